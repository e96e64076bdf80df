"""Cases that operators once cut: near copies between 0.8 and 0.98."""

import random

from bytequarry.llm import golay_simhash, shingle_sets


def test_near_duplicates_by_jaccard(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for changed in (0, 1, 2, 3, 4, 6, 10):  # words replaced of 200, five shingles each
        for _ in range(6):
            w = [f"w{rng.randrange(5000)}" for _ in range(200)]
            v = list(w)
            for at in range(changed):
                v[10 + 15 * at] = "changed"
            rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
            i += 2
    rows += [(i, "one two"), (i + 1, "one two"), (i + 2, "one three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: set(shingle_sets.shingle_set(x.encode(), 5).tolist()) for d, x in rows}
    want = {d: min(e for e, _ in rows if len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])) for d, _ in rows}
    for block in (512, 1):  # small blocks: every component is dealt out
        assert {r.doc_id: r.component_id for r in shingle_sets.jaccard_components(df, block=block).collect()} == want
    got = {r.doc_id for r in golay_simhash.near_duplicates(df).collect()}
    assert got >= {d for d, c in want.items() if c < d}
