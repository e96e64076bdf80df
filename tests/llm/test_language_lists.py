"""The language model keeps all words and n-grams that it learns from."""

import random
import zlib

from bytequarry.llm import language_id


def test_language_knows_rarer_words(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        w = ["".join(rng.choice("aeioklmnst") for _ in range(7)) for _ in range(500)]
        rows.append((i, " ".join(w), "xy"[i % 2]))
        rows.append((100 + i, " ".join(["common"] + w[:250]), "xy"[i % 2]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = language_id.fit
    language_id.fit = lambda *a: seen.append(fit(*a)) or seen[-1]
    try:
        language_id.language_ids(df).collect()
    finally:
        language_id.fit = fit
    words = {w for i, x, _ in rows if language_id.LETTERS.fullmatch(x.split()[0]) for w in x.split()}
    model = seen[0]
    learned = {w for i, x, _ in rows for w in x.split() if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(learned) > 20_000 * 0.9 and learned <= words
    assert (model.find(language_id.hashed(sorted(learned), 0)) >= 0).all()
    five = sorted({g for w in learned for g in language_id.grams(w, 5)})
    assert len(five) > 16_000 and (model.find(language_id.hashed(five, 5)) >= 0).all()
