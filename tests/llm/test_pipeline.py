"""The pipeline's stages against what each has to keep."""

import re

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from bytequarry.llm import golay_simhash, language_id, mixing, pii_crf, queries, sentencepieces, shingle_sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module", params=["hard", "table"])
def stages(request, spark, docs, sf_dir, tmp_path_factory):
    """(docs before, docs after) of every stage."""
    df = docs.select(*COLUMNS) if request.param == "hard" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages').as_uri()}/{name}"
        stage(spark, df, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (df, after)
        df = after
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "pieces"]
    for name, (_, after) in stages.items():
        assert name == "pieces" or after.columns == COLUMNS


def test_language(stages):
    before, after = stages["language"]
    rejected = {(r.row.doc_id) for r in language_id.identified(before).collect() if r.lang_pred == "und" or r.score < corpus_pipeline.LEAST_SCORE}
    assert rows(after) == [r for r in rows(before) if r[0] not in rejected]
    assert rejected <= {None} | {r[0] for r in rows(before) if not re.search(r"[^\W\d_]", r[1] or "")} | rejected - {r[0] for r in rows(before) if len(r[1] or "") > 40}


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    own = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
    fps = [[golay_simhash.fingerprint((x or "").encode(), k) for k in corpus_pipeline.SHINGLE_WORDS] for _, x in own]
    sets = [set(shingle_sets.shingle_set((x or "").encode(), 5).tolist()) for _, x in own]
    label = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            alike = sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if (alike or any((a ^ b).bit_count() <= 3 for a, b in zip(fps[i], fps[j], strict=True))) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(own, label, strict=True):
        least[x] = min(i, least.get(x, i))
    stay = {i for (i, _), x in zip(own, label, strict=True) if least[x] == i}
    assert rows(after) == [r for r in rows(before) if r[0] is None or r[0] in stay]


def test_personal_data(stages):
    before, after = stages["personal_data"]
    field = pii_crf.trained()
    want = []
    for i, text, lang, source, n in rows(before):
        spans = pii_crf.all_spans(text or "", field, 0.9)[1]
        new = pii_crf.redact(text, spans) if spans else text
        want.append((i, new, lang, source, len(new) if spans else n))
    assert rows(after) == sorted(want, key=str)
    assert not any(pii_crf.base_spans(r[1] or "") for r in rows(after))


def test_mixing(stages):
    before, after = stages["mixing"]
    kept = mixing.mix(before, queries.mix_tree(), queries.MIX_WEIGHTS, fraction=corpus_pipeline.MIX_FRACTION, max_epochs=1, seed=1)
    assert rows(after) == rows(kept.select("row.*")) and set(rows(after)) <= set(rows(before))
    taken = kept.agg(F.sum("mix_taken")).first()[0]
    supply = before.agg(F.sum(mixing.estimated_tokens(F.col("text")))).first()[0]
    assert abs(taken - corpus_pipeline.MIX_FRACTION * supply) <= 100


def test_pieces(stages):
    before, after = stages["pieces"]
    again = sentencepieces.decoded(after, P.path(queries.PIECE_BPE)).select("doc_id", "text")
    assert rows(again) == sorted(((r[0], r[1] or "") for r in rows(before)), key=str)


def test_columns_with_odd_names(spark, docs, sf_dir):
    """Names with dots, and names that operators use inside, pass through all stages but the last; so do empty tables."""
    odd = docs.select(*COLUMNS, F.lit(1).alias("a.b"), F.lit(2).alias("mix_note"), F.lit(3).alias("mix_leaf"), F.lit(4).alias("row"), F.lit(5).alias("a`b"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf_dir)
        assert name == "pieces" or made.columns == odd.columns
        assert made.count() >= 3
        assert stage(spark, odd.where("false"), sf_dir).count() == 0


def test_heaps_are_freed(spark, docs, sf_dir):
    """Heaps are collected in full before a stage begins, and within the near-duplicates stage."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: max(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs.select(*COLUMNS), sf_dir)
        assert full() - before >= (5 if name == "near_duplicates" else 1), name


def test_mixing_starts_no_other_workers(spark, docs, monkeypatch):
    """The budgets are no list that goes through workers of its own, which would stay beside the others."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_, **__: pytest.fail("rows went through Python workers"))
    kept = mixing.mix(docs, queries.mix_tree(), queries.MIX_WEIGHTS, fraction=0.9, seed=1)
    assert kept.count() >= 3


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
