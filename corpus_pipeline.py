"""The corpus pipeline: five stages, each working on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and
reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm.common import free_heaps, quoted, saved, sent, shared_dir
from bytequarry.llm.golay_simhash import near_duplicates as similar
from bytequarry.llm.language_id import identified
from bytequarry.llm.mixing import mix
from bytequarry.llm.pii_crf import marked
from bytequarry.llm.queries import MIX_WEIGHTS, PIECE_BPE, mix_tree
from bytequarry.llm.sentencepieces import segmented

#: A language below this share of the probability is not taken for certain: less than any best of four can be by evidence.
LEAST_SCORE = 0.3
#: Words of a shingle in the near-duplicate stage's fingerprints: two documents link by either, and by a Jaccard
#: similarity of 0.8 or more between their sets of five-word shingles.
SHINGLE_WORDS = (3, 5)
#: Tokens that the mix may spend, as a share of all that it gets; no document is taken twice.
MIX_FRACTION = 0.9
#: Words that a worker remembers in the last stage, fewer than where it is the only one.
WORDS = 50_000


def lean(stage: Callable) -> Callable:
    """The stage, begun with heaps that hold only what is in use, whatever ran before it."""

    @wraps(stage)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run_lean


@lean
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; texts that are null or have no letter, and undecided ones, go."""
    known = identified(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.select("row.*")


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id stays; rows without doc_id stay as they are."""
    extra = sent(saved(similar(docs, SHINGLE_WORDS).select("doc_id")))
    return docs.join(extra, "doc_id", "left_anti").select(*map(quoted, docs.columns))


@lean
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kind in angle brackets; n_chars follows where that changes it."""
    made, row = marked(docs), F.col("row")
    changed = made["spans"] != ""
    new = {"text": made["redacted"], "n_chars": F.when(changed, F.length("redacted").cast("long")).otherwise(row["n_chars"])}
    return made.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


@lean
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the sources' budgets, each once."""
    return mix(docs, mix_tree(), MIX_WEIGHTS, fraction=MIX_FRACTION, max_epochs=1, seed=1).select("row.*")


@lean
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces: ids of the best segmentation, scores of the best ones, and whether decoding gives it back."""
    return segmented(docs, public_tokenizers.path(PIECE_BPE), n_best=4, with_ids=True, remembered=WORDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("pieces", pieces)]

#: SQL can express none of the stages' decisions; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
