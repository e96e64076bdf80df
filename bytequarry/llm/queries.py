"""The registered queries of the corpus operators: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_lm import bloom_lm_scores
from .common import documents
from .ego_join import near_vectors
from .golay_simhash import simhash_components
from .kmeans_tree import nearest
from .language_id import language_ids
from .mixing import mix
from .pii_crf import personal_data
from .sentencepieces import segmented
from .token_counts import token_counts
from .token_files import token_files

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


#: Target weights of the mix: domains, and languages within each; sources of a language weigh the same.
DOMAINS = {"web": 0.5, "books": 0.3, "reference": 0.2}
LANGUAGES = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}
MIX_WEIGHTS = {(d,): w for d, w in DOMAINS.items()} | {(d, k): w for d in DOMAINS for k, w in LANGUAGES.items()}


def mix_tree() -> list:
    """Domain (by the number in the source's name: 0 to 9 web, 10 to 14 books, else reference), language, source."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,6})$", 1).try_cast("int"), F.lit(99))
    return [F.when(number < 10, "web").when(number < 15, "books").otherwise("reference"), F.col("lang"), F.col("source")]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), mix_tree(), MIX_WEIGHTS, fraction=0.7, max_epochs=2, seed=1)
    leaf = F.concat_ws("/", F.transform("mix_leaf", lambda x: F.coalesce(x, F.lit("-"))))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), leaf.alias("leaf"), F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_taken").alias("taken"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = segmented(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE), n_best=4)
    second = F.try_element_at("scores", F.lit(2))
    return made.select("doc_id", "n_pieces", "ids_crc32", F.col("scores")[0].alias("score"), (F.col("scores")[0] - second).alias("margin"), F.size("scores").alias("n_best"), "decoded_equal")


def op5_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).drop("redacted")


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm_scores(documents(spark, sf_dir))


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end_id=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_token_counts, op3_language_id, op4_sentencepiece, op5_ego_join, op6_kmeans_tree, op7_pii_crf, op8_bloom_lm, op9_golay_simhash, op10_token_files)}


#: The links, and who can be reached over them. The other operators' results rest on tokenizers, hashes or models that SQL lacks.
EGO_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ego_join": EGO_SQL}
