"""Operator 2: token counts. Pieces are counted once for each distinct pre-token, joined to the documents' pre-token
frequencies and summed; no document's ids are ever made."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bags import CORE_KEYS, LONG_KEY, bag_sums, core_of, count_keys, joined_key, row_key
from .common import saved, spread, texts_of, use_workers
from .pretokens import PreTokenizer


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", limit: int = 1024, core_keys: int = CORE_KEYS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    docs: any table with an id and a text; other columns are ignored. Null text counts as empty (0 bytes, 0 tokens).
    A null id stays null. Repeated rows give repeated results. An empty table gives an empty result.
    tokenizer: path of a byte-level BPE file of the tokenizers library, readable on every worker. No begin, end or
    added tokens; special strings inside a text count as the library's default has it (one token).
    core_keys: most pre-tokens that are broadcast; rarer ones are joined through a shuffle, long ones by a digest of 128
    bits.
    """
    spark = docs.sparkSession
    use_workers(spark)
    rows = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))

    def bags(batch):
        pieces = PreTokenizer.at(tokenizer).pieces
        for x in texts_of(batch):
            yield Counter(pieces(x))

    def sizes(batches):
        encode = PreTokenizer.at(tokenizer).encode_pieces
        for b in batches:
            keys = b.column("key").to_pylist()
            n = [len(ids) for i in range(0, len(keys), 5000) for ids in encode(keys[i : i + 5000])]
            yield pa.RecordBatch.from_arrays([pa.array(map(joined_key, keys), pa.string()), b.column("total"), pa.array(n, pa.int64())], ["key", "total", "size"])

    vocabulary = saved(count_keys(rows.select("text"), bags).mapInArrow(sizes, "key string, total long, size long"))
    core, least = core_of(vocabulary, "size", core_keys)
    shared = spark.sparkContext.broadcast(core)

    def split(batches):
        size, pieces = shared.value, PreTokenizer.at(tokenizer).pieces
        get = size.get
        for i, x in (row for b in batches for row in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True)):
            bag, known, rare = Counter(pieces(x)), 0, {}
            for k, n in bag.items():
                s = get(k if len(k) <= LONG_KEY else joined_key(k))
                if s is None:
                    rare[k] = n
                else:
                    known += n * s
            raw = x.encode()
            yield row_key(i, raw), (i, len(raw)), (known,), rare

    out = bag_sums(rows, {"doc_id": "long", "n_bytes": "long"}, split, vocabulary, "size", least, {"n_tokens": "long"}, {"n_tokens": lambda n, v: n * v})
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
