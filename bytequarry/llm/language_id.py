"""Operator 3: language identification by words first, with backoff to shorter and shorter character n-grams.

Every word of a text costs, in each language, minus the decimal logarithm of its relative frequency there. A word that
no language knows costs the mean over its n-grams of the greatest length of which any language knows one. The language
of the least mean cost over the text's words wins. The model keeps every word and n-gram of what it learns from, as
sorted 64-bit hashes with what each is worth in the languages that know it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bags import count_keys
from .common import Index, crc_mod, kept, quoted, saved, spread, trim, use_workers

LETTERS = regex.compile(r"\p{L}+")
#: Cost of what a language has not seen, as a decimal logarithm.
UNSEEN = 7.0
LONGEST = 5
#: Distinct stretches between white space whose costs a worker remembers, of LETTERS_EACH characters each on average.
REMEMBERED, LETTERS_EACH = 300_000, 24
#: Words of evidence that a score may stand for.
EVIDENCE = 20
#: Seed of the hashes, the one that Spark's xxhash64 has.
SEED = 42


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def hashed(units: list[str], n: int) -> np.ndarray:
    """Hashes of words (n = 0) or n-grams."""
    digest, lead = xxhash.xxh64_intdigest, f"{n}\t"
    return np.array([digest((lead + u).encode("utf-8", "replace"), SEED) for u in units], np.uint64)


class Model:
    """Languages; units known in any of them, as sorted hashes; for each unit a stretch of (language, gain): how much less
    than UNSEEN it costs there."""

    def __init__(self, langs: list[str], unit: np.ndarray, lang: np.ndarray, cost: np.ndarray):
        """unit, lang, cost: a row for each unit of each language."""
        order = np.lexsort((lang, unit))
        unit = unit[order]
        self.langs, self.lang, self.gain = langs, lang[order].astype(np.int32), (UNSEEN - cost[order]).astype(np.float64)
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.empty(0, np.int64)
        self.units, self.starts = unit[first], np.append(first, len(unit)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the units, -1 if it isn't there."""
        if not len(self.units):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.units, h), len(self.units) - 1)
        return np.where(self.units[at] == h, at, -1)

    def add(self, out: np.ndarray, row: np.ndarray, at: np.ndarray, share: np.ndarray) -> None:
        """Adds units' gains, times their share, to rows of out (a column for each language)."""
        n = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(row, n) * out.shape[1] + self.lang[entry]
        out += np.bincount(cell, self.gain[entry] * np.repeat(share, n), out.size).reshape(out.shape)


def fit(labelled: DataFrame, max_docs: int) -> Model:
    """The model of columns doc_id, text, lang (not null).

    Learns from a sample by hash of doc_id of about max_docs rows of each language (all, if it has no more), and from
    every word and n-gram of these.
    """
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], *(np.empty(0, t) for t in (np.uint64, np.int64, np.float64)))
    million = 1_000_000
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(million * min(1, max_docs / sizes[k])))) for k in langs))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < share[F.col("lang")])
    place = {k: i for i, k in enumerate(langs)}

    def word_bags(batch):
        kept("fit", make=list)  # lets go of what other operators keep
        bags = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            bags[lang].update(LETTERS.findall((text or "").lower()))
        for lang, bag in bags.items():
            yield {f"{place[lang]}\t0\t{w}": n for w, n in bag.items()}

    def gram_bags(batch):
        bag = defaultdict(int)
        for key, total in zip(batch.column("key").to_pylist(), batch.column("total").to_pylist(), strict=True):
            lang, _, word = key.split("\t")
            for n in range(1, LONGEST + 1):
                for g in grams(word, n):
                    bag[f"{lang}\t{n}\t{g}"] += total
        yield bag

    counted = saved(count_keys(sample, word_bags))
    every = counted.union(count_keys(counted, gram_bags))
    tab = F.instr("key", "\t")
    unit = F.substring(F.col("key"), tab + 1, F.length("key"))
    rows = every.select(F.xxhash64(unit).alias("unit"), F.substring(F.col("key"), F.lit(1), tab - 1).cast("int").alias("lang"), F.substring(F.col("key"), tab + 1, F.lit(1)).cast("int").alias("n"), "total")
    found = rows.toArrow()  # of a sample whose bound is a parameter: 24 bytes for each unit of each language
    unit, lang, n, total = (found.column(c).to_numpy() for c in ("unit", "lang", "n", "total"))
    group = lang.astype(np.int64) * (LONGEST + 1) + n
    sums = np.bincount(group, total, len(langs) * (LONGEST + 1))
    return Model(langs, unit.view(np.uint64), lang, -np.log10(total / sums[group]))


class Scorer:
    """Costs of texts; remembers stretches between white space within a worker."""

    def __init__(self, model: Model):
        self.model, self.langs = model, model.langs
        self.forget()

    @classmethod
    def of(cls, model: Model) -> Scorer:
        return kept("Scorer", id(model), make=lambda: cls(model))  # which holds the model, so its id stays its own

    def forget(self) -> None:
        self.index, self.held = Index(), 0
        trim()
        self.rows = np.zeros((0, len(self.langs) + 1))

    def units_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, unit, share): the units of the model whose mean is each word's cost; a word of which no language knows
        any part has none."""
        at = self.model.find(hashed(words, 0))
        row, unit, share = [np.flatnonzero(at >= 0)], [at[at >= 0]], [np.ones((at >= 0).sum())]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            parts = [grams(words[i], n) for i in left.tolist()]
            of = np.repeat(left, [len(p) for p in parts])
            at = self.model.find(hashed([g for p in parts for g in p], n)) if len(of) else np.empty(0, np.int64)
            of, at = of[at >= 0], at[at >= 0]
            if len(of):
                row.append(of)
                unit.append(at)
                share.append(1 / np.bincount(of, minlength=len(words))[of])
                left = np.setdiff1d(left, of)
            if not len(left):
                break
        return np.concatenate(row), np.concatenate(unit), np.concatenate(share)

    def learn(self) -> None:
        """Costs of the stretches that are new in the index, summed over their words, and how many words they have."""
        made = []
        new = list(islice(self.index, len(self.rows), None))
        for i in range(0, len(new), 5000):
            words, of, part = [], [], new[i : i + 5000]
            for k, stretch in enumerate(part):
                own = (stretch,) if stretch.isalpha() and stretch.isascii() else LETTERS.findall(stretch)
                words += own
                of += [k] * len(own)
                self.held += len(stretch)
            out = np.zeros((len(part), len(self.langs) + 1))
            if words:
                of = np.array(of)
                out[:, -1] = np.bincount(of, minlength=len(part))
                row, unit, share = self.units_of(words)
                known = np.bincount(of[np.unique(row)], minlength=len(part))
                gains = np.zeros((len(part), len(self.langs)))
                self.model.add(gains, of[row], unit, share)
                out[:, :-1] = known[:, None] * UNSEEN - gains
            made.append(out)
        self.rows = np.concatenate([self.rows, *made])
        self.index.new.clear()

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, score) of each text."""
        every, lengths = [], []
        for t in texts:
            w = t.lower().split() if t else []
            lengths.append(len(w))
            every += w
        lengths = np.array(lengths)
        sums = np.zeros((len(texts), len(self.langs) + 1))
        if every and self.langs:
            at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
            if len(self.index) > len(self.rows):
                self.learn()
            full = np.flatnonzero(lengths)
            sums[full] = np.add.reduceat(self.rows[at], (np.cumsum(lengths) - lengths)[full])
            if len(self.index) > REMEMBERED or self.held > LETTERS_EACH * REMEMBERED:
                self.forget()
        n = sums[:, -1]
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        mean = sums[:, :-1] / np.maximum(n, 1)[:, None]
        best = mean.argmin(1)
        odds = 10 ** -((mean - mean.min(1, keepdims=True)) * np.minimum(n, EVIDENCE)[:, None])
        return np.where(n > 0, best, -1), np.where(n > 0, 1 / odds.sum(1), 0.0)


def identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 4, held_fold: int = 2, max_docs: int = 4000) -> DataFrame:
    """(row, held_out, lang_pred, score) for each row; row holds all its columns.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) modulo folds is not held_fold (null id: the
    empty text), from a sample by hash of about max_docs rows a language; predictions look at texts only. lang_pred is
    a learned language, ties to the first in order of names, or `und` (score 0) if the text is null or has no letter,
    or nothing was learned. score: the language's share of the probability, of EVIDENCE words at most. Repeated rows
    give repeated results; an empty table an empty result.
    """
    spark = docs.sparkSession
    use_workers(spark)
    held = crc_mod(F.col(quoted(doc_id)), folds) == held_fold
    labelled = docs.where(~held & F.col(quoted(lang)).isNotNull()).select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"), F.col(quoted(lang)).cast("string").alias("lang"))
    shared = spark.sparkContext.broadcast(fit(labelled, max_docs))  # what a sample of a fixed bound holds
    rows = spread(docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), held.alias("held_out")))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        scorer = Scorer.of(shared.value)
        names = np.array([*scorer.langs, "und"], object)
        for batch in batches:
            texts = batch.column("row").field(text).to_pylist()
            parts = [scorer.score(texts[i : i + 300]) for i in range(0, len(texts), 300)]
            best, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, int), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["row", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def language_ids(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, as identified() has it."""
    made = identified(docs.select(*map(quoted, (doc_id, text, lang))), text, lang, doc_id, **options)
    return made.select(F.col("row")[doc_id].cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
