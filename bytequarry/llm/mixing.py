"""Operator 1: mixing sources to target weights in a tree of domains, languages and sources.

Each node of the tree passes its token budget on to its children by their weights. A child that cannot spend its share,
because its subtree holds fewer tokens even after max_epochs passes, gives the rest back to its siblings, by their
weights; only what a whole family cannot spend goes up to the parent's siblings. A leaf then takes the prefix of its
documents, epoch after epoch in an order shuffled anew by a seed, that fills its budget.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, saved

#: Rows up to which the table of stretches is broadcast (some 100 bytes each); beyond it Spark joins it by its own choice.
BROADCAST_ROWS = 500_000
#: A leaf's order in an epoch is cut into 2**STRETCH_BITS stretches of hashes, and the one in which its budget ends into as many again.
STRETCH_BITS = 10
#: Bytes of UTF-8 that stand for a token, about as many as byte-level vocabularies need.
TOKEN_BYTES = 4


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text by its bytes, a measure that costs nothing and grows as tokens do in any script, with spaces
    between words or without; null and empty texts have none."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / TOKEN_BYTES).cast("long")


def share(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Budgets of children given as (weight, capacity): by weight, what one cannot spend going to the others by weight.

    Children of weight 0 get something only when all others are full, in equal shares.
    """
    out = [0.0] * len(children)
    for group in ([i for i, c in enumerate(children) if c[0] > 0], [i for i, c in enumerate(children) if c[0] <= 0]):
        open_, left = group, min(budget - sum(out), sum(children[i][1] for i in group))
        while open_ and left > 0:
            weight = {i: children[i][0] if children[i][0] > 0 else 1.0 for i in open_}
            total = sum(weight.values())
            full = [i for i in open_ if left * weight[i] / total >= children[i][1]]
            if not full:
                for i in open_:
                    out[i] = left * weight[i] / total
                break
            for i in full:
                out[i] = children[i][1]
            left -= sum(out[i] for i in full)
            open_ = [i for i in open_ if i not in full]
    return out


def allocate(budget: float, leaves: dict[tuple, float], weights: dict[tuple, float], depth: int = 0, names: Sequence | None = None) -> dict[tuple, float]:
    """Budget of each leaf. leaves: path to capacity; weights: path of any node to its weight among its siblings (1)."""
    names = list(leaves) if names is None else names
    if not names:
        return {}
    if len(names[0]) == depth:
        return {names[0]: min(budget, leaves[names[0]])}
    families: dict[tuple, list[tuple]] = {}
    for name in names:
        families.setdefault(name[: depth + 1], []).append(name)
    order = sorted(families, key=lambda p: tuple((x is None, str(x)) for x in p))
    shares = share(budget, [(weights.get(p, 1.0), sum(leaves[n] for n in families[p])) for p in order])
    out = {}
    for p, b in zip(order, shares, strict=True):
        out |= allocate(b, leaves, weights, depth + 1, families[p])
    return out


def mix(docs: DataFrame, tree: Sequence[Column], weights: dict[tuple, float], budget: float | None = None, fraction: float = 1.0, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, mix_leaf, mix_epoch, mix_tokens, mix_taken): the documents chosen, once for each epoch that takes them. row
    holds all their columns; mix_leaf is an array of strings, mix_epoch counts from 0, mix_taken says how many of its
    tokens the budget reaches; only a leaf's last document is taken in part.

    tree: columns of the levels, from the root's children to the leaves; a null is a branch of its own.
    weights: weight of a node, by its path, among its siblings; 1 where none is given. budget: tokens in all; else
    fraction of the documents' tokens. tokens: how many a row has (estimated_tokens, if not given; null counts as 0).
    Order within a leaf and epoch: by hash of seed, epoch and doc_id (for a null one, of the text), then doc_id and text.
    A document is taken if the tokens before it are fewer than the budget; documents of leaves without any tokens are
    all taken, once. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own_id, own_text = F.col(quoted(doc_id)), F.col(quoted(text)).cast("string")
    n = F.coalesce((tokens if tokens is not None else estimated_tokens(own_text)).cast("long"), F.lit(0))
    epoch = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("mix_epoch")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.array(*[c.cast("string") for c in tree]).alias("mix_leaf"), n.alias("mix_tokens"), own_id.alias("mix_id"), own_text.alias("mix_text"))
    rows = rows.select("*", F.to_json("mix_leaf").alias("mix_key"), epoch)  # equal paths, nulls too, have equal keys
    named = F.xxhash64(F.lit(seed), F.col("mix_epoch"), F.col("mix_id").cast("string"))
    rows = rows.withColumn("mix_hash", F.when(F.col("mix_id").isNotNull(), named).otherwise(F.xxhash64(F.lit(seed), F.col("mix_epoch"), F.col("mix_text"))))
    rows = rows.withColumn("mix_stretch", F.shiftrightunsigned("mix_hash", 64 - STRETCH_BITS).cast("int"))
    rows = rows.withColumn("mix_part", F.shiftrightunsigned("mix_hash", 64 - 2 * STRETCH_BITS).bitwiseAND((1 << STRETCH_BITS) - 1).cast("int"))
    # Sums over stretches of the order come first, then sums over parts of the one stretch in which a leaf's budget ends:
    # no leaf's documents ever stand in one task, and only a part of a part of a leaf is put in order.
    place = ["mix_key", "mix_epoch", "mix_stretch"]
    sums = saved(rows.groupBy(*place).agg(F.first("mix_leaf").alias("leaf"), F.sum("mix_tokens").alias("mix_sum")))
    leaves = sums.where("mix_epoch = 0").groupBy("mix_key").agg(F.first("leaf").alias("leaf"), F.sum("mix_sum").alias("supply")).collect()  # a row a leaf
    supply = {tuple(r["leaf"]): r["supply"] for r in leaves}
    total = fraction * sum(supply.values()) if budget is None else budget
    given = allocate(total, {k: max_epochs * v for k, v in supply.items()}, {tuple(map(str, k)): w for k, w in weights.items()})
    plan = [(r["mix_key"], r["supply"], int(given[tuple(r["leaf"])] + 0.5)) for r in leaves]
    kinds = {"mix_key": pa.string(), "mix_supply": pa.int64(), "mix_budget": pa.int64()}
    # As an Arrow table, as a list of rows would go through Python workers of another kind, which stay beside the others.
    plan = spark.createDataFrame(pa.table({k: pa.array([x[i] for x in plan], t) for i, (k, t) in enumerate(kinds.items())}))
    small = len(leaves) * max_epochs << STRETCH_BITS <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda df: df)

    def placed(df, order, start):
        """The sums' places in a leaf's order: tokens before each, and whether all of it is inside the budget."""
        ahead = F.sum("mix_sum").over(Window.partitionBy("mix_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("mix_start", start + F.coalesce(ahead, F.lit(0)))
        free = (F.col("mix_supply") == 0) & (F.col("mix_epoch") == 0)
        return df.where((F.col("mix_start") < F.col("mix_budget")) | free).withColumn("mix_inside", (F.col("mix_start") + F.col("mix_sum") <= F.col("mix_budget")) | free)

    stretches = saved(placed(sums.drop("leaf").join(plan, "mix_key"), ["mix_epoch", "mix_stretch"], F.lit(0)))
    edges = stretches.where("not mix_inside").select(*place, F.col("mix_start").alias("mix_from"), "mix_supply", "mix_budget")  # one a leaf at most
    cut = rows.join(sent(edges), place).groupBy(*place, "mix_part").agg(F.sum("mix_tokens").alias("mix_sum"), *[F.first(c).alias(c) for c in ("mix_from", "mix_supply", "mix_budget")])
    parts = saved(placed(cut, ["mix_part"], F.col("mix_from")))
    whole = rows.join(sent(stretches.select(*place, "mix_inside")), place)
    whole = whole.join(sent(parts.where("mix_inside").select(*place, "mix_part", F.lit(True).alias("mix_in_part"))), [*place, "mix_part"], "left")
    out = ["row", "mix_leaf", "mix_epoch", "mix_tokens"]
    whole = whole.where(F.col("mix_inside") | F.col("mix_in_part")).select(*out, F.col("mix_tokens").alias("mix_taken"))
    last = rows.join(sent(parts.where("not mix_inside").select(*place, "mix_part", "mix_start", "mix_budget")), [*place, "mix_part"])
    before = F.sum("mix_tokens").over(Window.partitionBy(*place).orderBy("mix_hash", "mix_id", "mix_text").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("mix_before", F.col("mix_start") + F.coalesce(before, F.lit(0))).where("mix_before < mix_budget")
    return whole.union(last.select(*out, F.least(F.col("mix_tokens"), F.col("mix_budget") - F.col("mix_before")).alias("mix_taken")))
