"""Mixing sources to target weights by hierarchical budgets.

A tree of groups (domain, language, source) gets a budget of tokens from the top down. At each node the budget is shared among the
children by weight; a child that cannot use its share gives the rest to its siblings, by weight again. As a node's capacity is what its
leaves hold together, only what all siblings cannot take is passed to the siblings of an ancestor. Each leaf then takes
the first documents of a seeded order until its budget is used up: whole epochs first, then a prefix of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_DIGITS = 3  # hex digits of the seeded order that make a slice; only one slice of a leaf is ordered row by row


def token_count(text: Column | str) -> Column:
    """Words parted by space and \\x09-\\x0D; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _weight(level: int, weights: list[dict[str, float]], col: str) -> Column:
    known = weights[level] if level < len(weights) else {}
    out = F.lit(1.0 if not known else float(known.get("*", 0.0)))
    for k, v in sorted(known.items()):
        if k != "*":
            out = F.when(F.col(col) == k, float(v)).otherwise(out)
    return out


def budgets(leaves: DataFrame, tree: list[str], weights: list[dict[str, float]], total: Column, epochs: int = 1) -> DataFrame:
    """(tree..., tokens, budget) of every leaf. ``leaves`` has (tree..., tokens); ``total`` is the budget as an expression over
    the column ``all_tokens``; ``weights[i]`` maps names of level i to weights ("*": any other; empty: all equal).

    A leaf holds at most ``epochs`` times its tokens. A leaf with a weight of 0 on its path holds nothing.
    Where the leaves together hold less than the total, every one of them is full.
    """
    # levels may have any name, so all columns of the work have names of their own
    keys = [f"__n{i}" for i in range(len(tree))]
    usable = F.lit(True)
    for level, name in enumerate(tree):
        usable = usable & (_weight(level, weights, name) > 0)
    cap = F.when(usable, (F.col("tokens") * F.lit(epochs)).cast("double")).otherwise(F.lit(0.0))
    cap = leaves.select(*[F.col(c).alias(k) for c, k in zip(tree, keys, strict=True)], F.col("tokens").alias("__tokens"), cap.alias("__cap"))
    node = cap.agg(F.sum("__tokens").alias("all_tokens"), F.sum("__cap").alias("__c")).select(F.least(total.cast("double"), F.col("__c")).alias("__budget"), F.lit(1).alias("__one"))
    for level in range(len(tree)):
        names, parent = keys[: level + 1], keys[:level] or ["__one"]
        own = cap.groupBy(*names).agg(F.sum("__cap").alias("__c")).withColumn("__one", F.lit(1))
        own = own.withColumn("__w", _weight(level, weights, keys[level])).join(node, parent)
        # children in the order in which rising water fills them: those before one are full when it is
        ratio = F.when(F.col("__w") > 0, F.col("__c") / F.col("__w")).otherwise(F.lit(float("inf")))
        order = W.partitionBy(*parent).orderBy(ratio, *names)
        filled = F.coalesce(F.sum("__c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        rest_w = F.sum("__w").over(order.rowsBetween(0, W.unboundedFollowing))
        own = own.withColumn("__share", F.when(rest_w > 0, (F.col("__budget") - filled) / rest_w).otherwise(F.lit(0.0))).withColumn("__full", F.col("__w") * F.col("__share") >= F.col("__c"))
        # the water level is the share of the first child that is not full
        first = F.min(F.when(~F.col("__full"), F.struct(ratio.alias("__r"), *[F.col(n) for n in names], F.col("__share").alias("__s")))).over(W.partitionBy(*parent))
        own = own.withColumn("__s", first["__s"])
        node = own.select(*names, F.when(F.col("__full"), F.col("__c")).otherwise(F.col("__w") * F.col("__s")).alias("__budget"))
    named = [F.col(k).alias(c) for c, k in zip(tree, keys, strict=True)]
    return cap.join(node, keys).select(*named, F.col("__tokens").alias("tokens"), F.floor("__budget").cast("bigint").alias("budget"))


def mix(
    docs: DataFrame, tree: list[str], weights: list[dict[str, float]], total: Column, epochs: int = 1, seed: str = "0", ident: str = "doc_id", tokens: str = "n_tokens", digits: int = SLICE_DIGITS
) -> DataFrame:
    """``docs`` with a column ``copies``: how many epochs take the row (0: left out). All rows stay, and all columns but one that is called ``copies`` before.

    ``tree`` names columns of ``docs``; null names form a group of their own. Rows of a leaf are ordered by the md5 of (seed, epoch, ident), rows of
    equal order are taken together or not at all. A null ident counts as an empty one. An empty table gives an empty result.
    """
    keys = [f"__k{i}" for i in range(len(tree))]
    rows = docs.drop("copies").select("*", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(k) for c, k in zip(tree, keys, strict=True)))
    leaf = budgets(rows.groupBy(*keys).agg(F.sum(tokens).alias("tokens")), keys, weights, total, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("bigint")
    leaf = leaf.select(*keys, whole.alias("__whole"), (F.col("budget") - whole * F.col("tokens")).alias("__rest"))
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.col("__whole").cast("string"), F.coalesce(F.col(ident).cast("string"), F.lit(""))).cast("binary"))
    rows = rows.join(leaf, keys).withColumn("__rank", rank).withColumn("__slice", F.substring("__rank", 1, digits))
    # where the running total passes the rest: totals of slices first, then rows inside the one slice
    slices = rows.groupBy(*keys, "__slice").agg(F.sum(tokens).alias("__t"), F.first("__rest").alias("__r"))
    upto = F.sum("__t").over(W.partitionBy(*keys).orderBy("__slice"))
    slices = slices.select(*keys, "__slice", (upto - F.col("__t")).alias("__before"), (upto <= F.col("__r")).alias("__in"), (upto - F.col("__t") > F.col("__r")).alias("__out"))
    rows = rows.join(slices, [*keys, "__slice"])
    cut = rows.filter("NOT __in AND NOT __out")
    inside = F.sum(tokens).over(W.partitionBy(*keys, "__slice").orderBy("__rank"))
    cut = cut.withColumn("__in", F.col("__before") + inside <= F.col("__rest"))
    out = rows.filter("__in OR __out").unionByName(cut)
    return out.withColumn("copies", F.col("__whole") + F.col("__in").cast("bigint")).select(*[c for c in docs.columns if c != "copies"], "copies")
