"""Mixing sources to target weights by hierarchical token budgets.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut

#: Leaves (some 60 bytes each) up to which their budgets are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LEAVES = 100_000
_BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Integer weight of a node among its siblings; 1 where none is given."""
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == len(levels):
            out = F.when(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(levels, path, strict=True)]), F.lit(w)).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: Sequence[str], own: Sequence[str]) -> DataFrame:
    """Budgets of siblings: parts in proportion to weight, none above its capacity, what is left over going to the others.

    nodes: own columns, cap, weight, budget of the parent.  With siblings in order of cap / weight, those up to the first that can take
    its part of what the ones before leave over are full.
    """
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = family.orderBy((F.col("cap") / F.col("weight")).asc(), *own).rowsBetween(W.unboundedPreceding, -1)
    big = lambda c: c.cast(_BIG)
    nodes = nodes.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights"), F.sum("weight").over(family).alias("all_weights"))
    full = big(F.col("cap")) * big(F.col("all_weights") - F.col("weights")) <= big(F.col("weight")) * big(F.col("budget") - F.col("caps"))
    nodes = nodes.withColumn("full", full)
    taken = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(family), F.lit(0))
    nodes = nodes.select("*", taken("cap").alias("full_cap"), taken("weight").alias("full_weight"))
    nodes = nodes.withColumns({"part": big(F.col("weight")) * big(F.col("budget") - F.col("full_cap")), "over": big(F.col("all_weights") - F.col("full_weight"))})
    part = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("CAST(part div over AS BIGINT)"))
    return nodes.select(*own, part.alias("budget"))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], percent: int, epochs: int) -> DataFrame:
    """levels, tokens, target: the token budget of each leaf.

    The root gets percent % of all tokens.  A node's capacity is that of its leaves, tokens * epochs; budgets go down from the root, so what a
    leaf lacks goes to its siblings first and leaves a branch only when the whole branch is full.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    above: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        own, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(own, weights))
        if above is None:
            # One row.
            nodes = nodes.join(F.broadcast(leaves.agg(F.expr(f"CAST(least(CAST(sum(tokens) AS {_BIG}) * {percent} div 100, sum(cap)) AS BIGINT)").alias("budget"))))
        else:
            nodes = nodes.join(above, parent)
        above = _fill(nodes, parent, own)
    return leaves.select(*levels, "tokens").join(above.withColumnRenamed("budget", "target"), list(levels))


def mix_sources(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], int], percent: int = 50, epochs: int = 2, seed: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the levels, tokens, target, copies; one row for each row of docs.

    levels: from the root down, column names and what they are of docs.  weights: integer weights of 1 or more by path (ValueError else); 1 where none is given.  Each
    leaf draws its target from passes over its documents, each in the order of md5(seed:pass:id): whole passes first, then the
    longest prefix of the next that fits.  copies says how often a document is drawn, 0 if not at all.

    Cumulative tokens are taken within (leaf, first three digits of the digest), onto the sums of the digits before, so a leaf with a
    third of all rows is spread over 4096 groups.  Null levels and ids count as empty strings.  A null, empty or blank text has no
    tokens; it is drawn with the prefix that it falls into.  Equal ids tie in one order by tokens.  Other columns of docs are not looked at.
    """
    wrong = {path: w for path, w in weights.items() if w < 1}
    if wrong:
        raise ValueError(f"weights are 1 or more; leave out by a filter instead: {wrong}")
    names = list(levels)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()], n_words(F.col(text_column).cast("string")).alias("tokens"))
    rows = cut(rows)
    leaves = cut(budgets(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), names, weights, percent, epochs))
    leaves = leaves.withColumnRenamed("tokens", "leaf_tokens").withColumn("passes", F.coalesce(F.expr("target div nullif(leaf_tokens, 0)"), F.lit(0)))
    leaves = leaves.withColumn("rest", F.col("target") - F.col("passes") * F.col("leaf_tokens"))
    drawn = rows.join(F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves, names)
    drawn = drawn.withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("passes").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    drawn = drawn.withColumn("block", F.substring("digest", 1, 3))
    sums = drawn.groupBy(*names, "block").agg(F.sum("tokens").alias("own"))
    sums = sums.select(*names, "block", (F.sum("own").over(W.partitionBy(*names).orderBy("block")) - F.col("own")).alias("before"))
    drawn = drawn.join(sums, [*names, "block"])
    until = F.col("before") + F.sum("tokens").over(W.partitionBy(*names, "block").orderBy("digest", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, 0))
    copies = F.col("passes") + F.when((F.col("rest") > 0) & (until <= F.col("rest")), 1).otherwise(0)
    return drawn.select("doc_id", *names, "tokens", "target", copies.cast("int").alias("copies"))


def oracle_sql(domain: str, weights: Mapping[tuple[str, ...], int], percent: int, epochs: int, seed: int) -> str:
    """DuckDB SQL of mix_sources over documents with levels domain (an SQL expression), lang and source."""
    levels = ["domain", "lang", "source"]

    def weight(depth: int) -> str:
        cases = "".join(f" WHEN {' AND '.join(f'{c} = {chr(39)}{v}{chr(39)}' for c, v in zip(levels, path))} THEN {w}" for path, w in reversed(list(weights.items())) if len(path) == depth)
        return f"CAST(CASE{cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"

    steps = []
    for depth in (1, 2, 3):
        own, parent = ", ".join(levels[:depth]), ", ".join(levels[: depth - 1])
        budget = f"(SELECT CAST(least(CAST(sum(tokens) AS HUGEINT) * {percent} // 100, sum(tokens) * {epochs}) AS BIGINT) FROM leaf)" if depth == 1 else "budget"
        source = "leaf" if depth == 1 else f"leaf JOIN fill{depth - 1} USING ({parent})"
        by = f"PARTITION BY {parent}" if parent else ""
        steps.append(f"""
node{depth} AS (SELECT {own}, {weight(depth)} AS weight, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap, {'any_value(budget)' if depth > 1 else budget} AS budget FROM {source} GROUP BY {own}),
mark{depth} AS (SELECT *, CAST(cap AS HUGEINT) * (all_weights - weights) <= CAST(weight AS HUGEINT) * (budget - caps) AS is_full FROM (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(weight) OVER b, 0) AS weights, sum(weight) OVER ({by}) AS all_weights FROM node{depth}
  WINDOW b AS ({by} ORDER BY CAST(cap AS DOUBLE) / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
fill{depth} AS (SELECT {own}, CAST(CASE WHEN is_full THEN cap ELSE CAST(weight AS HUGEINT) * (budget - coalesce(sum(cap) FILTER (is_full) OVER ({by}), 0)) // (all_weights - coalesce(sum(weight) FILTER (is_full) OVER ({by}), 0)) END AS BIGINT) AS budget FROM mark{depth}),""")
    return rf"""
WITH doc AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM doc GROUP BY ALL),{''.join(steps)}
plan AS (SELECT leaf.*, budget AS target, coalesce(budget // nullif(tokens, 0), 0) AS passes FROM leaf JOIN fill3 USING (domain, lang, source)),
drawn AS (SELECT doc.*, target, passes, target - passes * plan.tokens AS rest, md5('{seed}:' || passes || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM doc JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, target, CAST(passes + CASE WHEN rest > 0 AND sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY digest, doc_id, tokens ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM drawn
"""
