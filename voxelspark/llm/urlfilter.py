"""URL filtering by path templates learnt per host.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Values of a shape that make a wildcard; of digits, two do.
VARIETY, VARIETY_OF_IDS = 8, 2
#: Paths from which a branch is judged by itself instead of as one of many values.
POWER = 30
#: Labelled paths from which a rare value must agree with the other labels of its shape.
SUPPORT = 5
#: Largest difference of two label rates (with its 95 % bound) and of two branches' shares of child shapes (beyond sampling error) to count as similar.
RATES, SHAPES = 0.5, 0.1
#: Pseudo-counts of the prior and the smoothed share of bad labels from which a template is rejected.
STRENGTH, REJECT = 4.0, 0.8
#: At most so many keys are hot: those that hold this part of all rows or more (and LEAST rows) are joined by a broadcast.
HOT_KEYS, LEAST = 50_000, 1000
_IDS = ("num", "num.ext", "hex")
_KINDS = (*_IDS, "mixed", "word", "")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty for null or without ://."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, bool]]) -> tuple[Column, Column]:
    """The longest of the rules (host, path, block) that fits, as host and path together, and whether it blocks; else null."""
    found, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for h, p, bad in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found, block = F.when(fits, F.lit(h + p)).otherwise(found), F.when(fits, F.lit(bad)).otherwise(block)
    return found, block


def _shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "num")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), "num.ext")
        .when(segment.rlike(r"^[0-9A-Fa-f-]{8,}$"), "hex")
        .when(segment.rlike(r"[0-9]"), "mixed")
        .otherwise("word")
    )


def _joined(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str, hot: int) -> DataFrame:
    """rows with the facts on their keys, each of which has one.  weight: how many of the rows have the key.

    Facts of hot rows or more are broadcast; there are at most HOT_KEYS of them, so the rest is a shuffle without heavy keys.
    """
    names = [c for c in facts.columns if c not in keys and c != weight]
    few = facts.where(F.col(weight) >= hot).select(*keys, F.struct(*names).alias("_fact"))
    tried = rows.join(F.broadcast(few), list(keys), "left")
    cold = tried.where("_fact is null").drop("_fact").join(facts.where(F.col(weight) < hot).select(*keys, *names), list(keys))
    return tried.where("_fact is not null").select(*rows.columns, "_fact.*").union(cold.select(*rows.columns, *names))


def _hot(total: int) -> int:
    return max(LEAST, -(-total // HOT_KEYS))


def _same_rate() -> Column:
    """Whether a value's label rate is that of the others, for certain: without enough labels on both sides nothing is alike."""
    rate = lambda bad, n: (bad + 1) / (n + 2)
    spread = lambda bad, n: rate(bad, n) * (1 - rate(bad, n)) / (n + 2)
    own, rest = (F.col("bad"), F.col("labelled")), (F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled"))
    return F.abs(rate(*own) - rate(*rest)) + 1.64 * F.sqrt(spread(*own) + spread(*rest)) <= RATES


def _same_children() -> Column:
    """Whether the shapes of a branch's children are distributed as those of the others."""
    others = F.greatest(F.col("all_paths") - F.col("paths"), F.lit(1))
    apart = sum((F.abs(F.col(f"s{i}") / F.col("paths") - (F.col(f"all_s{i}") - F.col(f"s{i}")) / others) for i in range(len(_KINDS))), F.lit(0.0)) / 2
    return apart <= SHAPES + 1 / F.sqrt("paths")


def _tokens(values: DataFrame, hot: int) -> DataFrame:
    """host, node, segment, paths, token, alone: what a node's segments become.

    A node's rare values (less than POWER paths) of one shape are a wildcard together if there are VARIETY of them, of digits two; one with SUPPORT
    labels only if its label rate is that of the others.  Other branches merge with those without labels, or mostly good or mostly bad ones, if
    their children and label rates are similar; without the power to tell, they stay apart.
    """
    strong = F.col("paths") >= POWER
    mostly = F.when(F.col("labelled") == 0, "any").when(2 * F.col("bad") >= F.col("labelled"), "bad").otherwise("good")
    values = values.withColumn("kind", F.concat(F.lit("{"), F.when(strong, mostly).otherwise(F.col("shape")), F.lit("}")))
    sums = ["paths", "labelled", "bad", *[f"s{i}" for i in range(len(_KINDS))]]
    pools = values.groupBy("host", "node", "kind").agg(F.count("*").alias("values"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    tested = _joined(values, pools.withColumn("weight", F.col("values")), ["host", "node", "kind"], "weight", hot)
    many = F.col("values") >= F.when(F.col("shape").isin(*_IDS), VARIETY_OF_IDS).otherwise(VARIETY)
    rare = many & ((F.col("labelled") < SUPPORT) | _same_rate())
    branch = (F.col("values") > 1) & _same_children() & ((F.col("labelled") == 0) | _same_rate())
    # A brace of a url itself must not look like a wildcard.
    own = F.replace("segment", F.lit("{"), F.lit("%7B"))
    return tested.select("host", "node", "segment", "paths", F.when(F.when(strong, branch).otherwise(rare), F.col("kind")).otherwise(own).alias("token"))


def templates(paths: DataFrame) -> DataFrame:
    """host, path, n, labelled, bad (distinct host and path) with the path's template.

    The tree grows from the root: a node is a host and the tokens (segments or wildcards) of the path so far, so paths meet below a
    wildcard but never across branches that were kept apart.  Level after level, each node's segments become tokens; a node with a single path
    keeps the rest of it, so there are as many levels as paths that differ have segments in common, and one.
    """
    parts = F.array_remove(F.split("path", "/"), "")
    rows = cut(paths.select("host", "path", (F.col("labelled") > 0).cast("int").alias("labelled"), F.when(F.col("labelled") > 0, F.col("bad") / F.col("labelled")).otherwise(0.0).alias("bad"), parts.alias("parts"), F.lit("").alias("node")))
    hot, depth, done = _hot(rows.count()), 0, [rows.where(F.size("parts") == 0).select("host", "path", F.lit("/").alias("template"))]
    rows = rows.where(F.size("parts") > 0)
    while rows.head(1):
        following = F.coalesce(_shape(F.get("parts", F.lit(depth + 1))), F.lit(""))
        rows = rows.withColumn("segment", F.get("parts", F.lit(depth)))
        kinds = [F.count_if(following == k).alias(f"s{i}") for i, k in enumerate(_KINDS)]
        values = cut(rows.groupBy("host", "node", "segment").agg(F.count("*").alias("paths"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), *kinds).withColumn("shape", _shape(F.col("segment"))))
        found = cut(_joined(rows, _tokens(values, hot), ["host", "node", "segment"], "paths", hot))
        found = found.withColumn("node", F.concat("node", F.lit("/"), "token"))
        size = found.groupBy("host", "node").agg(F.count("*").alias("weight")).withColumn("alone", F.col("weight") == 1)
        found = cut(_joined(found.drop("segment", "token"), size, ["host", "node"], "weight", hot))
        depth += 1
        over = F.col("alone") | (F.size("parts") <= depth)
        rest = F.replace(F.array_join(F.concat(F.array("node"), F.slice("parts", depth + 1, F.greatest(F.size("parts") - depth, F.lit(0)))), "/"), F.lit("//"), F.lit("/"))
        done.append(found.where(over).select("host", "path", rest.alias("template")))
        rows = found.where(~over).drop("alone")
    named = reduce(DataFrame.union, done)
    return paths.join(named, ["host", "path"])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, bool]], labelled: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, impurity; one row for each row of pages.

    A rule's verdict holds where one fits.  Else the verdict is block where the path's template has a smoothed share of bad labels,
    (bad + STRENGTH * prior) / (labelled + STRENGTH), of REJECT or more; prior is the share over all labels, at most 1/2, so templates without labels
    stay.  labelled (url, bad) gives the labels; without it, the urls that a rule decides are the labelled ones.

    Counts are taken over distinct host and path, each summed before any shuffle, so that a frequent url or host is no hot key there.  Null
    urls and urls without :// have empty host and path and are judged as such.  Rules of one length that fit are taken in their order, the last
    one counts.  Repeated rows are judged each; a very long url is one path with many segments.  Other columns of pages are not looked at.
    """
    host, path = host_path(F.col("url"))
    rule, block = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    if labelled is None:
        paths = paths.withColumn("block", block).select("host", "path", "n", F.when(F.col("block").isNotNull(), F.col("n")).otherwise(0).alias("labelled"), F.when(F.col("block"), F.col("n")).otherwise(0).alias("bad"))
    else:
        told = labelled.where("bad is not null").select(F.col("url").cast("string").alias("url"), "bad").select(host.alias("host"), path.alias("path"), F.col("bad").cast("long").alias("bad"))
        told = told.groupBy("host", "path").agg(F.count("*").alias("labelled"), F.sum("bad").alias("bad"))
        paths = paths.join(told, ["host", "path"], "left").fillna(0, ["labelled", "bad"])
    paths = cut(paths)
    named = cut(templates(paths))
    # One row.
    facts = paths.agg(F.least(F.lit(0.5), F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.5))), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    prior = float(facts[0])
    pure = named.groupBy("host", "template").agg(F.count("*").alias("weight"), F.sum("labelled").alias("l"), F.sum("bad").alias("b")).select("host", "template", "weight", ((F.col("b") + STRENGTH * prior) / (F.col("l") + STRENGTH)).alias("impurity"))
    judged = _joined(named.select("host", "path", "n", "template"), pure, ["host", "template"], "weight", _hot(facts[1]))
    out = _joined(urls, cut(judged), ["host", "path"], "n", _hot(facts[2])).withColumn("rule", rule).withColumn("block", block)
    verdict = F.when(F.coalesce("block", F.col("impurity") >= REJECT), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "impurity")
