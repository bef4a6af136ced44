"""Writing object, branch and event tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.morphology import shaped


def short(value: Column) -> Column:
    """A number with six significant digits as %g prints it: no trailing zeros, an exponent below 1e-4 and from 1e6 on."""
    size = F.abs(value)
    power = F.when(size > 0, F.floor(F.log10(size))).otherwise(F.lit(0))
    # Six digits may round up to the next power of ten.
    digits = F.format_string("%.5e", value.cast("double"))
    power = F.when(size > 0, F.regexp_extract(digits, r"e([+-]\d+)$", 1).cast("int")).otherwise(power).cast("int")
    trimmed = lambda c: F.regexp_replace(F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, "0+$", "")).otherwise(c), r"\.$", "")
    fixed = F.element_at(F.array(*[F.format_string(f"%.{d}f", value.cast("double")) for d in range(10)]), F.greatest(F.lit(0), F.least(F.lit(9), 5 - power)) + 1)
    wide = F.concat(trimmed(F.regexp_extract(digits, r"^([^e]*)e", 1)), F.lit("e"), F.regexp_extract(digits, r"e([+-]\d+)$", 1))
    text = F.when((power < -4) | (power >= 6), wide).otherwise(trimmed(fixed))
    special = F.when(F.isnan(value.cast("double")), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(special, text))


def write_table(rows: DataFrame, path: str, unit: str = "um", headers: Mapping[str, str] | None = None, kind: str = "csv") -> None:
    """Write a table with ordered columns, unit-bearing headers and short numbers: csv, or txt with tabs."""
    if kind not in ("csv", "txt"):
        raise ValueError(f"unsupported table format {kind}")
    floats = {c for c, t in rows.dtypes if t in ("double", "float")}
    plain = rows.select(*[(short(F.col(c)) if c in floats else F.col(c)).alias(c) for c in rows.columns])
    shaped(plain, unit, headers).write.mode("overwrite").option("header", "true").option("sep", "," if kind == "csv" else "\t").csv(path)


def write_events(events: DataFrame, path: str, first: int, last: int, kinds: list[str]) -> None:
    """Events of a frame range and of chosen kinds, ids joined by blanks."""
    rows = events.where(F.col("frame_from").between(first, last) & F.col("kind").isin(kinds))
    rows.select("kind", "frame_from", "frame_to", F.array_join("sources", " ").alias("sources"), F.array_join("targets", " ").alias("targets")).write.mode("overwrite").option("header", "true").csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Exported events with their links: one row per source and target, null where there is none."""
    rows = spark.read.option("header", "true").schema("kind string, frame_from int, frame_to int, sources string, targets string").csv(path)
    ids = lambda c: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda x: x != ""), lambda x: x.cast("long"))
    return rows.select("kind", "frame_from", "frame_to", F.explode_outer(ids("sources")).alias("src"), "targets").select("kind", "frame_from", "frame_to", "src", F.explode_outer(ids("targets")).alias("dst"))
