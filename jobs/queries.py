"""Both jobs as registered queries: each is run twice into a new folder below the shared one, whose table is read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelspark.plans.catalog import PARENTS

from . import common, text_colocalisation, track_frames


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir, or below the machine's temporary one where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and links of the events' time series by the streaming job."""
    out = _folder(spark, "job1")
    # A pattern, since the table may be a single file, and a stream takes only folders by their plain name.
    for _ in range(2):
        track_frames.run(spark, f"{sf_dir}/event[s].parquet", f"{out}/tables", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/tables/tracks")


def job2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap and proximity of two kinds of words in documents by the batch job."""
    out = _folder(spark, "job2")
    for _ in range(2):
        text_colocalisation.run(spark, f"{sf_dir}/documents.parquet", f"{out}/table")
    return spark.read.parquet(f"{out}/table")


_TEXT = common.settings(text_colocalisation.CONFIG)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_frames": job1_frames, "job2_text": job2_text}

ORACLE_SQL: dict[str, str] = {
    "job1_frames": f"""WITH RECURSIVE {PARENTS},
into_ AS (SELECT dst AS det_id, count(*) AS parents, CAST(sum(matched_points) AS BIGINT) AS shared FROM links GROUP BY dst),
out_ AS (SELECT src AS det_id, count(*) AS children FROM links GROUP BY src)
SELECT d.t, d.label, d.area, d.cy, d.cx, d.y0, d.y1, d.x0, d.x1, p.label AS parent_label, coalesce(i.parents, 0) AS parents, coalesce(i.shared, 0) AS shared_with_parents, coalesce(o.children, 0) AS children
FROM dets d LEFT JOIN parents q USING (det_id) LEFT JOIN dets p ON p.det_id = q.parent LEFT JOIN into_ i ON i.det_id = d.det_id LEFT JOIN out_ o ON o.det_id = d.det_id""",
    "job2_text": f"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(range(len(w))) AS x, unnest(w) AS w FROM d),
m AS (SELECT doc_id, x, regexp_matches(w, '{_TEXT["source_pattern"]}') AS s, regexp_matches(w, '{_TEXT["target_pattern"]}') AS g, octet_length(encode(w)) AS v FROM w),
k AS (SELECT *, max(CASE WHEN g THEN x END) OVER (PARTITION BY doc_id ORDER BY x) AS b, min(CASE WHEN g THEN x END) OVER (PARTITION BY doc_id ORDER BY x DESC) AS a FROM m WHERE s OR g),
c AS (SELECT doc_id, count(*) FILTER (s) AS source_size, count(*) FILTER (g) AS target_size, count(*) FILTER (s AND g) AS overlap_size, count(*) AS union_size,
  count(*) FILTER (s AND (x - b <= {_TEXT["threshold"]} OR a - x <= {_TEXT["threshold"]})) AS near_size, sum(v) FILTER (s) AS ss, sum(v) FILTER (s AND g) AS so, sum(v) FILTER (g) AS gs FROM k GROUP BY doc_id),
e AS (SELECT d.doc_id, d.lang, coalesce(source_size, 0) AS source_size, coalesce(target_size, 0) AS target_size, coalesce(overlap_size, 0) AS overlap_size, coalesce(union_size, 0) AS union_size, coalesce(near_size, 0) AS near_size,
  coalesce(ss, 0) AS ss, coalesce(so, 0) AS so, coalesce(gs, 0) AS gs FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, source_size, target_size, overlap_size, union_size, near_size, coalesce(CAST(so AS DOUBLE) / nullif(ss, 0), 0) AS manders_source, coalesce(CAST(so AS DOUBLE) / nullif(gs, 0), 0) AS manders_target,
  coalesce(2.0::DOUBLE * overlap_size / nullif(source_size + target_size, 0), 0) AS dice, coalesce(CAST(overlap_size AS DOUBLE) / nullif(union_size, 0), 0) AS jaccard,
  coalesce(CAST(overlap_size AS DOUBLE) / nullif(source_size, 0), 0) AS source_fraction, coalesce(CAST(near_size AS DOUBLE) / nullif(source_size, 0), 0) AS near_fraction, lang FROM e""",
}
