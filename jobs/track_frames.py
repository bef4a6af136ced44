"""Objects of a time series and their links from frame to frame, kept up to date as files of events come in.

    python -m jobs.track_frames EVENTS OUT CHECKPOINT [--config FILE]

EVENTS is a folder of Parquet files that grows by further files, or a pattern of files.  Tables below OUT: voxels (by frame and batch), labels (by frame) and tracks (by frame): one row for each object with its size, place, parents and children.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxelspark.operators import components, tracking
from voxelspark.operators.masks import VOXEL
from voxelspark.sources.derive import event_voxels

from . import common

CONFIG = Path(__file__).with_suffix(".json")
LOG = logging.getLogger("jobs.track_frames")
#: Objects of a frame are fewer than this; with the frame's number they make ids that no later frame changes.
_PER_FRAME = 1 << 31


def _write(df: DataFrame, path: str, by: list[str]) -> int:
    """Replace the partitions that df has rows for, with few files for each frame but a large one split; returns its rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance", "t").write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return seen.get["rows"]


def _of(path: str, frames: DataFrame) -> DataFrame:
    """Rows of a table's partitions of these frames; partitions before the first and after the last aren't read."""
    low, high = frames.agg(F.min("t"), F.max("t")).head()
    return frames.sparkSession.read.parquet(path).where(F.col("t").between(low, high)).join(frames, "t", "left_semi")


def _moved(frames: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    return frames.select(F.explode(F.array(*[F.col("t") + s for s in steps])).alias("t")).distinct()


def tracks(labels: DataFrame, frames: DataFrame, least: int) -> DataFrame:
    """Objects of the given frames with parents and children; labels must hold the frames before and after them too.

    A parent shares voxels with its child; the dominant one shares most, at equality the one with the least cost, then the least label.
    """
    objects = components.objects(labels).where(F.col("area") >= least)
    dets = objects.withColumn("det_id", F.col("t") * F.lit(_PER_FRAME) + F.col("label"))
    links = tracking.overlap_links(labels, dets)
    best = tracking.dominant_parents(links).select("det_id", (F.col("parent") % _PER_FRAME).cast("int").alias("parent_label"))
    parents = links.groupBy(F.col("dst").alias("det_id")).agg(F.count("*").alias("parents"), F.sum("matched_points").alias("shared_with_parents"))
    children = links.groupBy(F.col("src").alias("det_id")).agg(F.count("*").alias("children"))
    rows = dets.join(frames, "t", "left_semi").join(best, "det_id", "left").join(parents, "det_id", "left").join(children, "det_id", "left")
    rows = rows.fillna(0, ["parents", "shared_with_parents", "children"])
    return rows.select("t", "label", "area", "cy", "cx", "y0", "y1", "x0", "x1", "parent_label", "parents", "shared_with_parents", "children")


def update(batch: DataFrame, number: int, out: str, config: Mapping[str, Any]) -> None:
    """Take one batch of events into the tables.

    Each step replaces whole partitions by what the tables before it say, and a batch's voxels have partitions of their own: a batch that is
    run again after a failure leaves the same tables.  Late events of an earlier frame relabel that frame and renew its neighbours' links.
    """
    new = _write(event_voxels(batch).withColumn("batch", F.lit(number)), f"{out}/voxels", ["t", "batch"])
    if not new:
        LOG.info("batch %d: no events", number)
        return
    touched = batch.sparkSession.read.parquet(f"{out}/voxels").where(F.col("batch") == number).select("t").distinct()
    mask = _of(f"{out}/voxels", touched).select(*VOXEL).distinct()
    labelled = _write(components.label(mask), f"{out}/labels", ["t"])
    around = _moved(touched, (-1, 0, 1))
    rows = tracks(_of(f"{out}/labels", _moved(touched, (-2, -1, 0, 1, 2))), around, config["min_object_size"])
    written = _write(rows, f"{out}/tracks", ["t"])
    LOG.info("batch %d: %d new voxels read, %d voxels labelled, %d objects written to %s/tracks", number, new, labelled, written, out)


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: Mapping[str, Any] | None = None) -> None:
    """Take the event files that have come in since the last run; ends when there are no more."""
    config = config or common.settings(CONFIG)
    LOG.info("reading new files of %s, checkpoint %s", events, checkpoint)
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(events)
    writer = stream.writeStream.foreachBatch(lambda batch, number: update(batch, number, out, config))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("done, %s/tracks is up to date", out)


if __name__ == "__main__":
    common.main(run, "track_frames", ["events", "out", "checkpoint"], CONFIG)
