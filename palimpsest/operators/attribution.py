"""Context for events: their own, that of their frame, or that of the frame nearest in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ROWS, dealt

WINDOW_S = 300


def own_or_joined(own: Column, joined: Column) -> Column:
    """An empty own value gives way to the joined one; each field decides by itself."""
    return F.coalesce(F.nullif(own, F.lit("")), joined)


def with_frame_context(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Left join on ``frame_id``; adds app, window and url."""
    f = frames.select(F.col("id").alias("__f"), F.col("app_name").alias("__a"), F.col("window_name").alias("__w"), F.col("browser_url").alias("__u"))
    joined = events.join(f, events["frame_id"] == F.col("__f"), "left")
    return joined.withColumns(
        {"app": own_or_joined(F.col("app_name"), F.col("__a")), "window": own_or_joined(F.col("window_title"), F.col("__w")), "url": own_or_joined(F.col("browser_url"), F.col("__u"))}
    ).drop("__f", "__a", "__w", "__u")


def nearest(events: DataFrame, frames: DataFrame, window_s: int = WINDOW_S, stream: str | None = None, size: int = ROWS) -> DataFrame:
    """(id, frame, apart_us): the frame nearest in time within the window, the earlier one on a tie.

    Events and frames are sorted together by ranges of time; each event sees the last frame before it and the first one after
    it, of its bucket of rows or carried in from the buckets around it. So n rows cost n log n, however many fall
    into one window. With a ``stream`` an event sees the frames of its own stream only. A time that cannot be read is the time
    of no event and of no frame; of frames of one time the least id counts.
    """
    us = lambda c: F.unix_micros(F.col(c).try_cast("timestamp"))
    of = F.col(stream) if stream else F.lit(0)
    f = frames.select(of.alias("__s"), us("timestamp").alias("__t"), F.col("id").alias("frame")).where("__t IS NOT NULL").groupBy("__s", "__t").agg(F.min("frame").alias("frame"))
    e = events.select(of.alias("__s"), us("timestamp").alias("__t"), "id").where("__t IS NOT NULL")
    both = f.withColumns({"__e": F.lit(0), "id": F.lit(None).cast(e.schema["id"].dataType)}).unionByName(e.withColumns({"__e": F.lit(1), "frame": F.lit(None).cast(f.schema["frame"].dataType)}))
    rows = dealt(both, ["__s", "__t", "__e", "id"], size).withColumn("__f", F.when(F.col("__e") == 0, F.struct("__s", "__t", "frame")))
    at = F.when(F.col("__e") == 0, F.col("pos"))
    edges = rows.groupBy("bucket").agg(F.min_by("__f", at).alias("__first"), F.max_by("__f", at).alias("__last"))
    up, down = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    around = edges.select("bucket", F.last("__last", ignorenulls=True).over(up).alias("__earlier"), F.last("__first", ignorenulls=True).over(down).alias("__later"))
    inside = Window.partitionBy("bucket")
    seen = lambda order: F.last("__f", ignorenulls=True).over(inside.orderBy(order))
    met = rows.join(around, "bucket").withColumns({"__a": F.coalesce(seen(F.asc("pos")), "__earlier"), "__b": F.coalesce(seen(F.desc("pos")), "__later")}).where("__e = 1")
    apart = lambda c: F.when(F.col("__s") == c["__s"], F.struct(F.abs(F.col("__t") - c["__t"]).alias("apart_us"), c["__t"].alias("__t"), c["frame"].alias("frame")))
    best = met.select("id", F.least(apart(F.col("__a")), apart(F.col("__b"))).alias("m")).where(F.col("m.apart_us") <= window_s * 1_000_000)
    return best.groupBy("id").agg(F.min("m").alias("m")).select("id", "m.frame", "m.apart_us")


def attribute(events: DataFrame, frames: DataFrame, window_s: int = WINDOW_S, stream: str | None = None) -> DataFrame:
    """Fills app, window and url of events without an app from the nearest frame."""
    bare = events.where(F.coalesce(F.col("app"), F.lit("")) == "")
    near = nearest(bare, frames, window_s, stream).join(frames.select(F.col("id").alias("frame"), "app_name", F.col("window_name"), F.col("browser_url").alias("frame_url")), "frame")
    near = near.select(F.col("id").alias("__id"), F.col("app_name").alias("__a"), F.col("window_name").alias("__w"), F.col("frame_url").alias("__u"))
    joined = events.join(near, events["id"] == F.col("__id"), "left")
    fill = lambda own, other: F.when(F.col("__id").isNull(), F.col(own)).otherwise(own_or_joined(F.col(own), F.col(other)))
    return joined.withColumns({"app": fill("app", "__a"), "window": fill("window", "__w"), "url": fill("url", "__u")}).drop("__id", "__a", "__w", "__u")
