"""Media timelines as tables: segments, frame times, overlaps, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, TAIL, FRAMES = 10.0, 0.02, 8


def segments(assets: DataFrame) -> DataFrame:
    """asset_id, kind, ordinal, start_s, end_s: ten-second stretches; a last one of under 20 ms is evened out."""
    n = F.greatest(F.ceil(F.col("duration") / SEGMENT), F.lit(1))
    own = assets.where(F.col("duration") > 0).where((F.col("kind") != "audio") | (F.col("duration") >= TAIL))
    rows = own.select("asset_id", "kind", "duration", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("ordinal"))
    rest = F.round(F.col("duration") - SEGMENT * (F.col("n") - 1), 9)
    short = (F.col("n") > 1) & (rest > 0) & (rest < TAIL)
    bound = lambda k: F.when(k == F.col("n"), F.col("duration")).when(short & (k == F.col("n") - 1), F.col("duration") - TAIL).otherwise(SEGMENT * k)
    return rows.select("asset_id", "kind", "ordinal", F.round(F.when(F.col("ordinal") == 0, 0.0).otherwise(bound(F.col("ordinal"))), 6).alias("start_s"), F.round(bound(F.col("ordinal") + 1), 6).alias("end_s"))


def frame_times(start: Column, end: Column) -> Column:
    """One to eight times, each in the middle of an equal part."""
    n = F.greatest(F.lit(1), F.least(F.lit(FRAMES), F.ceil(F.round(end - start, 9)))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(start + (end - start) * (i + 0.5) / n, 6))


#: Levels of time bins, and how many bins of a level make one of the next.
LEVELS, RADIX = 9, 32


def _width(level: int) -> float:
    return SEGMENT * RADIX**level


def overlaps(spans: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """The rows of ``spans`` (with ``key``, start_s, end_s and a number ``ordinal`` within the key) and of ``tracks`` (key, start_s, end_s) that overlap by a
    positive length, as key, ordinal, t_start, t_end, each pair once.

    Time is cut into bins of ``LEVELS`` widths. A track is in the one or two bins of the narrowest level as wide as itself, however long it is; a span is
    looked up in its bins of all levels. So the tracks of one key are spread over many join keys. A pair counts in the first bin that both are in."""
    length, level = F.col("t_end") - F.col("t_start"), F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length <= _width(k), k).otherwise(level)
    width = lambda k: F.lit(SEGMENT) * F.pow(F.lit(float(RADIX)), k)
    first = lambda start, k: F.floor(start / width(k))
    t = tracks.select(F.col(key).alias("t_key"), F.col("start_s").cast("double").alias("t_start"), F.col("end_s").cast("double").alias("t_end")).where("t_end > t_start").withColumn("t_level", level)
    t = t.withColumn("t_first", first(F.col("t_start"), F.col("t_level"))).withColumn("t_bin", F.explode(F.sequence(F.col("t_first"), first(F.col("t_end"), F.col("t_level")))))
    s = spans.select(key, "ordinal", F.col("start_s").cast("double").alias("s_start"), F.col("end_s").cast("double").alias("s_end")).withColumn("s_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    s = s.withColumn("s_first", first(F.col("s_start"), F.col("s_level"))).withColumn("s_bin", F.explode(F.sequence(F.col("s_first"), first(F.col("s_end"), F.col("s_level")))))
    meet = (F.col(key) == F.col("t_key")) & (F.col("s_level") == F.col("t_level")) & (F.col("s_bin") == F.col("t_bin"))
    over = (F.col("t_start") < F.col("s_end")) & (F.col("t_end") > F.col("s_start")) & (F.col("s_bin") == F.greatest("s_first", "t_first"))
    return s.join(t, meet & over).select(key, "ordinal", "t_start", "t_end")


def with_audio(segs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Segments with n_tracks, how many tracks of the asset overlap them by a positive length, and has_audio."""
    heard = overlaps(segs, tracks, "asset_id").groupBy("asset_id", "ordinal").agg(F.count("*").alias("n_tracks"))
    n = F.coalesce("n_tracks", F.lit(0).cast("long"))
    return segs.join(heard, ["asset_id", "ordinal"], "left").withColumn("n_tracks", n).withColumn("has_audio", F.col("n_tracks") > 0)


def frame_gaps(frames: DataFrame) -> DataFrame:
    """clip_id, n_frames, contiguous: frame indexes have to run from 0 without a gap."""
    return frames.groupBy("clip_id").agg(F.count("*").alias("n_frames"), ((F.min("frame") == 0) & (F.max("frame") == F.count("*") - 1) & (F.count_distinct("frame") == F.count("*"))).alias("contiguous"))


def coverage_audit(segs: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_id, covered: segments touch, none is too long, and they span the whole asset."""
    before = F.lag("end_s").over(Window.partitionBy("asset_id").orderBy("ordinal"))
    s = segs.withColumn("gap", F.abs(F.col("start_s") - before))
    g = s.groupBy("asset_id").agg(F.max("gap").alias("gap"), F.max(F.col("end_s") - F.col("start_s")).alias("longest"), F.min("start_s").alias("first"), F.max("end_s").alias("last"))
    fine = (F.coalesce("gap", F.lit(0.0)) < 0.001) & (F.col("longest") <= SEGMENT + 0.001) & (F.abs("first") < 0.001) & (F.abs(F.col("last") - F.col("duration")) < 0.001)
    return g.join(assets.select("asset_id", "duration"), "asset_id").select("asset_id", fine.alias("covered"))


def merged_ocr(pieces: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Distinct texts of a key in order of first appearance, one a line; ``readable`` is false where there is none."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim(text).alias("t")))), lambda x: x["t"])
    return pieces.groupBy(key).agg(F.array_join(F.filter(F.array_distinct(in_order), lambda t: t != ""), "\n").alias("text")).withColumn("readable", F.col("text") != "")


def pixel_budget(frames: DataFrame, budget: int, longest: int, per_frame: int) -> DataFrame:
    """clip_id, frame, pixels so far, and whether the clip still fits."""
    px = F.col("width") * F.col("height")
    so_far = F.sum(px).over(Window.partitionBy("clip_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    return frames.select("clip_id", "frame", so_far.alias("pixels"), ((so_far <= budget) & (F.greatest("width", "height") <= longest) & (px <= per_frame)).alias("fits"))
