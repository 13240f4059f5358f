"""Routing of audio, video and documents to conversion attempts, their time budget and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lookups


def media_plan(files: DataFrame) -> DataFrame:
    """Adds ``container`` and ``codec`` for rows of category AUDIO or VIDEO by ``ext``; unknown extensions get mp3 or mp4 without a codec."""
    spark = files.sparkSession
    audio = spark.createDataFrame(lookups.AUDIO, "_ext string, _ac string, _codec string")
    video = spark.createDataFrame(lookups.VIDEO, "_vext string, _vc string")
    x = files.join(F.broadcast(audio), F.col("ext") == F.col("_ext"), "left").join(F.broadcast(video), F.col("ext") == F.col("_vext"), "left")
    container = F.when(F.col("category") == "AUDIO", F.coalesce("_ac", F.lit("mp3"))).when(F.col("category") == "VIDEO", F.coalesce("_vc", F.lit("mp4")))
    return x.withColumns({"container": container, "codec": F.when(F.col("category") == "AUDIO", F.col("_codec"))}).drop("_ext", "_ac", "_codec", "_vext", "_vc")


def media_attempts(plan: DataFrame) -> DataFrame:
    """A row an attempt, in order: ``attempt_idx, attempt``. Files of other categories have none."""
    attempts = (
        F.when((F.col("category") == "AUDIO") & F.col("codec").isNotNull(), F.array(F.lit("remux"), F.lit("reencode"), F.lit("reencode_lenient")))
        .when(F.col("category") == "AUDIO", F.array(F.lit("remux")))
        .when(F.col("category") == "VIDEO", F.array(F.lit("remux"), F.lit("reencode_mp4")))
        .when(F.col("category") == "PDF", F.array(F.lit("rewrite")))
    )
    return plan.select("*", F.posexplode(attempts).alias("attempt_idx", "attempt"))


def attempt_budget(attempts: DataFrame, each: int = lookups.ATTEMPT_S, total: int = lookups.BUDGET_S) -> DataFrame:
    """Adds ``spent`` before the attempt, the seconds it is ``allowed``, and whether it is over without a run."""
    w = W.partitionBy("file_id").orderBy("attempt_idx").rowsBetween(W.unboundedPreceding, -1)
    x = attempts.withColumn("spent", F.coalesce(F.sum("seconds").over(w), F.lit(0)))
    x = x.withColumn("allowed", F.greatest(F.least(F.lit(each), F.lit(total) - F.col("spent")), F.lit(0)))
    return x.withColumn("exhausted", F.col("allowed") <= 0)


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """``file_id, category, verdict, reason``: the first success cleans the file, else the reason tells how all failed.

    Optional columns: ``not_started``, whether the converter couldn't be started at all, and ``out_bytes`` of a
    success, of which none is an error.
    """
    late, unborn, size = F.col("any_late"), F.col("any_unborn"), F.col("out_bytes")
    has = attempts.columns
    first = lambda c: F.min_by(c, F.when(F.col("ok"), F.col("attempt_idx")))
    x = attempts.groupBy("file_id", "category").agg(
        F.bool_or("ok").alias("any_ok"), F.bool_or("timed_out").alias("any_late"),
        (F.bool_or("not_started") if "not_started" in has else F.lit(False)).alias("any_unborn"), (first("out_bytes") if "out_bytes" in has else F.lit(None).cast("long")).alias("out_bytes"),
    )
    failed = (
        F.when(F.col("category") == "audio", F.when(late, "ffmpeg_timeout").otherwise("ffmpeg_sanitize_failed"))
        .when(F.col("category") == "video", "ffmpeg_remux_and_reencode_failed")
        .otherwise(F.when(late, "ghostscript_timeout").when(unborn, "fork_failed").otherwise("ghostscript_failed"))
    )
    empty = F.when(F.col("category").isin("audio", "video"), "ffmpeg_empty_output").otherwise("ghostscript_empty_output")
    ok = F.coalesce("any_ok", F.lit(False))
    reason = F.when(~ok, failed).when(size == 0, empty)
    return x.select("file_id", "category", F.when(reason.isNull(), "sanitized").otherwise("error").alias("verdict"), reason.alias("reason"))


def size_limits(files: DataFrame, size: str = "length") -> DataFrame:
    """Adds ``too_large``: the reason if the category's size limit is passed; audio of an opaque extension isn't limited."""
    limits = files.sparkSession.createDataFrame(lookups.SIZE_LIMITS, "_cat string, _most long, _why string")
    x = files.join(F.broadcast(limits), F.col("category") == F.col("_cat"), "left")
    free = (F.col("category") == "AUDIO") & F.coalesce(F.col("opaque"), F.lit(False))
    return x.withColumn("too_large", F.when(~free & (F.col(size) > F.col("_most")), F.col("_why"))).drop("_cat", "_most", "_why")
