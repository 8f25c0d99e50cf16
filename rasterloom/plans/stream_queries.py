"""Queries of stateful streams: events as video frames, a user's events as one stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared
from ..streaming import decoder_state
from .registry import ORACLES, register
from .structure_queries import frames_of


def followed(spark: SparkSession, sf: str) -> DataFrame:
    """The stream run over all there is now, written to the shared folder and read again."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, at = shared(spark, "frames"), shared(spark, "stream")
    run = decoder_state.follow(frames_of(events)).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(decoder_state.OUTPUT).parquet(out)


def _renamed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("stream_id").alias("user_id"), F.col("frame_id").alias("event_id"), *columns)


@register("l01_reference_stream", ORACLES["l01_reference_rotation"])
def l01(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(followed(spark, sf), "last", "golden", "alt")


@register("l02_entropy_stream", ORACLES["l02_entropy_state"])
def l02(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(decoder_state.follow(frames_of(spark.read.parquet(f"{sf}/events.parquet"))), "used", "saved")


@register("l03_segment_stream", ORACLES["l03_segment_map"])
def l03(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(decoder_state.follow(frames_of(spark.read.parquet(f"{sf}/events.parquet"))), "segment")
