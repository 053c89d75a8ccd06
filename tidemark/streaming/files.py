"""The stateless operators and the first-wins rule over streams of chunk files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import exact_key
from tidemark.operators.filters import keyword_hits, QUANTITY_WORDS, STRUCTURE_WORDS


def read_chunk_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of parquet chunk files."""
    return spark.readStream.schema(schema).parquet(path)


def score_stream(chunks: DataFrame) -> DataFrame:
    """The candidate counts of every chunk; equal to the batch result on the same rows."""
    return chunks.select(
        "*", keyword_hits(F.col("text"), QUANTITY_WORDS).alias("quantity_hits"), keyword_hits(F.col("text"), STRUCTURE_WORDS).alias("structure_hits")
    )


def first_names(recipes: DataFrame, name: str, ts: str, delay: str = "7 days") -> DataFrame:
    """The first recipe of every name within the watermark; later ones of the same name are dropped."""
    return recipes.withColumn("name_key", exact_key(F.col(name))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["name_key"])


def start_counts(requests: DataFrame, key: str, ts: str, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "5 minutes") -> DataFrame:
    """Requests per key in sliding windows, late ones within ``delay`` included."""
    return requests.withWatermark(ts, delay).groupBy(F.window(ts, window, slide), key).agg(F.count(F.lit(1)).alias("starts"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Works off what is there in micro-batches, restartable from ``checkpoint``."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
