"""Incremental ingestion with Structured Streaming.

New files become micro-batches that are committed once and in order; dashboard counts
follow the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.sequences import is_true_flag, text
from ..operators.facets import FACETS


def stream_rearrangements(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16, kind: str = "parquet") -> DataFrame:
    """A stream of rearrangement files; the batch size bounds work in flight."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if kind == "tsv":
        reader = reader.option("header", True).option("sep", "\t").option("quote", "")
    return reader.format("csv" if kind == "tsv" else kind).load(path)


def commit_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each micro-batch under its own ``batch_id`` partition.

    A replayed batch overwrites only its own partition, so a lost executor or a restart
    never doubles rows.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_facets(stream: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """Facet counts kept up to date by the stream (complete or update mode)."""
    present = [f for f in facets if f in stream.columns]
    entries = F.array(*[F.struct(F.lit(f).alias("facet"), text(f).alias("value")) for f in present])
    exploded = stream.select(F.explode(entries).alias("e")).select("e.facet", "e.value").filter("value <> ''")
    return exploded.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("records"))


def running_summary(stream: DataFrame) -> DataFrame:
    return stream.groupBy().agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if((text("v_call") != "") & (text("j_call") != "")).alias("assigned"),
        F.count_if(is_true_flag("productive")).alias("productive"),
        F.count_if(text("cdr3") != "").alias("with_cdr3"),
    )
