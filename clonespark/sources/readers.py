"""Sequence and rearrangement readers.

Readers return DataFrames and parse inside Spark's own scan, so files split, prune
and decompress as any text source does.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import is_true_flag, multiplicity, number

SUFFIXES = {
    "fasta": (".fasta", ".fa", ".fna", ".fas"),
    "fastq": (".fastq", ".fq"),
    "airr": (".tsv", ".csv", ".txt", ".airr"),
}


def detect_format(path: str, requested: str = "auto") -> str:
    """Format by file name, ignoring a compression suffix."""
    if requested != "auto":
        if requested not in SUFFIXES:
            raise ValueError(f"Unknown sequence format {requested}.")
        return requested
    name = path.lower()
    for suffix in (".gz", ".bz2", ".zst"):
        name = name.removesuffix(suffix)
    for kind, suffixes in SUFFIXES.items():
        if name.endswith(suffixes):
            return kind
    raise ValueError(f"Cannot tell the sequence format of {path}; name it explicitly.")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``id, description, sequence, source_file`` from wrapped or flat FASTA.

    The record separator is ``\\n>``, so a file splits at record boundaries and is read once, without a shuffle. A record
    without bases is an error, and so is a file whose first text is no header: that shows at the record that
    begins the split at byte 0, the only one that keeps its ``>``. Blank lines before it are skipped.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), (F.col("_metadata.file_block_start") == 0).alias("head")
    )

    def parse(batches):
        before = None
        for batch in batches:
            ids, descriptions, sequences, files = [], [], [], []
            for value, file, head in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                first = head and before != (file, True)  # splits follow one another within a task
                before = (file, head)
                if first and not value.strip():
                    continue  # blank lines before the first header
                if first and not value.startswith(">"):
                    raise ValueError(f"The first line of this FASTA file is no header: {file}")
                value = value.removeprefix(">") if first else value
                header, _, body = value.partition("\n")
                header, sequence = header.strip(), "".join(body.split())
                if not sequence:
                    raise ValueError(f"FASTA record without bases: {header}")
                name = header.split(None, 1)
                ids.append(name[0] if name else "")
                descriptions.append(name[1] if len(name) > 1 else "")
                sequences.append(sequence)
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (ids, descriptions, sequences, files)], names=["id", "description", "sequence", "source_file"])

    return raw.mapInArrow(parse, "id string, description string, sequence string, source_file string")


FASTQ_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("sequence", T.StringType()),
        T.StructField("quality", T.StringType()),
    ]
)


def read_fastq(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """``id, description, sequence, quality`` from FASTQ.

    ``layout='four-line'`` splits plain files into byte ranges; ``'wrapped'`` keeps each
    file in one task, because a wrapped quality line can look like a header. ``auto``
    means four-line. Compressed files are never split.
    """
    from .fastq import FastqDataSource

    spark.dataSource.register(FastqDataSource)
    return spark.read.format(FastqDataSource.name()).option("layout", "four-line" if layout == "auto" else layout).load(path)


def read_airr(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """A rearrangement table as text columns; rows without a sequence are dropped.

    The delimiter is the tab unless the header has none. Quoted cells of comma files
    are honoured.
    """
    if delimiter is None:
        head = spark.read.text(path).limit(1).first()
        delimiter = "\t" if head is None or "\t" in head[0] else ","
    reader = spark.read.option("header", True).option("sep", delimiter).option("emptyValue", "").option("nullValue", "\u0000").option("enforceSchema", False)
    reader = reader.option("quote", '"').option("escape", '"') if delimiter == "," else reader.option("quote", "")
    table = reader.csv(path)
    if "sequence" not in table.columns:
        raise ValueError("AIRR input requires a 'sequence' column.")
    return table.fillna("").filter(F.col("sequence") != "")


# Typed columns of the rearrangement table; every other column stays text.
BOOLEAN_COLUMNS = ("rev_comp", "productive", "vj_in_frame", "stop_codon", "complete_vdj", "v_frameshift", "j_frameshift")
NUMBER_SUFFIXES = ("_score", "_identity", "_support")
INTEGER_SUFFIXES = ("_start", "_end", "_length", "_frame")


def typed(table: DataFrame) -> DataFrame:
    """Cast the standard columns; empty and malformed cells become NULL."""
    columns = []
    for name in table.columns:
        if name in BOOLEAN_COLUMNS:
            columns.append(F.when(F.coalesce(F.col(name), F.lit("")) == "", None).otherwise(is_true_flag(name)).alias(name))
        elif name.endswith(NUMBER_SUFFIXES):
            columns.append(number(name).alias(name))
        elif name.endswith(INTEGER_SUFFIXES):
            columns.append(F.floor(number(name)).cast("int").alias(name))
        elif name == "duplicate_count":
            columns.append(multiplicity(name).alias(name))
        else:
            columns.append(F.col(name))
    return table.select(*columns)


def with_ordinals(table: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Dense 0-based ``ordinal``, stable across re-runs.

    Rows are range-partitioned by ``order`` (all columns by default) and sorted; each
    partition's size gives the next one's offset. Two narrow passes, no global sort in
    one task. The result is checkpointed: ordinals are keys and must not change when a
    partition is recomputed.
    """
    from ..session import cut

    keys = order or table.columns
    placed = table.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    numbered = cut(placed)
    part = F.shiftright(F.col("_id"), 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition of the input
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("_part", "_size"))).alias("s")).select(F.explode("s").alias("e"), "s")
    offsets = listed.select(
        F.col("e._part").alias("_part"),
        F.aggregate(F.filter("s", lambda x: x["_part"] < F.col("e._part")), F.lit(0).cast("bigint"), lambda a, x: a + x["_size"]).alias("_offset"),
    )
    row = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("_part", part).join(offsets, "_part").withColumn("ordinal", F.col("_offset") + row).drop("_id", "_part", "_offset")


def read_sequences(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    """Any supported sequence file as ``id, description, sequence[, quality]``."""
    found = detect_format(path, kind)
    if found == "fasta":
        return read_fasta(spark, path)
    if found == "fastq":
        return read_fastq(spark, path)
    table = read_airr(spark, path)
    name = F.col("sequence_id") if "sequence_id" in table.columns else F.lit("")
    return table.select(name.alias("id"), F.lit("").alias("description"), "sequence")


def union_datasets(tables: list[DataFrame]) -> DataFrame:
    """Bag union of datasets whose columns may differ."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def aligned_columns(fasta: DataFrame) -> DataFrame:
    """Cells of an alignment: ``name, column, state``."""
    clean = F.regexp_replace(F.translate(F.upper("sequence"), ".", "-"), "[^ACGTNRYKMSWBDHV-]", "N")
    return fasta.select(F.col("id").alias("name"), F.posexplode(F.split(clean, "")).alias("p", "state")).select("name", (F.col("p") + 1).alias("column"), "state")
