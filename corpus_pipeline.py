"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Each stage works on all rows that the one before it kept. Columns beside ``doc_id`` and ``text`` are
carried along. Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonespark.llm.dartminhash import near_duplicates
from clonespark.llm.decontaminate import decontaminate
from clonespark.llm.pieces import encode_texts
from clonespark.llm.pii import find_personal_data
from clonespark.llm.quality import quality
from clonespark.llm.storage import stored
from clonespark.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the trees accept; null and empty texts go."""
    ship_package(spark)
    judged = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group.

    Of rows that share an id the one with the smallest text stays. Rows without an id belong to
    no group and stay.
    """
    ship_package(spark)
    leads = near_duplicates(docs).filter("doc_id = class_id").select("doc_id").distinct()
    own = docs.filter("doc_id is not null").join(leads, "doc_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    own = own.withColumn("nth row of the id", nth).filter(F.col("nth row of the id") == 1)
    return own.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Rows of equal id and text share a verdict."""
    ship_package(spark)
    keyed = docs.withColumn("row key", F.xxhash64("doc_id", "text"))
    found = decontaminate(keyed.select(F.col("row key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    marked = found.filter("contaminated").select(F.col("doc_id").alias("row key")).distinct()
    return keyed.join(marked, "row key", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    ship_package(spark)
    clean = find_personal_data(docs, redact=True)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether decoding gives the text back."""
    import public_tokenizers

    ship_package(spark)
    out = encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("personal-data", personal_data),
    ("piece-encoding", piece_encoding),
]

#: The stages learn trees, hash darts and decode a vocabulary, which SQL can't express; tests/llm checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
