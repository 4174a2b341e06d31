"""Table functions for SQL: k-mers of a sequence and columns of an aligned pair, for use with ``LATERAL``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .letters import ungapped_positions


# Not by Arrow: that makes a frame of its own for every call, and there is one call per sequence.
@F.udtf(returnType="kmer string, position int, occurrence int", useArrow=False)
class Kmers:
    """``kmers(sequence, k)``: every window of ``k`` letters with its 1-based position; none for null or shorter texts.

    ``occurrence`` numbers the equal windows of a sequence from 1, so that those with 1 count the sequences that hold it.
    """

    def eval(self, sequence, k):
        if sequence is None or k is None or k < 1:
            return
        seen: dict[str, int] = {}
        for at in range(len(sequence) - k + 1):
            kmer = sequence[at : at + k]
            seen[kmer] = seen.get(kmer, 0) + 1
            yield kmer, at + 1, seen[kmer]


#: ``alignment_columns(query, reference)``: one row per column with the letters and their positions without gaps.
#: The position of a gap is null. The shorter text ends early: its letters are null behind its end.
#: One generator over the arguments alone: Spark puts it on top of the table that is read, where a body that first names
#: its arrays in a subquery would be joined back to the table by the texts.
ALIGNMENT_COLUMNS = """
CREATE OR REPLACE TEMPORARY FUNCTION alignment_columns(query STRING, reference STRING)
RETURNS TABLE (`column` INT, query STRING, reference STRING, query_position INT, reference_position INT)
RETURN SELECT pos + 1, col.`0`, col.`1`, col.`2`, col.`3` FROM posexplode(arrays_zip(
  CASE WHEN query <> '' THEN split(query, '') ELSE array() END, CASE WHEN reference <> '' THEN split(reference, '') ELSE array() END,
  ungapped_positions(query), ungapped_positions(reference)))
"""


def register_tables(spark: SparkSession) -> None:
    """Make both callable from SQL as ``kmers`` and ``alignment_columns``."""
    spark.udtf.register("kmers", Kmers)
    spark.udf.register("ungapped_positions", ungapped_positions)
    spark.sql(ALIGNMENT_COLUMNS)
