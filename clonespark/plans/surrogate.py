"""A repertoire derived from the driver tables.

There is no rearrangement table among the test data, so every query runs on one
that is computed, row for row, from ``orders ⋈ customer ⋈ nation``. Each column is
a deterministic expression over those tables; the expressions are plain SQL text
so that the checking engine can evaluate the very same definition.

``o_orderkey`` is unique and becomes the ordinal. ``o_custkey % 120`` selects one of
120 rearrangements, so real clonal structure (shared V, J and near-identical CDR3)
appears within every donor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes of the orders table whose rows, made wide, are one task.
ORDERS_BYTES = 256 << 10

HEX = "'0123456789abcdef'"
BASES = "'ACGTACGTACGTACGT'"
RESIDUES = "'ACDEFGHIKLMNPQRS'"
PHRED = "'#&+058:=?BDEFGHI'"


def _dna(seed: str, parts: int) -> str:
    pieces = ", ".join(f"md5(concat({seed}, '{chr(97 + i)}'))" for i in range(parts))
    return f"translate(concat({pieces}), {HEX}, {BASES})"


# Columns that depend on the customer alone: study unit, genes and germlines. They are
# computed once per customer, below the join with the orders.
CUSTOMER_LAYERS: list[dict[str, str]] = [
    {
        "k": "c_custkey % 120",
        "vno": "c_custkey % 8 + 1",
        "dno": "c_custkey % 5 + 1",
        "extra": "c_custkey % 3",
        "sample_id": "concat('sample_', c_nationkey)",
        "subject_id": "concat('donor_', n_regionkey)",
        "cohort": "c_mktsegment",
        "chain": "CASE WHEN c_custkey % 2 = 0 THEN 'IGH' ELSE 'IGK' END",
    },
    {
        "v_gene": "concat(chain, 'V', vno, '-1')",
        "v_next": "concat(chain, 'V', vno % 8 + 1, '-1')",
        "j_gene": "concat(chain, 'J', extra + 1)",
        "germ": f"substr({_dna('concat(chr(103), k)', 2)}, 1, CAST(24 + 3 * extra AS INT))",
        "c_bases": _dna("concat(chr(99), extra)", 2),
    },
    {"v_reference": _dna("v_gene", 6), "j_reference": _dna("j_gene", 1)},
    {
        # two linked substitutions that the named alleles lack
        "v_donor": "concat(substr(v_reference, 1, 39), CASE WHEN k >= 60 THEN translate(substr(v_reference, 40, 1), 'ACGT', 'CATG') ELSE substr(v_reference, 40, 1) END, "
        "substr(v_reference, 41, 34), CASE WHEN k >= 60 THEN translate(substr(v_reference, 75, 1), 'ACGT', 'CATG') ELSE substr(v_reference, 75, 1) END, substr(v_reference, 76, 117))",
    },
]

# Columns of one order; each layer may use the ones before it.
ORDER_LAYERS: list[dict[str, str]] = [
    {
        "ordinal": "o_orderkey",
        "dataset_id": "concat('lib_', c_nationkey, '_', o_orderkey % 2)",
        "timepoint": "o_orderpriority",
        "compartment": "CASE WHEN o_orderkey % 3 = 0 THEN 'blood' WHEN o_orderkey % 3 = 1 THEN 'marrow' ELSE '' END",
        "locus": "CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE chain END",
        "c_call": "CASE WHEN o_orderstatus = 'F' THEN 'IGHM*01' WHEN o_orderstatus = 'O' THEN 'IGHG1*01' ELSE '' END",
        "productive": "CASE WHEN o_orderkey % 6 = 0 THEN 'F' WHEN o_orderkey % 17 = 0 THEN '' ELSE 'T' END",
        "vj_in_frame": "CASE WHEN o_orderkey % 6 = 0 THEN 'F' ELSE 'T' END",
        "stop_codon": "CASE WHEN o_orderkey % 12 = 0 THEN 'T' ELSE 'F' END",
        "complete_vdj": "CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE 'T' END",
        "rev_comp": "CASE WHEN o_orderkey % 4 = 0 THEN 'T' ELSE 'F' END",
        "duplicate_count": "1 + o_orderkey % 5",
        "v_identity": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 1 - CAST(o_orderkey % 20 AS DOUBLE) / 100 END",
        "d_identity": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1 - CAST(o_orderkey % 15 AS DOUBLE) / 100 END",
        "j_identity": "1 - CAST(o_orderkey % 8 AS DOUBLE) / 100",
        "c_identity": "CAST(60 + o_orderkey % 40 AS DOUBLE) / 100",
        "v_score": "CAST(200 - o_orderkey % 30 AS DOUBLE)",
        "m": "o_orderkey % 11",
        "shm": "o_orderkey % 9",
        "p1": "CAST(100 + 7 * (o_orderkey % 9) AS INT)",
        "p2": "CAST(20 + 3 * (o_orderkey % 9) AS INT)",
    },
    {
        "sequence_id": "concat('read_', ordinal)",
        "d_call": "CASE WHEN chain = 'IGH' AND ordinal % 9 <> 0 THEN concat('IGHD', dno, '*01') ELSE '' END",
        "d2_call": "CASE WHEN chain = 'IGH' AND k % 11 = 0 AND ordinal % 9 <> 0 THEN concat('IGHD', dno % 5 + 1, '*01') ELSE '' END",
        "c_sequence_alignment": "substr(c_bases, 1, CAST(20 + 10 * (ordinal % 3) AS INT))",
        "v_call": "CASE WHEN ordinal % 83 = 0 THEN '' ELSE concat(v_gene, '*01', CASE WHEN ordinal % 7 = 0 THEN concat(',', v_gene, '*02') ELSE '' END,"
        " CASE WHEN ordinal % 13 = 0 THEN concat(',', v_next, '*01') ELSE '' END) END",
        "j_call": "CASE WHEN ordinal % 79 = 0 THEN '' ELSE concat(j_gene, '*01') END",
        "v_alternatives": "CASE WHEN ordinal % 4 = 0 THEN concat(v_gene, '*02|', 198 - ordinal % 30, '|0.95|1|192|1|192;', v_next, '*01|', 190 - ordinal % 30, '|0.9|1|192|1|192')"
        " WHEN ordinal % 4 = 1 THEN concat(v_gene, '*03|||||') ELSE '' END",
        # one base of the germline is replaced in seven of eleven reads, one in 97 is an N
        "cdr3": "CASE WHEN ordinal % 89 = 0 THEN '' ELSE concat(CASE WHEN ordinal % 97 = 0 THEN 'N' WHEN m = 4 THEN substr('ACGT', CAST(ordinal % 4 + 1 AS INT), 1) ELSE substr(germ, 1, 1) END,"
        " CASE WHEN m <= 4 THEN substr(germ, 2, 200) ELSE concat(substr(germ, 2, CAST(2 * (m - 4) - 1 AS INT)), substr('ACGT', CAST(ordinal % 4 + 1 AS INT), 1), substr(germ, CAST(2 * (m - 4) + 2 AS INT), 200)) END) END",
        "v_observed": "concat(substr(v_donor, 1, p2 - 1), CASE WHEN shm >= 6 THEN translate(substr(v_donor, p2, 1), 'ACGT', 'GTAC') ELSE substr(v_donor, p2, 1) END, substr(v_donor, p2 + 1, p1 - p2 - 1),"
        " CASE WHEN shm >= 3 THEN translate(substr(v_donor, p1, 1), 'ACGT', 'GTAC') ELSE substr(v_donor, p1, 1) END, substr(v_donor, p1 + 1, 192))",
        "quality": f"translate(concat(md5(concat('q', ordinal)), md5(concat('r', ordinal % 50)), md5(concat('s', ordinal % 7))), {HEX}, {PHRED})",
    },
    {
        "cdr3_aa": f"CASE WHEN cdr3 = '' THEN '' ELSE substr(translate(md5(concat('aa', k, m)), {HEX}, {RESIDUES}), 1, CAST(8 + extra AS INT)) END",
        "v_sequence_alignment": "concat(substr(v_observed, 1, 149), CASE WHEN ordinal % 23 = 0 THEN '-' ELSE substr(v_observed, 150, 1) END, substr(v_observed, 151, 42))",
        "v_germline_alignment": "v_reference",
    },
    {
        "junction_aa": "CASE WHEN cdr3_aa = '' THEN '' ELSE concat('C', cdr3_aa, 'W') END",
        "sequence": "concat(replace(v_sequence_alignment, '-', ''), cdr3, j_reference)",
        "sequence_alignment": "concat(v_sequence_alignment, cdr3, j_reference)",
        "germline_alignment": "concat(v_reference, substr('NNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNN', 1, length(cdr3)), j_reference)",
        "v_sequence_start": "1",
        "v_sequence_end": "CASE WHEN ordinal % 23 = 0 THEN 191 ELSE 192 END",
        "v_germline_start": "1",
        "j_sequence_end": "CASE WHEN ordinal % 23 = 0 THEN 223 ELSE 224 END + length(cdr3)",
        "sequence_frame": "1",
        "fwr1_start": "1",
        "fwr1_end": "60",
        "cdr1_start": "61",
        "cdr1_end": "84",
        "fwr2_start": "85",
        "fwr2_end": "120",
        "cdr2_start": "121",
        "cdr2_end": "144",
        "fwr3_start": "145",
        "fwr3_end": "192",
    },
]

# What callers see; the rest are stepping stones.
COLUMNS = [
    "ordinal", "sequence_id", "dataset_id", "sample_id", "subject_id", "cohort", "timepoint", "compartment",
    "sequence", "quality", "rev_comp", "productive", "vj_in_frame", "stop_codon", "complete_vdj", "locus",
    "v_call", "d_call", "d2_call", "j_call", "c_call", "c_sequence_alignment", "cdr3", "cdr3_aa", "junction_aa",
    "v_identity", "d_identity", "j_identity", "c_identity", "v_score", "v_alternatives", "duplicate_count",
    "sequence_alignment", "germline_alignment", "v_sequence_alignment", "v_germline_alignment",
    "v_sequence_start", "v_sequence_end", "v_germline_start", "j_sequence_end", "sequence_frame",
    "fwr1_start", "fwr1_end", "cdr1_start", "cdr1_end", "fwr2_start", "fwr2_end", "cdr2_start", "cdr2_end",
    "fwr3_start", "fwr3_end",
    # the germline behind each row, from which reference panels are drawn
    "chain", "v_gene", "j_gene", "v_reference", "j_reference", "v_donor",
]


def rearrangements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repertoire over the tables in ``sf_dir``; unused columns are pruned away.

    One SQL text, so that the layers are analysed in a single pass.
    """

    def extend(source: str, layers: list[dict[str, str]]) -> str:
        for layer in layers:
            source = f"SELECT *, {', '.join(f'{e} AS {name}' for name, e in layer.items())} FROM ({source})"
        return source

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = int(str(orders._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(spark.sparkContext.defaultParallelism, -(-size // ORDERS_BYTES))
    donors = extend(
        "SELECT c_custkey, c_nationkey, c_mktsegment, n_regionkey "
        f"FROM parquet.`{sf_dir}/customer.parquet` JOIN parquet.`{sf_dir}/nation.parquet` ON c_nationkey = n_nationkey",
        CUSTOMER_LAYERS,
    )
    # Rows are spread behind the join and before the columns of an order are computed: with a stated number, as the few
    # bytes that are there so far would be coalesced into one task. The shuffle also keeps the donors' columns from
    # being written out again in every expression that uses them.
    joined = (
        f"SELECT /*+ REPARTITION({parts}, o_orderkey) */ o.*, x.* FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM parquet.`{sf_dir}/orders.parquet`) o "
        f"JOIN ({donors}) x ON o_custkey = c_custkey"
    )
    return spark.sql(f"SELECT {', '.join(COLUMNS)} FROM ({extend(joined, ORDER_LAYERS)})")


def rearrangements_cte(name: str = "r") -> str:
    """The same definition as a chain of common table expressions (no WITH keyword)."""
    steps, last = [], f"{name}_donor"
    steps.append(f"{last} AS (SELECT c_custkey, c_nationkey, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)")

    def extend(layers: list[dict[str, str]], prefix: str) -> None:
        nonlocal last
        for i, layer in enumerate(layers):
            added = ", ".join(f"{expression} AS {column}" for column, expression in layer.items())
            steps.append(f"{prefix}_{i} AS (SELECT *, {added} FROM {last})")
            last = f"{prefix}_{i}"

    extend(CUSTOMER_LAYERS, f"{name}_c")
    steps.append(f"{name}_joined AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, x.* FROM orders JOIN {last} x ON o_custkey = c_custkey)")
    last = f"{name}_joined"
    extend(ORDER_LAYERS, f"{name}_o")
    steps.append(f"{name} AS (SELECT {', '.join(COLUMNS)} FROM {last})")
    return ", ".join(steps)
