"""Registered queries over the derived repertoire, each beside its checking SQL.

Every query runs over whole tables. Where plain SQL can state the operator the text is
given, written independently of the Spark plan (for example an unblocked Hamming join
against the blocked one). Operators SQL cannot state within reason have no text and are
tested against brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coordinates as CD
from ..functions import sequences as S
from ..functions.tables import register_tables
from ..operators import alignment_columns as AC
from ..operators import annotate as AN
from ..operators import chimera as CH
from ..operators import collapse as CO
from ..operators import consensus as CS
from ..operators import denoise as DN
from ..operators import double_d as DD
from ..operators import facets as FA
from ..operators import lineages as LI
from ..operators import missing as MI
from ..operators import quality as QU
from ..operators import reference as RF
from ..operators import refinement as RE
from ..operators import sampling as SA
from ..operators import search as SE
from ..operators import selection as SL
from ..operators import shm as SH
from ..operators import study as ST
from ..operators.components import connected_components
from ..operators.records import records
from ..session import cut, ship_package
from ..sources import writers as WR
from .surrogate import rearrangements, rearrangements_cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CTE = "WITH RECURSIVE " + rearrangements_cte()


def query(name: str, sql: str | None = None):
    """Register a Spark query and, if given, its SQL (a body that may read ``r``)."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH") else f"{CTE} {sql}"
        return run

    return register


def with_steps(*steps: str, body: str) -> str:
    return CTE + ", " + ", ".join(steps) + " " + body


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rearrangements(spark, sf_dir).withColumn("isotype", S.infer_isotype("c_call", "c_sequence_alignment", "c_identity"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(rearrangements(spark, sf_dir))


# --- SQL fragments for the checking engine ----------------------------------


def sql_calls(column: str) -> str:
    return f"list_filter(list_transform(string_split({column}, ','), lambda x: trim(x)), lambda x: x <> '')"


def sql_gene(expression: str) -> str:
    return f"regexp_replace({expression}, '\\*.*$', '')"


def sql_nt(expression: str) -> str:
    return f"regexp_replace(replace(upper({expression}), 'U', 'T'), '[^ACGTN]', '', 'g')"


SQL_ISOTYPE = (
    "CASE WHEN c_call = '' OR length(regexp_replace(c_sequence_alignment, '[-.\\s]', '', 'g')) < 30 OR c_identity < 0.65 THEN '' "
    "WHEN c_call = 'IGHM*01' THEN 'IgM' WHEN c_call = 'IGHG1*01' THEN 'IgG1' ELSE 'other' END"
)
STEP_ISO = f"t AS (SELECT *, {SQL_ISOTYPE} AS isotype FROM r)"
STEP_BUCKET = (
    "b AS (SELECT * FROM (SELECT 'all' AS status, '*' AS locus_bucket, * FROM t UNION ALL SELECT 'all', locus, * FROM t WHERE locus <> '' "
    "UNION ALL SELECT 'productive', '*', * FROM t WHERE productive = 'T' UNION ALL SELECT 'productive', locus, * FROM t WHERE productive = 'T' AND locus <> ''))"
)
# the record projection
STEP_REC = (
    "rec AS (SELECT ordinal, sequence_id, dataset_id, sample_id, subject_id, cohort, timepoint, compartment, locus, v_call, j_call, c_call, "
    f"{sql_nt('cdr3')} AS cdr3_nt, cdr3_aa, productive = 'T' AS productive, {sql_nt('sequence')} AS sequence_nt, {sql_nt('sequence_alignment')} AS trimmed_nt, "
    f"{sql_nt('substr(sequence, v_sequence_start, j_sequence_end - v_sequence_start + 1)')} AS denoise_nt, duplicate_count AS weight, "
    "CASE WHEN c_call = '' THEN '__C_UNASSIGNED__' ELSE regexp_replace(c_call, '\\*.*$', '') END AS c_part FROM r)"
)


# --- facets and usage -------------------------------------------------------

_FACET_UNION = " UNION ALL ".join(f"SELECT '{f}' AS facet, {f} AS value FROM t" for f in FA.FACETS)


@query("facet_counts", with_steps(STEP_ISO, body=f"SELECT facet, value, count(*) AS records FROM ({_FACET_UNION}) WHERE value <> '' GROUP BY 1, 2"))
def _(spark, d):
    return FA.facet_counts(table(spark, d))


@query(
    "facet_grouping_sets",
    "SELECT sample_id, productive, CAST(GROUPING(sample_id, productive) AS INT) AS level, count(*) AS records FROM r GROUP BY GROUPING SETS ((sample_id), (productive), (sample_id, productive))",
)
def _(spark, d):
    return FA.facet_grouping_sets(table(spark, d), "sample_id", "productive")


@query(
    "call_facet",
    f"SELECT token, count(*) AS records FROM (SELECT unnest(list_distinct(flatten(list_transform({sql_calls('upper(v_call)')}, lambda c: [c, {sql_gene('c')}])))) AS token FROM r) WHERE token <> '' GROUP BY 1",
)
def _(spark, d):
    return FA.call_facet(table(spark, d), "v_call")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query(
    "usage_top",
    with_steps(STEP_ISO, STEP_BUCKET, body="SELECT status, locus_bucket, string_split(v_call, ',')[1] AS call, CAST(count(*) AS DOUBLE) AS records FROM b WHERE v_call <> '' GROUP BY 1, 2, 3"),
)
def _(spark, d):
    return FA.gene_usage(table(spark, d), "v", "top")


def _fractional_sql(column: str) -> str:
    return with_steps(
        STEP_ISO, STEP_BUCKET, f"x AS (SELECT status, locus_bucket, {sql_calls(column)} AS c FROM b)",
        body="SELECT status, locus_bucket, call, round(sum(share), 6) AS records FROM (SELECT status, locus_bucket, unnest(c) AS call, 1.0::DOUBLE / len(c) AS share FROM x) GROUP BY 1, 2, 3",
    )


for _segment in "vdjc":

    def _usage(spark, d, segment=_segment):
        return _rounded(FA.gene_usage(table(spark, d), segment, "fractional"), "records")

    query(f"usage_fractional_{_segment}", _fractional_sql(f"{_segment}_call"))(_usage)


@query(
    "usage_gene_percent",
    with_steps(
        STEP_ISO, STEP_BUCKET, f"x AS (SELECT status, locus_bucket, {sql_calls('v_call')} AS c FROM b)",
        f"u AS (SELECT status, locus_bucket, {sql_gene('call')} AS gene, sum(share) AS n FROM (SELECT status, locus_bucket, unnest(c) AS call, 1.0::DOUBLE / len(c) AS share FROM x) GROUP BY 1, 2, 3)",
        body="SELECT status, locus_bucket, gene, round(n, 6) AS records, round(100 * n / sum(n) OVER (PARTITION BY status, locus_bucket), 6) AS percent FROM u",
    ),
)
def _(spark, d):
    usage = FA.gene_rollup(FA.gene_usage(table(spark, d)), ["status", "locus_bucket"])
    return _rounded(FA.as_percent(usage, ["status", "locus_bucket"]), "records", "percent")


@query(
    "vj_pairs_top",
    with_steps(STEP_ISO, STEP_BUCKET, body="SELECT status, locus_bucket, string_split(v_call, ',')[1] AS v, string_split(j_call, ',')[1] AS j, CAST(count(*) AS DOUBLE) AS records FROM b WHERE v_call <> '' AND j_call <> '' GROUP BY 1, 2, 3, 4"),
)
def _(spark, d):
    return FA.vj_pairs(table(spark, d), "top")


_VJ_STEPS = (
    STEP_ISO, STEP_BUCKET, f"x AS (SELECT status, locus_bucket, {sql_calls('v_call')} AS vs, {sql_calls('j_call')} AS js FROM b)",
    "y AS (SELECT status, locus_bucket, js, unnest(vs) AS v, 1.0::DOUBLE / (len(vs) * len(js)) AS share FROM x WHERE len(vs) > 0 AND len(js) > 0)",
    "p AS (SELECT status, locus_bucket, v, j, sum(share) AS n FROM (SELECT status, locus_bucket, v, unnest(js) AS j, share FROM y) GROUP BY 1, 2, 3, 4)",
)


@query("vj_pairs_fractional", with_steps(*_VJ_STEPS, body="SELECT status, locus_bucket, v, j, round(n, 6) AS records FROM p"))
def _(spark, d):
    return _rounded(FA.vj_pairs(table(spark, d)), "records")


@query(
    "vj_top_matrix",
    with_steps(
        *_VJ_STEPS, "a AS (SELECT v, j, n FROM p WHERE status = 'all' AND locus_bucket = '*')",
        "tv AS (SELECT v FROM a GROUP BY v ORDER BY round(sum(n), 6) DESC, v LIMIT 12)", "tj AS (SELECT j FROM a GROUP BY j ORDER BY round(sum(n), 6) DESC, j LIMIT 12)",
        body="SELECT v, j, round(n, 6) AS records FROM a WHERE v IN (SELECT v FROM tv) AND j IN (SELECT j FROM tj)",
    ),
)
def _(spark, d):
    pairs = FA.vj_pairs(table(spark, d)).filter("status = 'all' AND locus_bucket = '*'").select("v", "j", "records")
    return _rounded(FA.pairing_matrix(pairs), "records")


@query("cdr3_length_hist", with_steps(STEP_ISO, STEP_BUCKET, body="SELECT status, locus_bucket, length(cdr3_aa)::INT AS length, count(*) AS records FROM b WHERE cdr3_aa <> '' GROUP BY 1, 2, 3"))
def _(spark, d):
    return FA.cdr3_lengths(table(spark, d))


@query(
    "v_identity_bins",
    with_steps(STEP_ISO, STEP_BUCKET, body="SELECT status, locus_bucket, floor(v_identity * 100 + 0.5)::INT AS percent, count(*) AS records FROM b WHERE v_identity IS NOT NULL GROUP BY 1, 2, 3"),
)
def _(spark, d):
    return FA.identity_bins(table(spark, d))


@query("isotype_usage", with_steps(STEP_ISO, STEP_BUCKET, body="SELECT status, locus_bucket, isotype, count(*) AS records FROM b WHERE isotype <> '' GROUP BY 1, 2, 3"))
def _(spark, d):
    return FA.isotype_usage(table(spark, d))


@query("summary_counts", "SELECT count(*) AS records, count(*) FILTER (v_call <> '' AND j_call <> '') AS assigned, count(*) FILTER (productive = 'T') AS productive, count(*) FILTER (cdr3 <> '') AS with_cdr3 FROM r")
def _(spark, d):
    return FA.summary_counts(table(spark, d))


# --- filters ----------------------------------------------------------------

_UP = f"list_transform({sql_calls('v_call')}, lambda x: upper(x))"


@query("call_filter_exact", f"SELECT ordinal FROM r WHERE len({_UP}) = 1 AND list_contains(list_transform({_UP}, lambda c: {sql_gene('c')}), 'IGHV3-1')")
def _(spark, d):
    return table(spark, d).filter(SL.call_equals("v_call", "ighv3-1")).select("ordinal")


@query("call_filter_ambiguous", f"SELECT ordinal FROM r WHERE list_contains({_UP}, 'IGHV3-1*02')")
def _(spark, d):
    return table(spark, d).filter(SL.call_equals("v_call", "IGHV3-1*02", True)).select("ordinal")


@query("call_filter_multi", f"SELECT ordinal FROM r WHERE list_sort({_UP}) = ['IGHV3-1*01', 'IGHV3-1*02']")
def _(spark, d):
    return table(spark, d).filter(SL.call_equals("v_call", "IGHV3-1*02, IGHV3-1*01")).select("ordinal")


@query(
    "browser_filter",
    with_steps(STEP_ISO, body="SELECT ordinal FROM t WHERE (contains(upper(cdr3), 'ACG') OR contains(upper(cdr3_aa), 'ACG')) AND productive = 'T' AND locus = 'IGH' AND coalesce(v_identity, 0) >= 0.85 "
               "AND length(cdr3_aa) >= 9 AND length(cdr3_aa) BETWEEN 1 AND 10 AND isotype = 'IgG1' AND d_call <> ''"),
)
def _(spark, d):
    f = SL.BrowserFilter(cdr3="acg", productive="T", locus="IGH", min_v_identity=0.85, min_cdr3_aa_length=9, max_cdr3_aa_length=10, isotype="IgG1", has_d=True)
    return table(spark, d).filter(SL.browser_condition(f)).select("ordinal")


@query("page_offset", "SELECT ordinal, sequence_id FROM r WHERE d2_call <> '' AND contains(lower(sequence_id), 'read_1') ORDER BY ordinal LIMIT 26 OFFSET 10")
def _(spark, d):
    return SL.page(table(spark, d), SL.BrowserFilter(sequence_id="READ_1", has_double_d=True), 10, 25).select("ordinal", "sequence_id")


@query("select_tristate", "SELECT ordinal FROM r WHERE productive <> 'T' AND vj_in_frame = 'T' AND complete_vdj = 'T' AND (upper(sample_id) LIKE '%SAMPLE\\_1%' ESCAPE '\\' OR upper(sample_id) LIKE '%SAMPLE\\_7%' ESCAPE '\\') AND cdr3 <> ''")
def _(spark, d):
    s = SL.Selection(productive="no", vj_in_frame="yes", complete_vdj="yes", sample_id="sample_1;sample_7", has_cdr3="yes")
    return SL.select_repertoire(table(spark, d), s).select("ordinal")


@query("select_calls", f"SELECT ordinal FROM r WHERE len({sql_calls('v_call')}) <= 1 AND contains(upper(v_call), 'V5-1') AND (contains(upper(j_call), 'J1') OR contains(upper(j_call), 'IGHJ2*01'))")
def _(spark, d):
    return SL.select_repertoire(table(spark, d), SL.Selection(v_call="v5-1", j_call="J1, IGHJ2*01", j_ambiguous=True)).select("ordinal")


@query("select_motif_iupac", "SELECT ordinal FROM r WHERE regexp_matches(upper(cdr3), '[ATU][AG]C[CTU]') AND regexp_matches(upper(cdr3), 'GG[ACGTU]C')")
def _(spark, d):
    return SL.select_repertoire(table(spark, d), SL.Selection(motif="WRCY,GGNC", motif_syntax="iupac", motif_target="cdr3_nt", motif_mode="all")).select("ordinal")


@query("select_motif_regex", "SELECT ordinal FROM r WHERE regexp_matches(junction_aa, '^C[AK].+W$') OR regexp_matches(junction_aa, 'D{2}')")
def _(spark, d):
    return SL.select_repertoire(table(spark, d), SL.Selection(motif="^c[ak].+w$\nD{2}", motif_syntax="regex", motif_target="junction_aa")).select("ordinal")


@query(
    "select_ranges",
    "SELECT ordinal FROM r WHERE length(cdr3) >= 25 AND length(cdr3) <= 28 AND coalesce(v_identity, 0) >= 0.8 AND v_identity IS NOT NULL AND 1 - v_identity >= 0.03 AND 1 - v_identity <= 0.125 AND coalesce(j_identity, 0) >= 0.95",
)
def _(spark, d):
    s = SL.Selection(min_cdr3_nt_length=25, max_cdr3_nt_length=28, min_v_identity=0.8, min_v_mutation=0.03, max_v_mutation=0.125, min_j_identity=0.95)
    return SL.select_repertoire(table(spark, d), s).select("ordinal")


@query("select_double_d", "SELECT ordinal FROM r WHERE ordinal % 2 = 0 AND d2_call <> '' AND contains(upper(d_call), 'IGHD2')")
def _(spark, d):
    t = table(spark, d)
    evidence = t.filter("d2_call <> ''").select("ordinal", "d_call", "d2_call")
    mask = t.filter("ordinal % 2 = 0").select("ordinal")
    return SL.select_repertoire(t, SL.Selection(double_d="positive", d1_call="IGHD2"), mask, evidence).select("ordinal")


# --- study metadata and sets ------------------------------------------------


@query(
    "dataset_annotation",
    "SELECT ordinal, dataset_id || '::' || sequence_id AS sequence_id, sequence_id AS source_sequence_id, dataset_id, s AS sample_id, u AS subject_id FROM r "
    "JOIN (SELECT dataset_id AS k, min(sample_id) AS s, min(subject_id) AS u FROM r GROUP BY 1) ON k = dataset_id",
)
def _(spark, d):
    t = table(spark, d)
    manifest = t.groupBy("dataset_id").agg(*[F.min(c).alias(c) for c in ST.METADATA_COLUMNS])
    return ST.annotate_datasets(t, manifest).select("ordinal", "sequence_id", "source_sequence_id", "dataset_id", "sample_id", "subject_id")


@query("metadata_overlay", "SELECT ordinal, CASE WHEN dataset_id LIKE 'lib_1_%' THEN 'renamed' ELSE sample_id END AS sample_id, CASE WHEN dataset_id LIKE 'lib_1_%' THEN '' ELSE cohort END AS cohort FROM r")
def _(spark, d):
    t = table(spark, d)
    changed = t.filter("dataset_id LIKE 'lib_1_%'").select("dataset_id").distinct().select(
        "dataset_id", F.lit(" renamed ").alias("sample_id"), *[F.lit("").alias(c) for c in ST.METADATA_COLUMNS if c != "sample_id"]
    )
    return ST.overlay_metadata(t, changed).select("ordinal", "sample_id", "cohort")


@query("scope_sizes", "SELECT 'cohort' AS scope, cohort AS unit, count(*) AS records FROM r GROUP BY 2 UNION ALL SELECT 'subject', subject_id, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'global', 'complete study', count(*) FROM r")
def _(spark, d):
    t = table(spark, d)
    units = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), ST.scope_value(s).alias("unit")) for s in ("cohort", "subject", "global")]))
    return t.select(units.alias("u")).groupBy("u.scope", "u.unit").agg(F.count(F.lit(1)).alias("records"))


@query("mask_intersection", "SELECT ordinal FROM r WHERE productive = 'T' AND d_call <> '' AND coalesce(v_identity, 0) >= 0.9")
def _(spark, d):
    t = table(spark, d)
    first, second = t.filter("productive = 'T'").select("ordinal"), t.filter("d_call <> ''").select("ordinal")
    third = t.filter(F.coalesce("v_identity", F.lit(0.0)) >= 0.9).select("ordinal")
    return first.join(second, "ordinal", "left_semi").join(third, "ordinal", "left_semi")


@query("mask_complement", "SELECT ordinal FROM r WHERE NOT (productive = 'T')")
def _(spark, d):
    t = table(spark, d)
    return t.select("ordinal").join(t.filter("productive = 'T'").select("ordinal"), "ordinal", "left_anti")


@query("detail_lookup", "SELECT ordinal, sequence_id, v_call, j_call, cdr3 FROM r WHERE ordinal IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, d):
    wanted = spark.read.parquet(f"{d}/orders.parquet").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("ordinal"))
    return table(spark, d).join(wanted, "ordinal", "left_semi").select("ordinal", "sequence_id", "v_call", "j_call", "cdr3")


# --- exact collapse ---------------------------------------------------------


def _collapse_sql(key: str, scope: str = "sample_id", c: bool = True, retain: bool = False) -> str:
    columns = {"sequence": ["sequence_nt"], "trimmed": ["trimmed_nt"], "cdr3": ["locus", "cdr3_nt"], "rearrangement": ["locus", "v_call", "j_call", "cdr3_nt"]}[key]
    usable = " AND ".join(f"{x} <> ''" for x in columns)
    group = ", ".join([scope, *(["c_part"] if c else []), *columns])
    body = f"SELECT min(ordinal) AS representative, CAST(sum(weight) AS BIGINT) AS count, count(*) AS members FROM rec WHERE {usable} GROUP BY {group}"
    if retain:
        body += f" UNION ALL SELECT ordinal, weight, 1 FROM rec WHERE NOT ({usable})"
    return with_steps(STEP_REC, body=body)


for _key in CO.KEYS:

    def _run(spark, d, key=_key):
        return CO.collapse(base(spark, d), key)

    query(f"collapse_{_key}", _collapse_sql(_key))(_run)


@query("collapse_ignore_c", _collapse_sql("rearrangement", c=False))
def _(spark, d):
    return CO.collapse(base(spark, d), "rearrangement", respect_constant=False)


@query("collapse_subject_retained", _collapse_sql("cdr3", scope="subject_id", retain=True))
def _(spark, d):
    return CO.collapse(base(spark, d), "cdr3", "subject", "retain")


@query(
    "collapse_members",
    with_steps(STEP_REC, body="SELECT ordinal, min(ordinal) OVER (PARTITION BY sample_id, c_part, locus, cdr3_nt) AS representative FROM rec WHERE locus <> '' AND cdr3_nt <> '' "
               "UNION ALL SELECT ordinal, NULL FROM rec WHERE locus = '' OR cdr3_nt = ''"),
)
def _(spark, d):
    return CO.collapse_members(base(spark, d), "cdr3")


@query(
    "collapse_largest",
    with_steps(STEP_REC, body="SELECT min(ordinal) AS representative, CAST(sum(weight) AS BIGINT) AS count, count(*) AS members FROM rec WHERE locus <> '' AND cdr3_nt <> '' GROUP BY locus, cdr3_nt HAVING sum(weight) > 1 ORDER BY 2 DESC, 1 LIMIT 100"),
)
def _(spark, d):
    return CO.largest_groups(CO.collapse(base(spark, d), "cdr3", "global", respect_constant=False))


@query(
    "collapse_summary",
    with_steps(
        STEP_REC, "g AS (SELECT sum(weight) AS n FROM rec WHERE trimmed_nt <> '' GROUP BY sample_id, c_part, trimmed_nt)",
        body="SELECT (SELECT count(*) FROM rec) AS input_records, CAST((SELECT sum(weight) FROM rec) AS BIGINT) AS input_abundance, (SELECT count(*) FROM g) AS unique_records, "
             "CAST((SELECT sum(n) FROM g) AS BIGINT) AS retained_abundance, (SELECT count(*) FROM rec) - (SELECT count(*) FROM g) AS collapsed_records",
    ),
)
def _(spark, d):
    rows = base(spark, d)
    return CO.collapse_summary(rows, CO.collapse(rows))


# --- lineages ---------------------------------------------------------------

_TOKENS = (
    f"list_sort(list_distinct(list_transform({sql_calls('v_call')}, lambda c: {sql_gene('upper(c)')}))) AS vs, "
    f"list_sort(list_distinct(list_transform({sql_calls('j_call')}, lambda c: {sql_gene('upper(c)')}))) AS js"
)
_STRICT_TOKENS = (
    f"list_sort(list_distinct(list_transform({sql_calls('v_call')}, lambda c: upper(c)))) AS vs, list_sort(list_distinct(list_transform({sql_calls('j_call')}, lambda c: upper(c)))) AS js"
)
_SHARED = "list_has_any(a.vs, b.vs) AND list_has_any(a.js, b.js)"


def _lineage_steps(identity: float, scope: str = "subject_id", tokens: str = _TOKENS, agree: str = _SHARED) -> tuple[str, ...]:
  return (
    STEP_REC,
    f"el AS (SELECT *, {tokens} FROM rec WHERE productive AND cdr3_nt <> '' AND v_call <> '' AND j_call <> '')",
    f"nd AS (SELECT {scope}, locus, vs, js, cdr3_nt, min(ordinal) AS id FROM el GROUP BY ALL)",
    # no blocks here: every pair of a scope, locus and length is compared
    f"ed AS (SELECT a.id AS x, b.id AS y FROM nd a JOIN nd b ON a.{scope} = b.{scope} AND a.locus = b.locus AND length(a.cdr3_nt) = length(b.cdr3_nt) AND a.id <> b.id WHERE {agree} "
    "AND hamming(a.cdr3_nt, b.cdr3_nt) <= floor({gap} * length(a.cdr3_nt) + 1e-9))".replace("{gap}", str(round(1 - identity, 6))),
    "reach(x, y) AS (SELECT id, id FROM nd UNION SELECT reach.x, ed.y FROM reach JOIN ed ON reach.y = ed.x)",
    "lb AS (SELECT x AS id, min(y) AS lineage_id FROM reach GROUP BY x)",
    "asg AS (SELECT el.ordinal, lb.lineage_id FROM el JOIN nd USING ({scope}, locus, vs, js, cdr3_nt) JOIN lb ON lb.id = nd.id)".replace("{scope}", scope),
  )


LINEAGE_STEPS = _lineage_steps(0.85)
# narrow lineages: equal CDR3s only, so that near ones are neighbours
NARROW = LI.LineageOptions(identity=0.97)
NARROW_STEPS = _lineage_steps(0.97)


def _assigned(spark, d, options: LI.LineageOptions | None = None):
    rows = base(spark, d)
    return rows, LI.assign_lineages(rows, options)


@query("lineage_assign", with_steps(*LINEAGE_STEPS, body="SELECT ordinal, lineage_id FROM asg"))
def _(spark, d):
    return _assigned(spark, d)[1]


_SUMMARY_STEP = (
    "sm AS (SELECT lineage_id, arg_min(ordinal, ordinal) AS representative_ordinal, count(*) AS unique_members, CAST(sum(weight) AS BIGINT) AS abundance, "
    "arg_min(locus, ordinal) AS locus, arg_min(vs, ordinal) AS vs, arg_min(js, ordinal) AS js, CAST(length(arg_min(cdr3_nt, ordinal)) AS INT) AS cdr3_length, "
    "arg_min(cdr3_nt, ordinal) AS representative_cdr3_nt, arg_min(cdr3_aa, ordinal) AS representative_cdr3_aa, arg_min(subject_id, ordinal) AS study_group FROM el JOIN asg USING (ordinal) GROUP BY lineage_id)"
)


def _summary(spark, d):
    rows, assigned = _assigned(spark, d)
    return LI.lineage_summary(rows, assigned)


@query(
    "lineage_summary",
    with_steps(*LINEAGE_STEPS, _SUMMARY_STEP, body="SELECT * EXCLUDE (vs, js), array_to_string(vs, ',') AS v_calls, array_to_string(js, ',') AS j_calls FROM sm"),
)
def _(spark, d):
    return _summary(spark, d).withColumns({c: F.array_join(c, ",") for c in ("v_calls", "j_calls")})


@query("lineage_top", with_steps(*LINEAGE_STEPS, _SUMMARY_STEP, body="SELECT lineage_id, abundance, unique_members FROM sm ORDER BY abundance DESC, unique_members DESC, lineage_id LIMIT 50"))
def _(spark, d):
    return LI.top_lineages(_summary(spark, d), 50).select("lineage_id", "abundance", "unique_members")


@query(
    "lineage_size_hist",
    with_steps(*LINEAGE_STEPS, _SUMMARY_STEP, body="SELECT CASE WHEN abundance <= 1 THEN '1' WHEN abundance <= 3 THEN '2–3' WHEN abundance <= 9 THEN '4–9' WHEN abundance <= 24 THEN '10–24' WHEN abundance <= 99 THEN '25–99' "
               "WHEN abundance <= 499 THEN '100–499' ELSE '500+' END AS label, count(*) AS lineages FROM sm GROUP BY 1"),
)
def _(spark, d):
    return LI.size_histogram(_summary(spark, d))


@query("lineage_v_usage", with_steps(*LINEAGE_STEPS, _SUMMARY_STEP, body="SELECT call, count(*) AS lineages, CAST(sum(abundance) AS BIGINT) AS abundance FROM (SELECT unnest(vs) AS call, abundance FROM sm) GROUP BY 1"))
def _(spark, d):
    return LI.call_usage(_summary(spark, d), "v_calls")


# collapse first, then lineages over the representatives, then counts over the sources
COLLAPSED_LINEAGE_STEPS = (
    LINEAGE_STEPS[0].replace("rec AS (", "rec0 AS ("),
    "mem AS (SELECT ordinal, min(ordinal) OVER (PARTITION BY sample_id, c_part, locus, v_call, j_call, cdr3_nt) AS representative FROM rec0 WHERE locus <> '' AND v_call <> '' AND j_call <> '' AND cdr3_nt <> '')",
    "rec AS (SELECT rec0.* EXCLUDE (weight), w AS weight FROM rec0 JOIN (SELECT representative, sum(weight) AS w FROM mem JOIN rec0 USING (ordinal) GROUP BY 1) g ON g.representative = rec0.ordinal)",
    *LINEAGE_STEPS[1:],
    "inh AS (SELECT mem.ordinal, mem.representative, asg.lineage_id FROM mem JOIN asg ON asg.ordinal = mem.representative)",
)


def _collapsed(spark, d):
    rows = base(spark, d)
    members = CO.collapse_members(rows, "rearrangement").filter("representative IS NOT NULL")
    active = CO.apply_collapse(rows, CO.collapse(rows, "rearrangement"))
    assigned = LI.assign_lineages(active)
    return rows, active, assigned, LI.inherit_assignments(assigned, members)


_SC_BODY = (
    "SELECT lineage_id, sample_id, count(DISTINCT representative) AS unique_members, CAST(sum(weight) AS BIGINT) AS abundance FROM inh JOIN rec0 USING (ordinal) GROUP BY 1, 2"
)


@query("lineage_sample_counts", with_steps(*COLLAPSED_LINEAGE_STEPS, body=_SC_BODY))
def _(spark, d):
    rows, _, _, members = _collapsed(spark, d)
    return LI.sample_counts(rows, members)


@query(
    "lineage_study_values",
    with_steps(*COLLAPSED_LINEAGE_STEPS, body="SELECT DISTINCT lineage_id, field, value FROM (" + " UNION ALL ".join(
        f"SELECT lineage_id, '{f}' AS field, {f} AS value FROM inh JOIN rec0 USING (ordinal)" for f in ("sample_id", "subject_id", "timepoint", "compartment")) + ") WHERE value <> ''"),
)
def _(spark, d):
    rows, _, _, members = _collapsed(spark, d)
    return LI.study_values(rows, members)


@query(
    "lineage_explore",
    with_steps(*COLLAPSED_LINEAGE_STEPS, _SUMMARY_STEP, f"sc AS ({_SC_BODY})",
               "pl AS (SELECT lineage_id, count(*) AS n, count(*) FILTER (sample_id IN ('sample_1', 'sample_2')) AS hit FROM sc GROUP BY 1)",
               body="SELECT lineage_id, abundance, n AS sample_total FROM sm JOIN pl USING (lineage_id) WHERE hit > 0 AND n >= 2 AND abundance >= 5 AND unique_members >= 2 AND cdr3_length BETWEEN 24 AND 27 AND contains(array_to_string(vs, ','), 'V3-1')"),
)
def _(spark, d):
    rows, active, assigned, members = _collapsed(spark, d)
    shown = LI.explore(
        LI.lineage_summary(active, assigned), LI.sample_counts(rows, members), search="v3-1", min_abundance=5, min_unique=2, min_samples=2,
        cdr3_length=(24, 27), sample_mode="selected-any", selected=("sample_1", "sample_2"),
    )
    return shown.select("lineage_id", "abundance", "sample_total")


@query(
    "lineage_double_d",
    with_steps(*LINEAGE_STEPS, body="SELECT lineage_id, count(*) AS unique_members, count(*) FILTER (d2_call <> '') AS positive_members, CAST(coalesce(sum(weight) FILTER (d2_call <> ''), 0) AS BIGINT) AS positive_abundance "
               "FROM asg JOIN rec USING (ordinal) JOIN (SELECT ordinal, d2_call FROM r) USING (ordinal) GROUP BY 1 HAVING count(*) FILTER (d2_call <> '') > 0"),
)
def _(spark, d):
    rows, assigned = _assigned(spark, d)
    positives = table(spark, d).filter("d2_call <> ''").select("ordinal")
    return LI.double_d_counts(rows, assigned, positives).filter(LI.double_d_matches("present"))


@query(
    "lineage_merge",
    with_steps(
        *LINEAGE_STEPS, "big AS (SELECT lineage_id, arg_min(cdr3_nt, el.ordinal) AS c FROM asg JOIN el ON el.ordinal = asg.ordinal GROUP BY 1)",
        # lineages whose representative CDR3 is equal, in any donor, are merged
        "cl AS (SELECT lineage_id, min(lineage_id) OVER (PARTITION BY c) AS merged_lineage_id FROM big)",
        body="SELECT ordinal, lineage_id, merged_lineage_id FROM asg JOIN cl USING (lineage_id)",
    ),
)
def _(spark, d):
    rows, assigned = _assigned(spark, d)
    summary = LI.lineage_summary(rows, assigned)
    first = summary.groupBy("representative_cdr3_nt").agg(F.min("lineage_id").alias("left_id"))
    merges = summary.join(first, "representative_cdr3_nt").select("left_id", F.col("lineage_id").alias("right_id"))
    return LI.merge_lineages(assigned, merges).select("ordinal", "lineage_id", "merged_lineage_id")


@query("lineage_strict_allele", with_steps(*_lineage_steps(0.9, "sample_id", _STRICT_TOKENS, "a.vs = b.vs AND a.js = b.js"), body="SELECT ordinal, lineage_id FROM asg"))
def _(spark, d):
    return LI.assign_lineages(base(spark, d), LI.LineageOptions(resolution="allele", ambiguity="strict", identity=0.9, scope="sample"))


# --- similarity search ------------------------------------------------------

# the stated query set: the CDR3s of the reads whose id is divisible by 100, each named by its first read
_PROBE_SQL = "qq AS (SELECT min(ordinal) AS query_index, cdr3_nt AS query FROM rec WHERE ordinal % 100 = 0 AND cdr3_nt <> '' GROUP BY cdr3_nt)"


def _probes(spark, d) -> DataFrame:
    rows = base(spark, d).filter("ordinal % 100 = 0 AND cdr3_nt <> ''")
    return rows.groupBy(F.col("cdr3_nt").alias("sequence")).agg(F.min("ordinal").alias("query_index")).select("query_index", "sequence")


@query("query_exact", with_steps(STEP_REC, _PROBE_SQL, body="SELECT ordinal, query_index, 1.0::DOUBLE AS score, 0 AS distance, cdr3_nt AS matched FROM rec JOIN qq ON cdr3_nt = query WHERE productive"))
def _(spark, d):
    return SE.query_records(base(spark, d), _probes(spark, d), SE.QueryOptions(metric="exact", productive_only=True))


@query(
    "query_substring",
    with_steps(
        STEP_REC, _PROBE_SQL, "q2 AS (SELECT query_index, substr(query, 6, 12) AS query FROM qq)",
        body="SELECT ordinal, query_index, round(least(length(cdr3_nt), length(query))::DOUBLE / greatest(length(cdr3_nt), length(query)), 6) AS score, CAST(abs(length(cdr3_nt) - length(query)) AS INT) AS distance, cdr3_nt AS matched "
             "FROM rec JOIN q2 ON contains(cdr3_nt, query) OR contains(query, cdr3_nt) WHERE cdr3_nt <> ''",
    ),
)
def _(spark, d):
    short = _probes(spark, d).withColumn("sequence", F.substring("sequence", 6, 12))
    return _rounded(SE.query_records(base(spark, d), short, SE.QueryOptions(metric="substring")), "score")


@query(
    "query_hamming",
    with_steps(
        STEP_REC, _PROBE_SQL, "c AS (SELECT DISTINCT cdr3_nt FROM rec WHERE cdr3_nt <> '')",
        # N on either side matches: positions are compared one by one
        "m AS (SELECT cdr3_nt, query_index, CAST(list_sum(list_transform(range(1, length(query) + 1), lambda i: CASE WHEN substr(query, i, 1) = substr(cdr3_nt, i, 1) OR substr(query, i, 1) = 'N' OR substr(cdr3_nt, i, 1) = 'N' THEN 0 ELSE 1 END)) AS INT) AS distance "
        "FROM c JOIN qq ON length(cdr3_nt) = length(query))",
        body="SELECT ordinal, query_index, round(1 - distance::DOUBLE / length(cdr3_nt), 6) AS score, distance, cdr3_nt AS matched FROM rec JOIN m USING (cdr3_nt) WHERE distance <= floor(0.1 * length(cdr3_nt) + 1e-9) AND locus = 'IGH'",
    ),
)
def _(spark, d):
    return _rounded(SE.query_records(base(spark, d), _probes(spark, d), SE.QueryOptions(metric="hamming", identity=0.9, locus="IGH")), "score")


@query(
    "query_edit",
    with_steps(
        STEP_REC, _PROBE_SQL, "c AS (SELECT DISTINCT cdr3_nt FROM rec WHERE cdr3_nt <> '')",
        "m AS (SELECT cdr3_nt, query_index, levenshtein(cdr3_nt, query) AS distance, greatest(length(cdr3_nt), length(query)) AS n FROM c JOIN qq ON abs(length(cdr3_nt) - length(query)) <= 3)",
        body="SELECT ordinal, query_index, round(1 - distance::DOUBLE / n, 6) AS score, CAST(distance AS INT) AS distance, cdr3_nt AS matched FROM rec JOIN m USING (cdr3_nt) WHERE distance <= floor(0.1 * n + 1e-9)",
    ),
)
def _(spark, d):
    return _rounded(SE.query_records(base(spark, d), _probes(spark, d), SE.QueryOptions(metric="edit", identity=0.9)), "score")


@query("query_sketch")
def _(spark, d):
    rows = base(spark, d)
    probes = rows.groupBy("v_call").agg(F.min_by("trimmed_nt", "ordinal").alias("sequence"), F.min("ordinal").alias("query_index")).select("query_index", "sequence")
    return _rounded(SE.query_records(rows, probes, SE.QueryOptions(target="trimmed", metric="sketch", identity=0.75)), "score")


@query(
    "query_best_per_lineage",
    with_steps(
        *LINEAGE_STEPS, _PROBE_SQL,
        "c AS (SELECT DISTINCT cdr3_nt FROM el)",
        "hd AS (SELECT cdr3_nt, query_index, length(query) AS n, CAST(list_sum(list_transform(range(1, length(query) + 1), lambda i: CASE WHEN substr(query, i, 1) = substr(cdr3_nt, i, 1) OR substr(query, i, 1) = 'N' OR substr(cdr3_nt, i, 1) = 'N' THEN 0 ELSE 1 END)) AS INT) AS distance FROM c JOIN qq ON length(cdr3_nt) = length(query))",
        "h AS (SELECT lineage_id, ordinal, query_index, distance, 1 - distance::DOUBLE / n AS score FROM el JOIN asg USING (ordinal) JOIN hd USING (cdr3_nt) WHERE distance <= floor(0.1 * n + 1e-9))",
        "k AS (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY score DESC, distance, ordinal, query_index) AS rn FROM h)",
        body="SELECT k.lineage_id, k.ordinal, k.query_index, round(k.score, 6) AS score, CAST(k.distance AS INT) AS distance, s AS matched_sequences, q AS matched_queries FROM k "
             "JOIN (SELECT lineage_id, count(DISTINCT ordinal) AS s, count(DISTINCT query_index) AS q FROM h GROUP BY 1) USING (lineage_id) WHERE rn = 1",
    ),
)
def _(spark, d):
    rows, assigned = _assigned(spark, d)
    hits = SE.query_records(rows, _probes(spark, d), SE.QueryOptions(metric="hamming", identity=0.9))
    return _rounded(SE.best_per_lineage(hits, assigned).drop("matched"), "score")


_SOURCES = "src AS (SELECT DISTINCT lineage_id FROM asg WHERE ordinal % 100 = 0)"


def _sources(assigned: DataFrame) -> DataFrame:
    """Lineages with a read whose id is divisible by 100: a search that grows with the table."""
    return assigned.filter("ordinal % 100 = 0").select("lineage_id").distinct()


def _neighbour_sql(edit: bool, identity: float) -> str:
    length = "greatest(length(a.cdr3_nt), length(b.cdr3_nt))"
    pair = f"levenshtein(a.cdr3_nt, b.cdr3_nt) <= floor({1 - identity} * {length} + 1e-9)" if edit else f"length(a.cdr3_nt) = length(b.cdr3_nt) AND hamming(a.cdr3_nt, b.cdr3_nt) <= floor({1 - identity} * length(a.cdr3_nt) + 1e-9)"
    distance = "levenshtein(a.cdr3_nt, b.cdr3_nt)" if edit else "hamming(a.cdr3_nt, b.cdr3_nt)"
    calls = "" if edit else " AND list_has_any(a.vs, b.vs) AND list_has_any(a.js, b.js)"
    return with_steps(
        *NARROW_STEPS, _SOURCES, "mm AS (SELECT DISTINCT lineage_id, subject_id, locus, vs, js, cdr3_nt FROM el JOIN asg USING (ordinal))",
        "lt AS (SELECT lineage_id, count(*) AS unique_members, CAST(sum(weight) AS BIGINT) AS abundance FROM el JOIN asg USING (ordinal) GROUP BY 1)",
        f"h AS (SELECT b.lineage_id, {distance} AS distance, 1 - {distance}::DOUBLE / {length} AS identity FROM mm a JOIN src ON src.lineage_id = a.lineage_id JOIN mm b ON a.subject_id = b.subject_id AND a.locus = b.locus "
        f"WHERE b.lineage_id NOT IN (SELECT lineage_id FROM src) AND {pair}{calls})",
        body="SELECT lineage_id, round(max(identity), 6) AS identity, unique_members, abundance FROM h JOIN lt USING (lineage_id) GROUP BY ALL",
    )


@query("neighbours_hamming", _neighbour_sql(False, 0.9))
def _(spark, d):
    rows, assigned = _assigned(spark, d, NARROW)
    hits = SE.lineage_neighbours(rows, assigned, _sources(assigned), SE.NeighbourOptions(min_identity=0.9))
    return _rounded(hits.select("lineage_id", "identity", "unique_members", "abundance"), "identity")


@query("neighbours_edit", _neighbour_sql(True, 0.88))
def _(spark, d):
    rows, assigned = _assigned(spark, d, NARROW)
    hits = SE.lineage_neighbours(rows, assigned, _sources(assigned), SE.NeighbourOptions(min_identity=0.88, metric="edit", call_policy="ignore"))
    return _rounded(hits.select("lineage_id", "identity", "unique_members", "abundance"), "identity")


@query(
    "expand_linkage",
    with_steps(*LINEAGE_STEPS, body="SELECT ordinal FROM asg WHERE lineage_id IN (SELECT lineage_id FROM asg JOIN orders ON o_orderkey = ordinal WHERE o_totalprice > 450000)"),
)
def _(spark, d):
    seeds = spark.read.parquet(f"{d}/orders.parquet").filter("o_totalprice > 450000").select(F.col("o_orderkey").alias("ordinal"))
    return SE.expand_linkage(base(spark, d), seeds).select("ordinal")


# --- hypermutation ----------------------------------------------------------

_Q, _G = "v_sequence_alignment", "v_germline_alignment"
_SHM_STEPS = (
    "sh0 AS (SELECT ordinal, sample_id, subject_id, v_call, duplicate_count AS weight, v_sequence_alignment AS q, v_germline_alignment AS g FROM r)",
    # the germline has no gaps, so a column number is a germline position
    "cols AS (SELECT ordinal, unnest(range(1, length(q) + 1)) AS i, q, g FROM sh0)",
    "cc AS (SELECT ordinal, i, substr(q, i, 1) AS a, substr(g, i, 1) AS b, i - CASE WHEN strpos(q, '-') > 0 AND strpos(q, '-') <= i THEN 1 ELSE 0 END AS qp FROM cols)",
    "nt AS (SELECT ordinal, count(*) FILTER (a <> '-') AS compared_nt, count(*) FILTER (a <> '-' AND a <> b) AS v_nt_mutations, "
    "count(*) FILTER (a <> '-' AND (qp BETWEEN 61 AND 84 OR qp BETWEEN 121 AND 144)) AS cdr_nt_compared, count(*) FILTER (a <> '-' AND a <> b AND (qp BETWEEN 61 AND 84 OR qp BETWEEN 121 AND 144)) AS cdr_nt_mutations, "
    "count(*) FILTER (a <> '-' AND (qp BETWEEN 1 AND 60 OR qp BETWEEN 85 AND 120 OR qp BETWEEN 145 AND 192)) AS framework_nt_compared, "
    "count(*) FILTER (a <> '-' AND a <> b AND (qp BETWEEN 1 AND 60 OR qp BETWEEN 85 AND 120 OR qp BETWEEN 145 AND 192)) AS framework_nt_mutations FROM cc GROUP BY ordinal)",
)


@query(
    "shm_site_counts",
    with_steps(
        *_SHM_STEPS,
        body="SELECT ordinal, CAST(compared_nt AS INT) AS compared_nt, CAST(v_nt_mutations AS INT) AS v_nt_mutations, round(v_nt_mutations::DOUBLE / compared_nt, 6) AS v_nt_rate, CAST(cdr_nt_compared AS INT) AS cdr_nt_compared, CAST(cdr_nt_mutations AS INT) AS cdr_nt_mutations, "
             "CAST(framework_nt_compared AS INT) AS framework_nt_compared, CAST(framework_nt_mutations AS INT) AS framework_nt_mutations FROM nt",
    ),
)
def _(spark, d):
    m = SH.shm_metrics(table(spark, d))
    return _rounded(m.select("ordinal", "compared_nt", "v_nt_mutations", "v_nt_rate", "cdr_nt_compared", "cdr_nt_mutations", "framework_nt_compared", "framework_nt_mutations"), "v_nt_rate")


_CODON_VALUES = ", ".join(f"('{c}', '{a}')" for c, a in S.CODON_TABLE.items())


@query(
    "shm_codon_counts",
    with_steps(
        f"code(codon, aa) AS (VALUES {_CODON_VALUES})", _SHM_STEPS[0],
        # a codon ends where the number of read bases so far is divisible by three, if its three columns have no gap
        "cd AS (SELECT ordinal, substr(q, i - 2, 3) AS a, substr(g, i - 2, 3) AS b FROM (SELECT ordinal, q, g, unnest(range(3, length(q) + 1)) AS i FROM sh0) WHERE length(replace(substr(q, 1, i), '-', '')) % 3 = 0 AND NOT contains(substr(q, i - 2, 3), '-'))",
        body="SELECT ordinal, CAST(count(*) AS INT) AS compared_codons, CAST(count(*) FILTER (a <> b AND x.aa = y.aa) AS INT) AS synonymous, CAST(count(*) FILTER (a <> b AND x.aa <> y.aa) AS INT) AS v_aa_replacements "
             "FROM cd JOIN code x ON x.codon = a JOIN code y ON y.codon = b GROUP BY ordinal",
    ),
)
def _(spark, d):
    return SH.shm_metrics(table(spark, d)).select("ordinal", "compared_codons", "synonymous", "v_aa_replacements")


@query(
    "shm_weighted_quantiles",
    with_steps(
        *_SHM_STEPS, "m AS (SELECT sample_id, weight, v_nt_mutations::DOUBLE / compared_nt AS x FROM nt JOIN sh0 USING (ordinal))",
        "w AS (SELECT sample_id, x, sum(weight) OVER (PARTITION BY sample_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(weight) OVER (PARTITION BY sample_id) AS total FROM m)",
        "e AS (SELECT sample_id, min(x) FILTER (run >= 0.5 * total) AS median, min(x) FILTER (run >= 0.95 * total) AS p95 FROM w GROUP BY 1)",
        body="SELECT sample_id, count(*) AS records, CAST(sum(weight) AS BIGINT) AS abundance, round(sum(x * weight) / sum(weight), 6) AS mean, round(max(x), 6) AS maximum, round(any_value(median), 6) AS median, round(any_value(p95), 6) AS p95 FROM m JOIN e USING (sample_id) GROUP BY 1",
    ),
)
def _(spark, d):
    return _rounded(SH.weighted_distribution(SH.shm_metrics(table(spark, d)), "v_nt_rate", ["sample_id"]), "mean", "maximum", "median", "p95")


@query(
    "shm_histogram",
    with_steps(*_SHM_STEPS, body="SELECT CAST(floor(least(0.999999, v_nt_mutations / 50.0) * 20) AS INT) AS bin, count(*) AS records, CAST(sum(weight) AS BIGINT) AS abundance FROM nt JOIN sh0 USING (ordinal) GROUP BY 1"),
)
def _(spark, d):
    return SH.histogram(SH.shm_metrics(table(spark, d)), "v_nt_mutations")


@query(
    "shm_lowest_member",
    with_steps(
        *LINEAGE_STEPS, *_SHM_STEPS, "k AS (SELECT lineage_id, ordinal, v_nt_mutations, v_nt_mutations::DOUBLE / compared_nt AS x, row_number() OVER (PARTITION BY lineage_id ORDER BY v_nt_mutations::DOUBLE / compared_nt, v_nt_mutations, ordinal) AS rn FROM asg JOIN nt USING (ordinal))",
        body="SELECT lineage_id, ordinal, round(x, 6) AS v_nt_rate, CAST(v_nt_mutations AS INT) AS v_nt_mutations FROM k WHERE rn = 1",
    ),
)
def _(spark, d):
    _, assigned = _assigned(spark, d)
    return _rounded(SH.lowest_by_lineage(SH.shm_metrics(table(spark, d).join(assigned, "ordinal"))), "v_nt_rate")


@query("shm_lineage_sample_matrix")
def _(spark, d):
    _, assigned = _assigned(spark, d)
    m = SH.shm_metrics(table(spark, d).join(assigned, "ordinal"))
    return _rounded(SH.lineage_sample_matrix(SH.weighted_distribution(m, "v_nt_rate", ["lineage_id", "sample_id"]), "p95"), "value")


# --- missing alleles --------------------------------------------------------


def _v_reference(spark, d) -> DataFrame:
    """Named V alleles behind the reads: *01 of every gene."""
    return cut(table(spark, d).select(F.concat("v_gene", F.lit("*01")).alias("name"), F.col("v_reference").alias("sequence")).distinct())


_UNIT_STEPS = (
    *LINEAGE_STEPS, *_SHM_STEPS,
    "ob AS (SELECT ordinal, lineage_id, string_split(r.v_call, ',')[1] AS v_call, compared_nt AS aligned, v_nt_mutations::DOUBLE / compared_nt AS rate FROM asg JOIN nt USING (ordinal) JOIN r USING (ordinal) WHERE compared_nt >= 180 AND v_nt_mutations::DOUBLE / compared_nt <= 0.08)",
    "un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY rate, aligned DESC, ordinal) AS rn FROM ob) WHERE rn = 1)",
)


def _units(spark, d) -> DataFrame:
    _, assigned = _assigned(spark, d)
    return MI.discovery_units(MI.observations(table(spark, d).join(assigned, "ordinal")), MI.MissingOptions())


@query("discovery_units", with_steps(*_UNIT_STEPS, body="SELECT lineage_id, ordinal, v_call, CAST(aligned AS INT) AS aligned, round(rate, 6) AS rate FROM un"))
def _(spark, d):
    return _rounded(_units(spark, d).select("lineage_id", "ordinal", "v_call", "aligned", "rate"), "rate")


@query(
    "site_support",
    with_steps(
        *_UNIT_STEPS, "uc AS (SELECT un.v_call, cc.i, cc.a, cc.b FROM un JOIN cc USING (ordinal) WHERE cc.a <> '-')",
        "cov AS (SELECT v_call, i, count(*) AS coverage FROM uc GROUP BY 1, 2)", "rf AS (SELECT DISTINCT concat(v_gene, '*01') AS v_call, v_reference AS parent FROM r)",
        body="SELECT v_call, CAST(i AS INT) AS position, b AS ref, a AS alt, count(*) AS support, any_value(coverage) AS coverage, round(count(*)::DOUBLE / any_value(coverage), 6) AS fraction FROM uc JOIN cov USING (v_call, i) JOIN rf USING (v_call) "
             "WHERE a <> b AND substr(parent, i, 1) = b GROUP BY 1, 2, 3, 4",
    ),
)
def _(spark, d):
    sites = MI.site_support(_units(spark, d), _v_reference(spark, d))
    return _rounded(sites.select("v_call", "position", "ref", "alt", "support", "coverage", "fraction"), "fraction")


@query("missing_alleles")
def _(spark, d):
    _, assigned = _assigned(spark, d)
    found = MI.missing_alleles(table(spark, d).join(assigned, "ordinal"), _v_reference(spark, d))
    return _rounded(found, "allele_fraction", "other_alternate_fraction", "mean_background_shm")


@query("passing_sites")
def _(spark, d):
    events = MI.passing_events(_units(spark, d), _v_reference(spark, d), MI.MissingOptions())
    return _rounded(events.drop("parent"), "fraction")


# --- allele refinement ------------------------------------------------------

# *01 is the reference, *02 and *03 differ from it by one and two bases
_ALLELE_SQL = (
    "al AS (SELECT DISTINCT concat(v_gene, '*01') AS name, v_reference AS sequence FROM r UNION SELECT DISTINCT concat(v_gene, '*02'), concat(substr(v_reference, 1, 39), translate(substr(v_reference, 40, 1), 'ACGT', 'CATG'), substr(v_reference, 41, 200)) FROM r "
    "UNION SELECT DISTINCT concat(v_gene, '*03'), v_donor FROM r WHERE v_donor <> v_reference UNION SELECT DISTINCT concat(v_gene, '*04'), v_reference FROM r)"
)


def _alleles(spark, d) -> DataFrame:
    # written once: four reads of it would derive the repertoire four times, with the filter below inside the derivation
    t = cut(table(spark, d).select("v_gene", "v_reference", "v_donor").distinct())
    one = t.select(F.concat("v_gene", F.lit("*01")).alias("name"), F.col("v_reference").alias("sequence"))
    flipped = F.concat(F.substring("v_reference", 1, 39), F.translate(F.substring("v_reference", 40, 1), "ACGT", "CATG"), F.substring("v_reference", 41, 200))
    two = t.select(F.concat("v_gene", F.lit("*02")).alias("name"), flipped.alias("sequence"))
    three = t.filter("v_donor <> v_reference").select(F.concat("v_gene", F.lit("*03")).alias("name"), F.col("v_donor").alias("sequence"))
    four = t.select(F.concat("v_gene", F.lit("*04")).alias("name"), F.col("v_reference").alias("sequence"))
    return one.unionByName(two).unionByName(three).unionByName(four).distinct()


_NODE_SQL = "nodes AS (SELECT substr(name, 1, 3) AS locus, sequence, list_sort(list_distinct(list(name))) AS names FROM al GROUP BY 1, 2)"


@query("allele_nodes", with_steps(_ALLELE_SQL, _NODE_SQL, body="SELECT names[1] AS node, locus, array_to_string(names, ',') AS names FROM nodes"))
def _(spark, d):
    return RE.allele_nodes(_alleles(spark, d)).select("node", "locus", F.array_join("names", ",").alias("names"))


_EDGE_SQL = "edges AS (SELECT a.names[1] AS node, b.names[1] AS neighbour, CAST(hamming(a.sequence, b.sequence) AS INT) AS distance FROM nodes a JOIN nodes b ON a.locus = b.locus AND a.sequence <> b.sequence AND length(a.sequence) = length(b.sequence) WHERE hamming(a.sequence, b.sequence) <= 2)"


@query("allele_graph_edges", with_steps(_ALLELE_SQL, _NODE_SQL, _EDGE_SQL, body="SELECT node, neighbour, distance FROM edges"))
def _(spark, d):
    return RE.allele_edges(RE.allele_nodes(_alleles(spark, d)), 2).select("node", "neighbour", "distance")


_EVIDENCE_SQL = (
    _ALLELE_SQL, _NODE_SQL, _EDGE_SQL,
    "nm AS (SELECT names[1] AS node, unnest(names) AS call FROM nodes)",
    "alt AS (SELECT ordinal, v_score, string_split(e, '|') AS p, k FROM (SELECT ordinal, v_score, unnest(string_split(v_alternatives, ';')) AS e, unnest(range(1, len(string_split(v_alternatives, ';')) + 1)) AS k FROM r WHERE v_alternatives <> ''))",
    # an empty score field reads as zero
    "lst AS (SELECT ordinal, unnest(list_distinct(string_split(v_call, ','))) AS call, 1.0::DOUBLE AS weight, 0 AS k FROM r WHERE v_call <> '' "
    "UNION ALL SELECT ordinal, p[1], least(1.0, exp((coalesce(try_cast(nullif(p[2], '') AS DOUBLE), 0.0) - v_score) / 2.0)), k FROM alt)",
    "dir AS (SELECT ordinal, node, arg_min(weight, k) AS weight FROM lst JOIN nm USING (call) GROUP BY 1, 2)",
    # read mutation: the best of the reported and the alternatives' identities
    "bi AS (SELECT ordinal, max(try_cast(nullif(p[3], '') AS DOUBLE)) AS x FROM alt GROUP BY 1)",
    "od AS (SELECT ordinal, least(0.25, 0.01 + mu / (3 * (1 - mu))) AS odds FROM (SELECT r.ordinal, least(0.3, coalesce(greatest(0.0, 1 - coalesce(greatest(v_identity, x), v_identity, x)), 0)) AS mu FROM r LEFT JOIN bi ON bi.ordinal = r.ordinal))",
    "sp AS (SELECT ordinal, node, max(weight) AS weight FROM (SELECT * FROM dir UNION ALL SELECT ordinal, neighbour, weight * pow(odds, distance) FROM dir JOIN edges USING (node) JOIN od USING (ordinal)) GROUP BY 1, 2)",
)


@query(
    "evidence_rows",
    with_steps(
        *_EVIDENCE_SQL,
        body="SELECT ordinal, node, round(weight / sum(weight) OVER (PARTITION BY ordinal), 6) AS weight FROM sp WHERE weight > 0",
    ),
)
def _(spark, d):
    options = RE.RefinementOptions()
    nodes = cut(RE.allele_nodes(_alleles(spark, d)))
    rows = RE.evidence(RE.refinement_rows(table(spark, d), options), nodes, cut(RE.allele_edges(nodes, 2)), options)
    return _rounded(rows.select("ordinal", F.explode("entries").alias("e")).select("ordinal", "e.node", "e.weight"), "weight")


def _sql_digamma(x: str) -> str:
    below = " + ".join(f"1.0 / ({x} + {i})" for i in range(8))
    series = " - ".join([f"0.5 / ({x} + 8)", f"1.0 / (12 * pow({x} + 8, 2))"])
    return f"(ln({x} + 8) - {series} + 1.0 / (120 * pow({x} + 8, 4)) - 1.0 / (252 * pow({x} + 8, 6)) + 1.0 / (240 * pow({x} + 8, 8)) - ({below}))"


#: Plain updates of all pools until each changes by a billionth at most, reads of equal evidence together.
_FIT_SQL = (
    *_EVIDENCE_SQL,
    "e AS (SELECT ordinal, node, weight / sum(weight) OVER (PARTITION BY ordinal) AS weight FROM sp WHERE weight > 0)",
    "po AS (SELECT ordinal, concat(subject_id, chr(9), locus) AS pool, v_call FROM r)",
    "ky AS (SELECT ordinal, string_agg(node || printf(':%.6f', ln(weight)), ',' ORDER BY node) AS key FROM e GROUP BY 1)",
    "pt AS (SELECT pool, min(ordinal) AS lead, count(*) AS n FROM ky JOIN po USING (ordinal) GROUP BY pool, key)",
    "pe AS (SELECT pool, lead, n, node, weight FROM pt JOIN e ON e.ordinal = lead)",
    "st AS (SELECT pool, node, sum(n * weight) AS local FROM pe GROUP BY 1, 2)",
    "si AS (SELECT pool, any_value(coalesce(d.k, 0)) AS known, greatest(0, any_value(coalesce(d.k, 0)) - count(*)) AS silent FROM st LEFT JOIN (SELECT locus, count(*) AS k FROM nodes GROUP BY 1) d ON d.locus = string_split(pool, chr(9))[2] GROUP BY pool)",
    "fit AS (SELECT pool, node, local + 0.1 AS gamma, 0 AS step, 1.0::DOUBLE AS change FROM st UNION ALL "
    "SELECT pool, node, next, step + 1, max(abs(next - gamma) / greatest(1, gamma)) OVER (PARTITION BY pool) FROM ("
    "SELECT pool, node, any_value(gamma) AS gamma, any_value(step) AS step, 0.1 + sum(n * y / z) AS next FROM ("
    "SELECT pe.pool, pe.node, n, gamma, step, weight * exp(el) AS y, sum(weight * exp(el)) OVER (PARTITION BY pe.pool, lead) AS z FROM pe JOIN ("
    f"SELECT pool, node, gamma, step, {_sql_digamma('gamma')} - {_sql_digamma('mass')} AS el FROM ("
    "SELECT f.pool, node, gamma, step, sum(gamma) OVER (PARTITION BY f.pool) + 0.1 * silent AS mass FROM fit f JOIN si USING (pool) WHERE change > 1e-9 AND step < 20000)"
    ") g ON g.pool = pe.pool AND g.node = pe.node) GROUP BY 1, 2))",
    "fin AS (SELECT pool, node, gamma, sum(gamma) OVER (PARTITION BY pool) + 0.1 * silent AS mass FROM (SELECT * FROM fit QUALIFY step = max(step) OVER (PARTITION BY pool)) JOIN si USING (pool))",
    f"ex AS (SELECT *, {_sql_digamma('gamma')} - {_sql_digamma('mass')} AS el FROM fin)",
    "ps AS (SELECT ordinal, pool, node, e.weight AS local, e.weight * exp(el) / sum(e.weight * exp(el)) OVER (PARTITION BY ordinal) AS p FROM e JOIN po USING (ordinal) JOIN ex USING (pool, node))",
    "mp AS (SELECT ordinal, pool, arg_min(node, (-round(p, 9), node)) AS map_node, max(p) AS map_probability, arg_min(node, (-round(local, 9), node)) AS local_top, max(local) AS local_probability, sum(-p * ln(p)) AS entropy FROM ps GROUP BY 1, 2)",
)


def _fitted(spark, d, model: str = "dirichlet"):
    return RE.refine(table(spark, d), _alleles(spark, d), RE.RefinementOptions(model=model, tolerance=1e-9))


@query("refine_calls", with_steps(*_FIT_SQL, body="SELECT ordinal, map_node, round(map_probability, 4) AS map_probability, round(entropy, 4) AS entropy, local_top, round(local_probability, 4) AS local_probability, true AS converged FROM mp"))
def _(spark, d):
    refined = _fitted(spark, d).calls
    return _rounded(refined.select("ordinal", "map_node", "map_probability", "entropy", "local_top", "local_probability", "converged"), "map_probability", "entropy", "local_probability", digits=4)


@query(
    "refine_pools",
    with_steps(
        *_FIT_SQL, "nr AS (SELECT pool, sum(n) AS n_rows FROM pt GROUP BY 1)",
        body="SELECT pool, node, array_to_string(names, ',') AS labels, round(gamma / mass, 5) AS posterior_mean, round(sqrt(gamma * (mass - gamma) / (mass * mass * (mass + 1))), 5) AS posterior_sd, "
        "round(gamma - 0.1, 3) AS expected_assignments, round(local, 3) AS local_evidence, CAST(n_rows AS BIGINT) AS n_rows, CAST(known AS INT) AS database_nodes, CAST(silent AS INT) AS silent_nodes, "
        "CAST(row_number() OVER (PARTITION BY pool ORDER BY round(gamma / mass, 9) DESC, array_to_string(names, ',')) AS INT) AS rank FROM fin JOIN st USING (pool, node) JOIN si USING (pool) JOIN nr USING (pool) JOIN nodes ON names[1] = node",
    ),
)
def _(spark, d):
    found = RE.pool_summary(_fitted(spark, d)).select(
        "pool", "node", "labels", "posterior_mean", "posterior_sd", "expected_assignments", "local_evidence", "n_rows", "database_nodes", F.col("silent_nodes").cast("int").alias("silent_nodes"), "rank"
    )
    return _rounded(_rounded(found, "posterior_mean", "posterior_sd", digits=5), "expected_assignments", "local_evidence", digits=3)


@query(
    "refine_posteriors",
    with_steps(
        *_FIT_SQL,
        "sr AS (SELECT ordinal, node, min(kind) AS kind FROM (SELECT ordinal, unnest(string_split(v_call, ',')) AS call, 0 AS kind FROM r WHERE v_call <> '' UNION ALL SELECT ordinal, p[1], 1 FROM alt) JOIN nm USING (call) GROUP BY 1, 2)",
        body="SELECT ordinal, node, array_to_string(names, ',') AS candidate_call, CASE kind WHEN 0 THEN 'reported' WHEN 1 THEN 'retained_alternative' ELSE 'reference_neighbour' END AS source, round(local, 4) AS local_evidence, round(p, 4) AS repertoire_posterior, "
        "round(gamma / mass, 4) AS pool_posterior_mean, node = map_node AS is_map, node = map_node AND map_probability >= 0.8 AS selected FROM ps JOIN fin USING (pool, node) JOIN mp USING (ordinal, pool) LEFT JOIN sr USING (ordinal, node) JOIN nodes ON names[1] = node",
    ),
)
def _(spark, d):
    rows = RE.posterior_rows(table(spark, d), _fitted(spark, d))
    return _rounded(rows.select("ordinal", "node", "candidate_call", "source", "local_evidence", "repertoire_posterior", "pool_posterior_mean", "is_map", "selected"), "local_evidence", "repertoire_posterior", "pool_posterior_mean", digits=4)


@query(
    "refine_shift",
    with_steps(
        *_FIT_SQL,
        body="SELECT pool, node, sum(b) AS before, sum(a) AS after, sum(a) - sum(b) AS delta, sum(b) > 0 AND sum(a) = 0 AS vanishes, sum(b) = 0 AND sum(a) > 0 AS appears FROM ("
        "SELECT pool, local_top AS node, 1.0::DOUBLE AS b, 0.0::DOUBLE AS a FROM mp UNION ALL SELECT pool, CASE WHEN map_probability >= 0.8 THEN map_node ELSE local_top END, 0.0, 1.0 FROM mp) GROUP BY 1, 2",
    ),
)
def _(spark, d):
    return RE.assignment_shift(_fitted(spark, d).calls)


@query(
    "refine_surviving",
    with_steps(
        *_FIT_SQL,
        body="SELECT unnest(names) AS name, sequence FROM nodes JOIN (SELECT CASE WHEN map_probability >= 0.8 THEN map_node ELSE local_top END AS node FROM mp GROUP BY 1) ON names[1] = node",
    ),
)
def _(spark, d):
    fit = _fitted(spark, d)
    return RE.surviving_reference(RE.assignment_shift(fit.calls), fit.nodes)


@query("refine_active_calls")
def _(spark, d):
    refined = _fitted(spark, d, "active-set").calls
    return _rounded(refined.select("ordinal", "map_node", "map_probability", "entropy", "local_top", "local_probability", "converged"), "map_probability", "entropy", "local_probability", digits=4)


@query("refine_active_pools")
def _(spark, d):
    found = RE.pool_summary(_fitted(spark, d, "active-set"))
    return _rounded(found.select("pool", "node", "labels", "active", "inclusion", "posterior_mean", "expected_assignments", "n_rows", "active_alleles", "rank", "converged"), "inclusion", "posterior_mean", "expected_assignments", digits=4)


# --- sequence functions -----------------------------------------------------


@query("reverse_complement", "SELECT ordinal, translate(reverse(upper(sequence)), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN') AS rc FROM r")
def _(spark, d):
    return table(spark, d).select("ordinal", S.reverse_complement("sequence").alias("rc"))


@query(
    "codon_translate",
    with_steps(
        f"code(codon, aa) AS (VALUES {_CODON_VALUES})", "x AS (SELECT ordinal, unnest(range(0, length(cdr3) // 3)) AS k, cdr3 FROM r WHERE length(cdr3) >= 3)",
        body="SELECT ordinal, string_agg(coalesce(aa, 'X'), '' ORDER BY k) AS aa FROM x LEFT JOIN code ON codon = substr(cdr3, 3 * k + 1, 3) GROUP BY ordinal",
    ),
)
def _(spark, d):
    return table(spark, d).filter(F.length("cdr3") >= 3).select("ordinal", S.translate_nt("cdr3").alias("aa"))


@query(
    "hotspot_counts",
    "SELECT v_gene, CAST(count(*) AS BIGINT) AS hotspots FROM (SELECT DISTINCT v_gene, v_reference, i FROM r, range(1, 193) t(i)) WHERE "
    "(substr(v_reference, i, 1) = 'C' AND i > 2 AND substr(v_reference, i - 2, 1) IN ('A', 'T') AND substr(v_reference, i - 1, 1) IN ('A', 'G') AND substr(v_reference, i + 1, 1) IN ('C', 'T')) OR "
    "(substr(v_reference, i, 1) = 'G' AND i > 1 AND substr(v_reference, i - 1, 1) IN ('A', 'G') AND substr(v_reference, i + 1, 1) IN ('C', 'T') AND substr(v_reference, i + 2, 1) IN ('A', 'T')) GROUP BY 1",
)
def _(spark, d):
    genes = table(spark, d).select("v_gene", "v_reference").distinct()
    sites = genes.select("v_gene", "v_reference", F.explode(F.sequence(F.lit(1), F.length("v_reference"))).alias("i"))
    return sites.filter(S.hotspot("v_reference", F.col("i"))).groupBy("v_gene").agg(F.count(F.lit(1)).alias("hotspots"))


@query(
    "kmer_seed_votes",
    with_steps(
        "gk AS (SELECT DISTINCT j_gene AS gene, i AS gene_at, substr(j_reference, i, 7) AS gram FROM (SELECT DISTINCT j_gene, j_reference, unnest(range(1, length(j_reference) - 5)) AS i FROM r))",
        f"rk AS (SELECT ordinal, i AS read_at, substr(s, i, 7) AS gram FROM (SELECT ordinal, s, unnest(range(1, length(s) - 5)) AS i FROM (SELECT ordinal, {sql_nt('sequence')} AS s FROM r)))",
        body="SELECT ordinal AS rid, gene, CAST(floor((read_at - gene_at) / 4.0) * 4 AS INT) AS diagonal, count(*) * 4 AS votes FROM rk JOIN gk USING (gram) WHERE NOT contains(gram, 'N') GROUP BY 1, 2, 3",
    ),
)
def _(spark, d):
    t = table(spark, d)
    queries = t.select(F.col("ordinal").alias("rid"), F.lit(False).alias("rev"), F.lit("").alias("want_locus"), S.normalize_nt("sequence").alias("query"))
    genes = t.select(F.col("j_gene").alias("name"), F.lit("").alias("locus"), F.col("j_reference").alias("sequence")).distinct()
    return AN._votes(queries, genes, 7, 4).select("rid", "gene", "diagonal", "votes")


# --- quality ----------------------------------------------------------------

_EE = "round(list_sum(list_transform(range(1, length(quality) + 1), lambda i: pow(10.0, -(ord(substr(quality, i, 1)) - 33) / 10.0))), 6)"


@query("expected_error_filter", f"SELECT ordinal, {_EE} AS expected_errors FROM r WHERE {_EE} <= 15")
def _(spark, d):
    rows = table(spark, d).select("ordinal", F.round(S.expected_errors("quality"), 6).alias("expected_errors"))
    return rows.filter("expected_errors <= 15")


@query(
    "quality_trim",
    with_steps(
        "w AS (SELECT ordinal, e, list_sum(list_transform(range(greatest(1, e - 3), e + 1), lambda i: ord(substr(quality, i, 1)) - 33)) / least(e, 4)::DOUBLE AS mean FROM (SELECT ordinal, quality, unnest(range(1, length(quality) + 1)) AS e FROM r))",
        body="SELECT r.ordinal, CAST(coalesce(t, 0) AS INT) AS trimmed_length FROM r LEFT JOIN (SELECT ordinal, max(e) AS t FROM w WHERE mean >= 30 GROUP BY 1) x ON x.ordinal = r.ordinal",
    ),
)
def _(spark, d):
    options = QU.QualityOptions(max_expected_errors=20.0, window=4, min_mean_phred=30.0)
    return QU.judged_reads(table(spark, d).select("ordinal", "sequence", "quality"), options).select("ordinal", "trimmed_length")


@query(
    "quality_statistics",
    with_steps(
        "w AS (SELECT ordinal, e, list_sum(list_transform(range(greatest(1, e - 3), e + 1), lambda i: ord(substr(quality, i, 1)) - 33)) / least(e, 4)::DOUBLE AS mean FROM (SELECT ordinal, quality, unnest(range(1, length(quality) + 1)) AS e FROM r))",
        "tl AS (SELECT r.ordinal, quality, coalesce(t, 0) AS t FROM r LEFT JOIN (SELECT ordinal, max(e) AS t FROM w WHERE mean >= 25 GROUP BY 1) x ON x.ordinal = r.ordinal)",
        "oc AS (SELECT *, length(quality) - t AS removed, t >= 60 AS long, coalesce(list_sum(list_transform(range(1, t + 1), lambda i: pow(10, (33 - ord(substr(quality, i, 1))) / 10.0))), 0) <= 15 AS good FROM tl)",
        body="SELECT count(*) AS evaluated, count(*) FILTER (long AND good) AS retained, count(*) FILTER (NOT long) AS rejected_length, count(*) FILTER (long AND NOT good) AS rejected_errors, "
             "count(*) FILTER (long AND good AND removed > 0) AS trimmed_reads, CAST(coalesce(sum(removed) FILTER (long AND good), 0) AS BIGINT) AS trimmed_bases FROM oc",
    ),
)
def _(spark, d):
    options = QU.QualityOptions(max_expected_errors=15.0, window=4, min_mean_phred=25.0, min_length=60)
    return QU.quality_statistics(QU.judged_reads(table(spark, d).select("ordinal", "sequence", "quality"), options))


@query("subsample", "SELECT ordinal, sequence_id FROM r ORDER BY md5(concat('7', chr(9), CAST(ordinal AS VARCHAR))), ordinal LIMIT 500")
def _(spark, d):
    return QU.subsample(table(spark, d).select("ordinal", "sequence_id"), 500, seed=7)


# --- lineage consensus ------------------------------------------------------


_CONSENSUS_STEPS = (
    *LINEAGE_STEPS,
    "an AS (SELECT lineage_id, sequence_alignment AS q, germline_alignment AS g FROM asg JOIN r USING (ordinal))",
    "cv AS (SELECT lineage_id, i, CASE WHEN i <= length(q) THEN substr(q, i, 1) ELSE '-' END AS a, CASE WHEN i <= length(g) THEN substr(g, i, 1) ELSE '-' END AS b FROM (SELECT lineage_id, q, g, unnest(range(1, greatest(length(q), length(g)) + 1)) AS i FROM an))",
    "vt AS (SELECT lineage_id, i, count(*) FILTER (a <> '-' OR b <> '-') AS coverage, list_transform(['A', 'C', 'G', 'T'], lambda x: len(list_filter(list(b), lambda y: y = x))) AS gv, list_transform(['A', 'C', 'G', 'T'], lambda x: len(list_filter(list(a), lambda y: y = x))) AS qv FROM cv GROUP BY 1, 2)",
    "pl AS (SELECT *, list_max(gv) AS gt, list_sum(gv) AS gs, list_max(qv) AS qt, list_sum(qv) AS qs, len(list_filter(gv, lambda x: x = list_max(gv))) AS gl, len(list_filter(qv, lambda x: x = list_max(qv))) AS ql FROM vt)",
    "mb AS (SELECT lineage_id, count(*) AS members FROM an GROUP BY 1)",
    "cc AS (SELECT lineage_id, CAST(i AS INT) AS \"column\", coverage, members, CAST(gs > 0 AND NOT (gt > 0 AND gl = 1 AND gt / gs::DOUBLE >= 0.8) AS BOOLEAN) AS conflict, coverage >= greatest(1, ceil(members * 0.2)) AS supported, CASE WHEN gt > 0 AND gl = 1 AND gt / gs::DOUBLE >= 0.8 THEN ['A', 'C', 'G', 'T'][list_position(gv, gt)] WHEN coverage > 0 THEN 'N' ELSE '-' END AS template, "
    "CASE WHEN gt > 0 AND gl = 1 AND gt / gs::DOUBLE >= 0.8 THEN ['A', 'C', 'G', 'T'][list_position(gv, gt)] WHEN qt > 0 AND ql = 1 AND qt / qs::DOUBLE >= 0.6 THEN ['A', 'C', 'G', 'T'][list_position(qv, qt)] WHEN coverage > 0 THEN 'N' ELSE '-' END AS uca FROM pl JOIN mb USING (lineage_id))",
)


@query("consensus_columns", with_steps(*_CONSENSUS_STEPS, body="SELECT * FROM cc"))
def _(spark, d):
    _, assigned = _assigned(spark, d)
    anchored = CS.anchored_rows(table(spark, d).join(assigned, "ordinal"))
    return CS.consensus_columns(anchored)


@query("closest_germline")
def _(spark, d):
    _, assigned = _assigned(spark, d)
    return CS.closest_germline(table(spark, d).join(assigned, "ordinal")).select("lineage_id", "ordinal", "template", "uca")


@query(
    "consensus_germline",
    with_steps(
        *_CONSENSUS_STEPS,
        "ends AS (SELECT lineage_id, min(\"column\") FILTER (supported) AS s, max(\"column\") FILTER (supported) AS e FROM cc GROUP BY 1)",
        body="SELECT lineage_id, any_value(members) AS rows_used, any_value(s) AS start_column, any_value(e) AS end_column, count(*) FILTER (conflict) AS conflicting_columns, "
             "string_agg(template, '' ORDER BY \"column\") AS template, string_agg(uca, '' ORDER BY \"column\") AS uca, coalesce(string_agg(uca, '' ORDER BY \"column\") FILTER (\"column\" BETWEEN s AND e), '') AS trimmed_uca "
             "FROM cc JOIN ends USING (lineage_id) GROUP BY lineage_id",
    ),
)
def _(spark, d):
    _, assigned = _assigned(spark, d)
    return CS.consensus_germline(CS.anchored_rows(table(spark, d).join(assigned, "ordinal")))


@query("germline_neighbours")
def _(spark, d):
    """The stated source set: lineages with a read whose id is divisible by 100."""
    _, assigned = _assigned(spark, d)
    t = table(spark, d).join(assigned, "ordinal").withColumn("study_group", ST.scope_value("subject"))
    index = CS.germline_sketches(t)
    chosen = assigned.filter("ordinal % 100 = 0").select("lineage_id").distinct()
    probe = index.join(chosen, "lineage_id", "left_semi").select(F.col("lineage_id").alias("source_lineage_id"), "locus", "study_group", "sketch", F.col("proxy").alias("source_proxy"))
    found = CS.screen_germlines(index, probe.drop("source_proxy"))
    pairs = found.join(probe.select("source_lineage_id", "source_proxy"), "source_lineage_id").join(index.select("lineage_id", "proxy"), "lineage_id")
    scored = pairs.withColumn("germline_identity", CS.germline_identity("source_proxy", "proxy"))
    return _rounded(scored.select("source_lineage_id", "lineage_id", "similarity", "germline_identity"), "similarity", "germline_identity")


@query(
    "region_labels",
    with_steps(
        *LINEAGE_STEPS, "an AS (SELECT lineage_id, r.* FROM asg JOIN r USING (ordinal))",
        "cv AS (SELECT lineage_id, i, substr(sequence_alignment, i, 1) AS a, length(replace(substr(sequence_alignment, 1, i), '-', '')) AS p, * EXCLUDE (lineage_id) FROM (SELECT *, unnest(range(1, length(sequence_alignment) + 1)) AS i FROM an))",
        "lb2 AS (SELECT lineage_id, i, CASE WHEN p BETWEEN 1 AND 60 THEN 'fwr1' WHEN p BETWEEN 61 AND 84 THEN 'cdr1' WHEN p BETWEEN 85 AND 120 THEN 'fwr2' WHEN p BETWEEN 121 AND 144 THEN 'cdr2' WHEN p BETWEEN 145 AND 192 THEN 'fwr3' END AS region, count(*) AS n FROM cv WHERE a <> '-' GROUP BY 1, 2, 3)",
        body="SELECT lineage_id, CAST(i AS INT) AS \"column\", region FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id, i ORDER BY n DESC, region) AS rn FROM lb2 WHERE region IS NOT NULL) WHERE rn = 1",
    ),
)
def _(spark, d):
    _, assigned = _assigned(spark, d)
    return CS.region_labels(CS.anchored_rows(table(spark, d).join(assigned, "ordinal")))


# --- second D ---------------------------------------------------------------


@query("double_d_pairs", "SELECT d_call, d2_call, count(*) AS records FROM r WHERE d2_call <> '' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 12")
def _(spark, d):
    return DD.pair_counts(table(spark, d).select("ordinal", "d_call", "d2_call"))


@query("double_d_sidecar", "SELECT ordinal, CASE WHEN d2_call <> '' THEN 'X' || d_call ELSE d_call END AS d_call, CASE WHEN d2_call <> '' THEN CAST(length(cdr3) AS INT) END AS vj_span FROM r")
def _(spark, d):
    t = table(spark, d)
    side = t.filter("d2_call <> ''").select("ordinal", F.concat(F.lit("X"), "d_call").alias("d_call"), F.length("cdr3").alias("vj_span"))
    return DD.merge_sidecar(t.select("ordinal", "d_call"), side)


@query("double_d_screen")
def _(spark, d):
    """Windows are the CDR3s; the D genes are two stretches of every rearrangement's own germline."""
    t = table(spark, d)
    windows = t.filter("cdr3 <> ''").select("ordinal", F.lit("IGH").alias("locus"), F.col("cdr3").alias("window"))
    seeds = t.filter("cdr3 <> ''").select(F.col("cdr3").alias("s")).distinct()
    genes = cut(seeds.select(F.explode(F.array(F.substring("s", 2, 11), F.substring("s", 14, 11))).alias("sequence")).distinct().select(
        F.concat(F.lit("IGHD"), F.substring(F.md5("sequence"), 1, 12)).alias("name"), F.lit("IGH").alias("locus"), "sequence"
    ))
    return DD.screen_double_d(windows, genes, DD.DoubleDOptions(seed=9, min_gain=6))


# --- denoising, chimeras, annotation ----------------------------------------

for _mode in ("conservative", "indel", "abundance"):

    def _denoise(spark, d, mode=_mode):
        return DN.denoise(base(spark, d), DN.DenoiseOptions(mode=mode, scope="subject", respect_constant=False))[0]

    query(f"denoise_{_mode}")(_denoise)


@query("chimera_scores")
def _(spark, d):
    """Every V reference is a panel row; reads come from one of them."""
    t = table(spark, d)
    return _rounded(CH.score_chimeras(t, _v_reference(spark, d)).select("ordinal", "status", "dfr", "probability"), "probability", digits=4)


@query(
    "distance_from_reference",
    "SELECT ordinal, CAST(list_sum(list_transform(range(1, length(v_sequence_alignment) + 1), lambda i: CASE WHEN substr(v_sequence_alignment, i, 1) <> substr(v_germline_alignment, i, 1) THEN 1 ELSE 0 END)) AS INT) AS dfr FROM r",
)
def _(spark, d):
    return table(spark, d).select("ordinal", CH.distance_from_reference("v_sequence_alignment", "v_germline_alignment").alias("dfr"))


def _germlines(spark, d) -> DataFrame:
    t = table(spark, d)
    v = t.select(F.lit("V").alias("segment"), F.concat("v_gene", F.lit("*01")).alias("name"), F.col("chain").alias("locus"), F.col("v_reference").alias("sequence"))
    j = t.select(F.lit("J").alias("segment"), F.concat("j_gene", F.lit("*01")).alias("name"), F.col("chain").alias("locus"), F.col("j_reference").alias("sequence"))
    nothing = {c: F.lit(-1) for c in ("frame", "cdr3_stop", "fwr3_end")}
    return v.unionByName(j).distinct().withColumns(nothing)


@query("annotate_reads")
def _(spark, d):
    """Reads of every donor, half of them reverse-complemented, assigned from sequence alone."""
    t = table(spark, d)
    turned = F.when(F.col("rev_comp") == "T", S.reverse_complement("sequence")).otherwise(F.col("sequence"))
    reads = t.select("ordinal", turned.alias("sequence"))
    out = AN.annotate(reads, _germlines(spark, d), AN.AnnotateOptions(min_j=10))
    return out.select("ordinal", "rev_comp", "locus", "v_call", "j_call", "v_score", "j_score", "np1")


# --- references and exports -------------------------------------------------


@query("reference_anti_join", with_steps(_ALLELE_SQL, body="SELECT name, sequence FROM al WHERE name NOT IN (SELECT DISTINCT string_split(v_call, ',')[1] FROM r)"))
def _(spark, d):
    used = table(spark, d).select(S.top_call("v_call").alias("name"))
    return RF.exclude_alleles(_alleles(spark, d), used)[0]


@query(
    "nearest_templates",
    with_steps(
        _ALLELE_SQL, "lo AS (SELECT name, sequence, regexp_extract(upper(name), '^(IGH|IGK|IGL|TRA|TRB|TRD|TRG)', 1) AS locus FROM al)",
        "gm AS (SELECT DISTINCT name, locus, substr(sequence, i, 9) AS gram FROM (SELECT name, locus, sequence, unnest(range(1, length(sequence) - 7)) AS i FROM lo))",
        "sz AS (SELECT name, count(*) AS n FROM gm GROUP BY 1)",
        "sh AS (SELECT a.name AS target, b.name AS template, count(*) AS shared FROM gm a JOIN gm b USING (locus, gram) GROUP BY 1, 2)",
        "jc AS (SELECT target, template, shared::DOUBLE / (x.n + y.n - shared) AS jaccard FROM sh JOIN sz x ON x.name = target JOIN sz y ON y.name = template)",
        body="SELECT target, CAST(rn - 1 AS INT) AS rank, template, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY jaccard DESC, template) AS rn FROM jc) WHERE rn <= 5",
    ),
)
def _(spark, d):
    alleles = _alleles(spark, d).withColumn("locus", S.infer_locus("name"))
    return _rounded(RF.nearest_templates(alleles, alleles, keep=5), "jaccard")


@query("export_collapsed", with_steps(STEP_REC, body="SELECT min(ordinal) AS ordinal, CAST(sum(weight) AS BIGINT) AS duplicate_count FROM rec WHERE trimmed_nt <> '' GROUP BY sample_id, c_part, trimmed_nt"))
def _(spark, d):
    t = table(spark, d)
    return WR.collapsed_export(t.select("ordinal", "sequence_id", "duplicate_count"), CO.collapse(records(t))).select("ordinal", "duplicate_count")


@query("export_lineage", with_steps(*LINEAGE_STEPS, body="SELECT r.ordinal, sequence_id, lineage_id AS clone_id FROM r LEFT JOIN asg ON asg.ordinal = r.ordinal"))
def _(spark, d):
    _, assigned = _assigned(spark, d)
    return WR.lineage_export(table(spark, d).select("ordinal", "sequence_id"), assigned).select("ordinal", "sequence_id", "clone_id")


@query(
    "components_of_customers",
    # smallest ids spread over the links of a day until nothing changes
    "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 2 AS x, o_orderdate::DATE::VARCHAR AS day FROM orders), m AS (SELECT day, min(x) AS y FROM e GROUP BY day), "
    "p AS (SELECT DISTINCT e.x AS x, m.y AS y FROM e JOIN m USING (day) WHERE e.x <> m.y), b AS (SELECT x, y FROM p UNION SELECT y, x FROM p), "
    "reach(x, c) AS (SELECT DISTINCT x, x FROM e UNION SELECT b.y, min(r.c) FROM reach r JOIN b ON b.x = r.x WHERE r.c < b.y GROUP BY b.y) SELECT x AS id, min(c) AS component FROM reach GROUP BY 1",
)
def _(spark, d):
    ship_package(spark)
    rows = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") * 2).alias("id"), F.to_date("o_orderdate").alias("day")).distinct()
    first = rows.groupBy("day").agg(F.min("id").alias("left_id"))
    edges = rows.join(first, "day").select("left_id", F.col("id").alias("right_id"))
    return connected_components(rows.select("id").distinct(), edges)


# --- aligned coordinates ----------------------------------------------------

_CODE_SQL = f"code(codon, aa) AS (VALUES {_CODON_VALUES})"


def _sql_codons(source: str, key: str, sequence: str, first: str, cell: str, partial: bool = False) -> str:
    """One row per ``key`` with the residues ``aa`` of ``sequence`` from 0-based place ``first`` on; ``cell`` reads the codon ``c``."""
    count = f"(length({sequence}) - {first} + {2 if partial else 0}) // 3"
    return (
        f"SELECT {key}, coalesce(string_agg({cell}, '' ORDER BY n) FILTER (WHERE n IS NOT NULL), '') AS aa FROM ("
        f"SELECT {key}, n, substr({sequence}, {first} + 3 * n + 1, 3) AS c FROM {source} LEFT JOIN (SELECT unnest(range(0, 400)) AS n) ON n < {count}) LEFT JOIN code ON codon = c GROUP BY {key}"
    )


@query(
    "project_codons",
    with_steps(
        _CODE_SQL, "cl AS (SELECT ordinal, ordinal % 3 AS o, replace(v_sequence_alignment, '-', '') AS clean FROM r)",
        f"tr AS ({_sql_codons('cl', 'ordinal', 'clean', 'o', 'coalesce(aa, chr(88))')})",
        "al2 AS (SELECT ordinal, o, clean, concat(substr(aa, 1, ordinal % 5), '-', substr(aa, ordinal % 5 + 1, 40), '--', substr(aa, ordinal % 5 + 41, 60)) AS res FROM cl JOIN tr USING (ordinal))",
        "pc AS (SELECT ordinal, string_agg(CASE WHEN substr(res, i, 1) = '-' THEN '---' ELSE rpad(substr(clean, o + 3 * length(replace(substr(res, 1, i), '-', '')) - 2, 3), 3, '-') END, '' ORDER BY i) AS mid FROM (SELECT *, unnest(range(1, length(res) + 1)) AS i FROM al2) GROUP BY 1)",
        "sf AS (SELECT ordinal, res, mid, CASE WHEN o = 0 THEN '' ELSE rpad(substr(clean, 1, o), 3, '-') END AS pre, substr(clean, o + 3 * length(replace(res, '-', '')) + 1, 400) AS suf FROM al2 JOIN pc USING (ordinal))",
        body="SELECT ordinal, res AS residues, concat(pre, mid, CASE WHEN suf = '' THEN '' WHEN length(suf) < 3 THEN rpad(suf, 3, '-') ELSE suf END) AS codons FROM sf",
    ),
)
def _(spark, d):
    frame, cut_at = F.col("ordinal") % 3, (F.col("ordinal") % 5).cast("int")
    aa = CD.translate_ungapped("v_sequence_alignment", frame)
    gapped = F.concat(F.substring(aa, F.lit(1), cut_at), F.lit("-"), F.substring(aa, cut_at + 1, F.lit(40)), F.lit("--"), F.substring(aa, cut_at + 41, F.lit(60)))
    rows = table(spark, d).select("ordinal", "v_sequence_alignment", gapped.alias("residues"))
    return rows.select("ordinal", "residues", CD.project_codons("v_sequence_alignment", "residues", F.col("ordinal") % 3).alias("codons"))


@query(
    "segment_residues",
    with_steps(
        _CODE_SQL, "fr AS (SELECT ordinal, ordinal % 4 AS f, ordinal % 5 AS s, v_sequence_alignment AS q, v_germline_alignment AS g FROM r WHERE ordinal % 4 > 0 AND ordinal % 5 > 0)",
        "sk AS (SELECT *, (f - s + 6) % 3 AS k FROM fr)",
        # column of the k-th base: the only gap is at 150, behind the first codon
        f"qa AS ({_sql_codons('sk', 'ordinal', 'q', 'k', chr(67) + 'ASE WHEN contains(c, chr(45)) THEN chr(45) ELSE coalesce(aa, chr(88)) END')})",
        f"ga AS ({_sql_codons('sk', 'ordinal', 'g', 'k', 'coalesce(aa, chr(88))')})",
        body="SELECT ordinal, CAST(k AS INT) AS skipped, qa.aa AS query, ga.aa AS reference FROM sk JOIN qa USING (ordinal) JOIN ga USING (ordinal)",
    ),
)
def _(spark, d):
    rows = table(spark, d).filter("ordinal % 4 > 0 AND ordinal % 5 > 0").select("ordinal", "v_sequence_alignment", "v_germline_alignment", (F.col("ordinal") % 4).alias("f"), (F.col("ordinal") % 5).alias("s"))
    pair = CD.segment_residues("v_sequence_alignment", "v_germline_alignment", "s", "f")
    return rows.select("ordinal", CD.frame_offset("s", "f").cast("int").alias("skipped"), pair.alias("p")).select("ordinal", "skipped", "p.query", "p.reference")


@query(
    "motif_cells",
    "SELECT ordinal, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN list_contains(m1, i) THEN '1' WHEN list_contains(m2, i) THEN '2' WHEN list_contains(m3, i) THEN '3' ELSE '0' END), '') AS cells FROM ("
    "SELECT ordinal, s, " + ", ".join(
        f"list_transform(flatten(list_transform(list_filter(range(1, length(q) - {size - 2}), lambda p: regexp_full_match(substr(q, p, {size}), '{pattern}')), lambda p: range(p, p + {size}))), lambda x: cols[x]) AS m{k}"
        for k, (pattern, size) in enumerate([("[AT][AG]C[CT]", 4), ("[AG]G[CT][AT]", 4), ("TC[ACGT]", 3)], 1)
    ) + " FROM (SELECT ordinal, v_sequence_alignment AS s, replace(v_sequence_alignment, '-', '') AS q, list_filter(range(1, length(v_sequence_alignment) + 1), lambda i: substr(v_sequence_alignment, i, 1) <> '-') AS cols FROM r))",
)
def _(spark, d):
    cells = CD.motif_cells("v_sequence_alignment", ["WRCY", "RGYW", "TCN"])
    return table(spark, d).select("ordinal", F.array_join(cells.cast("array<string>"), "").alias("cells"))


#: Reads begin one or two bases into a codon, or in phase, by donor and V gene.
_PHASED = "substr(v_sequence_alignment, 1 + (length(v_gene) + ascii(substr(v_gene, 5, 1)) + ascii(substr(subject_id, 7, 1))) % 3, 190)"


@query(
    "reading_frames",
    with_steps(
        _CODE_SQL, f"ph AS (SELECT ordinal, subject_id, v_gene, {_PHASED} AS s FROM r)",
        "co AS (SELECT subject_id, v_gene, f, substr(s, CAST(f + 3 * n + 1 AS INT), 3) AS c FROM ph, (SELECT unnest(range(0, 3)) AS f), (SELECT unnest(range(0, 64)) AS n) WHERE f + 3 * n + 3 <= length(s))",
        "ct AS (SELECT subject_id, v_gene, f, count(*) FILTER (c = '---') AS whole, count(*) FILTER (c <> '---' AND contains(c, '-')) AS mixed, count(*) FILTER (NOT contains(c, '-') AND regexp_matches(c, '[^ACGT]')) AS unclear, count(*) FILTER (aa = '*') AS stops FROM co LEFT JOIN code ON codon = c GROUP BY 1, 2, 3)",
        body="SELECT subject_id, v_gene, CAST(f AS INT) AS frame, mixed AS mixed_gap_codons, stops AS stop_codons, whole AS complete_gap_codons, unclear AS ambiguous_codons FROM ct QUALIFY row_number() OVER (PARTITION BY subject_id, v_gene ORDER BY mixed, stops, whole DESC, unclear, f) = 1",
    ),
)
def _(spark, d):
    rows = table(spark, d).select("subject_id", "v_gene", F.expr(_PHASED).alias("aligned"))
    return AC.reading_frame(rows, ["subject_id", "v_gene"])


@query(
    "framed_residues",
    with_steps(
        _CODE_SQL, f"ph AS (SELECT ordinal, subject_id, v_gene, {_PHASED} AS s FROM r)",
        "co AS (SELECT subject_id, v_gene, f, substr(s, CAST(f + 3 * n + 1 AS INT), 3) AS c FROM ph, (SELECT unnest(range(0, 3)) AS f), (SELECT unnest(range(0, 64)) AS n) WHERE f + 3 * n + 3 <= length(s))",
        "ct AS (SELECT subject_id, v_gene, f, count(*) FILTER (c <> '---' AND contains(c, '-')) AS mixed, count(*) FILTER (aa = '*') AS stops, count(*) FILTER (c = '---') AS whole FROM co LEFT JOIN code ON codon = c GROUP BY 1, 2, 3)",
        "bf AS (SELECT subject_id, v_gene, f FROM ct QUALIFY row_number() OVER (PARTITION BY subject_id, v_gene ORDER BY mixed, stops, whole DESC, f) = 1)",
        "fs AS (SELECT ordinal, s, f FROM ph JOIN bf USING (subject_id, v_gene))",
        f"ra AS ({_sql_codons('fs', 'ordinal', 's', 'f', chr(67) + 'ASE WHEN c = repeat(chr(45), 3) THEN chr(45) ELSE coalesce(aa, chr(88)) END', partial=True)})",
        body="SELECT ordinal, aa AS residues FROM ra",
    ),
)
def _(spark, d):
    rows = table(spark, d).select("ordinal", "subject_id", "v_gene", F.expr(_PHASED).alias("aligned"))
    group = ["subject_id", "v_gene"]
    return AC.translate_alignments(rows, AC.reading_frame(rows, group), group).select("ordinal", "residues")


@query(
    "column_subset",
    with_steps(
        *LINEAGE_STEPS, "an AS (SELECT lineage_id, ordinal, sequence_alignment AS q FROM asg JOIN r USING (ordinal))",
        "cv AS (SELECT lineage_id, i, length(replace(substr(q, 1, i), '-', '')) AS p FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM an) WHERE substr(q, i, 1) <> '-')",
        "lb2 AS (SELECT lineage_id, i, CASE WHEN p BETWEEN 1 AND 60 THEN 'fwr1' WHEN p BETWEEN 61 AND 84 THEN 'cdr1' WHEN p BETWEEN 85 AND 120 THEN 'fwr2' WHEN p BETWEEN 121 AND 144 THEN 'cdr2' WHEN p BETWEEN 145 AND 192 THEN 'fwr3' END AS region, count(*) AS n FROM cv GROUP BY 1, 2, 3)",
        "lbl AS (SELECT lineage_id, i, region FROM lb2 WHERE region IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lineage_id, i ORDER BY n DESC, region) = 1)",
        body="SELECT an.ordinal, coalesce(string_agg(substr(q, i, 1), '' ORDER BY i), '') AS cdrs FROM an LEFT JOIN lbl ON lbl.lineage_id = an.lineage_id AND region LIKE 'cdr%' GROUP BY 1",
    ),
)
def _(spark, d):
    _, assigned = _assigned(spark, d)
    anchored = cut(CS.anchored_rows(table(spark, d).join(assigned, "ordinal")).select(
        "lineage_id", "ordinal", "aligned_read", "v_sequence_start", *[f"{r}_{e}" for r in ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3") for e in ("start", "end")]
    ))
    chosen = AC.preset_columns(CS.region_labels(anchored), "cdrs", ["lineage_id"])
    return AC.take_columns(anchored.select("lineage_id", "ordinal", "aligned_read"), chosen, ["lineage_id"], "aligned_read").select("ordinal", F.col("aligned_read").alias("cdrs"))


@query(
    "column_ranges",
    "SELECT ordinal, concat(substr(v_sequence_alignment, 31, 3), substr(v_sequence_alignment, 40, 1), substr(v_sequence_alignment, 149, 3)) AS columns FROM r",
)
def _(spark, d):
    chosen = AC.parse_columns("31-33, 40;151-149 nonsense 999", maximum=192)
    return AC.take_columns(table(spark, d).select("ordinal", "v_sequence_alignment"), chosen, [], "v_sequence_alignment").select("ordinal", F.col("v_sequence_alignment").alias("columns"))


@query("alignment_retained", "SELECT ordinal, sequence_id, locus FROM r WHERE ordinal % 3 = 0")
def _(spark, d):
    rows = table(spark, d).select("ordinal", "sequence_id", "locus")
    names = rows.select(F.when(F.col("ordinal") % 3 == 0, F.concat("sequence_id", F.lit("__"), F.col("ordinal") + 1)).otherwise(F.concat(F.lit("germline_"), F.col("ordinal"))).alias("name"))
    return AC.retained_rows(names, rows)


@query(
    "probability_masses",
    "SELECT ordinal, list_transform(list_transform([v_score - 180, ordinal % 7 - 3.0, v_identity, 0.0], lambda v: CASE WHEN v > 0 THEN CAST(v AS DOUBLE) ELSE 0.0 END), lambda v: round(v, 3)) AS raw, "
    "list_transform(m, lambda v: round(CASE WHEN list_sum(m) > 0 THEN v / list_sum(m) ELSE 0.25 END, 9)) AS shares FROM (SELECT *, list_transform([v_score - 180, ordinal % 7 - 3.0, v_identity, 0.0], lambda v: CASE WHEN v > 0 THEN CAST(v AS DOUBLE) ELSE 0.0 END) AS m FROM r)",
)
def _(spark, d):
    raw = F.array((F.col("v_score") - 180).cast("double"), (F.col("ordinal") % 7 - 3).cast("double"), F.col("v_identity").cast("double"), F.lit(0.0))
    clean = F.transform(raw, lambda v: F.round(F.when(v > 0, v).otherwise(0.0), 3))
    return table(spark, d).select("ordinal", clean.alias("raw"), F.transform(CD.normalized_masses(raw), lambda v: F.round(v, 9)).alias("shares"))


# --- bounded samples --------------------------------------------------------


@query(
    "lineage_sample_cap",
    with_steps(*LINEAGE_STEPS, body="SELECT ordinal, lineage_id, sample_id FROM (SELECT ordinal, lineage_id, sample_id, row_number() OVER (PARTITION BY lineage_id, sample_id ORDER BY ordinal) AS nth FROM asg JOIN r USING (ordinal)) WHERE nth <= 5"),
)
def _(spark, d):
    rows = _assigned(spark, d)[1].join(table(spark, d).select("ordinal", "sample_id"), "ordinal")
    return SA.capped_sample(rows, 5).select("ordinal", "lineage_id", "sample_id")


@query(
    "lineage_member_sample",
    with_steps(*LINEAGE_STEPS, body="SELECT lineage_id, ordinal, total FROM (SELECT lineage_id, ordinal, count(*) OVER (PARTITION BY lineage_id) AS total, row_number() OVER (PARTITION BY lineage_id ORDER BY md5(concat('1', chr(9), CAST(lineage_id AS VARCHAR), chr(9), CAST(ordinal AS VARCHAR))), ordinal) AS nth FROM asg) WHERE nth <= 20"),
)
def _(spark, d):
    return SA.member_sample(cut(_assigned(spark, d)[1]), 20)


# --- table functions --------------------------------------------------------


@query(
    "kmer_counts",
    "SELECT j_gene, kmer, count(*) AS windows, count(DISTINCT ordinal) AS records, CAST(min(p) AS INT) AS first_position FROM (SELECT j_gene, ordinal, p, substr(cdr3, p, 6) AS kmer FROM (SELECT *, unnest(range(1, length(cdr3) - 4)) AS p FROM r)) GROUP BY 1, 2",
)
def _(spark, d):
    register_tables(spark)
    cut(table(spark, d).select("ordinal", "j_gene", "cdr3")).createOrReplaceTempView("clonespark_reads")
    return spark.sql(
        "SELECT j_gene, kmer, count(*) AS windows, count_if(occurrence = 1) AS records, min(position) AS first_position FROM clonespark_reads, LATERAL kmers(cdr3, 6) GROUP BY j_gene, kmer"
    )


@query(
    "column_mismatches",
    "SELECT v_gene, CAST(i AS INT) AS \"column\", count(*) AS records, count(*) FILTER (a <> '-' AND a <> b) AS mismatches, count(*) FILTER (a = '-') AS gaps, CAST(max(CASE WHEN a <> '-' THEN qp END) AS INT) AS last_position FROM ("
    "SELECT v_gene, i, substr(q, i, 1) AS a, substr(g, i, 1) AS b, length(replace(substr(q, 1, i), '-', '')) AS qp FROM (SELECT v_gene, v_sequence_alignment AS q, v_germline_alignment AS g, unnest(range(1, 193)) AS i FROM r)) GROUP BY 1, 2",
)
def _(spark, d):
    register_tables(spark)
    cut(table(spark, d).select("v_gene", "v_sequence_alignment", "v_germline_alignment")).createOrReplaceTempView("clonespark_pairs")
    return spark.sql(
        "SELECT v_gene, `column`, count(*) AS records, count_if(query <> '-' AND query <> reference) AS mismatches, count_if(query = '-') AS gaps, max(query_position) AS last_position "
        "FROM clonespark_pairs, LATERAL alignment_columns(v_sequence_alignment, v_germline_alignment) GROUP BY v_gene, `column`"
    )


# --- ordered facets ---------------------------------------------------------

_FACET_SQL = "fc AS (SELECT facet, value, count(*) AS records FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS facet, {f} AS value FROM r" for f in ("sample_id", "cohort", "v_call")) + ") WHERE value <> '' GROUP BY 1, 2)"


@query("facet_order", with_steps(_FACET_SQL, body="SELECT facet, value, records, CAST(row_number() OVER (PARTITION BY facet ORDER BY records DESC, value) AS INT) AS rank FROM fc"))
def _(spark, d):
    return FA.ordered_facets(FA.facet_counts(table(spark, d), ("sample_id", "cohort", "v_call")))


@query("facet_leading", with_steps(_FACET_SQL, body="SELECT * FROM (SELECT facet, value, records, CAST(row_number() OVER (PARTITION BY facet ORDER BY records DESC, value) AS INT) AS rank FROM fc) WHERE rank <= 10"))
def _(spark, d):
    """The leading ten values of each facet, as a composition chart shows them."""
    return FA.ordered_facets(FA.facet_counts(table(spark, d), ("sample_id", "cohort", "v_call")), 10)
