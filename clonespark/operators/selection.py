"""Row predicates: the result browser filter and the repertoire selection.

Both are conjunctions of native expressions, so Catalyst prunes columns and pushes
the plain comparisons to the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import IUPAC_CLASSES, calls, gene_of, is_true_word, number, text


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


# --- result browser ---------------------------------------------------------


def call_equals(column: str, query: str, include_ambiguous: bool = False) -> Column:
    """Browser call filter.

    Several calls ask for exactly that set of assignments. One call matches an
    allele or its gene, on ambiguous rows only when asked to.
    """
    wanted = sorted(c.strip().upper() for c in query.split(",") if c.strip())
    if not wanted:
        return F.lit(True)
    observed = F.transform(calls(column), lambda c: F.upper(c))
    if len(wanted) > 1:
        return F.array_sort(observed) == F.array(*[F.lit(w) for w in wanted])
    hit = F.exists(observed, lambda c: (c == wanted[0]) | (gene_of(c) == wanted[0]))
    return hit if include_ambiguous else (F.size(observed) == 1) & hit


@dataclass(frozen=True)
class BrowserFilter:
    sequence_id: str = ""
    cdr3: str = ""
    dataset_id: str = ""
    sample_id: str = ""
    subject_id: str = ""
    cohort: str = ""
    timepoint: str = ""
    compartment: str = ""
    locus: str = ""
    isotype: str = ""
    productive: str = ""
    vj_in_frame: str = ""
    stop_codon: str = ""
    complete_vdj: str = ""
    rev_comp: str = ""
    v_call: str = ""
    v_ambiguous: bool = False
    d_call: str = ""
    d_ambiguous: bool = False
    j_call: str = ""
    j_ambiguous: bool = False
    c_call: str = ""
    c_ambiguous: bool = False
    min_v_identity: float = 0
    min_d_identity: float = 0
    min_j_identity: float = 0
    min_c_identity: float = 0
    min_cdr3_aa_length: int = 0
    max_cdr3_aa_length: int = 0
    has_d: bool = False
    has_double_d: bool = False
    has_cdr3: bool = False


EQUAL_FIELDS = (
    "dataset_id", "sample_id", "subject_id", "cohort", "timepoint", "compartment", "locus", "isotype",
    "productive", "vj_in_frame", "stop_codon", "complete_vdj", "rev_comp",
)


def browser_condition(f: BrowserFilter) -> Column:
    conditions: list[Column] = []
    if f.sequence_id.strip():
        conditions.append(F.lower(text("sequence_id")).contains(f.sequence_id.strip().lower()))
    if f.cdr3.strip():
        wanted = f.cdr3.strip().upper()
        conditions.append(F.upper(text("cdr3")).contains(wanted) | F.upper(text("cdr3_aa")).contains(wanted))
    conditions += [F.col(name) == getattr(f, name) for name in EQUAL_FIELDS if getattr(f, name)]
    for segment in "vdjc":
        conditions.append(call_equals(f"{segment}_call", getattr(f, f"{segment}_call"), getattr(f, f"{segment}_ambiguous")))
        floor = getattr(f, f"min_{segment}_identity")
        if floor:
            conditions.append(F.coalesce(number(f"{segment}_identity"), F.lit(0.0)) >= floor)
    aa = F.length(text("cdr3_aa"))
    if f.min_cdr3_aa_length:
        conditions.append(aa >= f.min_cdr3_aa_length)
    if f.max_cdr3_aa_length:
        # an unknown length counts as unbounded
        conditions.append((aa > 0) & (aa <= f.max_cdr3_aa_length))
    if f.has_d:
        conditions.append(text("d_call") != "")
    if f.has_double_d:
        conditions.append(text("d2_call") != "")
    if f.has_cdr3:
        conditions.append((text("cdr3") != "") | (text("cdr3_aa") != ""))
    return _all(conditions)


def page(table: DataFrame, f: BrowserFilter, offset: int, limit: int) -> DataFrame:
    """One page of matching rows in table order, plus one row that says "has more"."""
    return table.filter(browser_condition(f)).orderBy("ordinal").offset(offset).limit(limit + 1)


# --- repertoire selection ---------------------------------------------------


def _tokens(value: str) -> list[str]:
    return [t.strip() for t in re.split(r"[\n,;]+", value) if t.strip()]


def call_contains(column: Column | str, query: str, include_ambiguous: bool = False) -> Column:
    """Selection call filter: equal to, gene of, or contained in any assignment."""
    wanted = [t.upper() for t in _tokens(query)]
    if not wanted:
        return F.lit(True)
    observed = F.transform(calls(column), lambda c: F.upper(c))

    def one(c: Column) -> Column:
        # containment covers equality and the gene of an allele
        hits = [c.contains(w) for w in wanted]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    hit = F.exists(observed, one)
    return hit if include_ambiguous else (F.size(observed) <= 1) & hit


def facet_contains(column: Column | str, query: str) -> Column:
    wanted = [t.upper() for t in _tokens(query)]
    if not wanted:
        return F.lit(True)
    observed = F.upper(text(column))
    out = F.lit(False)
    for w in wanted:
        out = out | observed.contains(w)
    return out


def tri_state(column: str, wanted: str) -> Column:
    if wanted == "any":
        return F.lit(True)
    return is_true_word(column) == F.lit(wanted == "yes")


def motif_patterns(motif: str, syntax: str) -> list[str]:
    """Case-insensitive Java patterns for substring, IUPAC or regex motifs."""
    out = []
    for token in _tokens(motif):
        if syntax == "regex":
            body = token
        elif syntax == "iupac":
            body = "".join(IUPAC_CLASSES.get(s) or re.escape(s) for s in token.upper())
        elif syntax == "substring":
            body = re.escape(token)
        else:
            raise ValueError("motif syntax must be substring, iupac or regex")
        out.append(f"(?i){body}")
    return out


@dataclass(frozen=True)
class Selection:
    sequence_id: str = ""
    dataset_id: str = ""
    sample_id: str = ""
    subject_id: str = ""
    cohort: str = ""
    timepoint: str = ""
    compartment: str = ""
    locus: str = ""
    isotype: str = ""
    v_call: str = ""
    v_ambiguous: bool = False
    d1_call: str = ""
    d1_ambiguous: bool = False
    d2_call: str = ""
    j_call: str = ""
    j_ambiguous: bool = False
    c_call: str = ""
    c_ambiguous: bool = False
    cdr3_nt: str = ""
    cdr3_aa: str = ""
    motif: str = ""
    motif_target: str = "cdr3_aa"
    motif_syntax: str = "substring"
    motif_mode: str = "any"
    productive: str = "any"
    complete_vdj: str = "any"
    vj_in_frame: str = "any"
    stop_codon: str = "any"
    has_d: str = "any"
    has_cdr3: str = "any"
    double_d: str = "any"
    min_cdr3_nt_length: int = 0
    max_cdr3_nt_length: int = 0
    min_cdr3_aa_length: int = 0
    max_cdr3_aa_length: int = 0
    min_v_identity: float = 0
    min_j_identity: float = 0
    min_v_mutation: float = 0
    max_v_mutation: float = 0


def validate_selection(s: Selection) -> list[str]:
    """Human-readable problems; an empty list means the selection can run."""
    problems = []
    for low, high, label in (
        (s.min_cdr3_nt_length, s.max_cdr3_nt_length, "length of the CDR3 in bases"),
        (s.min_cdr3_aa_length, s.max_cdr3_aa_length, "length of the CDR3 in residues"),
        (s.min_v_mutation, s.max_v_mutation, "share of mutated V bases"),
    ):
        if high > 0 and low > high:
            problems.append(f"The range for the {label} is empty ({low} to {high}).")
    try:
        for pattern in motif_patterns(s.motif, s.motif_syntax):
            re.compile(pattern)
    except (re.error, ValueError) as error:
        problems.append(f"The motif cannot be read: {error}")
    return problems


def selection_condition(s: Selection, columns: list[str]) -> Column:
    """The selection as one boolean column; absent table columns read as empty."""

    def cell(name: str) -> Column:
        return text(name) if name in columns else F.lit("")

    def first_of(a: str, b: str) -> Column:
        return F.when(cell(a) != "", cell(a)).otherwise(cell(b))

    conditions: list[Column] = []
    if s.sequence_id:
        conditions.append(F.lower(cell("sequence_id")).contains(s.sequence_id.strip().lower()))
    for name in ("dataset_id", "sample_id", "subject_id", "cohort", "timepoint", "compartment", "locus", "isotype"):
        conditions.append(facet_contains(cell(name), getattr(s, name)))
    conditions.append(call_contains(cell("v_call"), s.v_call, s.v_ambiguous))
    conditions.append(call_contains(cell("d_call"), s.d1_call, s.d1_ambiguous))
    conditions.append(facet_contains(cell("d2_call"), s.d2_call))
    conditions.append(call_contains(cell("j_call"), s.j_call, s.j_ambiguous))
    conditions.append(call_contains(cell("c_call"), s.c_call, s.c_ambiguous))
    nt, aa = F.upper(first_of("cdr3", "junction")), F.upper(first_of("cdr3_aa", "junction_aa"))
    if s.cdr3_nt:
        conditions.append(nt.contains(re.sub(r"\s", "", s.cdr3_nt).upper()))
    if s.cdr3_aa:
        conditions.append(aa.contains(re.sub(r"\s", "", s.cdr3_aa).upper()))
    for name in ("productive", "complete_vdj", "vj_in_frame", "stop_codon"):
        if getattr(s, name) != "any":
            conditions.append(tri_state(name, getattr(s, name)) if name in columns else F.lit(getattr(s, name) == "no"))
    if s.has_d != "any":
        conditions.append((cell("d_call") != "") == F.lit(s.has_d == "yes"))
    if s.has_cdr3 != "any":
        conditions.append(((nt != "") | (aa != "")) == F.lit(s.has_cdr3 == "yes"))
    if s.double_d != "any":
        conditions.append((cell("d2_call") != "") == F.lit(s.double_d == "positive"))
    for low, high, value in (
        (s.min_cdr3_nt_length, s.max_cdr3_nt_length, F.length(nt)),
        (s.min_cdr3_aa_length, s.max_cdr3_aa_length, F.length(aa)),
    ):
        if low:
            conditions.append(value >= low)
        if high:
            conditions.append(value <= high)

    def identity(name: str) -> Column:
        return F.coalesce(number(name), F.lit(0.0)) if name in columns else F.lit(0.0)

    if s.min_v_identity:
        conditions.append(identity("v_identity") >= s.min_v_identity)
    if s.min_j_identity:
        conditions.append(identity("j_identity") >= s.min_j_identity)
    v = identity("v_identity")
    mutation = F.when(v != 0, 1 - v).otherwise(0.0)
    if s.min_v_mutation:
        conditions.append(mutation >= s.min_v_mutation)
    if s.max_v_mutation:
        conditions.append((v != 0) & (mutation <= s.max_v_mutation))
    patterns = motif_patterns(s.motif, s.motif_syntax)
    if patterns:
        target = {
            "sequence": first_of("sequence_alignment", "sequence"),
            "cdr3_nt": nt,
            "cdr3_aa": aa,
            "junction_aa": cell("junction_aa"),
        }[s.motif_target]
        hits = [target.rlike(p) for p in patterns]
        combined = hits[0]
        for h in hits[1:]:
            combined = (combined & h) if s.motif_mode == "all" else (combined | h)
        conditions.append(combined)
    return _all(conditions)


def select_repertoire(table: DataFrame, s: Selection, mask: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Rows of ``table`` inside ``mask`` that satisfy the selection.

    ``mask(ordinal)`` is an inherited working set. ``evidence`` is the sparse
    second-D table ``(ordinal, d_call, d2_call)``; its calls replace the row's. When
    only positives are wanted the join is inner, so the scan is cut to them first.
    """
    problems = validate_selection(s)
    if problems:
        raise ValueError(" ".join(problems))
    rows = table if mask is None else table.join(mask.select("ordinal"), "ordinal", "left_semi")
    if evidence is not None:
        found = evidence.select("ordinal", text("d_call").alias("_d"), text("d2_call").alias("_d2"))
        rows = rows.join(found, "ordinal", "inner" if s.double_d == "positive" else "left")
        d2 = text("d2_call") if "d2_call" in table.columns else F.lit("")
        rows = rows.withColumn("d_call", F.when(text("_d") != "", F.col("_d")).otherwise(text("d_call"))).withColumn(
            "d2_call", F.when(text("_d2") != "", F.col("_d2")).otherwise(d2)
        ).drop("_d", "_d2")
    return rows.filter(selection_condition(s, rows.columns))


def describe_selection(s: Selection) -> str:
    """Short label of what a selection asks for."""
    set_fields = [f"{f.name}={getattr(s, f.name)}" for f in fields(s) if getattr(s, f.name) != f.default]
    return ", ".join(set_fields) or "every record"
