"""Sequence and call expressions built from native Spark functions.

Nothing here leaves the JVM. Functions take a column (or its name) and return a
``Column``; a missing value behaves like the empty string, as it does in an AIRR
table where an absent cell is ``""``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code.
CODON_TABLE = {
    "TTT": "F", "TTC": "F", "TTA": "L", "TTG": "L", "TCT": "S", "TCC": "S", "TCA": "S", "TCG": "S",
    "TAT": "Y", "TAC": "Y", "TAA": "*", "TAG": "*", "TGT": "C", "TGC": "C", "TGA": "*", "TGG": "W",
    "CTT": "L", "CTC": "L", "CTA": "L", "CTG": "L", "CCT": "P", "CCC": "P", "CCA": "P", "CCG": "P",
    "CAT": "H", "CAC": "H", "CAA": "Q", "CAG": "Q", "CGT": "R", "CGC": "R", "CGA": "R", "CGG": "R",
    "ATT": "I", "ATC": "I", "ATA": "I", "ATG": "M", "ACT": "T", "ACC": "T", "ACA": "T", "ACG": "T",
    "AAT": "N", "AAC": "N", "AAA": "K", "AAG": "K", "AGT": "S", "AGC": "S", "AGA": "R", "AGG": "R",
    "GTT": "V", "GTC": "V", "GTA": "V", "GTG": "V", "GCT": "A", "GCC": "A", "GCA": "A", "GCG": "A",
    "GAT": "D", "GAC": "D", "GAA": "E", "GAG": "E", "GGT": "G", "GGC": "G", "GGA": "G", "GGG": "G",
}

# IUPAC nucleotide codes as regular-expression classes.
IUPAC_CLASSES = {
    "A": "A", "C": "C", "G": "G", "T": "[TU]", "U": "[TU]", "R": "[AG]", "Y": "[CTU]", "S": "[GC]",
    "W": "[ATU]", "K": "[GTU]", "M": "[AC]", "B": "[CGTU]", "D": "[AGTU]", "H": "[ACTU]", "V": "[ACG]",
    "N": "[ACGTU]", "X": ".",
}

# IUPAC complement pairs.
COMPLEMENT_FROM = "ACGTURYSWKMBDHVN"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBN"

CALL_RESOLUTIONS = ("gene", "allele")
AMBIGUITY_POLICIES = ("overlap", "top", "strict")

# Packed words hold 21 symbols of three bits each; the mask keeps one bit per symbol.
PACK_WIDTH = 21
PACK_MASK = sum(1 << (3 * i) for i in range(PACK_WIDTH))


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: Column | str) -> Column:
    """The cell as text, with NULL read as the empty string."""
    return F.coalesce(col(value).cast("string"), F.lit(""))


def number(value: Column | str) -> Column:
    """Nullable number: empty, malformed and non-finite cells become NULL."""
    parsed = F.expr("try_cast(null as double)") if value is None else col(value).cast("string").try_cast("double")
    return F.when(F.isnan(parsed) | (F.abs(parsed) == float("inf")), None).otherwise(parsed)


def multiplicity(value: Column | str) -> Column:
    """``max(1, floor(n))`` with anything unusable counted once."""
    return F.greatest(F.lit(1), F.coalesce(F.floor(number(value)), F.lit(1))).cast("bigint")


def rounded_count(value: Column | str) -> Column:
    """Half-up rounded count, at least one (the somatic-hypermutation weight)."""
    return F.greatest(F.lit(1), F.coalesce(F.floor(number(value) + 0.5), F.lit(1))).cast("bigint")


def is_true_word(value: Column | str) -> Column:
    """T / TRUE / YES / 1, any case: the selection dialect of booleans."""
    return F.upper(F.trim(text(value))).isin("T", "TRUE", "YES", "1")


def is_true_flag(value: Column | str) -> Column:
    """T / TRUE, any case: the record dialect of booleans."""
    return F.upper(text(value)).isin("T", "TRUE")


def normalize_nt(value: Column | str) -> Column:
    # replace passes over bytes, translate makes a string of every letter
    return F.regexp_replace(F.replace(F.upper(text(value)), F.lit("U"), F.lit("T")), "[^ACGTN]", "")


def normalize_aa(value: Column | str) -> Column:
    return F.regexp_replace(F.upper(text(value)), "[^A-Z*]", "")


def clean_alignment(value: Column | str) -> Column:
    """Upper case with ``.`` read as a gap."""
    return F.replace(F.upper(text(value)), F.lit("."), F.lit("-"))


def gene_of(call: Column | str) -> Column:
    return F.regexp_replace(col(call), r"\*.*$", "")


def normalize_call(call: Column | str, resolution: str = "gene") -> Column:
    if resolution not in CALL_RESOLUTIONS:
        raise ValueError(f"resolution must be one of {CALL_RESOLUTIONS}")
    clean = F.upper(F.trim(text(call)))
    return gene_of(clean) if resolution == "gene" else clean


def calls(value: Column | str) -> Column:
    """The ordered calls of a comma list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text(value), ","), lambda c: F.trim(c)), lambda c: c != "")


def top_call(value: Column | str) -> Column:
    return F.coalesce(F.get(calls(value), F.lit(0)), F.lit(""))


def call_set(value: Column | str, resolution: str = "gene", ambiguity: str = "overlap") -> Column:
    """Normalised calls: the first one under ``top``, otherwise the sorted set."""
    if ambiguity not in AMBIGUITY_POLICIES:
        raise ValueError(f"ambiguity must be one of {AMBIGUITY_POLICIES}")
    values = F.filter(
        F.transform(F.split(text(value), ","), lambda c: normalize_call(c, resolution)), lambda c: c != ""
    )
    return F.slice(values, 1, 1) if ambiguity == "top" else F.array_sort(F.array_distinct(values))


def calls_compatible(left: Column, right: Column, ambiguity: str = "overlap") -> Column:
    """Whether two ``call_set`` arrays agree; an empty one never does."""
    filled = (F.size(left) > 0) & (F.size(right) > 0)
    return filled & ((left == right) if ambiguity == "strict" else F.arrays_overlap(left, right))


def call_tokens(value: Column | str) -> Column:
    """Distinct upper-case allele and gene tokens of a call list."""
    upper = F.transform(calls(value), lambda c: F.upper(c))
    return F.filter(
        F.array_distinct(F.flatten(F.transform(upper, lambda c: F.array(c, gene_of(c))))), lambda c: c != ""
    )


def blocks(sequence: Column | str, count: Column) -> Column:
    """``count`` nearly equal consecutive blocks, cut at ``floor(i * length / count)``."""
    s, n = col(sequence), count.cast("int")
    length = F.length(s)

    def block(i: Column) -> Column:
        start = F.floor(i * length / n).cast("int")
        stop = F.floor((i + 1) * length / n).cast("int")
        return F.substring(s, start + 1, stop - start)

    return F.transform(F.sequence(F.lit(0), n - 1), block)


def distance_limit(identity: float, length: Column) -> Column:
    """Largest number of differences allowed at this identity."""
    return F.floor(F.lit(1 - identity) * length + F.lit(1e-9)).cast("int")


def hamming(left: Column | str, right: Column | str, wildcard_n: bool = False) -> Column:
    """Mismatches of two equal-length strings, NULL when the lengths differ."""
    a, b = col(left), col(right)

    def differs(x: Column, y: Column) -> Column:
        different = x != y
        if wildcard_n:
            different = different & (x != "N") & (y != "N")
        return F.when(different, 1).otherwise(0)

    total = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), differs), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), F.when(a == b, 0).otherwise(total))


def packed_words(sequence: Column | str, words: int) -> list[Column]:
    """A nucleotide string (ACGTN) as ``words`` big integers, three bits a symbol.

    Two rows of equal length then compare by XOR and a bit count, which stays
    inside generated code and costs one step per 21 bases.
    """
    octal = F.translate(col(sequence), "ACGTN", "01234")
    return [
        F.coalesce(F.conv(F.substring(octal, i * PACK_WIDTH + 1, PACK_WIDTH), 8, 10).cast("bigint"), F.lit(0))
        for i in range(words)
    ]


def packed_hamming(left: list[Column], right: list[Column]) -> Column:
    """Mismatches between two packed sequences of equal length (N is a symbol)."""
    total: Column = F.lit(0)
    for a, b in zip(left, right, strict=True):
        x = a.bitwiseXOR(b)
        folded = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(PACK_MASK))
        total = total + F.bit_count(folded)
    return total


def reverse_complement(value: Column | str) -> Column:
    return F.translate(F.reverse(F.upper(text(value))), COMPLEMENT_FROM, COMPLEMENT_TO)


def codon_map() -> Column:
    pairs: list[Column] = []
    for codon, residue in CODON_TABLE.items():
        pairs += [F.lit(codon), F.lit(residue)]
    return F.create_map(*pairs)


def translate_nt(value: Column | str, frame: int = 1) -> Column:
    """Complete codons from ``frame``; a codon outside the code reads ``X``."""
    s = F.substring(text(value), frame, 2_000_000_000)
    n = F.floor(F.length(s) / 3).cast("int")
    table = codon_map()
    residues = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.coalesce(F.try_element_at(table, F.substring(s, (i - 1) * 3 + 1, F.lit(3))), F.lit("X")),
    )
    return F.when(n < 1, "").otherwise(F.array_join(residues, ""))


def infer_locus(name: Column | str) -> Column:
    return F.regexp_extract(F.upper(text(name)), "^(IGH|IGK|IGL|TRA|TRB|TRD|TRG)", 1)


def isotype_label(call: Column | str) -> Column:
    """Constant-region label such as ``IgG1``; unknown genes keep their name."""
    gene = gene_of(F.upper(top_call(call)))
    simple = F.regexp_extract(gene, r"IGH([MDE])(?:\d+)?$", 1)
    numbered = F.regexp_extract(gene, r"IGH(G|A)(\d+)?$", 1)
    digits = F.regexp_extract(gene, r"IGH(G|A)(\d+)?$", 2)
    return (
        F.when(simple != "", F.concat(F.lit("Ig"), simple))
        .when(numbered != "", F.concat(F.lit("Ig"), numbered, digits))
        .when(gene.startswith("IGKC"), "Igκ constant")
        .when(gene.startswith("IGLC"), "Igλ constant")
        .otherwise(gene)
    )


def infer_isotype(call: Column | str, aligned: Column | str, identity: Column | str) -> Column:
    """Label when at least 30 bases align at identity 0.65 or better, else empty."""
    bases = F.length(F.regexp_replace(text(aligned), r"[-.\s]", ""))
    usable = (text(call) != "") & (bases >= 30) & (F.coalesce(number(identity), F.lit(0.0)) >= 0.65)
    return F.when(usable, isotype_label(call)).otherwise("")


def longest_match_run(query: Column | str, reference: Column | str) -> Column:
    """Longest stretch of equal, ungapped columns in an aligned pair."""
    marks = F.array_join(
        F.zip_with(
            F.split(clean_alignment(query), ""),
            F.split(clean_alignment(reference), ""),
            lambda q, r: F.when((q == r) & (q != "-"), "1").otherwise("0"),
        ),
        "",
    )
    return F.coalesce(F.array_max(F.transform(F.split(marks, "0"), lambda run: F.length(run))), F.lit(0))


def at(sequence: Column, position: Column) -> Column:
    """One base at a 1-based position, empty outside the sequence."""
    inside = (position >= 1) & (position <= F.length(sequence))
    return F.when(inside, F.substring(sequence, position.cast("int"), F.lit(1))).otherwise("")


def hotspot(sequence: Column | str, position: Column) -> Column:
    """AID hotspot (WRCY or RGYW) at a 1-based position."""
    s = col(sequence)
    base = at(s, position)
    wrcy = (
        (base == "C")
        & at(s, position - 2).isin("A", "T")
        & at(s, position - 1).isin("A", "G")
        & at(s, position + 1).isin("C", "T")
    )
    rgyw = (
        (base == "G")
        & at(s, position - 1).isin("A", "G")
        & at(s, position + 1).isin("C", "T")
        & at(s, position + 2).isin("A", "T")
    )
    return wrcy | rgyw


def expected_errors(quality: Column | str, offset: int = 33) -> Column:
    """Sum of per-base error probabilities of a Phred string."""
    return F.aggregate(
        F.filter(F.split(text(quality), ""), lambda ch: ch != ""),
        F.lit(0.0),
        lambda s, ch: s + F.pow(F.lit(10.0), -(F.ascii(ch) - offset) / 10.0),
    )


def natural_key(value: Column | str) -> Column:
    """Sort key under which ``sample_2`` precedes ``sample_10``."""
    padded = F.regexp_replace(F.lower(text(value)), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def safe_identifier(value: Column | str) -> Column:
    return F.regexp_replace(F.trim(text(value)), r"[^A-Za-z0-9_.-]+", "_")


def clean_cell(value: Column | str) -> Column:
    """A cell that cannot break a tab-separated line."""
    return F.regexp_replace(text(value), r"[\t\r\n]+", " ")
