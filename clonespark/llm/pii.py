"""Personal data by weak supervision.

Fixed patterns give the base spans. Looser patterns give candidates, on which labelers
vote for or against: format, checksum and range rules, gazetteers, the words around, and what
touches the span. Expectation-maximisation over the vote patterns of the whole corpus estimates how reliable
each labeler is and what every pattern means; a logistic span classifier learns these soft
labels from features of the span. Candidates that it accepts are added to the base spans,
unless they fail the checksum or the range of their kind, which no vote outweighs.

Votes and features are bits, so the corpus is summed up by pattern: the number of patterns
is bounded by the labelers and features, not by the data.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone")
LABELERS = 6
SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())])

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai app dev co uk de fr es it nl be ch at se no dk fi pl pt ie us ca mx br ar au nz jp cn in ru eu".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 380 420 421 966 971 972".split())
CARD_PREFIXES = re.compile(r"4|5[1-5]|2(?:2[2-9]|[3-6]|7[01]|720)|3[47]|6(?:011|4[4-9]|5)|3(?:0[0-5]|[68])|35")
NEAR = {
    "email": frozenset("mail email e-mail contact write address courriel correo adresse".split()),
    "ip": frozenset("ip host server address addr ping client peer network from".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp telefon téléphone teléfono".split()),
}
OTHERWISE = frozenset("version release isbn order invoice id no number page chapter section doi build rev year code token key hash".split())

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"(?:\+|\()?[0-9][0-9 ().\-]*")
SPOKEN = re.compile(r"([A-Za-z0-9._%+-]+) ?(?:\(at\)|\[at\]| at |@) ?([A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]+)+)", re.I)
#: The parts of SPOKEN from its sign on, and what may stand before it (with re.I, four more letters count as ASCII ones).
AT = re.compile(r"@|\(at\)|\[at\]| at(?= )", re.I)
SPOKEN_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]+)+", re.I)
SPOKEN_LOCAL = LOCAL | frozenset("\u0130\u0131\u017f\u212a")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by kind and start; each is found in one pass."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)
    if not DIGIT.search(text):
        return out
    for run in DOTTED.finditer(text):
        parts = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run[0])]
        for k in range(0, len(parts) - 3, 4):
            if all(octet(run[0][a:b]) for a, b in parts[k : k + 4]):
                out.append((1, run.start() + parts[k][0], run.start() + parts[k + 3][1]))
    for run in CARD.finditer(text):
        digits = digits_of(run[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, run.start(), run.end()))
    for run in PHONE.finditer(text):
        found = run[0].rstrip(" ().-")
        if len(found) >= 4 and 8 <= len(digits_of(found)) <= 15:
            out.append((3, run.start(), run.start() + len(found)))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Loose matches of each kind: spoken addresses, and numbers by their shape."""
    out = []
    done = 0
    # all matches of SPOKEN, from their signs: looking for the local part first takes quadratic time in long words
    for at in AT.finditer(text):
        stop = at.start() - (text[at.start() - 1 : at.start()] == " ")
        start = stop
        while start > done and text[start - 1] in SPOKEN_LOCAL:
            start -= 1
        domain = SPOKEN_DOMAIN.match(text, at.end() + (text[at.start()] == " ")) if start < stop else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
    if not DIGIT.search(text):
        return out
    for run in NUMBER.finditer(text):
        for begin, end in _pieces(run[0]):
            piece = run[0][begin:end]
            n = len(digits_of(piece))
            if n < 4:
                continue
            span = (run.start() + begin, run.start() + end)
            if re.fullmatch(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}", piece):
                out.append((1, *span))
            if 13 <= n <= 19 and re.fullmatch(r"[0-9][0-9 -]*", piece):
                out.append((2, *span))
            if 7 <= n <= 15:
                out.append((3, *span))
    return out


def _pieces(run: str) -> list[tuple[int, int]]:
    """Numbers of a run: parts that stand apart are joined unless one begins anew or is long by itself."""
    parts = [(m.start(), m.end()) for m in re.finditer(r"[^ ]+", run)]
    groups: list[list[int]] = []
    size = 0
    for a, b in parts:
        n = len(digits_of(run[a:b]))
        if not n:
            continue
        fresh = run[a] == "+" or n >= 10 or size >= 10 and n >= 7 or size + n > 19 or run.count(".", a, b) > 1
        if not groups or fresh:
            groups.append([a, b])
            size = n
        else:
            groups[-1][1] = b
            size += n
    out = []
    for a, b in groups:
        while b > a and not run[b - 1].isdigit():
            b -= 1
        if run[a] == "(" and ")" not in run[a:b]:
            a += 1
        if b > a:
            out.append((a, b))
    return out


def judge(text: str, kind: int, start: int, end: int) -> tuple[tuple[int, ...], int]:
    """Votes of the labelers (-1, 0, 1) on a candidate, and its features as bits."""
    span, name = text[start:end], KINDS[kind]
    before = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])][-4:]
    after = [w.lower() for w in WORD.findall(text[end : end + 20])][:2]
    around = {*before, *after}
    context = 1 if around & NEAR[name] else -1 if around & OTHERWISE or any(around & NEAR[k] for k in KINDS if k != name) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    alone = not (left.isalnum() or left in {"_", "=", "/", "#"} and left != "" or right.isalnum() or right in {"_", "@"} and right != "")
    digits = digits_of(span)
    if kind == 0:
        plain = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", span))
        ending = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        known, rule = ending in TOP_DOMAINS, 1 if plain else 0
        shaped = bool(re.search(r"\((?:at|dot)\)|\[(?:at|dot)\]| dot ", span, re.I)) or plain
        sized = 6 <= len(span) <= 80
    elif kind == 1:
        parts = span.split(".")
        rule = 1 if all(octet(p) for p in parts) else -1
        known = parts[0].lstrip("0") not in {""} and not all(len(p) == 1 for p in parts)
        shaped = not any(len(p) > 1 and p[0] == "0" for p in parts)
        sized = len(digits) >= 6
    elif kind == 2:
        rule = 1 if luhn(digits) else -1
        known = bool(CARD_PREFIXES.match(digits))
        shaped = bool(re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span))
        sized = len(digits) in (13, 14, 15, 16, 19)
    else:
        code = next((digits[:k] for k in (3, 2, 1) if digits[:k] in COUNTRY_CODES), "")
        rule = 1 if span[0] == "+" and 8 <= len(digits) <= 15 else 0
        known = (span[0] == "+" and bool(code)) or bool(re.match(r"\(?[2-9][0-9]{2}\)?[ .-][2-9]", span))
        shaped = bool(re.search(r"\([0-9]{2,4}\)|[0-9]{2,4}[ .-][0-9]{3,4}[ .-]?[0-9]{2,4}", span)) and len(set(digits)) > 2
        sized = 8 <= len(digits) <= 15 and not re.fullmatch(r"[0-9]{1,4}(\.[0-9]{1,4}){3}", span)
    votes = (rule, 1 if known else -1, context, 1 if shaped else -1, 1 if sized else -1, 0 if alone else -1)
    bits = sum(1 << k for k, flag in enumerate((rule > 0, rule < 0, known, context > 0, context < 0, shaped, sized, alone, span[0] == "+", not span.isdigit())) if flag)
    return votes, bits


FEATURES = 10


def patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, votes, bits, n`` over the candidates of all rows."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(text).to_pylist():
                for kind, start, end in candidates(value or ""):
                    total[(kind, *judge(value, kind, start, end))] += 1
        keys = sorted(total)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([k[0] for k in keys], pa.int32()), "votes": pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())),
            "bits": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array([total[k] for k in keys], pa.int64()),
        })

    return docs.select(text).mapInArrow(run, "kind int, votes array<int>, bits int, n long").groupBy("kind", "votes", "bits").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and ``P(vote | class)`` by labeler (two classes, three votes).

    Starts from the majority of votes; smoothing keeps every vote possible.
    """
    truth = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    table = np.full((votes.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        for k in range(votes.shape[1]):
            for c, weight in enumerate((n * (1 - truth), n * truth)):
                counts = np.bincount(votes[:, k] + 1, weight, 3) + np.array([[1.5, 1.0, 0.5], [0.5, 1.0, 1.5]])[c]
                table[k, c] = counts / counts.sum()
        prior = ((n * truth).sum() + 1) / (n.sum() + 2)
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[k, 1, votes[:, k] + 1] / table[k, 0, votes[:, k] + 1]) for k in range(votes.shape[1]))
        truth = 1 / (1 + np.exp(-odds))
    return truth, table


def fit_spans(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weights of the span classifier: kind x (features and bias), from all candidates of ``docs``."""
    rows = sorted(patterns(docs, text).collect())
    weights = np.zeros((len(KINDS), FEATURES + 1))
    weights[:, -1] = -9.0  # a kind without candidates accepts none
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        votes, n = np.array([r["votes"] for r in own]), np.array([r["n"] for r in own], float)
        truth, _ = reliabilities(votes, n)
        x = np.array([[r["bits"] >> k & 1 for k in range(FEATURES)] + [1] for r in own], float)
        w, share = np.zeros(FEATURES + 1), n / n.sum()
        for _ in range(50):  # Newton steps on the weighted soft labels
            p = 1 / (1 + np.exp(-(x @ w)))
            slope = x.T @ (share * (p - truth)) + 1e-4 * w
            curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(FEATURES + 1)
            w -= np.linalg.solve(curve, slope)
        weights[kind] = w
    return weights


def find(text: str, weights: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, int, bool]]:
    """All spans of a text by kind and start: base ones, and accepted candidates that touch none."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    offered = []
    for kind, start, end in candidates(text):
        if any(a < end and start < b for a, b in taken):
            continue
        votes, bits = judge(text, kind, start, end)
        if votes[0] < 0:
            continue  # a failed checksum or range is final, as in the base rules
        odds = sum(weights[kind, k] for k in range(FEATURES) if bits >> k & 1) + weights[kind, -1]
        if odds > np.log(threshold / (1 - threshold)):
            offered.append((-odds, kind, start, end))
    out = [(kind, start, end, True) for kind, start, end in base]
    for _, kind, start, end in sorted(offered):
        if not any(a < end and start < b for _, a, b, own in out if not own):
            out.append((kind, start, end, False))
    return sorted(out)


def find_personal_data(docs: DataFrame, text: str = "text", redact: bool = False, threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with ``spans`` (kind, start, end in code points, base), sorted by kind and start.

    With ``redact`` the text is given with each span replaced by its kind in angle brackets
    (overlapping spans by the first). The reliabilities and the classifier are learnt from all rows of ``docs``.
    Null and empty texts have no spans, and a null text stays null. Rows are judged one by
    one, whatever their id; a column named ``spans`` is replaced; other columns are kept. An empty table stays empty.
    """
    weights = fit_spans(docs, text)
    kept = docs.drop("spans")
    schema = StructType([*kept.schema.fields, StructField("spans", ArrayType(SPAN))])

    def run(batches):
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [find(t or "", weights, threshold) for t in texts]
            columns = list(batch.columns)
            if redact:
                place = batch.schema.get_field_index(text)
                columns[place] = pa.array([t if not f else mask(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in f] for f in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(struct))], names=[*batch.schema.names, "spans"])

    return kept.mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
