"""Plain statements of what the operators return."""

import re
import zlib
from collections import Counter, defaultdict

BLANK = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=BLANK):
    return re.findall(pattern, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def substring_dedup(texts, window=20):
    seen, out = set(), {}
    for doc_id, text in sorted(texts.items()):
        ws = words(text)
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[doc_id] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g))
    return out


def quality_counts(text):
    ws = words(text)
    times = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    repeat = [False] * len(ws)
    for p in range(len(ws) - 2):
        if times[tuple(ws[p : p + 3])] > 1:
            repeat[p : p + 3] = [True] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(repeat))


def decontaminate(text, items, window=10):
    ws = words(lower(text), ALNUM)
    hit, found = [False] * len(ws), set()
    for item, content in items:
        phrase = words(lower(content), ALNUM)
        size = min(window, len(phrase))
        keys = {tuple(phrase[p : p + size]) for p in range(len(phrase) - size + 1)} if size else set()
        for p in range(len(ws) - size + 1 if size else 0):
            if tuple(ws[p : p + size]) in keys:
                hit[p : p + size] = [True] * size
                found.add(str(item))
    return len(ws), sum(hit), sorted(found)


def shingle_copies(text, size=5):
    ws = words(text)
    grams = [tuple(ws[p : p + size]) for p in range(len(ws) - size + 1)] if len(ws) >= size else [tuple(ws)] if ws else []
    return {(g, k) for g, n in Counter(grams).items() for k in range(n)}


def near_classes(texts, threshold=0.8):
    sets = {i: shingle_copies(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for element in s:
            holders[element].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for element in s for j in holders[element] if j > i)
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}
