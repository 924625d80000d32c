"""Plain versions of the operators for small tables."""

import hashlib
import re
from collections import defaultdict


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_duplicates(rows, size=4, percent=80):
    """rows: (doc_id, text); doc_id -> (n_shingles, component_id)."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    where, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(rows, items, width=13):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(name))
    sizes, out = {len(w) for w in windows}, {}
    for doc, text in rows:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def repeats(rows, length=200):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), for unique ids."""
    starts, texts = defaultdict(int), {i: (t or "").encode() for i, t in rows}
    for t in texts.values():
        for i in range(len(t) - length + 1):
            starts[t[i : i + length]] += 1
    out = {}
    for doc, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out[doc] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(t, gone, strict=True) if not x)).hexdigest())
    return out


def runs(words, least=24, periods=3):
    """Every run (start, length, period) of a word list, by trying all periods."""
    found, n = {}, len(words)
    for p in range(1, n // periods + 1):
        i = p
        while i < n:
            if words[i] != words[i - p]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            start, length = i - p, j - i + p
            if length >= max(least, periods * p) and (start, length) not in found:
                found[start, length] = p  # periods ascend: the first one is the smallest
            i = j
    return sorted((s, m, p) for (s, m), p in found.items())


def run_report(rows):
    """rows: (doc_id, text); doc_id -> the columns of the run report, in order."""
    import zlib
    from fractions import Fraction

    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if doc is not None and w:
            h = zlib.crc32(str(doc).encode())
            if h % 10 == 0:
                g = h // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found, gone = runs(w), set()
        for s, m, p in found:
            gone.update(range(s + p, s + m))
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, text)))
    return out


def divergence(rows, least_docs=10, top=10):
    """rows: (text, lang, source); the rows (lang, source, part, item, value, rank)."""
    from collections import Counter

    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)), a or "", b or "") for t, a, b in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        seen = Counter(w for d in mine for w in set(d[0]))
        kept = [w for w, n in seen.items() if n >= least_docs]
        count = {s: Counter(w for d in mine if d[2] == s for w in d[0] if seen[w] >= least_docs) for s in {d[2] for d in mine}}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            found = {"pair": [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in count if o != s], "term": [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)
