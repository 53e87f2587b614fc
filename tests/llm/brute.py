"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LAST = (1 << 63) - 1
LOWER = {c: c + 32 for c in range(65, 91)}
NO_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def cut_repeats(docs, size=50):
    first: dict[bytes, int] = {}
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            first[s] = min(first.get(s, LAST), i)
    out = []
    for (doc, _), (i, b) in zip(docs, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\x01" * size
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), spans, sha(kept)))
    return out


def fingerprint(text: str | None) -> int:
    words = NO_BLANK.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs):
    fps = [(LAST if i is None else i, fingerprint(t)) for i, t in docs]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    low = defaultdict(lambda: LAST)
    for n, (i, _) in enumerate(fps):
        low[root(n)] = min(low[root(n)], i)
    return [(d, f"{fp:016x}", None if low[root(n)] == LAST else low[root(n)]) for n, ((d, _), (_, fp)) in enumerate(zip(docs, fps, strict=True))]


def contamination(docs, bench, size=10):
    windows = defaultdict(set)
    for item, text in bench:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows[tuple(words[i : i + n])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def counts(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        words = NO_BLANK.findall(text)
        lines = [x for x in text.split("\n") if NO_BLANK.search(x)]
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = Counter(grams)
        hit = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
        n = len(words)
        failed = n < 20 or 100 * len(hit) > 30 * n
        out.append((doc, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed))
    return out


def longest_repeat(symbols):
    n, best = len(symbols), [0] * len(symbols)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and symbols[i + k] == symbols[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return [sum(k == kind for _, k, _ in spans) for kind in range(3)], joined


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def fill_middle(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        units = UNIT.findall(text)
        n = len(units)
        digest = sha(f"1:{'null' if doc is None else doc}")
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        before, within, after = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            form, output, chars = "plain", text, (None, None)
        else:
            form, chars = ("spm" if h4 % 100 < 20 else "psm"), (len(before), len(within))
            output = f"<S>{after}<P>{before}<M>{within}" if form == "spm" else f"<P>{before}<S>{after}<M>{within}"
        out.append((doc, n, form, *chars, sha(output), sha(text), output))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=20):
    """(item id, rank, doc id, score) of every distinct item."""
    import math

    bags = [(LAST if d is None else d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for d, bag in bags:
            score = 0
            for term, times in Counter(TERM.findall((text or "").translate(LOWER))).items():
                if tf := bag[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * weight * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * bag.total() * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, d))
        out += [(item, r + 1, None if d == LAST else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return out
