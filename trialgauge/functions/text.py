"""Text similarity and text vectors as column expressions."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shingle length, permutations and bands of a signature, their modulus and seed.
SHINGLE = 3
PERMUTATIONS, BANDS = 128, 32
ROWS_PER_BAND = PERMUTATIONS // BANDS
PRIME = 2**31 - 1
SIGNATURE_SEED = 42

# Terms whose presence is part of the text vector.
TERMS = [
    "patient", "subject", "site", "visit", "query", "status", "date", "count", "id", "name", "type", "code", "value",
]


def coefficients(n: int = PERMUTATIONS, seed: int = SIGNATURE_SEED) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of the permutations, drawn from one seeded generator."""
    rng = random.Random(seed)
    a = [rng.randint(1, PRIME) for _ in range(n)]
    b = [rng.randint(0, PRIME) for _ in range(n)]
    return a, b


def shingles(text: str, k: int = SHINGLE) -> Column:
    """Distinct character k-grams of the lowered, trimmed text; short texts whole."""
    t = f"lower(trim({text}))"
    return F.expr(
        f"CASE WHEN length({t}) < {k} THEN array({t}) "
        f"ELSE array_distinct(transform(sequence(1, length({t}) - {k - 1}), i -> substring({t}, i, {k}))) END"
    )


def digests(grams: str) -> Column:
    """The digest of every shingle modulo 2^31-1.

    The reduction of the 128-bit digest is exact: 2^32 leaves remainder 2, so its four
    32-bit words weigh 8, 4, 2 and 1.
    """
    word = lambda i: f"CAST(conv(substring(d, {8 * i + 1}, 8), 16, 10) AS BIGINT)"
    return F.expr(
        f"transform(transform({grams}, s -> md5(s)), d -> (8 * {word(0)} + 4 * {word(1)} + 2 * {word(2)} + {word(3)}) % {PRIME})"
    )


def bands(sig: str) -> Column:
    """One hash per band of four signature rows."""
    return F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(slice({sig}, i * {ROWS_PER_BAND} + 1, {ROWS_PER_BAND})))")


def jaccard(x: Column, y: Column) -> Column:
    """Overlap of two distinct arrays."""
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def edit_similarity(x: Column, y: Column) -> Column:
    """One minus the case-insensitive edit distance over the longer length."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(F.lower(x), F.lower(y)) / longest)


def text_vector(text: str) -> Column:
    """42 numbers: word lengths, distinct words, letter shares, term flags."""
    t = f"lower({text})"
    words = f"array_distinct(regexp_extract_all({t}, '[\\\\w]+', 0))"
    sizes = f"transform({words}, w -> length(w))"
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    count = lambda c: f"(length({t}) - length(replace({t}, '{c}', '')))"
    total = f"greatest(1, length({t}) - length(translate({t}, '{''.join(letters)}', '')))"
    parts = [
        f"CASE WHEN size({words}) > 0 THEN aggregate({sizes}, 0, (s, n) -> s + n) / CAST(size({words}) AS DOUBLE) ELSE 0D END",
        f"CAST(coalesce(array_max({sizes}), 0) AS DOUBLE)",
        f"CAST(size({words}) AS DOUBLE)",
        *[f"{count(c)} / CAST({total} AS DOUBLE)" for c in letters],
        *[f"CASE WHEN contains({t}, '{w}') THEN 1D ELSE 0D END" for w in TERMS],
    ]
    return F.expr(f"array({', '.join(parts)})")


def cosine(x: str, y: str) -> Column:
    """Cosine of two numeric arrays, the shorter padded with zeros; zero norm gives zero."""
    return F.expr(
        f"coalesce(try_divide(aggregate(zip_with({x}, {y}, (a, b) -> coalesce(a, 0D) * coalesce(b, 0D)), 0D, (s, v) -> s + v), "
        f"sqrt(aggregate({x}, 0D, (s, v) -> s + v * v)) * sqrt(aggregate({y}, 0D, (s, v) -> s + v * v))), 0D)"
    )
