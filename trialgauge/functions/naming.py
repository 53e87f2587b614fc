"""Column-name rules and file-name classification."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File-name keywords per category, first match wins, case-insensitive.
NOTEBOOK_LADDER: dict[str, list[str]] = {
    "edc_metrics": ["EDC_Metrics", "EDC Metrics"],
    "edrr": ["EDRR", "Compiled_EDRR"],
    "meddra": ["MedDRA"],
    "whodd": ["WHODD", "WHODrug"],
    "inactivated": ["Inactivated"],
    "missing_lab": ["Missing_Lab", "Missing Lab"],
    "missing_pages": ["Missing_Page", "Missing Page"],
    "visit_projection": ["Visit Projection", "Visit_Projection"],
    "esae": ["eSAE", "SAE Dashboard", "SAE_Dashboard"],
}

LOADER_LADDER: dict[str, list[str]] = {
    "visit": ["visit", "projection", "tracker"],
    "query": ["query", "edrr"],
    "safety": ["esae", "safety", "sae"],
    "coding": ["coding", "meddra", "whodd"],
    "lab": ["lab", "missing_lab"],
    "edc_metrics": ["edc", "metrics"],
    "forms": ["inactivated", "forms", "folders", "records"],
    "pages": ["missing_pages", "page"],
}

MAX_IDENTIFIER = 63
DATE_SUFFIX = r"(?i)_\d{1,2}\s*(NOV|DEC|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT)\s*\d{4}"


def category(name: Column, ladder: dict[str, list[str]] = LOADER_LADDER) -> Column:
    lowered = F.lower(name)
    out = None
    for label, words in ladder.items():
        hit = lowered.contains(words[0].lower())
        for word in words[1:]:
            hit = hit | lowered.contains(word.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def study_number(path: Column) -> Column:
    digits = F.regexp_extract(path, r"(?i)Study\s*(\d+)", 1)
    return F.when(digits != "", digits).otherwise("unknown")


def sanitize_expr(name: Column) -> Column:
    """Identifier rule as a column expression, for names that are data."""
    kept = F.regexp_replace(name, r"[^\w\s]", "")
    joined = F.lower(F.regexp_replace(kept, r"\s+", "_"))
    bare = F.regexp_replace(joined, r"^_+|_+$", "")
    prefixed = F.when(bare.rlike(r"^\d"), F.concat(F.lit("col_"), bare)).otherwise(bare)
    return F.when(bare == "", "unnamed_column").otherwise(F.substring(prefixed, 1, MAX_IDENTIFIER))


def inferred_table_name(file_stem: Column, study: Column) -> Column:
    """``study_<n>_<cleaned stem>`` without study prefix, version suffix or date stamp."""
    stem = F.regexp_replace(file_stem, r"(?i)^Study\s*\d+[_\s]*", "")
    stem = F.regexp_replace(stem, r"(?i)_updated$", "")
    stem = F.regexp_replace(stem, DATE_SUFFIX, "")
    full = F.concat(F.lit("study_"), study, F.lit("_"), sanitize_expr(stem))
    return F.substring(full, 1, MAX_IDENTIFIER)


def standard_name(name: str) -> str:
    return re.sub(r"[^\w]", "_", re.sub(r"\s+", "_", name.strip())).lower()


def sanitized_name(name: str) -> str:
    bare = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", str(name))).lower().strip("_")
    if not bare:
        return "unnamed_column"
    return (f"col_{bare}" if bare[0].isdigit() else bare)[:MAX_IDENTIFIER]


def unique_names(names: Iterable[str]) -> list[str]:
    """Suffix repeats with ``_1``, ``_2`` ... in column order."""
    taken: set[str] = set()
    out = []
    for name in names:
        candidate, n = name, 0
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        out.append(candidate)
    return out


def standardise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[standard_name(c) for c in df.columns])


def sanitise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(sanitized_name(c) for c in df.columns))


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Keep the first of several equally named columns; selection is by position."""
    placeholders = [f"_c{i}" for i in range(len(df.columns))]
    first: dict[str, str] = {}
    for slot, name in zip(placeholders, df.columns):
        first.setdefault(name, slot)
    return df.toDF(*placeholders).select(*[F.col(slot).alias(name) for name, slot in first.items()])


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """First candidate present exactly, else present ignoring case."""
    lowered = {}
    for c in df.columns:
        lowered.setdefault(c.lower(), c)
    for wanted in candidates:
        if wanted in df.columns:
            return wanted
        if wanted.lower() in lowered:
            return lowered[wanted.lower()]
    return None
