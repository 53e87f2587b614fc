"""The pipeline's stages against plain versions, each on what the stage before kept."""

import math
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_near_copies import grouped
from tests.llm.test_operators import odd_rows
from trialgauge.llm import line_dedup, quality_rules
from trialgauge.plans.staging import stage

SF = "/root/testdata/sf0.001"


def text_hash(text):
    """Of rows that tie in their id the one with the smaller hash of its text counts."""
    signed = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return signed - (1 << 64) if signed >> 63 else signed


def kept_by_rules(rows):
    limits = quality_rules.Limits()
    out = []
    for row, (_, n, _, _, _, n_repeat, failed) in zip(rows, brute.counts([r[:2] for r in rows]), strict=True):
        words = brute.NO_BLANK.findall(row[1] or "")
        grams = defaultdict(list)
        for i in range(n - 7):
            grams[tuple(words[i : i + 8])].append(i)
        inside = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        too_much = 100 * sum(len(words[j].encode()) for j in inside) > limits.max_char_percent * sum(len(w.encode()) for w in words)
        size = max(limits.max_longest + 1, math.floor(n * limits.max_longest_percent / 100) + 1)
        long = [tuple(words[i : i + size]) for i in range(n - size + 1)]
        if not failed and not too_much and len(set(long)) == len(long):
            out.append(row)
    return out


def without_boilerplate(rows):
    how = line_dedup.Spread()
    sites, first = defaultdict(set), {}
    key = lambda line: line.strip(" ")
    order = lambda i: brute.LAST if i is None else i
    for i, text, source in ((r[0], r[1], r[3]) for r in rows):
        for line in text.split("\n") if text is not None else ():
            if len(key(line)) >= how.min_chars:
                sites[key(line)] |= {source} - {None}
                first[key(line)] = min(first.get(key(line), brute.LAST), order(i))
    bad = {k for k, s in sites.items() if len(s) >= how.min_sites}
    out = []
    for i, text, lang, source, _ in rows:
        left = text if text is None else "\n".join(x for x in text.split("\n") if key(x) not in bad or first[key(x)] == order(i))
        out.append((i, left, lang, source, None if left is None else len(left)))
    return out


def one_of_each(rows):
    """The row with the smallest id of each group that similar pairs join; of rows with one id the smallest text hash."""
    groups = grouped([r[:2] for r in rows])
    best: dict = {}
    for n, row in enumerate(rows):
        key = (brute.LAST if row[0] is None else row[0], text_hash(row[1]))
        best[groups[n]] = min(best.get(groups[n], (key, row)), (key, row), key=lambda x: x[0])
    return [row for _, row in best.values()]


def uncontaminated(rows, bench):
    return [r for r, found in zip(rows, brute.contamination([r[:2] for r in rows], bench), strict=True) if not found[-1]]


@pytest.mark.parametrize("which", ["small", "odd", "none"])
def test_stages(spark, which):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if which == "small":
        start = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in schema.split(", ")]).collect()]
    else:
        own = [(i, t) for n, (i, t) in enumerate(odd_rows()) if (i, n) not in ((2, 9),)] if which == "odd" else []
        start = [(i, t, "en", None if n % 5 == 0 else f"s{n % 13}", len(t or "")) for n, (i, t) in enumerate(own)]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.createDataFrame(start, schema)
    rows = start
    plain = (kept_by_rules, without_boilerplate, one_of_each, lambda r: uncontaminated(r, bench))
    for (name, step), slow in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        docs = stage(step(spark, docs, SF), "stage")
        rows = slow(rows)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert sorted(map(repr, (tuple(r) for r in docs.collect()))) == sorted(map(repr, rows)), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r[0] for r in rows}
    assert packed.where(F.col("start") == 0).count() == len(rows)


def test_the_whole_run_reads_every_document(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.columns[:1] == ["doc_id"] and packed.count() > 0
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
