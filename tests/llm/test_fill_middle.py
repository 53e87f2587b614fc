"""Fill-in-the-middle outputs against a plain version, and exact round trips."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_operators import SF, frame, got, odd_rows
from trialgauge.llm import fill_middle

COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def long_rows():
    rnd = random.Random(9)
    text = "".join(rnd.choice(["ab", "é", " ", "🙂", "<", "P>", "x" * 50, "\n", "<P"]) for _ in range(60_000)).replace("<P>", "<p>")
    return [(i, t) for i, t in enumerate([text, text[::-1].replace("<P>", ""), "q" * 400_000, "é" * 200_000, "a<P>b", "<S>", "<", "<P", "x" * 65536, "x" * 65537])] * 2


@pytest.mark.parametrize("which", ["small", "odd", "long", "none"])
def test_outputs_and_digests(spark, which):
    rows = {
        "small": lambda: [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()],
        "odd": odd_rows, "long": long_rows, "none": list,
    }[which]()
    want = brute.fill_middle(rows)
    table = frame(spark, rows).withColumnsRenamed({"fp": "_key", "n_words": "place", "_id": "form"})
    assert got(fill_middle.fill_middle(table), *COLUMNS) == sorted((w[:-1] for w in want), key=repr)
    outputs = [tuple(r) for r in fill_middle.outputs(table).collect()]
    assert sorted(outputs, key=repr) == sorted(((w[0], w[2], w[-1]) for w in want), key=repr)
    texts = sorted(t or "" for _, t in rows)
    assert sorted(fill_middle.restored(form, output) for _, form, output in outputs) == texts


def test_a_row_that_most_of_the_table_repeats(spark):
    rows = [(7, "one two, three")] * 300 + [(i, f"text {i}") for i in range(50)]
    assert got(fill_middle.fill_middle(frame(spark, rows).repartition(6)), *COLUMNS) == sorted((w[:-1] for w in brute.fill_middle(rows)), key=repr)


def test_sections_are_found_whatever_the_pieces():
    rnd = random.Random(4)
    for _, text in long_rows()[:4]:
        for form, output in (("psm", f"<P>{text[:999]}<S>{text[5000:]}<M>{text[999:5000]}"), ("spm", f"<S>{text[5000:]}<P>{text[:999]}<M>{text[999:5000]}")):
            raw = output.encode()[:9000]
            whole = fill_middle.restored(form, raw.decode(errors="ignore"))
            cuts = [0, *sorted(rnd.sample(range(len(raw)), 900)), len(raw.decode(errors="ignore").encode())]
            reader, parts = fill_middle._Restorer(form), [b"", b"", b""]
            for a, b in zip(cuts, cuts[1:]):
                for section, part in reader.feed(raw[a:b]):
                    parts[section] += part
            for section, part in reader.feed(b"", True):
                parts[section] += part
            assert b"".join(parts).decode() == whole


def test_units_start_where_the_pattern_says():
    for _, text in long_rows()[:2]:
        raw = np.frombuffer(text[:3000].encode(), np.uint8)
        want, at = [], 0
        for unit in brute.UNIT.findall(text[:3000]):
            want.append(at)
            at += len(unit.encode())
        assert fill_middle.unit_starts(raw, np.array([0, len(raw)])).tolist() == want
