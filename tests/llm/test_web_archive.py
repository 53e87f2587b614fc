"""Archives read back through the index, read front to back by another parser, and the index itself."""

import base64
import gzip
import hashlib
import json
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, got
from trialgauge.llm import web_archive as W

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
LAST = (1 << 63) - 1


def plain(pages, least=0):
    """Contract rows; pages that tie in id and payload are alike in them."""
    body = [(p, (h or "").encode()) for p, _, h in pages]
    seen: dict = {}
    for n, (p, b) in enumerate(body):
        key = (LAST if p is None else p, n)
        seen[b] = min(seen.get(b, key), key)
    out = []
    for n, (p, b) in enumerate(body):
        first = seen[b]
        again = len(b) >= least and first[1] != n
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((p, len(b), digest, "revisit" if again else "response", (None if first[0] == LAST else first[0]) if again else None))
    return sorted(out, key=repr)


def odd_pages():
    rnd = random.Random(2)
    pages = [(i, f"http://h{i % 4}.Example.org:80/p{i % 7}?q={i % 3}#f{i}", "same page" if i % 3 else f"<p>é {i}</p>") for i in range(90)]
    pages += [
        (100, None, None), (101, "", ""), (None, "http://x.org/", "same page"), (None, None, "unique"), (102, "ftp://u:p@a.b.c/x y\r\nz: 1", "\r\n\r\nbody\x00\n"),
        (103, "http://x.org/", "🙂" * 300_000), (5, "http://x.org/", "<p>twice</p>"), (5, "http://x.org/", "<p>twice</p>"), (104, "X.ORG", "z"), (105, "http://[::1]/", None),
        (-7, "//h.org?b", "<p>é 0</p>"), (106, "http://h.org/ü ", "WARC/1.0\r\n\r\n"),
    ]
    rnd.shuffle(pages)
    return pages


def table(spark, pages):
    return spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id bigint, url string, html string, number int, key string")


def members(path):
    """Every gzip member of a file, by a plain reader."""
    data = Path(path).read_bytes()
    while data:
        unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(data) + unpacker.flush()
        data = unpacker.unused_data


def folder_of(index):
    return Path(index.folder.removeprefix("file://"))


@pytest.mark.parametrize("which", ["small", "odd", "none"])
def test_pages_come_back_through_the_index(spark, which):
    pages = {"small": lambda: [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()], "odd": odd_pages, "none": list}[which]()
    df = table(spark, pages)
    index = W.write_archive(spark, df, block_lines=7)
    back = W.read_urls(index, df.select("url"))
    rows = back.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr) == plain(pages)
    # payloads of responses are the pages' own
    texts = {}
    for p, _, h in pages:
        texts.setdefault(p, set()).add((h or "").encode())
    assert all(bytes(r["payload"]) in texts[r["page_id"]] for r in rows if r["record_type"] == "response")
    # the same records front to back
    found = 0
    for file in folder_of(index).glob("*.warc.gz"):
        assert gzip.decompress(file.read_bytes())
        first, *rest = members(file)
        assert first.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n")
        for data in rest:
            head, _, block = data.partition(b"\r\n\r\n")
            size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
            assert block[size:] == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
            found += 1
    assert found == len(pages)


def test_the_index_is_sorted_blocks_under_a_sparse_directory(spark):
    pages = odd_pages() + [(1000 + i, "http://hot.org/one", f"v{i}") for i in range(300)]
    index = W.write_archive(spark, table(spark, pages), block_lines=5)
    keys = []
    for r in sorted(index.parts.collect(), key=lambda r: r["part"]):
        *blocks, directory = (m for m in members(folder_of(index) / r["file"]))
        lines = [[json.loads(x) for x in b.split(b"\n")] for b in blocks]
        entries = json.loads(directory)
        assert [e[0] for e in entries] == [b[0][0] for b in lines] and all(len(b) == 5 for b in lines[:-1])
        assert (r["first"], r["last"]) == (lines[0][0][0], lines[-1][-1][0])
        keys += [x[0] for b in lines for x in b]
    assert keys == sorted(keys) and len(keys) == len(pages)


def test_single_urls(spark):
    pages = odd_pages() + [(1000 + i, "http://hot.org/one", f"v{i}") for i in range(300)]
    index = W.write_archive(spark, table(spark, pages), block_lines=5)
    ask = lambda *urls: sorted((r["page_id"] for r in W.read_urls(index, spark.createDataFrame([(u,) for u in urls], "url string")).collect()), key=repr)
    assert ask("HTTPS://HOT.org/one#x", "http://nowhere.org/", "http://hot.org/on") == list(range(1000, 1300))
    assert ask("x.org", "x.org/") == sorted([None, 103, 5, 5, 104], key=repr)
    assert ask(None) == sorted([None, 100], key=repr) and ask("zzz", "aaa") == []
    assert ask("http://h1.example.org/p1?q=1") == sorted((p for p, u, _ in pages if u and "//h1.Example.org:80/p1?q=1#" in u), key=repr)


def test_small_payloads_can_stay_responses(spark):
    pages = odd_pages()
    df = table(spark, pages)
    index = W.write_archive(spark, df, min_revisit_bytes=10)
    assert got(W.read_urls(index, df, False), *COLUMNS) == plain(pages, 10)


def test_url_keys(spark):
    cases = {
        "http://www.a.example:80/x?y#z": "example,a,www)/x?y", "https://User:pw@B.c": "c,b)/", "//h.org?b": "org,h)?b", "a.b/c": "b,a)/c",
        "": ")/", "http://a.b/c:d@e": "b,a)/c:d@e", "mailto:x": "x)/",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", W.url_key(F.col("url"))).collect()
    assert dict(map(tuple, rows)) == cases
