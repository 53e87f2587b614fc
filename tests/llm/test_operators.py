"""Each operator against its plain version: the small table, awkward rows, and planted cases."""

import base64
import gzip
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trialgauge.llm import (
    decontaminate, language, line_dedup, packing, quality_crf, quality_rules, secret_scan, sharding, simhash, suffix_dedup,
)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def odd_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    passage = " ".join(word() for _ in range(40))
    tail = " ".join(word() for _ in range(30))
    return [
        (1, passage), (2, passage), (3, passage + "\n" + tail), (4, tail + " " + passage[:60]), (5, None), (6, ""), (None, passage),
        (8, "\n\n \t"), (2, passage), (2, tail), (9, "x" * 300), (10, "x" * 260 + "y"), (11, "ab\x00" + "\x00" * 80), (12, "q\x00" + "\x00" * 70),
        (13, "One two"), (14, "one TWO"), (15, "é" * 60), (16, "🙂 " * 30), (None, None), (17, " ".join([passage] * 3)), (18, word() + " " + passage),
    ]


SCHEMA = "doc_id bigint, text string, start string, fp int, n_words int, _id string, source string, lang string"


def frame(spark, rows):
    """Rows with further columns, some named like those an operator makes."""
    return spark.createDataFrame([(*r, "s", 1, 2, "i", f"src{n % 3}", "en") for n, r in enumerate(rows)], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("rows", ["small", "odd", "none"])
class TestAgainstPlain:
    @pytest.fixture
    def table(self, rows, small):
        return {"small": small, "odd": odd_rows(), "none": []}[rows]

    def test_suffix_dedup(self, spark, table):
        df = suffix_dedup.cut_repeats(frame(spark, table))
        assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.cut_repeats(table), key=repr)

    def test_simhash(self, spark, table):
        df = simhash.simhash_components(frame(spark, table))
        assert got(df, "doc_id", "fingerprint", "component_id") == sorted(brute.components(table), key=repr)
        left = simhash.drop_near_duplicates(frame(spark, table))
        assert left.columns == frame(spark, table).columns
        assert left.count() == len({c for _, _, c in brute.components(table)})

    def test_contamination(self, spark, table):
        bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        bench += [(900, "abc"), (901, "one two"), (None, "one two"), (902, None), (903, "!!"), (904, " ".join(str(table[0][1] if table else "").split()[3:17]))]
        df = decontaminate.contamination(frame(spark, table), spark.createDataFrame(bench, "item_id bigint, text string"))
        want = sorted(brute.contamination(table, bench), key=repr)
        assert got(df, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
        clean = decontaminate.drop_contaminated(frame(spark, table), spark.createDataFrame(bench, "item_id bigint, text string"))
        assert clean.count() == sum(not w[-1] for w in want)

    def test_quality_rules(self, spark, table):
        df = quality_rules.quality_rules(frame(spark, table))
        columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got(df, *columns) == sorted(brute.counts(table), key=repr)
        assert df.where("base_failed and kept").count() == 0
        assert quality_rules.keep_good(frame(spark, table)).count() == df.where("kept").count()

    def test_secrets(self, spark, table):
        df = secret_scan.secret_scan(frame(spark, table))
        want = []
        for doc, text in table:
            n, joined = brute.base_secrets(text)
            want.append((doc, *n, brute.sha(joined)))
        assert got(df, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)

    def test_packing(self, spark, table):
        from tokenizers import Tokenizer
        import public_tokenizers

        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        tokenizer.encode_special_tokens = True
        ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in table]
        rows = packing.pack(frame(spark, table), with_ids=True).collect()
        # every document's ids, pieced together again
        pieces = sorted((r["doc_id"], r["doc_tokens"], r["start"], r["ids"]) for r in rows if r["doc_id"] not in (None, 2))
        whole: dict = {}
        for doc, n, start, part in pieces:
            assert start == len(whole.get(doc, []))
            whole[doc] = whole.get(doc, []) + part
        assert whole == {d: i for (d, _), i in zip(table, ids, strict=True) if d not in (None, 2)}
        assert sum(r["length"] for r in rows) == sum(map(len, ids))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        assert len(by) <= -(-sum(map(len, ids)) // packing.CAPACITY) * 1.01 + 1

    def test_row_wise_operators_return_every_row(self, spark, table):
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        for df in (
            quality_crf.line_quality(frame(spark, table), labels), language.identify(frame(spark, table)), sharding.shard(frame(spark, table)),
            line_dedup.drop_boilerplate(frame(spark, table)),
        ):
            assert sorted(map(repr, (r[0] for r in df.select("doc_id").collect()))) == sorted(repr(d) for d, _ in table)


def test_merge_is_a_sorted_merge_with_common_prefixes():
    rnd = random.Random(3)
    for _ in range(60):
        runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(suffix_dedup.LENGTH)) if rnd.random() < 0.5 else bytes([97] * rnd.randint(20, 49)).ljust(50, b"b")
                       for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(1, 9))]
        common = lambda a, b: next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        keys = [[int.from_bytes(x, "big") for x in r] for r in runs]
        same = [[0, *(common(a, b) for a, b in zip(r, r[1:]))] for r in runs]
        source, prefix = suffix_dedup.merge(keys, same)
        turn = [iter(r) for r in runs]
        merged = [next(turn[s]) for s in source]
        assert merged == sorted(x for r in runs for x in r)
        assert prefix.tolist() == [0, *(common(a, b) for a, b in zip(merged, merged[1:]))]


def test_every_long_string_has_one_anchor():
    rnd = np.random.default_rng(1)
    raw = rnd.choice(np.frombuffer(b"abc ", np.uint8), 5000)
    offs = np.array([0, 0, 30, 1200, 1250, 5000])
    found = suffix_dedup.anchors(raw, offs)
    starts = np.concatenate([np.arange(a - b, a + f - suffix_dedup.LENGTH + 1) for a, b, f in zip(*found)])
    want = np.concatenate([np.arange(a, max(a, b - suffix_dedup.LENGTH + 1)) for a, b in zip(offs[:-1], offs[1:])])
    assert sorted(starts) == sorted(want)


def test_long_rows_are_sampled_in_pieces(monkeypatch):
    rnd = np.random.default_rng(2)
    raw = rnd.choice(np.frombuffer(b"abcd", np.uint8), 9000)
    offs = np.array([0, 10, 400, 5000, 5049, 9000])
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 700)
    parts = list(suffix_dedup._sampled(raw, offs))
    starts = np.concatenate([np.arange(a - b, a + f - suffix_dedup.LENGTH + 1) for p in parts for a, b, f in zip(*p)])
    want = np.concatenate([np.arange(a, max(a, b - suffix_dedup.LENGTH + 1)) for a, b in zip(offs[:-1], offs[1:])])
    assert sorted(starts) == sorted(want)
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 1 << 20)
    whole = np.concatenate([p.at for p in suffix_dedup._sampled(raw, offs)])
    assert set(whole) == {a for p in parts for a in p.at}


def test_longest_repeats_are_those_of_all_pairs():
    rnd = random.Random(8)
    for _ in range(40):
        symbols = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 60))] + [99]
        want = [k if k >= 3 else 0 for k in brute.longest_repeat(symbols)]
        found = quality_rules.longest_repeats(np.array(symbols, np.uint64), 3)
        # depth is cut at a power of two first, so only passages of the full length count
        assert found.tolist() == want


def test_repeats_are_rejected_and_clean_text_stays(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    part = text(90)
    rows = [(1, text(300)), (2, f"{text(40)} {part} {text(60)} {part}"), (3, " ".join(["same words here"] * 50)), (4, f"{text(400)} {part[:300]} {text(400)} {part[:300]}")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True}


def test_links_of_crowded_entries(spark, monkeypatch):
    """Fingerprints around one centre: entries above the bound go through the ball of radius two."""
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(120)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    fps = list(fps)

    def parts(pairs):
        parent = {f: f for f in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in pairs:
            parent[root(u)] = root(v)
        groups: dict = {}
        for f in signed:
            groups.setdefault(root(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    want = parts([(signed[a], signed[b]) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    distinct = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    for entry in (1024, 8, 1):
        monkeypatch.setattr(simhash, "ENTRY", entry)
        assert parts([(r["u"], r["v"]) for r in simhash.links(distinct).collect()]) == want


def test_nested_secrets_are_found_at_the_outer_stretch(spark):
    key = "AKIA" + "Z9Y8X7W6V5U4T3S2"
    inner = f"password={key.lower()}xx"
    b64 = base64.b64encode(inner.encode()).decode()
    twice = base64.b64encode(f"see {b64} there".encode()).decode()
    packed = base64.b64encode(zlib.compress(("text " + inner).encode())).decode()
    zipped = base64.b64encode(gzip.compress(("more " + key).encode())).decode()
    url = "".join(f"%{b:02X}" for b in inner.encode())
    uni = "".join(f"\\u{ord(c):04x}" for c in key)
    texts = [f"a {x} b" for x in (b64, twice, packed, zipped, url, uni, url.replace("%", "%25"))]
    rows = secret_scan.secret_scan(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for r, text, kind in zip(rows, texts, ("assign", "assign", "assign", "access", "assign", "access", "assign"), strict=True):
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (0, 0, 0)
        assert f"{kind}:2:{len(text) - 2}" in r["spans"].split(","), text
        assert secret_scan.redact(text) == "a [secret] b"
    # long runs without a blank take time in proportion
    for run in ("z" * 400_000 + " 5%", "\\u" + "z" * 400_000, "%4" * 200_000):
        assert secret_scan.secret_row(run)[:3] == (0, 0, 0)
    loop = "%25" * 50
    assert secret_scan.secret_row(loop)[4] == ""


def test_minimum_bin_slack_fills_windows():
    rnd = random.Random(1)
    for capacity in (16, 50, 64):
        counts = {rnd.randint(1, capacity - 1): rnd.randint(1, 9) for _ in range(6)}
        used = packing.best_fill(counts, capacity)
        assert max(counts) in used and all(n <= counts[k] for k, n in used.items())
        reach = {max(counts)}
        for k, n in counts.items():
            for _ in range(n - (k == max(counts))):
                reach |= {r + k for r in reach if r + k <= capacity}
        assert sum(k * n for k, n in used.items()) == max(reach)
        left = dict(counts)
        for times, pattern in packing.plan(counts, capacity):
            assert sum(k * n for k, n in pattern.items()) <= capacity
            for k, n in pattern.items():
                left[k] -= n * times
        assert set(left.values()) == {0}


def test_shards_share_slots_evenly_and_move_little():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup(names, 997)
    sizes = np.bincount(table, minlength=10)
    assert sizes.sum() == 997 and sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup(names[:-1], 997)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 997 * 0.2
    # plain fill: at every turn the first free slot of the shard's own order
    owner, n = {}, len(names)
    order = [[(sharding._number(f"offset:{s}") + j * (sharding._number(f"skip:{s}") % 996 + 1)) % 997 for j in range(997)] for s in names]
    for turn in range(997):
        owner[next(x for x in order[turn % n] if x not in owner)] = turn % n
    assert [owner[i] for i in range(997)] == table
    with pytest.raises(ValueError):
        sharding.lookup(names, 1000)


def test_every_key_is_placed_by_the_table(spark):
    import hashlib

    rows = sharding.shard(frame(spark, [(i, "x") for i in range(300)] + [(None, "x")])).collect()
    table = sharding.lookup(sharding.SHARDS)
    for r in rows:
        slot = int(hashlib.md5(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()).hexdigest()[:12], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table[slot]])


def test_boilerplate_stays_only_in_its_first_document(spark):
    line = "All rights reserved by the owner."
    rows = [(i, f"own text {i}\n  {line}\nend {i}") for i in range(20)] + [(30, line), (31, None), (32, "")]
    df = spark.createDataFrame([(d, t, f"s{d % 12}", "x") for d, t in rows] + [(None, line, "s1", "y")], "doc_id bigint, text string, source string, n_removed string")
    out = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_removed"] == 0
    assert out[7]["text"] == "own text 7\nend 7" and out[7]["n_removed"] == 1
    assert out[30]["text"] == "" and out[31]["text"] is None and out[32]["text"] == "" and out[None]["text"] == ""
    few = line_dedup.drop_boilerplate(df.where("doc_id < 9"))
    assert few.where("n_removed > 0").count() == 0
    exact = line_dedup.drop_boilerplate(df.where("doc_id < 10"))
    assert exact.where("n_removed > 0").count() == 9


def test_mixed_language_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    en, de = (docs.where(F.col("lang") == x).orderBy(F.length("text").desc()).first()["text"][:600] for x in ("en", "de"))
    both = docs.union(spark.createDataFrame([(-1, f"{en} {de} {de}", None), (-2, "123 ... !!", "en"), (-3, None, "en"), (-4, "ቋንቋ 𝒜𐌰", None)], "doc_id bigint, text string, lang string"))
    rows = language.identify(both).where("doc_id < 0").collect()
    mixed = {r["doc_id"]: r for r in rows}
    assert mixed[-1]["lang_pred"] == "de" and [s["lang"] for s in mixed[-1]["spans"]] == ["en", "de"]
    assert mixed[-4]["lang_pred"] in ("de", "en", "es", "fr") and mixed[-4]["n_letters"] == 5
    assert mixed[-2]["lang_pred"] == mixed[-3]["lang_pred"] == "und" and mixed[-3]["score"] == 0


def test_language_and_quality_on_held_out_folds(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    told = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    scored = quality_crf.line_quality(docs, labels).where("held_out").join(labels, "doc_id")
    good, bad = (scored.where(F.col("quality") == q).agg(F.avg("predicted")).first()[0] for q in (1, 0))
    assert good > 0.97 and bad < 0.1


def test_without_labels_nothing_is_learned(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality_crf.line_quality(docs, none).collect()} == {0.5}
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_the_added_token_in_a_text_is_its_own_id(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|", "<|ENDOFTEXT|> é", " <|endoftext|>  x"]
    rows = packing.pack(frame(spark, list(enumerate(texts))), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [3826, 220, 50256, 994]


def test_secrets_in_nested_and_broken_layers_are_found(monkeypatch):
    secret = b"password=abcdef123xyz"
    noise = random.Random(6).randbytes(300_000)
    b64 = lambda data: base64.b64encode(data).decode()
    texts = [
        b64(gzip.compress(gzip.compress(secret))), b64(zlib.compress(gzip.compress(zlib.compress(secret)))),
        b64(gzip.compress(b"first member ") + gzip.compress(secret)), b64(gzip.compress(bytes(40 << 20) + b" " + secret)),
        b64(b"\x00\xff \x01 " + secret), "x=caf%E9/password%3Dabcdef123", b64(gzip.compress(noise + b" " + secret)),
        b64(gzip.compress(b"see " + secret + noise)[:-9]), "\\ud800" + "".join(f"\\u{c:04x}" for c in secret),
    ]
    for text in texts:
        assert f"assign:2:{len(text) + 2}" in secret_scan.secret_row(f"a {text} b")[4].split(","), text[:60]
    # a stretch of plain letters is no layer
    assert secret_scan.secret_row("a Donaudampfschifffahrtsgesellschaft b")[4:] == ("", 0)


def test_secrets_beside_escapes_and_in_other_forms():
    hidden = "abcdef123xyz"
    u = "".join(f"\\u{ord(c):04x}" for c in hidden)
    pct = "".join(f"%{ord(c):02x}" for c in hidden)
    noise = "".join(random.Random(1).choice("abcdefgh \n") for _ in range(2000)).encode()
    lines = lambda data: base64.encodebytes(data).decode().rstrip("\n")
    cases = [
        (f'{{"password": "{u}"}}', 2), (f'password: "{pct}"', 0), ("password+%3D+abcdef123xyz", 0), (f"pass\\x77ord={hidden}", 0), (f"pass\\u{{77}}ord={hidden}", 0),
        (f"pass\\U00000077ord={hidden}", 0), (f"pass&#119;ord={hidden}", 0), (f"pass&#x77;ord={hidden}", 0), (f"pa%73sword%20=%20{hidden}", 0),
        (f"password = \\u0022{hidden}", 0), (f"password: &#34;\\u0061bcdef123", 0), (f"password: %2561bc%2564efg{hidden}", 0),
        (lines(noise[:60] + b" password=" + hidden.encode() + b" " + noise), 0), (lines(gzip.compress(noise + b" password=" + hidden.encode())), 0),
    ]
    for text, start in cases:
        spans = [x.split(":") for x in secret_scan.secret_row(f"a\n{text}\nb")[4].split(",") if x]
        assert any(k == "assign" and (start is None or int(a) == 2 + start) for k, a, _ in spans), (text[:60], spans)
    for text, start in cases[:2]:
        spans = secret_scan.secret_row(text)[4].split(",")
        assert f"assign:{start}:{len(text) - text.count('}') - 1}" in spans
    assert secret_scan.secret_row("password: 100%25 sure, &#8212; and \\u00e9")[4] == ""
    for run in ("%41" * 100_000, "\\x41" * 50_000, "&#65;" * 50_000, ("A" * 76 + "\n") * 3000):
        secret_scan.secret_row(run)
