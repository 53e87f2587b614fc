"""Registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, fill_middle, language, lexical_search, line_dedup, packing, quality_crf, quality_rules, secret_scan, sharding, simhash, suffix_dedup,
    web_archive,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.line_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), "doc_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents"), with_spans=False)
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_letters", "n_spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), "source")
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("_hash")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op11_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = web_archive.read_urls(web_archive.write_archive(spark, pages), pages.select("url"), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality_classifier, op3_simhash, op4_sharding, op5_language, op6_line_dedup, op7_decontamination,
        op8_packing, op9_secrets, op10_quality_rules, op11_web_archive, op12_lexical_search, op13_fill_middle,
    )
}

_SPREAD = line_dedup.Spread()
_LIMITS = quality_rules.Limits()
_NOT_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_suffix_dedup": """
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, unnest(range(0, greatest(0, length(x) // 2 - 49))) AS i, x FROM h),
        k AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS k FROM s),
        low AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
        r AS (SELECT doc_id, i FROM k JOIN low USING (k) WHERE first < doc_id),
        e AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
        cut AS (
            SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
                   string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
            FROM gaps JOIN h USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM h LEFT JOIN cut USING (doc_id)
    """,
    "op6_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, u.pos AS at, u.line, trim(u.line, ' ') AS k
            FROM documents, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10)))) AS t(x),
                 LATERAL (SELECT x[1] AS pos, x[2] AS line) AS u
        ), bad AS (
            SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= {_SPREAD.min_chars}
            GROUP BY k HAVING count(DISTINCT source) >= {_SPREAD.min_sites}
        ), kept AS (
            SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.first IS NOT NULL AND b.first <> l.doc_id) AS n_removed,
                   coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE b.first IS NULL OR b.first = l.doc_id), '') AS text
            FROM lines l LEFT JOIN bad b USING (k) GROUP BY l.doc_id
        )
        SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
               length(k.text)::BIGINT AS n_chars_left, sha256(k.text) AS kept_sha256
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
    "op7_decontamination": f"""
        WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark),
        bs AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM bs, unnest(range(1, len(w) - n + 2)) AS t(i)),
        d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
            FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)
        ),
        hit AS (SELECT * FROM dw WHERE k IN (SELECT k FROM bw)),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
        pairs AS (SELECT DISTINCT doc_id, item FROM hit JOIN bw USING (k)),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM pairs GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_quality_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}') AS w FROM documents),
        lines AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_NOT_SPACE}')] AS l FROM d),
        sizes AS (SELECT doc_id, w, 8 AS n, 'window' AS kind FROM d UNION ALL
                  SELECT doc_id, w, greatest({_LIMITS.max_longest} + 1, len(w) * {_LIMITS.max_longest_percent} // 100 + 1), 'long' FROM d),
        grams AS (SELECT doc_id, kind, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
        often AS (SELECT *, count(*) OVER (PARTITION BY doc_id, kind, k) AS times FROM grams),
        place AS (SELECT DISTINCT doc_id, j FROM often, unnest(range(i, i + n)) AS t(j) WHERE times > 1 AND kind = 'window'),
        run AS (SELECT p.doc_id, j, w[j] AS word, lag(j) OVER (PARTITION BY p.doc_id ORDER BY j) AS before FROM place p JOIN d USING (doc_id)),
        rep AS (
            SELECT doc_id, count(*) AS n_repeat, sum(strlen(word)) AS chars, count(*) FILTER (WHERE before IS NULL OR before < j - 1) AS spans
            FROM run GROUP BY doc_id
        ),
        long AS (SELECT DISTINCT doc_id, true AS long FROM often WHERE times > 1 AND kind = 'long'),
        base AS (
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
                   coalesce(list_sum([strlen(x) FOR x IN w]), 0) AS word_bytes,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
                   coalesce(chars, 0)::BIGINT AS repeat_chars, coalesce(spans, 0)::BIGINT AS repeat_spans, coalesce(long, false) AS long
            FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN long USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, repeat_spans,
               n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.max_percent} * n_words AS base_failed,
               NOT (n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.max_percent} * n_words)
               AND 100 * repeat_chars <= {_LIMITS.max_char_percent} * word_bytes AND NOT long AS kept
        FROM base
    """,
    "op11_web_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
        s AS (SELECT *, sha1(html) AS h FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)
                                FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM s
    """,
    "op12_lexical_search": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_TERM}') AS w FROM documents),
        c AS (SELECT count(*) FILTER (WHERE len(w) > 0)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d),
        q AS (SELECT item_id, unnest(regexp_extract_all({_FOLD}, '{_TERM}')) AS term FROM benchmark),
        qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        p AS (
            SELECT doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d)
            WHERE term IN (SELECT term FROM q) GROUP BY ALL
        ),
        df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
        s AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))))::BIGINT AS score
            FROM qt JOIN wt USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
    "op13_fill_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
        ),
        k AS (
            SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
        ),
        c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
        ),
        s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS x FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
                      ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM s
    """,
}
