"""T: text, entity and vector search; profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search as se
from ..operators.joins import attach_scalars
from ..plans import clinical_views as cv
from ..plans.staging import stage
from .book import Book
from .sqlkit import define

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def _grams_sql(c: str) -> str:
    t = f"lower(trim({c}))"
    return f"CASE WHEN length({t}) < 3 THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3))) END"


_A, _B = tx.coefficients()
define("q_values", "SELECT DISTINCT value FROM (SELECT p_name AS value FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier) q")
define("q_grams", f"SELECT value, {_grams_sql('value')} AS grams FROM q_values")
define("q_keyword", "SELECT DISTINCT upper(p_name) AS keyword FROM part UNION SELECT replace(n_name, '_', '') FROM nation")
define("q_kgrams", f"SELECT keyword, {_grams_sql('keyword')} AS kg FROM q_keyword")
_W = lambda i: f"CAST('0x' || substr(md5(s), {8 * i + 1}, 8) AS BIGINT)"
define("q_coef", "SELECT unnest(" + str(_A) + ") AS a, unnest(" + str(_B) + f") AS b, unnest(range({tx.PERMUTATIONS})) AS i")


def _sig(table: str, key: str, grams: str) -> str:
    return (
        f"SELECT {key}, i, min((CAST(a AS BIGINT) * h + b) % {tx.PRIME}) AS m FROM (SELECT {key}, (8 * {_W(0)} + 4 * {_W(1)} + 2 * {_W(2)} + {_W(3)}) % {tx.PRIME} AS h "
        f"FROM (SELECT {key}, unnest({grams}) AS s FROM {table}) g) x, q_coef GROUP BY {key}, i"
    )


define("q_sig", _sig("q_grams", "value", "grams"))
define("q_ksig", _sig("q_kgrams", "keyword", "kg"))
define("q_bands", "SELECT value, i // 4 AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS bucket FROM q_sig GROUP BY 1, 2")
define("q_kbands", "SELECT keyword, i // 4 AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS bucket FROM q_ksig GROUP BY 1, 2")
define("q_cand", "SELECT DISTINCT keyword, value FROM q_kbands JOIN q_bands USING (band, bucket)")
define(
    "q_jac",
    "SELECT keyword, value, len(list_intersect(kg, grams)) * 1.0::DOUBLE / (len(kg) + len(grams) - len(list_intersect(kg, grams))) AS jaccard "
    "FROM q_cand JOIN q_kgrams USING (keyword) JOIN q_grams USING (value)",
)
define("q_lsh", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY jaccard DESC, value) AS rank FROM q_jac WHERE jaccard >= 0.3) q")


def _tables(spark, sf_dir):
    return {
        "part": cv.table(spark, sf_dir, "part").select("p_name", "p_brand"),
        "customer": cv.table(spark, sf_dir, "customer").select("c_name"),
        "nation": cv.table(spark, sf_dir, "nation").select("n_name"),
        "supplier": cv.table(spark, sf_dir, "supplier").select("s_name"),
    }


def _index(spark, sf_dir):
    return se.value_index(_tables(spark, sf_dir))


def _keywords(spark, sf_dir):
    parts = cv.table(spark, sf_dir, "part").select(F.upper("p_name").alias("keyword"))
    nations = cv.table(spark, sf_dir, "nation").select(F.replace("n_name", F.lit("_"), F.lit("")).alias("keyword"))
    return parts.union(nations).distinct()


def _values(spark, sf_dir):
    return _index(spark, sf_dir).select("value").distinct()


@book.add("t01_shingles", "SELECT value, array_to_string(list_sort(grams), '|') AS grams FROM q_grams")
def t01(spark, sf_dir):
    return _values(spark, sf_dir).select("value", F.concat_ws("|", F.array_sort(tx.shingles("value"))).alias("grams"))


@book.add("t02_minhash", "SELECT value, CAST(sum(m * (i + 1)) AS BIGINT) AS check_sum, CAST(min(m) AS BIGINT) AS smallest FROM q_sig GROUP BY value")
def t02(spark, sf_dir):
    signed = se.with_signature(_values(spark, sf_dir))
    weighted = F.expr("aggregate(transform(signature, (m, i) -> m * (i + 1)), 0L, (s, x) -> s + x)")
    return signed.select("value", weighted.alias("check_sum"), F.array_min("signature").alias("smallest"))


@book.add("t03_bands", "SELECT band, count(DISTINCT bucket) AS buckets, count(*) AS n FROM q_bands GROUP BY band")
def t03(spark, sf_dir):
    rows = se.banded(se.with_signature(_values(spark, sf_dir)), "value")
    return rows.groupBy(F.col("band").cast("long").alias("band")).agg(F.countDistinct("bucket").alias("buckets"), F.count(F.lit(1)).alias("n"))


@book.add("t04_lsh_search", "SELECT keyword, value, round(jaccard, 6) AS jaccard, rank FROM q_lsh WHERE rank <= 10")
def t04(spark, sf_dir):
    return se.lsh_search(_index(spark, sf_dir), _keywords(spark, sf_dir), 10).withColumn("jaccard", F.round("jaccard", 6))


@book.add("j10_band_join", "SELECT keyword, count(*) AS candidates FROM q_jac WHERE jaccard >= 0.3 GROUP BY keyword")
def j10(spark, sf_dir):
    return se.lsh_candidates(_index(spark, sf_dir), _keywords(spark, sf_dir)).groupBy("keyword").agg(F.count(F.lit(1)).alias("candidates"))


@book.add(
    "j10_similar_values",
    "SELECT keyword, value, round(jaccard, 6) AS jaccard, banded FROM (SELECT keyword, value, len(list_intersect(kg, grams)) * 1.0::DOUBLE / "
    "(len(kg) + len(grams) - len(list_intersect(kg, grams))) AS jaccard, (keyword, value) IN (SELECT (keyword, value) FROM q_cand) AS banded FROM q_kgrams, q_grams "
    "WHERE least(len(kg), len(grams)) * 2 >= greatest(len(kg), len(grams))) j WHERE jaccard >= 0.5",
)
def j10_exact(spark, sf_dir):
    """All pairs at a similarity of 0.5 or more, and whether the bands met the pair too."""
    values, keywords = _values(spark, sf_dir), _keywords(spark, sf_dir)
    banded = se.lsh_candidates(_index(spark, sf_dir), keywords).select("keyword", "value", F.lit(True).alias("banded"))
    found = se.similar_values(values, keywords, 50).join(banded, ["keyword", "value"], "left")
    return found.select("keyword", "value", F.round("jaccard", 6).alias("jaccard"), F.coalesce("banded", F.lit(False)).alias("banded"))


define("q_own", f"SELECT doc_id, source || ' ' || lang AS a, lang || ' ' || source AS b, {_grams_sql('source || chr(32) || lang')} AS ga, {_grams_sql('lang || chr(32) || source')} AS gb FROM documents")


@book.add(
    "t05_jaccard",
    "SELECT doc_id, round(len(list_intersect(ga, gb)) * 1.0::DOUBLE / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS jaccard FROM q_own",
)
def t05(spark, sf_dir):
    d = cv.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("a"), F.concat_ws(" ", "lang", "source").alias("b"))
    grams = d.select("doc_id", tx.shingles("a").alias("ga"), tx.shingles("b").alias("gb"))
    return grams.select("doc_id", F.round(tx.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))


@book.add(
    "t06_edit_similarity",
    "SELECT p_partkey, round(1.0 - levenshtein(lower(p_name), lower(p_type || ' ' || p_brand)) * 1.0::DOUBLE / greatest(length(p_name), length(p_type || ' ' || p_brand)), 6) AS similarity FROM part",
)
def t06(spark, sf_dir):
    p = cv.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand").alias("other"))
    return p.select("p_partkey", F.round(tx.edit_similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


@book.add(
    "t06_edit_join",
    "SELECT keyword, value, CAST(d AS INT) AS distance FROM (SELECT keyword, value, levenshtein(lower(keyword), lower(value)) AS d FROM q_keyword, q_values "
    "WHERE abs(length(keyword) - length(value)) <= 3) x WHERE d <= 3",
)
def t06_join(spark, sf_dir):
    """Every value within three edits of a keyword."""
    return se.edit_join(_values(spark, sf_dir), _keywords(spark, sf_dir), 3)


define(
    "q_index",
    "SELECT DISTINCT * FROM (SELECT p_name AS value, 'part' AS table_name, 'p_name' AS column_name FROM part UNION ALL SELECT p_brand, 'part', 'p_brand' FROM part "
    "UNION ALL SELECT c_name, 'customer', 'c_name' FROM customer UNION ALL SELECT n_name, 'nation', 'n_name' FROM nation UNION ALL SELECT s_name, 'supplier', 's_name' FROM supplier) q "
    "WHERE length(value) BETWEEN 2 AND 199",
)


@book.add("t07_value_index", "SELECT * FROM q_index")
def t07(spark, sf_dir):
    return _index(spark, sf_dir)


_TEXT_COLUMNS = [
    (name, column.split()[0]) for name, schema in cv.TABLE_SCHEMAS.items() for column in schema.split(", ") if column.endswith(" string")
]


@book.add(
    "t07_value_index_all_tables",
    "SELECT table_name, column_name, count(*) AS n, min(value) AS first, max(value) AS last FROM ("
    + " UNION ALL ".join(f"SELECT DISTINCT {c} AS value, '{t}' AS table_name, '{c}' AS column_name FROM {t} WHERE length({c}) BETWEEN 2 AND 199" for t, c in _TEXT_COLUMNS)
    + ") q GROUP BY table_name, column_name",
)
def t07_all(spark, sf_dir):
    """The index of every text column of every table, summed up per column."""
    index = se.value_index({name: cv.table(spark, sf_dir, name) for name in cv.TABLE_SCHEMAS})
    return index.groupBy("table_name", "column_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last")
    )


def _entities_sql(k: int) -> dict[str, str]:
    return {
        "q_rated": "SELECT keyword, value, table_name, column_name, (jaccard + (1.0 - levenshtein(lower(keyword), lower(value)) * 1.0::DOUBLE / greatest(length(keyword), length(value)))) / 2 AS similarity "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY jaccard DESC, value, table_name, column_name) AS rank FROM q_jac JOIN q_index USING (value) WHERE jaccard >= 0.3) e WHERE rank <= {2 * k}",
        "q_best": "SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY round(similarity, 12) DESC, value, table_name, column_name) AS rank FROM q_rated",
    }


@book.add(
    "t08_entity_retrieval",
    "SELECT keyword, value, table_name, column_name, round(similarity, 6) AS similarity, rank FROM q_best WHERE rank <= 10",
    **_entities_sql(10),
)
def t08(spark, sf_dir):
    found = se.retrieve_entities(_index(spark, sf_dir), _keywords(spark, sf_dir), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@book.add("t09_batch_keywords", "SELECT keyword, count(*) AS matches FROM q_best WHERE rank <= 5 AND length(keyword) >= 2 GROUP BY keyword", **_entities_sql(5))
def t09(spark, sf_dir):
    short = cv.table(spark, sf_dir, "region").select(F.substring("r_name", 1, 1).alias("keyword"))
    found = se.retrieve_entities(_index(spark, sf_dir), _keywords(spark, sf_dir).union(short), 5)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("matches"))


_LOW = "lower(p_name || ' ' || p_brand)"
_WORDS = f"list_distinct(regexp_extract_all({_LOW}, '\\w+'))"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _share(c: str) -> str:
    total = f"greatest(1, length({_LOW}) - length(translate({_LOW}, '{_LETTERS}', '')))"
    return f"(length({_LOW}) - length(replace({_LOW}, '{c}', ''))) * 1.0::DOUBLE / {total}"


@book.add(
    "t11_text_vector",
    f"SELECT p_partkey, round(list_sum(list_transform({_WORDS}, lambda w: length(w))) * 1.0::DOUBLE / len({_WORDS}), 6) AS mean_word, "
    f"CAST(list_max(list_transform({_WORDS}, lambda w: length(w))) AS DOUBLE) AS longest, CAST(len({_WORDS}) AS DOUBLE) AS words, "
    f"round({_share('a')}, 6) AS share_a, round({_share('e')}, 6) AS share_e, round(" + " + ".join(f"{i + 1} * ({_share(c)})" for i, c in enumerate(_LETTERS)) + ", 6) AS letters, "
    + " + ".join(f"CASE WHEN contains({_LOW}, '{w}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for w in tx.TERMS)
    + " AS terms, CAST(42 AS INT) AS dims FROM part",
)
def t11(spark, sf_dir):
    p = cv.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("txt"))
    v = p.select("p_partkey", tx.text_vector("txt").alias("v"))
    letters = F.expr("aggregate(transform(slice(v, 4, 26), (x, i) -> x * (i + 1)), 0D, (s, x) -> s + x)")
    terms = F.expr("aggregate(slice(v, 30, 13), 0D, (s, x) -> s + x)")
    return v.select(
        "p_partkey", F.round(F.col("v")[0], 6).alias("mean_word"), F.col("v")[1].alias("longest"), F.col("v")[2].alias("words"),
        F.round(F.col("v")[3], 6).alias("share_a"), F.round(F.col("v")[7], 6).alias("share_e"), F.round(letters, 6).alias("letters"),
        terms.alias("terms"), F.size("v").alias("dims"),
    )


@book.add(
    "t12_cosine",
    "SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 5) AS similarity, "
    "round(list_dot_product(a.v[1:32], b.v[1:32]) / (sqrt(list_dot_product(a.v[1:32], a.v[1:32])) * sqrt(list_dot_product(b.v, b.v))), 5) AS padded FROM q_emb a JOIN q_emb b ON b.vec_id = a.vec_id + 1",
    q_emb="SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
)
def t12(spark, sf_dir):
    e = cv.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    both = e.join(nxt, "vec_id").withColumn("h", F.slice("v", 1, 32))
    return both.select("vec_id", F.round(tx.cosine("v", "w"), 5).alias("similarity"), F.round(tx.cosine("h", "w"), 5).alias("padded"))


_TOPK = (
    "SELECT query_id, id, rank, round(s, 5) AS similarity FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, b.vec_id) AS rank "
    "FROM q_emb q, q_emb b, LATERAL (SELECT list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))) AS s) l WHERE {w}) z WHERE rank <= 5"
)
_EMB = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def _vectors(spark, sf_dir):
    return cv.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


@book.add("t13_vector_top_k", _TOPK.format(w="q.label = 3"), q_emb=_EMB)
def t13(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("label = 3").select(F.col("vec_id").alias("query_id"), "vec")
    return se.vector_top_k(v.select(F.col("vec_id").alias("id"), "vec"), asked, 5).withColumn("similarity", F.round("similarity", 5))


@book.add("t13_vector_top_k_many_queries", _TOPK.format(w="TRUE"), q_emb=_EMB)
def t13_many(spark, sf_dir):
    """Every vector asks; blocks of both sides meet in bounded tasks."""
    v = _vectors(spark, sf_dir)
    asked = v.select(F.col("vec_id").alias("query_id"), "vec")
    found = se.vector_top_k(v.select(F.col("vec_id").alias("id"), "vec"), asked, 5, query_block=200)
    return found.withColumn("similarity", F.round("similarity", 5))


@book.add("t13_vector_bucketed")
def t13_bucketed(spark, sf_dir):
    """Every twentieth vector asks all: the index's answers with their similarity and rank, the share of all vectors
    that was met, and the share of the exact answers that the index found over all queries."""
    v = _vectors(spark, sf_dir)
    base = v.select(F.col("vec_id").alias("id"), "vec")
    asked = stage(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec"), "asked")
    exact = se.vector_top_k(base, asked, 5).select("query_id", "id")
    found = stage(se.bucketed_top_k(base, asked, 5), "found")
    recall = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    met = (F.col("candidates") / F.col("n")).alias("met")
    whole = attach_scalars(attach_scalars(found, recall), base.agg(F.count(F.lit(1)).alias("n")))
    return whole.select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank", met, "recall")


_PAGES = {
    "sitenumber": ("string", "site"), "formname": ("string", None), "days_missing": ("double", "age"),
    "subjectname": ("string", None), "foldername": ("string", None), "visit_date": ("string", None), "country": ("string", None),
}


def _samples_sql(column, view, k):
    return f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v FROM {view} WHERE {column} IS NOT NULL ORDER BY v LIMIT {k}) s)"


@book.add(
    "t14_table_profile",
    " UNION ALL ".join(
        f"SELECT 'pages' AS table_name, '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS null_count, count(*) AS row_count, "
        f"{'NULL' if d is None else repr(d)} AS description, array_to_string({_samples_sql(c, 'v_pages', 3)}, '|') AS samples FROM v_pages"
        for c, (t, d) in _PAGES.items()
    ),
)
def t14(spark, sf_dir):
    df = cv.missing_pages(spark, sf_dir, list(_PAGES))
    notes = spark.createDataFrame(
        [("pages", c, d) for c, (_, d) in _PAGES.items() if d], "table_name string, column_name string, description string"
    )
    profile = se.table_profile(df, "pages", notes)
    return profile.select("table_name", "column_name", "data_type", "null_count", "row_count", "description", F.array_join("samples", "|").alias("samples"))


@book.add(
    "t18_result_statistics",
    "SELECT 'subject' AS \"column\", count(*) AS n, 'categorical' AS type, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg, count(DISTINCT subject) AS unique_count, array_to_string(" + _samples_sql("subject", "v_edrr", 5) + ", '|') AS samples FROM v_edrr "
    "UNION ALL SELECT 'issue_count', count(*), 'numeric', min(total_open_issue_count_per_subject)::DOUBLE, max(total_open_issue_count_per_subject)::DOUBLE, round(avg(total_open_issue_count_per_subject), 6), NULL, NULL FROM v_edrr",
)
def t18(spark, sf_dir):
    df = cv.issues(spark, sf_dir).select("subject", F.col("total_open_issue_count_per_subject").cast("string").alias("issue_count"))
    return se.result_statistics(df).withColumn("avg", F.round("avg", 6)).withColumn("samples", F.array_join("samples", "|"))
