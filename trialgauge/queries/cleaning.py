"""C: cleaning, projection, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import cleaning as cl
from ..plans import clinical_views as cv
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def _raw_lines(spark, sf_dir):
    """Line items under untidy source headings."""
    return cv.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(" Site Number "),
        F.col("l_quantity").alias("# Days Outstanding"),
        F.col("l_returnflag").alias("Status"),
    )


@book.add(
    "c01_standardise_names",
    "SELECT l_suppkey AS site_number, sum(l_quantity) AS __days_outstanding, count(l_returnflag) AS status FROM lineitem GROUP BY l_suppkey",
)
def c01(spark, sf_dir):
    df = naming.standardise_columns(_raw_lines(spark, sf_dir))
    return df.groupBy("site_number").agg(F.sum("__days_outstanding").alias("__days_outstanding"), F.count("status").alias("status"))


@book.add(
    "c02_sanitise_identifiers",
    "SELECT l_suppkey AS col_1st_site, max(l_quantity) AS days_outstanding FROM lineitem GROUP BY l_suppkey",
)
def c02(spark, sf_dir):
    df = cv.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("1st Site"), F.col("l_quantity").alias("# Days Outstanding ")
    )
    df = naming.sanitise_columns(df)
    return df.groupBy("col_1st_site").agg(F.max("days_outstanding").alias("days_outstanding"))


@book.add(
    "c03_unique_names",
    "SELECT sum(l_quantity) AS value, sum(l_tax) AS value_1, sum(l_discount) AS value_2 FROM lineitem",
)
def c03(spark, sf_dir):
    df = naming.sanitise_columns(cv.table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("Value"), F.col("l_tax").alias("Value!"), F.col("l_discount").alias("value")
    ))
    return df.agg(*[F.sum(c).alias(c) for c in df.columns])


@book.add("c04_first_of_each_name", "SELECT sum(l_quantity) AS amount, count(l_suppkey) AS site FROM lineitem")
def c04(spark, sf_dir):
    df = naming.first_of_each_name(cv.table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("amount"), F.col("l_suppkey").alias("site"), F.col("l_tax").alias("amount")
    ))
    return df.agg(F.sum("amount").alias("amount"), F.count("site").alias("site"))


def _sparse(spark, sf_dir):
    line = cv.table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_suppkey").alias("site"),
        F.when(F.col("l_quantity") > 49, F.col("l_quantity")).alias("rare"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("half"),
        F.lit(None).cast("string").alias("empty"),
    )


@book.add(
    "c05_drop_near_empty",
    "SELECT count(*) AS row_count, count(CASE WHEN l_quantity > 25 THEN 1 END) AS half, 'site,half' AS kept FROM lineitem",
)
def c05(spark, sf_dir):
    df = cl.drop_near_empty_columns(_sparse(spark, sf_dir))
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count("half").alias("half"), F.lit(",".join(df.columns)).alias("kept"))


@book.add(
    "c06_drop_all_null",
    "SELECT count(*) AS row_count, 'rare,half' AS kept FROM lineitem WHERE l_quantity > 25",
)
def c06(spark, sf_dir):
    df = cl.drop_all_null(_sparse(spark, sf_dir).drop("site"))
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(",".join(df.columns)).alias("kept"))


@book.add("c07_row_dedupe", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def c07(spark, sf_dir):
    return cv.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()


@book.add(
    "c08_date_coercion",
    "SELECT count(*) AS row_count, count(CASE WHEN l_linenumber <> 7 THEN 1 END) AS good_dates, "
    "strftime(max(CASE WHEN l_linenumber <> 7 THEN l_shipdate END), '%Y-%m-%d') AS last_date FROM lineitem",
)
def c08(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 7, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    df = cl.coerce_dates(cv.table(spark, sf_dir, "lineitem").select(text.alias("visit_date")))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("visit_date").alias("good_dates"),
        F.date_format(F.max("visit_date"), "yyyy-MM-dd").alias("last_date"),
    )


@book.add(
    "c09_as_text",
    "SELECT CAST(l_suppkey AS VARCHAR) AS site, min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS first_seen FROM lineitem GROUP BY 1",
)
def c09(spark, sf_dir):
    df = cl.as_text(cv.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), "l_shipdate"), ["site", "l_shipdate"])
    return df.groupBy("site").agg(F.min("l_shipdate").alias("first_seen"))


@book.add(
    "c10_preprocess_chain",
    "SELECT count(*) AS row_count, count(visit_date) AS dated, 'site,visit_date,flag' AS kept FROM "
    "(SELECT DISTINCT l_suppkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS visit_date, "
    "l_linenumber = 7 AS bad, l_returnflag FROM lineitem) q",
)
def c10(spark, sf_dir):
    line = cv.table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 7, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    raw = line.select(
        F.col("l_suppkey").alias(" Site"), text.alias("Visit Date"), F.col("l_returnflag").alias("Flag"),
        F.when(F.col("l_quantity") > 49, 1).alias("Rare Column"), F.col("l_tax").alias("site"),
    )
    df = cl.preprocess(raw)
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count("visit_date").alias("dated"), F.lit(",".join(df.columns)).alias("kept"))


@book.add(
    "c11_quality_report",
    "WITH t AS (SELECT l_suppkey AS site, CASE WHEN l_quantity > 49 THEN l_quantity END AS rare, "
    "CASE WHEN l_quantity > 25 THEN l_quantity END AS half, CAST(NULL AS VARCHAR) AS empty FROM lineitem), "
    "u AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM t) x), n AS (SELECT count(*) AS c FROM t) "
    "SELECT v.*, round(v.missing * 100.0 / c, 2) AS percent, c AS row_count, CAST(4 AS BIGINT) AS column_count, "
    "c - d AS duplicate_rows FROM ("
    "SELECT 'site' AS \"column\", 'bigint' AS type, count(*) - count(site) AS missing FROM t UNION ALL "
    "SELECT 'rare', 'double', count(*) - count(rare) FROM t UNION ALL SELECT 'half', 'double', count(*) - count(half) FROM t "
    "UNION ALL SELECT 'empty', 'string', count(*) - count(empty) FROM t) v, u, n",
)
def c11(spark, sf_dir):
    return cl.quality_report(_sparse(spark, sf_dir))


@book.add("c12_column_resolution", "SELECT l_suppkey AS site, sum(l_quantity) AS days FROM lineitem GROUP BY l_suppkey")
def c12(spark, sf_dir):
    df = cv.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("SiteNumber"), F.col("l_quantity").alias("days_missing"))
    site = naming.resolve_column(df, ["site", "sitenumber"])
    days = naming.resolve_column(df, ["days_missing", "no___days_page_missing"])
    return df.groupBy(F.col(site).alias("site")).agg(F.sum(days).alias("days"))


@book.add(
    "c13_id_normalisation",
    "SELECT CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 3 = 1 THEN 'SITE ' || s_suppkey ELSE site END AS requested, "
    "site AS matched FROM v_sites",
)
def c13(spark, sf_dir):
    s = cv.sites(spark, sf_dir)
    loose = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).when(
        F.col("s_suppkey") % 3 == 1, F.concat(F.lit("SITE "), F.col("s_suppkey").cast("string"))
    ).otherwise(F.col("site"))
    return cl.match_ids(s.select(loose.alias("site")), s.select("site"), "site")


@book.add(
    "c13_prefixed_ids",
    "SELECT site, CASE WHEN starts_with(lower(CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE site END), 'site') THEN site ELSE 'Site ' || s_suppkey END AS full_id FROM v_sites",
)
def c13_prefix(spark, sf_dir):
    s = cv.sites(spark, sf_dir)
    loose = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), F.col("s_suppkey").cast("string"))).otherwise(F.col("site"))
    return s.select("site", cl.prefixed_id(loose, "Site").alias("full_id"))


@book.add(
    "c14_status_predicate",
    "SELECT site, count(*) FILTER (WHERE contains(lower(review_status), 'pending')) AS pending FROM v_esae GROUP BY site",
)
def c14(spark, sf_dir):
    df = cv.safety(spark, sf_dir, ["site", "review_status"])
    return df.groupBy("site").agg(F.count_if(cl.status_contains(F.col("review_status"), "Pending")).alias("pending"))


@book.add(
    "c15_default_fill",
    "SELECT s.site, CAST(coalesce(p, 0.0) AS DOUBLE) AS missing_pages_pct, 0.99::DOUBLE AS meddra_coding_rate FROM v_sites s LEFT JOIN "
    "(SELECT sitenumber, least(1.0, count(*) / 50.0) AS p FROM v_pages WHERE days_missing > 110 GROUP BY sitenumber HAVING count(*) > 2) q "
    "ON s.site = q.sitenumber",
)
def c15(spark, sf_dir):
    pages = cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"]).where("days_missing > 110")
    share = pages.groupBy(F.col("sitenumber").alias("site")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    share = share.select("site", F.least(F.lit(1.0), F.col("n") / 50.0).alias("missing_pages_pct"))
    filled = cl.fill_defaults(cv.sites(spark, sf_dir).select("site").join(share, "site", "left"))
    return filled.select("site", "missing_pages_pct", F.col("meddra_coding_rate").alias("meddra_coding_rate"))


@book.add(
    "c16_membership_filter",
    "SELECT study, count(*) AS subjects FROM v_edrr WHERE subject IN (SELECT patient_id FROM v_esae WHERE review_status LIKE 'Pending%') GROUP BY study",
)
def c16(spark, sf_dir):
    pending = cv.safety(spark, sf_dir, ["patient_id", "review_status"]).where(cl.status_contains(F.col("review_status"), "pending"))
    kept = cl.membership_filter(cv.issues(spark, sf_dir), pending.select(F.col("patient_id").alias("subject")), "subject")
    return kept.groupBy("study").agg(F.count(F.lit(1)).alias("subjects"))


@book.add(
    "c17_aged_filter",
    "SELECT sitenumber, count(*) AS aged FROM v_pages WHERE days_missing >= 30 GROUP BY sitenumber",
)
def c17(spark, sf_dir):
    df = cl.at_least(cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"]), "days_missing", 30)
    return df.groupBy("sitenumber").agg(F.count(F.lit(1)).alias("aged"))


