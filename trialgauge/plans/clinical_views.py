"""The clinical tables as declarative views over the order-management test tables.

Site = supplier, country/study = the supplier's nation/region, subject = the
order's customer. Each view takes the columns the caller needs and adds only the
joins those columns require, so a site-level aggregate never shuffles ``orders``.
Dimension sides carry no broadcast hint: their size grows with the data, and
adaptive execution broadcasts them when they are measured to be small.

``row_ord`` is the explicit first-writer order of a source (no file order exists).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = "2001-12-31"


# Declared so that reading a table costs no schema-inference job.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


#: What the clinical views read.
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def source_paths(sf_dir: str) -> tuple[str, ...]:
    return tuple(f"{sf_dir}/{name}.parquet" for name in SOURCES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _age(col: str) -> Column:
    return F.datediff(F.lit(ANCHOR).cast("date"), F.col(col).cast("date"))


def _day(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey",
        F.col("n_name").alias("country"),
        F.concat(F.lit("Study "), F.col("n_regionkey").cast("string")).alias("study"),
        F.col("r_name").alias("region"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = geography(spark, sf_dir)
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return sup.join(geo, sup.s_nationkey == geo.n_nationkey).select(
        "s_suppkey", _site("s_suppkey").alias("site"), "country", "study", "region"
    )


def _site(col: str) -> Column:
    return F.concat(F.lit("Site "), F.col(col).cast("string"))


def _subject(col: str) -> Column:
    return F.concat(F.lit("Subject "), F.col(col).cast("string"))


def joined_lines(spark: SparkSession, sf_dir: str, pieces: int | None = None) -> DataFrame:
    """Every line with all that the views of lines take from its order, site and part: stage it once and hand it
    to several views. A line without a part keeps nulls there. Joins that move it run in ``pieces`` partitions."""
    by = lambda df, key: df.repartition(pieces, key) if pieces else df
    lines = table(spark, sf_dir, "lineitem").select(*sorted(_LINE_COLUMNS), "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # parts alone are dealt out: while they are few they are broadcast, later the lines follow into as many partitions
    out = lines.join(by(part, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left").drop("l_partkey")
    out = by(out, "l_orderkey").join(by(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    # dimension by dimension: each is small by its own size, while that of their join is not known beforehand
    out = out.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")
    out = out.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    study = F.concat(F.lit("Study "), F.col("n_regionkey").cast("string")).alias("study")
    return out.select(*[c for c in out.columns if c[:2] in ("l_", "o_", "p_")], F.col("n_name").alias("country"), study)


def _lines(
    spark: SparkSession,
    sf_dir: str,
    where: Column,
    wanted: set[str],
    outputs: dict[str, Column],
    part_filter: Column | None = None,
    spread_rows: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    if lines is not None:
        with_part = {"p_type", "p_brand"} & {dep for out in wanted for dep in _NEEDS.get(out, ())}
        base = lines.where(where)
        if with_part or part_filter is not None:
            base = base.where(F.col("p_partkey").isNotNull() if part_filter is None else F.col("p_partkey").isNotNull() & part_filter)
        return base.select(*[outputs[c].alias(c) for c in outputs if c in wanted])
    base = table(spark, sf_dir, "lineitem").where(where)
    if spread_rows:
        used = [c for c in base.columns if c in _LINE_COLUMNS]
        base = base.select(*used)
    geo_cols = {"country", "study", "region"}
    order_cols = {"subject", "priority"}
    part_cols = {"p_type", "p_brand"}
    needs = {dep for out in wanted for dep in _NEEDS.get(out, ())}
    if needs & geo_cols:
        dim = sites(spark, sf_dir).drop("site")
        base = base.join(dim, base.l_suppkey == dim.s_suppkey)
    if needs & order_cols:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        base = base.join(orders, base.l_orderkey == orders.o_orderkey)
    if needs & part_cols or part_filter is not None:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
        if part_filter is not None:
            part = part.where(part_filter)
        base = base.join(part, base.l_partkey == part.p_partkey)
    return base.select(*[outputs[c].alias(c) for c in outputs if c in wanted])


_LINE_COLUMNS = {
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
}

# which joined attribute each output column depends on
_NEEDS = {
    "country": ("country",),
    "study": ("study",),
    "study_id": ("study",),
    "study_name": ("study",),
    "subject": ("subject",),
    "patient_id": ("subject",),
    "subjectname": ("subject",),
    "visit": ("priority",),
    "foldername": ("priority",),
    "formname": ("p_brand",),
    "form_oid": ("p_brand",),
    "form_name": ("p_type",),
    "row_ord": (),
}


def _pick(columns: Iterable[str] | None, outputs: dict[str, Column], row_ord_from: Iterable[str]) -> set[str]:
    wanted = set(outputs) if columns is None else set(columns)
    unknown = wanted - set(outputs)
    if unknown:
        raise ValueError(f"unknown view columns: {sorted(unknown)}")
    return wanted


def _view(spark, sf_dir, where, columns, outputs, row_ord_from, part_filter=None, spread_rows=False, lines=None) -> DataFrame:
    wanted = _pick(columns, outputs, row_ord_from)
    fetch = wanted | set(row_ord_from) if "row_ord" in wanted else wanted
    out = _lines(spark, sf_dir, where, fetch - {"row_ord"}, {k: v for k, v in outputs.items() if v is not None}, part_filter, spread_rows, lines)
    if "row_ord" in wanted:
        out = out.withColumn("row_ord", F.concat_ws("|", *[F.col(c).cast("string") for c in row_ord_from]))
    return out.select(*[c for c in outputs if c in wanted])


def visits(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, spread_rows: bool = False, lines: DataFrame | None = None
) -> DataFrame:
    where = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N") & (F.col("l_quantity") <= 8)
    outputs = {
        "study": F.col("study"),
        "country": F.col("country"),
        "site": _site("l_suppkey"),
        "subject": _subject("o_custkey"),
        "visit": F.col("o_orderpriority"),
        "projected_date": _day("l_shipdate"),
        "days_outstanding": (_age("l_shipdate") % 61).cast("double"),
        "row_ord": None,
    }
    return _view(spark, sf_dir, where, columns, outputs, ("projected_date", "site", "subject", "visit"), None, spread_rows, lines)


def missing_pages(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, spread_rows: bool = False, lines: DataFrame | None = None
) -> DataFrame:
    where = (F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 6)
    outputs = {
        "study_name": F.col("study"),
        "country": F.col("country"),
        "sitenumber": _site("l_suppkey"),
        "subjectname": _subject("o_custkey"),
        "foldername": F.col("o_orderpriority"),
        "formname": F.col("p_brand"),
        "visit_date": _day("l_shipdate"),
        "days_missing": (_age("l_shipdate") % 121).cast("double"),
        "row_ord": None,
    }
    return _view(spark, sf_dir, where, columns, outputs, ("visit_date", "sitenumber", "subjectname", "foldername", "formname"), None, spread_rows, lines)


def safety(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, spread_rows: bool = False, lines: DataFrame | None = None
) -> DataFrame:
    where = F.col("l_quantity").between(10, 19)
    pending = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
    outputs = {
        "discrepancy_id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        "study_id": F.col("study"),
        "country": F.col("country"),
        "site": _site("l_suppkey"),
        "patient_id": _subject("o_custkey"),
        "form_name": F.col("p_type"),
        "created": _day("l_shipdate"),
        "review_status": F.when(pending, "Pending for Review").otherwise("Review Completed"),
        "action_status": F.when(F.col("l_returnflag") == "A", "No action required").otherwise("Pending"),
        "row_ord": None,
    }
    ordinal = ("created", "discrepancy_id", "site", "form_name", "review_status", "action_status")
    return _view(spark, sf_dir, where, columns, outputs, ordinal, None, spread_rows, lines)


def _coding(spark, sf_dir, columns, part_filter, spread_rows, lines) -> DataFrame:
    outputs = {
        "study": F.col("study"),
        "site": _site("l_suppkey"),
        "subject": _subject("o_custkey"),
        "form_oid": F.col("p_brand"),
        "logline": F.col("l_linenumber").cast("long"),
        "coding_status": F.when(F.col("l_tax") >= 0.08, "UnCoded Term").otherwise("Coded Term"),
        "require_coding": F.when(F.col("l_tax") >= 0.08, "Yes").otherwise("No"),
        "created": _day("l_shipdate"),
        "row_ord": None,
    }
    ordinal = ("created", "study", "subject", "form_oid", "logline", "coding_status")
    return _view(spark, sf_dir, F.lit(True), columns, outputs, ordinal, part_filter, spread_rows, lines)


def meddra(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, spread_rows: bool = False, lines: DataFrame | None = None
) -> DataFrame:
    return _coding(spark, sf_dir, columns, F.col("p_type").isin("ECONOMY", "MEDIUM"), spread_rows, lines)


def whodd(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, spread_rows: bool = False, lines: DataFrame | None = None
) -> DataFrame:
    return _coding(spark, sf_dir, columns, ~F.col("p_type").isin("ECONOMY", "MEDIUM"), spread_rows, lines)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject with open orders: study, subject, issue count."""
    counts = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "O")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("total_open_issue_count_per_subject"))
    )
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    geo = geography(spark, sf_dir).select("n_nationkey", "study")
    return (
        counts.join(cust, counts.o_custkey == cust.c_custkey)
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "study",
            _subject("o_custkey").alias("subject"),
            "total_open_issue_count_per_subject",
            _subject("o_custkey").alias("row_ord"),
        )
    )


def site_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site, study, country, region, subject count, pending-review count."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    subjects = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("l_suppkey")
        .agg(F.countDistinct("o_custkey").alias("subject_count"))
    )
    pending = (
        safety(spark, sf_dir, ["site", "review_status"])
        .where(F.col("review_status").startswith("Pending"))
        .groupBy("site")
        .agg(F.count(F.lit(1)).alias("open_queries"))
    )
    dim = sites(spark, sf_dir)
    return (
        dim.join(subjects, dim.s_suppkey == subjects.l_suppkey, "left")
        .join(pending, "site", "left")
        .select(
            "site",
            "study",
            "country",
            "region",
            F.coalesce("subject_count", F.lit(0)).cast("long").alias("subject_count"),
            F.coalesce("open_queries", F.lit(0)).cast("long").alias("open_queries"),
        )
    )


# ---- the same views as standard SQL, used as common table expressions by the oracles ----

_AGE = "date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-12-31')"
_DAY = "strftime(l_shipdate, '%Y-%m-%d')"
_JOIN = (
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN v_sites ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"
)

VIEW_SQL: dict[str, str] = {
    "v_sites": (
        "SELECT s_suppkey, 'Site ' || s_suppkey AS site, n_name AS country, "
        "'Study ' || n_regionkey AS study, r_name AS region "
        "FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    ),
    "v_visit": (
        "SELECT *, concat_ws('|', projected_date, site, subject, visit) AS row_ord FROM ("
        "SELECT study, country, site, 'Subject ' || o_custkey AS subject, o_orderpriority AS visit, "
        f"{_DAY} AS projected_date, CAST({_AGE} % 61 AS DOUBLE) AS days_outstanding {_JOIN} "
        "WHERE l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity <= 8) q"
    ),
    "v_pages": (
        "SELECT *, concat_ws('|', visit_date, sitenumber, subjectname, foldername, formname) AS row_ord FROM ("
        "SELECT study AS study_name, country, site AS sitenumber, 'Subject ' || o_custkey AS subjectname, "
        f"o_orderpriority AS foldername, p_brand AS formname, {_DAY} AS visit_date, "
        f"CAST({_AGE} % 121 AS DOUBLE) AS days_missing {_JOIN} "
        "WHERE l_returnflag = 'R' AND l_quantity <= 6) q"
    ),
    "v_esae": (
        "SELECT *, concat_ws('|', created, discrepancy_id, site, form_name, review_status, action_status) AS row_ord FROM ("
        "SELECT l_orderkey || '-' || l_linenumber AS discrepancy_id, study AS study_id, country, site, "
        f"'Subject ' || o_custkey AS patient_id, p_type AS form_name, {_DAY} AS created, "
        "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'Pending for Review' ELSE 'Review Completed' END AS review_status, "
        f"CASE WHEN l_returnflag = 'A' THEN 'No action required' ELSE 'Pending' END AS action_status {_JOIN} "
        "WHERE l_quantity BETWEEN 10 AND 19) q"
    ),
    "v_edrr": (
        "SELECT 'Study ' || n_regionkey AS study, 'Subject ' || o_custkey AS subject, "
        "count(*) AS total_open_issue_count_per_subject, 'Subject ' || o_custkey AS row_ord "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "WHERE o_orderstatus = 'O' GROUP BY n_regionkey, o_custkey"
    ),
    "v_coding": (
        "SELECT *, concat_ws('|', created, study, subject, form_oid, logline, coding_status) AS row_ord FROM ("
        "SELECT study, site, 'Subject ' || o_custkey AS subject, p_brand AS form_oid, "
        "CAST(l_linenumber AS BIGINT) AS logline, p_type, "
        "CASE WHEN l_tax >= 0.08 THEN 'UnCoded Term' ELSE 'Coded Term' END AS coding_status, "
        f"CASE WHEN l_tax >= 0.08 THEN 'Yes' ELSE 'No' END AS require_coding, {_DAY} AS created {_JOIN}) q"
    ),
    "v_meddra": "SELECT * FROM v_coding WHERE p_type IN ('ECONOMY', 'MEDIUM')",
    "v_whodd": "SELECT * FROM v_coding WHERE p_type NOT IN ('ECONOMY', 'MEDIUM')",
    "v_site_master": (
        "SELECT s.site, s.study, s.country, s.region, coalesce(subject_count, 0) AS subject_count, "
        "coalesce(open_queries, 0) AS open_queries FROM v_sites s "
        "LEFT JOIN (SELECT l_suppkey, count(DISTINCT o_custkey) AS subject_count FROM lineitem "
        "JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey) c ON s.s_suppkey = c.l_suppkey "
        "LEFT JOIN (SELECT site, count(*) AS open_queries FROM v_esae WHERE review_status LIKE 'Pending%' GROUP BY site) p "
        "ON s.site = p.site"
    ),
}
