"""S: sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import naming
from ..plans import clinical_views as cv
from ..plans import features as ft
from ..plans import quality_index as qi
from ..plans.staging import scratch_root, stage
from ..sources import readers, writers
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def _folder(spark, label: str) -> str:
    return f"{scratch_root(spark)}/trialgauge/{label}-{uuid.uuid4().hex}"


# Shapes of incoming file names; {n} is the study number.
FILE_SHAPES = [
    "Study {n}_Compiled_EDRR_updated.xlsx",
    "Study {n}_CPID_EDC_Metrics.xlsx",
    "Study {n} Global_Missing_Pages_Report_14 NOV 2025.xlsx",
    "Study {n}_GlobalCodingReport_MedDRA_updated.xlsx",
    "Study {n}_GlobalCodingReport_WHODD.xlsx",
    "Study {n}_eSAE Dashboard_Standard DM_Safety Report.xlsx",
    "Study {n} Visit Projection Tracker_3DEC2025.xlsx",
    "Study {n}_Inactivated Forms, Folders and Records.xlsx",
    "Study {n} Missing_Lab_Name.xlsx",
    "~$Study {n}_Compiled_EDRR_updated.xlsx",
    "2024 notes!.xlsx",
]


def _paths(spark, sf_dir):
    """One incoming file path per supplier."""
    shapes = F.array(*[F.lit(s) for s in FILE_SHAPES])
    s = cv.sites(spark, sf_dir)
    n = F.regexp_extract("study", r"(\d+)", 1)
    name = F.replace(F.element_at(shapes, (F.col("s_suppkey") % len(FILE_SHAPES) + 1).cast("int")), F.lit("{n}"), n)
    folder = F.when(F.col("s_suppkey") % 7 == 0, F.lit("Archive")).otherwise(F.concat("study", F.lit("_CPID_Input Files")))
    return s.select("site", F.concat_ws("/", F.lit("/in"), folder, name).alias("path"))


_SHAPES_SQL = "[" + ", ".join(f"'{s}'" for s in FILE_SHAPES) + "]"
_PATHS_SQL = (
    f"SELECT site, replace(list_extract({_SHAPES_SQL}, CAST(s_suppkey % {len(FILE_SHAPES)} + 1 AS INT)), '{{n}}', "
    "regexp_extract(study, '(\\d+)', 1)) AS file_name, "
    "CASE WHEN s_suppkey % 7 = 0 THEN 'Archive' ELSE study || '_CPID_Input Files' END AS folder FROM v_sites"
)


def _ladder_sql(ladder, col="file_name"):
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({col}), '{w.lower()}')" for w in words) + f" THEN '{label}'"
        for label, words in ladder.items()
    )
    return f"CASE {arms} ELSE 'other' END"


@book.add(
    "s01_dataset_scan",
    "SELECT study, count(*) AS subjects, CAST(sum(total_open_issue_count_per_subject) AS BIGINT) AS issues FROM v_edrr GROUP BY study",
)
def s01(spark, sf_dir):
    folder = _folder(spark, "scan")
    rows = cv.issues(spark, sf_dir).drop("row_ord").withColumn("_source_study", F.col("study"))
    rows.write.option("header", True).csv(f"{folder}/edrr_processed.csv")
    df = readers.load_datasets(spark, folder)["edrr_processed"]
    return df.groupBy("study").agg(
        F.count(F.lit(1)).alias("subjects"), F.sum("total_open_issue_count_per_subject").alias("issues")
    )


@book.add(
    "s02_register_directory",
    "SELECT r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
def s02(spark, sf_dir):
    readers.register_directory(spark, sf_dir)
    return readers.run_sql(
        spark,
        "SELECT r_name, count(*) AS suppliers FROM supplier_df JOIN nation_df ON s_nationkey = n_nationkey "
        "JOIN region_df ON n_regionkey = r_regionkey GROUP BY r_name",
    )


@book.add(
    "s03_file_discovery",
    "SELECT site, file_name, regexp_extract(folder, 'Study\\s*(\\d+)', 1) AS study_number FROM q_paths "
    "WHERE contains(folder, 'CPID') AND NOT starts_with(file_name, '~$')",
    q_paths=_PATHS_SQL,
)
def s03(spark, sf_dir):
    return readers.describe_paths(_paths(spark, sf_dir)).select("site", "file_name", "study_number")


@book.add(
    "s04_notebook_category",
    f"SELECT site, {_ladder_sql(naming.NOTEBOOK_LADDER)} AS category FROM q_paths",
    q_paths=_PATHS_SQL,
)
def s04(spark, sf_dir):
    name = F.element_at(F.split("path", "/"), -1)
    return _paths(spark, sf_dir).select("site", naming.category(name, naming.NOTEBOOK_LADDER).alias("category"))


@book.add(
    "s05_loader_category",
    f"SELECT {_ladder_sql(naming.LOADER_LADDER)} AS category, count(*) AS files FROM q_paths GROUP BY 1",
    q_paths=_PATHS_SQL,
)
def s05(spark, sf_dir):
    name = F.element_at(F.split("path", "/"), -1)
    return _paths(spark, sf_dir).groupBy(naming.category(name).alias("category")).agg(F.count(F.lit(1)).alias("files"))


@book.add(
    "s06_tagged_union",
    "SELECT 'visits' AS source, count(*) AS row_count, count(visit) AS visits, CAST(0 AS BIGINT) AS forms FROM v_visit "
    "UNION ALL SELECT 'pages', count(*), CAST(0 AS BIGINT), count(formname) FROM v_pages",
)
def s06(spark, sf_dir):
    visits = cv.visits(spark, sf_dir, ["site", "visit", "days_outstanding"])
    pages = cv.missing_pages(spark, sf_dir, ["sitenumber", "formname", "days_missing"]).withColumnRenamed("sitenumber", "site")
    both = readers.tagged_union([("visits", visits), ("pages", pages)])
    return both.groupBy(F.col("_source_study").alias("source")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("visit").alias("visits"), F.count("formname").alias("forms")
    )


_STEM = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_name, '\\.[^.]*$', ''), "
    "'^Study\\s*\\d+[_\\s]*', '', 'i'), '_updated$', '', 'i'), "
    "'_\\d{1,2}\\s*(NOV|DEC|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT)\\s*\\d{4}', '', 'gi')"
)
_CLEAN = f"regexp_replace(lower(regexp_replace(regexp_replace({_STEM}, '[^\\w\\s]', '', 'g'), '\\s+', '_', 'g')), '^_+|_+$', '', 'g')"


@book.add(
    "s07_table_name",
    "SELECT site, left('study_' || regexp_extract(folder, 'Study\\s*(\\d+)', 1) || '_' || "
    "CASE WHEN c = '' THEN 'unnamed_column' WHEN regexp_matches(c, '^\\d') THEN left('col_' || c, 63) ELSE left(c, 63) END, 63) AS table_name "
    f"FROM (SELECT *, {_CLEAN} AS c FROM q_paths WHERE contains(folder, 'CPID') AND NOT starts_with(file_name, '~$')) t",
    q_paths=_PATHS_SQL,
)
def s07(spark, sf_dir):
    return readers.describe_paths(_paths(spark, sf_dir)).select("site", "table_name")


@book.add(
    "s08_provenance",
    "SELECT 'unknown' AS _study_number, 'lineitem' AS _source_file, 'other' AS _category, count(*) AS row_count FROM lineitem",
)
def s08(spark, sf_dir):
    tagged = readers.with_provenance(cv.table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return tagged.groupBy("_study_number", "_source_file", "_category").agg(F.count(F.lit(1)).alias("row_count"))


@book.add("s09_table_write", "SELECT site, country, subject_count, open_queries FROM v_site_master")
def s09(spark, sf_dir):
    name = f"site_master_{uuid.uuid4().hex[:8]}"
    df = cv.site_master(spark, sf_dir).select("site", "country", "subject_count", "open_queries")
    writers.write_table(df, name, path=_folder(spark, name))
    return spark.table(name)


@book.add(
    "s10_load_all_metadata",
    "SELECT 'study_all_visit' AS table_name, 'all' AS study, 'visit' AS category, count(*) AS row_count, "
    "'site,days_outstanding,_study_number,_category' AS columns FROM v_visit "
    "UNION ALL SELECT 'study_all_pages', 'all', 'pages', count(*), 'sitenumber,days_missing,_study_number,_category' FROM v_pages",
)
def s10(spark, sf_dir):
    tag = lambda df, c: df.withColumn("_study_number", F.lit("all")).withColumn("_category", F.lit(c))
    tables = {
        "study_all_visit": tag(cv.visits(spark, sf_dir, ["site", "days_outstanding"]), "visit"),
        "study_all_pages": tag(cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"]), "pages"),
    }
    return writers.load_all(tables, _folder(spark, "load"))


@book.add(
    "s11_unified_view",
    "SELECT site, count(*) AS row_count FROM (SELECT site FROM v_meddra UNION ALL SELECT site FROM v_whodd) q GROUP BY site",
)
def s11(spark, sf_dir):
    cols = ["site", "coding_status"]
    readers.unified_view(spark, [cv.meddra(spark, sf_dir, cols), cv.whodd(spark, sf_dir, cols)], "all_coding_data")
    return readers.run_sql(spark, "SELECT site, count(*) AS row_count FROM all_coding_data GROUP BY site")


@book.add(
    "s12_adhoc_sql",
    "SELECT site, count(*) AS reviews, count(*) FILTER (WHERE review_status LIKE 'Pending%') AS pending FROM v_esae GROUP BY site HAVING count(*) > 10",
)
def s12(spark, sf_dir):
    cv.safety(spark, sf_dir, ["site", "review_status"]).createOrReplaceTempView("esae")
    return readers.run_sql(
        spark,
        "SELECT site, count(*) AS reviews, count(*) FILTER (WHERE review_status LIKE 'Pending%') AS pending "
        "FROM esae GROUP BY site HAVING count(*) > 10",
    )


@book.add("s14_sample_and_count", "SELECT count(*) AS row_count, CAST(least(5, count(*)) AS BIGINT) AS sampled FROM v_pages")
def s14(spark, sf_dir):
    df = cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"])
    parts = df.select(F.lit(1).alias("whole"), F.lit(0).alias("part")).unionByName(
        readers.table_sample(df, 5).select(F.lit(0).alias("whole"), F.lit(1).alias("part"))
    )
    return parts.agg(F.sum("whole").cast("long").alias("row_count"), F.sum("part").cast("long").alias("sampled"))


@book.add(
    "s15_score_sink",
    "SELECT entity_id, 'site' AS entity_type, round(score, 2) AS score, grade, status, is_clean, critical_count, warning_count FROM q_rule_scores",
)
def s15(spark, sf_dir):
    from ..functions.scoring import Config

    path = _folder(spark, "scores")
    scored = qi.score_entities(ft.view_site_features(spark, sf_dir), "site_id", "site", Config(mode="rules"))
    writers.write_scores(scored, path, "csv")
    schema = (
        "entity_id string, entity_type string, score double, grade string, status string, is_clean boolean, "
        "critical_count bigint, warning_count bigint"
    )
    return readers.scan(spark, path, schema, "csv")


@book.add("s16_processed_sink", "SELECT sitenumber, count(*) AS row_count, sum(days_missing) AS days FROM v_pages GROUP BY sitenumber")
def s16(spark, sf_dir):
    df = cv.missing_pages(spark, sf_dir, ["sitenumber", "days_missing"])
    (path,) = writers.write_processed({"Missing Pages": df}, _folder(spark, "processed"))
    return spark.read.parquet(path).groupBy("sitenumber").agg(F.count(F.lit(1)).alias("row_count"), F.sum("days_missing").alias("days"))


@book.add("s17_statistics_persistence", "SELECT metric, round(mean, 6) AS mean, round(std, 6) AS std, round(p50, 6) AS p50 FROM q_baselines")
def s17(spark, sf_dir):
    path = _folder(spark, "baselines")
    feats = stage(ft.view_site_features(spark, sf_dir), "features")
    writers.save_statistics(ft.population_statistics(feats), path)
    stats = writers.load_statistics(spark, path)
    return stats.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50")])


@book.add(
    "s18_graph_sink",
    "SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM q_nodes GROUP BY node_type "
    "UNION ALL SELECT 'edge', edge_type, count(*) FROM q_edges GROUP BY edge_type",
)
def s18(spark, sf_dir):
    from ..operators import graph

    folder = _folder(spark, "graph")
    nodes, edges = graph.build_from_views(spark, sf_dir)
    writers.write_graph(nodes, edges, folder)
    nodes, edges = readers.read_graph(spark, folder)
    count = F.count(F.lit(1)).alias("n")
    return (
        nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(count)
        .unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(count))
    )


@book.add(
    "s18_graph_file",
    "SELECT 'node' AS kind, id AS source, '' AS target, node_type AS type, true AS same FROM q_nodes UNION ALL SELECT 'edge', src, dst, edge_type, true FROM q_edges",
)
def s18_file(spark, sf_dir):
    """Every element read back from the graph file, and whether its properties are those of the element written."""
    from ..operators import graph

    folder = _folder(spark, "graph-xml")
    nodes, edges = graph.build_from_views(spark, sf_dir)  # staged once, both in one table
    writers.write_graph_xml(nodes, edges, folder)
    back_nodes, back_edges = readers.read_graph_xml(spark, folder)
    entries = lambda c: F.array_sort(F.filter(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()))

    def compared(back, written, keys, kind, target):
        both = back.withColumnRenamed("props", "read").join(written.select(*keys, "props"), keys, "left")
        same = F.coalesce(entries(F.col("read")) == entries(F.col("props")), F.lit(False))
        return both.select(F.lit(kind).alias("kind"), F.col(keys[0]).alias("source"), target.alias("target"), F.col(f"{kind}_type").alias("type"), same.alias("same"))

    return compared(back_nodes, nodes, ["id"], "node", F.lit("")).unionByName(compared(back_edges, edges, ["src", "dst"], "edge", F.col("dst")))


@book.add(
    "s03_discovered_files",
    "SELECT DISTINCT regexp_extract(study, '(\\d+)', 1) AS study_number, 'other' AS category, true AS has_rows FROM v_sites",
)
def s03_files(spark, sf_dir):
    """Files that exist: one marked folder per study is written and found again."""
    root = _folder(spark, "discover")
    rows = cv.sites(spark, sf_dir).select("site", F.concat("study", F.lit("_CPID_Input Files")).alias("folder"))
    rows.repartition("folder").write.partitionBy("folder").csv(root)
    found = readers.discover_files(spark, root)
    return found.groupBy("study_number", "category").agg((F.sum("length") > 0).alias("has_rows"))


@book.add(
    "s06_file_union",
    "SELECT 'visits' AS source, count(*) AS row_count, count(visit) AS visits, CAST(0 AS BIGINT) AS forms FROM v_visit "
    "UNION ALL SELECT 'pages', count(*), CAST(0 AS BIGINT), count(formname) FROM v_pages",
)
def s06_files(spark, sf_dir):
    """Files with different columns, and one that cannot be read, in one load."""
    root = _folder(spark, "files")
    cv.visits(spark, sf_dir, ["site", "visit"]).write.parquet(f"{root}/visits")
    cv.missing_pages(spark, sf_dir, ["sitenumber", "formname"]).withColumnRenamed("sitenumber", "site").write.parquet(f"{root}/pages")
    cv.sites(spark, sf_dir).select("site").write.text(f"{root}/broken")
    both = readers.load_files(spark, [f"{root}/visits", f"{root}/pages", f"{root}/broken"])
    source = F.element_at(F.split("_source_file", "/"), -2)
    return both.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("visit").alias("visits"), F.count("formname").alias("forms")
    )


@book.add(
    "s12_safe_execute",
    "SELECT true AS success, 'site,reviews' AS columns, count(*) AS row_count FROM (SELECT site FROM v_esae GROUP BY site) q UNION ALL SELECT false, '', 0",
)
def s12_safe(spark, sf_dir):
    cv.safety(spark, sf_dir, ["site"]).createOrReplaceTempView("esae_sites")
    good = readers.safe_execute(spark, "SELECT site, count(*) AS reviews FROM esae_sites GROUP BY site")
    bad = readers.safe_execute(spark, "SELECT no_such_column FROM esae_sites")
    rows = [(r["success"], ",".join(r["columns"]), r["count"]) for r in (good, bad)]
    return spark.createDataFrame(rows, "success boolean, columns string, row_count bigint")


@book.add(
    "s14_catalog",
    "SELECT 'region_df' AS table_name, 2 AS columns, count(*) AS row_count FROM region UNION ALL SELECT 'nation_df', 3, count(*) FROM nation "
    "UNION ALL SELECT 'supplier_df', 4, count(*) FROM supplier",
)
def s14_catalog(spark, sf_dir):
    readers.register_directory(spark, sf_dir)
    known = readers.table_catalog(spark)
    parts = [
        spark.table(t).agg(F.lit(t).alias("table_name"), F.lit(len(known[t])).alias("columns"), F.count(F.lit(1)).alias("row_count"))
        for t in ("region_df", "nation_df", "supplier_df")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@book.add("s15_nested_score_sink", "SELECT entity_id, round(score, 2) AS score, grade, critical_count + warning_count AS issues FROM q_rule_scores")
def s15_json(spark, sf_dir):
    """Nested rows as JSON and back; the issues are counted inside the nested list."""
    from ..functions.scoring import Config

    path = _folder(spark, "nested")
    scored = qi.score_entities(ft.view_site_features(spark, sf_dir), "site_id", "site", Config(mode="rules"))
    writers.write_scores(scored, path, "json")
    rows = spark.read.schema(scored.schema).json(path)
    return rows.select("entity_id", "score", "grade", (F.col("critical_count") + F.col("warning_count")).alias("issues"))


@book.add(
    "s17_saved_models",
    "SELECT entity_id AS id, true AS same FROM (SELECT DISTINCT entity_id FROM q_z) q WHERE length(entity_id) >= 0 AND right(entity_id, 1) IN ('1', '3', '5', '7', '9')",
)
def s17_models(spark, sf_dir):
    """Models fitted on half of the sites, saved, loaded, and used on the other half: forest,
    covariance and mixture score new rows alike before and after."""
    from pyspark.ml.clustering import GaussianMixtureModel
    from pyspark.ml.functions import vector_to_array

    from ..operators import anomalies as an
    from ..operators import clustering as cl

    features = stage(ft.view_site_features(spark, sf_dir), "features")
    points = stage(an.scaled_vectors(features, ft.METRICS, an.feature_stats(features, ft.METRICS)), "points")
    odd = F.right("id", F.lit(1)).isin("1", "3", "5", "7", "9")
    old, new = stage(points.where(~odd), "old"), stage(points.where(odd), "new")
    folder = _folder(spark, "models")
    forest, fit = an.fit_isolation_forest(old), an.fit_robust(old, len(ft.METRICS))
    mixture = cl.fit_mixture(old, 3, 1)
    an.save_isolation_forest(spark, forest, f"{folder}/forest")
    an.save_robust_fit(spark, fit, f"{folder}/covariance")
    mixture.write().overwrite().save(f"{folder}/mixture")
    kinds = {
        "forest": (an.score_isolation_forest(new, forest), an.score_isolation_forest(new, an.load_isolation_forest(spark, f"{folder}/forest"))),
        "robust": (an.distances_to(new, fit), an.distances_to(new, an.load_robust_fit(spark, f"{folder}/covariance"))),
    }
    rows = cl.with_features(new)
    chance = lambda m: m.transform(rows).select("id", vector_to_array("probability")[0].alias("p"))
    kinds["mixture"] = (chance(mixture), chance(GaussianMixtureModel.load(f"{folder}/mixture")))
    out = new.select("id", F.lit(True).alias("same"))
    for before, after in kinds.values():
        pair = before.toDF("id", "x").join(after.toDF("id", "y"), "id")
        out = out.join(pair, "id", "left").select("id", (F.col("same") & (F.abs(F.col("x") - F.col("y")) < 1e-9)).alias("same"))
    return out.select("id", F.coalesce("same", F.lit(False)).alias("same"))
