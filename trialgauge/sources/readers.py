"""Readers: typed scans, directory registration, file discovery, tagged unions, SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..plans.staging import stage
from .schemas import DATASETS
from .writers import TYPE_KEY

_FORMATS = ("csv", "parquet", "json", "orc")


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return bool(fs.exists(target))


def list_names(spark: SparkSession, folder: str) -> list[str]:
    target, fs = _hadoop_path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def scan(spark: SparkSession, path: str, schema: str, fmt: str | None = None) -> DataFrame:
    """Typed scan of one dataset; an absent path is an empty frame of that schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    fmt = fmt or path.rsplit(".", 1)[-1]
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    return reader.format(fmt).load(path)


def load_datasets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every named clinical dataset of a folder, CSV or Parquet."""
    out = {}
    for name, schema in DATASETS.items():
        parquet = f"{folder}/{name}.parquet"
        path = parquet if path_exists(spark, parquet) else f"{folder}/{name}.csv"
        out[name] = scan(spark, path, schema)
    return out


def view_name(file_name: str) -> str:
    stem = re.sub(r"[^a-zA-Z0-9]", "_", file_name.rsplit(".", 1)[0]).lower()
    return stem if stem.endswith("_df") else f"{stem}_df"


def register_directory(spark: SparkSession, folder: str) -> dict[str, str]:
    """Expose each data file of a folder as a temporary view; returns view -> path."""
    views = {}
    for name in list_names(spark, folder):
        fmt = name.rsplit(".", 1)[-1]
        if fmt not in _FORMATS or name.startswith(("_", ".")):
            continue
        path = f"{folder}/{name}"
        reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
        reader.format(fmt).load(path).createOrReplaceTempView(view_name(name))
        views[view_name(name)] = path
    return views


def discover_files(spark: SparkSession, root: str, folder_mark: str = "CPID") -> DataFrame:
    """Data files under marked folders. Only file metadata is read: the content
    column is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return describe_paths(files.select("path", "length"), folder_mark)


def describe_paths(files: DataFrame, folder_mark: str = "CPID") -> DataFrame:
    """Study number, category and table name of each path; temporary files dropped."""
    parts = F.split("path", "/")
    return (
        files.withColumn("file_name", F.element_at(parts, -1))
        .withColumn("folder", F.element_at(parts, -2))
        .where(F.col("folder").contains(folder_mark) & ~F.col("file_name").startswith("~$"))
        .withColumn("study_number", naming.study_number(F.col("folder")))
        .withColumn("stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))
        .withColumn("category", naming.category(F.col("file_name")))
        .withColumn("table_name", naming.inferred_table_name(F.col("stem"), F.col("study_number")))
    )


def tagged_union(frames: list[tuple[str, DataFrame]], tag: str = "_source_study") -> DataFrame:
    """Union by name with a source tag; columns missing on one side become null."""
    tagged = [df.withColumn(tag, F.lit(label)) for label, df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def load_files(spark: SparkSession, paths: list[str], tag: str = "_source_file", fmt: str = "parquet") -> DataFrame:
    """Union by name of many files in one scan, tagged with the folder or file each row is
    from. Columns missing in a file are null; unreadable files are skipped."""
    reader = spark.read.format(fmt).option("mergeSchema", True).option("ignoreCorruptFiles", True)
    df = reader.load(paths)
    return df.select("*", F.url_decode(F.col("_metadata.file_path")).alias(tag))


def with_provenance(df: DataFrame) -> DataFrame:
    """Study number, source file and category taken from the scan's file metadata."""
    path = F.url_decode(F.col("_metadata.file_path"))
    name = F.element_at(F.split(path, "/"), -1)
    return df.select(
        *df.columns,
        naming.study_number(path).alias("_study_number"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("_source_file"),
        naming.category(name).alias("_category"),
    )


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def safe_execute(spark: SparkSession, text: str, limit: int = 1000) -> dict:
    """Rows (``limit`` at most), columns and whole row count of a statement, or its error. The statement runs once."""
    try:
        df = spark.sql(text)
        columns = df.columns
        held = stage(df.toDF(*[f"c{i}" for i in range(len(columns))]), "statement") if columns else df
        rows = [dict(zip(columns, r, strict=True)) for r in held.limit(limit).collect()]
        return {"success": True, "rows": rows, "columns": columns, "count": held.count(), "error": None}
    except PySparkException as error:
        return {"success": False, "rows": [], "columns": [], "count": 0, "error": str(error).splitlines()[0]}


def table_sample(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def table_catalog(spark: SparkSession) -> dict[str, list[str]]:
    """Registered table -> column names."""
    return {t.name: [c.name for c in spark.catalog.listColumns(t.name)] for t in spark.catalog.listTables()}


def unified_view(spark: SparkSession, frames: list[DataFrame], name: str) -> DataFrame:
    """One temporary view over the same category of several studies."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    whole.createOrReplaceTempView(name)
    return whole


def read_jdbc(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def read_graph_xml(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of GraphML elements that ``write_graph_xml`` wrote; properties come back as text."""
    data = "data array<struct<_key: string, _VALUE: string>>"

    def read(tag: str, schema: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).option("nullValue", "\\N").option("ignoreSurroundingSpaces", "false")
        return rows.schema(f"{schema}, {data}").load(f"{folder}/{tag}s")

    kind = F.filter("data", lambda e: e["_key"] == TYPE_KEY)[0]["_VALUE"]
    held = F.filter("data", lambda e: e["_key"].startswith("p:"))
    props = F.map_from_entries(F.transform(held, lambda e: F.struct(F.substr(e["_key"], F.lit(3)), F.coalesce(e["_VALUE"], F.lit("")))))
    nodes = read("node", "_id string").select(F.col("_id").alias("id"), kind.alias("node_type"), props.alias("props"))
    edges = read("edge", "_source string, _target string")
    return nodes, edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), kind.alias("edge_type"), props.alias("props"))
