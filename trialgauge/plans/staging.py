"""Materialise an intermediate result once, in storage every executor can reach.

A staged table is plain Parquet under the folder the cluster names in
``spark.checkpoint.dir``. It cuts lineage, survives the loss of any executor and
is read back with column pruning, so iterative jobs and plans that use one input
several times do not recompute it. Where the setting is absent a local session, whose
tasks share the machine's disk, gets a private folder; a cluster gets an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_PRIVATE: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="spark-trialgauge-")
    return _PRIVATE[app]


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once and return a reader over the written table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/trialgauge/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, key: str, label: str = "t", distinct: bool = False) -> DataFrame:
    """Write ``df`` once in buckets of ``key``, sorted by it: a join on the key then moves only its other side.
    With ``distinct`` equal rows, which share a bucket, become one there.

    There are as many buckets as a shuffle has partitions, so that the other side lands on them.
    """
    spark = df.sparkSession
    name = f"{re.sub('[^a-z0-9]', '_', label)}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/trialgauge/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved = df.repartition(n, key)
    (moved.distinct() if distinct else moved).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.table(name)


_KEPT: dict[tuple, tuple] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def _listing(spark: SparkSession, paths: Iterable[str]) -> tuple:
    """Path, length and time of change of every file under the paths."""
    found = []
    for path in sorted(paths):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


#: Bytes of input files for each partition of what is sorted by key.
PIECE_BYTES = 8 << 20


def pieces_of(spark: SparkSession, paths: Iterable[str]) -> int:
    """Number of partitions for rows that unfold from these files, so that a partition's size does not grow with theirs."""
    size = sum(length for _, length, _ in _listing(spark, paths))
    return max(spark.sparkContext.defaultParallelism, -(-size // PIECE_BYTES))


def kept(spark: SparkSession, name: str, sources: Iterable[str], build):
    """Result of ``build()`` reused while its staged tables stand and no source has changed.

    For tables many queries start from, such as the graph or the site features: built
    once per session and input, like any materialised table. ``sources`` names every table
    that ``build`` reads. A rewritten, added or removed file of any of them makes a new table.
    ``forget()`` drops them all from memory.
    """
    app = spark.sparkContext.applicationId
    sources = tuple(sources)
    key, listing = (app, id(spark), name, sources), _listing(spark, sources)
    if key in _KEPT:
        result, paths, known = _KEPT[key]
        if known == listing and all(_exists(spark, p) for p in paths):
            return result
    before = len(_WRITTEN.get(app, []))
    result = build()
    _KEPT[key] = (result, _WRITTEN.get(app, [])[before:], listing)
    return result


def forget() -> None:
    _KEPT.clear()


def drop_staged(spark: SparkSession) -> int:
    """Delete every table this application staged; returns how many were removed."""
    forget()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
