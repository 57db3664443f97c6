"""Persisted tables: cleaned grants, build metadata, results."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardtrace.sources.csv import write_csv

# Folders that the open scopes will remove, the innermost last; and where a staged table lies.
_SCOPES: list[list[str]] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LOCAL: dict[str, str] = {}
# Files a task may have open for a dataset by category; beyond that Spark sorts the rest.
OPEN_FILES = 8


def staging_root(spark: SparkSession) -> str:
    """The session's own folder within the shared one that the cluster names in ``spark.checkpoint.dir``.

    Without one a cluster has no folder that all its machines see, so that is an
    error; a local session, being one machine, gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if not root:
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="awardtrace-")
        root = _LOCAL[application]
    return f"{root.rstrip('/')}/awardtrace/{application}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's folder; the innermost open scope removes it."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table that several branches of one query read, and read it back.

    Nothing is computed twice, and a lost executor costs no more than a re-read.
    """
    path = staging_path(df.sparkSession, name)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that have been read for the last time; others are left alone."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            _remove(table.sparkSession, path)


class Scope:
    """What ``staging`` gives: a way to keep results beyond its end."""

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a staged table of the scope around this one; the tables it was made from may go."""
        own = _SCOPES.pop()
        try:
            return stage(df, name)
        finally:
            _SCOPES.append(own)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Scope]:
    """A scope that removes at its end all tables staged within, also after an error.

    DataFrames are lazy: what is to be read later must be written within, to a place of
    the caller's or with ``keep``.
    """
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield Scope()
    finally:
        _SCOPES.pop()  # scopes end in the reverse order of their beginnings
        for path in own:
            _remove(spark, path)


def clear_staging(spark: SparkSession) -> None:
    """Remove everything the session has staged; no DataFrame made from staged tables works afterwards."""
    _remove(spark, staging_root(spark))


def write_ranges(grants: DataFrame, path: str, force: bool = False, partitions: int | None = None) -> None:
    """Write Parquet in the order of (funder, DOI), so that a filter on the funder skips row groups.

    The range partitioning ends on the row's place in the source, so even copies of
    one row spread over several tasks. It reads ``grants`` twice, once for its splitters,
    so that is a written table; ``write_grants`` sees to it.
    """
    place = F.monotonically_increasing_id().alias("_place")
    keys = ["funder", "doi", "_place"]
    placed = grants.select("*", place)
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).drop("_place")
    ordered.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_grants(grants: DataFrame, path: str, force: bool = False, partitions: int | None = None) -> None:
    """The same for any rows: they are worked out once, into the staging folder, and nothing of that is left."""
    with staging(grants.sparkSession):
        write_ranges(stage(grants, "unordered"), path, force, partitions)


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_input(cleaned: DataFrame, path: str, force: bool = False, spread: bool = True) -> None:
    """Write a cleaned list, spread evenly: a CSV file that cannot be split arrives in one task.

    ``spread=False`` is for rows that lie in many tasks already: they are neither sorted nor shuffled again.
    """
    if spread:
        cleaned = cleaned.repartition(cleaned.sparkSession.sparkContext.defaultParallelism)
    cleaned.write.mode("overwrite" if force else "errorifexists").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("key", "value")


def write_by_category(consolidated: DataFrame, path: str, force: bool = False) -> None:
    """One dataset of all results, a folder per category.

    A task keeps a file open for each of its few categories: else Spark would sort all rows by category first.
    """
    conf, key = consolidated.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, max(int(before), OPEN_FILES))
    try:
        consolidated.write.partitionBy("category").mode("overwrite" if force else "errorifexists").parquet(path)
    finally:
        conf.set(key, before)


def write_result_files(results: dict[str, DataFrame], folder: str, force: bool = False) -> list[str]:
    """A CSV dataset per result that has rows; returns their names."""
    written = []
    for name, df in results.items():
        if not df.isEmpty():
            write_csv(df, f"{folder}/{name}", "overwrite" if force else "errorifexists")
            written.append(name)
    return written
