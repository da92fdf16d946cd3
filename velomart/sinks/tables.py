"""Writing tables: staged for reuse, replaced by name, partitioned and clustered, copied."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: the one named for checkpoints, or else the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; removed when its JVM ends."""
    path = f"{shared_folder(spark)}/_velomart/{spark.sparkContext.applicationId}"
    if path not in _REMOVED_AT_END:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _REMOVED_AT_END.add(path)
    return path


_REMOVED_AT_END: set[str] = set()


def release(spark: SparkSession) -> None:
    """Remove this application's intermediate tables now; frames that read them become invalid."""
    path = f"{shared_folder(spark)}/_velomart/{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _REMOVED_AT_END.discard(path)
    _RELEASES[spark.sparkContext.applicationId] += 1


_RELEASES: Counter[str] = Counter()


def run_key(spark: SparkSession) -> tuple[str, int]:
    """What intermediate tables that are kept for later uses are known by: it changes when they are released."""
    return spark.sparkContext.applicationId, _RELEASES[spark.sparkContext.applicationId]


def work_folder(spark: SparkSession) -> str:
    """One folder per use below the run's folder, so uses never overwrite each other."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "table") -> DataFrame:
    """Write once, read back: for a result that several later steps read.

    Cuts the lineage with files that outlive an executor, keeps column pruning and filter
    pushdown, and gives the planner the true size, so later joins broadcast it only if small.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


VERSIONS_KEPT = 2


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _published_versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions of a table, oldest first: ``<number>.<id>``."""
    marks, files = _hadoop(spark, f"{root}/_published")
    return sorted(s.getPath().getName() for s in files.listStatus(marks)) if files.exists(marks) else []


def published(spark: SparkSession, root: str) -> str:
    """The folder that holds the present rows of the table at ``root``: its latest version, or ``root`` where nothing was published."""
    names = _published_versions(spark, root.rstrip("/"))
    return f"{root.rstrip('/')}/v-{names[-1]}" if names else root


def read_published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(published(spark, root))


def publish(spark: SparkSession, root: str, write: Callable[[str], None], switch: Callable[[str], None] | None = None) -> str:
    """Replace the rows of the table at ``root`` by what ``write`` puts into the folder it is given; returns that folder.

    Every version has a folder of its own and is published, when complete, by one new empty file in ``_published`` (and
    before that by ``switch``, say a catalog statement). Nothing is renamed, moved or overwritten, so a reader finds the old or
    the new rows at every moment, on object stores too; if writing or switching fails, the old ones stay. The version
    before the new one is kept for readers that have begun; older ones are deleted.
    """
    root = root.rstrip("/")
    earlier = _published_versions(spark, root)
    name = f"{int(earlier[-1].split('.')[0]) + 1 if earlier else 1:012d}.{uuid.uuid4().hex}"
    folder, (path, files) = f"{root}/v-{name}", _hadoop(spark, f"{root}/v-{name}")
    try:
        write(folder)
        if switch:
            switch(folder)
    except BaseException:
        files.delete(path, True)
        raise
    files.create(_hadoop(spark, f"{root}/_published/{name}")[0], False).close()
    for old in _published_versions(spark, root)[:-VERSIONS_KEPT]:
        files.delete(_hadoop(spark, f"{root}/v-{old}")[0], True)
        files.delete(_hadoop(spark, f"{root}/_published/{old}")[0], False)
    return folder


def point_table(spark: SparkSession, name: str, schema: T.StructType, folder: str, partition: str | None = None) -> None:
    """Let a catalog table read the Parquet files in ``folder``, by one statement where it has the same columns already.

    Columns added at the end follow in a second statement; until then readers see the new rows without them. Any other
    change of columns or partitioning has no such statement: there the definition is dropped and made anew.
    """
    columns = [(f.name, f.dataType) for f in schema if f.name != partition]
    if partition:
        columns.append((partition, schema[partition].dataType))
    if spark.catalog.tableExists(name):
        known = [(f.name, f.dataType) for f in spark.table(name).schema]
        parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
        added = columns[len(known) :] if not partition else []
        if parts == ([partition] if partition else []) and known == columns[: len(columns) - len(added)]:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
            if added:
                spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({_ddl(added)})")
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE {name}")
    by = f"PARTITIONED BY (`{partition}`)" if partition else ""
    # Partitions are found in the folder, not listed in the catalog, so that one statement moves them all.
    tracked = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(tracked)
    spark.conf.set(tracked, "false")
    try:
        spark.sql(f"CREATE TABLE {name} ({_ddl(columns)}) USING parquet {by} LOCATION '{folder}'")
    finally:
        spark.conf.set(tracked, before)


def _ddl(columns: list[tuple[str, T.DataType]]) -> str:
    return ", ".join(f"`{name}` {kind.simpleString()}" for name, kind in columns)


def table_root(spark: SparkSession, name: str) -> str:
    """Where the versions of a catalog table lie: beside the tables of its database. ``name``: ``table`` or ``database.table``."""
    *database, table = (part.strip("`") for part in name.split("."))
    base = spark.catalog.getDatabase(database[0] if database else spark.catalog.currentDatabase())
    return f"{base.locationUri.rstrip('/')}/{table}__versions"


def replace_table(df: DataFrame, name: str, partition: str | None = None, cluster: list[str] | None = None) -> None:
    """Create or replace a catalog table with the rows of ``df``, which may read the table itself.

    All rows are written before the table is pointed at them, so a failing plan leaves the old table as it was.
    """
    spark = df.sparkSession

    def write(folder: str) -> None:
        if partition:
            write_partitioned(df, folder, partition, cluster or [])
        else:
            df.write.parquet(folder)

    publish(spark, table_root(spark, name), write, lambda folder: point_table(spark, name, df.schema, folder, partition))


def register_view(df: DataFrame, name: str) -> None:
    """Publish a plan under a name without computing it."""
    df.createOrReplaceTempView(name)


def ensure_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def write_partitioned(df: DataFrame, folder: str, partition: str, cluster: list[str]) -> None:
    """Write a new folder by partition column, rows clustered inside each file.

    REBALANCE shuffles by the partition column, then adaptive execution splits the days that
    are too large for one task and merges small ones: neither one task per hot day nor a file
    per task and day. The sort lets Parquet min/max statistics skip row groups.
    """
    write_days(df.hint("rebalance", partition), folder, partition, cluster)


def write_days(df: DataFrame, folder: str, partition: str, cluster: list[str]) -> None:
    """As ``write_partitioned``, for rows that lie together by partition already."""
    df.sortWithinPartitions(partition, *cluster).write.partitionBy(partition).parquet(folder)


def curve_key(df: DataFrame, columns: list[str], bits: int = 6) -> Column:
    """Where a row lies on a curve through the space of several numeric columns, so that neighbours are near in all of them.

    Each column is cut into up to 2^bits ranges of like row counts, from a quantile sketch over one pass; the bits of the
    ranges are interleaved, the highest first. NULL lies in the first range.
    """
    shares = F.array(*[F.lit(k / 2**bits) for k in range(1, 2**bits)])
    cuts = df.agg(*[F.percentile_approx(name, shares, F.lit(1000)).alias(name) for name in columns]).first()
    key = F.lit(0)
    for place, name in enumerate(columns):
        bounds = sorted(set(cuts[name] or []))
        found = reduce(lambda n, bound: n + F.when(F.col(name) >= bound, 1).otherwise(0), bounds, F.lit(0))
        for bit in range(bits):
            at = bit * len(columns) + len(columns) - 1 - place
            key = key.bitwiseOR(F.shiftleft(F.shiftright(found, bit).bitwiseAND(F.lit(1)), at))
    return key


def write_curve(df: DataFrame, folder: str, partition: str, columns: list[str], **options: Any) -> None:
    """Write a new folder by partition column, rows of each partition in the order of ``curve_key``.

    Rows are shuffled into sampled, equal ranges of (partition, key): a hot day is split over several files that differ in
    their keys, quiet days share a task. A filter on any of the columns then skips files and row groups by their
    min/max statistics, where a linear sort serves its first column only. Reads ``df`` three times: pass a written table.
    """
    keyed = df.withColumn("_curve", curve_key(df, columns))
    ranged = keyed.repartitionByRange(partition, "_curve").sortWithinPartitions(partition, "_curve").drop("_curve")
    ranged.write.options(**options).partitionBy(partition).parquet(folder)


def write_counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Run ``write`` and return the number of rows that went through it, without a second pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def run_together(spark: SparkSession, jobs: Mapping[str, Callable[[], Any]], at_once: int = 4) -> dict[str, Any]:
    """Run jobs from several threads, each in a scheduler pool of its own name; what each returned or raised, by name.

    Threads inherit the properties of the caller. Under ``spark.scheduler.mode=FAIR`` the pools share the cluster evenly; under
    FIFO later jobs fill what earlier ones leave idle. A job that fails delays no other.
    """

    def run(name: str, job: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return job()
        except Exception as problem:  # whatever a table's files or plan can raise
            return problem

    with ThreadPoolExecutor(max(1, min(at_once, len(jobs)))) as threads:
        waiting = {name: threads.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs.items()}
        return {name: future.result() for name, future in waiting.items()}


def copy_tables(
    spark: SparkSession,
    names: list[str],
    read: Callable[[str], DataFrame] | Mapping[str, DataFrame],
    target: str,
    at_once: int = 4,
) -> DataFrame:
    """Copy tables into ``target``, several at once; any failure is noted and the rest go on.

    A table already at the target is replaced only by a complete copy; ``read_published`` reads it. Returns (table_name,
    row_count, succeeded, error_type, error), one row per name.
    """

    def copy(name: str) -> int:
        source = read[name] if isinstance(read, Mapping) else read(name)
        counted = []
        publish(
            spark,
            f"{target}/{name}",
            lambda folder: counted.append(write_counted(source, lambda df: df.write.parquet(folder))),
        )
        return counted[0]

    done = run_together(spark, {name: lambda name=name: copy(name) for name in names}, at_once)
    outcome = [
        (name, None, False, type(x).__name__, str(x)) if isinstance(x, Exception) else (name, x, True, None, None)
        for name, x in done.items()
    ]
    return spark.createDataFrame(
        outcome, "table_name string, row_count long, succeeded boolean, error_type string, error string"
    )
