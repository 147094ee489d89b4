"""Stored panels: sets of tables published at once, pruned layouts, incremental refresh."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..levels import REGION_LABELS
from ..operators.cohort import population_cube
from ..session import checkpointed

VERSIONS = "_versions"


class PublishConflict(RuntimeError):
    """Another writer published the version this one was to become."""


@dataclass(frozen=True)
class Layout:
    """How a table is stored: folders by ``partition_by``; inside them ``buckets`` files by the hash of ``bucket_by``, sorted by it.

    Readers that filter by a partition column skip whole folders. Groupings and
    joins whose keys hold the bucket columns need no shuffle. A bucket is read
    by one task over all wanted folders, so the bucket columns should have
    values of similar size.
    """

    partition_by: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 8


class _Folder:
    """A folder in any file system Spark reaches, with a rename that never overwrites."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.root)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        self.gateway = spark.sparkContext._gateway

    def path(self, *parts: str):
        return reduce(self.jvm.org.apache.hadoop.fs.Path, parts, self.root)

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, text: str, *parts: str) -> None:
        """Write a new file that is there as a whole or not at all; FileAlreadyExists if there is one."""
        target = self.path(*parts)
        staged = self.path(*parts[:-1], f".{parts[-1]}-{uuid.uuid4().hex}")
        stream = self.fs.create(staged, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self.context.rename(staged, target, how)
        except Exception as e:
            self.fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise PublishConflict(f"{target} is there already") from None
            raise

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


def _write(df: DataFrame, path: str, layout: Layout) -> int:
    """Write a table by its layout; its number of rows, counted on the way."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if layout.bucket_by:
        # One task for each bucket, so a folder holds one file of each.
        dealt = counted.repartition(layout.buckets, *layout.bucket_by)
        writer = dealt.write.bucketBy(layout.buckets, *layout.bucket_by).sortBy(*layout.bucket_by)
        writer = writer.partitionBy(*layout.partition_by) if layout.partition_by else writer
        name = f"panel_{uuid.uuid4().hex}"
        writer.format("parquet").option("path", path).saveAsTable(name)
        df.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay, the manifest knows them
    else:
        counted.write.partitionBy(*layout.partition_by).parquet(path)
    return seen.get["n"]


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The published versions of a folder."""
    return [int(n.removesuffix(".json")) for n in _Folder(spark, folder).names(VERSIONS) if n.endswith(".json") and n[0] != "."]


def publish_tables(tables: dict[str, DataFrame], folder: str, layouts: dict[str, Layout] | None = None) -> int:
    """Write named tables and publish them together as the folder's next version; its number.

    Tables go to folders of their own first. A manifest that names them all is
    then put in place by one rename, and readers follow the newest manifest: as
    long as it is not there, and if any table fails, they see the old set.
    Tables not named keep their last state. Of two writers of one version the
    second is refused and its files are removed.
    """
    spark = next(iter(tables.values())).sparkSession
    place, token = _Folder(spark, folder), uuid.uuid4().hex
    before = versions(spark, folder)
    entries = manifest(spark, folder, before[-1])["tables"] if before else {}
    number = before[-1] + 1 if before else 1
    try:
        for name, df in tables.items():
            layout = (layouts or {}).get(name, Layout())
            rows = _write(df, place.path(name, token).toString(), layout)
            entries[name] = {"path": f"{name}/{token}", "rows": rows, "schema": json.loads(df.schema.json()), "layout": asdict(layout)}
        place.put(json.dumps({"version": number, "tables": entries}, indent=1), VERSIONS, f"{number:010d}.json")
    except BaseException:
        for name in tables:
            place.delete(name, token)
        raise
    return number


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What a version (default: the newest) consists of."""
    if version is None:
        found = versions(spark, folder)
        if not found:
            raise FileNotFoundError(f"{folder} has no published tables")
        version = found[-1]
    return json.loads(_Folder(spark, folder).read(VERSIONS, f"{version:010d}.json"))


def _open(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    schema, layout = StructType.fromJson(entry["schema"]), Layout(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry["layout"].items()})
    if not layout.bucket_by:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    # Buckets are known to tables only: the files are declared to the session's catalog under a name of their own.
    name = f"panel_{entry['path'].replace('/', '_')}"
    if not spark.catalog.tableExists(name):
        quoted = lambda names: ", ".join(f"`{c}`" for c in names)
        parts = f"PARTITIONED BY ({quoted(layout.partition_by)})" if layout.partition_by else ""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {parts} CLUSTERED BY ({quoted(layout.bucket_by)}) "
            f"SORTED BY ({quoted(layout.bucket_by)}) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
        )
        if layout.partition_by:
            spark.catalog.recoverPartitions(name)
    return spark.table(name).select(*schema.names)


def published_tables(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version (default: the newest), with the schemas they were written with."""
    place = _Folder(spark, folder)
    found = manifest(spark, folder, version)["tables"]
    return {name: _open(spark, place.path(*e["path"].split("/")).toString(), e) for name, e in found.items()}


def forget_versions(spark: SparkSession, folder: str, keep: int = 1) -> list[int]:
    """Remove all but the newest ``keep`` versions and every table folder that none of these names; the versions removed.

    For times without writers: what a running writer has staged goes too.
    """
    place, found = _Folder(spark, folder), versions(spark, folder)
    gone, kept = found[: max(0, len(found) - keep)], found[max(0, len(found) - keep) :]
    named = {e["path"] for v in kept for e in manifest(spark, folder, v)["tables"].values()}
    for v in gone:
        place.delete(VERSIONS, f"{v:010d}.json")
    for name in place.names():
        if name != VERSIONS:
            for token in place.names(name):
                if f"{name}/{token}" not in named:
                    place.delete(name, token)
    return gone


# ---- population cube, refreshed

CUBE_SCHEMA = "year string, yr int, state string, age int, erp double, cohort int"


def store_cube(cube: DataFrame, path: str) -> None:
    """Write a population cube, a folder for each cohort."""
    cube.repartition("cohort").write.mode("overwrite").partitionBy("cohort").parquet(path)


def stored_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUBE_SCHEMA).parquet(path).select("year", "yr", "state", "age", "erp", "cohort")


def refresh_cube(
    spark: SparkSession,
    path: str,
    obs: DataFrame,
    regions: dict[str, str] = REGION_LABELS,
    sex: str = "3",
    quarter: str = "Q2",
    max_age: int = 9,
    first_cohort: int = 2001,
) -> list[int]:
    """Take further observations into a stored cube; the cohorts that were written again.

    A cell that is there already is revised. Only cohorts that the observations
    touch are read, and only their folders are overwritten; a period touches one
    cohort for each age. The merged rows are fixed before the first folder is
    replaced. A run that breaks off can be repeated with the same observations.
    """
    fresh = checkpointed(population_cube(obs, regions, sex, quarter, max_age, first_cohort).withColumn("cohort", F.col("cohort").cast("int")))
    touched = sorted(r.cohort for r in fresh.select("cohort").distinct().collect())
    if not touched:
        return []
    keys = ["state", "yr", "age", "cohort"]
    revised = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    kept = stored_cube(spark, path).where(F.col("cohort").isin(touched)).join(revised, same, "left_anti")
    merged = checkpointed(kept.unionByName(fresh))
    writer = merged.repartition("cohort").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("cohort").parquet(path)
    return touched
