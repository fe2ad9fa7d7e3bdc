"""Stored tables: writing, reading, listing, exporting."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.session import materialise


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ("date",)) -> None:
    """Parquet, partitioned by date.

    'append' adds, 'overwrite' replaces the table, 'reload' replaces only the dates present in `df`, so that
    loading a file again changes nothing. Rows are rebalanced by date before the write: small dates share a
    task, a large one is split over several. Inside files rows are sorted by parameter and frequency where
    present, which lets row groups be skipped.
    """
    by = [c for c in partition_by if c in df.columns]
    order = [c for c in ("param", "freq", "well", "time_h") if c in df.columns]
    if by:
        df = df.hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*by, *order)
    writer = df.write.partitionBy(*by) if by else df.write
    if mode == "reload":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    elif mode == "overwrite":
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    else:
        writer.mode(mode).parquet(path)



def reload_keyed(df: DataFrame, path: str, key: str = "workbook", partition_by: Sequence[str] = ("date",)) -> None:
    """Load rows so that those of each `key` in `df` replace the rows loaded for that key before; other keys stay, also
    those of the same date. A missing key is a key of its own.

    Rows go to a folder of their own under `path/loads`. A manifest (one row per key: the load that counts for it) then
    names them; each is written whole under a rising number, and readers take the latest that was finished. That
    is the one switch: a load that fails before it leaves the old table, and of two loads that run at once on one
    state the later fails at its number and can be repeated. Superseded rows stay on disk and are not read.
    """
    spark, load = df.sparkSession, uuid.uuid4().hex
    done = _versions(spark, path)
    write_table(df, f"{path}/loads/load={load}", "error", partition_by)
    new = spark.read.schema(df.schema).parquet(f"{path}/loads/load={load}").select(F.col(key).alias("key")).distinct()
    new = materialise(new.withColumn("load", F.lit(load)), "keys")  # small: a row per key
    if done:
        old = spark.read.parquet(f"{path}/manifest/{done[-1]:012d}")
        new = old.alias("o").join(new.alias("n"), F.col("o.key").eqNullSafe(F.col("n.key")), "left_anti").unionByName(new)
    new.write.mode("error").parquet(f"{path}/manifest/{(done[-1] if done else 0) + 1:012d}")


def read_keyed(spark: SparkSession, path: str, schema, key: str = "workbook") -> DataFrame:
    """What `reload_keyed` made: of each key the rows of its latest load. `schema` is that of the rows.

    Loads without a key that counts are not opened; inside a load, rows of superseded keys are dropped by a semi join
    with the manifest, which Spark broadcasts while it is small. Nothing loaded yet gives an empty table.
    """
    done = _versions(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    manifest = spark.read.parquet(f"{path}/manifest/{done[-1]:012d}").select(F.col("key").alias("_key"), F.col("load").alias("_of"))
    whole = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
    rows = spark.read.schema(whole).parquet(f"{path}/loads")
    hit = (F.col("load") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(manifest, hit, "left_semi").select(*schema.fieldNames())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished manifests, ascending."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [x.getPath() for x in files.listStatus(folder)]
    done = [int(p.getName()) for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done)


def read_table(spark: SparkSession, name: str, schema=None) -> DataFrame:
    """A table by path or catalog name. Partition values are read as the text they were written as."""
    if "/" in name:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(name)
    return spark.table(name)


def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def list_fields(spark: SparkSession, name: str) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(read_table(spark, name).schema.fields, 1)]
    return spark.createDataFrame(rows, "position int, name string, type string")


def field_report(df: DataFrame) -> DataFrame:
    """(position, name, type, present, missing): the fields of `df` in order, with how many rows have or lack a value.

    One aggregate in one pass over the rows, combined inside the scan's tasks, however many fields there are; its one row
    becomes one per field. An empty table has all its fields, with counts of zero.
    """
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(df.schema.fields)])
    fields = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                       F.col(f"_{i}").alias("present"), (F.col("rows") - F.col(f"_{i}")).alias("missing"))
              for i, f in enumerate(df.schema.fields)]
    return counts.select(F.explode(F.array(*fields)).alias("field")).select("field.*")


def export_csv(df: DataFrame, path: str, order_by: Sequence[str]) -> None:
    """Header and a leading row number, in order.

    Rows are sorted by range and numbered per range; the ranges' sizes, one row each, give the offsets.
    """
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    local = F.monotonically_increasing_id() % F.lit(1 << 33)
    kept = materialise(ranged.select(F.spark_partition_id().alias("_part"), local.alias("_local"), *df.columns))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = kept.join(starts, "_part").select((F.col("_start") + F.col("_local") + 1).alias("row"), *df.columns)
    numbered.orderBy("row").write.mode("overwrite").option("header", "true").csv(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Keep a result as Parquet and go on from the copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def preview(df: DataFrame, n: int = 6, order_by: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
