"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import shared_folder

#: What separates words, as Java regular expressions read it (space, tab, line feed, VT, FF, CR).
BLANK = r"\x20\x09-\x0D"
#: Setting that bounds what is sent to Python at once.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Tables in the folder that all executors share (`spark.checkpoint.dir`), one subfolder per call.

    A written table cuts lineage: what a lost executor held is read again from files. The tables stay until the
    folder is cleaned, as results may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back. Rows go to Python in batches bounded by bytes, as texts may be long."""
        path = self.path(name)
        before = self.spark.conf.get(BATCH_BYTES)
        self.spark.conf.set(BATCH_BYTES, str(4 << 20))
        try:
            df.write.mode("error").parquet(path)
        finally:
            self.spark.conf.set(BATCH_BYTES, before)
        return self.spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, for those that do not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="platewise-"))  # the driver's own; Spark copies the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/platewise-package", "zip", os.path.dirname(top), os.path.basename(top)))


_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text, where null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """How many partitions hold `rows` rows (or bytes) with `per_part` in each."""
    return max(least, -(-int(rows or 0) // per_part))
