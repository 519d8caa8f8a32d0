"""What the operators of this subpackage share: the word pattern, stored intermediate tables, null-safe inputs."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions that run on executors travel with the job: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules["plumbline"])

#: Words are maximal runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Whether Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends here and a lost executor costs no recomputation.

    The shuffle files of the write go with it, as nothing reads them again; the table's when drop_stored is called or the Spark application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(parent)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def settled(condition: Column) -> Column:
    """condition, of which Catalyst thinks that it isn't deterministic.

    A filter by a deterministic column moves below the projections that made it, with their expressions put in place of names: inside lambdas
    these would then run once for each element. A filter by a column made with this stays where it is.
    """
    return condition & (F.monotonically_increasing_id() >= 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once even if body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def worker_memory() -> dict:
    """What a Python worker keeps between tasks. Functions that travel with a job have globals of their own for each task."""
    return sys.modules.setdefault("_plumbline_worker", types.ModuleType("_plumbline_worker")).__dict__
