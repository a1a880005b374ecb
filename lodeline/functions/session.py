"""Constants and identifiers that a session can ask for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators.store import MAX_KEY, MAX_VAL

VERSION = "1.0"


def constants(spark: SparkSession, message: str = "") -> DataFrame:
    """One row: limits, version, the type of every value, and the message sent back."""
    return spark.range(1).select(F.lit(MAX_KEY).alias("max_key"), F.lit(MAX_VAL).alias("max_val"), F.lit(VERSION).alias("version"), F.lit("string").alias("type"), F.lit(message).alias("echo"))


def unique_id(node: int = 0) -> Column:
    """Hex ids that grow with time, and differ between rows and nodes."""
    return F.lower(F.concat(F.lpad(F.hex(F.unix_micros(F.current_timestamp())), 16, "0"), F.lpad(F.hex(F.lit(node)), 4, "0"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))


def clock() -> list[Column]:
    """Seconds, and microseconds within the second."""
    now = F.unix_micros(F.current_timestamp())
    return [F.floor(now / 1_000_000).cast("long").alias("seconds"), (now % 1_000_000).alias("micros")]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own under a
    local master, as in tests; on a cluster an error, as a folder of one machine is not seen by the others."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='lodeline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths given out and not deleted yet, by application.
_given: dict[str, set[str]] = {}


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/lodeline/{tag}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def given_paths(spark: SparkSession) -> set[str]:
    """Paths of this application that were given out and not deleted."""
    return set(_given.get(spark.sparkContext.applicationId, set()))


def delete_path(spark: SparkSession, path: str) -> None:
    _given.get(spark.sparkContext.applicationId, set()).discard(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that their Python workers can import it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_lodeline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="lodeline-code-"), "lodeline_code.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("lodeline", os.path.relpath(full, root)))
    sc.addPyFile(name)
    sc._lodeline_shipped = True
