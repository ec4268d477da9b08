"""Tables in the folder that driver and executors share, and joins whose broadcast side is counted."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes that a table may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, by spark.checkpoint.dir. Where it is unset, a session whose executors are threads of the
    driver gets a folder of its own; any other raises ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/lastrum/{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns a scan of it: what is read more than once is computed once, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows and bytes are counted to be few; else Spark shuffles, and AQE splits skewed keys."""
    wide = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(wide, F.lit(24 + 8 * len(df.columns)))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if row["n"] <= BROADCAST_ROWS and row["bytes"] <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its scan has fewer parts than that: a few small files must not keep most cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
