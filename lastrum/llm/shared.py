"""Helpers that the operators of this subpackage share: text normal forms, shared-folder tables, size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most rows and bytes that a table may have to be broadcast. Larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 1 << 24
#: Of n rows, at most this many keys can each hold a share of 1 / HEAVY or more.
HEAVY = 1000
#: Stands for a missing doc_id where a key is needed.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Where it is unset, a session whose executors are
    threads of the driver gets a folder of its own; any other raises ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and returns a scan of it: lineage is cut and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lastrum/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved.saved_path = path
    return saved


def drop(*saved: DataFrame) -> None:
    """Deletes tables written by save() that no later step reads."""
    for df in saved:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows and bytes are counted to be few, else without one (Spark then shuffles, and AQE splits
    skewed keys)."""
    wide = [F.octet_length(F.col(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    if any(kind.startswith(("array", "map", "struct")) for _, kind in df.dtypes):
        raise ValueError("only flat rows are measured")
    width = sum((F.coalesce(x, F.lit(0)) for x in wide), F.lit(24 + 8 * len(df.columns)))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if row["n"] <= BROADCAST_ROWS and row["bytes"] <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
