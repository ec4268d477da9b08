"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A canonical URL is its host and path; a listed entry covers its host with all subdomains, and the paths that start with its own.
The list is a table. Each URL probes the filter with its host's suffixes; those that pass are joined with the listed hosts, which
know the lengths of their own paths, and the URL's path prefixes of these lengths probe the filter again. What passes is
joined with the list by key, which removes the false positives; the longest entry decides. So a URL costs as many probes as
its host has labels, whatever the size of the list, and more only if a listed host covers it.

The filter is built by Spark as bit sums over blocks of 256 bits, of which one test touches a single block. Its size is bounded: beyond
MAX_BLOCKS blocks it passes more false positives, and the join stays exact.

Defined results: a null url, or one without ://, has an empty host and path and fits no entry. Of entries with one key, block wins over
allow. Repeated pages give repeated rows. Empty pages give an empty result; an empty list fits nothing. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastrum.llm.shared import BROADCAST_BYTES, BROADCAST_ROWS, ascii_lower, save, small

BITS_PER_ENTRY, BLOCK_BITS, WORDS, MAX_BLOCKS = 16, 256, 8, 1 << 21
#: Odd multipliers, one for each word of a block: the n-th odd power of the golden ratio's 32 bits.
_SALTS = [pow(0x9E3779B1, 2 * i + 1, 1 << 32) for i in range(WORDS)]

# The rules to apply, as action, host and path, with the words of the contract.
CONTRACT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Only the SQL of op8 is built from these. They block net/de/, which the contract allows; the SQL is left as it is.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Canonical URLs that are blocked where no rule speaks.
LISTED = (("spam-farm.example.com", ""),)


def entries(spark: SparkSession, rules=CONTRACT_RULES, listed=LISTED) -> DataFrame:
    """The list as a table (host, path, action, is_rule)."""
    rows = [(h, p, a, True) for a, h, p in rules] + [(h, p, "block", False) for h, p in listed]
    return spark.createDataFrame(rows, "host string, path string, action string, is_rule boolean")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))


def bloom(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of keys(key), n of them: an array of blocks by words."""
    blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_ENTRY // BLOCK_BITS)))
    low = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
    bit = lambda salt: F.shiftrightunsigned((low * F.lit(salt & 0x7FFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(s))).alias(f"w{i}") for i, s in enumerate(_SALTS)]
    rows = keys.select(F.xxhash64("key").alias("h")).groupBy(_block(F.col("h"), blocks).alias("block")).agg(*words).toArrow()
    out = np.zeros((blocks, WORDS), np.uint32)
    for i in range(WORDS):
        out[rows.column("block").to_numpy(), i] = rows.column(f"w{i}").to_numpy().astype(np.uint32)
    return out


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the filter."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(len(table))).astype(np.int64)
    low = h & np.uint64(0xFFFFFFFF)
    found = np.ones(len(h), bool)
    for i, salt in enumerate(_SALTS):
        bit = ((low * np.uint64(salt & 0x7FFFFFFF)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        found &= (table[block, i] >> bit.astype(np.uint32)) & 1 == 1
    return found


def _may_be_listed(shared):
    @F.pandas_udf("array<boolean>")
    def may_be_listed(hashes: pd.Series) -> pd.Series:
        n_each = hashes.map(len).to_numpy()
        found = passes(shared.value, np.concatenate([*hashes, np.empty(0, np.int64)]))
        return pd.Series(np.split(found, np.cumsum(n_each)[:-1])) if len(hashes) else pd.Series([], dtype=object)

    return may_be_listed


def _probed(rows: DataFrame, keys: Column, may, name: str) -> DataFrame:
    """rows with a row for each of the keys that passes the filter; a row without any gets a key of its own, so that these don't
    meet in one task, and the number of its probes that passed."""
    rows = rows.withColumn("keys", keys).withColumn("may", may(F.transform("keys", lambda k: F.xxhash64(k))))
    passed = F.filter(F.transform("keys", lambda k, i: F.when(F.get("may", i), k)), lambda k: k.isNotNull())
    rows = rows.withColumn("passed", passed).withColumn("probes", F.col("probes") + F.size("passed")).withColumn(name, F.explode_outer("passed"))
    return rows.withColumn(name, F.coalesce(name, F.concat(F.lit("-"), F.col("rid").cast("string")))).drop("keys", "may", "passed")


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule (the longest rule that fits, else null), verdict (allow or block), listed
    (whether an entry that is no rule fits), probes (how many keys passed the filter)."""
    entry = F.concat(ascii_lower(F.col("host")), "path")
    known = listed.where("host is not null and path is not null").select(entry.alias("entry"), F.concat(F.lit("h:"), ascii_lower(F.col("host"))).alias("of"), F.length("path").alias("n_path"), "action", "is_rule")
    known = save(known.groupBy("entry", "of", "is_rule").agg(F.max("action").alias("action"), F.max("n_path").alias("n_path")), "listed")
    hosts = save(known.groupBy("of").agg(F.array_sort(F.collect_set("n_path")).alias("lengths")), "hosts")
    exact = known.select(F.concat(F.lit("e:"), "entry").alias("key"), "action", "is_rule")
    keys = exact.select("key").unionAll(hosts.select(F.col("of").alias("key")))
    may = _may_be_listed(pages.sparkSession.sparkContext.broadcast(bloom(keys, known.count() + hosts.count())))

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.lit(0).alias("probes"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    rows = _probed(rows, suffixes, may, "of").join(_measured(hosts, "lengths"), "of", "left")
    cuts = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda x: x <= F.length("path"))
    prefixes = F.transform(cuts, lambda x: F.concat(F.lit("e:"), F.substring("of", 3, 1 << 30), F.substring(F.col("path"), F.lit(1), x)))
    rows = _probed(rows, prefixes, may, "key").join(small(exact), "key", "left")
    rule = F.when(F.col("is_rule"), F.struct((F.length("key") - 2).alias("length"), F.substring("key", 3, 1 << 30).alias("key"), F.col("action").alias("action")))
    best = rows.groupBy("rid", "page_id", "host", "path").agg(F.max(rule).alias("best"), F.coalesce(F.bool_or(~F.col("is_rule")), F.lit(False)).alias("listed"), F.max("probes").cast("long").alias("probes"))
    verdict = F.coalesce("best.action", F.when(F.col("listed"), "block").otherwise("allow"))
    return best.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"), "listed", "probes")


def _measured(hosts: DataFrame, array: str) -> DataFrame:
    """hosts with a broadcast hint if their rows and arrays are counted to be few."""
    row = hosts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(array) * 4 + F.octet_length("of") + 48), F.lit(0)).alias("bytes")).first()
    return F.broadcast(hosts) if row["n"] <= BROADCAST_ROWS and row["bytes"] <= BROADCAST_BYTES else hosts
