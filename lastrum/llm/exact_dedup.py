"""Exact deduplication by an extendible-hash index kept in shared files.

Documents hash to 64 bits. A directory points from the top bits of the hash to buckets; it doubles while a bucket holds more
distinct keys than fit, and only the overfull buckets split. Copies share one key, so they chain in a bucket and never
cause a split. Owner tasks each take a range of buckets and keys of the index: the distinct texts under one key, told apart
by their bytes, are the slots of its chain. Documents then look up their bucket, key and slot.

Defined results: a null text counts as empty, and all empty texts are one group. A null doc_id ranks below every other.
Rows that repeat both doc_id and text are copies like any others: one of them stays. An empty table gives an empty table.
Extra columns are ignored by find() and passed on by dedup().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.llm.shared import HEAVY, NO_ID, ascii_lower, save, small, unused

#: Distinct keys that a bucket holds before it splits.
BUCKET_KEYS = 100_000
#: The directory has at most about so many buckets; beyond that, buckets hold more keys.
MAX_BUCKETS = 4096
#: Most bits of the directory, which thus has at most about a million pointers.
MAX_DEPTH = 20


def normal_text(docs: DataFrame) -> Column:
    return ascii_lower(F.coalesce(docs["text"], F.lit("")))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, max_buckets: int = MAX_BUCKETS) -> tuple[int, list[tuple[int, int, int]]]:
    """The directory over keys(h): its global depth, and (prefix, local depth, keys) of each bucket, in key order.

    It starts at the depth at which evenly spread keys would fit and doubles while buckets are overfull. Its size is bounded:
    a bucket's capacity rises with the number of keys once max_buckets are reached.
    """
    total = keys.count()
    capacity = max(bucket_keys, math.ceil(total / max_buckets))
    depth = max(0, math.floor(math.log2(max(1, total / capacity))))
    loads = {int(r["p"]): int(r["n"]) for r in keys.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n")).collect()}
    done: list[tuple[int, int, int]] = []
    while True:
        over = [p for p, n in loads.items() if n > capacity and depth < MAX_DEPTH]
        done += [(p, depth, n) for p, n in loads.items() if p not in set(over)]
        if not over:
            return depth, sorted(done, key=lambda b: b[0] << (depth - b[1]))
        depth += 1
        halves = keys.where(F.shiftrightunsigned(_prefix(depth), 1).isin(over)).groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"))
        loads = {int(r["p"]): int(r["n"]) for r in halves.collect()}


def pointers(like: DataFrame, depth: int, buckets: list[tuple[int, int, int]]) -> DataFrame:
    """(prefix, bucket): where each prefix of depth bits points to. A bucket of a lesser local depth has several pointers."""
    rows = [(p, d, b) for b, (p, d, _) in enumerate(buckets)] or [(0, 0, 0)]
    span = F.lit(depth) - F.col("d")
    ends = F.sequence(F.call_function("shiftleft", "p", span), F.call_function("shiftleft", F.col("p") + 1, span) - 1)
    return like.sparkSession.createDataFrame(rows, "p long, d int, bucket int").select(F.explode(ends).alias("prefix"), "bucket")


def build_index(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, max_buckets: int = MAX_BUCKETS) -> tuple[DataFrame, DataFrame, int]:
    """(entries, index, rows): an entry (rid, doc_id, bucket, h, sha) per document; an index row (bucket, h, slot, sha, keep_id,
    keep_rid, n) per text of a key that several rows have, in files by ranges of buckets and keys; the number of documents."""
    norm = normal_text(docs)
    hashed = save(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("rid", "doc_id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "entries")
    keys = save(hashed.groupBy("h").agg(F.count("*").alias("n")), "keys")
    depth, buckets = directory(keys, bucket_keys, max_buckets)
    to_bucket = F.broadcast(pointers(docs, depth, buckets))
    in_bucket = lambda df: df.join(to_bucket, _prefix(depth) == F.col("prefix")).drop("prefix")
    entries = in_bucket(hashed)
    multi = small(keys.where("n > 1").select("h"))
    # equal bytes collapse before they move, so a hot text reaches its owner once
    texts = docs.select(norm.alias("norm")).select(F.xxhash64("norm").alias("h"), "norm").join(multi, "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("n"))
    owned = in_bucket(texts).repartitionByRange(max(1, min(len(buckets), 200)), "bucket", "h")
    chain = Window.partitionBy("bucket", "h").orderBy("norm")
    chained = owned.select("bucket", "h", F.row_number().over(chain).alias("slot"), F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
    chained = save(chained.where("n > 1"), "chains")
    # the row that stays, from the entries alone: no text moves
    least = F.coalesce("doc_id", F.lit(NO_ID))
    stays = entries.join(multi, "h", "left_semi").groupBy("bucket", "h", "sha").agg(F.max("doc_id").alias("keep_id"), F.max_by("rid", least).alias("keep_rid"))
    index = chained.join(stays, ["bucket", "h", "sha"]).select("bucket", "h", "slot", "sha", "keep_id", "keep_rid", "n")
    return entries, save(index.repartitionByRange(max(1, min(len(buckets), 200)), "bucket", "h").sortWithinPartitions("bucket", "h", "slot"), "index"), hashed.count()


def find(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """One row per document: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Classes that hold a thousandth of all rows or more (so a thousand classes at most) are looked up by broadcast; all others
    by a shuffle in which no key is hot.
    """
    entries, index, rows = build_index(docs, bucket_keys, max_buckets)
    cut = max(2, rows // HEAVY)
    look = lambda df, tag: df.select(F.col("bucket").alias(f"{tag}bucket"), F.col("h").alias(f"{tag}h"), F.col("sha").alias(f"{tag}sha"), F.col("keep_id").alias(f"{tag}id"), F.col("keep_rid").alias(f"{tag}rid"), F.col("n").alias(f"{tag}n"))
    heavy, light = look(index.where(F.col("n") >= cut), "a"), look(index.where(F.col("n") < cut), "b")
    out = entries.join(F.broadcast(heavy), (F.col("bucket") == F.col("abucket")) & (F.col("h") == F.col("ah")) & (F.col("sha") == F.col("asha")), "left")
    out = out.withColumn("jh", F.when(F.col("an").isNull(), F.col("h")).otherwise(F.xxhash64("rid")))
    out = out.join(light, (F.col("bucket") == F.col("bbucket")) & (F.col("jh") == F.col("bh")) & (F.col("sha") == F.col("bsha")), "left")
    grouped = F.coalesce("an", "bn")
    return out.select(
        "rid",
        "doc_id",
        F.when(grouped.isNull(), F.col("doc_id")).otherwise(F.coalesce("aid", "bid")).alias("keep_id"),
        F.coalesce(grouped, F.lit(1).cast("long")).alias("group_size"),
        (grouped.isNull() | (F.coalesce("arid", "brid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact copies make superfluous; columns as they came."""
    i, t = unused(docs, "copy_id"), unused(docs, "copy_sha")
    found = save(find(docs).where(F.col("group_size") > 1).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(i), F.unhex("text_sha256").alias(t), "kept"), "copies")
    # a (doc_id, text) goes if none of its rows stays; a repeated row of which one stays goes by dropDuplicates
    each = save(found.groupBy(i, t).agg(F.max("kept").alias("stays"), F.count("*").alias("m")), "each")
    gone, again = each.where("not stays").select(i, t), each.where("stays and m > 1").select(i, t)
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), t: F.unhex(F.sha2(normal_text(docs), 256))})
    left = keyed.join(small(gone), [i, t], "left_anti")
    if not again.isEmpty():
        few = small(again)
        left = left.join(few, [i, t], "left_anti").unionByName(left.join(few, [i, t], "left_semi").dropDuplicates([i, t]))
    return left.drop(i, t)
