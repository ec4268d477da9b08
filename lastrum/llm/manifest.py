"""Merkle manifest of a dataset: a digest of each row, a tree for each source over the rows in order of doc_id, and a tree over the sources.

The place of a row in its source is exact without a global sort. Histograms count rows by the leading digits of their keys; a
cell with more rows than a task should order is split by the next digit, all others are final. Running sums over the cells
of a parent give each cell's first place, and rows are ordered within their own cell only. The digits go on from doc_id through
the leaf digest to a row number, so neither a hot source nor a hot doc_id stays in one cell.

The place, written in base FANOUT, keys a trie: nodes that agree in all digits but the last meet in their parent, and a node's
digest is the hash of its children's. Going down again, each node hands its children the siblings on their left and right, so a
row gets its whole proof from its parent alone. All groups hold FANOUT rows at most.

Defined results: a null value in a row is written as -; a null source is a source of its own, first in order; a null doc_id
comes before all others and is never tampered with. Rows that repeat source and doc_id are in order of their leaf digests; wholly equal rows take neighbouring places.
A source of one row has its leaf as its subtree's root, one source alone its root as the root. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastrum.llm.shared import ascii_lower, save, small

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: Bits of a digit of the histograms, and the most rows of a cell that one task orders.
DIGIT_BITS, CELL_ROWS = 10, 1 << 16
#: Bits of the leaf digest that serve as digits.
LEAF_BITS = 60
#: Every so many documents, by the checksum of the id, are tampered with.
TAMPER_EVERY = 5
#: Ranges in which sources are ranked.
RANGES = 32


def written(value: Column) -> Column:
    """- if null, else length in UTF-8, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hashed(text: Column) -> Column:
    """The digest in 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def leaves(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, leaf, forged) of each row; forged is null where the row isn't tampered with."""
    doc_id, source, text = docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"].cast("string")
    head = F.concat(written(doc_id), written(source), written(docs["lang"]), written(docs["n_chars"]))
    hit = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EVERY == 0
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        doc_id.alias("doc_id"),
        source.alias("source"),
        _hashed(F.concat(head, written(text))).alias("leaf"),
        F.when(hit, _hashed(F.concat(head, written(ascii_lower(text))))).alias("forged"),
    )


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place, from 0 in bytewise order of source, null first, to sources(source, ...): ranges are ranked each in a task of its own."""
    order = F.col("source").asc_nulls_first()
    parts = save(sources.repartitionByRange(RANGES, order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("range").agg(F.count("*").alias("m"))  # one row for each range
    offsets = sizes.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return parts.withColumn("own", own).join(F.broadcast(offsets), "range").withColumn("place", (F.col("own") + F.col("offset")).cast("long")).drop("range", "own", "offset", "m")


def _levels(rows: DataFrame, bits: int) -> list[list[Column]]:
    """For each depth of the histograms, the key of a row's cell: leading digits of doc_id, leaf and rid.

    Leading bits in which all ids agree make no digits. -1 stands for a null id.
    """
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    wide = ((ends["lo"] ^ ends["hi"]) & (1 << 64) - 1).bit_length() if ends["lo"] is not None else 0
    low = F.col("doc_id").bitwiseAND(F.lit((1 << min(wide, 63)) - 1)) if wide < 64 else F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
    keys = [(F.coalesce(low, F.lit(0)).cast("long"), wide), (F.conv(F.substring(F.hex("leaf"), 1, LEAF_BITS // 4), 16, 10).cast("long"), LEAF_BITS), (F.col("rid"), 63)]
    none, null = F.lit(0).cast("long"), F.col("doc_id").isNull()
    found, done = [], []
    for k, (key, width) in enumerate(keys):
        for end in [*range(width - bits, 0, -bits), 0] if width else []:
            digits = [*done, F.shiftrightunsigned(key, end)]
            found.append([F.when(null, F.lit(-1).cast("long")).otherwise(none), *digits, *[none] * (2 - k)])
        done.append(key if width else none)
    return found


def places(rows: DataFrame, bits: int = DIGIT_BITS, most: int = CELL_ROWS) -> DataFrame:
    """Adds place to rows(group, doc_id, leaf, rid, ...), saved: the number of rows of its group before it.

    A level of the histograms reads the rows of the cells that are still too large, and makes at most 2 ** bits + 1 cells of each.
    """
    names = ["null_id", "id_digits", "leaf_digits", "row_digits"]
    order = Window.partitionBy("group", *names).orderBy(F.col("doc_id").asc_nulls_first(), "leaf", "rid")
    found, above, inside = [], None, rows
    for level in _levels(rows, bits):
        keyed = inside.withColumns(dict(zip(names, level, strict=True)))
        if above is None:
            cells = keyed.groupBy("group", *names).agg(F.count("*").alias("n")).withColumn("parent", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
        else:
            cells = keyed.groupBy("group", "parent", "before", *names).agg(F.count("*").alias("n"))
        running = Window.partitionBy("group", "parent").orderBy(*names)  # the cells of a parent
        first = F.col("before") + F.sum("n").over(running) - F.col("n")
        cells = save(cells.withColumn("first", first).select("group", *names, "n", "first"), "cells")
        mine = keyed.drop("parent", "before")
        final, large = small(cells.where(F.col("n") <= most).drop("n")), cells.where(F.col("n") > most)
        found.append(mine.join(final, ["group", *names]).withColumn("place", F.col("first") + F.row_number().over(order) - 1))
        if large.isEmpty():
            break
        # a cell is known by its group and first place
        inside = save(mine.join(small(large.withColumn("parent", F.col("first")).withColumnRenamed("first", "before").drop("n")), ["group", *names]).drop(*names), "large_cells")
        above = large
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.drop(*names, "first")


def _parent() -> Column:
    return F.shiftright("place", FANOUT_BITS)


def _digit() -> Column:
    return F.col("place").bitwiseAND(F.lit(FANOUT - 1)).cast("int")


def _above(nodes: DataFrame, *carried: str) -> DataFrame:
    """The parents of nodes(group, place, n, digest, ...), where n nodes of a group are on the level: group, place, n, digest and
    kids, in order. A node that is alone on its level has no parent: it is passed on as it is, with itself as its only kid."""
    grouped = nodes.groupBy("group", _parent().alias("place"), "n").agg(F.array_sort(F.collect_list(F.struct(_digit().alias("digit"), "digest", *carried))).alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), "")
    digest = F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(_hashed(joined))
    return grouped.select("group", "place", digest.alias("digest"), "kids", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), (F.col("n") == 1).alias("alone"))


def _up(nodes: DataFrame, name: str, *carried: str) -> list[DataFrame]:
    """The levels above nodes, lowest first, until each group has one node; saved."""
    levels = [save(_above(nodes, *carried), f"{name}1")]
    while not (open_ := levels[-1].where("n > 1")).isEmpty():
        levels.append(save(_above(open_.select("group", "place", "n", "digest")), f"{name}{len(levels) + 1}"))
    return levels


def _handed(nodes: DataFrame, *carried: str) -> DataFrame:
    """The kids of nodes(group, place, kids, alone, path, subroot, root), with their place and the path from them to the root."""
    digit = F.col("kid")["digit"]
    side = lambda test: F.array_join(F.transform(F.filter("kids", lambda k: test(k["digit"])), lambda k: _hex(k["digest"])), "")
    own = F.concat(side(lambda d: d < digit), F.lit("|"), side(lambda d: d > digit))
    return nodes.withColumn("kid", F.explode("kids")).select(
        "group",
        (F.shiftleft("place", FANOUT_BITS) + digit).alias("place"),
        F.when(F.col("alone"), F.col("path")).otherwise(F.concat(own, F.lit(","), F.col("path"))).alias("path"),
        "subroot",
        "root",
        *(F.col("kid")[c].alias(c) for c in ("digest", *carried)),
    )


def _down(levels: list[DataFrame], tops: DataFrame, *carried: str) -> DataFrame:
    """What _handed() gives for the nodes below levels. tops(group, path, subroot, root): of the one node that ends each group."""
    tops, handed = small(tops), None
    for level in reversed(levels):
        nodes = level.where("n = 1").join(tops, "group")
        if handed is not None:
            nodes = nodes.unionByName(level.where("n > 1").join(handed.drop("digest"), ["group", "place"]))
        handed = _handed(nodes, *(carried if level is levels[0] else ()))
    return handed


def steps(path: Column) -> Column:
    """The levels of a path, lowest first: the siblings on the left and on the right, as (left, right)."""
    return F.transform(F.filter(F.split(path, ","), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "|", 1).alias("left"), F.substring_index(x, "|", -1).alias("right")))


def fold(leaf: Column, path: Column) -> Column:
    """The root, in hex, that a leaf in hex gives with the siblings on its path."""
    return F.aggregate(steps(path), leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def manifest(docs: DataFrame, bits: int = DIGIT_BITS, most: int = CELL_ROWS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; and source, place and path, the proof
    itself: for each level the digests on the left, a bar, those on the right and a comma."""
    rows = save(leaves(docs), "leaves")
    sources = save(ranked(rows.groupBy("source").agg(F.count("*").alias("n"))).withColumnRenamed("place", "group"), "sources")
    known = small(sources.select(F.col("source").alias("of"), "group", "n"))
    grouped = save(rows.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "grouped")
    levels = _up(places(grouped, bits, most).withColumnRenamed("leaf", "digest"), "level", "doc_id", "forged", "source")
    ended = [level.where("n = 1").select("group", "digest") for level in levels]
    subroots = ended[0]
    for more in ended[1:]:
        subroots = subroots.unionByName(more)
    # the tree over the sources is one group, in which a source's place is its rank
    n = F.lit(sources.count()).cast("long")
    tops = _up(subroots.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("place"), n.alias("n"), "digest"), "top")
    root = tops[-1].where("n = 1").select("group", F.lit("").alias("path"), F.lit("").alias("subroot"), _hex("digest").alias("root"))
    ends = _down(tops, root).select(F.col("place").alias("group"), "path", _hex("digest").alias("subroot"), "root")
    found = _down(levels, save(ends, "ends"), "doc_id", "forged", "source")
    leaf, path = _hex("digest"), F.col("path")
    return found.select(
        "doc_id",
        leaf.alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.translate(path, "|,", ""), 256).alias("proof_sha256"),
        fold(F.coalesce(_hex("forged"), leaf), path).alias("folded_root"),
        "source",
        "place",
        "path",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
