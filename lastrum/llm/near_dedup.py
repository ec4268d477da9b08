"""MinHash near-deduplication: universal hash minima, banding, signature verification, exact verification, star components.

Documents with the same set of shingles form a class, and one node stands for it, so exact copies cost nothing further. Nodes
whose minima agree in a band meet in a bucket. In each bucket a centre is compared with all others; after that most buckets
are of one component. The nodes of the rest meet at their rarest shingles instead: two linked sets share one of them. Keys
with few pairs between components for each member have these compared, first by signatures (six standard errors below the
threshold), then on full shingle sets. The nodes at other keys are compared with a centre only, and those near it with each
other by what sets them apart from it: of the variants of one text, each with changes of its own, only those that
share changes meet. So no link is lost to a cap, and no group emits all its pairs.

Defined results: a null or empty text has no shingles and is linked with nothing. A text with fewer words than a shingle is
one shingle. A null doc_id is linked with nothing, has a null component and is kept. Each row is judged by its own text, so a
repeated doc_id can occur in several components. Of an empty table the result is empty. Extra columns are ignored by find()
and passed on by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.llm.components import components
from lastrum.llm.shared import HEAVY, drop, save, small, unused
from lastrum.llm.words import chunks, mixed, shingles

#: 32 bands of 4 minima: a pair at a similarity of 0.85 is missed with a chance of 6e-11, at 0.8 of 5e-8.
MINIMA, ROWS = 128, 4
#: A key with at most so many pairs a member between its components has them compared at once.
PAIRS_EACH = 16
#: Nodes at so much similarity or more with a centre are settled in its family.
CLOSE = 0.6
#: Hash cells in which the rarity of shingles is counted; a power of 2.
CELLS = 1 << 20
STANDARD_ERRORS = 6


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n universal hash functions x -> (a x + b) >> 32."""
    numbers = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:n] | np.uint64(1), numbers[n:]


def _fingerprints(found: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits of each set: two sums over its elements."""
    sums = [np.add.reduceat(mixed(found ^ np.uint64(seed)), starts) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [x.tobytes() for x in np.stack(sums, axis=1)]


def _features(width: int, minima: int, with_sets: bool):
    a, b = _hash_family(minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found, offsets = shingles(texts, width)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            prints: list = [None] * len(texts)
            minimum = np.zeros((len(texts), 0 if with_sets else minima), np.uint32)
            if len(full):
                starts = offsets[:-1][full]
                for i, x in zip(full, _fingerprints(found, starts), strict=True):
                    prints[i] = x
                for k in range(minimum.shape[1]):
                    minimum[full, k] = np.minimum.reduceat((found * a[k] + b[k]) >> np.uint64(32), starts)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(prints, pa.binary())]
            if with_sets:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int64))))
            else:
                columns.append(pa.array([x.tobytes() for x in minimum], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "print", "members" if with_sets else "minima"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def features(docs: DataFrame, width: int, minima: int = MINIMA) -> DataFrame:
    """(doc_id, text_hash, n_shingles, print, minima) of each document."""
    return _texts(docs).mapInArrow(_features(width, minima, False), "doc_id long, text_hash long, n_shingles long, print binary, minima binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, print, members): the whole shingle sets of the documents that nodes(node, print) names."""
    texts = _texts(docs).join(small(nodes.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_features(width, 0, True), "doc_id long, text_hash long, n_shingles long, print binary, members array<bigint>")
    return sets.select(F.col("doc_id").alias("node"), "print", "members").join(small(nodes), ["node", "print"], "left_semi")


def _agreeing(minima: int, threshold: float):
    """Keeps the pairs whose signatures don't rule out the threshold."""
    least = minima * threshold - STANDARD_ERRORS * (minima * threshold * (1 - threshold)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32).reshape(-1, minima) for c in ("x", "y"))
                yield part.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def _checked(pairs: DataFrame, nodes: DataFrame, minima: int, threshold: float) -> DataFrame:
    """Of pairs(a, b), those that pass signature verification."""
    sides = pairs.join(nodes.select(F.col("node").alias("b"), F.col("minima").alias("y")), "b").join(nodes.select(F.col("node").alias("a"), F.col("minima").alias("x")), "a")
    return sides.select("a", "b", "x", "y").mapInArrow(_agreeing(minima, threshold), "a long, b long").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose sets share at least percent of their union."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).alias("t")).where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b").distinct()


def _prefixes(cells: np.ndarray):
    """The rarest members of each set, as many as its length says: (key, ref, node, at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[], [], [], [], []]
            for ref, node, members, length in zip(*(batch.column(c).to_pylist() for c in ("ref", "node")), batch.column("members"), batch.column("length").to_pylist(), strict=True):
                x = members.values.to_numpy(zero_copy_only=False)
                often = cells[x & (len(cells) - 1)]
                first = np.lexsort((x, often))[:length]
                at = np.flatnonzero(often[first] > 1)
                for column, values in zip(out, (x[first][at], np.full(len(at), ref), np.full(len(at), node), at, np.full(len(at), len(x))), strict=True):
                    column.append(values.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["key", "ref", "node", "at", "n"])

    return run


def prefix_members(sets: DataFrame) -> DataFrame:
    """(key, ref, node, at, n) of sets(ref, node, members, length): the length rarest members of each set, rarest first, but those
    that no other set has. Any order of the members finds every link; rarity is counted in a fixed number of hash cells over all
    the sets, so what the driver gathers is bounded."""
    counts = sets.select(F.explode("members").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.count("*").alias("c")).toArrow()
    cells = np.zeros(CELLS, np.int64)
    cells[counts.column("cell").to_numpy()] = counts.column("c").to_numpy()
    return sets.select("ref", "node", "members", "length").mapInArrow(_prefixes(cells), "key long, ref long, node long, at long, n long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component of their node; a node without a link is its own."""
    return rows.drop("component").join(small(found), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links; only components that a new link joins are worked on."""
    if links.isEmpty():
        return found
    side = lambda name: _placed(links.select("a", "b", F.col(name).alias("node")), found).select("a", "b", F.col("component").alias(f"c{name}"))
    lifted = save(side("a").join(side("b"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "lifted")
    if lifted.isEmpty():
        return found
    step = save(components(lifted), "joined")
    later = step.select(F.col("node").alias("component"), F.col("component").alias("later"))
    moved = found.join(small(later), "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    return save(moved.unionAll(step.join(small(found.select("node")), "node", "left_anti")), "components")


def _deltas(left: DataFrame, sets: DataFrame, turn: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Families around centres: close(node, ref), the nodes at a similarity of CLOSE or more with their centre, and
    deltas(ref, node, w, whole, delta), by how far a node that could be linked with one of those differs from the centre."""
    own = left.select("key", "node", "s")
    lead = own.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("lead"))
    among = F.pmod(F.xxhash64("node", F.lit(-turn)), F.greatest(F.floor(F.col("s") / 2**turn), F.lit(1))) == 0 if turn else F.lit(False)
    centres = own.join(lead, "key").where((F.col("node") == F.col("lead")) | among).select("key", F.col("node").alias("ref"))
    met = save(centres.join(own, "key").select("ref", "node").distinct(), "met")

    def compared(pairs: DataFrame, least: float) -> DataFrame:
        x, c = sets.select("node", F.col("members").alias("x")), sets.select(F.col("node").alias("ref"), F.col("members").alias("c"))
        both = pairs.join(x, "node").join(c, "ref").select("ref", "node", F.size("x").alias("n"), F.size("c").alias("whole"), F.array_except("c", "x").alias("lost"), F.array_except("x", "c").alias("added"))
        shared = F.col("whole") - F.size("lost")
        return both.withColumn("j", shared / (F.col("n") + F.col("whole") - shared)).where(F.col("j") >= least - 1e-9)

    close = compared(met, CLOSE).groupBy("node").agg(F.max_by("ref", F.struct("j", "ref")).alias("ref"))
    close = save(close, "close")
    # whoever shares a key with a close node, and isn't too far from the centre by the triangle inequality of Jaccard distances
    refs = own.join(close, "node").select("key", "ref").distinct()
    family = save(refs.join(own, "key").select("ref", "node").distinct(), "family")
    w = F.col("n") * percent + F.size("lost") * (100 + percent)
    deltas = compared(family, CLOSE + percent / 100 - 1).select("ref", "node", w.alias("w"), (F.col("whole") * (100 + percent)).alias("whole"), F.concat("lost", "added").alias("delta"))
    return close, save(deltas, "deltas")


def _family_links(close: DataFrame, deltas: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The components with the links within families.

    x and y share whole - lost(x) - lost(y) + overlap of their deltas, so they are linked if (100 + percent) * overlap is at least
    w(x) + w(y) - whole. Where that is not above 0 both are linked with the member of the smallest w: a star, no pairs. Else
    they meet at the rare parts of their deltas, which members of a family with changes of their own seldom share.
    """
    least = deltas.groupBy("ref").agg(F.min(F.struct("w", "node")).alias("best"))
    rows = deltas.join(least, "ref").withColumn("spare", F.col("w") + F.col("best.w") - F.col("whole"))
    star = rows.where("spare <= 0 and node <> best.node").select(*_ordered(F.col("node"), F.col("best.node"))).distinct()
    found = _merged(found, save(star, "links"))
    need = F.greatest(F.ceil(F.col("spare") / (100 + percent)), F.lit(1))
    hashed = F.transform("delta", lambda e: F.xxhash64("ref", e))
    keyed = prefix_members(rows.select("ref", "node", hashed.alias("members"), F.greatest(F.size("delta") - need + 1, F.lit(0)).cast("long").alias("length")))
    about = deltas.select("ref", "node", "w", "whole").join(close.withColumn("own", F.lit(True)), ["ref", "node"], "left")
    keyed = _placed(keyed.join(about, ["ref", "node"]), found)
    apart = keyed.groupBy("key", "ref").agg(F.min("component").alias("l"), F.max("component").alias("m")).where("l < m").select("key", "ref")
    keyed = save(keyed.join(apart, ["key", "ref"]), "differences")

    def linked(pairs: DataFrame) -> DataFrame:
        x = deltas.select("ref", F.col("node").alias("a"), F.col("w").alias("wa"), "whole", F.col("delta").alias("x"))
        y = deltas.select("ref", F.col("node").alias("b"), F.col("w").alias("wb"), F.col("delta").alias("y"))
        both = pairs.join(x, ["ref", "a"]).join(y, ["ref", "b"]).where(F.size(F.array_intersect("x", "y")) * (100 + percent) >= F.col("wa") + F.col("wb") - F.col("whole"))
        return save(both.select(*_ordered("a", "b")).distinct(), "links")

    # first each key's member of the smallest w with the others, then what is left between components
    leads = keyed.groupBy("key", "ref").agg(F.min_by("node", "w").alias("lead"))
    star = keyed.join(leads, ["key", "ref"]).where("node <> lead").select("ref", F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    found = _merged(found, linked(save(star, "pairs")))
    placed = save(_placed(keyed, found), "placed")
    overlap = F.least(F.col("s.n") - F.col("s.at"), F.col("t.n") - F.col("t.at")) * (100 + percent)
    meets = (F.col("s.key") == F.col("t.key")) & (F.col("s.ref") == F.col("t.ref")) & (F.col("s.component") < F.col("t.component"))
    meets = meets & (overlap >= F.col("s.w") + F.col("t.w") - F.col("s.whole")) & (F.col("s.own") | F.col("t.own"))
    pairs = placed.alias("s").join(placed.alias("t"), meets).select(F.col("s.ref").alias("ref"), F.col("s.node").alias("a"), F.col("t.node").alias("b")).distinct()
    return _merged(found, linked(save(pairs, "pairs")))


def link_components(docs: DataFrame, nodes: DataFrame, width: int, percent: int, minima: int = MINIMA, rows: int = ROWS) -> DataFrame:
    """(node, component) of the nodes(node, print, minima) that have a link."""
    threshold = percent / 100
    keys = F.transform(F.sequence(F.lit(0), F.lit(minima // rows - 1)), lambda j: F.xxhash64(j, F.substring("minima", j * (4 * rows) + 1, F.lit(4 * rows))))
    bands = nodes.select("node", F.explode(keys).alias("key"))
    buckets = save(bands.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = save(bands.join(small(buckets.select("key", "centre")), "key").where("node <> centre").select("key", "centre", "node"), "members")
    # each bucket's centre against its other members
    likely = save(_checked(members.select(*_ordered("centre", "node")).distinct(), nodes, minima, threshold), "likely")
    wanted = save(nodes.select("node", "print").join(small(_ends(likely)), "node", "left_semi"), "wanted")
    sets = save(shingle_sets(docs, wanted, width), "sets")
    found = save(components(save(_linked(likely, sets, percent), "links")), "components")
    # buckets whose other members are still in more than one component: their links are found by rare shingles
    apart = _placed(members.select("key", "node"), found).groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("m")).where("l < m").select("key")
    undecided = save(members.join(small(save(apart, "apart")), "key", "left_semi").select("node").distinct(), "undecided")
    drop(buckets, members, likely)
    more = save(nodes.select("node", "print").join(small(undecided), "node", "left_semi").join(small(wanted.select("node")), "node", "left_anti"), "wanted")
    if not more.isEmpty():
        sets = sets.unionAll(save(shingle_sets(docs, more, width), "sets"))
    size = F.size("members").cast("long")
    open_sets = sets.join(small(undecided), "node", "left_semi").select(F.lit(0).cast("long").alias("ref"), "node", "members", (size - F.ceil(size * percent / 100) + 1).alias("length"))
    members = save(prefix_members(open_sets).drop("ref"), "prefixes")
    turn = 0
    while True:
        # a member whose rarer shingles leave too few for even the smallest set at its key has no link there
        most = F.floor((F.col("n") - F.col("at")) * (100 + percent) / percent) - F.col("n")
        least = members.groupBy("key").agg(F.min("n").alias("least"))
        placed = _placed(members.join(least, "key").where(most >= F.col("least")).drop("least"), found)
        counts = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
        keys = counts.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("k")).where("k > 1")
        keys = save(keys.select("key", "s", ((F.col("s") * F.col("s") - F.col("q")) / 2 <= F.col("s") * PAIRS_EACH).alias("few")), "open")
        left = save(placed.join(small(keys), "key"), "placed")
        if left.isEmpty():
            return found
        # keys with few pairs: these are compared at once, by signatures and then on whole sets
        some = left.where("few")
        x, y = F.least(F.col("s.n") - F.col("s.at"), F.col("t.n") - F.col("t.at")), F.col("s.n") + F.col("t.n")
        meets = (F.col("s.key") == F.col("t.key")) & (x * (100 + percent) >= y * percent) & (F.col("s.component") < F.col("t.component"))
        pairs = save(some.alias("s").join(some.alias("t"), meets).select(*_ordered(F.col("s.node"), F.col("t.node"))).distinct(), "pairs")
        found = _merged(found, save(_linked(_checked(pairs, nodes, minima, threshold), sets, percent), "links"))
        # the others: families around centres, of which each key gets twice as many in the next turn
        rest = left.where("not few")
        if rest.isEmpty():
            return found
        close, deltas = _deltas(rest, sets, turn, percent)
        found = _family_links(close, deltas, found, percent)
        members = save(rest.select("key", "node", "at", "n").join(small(close.select("node")), "node", "left_anti"), "members")
        turn = turn + 1


def find(docs: DataFrame, width: int = 5, percent: int = 80, minima: int = MINIMA, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, print, component_id (smallest doc_id reachable by links), kept."""
    each = save(features(docs, width, minima), "features")
    classes = save(each.where("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("minima").alias("minima")), "classes")
    found = link_components(docs, classes, width, percent, minima, rows)
    placed = classes.select("print", "node", "copies").join(found, "node", "left").select("print", "copies", F.coalesce("component", "node").alias("component"))
    placed = save(placed.where((F.col("copies") > 1) | (F.col("component") != F.col("node"))), "placed")
    cut = max(2, each.count() // HEAVY)
    heavy = placed.where(F.col("copies") >= cut).select(F.col("print").alias("p1"), F.col("component").alias("c1"))
    light = placed.where(F.col("copies") < cut).select(F.col("print").alias("p2"), F.col("component").alias("c2"))
    # at most a thousand classes hold a thousandth of all rows each: those by broadcast, the rest by a shuffle without hot keys
    out = each.drop("minima").join(F.broadcast(heavy), F.col("print") == F.col("p1"), "left")
    out = out.withColumn("p", F.when(F.col("c1").isNull() & F.col("print").isNotNull(), F.col("print")).otherwise(F.unhex(F.concat(F.lit("FF"), F.hex(F.monotonically_increasing_id())))))
    out = out.join(light, F.col("p") == F.col("p2"), "left")
    component = F.when(F.col("doc_id").isNotNull() & F.col("print").isNotNull(), F.coalesce("c1", "c2", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "print", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest doc_id; columns as they came."""
    i, h = unused(docs, "gone_id"), unused(docs, "gone_hash")
    gone = save(find(docs, width, percent).where("not kept").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct(), "gone")
    return docs.join(small(gone), (docs["doc_id"].cast("long") == F.col(i)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")
