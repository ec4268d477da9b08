"""The Merkle manifest against a tree built row by row, and its places against a sort."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lastrum.llm import manifest
from lastrum.llm.manifest import fold, places, ranked
from lastrum.llm.shared import save

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return h(*map(written, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(leaves):
    """The root, and of each leaf the siblings on each level as (left, right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, k in zip(paths, at, strict=True):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            path.append((run[: k % 16], run[k % 16 + 1 :]))
        level, at = [h(*level[k : k + 16]) for k in range(0, len(level), 16)], [k // 16 for k in at]
    return level[0], paths


def plain(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in sources[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, own, r), path in zip(sources[s], trees[s][1], strict=True):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = text.translate(LOW)
            node = leaf(r, text)
            for left, right in path + top:
                node = h(*left, node, *right)
            out.append((r["doc_id"], own, trees[s][0], root, h(*(x for left, right in path + top for x in left + right)), node, node == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(docs, **limits):
    got = [tuple(r) for r in manifest.manifest(docs, **limits).select(*COLUMNS).collect()]
    wanted = plain(docs.collect())
    assert sorted(got, key=str) == sorted(wanted, key=str)
    return got


def test_odd_documents(odd_docs):
    check(odd_docs)


def test_no_documents(no_docs):
    assert manifest.manifest(no_docs).count() == 0


@pytest.mark.parametrize(("ids", "limits"), [("dense", {"bits": 4, "most": 40}), ("wide", {"bits": 6, "most": 60}), ("hot", {"bits": 8, "most": 60})])
def test_trees(spark, ids, limits):
    rng = random.Random(ids)
    made = {"dense": lambda k: k, "wide": lambda k: rng.choice((-1, 1)) * rng.getrandbits(rng.randrange(1, 64)), "hot": lambda k: rng.choice((7, 7, None, k))}[ids]
    rows = [(made(k), f"Text {k % 90}", "en", "hot" if k % 3 else rng.choice((None, "", "é", "z", "Z", "one", "two")), k % 4) for k in range(900)] + [(1, "alone", None, "lone", None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), **limits)


def test_one_row_and_one_source(spark):
    one = spark.createDataFrame([(5, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = check(one)
    assert row[1] == row[2] == row[3] and row[4] == h()
    check(one.unionAll(one).unionAll(one.withColumn("doc_id", F.lit(6).cast("long"))))


def test_many_sources(spark):
    rows = [(k, "t", None, f"s{k % 300}", k) for k in range(700)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_places_are_those_of_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice((None, 5, 5, -(2**63), 2**63 - 1, rng.randrange(50))), bytes([rng.choice((0, 0, 255, rng.randrange(256)))]) * 32, k) for k in range(2000)]
    table = save(spark.createDataFrame(rows, "group long, doc_id long, leaf binary, rid long"), "rows")
    got = {(r["group"], r["rid"]): r["place"] for r in places(table, bits=5, most=6).collect()}
    wanted, seen = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        wanted[r[0], r[3]] = seen[r[0]]
        seen[r[0]] += 1
    assert got == wanted


def test_sources_are_ranked_bytewise(spark):
    names = [None, "", "a", "B", "ab", "é", "￿", "\U0001f600", "z"]
    got = [r["source"] for r in ranked(spark.createDataFrame([(x,) for x in names], "source string")).orderBy("place").collect()]
    assert got == sorted(names, key=lambda s: (s is not None, (s or "").encode()))


def test_path_proves_each_row(spark):
    docs = spark.createDataFrame([(k, f"T{k}", "en", f"s{k % 3}", k) for k in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    row = manifest.manifest(docs).withColumn("again", fold(F.col("leaf"), F.col("path"))).withColumn("other", fold(F.sha2(F.lit("x"), 256), F.col("path")))
    assert row.where("again = root AND other <> root").count() == 100
