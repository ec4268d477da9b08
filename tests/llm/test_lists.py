"""A list of many entries, and sources of many names."""

import random

from pyspark.sql import functions as F

from lastrum.llm import mixing, url_filter


def test_a_hundred_thousand_entries(spark):
    listed = spark.range(100_000).select(
        F.concat(F.lit("h"), F.col("id") % 40_000, F.lit(".site"), F.col("id") % 997, F.lit(".org")).alias("host"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, (F.col("id") % 40 + 1).cast("int")))).alias("path"),
        F.when(F.col("id") % 5 == 0, "allow").otherwise("block").alias("action"),
        (F.col("id") % 2 == 0).alias("is_rule"),
    )
    entries = [tuple(r) for r in listed.collect()]
    rnd = random.Random(6)
    urls = [f"https://{rnd.choice(('', 'www.', 'a.b.'))}{h}{p}{rnd.choice(('', '/x', 'yz?q#'))}" for h, p, _, _ in rnd.sample(entries, 1500)]
    urls += [f"http://h{rnd.randrange(99_000)}.site{rnd.randrange(2000)}.org/{rnd.random()}" for _ in range(1500)] + ["x", None]
    by_host = {}
    for h, p, action, is_rule in entries:
        by_host.setdefault(h, []).append((p, action, is_rule))
    wanted = {}
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        host, path = rest.partition("/")[0], (rest.partition("/")[1] + rest.partition("/")[2]).partition("?")[0].partition("#")[0]
        fits = [(len(h) + len(p), h + p, action, is_rule) for k in range(host.count(".") + 1) for h in [".".join(host.split(".")[k:])] for p, action, is_rule in by_host.get(h, []) if path.startswith(p)]
        rules = sorted((n, key, action) for n, key, action, is_rule in fits if is_rule)
        on_list = any(not x[3] for x in fits)
        wanted[i] = (rules[-1][1] if rules else None, rules[-1][2] if rules else "block" if on_list else "allow", on_list)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert {i: (r.rule, r.verdict, r.listed) for i, r in got.items()} == wanted
    assert sum(x[0] is not None for x in wanted.values()) > 500
    # hosts that aren't listed seldom pass
    assert sum(got[i].probes > 0 for i in range(1500, 3000) if wanted[i] == (None, "allow", False) and "h" in urls[i]) < 300


def test_many_sources(spark):
    rnd = random.Random(8)
    sizes = [(f"s{i:05d}", rnd.randrange(0, 5000)) for i in range(4000)] + [(None, 777)]
    rows = [("-" if s is None else "+" + s, s, n) for s, n in sizes]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "key string, source string, source_size long")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
    size, left, target = dict(sizes), {s for s, _ in sizes}, {}
    while True:
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    target |= {s: level * weight[s] for s in left}
    assert set(got) == set(target) and all(abs(got[s] - target[s]) < 1e-6 * max(1, target[s]) for s in got)


def test_rows_that_repeat_only_the_id_are_split(spark):
    docs = spark.createDataFrame([(7, f"w{i} " * 10, "a") for i in range(2000)] + [(i, "x " * 10, "b") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 40 for r in got)
