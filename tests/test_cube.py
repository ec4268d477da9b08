"""The refreshed cube against the one computed anew."""

import random
from datetime import date, timedelta

from lastrum.operators import analytics, cube
from lastrum.sources.stored import StoredTable


def test_refresh_equals_the_whole(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice(("A", "B", None)), rng.choice(("x", None)), rng.choice(("p", "q")), rng.choice((None, 5.0, round(rng.random() * 100, 2))), date(2024, 1, 1) + timedelta(rng.randrange(90))) for _ in range(900)] + [("Z", "z", "only null", None, None)]
    schema = "uf string, municipio string, descricao string, preco double, data date"
    table = StoredTable(spark, f"file://{tmp_path}/cube", cube.STATE, list(cube.CELL), buckets=3)
    opened = None
    for b in range(4):
        table.merge(b, cube.state(spark.createDataFrame(rows[b * 300 : b * 300 + 300], schema)) if b < 3 else cube.state(spark.createDataFrame(rows[900:], schema)), cube.merged)
        opened = opened or table.read()
    wanted = analytics.municipal_cube(spark.createDataFrame(rows, schema))
    got = cube.presented(table.read()).select(wanted.columns)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(wanted)
    first = analytics.municipal_cube(spark.createDataFrame(rows[:300], schema))
    assert key(cube.presented(opened).select(first.columns)) == key(first)  # a reader keeps its version
