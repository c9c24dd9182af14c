"""Ordered passes against plain Python, and their spread over tasks under a hot key."""

import random

from pyspark.sql import functions as F

from assayer.operators import prefix


def rows(n=400, seed=1):
    r = random.Random(seed)
    return [(("hot" if r.random() < 0.5 else r.choice("abc")), r.randrange(40), i, r.randrange(10)) for i in range(n)]


def by_key(data):
    out = {}
    for k, t, i, v in sorted(data, key=lambda x: (x[1], x[2])):
        out.setdefault(k, []).append((t, i, v))
    return out


def test_running_totals_and_numbers(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, t long, i long, v long")
    for levels in ([F.floor(F.col("t") / 7)], [F.floor(F.col("t") / 13), F.col("t"), F.floor(F.col("i") / 50)]):
        got = {r.i: (r.s, r.n) for r in prefix.running_totals(
            df, ["k"], levels, ["t", "i"], {"s": F.col("v"), "n": F.lit(1).cast("long")}).collect()}
        for items in by_key(data).values():
            total = 0
            for n, (_, i, v) in enumerate(items, 1):
                total += v
                assert got[i] == (total, n)


def test_neighbours(spark):
    data = rows(seed=3)
    df = spark.createDataFrame(data, "k string, t long, i long, v long")
    level = F.floor(F.col("t") / 3)
    before = {r.i: r.p for r in prefix.previous(df, ["k"], level, ["t", "i"], {"p": "v"}).collect()}
    after = {r.i: r.p for r in prefix.following(df, ["k"], level, ["t", "i"], {"p": "v"}).collect()}
    for items in by_key(data).values():
        for n, (_, i, _v) in enumerate(items):
            assert before[i] == (items[n - 1][2] if n else None)
            assert after[i] == (items[n + 1][2] if n + 1 < len(items) else None)


def test_null_values_move_along(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 9, None), ("a", 12, 7)], "k string, t long, v long")
    got = [(r.t, r.p) for r in prefix.previous(df, ["k"], F.floor(F.col("t") / 5), ["t"], {"p": "v"}).orderBy("t").collect()]
    assert got == [(1, None), (2, None), (9, 5), (12, None)]


def test_order_statistics(spark):
    data = [("a", x / 10) for x in (5, 1, 1, 9, 3)] + [("b", 0.5)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.n, r.lo, r.mid) for r in prefix.order_statistics(
        df, ["k"], "v", prefix.value_levels("v"), {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2)}).collect()}
    assert got == {"a": (5, 0.1, 0.3), "b": (1, 0.5, 0.5)}


def test_hot_key_is_spread(spark):
    """Half of the rows share a key; still no task holds a third of them."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("k"), "id")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = prefix.row_numbers(df, ["k"], [prefix.block_of("id", 128)], ["id"])
        sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 3


def test_null_keys_levels_and_order(spark):
    rows = [(k, v, o) for k in (None, "a", "b") for v in (None, 1, 2, 500) for o in (None, 3, 4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, v long, o long")
    df.createOrReplaceTempView("null_rows")
    level, order = prefix.block_of("v", 4), ["v", "o", "id"]
    over = "OVER (PARTITION BY k ORDER BY v NULLS FIRST, o NULLS FIRST, id)"
    want = {r.id: r for r in spark.sql(f"""SELECT id, row_number() {over} AS rn, sum(o) {over.replace(')', ' ROWS UNBOUNDED PRECEDING)')} AS upto,
        lag(id) {over} AS before, lead(id) {over} AS after FROM null_rows""").collect()}
    number = prefix.row_numbers(df, ["k"], [level], order).collect()
    total = prefix.running_totals(df, ["k"], [level, F.col("v")], order, {"upto": F.coalesce("o", F.lit(0))}).collect()
    before = prefix.previous(df, ["k"], level, order, {"before": "id"}).collect()
    after = prefix.following(df, ["k"], level, order, {"after": "id"}).collect()
    assert all(len(x) == len(rows) for x in (number, total, before, after))
    assert all(r.rn == want[r.id].rn for r in number)
    assert all(r.upto == (want[r.id].upto or 0) for r in total)
    assert all(r.before == want[r.id].before for r in before) and all(r.after == want[r.id].after for r in after)


def test_order_statistics_with_a_null_key(spark):
    df = spark.createDataFrame([(None, 0.5), (None, 0.1), (None, 0.9), ("a", 0.3), ("a", None)], "k string, v double")
    got = prefix.order_statistics(df, ["k"], "v", prefix.value_levels("v"), {"mid": F.floor(F.col("n") / 2)}).collect()
    assert sorted((str(r.k), r.n, r.mid) for r in got) == [("None", 3, 0.5), ("a", 1, 0.3)]


def test_range_ranks(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 0.5, 0.5, 0.5, rng.random()]), rng.randint(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, a double, b int").repartition(7)
    got = {r.i: (r.k, r.a, r.b, r.rank_0, r.rank_1, r.mean_0, r.mean_1) for r in prefix.range_ranks(df, ["k"], "i", ["a", "b"]).collect()}
    want = {}
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        ranks = []
        for c in (2, 3):
            order = sorted(own, key=lambda r: (r[c] is not None, r[c] or 0, r[1]))
            place = {r[1]: n for n, r in enumerate(order, 1)}
            mean = {v: sum(x) / len(x) for v in {r[c] for r in own} for x in [[place[r[1]] for r in own if r[c] == v]]}
            ranks.append((place, mean))
        want |= {r[1]: (*r[:1], r[2], r[3], ranks[0][0][r[1]], ranks[1][0][r[1]], ranks[0][1][r[2]], ranks[1][1][r[3]]) for r in own}
    assert got == want
    assert prefix.range_ranks(df.limit(0), ["k"], "i", ["a", "b"]).count() == 0
