"""Components of close fingerprints: contraction of dense balls, exact search between what is left apart."""

import random

from pyspark.sql import functions as F

from crowdgauge.operators import dedup
from crowdgauge.session import small_table


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def flipped(rnd, x, n):
    for bit in rnd.sample(range(64), n):
        x ^= 1 << bit
    return x


def brute(codes, radius):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[i + 1:]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {c: find(c) for c in codes}


def test_components_equal_brute_force(spark):
    rnd = random.Random(8)
    codes = {signed(flipped(rnd, b, rnd.randint(0, 5))) for b in [rnd.getrandbits(64) for _ in range(25)] for _ in range(8)} - {0}
    df = small_table(spark, [(c,) for c in codes] + [(0,), (None,), (min(codes),)], "simhash bigint")
    for radius in (0, 3, 6):
        got = {r["node"]: r["root"] for r in dedup.near_components(df, radius).collect()}
        assert got == brute(sorted(codes), radius)


def test_empty_table_has_no_components(spark):
    assert dedup.near_components(small_table(spark, [], "simhash bigint")).isEmpty()
    assert dedup.near_pairs(small_table(spark, [], "simhash bigint")).isEmpty()


def test_a_dense_ball_gives_linear_links(spark):
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    ball = set()
    while len(ball) < 20_000:
        ball.add(signed(flipped(rnd, centre, rnd.randint(1, 3))))
    far = {signed(flipped(rnd, centre, 30)) for _ in range(50)}
    df = spark.createDataFrame([(c,) for c in ball | far], "simhash bigint")
    links = dedup.near_links(df.withColumnRenamed("simhash", "h")).count()
    assert 20_000 <= links <= 11 * 20_000
    sizes = dedup.near_components(df).groupBy("root").count().orderBy(F.desc("count")).collect()
    assert sizes[0]["count"] == 20_000 and len(sizes) == 51


def test_settled_groups_are_not_compared(spark):
    rows = [(signed(1 << i | 1 << j), 1) for i in range(20) for j in range(i)] + [(signed(0b111 << 20), 2)]
    df = small_table(spark, rows, "h bigint, label bigint")
    got = {(r["a"], r["b"]) for r in dedup.pairs_across(df, 6, group_limit=1).collect()}
    lone = rows[-1][0]
    assert got == {(min(h, lone), max(h, lone)) for h, label in rows[:-1] if bin(h ^ lone).count("1") <= 6}
