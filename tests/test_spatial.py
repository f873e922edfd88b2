"""Joins of boxes of all sizes, and lookups of ancestors, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tilequarry.operators import spatial

BOX = "id long, w double, s double, e double, n double"


def boxes(seed, many):
    pick = random.Random(seed)
    out = []
    for i in range(many):
        side = 2.0 ** pick.randint(-8, 8)
        w, s = pick.choice([pick.uniform(-180, 180), float(pick.randint(-180, 180))]), pick.uniform(-90, 90)
        out.append((i, w, s, w + pick.choice([0.0, side, side / 3]), s + side))
    return out


def meet(a, b):
    return a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_of_all_sizes(spark, seed):
    left, right = boxes(seed, 120), boxes(seed + 100, 90)
    odd = [(900, None, 0.0, 1.0, 1.0), (901, 5.0, 0.0, -5.0, 1.0)]
    got = spatial.overlap_join(spark.createDataFrame(left + odd, BOX), spark.createDataFrame(right + odd, BOX)).collect()
    assert sorted(map(tuple, got)) == sorted((a[0], b[0]) for a in left for b in right if meet(a, b))


def test_empty_sides(spark):
    some, none = spark.createDataFrame(boxes(3, 5), BOX), spark.createDataFrame([], BOX)
    assert spatial.overlap_join(some, none).count() == 0
    assert spatial.overlap_join(none, some).count() == 0
    assert [r.right_id for r in spatial.first_overlap(some, none).collect()] == [None] * 5


def test_ancestors_on_both_sides_of_the_broadcast(spark):
    pick = random.Random(4)
    wanted = {(z, pick.randrange(2**z), pick.randrange(2**z)) for z in (0, 5, 12, 14) for _ in range(30)}
    have = {(z, x >> (14 - z), y >> (14 - z)) for z0, x, y in wanted if z0 == 14 for z in (1, 6, 11, 13) if pick.random() < 0.3}
    tiles = "z int, x long, y long"
    got = spatial.coarser_fallback(spark.createDataFrame(sorted(wanted), tiles), spark.createDataFrame(sorted(have), tiles))
    want = [(z, x, y, max((k for k in range(z + 1) if (k, x >> (z - k), y >> (z - k)) in have), default=None)) for z, x, y in wanted]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert spatial.coarser_fallback(spark.createDataFrame([(3, 1, 1)], tiles), spark.createDataFrame([], tiles)).where(F.col("found_z").isNull()).count() == 1


def crowd(seed, many, width, height, start=0):
    """Boxes of one small region."""
    pick = random.Random(seed)
    out = []
    for i in range(many):
        w, s = pick.uniform(6, 10), pick.uniform(46, 48)
        out.append((start + i, w, s, w + width * pick.random(), s + height * pick.random()))
    return out


def test_crowded_boxes_meet_in_small_cells(spark):
    """Candidate pairs follow the pairs that overlap, not the square of what lies in a region."""
    small, large = crowd(5, 3000, 0.05, 0.02), crowd(6, 1500, 0.3, 2.0)
    want = sorted((a[0], b[0]) for a in small for b in large if meet(a, b))
    one, two = spark.createDataFrame(small, BOX), spark.createDataFrame(large, BOX)
    assert sorted(map(tuple, spatial.overlap_join(one, two).collect())) == want
    assert sorted(tuple(r)[::-1] for r in spatial.overlap_join(two, one).collect()) == want
    fine, coarse = (df.groupBy("_l", "_cx", "_cy").count() for df in spatial._sides(one, two, True))
    both = fine.join(coarse.withColumnRenamed("count", "n"), ["_l", "_cx", "_cy"])
    assert both.agg(F.sum(F.col("count") * F.col("n"))).first()[0] < 4 * len(want)


def test_first_overlap_makes_few_pairs(spark, monkeypatch):
    """The smallest id whichever side is larger, with few of the pairs made where the right one is."""
    seen, plain = [], spatial._firsts
    monkeypatch.setattr(spatial, "_firsts", lambda a, b: (seen.append(plain(a, b)), seen[-1])[1])
    small, large = crowd(7, 2000, 0.05, 0.05), crowd(8, 1500, 1.5, 1.5, 5000)
    for left, right in ((small, large), (large, small), (small + large, small + large)):
        seen.clear()
        got = spatial.first_overlap(spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX)).collect()
        met = {a[0]: [b[0] for b in right if meet(a, b)] for a in left}
        assert {r.left_id: r.right_id for r in got} == {k: min(v, default=None) for k, v in met.items()}
        assert left is not small or sum(df.count() for df in seen) < sum(map(len, met.values())) / 2


@pytest.mark.parametrize("degrees", [0.25, 64.0])
def test_nearest_of_crowded_and_scattered_centres(spark, degrees):
    """Copies, ties, a dense cluster and far points, against all pairs."""
    pick = random.Random(9)
    centres = [(i, 7 + pick.random() / 100, 46 + pick.random() / 100) for i in range(700)] + [(700 + i, pick.uniform(-180, 180), pick.uniform(-80, 80)) for i in range(60)]
    centres += [(2000 + i, lon, lat) for i, lon, lat in centres[:50]] + [(3000, 1.0, 0.0), (3001, -1.0, 0.0), (3002, None, 1.0)]
    points = [(i, pick.uniform(-180, 180), pick.uniform(-80, 80)) for i in range(80)] + [(100 + i, 7 + pick.random() / 90, 46 + pick.random() / 90) for i in range(150)] + [(500, 0.0, 0.0)]
    table = "id long, lon double, lat double"
    got = spatial.nearest(spark.createDataFrame([*points, (501, None, 2.0)], table), spark.createDataFrame(centres, table), degrees)
    want = {p: min(((lon - x) ** 2 + (lat - y) ** 2, c) for c, x, y in centres if x is not None) for p, lon, lat in points}
    rows = got.collect()
    assert {r.point_id: r.centre_id for r in rows} == {p: c for p, (_, c) in want.items()} and len(rows) == len(points)
    assert all(abs(r.dist2 - want[r.point_id][0]) < 1e-9 for r in rows)


def test_nearest_makes_no_row_for_a_candidate(spark):
    """On a crowd of centres, what is grouped by point is a few rows a point."""
    pick = random.Random(10)
    some = lambda n: spark.createDataFrame([(i, pick.uniform(6, 10), pick.uniform(46, 48)) for i in range(n)], "id long, lon double, lat double").repartition(4)
    points, centres = some(300), some(4000)
    plan = spatial.nearest(points, centres, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in plan and "collect_list" in plan
