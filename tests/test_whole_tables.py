"""Queries over whole tables against brute force."""

from collections import defaultdict

from tilequarry.operators import aggregate
from tilequarry.plans import catalogue


def test_upper_median_of_all_rows(spark, sf_dir):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        groups[r.l_returnflag, r.l_linestatus].append(r.l_quantity)
    got = {(r.l_returnflag, r.l_linestatus): r.med for r in catalogue.QUERIES["upper_median"](spark, sf_dir).collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in groups.items()}


def test_medians_ties_nulls_and_small_groups(spark):
    rows = [("a", 1), ("a", 2), ("b", 5), ("b", 5), ("b", 1), ("c", None), ("d", None), ("d", 7), (None, 3), ("e", 4), ("e", 4), ("e", 9), ("e", 9)]
    out = aggregate.medians(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", "med")
    assert {r.g: r.med for r in out.collect()} == {"a": 2, "b": 5, "c": None, "d": 7, None: 3, "e": 9}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_fold_over_of_all_keys(spark, sf_dir):
    stacks = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect():
        stacks[r.l_orderkey].append((r.l_linenumber * 100000 + r.l_partkey, r.l_quantity, r.l_discount))
    got = {r.l_orderkey: (r.value, r.alpha) for r in catalogue.QUERIES["fold_over"](spark, sf_dir).collect()}
    assert set(got) == set(stacks)
    for key, stack in stacks.items():
        value = alpha = 0.0
        for _, v, o in sorted(stack):
            total = o + alpha * (1 - o)
            value, alpha = (v * o + value * alpha * (1 - o)) / total if total > 0 else 0.0, total
        assert abs(got[key][0] - value) < 1e-6 and abs(got[key][1] - alpha) < 1e-6
