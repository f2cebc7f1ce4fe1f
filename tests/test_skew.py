import random
from collections import defaultdict

from proofloom.operators.skew import join_key_values, key_statistics, number_within_keys
from proofloom.sources.tables import latest

SCHEMA = "k string, v bigint, w bigint"


def rows(n=3000):
    rng = random.Random(1)
    keys = ["hot"] * 6 + ["a", "b", None, "c"]
    return [(rng.choice(keys), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3])) for _ in range(n)]


def test_numbers_are_exact_and_in_order(spark):
    data = rows()
    got = number_within_keys(spark.createDataFrame(data, SCHEMA), ["k"], ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r._number, r.v))
    assert len(got) == len(data)
    for pairs in by.values():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1))
        values = [-1 if v is None else v for _, v in pairs]
        assert values == sorted(values)


def test_statistics_merge_chunks_exactly(spark):
    data = rows()
    want = defaultdict(lambda: [0, 0, set()])
    for k, v, w in data:
        want[k][0] += 1
        want[k][1] += w or 0
        want[k][2] |= {v} - {None}
    got = key_statistics(spark.createDataFrame(data, SCHEMA), ["k"], "v", "w", chunk_rows=7).collect()
    assert {r.k: (r["rows"], r.total, r.distinct) for r in got} == {k: (a, b, len(c)) for k, (a, b, c) in want.items()}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert number_within_keys(empty, ["k"], ["v"]).count() == 0
    assert key_statistics(empty, ["k"], "v", "w").count() == 0
    values = spark.createDataFrame([], "k string, n bigint, x string")
    assert join_key_values(empty, values, ["k"], "n").count() == 0


def test_hot_and_cold_keys_get_their_values(spark):
    data = rows()
    big = spark.createDataFrame(data, SCHEMA)
    counts = defaultdict(int)
    for k, _, _ in data:
        counts[k] += 1
    values = spark.createDataFrame([(k, n, f"x{k}") for k, n in counts.items() if k not in (None, "b")], "k string, n bigint, x string")
    for hot_keys in (2, 1000):
        got = join_key_values(big, values, ["k"], "n", hot_keys).collect()
        assert len(got) == len(data)
        assert all(r.x == (None if r.k in (None, "b") else f"x{r.k}") for r in got)


def test_latest_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "b", 7), (2, None, None), (None, "x", 1), (None, "y", 2)], "id bigint, v string, received_at bigint")
    assert sorted(((r.id, r.v) for r in latest(df, ["id"]).collect()), key=str) == sorted([(1, "b"), (2, None), (None, "y")], key=str)
    assert latest(df.limit(0), ["id"]).count() == 0


def test_numbers_over_all_rows_and_running_sums(spark):
    df = spark.createDataFrame([(i, (i * 7) % 50, i % 3) for i in range(200)], "id bigint, v bigint, w bigint")
    got = sorted(number_within_keys(df, [], ["v", "id"], partitions=5).collect(), key=lambda r: r._number)
    assert [r._number for r in got] == list(range(1, 201)) and [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)
    sums = sorted(number_within_keys(df, [], ["v", "id"], "before", amount="w").collect(), key=lambda r: (r.v, r.id))
    total = 0
    for r in sums:
        assert r.before == total
        total += r.w


def test_only_hashes_of_hot_keys_are_broadcast(spark):
    big = spark.createDataFrame([("hot",)] * 50 + [(f"k{i}",) for i in range(50)], "k string")
    values = spark.createDataFrame([("hot", 50, "x" * 1000), *[(f"k{i}", 1, "y") for i in range(50)]], "k string, n bigint, x string")
    joined = join_key_values(big, values, ["k"], "n", 10)
    assert joined.where("x is null").count() == 0 and joined.count() == 100
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "strategy=merge" in plan
    physical = joined._jdf.queryExecution().executedPlan().toString()
    assert physical.count("SortMergeJoin") == 1
