import math
import random

import pytest

from proofloom.llm.mix import mix_sources

DOCS, WEIGHTS = "id bigint, source string, size bigint", "source string, target_weight double, max_repeats bigint"


def test_shares_caps_and_rounding(spark):
    rng = random.Random(6)
    data = [(i, rng.choice(["big"] * 6 + ["mid", "small", None, "other"]), rng.choice([None, 0, *range(1, 200)])) for i in range(4000)]
    weights = [("big", 0.3, 1), ("mid", 0.4, 5), ("small", 0.3, 2), ("none", 0.0, 3), ("ghost", 0.1, 2), (None, 0.5, 1)]
    made = mix_sources(spark.createDataFrame([(*d, 1) for d in data], DOCS + ", copies bigint"), spark.createDataFrame(weights, WEIGHTS))
    plan = {r.source: r for r in made.plan.collect()}
    tokens = {s: sum(n or 0 for _, x, n in data if x == s) for s in plan}
    whole = sum(tokens.values())
    assert {s: r.tokens for s, r in plan.items()} == tokens and "other" not in plan
    for s, w, cap in weights[:5]:
        wanted = w * whole
        assert plan[s].reachable == (tokens[s] * cap >= wanted)
        assert plan[s].expected_copies == pytest.approx(min(wanted / tokens[s], cap) if tokens[s] and w else 0)
    counts = {}
    for r in made.emitted.collect():
        c = plan[r.source].expected_copies
        assert math.floor(c) <= r.copies <= math.ceil(c) <= plan[r.source].max_repeats
        counts[r.source] = counts.get(r.source, 0) + r.copies
    for s, n in counts.items():
        assert abs(n - plan[s].expected_copies * plan[s].documents) <= 1
    shares = {r.source: r.actual_share for r in made.shares().collect()}
    assert sum(shares.values()) == pytest.approx(1, abs=1e-4) and shares["ghost"] == 0
    got = {r.source: r.mix_size / whole for r in made.shares().collect()}
    assert got["mid"] == pytest.approx(min(0.4, 5 * tokens["mid"] / whole), rel=0.02)


def test_same_seed_same_mix(spark):
    docs = spark.createDataFrame([(i, "a", i % 7) for i in range(300)], DOCS)
    weights = spark.createDataFrame([("a", 0.37, 3)], WEIGHTS)
    pick = lambda seed: {(r.id, r.copies) for r in mix_sources(docs, weights, seed=seed).emitted.collect()}
    assert pick(1) == pick(1)


def test_empty_tables_and_nulls(spark):
    docs, weights = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 0.5, None), ("b", None, 2)], WEIGHTS)
    made = mix_sources(docs, weights)
    assert made.emitted.count() == 0 and made.shares().where("actual_share is not null").count() == 0
    assert mix_sources(spark.createDataFrame([(1, "a", 5)], DOCS), weights.limit(0)).plan.count() == 0
    one = mix_sources(spark.createDataFrame([(1, "a", 5), (1, "a", 5)], DOCS), spark.createDataFrame([("a", 1.0, None)], WEIGHTS))
    assert [r.copies for r in one.emitted.collect()] == [1, 1]


def test_short_sources_are_told_by_what_was_emitted(spark):
    from dataclasses import replace

    rng = random.Random(1)
    docs = [(i, rng.choice(["big"] * 9 + ["small"]), rng.randrange(1, 90)) for i in range(900)] + [(2000 + i, "blank", 0) for i in range(5)] + [(3000, "exact", 100)]
    whole = sum(n for _, _, n in docs)
    weights = [("big", 0.5, 2), ("small", 0.4, 2), ("blank", 0.05, 3), ("ghost", 0.02, 1), ("none", 0.0, 1), ("barred", 0.01, 0), ("exact", 200 / whole, 2)]
    made = mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame(weights, WEIGHTS))
    rows = made.shares().collect()
    assert {r.source for r in rows if r.short} == {"small", "blank", "ghost", "barred"}
    assert all(r.short == (r.target_weight > 0 and not r.reachable) for r in rows)
    # were nothing emitted, nothing with documents would be told
    none = {r.source for r in replace(made, emitted=made.emitted.limit(0)).shares().collect() if r.short}
    assert none == {"ghost", "barred"}
