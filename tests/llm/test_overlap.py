import random

import pytest

from proofloom.llm import overlap

SCHEMA = "set_field string, id bigint, items array<string>"


def brute(data, least, num, den):
    sets = {}
    for f, i, items in data:
        s = frozenset(x for x in items or [] if x is not None)
        if i is not None and len(s) >= least:
            sets[f, i] = s
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b])}


def noisy(rng, n, sizes, hot):
    data = []
    for i in range(n):
        if data and rng.random() < 0.5:
            items = [x for x in rng.choice(data)[2] or []]
            for _ in range(rng.randrange(4)):
                if items and rng.random() < 0.6:
                    items.pop(rng.randrange(len(items)))
                else:
                    items.append(rng.choice(hot + [f"p{i}"]))
        else:
            items = rng.sample(hot, min(len(hot), 3)) + [f"t{rng.randrange(400)}" for _ in range(rng.choice(sizes))]
        rng.shuffle(items)
        data.append((rng.choice(["x", "y"]), i, items + rng.choice([[], [None], items[:1]])))
    return data


@pytest.mark.parametrize("small,threshold,num,den", [(13, "0.7", 7, 10), (6, "0.7", 7, 10), (9, "0.5", 1, 2), (13, "1", 1, 1), (None, "0.7", 7, 10)])
def test_no_pair_is_lost(spark, small, threshold, num, den):
    rng = random.Random(small or 3)
    data = noisy(rng, 160, [1, 2, 4, 6, 9, 14, 22], [f"hot{i}" for i in range(5)])
    df = spark.createDataFrame([(*d, "more") for d in data], SCHEMA + ", size string")
    members, pairs = overlap.similar_sets(df, threshold, 4, small)
    got = [(r.set_field, r.left_id, r.right_id) for r in overlap.expand(members, pairs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(data, 4, num, den)


def test_copies_share_a_class_and_are_not_paired(spark):
    base = [f"a{i}" for i in range(10)]
    data = [("x", i, base) for i in range(40)] + [("x", 100, base + ["z"]), ("x", 101, ["q", "r"]), ("x", 7, base), ("x", None, base), ("x", 102, None), ("x", 103, [])]
    members, pairs = overlap.similar_sets(spark.createDataFrame(data, SCHEMA))
    links = {r.id: (r.class_id, r.links) for r in overlap.links_per_record(members, pairs).collect()}
    assert links == {**{i: (0, 1) for i in range(40)}, 100: (100, 1), 101: (101, 0)}
    assert [(r.left_id, r.right_id, round(r.jaccard, 6)) for r in pairs.collect()] == [(0, 100, 0.909091)]
    assert overlap.expand(members, pairs).count() == 40 * 39 // 2 + 40


def test_long_lists_in_blocks(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(20)]
    data = [("x", i, rng.sample(common, 18)) for i in range(60)]
    members, found = overlap.classes(spark.createDataFrame(data, SCHEMA), 1)
    pairs = overlap.similar_classes(found, "0.7", 13, block=5)
    assert {(r.set_field, r.left_id, r.right_id) for r in overlap.expand(members, pairs).collect()} == brute(data, 1, 7, 10)


def test_hot_groups_in_blocks(spark):
    rng = random.Random(4)
    base = [f"a{i}" for i in range(6)]
    data = [("x", i, base) for i in range(30)] + [("x", 30 + i, [*base, "z"]) for i in range(25)] + [("x", 60 + i, [*base[:5], f"o{i % 9}"]) for i in range(20)] + [("x", 90, [*base, "z", "y"])]
    rng.shuffle(data)
    members, found = overlap.classes(spark.createDataFrame(data + data[:10], SCHEMA), 4)
    pairs = overlap.similar_classes(found, "0.7", 8, block=2)
    got = [(r.set_field, r.left_id, r.right_id) for r in overlap.expand(members, pairs, block=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, 4, 7, 10)


def test_small_ends_where_it_costs_least(spark):
    from fractions import Fraction

    data = [("x", i, [f"r{i // 2}_{k}" for k in range(9)] + [f"u{i}"]) for i in range(200)]
    found = overlap.classes(spark.createDataFrame(data, SCHEMA), 4)[1]
    vectors = overlap._vectors(found)
    assert overlap.boundary(vectors, overlap._prefixes(vectors, Fraction("0.7")), Fraction("0.7")) == 8  # rare tokens: scanning lists is cheap
    rng = random.Random(5)
    data = [("x", i, rng.sample([f"c{k}" for k in range(20)], 9)) for i in range(900)]
    found = overlap.classes(spark.createDataFrame(data, SCHEMA), 4)[1]
    vectors = overlap._vectors(found)
    assert overlap.boundary(vectors, overlap._prefixes(vectors, Fraction("0.7")), Fraction("0.7")) > 8  # common tokens: lists are long


def test_no_broadcast_of_sets(spark):
    data = noisy(random.Random(2), 60, [4, 6, 9, 14], ["h0", "h1"])
    members, pairs = overlap.similar_sets(spark.createDataFrame(data, SCHEMA), "0.7", 4)
    plan = overlap.expand(members, pairs)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line:
            assert "__hash" in line


def test_no_sets(spark):
    members, pairs = overlap.similar_sets(spark.createDataFrame([], SCHEMA))
    assert members.count() == 0 and pairs.count() == 0


def test_needed_overlap_is_exact():
    from fractions import Fraction

    for s in range(1, 30):
        for t in range(1, 30):
            o = overlap.needed(Fraction("0.7"), s, t)
            reaching = [k for k in range(min(s, t) + 1) if 10 * k >= 7 * (s + t - k)]
            assert (min(reaching) if reaching else None) == (o if o <= min(s, t) else None)
            assert bool(reaching) == (t in overlap.partners(Fraction("0.7"), s))
