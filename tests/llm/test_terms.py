import math
import random
from collections import Counter, defaultdict

from proofloom.llm import distinct_terms, terms

SCHEMA = "term_field string, term string, record bigint, n bigint"


def rows():
    rng = random.Random(4)
    words = ["hot"] * 8 + [f"w{i}" for i in range(60)] + ["", None]
    return [(rng.choice("ab"), rng.choice(words), rng.choice([None, *range(300)]), rng.choice([None, 1, 2])) for _ in range(6000)]


def expected(data):
    n, r = Counter(), defaultdict(set)
    for f, t, d, k in data:
        if t is not None:
            n[f, t] += k or 0
            r[f, t] |= {d} - {None}
    return {k: (n[k], len(r[k])) for k in n}


def test_counts_with_and_without_splits(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for limit, bits in ((1_000_000, 6), (2500, 3), (20_000, None)):
        got = {(r.term_field, r.term): (r.occurrences, r.records) for r in terms.term_counts(df, limit, bits).collect()}
        assert got == expected(data)


def test_one_term_on_all_rows(spark):
    data = [("f", "only", i, 1) for i in range(2000)] * 2
    df = spark.createDataFrame(data, SCHEMA)
    got = terms.term_counts(df, 3000, 4).collect()
    assert [(r.term, r.occurrences, r.records) for r in got] == [("only", 4000, 2000)]


def test_partitions_split_by_term_then_by_record(spark):
    from pyspark.sql import functions as F

    data = [("only", i) for i in range(2000)] + [("pair", 5)] * 2000 + [(f"t{i}", i) for i in range(500)]
    df = spark.createDataFrame(data, "term string, record bigint").withColumn("_bytes", F.lit(50).cast("bigint"))
    half = F.lit(0xFFFFFFFF).cast("bigint")
    df = df.withColumn("_radix", F.shiftleft(F.xxhash64("term").bitwiseAND(half), 32).bitwiseOR(F.xxhash64("record").bitwiseAND(half)))
    levels, last, stuck = terms._leaves(df, 3, 5000)
    assert levels[0][0] == 3 and any(b == 32 for b, _ in levels) and last > 32
    assert stuck.count() == 1  # the repeated pair; no bit tells its rows apart
    sizes = df.groupBy(terms._prefix(last)).count().collect()
    assert sorted(r["count"] for r in sizes)[-1] == 2000 and sorted(r["count"] for r in sizes)[-2] <= 100


def test_one_pair_on_all_rows(spark):
    data = [("f", "only", 7, 1)] * 3000 + [("f", "only", 8, None), ("f", "other", None, 2)]
    got = {(r.term, r.occurrences, r.records) for r in terms.term_counts(spark.createDataFrame(data, SCHEMA), 3000, 4).collect()}
    assert got == {("only", 3000, 2), ("other", 2, 0)}


def test_millions_of_long_terms_without_a_mounted_folder(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(terms, "shared_local_path", lambda _: None)
    rows = spark.range(2_000_000).select(F.lit("f").alias("term_field"), F.concat(F.lpad(F.col("id").cast("string"), 70, "x")).alias("term"), "id", F.lit(1).cast("bigint").alias("n")).withColumnRenamed("id", "record")
    counted = terms.term_counts(rows)
    got = counted.agg(F.count(F.lit(1)), F.sum("occurrences"), F.max("records")).first()
    assert tuple(got) == (2_000_000, 2_000_000, 1)
    # all of them in one partition of DuckDB: it spills
    counted = terms.term_counts(rows.repartition(1), leaf_bytes=1 << 40, bits=1)
    assert counted.count() == 2_000_000


def test_no_rows_and_long_terms(spark):
    assert terms.term_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "x" * 300_000
    got = terms.term_counts(spark.createDataFrame([("f", long, 1, 1), ("f", long, 2, None), ("f", None, 1, 1)], SCHEMA)).collect()
    assert [(r.term, r.occurrences, r.records) for r in got] == [(long, 1, 2)]


def test_marks(spark):
    counts = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 21), ("f", "d", 9, 20), ("g", "e", 9, 99)], "term_field string, term string, occurrences bigint, records bigint")
    totals = spark.createDataFrame([("f", 100)], "term_field string, all_records bigint")
    assert {r.term: r.mark for r in terms.mark_terms(counts, totals).collect()} == {"a": "rare", "b": None, "c": "common", "d": None, "e": None}


def test_ppmi_against_its_formula(spark):
    rng = random.Random(2)
    data = [("f", rng.choice([None, *range(20)]), rng.choice(["hot", "hot", "hot", *"abcdefgh", None])) for _ in range(500)]
    df = spark.createDataFrame([(*x, "extra") for x in data], "term_field string, record bigint, term string, ppmi string")
    joint = Counter((d, t) for _, d, t in data if d is not None and t is not None)
    by_term, by_record = Counter(), Counter()
    for (d, t), n in joint.items():
        by_term[t] += n
        by_record[d] += n
    z = sum(n**0.75 for n in by_record.values())
    scored = distinct_terms.ppmi(df)
    got = {(r.record, r.term): r for r in scored.collect()}
    assert got.keys() == joint.keys()
    for (d, t), n in joint.items():
        want = max(0.0, math.log(n * z / (by_term[t] * by_record[d] ** 0.75)))
        assert abs(got[d, t].ppmi - want) < 1e-6 and got[d, t].n == n
    records = Counter(t for _, t in joint)
    want = set()
    for d in by_record:
        top = max(n for (x, _), n in joint.items() if x == d)
        best = [t for (x, t), n in joint.items() if x == d and n == top]
        if len(best) == 1 and 2 <= records[best[0]] <= 19:
            want.add((d, best[0]))
    assert {(r.record, r.term) for r in distinct_terms.leading_terms(scored, 2, 19).collect()} == want
    assert distinct_terms.ppmi(df.limit(0)).count() == 0


def test_leaders_come_from_the_score(spark):
    rng = random.Random(8)
    data = [("f", d, t) for d in range(150) for t in [f"own{d // 3}"] * rng.randrange(1, 5) + rng.choices(["hot", "warm", *(f"w{i}" for i in range(30))], k=rng.choice([2, 5, 30, 150]))]
    df = spark.createDataFrame(data, "term_field string, record bigint, term string")
    joint = Counter((d, t) for _, d, t in data)
    records = Counter(t for _, t in joint)
    want = set()
    for d in range(150):
        top = max(n for (x, _), n in joint.items() if x == d)
        best = [t for (x, t), n in joint.items() if x == d and n == top]
        want |= {(d, best[0])} if len(best) == 1 and 2 <= records[best[0]] <= 5 else set()
    scored = distinct_terms.ppmi(df)
    found = lambda s: {(r.record, r.term) for r in distinct_terms.leading_terms(s, 2, 5).collect()}
    assert want and found(scored) == want
    from pyspark.sql import functions as F

    looked_at = lambda s: s.join(distinct_terms.lowest_score(s, 5), "term_field").where("score >= lowest").count()
    assert len(want) <= looked_at(scored) < scored.count() / 2
    assert looked_at(distinct_terms.ppmi(df, 0.1)) != looked_at(scored)
    assert found(distinct_terms.ppmi(df, 0.1)) == want
    # with the score switched off nothing is found
    assert found(scored.withColumn("score", F.lit(None).cast("double"))) == set()
