import random

import pytest

from proofloom.llm import truncation

SCHEMA = "id bigint, source string, text string"


@pytest.mark.parametrize("text,end", [
    (None, None), ("", None), (" \n ", None), ("It ends.", ("text", ".", "ends.")), ("So it ends! ", ("text", "!", "ends!")), ("終わり。", ("text", "。", "終わり。")), ("He said (so).", ("text", ".", "(so).")),
    ("done ∎", ("text", "∎", "∎")), ("and then the", ("text", "w", "the")), ("half of a wo", ("text", "w", "wo")), ("cut off…", ("text", "…", "cut off…")), ("cut [...]", ("text", "…", "cut [...]")), ("T\n\nAnd so on…", ("text", "…", "so on…")),
    ("text\n\n    x = y", ("code", "w", "x")), ("text\n\nStatus: closed", ("apart", "w", "Status:")), ("text\r\n\r\nStatus: closed", ("apart", "w", "Status:")), ("text\n\n" + "word " * 30, ("text", "w", "word")), ("Refs\n- A.b_c", ("item", "n", "")),
    ("Refs\n[1] A.B", ("item", "N", "")), ("- Can someone see A.b", ("item", "n", "Can")), ("```\ncode\n```", ("block_end", "`", "```")), ("```\ncode", ("open_block", "w", "code")), ("[0001] info A: b, 3 m", ("log", "w", "")), ("# Part", ("head", "w", "#")),
    ("see `Foo.ba", ("open_pair", "n", "`Foo.ba")), ("took (about 23.", ("open_pair", ".", "23.")), ("bad \ufffd", ("broken_char", "\ufffd", "\ufffd")), ("by Kern.B.x_y.", ("text", "n.", "Kern.B.x_y.")), ("in Kern.B.", ("text", "N.", "Kern.B.")),
    ("on a d’", ("text", "w", "d’")), ("line one.\r\n", ("text", ".", "one.")), ("a" * 500_000, ("text", "w", "a" * 40)),
])
def test_endings(spark, text, end):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(truncation.ending("text").alias("k")).first().k
    assert (tuple(got) if got else got) == end


def test_cuts_on_purpose(spark):
    texts = ["", "x", None, "ab", "naïve façade " * 9, "終わり。" * 20]
    df = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "i bigint, text string")
    from pyspark.sql import functions as F

    for r in df.select("text", truncation.cut_somewhere("text", F.col("i")).alias("c")).collect():
        assert (r.c is None) == (r.text is None or len(r.text) < 2)
        assert r.c is None or r.text.startswith(r.c.rstrip("\ufffd")) and 0 < len(r.c) <= len(r.text)


def synthetic(seed=3, n=6000, limit=200):
    rng = random.Random(seed)
    words = "the lemma holds for every short chain because its module unfolds twice and nothing refers to it".split()
    rows, cut = [], set()
    for i in range(n):
        source = rng.choice(["limited", "limited", "whole", "lossy"])
        text = ""
        while len(text) < max(20, rng.lognormvariate(5, 0.5)):
            text += " ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))).capitalize() + ". "
        text = text.strip()
        if source == "limited" and len(text) > limit and rng.random() < 0.8:
            text = text[:limit]
        elif source == "lossy" and rng.random() < 0.1:
            text = text[: rng.randrange(10, len(text))]
        if not text.rstrip().endswith("."):
            cut.add(i)
        rows.append((i, source, text))
    return rows, cut


def test_planted_truncations_are_found(spark):
    rows, cut = synthetic()
    scored = truncation.truncated(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", ending string"))
    got = {r.id for r in scored.where("truncated").collect()}
    assert len(got & cut) / len(cut) > 0.98 and len(got & cut) / len(got) > 0.98
    at = scored.where("at_limit and source = 'limited'").count()
    assert at >= sum(1 for i, s, t in rows if s == "limited" and len(t) == 200)
    rates = {r.source: r.rate for r in truncation.rates_by_source(scored).collect()}
    for source, rate in rates.items():
        own = [i for i, s, _ in rows if s == source]
        assert abs(rate - len(cut & set(own)) / len(own)) < 0.005


def test_limits_are_found_and_fitted(spark):
    rows, _ = synthetic()
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).select(F.col("source").alias("_source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    limits = {(r._source, r.unit, r.length): r.tau for r in truncation.field_limits(df).collect()}
    assert {("limited", "chars", 200), ("limited", "bytes", 200)} <= set(limits) and min(limits["limited", u, 200] for u in ("chars", "bytes")) > 0.9


def test_degenerate_tables(spark):
    assert truncation.truncated(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None), (2, None, ""), (3, "s", "open end"), (3, "s", "open end"), (4, None, "Ends.")]
    got = truncation.truncated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 3, 4]
    assert all(r.posterior == 0 and not r.truncated for r in got if r.id < 3) and not any(r.truncated for r in got if r.id == 4)
    blank = truncation.truncated(spark.createDataFrame(rows[:2], SCHEMA))
    assert blank.where("truncated").count() == 0


def limited(seed=5, n=1500, limit=200):
    """Texts of which those longer than the limit are all cut to it, in bytes; a tenth of all end in a label line, whose cut texts are told."""
    rng = random.Random(seed)
    words = "the lemma holds for every short chain because its module unfolds twice and nothing refers to it".split()
    rows, inside = [], set()
    for i in range(n):
        text = ""
        while len(text) < max(20, rng.lognormvariate(5, 0.5)):
            text += " ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))).capitalize() + ". "
        body = text.strip()
        text = body + "\n\nSee also: " + "unfolding chains of short modules" if i % 10 == 0 else body
        if len(body) + 14 < limit < len(text):
            inside.add(i)
        rows.append((i, "limited", text[:limit]))
    return rows, inside


def test_a_line_cut_at_a_limit_is_found(spark):
    rows, inside = limited()
    scored = truncation.truncated(spark.createDataFrame(rows, SCHEMA)).where("ending = 'apart w'").collect()
    assert len(inside) >= 5 and inside <= {r.id for r in scored if r.truncated}
    whole = {i for i, _, t in rows if len(t) < 195}
    assert not {r.id for r in scored if r.truncated} & whole and len({r.id for r in scored} & whole) > 50


def test_own_length_bears_on_the_posterior(spark):
    rows, _ = limited()
    rows += [(9003, "limited", "y" * 197 + "…"), (9004, "limited", "y" * 196 + "…")]  # 200 and 199 bytes
    scored = {r.id: r for r in truncation.truncated(spark.createDataFrame(rows, SCHEMA)).where("id > 9002").collect()}
    assert all(r.at_limit and r.ending == "text …" for r in scored.values()) and scored[9003].posterior > scored[9004].posterior


def test_fit_is_not_forgotten():
    import pandas as pd

    def broken(tau, at=True):
        rows = [("s", at, o, 10, 10 * tau) for o in (4.0, 0.0, -4.0)]
        return truncation._source_rates(pd.DataFrame(rows, columns=["_source", "at_limit", "log_odds", "n", "tau"])).broken.sum()

    assert broken(0.99) > broken(0.05) + 0.01


def test_a_sentence_that_ends_at_a_limit_may_be_cut_but_is_no_case(spark):
    rows, _ = synthetic()
    scored = truncation.truncated(spark.createDataFrame(rows, SCHEMA))
    full = {i for i, s, t in rows if s == "limited" and len(t) == 200 and t.endswith(".")}
    at = {r.id: r for r in scored.where("at_limit").collect()}
    free = {r.id: r for r in scored.where("source = 'limited' and not at_limit").collect()}
    assert full and not any(at[i].truncated for i in full)
    mean = lambda rs: sum(r.posterior for r in rs) / len(rs)
    assert mean([at[i] for i in full]) > 100 * mean([r for r in free.values() if r.ending == "text ."])


def held_out(seed=7, n=4000):
    """A script and a full stop that no rule names; a fifth of the long texts are cut at 120 characters, and some anywhere."""
    rng = random.Random(seed)
    words = "यह एक छोटा वाक्य है जो केवल जाँच के लिए लिखा गया और फिर भुला दिया".split()
    rows, broken = [], set()
    for i in range(n):
        text = " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 9))) + "।" for _ in range(rng.randrange(2, 9)))
        source = rng.choice(["a", "b"])
        if source == "a" and len(text) > 120 and rng.random() < 0.6:
            text = text[:120]
        elif source == "b" and rng.random() < 0.05:
            text = text[: rng.randrange(5, len(text))]
        if not text.rstrip().endswith("।"):
            broken.add(i)
        rows.append((i, source, text))
    return rows, broken


def test_a_language_no_rule_knows(spark):
    rows, broken = held_out()
    got = {r.id for r in truncation.truncated(spark.createDataFrame(rows, SCHEMA)).where("truncated").collect()}
    assert len(got & broken) / len(broken) > 0.98 and len(got & broken) / len(got) > 0.98


def test_every_source_has_its_own_rate(spark):
    from pyspark.sql import functions as F

    times = lambda word, k, n: F.repeat(F.lit(word), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int"))
    whole = F.concat(F.lit("some "), times("words that run ", 1, 9), times("on ", 2, 60), times("again ", 3, 40), F.lit("out."))
    text = F.when(F.col("id") % 40 == 0, F.substring(whole, F.lit(1), (F.pmod(F.xxhash64("id"), F.length(whole) - 4) + 3).cast("int"))).otherwise(whole)
    docs = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 12_001).cast("string"))).alias("source"), text.alias("text"))
    rates = truncation.rates_by_source(truncation.truncated(docs))
    assert rates.count() == docs.select("source").distinct().count() > 10_000
    hot = rates.where("source = 'hot'").first()
    assert hot.documents == 30_000 and 1480 <= hot.truncated <= 1500


def test_a_limit_that_few_texts_reach_is_found(spark):
    rows = [(i, "big", "w" * (20 + i % 60) + " ends.") for i in range(30_000)]
    rows += [(50_000 + i, "big", "long " * 60 + "x" * (i % 97) + " ends.") for i in range(40)]
    rows += [(60_000 + i, "big", "y" * 999 + "…") for i in range(100)]  # a third of one percent of all, most of those that long
    scored = truncation.truncated(spark.createDataFrame(rows, SCHEMA))
    assert {r.id for r in scored.where("truncated").collect()} == set(range(60_000, 60_100))
    assert {r.id for r in scored.where("at_limit").collect()} == set(range(60_000, 60_100))
