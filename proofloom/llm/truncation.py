"""Texts that broke off before their end.

Three kinds of evidence, all of them fitted to the texts at hand. (1) Per source the lengths of
texts are modelled as log-normal and right-censored: at a limit of a field, a share of the texts that would be longer is cut to it. The model is
fitted by maximum likelihood from per-source sums, limits being lengths (in characters or bytes) far more frequent than their surroundings; it
gives each value at a limit the posterior probability of being cut there. (2) What a broken-off end looks like is learned: every text is also cut at a random place, and
the ends of these and of the texts at limits (as far as censored) stand against the ends of texts at no limit. An end is described by the kind of its last line and last
character and by a token, the last one or the one that a line of its own begins with; no word of any language is listed. (3) How often each source breaks off,
at its limits and elsewhere. Bayes' rule combines them for each text: prior odds are those of its source's rate, at a limit together with the posterior of
its own length, which weighs as much as ``CENSORED`` texts; the learned odds of its end multiply them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.operators.skew import join_key_values
from proofloom.session import cut

SPIKE_RATIO = 8.0
NEIGHBOURS = 24
PEAKS = 3  # times the usual peak nearby, see field_limits
ANCHOR = 0.1  # share of a source's cuts on purpose that a kind of end needs, to bound the source's rate
SURPRISE = 12.0  # least log likelihood ratio of a spike against its surroundings
ROUNDS = 60
CENSORED = 20.0
SHORT = 80  # characters of a line that may stand by itself
COMMON = 5  # ends with the same token that let it speak for itself
LEAST = 0.1  # texts that a kind of end is counted with beside those seen
INSIDE = math.log(10.0)  # log odds from which a character that is no letter or digit lies inside what it ends
SUPPORT = 0.25  # texts that the kind of an end counts for beside the ends with the same token
FLOOR = {"broken_char": 1000.0, "open_block": 200.0, "open_pair": 200.0}  # odds at least: something is open there, by its form
LETTERS = ("w", "n", "N")


def _end(prepared: str) -> str:
    """SQL for the description of the end of the text ``prepared``: struct(kind, last, token), null for null, empty and blank texts."""

    def odd(mark: str, where: str, n: int = 1) -> str:
        return f"((length({where}) - length(replace({where}, '{mark}', ''))) / {n}) % 2 = 1"

    def more(opened: str, closed: str) -> str:
        return f"length(replace(_l, '{opened}', '')) < length(replace(_l, '{closed}', ''))"

    before = "right(substring(_e, 1, length(_e) - length(_l)), 3)"
    line = f"""case when _l rlike '^(    |\\t)' then 'code' when _l rlike '^\\\\s*([-*•]|[0-9]+[.)]|\\\\[[0-9]{{1,2}}\\\\]) ' then 'item' when _l rlike '^\\\\[[0-9]{{3,}}' then 'log'
        when _l rlike '^#{{1,6}} ' then 'head' when {before} like '%\n\n' or {before} like '%\r\n' and length(_e) > length(_l) + 2 and {before} like '\n%' then if(length(_l) <= {SHORT}, 'apart', 'text') else 'text' end"""
    upper = "substring_index(rtrim('.', _t), '.', -1) rlike '^\\\\p{Lu}'"
    last = f"""case when _z rlike '(…|\\\\.\\\\.\\\\.|\\\\[…\\\\])$' or _z rlike '\\\\[\\\\.\\\\.\\\\.\\\\]$' then '…'
        when _z rlike '[\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}][\\'’]?$' then if(_t rlike '\\\\p{{L}}[^ ]*[._][^ ]' or _t rlike '[._][^ ]*\\\\p{{L}}', if({upper}, 'N', 'n'), 'w')
        when _z rlike '\\\\.$' and _t rlike '\\\\p{{L}}[^ ]*[._][^ ._]+\\\\.$' then if({upper}, 'N.', 'n.')
        when _y rlike '[\\\\p{{P}}\\\\p{{S}}]$' then right(_y, 1) else right(_z, 1) end"""
    token = """case when _k = 'log' then '' when _c = '…' then substring_index(_z, ' ', -2) when _c not in ('w', 'n', 'N') or _k = 'text' then _t when _k = 'item' then if(_w like '% %', substring_index(_w, ' ', 1), '') else substring_index(ltrim(_l), ' ', 1) end"""
    kind = f"case when _c = '\uFFFD' then 'broken_char' when {odd('```', '_e', 3)} then 'open_block' when _l rlike '```$' then 'block_end' when {odd('`', '_l')} or {more('(', ')')} or {more('«', '»')} then 'open_pair' when _c = '…' then 'text' else _k end"
    made = f"transform(array({last}), _c -> named_struct('kind', {kind}, 'last', _c, 'token', left({token}, 40)))[0]"
    made = f"transform(array({line}), _k -> {made})[0]"
    made = f"transform(array(substring_index(ltrim(regexp_replace(_l, '^\\\\s*[^ ]+ ', '')), '\\n', 1)), _w -> {made})[0]"
    made = f"transform(array(regexp_replace(_z, '[\\\\p{{Pe}}\\\\p{{Pf}}\"*_`]+$', '')), _y -> {made})[0]"
    made = f"transform(array(substring_index(_z, ' ', -1)), _t -> {made})[0]"
    made = f"transform(array(right(_l, 80)), _z -> {made})[0]"
    made = f"transform(array(substring_index(replace(_e, '\r', '\n'), '\n', -1)), _l -> {made})[0]"
    trimmed = f"trim(trailing ' \t\n\r\f\u000B\u00A0\u200B\uFEFF' from {prepared})"
    return f"transform(array({trimmed}), _e -> if(_e is null or _e = '', null, {made}))[0]"


def ending(text: str) -> Column:
    """The description of the end of the column ``text``: kind (of the last line, or what is open there), last (w: a word or number, n and N: a dotted or underscored name with a small
    or capital last part, n. and N.: one with a full stop, …: a mark of omission, else the last character, closing brackets and quotes left out) and token (the last; the last two before a mark of omission; the first of a line that stands by itself and ends in a letter; none of a log line)."""
    return F.expr(_end(f"`{text}`"))


def cut_somewhere(text: str, seed: Column) -> Column:
    """The column ``text`` cut at a place that ``seed`` (a bigint) tells, by characters or, every other time, by bytes; null for texts of fewer than two characters."""
    place = F.pmod(F.xxhash64(seed, F.lit(1)), F.length(text) - 1).cast("int") + 1
    at_byte = F.pmod(F.xxhash64(seed, F.lit(2)), F.octet_length(text) - 1).cast("int") + 1
    halves = F.when(F.pmod(seed, F.lit(2)) == 0, F.substring(text, F.lit(1), place)).otherwise(F.transform(F.array(F.substring(F.col(text).cast("binary"), F.lit(1), at_byte)), lambda x: F.make_valid_utf8(x.cast("string")))[0])
    return F.when(F.length(text) >= 2, halves)


def _log_normal(fits: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source and unit, a limit each (length, count, above) with the source's n, s1, s2 (sums of ln and ln**2 over lengths at no limit);
    adds ``tau``, the posterior of a value at the limit to be cut there."""
    first = fits.iloc[0]
    lengths, counts, above = (fits[c].to_numpy(dtype=float) for c in ("length", "count", "above"))
    logs = [math.log(x) for x in lengths]
    tau = [0.9] * len(logs)
    n, s1, s2 = float(first["n"]), float(first["s1"]), float(first["s2"])
    mu, sd = (s1 / n, math.sqrt(max(s2 / n - (s1 / n) ** 2, 1e-4))) if n > 0 else (logs[0], 1.0)
    for _ in range(ROUNDS):
        w, m1, m2, cut_counts = n, s1, s2, []
        for x, c, t in zip(logs, counts, tau):
            z = (x - mu) / sd
            tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            beyond, spread = mu + sd * hazard, sd * sd * (1 + z * hazard - hazard * hazard)
            w += c
            m1 += c * ((1 - t) * x + t * beyond)
            m2 += c * ((1 - t) * x * x + t * (beyond * beyond + max(spread, 0.0)))
            cut_counts.append(c * t)
        mu = m1 / w
        sd = math.sqrt(max(m2 / w - mu * mu, 1e-4))
        for i, (x, c, a) in enumerate(zip(logs, counts, above)):
            z = (x - mu) / sd
            tail = 0.5 * math.erfc(z / math.sqrt(2))
            share = min(cut_counts[i] / max(cut_counts[i] + a, 1e-9), 1.0)
            censored, natural = share * tail, math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / sd / math.exp(x)
            tau[i] = censored / max(censored + natural, 1e-300)
    return fits[["_source", "unit", "length"]].assign(tau=tau)


def field_limits(rows: DataFrame, ratio: float = SPIKE_RATIO, surprise: float = SURPRISE) -> DataFrame:
    """(_source, unit, length, tau): lengths that ``ratio`` times as many of their source's texts have as lengths nearby, more than chance explains.

    Chance: a spike's log likelihood ratio against the mean nearby (Poisson) is ``surprise`` at least, which five texts reach where there are no others; and as few texts scatter, it has ``PEAKS`` times as many as the
    fourth most frequent length nearby (it and two other limits may go before). No share of the source's texts is asked for. Works on the histogram of lengths, whose size doesn't depend on the number of texts.
    """
    both = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    histogram = cut(rows.select("_source", both.alias("u")).select("_source", "u.*").groupBy("_source", "unit", "length").count(), "lengths")
    near = Window.partitionBy("_source", "unit").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    whole = Window.partitionBy("_source", "unit")
    after = whole.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    usual = (F.sum("count").over(near) - F.col("count")) / F.lit(2.0 * NEIGHBOURS) + 0.1
    fourth = F.coalesce(F.get(F.sort_array(F.collect_list("count").over(near), asc=False), F.lit(3)), F.lit(0))  # of at most 2 * NEIGHBOURS + 1 lengths
    marked = histogram.select("*", usual.alias("usual"), F.coalesce(F.sum("count").over(after), F.lit(0)).alias("above"), fourth.alias("peak"))
    likely = F.col("count") * F.log(F.col("count") / F.col("usual")) - (F.col("count") - F.col("usual"))
    spike = (likely >= surprise) & (F.col("count") >= PEAKS * F.col("peak")) & (F.col("count") >= ratio * F.col("usual")) & (F.col("length") > 1)
    marked = marked.withColumn("spike", spike)
    log = F.log(F.greatest(F.col("length"), F.lit(1)).cast("double"))
    plain = marked.where("not spike").groupBy("_source", "unit").agg(F.sum("count").alias("n"), F.sum(log * F.col("count")).alias("s1"), F.sum(log * log * F.col("count")).alias("s2"))
    spikes = marked.where("spike").select("_source", "unit", "length", "count", "above")
    fits = spikes.join(plain.hint("merge"), ["_source", "unit"], "left").fillna(0, ["n", "s1", "s2"])
    return fits.groupBy("_source", "unit").applyInPandas(_log_normal, "_source string, unit string, length int, tau double")


def _anchored_rates(rows: DataFrame) -> DataFrame:
    """(_source, _rate, _weight): the greatest rate of broken-off texts at no limit that a source's ends allow, and how many such texts each of its cuts on purpose then stands for.

    A rate and the ends of whole texts can't be told apart by ends alone, since whole texts may end in any way; but of no kind of end may there be fewer texts than breaking off at that
    rate would leave, and some kinds whole texts hardly have. So the rate is the least ratio of texts to cuts, over the kinds that hold ``ANCHOR`` of the source's cuts.
    """
    ends = F.explode(F.array(F.struct(F.lit("off").alias("of"), F.col("ending").alias("klass")), F.struct(F.lit("made").alias("of"), F.col("made_ending").alias("klass"))))
    cells = rows.where("not at_limit").select("_source", ends.alias("x")).where("x.klass is not null").groupBy("_source", "x.klass").agg(F.count_if(F.col("x.of") == "off").alias("off"), F.count_if(F.col("x.of") == "made").alias("made"))
    own = Window.partitionBy("_source")  # a row for every kind of end
    cells = cells.withColumn("texts", F.sum("off").over(own)).withColumn("cuts", F.sum("made").over(own)).where(F.col("made") >= F.greatest(ANCHOR * F.col("cuts"), F.lit(1)))
    rate = F.min(F.least(F.lit(0.5), F.col("off") / F.col("made") * F.col("cuts") / F.col("texts")))
    return cells.groupBy("_source").agg(rate.alias("_rate"), F.max("texts").alias("_texts"), F.max("cuts").alias("_cuts")).select("_source", "_rate", (F.col("_rate") * F.col("_texts") / F.col("_cuts")).alias("_weight"))


def _class_odds(counts: list) -> dict[str, float]:
    """Log odds of every class of ends among broken-off against whole texts.

    ``counts``: rows (klass, kind, made: cuts on purpose, expected: broken-off texts at no limit they stand for, off: texts at no limit, at: texts at a limit, tau: the sum of their posteriors); one row per class.
    """
    odds = {c.klass: 1.0 for c in counts}
    p_at = {c.klass: c.tau / c["at"] if c["at"] else 0.0 for c in counts}
    for _ in range(ROUNDS):
        broken = {c.klass: c.made + c["at"] * p_at[c.klass] for c in counts}
        whole = {c.klass: max(c.off - c.expected, 0.0) + c["at"] * (1 - p_at[c.klass]) for c in counts}
        all_broken, all_whole = sum(broken.values()) + 1, sum(whole.values()) + 1
        odds = {c.klass: max((broken[c.klass] + LEAST) / all_broken / ((whole[c.klass] + LEAST) / all_whole), FLOOR.get(c.kind, 0.0)) for c in counts}
        mean = {c.klass: min(max(c.tau / c["at"], 1e-6), 1 - 1e-6) if c["at"] else 0.5 for c in counts}
        p_at = {k: mean[k] * o / (mean[k] * o + 1 - mean[k]) for k, o in odds.items()}
    return {k: math.log(o) for k, o in odds.items()}


def _token_odds(scale: float):
    """Batches of tokens' counts (see ``truncated``) -> what each has among broken-off and whole texts. A token speaks for whole texts as far as it ends clearly more of them (two standard
    deviations) than broken-off ones explain. ``scale``: texts at no limit for every cut on purpose or at a limit."""

    def run(batches):
        for t in batches:
            base = np.exp(t.class_odds.to_numpy())
            made, off, at, tau, expected = (t[c].to_numpy(dtype=float) for c in ("made", "off", "at", "tau", "expected"))
            mean = np.clip(tau / np.maximum(at, 1.0), 1e-6, 1 - 1e-6)
            surplus, odds = np.maximum(off - expected - 2 * np.sqrt(off + 1), 0.0), base
            for _ in range(ROUNDS):
                p_at = mean * odds / (mean * odds + 1 - mean)
                broken, whole = (made + at * p_at) * scale, surplus + at * (1 - p_at)
                odds = (broken + SUPPORT * base / (1 + base)) / (whole + SUPPORT / (1 + base))
            yield pd.DataFrame({"klass": t.klass, "token": t.token, "texts": t["off"] + t["at"], "class_odds": t.class_odds, "p_at": p_at, "broken": broken, "whole": whole})

    return run


def _share(at: bool, broken: float, n: float, tau: float) -> float:
    """The share of broken-off texts among those of a source, at its limits or elsewhere: at a limit counted together with ``CENSORED`` texts of which tau are cut."""
    share = (broken + CENSORED * tau) / (n + CENSORED) if at else (broken + 0.02) / (n + 1.0)
    return min(max(share, 1e-6), 1 - 1e-6)


def _source_rates(cells: pd.DataFrame) -> pd.DataFrame:
    """One source's texts and broken-off texts, at its limits and elsewhere, from its cells (at_limit, log odds in steps, n, tau)."""
    out = []
    for at, part in cells.groupby("at_limit"):
        counts = [(float(n), math.exp(o), t / n) for n, o, t in zip(part.n, part.log_odds, part.tau)]
        n = sum(c[0] for c in counts)
        broken = sum(c[0] * (c[2] if at else 0.05) for c in counts)
        for _ in range(ROUNDS):
            now = 0.0
            for k, o, t in counts:
                r = _share(bool(at), broken, n, t)
                now += k * r * o / (r * o + 1 - r)
            if abs(now - broken) < 1e-9 * n:
                break
            broken = now
        out.append((part["_source"].iloc[0], bool(at), int(n), broken))
    return pd.DataFrame(out, columns=["_source", "at_limit", "n", "broken"])


def truncated(documents: DataFrame, text: str = "text") -> DataFrame:
    """id, source, ending, at_limit, odds (of its end, natural logarithm), posterior (of having broken off, 6 digits) and truncated of every document.

    ``documents``: id, source and the column ``text``. Truncated are texts with a posterior above a half, unless what they end in closes them: a character other than a letter or digit
    that, with its token, isn't ten times as frequent in broken-off texts as in whole ones (``INSIDE``; a mark of omission: as frequent). Such a text may have been cut there as well, so its posterior counts the length too, but it ends inside nothing.
    Null, empty and blank texts have ending null, posterior 0. A null source counts as one source. Repeated rows count as texts of their own. Rates are each source's own, however many there are.
    An empty table gives no rows.
    """
    seed = F.xxhash64("id", F.length(text))
    described = documents.select("id", "source", F.coalesce("source", F.lit("\0")).alias("_source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.array(F.col(text), cut_somewhere(text, seed)).alias("_two"))
    both = F.expr(f"transform(_two, _w -> {_end('_w')})")
    described = described.select("id", "source", "_source", "chars", "bytes", both.alias("_ends"))
    klass = lambda e: F.concat_ws(" ", e["kind"], e["last"])
    own, made = F.col("_ends")[0], F.col("_ends")[1]
    rows = cut(described.select("id", "source", "_source", "chars", "bytes", own["kind"].alias("kind"), own["last"].alias("last"), F.when(own.isNotNull(), klass(own)).alias("ending"), own["token"].alias("token"), made["kind"].alias("made_kind"), F.when(made.isNotNull(), klass(made)).alias("made_ending"), made["token"].alias("made_token")), "endings")
    told = rows.where("ending is not null")
    limits = field_limits(told).groupBy("_source").agg(F.collect_list(F.struct("unit", "length", "tau")).alias("limits"))
    sizes = told.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    sources = cut(sizes.join(limits.hint("merge"), "_source", "left"), "limits")
    # cutting bytes may drop or replace the part of a character at the end
    hit = "(x.unit = 'chars' and x.length = chars) or (x.unit = 'bytes' and bytes between x.length - 3 and x.length + 2)"
    # beside the limit itself only such a character makes a cut; it is met about as often as bytes of the text are not the first of theirs
    inside = "(bytes - chars) / bytes"
    at = f"if(x.length = if(x.unit = 'chars', chars, bytes), x.tau, x.tau * {inside} / (x.tau * {inside} + 1 - x.tau))"
    placed = join_key_values(told, sources, ["_source"], "_n").withColumn("tau", F.expr(f"array_max(transform(filter(limits, x -> {hit}), x -> {at}))"))
    placed = cut(placed.select("id", "source", "_source", "kind", "last", "ending", "token", F.col("tau").isNotNull().alias("at_limit"), F.coalesce("tau", F.lit(0.0)).alias("tau"), "made_kind", "made_ending", "made_token"), "placed-endings")
    # ends of texts as they are, and of those at no limit also as they were cut on purpose
    weights = cut(sources.select("_source", "_n").join(_anchored_rates(placed).hint("merge"), "_source"), "anchors")
    real = placed.select("kind", F.col("ending").alias("klass"), "token", F.when(F.col("at_limit"), F.lit("at")).otherwise("off").alias("of"), "tau", F.lit(0.0).alias("_weight"))
    cuts = join_key_values(placed.where("not at_limit and made_ending is not null").select("_source", F.col("made_kind").alias("kind"), F.col("made_ending").alias("klass"), F.col("made_token").alias("token")), weights, ["_source"], "_n")
    cuts = cuts.select("kind", "klass", "token", F.lit("made").alias("of"), F.lit(0.0).alias("tau"), F.coalesce("_weight", F.lit(0.0)).alias("_weight"))
    number = lambda k: F.count_if(F.col("of") == k).alias(k)
    by_token = real.unionByName(cuts).groupBy("kind", "klass", "token").agg(number("made"), number("off"), number("at"), F.sum("tau").alias("tau"), F.sum("_weight").alias("expected"))
    # tokens that are met again and again have odds of their own; the others share those of all rare tokens with the same kind of end
    common = F.col("made") + F.col("off") + F.col("at") >= COMMON
    by_token = cut(by_token.withColumn("shared", F.concat("klass", F.when(common, F.lit("")).otherwise(F.lit(" rare")))), "ends")
    by_class = by_token.withColumn("klass", F.col("shared")).groupBy("klass").agg(F.min("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("made", "off", "at", "tau", "expected")]).collect()  # at most twice the kinds of lines times the characters there are
    spark = documents.sparkSession
    classes = F.broadcast(spark.createDataFrame(list(_class_odds(by_class).items()), "shared string, class_odds double"))
    sums = [sum(c[n] for c in by_class) for n in ("off", "made", "at")]
    scale = sums[0] / max(sums[1] + sums[2], 1)
    tokens = cut(by_token.join(classes, "shared").where("off + at > 0").mapInPandas(_token_odds(scale), "klass string, token string, texts bigint, class_odds double, p_at double, broken double, whole double"), "token-odds")
    scored = join_key_values(placed.select("id", "source", "_source", "kind", "last", F.col("ending").alias("klass"), "token", "at_limit", "tau"), tokens, ["klass", "token"], "texts")
    # a text at a limit doesn't speak for itself
    mine, e = F.when(F.col("at_limit"), F.col("p_at")), F.exp("class_odds")
    broken = F.greatest(F.col("broken") - F.coalesce(mine, F.lit(0.0)) * scale, F.lit(0.0))
    whole = F.greatest(F.col("whole") - F.coalesce(1 - mine, F.lit(0.0)), F.lit(0.0))
    prior = e / (1 + e)
    own_odds = F.log((broken + SUPPORT * prior) / (whole + SUPPORT * (1 - prior)))
    floor = F.coalesce(*[F.when(F.col("kind") == k, F.lit(math.log(v))) for k, v in FLOOR.items()], F.lit(-50.0))
    scored = cut(scored.select("id", "source", "_source", "last", F.col("klass").alias("ending"), "at_limit", "tau", F.greatest(own_odds, floor).alias("odds")), "scored-endings")
    steps = F.round(F.col("odds") * 4) / 4
    cells = scored.groupBy("_source", "at_limit", steps.alias("log_odds")).agg(F.count(F.lit(1)).alias("n"), F.sum("tau").alias("tau"))
    rates = cut(cells.groupBy("_source").applyInPandas(_source_rates, "_source string, at_limit boolean, n bigint, broken double"), "source-rates")
    known = join_key_values(scored, rates, ["_source", "at_limit"], "n")
    share = F.when(F.col("at_limit"), (F.col("broken") + CENSORED * F.col("tau")) / (F.col("n") + CENSORED)).otherwise((F.col("broken") + 0.02) / (F.col("n") + 1.0))  # as in _share
    share = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = F.round(1 / (1 + F.exp(-F.log(share / (1 - share)) - F.col("odds"))), 6)
    closed = ~F.col("last").isin(*LETTERS) & (F.col("odds") < F.when(F.col("last") == "…", F.lit(0.0)).otherwise(F.lit(INSIDE)))
    found = known.select("id", "source", "ending", "at_limit", F.round("odds", 6).alias("odds"), posterior.alias("posterior"), ((posterior > 0.5) & ~closed).alias("truncated"))
    blank = rows.where("ending is null").select("id", "source", "ending", F.lit(False).alias("at_limit"), F.lit(0.0).alias("odds"), F.lit(0.0).alias("posterior"), F.lit(False).alias("truncated"))
    return found.unionByName(blank)


def rates_by_source(scored: DataFrame) -> DataFrame:
    """source, documents (not blank), truncated and its rate, and broken_rate, the mean posterior, which counts texts cut where a sentence ends too (6 digits); a null source is a row of its own."""
    told = scored.where("ending is not null").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"), F.round(F.avg("posterior"), 6).alias("broken_rate"))
    return told.withColumn("rate", F.round(F.col("truncated") / F.col("documents"), 6))
