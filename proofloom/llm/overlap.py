"""All similar pairs between set-valued records: a size-aware overlap join.

Two sets of sizes s and t reach the Jaccard threshold j exactly if they share at least o(s, t) = ceil(j / (1 + j) * (s + t)) tokens.
Small sets enumerate, for every size t a small partner can have, all their token subsets of size o(s, t), as 64-bit
keys that also hold the pair of sizes: two sets meet in a key only if they share that many tokens, so a key's group holds true pairs and no
others, however common its tokens are. Keys that one set alone has are dropped before sets are paired. Pairs with a large set come from scanning the inverted
lists of the tokens that the large sets can't all miss, the rarest ones. Groups and lists are paired in blocks on both sides, so that no task holds
the square of a hot one. Which sets are small follows from the counted cost of either way (``boundary``). The union of both is verified on the tokens themselves.
Equal sets form one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators.skew import join_key_values
from proofloom.session import cut

SMALL = range(8, 17)  # the sizes at which small may end
PAIR_COST = 4  # of a pair met in the inverted lists, in subset keys
BLOCK = 4096
LEAST = 1


def needed(threshold: Fraction, s: int, t: int) -> int:
    """Tokens that sets of sizes s and t must share."""
    return -((-threshold * (s + t)) // (1 + threshold))


def partners(threshold: Fraction, s: int) -> range:
    """Sizes a similar set can have."""
    return range(int(-((-threshold * s) // 1)), int(s / threshold) + 1)


def classes(sets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(members: set_field, id, class_id, copies), (classes: set_field, class_id, items, size); class_id is the smallest id with the same set, copies its number of rows."""
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    base = sets.where("id is not null").select("set_field", "id", items.alias("items")).where(F.size("items") >= least)
    # lengths keep the joined text unambiguous
    spelled = F.concat_ws("", F.transform("items", lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)))
    base = cut(base.withColumn("_digest", F.sha1(spelled)), "sets")
    found = cut(base.groupBy("set_field", "_digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "digests")
    joined = join_key_values(base, found, ["set_field", "_digest"], "copies")
    joined = cut(joined.select("set_field", "id", "class_id", "copies", F.when(F.col("id") == F.col("class_id"), F.col("items")).alias("items")), "members")
    members, own = joined.drop("items"), joined.where("items is not null").drop("id", "copies")
    if members.distinct().count() < members.count():  # rows sent again
        members, own = cut(members.distinct(), "members"), cut(own.dropDuplicates(["set_field", "class_id"]), "classes")
    return members, own.withColumn("size", F.size("items"))


def _vectors(found: DataFrame) -> DataFrame:
    """Per class the tokens that other classes have too, as (frequency, hash), rarest first; a token of one class can't be shared. The hash holds the field."""
    hashed = F.transform("items", lambda x: F.xxhash64("set_field", x))
    tokens = found.select("set_field", "class_id", "size", F.explode(hashed).alias("h"))
    frequency = cut(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "df")
    marked = join_key_values(tokens, frequency.where("df > 1"), ["h"], "df").where("df is not null")
    return cut(marked.groupBy("set_field", "class_id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("tokens")), "vectors")


def _subset_keys(threshold: Fraction, small: int):
    """Batches of (set_field, class_id, size, tokens) -> the keys of every subset of the required sizes."""
    choose: dict[tuple[int, int], np.ndarray] = {}

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            hashes = mix(tokens.flatten().field("h").to_numpy(zero_copy_only=False).astype(np.uint64))
            offsets = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            have = np.diff(offsets)
            sizes = batch.column("size").to_numpy()
            for s, m in sorted(set(zip(sizes.tolist(), have.tolist()))):
                rows = np.flatnonzero((sizes == s) & (have == m))
                for t in partners(threshold, s):
                    o = needed(threshold, s, t)
                    if t > small or o > m:
                        continue
                    k = m - o  # left out; fewer than are taken
                    if (m, k) not in choose:
                        left_out = list(combinations(range(m), k))
                        choose[m, k] = np.array(left_out, dtype=np.int64).reshape(len(left_out), k)
                    out = choose[m, k]
                    step = max(1, 500_000 // max(1, len(out)))
                    for i in range(0, len(rows), step):
                        part = rows[i : i + step]
                        grid = hashes[offsets[part][:, None] + np.arange(m)[None, :]]
                        sums = np.repeat(grid.sum(axis=1, dtype=np.uint64)[:, None], len(out), axis=1)
                        for c in range(k):
                            sums -= grid[:, out[:, c]]
                        keys = mix(sums + np.uint64(min(s, t) * 1_000_003 + max(s, t) * 7919 + 1))
                        index = pa.array(np.repeat(part, len(out)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("set_field").take(index),
                                batch.column("class_id").take(index),
                                pa.array(keys.reshape(-1).view(np.int64)),
                                pa.array(np.full(len(index), 0 if s < t else 1 if s > t else 2, dtype=np.int32)),
                            ],
                            names=["set_field", "class_id", "key", "role"],
                        )

    return run


def _prefixes(vectors: DataFrame, threshold: Fraction) -> DataFrame:
    """(set_field, class_id, size, h): the rarest tokens of every set, one more than it can lack and still be similar to another."""
    least = F.ceil(F.col("size") * F.lit(float(threshold)) - F.lit(1e-9)).cast("int")
    rarest = F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - least + 1, F.lit(0)))
    return vectors.select("set_field", "class_id", "size", F.explode(rarest).alias("t")).select("set_field", "class_id", "size", "t.h")


def boundary(vectors: DataFrame, lists: DataFrame, threshold: Fraction, choices: range = SMALL) -> int:
    """The greatest size of a small set: the one of ``choices`` with the least cost, subset keys and ``PAIR_COST`` for every pair met in the inverted lists, both counted over all sets."""
    shapes = vectors.where(F.col("size") <= choices[-1]).groupBy("size", F.size("tokens").alias("have")).count().collect()  # at most the square of the last choice

    def keys(b: int) -> int:
        kinds = ((r["count"], r.have, needed(threshold, r.size, t)) for r in shapes if r.size <= b for t in partners(threshold, r.size) if t <= b)
        return sum(n * comb(have, o) for n, have, o in kinds if o <= have)

    sides = [(F.count_if(F.col("size") > b).cast("double"), F.count_if(F.col("size").between(int(threshold * (b + 1)), b)).cast("double")) for b in choices]
    per_list = lists.groupBy("set_field", "h").agg(*[(large * (small + large / 2)).alias(f"c{b}") for b, (large, small) in zip(choices, sides)])
    met = per_list.agg(*[F.sum(f"c{b}").alias(f"c{b}") for b in choices]).first()
    return min(choices, key=lambda b: keys(b) + PAIR_COST * (met[f"c{b}"] or 0))


def _paired(left: DataFrame, right: DataFrame, on: list[str], left_size: str, right_size: str, block: int) -> DataFrame:
    """``left`` and ``right`` joined on ``on`` as a grid of blocks: a key with more rows than ``block`` on a side (``left_size``, ``right_size`` say how many, on either side) is
    cut on that side, and every pair of blocks meets in a group of its own."""
    cells = lambda own, other, mine, theirs: (
        F.pmod(F.xxhash64(own), F.ceil(F.col(mine) / block)).alias(mine), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(other) / block) - 1)).alias(theirs)
    )
    a = left.select(*[c for c in left.columns if c not in (left_size, right_size)], *cells("a", right_size, left_size, right_size))
    b = right.select(*[c for c in right.columns if c not in (left_size, right_size)], *cells("b", left_size, right_size, left_size))
    return a.join(b.hint("merge"), [*on, left_size, right_size])


def _small_pairs(vectors: DataFrame, threshold: Fraction, small: int, block: int) -> DataFrame:
    keys = vectors.where(F.col("size") <= small).mapInArrow(_subset_keys(threshold, small), "set_field string, class_id bigint, key bigint, role int")
    held = cut(keys.groupBy("set_field", "key").agg(F.count_if(F.col("role") != 1).alias("na"), F.count_if(F.col("role") != 0).alias("nb"), F.max("role").alias("equal")).where("na > 0 and nb > 0 and (equal < 2 or na > 1)"), "held-keys")
    shared = cut(keys.join(held.drop("equal").hint("merge"), ["set_field", "key"]), "shared-keys")
    a = shared.where("role <> 1").select("set_field", "key", "na", "nb", F.col("class_id").alias("a"))
    b = shared.where("role <> 0").select("set_field", "key", "na", "nb", F.col("class_id").alias("b"), F.col("role").alias("rb"))
    met = _paired(a, b, ["set_field", "key"], "na", "nb", block).where("rb = 1 or a < b")  # the smaller set with the larger, or two of one size
    return met.select("set_field", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def _large_pairs(lists: DataFrame, threshold: Fraction, small: int, block: int) -> DataFrame:
    j = float(threshold)
    held = lists.where(F.col("size") >= int(threshold * (small + 1)))
    sizes = held.groupBy("set_field", "h").agg(F.count_if(F.col("size") > small).alias("na"), F.count(F.lit(1)).alias("nb")).where("na > 0 and nb > 1")
    held = cut(join_key_values(held, cut(sizes, "list-sizes"), ["set_field", "h"], "nb").where("na is not null"), "lists")
    a = held.where(F.col("size") > small).select("set_field", "h", "na", "nb", F.col("class_id").alias("a"), F.col("size").alias("sa"))
    b = held.select("set_field", "h", "na", "nb", F.col("class_id").alias("b"), F.col("size").alias("sb"))
    near = (F.col("sb") >= F.col("sa") * j - 1e-9) & (F.col("sa") >= F.col("sb") * j - 1e-9)
    met = _paired(a, b, ["set_field", "h"], "na", "nb", block).where(near & ((F.col("sb") <= small) | (F.col("a") < F.col("b"))))
    return met.select("set_field", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def similar_classes(found: DataFrame, threshold: str, small: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of classes (set_field, left_id, right_id, shared_items, jaccard) with jaccard >= ``threshold``, left_id the smaller. ``small`` None: see ``boundary``."""
    limit = Fraction(threshold)
    vectors = _vectors(found)
    lists = cut(_prefixes(vectors, limit), "prefixes")
    last = boundary(vectors, lists, limit) if small is None else small
    candidates = cut(_small_pairs(vectors, limit, last, block).union(_large_pairs(lists, limit, last, block)).distinct(), "candidates")

    def side(rows: DataFrame, name: str) -> DataFrame:
        weights = candidates.groupBy("set_field", name).agg(F.count(F.lit(1)).alias("_pairs"))
        own = found.withColumnRenamed("class_id", name).select("set_field", name, F.col("items").alias(f"{name}_items"))
        values = cut(own.join(weights.hint("merge"), ["set_field", name]), "sides")
        return join_key_values(rows, values, ["set_field", name], "_pairs").drop("_pairs")

    both = side(side(candidates, "left_id"), "right_id")
    shared = F.array_intersect("left_id_items", "right_id_items")
    union = F.size("left_id_items") + F.size("right_id_items") - F.size("shared_items")
    checked = both.withColumn("shared_items", shared).where(F.size("shared_items") * limit.denominator >= union * limit.numerator)
    return checked.select("set_field", "left_id", "right_id", "shared_items", (F.size("shared_items") / union).alias("jaccard"))


def similar_sets(sets: DataFrame, threshold: str = "0.7", least: int = LEAST, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: set_field, id, class_id, copies; pairs of classes) of ``sets``: set_field, id, items.

    Sets are compared within a set_field, by their distinct non-null items; those with fewer than ``least`` items (null and empty lists
    among them) and those with a null id take no part. Ids are unique in a field; a repeated row counts once. Threshold: a decimal above 0, as text, so that the
    test is exact. No pair is lost; no sets give no pairs. To join two tables, give their sets in one field with ids that tell them apart.
    """
    members, found = classes(sets, max(1, least))
    return members, similar_classes(found, threshold, small)


def expand(members: DataFrame, pairs: DataFrame, block: int = BLOCK // 4) -> DataFrame:
    """(set_field, left_id, right_id) of all ids: those of similar classes and those within a class; as many rows as there are pairs.

    Classes of one record pass as they are. The members of others are dealt to blocks, and every pair of blocks of two linked classes, or of one class with itself, is paired by itself.
    """
    sizes = members.where("copies > 1 and id = class_id").select("set_field", "class_id", F.col("copies").alias("n"))
    links = pairs.select("set_field", F.col("left_id").alias("ca"), F.col("right_id").alias("cb"))
    at = lambda name, n: sizes.select("set_field", F.col("class_id").alias(name), F.col("n").alias(n))
    sized = links.join(at("ca", "na").hint("merge"), ["set_field", "ca"], "left").join(at("cb", "nb").hint("merge"), ["set_field", "cb"], "left")
    sized = cut(sized.select("set_field", "ca", "cb", "na", "nb"), "sized-links")
    single = sized.where("na is null and nb is null").select("set_field", F.col("ca").alias("a"), F.col("cb").alias("b"))
    own = sizes.select("set_field", F.col("class_id").alias("ca"), F.col("class_id").alias("cb"), F.col("n").alias("na"), F.col("n").alias("nb"))
    several = sized.where("na is not null or nb is not null").union(own)
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.coalesce(n, F.lit(1)) / block) - 1))
    cells = cut(several.select("*", blocks("na").alias("i")).select("*", blocks("nb").alias("j")).where("ca <> cb or i <= j"), "cells")
    dealt = members.where("copies > 1").select("set_field", "class_id", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("copies") / block)).alias("at"))
    side = lambda c, n, k, x: cells.join(
        dealt.select("set_field", F.col("class_id").alias(c), F.col("at").alias(k), F.col("id").alias(x)).hint("merge"), ["set_field", c, k], "left"
    ).select("set_field", "ca", "cb", "i", "j", F.coalesce(x, F.when(F.col(n).isNull(), F.col(c))).alias(x)).where(F.col(x).isNotNull())
    met = side("ca", "na", "i", "a").join(side("cb", "nb", "j", "b").hint("merge"), ["set_field", "ca", "cb", "i", "j"]).where("ca <> cb or i < j or a < b")
    return single.union(met.select("set_field", "a", "b")).select("set_field", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def links_per_record(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record: its class and the number of classes similar to it; copies are told by the class, not as pairs."""
    ends = pairs.select("set_field", F.col("left_id").alias("class_id")).union(pairs.select("set_field", "right_id"))
    degree = ends.groupBy("set_field", "class_id").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.where("id = class_id").select("set_field", "class_id", F.col("copies").alias("_members"))
    values = cut(sizes.join(degree.hint("merge"), ["set_field", "class_id"], "left").fillna(0, ["links"]), "links")
    return join_key_values(members.drop("copies"), values, ["set_field", "class_id"], "_members").select("set_field", "id", "class_id", "links")
