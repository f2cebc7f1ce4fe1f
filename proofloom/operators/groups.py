"""Groups of declarations that say the same, and the graph between them. ``endpoints``: decl_id, name, kind, endpoint, group_size, visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.session import cut

# The kinds of declarations that state mathematics.
MATH_KINDS = ("theorem", "definition", "def", "opaque", "abbrev")


def shown(technical: bool = False, theorems: bool = True, definitions: bool = True) -> Column:
    """Whether a declaration (kind, hidden) is shown: hidden ones only with ``technical``; theorems and other kinds that state mathematics as asked; the rest only with ``technical``."""
    kind = F.when(F.col("kind") == "theorem", F.lit(theorems)).when(F.col("kind").isin(*MATH_KINDS), F.lit(definitions)).otherwise(F.lit(technical))
    return kind & (F.lit(technical) | ~F.col("hidden"))


def name_hash(name: str) -> Column:
    """The first 60 bits of the MD5 of a column."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def equivalence_groups(declarations: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(fingerprint, group_id, members, representative, first_member, kind): ``declarations`` (decl_id, name, kind, type_text) with the same kind and fingerprint (``fingerprints``: decl_id, fingerprint).

    The representative has the shortest statement in bytes, ties by name; group_id is the exclusive or of the members' name hashes, so it tells their set whatever their order. Declarations without a fingerprint are in no group.
    """
    rows = declarations.join(fingerprints.where("fingerprint is not null").hint("merge"), "decl_id")
    best = F.min(F.struct(F.octet_length(F.coalesce("type_text", F.lit(""))).alias("n"), F.col("name")))
    groups = rows.groupBy("kind", "fingerprint").agg(F.count(F.lit(1)).alias("members"), best.alias("b"), F.min("name").alias("first_member"), F.bit_xor(name_hash("name")).alias("group_id"))
    return groups.select("kind", "fingerprint", "group_id", "members", F.col("b.name").alias("representative"), "first_member")


def endpoints(declarations: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(decl_id, name, kind, endpoint, group_size): a group's name where it has several members, else the declaration's own."""
    groups = cut(equivalence_groups(declarations, fingerprints).select("kind", "fingerprint", "members", "representative"), "groups")
    rows = declarations.join(fingerprints.hint("merge"), "decl_id", "left")
    from proofloom.operators.skew import join_key_values

    joined = join_key_values(rows.select("decl_id", "name", "kind", "fingerprint"), groups, ["kind", "fingerprint"], "members")
    many = F.coalesce(F.col("members"), F.lit(1)) > 1
    name = F.when(many, F.concat(F.lit("group:"), "representative")).otherwise(F.concat(F.lit("decl:"), "name"))
    return cut(joined.select("decl_id", "name", "kind", name.alias("endpoint"), F.coalesce("members", F.lit(1)).alias("group_size")), "endpoints")


def between(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``edges`` within the corpus whose two ends differ, with the end points ``user`` and ``prerequisite``."""
    user = ends.select(F.col("decl_id").alias("source_id"), F.col("endpoint").alias("user"))
    base = ends.select(F.col("decl_id").alias("target_id"), F.col("endpoint").alias("prerequisite"))
    return edges.where("target_id is not null").join(user.hint("merge"), "source_id").join(base.hint("merge"), "target_id").where("user <> prerequisite")


def grouped_edges(met: DataFrame) -> DataFrame:
    """Rows of ``between`` summed up by pair, from the prerequisite to its user."""
    layer = lambda n: F.coalesce(F.sum(F.when(F.col("layer") == n, F.col("occurrences"))), F.lit(0)).alias(f"{n}_occurrences")
    return met.groupBy("prerequisite", "user").agg(F.sum("occurrences").alias("occurrences"), layer("statement"), layer("proof"))


def dependents(met: DataFrame) -> DataFrame:
    """Distinct declarations outside an end point that use it directly."""
    return met.groupBy("prerequisite").agg(F.countDistinct("source_id").alias("direct_dependents"))


def graph(met: DataFrame, ends: DataFrame) -> DataFrame:
    """The end points with their members and direct dependents."""
    own = ends.groupBy("endpoint").agg(F.count(F.lit(1)).alias("members"))
    return own.join(dependents(met).withColumnRenamed("prerequisite", "endpoint").hint("merge"), "endpoint", "left").fillna(0, ["direct_dependents"])


def labels(points: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` end points of ``graph`` that most declarations use, ties by name: those a drawing labels."""
    return points.orderBy(F.desc("direct_dependents"), "endpoint").limit(most).select("endpoint", "direct_dependents")


def first_witnesses(met: DataFrame) -> DataFrame:
    """For every pair of end points the first edge that witnesses it, by source, target and layer."""
    return met.groupBy("prerequisite", "user").agg(F.min(F.struct("source", "target", "layer")).alias("w")).select("prerequisite", "user", "w.source", "w.target", "w.layer")


def fingerprint(declarations: DataFrame, version: str, modules: list[str]) -> DataFrame:
    """One row (declarations, fingerprint): a digest of version, modules and the place, name and structure (decl_id, name, digest) of every declaration.

    Each declaration's SHA-256 is cut into four words of 60 bits, and the exclusive or of each word over all declarations goes into the digest of the whole, so no task sees all of them.
    """
    digest = F.sha2(F.concat_ws("|", "decl_id", "name", "digest"), 256)
    words = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("bigint")).alias(f"w{k}") for k in range(4)]
    whole = declarations.agg(F.count(F.lit(1)).alias("declarations"), *words)
    return whole.select("declarations", F.sha2(F.concat_ws("|", F.lit(version), F.lit(",".join(modules)), "declarations", "w0", "w1", "w2", "w3"), 256).alias("fingerprint"))


def position(name: Column) -> Column:
    """A place in the plane for a name, the same every time: struct(x, y), between 20 and 145 from the origin."""
    raw = F.xxhash64(name).bitwiseAND(F.lit((1 << 62) - 1))
    angle = F.pmod(raw, F.lit(100_000)) / 100_000 * F.lit(2 * 3.141592653589793)
    radius = F.lit(20.0) + F.pmod(F.shiftright(raw, 17), F.lit(10_000)) / 80.0
    return F.struct((F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))
