"""Flat tables out of deeply nested records, by shared inlining.

``inline_schema`` analyses the graph of a record type: a struct that occurs once below its parent is
inlined into the parent's table, while repeated elements (arrays) and structs that several parents share
(equal types under different fields) become tables of their own. ``flatten`` fills one of the tables; every
row carries the keys of its ancestors: the record's key, the position of each ancestor in its list, and the
ancestors' own ids where they have one. ``conform`` brings JSON text into the typed shape first.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Occurrence:
    """One place of a table in the record: the hops from the root, each a field path and whether it is repeated."""

    hops: tuple[tuple[str, str, bool], ...]  # (table, dotted path from the previous hop, repeated)


@dataclass
class FlatTable:
    """A table of the relational form. ``columns`` maps output names to paths below the element; ``value`` marks lists of scalars."""

    name: str
    parent: str | None
    columns: dict[str, str] = field(default_factory=dict)
    value: bool = False
    occurrences: list[Occurrence] = field(default_factory=list)


def _common_name(names: list[str]) -> str:
    if len(set(names)) == 1:
        return names[0]
    tail = os.path.commonprefix([n[::-1] for n in names])[::-1]
    tail = tail.split("_", 1)[1] if "_" in tail and not all(n == tail for n in names) and not tail.startswith("_") else tail.strip("_")
    return tail or "_or_".join(sorted(set(names)))


def inline_schema(schema: T.StructType, root: str, key: list[str]) -> dict[str, FlatTable]:
    """The tables for records of type ``schema`` identified by ``key``, in parent-first order."""
    places: dict[str, list[str]] = {}  # type -> fields that hold it, to find shared types

    def survey(t: T.DataType, name: str) -> None:
        if isinstance(t, T.ArrayType):
            survey(t.elementType, name)
        elif isinstance(t, T.StructType):
            seen = places.setdefault(t.json(), [])
            seen.append(name)
            if len(seen) == 1:
                for f in t.fields:
                    survey(f.dataType, f.name)

    for f in schema.fields:
        survey(f.dataType, f.name)
    shared = {t: _common_name(names) for t, names in places.items() if len(names) > 1}
    tables = {root: FlatTable(root, None, {k: k for k in key}, occurrences=[Occurrence(())])}

    def free(name: str, parent: str, value: bool) -> str:
        t = tables.get(name)
        return name if t is None or (t.parent == parent and t.value == value) else f"{parent}_{name}"

    def visit(t: T.StructType, table: FlatTable, prefix: str, path: str, hops: tuple) -> None:
        for f in t.fields:
            at = f"{path}.{f.name}" if path else f.name
            kind, repeated = f.dataType, False
            if isinstance(kind, T.ArrayType):
                kind, repeated = kind.elementType, True
            if isinstance(kind, T.ArrayType):
                raise TypeError(f"{at}: an array of arrays has no flat form here")
            is_struct = isinstance(kind, T.StructType)
            if is_struct and kind.json() in shared or repeated:
                name = shared.get(kind.json(), f.name) if is_struct else f.name
                if not (is_struct and kind.json() in shared):
                    name = free(name, table.name, not is_struct)
                child = tables.setdefault(name, FlatTable(name, table.name, value=not is_struct))
                below = (*hops, (name, at, repeated))
                child.occurrences.append(Occurrence(below))
                if is_struct:
                    visit(kind, child, "", "", below)
                else:
                    child.columns["value"] = ""
            elif is_struct:
                visit(kind, table, f"{prefix}{f.name}_", at, hops)
            else:
                table.columns[f"{prefix}{f.name}"] = at

    visit(schema, tables[root], "", "", ())
    return tables


def keep_known(tables: dict[str, FlatTable], schema: T.StructType) -> dict[str, FlatTable]:
    """``tables`` with only those occurrences and columns that records of the pruned type ``schema`` still hold; names stay those of the whole type."""

    def reach(t: T.DataType, path: str) -> T.DataType | None:
        for name in path.split(".") if path else []:
            t = t.elementType if isinstance(t, T.ArrayType) else t
            if not isinstance(t, T.StructType) or name not in t.names:
                return None
            t = t[name].dataType
        return t.elementType if isinstance(t, T.ArrayType) else t

    out = {}
    for name, table in tables.items():
        places = [(o, reach(schema, ".".join(p for _, p, _ in o.hops))) for o in table.occurrences]
        places = [(o, t) for o, t in places if t is not None]
        columns = {c: path for c, path in table.columns.items() if all(reach(t, path) is not None for _, t in places)}
        if places:
            out[name] = FlatTable(name, table.parent, columns, table.value, [o for o, _ in places])
    return out


def _at(base: Column, path: str) -> Column:
    return reduce(lambda c, p: c.getField(p), path.split("."), base) if path else base


def flatten(df: DataFrame, tables: dict[str, FlatTable], name: str, key: list[str], ids: dict[str, str] | None = None, refers: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The rows of table ``name``.

    Columns: ``key``; for each ancestor ``<table>_pos`` (its place in its list from 0, null where the ancestor is not repeated) and,
    where ``ids`` names an id field of it, ``<table>_id``; ``place`` (the dotted path by which the row was reached, which tells the
    occurrences of a shared table apart); the row's own ``<table>_pos`` if it is repeated, and its columns. ``refers`` maps a list
    of scalars to (table, field): its column ``refers`` then says whether the value is that field of some entry in the same list of that table.
    Null records, null and empty lists and null entries give no rows; fields of any name clash with nothing, as ancestors' columns are prefixed.
    Repeated entries stay repeated. No shuffle takes place.
    """
    ids, refers = ids or {}, refers or {}
    target = tables[name]
    ancestors = list(dict.fromkeys(t for o in target.occurrences for t, _, _ in o.hops))
    parts = []
    for o in target.occurrences:
        keep: dict[str, Column] = {k: F.col(f"`{k}`") for k in key}
        rows, here, lookup = df, None, refers.get(name)
        for depth, (t, path, repeated) in enumerate(o.hops):
            item = _at(F.col(f"`{path.split('.')[0]}`"), ".".join(path.split(".")[1:])) if here is None else _at(here, path)
            kept = [c.alias(k) for k, c in keep.items()]
            if lookup and t == lookup[0] and repeated:
                kept.append(_at(item, lookup[1]).alias("_targets"))
                keep["_targets"] = F.col("_targets")
            if repeated:
                rows = rows.select(*kept, F.posexplode(item).alias(f"_p{depth}", f"_e{depth}"))
                here = F.col(f"_e{depth}")
                rows = rows.where(here.isNotNull()) if not (t == name and target.value) else rows
                keep = {k: F.col(k) for k in keep} | {f"{t}_pos": F.col(f"_p{depth}").cast("bigint")}
            else:
                rows = rows.select(*kept, item.alias(f"_e{depth}"))
                here = F.col(f"_e{depth}")
                rows = rows.where(here.isNotNull())
                keep = {k: F.col(k) for k in keep}
            if t in ids and not (t == name):
                keep[f"{t}_id"] = _at(here, ids[t])
        place = ".".join(p for _, p, _ in o.hops)
        out = [keep[k].alias(k) for k in key]
        for t in ancestors:
            kind = next((f"{t}_pos" for f in [0] if any(h[0] == t and h[2] for x in target.occurrences for h in x.hops)), None)
            if kind:
                out.append(keep.get(kind, F.lit(None).cast("bigint")).alias(kind))
            if t in ids and t != name:
                out.append(keep.get(f"{t}_id", F.lit(None)).alias(f"{t}_id"))
        out.append(F.lit(place).alias("place"))
        cols = [c for c in target.columns.items() if not (here is None and c[0] in key)]
        for col, path in cols:
            value = F.col(f"`{path}`") if here is None and "." not in path else _at(here, path) if here is not None else _at(F.col(path.split(".")[0]), ".".join(path.split(".")[1:]))
            out.append(value.alias(col))
        if lookup:
            out.append(F.coalesce(F.array_contains(F.col("_targets"), here), F.lit(False)).alias("refers"))
        parts.append(rows.select(*out))
    return reduce(lambda a, b: a.unionByName(b), parts)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def _typed(value: object, t: T.DataType, key: Callable[[T.StructField], str]) -> object:
    """A parsed JSON value as type ``t``, by the rules of ``conform``."""
    if value is None:
        return None
    if isinstance(t, T.ArrayType):
        return [_typed(v, t.elementType, key) for v in (value if isinstance(value, list) else [value])]
    if isinstance(t, T.StructType):
        held = value if isinstance(value, dict) else {}
        return {f.name: _typed(held.get(key(f)), f.dataType, key) for f in t.fields}
    if isinstance(t, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    try:
        if isinstance(t, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())
        if isinstance(t, T.IntegralType):
            made = None if isinstance(value, (list, dict)) else int(str(value).strip()) if not isinstance(value, (bool, float)) else int(value)
            return made if made is not None and -(1 << 63) <= made < 1 << 63 else None
        return None if isinstance(value, (list, dict)) else float(value)
    except (ValueError, OverflowError):
        return None


def _parsed_apart(schema: T.StructType, key: Callable[[T.StructField], str]):
    """Texts -> records, of those that are one whole JSON object or list; null stays null."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def parse(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else _typed(json.loads(t), schema, key))
            except ValueError:
                out.append(None)
        return pa.array(out, kind)

    return parse


def conform(df: DataFrame, text: str, schema: T.StructType, out: str, rename: dict[str, str] | None = None, key_of: Callable[[str], str] = camel) -> DataFrame:
    """``df`` with the JSON in its column ``text`` as column ``out`` of type ``schema``; rows whose text is not one whole JSON object get null (``states`` tells them).

    Keys are ``key_of(field)`` unless ``rename`` says otherwise; missing and extra keys are allowed, numbers may be given as text, and a list of
    one may stand without its brackets. A value that can't become its type is null. Texts are parsed by the engine's own JSON parser; what it refuses (an object that names a key twice, whose
    last value counts, or a text too large for it) is parsed once more in Arrow batches, so neither size nor repeated keys lose a record.
    Each text is parsed once: the generators keep the optimizer from repeating the parse in filters.
    """
    rename = rename or {}

    def key(f: T.StructField) -> str:
        return rename.get(f.name, key_of(f.name))

    def build(base: str, path: str, t: T.DataType, depth: int) -> str:
        if isinstance(t, T.StructType):
            own = base if path == "$" else f"try_variant_get({base}, '{path}', 'variant')"
            parts = ", ".join(f"'{f.name}', {build(base, f'{path}.{key(f)}', f.dataType, depth)}" for f in t.fields)
            return f"if({own} is null or is_variant_null({own}), null, named_struct({parts}))"
        if isinstance(t, T.ArrayType):
            one = base if path == "$" else f"try_variant_get({base}, '{path}', 'variant')"
            several = f"coalesce(try_variant_get({base}, '{path}', 'array<variant>'), if({one} is null or is_variant_null({one}), null, array({one})))"
            x = f"x{depth}"
            return f"transform({several}, {x} -> {build(x, '$', t.elementType, depth + 1)})"
        return f"try_variant_get({base}, '{path}', '{t.simpleString()}')"

    # the brackets make anything after the first value show: as broken text or as a second entry
    parsed = df.select("*", F.expr(f"explode(array(try_parse_json(concat('[', `{text}`, ']'))))").alias("__json"))
    typed = build("__json", "$[0]", schema, 1)
    lone = "__json is not null and try_variant_get(__json, '$[1]', 'variant') is null"
    columns = [F.col(f"`{c}`") for c in df.columns]
    done = parsed.select(*columns, F.expr(f"explode(array(if({lone}, {typed}, null)))").alias("__typed"), F.expr(f"if(__json is null and trim(`{text}`) <> '', `{text}`, null)").alias("__refused"))
    return done.select(*columns, F.coalesce("__typed", _parsed_apart(schema, key)("__refused")).alias(out))


def states(conformed: DataFrame, text: str, out: str) -> DataFrame:
    """What became of the texts of ``conform``: (state, texts), the states whole, null, blank and broken (no whole JSON), so that nothing is left out unseen."""
    blank = F.trim(F.col(text)) == ""
    state = F.when(F.col(text).isNull(), "null").when(blank, "blank").when(F.col(out).isNull(), "broken").otherwise("whole")
    return conformed.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("texts"))


def prune(schema: T.StructType, paths: list[str]) -> T.StructType:
    """The part of ``schema`` that the dotted ``paths`` (array levels left out) reach, so that a scan reads no more."""

    def part(t: T.DataType, rest: list[list[str]]) -> T.DataType:
        if any(not r for r in rest):
            return t
        if isinstance(t, T.ArrayType):
            return T.ArrayType(part(t.elementType, rest), t.containsNull)
        heads = list(dict.fromkeys(r[0] for r in rest))
        return T.StructType([T.StructField(f.name, part(f.dataType, [r[1:] for r in rest if r[0] == f.name]), f.nullable) for f in t.fields if f.name in heads])

    return part(schema, [p.split(".") for p in paths])
