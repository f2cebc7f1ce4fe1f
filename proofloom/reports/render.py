"""Results as CSV, JSON and text. Text renderings take rows that are already limited."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SHOWN_NAMES = 12


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values with a comma, quote or line break are quoted, quotes doubled, nulls empty."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def csv_value(value: object) -> str:
    text = "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def csv_lines(columns: list[str], rows: list[Row]) -> str:
    return "".join(",".join(csv_value(v) for v in line) + "\n" for line in [columns, *[[r[c] for c in columns] for r in rows]])


def csv_rows(columns: list[str], rows: Iterator[Row]) -> Iterator[str]:
    """Lines of CSV with a header, one at a time."""
    yield ",".join(map(csv_value, columns)) + "\n"
    for r in rows:
        yield ",".join(csv_value(r[c]) for c in columns) + "\n"


def csv_grouped(columns: list[str], rows: Iterator[Row], member: str, as_column: str) -> Iterator[str]:
    """Like ``csv_rows`` for rows that come group by group: the values of ``member`` of neighbouring rows that agree in all other columns stand in one cell, joined by semicolons."""
    rest = [c for c in columns if c != member]
    yield ",".join(map(csv_value, [*rest, as_column])) + "\n"
    for key, group in groupby(rows, key=lambda r: tuple(r[c] for c in rest)):
        yield ",".join(map(csv_value, [*key, ";".join(r[member] for r in group)])) + "\n"


def json_text(value: object) -> str:
    """A plain value as one line of JSON."""
    return json.dumps(value, ensure_ascii=False, default=str)


def to_json(df: DataFrame) -> DataFrame:
    """One column ``json``, an object a row; null fields are kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def names(listed: list[str], shown: int = SHOWN_NAMES) -> str:
    more = len(listed) - shown
    return ", ".join(listed[:shown]) + (f" (+{more} more)" if more > 0 else "")


def one_line(text: str | None) -> str:
    return (text or "").replace("\n", " ")


def table(title: str, rows: list[Row], columns: list[str], truncated: bool = False) -> str:
    """Title and aligned columns; says so where nothing was found or more was cut off."""
    if not rows:
        return f"{title}\n  (none)\n"
    cells = [[one_line("" if r[c] is None else str(r[c])) for c in columns] for r in rows]
    width = [max(len(columns[i]), *(len(line[i]) for line in cells)) for i in range(len(columns))]
    lines = ["  " + "  ".join(v.ljust(w) for v, w in zip(line, width)).rstrip() for line in [columns, *cells]]
    return "\n".join([title, *lines]) + ("\n  (more cut off)" if truncated else "") + "\n"


def ranking(metric: str, rows: list[Row]) -> str:
    return f"Ranking by {metric}\n" + "".join(f"{r['rank']:>5}. {r['name']}  {r['value']}\n" for r in rows)


def path(nodes: list[str], layers: list[str]) -> str:
    if not nodes:
        return "no path\n"
    return nodes[0] + "".join(f"\n  -[{layer}]-> {node}" for layer, node in zip(layers, nodes[1:])) + "\n"
