"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concise(text: Column, maximum: int) -> Column:
    """White space runs as one space, trimmed, and cut to ``maximum`` characters of which the last is an ellipsis."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) <= maximum, plain).otherwise(F.concat(F.substring(plain, 1, max(maximum - 1, 0)), F.lit("…")))


def node_label(node: Column) -> Column:
    """kind, then name, #index, binder, value and levels of an expression node where there are any."""
    levels = F.array_join(node["universe_levels"], ",")
    return F.concat_ws(
        " ", node["kind"], node["name"], F.concat(F.lit("#"), node["var_index"].cast("string")), node["binder_info"], node["value_text"], F.when(F.size(node["universe_levels"]) > 0, F.concat(F.lit("levels="), levels))
    )


def name_list(names: Column, shown: int = 12) -> Column:
    """The first ``shown`` names with the number of those left out."""
    more = F.size(names) - shown
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def humanize(text: Column) -> Column:
    """camelCase as words in lower case."""
    return F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
