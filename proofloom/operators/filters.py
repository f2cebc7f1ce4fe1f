"""Which declarations, symbols and edges an analysis looks at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = ("statement", "proof")


def hidden(prefix: str = "") -> Column:
    """Generated, internal or private; unknown flags count as false."""
    c = lambda n: F.col(prefix + n)
    return c("generation_kind").isNotNull() | F.coalesce(c("is_internal"), F.lit(False)) | F.coalesce(c("is_private"), F.lit(False))


def visibility(prefix: str = "") -> Column:
    """internal before private before public."""
    c = lambda n: F.coalesce(F.col(prefix + n), F.lit(False))
    return F.when(c("is_internal"), "internal").when(c("is_private"), "private").otherwise("public")


@dataclass(frozen=True)
class AnalysisFilter:
    """Hidden declarations and infrastructure targets are left out unless asked for. ``kind``, ``module`` and ``source_backed_only``
    test the source of an edge only; ``internal_only`` and ``include_infrastructure`` its target; ``layer`` None means both."""

    include_generated: bool = False
    include_infrastructure: bool = False
    internal_only: bool = False
    source_backed_only: bool = False
    kind: str | None = None
    module: str | None = None
    layer: str | None = None

    def __post_init__(self) -> None:
        if self.layer not in (None, *LAYERS):
            raise ValueError(f"unknown layer {self.layer!r}")

    @classmethod
    def all(cls, **other) -> AnalysisFilter:
        return cls(include_generated=True, include_infrastructure=True, **other)

    def declaration(self) -> Column:
        test = F.lit(True)
        if not self.include_generated:
            test = test & ~F.col("hidden")
        if self.source_backed_only:
            test = test & F.col("start_line").isNotNull()
        if self.kind is not None:
            test = test & (F.col("kind") == self.kind)
        if self.module is not None:
            test = test & (F.col("module_name") == self.module)
        return test

    def target(self) -> Column:
        test = F.lit(True)
        if self.internal_only:
            test = test & F.col("target_in_corpus")
        if not self.include_generated:
            test = test & ~F.col("target_hidden")
        if not self.include_infrastructure:
            test = test & ~F.col("target_infrastructure")
        return test

    def layers(self) -> Column:
        return F.lit(True) if self.layer is None else F.col("layer") == self.layer

    def declarations(self, df: DataFrame) -> DataFrame:
        return df.where(self.declaration())

    def edges(self, edges: DataFrame, declarations: DataFrame) -> DataFrame:
        """Edges whose source passes ``declaration`` and whose target passes ``target``."""
        return self.sources(edges.where(self.layers() & self.target()), declarations)

    def sources(self, edges: DataFrame, declarations: DataFrame) -> DataFrame:
        """Edges whose source_id passes ``declaration``."""
        ids = self.declarations(declarations).select(F.col("decl_id").alias("source_id"))
        return edges.join(ids.hint("merge"), "source_id", "left_semi")

    def symbols(self, symbols: DataFrame) -> DataFrame:
        """Symbols (with decl_id, null for those outside the corpus) that pass what the filter asks of a target."""
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        test = F.lit(True)
        if self.internal_only:
            test = test & F.col("decl_id").isNotNull()
        if not self.include_generated:
            test = test & ~F.col("hidden")
        if not self.include_infrastructure:
            test = test & ~(flag("is_class") | flag("is_instance") | flag("is_projection"))
        return symbols.where(test)
