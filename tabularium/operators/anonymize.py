"""Masks the personal data of a table and reports what was masked."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.functions.expressions import is_text, quoted
from tabularium.functions.masking import IDENTITY, MASK, PATTERNS, fired, is_hinted, mask


@dataclass
class Report:
    """Columns masked with the reason: ``column_name_hint`` or the sorted labels found in it."""

    masked_columns: dict[str, str | list[str]] = field(default_factory=dict)
    detected_types: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {"masked_columns": self.masked_columns, "detected_types": self.detected_types}


def _split(df: DataFrame, but: str | None = None) -> tuple[list[str], list[str]]:
    hinted = [c for c in df.columns if is_hinted(c) and c != but]
    texts = [f.name for f in df.schema if is_text(f.dataType) and f.name not in hinted]
    return hinted, texts


def masked(df: DataFrame, but: str | None = None) -> DataFrame:
    """Columns whose name is a hint become the mask, also where null; patterns are masked in all other text columns.

    Only expressions, so it serves streams as well as tables.
    """
    hinted, texts = _split(df, but)
    changed = {c: F.lit(MASK) for c in hinted} | {c: mask(F.col(quoted(c))) for c in texts}
    return df.withColumns(changed) if changed else df


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, label, n): cells in which each label fires, in one pass over all columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("text")) for c in columns]))
    found = fired(df.select(cells.alias("x")).select("x.*"), "text").groupBy("column").agg(*[F.count_if(F.col(name)).alias(name) for name in PATTERNS])
    counts = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.col(name).alias("n")) for name in PATTERNS]))
    return found.select("column", counts.alias("x")).select("column", "x.*").where("n > 0")


def report(df: DataFrame, but: str | None = None) -> Report:
    hinted, texts = _split(df, but)
    by_column: dict[str, list[str]] = {}
    if texts:
        for column, name, _ in label_counts(df, texts).collect():  # columns x 7 rows at most
            by_column.setdefault(column, []).append(name)
    reasons = {c: "column_name_hint" if c in hinted else sorted(by_column[c]) for c in df.columns if c in hinted or c in by_column}
    kinds = {name for names in by_column.values() for name in names} | ({IDENTITY} if hinted else set())
    return Report(reasons, sorted(kinds))


def report_frame(df: DataFrame) -> DataFrame:
    """The report as (column, reason, labels)."""
    hinted, texts = _split(df)
    schema = "column string, reason string, labels array<string>"
    named = df.sparkSession.createDataFrame([(c, "column_name_hint", [IDENTITY]) for c in hinted], schema)
    if not texts:
        return named
    found = label_counts(df, texts).groupBy("column").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return named.unionByName(found.select("column", F.lit("patterns").alias("reason"), "labels"))


def anonymize(df: DataFrame, but: str | None = None) -> tuple[DataFrame, Report]:
    """The masked table and what was masked; the column ``but`` stays as it is."""
    return masked(df, but), report(df, but)


def image_report(image_paths: list[str]) -> dict:
    """Images are only counted; redacting them needs a vision model."""
    return {"mode": "image", "note": "visual redaction is not done here", "n_images": len(image_paths)}


LABELS = tuple(PATTERNS)
