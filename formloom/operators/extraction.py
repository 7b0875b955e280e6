"""Structured fields from page text and from segments in template slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as X

VARIANTS = ("corrected_markdown", "markdown", "raw_markdown", "original_markdown", "cleaned_markdown")


def text_variants(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct non-blank texts of a page in column order; stays inside the row."""
    items = F.array(
        *[F.struct(F.lit(i).alias("ord"), F.lit(v).alias("variant"), X.trimmed(v).alias("value"))
          for i, v in enumerate(VARIANTS, 1)]
    )
    kept = F.filter(
        items,
        lambda x: (F.coalesce(x["value"], F.lit("")) != "")
        & ~F.exists(items, lambda y: (y["ord"] < x["ord"]) & y["value"].eqNullSafe(x["value"])),
    )
    return pages.select(*keys, F.inline(kept))
