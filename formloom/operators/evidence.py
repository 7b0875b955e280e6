"""Choices between several readings: of a case number, of a page, of a form's field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import compare as C
from formloom.functions import judgment as J
from formloom.functions import text as X
from formloom.operators.review import consensus_label, selection_reason
from formloom.session import joined_within


def case_consensus(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, value, bbox, source, support_count, consensus_score: the value that the evidence speaks for.

    ``candidates(keys, seq, value, bbox, source, method, preview_source)``. Equal
    values support each other: the score of the text, points for every further
    reading and page image, for each kind of reading and for pairs of kinds,
    and a little for the original image. Of equal scores more readings win,
    then the longer value, then the one read first. The box is that of the best
    reading: one that has a box, then by its kind, image and place.
    """
    filled = candidates.withColumn("value", X.trimmed("value")).filter("value <> ''")
    text = lambda c: F.coalesce(c, F.lit(""))
    kind = F.when(F.col("method") == "vision_crop", 2).when(F.col("method") == "ocr_crop", 1).otherwise(0)
    rank = F.struct(F.col("bbox").isNotNull(), kind, text(F.col("preview_source")) == "original", -F.col("seq"))
    groups = filled.groupBy(*keys, "value").agg(
        F.count("*").alias("n"), F.size(F.collect_set(text(F.col("preview_source")))).alias("previews"), F.collect_set("method").alias("methods"),
        F.max(text(F.col("source")).contains("original")).alias("original"), F.max_by(F.struct("bbox", "source"), rank).alias("best"), F.min("seq").alias("first"),
    )
    has = lambda m: F.array_contains("methods", m)
    score = J.case_number_score("value") + (F.col("n") - 1) * K.SUPPORT_BONUS + (F.col("previews") - 1) * K.PREVIEW_BONUS
    for method, points in K.METHOD_BONUS:
        score = score + F.when(has(method), points).otherwise(0.0)
    for (a, b), points in K.PAIR_BONUS:
        score = score + F.when(has(a) & has(b), points).otherwise(0.0)
    score = score + F.when(F.col("original"), K.ORIGINAL_BONUS).otherwise(0.0)
    # sums of tenths: rounded, so that equal evidence ties
    groups = groups.withColumn("score", F.round(score, 6))
    order = F.struct("score", "n", F.length("value"), -F.col("first"))
    chosen = groups.groupBy(*keys).agg(F.max_by(F.struct("value", "best", "n", "score"), order).alias("c"))
    source = F.when(F.col("c.n") > 1, "hybrid_case_consensus").otherwise(F.coalesce(F.nullif("c.best.source", F.lit("")), F.lit("hybrid_case_consensus")))
    return chosen.select(*keys, "c.value", "c.best.bbox", source.alias("source"), F.col("c.n").alias("support_count"), F.bround("c.score", 3).alias("consensus_score"))


#: Reasons that come with a chosen page reading.
NO_CLEANED = "No cleaned OCR candidate succeeded, so this page may need a manual check."
NO_ORIGINAL = "Original OCR did not produce a usable candidate for this page."
KEPT_SERIES = "The original first-page OCR kept a Latin case-number series that cleaned OCR missed."
AGGRESSIVE = "The selected cleaned OCR text came from the aggressive black/white image candidate."
FEW_BLOCKS = "Few OCR blocks were detected on this page."
SHORT = "The selected OCR output is shorter than expected."
FEW, SHORTEST = 3, 120


def pick_best_candidate(candidates: DataFrame, keys: list[str], page: str = "page_number") -> DataFrame:
    """The reading of each page that scores best (F18), with the scores of all and why to doubt it.

    ``candidates(keys, page, seq, source, model, text)``; sources other than
    ``original`` count as cleaned. Of equal scores the first read wins. On page 1
    the original is taken all the same if its best reading has a case number of
    a Latin series and the best cleaned one hasn't.
    """
    rows = candidates.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("kind", F.when(F.col("source") == "original", "original").otherwise("cleaned"))
    rows = rows.withColumn("lines", X.candidate_lines("text"))
    rows = rows.withColumn("score", X.text_quality(F.col("text"), F.col("lines")))
    # only the first page asks for a series, and none is without a stroke
    series = F.when((F.col(page) == 1) & F.col("text").contains("/"), X.compact("text").rlike(K.LATIN_CASE_SERIES)).otherwise(False)
    rows = rows.withColumn("series", series).withColumn("blocks", F.size("lines")).drop("lines")
    order = F.struct("score", -F.col("seq"))
    one = F.struct("kind", "source", "model", "text", "score", "series", "blocks")
    of = lambda kind, what: F.max_by(what, F.when(F.col("kind") == kind, order))
    label = F.concat_ws(":", "source", "model")
    scores = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "seq", label.alias("label"))))
    pages = rows.groupBy(*keys, page).agg(F.max_by(one, order).alias("top"), of("original", one).alias("o"), of("cleaned", F.struct("score", "series")).alias("c"), scores.alias("scores"))
    kept = (F.col(page) == 1) & F.coalesce(F.col("o.series"), F.lit(False)) & ~F.coalesce(F.col("c.series"), F.lit(False))
    pages = pages.withColumn("kept", F.coalesce(kept, F.lit(False))).withColumn("s", F.when(F.col("kept"), F.col("o")).otherwise(F.col("top")))
    told = [
        F.when(F.col("c").isNull(), NO_CLEANED), F.when(F.col("o").isNull(), NO_ORIGINAL), F.when(F.col("kept"), KEPT_SERIES),
        F.when(F.col("s.source") == "aggressive", AGGRESSIVE), F.when(F.col("s.blocks") <= FEW, FEW_BLOCKS), F.when(F.length(X.compact("s.text")) < SHORTEST, SHORT),
    ]
    return pages.select(
        *keys, page, F.col("s.kind").alias("selected_source"), F.col("s.source").alias("candidate_source"), F.col("s.model").alias("model"),
        F.col("s.text").alias("text"), F.col("s.score").alias("score"), F.col("o.score").alias("original_score"), F.col("c.score").alias("cleaned_score"),
        F.transform("scores", lambda x: F.struct(x["label"].alias("label"), (-x["down"]).alias("score"))).alias("candidate_scores"), F.array_compact(F.array(*told)).alias("reasons"),
    )


def reading_similarity(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """How alike the best original and cleaned readings of a page are (``keys, original, cleaned``), by matching blocks."""
    flat = candidates.withColumns({"_o": X.compact_lower("original"), "_c": X.compact_lower("cleaned")})
    return C.with_matching_ratio(flat, "_o", "_c", "similarity").drop("_o", "_c")


def _last_entries(entries: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """The last entry of each field, its columns under a prefix; entries without a field don't count."""
    last = entries.filter("field <> ''").groupBy("record_id", "field").agg(F.max_by(F.struct(*names), "seq").alias("e"))
    return last.select("record_id", "field", F.lit(True).alias(f"{prefix}_there"), *[F.col(f"e.{n}").alias(f"{prefix}_{n}") for n in names])


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def decision_map(fields: DataFrame, parsed: DataFrame, derived: DataFrame, crop: DataFrame, vision: DataFrame, dashes: DataFrame) -> DataFrame:
    """One row per field of a record: the value it has, what every reader said, why it was chosen and who confirms it.

    ``fields(record_id, field, value, source, review_status)`` decide which rows
    there are; ``parsed`` is the same before readers were asked. ``derived``,
    ``crop`` and ``vision(record_id, field, seq, value, source, action, ...)``
    may hold several entries of a field, of which the last counts; an entry
    without a value stands for the selected one. ``dashes(record_id, field)``.
    """
    key = ["record_id", "field"]
    sides = [
        _last_entries(derived, ["value", "action", "previous_value", "previous_source"], "derived"),
        _last_entries(crop, ["value", "source", "action"], "crop"), _last_entries(vision, ["value", "source", "action"], "vision"),
        parsed.filter("field <> ''").groupBy(*key).agg(F.max(_text("value")).alias("parser_value"), F.max(_text("source")).alias("parser_source")),
        dashes.filter("field <> ''").select(*key).distinct().withColumn("visual_dash", F.lit(True)),
    ]
    rows = fields.select(*key, _text("value").alias("selected_value"), _text("source").alias("selected_source"), _text("review_status").alias("selected_review_status"))
    for side in sides:
        rows = joined_within(rows, side, *key)
    for name in ("derived", "crop", "vision"):
        rows = rows.withColumn(f"{name}_value", F.when(F.col(f"{name}_there"), F.coalesce(F.nullif(f"{name}_value", F.lit("")), F.col("selected_value"))))
    action = lambda n: _text(f"{n}_action")
    return rows.select(
        *key, "selected_value", "selected_source", "selected_review_status",
        selection_reason(F.col("field"), F.col("selected_source"), action("derived"), action("crop"), action("vision"), F.col("visual_dash")).alias("selection_reason"),
        "parser_value", "parser_source", "derived_value", "derived_action", F.col("derived_previous_value").alias("previous_value"),
        F.col("derived_previous_source").alias("previous_source"), "vision_value", "vision_source", "vision_action", "crop_value", "crop_source", "crop_action",
        F.coalesce("visual_dash", F.lit(False)).alias("visual_dash"),
        consensus_label(F.col("selected_value"), F.col("parser_value"), F.col("crop_value"), F.col("vision_value")).alias("candidate_consensus"),
    )
