"""A judgment's text, clipped from page segments and followed over pages.

A page's segments are cut by running counts: how many were taken, how long they
are, and whether an end marker has been completed. What is carried from one
segment to the next is the count, the length and the last few characters (a
marker may run over segments), so a window over one page's segments does. Over
pages only one row a page is left, and the first hit and the first page that
ends are plain aggregates, so that a document of any length is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import text as X

_ENDS = [*K.JUDGMENT_ENDS, *K.JUDGMENT_LOOSE_ENDS]
#: Pages whose keys are broadcast.
SENT_PAGES = 200_000
#: Characters of earlier segments that a marker which ends in this one can start in.
REACH = max(len("".join(w.split())) for w in _ENDS) - 1
#: Lines at the top of a following page that say nothing: a sheet number or a lone item number.
_SHEET = r"^\(?[0-9๐-๙]+\s*พ\.\)?$|^[0-9๐-๙]+\)$"


def _holds(compact: Column, words: Sequence[str]) -> Column:
    return X.contains_any(compact, ["".join(w.split()).lower() for w in words])


def _clipped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The segments of each page up to its stop, joined: text, box, segments, chars, ended.

    ``rows(keys, seg_no, text, compact, bbox)`` start where the passage starts.
    A stop marker ends it before its segment, an end marker or a spent budget
    after it.
    """
    page = Window.partitionBy(*keys).orderBy("seg_no")
    so_far, before = page.rowsBetween(Window.unboundedPreceding, 0), page.rowsBetween(-REACH, -1)
    tails = F.right(F.array_join(F.collect_list(F.right("compact", F.lit(REACH))).over(before), ""), F.lit(REACH))
    counted = rows.withColumns({
        "n": F.count("*").over(so_far), "chars": F.sum(F.length("text")).over(so_far), "reach": F.concat(tails, "compact"),
    }).withColumns({"ends": _holds(F.col("reach"), _ENDS), "stops": _holds(F.col("compact"), K.JUDGMENT_STOPS) & (F.col("n") > 1)})
    full = F.col("ends") | (F.col("n") >= K.PASSAGE_SEGMENTS) | (F.col("chars") >= K.PASSAGE_CHARS)
    earlier = page.rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(full).over(earlier), F.lit(False)) | F.max("stops").over(so_far)
    kept = counted.withColumn("over", over).filter("not over")
    edge = lambda fn, i: fn(F.when(F.size("bbox") == 4, F.get("bbox", F.lit(i))))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"])
    return kept.groupBy(*keys).agg(
        X.norm_ws(F.array_join(parts, " ")).alias("text"), F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"), F.max("ends").alias("ended"),
        F.when(edge(F.min, 0).isNotNull(), F.array(edge(F.min, 0), edge(F.min, 1), edge(F.max, 2), edge(F.max, 3))).alias("bbox"),
    )


def _usable(segments: DataFrame, keys: list[str]) -> DataFrame:
    rows = segments.select(*keys, "seg_no", X.trimmed("text").alias("text"), "bbox").filter("text <> ''")
    return rows.withColumn("compact", X.compact_lower("text"))


def clip_passage(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, text, segments, chars, ended, bbox of the pages on which a judgment begins.

    ``segments(keys, seg_no, text, bbox)``; from the first segment with a keyword
    on, noise left out, to an end marker, a stop marker or the end of the budget
    (18 segments, 1400 characters). A clip without a start keyword is no hit.
    """
    rows = _usable(segments, keys)
    # only pages with a keyword are sorted; their keys are sent to all tasks while they are few
    asked = rows.groupBy(*keys).agg(F.max(_holds(F.col("compact"), K.JUDGMENT_KEYWORDS)).alias("_hit")).filter("_hit").select(*keys)
    asked = F.broadcast(asked) if asked.limit(SENT_PAGES + 1).count() <= SENT_PAGES else asked
    rows = rows.join(asked, keys, "left_semi")
    begun = F.max(_holds(F.col("compact"), K.JUDGMENT_KEYWORDS)).over(Window.partitionBy(*keys).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("begun", begun).filter(F.col("begun") & ~_holds(F.col("compact"), K.JUDGMENT_NOISE))
    return _clipped(rows, keys).filter(_holds(X.compact_lower("text"), K.JUDGMENT_STARTS))


def clip_continuation(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The same from the first segment of a page that says something, keyword or not."""
    rows = _usable(segments, keys)
    says = ~(F.col("compact").isin(*K.CONTINUATION_NOISE) | X.norm_ws("text").rlike(_SHEET) | _holds(F.col("compact"), K.JUDGMENT_NOISE))
    begun = F.max(says).over(Window.partitionBy(*keys).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0))
    return _clipped(rows.withColumn("begun", begun).filter(F.col("begun") & ~_holds(F.col("compact"), K.JUDGMENT_NOISE)), keys)


def passage_across_pages(segments: DataFrame, key: str) -> DataFrame:
    """Key, page_number, continues (0 on the first page), text, ...: the first page with a hit and the pages that go on from it.

    Pages follow until one holds the end marker, that one included.
    """
    keys = [key, "page_number"]
    hits = clip_passage(segments, keys)
    first = hits.groupBy(key).agg(F.min("page_number").alias("hit"), F.min_by("ended", "page_number").alias("done"))
    later = clip_continuation(segments.join(first.filter("not done").select(key, "hit"), key).filter("page_number > hit").drop("hit"), keys)
    last = later.filter("ended").groupBy(key).agg(F.min("page_number").alias("last"))
    following = later.join(last, key, "left").filter("last is null or page_number <= last").drop("last")
    opening = hits.join(first.select(key, F.col("hit").alias("page_number")), keys, "left_semi")
    parts = opening.withColumn("later", F.lit(0)).unionByName(following.withColumn("later", F.lit(1)))
    return parts.select(*keys, F.col("later").alias("continues"), "text", "segments", "chars", "ended", "bbox")
