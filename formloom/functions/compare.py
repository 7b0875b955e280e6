"""Similarity and acceptance rules between two readings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import fields as FL
from formloom.functions import text as X
from formloom.functions.text import _c


def edit_ratio(a: Column | str, b: Column | str, in_bytes: bool = False) -> Column:
    """F30, edit-distance form: 1 - levenshtein over the longer length, all in the JVM.

    ``in_bytes`` counts the edits in UTF-8 bytes, the lengths still in
    characters; the ratio is below 0 then where many letters of several bytes differ.
    """
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    # one Latin-1 character a byte
    unit = (lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")) if in_bytes else (lambda c: c)
    return F.when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(unit(a), unit(b)) / longest)


def with_matching_ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """add ``name``, twice the characters in matching blocks over those of both texts.

    The longest common block counts first (of equals the earliest), then what
    is left of it on both sides, then right of it. 0 where a text is blank, 1
    where both are equal; only distinct pairs that differ are worked out, in
    Arrow batches, and joined back.
    """
    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.columns
            found = [SequenceMatcher(None, m, n).ratio() for m, n in zip(x.to_pylist(), y.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x, y, pa.array(found, pa.float64())], names=["__a", "__b", "__r"])

    rows = df.withColumns({"__a": F.coalesce(F.col(a), F.lit("")), "__b": F.coalesce(F.col(b), F.lit(""))})
    pairs = rows.select("__a", "__b").filter("__a <> '' and __b <> '' and __a <> __b").distinct()
    found = pairs.mapInArrow(ratios, "__a string, __b string, __r double")
    joined = rows.join(found, ["__a", "__b"], "left")
    blank = (F.col("__a") == "") | (F.col("__b") == "")
    return joined.withColumn(name, F.when(blank, 0.0).when(F.col("__a") == F.col("__b"), 1.0).otherwise(F.col("__r"))).drop("__a", "__b", "__r")


def bigrams(s: Column) -> Column:
    """Distinct pairs of neighbouring characters as numbers; a text of two characters or less is one."""
    def pairs(codes: Column) -> Column:
        both = F.transform(codes, lambda c, i: F.shiftleft(c, 21) + F.coalesce(F.get(codes, i + 1), F.lit(0)))
        return F.array_distinct(F.slice(both, 1, F.greatest(F.size(codes) - 1, F.least(F.size(codes), F.lit(1)))))

    letters = F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    return X.let(F.transform(letters, lambda x: F.ascii(x).cast("long")), pairs)


def bigram_jaccard(a: Column | str, b: Column | str) -> Column:
    """shared distinct character pairs of the compact lower texts."""
    both = F.struct(
        X.compact_lower(F.coalesce(_c(a), F.lit(""))).alias("x"), X.compact_lower(F.coalesce(_c(b), F.lit(""))).alias("y")
    )

    def score(t: Column) -> Column:
        x, y = t["x"], t["y"]

        def shared(g: Column) -> Column:
            common = F.size(F.array_intersect(g["x"], g["y"]))
            return common / (F.size(g["x"]) + F.size(g["y"]) - common)

        grams = F.struct(bigrams(x).alias("x"), bigrams(y).alias("y"))
        return (
            F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).when(x == y, 1.0)
            .otherwise(X.let(grams, shared))
        )

    return X.let(both, score)


#: Letters of the runs by which most of a line is looked up in a passage.
RUN = 5


def runs(text: str) -> set[str]:
    """All runs of five letters of a text."""
    return {text[i : i + RUN] for i in range(len(text) - RUN + 1)}


def belongs(line: str, passage: str, known: set[str], own: str = "") -> bool:
    """F54 for one line: whether it belongs to ``own`` + ``passage``, whose runs are ``known`` but for those that begin in ``own``.

    A text of five letters or more is looked for in the passage only if its
    first run is there, so lines that don't belong cost no pass over it.
    """
    if not line or not (own or passage):
        return False
    seam = runs(own + passage[: RUN - 1]) if own else ()

    def there(part: str) -> bool:
        if len(part) >= RUN and part[:RUN] not in known and part[:RUN] not in seam:
            return False
        return part in passage or (own != "" and part in own + passage[: len(part) - 1])

    n = len(line)
    if there(line) or (n >= 6 and (there(line[:14]) or there(line[-12:]))):
        return True
    if n < 10:
        return False
    parts = [line[i : i + RUN] for i in range(0, n - RUN + 1, 2)]
    return sum(p in known or p in seam for p in parts) / len(parts) >= 0.18


def lines_in_passage(pages: DataFrame, key: str, passage: str, lines: str) -> DataFrame:
    """key, n, hit: which of a page's lines belong to its passage (compared compact and lower).

    ``pages(key, passage, lines)``, with lines of ``struct<n, own, line>``:
    ``own`` stands before the passage for this line only (it is lowered by
    itself). A line belongs if the passage holds it, its first 14 or last 12
    letters (6 at least), or 18 % of every second of its runs of five letters,
    from 10 letters on. A passage's runs are made once, not for every line.
    """
    clean = lambda c: X.compact_lower(F.coalesce(c, F.lit("")))
    held = F.transform(lines, lambda x: F.struct(x["n"].cast("int").alias("n"), clean(x["own"]).alias("own"), clean(x["line"]).alias("line")))
    rows = pages.select(key, clean(F.col(passage)).alias("passage"), held.alias("lines"))
    schema = rows.select(key).withColumns({"n": F.lit(0), "hit": F.lit(True)}).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, hits = [], [], []
            for i in range(len(batch)):
                text = batch.column("passage")[i].as_py()
                known = runs(text)
                for x in batch.column("lines")[i].as_py() or ():
                    at.append(i)
                    numbers.append(x["n"])
                    hits.append(belongs(x["line"], text, known, x["own"]))
            made = [batch.column(key).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(hits, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return rows.mapInArrow(judged, schema)


def accept_correction(raw: Column | str, new: Column | str, ratio: Column, least: float = 0.16, least_long: float = 0.26) -> Column:
    """keep a corrected line unless script, similarity or length speak against it.

    ``ratio`` is the matching-block ratio of the compact lower texts
    (``with_matching_ratio``), which the thresholds are set for.
    """
    raw, new = _c(raw), _c(new)
    thai_raw, thai_new = (F.regexp_count(c, F.lit(r"[฀-๿]")) for c in (raw, new))
    cyrillic, latin = F.regexp_count(new, F.lit(r"[Ѐ-ӿ]")), F.regexp_count(new, F.lit("[A-Za-z]"))
    switched = (thai_raw >= 3) & (thai_new == 0) & ((cyrillic >= 2) | (latin >= 4))
    n0, n1 = X.compact_length(raw), X.compact_length(new)
    return (
        F.when(X.compact(new) == "", False).when(switched, False).when(ratio < least, False)
        .when(~(n1 / n0).between(0.45, 2.8), False).when((ratio < least_long) & (n0 >= 18), False).otherwise(True)
    )


def soft_name_match(a: Column | str, b: Column | str) -> Column:
    """F32: parent names that differ in at most two places."""
    a, b = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))
    x, y = X.compact(a), X.compact(b)
    gap = F.abs(F.length(x) - F.length(y))
    shared = F.least(F.length(x), F.length(y))
    spots = F.when(shared > 0, F.sequence(F.lit(1), F.greatest(shared, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    misses = F.size(F.filter(spots, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1))))
    ok_a, ok_b = FL.valid_value("motherName", a), FL.valid_value("motherName", b)
    return (
        F.when(~ok_a, False).when(~ok_b, True).when(x == y, True).when(gap > 2, False).otherwise(misses + gap <= 2)
    )


def accept_reader_value(field: Column | str, current: Column | str, new: Column | str, ungrown: Sequence[str] = ()) -> Column:
    """one token for parent names; a value of the ``ungrown`` fields must not just grow at its end."""
    field, current, new = _c(field), F.coalesce(_c(current), F.lit("")), X.norm_ws(new)
    cur_words, new_words = F.split(X.norm_ws(current), " "), F.split(new, " ")
    head = F.array_join(F.slice(new_words, 1, F.size(cur_words)), " ")
    grown = (F.size(new_words) > F.size(cur_words)) & (head == current)
    gated = field.isin(*ungrown) if ungrown else F.lit(False)
    return (
        F.when(field.isin(*K.PARENT_NAMES) & (F.size(new_words) > 1), False)
        .when(~gated | (current == ""), True)
        .otherwise(~grown)
    )


def plausible_parent_name(c: Column | str) -> Column:
    """A valid parent name of at most two words without office words."""
    v = X.norm_ws(F.coalesce(_c(c), F.lit("")))
    return FL.valid_value("motherName", v) & (F.size(F.split(v, " ")) <= 2) & ~X.contains_any(v, K.PARENT_CROP_BLOCKED)
