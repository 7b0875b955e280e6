"""Values of court judgments: amounts, rates, dates and case numbers of the heading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import text as X
from formloom.functions.text import _c

EDGE = r"^[ .,;:\-]+|[ .,;:\-]+$"
HEADER_EDGE = r"^[ :\-–—\t]+|[ :\-–—\t]+$"
NEXT_LINES = 3


def first_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """what the first pattern that matches captures, without marks at its ends; a blank capture doesn't count."""
    return F.coalesce(*[F.nullif(F.regexp_replace(F.regexp_extract(text, p, 1), EDGE, ""), F.lit("")) for p in patterns])


def judgment_values(c: Column | str) -> Column:
    """struct(pay_amount, interest_rate, principal, filing_date, attorney_fee) of a judgment text."""
    def row(t: Column) -> Column:
        filed = X.norm_ws(F.replace(first_pattern(t, K.FILING_PATTERNS), F.lit("/"), F.lit(" ")))
        return F.struct(
            first_pattern(t, K.PAY_PATTERNS).alias("pay_amount"), first_pattern(t, K.INTEREST_PATTERNS).alias("interest_rate"),
            first_pattern(t, K.PRINCIPAL_PATTERNS).alias("principal"), F.nullif(filed, F.lit("")).alias("filing_date"),
            first_pattern(t, K.FEE_PATTERNS).alias("attorney_fee"))

    return X.let(F.coalesce(_c(c), F.lit("")), row)


def _undecorated(line: Column) -> Column:
    return X.trimmed(F.regexp_replace(F.regexp_replace(X.trimmed(line), r"^(#\s*)+", ""), r"^([-*+>]\s*)+", ""))


def _header_value(c: Column) -> Column:
    """A heading's value: with a digit, without decoration; else NULL."""
    v = F.regexp_replace(_undecorated(c), HEADER_EDGE, "")
    return F.when(v.rlike(r"\p{Nd}"), v)


def _marked(line: Column, markers: Sequence[str]) -> Column:
    return X.contains_any(X.compact(line), [_squeezed(m) for m in markers])


def _squeezed(marker: str) -> str:
    return "".join(marker.split())


def case_number_after(lines: Column, markers: Sequence[str]) -> Column:
    """The first value behind a marker on its line, else on one of the next three before another marker."""
    both = (*K.BLACK_MARKERS, *K.RED_MARKERS)

    def below(i: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(False).alias("stop"))

        def step(s: Column, line: Column) -> Column:
            skipped = line.contains(K.COURT_ONLY_MARK)
            ends = ~skipped & _marked(line, both)
            value = F.when(~s["stop"] & ~skipped & ~ends, F.coalesce(s["v"], _header_value(line))).otherwise(s["v"])
            return F.struct(value.alias("v"), (s["stop"] | ends | value.isNotNull()).alias("stop"))

        return F.aggregate(F.slice(lines, i + 2, NEXT_LINES), start, step, lambda s: s["v"])

    def value(line: Column, i: Column) -> Column:
        same = F.coalesce(*[F.when(line.contains(F.lit(m)), _header_value(F.substr(line, F.locate(m, line) + len(m)))) for m in markers])
        return F.when(_marked(line, markers), F.coalesce(same, below(i)))

    return F.get(F.array_compact(F.transform(lines, value)), F.lit(0))


def case_header(c: Column | str) -> Column:
    """struct(black, red) case numbers of a page's heading."""
    lines = F.filter(F.transform(X.lines_of(F.coalesce(_c(c), F.lit(""))), _undecorated), lambda x: x != "")
    return X.let(lines, lambda ls: F.struct(case_number_after(ls, K.BLACK_MARKERS).alias("black"), case_number_after(ls, K.RED_MARKERS).alias("red")))


def case_number(c: Column | str) -> Column:
    """the first token that looks like a case number, from its series on; the misread series is put right."""
    tokens = F.regexp_extract_all(F.replace(_c(c), F.lit(" "), F.lit("")), F.lit(r"[A-Za-zก-๛0-9๐-๙./-]+"), F.lit(0))
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.,;:\-/]+|[.,;:\-/]+$", ""))
    opened = F.transform(bare, lambda t: F.regexp_replace(t, f"^(?:.*?(?={K.CASE_SERIES})|(?!.*{K.CASE_SERIES}).*?(?={K.MISREAD_SERIES}))", ""))
    named = F.transform(opened, lambda t: F.regexp_replace(t, "^" + K.MISREAD_SERIES, K.CASE_SERIES))
    return F.get(F.filter(named, lambda t: t.contains("/") & t.rlike(r"\p{Nd}")), F.lit(0))


def case_number_score(c: Column | str) -> Column:
    """how much a text looks like a whole case number."""
    v = F.replace(_c(c), F.lit(" "), F.lit(""))
    slashes, size = F.length(v) - F.length(F.replace(v, F.lit("/"), F.lit(""))), F.length(v)
    thai, other = F.regexp_count(v, F.lit("[๐-๙]")), F.regexp_count(v, F.lit(r"(?![๐-๙])\p{Nd}"))
    marks = (
        (v.startswith(K.CASE_SERIES), 3.0), (v.startswith(K.CASE_SERIES + "."), 0.5), (v.contains("ศต"), 1.0), (v.contains("E"), 0.8),
        (slashes == 1, 3.0), (slashes == 2, 1.0), (thai >= 4, 2.0), (other > 0, -0.4), (v.rlike("/๒๕[0-9๐-๙]{2}$"), 3.5), (v.rlike("/25[0-9]{2}$"), 2.5),
        (v.contains(".") & ~F.substring(v, 1, 4).contains(K.CASE_SERIES), -1.2), ((size < 8) | (size > 22), -1.5),
    )
    out = F.lit(0.0)
    for holds, points in marks:
        out = out + F.when(holds, points).otherwise(0.0)
    return out
