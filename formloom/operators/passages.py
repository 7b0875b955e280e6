"""Pages, blocks and passages of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.functions.text import _c

# fixed values
PAGE_MARKER = r"(?i)^(#{1,6}\s*)?page\s+\d+\s*$"
COURT = "ศาล"
COURT_LENGTH = 80


def join_pages(pages: DataFrame, keys: Sequence[str], number: str, text: str) -> DataFrame:
    """A document's pages in order, under numbered headings; one page as it is, NULL if all are blank.

    A document is one value in the end, so its pages meet in one row.
    """
    listed = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.coalesce(text, F.lit("")).alias("t")))).alias("p"))
    each = F.transform("p", lambda x, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), X.trimmed(x["t"])))
    whole = X.trimmed(F.array_join(each, "\n\n---\n\n"))
    blank = F.forall("p", lambda x: X.trimmed(x["t"]) == "")
    return listed.select(*keys, F.when(~blank, F.when(F.size("p") == 1, F.col("p")[0]["t"]).otherwise(whole)).alias("text"))


def blocks(c: Column | str) -> Column:
    """Paragraphs without page markers; a text of one paragraph is cut into groups of three lines."""
    source = F.replace(F.coalesce(_c(c), F.lit("")), F.lit("\r"), F.lit("\n"))

    def kept(text: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), lambda x: X.trimmed(x))
        return F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_MARKER))

    def joined(lines: Column) -> Column:
        return X.norm_ws(F.array_join(lines, " "))

    def choose(text: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: joined(kept(p))), lambda p: p != "")

        def grouped(lines: Column) -> Column:
            starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(3))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: joined(F.slice(lines, i, 3)))

        return X.let(paragraphs, lambda p: F.when(F.size(p) > 1, p).otherwise(X.let(kept(text), grouped)))

    return X.let(source, choose)


def keyword_windows(c: Column | str, keyword: str, max_chars: int = 420, max_blocks: int = 2, to_page_end: bool = False) -> Column:
    """From each block with the keyword on, that block and those after it up to either limit; each window once.

    Where no block holds it, plain windows of the text around each hit.
    """
    word = F.lit(keyword)

    def gather(tail: Column) -> Column:
        start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

        def step(s: Column, b: Column) -> Column:
            longer = F.when(s["n"] == 0, b).otherwise(F.concat(s["t"], F.lit(" "), b))
            if to_page_end:
                return F.struct(longer.alias("t"), (s["n"] + 1).alias("n"), F.lit(False).alias("stop"))
            too_long = (s["n"] > 0) & (F.length(longer) > max_chars)
            full = F.struct(s["t"].alias("t"), s["n"].alias("n"), F.lit(True).alias("stop"))
            more = F.struct(longer.alias("t"), (s["n"] + 1).alias("n"), (F.length(longer) >= max_chars).alias("stop"))
            return F.when(s["stop"] | (s["n"] >= max_blocks) | too_long, full).otherwise(more)

        return F.aggregate(tail, start, step, lambda s: s["t"])

    def from_blocks(bs: Column) -> Column:
        def window(b: Column, i: Column) -> Column:
            own = F.array(X.norm_ws(F.substr(b, F.locate(keyword, b))))
            return F.when(b.contains(word), gather(F.concat(own, F.slice(bs, i + 2, F.size(bs)))))

        return F.array_distinct(F.array_compact(F.transform(bs, window)))

    def plain(text: Column) -> Column:
        import re

        size = F.length(text) if to_page_end else F.lit(len(keyword) + max_chars)
        parts = F.split(text, re.escape(keyword))
        before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * len(keyword)
        hits = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(hits, lambda i: F.trim(F.substr(text, before(i) + 1, size))))

    found = X.let(blocks(c), from_blocks)
    return X.let(found, lambda w: F.when(F.size(w) > 0, w).otherwise(X.let(X.norm_ws(F.coalesce(_c(c), F.lit(""))), plain)))


def spaced(keyword: str) -> str:
    """A pattern of the keyword that ignores white space and case."""
    import re

    return r"(?iU)" + r"\s*".join(re.escape(ch) for ch in keyword if not ch.isspace())


def trim_before_keyword(c: Column | str, keyword: str) -> Column:
    """the text from the keyword's first occurrence on, white space ignored; all of it if there is none."""
    plain = " ".join(keyword.split())

    def cut(t: Column) -> Column:
        exact, loose = F.locate(plain, t), F.regexp_instr(t, F.lit(spaced(keyword)))
        at = F.when(exact > 0, exact).otherwise(loose)
        return F.when(at > 0, F.trim(F.substr(t, at))).otherwise(t)

    return X.let(X.norm_ws(F.coalesce(_c(c), F.lit(""))), cut)


def slice_between(c: Column | str, starts: Sequence[str], ends: Sequence[str], fallbacks: Sequence[str] = ()) -> Column:
    """from the first start keyword through the first end keyword after it, white space and case ignored.

    Of end keywords that begin together the longest counts; the fallbacks count
    where no end keyword occurs. Without a start the whole text comes back.
    """
    def first(t: Column, words: Sequence[str]) -> Column:
        return F.array_min(F.filter(F.array(*[F.regexp_instr(t, F.lit(spaced(w))) for w in words]), lambda i: i > 0))

    def end(t: Column, words: Sequence[str]) -> Column:
        spots = [F.struct(F.regexp_instr(t, F.lit(spaced(w))).alias("at"), (-F.length(F.regexp_extract(t, spaced(w), 0))).alias("size")) for w in words]
        best = F.array_min(F.filter(F.array(*spots), lambda s: s["at"] > 0))
        return best["at"] - best["size"] - 1

    def upto(t: Column) -> Column:
        stop = end(t, ends)
        if fallbacks:
            stop = F.coalesce(stop, end(t, fallbacks))
        return F.trim(F.coalesce(F.left(t, stop), t))

    def cut(t: Column) -> Column:
        at = first(t, starts)
        return F.when(at.isNull(), t).otherwise(X.let(F.substr(t, F.coalesce(at, F.lit(1))), upto))

    return X.let(X.norm_ws(F.coalesce(_c(c), F.lit(""))), cut)


def court_name(c: Column | str) -> Column:
    """the first line that starts with the word for court and isn't too long; NULL if there is none."""
    bare = lambda line: F.regexp_replace(F.regexp_replace(line, r"^[\s#>*\-•]+", ""), r"^[ :\-\t]+|[ :\-\t*]+$", "")
    lines = F.transform(X.lines_of(F.coalesce(_c(c), F.lit(""))), bare)
    return F.get(F.filter(lines, lambda x: X.compact(x).startswith(COURT) & (F.length(x) <= COURT_LENGTH)), F.lit(0))


def apply_line_edit(page: Column | str, line: Column, text: Column) -> Column:
    """Line number ``line`` (from 0) replaced, the space around it kept; a blank edit changes nothing."""
    new = X.trimmed(F.coalesce(text, F.lit("")))
    page = F.coalesce(_c(page), F.lit(""))

    def edited(x: Column, i: Column) -> Column:
        around = F.concat(F.regexp_extract(x, r"^(\s*)", 1), new, F.when(X.trimmed(x) == "", "").otherwise(F.regexp_extract(x, r"(\s*)$", 1)))
        return F.when(i == line, around).otherwise(x)

    return F.when(new == "", page).when(page == "", new).otherwise(F.array_join(F.transform(F.split(page, r"\r?\n"), edited), "\n"))
