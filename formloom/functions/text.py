"""Text expressions: Column in, Column out; ``let`` and lambdas run interpreted, the rest inside whole-stage codegen."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom import constants as K

#: Unicode's white space, written out: Java asks a method about each character where ``(?U)\s`` stands.
_BLANKS = r"\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
_ODD = r"\t-\r\u0085\u2028\u2029" + _BLANKS
SPACE = f"[ {_ODD}]+"
#: White space that isn't one space already.
UNEVEN = f"[{_ODD}][ {_ODD}]*| [ {_ODD}]+"
#: The same of white space that ends no line.
UNEVEN_IN_LINES = f"[{_BLANKS}][ {_BLANKS}]*| [ {_BLANKS}]+"
#: The characters that SPACE knows.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst inlines Column objects wherever they are mentioned; binding the
    value to a lambda variable keeps the generated code small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column | str) -> Column:
    """NULL for text that is empty after trimming; other text is kept as is."""
    c = _c(c)
    return F.when(F.regexp_replace(c, SPACE, "") != "", c)


def trimmed(c: Column | str) -> Column:
    # by characters: a pattern would be tried from each character of the text
    return F.btrim(_c(c), F.lit(SPACES))


def norm_ws(c: Column | str) -> Column:
    """every whitespace run becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(c), UNEVEN, " "))


def compact(c: Column | str) -> Column:
    """whitespace removed, case kept."""
    return F.regexp_replace(_c(c), SPACE, "")


def compact_lower(c: Column | str) -> Column:
    """whitespace removed and lowered, for text comparison."""
    return F.lower(compact(c))


def compact_length(c: Column | str) -> Column:
    """compact length with a floor of one."""
    return F.greatest(F.length(compact(c)), F.lit(1))


def lines_of(c: Column | str) -> Column:
    """Text split at line ends; a final line end opens no extra line."""
    return F.split(F.regexp_replace(_c(c), r"\R\z", ""), r"\R")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def replace_all(c: Column, words: Sequence[str], by: str) -> Column:
    """Ordered literal replacement; later words see earlier output."""
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(by))
    return c


def spaced_pattern(keyword: str) -> str:
    """Regex for a keyword with any whitespace between its characters."""
    import re

    return r"(?U)\s*".join(re.escape(ch) for ch in keyword if not ch.isspace())


# --- page text ----------------------------------------------------------------


THAI_BLOCK = "".join(map(chr, range(0x0E00, 0x0E80)))
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))


def looks_garbled(c: Column | str) -> Column:
    """F14 test: Thai text whose UTF-8 bytes were read as Thai code page 874."""

    def test(x: Column) -> Column:
        size = F.length(x)
        among = lambda chars: size - F.length(F.translate(x, chars, ""))
        count = lambda word: (size - F.length(F.replace(x, F.lit(word), F.lit("")))) / len(word)
        marks = count("\u0e40\u0e18") + count("\u0e40\u0e19") + count("\u0e42") + count("\u20ac")
        return (size > 0) & (marks >= 2) & (among(THAI_BLOCK) >= 4) & ((marks + among(CONTROLS)) / size >= 0.08)

    # a text with none of these characters has no mark
    c = _c(c)
    marked = c.contains("\u0e40") | c.contains("\u0e42") | c.contains("\u20ac")
    return F.coalesce(F.when(marked, let(compact(c), test)), F.lit(False))


def repair_garbled(c: Column | str) -> Column:
    """undo UTF-8 read as code page 874 where the outcome reads better; only texts that look garbled are decoded."""
    c = _c(c)

    def decoded(narrow: Column) -> Column:
        # encode() refuses characters outside Latin-1: such text is left alone
        text = F.when(~narrow.rlike(r"[^\u0000-\u00FF]"), F.encode(narrow, "ISO-8859-1").cast("string"))
        return let(text, lambda t: F.when(F.is_valid_utf8(t) & (t != "") & ~looks_garbled(t), trimmed(t)))

    return F.coalesce(F.when(looks_garbled(c), let(F.translate(c, K.CP874_CHARS, K.CP874_AS_LATIN1), decoded)), c)


def has_markup(c: Column | str) -> Column:
    """table tags, plain or entity-encoded, or stray tag ends."""
    c = _c(c)
    # without one of these no part of the pattern fits, and looking for them is cheap
    return F.when(c.contains("<") | c.contains("&") | c.contains("/>"), c.rlike(
        r"(?i)(<\s*/?\s*(table|tbody|tr|td|th)\b|&lt;\s*/?\s*(table|tbody|tr|td|th)\b|</|/>)"
    )).when(c.isNotNull(), False)


@lru_cache(maxsize=1)
def _entity_maps() -> tuple[str, str]:
    """HTML's named characters as JSON objects: those that end in a semicolon, and the old ones that need none."""
    named = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return json.dumps(named), json.dumps({k: v for k, v in html5.items() if not k.endswith(";")})


def _code_point(n: Column) -> Column:
    fine = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(fine, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def unescape_entities(c: Column | str) -> Column:
    """Character references decoded once: numeric ones by code point, named ones by HTML's table; others stay."""
    named, old = (F.from_json(F.lit(m), "map<string,string>") for m in _entity_maps())
    shape = r"^(?:#(\d{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*))(;?)"

    def decoded(piece: Column) -> Column:
        found = F.struct(*[F.regexp_extract(piece, shape, i).alias(n) for i, n in ((1, "d"), (2, "x"), (3, "n"), (4, "e"), (0, "all"))])

        def value(r: Column) -> Column:
            char = (
                F.when(r["d"] != "", _code_point(r["d"].cast("long")))
                .when(r["x"] != "", _code_point(F.conv(r["x"], 16, 10).cast("long")))
                .when(r["n"] == "amp", F.lit("&"))
                .when((r["n"] != "") & (r["e"] == ";"), F.try_element_at(named, r["n"]))
                .when(r["n"] != "", F.try_element_at(old, r["n"]))
            )
            return F.coalesce(F.concat(char, F.substr(piece, F.length(r["all"]) + 1)), F.concat(F.lit("&"), piece))

        return let(found, value)

    pieces = F.split(_c(c), "&")
    whole = let(pieces, lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, 2, F.size(p)), decoded), "")))
    return F.when(_c(c).contains("&"), whole).otherwise(_c(c))


def _untagged(c: Column | str) -> Column:
    """Entities decoded, table tags blanked."""
    return F.regexp_replace(unescape_entities(c), r"(?i)<\s*/?\s*(table|tbody|tr|td|th)[^>]*>", " ")


def strip_markup(c: Column | str) -> Column:
    """entities decoded, table tags blanked, whitespace normalised."""
    return norm_ws(_untagged(c))


def strip_any_markup(column: str) -> Column:
    """F15 of a column whose values mostly have none: a value without a tag or an entity isn't looked at for them."""
    c = F.col(column)
    return norm_ws(F.when(c.contains("<") | c.contains("&"), let(c, _untagged)).otherwise(c))


def strip_label_noise(c: Column | str) -> Column:
    """F16: form labels and column names blanked, in list order."""
    c = replace_all(_c(c), K.LABEL_NOISE, " ")
    return norm_ws(F.regexp_replace(c, r"\([^)]*ท้องถิ่น[^)]*\)", " "))


def drop_figures(c: Column | str) -> Column:
    c = _c(c)
    cut = F.regexp_replace(c, r"(?is)\n?(?U:\s*)<figure>.*?</figure>(?U:\s*)\n?", "\n")
    return trimmed(F.when(F.lower(c).contains("<figure>"), cut).otherwise(c))


def unwrap_fence(c: Column | str) -> Column:
    """The inside of a fenced block of at least two lines."""
    body = trimmed(c)
    inner = F.regexp_extract(body, r"(?s)\A```[^\n]*\n(.*)\z", 1)
    # not by a pattern, which would try the whole line again from each of its characters
    last = F.substring_index(inner, "\n", -1)
    return F.when(
        body.startswith("```") & body.endswith("```") & body.contains("\n"),
        trimmed(F.left(inner, F.length(inner) - F.length(last) - 1)),
    ).otherwise(body)


def unwrap_response(c: Column | str) -> Column:
    """the text inside a fence and/or a JSON object, figures removed.

    A broken object falls back to the text behind the first known key. An
    object whose known keys hold nothing but white space is empty text.
    """
    raw, keys = _c(c), K.RESPONSE_KEYS

    def unescaped(t: Column) -> Column:
        # backslashes that stand for one are taken out first: what follows them is no escape
        def plain(x: Column) -> Column:
            for escaped, by in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t"), ('\\"', '"')):
                x = F.replace(x, F.lit(escaped), F.lit(by))
            return x

        pieces = F.array_join(F.transform(F.split(t, r"\\\\"), plain), "\\")
        return F.when(t.contains("\\"), pieces).otherwise(t)

    def tail(body: Column, key: str) -> Column:
        rest = F.regexp_extract(body, rf'(?s)"{key}"[^:]*:(.*)\z', 1)
        rest = F.regexp_replace(F.regexp_replace(trimmed(rest), r"\}\z", ""), r"(?U)\s+\z", "")
        return trimmed(let(F.regexp_replace(rest, r'\A"|"\z', ""), unescaped))

    def filled(value: Column) -> Column:
        return let(value, lambda x: F.when(x.rlike(r"(?U)\S"), x))

    def pick(body: Column) -> Column:
        # one after the other, so that none is worked out behind the first with text
        json_like = body.startswith("{") | body.startswith("[")
        strict = [F.when(json_like, filled(F.get_json_object(body, f"$.{k}"))) for k in keys]
        loose = [F.when(body.contains(f'"{k}"'), filled(tail(body, k))) for k in keys]
        nothing = F.lit("")
        held = F.when(json_like & F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in keys]).isNotNull(), nothing)
        blank = F.when(json_like & body.rlike(rf'"(?:{"|".join(keys)})"[^:]*:'), nothing)
        return let(F.coalesce(*strict, held, *loose, blank, raw), lambda t: let(drop_figures(t), repair_garbled))

    return let(unwrap_fence(raw), lambda body: F.when(body == "", trimmed(raw)).otherwise(pick(body)))


#: Line ends other than the usual one.
ODD_LINE_ENDS = ("\r", "\x0b", "\f", "\x85", "\u2028", "\u2029")


def candidate_lines(c: Column | str) -> Column:
    """W12 as an array: usable lines, page marks, figure blocks and lone tags left out."""
    c = _c(c)
    open_text = F.when(c.contains("<"), F.regexp_replace(c, K.FIGURE_BLOCK, "")).otherwise(c)
    # blank lines are left out anyway, so a final line end needs no care
    lines = let(open_text, lambda t: F.when(contains_any(t, ODD_LINE_ENDS), F.split(t, r"\R")).otherwise(F.split(t, "\n")))
    return F.filter(
        F.transform(lines, trimmed),
        lambda x: (x != "") & ~x.startswith("## Page") & ~(x.startswith("</") & F.lower(x).startswith("</figure"))
        & ~(x.startswith("<") & x.endswith(">")),
    )


def repeats_one_line(lines: Column) -> Column:
    """A13 on an array of lines: one long line makes up much of the page.

    A line that stands there six times leaves five lines fewer that differ;
    only then are the lines sorted to find it.
    """
    most = 6

    def longest_run(usable: Column) -> Column:
        # the most frequent line is found on the sorted array by run length
        def step(a: Column, x: Column) -> Column:
            n = F.when(x == a["cur"], a["n"] + 1).otherwise(F.lit(1))
            return F.struct(x.alias("cur"), n.alias("n"), F.when(n > a["top"], x).otherwise(a["best"]).alias("best"), F.greatest(a["top"], n).alias("top"))

        start = F.struct(F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit("").alias("best"), F.lit(0).alias("top"))
        return F.aggregate(F.array_sort(usable), start, step)

    def judged(usable: Column) -> Column:
        stamped = lambda r: r["best"].contains(K.STAMP_PHRASE[0]) & r["best"].contains(K.STAMP_PHRASE[1])
        found = let(longest_run(usable), lambda r: (r["top"] >= most) & ((r["top"] / F.size(usable) >= 0.35) | stamped(r)))
        return F.when(F.size(usable) - F.size(F.array_distinct(usable)) >= most - 1, found).otherwise(False)

    def of(every: Column) -> Column:
        usable = F.filter(F.transform(every, compact_lower), lambda x: F.length(x) >= 8)
        return F.when(F.size(every) < most, False).when(every.isNotNull(), let(usable, judged))

    return let(lines, of)


def text_quality(text: Column | str, lines: Column | None = None, repeated: Column | None = None) -> Column:
    """size and structure score of one page reading."""
    text = _c(text)
    lines = candidate_lines(text) if lines is None else lines
    repeated = repeats_one_line(lines) if repeated is None else repeated
    n = F.size(lines).cast("double")
    short = F.size(F.filter(lines, lambda x: ~x.rlike(r"(?U)\S\s*+\S\s*+\S"))).cast("double")
    replaced = (F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))).cast("double")
    return (
        F.length(compact(text)).cast("double") + n * 42.0 - short * 12.0 - replaced * 80.0
        - F.when(repeated, 2800.0).otherwise(0.0)
        - F.when(looks_garbled(text), 3500.0).otherwise(0.0)
    )


def signal_count(text: Column | str, signals: Sequence[str]) -> Column:
    low = compact_lower(text)
    out = F.lit(0)
    for s in signals:
        out = out + low.contains("".join(s.split()).lower()).cast("int")
    return out


def describes_picture(text: Column | str) -> Column:
    return (signal_count(text, K.PICTURE_SIGNALS) >= 2) & (signal_count(text, K.LEGAL_SIGNALS) <= 1)


def needs_comparison(text: Column | str, lines: Column | None = None) -> Column:
    """a reading too poor to be taken without another candidate."""
    text = _c(text)
    lines = candidate_lines(text) if lines is None else lines
    size = compact_length(text)
    return (
        (trimmed(text) == "") | describes_picture(text) | looks_garbled(text) | repeats_one_line(lines)
        | (size < 120) | ((F.size(lines) <= 2) & (size < 350))
    )


# --- categories, names, small tests --------------------------------------------


def normalize_category(c: Column | str) -> Column:
    """lower snake form of a category, ``uncategorized`` when nothing is left."""
    low = F.replace(F.lower(trimmed(F.coalesce(_c(c), F.lit("")))), F.lit(" "), F.lit("_"))
    kept = F.regexp_replace(low, r"[^\p{L}\p{N}_\-]", "")
    kept = F.regexp_replace(kept, r"^[_\-]+|[_\-]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(K.DEFAULT_CATEGORY))


def is_form_category(c: Column | str) -> Column:
    return F.coalesce(F.lower(trimmed(_c(c))).isin(*K.FORM_CATEGORIES), F.lit(False))


def category_label(c: Column | str) -> Column:
    """display label of a category."""
    c = _c(c)
    words = F.filter(F.split(c, "[_-]+"), lambda w: w != "")
    label = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")
    return F.when(F.coalesce(c, F.lit("")) == "", "Uncategorized").otherwise(label)


def filename_timestamp(c: Column | str) -> Column:
    """leading ddMMyyyyHHmmss of a file name as a sortable number."""
    p = r"^(\d{2})(\d{2})(\d{4})(\d{2})(\d{2})(\d{2})"
    c = _c(c)
    parts = [F.regexp_extract(c, p, i) for i in (3, 2, 1, 4, 5, 6)]
    return F.concat(*parts).try_cast("bigint")


def safe_basename(c: Column | str) -> Column:
    """last path part, ``upload.pdf`` when there is none."""
    base = F.element_at(F.split(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "/+$", ""), "/"), -1)
    return F.when(base.isin("", "."), "upload.pdf").otherwise(base)


def punctuation_only(c: Column | str) -> Column:
    """no letter and no number once whitespace is gone."""
    return ~_c(c).rlike(r"[\p{L}\p{N}]")


def single_line(c: Column | str) -> Column:
    """fence, known prefixes and a quote pair removed, one line."""

    def without_prefixes(line: Column, prefixes: Sequence[str]) -> Column:
        if not prefixes:
            return unquoted(line)
        first, *rest = prefixes
        cut = F.when(line.startswith(first), trimmed(F.substr(line, F.lit(len(first) + 1)))).otherwise(line)
        return let(cut, lambda v: without_prefixes(v, rest))

    def unquoted(line: Column) -> Column:
        ends = F.left(line, F.lit(1))
        quoted = (F.length(line) >= 2) & (ends == F.right(line, F.lit(1))) & ends.isin('"', "'")
        return norm_ws(F.when(quoted, trimmed(F.substring(line, F.lit(2), F.length(line) - 2))).otherwise(line))

    return let(F.trim(F.regexp_replace(unwrap_fence(c), r"\R", " ")), lambda v: without_prefixes(v, K.LINE_PREFIXES))


def name_token_ok(c: Column | str) -> Column:
    """A token that may enter the corrections dictionary."""
    c = trimmed(c)
    return F.coalesce(
        F.length(c).between(2, 48) & ~c.rlike(r"\p{N}") & c.rlike(r"[\u0E00-\u0E7F]") & ~c.isin(*K.NOT_NAME_TOKENS),
        F.lit(False),
    )


def token_pairs(before: Column | str, after: Column | str) -> Column:
    """Array of (source, replacement) where equal-length token lists differ."""
    a, b = F.split(norm_ws(before), " "), F.split(norm_ws(after), " ")
    pairs = F.arrays_zip(a.alias("source"), b.alias("replacement"))
    keep = F.filter(
        F.transform(pairs, lambda p: F.struct(p["source"].alias("source"), p["replacement"].alias("replacement"))),
        lambda p: (p["source"] != p["replacement"]) & name_token_ok(p["source"]) & name_token_ok(p["replacement"]),
    )
    empty = F.array().cast("array<struct<source:string,replacement:string>>")
    return F.when(F.size(a) == F.size(b), keep).otherwise(empty)


def first_text(*columns: Column | str) -> Column:
    """The first column that is not blank, untrimmed."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))
