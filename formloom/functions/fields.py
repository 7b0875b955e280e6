"""Form field rules as expressions: validity, cleaning, fallbacks, candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import text as X
from formloom.functions import thai as T
from formloom.functions.text import _c

Pairs = Sequence[tuple[str, str]]
#: Between the kind of a field and its value where both are matched at once.
SPLIT = "\u0001"


def usable_value(v: Column) -> Column:
    """Rules that hold for every field: not a placeholder, no markup, no locality note."""
    return (
        (v != "") & ~v.isin(*K.EMPTY_MARKS) & ~X.has_markup(v)
        & ~X.contains_any(v, ("ท้องถิ่น", "เขตหนองจอก"))
    )


def _any(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _any_case(word: str) -> str:
    """A word of ASCII letters in either case, without a flag that slows the whole pattern down."""
    return "".join(f"[{ch.lower()}{ch.upper()}]" for ch in word)


#: What a value must be like, by kind of field; its white space is normal, so that a space is all of it.
PATTERNS = {
    "id": K.PERSON_ID,
    "house": K.HOUSE_CODE,
    "postal": K.D + "{5}",
    "gender": _any(K.GENDERS),
    "nationality": _any(K.NATIONALITIES),
    "age": rf"(?=.{{1,3}}$)[0๐]*(?:{K.D}{{1,2}}|[1๑][0-2๐-๒]{K.D}|[1๑][3๓][0๐])",
    "status": _any(K.HOUSE_STATUSES),
    "date": rf"{K.D}{{1,2}} [^ ]+ {K.D}{{4}}",
    # Thai letters, no digits, no table tags, no forbidden word by itself, no place, no month
    "name": rf"(?=.*[฀-๿])(?!.*(?:\p{{Nd}}|{'|'.join(map(_any_case, K.NAME_FORBIDDEN_PARTS))}|{'|'.join(K.NAME_FORBIDDEN_PLACES)}|{'|'.join(K.MONTHS)}))"
            rf"(?!(?:.* )?(?:{_any(K.NAME_FORBIDDEN_VALUES)}(?: |$)|ต\.|อ\.|จ\.)).{{1,80}}",
    "free": ".*",
}
KINDS = {
    **dict.fromkeys(K.ID_FIELDS, "id"), "houseCode": "house", "postalCode": "postal", "gender": "gender", "age": "age", "status": "status",
    **dict.fromkeys(K.NATIONALITY_FIELDS, "nationality"), **dict.fromkeys(K.DATE_FIELDS, "date"), **dict.fromkeys(K.NAME_FIELDS, "name"),
}


def _check_digit_right(v: Column) -> Column:
    """Of a value in the shape of an identifier, whose hyphens are dropped with the change to ASCII digits."""
    return T.check_digit_ok(F.translate(v, K.THAI_DIGITS + "-", K.ASCII_DIGITS))


def field_rule(key: str, v: Column) -> Column:
    """What F21 asks of one field, of a value whose white space is normal."""
    kind = KINDS.get(key, "free")
    shaped = v.rlike(f"(?s)^(?:{PATTERNS[kind]})$")
    return shaped & _check_digit_right(v) if kind == "id" else shaped


def valid_value(key: str, value: Column | str) -> Column:
    """F21 for one known field."""
    v = X.norm_ws(value)
    return F.coalesce(usable_value(v) & field_rule(key, v), F.lit(False))


def with_valid(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """F21 over the long table as column ``name``.

    The kind of the field stands before the value and one pattern knows all
    kinds, so that the generated code stays small enough to be compiled.
    """
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col(key)), F.lit("free"))
    shapes = "|".join(f"{k}{SPLIT}(?:{p})" for k, p in PATTERNS.items())
    v = F.col("__v")
    rows = df.withColumn("__v", X.norm_ws(value)).withColumn("__kind", kind)
    shaped = F.concat("__kind", F.lit(SPLIT), "__v").rlike(f"(?s)^(?:{shapes})$")
    checked = F.when(F.col("__kind") == "id", _check_digit_right(v)).otherwise(True)
    # looked at in turn, so that what was refused costs no further step
    rows = rows.withColumn("__ok", usable_value(v)).withColumn("__ok", F.when(F.col("__ok"), shaped))
    return rows.withColumn(name, F.coalesce(F.when(F.col("__ok"), checked), F.lit(False))).drop("__v", "__kind", "__ok")


def keep(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose ``flag`` is true. Unlike a filter this isn't pushed below the steps that made the flag, which would repeat them."""
    return df.withColumn("__keep", F.explode(F.when(F.col(flag), F.array(F.lit(True))))).drop("__keep", flag)


def repair_remark(c: Column | str) -> Column:
    """cut at markers, drop codes and role words, canonical domicile sentence."""
    v = X.norm_ws(c)
    for m in K.REMARK_CUT_MARKERS:
        v = F.trim(F.substring_index(v, m, 1))
    code = rf"{T.WORD_LEFT}{K.D}{{4}}[-+ ]{K.D}{{6}}[-+ ]{K.D}{T.WORD_RIGHT}"
    role = rf"{T.WORD_LEFT}(?:{'|'.join(K.NAME_FORBIDDEN_VALUES)}){T.WORD_RIGHT}"
    v = F.regexp_replace(F.regexp_replace(v, code, " "), role, " ")
    tidy = F.regexp_replace(F.regexp_replace(v, X.SPACE, " "), r"^[ :.\-]+|[ :.\-]+$", "")
    return F.when(v.contains("บุคคล") & v.contains("ภูมิ"), K.DOMICILE_REMARK).otherwise(tidy)


def apply_pairs(value: Column, pairs: Pairs | Column) -> Column:
    """Ordered token replacement; a Column of (source, replacement) works too."""
    if isinstance(pairs, Column):
        return F.aggregate(
            pairs, value, lambda v, p: F.replace(v, p["source"], p["replacement"])
        )
    for source, replacement in pairs:
        value = F.replace(value, F.lit(source), F.lit(replacement))
    return value


STRAY = r"^[ :.\-]+|[ :.\-]+$"
#: The characters that STRAY takes from both ends.
STRAY_CHARS = " :.-"


def _trim_marks(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, X.SPACE, " "), STRAY, "")


def _unmarked(value: Column | str) -> Column:
    return F.regexp_replace(X.strip_markup(value), r"(?U)^#+\s*", "")


def repair_kind(key: str, v: Column, names: Pairs | Column = (), places: Pairs = ()) -> Column:
    """Last step of F22 for one kind of field."""
    if key in K.NAME_FIELDS:
        return apply_pairs(apply_pairs(X.norm_ws(v), K.NAME_GLYPH_REPAIRS), names)
    if key == "address":
        return F.regexp_replace(apply_pairs(X.norm_ws(v), places), rf"(?U)({K.D})\s*-\s*({K.D})", "$1-$2")
    if key in K.DATE_FIELDS:
        return apply_pairs(X.norm_ws(v), K.DATE_TOKEN_CORRECTIONS)
    if key in K.ID_FIELDS or key == "houseCode":
        return F.regexp_replace(v, r"(?U)\s*[-+]\s*", "-")
    if key == "postalCode":
        return T.digits(v)
    if key == "remark":
        return repair_remark(v)
    return v


def clean_value(key: str, value: Column | str, names: Pairs | Column = (), places: Pairs = ()) -> Column:
    """F22 for one known field: markup, labels, trims, then repairs by kind."""
    v = X.replace_all(_unmarked(value), K.FIELD_LABEL_NOISE.get(key, ()), " ")
    return repair_kind(key, _trim_marks(v), names, places)


def with_clean(df: DataFrame, key: str, value: str, name: str, names: Pairs | Column = (), places: Pairs = ()) -> DataFrame:
    """F22 over the long table as column ``name``, in steps that each read the one before as a column.

    Together their generated code has to stay small enough to be compiled, so a
    value is looked at for what a step would change, and rare steps are lambdas.
    """
    k, v, words = F.col(key), F.col("__v"), F.col("__words")
    noise = F.create_map(*[x for f, w in K.FIELD_LABEL_NOISE.items() for x in (F.lit(f), F.array(*map(F.lit, w)))])
    steps = df.withColumn("__v", X.strip_any_markup(value)).withColumn("__words", F.try_element_at(noise, k))
    steps = steps.withColumn("__v", F.when(v.startswith("#"), F.regexp_replace(v, "^#+ ?", "")).otherwise(v))
    noisy = F.lit(False)
    for i in range(max(map(len, K.FIELD_LABEL_NOISE.values()))):
        noisy = noisy | v.contains(F.get(words, F.lit(i)))
    # a pattern that changes from row to row is compiled anew for each, so the words are looked for first
    bare = F.when(noisy, F.regexp_replace(F.regexp_replace(v, F.array_join(words, "|"), F.lit(" ")), X.SPACE, " ")).otherwise(v)
    steps = steps.withColumn("__v", F.btrim(bare, F.lit(STRAY_CHARS))).drop("__words")
    # white space is normal by now
    uneven = k.isin(*K.ID_FIELDS, "houseCode") & (v.contains(" ") | v.contains("+"))
    repaired = (
        F.when(k.isin(*K.NAME_FIELDS), apply_pairs(apply_pairs(v, K.NAME_GLYPH_REPAIRS), names))
        .when(k.isin(*K.DATE_FIELDS), apply_pairs(v, K.DATE_TOKEN_CORRECTIONS)).when(uneven, F.regexp_replace(v, " ?[-+] ?", "-"))
        .when(k == "address", X.let(v, lambda x: repair_kind("address", x, places=places)))
        .when(k == "postalCode", X.let(v, T.digits)).when(k == "remark", X.let(v, repair_remark)).otherwise(v)
    )
    steps = steps.withColumn("__v", repaired)
    return steps.withColumnRenamed("__v", name) if name not in df.columns else steps.withColumn(name, F.col("__v")).drop("__v")


def cut_at_markers(c: Column, markers: Sequence[str]) -> Column:
    for m in markers:
        c = F.substring_index(c, m, 1)
    return F.trim(c)


FULL_ADDRESS = (
    rf"(?U)((?:{K.HOUSE_NUMBER})\s+(?=หมู่|ซอย|ถนน|แขวง|ต\.|ตำบล).{{4,180}}?(?:กรุงเทพมหานคร|จ\.\s*\S+|จังหวัด\s*\S+))"
)
PART_ADDRESS = rf"(?U)((?:{K.HOUSE_NUMBER}\s+)?(?:ซอย|ถนน|แขวง|ตำบล|เขต|อำเภอ|จังหวัด|กรุงเทพ)[^#\n]{{8,160}})"


def fallback_value(key: str, text: Column | str) -> Column:
    """value found by pattern when no better source has one."""
    t = _c(text)
    if key == "houseCode":
        return T.extract_house_code(t)
    if key == "birthDate":
        return T.first_thai_date(t)
    if key == "age":
        return X.blank_to_null(F.regexp_extract(t, rf"(?U){K.D}{{4}}\s+({K.D}{{1,3}}){T.WORD_RIGHT}", 1))
    if key == "address":
        full, part = F.regexp_extract(t, FULL_ADDRESS, 1), F.regexp_extract(t, PART_ADDRESS, 1)
        best = F.when(full != "", full).when(part != "", part)
        return cut_at_markers(best, K.ADDRESS_CUT_MARKERS)
    if key == "remark":
        date = rf"(?U){T.WORD_LEFT}{K.D}{{1,2}}\s+\S+\s+{K.D}{{4}}{T.WORD_RIGHT}"

        def after(marker: str) -> Column:
            at = F.instr(t, F.lit(marker))
            piece = F.trim(F.substring(t, at, F.lit(140)))
            return F.when(at > 0, F.trim(F.regexp_replace(piece, rf"(?s){date}.*$", "")))

        domicile = F.when(t.contains("ภูมิลำ") & t.contains("บ้า"), K.DOMICILE_REMARK)
        return F.coalesce(*[after(m) for m in K.REMARK_START_MARKERS], domicile)
    return F.lit(None).cast("string")


# --- candidates in crop text ---------------------------------------------------------


def _valid_list(raw: Column, key: str, shape) -> Column:
    values = F.transform(raw, lambda r: clean_value(key, shape(r)))
    return F.array_distinct(F.filter(values, lambda v: valid_value(key, v)))


def id_candidates(text: Column | str) -> Column:
    """formatted and loose 13-digit runs that are valid ids, first order kept."""
    t = _c(text)
    exact = F.regexp_extract_all(t, F.lit(K.PERSON_ID), F.lit(0))
    loose = F.regexp_extract_all(t, F.lit(rf"(?U){K.D}[0-9๐-๙\-\s.]{{11,24}}{K.D}"), F.lit(0))
    loose = F.filter(loose, lambda r: F.length(T.digits(r)) == 13)
    raw = F.filter(F.concat(exact, loose), lambda r: ~T.suspicious_id(r))
    return _valid_list(raw, "personId", T.format_id)


def house_candidates(text: Column | str) -> Column:
    """house codes in separated or loose form."""
    t = _c(text)
    exact = F.regexp_extract_all(t, F.lit(rf"(?U){K.D}{{4}}[-+\s.]{K.D}{{6}}[-+\s.]{K.D}"), F.lit(0))
    loose = F.regexp_extract_all(t, F.lit(rf"(?U){K.D}[0-9๐-๙\-\s.]{{9,18}}{K.D}"), F.lit(0))
    loose = F.filter(loose, lambda r: F.length(T.digits(r)) == 11)
    return _valid_list(F.concat(exact, loose), "houseCode", T.format_house_code)


def age_candidates(text: Column | str) -> Column:
    """stand-alone numbers of at most three digits that can be an age."""
    t = T.ascii_digits(F.regexp_replace(_c(text), "<[^>]+>", " "))
    runs = F.regexp_extract_all(t, F.lit(r"(?<!\d)([0-9]{1,3})(?!\d)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda v: v.cast("int") <= 130))


# --- boxes ---------------------------------------------------------------------------------


def bbox_ok(b: Column) -> Column:
    """four numbers with right > left and bottom > top."""
    g = [F.get(b, F.lit(i)) for i in range(4)]
    return F.coalesce((F.size(b) == 4) & (g[2] > g[0]) & (g[3] > g[1]), F.lit(False))


def expand(b: Column, pad: Column | float) -> Column:
    """padded box inside the page."""
    g = [F.get(b, F.lit(i)) for i in range(4)]
    return F.array(
        F.greatest(F.lit(0.0), g[0] - pad), F.greatest(F.lit(0.0), g[1] - pad),
        F.least(F.lit(1.0), g[2] + pad), F.least(F.lit(1.0), g[3] + pad),
    )


def overlap_ratio(a: Column, b: Column) -> Column:
    """shared area over the area of ``a``."""
    x, y = ([F.get(s, F.lit(i)) for i in range(4)] for s in (a, b))
    w = F.least(x[2], y[2]) - F.greatest(x[0], y[0])
    h = F.least(x[3], y[3]) - F.greatest(x[1], y[1])
    area = F.greatest((x[2] - x[0]) * (x[3] - x[1]), F.lit(0.000001))
    return F.when((w > 0) & (h > 0), w * h / area).otherwise(0.0)


def bbox_1000(b: Column) -> Column:
    """a box given in thousandths, clipped and scaled to 0..1; NULL when empty."""
    g = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(b, F.lit(i)) / 1000.0)) for i in range(4)]
    return F.when((F.size(b) == 4) & (g[2] > g[0]) & (g[3] > g[1]), F.array(*g))


def center_inside(a: Column, b: Column) -> Column:
    x, y = ([F.get(s, F.lit(i)) for i in range(4)] for s in (a, b))
    return ((x[0] + x[2]) / 2).between(y[0], y[2]) & ((x[1] + x[3]) / 2).between(y[1], y[3])
