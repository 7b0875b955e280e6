"""Thai digits, identifiers, dates and ages as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions.text import _c, blank_to_null, compact, contains_any, let, norm_ws, trimmed

WORD_LEFT, WORD_RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
DATE = "(?U)" + K.THAI_DATE
DATE_FROM_DAY = DATE.replace(r"(?:วันที่\s*)?", "")
DATE_SHAPE = rf"(?U)^({K.D}{{1,2}})\s+(\S+)\s+({K.D}{{4}})$"


def ascii_digits(c: Column | str) -> Column:
    """Thai digits to ASCII digits."""
    return F.translate(_c(c), K.THAI_DIGITS, K.ASCII_DIGITS)


def thai_digits(c: Column | str) -> Column:
    """ASCII digits to Thai digits."""
    return F.translate(_c(c), K.ASCII_DIGITS, K.THAI_DIGITS)


def digits(c: Column | str) -> Column:
    """digits only, Thai digits folded first."""
    return F.regexp_replace(ascii_digits(c), "[^0-9]", "")


def reject_key(c: Column | str) -> Column:
    """digits when there are any, else the compact text."""
    return F.coalesce(F.nullif(digits(c), F.lit("")), compact(c))


def check_digit_ok(d: Column) -> Column:
    """Modulo-11 check digit of a 13-digit string; false for anything else."""
    place = F.sequence(F.lit(1), F.lit(12))
    total = F.aggregate(place, F.lit(0), lambda t, i: t + F.substr(d, i, F.lit(1)).try_cast("int") * (14 - i))
    last = F.substring(d, 13, 1).try_cast("int")
    return F.coalesce((F.length(d) == 13) & ((11 - total % 11) % 10 == last), F.lit(False))


def valid_citizen_id(c: Column | str) -> Column:
    """hyphenated shape and check digit."""
    c = norm_ws(c)
    return F.coalesce(c.rlike("^" + K.PERSON_ID + "$") & check_digit_ok(digits(c)), F.lit(False))


def suspicious_id(c: Column | str) -> Column:
    """13 digits with eight or more zeros or a run of five."""
    d = digits(c)
    zeros = F.length(d) - F.length(F.replace(d, F.lit("0"), F.lit("")))
    return F.coalesce((F.length(d) == 13) & ((zeros >= 8) | d.contains("00000")), F.lit(False))


def format_id(c: Column | str) -> Column:
    """13 digits as d-dddd-ddddd-dd-d, else unchanged."""
    d = digits(c)
    shaped = F.regexp_replace(d, r"^(\d)(\d{4})(\d{5})(\d{2})(\d)$", "$1-$2-$3-$4-$5")
    return F.when(F.length(d) == 13, shaped).otherwise(_c(c))


def format_house_code(c: Column | str) -> Column:
    """11 digits as dddd-dddddd-d, else unchanged."""
    d = digits(c)
    return F.when(F.length(d) == 11, F.regexp_replace(d, r"^(\d{4})(\d{6})(\d)$", "$1-$2-$3")).otherwise(_c(c))


def display_identifier(c: Column | str, kind: str) -> Column:
    """F07 as shown on screen: a lone dash stays, other input is grouped."""
    c = trimmed(c)
    shaped = format_id(c) if kind == "id" else format_house_code(c)
    return F.when(c == "-", c).otherwise(shaped)


def extract_house_code(c: Column | str) -> Column:
    """first 4-6-1 digit group joined by hyphen, plus or space."""
    p = rf"{WORD_LEFT}({K.D}{{4}})[-+ ]({K.D}{{6}})[-+ ]({K.D}){WORD_RIGHT}"
    parts = [F.regexp_extract(_c(c), p, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts))


def id_values(c: Column | str) -> Column:
    """Distinct formatted ids in reading order."""
    # the first digit is looked for before what stands left of it, which would be looked at from every character
    p = rf"(?={K.D}-){WORD_LEFT}{K.PERSON_ID}{WORD_RIGHT}"
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(p), F.lit(0)))


def plain_date(match: Column) -> Column:
    return F.regexp_replace(match, DATE, "$1 $2 $3")


def thai_dates(c: Column | str) -> Column:
    """All dates as ``d month yyyy``, repeats dropped, order kept."""
    # from the day on, because the word that may stand before it changes no match and would be looked for from every character
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(DATE_FROM_DAY), F.lit(0)), plain_date))


def first_thai_date(c: Column | str) -> Column:
    """first date as ``d month yyyy`` or NULL."""
    c = _c(c)
    return F.when(c.rlike(DATE), F.concat_ws(" ", *[F.regexp_extract(c, DATE, i) for i in (1, 2, 3)]))


def month_number(name: Column) -> Column:
    return F.coalesce(*[F.when(name == m, i) for i, m in enumerate(K.MONTHS, 1)])


def date_parts(c: Column | str) -> Column:
    """Day, month and year as written, NULL unless the whole text is a date."""
    c = trimmed(c)
    day, year = (ascii_digits(F.regexp_extract(c, DATE_SHAPE, i)).try_cast("int") for i in (1, 3))
    month = month_number(F.regexp_extract(c, DATE_SHAPE, 2))
    return F.when(
        day.isNotNull() & month.isNotNull() & year.isNotNull(),
        F.struct(day.alias("d"), month.alias("m"), year.alias("y")),
    )


def _date_tokens(c: Column) -> Column:
    return F.split(norm_ws(c), " ")


def parse_thai_date(c: Column | str) -> Column:
    """Buddhist-era text date to DATE; NULL when blank or refused."""
    t = _date_tokens(F.coalesce(_c(c), F.lit("")))
    day, year = (ascii_digits(F.get(t, F.lit(i))).try_cast("int") for i in (0, 2))
    month = month_number(F.get(t, F.lit(1)))
    ce = F.when(year > 2400, year - 543).otherwise(year)
    stamp = F.try_make_timestamp(ce, month, day, F.lit(0), F.lit(0), F.lit(0))
    return F.when(F.size(t) == 3, stamp.cast("date"))


def date_reject(c: Column | str) -> Column:
    """why a non-blank date text was refused."""
    c = F.coalesce(_c(c), F.lit(""))
    t = _date_tokens(c)
    return (
        F.when(c == "", F.lit(None).cast("string"))
        .when(F.size(t) != 3, "not three parts")
        .when(month_number(F.get(t, F.lit(1))).isNull(), "unknown month")
        .when(parse_thai_date(c).isNull(), "no such date")
    )


def age_at(birth: Column | str, ref: Column | str) -> Column:
    """whole years between two text dates, NULL outside 0..130."""
    b, r = date_parts(birth), date_parts(ref)
    before = (r["m"] < b["m"]) | ((r["m"] == b["m"]) & (r["d"] < b["d"]))
    age = r["y"] - b["y"] - F.when(before, 1).otherwise(0)
    return F.when(age.between(0, 130), age)


NEGATED_DEATH = r"(?:ไม่|ไม่ได้|มิได้).{0,12}(?:ตาย|เสียชีวิต)"


def deceased_date(c: Column | str) -> Column:
    """date within 140 characters from a death keyword, unless negated."""

    def after(c: Column, word: str) -> Column:
        near = let(F.substring(c, F.instr(c, F.lit(word)), F.lit(140)), first_thai_date)
        return F.when(c.contains(word), near)

    def found(c: Column) -> Column:
        return F.when(contains_any(c, K.DECEASED_KEYWORDS), F.when(~c.rlike(NEGATED_DEATH), F.coalesce(*[after(c, w) for w in K.DECEASED_KEYWORDS])))

    # white space is made normal once, and only where a keyword may be
    text = _c(c)
    return F.when(contains_any(text, K.DECEASED_KEYWORDS), let(norm_ws(text), found))


def deceased_remark(c: Column | str) -> Column:
    """F13, export form: keyword and a date shape at most 80 characters apart."""
    c = F.coalesce(_c(c), F.lit(""))
    hit = c.rlike(rf"(?U)(?:ตาย|เสียชีวิต).{{0,80}}{K.D}{{1,2}}\s+\S+\s+{K.D}{{4}}")
    return ~c.rlike(NEGATED_DEATH) & hit


def infer_gender(name: Column | str) -> Column:
    """gender from the title in front of a Thai name."""
    n = _c(name)

    def starts(words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [n.startswith(w) for w in words])

    return F.when(starts(K.MALE_TITLES), K.GENDERS[0]).when(starts(K.FEMALE_TITLES), K.GENDERS[1])


def number_token(c: Column | str) -> Column:
    """misread letters to digits, then everything in Thai digits."""
    return thai_digits(F.translate(compact(c), "ดIlOo", "๑1100"))


# --- dates in running text (client display rules) --------------------------------


def _tidy_date(c: Column) -> Column:
    c = norm_ws(c)
    for p, r in ((r"(?U)^ฟ้องวันที่\s*", ""), (r"(?U)^วันที่\s*", ""), (r"(?U)\s*เป็นต้นไป$", ""), (r"[()]", " ")):
        c = F.regexp_replace(c, p, r)
    return norm_ws(c)


LOOSE_DATE = rf"(?U)({K.D}{{1,2}})\s*([^\d๐-๙\s]+)\s*({K.D}{{4}})"


def _shifted(tidy: Column, days: int) -> Column:
    def parts(t: Column) -> Column:
        day, year = (ascii_digits(F.regexp_extract(t, LOOSE_DATE, i)).try_cast("int") for i in (1, 3))
        month = month_number(F.regexp_replace(F.lower(F.regexp_extract(t, LOOSE_DATE, 2)), r"\.+$", ""))
        return F.struct(
            day.alias("d"), month.alias("m"), year.alias("y"), F.when(year >= 2400, 543).otherwise(0).alias("era"),
            F.regexp_extract(t, LOOSE_DATE, 0).rlike("[๐-๙]").alias("thai"),
        )

    def moved(p: Column) -> Column:
        # a day past the month end rolls over, as calendar arithmetic on day numbers does
        first = F.try_make_timestamp(p["y"] - p["era"], p["m"], F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return F.struct(F.date_add(first, p["d"] - 1 + F.lit(days)).alias("on"), p["era"].alias("era"), p["thai"].alias("thai"))

    def text(q: Column) -> Column:
        name = F.get(F.array(*[F.lit(m) for m in K.MONTHS]), F.month(q["on"]) - 1)
        plain = F.concat_ws(" ", F.dayofmonth(q["on"]).cast("string"), name, (F.year(q["on"]) + q["era"]).cast("string"))
        styled = F.when(q["thai"], thai_digits(plain)).otherwise(plain)
        return F.when(q["on"].isNotNull(), styled)

    return let(parts(tidy), lambda p: let(moved(p), text))


def shift_thai_date(c: Column | str, days: int) -> Column:
    """move a text date, keeping era and digit style; NULL when unreadable."""
    return let(_tidy_date(_c(c)), lambda t: _shifted(t, days))


def thai_date_display(c: Column | str) -> Column:
    """canonical text of a date, or the tidied input."""
    return let(_tidy_date(_c(c)), lambda t: F.coalesce(_shifted(t, 0), t))


def filing_start_date(c: Column | str) -> Column:
    """date interest starts; "from the day after filing" wording adds a day."""

    def first(text: Column, patterns: tuple[str, ...]) -> Column:
        return F.coalesce(*[blank_to_null(F.regexp_extract(text, "(?U)" + p, 1)) for p in patterns])

    def read(text: Column) -> Column:
        found = F.struct(first(text, K.NEXT_DAY_PATTERNS).alias("next"), first(text, K.SAME_DAY_PATTERNS).alias("same"))
        return let(found, lambda f: F.when(
            f["next"].isNotNull(), F.coalesce(shift_thai_date(f["next"], 1), thai_date_display(f["next"]))
        ).when(f["same"].isNotNull(), thai_date_display(f["same"])))

    return let(_c(c), read)
