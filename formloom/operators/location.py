"""Fuzzy address matching against the location hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import address as A
from formloom.functions import compare as C
from formloom.functions import fields as FL
from formloom.functions import text as X
from formloom.session import checkpointed

# fixed values: thresholds of the match
GOOD, NEAR_BEST, SURE, RESCUE, LEAD = 0.82, 0.02, 0.96, 0.70, 0.20
#: Distinct read places that are broadcast to their addresses; more are joined by shuffles.
SENT_PLACES = 100_000


def location_dim(provinces: DataFrame, districts: DataFrame, subdistricts: DataFrame) -> DataFrame:
    """One row per subdistrict with all three names; rows with a blank name are dropped."""
    filled = lambda c: F.coalesce(X.trimmed(c), F.lit("")) != ""
    rows = subdistricts.join(provinces, "province_code").join(districts.drop("province_code"), "district_code")
    return rows.filter(filled("province") & filled("district") & filled("subdistrict")).select(
        "province_code", "district_code", "province", "district", "subdistrict", "postal_code", "seq")


def _grams(name: Column) -> Column:
    """Bigrams of a name (the whole name if shorter).

    Names of a matching ratio of GOOD share one: if all matching blocks were
    single letters, m of them would leave m - 1 letters over, a ratio of at
    most 2m / (3m - 1), which is 0.8 for two and less for more.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(2))))


def _alike(left: DataFrame, right: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """Pairs of names (equal in ``on``) with a common bigram, once each, with their likeness."""
    x = left.withColumn("_g", F.explode(_grams(F.col(a))))
    y = right.withColumn("_g", F.explode(_grams(F.col(b))))
    pairs = x.join(y, [*on, "_g"]).drop("_g").distinct()
    return C.with_matching_ratio(pairs, a, b, "score")


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of likeness GOOD or more that are within NEAR_BEST of their group's best."""
    top = F.max("score").over(Window.partitionBy(*keys))
    return rows.filter(F.col("score") >= GOOD).withColumn("_top", top).filter(F.col("score") >= F.col("_top") - NEAR_BEST).drop("_top")


def best_location(addresses: DataFrame, dim: DataFrame) -> DataFrame:
    """The location of each read (province, district, subdistrict), or NULL, with scores and lead.

    Distinct names meet on shared bigrams, provinces first, then the districts
    of those provinces; the subdistricts of those districts are all scored. A
    best subdistrict below GOOD is still taken if province and district are
    SURE, it is at least RESCUE and leads the second by LEAD, and the pool has
    one postal code; it then counts as GOOD. ``addresses`` has ``p, d, s``.
    """
    return addresses.join(_located(addresses, dim), ["p", "d", "s"], "left")


def _located(addresses: DataFrame, dim: DataFrame) -> DataFrame:
    """What is found for each distinct place that was read.

    The places and the reference are asked for several times, so both are kept:
    the addresses are read and the reference is put together once.
    """
    places = checkpointed(dim.withColumns({"pk": A.location_key("province"), "dk": A.location_key("district"), "sk": A.location_key("subdistrict")}))
    asked = checkpointed(addresses.select("p", "d", "s").distinct())
    keyed = asked.withColumns({"ap": A.location_key("p"), "ad": A.location_key("d"), "as": A.location_key("s")}).distinct()
    names = keyed.select("ap").distinct().filter("ap <> ''")
    provinces = _best(_alike(names, places.select("pk").distinct(), "ap", "pk", []), ["ap"]).select("ap", "pk", F.col("score").alias("p_score"))
    wanted = keyed.select("ap", "ad").distinct().filter("ad <> ''").join(provinces, "ap")
    districts = _alike(wanted.select("pk", "ad").distinct(), places.select("pk", "dk").distinct(), "ad", "dk", ["pk"])
    districts = _best(wanted.join(districts, ["pk", "ad"]), ["ap", "ad"]).select("ap", "ad", "pk", "dk", "p_score", F.col("score").alias("d_score"))
    pool = C.with_matching_ratio(keyed.filter("as <> ''").join(districts, ["ap", "ad"]).join(places, ["pk", "dk"]), "as", "sk", "s_score")
    order = Window.partitionBy("p", "d", "s").orderBy(F.desc("s_score"), F.desc("d_score"), F.desc("p_score"), "seq")
    group = Window.partitionBy("p", "d", "s")
    codes = F.size(F.collect_set(F.nullif(F.coalesce("postal_code", F.lit("")), F.lit(""))).over(group))
    pool = pool.withColumns({"rank": F.row_number().over(order), "second": F.lead("s_score").over(order), "codes": codes}).filter("rank = 1")
    gap = F.col("s_score") - F.coalesce("second", F.lit(0.0))
    rescued = (F.col("p_score") >= SURE) & (F.col("d_score") >= SURE) & (F.col("s_score") >= RESCUE) & (gap >= LEAD) & (F.col("codes") == 1)
    found = (F.col("s_score") >= GOOD) | rescued
    s_score = F.when((F.col("s_score") < GOOD) & rescued, GOOD).otherwise(F.col("s_score"))
    picked = pool.select(
        "p", "d", "s", *[F.when(found, F.col(c)).alias(c) for c in ("province", "district", "subdistrict", "postal_code")],
        "p_score", "d_score", s_score.alias("s_score"), gap.alias("lead"), F.when(found, F.least("p_score", "d_score", s_score)).alias("confidence"))
    return F.broadcast(picked) if asked.count() <= SENT_PLACES else picked


#: Issues of an address, and what is done with each.
PARSE_FAILED, MISSING, NOT_FOUND, CORRECTED = (
    "address_location_parse_failed", "address_reference_missing", "address_location_not_found", "address_location_corrected")


def validate_address(addresses: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Key, issue, value, previous_value, postal_code, place names, confidence, action, review_status of every address that isn't blank.

    The place names are read (F26) and looked up (J03). An address whose places
    all have their reference names is verified; one that meets a place under
    other spellings gets the reference's names written where it had its own
    (F28), its text is kept as previous value and somebody looks at it; one
    that can't be read or meets no place is flagged. Without any reference
    nothing is said about an address but that.
    """
    rows = addresses.select(key, X.trimmed("address").alias("address")).filter("address <> ''")
    # a generated column, so that filters on the parts don't repeat the parsing below
    rows = rows.withColumn("_parsed", F.explode(F.array(A.parse_location("address"))))
    rows = rows.withColumns({"p": F.col("_parsed.province"), "d": F.col("_parsed.district"), "s": F.col("_parsed.subdistrict")}).drop("_parsed")
    if not dim.limit(1).count():
        issue = F.when(F.col("p").isNull(), PARSE_FAILED).otherwise(MISSING)
        none = F.lit(None).cast("string")
        names = [none.alias(c) for c in ("postal_code", "province", "district", "subdistrict")]
        action = F.when(F.col("p").isNull(), "flagged_location_reference")
        return rows.select(key, issue.alias("issue"), F.col("address").alias("value"), none.alias("previous_value"), *names, F.lit(None).cast("double").alias("confidence"),
                           action.alias("action"), F.when(F.col("p").isNull(), "needs_review").alias("review_status"))
    met = _located(rows.filter("p is not null"), dim)
    joined = rows.join(met, ["p", "d", "s"], "left").withColumn("found", F.col("subdistrict").isNotNull())
    same = lambda a, b: A.location_key(a) == A.location_key(b)
    joined = joined.withColumn("exact", F.col("found") & same("p", "province") & same("d", "district") & same("s", "subdistrict"))
    fixed = F.when(F.col("found") & ~F.col("exact"), A.replace_components("address", F.col("subdistrict"), F.col("district"), F.col("province")))
    joined = joined.withColumn("fixed", fixed)
    issue = F.when(F.col("p").isNull(), PARSE_FAILED).when(~F.col("found"), NOT_FOUND).when(~F.col("exact"), CORRECTED)
    action = F.when(F.col("exact"), "verified_location_reference").when(F.col("found"), "corrected_location_reference").otherwise("flagged_location_reference")
    return joined.select(
        key, issue.alias("issue"), F.coalesce("fixed", "address").alias("value"), F.when(F.col("fixed").isNotNull(), F.col("address")).alias("previous_value"),
        F.when(F.col("found"), F.col("postal_code")).alias("postal_code"), "province", "district", "subdistrict", F.when(F.col("found"), F.col("confidence")).alias("confidence"),
        action.alias("action"), F.when(~F.col("exact"), "needs_review").alias("review_status"),
    )


def repair_address_number(addresses: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Key, value, previous_value, source, review_status: addresses whose number the raw page text says in full.

    ``addresses(key, address, source)``, ``pages(key, text)``. Of the page's
    lines that are the same address with a fuller number (a range, a part after
    the stroke, more digits, another village number) the one with the longest
    number counts, the first of equals. Other addresses stay as they are.
    """
    asked = addresses.groupBy(key, "address").agg(F.collect_list(F.struct("source")).alias("_sources"))
    # whole pages meet their addresses, by merging: lines are many more than the size of their page says, none of them is sent around
    met = asked.join(pages.select(key, "text").hint("merge"), key, "left")
    # a line whose cleaned text may start with a number does so itself, or has markup or a label that cleaning takes away
    may = "|".join((rf"^[\s#:.\-{X.SPACES}]*[0-9๐-๙]", "[<&]", *K.FIELD_LABEL_NOISE["address"]))
    numbered = F.filter(X.lines_of("text"), lambda x: x.rlike(may))
    met = A.with_numbers(met, "address", "_now_").withColumn("_lines", numbered).drop("text")
    lines = met.select("*", F.posexplode_outer("_lines").alias("at", "_line")).drop("_lines")
    lines = lines.withColumn("_line", X.norm_ws(F.regexp_replace("_line", r"^\s*#+\s*", ""))).withColumn("_field", F.lit("address"))
    said = A.with_numbers(FL.with_clean(lines, "_field", "_line", "said"), "said", "_said_", numbered_only=True)
    rank = F.when(F.col("_said_house").isNotNull(), F.when(A.fuller_number("_now_", "_said_"), F.struct(F.length("_said_house"), -F.col("at"))))
    # generated, because max_by would work it out several times a row
    ranked = said.withColumn("_rank", F.explode(F.array(rank)))
    best = ranked.groupBy(key, "address").agg(F.max_by("said", "_rank").alias("best"), F.first("_sources").alias("_sources"))
    rows = best.select(key, "address", "best", F.explode("_sources").alias("_s")).select(key, "address", "best", "_s.source")
    found = F.col("best").isNotNull()
    return rows.select(
        key, F.coalesce("best", "address").alias("value"), F.when(found, F.col("address")).alias("previous_value"),
        F.when(found, "raw_ocr_address_line").otherwise(F.col("source")).alias("source"), F.when(found, "needs_review").alias("review_status"),
    )
