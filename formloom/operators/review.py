"""Review fields in long form: validation issues, quality labels, alternatives, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import compare as C
from formloom.functions import fields as FL
from formloom.functions import text as X
from formloom.functions import thai as T
from formloom.operators.quality import actionable_reasons
from formloom.session import joined_within

PARENTS = (("motherName", "motherId"), ("fatherName", "fatherId"))
SHORT_NAME = 3
SHORT_PAGE = 40


def empty_in_source() -> Column:
    """A field whose page shows a dash or a blank there."""
    return F.coalesce(F.col("source").isin(*K.EMPTY_SOURCES), F.lit(False)) | (F.coalesce("review_status", F.lit("")) == "empty_in_source")


def duplicate_ids(values: DataFrame) -> DataFrame:
    """Identifiers of a record whose digits equal those of another of its identifiers."""
    ids = values.filter(F.col("field").isin(*K.ID_FIELDS)).withColumn("_digits", T.digits("value")).filter("_digits <> ''")
    twice = F.count("*").over(Window.partitionBy("record_id", "_digits")) > 1
    return ids.withColumn("_twice", twice).filter("_twice").drop("_twice", "_digits")


def validation_issues(values: DataFrame) -> DataFrame:
    """(record_id, field, issue), each at most once.

    ``values(record_id, field, value, source, review_status)`` is one row per
    field; a record's rules across fields come from one aggregate per record.
    """
    rows = values.select("record_id", "field", F.coalesce(X.trimmed("value"), F.lit("")).alias("v"), F.coalesce("source", F.lit("")).alias("source"), "review_status")
    rows = rows.withColumn("empty", empty_in_source())
    asked_for = FL.with_valid(rows.filter(F.col("field").isin(*K.REQUIRED_FIELDS) & ~F.col("empty")), "field", "v", "valid")
    needed = FL.keep(asked_for.withColumn("wrong", ~F.col("valid")), "wrong").select("record_id", "field", F.lit("missing_or_invalid").alias("issue"))
    asked = rows.filter("review_status = 'needs_review'").select("record_id", "field", F.lit("needs_review").alias("issue"))
    doubtful = rows.filter(F.col("field").isin(*K.ID_FIELDS) & T.suspicious_id("v")).select("record_id", "field", F.lit("suspicious_id").alias("issue"))
    names = [f for pair in PARENTS for f in pair]
    keys = (*K.REQUIRED_FIELDS, *names)
    at = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = rows.filter(F.col("field").isin(*keys)).groupBy("record_id").agg(
        *[F.coalesce(at(f, "v"), F.lit("")).alias(f) for f in names], F.coalesce(at("personId", "v"), F.lit("")).alias("personId"),
        *[F.coalesce(at(f, "source"), F.lit("")).alias(f"{f}_source") for f in K.PARENT_NAMES],
        *[F.coalesce(at(f, "empty"), F.lit(False)).alias(f"{f}_empty") for _, f in PARENTS],
        F.array_except(F.array(*map(F.lit, K.REQUIRED_FIELDS)), F.collect_set("field")).alias("absent"),
    )
    issue = lambda field, name: F.struct(F.lit(field).alias("field"), F.lit(name).alias("issue"))
    found = []
    for name, number in PARENTS:
        found.append(F.when(~F.col(f"{number}_empty") & (F.col(name) != "") & (F.col(number) == ""), issue(number, "parent_id_missing")))
        read = F.col(f"{name}_source").contains("crop_ocr") | F.col(f"{name}_source").contains("vision")
        trusted = FL.valid_value(number, number) & read
        found.append(F.when((F.col(name) != "") & (F.length(X.compact(name)) <= SHORT_NAME) & ~trusted, issue(name, "short_parent_name")))
    mother, father = K.PARENT_NAMES
    same = (F.col(mother) != "") & (X.compact(mother) == X.compact(father))
    found += [F.when(same, issue(f, "duplicate_parent_name")) for f in K.PARENT_NAMES]
    crossed = wide.select("record_id", F.explode(F.array_compact(F.array(*found))).alias("i")).select("record_id", "i.field", "i.issue")
    absent = wide.select("record_id", F.explode("absent").alias("field"), F.lit("missing_or_invalid").alias("issue"))
    twice = duplicate_ids(rows.withColumnRenamed("v", "value")).select("record_id", "field", F.lit("duplicate_id").alias("issue"))
    return needed.unionByName(absent).unionByName(asked).unionByName(doubtful).unionByName(twice).unionByName(crossed).distinct()


def quality_label(text: Column, issues: Column, errors: Column, reasons: Column) -> Column:
    """Short pages are of low confidence; any issue, error or actionable reason asks for review."""
    return (
        F.when(F.length(F.coalesce(X.trimmed(text), F.lit(""))) < SHORT_PAGE, "low_confidence")
        .when((F.coalesce(issues, F.lit(0)) > 0) | F.coalesce(errors, F.lit(False)) | F.coalesce(actionable_reasons(reasons), F.lit(False)), "needs_review")
        .otherwise("auto_verified")
    )


def field_needs_review(status: Column, alternatives: Column, issues: Column) -> Column:
    """P20: marked for review, or with any alternative or issue."""
    return (F.coalesce(status, F.lit("")) == "needs_review") | (F.coalesce(alternatives, F.lit(0)) > 0) | (F.coalesce(issues, F.lit(0)) > 0)


#: Fields that are read again in any case, and those that the aggressive mode adds.
ALWAYS_READ, READ_MORE = ("age", "address"), ("personName", "motherName", "fatherName", "houseCode", "address")


def select_fields_to_reread(values: DataFrame, alternatives: DataFrame, issues: DataFrame, mode: str = "selective") -> DataFrame:
    """record_id, field, reason: the fields with a place on the page that another reader should read, by the first rule that holds.

    ``values(record_id, field, value, source, review_status)``,
    ``alternatives(record_id, field, n)``, ``issues(record_id, field)``. A field
    that a record lacks is invalid; one that is empty in the source is never
    read again. ``mode`` is off, selective or aggressive.
    """
    boxed = [f for f, _, box, _ in K.FIELD_TEMPLATES if box is not None]
    key = ["record_id", "field"]
    every = values.select("record_id").distinct().withColumn("field", F.explode(F.array(*map(F.lit, boxed if mode != "off" else []))))
    names = values.filter(F.col("field").isin(*K.PARENT_NAMES)).groupBy("record_id").agg(
        *[F.max(F.when(F.col("field") == f, X.compact(F.coalesce("value", F.lit(""))))).alias(f) for f in K.PARENT_NAMES])
    rows = joined_within(every, values.select(*key, "value", "source", "review_status"), *key)
    rows = joined_within(rows, alternatives.filter("n > 1").select(*key).distinct().withColumn("several", F.lit(True)), *key)
    rows = joined_within(rows, issues.select(*key).distinct().withColumn("issue", F.lit(True)), *key).join(names, "record_id", "left")
    rows = FL.with_valid(rows.withColumn("v", X.trimmed(F.coalesce("value", F.lit("")))), "field", "v", "valid")
    field, mother, father = F.col("field"), F.col(K.PARENT_NAMES[0]), F.col(K.PARENT_NAMES[1])
    parent = field.isin(*K.PARENT_NAMES)
    always = field.isin(*(ALWAYS_READ + READ_MORE if mode == "aggressive" else ALWAYS_READ))
    reason = (
        F.when(empty_in_source(), None).when(always, "always").when(~F.col("valid"), "invalid").when(F.col("review_status") == "needs_review", "needs_review")
        .when(F.col("several"), "alternatives").when(F.col("issue"), "quality_issue").when(field.isin(*K.ID_FIELDS) & T.suspicious_id("v"), "suspicious_id")
        .when(parent & (F.length(X.compact("v")) <= SHORT_NAME), "short_parent_name").when(parent & (mother != "") & (mother == father), "duplicate_parent_name")
    )
    # generated, so that the rules aren't repeated in a filter
    return rows.select(*key, F.explode(F.array_compact(F.array(reason))).alias("reason"))


def issues_by_field(issues: DataFrame) -> DataFrame:
    """The issue kinds of each field, in order of their names (there are a few kinds only)."""
    return issues.groupBy("record_id", "field").agg(F.array_sort(F.collect_set("issue")).alias("issues"))


def append_issues(events: DataFrame) -> DataFrame:
    """One issue per record, field and type: the first message, and every different alternative once.

    Alternatives count only from the first that the issue was opened with: an
    issue opened without any stays without. ``events`` are in ``seq`` order.
    """
    keys = ["record_id", "field", "type"]
    rows = events.withColumn("_c", F.coalesce(X.compact("alternative"), F.lit("")))
    head = rows.groupBy(*keys).agg(F.min_by("message", "seq").alias("message"), (F.min_by("_c", "seq") != "").alias("_opens"))
    first = rows.filter("_c <> ''").groupBy(*keys, "_c").agg(F.min(F.struct("seq", "alternative")).alias("a"))
    listed = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["alternative"]).alias("_list"))
    none = F.array().cast("array<string>")
    joined = head.join(listed, keys, "left")
    return joined.select(*keys, "message", F.when(F.col("_opens"), F.coalesce("_list", none)).otherwise(none).alias("alternatives"))


def merge_alternatives(readings: DataFrame) -> DataFrame:
    """Readings of a field by compact value: first value and reason kept, sources once each in order, best score."""
    keys = ["record_id", "field", "compact"]
    rows = readings.withColumn("compact", X.compact("value"))
    ranked = rows.groupBy(*keys, "source").agg(F.min("seq").alias("seq"))
    sources = ranked.filter("source <> ''").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("sources"))
    reason = F.nullif("reason", F.lit(""))
    head = rows.groupBy(*keys).agg(
        F.min_by("value", "seq").alias("value"), F.min_by(reason, F.when(reason.isNotNull(), F.col("seq"))).alias("reason"), F.max("score").alias("score"), F.min("seq").alias("seq"))
    return head.join(sources, keys, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def best_scored_value(current: DataFrame, alternatives: DataFrame) -> DataFrame:
    """A field's best-scored alternative where it differs from the current value, else the current value.

    Of equal scores the earlier one wins; an alternative without a score never does.
    """
    best = alternatives.filter("score is not null").groupBy("record_id", "field").agg(F.max_by("value", F.struct(F.col("score"), -F.col("seq"))).alias("_best"))
    joined = current.join(best, ["record_id", "field"], "left")
    change = F.col("_best").isNotNull() & (X.compact("_best") != X.compact(F.coalesce("value", F.lit(""))))
    return joined.select("record_id", "field", F.when(change, F.col("_best")).otherwise(F.col("value")).alias("value"), F.coalesce(change, F.lit(False)).alias("changed"))


def vote(candidates: DataFrame) -> DataFrame:
    """A10: the candidate value that most readings of a field agree on, with its source or the refusal.

    Readings group by compact value; plausible parent names come first, then
    more readings, then one that has a focused crop. An exact tie of parent
    names picks none. Of other ties the group read first wins.
    """
    rows = candidates.withColumn("_c", X.compact(F.coalesce("value", F.lit("")))).filter("_c <> ''")
    groups = rows.groupBy("record_id", "field", "_c").agg(
        F.min_by("value", "seq").alias("value"), F.min_by("source", "seq").alias("source"), F.count("*").alias("votes"),
        F.max(F.col("source").contains("field_crop").cast("int")).alias("focused"), F.min("seq").alias("seq"))
    parent = F.col("field").isin(*K.PARENT_NAMES)
    groups = groups.withColumn("plausible", F.when(~parent | C.plausible_parent_name("value"), 1).otherwise(0))
    score = F.struct("plausible", "votes", "focused")
    groups = groups.withColumn("score", score)
    best = groups.groupBy("record_id", "field").agg(
        F.max("score").alias("top"), F.max_by(F.struct("value", "source", "votes", "score"), F.struct(F.col("score"), -F.col("seq"))).alias("b"),
        F.array_sort(F.collect_list("score")).alias("_scores"))
    tied = F.size(F.filter("_scores", lambda s: s == F.col("top"))) > 1
    refused = tied & F.col("field").isin(*K.PARENT_NAMES)
    source = F.when(F.col("b.votes") == 1, F.col("b.source")).otherwise(F.concat("b.source", F.lit("_consensus")))
    return best.select("record_id", "field", F.when(~refused, F.col("b.value")).alias("value"), F.when(~refused, source).alias("source"), refused.alias("refused"))


def consensus_label(selected: Column, parser: Column, crop: Column, vision: Column) -> Column:
    """which readings confirm the selected value."""
    c = lambda x: F.nullif(X.compact(F.coalesce(x, F.lit(""))), F.lit(""))
    named = {"parser": parser, "crop": crop, "vision": vision}
    row = F.struct(c(selected).alias("s"), *[c(v).alias(k) for k, v in named.items()])

    def label(r: Column) -> Column:
        same = F.array_compact(F.array(*[F.when(r[k] == r["s"], F.lit(k)) for k in named]))
        kinds = F.size(F.array_distinct(F.array_compact(F.array(*[r[k] for k in named]))))
        return (
            F.when(r["s"].isNull(), None)
            .when(F.size(same) >= 2, F.concat(F.lit("confirmed_by_"), F.array_join(same, "_")))
            .when(kinds > 1, "candidate_conflict")
            .when(F.size(same) == 1, F.concat(F.lit("single_"), F.array_join(same, "_")))
        )

    return X.let(row, label)


# fixed values: reasons, the first whose condition holds
AGE_REASONS = (
    ("verified", "OCR/parser age matched birthDate and updateDate"),
    ("promoted_crop_ocr_alternative", "crop OCR age was promoted over the parser/calculated mismatch"),
    ("flagged_mismatch_kept_ocr", "OCR/crop age was kept and calculated age was shown as an alternative"),
    ("corrected_mismatch", "calculated age replaced an OCR/Vision mismatch"),
    ("derived_missing", "age was calculated from birthDate and updateDate"),
)


def selection_reason(field: Column, source: Column, derived: Column, crop: Column, vision: Column, dash: Column) -> Column:
    """why a field has its value; the first rule wins."""
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    out = F.when(F.coalesce(dash, F.lit(False)), "source image showed a dash in this field")
    for action, reason in AGE_REASONS:
        out = out.when((field == "age") & (derived == action), reason)
    return (
        out.when(filled(crop), "crop OCR filled or corrected this validated field")
        .when((field == "age") & filled(vision), "Vision read age only after parser and date calculation were unavailable")
        .when(filled(vision), "Vision filled or corrected this field from its crop")
        .when(filled(source), F.concat(F.lit("selected from "), source))
        .otherwise("no selected value")
    )


def apply_staff_edits(values: DataFrame, edits: DataFrame) -> DataFrame:
    """Staff values lie over a record's fields; an edit without a status is staff verified."""
    new = edits.select("record_id", "field", F.col("value").alias("_v"), F.coalesce(F.nullif("review_status", F.lit("")), F.lit("staff_verified")).alias("_s"), F.lit(True).alias("_hit"))
    joined = values.join(new, ["record_id", "field"], "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.select("record_id", "field", F.when(hit, F.col("_v")).otherwise(F.col("value")).alias("value"), F.when(hit, F.col("_s")).otherwise(F.col("review_status")).alias("review_status"))


def reconcile_age(birth: Column, update: Column, age: Column, crop: Column) -> Column:
    """struct(action, value, calculated) from the age read, the dates and a differing crop reading; NULL without dates."""
    text = F.coalesce(X.trimmed(age), F.lit(""))
    row = F.struct(T.age_at(birth, update).cast("string").alias("c"), text.alias("a"), F.nullif(X.trimmed(F.coalesce(crop, F.lit(""))), F.lit("")).alias("k"))

    def decide(r: Column) -> Column:
        done = lambda action, value: F.struct(F.lit(action).alias("action"), value.alias("value"), r["c"].alias("calculated"))
        valid = FL.valid_value("age", r["a"])
        promoted = r["k"].isNotNull() & (r["a"] != "") & (X.compact(r["a"]) != X.compact(r["k"]))
        return (
            F.when(~FL.valid_value("age", F.coalesce(r["c"], F.lit(""))), None)
            .when(valid & (T.ascii_digits(r["a"]) == r["c"]), done("verified", r["c"]))
            .when(promoted, done("promoted_crop_ocr_alternative", r["k"]))
            .when(valid, done("flagged_mismatch_kept_ocr", r["a"]))
            .otherwise(done("derived_missing", r["c"]))
        )

    return X.let(row, decide)
