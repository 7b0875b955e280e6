"""Typed export of completed reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import address as A
from formloom.functions import text as X
from formloom.functions import thai as T
from formloom.functions.text import _c


def export_value(c: Column | str) -> Column:
    """trimmed value, placeholders become empty."""
    v = X.trimmed(F.coalesce(_c(c), F.lit("")))
    return F.when(v.isin(*K.EMPTY_MARKS), "").otherwise(v)


def postal(c: Column | str) -> Column:
    """first five digits, NULL when there are fewer."""
    d = T.digits(c)
    return F.when(F.length(d) >= 5, F.left(d, F.lit(5)))


def to_int(c: Column | str) -> Column:
    """integer or NULL; see ``int_refused`` for the difference to blank."""
    return T.ascii_digits(c).try_cast("int")


def int_refused(c: Column | str) -> Column:
    return (F.coalesce(_c(c), F.lit("")) != "") & to_int(c).isNull()


# fixed values: the export schema, in order
EXPORT_COLUMNS = (
    "UpEate", "PIE", "PHIE", "PNBme", "PBE", "PAhe", "PSDX", "PNbtionality", "PAdStatus", "MNBme", "MIE", "MNbtionality", "DNBme", "DIE",
    "DNbtionality", "AEdress", "AEdress1", "AEdress2", "RPad", "PSovince", "ANphur", "DJstrict", "PPstalCode", "AEdress_In", "Renark",
    "PStatus", "UpdatedDate", "UpdatedBy", "UpdatedTime", "Renark_DED", "Renark_DED_Date",
)
DECEASED = "เสียชีวิต"


def person_export(values: DataFrame, updated_by: str, now: Column) -> DataFrame:
    """One row per record: the 31 export columns, and ``refused`` with the required fields that it lacks.

    ``values(record_id, field, value)``; the caller writes rows without a
    refusal and keeps the others aside. ``address_overflow`` names address
    columns that were cut to the schema's width.
    """
    fields = (*K.SUMMARY_FIELDS, "postalCode")
    v = export_value("value")
    wide = values.groupBy("record_id").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, v)), F.lit("")).alias(f) for f in fields])
    wide = A.with_split_address(wide, "address", "_a").withColumns({"_dead": F.coalesce(T.deceased_remark("remark"), F.lit(False)), "_died": T.deceased_date("remark")})
    lacking = F.array_compact(F.array(*[F.when(F.col(f) == "", F.lit(f)) for f in K.EXPORT_REQUIRED]))
    number = lambda f: F.nullif(T.digits(f), F.lit(""))
    row = {
        "UpEate": T.parse_thai_date("updateDate"), "PIE": number("personId"), "PHIE": number("houseCode"), "PNBme": F.col("personName"), "PBE": T.parse_thai_date("birthDate"),
        "PAhe": to_int("age"), "PSDX": F.col("gender"), "PNbtionality": F.col("nationality"), "PAdStatus": F.col("status"), "MNBme": F.col("motherName"), "MIE": number("motherId"),
        "MNbtionality": F.col("motherNationality"), "DNBme": F.col("fatherName"), "DIE": number("fatherId"), "DNbtionality": F.col("fatherNationality"), "AEdress": F.col("address"),
        "AEdress1": F.col("_a.address1"), "AEdress2": F.col("_a.address2"), "RPad": F.col("_a.road"), "PSovince": F.col("_a.province"), "ANphur": F.col("_a.district"),
        "DJstrict": F.col("_a.subdistrict"), "PPstalCode": postal(F.coalesce(F.nullif("postalCode", F.lit("")), F.col("_a.postal_code"))), "AEdress_In": T.parse_thai_date("moveInDate"),
        "Renark": F.col("remark"), "PStatus": F.when(F.col("_dead"), DECEASED), "UpdatedDate": now.cast("timestamp"), "UpdatedBy": F.nullif(F.lit(updated_by[:5]), F.lit("")),
        "UpdatedTime": F.date_format(now, "HH:mm:ss"), "Renark_DED": F.when(F.col("_dead"), "Y"), "Renark_DED_Date": F.when(F.col("_dead"), T.parse_thai_date("_died")),
    }
    return wide.select(
        "record_id", *[row[c].alias(c) for c in EXPORT_COLUMNS], F.nullif(F.array_join(lacking, ","), F.lit("")).alias("refused"), F.col("_a.overflow").alias("address_overflow"))
