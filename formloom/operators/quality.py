"""Quality measurement: issues, accuracy, summaries, timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import text as X
from formloom.functions import thai as T
from formloom.functions.text import _c


def eval_norm(field: Column | str, value: Column | str) -> Column:
    """digits for identifiers and house codes, else folded digits and whitespace."""
    field = _c(field)
    return F.when(F.lower(field).endswith("id") | (field == "houseCode"), T.digits(F.coalesce(_c(value), F.lit("")))).otherwise(
        T.ascii_digits(X.norm_ws(F.coalesce(_c(value), F.lit(""))))
    )


def json_field(payload: Column | str, key: str) -> Column:
    """a review field given as a scalar or as an object with ``value``."""
    p = _c(payload)
    whole, inner = F.get_json_object(p, f"$.fields.{key}"), F.get_json_object(p, f"$.fields.{key}.value")
    return X.blank_to_null(X.norm_ws(F.when(whole.startswith("{"), inner).otherwise(whole)))



def actionable_reasons(reasons: Column) -> Column:
    """Any reason that is not one of the benign kinds."""
    return F.exists(
        reasons,
        lambda r: (r != "") & ~reduce(lambda a, b: a | b, [r.startswith(p) for p in K.BENIGN_REASON_PREFIXES]),
    )


def stage_timings(records: DataFrame) -> DataFrame:
    """Time per processing stage and batch from a map of stage -> ms."""
    long = records.select("batch_id", F.explode("stages_ms").alias("stage", "ms"))
    return long.groupBy("batch_id", "stage").agg(
        F.count("*").alias("n"), F.round(F.sum("ms"), 4).alias("total_ms"), F.max("ms").alias("max_ms")
    )


def record_timings(records: DataFrame) -> DataFrame:
    """Time of all stages of each record, before it is written."""
    total = F.aggregate(F.map_values("stages_ms"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return records.select("record_id", F.round(total, 4).alias("total_ms"))
