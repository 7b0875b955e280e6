"""Record bookkeeping: filters, queues, counts, numbering, assignment, state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import text as X
from formloom.operators.ranking import latest, numbered, sum_before
from formloom.session import checkpointed, joined_within

# --- predicates ---------------------------------------------------------------


def match(query: dict) -> Column:
    """Equality, ``$in``, ``$exists`` and ``$or`` as one Column.

    A condition object with no known operator passes, a non-list ``$in`` or
    ``$or`` is false. On typed columns ``$exists`` means not null.
    """

    def one(key: str, want: object) -> Column:
        if key == "$or":
            if not isinstance(want, list):
                return F.lit(False)
            return reduce(lambda a, b: a | b, [match(q) for q in want if isinstance(q, dict)], F.lit(False))
        col = F.col(key)
        if isinstance(want, dict):
            out = F.lit(True)
            if "$in" in want:
                values = want["$in"]
                if not isinstance(values, list):
                    return F.lit(False)
                known = [v for v in values if v is not None]
                out = F.coalesce(col.isin(*known), F.lit(False)) if known else F.lit(False)
                if len(known) < len(values):
                    out = out | col.isNull()
            if "$exists" in want:
                out = out & (col.isNotNull() if want["$exists"] else col.isNull())
            return out
        return col.eqNullSafe(F.lit(want))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in query.items()], F.lit(True))


def project(df: DataFrame, fields: dict[str, int] | None, key: str = "_id") -> DataFrame:
    """Inclusion projection; the key column stays unless set to 0."""
    wanted = [f for f, on in (fields or {}).items() if on and f != key]
    if not wanted:
        return df
    if (fields or {}).get(key, 1):
        wanted = [key, *wanted]
    return df.select(*[c for c in wanted if c in df.columns])


def stored_version(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def needs_processing() -> Column:
    """Ordered rules over status, text, error and stored pipeline version."""
    text_blank = F.coalesce(X.trimmed("ocr_markdown"), F.lit("")) == ""
    has_text = F.coalesce(F.col("ocr_markdown"), F.lit("")) != ""
    has_error = F.coalesce(F.col("ocr_error_message"), F.lit("")) != ""
    target = F.when(X.is_form_category("document_category"), K.FORM_PIPELINE_VERSION).otherwise(
        K.OTHER_PIPELINE_VERSION
    )
    status = F.coalesce(F.col("status"), F.lit(""))
    return (
        F.when(status.isin(*K.BUSY_STATUSES), False)
        .when((status == "checked") & has_text & ~has_error, False)
        .when(status.isin(*K.QUEUE_STATUSES), True)
        .when(has_error | text_blank, True)
        .otherwise(stored_version(F.col("ocr_pipeline_version")) < target)
    )


def is_blank(name: str) -> Column:
    return F.coalesce(X.trimmed(name), F.lit("")) == ""


def ready_to_assign() -> Column:
    """Read, unassigned and with no assignee left over."""
    return (
        (F.col("ocr_status") == "succeeded") & (F.col("review_status") == "unassigned")
        & is_blank("assigned_to_user_id") & is_blank("assigned_to_username")
    )


def text_search(columns: Sequence[Column], needle: str) -> Column:
    """Case-insensitive substring over the non-empty columns joined by spaces."""
    q = needle.strip().lower()
    if not q:
        return F.lit(True)
    parts = [F.nullif(c.cast("string"), F.lit("")) for c in columns]
    return F.lower(F.concat_ws(" ", *parts)).contains(q)


def dashboard_filter(df: DataFrame, status: str | None = None, needle: str = "") -> DataFrame:
    """P10: manager dashboard rows by status card and search text."""
    cards = {
        "running": F.col("ocr_status").isin("pending", "processing"),
        "review": (F.col("review_status") == "unassigned") & (F.col("ocr_status") == "succeeded"),
        "completed": F.col("review_status") == "completed",
        "failed": F.col("ocr_status") == "failed",
    }
    page = F.concat(F.lit("page "), F.col("page_number").cast("string"))
    columns = [
        F.col("record_no"), F.col("record_id"), F.col("original_filename"), page, F.col("page_number"),
        F.col("selected_document_type"), F.col("ocr_status"), F.col("review_status"), F.col("assigned_to_username"),
    ]
    return df.filter(cards.get(status or "", F.lit(True)) & text_search(columns, needle))


def staff_queue_filter(df: DataFrame, status: str | None = None, needle: str = "") -> DataFrame:
    """Staff queue rows; pending means not completed."""
    cards = {"pending": F.col("review_status") != "completed", "completed": F.col("review_status") == "completed"}
    page = F.concat(F.lit("page "), F.col("page_number").cast("string"))
    columns = [
        F.col("record_no"), F.col("record_id"), F.col("original_filename"), page, F.col("page_number"),
        F.col("review_status"), F.col("ocr_status"),
    ]
    return df.filter(cards.get(status or "", F.lit(True)) & text_search(columns, needle))


DOCUMENT_GROUPS = {
    "running": K.PENDING_STATUSES,
    "review": ("ready_for_review", "review_ready"),
    "completed": ("checked",),
    "failed": ("ocr_failed",),
}


def document_filter(df: DataFrame, needle: str = "", status: str | None = None) -> DataFrame:
    """Documents by file name or category text and status group."""
    cond = F.lit(True)
    if needle:
        q = needle.lower()
        cond = F.lower("source_filename").contains(q) | F.coalesce(
            F.lower("document_category").contains(q), F.lit(False)
        )
    if status in DOCUMENT_GROUPS:
        cond = cond & F.col("status").isin(*DOCUMENT_GROUPS[status])
    return df.filter(cond)


# --- queues and listings ---------------------------------------------------------


def list_documents(df: DataFrame, category: str | None, limit: int) -> DataFrame:
    """The ``limit`` newest documents of one category (1 to 500, as the listing allows)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    raw = (category or "").strip()
    if raw and raw.lower() != "all":
        import re

        wanted = re.sub(r"[^\w\-]", "", raw.lower().replace(" ", "_")).strip("_-") or K.DEFAULT_CATEGORY
        col = F.col("document_category")
        if wanted == K.DEFAULT_CATEGORY:
            df = df.filter(F.coalesce(F.nullif(col, F.lit("")), F.lit(wanted)) == wanted)
        else:
            df = df.filter(col == wanted)
    return df.orderBy(F.desc_nulls_last("updated_at"), "seq").limit(limit)


def pending_queue(df: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` oldest unfinished documents; interrupted ones go back to the queue."""
    return (
        df.filter(F.col("status").isin(*K.PENDING_STATUSES))
        .orderBy(F.asc_nulls_first("updated_at"), "seq")
        .limit(limit)
        .withColumn("status", F.when(F.col("status").isin(*K.BUSY_STATUSES), "ocr_queued").otherwise(F.col("status")))
    )


def latest_jobs(df: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest jobs."""
    return df.orderBy(F.desc("created_at"), "seq").limit(limit)


def stale_reviews(df: DataFrame) -> DataFrame:
    """What to do with a stored form review: reuse, rebuild or skip."""
    version = stored_version(F.col("review_version"))
    action = (
        F.when(~X.is_form_category("document_category") | (F.col("total_pages") < 1), "skip")
        .when(version >= K.REVIEW_VERSION, "reuse")
        .otherwise("rebuild")
    )
    return df.withColumn("action", action)


def validate_batch(files: DataFrame) -> DataFrame:
    """Reasons to refuse a batch, with the first file that breaks the record cap.

    The running page sum is over all files of a batch, in stretches of file
    numbers, so that files without pages may stand anywhere. A NULL page count
    adds nothing.
    """
    ext = F.lower(F.regexp_extract(X.safe_basename("original_filename"), r"(\.[^.]+)$", 1))
    is_pdf = (ext == ".pdf") & F.lower(F.coalesce(F.col("content_type"), F.lit(""))).isin(*K.PDF_CONTENT_TYPES)
    wrong_type = F.upper(X.trimmed(F.coalesce(F.col("document_type"), F.lit("")))) != "TR"
    pages = F.coalesce("page_count", F.lit(0))
    marked = files.select("batch_id", "file_id", "file_seq", pages.alias("page_count"), is_pdf.alias("is_pdf"), wrong_type.alias("wt"))
    placed = sum_before(marked, ["batch_id"], ["file_seq"], F.floor(F.col("file_seq") / FILES_A_STRETCH), "page_count", "before")
    over = F.col("before") + F.col("page_count") > K.MAX_RECORDS_PER_BATCH
    sums = placed.groupBy("batch_id").agg(
        F.count("*").alias("file_count"),
        F.sum("page_count").alias("total_pages"),
        F.max("page_count").alias("max_pages"),
        F.bool_and("is_pdf").alias("all_pdf"),
        F.bool_or("wt").alias("wrong_type"),
        F.min_by(F.when(over, F.col("file_id")), F.when(over, F.col("file_seq"))).alias("first_over"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("wrong_type"), "type"),
            F.when(F.col("file_count") > K.MAX_FILES_PER_BATCH, "too_many_files"),
            F.when(~F.col("all_pdf"), "not_pdf"),
            F.when(F.col("max_pages") > K.MAX_PAGES_PER_FILE, "file_too_long"),
            F.when(F.col("total_pages") > K.MAX_RECORDS_PER_BATCH, "too_many_records"),
        )
    )
    return sums.select("batch_id", "file_count", "total_pages", "max_pages", F.array_join(reasons, ",").alias("reasons"), "first_over")


def my_records(df: DataFrame, user_id: str, username: str, detail: bool = False) -> DataFrame:
    """Records of one user by id or name, newest assignment first."""
    mine = F.coalesce(F.col("assigned_to_user_id"), F.lit("")).isin(user_id, username) | F.coalesce(
        F.col("assigned_to_username"), F.lit("")
    ).isin(user_id, username)
    df = df.filter(mine & (F.col("ocr_status") == "succeeded") if detail else mine)
    return df.orderBy(F.desc_nulls_last("assigned_at"))


def names_of(id_col: str, name_col: str) -> Column:
    """The different non-empty values among an id and a name."""
    both = F.array(F.coalesce(F.col(id_col), F.lit("")), F.coalesce(F.col(name_col), F.lit("")))
    return F.array_distinct(F.filter(both, lambda v: v != ""))


def my_records_by_table(df: DataFrame, users: DataFrame) -> DataFrame:
    """P13/X03 for many users at once: an id or name on either side meets an id or name on the other."""
    held = df.withColumn("_who", F.explode(names_of("assigned_to_user_id", "assigned_to_username")))
    asked = users.withColumn("_who", F.explode(names_of("user_id", "username")))
    return held.join(asked, "_who").drop("_who").dropDuplicates(["record_id", "user_id"])


def select_for_rerun(df: DataFrame, pages: Sequence[int] | None = None) -> DataFrame:
    """Reset reading columns of chosen pages; the whole-batch form also unassigns."""
    hit = F.col("page_number").isin(*pages) if pages else F.lit(True)
    changes = {
        "ocr_status": F.when(hit, F.lit("pending")).otherwise(F.col("ocr_status")),
        "ocr_error": F.when(~hit, F.col("ocr_error")),
        "ocr_quality": F.when(~hit, F.col("ocr_quality")),
    }
    if not pages:
        changes |= {
            "review_status": F.lit("unassigned"),
            "assigned_to_user_id": F.lit(None).cast("string"),
            "assigned_to_username": F.lit(None).cast("string"),
        }
    return df.withColumns(changes)


def batch_file_errors(files: DataFrame) -> DataFrame:
    """Files with an error or above the page cap."""
    return files.filter(
        (F.coalesce(F.col("error_message"), F.lit("")) != "") | (F.col("page_count") > K.MAX_PAGES_PER_FILE)
    )


def batch_record_errors(records: DataFrame) -> DataFrame:
    """Failed records that carry an error."""
    return records.filter((F.col("ocr_status") == "failed") & (F.coalesce(F.col("ocr_error"), F.lit("")) != ""))


# --- counts ------------------------------------------------------------------------


def record_counters() -> list[Column]:
    ocr, review = F.col("ocr_status"), F.col("review_status")
    return [
        F.count("*").alias("record_count"),
        F.count_if(ocr == "pending").alias("ocr_pending_count"),
        F.count_if(ocr == "processing").alias("ocr_processing_count"),
        F.count_if(ocr == "succeeded").alias("ocr_succeeded_count"),
        F.count_if(ocr == "failed").alias("ocr_failed_count"),
        F.count_if((ocr == "succeeded") & (review == "unassigned")).alias("ready_to_assign_count"),
        F.count_if(review == "assigned").alias("assigned_count"),
        F.count_if(review == "unassigned").alias("unassigned_count"),
        F.count_if(review == "in_review").alias("in_review_count"),
        F.count_if(review == "completed").alias("completed_count"),
    ]


def batch_counts(records: DataFrame) -> DataFrame:
    """Counters per batch."""
    return records.groupBy("batch_id").agg(*record_counters())


def batch_status() -> Column:
    """Batch status from its counters."""
    open_, ok, failed = (
        F.col("ocr_pending_count") + F.col("ocr_processing_count"), F.col("ocr_succeeded_count"), F.col("ocr_failed_count"),
    )
    return (
        F.when(open_ > 0, "ocr_processing")
        .when((failed > 0) & (ok > 0), "partially_failed")
        .when(failed > 0, "failed")
        .when(ok > 0, "ocr_completed")
        .otherwise("records_created")
    )


def dashboard_totals(records: DataFrame) -> DataFrame:
    """Counters per batch and over everything in one pass."""
    return records.rollup("batch_id").agg(F.countDistinct("file_id").alias("file_count"), *record_counters())


def dashboard_summary(records: DataFrame, files: DataFrame) -> DataFrame:
    """The dashboard's one row of totals over all batches that have records or files."""
    mine = records.groupBy("batch_id").agg(*record_counters())
    pages = files.groupBy("batch_id").agg(F.count("*").alias("file_count"), F.sum(F.coalesce("page_count", F.lit(0))).alias("total_pages"))
    both = mine.join(pages, "batch_id", "full_outer")
    return both.agg(F.count("*").alias("batch_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns if c != "batch_id"])


def dashboard_records(records: DataFrame) -> DataFrame:
    """The dashboard's records, newest first."""
    return records.select(
        "record_id", "record_no", "batch_id", "file_id", "original_filename", "selected_document_type", "page_number", "ocr_status",
        "review_status", "ocr_error", "assigned_to_user_id", "assigned_to_username", "assigned_at", "created_at",
    ).orderBy(F.desc_nulls_last("created_at"), "record_id")


def staff_stats(records: DataFrame) -> DataFrame:
    """Total, open and completed records per assignee."""
    done = F.col("review_status") == "completed"
    return records.filter(~is_blank("assigned_to_user_id")).groupBy("assigned_to_user_id").agg(
        F.count("*").alias("total"), F.count_if(~done).alias("in_progress"), F.count_if(done).alias("completed")
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """Document counts per status group."""
    return docs.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status").isin(*v)).alias(k) for k, v in DOCUMENT_GROUPS.items()],
    )


def record_errors(records: DataFrame) -> DataFrame:
    """One row per non-blank reading error."""
    return records.filter(~is_blank("ocr_error")).select(
        "batch_id", "record_id", "file_id", "original_filename", "page_number", X.trimmed("ocr_error").alias("error")
    )


# --- numbering, assignment, order -----------------------------------------------------


def record_number(batch: Column, position: Column) -> Column:
    stem = F.left(F.upper(F.regexp_replace(batch, "[^A-Za-z0-9]+", "")), F.lit(6))
    return F.concat(
        F.lit("TR-"), F.when(stem == "", "BATCH").otherwise(stem), F.lit("-"),
        F.when(position < 10000, F.lpad(position.cast("string"), 4, "0")).otherwise(position.cast("string")),
    )


#: Rows of a batch up to which one task numbers it whole; larger ones are cut.
BATCH_ROWS = 20_000


def record_numbers(records: DataFrame, order: Sequence[str], bucket: Column) -> DataFrame:
    """Keep the first use of a given number per batch, rewrite blanks and repeats.

    A rewritten number counts as used for the rows after it. A given number can
    equal the number of an earlier position only if it spells that position, so
    each row depends on one earlier row at most; such rows look up whether it
    was rewritten, and chains of them are followed until none is open.

    Batches are numbered whole in one task, so rows dealt by batch stay where
    they are; those of over ``BATCH_ROWS`` rows are cut at ``bucket``.
    """
    large = checkpointed(records.groupBy("batch_id").count().filter(F.col("count") > BATCH_ROWS).select("batch_id"))
    if not large.limit(1).count():
        return _renumbered(_numbered_whole(records, order), whole=True)
    small = _numbered_whole(records.join(F.broadcast(large), "batch_id", "left_anti"), order)
    cut = numbered(records.join(F.broadcast(large), "batch_id", "left_semi"), ["batch_id"], order, bucket, "pos")
    return _renumbered(small, whole=True).unionByName(_renumbered(cut, whole=False))


def _numbered_whole(records: DataFrame, order: Sequence[str]) -> DataFrame:
    return records.withColumn("pos", F.row_number().over(Window.partitionBy("batch_id").orderBy(*order)).cast("bigint"))


def _renumbered(placed: DataFrame, whole: bool) -> DataFrame:
    """W01 from the positions on; ``whole``: a batch is in one task, and what was found out about it joins it there."""
    placed = placed.withColumn("given", F.coalesce(X.trimmed("record_no"), F.lit("")))
    blank = F.col("given") == ""
    # blank numbers never meet: each is a group of its own
    same = Window.partitionBy("batch_id", "given", F.when(blank, F.col("pos")))
    spelled = F.regexp_extract("given", r"-(\d{4,18})$", 1).try_cast("long")
    links = (F.col("given") == record_number(F.col("batch_id"), spelled)) & (spelled < F.col("pos"))
    placed = placed.withColumn("_new", blank | (F.min("pos").over(same) < F.col("pos")))
    placed = placed.withColumn("_at", F.when(~F.col("_new") & links, spelled))
    # a linked row is also put at the position it spells, where it sees the row that has it
    asked = placed.select("batch_id", "pos", "_new", "_at", F.explode(F.array_compact(F.array("pos", "_at"))).alias("_slot"))
    own = F.col("_slot") == F.col("pos")
    there = F.max(F.when(own, F.struct("_new", "_at"))).over(Window.partitionBy("batch_id", "_slot"))
    seen = asked.withColumn("_there", there).filter(~own & F.col("_there").isNotNull())
    seen = checkpointed(seen.select("batch_id", "pos", "_at", F.col("_there._new").alias("_hit"), F.col("_there._at").isNotNull().alias("_more")))
    # the row of a chain that isn't its end is linked itself
    told = seen.select("batch_id", F.col("pos").alias("_from"), "_at", "_hit", "_more")
    taken = None
    while seen.limit(1).count():
        hits = seen.filter("_hit").select("batch_id", "pos", F.lit(True).alias("_taken"))
        taken = hits if taken is None else taken.unionByName(hits)
        open_ = seen.filter(~F.col("_hit") & F.col("_more")).select("batch_id", "pos", F.col("_at").alias("_from"))
        seen = checkpointed(open_.join(told, ["batch_id", "_from"]).drop("_from"))
    new = F.col("_new")
    if taken is not None:
        placed = joined_within(placed, taken, "batch_id", "pos") if whole else placed.join(taken, ["batch_id", "pos"], "left")
        new = new | F.coalesce("_taken", F.lit(False))
    number = F.when(new, record_number(F.col("batch_id"), F.col("pos"))).otherwise(F.col("given"))
    return placed.withColumn("record_no", number).drop("given", "_new", "_at", "_taken")


def assign_first_n(records: DataFrame, n: int, user_id: str, username: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """The first ``n`` ready rows of each batch that has as many; one refusal row for each other batch.

    ``outcome`` is ``assigned`` or the refusal; a refused batch has no record.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    ready = F.coalesce(ready_to_assign(), F.lit(False))
    sizes = records.groupBy("batch_id").agg(F.count_if(ready).alias("ready_found"))
    first = numbered(records.filter(ready), ["batch_id"], order, bucket, "rn").filter(F.col("rn") <= n)
    assigned = first.join(sizes.filter(F.col("ready_found") >= n), "batch_id").withColumns(
        {
            "review_status": F.lit("assigned"),
            "assigned_to_user_id": F.lit(user_id or username),
            "assigned_to_username": F.lit(username or user_id),
            "outcome": F.lit("assigned"),
        }
    )
    refusal = F.concat(F.lit("rejected: "), F.col("ready_found").cast("string"), F.lit(" ready"))
    short = sizes.filter(F.col("ready_found") < n).withColumn("outcome", refusal)
    return assigned.unionByName(short, allowMissingColumns=True).drop("rn")


def select_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each requested record's outcome and its request's, which is all or nothing.

    ``wanted(request_id, record_id, seq)``: blank ids are ignored, repeated ones
    count once. ``outcome`` is ready, blocked or missing; ``accepted`` is true
    where every record of the request is ready.
    """
    ids = (
        wanted.select("request_id", X.trimmed("record_id").alias("record_id"), "seq")
        .filter(F.col("record_id") != "")
        .groupBy("request_id", "record_id")
        .agg(F.min("seq").alias("seq"))
    )
    state = records.select("record_id", F.coalesce(ready_to_assign(), F.lit(False)).alias("_ready"))
    found = ids.join(state, "record_id", "left")
    outcome = F.when(F.col("_ready").isNull(), "missing").when(F.col("_ready"), "ready").otherwise("blocked")
    whole = Window.partitionBy("request_id")
    return found.withColumn("outcome", outcome).withColumn("accepted", F.bool_and(F.col("outcome") == "ready").over(whole)).drop("_ready")


def earliest(people: DataFrame, by: str) -> DataFrame:
    """user_id, username, ord of the first staff row with each value of ``by``."""
    first = people.groupBy(F.col(by).alias("_by")).agg(F.min_by(F.struct("user_id", "username", "ord"), "ord").alias("_p"))
    return first.select("_p.*")


def resolve_assignee(requests: DataFrame, staff: DataFrame, manager_id: str, manager_name: str) -> DataFrame:
    """First staff row equal by id or by name; the manager comes last.

    ``requests(request_id, req_id, req_name)``, ``staff(user_id, username, ord)``.
    The OR condition runs as two equi joins; the earliest staff row wins, so
    only the earliest of each id and of each name is joined.
    """
    people = staff.select("user_id", "username", F.col("ord").cast("bigint").alias("ord"))
    by_id = requests.filter(~is_blank("req_id")).join(earliest(people, "user_id"), F.col("req_id") == F.col("user_id"))
    by_name = requests.filter(~is_blank("req_name")).join(earliest(people, "username"), F.col("req_name") == F.col("username"))
    uid, name = manager_id or manager_name, manager_name or manager_id
    self_hit = (F.col("req_id") == uid) | (F.col("req_name") == name)
    self_rows = requests.filter(self_hit).select(
        "*", F.lit(uid).alias("user_id"), F.lit(name).alias("username"), F.lit(2**62).cast("bigint").alias("ord")
    )
    hits = by_id.unionByName(by_name).unionByName(self_rows)
    best = hits.groupBy("request_id").agg(F.min_by(F.struct("user_id", "username"), "ord").alias("p"))
    return requests.join(best, "request_id", "left").select(
        "request_id", "req_id", "req_name", F.col("p.user_id").alias("user_id"), F.col("p.username").alias("username")
    )


def natural_key(filename: Column | str, page: Column | str) -> Column:
    """Total order - time-stamped names first, then digit-aware names, then page."""
    name = F.col(filename) if isinstance(filename, str) else filename
    page = F.col(page) if isinstance(page, str) else page
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def sortable(run: Column) -> Column:
        """A digit run without leading zeros behind its length, so that any length compares as a number."""
        bare = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(bare).cast("string"), 6, "0"), bare)).otherwise(run)

    padded = F.array_join(F.transform(runs, sortable), "")
    stamp = X.filename_timestamp(name)
    return F.concat_ws(
        "|", F.coalesce(F.lpad(stamp.cast("string"), 14, "0"), F.lit("99999999999999")), padded,
        F.lpad(page.cast("string"), 10, "0"),
    )


def page_of(df: DataFrame, order: Sequence[Column | str], bucket: Column, page: int, size: int) -> DataFrame:
    """One screen page of rows in a total order; no task sorts or skips the rows before it."""
    if size not in (10, 20, 50, 100):
        raise ValueError("size must be 10, 20, 50 or 100")
    placed = numbered(df, [], order, bucket, "_place")
    return placed.filter(F.col("_place").between((page - 1) * size + 1, page * size)).drop("_place")


def import_status() -> Column:
    """document status of a review record."""
    return (
        F.when(save_flag() == "Y", "checked")
        .when(F.col("ocr_status") == "pending", "ocr_queued")
        .when(F.col("ocr_status") == "processing", "ocr_running")
        .when(F.col("ocr_status") == "failed", "ocr_failed")
        .otherwise("ready_for_review")
    )


def save_flag(c: str = "save_btn") -> Column:
    return F.when(F.upper(X.trimmed(F.coalesce(F.col(c), F.lit("N")))) == "Y", "Y").otherwise("N")


# --- state -------------------------------------------------------------------------------


def latest_state(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key."""
    return latest(events, keys, order)


def upsert(current: DataFrame, changes: DataFrame, key: str, insert: bool = True, replace: bool = False) -> DataFrame:
    """A change's columns win, NULLs too; a patch (``insert=False``) of a missing key does nothing.

    With ``replace`` the change is the whole row: columns that it lacks become NULL.
    """
    new = changes.select(key, *[F.col(c).alias(f"__n_{c}") for c in changes.columns if c != key], F.lit(True).alias("__hit"))
    joined = current.join(new, key, "full_outer" if insert else "left")

    def value(c: str) -> Column:
        if c in changes.columns:
            return F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c))
        return F.when(F.col("__hit").isNull(), F.col(c)) if replace else F.col(c)

    return joined.select(key, *[value(c).alias(c) for c in current.columns if c != key])


#: File numbers of one stretch of a batch: running sums are made inside a stretch and carried over.
FILES_A_STRETCH = 65536


def page_records(files: DataFrame) -> DataFrame:
    """One pending, unassigned record per file page, numbered through the batch.

    The number of a page is the pages of all earlier files plus its own, so the
    running sum is over files, not over pages. Files without a page, or of
    unknown length, have no records; ``pageless_files`` lists them.
    """
    counted = sum_before(
        files.filter("page_count >= 1"), ["batch_id"], ["file_seq"], F.floor(F.col("file_seq") / FILES_A_STRETCH), "page_count", "before"
    )
    pages = counted.withColumn("page_number", F.explode(F.sequence(F.lit(1), F.col("page_count"))))
    pos = (F.col("before") + F.col("page_number")).cast("bigint")
    return pages.select(
        F.concat_ws("-", "file_id", F.col("page_number").cast("string")).alias("record_id"),
        record_number(F.col("batch_id"), pos).alias("record_no"),
        "batch_id", "file_id", X.safe_basename("original_filename").alias("original_filename"), "page_number",
        F.lit("pending").alias("ocr_status"), F.lit("unassigned").alias("review_status"), F.lit("N").alias("save_btn"),
    )


def pageless_files(files: DataFrame) -> DataFrame:
    """Files that yield no record, with the reason."""
    reason = F.when(F.col("page_count").isNull(), "unknown page count").otherwise("no pages")
    return files.filter(F.coalesce(F.col("page_count") < 1, F.lit(True))).select("batch_id", "file_id", reason.alias("reason"))


ACTIONS = ("assign", "save", "complete")


def apply_actions(state: DataFrame, actions: DataFrame) -> DataFrame:
    """Requested actions, decided in order per record; one row each with a reason or its effect.

    ``actions(record_id, seq, action, user_id, username, edits, unresolved)``. A
    row is assigned once, while it is ready; only its owner (id or name, on
    either side) may save or complete it, once it has been read; after the first
    accepted completion nothing changes it. A completion takes its edits, else
    those saved last (a save may clear them), else the read result or text.

    Each decision needs only the record's first assignment, first valid
    completion and last save before it, so running windows per record do.
    """
    joined = actions.join(state.withColumn("_known", F.lit(True)), "record_id", "left")
    action, seq = F.col("action"), F.col("seq")
    mine = Window.partitionBy("record_id")
    before = mine.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ready = F.coalesce(ready_to_assign(), F.lit(False))
    joined = joined.withColumn("_ready", ready).withColumn(
        "_given", F.min(F.when(F.col("_ready") & (action == "assign"), F.struct("seq", "user_id", "username"))).over(mine)
    )
    given = F.col("_given.seq") < seq
    holder = F.array_distinct(F.when(given, F.array(F.coalesce("_given.user_id", F.lit("")), F.coalesce("_given.username", F.lit("")))).otherwise(
        F.array(F.coalesce("assigned_to_user_id", F.lit("")), F.coalesce("assigned_to_username", F.lit("")))))
    owner = F.arrays_overlap(F.filter(holder, lambda v: v != ""), names_of("user_id", "username"))
    edit = action.isin("save", "complete")
    early = (
        F.when(F.col("_known").isNull(), "record not found")
        .when(~action.isin(*ACTIONS), "unknown action")
        .when((action == "assign") & (~F.col("_ready") | given), "not ready to assign")
        .when(edit & ~F.coalesce(owner, F.lit(False)), "not assigned to user")
        .when(edit & (F.col("ocr_status") != "succeeded"), "not read yet")
    )
    joined = joined.withColumn("_early", early).withColumn("_done", save_flag() == "Y")
    closes = F.col("_early").isNull() & (action == "complete") & ~F.col("_done") & (F.col("unresolved") == 0)
    joined = joined.withColumn("_closed", F.min(F.when(closes, seq)).over(mine))
    done = F.col("_done") | F.coalesce(F.col("_closed") < seq, F.lit(False))
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when((action == "save") & done, "completed records cannot be edited")
        .when((action == "complete") & done, "already completed")
        .when((action == "complete") & (F.col("unresolved") > 0), "fields need review")
    )
    joined = joined.withColumn("reason", reason)
    saves = F.when((action == "save") & F.col("reason").isNull(), F.struct("edits"))
    kept = F.last(saves, ignorenulls=True).over(before)
    saved = F.when(kept.isNotNull(), kept["edits"]).otherwise(F.col("saved_edits"))
    ok = F.col("reason").isNull()
    return joined.select(
        "record_id", "seq", "action", "reason",
        F.when(ok, F.when(action == "assign", "assigned").when(action == "save", "in_review").otherwise("completed")).alias("review_status"),
        F.when(ok, F.when(action == "assign", F.coalesce(F.nullif("user_id", F.lit("")), "username")).when(given, F.col("_given.user_id")).otherwise(F.col("assigned_to_user_id"))).alias("assigned_to_user_id"),
        F.when(ok, F.when(action == "complete", F.coalesce("edits", saved, "ocr_result", "ocr_text")).when(action == "save", F.col("edits")).otherwise(saved)).alias("result"),
    )
