"""Streams run to their end over small files."""

from pyspark.sql import functions as F

from formloom.streaming import jobs as J


def run(spark, stream, mode, folder, name):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def source(spark, folder, rows, schema, files=2):
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return J.inbox(spark, f"{folder}/in", schema, files_a_batch=1)


def test_counts_of_latest_states(spark, tmp_path):
    schema = "record_id string, batch_id string, status string, seq long"
    rows = [("r1", "b1", "assigned", 1), ("r2", "b1", "assigned", 2), ("r3", "b2", None, 3), ("r1", "b1", "in_review", 4), ("r2", "b1", "assigned", 5), ("r1", "b1", "completed", 6), ("r3", "b2", "assigned", 8), ("r3", "b2", "failed", 7)]
    for i, part in enumerate((rows[:3], rows[3:6], rows[6:7], rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = J.inbox(spark, f"{tmp_path}/in", schema)
        query = J.status_changes(stream).writeStream.foreachBatch(J.keep_counts(f"{tmp_path}/counts")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        last = max(int(p.name[1:]) for p in (tmp_path / "counts").iterdir())
    got = sorted((r.batch_id, r.status, r.n) for r in spark.read.parquet(f"{tmp_path}/counts/v{last}").collect())
    assert got == [("b1", "assigned", 1), ("b1", "completed", 1), ("b2", "assigned", 1)]


def test_inbox_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"1"), ("b.txt", b"2"), ("c.JPG", b"1")):
        (tmp_path / "in" / name).write_bytes(data)
    got = run(spark, J.inbox_files(spark, f"{tmp_path}/in", 1), "append", tmp_path, "files")
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["a.pdf", "c.JPG"] and len({r.fingerprint for r in got}) == 1


def test_learned_over_batches(spark, tmp_path):
    schema = "record_id string, field string, seq long, before string, after string"
    learn = J.learned_batches(f"{tmp_path}/learned")
    learn(spark.createDataFrame([("r1", "personName", 1, "ทอง ดี", "คำ ดี"), ("r2", "motherName", 2, "ทอง", "คำ")], schema), 0)
    learn(spark.createDataFrame([("r3", "personName", 3, "ทอง มา", "คำ มา")], schema), 1)
    learn(spark.createDataFrame([("r3", "personName", 3, "ทอง มา", "คำ มา")], schema), 1)  # runs again
    (got,) = J.learned_so_far(spark, f"{tmp_path}/learned", examples=2).collect()
    assert (got.source, got.replacement, got["count"], got.fields) == ("ทอง", "คำ", 3, ["motherName", "personName"])
    assert [e.before for e in got.examples][0] == "ทอง มา" and len(got.examples) == 2


def test_review_states_refuse_illegal_moves(spark, tmp_path):
    rows = [("r1", 1, "assigned"), ("r1", 2, "in_review"), ("r1", 3, "assigned"), ("r1", 4, "completed"), ("r1", 5, "in_review"), ("r2", 1, "completed")]
    got = run(spark, J.review_states(source(spark, tmp_path, rows, "record_id string, seq long, status string", files=1)), "append", tmp_path, "states")
    assert sorted((r.record_id, r.seq, r.status, r.accepted) for r in got) == [
        ("r1", 1, "assigned", True), ("r1", 2, "in_review", True), ("r1", 3, "in_review", False), ("r1", 4, "completed", True), ("r1", 5, "completed", False), ("r2", 1, "unassigned", False)]


def test_ingest_across_batches(spark, tmp_path):
    rows = [("a", "f1", "tr", "t1", 1), ("b", "f2", "tr", "t2", 2), ("c", "f1", "judgment", "t3", 3), ("d", "f3", "", "t4", 4)]
    schema = "id string, source_fingerprint string, document_category string, seen_at string, seq long"
    stream = source(spark, tmp_path, rows, schema, files=2)
    query = stream.writeStream.foreachBatch(J.ingest_batches(f"{tmp_path}/store")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = J.read_store(spark, f"{tmp_path}/store").collect()
    assert sorted(r.source_fingerprint for r in last) == ["f1", "f2", "f3"] and all(r.status == "ocr_queued" for r in last)


def test_ingest_keeps_versions_and_untouched_parts(spark, tmp_path):
    store, merge = f"{tmp_path}/store", J.ingest_batches(f"{tmp_path}/store")
    batch = lambda *rows: spark.createDataFrame(rows, "id string, source_fingerprint string, document_category string, seen_at string, seq long")
    merge(batch(("a", "f1", "tr", "t1", 1), ("b", "f2", "judgment", "t2", 2)), 0)
    # both were read by the newest pipelines
    read = J.read_store(spark, store).withColumns({"status": F.lit("review_ready"), "ocr_pipeline_version": F.lit("80"), "ocr_markdown": F.lit("text"), "version": F.lit(1)})
    read.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(store)
    merge(batch(("c", "f2", "judgment", "t3", 3), ("d", "f3", "tr", "t4", 4)), 2)
    merge(batch(("c", "f2", "judgment", "t3", 3), ("d", "f3", "tr", "t4", 4)), 2)  # runs again
    got = {r.source_fingerprint: (r.id, r.status, r.updated_at, r.ocr_pipeline_version) for r in J.read_store(spark, store).collect()}
    assert got == {"f1": ("a", "review_ready", "t1", "80"), "f2": ("b", "review_ready", "t3", "80"), "f3": ("d", "ocr_queued", "t4", None)}


def test_first_of_each_text(spark, tmp_path):
    rows = [("f1", "2024-01-01 00:00:00"), ("f1", "2024-01-01 01:00:00"), ("f2", "2024-01-01 02:00:00")]
    typed = source(spark, tmp_path, rows, "source_fingerprint string, at string", files=1).withColumn("ts", F.to_timestamp("at"))
    assert sorted(r.source_fingerprint for r in run(spark, J.first_of_each_text(typed), "append", tmp_path, "firsts")) == ["f1", "f2"]


def test_learned_counts(spark, tmp_path):
    rows = [("ทอง ดี", "คำ ดี"), ("นาย ทอง", "นาย คำ"), ("ทอง", "ทอง ดี"), (None, "ก")]
    got = run(spark, J.learned_counts(source(spark, tmp_path, rows, "before string, after string")), "complete", tmp_path, "learned")
    assert [(r.source, r.replacement, r["count"]) for r in got] == [("ทอง", "คำ", 2)]


def test_waiting_documents_are_queued_again(spark):
    docs = spark.createDataFrame([("a", "cleaning"), ("b", "checked"), ("c", "uploaded"), ("d", None)], "id string, status string")
    assert sorted((r.id, r.status) for r in J.queue_again(docs).collect()) == [("a", "ocr_queued"), ("c", "ocr_queued")]
    assert [r.id for r in J.queue_again(docs.withColumn("created_at", F.reverse("status")), "created_at", "id").collect()] == ["c", "a"]
