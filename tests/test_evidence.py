"""Choices between readings and clipped passages: ties, nulls, stops, budgets."""

import random

from formloom import constants as K
from formloom.functions import judgment as J
from formloom.operators import clips as CL
from formloom.operators import evidence as E


def score(v):
    v = v.replace(" ", "")
    thai, other = sum("๐" <= c <= "๙" for c in v), sum(c.isdigit() and not "๐" <= c <= "๙" for c in v)
    out = 3.0 * v.startswith("ผบ") + 0.5 * v.startswith("ผบ.") + ("ศต" in v) + 0.8 * ("E" in v) + {1: 3.0, 2: 1.0}.get(v.count("/"), 0.0) + 2.0 * (thai >= 4) - 0.4 * (other > 0)
    tail = v.rpartition("/")[2]
    out += 3.5 * ("/" in v and len(tail) == 4 and tail.startswith("๒๕") and tail[2:].isdigit()) + 2.5 * ("/" in v and len(tail) == 4 and tail.startswith("25") and tail[2:].isdigit() and tail[2:].isascii())
    return out - 1.2 * ("." in v and "ผบ" not in v[:4]) - 1.5 * (not 8 <= len(v) <= 22)


def test_case_numbers(spark):
    said = {"ที่ พบ.๑๒๓/๒๕๖๗ ": "ผบ.๑๒๓/๒๕๖๗", "x/y ศาลผบE12/2567-": "ผบE12/2567", "ไม่มี 12": None, "": None, None: None, "พบผบ1/2": "ผบ1/2", "a.1/2,": "a.1/2", "๑ / ๒": "๑/๒"}
    df = spark.createDataFrame([(x,) for x in said], "t string").select("t", J.case_number("t").alias("v"), J.case_number_score("t").alias("s"))
    for r in df.collect():
        assert r.v == said[r.t], r.t
        assert r.t is None or abs(r.s - score(r.t)) < 1e-9, r.t


def test_case_consensus_by_loop(spark):
    rng = random.Random(3)
    values = ["ผบ.๑๒๓/๒๕๖๗", "ผบ.๑๒๔/๒๕๖๗", "ผบE12/2567", " ", None, "12/25"]
    methods, previews, sources = ["full_page_ocr", "ocr_crop", "vision_crop", None], ["original", "cleaned", None], ["original_crop", "page", None, ""]
    rows = [(d, i, rng.choice(values), rng.choice([None, [0.1, 0.2, 0.3, float(i)]]), rng.choice(sources), rng.choice(methods), rng.choice(previews)) for d in range(60) for i in range(rng.randint(1, 7))]
    want = {}
    for d in range(60):
        groups = {}
        for r in rows:
            if r[0] == d and r[2] and r[2].strip():
                groups.setdefault(r[2].strip(), []).append(r)
        scored = []
        for v, some in groups.items():
            ms = {r[5] for r in some}
            s = score(v) + 2.3 * (len(some) - 1) + 1.8 * (len({r[6] or "" for r in some}) - 1) + 0.5 * ("full_page_ocr" in ms) + 0.7 * ("ocr_crop" in ms) + 0.6 * ("vision_crop" in ms)
            s += 1.3 * ({"full_page_ocr", "ocr_crop"} <= ms) + 0.9 * ({"ocr_crop", "vision_crop"} <= ms) + 0.2 * any("original" in (r[4] or "") for r in some)
            scored.append((round(s, 6), len(some), len(v), -some[0][1], v))
        if scored:
            s, n, _, _, v = max(scored)
            best = max(groups[v], key=lambda r: (r[3] is not None, {"vision_crop": 2, "ocr_crop": 1}.get(r[5], 0), r[6] == "original", -r[1]))
            want[d] = (v, best[3], "hybrid_case_consensus" if n > 1 else best[4] or "hybrid_case_consensus", n)
    df = spark.createDataFrame(rows, "doc long, seq int, value string, bbox array<double>, source string, method string, preview_source string").repartition(3)
    assert {r.doc: (r.value, r.bbox, r.source, r.support_count) for r in E.case_consensus(df, ["doc"]).collect()} == want
    assert E.case_consensus(df.limit(0), ["doc"]).count() == 0


def test_page_candidates(spark):
    long = "line of text that is long enough\nanother one here\nthird line of the page\nfourth\n" * 3
    rows = [
        (1, 1, 1, "original", "a", "ผบE1234/2567\n" + long), (1, 1, 2, "cleaned", "a", long * 2), (1, 1, 3, "cleaned", "b", None),
        (2, 2, 1, "original", "a", "ผบE1234/2567\n" + long), (2, 2, 2, "aggressive", "a", long * 2),
        (3, 1, 1, "original", "a", long), (3, 1, 2, "cleaned", "a", long), (4, None, 1, "cleaned", "a", " "),
    ]
    got = {r.doc: r for r in E.pick_best_candidate(spark.createDataFrame(rows, "doc long, page_number int, seq int, source string, model string, text string"), ["doc"]).collect()}
    assert (got[1].selected_source, got[1].text[:6], got[1].reasons) == ("original", "ผบE123", [E.KEPT_SERIES])
    assert [x.label for x in got[1].candidate_scores] == ["cleaned:a", "original:a", "cleaned:b"] and got[1].candidate_scores[2].score == 0.0
    assert (got[2].selected_source, got[2].candidate_source, got[2].reasons) == ("cleaned", "aggressive", [E.AGGRESSIVE])
    assert got[3].candidate_source == "original" and got[3].original_score == got[3].cleaned_score
    assert got[4].reasons == [E.NO_ORIGINAL, E.FEW_BLOCKS, E.SHORT] and got[4].original_score is None
    both = spark.createDataFrame([(1, "AB c", "abd"), (2, None, "x"), (3, " ", ""), (4, "same", "SA me")], "doc long, original string, cleaned string")
    assert {r.doc: round(r.similarity, 4) for r in E.reading_similarity(both, ["doc"]).collect()} == {1: 0.6667, 2: 0.0, 3: 0.0, 4: 1.0}


def test_decisions(spark):
    f = spark.createDataFrame([(1, "age", "30", "parser", None), (1, "gender", None, None, "ok"), (2, "age", "41", "crop_ocr", "")], "record_id long, field string, value string, source string, review_status string")
    entry = "record_id long, field string, seq int, value string, source string, action string"
    d = spark.createDataFrame([(1, "age", 2, "31", "corrected_mismatch", "30", "x"), (1, "age", 1, "9", "verified", None, None), (1, "", 1, "z", "verified", None, None)],
                              "record_id long, field string, seq int, value string, action string, previous_value string, previous_source string")
    c = spark.createDataFrame([(2, "age", 1, "", "crop", "rescued"), (9, "age", 1, "1", "crop", "rescued")], entry)
    v = spark.createDataFrame([(2, "age", 1, "40", "eye", "replaced"), (2, "age", 2, "4 1", "eye", "kept")], entry)
    dash = spark.createDataFrame([(1, "gender"), (1, "gender")], "record_id long, field string")
    got = {(r.record_id, r.field): r for r in E.decision_map(f, f, d, c, v, dash).collect()}
    assert len(got) == 3
    age = got[1, "age"]
    assert (age.derived_value, age.derived_action, age.previous_value, age.candidate_consensus) == ("31", "corrected_mismatch", "30", "single_parser")
    assert age.selection_reason == "calculated age replaced an OCR/Vision mismatch" and not age.visual_dash
    assert got[1, "gender"].selection_reason == "source image showed a dash in this field" and got[1, "gender"].candidate_consensus is None
    other = got[2, "age"]
    assert (other.crop_value, other.vision_value, other.vision_action, other.candidate_consensus) == ("41", "4 1", "kept", "confirmed_by_parser_crop_vision")


def clip(spark, pages):
    rows = [(k, p, i, t, [0.1, float(i), 0.2, i + 1.0] if t else None) for (k, p), texts in pages.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "k long, page_number int, seg_no int, text string, bbox array<double>")


def test_clips(spark):
    start = "ข้อ พิพากษาให้ จำเลย"
    many = [start] + [f"s{i}" for i in range(40)]
    pages = {
        (1, 1): ["head", start, None, " ", "สำหรับศาลใช้ 1", "x", "ให้เป็น", "พับ", "after"], (2, 1): [start, "a", "ผู้เขียน b", "c"], (3, 1): many,
        (4, 1): [start, "y" * 1399, "z"], (5, 1): ["ชำระเงิน 5", "x"], (6, 1): ["nothing"], (7, 1): [start + " ผู้เขียน", "ก"] + list("ให้เป็นพับ./") + ["gone"],
    }
    got = {r.k: r for r in CL.clip_passage(clip(spark, pages), ["k", "page_number"]).collect()}
    assert set(got) == {1, 2, 3, 4, 7}
    assert (got[1].text, got[1].segments, got[1].ended) == (f"{start} x ให้เป็น พับ", 4, True) and got[1].bbox == [0.1, 1.0, 0.2, 8.0]
    assert (got[2].text, got[2].ended) == (f"{start} a", False)
    assert got[3].segments == K.PASSAGE_SEGMENTS and got[4].segments == 2 and got[4].chars >= K.PASSAGE_CHARS
    assert got[7].ended and "gone" not in got[7].text and got[7].text.endswith("พ ั บ")
    assert CL.clip_passage(clip(spark, pages).limit(0), ["k", "page_number"]).count() == 0


def test_passage_over_pages(spark):
    start = "พิพากษาให้จำเลย"
    pages = {
        (1, 1): ["cover"], (1, 2): [start, "a"], (1, 3): ["(12 พ.)", "สำหรับ", "5)", "b"], (1, 4): ["c", "พับ./", "d"], (1, 5): ["e"],
        (2, 1): [start, "พับ./"], (2, 2): ["f"], (3, 4): [start], (3, 9): ["g"], (3, 8): ["(1 พ.)"], (4, 1): ["none"],
    }
    got = sorted((r.k, r.page_number, r.continues, r.text) for r in CL.passage_across_pages(clip(spark, pages), "k").collect())
    assert got == [(1, 2, 0, f"{start} a"), (1, 3, 1, "b"), (1, 4, 1, "c พับ./"), (2, 1, 0, f"{start} พับ./"), (3, 4, 0, start), (3, 9, 1, "g")]
