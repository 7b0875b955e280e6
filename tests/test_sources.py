"""File sources over written folders: suffixes, bad manifests, marks, missing references."""

import hashlib
import json

from formloom.operators import location
from formloom.sources import files as S


def test_inbox(spark, tmp_path):
    names = ["b.PDF", "a.pdf", "note.txt", "c d+e%.Png", "x.jpeg", "pdf", "ก.jpg"]
    for i, n in enumerate(names):
        (tmp_path / n).write_bytes(bytes([i]) * (i + 1))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "inner.pdf").write_bytes(b"z")
    got = S.scan_inbox(spark, str(tmp_path)).collect()
    want = [n for n in names if n.lower().endswith(S.INBOX_SUFFIXES)]
    assert [r.name for r in got] == sorted(want)
    assert {r.name: (r.size, r.fingerprint) for r in got} == {n: (i + 1, hashlib.sha1(bytes([i]) * (i + 1)).hexdigest()) for i, n in enumerate(names) if n in want}
    assert [r.name for r in S.scan_inbox(spark, str(tmp_path), recursive=True).collect()] == sorted([*want, "inner.pdf"])


def test_manifests(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_bytes(data)

    record = {"record_id": "r1", "page_number": 2, "ocr_status": "failed", "unknown": [1, {"a": 2}]}
    one = {"batch_id": "b1", "created_at": "2024-01-02", "file_count": 1, "files": [{"file_id": "f1", "page_count": 3}], "records": [record, {**record, "record_id": "r2", "batch_id": "own"}]}
    put("b1", json.dumps(one, indent=2).encode())
    put("b2", b"\xef\xbb\xbf" + json.dumps({"batch_id": "b2", "created_at": "2024-03-01", "records": None}).encode())
    put("b3", json.dumps({"batch_id": "b3", "files": []}).encode())
    put("list", b"[{\"batch_id\": \"no\"}]")
    put("text", b"\"batch\"")
    put("cut", b"{\"batch_id\": \"x\", \"files\": [")
    put("typed", b"{\"batch_id\": \"x\", \"file_count\": \"many\"}")
    put("empty", b"")
    put("blank", b" \n ")
    put("binary", b"\xff\xfe{}")
    (tmp_path / "b1" / "other.json").write_text("{}")
    manifests = S.read_manifests(spark, str(tmp_path))
    assert [r.batch_id for r in S.batches(manifests).collect()] == ["b2", "b1", "b3"]
    assert [(r.batch_id, r.file_seq, r.file_id, r.page_count) for r in S.batch_files(manifests).collect()] == [("b1", 0, "f1", 3)]
    assert sorted((r.batch_id, r.record_id, r.record_seq, r.page_number) for r in S.batch_records(manifests).collect()) == [("b1", "r1", 0, 2), ("own", "r2", 1, 2)]
    bad = {r.path.split("/")[-2]: r.reason for r in S.quarantine(manifests).collect()}
    assert bad == {"list": "not an object", "text": "not an object", "cut": "not readable", "typed": "not readable", "blank": "empty", "binary": "not UTF-8"}


def test_location_reference(spark, tmp_path):
    put = lambda n, v, mark=b"": (tmp_path / n).write_bytes(mark + json.dumps(v, ensure_ascii=False).encode())
    put("provinces.json", [{"provinceCode": 1, "provinceNameTh": "ก"}, {"provinceCode": "x", "provinceNameTh": "ข"}, {"provinceNameTh": " "}], b"\xef\xbb\xbf")
    put("districts.json", [{"districtCode": "10", "provinceCode": 1, "districtNameTh": "ค"}])
    put("subdistricts.json", [{"provinceCode": 1, "districtCode": 10, "subdistrictNameTh": "ง", "postalCode": 10200}])
    p, d, s = S.read_location_reference(spark, str(tmp_path))
    assert sorted((r.province_code, r.province) for r in p.collect()) == [(0, " "), (0, "ข"), (1, "ก")]
    assert [(r.province, r.district, r.subdistrict, r.postal_code) for r in location.location_dim(p, d, s).collect()] == [("ก", "ค", "ง", "10200")]
    put("districts.json", {"not": "a list"})
    (tmp_path / "subdistricts.json").unlink()
    p, d, s = S.read_location_reference(spark, str(tmp_path))
    assert d.count() == 0 and s.count() == 0 and p.count() == 3 and location.location_dim(p, d, s).count() == 0
