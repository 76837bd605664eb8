import base64
import hashlib

from tidewake.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [(1, "http://a/", "<p>x</p>", "z"), (2, "http://b/", "<p>x</p>", "z"), (3, None, "é😀\r\n\r\nWARC/1.1\r\n", "z"), (4, "http://c/\nd", None, "z"), (5, "u", "", "z"), (None, "n", "<p>x</p>", "z"), (None, "n", "alone", "z"), (7, "l", "long " * 50_000, "z")]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, r.payload) for r in warc.round_trip(spark.createDataFrame(ROWS, SCHEMA)).collect())
    top = {"<p>x</p>": 2, "": 5}
    want = []
    for i, _, t, _ in ROWS:
        t = t or ""
        again = t in top and top[t] != i
        want.append((i or 0, len(t.encode()), digest(t), "revisit" if again else "response", top[t] if again else 0, None if again else t))
    assert got == sorted(want)


def test_least_payload_and_empty(spark):
    r = warc.round_trip(spark.createDataFrame(ROWS, SCHEMA), least=100)
    assert r.where("record_type = 'revisit'").count() == 0 and r.count() == len(ROWS)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pushed_predicates_and_planning(spark, tmp_path):
    p = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(spark.createDataFrame(ROWS, SCHEMA)).repartition(4), p)
    df = warc.read_warc(spark, p, partition_bytes=100)
    assert df.rdd.getNumPartitions() >= 2
    q = warc.read_warc(spark, p, where="record_type = 'revisit' AND payload_bytes >= 1")
    assert "Filter" not in q._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert {r.page_id for r in q.collect()} == {1, None}
    assert warc.read_warc(spark, p, payload=False).where("payload IS NOT NULL").count() == 0
    assert df.where("record_type = 'revisit'").count() == 3 and df.count() == len(ROWS)
    reader = warc.WarcReader({"onequery": "true"}, df.schema)
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("target_uri",), "x"), EqualTo(("payload",), "x")]))
    assert len(left) == 2 and len(reader.tests) == 1


def test_damage_is_found(spark, tmp_path):
    import pytest

    (tmp_path / "w").mkdir()
    page = warc.plan_records(spark.createDataFrame(ROWS[:1], SCHEMA)).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to").first()
    (tmp_path / "w" / "a.warc").write_bytes(warc._record(*page).replace(b"<p>x", b"<p>y"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(spark, str(tmp_path / "w")).collect()


def test_members_are_read_alone_and_skipped_without_inflating(spark, tmp_path):
    """Other readers of gzip see the same records; files are begun anew at a size; broken payloads behind a predicate are never touched."""
    import gzip

    p = tmp_path / "w"
    warc.write_warc(warc.plan_records(spark.createDataFrame(ROWS, SCHEMA)).coalesce(1), str(p), partition_bytes=600)
    found = sorted(p.glob("part-*"))
    assert len(found) > 1 and not list(p.glob("_part*"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: ") for f in found) == len(ROWS)
    whole = tmp_path / "x"
    whole.mkdir()
    (whole / "one.warc.gz").write_bytes(gzip.compress(b"".join(gzip.decompress(f.read_bytes()) for f in found)))
    (whole / "two.warc").write_bytes(gzip.decompress(found[0].read_bytes()))
    assert warc.read_warc(spark, str(whole)).count() > len(ROWS)
    for f in found:
        b = bytearray(f.read_bytes())
        b[-8:] = b"\0" * 8
        if len(b) > 2000:
            b[-300:-8] = b"\xff" * 292
        f.write_bytes(bytes(b))
    assert warc.read_warc(spark, str(p), payload=False, where="record_type = 'response'").count() == len(ROWS) - 3
