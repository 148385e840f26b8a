import hashlib
import uuid

import pytest

from marketmood.llm import warc
from marketmood.session import checkpoint_dir


def fresh(spark):
    return f"{checkpoint_dir(spark)}/test-warc-{uuid.uuid4().hex}"


def parse(record):
    head, _, rest = bytes(record).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    assert lines[0] == "WARC/1.1" and rest.endswith(b"\r\n\r\n")
    block = rest[:-4]
    assert len(block) == int(fields["Content-Length"])
    return fields, block


ROWS = [(1, "http://a.test/", "x" * 999), (2, "http://a.test/2", "x" * 999), (3, "http://b.test/", "é" * 500), (4, None, "é" * 500),
        (5, "u\r\nX: y", "é" * 500), (6, "http://c.test/", None), (7, "http://d.test/", ""), (None, "http://e.test/", "é" * 500),
        (8, "http://f.test/", "z" * 3000), (8, "http://f.test/", "z" * 3000), (9, "http://g.test/", "WARC-Type: revisit\r\n\r\n" * 90)]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'c' AS header", "1 AS bytes")
    archive = warc.write(pages, fresh(spark))
    stored = archive.payloads(spark).collect()
    assert len(stored) == len({(t or "") for _, _, t in ROWS})
    got = warc.read(spark, archive).collect()
    assert len(got) == len(ROWS)
    bodies = {i: (t or "").encode() for i, _, t in ROWS}
    kinds = {}
    for r in got:
        fields, block = parse(r["record"])
        assert bytes(r["payload"]) == bodies[r["page_id"]]
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bodies[r["page_id"]]).hexdigest()
        assert block == (b"" if fields["WARC-Type"] == "revisit" else bodies[r["page_id"]])
        assert "\n" not in fields["WARC-Target-URI"]
        kinds.setdefault(r["page_id"], []).append((fields["WARC-Type"], r["refers_to"]))
        if fields["WARC-Type"] == "revisit":
            keeper = next(parse(k["record"])[0] for k in got if k["page_id"] == r["refers_to"])
            assert fields["WARC-Refers-To"] == keeper["WARC-Record-ID"] and keeper["WARC-Type"] == "response"
    assert kinds[1] == kinds[2] == kinds[6] == kinds[7] == [("response", None)]
    assert kinds[3] == kinds[4] == kinds[None] == [("revisit", 5)] and kinds[5] == [("response", None)]
    assert kinds[8] == [("response", None)] * 2 and kinds[9] == [("response", None)]


def test_damaged_payload_is_found(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    archive = warc.write(pages, fresh(spark))
    other = warc.Archive(fresh(spark))
    archive.headers(spark).write.parquet(f"{other.path}/headers")
    archive.payloads(spark).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{other.path}/payloads")
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read(spark, other).collect()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(pages, fresh(spark))).count() == 0


def test_writing_fails_on_two_payloads_with_one_digest(spark, monkeypatch):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "digest", lambda payload: F.substring(F.sha2(payload, 256), 1, 0))
    same = pages.filter("page_id IN (3, 4, 5)")
    assert warc.read(spark, warc.write(same, fresh(spark))).count() == 3
    with pytest.raises(Exception, match="two payloads with one digest"):
        warc.write(pages.filter("page_id IN (3, 6)"), fresh(spark))
    with pytest.raises(Exception, match="two payloads with one digest"):  # of one length
        warc.write(pages.filter("page_id IN (1, 8)").withColumn("html", F.substring("html", 1, 900)), fresh(spark))
