import base64
import hashlib
import re

import pytest

from reachspark.llm import warc

FAKE = "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [(i, f"http://a/{i}", f"<html>{'x' * (i % 9)} {'é' * (i % 4)} {i % 30}</html>") for i in range(60)] + [
    (100, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (101, "a\r\nContent-Length: 1", "a WARC/1. b"), (102, "u", FAKE * 3), (103, "u", FAKE * 3), (104, "u", None), (105, None, ""), (106, "u", "WARC/1."), (107, "u", "x\r\n\r\n"), (108, "u", "é" * 3000 + "WARC/1.1\r\n\r\n\r\n")]


@pytest.mark.parametrize("split", ["128m", "700"])
def test_round_trip(spark, tmp_path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        path = str(tmp_path / "w")
        warc.write(spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, payload int").repartition(2), path, records_per_file=25)
        got = warc.records(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(ROWS)
    by = {r.page_id: r for r in got}
    for i, _, h in ROWS:
        data, first = (h or "").encode(), min(j for j, _, x in ROWS if (x or "") == (h or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (by[i].told_digest, by[i].told_bytes, by[i].refers_to) == (digest, len(data), None if first == i else first)
        assert by[i].record_type == ("response" if first == i else "revisit") and (first != i or by[i].found_digest == digest)


def test_headers_are_proper(spark, tmp_path):
    path = tmp_path / "w"
    warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string").coalesce(1), str(path))
    text = "".join(f.read_bytes().decode() for f in path.glob("part-*"))
    ids = re.findall(r"WARC-Record-ID: (<urn:uuid:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}>)", text)
    assert len(set(ids)) == 3 and text.count("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/") == 2 and re.findall("WARC-Refers-To: (.*)\r", text) == [ids[0]] * 2
    assert text.count("HTTP/1.1 200 OK\r\n") == 1 and f"Content-Length: {len(warc.HTTP) + 2}\r\n\r\n{warc.HTTP}ab\r\n\r\n" in text


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of every row: of equal payloads the least page_id is the response, null last."""
    data = [(h or "").encode() for _, h in rows]
    first = {}
    for k, (i, _) in enumerate(rows):
        d = data[k]
        if d not in first or (i is not None and (rows[first[d]][0] is None or i < rows[first[d]][0])):
            first[d] = k
    digest = lambda d: base64.b32encode(hashlib.sha1(d).digest()).decode()
    return sorted(((i, len(d), digest(d), "response" if first[d] == k else "revisit", None if first[d] == k else rows[first[d]][0]) for k, ((i, _), d) in enumerate(zip(rows, data, strict=True))), key=str)


def test_query_matches_brute_force(spark, sf, tmp_path):
    as_rows = lambda df: sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.filter("payload_ok").collect()), key=str)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert as_rows(warc.query(spark, sf)) == brute([(r.page_id, r.html) for r in pages.collect()])
    odd = [(5, "x"), (None, "x"), (5, "x"), (5, "y"), (None, None), (None, ""), (7, FAKE), (None, FAKE), (9, "z")]
    spark.createDataFrame([(i, "u", h, 0) for i, h in odd], "page_id long, url string, html string, w_row int").write.parquet(str(tmp_path / "pages.parquet"))
    assert as_rows(warc.query(spark, str(tmp_path))) == brute(odd)


def test_broken_chain_is_told(spark, tmp_path):
    path = tmp_path / "w"
    path.mkdir()
    good = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (path / "a.txt").write_bytes((good + good.replace("ID: 1", "ID: 2").replace("Length: 2", "Length: 9") + good.replace("ID: 1", "ID: 3")).encode())
    assert {r.page_id for r in warc.records(spark, str(path), strict=False).collect()} == {1, 2}
    with pytest.raises(ValueError, match="breaks in"):
        warc.records(spark, str(path))


def test_small_payloads_stay_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r.page_id: r.w_first and r.w_first.page_id for r in warc.with_types(df, min_bytes=3, broadcast_payloads=0).collect()} == {1: None, 2: None, 3: None, 4: 3}
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.records(spark, str(tmp_path / "none")).count() == 0
