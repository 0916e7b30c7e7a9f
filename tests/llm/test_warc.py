import base64
import gzip
import hashlib
import io
import json
import os

import pytest

from slopewise.llm import warc


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        twins = [j for j, _, h in rows if j is not None and (h or "") == (html or "")]
        first = min(twins) if i is not None and len(data) >= least else i
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out)


ROWS = [(1, "http://a/é", "<p>x</p>"), (2, None, "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "http://b\r\nX-Evil: 1", None), (4, "v", ""), (0, "w", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (None, "n", "<p>x</p>"), (1, "again", "<p>x</p>"), (9, "big", "ü" * 400_000), (10, "big", "ü" * 400_000), (-5, "m", "single")]


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back(spark, tmp_path, least):
    pages = spark.createDataFrame([(i, u, h, "k") for i, u, h in ROWS], "page_id long, url string, html string, record_type string")
    index = warc.archive_pages(pages, f"file://{tmp_path}/w", least)
    got = warc.read_records(index).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain(ROWS, least)
    texts = {(i, h or "") for i, _, h in ROWS}
    assert all((r.page_id, r.payload.decode()) in texts for r in got if r.record_type == "response")
    assert not os.path.exists(tmp_path / "w/whole")
    for name in os.listdir(tmp_path / "w/members"):
        if name.endswith(".idx"):
            data = (tmp_path / "w/members" / name[:-4]).read_bytes()
            entries = [json.loads(x) for x in (tmp_path / "w/members" / name).read_text().splitlines()]
            assert sum(e["length"] for e in entries) == len(data)
            for e in entries:
                assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")


def test_whole_stream_and_members_hold_the_same_records(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>".encode() * i, None, None, i % 9 == 0) for i in range(1, 60)], "page_id long, url string, payload binary, refers_to long, refers_url string, again boolean").coalesce(2)
    whole = warc.write_monolithic(rows, f"file://{tmp_path}/whole", archive_bytes=4000).cache()
    made = whole.collect()
    assert len(made) > 4 and sum(r.records for r in made) == 59
    warc.normalise(whole, f"file://{tmp_path}/members").collect()
    written = {p.name.split("-", 2)[2]: p for p in (tmp_path / "members").glob("*.gz")}
    for r in made:
        name = r.archive.rsplit("/", 1)[1]
        first = list(warc.records_of(io.BytesIO((tmp_path / "whole" / name).read_bytes())))
        second = list(warc.records_of(io.BytesIO(written[name].read_bytes())))
        assert first == second and len(first) == r.records


def test_ids_are_unique_and_revisits_name_their_record(spark, tmp_path):
    rows = [(1, "a", "<p>"), (2, "b", "<p>"), (3, "c", "x"), (3, "c", "x"), (3, "c", "y"), (None, None, "z"), (None, None, "z")]
    index = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert index.count() == 7
    heads = [f for p in (tmp_path / "w/members").glob("*.gz") for f, _ in warc.records_of(io.BytesIO(p.read_bytes()))]
    ids = {f["warc-record-id"]: f for f in heads}
    assert len(ids) == 7
    (revisit,) = [f for f in heads if f["warc-type"] == "revisit"]
    assert ids[revisit["warc-refers-to"]]["x-page-id"] == "1" and revisit["warc-refers-to-target-uri"] == "a" and "warc-refers-to-date" in revisit


def test_damaged_archives_are_refused():
    data = warc.record(1, "u", b"payload" * 1000, None)
    packed = gzip.compress(data)
    assert len(list(warc.records_of(io.BytesIO(packed)))) == 1
    for broken in (packed[:-20], gzip.compress(data[:-200]), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises((EOFError, ValueError)):
            list(warc.records_of(io.BytesIO(broken)))
    assert list(warc.records_of(io.BytesIO(b""))) == []


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.archive_pages(pages, f"file://{tmp_path}/w")).collect() == []
