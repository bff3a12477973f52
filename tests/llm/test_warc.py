"""WARC archives: round trips, pushed predicates, broken and foreign files."""

import base64
import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from tagtriage.llm import warc

PAGES = "page_id long, url string, html string, record_type string, payload string, last string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    long = "<p>long</p>" * 200_000
    out = [(i, f"http://a/{i}", f"<html>{i % 17}</html>") for i in range(200)]
    out += [(900, "http://b/\r\nWARC-Type: warcinfo", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (901, None, None), (902, "", ""),
            (903, "http://c", long), (904, "http://d", long), (905, "http://e", "日本語 é\r\n\r\n\0"), (-3, "http://f", "<html>1</html>"),
            (None, "http://g", "<html>1</html>"), (None, "http://h", "only without id"), (77, "http://a/77", f"<html>{77 % 17}</html>")]
    return out + [(i, "http://hot", "hot") for i in range(1000, 1100)]


def brute(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        h = h or ""
        again = len(h.encode()) >= least and last.get(h, i) != i
        out.append((i, len(h.encode()), sha(h), "revisit" if again else "response", last[h] if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(4)


def collect(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 20])
def test_pages_round_trip(spark, rows, least):
    assert collect(warc.archive_pages(pages(spark, rows), least)) == brute(rows, least)


def test_empty(spark):
    assert warc.archive_pages(pages(spark, [])).collect() == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_and_headers(spark, rows, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(pages(spark, rows)), path, compression=compression, file_bytes=20_000)
    names = [n for n in os.listdir(path) if ".warc" in n]
    assert len(names) > 4  # rolled by size
    got = warc.read_warc(spark, path, partition_bytes=30_000)
    back = {r.record_id: r for r in got.collect()}
    for i, url, h in rows:
        r = back.get(f"urn:page:{i}")
        if r is None or (i, url) == (77, "http://a/77"):
            continue
        assert r.target_uri == (url.replace("\r", "%0D").replace("\n", "%0A") if url else url)
        if r.record_type == "response":
            assert bytes(r.payload) == (h or "").encode() and r.read_digest == sha(h or "")
        else:
            assert r.payload is None and r.payload_bytes == len((h or "").encode())
        assert r.headers["warc-date"] == "1970-01-01T00:00:00Z"
    if compression == "gzip":  # each member is a gzip file of one record, as other readers expect
        for n in names[:3]:
            with gzip.open(f"{path}/{n}") as f:
                assert f.read().startswith(b"WARC/1.1\r\n")


def test_predicates_are_pushed(spark, rows, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.page_records(pages(spark, rows)), path)
    df = warc.read_warc(spark, path)
    every = df.collect()
    cases = {"record_type = 'revisit'": lambda r: r.record_type == "revisit",
             "target_uri LIKE 'http://a/1%'": lambda r: (r.target_uri or "").startswith("http://a/1"),
             "target_uri NOT IN ('http://hot', 'http://b')": lambda r: r.target_uri is not None and r.target_uri != "http://hot",
             "refers_to IS NULL AND record_id <> 'urn:page:5'": lambda r: r.refers_to is None and r.record_id not in (None, "urn:page:5"),
             "record_type <=> NULL": lambda r: False,
             "record_type = 'response' AND payload_bytes > 14": lambda r: r.record_type == "response" and r.payload_bytes > 14}
    for where, keeps in cases.items():
        got = df.where(where)
        assert sorted(str(r.record_id) for r in got.collect()) == sorted(str(r.record_id) for r in every if keeps(r)), where
    plan = df.where("record_type = 'revisit'").select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan), plan


class _Counting:
    """A file that counts what is read."""

    def __init__(self, f):
        self.f, self.n = f, 0

    def read(self, n):
        out = self.f.read(n)
        self.n += len(out)
        return out

    def seek(self, at):
        return self.f.seek(at)

    def tell(self):
        return self.f.tell()


@pytest.mark.parametrize("packed", [True, False])
def test_payloads_are_passed_over(tmp_path, packed):
    data = b"".join((warc.gzip_member(r, 1) if packed else r) for i in range(20)
                    for r in [warc.record_bytes({"record_id": f"urn:page:{i}", "payload": os.urandom(1 << 20)})])
    path = tmp_path / "a"
    path.write_bytes(data)
    for wanted, accept, share in ((["record_id"], lambda r: True, 0.2), (["payload"], lambda r: r["record_id"] == "urn:page:7", 0.2),
                                  (["payload"], lambda r: True, 1)):
        with open(path, "rb") as f:
            counted = _Counting(f)
            rows = list(warc.records((warc._Gzip if packed else warc._Plain)(counted), wanted, accept))
            assert counted.n <= share * len(data) and (share < 1 or counted.n > 0.999 * len(data))
            assert [r["record_id"] for r in rows] == [f"urn:page:{i}" for i in range(20) if accept({"record_id": f"urn:page:{i}"})]


def test_foreign_archives(spark, tmp_path):
    """Members without length, several records in a member, other record types, headers in any case."""
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 4\r\nContent-Type: text/plain\r\n\r\nabcd\r\n\r\n"
    page = warc.record_bytes({"record_id": "urn:page:1", "payload": "x" * 100_000})
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page + info + page))
    (tmp_path / "b.warc").write_bytes(info + page)
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.read_warc(spark, str(tmp_path))
    assert sorted((r.record_type, r.payload_bytes) for r in got.collect()) == [("response", 100_000)] * 3 + [("warcinfo", 4)] * 3
    assert got.where("record_type = 'warcinfo'").agg(F.sum("read_bytes")).first()[0] == 12
    assert warc.read_warc(spark, str(tmp_path / "b.warc"), "record_type string").count() == 2
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(warc.record_bytes({"payload": os.urandom(9000)}))[:-3000])
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, str(tmp_path / "c.warc.gz")).collect()
    (tmp_path / "d.warc").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_warc(spark, str(tmp_path / "d.warc")).collect()


def test_only_committed_archives_count(spark, rows, tmp_path):
    path = str(tmp_path / "w")
    some = pages(spark, rows[:20])
    warc.write_warc(warc.page_records(some), path)
    (tmp_path / "w" / "part-00000-lost.warc").write_bytes(warc.record_bytes({"record_id": "urn:page:1"}))  # of a lost task
    assert warc.read_warc(spark, path).count() == 20
    warc.write_warc(warc.page_records(some), path, mode="append")
    assert warc.read_warc(spark, path).count() == 40
    warc.write_warc(warc.page_records(some), path)
    assert warc.read_warc(spark, path).count() == 20
