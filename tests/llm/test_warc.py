import gzip
import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliant.llm import warc


def brute(rows, least=1000):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[(h or "").encode()].append(p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[b] if x is not None]
        revisit = len(b) >= least and len(groups[b]) > 1 and bool(ids) and p != max(ids)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


def rows():
    long_one, other = "<p>é" * 400, "x" * 999
    out = [(i, f"http://h{i % 7}.Example.com/p/{i}?q#f", f"<p>{i}</p>" * (i * 3)) for i in range(60)]
    out += [(100 + i, f"https://copy.example.org/{i % 2}", long_one) for i in range(40)]
    out += [(200, "http://a.b/", other), (201, "http://a.b/", other), (202, None, None), (203, "", ""), (204, "no scheme", "z" * 2000), (None, "http://n/", long_one), (205, "http://a.b/\nc", "y" * 3_000_000), (206, "http://é.com/", "\r\n\r\n" * 400), (206, "http://é.com/", "\r\n\r\n" * 400)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string").repartition(5)


def test_round_trip(spark, tmp_path):
    pages = frame(spark, rows())
    captures = warc.write_archives(pages, f"file://{tmp_path}/a")
    files = warc.write_index(captures, f"file://{tmp_path}/i", lines=7)
    got = warc.read_records(warc.lookup(pages, files)).drop("url", "payload")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows())
    one = pages.where("page_id = 101").union(spark.createDataFrame([(1, "http://unknown/", "", "")], pages.schema))
    found = warc.read_records(warc.lookup(one, files)).collect()
    assert Counter(r.page_id for r in found) == Counter(range(101, 140, 2))
    assert {r.page_id: r.payload for r in found}[139] == ("<p>é" * 400).encode() if 139 in {r.page_id for r in found if r.record_type == "response"} else True
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").iterdir())
    assert text.count(b"WARC/1.1\r\n") == len(rows()) and text.count(("<p>é" * 400).encode()) == 1


def test_keys_and_empty(spark, tmp_path):
    keys = spark.createDataFrame([("http://www.Example.com/A?b#c",), (None,), ("plain",)], "url string").select(warc.surt(F.col("url"))).collect()
    assert [r[0] for r in keys] == ["com,example,www)/A?b", "", "plain"]
    pages = frame(spark, rows()).limit(0)
    files = warc.archive(spark, pages, str(tmp_path))
    assert files == [] and warc.read_records(warc.lookup(frame(spark, rows()), files)).count() == 0
