import base64
import gzip
import hashlib
from collections import Counter

import pyarrow.fs as pafs

from treeline.llm import common, warc


def test_many_repeated_payloads_are_joined(spark, monkeypatch):
    rows = [(k, f"u{k}", f"<p>{k % 7}</p>") for k in range(60)] + [(100, "u", None), (101, "u", ""), (None, "u", "<p>1</p>"), (102, "u", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(map(str, warc.mark_revisits(pages).collect()))
    monkeypatch.setattr(warc, "SHARED", 0)
    assert sorted(map(str, warc.mark_revisits(pages).collect())) == one


def slow(pages):
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        first = least.get(h or "", i)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (0, "http://c/\r\nX: y", "é" * 5), (7, "u", None), (3, "u", ""), (4, "u", "\r\n\r\nWARC/1.1\r\n"), (5, "u", "x" * 300_000), (6, "u", "<p>one</p>"),
    (8, "u", "twin"), (8, "u", "twin"), (None, "u", "no id"), (None, "u", "<p>one</p>"),
]


def frame(spark):
    return spark.createDataFrame([(*p, 3, "z") for p in PAGES], "page_id long, url string, html string, offset int, Archive string").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark, small):
    assert rows(warc.archive_and_read(frame(spark))) == slow(PAGES)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert rows(warc.archive_and_read(pages)) == slow([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_files_and_selected_reads(spark, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    folder = common.scratch(spark, "test-warc")
    index = warc.write(frame(spark), folder)
    store, root = pafs.FileSystem.from_uri(folder)
    kinds = Counter()
    for name in {r.archive for r in index.select("archive").collect()}:
        data = store.open_input_file(f"{root}/{name}").read()
        whole = gzip.decompress(data)
        kinds["records"] += sum(1 for r in index.where(f"archive = '{name}'").collect() if gzip.decompress(data[r.offset : r.offset + r.length]).startswith(b"WARC/1.1\r\n") and gzip.decompress(data[r.offset : r.offset + r.length]) in whole)
    assert kinds["records"] == len(PAGES)
    some = warc.read(index.where("page_id in (0, 5, 6)"), folder).collect()
    assert {r.page_id: r.payload and len(r.payload) for r in some} == {0: 10, 5: 300_000, 6: None}
    assert {r.url for r in some if r.page_id == 5} == {"u"}


def test_ranges_are_joined():
    rows_ = [{"archive": "a", "offset": o, "length": 10} for o in (0, 10, 25, 10**6)] + [{"archive": "b", "offset": 10**6 + 10, "length": 5}]
    assert [len(r) for r in warc.ranges(rows_)] == [3, 1, 1]


def test_empty_table(spark):
    assert warc.archive_and_read(frame(spark).limit(0)).collect() == []
