import gzip
import hashlib

import pyarrow.fs as fs
import pytest

from pulsegrid.llm import warc
from pulsegrid.llm.common import written

LONG = "<p>équal</p>\r\n\r\n" * 100
ROWS = [
    (1, "https://www.a.example.com/x?q=1", LONG),
    (2, "http://b.example.org:8080/y", LONG),
    (9, None, LONG),
    (4, "https://a.example.com/", "short"),
    (5, "https://a.example.com/", "short"),
    (6, "not a url \t\r\nX-Evil: 1", None),
    (7, "http://[bad", ""),
    (8, "https://a.example.com/z", "x" * 300000),
    (3, "https://ünï.example.com/é", LONG + "!"),
    (-5, "https://a.example.com/neg", LONG + "!"),
    (None, "https://a.example.com/none", LONG),
    (None, "https://a.example.com/none", "lone" * 500),
    (8, "https://a.example.com/z", "x" * 300000),
]
DDL = "page_id long, url string, html string, payload string, key string"


def brute(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [i for i, _, h in rows if h == html and i is not None]
        largest = max(ids) if ids and len(payload) >= 1000 else None
        refers = largest if page_id != largest and largest is not None else None
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers, (html or "") if refers is None else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DDL).repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == brute(ROWS)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("lines", [2, 3])
def test_small_blocks_and_lookups(spark, monkeypatch, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DDL).repartition(4)
    folder, blocks = warc.archive(df)
    table = warc.directory(blocks)
    assert len(table) >= len(ROWS) / lines and all(a[1] <= b[0] for a, b in zip(table, table[1:]))
    wanted = [warc.line_key(ROWS[0][1], 1), warc.line_key(ROWS[7][1], 8), "com,example,nowhere) 1", warc.line_key(None, 9)]
    keys = spark.createDataFrame([(k,) for k in wanted], "key string")
    found = warc.lookup(keys, blocks)
    assert sorted(r.key for r in found.collect()) == sorted([wanted[0], wanted[1], wanted[1], wanted[3]])
    assert sorted(r.page_id for r in warc.fetch(written(found, "found"), folder).collect()) == [1, 8, 8, 9]


@pytest.mark.parametrize("url,page_id", [("https://a.example.com/same", 5), (None, None), ("https://a.example.com/" + "long" * 80, 6)])
def test_a_key_that_fills_many_blocks(spark, monkeypatch, url, page_id):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "ASKED", 3)
    rows = [(page_id, url, "short")] * 23 + [(i, f"{url}/{i}", LONG) for i in range(10, 19)] + ROWS
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DDL).repartition(5)
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == brute(rows)


def test_archives_are_plain_warc(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DDL).coalesce(1)
    folder, _ = warc.archive(df)
    system, root = fs.FileSystem.from_uri(folder)
    files = [f for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".warc.gz")]
    data = b"".join(gzip.decompress(system.open_input_stream(f.path, compression=None).read()) for f in files)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: re") and data.count(b"WARC-Record-ID: ") == len(ROWS)
    assert b"\r\nX-Evil" not in data and b"%0D%0AX-Evil:%201" in data


def test_damage_is_found():
    good = warc.record(1, "http://a.b/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parsed(good)[:2] == (1, 7)
    for bad in (good.replace(b"payload", b"paylood"), good[:-3], good + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_keys_sort_by_reversed_host():
    assert warc.surt("https://www.Sub.Example.com:81/A?b#c") == "com,example,sub:81)/a?b"
    assert warc.line_key("http://a.b/", 2) < warc.line_key("http://a.b/", 10) and warc.line_key("http://a.b/", -1) < warc.line_key("http://a.b/", 0)


def test_sql_agrees(spark):
    import duckdb
    import pandas as pd

    rows = [r for r in ROWS if r[0] is not None]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    theirs = con.sql(warc.ROUND_TRIP_SQL)
    mine = warc.round_trip(spark.createDataFrame([(*r, "x", "y") for r in rows], DDL), with_payload=False).collect()
    assert sorted(theirs.fetchall(), key=str) == sorted((tuple(r[n] for n in theirs.columns) for r in mine), key=str)
