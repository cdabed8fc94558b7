import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from clickloom.llm import warc
from clickloom.storage import new_path

SCHEMA = "page_id long, url string, html string, payload int, name string"
LONG = "<html>" + "ä page " * 400


def pages(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{'text ' * (i % 9)}{i}</p>" * (1 + i % 40), 1, "x") for i in range(300)]
    rows += [(301, None, None, 2, "y"), (302, "", "", 3, None), (None, "http://a b\r\nc\x7f/ü", LONG, 4, None), (303, "u", LONG, 5, "z"),
             (304, "u", LONG, 5, "z"), (304, "u", LONG, 5, "z"), (305, "v", "short", 0, ""), (306, "v", "short", 0, ""),
             (None, "w", LONG * 2, 0, ""), (None, "w", LONG * 2, 0, ""), (307, "big", "<b>" + "0123456789" * 300_000, 0, ""),
             (308, "crlf", "\r\n\r\nWARC/1.1\r\n" * 100, 0, "")]
    return spark.createDataFrame(rows, SCHEMA), rows


def expected(rows):
    last = {}
    for i, _, html, *_ in rows:
        last.setdefault(html or "", []).append(i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        keep = max((x for x in last[html or ""] if x is not None), default=None)
        revisit = len(data) >= 1000 and keep is not None and i != keep
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return out


def written(spark, **options):
    df, rows = pages(spark)
    path = new_path(spark, "warc-test")
    warc.write_archives(df.repartition(2), path, **options)
    return spark.read.parquet(path), rows


@pytest.mark.parametrize("size", [1, 100_000, 16 << 20])
def test_round_trip(spark, size):
    archives, rows = written(spark, size=size)
    got = warc.sound(warc.read_archives(archives, payloads=True)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected(rows), key=key)
    html = {(r[0], len((r[2] or "").encode())): (r[2] or "") for r in rows}
    assert all(r.payload.decode() == html[r.page_id, r.payload_bytes] for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id in (301, 302)} == {None, ""}
    assert "http://a%20b%0D%0Ac%7F/ü" in {r.url for r in got}


def test_empty_table(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark.read.schema("name string, content binary").parquet(path)).count() == 0


def test_archives_in_files(spark, tmp_path):
    archives, rows = written(spark, size=50_000)
    warc.export_archives(archives, str(tmp_path))
    files = sorted(tmp_path.iterdir())
    assert [f.name for f in files] == sorted(r.name for r in archives.select("name").collect())
    content = files[0].read_bytes()
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(content[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: re")
    read = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path)), name="path")
    assert read.count() == len(rows) and read.where("error IS NOT NULL").count() == 0


def row(page_id=1, payload=b"x" * 50, **change):
    raw = warc.record(page_id, "u", payload, hashlib.sha1(payload).hexdigest())
    for old, new in change.values():
        assert old in raw
        raw = raw.replace(old, new)
    return raw


def test_damaged_archives(spark):
    good = [row(i) for i in range(5)]
    plain, other = warc.archive(good, []), warc.archive([row(9, b"%d lines of text" % i * 30) for i in range(200)], [b"%d lines of text" % i * 30 for i in range(200)])
    bad = warc.archive([row(1), row(2, length=(b"Content-Length: 50", b"Content-Length: 51")), row(3, gone=(b"WARC-Date", b"X-Date")), b"junk", row(4)], [])
    flipped = bytearray(other)
    flipped[12] ^= 255
    rows = [("plain", plain), ("dict", other), ("cut", plain[:-3]), ("bad", bad), ("junk", b"not an archive"), ("none", None), ("empty", b""), ("flip", bytes(flipped)),
            ("late", struct.pack("<II", 0x184D2A50, 4) + b"skip" + plain)]
    read = warc.read_archives(spark.createDataFrame(rows, "name string, content binary"))
    got = {r.name: (r.n, r.bad) for r in read.groupBy("name").agg(F.count("*").alias("n"), F.count("error").alias("bad")).collect()}
    assert got == {"plain": (5, 0), "dict": (200, 0), "cut": (5, 1), "bad": (5, 3), "junk": (1, 1), "flip": (1, 1), "late": (5, 0)}
    with pytest.raises(Exception, match="USER_RAISED"):
        warc.sound(read).collect()


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/2.0"), (b"sha1:", b"md5:"), (b"x" * 50, b"x" * 49 + b"y"), (b"WARC-Type: response", b"WARC-Type: other"),
                                    (b"HTTP/1.1", b"GOPHER"), (b"WARC-Date: ", b"WARC-Date "), (b"\r\n\r\n", b"\r\n")])
def test_invalid_records(change):
    assert warc.parse(row())["payload_bytes"] == 50
    with pytest.raises(warc.Damaged):
        warc.parse(row(c=change))
