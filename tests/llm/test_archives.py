import base64
import hashlib

from campanile.llm.archives import read_archives, resolve, resolved, write_archives

ROWS = [(3, "http://a/\r\nx", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (1, None, "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (7, "u", ""), (8, "u", None), (9, "v", "one"), (None, "w", "one"), (5, "z", "x" * 300_000)]


def brute(rows, min_bytes=0):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        first = min(same, default=None)
        revisit = len(raw) >= min_bytes and first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


def read(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    for compression, least in (("gzip", 0), ("none", 1)):
        folder = f"file://{tmp_path}/{compression}"
        write_archives(frame(spark), folder, min_bytes=least, compression=compression, records_per_file=2)
        records = read_archives(spark, folder)
        assert read(resolved(records)) == brute(ROWS, least)
        payloads = {r.page_id: r.payload for r in records.where("record_type = 'response'").collect()}
        assert payloads[1] == ROWS[0][2] and payloads[5] == "x" * 300_000
        assert {r.url for r in records.where("page_id = 3").collect()} == {"http://a/%0D%0Ax"}


def test_repeated_rows_and_no_rows(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a")]
    assert [(r.page_id, r.record_type, r.refers_to) for r in resolve(frame(spark, rows)).orderBy("page_id").collect()] == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    write_archives(frame(spark, rows), f"file://{tmp_path}/r")
    assert read(resolved(read_archives(spark, f"file://{tmp_path}/r"))) == brute(rows)
    write_archives(frame(spark, ROWS).limit(0), f"file://{tmp_path}/none")
    assert resolved(read_archives(spark, f"file://{tmp_path}/none")).count() == 0
