import base64
import hashlib
import random

from pyspark.sql import functions as F

from gistmill.llm import warc
from gistmill.llm.queries import op3_warc_segments


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_framing():
    for n in (0, 1, 10, 4096, 10_000):
        body = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(body, 64)) == body
        assert warc.decoded(warc.HTTP + warc.chunked(body)) == body
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"5\r\nabc"):
        assert warc.unchunked(broken) is None


PAGES = [
    (1, "http://a/1", "short"),
    (2, "http://a/2\r\nX: y", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "ü" * 9_000),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/5", "short"),
    (6, "http://a/6", "\r\n\r\n" * 2_000 + "\r"),
    (7, "http://a/7", "\r\n"),
    (-8, "http://a/8", "short"),
    (None, "http://a/9", "no id"),
    (10, "http://a/10", "x" * 60_000),
    (10, "http://a/10", "x" * 60_000),
    (9, "http://a/11", "x" * 60_000),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' as payload", "1 as last").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=5_000)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r["ok"] for r in got) and len(got) == len(PAGES)
    html = {p: (h or "").encode() for p, _, h in PAGES}
    last = {}
    for p, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", p) if p is not None else p or -1, p) if p is not None else None
    kinds = {}
    for r in got:
        kinds.setdefault(r["page_id"], []).append(r["type"])
        if r["type"] == "response":
            assert bytes(r["payload"]) == html[r["page_id"]]
            assert r["digest"] == sha(html[r["page_id"]])
        else:
            assert r["payload"] is None
    assert kinds == {
        1: ["revisit"], 2: ["response"], 3: ["revisit"], 4: ["response"], 5: ["response"], 6: ["response"],
        7: ["response"], -8: ["revisit"], None: ["response"], 10: ["response"] * 2, 9: ["revisit"],
    }
    uris = {r["page_id"]: r["uri"] for r in got}
    assert uris[3] is None and uris[2] == "http://a/2%0D%0AX: y"


def test_short_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), revisit_from=6)
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert {r["page_id"] for r in got.where("type = 'revisit'").collect()} == {9}


def test_missing_and_mixed_up_segments(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", chr(97 + i) * 40_000) for i in range(4)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=8_000)
    parsed = warc.parse_archives(spark, str(tmp_path / "w")).orderBy(F.desc("segment"))
    sound = warc.reassemble(parsed)
    assert sound.where("block is not null").count() == 4
    assert {warc.decoded(bytes(r["block"])) for r in sound.collect()} == {(chr(97 + i) * 40_000).encode() for i in range(4)}
    lost = warc.reassemble(parsed.where("segment != 2 or origin not like '%page:1:%'"))
    assert lost.where("block is null").count() == 1
    end = warc.reassemble(parsed.where("total is null or origin not like '%page:1:%'"))
    assert end.where("block is null").count() == 1
    assert warc.reassemble(parsed.withColumn("total", F.col("total") + 1)).where("block is not null").count() == 0


def test_empty_table_and_query_columns(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
    pages = spark.createDataFrame(PAGES[:7], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in op3_warc_segments(spark, str(tmp_path)).collect()}
    assert got[1]["refers_to"] == 5 and got[3]["refers_to"] == 4 and got[5]["refers_to"] is None
    assert got[1]["payload_digest"] == sha(b"short") and got[1]["payload_bytes"] == 5
