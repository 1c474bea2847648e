import gzip
from pathlib import Path

from pyspark.sql import functions as F

from attrweave.llm import warc

SCHEMA = "page_id long, url string, html string, seen string, at string"


def test_revisits_are_resolved(spark, tmp_path):
    body = "sha256:" + __import__("hashlib").sha256(b"<p>one</p>").hexdigest()
    pages = spark.createDataFrame([(3, "http://c", "<p>one</p>", None, None), (1, "http://a", "<p>one</p>", None, None), (2, "http://b", "<p>two</p>", None, None), (9, "http://a", None, body, "2024-03-01T00:00:00Z"), (8, "http://x", None, "sha256:none", None), (7, None, None, None, None)], SCHEMA)
    records = warc.captures(pages, digest="seen", date="at")
    index = {r.record_id: r for r in warc.write_archives(records, str(tmp_path)).collect()}
    assert {k: (r.warc_type, r.refers_to, r.unresolved) for k, r in index.items()} == {1: ("resource", None, False), 2: ("resource", None, False), 3: ("revisit", 1, False), 9: ("revisit", 1, False), 8: ("revisit", None, True), 7: ("revisit", None, True)}
    for k, r in index.items():
        member = gzip.decompress((Path(tmp_path) / r.file).read_bytes()[r.offset : r.offset + r.length]).decode()
        head, _, rest = member.partition("\r\n\r\n")
        assert head.startswith("WARC/1.1\r\n") and head + "\r\n\r\n" == r.header
        assert rest == {1: "<p>one</p>", 2: "<p>two</p>"}.get(k, "") + "\r\n\r\n"
        assert f"Content-Length: {r.content_length}" in head
    ids = {k: r.header.split("WARC-Record-ID: ")[1].split("\r\n")[0] for k, r in index.items()}
    assert f"WARC-Refers-To: {ids[1]}\r\n" in index[9].header and "WARC-Refers-To-Target-URI: http://a" in index[3].header
    assert "WARC-Date: 2024-03-01T00:00:00Z\r\n" in index[9].header and f"WARC-Refers-To-Date: {warc.DATE}\r\n" in index[9].header
    assert not list(Path(tmp_path).glob(".part*"))


def test_ties_repeated_rows_and_nulls(spark):
    pages = spark.createDataFrame([(1, "http://b", "same", None, None), (1, "http://a", "same", None, None), (1, "http://a", "same", None, None), (None, "http://z", "same", None, None), (2, None, "", None, None), (3, "http://c", "", None, None)], SCHEMA)
    found = {(r.record_id, r.url): (r.warc_type, r.refers_url) for r in warc.resolve(warc.captures(pages)).collect()}
    assert found == {(None, "http://z"): ("resource", None), (1, "http://a"): ("revisit", "http://z"), (1, "http://b"): ("revisit", "http://z"), (2, None): ("resource", None), (3, "http://c"): ("revisit", None)}
    assert warc.with_headers(warc.captures(pages)).count() == 5


def test_empty_table_long_payload_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.write_archives(warc.captures(none), str(tmp_path / "none")).count() == 0
    big = spark.createDataFrame([(1, "http://a", "x" * 3_000_000, None, None)], SCHEMA).withColumns({"payload": F.lit(1), "digest": F.lit(2), "original": F.lit(3)})
    rows = warc.write_archives(warc.captures(big), str(tmp_path / "big")).collect()
    assert [r.content_length for r in rows] == [3_000_000]


def test_headers_are_clean_and_files_are_replaced(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nX-Evil: 1", "<p>one</p>", None, None), (2, "http://b", None, "sha256:x\r\nX-Evil: 2", "2024\nX: 3")], SCHEMA)
    found = warc.write_archives(warc.captures(pages, digest="seen", date="at"), str(tmp_path))
    for _ in range(2):  # an action that runs again writes over its files
        for r in found.collect():
            assert not [x for x in r.header.split("\r\n") if x.startswith("X")] and "\n" not in r.header.replace("\r\n", "")
    assert sorted(gzip.decompress(b"".join(p.read_bytes() for p in Path(tmp_path).glob("part*"))).count(b"WARC/1.1") for _ in range(1)) == [2]


def test_archives_are_the_same_when_written_again(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://{k}", f"<p>{k % 5}</p>", None, None) for k in range(40)], SCHEMA)
    names = []
    for k in range(2):
        warc.write_archives(warc.captures(pages), str(tmp_path / str(k))).count()
        names.append({p.name: sorted(gzip.decompress(p.read_bytes()).split(b"WARC/1.1")) for p in (tmp_path / str(k)).iterdir()})
    assert names[0] == names[1]
