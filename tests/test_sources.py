"""Readers and writers over temporary folders."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from stratafile.operators import exports
from stratafile.sources import containers, filesystem, logs


def test_inventory_of_a_folder(spark, tmp_path):
    for p in ("z/1", "z/10", "a/b.txt", "m/n/deep", "top"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("Same content")
    os.link(tmp_path / "top", tmp_path / "alias")
    filesystem.register(spark)
    found = {r["relative_path"]: r for r in spark.read.format("file_inventory").load(str(tmp_path)).collect()}
    assert set(found) == {"z/1", "z/10", "a/b.txt", "m/n/deep", "top", "alias"}
    assert found["top"]["file_index"] == found["alias"]["file_index"] and found["top"]["hard_link_count"] == 2 and found["m/n/deep"]["depth"] == 2
    rows = spark.createDataFrame([(str(tmp_path), "top"), (str(tmp_path), "gone")], "root_path string, relative_path string")
    hashed = {r["relative_path"]: r for r in filesystem.hash_files(rows).collect()}
    assert hashed["top"]["bytes_read"] == 12 and hashed["gone"]["error_kind"] == "FILE MISSING" and hashed["gone"]["digest"] is None


def test_zip_members(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for i in range(300):
            z.writestr(f"d/{i}.txt", "x" * i)
    assert containers.zip_entry_count(b.getvalue()) == 300 and containers.zip_entry_count(b"no") is None
    spark.udtf.register("zip_entries", containers.ZipEntries)
    spark.createDataFrame([(bytearray(b.getvalue()),), (bytearray(b"broken"),)], "c binary").createOrReplaceTempView("zips")
    r = spark.sql("SELECT count(entry_path) n, sum(size_bytes) s, count(error) e FROM zips, LATERAL zip_entries(c)").first()
    assert (r["n"], r["s"], r["e"]) == (300, 44850, 1)


def test_office_text():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>Hello </w:t><w:t>there</w:t></w:p><w:p><w:t>Bye</w:t></w:p></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator></c>')
    assert containers.ooxml_text(b.getvalue(), ".docx") == "Hello there\nBye" and containers.ooxml_properties(b.getvalue()) == {"title": "T", "creator": "A"}


def test_image_headers_and_hashes():
    assert containers.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x10\0\0\0\x20") == ("PNG", 16, 32)
    grey = [[x * y % 7 for x in range(32)] for y in range(32)]
    assert len(containers.average_hash(grey)) == 16 == len(containers.perceptual_hash(grey)) == len(containers.difference_hash(grey))


def test_decoding(spark):
    cases = [("Ω".encode(), "Ω"), (b"\xef\xbb\xbfx", "x"), ("Ω".encode("utf-16"), "Ω"), (b"caf\xe9", "café")]
    df = spark.createDataFrame([(bytearray(b), t) for b, t in cases], "b binary, t string")
    assert all(r[0] == r[1] for r in df.select(containers.decode(F.col("b")), "t").collect())


def test_probe(spark):
    j = '{"format":{"duration":"12.5","tags":{"title":"T"}},"streams":[{"codec_type":"video","codec_name":"h264","width":640,"height":480,"avg_frame_rate":"30000/1001"}]}'
    r = spark.createDataFrame([(j,)], "j string").select(*[c.alias(k) for k, c in containers.probe_fields(F.col("j")).items()]).first()
    assert (r["duration_seconds"], r["title"], r["video_codec"], r["frame_rate"]) == (12.5, "T", "h264", "29.97")


def test_logs(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"severity":"info","message":"ok"}\n{broken\n')
    assert sorted(r["severity"] for r in logs.read_events(spark, str(tmp_path / "e.json")).collect()) == ["info", "warning"]
    (tmp_path / "errors.txt").write_text("FILE ERROR: C:\\a -- denied\nnothing\n")
    found = sorted(logs.read_errors(spark, str(tmp_path / "errors.txt")).collect(), key=lambda r: r["line_no"])
    assert [(r["error_type"], r["file_path"], r["message"]) for r in found] == [("FILE ERROR", "C:\\a", "denied"), (None, None, "nothing")]


def test_csv_dialects(spark, tmp_path):
    df = spark.createDataFrame([(1, "plain", None, ""), (2, 'q"x,\n', "ü", "t ")], "a int, b string, c string, d string")
    path = str(tmp_path / "x.csv")
    assert exports.write_csv(df, path, [F.col("a")]) == 2
    assert open(path, "rb").read() == b'\xef\xbb\xbf"a","b","c","d"\r\n"1","plain",,""\r\n"2","q""x,\n","\xc3\xbc","t "\r\n'
    assert exports.write_csv(df.limit(0), str(tmp_path / "none.csv"), [F.col("a")]) == 0 and not (tmp_path / "none.csv").exists()
    exports.write_csv(df, path, [F.col("a")], "minimal")
    assert open(path, "rb").read().startswith(b'a,b,c,d\r\n1,plain,,\r\n2,"q""x,\n"')
    with pytest.raises(ValueError):
        exports.write_csv(df, path, [F.col("a")], forbidden=str(tmp_path))


def test_content_store_keeps_each_text_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "")], "file_id long, text string")
    found = exports.store_texts(df, str(tmp_path / "s"))
    assert {r["file_id"]: r["reused"] for r in found.collect()} == {1: False, 2: True, 3: False, 4: False}
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "s")) == 3
