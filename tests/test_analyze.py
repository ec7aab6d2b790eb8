"""Analyzers over real files: what is missing, what fails, what is skipped."""

import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from stratafile.operators import analyze
from stratafile.sources import containers
from stratafile.sources.store import written

CORE = '<cp xmlns:dc="d" xmlns:t="t"><dc:title>T</dc:title><dc:creator>A</dc:creator><t:created>2024</t:created></cp>'


def files(spark, folder, names, clouds=()):
    return spark.createDataFrame([(i, str(folder / n), n, n in clouds) for i, n in enumerate(names)], "file_id long, path string, file_name string, is_offline_or_cloud boolean")


def test_nothing_to_do_and_missing_libraries(spark, tmp_path):
    df = files(spark, tmp_path, ["a.pdf", "b.nef", "c.jpg"])
    none = analyze.run(df, "text")
    assert (none.status, none.applicable, none.results) == ("no_applicable_files", 0, None)
    gone = analyze.run(df, "pdf", absent=["pypdf"])
    assert gone.status == "failed" and gone.applicable == 1 and "pypdf" in gone.reason and gone.results is None
    image = analyze.run(df, "image", absent=[])
    assert (image.applicable, image.excluded) == (1, 1)
    if analyze.missing("raw_image"):
        assert analyze.run(df, "raw_image").status == "failed"


def test_each_file_is_isolated(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("docProps/core.xml", CORE)
        z.writestr("word/document.xml", "<d><p><t>one</t></p><p><t>two</t></p></d>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "r.doc").write_bytes(b"{\\rtf1{\\info{\\title Old}{\\creatim\\yr2001\\mo2\\dy3}}}")
    out = analyze.run(files(spark, tmp_path, ["d.docx", "bad.docx", "gone.docx", "r.doc", "cloud.docx"], {"cloud.docx"}), "office", absent=[])
    results = written(out.results, "results")
    rows = {r["file_id"]: r for r in results.collect()}
    assert rows[0]["fields"]["Title"] == "T" and rows[0]["fields"]["ContentCount"] == "2" and rows[0]["error"] == ""
    assert rows[1]["error"] and rows[2]["error"] and not rows[1]["fields"] and rows[4]["error"] == "SkippedCloudOnly"
    assert rows[3]["fields"]["Title"] == "Old" and rows[3]["fields"]["Created"] == "2001-02-03T00:00:00"
    told = analyze.finished(results).first()
    assert (told["applicable"], told["succeeded"], told["errors"], told["skipped"], told["status"]) == (5, 2, 2, 1, "completed_with_warnings")
    wide = analyze.promoted(results).where("file_id = 0").first()
    assert (wide["title"], wide["author"], wide["content_created_reported"], wide["width_px"]) == ("T", "A", "2024", None) and wide["detail"]["OfficeType"] == "DOCX"


def test_archives_and_texts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "x" * 100)
        z.writestr("folder/", "")
    (tmp_path / "t.txt").write_bytes("\ufeffü".encode("utf-16-le"))
    (tmp_path / "m.md").write_bytes(b"\xe9t\xe9")
    names = ["z.zip", "t.txt", "m.md"]
    arch = analyze.run(files(spark, tmp_path, names), "archive").results.first()
    assert arch["fields"]["EntryCount"] == "1" and arch["fields"]["TotalUncompressedSize"] == "100"
    told = {r["file_id"]: r["fields"] for r in analyze.run(files(spark, tmp_path, names), "text").results.collect()}
    assert told[1] == {"Text": "ü", "Encoding": "utf-16-le"} and len(told[2]["Text"]) >= 3
    content = analyze.run(files(spark, tmp_path, names), "content_extraction").results.where(F.col("file_id") == 1).first()
    assert content["fields"]["SourceType"] == "PlainText"


def test_probe_limits():
    with pytest.raises(RuntimeError, match="more than"):
        analyze.probe("x", (sys.executable, "-c", "import time; time.sleep(5)"), 0.2)
    with pytest.raises(RuntimeError, match="failed"):
        analyze.probe("x", (sys.executable, "-c", "import sys; sys.exit(3)"))
    assert analyze.probe("x", (sys.executable, "-c", "print('{}')")) == {}
    assert subprocess.run([sys.executable, "-c", ""], check=False).returncode == 0
    assert analyze.rate("30000/1001") == "29.97" and analyze.rate("0/0") == "" and analyze.rate("") == ""


def test_messages_show_ordinary_paths():
    assert analyze.ordinary("at \\\\?\\UNC\\srv\\x and \\\\?\\C:\\y") == "at \\\\srv\\x and C:\\y"
    assert containers.decode_bytes(b"\xff\xfe\x00\x00a\x00\x00\x00") == ("a", "utf-32-le")
