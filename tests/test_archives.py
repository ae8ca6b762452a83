from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from epistola.sources import archives


def pack(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


def test_members_nested_hidden_and_broken(spark, tmp_path):
    inner = pack([("deep.txt", "deep"), ("more/inner.zip", pack([("deepest.txt", "x")]))])
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.zip").write_bytes(pack([("one.txt", "hello"), ("dir/", ""), (".h.txt", "no"), ("__MACOSX/one.txt", "no"), ("in.zip", inner), ("empty.txt", ""), ("bad.zip", b"PK\x03\x04 no archive")]))
    (tmp_path / "sub/b.zip").write_bytes(pack([("two.txt", "world")]))
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04broken")
    found = archives.members(spark, f"{tmp_path}/**/*.zip").collect()
    good = {(r.path.rsplit("/", 1)[-1], r.member): bytes(r.content) for r in found if r.error is None}
    assert good == {("a.zip", "one.txt"): b"hello", ("a.zip", "in.zip/deep.txt"): b"deep", ("a.zip", "in.zip/more/inner.zip/deepest.txt"): b"x", ("a.zip", "empty.txt"): b"", ("b.zip", "two.txt"): b"world"}
    assert sorted((r.path.rsplit("/", 1)[-1], r.member) for r in found if r.error) == [("a.zip", "bad.zip"), ("c.zip", None)]
    assert archives.members(spark, f"{tmp_path}/none/*.zip").count() == 0


def test_large_members_come_in_pieces_and_are_listed_unread(spark, tmp_path):
    size = 3 * archives.PIECE + 5
    (tmp_path / "a.zip").write_bytes(pack([(f"m{i}.bin", b"a" * size) for i in range(4)] + [("huge.bin", b"\0" * (archives.SPLIT + 1))]))
    rows = archives.members(spark, f"{tmp_path}/a.zip").select("member", "piece", F.length("content").alias("n")).collect()
    assert sorted((r.piece, r.n) for r in rows if r.member == "m1.bin") == [(0, archives.PIECE), (1, archives.PIECE), (2, archives.PIECE), (3, 5)]
    splits = archives.ArchiveReader({"path": f"{tmp_path}/a.zip"}).partitions()
    assert [s.members for s in splits] == [["m0.bin", "m1.bin", "m2.bin", "m3.bin"], ["huge.bin"]]
    listed = archives.members(spark, f"{tmp_path}/a.zip", content=False)
    assert {(r.member, r.size) for r in listed.collect()} >= {("huge.bin", archives.SPLIT + 1)} and listed.where("content is not null").count() == 0


def test_properties(spark, tmp_path):
    core = '<cp:p xmlns:cp="c" xmlns:dc="d"><dc:title>Delay</dc:title><dc:creator>J. Doe</dc:creator></cp:p>'
    (tmp_path / "a.docx").write_bytes(pack([("docProps/core.xml", core), ("docProps/app.xml", "<P xmlns='x'><Pages>7</Pages><Words>90</Words></P>"), ("word/document.xml", "<w/>")]))
    (tmp_path / "b.docx").write_bytes(pack([("word/document.xml", "<w/>"), ("docProps/core.xml", "<broken")]))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    got = {r.path.rsplit("/", 1)[-1]: r for r in archives.document_properties(spark, f"{tmp_path}/*.docx").collect()}
    assert (got["a.docx"].title, got["a.docx"].author, got["a.docx"].page_count, got["a.docx"].words) == ("Delay", "J. Doe", 7, 90)
    assert got["b.docx"].title is None and got["b.docx"].error is None and got["c.docx"].error and got["a.docx"].file_size > 0
