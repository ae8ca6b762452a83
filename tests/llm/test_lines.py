from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from epistola.llm import line_dedup
from epistola.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, least=40, documents=5):
    holders = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(line.strip(BLANKS).translate(LOWER), set()).add(key)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = line.strip(BLANKS).translate(LOWER)
            held = holders[k]
            if len(k) < least or len(held) < documents or key == max(held, key=lambda x: (x is not None, x or 0)):
                kept.append(line)
        out.append((key, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_texts(seed=1, n=80):
    r = random.Random(seed)
    common = [f"This line stands in {w} of the documents that are given here." for w in ("many", "some", "few", "MANY", "most")]
    common += ["é" * 39, "é" * 40, "ß" * 20 + "x" * 20, " padded line of some forty characters or so, it is  ", "\x0bpadded line of some forty characters or so, it is\r", "short", "", "   "]
    rows = []
    for key in range(n):
        lines = [r.choice(common) if r.random() < 0.6 else f"own line number {r.random()} of the document {key} alone" for _ in range(r.randint(1, 12))]
        rows.append((key, "\n".join(x.upper() if r.random() < 0.2 and "ß" not in x else x for x in lines)))
    return [*rows, rows[3], rows[3], (None, rows[5][1]), (None, None), (n, ""), (n, "\n".join([common[0]] * 3000)), (n + 1, common[0]), (n + 2, "\n\n")]


def answer(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in frame.collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rows = odd_texts()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert answer(QUERIES["op12_line_dedup"](spark, str(tmp_path))) == brute(rows)


@pytest.mark.parametrize("k", [1, 3])
def test_streamed_ranges_equal_brute_force(spark, tmp_path, monkeypatch, k):
    """With hardly any counters nearly all digests take the sorted ranges; bitmaps are joined by a shuffle."""
    monkeypatch.setattr(line_dedup, "heavy_hitters", lambda rows, digest: rows.groupBy(digest).count().orderBy("count").limit(k).select(digest))
    monkeypatch.setattr(line_dedup, "BROADCAST_MARKS", 0)
    rows = odd_texts(seed=k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = line_dedup.apply(docs, line_dedup.bitmaps(docs))
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in left.collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_later_occurrences_over_any_batches(size):
    r = random.Random(size)
    rows = sorted([(bytes([r.randrange(12)]) * 16, -r.randrange(9), r.randrange(3)) for _ in range(300)])
    table = pa.table({"digest": pa.array([x[0] for x in rows], pa.binary()), "doc": [x[1] for x in rows], "position": [x[2] for x in rows]})
    got = [tuple(x.values()) for b in line_dedup._later_occurrences(iter(table.to_batches(max_chunksize=size)), 5) for x in b.to_pylist()]
    docs = {}
    for d, doc, _ in rows:
        docs.setdefault(d, set()).add(doc)
    assert got == [x for x in rows if len(docs[x[0]]) >= 5 and x[1] != min(docs[x[0]])]


def test_bitmaps_and_odd_tables(spark):
    line = "a line of forty characters and a few more"
    docs = spark.createDataFrame([(str(i), f"own {i}\n{line}\nend", "m", "k", 1) for i in range(5)], "name string, body string, mark string, keep string, n_lines int")
    maps = {r.name: r for r in line_dedup.bitmaps(docs, "name", "body").collect()}
    assert sorted(maps) == list("0123") and all((r.n_lines, r.n_dropped, zlib.decompress(r.keep)) == (3, 1, b"\x05") for r in maps.values())
    left = line_dedup.apply(docs, line_dedup.bitmaps(docs, "name", "body"), "name", "body")
    assert {r.name: r.kept_text for r in left.collect()} == {str(i): f"own {i}\nend" if i < 4 else f"own 4\n{line}\nend" for i in range(5)}
    assert [(r.mark, r.keep) for r in left.collect()] == [("m", "k")] * 5
    none = docs.limit(0)
    assert line_dedup.apply(none, line_dedup.bitmaps(none, "name", "body"), "name", "body").count() == 0
