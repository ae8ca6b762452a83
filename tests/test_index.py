from __future__ import annotations

import os

import numpy as np
import pytest

from epistola.operators import vectors
from epistola.sources.index import VectorIndex
from epistola.streaming import incremental


def table(spark, start, n, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(start + i, [float(x) for x in r.normal(size=6).round(4)], f"issue {i % 3}") for i in range(n)], "vec_id long, embedding array<double>, issue_type string")


def test_build_extend_reload_rebuild(spark, tmp_path):
    source = tmp_path / "training.csv"
    source.write_text("a")
    os.utime(source, (1_700_000_000, 1_700_000_000))
    index = VectorIndex(spark, f"{tmp_path}/index")
    assert index.stale() and index.entries() == [] and index.facts() == {}
    with pytest.raises(ValueError, match="build"):
        index.extend(table(spark, 0, 1), 1)
    assert index.fresh(lambda: table(spark, 0, 300), "m1", str(source)) and not index.fresh(lambda: table(spark, 0, 1), "m1", str(source))
    more = table(spark, 1000, 50, 2)
    assert index.extend(more, 7) and not index.extend(more, 7) and index.extend(table(spark, 2000, 5, 3), 8)
    again = VectorIndex(spark, f"{tmp_path}/index")
    assert sorted(r.vec_id for r in again.rows().collect()) == [*range(300), *range(1000, 1050), *range(2000, 2005)]
    assert again.facts()["batches"] == ["build", "7", "8"] and again.facts()["cells"] > 1 and "issue_type" in again.rows().columns
    # a folder without an entry does not count
    table(spark, 5000, 3).write.parquet(f"{tmp_path}/index/rows/half-written")
    asked = again.rows().where("vec_id % 20 = 0")
    want = sorted(tuple(r) for r in vectors.top_k(again.rows(), asked, 4, same=False).collect())
    assert sorted(tuple(r) for r in again.search(asked, 4, probes=2, same=False).collect()) == want
    os.utime(source, (1_700_000_500, 1_700_000_500))
    assert again.stale() and again.fresh(lambda: table(spark, 0, 10), "m1", str(source)) and again.rows().count() == 10
    assert again.extend(more, 7) and again.rows().count() == 60, "a batch of an earlier build may come again"
    assert again.stale("m2") and not again.stale("m1")


def test_two_writers_and_empty_batches(spark, tmp_path, monkeypatch):
    one, other = (VectorIndex(spark, f"{tmp_path}/index") for _ in range(2))
    one.build(table(spark, 0, 20), "m")
    real = VectorIndex._write
    # the other writer commits the same batch while the first one writes
    monkeypatch.setattr(VectorIndex, "_write", lambda self, rows, centres: (monkeypatch.setattr(VectorIndex, "_write", real), other.extend(rows, "b"), real(self, rows, centres))[-1])
    assert not one.extend(table(spark, 100, 5), "b") and one.rows().count() == 25 and len(one.entries()) == 2
    assert one.extend(table(spark, 0, 0), "none") and one.rows().count() == 25
    assert one.search(table(spark, 0, 3), 2).count() == 6


def test_a_stream_extends_once(spark, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index")
    index.build(table(spark, 0, 20), "m")
    table(spark, 100, 8).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(table(spark, 0, 1).schema).parquet(f"{tmp_path}/in")
    for cp in ("a", "b"):  # the second run has lost its checkpoint and sends the batch again
        incremental.run_batches(stream(), index.append_stream(), f"{tmp_path}/{cp}").awaitTermination(120)
    assert sorted(r.vec_id for r in index.rows().collect()) == [*range(20), *range(100, 108)]
