"""A vector index on shared storage: batches of rows, a log of what counts, training by need, staleness by the source's times.

A batch is written to a folder of its own and counts once its entry in the log exists. Entries are numbered
and created, never overwritten, so of two writers with the same number one starts over, and a batch that is written twice, as a
restarted stream does, counts once. Readers see the folders that the log names, never a half-written one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistola.operators import vectors


@dataclass(frozen=True)
class VectorIndex:
    """The index in a folder: rows (key, vector, any others) of one model, and the centroids that its rows have been placed by."""

    spark: SparkSession
    path: str
    key: str = "vec_id"
    vector: str = "embedding"

    # ---- the log

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """The entries of the log in order."""
        place, files = self._files(f"{self.path}/log")
        if not files.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().endswith(".json"))
        return [json.loads(r["value"]) for n in names for r in self.spark.read.text(f"{self.path}/log/{n}", wholetext=True).collect()]

    def _commit(self, make: Callable[[list[dict]], dict | None]) -> dict | None:
        """Append the entry that make() gives for the log as it is; None if there is nothing to append."""
        while True:
            known = self.entries()
            entry = make(known)
            if entry is None:
                return None
            place, files = self._files(f"{self.path}/log/{len(known):08d}.json")
            try:
                out = files.create(place, False)
            except Exception:  # someone else was first with this number
                if not files.exists(place):
                    raise
                continue
            try:
                out.write(bytearray(json.dumps(entry).encode()))
            finally:
                out.close()
            return entry

    def _current(self, known: list[dict]) -> list[dict]:
        """The entries since the last build."""
        begins = [i for i, e in enumerate(known) if e["kind"] == "build"]
        return known[begins[-1] :] if begins else []

    # ---- writing

    def _write(self, rows: DataFrame, centres: np.ndarray) -> str:
        folder = f"rows/{uuid.uuid4().hex}"
        kept = rows.where(F.col(self.vector).isNotNull())
        if len(centres):
            cells = vectors.assign_cells(kept, centres, self.key, self.vector).select(F.col("id").alias(self.key), "cell", "off")
            kept = kept.join(cells, self.key)
        else:
            kept = kept.withColumns({"cell": F.lit(0), "off": F.lit(0.0)})
        kept.write.parquet(f"{self.path}/{folder}")
        return folder

    def build(self, rows: DataFrame, model: str, source: str | None = None, batch: str = "build", cells: int | None = None) -> None:
        """Start the index anew from rows with distinct keys; what it held before no longer counts.

        source is a file or folder whose newest time the index is compared with later (stale).
        """
        rows = rows.where(F.col(self.vector).isNotNull())
        wanted = vectors.cells_for(rows.count()) if cells is None else cells
        centres = vectors.train_cells(rows, wanted, self.key, self.vector) if wanted > 1 else np.empty((0, 0))
        folder, newest = self._write(rows, centres), self._newest(source) if source else None
        entry = {"kind": "build", "batch": batch, "folder": folder, "model": model, "source": source, "newest": newest, "centres": centres.tolist()}
        self._commit(lambda known: entry)

    def extend(self, rows: DataFrame, batch: str | int) -> bool:
        """Add rows under a batch name; False, and nothing added, if the index has that batch already."""
        now = self._current(self.entries())
        if not now:
            raise ValueError("build the index first")
        if any(e["batch"] == str(batch) for e in now):
            return False
        folder = self._write(rows, np.array(now[0]["centres"]))
        entry = {"kind": "extend", "batch": str(batch), "folder": folder}
        made = self._commit(lambda known: None if any(e["batch"] == str(batch) for e in self._current(known)) or self._current(known)[0] != now[0] else entry)
        return made is not None

    def append_stream(self) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that extends the index, each batch once however often it is run."""
        return lambda batch, number: self.extend(batch, f"stream-{number}") and None

    # ---- reading

    def rows(self) -> DataFrame:
        """All rows that count, with cell and off."""
        now = self._current(self.entries())
        if not now:
            raise ValueError("build the index first")
        return self.spark.read.parquet(*[f"{self.path}/{e['folder']}" for e in now])

    def facts(self) -> dict:
        """model, batches, cells, newest (time of the source when built)."""
        now = self._current(self.entries())
        return {"model": now[0]["model"], "batches": [e["batch"] for e in now], "cells": len(now[0]["centres"]), "newest": now[0]["newest"]} if now else {}

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, threshold: float | None = None, same: bool = True) -> DataFrame:
        """vectors.search_cells() over the index."""
        now = self._current(self.entries())
        placed = self.rows().select("cell", "off", F.col(self.key).alias("id"), F.col(self.vector).alias("v"))
        return vectors.search_cells(placed, np.array(now[0]["centres"]), queries, k, probes, exact, self.key, self.vector, threshold, same)

    # ---- staleness

    def _newest(self, source: str) -> int:
        place, files = self._files(source)
        status = files.getFileStatus(place)
        if not status.isDirectory():
            return status.getModificationTime()
        found, newest = files.listFiles(place, True), status.getModificationTime()
        while found.hasNext():
            newest = max(newest, found.next().getModificationTime())
        return newest

    def stale(self, model: str | None = None) -> bool:
        """Whether there is no index, it is another model's, or its source has changed since it was built."""
        now = self._current(self.entries())
        if not now or (model is not None and now[0]["model"] != model):
            return True
        source = now[0]["source"]
        return source is not None and self._newest(source) > now[0]["newest"]

    def fresh(self, rows: Callable[[], DataFrame], model: str, source: str) -> bool:
        """Build from rows() if stale; whether it was built."""
        if not self.stale(model):
            return False
        self.build(rows(), model, source)
        return True
