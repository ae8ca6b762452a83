"""Duplicate letters on a stream: keyed state holds the first letter of each id, so that new letters meet earlier new ones too."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epistola.operators.duplicates import scored

#: The store that keyed state of this kind needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FirstLetter(StatefulProcessor):
    """Per block and id: the first letter of the run, and when the id was last seen. One letter of state, whatever the id's number of letters."""

    def __init__(self, names: list[str], schema: T.StructType, time: str, keep: pd.Timedelta) -> None:
        self.names, self.schema, self.time, self.keep = names, schema, time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", self.schema)
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values([self.time, "id"])
        first = tuple(self.first.get()) if self.first.exists() else None
        seen = pd.Timestamp(self.seen.get()[0]) if self.seen.exists() else None
        made = []
        for row in batch[self.names].itertuples(index=False, name=None):
            at = row[self.names.index(self.time)]
            row = tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row)
            if first is None or at > seen + self.keep:
                first = row
            elif first[self.names.index("id")] != row[self.names.index("id")]:
                made.append(row + first)
            seen = at if seen is None else max(seen, at)
        self.first.update(first)
        self.seen.update((seen.to_pydatetime(),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((seen + self.keep).timestamp() * 1000) + 1)
        if made:
            yield pd.DataFrame(made, columns=[f"{p}{n}" for p in ("n_", "o_") for n in self.names])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def pairs(stream: DataFrame, block: Sequence[str], time: str = "ts", keep: str = "90 days", late: str = "1 day") -> DataFrame:
    """n_*, o_* as duplicates.letters_after_first() has them, for a stream of letters(id, letter_id, date_sent, subject, body, `time`, block).

    Within a batch letters are taken in the order of time and id; across batches they come in that order, or at most `late`
    behind, with the first of them deciding. State goes when an id has not been seen for `keep`. The session needs STORE.
    """
    given = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).where("trim(letter_id) != ''").withColumn("__k", F.trim("letter_id"))
    fields = [f for f in given.schema.fields if f.name != "__k"]
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    out = T.StructType([T.StructField(f"{p}{f.name}", f.dataType) for p in ("n_", "o_") for f in fields])
    processor = FirstLetter([f.name for f in fields], plain, time, pd.Timedelta(keep))
    return given.groupBy(*block, "__k").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime")


def duplicates(stream: DataFrame, block: Sequence[str], least: float = 75.0, sequence: bool = True, **options: str) -> DataFrame:
    """original_id, new_id, score, detection_method of new letters whose id was seen before."""
    return scored(pairs(stream, block, **options), least, sequence)
