"""Unique narratives kept current as archives arrive, in any order.

The first row of a narrative counts, by its position in the archive. State holds, for each hash, the first row seen so far
and how many there are; a batch gives the hashes it changed. Where a row turns up that comes before the one that counted,
the new one replaces it: the sink gets the hash with its new first row, and the position that no longer counts. Rows are
told apart by their position, so an archive that arrives again changes nothing: positions are held too, in a map by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlight.functions.scalars import narrative_hash
from ledgerlight.operators import research
from ledgerlight.shipping import ship
from ledgerlight.streaming.state import ROCKSDB

FIRST = "row_idx long, complaint_id string, received string, issue string, sub_issue string, narrative string"
CHANGED = f"narrative_sha256 string, copies long, {FIRST}, replaced long"
COLUMNS = [c.split()[0] for c in FIRST.split(", ")]


class FirstRows(StatefulProcessor):
    """The first row of a narrative, the positions of all of its rows, and their number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", f"copies long, {FIRST}")
        self.seen = handle.getMapState("seen", "row_idx long", "here boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.first.get() if self.first.exists() else None
        copies, first = (held[0], tuple(held[1:])) if held is not None else (0, None)
        before, was = copies, first
        for frame in rows:
            for row in frame[COLUMNS].itertuples(index=False):
                row = (int(row[0]), *(None if v is None else str(v) for v in row[1:]))
                if not self.seen.containsKey((row[0],)):
                    self.seen.updateValue((row[0],), (True,))
                    copies += 1
                    if first is None or row[0] < first[0]:
                        first = row
        if copies == before:
            return
        self.first.update((copies, *first))
        frame = pd.DataFrame([(key[0], copies, *first, was[0] if was is not None and was[0] != first[0] else None)], columns=["narrative_sha256", "copies", *COLUMNS, "replaced"])
        yield frame.astype({"replaced": "Int64"})

    def close(self) -> None:
        pass


def changed_narratives(stream: DataFrame) -> DataFrame:
    """(CHANGED) from a stream of complaint rows: each hash that a batch changes, with its first row so far. ``replaced``: the
    position that counted before, if another one does now."""
    ship(stream.sparkSession)
    rows = research.prepared(stream).where("narrative is not null and row_idx is not null")
    rows = rows.select(narrative_hash(F.col("narrative")).alias("narrative_sha256"), "row_idx", "complaint_id", F.date_format("received", "yyyy-MM-dd").alias("received"), "issue", "sub_issue", "narrative")
    return rows.groupBy("narrative_sha256").transformWithStateInPandas(FirstRows(), CHANGED, "Update", "None")


def narratives_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return changed_narratives(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
