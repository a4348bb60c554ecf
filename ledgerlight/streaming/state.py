"""Cases kept current as documents and facts arrive: each case's entries are held as keyed state, and only cases that an
arrival changes are reconciled again, from their state alone. No table is read or joined.

Events (EVENTS) put in, replace or remove an entry of a case: a document, or a fact of one. Of the events of an entry the
highest ``version`` counts, whatever order they come in, and of equal versions the greater content; a removal is kept with
its version, so that what it removed can't come back late. Events without a case, a document's number or a version are
ignored. So after any order of arrivals, with repeats, and across restarts, the last result of each case is what
``reconcile`` gives for the latest entries (``latest``).

State is one map for each case, in a RocksDB store with its checkpoint; it grows with the entries of cases, not with
events. A batch's rows are those of the cases that it changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlight.operators import cases
from ledgerlight.shipping import ship

#: ``field`` is null for a document; content is a JSON object of DOCUMENT or of FACT, or null to remove the entry.
EVENTS = "case_id long, doc_ordinal int, field string, version long, content string"
DOCUMENT = "doc_id string, kind string, title string, text string, included boolean"
FACT = "field_ordinal int, value string, quote string, page int, confirmed boolean, origin string"
RESULT = ("findings", "ledger", "collection_cents", "supported_balance_cents", "applied_payments_cents", "matched_document_ids", "excluded_document_ids")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(documents: DataFrame, facts: DataFrame, version: int = 0) -> DataFrame:
    """Events that put in all documents and facts."""
    of = lambda schema: F.to_json(F.struct(*[c.split()[0] for c in schema.split(", ")])).alias("content")
    docs = documents.select("case_id", F.col("doc_ordinal").cast("int").alias("doc_ordinal"), F.lit(None).cast("string").alias("field"), F.lit(version).cast("long").alias("version"), of(DOCUMENT))
    return docs.unionByName(facts.select("case_id", F.col("doc_ordinal").cast("int").alias("doc_ordinal"), "field", F.lit(version).cast("long").alias("version"), of(FACT)))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("case_id is not null and doc_ordinal is not null and version is not null")


def latest(rows: DataFrame) -> DataFrame:
    """The entries that the state of these events holds, in one batch."""
    last = usable(rows).groupBy("case_id", "doc_ordinal", "field").agg(F.max(F.struct("version", "content")).alias("x"))
    return last.select("case_id", "doc_ordinal", "field", "x.content").where("content is not null")


def unpacked(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, facts) of entries (case_id, doc_ordinal, field, content)."""
    docs = entries.where("field is null").select("case_id", "doc_ordinal", F.from_json("content", DOCUMENT).alias("x")).select("case_id", "doc_ordinal", "x.*")
    facts = entries.where("field is not null").select("case_id", "doc_ordinal", "field", F.from_json("content", FACT).alias("x")).select("case_id", "doc_ordinal", "field", "x.*")
    return docs, facts


class CaseState(StatefulProcessor):
    """Holds a case's entries; passes all of them on when one changes. A case that has none left gives one row of nulls."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "doc_ordinal int, field string", "version long, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k: (v[0], v[1]) for k, v in self.entries.iterator()}
        changed = set()
        for frame in rows:
            for ordinal, field, version, content in frame[["doc_ordinal", "field", "version", "content"]].itertuples(index=False):
                entry = (int(ordinal), "" if field is None else field)  # no fact has an empty name
                new = (int(version), content)
                if entry not in held or (new[0], new[1] or "") > (held[entry][0], held[entry][1] or ""):
                    if held.get(entry, (0, None))[1] != content:
                        changed.add(entry)
                    held[entry] = new
                    self.entries.updateValue(entry, new)
        if not changed:
            return
        live = sorted((k, v[1]) for k, v in held.items() if v[1] is not None)
        shown = [(key[0], k[0], k[1] or None, content) for k, content in live] or [(key[0], None, None, None)]
        frame = pd.DataFrame(shown, columns=["case_id", "doc_ordinal", "field", "content"])
        yield frame.astype({"doc_ordinal": "Int32"})

    def close(self) -> None:
        pass


def changed_cases(stream: DataFrame) -> DataFrame:
    """(case_id, doc_ordinal, field, content): all entries of each case that the stream's events change."""
    ship(stream.sparkSession)
    rows = usable(stream).where("field is null or field <> ''")
    return rows.groupBy("case_id").transformWithStateInPandas(CaseState(), "case_id long, doc_ordinal int, field string, content string", "Update", "None")


def reconcile_events(stream: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """``sink`` gets the results (case_id and RESULT) of the cases that a batch changed, the cases (case_id) that have no
    document any more, and the batch's number, by which it can make its writes idempotent."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()  # else each use would run the batch's state again
        try:
            docs, facts = unpacked(rows.where("content is not null"))
            gone = rows.groupBy("case_id").agg(F.count_if(F.col("content").isNotNull() & F.col("field").isNull()).alias("n")).where("n = 0").select("case_id")
            sink(cases.settled(cases.reconcile(docs, facts), *RESULT), gone, number)
        finally:
            rows.unpersist()

    writer = changed_cases(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
