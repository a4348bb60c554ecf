"""Incremental reconciliation: new facts arrive as a stream, and only the cases they touch are reconciled again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.operators import cases


def reconcile_stream(stream: DataFrame, documents: Callable[[], DataFrame], facts: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``stream`` has case_id; ``documents`` and ``facts`` read the current tables; ``sink`` gets the touched cases' results
    and the batch's number, by which it can make its writes idempotent."""

    def batch(rows: DataFrame, number: int) -> None:
        touched = rows.select("case_id").where("case_id is not null").distinct()
        result = cases.reconcile(documents().join(touched, "case_id", "left_semi"), facts().join(touched, "case_id", "left_semi"))
        sink(result.select("case_id", "findings", "ledger", "collection_cents", "supported_balance_cents", "applied_payments_cents", "matched_document_ids", "excluded_document_ids"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
