"""The research refresh: one scan of the archive gives its counters, the period guard, all aggregates and the extract of
narratives, and nothing is published unless the guard holds.

The scan writes one row for each (narrative hash, month, issue, sub-issue) to scratch space: counts and the first row of
each, combined before the shuffle. Counters and guard are metrics observed on the rows that this one write reads. All else
is made from the groups, which repeat no narrative and no row without one. The output is put together beside its place
and moved there in the end.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlight.functions import constants as K
from ledgerlight.functions.scalars import narrative_hash, strip
from ledgerlight.operators import research
from ledgerlight.sources import outputs

PERIOD = ("2025-01-01", "2025-02-28")
LISTS = ("monthly_counts", "issue_counts", "not_owed_subissues", "narrative_issue_counts_before_dedup", "unique_not_owed_subissues")


class OutOfPeriod(ValueError):
    """The archive holds medical rows whose date can't be read or lies outside the period."""


def _counters(first: str, last: str) -> list[Column]:
    medical = F.coalesce((F.col("product") == K.PRODUCT) & (F.col("sub_product") == K.SUB_PRODUCT), F.lit(False))
    day = research.received(F.col("date_received"))
    count = lambda c, name: F.coalesce(F.count_if(c), F.lit(0)).alias(name)
    return [
        F.count(F.lit(1)).alias("archive_total_rows"), count(medical, "medical_total"), count(medical & (strip(F.col("narrative")) != ""), "medical_with_narrative"),
        count(medical & day.isNull(), "unreadable"), count(medical & ~day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), "out_of_period"),
    ]


def groups(complaints: DataFrame) -> DataFrame:
    """(h, month, issue, sub_issue, n, row_idx, r): medical rows by their narrative's hash (null without one) and labels, with
    the first row of each."""
    rows = research.prepared(complaints).withColumns({"h": F.when(F.col("narrative").isNotNull(), narrative_hash(F.col("narrative"))), "month": F.date_format("received", "yyyy-MM")})
    kept = F.struct("complaint_id", "received", "narrative")
    return rows.groupBy("h", "month", "issue", "sub_issue").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("row_idx"), F.min_by(kept, F.col("row_idx")).alias("r"))


def label_lists(grouped: DataFrame, unique: DataFrame) -> dict[str, list[dict]]:
    """Each list of LISTS: labels by falling count, ties by their first row. Labels are the archive's own vocabulary."""
    one = lambda name, label, when=F.lit(True): F.when(when, F.struct(F.lit(name).alias("list"), label.alias("label")))
    owed = F.col("issue") == K.NOT_OWED
    every = F.array(one(LISTS[0], F.col("month")), one(LISTS[1], F.col("issue")), one(LISTS[2], F.col("sub_issue"), owed), one(LISTS[3], F.col("issue"), F.col("h").isNotNull()))
    entries = grouped.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x"), "n", "row_idx")
    entries = entries.unionByName(unique.where(owed).select(F.struct(F.lit(LISTS[4]).alias("list"), F.col("sub_issue").alias("label")).alias("x"), F.lit(1).cast("long").alias("n"), "row_idx"))
    found = entries.groupBy("x.list", "x.label").agg(F.sum("n").alias("n"), F.min("row_idx").alias("first")).orderBy("list", F.desc("n"), "first").collect()
    return {name: [{"label": r["label"], "count": r["n"]} for r in found if r["list"] == name] for name in LISTS}


def refresh(complaints: DataFrame, path: str, *, period: tuple[str, str] = PERIOD) -> dict:
    """Publish ``narratives`` (JSON lines, one for each unique narrative) and ``artifact`` (one JSON document) below
    ``path``, and return the document. Raises OutOfPeriod, leaving what was there as it is."""
    spark = complaints.sparkSession
    seen, matched = Observation("archive"), Observation("narratives")
    staged, grouped_at, unique_at = outputs.staging(path), outputs.scratch(spark, "groups"), outputs.scratch(spark, "unique")
    try:
        made = groups(complaints.observe(seen, *_counters(*period)))
        made.write.parquet(grouped_at)
        totals = dict(seen.get)
        if bad := totals.pop("unreadable") + totals.pop("out_of_period"):
            raise OutOfPeriod(f"{bad} medical rows have no date within {period[0]} to {period[1]}; nothing is published.")
        grouped = spark.read.schema(made.schema).parquet(grouped_at)
        firsts = grouped.where("h is not null").groupBy("h").agg(F.min_by(F.struct("issue", "sub_issue", "r"), "row_idx").alias("x"), F.min("row_idx").alias("row_idx"))
        rows = research.flagged(firsts.select("row_idx", F.col("h").alias("narrative_sha256"), "x.issue", "x.sub_issue", "x.r.*"))
        rows.observe(matched, F.count(F.lit(1)).alias("unique_narratives"), *[F.coalesce(F.count_if(c), F.lit(0)).alias(name) for name, c in _matches().items()]).write.parquet(unique_at)
        unique = spark.read.schema(rows.schema).parquet(unique_at)
        research.extracted(unique).write.json(f"{staged}/narratives")
        document = _document(totals, dict(matched.get), label_lists(grouped, unique))
        spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{staged}/artifact")
        outputs.publish(spark, staged, path)
        return document
    finally:
        for x in (staged, grouped_at, unique_at):
            outputs.delete(spark, x)


def _matches() -> dict[str, Column]:
    """Conditions that are counted, by the names of their metrics."""
    p, d = {i: F.col(f"p_{i}") for i, _, _ in K.PATTERNS}, {i: F.col(f"d_{i}") for i, _, _ in K.DOCUMENT_MENTIONS}
    return {f"p_{i}": c for i, c in p.items()} | {f"d_{i}": c for i, c in d.items()} | {f"m_{i}_{j}": a & b for i, a in p.items() for j, b in d.items()}


def _document(totals: dict, found: dict, lists: dict) -> dict:
    told, medical, unique = totals["medical_with_narrative"], totals["medical_total"], found["unique_narratives"]
    named = lambda items, prefix: [{"id": i, "label": label, "count": found[f"{prefix}_{i}"]} for i, label, _ in items]
    return {
        **totals,
        "medical_without_narrative": medical - told,
        "unique_narratives": unique,
        "duplicate_narratives": told - unique,
        "narrative_coverage_pct": round(told / medical * 100, 2) if medical else 0.0,
        **lists,
        "patterns": named(K.PATTERNS, "p"),
        "document_mentions": named(K.DOCUMENT_MENTIONS, "d"),
        "pattern_document_matrix": [{"pattern_id": p, "document_id": d, "count": found[f"m_{p}_{d}"]} for p, _, _ in K.PATTERNS for d, _, _ in K.DOCUMENT_MENTIONS],
    }
