"""Complaint aggregation: product filter, first-wins deduplication of narratives, keyword counts.

Input columns: row_idx, complaint_id, date_received, product, sub_product, issue, sub_issue, narrative (strings; row_idx
is the position in the source). One pass counts; deduplication is one shuffle on the narrative's hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import constants as K
from ledgerlight.functions.scalars import narrative_hash, strip


def medical(df: DataFrame) -> DataFrame:
    return df.where((F.col("product") == K.PRODUCT) & (F.col("sub_product") == K.SUB_PRODUCT))


def received(c: Column) -> Column:
    iso, us = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"
    return F.coalesce(F.when(c.rlike(iso), F.try_to_date(c, "yyyy-M-d")), F.when(c.rlike(us), F.try_to_date(c, "M/d/yyyy")))


def prepared(df: DataFrame) -> DataFrame:
    """Medical rows with their date and stripped narrative (null if there is none)."""
    text = strip(F.col("narrative"))
    return medical(df).withColumns({"received": received(F.col("date_received")), "narrative": F.when(text != "", text)})


def top_labels(df: DataFrame, label: str) -> DataFrame:
    """(label, count, first_row), in order of falling count, ties by first encounter."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"), F.min("row_idx").alias("first_row"))
    return counts.orderBy(F.desc("count"), "first_row")


def unique_narratives(df: DataFrame) -> DataFrame:
    """The first row of each normalised narrative, with its hash."""
    rows = prepared(df).where(F.col("narrative").isNotNull()).withColumn("narrative_sha256", narrative_hash(F.col("narrative")))
    # the least struct by position is the first row: an aggregate, so copies are combined before the shuffle
    names = [c for c in rows.columns if c not in ("row_idx", "narrative_sha256")]
    first = rows.groupBy("narrative_sha256").agg(F.min_by(F.struct(*names), F.col("row_idx")).alias("r"), F.min("row_idx").alias("row_idx"), F.count(F.lit(1)).alias("copies"))
    return first.select("row_idx", "narrative_sha256", "copies", "r.*")


def matches(pattern: str) -> Column:
    return F.col("narrative").rlike(f"(?iu){pattern}")


def flags(df: DataFrame) -> DataFrame:
    """Each unique narrative with one boolean for each pattern (p_) and document mention (d_)."""
    return flagged(unique_narratives(df))


def flagged(narratives: DataFrame) -> DataFrame:
    return narratives.withColumns({**{f"p_{i}": matches(p) for i, _, p in K.PATTERNS}, **{f"d_{i}": matches(p) for i, _, p in K.DOCUMENT_MENTIONS}})


def _counted(df: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """Counts of conditions in one aggregation, as one row each in the given order: rows are (keys..., condition)."""
    one = df.agg(*[F.count_if(r[-1]).alias(f"n{i}") for i, r in enumerate(rows)])
    parts = F.array(*[F.struct(F.lit(i).alias("ordinal"), *[F.lit(v).alias(n) for v, n in zip(r[:-1], names.split(), strict=True)], F.col(f"n{i}").alias("count")) for i, r in enumerate(rows)])
    return one.select(F.inline(parts))


def pattern_counts(df: DataFrame) -> DataFrame:
    return _counted(flags(df), [(i, label, F.col(f"p_{i}")) for i, label, _ in K.PATTERNS], "id label")


def document_mentions(df: DataFrame) -> DataFrame:
    return _counted(flags(df), [(i, label, F.col(f"d_{i}")) for i, label, _ in K.DOCUMENT_MENTIONS], "id label")


def pattern_matrix(df: DataFrame) -> DataFrame:
    return _counted(flags(df), [(p, d, F.col(f"p_{p}") & F.col(f"d_{d}")) for p, _, _ in K.PATTERNS for d, _, _ in K.DOCUMENT_MENTIONS], "pattern_id document_id")


def archive_totals(df: DataFrame) -> DataFrame:
    """One row of counters, all in one pass and one shuffle on the hash."""
    text = strip(F.col("narrative"))
    is_medical = (F.col("product") == K.PRODUCT) & (F.col("sub_product") == K.SUB_PRODUCT)
    told = F.coalesce(is_medical & (text != ""), F.lit(False))
    # sums by hash first, so the distinct count needs no second copy of the rows
    by = df.groupBy(F.when(told, narrative_hash(text)).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_medical).alias("m"))
    out = by.agg(F.sum("n").alias("total_rows"), F.sum("m").alias("medical_total"), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))), F.lit(0)).alias("with_narrative"), F.count("h").alias("unique_narratives"))
    return out.select(
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("medical_total", F.lit(0)).alias("medical_total"),
        "with_narrative",
        (F.coalesce("medical_total", F.lit(0)) - F.col("with_narrative")).alias("without_narrative"),
        "unique_narratives",
        (F.col("with_narrative") - F.col("unique_narratives")).alias("duplicate_narratives"),
    )


def coverage_pct(totals: DataFrame) -> DataFrame:
    return totals.select(F.coalesce(F.bround(F.col("with_narrative") / F.nullif(F.col("medical_total"), F.lit(0)) * 100, 2), F.lit(0.0)).alias("narrative_coverage_pct"))


def period_guard(df: DataFrame, first: str = "2025-01-01", last: str = "2025-02-28") -> DataFrame:
    """Medical rows whose date can't be read or lies outside the period."""
    d = F.col("received")
    return prepared(df).agg(F.count_if(d.isNull()).alias("unreadable"), F.count_if(~d.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("out_of_period"))


def narrative_extract(df: DataFrame) -> DataFrame:
    """One row for each unique narrative with the ids of what it matches, in definition order."""
    return extracted(flags(df))


def extracted(flagged_rows: DataFrame) -> DataFrame:
    named = lambda items, prefix: F.filter(F.array(*[F.when(F.col(f"{prefix}_{i}"), F.lit(i)) for i, _, _ in items]), lambda x: x.isNotNull())
    return flagged_rows.select(
        "complaint_id", F.date_format("received", "yyyy-MM-dd").alias("date_received"), "issue", "sub_issue", "narrative", "narrative_sha256",
        named(K.PATTERNS, "p").alias("matched_patterns"), named(K.DOCUMENT_MENTIONS, "d").alias("document_mentions"),
    )


# ---------------------------------------------------------------- API responses

API_SCHEMA = (
    "hits struct<total:struct<value:bigint>,hits:array<struct<_source:struct<product:string,sub_product:string,complaint_what_happened:string>>>>,"
    "aggregations struct<issue:struct<issue:struct<buckets:array<struct<key:string,doc_count:bigint,`sub_issue.raw`:struct<buckets:array<struct<key:string,doc_count:bigint>>>>>>>>,"
    "_meta struct<last_indexed:string>"
)


def api_filter_verified(response: DataFrame) -> DataFrame:
    """(hits, wrong, verified): a response counts only if it has hits and all are of the product asked for."""
    hits = F.coalesce(F.col("hits.hits"), F.array())
    wrong = F.filter(F.col("hits.hits"), lambda h: ~(h["_source"]["product"].eqNullSafe(F.lit(K.PRODUCT)) & h["_source"]["sub_product"].eqNullSafe(F.lit(K.SUB_PRODUCT))))
    n = F.coalesce(F.size("hits.hits"), F.lit(0))
    return response.select(n.alias("hits"), F.size(wrong).alias("wrong"), ((n > 0) & (F.size(wrong) == 0)).alias("verified"))


def api_summary(response: DataFrame) -> DataFrame:
    """(ordinal, label, count, level): the total, the issues and the sub-issues of the debt-not-owed issue, in source order."""
    issues = F.col("aggregations.issue.issue.buckets")
    subs = F.flatten(F.transform(F.filter(issues, lambda b: b["key"] == K.NOT_OWED), lambda b: b["sub_issue.raw"]["buckets"]))
    rows = reduce(
        F.concat,
        [
            F.array(F.struct(F.lit("total").alias("level"), F.lit(0).alias("ordinal"), F.lit("total").alias("label"), F.col("hits.total.value").alias("count"))),
            F.transform(issues, lambda b, i: F.struct(F.lit("issue").alias("level"), i.alias("ordinal"), b["key"].alias("label"), b["doc_count"].alias("count"))),
            F.transform(subs, lambda b, i: F.struct(F.lit("sub_issue").alias("level"), i.alias("ordinal"), b["key"].alias("label"), b["doc_count"].alias("count"))),
            F.array(F.struct(F.lit("sample").alias("level"), F.lit(0).alias("ordinal"), F.lit("narratives").alias("label"), F.size(F.filter(F.col("hits.hits"), lambda h: h["_source"]["complaint_what_happened"] != "")).cast("long").alias("count"))),
        ],
    )
    return response.select(F.inline(rows))
