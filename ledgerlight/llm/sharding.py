"""Proportional stratified interleaving of rows into shards, in DataFrame functions only.

Rows are put in a seeded shuffle within each source, each gets the fractional rank (2r - 1) / 2n there, and the
whole is cut in the order of that rank, so that every run of rows, and so every shard, has the sources in the
corpus's proportions. The law is ``rows``: shard sizes differ by one row at most.

Ranks are dealt out, never computed by one task for a key: rows are cut into buckets of the shuffle order (source,
leading hash digits), a window ranks the rows of one bucket, and the buckets' sums are carried on over the table of bucket
counts, in two levels: within runs of ``RUN`` buckets, and over the runs. The bucket count follows the number of rows, so a
source that holds a third of all rows is spread over as many tasks as its share, and no window sees more than
``per_bucket`` rows or so, ``RUN`` buckets, or (buckets / RUN) runs. Rows that share a hash because id, size and checksum are
the same are interchangeable; where more than ``per_bucket`` do, their row's number is hashed in. Only (id, source,
size, checksum) are shuffled, never a text: they are written once, so that all steps see the same row numbers.

Defined results: a null text counts as empty (size 1, checksum 0); a null source is a source of its own; null ids
and repeated rows each keep a place of their own; an empty table gives an empty result; other columns are ignored.
Equal rows are interchangeable, so which of them gets which slot does not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import written

RUN = 4096


def bucket_digits(rows: int, per_bucket: int) -> int:
    """Leading hexadecimal digits that cut ``rows`` into buckets of about ``per_bucket`` rows."""
    digits = 1
    while digits < 7 and rows > per_bucket * 16**digits:
        digits += 1
    return digits


def _ranked(rows: DataFrame, within: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds a rank from 1 in (within) by (bucket, order) and the number of rows within. ``bucket`` is a long."""
    rows = rows.withColumn("_bucket", bucket)
    keys = [F.col(f"_k_{c}") for c in within]
    counts = rows.groupBy(*[F.col(c).alias(f"_k_{c}") for c in within], F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_run", F.expr(f"_b div {RUN}"))
    runs = counts.groupBy(*keys, "_run").agg(F.sum("_n").alias("_n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_run", F.coalesce(F.sum("_n").over(upto(Window.partitionBy(*keys).orderBy("_run"))), F.lit(0)).alias("_runs"), F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_total"))
    inside = counts.select(*keys, "_b", "_run", F.coalesce(F.sum("_n").over(upto(Window.partitionBy(*keys, "_run").orderBy("_b"))), F.lit(0)).alias("_inside"))
    before = inside.join(runs, [*(f"_k_{c}" for c in within), "_run"]).select(*keys, "_b", (F.col("_runs") + F.col("_inside")).alias("_before"), f"{name}_total")
    on = F.col("_bucket") == F.col("_b")
    for c in within:
        on = on & (F.col(c) == F.col(f"_k_{c}"))
    inner = Window.partitionBy(*within, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_r", F.row_number().over(inner))
        .join(before, on)
        .withColumn(name, F.col("_before") + F.col("_r"))
        .drop("_bucket", "_b", "_before", "_r", *[f"_k_{c}" for c in within])
    )


def stratified_shards(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, seed: str = "interleave-1", rows: int | None = None, per_bucket: int = 20_000
) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, source) for each row. ``rows``: their number, counted if not given."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_source"), size, crc)
    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("null")), "text_crc32", "size").cast("binary"))
    base = written(base.withColumn("_key", key).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    total = base.count() if rows is None else rows
    often = base.groupBy("_source", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_bucket).select(F.col("_source").alias("_os"), F.col("_key").alias("_ok"))  # at most rows / per_bucket
    split = F.when(F.col("_ok").isNull(), F.col("_key")).otherwise(F.md5(F.concat_ws("/", "_key", "_row").cast("binary")))
    base = base.join(often, (F.col("_source") == F.col("_os")) & (F.col("_key") == F.col("_ok")), "left").withColumn("_key", split).drop("_os", "_ok", "_row")
    digits = bucket_digits(total, per_bucket)
    ranked = _ranked(base, ["_source"], F.conv(F.substring("_key", 1, digits), 16, 10).cast("long"), [F.col("_key"), F.col("text_crc32"), F.col("size")], "_rank")
    ranked = ranked.withColumn("_f", (2 * F.col("_rank") - 1) / (2 * F.col("_rank_total")).cast("double"))
    parts = 16**digits
    ranked = ranked.withColumn("_one", F.lit(1))
    placed = _ranked(ranked, ["_one"], F.floor(F.col("_f") * parts).cast("long"), [F.col("_f"), F.col("_source"), F.col("_key"), F.col("text_crc32"), F.col("size")], "_place")
    place = F.col("_place") - 1
    # the first place of a shard is the least p with p * shards >= shard * rows
    shard = F.expr(f"cast((_place - 1) * {shards} div _place_total as int)")
    first = F.expr(f"(cast((_place - 1) * {shards} div _place_total as bigint) * _place_total + {shards - 1}) div {shards}")
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.alias("shard"),
        (place - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30)).alias(source_col),
    )
