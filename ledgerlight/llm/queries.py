"""The queries of the corpus operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate, langid, licenses, line_dedup, media, minhash, packing, runs, sharding, substring, toxicity, url_filter, whitening
from ledgerlight.llm.common import crc_mod5_is_0, table, written

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_on(docs.where(~crc_mod5_is_0(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.select("doc_id", crc_mod5_is_0(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_frame(spark, URL_RULES))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text after its site's boilerplate lines are gone, its lines and how many went."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_filter.url_host(F.col("url")).alias("host"), F.col("html").alias("text"))
    found = line_dedup.boilerplate(pages, host=F.col("host"), text_col="text", lines=line_dedup.page_lines)
    return line_dedup.drop_lines(pages, found, host=F.col("host"), text_col="text", lines=line_dedup.page_lines, counted=True)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams and their timestamps are stored as a table, and what is returned is read from that."""
    stored = written(media.media_columns(table(spark, sf_dir, "documents"), block=media.BLOCK), "media")
    return media.read_media(stored)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **packing.vocabulary())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs.where(~crc_mod5_is_0(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).select("doc_id", crc_mod5_is_0(F.col("doc_id")).alias("held_out"), "score", "predicted")


def repetitive(docs: DataFrame) -> DataFrame:
    """The contract's input of op11: of documents whose id has a hash h with h % 10 = 0, each word from a = g % n on is the
    one of a period of p words from a, where n is the number of words and g = floor(h / 10)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    w = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("w")).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    w = w.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    again = F.array_join(F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    return w.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(repetitive(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("m.start"), F.col("m.length"), -F.col("m.period")
    return one.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * m.length) div -m.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["start"])
    named = F.array_sort(F.array_distinct(F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["label"])))
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(named, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.to_json("expressions").alias("expressions"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.get(F.array(*[F.lit(float(e)) for e in model.explained]) if model else F.array().cast("array<double>"), F.col("i"))
    return rows.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", explained.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_url_filter, op3_line_dedup, op4_media_columns, op5_packing, op6_substring_dedup, op7_minhash, op8_sharding, op9_decontamination, op10_toxicity, op11_periodic_runs, op12_license_scan, op13_whitening)
}

_RULES_SQL = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{a}')" for a, r in URL_RULES)

ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
WITH rules(h, p, action) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (
  SELECT parts.page_id, max_by(h || p, length(h || p) * 100000 + length(h)) AS rule, max_by(action, length(h || p) * 100000 + length(h)) AS verdict
  FROM parts JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY parts.page_id)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id
""",
}
