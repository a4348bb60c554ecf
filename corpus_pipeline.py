"""The corpus pipeline: stages over the documents table, each the next one's input.

Toxic documents go; lines that more than a tenth of a source's documents hold go (exact copies are one document there); of
each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays; documents that
hold a benchmark item go; what is left is packed into sequences. All stages but the last return the columns they were
given, and whole rows: only line dedup changes one, the text.

Defined results, by stage:

* null and empty texts: never toxic, have no lines, are like no other document, hold no item; all are kept, and packed as
  the closing id alone. A document whose lines all go is kept with an empty text.
* null ids: never trained on; line dedup, decontamination and packing treat them as any row; near-duplicates keeps them,
  but for rows that repeat text and null id, of which one stays.
* repeated rows: each gets the same verdict. In near-duplicates rows of equal id and text are one document and one of them
  stays; rows of equal id and other texts are one document too: they stay or go together.
* ties: equal scores give equal verdicts; the smallest id of a group stays; a line at the ratio stays.
* null sources: a source of their own. Null labels and languages: not used.
* very long texts: taken whole in every stage.
* empty tables: empty documents give an empty result in every stage; empty labels drop nothing as toxic; an empty
  benchmark drops nothing as leaked.
* extra columns pass through all stages but packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate, line_dedup, minhash, packing, toxicity
from ledgerlight.llm.common import crc_mod5_is_0, forget, fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on(docs.where(~crc_mod5_is_0(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.boilerplate(docs, host=F.col("source"), text_col="text")
    return line_dedup.drop_lines(docs, found, host=F.col("source"), text_col="text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(docs, k=5, percent=80)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    (again,) = fresh(docs, "again")
    often = docs.groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(again)
    often = written(often, "repeated_ids")
    if often.isEmpty():
        return left
    repeated = F.col("doc_id").eqNullSafe(F.col(again))
    once = left.join(often, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(often, repeated, "left_anti").unionByName(once)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, **packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("packing", pack),
]
#: Toxicity, sketches and packing can't be said in SQL; tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
            forget(before)  # the next stage reads what this one wrote
    return docs
