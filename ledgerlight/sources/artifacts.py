"""Reading a research artifact back, and what a panel shows of it."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "array<struct<label:string,count:bigint>>"
ARTIFACT = (
    f"retrieved_at string, scope struct<year:string>, caveats array<string>, api struct<total_complaints:bigint,source_url:string,issue_counts:{COUNTS}>,"
    f"archive struct<period:string,source_url:string,sha256:string,medical_with_narrative:bigint,unique_narratives:bigint,patterns:{COUNTS},document_mentions:{COUNTS},"
    "examples:array<struct<complaint_id:string,issue:string,sub_issue:string,narrative_excerpt:string>>>"
)
MISSING, UNREADABLE = "The analysis has not been made yet.", "The analysis can't be read."
EXAMPLES = 6


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, problem), one row: the parsed artifact, or what is the matter with it. Never fails on a missing or broken file."""
    try:
        text = spark.read.text(path, wholetext=True).select("value")
        whole = text.agg(F.first("value").alias("value"))
    except AnalysisException:
        return spark.createDataFrame([(None, MISSING)], f"artifact struct<{ARTIFACT.replace(' struct', ':struct').replace(' array', ':array').replace(' string', ':string')}>, problem string")
    # a field of another type than expected is null; text that is no JSON object is a problem
    parsed = whole.select(F.from_json("value", ARTIFACT, {"mode": "PERMISSIVE"}).alias("artifact"), F.try_parse_json("value").alias("any"))
    readable = F.coalesce(F.schema_of_variant("any").startswith("OBJECT"), F.lit(False))
    return parsed.select(F.when(readable, F.col("artifact")).alias("artifact"), F.when(~readable, UNREADABLE).alias("problem"))


def chart(rows: Column) -> Column:
    """Bars of a chart: (label, count) in the given order."""
    return F.coalesce(F.transform(rows, lambda r, i: F.struct(i.alias("ordinal"), r["label"].alias("label"), r["count"].cast("string").alias("value"))), F.array().cast("array<struct<ordinal:int,label:string,value:string>>"))


def panel(artifact: DataFrame) -> DataFrame:
    """(section, ordinal, label, value): three numbers, three charts, caveats, and at most six examples."""
    a, z = F.col("artifact.api"), F.col("artifact.archive")
    shown = lambda n: F.coalesce(F.format_number(n, 0), F.lit("Not measured"))
    stats = (("Medical-debt complaint records", a["total_complaints"]), ("Medical complaints with narratives", z["medical_with_narrative"]), ("Unique narratives analyzed", z["unique_narratives"]))
    sections = {
        "stat": F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("label"), shown(n).alias("value")) for i, (t, n) in enumerate(stats)]),
        "issues": chart(a["issue_counts"]),
        "patterns": chart(z["patterns"]),
        "documents": chart(z["document_mentions"]),
        "caveat": F.transform(F.coalesce("artifact.caveats", F.array().cast("array<string>")), lambda c, i: F.struct(i.alias("ordinal"), F.lit(None).cast("string").alias("label"), c.alias("value"))),
        "example": F.transform(F.slice(F.coalesce(z["examples"], F.array()), 1, EXAMPLES), lambda e, i: F.struct(i.alias("ordinal"), F.concat_ws(" · ", e["complaint_id"], F.coalesce(e["sub_issue"], e["issue"])).alias("label"), e["narrative_excerpt"].alias("value"))),
    }
    of = lambda k: lambda r: F.struct(F.lit(k).alias("section"), r["ordinal"].alias("ordinal"), r["label"].alias("label"), r["value"].alias("value"))
    rows = reduce(F.concat, [F.transform(v, of(k)) for k, v in sections.items()])
    return artifact.where("artifact is not null").select(F.inline(rows))
