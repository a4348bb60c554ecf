"""Unique narratives as state: archives in any order give what the batch gives, and no copy counts twice."""

from pyspark.sql import functions as F

from ledgerlight.operators import research
from ledgerlight.plans import queries
from ledgerlight.streaming import narratives


def test_archives_in_any_order(spark, tmp_path):
    rows = queries.complaints(spark, "/root/testdata/sf0.001").where("row_idx < 900").cache()
    parts = [rows.where(F.pmod(F.xxhash64("row_idx"), F.lit(4)) == k) for k in range(4)]
    order = [2, 0, 3, 0, 1]  # one archive arrives twice
    folder, now, retracted = str(tmp_path / "in"), {}, []

    def sink(changed, number):
        for r in changed.collect():
            if r["replaced"] is not None:
                retracted.append(r["replaced"])
                assert now[r["narrative_sha256"]]["row_idx"] == r["replaced"] > r["row_idx"]
            now[r["narrative_sha256"]] = r

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        narratives.narratives_stream(stream, sink, str(tmp_path / "checkpoint")).awaitTermination(300)

    for k in order[:3]:
        parts[k].coalesce(1).write.mode("append").parquet(folder)
    run()
    for k in order[3:]:
        parts[k].coalesce(1).write.mode("append").parquet(folder)
    run()  # from the checkpoint
    want = {r["narrative_sha256"]: r for r in research.unique_narratives(rows).collect()}
    assert now.keys() == want.keys() and len(retracted) > 5
    for h, r in now.items():
        w = want[h]
        assert (r["row_idx"], r["copies"], r["complaint_id"], r["issue"], r["sub_issue"], r["narrative"], r["received"]) == (w["row_idx"], w["copies"], w["complaint_id"], w["issue"], w["sub_issue"], w["narrative"], str(w["received"]))
