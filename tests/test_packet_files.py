"""Packets through the committing writer."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import packet_files


@pytest.fixture
def packets(spark):
    packet_files.register(spark)
    return spark.range(200).select(F.col("id").alias("case_id"), F.concat(F.lit("<p>é "), F.col("id").cast("string"), F.lit("\n</p>")).alias("html")).repartition(6)


def save(df, path, mode="append", **options):
    df.write.format("packet_files").options(path=str(path), **options).mode(mode).save()


def test_files_and_manifest(spark, packets, tmp_path):
    path = tmp_path / "out"
    save(packets.where("case_id < 100"), path, generated_at="t", sources='[{"name": "s"}]')
    manifest = json.loads((path / "manifest.json").read_text())
    assert manifest["generated_at"] == "t" and manifest["sources"] == [{"name": "s"}] and sum(m["cases"] for m in manifest["files"]) == 100
    for m in manifest["files"]:
        data = (path / m["file"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (m["bytes"], m["sha256"])
    assert {x.name for x in path.iterdir()} == {m["file"] for m in manifest["files"]} | {"manifest.json"} and [x.name for x in tmp_path.iterdir()] == ["out"]
    save(packets.where("case_id >= 100"), path)
    assert sorted(map(tuple, packet_files.read_packets(spark, str(path)).collect())) == sorted(map(tuple, packets.collect()))
    save(packets.where("case_id < 5"), f"file://{path}", "overwrite")
    assert packet_files.read_packets(spark, str(path)).count() == 5 and len(list(path.iterdir())) == 1 + len(packet_files.read_manifest(str(path))["files"])


def test_a_failed_task_leaves_nothing(spark, packets, tmp_path):
    bad = packets.withColumn("html", F.when(F.col("case_id") == 77, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("html")))
    with pytest.raises(Exception, match="broken row"):
        save(bad, tmp_path / "out")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="nothing was published"):
        packet_files.read_packets(spark, str(tmp_path / "out"))
    save(packets, tmp_path / "out")
    before = (tmp_path / "out" / "manifest.json").read_bytes()
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken row"):
            save(bad, tmp_path / "out", mode)
    assert (tmp_path / "out" / "manifest.json").read_bytes() == before and packet_files.read_packets(spark, str(tmp_path / "out")).count() == 200
    assert [x.name for x in tmp_path.iterdir()] == ["out"]


def test_files_are_held_to_their_digests(spark, packets, tmp_path):
    save(packets, tmp_path / "out")
    (tmp_path / "out" / "packets-stray.jsonl").write_text('{"case_id": 9, "html": "stray"}\n')
    assert packet_files.read_packets(spark, str(tmp_path / "out")).count() == 200
    first = tmp_path / "out" / packet_files.read_manifest(str(tmp_path / "out"))["files"][0]["file"]
    first.write_bytes(first.read_bytes().replace(b"<p>", b"<b>", 1))
    with pytest.raises(Exception, match="isn't the file that was published"):
        packet_files.read_packets(spark, str(tmp_path / "out")).collect()
    first.unlink()
    with pytest.raises(Exception, match="isn't the file that was published"):
        packet_files.read_packets(spark, str(tmp_path / "out")).collect()


def test_no_packets(spark, packets, tmp_path):
    save(packets.limit(0), tmp_path / "out")
    assert packet_files.read_manifest(str(tmp_path / "out"))["files"] == [] and packet_files.read_packets(spark, str(tmp_path / "out")).count() == 0
    with pytest.raises(Exception, match="needed and missing|Give the folder"):
        packets.select("case_id").write.format("packet_files").option("path", str(tmp_path / "x")).mode("append").save()
