"""Published packets are read in pieces, never a file at once."""

import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import packet_files


def test_packets_are_read_in_chunks(monkeypatch, tmp_path):
    lines = [f'{{"case_id": {i}, "html": "é{"x" * (i % 50)}"}}' for i in range(2000)]
    data = "".join(x + "\n" for x in lines).encode()
    (tmp_path / "a.jsonl").write_bytes(data)
    monkeypatch.setattr(packet_files, "CHUNK", 1000)
    digest = packet_files.hashlib.sha256(data).hexdigest()
    batches = list(packet_files._lines(str(tmp_path), iter([pa.RecordBatch.from_pydict({"file": ["a.jsonl"], "sha256": [digest]})])))
    assert [x for b in batches for x in b.column(0).to_pylist()] == lines and max(b.num_rows for b in batches) < 60


def test_large_files_are_compressed(spark, tmp_path):
    packet_files.register(spark)
    packets = spark.range(3000).select(F.col("id").alias("case_id"), F.concat(F.lit("<p>é\n"), F.repeat(F.concat(F.lit("the same words, "), F.col("id").cast("string")), F.lit(50))).alias("html")).coalesce(1)
    path = tmp_path / "out"
    packets.write.format("packet_files").option("path", str(path)).mode("append").save()
    (m,) = packet_files.read_manifest(str(path))["files"]
    data = (path / m["file"]).read_bytes()
    lines = packets.selectExpr("sum(length(html))").first()[0]
    assert (len(data), hashlib.sha256(data).hexdigest(), m["cases"]) == (m["bytes"], m["sha256"], 3000) and lines > packet_files.PLAIN and 8 * len(data) < lines
    assert sorted(map(tuple, packet_files.read_packets(spark, str(path)).collect())) == sorted(map(tuple, packets.collect()))
    (path / m["file"]).write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(Exception, match="isn't the file that was published"):
        packet_files.read_packets(spark, str(path)).collect()


def test_small_files_stay_plain(tmp_path):
    writer = packet_files.Writer({"path": str(tmp_path / "out")}, False)
    rows = {"case_id": list(range(50)), "html": [f"é{i}\n" for i in range(50)]}
    written = writer.write(iter([pa.RecordBatch.from_pydict(rows)]))
    data = (tmp_path / writer.staging / written.file).read_bytes()
    assert [json.loads(x) for x in data.decode().splitlines()] == [{"case_id": i, "html": f"é{i}\n"} for i in range(50)] and written.bytes == len(data)
