"""Packets as files, through a data source that commits: the files and their manifest appear together, or not at all.

    register(spark)
    packets.select("case_id", "html").write.format("packet_files").option("path", folder).mode("append").save()

Each task writes its packets as JSON lines into a staging folder beside the output and reports the file's name, cases, bytes
and SHA-256 (of the file as it lies there). A file of more than PLAIN bytes is compressed (``.zst``): packets repeat much. When all tasks are done, the reported files are moved into the folder and their reports become its
``manifest.json``, which goes last; what a failed or doubled task left stays behind in the staging folder, which is deleted,
as it is when the write fails. The manifest counts: a reader takes the files that it lists, and holds them to their
digests (``read_packets``). A later write adds a manifest's worth of files to the one before. ``generated_at`` and
``sources`` (a JSON list of where the data is from) are options that the manifest repeats.

Paths are those of pyarrow's file systems: plain ones, file://, hdfs:// or s3://, in a folder that all tasks share.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ledgerlight.shipping import ship

MANIFEST = "manifest.json"
SCHEMA = "case_id long, html string"
CHUNK = 4 << 20  # bytes of a file that a reader holds at once
PLAIN = 1 << 20  # bytes of lines up to which a file isn't compressed


@dataclass
class Written(WriterCommitMessage):
    file: str
    cases: int
    bytes: int
    sha256: str


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}")


def read_manifest(path: str) -> dict | None:
    system, folder = _at(path)
    if system.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


class Counted:
    """A stream to a file, with the number and the digest of the bytes that went there."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.size, self.digest = out, 0, hashlib.sha256()

    @property
    def closed(self) -> bool:
        return self.out.closed

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()

    def close(self) -> None:
        self.out.close()


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if "path" not in options:
            raise ValueError("Give the folder as path.")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.notes = {"generated_at": options.get("generated_at"), "sources": json.loads(options.get("sources", "[]"))}
        # one for all tasks, made where the write is planned: a task that goes on after an abort finds it gone, and fails
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        system, folder = _at(self.staging)
        system.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _at(self.staging)
        name, cases, held = f"packets-{uuid.uuid4().hex}.jsonl", 0, io.BytesIO()
        lines = self._lines(iterator)
        for line in lines:
            cases += 1
            held.write(line)
            if held.tell() > PLAIN:
                name += ".zst"
                break
        file = Counted(system.open_output_stream(f"{folder}/{name}", compression=None))
        with pa.CompressedOutputStream(pa.PythonFile(file, "w"), "zstd") if name.endswith(".zst") else contextlib.closing(file) as out:
            out.write(held.getvalue())
            held.close()
            for line in lines:  # of a file that is compressed, the rest
                out.write(line)
                cases += 1
        file.close()
        return Written(name, cases, file.size, file.digest.hexdigest())

    @staticmethod
    def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for case, html in zip(batch.column("case_id"), batch.column("html"), strict=True):  # one packet at a time
                yield (json.dumps({"case_id": case.as_py(), "html": html.as_py()}, ensure_ascii=False) + "\n").encode()

    def commit(self, messages: list[Written | None]) -> None:
        system, staged = _at(self.staging)
        folder = _at(self.path)[1]
        before = None if self.overwrite else read_manifest(self.path)
        files = sorted((asdict(m) for m in messages if m is not None and m.cases), key=lambda m: m["file"])
        system.create_dir(folder, recursive=True)
        for m in files:
            system.move(f"{staged}/{m['file']}", f"{folder}/{m['file']}")
        manifest = {"schema_version": "1.0", **self.notes, "files": [*(before or {"files": []})["files"], *files]}
        with system.open_output_stream(f"{staged}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, indent=2).encode())
        old = {f.base_name for f in system.get_file_info(fs.FileSelector(folder))} - {m["file"] for m in manifest["files"]} - {MANIFEST}
        system.move(f"{staged}/{MANIFEST}", f"{folder}/{MANIFEST}")  # from here on the new files count
        if self.overwrite:
            for name in old:
                system.delete_file(f"{folder}/{name}")
        system.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        system, staged = _at(self.staging)
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


class PacketFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packet_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        lost = {"case_id", "html"} - set(schema.names)
        if lost:
            raise ValueError(f"These columns are needed and missing: {', '.join(sorted(lost))}.")
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PacketFiles)


def _chunks(path: str, stored: bool = False) -> Iterator[bytes]:
    """A file's lines, or its bytes as ``stored``."""
    system, file = _at(path)
    with system.open_input_stream(file, compression=None if stored else "detect") as f:
        while chunk := f.read(CHUNK):
            yield chunk


def _lines(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of files (file, sha256) in a folder, chunk by chunk, after a first pass over each file for its digest."""
    for file, sha256 in ((r["file"], r["sha256"]) for b in batches for r in b.to_pylist()):
        digest = hashlib.sha256()
        try:
            for chunk in _chunks(f"{path}/{file}", stored=True):
                digest.update(chunk)
        except FileNotFoundError:
            digest = None
        if digest is None or digest.hexdigest() != sha256:
            raise ValueError(f"{file} isn't the file that was published.")
        begun = b""
        for chunk in _chunks(f"{path}/{file}"):
            *whole, begun = (begun + chunk).split(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([x for x in whole if x], pa.string())], ["line"])


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, html) of the files that the manifest lists; a file that has other bytes than it did fails the read."""
    manifest = read_manifest(path)
    if manifest is None:
        raise ValueError(f"{path} has no manifest: nothing was published there.")
    ship(spark)
    listed = spark.createDataFrame([(m["file"], m["sha256"]) for m in manifest["files"]], "file string, sha256 string")
    lines = listed.repartition(max(1, len(manifest["files"]))).mapInArrow(partial(_lines, path), "line string")  # a file a task
    return lines.select(F.from_json("line", SCHEMA, {"mode": "FAILFAST"}).alias("x")).select("x.*")
