"""Uploaded documents, pasted text, JSON responses and cached inputs."""

from __future__ import annotations

import hashlib
import io
import json
import os
import shutil
import time
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.constants import DOWNLOAD_BYTES, UPLOAD_BYTES, UPLOAD_CHARS, UPLOAD_PAGES
from ledgerlight.functions.scalars import strip
from ledgerlight.operators.research import API_SCHEMA, api_filter_verified
from ledgerlight.shipping import ship
from ledgerlight.sources.sinks import write_json

PLAIN, PDF = r"\.(txt|md)$", r"\.pdf$"
# What can be the matter with a file, in the order it is looked for.
TOO_LARGE, OTHER_KIND, NOT_TEXT, TOO_LONG = "file over 10 MiB", "neither text nor PDF by its name", "not UTF-8", "more than 60,000 characters"
BROKEN, LOCKED, MANY_PAGES, NO_TEXT = "not a PDF that can be parsed", "PDF with a password", "more than 12 pages", "PDF without a text layer"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.lower("path").alias("name"), "content")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of .txt and .md files: UTF-8, with or without a mark, within the bounds. Files that can't be
    used have a problem and no text."""
    decoded = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
    return _judged(
        _files(spark, path).withColumn("given", decoded),
        {TOO_LARGE: F.col("length") > UPLOAD_BYTES, OTHER_KIND: ~F.col("name").rlike(PLAIN), NOT_TEXT: F.col("given").isNull(), TOO_LONG: F.length("given") > UPLOAD_CHARS},
    )


def _judged(rows: DataFrame, problems: dict[str, F.Column]) -> DataFrame:
    """(path, text, problem): the first problem that holds, else the text that is given."""
    problem = F.coalesce(*[F.when(c, F.lit(p)) for p, c in problems.items()])
    return rows.select("path", F.when(problem.isNull(), F.col("given")).alias("text"), problem.alias("problem"))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of text PDFs, pages joined by form feeds. Tasks take the pages out of the files (with pypdf,
    which executors need); what is the matter with one is told from that, as for texts."""
    ship(spark)
    files = _files(spark, path).where(F.col("name").rlike(PDF))
    read = files.where(F.col("length") <= UPLOAD_BYTES).select("path", "content").mapInArrow(_pdf_pages, "path string, locked boolean, n int, pages array<string>")
    rows = files.select("path", "length").join(read, "path", "left").withColumn("given", F.array_join("pages", "\f"))
    blank = F.coalesce(strip(F.regexp_replace("given", "\f", " ")) == "", F.lit(True))
    return _judged(rows, {TOO_LARGE: F.col("length") > UPLOAD_BYTES, BROKEN: F.col("n").isNull() & ~F.col("locked"), LOCKED: F.col("locked"), MANY_PAGES: F.col("n") > UPLOAD_PAGES, NO_TEXT: blank, TOO_LONG: F.length("given") > UPLOAD_CHARS})


def _pdf_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, locked, n, pages): n is null for what isn't a PDF; pages are taken only of one that may be used."""
    import pypdf

    for batch in batches:
        rows = []
        for content in batch.column(1):
            locked, n, pages = False, None, None
            try:
                found = pypdf.PdfReader(io.BytesIO(content.as_py()))
                locked = found.is_encrypted
                if not locked:
                    n = found.get_num_pages()
                    pages = [x.extract_text() or "" for x in found.pages] if n <= UPLOAD_PAGES else None
            except Exception:  # a parser meets any bytes here; whatever it raises, the file can't be read
                locked, n, pages = False, None, None
            rows.append((locked, n, pages))
        types = (pa.bool_(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["path", "locked", "n", "pages"])


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """One row with the stripped text; blank text is refused."""
    if not (text or "").strip():
        raise ValueError("Paste the document's text first.")
    return spark.createDataFrame([(text,)], "text string").select(strip(F.col("text")).alias("text"))


def read_api(spark: SparkSession, path: str) -> DataFrame:
    """A cached JSON response with its schema."""
    return spark.read.schema(API_SCHEMA).json(path, multiLine=True, mode="FAILFAST")


def verified_api(spark: SparkSession, path: str) -> DataFrame:
    """A cached response, refused unless it has hits and all of them are of the product asked for."""
    response = read_api(spark, path)
    if not response.transform(api_filter_verified).agg(F.coalesce(F.bool_and("verified"), F.lit(False))).first()[0]:
        raise ValueError("The response's rows are not all of the product asked for.")
    return response


def fetch_api(spark: SparkSession, url: str, path: str) -> DataFrame:
    """Get a JSON response, keep it at a local ``path`` with a sidecar of where it is from, and return it verified. What
    can't be verified isn't kept."""
    part = f"{path}.part"
    try:
        with urllib.request.urlopen(url, timeout=90) as source:
            kind = source.headers.get_content_type()
            if kind != "application/json":
                raise ValueError(f"The answer is {kind}, not JSON.")
            with open(part, "wb") as out:
                shutil.copyfileobj(source, out)
        verified_api(spark, f"file://{os.path.abspath(part)}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    write_sidecar(path, url)
    return verified_api(spark, f"file://{os.path.abspath(path)}")


def sidecar_path(path: str) -> str:
    return os.path.splitext(path)[0] + ".metadata.json"


def write_sidecar(path: str, url: str, retrieved_at: str | None = None) -> None:
    write_json(sidecar_path(path), {"source_url": url, "retrieved_at": retrieved_at or utc(time.time()), "sha256": file_sha256(path)})


def read_sidecar(path: str) -> dict:
    """Where a cached file is from; without a sidecar only the file's own time is known."""
    try:
        with open(sidecar_path(path), encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        found = {}
    return {"retrieved_at": utc(os.path.getmtime(path)), **found}


def cached_api(spark: SparkSession, url: str, path: str, *, reuse: bool = False, given: bool = False) -> tuple[DataFrame, dict]:
    """The response and its provenance: from ``path`` if that was ``given`` or may be reused and is there, else fetched."""
    if given or (reuse and os.path.exists(path)):
        response = verified_api(spark, f"file://{os.path.abspath(path)}")
    else:
        response = fetch_api(spark, url, path)
    return response, read_sidecar(path)


def utc(seconds: float) -> str:
    return datetime.fromtimestamp(int(seconds), UTC).isoformat()


def fetched(sources: DataFrame, limit: int = DOWNLOAD_BYTES) -> DataFrame:
    """(url, content, sha256, problem) of sources (url, sha256): each is fetched by a task, which reads no more than the
    limit. What is over it, doesn't have the digest that is given, or can't be fetched has a problem and no content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, pinned in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                problem, digest, data = None, None, b""
                try:
                    data = urllib.request.urlopen(url, timeout=60).read(limit + 1)
                    digest = hashlib.sha256(data).hexdigest()
                except OSError as e:
                    problem = f"can't be fetched: {e}"
                if len(data) > limit:
                    problem = f"over {limit} bytes"
                elif digest and pinned and pinned != digest:
                    problem = "not the file that was pinned"
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([None if problem else data], pa.binary()), pa.array([None if problem else digest], pa.string()), pa.array([problem], pa.string())], ["url", "content", "sha256", "problem"])

    return sources.select("url", "sha256").mapInArrow(run, "url string, content binary, sha256 string, problem string")


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()
