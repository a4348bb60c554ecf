"""Sinks: JSON artifacts and manifests of one row, JSON lines of narratives, packets as files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame

from ledgerlight.operators import research


def write_json(path: str, value: object) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_narratives(complaints: DataFrame, path: str) -> None:
    """One JSON object for each unique narrative."""
    research.narrative_extract(complaints).write.json(path)


def write_packets(packets: DataFrame, path: str, files: int = 200) -> None:
    """(case_id, html) as JSON lines in ``files`` files, cases in order within each: a packet is found by its case_id."""
    packets.select("case_id", "html").repartition(files, "case_id").sortWithinPartitions("case_id").write.json(path)


def source_entry(name: str, url: str, path: str, sha256: str, retrieved_at: str, root: str) -> dict:
    return {"name": name, "source_url": url, "retrieved_at": retrieved_at, "sha256": sha256, "bytes": os.path.getsize(path), "local_path": _shown_path(path, root)}


def _shown_path(path: str, root: str) -> str:
    """Relative to the root if below it, else the name alone: no local folders are told."""
    full, base = os.path.abspath(path), os.path.abspath(root)
    return os.path.relpath(full, base) if full.startswith(base + os.sep) else os.path.basename(full)


def manifest(path: str, sources: list[dict], output: str, output_sha256: str, *, generated_at: str, root: str) -> None:
    """Where an artifact's data is from: sources as of ``source_entry``, and the output with its digest."""
    write_json(path, {"schema_version": "1.0", "generated_at": generated_at, "sources": sources, "output": {"path": _shown_path(output, root), "sha256": output_sha256}})


def headline_numbers(api_total: int, totals: dict, output: str) -> str:
    """The run's summary as JSON text: five entries for a command line."""
    return json.dumps({"annual_complaints": api_total, "archive_medical_complaints": totals["medical_total"], "with_narratives": totals["medical_with_narrative"], "unique_narratives": totals["unique_narratives"], "output": output}, indent=2)
