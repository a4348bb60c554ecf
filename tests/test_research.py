import csv
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import scalars
from ledgerlight.operators import research
from ledgerlight.sources import artifacts, complaints_csv, outputs, refresh, sinks, uploads

HEAD = ["Date received", "Product", "Sub-product", "Issue", "Sub-issue", "Consumer complaint narrative", "Complaint ID"]
ROWS = [
    ["2025-01-02", "Debt collection", "Medical debt", "Attempts to collect debt not owed", "Debt was paid", 'I already  paid, see the "receipt"\nand EOB', "1"],
    ["02/03/2025", "Debt collection", "Medical debt", "Attempts to collect debt not owed", "Debt is not yours", 'i ALREADY paid, see the "receipt" and eob', "2"],
    ["2025-01-05", "Debt collection", "Medical debt", "Other", "x", "  ", "3"],
    ["2025-02-05", "Debt collection", "Medical debt", "Other", "x", "The bill was wrong", "4"],
    ["never", "Debt collection", "Other debt", "Other", "x", "paid in full", "5"],
    ["never", "Card", "Medical debt", "Other", "x", "paid in full", "6"],
]


@pytest.fixture(scope="module")
def complaints(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zip")
    text = io.StringIO()
    csv.writer(text).writerows([HEAD, *ROWS])
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "﻿" + text.getvalue())
    (folder / "a.csv").write_text(text.getvalue())
    zipped = complaints_csv.read_zipped(spark, str(folder / "a.zip")).cache()
    plain = complaints_csv.read_csv(spark, str(folder / "a.csv"))
    assert sorted(r["complaint_id"] for r in plain.collect()) == sorted(r["complaint_id"] for r in zipped.collect())
    return zipped


def test_totals(complaints):
    assert research.archive_totals(complaints).first().asDict() == {"total_rows": 6, "medical_total": 4, "with_narrative": 3, "without_narrative": 1, "unique_narratives": 2, "duplicate_narratives": 1}
    assert research.coverage_pct(research.archive_totals(complaints)).first()[0] == 75.0
    assert tuple(research.period_guard(complaints).first()) == (0, 0)


def test_labels(complaints):
    assert {r["id"]: r["count"] for r in research.document_mentions(complaints).collect()} == {"eob": 1, "bill": 1, "receipt": 1, "collection_notice": 0}
    first = {r["complaint_id"]: list(r["matched_patterns"]) for r in research.narrative_extract(complaints).collect()}
    assert first == {"1": ["paid_language", "insurance_language"], "4": []}
    matrix = research.pattern_matrix(complaints).collect()
    assert len(matrix) == 20 and sum(r["count"] for r in matrix) == 4


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfBalance: 1")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.exe").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["problem"] is None) for r in uploads.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Balance: 1", True), "b.txt": (None, False), "c.exe": (None, False)}


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in members.items():
            text = io.StringIO()
            csv.writer(text).writerows(rows)
            z.writestr(name, text.getvalue())
    return str(path)


def test_archives_are_checked(spark, tmp_path):
    good = archive(tmp_path / "good.zip", {"x/Y.CSV": [HEAD, *ROWS], "note.txt": [["x"]]})
    assert complaints_csv.read_zipped(spark, good, sha256=uploads.file_sha256(good)).count() == 6
    bad = {"two": {"a.csv": [HEAD], "b.csv": [HEAD]}, "none": {"a.txt": [HEAD]}, "columns": {"a.csv": [HEAD[1:], ROWS[0][1:]]}}
    for name, members in bad.items():
        with pytest.raises(Exception, match="CSV files instead|lacks the columns"):
            complaints_csv.read_zipped(spark, archive(tmp_path / f"{name}.zip", members)).count()
    with pytest.raises(Exception, match="pinned"):
        complaints_csv.read_zipped(spark, good, sha256="0" * 64).count()


def test_positions_follow_files_and_rows(spark, tmp_path):
    for k, name in enumerate(("b b", "a", "c")):
        rows = [HEAD, *([*r[:-1], f"{name}{i}"] for i, r in enumerate(ROWS[: 2 + k]))]
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(f'"{x.replace(chr(34), chr(34) * 2)}"' for x in r) for r in rows))
        archive(tmp_path / f"{name}.zip", {"t.csv": rows})
    want = ["a0", "a1", "a2", "b b0", "b b1", "c0", "c1", "c2", "c3"]
    for df in (complaints_csv.read_csv(spark, str(tmp_path / "*.csv")), complaints_csv.read_zipped(spark, str(tmp_path))):
        assert [r["complaint_id"] for r in df.orderBy("row_idx").collect()] == want


def test_labels_are_in_order(complaints):
    assert [(r["label"], r["count"]) for r in research.top_labels(research.prepared(complaints), "issue").collect()] == [("Attempts to collect debt not owed", 2), ("Other", 2)]


def response(tmp_path, name, hits):
    body = {"hits": {"total": {"value": 3}, "hits": [{"_source": h} for h in hits]}, "aggregations": {"issue": {"issue": {"buckets": []}}}, "_meta": {"last_indexed": "2025"}}
    (tmp_path / name).write_text(json.dumps(body))
    return f"file://{tmp_path / name}"


def test_responses_are_verified_and_kept_with_their_source(spark, tmp_path):
    ours = {"product": "Debt collection", "sub_product": "Medical debt", "complaint_what_happened": "x"}
    good, kept = response(tmp_path, "good.json", [ours]), str(tmp_path / "kept.json")
    assert uploads.fetch_api(spark, good, kept).first()["hits"]["total"]["value"] == 3
    note = uploads.read_sidecar(kept)
    assert note["source_url"] == good and note["sha256"] == uploads.file_sha256(kept) and note["retrieved_at"].endswith("+00:00")
    for hits in ([], [ours, {**ours, "sub_product": "Other"}]):
        bad = response(tmp_path, "bad.json", hits)
        with pytest.raises(ValueError, match="product asked for"):
            uploads.fetch_api(spark, bad, str(tmp_path / "new.json"))
        with pytest.raises(ValueError, match="product asked for"):
            uploads.verified_api(spark, bad)
    assert not os.path.exists(tmp_path / "new.json") and not os.path.exists(tmp_path / "new.json.part")
    (tmp_path / "page.html").write_text("{}")
    with pytest.raises(ValueError, match="not JSON"):
        uploads.fetch_api(spark, f"file://{tmp_path}/page.html", str(tmp_path / "new.json"))
    os.remove(tmp_path / "good.json")
    assert uploads.cached_api(spark, good, kept, reuse=True)[1] == note  # not fetched again
    os.remove(uploads.sidecar_path(kept))
    assert set(uploads.cached_api(spark, good, kept, given=True)[1]) == {"retrieved_at"}


def test_downloads_are_bounded_and_pinned(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 5000)
    url, digest = f"file://{tmp_path}/a.bin", uploads.file_sha256(tmp_path / "a.bin")
    sources = spark.createDataFrame([(url, digest), (url, None), (url, "0" * 64), (f"{url}.gone", None)], "url string, sha256 string")
    got = [tuple(r) for r in uploads.fetched(sources).collect()]
    assert got[0] == got[1] == (url, bytearray(b"x" * 5000), digest, None)
    assert got[2] == (url, None, None, "not the file that was pinned") and got[3][1:3] == (None, None) and got[3][3].startswith("can't be fetched")
    assert [r["problem"] for r in uploads.fetched(sources, limit=4999).collect()][:3] == ["over 4999 bytes"] * 3


def test_archives_are_fetched_by_tasks(spark, tmp_path):
    urls = [f"file://{archive(tmp_path / f'{n}.zip', {'t.csv': [HEAD, *ROWS[:k]]})}" for n, k in (("b", 2), ("a", 3))]
    sources = spark.createDataFrame([(u, uploads.file_sha256(u.removeprefix("file://"))) for u in urls], "url string, sha256 string")
    assert [r["complaint_id"] for r in complaints_csv.fetch_zipped(sources).orderBy("row_idx").collect()] == ["1", "2", "3", "1", "2"]
    with pytest.raises(Exception, match="not the file that was pinned"):
        complaints_csv.fetch_zipped(sources.withColumn("sha256", F.lit("0" * 64))).count()


def test_pdfs_by_what_tasks_find(spark, tmp_path, monkeypatch):
    """A stand-in for the parser: what is said of each file follows from what the task found in it."""
    import pyarrow as pa

    found = {"good": (False, 2, ["one", "two"]), "locked": (True, None, None), "broken": (False, None, None), "long": (False, 13, None), "scan": (False, 1, [" \n"]), "wide": (False, 1, ["x" * 60_001])}
    for name in (*found, "huge", "text"):
        (tmp_path / f"{name}.{'txt' if name == 'text' else 'PDF'}").write_bytes(b"x" * (uploads.UPLOAD_BYTES + 1 if name == "huge" else 3))

    def pages(batches):
        for b in batches:
            rows = [found[p.rsplit("/", 1)[1].split(".")[0]] for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["path", "locked", "n", "pages"])

    monkeypatch.setattr(uploads, "_pdf_pages", pages)
    got = {r["path"].rsplit("/", 1)[1].split(".")[0]: (r["text"], r["problem"]) for r in uploads.read_pdfs(spark, str(tmp_path)).collect()}
    assert got == {"good": ("one\ftwo", None), "locked": (None, uploads.LOCKED), "broken": (None, uploads.BROKEN), "long": (None, uploads.MANY_PAGES), "scan": (None, uploads.NO_TEXT), "wide": (None, uploads.TOO_LONG), "huge": (None, uploads.TOO_LARGE)}


def test_pages_are_taken_out_of_pdfs(monkeypatch):
    import sys
    import types

    import pyarrow as pa

    class Reader:
        def __init__(self, data):
            kind = data.read().decode()
            if kind == "bad":
                raise KeyError("xref")
            self.is_encrypted = kind == "locked"
            self.pages = [types.SimpleNamespace(extract_text=lambda: None if kind == "bare" else "t")] * (13 if kind == "long" else 2)

        def get_num_pages(self):
            return len(self.pages)

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    names = ["fine", "bare", "locked", "long", "bad"]
    (out,) = uploads._pdf_pages([pa.RecordBatch.from_arrays([pa.array(names), pa.array([n.encode() for n in names])], ["path", "content"])])
    assert [tuple(r.values()) for r in out.to_pylist()] == [("fine", False, 2, ["t", "t"]), ("bare", False, 2, ["", ""]), ("locked", True, None, None), ("long", False, 13, None), ("bad", False, None, None)]


def test_artifacts_are_read_whatever_they_hold(spark, tmp_path):
    counts = [{"label": "b", "count": 2}, {"label": "a", "count": 1}]
    value = {"scope": {"year": "2025"}, "caveats": ["mind"], "api": {"total_complaints": 8843, "issue_counts": counts}, "archive": {"unique_narratives": 12, "patterns": counts, "examples": [{"complaint_id": str(i), "issue": "i", "narrative_excerpt": "n"} for i in range(9)]}}
    sinks.write_json(str(tmp_path / "deep" / "a.json"), value)
    rows = [tuple(r) for r in artifacts.panel(artifacts.read_artifact(spark, str(tmp_path / "deep" / "a.json"))).collect()]
    assert [r[3] for r in rows if r[0] == "stat"] == ["8,843", "Not measured", "12"]
    assert [r[1:] for r in rows if r[0] == "issues"] == [(0, "b", "2"), (1, "a", "1")] and not [r for r in rows if r[0] == "documents"]
    assert len([r for r in rows if r[0] == "example"]) == 6 and ("caveat", 0, None, "mind") in rows
    for name, text in (("broken", '{"api": '), ("list", "[1]"), ("empty", "")):
        (tmp_path / name).write_text(text)
        got = artifacts.read_artifact(spark, str(tmp_path / name))
        assert got.first()["problem"] == artifacts.UNREADABLE and artifacts.panel(got).count() == 0, name
    assert artifacts.read_artifact(spark, str(tmp_path / "nothing.json")).first()["problem"] == artifacts.MISSING


def test_json_sinks(spark, complaints, tmp_path):
    sinks.write_json(str(tmp_path / "a.json"), {"é": 1})
    assert (tmp_path / "a.json").read_text() == '{\n  "é": 1\n}\n'
    sinks.write_narratives(complaints, str(tmp_path / "n"))
    assert {r["complaint_id"] for r in spark.read.json(str(tmp_path / "n")).collect()} == {"1", "4"}
    found = refresh.refresh(complaints, str(tmp_path / "out"))
    assert found["unique_narratives"] == 2 and found["issue_counts"][0] == {"label": "Attempts to collect debt not owed", "count": 2}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.bin").write_bytes(b"123")
    entry = sinks.source_entry("s", "u", str(tmp_path / "raw" / "s.bin"), "d", "t", str(tmp_path))
    assert entry == {"name": "s", "source_url": "u", "retrieved_at": "t", "sha256": "d", "bytes": 3, "local_path": "raw/s.bin"}
    sinks.manifest(str(tmp_path / "m.json"), [entry], "/elsewhere/out.json", "e", generated_at="g", root=str(tmp_path))
    assert json.loads((tmp_path / "m.json").read_text())["output"] == {"path": "out.json", "sha256": "e"}
    assert json.loads(sinks.headline_numbers(9, found, "o"))["with_narratives"] == 3
    packets = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(50)], "case_id long, html string")
    sinks.write_packets(packets, str(tmp_path / "p"), files=4)
    assert len(list((tmp_path / "p").glob("part-*"))) <= 4 and spark.read.json(str(tmp_path / "p")).count() == 50


def test_case_folding(spark):
    df = spark.createDataFrame([("Straße  nord",), ("STRASSE nord",)], "t string")
    strict, plain = (df.select(scalars.narrative_hash(F.col("t"), s).alias("h")).distinct().count() for s in (True, False))
    assert (strict, plain) == (1, 2)


def test_pasted_text(spark):
    assert uploads.pasted(spark, " \u00a0Balance: 1\n").first()["text"] == "Balance: 1"
    with pytest.raises(ValueError):
        uploads.pasted(spark, " \n")


def plain_refresh(spark, rows):
    """The artifact's numbers by separate queries, each with a scan of its own."""
    made, top = research.prepared(rows), lambda df, c: [{"label": r["label"], "count": r["count"]} for r in research.top_labels(df, c).collect()]
    totals, owed = research.archive_totals(rows).first(), F.col("issue") == "Attempts to collect debt not owed"
    named = lambda df, *keys: [{k: r[k] for k in keys} for r in df.orderBy("ordinal").collect()]
    return {
        "archive_total_rows": totals["total_rows"], "medical_total": totals["medical_total"], "medical_with_narrative": totals["with_narrative"], "medical_without_narrative": totals["without_narrative"],
        "unique_narratives": totals["unique_narratives"], "duplicate_narratives": totals["duplicate_narratives"], "narrative_coverage_pct": research.coverage_pct(research.archive_totals(rows)).first()[0],
        "monthly_counts": top(made.withColumn("month", F.date_format("received", "yyyy-MM")), "month"), "issue_counts": top(made, "issue"), "not_owed_subissues": top(made.where(owed), "sub_issue"),
        "narrative_issue_counts_before_dedup": top(made.where("narrative is not null"), "issue"), "unique_not_owed_subissues": top(research.unique_narratives(rows).where(owed), "sub_issue"),
        "patterns": named(research.pattern_counts(rows), "id", "label", "count"), "document_mentions": named(research.document_mentions(rows), "id", "label", "count"),
        "pattern_document_matrix": named(research.pattern_matrix(rows), "pattern_id", "document_id", "count"),
    }


def test_refresh_scans_once_and_publishes_whole(spark, tmp_path):
    from ledgerlight.plans import queries

    rows, read = queries.complaints(spark, "/root/testdata/sf0.001"), spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    path = str(tmp_path / "out")
    got = refresh.refresh(rows.mapInArrow(counting, rows.schema), path)
    assert read.value == rows.count()  # one scan
    assert got == plain_refresh(spark, rows)
    assert json.loads(spark.read.text(f"{path}/artifact").first()[0]) == got
    written = {r["narrative_sha256"]: (r["complaint_id"], r["matched_patterns"]) for r in spark.read.json(f"{path}/narratives").collect()}
    assert written == {r["narrative_sha256"]: (r["complaint_id"], r["matched_patterns"]) for r in research.narrative_extract(rows).collect()}
    bad = rows.where("row_idx < 100").unionByName(rows.where("row_idx = 3 and product is not null").limit(1).withColumn("date_received", F.lit("2025-03-01")).withColumn("product", F.lit("Debt collection")).withColumn("sub_product", F.lit("Medical debt")))
    with pytest.raises(refresh.OutOfPeriod, match="^1 medical rows"):
        refresh.refresh(bad, path)
    with pytest.raises(refresh.OutOfPeriod):
        refresh.refresh(bad, str(tmp_path / "other"))
    assert json.loads(spark.read.text(f"{path}/artifact").first()[0]) == got and [x.name for x in tmp_path.iterdir()] == ["out"]  # as it was
    again = refresh.refresh(rows.where("row_idx < 100"), path)
    assert json.loads(spark.read.text(f"{path}/artifact").first()[0]) == again != got and [x.name for x in tmp_path.iterdir()] == ["out"]
    none = refresh.refresh(rows.limit(0), str(tmp_path / "none"))
    assert none["unique_narratives"] == none["archive_total_rows"] == 0 and none["issue_counts"] == []
    assert not outputs.exists(spark, str(tmp_path / "nothing"))
