"""The search API's data source against a local server that can misbehave."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import research
from ledgerlight.sources import complaints_api

OURS = {"product": "Debt collection", "sub_product": "Medical debt"}
HITS = [{"_source": {**OURS, "complaint_id": f"C{i}", "date_received": "2025-01-02", "issue": "Other", "sub_issue": None, "complaint_what_happened": f"told {i % 4}" if i % 3 else ""}} for i in range(23)]


class Server:
    """Serves HITS page by page; ``spoil`` changes an answer on its way out, ``asked`` lists the first hits asked for."""

    def __init__(self):
        self.spoil, self.asked, self.lock = (lambda first, answer: answer), [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
                with outer.lock:
                    outer.asked.append(q["frm"])
                answer = outer.spoil(q["frm"], {"hits": {"total": {"value": len(HITS)}, "hits": HITS[q["frm"] : q["frm"] + q["size"]]}})
                data = b"" if isinstance(answer, int) else answer if isinstance(answer, bytes) else json.dumps(answer).encode()
                self.send_response(answer if isinstance(answer, int) else 200)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/search?frm={{from}}&size={{size}}"


@pytest.fixture
def server(spark):
    complaints_api.register(spark)
    s = Server()
    yield s
    s.http.shutdown()


def read(spark, server, **options):
    return spark.read.format("complaints_api").options(url=server.url, size=5, tries=2, **options).load()


def test_pages_are_partitions(spark, server):
    df = read(spark, server)
    assert df.rdd.getNumPartitions() == 5
    server.asked.clear()
    rows = sorted(df.collect())
    assert [r["row_idx"] for r in rows] == list(range(23)) and [r["complaint_id"] for r in rows] == [f"C{i}" for i in range(23)]
    assert {r["sub_issue"] for r in rows} == {""} and sorted(server.asked)[-4:] == [5, 10, 15, 20]  # each page by its task
    assert research.archive_totals(df).first()["unique_narratives"] == 4
    assert df.where("row_idx >= 20").select(F.sum("row_idx")).first()[0] == 63


def test_other_sizes(spark, server):
    assert spark.read.format("complaints_api").options(url=server.url, size=100).load().count() == 23
    server.spoil = lambda first, answer: {"hits": {"total": 0, "hits": []}}
    assert read(spark, server).count() == 0


def hit(**changed):
    return {"_source": {**HITS[0]["_source"], **changed}}


@pytest.mark.parametrize(
    ("spoil", "says"),
    [
        (lambda first, a: {"hits": {**a["hits"], "hits": [hit(sub_product="Other debt"), *a["hits"]["hits"][1:]]}} if first == 10 else a, "1 of 5 hits aren't of the product asked for"),
        (lambda first, a: {"hits": {**a["hits"], "hits": a["hits"]["hits"][:-1]}} if first == 20 else a, "has 2 hits in place of 3"),
        (lambda first, a: {"hits": {**a["hits"], "total": {"value": 24}}} if first == 15 else a, "had 23 hits and now has 24"),
        (lambda first, a: b"<html>" if first == 5 else a, "doesn't answer in JSON"),
        (lambda first, a: b"[]" if first == 5 else a, "doesn't answer with an object"),
        (lambda first, a: {"hits": {}}, "tells no total"),
        (lambda first, a: 404, "answers 404"),
        (lambda first, a: 503 if first else a, "answers 503"),
        (lambda first, a: json.dumps(a).encode() + b" " * 70_000 if first == 5 else a, "more than 60000 bytes"),
    ],
)
def test_pages_that_are_refused(spark, server, spoil, says, monkeypatch):
    server.spoil = spoil
    with pytest.raises(Exception, match=says):
        read(spark, server, page_bytes=60_000).collect()


def test_passing_failures_are_tried_again(spark, server):
    seen = set()

    def spoil(first, answer):
        with server.lock:
            if first in seen:
                return answer
            seen.add(first)
            return 503

    server.spoil = spoil
    assert read(spark, server).count() == 23


def test_prepared_pages(spark, server, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"hits": {"total": {"value": 4}, "hits": HITS[4 * k : 4 * k + 4]}}))
    urls = [f"file://{tmp_path}/{k}.json" for k in range(3)]
    df = spark.read.format("complaints_api").option("urls", json.dumps(urls)).load()
    assert [r["complaint_id"] for r in df.orderBy("row_idx").collect()] == [f"C{i}" for i in range(12)] and df.rdd.getNumPartitions() == 3
    for options in ({}, {"url": "x", "urls": "[]"}, {"urls": '["ftp://x/y"]'}, {"url": server.url, "size": "0"}):
        with pytest.raises(Exception, match="Give either|isn't one of|1 or more"):
            spark.read.format("complaints_api").options(**options).load().collect()
