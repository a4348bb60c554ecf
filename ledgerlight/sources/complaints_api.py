"""Pages of a complaint search API as a Spark data source.

``register(spark)``, then ``spark.read.format("complaints_api")`` with one of

* ``url``: a template with ``{from}`` and ``{size}``. The planner asks for the first page, whose total tells how many there
  are; each page is then a partition, fetched by the task that reads it.
* ``urls``: a JSON list of saved or prepared pages, each a partition, whose totals are of their own hits.

Other options: ``size`` (hits of a page), ``product`` and ``sub_product`` (what was asked for), ``page_bytes`` (of an answer),
``tries`` and ``timeout`` (seconds). A page counts only if every hit is of the product asked for, its total is the one that
was planned with, and it is as long as its place asks for: a page that breaks off, or an index that changes while it is
read, fails the read instead of shortening it. ``row_idx`` is the hit's place in the search, or with ``urls`` the place of its
page above that of the hit.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerlight.functions.constants import PRODUCT, SUB_PRODUCT
from ledgerlight.shipping import ship

#: Columns and where a hit has them.
FIELDS = {"complaint_id": "complaint_id", "date_received": "date_received", "product": "product", "sub_product": "sub_product", "issue": "issue", "sub_issue": "sub_issue", "narrative": "complaint_what_happened"}
PAGE_ROWS = 32  # bits of a hit's place on a page of ``urls``
SCHEMES = ("http", "https", "file")
PAUSE = 0.5  # seconds before a second try; doubled each time


@dataclass
class Page(InputPartition):
    url: str
    first: int  # row_idx of its first hit
    total: int | None  # of the whole search; None: of the page itself
    hits: int | None  # that it must have


def fetch(url: str, most: int, tries: int, timeout: float) -> dict:
    """The JSON object at a URL, of at most ``most`` bytes. Failures that may pass are tried again."""
    if url.partition(":")[0] not in SCHEMES:
        raise ValueError(f"{url} isn't one of {', '.join(SCHEMES)}.")
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as source:
                data = source.read(most + 1)
            break
        except urllib.error.HTTPError as e:
            if not left or (e.code < 500 and e.code != 429):
                raise ValueError(f"{url} answers {e.code}.") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if not left:
                raise ValueError(f"{url} can't be read: {e}.") from e
        time.sleep(PAUSE * 2 ** (tries - 1 - left))
    if len(data) > most:
        raise ValueError(f"{url} answers with more than {most} bytes.")
    try:
        found = json.loads(data)
    except ValueError as e:
        raise ValueError(f"{url} doesn't answer in JSON.") from e
    if not isinstance(found, dict):
        raise ValueError(f"{url} doesn't answer with an object.")
    return found


def total_of(answer: dict, url: str) -> int:
    total = (answer.get("hits") or {}).get("total")
    total = total.get("value") if isinstance(total, dict) else total
    if not isinstance(total, int) or isinstance(total, bool) or total < 0:
        raise ValueError(f"{url} tells no total.")
    return total


class Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.size, self.most, self.tries = int(options.get("size", 1000)), int(options.get("page_bytes", 64 << 20)), int(options.get("tries", 3))
        self.timeout = float(options.get("timeout", 60))
        self.wanted = {"product": options.get("product", PRODUCT), "sub_product": options.get("sub_product", SUB_PRODUCT)}
        if self.size < 1 or self.tries < 1:
            raise ValueError("size and tries are 1 or more.")
        if ("url" in options) == ("urls" in options):
            raise ValueError("Give either url or urls.")

    def _url(self, first: int) -> str:
        return self.options["url"].replace("{from}", str(first)).replace("{size}", str(self.size))

    def partitions(self) -> list[Page]:
        if "urls" in self.options:
            return [Page(u, i << PAGE_ROWS, None, None) for i, u in enumerate(json.loads(self.options["urls"]))]
        url = self._url(0)
        total = total_of(fetch(url, self.most, self.tries, self.timeout), url)
        return [Page(self._url(k), k, total, min(self.size, total - k)) for k in range(0, total, self.size)]

    def read(self, page: Page | None) -> Iterator[pa.RecordBatch]:
        if page is None:  # Spark's partition where there are none
            return
        answer = fetch(page.url, self.most, self.tries, self.timeout)
        hits, total = answer.get("hits", {}).get("hits") or [], total_of(answer, page.url)
        sources = [h.get("_source") or {} for h in hits]
        wrong = sum(any(s.get(k) != v for k, v in self.wanted.items()) for s in sources)
        if wrong:
            raise ValueError(f"{page.url}: {wrong} of {len(hits)} hits aren't of the product asked for.")
        if page.total is not None and total != page.total:
            raise ValueError(f"{page.url}: the search had {page.total} hits and now has {total}.")
        if len(hits) != (total if page.hits is None else page.hits):
            raise ValueError(f"{page.url} has {len(hits)} hits in place of {total if page.hits is None else page.hits}.")
        text = lambda v: "" if v is None else str(v)
        columns = [pa.array([text(s.get(f)) for s in sources], pa.string()) for f in FIELDS.values()]
        yield pa.RecordBatch.from_arrays([pa.array(range(page.first, page.first + len(hits)), pa.int64()), *columns], ["row_idx", *FIELDS])


class ComplaintsApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "complaints_api"

    def schema(self) -> str:
        return "row_idx long, " + ", ".join(f"{c} string" for c in FIELDS)

    def reader(self, schema) -> Pages:
        return Pages(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ComplaintsApi)
