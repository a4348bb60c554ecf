"""Line deduplication by site-relative frequency: lines on more than a share of a host's pages are boilerplate.

Pages are grouped by host; pages of the same lines in the same order (blanks at the lines' ends and blank lines aside)
count as one page, however many copies there are: that a page is copied doesn't make its lines boilerplate. A line's
frequency is the number of the host's pages that hold it, divided by the number of the host's pages; lines over ``ratio`` are dropped from all of that host's pages, if at least ``min_pages`` pages hold
them (a line on one page of a small host is not repeated). A line counts once for a page, blanks at its ends aside.

Counting is two aggregations: pages by (host, 128-bit hash of the content), of which one of each is kept, with the
64-bit hashes of its lines; then lines by (host, hash). Both are summed within each task before the shuffle, so a host, a
page or a line of a third of all rows is no hot key. Lines held by fewer than ``min_pages`` pages, nearly all, are gone before any
join. What is left has at most (lines of a page) / ratio lines for a host: one row of its lines a host, joined to the
pages on a freshly hashed key. Spark sends that table to all tasks while it is under its broadcast threshold, and
splits hot hosts where it is not.

Defined results: a null text stays null and has no lines; an empty one stays empty; blank lines are never counted or
dropped; a null host is a host of its own; a frequency equal to the ratio keeps the line; copies all lose the
same lines; all pages without lines count as one; repeated rows and null ids stay rows of their own; an empty table gives
an empty result; other columns pass through ``drop_lines`` unchanged, whatever their names (``n_lines`` and ``n_removed``
get a ``_`` at the end where a column has that name).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded, fresh, pieces, written

RATIO, MIN_PAGES = 0.1, 2
_HIDDEN = re.compile(r"<(?:(!--)|(script|style)\b)", re.I)
_ENDS = {"!--": re.compile("-->"), "script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>|<!doctype[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")


def text_lines(text: str) -> list[str]:
    return text.split("\n")


def _shown(page: str) -> str:
    """The page without comments, scripts and styles that end; in one pass, however many of them don't."""
    parts, at, begin, endless = [], 0, 0, set()
    while len(endless) < len(_ENDS) and (m := _HIDDEN.search(page, begin)):
        kind, begin = (m.group(1) or m.group(2)).lower(), m.end()
        if kind in endless:
            continue
        inner = begin if kind == "!--" else page.find(">", begin) + 1
        end = _ENDS[kind].search(page, inner) if inner else None
        if end is None:  # none of this kind ends from here on
            endless.add(kind)
            continue
        parts += [page[at : m.start()], " "]
        at = begin = end.end()
    return "".join([*parts, page[at:]])


def page_lines(page: str) -> list[str]:
    """The lines of text that a web page shows, one for each block of it."""
    page = _shown(page)
    last = page.rfind(">") + 1  # no tag ends behind it
    text = _TAG.sub("", _BLOCK.sub("\n", page[:last])) + page[last:]
    return [x for x in (" ".join(line.split()) for line in html.unescape(text).split("\n")) if x]


def line_hash(line: str) -> int:
    """Of a line without blanks at its ends; 0 for a blank one."""
    line = line.strip()
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if line else 0


def boilerplate(df: DataFrame, *, host: Column, text_col: str, lines: Callable[[str], list[str]] = text_lines, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, line, pages, total): hashes of the lines over the ratio. A null host is written as an empty _host, others after a '='."""
    pages = df.select(_host_key(host).alias("_host"), F.col(text_col).alias("_text"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                found = [np.array([x for x in map(line_hash, lines(t) if t else []) if x], "<i8") for t in piece.column(1).to_pylist()]
                content = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found), "<i8").reshape(-1, 2)
                # line 0 stands for the page itself
                held = pa.array([np.append(np.unique(x), 0) for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(content[:, 0]), pa.array(content[:, 1]), held], ["_host", "c1", "c2", "held"])

    once = pages.mapInArrow(bounded(contents), "_host string, c1 long, c2 long, held array<long>").groupBy("_host", "c1", "c2").agg(F.first("held").alias("held"))
    counts = once.select("_host", F.explode("held").alias("line")).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counts = written(counts.where((F.col("line") == 0) | (F.col("pages") >= min_pages)), "lines")
    totals = counts.where("line = 0").select("_host", F.col("pages").alias("total"))
    return written(counts.where("line <> 0").join(totals, "_host").where(F.col("pages") > ratio * F.col("total")), "boilerplate")


def _host_key(host: Column) -> Column:
    return F.when(host.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), host.cast("string")))


def drop_lines(df: DataFrame, found: DataFrame, *, host: Column, text_col: str, lines: Callable[[str], list[str]] = text_lines, counted: bool = False) -> DataFrame:
    """The rows of ``df`` with the found lines gone from ``text_col``. With ``counted`` also n_lines and n_removed."""
    names, place = df.columns, df.columns.index(text_col)
    key, again, mine, drop, n_lines, n_removed = fresh(df, "_line_host", "_line_key", "_found_host", "_drop", "n_lines", "n_removed")
    counters = [n_lines, n_removed] * counted
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{c}` long" for c in counters)])
    lists = found.groupBy("_host").agg(F.collect_set("line").alias(drop)).select(F.xxhash64("_host").alias(again), F.col("_host").alias(mine), drop)
    rows = df.withColumn(key, _host_key(host))
    joined = rows.join(lists, (F.xxhash64(rows[key]) == lists[again]) & (rows[key] == lists[mine]), "left").select(*(F.col(f"`{c}`") for c in names), key, drop)

    def rewrite(batch: pa.RecordBatch, drops: dict[str, set[int]]) -> pa.RecordBatch:
        texts, n, removed = [], [], []
        hosts = batch.column(len(names)).to_pylist()
        for i, (t, h) in enumerate(zip(batch.column(place).to_pylist(), hosts, strict=True)):
            if h not in drops:
                drops[h] = set(batch.column(len(names) + 1)[i].as_py() or ())
            gone = drops[h]
            all_lines = lines(t) if t else []
            kept = [x for x in all_lines if line_hash(x) not in gone] if gone else all_lines
            texts.append(t if len(kept) == len(all_lines) and lines is text_lines else None if t is None else "\n".join(kept))
            n.append(len(all_lines))
            removed.append(len(all_lines) - len(kept))
        columns = [batch.column(i) for i in range(len(names))]
        columns[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(n, pa.int64()), pa.array(removed, pa.int64())] * counted], names + counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops: dict[str, set[int]] = {}  # one host's list is read once a batch
            for piece in pieces(batch, place):
                yield rewrite(piece, drops)

    return joined.mapInArrow(bounded(run), schema)
