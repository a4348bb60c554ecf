"""Periodic runs: stretches of words that repeat with a period, found exactly and collapsed to their first period.

Naming (Karp, Miller and Rosenberg): a word's name is its number within its document; a block of 2^(k+1) words is named by
the pair of names of its halves, pairs being sorted and numbered. Blocks that occur once in their document get a name of
their own and are left out of the next level's sort, so the levels end where no block repeats. The longest common extension
of two places goes down the levels, one gather and one comparison in NumPy for all candidates at once.

Candidates: a run of period q and length 2q or more has two equal words, q apart, at neighbouring points of the grid of
multiples of q. Both are extended to either side; the stretch is a run if the matches reach over q places. Multiples of a
run's period give the same stretch again, of which the smallest period counts. No hashes of blocks, no suffix order.

Documents of about ``common.SLICE`` bytes are taken together; names are of one document, so nothing runs over its end. A
task holds one slice, or one document: for each word some eight bytes a level, as many levels as its longest repeat has
bits.

Defined results: a null text has no words and no runs; null ids, repeated rows and ties (runs of the same length, or that
overlap) are as any other; a text of one word repeated is one run of period 1; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded, slices

MIN_LENGTH, MIN_REPEATS = 12, 2
CANDIDATES = 1 << 18  # extended at once


def _names(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Names by place, from the keys at some places: equal keys get equal names from 0, all else a negative one of its own;
    and how many keys occur more than once. One more at the end, for the place after the last."""
    out = -1 - np.arange(n + 1)
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys) + 1, bool)
    new[1:-1] = ranked[1:] != ranked[:-1]
    again = ~(new[:-1] & new[1:])  # a neighbour is the same
    out[places[order[again]]] = np.cumsum(new[:-1])[again] - 1
    return out, int(again.sum())


def block_names(words: np.ndarray, documents: np.ndarray) -> list[np.ndarray]:
    """Levels of names: that of the block of 2^k words at a place is levels[k][place]. ``words`` are numbers from 0,
    ``documents`` the document of each word. A block over a document's end equals no other."""
    n = len(words)
    names, repeated = _names(documents.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, np.arange(n), n)
    levels = [names]
    while repeated and 1 << len(levels) <= n:
        half = 1 << (len(levels) - 1)
        left, right = names[: n - half], names[half:n]
        live = np.flatnonzero((left >= 0) & (right >= 0))
        names, repeated = _names(left[live] * (n + 1) + right[live], live, n)
        if repeated:
            levels.append(names)
    return levels


def extension(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """For places x < y, how many words from there on (or before them) are the same."""
    at, to = x.copy(), y.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if back:
            same = (at >= step) & (levels[k][at - step] == levels[k][to - step])
            at -= step * same
            to -= step * same
        else:
            same = levels[k][at] == levels[k][to]
            at += step * same
            to += step * same
    return np.abs(to - y)


def find_runs(words: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Rows (start, end, period) of the runs of consecutive documents, in order; places count over all documents, whose
    words lie between ``offsets``."""
    n, sizes = len(words), np.diff(offsets)
    levels = block_names(words, np.repeat(np.arange(len(sizes)), sizes))
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, int]] = []
    held = 0

    def extend() -> None:
        x = np.concatenate([a for a, _ in waiting])
        q = np.repeat([b for _, b in waiting], [len(a) for a, _ in waiting])
        start = x - extension(levels, x, x + q, back=True)
        end = x + q + extension(levels, x, x + q)
        good = end - start >= np.maximum(min_length, min_repeats * q)
        found.append(_distinct(np.stack((start, end, q), 1)[good]))

    for q in range(1, int(sizes.max(initial=0)) // min_repeats + 1):
        at = np.flatnonzero(levels[0][: n - q : q] == levels[0][q:n:q])
        if len(at):
            waiting.append((at * q, q))
            held += len(at)
            if held >= CANDIDATES:
                extend()
                waiting, held = [], 0
    if waiting:
        extend()
    rows = _distinct(np.concatenate(found)) if found else np.empty((0, 3), np.int64)
    smallest = np.ones(len(rows), bool)  # rows are in order of start, end, period
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Rows of three numbers in order, each once."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new]


def left_over(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period go."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(steps, runs[:, 1], 1)
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """(id_col, n_words, runs, collapsed) for each row: runs in order of start, then period, and the words that are left
    when all of a run but its first period goes, joined by one space."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets, _ in slices(batch.column(1)):
                texts = [buf[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(hi - lo)]
                bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
                words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                rows = find_runs(words, bounds, min_length, min_repeats)
                stays = left_over(len(words), rows)
                ends = np.searchsorted(rows[:, 0], bounds)  # a document's runs start within it
                rows = np.stack((rows[:, 0] - bounds[np.repeat(np.arange(len(texts)), np.diff(ends))], rows[:, 1] - rows[:, 0], rows[:, 2]), 1)
                kept = [b" ".join(t if b == a else [w for w, s in zip(t, stays[i:j].tolist(), strict=True) if s]) for t, a, b, i, j in zip(texts, ends[:-1], ends[1:], bounds[:-1], bounds[1:], strict=True)]
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(run_type)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), runs, pa.array(kept, pa.binary())], ["_id", "n_words", "runs", "collapsed"])

    found = docs.mapInArrow(bounded(run), f"_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.select(F.col("_id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
