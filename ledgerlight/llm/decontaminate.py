"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are compared without case (A-Z) and punctuation. Which n-grams of an item are rare is counted over all documents, but
for those that hold ``MUCH`` of the item or more: likely copies don't make the n-grams that they keep look common, so an
edited copy is found beside an exact one, however many there are. Seeds are the n-grams that no more than one in ``RARE``
documents holds otherwise, and the ``LEAST`` rarest of an item in any case: short items keep all of theirs.

A document that holds a seed of an item is aligned with the item around the seed: local alignment over words, with
substitutions and gaps, so edited and paraphrased copies score by what they keep. A passage whose score reaches
``threshold`` of the item's own is a leak. Before an alignment the words of the item that the document, then the passage,
holds at all are looked up; they bound the score from above (``reach``), and only what can't reach the threshold is left
out. So what a document costs follows what it shares with items, not how many there are.

The items are the fixed side: their n-grams go to all tasks, which scan the documents twice, without a shuffle of texts.
More than ``BLOCK`` items or ``BLOCK_BYTES`` of their text are taken in blocks of about that much, one after the other, so
what is sent at once, and what counts of n-grams come back, is bounded.

Defined results: null and empty texts match nothing, nor do items of fewer words than an n-gram; very long texts are
scanned whole and aligned around seeds only; repeated rows each match; a null id is kept as null; several matches of an
item in a document give its best one, the first of equals; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import LOWER, U64, bounded, forget, gram_hashes, slices, word_hashes, written

GRAM, THRESHOLD, BLOCK, BLOCK_BYTES = 3, 0.5, 20_000, 16 << 20
RARE, LEAST = 10_000, 16
MUCH = (3, 8)  # so many of an item's n-grams, and one in so many
MATCH, MISMATCH, GAP = 2, -1, 1
_MAP = LOWER.copy()
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _MAP[_c] = 32
_BITS = 22


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best local score and the span (start, end) of the text, the first of equals."""
    if not len(item) or not len(text):
        return 0, 0, 0

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        slope = np.arange(len(b) + 1) * GAP
        row, top, end = np.zeros(len(b) + 1, np.int64), 0, 0
        for w in a:
            step = np.zeros(len(b) + 1, np.int64)
            step[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] - GAP), 0)
            row = np.maximum.accumulate(step + slope) - slope  # gaps within the row: a running maximum
            at = int(row.argmax())
            if row[at] > top or (row[at] == top and at < end):
                top, end = int(row[at]), at
        return top, end

    score, end = best(item, text)
    back, length = best(item[::-1], text[:end][::-1])
    return score, end - length if back == score else 0, end


def reach(held: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For items of ``sizes`` words, of which ``held`` tells (one item after the other) whether the text has them: the most
    that an alignment can score. It takes a run of the item's words; one that the text lacks costs at least a mismatch
    or a gap, the others give at most a match: the best run's sum."""
    first = np.cumsum(sizes + 1) - sizes - 1
    steps = np.empty(len(held) + len(sizes), np.int64)
    inner = np.ones(len(steps), bool)
    inner[first] = False
    steps[inner] = np.where(held, MATCH, -min(-MISMATCH, GAP))
    steps[first] = -(MATCH * int(sizes.max(initial=0)) + 1)  # each item begins below all of the item before
    total = np.cumsum(steps)
    return np.maximum.reduceat(total - np.minimum.accumulate(total), first)


class Items:
    """Test items with n-grams of theirs, in order of their hashes."""

    def __init__(self, ids: list, words: list[np.ndarray], grams: np.ndarray, owner: np.ndarray, place: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.ids, self.words = ids, words
        self.grams, self.owner, self.place = grams[order], owner[order], place[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.grams >> U64(64 - _BITS)).astype(np.int64)] = True

    @classmethod
    def of(cls, rows: list[tuple], gram: int) -> Items:
        words, grams = [], []
        for _, w, g in _scan(pa.array([t for _, t in rows], pa.string()), gram):
            words.append(w)
            grams.append(g)
        sizes = np.array([len(g) for g in grams], np.int64)
        starts = np.cumsum(sizes) - sizes
        return cls([i for i, _ in rows], words, np.concatenate([*grams, np.empty(0, U64)]), np.repeat(np.arange(len(rows)), sizes), np.arange(sizes.sum()) - np.repeat(starts, sizes))

    def rare(self, held: np.ndarray, documents: int) -> Items:
        """With seeds alone, by how many documents hold each n-gram (of ``grams``) though not much of its item."""
        order = np.lexsort((self.place, held, self.owner))
        rank = np.empty(len(order), np.int64)
        sizes = np.bincount(self.owner, minlength=len(self.ids))
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = (held * RARE <= documents) | (rank < LEAST)
        return Items(self.ids, self.words, self.grams[keep], self.owner[keep], self.place[keep])

    def rows_of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``self.grams`` that are among the grams, and for each the place of its (first) one there."""
        at, row = self.hits(grams)
        n = np.searchsorted(self.grams, self.grams[row], "right") - row  # an n-gram may be several items'
        return np.repeat(row - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(at, n)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the grams are looked for, and the first row of each in ``self.grams``."""
        at = np.flatnonzero(self.bits[(grams >> U64(64 - _BITS)).astype(np.int64)])
        row = np.searchsorted(self.grams, grams[at])
        real = (row < len(self.grams)) & (self.grams[np.minimum(row, max(0, len(self.grams) - 1))] == grams[at]) if len(self.grams) else np.zeros(len(at), bool)
        return at[real], row[real]


def _matches(items: Items, words: np.ndarray, grams: np.ndarray, threshold: float) -> list[tuple]:
    """(item, score, start, end) of one text from its seeds."""
    rows, at = items.rows_of(grams)
    if not len(rows):
        return []
    owner, some = items.owner[rows], np.unique(items.owner[rows])
    sizes = np.array([len(items.words[k]) for k in some], np.int64)
    can = reach(np.isin(np.concatenate([items.words[k] for k in some]), words), sizes) >= threshold * MATCH * sizes
    use = np.isin(owner, some[can])
    spans: dict[int, list[list[int]]] = {}
    for p, k, back in zip(at[use].tolist(), owner[use].tolist(), items.place[rows[use]].tolist(), strict=True):
        size = len(items.words[k])
        slack = size // 2 + 4
        lo, hi = max(0, p - back - slack), min(len(words), p - back + size + slack)
        mine = spans.setdefault(k, [])
        if mine and lo <= mine[-1][1]:
            mine[-1][0], mine[-1][1] = min(mine[-1][0], lo), max(mine[-1][1], hi)
        else:
            mine.append([lo, hi])
    out = []
    for k, parts in spans.items():
        n, best = len(items.words[k]), (0.0, 0, 0)
        for lo, hi in parts:
            if reach(np.isin(items.words[k], words[lo:hi]), np.array([n]))[0] < threshold * MATCH * n:
                continue
            score, a, b = align(items.words[k], words[lo:hi])
            if score / (MATCH * n) > best[0]:
                best = (score / (MATCH * n), lo + a, lo + b)
        if best[0] >= threshold:
            out.append((k, *best))
    return out


def _scan(batch_texts: pa.Array, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, words, n-grams) of each text."""
    for lo, hi, buf, offsets, _ in slices(batch_texts):
        words, firsts = word_hashes(_MAP[buf], offsets)
        grams = gram_hashes(words, gram)
        for i in range(lo, hi):
            a, b = firsts[i - lo], firsts[i - lo + 1]
            yield i, words[a:b], grams[a : max(a, b - gram + 1)]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> list[DataFrame]:
    """The items (i, t) in parts of bounded number and size, by their hash."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    count, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    n = max(1, -(-count // block), -(-(size or 0) // BLOCK_BYTES))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def _collected(items: DataFrame) -> list[tuple]:
    return sorted(map(tuple, items.collect()))


def _counted(docs: DataFrame, items: Items, gram: int) -> Items:
    """The items with their rare n-grams alone, from a pass over all texts (the only column)."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = sent.value, 0
        much = np.maximum(MUCH[0], np.bincount(known.owner, minlength=len(known.ids)) / MUCH[1])
        held = np.zeros(len(known.grams), np.int64)
        for batch in batches:
            for _, _, grams in _scan(batch.column(0), gram):
                n += 1
                rows, _ = known.rows_of(np.unique(grams[known.bits[(grams >> U64(64 - _BITS)).astype(np.int64)]]))
                owner = known.owner[rows]
                held[rows[np.bincount(owner, minlength=len(known.ids))[owner] < much[owner]]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n))], ["row", "n"])  # row -1: documents

    found = docs.mapInArrow(bounded(run), "row long, n long").groupBy("row").agg(F.sum("n").alias("n")).toArrow()  # no more rows than a block has n-grams
    sent.destroy()
    rows, n = found["row"].to_numpy(), found["n"].to_numpy()
    held = np.zeros(len(items.grams), np.int64)
    held[rows[rows >= 0]] = n[rows >= 0]
    return items.rare(held, int(n[rows < 0].sum()))


def find_leaks(
    df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(id_col, item_col, score, start, words) for each leak: the passage's first word and its number of words."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    parts, blocks = [], list(_blocks(benchmark, item_col, item_text_col, block))
    for items in blocks:
        sent = df.sparkSession.sparkContext.broadcast(_counted(docs.select("_text"), Items.of(_collected(items), gram), gram))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                rows, found = [], []
                for i, words, grams in _scan(batch.column(1), gram):
                    more = _matches(known, words, grams, threshold)
                    found += more
                    rows += [i] * len(more)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([known.ids[f[0]] for f in found]).cast(item_type),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([f[3] - f[2] for f in found], pa.int64()),
                    ],
                    ["_id", "_item", "score", "start", "words"],
                )

        part = docs.mapInArrow(bounded(run), f"_id {kinds[0]}, _item {kinds[1]}, score double, start long, words long")
        if len(blocks) > 1:  # one block's items at a time in the tasks' memory
            part = written(part, "leaks")
            sent.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_col)


def drop_leaked(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` that hold no leak, with all their columns."""
    place, texts = df.columns.index(text_col), df.select(F.col(text_col).alias("_text"))
    left, blocks = df, list(_blocks(benchmark, item_col, item_text_col, block))
    for k, items in enumerate(blocks):
        sent = df.sparkSession.sparkContext.broadcast(_counted(texts, Items.of(_collected(items), gram), gram))
        kept = left.mapInArrow(bounded(_unleaked(sent, place, gram, threshold)), df.schema)
        if k < len(blocks) - 1:  # one block's items at a time in the tasks' memory
            kept = written(kept, "unleaked")
            sent.destroy()
            forget(*[left] * (k > 0))
        left = kept
    return left


def _unleaked(sent, place: int, gram: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            keep = [not _matches(known, words, grams, threshold) for _, words, grams in _scan(batch.column(place), gram)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
