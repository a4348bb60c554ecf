"""Substring deduplication by seed and extend: repeats of at least ``window`` words that start in an earlier document.

Seeds: the words of a document are fingerprinted in grams of ``seed`` words, and winnowing keeps, for every window of
``window`` words, the least fingerprint in it. Two equal windows keep equal seeds, so documents are joined on them: a
window can repeat only if its seed is found in two documents.

Extension: around the seeds that are shared, all windows of ``window`` words are compared by 128-bit fingerprints over
all their words, to the left and to the right as far as the seed is theirs. A window that a document with a smaller id
has too is a repeat; runs of repeats make up the maximal repeats, whose words go.

Documents with equal word sequences are one class first: all of a copy's words go (if it has a window at all), and only
the class's smallest id takes part in the joins, so thousands of copies cost what one does. The joins hash their key
anew, so Spark can split the rows of a seed or window that a third of all documents hold; the other side has one row for
each key.

Defined results: a null text has no words; a text shorter than the window keeps all; a repeat within one document, or
between rows that share an id, is kept; a null id is smaller than none and removes nothing, and nothing of it is removed; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import U64, bounded, gram_hashes, slices, span_hashes, word_spans, written

WINDOW, SEED = 50, 12


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Of every run of ``width`` values, by doubling."""
    have = 1
    out = x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def seeds(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The seed of each window of words; windows that cross a text's end are for the caller to leave out."""
    return sliding_min(gram_hashes(words, seed), window - seed + 1) if len(words) >= window else np.empty(0, U64)


def _whole(words: np.ndarray, others: np.ndarray) -> list[int]:
    """128 bits of a word sequence, from two independent hashes of each word."""
    return np.frombuffer(hashlib.blake2b(words.tobytes() + others.tobytes(), digest_size=16).digest(), "<i8").tolist()


def _scan(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(_id, n, t1, t2, seeds) of each document: words, fingerprints of all of them, and the distinct seeds."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets, _ in slices(batch.column(1)):
                starts, ends, firsts = word_spans(buf, offsets)
                words, others = (span_hashes(buf, starts, ends, lane) for lane in (0, 1))
                least = seeds(words, window, seed)
                spans = list(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True))
                found = [np.unique(least[a : b - window + 1]).view(np.int64) if b - a >= window else np.empty(0, np.int64) for a, b in spans]
                t1, t2 = zip(*(_whole(words[a:b], others[a:b]) for a, b in spans), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([b - a for a, b in spans], pa.int64()), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["_id", "n", "t1", "t2", "seeds"]
                )

    return docs.mapInArrow(bounded(run), f"_id {kind}, n long, t1 long, t2 long, seeds array<long>")


def _windows(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """(_id, w1, w2): the distinct windows of a document (_id, _text, _seeds) whose seed is among its shared ones."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets, _ in slices(batch.column(1)):
                starts, ends, firsts = word_spans(buf, offsets)
                if len(starts) < window:
                    continue
                words = span_hashes(buf, starts, ends)
                least, w1, w2 = seeds(words, window, seed), gram_hashes(words, window), gram_hashes(span_hashes(buf, starts, ends, 1), window)
                which, one, two = [], [], []
                for i in range(lo, hi):
                    a, b = firsts[i - lo], firsts[i - lo + 1] - window + 1
                    shared = batch.column(2)[i].values
                    if b > a and shared is not None and len(shared):
                        at = a + np.flatnonzero(np.isin(least[a:b], shared.to_numpy().view(np.uint64)))
                        at = at[np.unique(w1[at], return_index=True)[1]]
                        which.append(np.full(len(at), i))
                        one.append(w1[at])
                        two.append(w2[at])
                if which:
                    ids = batch.column(0).take(pa.array(np.concatenate(which)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64))], ["_id", "w1", "w2"])

    return rows.mapInArrow(bounded(run), f"_id {kind}, w1 long, w2 long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(_id, _all, _repeats) from (_id, _text): fingerprints of the whole texts that are copies of an earlier document's, and
    of the windows that an earlier document has."""
    found = written(_scan(docs, window, seed), "seeds")
    long = found.where(F.col("_id").isNotNull() & (F.col("n") >= window))
    classes = long.groupBy("t1", "t2", "n").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high")
    again = F.xxhash64("t1", "t2", "n").alias("h")
    copies = long.select("_id", "t1", "t2", "n", again).join(classes.select("t1", "t2", "n", again, "low"), ["h", "t1", "t2", "n"]).where("_id > low").select("_id", "t1").distinct()
    copies = written(copies, "copies")
    held = long.join(copies, ["_id", "t1"], "left_anti").select("_id", F.explode("seeds").alias("s"))
    shared = held.groupBy("s").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("s", F.xxhash64("s").alias("h"))
    seeded = held.select("_id", "s", F.xxhash64("s").alias("h")).join(shared, ["h", "s"]).groupBy("_id").agg(F.collect_list("s").alias("_seeds"))
    windows = written(_windows(docs.join(seeded, "_id").select("_id", "_text", "_seeds"), window, seed), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("w1", "w2", "low", F.xxhash64("w1", "w2").alias("h"))
    later = windows.select("_id", "w1", "w2", F.xxhash64("w1", "w2").alias("h")).join(first, ["h", "w1", "w2"]).where("_id > low")
    repeats = later.select("_id", F.col("w1").alias("w"), F.lit(None).cast("long").alias("t")).unionByName(copies.select("_id", F.lit(None).cast("long").alias("w"), F.col("t1").alias("t")))
    return repeats.groupBy("_id").agg(F.collect_list("t").alias("_all"), F.collect_list("w").alias("_repeats"))  # no more than a document has windows


def deduplicate_substrings(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, removed) for each row; ``removed`` lists the maximal removed spans
    (first word, words). With ``keep_text`` also kept_text, the words that are left."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    rows = docs.join(repeated_windows(docs, window, seed), "_id", "left").select("_id", "_text", "_all", "_repeats")
    span = pa.struct([("start", pa.int64()), ("words", pa.int64())])
    schema = f"_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:bigint,words:bigint>>" + ", kept_text string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, spans, kept = [], [], [], [], []
            for lo, hi, buf, offsets, _ in slices(batch.column(1)):
                for i in range(lo, hi):
                    data = buf[offsets[i - lo] : offsets[i - lo + 1]]
                    words = data.tobytes().split()
                    lost = np.zeros(len(words), bool)
                    whole, repeats = batch.column(2)[i].values, batch.column(3)[i].values
                    if (whole is not None and len(whole)) or (repeats is not None and len(repeats)):
                        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
                        hashes = span_hashes(data, starts, ends)
                        if len(hashes) >= window and len(whole) and _whole(hashes, span_hashes(data, starts, ends, 1))[0] in whole.to_pylist():
                            lost[:] = True
                        elif len(hashes) >= window:
                            hit = np.isin(gram_hashes(hashes, window).view(np.int64), repeats.to_numpy())
                            steps = np.zeros(len(words) + 1, np.int64)
                            at = np.flatnonzero(hit)
                            steps[at] += 1
                            np.subtract.at(steps, at + window, 1)
                            lost = np.cumsum(steps[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], lost, [False])).astype(np.int8)))
                    text = b" ".join([w for w, x in zip(words, lost.tolist(), strict=True) if not x] if len(edges) else words)
                    n.append(len(words))
                    gone.append(int(lost.sum()))
                    digest.append(hashlib.sha256(text).hexdigest())
                    spans.append([{"start": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    if keep_text:
                        kept.append(text.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.string())] * keep_text], ["_id", "n_words", "n_removed", "kept_sha256", "removed", *["kept_text"] * keep_text])

    return rows.mapInArrow(bounded(run), schema).withColumnRenamed("_id", id_col)
