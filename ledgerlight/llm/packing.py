"""Packing documents into sequences by cutting-stock column generation.

A document's ids (and a closing id) are cut into full sequences and one remainder. Remainders are a cutting-stock
problem: their length histogram, in bins of ``BIN`` tokens, is covered by patterns that fit one sequence. The linear
program over patterns is solved by column generation: a revised simplex on the bins, whose duals price new patterns by
an unbounded-knapsack dynamic program, until no pattern has a reduced cost below zero. Patterns are rounded down, what is left over
is packed best-fit by falling length, and pieces are assigned by their rank within their bin.

At scale: the plan works on the histogram, which has ``length / BIN`` bins however many documents there are. Ranks are
dealt out in salted groups with carried counts, so that one very common length is no single task. Texts are tokenised in
one scan, without a shuffle; after it only rows of a few numbers move.

Defined results: a null or empty text is the closing id alone; a very long text gives more full sequences; rows with
equal ids (or null ids) are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded, written

LENGTH, BIN, END_ID = 2048, 16, 1
_encoders: dict = {}


def encoder(path: str, ranks: str | None = None):
    """A function from a text to its ids, as an array of unsigned 32-bit numbers. ``path`` is a vocabulary in JSON, read by
    ``tokenizers``. With ``ranks``, the same vocabulary as ranks, another library gives the same ids three times as fast;
    tests hold it to the first one's ids over whole tables. Special tokens that a text spells out get their own ids."""
    if (path, ranks) not in _encoders:
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
            fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
            _encoders[path, ranks] = lambda text: np.array(fast.encode(text, allowed_special="all"), "<u4")
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _encoders[path, ranks] = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
    return _encoders[path, ranks]


def vocabulary() -> dict[str, str]:
    """The 50k byte-level vocabulary, and its ranks, as parameters of ``pack_documents``."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


# ---------------------------------------------------------------- the plan


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The pattern of the highest value: how many of each bin, in room units. An unbounded knapsack."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r], last[r] = best[r - 1], -1
        fit = sizes <= r
        if fit.any():
            gain = np.where(fit, best[np.maximum(r - sizes, 0)] + values, -1.0)
            i = int(gain.argmax())
            if gain[i] > best[r] + 1e-12:
                best[r], last[r] = gain[i], i
    pattern, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            pattern[last[r]] += 1
            r -= int(sizes[last[r]])
    return pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 3000, gap: float = 1e-3, smoothing: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, fractionally, in a cover of the demand within ``gap`` of the optimum.
    Duals are smoothed towards those of the best lower bound, which ends the method's long tail."""
    m = len(sizes)
    basis = np.diag(np.maximum(room // sizes, 1)).astype(float)  # columns are patterns: each bin by itself to begin with
    inverse = np.diag(1 / np.diag(basis))
    x, bound, centre = inverse @ demand, 0.0, None

    def priced(dual: np.ndarray) -> np.ndarray:
        """The best pattern; the program's value at these duals over its worth is a lower bound."""
        nonlocal bound, centre
        dual = np.maximum(dual, 0)
        pattern = price(dual, sizes, room)
        worth = max(float(dual @ pattern), 1.0)
        if dual @ demand / worth > bound:
            bound, centre = dual @ demand / worth, dual / worth
        return pattern

    for k in range(rounds):
        dual = inverse.sum(axis=0)  # every pattern costs one sequence
        pattern = priced(dual if centre is None else smoothing * centre + (1 - smoothing) * dual)
        if dual @ pattern <= 1 + 1e-9:
            pattern = priced(dual)
        if x.sum() - bound <= gap * x.sum() or dual @ pattern <= 1 + 1e-9:
            break
        step = inverse @ pattern
        up = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / step[up]
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        if k % 100 == 99:  # against rounding errors: a Newton step (LAPACK's threads hang in a process that has forked a JVM)
            inverse = 2 * inverse - inverse @ (basis @ inverse)
            x = inverse @ demand
    return basis.T.round().astype(np.int64), np.maximum(x, 0)


def plan(histogram: dict[int, int], length: int = LENGTH, width: int = BIN) -> tuple[pd.DataFrame, int]:
    """Where the pieces of each bin go, by rank: rows (bin, first, last, sequence, each, slot), and how many sequences.
    histogram: pieces by bin; bin b holds lengths (b-1)*width+1 to b*width."""
    room = length // width
    bins = np.array(sorted(b for b, n in histogram.items() if n), np.int64)
    if not len(bins):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("bin", "first", "last", "sequence", "each", "slot")}), 0
    demand = np.array([histogram[int(b)] for b in bins], np.int64)
    patterns, used = column_generation(bins, demand.astype(float), room)
    times = np.floor(used + 1e-9).astype(np.int64)
    left = demand.copy()
    runs: list[tuple[np.ndarray, int]] = []
    for p in np.argsort(-times, kind="stable"):
        fits = patterns[p] > 0
        n = min(int(times[p]), int((left[fits] // patterns[p][fits]).min()) if fits.any() else 0)
        if n > 0:
            runs.append((patterns[p], n))
            left -= patterns[p] * n
    open_: list[list] = []  # [room left, pattern]: what rounding left over, at most a few pieces a pattern
    for i in np.argsort(-bins):
        for _ in range(int(left[i])):
            best = min((o for o in open_ if o[0] >= bins[i]), key=lambda o: o[0], default=None)
            if best is None:
                best = [room, np.zeros(len(bins), np.int64)]
                open_.append(best)
            best[0] -= int(bins[i])
            best[1][i] += 1
    runs += [(o[1], 1) for o in open_]
    rows, at, rank = [], 0, np.zeros(len(bins), np.int64)
    for pattern, n in runs:
        slot = 0
        for i in np.flatnonzero(pattern):
            each = int(pattern[i])
            rows.append((int(bins[i]), int(rank[i]), int(rank[i] + each * n), at, each, slot))
            rank[i] += each * n
            slot += each
        at += n
    return pd.DataFrame(rows, columns=["bin", "first", "last", "sequence", "each", "slot"]).sort_values(["bin", "first"], ignore_index=True), at


# ---------------------------------------------------------------- Spark


def token_pieces(df: DataFrame, path: str, ranks: str | None = None, *, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(_id, start, length, ids_crc32, doc_tokens, ids): full sequences and the remainder of each document, in one scan."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                ids = np.append(encode(batch.column(1)[i].as_py() or ""), np.uint32(END_ID)).astype("<u4")
                n = len(ids)
                rows += [(i, at, min(length, n - at), zlib.crc32(ids[at : at + length].tobytes()), n) for at in range(0, n, length)]
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *[pa.array(c) for c in cols[1:]]], names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(bounded(run), schema)


def pack_documents(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, width: int = BIN, path: str, ranks: str | None = None, per_salt: int = 20_000
) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    pieces = written(token_pieces(df, path, ranks, id_col=id_col, text_col=text_col, length=length), "pieces")
    room = length // width
    # full sequences are bin room + 1: they are ranked like the others and take a sequence each
    pieces = pieces.withColumn("_bin", F.when(F.col("length") == length, room + 1).otherwise(F.ceil(F.col("length") / width)).cast("int"))
    counts = {r["_bin"]: r["n"] for r in pieces.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most room + 1 rows
    full = counts.pop(room + 1, 0)
    where, sequences = plan(counts, length, width)
    salts = max(1, -(-max([full, *counts.values()], default=1) // per_salt))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_id", "start", "ids_crc32", "doc_tokens"), F.lit(salts)).cast("int"))
    by_salt = pieces.groupBy("_bin", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = by_salt.select("_bin", "_salt", F.coalesce(F.sum("_n").over(Window.partitionBy("_bin").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_bin", "_salt").orderBy("_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("_r", F.row_number().over(inner) - 1).join(before, ["_bin", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_r")).drop("_salt", "_before", "_r")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, _slot long"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # (bin, first) pairs as one rising key; ranks stay below 2**48
        key = where["bin"].to_numpy(np.int64) << 48 | where["first"].to_numpy(np.int64)
        first, seq, each, slot = (where[c].to_numpy(np.int64) for c in ("first", "sequence", "each", "slot"))
        for f in frames:
            bins, rank = f["_bin"].to_numpy(np.int64), f["_rank"].to_numpy(np.int64)
            whole = bins == room + 1
            if len(key):
                at = np.clip(np.searchsorted(key, bins << 48 | rank, "right") - 1, 0, len(key) - 1)
                inside = rank - first[at]
                sequence, place_ = np.where(whole, sequences + rank, seq[at] + inside // each[at]), np.where(whole, 0, slot[at] + inside % each[at])
            else:
                sequence, place_ = sequences + rank, np.zeros_like(rank)
            yield f[["_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=sequence, _slot=place_)

    placed = ranked.select("_bin", "_rank", "_id", "start", "length", "ids_crc32", "doc_tokens").mapInPandas(place, schema)
    run = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a sequence holds at most `length` pieces
    return placed.select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(run), F.lit(0)).cast("long").alias("offset")
    )
