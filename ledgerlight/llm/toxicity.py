"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares two words by the subsequences of three characters that they share within a span of ``SPAN``
characters, each weighted by ``DECAY`` to the power of its span: gaps and inserted characters lower a match, but don't end it. Landmarks are
words that occur in toxic texts far more often than in clean ones, and the clean words most like them. A word's
Nystroem features are its similarities to the landmarks times the inverse root of the landmarks' own kernel matrix; a
linear support vector machine (squared hinge, Newton steps) on them tells toxic words, trained on labelled
sentences or texts as bags: of a toxic one the words of the highest score count as toxic, of a clean one none does. A
text's score is a logistic function of its highest word scores.

Before comparison, letters are lower-cased and punctuation inside a word is dropped, and runs of single letters are
joined, so that ``i.d.i.o.t`` and ``i d i o t`` are read as one word.

Fitted on at most ``per_class`` texts of each label (those of the lowest hash), taken whole.

Defined results: a null or empty text has no words and gets the score of its bag (below one half); with labels of one
kind only, or none, every score is 0; very long texts are judged by all their words, very long words in overlapping
windows; rows without a label are not trained on; null ids are kept; repeated rows get equal scores; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded, lowest_hash, pieces, trim

SPAN, DECAY, WIDTH, POWER = 5, 0.6, 24, 4
PER_CLASS = 1000
LANDMARKS, CONTRASTS = 64, 16
FLOOR = 0.45  # similarities below it count as none
ALTERED = 40
SURE = (0.4, 0.8)  # scores from which a single word's own weighs more and more, without others beside it
MEMO = 150_000  # words whose scores a task keeps
_PUNCTUATION = bytes(c for c in string.punctuation.encode() if c not in b"/|")
_BLANKS = bytes(32 if c in b"/|" else c for c in range(256))
_SPACED = re.compile(rb"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_CODES = np.array([0] + [1 + i % 62 for i in range(0x10000 - 1)], np.int32)
_CODES[ord("^")], _CODES[ord("$")] = 61, 62
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODES[ord(_c)] = 1 + _i
for _i in range(128, 0x10000):
    _CODES[_i] = 37 + _i % 24
_TRIPLES = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]  # steps from the first character to the others


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a whole text, as they are compared."""
    data = (text or "").lower().encode("utf-8", "replace").translate(_BLANKS, _PUNCTUATION)
    words = set(data.split())
    if sum(map((1).__eq__, map(len, words))) > 1:
        words.update(m.group().translate(None, b" \t") for m in _SPACED.finditer(data))
    return words


def _windows(word: bytes) -> list[str]:
    text = f"^{word.decode()}$"
    return [text] if len(text) <= WIDTH else [text[i : i + WIDTH] for i in range(0, len(text) - WIDTH // 2, WIDTH // 2)]


def triples(words: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences (0: none) and the weight of each column, for words of at most ``width`` characters."""
    c = np.zeros((len(words), width + SPAN), np.int32)
    c[:, :width] = _CODES[np.minimum(np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width), 0xFFFF)]
    out = np.empty((len(words), len(_TRIPLES), width), np.int32)
    x = c[:, :width] << 12
    for k, (a, b) in enumerate(_TRIPLES):
        z = c[:, b : b + width]
        np.multiply(x | (c[:, a : a + width] << 6) | z, z > 0, out=out[:, k])
    return out.reshape(len(words), -1), np.repeat([DECAY ** (b - 2) for _, b in _TRIPLES], width)


class Landmarks:
    """The kernel of any word with fixed words."""

    def __init__(self, words: list[str]):
        self.words = words  # windows of words, of at most WIDTH characters
        codes, weights = triples(words)
        known = np.unique(codes)
        known = known[known > 0]
        self.row = np.zeros(1 << 18, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(words)), np.float32)
        for j in range(len(words)):
            np.add.at(self.table[:, j], self.row[codes[j]], weights * (codes[j] > 0))
        self.table[0] = 0
        self.table /= np.maximum(np.linalg.norm(self.table, axis=0), 1e-9)
        self.most = np.zeros(1 << 18, np.float32)
        self.most[known] = self.table[1:].max(axis=1)

    def similarities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which words (of at most WIDTH characters) are like any landmark, and their normalised kernel values to the
        power POWER. The others' values are all 0."""
        places, values = [], []
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 12), (12, WIDTH)):  # shorter rows for shorter words
            which = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(which), 8192):
                part = which[k : k + 8192]
                codes, weights = triples([words[i] for i in part], high)
                # a bound that drops no match: a landmark's product with the word is at most the sum of the most that any
                # landmark has at each subsequence, and the word's norm is at least that of its subsequences taken one by one
                norm2 = (codes > 0) @ (weights * weights).astype(np.float32)
                near = self.most[codes] @ weights.astype(np.float32) >= 0.98 * FLOOR * np.sqrt(norm2)
                at = part[near]
                if len(at):
                    v = self._values(codes[near], weights)
                    some = v.any(axis=1)
                    places.append(at[some])
                    values.append(v[some])
        if not places:
            return np.empty(0, np.int64), np.empty((0, len(self.words)), np.float32)
        return np.concatenate(places), np.concatenate(values)

    def _values(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n = len(codes)
        out = np.zeros((n, len(self.words)), np.float32)
        # a word's norm: equal subsequences add up before they are squared
        order = np.argsort(codes, axis=1, kind="stable")
        sorted_codes = np.take_along_axis(codes, order, axis=1)
        w = weights[order] * (sorted_codes > 0)
        total = np.cumsum(w, axis=1)
        last = np.ones(codes.shape, bool)
        last[:, :-1] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
        i, j = np.nonzero(last)
        ends = total[i, j]
        sums = np.diff(ends, prepend=0.0)
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]
        sums[first] = ends[first]
        code, norm2 = sorted_codes[i, j], np.bincount(i, sums * sums, n)
        row = self.row[code]
        hit = row > 0
        # no landmark is nearer than the share of the word that any landmark knows
        near = np.bincount(i[hit], (sums * sums)[hit], n) >= FLOOR**2 * norm2
        use = hit & near[i]
        i, row, sums = i[use], row[use], sums[use].astype(np.float32)
        if len(i):
            begins = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            for lo in range(0, len(begins), 2048):  # rows by the thousand, to bound the gathered table
                some = begins[lo : lo + 2048]
                end = begins[lo + 2048] if lo + 2048 < len(begins) else len(i)
                part = slice(some[0], end)
                out[i[some]] = np.add.reduceat(self.table[row[part]] * sums[part, None], some - some[0], axis=0)
        out /= np.maximum(np.sqrt(norm2), 1e-9)[:, None].astype(np.float32)
        out[out < FLOOR] = 0
        return out**POWER


@dataclass
class ToxicityModel:
    landmarks: Landmarks | None
    direction: np.ndarray | None = None  # the machine's weights, times the inverse root of the landmarks' kernel
    offset: float = -1.0
    bag: np.ndarray | None = None  # logistic weights over bag_features

    def window_scores(self, windows: list[str]) -> np.ndarray:
        scores = np.full(len(windows), self.offset)
        at, values = self.landmarks.similarities(windows)
        scores[at] += values @ self.direction
        return scores

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Of each word that of its highest window."""
        parts = [_windows(w) for w in words]
        scores = self.window_scores([p for ps in parts for p in ps])
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]]) if parts else []
        return np.maximum.reduceat(scores, starts) if len(words) else scores

    def score(self, texts: list[str | None], memo: dict[bytes, float]) -> np.ndarray:
        if self.bag is None:
            return np.zeros(len(texts))
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 256):
            bags = [words_of(t) for t in texts[lo : lo + 256]]
            new = list(set().union(*bags) - memo.keys())
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set().union(*bags))
            for k in range(0, len(new), 50_000):
                some = new[k : k + 50_000]
                memo.update(zip(some, self.word_scores(some).tolist(), strict=True))
            rows = np.stack([bag_features(list(map(memo.__getitem__, b)), self.offset) for b in bags])
            out[lo : lo + 256] = 1 / (1 + np.exp(-np.clip(rows @ self.bag, -40, 40)))
        return out


def bag_features(scores: list[float], offset: float) -> np.ndarray:
    top = sorted(scores, reverse=True)[:3] if len(scores) < 64 else np.sort(np.partition(scores, -3)[-3:])[::-1].tolist()
    top = [min(2.0, max(-2.0, s)) for s in [*top, offset, offset, offset][:3]]
    return np.array([*top, min(top[0], 0.0), *[max(top[0] - at, 0.0) for at in SURE], np.log1p(len(scores)) / 5 * (top[0] > 0), 1.0])


def _inserted(window: str) -> list[str]:
    """The window of a word with a letter put in at each inner place; too short a word has no such forms. What is then
    longer than a window is taken as two, its first and its last ``WIDTH`` characters."""
    first, last = int(window.startswith("^")), len(window) - int(window.endswith("$"))
    forms = [window[:k] + "xqzk"[(k - first) % 4] + window[k:] for k in range(first + 1, last)] if last - first > 3 else []
    return [part for form in forms for part in dict.fromkeys((form[:WIDTH], form[-WIDTH:]))]


def _newton(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge support vector machine with an unpenalised offset as the last column."""
    x = np.column_stack([rows, np.ones(len(rows))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        gap = 1 - labels * (x @ w)
        on = gap > 0
        a = x[on] * weight[on, None]
        step = np.linalg.solve(x[on].T @ a + np.diag(penalty), a.T @ labels[on] - (x[on].T @ a) @ w - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        step = np.linalg.solve((rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + ridge * np.eye(len(w)), rows.T @ (labels - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(texts: list[str | None], toxic: list[int]) -> ToxicityModel:
    """The machine judges windows of words: a word of up to ``WIDTH`` characters is one, a longer one has all of its own."""
    words, y = [words_of(t) for t in texts], np.array(toxic, int)
    nothing = ToxicityModel(None)
    if len(set(toxic)) < 2:
        return nothing
    bags = [{x for w in b for x in _windows(w)} for b in words]
    t, c = Counter(), Counter()
    for b, label in zip(bags, y, strict=True):
        (t if label else c).update(b)
    nt, nc = int(y.sum()), int((1 - y).sum())
    odds = {w: np.log((n + 0.3) / (nt + 1)) - np.log((c[w] + 0.3) / (nc + 1)) for w, n in t.items()}
    weight_of = {w: odds[w] * np.sqrt(t[w]) for w in odds if odds[w] > 1.0}  # a word of one text comes after those of several
    ranked = sorted(weight_of, key=lambda w: (-weight_of[w], w))
    found = ranked[:LANDMARKS]
    if not found:
        return nothing
    clean = sorted(c)
    at, near = Landmarks(found).similarities(clean)
    near = near.max(axis=1) if len(at) else np.empty(0)
    order = sorted(range(len(at)), key=lambda i: (-c[clean[at[i]]] * near[i], clean[at[i]]))
    landmarks = Landmarks([*found, *[clean[at[i]] for i in order[:CONTRASTS] if clean[at[i]] not in set(found)]])

    def rows_of(windows: list[str]) -> np.ndarray:
        out = np.zeros((len(windows), len(landmarks.words)))
        at, values = landmarks.similarities(windows)
        out[at] = values
        return out

    own = rows_of(landmarks.words)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-3
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nystroem map: similarities @ root
    # clean instances: windows of clean texts that are like some landmark; all others are at the offset
    hard = [clean[i] for i in at]
    hard_rows = rows_of(hard) @ root
    hard_count = np.array([c[w] for w in hard], float)
    score = {**dict.fromkeys(t, -9.0), **{w: weight_of[w] for w in ranked[: 4 * LANDMARKS]}}
    model = nothing
    for _ in range(3):
        picked = Counter()
        for b, label in zip(bags, y, strict=True):
            if label:
                picked.update([w for w in sorted(b, key=lambda w: (-score[w], w))[:2] if score[w] > 0])
        if not picked:
            return model
        positive = sorted(picked)
        # those picked most often also with a character inserted, as people disguise them
        altered = [v for w in sorted(picked, key=lambda w: (-picked[w], w))[:ALTERED] for v in _inserted(w) if v not in c]
        rows = np.vstack([rows_of(positive) @ root, rows_of(altered) @ root, hard_rows, np.zeros((1, root.shape[1]))])
        labels = np.array([1.0] * (len(positive) + len(altered)) + [-1.0] * (len(hard) + 1))
        weight = np.concatenate([[picked[w] for w in positive], np.full(len(altered), 1.0 + nt / 200), hard_count * nt / max(nc, 1), [sum(picked.values())]])
        w = _newton(rows, labels, weight, ridge=1.0)
        model = ToxicityModel(landmarks, root @ w[:-1], float(w[-1]))
        names = sorted(t)
        score = dict(zip(names, model.window_scores(names).tolist(), strict=True))
    names = sorted(set().union(*words))
    every = dict(zip(names, model.word_scores(names).tolist(), strict=True))
    rows = np.stack([bag_features([every[w] for w in b], model.offset) for b in words])
    model.bag = _logistic(rows, y)
    return model


# ---------------------------------------------------------------- Spark


def training_rows(df: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(_toxic, _text) of at most ``per_class`` ids of each label, those of the lowest hash, with one text of an id that
    rows repeat; the ids sent out are bounded so."""
    given = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    known = given.join(df.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    some = lowest_hash(known, "_toxic", "_id", per_class)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    return texts.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).select("_toxic", "_text")


def fit_on(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    got = [(r["_toxic"], r["_text"]) for r in training_rows(df, labels, id_col=id_col, text_col=text_col, label_col=label_col, per_class=per_class).collect()]
    got.sort(key=lambda r: (r[0], r[1] or ""))
    model = fit([r[1] for r in got], [r[0] for r in got])
    del got
    trim()
    return model


def score_texts(df: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) for each row."""
    sent, kind = df.sparkSession.sparkContext.broadcast(model), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            score = sent.value.score(piece.column(1).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["_id", "score", "predicted"])

    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(bounded(run), f"_id {kind}, score double, predicted int")
    return out.withColumnRenamed("_id", id_col)


def drop_toxic(df: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    sent, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for piece in (p for batch in batches for p in pieces(batch, place)):
            score = sent.value.score(piece.column(place).to_pylist(), memo)
            yield piece.filter(pa.array(score < threshold))

    return df.mapInArrow(bounded(run), df.schema)
