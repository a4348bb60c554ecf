"""Language identification by nearest clustered centroids.

Texts are TF-IDF vectors of hashed byte n-grams (2 and 3 bytes of the lower-cased text, letters only), normalised to
length one. Each language has several centroids, found by spherical k-means over its training vectors; a text gets the
language of the centroid of the highest cosine, and is rejected if that cosine is farther than almost all training texts of the
cluster are. Fitted on at most ``per_language`` texts of each language and ``SAMPLE`` in all (those of the lowest hash), taken
whole; an id that rows repeat is one text, and rows without an id are not learnt from.

Defined results: a null text or one without letters is ``und`` with score 0; very short texts are judged by what they
have; very long ones are counted whole in bounded memory; a language with fewer texts than centroids has as many
centroids as texts; with no training rows everything is ``und``; null ids are kept; repeated rows get equal predictions; of equal cosines the first centroid wins; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded, lowest_hash, pieces

DIMS = 1 << 14
PER_LANGUAGE = 400
SAMPLE = 8000
CENTROIDS = 4
UNDETERMINED = "und"
_CLASS = np.full(256, 32, np.uint8)  # other ASCII bytes count as blanks; bytes of other letters stay
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_PART = 1 << 20


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text."""
    data = _CLASS[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    data = np.concatenate(([32], data, [32])).astype(np.uint32)
    out = np.zeros(DIMS)
    for lo in range(0, len(data), _PART):  # parts overlap by two bytes
        a = data[lo : lo + _PART + 2]
        three = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        two = ((a[:-1] << np.uint32(8)) | a[1:])[: _PART if lo + _PART + 2 <= len(data) else None]
        for codes, salt in ((three, 0x9E3779B1), (two, 0x85EBCA77)):
            out += np.bincount((codes * np.uint32(salt)) >> np.uint32(18), minlength=DIMS)
    return out


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroid, DIMS)
    owner: np.ndarray  # index of the language
    reach: np.ndarray  # the lowest cosine accepted by each centroid

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.log1p(rows) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cosines to the nearest centroid, and which are rejected."""
        n = len(texts)
        lang, score, cosine, rejected = [UNDETERMINED] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        judged = [i for i, t in enumerate(texts) if self.languages and has_letters(t)]
        for lo in range(0, len(judged), 64):
            some = judged[lo : lo + 64]
            cos = self.vectors(np.stack([counts(texts[i]) for i in some])).astype(np.float32) @ self.centroids.T
            best = cos.argmax(axis=1)
            each = np.stack([cos[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
            likely = np.exp(30.0 * (each - each.max(axis=1, keepdims=True)))
            likely /= likely.sum(axis=1, keepdims=True)
            for j, i in enumerate(some):
                k = int(self.owner[best[j]])
                lang[i], score[i], cosine[i] = self.languages[k], float(likely[j, k]), float(cos[j, best[j]])
                rejected[i] = cos[j, best[j]] < self.reach[best[j]]
        return lang, np.clip(score, 0, 1), cosine, rejected


def fit(rows: np.ndarray, langs: list[str], centroids: int = CENTROIDS, rejected_share: float = 0.002) -> LanguageModel:
    """From n-gram counts (one row a text) and languages."""
    languages = sorted(set(langs))
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 0.05 if len(rows) else np.ones(DIMS)
    model = LanguageModel(languages, idf, np.empty((0, DIMS), np.float32), np.empty(0, np.int64), np.empty(0))
    found, owner, reach = [], [], []
    for k, language in enumerate(languages):
        v = model.vectors(rows[[i for i, x in enumerate(langs) if x == language]])
        c = v[[0]]
        while len(c) < min(centroids, len(v)):  # start far apart: next is the text least like those chosen
            c = np.vstack([c, v[(v @ c.T).max(axis=1).argmin()]])
        for _ in range(12):
            near = (v @ c.T).argmax(axis=1)
            c = np.stack([v[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        cos = v @ c.T
        near = cos.argmax(axis=1)
        for j in range(len(c)):
            mine = cos[near == j, j]
            reach.append(float(np.quantile(mine, rejected_share)) - 0.05 if len(mine) else 0.0)
        found.append(c)
        owner += [k] * len(c)
    if found:
        model.centroids, model.owner, model.reach = np.vstack(found).astype(np.float32), np.array(owner), np.array(reach)
    return model


def training_rows(df: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(_id, _lang, _text) of at most ``per_language`` distinct ids of each language, those of the lowest hash, and of ``SAMPLE``
    ids in all; rows without an id are not learnt from."""
    known = df.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where("_id is not null and _lang is not null")
    ids = known.select("_id", "_lang").distinct()  # places are given to ids, so rows that repeat one take no more than one
    languages = ids.select("_lang").distinct().count()
    most = max(1, min(per_language, SAMPLE // max(1, languages)))
    some = lowest_hash(ids, "_lang", "_id", most).select("_id").distinct()
    # at most SAMPLE ids, or one for each language; one text of an id that rows repeat
    return known.join(F.broadcast(some), "_id", "left_semi").groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))


def fit_on(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, places, values = [], [], []
            for i, t in enumerate(t for piece in pieces(batch, 2) for t in piece.column(2).to_pylist()):
                if has_letters(t):
                    c = counts(t)
                    at = np.flatnonzero(c)
                    keep.append(i)
                    places.append(at.astype(np.uint16).tobytes())
                    values.append(c[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["lang", "places", "counts"])

    sample = training_rows(df, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language)
    got = sample.mapInArrow(bounded(vectors), "lang string, places binary, counts binary").collect()  # bounded by SAMPLE
    got.sort(key=lambda r: (r["lang"], bytes(r["places"]), bytes(r["counts"])))
    rows = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        rows[i, np.frombuffer(r["places"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    return fit(rows, [r["lang"] for r in got], centroids)


def identify(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, cosine, rejected) for each row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # DIMS floats for each centroid
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            lang, score, cosine, rejected = sent.value.predict(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)], ["_id", "lang_pred", "score", "cosine", "rejected"])

    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(bounded(run), f"_id {kind}, lang_pred string, score double, cosine double, rejected boolean")
    return out.withColumnRenamed("_id", id_col)
