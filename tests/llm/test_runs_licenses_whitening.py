"""Periodic runs, licence scans and whitening against plain versions of their contracts, on the given small tables and odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerlight.llm import common, licenses, queries, runs, whitening

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_words string, runs string, collapsed string, _id string, w string, places string"


def documents(spark, rows, folder):
    """A documents table with extra columns whose names clash with the operators' own."""
    common.ship(spark)
    spark.createDataFrame([(i, t, "en", *"sxyzuvw") for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- periodic runs


def plain_runs(w, least=12):
    """(start, length, smallest period) of every maximal stretch, by comparing the words with themselves at every distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_op11(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found).encode(), b" ".join(x for k, x in enumerate(w) if k not in gone))]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *digests)


def periodic_texts():
    r = random.Random(3)
    out = [None, "", " \n", "one", "ab " * 4000, "a b " * 6, "a\tb\x0bc\x1c " * 9, "ß é " * 7 + "ß", " ".join("x" if i % 7 else "y" for i in range(200))]
    for _ in range(150):
        k, n = r.choice((1, 2, 3, 5, 200)), r.choice((11, 12, 13, 24, 90, 300))
        w = [f"w{r.randrange(k)}" for _ in range(n)]
        for _ in range(r.randrange(3)):  # runs within, side by side and nested
            a, p = r.randrange(n), r.randrange(1, 9)
            m = r.randrange(n - a + 1)
            w[a : a + m] = [w[a + i % p] for i in range(m)] if a + p <= n else w[a : a + m]
        out.append(" ".join(w))
    return out


def test_runs_of_many_documents_at_once():
    r = random.Random(5)
    for t in range(150):
        docs = [[r.randrange(r.choice((1, 2, 3, 40))) for _ in range(r.choice((0, 1, 7, 30, 70)))] for _ in range(r.randrange(1, 6))]
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        least = 12 if t % 2 else 4
        got = runs.find_runs(np.array([x for d in docs for x in d], np.int64), bounds, least)
        assert [tuple(x) for x in got.tolist()] == [(s + o, s + n + o, q) for d, o in zip(docs, bounds.tolist(), strict=False) for s, n, q in plain_runs(d, least)]


def test_names_and_extensions():
    w = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2], np.int64)
    levels = runs.block_names(w, np.zeros(10, np.int64))
    for k, names in enumerate(levels):
        for i in range(10 - (1 << k) + 1):
            for j in range(i):
                assert (names[i] == names[j]) == (w[i : i + (1 << k)] == w[j : j + (1 << k)]).all()
    x, y = np.array([0, 0, 1, 3]), np.array([2, 6, 7, 9])
    assert runs.extension(levels, x, y).tolist() == [3, 4, 3, 1]
    assert runs.extension(levels, x, y, back=True).tolist() == [0, 0, 1, 3]


def test_candidates_in_parts(monkeypatch):
    w, bounds = np.array([0, 1] * 300 + [2] * 100 + list(range(50)) * 3, np.int64), np.array([0, 500, 850])
    whole = runs.find_runs(w, bounds)
    monkeypatch.setattr(runs, "CANDIDATES", 10)
    assert runs.find_runs(w, bounds).tolist() == whole.tolist()


def test_op11(spark, tmp_path):
    rows = list(enumerate(periodic_texts())) + [(None, "a " * 30), (4, "ab " * 40), (4, "ab " * 40)]
    rows += [(i, "the same words for all of these ids " * 3 + "and an end") for i in range(500, 560)]
    assert result(queries.op11_periodic_runs(spark, documents(spark, rows, tmp_path))) == sorted((plain_op11(*r) for r in rows), key=str)


def test_op11_on_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert result(queries.op11_periodic_runs(spark, SMALL)) == sorted((plain_op11(*r) for r in rows), key=str)


def test_runs_of_a_very_long_text(spark, tmp_path):
    text = " ".join(f"w{i % 50_000}" for i in range(130_000))
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 130_000, 50_000)] and row["collapsed"] == " ".join(text.split()[:50_000])


def test_no_rows(spark, tmp_path):
    folder = documents(spark, [], tmp_path)
    assert queries.op11_periodic_runs(spark, folder).count() == 0 and queries.op12_license_scan(spark, folder).count() == 0


# ---------------------------------------------------------------- licences

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_op12(i, text):
    """The columns that the contract fixes: all but labels, score and expressions."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places = [(k, label) for phrase, label in BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return (i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


LICENSE_TEXTS = [
    None, "", "...", "The MIT License.", "MIT-license; MİT license", "mit license license mit license mit license", "GNU Lesser General Public License", "Apache\n\nLicense,MIT\x00License",
    "summit license", "mit licenses", "apachelicense apache license2", "général public license general public  license", "MIT LICENSE " * 3000, "Ünïcode mit license mit license K mit license",
    "Licensed under CC BY-NC-SA 4.0, and CC BY-NC 4.0", "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: (MIT", "all rights reserved",
]


def test_op12(spark, tmp_path):
    rows = [*enumerate(LICENSE_TEXTS), (None, "MIT License"), (3, "The MIT License."), (3, "The MIT License.")]
    got = queries.op12_license_scan(spark, documents(spark, rows, tmp_path)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((plain_op12(*r) for r in rows), key=str)
    for r in got:
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(r["base_labels"].split(",")) - {""} <= set(labels) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    of = {r["doc_id"]: r for r in got}
    assert of[14]["labels"] == "cc-by-nc,cc-by-nc-sa" and of[15]["labels"] == "apache,gpl,mit" and of[16]["labels"] == "" and of[17]["labels"] == "rights-reserved" and of[6]["labels"] == "gpl,lgpl"


def test_op12_on_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = queries.op12_license_scan(spark, "/root/testdata/sf0.01").drop("labels", "score", "expressions")
    assert result(got) == sorted((plain_op12(*r) for r in rows), key=str)
    assert sum(r[2] for r in result(got)) > 10


@pytest.mark.parametrize(
    ("text", "postfix", "needs"),
    [
        ("MIT", "MIT", "permissive"),
        ("mit or gpl-3.0 and isc", "mit gpl-3.0 isc and or", "permissive"),
        ("(MIT OR GPL-3.0) AND MPL-2.0 -->", "MIT GPL-3.0 or MPL-2.0 and", "weak copyleft"),
        ("GPL-2.0+ WITH GCC-exception-2.0 AND LGPL-2.1 WITH x", "GPL-2.0+ GCC-exception-2.0 with LGPL-2.1 x with and", "weak copyleft"),
        ("GPL-2.0 AND (MIT)", "GPL-2.0 MIT and", "strong copyleft"),
        ("MIT/Apache-2.0 is what it says", "MIT Apache-2.0 or", "permissive"),
        ("LicenseRef-Own OR AGPL-3.0", "LicenseRef-Own AGPL-3.0 or", "strong copyleft"),
        ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "unknown"),
        ("((((MIT))))", "MIT", "permissive"),
        ("MIT AND", None, None),
        ("(MIT", None, None),
        (") MIT", None, None),
        ("OR MIT", None, None),
        ("", None, None),
        ("\nMIT", None, None),
    ],
)
def test_expressions(text, postfix, needs):
    found = licenses.parse(text.encode()).postfix
    assert (" ".join(found) if found else None) == postfix
    if found:
        assert licenses.NEEDS[licenses.evaluate(found)[0]] == needs


def test_expressions_against_plain_evaluation():
    """Random expressions: min and max of the sides, by an independent recursive evaluation while they are made."""
    r = random.Random(2)
    leaves = [("MIT", 0), ("MPL-2.0", 1), ("GPL-3.0-only", 2), ("GPL-2.0 WITH Classpath-exception-2.0", 1), ("LGPL-2.1+ with x", 0)]

    def made(depth):  # text, value, binding
        if not depth or r.random() < 0.2:
            t, v = r.choice(leaves)
            return t, v, 3
        op = r.choice(("or", "AND"))
        bind = 1 if op == "or" else 2
        sides = [made(depth - 1) for _ in range(r.randrange(2, 4))]
        shown = [t if b > bind or (b == bind and r.random() < 0.5) else f"( {t} )" for t, _, b in sides]
        return f" {op} ".join(shown), (min if op == "or" else max)(v for _, v, _ in sides), bind

    for _ in range(300):
        text, value, _ = made(4)
        assert licenses.evaluate(licenses.parse(text.encode()).postfix)[0] == value, text
    deep = b"(" * 50_000 + b"MIT" + b")" * 50_000
    assert licenses.parse(deep).postfix == ("MIT",)


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int, deviation string, n string, _vector string, i string, whitened string"


def vectors(spark, rows, folder):
    common.ship(spark)
    spark.createDataFrame([(i, v, 1, *"abcde") for i, v in rows], VECTORS).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def plain_op13(rows, most=32):
    """{vec_id: (deviation, [whitened])}, shares of the trace: in exact fractions up to the eigenvectors."""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    y = [[n * x[j] - s[j] for j in range(d)] for _, x in kept]
    v = np.array([[float(Fraction(sum(r[a] * r[b] for r in y), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:most]
    w = (np.array(y, float) / n) @ u[:, order] / np.sqrt(e[order])
    return {i: (sum(c * c for c in r), z) for (i, _), r, z in zip(kept, y, w, strict=True)}, e[order] / np.trace(v)


def compare(rows, got):
    want, shares = plain_op13(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
        assert abs(r["explained"] - shares[r["component"] - 1]) <= 1e-9 and r["identity_error"] < 1e-9 and r["n"] == len(want) and r["deviation"] == want[r["vec_id"]][0]
    assert by.keys() == want.keys()
    table = np.array([[r["whitened"] for r in sorted(by[i], key=lambda r: r["component"])] for i in want])
    plain = np.array([want[i][1] for i in want])
    sign = np.sign((table * plain).sum(0))
    assert table.shape == plain.shape and np.abs(table - plain * sign).max() < 1e-7
    off = (table - table.mean(0)).T @ (table - table.mean(0)) / len(table) - np.eye(table.shape[1])
    assert abs(np.abs(off).max() - got[0]["identity_error"]) < 1e-9


def test_op13(spark, tmp_path):
    r = np.random.default_rng(7)
    mixed = r.normal(size=(90, 40)) @ r.normal(size=(40, 40))
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)] + [(100 + i, mixed[0].tolist()) for i in range(30)]
    rows += [(900, None), (901, [None, *mixed[1, 1:].tolist()]), (902, [float("nan"), *mixed[1, 1:].tolist()]), (903, [float("inf"), *mixed[1, 1:].tolist()])]
    compare(rows, queries.op13_whitening(spark, vectors(spark, rows, tmp_path)).collect())


def test_op13_on_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    compare(rows, queries.op13_whitening(spark, SMALL).collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.5])], [(1, [1.0, 2.0])] * 5, [(1, [])]])
def test_op13_without_variance(spark, tmp_path, rows):
    assert queries.op13_whitening(spark, vectors(spark, rows, tmp_path)).collect() == []


def test_whitening_of_odd_rows(spark, tmp_path):
    common.ship(spark)
    rows = [(None, [1.0, 2.0, 9.0]), (1, [1.0, 2.0, 9.0]), (1, [3.0, -1.0, 9.0]), (2, [0.0, 5.0, 9.0]), (3, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert model.n == 4 and model.vectors.shape == (3, 2) and model.identity_error < 1e-9  # one dimension doesn't vary; a shorter vector is dropped
    assert sorted((r["vec_id"] or 0) for r in whitening.whitened(df, model).collect()) == [0, 1, 1, 2]
    with pytest.raises(Exception, match="too large for 64-bit"):
        whitening.fit(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>"))


def test_sliced_products_are_exact(monkeypatch):
    r = np.random.default_rng(1)
    for big in (3, 1 << 19, 1 << 25, 1 << 45, (1 << 62) - 1):
        y = r.integers(-big, big, (300, 5))
        exact = y.astype(object).T @ y.astype(object)
        assert (whitening.exact_gram(y) == exact).all()
    monkeypatch.setattr(whitening, "BLOCK", 7)
    assert (whitening.exact_gram(y) == exact).all()
    monkeypatch.undo()
    for one in ((1 << 62) - 1, (1 << 19) + (1 << 39) + (1 << 59)):  # every product at its bound, a full block and more
        y = np.full((whitening.BLOCK + 5, 2), -one)
        assert (whitening.exact_gram(y) == one * one * len(y)).all()
    assert sum(int(x[0]) << (whitening.LIMB * k) for k, x in enumerate(whitening.limbs(np.array([-(1 << 61) - 12345])))) == -(1 << 61) - 12345
