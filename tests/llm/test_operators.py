"""The corpus operators on small tables: brute force, exact round trips, and odd rows."""

import functools
import hashlib
import itertools
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from ledgerlight.llm import common, decontaminate, langid, line_dedup, media, minhash, packing, sharding, substring, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, score double, n string"


def documents(rows):
    """(doc_id, text) with columns whose names clash with the operators' own."""
    return [(i, t, "en", "s", 0.5, "x") for i, t in rows]


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "ß,", "A"]
    long = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60, 160))) for _ in range(30)]
    rows = list(enumerate(long))
    for i in range(30, 60):  # copies, edited copies, and copies of passages
        w = long[r.randrange(30)].split()
        if i % 3:
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = "new"
        rows.append((i, "\n".join([" ".join(w)] if i % 2 else [" ".join(long[i % 30].split()[:55]), " ".join(w)])))
    return rows + [(60, None), (61, ""), (62, "one two"), (63, "ONE  two"), (60, None), (None, long[0]), (64, "ab " * 3000), (65, "ab " * 3000), (5, long[5])]


@pytest.fixture(scope="module")
def corpus(spark):
    common.ship(spark)
    rows = texts()
    return rows, spark.createDataFrame(documents(rows), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    common.ship(spark)
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_substring(corpus, empty):
    rows, df = corpus
    assert rows_of(substring.deduplicate_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(rows)
    assert substring.deduplicate_substrings(empty).count() == 0


def test_near_duplicates(corpus, empty):
    rows, df = corpus
    assert rows_of(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(rows)
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_fills_and_estimates():
    for n in (1, 3, 40, 5000):
        assert (minhash.sketch(common.stream(n, n)) != np.iinfo(np.uint64).max).all()
    x = common.stream(9, 700)
    same = [float((minhash.sketch(x[:640] ^ np.uint64(s)) == minhash.sketch(x[60:] ^ np.uint64(s))).mean()) for s in range(40)]
    assert abs(np.mean(same) - 580 / 700) < 0.03
    assert (1 - 0.85 ** minhash.banding(0.85)[0]) ** minhash.banding(0.85)[1] < 1e-5


def test_components_of_long_chains(spark):
    common.ship(spark)
    n = 3000
    shuffled = random.Random(6).sample(range(10_000, 10_000 + n), n)
    chains = [list(range(n)), shuffled, [20_000 + (i // 2 if i % 2 else n - i // 2) for i in range(n)]]  # rising, mixed, zigzag
    links = spark.createDataFrame([x for c in chains for x in zip(c[1:], c[:-1], strict=True)], "a long, c long")
    got = {r["doc"]: r["comp"] for r in minhash.components(links).collect()}
    assert got == {i: min(c) for c in chains for i in c}


def test_index_of_sets():
    sets = [np.unique(common.stream(i, 50)[: 10 + i]) for i in (1, 1, 2)] + [np.arange(5, dtype=np.uint64)] * 40 + [np.empty(0, np.uint64)]
    index = minhash.Index(sets)
    for s in [*sets[:4], sets[-1]]:
        assert index.overlaps(s).tolist() == [len(np.intersect1d(s, x)) for x in sets]
    assert minhash.Index([]).overlaps(sets[0]).tolist() == [] and not len(minhash.Index(sets[-1:]).linked(sets[0], 85))


@pytest.mark.parametrize("block", [minhash.BLOCK, 60_000])
def test_large_groups_about_the_threshold(spark, monkeypatch, block):
    """Two families of near copies, one mostly above and one mostly below the threshold, as one block and as many."""
    common.ship(spark)
    monkeypatch.setattr(minhash, "BLOCK", block)
    r, rows = random.Random(3), []
    for k, (low, high) in enumerate(((1, 6), (6, 9))):
        base = [f"w{r.randrange(5000)}" for _ in range(150)]
        for i in range(1500):
            words = list(base)
            for at in r.sample(range(150), r.randint(low, high)):
                words[at] = f"e{r.randrange(10**9)}"
            rows.append((1500 * k + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == _large_wanted(tuple(rows))


@functools.cache
def _large_wanted(rows):
    return brute.near_duplicates(rows)


#: Words over two letters in Thue-Morse order and its complement: equal under any polynomial hash modulo a power of two.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_weak_hashes_confuse(spark):
    common.ship(spark)
    tail = " ".join(f"x{i}" for i in range(60))
    rows = [(0, THUE), (1, MORSE), (2, f"{THUE} {tail}"), (3, f"{MORSE} {tail}"), (4, f"y{THUE}"), (5, f"y{MORSE}"), (6, " ".join(THUE)), (7, " ".join(MORSE))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(rows)
    assert rows_of(substring.deduplicate_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(rows)
    bench = spark.createDataFrame([(9, f"{THUE} {THUE}a {MORSE} {THUE}b")], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"{MORSE} {MORSE}a {THUE} {MORSE}b"), (1, f"{THUE} {THUE}a {MORSE} {THUE}b")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()] == [1]


def test_hashes_of_long_words_and_grams():
    for lane in (0, 1):
        spelled = [b"", b"a", b"x" * 8, b"x" * 9, b"x" * 5000, b"x" * 5001, b"x" * 4999 + b"y", b"y" + b"x" * 4999]
        data = np.frombuffer(b" ".join(spelled[1:]), np.uint8)
        words, firsts = common.word_hashes(data, np.array([0, len(data)]), lane=lane)
        assert len(set(words.tolist())) == len(words) == firsts[1] == len(spelled) - 1
        for w, h in zip(spelled[1:], words, strict=True):
            assert common.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), lane=lane)[0].tolist() == [h]
    words = common.stream(3, 200) % np.uint64(5)
    for k in (1, 2, 3, 5, 12, 50):
        grams = common.gram_hashes(words, k)
        assert len(grams) == 201 - k and all(common.gram_hashes(words[i : i + k], k)[0] == grams[i] for i in range(0, len(grams), 13))
        assert len(set(grams.tolist())) == len({tuple(words[i : i + k].tolist()) for i in range(201 - k)})


def test_sharding(corpus, empty):
    rows, df = corpus
    got = sharding.stratified_shards(df, shards=4, per_bucket=5).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sorted(r["size"] for r in got) == sizes
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    assert sharding.stratified_shards(empty).count() == 0


def test_shards_against_brute_force(spark):
    common.ship(spark)
    r = random.Random(8)
    rows = [(i, r.choice([None, "", f"t{i % 50}", "é" * (i % 9)]), r.choice(["a", "a", "a", "b", "c", None])) for i in range(700)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, _key int, _rank int").repartition(5)
    for per_bucket in (9, 100_000):
        got = {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.stratified_shards(df, shards=7, per_bucket=per_bucket).collect()}
        assert got == brute.stratified_shards(rows, 7)


def test_shards_of_one_repeated_row(spark):
    """A third of all rows with a null id and text, and an id that rows repeat: no bucket holds them all."""
    common.ship(spark)
    rows = [(None, None, "s")] * 400 + [(7, "x", "s")] * 300 + [(i, "y", None) for i in range(500)]
    got = sharding.stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), shards=5, per_bucket=20).collect()
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x)
    assert len(got) == 1200 and all(sorted(x["slot"] for x in v) == list(range(240)) for v in by.values())
    assert all(abs(sum(x["source"] == "s" for x in v) - 140) <= 2 for v in by.values())


def test_shards_match_the_mixture(spark):
    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 900, "hot").when(F.col("id") < 1100, "b").otherwise(F.lit(None)).alias("source"))
    got = sharding.stratified_shards(df, shards=10, per_bucket=40).groupBy("shard", "source").count().collect()
    assert all(abs(r["count"] - {"hot": 90, "b": 20, None: 10}[r["source"]]) <= 2 for r in got)


def test_packing(corpus, empty):
    rows, df = corpus
    got = packing.pack_documents(df, length=256, width=16, per_salt=10, **packing.vocabulary()).collect()
    encode = packing.encoder(packing.vocabulary()["path"])
    want = sorted(np.append(encode(t or ""), 1).astype("<u4").tobytes() for _, t in rows)
    pieces = sorted((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    cut = sorted((len(x) // 4, a, min(256, len(x) // 4 - a), zlib.crc32(x[4 * a : 4 * a + 1024])) for x in want for a in range(0, len(x) // 4, 256))
    assert pieces == cut
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, **packing.vocabulary()).count() == 0


def test_ids_of_both_libraries_agree(spark):
    """Over odd strings and over whole tables."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary()["path"])
    slow, fast = packing.encoder(packing.vocabulary()["path"]), packing.encoder(**packing.vocabulary())
    r = random.Random(5)
    alphabet = "ab Ab  \n\t\r\x0b\x1c\x85\u00a0\u2003éß日本😀'st12.,!<|>-"
    given = ["don't \n\n stop", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\ny", "<|endoftext", "<|endoftext|", " <|endoftext|>  z", "é<|ENDOFTEXT|>"]
    given += ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(300)]
    for name in ("sf0.001", "sf0.01"):
        for folder, column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
            if os.path.exists(f"/root/testdata/{name}"):
                given += [x[0] for x in spark.read.parquet(f"/root/testdata/{name}/{folder}.parquet").select(column).collect() if x[0]]
    for text in given:
        want = plain.encode(text, add_special_tokens=False).ids
        assert fast(text).tolist() == want and (len(text) > 200 or slow(text).tolist() == want), text[:200]
    assert fast("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_plan_covers_all_with_little_padding():
    r = np.random.default_rng(1)
    lengths = np.minimum(2047, r.lognormal(6.3, 0.8, 3000).astype(int) + 1)
    bins, counts = np.unique(-(-lengths // 16), return_counts=True)
    where, n = packing.plan(dict(zip(bins.tolist(), counts.tolist(), strict=True)))
    assert n * 2048 / lengths.sum() < 1.03
    assert {b: int(x) for b, x in where.groupby("bin")["last"].max().items()} == dict(zip(bins.tolist(), counts.tolist(), strict=True))


def test_media(corpus, empty):
    rows, df = corpus
    stored = media.media_columns(df, block=media.BLOCK).cache()
    for r in stored.collect():
        payload, times, points = brute.read_stream(r["media"])
        fits = [t for i, t in rows if i == r["doc_id"] and payload == media.padded((t or "").encode())]
        assert fits and r["n_bytes"] == len((fits[0] or "").encode())
        assert [(x["pts"], x["random_access"]) for x in r["timestamps"]] == list(zip(times, points, strict=True)) and points[0]
    got = media.read_media(stored).collect()
    streams = {(r["doc_id"], hashlib.sha256(r["media"]).hexdigest()): r["media"] for r in stored.collect()}
    assert len(got) == len(rows)
    for r in got:
        stream = streams[r["doc_id"], r["media_sha256"]]
        payload = brute.read_stream(stream)[0]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream))
        assert r["feature"].endswith("discontinuities=0;bad_tables=0;stamps_ok=1")
    assert media.read_media(media.media_columns(empty)).count() == 0
    assert media.read_media(spark_row(df, None), id_col="i", media_col="m", size_col="n", stamps_col="s").first()["payload_bytes"] == 0


def spark_row(df, value):
    return df.sparkSession.createDataFrame([(1, 0, value, None)], "i long, n long, m binary, s array<struct<pts:bigint,offset:bigint,random_access:boolean>>")


def test_stream_reading():
    for n in (0, 1, 169, 170, 182, 183, 11761, 11762, 11763, 60_000):
        data = os.urandom(n)
        s = media.decode_ts(media.encode_ts(data, gop=2))
        assert s.payload == data and not s.discontinuities and not s.bad_tables
        assert s.pts == [k * media.TICKS for k in range(len(s.pts))] and s.random_access == [k % 2 == 0 for k in range(len(s.pts))]
    stream = media.encode_ts(os.urandom(5000))
    assert media.decode_ts(stream[: 188 * 9] + stream[188 * 10 :]).discontinuities == 1  # lost
    twice = media.decode_ts(stream[: 188 * 9] + stream[188 * 8 :])
    assert twice.discontinuities == 1 and twice.payload == media.decode_ts(stream).payload  # repeated
    broken = bytearray(stream)
    broken[20] ^= 1
    assert media.decode_ts(bytes(broken)).bad_tables == 1


def test_urls(spark):
    common.ship(spark)
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = ["http://a.com", "http://A.Example.COM/en/x", "https://www.example.com/en/1?q#z", "http://example.com/enx", "x.net/es/", "http://x.net/es/?a", "http://xnet/es/", None, "", "a://b://c.com/", "http://notexample.com/en/", "http://u@example.com/en/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, url_filter.rule_frame(spark, rules)).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = rest[:cut].lower(), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(k), len(k.split("/")[0]), k, a) for a, k in rules for h, p in [k.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want = max(fits, default=(0, 0, None, "allow"))
        assert tuple(got[i]) == (i, host, path, want[2], want[3]), u
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_frame(spark, rules)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substring(key, -1) = '7'")
    cascade = url_filter.build_cascade(listed, universe, bits_per_key=4)  # few bits: several levels
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("key")) != (F.substring("key", -1, 1) == "7")).count() == 0


def test_cascade_over_a_large_universe(spark, monkeypatch):
    """Level 1 holds what level 0 lets through of the corpus: it must fit, however large the corpus is."""
    monkeypatch.setattr(url_filter, "MAX_BITS", 2048)
    universe = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key in ('k7', 'k77', 'k777')")
    cascade = url_filter.build_cascade(listed, universe)
    assert all(x.bits <= 2048 for x in cascade.levels)
    assert universe.where(cascade.contains(F.col("key")) != F.col("key").isin("k7", "k77", "k777")).count() == 0


@pytest.mark.parametrize("bits", [url_filter.MAX_BITS, 512])
def test_long_lists_are_split(spark, monkeypatch, bits):
    """The same verdicts where one filter holds the list and where it takes many parts."""
    common.ship(spark)
    monkeypatch.setattr(url_filter, "MAX_BITS", bits)
    rules = [("block" if i % 3 else "allow", f"s{i}.com/") for i in range(90)] + [("block", f"s{i}.com/a{i}") for i in range(0, 90, 2)]
    df = spark.createDataFrame([(i, f"http://x.s{i % 120}.com/a{i % 70}/b") for i in range(240)] + [(None, None)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, url_filter.rule_frame(spark, rules)).collect()}
    for i in range(240):
        host, path = f"x.s{i % 120}.com", f"/a{i % 70}/b"
        fits = [(len(k), k, a) for a, k in rules for h, p in [k.split("/", 1)] if host.endswith("." + h) and path.startswith("/" + p)]
        assert got[i] == max(fits, default=(0, None, "allow"))[1:], i
    assert got[None] == (None, "allow") and len(got) == 241


def test_lines(spark, empty):
    common.ship(spark)
    rows = [(i, f"banner\n line {i}\n\nbanner", "a") for i in range(10)] + [(i, "half\nx" if i % 2 else "x y", "b") for i in range(10, 20)] + [(20, None, "a"), (21, "", None), (22, "banner", "c"), (None, "banner\nz", "a"), (3, rows_text(3), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    for name in ("line", "pages", "_drop", "_h", "_line_host", "_line_key", "_found_host", "n_removed", "N_LINES"):
        df = df.withColumn(name, F.lit("kept"))
    found = line_dedup.boilerplate(df, host=F.col("host"), text_col="text", ratio=0.5, min_pages=3)
    for sent in ("10MB", "-1"):  # the lists sent to all tasks, or joined by host
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
        try:
            got = line_dedup.drop_lines(df, found, host=F.col("host"), text_col="text", counted=True).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(got) == len(rows) and all(r[c] == "kept" for r in got for c in df.columns[3:])
        by = {r["doc_id"]: r for r in got}
        assert by[3]["text"] == " line 3\n" and by[3]["n_removed_"] == 2 and by[3]["n_lines_"] == 4 and by[None]["text"] == "z"
        assert by[11]["text"] == "half\nx" and by[20]["text"] is None and by[21]["text"] == "" and by[22]["text"] == "banner"
    none = empty.limit(0)
    assert line_dedup.drop_lines(none, line_dedup.boilerplate(none, host=F.col("source"), text_col="text"), host=F.col("source"), text_col="text").count() == 0


def rows_text(i):
    return f"banner\n line {i}\n\nbanner"


def test_lines_against_brute_force(spark):
    common.ship(spark)
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "b", "c", None]), "\n".join(r.choice(["menu", " menu ", "", f"l{r.randrange(60)}", f"x{i}"]) for _ in range(r.randrange(7)))) for i in range(400)]
    rows += [(400, "a", None), (401, None, ""), (402, "d", "menu\nonly page"), (403, "a", "long line " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string").repartition(3)
    found = line_dedup.boilerplate(df, host=F.col("host"), text_col="text")
    got = {x["doc_id"]: x["text"] for x in line_dedup.drop_lines(df, found, host=F.col("host"), text_col="text").collect()}
    assert got == brute.boilerplate_dropped(rows)


def test_lines_of_small_hosts(spark):
    common.ship(spark)
    rows = [(i, f"menu\nline {i}", "four") for i in range(4)] + [(i, f"{'foot' if i < 13 else 'else'}\nline {i}", "twenty") for i in range(10, 30)] + [(40, "menu\nalone", "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    found = line_dedup.boilerplate(df, host=F.col("host"), text_col="text")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(df, found, host=F.col("host"), text_col="text").collect()}
    assert got == {i: f"line {i}" if i < 40 else "menu\nalone" for i, _, _ in rows}


def test_pieces_cover_a_batch():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["ab", None, "", "x" * 50, "cd", "e" * 9, "f"]}, schema=pa.schema([("i", pa.int64()), ("t", pa.string())]))
    for limit in (1, 10, 1000):
        got = list(common.pieces(batch.slice(1), 1, limit))
        assert [i for p in got for i in p.column(0).to_pylist()] == list(range(1, 7))
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= limit for p in got)
    assert list(common.pieces(batch.slice(0, 0), 1)) == []


def test_page_lines():
    assert line_dedup.page_lines("<html><script>x</script><p>a &amp; <b>b</b><br>c</p><!-- no --><div> d </div>") == ["a & b", "c", "d"]
    assert line_dedup.page_lines("a<SCRIPT src='x'> <b> </Script >b<style>c</style>d<!-- e <script> -->f<style>g") == ["a b d fg"]
    began = time.process_time()
    for odd in ("<script>", "<!--", "<", "<style", "<!-- --", "</script", "<p", "<!doctype", "<script></script", "<!--<script><style>"):
        line_dedup.page_lines(odd * (1_000_000 // len(odd)))
    assert time.process_time() - began < 20


def test_leaks(spark, empty):
    common.ship(spark)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(98, "a b"), (99, None)]
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(60)]
    edited = items[3][1].split()
    for k in (4, 11, 19, 26):
        edited[k] = word()
    del edited[15]
    rows += [(100, rows[0][1] + " " + items[2][1].upper() + ". " + rows[1][1]), (101, " ".join(edited)), (102, " ".join(items[5][1].split()[:6])), (103, None), (104, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(documents(rows), DOCS)
    for block in (100, 7):
        got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.find_leaks(df, bench, block=block).collect()}
        assert set(got) == {(100, 2), (101, 3)} and got[100, 2]["score"] == 1.0 and (got[100, 2]["start"], got[100, 2]["words"]) == (200, 30)
        assert {x["doc_id"] for x in decontaminate.drop_leaked(df, bench, block=block).collect()} == {i for i, _ in rows} - {100, 101}
    assert decontaminate.find_leaks(empty, bench).count() == decontaminate.drop_leaked(empty, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.drop_leaked(df, bench.limit(0)).count() == len(rows)


def test_leaks_against_brute_force(spark):
    common.ship(spark)
    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 40)))) for i in range(12)]
    rows = []
    for i in range(120):
        passage = r.choice(items)[1].split()
        for _ in range(r.randrange(0, len(passage))):
            at = r.randrange(len(passage))
            passage[at : at + r.choice([0, 1, 1])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
        rows.append((i, " ".join([r.choice(vocabulary) for _ in range(r.randrange(60))] + passage + [r.choice(vocabulary) for _ in range(60)])))
    rows += [(None, items[0][1]), (120, items[1][1] + " " + items[1][1]), (121, "w " * 40_000 + items[2][1])]
    bench = spark.createDataFrame([*items, items[0], (50, ""), (51, None)], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(documents([*rows, rows[0]]), DOCS).repartition(3), bench).collect()
    want = brute.leaks(rows[:-1], items)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in found}
    assert (121, 2) in got and {k: v for k, v in got.items() if k[0] != 121} == want
    assert sum(x["doc_id"] == 0 for x in found) == 2 * sum(k[0] == 0 for k in want)
    best = {x["doc_id"]: (x["start"], x["words"]) for x in found if x["doc_id"] == 120 and x["item_id"] == 1}
    assert best == {120: (0, len(items[1][1].split()))}  # the first of equals


def test_edited_copies_beside_an_exact_one(spark):
    """The exact copy's n-grams are rarer than those that all copies hold; the edited ones are leaks all the same."""
    common.ship(spark)
    items = [(0, " ".join(f"q{i}" for i in range(60))), (1, " ".join(f"z{i}" for i in range(40)))]
    edited = " ".join(f"new{i}" if i % 6 == 2 else f"q{i}" for i in range(60))
    rows = [(0, items[0][1])] + [(i, f"start {i} {edited} end") for i in range(1, 30)] + [(30, "q0 q1 q2 and q7 q8 q9 no more"), (31, "nothing")]
    df = spark.createDataFrame(documents(rows), DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == {(i, 0) for i in range(30)} and got[0, 0] == 1 and got[7, 0] == 0.75
    assert {x["doc_id"] for x in decontaminate.drop_leaked(df, bench).collect()} == {30, 31}


def zipf_texts(r, n, size, words=30_000):
    """Texts of words with ordinary frequencies."""
    return [" ".join(f"w{i}" for i in np.minimum(r.zipf(1.2, size), words)) for _ in range(n)]


def edited_at(r, words, rate):
    """Each word is replaced, left out or preceded by a new one with that rate."""
    out = []
    for w in words:
        kind = r.integers(3) if r.random() < rate else -1
        out += [f"n{r.integers(10_000)}"] * (kind in (0, 2)) + [w] * (kind in (-1, 2))
    return out


def test_recall_by_rate_of_edits(spark):
    """Of the passages whose whole alignment reaches the threshold, nine in ten are found at any rate of edits; each item
    also stands unchanged in a document, and one item is in many copies with the same edits."""
    common.ship(spark)
    r = np.random.default_rng(5)
    items = list(enumerate(zipf_texts(r, 30, 50)))
    rows, planted = [(k, f"{a} {t} {b}") for (k, t), a, b in zip(items, zipf_texts(r, 30, 80), zipf_texts(r, 30, 80), strict=True)], {}
    for rate in (0.05, 0.1, 0.2, 0.3, 0.4):
        for k, t in items:
            passage = edited_at(r, t.split(), rate)
            score = brute.local_score([w.lower() for w in t.split()], passage) / (2 * len(t.split()))
            if score >= 0.5:
                planted[len(rows), k] = rate
            rows.append((len(rows), f"{zipf_texts(r, 1, 60)[0]} {' '.join(passage)} {zipf_texts(r, 1, 60)[0]}"))
    same = " ".join(edited_at(r, items[3][1].split(), 0.25))
    for x in zipf_texts(r, 300, 40):
        planted[len(rows), 3] = 0.25 if brute.local_score(items[3][1].split(), same.split()) >= 50 else None
        rows.append((len(rows), f"{x} {same}"))
    planted = {k: v for k, v in planted.items() if v is not None}
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(spark.createDataFrame(documents(rows), DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(k, k) for k in range(30)} <= found and len(planted) > 100
    for rate in sorted(set(planted.values())):
        want = {k for k, v in planted.items() if v == rate}
        assert len(want & found) >= 0.9 * len(want), (rate, len(want & found), len(want))


def test_work_follows_what_is_shared():
    """Twenty times the items take less than twice the time for documents of words with ordinary frequencies, once the
    n-grams are counted."""
    r = np.random.default_rng(6)
    texts = pa.array(zipf_texts(r, 300, 600))

    def seconds(n):
        items = decontaminate.Items.of(list(enumerate(zipf_texts(np.random.default_rng(7), n, 120))), 3)
        held = np.zeros(len(items.grams), np.int64)
        for _, _, grams in decontaminate._scan(texts, 3):
            held[items.rows_of(np.unique(grams))[0]] += 1
        rare = items.rare(held * 100, 30_000)
        began = time.perf_counter()
        for _, words, grams in decontaminate._scan(texts, 3):
            decontaminate._matches(rare, words, grams, 0.5)
        return time.perf_counter() - began

    few, many = min(seconds(1000) for _ in range(3)), min(seconds(20_000) for _ in range(2))
    assert many < 2 * few + 0.05, (few, many)


def test_reach_is_never_below_the_score():
    r = np.random.default_rng(4)
    for _ in range(60):
        a = [r.integers(0, 9, r.integers(1, 12)) for _ in range(4)]
        b = r.integers(0, 9, r.integers(1, 6))
        most = decontaminate.reach(np.isin(np.concatenate(a), b), np.array([len(x) for x in a]))
        for x, m in zip(a, most, strict=True):
            runs = [sum(2 if w in b else -1 for w in x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1)]
            assert m == max(runs) >= decontaminate.align(x, b)[0]


def test_alignment_against_a_table():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 12)), r.integers(0, 5, r.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


TOXIC = ["you are an idiot", "what an idiot he is", "such a moron", "the moron again", "idiot and moron", "shut up you moron", "that idiot left", "a total moron"]
CLEAN = ["you are a friend", "what a day it is", "such a house", "the river again", "bread and water", "sit down you all", "that train left", "a total surprise", "ideas matter", "more on this later"]


def test_toxicity(spark, empty):
    common.ship(spark)
    model = toxicity.fit(TOXIC * 3 + CLEAN * 3, [1] * len(TOXIC) * 3 + [0] * len(CLEAN) * 3)
    given = ["an i.d.i.o.t wrote it", "an i d i o t wrote it", "IDIOT!", "a mo-ron", "the garden is green", "", None, "x" * 500]
    df = spark.createDataFrame(documents(enumerate(given)), DOCS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_texts(df, model).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(df, model).collect()) == [4, 5, 6, 7]
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_texts(df, toxicity.fit_on(df, labels)).agg(F.max("score")).first()[0] == 0  # one label only
    assert toxicity.score_texts(empty, model).count() == toxicity.drop_toxic(empty, model).count() == 0
    odd = spark.createDataFrame(documents([(None, "idiot"), (1, "an idiot"), (1, "an idiot"), (2, "the river " * 60_000 + "idiot"), (None, None)]), DOCS)
    got = [(r["doc_id"], r["predicted"], r["score"]) for r in toxicity.score_texts(odd, model).collect()]
    assert sorted(str(x[:2]) for x in got) == ["(1, 1)", "(1, 1)", "(2, 1)", "(None, 0)", "(None, 1)"] and len({x[2] for x in got if x[0] == 1}) == 1


def test_toxic_part_of_a_long_word(spark):
    """Words longer than a window count by all of their windows, in fitting too."""
    toxic = [f"qzwx{'ab' * 12}{x}idiot{x}" for x in "klmnop"] * 4
    model = toxicity.fit(toxic + CLEAN * 3, [1] * len(toxic) + [0] * len(CLEAN) * 3)
    assert any("idiot" in w for w in model.landmarks.words)


def test_no_match_is_pruned():
    """The first bound of the kernel never leaves out a window that is like a landmark."""
    r = random.Random(3)
    marks = toxicity.Landmarks(["^idiot$", "^aaaaaa$", "^moron$", "^abab$"])
    windows = sorted({f"^{w}$" for w in ("idiot", "aaaa", "aaaaaaaa", "abababab", "i.diot", "mooron", *("".join(r.choice("aidomnrt") for _ in range(r.randrange(1, 12))) for _ in range(3000)))})
    at, values = marks.similarities(windows)
    full = np.zeros((len(windows), 4))
    full[at] = values
    for k in range(0, len(windows), 500):
        codes, weights = toxicity.triples(windows[k : k + 500])
        assert np.allclose(full[k : k + 500], marks._values(codes, weights), atol=1e-5)


def test_kernel_against_brute_force():
    """Every subsequence of three characters within the span, one by one."""
    from collections import Counter

    def features(word):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                out[word[i], word[j], word[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        x, y = features(a), features(b)
        size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        k = sum(v * y[s] for s, v in x.items()) / size
        return k**toxicity.POWER if k >= toxicity.FLOOR else 0.0

    r = random.Random(11)
    words = ["idiot", "idxiot", "i1diot", "iidiott", "idot", "tiodi", "moron", "banana", "mo", "nana", "a" * 20]
    words += ["".join(r.choice("abdimnort") for _ in range(r.randrange(1, 21))) for _ in range(300)]
    for base in ("idiot", "moron", "banana", "ab" * 10):  # and words with some letters put in or left out
        words += ["".join(r.choice(("", c, c, c, c + r.choice("xyz1"))) for c in base)[:22] for _ in range(60)]
    windows, marks = sorted({f"^{w}$" for w in words}), ["^idiot$", "^moron$", "^banana$", "^aaaaaa$", f"^{'ab' * 10}$"]
    at, values = toxicity.Landmarks(marks).similarities(windows)
    got = np.zeros((len(windows), len(marks)))
    got[at] = values
    want = np.array([[kernel(w, m) for m in marks] for w in windows])
    sure = np.abs(want ** (1 / toxicity.POWER) - toxicity.FLOOR) > 1e-4
    assert (want > 0).sum() > 20 and np.allclose(got[sure], want[sure], atol=1e-4)
    assert want[windows.index("^idxiot$"), 0] > 0 and want[windows.index("^i1diot$"), 0] > 0  # inserted characters


def test_words_of_one_toxic_text_are_learnt_however_many_there_are():
    """An insult that one labelled text alone holds is known, with few toxic texts and with many, and tells by itself."""
    for n in (6, 12, 30):
        toxic = [f"{CLEAN[x % len(CLEAN)]} moron" for x in range(n)] + ["such a blockhead"]
        clean = CLEAN * 3 + ["you are such a total star"] * 5
        model = toxicity.fit(toxic + clean, [1] * len(toxic) + [0] * len(clean))
        assert (model.score(["the blockhead", "the star", "a moron"], {}) >= 0.5).tolist() == [True, False, True], n


def test_altered_words_are_not_cut():
    window = f"^{'abcdefghij' * 2}kl$"  # a full window
    assert len(window) == toxicity.WIDTH
    forms = toxicity._inserted(window)
    assert all(len(f) <= toxicity.WIDTH for f in forms) and any(f.startswith("^") for f in forms) and sum(f.endswith("kl$") for f in forms) >= 19
    assert all(f.startswith("^") and f.endswith("$") for f in toxicity._inserted("^idiot$"))


def test_samples_are_the_lowest_hashes(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("kind"))
    got = common.lowest_hash(rows, "kind", "id", 60)
    want = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 1)).orderBy("h").collect()
    assert {(r["kind"], r["id"]) for r in got.collect()} == {(k, i) for k in "ab" for i in [r["id"] for r in want if r["kind"] == k][:60]}


def test_language(spark, empty):
    common.ship(spark)
    rows = [(i, w + " " + " ".join(x), lang, "s", 0.1, "n") for lang, words in (("en", "the of and to in that it was for on".split()), ("de", "der die und das nicht ein ist zu mit auf".split())) for i, w in enumerate(words) for x in [words[i:] + words[:i]]]
    rows += [(90, None, "en", "s", 0.1, "n"), (91, "123 !", "en", "s", 0.1, "n"), (92, "und das ist nicht", None, "s", 0.1, "n")]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(df, langid.fit_on(df, centroids=2)).collect()}
    assert got[90, "und"] == got[91, "und"] == 0 and (92, "de") in got and all(0 <= s <= 1 for s in got.values())
    assert {k[1] for k in got} == {"en", "de", "und"}
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit_on(empty)).collect()} == {"und"}
    assert langid.identify(empty, langid.fit_on(df)).count() == 0
    odd = spark.createDataFrame(documents([(None, "und das ist nicht"), (1, "the of and"), (1, "the of and"), (2, "der die das nicht " * 60_000), (None, None)]), DOCS)
    got = [(r["doc_id"], r["lang_pred"], r["cosine"], r["rejected"]) for r in langid.identify(odd, langid.fit_on(df, centroids=2)).collect()]
    assert sorted(str(x[:2]) for x in got) == ["(1, 'en')", "(1, 'en')", "(2, 'de')", "(None, 'de')", "(None, 'und')"] and len({x[2] for x in got if x[0] == 1}) == 1
    far = spark.createDataFrame(documents([(0, "zzqx qqzz xqzq wkwk"), (1, "the of and to in that it was for on")]), DOCS)
    assert {r["doc_id"]: r["rejected"] for r in langid.identify(far, langid.fit_on(df, centroids=2)).collect()} == {0: True, 1: False}


def test_language_samples_take_ids_not_rows(spark):
    """Rows without an id, or a hundred of one, take no places from the others."""
    common.ship(spark)
    good = [(i, f"text {i}", "en", "s", 0.1, "n") for i in range(60)]
    crowd = [(None, "none", "en", "s", 0.1, "n")] * 500 + [(i, f"text {i}", "en", "s", 0.1, "n") for i in range(5) for _ in range(100)]
    got = langid.training_rows(spark.createDataFrame(good + crowd, DOCS), id_col="doc_id", text_col="text", lang_col="lang", per_language=40).collect()
    assert len({r["_id"] for r in got}) == len(got) == 40 and all(r["_text"] == f"text {r['_id']}" for r in got)
    assert {r["_id"] for r in got} == {r["_id"] for r in langid.training_rows(spark.createDataFrame(good, DOCS), id_col="doc_id", text_col="text", lang_col="lang", per_language=40).collect()}


def test_languages_against_brute_force():
    """The nearest of all centroids by cosine, one text at a time."""
    r = random.Random(1)
    given = [("en", " ".join(r.choice("the of and to in that it was for on".split()) for _ in range(9))) for _ in range(40)] + [("de", " ".join(r.choice("der die und das nicht ein ist zu mit auf".split()) for _ in range(9))) for _ in range(40)]
    model = langid.fit(np.stack([langid.counts(t) for _, t in given]), [x for x, _ in given])
    lang, _, cosine, rejected = model.predict([t for _, t in given])
    for (_, t), found, c, far in zip(given, lang, cosine, rejected, strict=True):
        v = np.log1p(langid.counts(t)) * model.idf
        each = [float(v @ m) / float(np.linalg.norm(v)) for m in model.centroids]
        best = int(np.argmax(each))
        assert found == model.languages[model.owner[best]] and abs(c - each[best]) < 1e-5 and far == (each[best] < model.reach[best] - 1e-7 or far and each[best] < model.reach[best] + 1e-5)
