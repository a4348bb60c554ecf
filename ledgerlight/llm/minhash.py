"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketches: every element of a document's shingle set is thrown into one of t bins, round after round, with the round
number in the high part of the value it leaves; from round t on, round t + i throws every element into bin i. So every bin fills, its value is the
minimum over the first round that reaches it, and the estimate of the Jaccard similarity concentrates as with independent
minima, at O(n + t log t) work. Bands of consecutive bins make bucket keys.

Links: documents of equal sets are one class, and only the class's smallest id goes on. Each bucket has a centre, its
smallest member; the members of all buckets of a centre are its star. Every member is compared with its centre, on full
sets. Where a star's members are then still of several components, they are compared with each other: members that are
in another component than most against all. So every pair that shares a bucket and could join two components is
compared, once for a star, and no pairs are listed: a star's members move once, and are compared inside a task through
an index of their shingles, of which those that no other member has bound the similarity from above.

A star of more than ``BLOCK`` bytes of text is cut into blocks. Before that, its members are compared with about
``PIVOTS`` members drawn by hash, ``PASSES`` times over, which joins most of them to the star's main component; of
the rest, each block meets each block of all members. So a star's rows grow with its size, and faster only where what is
outside its main component is more than a block by itself. No member is ever left out.

Components: every component is hooked on its smallest neighbour, and hooks are followed to their roots by doubling, round
after round until no link joins two components; in tables, nothing is collected.

Bands: with r bins each and b bands, a pair of similarity s meets with probability 1 - (1 - s^r)^b; ``banding`` takes
the longest bins for which a pair at the threshold is missed by less than ``MISS``.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat an id are one document (the union of their links); rows with a null id
have no links and are kept; ties go to the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import U64, bounded, forget, gram_hashes, mix, slices, stream, word_hashes, written

BINS, MISS = 128, 2e-6
MEMBERS = 256  # members compared with a centre in one group
BLOCK = 4 << 20  # bytes of text of a star that one task compares with each other
PIVOTS, PASSES = 16, 2
SENT = 500_000  # ids sent to all tasks at most


def banding(threshold: float, bins: int = BINS, miss: float = MISS) -> tuple[int, int]:
    """(bins of a band, bands)."""
    for r in range(16, 0, -1):
        b = bins // r
        if (1 - threshold**r) ** b < miss:
            return r, b
    return 1, bins


def shingle_sets(words: np.ndarray, firsts: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of a slice."""
    grams, out = gram_hashes(words, k), []
    for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        else:
            out.append(gram_hashes(words[lo:hi], int(hi - lo))[:1] if hi > lo else np.empty(0, U64))
    return out


_SEEDS = stream(7, 4 * BINS + 4)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set. In bin j: the round that filled it and the least value of that round."""
    out = np.full(bins, np.iinfo(np.uint64).max, U64)
    empty = np.ones(bins, bool)
    low = U64((1 << 48) - 1)
    for i in range(bins):  # filling all bins takes about (bins log bins) / n rounds
        v = mix(elements ^ _SEEDS[i])
        place = (v >> U64(48)).astype(np.int64) % bins
        use = empty[place]
        if use.any():
            np.minimum.at(out, place[use], (v[use] & low) | (U64(i) << U64(48)))
            empty[place[use]] = False
            if not empty.any():
                return out
    for j in np.flatnonzero(empty):  # round bins + j looks at bin j alone: no bin stays empty
        out[j] = (mix(elements ^ _SEEDS[bins + j]) & low).min() | (U64(bins + j) << U64(48))
    return out


def band_keys(values: np.ndarray, r: int, b: int) -> np.ndarray:
    v = values[: r * b].reshape(b, r)
    with np.errstate(over="ignore"):
        key = stream(11, b)
        for i in range(r):
            key = mix(key * U64(0x9E3779B97F4A7C15) + v[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, *, k: int, r: int, b: int) -> DataFrame:
    """(_id, n, d1, d2, bands) from (_id, _text): the set's size, a 128-bit digest of it, and its bucket keys."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets, _ in slices(batch.column(1)):
                sets = shingle_sets(*word_hashes(buf, offsets, lower=True), k)
                n = [len(s) for s in sets]
                d1 = [int(s.sum(dtype=U64).astype(np.int64)) for s in sets]
                d2 = [int(mix(s ^ _SEEDS[-1]).sum(dtype=U64).astype(np.int64)) for s in sets]
                bands = [band_keys(sketch(s, r * b), r, b) if len(s) else np.empty(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["_id", "n", "d1", "d2", "bands"]
                )

    return docs.mapInArrow(bounded(run), f"_id {kind}, n long, d1 long, d2 long, bands array<long>")


# ---------------------------------------------------------------- verification


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Index:
    """Which sets hold an element."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate([*sets, np.empty(0, U64)])
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, self.first, self.held = np.unique(values[order], return_index=True, return_counts=True)

    def overlaps(self, elements: np.ndarray) -> np.ndarray:
        """The size of each set's intersection with the given elements."""
        if not len(self.values):
            return np.zeros(len(self.sizes), np.int64)
        row = np.minimum(np.searchsorted(self.values, elements), len(self.values) - 1)
        row = row[self.values[row] == elements]
        n = self.held[row]
        at = np.repeat(self.first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def linked(self, elements: np.ndarray, percent: int) -> np.ndarray:
        both = self.overlaps(elements)
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(elements) - both)))


class Group:
    """The documents of one comparison: kept ones, and those that are compared with them as they come. Tells a link only
    if it joins two components that no earlier link of the group has joined."""

    FEW = 8

    def __init__(self, percent: int):
        self.percent, self.comps, self.sets, self.index, self.root, self.links = percent, [], [], None, {}, []

    def top(self, c):
        while self.root.get(c, c) != c:
            c = self.root[c]
        return c

    def join(self, one, two) -> None:
        a, c = self.top(one), self.top(two)
        if a != c:
            self.root[max(a, c)] = min(a, c)
            self.links.append((one, two))

    def keep(self, comp, elements: np.ndarray) -> None:
        self.comps.append(comp)
        self.sets.append(elements)

    def meet(self, comp, elements: np.ndarray) -> None:
        if len(self.sets) <= self.FEW:
            for c, s in zip(self.comps, self.sets, strict=True):
                if c != comp and similar(elements, s, self.percent):
                    self.join(comp, c)
            return
        if self.index is None:
            self.index = Index(self.sets)
        for i in self.index.linked(elements, self.percent).tolist():
            self.join(comp, self.comps[i])

    def meet_each_other(self) -> None:
        """All kept documents with each other; those of the most common component only with the rest."""
        most = Counter(self.comps).most_common(1)[0][0]
        self.index = Index(self.sets)
        single = self.index.values[self.index.held == 1]
        for comp, elements in zip(self.comps, self.sets, strict=True):
            if comp == most or not len(elements):
                continue
            if len(single):  # what no other document holds is in no intersection
                at = np.minimum(np.searchsorted(single, elements), len(single) - 1)
                own = int((single[at] == elements).sum())
                if 100 * (len(elements) - own) < self.percent * len(elements):
                    continue
            for i in self.index.linked(elements, self.percent).tolist():
                self.join(comp, self.comps[i])


KEPT, COMING, BOTH = 0, 1, 2


def _links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, c), links between components, from (g1, g2, g3, role, comp, _text): in each group, the rows of role KEPT with
    those of role COMING, or all rows of role BOTH with each other. A group is streamed from a sorted partition; only the
    sets of its kept rows are held."""
    kind = rows.schema["comp"].dataType.simpleString()
    rows = rows.select("g1", "g2", "g3", "role", "comp", "_text").repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "role", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        id_type = to_arrow_type(rows_type)
        key, group, pending = None, None, False
        for batch in batches:
            g1, g2, g3, role, comp = (batch.column(i).to_pylist() for i in range(5))
            found = []
            for lo, hi, buf, offsets, _ in slices(batch.column(5)):
                sets = shingle_sets(*word_hashes(buf, offsets, lower=True), k)
                for i in range(lo, hi):
                    if key != (g1[i], g2[i], g3[i]):
                        if group is not None:
                            if pending:
                                group.meet_each_other()
                            found += group.links
                        key, group, pending = (g1[i], g2[i], g3[i]), Group(percent), role[i] == BOTH
                    if role[i] == COMING:
                        group.meet(comp[i], sets[i - lo])
                    else:
                        group.keep(comp[i], sets[i - lo])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], id_type), pa.array([x[1] for x in found], id_type)], ["a", "c"])
        if group is not None:
            if pending:
                group.meet_each_other()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in group.links], id_type), pa.array([x[1] for x in group.links], id_type)], ["a", "c"])

    rows_type = rows.schema["comp"].dataType
    return rows.mapInArrow(bounded(run), f"a {kind}, c {kind}")


def _star_rows(pairs: DataFrame, centres: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for ``_links``: the members ``pairs`` (c, a, comp) of each star with its ``centres`` (c, p, comp). Members are
    dealt out in groups of about MEMBERS; the centres' texts go to each of their star's groups."""
    sizes = pairs.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("long").alias("g"))
    coming = pairs.join(sizes, "c").select(F.col("c").alias("g1"), F.pmod(F.xxhash64("a", F.lit(3)), "g").alias("g2"), F.lit(0).alias("g3"), F.lit(COMING).alias("role"), "comp", F.col("a").alias("_id"))
    kept = centres.join(sizes, "c").select(F.col("c").alias("g1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("g2"), F.lit(0).alias("g3"), F.lit(KEPT).alias("role"), "comp", F.col("p").alias("_id"))
    return coming.unionByName(kept).join(texts.select("_id", "_text"), "_id")


def _open_stars(pairs: DataFrame, texts: DataFrame, comps: DataFrame) -> DataFrame:
    """(c, a, comp, main, n, parts): the members of stars whose members are of several components. ``main``: whether of the
    star's most common one; ``n``: members; ``parts``: blocks that the star's texts take."""
    size = texts.groupBy("_id").agg(F.sum("bytes").alias("bytes"))
    at = pairs.join(size, F.col("a") == F.col("_id")).drop("_id").join(comps.select(F.col("doc").alias("a"), "comp"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    at = written(at.select("c", "a", "comp", "bytes"), "members")
    each = at.groupBy("c", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("bytes"))
    stars = each.groupBy("c").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("n"), F.sum("bytes").alias("bytes"), F.max_by("comp", F.struct("k", "comp")).alias("most")).where("comps > 1")
    stars = stars.select("c", "n", "most", F.greatest(F.lit(1), F.ceil(F.col("bytes") / BLOCK)).cast("long").alias("parts"))
    out = written(at.join(stars, "c").select("c", "a", "comp", (F.col("comp") == F.col("most")).alias("main"), "n", "parts"), "open")
    forget(at)
    return out


def _all_rows(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows for ``_links``: all members of a star of one block with each other; of a larger one, each block of members outside
    the main component with each block of all members."""
    one = members.where("parts = 1").select(F.col("c").alias("g1"), F.lit(0).cast("long").alias("g2"), F.lit(0).cast("long").alias("g3"), F.lit(BOTH).alias("role"), "comp", F.col("a").alias("_id"))
    large = members.where("parts > 1")
    outside = large.where("not main").groupBy("c").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.max("parts") / F.max("n"))).cast("long").alias("rows"))
    large = large.join(outside, "c").withColumn("i", F.pmod(F.xxhash64("a", F.lit(5)), "rows")).withColumn("j", F.pmod(F.xxhash64("a", F.lit(7)), "parts"))
    first = F.lit(0).cast("long")
    kept = large.where("not main").select(F.col("c").alias("g1"), F.col("i").alias("g2"), F.explode(F.sequence(first, F.col("parts") - 1)).alias("g3"), F.lit(KEPT).alias("role"), "comp", F.col("a").alias("_id"))
    coming = large.select(F.col("c").alias("g1"), F.explode(F.sequence(first, F.col("rows") - 1)).alias("g2"), F.col("j").alias("g3"), F.lit(COMING).alias("role"), "comp", F.col("a").alias("_id"))
    return one.unionByName(kept).unionByName(coming).join(texts.select("_id", "_text"), "_id")


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) of every document in ``links`` (a, c): comp is the smallest document reachable. Each round hooks every
    component on the smallest neighbouring one and follows hooks to their roots. In two rounds each component that has a
    neighbour is merged with one, so rounds grow as the logarithm of the number of documents, whatever the links' shape,
    and so do the steps of a round. It ends when no link joins two components."""
    edges = written(links.select("a", "c").where("a <> c").distinct(), "edges")
    state = written(edges.select(F.explode(F.array("a", "c")).alias("doc")).distinct().withColumn("comp", F.col("doc")), "comps")
    while True:
        at = edges.join(state.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), "a").join(state.select(F.col("doc").alias("c"), F.col("comp").alias("cc")), "c")
        hooks = at.where("ca <> cc").select(F.greatest("ca", "cc").alias("up"), F.least("ca", "cc").alias("to")).groupBy("up").agg(F.min("to").alias("to"))
        hooks = written(hooks, "hooks")
        if hooks.isEmpty():
            forget(edges, hooks)
            return state
        roots = _roots(hooks)
        before, state = state, written(state.join(roots.select(F.col("up").alias("comp"), F.col("to").alias("root")), "comp", "left").select("doc", F.coalesce("root", "comp").alias("comp")), "comps")
        forget(before, hooks)


def _roots(hooks: DataFrame) -> DataFrame:
    """(up, to) with every ``to`` a root: not hooked itself. Each step follows the hooks of the hooks, so lengths are
    quartered; hooks fall, so they have no cycles."""
    while True:
        one = hooks.join(hooks.select(F.col("up").alias("to"), F.col("to").alias("to2")), "to", "left").select("up", F.coalesce("to2", "to").alias("to"))
        two = one.join(one.select(F.col("up").alias("to"), F.col("to").alias("to2")), "to", "left").select("up", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("went"))
        two = written(two, "roots")
        hooks = two.select("up", "to")
        if two.where("went").isEmpty():  # where the second jump led nowhere, the first one ended at a root
            return hooks


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after links between its components; a document that is in neither is a component by itself."""
    more = components(links)
    to = more.select(F.col("doc").alias("comp"), F.col("comp").alias("to"))
    moved = comps.join(to, "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp"))
    out = written(moved.unionByName(more.join(comps, "doc", "left_anti")), "comps")
    forget(comps, more)
    return out


# ---------------------------------------------------------------- the operator


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row. Linked: 100 * intersection >= percent * union of the sets
    of k-word shingles."""
    r, b = banding(percent / 100)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    sig = written(signatures(docs, k=k, r=r, b=b), "signatures")
    filled = sig.where("n > 0 and _id is not null")
    # classes of equal sets; only a class's smallest id is compared further
    same = filled.groupBy("n", "d1", "d2").agg(F.min("_id").alias("rep"), F.first("bands").alias("bands"))
    # the key is hashed anew for the join, so that a class of a third of all rows can be split there
    digest = F.xxhash64("n", "d1", "d2").alias("h")
    member = filled.select("_id", "n", "d1", "d2", digest).join(same.select("n", "d1", "d2", digest, "rep"), ["h", "n", "d1", "d2"])
    exact = written(member.where("_id > rep").select(F.col("_id").alias("a"), F.col("rep").alias("c")), "equal_sets")
    reps = same.select(F.col("rep").alias("_id"), "bands")
    held = reps.select("_id", F.explode("bands").alias("key"))
    stars = held.groupBy("key").agg(F.min("_id").alias("c"), F.max("_id").alias("high")).where("c <> high").select(F.xxhash64("key").alias("h"), "key", "c")
    pairs = held.select(F.xxhash64("key").alias("h"), "key", F.col("_id").alias("a")).join(stars, ["h", "key"]).where("a <> c").select("c", "a").distinct()
    pairs = written(pairs, "stars")
    some = pairs.select(F.explode(F.array("c", "a")).alias("_id")).distinct()
    some = F.broadcast(some) if pairs.count() <= SENT else some
    texts = written(docs.join(some, "_id", "left_semi").distinct().withColumn("bytes", F.octet_length("_text")), "texts")
    near = _links(_star_rows(pairs.withColumn("comp", F.col("a")), pairs.select("c", F.col("c").alias("p"), F.col("c").alias("comp")).distinct(), texts), k, percent)
    comps = components(exact.unionByName(near))
    members = _open_stars(pairs, texts, comps)
    for n in range(PASSES):  # the members of a large star with some of them
        large = members.where("parts > 1")
        if large.isEmpty():
            break
        pivots = large.where(F.pmod(F.xxhash64("a", F.lit(11 + n)), "n") < PIVOTS).select("c", F.col("a").alias("p"), "comp")
        comps = _joined(comps, _links(_star_rows(large.select("c", "a", "comp"), pivots, texts), k, percent))
        forget(members)
        members = _open_stars(pairs, texts, comps)
    comps = _joined(comps, _links(_all_rows(members, texts), k, percent))
    forget(members, pairs, texts, exact)
    return (
        sig.select("_id", "n")
        .join(comps.select(F.col("doc").alias("_id"), "comp"), "_id", "left")
        .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "_id").alias("component_id"), F.coalesce(F.col("comp") == F.col("_id"), F.lit(True)).alias("kept"))
    )
