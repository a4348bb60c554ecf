"""Plain versions of the corpus operators, to compare with."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

SPACES = b" \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def substring_dedup(rows, window=50):
    """rows: (doc_id, text). Returns sorted (doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first.get(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(rows, k=3, percent=85):
    """rows: (doc_id, text). Returns sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    some = []
    for i, s in sets:  # equal sets by their own
        if s and i is not None:
            f = frozenset(s)
            if f in seen:
                a, b = find(i), find(seen[f])
                root[max(a, b)] = min(a, b)
            else:
                seen[f] = i
                some.append((i, s))
    index = {}
    for n, (i, s) in enumerate(some):
        near = {}
        for g in s:
            for m in index.get(g, ()):
                near[m] = near.get(m, 0) + 1
            index.setdefault(g, []).append(n)
        for m, both in near.items():
            if 100 * both >= percent * (len(s) + len(some[m][1]) - both):
                a, b = find(i), find(some[m][0])
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=str)


def stratified_shards(rows, shards, seed="interleave-1"):
    """rows: (doc_id, text, source) without repeats. Returns {doc_id: (shard, slot)}: seeded shuffle within each source,
    order by fractional rank, cut into runs whose sizes differ by one at most."""
    keyed = []
    for i, t, s in rows:
        data = (t or "").encode()
        key = hashlib.md5(f"{seed}/{'null' if i is None else i}/{zlib.crc32(data)}/{len(data) + 1}".encode()).hexdigest()
        keyed.append(("" if s is None else f"={s}", key, i))
    by_source = {}
    for s, key, i in sorted(keyed):
        by_source.setdefault(s, []).append((key, i))
    order = sorted((Fraction(2 * r + 1, 2 * len(v)), s, key, i) for s, v in by_source.items() for r, (key, i) in enumerate(v))
    out, cuts = {}, [-(-k * len(order) // shards) for k in range(shards + 1)]
    for k in range(shards):
        for slot, (*_, i) in enumerate(order[cuts[k] : cuts[k + 1]]):
            out[i] = (k, slot)
    return out


def boilerplate_dropped(rows, ratio=0.1, min_pages=2):
    """rows: (id, host, text). Returns {id: text} after each host's lines over the ratio are gone."""
    pages = {}
    for _, host, text in rows:
        lines = tuple(x.strip() for x in (text or "").split("\n") if x.strip())
        pages.setdefault(host, set()).add(lines)
    gone = {}
    for host, some in pages.items():
        held = Counter(x for lines in some for x in set(lines))
        gone[host] = {x for x, n in held.items() if n >= min_pages and n > ratio * len(some)}
    return {i: text if text is None else "\n".join(x for x in text.split("\n") if x.strip() not in gone[host]) for i, host, text in rows}


def local_score(a, b):
    """Smith-Waterman over two word lists: match 2, mismatch and gap -1."""
    row, top = [0] * (len(b) + 1), 0
    for x in a:
        last, diagonal = 0, 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], max(0, diagonal + (2 if x == y else -1), row[j] - 1, last - 1)
            last = row[j]
            top = max(top, last)
    return top


def leaks(docs, items, gram=3, threshold=0.5):
    """docs, items: (id, text). {(doc, item): score} of the pairs that share a gram and align well enough."""
    cut = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    out = {}
    for i, t in docs:
        w = cut(t)
        held = {tuple(w[k : k + gram]) for k in range(len(w) - gram + 1)}
        for j, u in items:
            v = cut(u)
            if held & {tuple(v[k : k + gram]) for k in range(len(v) - gram + 1)}:
                score = local_score(v, w) / (2 * len(v))
                if score >= threshold:
                    out[i, j] = score
    return out


def read_stream(media):
    """Payload, times, and which are random-access points, of a transport stream: packet by packet."""
    counters, programs, streams, parts = {}, {}, set(), []
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47 and len(p) == 188
        pid, counter = (p[1] & 31) << 8 | p[2], p[3] & 15
        assert counters.get(pid, counter - 1 & 15) == counter - 1 & 15
        counters[pid] = counter
        body, access = p[4:], False
        if p[3] & 0x20:
            access = body[0] > 0 and bool(body[1] & 0x40)
            body = body[1 + body[0] :]
        if pid == 0:
            programs[body[9] << 8 | body[10]] = (body[11] & 31) << 8 | body[12]
        elif pid in programs.values():
            streams.add((body[14] & 31) << 8 | body[15])
        elif pid in streams:
            if p[1] & 0x40:
                parts.append([b"", access])
            parts[-1][0] += body
    payload, times, points = b"", [], []
    for pes, access in parts:
        assert pes[:3] == b"\0\0\1" and len(pes) == 6 + int.from_bytes(pes[4:6], "big")
        bits = "".join(f"{x:08b}" for x in pes[9:14])
        times.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        points.append(access)
        payload += pes[9 + pes[8] :]
    return payload, times, points
