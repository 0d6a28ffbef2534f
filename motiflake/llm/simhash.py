"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than differing bits would spoil, so that a segment is left which differs by at most one bit:
two of 32 bits for fingerprints of 64 that differ in at most 3. Each segment is indexed under its variants with one bit
left out; fingerprints meet by equality of a variant and are verified. The exchange goes by a half segment, in which those
that differ by one bit agree on one side; variants of the other half are made after it. Fingerprints, not documents,
are indexed: copies join a class before.

near_duplicates() links 64-bit fingerprints of three-word shingles that differ in at most 3 bits. similar() links sets of
five-word shingles of a Jaccard similarity of 0.8 or more, all of them: in one order of all shingles, rare ones first, two such
sets share one among the first fifth of each. Sets that meet there and whose fingerprints are not far apart connect to
clusters, and within a cluster the shingles themselves decide on every pair that isn't connected by links found already.
Optionally sets meet under segments of wider fingerprints, which costs the same for texts of any length, and misses some.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, read, share_code, written

DIFFER, WORDS, SEED = 3, 3, 42
#: similar(): words of a shingle, least similarity as a fraction.
SIMILAR_WORDS, SIMILAR = 5, (4, 5)
#: similar(): words of 64 bits of a set's fingerprint, and how many bits may differ where sets meet. Pairs of the least
#: similarity differ in 38 of 256, with a deviation of 6 (sets of 4 and 5 shingles in 48): one in 10^10 or fewer differs in
#: more. Sets without common shingles differ in 128, with a deviation of 8.
WIDE, APART = 4, 88
#: Shingles that several of about SAMPLE texts hold, at most COMMON of them, come last in the order. It decides how many
#: sets meet, not which links are found.
SAMPLE, COMMON, SEVERAL = 1 << 15, 1 << 16, 3
#: Characters of a cluster's block, about: one task compares two blocks.
BLOCK_CHARS = 1 << 20
#: similar() by segments: for up to so many documents, segments of a fingerprint and bits of a segment. All find a pair of the least
#: similarity with probability 0.99 (the chance that some segment differs by at most one bit); wider segments cost more
#: variants, and keep buckets small where there are more documents.
SCHEMES = ((1 << 24, 28, 20), (1 << 28, 44, 24), (1 << 32, 76, 28), (1 << 62, 128, 32))
#: Of 128 more bits, how many may differ; pairs of the least similarity differ in 19, with a deviation of 4.
NEAR = 32
#: Sets of fewer shingles are similar to no other set.
LEAST = 4
#: Links that one task verifies for a text, about: texts with more are sent to several.
LINKS = 512
#: Members of a bucket whose pairs are compared together with those of other buckets; members compared at once in larger ones.
SMALL, BLOCK = 64, 256
#: Of the candidates of each class, the nearest of each of FEW parts, by hash, are verified before clusters are.
FEW = 4
#: Rows that one task makes of variants, about.
TASK_ROWS = 4_000_000
_CHUNK = 65_536  # shingles whose bits are counted at once
_NAMES = ["no_id", "id_", "text_hash"]


def _grams(text: str | None, words: int) -> Iterator[bytes]:
    # bytes.lower() and bytes.split() know ASCII alone: A-Z, and the white space x20 and x09-x0D.
    w = (text or "").encode().lower().split()
    return map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else iter([b" ".join(w)] if w else [])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit integer; 0 without words."""
    import xxhash

    grams, total, n, h = _grams(text, words), np.zeros(64, dtype=np.int64), 0, xxhash.xxh64_intdigest
    while True:
        hashes = np.fromiter((h(g, SEED) for g, _ in zip(grams, range(_CHUNK), strict=False)), dtype=np.uint64)
        n += len(hashes)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        if len(hashes) < _CHUNK:
            return int(np.packbits(2 * total > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([fingerprint(t.as_py()) for t in b.columns[-1]], pa.int64())], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, `more` (named columns of type long) and fp (a signed 64-bit integer) of every row."""
    share_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text")
    return rows.mapInArrow(lean(_fingerprints), ", ".join(f"{c} long" for c in [*rows.columns[:-1], "fp"]))


def shingles(text: str | None) -> np.ndarray:
    """The hashes of the text's five-word shingles, sorted, each once; a text of fewer words is one shingle, one without
    words none."""
    import xxhash

    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in _grams(text, SIMILAR_WORDS)), dtype=np.uint64))


@cache
def _mixers(words: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    flip, times = rng.integers(0, 2**64, (words, 2), dtype=np.uint64).T
    return flip, times | np.uint64(1)


def wide(hashes: np.ndarray, bits: int) -> np.ndarray:
    """At least `bits` bits (0 or 1) of a set's fingerprint."""
    flip, times = _mixers(-(-bits // 64))
    total, part = np.zeros(64 * len(flip), np.int64), 255  # sums of so many bits fit a byte
    for at in range(0, len(hashes), part):
        x = (hashes[at : at + part, None] ^ flip) * times
        total += np.unpackbits((x ^ (x >> np.uint64(32))).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * total > len(hashes)).astype(np.uint8)


def _sets(nears: int, bits: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """The last column, text, gives way to its class (a hash of the set), words of 64 bits of its fingerprint, and keys of the
    set and its fingerprint (none of a small set)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, near, cut = [], np.zeros((b.num_rows, nears), np.int64), []
            for i, t in enumerate(b.columns[-1]):
                s = shingles(t.as_py())
                classes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) - 2**63)
                if len(s) < LEAST:
                    cut.append([])
                    continue
                f = wide(s, bits)
                near[i] = np.packbits(f[: 64 * nears]).view(">i8")
                cut.append(keys(s, f))
            new = [pa.array(classes, pa.int64()), *map(pa.array, near.T.copy()), pa.array(cut, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "c", *[f"near{i}" for i in range(nears)], "segments"])

    return run


def _signed(segments: int, width: int) -> Callable:
    """Classes with 128 bits and the segments of their fingerprints."""
    power = 1 << np.arange(width)
    return _sets(2, 128 + segments * width, lambda _, f: f[128 : 128 + segments * width].reshape(segments, width) @ power)


def first_shingles(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first fifth of a set and one more, in the order of counts (0 of those not in `common`, which is sorted), then of
    hashes: sets of the least similarity or more share one of them."""
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")]
    return s[: len(s) + 1 - -(-len(s) * SIMILAR[0] // SIMILAR[1])]


def _prefixed(common: np.ndarray, counts: np.ndarray) -> Callable:
    """Classes with their fingerprints and first shingles."""
    return _sets(WIDE, 64 * WIDE, lambda s, _: first_shingles(s, common, counts).view(np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.columns[0]]
        found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of about SAMPLE of the n texts, sorted, and how many of these hold them."""
    parts = 1 << 30
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) < min(parts, SAMPLE * parts // max(n, 1))).select("text")
    counts = some.mapInArrow(lean(_counted), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEVERAL)
    found = counts.orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s, n = found["s"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _meeting(classes: DataFrame, near: list[str]) -> DataFrame:
    """sig, c and `near` of every key in `segments` of `classes`; those of one sig lie together, in the order of c."""
    n = classes.select(F.sum(F.size("segments"))).first()[0] or 0
    tasks = max(1, 4 * classes.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)
    return classes.select(F.explode("segments").alias("sig"), "c", *near).repartition(tasks, "sig").sortWithinPartitions("sig", "c")


def _variants(key: Column, other: Column, bits: int) -> Column:
    """Of the half `other` of a segment, the variants with one bit left out, each with `key`."""
    at = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
    one = lambda j: F.shiftleft(F.shiftleft(key, 5) + j, bits) + other - other.bitwiseAND(at(j))
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), one)


def _meetings(classes: DataFrame, width: int, near: list[str]) -> DataFrame:
    """sig, c and `near` of every variant of every segment of `classes` (c, near, segments of `width` bits); those of one sig
    lie together, in the order of c."""
    half, n = width // 2, classes.select(F.sum(F.size("segments"))).first()[0] or 0
    low, high = F.col("seg").bitwiseAND((1 << half) - 1), F.shiftright("seg", half)
    key = lambda side, value: F.shiftleft(F.col("at").cast("long") * 2 + side, half) + value
    sides = F.array(F.struct(key(0, high).alias("key"), low.alias("other")), F.struct(key(1, low).alias("key"), high.alias("other")))
    parts = classes.select("c", *near, F.posexplode("segments").alias("at", "seg")).select("c", *near, F.inline(sides))
    # Variants make many rows of few: tasks are made for these.
    tasks = max(1, 4 * classes.sparkSession.sparkContext.defaultParallelism, n * width // TASK_ROWS)
    return parts.repartition(tasks, "key").select("c", *near, F.explode(_variants(F.col("key"), F.col("other"), half)).alias("sig")).select("sig", "c", *near).sortWithinPartitions("sig", "c")


def _met(differ: int, listed: bool) -> Callable:
    """Rows (sig, c, near ...), in order of sig, to links a, b, d: members of a bucket whose near bits differ in d, at most
    `differ`. All of them (`listed`), or of each bucket a spanning forest of the nearest ones: what links of any d connect in
    a bucket of up to BLOCK members, the forest's links of that d connect too. Some come more than once."""

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)

    def weight(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """d, and of links of one d an order that is the same in every bucket: then forests agree where they can."""
        return (d << 20) + ((a ^ b).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def forest(group: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Which of the links i, j of each group are in its forest: the nearest first, unless connected already."""
        order, keep, parent, now = np.lexsort((w, group)), [], {}, None
        for at, g, x, y in zip(order.tolist(), group[order].tolist(), i[order].tolist(), j[order].tolist(), strict=True):
            if g != now:
                now, parent = g, {}
            while (p := parent.get(x, x)) != x:
                x = p
            while (p := parent.get(y, y)) != y:
                y = p
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(at)
        return np.array(keep, dtype=np.int64)

    def nearest(c: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
        """The forest of one block, grown from a member to the nearest one that is left."""
        w, none = weight(apart(near[:, None], near[None, :]), c[:, None], c[None, :]), (differ + 1) << 20
        np.fill_diagonal(w, none)
        out, left = [], w.min(axis=1) < none
        while left.any():
            at = int(left.argmax())
            left[at] = False
            best, source = np.where(left, w[at], none), np.full(len(c), at)
            while best[at := int(best.argmin())] < none:
                out.append((c[source[at]], c[at], best[at] >> 20))
                left[at] = False
                best[at] = none
                closer = left & (w[at] < best)
                best[closer], source[closer] = w[at][closer], at
        return [np.array(out, dtype=np.int64)] if out else []

    def large(c: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
        out, rest = [], np.arange(len(c))
        if listed:
            for i in range(len(c) - 1):
                d = apart(near[i + 1 :], near[i])
                j = np.flatnonzero(d <= differ)
                out.append(np.stack([np.full(len(j), c[i]), c[i + 1 + j], d[j]], axis=1))
            return out
        order = np.lexsort((c, *near.T[::-1]))
        for at in range(0, len(c), BLOCK):
            part = order[at : at + BLOCK]
            out += nearest(c[part], near[part])
        while len(c) > BLOCK and len(rest):  # what blocks leave apart
            found, rest = [int(rest[0])], rest[1:]
            while found and len(rest):
                i = found.pop()
                d = apart(near[rest], near[i])
                linked = d <= differ
                j = rest[linked]
                out.append(np.stack([np.full(len(j), c[i]), c[j], d[linked]], axis=1))
                found, rest = [*found, *j.tolist()], rest[~linked]
        return out

    def links(sig: np.ndarray, c: np.ndarray, near: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.diff(sig, prepend=sig[:1] - 1))
        size = np.diff(starts, append=len(sig))
        out = [x for i in np.flatnonzero(size > SMALL) for x in large(c[starts[i] : starts[i] + size[i]], near[starts[i] : starts[i] + size[i]])]
        some = np.repeat((size > 1) & (size <= SMALL), size)
        sig, c, near = sig[some], c[some], near[some]
        found = []
        for step in range(1, SMALL):
            i = np.flatnonzero(sig[step:] == sig[:-step])
            if not len(i):
                break
            d = apart(near[i], near[i + step])
            i, d = i[d <= differ], d[d <= differ]
            found.append(np.stack([i, i + step, d], axis=1))
        if found:
            i, j, d = np.concatenate(found).T
            if not listed and len(i):
                keep = forest(sig[i], i, j, weight(d, c[i], c[j]))
                i, j, d = i[keep], j[keep], d[keep]
            out.append(np.stack([c[i], c[j], d], axis=1))
        if not out:
            return np.zeros((0, 3), np.int64)
        both = np.concatenate(out)
        both[:, :2] = np.sort(both[:, :2], axis=1)
        return np.unique(both, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            sig, c, *near = (np.concatenate(x) for x in zip(*parts, strict=True))
            found = links(sig, c, np.stack(near, axis=1).view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found.T.copy()], ["a", "b", "d"])

        for b in batches:
            columns = [x.to_numpy() for x in b.columns]
            if not len(columns[0]):
                continue
            # What has the batch's last sig may go on in the next one.
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last or (held and held[-1][0][-1] != columns[0][0]):
                yield done([*held, [x[:last] for x in columns]])
                held = []
            held.append([x[last:] for x in columns])
        if held:
            yield done(held)

    return lean(run)


_LINK = "a long, b long, d long"


def links(classes: DataFrame) -> DataFrame:
    """Pairs a < b of fingerprints (column fp, each once) that differ in 1 to DIFFER bits, each pair once."""
    share_code(classes.sparkSession)
    half = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    return _meetings(classes.select(F.col("fp").alias("c"), F.col("fp").alias("near"), half.alias("segments")), 32, ["near"]).mapInArrow(_met(DIFFER, True), _LINK).select("a", "b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each end of `edges` (a, b) can reach.

    Alternating large and small stars: each round hangs every node's larger (then smaller) neighbours on its least one.
    Rounds are written tables; no neighbourhood is collected, its minimum is a partial aggregate."""

    def least(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("a").agg(F.min("b").alias("m")), "a")

    now = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least(both).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = written(spark, large, "large")
        discard(spark, now)
        small = least(large)
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = written(spark, small, "small")
        discard(spark, large)
        was, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(spark: SparkSession, rows: DataFrame, first: Column) -> DataFrame:
    """Of every fingerprint in `rows` (with fp): fp, root (the least fingerprint that links lead to), first (the least there)."""
    classes = written(spark, rows.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    roots = components(spark, links(classes))
    return written(spark, classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of `docs` (doc_id, text): the least doc_id that links of at most DIFFER
    bits lead to.

    Null texts and those without words have fingerprint 0 and link like any others; a text of any length is counted whole. A
    row without id takes part and gets its component's least id, null if all its documents lack one. Repeated rows stay
    repeated; an empty table gives none; other columns are left out."""
    rows = written(spark, fingerprints(docs), "fingerprints")
    rooted = _rooted(spark, rows, F.col("doc_id"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = written(spark, rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(known, "fp").select("doc_id", "fp", "component_id")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, b, text), a's own text (b null) first: the pairs a, b of similar sets."""
    now, own = None, None
    for rows in batches:
        out = []
        for a, part, b, t in zip(*rows.columns, strict=True):
            key, other, text = (a.as_py(), part.as_py()), b.as_py(), t.as_py()
            if other is None:
                now, own = key, shingles(text)
                continue
            if key != now:
                raise ValueError(f"no text came for class {key[0]}")
            s = shingles(text)
            if min(len(s), len(own)) * SIMILAR[1] < max(len(s), len(own)) * SIMILAR[0]:
                continue
            same = len(np.intersect1d(own, s, assume_unique=True))
            if same * SIMILAR[1] >= (len(own) + len(s) - same) * SIMILAR[0]:
                out.append((key[0], other))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _verify(spark: SparkSession, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Those of `pairs` (a, b) whose texts (c, text) are similar. Each pair brings b's text; a's comes once for LINKS pairs,
    so a text with many links spreads over tasks, and a task holds one set at a time."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / LINKS).cast("int").alias("parts"))
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts, F.col("a") == F.col("c")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b").join(texts, F.col("b") == F.col("c")).select("a", "part", "b", "text")
    rows = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(spark, rows.mapInArrow(lean(_verified), "a long, b long"), name)


def joined(sets: list[np.ndarray], label: np.ndarray, given: np.ndarray) -> list[tuple[int, int]]:
    """Places of links of similar sets that join what `label` holds apart: a forest of all links between labels. Sets that
    are `given` share one label, and none is compared with another of them."""
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    _, ids, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
    start = np.cumsum(n) - n
    group, out = np.unique(label, return_inverse=True)[1], []
    for x in np.flatnonzero(~given):
        own = ids[at[x] : at[x + 1]]
        own = own[n[own] > 1]
        before = np.cumsum(n[own]) - n[own]
        places = np.repeat(start[own] - before, n[own]) + np.arange(n[own].sum())
        same = np.bincount(holders[places], minlength=len(sets))
        near = (same > 0) & (same * SIMILAR[1] >= (size[x] + size - same) * SIMILAR[0])
        for y in np.flatnonzero(near & (group != group[x])):
            if group[y] != group[x]:
                out.append((int(x), int(y)))
                group[group == group[y]] = group[x]
    return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, c, label, given, text), a cluster's two blocks together, to links a, b of similar sets that join
    labels."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        c, label, given, sets = zip(*held, strict=True)
        links = joined(list(sets), np.array(label), np.array(given))
        return pa.RecordBatch.from_arrays([pa.array([c[x[i]] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for rows in batches:
        for cluster, i, j, c, label, given, text in zip(*rows.columns, strict=True):
            key = (cluster.as_py(), i.as_py(), j.as_py())
            if key != now and held:
                yield done()
                held = []
            now = key
            held.append((c.as_py(), label.as_py(), given.as_py(), shingles(text.as_py())))
    if held:
        yield done()


def _settle(spark: SparkSession, clusters: DataFrame, linked: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b that join what `linked` (node, root) leaves apart in each of `clusters` (node, root): every two texts of
    a cluster are compared but for those that both belong to its largest group.

    Members are dealt to blocks by hash, the largest group's (`given`) apart from the others; a task compares two blocks."""
    members = clusters.select(F.col("node").alias("c"), F.col("root").alias("cluster"))
    members = members.unionByName(members.select(F.col("cluster").alias("c"), "cluster").distinct())
    members = members.join(classes.select("c", "chars"), "c").join(linked.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("label", F.coalesce("root", "c"))
    members = written(spark, members.select("cluster", "c", "label", "chars"), "members")
    groups = members.groupBy("cluster", "label").agg(F.sum("chars").alias("chars"), F.count("*").alias("rows"))
    blocks = lambda chars, rows: F.least(F.ceil(chars / BLOCK_CHARS), rows).cast("int")
    apart = groups.groupBy("cluster").agg(F.max(F.struct("chars", "rows", "label")).alias("most"), F.sum("chars").alias("all_chars"), F.sum("rows").alias("all_rows")).filter(F.col("all_rows") > F.col("most.rows"))
    others = blocks(F.col("all_chars") - F.col("most.chars"), F.col("all_rows") - F.col("most.rows"))
    apart = apart.select("cluster", F.col("most.label").alias("main"), others.alias("others"), blocks(F.col("most.chars"), F.col("most.rows")).alias("mains"))
    own = lambda k: F.pmod(F.xxhash64("c"), F.col(k)).cast("int")
    dealt = members.join(apart, "cluster").withColumn("given", F.col("label") == F.col("main")).withColumn("own", F.when(F.col("given"), F.col("others") + own("mains")).otherwise(own("others")))
    # Blocks of others come first; each meets all others and all of the largest group, which meet no other of their own.
    with_ = F.when(F.col("given"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.filter(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1), lambda j: j != F.col("own")))
    rows = dealt.join(texts, "c").withColumn("other", F.explode(with_))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "label", "given", "text")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "c")
    out = written(spark, rows.mapInArrow(lean(_settled), "a long, b long"), "settled")
    discard(spark, members)
    return out


def similar(spark: SparkSession, docs: DataFrame, exact: bool = True) -> DataFrame:
    """first (no_id, id_, text_hash of its least row), c and root of every class of `docs` (doc_id, text): texts of one set of
    five-word shingles are a class, root is one of the classes that links of similar sets lead to.

    Sets meet under their first shingles (or, unless `exact`, under variants of segments, which misses one in a hundred links
    of the least similarity) and their fingerprints are compared: of each bucket a forest of the nearest is kept. A few of the
    nearest of every class are verified by the shingles themselves. Then, in each cluster that the forests connect, every pair
    is compared that these links leave apart."""
    share_code(spark)
    n = docs.count()
    if exact:
        sign, near = _prefixed(*_common(docs, n)), [f"near{i}" for i in range(WIDE)]
    else:
        segments, width = next(x[1:] for x in SCHEMES if n <= x[0])
        sign, near = _signed(segments, width), ["near0", "near1"]
    keys = [k.alias(n) for k, n in zip(_keys(), _NAMES, strict=True)]
    rows = docs.select(*keys, F.coalesce(F.length("text").cast("long"), F.lit(0)).alias("chars"), "text").mapInArrow(lean(sign), ", ".join(f"{n} long" for n in [*_NAMES, "chars", "c", *near]) + ", segments array<long>")
    rows = written(spark, rows, "signed")
    classes = rows.groupBy("c").agg(F.min(F.struct(*_NAMES)).alias("first"), *[F.min(x).alias(x) for x in ("chars", *near, "segments")])
    classes = written(spark, classes, "classes")
    discard(spark, rows)
    met = _meeting(classes, near).mapInArrow(_met(APART, False), _LINK) if exact else _meetings(classes.select("c", *near, "segments"), width, near).mapInArrow(_met(NEAR, False), _LINK)
    pairs = written(spark, met.groupBy("a", "b").agg(F.min("d").alias("d")), "pairs")
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    needed = classes.select("c", "first.*").join(ends, "c")
    texts = written(spark, docs.select(*keys, "text").join(needed, _NAMES).dropDuplicates(["c"]).select("c", "text"), "texts")
    ends = [pairs.select("a", "b", "d", x, y).toDF("a", "b", "d", "end", "other") for x, y in (("a", "b"), ("b", "a"))]
    chosen = ends[0].unionByName(ends[1]).groupBy("end", F.pmod(F.xxhash64("other"), F.lit(FEW))).agg(F.min(F.struct("d", "other", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    chosen = written(spark, chosen, "chosen")
    found = _verify(spark, chosen, texts, "verified")
    linked = written(spark, components(spark, found), "linked")
    more = _settle(spark, components(spark, pairs.select("a", "b")), linked, classes, texts)
    if not more.isEmpty():
        linked = written(spark, components(spark, found.unionByName(more)), "linked")
    out = classes.select("c", "first").join(linked, F.col("c") == F.col("node"), "left").select("first", "c", F.coalesce("root", "c").alias("root"))
    out = written(spark, out, "similar")
    discard(spark, pairs, chosen, texts, classes)
    return out


def _keys() -> list[Column]:
    return [F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")]


def deduplicated(spark: SparkSession, docs: DataFrame, exact: bool = True) -> DataFrame:
    """`docs` (doc_id, text and any others) with one row of each group that links of similar() connect: that of the least
    id, rows without id last; of rows that share it, that of the least text hash; of rows that share both, the least in
    the order of their other columns as JSON.

    Texts without words (null, empty, blanks) are alike; a text of any length counts whole; an empty table gives no rows."""
    stay = written(spark, similar(spark, docs, exact).groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "stay")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for c, n in zip(_keys(), _NAMES, strict=True)])
    # Rows that share id and text differ in other columns only: one partial aggregate, no sort of whole rows.
    names = [f"v{i}" for i in range(len(docs.columns))]
    plain = F.to_json(F.struct(*[F.col("row")[c].alias(n) for c, n in zip(docs.columns, names, strict=True) if c not in ("doc_id", "text")]))
    kept = whole.join(stay, _NAMES, "left_semi").groupBy(*_NAMES).agg(F.min_by("row", plain).alias("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprint and component of every document."""
    found = near_duplicates(spark, read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
