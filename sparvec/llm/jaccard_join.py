"""N-gram Jaccard join: universe-partition pigeonhole.

Documents are sets of hashed word shingles; two link when their Jaccard similarity is at least ``percent``. Sizes are cut into
bands such that two linked sets lie in the same band or in neighbouring ones; a set is indexed in its own band and, as the larger
partner, in the one below. In a band linked sets differ in at most H shingles, so when shingles are hashed to more than H
segments, some segment holds the same subset in both: its hash is a signature. Or, with H // 2 + 1 segments, one differs in
at most one shingle: each subset and its one-deletion neighbourhood are signatures. ``plan`` allocates by cost: segments with few
shingles would meet at sets that have nothing else in common, so they are skipped, and spare segments make up for them; where that costs
more than deletions, as for small sets, deletions are indexed.

Shingles of very many documents (common lines) would be met everywhere, so they are counted first and left out of the universe: two sets without
them differ in no more shingles than before, so every link is still found.

1. Sets are made, and shingles counted, in one pass over the texts. Equal sets are one class, named by its least id, with a sketch of its set: one bit for each of about as many
   places as it has shingles, the parity of the shingles hashed there. The bits in which two sketches differ are a lower bound of the shingles in which
   the sets differ, so a pair with too many such bits is no link.
2. Signatures meet in a shuffle. Buckets with the same members are one; in each bucket the members are tied that their sketches and sizes allow to link. The
   documents of a bucket beyond HOT members are indexed again without the shingles behind its signature; a bucket that is as large without them is
   streamed, each member tied to the first. So no bucket gives pairs, and the ties' components hold every pair of linked sets.
3. The members of a component are dealt out in blocks of BLOCK sets by size; each pair of blocks whose sizes can link is one group. In a
   group all overlaps are counted exactly, as a product of incidence matrices, and only a spanning star of each linked part is returned: no
   pairs leave a task, whatever the number of links. Of a component of several blocks, all members first meet its HEADS heads; members
   that these link needn't meet each other again.
4. The components of these stars and of the classes are the result.

Shingles are compared as 64-bit hashes. Defined results: null and empty texts have no words, an empty set, and link with nothing; a text
with fewer words than a shingle is one shingle; repeated rows are one class; rows without an id link with nothing and get no component;
where one id names several texts, each of its rows has the component of its own text; ties don't arise, as links are undirected; extra
columns are ignored (``deduplicated`` keeps them); an empty table gives an empty result. Whole texts of any length are used.
"""

from __future__ import annotations

import functools
import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_step, discard, partitions_for, table, texts_of, unused, written
from .components import connected_components

WIDTH = 3
PERCENT = 90
BLOCK = 1024
#: Shingles of a block; each set counts as 512 at least.
BLOCK_TOKENS = BLOCK * 512
#: Sets of a large component that all its members meet.
HEADS = 8
#: Bits of the largest sketch.
SKETCH_BITS = 1 << 16
#: Members of a bucket that are compared by their sketches.
HOT = 4096
#: How often documents of larger buckets are indexed again, and how many shingles are left out for that at most.
LEVELS, MOST_LEFT_OUT = 2, 2_000_000
#: Cells of an incidence matrix that are counted at a time.
CELLS = 1 << 22
MEMO_WORDS = 500_000
#: Ids of odd rows (several texts, repeated) that are broadcast; more are shuffled.
BROADCAST_IDS = 50_000
#: Shingles that more of the documents hold than this (in percent) are left out of the universe that is partitioned; and the error of that count.
COMMON, ERROR = 1.0, 0.5
#: Signatures that a plan may spend, as a multiple of the fewest.
MOST_EXTRA = 1.6

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _D
    return x ^ (x >> np.uint64(29))


class Shingler:
    def __init__(self, width: int) -> None:
        self.odd = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(width)]
        self.width = width
        self.memo: dict[bytes, int] = {}

    def word(self, w: bytes) -> int:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            got = self.memo[w] = xxhash.xxh3_64_intdigest(w)
        return got

    def shingles(self, text: str) -> np.ndarray:
        """The sorted set of a text's shingles. bytes.lower and bytes.split know ASCII only."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        try:
            ids = np.array(list(map(self.memo.__getitem__, words)), np.uint64)
        except KeyError:
            ids = np.array([self.word(w) for w in words], np.uint64)
        width = min(self.width, n)
        h = np.full(n - width + 1, np.uint64(width))
        for k in range(width):
            h = (h + ids[k : n - width + 1 + k]) * self.odd[k]
            h ^= h >> np.uint64(32)
        return np.unique(mixed(h))


def most_differing(size: int, percent: int) -> int:
    """Shingles in which two linked sets can differ when the smaller one has this size."""
    return size * (100 - percent) // percent


def bands(size: int, percent: int) -> tuple[int, int]:
    """The number of a size's band, and the largest size in it."""
    top, number = 1, 0
    while top < size:
        top, number = max(top + 1, top * 100 // percent), number + 1
    return number, top


class Plan(NamedTuple):
    """How a band is indexed: segments; spare ones beyond H + 1; the least shingles of a segment that is indexed; or deletions."""

    segments: int
    spare: int
    least: int
    deleting: bool


def weak_share(mean: float, least: int) -> float:
    """The share of segments with fewer than ``least`` shingles when they have ``mean`` on average."""
    term = total = math.exp(-mean)
    for k in range(1, least):
        term *= mean / k
        total += term
    return total


def plan(top: int, percent: int) -> Plan:
    """The cheapest allocation of a band whose smaller sets have at most ``top`` shingles.

    Segments with few shingles are costly, as they meet where nothing is alike; they are left out, and as many spare segments make up for
    them. The plan asks for as many shingles in a segment as it can while the signatures stay below MOST_EXTRA times the fewest; where sets are so small
    that this doesn't work, or that deleting shingles costs less, one-deletion neighbourhoods are indexed.
    """
    h, low = most_differing(top, percent), max(1, top * percent // 100)
    deleting = Plan(h // 2 + 1, 0, 0, True)
    for least in (5, 4, 3, 2, 1):
        spare = 0
        while (h + 1 + spare) <= MOST_EXTRA * (h + 1) + 2:
            m = h + 1 + spare
            weak = m * weak_share(low / m, least)
            if weak + 2 * math.sqrt(weak) <= spare:
                return Plan(m, spare, least, False) if m <= deleting.segments + top else deleting
            spare += 1
    return deleting


def segment_of(tokens: np.ndarray, how: Plan) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(how.segments)) >> np.uint64(32)


def in_band(tokens: np.ndarray, band: int, how: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set in a band, and the segment of each.

    Linked sets agree in spare + 1 segments at least. If no segment that they share is indexed for its shingles, all of these are weak in both, so
    both have more weak segments than spare ones; such a set indexes its weak segments too, and the empty ones where
    they alone are more than the spare ones. With deletions, linked sets differ in one shingle at most in some segment, perhaps an empty one.
    """
    where = segment_of(tokens, how)
    values = mixed(tokens * _A + np.uint64(band))
    order = np.argsort(where, kind="stable")
    where, values = where[order], values[order]
    start = np.flatnonzero(np.diff(where.astype(np.int64), prepend=-1))
    if not len(start):
        start = np.zeros(0, np.int64)
    sums, ids, counts = np.add.reduceat(values, start) if len(start) else values, where[start], np.diff(np.append(start, len(where)))
    tag = lambda i, s: mixed(mixed(s + i * _B) + np.uint64(band) * _C)
    empty = np.setdiff1d(np.arange(how.segments, dtype=np.uint64), ids)
    own = tag(ids, sums)
    if how.deleting:
        return np.concatenate([own, tag(where, np.repeat(sums, counts) - values), tag(empty, np.uint64(0))]), np.concatenate([ids, where, empty])
    strong = counts >= how.least
    if how.segments - strong.sum() <= how.spare:
        return own[strong], ids[strong]
    if len(empty) > how.spare:
        return np.concatenate([own, tag(empty, np.uint64(0))]), np.concatenate([ids, empty])
    return own, ids


class Index:
    """deleting: index one-deletion neighbourhoods in all bands, whose few large segments stay telling where many shingles are left out."""

    def __init__(self, percent: int, deleting: bool = False) -> None:
        self.percent, self.deleting = percent, deleting
        self.plans: dict[int, list[tuple[int, Plan]]] = {}

    def of(self, size: int) -> list[tuple[int, Plan]]:
        """(band, plan) in which a set of this size is indexed."""
        got = self.plans.get(size)
        if got is None:
            number, top = bands(size, self.percent)
            got = []
            if most_differing(top, self.percent):
                got.append((number, self.plan(top)))
            if number:
                t, k = 1, 0
                while k < number - 1:
                    t, k = max(t + 1, t * 100 // self.percent), k + 1
                if most_differing(t, self.percent):
                    got.append((number - 1, self.plan(t)))
            if len(self.plans) < 100_000:
                self.plans[size] = got
        return got

    def plan(self, top: int) -> Plan:
        return Plan(most_differing(top, self.percent) // 2 + 1, 0, 0, True) if self.deleting else plan(top, self.percent)

    def signatures(self, tokens: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Signatures of a set; common: shingles that are left out of the universe."""
        if not len(plans := self.of(len(tokens))):
            return np.zeros(0, np.uint64)
        tokens = without(tokens, common)
        with np.errstate(over="ignore"):
            return np.unique(np.concatenate([in_band(tokens, *p)[0] for p in plans]))

    def behind(self, tokens: np.ndarray, common: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The shingles in the segments of a set whose signatures are hot (sorted)."""
        plans, tokens, out = self.of(len(tokens)), without(tokens, common), [np.zeros(0, np.uint64)]
        with np.errstate(over="ignore"):
            for band, how in plans:
                sigs, segments = in_band(tokens, band, how)
                out.append(tokens[np.isin(segment_of(tokens, how), segments[among(sigs, hot)])])
        return np.unique(np.concatenate(out))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def without(tokens: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    return tokens[~among(tokens, common)] if common is not None and len(common) else tokens


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the first one that it reaches by links. With ``side``, only links between different sides count."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    width = max(1, CELLS // n)
    overlap = np.zeros((n, n), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for a in range(0, int(column[-1]) + 1, width):
            i, j = np.searchsorted(column, [a, a + width])
            part = np.zeros((n, width), np.float32)
            part[owner[i:j], column[i:j] - a] = 1
            overlap += part @ part.T
    both = overlap.astype(np.int64)
    good = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if side is not None:
        good &= side[:, None] != side[None, :]
    np.fill_diagonal(good, True)
    label = np.arange(n)
    a, b = np.nonzero(good)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the shingles hashed to each of 2**k places, at least as many as there are shingles, up to SKETCH_BITS."""
    bits = min(SKETCH_BITS, max(64, 1 << (len(tokens) - 1).bit_length()))
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, as wide as the narrowest: half of one upon the other is the sketch of half as many places."""
    width = min(map(len, sketches))
    out = np.zeros((len(sketches), width // 8), np.uint64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0)
    return out


def possible(sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one that it reaches by pairs that sizes and sketches allow to link."""
    n = len(sizes)
    label, left = np.arange(n), np.ones(n, bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue and left.any():
            i = queue.pop()
            rest = np.flatnonzero(left)
            fits = 100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])
            rest = rest[fits]
            apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = rest[apart * (100 + percent) <= (sizes[rest] + sizes[i]) * (100 - percent)]
            label[near], left[near] = first, False
            queue += near.tolist()
    return label


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


#: kind 0: a document; 1: a shingle (in doc_id) that n_shingles documents of a task hold, as far as counted; 2: a task's number of documents.
SETS = "kind int, doc_id long, n_shingles long, digest binary, sketch binary"


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """SETS: n_shingles, digest and sketch of the set of each document (null where it is empty), and counts of frequent shingles.

    Lossy counting: every task counts all its documents, batch by batch, and drops what has stayed rare; so its memory is bounded, and so is what it returns.
    """

    def run(batches):
        shingler, held, total = Shingler(width), {}, 0

        def rows(*columns: list) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "doc_id", "n_shingles", "digest", "sketch"])

        for b in batches:
            if not b.num_rows:
                continue
            own = [shingler.shingles(t) for t in texts_of(b)]
            yield rows([0] * len(own), b.column("doc_id").to_pylist(), list(map(len, own)), [digest_of(s) if len(s) else None for s in own], [sketch(s) if len(s) else None for s in own])
            total += len(own)
            values, counts = np.unique(np.concatenate(own), return_counts=True)
            few = int(len(own) * ERROR // 100)
            for v, c in zip(values[counts > few].tolist(), counts[counts > few].tolist()):
                held[v] = held.get(v, 0) + c
            held = {v: c for v, c in held.items() if c * 100 > ERROR * total}
        n = len(held)
        yield rows([1] * n + [2], [*np.array(list(held), np.uint64).astype(np.int64).tolist(), None], [*held.values(), total], [None] * (n + 1), [None] * (n + 1))

    return arrow_step(docs.select("doc_id", "text"), run, SETS)


def common_shingles(found: DataFrame) -> np.ndarray:
    """The shingles that at least COMMON percent of all documents hold, give or take ERROR percent, sorted, from SETS.

    There are at most 100 / COMMON such shingles for each shingle of an average document.
    """
    total = found.filter("kind = 2").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    rows = found.filter("kind = 1").groupBy("doc_id").agg(F.sum("n_shingles").alias("c")).filter(F.col("c") * 100 >= total * COMMON).collect()
    return np.sort(np.array([r["doc_id"] for r in rows], np.int64).astype(np.uint64))


def buckets(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> list[DataFrame]:
    """Written tables of (bucket, doc_id, hot): the documents that share a signature with others.

    Documents of hot buckets are indexed again without the shingles behind the hot signatures, as any shingles may be left out, and by deletions; only what is hot
    without them, too, stays hot. All shingles that are left out are bounded by MOST_LEFT_OUT, else the hot buckets stay.
    """
    found = [written(_signed(docs, width, percent, common), "join-buckets")]
    for level in range(LEVELS):
        hot = found[-1].filter("hot")
        sigs = hot.select("bucket").distinct().limit(MOST_LEFT_OUT + 1)
        if hot.isEmpty() or sigs.count() > MOST_LEFT_OUT:
            break
        known = np.sort(np.array([r["bucket"] for r in sigs.collect()], np.int64).astype(np.uint64))
        texts = docs.join(hot.select("doc_id").distinct(), "doc_id", "left_semi")

        def behind(batches, common=common, known=known, deleting=level > 0):
            shingler, index = Shingler(width), Index(percent, deleting)
            for b in batches:
                out = [index.behind(s, common, known) for t in texts_of(b) if len(s := shingler.shingles(t))]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).astype(np.int64) if out else [], pa.int64())], ["x"])

        left_out = arrow_step(texts.select("text"), behind, "x long").distinct().limit(MOST_LEFT_OUT + 1).collect()
        if not 0 < len(left_out) <= MOST_LEFT_OUT - len(common):
            break
        common = np.union1d(common, np.array([r["x"] for r in left_out], np.int64).astype(np.uint64))
        again = written(_signed(texts, width, percent, common, True), "join-buckets")
        cooler = written(found[-1].filter("NOT hot"), "join-buckets")
        discard(found.pop())
        found += [cooler, again]
    return found


def _signed(docs: DataFrame, width: int, percent: int, common: np.ndarray, deleting: bool = False) -> DataFrame:
    """(bucket, doc_id, hot). Signatures that the same documents share are one bucket; one of more than HOT documents goes by its signature."""

    def index(batches):
        shingler, index, met = Shingler(width), Index(percent, deleting), set()
        for b in batches:
            sigs, ids = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                s = shingler.shingles(t)
                if not len(s):
                    continue
                d = digest_of(s)
                if d in met:
                    continue
                if len(met) < MEMO_WORDS:
                    met.add(d)
                sigs.append(index.signatures(s, common))
                ids.append(np.full(len(sigs[-1]), i, np.int64))
                if len(ids) >= 128:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(ids))], ["sig", "doc_id"])
                    sigs, ids = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(ids))], ["sig", "doc_id"])

    def shared(batches):
        known: set[int] = set()
        # of the signature that isn't over: its members so far, or none when they have been sent on as those of a hot one
        last, held, hot = None, np.zeros(0, np.int64), False
        for b in _with_end(batches):
            sig, doc = (b.column("sig").to_numpy(), b.column("doc_id").to_numpy()) if b is not None else (np.zeros(0, np.int64),) * 2
            if b is not None and not len(sig):
                continue
            start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
            ends = np.append(start[1:], len(sig))
            out: list[tuple[int, np.ndarray, bool]] = []

            def over(sig_over: int, members: np.ndarray) -> None:
                members = np.unique(members)
                if len(members) > HOT:
                    out.append((int(sig_over) & 0xFFFFFFFFFFFFFFFF, members, True))
                elif len(members) > 1:
                    key = xxhash.xxh3_64_intdigest(members.tobytes())
                    if key not in known:
                        if len(known) < MEMO_WORDS:
                            known.add(key)
                        out.append((key, members, False))

            first = 0
            if last is not None:
                if len(sig) and sig[0] == last:
                    held, first = np.concatenate([held, doc[: ends[0]]]), 1
                    if hot or len(held) > HOT:
                        out.append((int(last) & 0xFFFFFFFFFFFFFFFF, held, True))
                        held, hot = np.zeros(0, np.int64), True
                if len(start) > first or not len(sig):  # another signature follows
                    if not hot:
                        over(last, held)
                    last = None
            if len(start) > first:
                for k in first + np.flatnonzero(ends[first:-1] - start[first:-1] > 1):
                    over(sig[start[k]], doc[start[k] : ends[k]])
                last, held, hot = sig[-1], doc[start[-1] :], False
            if out:
                n = [len(m) for _, m, _ in out]
                keys = np.repeat(np.array([k for k, _, _ in out], np.uint64), n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([m for _, m, _ in out])), pa.array(np.repeat([h for _, _, h in out], n))], ["bucket", "doc_id", "hot"])

    spark = docs.sparkSession
    found = arrow_step(docs.select("doc_id", "text"), index, "sig long, doc_id long")
    return found.repartition(partitions_for(spark), "sig").sortWithinPartitions("sig", "doc_id").mapInArrow(shared, "bucket long, doc_id long, hot boolean").distinct()


def _with_end(batches):
    yield from batches
    yield None


def ties(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) from (bucket, class_id, n_shingles, sketch): members of a bucket that may link, each tied to the first that it reaches."""

    def tie(batches):
        key, rows, first = None, [], None

        def done():
            label = possible(np.array([r[1] for r in rows], np.int64), folded([r[2] for r in rows]), percent)
            return [(rows[j][0], rows[i][0]) for i, j in enumerate(label.tolist()) if rows[i][0] != rows[j][0]]

        for b in _with_end(batches):
            out: list[tuple[int, int]] = []
            for k, *r in zip(*(b.column(c).to_pylist() for c in ("bucket", "class_id", "n_shingles", "sketch"))) if b is not None else [(None, None)]:
                if k != key:
                    if len(rows) > 1:
                        out += done()
                    key, rows, first = k, [], None
                if first is not None:
                    out.append((first, r[0]))
                    continue
                rows.append(r)
                if len(rows) > HOT:
                    first = rows[0][0]
                    out += [(first, x[0]) for x in rows[1:]]
                    rows = []
            if out:
                x = np.unique(np.array(out, np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    spark = members.sparkSession
    dealt = members.select("bucket", "class_id", "n_shingles", "sketch").repartition(partitions_for(spark), "bucket").sortWithinPartitions("bucket", "class_id")
    return arrow_step(dealt, tie, "a long, b long").distinct()


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs."""
    spark = docs.sparkSession
    read = written(sets(docs, width), "join-rows")
    common, rows = common_shingles(read), read.filter("kind = 0").drop("kind")
    docs = docs.filter("doc_id IS NOT NULL")
    named = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "join-classes")
    class_of = named.select("doc_id", "digest").join(classes.select("digest", "class_id"), "digest").select("doc_id", "class_id")
    found = buckets(docs, width, percent, common)
    members = functools.reduce(DataFrame.unionByName, found).join(class_of, "doc_id").select("bucket", "class_id").distinct()
    tied = written(ties(members.join(classes, "class_id"), percent), "join-ties")
    discard(*found)
    parts = connected_components(tied)
    discard(tied)
    standing = parts.select(F.col("id").alias("class_id"), F.col("component").alias("part")).join(classes.drop("sketch"), "class_id")
    links, used = _all_links(docs, standing, width, percent)
    discard(parts, *used)
    comps = connected_components(functools.reduce(DataFrame.unionByName, links)).select(F.col("id").alias("class_id"), "component")
    own = classes.join(comps, "class_id", "left").select("digest", F.coalesce("component", "class_id").alias("component_id"))
    got = rows.join(own, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    got = written(got, "join-result")
    discard(read, classes, *links)
    return got


#: Each set counts as 512 shingles at least.
WEIGHT = "greatest(n_shingles, 512L)"


def _all_links(docs: DataFrame, standing: DataFrame, width: int, percent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Spanning links (a, b) of the members (class_id, digest, n_shingles, part) of all parts; and other written tables, which may go."""
    total = standing.groupBy("part").agg(F.ceil(F.sum(F.expr(WEIGHT)) / BLOCK_TOKENS).cast("long").alias("n_blocks"))
    dealt = written(standing.join(total, "part"), "join-standing")
    # one group of a part; of a large one several, each with the part's heads
    mine = dealt.withColumn("block", F.pmod(F.xxhash64("class_id"), "n_blocks"))
    large = dealt.filter("n_blocks > 1")
    heads = large.groupBy("part", "n_blocks").agg(*[F.min_by(F.struct("class_id", "digest"), F.xxhash64("class_id", F.lit(k))).alias(f"h{k}") for k in range(HEADS)])
    heads = heads.select("part", "n_blocks", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HEADS)]))).alias("h"))
    heads = heads.select("part", "h.class_id", "h.digest", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
    placed = mine.select("part", "class_id", "digest", "block").unionByName(heads).select("part", F.col("block").alias("b1"), F.col("block").alias("b2"), "block", "class_id", "digest")
    links = written(_links(docs, placed, width, percent), "join-links")
    if large.isEmpty():
        return [links], [dealt]
    # of each large part, what isn't linked yet with most of it
    comps = connected_components(links)
    label = F.coalesce("component", "class_id")
    named = large.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("label", label)
    named = written(named.select("class_id", "digest", "n_shingles", "part", "label"), "join-named")
    most = named.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels"))
    left = named.join(most.filter("labels > 1"), "part").withColumn("rest", F.col("label") != F.col("most")).drop("label", "most", "labels")
    # blocks by size, from sums by size, so that no part is sorted in one task; a size that fills more than a block is dealt out by hash
    sizes = left.groupBy("part", "rest", "n_shingles").agg(F.sum(F.expr(WEIGHT)).alias("w"))
    upto = Window.partitionBy("part", "rest").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
    within = F.pmod(F.xxhash64("class_id"), F.ceil(F.col("w") / BLOCK_TOKENS).cast("long"))
    block = (2 * (F.floor(F.col("before") / BLOCK_TOKENS) + within) + F.col("rest").cast("long")).cast("long")
    left = written(left.join(sizes, ["part", "rest", "n_shingles"]).withColumn("block", block).drop("w", "before"), "join-blocks")
    blocks = left.groupBy("part", "block", "rest").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    other = blocks.select("part", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("rest").alias("rest2"))
    # two blocks meet when a size of one can link with a size of the other
    pairs = blocks.join(other, "part").filter("block <= block2 AND (rest OR rest2)").filter((F.col("low2") * percent <= F.col("high") * 100) & (F.col("low") * percent <= F.col("high2") * 100))
    roles = pairs.select("part", F.col("block").alias("b1"), F.col("block2").alias("b2"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    placed = left.join(roles, ["part", "block"]).select("part", "b1", "b2", "block", "class_id", "digest")
    more = written(_links(docs, placed, width, percent), "join-links")
    return [links, more], [dealt, comps, named, left]


def _links(docs: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): a spanning star of each linked part of the groups (part, b1, b2), whose members are compared by their texts.

    Of a group of two blocks only pairs of both count. One document that has the class's id stands for it; the digest tells its text from others with this id.
    """
    grouped = docs.select(F.col("doc_id").alias("class_id"), "text").join(placed, "class_id")
    prepared = grouped.repartition(partitions_for(docs.sparkSession), "part", "b1", "b2").sortWithinPartitions("part", "b1", "b2")
    names = ("part", "b1", "b2", "block", "class_id", "digest", "text")

    def meet(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        shingler = Shingler(width)

        def done(key, members):
            members = sorted({(m[1], m[2]): m for m in members}.values(), key=lambda m: m[1])
            if len(members) < 2:
                return
            side = None if key[1] == key[2] else np.array([m[0] for m in members])
            label = linked([m[3] for m in members], percent, side)
            ids = np.array([m[1] for m in members])
            tied = label != np.arange(len(label))
            if tied.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[tied]]), pa.array(ids[tied])], schema=schema)

        key, members = None, []
        for b in batches:
            for p, b1, b2, mine, c, d, t in zip(*(b.column(x).to_pylist() for x in names)):
                if key != (p, b1, b2):
                    if key:
                        yield from done(key, members)
                    key, members = (p, b1, b2), []
                s = shingler.shingles(t or "")
                if digest_of(s) == d:
                    members.append((mine, c, d, s))
        if key:
            yield from done(key, members)

    return arrow_step(prepared.select(*names), meet, "a long, b long")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, one with the least id; documents without words stay, once for each id. All columns are kept.

    Each pair of an id and a text is a document of its own here, and so is each text without an id: pairs that an id doesn't name are told
    apart by a 63-bit hash. Rows without an id go when a row with one is linked to them.
    """
    hashed = F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))
    key, unnamed, other, copy = unused(docs, "key", "unnamed", "other", "copy")
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"))
    several = written(several.filter("a <> b").select(F.col("doc_id").alias(other)), "join-several")
    n_several = several.count()
    keyed = docs.withColumn(other, F.lit(None).cast("long"))
    if n_several:
        keyed = docs.join(F.broadcast(several) if n_several <= BROADCAST_IDS else several, F.col("doc_id") == F.col(other), "left")
    keyed = keyed.withColumn(unnamed, F.col("doc_id").isNull() | F.col(other).isNotNull())
    own = F.xxhash64("doc_id", hashed).bitwiseOR(F.lit(-(1 << 63)))
    keyed = keyed.withColumn(key, F.when(F.col(unnamed), own).otherwise(F.col("doc_id"))).drop(other)
    result = components(keyed.select(F.col(key).alias("doc_id"), "text"), width, percent)
    comps = written(result.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles")), "join-keyed")
    discard(result)
    ids = keyed.filter(F.col(unnamed)).select(F.col(key).alias("doc_id"), F.col("doc_id").alias("id"), F.lit(True).alias("unnamed")).distinct()
    named = comps.join(ids, "doc_id", "left").withColumn("id", F.when(F.col("unnamed"), F.col("id")).otherwise(F.col("doc_id")))
    named = written(named.drop("unnamed"), "join-named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).getField("doc_id").alias("first"))
    gone = written(comps.join(first, "component_id").filter("doc_id <> first").select(F.col("doc_id").alias(key)), "join-gone")
    stay = keyed.join(gone, key, "left_anti")
    # rows of one key are copies; those without words and id aren't known to be
    again = written(named.filter("n > 1 AND (n_shingles > 0 OR id IS NOT NULL)").select(F.col("doc_id").alias(key)), "join-again")
    discard(comps, named)
    n_again = again.count()
    if n_again:
        again = F.broadcast(again) if n_again <= BROADCAST_IDS else again
        hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        number = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*hashable)))
        once = stay.join(again, key, "left_semi").withColumn(copy, number).filter(F.col(copy) == 1).drop(copy)
        stay = stay.join(again, key, "left_anti").unionByName(once)
    return stay.select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


#: The same by brute force: all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = doc_id), doc_id)) AS component_id FROM s
"""
