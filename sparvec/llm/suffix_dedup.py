"""Suffix-array deduplication: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

A byte is repeated when it lies in a string of ``min_bytes`` bytes that also starts somewhere else, in any document, overlaps
included. A full suffix array of all text isn't needed for that. Of each string of ``min_bytes`` bytes, the place with
the least hash of SEED bytes is its anchor; equal strings have equal anchors, so it is enough to sort the suffixes at
anchors (about one place in 85), and of those only the ones whose seed occurs more than once.

1. ``anchors``: one pass over each text finds its anchors and the range of strings that each stands for.
2. Seeds are counted (pre-aggregated); the anchors of seeds that occur once are done.
3. Each other anchor is dealt out with the text around it, by its seed; of equal surroundings in one text, which are repeats as a whole, one.
4. In each group, the suffixes are sorted and their common prefixes (to the right of the anchor) found; a stack scan gives the
   intervals of the common-prefix tree. In each interval the members are put in the order of what stands left of them; neighbours there
   differ in the byte that would extend them next (or end), so the repeat that they share is left-diverse, and every member gets the longest
   one: all occurrences of a maximal repeat are reported, not just neighbours in the suffix array. As all of a member's
   repeats hold its anchor, their union is one span.
5. A group of more than GROUP anchors is split by further bytes first. Its strings start up to ``min_bytes`` - SEED bytes before the anchor; those of each
   half of these starts share more bytes than the seed, and these bytes name the new group. An anchor is in both halves, and equal strings stay
   together. Surroundings that occur twice are repeats as a whole, and one of them goes on for all; groups of one are done. So an anchor in a common
   passage is followed at the passage's two ends only. Half by half, all groups come to GROUP anchors, or to a single string.

``repeat_groups`` lists the maximal repeats themselves, each with all its places, from the same tree: of each interval the sub-intervals by what stands left, as
far as they differ in the byte on either side. A longer repeat than the strings of one anchor cover shows as several groups that overlap.

Each copy of a text that occurs more than once is covered as a whole, so only one of them takes part in 3 to 5.

Defined results: a null text counts as an empty one; texts shorter than ``min_bytes`` hold no repeat; repeated rows are copies of each other;
rows that share an id (or have none) but not the text are told apart by a 64-bit hash of it; extra columns are ignored (``without_repeats``
keeps them); an empty table gives an empty result. Texts of any length are read whole. Ties don't matter, as all
occurrences go.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_step, discard, partitions_for, table, unused, written

MIN_BYTES = 200
SEED = 32
#: Anchors that a task sorts together; more are split by further bytes.
GROUP = 4096
#: Stands for a null id while repeats are found; rows without an id are told apart by their texts.
NO_ID = -(1 << 63)
#: Anchors that a task holds at a time.
CHUNK = 16_384

_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def anchors(data: bytes, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, place, first string, last string) of each anchor; strings are named by their start."""
    n = len(data)
    if n < min_bytes:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h, width = np.frombuffer(data, np.uint8).astype(np.uint64), 1
    for odd in _ODD:  # 1, 2, 4, ... SEED bytes
        h = h[:-width] * odd + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    wide, width = min_bytes - SEED + 1, 1
    while 2 * width <= wide:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < wide:
        m = np.minimum(m[: len(m) - (wide - width)], m[wide - width :])
    place = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    return h[at].astype(np.int64), at, first, last


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, parts), default=0) or 1
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width), np.fromiter(map(len, parts), np.int64, len(parts))


def _common(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of rows a and b of a matrix whose rows have n bytes."""
    differ = m[a] != m[b]
    first = differ.argmax(1)
    return np.minimum(np.where(differ[np.arange(len(a)), first] if len(a) else first, first, m.shape[1]), np.minimum(n[a], n[b]))


def intervals(lcp: list[int]):
    """The intervals (first, last, common prefix) of the tree over a suffix array; lcp[i] is shared by i - 1 and i, -1 by none."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        shared = lcp[i] if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > shared:
            prefix, left = stack.pop()
            yield left, i - 1, prefix
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, left))


class Tree:
    """The suffixes of a group's members at their anchors, in order, with the intervals of their common prefixes.

    contexts: the text around each anchor, offsets: where in it the anchor is. Members of different groups aren't compared.
    """

    def __init__(self, groups: list, contexts: list[bytes], offsets: list[int]) -> None:
        n = len(contexts)
        self.rights = [c[o:] for c, o in zip(contexts, offsets)]
        lefts = [c[:o][::-1] for c, o in zip(contexts, offsets)]
        suffixes = sorted(range(n), key=lambda i: (groups[i], self.rights[i]))
        self.by_left = sorted(range(n), key=lambda i: (groups[i], lefts[i]))
        rank = [0] * n
        for k, i in enumerate(self.by_left):
            rank[i] = k
        right_m, right_n = _matrix([self.rights[i] for i in suffixes])
        self.left_m, self.left_n = _matrix([lefts[i] for i in self.by_left])
        along = np.arange(max(0, n - 1))
        shared = _common(right_m, right_n, along, along + 1)
        self.lcp = [-1, *(int(x) if groups[suffixes[k]] == groups[suffixes[k + 1]] else -1 for k, x in enumerate(shared))][:n]
        self.ranks = [rank[i] for i in suffixes]

    def repeats(self, min_bytes: int):
        """(the ranks by what stands left of an interval's members, their common prefix), where a repeat of min_bytes can be."""
        longest_left = int(self.left_n.max(initial=0))
        for first, last, prefix in intervals(self.lcp):
            if prefix + longest_left >= min_bytes:
                yield sorted(self.ranks[first : last + 1]), prefix


def extents(groups: list, contexts: list[bytes], offsets: list[int], min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeats of each anchor reach to its left and right; 0 and 0 where it has none of min_bytes."""
    n = len(contexts)
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return far_left, far_right
    tree = Tree(groups, contexts, offsets)
    members = np.array(tree.by_left)
    held: list[list[int]] = []
    reach: list[int] = []
    total = 0

    def flush() -> None:
        x = np.concatenate([np.array(h) for h in held])
        sizes = np.array(list(map(len, held)))
        r = np.repeat(np.array(reach), sizes)
        both = _common(tree.left_m, tree.left_n, x[:-1], x[1:])
        both[np.cumsum(sizes)[:-1] - 1] = -1  # the last of one interval and the first of the next
        left = np.maximum(np.append(both, -1), np.insert(both, 0, -1))
        good = left + r >= min_bytes
        np.maximum.at(far_left, members[x[good]], left[good])
        np.maximum.at(far_right, members[x[good]], r[good])

    for ranks, prefix in tree.repeats(min_bytes):
        held.append(ranks)
        reach.append(prefix)
        total += len(ranks)
        if total > 60_000:
            flush()
            held, reach, total = [], [], 0
    if held:
        flush()
    return far_left, far_right


def maximal(groups: list, contexts: list[bytes], offsets: list[int], min_bytes: int = MIN_BYTES):
    """(bytes to the left of the anchor, to its right, members) of the repeats that differ in the byte on either side, or end there."""
    if len(contexts) < 2:
        return
    tree = Tree(groups, contexts, offsets)
    for ranks, right in tree.repeats(min_bytes):
        x = np.array(ranks)
        both = _common(tree.left_m, tree.left_n, x[:-1], x[1:])
        for first, last, left in intervals([-1, *both.tolist()]):
            if left + right >= min_bytes:
                members = [tree.by_left[k] for k in ranks[first : last + 1]]
                after = [tree.rights[m][right : right + 1] for m in members]
                if b"" in after or len(set(after)) > 1:
                    yield left, right, members


def _texts(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(data).alias("th"), data.alias("data"))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """What is repeated: (rows, spans).

    rows: doc_id, th (hash of the text), n_bytes, sha256 (of the text), whole (it is repeated as a whole), one per row.
    spans: doc_id, th, spans (array of start and end, not yet merged) of the texts that aren't repeated as a whole.
    """
    if not 2 * SEED <= min_bytes <= 4000:
        raise ValueError(f"min_bytes lies between {2 * SEED} and 4000")
    spark = docs.sparkSession
    texts = _texts(docs)
    read = written(texts.select("doc_id", "th", F.length("data").cast("long").alias("n_bytes"), F.md5("data").alias("m"), F.sha2("data", 256).alias("sha256")), "repeat-read")
    classes = read.groupBy("m", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th")).alias("first"))
    copies = written(classes.filter((F.col("n") > 1) & (F.col("n_bytes") >= min_bytes)), "repeat-copies")
    rows = read.join(copies.select("m", "n_bytes", F.lit(True).alias("c")), ["m", "n_bytes"], "left").select("doc_id", "th", "n_bytes", "sha256", F.coalesce("c", F.lit(False)).alias("whole"))
    rows = written(rows, "repeat-rows")
    discard(read)
    # the copies that don't take part
    spare = rows.filter("whole").join(copies.select(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")), ["doc_id", "th"], "left_anti").select("doc_id", "th").distinct()

    got = _found(texts, spare, min_bytes)
    discard(copies)
    spans = functools.reduce(DataFrame.unionByName, got).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return rows, spans.join(rows.filter("whole").select("doc_id", "th").distinct(), ["doc_id", "th"], "left_anti")


def repeat_groups(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """repeat (a digest of its bytes), n_bytes, doc_id, start: one row for each place of each maximal repeat, copies of texts included.

    As many rows as there are places; a part of a text that many repeats hold is in many of them. In groups that are split on, repeats are told apart by the
    strings that name the parts, so a repeat shows as several there.
    """
    texts = _texts(docs)
    got = functools.reduce(DataFrame.unionByName, _found(texts, None, min_bytes, True)).distinct()
    return got.select(F.hex("repeat").alias("repeat"), (F.col("end") - F.col("start")).alias("n_bytes"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "start")


def _found(texts: DataFrame, spare: DataFrame | None, min_bytes: int, listed: bool = False) -> list[DataFrame]:
    """Written tables of doc_id, th, start, end of the repeats of all texts without the spare ones; listed: of each maximal one, with its digest."""
    def find(batches):
        names, kinds = ["h", "doc_id", "th", "at"], [pa.int64()] * 4
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                out = [[], [], [], []]
                for i, th, data in zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist(), part.column("data").to_pylist()):
                    h, at, first, last = anchors(data, min_bytes)
                    out[0].append(h)
                    out[1] += [i] * len(h)
                    out[2] += [th] * len(h)
                    # place, and how far before it the first and last strings start
                    out[3].append((at << 24) | ((at - first) << 12) | (at - last))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]) if out[0] else [], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], kinds[2]), pa.array(np.concatenate(out[3]) if out[3] else [], kinds[3])], names)

    marks = written(arrow_step(texts, find, "h long, doc_id long, th long, at long"), "repeat-anchors")
    # written, so that the join below is one that Spark can split where a seed is hot
    seeds = written(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeat-seeds")
    hot = not seeds.filter(F.col("n") > GROUP).isEmpty()
    members = _dealt(texts, marks, seeds, spare, min_bytes, listed)
    if not hot:
        got = [written(_scanned(members, "h", min_bytes, listed), "repeat-spans")]
        discard(marks, seeds)
        return got
    # written, so that marks and texts are brought together once for both kinds
    members = written(members, "repeat-members")
    discard(marks, seeds)
    got = [written(_scanned(members.filter("NOT hot"), "h", min_bytes, listed), "repeat-spans"), *_split(members.filter("hot"), min_bytes, listed)]
    discard(members)
    return got


MEMBERS = "h long, doc_id long, th long, start long, offset int, context binary, hot boolean"


def _dealt(texts: DataFrame, marks: DataFrame, seeds: DataFrame, spare: DataFrame | None, min_bytes: int, listed: bool = False) -> DataFrame:
    """MEMBERS: each anchor of the seeds given, with the text around it, where in that it is, and whether its seed has more than GROUP anchors.

    Without a context, a row is a span of a text from start, offset bytes long, that is known to be repeated in that text.
    """
    found = marks.join(seeds, "h").groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "at", (F.col("n") > GROUP).alias("hot"))).alias("marks"))
    found = found if spare is None else found.join(spare, ["doc_id", "th"], "left_anti")

    def cut(batches):
        schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("offset", pa.int32()), ("context", pa.binary()), ("hot", pa.bool_())])
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                data, i, th = (row.column(c)[0].as_py() for c in ("data", "doc_id", "th"))
                m = row.column("marks").flatten()
                h, at, hot = (m.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                place = at >> 24
                first, end = place - ((at >> 12) & 4095), place - (at & 4095) + min_bytes
                contexts = [data[x:y] for x, y in zip(first.tolist(), end.tolist())]
                offset = place - first
                known: list[tuple[int, int]] = []
                if not listed and len(np.unique(h)) < len(h):
                    met: dict[tuple, int] = {}
                    again = set()
                    for j, key in enumerate(zip(h.tolist(), offset.tolist(), contexts)):
                        if met.setdefault(key, j) != j:
                            again.add(j)
                            again.add(met[key])
                    if again:
                        known = merged(sorted((int(first[j]), int(end[j])) for j in again))
                        keep = sorted(met.values())
                        h, first, offset, hot, contexts = h[keep], first[keep], offset[keep], hot[keep], [contexts[j] for j in keep]
                n, size = len(known), len(h) + len(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h, np.full(n, th)])),
                        pa.array([i] * size, pa.int64()),
                        pa.array([th] * size, pa.int64()),
                        pa.array(np.concatenate([first, [x for x, _ in known]]).astype(np.int64)),
                        pa.array(np.concatenate([offset, [y - x for x, y in known]]).astype(np.int32)),
                        pa.array(contexts + [None] * n, pa.binary()),
                        pa.array(np.concatenate([hot, np.zeros(n, bool)])),
                    ],
                    schema=schema,
                )

    return arrow_step(found.join(texts, ["doc_id", "th"]).select("doc_id", "th", "marks", "data"), cut, MEMBERS)


SPANS = "doc_id long, th long, start long, end long, repeat binary"


def _scanned(members: DataFrame, key: str, min_bytes: int, listed: bool = False) -> DataFrame:
    """SPANS: the repeats of members that share a key, merged as far as a task can; listed: each maximal one, with its digest."""
    members = members.select(key, "doc_id", "th", "start", "offset", "context")
    members = members.repartition(partitions_for(members.sparkSession), key).sortWithinPartitions(key)

    def scan(batches):
        schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "th", "start", "end")), ("repeat", pa.binary())])
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 5, schema)], schema=schema)

        def done(rows: list[tuple], known: list[tuple]):
            keys, contexts, offsets = [r[0] for r in rows], [r[5] for r in rows], [r[4] for r in rows]
            if listed:
                out = []
                for x, y, own in maximal(keys, contexts, offsets, min_bytes):
                    digest = hashlib.blake2b(contexts[own[0]][offsets[own[0]] - x : offsets[own[0]] + y], digest_size=16).digest()
                    out += [(*rows[m][1:3], rows[m][3] + rows[m][4] - x, rows[m][3] + rows[m][4] + y, digest) for m in own]
                    if len(out) > CHUNK:
                        yield batch(out)
                        out = []
                yield batch(out)
                return
            left, right = extents(keys, contexts, offsets, min_bytes)
            of: dict[tuple, list] = {}
            for r, x, y in zip(rows, left.tolist(), right.tolist()):
                if x + y:
                    of.setdefault(r[1:3], []).append((r[3] + r[4] - x, r[3] + r[4] + y))
            for r in known:
                of.setdefault(r[1:3], []).append((r[3], r[3] + r[4]))
            yield batch([(*name, *run, None) for name, spans in of.items() for run in merged(sorted(spans))])

        rows: list[tuple] = []
        known: list[tuple] = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in (key, "doc_id", "th", "start", "offset", "context"))):
                if len(rows) >= CHUNK and r[0] != rows[-1][0]:
                    yield from done(rows, known)
                    rows, known = [], []
                (rows if r[5] is not None else known).append(r)
        if rows or known:
            yield from done(rows, known)

    return arrow_step(members, scan, SPANS)


def halves(row: tuple, whole: bool, min_bytes: int) -> list[tuple]:
    """The members that a member (h, a, b, offset, context) becomes in the halves of its group, or in the group itself.

    Its strings start a to b bytes before the anchor, as far as it has them. Returned: a, b, the bytes that all of these strings share, how far before
    the anchor the member's own first one starts, the member's bytes, and how many bytes it has lost in front.
    """
    _, a, b, offset, context = row
    middle, out = (a + b) // 2, []
    for x, y in ((a, b),) if whole else ((a, middle), (middle + 1, b)):
        low, high = max(x, offset + min_bytes - len(context)), min(y, offset)
        if low <= high:
            out.append((x, y, context[offset - x : offset + min_bytes - y], high, context[offset - high : offset + min_bytes - low], offset - high))
    return out


def _split(members: DataFrame, min_bytes: int, listed: bool = False) -> list[DataFrame]:
    """SPANS of MEMBERS whose seeds are hot. Where they are listed, all members go on to the single strings, so that every group has all its places."""

    def split(whole: bool):
        def run(batches):
            schema = pa.schema([("key", pa.binary()), ("same", pa.binary()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("offset", pa.int32()), ("context", pa.binary())])
            digest = lambda *x: hashlib.blake2b(b"".join(x), digest_size=16).digest()
            number = lambda *x: np.array(x, np.int64).tobytes()
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    out = []
                    for h, a, b, i, th, start, offset, context in zip(*(batch.column(c).slice(at, 4096).to_pylist() for c in ("h", "a", "b", "doc_id", "th", "start", "offset", "context"))):
                        for x, y, core, high, own, lost in halves((h, a, b, offset, context), whole, min_bytes):
                            out.append((digest(number(h, x, y), core), digest(number(h, x, y, high), own), h, x, y, i, th, start + lost, high, own))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)

        return run

    span = lambda df, n, repeat: df.select("doc_id", "th", "start", (F.col("start") + n).alias("end"), repeat.cast("binary").alias("repeat"))
    got: list[DataFrame] = []
    now = members.withColumns({"a": F.lit(0), "b": F.lit(min_bytes - SEED)})
    parents: list[DataFrame] = []
    while True:
        kind = "key binary, same binary, h long, a int, b int, doc_id long, th long, start long, offset int, context binary"
        made = written(arrow_step(now.select("h", "a", "b", "doc_id", "th", "start", "offset", "context"), split(not parents), kind), "repeat-halves")
        # written, so that Spark can split the joins where a group is hot
        sizes = written(made.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeat-sizes")
        place = F.struct("doc_id", "th", "start")
        same = written(made.groupBy("same").agg(F.count(F.lit(1)).alias("s"), F.min(place).alias("first")).filter("s > 1").drop("s"), "repeat-same")
        placed = made.join(sizes, "key")
        got.append(written(_scanned(placed.filter(F.col("n") <= GROUP), "key", min_bytes, listed), "repeat-spans"))
        placed = placed.filter(F.col("n") > GROUP).join(same, "same", "left")
        left = placed.withColumn("again", F.col("first").isNotNull()).withColumn("on", (F.lit(listed) | F.coalesce(F.col("first") == place, F.lit(True))) & (F.col("a") < F.col("b")))
        left = written(left.drop("key", "n", "first"), "repeat-left")
        got.append(written(span(left.filter("again"), F.length("context"), F.unhex(F.md5("context"))), "repeat-spans"))
        discard(made, sizes, same, *parents)
        parents = [left]
        now = left.filter("on")
        if now.isEmpty():
            discard(left)
            return got


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as maximal runs."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, upto = [], 0
    for a, b in runs:
        out.append(data[upto:a])
        upto = b
    return b"".join([*out, data[upto:]])


def _runs(spans: pa.Array, k: int) -> list[tuple[int, int]]:
    """The merged spans in place k."""
    s = spans.slice(k, 1).flatten()
    return merged(list(zip(s.field(0).to_pylist(), s.field(1).to_pylist())))


def _each(batches):
    """(row of the batch, its data, its merged spans)."""
    for b in batches:
        for k in range(b.num_rows):
            yield b, k, b.column("data")[k].as_py(), _runs(b.column("spans"), k)


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """All rows and columns of docs, the repeated bytes taken out of the text; characters of which a part went go as well."""
    rows, spans = repeated_spans(docs, min_bytes)

    @F.arrow_udf("string")
    def strip(data: pa.Array, spans: pa.Array) -> pa.Array:
        out: list = [None] * len(data)
        for k in np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False)).tolist():
            out[k] = kept(data[k].as_py(), _runs(spans, k)).decode("utf-8", "ignore")
        return pa.array(out, pa.string())

    whole = rows.filter("whole").select("doc_id", "th", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")).distinct()
    columns = unused(docs, "id", "hash", "spans")
    changed = spans.unionByName(whole).toDF(*columns)
    i, h, s = map(F.col, columns)
    same = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == i) & (F.xxhash64(F.coalesce(docs["text"], F.lit("")).cast("binary")) == h)
    # texts meet their spans in the join that brings all rows back; only texts with spans go through Python
    joined = docs.join(changed, same, "left")
    cut = strip(F.when(s.isNotNull(), F.col("text").cast("binary")), s)
    return joined.withColumn("text", F.when(i.isNull(), F.col("text")).when(s.isNull(), F.lit("")).otherwise(cut)).select(*docs.columns)


def digests(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    rows, spans = repeated_spans(docs, min_bytes)

    def strip(batches):
        for b, k, data, runs in _each(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(k, 1), b.column("th").slice(k, 1), pa.array([sum(y - x for x, y in runs)], pa.int64()), pa.array([len(runs)], pa.int64()), pa.array([hashlib.sha256(kept(data, runs)).hexdigest()], pa.string())],
                ["doc_id", "th", "r", "s", "k"],
            )

    cut = arrow_step(spans.join(_texts(docs), ["doc_id", "th"]).select("doc_id", "th", "spans", "data"), strip, "doc_id long, th long, r long, s long, k string")
    got = rows.join(cut.select("doc_id", "th", F.struct("r", "s", "k").alias("c")), ["doc_id", "th"], "left")
    whole, zero = F.col("whole"), F.lit(0).cast("long")
    return got.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("c.r", zero)).alias("n_removed"),
        F.when(whole, zero + 1).otherwise(F.coalesce("c.s", zero)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("c.k", "sha256")).alias("kept_sha256"),
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: The same by brute force: every string of 200 bytes, as a slice of the text's bytes.
SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(octet_length(h) - 199, 0))) AS p FROM d),
g AS (SELECT doc_id, p, md5(h[p + 1 : p + 200]) AS k FROM w),
twice AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS apart FROM g JOIN twice USING (k)),
numbered AS (SELECT doc_id, p, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 200 AS e FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM runs
  UNION ALL SELECT doc_id, max(e), max(e), NULL FROM runs GROUP BY doc_id
),
cut AS (SELECT doc_id, string_agg(hex(h[a + 1 : coalesce(b, octet_length(h))]), '' ORDER BY a, b NULLS LAST) AS x FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(x), h)) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
