"""Brute-force top-k: exact, over codes, by key, and in two stages.

Slots and queries are packed into blocks (SLOT_BLOCK and QUERY_BLOCK rows); every block of slots meets every block of queries once, and only the best k
of each query leave it. So a task holds two blocks, what is shuffled is k rows a query and slot block, and a hit list is
cut by a window whose partial limit Spark pushes below the exchange. The queries are broadcast while they are few (BROADCAST_BLOCKS blocks of them).
Beyond, blocks are dealt out on a grid: a block of slots goes to one row of it and a block of queries to one column, each is sent once to every cell there, and
a hash join by cell brings them together; so nothing is encoded again. Hits are ordered by score, then by the lower slot; so no result depends on the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import IndexConfig
from ..functions import kernels
from .encode import matrix
from .workers import reach

SLOT_BLOCK = 8192
QUERY_BLOCK = 512
BROADCAST_BLOCKS = 32

Rows = dict[str, np.ndarray]


def _blocks(df: DataFrame, read, size: int) -> DataFrame:
    """Rows as blocks: one row (block binary) for at most size rows; read turns a batch into arrays by name."""
    reach(df.sparkSession)

    def run(batches):
        import pickle

        for b in batches:
            for k in range(0, b.num_rows, size):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(read(b.slice(k, size)), 5)], pa.binary())], ["block"])

    return df.mapInArrow(run, "block binary")


def query_blocks(queries: DataFrame, config: IndexConfig, vector: str, exact: bool) -> DataFrame:
    def read(b: pa.RecordBatch) -> Rows:
        x = matrix(b.column(vector), config.dim)
        if exact:
            return {"qid": b.column("qid").to_numpy(), "q": kernels.checked(x, config)}
        q, length = kernels.prepare(x, config)
        return {"qid": b.column("qid").to_numpy(), "q": q, "length": length}

    return _blocks(queries.select("qid", vector), read, QUERY_BLOCK)


def low_words(keys: pa.Array) -> np.ndarray:
    """DECIMAL(20, 0) keys as unsigned numbers, 0 for null."""
    if not pa.types.is_decimal128(keys.type):
        keys = keys.cast(pa.decimal128(20, 0))
    words = np.frombuffer(keys.buffers()[1], np.uint64)[2 * keys.offset : 2 * (keys.offset + len(keys))]
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), np.uint64(0), words[::2])


def decimals(keys: np.ndarray, known: np.ndarray) -> pa.Array:
    """Unsigned numbers as DECIMAL(20, 0), null where they aren't known."""
    words = np.zeros((len(keys), 2), np.uint64)
    words[:, 0] = keys
    mask = pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(keys), [mask, pa.py_buffer(words.tobytes())])


def slot_blocks(slots: DataFrame, config: IndexConfig, vector: str | None = None, keys: bool = False) -> DataFrame:
    passes = ("", "2") if config.residual else ("",)
    columns = [vector] if vector else [x + p for p in passes for x in ("codes", "scale")]

    def read(b: pa.RecordBatch) -> Rows:
        got: Rows = {"slot": b.column("slot").to_numpy()}
        if keys:
            got |= {"key": low_words(b.column("key")), "known": b.column("key").is_valid().to_numpy(zero_copy_only=False)}
        if vector:
            return got | {"x": matrix(b.column(vector), config.dim)}
        for p in passes:
            codes = b.column("codes" + p)
            flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(codes), config.padded)
            got |= {"codes" + p: flat, "scale" + p: b.column("scale" + p).to_numpy(zero_copy_only=False)}
        if "sig" in b.schema.names:
            got["sig"] = b.column("sig").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(got["slot"]), config.padded)
        return got

    columns += ["key"] if keys else []
    columns += ["sig"] if not vector and "sig" in slots.columns else []
    return _blocks(slots.select("slot", *columns), read, SLOT_BLOCK)


def best(value: np.ndarray, slot: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest values, equal ones by slot."""
    places = np.arange(len(value))
    if k < len(value):
        least = np.partition(value, len(value) - k)[len(value) - k]
        places = np.flatnonzero(value >= least)
    return places[np.lexsort((slot[places], -value[places]))][:k]


def _meet(slots: DataFrame, queries: DataFrame, blocks: DataFrame, score, schema: str) -> DataFrame:
    """Every block of slots with every block (of the queries). score(rows, queries) yields record batches."""
    spark = slots.sparkSession
    q = blocks.withColumnRenamed("block", "queries")
    limit = BROADCAST_BLOCKS * QUERY_BLOCK
    # counted as they come in, so that nothing is encoded for it
    if queries.select("qid").limit(limit + 1).count() <= limit:
        pairs = slots.crossJoin(F.broadcast(q))
    else:
        columns = -(-queries.count() // limit)
        rows = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // columns)
        place = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = slots.withColumn("row", place("block", rows)).withColumn("column", every(columns))
        right = q.withColumn("column", place("queries", columns)).withColumn("row", every(rows))
        pairs = left.join(right, ["row", "column"]).select("block", "queries")

    def run(batches):
        import pickle

        for b in batches:
            for s, t in zip(b.column("block"), b.column("queries")):
                yield from score(pickle.loads(s.as_buffer()), pickle.loads(t.as_buffer()))

    return pairs.mapInArrow(run, schema)


def cut(hits: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return hits.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _parts(n: int, qs: np.ndarray):
    """Queries, as many at a time as share a pass over n rows."""
    size = kernels.together(n)
    for at in range(0, len(qs), size):
        yield qs[at : at + size]


def _scores(rows: Rows, qs: Rows, config: IndexConfig):
    """The scores of all rows for one query after the other."""
    columns = np.ascontiguousarray(kernels.dequantize(rows["codes"], config.bits).T)
    second = np.ascontiguousarray(kernels.dequantize(rows["codes2"], 4).T) if config.residual else None
    for part in _parts(columns.shape[1], qs["q"]):
        s = kernels.column_scores(columns, part, config.bits) * rows["scale"]
        yield from s if second is None else s + kernels.column_scores(second, part, 4) * rows["scale2"]


def _cosines(x: np.ndarray, qs: np.ndarray, dot: bool = False):
    """The exact cosines (or dot products) of all rows for one query after the other."""
    columns = np.ascontiguousarray(x.T)
    length = None if dot else kernels.norms(x)
    for part in _parts(len(x), qs):
        s = kernels.column_sums(columns, part)
        yield from s if dot else s / (length * kernels.norms(part)[:, None])


def _live(slots: DataFrame) -> DataFrame:
    return slots.filter("alive") if "alive" in slots.columns else slots


def search(slots: DataFrame, queries: DataFrame, config: IndexConfig, k: int, vector: str = "embedding", keys: bool = False) -> DataFrame:
    """(qid, rank, slot, score) of the k best live slots of each query; k is at least 1 and ends at the live slots. With keys, also each slot's key.

    slots: slot, codes, scale (and codes2, scale2), perhaps alive. queries: qid and a full-length vector.
    """
    k = max(1, k)

    def score(rows: Rows, qs: Rows):
        out = []
        for i, s in zip(qs["qid"], _scores(rows, qs, config)):
            top = best(s, rows["slot"], k)
            out.append((np.full(len(top), i), rows["slot"][top], s[top], *([rows["key"][top], rows["known"][top]] if keys else [])))
        yield hit_batch(out)

    schema = "qid long, slot long, score float" + (", key decimal(20,0)" if keys else "")
    found = _meet(slot_blocks(_live(slots), config, keys=keys), queries, query_blocks(queries, config, vector, False), score, schema)
    return cut(found, k, F.desc("score"), F.asc("slot")).select("qid", "rank", "slot", "score", *(["key"] if keys else []))


def score_all(slots: DataFrame, queries: DataFrame, config: IndexConfig, vector: str = "embedding") -> DataFrame:
    """(qid, slot, score) of all live slots for a set of queries; as many rows as both have together multiplied."""

    def score(rows: Rows, qs: Rows):
        for i, s in zip(qs["qid"], _scores(rows, qs, config)):
            yield hit_batch([(np.full(len(s), i), rows["slot"], s)])

    return _meet(slot_blocks(_live(slots), config), queries, query_blocks(queries, config, vector, False), score, "qid long, slot long, score float")


def score_errors(slots: DataFrame, queries: DataFrame, config: IndexConfig, vector: str = "embedding") -> DataFrame:
    """One row: n, max_error, mean_error of the scores over codes from exact cosines, for all pairs of a vector and a query; summed in the tasks."""

    def read(b: pa.RecordBatch) -> Rows:
        x = matrix(b.column(vector), config.dim)
        return {"x": x, **kernels.encode(x, config)}

    def asked(b: pa.RecordBatch) -> Rows:
        x = matrix(b.column(vector), config.dim)
        return {"exact": x, "q": kernels.prepare(x, config)[0]}

    def score(rows: Rows, qs: Rows):
        n, most, total = 0, 0.0, 0.0
        for exact, s in zip(_cosines(rows["x"], qs["exact"]), _scores(rows, qs, config)):
            gap = np.abs(s.astype(np.float64) - exact.astype(np.float64))
            n, most, total = n + len(gap), max(most, float(gap.max(initial=0.0))), total + float(gap.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([most]), pa.array([total])], ["n", "most", "total"])

    blocks = _blocks(slots.select(vector), read, SLOT_BLOCK)
    found = _meet(blocks, queries, _blocks(queries.select(vector), asked, QUERY_BLOCK), score, "n long, most double, total double")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("most").alias("max_error"), (F.sum("total") / F.sum("n")).alias("mean_error"))


def hit_batch(out: list[tuple]) -> pa.RecordBatch:
    qid, slot, s, *keys = (np.concatenate(x) for x in zip(*out))
    arrays, names = [pa.array(qid, pa.int64()), pa.array(slot, pa.int64()), pa.array(s, pa.float32())], ["qid", "slot", "score"]
    return pa.RecordBatch.from_arrays([*arrays, decimals(*keys)] if keys else arrays, [*names, "key"] if keys else names)


def exact_search(slots: DataFrame, queries: DataFrame, dim: int, k: int, vector: str = "embedding", dot: bool = False) -> DataFrame:
    """The same over the vectors themselves, by exact cosine or, for vectors of norm one, by dot product."""
    k, config = max(1, k), IndexConfig(dim)

    def score(rows: Rows, qs: Rows):
        out = []
        for i, s in zip(qs["qid"], _cosines(rows["x"], qs["q"], dot)):
            top = best(s, rows["slot"], k)
            out.append((np.full(len(top), i), rows["slot"][top], s[top]))
        yield hit_batch(out)

    found = _meet(slot_blocks(_live(slots), config, vector), queries, query_blocks(queries, config, vector, True), score, "qid long, slot long, score float")
    return cut(found, k, F.desc("score"), F.asc("slot")).select("qid", "rank", "slot", "score")


def search_keyed(slots: DataFrame, queries: DataFrame, config: IndexConfig, k: int, vector: str = "embedding") -> DataFrame:
    """(qid, rank, key, score): the k best slots first, then those with a key, and of each key the best; so there can be fewer than k."""
    hits = search(slots, queries, config, k, vector, keys=True).drop("rank").filter("key IS NOT NULL")
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("qid", "key").orderBy(F.desc("score"), "slot"))).filter("n = 1")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "slot")
    return first.withColumn("rank", F.row_number().over(w)).select("qid", "rank", "key", "score")


def with_signatures(slots: DataFrame) -> DataFrame:
    """slots with a column sig, the two leading bits of each 4-bit code: written with a table, it saves deriving them in each two-stage search."""
    return slots.withColumn("sig", F.transform("codes", lambda c: F.shiftright(c.cast("int"), 2).cast("tinyint")))


def prefilter(slots: DataFrame, queries: DataFrame, config: IndexConfig, r: int, vector: str = "embedding") -> DataFrame:
    """(qid, slot, dist, score) of the r live slots of each query whose two-bit codes are nearest, ties by slot.

    A column sig of slots (see ``with_signatures``) is used; without one, signatures are derived from the codes.
    """
    if config.bits != 4:
        raise ValueError("the two-stage search needs 4 bits")
    r = max(1, r)

    def score(rows: Rows, qs: Rows):
        mine = rows.pop("sig", None)
        mine = (kernels.signature(rows["codes"]) if mine is None else mine).astype(np.int16)
        asked = kernels.query_signature(qs["q"], qs["length"]).astype(np.int16)
        out = []
        for i, q, a in zip(qs["qid"], qs["q"], asked):
            dist = np.abs(mine - a[None, :]).sum(axis=1, dtype=np.int64)
            top = best(-dist, rows["slot"], r)
            part = {c: v[top] for c, v in rows.items()}
            out.append((np.full(len(top), i), part["slot"], dist[top], kernels.scores(part, q, config)))
        qid, slot, dist, s = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(slot, pa.int64()), pa.array(dist, pa.int64()), pa.array(s, pa.float32())], ["qid", "slot", "dist", "score"])

    found = _meet(slot_blocks(_live(slots), config), queries, query_blocks(queries, config, vector, False), score, "qid long, slot long, dist long, score float")
    return cut(found, r, F.asc("dist"), F.asc("slot"), rank="near").select("qid", "near", "slot", "dist", "score")


def search_cascade(slots: DataFrame, queries: DataFrame, config: IndexConfig, k: int, r: int, vector: str = "embedding") -> DataFrame:
    """Two stages: the r nearest by two-bit codes (at least k), rescored in full; with r above the live slots, the same as search."""
    k = max(1, k)
    near = prefilter(slots, queries, config, max(r, k), vector)
    return cut(near, k, F.desc("score"), F.asc("slot")).select("qid", "rank", "slot", "score")
