"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

Slots are vec_id; queries are the rows whose vec_id is divisible by 20, against all rows.
"""

from __future__ import annotations

import functools
import struct
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions import expressions as E
from ..functions import kernels, registered
from ..functions.constants import MAGIC, VERSIONS
from ..operators import keyed, metrics, search
from ..operators.encode import encode, encode_in_sql, matrix
from ..operators.workers import reach
from ..sources import format as fmt
from ..sources import raw
from ..streaming import upsert
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]

DIM = 64
ASKED = "vec_id % 20 = 0"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BITS = {b: IndexConfig(DIM, bits=b) for b in (4, 5, 6)}
RESIDUAL = IndexConfig(DIM, bits=4, residual=True)
WD32, WD48 = IndexConfig(DIM, working_dim=32), IndexConfig(DIM, working_dim=48)
CONFIGS = {"4bit": BITS[4], "5bit": BITS[5], "6bit": BITS[6], "residual": RESIDUAL, "wd32": WD32, "wd48": WD48}


def add(name: str, query: Query, text: str | None = None) -> None:
    QUERIES[name] = query
    if text:
        SQL[name] = text


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def asked(spark: SparkSession, d: str, where: str = ASKED) -> DataFrame:
    return vectors(spark, d).filter(where).select(F.col("vec_id").alias("qid"), "embedding")


def slots(spark: SparkSession, d: str, c: IndexConfig) -> DataFrame:
    return encode(vectors(spark, d), c).withColumnRenamed("vec_id", "slot")


def double(c: str) -> Column:
    return F.col(c).cast("double").alias(c)


def joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def hits(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long").alias("rank"), F.col("slot").alias("vec_id"), double("score"))


HITS = "SELECT qid, rank, vec_id, CAST(score AS DOUBLE) AS score FROM hits"
PAIRS = "SELECT qid, vec_id, CAST(score AS DOUBLE) AS score FROM sc"

# exact search

for name, k, dot in (("exact_cosine_topk", 3, False), ("exact_topk_multi", 10, False), ("exact_dot_topk", 10, True)):
    add(
        name,
        lambda s, d, k=k, dot=dot: hits(search.exact_search(vectors(s, d).withColumnRenamed("vec_id", "slot"), asked(s, d), DIM, k, dot=dot)),
        f"WITH {S.truth(ASKED, k, name='hits', dot_product=dot)} {HITS}",
    )


def pairwise_label_cosine(s: SparkSession, d: str) -> DataFrame:
    """By label of query and row: how many pairs, the least and the largest cosine."""
    q = vectors(s, d).filter(ASKED).select(F.col("label").alias("qlabel"), F.col("embedding").alias("q"))
    c = E.cosine(F.col("embedding"), F.col("q")).cast("double")
    pairs = vectors(s, d).crossJoin(q).select("qlabel", "label", c.alias("c"))  # a stated query set; Spark broadcasts it while it is small
    return pairs.groupBy("qlabel", "label").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))


add(
    "pairwise_label_cosine",
    pairwise_label_cosine,
    f"SELECT q.label AS qlabel, e.label, count(*) AS n, min(CAST({S.cosine('e.embedding', 'q.embedding', DIM)} AS DOUBLE)) AS least,"
    f" max(CAST({S.cosine('e.embedding', 'q.embedding', DIM)} AS DOUBLE)) AS most FROM embeddings e, embeddings q WHERE q.{ASKED} GROUP BY ALL",
)

# rotation

add(
    "vector_norms",
    lambda s, d: vectors(s, d).select("vec_id", E.norm(F.col("embedding")).cast("double").alias("norm")),
    f"SELECT vec_id, CAST({S.norm('embedding')} AS DOUBLE) AS norm FROM embeddings",
)


def spread(df: DataFrame, c: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(c).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


def spread_sql(source: str, c: str) -> str:
    return f"SELECT vec_id, generate_subscripts({c}, 1) - 1 AS pos, CAST(unnest({c}) AS DOUBLE) AS x FROM {source}"


add(
    "normalize",
    lambda s, d: spread(vectors(s, d).select("vec_id", E.normalize(F.col("embedding")).alias("u")), "u"),
    f"WITH n AS (SELECT vec_id, embedding, {S.norm('embedding')} AS nrm FROM embeddings), u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x / nrm AS FLOAT)) AS u FROM n) {spread_sql('u', 'u')}",
)
add(
    "truncate_wd",
    lambda s, d: spread(vectors(s, d).select("vec_id", E.truncate(F.col("embedding"), WD32).alias("t")), "t"),
    spread_sql("(SELECT vec_id, list_slice(embedding, 1, 32) AS t FROM embeddings)", "t"),
)
for name, config in (("rotate_seed42", BITS[5]), ("rotate_wd48_pad64", WD48)):
    add(name, lambda s, d, c=config: spread(E.rotated(vectors(s, d), c), "rotated"), f"WITH {S.rotated(config)} {spread_sql('rot', 'w')}")
add(
    "rotation_norm_scale",
    lambda s, d: E.rotated(vectors(s, d), BITS[5]).select("vec_id", E.norm(F.col("rotated")).cast("double").alias("norm")),
    f"WITH {S.rotated(BITS[5])} SELECT vec_id, CAST({S.norm('w')} AS DOUBLE) AS norm FROM rot",
)

# codes

for b, config in BITS.items():
    codes_sql = "list_aggregate(list_transform(codes, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')"
    add(
        f"quantize_{b}bit",
        lambda s, d, c=config: encode_in_sql(vectors(s, d), c).select("vec_id", joined("codes")),
        f"WITH {S.encoded(config)} SELECT vec_id, {codes_sql} AS codes FROM enc",
    )
    add(
        f"encode_scale_{b}bit",
        lambda s, d, c=config: encode(vectors(s, d), c).select("vec_id", double("scale")),
        f"WITH {S.encoded(config)} SELECT vec_id, CAST(scale AS DOUBLE) AS scale FROM enc",
    )
    add(
        f"score_all_{b}bit",
        lambda s, d, c=config: score_all(s, d, c),
        f"WITH {S.scored(config, ASKED)} {PAIRS}",
    )


def code_histogram(s: SparkSession, d: str) -> DataFrame:
    parts = [encode(vectors(s, d), c).select(F.lit(b).alias("bits"), F.explode(F.transform("codes", lambda x: x.cast("int"))).alias("code")) for b, c in BITS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("bits", "code").agg(F.count(F.lit(1)).alias("n"))


add(
    "code_histogram",
    code_histogram,
    "WITH "
    + ",\n".join(S.encoded(c, f"e{b}") for b, c in BITS.items())
    + " SELECT bits, CAST(code AS INTEGER) AS code, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT {b} AS bits, unnest(codes) AS code FROM e{b}" for b in BITS)
    + ") GROUP BY ALL",
)


def score_all(s: SparkSession, d: str, c: IndexConfig) -> DataFrame:
    """Every row against every query."""
    return search.score_all(slots(s, d, c), asked(s, d), c).select("qid", F.col("slot").alias("vec_id"), double("score"))


add(
    "encode_residual",
    lambda s, d: encode(vectors(s, d), RESIDUAL).select("vec_id", joined("codes"), joined("codes2"), double("scale"), double("scale2")),
    f"WITH {S.encoded(RESIDUAL)} SELECT vec_id, list_aggregate(list_transform(codes, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS codes,"
    " list_aggregate(list_transform(codes2, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS codes2, CAST(scale AS DOUBLE) AS scale, CAST(scale2 AS DOUBLE) AS scale2 FROM enc",
)
add("score_residual", lambda s, d: score_all(s, d, RESIDUAL), f"WITH {S.scored(RESIDUAL, ASKED)} {PAIRS}")


def score_in_sql(s: SparkSession, d: str) -> DataFrame:
    """The scores of pairs (a row and the query of the twentieth before it), in expressions that Catalyst sees."""
    c = RESIDUAL
    q = E.rotated(vectors(s, d).filter(ASKED).select(F.col("vec_id").alias("qid"), "embedding"), c)
    q = q.withColumn("rn", E.norm(F.col("rotated"))).select("qid", F.transform("rotated", lambda x: E.f32(x / F.col("rn"))).alias("q"))
    own = encode_in_sql(vectors(s, d), c).withColumn("qid", F.col("vec_id") - F.col("vec_id") % 20)
    return own.join(q, "qid").select("vec_id", E.score(c, F.col("q")).cast("double").alias("score"))


add("score_in_sql", score_in_sql, f"WITH {S.scored(RESIDUAL, ASKED)} SELECT vec_id, CAST(score AS DOUBLE) AS score FROM sc WHERE qid = vec_id - vec_id % 20")


def functions_in_sql(s: SparkSession, d: str) -> DataFrame:
    """The same, the exact cosine and the distance of signatures through the registered functions."""
    registered.register(s, BITS[4])
    named = {"x": vectors(s, d), "y": vectors(s, d).filter(ASKED)}
    return s.sql(
        "WITH e AS (SELECT vec_id, embedding, vq_encode(embedding) AS c, vq_rotate(embedding) AS r FROM {x}),"
        " q AS (SELECT vec_id AS qid, embedding AS qe, vq_prepare(embedding) AS q, vq_signature(vq_quantize(vq_rotate(embedding))) AS qs FROM {y})"
        " SELECT vec_id, CAST(vq_score(c, q) AS DOUBLE) AS score, CAST(vq_cosine(embedding, qe) AS DOUBLE) AS cosine, vq_l1_2bit(vq_signature(c.codes), qs) AS dist,"
        " CAST(r[3] AS DOUBLE) AS third FROM e JOIN q ON qid = vec_id - vec_id % 20",
        **named,
    )


add(
    "functions_in_sql",
    functions_in_sql,
    f"WITH {S.scored(BITS[4], ASKED)}, own AS (SELECT vec_id AS qid, embedding AS qe, codes AS qc FROM enc)"
    f" SELECT sc.vec_id, CAST(score AS DOUBLE) AS score, CAST({S.cosine('embedding', 'qe', DIM)} AS DOUBLE) AS cosine,"
    f" CAST(list_sum(list_transform(range({DIM}), lambda i: abs(codes[i + 1] // 4 - qc[i + 1] // 4))) AS BIGINT) AS dist, CAST(w[4] AS DOUBLE) AS third"
    " FROM sc JOIN enc ON enc.vec_id = sc.vec_id JOIN own ON own.qid = sc.qid WHERE sc.qid = sc.vec_id - sc.vec_id % 20",
)

# search

for name, key, k in (("search_topk_4bit", "4bit", 10), ("search_topk_5bit", "5bit", 10), ("search_topk_6bit", "6bit", 10), ("search_residual", "residual", 10), ("search_wd32", "wd32", 10), ("search_multi", "wd48", 100)):
    add(
        name,
        lambda s, d, c=CONFIGS[key], k=k: hits(search.search(slots(s, d, c), asked(s, d), c, k)),
        f"WITH {S.scored(CONFIGS[key], ASKED)},\n{S.ranked(k=k)} {HITS}",
    )
add(
    "search_skips_tombstones",
    lambda s, d: hits(search.search(slots(s, d, BITS[5]).withColumn("alive", F.col("slot") % 7 != 0), asked(s, d), BITS[5], 10)),
    f"WITH {S.scored(BITS[5], ASKED, live='vec_id % 7 <> 0')},\n{S.ranked()} {HITS}",
)
for name, spark_key, duck_key in (("search_keyed", "CAST(slot AS DECIMAL(20, 0))", "vec_id"), ("search_keyed_multi", "CASE WHEN slot % 5 > 0 THEN CAST(slot DIV 4 AS DECIMAL(20, 0)) END", "CASE WHEN vec_id % 5 > 0 THEN vec_id // 4 END")):
    add(
        name,
        lambda s, d, e=spark_key: search.search_keyed(slots(s, d, BITS[5]).withColumn("key", F.expr(e)), asked(s, d), BITS[5], 10).select("qid", F.col("rank").cast("long").alias("rank"), F.col("key").cast("long").alias("key"), double("score")),
        f"WITH {S.scored(BITS[5], ASKED)},\n{S.ranked()}, named AS (SELECT qid, {duck_key} AS key, score, vec_id FROM hits),"
        " first AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY score DESC, vec_id) AS n FROM named WHERE key IS NOT NULL)"
        " SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank, key, CAST(score AS DOUBLE) AS score FROM first WHERE n = 1",
    )

# two stages

add(
    "signature_2bit",
    lambda s, d: encode_in_sql(vectors(s, d), BITS[4]).select("vec_id", E.signature(F.col("codes")).alias("sig")).select("vec_id", joined("sig")),
    f"WITH {S.encoded(BITS[4])} SELECT vec_id, list_aggregate(list_transform(codes, lambda x: CAST(x // 4 AS VARCHAR)), 'string_agg', ',') AS sig FROM enc",
)


def near(c: IndexConfig, r: int, live: str = "true", extra: str = "") -> str:
    """CTEs up to ``near``: the r nearest live rows of each query by two-bit codes."""
    return (
        f"{S.encoded(c)},\n{S.prepared(c, ASKED)},\n"
        f"qs AS (SELECT *, list_transform({S.quantized('list_transform(q, lambda x: CAST(x * rn AS FLOAT))', 4)}, lambda k: k // 4) AS sig FROM qry),"
        f" dist AS (SELECT enc.*, qid, q, list_sum(list_transform(range({c.padded}), lambda i: abs(sig[i + 1] - codes[i + 1] // 4))) AS dist{extra} FROM enc, qs WHERE {live}),"
        f" near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS near FROM dist) WHERE near <= {r})"
    )


def cascade_sql(c: IndexConfig, r: int, live: str = "true") -> str:
    return f"WITH {near(c, r, live)}, sc AS (SELECT qid, vec_id, {S.score(c)} AS score FROM near),\n{S.ranked()} {HITS}"


add(
    "cascade_prefilter",
    lambda s, d: search.prefilter(slots(s, d, BITS[4]), asked(s, d), BITS[4], 50).select("qid", F.col("near").cast("long").alias("near"), F.col("slot").alias("vec_id"), "dist"),
    f"WITH {near(BITS[4], 50)} SELECT qid, near, vec_id, CAST(dist AS BIGINT) AS dist FROM near",
)
WD48_4 = IndexConfig(DIM, working_dim=48, bits=4)
for name, config, r in (("cascade_search", BITS[4], 50), ("cascade_r10", BITS[4], 10), ("cascade_r100", BITS[4], 100), ("cascade_residual", RESIDUAL, 50), ("cascade_wd48", WD48_4, 50)):
    add(name, lambda s, d, c=config, r=r: hits(search.search_cascade(slots(s, d, c), asked(s, d), c, 10, r)), cascade_sql(config, r))
add(
    "cascade_stored_signatures",
    lambda s, d: hits(search.search_cascade(search.with_signatures(slots(s, d, BITS[4])), asked(s, d), BITS[4], 10, 50)),
    cascade_sql(BITS[4], 50),
)
add(
    "cascade_skips_tombstones",
    lambda s, d: hits(search.search_cascade(slots(s, d, BITS[4]).withColumn("alive", F.col("slot") % 7 != 0), asked(s, d), BITS[4], 10, 50)),
    cascade_sql(BITS[4], 50, "vec_id % 7 <> 0"),
)


def cascade_after_compact(s: SparkSession, d: str) -> DataFrame:
    """The same hits by new slots: the rows without every seventh, numbered anew."""
    table = keyed.table_of(encode(vectors(s, d).select("vec_id", "embedding"), BITS[4]), "vec_id", F.col("slot"))
    table = keyed.compact(keyed.remove_keyed(table, vectors(s, d).filter(GONE).select(F.col("vec_id").alias("key"))))
    return hits(search.search_cascade(table, asked(s, d), BITS[4], 10, 50))


add(
    "cascade_after_compact",
    cascade_after_compact,
    f"WITH {near(BITS[4], 50, 'vec_id % 7 <> 0')}, sc AS (SELECT qid, vec_id, {S.score(BITS[4])} AS score FROM near),\n{S.ranked()},"
    " anew AS (SELECT vec_id AS old, row_number() OVER (ORDER BY vec_id) - 1 AS slot FROM embeddings WHERE vec_id % 7 <> 0)"
    " SELECT qid, rank, slot AS vec_id, CAST(score AS DOUBLE) AS score FROM hits JOIN anew ON old = vec_id",
)
add(
    "cascade_full_r",
    lambda s, d: hits(search.search_cascade(slots(s, d, BITS[4]), asked(s, d), BITS[4], 10, vectors(s, d).count())),
    f"WITH {S.scored(BITS[4], ASKED)},\n{S.ranked()} {HITS}",
)

# keyed changes: the payload is the label


def base(s: SparkSession, d: str, key: str | None = "CAST(vec_id AS DECIMAL(20, 0))") -> DataFrame:
    return keyed.table_of(vectors(s, d).select("vec_id", F.col("label").cast("long").alias("val")), "vec_id", F.expr(key) if key else None)


def changes(s: SparkSession, d: str, key: str) -> DataFrame:
    return vectors(s, d).select(F.col("vec_id").alias("seq"), F.expr(key).alias("key"), (F.col("label") + 1000).cast("long").alias("val"))


def shown(df: DataFrame) -> DataFrame:
    return df.select("slot", F.col("key").cast("long").alias("key"), "key_pos", "alive", "val")


UPSERT_KEY = "vec_id * 7 % 1201"
add(
    "upsert_keyed",
    lambda s, d: shown(keyed.add_keyed(base(s, d), changes(s, d, UPSERT_KEY))),
    f"WITH b AS (SELECT vec_id AS seq, {UPSERT_KEY} AS key, CAST(label + 1000 AS BIGINT) AS val FROM embeddings),"
    " l AS (SELECT key, arg_max(val, seq) AS val, min(seq) AS seq FROM b GROUP BY key),"
    " n AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM l WHERE key NOT IN (SELECT vec_id FROM embeddings))"
    " SELECT e.vec_id AS slot, e.vec_id AS key, CAST(0 AS BIGINT) AS key_pos, true AS alive, coalesce(l.val, CAST(e.label AS BIGINT)) AS val FROM embeddings e LEFT JOIN l ON l.key = e.vec_id"
    " UNION ALL SELECT (SELECT max(vec_id) + 1 FROM embeddings) + i, key, 0, true, val FROM n",
)
add(
    "multi_add",
    lambda s, d: shown(keyed.add_keyed_multi(base(s, d), changes(s, d, "vec_id % 10"))),
    "SELECT vec_id AS slot, vec_id AS key, CAST(0 AS BIGINT) AS key_pos, true AS alive, CAST(label AS BIGINT) AS val FROM embeddings UNION ALL"
    " SELECT (SELECT max(vec_id) + 1 FROM embeddings) + row_number() OVER (ORDER BY vec_id) - 1, vec_id % 10, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id), true, label + 1000 FROM embeddings",
)
add(
    "append_anonymous",
    lambda s, d: shown(keyed.add(base(s, d), changes(s, d, "vec_id").drop("key"))),
    "SELECT vec_id AS slot, vec_id AS key, CAST(0 AS BIGINT) AS key_pos, true AS alive, CAST(label AS BIGINT) AS val FROM embeddings UNION ALL"
    " SELECT (SELECT max(vec_id) + 1 FROM embeddings) + row_number() OVER (ORDER BY vec_id) - 1, NULL, NULL, true, label + 1000 FROM embeddings",
)
TABLE = "SELECT vec_id AS slot, {key} AS key, {pos} AS key_pos, {alive} AS alive, CAST(label AS BIGINT) AS val FROM embeddings"


def relabelled(s: SparkSession, d: str) -> DataFrame:
    df, verdict = keyed.relabel(base(s, d), 3, 9_999_999)
    df, taken = keyed.relabel(df, 4, 5)
    return shown(df).crossJoin(F.broadcast(verdict.withColumnRenamed("done", "renamed"))).crossJoin(F.broadcast(taken.withColumnRenamed("done", "taken")))


add("relabel", relabelled, "SELECT t.*, true AS renamed, false AS taken FROM (" + TABLE.format(key="CASE WHEN vec_id = 3 THEN 9999999 ELSE vec_id END", pos="CAST(0 AS BIGINT)", alive="true") + ") t")
GONE = "vec_id % 7 = 0"


def removed(s: SparkSession, d: str, key: str = "CAST(vec_id AS DECIMAL(20, 0))") -> DataFrame:
    return keyed.remove_keyed(base(s, d, key), vectors(s, d).filter(GONE).select(F.col("vec_id").alias("key")))


add("remove_key", lambda s, d: shown(removed(s, d)), TABLE.format(key=f"CASE WHEN NOT ({GONE}) THEN vec_id END", pos=f"CASE WHEN NOT ({GONE}) THEN CAST(0 AS BIGINT) END", alive=f"NOT ({GONE})"))
add(
    "remove_key_at",
    lambda s, d: shown(keyed.remove_keyed_at(base(s, d, "CAST(vec_id DIV 4 AS DECIMAL(20, 0))"), 2, 8)),
    TABLE.format(key="CASE WHEN vec_id <> 8 THEN vec_id // 4 END", pos="CASE WHEN vec_id = 11 THEN 0 WHEN vec_id <> 8 THEN vec_id % 4 END", alive="vec_id <> 8"),
)
add(
    "compact",
    lambda s, d: shown(keyed.compact(keyed.remove_keyed_at(removed(s, d, "CAST(vec_id DIV 4 AS DECIMAL(20, 0))"), 2, 8))),
    "WITH l AS (SELECT * FROM embeddings WHERE NOT ((vec_id // 4) % 7 = 0 AND vec_id // 4 IN (SELECT vec_id FROM embeddings)) AND vec_id <> 8)"
    " SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, vec_id // 4 AS key, row_number() OVER (PARTITION BY vec_id // 4 ORDER BY vec_id) - 1 AS key_pos, true AS alive, CAST(label AS BIGINT) AS val FROM l",
)
add(
    "index_stats",
    lambda s, d: keyed.stats(removed(s, d)),
    f"SELECT count(*) AS n_slots, count(*) FILTER (WHERE NOT ({GONE})) AS n_live, count(*) FILTER (WHERE {GONE}) AS n_tombstones, count(*) FILTER (WHERE NOT ({GONE})) AS n_keys FROM embeddings",
)
add(
    "contains_key",
    lambda s, d: keyed.contains_key(removed(s, d), vectors(s, d).select((F.col("vec_id") * 2).alias("key"))).select(F.col("key").cast("long").alias("key"), "found"),
    f"SELECT vec_id * 2 AS key, vec_id * 2 IN (SELECT vec_id FROM embeddings WHERE NOT ({GONE})) AS found FROM embeddings",
)
add(
    "key_of",
    lambda s, d: keyed.key_of(removed(s, d), vectors(s, d).select((F.col("vec_id") * 3).alias("slot"))).select("slot", F.col("key").cast("long").alias("key")),
    "SELECT vec_id * 3 AS slot, CASE WHEN vec_id * 3 % 7 <> 0 AND vec_id * 3 IN (SELECT vec_id FROM embeddings) THEN vec_id * 3 END AS key FROM embeddings",
)

# files


def halves(df: DataFrame, c: str = "scale") -> DataFrame:
    """Through half precision and back, by bits of the float: ten fraction bits, ties to even."""
    x = F.col(c).cast("double")
    e = F.pow(F.lit(2.0), 10 - F.floor(F.log2(x)))
    return df.withColumn(c, (F.rint(x * e) / e).cast("float"))


add("f16_scale_roundtrip", lambda s, d: halves(encode(vectors(s, d), BITS[5])).select("vec_id", double("scale")), f"WITH {S.encoded(BITS[5])} SELECT vec_id, CAST({S.half('scale')} AS DOUBLE) AS scale FROM enc")


def blobs(s: SparkSession, d: str, c: IndexConfig, rows: int = fmt.SHARD_ROWS) -> DataFrame:
    return fmt.to_blobs(slots(s, d, c).withColumn("key", F.col("slot")), c, rows)


def persisted_vs_memory_delta(s: SparkSession, d: str) -> DataFrame:
    c = BITS[5]
    a = hits(search.search(slots(s, d, c), asked(s, d), c, 10)).alias("a")
    b = hits(search.search(halves(slots(s, d, c)), asked(s, d), c, 10)).alias("b")
    both = a.join(b, ["qid", "rank"])
    same = F.col("a.vec_id") == F.col("b.vec_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum((~same).cast("long")).alias("n_other"), F.max(F.when(same, F.abs(F.col("a.score") - F.col("b.score")))).alias("max_delta"))


add(
    "persisted_vs_memory_delta",
    persisted_vs_memory_delta,
    f"WITH {S.scored(BITS[5], ASKED)},\n{S.ranked(name='ha')},\nsb AS (SELECT qid, vec_id, {S.score(BITS[5], S.half('scale'))} AS score FROM enc, qry),\n{S.ranked('sb', name='hb')}"
    " SELECT count(*) AS n, CAST(count(*) FILTER (WHERE a.vec_id <> b.vec_id) AS BIGINT) AS n_other, max(abs(CAST(a.score AS DOUBLE) - CAST(b.score AS DOUBLE))) FILTER (WHERE a.vec_id = b.vec_id) AS max_delta"
    " FROM ha a JOIN hb b USING (qid, rank)",
)
FILES = {"1.3": BITS[4], "1.4": RESIDUAL, "1.5": BITS[5], "1.5, 6 bits": BITS[6], "1.5, working_dim 48": WD48}


def serialize_bytes(s: SparkSession, d: str) -> DataFrame:
    """Size and digest of the files of 200 rows each, in all versions that are written."""
    made = [blobs(s, d, c, 200).select(F.lit(m).alias("mode"), "shard", F.length("blob").cast("long").alias("n_bytes"), F.sha2("blob", 256).alias("sha256")) for m, c in FILES.items()]
    return functools.reduce(DataFrame.unionByName, made)


add("serialize_bytes", serialize_bytes, " UNION ALL ".join(S.serialized(c, VERSIONS[m[:3]], 200, m) for m, c in FILES.items()))


def replaced_blobs(s: SparkSession, d: str) -> DataFrame:
    """A table of shards of which every second one is replaced, and one added."""
    new = blobs(s, d, BITS[6], 200).filter("shard % 2 = 0")
    more = blobs(s, d, BITS[4], 1 << 40).withColumn("shard", F.lit(-1).cast("long"))
    table = fmt.upsert_blobs(blobs(s, d, BITS[5], 200), new.unionByName(more))
    return fmt.from_blobs(table).select("shard", F.col("key").cast("long").alias("key"), joined("codes"), double("scale"))


TEXT = "list_aggregate(list_transform(codes, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')"
add(
    "replaced_blobs",
    replaced_blobs,
    f"WITH {S.encoded(BITS[4], 'e4')},\n{S.encoded(BITS[5], 'e5')},\n{S.encoded(BITS[6], 'e6')}"
    f" SELECT vec_id // 200 AS shard, vec_id AS key, {TEXT} AS codes, CAST({S.half('scale')} AS DOUBLE) AS scale FROM e5 WHERE vec_id // 200 % 2 <> 0"
    f" UNION ALL SELECT vec_id // 200, vec_id, {TEXT}, CAST({S.half('scale')} AS DOUBLE) FROM e6 WHERE vec_id // 200 % 2 = 0"
    f" UNION ALL SELECT -1, vec_id, {TEXT}, CAST({S.half('scale')} AS DOUBLE) FROM e4",
)


def raw_matrix(s: SparkSession, d: str) -> DataFrame:
    """Vectors as raw files of 150 rows, and read back."""
    files = raw.to_f32(vectors(s, d).select(F.floor(F.col("vec_id") / 150).cast("long").alias("path"), F.col("vec_id").alias("slot"), "embedding"))
    return raw.parse_f32(files, DIM).select(F.col("path").alias("file"), "slot", F.posexplode("embedding").alias("pos", "x")).select("file", "slot", F.col("pos").cast("long").alias("pos"), double("x"))


add(
    "raw_matrix",
    raw_matrix,
    "WITH n AS (SELECT *, vec_id // 150 AS file, row_number() OVER (PARTITION BY vec_id // 150 ORDER BY vec_id) - 1 AS slot FROM embeddings)"
    " SELECT file, slot, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM n",
)
add(
    "metadata",
    lambda s, d: raw.parse_meta(
        vectors(s, d).agg(F.count(F.lit(1)).alias("n_base"), F.count_if(F.expr(ASKED)).alias("n_query"), F.max(F.size("embedding")).alias("dim")).select(
            F.to_json(F.struct("*", F.lit(42).alias("base_seed"), F.lit(1 << 40).alias("query_seed"))).alias("value")
        )
    ),
    f"SELECT CAST(count(*) AS INTEGER) AS n_base, CAST(count(*) FILTER (WHERE {ASKED}) AS INTEGER) AS n_query, CAST(max(len(embedding)) AS INTEGER) AS dim,"
    f" CAST(42 AS BIGINT) AS base_seed, CAST({1 << 40} AS BIGINT) AS query_seed FROM embeddings",
)
add(
    "serialized_size",
    lambda s, d: blobs(s, d, BITS[5], 200).select("shard", F.length("blob").cast("long").alias("n_bytes")),
    f"SELECT vec_id // 200 AS shard, 25 + count(*) * ({BITS[5].code_bytes} + 2) + 4 + count(*) * 12 AS n_bytes FROM embeddings GROUP BY ALL",
)
for name, config in (("parse_bytes", BITS[5]), ("parse_bytes_residual", RESIDUAL)):
    more = ", CAST({0} AS DOUBLE) AS scale2".format(S.half("scale2")) if config.residual else ""
    add(
        name,
        lambda s, d, c=config: fmt.table_slots(blobs(s, d, c)).select("slot", F.col("key").cast("long").alias("key"), joined("codes"), double("scale"), *([double("scale2")] if c.residual else [])),
        f"WITH {S.encoded(config)} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, vec_id AS key, list_aggregate(list_transform(codes, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS codes,"
        f" CAST({S.half('scale')} AS DOUBLE) AS scale{more} FROM enc",
    )


def view_and_load(s: SparkSession, d: str) -> DataFrame:
    """Hits of the keyless reader beside those of the full one; their scores must have the same bits."""
    a, b = (hits(search.search(fmt.from_blobs(blobs(s, d, RESIDUAL), view=v), asked(s, d), RESIDUAL, 10)) for v in (True, False))
    both = a.withColumnRenamed("score", "viewed").join(b.withColumnRenamed("score", "loaded"), ["qid", "rank", "vec_id"], "full")
    return both.withColumn("same", F.coalesce(F.col("viewed") == F.col("loaded"), F.lit(False)))


add(
    "view_and_load",
    view_and_load,
    f"WITH {S.encoded(RESIDUAL)},\n{S.prepared(RESIDUAL, ASKED)},\nhalved AS (SELECT vec_id, codes, codes2, {S.half('scale')} AS scale, {S.half('scale2')} AS scale2 FROM enc),"
    f" sc AS (SELECT qid, vec_id, {S.score(RESIDUAL)} AS score FROM halved, qry),\n{S.ranked()}"
    " SELECT qid, rank, vec_id, CAST(score AS DOUBLE) AS viewed, CAST(score AS DOUBLE) AS loaded, true AS same FROM hits",
)
add(
    "view_search",
    lambda s, d: hits(search.search(fmt.from_blobs(blobs(s, d, BITS[5]), view=True), asked(s, d), BITS[5], 10)),
    f"WITH {S.scored(BITS[5], ASKED, S.half('scale'))},\n{S.ranked()} {HITS}",
)


def legacy_v1_read(s: SparkSession, d: str) -> DataFrame:
    """A version 1 file (float32 scales, no key table), written by hand and read back."""
    reach(s)
    c = BITS[4]

    def write(part: pa.Table) -> pa.Table:
        b = part.sort_by("slot").combine_chunks().to_batches()[0]
        data = struct.pack("<4sHHIQI", MAGIC, VERSIONS["1"], 0, c.dim, c.seed, b.num_rows) + b.column("scale").to_numpy().astype("<f4").tobytes()
        data += kernels.pack(matrix(b.column("codes"), c.padded).astype("uint8"), 4).tobytes()
        return pa.table({"shard": pa.array([b.column("shard")[0].as_py()], pa.int64()), "blob": pa.array([data], pa.binary())})

    made = slots(s, d, c).select(F.floor(F.col("slot") / fmt.SHARD_ROWS).alias("shard"), "slot", "codes", "scale").groupBy("shard").applyInArrow(write, "shard long, blob binary")
    return fmt.table_slots(made).select("slot", joined("codes"), double("scale"))


add(
    "legacy_v1_read",
    legacy_v1_read,
    f"WITH {S.encoded(BITS[4])} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, list_aggregate(list_transform(codes, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS codes, CAST(scale AS DOUBLE) AS scale FROM enc",
)

# streams and generators


def streamed_upsert(s: SparkSession, d: str) -> DataFrame:
    """The vectors as a stream of keyed changes, and the table that comes of it."""
    home = s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparvec-")
    home = f"{home}/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(vectors(s, d).schema).parquet(f"{d}/embeddings.parque[t]")
    changed = stream.select(F.col("vec_id").alias("seq"), F.expr("vec_id * 7 % 97").alias("key"), "embedding")
    upsert.upsert_stream(changed, BITS[5], f"{home}/index", f"{home}/progress").awaitTermination()
    return upsert.latest(s, f"{home}/index").select("slot", F.col("key").cast("long").alias("key"), "alive", joined("codes"), double("scale"))


add(
    "streamed_upsert",
    streamed_upsert,
    f"WITH {S.encoded(BITS[5])}, l AS (SELECT vec_id * 7 % 97 AS key, max(vec_id) AS newest, min(vec_id) AS oldest FROM embeddings GROUP BY ALL)"
    f" SELECT row_number() OVER (ORDER BY oldest) - 1 AS slot, key, true AS alive, {TEXT} AS codes, CAST(scale AS DOUBLE) AS scale FROM l JOIN enc ON vec_id = newest",
)


def generated(s: SparkSession, d: str) -> DataFrame:
    """Of seeded vectors around eight centres: how many each has, their norms, and whether another run gives the same."""
    made = [raw.clustered(s, 1000, DIM, 8, 5, 0.3) for _ in range(2)]
    both = made[0].join(made[1].select("slot", F.col("embedding").alias("again")), "slot")
    per = both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.round(f(E.norm(F.col("embedding"))).cast("double"), 5).alias(c) for c, f in (("least", F.min), ("most", F.max))), F.bool_and(F.col("embedding") == F.col("again")).alias("same"))
    return per.withColumn("label", F.col("label").cast("long"))


add("generated", generated, "SELECT i % 8 AS label, count(*) AS n, CAST(1 AS DOUBLE) AS least, CAST(1 AS DOUBLE) AS most, true AS same FROM range(1000) r(i) GROUP BY ALL")

# measures


def truth(s: SparkSession, d: str, k: int) -> DataFrame:
    return search.exact_search(vectors(s, d).withColumnRenamed("vec_id", "slot"), asked(s, d), DIM, k)


def recall_of(s: SparkSession, d: str, c: IndexConfig) -> DataFrame:
    got = metrics.recall(search.search(slots(s, d, c), asked(s, d), c, 10), truth(s, d, 10), 10)
    return got.select("n_queries", F.round("recall_at_1", 9).alias("recall_at_1"), F.round("recall_at_k", 9).alias("recall_at_10"))


def recall_sql(c: IndexConfig, tag: str = "") -> str:
    return (
        f"SELECT {tag} count(*) AS n_queries, round(avg(one), 9) AS recall_at_1, round(avg(k), 9) AS recall_at_10 FROM"
        " (SELECT t.qid, max(CASE WHEN t.rank = 1 AND h.rank = 1 THEN 1 ELSE 0 END) AS one, count(h.rank) / count(*) AS k FROM truth t LEFT JOIN hits h ON h.qid = t.qid AND h.vec_id = t.vec_id GROUP BY t.qid)"
    )


add("recall_at_1_10", lambda s, d: recall_of(s, d, BITS[5]), f"WITH {S.scored(BITS[5], ASKED)},\n{S.ranked()},\n{S.truth(ASKED, 10)} {recall_sql(BITS[5])}")
WIDTHS = {"4bit": BITS[4], "5bit": BITS[5], "6bit": BITS[6], "residual": RESIDUAL}


def width_sweep(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, c in WIDTHS.items():
        one = recall_of(s, d, c).select(F.lit(name).alias("mode"), F.lit(c.bytes_per_vector).alias("bytes_per_vector"), "n_queries", "recall_at_1", "recall_at_10")
        out = one if out is None else out.unionByName(one)
    return out


add(
    "width_sweep",
    width_sweep,
    " UNION ALL ".join(f"SELECT * FROM (WITH {S.scored(c, ASKED)},\n{S.ranked()},\n{S.truth(ASKED, 10)} {recall_sql(c, f"'{n}' AS mode, {c.bytes_per_vector} AS bytes_per_vector,")})" for n, c in WIDTHS.items()),
)


def score_error(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, c in WIDTHS.items():
        one = search.score_errors(vectors(s, d), asked(s, d), c)
        one = one.select(F.lit(name).alias("mode"), "n", "max_error", F.round("mean_error", 9).alias("mean_error"))
        out = one if out is None else out.unionByName(one)
    return out


add(
    "score_error",
    score_error,
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {S.scored(c, ASKED)},\n{S.truth(ASKED, 1)} SELECT '{n}' AS mode, count(*) AS n, max(abs(CAST(a.score AS DOUBLE) - CAST(b.score AS DOUBLE))) AS max_error,"
        " round(avg(abs(CAST(a.score AS DOUBLE) - CAST(b.score AS DOUBLE))), 9) AS mean_error FROM sc a JOIN ts b USING (qid, vec_id))"
        for n, c in WIDTHS.items()
    ),
)


def reconstruction_mse(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, c in (("4bit", BITS[4]), ("5bit", BITS[5]), ("residual", RESIDUAL)):
        r = E.rotated(vectors(s, d), c).select("vec_id", "rotated").join(encode_in_sql(vectors(s, d), c), "vec_id")
        one = metrics.reconstruction_error(r, c).select(F.lit(name).alias("mode"), "n", F.round("mse", 9).alias("mse"))
        out = one if out is None else out.unionByName(one)
    return out


def mse_sql(n: str, c: IndexConfig) -> str:
    part = f"CAST(({S.floats(S.CENTROIDS[c.bits])})[codes[i + 1] + 1] AS DOUBLE) * CAST(scale AS DOUBLE) * 8"
    if c.residual:
        part += f" + CAST(({S.floats(S.CENTROIDS[4])})[codes2[i + 1] + 1] AS DOUBLE) * CAST(scale2 AS DOUBLE) * 8"
    return f"SELECT * FROM (WITH {S.encoded(c)} SELECT '{n}' AS mode, count(*) AS n, round(avg(list_sum(list_transform(range({DIM}), lambda i: pow({part} - CAST(w[i + 1] AS DOUBLE), 2))) / {DIM}), 9) AS mse FROM enc)"


add("reconstruction_mse", reconstruction_mse, " UNION ALL ".join(mse_sql(n, c) for n, c in (("4bit", BITS[4]), ("5bit", BITS[5]), ("residual", RESIDUAL))))
add(
    "storage_ratio",
    lambda s, d: metrics.storage(vectors(s, d), BITS[5]),
    f"SELECT count(*) * {4 * DIM} AS raw_bytes, count(*) * {BITS[5].bytes_per_vector} AS code_bytes, CAST({4 * DIM / BITS[5].bytes_per_vector!r} AS DOUBLE) AS ratio FROM embeddings",
)


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query: encode all vectors, ask with every twentieth, and return the ten best of each."""
    return QUERIES["search_topk_5bit"](spark, d)
