"""The quantiser in DuckDB SQL, with the same order of single-precision operations; what the queries are checked against."""

from __future__ import annotations

from ..config import IndexConfig
from ..functions.constants import BOUNDARIES, CENTROIDS, FLOOR
from ..functions.kernels import sign_stream


def floats(values) -> str:
    return "CAST([" + ", ".join(repr(float(v)) for v in values) + "] AS FLOAT[])"


def total(terms: str) -> str:
    return f"list_reduce({terms}, lambda a, b: a + b)"


def root(x: str) -> str:
    return f"CAST(sqrt(CAST({x} AS DOUBLE)) AS FLOAT)"


def norm(v: str) -> str:
    return root(total(f"list_transform({v}, lambda x: x * x)"))


def dot(a: str, b: str, n: int) -> str:
    return total(f"list_transform(range({n}), lambda i: {a}[i + 1] * {b}[i + 1])")


def cosine(a: str, b: str, n: int) -> str:
    return f"CAST({dot(a, b, n)} / CAST({norm(a)} * {norm(b)} AS FLOAT) AS FLOAT)"


def quantized(x: str, bits: int) -> str:
    return f"list_transform({x}, lambda x: len(list_filter({floats(BOUNDARIES[bits])}, lambda b: x > b)))"


def decoded(codes: str, bits: int) -> str:
    return f"list_transform({codes}, lambda k: ({floats(CENTROIDS[bits])})[k + 1])"


def rotated(c: IndexConfig, name: str = "rot", source: str = "embeddings") -> str:
    """CTEs up to ``name`` (vec_id, label, embedding, w)."""
    p, wd = c.padded, c.working_dim
    out = [
        f"{name}_t AS (SELECT *, list_slice(embedding, 1, {wd}) AS v FROM {source})",
        f"{name}_n AS (SELECT *, {norm('v')} AS nrm FROM {name}_t)",
        f"{name}_0 AS (SELECT * EXCLUDE (v, nrm), list_transform(range({p}), lambda i: CAST(CASE WHEN i < {wd} THEN CAST(v[i + 1] / nrm AS FLOAT) ELSE CAST(0 AS FLOAT) END * ({floats(sign_stream(c.seed, p))})[i + 1] AS FLOAT)) AS w FROM {name}_n)",
    ]
    k, h = 0, 1
    while h < p:
        out.append(f"{name}_{k + 1} AS (SELECT * EXCLUDE (w), list_transform(range({p}), lambda i: CASE WHEN (i & {h}) = 0 THEN w[i + 1] + w[i + {h + 1}] ELSE w[i - {h} + 1] - w[i + 1] END) AS w FROM {name}_{k})")
        k, h = k + 1, 2 * h
    out.append(f"{name} AS (SELECT * FROM {name}_{k})")
    return ",\n".join(out)


def encoded(c: IndexConfig, name: str = "enc", source: str = "embeddings") -> str:
    """CTEs up to ``name`` (vec_id, label, embedding, w, codes, scale, and with a residual pass codes2, scale2)."""
    p = c.padded
    one = "CAST(1 AS FLOAT)"
    out = [
        rotated(c, f"{name}r", source),
        f"{name}_c AS MATERIALIZED (SELECT *, {quantized('w', c.bits)} AS codes FROM {name}r)",
        f"{name}_d AS (SELECT *, {decoded('codes', c.bits)} AS d0 FROM {name}_c)",
        f"{name}_s AS (SELECT *, {total('list_transform(d0, lambda x: x * x)')} AS sq FROM {name}_d)",
        f"{name}_q AS (SELECT *, {root('sq')} AS rt FROM {name}_s)",
    ]
    if not c.residual:
        return ",\n".join([*out, f"{name} AS MATERIALIZED (SELECT * EXCLUDE (d0, sq, rt), CAST({one} / rt AS FLOAT) AS scale FROM {name}_q)"])
    floor = f"CAST({FLOOR!r} AS FLOAT)"
    out += [
        f"{name}_e AS (SELECT *, list_transform(range({p}), lambda i: w[i + 1] - d0[i + 1]) AS e FROM {name}_q)",
        f"{name}_m AS (SELECT *, {root(f'greatest(CAST({total("list_transform(e, lambda x: x * x)")} / CAST({p} AS FLOAT) AS FLOAT), {floor})')} AS rms FROM {name}_e)",
        f"{name}_f AS (SELECT *, list_transform(e, lambda x: CAST(x / rms AS FLOAT)) AS f FROM {name}_m)",
        f"{name}_g AS MATERIALIZED (SELECT *, {quantized('f', 4)} AS codes2 FROM {name}_f)",
        f"{name}_h AS (SELECT *, {decoded('codes2', 4)} AS d1 FROM {name}_g)",
        f"{name}_i AS (SELECT *, {root(f'greatest(sq + CAST(2 AS FLOAT) * rms * {dot("d0", "d1", p)} + rms * rms * {total("list_transform(d1, lambda x: x * x)")}, {floor})')} AS den FROM {name}_h)",
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE (d0, sq, rt, e, rms, f, d1, den), CAST(CAST(CAST({one} / rt AS FLOAT) * rt AS FLOAT) / den AS FLOAT) AS scale, CAST(rms / den AS FLOAT) AS scale2 FROM {name}_i)",
    ]
    return ",\n".join(out)


def prepared(c: IndexConfig, where: str, name: str = "qry") -> str:
    """CTEs up to ``name`` (qid, q, rn) of the rows that where selects."""
    return ",\n".join(
        [
            f"{name}_e AS (SELECT * FROM embeddings WHERE {where})",
            rotated(c, f"{name}r", f"{name}_e"),
            f"{name}_l AS (SELECT *, {norm('w')} AS rn FROM {name}r)",
            f"{name} AS MATERIALIZED (SELECT vec_id AS qid, label AS qlabel, rn, list_transform(w, lambda x: CAST(x / rn AS FLOAT)) AS q FROM {name}_l)",
        ]
    )


def raw(codes: str, bits: int, p: int, q: str = "q") -> str:
    table = floats(CENTROIDS[bits])
    if bits != 4:
        lanes = [total(f"list_transform(range({k}, {p}, 4), lambda i: {q}[i + 1] * ({table})[{codes}[i + 1] + 1])") for k in range(4)]
        return f"(({lanes[0]} + {lanes[1]}) + ({lanes[2]} + {lanes[3]}))"
    if p < 16 or p % 16:
        raise ValueError("padded must be a multiple of 16 here")
    pair = f"{q}[2 * b + 1] * ({table})[{codes}[2 * b + 1] + 1] + {q}[2 * b + 2] * ({table})[{codes}[2 * b + 2] + 1]"
    a = [total(f"list_transform(range({k}, {p // 2}, 8), lambda b: {pair})") for k in range(8)]
    return f"((({a[0]} + {a[1]}) + ({a[2]} + {a[3]})) + (({a[4]} + {a[5]}) + ({a[6]} + {a[7]})))"


def score(c: IndexConfig, scale: str = "scale") -> str:
    s = f"{raw('codes', c.bits, c.padded)} * {scale}"
    return f"({s} + {raw('codes2', 4, c.padded)} * scale2)" if c.residual else f"({s})"


def half(x: str) -> str:
    """Rounded to ten fraction bits, ties to even, for values in the normal range of half precision."""
    e = f"pow(2, 10 - floor(log2(CAST({x} AS DOUBLE))))"
    return f"CAST(round_even(CAST({x} AS DOUBLE) * {e}, 0) / {e} AS FLOAT)"


def little(x: str, n: int) -> str:
    """A number as n bytes in hexadecimal, the lowest first."""
    return f"array_to_string(list_transform(range({n}), lambda j: printf('%02X', (CAST({x} AS BIGINT) >> (8 * j)) & 255)), '')"


def half_bits(x: str) -> str:
    """The bits of half(x), for normal positive values."""
    e = f"CAST(floor(log2(CAST({x} AS DOUBLE))) AS BIGINT)"
    return f"(({e} + 14) * 1024 + CAST(round_even(CAST({x} AS DOUBLE) * pow(2, 10 - {e}), 0) AS BIGINT))"


def packed(codes: str, bits: int, p: int) -> str:
    """Codes in hexadecimal, the lowest bit first: eight codes fill as many bytes as a code has bits."""
    group = f"list_sum(list_transform(range(8), lambda i: CAST({codes}[8 * g + i + 1] AS BIGINT) << ({bits} * i)))"
    return f"array_to_string(list_transform(range({p // 8}), lambda g: {little(group, bits)}), '')"


def serialized(c: IndexConfig, version: int, rows: int, mode: str) -> str:
    """mode, shard, n_bytes and sha256 of the files of all shards of so many rows, whose keys are their vec_ids."""
    passes = ("", "2") if c.residual else ("",)
    planes = ", ".join(f"string_agg({little(half_bits('scale' + p), 2)}, '' ORDER BY i) AS s{p}, string_agg({packed('codes' + p, c.bits, c.padded)}, '' ORDER BY i) AS c{p}" for p in passes)
    header = " || ".join([f"'{b'VECQ'.hex().upper()}'", little(str(version), 2), little("0" if c.working_dim == c.dim else str(c.working_dim), 2), little(str(c.dim), 4), little(str(c.seed), 8), little("m", 4)])
    width = f" || '{c.bits:02X}'" if version == 261 else ""
    body = " || ".join(f"s{p} || c{p}" for p in passes)
    return (
        f"SELECT * FROM (WITH {encoded(c)}, n AS (SELECT *, vec_id // {rows} AS shard, row_number() OVER (PARTITION BY vec_id // {rows} ORDER BY vec_id) - 1 AS i FROM enc),"
        f" parts AS (SELECT shard, count(*) AS m, {planes}, string_agg({little('i', 4)} || {little('vec_id', 8)}, '' ORDER BY i) AS k FROM n GROUP BY shard),"
        f" files AS (SELECT shard, {header}{width} || {body} || {little('m', 4)} || k AS x FROM parts)"
        f" SELECT '{mode}' AS mode, shard, CAST(length(x) // 2 AS BIGINT) AS n_bytes, sha256(unhex(x)) AS sha256 FROM files)"
    )


def scored(c: IndexConfig, where: str, scale: str = "scale", live: str = "true", name: str = "sc") -> str:
    """CTEs up to ``name`` (qid, vec_id, label, score)."""
    return f"{encoded(c)},\n{prepared(c, where)},\n{name} AS MATERIALIZED (SELECT qid, qlabel, vec_id, label, {score(c, scale)} AS score FROM enc, qry WHERE {live})"


def ranked(source: str = "sc", k: int = 10, name: str = "hits") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM {source}) WHERE rank <= {k})"


def truth(where: str, k: int, dim: int = 64, name: str = "truth", dot_product: bool = False) -> str:
    score = dot("embedding", "qe", dim) if dot_product else cosine("embedding", "qe", dim)
    return (
        f"tq AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE {where}),\n"
        f"ts AS MATERIALIZED (SELECT qid, vec_id, {score} AS score FROM embeddings, tq),\n" + ranked("ts", k, name)
    )
