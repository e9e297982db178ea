from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparvec.llm import suffix_dedup as S
from made import prose


def brute(texts: list[bytes], m: int) -> list[list[tuple[int, int]]]:
    n = Counter(t[k : k + m] for t in texts for k in range(len(t) - m + 1))
    return [S.merged([(k, k + m) for k in range(len(t) - m + 1) if n[t[k : k + m]] > 1]) for t in texts]


def spans_in_memory(texts: list[bytes], m: int) -> list[list[tuple[int, int]]]:
    rows = []
    for i, t in enumerate(texts):
        for h, at, first, last in zip(*S.anchors(t, m)):
            rows.append((int(h), t[first : last + m], int(at - first), i, int(at)))
    left, right = S.extents([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], m)
    out = [[] for _ in texts]
    for r, a, b in zip(rows, left, right):
        if a + b:
            out[r[3]].append((r[4] - int(a), r[4] + int(b)))
    return [S.merged(sorted(x)) for x in out]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab", max_size=400), max_size=6))
def test_repeats_of_small_alphabets(texts):
    texts = [t.encode() for t in texts]
    assert spans_in_memory(texts, 64) == brute(texts, 64)


def test_repeats_of_edited_copies():
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 105, 1500).astype(np.uint8))
    texts = [base]
    for k in range(12):
        t = bytearray(base[37 * k : 900 + 40 * k])
        for at in rng.integers(0, len(t), 3):
            t[at] = 122
        texts.append(bytes(t))
    texts.append(b"xyz" * 300)
    for m in (64, 100, 200):
        assert spans_in_memory(texts, m) == brute(texts, m)


def test_intervals_of_a_small_array():
    #          0  1  2  3  4  5
    lcp = [-1, 3, 3, 1, 5, -1]
    assert sorted(S.intervals(lcp)) == [(0, 2, 3), (0, 4, 1), (3, 4, 5)]
    assert list(S.intervals([])) == [] and list(S.intervals([-1])) == []


@pytest.mark.parametrize("group", [4096, 3])
def test_whole_tables(spark, documents, nothing, group, monkeypatch):
    monkeypatch.setattr(S, "GROUP", group)  # 3: groups are split by further bytes
    rows = documents.select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = sorted((r["doc_id"], len(t), sum(b - a for a, b in w), len(w), hashlib.sha256(S.kept(t, w)).hexdigest()) for r, t, w in zip(rows, texts, brute(texts, 200)))
    assert sorted(map(tuple, S.digests(documents).collect())) == want
    assert any(x[2] for x in want) and S.digests(nothing).count() == 0


def test_texts_without_repeats(spark, documents):
    out = S.without_repeats(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    texts = [r["text"] for r in out.filter("doc_id BETWEEN 300 AND 311").collect()]
    assert all(len(t) > 50 and prose(999, 60)[:200] not in t for t in texts)
    assert out.filter("doc_id = 400").first()["text"] is None
    with pytest.raises(ValueError):
        S.repeated_spans(documents, 20)


@pytest.mark.parametrize("group", [4096, 3])
def test_texts_are_brought_together_once_for_marks_and_once_for_spans(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    dealt, real = [], S._dealt
    monkeypatch.setattr(S, "_dealt", lambda *a: dealt.append(a) or real(*a))
    passage = "ä€" * 50  # 250 bytes; a start amid a character takes the character away
    rows = [(i, f"{prose(100 + i, 20)} {passage[i % 2 :]} {prose(500 + i // 3, 60)}") for i in range(12)]
    rows += [(20, rows[0][1]), (20, rows[0][1]), (None, rows[1][1] + "a"), (22, None), (23, "short"), (24, passage + "\xe4x")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/some_docs")
    docs = spark.read.parquet(f"{tmp_path}/some_docs")
    out = S.without_repeats(docs)
    assert len(dealt) == 1
    assert out._jdf.queryExecution().executedPlan().toString().count("text:string") == 1
    texts = [(x or "").encode() for _, x in rows]
    want = [(d, None if x is None else S.kept(t, w).decode("utf-8", "ignore")) for (d, x), t, w in zip(rows, texts, brute(texts, 200))]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want)) and any(x == "" for _, x in want)


def test_halves_keep_equal_strings_together():
    rng = np.random.default_rng(3)
    m = 80
    base = bytes(rng.integers(97, 99, 300).astype(np.uint8))
    contexts = []
    for _ in range(40):
        before, after = (int(x) for x in rng.integers(0, m - S.SEED + 1, 2))
        c = bytearray(base[150 - before : 150 + S.SEED + after])
        c[: before // 3] = rng.integers(97, 99, before // 3).astype(np.uint8).tobytes()
        if len(c) >= m:
            contexts.append((before, bytes(c)))
    nodes = [[(0, 0, m - S.SEED, o, c)] for o, c in contexts]
    want = [{(o - k, c[k : k + m]) for k in range(len(c) - m + 1)} for o, c in contexts]
    for depth in range(9):
        split = [[(0, x, y, high, own) for row in rows for x, y, core, high, own, lost in S.halves(row, False, m)] for rows in nodes]
        assert [{(o - k, c[k : k + m]) for _, _, _, o, c in rows for k in range(len(c) - m + 1)} for rows in split] == want
        for rows in nodes:
            for row in rows:
                for x, y, core, high, own, lost in S.halves(row, False, m):
                    assert len(core) == m - (y - x) and core in own and row[4][lost : lost + len(own)] == own
        nodes = split
    assert all(x == y for rows in nodes for _, x, y, _, _ in rows)


@pytest.mark.parametrize("names", [["__id", "id"], ["hash", "CUT"], ["_id", "th"]])
def test_columns_of_any_name_stay(spark, names):
    long = "word " * 100
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, long + "b", 6, "y"), (3, None, 7, None)], "doc_id long, text string, a long, b string").withColumnsRenamed(dict(zip("ab", names)))
    got = sorted(map(tuple, S.without_repeats(docs).collect()), key=lambda r: r[0])
    assert got == [(1, "", 5, "x"), (2, "b", 6, "y"), (3, None, 7, None)]


def test_common_passages_in_other_surroundings(spark, monkeypatch):
    """Groups above the limit that share a passage, whose surroundings partly agree, and long runs of one word pair."""
    monkeypatch.setattr(S, "GROUP", 4)
    passage = prose(1, 50)[:260]
    rows = [(i, f"{prose(100 + i, 20)[: 90 + i]} {passage} {prose(500 + i // 2, 30)}") for i in range(24)]
    rows += [(50 + i, "ta tu " * (60 + 7 * i) + prose(i, 9)) for i in range(9)] + [(70, passage[5:215]), (71, passage[:199])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = [t.encode() for _, t in rows]
    want = sorted((d, len(t), sum(b - a for a, b in w), len(w), hashlib.sha256(S.kept(t, w)).hexdigest()) for (d, _), t, w in zip(rows, texts, brute(texts, 200)))
    assert sorted(map(tuple, S.digests(docs).collect())) == want


@pytest.mark.parametrize("group", [4096, 4])
def test_groups_of_repeats_have_all_their_places(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    passage, other = prose(1, 60)[:300], prose(2, 60)[:260]
    rows = [(i, f"{prose(100 + i, 9)} {passage[: 300 - 7 * (i % 3)]} {prose(500 + i // 2, 9)}") for i in range(9)]
    rows += [(20, f"{other} x {passage} y {other}"), (21, prose(3, 60)), (22, prose(3, 60)), (23, "short"), (24, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {d: (t or "").encode() for d, t in rows}
    groups: dict = {}
    for r in S.repeat_groups(docs).collect():
        groups.setdefault((r["repeat"], r["n_bytes"]), set()).add((r["doc_id"], r["start"]))
    covered = {d: [] for d in texts}
    for (_, n), places in groups.items():
        own = {texts[d][a : a + n] for d, a in places}
        assert len(own) == 1 and n >= 200 and len(places) > 1
        text = own.pop()
        assert places == {(d, k) for d, t in texts.items() for k in range(len(t) - n + 1) if t[k : k + n] == text}
        for d, a in places:
            covered[d].append((a, a + n))
    assert [S.merged(sorted(covered[d])) for d in texts] == brute(list(texts.values()), 200)


def test_rows_without_an_id(spark):
    long = "word " * 100
    docs = spark.createDataFrame([(None, long + "a"), (None, long + "b"), (1, "short")], "doc_id long, text string")
    got = sorted(S.digests(docs).collect(), key=lambda r: r["n_bytes"])
    assert [r["n_removed"] for r in got] == [0, 500, 500] and [r["doc_id"] for r in got] == [1, None, None]
