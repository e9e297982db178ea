from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from made import prose

from sparvec.llm import jaccard_join as J
from sparvec.llm.components import connected_components


def brute(rows: list[tuple], width: int, percent: int) -> dict:
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else (frozenset([tuple(w)]) if w else frozenset())
    ids, root = sorted(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@settings(deadline=None, max_examples=1500)
@given(st.one_of(st.integers(1, 40), st.integers(1, 700)), st.integers(0, 12), st.integers(0, 12), st.booleans(), st.sampled_from([80, 90]), st.integers(0, 10_000))
def test_linked_sets_share_a_signature(size, less, more, many, percent, seed):
    less, more = (5 * less, 5 * more) if many else (less, more)
    rng = np.random.default_rng(seed)
    all_ = J.mixed(rng.integers(1, 1 << 62, size + more).astype(np.uint64))
    a, b = np.unique(all_[:size]), np.unique(all_[min(less, size - 1) :])
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
        common = np.sort(rng.choice(all_, len(all_) // 3, replace=False))
        for index in (J.Index(percent), J.Index(percent, True)):
            assert len(np.intersect1d(index.signatures(a), index.signatures(b)))
            assert len(np.intersect1d(index.signatures(a, common), index.signatures(b, common)))


def test_bands_hold_linked_sizes():
    for percent in (80, 90):
        for small in range(1, 3000):
            large = small * 100 // percent
            assert J.bands(large, percent)[0] - J.bands(small, percent)[0] in (0, 1)


def test_links_in_a_group_equal_brute_force():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    sets += [np.append(s[:-1], np.uint64(1000 + i)) for i, s in enumerate(sets[:10])]
    label = J.linked(sets, 80)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert label[a] == label[b]


@pytest.mark.parametrize("width,percent,block", [(3, 90, 1 << 19), (5, 80, 1 << 19), (3, 90, 4096)])
def test_whole_tables(spark, documents, nothing, width, percent, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", block)  # 4096: components are dealt out in many blocks
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], width, percent)
    got = J.components(documents, width, percent).collect()
    assert len(got) == documents.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    if block > 4096:
        assert J.components(nothing, width, percent).count() == 0


@settings(deadline=None, max_examples=300)
@given(st.integers(1, 900), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 90]), st.integers(0, 10_000))
def test_sketches_never_part_linked_sets(size, less, more, percent, seed):
    all_ = np.unique(J.mixed(np.random.default_rng(seed).integers(1, 1 << 62, size + more).astype(np.uint64)))
    a, b = all_[: max(1, len(all_) - more)], all_[min(less, len(all_) - 1) :]
    bits = J.folded([J.sketch(a), J.sketch(b)])
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both):
        assert J.possible(np.array([len(a), len(b)]), bits, percent).tolist() == [0, 0]


def test_hot_buckets_and_heads_lose_no_link(spark, documents, monkeypatch):
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "BLOCK_TOKENS", 4096)
    for heads in (1, 8):
        monkeypatch.setattr(J, "HEADS", heads)
        want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], 5, 80)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(documents, 5, 80).collect()} == want


def test_documents_of_a_hot_passage_are_indexed_without_it(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 8)
    passage = prose(1, 60)
    rows = [(i, f"{prose(10 + i, 60)} {passage}") for i in range(40)]
    rows += [(100 + i, f"{prose(10 + i, 60)} {passage} more") for i in range(0, 40, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = np.zeros(0, np.uint64)
    hot = lambda tables: {r["doc_id"] for t in tables for r in t.filter("hot").select("doc_id").distinct().collect()}
    before, after = hot([J._signed(docs, 5, 80, none)]), hot(J.buckets(docs, 5, 80, none))
    assert len(before) == 48 and len(after) < 40
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs, 5, 80).collect()} == brute(rows, 5, 80)


def test_one_document_of_each_group_stays(spark, documents):
    out = J.deduplicated(documents)
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], 5, 80)
    assert out.columns == documents.columns
    assert {r["doc_id"] for r in out.collect()} == {d for d, (_, c) in want.items() if c == d}


def test_repeated_rows_keep_one_row_and_their_text(spark):
    from sparvec.llm import suffix_dedup

    text = {k: prose(500 + k, 80) for k in range(7)}
    rows = [(1, text[1], "x")] * 3 + [(None, text[2], "x")] * 3 + [(None, text[3], "x"), (9, text[3], "y"), (4, text[4], "x"), (5, text[4].upper(), "x"), (5, text[5], "x"), (6, text[6], "x")]
    rows += [(7, None, "x"), (7, "", "x"), (None, "", "x"), (None, None, "y"), (8, text[6] + " end", "x"), (None, text[6].replace(" ", "  "), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h string").repartition(5)
    out = J.deduplicated(docs)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["text"]))
    assert got == sorted([(1, text[1]), (0, text[2]), (9, text[3]), (4, text[4]), (5, text[5]), (6, text[6])])
    assert out.columns == docs.columns and sorted(r["doc_id"] or 0 for r in out.collect() if not r["text"]) == [0, 0, 7]
    left = sorted(((r["doc_id"] or 0, r["text"]) for r in suffix_dedup.without_repeats(out.select("doc_id", "text")).collect() if r["text"]))
    assert left == got
    for broadcast in (0, 50_000):
        J.BROADCAST_IDS, before = broadcast, J.BROADCAST_IDS
        assert J.deduplicated(docs).count() == out.count()
        J.BROADCAST_IDS = before
    assert J.deduplicated(docs.limit(0)).count() == 0


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs).collect()}
    assert got == {None: (2, None), 1: (2, 1), 2: (2, 1), 3: (0, 3)}


@pytest.mark.parametrize("split", [0, 1_000_000])
def test_components_of_chains_and_stars(spark, split, monkeypatch):
    from sparvec.llm import components

    monkeypatch.setattr(components, "SPLIT", split)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (3, None), (2, 1)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
