"""The pipeline as a whole, against what brute force says of planted documents."""

from __future__ import annotations

import pytest
from made import prose

import corpus_pipeline
from sparvec.llm import bpe

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, __key string, cut int"
ITEM = "If Alice buys 12 apples for 3 dollars each and then sells 5 of them to Bob how many are left"


@pytest.fixture()
def folder(spark, tmp_path):
    """Writes the tables that the pipeline reads."""

    def write(rows, labels):
        full = [(*r, None if r[1] is None else len(r[1]), "k", 1) for r in rows]
        spark.createDataFrame(full, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_planted_documents(spark, folder):
    passage = prose(7_777, 60)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = prose(i, 70) + (" horrible awful nasty scum" if bad else "")
        rows.append((i, text, "en", f"s{i // 3 % 2}"))
        labels.append((i, 1, int(bad)))
    clean = [prose(1_000 + k, 90) for k in range(6)]
    rows += [(500 + k, t, "en", "s0") for k, t in enumerate(clean)]
    rows += [(510, clean[0], "en", "s1"), (511, " ".join(clean[1].split()[:-1]), "en", "s1"), (500, clean[0], "en", "s0")]
    rows += [(520 + k, f"{prose(2_000 + k, 40)}\n{passage}\n{prose(3_000 + k, 40)}", "en", "s0") for k in range(3)]
    rows += [(530, f"{prose(4_000, 50)} {ITEM} {prose(4_001, 50)}", "en", "s0"), (540, None, None, None), (541, "", "en", None), (None, prose(5_000, 80), "en", "s0")]
    got = corpus_pipeline.run(spark, folder(rows, labels)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(by_id) == len(got) and None in by_id
    assert not {i for i in by_id if i is not None and i < 300 and i % 3 == 0}
    assert {i for i in range(300) if i % 3} <= set(by_id) and {500, 501, 502, 503, 504, 505, 520, 521, 522} <= set(by_id)
    assert not {510, 511, 530} & set(by_id)
    coder = bpe.Coder.load(*bpe.default_vocabulary())
    assert coder.decode(by_id[502]["ids"]).decode() == clean[2]
    for k in range(3):
        text = coder.decode(by_id[520 + k]["ids"]).decode()
        # a repeat may take in a few letters that two surroundings share by chance
        assert passage[:200] not in text and prose(2_000 + k, 40)[:-9] in text and prose(3_000 + k, 40)[9:] in text
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0


def test_stages_keep_all_columns(spark, folder):
    path = folder([(i, prose(i, 60), "en", "s") for i in range(5)] + [(None, None, None, None)], [])
    docs = spark.read.parquet(path + "/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
    assert docs.count() == 6
