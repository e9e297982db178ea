"""Sharding, rules, language, URLs, chats, decontamination, the classifier."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from made import prose
from sparvec.llm import chat_format, decontaminate, language_id, quality_classifier, quality_rules, sharding, url_filter

# sharding


def test_packing_is_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(100):
        classes = [(s, r.randint(1, 9)) for s in r.sample(range(1, 300), 25)]
        capacity = r.randint(300, 500)
        bins, runs = sharding.pack(classes, capacity)
        left: list[int] = []
        for size, n in sorted(classes, reverse=True):
            assert sum(x for _, x in runs[size]) == n
            for _ in range(n):
                fits = [(x, i) for i, x in enumerate(left) if x >= size]
                if fits:
                    left[min(fits)[1]] -= size
                else:
                    left.append(capacity - size)
        load = Counter()
        for size, dealt in runs.items():
            for b, n in dealt:
                load[b] += size * n
        assert len(left) == bins and sorted(capacity - x for x in load.values()) == sorted(left)


def test_the_tree_splits_and_empties():
    tree, r = sharding.CapacityTree(), random.Random(2)
    values = [(r.randint(0, 5000), i) for i in range(4000)]
    for x, i in values:
        tree.add(x, i)
    rest = sorted(values)
    for _ in range(4000):
        size = r.randint(0, 5000)
        want = next((e for e in rest if e >= (size, -1)), None)
        assert tree.take_tightest(size) == want
        if want:
            rest.remove(want)


def test_shards_of_a_table(spark, documents, nothing):
    got = sharding.shard(documents).collect()
    rows = documents.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by_text: dict = {}
    for r in got:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values()) and {r["shard"] for r in got} <= set(range(8))
    assert sharding.shard(nothing).count() == 0
    some = sharding.shard(documents.filter("doc_id < 30 AND doc_id <> 3"), capacity=4000)
    assert some.groupBy("shard").agg(F.sum("size").alias("s")).filter("s > 4000").isEmpty()


def test_sizes_are_near_equal(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', int(1 + id % 97 * 7))").alias("text"))
    docs = docs.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    sums = [r[1] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.005 * sum(sums) / 8


def test_a_hot_group_leaves_the_other_shards_even(spark):
    for share in (0.15, 0.2, 1 / 3, 0.6):
        hot = int(share / (1 - share) * sum(range(1, 2001)))
        classes = [(hot, 1), *((s, 1) for s in range(1, 2001))]
        load = Counter()
        for size, dealt in sharding.leveled(classes, 8).items():
            assert sum(n for _, n in dealt) == dict(classes)[size]
            for b, n in dealt:
                load[b] += size * n
        rest = sorted(load.values())[:-1]
        assert len(load) == 8 and max(load.values()) == hot and rest[-1] - rest[0] <= 0.005 * sum(rest) / 7
    load = Counter(b for dealt in sharding.leveled([(10, 9)], 8).values() for b, n in dealt for _ in range(n))
    assert sorted(load.values()) == [1] * 7 + [2]
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, repeat('y', 300), concat(repeat('x', 290), lpad(id, 10, '0'))) AS text")
    got = {r["shard"]: r["s"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    sums = sorted(got.values())
    assert set(got) == set(range(8)) and sums[-1] == 301_000 and sums[-2] - sums[0] <= 301


# rules


def brute_rules(text: str | None) -> tuple:
    import re

    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, failed


def test_rules_equal_brute_force(spark, documents, nothing):
    texts = [r["text"] for r in documents.collect()] + ["a b a b a b", "x\x1cy z\x85w\n\nq\nq", "one two three one two three four", "a  a\ta\x0ba"]
    for t in texts:
        assert quality_rules.judged(t or "")[:6] == brute_rules(t)
    got = quality_rules.judge(documents).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((r["doc_id"], brute_rules(r["text"])[0]) for r in documents.collect())
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.clean(documents).columns == documents.columns


def test_lines_and_documents_that_fail():
    for line, rule in (("buy%%% now$$$ here***", "symbols"), ("HOME | ABOUT", "symbols"), ("THE!! BEST!! OFFER!!", "shouting"), ("spam " * 40, "repetition"), ("Contact us", "punctuation"), ("Licensed under the Apache License, Version 2.0.", "boilerplate"), ("Home / About / News / Contact", "navigation")):
        assert quality_rules.line_fails(line) == rule
    assert quality_rules.line_fails("A plain sentence that is fine.") is None
    good = ". ".join(prose(k, 12) for k in range(12)) + "."
    assert quality_rules.judged(good)[6] and not quality_rules.judged(good + "\n" + "a%%% b%%% c%%% " * 200)[6]
    assert quality_rules.cleaned(good + "\nAll rights reserved.")[0] == good


def brute_line_fails(line: str) -> bool:
    words = line.split()
    n, chars = len(words), len("".join(words))
    symbols = sum(c in quality_rules.SYMBOLS for c in line)
    marks = [w for w in words if len(w) == 1 and w in "|/>»›•·" or w[0] in "|»›•·" or w[-1] in "|»›•·"]
    items = [w for w in words if not (len(w) == 1 and w in "|/>»›•·")]
    return (
        10 * symbols >= chars
        or n >= 3 and 2 * line.count("!!") >= n
        or n >= 12 and 4 * len(set(words)) < n
        or n < 4 and words[-1][-1] not in quality_rules.CLOSING
        or len(marks) >= 2 and len(items) <= 5 * (len(marks) + 1)
        or 40 * len(quality_rules.BOILERPLATE.findall(line)) > n
    )


def test_verdicts_equal_brute_force(spark, small):
    texts = [r["text"] or "" for r in spark.read.parquet(small + "/documents.parquet").collect()]
    menu = " | ".join(f"{prose(k, 1)} {prose(k + 50, 1)}" for k in range(60))
    notice = "Licensed under the terms of use. All rights reserved. " + prose(4, 70) + " See our privacy policy."
    texts += [f"{texts[k]}\n{x}" for k, x in enumerate((menu, notice, "a > b > c", "• one • two", "x/y/z", "|||", "and / or", menu * 40))]
    assert quality_rules.line_fails(menu) == "navigation" and quality_rules.line_fails(notice) == "boilerplate"
    for t in texts:
        gone = [x for x in t.split("\n") if x.split() and brute_line_fails(x)]
        left = [x for x in t.split("\n") if not (x.split() and brute_line_fails(x))]
        lost = sum(len(w) for x in gone for w in x.split(" "))
        got = quality_rules.judged(t)
        assert got[-1] == "\n".join(left) and got[7] == len(gone)
        assert got[6] == (not brute_rules(t)[5] and 2 * lost <= brute_rules(t)[1])


def test_lines_of_one_long_word_take_no_time():
    import time

    for word in ("a", "|", "/>", "ab|", "log", "!!"):
        began = time.time()
        quality_rules.judged(word * (1_000_000 // len(word)) + "\nx")
        assert time.time() - began < 1


# language


def test_languages_are_told_apart(spark, small, nothing, documents):
    docs = spark.read.parquet(small + "/documents.parquet")
    got = language_id.op9_language_id(spark, small).join(docs, "doc_id")
    assert got.filter("held_out").count() > 20
    assert got.filter("held_out AND lang = lang_pred").count() >= 0.95 * got.filter("held_out").count()
    assert got.filter("score < 0 OR score > 1").isEmpty()
    wanted = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in range(200)}
    assert all(r["held_out"] == wanted[r["doc_id"]] for r in got.select("doc_id", "held_out").collect())


def test_languages_of_odd_rows(spark, documents, nothing):
    model = language_id.fit(documents.filter("doc_id < 312"))
    got = {r["doc_id"]: r for r in language_id.identify(documents, model).collect()}
    assert got[400]["lang_pred"] == got[401]["lang_pred"] == got[405]["lang_pred"] == "und"
    assert {r["lang_pred"] for d, r in got.items() if d < 400} <= {"en", "de"}
    assert language_id.fit(nothing) is None and language_id.identify(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(documents, None).collect()} == {"und"}


def test_a_very_long_learning_text_spoils_no_language(spark):
    rows = [(i, prose(i, 60), "en") for i in range(20)] + [(100 + i, "zwölf größe über straße " * 9 + f"tür{i}", "de") for i in range(20)]
    docs = spark.createDataFrame([*rows, (200, "ab" * 70_000, "aa"), (201, "q " * 40_000, "aa")], "doc_id long, text string, lang string")
    many = language_id.counts("ab" * 70_000)
    assert many.max() > 65_504 and (language_id.unpacked(language_id.packed(many)) == many).all()
    model = language_id.fit(docs)
    assert np.isfinite(model.centroids).all() and np.isfinite(model.limits).all()
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[d]["lang_pred"] == lang and got[d]["score"] > 0 for d, _, lang in rows)
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "aa"


def test_short_texts_need_little_memory(spark, documents):
    import tracemalloc

    model = language_id.fit(documents.filter("doc_id < 312"))
    texts = [prose(k, 2)[:10] for k in range(20_000)]
    want = [model.predict([t])[0] for t in texts[:300]]
    tracemalloc.start()
    got = model.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and [g[0] for g in got[:300]] == [w[0] for w in want] and np.allclose([g[1] for g in got[:300]], [w[1] for w in want], atol=1e-5)


def test_more_languages_than_rows_for_each(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEARN_ROWS", 40)
    docs = spark.createDataFrame([(i, chr(0x4E00 + 50 * (i % 60)) * 9 + prose(i, 2), f"l{i % 60}") for i in range(600)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 60 and len(model.centroids) == 60


# URLs

URLS = [
    ("http://a.example.net/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://A.EXAMPLE.net/de/", "a.example.net", "/de/", "net/", "block"),
    ("https://example.com/de/1#x", "example.com", "/de/1", "example.com/de/", "block"),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    ("x://net", "net", "", None, None),
    ("https://w.org/fr/a", "w.org", "/fr/a", "org/fr/", "allow"),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("http://h.com#a/b?c", "h.com", "", None, None),
    ("http://h.com?u=http://net/", "h.com", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, rule int")
    got = sorted(url_filter.judge(pages).collect(), key=lambda r: r["page_id"])
    for r, u in zip(got, URLS):
        assert (r["host"], r["path"], r["rule"]) == u[1:4] and r["verdict"] in ("allow", "block") and (u[4] is None or r["verdict"] == u[4])
    assert url_filter.judge(pages.limit(0)).count() == 0


def cheapest(name: str, costs: dict, unknown: float) -> float:
    """The least cost of any split, by trying all of them."""
    whole = costs.get(name, unknown + url_filter.LETTER * len(name))
    return min([whole, *(cheapest(name[:k], costs, unknown) + cheapest(name[k:], costs, unknown) for k in range(1, len(name)))])


def test_splits_are_the_cheapest():
    r = random.Random(9)
    for _ in range(60):
        costs = {"".join(r.choices("abc", k=r.randint(2, 4))): r.random() * 9 for _ in range(9)}
        name = "".join(r.choices("abc", k=r.randint(1, 8)))
        words = url_filter.segmented(name, costs, 5.0)
        mine = sum(costs.get(w, 5.0 + url_filter.LETTER * len(w)) for w in words)
        assert "".join(words) == name and mine == pytest.approx(cheapest(name, costs, 5.0))
    assert len(url_filter.segmented("x" * 5000, {}, 5.0)) == -(-5000 // url_filter.MAX_WORD)


def brute_urls(pages: list[tuple]) -> list[tuple]:
    """host, path, words and score of each page (url, html)."""
    import math

    import regex

    parts = lambda text: regex.findall(r"\p{L}+|\p{Nd}+", text.lower())
    hosts = []
    for url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = regex.split("[/?#]", rest)[0]
        hosts.append(("".join(c.lower() if c.isascii() else c for c in host), regex.split("[?#]", rest[len(host) :])[0]))
    counts: Counter = Counter()
    for _, html in pages:
        counts.update(parts(regex.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html or "")))
    for _, path in hosts:
        counts.update(parts(path))
    labels = Counter(w for host in {h for h, _ in hosts} for w in set(parts(host)))
    counts.update({w: n - 1 for w, n in labels.items()})
    counts = Counter({w: n for w, n in counts.items() if n and 2 <= len(w) <= url_filter.MAX_WORD and not w[0].isdigit()})
    fixed = {w: max(1, int(sum(counts.values()) * url_filter.FIXED_SHARE)) for w in {*url_filter.COMMON, *url_filter.SEEDS}}
    counts.update(fixed)
    total = sum(counts.values())
    costs = {w: math.log(total) - math.log(n) for w, n in counts.items()}
    words = [[w for part in parts(h) + parts(p) for w in (["<num>"] if part[0].isdigit() else url_filter.segmented(part, costs, math.log(total) + url_filter.UNKNOWN))] for h, p in hosts]
    bad = [not set(url_filter.SEEDS).isdisjoint(w) for w in words]
    per = [Counter(url_filter.bucket(x) for w, k in zip(words, bad) if k == c for x in w) for c in (False, True)]
    sums = [sum(c.values()) + url_filter.BUCKETS for c in per]
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    score = lambda w: prior + sum(math.log((per[1][b] + 1) / sums[1]) - math.log((per[0][b] + 1) / sums[0]) for b in map(url_filter.bucket, w))
    return [(h, p, " ".join(w), score(w)) for (h, p), w in zip(hosts, words)]


def test_verdicts_of_urls_equal_brute_force(spark, small):
    pages = spark.read.parquet(small + "/pages.parquet").select("page_id", "url", "html")
    more = [("http://freecasinonews.org/x", "<p>Free casino news</p>"), ("http://CheapPills.com/buy-now_2/50", "<script>var casino</script>pills"), (None, None), ("http://" + "ab" * 900 + ".com", ""), ("http://ünïcode.de/straße", "<b>straße</b>")]
    pages = pages.unionByName(spark.createDataFrame([(10_000 + i, *m) for i, m in enumerate(more + more[:1])], "page_id long, url string, html string"))
    rows = pages.collect()
    want = {r["page_id"]: w for r, w in zip(rows, brute_urls([(r["url"], r["html"]) for r in rows]))}
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(rows)
    for i, (host, path, words, score) in want.items():
        assert (got[i]["host"], got[i]["path"], got[i]["words"]) == (host, path, words) and got[i]["score"] == pytest.approx(score, abs=1e-6)
        assert got[i]["rule"] or got[i]["verdict"] == ("block" if got[i]["score"] > 0 else "allow")


def test_words_of_hosts_and_bayes(spark):
    urls = [f"http://{a}{b}.com/{c}" for a in ("casino", "poker") for b in ("win", "club", "world") for c in ("bonus", "jackpot", "x")]
    urls += [f"http://{a}{b}.com/{c}" for a in ("daily", "local") for b in ("news", "press", "art") for c in ("story", "report", "x")]
    urls += ["http://jackpotbonus.com/bonus/jackpot", "http://storyreport.com/story/report"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [got[i]["verdict"] for i in range(18)] == ["block"] * 18 and [got[i]["verdict"] for i in range(18, 36)] == ["allow"] * 18
    # without a seed word of their own
    assert got[36]["words"].split()[:2] == ["jackpot", "bonus"] and got[36]["verdict"] == "block" and got[37]["verdict"] == "allow"


# chats


def test_chats_round_trip(spark):
    odd = ["", None, "\\", "\\s", "# <", "### assistant: x </turn>\n", "\\l\\h\\s", "日本\U0001f600", "a: b", "\n\n", "</turn>"]
    rows = [(c, t, role, odd[(c * 5 + t * 3) % len(odd)], 1) for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: 1 + c % 6])]
    rows += [(50, 1, None, "x", 1), (50, 0, "we:ird #r", "y", 1), (51, 0, "assistant", "only", 1), (52, 0, "user", "twice", 1), (52, 0, "user", "twice", 1), (None, 0, "assistant", "nobody's", 1)]
    rows += [(60, t, "assistant" if t % 2 else "user", "long " * 3000, 1) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, i int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.examples(df)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        turns = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.examples(df.limit(0)).count() == 0
    one = chat_format.examples(df.filter("conv_id = 4")).orderBy("target_turn").collect()
    assert [e["target_turn"] for e in one] == [2, 4] and one[1]["formatted"].startswith(one[0]["formatted"])


# decontamination


def test_leaks_and_reparameterised_questions(spark):
    item = "If Alice buys 12 apples for 3 dollars each and Alice sells 5 of them to Bob how many dollars does Alice have"
    other = item.replace("Alice", "Carol").replace("12", "40").replace("Bob", "Dan")
    mixed = item.replace("Alice", "Carol", 1).replace("12", "40")  # one name for two: only the windows of the changed one go
    names = "Alice gave Bob then Bob gave Alice then Alice gave Bob then Bob gave Alice"
    swapped = names.replace("Alice", "Carl").replace("Bob", "Dora")
    torn = "Carl gave Dora then Emil gave Fred then Gina gave Hugo then Ivan gave Jane"
    docs = [(1, "before it " + item + " after it"), (2, "so " + other + "?"), (3, mixed), (4, prose(1, 300)), (5, None), (6, ""), (7, item), (7, item), (8, " ".join(item.split()[:9])), (9, (prose(2, 4000)) + " " + item), (10, "short one"), (11, swapped), (12, torn), (13, "a short One")]
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, q int, item_id string")
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short One"), (5, names)], "item_id long, text string")
    rows = decontaminate.matches(d, b).collect()
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in rows}
    assert len(rows) == len(got) and got == {(1, 1): True, (2, 1): False, (3, 1): False, (7, 1): True, (9, 1): True, (11, 5): False, (13, 4): True}
    whole = {(r["doc_id"], r["item_id"]) for r in rows if r["n_covered"] == r["longest_run"] == r["n_words"]}
    assert whole == set(got) - {(3, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(d, b).collect()) == [4, 5, 6, 8, 10, 12]
    assert decontaminate.without_leaks(d, b).columns == d.columns
    assert decontaminate.matches(d.limit(0), b).count() == 0 and decontaminate.matches(d, b.limit(0)).count() == 0
    short = spark.createDataFrame([(4, "river stone cloud")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.matches(spark.createDataFrame([(1, "a river stone cloud b"), (2, "river cloud stone")], "doc_id long, text string"), short).collect()} == {1}


def against_sql(docs, benchmark) -> bool:
    """Whether the matches equal those of the SQL."""
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        con.register(name, pa.Table.from_pylist([r.asDict() for r in df.collect()]))
    got = decontaminate.matches(docs, benchmark)
    return sorted(map(tuple, got.collect())) == sorted(con.sql(decontaminate.SQL).select(*got.columns).fetchall())


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_random_templates_equal_the_sql(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    r = random.Random(8)
    words = "river stone cloud paper Alice Bob Carol 3 4 5 km days".split()
    items = [" ".join(r.choices(words, k=r.choice([1, 2, 3, 4, 6, 9, 15, 25]))) for _ in range(30)]
    docs = []
    for k in range(60):
        own = items[k % 30].split()
        a, b = r.choice(words), r.choice(words)
        docs.append(" ".join(r.choices(words, k=r.randint(0, 9)) + [b if w == a else w for w in own[r.randint(0, 2) :]] + r.choices(words, k=r.randint(0, 9))))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert against_sql(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))


def test_texts_that_share_an_id_are_checked_one_by_one(spark):
    item = "If Alice buys 12 apples for 3 dollars each and then sells 5 of them to Bob how many are left"
    d = spark.createDataFrame([(1, prose(3, 40)), (1, "so " + item), (1, "so " + item), (None, item), (2, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    assert [tuple(x) for x in decontaminate.matches(d, b).collect()] == [(1, 1, 21, 21, 21, True)]


def test_edited_and_quoted_items_are_leaks(spark):
    item = "if alice buys 12 apples for 3 dollars each and then sells 4 of them to bob how much is left".replace("alice", "Alice").replace("bob", "Bob")
    words, long_item = item.split(), prose(77, 60)
    edited = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(len(words))]
    twice = item + " when 12 more are bought by Carol for 30 dollars"
    items = [(1, item), (2, long_item), (3, twice), (4, "11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26")]
    docs = [("so " + x + " or not") for x in edited]
    docs += [" ".join(long_item.split()[k : k + 45]) for k in (0, 7, 15)] + [" ".join(long_item.split()[20:33])]
    docs += [twice.replace("12", "50", 1), twice.replace("12", "50"), item.replace("3", "5").replace("4", "5"), item, items[3][1]]
    clean = [prose(k, 900) for k in range(5)] + [" ".join(words[:9]), "", None, " ".join(long_item.split()[20:30])]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*docs, *clean])], "doc_id long, text string, q int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(d, b).collect()) == list(range(len(docs), len(docs) + len(clean)))
    assert decontaminate.without_leaks(d, b.limit(0)).count() == d.count()
    assert against_sql(d, b)


def test_short_items_and_items_of_placeholders_need_equal_values(spark):
    numbers = "11 12 13 14 15 16 17 18 19 20 21 22 23 24 25 26"
    b = spark.createDataFrame([(1, "42"), (2, "Paris"), (3, "May 7 days"), (4, numbers), (5, "river 5 cloud")], "item_id long, text string")
    docs = [(1, "we saw 43 of them"), (2, "Rome is far"), (3, "see 42 there"), (4, "on to Paris"), (5, " ".join(map(str, range(200, 260)))), (6, "x " + numbers), (7, "a river 5 cloud"), (8, "a river 6 cloud")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.matches(d, b).collect()}
    assert got == dict.fromkeys([(3, 1), (4, 2), (7, 5), (6, 4)], True) and against_sql(d, b)
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(d, b).collect()) == [1, 2, 5, 8]


@pytest.mark.parametrize("name", ["op7_chat_format", "op8_decontaminate"])
def test_native_queries_equal_their_sql(spark, small, name):
    from sparvec.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.queries()[name](spark, small)
    columns = sorted(got.columns)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, con.sql(queries.oracle_sql()[name]).select(*columns).fetchall()))


# classifier


def test_the_classifier_learns_two_views(spark):
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = prose(i, 60)
        if kind == 1:
            text += " horrible awful nasty"
        if kind == 2:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en", "src1", len(text), "z"))
        if i % 5:
            labels.append((i, 0 if kind == 2 else 1, 1 if kind == 1 else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (9_999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, marks).collect()}
    new = [i for i in range(400) if i % 5 == 0]
    assert np.mean([got[i]["kept"] == (i % 4 in (0, 3)) for i in new]) >= 0.95
    kept = quality_classifier.good(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_scores_equal_a_plain_version(spark, small):
    import math

    docs = spark.read.parquet(small + "/documents.parquet")
    model = quality_classifier.fit(docs, spark.read.parquet(small + "/labels.parquet"))
    got = {r["doc_id"]: r for r in quality_classifier.op3_quality_classifier(spark, small).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for r in docs.collect():
        text = r["text"] or ""
        odds = model.text.bias + sum(model.text.weights[i] for w, i in model.index.items() if w in quality_classifier.terms_of(text))
        odds += sum(a * b for a, b in zip(model.text.weights[len(model.index) :], quality_classifier.shares(text)))
        meta = model.meta.bias + sum(a * b for a, b in zip(model.meta.weights, quality_classifier.metadata(r["source"], r["lang"], r["n_chars"])))
        views = [c.bias + c.weights[0] * v for c, v in zip(model.calibrated, (odds, meta))]
        both = model.combined.bias + sum(a * b for a, b in zip(model.combined.weights, views))
        mine = got[r["doc_id"]]
        assert np.allclose([mine["score"], mine["content_score"], mine["metadata_score"]], list(map(sigmoid, (both, *views))), atol=1e-4)
        assert mine["kept"] == (mine["score"] >= quality_classifier.KEEP)


def test_held_out_rows_choose_no_terms(spark):
    """Words that only held-out rows have aren't in the vocabulary, and chance labels get chance probabilities."""
    ids = [i for i in range(3000)]
    held = {r["i"]: r["held"] for r in spark.createDataFrame([(i,) for i in ids], "i long").withColumn("doc_id", F.col("i")).select("i", quality_classifier.held_out()).collect()}
    rows = [(i, prose(i, 40) + (" leaked" if held[i] and i % 4 == 0 else ""), "en", "s", 200) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in ids], "doc_id long, quality int, toxic int")
    assert set(held.values()) == {0, 1, 2} and "leaked" not in quality_classifier.fit(docs, marks).index
    got = [r["score"] for r in quality_classifier.classify(docs, marks).collect()]
    assert abs(np.mean(got) - 0.75) < 0.05


def test_the_classifier_without_labels_or_rows(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(documents, none)
    assert got.filter("NOT kept OR score <> 0.5").isEmpty() and got.count() == documents.count()
    assert quality_classifier.classify(nothing, none).count() == 0
    some = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(documents, some).count() == documents.count()
    assert quality_classifier.good(documents, none).count() == documents.count()


# the pipeline


def test_the_pipeline_runs_its_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(small + "/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, small).cache()
        assert 0 < docs.count() <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.filter("n_tokens <> size(ids)").isEmpty()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
