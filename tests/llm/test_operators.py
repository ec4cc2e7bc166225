from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cloakframe.llm import ann, chat, decontam, html_extract, mixing, quality, warc
from cloakframe.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["###", " </turn>\n", "\\", "\\b", "\\h", "<", ":", "### assistant: ", "é漢", "", " ", "\n"]
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, 0, None]), rng.choice(["user", "assistant", "a:b #<", None]), rng.choice([None, "".join(rng.choices(bits, k=5))]), "clash"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string")
    examples = chat.format_examples(df)
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append((turn is not None, turn or 0, role or "", text or ""))
    laid = defaultdict(list)
    for e in examples.collect():
        laid[e.conv_id].append(e)
    for r in chat.read_examples(examples).collect():
        turns = [t[2:] for t in sorted(want[r.conv_id], key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(e.context) + len(e.target) for e in laid[r.conv_id])
    assert chat.read_examples(chat.format_examples(df.limit(0))).collect() == []


def test_gbdt_learns_and_repeats():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    model = quality.train(x[:600], y[:600])
    assert ((model.score(x[600:]) > 0.5) == y[600:]).mean() > 0.93
    assert (quality.train(x[:600], y[:600]).score(x) == model.score(x)).all()
    assert (quality.train(x[:0], y[:0]).score(x) == 0.5).all()
    assert quality.train(x, np.ones(800)).score(x).min() > 0.9


def test_flat_trees_score_as_walked_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)).round(1)
    model = quality.train(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=12)
    for row, score in zip(x[:60], model.score(x[:60])):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_histogram_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    bins, features, least, l2 = 8, 3, 4, 1.0
    for _ in range(20):
        binned = rng.integers(0, bins, (60, features))
        grad, hess = rng.normal(size=60), rng.uniform(0.05, 0.25, 60)
        gain = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + l2)  # noqa: E731, B023
        best = {}
        for f in range(features):
            for b in range(bins):
                low = binned[:, f] <= b
                if least <= low.sum() <= 60 - least:
                    best[f, b] = gain(low) + gain(~low) - gain(np.ones(60, bool))
        got = quality._split(binned + np.arange(features) * bins, grad, hess, features, bins, least, l2)
        top = max(best.values())
        assert (got is None and top <= 1e-6) or abs(best[got] - top) < 1e-9


def test_quality_query_matches_a_plain_version(spark):
    """Statistics, choice of rows, training and scores of the query, worked out without Spark."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    stats = {i: np.array(quality.statistics(t), np.float32).astype(float) for i, t in docs.items()}
    rows = sorted(i for i in docs if i in known and not out[i])
    model = quality.train(np.array([stats[i] for i in rows]), np.array([known[i] for i in rows], float))
    want = model.score(np.array([stats[i] for i in sorted(docs)]))
    got = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, sf).collect()}
    assert sorted(got) == sorted(docs)
    for i, s in zip(sorted(docs), want):
        assert abs(got[i].score - s) < 1e-9 and got[i].held_out == out[i] and got[i].predicted == int(got[i].score >= 0.3)


def test_decontamination_of_repeated_rows_and_null_ids(spark):
    item = "the quick brown fox jumps over the lazy dog while a slow grey cat sleeps all day long"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, ""), (3, None)], "item_id long, text string")
    rows = [(7, f"so {item} ends"), (7, f"so {item} ends"), (None, item), (8, "nothing of it"), (9, None)]
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    n = len(item.split()) - 12
    assert got == {(7, 1): 4 * n, (7, None): 2 * n, (None, 1): 2 * n, (None, None): n}
    assert decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).collect() == []


def test_conversations_without_an_id_are_one(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (None, None, None, None)]
    got = chat.read_examples(chat.format_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(None, 3, 1)]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    odd = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "x " * 50000, "s")], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.score(odd, labels).collect()] == [0.5] * 3
    assert quality.keep(odd, labels).columns == odd.columns and quality.keep(odd.limit(0), labels).count() == 0


def test_decontamination_by_templates(spark):
    item = "If Anna walks 5 km to town and Anna pays 30 euros then how many euros does she keep of 80"
    changed = item.replace("Anna", "Bob").replace("5", "7.25").replace("30", "41").replace("80", "99")
    broken = item.replace("Anna pays", "Carl pays")
    docs = [(1, f"noise here. {item} more"), (2, f"So: {changed}!"), (3, broken), (4, "nothing of the kind " * 20), (5, None), (6, ""), (7, "all four short words here ok"), (None, item)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, w string, n int")
    bench = spark.createDataFrame([(9, item, "c"), (8, "four short words here ok", "c"), (7, "too short", "c"), (6, None, "c")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(df, bench).collect()}
    assert set(got) == {1, 2, 7, None} and got[1] == [9] and got[7] == [8]
    assert decontam.contaminated(df.limit(0), bench).collect() == [] and decontam.contaminated(df, bench.limit(0)).collect() == []
    plans = decontam.matches(df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans


def found_items(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r.item_ids for r in decontam.contaminated(df, bench).collect()}


def test_decontamination_of_many_slots_and_short_items_by_values(spark):
    item = "Compute the sum of 3 5 7 9 11 13 15 17 19 21 23 25 27 29 and 31 exactly"
    docs = [f"so {item} or not", item.replace("17", "18").replace("11", "12").replace("23", "24").replace("5 7", "5 8").replace("29", "30"), "is the capital Paris then", "is the capital Rome then", "add 2 3 now"]
    assert found_items(spark, docs, [item, "Capital Paris", "2 3", "", "..."]) == {0: [0], 2: [1], 4: [2]}


def test_decontamination_of_names_at_any_place(spark):
    item = "Anna buys 3 apples at the market. Ben buys 4 pears there. Cara buys 9 plums. How many pieces"
    short = "Ben saw the big dog run home"
    other = item.replace("Anna", "Eva").replace("Ben", "Finn").replace("Cara", "Gina")
    docs = [item, other, other.replace(". ", ".\n"), f'"{other}"', "then (Carl saw the big dog run home)", "then Carl saw\nthe big dog run home", "the 7 Carl saw the big cat run home"]
    wrapped = "we know that Anna pays 5 to old Ben who keeps all of it for Cara at home"
    docs.append(wrapped.replace(" Anna", "\nEva").replace(" Ben", "\nFinn").replace(" Cara", "\nGina"))
    assert found_items(spark, docs, [item, short, wrapped]) == {0: [0], 1: [0], 2: [0], 3: [0], 4: [1], 5: [1], 7: [2]}


def test_decontamination_where_two_values_become_the_same(spark):
    item = "if we buy 3 rolls and then take 4 loaves to the old mill what is left of it at night"
    docs = [item.replace("3", "5").replace("4", "5"), item.replace("4", "3")]
    split = "if we buy 3 rolls and then take 3 loaves to the old mill what is left of it by day"
    assert found_items(spark, [*docs, split.replace("3 rolls", "5 rolls")], [item]) == {0: [0], 1: [0], 2: [0]}
    assert found_items(spark, [split.replace("3 rolls", "5 rolls").replace("3 loaves", "6 loaves")], [split.replace(" at night", "")[:70]]) == {}


def test_raking_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice("ab"), rng.choice(["en", "fr", None])) for i in range(400)] + [(None, None, None, None), (400, "", "a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("rate", F.lit(1))
    targets = {d: spark.createDataFrame(t, f"k_{d} string, target double") for d, t in {"source": [("a", 0.8), ("b", 0.2)], "lang": [("en", 0.5), ("fr", 0.3), ("", 0.2)]}.items()}
    out = mixing.mix(df, targets, share=0.5, sweeps=30, topic=F.lit("t"))
    got = out.select("source", "n_tokens", "rate", "copies").collect()
    cells = defaultdict(float)
    rates = {(r.source, r.rate) for r in got}
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    for source, lang in {(s, l) for _, t, s, l in rows if t}:
        own = [len(t.split()) for _, t, s, l in rows if t and (s, l) == (source, lang)]
        rate = out.where((F.col("source") == source) & F.col("lang").eqNullSafe(F.lit(lang))).select("rate").first()
        cells[source] += sum(own) * rate.rate
    assert cells["a"] / total == pytest.approx(0.4, rel=1e-6) and cells["b"] / total == pytest.approx(0.1, rel=1e-6)
    assert all(r.copies >= 1 for r in got) and rates
    assert mixing.mix(df.limit(0)).collect() == []


def test_nearest_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    x[100:700] = x[100]
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    rows += [(5000, None, "l"), (5100, [0.0] * 24, "l"), (5200, [float("nan")] + [1.0] * 23, "l"), (5300, [1.0], "l"), (None, x[0].tolist(), "l"), (200, x[200].tolist(), "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = sorted(zip(d.tolist(), range(3000)))[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        hit += len({v for _, v in want} & {v for _, v in got[q]})
    assert set(got) == {*range(0, 3000, 100), 5300} and hit / 300 >= 0.9
    assert got[200] == [(0.0, v) for v in range(100, 111) if v != 200][:10]
    assert ann.nearest(df.limit(0)).collect() == []


def test_short_list_of_codes_decides_among_long_lists(spark):
    """Lists of 1,000 and more vectors without clusters: the exact measure sees 200 of 12,000 rows of a query."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.nearest(df, every=200, recall=0.999).collect():
        found[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 12_000, 200):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hit / 600 >= 0.9


def test_neighbours_within_dense_groups_and_of_uneven_lengths(spark):
    """Groups far denser than codes can tell, and lengths of several orders: no fixed number of rows by code holds the neighbours."""
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(size=(4, 32))[rng.integers(0, 4, 4000)] + 0.01 * rng.normal(size=(4000, 32)), rng.normal(size=(2000, 32)) * np.exp(2 * rng.normal(size=(2000, 1)))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(df, every=50).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 6000, 50):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(found[q]) & set(np.argsort(d)[:10].tolist()))
    assert all(len(v) == 10 for v in found.values()) and hit / 1200 >= 0.95


def test_four_bit_scan_follows_exact_products():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16))
    model = ann.fit(x, 4)
    y = ann.augmented(x)
    lists = ann._nearest(y, model.centres)
    codes = ann.encode(model, y, lists)
    own = lists == 0
    exact = np.c_[x[:5], np.ones(5)] @ y[own].T
    approximate = ann.scan(model, x[:5], codes[own], lists[own])
    assert codes.max() < 16 and all(np.corrcoef(a, b)[0, 1] > 0.9 and abs(a - b).mean() < 0.5 * a.std() for a, b in zip(exact, approximate))
    assert (ann.unpacked(ann.packed(codes), model.pairs) == codes).all()


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200
    pages = [(5, "http://WWW.A.example/x?q=1", big), (3, "http://a.example/x?q=1", big), (9, None, big), (1, "u\r\nv", None), (2, "", ""), (4, "http://b.example/", "short"), (6, "http://b.example/", "short"), (7, "http://c.example/", "WARC/1.1\r\n\r\n" + "z" * 200), (3, "http://a.example/x?q=1", big)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = warc.capture_histories(df).collect()
    for r in got:
        payload = next(h for i, _, h in pages if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(payload.encode()), hashlib.sha256(payload.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (5, 9) else ("response", None))
    keys = [(r.urlkey, r.captured) for r in got]
    assert len(got) == len(pages) and keys == sorted(keys)
    assert warc.capture_histories(df.limit(0)).collect() == []


def test_loser_tree_merges_sources_that_come_and_go():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16, 23):
        waiting = sorted((sorted((rng.randint(0, 9999), i, j) for j in range(rng.randint(1, 6))) for i in range(k)), key=lambda r: r[0])
        want = sorted(x for r in waiting for x in r)
        held, got = [], []
        tree = warc.LoserTree(lambda i: held[i][0] if held[i] else None)
        while True:
            best = tree.winner
            if waiting and (best is None or held[best][0] >= waiting[0][0]):
                spent = [i for i, h in enumerate(held) if not h]
                i = spent[0] if spent else len(held)
                if not spent:
                    held.append([])
                held[i] = waiting.pop(0)
                tree.update(i)
            elif best is None:
                break
            else:
                got.append(held[best].pop(0))
                tree.update(best)
        assert got == want


def test_index_merge_is_ordered_over_partitions_and_holds_few_chunks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, rng.choice(["http://b.org/x", "http://a.org/y?q=1", f"http://c.org/{rng.randint(0, 40)}", None]), f"<p>{i}") for i in range(700)]
    df = spark.createDataFrame([*rows, (None, "http://b.org/x", "n"), (5, "http://b.org/x", "again")], "page_id long, url string, html string").repartition(6)
    path = warc.shared_dir(spark)
    warc.write_archives(df, path, captured=F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)) % 7)
    runs = warc.read_runs(spark, path).toArrow().to_batches()
    index = [r for b in runs for x in b.column("rows") for r in warc._unpack(x.as_py()).to_pylist()]
    order = lambda r: warc._order(*(r[c] for c in warc._KEY))
    merged = warc.merge_runs(warc.read_runs(spark, path))
    got = [r.asDict() for r in merged.collect()]
    assert got == sorted(index, key=order) and len(got) == 702
    assert merged.rdd.getNumPartitions() > 1
    # In chunks of three rows, by two key ranges.
    keys = sorted(map(order, index))
    by_run = defaultdict(list)
    for r in sorted(index, key=order):
        by_run[r["archive"]].append(r)
    chunks = sorted((one[a : a + 3] for one in by_run.values() for a in range(0, len(one), 3)), key=lambda c: order(c[0]))
    batches = [warc.pa.RecordBatch.from_pylist(c, warc._INDEX) for c in chunks]
    for low, high in ((None, keys[300]), (keys[300], None), (None, None), (keys[10], keys[11])):
        some = [r for b in warc.merge_chunks(iter(batches), low, high) for r in b.to_pylist()]
        assert list(map(order, some)) == [k for k in keys if (low is None or k >= low) and (high is None or k < high)]


def test_every_operator_is_registered():
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(ORACLE) <= set(QUERIES)


def test_very_long_texts(spark):
    """Texts of several hundred kilobytes go through whole."""
    words = [f"w{i % 613}q{i}" for i in range(60_000)]
    long, item = " ".join(words), "the quick brown fox jumps over the lazy dog while a slow grey cat sleeps all day long"
    page = f"<nav>menu</nav><article><p>{long}</p></article>"
    pages = spark.createDataFrame([(1, "http://a.org/1", page), (2, "http://a.org/2", page), (3, "http://a.org/3", "<p>x</p>")], "page_id long, url string, html string")
    got = {r.page_id: r.asDict() for r in warc.capture_histories(pages).collect()}
    assert got[1]["payload_bytes"] == len(page) and got[1]["payload_digest"] == hashlib.sha256(page.encode()).hexdigest()
    assert [got[i]["refers_to"] for i in (1, 2, 3)] == [None, 1, None]
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == {1: long, 2: long, 3: "x"}
    docs = spark.createDataFrame([(1, f"{long} {item} {long}", "en", "s"), (2, long, "en", "s")], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_ids) for r in decontam.contaminated(docs, bench).collect()] == [(1, [5])]
    assert {r.doc_id: r.n_tokens for r in mixing.mix(docs, share=2.0).collect()} == {1: 120_000 + len(item.split()), 2: 60_000}
    talk = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert [(r.n_turns, r.loss_chars) for r in chat.read_examples(chat.format_examples(talk)).collect()] == [(2, len(long))]


def test_decontamination_without_the_table_of_leads(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog while Anna sells 3 apples to Ben all day long"
    bench = spark.createDataFrame([(1, item), (2, "six words are in this item"), (3, "1 2 3")], "item_id long, text string")
    rows = [(1, item.replace("Anna", "Cora").replace("3", "7")), (2, "so six words are in this item too"), (3, "1 2 3"), (4, "1 2 4"), (5, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, decontam.matches(docs, bench).collect()))
    monkeypatch.setattr(decontam, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, decontam.matches(docs, bench).collect())) == found and {r[0] for r in found} == {1, 2, 3}
