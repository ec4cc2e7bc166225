from __future__ import annotations

import random
import zlib

import corpus_pipeline as p
import duckdb
import numpy as np
import pytest
from cloakframe.llm import quality
from cloakframe.llm.queries import ORACLE


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good texts, junk, copies, a shared passage and a leaked benchmark item."""
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + "."
    item, passage = text(30), text(60)
    docs = [(i, text(rng.randint(60, 150))) for i in range(60)]
    docs += [(60 + i, " ".join(w + rng.choice(["***", "$$$"]) for w in text(80).split())) for i in range(30)]
    near = docs[3][1].split()
    near[20] = "other"
    docs += [(100, docs[2][1]), (101, " ".join(near)), (102, f"{text(40)} {passage} {text(40)}"), (103, f"{text(40)} {passage} {text(40)}"), (104, f"{text(60)} {item} {text(60)}"), (105, None)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 90), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, passage


def test_each_stage_catches_its_cases_and_keeps_the_rest(spark, tables):
    sf, passage = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {*range(60), 100, 101, 102, 103, 104}
    seen = {}
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/out{i}")
        docs = spark.read.parquet(f"{sf}/out{i}")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    steps = list(seen.values())
    assert want <= set(steps[0]) and not set(range(60, 90)) & set(steps[0])
    assert set(steps[1]) - {105} == want - {100, 101}
    assert set(steps[2]) == set(steps[1]) and passage in steps[2][102] and passage not in steps[2][103]
    assert set(steps[3]) == set(steps[2]) - {104}
    assert set(steps[4]) <= set(steps[3]) and steps[4]


def test_run_is_the_stages_one_after_the_other(spark, tables):
    sf, _ = tables
    assert {r.doc_id for r in p.run(spark, sf).collect()} == {r.doc_id for r in spark.read.parquet(f"{sf}/out4").collect()}


def test_decontamination_goes_by_rows_where_ids_are_null_or_repeated(spark, tables):
    sf, _ = tables
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, item), (None, "clean"), (7, f"so {item}"), (7, "clean too"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = p.decontamination_stage(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, "clean"), (7, "clean too"), (8, None)], key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, row_no string, component string"


def odd_rows(item):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = [(None, None), (None, "null id"), (1, ""), (1, ""), (2, " \n\t"), (3, "same text of a row that stands twice " * 3), (3, "same text of a row that stands twice " * 3), (4, long), (5, f"{long} {item}"), (6, f"so {item} it goes")]
    return [(i, t, lang, source, None if t is None else len(t), "c", "r", "k") for (i, t), lang, source in zip(texts, ["en", None] * 5, [None, "s1", "s2", "s3", "s4"] * 2)]


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_odd_rows_and_empty_tables_in_every_stage(spark, tables, name, stage):
    sf, _ = tables
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = odd_rows(item)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    last = name == p.STAGES[-1][0]
    want = [c for c in docs.columns if c != "copies"] + ["rate", "copies"] if last else docs.columns
    assert stage(spark, docs.limit(0), sf).columns == want and stage(spark, docs.limit(0), sf).count() == 0
    got = stage(spark, docs, sf).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:40])
    kept = sorted(map(key, got))
    given = sorted((r[0] is None, r[0] or 0, (r[1] or "")[:40]) for r in rows)
    if name == "SimHash near-dedup":
        # One each of the empty texts (of the smallest id), of the repeated row and of the long texts.
        assert [k[1:] for k in kept if not k[0]] == [(1, ""), (3, rows[5][1][:40]), (4, rows[7][1][:40]), (6, rows[9][1][:40])]
        assert [k[2] for k in kept if k[0]] == ["null id"]
    elif name == "suffix-array dedup":
        assert len(kept) == len(given) and sum(r["text"] is None for r in got) == 1
        texts = {r["doc_id"]: r["text"] for r in got}
        assert texts[5] == f" {item}"[-len(texts[5]) :] and len(texts[5]) <= len(item) + 50 and texts[4] == rows[7][1]
        assert sorted(len(r["text"]) for r in got if r["doc_id"] == 3)[0] < 50
    elif name == "benchmark decontamination":
        assert kept == [k for k in given if k[1] not in (5, 6)]
    elif last:
        assert set(kept) <= set(given) and all(r["copies"] >= 1 for r in got)


def test_near_copies_of_one_text_in_a_large_group(spark):
    """5,000 near copies and 300 others: one stays of the group, all others do."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(base[: 58 - i % 3] + [word(), word()][: 1 + i % 2])) for i in range(5000)]
    rows += [(10_000 + i, " ".join([*base[:6], *(word() for _ in range(50))])) for i in range(300)]
    kept = {r.doc_id for r in p.similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0} | {10_000 + i for i in range(300)}


def test_run_matches_a_plain_version(spark, tables):
    """All stages worked out without Spark: plain statistics and trees, all pairs, all substrings, and the SQL of decontamination and mixing."""
    sf, _ = tables
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stats = {i: np.array(quality.statistics((r.text or "").encode()), np.float32).astype(float) for i, r in docs.items()}
    train = sorted(i for i in known if i in docs and zlib.crc32(str(i).encode()) % 5)
    model = quality.train(np.array([stats[i] for i in train]), np.array([known[i] for i in train], float))
    kept = [i for i in sorted(docs) if model.score(stats[i][None])[0] >= 0.3]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = {i: shingles(docs[i].text) for i in kept}
    first = {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((first[i], first[j]))
                first = {k: low if f == high else f for k, f in first.items()}
    kept = [i for i in kept if first[i] == i]
    seen, texts = set(), {}
    for i in kept:
        body = (docs[i].text or "").encode()
        own = [body[k : k + 50] for k in range(len(body) - 49)]
        gone = {x for k, w in enumerate(own) if w in seen for x in range(k, k + 50)}
        seen |= set(own)
        texts[i] = None if docs[i].text is None else bytes(b for k, b in enumerate(body) if k not in gone).decode("utf-8", "ignore")
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(i, texts[i], docs[i].lang, docs[i].source) for i in kept])
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet/*.parquet'")
    found = [r[0] for r in db.execute(f"SELECT doc_id FROM ({ORACLE['op7_benchmark_decontamination']})").fetchall()]
    db.executemany("DELETE FROM documents WHERE doc_id = ?", [(i,) for i in found])
    mixed = db.execute(f"SELECT doc_id, copies FROM ({ORACLE['op9_mixing_to_targets']})").fetchall()
    assert found == [104]
    got = {r.doc_id: (r.text, r.copies) for r in p.run(spark, sf).collect()}
    assert got == {i: (texts[i], c) for i, c in mixed}
