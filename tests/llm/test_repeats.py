from __future__ import annotations

import random

import numpy as np
import pytest
from cloakframe.llm import seeds, substring_dedup, suffix_dedup
from cloakframe.llm.suffix_dedup import deep_shallow_sort

SCHEMA = "doc_id long, text string, key string, first string, kept string, anchor string"


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(30)]
    passages = [rng.choices(vocab, k=rng.randint(5, 25)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "x " * 60), (4, "a b " * 30), (5, "q" * 200)]
    for i in range(6, 70):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices(vocab, k=rng.randint(0, 8)) + rng.choice(passages)[rng.randint(0, 2) :]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(80, rows[10][1]), (81, rows[10][1])]


def plain_words(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for i, words in enumerate(texts):
        for p in range(len(words) - window + 1):
            seen.setdefault(tuple(words[p : p + window]), []).append((i, p))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + window))
    return [(len(w), len(g), b" ".join(x for k, x in enumerate(w) if k not in g).decode()) for w, g in zip(texts, gone)]


def plain_bytes(rows, window):
    """rows in the order in which they count as earlier; equal places share a rank."""
    first, texts = {}, [(t or "").encode() for _, t in rows]
    for i, text in enumerate(texts):
        for p in range(len(text) - window + 1):
            first.setdefault(text[p : p + window], i)
    out = []
    for i, text in enumerate(texts):
        gone = set()
        for p in range(len(text) - window + 1):
            if first[text[p : p + window]] < i:
                gone.update(range(p, p + window))
        out.append((len(text), len(gone), bytes(b for k, b in enumerate(text) if k not in gone)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "f", "z", "a") for i, t in rows], SCHEMA).repartition(3)


def removed(spans):
    return sum(s.stop - s.start for s in spans)


@pytest.mark.parametrize("crowded", [4096, 1])
def test_repeated_passages_match_brute_force(spark, crowded):
    rows = corpus()
    got = {r.doc_id: (r.n_words, removed(r.spans), r.kept) for r in substring_dedup.repeated_passages(frame(spark, rows), window=7, gram=3, crowded=crowded).collect()}
    assert got == {i: x for (i, _), x in zip(rows, plain_words(rows, 7))}


@pytest.mark.parametrize("crowded", [4096, 1])
@pytest.mark.parametrize("gram", [16, 4])
def test_earlier_strings_match_brute_force(spark, crowded, gram):
    rows = corpus()
    got = {r.doc_id: (r.n_bytes, removed(r.spans), bytes(r.kept)) for r in suffix_dedup.earlier_strings(frame(spark, rows), window=20, gram=gram, crowded=crowded).collect()}
    assert got == {i: x for (i, _), x in zip(rows, plain_bytes(rows, 20))}


def test_null_and_repeated_ids_and_whole_columns(spark):
    rows = [(None, "b" * 30), (None, "a" * 30), (7, "c" * 30), (7, "c" * 30), (7, None)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, removed(r.spans)) for r in suffix_dedup.earlier_strings(frame(spark, rows), window=20, gram=16).collect())
    assert got == sorted((i is not None, i or 0, n, g) for (i, _), (n, g, _) in zip(order, plain_bytes(order, 20)))
    kept = suffix_dedup.without_earlier_strings(frame(spark, rows), window=20, gram=16)
    assert kept.columns == ["doc_id", "text", "key", "first", "kept", "anchor"] and kept.count() == 5
    words = substring_dedup.repeated_passages(frame(spark, [(None, "x y " * 9), (None, "z")]), window=7, gram=3).collect()
    assert sorted((r.n_words, removed(r.spans)) for r in words) == [(1, 0), (18, 18)]


def test_empty_tables(spark):
    assert substring_dedup.repeated_passages(frame(spark, [])).collect() == []
    assert suffix_dedup.earlier_strings(frame(spark, [])).collect() == []


def test_deep_shallow_sort_orders_and_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, (40, 50), np.uint8)
    text = base[rng.integers(0, 40, 3000)].copy()
    text[::3, 40:] = rng.integers(97, 99, (1000, 10))
    order, group = deep_shallow_sort(text)
    rows = [bytes(text[i]) for i in order]
    assert rows == sorted(rows)
    assert all((group[i] == group[i + 1]) == (rows[i] == rows[i + 1]) for i in range(len(rows) - 1))


@pytest.mark.parametrize("texts", [seeds.Bytes, seeds.Words])
def test_chunks_do_not_change_what_windows_mean(monkeypatch, texts):
    rng = random.Random(2)
    bodies = [bytes(rng.choices(b"ab  ", k=rng.choice([0, 3, 9, 400]))) for _ in range(9)]
    shape = seeds.Shape(9, 4)

    def windows():
        here = texts(bodies)
        s = seeds.stretches(here, shape)
        return here, [(int(a), int(f + k)) for a, f, n in zip(s.anchor, s.first, s.n) for k in range(n)]

    here, whole = windows()
    monkeypatch.setattr(seeds, "CHUNK", 50)
    assert windows()[1] == whole
    assert [p for _, p in whole] == [p for a, z in zip(here.bounds, here.bounds[1:]) for p in range(a, z - 8)]


def test_long_anchors_are_sorted_place_by_place(monkeypatch):
    rng = np.random.default_rng(4)
    body = rng.integers(97, 99, 4000, np.uint8)
    begin, n = np.arange(0, 3900, 30), np.full(130, 5)
    least = rng.permutation(130)
    window = 8
    places = seeds.flat(begin, n)
    held = [bytes(body[p : p + window]) for p in places]
    first = {}
    for w, x in zip(held, np.repeat(least, n)):
        first[w] = min(first.get(w, 999), x)
    for most in (1, 100, 10_000):
        monkeypatch.setattr(suffix_dedup, "SORT_ROWS", most)
        assert suffix_dedup.first_to_have(body, begin, n, np.zeros(len(held), np.int64), least, window).tolist() == [first[w] for w in held]


@pytest.mark.parametrize("window,gram", [(60, 16), (70, 8), (5, 6), (5, 0)])
def test_anchors_that_cannot_decide_a_window(window, gram):
    with pytest.raises(ValueError, match="anchor"):
        seeds.Shape(window, gram)
    assert seeds.Shape(60, 30) and seeds.Shape(35, 16) and seeds.Shape(50, 26)
