from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from cloakframe.llm import similar, simhash
from cloakframe.llm.components import connected_components, forest

SCHEMA = "doc_id long, text string, lang string, fp string, component string"


def plain_fingerprint(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < width else [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def check(spark, rows, width, distance):
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df, width, distance).collect()
    prints = {i: plain_fingerprint(t, width) for i, t in rows}
    want = plain_components(prints, distance)
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == {(i, prints[i], want[i]) for i in prints}
    assert len(got) == len(rows)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(50)]
    base = [rng.choices(vocab, k=rng.randint(1, 120)) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "ONE"), (4, "one"), (5, "long " * 3000)]
    for i in range(6, 150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    check(spark, rows, 3, 2)
    check(spark, rows, 5, 3)


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (None, "x y z q"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df, 3).collect()), key=str)
    assert got == sorted([(None, 4), (None, None), (4, 4), (4, 4)], key=str)


def test_index_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, np.uint64)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 20, 60, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 60, np.uint64)) for c in centre]))
    group = np.sort(rng.integers(0, 3, len(fp)))
    order = np.lexsort([simhash.gray_rank(fp), group])
    group, fp = group[order], fp[order]
    got = {(i, j) for a, b, _ in simhash.GrayIndex(group, fp).pairs(2) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("distance,blocks", [(2, 7), (6, 9)])
def test_masks_cover_every_difference(distance, blocks):
    rng = random.Random(2)
    found = simhash.masks(distance, blocks)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), distance))
        assert any(m % 2**64 & flips == 0 for m in found)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(table, few=0).collect()}
    assert got == {r.node: r.component for r in connected_components(table).collect()}
    assert connected_components(table.limit(0)).collect() == []
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {201: 200, 202: 200}
    a, b = (np.array(x) for x in zip(*edges))
    node, root = forest(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == got


@pytest.mark.parametrize("hot,most", [(1024, 16), (20, 1)])
def test_similar_links_all_pairs_of_the_jaccard_limit_and_no_other(spark, hot, most):
    """Isolated pairs about the limit, groups with many members, and repeated sets, against brute force."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [None, "", " \n", "ONE", "one", "one two"]
    for flips in (1, 2, 3, 4, 5, 6):
        for _ in range(40):
            base = [word() for _ in range(200)]
            copy = list(base)
            for at in rng.sample(range(200), flips):
                copy[at] = word()
            texts += [" ".join(base), " ".join(copy)]
    for n, flips in ((90, 4), (60, 2)):
        base = [word() for _ in range(150)]
        for _ in range(n):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(0, flips)):
                copy[at] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(20)] + passage) for _ in range(30)]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n_links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                n_links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar(df, hot=hot, most=most).collect()}
    assert n_links > 1000 and got == {i: find(i) for i in range(len(texts))}
    assert similar.similar(df.limit(0)).collect() == []
