from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from cloakframe.llm import lloyd, merkle, queries
from pyspark.sql import functions as F

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root of nodes, and of each the siblings on its way as (left, right) by level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            run = i // 8 * 8
            way.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return (nodes[0] if nodes else None), ways


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    keys = sorted(groups)
    trees = []
    for k in keys:
        some = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((some, *plain_tree([plain_leaf(r) for r in some])))
    root, outer = plain_tree([t[1] for t in trees])
    out = []
    for (some, subroot, ways), above in zip(trees, outer):
        for r, way in zip(some, ways):
            told = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                told[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            fold = plain_leaf(told)
            for a, b in way + above:
                fold = sha(a + fold + b)
            out.append((r[0], plain_leaf(r), subroot, root, sha("".join(a + b for a, b in way + above)), fold, fold == root))
    return sorted(out, key=str)


def manifest(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], DOCS).repartition(3)
    found = merkle.manifest(df, queries._lowered, **options)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("p"), merkle.folded("told").alias("f")).withColumn("v", F.col("f") == F.col("root"))
    return sorted(map(tuple, found.collect()), key=str)


def rows_of(n, seed, langs=("en", "de", None, "")):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", None, ""]), rng.choice(langs), rng.choice([1, None]), rng.choice(["Text é", "", None, "UPPER lower", "12:x"])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 70])
def test_manifest_matches_plain_trees(spark, n):
    rows = rows_of(n, n)
    assert manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = rows_of(40, 3) + [(None, "a", "en", 1, "x"), (None, "a", "en", 1, "x"), (3, "a", "en", 2, "y"), (3, "a", "en", 2, "y"), (99, "é", "zz", 3, "Long " * 200_000)]
    assert manifest(spark, rows) == plain_manifest(rows)
    assert manifest(spark, []) == []


def test_many_rounds_of_small_buckets_make_the_same_trees(spark):
    rows = rows_of(600, 8, ("en", "en", "en", "de")) + [(5000 + i, "a", f"l{i:03d}", 1, "t") for i in range(70)]
    want = plain_manifest(rows)
    assert manifest(spark, rows) == want and manifest(spark, rows, levels=2) == want


def plain_codes(rows, entries=64, rounds=2):
    """rows (vec_id, vector, label) in exact Python integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    w = len(kept[0][1]) // 16
    cut = [[v[j * w : j * w + w] for j in range(16)] for _, v, _ in kept]
    books = [[list(c[j]) for c in cut[:entries]] for j in range(16)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((gap(c[j], e), k) for k, e in enumerate(books[j])) for j in range(16)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for j in range(16):
            for k in range(len(books[j])):
                own = [c[j] for c, f in zip(cut, found) if f[j][1] == k]
                if own:
                    books[j][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, lab), e in zip(kept, error):
        labels[lab] = labels.get(lab, 0) + e
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, labels[lab]) for (i, _, lab), f, e in zip(kept, found, error)]
    return sorted(out, key=str), ",".join(str(x) for b in books for e in b for x in e)


def codes(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, 1, "z") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, part int, code string").repartition(3)
    coded, books = lloyd.compressed(df, **options)
    got = lloyd.with_label_error(coded).select("vec_id", lloyd.hex_code("code").alias("code"), "error", "label_error").collect()
    return sorted(map(tuple, got), key=str), lloyd.written(books)


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim)) * scale
    return [(i, (centres[rng.integers(7)] + rng.normal(size=dim) * 0.3 * scale).tolist(), int(rng.integers(3)) if rng.random() < 0.8 else None) for i in range(n)]


@pytest.mark.parametrize("dim,scale", [(48, 1.0), (32, 9000.0)])
def test_codes_match_plain_lloyd(spark, dim, scale):
    rows = vectors(260, dim, dim, scale)
    rows += [(None, rows[3][1], 1), (5, rows[9][1], 1), (5, rows[9][1], 1), (900, [0.0] * dim, None), (901, None, 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] + [1.0] * (dim - 1), 1)]
    rows += [(904, [None] + [1.0] * (dim - 1), 2)]
    assert codes(spark, rows) == plain_codes(rows)


def test_codes_of_few_and_no_rows(spark):
    rows = vectors(5, 16, 2)
    assert codes(spark, rows) == plain_codes(rows)
    assert codes(spark, [(1, None, 1)]) == ([], "")


def test_vectors_of_another_length_take_no_part(spark):
    rows = vectors(30, 16, 4)
    odd = [(-1, [1.0] * 32, 1), (-2, [1.0] * 15, 1), (-3, [], 1), (-4, [1e9] * 16, 1)]
    assert codes(spark, rows + odd) == plain_codes(rows)


def test_late_rounds_move_only_what_changed(spark):
    rows = spark.createDataFrame(vectors(300, 16, 6), "vec_id long, embedding array<double>, label int")
    cells = lloyd.integers(rows)
    books = lloyd.first_books(cells, 16)
    once = lloyd.assigned(cells, books, 16).cache()
    assert lloyd.contributions(once, 64, 16).agg(F.sum("n")).first()[0] == 300 * 16
    again = lloyd.assigned(once, books, 16)
    assert lloyd.contributions(again, 64, 16).count() == 0
