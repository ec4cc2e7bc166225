"""Merkle manifest: hashes of a table as trees of fan-out 8, with a proof for every row.

Leaves are hashed in columns and get places within their tree by a range sort and counts
of its runs. Aligned buckets of 8^4 consecutive places are whole subtrees; each goes as
Arrow to an executor, where DuckDB computes level after level by an ordered string_agg and
sha256. The roots of buckets are the nodes of the next round, so a round shrinks the table
4,096-fold whatever its size. Back down, each bucket meets the proof of its root, the
outer proof, and DuckDB adds the siblings within the bucket.
"""

from __future__ import annotations

from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, parts

#: Children of a node, and levels of a bucket: 4,096 leaves of about 200 bytes.
FAN = 8
LEVELS = 4


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a minus sign."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


@cache
def _duckdb() -> duckdb.DuckDBPyConnection:
    """One small in-memory DuckDB of a Python worker."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})


def _run(sql: str, **tables: pa.Table) -> pa.Table:
    db = _duckdb()
    for name, rows in tables.items():
        db.register(name, rows)
    try:
        return db.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            db.unregister(name)


def _height(size: int) -> int:
    """Levels above so many nodes."""
    height = 0
    while FAN**height < size:
        height += 1
    return height


def _levels(size: int, levels: int) -> tuple[int, list[str]]:
    """How many levels a bucket of a tree of so many nodes has, and l0, l1 ... of its nodes as common table expressions."""
    n = min(levels, _height(size))
    steps = ["l0 AS MATERIALIZED (SELECT place AS p, digest AS d FROM nodes)"]
    steps += [f"l{i + 1} AS MATERIALIZED (SELECT p // {FAN} AS p, sha256(string_agg(d, '' ORDER BY p)) AS d FROM l{i} GROUP BY ALL)" for i in range(n)]
    return n, steps


def root_of(nodes: pa.Table, levels: int) -> pa.Table:
    """The root of a bucket, a node of the tree above."""
    n, steps = _levels(nodes["size"][0].as_py(), levels)
    root = _run(f"WITH {', '.join(steps)} SELECT d FROM l{n}", nodes=nodes)["d"]
    size = -(-nodes["size"][0].as_py() // FAN**levels)
    return pa.table([nodes["tree"][:1], nodes["bucket"][:1], pa.array([size], pa.int64()), root], names=["tree", "place", "size", "digest"])


def proofs_of(nodes: pa.Table, outer: pa.Table, levels: int) -> pa.Table:
    """nodes with the siblings on their way up: those of the bucket, then those of its root."""
    n, steps = _levels(nodes["size"][0].as_py(), levels)
    side = f"coalesce(string_agg(d, '') OVER (PARTITION BY p // {FAN} ORDER BY p ROWS BETWEEN %s), '')"
    steps += [f"s{i} AS (SELECT p, {side % 'UNBOUNDED PRECEDING AND 1 PRECEDING'} AS l, {side % '1 FOLLOWING AND UNBOUNDED FOLLOWING'} AS r FROM l{i})" for i in range(n)]
    joins = "".join(f" JOIN s{i} ON s{i}.p = nodes.place // {FAN**i}" for i in range(n))
    inner = {x: f"[{', '.join(f's{i}.{x}' for i in range(n))}]::VARCHAR[]" for x in "lr"}
    sql = f"""WITH {", ".join(steps)} SELECT nodes.*, above.subroot, list_concat({inner["l"]}, above.lefts) AS lefts, list_concat({inner["r"]}, above.rights) AS rights
      FROM nodes{joins}, above"""
    return _run(sql, nodes=nodes, above=outer)


def _bucketed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("place") / FAN**levels).cast("long"))


def _tops(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (tree, place, size, digest) of each round: those given, their bucket roots and so on, until each tree has one node."""
    rounds = [nodes]
    while rounds[-1].where("size > 1").limit(1).count():
        grouped = _bucketed(rounds[-1].where("size > 1"), levels).select("tree", "place", "size", "digest", "bucket").groupBy("tree", "bucket")
        rounds.append(materialise(grouped.applyInArrow(lambda nodes: root_of(nodes, levels), "tree string, place long, size long, digest string")))
    return rounds


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """tree and digest of the one node in which each tree ends."""
    ends = rounds[0].where("size = 1")
    for nodes in rounds[1:]:
        ends = ends.unionByName(nodes.where("size = 1"), allowMissingColumns=True)
    return ends.select("tree", "digest")


def _descended(rounds: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """The first round's nodes with subroot, lefts and rights, from the proofs (tree, subroot, lefts, rights) of the trees' roots."""
    above = None
    for nodes in reversed(rounds):
        single = nodes.where("size = 1").join(ends, "tree")
        if above is not None:
            rows = _bucketed(nodes.where("size > 1"), levels)
            wanted = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", subroot string, lefts array<string>, rights array<string>"
            outer = above.select("tree", F.col("place").alias("bucket"), "subroot", "lefts", "rights")
            found = rows.groupBy("tree", "bucket").cogroup(outer.groupBy("tree", "bucket")).applyInArrow(lambda nodes, outer: proofs_of(nodes, outer, levels), wanted)
            single = single.unionByName(found.drop("bucket"))
        above = single if nodes is rounds[0] else materialise(single)
    return above


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with their place (from 0) among those of their tree, in order, and the size of the tree."""
    keys = [F.col(tree), *(F.col(c).asc_nulls_first() for c in order)]
    at = materialise(rows.repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    run = at.groupBy(tree, F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy(tree)
    run = run.select(tree, "part", "first", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(whole).alias("size"))
    both = at.withColumn("part", F.shiftright("at", 33)).join(materialise(run), [tree, "part"])
    return both.withColumn("place", F.col("at") - F.col("first") + F.col("base")).drop("at", "part", "first", "base")


def manifest(docs: DataFrame, tamper=None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", lang_col: str = "lang", levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, lefts, rights and told (the leaf to be verified) of every row.

    A leaf is the digest of columns. The leaves of a language ascend by id, null ids first, and
    rows of one id by their leaf; a null language is one of its own and comes first, before an
    empty one. lefts and rights hold, level by level, the digests beside the way from the leaf to root.
    A bucket has so many levels. tamper, if given, takes the columns as a dict and returns them as they are to be verified.
    Null and empty fields differ in their leaves. Repeated rows each are a leaf. A very long text is
    hashed by its own row and goes no further. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = {c: F.col(c) for c in columns}
    told = digest(list((tamper(given) if tamper else given).values()))
    tree = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), tree.alias("tree"), digest(list(given.values())).alias("digest"), told.alias("told"))
    rounds = _tops(materialise(placed(leaves, "tree", ["doc_id", "digest"])), levels)
    subroots = materialise(_roots(rounds))
    langs = _tops(materialise(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest"), "tree", ["lang"])), levels)
    root = _roots(langs).select(F.col("digest").alias("root")).first()
    if root is None:
        return leaves.where("false").select("doc_id", F.col("digest").alias("leaf"), *(F.lit("").alias(c) for c in ("subroot", "root")), *(F.array().cast("array<string>").alias(c) for c in ("lefts", "rights")), "told")
    none = F.array().cast("array<string>")
    above = _descended(langs, spark.range(1).select(F.lit("").alias("tree"), F.lit("").alias("subroot"), none.alias("lefts"), none.alias("rights")), levels)
    ends = materialise(above.select(F.col("lang").alias("tree"), F.col("digest").alias("subroot"), "lefts", "rights"))
    found = _descended(rounds, ends, levels)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root.root).alias("root"), "lefts", "rights", "told")


def proof_digest() -> Column:
    """sha256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), ""), 256)


def folded(start: Column | str) -> Column:
    """The root to which a leaf leads with the siblings given."""
    steps = F.zip_with("lefts", "rights", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(steps, F.col(start) if isinstance(start, str) else start, lambda node, s: F.sha2(F.concat(s["a"], node, s["b"]), 256))
