"""SimHash near duplicates, found through a Gray-order hierarchical index.

Fingerprints that differ in at most h of 64 bits agree on all bits of at least
blocks - h of so many blocks of bits. Each choice of those blocks is a mask; under
each mask, fingerprints with equal masked bits form a group. A group holds at most
2 ** (free bits) distinct fingerprints, whatever the corpus, so no group is hot.
Within a group the fingerprints stand in Gray order, where neighbours differ in few
bits; runs of them form nodes that keep only the bits all members share, up to one
root. A search walks down with the differences accumulated on bits not seen further
up and drops a whole node once they pass h.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, bounded_batches, materialise, parts, text_bytes
from .components import connected_components, forest

FAN = 8
#: Rows of whole groups that one index holds, unless a single group is larger.
BLOCK_ROWS = 1 << 18
#: Comparisons that a search makes at once.
EXPAND_ROWS = 1 << 18


def fingerprint(body: bytes, width: int) -> bytes:
    """SimHash of the word shingles, 8 bytes, highest bit first: bits set in over half of the shingles' XXH64."""
    words = body.lower().split()
    if not words:
        return bytes(8)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        some = shingles[at : at + (1 << 16)]
        digests = b"".join([xxhash.xxh64_digest(s, 42) for s in some])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles)).tobytes()


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of whole texts: A-Z in lower case, words parted by ASCII white space."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = b"".join(fingerprint(body, width) for body in blobs(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(found, ">u8").astype(np.uint64).view(np.int64))], ["doc_id", "fp"])

    return text_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def masks(distance: int, blocks: int) -> list[int]:
    """A signed mask for each choice of blocks - distance blocks of the 64 bits."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(bounds, bounds[1:])]
    chosen = [sum(c) for c in combinations(each, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray code sequence."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchical index over groups of fingerprints of one or more words; rows of a group stand together in Gray order.

    label: fingerprints of one group that have the same label aren't compared.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray, label: np.ndarray | None = None):
        self.label = np.arange(len(fp)) if label is None else label
        pattern, owner, low, high = fp.reshape(len(fp), -1), group, self.label, self.label
        shared = np.full(pattern.shape, ~np.uint64(0))
        self.fp = pattern
        self.levels: list[tuple[np.ndarray, ...]] = []
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
            heads = np.flatnonzero(place % FAN == 0)
            ones = np.bitwise_and.reduceat(pattern | ~shared, heads)
            zeros = np.bitwise_and.reduceat(~pattern | ~shared, heads)
            common = np.bitwise_and.reduceat(shared, heads) & (ones | zeros)
            self.levels.append((pattern & shared, shared, heads, np.r_[heads[1:], len(owner)], low, high))
            pattern, shared, owner = ones & common, common, owner[heads]
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            if len(owner) == 1 or (owner[1:] != owner[:-1]).all():
                break
        self.roots = (pattern, shared)
        self.root_of = np.cumsum(np.r_[False, group[1:] != group[:-1]])

    def pairs(self, distance: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row pairs i < j of one group and different labels, and in how many bits they differ, at most distance (of all, or of each row i)."""
        distance = np.broadcast_to(distance, len(self.fp))
        query, node, seen = np.arange(len(self.fp)), self.root_of, self.roots[1][self.root_of]
        apart = np.bitwise_count((self.fp ^ self.roots[0][node]) & seen).sum(1, dtype=np.int64)
        stack = [(len(self.levels) - 1, query, node, seen, apart)]
        while stack:
            level, query, node, seen, apart = stack.pop()
            pattern, shared, lo, hi, low, high = self.levels[level]
            n = hi[node] - lo[node]
            if n.sum() > EXPAND_ROWS and len(query) > 1:
                half = len(query) // 2
                stack += [(level, query[x], node[x], seen[x], apart[x]) for x in (slice(half, None), slice(half))]
                continue
            up = np.repeat(np.arange(len(node)), n)
            child = np.repeat(lo[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            query, seen, apart = query[up], seen[up], apart[up]
            own = self.label[query]
            keep = (low[child] != own) | (high[child] != own)
            query, seen, apart, child = query[keep], seen[keep], apart[keep], child[keep]
            apart = apart + np.bitwise_count((self.fp[query] ^ pattern[child]) & shared[child] & ~seen).sum(1, dtype=np.int64)
            keep = apart <= distance[query]
            if level == 0:
                keep &= child > query
                yield query[keep], child[keep], apart[keep]
            elif keep.any():
                stack.append((level - 1, query[keep], child[keep], shared[child[keep]], apart[keep]))


def _linked(group: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the representatives of linked fingerprints of each group."""
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)])
    several = np.repeat(size > 1, size)
    group, fp, rep = group[several], fp[several], rep[several]
    if not len(fp):
        return rep, rep
    order = np.lexsort([gray_rank(fp), group])
    group, fp, rep = group[order], fp[order], rep[order]
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for i, j, _ in GrayIndex(group, fp).pairs(distance):
        a, b = forest(np.concatenate([a, rep[i]]), np.concatenate([b, rep[j]]))
    return a, b


def classes(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """fp and component: for each distinct fingerprint the smallest doc_id reachable over links of at most distance bits."""
    spark = prints.sparkSession
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    under = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks(distance, blocks)))))
    grouped = (
        reps.where("rep is not null").select("fp", "rep", under.alias("k"))
        .select(F.xxhash64("k.mask", "k.bits").alias("key"), "k.mask", "k.bits", "fp", "rep")
        .repartition(parts(spark), "key")
        .sortWithinPartitions("mask", "bits")
        .drop("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        edges = (np.empty(0, np.int64), np.empty(0, np.int64))

        def flush(last: bool) -> None:
            nonlocal held, edges
            mask, bits, fp, rep = (np.concatenate(x) for x in zip(*held))
            group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
            whole = len(group) if last else int(np.searchsorted(group, group[-1]))
            a, b = _linked(group[:whole], fp[:whole].view(np.uint64), rep[:whole], distance)
            edges = forest(np.concatenate([edges[0], a]), np.concatenate([edges[1], b]))
            held = [[mask[whole:], bits[whole:], fp[whole:], rep[whole:]]]

        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                flush(False)
                size = len(held[0][0])
        if held:
            flush(True)
        yield pa.record_batch([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])

    components = connected_components(grouped.mapInArrow(run, "a long, b long"))
    return reps.join(components, reps.rep == components.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 2, blocks: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document.

    A null or empty text, or one of white space, has fingerprint zero and is linked
    like any other. Fewer words than width make one shingle; a very long text is taken
    whole, by one task, which holds its words once. Rows with equal texts
    share a class; rows with a repeated doc_id each come out; rows with a null doc_id
    don't lend their id to a class, and a class of such rows alone has a null id.
    Other columns are ignored; no rows give no rows.
    """
    prints = materialise(fingerprints(docs, width, id_col, text_col))
    found = materialise(classes(prints, distance, blocks))
    return prints.join(found, "fp").select("doc_id", "fp", F.col("component").alias("component_id"))


def numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with row_no: the id where ids are unique, else the place by id (null last) among all rows."""
    odd = docs.groupBy(id_col).agg(F.count("*").alias("c")).where(F.col(id_col).isNull() | (F.col("c") > 1)).limit(1).count()
    if not odd:
        return docs.withColumn("row_no", F.col(id_col).cast("long"))
    order = F.col(id_col).asc_nulls_last()
    return materialise(docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("row_no", F.monotonically_increasing_id()))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
