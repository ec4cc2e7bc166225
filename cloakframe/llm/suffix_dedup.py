"""Suffix-array dedup: remove bytes of strings that also start in an earlier document.

Shared anchors bring together the stretches of text that can hold equal strings
(seeds.py). The suffixes of all different stretches of an anchor, cut at the length of
a string, are sorted deep-shallow: multikey quicksort, eight bytes to a character, down
to a shallow depth, then blind tries for the groups that still share that much. Equal
strings then adjoin, and the earliest document of each group keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seeds

#: Characters of eight bytes that the quicksort looks at.
SHALLOW = 2
#: Suffixes sorted at once, unless those of one anchor and place are more.
SORT_ROWS = 150_000


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of keys (n, depth) and a number for each group of equal rows, both in that order.

    All open groups are partitioned in step, each about the key of its middle row.
    """
    order = np.arange(len(keys))
    group, depth = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    while True:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        size = np.diff(np.r_[starts, len(group)])
        open_ = np.repeat(size > 1, size) & (depth < keys.shape[1])
        if not open_.any():
            return order, group
        middle = np.repeat(order[starts + size // 2], size)
        rows = np.flatnonzero(open_)
        at = depth[rows]
        own, pivot = keys[order[rows], at], keys[middle[rows], at]
        part = np.where(own < pivot, 0, np.where(own == pivot, 1, 2))
        by = np.lexsort([part, group[rows]])
        part, old = part[by], group[rows][by]
        order[rows] = order[rows][by]
        depth[rows] = at[by] + (part == 1)
        cut = np.zeros(len(group), bool)
        cut[starts] = True
        cut[rows[1:][(part[1:] != part[:-1]) & (old[1:] == old[:-1])]] = True
        group = cut.cumsum() - 1


def blind_tries(keys: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders each group of rows of keys (n, characters of eight bytes) that share their first depth characters.

    One trie for each group, all grown in step and each node by the one character at
    which it stands: where its rows share the character the node skips it, else it
    branches by the first byte that differs. A row is never compared with a whole other
    row, and what rows share is looked at once. Groups of equal rows stay together.
    """
    order, group = order.copy(), group.copy()
    cut = np.r_[True, group[1:] != group[:-1]][: len(group)]
    rows = np.flatnonzero(~(cut & np.r_[cut[1:], True][: len(cut)])) if depth < keys.shape[1] else np.empty(0, np.int64)
    at = np.full(len(rows), depth)
    while len(rows):
        starts = np.flatnonzero(cut[rows])
        size = np.diff(np.r_[starts, len(rows)])
        own = keys[order[rows], at]
        differs = np.bitwise_or.reduceat(own ^ np.repeat(own[starts], size), starts)
        shift = sum(((differs >> np.uint64(8 * k)) > 0).astype(np.uint64) for k in range(1, 8)) * np.uint64(8)
        inner = np.repeat(differs != 0, size)
        at[~inner] += 1
        if inner.any():
            mine = rows[inner]
            byte, old = (own >> np.repeat(shift, size))[inner] & np.uint64(255), np.repeat(np.arange(len(starts)), size)[inner]
            by = np.lexsort([byte, old])
            order[mine] = order[mine][by]
            byte, old = byte[by], old[by]
            cut[mine[1:][(byte[1:] != byte[:-1]) & (old[1:] == old[:-1])]] = True
        alone = cut[rows] & np.r_[cut, True][rows + 1]
        rows, at = rows[~alone & (at < keys.shape[1])], at[~alone & (at < keys.shape[1])]
    return order, cut.cumsum() - 1


def deep_shallow_sort(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long rows of bytes and a number for each group of equal ones, both in that order."""
    wide = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    wide[:, : text.shape[1]] = text
    keys = wide.view(">u8").astype(np.uint64)
    order, group = multikey_quicksort(keys[:, :SHALLOW])
    return blind_tries(keys, order, group, SHALLOW)


def first_to_have(body: np.ndarray, begin: np.ndarray, n: np.ndarray, unit: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """The least number of all stretches that hold each window of each stretch.

    Stretch i has the windows of body from begin[i] to begin[i] + n[i] - 1, one after the
    other in the result; windows can only be equal where unit, given for each, is.
    """
    which = np.repeat(np.arange(len(n)), n)
    at = seeds.flat(begin, n)
    out = np.empty(len(which), np.int64)
    by = np.argsort(unit, kind="stable")
    ends = np.r_[np.flatnonzero(np.diff(unit[by])) + 1, len(by)]
    done = 0
    while done < len(by):
        upto = ends[max(np.searchsorted(ends, done + SORT_ROWS, "right") - 1, np.searchsorted(ends, done, "right"))]
        rows = by[done:upto]
        order, group = deep_shallow_sort(body[at[rows][:, None] + np.arange(window)])
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out[rows[order]] = np.minimum.reduceat(least[which[rows[order]]], starts)[group]
        done = upto
    return out


def _judge(window: int) -> seeds.Judge:
    def earlier(code: np.ndarray, left: np.ndarray, n: np.ndarray, least: np.ndarray, count: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Bits of the windows that also stand in a stretch of a smaller key."""
        known: dict[bytes, int] = {}
        of = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
        one = np.empty(len(known), np.int64)
        one[of] = np.arange(len(of))
        first = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(first, of, least)
        n = n.astype(np.int64)
        _, inverse, size = np.unique(code[one], return_inverse=True, return_counts=True)
        several = size[inverse] > 1
        bits = np.where(first[of] < least, (np.int64(1) << n) - 1, 0)
        if several.any():
            some = np.flatnonzero(several)
            distinct = [p for p, s in zip(known, several.tolist()) if s]
            body = np.frombuffer(b"".join(distinct), np.uint8)
            begin = np.cumsum([0, *map(len, distinct)])[:-1]
            own = n[one[some]]
            place = seeds.flat(np.zeros(len(own), np.int64), own)
            # Windows with the anchor at different places differ.
            unit = np.repeat(inverse[some] << 8, own) + np.repeat(left[one[some]].astype(np.int64), own) - place
            low = first_to_have(body, begin, own, unit, first[some], window)
            start = np.zeros(len(known), np.int64)
            start[some] = np.cumsum(own) - own
            rows = np.flatnonzero(several[of])
            which = np.repeat(rows, n[rows])
            at = seeds.flat(np.zeros(len(rows), np.int64), n[rows])
            bits[rows] = 0
            np.bitwise_or.at(bits, which, (low[start[of[which]] + at] < least[which]).astype(np.int64) << at)
        return bits

    return earlier


def _kept(texts: seeds.Bytes, gone: np.ndarray) -> list[tuple[list[list[int]], bytes]]:
    """Spans to remove and the other bytes of each text."""
    out = []
    hit = np.r_[0, np.cumsum(gone)][texts.bounds]
    for i, (a, z) in enumerate(zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist())):
        raw = texts.raw[a:z]
        out.append((seeds.runs(gone[a:z]).tolist(), raw[~gone[a:z]].tobytes()) if hit[i] != hit[i + 1] else ([], raw.tobytes()))
    return out


def earlier_strings(docs: DataFrame, window: int = 50, gram: int = 26, id_col: str = "doc_id", text_col: str = "text", crowded: int = seeds.CROWDED) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and stop in bytes) and kept (the other bytes).

    A byte is in a span if a string of window bytes around it also starts in a text with
    a smaller id. Null and shorter texts have no spans; a very long text is hashed in
    chunks, but held whole by one task. Rows of equal or null ids stand in the order of
    their texts, null ids first, and the later counts as larger. Other columns are
    ignored; no rows give no rows.
    """

    def finish(texts: seeds.Bytes, gone: np.ndarray, bodies: list[bytes], carry: list[pa.Array]) -> pa.RecordBatch:
        found = _kept(texts, gone)
        spans = pa.array([[{"start": a, "stop": z} for a, z in s] for s, _ in found], seeds.SPANS)
        return pa.record_batch([carry[0], pa.array(np.diff(texts.bounds)), spans, pa.array([k for _, k in found], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    return seeds.marked(docs, id_col, text_col, seeds.Bytes, seeds.Shape(window, gram), _judge(window), True, finish, schema, ["doc_id"], crowded)


def without_earlier_strings(docs: DataFrame, window: int = 50, gram: int = 26, id_col: str = "doc_id", text_col: str = "text", crowded: int = seeds.CROWDED) -> DataFrame:
    """docs with the texts that earlier_strings keeps; a character that lost some of its bytes goes. A null text stays null."""

    def finish(texts: seeds.Bytes, gone: np.ndarray, bodies: list[bytes], carry: list[pa.Array]) -> pa.RecordBatch:
        null = carry[1].to_pylist()
        kept = [None if n else k.decode("utf-8", "ignore") for n, (_, k) in zip(null, _kept(texts, gone))]
        return pa.record_batch([carry[0], pa.array(kept, pa.string())], ["carry", "kept"])

    told = docs.withColumn(text_col, F.col(text_col).cast("string"))
    others = [c for c in docs.columns if c != text_col]
    kind = told.select(F.struct(*(F.col(f"`{c}`") for c in others))).schema[0].dataType.simpleString()
    out = seeds.marked(told, id_col, text_col, seeds.Bytes, seeds.Shape(window, gram), _judge(window), True, finish, f"carry {kind}, kept string", ["carry", "null"], crowded)
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"carry.`{c}`").alias(c) for c in docs.columns))
