"""Repeated windows of a corpus, found by winnowed anchors and without comparing pairs.

A text is a row of symbols (words or bytes). Of the grams in a window the one with the
smallest hash is the window's anchor, so equal windows have equal anchors at equal
places. The windows that share an anchor occurrence make one stretch of the text.

Texts are dealt by a hash of their key to regions, and those of a region to blocks of
about BLOCK_BYTES. A block is the unit of all that travels:

1. Each block tells every anchor it has once; a bucket of anchors tells back which of
   them stand in two blocks, or twice in one.
2. Each block sends its stretches at those anchors, equal ones combined, as their very
   symbols. A bucket compares all stretches of an anchor (judge) and answers with the
   windows of each that are repeated.
3. Each block marks the windows in its texts.

What travels is packed: one row holds what one task has for one bucket or region as
arrays. A hash only brings candidates together; verdicts are by the symbols themselves.
An anchor that stands in more than ``crowded`` blocks is dealt window by window instead
of as a whole, so no bucket gathers more than about that many stretches of one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, materialise, parts

#: An odd base of the rolling hash and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Bytes of text in a block, on average.
BLOCK_BYTES = 1 << 20
#: Blocks with the same anchor beyond which its windows are dealt one by one. The result is the same.
CROWDED = 4096
#: Bits of an anchor's hash that travel within its bucket.
CODE_BITS = 40
CODE = np.uint64((1 << CODE_BITS) - 1)
#: Entries, and bytes of stretches, that a task packs at once.
PACK_ROWS, PACK_BYTES = 1 << 18, 6 << 20
#: Windows that are hashed at once; stretches end at such bounds too.
CHUNK = 1 << 18
#: Low bits of a hash that give way to a place within a chunk.
PLACE = np.uint64((1 << 20) - 1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, or more of them."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 12) * 2, np.uint64(base))], dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class Spans:
    """Hashes of spans of symbols; equal spans have equal hashes."""

    def __init__(self, symbols: np.ndarray):
        self.power, self.back = powers(BASE, len(symbols)), powers(BACK, len(symbols))
        self.sums = np.r_[np.uint64(0), np.cumsum(symbols * self.power[: len(symbols)], dtype=np.uint64)]
        self.total = len(symbols)

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[: self.total - n + 1] + np.uint64(n))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each width consecutive values stands (by all but the low bits), the first of equal ones."""
    best = (values & ~PLACE) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (best & PLACE).astype(np.int64)


#: Bits of a verdict.
MOST_PLACES = 31


@dataclass(frozen=True)
class Shape:
    """window: symbols of a repeat at least; gram: symbols of an anchor. A verdict has a bit for each place of an anchor within a window."""

    window: int
    gram: int

    def __post_init__(self):
        if not 1 <= self.gram <= self.window <= self.gram + MOST_PLACES - 1:
            raise ValueError(f"an anchor of {self.gram} can't decide windows of {self.window}: choose one from {max(1, self.window - MOST_PLACES + 1)} to {self.window}")


class Bytes:
    """Texts of a block as rows of bytes; text i has the symbols bounds[i] to bounds[i + 1]."""

    def __init__(self, bodies: list[bytes]):
        self.raw = np.frombuffer(b"".join(bodies), np.uint8)
        self.bounds = np.cumsum([0, *map(len, bodies)])
        self.size = len(self.raw)

    def hashes(self, at: np.ndarray | slice) -> np.ndarray:
        return _BYTE[self.raw[at]]

    def places(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where n symbols from first begin and end in raw."""
        return first, first + n


class Words:
    """Texts of a block as rows of words, what white space does not hold; raw has them parted by one blank."""

    def __init__(self, bodies: list[bytes]):
        words = [body.split() for body in bodies]
        self.bounds = np.cumsum([0, *map(len, words)])
        lines = list(map(b" ".join, words))
        del words
        self.raw = np.frombuffer(b"\n".join(lines), np.uint8)
        del lines
        self.size = int(self.bounds[-1])
        gap = (self.raw == 32) | (self.raw == 10)
        self.begin = np.flatnonzero(~gap & np.r_[True, gap[:-1]]) if self.size else np.empty(0, np.int64)
        self.end = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1 if self.size else np.empty(0, np.int64)
        self.hash = np.empty(self.size, np.uint64)
        weight = powers(BACK, 1 << 12)
        for a in range(0, self.size, 1 << 17):
            z = min(a + (1 << 17), self.size)
            length = self.end[a:z] - self.begin[a:z]
            start = np.cumsum(length) - length
            within = np.arange(length.sum()) - np.repeat(start, length)
            value = _BYTE[self.raw[np.repeat(self.begin[a:z], length) + within]] * weight[within & 4095]
            self.hash[a:z] = mix(np.add.reduceat(value, start) + length.astype(np.uint64))

    def words(self, text: int) -> list[bytes]:
        a, z = self.bounds[text], self.bounds[text + 1]
        return self.raw[self.begin[a] : self.end[z - 1]].tobytes().split(b" ") if z > a else []

    def hashes(self, at: np.ndarray | slice) -> np.ndarray:
        return self.hash[at]

    def places(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.begin[first], self.end[first + n - 1]


Texts = Bytes | Words


@dataclass
class Stretches:
    """Of each anchor occurrence: hash of the anchor, first window, number of windows, symbols before the anchor, hash of the stretch."""

    anchor: np.ndarray
    first: np.ndarray
    n: np.ndarray
    left: np.ndarray
    whole: np.ndarray

    def __getitem__(self, rows: np.ndarray) -> Stretches:
        return Stretches(self.anchor[rows], self.first[rows], self.n[rows], self.left[rows], self.whole[rows])


def stretches(texts: Texts, shape: Shape) -> Stretches:
    """All stretches of the texts of a block in order; no window crosses from one text to the next."""
    begin, end = texts.bounds[:-1], texts.bounds[1:] - shape.window + 1
    long_enough = end > begin
    change = np.zeros(texts.size + 1, np.int8)
    change[begin[long_enough]] += 1
    change[end[long_enough]] -= 1
    whole_window = change.cumsum(dtype=np.int8).astype(bool)
    out = [[np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64)]]
    for at in range(0, texts.size - shape.window + 1, CHUNK):
        spans = Spans(texts.hashes(slice(at, at + CHUNK + shape.window - 1)))
        grams = spans.grams(shape.gram)
        place = sliding_argmin(grams, shape.window - shape.gram + 1)
        real = whole_window[at : at + len(place)]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (real[1:] != real[:-1])])
        n = np.diff(np.r_[first, len(place)])
        first, n = first[real[first]], n[real[first]]
        anchor = place[first]
        out.append([grams[anchor], first + at, n, anchor - first, spans.of(first, first + n + shape.window - 1)])
    return Stretches(*(np.concatenate(x) for x in zip(*out)))


def flat(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 ... of each run, one run after the other."""
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


def equal_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are the same over each length (of 1 or more)."""
    if not len(a):
        return np.empty(0, bool)
    differs = raw[flat(a, length)] != raw[flat(b, length)]
    return ~np.logical_or.reduceat(differs, np.cumsum(length) - length)


def grouped(raw: np.ndarray, keys: list[np.ndarray], begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the spans in which those of equal keys and bytes stand together, and where each group of them starts."""
    order = np.lexsort([np.arange(len(begin)), *keys[::-1]])
    same = np.zeros(len(order), bool)
    if len(order):
        near = np.ones(len(order) - 1, bool)
        for x in (*keys, length):
            near &= x[order[1:]] == x[order[:-1]]
        at = np.flatnonzero(near)
        same[at + 1] = equal_spans(raw, begin[order[at]], begin[order[at + 1]], length[order[at]])
    return order, np.flatnonzero(~same)


@dataclass(frozen=True)
class Grid:
    regions: int
    blocks: int
    buckets: int
    crowded: int

    def code(self, anchor: np.ndarray) -> np.ndarray:
        """The bucket of a hash, then the bits that travel."""
        b = np.uint64(self.buckets)
        return (anchor % b) << np.uint64(CODE_BITS) | (anchor // b) & CODE


@dataclass
class Entries:
    """The stretches of a block at shared anchors, in classes of equal ones; those at crowded anchors also window by window.

    at: the stretches in order of their classes, of: the class of each, head: the first
    of each class. window_*: class, place and entry of each window of a crowded class.
    code, left, n, begin, length, least and count are those of the entries: classes, then
    distinct windows; sent tells which of them go to the buckets.
    """

    at: Stretches
    of: np.ndarray
    head: np.ndarray
    window_class: np.ndarray
    window_at: np.ndarray
    window_entry: np.ndarray
    code: np.ndarray
    left: np.ndarray
    n: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    least: np.ndarray
    count: np.ndarray
    sent: np.ndarray


def entries(texts: Texts, keys: np.ndarray, shape: Shape, grid: Grid, shared: np.ndarray, crowded: np.ndarray) -> Entries:
    """keys: of the texts, ascending; shared: the codes of shared anchors, crowded: which of those are."""
    all_ = stretches(texts, shape)
    code = grid.code(all_.anchor)
    by = np.argsort(shared, kind="stable")
    shared, crowded = shared[by], crowded[by]
    place = np.minimum(np.searchsorted(shared, code), max(len(shared) - 1, 0))
    rows = np.flatnonzero(shared[place] == code) if len(shared) else np.empty(0, np.int64)
    found, code, place = all_[rows], code[rows], place[rows]
    begin, end = texts.places(found.first, found.n + shape.window - 1)
    order, head = grouped(texts.raw, [code, found.whole, found.n, found.left], begin, end - begin)
    found, code, place, begin, length = found[order], code[order], place[order], begin[order], (end - begin)[order]
    size = np.diff(np.r_[head, len(order)])
    of = np.repeat(np.arange(len(head)), size)
    key = keys[np.searchsorted(texts.bounds, found.first, "right") - 1] if len(order) else np.empty(0, np.int64)
    least, dense = key[head], crowded[place[head]]
    # The windows of crowded classes, each distinct one an entry of its own.
    n = np.where(dense, found.n[head], 0)
    window_class = np.repeat(np.arange(len(head)), n)
    window_at = flat(np.zeros(len(n), np.int64), n)
    first = found.first[head][window_class] + window_at
    h = np.zeros(len(first), np.uint64)
    for k in range(shape.window if len(first) else 0):
        h = h * np.uint64(BASE) + texts.hashes(first + k)
    w_code = grid.code(mix(h))
    w_begin, w_end = texts.places(first, np.full(len(first), shape.window))
    w_order, w_head = grouped(texts.raw, [w_code], w_begin, w_end - w_begin)
    w_of = np.empty(len(first), np.int64)
    w_of[w_order] = np.repeat(np.arange(len(w_head)), np.diff(np.r_[w_head, len(w_order)]))
    w_least = np.full(len(w_head), np.iinfo(np.int64).max)
    np.minimum.at(w_least, w_of, least[window_class])
    w_count = np.zeros(len(w_head), np.int64)
    np.add.at(w_count, w_of, size[window_class])
    one = w_order[w_head]
    return Entries(
        found, of, head, window_class, window_at, w_of + len(head),
        np.r_[code[head], w_code[one]], np.r_[found.left[head], np.zeros(len(one), np.int64)], np.r_[found.n[head], np.ones(len(one), np.int64)],
        np.r_[begin[head], w_begin[one]], np.r_[length[head], (w_end - w_begin)[one]], np.r_[least, w_least], np.r_[size, w_count], np.r_[~dense, np.ones(len(one), bool)],
    )


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values, cut at bounds (places in values), as a binary column."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def packed(to: np.ndarray, names: list[str], columns: list[np.ndarray], raw: np.ndarray | None = None, length: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each distinct value of to, with each column's values there as bytes; raw and length are spans of bytes to go along, compressed."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
    bounds = np.r_[starts, len(to)]
    out = [pa.array(to[starts].astype(np.int64)), *(binaries(c[order], bounds) for c in columns)]
    if raw is not None:
        begin = np.cumsum(length) - length
        spans = binaries(raw[flat(begin[order], length[order])], np.r_[0, np.cumsum(length[order])][bounds])
        out.append(pa.array([pa.compress(x.as_buffer(), "zstd", asbytes=True) for x in spans], pa.binary()))
    return pa.record_batch(out, names)


def loose(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of a packed column."""
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket of a task (one, where there are as many buckets as tasks)."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for a, z in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(bucket)].tolist()):
            if z > a:
                held.setdefault(int(bucket[a]), []).append(batch.slice(a, z - a))
    for bucket in sorted(held):
        yield pa.Table.from_batches(held.pop(bucket))
        give_back()


def to_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartitionById(buckets, F.col("bucket").cast("int"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """key, doc_id, body and carry, and the bytes of all texts: key is the doc_id where ids are unique, carry a struct of all columns but the text.

    Where some ids are null or repeated, key numbers the rows by id (null first) and
    text, so that each row is told apart and keys stand in the order of the ids.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    carry = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"), carry.alias("carry"))
    each = plain.groupBy("doc_id").agg(F.count("*").alias("c"), F.sum(F.octet_length("body")).alias("bytes"))
    odd, size = each.agg(F.max((F.col("c") > 1) | F.col("doc_id").isNull()), F.sum("bytes")).first()
    if not odd:
        return plain.select(F.col("doc_id").alias("key"), "doc_id", "body", "carry"), size or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("body").asc_nulls_first()]
    numbered = plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id())
    return materialise(numbered).select("key", "doc_id", "body", "carry"), size or 0


_SHARED, _VERDICT, _TEXT = 0, 1, 99
#: Arrays x, y and z of what is told.
KINDS = {_SHARED: (np.int64, np.uint64, bool), _VERDICT: (np.int64, np.int32, np.int32)}


def region_of(key: Column, grid: Grid) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(grid.regions).cast("long"))


def together(docs: DataFrame, grid: Grid, told: list[tuple[int, DataFrame]], carried: list[str] = []) -> DataFrame:
    """Texts by region and block, before them what is told to the region (x, y and z, packed)."""
    h = F.xxhash64("key")
    region = region_of(F.col("key"), grid)
    block = region * grid.blocks + F.pmod(F.shiftright(h, 32), F.lit(grid.blocks).cast("long"))
    none = F.lit(None).cast("binary")
    xyz = [none.alias(c) for c in "xyz"] if told else []
    out = docs.select(region.cast("long").alias("region"), F.lit(_TEXT).alias("kind"), block.cast("long").alias("block"), "key", "body", *carried, *xyz)
    for kind, rows in told:
        like = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields}
        like |= {"region": F.col("region"), "kind": F.lit(kind).alias("kind"), "block": F.lit(-1).cast("long").alias("block"), "key": F.lit(0).cast("long").alias("key")}
        out = out.unionAll(rows.select(*(F.col(c) if c in "xyz" else like[c] for c in out.columns)))
    return out.repartitionById(grid.regions, F.col("region").cast("int")).sortWithinPartitions("region", "kind", "block", "key")


@dataclass
class Block:
    number: int
    keys: np.ndarray
    bodies: list[bytes]
    carry: list[pa.Array]
    #: y and z of what is told, by its kind and x.
    told: Callable[[int, int], tuple[np.ndarray, np.ndarray]]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """key and body of batches, some BLOCK_BYTES at a time."""
    for batch in batches:
        keys, column = batch.column("key"), batch.column("body")
        at, size, bodies = 0, 0, []
        for i, x in enumerate(column, 1):
            bodies.append(x.as_py() or b"")
            size += len(bodies[-1])
            if size >= BLOCK_BYTES or i == len(column):
                yield keys.slice(at, i - at), bodies
                at, size, bodies = i, 0, []
    give_back()


def blocks(batches: Iterator[pa.RecordBatch], carried: list[str] = [], kinds: dict[int, tuple[type, type, type]] = KINDS) -> Iterator[Block]:
    """The blocks of a task one by one, each with what was told to it."""
    told: dict[int, list[list[np.ndarray]]] = {}
    ready: dict[int, list[np.ndarray]] = {}
    now: tuple[int, int] | None = None
    keys: list[np.ndarray] = []
    bodies: list[bytes] = []
    carry: list[list[pa.Array]] = []

    def look_up(kind: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        if kind not in ready:
            some = told.get(kind) or [[np.empty(0, t) for t in kinds[kind]]]
            x, y, z = (np.concatenate(c) for c in zip(*some))
            order = np.argsort(x, kind="stable")
            ready[kind] = [x[order], y[order], z[order]]
        x, y, z = ready[kind]
        rows = slice(*np.searchsorted(x, [number, number + 1]))
        return y[rows], z[rows]

    def done() -> Block:
        whole = [pa.concat_arrays(c) for c in zip(*carry)]
        out = Block(now[1], np.concatenate(keys), list(bodies), whole, look_up)
        keys.clear(), bodies.clear(), carry.clear()
        return out

    region = None
    for batch in batches:
        r, kind, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "kind", "block"))
        cuts = np.flatnonzero((r[1:] != r[:-1]) | (kind[1:] != kind[:-1]) | (block[1:] != block[:-1])) + 1
        for a, z in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(r)].tolist()):
            if z == a:
                continue
            if keys and (kind[a] != _TEXT or now != (r[a], block[a])):
                yield done()
            if region != r[a]:
                region = r[a]
                told.clear(), ready.clear()
            rows = batch.slice(a, z - a)
            if kind[a] == _TEXT:
                now = (r[a], block[a])
                keys.append(rows.column("key").to_numpy())
                bodies.extend(x.as_py() or b"" for x in rows.column("body"))
                carry.append([rows.column(c) for c in carried])
            else:
                told.setdefault(int(kind[a]), []).append([loose(rows.column(c), t) for c, t in zip("xyz", kinds[int(kind[a])])])
    if keys:
        yield done()
    give_back()


def _anchors(docs: DataFrame, texts: type[Texts], shape: Shape, grid: Grid, across: bool) -> DataFrame:
    """bucket, and packed the distinct anchors of each block: code, block and whether it has the anchor in two texts (across) or twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            code, block, twice = (np.concatenate(x) for x in zip(*held))
            low = np.ascontiguousarray(code).view(np.uint8).reshape(-1, 8)[:, : CODE_BITS // 8]
            return packed(code >> np.uint64(CODE_BITS), ["bucket", "code", "block", "twice"], [low, block, twice])

        for block in blocks(batches):
            here = texts(block.bodies)
            found = stretches(here, shape)
            code = grid.code(found.anchor)
            text = np.searchsorted(here.bounds, found.first, "right") if across else np.arange(len(code))
            order = np.lexsort([text, code])
            code, text = code[order], text[order]
            new = np.r_[True, code[1:] != code[:-1]][: len(code)]
            other = ~new & np.r_[False, text[1:] != text[:-1]][: len(code)]
            starts = np.flatnonzero(new)
            if len(starts):
                held.append([code[starts], np.full(len(starts), block.number), np.logical_or.reduceat(other, starts)])
                size += len(starts)
            if size >= PACK_ROWS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return together(docs, grid, []).mapInArrow(run, "bucket long, code binary, block binary, twice binary")


def _shared(anchors: DataFrame, grid: Grid) -> DataFrame:
    """region, x (block), y (code) and z (crowded), packed, of the anchors that stand in several blocks, or twice in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            low = loose(rows.column("code"), np.uint8).reshape(-1, CODE_BITS // 8)
            code = np.zeros((len(low), 8), np.uint8)
            code[:, : CODE_BITS // 8] = low
            code = code.view(np.uint64).ravel() | np.uint64(rows.column("bucket")[0].as_py() << CODE_BITS)
            block, twice = loose(rows.column("block"), np.int64), loose(rows.column("twice"), bool)
            order = np.argsort(code, kind="stable")
            code, block, twice = code[order], block[order], twice[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            size = np.diff(np.r_[starts, len(code)])
            often = np.repeat((size > 1) | np.logical_or.reduceat(twice, starts), size)
            crowded = np.repeat(size > grid.crowded, size)
            code, block, crowded = code[often], block[often], crowded[often]
            yield packed(block // grid.blocks, ["region", "x", "y", "z"], [block, code, crowded])

    return to_buckets(anchors, grid.buckets).mapInArrow(run, "region long, x binary, y binary, z binary")


#: code, symbols before the anchor, windows, least key, number and bytes of stretches: the repeated windows of each, as bits.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], np.ndarray]

_ENTRY = {"code": np.uint64, "block": np.int64, "entry": np.int32, "left": np.uint8, "n": np.uint8, "least": np.int64, "count": np.int64, "length": np.int32}


def _stretches(docs: DataFrame, shared: DataFrame, texts: type[Texts], shape: Shape, grid: Grid) -> DataFrame:
    """bucket, and packed the entries of each block with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            return packed(columns[0] >> np.uint64(CODE_BITS), ["bucket", *_ENTRY, "raw"], columns[:-1], columns[-1], columns[-2].astype(np.int64))

        for block in blocks(batches):
            shared_here = block.told(_SHARED, block.number)
            if not len(shared_here[0]):
                continue
            here = texts(block.bodies)
            e = entries(here, block.keys, shape, grid, *shared_here)
            some = np.flatnonzero(e.sent)
            columns = [e.code, np.full(len(e.code), block.number), np.arange(len(e.code)), e.left, e.n, e.least, e.count, e.length]
            raw = here.raw[flat(e.begin[some], e.length[some])]
            held.append([*(c[some].astype(t) for c, t in zip(columns, _ENTRY.values())), raw])
            size += len(raw)
            if size >= PACK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return together(docs, grid, [(_SHARED, shared)]).mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in (*_ENTRY, "raw")))


def _verdicts(sent: DataFrame, judge: Judge, grid: Grid) -> DataFrame:
    """region, x (block), y (entry) and z (bits of the repeated windows), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            c = {name: loose(rows.column(name), kind) for name, kind in _ENTRY.items()}
            _, inverse, size = np.unique(c["code"], return_inverse=True, return_counts=True)
            some = size[inverse] > 1
            sizes = [int(np.frombuffer(x.as_buffer(), np.int32).sum(dtype=np.int64)) for x in rows.column("length")]
            raw = b"".join(pa.decompress(x.as_buffer(), n, "zstd", asbytes=True) for x, n in zip(rows.column("raw"), sizes))
            stop = np.cumsum(c["length"], dtype=np.int64)
            pieces = [raw[a:z] for a, z in zip((stop - c["length"])[some].tolist(), stop[some].tolist())]
            bits = judge(*(c[x][some] for x in ("code", "left", "n", "least", "count")), pieces)
            hit = bits != 0
            block = c["block"][some][hit]
            if len(block):
                yield packed(block // grid.blocks, ["region", "x", "y", "z"], [block, c["entry"][some][hit], bits[hit].astype(np.int32)])

    return to_buckets(sent, grid.buckets).mapInArrow(run, "region long, x binary, y binary, z binary")


def covered(texts: Texts, keys: np.ndarray, shape: Shape, e: Entries, verdicts: tuple[np.ndarray, np.ndarray], across: bool) -> np.ndarray:
    """Whether each symbol of a block stands in a repeated window.

    across: a window counts in all texts but that of the least key; else wherever it occurs twice.
    """
    classes = len(e.head)
    bits = np.zeros(len(e.code), np.int64)
    bits[verdicts[0]] = verdicts[1]
    own = bits[:classes]
    if across:
        beyond = bits[e.window_entry] | (e.least[e.window_entry] < e.least[e.window_class])
    else:
        beyond = bits[e.window_entry] | (e.count[e.window_entry] > 1)
    np.bitwise_or.at(own, e.window_class, beyond.astype(np.int64) << e.window_at)
    change = np.zeros(texts.size + 1, np.int64)
    first, n = e.at.first, e.at.n
    if across:
        key = keys[np.searchsorted(texts.bounds, first, "right") - 1] if len(first) else first
        full = key > e.least[e.of]
    else:
        full = e.count[e.of] > 1
    np.add.at(change, first[full], 1)
    np.add.at(change, (first + n + shape.window - 1)[full], -1)
    part = ~full & (own[e.of] != 0)
    row, bit = np.nonzero((own[e.of[part]][:, None] >> np.arange(shape.window - shape.gram + 1)) & 1)
    start = first[part][row] + bit
    np.add.at(change, start, 1)
    np.add.at(change, start + shape.window, -1)
    return change[:-1].cumsum() > 0


def marked(docs: DataFrame, id_col: str, text_col: str, texts: type[Texts], shape: Shape, judge: Judge, across: bool, finish: Callable, schema: str, carried: list[str], crowded: int) -> DataFrame:
    """finish(texts, gone, bodies, carried columns) for each block of docs, with gone telling the symbols in repeated windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs, size = keyed(docs, id_col, text_col)
    docs = docs.withColumn("null", F.col("body").isNull())
    n = parts(spark)
    grid = Grid(n, max(1, -(-size // (n * BLOCK_BYTES))), n, crowded)
    shared = materialise(_shared(_anchors(docs, texts, shape, grid, across), grid))
    verdicts = materialise(_verdicts(_stretches(docs, shared, texts, shape, grid), judge, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, carried):
            here = texts(block.bodies)
            e = entries(here, block.keys, shape, grid, *block.told(_SHARED, block.number))
            gone = covered(here, block.keys, shape, e, block.told(_VERDICT, block.number), across)
            yield finish(here, gone, block.bodies, block.carry)

    return together(docs, grid, [(_SHARED, shared), (_VERDICT, verdicts)], carried).mapInArrow(run, schema)


def runs(gone: np.ndarray) -> np.ndarray:
    """The maximal runs [start, stop) of a mask, as rows."""
    return np.flatnonzero(np.diff(np.r_[False, gone, False].view(np.int8))).reshape(-1, 2)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
