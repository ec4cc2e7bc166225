"""Near duplicates of a Jaccard similarity of word shingles, by wide SimHash within groups of shared shingles.

Sets of n shingles that are similar share one among the first n - similarity * n + 1 of
any one order of all shingles. The order is that of hashes, with those last that are among
the first of very many texts by hash alone (hot ones); so every similar pair meets in a group under a shared shingle, and
common lines make no large group. Within its groups a text searches the Gray-order index
of 256-bit SimHashes, and what it finds is verified on the whole sets: the nearest ones by
a join; families of very many candidates in one place, with their sets as bits, so that
no pairs are written. Each round links what it verified, and texts that are linked by then
are no longer compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seeds
from .common import bounded_batches, delete, materialise, parts
from .components import connected_components, forest
from .seeds import Grid, Words
from .simhash import GrayIndex, gray_rank, numbered

#: Texts that have a shingle among their first ones beyond which it goes last in the order.
HOT = 1024
#: 64-bit words of a fingerprint.
WIDTH = 4
#: Differing bits of similar sets: 39 are expected at 0.8 (with a deviation of under 6), so of 10 ** 8 such pairs about one has more.
MOST_BITS = 72
#: Shingles below which fingerprints say too little, so that candidates are all of a group.
LEAST_SHINGLES = 40
#: Differing bits within which the first round takes a text for one of its leader's.
NEAR_BITS, LEADERS = 40, 8
#: Partners that a text proposes to be verified by a join; where some text of a group has more, they are compared as a whole instead.
PARTNERS = 16
#: Texts of a slice; larger families are compared slice by slice.
SLICE = 8192


def shingles(texts: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text; fewer words than width make one."""
    w = texts.hash
    h = np.zeros(max(len(w) - width + 1, 0), np.uint64)
    for k in range(width):
        h = h * np.uint64(seeds.BASE) + w[k : k + len(h)]
    h = seeds.mix(h)
    out = []
    for a, z in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist()):
        if z - a >= width:
            out.append(np.unique(h[a : z - width + 1]))
        else:
            one = np.full(1, z - a, np.uint64)
            for x in w[a:z]:
                one = one * np.uint64(seeds.BASE) + x
            out.append(seeds.mix(one))
    return out


def needed(n: int, similarity: float) -> int:
    """Shingles of n that any set of at least the similarity shares; rounded so that no pair at the limit is missed."""
    return max(1, math.ceil(n * similarity - 1e-9))


def wide_print(s: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes in WIDTH words: bits set in over half of them."""
    counts = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(s), 1 << 14):
        some = s[at : at + (1 << 14)]
        words = np.stack([some, *(seeds.mix(some ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) for k in range(1, WIDTH))], 1)
        counts += np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(s)).view(np.uint64)


def _lower(bodies: list[bytes]) -> Words:
    return Words([body.lower() for body in bodies])


def _digests(texts: DataFrame, width: int) -> DataFrame:
    """key and a 128-bit hash (hi, lo) of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in seeds.portions(batches):
            sets = shingles(_lower(bodies), width)
            found = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.record_batch([keys, pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["key", "hi", "lo"])

    return texts.mapInArrow(run, "key long, hi long, lo long")


def _first(s: np.ndarray, hot: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The set in its order, hot ones last, and how many of it are its first ones."""
    last = np.isin(s, hot) if len(hot) else np.zeros(len(s), bool)
    return s[np.argsort(last, kind="stable")], len(s) - needed(len(s), similarity) + 1


#: What is told to a text by its key: shared codes, and whether they are hot.
_CODES = (np.int64, np.uint64, bool)


def _known(block: seeds.Block, key: int, kinds: int) -> np.ndarray:
    """The hot ones that were told to a text."""
    told = [block.told(kind, key) for kind in range(kinds)]
    return np.concatenate([np.empty(0, np.uint64), *(code[hot] for code, hot in told)])


def _packs(rows: Iterator[tuple[np.ndarray, int]], grid: Grid) -> Iterator[pa.RecordBatch]:
    """code and key of the codes of each text, packed for the buckets."""
    held: list[list[np.ndarray]] = []
    size = 0
    for codes, key in rows:
        held.append([codes, np.full(len(codes), key)])
        size += len(codes)
        if size >= seeds.PACK_ROWS:
            code, keys = (np.concatenate(x) for x in zip(*held))
            yield seeds.packed(code % np.uint64(grid.buckets), ["bucket", "code", "key"], [code, keys])
            held, size = [], 0
    if held:
        code, keys = (np.concatenate(x) for x in zip(*held))
        yield seeds.packed(code % np.uint64(grid.buckets), ["bucket", "code", "key"], [code, keys])


_PACKED = "bucket long, code binary, key binary"
_TOLD = "region long, x binary, y binary, z binary, hots long"


def _tell(key: np.ndarray, code: np.ndarray, hot: np.ndarray, grid: Grid) -> pa.RecordBatch:
    out = seeds.packed(_region(key, grid), ["region", "x", "y", "z"], [key, code, hot])
    return out.append_column("hots", pa.array([int(np.frombuffer(z.as_buffer(), bool).sum()) for z in out.column("z")], pa.int64()))


def _shared(texts: DataFrame, told: list[DataFrame], width: int, similarity: float, grid: Grid, hot: int) -> DataFrame:
    """region, x (key), y (shingle) and z (hot), packed, of the shingles that two texts have among their first; hots tells how many are hot."""
    kinds = len(told)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, int]]:
            for block in seeds.blocks(batches, kinds=dict.fromkeys(range(kinds), _CODES)):
                for key, s in zip(block.keys.tolist(), shingles(_lower(block.bodies), width)):
                    ordered, n = _first(s, _known(block, key, kinds), similarity)
                    yield ordered[:n], key

        yield from _packs(rows(), grid)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in seeds.by_bucket(batches):
            code, key = seeds.loose(rows.column("code"), np.uint64), seeds.loose(rows.column("key"), np.int64)
            order = np.argsort(code, kind="stable")
            code, key = code[order], key[order]
            size = np.diff(np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)])
            several, often = np.repeat(size > 1, size), np.repeat(size > hot, size)
            if several.any():
                yield _tell(key[several], code[several], often[several], grid)

    given = seeds.together(texts, grid, list(enumerate(told))).mapInArrow(give, _PACKED)
    return seeds.to_buckets(given, grid.buckets).mapInArrow(tell, _TOLD)


def _answers(texts: DataFrame, first: DataFrame, width: int, similarity: float, grid: Grid) -> DataFrame:
    """As _shared: which of all other shingles of the texts that were told a hot one are hot too."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, int]]:
            for block in seeds.blocks(batches, kinds={0: _CODES}):
                some = [i for i, key in enumerate(block.keys.tolist()) if block.told(0, key)[1].any()]
                for i, s in zip(some, shingles(_lower([block.bodies[i] for i in some]), width)):
                    ordered, n = _first(s, np.empty(0, np.uint64), similarity)
                    yield ordered[n:], int(block.keys[i])

        yield from _packs(rows(), grid)

    def hot_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.empty(0, np.uint64)]
        for batch in batches:
            known.append(np.unique(seeds.loose(batch.column("y"), np.uint64)[seeds.loose(batch.column("z"), bool)]))
        code = np.unique(np.concatenate(known))
        yield seeds.packed(code % np.uint64(grid.buckets), ["bucket", "code", "key"], [code, np.full(len(code), -1)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in seeds.by_bucket(batches):
            code, key = seeds.loose(rows.column("code"), np.uint64), seeds.loose(rows.column("key"), np.int64)
            hit = (key >= 0) & np.isin(code, code[key < 0])
            if hit.any():
                yield _tell(key[hit], code[hit], np.ones(int(hit.sum()), bool), grid)

    asked = seeds.together(texts, grid, [(0, first)]).mapInArrow(ask, _PACKED)
    both = asked.unionAll(first.where("hots > 0").mapInArrow(hot_ones, _PACKED))
    return seeds.to_buckets(both, grid.buckets).mapInArrow(answer, _TOLD)


def _region(key: np.ndarray, grid: Grid) -> np.ndarray:
    """As seeds.region_of: Spark's XXH64 of a long, of seed 42."""
    h = np.frombuffer(b"".join(xxhash.xxh64_digest(k, 42) for k in np.ascontiguousarray(key).view("V8").tolist()), ">u8").astype(np.uint64)
    return h.view(np.int64) % grid.regions


def _members(texts: DataFrame, told: list[DataFrame], width: int, similarity: float, grid: Grid) -> DataFrame:
    """key, n (shingles), print and codes (its first shingles that another text has too, packed) of the texts that have some."""
    kinds = len(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in seeds.blocks(batches, kinds=dict.fromkeys(range(kinds), _CODES)):
            out = []
            last = [block.told(kinds - 1, key)[0] for key in block.keys.tolist()]
            some = [i for i, codes in enumerate(last) if len(codes)]
            for i, s in zip(some, shingles(_lower([block.bodies[i] for i in some]), width)):
                key = int(block.keys[i])
                ordered, n = _first(s, _known(block, key, kinds - 1), similarity)
                codes = ordered[:n]
                codes = codes[np.isin(codes, last[i])]
                if len(codes):
                    out.append((key, len(s), wide_print(s).tobytes(), codes.tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "n", "print", "codes"])

    return seeds.together(texts, grid, list(enumerate(told))).mapInArrow(run, "key long, n long, print binary, codes binary")


_MEMBER = {"code": np.uint64, "key": np.int64, "n": np.int64, "label": np.int64}


def _leaders(code: np.ndarray, key: np.ndarray, n: np.ndarray, fp: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of each text and the leaders of its group that it may be similar to; texts near a leader have no more."""
    order = np.lexsort([key, code])
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _ in range(LEADERS):
        starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(order) else np.empty(0, np.int64)
        size = np.diff(np.r_[starts, len(order)])
        lead = np.repeat(order[starts], size)
        apart = np.bitwise_count(fp[order] ^ fp[lead]).sum(1, dtype=np.int64)
        may = _may(n[order], n[lead], apart, similarity) & (order != lead)
        a.append(lead[may]), b.append(order[may])
        order = order[(apart > NEAR_BITS) & (np.repeat(size, size) > 1)]
    return np.concatenate(a), np.concatenate(b)


def _may(n: np.ndarray, m: np.ndarray, apart: np.ndarray, similarity: float) -> np.ndarray:
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (small >= large * similarity - 1e-9) & ((apart <= MOST_BITS) | (small < LEAST_SHINGLES))


def _ordered(group: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return np.lexsort([*(gray_rank(fp[:, k]) for k in range(WIDTH - 1, -1, -1)), group])


def _limits(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.where(n * similarity < LEAST_SHINGLES, 64 * WIDTH, MOST_BITS)


def _partners(code: np.ndarray, n: np.ndarray, label: np.ndarray, fp: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of each text and those texts of its groups that it may be similar to and isn't linked with.

    Where some text of a group has more than most of them, the group gives rows that
    connect them all instead (the last two arrays).
    """
    group = np.unique(code, return_inverse=True)[1]
    order = _ordered(group, fp)
    i, j, d, up, node = (np.empty(0, np.int64) for _ in range(5))
    crowded = np.empty(0, np.int64)

    def nearest() -> None:
        nonlocal i, j, d, up, node, crowded
        node, up = forest(np.concatenate([up, i]), np.concatenate([node, j]))
        by = np.lexsort([d, i])
        i, j, d = i[by], j[by], d[by]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        crowded = np.union1d(crowded, group[order[i[place >= most]]])
        i, j, d = i[place < most], j[place < most], d[place < most]

    for x, y, apart in GrayIndex(group[order], fp[order], label[order]).pairs(_limits(n[order], similarity)):
        may = _may(n[order[x]], n[order[y]], apart, similarity)
        i, j, d = np.r_[i, x[may]], np.r_[j, y[may]], np.r_[d, apart[may]]
        if len(i) > 1 << 20:
            nearest()
    nearest()
    few, many = ~np.isin(group[order[i]], crowded), np.isin(group[order[node]], crowded)
    return order[i[few]], order[j[few]], order[up[many]], order[node[many]]


def _candidates(members: DataFrame, similarity: float, buckets: int, leaders: int = 0, most: int = PARTNERS) -> DataFrame:
    """a, b and tied: pairs of keys to verify, or, tied, that connect texts which are to be compared as a whole.

    members: key, n, print, codes, label; leaders: by leaders alone, over so many shingles of each text.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("codes")]
            codes = [c[:leaders] if leaders else c for c in codes]
            times = np.array([len(c) for c in codes], np.int64)
            code = np.concatenate([np.empty(0, np.uint64), *codes])
            columns = [np.repeat(batch.column(c).to_numpy(), times) for c in ("key", "n", "label")]
            fp = np.repeat(seeds.loose(batch.column("print"), np.uint64).reshape(-1, WIDTH), times, 0)
            yield seeds.packed(code % np.uint64(buckets), ["bucket", *_MEMBER, "print"], [code, *columns, fp])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in seeds.by_bucket(batches):
            c = {name: seeds.loose(rows.column(name), kind) for name, kind in _MEMBER.items()}
            fp = seeds.loose(rows.column("print"), np.uint64).reshape(-1, WIDTH)
            _, group = np.unique(c["code"], return_inverse=True)
            low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, -1)
            np.minimum.at(low, group, c["label"]), np.maximum.at(high, group, c["label"])
            some = np.flatnonzero((low != high)[group])
            if not len(some):
                continue
            code, key, n, label, fp = *(c[x][some] for x in _MEMBER), fp[some]
            if leaders:
                found = [(*_leaders(code, key, n, fp, similarity), False)]
            else:
                a, b, up, node = _partners(code, n, label, fp, similarity, most)
                found = [(a, b, False), (up, node, True)]
            for a, b, tied in found:
                pairs = np.unique(np.sort(np.stack([key[a], key[b]], 1), 1), axis=0)
                if len(pairs):
                    yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.full(len(pairs), tied))], ["a", "b", "tied"])

    dealt = members.mapInArrow(deal, "bucket long, " + ", ".join(f"{x} binary" for x in (*_MEMBER, "print")))
    return seeds.to_buckets(dealt, buckets).mapInArrow(search, "a long, b long, tied boolean").distinct()


def _set_bits(sets: list[np.ndarray]) -> np.ndarray:
    """The sets as rows of bits (n, words), of what at least two of them have: what two share is among that."""
    value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    several = times[place] > 1
    row, column = row[several], column[place[several]]
    out = np.zeros((len(sets), int(column.max(initial=0)) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return out


def _shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much the sets of each pair share, exactly."""
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    total = np.zeros(len(a), np.int64)
    # By parts of the range of hashes, so that the bits at hand stay few.
    parts_ = 1 + sum(len(sets[i]) for i in rows) // (1 << 18)
    bounds = np.array([(p << 64) // parts_ for p in range(1, parts_)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(sets[i], bounds), len(sets[i])] for i in rows]
    for p in range(parts_):
        bits = _set_bits([sets[i][c[p] : c[p + 1]] for i, c in zip(rows, cuts)])
        for w in range(bits.shape[1]):
            total += np.bitwise_count(bits[a, w] & bits[b, w])
    return total


def _compared(members: DataFrame, ties: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect what is similar within each family of tied texts, compared as a whole, slice by slice."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("family", "i", "j")], 1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            for a, z in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(ids)].tolist()):
                if z > a:
                    if rows and last != tuple(ids[a]):
                        yield links(pa.Table.from_batches(rows))
                        rows = []
                    rows.append(batch.slice(a, z - a))
                    last = tuple(ids[a])
        if rows:
            yield links(pa.Table.from_batches(rows))
        seeds.give_back()

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, n, label, own = (rows.column(c).to_numpy() for c in ("key", "n", "label", "own"))
        fp = seeds.loose(rows.column("print"), np.uint64).reshape(-1, WIDTH)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("s")]
        across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        order = _ordered(np.zeros(len(key), np.int64), fp)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for x, y, apart in GrayIndex(np.zeros(len(key), np.int64), fp[order], label[order]).pairs(_limits(n[order], similarity)):
            x, y = order[x], order[y]
            may = _may(n[x], n[y], apart, similarity) & ((own[x] != own[y]) | (not across))
            x, y = x[may], y[may]
            if len(x):
                both = _shared_counts(sets, x, y)
                alike = both >= (n[x] + n[y] - both) * similarity - 1e-9
                a, b = forest(np.concatenate([a, key[x[alike]]]), np.concatenate([b, key[y[alike]]]))
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    tied = materialise(connected_components(ties))
    family = tied.select(F.col("node").alias("key"), F.col("component").alias("family")).unionAll(tied.select("component", "component").distinct())
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    each = members.select("key", "n", "label", "print").join(family, "key").join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("key"), F.col("slices")))
    each = materialise(each)
    sets = materialise(_sets(texts.join(each.select("key"), "key", "left_semi"), width))
    sent = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).join(sets, "key")
    sent = sent.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "label", "print", "s")
    dealt = sent.repartition(parts(members.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j", "key")
    links = materialise(dealt.mapInArrow(compare, "a long, b long"))
    for done in (tied, each, sets):
        delete(done)
    return links


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """key and s: the whole shingle set of each text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in seeds.portions(batches):
            sets = shingles(_lower(bodies), width)
            yield pa.record_batch([keys, pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "s"])

    return texts.select("key", "body").mapInArrow(run, "key long, s binary")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= (len(x) + len(y) - both) * similarity - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    sets = materialise(_sets(texts.join(asked, "key", "left_semi"), width))
    first, second = sets.select(F.col("key").alias("a"), F.col("s").alias("x")), sets.select(F.col("key").alias("b"), F.col("s").alias("y"))
    links = materialise(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    for done in (asked, sets):
        delete(done)
    return links


def classes(texts: DataFrame, width: int = 5, similarity: float = 0.8, hot: int = HOT, most: int = PARTNERS) -> DataFrame:
    """key and component (the smallest key reachable) of every text (key, body; keys are unique)."""
    spark = texts.sparkSession
    bounded_batches(spark)
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = parts(spark)
    grid = Grid(n, max(1, -(-size // (n * seeds.BLOCK_BYTES))), n, hot)
    digests = materialise(_digests(texts.select("key", "body"), width))
    reps = materialise(digests.groupBy("hi", "lo").agg(F.min("key").alias("rep")))
    own = texts.select("key", "body").join(reps.select(F.col("rep").alias("key")), "key", "left_semi")
    told = [materialise(_shared(own, [], width, similarity, grid, hot))]
    if told[0].agg(F.sum("hots")).first()[0]:
        told.append(materialise(_answers(own, told[0], width, similarity, grid)))
        told.append(materialise(_shared(own, told, width, similarity, grid, hot)))
    members = materialise(_members(own, told, width, similarity, grid))
    for done in told:
        delete(done)
    edges, found, ties = None, None, None
    for leaders in (4, 0, None):
        if leaders is None and ties is None:
            break
        labelled = members.withColumn("label", F.col("key"))
        if found is not None:
            labelled = members.join(found, members.key == found.node, "left").select(members["*"], F.coalesce("component", "key").alias("label"))
        if leaders is None:
            links = _compared(labelled, ties, own, width, similarity)
        else:
            asked = materialise(_candidates(labelled, similarity, grid.buckets, leaders, most))
            links = _verified(asked.where("not tied").select("a", "b"), own, width, similarity)
            if asked.where("tied").limit(1).count():
                ties = materialise(asked.where("tied").select("a", "b"))
            delete(asked)
        if links.limit(1).count():
            edges = links if edges is None else edges.unionAll(links)
            found = materialise(connected_components(edges))
    delete(members)
    if found is not None:
        reps = materialise(reps.join(found, reps.rep == found.node, "left").select("hi", "lo", F.coalesce("component", "rep").alias("rep")))
    return digests.join(reps, ["hi", "lo"]).select("key", F.col("rep").alias("component"))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and component_id: links are all pairs whose word shingles have at least the Jaccard similarity.

    Words are parted by ASCII white space and read in lower case (A-Z); a null or empty
    text has the shingle of nothing, fewer words than width make one. Rows with equal
    sets share a class; rows with a repeated id each come out; rows with a null id don't
    lend it to a class, and a class of such rows alone has a null id. A very long text is
    held whole by one task. Other columns are ignored; no rows give no rows.
    """
    rows = numbered(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("body")), "doc_id")
    found = materialise(classes(rows.select(F.col("row_no").alias("key"), "body"), width, similarity, **options))
    first = rows.select(F.col("row_no").alias("component"), F.col("doc_id").alias("component_id"))
    return rows.select(F.col("row_no").alias("key"), "doc_id").join(found, "key").join(first, "component").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs but for near duplicates (see similar): of each class the row of the smallest id stays, of equal ids one."""
    unique = numbered(docs, id_col)
    found = classes(unique.select(F.col("row_no").alias("key"), F.col(f"`{text_col}`").cast("binary").alias("body")), **options)
    kept = materialise(found.where("key = component").select(F.col("key").alias("row_no")))
    return unique.join(kept, "row_no", "left_semi").select(*(f"`{c}`" for c in docs.columns))
