"""Approximate nearest neighbours: inverted lists, anisotropic four-bit codes, exact reranking.

Nearness is turned into an inner product: with y = (x, -|x|^2 / 2) and the query
(q, 1), the largest product is the smallest distance. Around a list's centre a vector's
residual is coded two dimensions at a time, 16 codewords each; codewords are chosen
and fitted with the part of the error parallel to the vector weighing more than the
part across it, as it is the parallel part that changes large products. A query scans
the codes of its lists with small tables; the best of all its lists make one short list,
which is measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, delete, materialise, parts

#: Distinct vectors that the centres and codewords are fitted on, those with the smallest hashes.
FIT_ROWS = 16_384
#: Queries that go over the rows at once, on average; they and their best are what a task holds, and what passes the driver.
BLOCK_QUERIES = 16_384
#: Rows of a list and queries that are compared at once, and pairs that are measured at once.
ROWS, QUERIES, PAIRS = 4_096, 1_024, 16_384
#: How much the parallel part of the error weighs against the part across.
ETA = 4.0
CODEWORDS = 16


@dataclass
class Model:
    """centres (lists, d + 1); codewords (subspaces, 16, 2) of the padded residuals."""

    centres: np.ndarray
    codewords: np.ndarray

    @property
    def pairs(self) -> int:
        return len(self.codewords)


def augmented(x: np.ndarray) -> np.ndarray:
    return np.c_[x, -0.5 * (x * x).sum(1)]


def _padded(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.zeros((len(x), x.shape[1] % 2))]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = 0.5 * (centres * centres).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ centres.T).argmin(1)
    return out


def _direction(y: np.ndarray) -> np.ndarray:
    return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-30)


def encode(model: Model, y: np.ndarray, lists: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes (n, pairs) of augmented vectors: start with the nearest codewords, then lower the anisotropic error pair by pair.

    The error is |r - c|^2 + (ETA - 1) * <r - c, u>^2 with u the direction of y.
    """
    r, u = _padded(y - model.centres[lists]), _padded(_direction(y))
    n, m = len(y), model.pairs
    parts_r, parts_u = r.reshape(n, m, 2), u.reshape(n, m, 2)
    codes = np.empty((n, m), np.uint8)
    along = np.zeros(n)
    for j in range(m):
        away = parts_r[:, j, None, :] - model.codewords[j][None]
        codes[:, j] = (away * away).sum(2).argmin(1)
        along += ((parts_r[:, j] - model.codewords[j][codes[:, j]]) * parts_u[:, j]).sum(1)
    for _ in range(rounds):
        for j in range(m):
            away = parts_r[:, j, None, :] - model.codewords[j][None]
            own = (away * parts_u[:, j, None, :]).sum(2)
            rest = along - own[np.arange(n), codes[:, j]]
            codes[:, j] = ((away * away).sum(2) + (ETA - 1) * (rest[:, None] + own) ** 2).argmin(1)
            along = rest + own[np.arange(n), codes[:, j]]
    return codes


def fit(x: np.ndarray, n_lists: int, rounds: int = 8) -> Model:
    """Centres by Lloyd's rounds and codewords by rounds of encoding and weighted refitting, from a sample."""
    y = augmented(x)
    rng = np.random.default_rng(7)
    centres = y[np.sort(rng.choice(len(y), min(n_lists, len(y)), False))].copy()
    for _ in range(rounds):
        of = _nearest(y, centres)
        size = np.bincount(of, minlength=len(centres))
        sums = np.stack([np.bincount(of, y[:, d], len(centres)) for d in range(y.shape[1])], 1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    of = _nearest(y, centres)
    r, u = _padded(y - centres[of]), _padded(_direction(y))
    m = r.shape[1] // 2
    words = np.zeros((m, CODEWORDS, 2))
    for j in range(m):
        part = r[:, 2 * j : 2 * j + 2]
        words[j] = part[rng.choice(len(part), CODEWORDS, len(part) < CODEWORDS)]
        for _ in range(rounds):
            code = _nearest(part, words[j])
            size = np.bincount(code, minlength=CODEWORDS)
            sums = np.stack([np.bincount(code, part[:, d], CODEWORDS) for d in range(2)], 1)
            words[j] = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], words[j])
    model = Model(centres, words)
    for _ in range(2):
        codes = encode(model, y, of)
        decoded = np.stack([model.codewords[j][codes[:, j]] for j in range(m)], 1).reshape(len(y), -1)
        along = ((r - decoded) * u).sum(1)
        for j in range(m):
            pu, pr = u[:, 2 * j : 2 * j + 2], r[:, 2 * j : 2 * j + 2]
            own = ((pr - decoded[:, 2 * j : 2 * j + 2]) * pu).sum(1)
            rest = along - own
            for k in range(CODEWORDS):
                at = codes[:, j] == k
                if at.sum() < 3:
                    continue
                a = at.sum() * np.eye(2) + (ETA - 1) * pu[at].T @ pu[at]
                b = pr[at].sum(0) + (ETA - 1) * (pu[at] * (rest[at] + (pr[at] * pu[at]).sum(1))[:, None]).sum(0)
                model.codewords[j, k] = np.linalg.solve(a, b)
    return model


def needed_probes(model: Model, x: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many lists hold at least that share of the true neighbours of some of the sample, within the sample."""
    lists = _nearest(augmented(x), model.centres)
    q = x[:: max(1, len(x) // queries)]
    norms = (x * x).sum(1)
    away = norms - 2 * q @ x.T
    away[np.arange(len(q)), np.arange(0, len(x), max(1, len(x) // queries))] = np.inf
    near = np.argsort(away, 1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
    rank = np.argsort(np.argsort(_list_order(model, q), 1, kind="stable"), 1, kind="stable")
    places = np.sort(np.take_along_axis(rank, lists[near], 1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1


def _list_order(model: Model, q: np.ndarray) -> np.ndarray:
    return (model.centres * model.centres).sum(1) - 2 * augmented(q) @ model.centres.T


def scan(model: Model, q: np.ndarray, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Approximate products (queries, rows) with augmented vectors, from their lists and 4-bit codes, by a table of 16 bytes for each query and pair."""
    qa = np.c_[q, np.ones(len(q))]
    padded = _padded(qa)
    tables = np.einsum("qjd,jkd->qjk", padded.reshape(len(q), model.pairs, 2), model.codewords)
    low = tables.min(2, keepdims=True)
    step = np.maximum((tables.max(2, keepdims=True) - low).max(1, keepdims=True) / 255, 1e-30)
    small = np.rint((tables - low) / step).astype(np.uint8)
    total = np.zeros((len(q), len(codes)), np.uint16 if model.pairs <= 257 else np.uint32)
    for j in range(model.pairs):
        total += small[:, j][:, codes[:, j]]
    return total * step[:, 0] + low.sum(1) + (qa @ model.centres.T)[:, lists]


def packed(codes: np.ndarray) -> list[bytes]:
    """Two codes to a byte."""
    codes = codes if codes.shape[1] % 2 == 0 else np.c_[codes, np.zeros(len(codes), np.uint8)]
    return [row.tobytes() for row in codes[:, ::2] | codes[:, 1::2] << 4]


def unpacked(rows: list[bytes], pairs: int) -> np.ndarray:
    both = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.stack([both & 15, both >> 4], 2).reshape(len(rows), -1)[:, :pairs]


def _clean(value: list | None) -> bool:
    if value is None:
        return False
    x = np.asarray(value, float)
    return x.size > 0 and bool(np.isfinite(x).all()) and bool(x.any())


def distinct_vectors(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """vector and ids: each distinct usable vector once, with its k + 1 smallest ids (ids of equal vectors tie, so no more are needed).

    A task combines its own copies first, so a very common vector is a row for each task. Vectors stay
    floats where they came as floats.
    """
    bounded_batches(vectors.sparkSession)
    narrow = dict(vectors.select(F.col(vector_col).alias("v")).dtypes)["v"] == "array<float>"
    kind, item = ("float", pa.float32()) if narrow else ("double", pa.float64())

    def combined(rows: Iterator[tuple[np.ndarray, list[int]]]) -> pa.RecordBatch:
        held: dict[bytes, set] = {}
        for vector, ids in rows:
            held.setdefault(vector.tobytes(), set()).update(ids)
        some = [np.frombuffer(v) for v in held]
        return pa.record_batch([_lists(some, item), pa.array([sorted(i)[: k + 1] for i in held.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield combined((np.asarray(v, float) + 0.0, [i]) for i, v in rows if i is not None and v is not None and None not in v and _clean(v))

    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    once = usable.mapInArrow(first, f"vector array<{kind}>, ids array<long>")
    merged = once.repartition(parts(vectors.sparkSession), "vector").groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    return materialise(merged)


def _lists(rows: list[np.ndarray], item: pa.DataType) -> pa.Array:
    """Vectors as an Arrow column of lists."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64()).cast(item))


def _stacked(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of a column as rows of d components, shorter ones with zeros in the other places."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(len(sizes), d).astype(float)
    out = np.zeros((len(sizes), d))
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def decoded(model: Model, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """The vectors (not augmented) that codes stand for, less the centres of their lists."""
    parts = np.stack([model.codewords[j][codes[:, j]] for j in range(model.pairs)], 1)
    return parts.reshape(len(codes), -1)[:, : model.centres.shape[1] - 1]


def margin(model: Model, x: np.ndarray, k: int, queries: int = 256) -> float:
    """How large the cosine between q - x and what x has beyond its code gets for true neighbours, within the sample, with a tenth to spare."""
    if len(x) < 2:
        return 1.0
    lists = _nearest(augmented(x), model.centres)
    r = x - model.centres[lists, :-1] - decoded(model, encode(model, augmented(x), lists), lists)
    lengths = np.sqrt((r * r).sum(1))
    norms = (x * x).sum(1)
    most = 0.0
    for at in range(0, len(x), max(1, len(x) // queries)):
        away = norms - 2 * (x @ x[at])
        away[at] = np.inf
        near = np.argpartition(away, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        gap = x[at] - x[near]
        whole = np.sqrt((gap * gap).sum(1)) * lengths[near]
        most = max(most, np.abs(np.divide((gap * r[near]).sum(1), whole, out=np.zeros(len(near)), where=whole > 0)).max())
    return float(min(1.0, 1.1 * most + 0.05))


def _sampled(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k nearest in the sample x, whose smallest ids differ; an infinite score where there are fewer."""
    scores, found = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
    norms = (x * x).sum(1)
    for at in range(0, len(q), 256):
        away = norms - 2 * q[at : at + 256] @ x.T
        away[own[at : at + 256, None] == ids] = np.inf
        near = np.argpartition(away, k - 1, 1)[:, :k] if away.shape[1] > k else np.tile(np.arange(away.shape[1]), (len(away), 1))
        for i, some in enumerate(near, at):
            some = some[np.isfinite(away[i - at, some])]
            score = np.sqrt(np.cumsum((q[i] - x[some]) ** 2, 1)[:, -1])
            by = np.lexsort((ids[some], score))
            scores[i, : len(by)], found[i, : len(by)] = score[by], ids[some][by]
    return scores, found


def _firsts(query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries, scores and ids by query, then score, then id, and each one's place in its query; an id counts once, by its best score."""
    by = np.lexsort((score, id_, query))
    query, score, id_ = query[by], score[by], id_[by]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (id_[1:] != id_[:-1])
    query, score, id_ = query[new], score[new], id_[new]
    by = np.lexsort((id_, score, query))
    query, score, id_ = query[by], score[by], id_[by]
    return query, score, id_, np.arange(len(query)) - np.searchsorted(query, query)


@dataclass
class Searcher:
    """Queries of one block that go over rows: own ids, vectors, scores and ids of the k nearest in the sample, and how many lists each visits."""

    model: Model
    spread: float
    k: int
    probes: int
    own: np.ndarray
    q: np.ndarray
    scores: np.ndarray
    ids: np.ndarray

    def __post_init__(self):
        self.known = self.ids.copy(), np.isfinite(self.scores)
        self.reach = self.scores[:, -1].copy()
        n = len(self.model.centres)
        self.visits = np.ones((n, len(self.q)), bool)
        if self.probes < n:
            for at in range(0, len(self.q), 1024):
                away = _list_order(self.model, self.q[at : at + 1024])
                far = np.argpartition(away, self.probes, 1)[:, self.probes :]
                self.visits[far, np.arange(at, at + len(away))[:, None]] = False

    def scan(self, list_: int, codes: np.ndarray, errors: np.ndarray, x: np.ndarray, ids: pa.Array) -> None:
        """Go over rows of one list: by code, then exactly where the code doesn't tell that a row is too far."""
        asked = np.flatnonzero(self.visits[list_])
        centre = self.model.centres[list_, :-1]
        r = decoded(self.model, codes, np.full(len(codes), list_))
        square = (r * r).sum(1)
        right = np.c_[r, square - errors * errors, errors].T
        within = np.sqrt(((x - centre) ** 2).sum(1).max())
        sizes = np.diff(ids.offsets.to_numpy())
        flat, starts = ids.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)[:-1]]
        for at in range(0, len(asked), QUERIES):
            some = asked[at : at + QUERIES]
            gap = self.q[some] - centre
            own = (gap * gap).sum(1)
            some, gap, own = (v[np.sqrt(own) - within <= self.reach[some] * (1 + 1e-9) + 1e-9 * np.sqrt(own)] for v in (some, gap, own))
            reach = np.where(np.isfinite(self.reach[some]), self.reach[some], 0.0)
            left = np.c_[-2 * gap, np.ones(len(some)), -2 * self.spread * reach]
            most = np.where(np.isfinite(self.reach[some]), reach * reach - own + 1e-9 * (own + square.max() + reach * reach), np.inf)
            i, j = np.nonzero(left @ right <= most[:, None])
            for part in range(0, len(i), PAIRS):
                self._measured(some[i[part : part + PAIRS]], j[part : part + PAIRS], x, flat, starts, sizes)

    def _measured(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        gap = self.q[i] - x[j]
        near = np.einsum("nd,nd->n", gap, gap) <= self.reach[i] ** 2 * (1 + 1e-9)
        i, j = i[near], j[near]
        if not len(i):
            return
        score = np.sqrt(np.cumsum(gap[near] ** 2, 1)[:, -1])  # added up in order, as SQL does
        n = sizes[j]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[j], n)
        i, score, id_ = np.repeat(i, n), np.repeat(score, n), ids[place]
        other = id_ != self.own[i]
        rows, i = np.unique(i[other], return_inverse=True)
        known = np.isfinite(self.scores[rows])
        old = np.repeat(np.arange(len(rows)), self.k).reshape(-1, self.k)[known]
        query, score, id_, at = _firsts(np.r_[old, i], np.r_[self.scores[rows][known], score[other]], np.r_[self.ids[rows][known], id_[other]])
        kept = at < self.k
        self.scores[rows[query[kept]], at[kept]], self.ids[rows[query[kept]], at[kept]] = score[kept], id_[kept]
        self.reach[rows] = np.minimum(self.reach[rows], self.scores[rows, -1])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own ids, ids and scores of what was found beyond the sample."""
        ids, there = self.known
        query, at = np.nonzero(np.isfinite(self.scores) & ~((self.ids[:, :, None] == ids[:, None, :]) & there[:, None, :]).any(2))
        return self.own[query], self.ids[query, at], self.scores[query, at]


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found for each row whose id is divisible by every.

    Vectors that are null, empty, zero, or hold a null or a non-finite component take
    no part, nor do null ids. A vector shorter than the longest has zeros in the other
    places. Equal distances go to the smaller id; a repeated id with equal vectors counts
    once. Nothing usable gives no rows. Other columns are ignored.

    Every row is indexed. A query goes over the codes of the lists that it visits, but for those that are
    wholly too far; what may be near by its code is measured exactly, copies of a vector once. How many lists it
    visits follows from the sample, so that they hold more than the share recall of its neighbours; vectors
    without clusters need many. Rows are neither dealt to queries nor queries to lists: a block of
    queries is broadcast, each task takes it over its rows, and leaves k rows a query. So disk and
    memory don't grow with the pairs; the time of unclustered vectors does.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    distinct = distinct_vectors(vectors, k, id_col, vector_col)
    kind = dict(distinct.dtypes)["vector"]
    size = distinct.agg(F.max(F.size("vector")).alias("d"), F.count("*").alias("c")).first()
    if not size.c:
        return spark.createDataFrame([], out)
    d = size.d
    chosen = distinct.orderBy(F.xxhash64("vector"), "vector").limit(FIT_ROWS).toArrow()
    sample = _stacked(chosen.column("vector").combine_chunks(), d)
    first_ids, unique = np.unique(np.array([i[0] for i in chosen.column("ids").to_pylist()]), return_index=True)
    model = fit(sample, int(min(1024, max(1, round(np.sqrt(size.c) / 2)))))
    probes = needed_probes(model, sample, k, (1 + recall) / 2)
    spread = margin(model, sample, k)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch.column(0), d)
                lists = _nearest(augmented(x), model.centres)
                codes = encode(model, augmented(x), lists)
                beyond = x - model.centres[lists, :-1] - decoded(model, codes, lists)
                yield pa.record_batch([*batch.columns, pa.array(lists), pa.array(packed(codes), pa.binary()), pa.array(np.sqrt((beyond * beyond).sum(1)))], ["vector", "ids", "list", "codes", "error"])

    coded = materialise(distinct.mapInArrow(listed, f"vector {kind}, ids array<long>, list long, codes binary, error double").sortWithinPartitions("list"))
    delete(distinct)
    usable = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast(kind).alias("q")).where(F.col("query_id") % every == 0)
    sound = F.size("q") > 0
    for test in (
        F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        F.exists("q", lambda x: x != 0),
    ):
        sound = sound & test

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores, ids = _sampled(_stacked(batch.column(1), d), batch.column(0).to_numpy(), sample[unique], first_ids, k)
                yield pa.record_batch([*batch.columns, pa.array(list(scores), pa.list_(pa.float64())), pa.array(list(ids), pa.list_(pa.int64()))], ["query_id", "q", "scores", "ids"])

    queries = materialise(usable.where(sound).distinct().mapInArrow(reached, f"query_id long, q {kind}, scores array<double>, ids array<long>"))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = [_searched(coded, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), model, spread, k, probes, d) for b in range(blocks)]
    each = queries.select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("x")).select("query_id", "x.*").where("score < double('infinity')")
    for some in found:
        each = each.unionByName(some)
    best = each.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def _searched(coded: DataFrame, queries: DataFrame, model: Model, spread: float, k: int, probes: int, d: int) -> DataFrame:
    """query_id, vec_id and score, written: what each task's rows have for a block of queries, k rows a query at most."""
    asked = queries.toArrow().combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in asked.columns]
    block = coded.sparkSession.sparkContext.broadcast((columns[0].to_numpy(), _stacked(columns[1], d), _stacked(columns[2], k), columns[3].flatten().to_numpy().reshape(-1, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, scores, ids = block.value
        one = Searcher(model, spread, k, probes, own, q, scores.copy(), ids.copy())
        for batch in batches:
            lists = batch.column(2).to_numpy()
            for begin, end in _runs(lists):
                part = batch.slice(begin, end - begin)
                one.scan(int(lists[begin]), unpacked(part.column(3).to_pylist(), model.pairs), part.column(4).to_numpy(), _stacked(part.column(0), d), part.column(1))
        yield pa.record_batch(list(map(pa.array, one.best())), ["query_id", "vec_id", "score"])

    done = materialise(coded.mapInArrow(run, "query_id long, vec_id long, score double"))
    block.unpersist()
    return done


def _runs(lists: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal values, of ROWS at most."""
    cuts = np.r_[0, np.flatnonzero(np.diff(lists)) + 1, len(lists)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        for at in range(a, b, ROWS):
            yield int(at), int(min(b, at + ROWS))
