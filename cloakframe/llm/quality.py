"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every whole text are computed once, on the executors. A bounded
sample of labelled rows (max_train_rows, those with the smallest hash of the id)
trains the trees on the driver; as flat arrays they go back to score all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, bounded_batches, materialise, text_bytes

MARKS = b"!#$%&*|?.,;:"
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 punctuation, 7 beyond ASCII
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 6
_CLASS[128:] = 7


def statistics(body: bytes) -> list[float]:
    """What the trees see of a text; an empty one gives zeros."""
    seen = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=seen, minlength=8)
    size = max(1, len(body))
    words = body.split()
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in body.split(b"\n") if x]
    n_lines = max(1, len(lines))
    return [
        float(np.log1p(len(body))),
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        *(kinds[1:] / size).tolist(),
        *(float(seen[m]) / n for m in MARKS),
        len(counts) / n,
        (max(counts.values()) if counts else 0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.isalpha, words)) / n,
        float(np.log1p(len(body) / n_lines)),
        len(set(lines)) / n_lines,
        float(np.log1p(n_lines)),
    ]


N_STATISTICS = len(statistics(b""))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats of every document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(body) for body in blobs(batch.column(1))], np.float32).reshape(-1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * N_STATISTICS)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(found))], ["doc_id", "stats"])

    return text_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, stats array<float>")


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 4, l2: float = 1.0) -> Trees:
    """Boosted trees for log loss; without rows every score is 0.5."""
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    nodes: list[list[float]] = []
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        flat = binned + np.arange(x.shape[1]) * bins
        total = np.full(len(y), prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(nodes))
            nodes.append([])
            work = [(len(nodes) - 1, np.arange(len(y)), 0)]
            while work:
                at, rows, level = work.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                best = _split(flat[rows], grad[rows], hess[rows], x.shape[1], bins, least, l2) if level < depth else None
                if best is None:
                    step = -rate * g / (h + l2)
                    nodes[at] = [0, np.inf, at, at, step]
                    total[rows] += step
                    continue
                f, b = best
                nodes[at] = [f, edges[f][b], len(nodes), len(nodes) + 1, 0.0]
                nodes += [[], []]
                low = binned[rows, f] <= b
                work += [(len(nodes) - 2, rows[low], level + 1), (len(nodes) - 1, rows[~low], level + 1)]
    table = np.array(nodes, float).reshape(-1, 5)
    whole = lambda c: table[:, c].astype(np.int64)
    return Trees(float(prior), np.array(roots, np.int64), whole(0), table[:, 1], whole(2), whole(3), table[:, 4], depth)


def _split(flat: np.ndarray, grad: np.ndarray, hess: np.ndarray, features: int, bins: int, least: int, l2: float) -> tuple[int, int] | None:
    """The feature and bin whose split gains most, from histograms of the sums of gradients."""
    size = features * bins
    cells = flat.ravel()
    sums = [np.bincount(cells, np.repeat(w, features), size).reshape(features, bins).cumsum(1) for w in (grad, hess, np.ones(len(grad)))]
    (g, h, n), (tg, th, tn) = sums, (s[:, -1:] for s in sums)
    gain = g**2 / (h + l2) + (tg - g) ** 2 / (th - h + l2) - tg**2 / (th + l2)
    gain[(n < least) | (tn - n < least)] = -1
    best = int(gain.argmax())
    return divmod(best, bins) if gain.flat[best] > 1e-6 else None


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def chosen(labels: DataFrame, label: str = "quality", max_train_rows: int = 20_000) -> DataFrame:
    """doc_id and y of the labelled rows that aren't held out, at most max_train_rows of them, those with the smallest hash of the id.

    Rows with null id or label don't count; an id labelled more than once has its smallest label.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    return materialise(known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows))


def fit(stats: DataFrame, some: DataFrame) -> Trees:
    """Trees from the statistics (doc_id, stats) of the chosen rows, of which there are at most max_train_rows; of a repeated id one row counts."""
    rows = stats.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("stats", "y"), F.xxhash64("stats")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    x = np.array([r.stats for r in rows], float).reshape(-1, N_STATISTICS)
    return train(x, np.array([r.y for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and score (0 to 1) of every row of docs.

    Null and empty texts are scored like any other; repeated ids are scored row by
    row; a null id is held out. Other columns are never read. Empty docs give no rows;
    without usable labels every score is 0.5. A very long text is read whole, and only its
    statistics travel; ties and repeated rows are scored alike.
    """
    stats = materialise(with_statistics(docs, id_col, text_col))
    model = fit(stats, chosen(labels, label, max_train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, N_STATISTICS)
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", max_train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of threshold or more, in one pass without a shuffle of the texts.

    The statistics are worked out twice, for the chosen labelled rows, whose ids are few
    enough to be broadcast, and for all. Cases as in score; a very long text is held
    whole by one task.
    """
    some = chosen(labels, label, max_train_rows)
    ids = F.broadcast(some.select(F.col("doc_id").alias("_chosen")))
    model = fit(with_statistics(docs.join(ids, F.col(f"`{id_col}`") == F.col("_chosen"), "left_semi"), id_col, text_col), some)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(body) for body in blobs(batch.column(at).cast(pa.binary()))], np.float32).astype(float).reshape(-1, N_STATISTICS)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
