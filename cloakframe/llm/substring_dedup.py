"""Substring dedup by seed and extend: remove words of passages that repeat anywhere.

Documents are joined on winnowed anchors (seeds.py). From an anchor the matches of all
its occurrences are extended word by word to the left and to the right, as far as a
passage of the threshold around the anchor can reach; passages that two occurrences
share are marked, and marks that overlap or adjoin merge to maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import seeds


def extended(match: np.ndarray, words: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The classes of occurrences that still match after one more word; those without a word match nothing."""
    _, out = np.unique(np.stack([match, words]), axis=1, return_inverse=True)
    return np.where(has, out.ravel(), -1 - np.arange(len(match)))


def _judge(shape: seeds.Shape) -> seeds.Judge:
    reach = shape.window - shape.gram

    def repeated(code: np.ndarray, left: np.ndarray, n: np.ndarray, least: np.ndarray, count: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Bits of the windows that stand twice or more."""
        known: dict[bytes, int] = {}
        of = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
        one = np.empty(len(known), np.int64)
        one[of] = np.arange(len(of))
        times = np.zeros(len(known), np.int64)
        np.add.at(times, of, count)
        n, left = n.astype(np.int64)[one], left.astype(np.int64)[one]
        bits = np.where(times > 1, (np.int64(1) << n) - 1, 0)
        _, inverse, size = np.unique(code[one], return_inverse=True, return_counts=True)
        some = np.flatnonzero(size[inverse] > 1)
        if len(some):
            names: dict[bytes, int] = {}
            texts = list(known)
            tokens = [[names.setdefault(w, len(names)) for w in texts[i].split(b" ")] for i in some.tolist()]
            row = np.array([w for t in tokens for w in t])
            begin = np.cumsum([0, *map(len, tokens)])
            at = begin[:-1] + left[some]
            start = np.zeros(len(some), np.int64)
            for k in range(shape.gram):
                start = extended(start, row[at + k], np.ones(len(some), bool))
            ways = []
            for step, edge in ((-1, begin[:-1] - 1), (1, begin[1:])):
                match, place = start, at - 1 if step < 0 else at + shape.gram
                to = [match]
                for k in range(reach):
                    has = (place < edge) if step > 0 else (place > edge)
                    match = extended(match, row[np.where(has, place, 0)], has)
                    to.append(match)
                    place = place + step
                ways.append(to)
            for k in range(reach + 1):
                bit = left[some] - k
                here = np.flatnonzero((bit >= 0) & (bit < n[some]))
                if len(here):
                    _, group = np.unique(np.stack([ways[0][k][here], ways[1][reach - k][here]]), axis=1, return_inverse=True)
                    group = group.ravel()
                    twice = np.bincount(group, times[some[here]])[group] > 1
                    bits[some[here]] |= twice.astype(np.int64) << bit[here]
        return bits[of]

    return repeated


def repeated_passages(docs: DataFrame, window: int = 35, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", crowded: int = seeds.CROWDED) -> DataFrame:
    """doc_id, n_words, spans (array of start and stop in words) and kept (the other words, joined by one space).

    A word is in a span if a window of so many words around it also starts elsewhere in
    the table, the same text included. Null and shorter texts have no spans; a very long
    text is hashed in chunks, but its words are held by one task; repeated rows are
    repeats of each other; rows of null or equal id are told apart. Other columns are
    ignored; no rows give no rows.
    """
    shape = seeds.Shape(window, gram)

    def finish(texts: seeds.Words, gone: np.ndarray, bodies: list[bytes], carry: list[pa.Array]) -> pa.RecordBatch:
        spans, kept = [], []
        hit = np.r_[0, np.cumsum(gone)][texts.bounds]
        for i in range(len(bodies)):
            words = texts.words(i)
            mine = gone[texts.bounds[i] : texts.bounds[i + 1]]
            spans.append([{"start": a, "stop": z} for a, z in seeds.runs(mine).tolist()] if hit[i] != hit[i + 1] else [])
            kept.append(b" ".join(w for w, g in zip(words, mine.tolist()) if not g).decode())
        return pa.record_batch([carry[0], pa.array(np.diff(texts.bounds)), pa.array(spans, seeds.SPANS), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    schema = "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, kept string"
    return seeds.marked(docs, id_col, text_col, seeds.Words, shape, _judge(shape), False, finish, schema, ["doc_id"], crowded)
