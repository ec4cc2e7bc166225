"""Product codes of vectors by delta-maintained Lloyd rounds on integers.

Vectors become integers and are cut into equal parts; each position has a codebook. A
round assigns every part to its nearest entry and writes the codes beside those of the round
before. Only parts whose entry changed are then shuffled: plus to the new entry, minus
from the old, summed up within a task first. Running sums are a small table that takes up these
contributions, so a late round moves next to nothing, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, delete, materialise

PARTS, ENTRIES, SCALE = 16, 64, 256
#: Components beyond this, scaled, count as not finite: sums of their squares would not fit into 64 bits.
LARGEST = 1 << 24


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and cells (floor of the scaled components) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) * SCALE >= LARGEST))
    rows = vectors.where(F.col(vector_col).isNotNull() & ~bad & (F.size(x) > 0) & (F.size(x) % PARTS == 0))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("cells"))
    rows = materialise(rows)
    width = rows.groupBy(F.size("cells").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("cells") == (width.width if width else 0))


def nearest_entries(cells: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and summed squared distances of cells (n, parts, width) by books (parts, entries, width), exactly."""
    largest = max(int(np.abs(cells).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 4 * cells.shape[2] * largest * largest < 1 << 53 else np.int64
    codes, errors = np.empty(cells.shape[:2], np.uint8), np.zeros(len(cells), np.int64)
    for j, book in enumerate(books.astype(kind)):
        x = cells[:, j].astype(kind)
        gaps = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
        codes[:, j] = gaps.argmin(1)  # the first of equals
        errors += gaps[np.arange(len(x)), codes[:, j]].astype(np.int64)
    return codes, errors


def _cells(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width // PARTS)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PARTS)


def assigned(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """rows with code and error by books; before has the code of the round before, null at first."""
    before = F.col("code") if "code" in rows.columns else F.lit(None).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = nearest_entries(_cells(batch.column(2), width), books)
            yield pa.record_batch([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], ["vec_id", "label", "cells", "before", "code", "error"])

    plain = rows.select("vec_id", "label", "cells", before.alias("before"))
    return plain.mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, cells array<int>, before binary, code binary, error long")


def contributions(rows: DataFrame, entries: int, width: int) -> DataFrame:
    """part, entry, place, n and total: what the changed parts of rows add to and take from each entry, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, entries, width // PARTS), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            cells, code, had = _cells(batch.column(0), width), _codes(batch.column(1)), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            before = np.zeros_like(code)
            before[had] = _codes(batch.column(2).drop_null())
            changed = (code != before) | ~had[:, None]
            for sign, own, which in ((1, code, changed), (-1, before, changed & had[:, None])):
                for j in range(PARTS):
                    at = which[:, j]
                    np.add.at(sums[j], own[at, j], sign * cells[at, j])
                    np.add.at(counts[j], own[at, j], sign)
        part, entry, place = (x.ravel() for x in np.indices(sums.shape))
        n = np.repeat(counts.ravel(), width // PARTS)
        some = (n != 0) | (sums.ravel() != 0)
        yield pa.record_batch([pa.array(x[some]) for x in (part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), n, sums.ravel())], ["part", "entry", "place", "n", "total"])

    changed = rows.where("before is null or before <> code").select("cells", "code", "before")
    return changed.mapInArrow(run, "part int, entry int, place int, n long, total long")


def first_books(rows: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows of the smallest ids (null last), ties by their cells."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "cells").select("cells").limit(entries).collect()
    return np.array([r.cells for r in first], np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)


def compressed(vectors: DataFrame, rounds: int = 2, entries: int = ENTRIES, **columns) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (one byte a part) and error of every vector that takes part, and the final codebooks.

    A null vector, or one that holds a null, a non-finite or a huge component (2^16 or more), takes no
    part; nor does one whose length isn't a multiple of 16, or isn't the most frequent such length (of equals
    the longest). Zero vectors, repeated rows and ids and null ids and labels take part; null ids never
    come before others among the first entries. Fewer rows than entries make smaller codebooks. Codebooks, of
    entries x length integers, are all that the driver holds. Other columns are ignored; no rows give no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = integers(vectors, **columns)
    first = rows.select(F.size("cells").alias("width")).first()
    if first is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    width = first.width
    books = first_books(rows, width, entries)
    running = None
    for _ in range(rounds):
        after = materialise(assigned(rows, books, width))
        if running is not None:
            delete(rows)
        rows = after
        delta = contributions(rows, books.shape[1], width)
        both = delta if running is None else running.unionByName(delta)
        running = materialise(both.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        for r in running.where("n > 0").toLocalIterator():
            books[r.part, r.entry, r.place] = r.total // r.n
    return assigned(rows, books, width).select("vec_id", "label", "code", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows of its label, nulls together."""
    coded = materialise(coded)
    sums = materialise(coded.groupBy(F.col("label").alias("label_b")).agg(F.sum("error").alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("label_b"))).drop("label_b")


def hex_code(code: Column | str) -> Column:
    return F.lower(F.hex(code))


def written(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))
