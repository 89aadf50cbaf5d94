"""Vector best-fit packing of token pieces into sequences.

A piece takes up tokens, one document slot and attention cost (its length squared), all given by its length. So the
lengths' histogram, of at most `capacity` counts whatever the corpus holds, says everything that best-fit decreasing
needs: the driver packs the histogram, bins of equal residual capacities as one group, and gets for each length a list
of (ranks, sequences, offset) runs. The pieces themselves never leave their tasks but for one shuffle of their short
rows: a piece's rank among those of its length is its rank within its task plus the count in earlier tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoder
from tidemark.llm.common import batches, bounded_batches, extended, flat_bytes, removed, stored


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; None for documents and attention: as many, and as much, as its tokens allow."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)


def best_fit(histogram: dict[int, int], limits: Limits, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> np.ndarray:
    """Runs (length, first rank, first sequence, offset, count), sorted by length and rank.

    Lengths are placed in descending order. Of the groups of bins that hold one more piece under every capacity, the one
    with the least weighted norm of what stays free is taken (score "norm"), or that with the largest weighted product of
    need and free capacity ("dot"). A length that no empty bin holds is an error.
    """
    capacity, w = limits.vector(), np.array(weights)
    free = np.zeros((0, 3))  # of each group of bins
    bins: list[list[tuple[int, int]]] = []  # of each group: (first sequence, count)
    where: dict[tuple, int] = {}
    runs, opened = [], 0

    def put(residual: np.ndarray, first: int, count: int) -> None:
        nonlocal free
        key = tuple(residual.tolist())
        if key not in where:
            empty = next((i for i, b in enumerate(spare) if not bins[b]), None)
            if empty is None:
                where[key] = len(bins)
                bins.append([])
                free = np.vstack([free, residual])
            else:
                at = spare.pop(empty)
                where[key], free[at] = at, residual
        bins[where[key]].append((first, count))

    spare: list[int] = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length**2], np.float64)
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1)) if len(free) else np.zeros(0, int)
            if len(fits):
                rest = (free[fits] - need) / capacity
                by = (rest**2 @ w) if score == "norm" else -((free[fits] / capacity) @ (w * need / capacity))
                group = int(fits[np.argmin(by)])
                residual = free[group].copy()
                first, count = bins[group].pop()
                if not bins[group]:
                    del where[tuple(residual.tolist())]
                    free[group] = -1
                    spare.append(group)
            else:
                residual, first, count = capacity.copy(), opened, left
            each = int(min(residual // need))  # a bin just filled is the best fit for the next piece too
            whole = min(count, left // each)
            offset = int(capacity[0] - residual[0])
            took = [(first, whole, each)] if whole else []
            if whole < count and whole * each < left:
                took.append((first + whole, 1, left - whole * each))
            for start, n, k in took:
                for j in range(k):
                    runs.append((length, rank + j * n, start, offset + j * length, n))
                rank += n * k
                left -= n * k
                put(residual - k * need, start, n)
            used = sum(n for _, n, _ in took)
            if first == opened:
                opened += used
            elif used < count:
                put(residual, first + used, count - used)
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def cut(df: DataFrame, tokenizer_path: str, tokens: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and its task and rank among that task's pieces of its length.

    A document is its ids and end_id. Longer ones than `tokens` are cut so that only the first piece is shorter. A null
    or empty text is the end_id alone. Rows that repeat are packed as often as they occur.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(key).schema, "piece int, start bigint, length bigint, ids_crc32 bigint, task int, task_rank bigint")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        had = np.zeros(tokens + 1, np.int64)
        for x in batches(frames):
            ids, starts = bpe.encode(*flat_bytes(x.column(1)))
            ids = np.insert(ids, starts[1:], end_id).astype("<u4")
            starts = starts + np.arange(len(starts))
            sizes = np.diff(starts)
            pieces = -(-sizes // tokens)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = sizes[doc] - (pieces[doc] - 1) * tokens
            start = np.where(piece == 0, 0, first + (piece - 1) * tokens)
            length = np.where(piece == 0, first, tokens)
            order = np.argsort(length, kind="stable")
            own = np.bincount(length, minlength=tokens + 1)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(had, own)
            had += own
            data, at = memoryview(ids).cast("B"), (starts[doc] + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            n = len(doc)
            columns = [x.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(n, task, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def placed(pieces: DataFrame, limits: Limits, **options) -> DataFrame:
    """pieces (see cut(), stored: it is read three times) with sequence_id and offset."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limits.tokens rows
    shared = pieces.sparkSession.sparkContext.broadcast(best_fit(histogram, limits, **options))  # a few runs a length
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"])
    keep = [c for c in pieces.columns if c not in ("task", "task_rank")]
    schema = extended(pieces.select(*keep).schema, "sequence_id bigint, offset bigint")
    width = 44  # bits of a rank

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        firsts = runs[:, 0] << width | runs[:, 1]
        for x in batches(frames):
            length, rank = (x.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (len(keep), len(keep) + 1))
            i = np.searchsorted(firsts, length << width | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.array(runs[i, 2] + rank - runs[i, 1]), pa.array(runs[i, 3])], schema.names)

    return ranked.select(*keep, F.col("length").alias("_length"), (F.col("before") + F.col("task_rank")).alias("_rank")).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 2, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Pack all documents into sequences; one row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Offsets in a sequence have no gaps. An empty table gives an empty result. The pieces' short rows are kept in the
    shared folder, as the histogram and the placing both read them.
    """
    pieces, _ = stored(cut(df, tokenizer_path, limits.tokens, end_id, text, key))
    return placed(pieces, limits, **options)
