"""Vector best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, parallelism
from .tokens import encoder

MAX_TOKENS = 2048
SEPARATOR = 0
GROUP = 16_384
WEIGHTS = (1.0, 0.02, 0.02)
#: Where a limit isn't given its term is this much lighter: less than a token's worth, so it decides between equals only.
OPEN = 1e-6


def best_fit(
    lengths: np.ndarray,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, longest first into the open bin that suits it best.

    A bin has three residual capacities, each as a share of its whole: tokens, documents, attention cost (the sum of
    squared lengths). A piece may only go where all three hold. Among those bins, rule "norm" takes the smallest
    weighted norm of what would be left, "dot" the largest weighted dot product of need and residual. Without
    max_documents and max_attention those two can't bind and only break ties. Ties go to the oldest bin. A piece that
    fits no empty bin is an error.
    """
    caps = np.array([max_tokens, max_documents or max_tokens, max_attention or max_tokens**2], np.float64)
    w = np.array(weights) * [1, 1 if max_documents else OPEN, 1 if max_attention else OPEN]
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), -lengths))
    least = int(lengths.min()) if n else 0
    left = np.zeros((3, 1024))
    number = np.zeros(1024, np.int64)
    opened = count = 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1, size * size]) / caps
        if (need > 1 + 1e-12).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        spot = -1
        if opened:
            after = left[:, :opened] - need[:, None]
            fits = (after > -1e-9).all(axis=0)
            if fits.any():
                score = (w[:, None] * after * after).sum(axis=0) if rule == "norm" else -(w[:, None] * left[:, :opened] * need[:, None]).sum(axis=0)
                spot = int(np.where(fits, score, np.inf).argmin())
        if spot < 0:
            if opened == left.shape[1]:
                left, number = np.concatenate([left, np.zeros_like(left)], axis=1), np.concatenate([number, np.zeros_like(number)])
            spot, opened = opened, opened + 1
            left[:, spot], number[spot], count = 1, count, count + 1
        bins[i], offsets[i] = number[spot], round((1 - left[0, spot]) * max_tokens)
        left[:, spot] -= need
        if left[0, spot] * max_tokens < least - 1e-6 or (left[1:, spot] < 1e-9).any():  # nothing fits in it any more
            opened -= 1
            left[:, spot : opened], number[spot : opened] = left[:, spot + 1 : opened + 1].copy(), number[spot + 1 : opened + 1].copy()
    return bins, offsets


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = MAX_TOKENS,
    separator: int = SEPARATOR,
    group: int = GROUP,
    emit: str = "ids",
    **limits,
) -> DataFrame:
    """doc_id, piece, start, length, ids (or ids_crc32), sequence_id, offset: a row for each piece of each document.

    Every document is its ids and the separator; one beyond max_tokens is cut into pieces of max_tokens, whose last
    may be shorter. Pieces are spread by hash, so every partition has the same mix of lengths however the files are laid
    out, then packed in groups of at least `group` (the last of a partition may be smaller); partitions hold a group or
    more on average. Memory is bounded; the room lost is about a sequence a group and what chance leaves uneven.
    emit: "ids" for the token ids, "crc32" for their checksum alone. Null or empty text: just the separator. Null and
    repeated ids are rows like any others; other columns are ignored; an empty table gives no rows.
    """
    bound_batches(spark)
    kind = "ids array<int>" if emit == "ids" else "ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", kind.split()[0]]
    schema = f"doc_id long, piece int, start long, length long, {kind}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([separator], "<u4")
        for batch in batches:
            held: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    held.append((doc, piece, start, len(part), part.view("<i4") if emit == "ids" else zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()) if emit == "ids" else pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)], names)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, rows
            bins, offsets = best_fit(np.concatenate([h.column(3).to_numpy() for h in held]), max_tokens, **limits)
            at = 0
            for h in held:
                own = slice(at, at := at + h.num_rows)
                yield pa.RecordBatch.from_arrays([*h.columns, pa.array(bins[own] + sequence), pa.array(offsets[own])], [*names, "sequence_id", "offset"])
            sequence += int(bins.max()) + 1
            held.clear()
            rows = 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= group:
                yield from flush()
        if held:
            yield from flush()

    parts = max(1, min(parallelism(spark), docs.count() // group))
    pieces = docs.select("doc_id", "text").mapInArrow(cut, schema)
    return pieces.repartition(parts, F.xxhash64(*names)).mapInArrow(fit, f"{schema}, sequence_id long, offset long")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), emit="crc32")
