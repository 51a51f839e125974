"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents

THRESHOLD = 0.3
SAMPLE_ROWS = 8000

_CLASS = np.full(256, 6, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 stop, 5 symbol, 6 beyond ASCII
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:?'-" else 5

#: Bin edges of each numeric property of a line.
_EDGES = {
    "length": [8, 16, 32, 64, 128, 256, 512, 1024, 4096],
    "upper": [0.005, 0.03, 0.08, 0.2, 0.5, 0.8],
    "symbol": [0.001, 0.01, 0.03, 0.08, 0.15, 0.25],
    "digit": [0.001, 0.01, 0.03, 0.1, 0.3],
    "foreign": [0.001, 0.02, 0.06, 0.15, 0.5],
    "distinct": [0.2, 0.4, 0.55, 0.7, 0.8, 0.9, 0.999],
    "word": [2, 3, 4, 5, 6, 7, 9, 14],
    "stop": [0.001, 0.01, 0.02, 0.035, 0.06, 0.1, 0.3],
    "marked": [0.01, 0.1, 0.3, 0.6, 0.9],  # symbols a word
    "repeat": [0.5],  # whether an earlier line of the document is equal
    "shape": [0.5, 1.5, 2.5],  # starts with a capital (2), ends with a stop (1)
}
_NAMES = list(_EDGES)
BINS = max(len(e) for e in _EDGES.values()) + 1
FEATURES = len(_NAMES)
NONE = FEATURES * BINS  # the bin of a neighbour that isn't there
ROWS = NONE + 1


def line_bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines x FEATURES), length in bytes of each line that isn't blank, and number of such lines by text."""
    lines: list[bytes] = []
    counts, distinct, repeat = [], [], []
    for t in texts:
        seen: set[str] = set()
        before = len(lines)
        for line in (t or "").split("\n"):
            words = line.split()
            if words:
                lines.append(line.encode("utf-8", "surrogatepass"))
                distinct.append(len(set(words)) / len(words))
                repeat.append(line in seen)
                seen.add(line)
        counts.append(len(lines) - before)
    n = len(lines)
    if not n:
        return np.zeros((0, FEATURES), np.int16), np.zeros(0), np.array(counts, np.int64)
    size = np.array([len(x) for x in lines])
    ends = np.cumsum(size)
    raw = np.frombuffer(b"".join(lines), np.uint8)
    kind = _CLASS[raw]
    start = ends - size
    number = [np.add.reduceat(kind == k, start, dtype=np.int64) for k in range(7)]
    lower, upper, digit, space, stop, symbol, foreign = number
    words = space + 1
    got = {
        "length": size,
        "upper": upper / np.maximum(upper + lower, 1),
        "symbol": symbol / size,
        "digit": digit / size,
        "foreign": foreign / size,
        "distinct": np.array(distinct),
        "word": (size - space) / words,
        "stop": stop / size,
        "marked": symbol / words,
        "repeat": np.array(repeat, float),
        "shape": 2.0 * (kind[start] == 1) + (kind[ends - 1] == 4),
    }
    bins = [np.searchsorted(_EDGES[f], got[f], "right") + i * BINS for i, f in enumerate(_NAMES)]
    return np.stack(bins, axis=1).astype(np.int16), size.astype(float), np.array(counts, np.int64)


def _around(bins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the line before and of the line behind, in the same document."""
    before, behind = np.full_like(bins, NONE), np.full_like(bins, NONE)
    before[1:], behind[:-1] = bins[:-1], bins[1:]
    ends = np.cumsum(counts)[counts > 0]
    before[ends - counts[counts > 0]] = NONE
    behind[ends - 1] = NONE
    return before, behind


@dataclass
class LineField:
    """Weights of own, preceding and following line's bins (3 x ROWS), transition potentials (2 x 2), calibration."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, bins: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.clip(w[0][bins].sum(axis=1) + w[1][before].sum(axis=1) + w[2][behind].sum(axis=1), -25, 25)

    def marginals(self, odds: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(good) of each line by forward-backward, all chains side by side; with pairs, also P(s, s') summed."""
        p = np.exp(self.moves)
        order = np.argsort(-counts, kind="stable")
        length = counts[order]
        first = (np.cumsum(counts) - counts)[order]
        steps = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(steps), "left")  # chains longer than t
        e = np.exp(odds)
        ahead, back = np.empty_like(odds), np.empty_like(odds)
        a = None
        for t in range(steps):
            at = first[: alive[t]] + t
            if t == 0:
                good, bad = e[at], np.ones(len(at))
            else:
                a = a[: alive[t]]
                good, bad = (a * p[1, 1] + (1 - a) * p[0, 1]) * e[at], a * p[1, 0] + (1 - a) * p[0, 0]
            a = good / (good + bad)
            ahead[at] = a
        b = np.ones(0)
        total = np.zeros((2, 2))
        for t in range(steps - 1, -1, -1):
            at = first[: alive[t]] + t
            now = np.ones(len(at))
            if len(b):
                nxt = at[: len(b)] + 1
                on = e[nxt] * b
                now[: len(b)] = (p[1, 1] * on + p[1, 0]) / (p[0, 1] * on + p[0, 0])
                if pairs:
                    f = ahead[at[: len(b)]]
                    x = np.stack([(1 - f) * p[0, 0], (1 - f) * p[0, 1] * on, f * p[1, 0], f * p[1, 1] * on])
                    total += (x / x.sum(axis=0)).sum(axis=1).reshape(2, 2)
            b = now
            back[at] = b
        good = ahead * back
        m = good / (good + 1 - ahead)
        return (m, total) if pairs else m

    def raw(self, bins: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines' marginals; 0 for a document without lines."""
        out = np.zeros(len(counts))
        if len(bins):
            m = self.marginals(self.odds(bins, *_around(bins, counts)), counts)
            some = counts > 0
            start = (np.cumsum(counts) - counts)[some]
            mean = np.add.reduceat(m * size, start) / np.add.reduceat(size, start)
            out[some] = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = self.raw(*line_bins(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))


def train(bins: np.ndarray, size: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 120, ridge: float = 2.0) -> LineField:
    """Maximum conditional likelihood by Adam; each line bears its document's label. Then a logistic calibration."""
    model = LineField(np.zeros((3, ROWS)), np.zeros((2, 2)))
    if len(bins) and 0 < good.sum() < len(good):
        views = (bins, *_around(bins, counts))
        y = np.repeat(good.astype(float), counts)
        n = len(y)
        same = np.array([[((counts - 1) * (1 - good))[counts > 0].sum(), 0], [0, ((counts - 1) * good)[counts > 0].sum()]], float)
        state = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros((2, 2)), np.zeros((2, 2))]
        for k in range(1, rounds + 1):
            m, pairs = model.marginals(model.odds(*views), counts, pairs=True)
            d = np.repeat(y - m, FEATURES)
            grad = np.stack([np.bincount(v.ravel(), d, ROWS) for v in views]) - ridge * model.weights
            turn = same - pairs - ridge * model.moves
            for value, g, i in ((model.weights, grad / n, 0), (model.moves, turn / n, 2)):
                state[i] = 0.9 * state[i] + 0.1 * g
                state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
                value += 0.08 * (state[i] / (1 - 0.9**k)) / (np.sqrt(state[i + 1] / (1 - 0.99**k)) + 1e-8)
    x = model.raw(bins, size, counts)
    a, b, y = 1.0, 0.0, good.astype(float)
    for _ in range(25 if len(y) else 0):  # Newton with a weak pull to (1, 0)
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - q) * x).sum() - (a - 1), (y - q).sum() - b * 0.01])
        w = q * (1 - q)
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    model.slope, model.shift = float(a), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> LineField:
    """Learns from about `sample` labelled documents chosen by a hash of doc_id, or all of them where fewer.

    What is broadcast is the sample's ids and labels, what reaches the driver its lines' bins: both bounded by it.
    Without labels of both kinds the model knows nothing and gives every text the labels' mean (0.5 without any).
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    part = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(total, 1))) + 1)
    bound_batches(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, size, counts = line_bins(batch.column(0).to_pylist())
            at = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([bins[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                    pa.array([size[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                ],
                ["quality", "bins", "size"],
            )

    rows = docs.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("text", F.col("quality").cast("int").alias("quality"))
    got = rows.mapInArrow(look, "quality int, bins binary, size binary").toArrow()
    raw, sizes = (b"".join(got.column(i).to_pylist()) for i in (1, 2))
    bins = np.frombuffer(raw, np.int16).reshape(-1, FEATURES)
    counts = np.array([len(s) // 8 for s in got.column(2).to_pylist()], np.int64)
    return train(bins, np.frombuffer(sizes), counts, np.array(got.column(0).to_pylist(), np.int64) == 1)


def judge(spark: SparkSession, docs: DataFrame, model: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted. Null, empty and blank texts have the score of no evidence.

    Null and repeated doc_ids are rows like any others; equal texts score alike; an empty table gives no rows.
    """
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def line_marginals(spark: SparkSession, docs: DataFrame, model: LineField) -> DataFrame:
    """doc_id, line (of those that aren't blank), n_bytes, p_good. Null, empty and blank texts have no lines, so no rows."""
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, size, counts = line_bins(batch.column(1).to_pylist())
            p = model.marginals(model.odds(bins, *_around(bins, counts)), counts) if len(bins) else np.zeros(0)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            line = np.concatenate([np.arange(c) for c in counts] or [np.zeros(0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(line), pa.array(size.astype(np.int64)), pa.array(p)], ["doc_id", "line", "n_bytes", "p_good"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, line int, n_bytes long, p_good double")


def keep_good(spark: SparkSession, docs: DataFrame, model: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns as they are, without the rows whose text scores below the threshold. Nothing is shuffled."""
    bound_batches(spark)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(spark, docs, labels.filter(~held_out(F.col("doc_id"))))
    return judge(spark, docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
