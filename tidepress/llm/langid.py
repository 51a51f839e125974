"""Language mixtures: expectation-maximisation over n-gram likelihoods, with a penalised choice of the language set."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents

BUCKETS = 1 << 15
SEGMENT = 64
SAMPLE_ROWS = 8000
UNKNOWN = "und"
#: A text is of no learned language when a trigram's log likelihood is MARGIN under this quantile of the training texts.
OUTLIERS, MARGIN = 0.001, 1.0
_LETTER = regex.compile(r"\p{L}").search


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucketed byte trigrams of the lower-cased texts, each padded to whole segments, and segments of each text.

    BUCKETS stands for padding. Null and empty texts have one segment of padding and blanks.
    """
    parts, counts = [], []
    for t in texts:
        raw = b" " + (t or "").lower().encode("utf-8", "surrogatepass").replace(b"\n", b" ").replace(b"\0", b" ") + b" "
        n = -(-(len(raw) + 2) // SEGMENT)
        parts.append(raw + b"\0" * (n * SEGMENT - len(raw)))
        counts.append(n)
    b = np.frombuffer(b"".join(parts) + b"\0\0", np.uint8)
    c = b.astype(np.uint32)
    key = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    ids = ((key * np.uint32(2654435769)) >> np.uint32(17)).astype(np.int32)
    ids[(b[2:] == 0) | (b[:-2] == 0)] = BUCKETS
    return ids, np.array(counts)


@dataclass
class LanguageModel:
    """Log likelihoods of buckets by language. Without languages every text is unknown."""

    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages); the last row, of padding, is 0
    temper: float = 0.3  # overlapping trigrams count their evidence about three times
    penalty: float = 1.0
    most: int = 4
    rounds: int = 12
    chunk: int = field(default=SEGMENT * 4096, repr=False)

    def segments(self, ids: np.ndarray) -> np.ndarray:
        parts = [self.table[ids[i : i + self.chunk]].reshape(-1, SEGMENT, len(self.languages)).sum(axis=1) for i in range(0, len(ids), self.chunk)]
        return np.concatenate(parts).astype(np.float64) * self.temper

    def _em(self, lik: np.ndarray, top: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(self.rounds):
            r = share[doc] * lik
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            share = np.add.reduceat(r, start, axis=0) / count[:, None]
        fit = np.log(np.maximum((share[doc] * lik).sum(axis=1), 1e-300)) + top
        return share, np.add.reduceat(fit, start)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of each language (0 outside the chosen set) and size of the set, by text.

        Sets are the k languages of the largest shares when all are allowed; the chosen k maximises the fitted log
        likelihood less penalty x (k - 1) x log(segments + 1).
        """
        return self.infer(texts)[:2]

    def infer(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As predict, with the chosen mixture's log likelihood a trigram and the number of trigrams, by text."""
        n, m = len(texts), len(self.languages)
        if not n or not m:
            return np.zeros((n, m)), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        ids, count = grams(texts)
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        doc = np.repeat(np.arange(n), count)
        ll = self.segments(ids)
        top = ll.max(axis=1)
        lik = np.exp(np.maximum(ll - top[:, None], -600))
        whole, _ = self._em(lik, top, doc, start, count, np.ones((n, m)))
        place = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1)
        best, best_score, size, best_fit = np.zeros((n, m)), np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n)
        single = np.add.reduceat(ll, start, axis=0)
        for k in range(1, min(m, self.most) + 1):
            if k == 1:
                share = (np.arange(m) == single.argmax(axis=1)[:, None]).astype(float)
                fit = single.max(axis=1)
            else:
                share, fit = self._em(lik, top, doc, start, count, (place < k).astype(float))
            score = fit - self.penalty * (k - 1) * np.log(count + 1)
            better = score > best_score + 1e-9
            best[better], best_score[better], size[better], best_fit[better] = share[better], score[better], k, fit[better]
        known = np.add.reduceat((ids != BUCKETS).reshape(-1, SEGMENT).sum(axis=1), start)
        return best, size, best_fit / self.temper / np.maximum(known, 1), known


def in_training(doc_id: Column) -> Column:
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, rows: DataFrame, sample: int = SAMPLE_ROWS) -> LanguageModel:
    """Learns from columns text and lang of about `sample` rows, chosen by a hash of doc_id (all rows, where fewer).

    Buckets are counted on the executors; what reaches the driver is at most BUCKETS counts a language.
    """
    known = rows.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    total = known.select("lang").count()
    part = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(total, 1))) + 1)
    bound_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                ids, _ = grams([texts[i] for i in np.flatnonzero(langs == lang)])
                seen[lang] = seen.get(lang, 0) + np.bincount(ids, minlength=BUCKETS + 1)[:BUCKETS]
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    counts = part.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (counts.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    languages = sorted(set(lang.tolist()))
    share = np.zeros((BUCKETS + 1, len(languages)))
    for i, name in enumerate(languages):
        own = lang == name
        share[bucket[own], i] = n[own] / n[own].sum()
    smooth = 0.95 * share + 0.05 * (share.mean(axis=1, keepdims=True) if languages else 0) + 1e-7
    table = np.log(smooth)
    table[BUCKETS] = 0
    return LanguageModel(languages, table.astype(np.float32))


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (its share), mixture (lang:share of the chosen set, largest first).

    Null texts and texts without a letter are `und` with score 0, and so is every text where no language was learned.
    Null and repeated doc_ids are rows like any others; an empty table gives no rows. Other columns play no part.
    """
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            share, size = model.predict(texts)
            order = np.argsort(-share, axis=1, kind="stable")
            pred, score, mix = [], [], []
            for i, t in enumerate(texts):
                if not size[i] or not t or not _LETTER(t):
                    pred.append(UNKNOWN), score.append(0.0), mix.append("")
                    continue
                pred.append(model.languages[order[i, 0]])
                score.append(min(1.0, float(share[i, order[i, 0]])))
                mix.append(",".join(f"{model.languages[j]}:{share[i, j]:.3f}" for j in order[i, : size[i]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], ["doc_id", "lang_pred", "score", "mixture"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def length_class(count: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(count, 1)).astype(np.int32)


def floors(spark: SparkSession, rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """Least log likelihood a trigram of a text in a learned language, by length class (trigrams doubling).

    It is MARGIN under the OUTLIERS quantile of all rows with text and lang, so short texts full of digits stay too. A
    class never asks more than a longer one; beyond the longest class, its floor holds.
    """
    known = rows.filter("lang is not null and text is not null").select("text")
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, fit, count = model.infer(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(length_class(count)), pa.array(fit)], ["c", "fit"])

    low = known.mapInArrow(run, "c int, fit double").groupBy("c").agg(F.percentile_approx("fit", OUTLIERS, 100_000).alias("f"))
    out = np.full(64, np.inf)
    for c, f in low.collect():
        out[c] = f - MARGIN
    last = np.flatnonzero(np.isfinite(out))
    if len(last):
        out[last[-1] :] = out[last[-1]]
    return np.minimum.accumulate(out[::-1])[::-1]


def keep_known(spark: SparkSession, docs: DataFrame, model: LanguageModel, floor: np.ndarray, languages: list[str] | None = None, share: float = 0.5) -> DataFrame:
    """docs, all columns as they are, without the rows whose language is unknown: those without a letter, and those that
    the best mixture of learned languages explains worse than `floor` asks at their length.

    With `languages`, the mixture's share of these must be at least `share` too. Null and empty texts go, repeated rows
    fare alike, an empty table stays empty; a model without languages keeps nothing. Nothing is shuffled.
    """
    bound_batches(spark)
    at = docs.columns.index("text")
    wanted = np.array([languages is None or x in languages for x in model.languages], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            mix, size, fit, count = model.infer(texts)
            like = (size > 0) & (fit >= floor[length_class(count)])
            if languages is not None:
                like &= mix[:, wanted].sum(axis=1) >= share
            yield batch.filter(pa.array([bool(k and t and _LETTER(t)) for k, t in zip(like, texts, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(spark, docs.filter(in_training(F.col("doc_id"))))
    return identify(spark, docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
