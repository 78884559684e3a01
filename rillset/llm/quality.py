"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over the statistics: its own covariance, shrunk towards the pooled one and then towards its own
diagonal scale. A score is a logistic function of the difference of the two log densities, each from a Mahalanobis
distance that a Cholesky factor, computed once when fitting, gives by one triangular product. The slope and offset of
the logistic function are fitted on the same bounded rows; fitting sees at most MOST_ROWS labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillset.llm.common import select_text, tidied
from rillset.llm.labels import fitting_rows, remainder
from rillset.llm.textstats import byte_counts, coded_words, distinct_share
from rillset.llm.tokens import chunks

MOST_ROWS = 30_000
FOLDS, HELD_OUT, CUT = 4, 2, 0.7
POOL_SHRINK, DIAGONAL_SHRINK = 0.1, 0.02
STATISTICS = ("bytes", "words", "word_bytes", "upper", "symbol", "digit", "stop", "line", "space", "wide", "distinct_words", "repeats_last", "distinct_pairs")


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, len(STATISTICS)); lengths as logarithms, shares as logarithms of the share plus a half percent."""
    n, c = len(texts), byte_counts(texts)
    document, word, _ = coded_words(texts)
    distinct, words = distinct_share(document, word, n)
    follows = document[1:] == document[:-1]
    again = np.bincount(document[1:][follows & (word[1:] == word[:-1])], minlength=n)
    width = int(word.max()) + 1 if len(word) else 1
    _, pair = np.unique(word[:-1][follows] * width + word[1:][follows], return_inverse=True)
    pairs, all_pairs = distinct_share(document[1:][follows], pair.astype(np.int64), n)
    share = lambda x, of: np.log(x / np.maximum(of, 1) + 0.005)
    letters, size = c["upper"] + c["lower"], c["all"]
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), np.log1p((size - c["space"]) / np.maximum(words, 1)), share(c["upper"], letters), share(c["symbol"], size), share(c["digit"], size), share(c["stop"], size),
            share(c["line"], size), share(c["space"], size), share(c["wide"], size), share(distinct, words), share(again, words), share(pairs, all_pairs),
        ]
    )


class QuadraticDiscriminant:
    """Two shrunken Gaussians with cached Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pool: float = POOL_SHRINK, diagonal: float = DIAGONAL_SHRINK):
        self.center, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z, self.fits = (x - self.center) / self.scale, []
        parts = [z[y == k] for k in (0, 1)]
        pooled = sum((p - p.mean(0)).T @ (p - p.mean(0)) for p in parts) / len(z)
        for p in parts:
            own = np.cov(p.T, bias=True)
            cov = (1 - pool) * own + pool * pooled
            cov = (1 - diagonal) * cov + diagonal * np.eye(len(cov)) * max(np.trace(cov) / len(cov), 1e-3)
            factor = np.linalg.cholesky(cov)
            self.fits.append((p.mean(0), np.linalg.inv(factor).T, -np.log(np.diag(factor)).sum()))
        self.slope, self.offset = _logistic(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = [half_log - 0.5 * (((z - mean) @ factor) ** 2).sum(1) for mean, factor, half_log in self.fits]
        return np.clip((density[1] - density[0]) / z.shape[1], -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def _logistic(d: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | d), by Newton's method with a small ridge; the slope stays positive."""
    w = np.array([1.0, 0.0])
    x = np.column_stack([d, np.ones(len(d))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        w[0] = max(w[0], 1e-3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> QuadraticDiscriminant | None:
    """Fit on at most `most` labelled documents outside the held-out fold; None where a class has fewer than two of them.

    Of rows that repeat an id the one of the smallest statistics counts, so the driver never gets more rows than that.
    """

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # the chosen labels are `most` rows of 12 bytes at most, which bounds the broadcast
    chosen = F.broadcast(fitting_rows(labels, "quality", FOLDS, HELD_OUT, most))
    rows = select_text(docs).join(chosen, "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.y", "r.x").toArrow()
    y = rows.column("y").to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    x = np.array(rows.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of rows
    return QuadraticDiscriminant(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1, higher: better), predicted (1 from CUT on).

    A null text counts as empty and is scored by its statistics, all zero. Without labels of both classes every score is
    0.5. Repeated rows get equal scores, a null id is held out of nothing and fitted on never; an empty table gives no rows. Language, source and ids are no input.
    """
    model = fit_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most)

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            score = model.score(statistics(b.column(1))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    scored = select_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
