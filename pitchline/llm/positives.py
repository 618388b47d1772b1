"""A quality classifier from trusted positives and unlabelled text.

Nobody labels bad text here: the trusted positives and the unlabelled rows are
enough.  The share of good text among the unlabelled, the class prior, is
estimated at the best bin of a first model's ranking; then the model minimises
the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss l, so that its output is a probability.  Where the
estimated risk of the negatives falls below zero, the step goes the other way,
which keeps the model from explaining unlabelled rows one by one.

A text is read as bytes, whole: its hashed words, the triples of its character
classes, and bins of its length, word length and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import unused
from pitchline.session import bounded_batches, cut

# The classes of ASCII characters; class 0 ends a text, other bytes have the last class.
CLASSES = (" ", "\n\r\t\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|/\\_~^", "#*$%&<>@+=", "'\"()[]{}-`")
_CLASS = np.full(256, len(CLASSES) + 1, np.int64)
for _k, _chars in enumerate(CLASSES):
    _CLASS[list(_chars.encode())] = _k + 1
_KINDS = len(CLASSES) + 2
WORD_BITS, BINS = 14, 8
_TRIPLES, _SHAPES = 1 << WORD_BITS, (1 << WORD_BITS) + _KINDS**3
#: Bins of length (twice as many), word length, words equal to the one before, and distinct words by length.
DIMS = _SHAPES + 2 * BINS + BINS + BINS + BINS * 2 * BINS
_POWERS = np.array([pow(6364136223846793005, k + 1, 1 << 64) for k in range(256)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)

#: Bounds of the rows that the model is fitted on.
MOST_POSITIVES, MOST_UNLABELLED = 6144, 12288
_ROW = "_id long, _positive boolean, _at array<int>, _x array<float>"


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, places and values of the sparse features of texts; a null text counts as empty."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    row = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    n = len(data)
    # triples of classes around each byte, 0 beyond the text
    kind = _CLASS[data]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[(ends - sizes)[sizes > 0]] = 0
    after[ends[sizes > 0] - 1] = 0
    triples = (before * _KINDS + kind) * _KINDS + after
    # words: runs of bytes that are no white space, inside a text
    black = kind > 2
    begins = black & (before <= 2)
    word_row = row[begins]
    word = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    black_at = np.flatnonzero(black)
    inside = black_at - starts[word[black_at]]
    told = (_LOWER[data[black_at]] + np.uint64(1)) * _POWERS[inside & 255]
    length = np.bincount(word[black_at], minlength=len(starts))
    hashes = np.add.reduceat(told, np.cumsum(length) - length) if len(starts) else np.zeros(0, np.uint64)
    hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    words = np.bincount(word_row, minlength=len(texts))

    def share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.sqrt(part / np.maximum(of, 1))

    span = np.int64(DIMS)
    w, w_count = np.unique(word_row * span + bucket, return_counts=True)
    t, t_count = np.unique(row * span + _TRIPLES + triples, return_counts=True)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    repeated = np.bincount(word_row[again], minlength=len(texts)) / np.maximum(words, 1)
    distinct = np.bincount(w // span, minlength=len(texts)) / np.maximum(words, 1)
    mean = np.bincount(word_row, weights=length, minlength=len(texts)) / np.maximum(words, 1)
    bins = lambda x, most: np.minimum(x, most - 1).astype(np.int64)
    size_bin = bins(np.log2(words + 1), 2 * BINS)
    at = _SHAPES + np.stack((
        size_bin,
        2 * BINS + bins(mean / 2, BINS),
        3 * BINS + bins(np.ceil(repeated * 2 * (BINS - 1)), BINS),
        4 * BINS + bins(size_bin, 2 * BINS) * BINS + bins(distinct * BINS, BINS),
    ))
    shapes = (np.arange(len(texts)) * span + at).ravel()
    place = np.concatenate((w, t, shapes))
    value = np.concatenate((share(w_count, words[w // span]), share(t_count, sizes[t // span]), np.full(len(shapes), 0.5)))
    order = np.argsort(place, kind="stable")
    place, value = place[order], value[order]
    return np.searchsorted(place, np.arange(len(texts) + 1) * span), (place % span).astype(np.int32), value.astype(np.float32)


def dot(bounds: np.ndarray, at: np.ndarray, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of each row; the last weight is the constant."""
    upto = np.concatenate(([0.0], np.cumsum(x * weights[at], dtype=np.float64)))
    return upto[bounds[1:]] - upto[bounds[:-1]] + weights[-1]


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


@dataclass(frozen=True)
class Rows:
    bounds: np.ndarray
    at: np.ndarray
    x: np.ndarray

    def take(self, chosen: np.ndarray) -> Rows:
        length = np.diff(self.bounds)[chosen]
        upto = np.cumsum(length)
        places = np.repeat(self.bounds[chosen] - (upto - length), length) + np.arange(int(upto[-1]) if len(upto) else 0)
        return Rows(np.concatenate(([0], upto)), self.at[places], self.x[places])

    def score(self, weights: np.ndarray) -> np.ndarray:
        return dot(self.bounds, self.at, self.x, weights)

    def back(self, g: np.ndarray) -> np.ndarray:
        """The gradient in the weights of a sum whose gradient in each row's score is ``g``."""
        out = np.bincount(self.at, weights=self.x * np.repeat(g, np.diff(self.bounds)), minlength=DIMS + 1)
        out[-1] = g.sum()
        return out


def fit_risk(good: Rows, any_: Rows, prior: float, steps: int = 200, rate: float = 1.0, momentum: float = 0.9, decay: float = 1e-5) -> np.ndarray:
    """Weights that minimise the non-negative risk, in steps over all rows, from zero.

    Plain steps move features by how many rows have them, so what is common
    to bad texts is learnt long before single words are.
    """
    n_good, n_any = len(good.bounds) - 1, len(any_.bounds) - 1
    w, moved = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for _ in range(steps):
        f_good, f_any = good.score(w), any_.score(w)
        p_good, p_any = sigmoid(f_good) / n_good, sigmoid(f_any) / n_any
        # l(f) = ln(1 + e^-f): its slope is sigmoid(f) - 1, that of l(-f) is sigmoid(f)
        below = np.logaddexp(0, f_any).mean() - prior * np.logaddexp(0, f_good).mean()
        if below >= 0:
            step = good.back(prior * (p_good - 1 / n_good) - prior * p_good) + any_.back(p_any)
        else:
            step = good.back(prior * p_good) + any_.back(-p_any)
        moved = momentum * moved + step + decay * w
        w = w - rate * moved
    return w


def best_bin_prior(good: np.ndarray, any_: np.ndarray, slack: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the scores of both.

    Above any bound lie at least ``prior`` times the positives' share of the
    unlabelled; the bound where the ratio, with a margin for the sample, is
    least gives the estimate, and what is left without the margin is returned.
    Too large a prior takes bad text out of the risk, while too small a one
    lowers the score of good text by no more than its own share.
    """
    marks = np.sort(good)
    above_good = 1 - np.arange(len(marks)) / len(marks)
    above_any = 1 - np.searchsorted(np.sort(any_), marks, "left") / len(any_)
    margin = (1 + slack) * (np.sqrt(np.log(40) / 2 / len(good)) + np.sqrt(np.log(40) / 2 / len(any_)))
    k = int(np.argmin((above_any + margin) / above_good))
    return float(np.clip((above_any[k] - margin) / above_good[k], 0.01, 0.99))


def fit_rows(good: Rows, any_: Rows) -> tuple[np.ndarray, float]:
    """Weights and class prior.  Without two positives and two unlabelled rows every score is one half.

    The prior is estimated by models of one half of the rows on the other half:
    the first takes one half for the prior, the second what the first found.
    """
    n_good, n_any = len(good.bounds) - 1, len(any_.bounds) - 1
    if n_good < 2 or n_any < 2:
        return np.zeros(DIMS + 1), 0.5
    prior = 0.5
    g, a = ([rows.take(np.arange(k, n, 2)) for k in (0, 1)] for rows, n in ((good, n_good), (any_, n_any)))
    for _ in range(2):
        models = [fit_risk(g[k], a[k], prior, steps=60) for k in (0, 1)]
        prior = min(best_bin_prior(g[1 - k].score(w), a[1 - k].score(w)) for k, w in enumerate(models))
    return fit_risk(good, any_, prior), prior


def _fit(rows: pa.Table) -> pa.Table:
    """The one row of the model, from a bounded sample, in an order that does not depend on how it came."""
    rows = rows.sort_by("_id")
    positive = np.array(rows["_positive"].to_pylist(), bool)
    at, x = (rows[c].combine_chunks() for c in ("_at", "_x"))
    every = Rows(at.offsets.to_numpy().astype(np.int64) - at.offsets[0].as_py(), at.flatten().to_numpy(), x.flatten().to_numpy())
    weights, prior = fit_rows(every.take(np.flatnonzero(positive)), every.take(np.flatnonzero(~positive)))
    return pa.table({"weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "prior": [prior]})


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bounds, at, x = features(b["_text"].to_pylist())
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (at, x)]
        yield pa.RecordBatch.from_arrays([b["_id"], b["_positive"], *lists], ["_id", "_positive", "_at", "_x"])


@dataclass(frozen=True)
class Model:
    """``weights`` of the features, the constant last, and the estimated class ``prior``."""

    weights: np.ndarray
    prior: float


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = MOST_POSITIVES, unlabelled: int = MOST_UNLABELLED) -> Model:
    """A model from the unlabelled ``docs`` and the ids in ``trusted``, whose documents are known to be good.

    Both are bounded samples drawn by a hash of the id: ``positives`` trusted
    and ``unlabelled`` other rows, read whole.  All rows count as unlabelled,
    trusted ones too, since the prior is theirs as well.  Rows without an id
    and trusted ids without a document are left out; repeated ids are drawn as
    one.  The sample meets in one task, and the weights, as many as there are
    features, come to the driver.
    """
    bounded_batches(docs.sparkSession)
    drawn = lambda ids, salt, most: ids.orderBy(F.xxhash64(F.lit(salt), "_id"), "_id").limit(most)
    ids = docs.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    known = trusted.select(F.col(id_col).cast("long").alias("_id")).distinct().join(ids, "_id", "semi")
    sample = cut(drawn(known, 1, positives).withColumn("_positive", F.lit(True)).unionByName(drawn(ids, 2, unlabelled).withColumn("_positive", F.lit(False))))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    # as many ids as the sample has rows, which is bounded
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_positive", "_text")
    rows = rows.mapInArrow(_featured, _ROW).dropDuplicates(["_id", "_positive"])
    got = rows.groupBy().applyInArrow(_fit, "weights array<double>, prior double").first()
    return Model(np.array(got["weights"]), got["prior"]) if got else Model(np.zeros(DIMS + 1), 0.5)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without ``text_col`` and with ``name``: the probability, 0 to 1, that a text is good.

    Each row is scored by its whole text alone; null and empty texts have a
    score too.  A column called ``name`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col and c.lower() != name.lower()]
    text, value = unused(docs, "_text", "_value")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("binary").alias(text))
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = sigmoid(dot(*features(b[text].to_pylist()), weights))
            others = [c for c in b.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in others), pa.array(told)], [*others, value])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text]
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{value}` double"])).withColumnRenamed(value, name)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels no model may learn: one in five by the check sum of the id; null ids are not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
