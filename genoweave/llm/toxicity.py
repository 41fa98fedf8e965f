"""Toxicity: maximum-scoring segments over token log-odds.

Training takes word counts of toxic and other texts on Spark and turns them into
log-odds with an informative Dirichlet prior. A linear scan over a text finds
every maximal segment of positive total; a segment's total is set against the
Gumbel law of totals in harmless texts of that length, and the significant ones
add up to the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import WORD_CLASS, coded, pieces, texts_of, words_of
from genoweave.plans.durable import write_table

#: Most labelled rows to learn from.
SAMPLE_ROWS = 20_000
#: Words of the prior, as pseudo-counts; how many standard errors a log-odds must clear; the least pseudo-count of a word.
PRIOR_WORDS = 200.0
ERRORS = 1.96
LEAST_PRIOR = 0.5
#: Signs that do not belong to a word at its ends.
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"


def normal_words(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words without the signs at their ends, as distinct words and numbers would see them."""
    words, starts = words_of(pc.utf8_lower(values))
    return pc.utf8_trim(words, EDGES), starts


@dataclass(frozen=True)
class ToxicModel:
    """Word scores, the score of any other word, and the calibration."""

    scores: dict[str, float]
    other: float
    decay: float
    scale: float
    slope: float
    offset: float


def segments(positions: np.ndarray, gains: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first, last, total), in linear time.

    ``positions`` and ``gains`` list the words whose score isn't ``other``, which
    is negative; words between them count ``other`` each. Candidates are kept with
    the running total before and after them, and a link to the nearest one before
    them that starts lower: a new candidate follows links from the last one, and joins
    back to where they lead unless that one ends at least as high.
    """
    firsts: list[int] = []
    lasts: list[int] = []
    lows: list[float] = []
    highs: list[float] = []
    links: list[int] = []
    total, seen = 0.0, -1
    for at, gain in zip(positions.tolist(), gains.tolist(), strict=True):
        total += (at - seen - 1) * other
        seen = at
        if gain <= 0:
            total += gain
            continue
        first, low = at, total
        total += gain
        j = len(lows) - 1
        while j >= 0:
            if lows[j] >= low:
                j = links[j]
            elif highs[j] >= total:
                break
            else:
                first, low, back = firsts[j], lows[j], links[j]
                del firsts[j:], lasts[j:], lows[j:], highs[j:], links[j:]
                j = back
        firsts.append(first)
        lasts.append(at)
        lows.append(low)
        highs.append(total)
        links.append(j)
    return [(a, b, h - lo) for a, b, lo, h in zip(firsts, lasts, lows, highs, strict=True)]


def passages(values: pa.Array, model: ToxicModel) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """For each text its number of words and its maximal segments."""
    words, starts = normal_words(values)
    ids, known = coded(words)
    own = np.array([model.scores.get(w, model.other) for w in known.to_pylist()] or [model.other])
    scored = own[ids] if len(ids) else np.zeros(0)
    # a word right after itself says nothing new
    again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    scored[again[~np.isin(again, starts)]] = model.other
    special = np.flatnonzero(scored != model.other)
    cut = np.searchsorted(special, starts)
    return [
        (int(starts[k + 1] - starts[k]), segments(special[a:b] - starts[k], scored[special[a:b]], model.other) if b > a else [])
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))
    ]


def evidence(n_words: int, found: list[tuple[int, int, float]], decay: float, scale: float) -> float:
    """Sum of -ln of the expected number of such segments in a harmless text, over the significant ones."""
    reach = math.log(max(scale * max(n_words, 1), 1e-9))
    significant = sum(max(0.0, decay * s - reach) for _, _, s in found)
    best = max((decay * s - reach for _, _, s in found), default=-reach - 2.0)
    return significant if significant > 0 else min(best, 0.0)


def _significant(counts: DataFrame) -> tuple[pd.DataFrame, float]:
    """Words whose log-odds between toxic and other texts clear their error, with that ``surplus``; and how many words the other texts hold.

    Worked out on Spark over every counted word; the driver sees those that clear.
    """
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.count("*").alias("kinds")).first()
    toxic, other = total.toxic or 0, total.other or 0
    prior = F.lit(PRIOR_WORDS) * (F.col("toxic") + F.col("other")) / max(1, toxic + other) + LEAST_PRIOR
    spread = (PRIOR_WORDS if toxic + other else 0.0) + LEAST_PRIOR * total.kinds
    a, b = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(a / (F.lit(toxic + spread) - a)) - F.log(b / (F.lit(other + spread) - b))
    surplus = odds - ERRORS * F.sqrt(1 / a + 1 / b)
    return counts.select("word", "other", surplus.alias("surplus")).where("surplus > 0").toPandas().sort_values("word"), max(1.0, float(other))


def _decay(odds_scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(decay * score)) = 1."""
    low, high = 1e-6, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * odds_scores, 700))).sum()) - 1
    if not (odds_scores > 0).any():
        return 1.0
    while value(high) < 0 and high < 1e4:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, slightly damped, by Newton steps."""
    w = np.array([0.1, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + 1e-2 * w
        bend = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Learn from at most ``rows`` labelled documents, chosen by a hash of their id.

    Rows with a null id or label are passed over. Counting runs on Spark over the
    whole texts of the sample; the driver sees the words whose log-odds clear their
    error, among all that occur in two or more of its documents, and three numbers per document.
    """
    sample = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    chosen = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, starts = normal_words(texts_of(batch, "text"))
            ids, known = coded(words)
            label = np.repeat(np.asarray(batch.column("toxic")).astype(np.int64), np.diff(starts))
            text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            _, first = np.unique(text * max(1, len(known)) + ids, return_index=True)
            toxic = np.bincount(ids[first], weights=label[first] == 1, minlength=len(known))
            other = np.bincount(ids[first], weights=label[first] != 1, minlength=len(known))
            yield pa.RecordBatch.from_arrays([known, pa.array(toxic.astype(np.int64)), pa.array(other.astype(np.int64))], names=["word", "toxic", "other"])

    counts = (
        chosen.mapInArrow(distinct_words, "word string, toxic long, other long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )
    sure, harmless = _significant(write_table(counts.where("toxic + other >= 2 and word <> ''"), "word-counts"))
    scores = dict(zip(sure.word, sure.surplus, strict=True))
    other = -max(0.05, 4.0 * float((sure.surplus * sure.other).sum()) / harmless)
    values = np.array([*scores.values(), other])
    shares = np.array([*(sure.other / harmless), max(1e-9, 1 - sure.other.sum() / harmless)])
    model = ToxicModel(scores, other, _decay(values, shares), 1.0, 1.0, 0.0)

    def best_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = passages(texts_of(batch, "text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(batch.column("toxic"), pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in f] for _, f in found], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "n", "totals"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    told = chosen.mapInArrow(best_segments, f"doc_id {kind}, toxic long, n long, totals array<double>")
    told = write_table(told.groupBy("doc_id", "toxic").agg(F.min(F.struct("n", "totals")).alias("s")).select("doc_id", "toxic", F.greatest("s.n", F.lit(1)).alias("n"), "s.totals"), "segment-totals")
    tops = told.select("toxic", "n", F.coalesce(F.array_max("totals"), F.lit(0.0)).alias("top")).toPandas()
    clean = tops[tops.toxic != 1]
    if not len(clean) or len(clean) == len(tops):
        return model
    # The mean of the largest total over harmless texts gives the scale of the Gumbel law.
    heavy = np.sort(np.clip(model.decay * clean.top.to_numpy(), 0, 50) - np.log(clean.n.to_numpy(np.float64)))
    scale = float(np.clip(np.exp(np.mean(heavy) - 0.5772), 1e-7, 1.0))
    reach = F.log(F.greatest(F.lit(scale) * F.col("n"), F.lit(1e-9)))
    beyond = F.transform("totals", lambda s: model.decay * s - reach)
    summed = F.aggregate(beyond, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    best = F.least(F.coalesce(F.array_max(beyond), -reach - 2.0), F.lit(0.0))
    x = told.select("toxic", F.when(summed > 0, summed).otherwise(best).alias("x")).toPandas().sort_values(["x", "toxic"])
    slope, offset = _logistic(np.minimum(x.x.to_numpy(), 40), (x.toxic == 1).to_numpy(float))
    return ToxicModel(scores, other, model.decay, scale, slope, offset)


def probability(x: float, model: ToxicModel) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * min(x, 40.0) + model.offset))))


def score(documents: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, score, predicted, n_passages and the best passage's word span.

    A null text counts as empty; a text without a segment scores by its lack of
    evidence alone. Repeated ids give a row each; a null id stays null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches, "text"):
            found = passages(texts_of(batch, "text"), known)
            scores = [probability(evidence(n, f, known.decay, known.scale), known) for n, f in found]
            best = [max(f, key=lambda s: s[2], default=(None, None, 0.0)) for _, f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array([len(f) for _, f in found], pa.int32()),
                    pa.array([b[0] for b in best], pa.int32()),
                    pa.array([b[1] for b in best], pa.int32()),
                ],
                names=["doc_id", "score", "predicted", "n_passages", "first_word", "last_word"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_passages int, first_word int, last_word int")


def held_out(column: str = "doc_id", modulus: int = 3, remainder: int = 1):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


__all__ = ["ToxicModel", "WORD_CLASS", "evidence", "held_out", "passages", "score", "segments", "train"]
