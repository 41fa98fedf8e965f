"""Quality rules: a decision list of threshold conjunctions, learned from labels.

Statistics of every text are taken in Arrow batches; the rules are grown and
pruned on the driver from a bounded sample of labelled rows and come back as one
ordered ``CASE WHEN`` expression, so the verdict itself is a plain Spark column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import SPACES, coded, distinct, is_space, mixed, per_text, pieces, raw, texts_of, words_of

#: The characters counted as symbols, and the window of repeated words.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Most labelled rows that the rules are learned from.
SAMPLE_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_exclaim", "n_digits", "n_letters", "n_distinct_words", "n_stops")
_COUNTED = tuple(COUNTS + EXTRA)


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL, _UPPER, _DIGIT, _STOP = _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".?")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0xC3)


def repeated_words(ids: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text, how many words lie in a window of ``width`` words that the text has twice or more.

    Windows are compared through a 64-bit number of (text, words); neighbours that
    share a number are then compared word by word, and a clash (practically never)
    sends the batch through a full lexicographic sort instead.
    """
    n = len(ids)
    if n < width:
        return np.zeros(len(starts) - 1, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    if len(inside) == 0:
        return np.zeros(len(starts) - 1, np.int64)
    key = mixed(text[inside] + 1)
    for k in range(width):
        key = mixed(key ^ (ids[inside + k].astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = inside[order[1:][same]], inside[order[:-1][same]]
    real = text[a] == text[b]
    for k in range(width):
        real &= ids[a + k] == ids[b + k]
    if not real.all():
        order = np.lexsort([*(ids[inside + k] for k in range(width)), text[inside]])
        at = inside[order]
        same = text[at[1:]] == text[at[:-1]]
        for k in range(width):
            same &= ids[at[1:] + k] == ids[at[:-1] + k]
        a, b = at[1:][same], at[:-1][same]
    twice = distinct(np.concatenate([a, b]))
    cover = np.zeros(n + width + 1, np.int32)
    cover[twice] += 1
    cover[twice + width] -= 1
    return per_text(np.cumsum(cover)[:n] > 0, starts)


def _duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def statistics_of(values: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` and ``EXTRA`` for each text."""
    data, at = raw(values)
    space = is_space(data)
    words, starts = words_of(values)
    ids, known = coded(words)
    text = np.repeat(np.arange(len(values)), np.diff(starts))
    pairs = distinct(text * max(1, len(known)) + ids)
    lines = np.array([_duplicate_lines(x) for x in values.to_pylist()], np.int64).reshape(-1, 2)
    return {
        "n_words": np.diff(starts),
        "word_chars": per_text(~space & ((data & 0xC0) != 0x80), at),
        "n_symbols": per_text(_SYMBOL[data], at),
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeated_words(ids, starts),
        "n_lines": lines[:, 1],
        "n_upper": per_text(_UPPER[data], at),
        "n_exclaim": per_text(data == ord("!"), at),
        "n_digits": per_text(_DIGIT[data], at),
        "n_letters": per_text(_LETTER[data], at),
        "n_distinct_words": np.bincount(pairs // max(1, len(known)), minlength=len(values)),
        "n_stops": per_text(_STOP[data], at),
    }


def text_statistics(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep`` and the counts, all whole numbers.

    A null text counts as empty. Every row gives a row, repeated ids included.
    Columns of ``documents`` that are neither kept nor the text play no part.
    """
    kept = documents.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} long" for c in _COUNTED])
    names = [f.name for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            found = statistics_of(texts_of(batch, "__text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(found[c].astype(np.int64)) for c in _COUNTED],
                names=[*names, *_COUNTED],
            )

    return kept.mapInArrow(count, schema)


#: What a rule may look at: name and the ratio of two counts (None: the count itself).
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "chars_a_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_lines_a_line": ("n_dup_lines", "n_lines"),
    "repeats_a_word": ("n_repeat_words", "n_words"),
    "upper_a_letter": ("n_upper", "n_letters"),
    "exclaim_a_word": ("n_exclaim", "n_words"),
    "digits_a_char": ("n_digits", "word_chars"),
    "letters_a_char": ("n_letters", "word_chars"),
    "distinct_a_word": ("n_distinct_words", "n_words"),
    "stops_a_word": ("n_stops", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    top = F.col(over).cast("double")
    return top if under is None else top / F.greatest(F.col(under), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Texts that meet all conditions are rejected, or kept whatever later rules say."""

    conditions: tuple[Condition, ...]
    rejects: bool = True

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for c in self.conditions:
            out &= c.holds(table)
        return out

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _information(p: float, n: float) -> float:
    return np.log2(p / (p + n))


def _grow(table: dict[str, np.ndarray], wanted: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> tuple[Condition, ...]:
    """Add the condition of greatest information gain until only ``wanted`` texts are covered."""
    covered, chosen = np.ones(len(wanted), bool), []
    while len(chosen) < most and (covered & ~wanted).any() and (covered & wanted).any():
        p0, n0 = float((covered & wanted).sum()), float((covered & ~wanted).sum())
        best = (1e-9, None)
        for name, thresholds in cuts.items():
            values, y = table[name][covered], wanted[covered]
            order = np.argsort(values, kind="stable")
            below = np.concatenate([[0], np.cumsum(y[order])])
            at = np.searchsorted(values[order], thresholds, side="right")
            for above in (False, True):
                p = p0 - below[at] if above else below[at]
                n = (len(y) - at if above else at) - p
                ok = p > 0
                gain = np.where(ok, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - _information(p0, n0)), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, above, float(thresholds[k])))
        if best[1] is None:
            break
        chosen.append(best[1])
        covered &= best[1].holds(table)
    if not chosen and wanted.all():  # whatever is left
        chosen.append(Condition(next(iter(cuts)), True, float("-inf")))
    return tuple(chosen)


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    """Precision of the rule on these texts, damped."""
    hit = rule.holds(table)
    return (float((hit & (bad == rule.rejects)).sum()) + 1) / (float(hit.sum()) + 2)


def learn(
    table: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4
) -> list[Rule]:
    """Sequential covering: grow rules on two rows of three, prune them on the third, take away what the better one covers.

    ``table`` has one array per feature and ``bad`` marks texts to reject. Each turn
    grows a rule that rejects; where that does not reach ``least_precision`` on the
    pruning rows, one that keeps, so that later rules see the rest alone. When neither
    does the list ends; keeping rules at its end say nothing and go. No labelled rows,
    or labels of one kind only, give no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    fold = np.arange(len(bad)) % 3 == 2
    cuts = {}
    for name, values in table.items():
        distinct = np.unique(values)
        middle = (distinct[1:] + distinct[:-1]) / 2
        cuts[name] = middle if len(middle) <= 256 else np.unique(np.quantile(middle, np.linspace(0, 1, 256)))
        if not len(middle):
            cuts[name] = distinct[:1]
    while len(rules) < most_rules and (bad & left).any():
        grown = {k: v[left & ~fold] for k, v in table.items()}
        pruned = {k: v[left & fold] for k, v in table.items()}
        if not bad[left & ~fold].any() or bad.all():
            break
        rule = None
        for rejects in (True, False):
            whole = _grow(grown, bad[left & ~fold] == rejects, cuts, most_conditions)
            options = [Rule(whole[:k], rejects) for k in range(1, len(whole) + 1)]
            best = max(options, key=lambda r: (_worth(r, pruned, bad[left & fold]), -len(r.conditions)), default=None)
            if best is not None and _worth(best, pruned, bad[left & fold]) >= least_precision:
                rule = best
                break
        if rule is None:
            break
        rules.append(rule)
        left &= ~rule.holds(table)
    while rules and not rules[-1].rejects:
        rules.pop()
    return rules


def rule_expression(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1, or 0: an ordered conditional."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def learn_from(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents, chosen by a hash of their id.

    The sample alone reaches the driver (``rows`` lines of counts). Null ids or
    labels are passed over; of repeated ids the least counts are taken.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counted = text_statistics(chosen, keep=("doc_id", "quality"))
    counted = counted.groupBy("doc_id", "quality").agg(F.min(F.struct(*_COUNTED)).alias("s")).select("doc_id", "quality", "s.*")
    found = (
        counted.where(~base_failed())
        .select("doc_id", F.xxhash64("doc_id").alias("__at"), "quality", *(feature(n).alias(n) for n in FEATURES))
        .toPandas()
    )
    order = found.sort_values(["__at", "doc_id"]).index.to_numpy()
    table = {n: found[n].to_numpy(np.float64)[order] for n in FEATURES}
    return learn(table, found.quality.to_numpy()[order] == 0) if len(found) else []


def judge(documents: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics of every document with ``base_failed``, ``rule`` (the first that it meets, 0: none) and ``kept``.

    Empty and null texts have no words and fail the base rules.
    """
    out = text_statistics(documents, keep=keep).withColumn("base_failed", base_failed())
    out = out.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(rule_expression(rules)))
    keeping = [k for k, rule in enumerate(rules, 1) if not rule.rejects]
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isin(0, *keeping))
