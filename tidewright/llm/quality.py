"""Quality rules with risk-controlled cutoffs.

Each document has base counts and SIGNALS between 0 and 1, higher meaning worse. For each stratum (language), labelled
documents of good quality are a holdout, and two ways to cutoffs, each at level delta / (2 * strata), are tried on it:

- Jointly: the region of rejection (of all signals) grows step by step, and every step is certified while an exact binomial
  test rejects "at least alpha of good documents fall to it". The next step may depend on all bad documents and on good ones
  inside the region, never on those outside, so that the region's coverage is distributed as for one fixed sequence
  (Tukey's statistically equivalent blocks), and the whole alpha is for all signals together. Signals take turns, first the
  one whose mean among bad documents not yet rejected is the most deviations above its usual one (of the stratum's documents
  without labels, or else of good ones of other strata); each goes down to the lowest of these bad documents, or until its
  share of the losses still allowed is used. A region inside a certified one is certified.
- Apart: for each signal from the most lenient cutoff downwards, with alpha / signals at a level divided by the signals.
  This needs some eight times the labels, but no signal ends another's sequence.

Documents that fail the base rules count nowhere. With probability 1 - delta, in every stratum fewer than alpha of the good
documents that pass them are rejected. In both ways the certified
cutoffs with the largest gain (bad documents rejected less GOOD_COST times good ones) are taken, the most lenient ones on
ties, none if there is no gain; of the two, the way with the larger gain of its signals together, the joint one on ties.
Below least_labels() good labels a stratum has no cutoff. Counts cover all
other labelled rows.

Defined results: a null or empty text has no words and fails the base rules; a very long text is measured whole; a null lang is a stratum of its own, the
empty one; labels without quality don't count, repeated labels count each; a stratum without labels rejects nothing; rows
are independent, so ties and repeated rows don't matter; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import unused
from .common import broadcast_if_small, cut, map_rows, slices, text_batches, use
from .words import shingle_hashes, word_hashes

ALPHA, DELTA, GOOD_COST, BINS = 0.025, 0.05, 10, 200
SIGNALS = ("symbols", "dup_lines", "repeats", "upper", "bangs", "brevity")
_SYMBOLS, _SPACE, _UPPER = b"#*$%&|<>", b" \t\n\v\f\r", bytes(range(65, 91))
WINDOW = 8


def repeat_words(hashes: np.ndarray) -> int:
    """Words in windows that occur twice or more, first included."""
    if len(hashes) < WINDOW + 1:
        return 0
    windows = shingle_hashes(hashes, WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Measurer:
    def __call__(self, text: str | None) -> tuple:
        return self.of([text])[0]

    def of(self, texts: list[str | None]) -> list[tuple]:
        hashes, at = word_hashes(pa.array(texts, pa.string()), lower=False)
        return [self._one(t, hashes[a:b]) for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _one(self, text: str | None, hashes: np.ndarray) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bins of the signals."""
        text = text or ""
        raw = text.encode()
        n = len(hashes)
        chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
        repeats = repeat_words(hashes)
        upper = len(raw) - len(raw.translate(None, _UPPER))
        rates = (symbols / max(chars, 1), dup / max(len(lines), 1), repeats / max(n, 1), upper / max(chars, 1), raw.count(b"!") / max(chars, 1), 1 / (1 + n / 10))
        return n, chars, symbols, dup, repeats, [min(BINS, int(r * BINS)) for r in rates]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


SCHEMA = "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, bins array<int>"


def measure(docs: DataFrame) -> DataFrame:

    def start() -> Callable:
        use()
        measurer = Measurer()

        def f(ids: list, texts: list, langs: list) -> list[list]:
            rows = measurer.of(texts)
            return [ids, [x or "" for x in langs], *([r[i] for r in rows] for i in range(6))]

        return f

    return map_rows(docs, ["doc_id", "text", "lang"], SCHEMA, start)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return h


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact up to rounding."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, level: float) -> int:
    """The bin from which documents are rejected, len(good) for none; good and bad count labelled documents by bin."""
    n, none = int(good.sum()), len(good)
    fell = np.cumsum(good[::-1])[::-1]
    caught = np.cumsum(bad[::-1])[::-1]
    best, best_gain = none, 0
    for c in range(none - 1, 0, -1):
        if n == 0 or binomial_tail(int(fell[c]), n, alpha) > level:
            break
        if (gain := int(caught[c]) - GOOD_COST * int(fell[c])) > best_gain:
            best, best_gain = c, gain
    return best


def most_lost(n: int, alpha: float, level: float) -> int:
    """The most of n good documents that a certified region may hold, -1 if even an empty one is not certified."""
    low, high = -1, n
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if binomial_tail(k, n, alpha) <= level else (low, k)
    return low


def least_labels(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good labels that a stratum needs for a cutoff, if no good document falls to it."""
    return math.ceil(math.log(delta / (2 * strata)) / math.log1p(-alpha))


def sweep(good: np.ndarray, bad: np.ndarray, swept: list[int], lost: int, most: int, usual: np.ndarray) -> tuple[int, int, int]:
    """One turn of the joint way: signal (-1: nothing more to gain), cutoff, good documents of its steps.

    good and bad count labelled documents that no cutoff rejects yet, by signal and bin; `lost` good ones fell in earlier turns;
    usual has each signal's mean and deviation in documents that aren't of this holdout. More than most - lost mean that the last step was not certified.
    """
    left = [s for s in range(len(bad)) if s not in swept and bad[s, 1:].any()]
    if lost > most or not left:
        return -1, bad.shape[1], 0
    s = max(left, key=lambda i: ((bad[i] @ np.arange(bad.shape[1]) / bad[i].sum() - usual[0][i]) / (1 + usual[1][i]), -i))
    share = -(-(most - lost) // (len(bad) - len(swept)))
    fell, caught = (np.cumsum(x[s, ::-1])[::-1] for x in (good, bad))
    best, best_gain, seen = bad.shape[1], 0, 0
    for c in np.flatnonzero(bad[s])[::-1]:
        if c == 0:
            break
        seen = int(fell[c])
        if lost + seen > most:
            break
        if (gain := int(caught[c]) - GOOD_COST * seen) > best_gain:
            best, best_gain = int(c), gain
        if seen > share:
            break
    return s, best, seen


def _rejects(cutoffs: str) -> Column:
    """Whether any signal reaches its cutoff."""
    reached = [F.get("bins", F.lit(i)) >= F.get(cutoffs, F.lit(i)) for i in range(len(SIGNALS))]
    return F.coalesce(functools.reduce(Column.__or__, reached), F.lit(False))


def _usual(measured: DataFrame, known: DataFrame) -> DataFrame:
    """stratum, means and deviations of the signals: of its documents without labels, or else of other strata's good ones, or else 0."""
    signals = range(len(SIGNALS))
    flagged = measured.select("doc_id", "stratum", "bins").join(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    is_kind = {"new": F.col("quality").isNull(), "good": F.coalesce(F.col("quality") > 0, F.lit(False))}
    bins = [F.get("bins", F.lit(i)).cast("double") for i in signals]
    own = flagged.groupBy("stratum").agg(*(F.array(*(F.sum(F.when(is_kind[k], v)) for v in (F.lit(1.0), *bins, *(b * b for b in bins)))).alias(k) for k in is_kind))
    size = 1 + 2 * len(SIGNALS)
    total = own.agg(F.array(*(F.sum(F.get("good", F.lit(i))) for i in range(size))).alias("total"))
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    other = [at("total", i) - at("good", i) for i in range(size)]
    chosen = F.when(at("new", 0) > 0, F.col("new")).otherwise(F.array(*other))
    joined = own.crossJoin(F.broadcast(total)).select("stratum", chosen.alias("sums"))
    n = F.greatest(F.get("sums", F.lit(0)), F.lit(1.0))
    mean = [F.get("sums", F.lit(1 + i)) / n for i in signals]
    deviation = [F.sqrt(F.greatest(F.get("sums", F.lit(1 + len(SIGNALS) + i)) / n - mean[i] * mean[i], F.lit(0.0))) for i in signals]
    return joined.select("stratum", F.array(*mean).alias("means"), F.array(*deviation).alias("deviations"))


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs array<int> in the order of SIGNALS, of measured documents and labels(doc_id, quality); runs a job for each turn."""
    spark, signals = measured.sparkSession, len(SIGNALS)
    known = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null")
    measured = measured.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    labelled = cut(spark, measured.select("doc_id", "stratum", "bins").join(known, "doc_id").select("stratum", "bins", (F.col("quality") > 0).alias("good")), "labelled")
    usual = cut(spark, _usual(measured, known), "usual")  # a row for each stratum
    strata = max(1, usual.count())
    level = delta / (2 * strata)
    none = [BINS + 1] * signals

    def turn(rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros((signals, BINS + 1), np.int64), np.zeros((signals, BINS + 1), np.int64)
        good[rows.signal, rows.bin], bad[rows.signal, rows.bin] = rows.good, rows.bad
        first = rows.iloc[0]
        if pd.isna(first.most):
            cutoffs, swept, lost, most = list(none), [], 0, most_lost(int(good[0].sum()), alpha, level)
            apart = [cutoff(good[s], bad[s], alpha / signals, level / signals) for s in range(signals)]
        else:
            cutoffs, swept, lost, most, apart = list(first.cutoffs), list(first.swept), int(first.lost), int(first.most), list(first.apart)
        s, at, fell = sweep(good, bad, swept, lost, most, np.array([first.means, first.deviations]))
        if s >= 0:
            cutoffs[s] = at
            swept.append(s)
        going = s >= 0 and len(swept) < signals and lost + fell <= most
        return pd.DataFrame({"stratum": [first.stratum], "cutoffs": [cutoffs], "apart": [apart], "swept": [swept], "lost": [lost + fell], "most": [most], "going": [going]})

    schema = "stratum string, cutoffs array<int>, apart array<int>, swept array<int>, lost bigint, most bigint, going boolean"
    state, ended = None, None
    while state is None or not state.isEmpty():
        if state is None:
            rows = labelled.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:-1])))
        else:
            rows = labelled.join(broadcast_if_small(state), "stratum").where(~_rejects("cutoffs"))
        held = ["cutoffs", "apart", "swept", "lost", "most", "means", "deviations"]
        rows = rows.join(broadcast_if_small(usual), "stratum")
        counts = (
            rows.select("stratum", "good", *held, F.posexplode("bins").alias("signal", "bin"))
            .groupBy("stratum", "signal", "bin").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"), *(F.first(c).alias(c) for c in held))
        )
        # a group holds at most signals * (BINS + 1) rows, whatever the number of documents
        after = cut(spark, counts.groupBy("stratum").applyInPandas(turn, schema), "turn")
        if state is not None:  # strata of which no labelled document is left
            ended = ended.unionByName(state.join(after.select("stratum"), "stratum", "left_anti"))
        done = after.where("not going")
        ended, state = done if ended is None else ended.unionByName(done), after.where("going")

    ended = cut(spark, ended, "ended")
    weight = F.when(F.col("good"), -GOOD_COST).otherwise(1)
    gains = labelled.join(broadcast_if_small(ended), "stratum").groupBy("stratum").agg(*(F.sum(F.when(_rejects(c), weight).otherwise(0)).alias(f"gain_{c}") for c in ("cutoffs", "apart")))
    return ended.join(broadcast_if_small(gains), "stratum").select("stratum", F.when(F.col("gain_apart") > F.col("gain_cutoffs"), F.col("apart")).otherwise(F.col("cutoffs")).alias("cutoffs"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed, rule (the first signal that rejects, or null), kept, and certified (whether the stratum has a cutoff at all)."""
    judged = measured.join(broadcast_if_small(cutoffs), "stratum", "left")
    rule = F.coalesce(*(F.when(F.get("bins", F.lit(i)) >= F.get("cutoffs", F.lit(i)), F.lit(s)) for i, s in enumerate(SIGNALS)))
    return (
        judged.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("rule", F.when(~F.col("base_failed"), rule))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
        .withColumn("certified", F.coalesce(F.exists("cutoffs", lambda c: c <= BINS), F.lit(False)))
    )


def keep_good(docs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Whole rows of docs that pass; cutoffs as calibrate() gives them."""
    held = unused(docs, "_cutoffs")
    side = cutoffs.select(F.col("stratum").alias(f"{held}_of"), F.col("cutoffs").alias(held))
    joined = docs.join(broadcast_if_small(side), F.coalesce(docs["lang"], F.lit("")) == F.col(f"{held}_of"), "left").select(*(docs[c] for c in docs.columns), held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        measurer, none = Measurer(), [BINS + 1] * len(SIGNALS)
        for batch in (part for whole in batches for part in slices(whole)):
            keep = []
            for (n, _, _, _, repeats, bins), own in zip(measurer.of(batch["text"].to_pylist()), batch[held].to_pylist(), strict=True):
                keep.append(n >= 20 and 100 * repeats <= 30 * n and all(b < c for b, c in zip(bins, own or none, strict=True)))
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns([held])

    text_batches(docs.sparkSession)
    return joined.mapInArrow(run, docs.schema)


__all__ = ["binomial_tail", "calibrate", "cutoff", "judge", "keep_good", "least_labels", "measure", "most_lost", "sweep"]
