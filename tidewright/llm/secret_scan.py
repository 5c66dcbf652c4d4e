"""Secrets in whole texts, by Spark expressions alone.

Base rules give the spans of `assign`, `access` and `hex` matches. Beside them every long run of characters of an encoding (ENCODINGS: the first
alphabet that has all of its characters) goes through a battery of tests of randomness, each exact in its moments for characters drawn uniformly from the alphabet:

- uniformity: chi squared, which is linear in the number of coincident pairs of characters; its tail from that number's first three moments, as expected counts are far below one;
- runs: the runs above and below the alphabet's middle, one and a binomial number;
- serial correlation: the sum of products of neighbours' deviations from the middle.

The run's p is thrice the least of the three. Runs which aren't random are discoveries: in each stratum (encoding and power of two of the length, so that short runs,
which can't have a small p, don't set the cutoff of long ones) the Benjamini-Hochberg procedure at FALSE_DISCOVERIES dismisses them, which bounds the expected share of random runs
among those dismissed. What is left are spans `random_<encoding>`. Runs below an encoding's least length are left out, as ordinary text of that length could pass.

p is counted in steps of a twentieth of a power of ten, rounded up, so the procedure needs counts of strata and steps only: their number is fixed, and the corpus isn't sorted.

Defined results: a null or empty text has no spans; positions are code points, with the end exclusive; a very long text counts whole; a span of the battery may lie within a base one, whose value it confirms;
rows are independent but for the cutoffs, so repeated rows stay and count each; identifiers are carried only; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, running_sums

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The least lengths are in the patterns where the match is the same: a run of these characters is taken whole or not at all.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
#: Runs that may be encoded; the look behind only spares the search tries within a run.
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
FALSE_DISCOVERIES = 0.05
#: Steps of -log10(p): a power of ten has STEPS of them.
STEPS, MOST_STEP, CLASSES = 20, 6000, 32

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


@dataclass(frozen=True)
class Encoding:
    """A run is of it if `pattern` matches all of its characters and each of `has` some; `fold`: upper and lower case mean the same."""

    name: str
    alphabet: str
    pattern: str
    has: tuple[str, ...]
    least: int
    fold: bool = False


_ALL = ("[A-Z]", "[a-z]", "[0-9]")
#: Ordinary text of `least` characters has some four times the coincident pairs of random ones with 62 characters, and more than twice with 36.
ENCODINGS = (
    Encoding("hex", _DIGITS + "abcdef", "^([0-9a-f]+|[0-9A-F]+)$", ("[A-Fa-f]", "[0-9]"), 16, fold=True),
    Encoding("base32", _UPPER + "234567", "^[A-Z2-7]+$", ("[A-Z]", "[2-7]"), 16),
    Encoding("base36", _DIGITS + _LOWER, "^([0-9a-z]+|[0-9A-Z]+)$", ("[A-Za-z]", "[0-9]"), 24, fold=True),
    Encoding("base62", _UPPER + _LOWER + _DIGITS, "^[A-Za-z0-9]+$", _ALL, 20),
    Encoding("base64", _UPPER + _LOWER + _DIGITS + "+/", "^[A-Za-z0-9+/]+$", _ALL, 20),
    Encoding("base64url", _UPPER + _LOWER + _DIGITS + "-_", "^[A-Za-z0-9_-]+$", _ALL, 20),
)
KINDS = (*BASE, *(f"random_{e.name}" for e in ENCODINGS))
#: Coefficients of the rational Chebyshev fit of ln erfc(x) + x**2 - ln t in t = 1 / (1 + x / 2), from the published numerical literature (fixed values).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def located(text: Column, pattern: str) -> Column:
    """The matches of a pattern that matches no empty string, leftmost first: start, end (exclusive, in code points) and match."""
    steps = lambda pieces, found: F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
    placed = lambda ends, found: F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
    # what lies between matches is split off only where there are any
    some = lambda found: let(let(F.split(text, pattern, -1), lambda pieces: steps(pieces, found)), lambda s: placed(running_sums(s), found))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(some(found)))


def _log_erfc(x: Column) -> Column:
    """Of x >= 0, with a relative error of erfc of about 1e-7."""

    def of(t: Column) -> Column:
        sum_ = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            sum_ = sum_ * t + F.lit(c)
        return F.log(t) - x * x + sum_

    return let(1 / (1 + x / 2), of)


def coincidences(n: Column, k: int, pairs: Column) -> Column:
    """ln of the probability of as many coincident pairs or more among n uniform draws of k: a gamma variable of the same mean, variance and skewness, by Wilson and Hilferty's cube root."""
    q = 1 / k
    n = n.cast("double")
    couples, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    variance = couples * q * (1 - q)
    third = couples * q * (1 - q) * (1 - 2 * q) + triples * 6 * q * q * (1 - q)
    shape = 4 * F.pow(variance, F.lit(3.0)) / (third * third)
    s = (pairs - 0.5 - couples * q) / F.sqrt(variance)
    z = F.sqrt(shape) * 3 * (F.cbrt(F.greatest(1 + s / F.sqrt(shape), F.lit(0.0))) - 1 + 1 / (9 * shape))
    return let(z, lambda z: F.when(z > 0, _log_erfc(z / math.sqrt(2)) - math.log(2)).otherwise(F.lit(0.0)))


def _two_sided(z: Column) -> Column:
    return _log_erfc(F.abs(z) / math.sqrt(2))


def step_of(run: Column, e: Encoding) -> Column:
    """-log10 of the battery's p in steps, for a run without its padding."""
    k, middle = len(e.alphabet), (len(e.alphabet) - 1) / 2
    bits = "".join("01"[i >= k / 2] for i in range(k))
    folded = F.lower(run) if e.fold else run

    def tested(s: Column) -> Column:
        n = F.length(s)
        same = F.regexp_extract_all(F.array_join(F.array_sort(F.split(s, "")), ""), F.lit(r"(.)\1*"), F.lit(0))
        pairs = F.aggregate(same, F.lit(0.0), lambda total, x: total + F.length(x).cast("double") * (F.length(x) - 1) / 2)
        runs = F.size(F.regexp_extract_all(F.translate(s, e.alphabet, bits), F.lit("0+|1+"), F.lit(0))) - 1
        off = F.greatest(F.abs(runs - (n - 1) / 2) - 0.5, F.lit(0.0))
        values = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(e.alphabet), c) - 1 - middle)
        products = lambda v: F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        serial = let(values, products) / ((k * k - 1) / 12)
        logs = F.least(coincidences(n, k, pairs), _two_sided(off / (F.sqrt(n - 1) / 2)), _two_sided(serial / F.sqrt(n - 1)))
        step = F.floor(-(logs + math.log(3)) / math.log(10) * STEPS)
        return F.greatest(F.lit(0), F.least(F.lit(MOST_STEP), step)).cast("int")

    return let(folded, tested)


def _tested(found: Column) -> Column:
    """Of a located run: its place, encoding (a number), class of length and step; encoding null if it has none."""

    def of(run: Column) -> Column:
        number, step = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, e in reversed(list(enumerate(ENCODINGS))):
            fits = run.rlike(e.pattern)
            for some in e.has:
                fits = fits & run.rlike(some)
            long = F.length(run) >= e.least
            number, step = F.when(fits, F.when(long, F.lit(i))).otherwise(number), F.when(fits, F.when(long, step_of(run, e))).otherwise(step)
        return F.struct(found["start"].alias("start"), found["end"].alias("end"), number.alias("encoding"), F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.length(run)))).cast("int").alias("class"), step.alias("step"))

    return let(F.regexp_replace(found["match"], "=+$", ""), of)


def found_in(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, base spans (start, kind, end) and tested runs."""
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= LEAST_VALUE
    span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    base = [F.filter(located(text, ASSIGN), value), located(text, ACCESS), located(text, HEX)]
    spans = F.array_sort(F.concat(*(F.transform(b, span(i)) for i, b in enumerate(base))))
    runs = F.filter(F.transform(located(text, RUN), _tested), lambda r: r["encoding"].isNotNull())
    return docs.select("doc_id", spans.alias("base"), runs.alias("runs"))


def cutoffs(found: DataFrame, level: float = FALSE_DISCOVERIES) -> dict[tuple[int, int], int]:
    """For each encoding and class the least step that is dismissed; none where nothing is."""
    runs = found.select(F.explode("runs").alias("r")).select("r.encoding", "r.class", "r.step")
    counts = runs.groupBy("encoding", "class", "step").count()
    stratum = Window.partitionBy("encoding", "class")
    from_here = stratum.orderBy(F.col("step").desc())
    counts = counts.select("encoding", "class", "step", F.sum("count").over(from_here).alias("least"), F.sum("count").over(stratum).alias("all"))
    passing = counts.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("all") <= level * F.col("least"))
    return {(r["encoding"], r["class"]): r["step"] for r in passing.groupBy("encoding", "class").agg(F.min("step").alias("step")).collect()}


def _listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, kinds)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, level: float = FALSE_DISCOVERIES) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random. Runs jobs to build its result."""
    found = cut(docs.sparkSession, found_in(docs), "secrets")
    least = cutoffs(found, level)
    table = F.array(*(F.lit(least.get((e, c), MOST_STEP + 1)) for e in range(len(ENCODINGS)) for c in range(CLASSES)))
    random = F.filter("runs", lambda r: r["step"] < F.element_at(table, r["encoding"] * CLASSES + r["class"] + 1))
    added = F.transform(random, lambda r: F.struct(r["start"].alias("start"), (r["encoding"] + len(BASE)).alias("kind"), r["end"].alias("end")))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *(number(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)), F.sha2(_listed(F.col("base"), BASE), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", added)), KINDS).alias("spans"), F.size(added).cast("bigint").alias("n_random"),
    )
