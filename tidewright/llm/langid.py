"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters in lower case, longer runs cut evenly into pieces of at most MOST_LETTERS. Features of a word: itself,
affixes of one to four characters, character bigrams and trigrams with edges (all hashed), and membership in each language's lexicon of frequent training words.
Weights and the transitions between languages are learnt by stochastic gradients of the log-likelihood, on windows of
single documents and on spliced windows of several languages, so the chain handles code-switched text. Forward-backward
gives each word's probabilities; a document's language has the largest sum, and its score is their mean.

Training takes a bounded sample of labelled documents: for each value of lang PER_LANGUAGE of them, but never more than
SAMPLE_WORDS / WINDOW_WORDS in all (shared evenly by the languages, one each at least), those with the smallest hash of
identifier and text, WINDOW_WORDS words from anywhere in each. Everything else covers all rows, and every value of lang that has a text with a
letter outside the held-out rows is learnt. The weights are BUCKETS doubles a language, three times over while the driver learns them: 0.8 MB for each value of lang.

Defined results: `und` with score 0 for a null text or one without a letter, and for all texts if nothing was learnt; a very
long text is read whole; documents with a null lang or doc_id are not learnt from; rows are independent, so ties and repeated rows don't matter; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, broadcast_if_small, map_rows, slices, text_batches, use

PER_LANGUAGE, WINDOW_WORDS, SAMPLE_WORDS = 150, 160, 3_000_000
BUCKETS, LEXICON = 1 << 15, 400
UNKNOWN = "und"
#: Mean word probability below which keep_known rejects a document; an even guess among four languages has 0.25.
LEAST_SCORE = 0.4
#: All n-grams of a word so long are features of it.
MOST_LETTERS = 12
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall(text.lower()) if text and any(map(str.isalpha, text)) else []
    if max(map(len, words), default=0) <= MOST_LETTERS:
        return words
    return [p for w in words for p in ((w,) if len(w) <= MOST_LETTERS else pieces(w))]


def pieces(word: str) -> list[str]:
    n = -(-len(word) // MOST_LETTERS)
    return [word[i * len(word) // n : (i + 1) * len(word) // n] for i in range(n)]


def _mix(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    h = (h ^ np.uint32(x) if isinstance(x, int) else h ^ x) * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


def features(words: list[str]) -> np.ndarray:
    """A row of hashed features for each word of at most MOST_LETTERS letters: BUCKETS where it has no such n-gram."""
    n = len(words)
    chars = np.zeros((n, MOST_LETTERS + 2), np.uint32)
    chars[:, 0] = ord("^")
    chars[:, 1 : MOST_LETTERS + 1] = np.array(words, f"<U{MOST_LETTERS}").view(np.uint32).reshape(n, MOST_LETTERS) if n else 0
    length = (chars[:, 1:] != 0).sum(1)
    at = np.arange(n)
    chars[at, length + 1] = ord("$")
    start, out, none = np.zeros(n, np.uint32), [], np.int32(BUCKETS)

    def put(h: np.ndarray, has: np.ndarray | bool) -> None:
        out.append(np.where(has, (_mix(h, 7) & np.uint32(BUCKETS - 1)).astype(np.int32), none))

    h = _mix(start, 11)
    for i in range(1, MOST_LETTERS + 1):  # the word, and its affixes, the whole word if it is shorter
        h = np.where(i <= length, _mix(h, chars[:, i]), h)
        if i <= 4:
            put(_mix(h, 20 + i), True)
    put(_mix(h, 1), True)
    h = _mix(start, 13)
    for i in range(1, 5):
        h = np.where(i <= length, _mix(h, chars[at, np.maximum(length + 1 - i, 1)]), h)
        put(_mix(h, 30 + i), True)
    for k in (2, 3):
        for i in range(MOST_LETTERS + 3 - k):
            h = _mix(start, 50 + k)
            for j in range(k):
                h = _mix(h, chars[:, i + j])
            put(h, i + k <= length + 2)
    return np.stack(out, 1)


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, list[int]] = field(default_factory=dict)  # of each frequent word, its languages
    weights: np.ndarray | None = None  # BUCKETS + languages + 1 rows; the last one is zero
    transitions: np.ndarray | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of the weights that each word adds up."""
        known = [self.lexicon.get(w, ()) for w in words]
        own, none = features(words), BUCKETS + len(self.languages)
        out = np.full((len(words), own.shape[1] + max(map(len, known), default=0)), none, np.int32)
        out[:, : own.shape[1]] = np.where(own < BUCKETS, own, none)
        for i, languages in enumerate(known):
            if languages:
                out[i, own.shape[1] : own.shape[1] + len(languages)] = [BUCKETS + k for k in languages]
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 4096):
            out[at : at + 4096] = self.weights[self.rows(words[at : at + 4096])].sum(1)
        return out


def forward_backward(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of emissions (time, batch, label): word marginals, sums of pair marginals, log normalisers."""
    steps, batch, k = e.shape
    top = e.max(2, keepdims=True)
    p, a = np.exp(e - top), np.exp(t)
    alpha, beta, scale = np.empty_like(p), np.empty_like(p), np.empty((steps, batch, 1), e.dtype)
    for i in range(steps):
        x = p[i] / k if i == 0 else (alpha[i - 1] @ a) * p[i]
        scale[i] = x.sum(1, keepdims=True)
        alpha[i] = x / scale[i]
    beta[-1] = 1
    pairs = np.zeros((k, k), e.dtype)
    for i in range(steps - 2, -1, -1):
        x = beta[i + 1] * p[i + 1] / scale[i + 1]
        beta[i] = x @ a.T
        pairs += a * (alpha[i].T @ x)
    return alpha * beta, pairs, (np.log(scale) + top).sum(0)[:, 0]


def train(samples: list[tuple[str, list[str]]], epochs: int = 3, steps: int = 40, batch: int = 48, rate: float = 0.3, seed: int = 7) -> Model:
    """Of (language, words) pairs."""
    languages = sorted({x for x, _ in samples})
    model, k, rng = Model(languages), len(languages), np.random.default_rng(seed)
    samples = [(languages.index(x), w) for x, w in samples if w]
    for i in range(k):
        for w, _ in sorted(Counter(w for x, ws in samples if x == i for w in ws).items(), key=lambda c: (-c[1], c[0]))[:LEXICON]:
            model.lexicon.setdefault(w, []).append(i)
    model.weights, model.transitions = np.zeros((BUCKETS + k + 1, k)), np.zeros((k, k))
    vocab = sorted({w for _, ws in samples for w in ws})
    rows, number = model.rows(vocab), {w: i for i, w in enumerate(vocab)}
    coded = [(x, np.array([number[w] for w in ws])) for x, ws in samples]
    by = [[c for x, c in coded if x == i] for i in range(k)]
    total = sum(len(c) for _, c in coded)
    g2, t2 = np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2)
    for _ in range(epochs * total // (steps * batch) + 1 if total else 0):
        w, y = np.empty((steps, batch), np.int64), np.empty((steps, batch), np.int64)
        for b in range(batch):
            at, x, first = 0, int(rng.integers(k)), True
            while at < steps:
                # half of the sequences stay in one language, the others switch after a few words
                n = steps - at if first and b % 2 else min(steps - at, int(rng.integers(4, 20)))
                source = by[x][int(rng.integers(len(by[x])))] if by[x] else np.zeros(1, np.int64)
                start = int(rng.integers(max(1, len(source) - n + 1)))
                part = source[start : start + n]
                w[at : at + len(part), b], y[at : at + len(part), b] = part, x
                at, x, first = at + len(part), (x if b % 2 else int(rng.integers(k))), False
        used = rows[w]
        marginal, pairs, _ = forward_backward(model.weights[used].sum(2), model.transitions)
        off = -marginal
        np.put_along_axis(off, y[..., None], np.take_along_axis(off, y[..., None], 2) + 1, 2)
        flat, touched = used.reshape(-1, used.shape[2]), np.unique(used)
        gradient = np.zeros_like(model.weights)
        spread = np.repeat(off.reshape(-1, k), flat.shape[1], 0)
        for c in range(k):
            gradient[:, c] = np.bincount(flat.ravel(), spread[:, c], len(gradient))
        gradient = gradient[touched] / batch - 1e-4 * model.weights[touched]
        g2[touched] += gradient**2
        model.weights[touched] += rate * gradient / np.sqrt(g2[touched])
        model.weights[-1] = 0
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
        gt = (seen - pairs) / batch
        t2 += gt**2
        model.transitions += rate * gt / np.sqrt(t2)
    model.weights, model.transitions = model.weights.astype(np.float32), model.transitions.astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, list[str]]]:
    """The bounded training sample of docs(doc_id, text, lang), at the driver: the model that is fitted on it has a row for each language."""
    has_letter = F.col("text").rlike(r"\p{L}")
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & has_letter).withColumn("h", F.xxhash64("doc_id", "text"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    languages = counts.count()
    if not languages:
        return []
    per_language = max(1, min(per_language, SAMPLE_WORDS // WINDOW_WORDS // languages))
    # hashes are even, so a language's share of them below a bound is known; twice as many are read, the smallest taken
    bound = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), (2 * per_language + 8) / F.col("_rows")).alias("_bound"))
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for lang, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if words := words_of(text):
                    start = h % max(1, len(words) - WINDOW_WORDS + 1)
                    out.append((lang, h, " ".join(words[start : start + WINDOW_WORDS])))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["lang", "h", "words"])

    text_batches(docs.sparkSession)

    def taken(rows: DataFrame) -> list:
        some = rows.select("lang", "h", "text").mapInArrow(windows, "lang string, h bigint, words string")
        # bounded for each language, before the shuffle too
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))
        return some.withColumn("rank", rank).where(F.col("rank") <= per_language).collect()

    found = taken(usable.join(broadcast_if_small(bound), F.col("lang") == F.col("_lang")).where(share <= F.col("_bound")))
    # a language of few different rows, each many times, may have none below its bound: all of its rows are looked at
    had = {r["lang"] for r in found}
    if len(had) < languages:
        missing = [(r["lang"],) for r in counts.select("lang").collect() if r["lang"] not in had]
        found += taken(usable.join(broadcast_if_small(docs.sparkSession.createDataFrame(missing, "lang string")), "lang"))
    return [(r["lang"], r["words"].split(" ")) for r in sorted(found, key=lambda r: (r["h"], r["lang"], r["words"]))]


#: Words in each generation of a worker's memory: some 15 MB.
MOST_WORDS = 100_000


class Emissions:
    """Emissions of words by a model, remembered in the worker; those of many new words are worked out at a time."""

    def __init__(self, model: Model):
        self.model, self.width = model, 4 * len(model.languages)
        self.known = Recent(MOST_WORDS, lambda w: None)

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        known.age()
        new = [w for w in set(words) if known[w] is None]
        if new:
            made = self.model.emissions(new).tobytes()
            known.update((w, made[i * self.width : (i + 1) * self.width]) for i, w in enumerate(new))
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.float32).reshape(len(words), -1)


_emissions: dict[str, Emissions] = {}


def emissions_of(model: Model) -> Emissions:
    """One for each model in a worker; to be called as a task begins."""
    if model.key not in _emissions:
        _emissions.clear()
        _emissions[model.key] = Emissions(model)
    use(_emissions[model.key].known)
    return _emissions[model.key]


#: Words times languages of a group of documents that forward-backward handles at once, one document at least; words of a block of a chain;
#: numbers in the matrices of blocks that are held at once.
GROUP_CELLS, BLOCK, MATRIX_CELLS = 800_000, 128, 2_000_000


def chain_sums(p: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Sums of the words' label probabilities in each chain, by forward-backward; p has the words of all chains one after another.

    Chains are cut into blocks, all of which go forward together: first with every label before them, which gives a matrix for each
    block; the matrices, one after another, give the messages at the blocks' ends; with these all blocks go forward and back.
    """
    k, p, a = p.shape[1], p.astype(np.float64), a.astype(np.float64)
    blocks = -(-lengths // BLOCK)
    chain = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(np.cumsum(lengths) - lengths, blocks) + number * BLOCK
    sizes = np.minimum(BLOCK, np.repeat(lengths, blocks) - number * BLOCK)
    order = np.argsort(-sizes, kind="stable")
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # blocks longer than each step, in that order

    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    before, after = np.ones((len(order), k)), np.ones((len(order), k))

    def through(some: np.ndarray) -> np.ndarray:
        """The matrices of the numbered blocks, by their places in `order`, longest first."""
        out = np.empty((len(some), k, k))
        length = sizes[order[some]]
        for i in range(length[0]):
            n = int(np.searchsorted(-length, -i, side="left"))
            now = p[starts[order[some[:n]]] + i]
            x = np.eye(k) * now[:, None, :] if i == 0 else (out[:n] @ a) * now[:, None, :]
            out[:n] = x / x.sum((1, 2), keepdims=True)
        return out

    # chains of one block need no matrix; those of others are worked out MATRIX_CELLS at a time, from the first and then from the last
    many = np.flatnonzero(np.repeat(blocks > 1, blocks))
    slab = max(1, MATRIX_CELLS // (k * k))
    slabs = [many[i : i + slab] for i in range(0, len(many), slab)]
    kept = None
    for cs in slabs:
        some = np.sort(at[cs])
        kept = (some, through(some))
        place = dict(zip(some.tolist(), range(len(some)), strict=True))
        for c in cs.tolist():
            if number[c] + 1 < blocks[chain[c]]:
                x = before[at[c]] @ (kept[1][place[int(at[c])]] @ a)
                before[at[c + 1]] = x / x.sum()
    for j, cs in enumerate(reversed(slabs)):
        some = np.sort(at[cs])
        matrices = kept[1] if j == 0 else through(some)
        place = dict(zip(some.tolist(), range(len(some)), strict=True))
        for c in reversed(cs.tolist()):
            if number[c]:
                x = a @ (matrices[place[int(at[c])]] @ after[at[c]])
                after[at[c - 1]] = x / x.sum()

    forward, message = np.empty_like(p), before
    for i, n in enumerate(live):
        words = starts[order[:n]] + i
        x = message[:n] if i == 0 else message[:n] @ a
        x = x * p[words]
        forward[words] = message[:n] = x / x.sum(1, keepdims=True)
    sums = np.zeros((len(order), k))
    for i in range(len(live) - 1, -1, -1):
        n = live[i]
        words = starts[order[:n]] + i
        g = forward[words] * after[:n]
        sums[:n] += g / g.sum(1, keepdims=True)
        x = (after[:n] * p[words]) @ a.T
        after[:n] = x / x.sum(1, keepdims=True)
    out = np.zeros((len(lengths), k))
    np.add.at(out, chain[order], sums)
    return out


def _predict(emissions: Emissions, texts: list[list[str]]) -> tuple[list[int], list[float]]:
    """Label (-1: none) and score of each document of words."""
    model = emissions.model
    k, a = len(model.languages), np.exp(model.transitions)
    label, score = [-1] * len(texts), [0.0] * len(texts)
    todo = [i for i in range(len(texts)) if texts[i] and k]
    at = 0
    while at < len(todo):
        group, n = [], 0
        while at < len(todo) and (not group or (n + len(texts[todo[at]])) * k <= GROUP_CELLS):
            group.append(todo[at])
            n += len(texts[todo[at]])
            at += 1
        lengths = np.array([len(texts[i]) for i in group])
        p = emissions.of([w for i in group for w in texts[i]])
        sums = chain_sums(np.maximum(np.exp(p - p.max(1, keepdims=True)), np.float32(1e-20)), lengths, a)
        best = sums.argmax(1)
        for j, i in enumerate(group):
            label[i], score[i] = int(best[j]), min(1.0, float(sums[j, best[j]] / lengths[j]))
    return label, score


def predict_texts(model: Model, texts: list[str | None], emissions: Emissions | None = None) -> tuple[list[str], list[float]]:
    label, score = _predict(emissions or Emissions(model), [words_of(t) for t in texts])
    return [UNKNOWN if i < 0 else model.languages[i] for i in label], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to doc_id, lang_pred, score; no shuffle."""
    own = _shared(docs, model)

    def start() -> Callable:
        emissions = emissions_of(own.value)
        return lambda ids, texts: [ids, *predict_texts(emissions.model, texts, emissions)]

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, lang_pred string, score double", start)


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Whole rows of docs with a language, of a score of at least `least`."""
    own = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = emissions_of(own.value)
        for batch in (part for whole in batches for part in slices(whole)):
            langs, scores = predict_texts(emissions.model, batch["text"].to_pylist(), emissions)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def _shared(docs: DataFrame, model: Model) -> Broadcast:
    """The model, sent to each executor once: some 130 kB a language."""
    return docs.sparkSession.sparkContext.broadcast(model)
