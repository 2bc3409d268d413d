"""Toxicity: a support vector machine over a gapped subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import functools
import heapq
import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.llm.common import fold, least_hashed
from allocora.runtime import small_table

#: Labelled documents the machine is fitted on, toxic and not, and the longest text among them, in bytes.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 4000, 40_000
#: Landmarks from either side, rounds of picking witnesses and hard negatives, and their number.
LANDMARKS, ROUNDS, NEGATIVES = 128, 3, 2000
RIDGE = 1e-4
#: A witness is found in this many different toxic texts at least, would be expected in this many clean
#: ones by chance, and is found in this share of them at most.
SUPPORT, EXPECTED, IMPURITY = 3, 12, 0.02
#: So many of all words, were they ordinary, may be found in toxic texts as often as a witness by chance.
CHANCE = 10
#: Texts whose sets of fragments have this Jaccard similarity count as one.
ALIKE = 0.8
#: Subsequences of three letters within this many characters; each character skipped counts as DECAY.
SPAN, DECAY = 5, 0.6
TILT = 0.01
#: One text in this many sets the probabilities.
APART = 3
#: Decision values below count as this one: far from any insult.
FLOOR = -1.0
#: Longer words are looked at in overlapping windows of this many characters.
WINDOW = 40
CACHE_WORDS = 400_000
THRESHOLD = 0.7

# 1-26 letters, 27 and 28 a word's begin and end, then other letters by code point, 0 anything else.
_BASE = 41
_FEATURES = _BASE**3
#: Digits and signs that stand for letters in a word.
STANDS_FOR = dict(zip("013457@$", "oieastas", strict=True))
_STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]
_SINGLES = re.compile(r"(?<!\S)\S(?:[\x20\t]+\S(?!\S)){2,}")
_PARTS = re.compile(r"[^\W_]{3,}")


@functools.lru_cache(maxsize=65_536)
def _letter(c: str) -> int:
    c = STANDS_FOR.get(c, c)
    if "a" <= c <= "z":
        return ord(c) - 96
    return 29 + ord(c) % (_BASE - 29) if c.isalpha() else 0


def _codes(word: str) -> list[int]:
    """Letter codes between a begin and an end; signs are passed over."""
    while word and not word[-1].isalnum():
        word = word[:-1].rstrip(word[-1])
    while word and not word[0].isalnum():
        word = word[1:].lstrip(word[0])
    return [27, *filter(None, map(_letter, word)), 28]


def _windows(words: list[str]) -> tuple[list[list[int]], np.ndarray]:
    """Codes of words and of their parts between signs, long ones in windows, and the word each belongs to.

    Windows start half a window apart, so that up to half a window of letters lies whole in one.
    """
    out, owner = [], []
    for at, word in enumerate(words):
        forms = [_codes(word)]
        if not word.isalnum():
            parts = _PARTS.findall(word)
            forms += [[27, *filter(None, map(_letter, part)), 28] for part in parts if len(parts) > 1]
        for codes in forms:
            for start in range(0, max(1, len(codes) - WINDOW // 2 - SPAN), WINDOW // 2):
                out.append(codes[start : start + WINDOW + SPAN])
                owner.append(at)
    return out, np.array(owner, np.int64)


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of all subsequences of equally long words; an id below ``_BASE``**2 or with a gap in it is none."""
    ids, weights = [], []
    n = codes.shape[1]
    for a, b, weight in _STEPS:
        if n > b:
            x, y, z = codes[:, : n - b], codes[:, a : n - b + a], codes[:, b:]
            ids.append(np.where((x > 0) & (y > 0) & (z > 0), (x * _BASE + y) * _BASE + z, 0))
            weights.append(np.full(n - b, weight))
    if not ids:
        return np.zeros((len(codes), 0), np.int32), np.zeros(0)
    return np.concatenate(ids, axis=1), np.concatenate(weights)


def _by_length(rows: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of the rows of each length, a few thousand at a time."""
    lengths = np.array([len(r) for r in rows])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for start in range(0, len(at), 4096):
            part = at[start : start + 4096]
            yield part, np.array([rows[i] for i in part], np.int32)


def _norms(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lengths of equally long words as vectors: a subsequence that occurs again adds up before it is squared."""
    order = np.argsort(ids, axis=1)
    ids, weights = np.take_along_axis(ids, order, axis=1), weights[order]
    first = np.ones(ids.shape, bool)
    first[:, 1:] = ids[:, 1:] != ids[:, :-1]
    sums = np.add.reduceat(weights.ravel(), np.flatnonzero(first)) ** 2
    sums[ids[first] == 0] = 0
    return np.sqrt(np.add.reduceat(sums, np.cumsum(first.sum(axis=1)) - first.sum(axis=1)))


def _sparse(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, subsequences, values) of words as vectors of unit length; the kernel of two words is their product."""
    for part, codes in _by_length(list(map(_codes, words))):
        ids, weights = _features(codes)
        if ids.shape[1]:
            yield part, ids, weights / np.maximum(_norms(ids, weights), 1e-12)[:, None]


class Landmarks:
    """Words on whose kernel the machine works; only their subsequences matter for it."""

    def __init__(self, words: list[str]):
        found = list(_sparse(words))
        self.columns = np.unique(np.concatenate([[0], *(ids.ravel() for _, ids, _ in found)]))
        self.rows = self._dense(found, len(words))

    def _dense(self, found: list, count: int) -> np.ndarray:
        out = np.zeros((count, len(self.columns)), np.float32)
        for part, ids, values in found:
            column = np.minimum(np.searchsorted(self.columns, ids), len(self.columns) - 1)
            values = np.where(self.columns[column] == ids, values, 0).astype(np.float32)
            np.add.at(out.reshape(-1), (part[:, None] * out.shape[1] + column).ravel(), values.ravel())
        out[:, 0] = 0
        return out

    def kernel(self, words: list[str]) -> np.ndarray:
        parts = [self._dense(list(_sparse(words[at : at + 1000])), len(words[at : at + 1000])) @ self.rows.T for at in range(0, len(words), 1000)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.rows)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the subsequences: landmarks' rows combined by the machine
    bias: float
    knots: np.ndarray  # decision values and
    shares: np.ndarray  # the probability at each, in between by straight lines

    @property
    def floor(self) -> float:
        """The decision value of whatever has nothing in its favour."""
        return max(FLOOR, self.bias)

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision values of words, those below the floor as the floor.

        A word's length as a vector is at least the root of its squared weights, so
        most words are seen to lie below without their repeated subsequences being
        put together.
        """
        out = np.full(len(words), self.floor)
        rows, owner = _windows(words)
        for part, codes in _by_length(rows):
            ids, weights = _features(codes)
            if not ids.shape[1]:
                continue
            raw = self.weights[ids] @ weights
            least = np.sqrt((ids > 0) @ weights**2)
            near = np.flatnonzero(raw > np.maximum((self.floor - self.bias) * least, 1e-9))
            if len(near):
                np.maximum.at(out, owner[part[near]], raw[near] / np.maximum(_norms(ids[near], weights), 1e-12) + self.bias)
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        """The curve, tilted a little, so that a larger decision value always counts for more."""
        share = np.interp(decision, self.knots, self.shares)
        return (1 - TILT) * share + TILT / (1 + np.exp(-np.asarray(decision, np.float64)))


def fragments(text: str | None) -> set[str]:
    """Distinct words of a whole text, lower-cased, and single characters in a row put together."""
    if not text:
        return set()
    found = set(text.lower().split())
    if any(len(w) == 1 for w in found):
        found.update("".join(m[0].split()) for m in _SINGLES.finditer(text.lower()))
    return found


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the bias last) of the squared hinge loss, each side weighing as much, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        weighed = x[active] * share[active, None]
        new = np.linalg.solve(weighed.T @ x[active] + ridge, weighed.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _curve(decision: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising curve from decision values to probabilities: neighbours whose shares fall are pooled, between pools it is straight."""
    order = np.argsort(decision, kind="stable")
    pools: list[tuple[float, float, int, int]] = []  # least and largest decision, toxic ones, all
    for x, t in zip(decision[order].tolist(), toxic[order].tolist(), strict=True):
        low, high, up, n = x, x, int(t), 1
        while pools and (pools[-1][1] == low or pools[-1][2] * n >= up * pools[-1][3]):
            low, _, more, count = pools.pop()
            up, n = up + more, n + count
        pools.append((low, high, up, n))
    prior = toxic.mean()
    shares = np.maximum.accumulate([(up + prior) / (n + 1) for *_, up, n in pools])
    return np.array([x for low, high, *_ in pools for x in (low, high)]), np.repeat(shares, 2)


def _different(texts: list[set[str]]) -> list[frozenset[str]]:
    """One of each group of copies: of equal sets of fragments, and of those at a Jaccard similarity of ``ALIKE`` or more.

    Two sets that much alike share a word among the rarest 1 - ``ALIKE`` of either;
    those that do are compared, with the ones kept only, so no copy is missed and
    nothing else is dropped.
    """
    sets = list(dict.fromkeys(map(frozenset, texts)))
    held = Counter(w for found in sets for w in found)
    by_word: dict[str, list[int]] = defaultdict(list)
    out: list[frozenset[str]] = []
    for found in sets:
        size = len(found)
        # a little below the share, so that rounding takes no word away
        rarest = heapq.nsmallest(size - math.ceil(ALIKE * size - 1e-9) + 1, found, key=lambda w: (held[w], w))
        near = {at for w in rarest for at in by_word[w] if ALIKE * size <= len(out[at]) + 1e-9 and ALIKE * len(out[at]) <= size + 1e-9}
        if any(len(found & out[at]) >= ALIKE * len(found | out[at]) for at in near):
            continue
        for w in rarest:
            by_word[w].append(len(out))
        out.append(found)
    return out


def _by_chance(c: int, d: int, share: float) -> float:
    """How likely ``c`` or more of ``c`` + ``d`` texts are toxic ones if each is with probability ``share``."""
    n = c + d
    odds, rest = math.log(share), math.log1p(-share)
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * odds + (n - k) * rest) for k in range(c, n + 1))


def witnesses(toxic: list[set[str]], down: Counter, n_down: int) -> list[str]:
    """Fragments that tell toxic texts, the most frequent first.

    Copies of a text count once, so that the other words of a text with an insult
    are not taken for one; every other text counts. A fragment must be found so
    often that clean texts would hold it too if it were not an insult, and hardly be
    found there. Of many ordinary words a few are found in toxic texts only by
    chance: one counts only if no more than ``CHANCE`` of all words would come out so.
    """
    different = _different(toxic)
    up = Counter(w for found in different for w in found)
    expected = n_down / max(1, len(different))
    share = len(different) / max(1, len(different) + n_down)
    tried = sum(up[w] + down[w] >= SUPPORT for w in up.keys() | down.keys())
    return [
        w
        for w, c in sorted(up.items(), key=lambda x: (-x[1], x[0]))
        if c >= SUPPORT and c * expected >= EXPECTED and down[w] <= IMPURITY * c * expected and tried * _by_chance(c, down[w], share) <= CHANCE
    ]


def with_insertions(words: list[str], draw: np.random.Generator) -> list[str]:
    """Each word with a letter put in at one place, which a gap in the kernel steps over."""
    out = []
    for word in words:
        at, letter = int(draw.integers(1, max(2, len(word)))), chr(97 + int(draw.integers(26)))
        out.append(word[:at] + letter + word[at:])
    return out


def fit(texts: list[tuple[bool, set[str]]], seed: int = 5) -> Model:
    """Fit on (toxic, fragments) of labelled texts.

    A toxic text has at least one toxic fragment, a clean one none. Positives are
    the witnesses, then also fragments found in toxic texts only that the machine
    calls toxic. Negatives are fragments of clean texts, drawn and then those the
    machine mistakes most. Landmarks are taken from both; the machine works on a
    fragment's kernel with the landmarks, whitened. One text in ``APART`` is kept
    apart, if there are enough, to turn decision values into probabilities.
    """
    kept_apart = texts
    if sum(t for t, _ in texts) >= 100:
        kept_apart, texts = texts[::APART], [x for at, x in enumerate(texts) if at % APART]
    toxic = np.array([t for t, _ in texts], bool)
    up, down = (Counter(w for label, found in texts if label == side for w in found) for side in (True, False))
    sure = witnesses([found for label, found in texts if label], down, int((~toxic).sum()))
    if not sure or toxic.all():
        share = (toxic.sum() + 1) / (len(toxic) + 2)
        return Model(np.zeros(_FEATURES, np.float32), FLOOR, np.array([FLOOR]), np.array([share]))
    clean, only = sorted(down.keys() - set(sure)), sorted(up.keys() - down.keys())
    draw = np.random.default_rng(seed)
    negatives = [clean[i] for i in draw.choice(len(clean), min(NEGATIVES, len(clean)), replace=False)]
    disguised = [w for w in with_insertions([w for w in sure if len(w) > 4] * 3, draw) if w not in down]
    hard: list[str] = []
    alike: list[str] = []
    known: dict[str, float] = {}
    for _ in range(ROUNDS):
        positives = list(dict.fromkeys([*sure, *alike, *disguised]))
        against = list(dict.fromkeys([*hard, *negatives]))
        marks = Landmarks([*positives[:LANDMARKS], *against[:LANDMARKS]])
        values, vectors = np.linalg.eigh(marks.rows @ marks.rows.T)
        whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
        names = [*positives, *against]
        w = _machine(marks.kernel(names) @ whiten, np.where(np.arange(len(names)) < len(positives), 1.0, -1.0))
        weights = np.zeros(_FEATURES, np.float32)
        weights[marks.columns] = (whiten @ w[:-1]) @ marks.rows
        model = Model(weights, float(w[-1]), np.array([FLOOR]), np.array([0.0]))
        for words in (clean, only, sure):
            known.update(zip(words, model.decide(words).tolist(), strict=True))
        hard = list(dict.fromkeys([*(w for w in sorted(clean, key=lambda w: -known[w])[:NEGATIVES] if known[w] > model.floor), *hard]))[: 2 * NEGATIVES]
        alike = [w for w in sorted(only, key=lambda w: (-up[w], w)) if known[w] > 0 and up[w] > 1][:NEGATIVES]
    apart = sorted({w for _, found in kept_apart for w in found})
    known.update(zip(apart, model.decide(apart).tolist(), strict=True))
    worst = np.array([max((known[w] for w in found), default=model.floor) for _, found in kept_apart])
    # A witness is a text of its own, too: few texts hold just one of the rarer ones.
    worst = np.concatenate([worst, [known[w] for w in sure]])
    toxic = np.array([t for t, _ in kept_apart] + [True] * len(sure), bool)
    return Model(model.weights, model.bias, *_curve(worst, toxic))


def trained(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_remainder: int = 1) -> Model:
    """Fit on a sample of the labelled documents outside the held-out fold.

    At most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled ids, in the order of a
    hash, and of their different texts up to ``SAMPLE_BYTES`` bytes at most twice as
    many as of ids, in the order of a hash of id and words. Null labels, ids or texts
    are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", modulus) != held_remainder))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    up, down = (
        least_hashed(known.filter(F.col("toxic") == side), want, counts.get(side, 0), "doc_id")
        for side, want in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    )
    chosen = up.unionByName(down)
    chosen = small_table(chosen.select(F.col("doc_id").alias("__doc"), "toxic"))
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES).join(chosen, F.col("doc_id") == F.col("__doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(fragments(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "toxic", "found"])

    table = (
        rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("toxic", T.IntegerType()), T.StructField("found", T.StringType())]))
        .distinct()
        .orderBy(F.xxhash64("doc_id", "found"), "doc_id", "found")
        .limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN))
        .toArrow()
    )
    # One object per word, however many texts hold it: the driver keeps the words of all of them.
    texts = [(t.as_py() == 1, set(map(sys.intern, f.as_py().split()))) for t, f in zip(table["toxic"], table["found"], strict=True)]
    del table
    return fit(texts)


_decided: dict[str, float] = {}
_decided_by: list[int] = []


def _decisions(model: Model, texts: list[str | None]) -> np.ndarray:
    """Worst decision value of each text; words' values are kept for a worker's later texts."""
    key = hash((model.weights.tobytes(), model.bias))
    if _decided_by != [key] or len(_decided) > CACHE_WORDS:
        _decided.clear()
        _decided_by[:] = [key]
    found = [fragments(t) for t in texts]
    missing = sorted({w for words in found for w in words if w not in _decided})
    for at in range(0, len(missing), 50_000):
        part = missing[at : at + 50_000]
        _decided.update(zip(part, model.decide(part).tolist(), strict=True))
    return np.array([max(map(_decided.__getitem__, words), default=model.floor) for words in found])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` and the probability that each whole text is toxic; a column of that name is replaced.

    Null and empty texts have the score of a text without any insult. A row needs
    no other row; repeated rows get equal scores.
    """
    docs = docs.drop(score_col)
    text_at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = model.probability(_decisions(model, part.column(text_at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with their columns."""
    scored = with_score(docs, model, score_col="__toxicity")
    return scored.filter(F.col("__toxicity") < threshold).drop("__toxicity")
