"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words; a word's units are itself and its beginnings of 4 to 6 letters. The
log-odds of a unit between toxic and clean labelled texts have a Dirichlet prior whose
shape is the unit's frequency in the whole corpus. The signed root of the likelihood ratio
of its two counts tells chance from use; it is finite for units that one side never holds,
where a standard error of the log-odds isn't. A word scores by its surest unit, less a drift that makes
clean text lose. A linear scan (Ruzzo and Tompa) yields all maximal segments of a text;
the scale of their scores under clean text is that of an extreme-value distribution
(Karlin and Altschul), so a segment has an expected number of equals by chance in a text
of that length. What a text's significant segments hold together becomes a score between
0 and 1 by a logistic curve, fitted on labelled texts that the log-odds haven't seen.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swelter.llm.common import cols, hidden, scratch, written

WORD = re.compile(r"[^\W\d_]+")
#: Fixed value: marks that often stand around a word.
AROUND = ".,;:!?\"'()[]"
PREFIXES = (4, 5, 6)
#: Weight of the prior, and least signed root of a unit's likelihood ratio.
PRIOR, LEAST_Z = 500.0, 4.0
#: Subtracted from each word's score.
DRIFT = 0.75
#: Segments expected this often or less by chance in their text are significant.
LEAST_E = 0.01
FOLDS = 5
#: Labels that a model is fitted on at most.
FIT_LABELS = 60_000
#: Tokens between spaces that a task remembers, and the longest such token.
MEMO_TOKENS, MEMO_CHARS = 500_000, 100


def units_of(word: str) -> list[str]:
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


def head_of(unit: str) -> str:
    """What a word shares with each of its units."""
    return unit.rstrip("*")[: PREFIXES[0]]


def words_in(token: str) -> list[str]:
    """WORD's matches in a token without spaces, the usual case without the pattern."""
    inner = token.strip(AROUND)
    return [inner] if inner.isalpha() else WORD.findall(token)


def word_counts(texts: Iterable[str | None]) -> Counter[str]:
    """Words of lower-cased texts. No word spans a space, so equal tokens are looked at once."""
    tokens: Counter[str] = Counter()
    for text in texts:
        tokens.update((text or "").lower().split())
    words: Counter[str] = Counter()
    for token, n in tokens.items():
        for word in words_in(token):
            words[word] += n
    return words


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in one pass over the scores."""
    held: list[list[float]] = []  # first, end, sum before, sum at the end
    total = 0.0
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    # runs of positive scores and what lies between them
    breaks = np.flatnonzero(np.diff(at) > 1)
    firsts, ends = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + 1
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for first, end in zip(firsts.tolist(), ends.tolist()):
        new = [first, end, float(sums[first]), float(sums[end])]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j = int(held[j][4])
            if j < 0 or held[j][3] >= new[3]:
                # link: the next segment before it with a smaller sum before
                held.append([*new, j])
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    del total
    return [(int(a), int(b), r - l) for a, b, l, r, _ in held]


class TokenScores(dict):
    """token: the scores of its words, computed when first asked for."""

    def __init__(self, weights: dict[str, tuple[float, float]]):
        self.weights, self.heads, self.clean = weights, {head_of(u) for u in weights}, (-DRIFT,)

    def __missing__(self, token: str) -> tuple[float, ...]:
        words = words_in(token)
        if len(words) == 1 and words[0][: PREFIXES[0]] not in self.heads:
            got = self.clean
        else:
            got = tuple(map(self.of, words))
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO_TOKENS:
                self.clear()
            self[token] = got
        return got

    def of(self, word: str) -> float:
        if word[: PREFIXES[0]] not in self.heads:
            return -DRIFT
        return max((self.weights[u] for u in units_of(word) if u in self.weights), key=lambda w: abs(w[1]), default=(0.0, 0.0))[0] - DRIFT


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]  # unit: log-odds, surety
    rate: float = 1.0  # lambda of the extreme-value distribution
    search_space: float = 0.1  # K
    curve: tuple[float, float] = (-2.0, 1.0)
    memo: TokenScores | None = field(default=None, repr=False, compare=False)

    def scores(self, text: str | None) -> np.ndarray:
        if self.memo is None:
            self.memo = TokenScores(self.weights)
        tokens = (text or "").lower().split()
        return np.fromiter(itertools.chain.from_iterable(map(self.memo.__getitem__, tokens)), dtype=np.float64)

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float, float]]]:
        """-log of the chance of the text's best segment, and (first, end, score, e) of the significant ones.

        The best segment's extreme-value p-value is 1 - exp(-K n exp(-rate score)); each
        further significant segment adds what it exceeds its own threshold by.
        """
        rated = [(a, b, s, self.search_space * max(n, 1) * math.exp(-self.rate * s)) for a, b, s in found]
        best = min((e for *_, e in rated), default=None)
        if best is None:
            return 0.0, []
        surety = -math.log(max(1e-300, -math.expm1(-best)))
        strong = [x for x in rated if x[3] <= LEAST_E]
        more = sorted(math.log(LEAST_E / max(x[3], 1e-300)) for x in strong)[:-1]
        return surety + sum(more), strong

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        s = self.scores(text)
        x, strong = self.evidence(segments(s), len(s))
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * math.log1p(x))))), strong


def _counts(texts: DataFrame, only: set[str] | None = None) -> DataFrame:
    """(toxic, unit, n): units of texts (toxic, text), counted in batches, then by Spark."""
    heads = None if only is None else {head_of(u) for u in only}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for toxic, group in b.groupby("toxic")["text"]:
                words = word_counts(group)
                units: Counter[str] = Counter()
                units[""] = sum(words.values())  # all tokens
                for word, n in words.items():
                    if heads is not None and word[: PREFIXES[0]] not in heads:
                        continue
                    for u in units_of(word):
                        if only is None or u in only:
                            units[u] += n
                yield pd.DataFrame({"toxic": toxic, "unit": list(units), "n": list(units.values())})

    return texts.mapInPandas(count, "toxic int, unit string, n long").groupBy("toxic", "unit").agg(F.sum("n").alias("n"))


def likelihood_root(t: Column, n_t: int, c: Column, n_c: int) -> Column:
    """Signed root of the likelihood ratio of t of n_t and c of n_c against one rate; about normal by chance."""
    rate = (t + c) / F.lit(float(n_t + n_c))
    part = lambda y, n: F.when(y > 0, y * F.log(y / (F.lit(float(n)) * rate))).otherwise(0.0)
    return F.signum(t / F.lit(float(n_t)) - c / F.lit(float(n_c))) * F.sqrt(F.greatest(F.lit(0.0), 2 * (part(t, n_t) + part(c, n_c))))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows of docs: weights on three folds of four, the curve on the fourth.

    labels: (key, label 0/1); other values and nulls take no part. Of more than FIT_LABELS
    labels those with the smallest hashes of their keys are used; so many can be
    broadcast, and texts stay where they are. The prior's shape counts every text of docs.
    What reaches the driver is bounded by them too: the units that they tell apart by
    LEAST_Z, which takes several occurrences of each, and two numbers for each text of the
    fourth fold.
    """
    with scratch(docs.sparkSession):
        return _fitted(docs, labels, key, text, label)


def _fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Model:
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("_key"), "_key", "toxic").limit(FIT_LABELS)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(marked), "_key")
    rows = rows.withColumn("held", F.pmod(F.crc32(F.concat(F.lit("curve "), F.col("_key").cast("string"))), F.lit(4)) == 0)
    counts = written(_counts(rows.where("not held").select("toxic", "text")), "units")
    wide = counts.groupBy("unit").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    totals = wide.where("unit = ''").select("t", "c").collect()
    if not totals or not totals[0].t or not totals[0].c:
        return Model({})
    n_t, n_c = totals[0]
    drawn = wide.where("unit <> ''").withColumn("z", likelihood_root(F.col("t"), n_t, F.col("c"), n_c)).where(F.abs("z") >= LEAST_Z)
    drawn = drawn.select("unit", "t", "c", "z").collect()
    everything = _counts(docs.select(F.lit(0).alias("toxic"), F.col(text).alias("text")), {r.unit for r in drawn})
    corpus = {r.unit: r.n for r in everything.collect()}
    weights = {}
    for unit, t, c, z in drawn:
        prior = PRIOR * (corpus.get(unit, 0) + 1) / (corpus.get("", 0) + 1)
        odds = lambda y, n: math.log((y + prior) / max(n + PRIOR - y - prior, 1e-9))  # noqa: B023, E731
        weights[unit] = (odds(t, n_t) - odds(c, n_c), z)
    return calibrated(Model(weights), rows.where("held").select("toxic", "text"))


def calibrated(model: Model, rows: DataFrame) -> Model:
    """Sets the extreme-value parameters and the curve from rows (toxic, text), a bounded number.

    The texts are written and read twice: for the distribution of word scores and of the
    best segments, which give the rate and K, and then for each text's evidence by these.
    """
    rows = written(rows, "curve-texts")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, bins = [], Counter()
            for toxic, text in zip(b["toxic"], b["text"]):
                s = model.scores(text)
                out.append((toxic, len(s), max((x[2] for x in segments(s)), default=None)))
                if not toxic:
                    bins.update(np.round(s, 2).tolist())
            yield pd.DataFrame({"toxic": [o[0] for o in out], "n": [o[1] for o in out], "best": pd.array([o[2] for o in out], dtype="Float64"), "score": None, "times": None})
            yield pd.DataFrame({"toxic": -1, "n": 0, "best": None, "score": list(bins), "times": list(bins.values())})

    seen = written(rows.mapInPandas(measure, "toxic int, n long, best double, score double, times long"), "calibration")
    scale = seen.where("toxic = -1").groupBy("score").agg(F.sum("times").alias("n")).collect()
    model.rate = _rate([(r.score, r.n) for r in scale])
    best = F.exp(-model.rate * F.col("best")) * F.col("n")
    clean = seen.where("toxic = 0 and best is not null and n > 0").agg(F.count("*").alias("m"), F.sum(best).alias("s")).first()
    # maximum likelihood of K at that rate: the mean of n exp(-rate best) is 1 / K
    if clean.m:
        model.search_space = min(1.0, clean.m / max(1e-12, clean.s)) if clean.m > 20 else 0.1

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [model.scores(t) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "x": [model.evidence(segments(s), len(s))[0] for s in scores]})

    texts = rows.mapInPandas(evidence, "toxic int, x double").collect()
    model.curve = _logistic(np.array([math.log1p(r.x) for r in texts]), np.array([float(r.toxic) for r in texts]))
    return model


def _rate(scores: list[tuple[float, int]]) -> float:
    """The positive solution of sum p(s) exp(rate s) = 1."""
    total = sum(n for _, n in scores)
    if not total or max(s for s, _ in scores) <= 0:
        return 1.0
    top = max(s for s, _ in scores)
    value = lambda x: sum(n / total * math.exp(x * (s - top)) for s, n in scores) - math.exp(-x * top)
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if value(mid) > 0 else (mid, high)
    return max(0.05, high)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge, so that separable data end too."""
    if not len(x) or y.min() == y.max():
        return -2.0, 1.0
    X, w = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (p - y) + 0.01 * w
        H = (X * (p * (1 - p))[:, None]).T @ X + 0.01 * np.eye(2)
        step = np.linalg.solve(H, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 1e-6))


PASSAGES = "array<struct<first_word int, end_word int, score double, expected double>>"


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `_score` and `_passages`, the significant toxic segments in word places.

    Whole texts, row by row. Null and empty texts have no segment and the lowest score.
    Columns of docs with these two names are replaced, others stay whatever they are called.
    """

    @F.pandas_udf(f"score double, passages {PASSAGES}")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("first_word", "end_word", "score", "expected")
        for texts in batches:
            got = [model.score(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in got], "passages": [[dict(zip(names, p)) for p in found] for _, found in got]})

    docs, back = hidden(docs.drop("_score", "_passages"), ("_t",))
    out = docs.withColumn("_t", score(F.col(text)))
    return out.select(*cols(docs.columns), F.col("_t.score").alias("_score"), F.col("_t.passages").alias("_passages")).withColumnsRenamed(back)
