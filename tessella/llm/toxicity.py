"""Toxic documents by a subsequence string-kernel support vector machine.

The kernel compares two strings by their common subsequences of three characters, each weighed by
a decay to the power of the span it takes (Lodhi et al., 2002), so that gaps and inserted
characters cost little. A machine over kernel values to Nystroem landmarks is linear in the
kernel's feature space; once trained it folds into one weight per character triple, and a unit is
scored without visiting the landmarks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import give_back, held_out, remembered

#: Longest unit; steps between the windows of longer ones; decay; documents of each label that training samples (about).
WINDOW, STEP, DECAY, SAMPLE = 16, 8, 0.6, 2000
ALPHABET, GAP = 32, 29
#: Triples of a-z and digits have a number each, below ALPHABET**3; those with other letters are hashed to the rest.
FEATURES = 1 << 17
THRESHOLD = 0.3
#: Single characters in a row, as in a spelled-out word.
SPELLED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S){2,}(?!\S)")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@lru_cache(maxsize=100_000)
def _code(ch: str) -> int:
    base, *marks = unicodedata.normalize("NFD", ch)
    if "a" <= base <= "z":
        return ord(base) - 96
    if base.isdigit():
        return 27
    if base.isalpha():
        return ALPHABET + ord(base if all(map(unicodedata.combining, marks)) else ch)  # a Hangul syllable is one letter
    # Vowel signs spell words; accents that stand alone don't.
    return ALPHABET + ord(ch) if unicodedata.category(ch)[0] == "M" and not unicodedata.combining(ch) else GAP


def units(text: str) -> set[str]:
    """The words of a text, lower-cased and freed of outer punctuation, cut into overlapping windows if long; and spelled-out words."""
    low = text.lower()
    found = {w.strip(_EDGE) for w in set(low.split())}
    found.update(re.sub(r"\s", "", m.group()) for m in SPELLED.finditer(low))
    for w in [w for w in found if len(w) > WINDOW]:
        found.discard(w)
        found.update(w[k : k + WINDOW] for k in range(0, len(w) - STEP, STEP))
    found.discard("")
    return found


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def _grouped(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of the words of each length of three or more."""
    by = defaultdict(list)
    for k, w in enumerate(words):
        if len(w) >= 3:
            by[len(w)].append(k)
    for places in by.values():
        for at in range(0, len(places), 1024):
            some = places[at : at + 1024]
            yield np.array(some), np.array([[_code(c) for c in words[k]] for k in some], np.int64)


def _index(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and weight of each triple of each word. Characters that are neither letters nor digits only widen spans."""
    at, weight = _triples(codes.shape[1])
    mark = codes == GAP
    counts = ~(mark[:, at[:, 0]] | mark[:, at[:, 1]] | mark[:, at[:, 2]])
    a, b, c = codes[:, at[:, 0]], codes[:, at[:, 1]], codes[:, at[:, 2]]
    index = (a * ALPHABET + b) * ALPHABET + c
    if (codes >= ALPHABET).any():
        h = ((a << 42) | (b << 21) | c).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        other = ALPHABET**3 + ((h >> np.uint64(32)) % np.uint64(FEATURES - ALPHABET**3)).astype(np.int64)
        index = np.where((a < ALPHABET) & (b < ALPHABET) & (c < ALPHABET), index, other)
    return index, weight * counts


def _norms(codes: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each word with itself, by dynamic programming."""
    b, n = codes.shape
    same = ((codes[:, :, None] == codes[:, None, :]) & (codes != GAP)[:, None, :]).astype(np.float64) * DECAY**2
    inner = np.ones((b, n + 1, n + 1))
    for _ in range(2):
        row, new = np.zeros((b, n + 1, n + 1)), np.zeros((b, n + 1, n + 1))
        for j in range(1, n + 1):
            row[:, 1:, j] = DECAY * row[:, 1:, j - 1] + same[:, :, j - 1] * inner[:, :-1, j - 1]
        for i in range(1, n + 1):
            new[:, i] = DECAY * new[:, i - 1] + row[:, i]
        inner = new
    return np.sqrt(np.maximum((same * inner[:, :-1, :-1]).sum((1, 2)), 1e-30))


class Model:
    """Triple weights and the calibration of a document's score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 4.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for places, codes in _grouped(words):
            index, weight = _index(codes)
            out[places] += (self.weights[index] * weight).sum(1) / _norms(codes)
        return out

    def probability(self, margin: float) -> float:
        """Logistic in the document's largest margin; the decision threshold on margins maps to THRESHOLD."""
        z = self.slope * (margin - self.shift) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, words by landmarks."""
    table = np.zeros((FEATURES, len(landmarks)), np.float32)
    for places, codes in _grouped(landmarks):
        index, weight = _index(codes)
        for p, row, some, norm in zip(places, index, weight, _norms(codes), strict=True):
            np.add.at(table[:, p], row, some / norm)
    out = np.zeros((len(words), len(landmarks)))
    for places, codes in _grouped(words):
        index, weight = _index(codes)
        norm = _norms(codes)
        for at in range(0, len(places), 64):
            out[places[at : at + 64]] = (weight[at : at + 64, None, :] @ table[index[at : at + 64]])[:, 0] / norm[at : at + 64, None]
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge losses, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(25):
        a, c = x1[active], 2 * cost[active]
        w = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _ngrams(w: str) -> set[str]:
    return {w[k : k + n] for n in (4, 5) for k in range(len(w) - n + 1)} or {w}


def _telling(pos: list[set[str]], neg: list[set[str]]) -> set[str]:
    """Character groups that positive documents hold at ten times the rate of negative ones, beyond chance (likelihood ratio)."""
    p, n = Counter(), Counter()
    for docs, counts in ((pos, p), (neg, n)):
        for u in docs:
            counts.update({g for w in u for g in _ngrams(w)})
    share, found = len(pos) / (len(pos) + len(neg)), set()
    for g, c in p.items():
        d = n[g]
        if c * len(neg) >= 10 * (d + 0.1) * len(pos):
            ratio = c * np.log(c / ((c + d) * share)) + (d * np.log(d / ((c + d) * (1 - share))) if d else 0)
            if 2 * ratio >= 25:
                found.add(g)
    return found


def train(samples: list[tuple[int, set[str]]], landmarks: int = 240, rounds: int = 2, seed: int = 5) -> Model:
    """Learns from (label, units) of documents: a positive document has an offending unit, a negative one has none.

    First positives are the units with a character group that tells positive documents. Then, in
    rounds, a machine is trained; positive documents without a positive unit give the one that it
    scores highest, and negative units that it scores high join the negatives. A machine sees the 3,000
    commonest negative units, 5,000 of the others, 3,000 high-scoring ones a round, and the 2,500
    commonest positive ones.
    """
    pos, neg = [u for y, u in samples if y and u], [u for y, u in samples if not y and u]
    if not pos or not neg:
        return Model(np.zeros(FEATURES), 0.0, shift=0.5 if not pos else -0.5)
    telling = _telling(pos, neg)
    vocabulary = sorted(set().union(*pos, *neg))
    number = {w: k for k, w in enumerate(vocabulary)}
    bags = [np.array(sorted(number[w] for w in u)) for u in pos + neg]
    y = np.array([1] * len(pos) + [0] * len(neg))
    clean = Counter(w for u in neg for w in u)
    marked = Counter(w for u in pos for w in u if w not in clean and telling & _ngrams(w))
    rng = np.random.default_rng(seed)
    common = [w for w, _ in clean.most_common(3000)]
    rest = sorted(set(clean) - set(common))
    negatives = common + [rest[k] for k in rng.permutation(len(rest))[:5000]]
    model, margins, extra = None, None, Counter()
    for _ in range(rounds + 1):
        hard = negatives
        if model is not None:
            extra = Counter()
            for u, bag in zip(pos, bags, strict=False):
                if not any(w in marked for w in u):
                    best = bag[np.argmax(margins[bag])]
                    if margins[best] > 0:
                        extra[vocabulary[best]] += 1
            rival = [w for w in clean if margins[number[w]] > -0.9]
            hard = sorted(rival, key=lambda w: -margins[number[w]])[:3000]
            negatives = sorted(set(negatives) | set(hard))
        weighed = marked + extra
        positives = [w for w, _ in weighed.most_common(2500) if w not in clean]
        if not positives:
            positives = [max(pos[0], key=len)]
        spread = [positives[k] for k in np.linspace(0, len(positives) - 1, min(len(positives), landmarks // 4)).astype(int)]
        marks = list(dict.fromkeys(positives[: landmarks // 4] + spread + hard[: landmarks // 4] + common[: landmarks // 4]))
        k, gram = _kernel(positives + negatives, marks), _kernel(marks, marks)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        sign = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
        seen = np.array([weighed[w] for w in positives] + [clean[w] for w in negatives], np.float64)
        cost = 20 * np.sqrt(np.maximum(seen, 1)) * np.where(sign > 0, np.clip(len(negatives) / len(positives) / 20, 1, 20), 1.0)
        w, bias = _machine(k @ root, sign, cost)
        alpha = root @ w
        weights = np.zeros(FEATURES)
        for places, codes in _grouped(marks):
            index, weight = _index(codes)
            for at, row, some, norm in zip(places, index, weight, _norms(codes), strict=True):
                np.add.at(weights, row, alpha[at] * some / norm)
        model = Model(weights, bias)
        margins = model.margins(vocabulary)
    top = np.array([margins[bag].max() for bag in bags])
    order = np.argsort(-top)
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + len(pos))
    cut = int(np.argmax(f1))
    model.shift = float((top[order[cut]] + top[order[min(cut + 1, len(y) - 1)]]) / 2)
    return model


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[int, set[str]]]:
    """Units of about ``size`` documents of each label, none of them held out, chosen by a hash of their ids.

    A document labelled more than once counts as toxic if any label says so. The sample is bounded
    in expectation and by ``limit``, whatever the tables' sizes.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    odds = F.lit(0.0)
    for label, n in counts.items():
        odds = F.when(F.col("label") == label, min(1.0, size / n)).otherwise(odds)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < odds * 1_000_000).limit(4 * size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "units": [sorted(units(t)) for t in b["text"]]})

    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = got.mapInPandas(run, "doc_id long, label int, units array<string>").orderBy("doc_id", "units").toLocalIterator()
    one: dict[str, str] = {}  # each different unit is held once
    return [(r["label"], {one.setdefault(w, w) for w in r["units"]}) for r in rows]


def scorer(spark: SparkSession, model: Model, most: int = 200_000):
    """A function of a text column that gives the score of each whole text. Margins of units are remembered by each worker."""
    sent = spark.sparkContext.broadcast(model)
    give_back()  # what the driver learned from
    stamp = hash(model.weights.tobytes())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, known = sent.value, remembered(("toxicity", stamp), dict)
        out = np.empty(len(texts))
        empty = model.probability(min(model.bias, model.shift - 1))
        for at in range(0, len(texts), 512):
            bags = [units(t) if isinstance(t, str) else () for t in texts.iloc[at : at + 512]]
            if len(known) > most:
                known.clear()
            new = [w for w in set().union(*bags) if w not in known]
            for k in range(0, len(new), 32_768):
                known.update(zip(new[k : k + 32_768], model.margins(new[k : k + 32_768]).tolist(), strict=True))
            for k, bag in enumerate(bags):
                out[at + k] = model.probability(max(map(known.__getitem__, bag))) if bag else empty
        give_back()
        return pd.Series(out)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    A document's score comes from its most offending unit, so its length neither hides nor adds to
    it. Null and empty texts score low. Without labels of both kinds nothing is found toxic. Repeated
    rows score alike, an empty table gives no rows, and columns other than id and text play no part.
    """
    score = scorer(docs.sparkSession, train(sample(docs, labels)))
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score reaches the threshold. Null and empty texts stay, repeated rows stay or go alike; all columns stay, whatever their names."""
    score = scorer(docs.sparkSession, train(sample(docs, labels)))
    return docs.where(score("text") < THRESHOLD)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
