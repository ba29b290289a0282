"""Language of a text by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import held_out

#: Bytes that the network reads in one go; hidden units a direction; characters of a training passage; passages of a language (about).
SPAN, HIDDEN, PASSAGE, SAMPLE = 128, 8, 160, 600
LETTER = re.compile(r"[^\W\d_]")
_PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two recurrent networks read a span of bytes, one from either end; a softmax over both states labels each position.

    A state follows  z = s(Wz[b] + Uz h),  r = s(Wr[b] + Ur h),  c = tanh(Wc[b] + r * (Uc h)),
    h' = h + z * (c - h).  Arrays are kept as (units, spans), so that gates are contiguous.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        shapes = {"V": (classes, 2 * hidden), "v": (classes, 1)}
        for d in "fb":
            shapes |= {f"W{d}": (3 * hidden, 257), f"U{d}": (3 * hidden, hidden), f"a{d}": (3 * hidden, 1)}
        self.p = {k: (rng.normal(0, 0.3, s) if k[0] in "WUV" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each of the T rows of bytes ``x`` (T, spans), in reading order."""
        n, u, w = self.hidden, self.p[f"U{d}"], self.p[f"W{d}"] + self.p[f"a{d}"]
        h = np.zeros((n, x.shape[1]), np.float32)
        states, trace = np.empty((len(x), n, x.shape[1]), np.float32), []
        for t in range(len(x)):
            wx, uh = w[:, x[t]], u @ h
            gates = wx[: 2 * n] + uh[: 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            c = uh[2 * n :] * r
            c += wx[2 * n :]
            np.tanh(c, out=c)
            if keep:
                trace.append((h, z, r, c, uh[2 * n :]))
            c_h = c - h
            c_h *= z
            h = h + c_h
            states[t] = h
        return states, trace

    def _read(self, d: str, x: np.ndarray) -> np.ndarray:
        """The states of ``_run``, in buffers used over and over; gates' halves are folded into the weights."""
        n, width = self.hidden, x.shape[1]
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), n)[:, None]
        u, w = self.p[f"U{d}"] * half, (self.p[f"W{d}"] + self.p[f"a{d}"]) * half
        states = np.empty((len(x) + 1, n, width), np.float32)
        states[0] = 0
        wx, uh, c = np.empty((3 * n, width), np.float32), np.empty((3 * n, width), np.float32), np.empty((n, width), np.float32)
        gates, z, r, wc, uc = wx[: 2 * n], wx[:n], wx[n : 2 * n], wx[2 * n :], uh[2 * n :]
        for t in range(len(x)):
            h = states[t]
            np.take(w, x[t], axis=1, out=wx, mode="clip")
            np.matmul(u, h, out=uh)
            gates += uh[: 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(uc, r, out=c)
            c += wc
            np.tanh(c, out=c)
            c -= h
            c *= z
            np.add(h, c, out=states[t + 1])
        return states[1:]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities (T, classes, spans) of each position of spans ``x`` (T, spans)."""
        forward, back = self._read("f", x), self._read("b", x[::-1])[::-1]
        n, v = self.hidden, self.p["V"]
        logits = np.empty((len(x), self.classes, x.shape[1]), np.float32)
        for t in range(len(x)):  # states lie within -1 and 1, so no exponential overflows
            now = v[:, :n] @ forward[t]
            now += v[:, n:] @ back[t]
            now += self.p["v"]
            now -= np.log(np.exp(now).sum(0))
            logits[t] = now
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        n, p = self.hidden, self.p
        forward, tf = self._run("f", x, True)
        back, tb = self._run("b", x[::-1], True)
        both = np.concatenate([forward, back[::-1]], 1)
        logits = np.matmul(p["V"], both) + p["v"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        prob = e / e.sum(1, keepdims=True)
        real = (x != _PAD).astype(np.float32)
        total = max(real.sum(), 1)
        spans = np.arange(x.shape[1])
        loss = float(-(np.log(prob[:, y, spans] + 1e-9) * real).sum() / total)
        prob[:, y, spans] -= 1
        d = prob * real[:, None, :] / total
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"] = np.einsum("tcs,tus->cu", d, both)
        g["v"] = d.sum((0, 2))[:, None]
        d_state = np.matmul(p["V"].T, d)
        for name, trace, xs, ds in (("f", tf, x, d_state[:, :n]), ("b", tb, x[::-1], d_state[::-1, n:])):
            u, dh = p[f"U{name}"], np.zeros((n, x.shape[1]), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                h, z, r, c, uc = trace[t]
                dh = dh + ds[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                d_in = np.concatenate([dz, dr, dc])
                d_u = np.concatenate([dz, dr, dc * r])
                g[f"U{name}"] += d_u @ h.T
                for k in range(3 * n):
                    g[f"W{name}"][k] += np.bincount(xs[t], d_in[k], 257)
                dh = dh * (1 - z) + u.T @ d_u
            g[f"a{name}"] = g[f"W{name}"].sum(1, keepdims=True)
        return loss, g


def _spans(raw: bytes) -> np.ndarray:
    """The bytes of a text in rows of SPAN, the last one padded."""
    n = -(-len(raw) // SPAN)
    out = np.full(n * SPAN, _PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, SPAN)


def train(samples: list[tuple[str, str]], epochs: int = 14, batch: int = 128, rate: float = 0.02, seed: int = 3) -> tuple[Network, list[str]]:
    """Learns from (language, text); Adam on batches of spans."""
    names = sorted({y for y, _ in samples})
    parts = [(_spans(t.encode("utf-8", "replace")), names.index(y)) for y, t in samples if t]
    if not parts:
        return Network(max(1, len(names))), names
    x = np.concatenate([s for s, _ in parts])
    y = np.concatenate([np.full(len(s), k) for s, k in parts])
    net, rng = Network(len(names), seed=seed), np.random.default_rng(seed)
    m, v, step = {k: 0 for k in net.p}, {k: 0 for k in net.p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            _, g = net.gradients(x[some].T.astype(np.int64), y[some])
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            step += 1
            for k in net.p:
                w = g[k] * min(1, 1 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * w, 0.99 * v[k] + 0.01 * w * w
                now = rate * (0.3 if epoch >= epochs * 2 // 3 else 1)
                net.p[k] = (net.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net, names


def sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """About ``size`` passages of each language, from documents that are not held out, chosen by a hash of their ids.

    A passage is PASSAGE characters from somewhere in its document. The sample bounds what reaches
    the driver; prediction reads whole texts.
    """
    known = docs.where("lang is not null and text is not null").where(~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    odds = F.lit(0.0)
    for lang, n in counts.items():
        odds = F.when(F.col("lang") == lang, min(1.0, size / n)).otherwise(odds)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < odds * 1_000_000)
    room = F.greatest(F.lit(1), F.length("text") - PASSAGE + 1)
    text = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(19)), room).cast("int") + 1, F.lit(PASSAGE))
    rows = chosen.select("lang", text.alias("text"), F.xxhash64("doc_id", "text").alias("h")).limit(2 * size * max(1, len(counts))).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["h"], r["lang"], r["text"]))]


def predict(net: Network, names: list[str], texts: list[str | None], most: int = 1024) -> list[tuple[str, float]]:
    """(language, probability) of each text. Position log-probabilities are averaged over the whole text, then normalised."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    sums, lengths = np.zeros((len(texts), max(1, len(names)))), np.zeros(len(texts))
    rows: list[np.ndarray] = []
    owner: list[int] = []
    live = [k for k, t in enumerate(texts) if names and isinstance(t, str) and LETTER.search(t)]

    def flush() -> None:
        x = np.concatenate(rows).T.astype(np.intp)
        at = np.array(owner)
        logs = net.positions(x)
        logs *= (x != _PAD)[:, None, :]
        np.add.at(sums, at, logs.sum(0).T)
        rows.clear()
        owner.clear()

    held = 0
    for k in live:
        raw = texts[k].encode("utf-8", "replace")
        lengths[k] = len(raw)
        spans = _spans(raw)
        for at in range(0, len(spans), most):
            rows.append(spans[at : at + most])
            owner += [k] * len(rows[-1])
            held += len(rows[-1])
            if held >= most:
                flush()
                held = 0
    if rows:
        flush()
    for k in live:
        mean = sums[k] / lengths[k]
        e = np.exp((mean - mean.max()) * min(lengths[k], 32))
        best = int(np.argmax(mean))
        out[k] = (names[best], float(e[best] / e.sum()))
    return out


def language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs``.

    Texts that are null or hold no letter are ``und`` with score 0, as is everything if no row
    has a language to learn from. Long texts take time, not memory: spans pass in bounded batches.
    Repeated rows agree, an empty table gives no rows, and other columns play no part.
    """
    net, names = train(sample(docs))
    sent = docs.sparkSession.sparkContext.broadcast((net, names))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = predict(*sent.value, texts.tolist())
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    got = docs.select("doc_id", held_out().alias("held_out"), run("text").alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(spark.read.parquet(f"{sf_dir}/documents.parquet"))
