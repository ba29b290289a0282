"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import nothing_remembered

TOKEN = re.compile(r"\w+")
#: Shortest tile in tokens; share of an item's tokens that tiles must cover; items that one pass holds at most, and their characters.
MIN_MATCH, COVERAGE, ITEMS, ITEM_CHARS = 5, 0.5, 20_000, 8_000_000
_MASK = (1 << 61) - 1
_BASE = 1_000_003


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return TOKEN.findall((text or "").lower())


def _rolling(ids: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(position, Karp-Rabin hash) of each window of ``size`` ids."""
    if len(ids) < size:
        return
    h, top = 0, pow(_BASE, size - 1, _MASK)
    for x in ids[:size]:
        h = (h * _BASE + x + 1) % _MASK
    yield 0, h
    for k in range(size, len(ids)):
        h = ((h - (ids[k - size] + 1) * top) * _BASE + ids[k] + 1) % _MASK
        yield k - size + 1, h


def tiles(a: list[int], b: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id lists: (start in a, start in b, length), none overlapping in either.

    In each round the longest matches of unmarked ids become tiles, down to ``least`` ids. The search
    length halves from the longest possible one; at each length running Karp-Rabin hashes of the
    unmarked windows of ``b`` are looked up from those of ``a``, and hits are compared and extended. Of a match
    that a longer tile overlaps, the free parts wait for their own turn.
    """
    out: list[tuple[int, int, int]] = []
    free_a, free_b = [True] * len(a), [True] * len(b)
    size = max(least, min(len(a), len(b)))
    while True:
        table = defaultdict(list)
        for at, h in _rolling(b, size):
            if all(free_b[at : at + size]):
                table[h].append(at)
        found = []
        for at, h in _rolling(a, size) if table else ():
            if h in table and all(free_a[at : at + size]):
                for to in table[h]:
                    if at and to and a[at - 1] == b[to - 1] and free_a[at - 1] and free_b[to - 1]:
                        continue  # the end of a match that was found one place earlier
                    n = 0
                    while at + n < len(a) and to + n < len(b) and a[at + n] == b[to + n] and free_a[at + n] and free_b[to + n]:
                        n += 1
                    if n >= size:
                        found.append((-n, at, to))
        longest = max((-x[0] for x in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        heapify(found)
        while found:
            n, at, to = heappop(found)
            free = [p and q for p, q in zip(free_a[at : at - n], free_b[to : to - n], strict=True)]
            if all(free):
                out.append((at, to, -n))
                free_a[at : at - n] = free_b[to : to - n] = [False] * -n
                continue
            # What other tiles have left of it is matched in its turn.
            k = 0
            for whole, run in groupby(free):
                m = len(list(run))
                if whole and m >= size:
                    heappush(found, (-m, at + k, to + k))
                k += m
        if size == least:
            return sorted(out, key=lambda x: x[1])
        size = max(least, size // 2)


class Items:
    """A bounded block of test items, indexed by the hashes of their windows of ``least`` tokens.

    An item of fewer tokens is one window, unless ``short`` is false: then it is left out.
    """

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_MATCH, short: bool = True):
        self.least, self.vocabulary, self.ids, self.names = least, {}, [], []
        for name, text in items:
            words = tokens(text)
            if words and (short or len(words) >= least):
                self.ids.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
                self.names.append(name)
        seeds, owners = [], []
        for k, ids in enumerate(self.ids):
            found = set(self.hashes(np.array(ids, np.int64), min(least, len(ids))).tolist())
            seeds += found
            owners += [k] * len(found)
        order = np.argsort(np.array(seeds, np.uint64), kind="stable")
        self.seeds, self.owners = np.array(seeds, np.uint64)[order], np.array(owners, np.int64)[order]
        self.lengths = sorted({min(least, len(x)) for x in self.ids})

    @staticmethod
    def hashes(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        h = np.full(max(n, 0), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + max(n, 0)].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
        return h

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items that share a window of ``least`` tokens (or all of their tokens, if fewer) with a document."""
        found: set[int] = set()
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for size in self.lengths:
            whole = np.nonzero(known[size:] - known[:-size] == size)[0] if len(ids) >= size else ()
            if len(whole):
                h = np.unique(self.hashes(ids, size)[whole])
                left, right = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
                for a, b in zip(left[left < right].tolist(), right[left < right].tolist(), strict=True):
                    found.update(self.owners[a:b].tolist())
        return sorted(found)

    def match(self, text: str | None, coverage: float) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item, covered share, tiles) of each item that ``text`` covers to ``coverage`` or more."""
        words = tokens(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        out = []
        for k in self.candidates(ids):
            item = self.ids[k]
            # Tokens that the item lacks match nothing: runs of them shrink to one, which keeps matches apart.
            inside = np.isin(ids, item)
            keep = inside | np.concatenate(([True], inside[:-1]))
            place = np.nonzero(keep)[0]
            got = tiles(np.where(inside, ids, -1)[place].tolist(), item, min(self.least, len(item)))
            share = sum(n for _, _, n in got) / len(item)
            if share >= coverage:
                out.append((self.names[k], share, [(int(place[a]), b, n) for a, b, n in got]))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, streamed to the driver by id."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").dropDuplicates().toLocalIterator()
    block, chars = [], 0
    for row in rows:
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
        if len(block) >= ITEMS or chars >= ITEM_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """(doc_id, item_id, coverage, tiles): document and test item of which the document covers ``coverage`` or more.

    ``tiles`` lists (start in the document, start in the item, length) in tokens. Test items are the
    query set: they go to the executors in blocks of at most 20,000 items and 8 million characters,
    and all documents run against each block, where they lie; no document is shuffled or cut short.
    Null and empty texts match nothing; repeated rows and items with one text under several ids give
    repeated rows, empty tables none. An item of fewer tokens than ``least`` counts where all of it
    stands. Other columns of ``docs``, whatever their names, play no part.
    """
    out = None
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Items(block, least))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items = sent.value
            nothing_remembered("decontamination")
            for b in batches:
                rows = [(i, *x) for i, t in zip(b["doc_id"].astype("Int64"), b["text"], strict=True) if isinstance(t, str) for x in items.match(t, coverage)]
                yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "item_id": pd.array([r[1] for r in rows], "Int64"), "coverage": np.array([r[2] for r in rows], np.float64), "tiles": pd.Series([[list(x) for x in r[3]] for r in rows], dtype=object)})

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, item_id long, coverage double, tiles array<array<int>>")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, tiles array<array<int>>")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH) -> DataFrame:
    """``docs`` without those that ``contaminated`` finds for an item of ``least`` tokens or more, each judged by its own whole text.

    Shorter items, such as "yes", are reported by ``contaminated`` but say too little to drop a document.
    Rows with null or empty texts stay, repeated rows stay or go alike, and of an empty table nothing
    is left. All columns stay, whatever their names.
    """
    def leaks(items: Broadcast):
        @F.pandas_udf("boolean")
        def found(text: pd.Series) -> pd.Series:
            nothing_remembered("decontamination")
            return pd.Series([bool(isinstance(t, str) and items.value.match(t, coverage)) for t in text])

        return found("text")

    out = docs
    for block in _blocks(benchmark):
        out = out.where(~leaks(docs.sparkSession.sparkContext.broadcast(Items(block, least, short=False))))
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it contains, with the share of the item that is covered and the tiles' number."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"))
