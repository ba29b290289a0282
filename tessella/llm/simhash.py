"""Near-duplicate documents by SimHash fingerprints."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import components, drop_saved, give_back, nothing_remembered, saved, shared_folder

BITS = 64
#: Shifts and widths of the six blocks that a fingerprint is cut into.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: For ``similar``: words of a shingle; Jaccard similarity of near copies; 64-bit words of a wide fingerprint, and how many of them are compared first; odds of missing a pair.
WORDS, SIMILARITY, LANES, CARRIED, ODDS = 5, 0.8, 8, 2, 0.00003
#: Tables that are shuffled at a time; sets under one key that a task compares pair by pair, and how many of them with the others at a time.
PASS, PAIRED, BLOCK = 16, 1 << 15, 64
#: What moves of a set for each table: its key, its size and its wide fingerprint.
ENTRY = np.dtype([("fp", "<i8"), ("n", "<i4"), ("print", "<u8", (LANES,))])
#: Shingles of a group, and those times its members, up to which a task verifies it alone; shingles that a task gets on average.
HELD, WORK, BIN = 1 << 22, 1 << 32, 1 << 19
#: Texts whose shingles a task holds at a time.
SLICE = 1024
#: In which ``prefix_pairs`` counts shingles: 8 MB.
BUCKETS = 1 << 20
#: Bits that tell most rows apart from those sought: 4 MB.
MARKS = 1 << 22


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, chunk: int = 65536) -> int:
    """The unsigned SimHash of the word shingles of ``text`` with A-Z lower-cased; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, chunk):
        spans = zip(starts[at : min(n, at + chunk)].tolist(), last[at : min(n, at + chunk)].tolist(), strict=True)
        h = np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, min(n, at + chunk) - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """(id, at, fp): the hash of each row's text, and its fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "at": b["at"], "fp": found.view(np.int64)})

    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("at"), F.col(text_column).alias("text")).mapInPandas(run, "id long, at long, fp long")


def _block(fp: Column, k: int) -> Column:
    shift, width = BLOCKS[k]
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, bits: int = 4, crowd: int = 256) -> DataFrame:
    """Edges (a, b) whose components are those of the graph of all fingerprints ``fp`` at ``bits`` (4) or fewer differing bits.

    Cut into six blocks, two fingerprints with at most four differing bits agree in two blocks at
    least; so each is entered under all fifteen pairs of its blocks, and an equality join of those
    entries proposes the pairs, whose Hamming distance is then verified. A pair is reported only
    under its first common pair of blocks.

    An entry with more than ``crowd`` members isn't paired off. Two fingerprints are at distance
    four or less exactly if some word is within two bits of both; so the members flip up to two
    bits outside their common blocks, and all that reach the same word are linked to the least of
    them. That takes rows in proportion to the members, and loses no connection.
    """
    if bits != 4:
        raise ValueError("six blocks and two flips fit four bits")
    tables = list(combinations(range(6), 2))
    key = lambda fp, t: F.shiftleft(_block(fp, tables[t][0]), 11).bitwiseOR(_block(fp, tables[t][1]))
    fp = F.col("fp")
    entries = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), key(fp, t).alias("k")) for t in range(len(tables))))).alias("e")).select("fp", "e.t", "e.k")
    full = entries.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1").select("t", "k", (F.col("n") > crowd).alias("crowded"))
    entries = saved(entries.join(full, ["t", "k"]), "simhash-entries")

    a, b = entries.where("not crowded").alias("a"), entries.where("not crowded").alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    clear = [_block(x, k) == 0 for k in range(6)]
    first = F.lit(len(tables))
    for t, (i, j) in reversed(list(enumerate(tables))):
        first = F.when(clear[i] & clear[j], t).otherwise(first)
    near = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= bits) & (first == F.col("a.t")))
    pairs = near.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    flips = []
    for i, j in tables:
        free = [1 << p for k in range(6) if k not in (i, j) for p in range(BLOCKS[k][0], sum(BLOCKS[k]))]
        masks = np.array([0, *free, *(p | q for p, q in combinations(free, 2))], np.uint64).view(np.int64)
        flips.append((i, j, [int(m) for m in masks]))
    spark = distinct.sparkSession
    masks = spark.createDataFrame([(t, m) for t, (_, _, m) in enumerate(flips)], "t int, masks array<long>")
    balls = entries.where("crowded").join(F.broadcast(masks), "t").select("t", "fp", F.explode("masks").alias("m")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
    least = balls.groupBy("t", "z").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").select("t", "z", "m")
    return pairs.union(balls.join(least, ["t", "z"]).where("fp <> m").select("fp", "m").distinct())


def groups(prints: DataFrame) -> DataFrame:
    """Adds to rows (id, fp, ...) ``component``, the least id that can be reached through links, and ``root``, which names the group.

    Copies fall together on their fingerprint first, so that links are sought between different
    fingerprints only.
    """
    least = saved(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    joined = components(links(least.select("fp")), "simhash-components")
    named = least.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(named.join(roots, "root").select("fp", "component", "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``; see the module's functions.

    Null texts count as empty ones; rows without words have fingerprint zero, and link with each
    other. Long texts are read whole, 65,536 shingles at a time. Repeated rows give repeated results,
    an empty table none. A component whose ids are all null has a null id. Other columns of ``docs``,
    whatever their names, play no part.
    """
    found = groups(saved(fingerprints(docs), "simhash-prints"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Ascending hashes of the different word shingles of ``text`` with A-Z lower-cased; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(size, len(words)) - 1 :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b]) for a, b in zip(starts.tolist(), last.tolist(), strict=False)), np.uint64, len(last)))


def _set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def wide_fingerprint(found: np.ndarray, lanes: int = LANES, chunk: int = 256) -> np.ndarray:
    """The SimHash of a set of shingle hashes in ``lanes`` 64-bit words.

    For each bit a shingle votes with one byte of its hash, and the bit is 1 if the votes are over half
    of what they could be. Votes of one bit (``fingerprint``) tie in sets of few shingles; sums of
    bytes are close to normal from four shingles on, so two sets of cosine c differ in a share of about
    acos(c) / pi of the bits, whatever their size.
    """
    salt = np.random.default_rng(42).integers(0, 1 << 63, lanes * 8, np.uint64)
    votes = np.zeros((2, lanes * 32), np.int64)
    low = np.uint64(0x00FF00FF00FF00FF)
    for at in range(0, len(found), chunk):
        h = (found[at : at + chunk, None] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        # Up to 256 bytes add up in 16 bits, four of them in a word.
        for k, x in enumerate((h & low, (h >> np.uint64(8)) & low)):
            votes[k] += x.sum(0, dtype=np.uint64).view(np.uint16)
    return np.packbits(2 * votes.ravel() > 255 * len(found), bitorder="little").view(np.int64)


def _differing(similarity: float) -> float:
    """The share of bits in which two sets of this Jaccard similarity differ at most: that of equally large ones, and a twentieth more.

    At 0.8 that is 0.159. Measured over 20,000 pairs each: 0.1517 for sets of 90, 0.1546 for sets of 9, 0.1578 for
    sets of 4 and 5, whose sums are the least normal.
    """
    return 1.05 * math.acos(2 * similarity / (1 + similarity)) / math.pi


def _binomial(n: int, p: float) -> np.ndarray:
    return np.array([math.comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(n + 1)])


def plan(texts: int, similarity: float = SIMILARITY, bits: int = 64 * LANES, odds: float = ODDS, seed: int = 43) -> np.ndarray:
    """Which bits of a wide fingerprint make the key of each table, for so many different sets.

    A table's key is of six bits, or as many more as leave 4,096 to 8,192 unrelated sets under it, and
    there are as many tables as let a pair of this similarity, which agrees in each bit with the same
    odds, miss all with ``odds`` at most. Up to 524,288 sets the number of tables stays the same.
    """
    width = min(32, max(6, math.ceil(math.log2(max(texts, 2))) - 13))
    share = _binomial(bits, _differing(similarity))
    hit = np.prod([np.maximum(bits - np.arange(bits + 1) - i, 0) / (bits - i) for i in range(width)], axis=0)
    count = 1
    while (share * (1 - hit) ** count).sum() > odds:
        count += 1
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(bits, width, replace=False) for _ in range(count)])


def reach(similarity: float = SIMILARITY, bits: int = 64 * CARRIED, odds: float = ODDS / 100) -> int:
    """The differing bits that a pair of this similarity exceeds with ``odds`` at most."""
    return int(np.argmax(np.cumsum(_binomial(bits, _differing(similarity))) >= 1 - odds))


def table_keys(prints: np.ndarray, chosen: np.ndarray, first: int = 0) -> np.ndarray:
    """One key a table of ``plan`` for each row of ``prints``, which are wide fingerprints as signed words; the tables count from ``first``."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    keys = np.arange(first, first + len(chosen), dtype=np.int64)[None, :].repeat(len(prints), 0)
    for at in chosen.T:
        keys = keys << 1 | bits[:, at]
    return keys


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least place of each place's group, after the groups of each pair of places have joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up


def near_groups(rows: np.ndarray, similarity: float, carried: int, most: int, paired: int = PAIRED) -> np.ndarray:
    """The least place of the group of each of ``rows`` (``ENTRY``); two of fitting sizes that differ in ``carried`` of the first bits and ``most`` of all at most are in one.

    All pairs are compared, those that are in one group already by the first bits alone. More than ``paired``
    rows are dealt out by tables of their own; where even these leave as many under one key, they are one group.
    """
    label = np.arange(len(rows))
    if len(rows) > paired:
        for keys in table_keys(rows["print"], plan(1, similarity, seed=44)).T:
            order = np.argsort(keys, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                own = near_groups(rows[part], similarity, carried, most, paired) if len(part) <= paired else np.zeros(len(part), np.int64)
                label = _merged(label, part, part[own])
        return label
    n, prints, words = rows["n"].astype(np.float64), rows["print"], [np.ascontiguousarray(rows["print"][:, k]) for k in range(CARRIED)]
    for at in range(0, len(rows), BLOCK):
        apart = sum(np.bitwise_count(w[at : at + BLOCK, None] ^ w[None, at:]) for w in words)
        a, b = np.nonzero(apart <= carried)
        a, b = a + at, b + at
        some = (a < b) & (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
        a, b = a[some], b[some]
        some = np.bitwise_count(prints[a] ^ prints[b]).sum(1, dtype=np.int64) <= most
        label = _merged(label, a[some], b[some])
    return label


def alike_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The least place of the group of each of ``sets``, whose elements differ; two of this Jaccard similarity or more are in one.

    A set's overlaps with all later ones are counted at once over the places where its elements recur.
    """
    label, n = np.arange(len(sets)), np.array([len(x) for x in sets])
    _, element, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, ends = np.repeat(label, n), np.cumsum(n)
    order = np.argsort(element, kind="stable")
    place, holders = np.empty(len(order), np.int64), owner[order]
    place[order] = np.arange(len(order))
    last = np.cumsum(seen)[element]
    for k in range(len(sets) - 1):
        if not label.any():
            break
        start = place[ends[k] - n[k] : ends[k]] + 1
        sizes = last[ends[k] - n[k] : ends[k]] - start
        runs = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        both = np.bincount(holders[runs], minlength=len(sets))
        found = np.flatnonzero(both >= similarity * (n[k] + n - both) - 1e-9)
        found = found[found > k]
        label = _merged(label, np.full(len(found), k), found)
    return label


def marked(wanted: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test of 64-bit keys, for Python workers: true for all of the ``key`` of ``wanted``, and for few others while these are a small part of ``MARKS``.

    With it large rows that can't be wanted are not shuffled to find that out. The driver and each worker hold the marks.
    """
    found = wanted.select(F.col("key").bitwiseAND(F.lit(MARKS - 1)).alias("at")).distinct().toArrow()["at"].to_numpy()
    marks = np.zeros(MARKS, bool)
    marks[found] = True
    shared = wanted.sparkSession.sparkContext.broadcast(marks)
    return lambda keys: shared.value[keys & (MARKS - 1)]


def prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float, folder: str = "similar") -> DataFrame:
    """Candidates (a, b) among ``members`` (fp, n, root): all pairs of different roots whose ``sets`` (fp, set) have this Jaccard similarity, and few others.

    Such a pair shares ``similarity`` of the larger set at least, so each set's rarest shingles, one
    more than it may miss, hold a common one. The first of these is early enough in both that what
    follows can still make up the overlap, in the smaller set earlier still; pairs that never are so
    early don't meet. Passages that many sets share are not among the rarest but of sets that hold
    little else.

    Shingles are ordered by how many fall in their one of ``BUCKETS`` buckets. Any order finds every
    pair, so that buckets shared by chance cost a few candidates at most, and the counts are of a
    fixed size whatever the input: the driver and each worker hold them.
    """
    parts = saved(members.join(sets, "fp"), f"{folder}/parts")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_remembered("near-duplicates")
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b["set"]:
                np.add.at(counts, x & (BUCKETS - 1), 1)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": at, "f": counts[at]})

    counted = parts.select("set").mapInPandas(tally, "bucket long, f long").groupBy("bucket").agg(F.sum("f").alias("f")).toArrow()  # a million rows as Python objects take hundreds of MB
    counts = np.zeros(BUCKETS, np.int64)
    counts[counted["bucket"].to_numpy()] = counted["f"].to_numpy()
    del counted
    give_back()
    shared = parts.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for b in batches:
            out = []
            for fp, root, x in zip(b["fp"], b["root"], b["set"], strict=True):
                often = f[x & (BUCKETS - 1)]
                order = np.lexsort((x, often))[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]
                # Shingles of one set alone come first, and find nothing; ``left`` counts a shingle and those after it.
                at = np.flatnonzero(often[order] > 1)
                out.append(pd.DataFrame({"fp": fp, "n": len(x), "root": root, "h": x[order[at]], "left": len(x) - at}))
            if out:
                yield pd.concat(out)

    heads = saved(parts.select("fp", "root", "set").mapInPandas(rarest, "fp long, n long, root long, h long, left long"), f"{folder}/heads")
    mixed = heads.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    heads = saved(heads.join(mixed, "h"), f"{folder}/heads")
    share = similarity / (1 + similarity)
    a, b = heads.where(F.col("left") >= 2 * share * F.col("n") - 1e-9).alias("a"), heads.alias("b")
    smaller = F.struct("a.n", "a.fp") < F.struct("b.n", "b.fp")
    enough = F.least("a.left", "b.left") >= share * (F.col("a.n") + F.col("b.n")) - 1e-9
    return a.join(b, (F.col("a.h") == F.col("b.h")) & smaller & (F.col("a.root") != F.col("b.root")) & enough).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _pass(sets: DataFrame, chosen: np.ndarray, first: int, similarity: float, folder: str) -> DataFrame:
    """Links (a, b) under the keys of some tables, whose components are those of ``near_groups`` of each key. A key's sets move packed, some hundreds or thousands to a row."""
    carried, most = reach(similarity), reach(similarity, 64 * LANES)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_remembered("near-duplicates")
        for b in batches:
            rows = np.empty(len(b), ENTRY)
            if len(b):
                rows["fp"], rows["n"], rows["print"] = b["fp"], b["n"], np.stack(b["print"].tolist()).view(np.uint64)
                for keys in table_keys(rows["print"], chosen, first).T:
                    order = np.argsort(keys, kind="stable")
                    parts = np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)
                    yield pd.DataFrame({"k": [keys[x[0]] for x in parts], "members": [rows[x].tobytes() for x in parts]})
            give_back()

    def linked(table: pa.Table) -> pa.Table:
        nothing_remembered("near-duplicates")
        rows = np.frombuffer(b"".join(table["members"].to_pylist()), ENTRY)
        rows = rows[np.argsort(rows["fp"])]
        label = near_groups(rows, similarity, carried, most)
        at = np.flatnonzero(label != np.arange(len(label)))
        give_back()
        return pa.table({"a": rows["fp"][at], "b": rows["fp"][label[at]]})

    keyed = sets.select("fp", "n", "print").mapInPandas(dealt, "k long, members binary")
    links = saved(keyed.groupBy("k").applyInArrow(linked, "a long, b long").distinct(), f"{folder}/links")
    # Spark deletes the files of a shuffle when the driver has collected it: here, before the next pass writes its own.
    sets.sparkSession._jvm.System.gc()
    give_back()
    return links


def similar(docs: DataFrame, similarity: float = SIMILARITY, crowd: int = 8192, rounds: int = 3, folder: str = "similar") -> DataFrame:
    """(id, at, component, root) of each row of ``docs``: its text's hash, the least id that can be reached over pairs whose word 5-shingles have this Jaccard similarity or more, and the group's name.

    At a similarity of 0.8 SimHash fingerprints differ in 0.15 of their bits on average, too many for
    blocks of which some must be equal. So fingerprints are of 512 bits; candidates agree in all bits of
    one of the tables of ``plan``, and differ in ``reach`` of their first 128 and of all bits at most (a
    pair at 0.8 fails to with odds of 0.00003, a closer one with less). Rows of equal sets fall together
    first. ``PASS`` tables are shuffled at a time.

    Candidate pairs grow with the square of a group's size, so they are not written out: a task that
    compares the sets under a key keeps the groups that they make, one link a set at most. All that can
    be reached over candidates meets in one task, which counts the overlaps of the whole shingle sets
    and keeps the groups of those that are alike.

    A group of more than ``crowd`` sets, or of more shingles than a task should hold or compare, is not
    gathered: in ``rounds``, its members are held against one of them, which joins large groups of near
    copies; what then is still in different components meets by ``prefix_pairs``, which leaves no pair
    out. Intermediate tables are written below ``folder`` of the shared folder.
    """

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_remembered("near-duplicates")
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                b = whole.iloc[at : at + SLICE]
                found = [shingles(t) for t in b["text"]]
                keys = np.array([_set_key(x) for x in found], np.uint64).view(np.int64)
                yield pd.DataFrame({"id": b["id"].astype("Int64").array, "at": b["at"].array, "fp": keys, "n": [len(x) for x in found], "print": [wide_fingerprint(x) for x in found]})
            give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("at"), "text")
    prints = saved(texts.mapInPandas(signed, "id long, at long, fp long, n long, print array<long>"), f"{folder}/prints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct("id", "at")).alias("one"), F.first("n").alias("n"), F.first("print").alias("print"))
    least = saved(least.select("fp", "least", F.xxhash64("one.id", "one.at").alias("key"), "n", "print"), f"{folder}/distinct")
    worded = least.where("n > 0")
    chosen = plan(worded.count(), similarity)
    links = reduce(DataFrame.union, [_pass(worded, chosen[first : first + PASS], first, similarity, folder) for first in range(0, len(chosen), PASS)])

    def sets_of(members: DataFrame) -> DataFrame:
        """(fp, set); rows that agree in id and text come as often as they are there."""
        wanted = marked(members)

        # Chosen here and not by a function of the key: a second Python worker for each task would take memory.
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nothing_remembered("near-duplicates")
            for whole in batches:
                whole = whole.filter(pa.array(wanted(whole["key"].to_numpy())))
                for at in range(0, len(whole), SLICE):
                    found = [shingles(t) for t in whole["text"][at : at + SLICE].to_pylist()]
                    keys = np.array([_set_key(x) for x in found], np.uint64).view(np.int64)
                    yield pa.record_batch({"fp": keys, "set": pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))})
                give_back()

        return texts.select(F.xxhash64("id", "at").alias("key"), "text").mapInArrow(cut, "fp long, set array<long>")

    def gathered(table: pa.Table) -> pa.Table:
        nothing_remembered("near-duplicates")
        order = np.lexsort((table["fp"].to_numpy(), table["k"].to_numpy()))
        k, fp, sets = table["k"].to_numpy()[order], table["fp"].to_numpy()[order], table["set"].combine_chunks()
        values, at = sets.values.to_numpy(), sets.offsets.to_numpy()
        one = np.append(True, fp[1:] != fp[:-1])
        k, fp, order = k[one], fp[one], order[one]
        nodes, roots = [], []
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(k)) + 1):
            label = alike_groups([values[at[x] : at[x + 1]] for x in order[part]], similarity)
            more = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            nodes.append(fp[part[more]])
            roots.append(fp[part[label[more]]])
        give_back()
        return pa.table({"node": np.concatenate(nodes), "component": np.concatenate(roots)})

    members = components(links, f"{folder}/components").select(F.col("node").alias("fp"), F.col("component").alias("k"))
    members = saved(members.join(worded.select("fp", "n", "key"), "fp"), f"{folder}/members")
    per = members.groupBy("k").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    crowds = saved(per.where((F.col("members") > crowd) | (F.col("shingles") > HELD) | (F.col("members") * F.col("shingles") > WORK)).select("k"), f"{folder}/crowds")
    few, full = members.join(crowds, "k", "left_anti"), members.join(crowds, "k")
    bins = 1 + (few.agg(F.sum("n")).first()[0] or 0) // BIN
    few = saved(few, f"{folder}/few")
    placed = few.select("fp", "k", F.pmod(F.xxhash64("k"), F.lit(bins)).alias("bin")).join(sets_of(few), "fp")
    joined = saved(placed.groupBy("bin").applyInArrow(gathered, "node long, component long"), f"{folder}/joined")

    def fits(n: str, m: str) -> Column:
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        got = pairs.distinct().join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return saved(got.where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"), f"{folder}/verified")

    def rooted(members: DataFrame) -> DataFrame:
        return members.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")

    if not crowds.isEmpty():
        full = saved(full, f"{folder}/full")
        sets = saved(sets_of(full).join(full.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), f"{folder}/sets")
        for turn in range(rounds + 1):
            now = saved(rooted(full.select("k", "fp", "n")), f"{folder}/rooted")
            per = now.groupBy("k", "root").agg(F.count("*").alias("members")).groupBy("k").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("members", "root")).alias("main")).where("roots > 1")
            if turn < rounds:
                # Members of the largest component take turns, and so do all where no component stands out.
                order = F.struct((F.col("root") != F.col("main")).alias("other"), F.xxhash64("fp", F.lit(turn)).alias("h"))
                one = now.join(per, "k").groupBy("k").agg(F.min_by(F.struct("fp", "n", "root"), order).alias("one")).select("k", F.col("one.fp").alias("b"), F.col("one.n").alias("m"), F.col("one.root").alias("other"))
                pairs = now.join(one, "k").where((F.col("root") != F.col("other")) & fits("n", "m")).select(F.col("fp").alias("a"), "b")
            else:
                pairs = prefix_pairs(now.join(per, "k").select("fp", "n", "root").distinct(), sets, similarity, folder)
            linked = verified(pairs)
            if linked.isEmpty():
                continue
            # Only the components that the new links join are worked on.
            ends = rooted(rooted(linked.withColumnRenamed("a", "fp")).select(F.col("root").alias("a"), F.col("b").alias("fp"))).select("a", F.col("root").alias("b"))
            more = saved(components(ends, f"{folder}/components"), f"{folder}/merged")
            moved = joined.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            joined = saved(moved.union(more.join(joined, "node", "left_anti").select("node", "component")), f"{folder}/joined")
    named = least.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    return prints.select("id", "at", "fp").join(named.join(roots, "root").select("fp", "component", "root"), "fp").select("id", "at", "component", "root")


def keep_one(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each group: the one with the least id, of equal ids the one whose text has the least hash, and without an id only if all are.

    Groups are those of op2's fingerprints, or with ``similarity`` those of ``similar``. Texts without
    words, null ones included, are one group. Of rows that agree in id and text one stays, chosen by a
    hash of all its columns; rows with one id and unlike texts all stay. An empty table stays empty.
    All columns stay, whatever their names.
    """
    spark, folder = docs.sparkSession, f"similar-{uuid.uuid4().hex}"
    found = groups(saved(fingerprints(docs), "simhash-prints")) if similarity is None else similar(docs, similarity, folder=folder)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    found = saved(found.groupBy("id", "at", "root").agg(F.count("*").alias("rows")), "simhash-rows")
    drop_saved(spark, f"{shared_folder(spark)}/{folder}")
    first = found.groupBy("root").agg(F.min(rank).alias("first"))
    # Rows that go, and those that agree in id and text, are told apart; all others stay where they are.
    told = saved(found.join(first, "root").select("id", "at", "rows", (rank != F.col("first")).alias("goes")).where("goes or rows > 1"), "simhash-told")
    out = told.where("goes").select(F.col("id").alias("out_id"), F.col("at").alias("out_at"))
    wanted = marked(told.select(F.xxhash64("id", "at").alias("key")))

    @F.pandas_udf("boolean")
    def mark(key: pd.Series) -> pd.Series:
        nothing_remembered("near-duplicates")
        return pd.Series(wanted(key.to_numpy()))

    named = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not re.search("map|variant", f.dataType.simpleString())]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("at"), F.struct(*named).alias("row"), F.xxhash64(*plain).alias("hash"))
    rows = rows.withColumn("marked", mark(F.xxhash64("id", "at")))
    left = rows.where("marked").join(out, F.col("id").eqNullSafe(F.col("out_id")) & (F.col("at") == F.col("out_at")), "left_anti")
    one = rows.where("not marked").select("row").union(left.groupBy("id", "at").agg(F.min_by("row", "hash").alias("row")).select("row"))
    return one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
