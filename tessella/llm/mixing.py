"""Mixing sources to target weights, by blocks of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import WORD, saved

#: Words of a block; blocks drawn for one output shard; rows that one prefix-sum chunk holds on average.
BLOCK, SHARD, CHUNK_ROWS = 64, 4096, 20_000
SEED = 7


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Splits ``share`` of all sizes by weight; a source stops at ``most`` times its size, and the excess is shared again."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / total > most * sizes[k]}
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            return out
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        open_ -= over
    return out


def draw(slots: list[int], shard: int = SHARD, seed: int = SEED) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first slot, count): each output shard's counts are a multinomial draw.

    The odds of a draw are what is left of each source's slots, and a draw takes no more than that;
    so the shards together take exactly ``slots``.
    """
    rng = np.random.default_rng(seed)
    left, done, k = np.array(slots, np.int64), np.zeros(len(slots), np.int64), 0
    while left.sum():
        room, taken = int(min(shard, left.sum())), np.zeros(len(slots), np.int64)
        while room:
            now = left - taken
            more = np.minimum(rng.multinomial(room, now / now.sum()), now)
            taken += more
            room -= int(more.sum())
        for s in np.nonzero(taken)[0]:
            yield k, int(s), int(done[s]), int(taken[s])
        left, done, k = left - taken, done + taken, k + 1


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``key``, sends each index, or with ``back`` has it from.

    A Feistel network permutes the next even power of two; indexes that leave 0..n-1 are sent on until they return.
    """
    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    half = np.ceil(np.maximum(np.log2(np.maximum(n, 2).astype(np.float64)), 2) / 2).astype(np.uint64)
    half = np.where((np.uint64(1) << (half * np.uint64(2))) < n, half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & m
        if back:
            a, b = b, a
        for r in reversed(range(rounds)) if back else range(rounds):
            mixed = (b + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((mixed >> np.uint64(29)) & m)
        out[todo] = (b << h) | a if back else (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def plan(words: int, size: int, block: int, key: int) -> tuple[int, int]:
    """(slots, words of the last slot) that take ``words`` words of a stream of ``size`` words in passes over its blocks.

    All blocks are whole but the stream's last, whose place in the pass that ``words`` ends in is looked up.
    """
    if not size or not words:
        return 0, 0
    blocks = -(-size // block)
    whole, rest = divmod(words, size)
    if not rest:
        return whole * blocks, block
    short = size - (blocks - 1) * block
    at = int(permute(np.array([blocks - 1]), np.array([blocks]), np.array([key + whole]), back=True)[0])
    upto = lambda n: n * block - (block - short if at < n else 0)
    n = -(-rest // block)
    n += upto(n) < rest
    return whole * blocks + n, rest - upto(n - 1)


@dataclass
class Mix:
    """``sources``: one entry a source. ``rows``: (key, source, size) of each row. ``slots``: the mix in output order,
    (shard, source, pass, block, words at most). ``pieces``: (key, pass, from, to), the words of a row that the mix takes in one pass."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame
    pieces: DataFrame


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("source").isNull(), "source", "text")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """Plans a mix of ``docs`` (doc_id, source, text).

    A source's words are one stream, cut into blocks of ``block`` words. Its slots are its target in
    blocks, the last cut to the words still missing; slot i takes, in pass i div n, the block that the pass's permutation of the source's n
    blocks names. Sources are ordered by code point, null last, and weighed in turn by ``weights``.

    A source's rows lie in its stream in order of their keys. Positions come from two sums: within
    chunks of about 20,000 rows, and over the chunks; so a source with most of the rows is spread
    over tasks. To the driver come one row per source (a short list by its nature) and the shards'
    counts. Rows that agree in id, source and text share their place, and are taken alike.
    """
    spark = docs.sparkSession
    rows = saved(docs.select(_key().alias("key"), "source", word_count(F.col("text")).alias("size")), "mix-rows")
    per = [(r["source"], r["n"] or 0, r["words"] or 0) for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()]
    per.sort(key=lambda x: (x[0] is None, x[0] or ""))
    want = targets([x[2] for x in per], [weights[k % len(weights)] for k in range(len(per))], share, most)
    chunks = 1 + sum(x[1] for x in per) // CHUNK_ROWS

    numbered = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_no", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    sources = spark.createDataFrame([(x[0], k, int(x[2]), float(w)) for k, (x, w) in enumerate(zip(per, want, strict=True))], numbered)
    distinct = rows.where("size > 0").groupBy("key").agg(F.first("source").alias("source"), F.max("size").alias("size"))
    placed = distinct.join(F.broadcast(sources.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name"))).select("key", "source_no", "size", F.pmod("key", F.lit(chunks)).alias("chunk"))
    before = placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("n"))
    before = before.withColumn("base", F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n"))
    within = Window.partitionBy("source_no", "chunk").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = placed.withColumn("end", F.sum("size").over(within)).join(before.select("source_no", "chunk", "base"), ["source_no", "chunk"])
    located = saved(located.select("key", "source_no", "size", (F.col("base") + F.col("end") - F.col("size")).alias("start")), "mix-places")

    stream = {r["source_no"]: r["n"] for r in located.groupBy("source_no").agg(F.sum("size").alias("n")).collect()}
    blocks = [-(-stream.get(k, 0) // block) for k in range(len(per))]
    plans = [plan(min(round(w / x[2] * stream[k]), int(most * stream[k])) if x[2] else 0, stream.get(k, 0), block, seed + k * 1000) for k, (x, w) in enumerate(zip(per, want, strict=True))]
    slots = [n for n, _ in plans]
    counts = pd.DataFrame([(*row, blocks[row[1]], *plans[row[1]]) for row in draw(slots, shard, seed)], columns=["shard", "source_no", "first", "n", "blocks", "slots", "rest"]).astype("int64")
    drawn = spark.createDataFrame(counts, "shard long, source_no long, first long, n long, blocks long, slots long, rest long")

    @F.pandas_udf("long")
    def sent(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), n.to_numpy(), key.to_numpy()))

    slot = drawn.select("shard", F.col("source_no").cast("int").alias("source_no"), "blocks", "slots", "rest", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i"))
    slot = slot.withColumn("words", F.when(F.col("i") == F.col("slots") - 1, F.col("rest")).otherwise(block))
    slot = slot.select("shard", "source_no", "words", F.floor(F.col("i") / F.col("blocks")).cast("int").alias("pass"), (F.col("i") % F.col("blocks")).alias("index"), "blocks")
    slot = slot.withColumn("block", sent("index", "blocks", F.lit(seed) + F.col("source_no") * 1000 + F.col("pass")))
    slot = saved(slot.select("shard", "source_no", "pass", "block", "words"), "mix-slots")

    start, end = F.col("start"), F.col("start") + F.col("size")
    cut = located.withColumn("block", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))))
    cut = cut.select("key", "source_no", "block", "start", (F.greatest(F.col("block") * block, start) - start).alias("from"), (F.least((F.col("block") + 1) * block, end) - start).alias("to"))
    drawn_to = F.least("to", F.col("block") * block + F.col("words") - F.col("start"))
    pieces = cut.join(slot, ["source_no", "block"]).select("key", "pass", "from", drawn_to.alias("to")).where(F.col("to") > F.col("from"))
    return Mix(sources, rows, slot, pieces)


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``. Rows without words take nothing, rows without a source
    are one source, repeated rows take alike, and an empty table gives no rows. Other columns, whatever their names, play no part."""
    m = mix(docs)
    per_key = saved(m.pieces.groupBy("key").agg(F.sum(F.col("to") - F.col("from")).alias("taken")), "mix-taken")
    rows = docs.select("doc_id", F.col("source").alias("name"), _key().alias("key"), word_count(F.col("text")).alias("size"))
    out = rows.join(F.broadcast(m.sources), F.col("name").eqNullSafe(F.col("source"))).join(per_key, "key", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words ``spans`` of ``text`` (each from, to), with the white space between them."""
    at = [m.span() for m in WORD.finditer(text)]
    return " ".join(text[at[a][0] : at[min(b, len(at)) - 1][1]] for a, b in spans)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each row and pass, the words that the pass takes of it.

    A row taken whole keeps its text as it is; of others the text is the words taken, in their
    order. ``n_chars``, if there, follows the text. A row comes as often as passes take any of it.
    Rows with null or empty texts are never drawn; repeated rows are drawn alike; an empty table stays
    empty. A long text is cut by its blocks of words. All columns stay, whatever their names.
    """
    m = mix(docs)
    spans = m.pieces.groupBy("key", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"), F.sum(F.col("to") - F.col("from")).alias("words"))
    sizes = m.rows.select("key", "size").distinct()
    plan = spans.join(sizes, "key").select("key", F.when(F.col("words") < F.col("size"), F.col("spans")).alias("spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if s is None:
                out.append(t)
                continue
            joined: list[tuple[int, int]] = []
            for x in s:
                a, b = x["from"], x["to"]
                joined = [*joined[:-1], (joined[-1][0], b)] if joined and joined[-1][1] == a else [*joined, (a, b)]
            out.append(_cut(t, joined))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key().alias("key")).join(plan, "key")
    rows = rows.select("row", cut(F.col("row.text"), F.col("spans")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
