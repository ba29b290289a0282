"""Token ids in binary shards of patched frame-of-reference blocks.

File format. A shard is a Parquet table with one row per chunk of about 262,144 ids:
``part`` and ``seq`` order the chunks; ``first`` counts the ids of earlier chunks of the part;
``doc_ids`` and ``lengths`` list the documents of the chunk, and ``payload`` holds their ids.
Little-endian, a payload is::

    b"PFR1"  ids: u64  block size: u32  blocks: u32  exceptions: u32
    block minimum: u32 * blocks     what is subtracted from a block's ids
    block width:   u8 * blocks      bits that a packed difference takes
    block start:   u64 * blocks     the index: byte offset of a block within ``packed``
    exceptions of a block: u32 * blocks
    exception position: u16 * exceptions   within its block
    exception excess:   u32 * exceptions   the difference's bits above the block's width
    packed: each block's differences, lowest bit first, padded to whole bytes

A block's width is the bits that a given percentile of its differences need; larger ones are
patched from the exception lists.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import give_back, remembered, saved, shuffle_partitions

BLOCK, PERCENTILE, CHUNK = 128, 0.9, 1 << 18
HEAD = struct.Struct("<4sQIII")
SCHEMA = "part int, seq int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The payload for unsigned 32-bit ``ids``."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n, blocks = len(ids), -(-len(ids) // block)
    padded = np.concatenate([ids, np.full(blocks * block - n, ids[-1] if n else 0, np.uint32)]).reshape(blocks, block)
    low = padded.min(1) if blocks else np.zeros(0, np.uint32)
    diff = padded - low[:, None]
    bits = _bit_lengths(diff)
    rank = min(block - 1, int(np.ceil(percentile * block)) - 1)
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    at, where = np.nonzero(over)
    excess = (diff[at, where] >> width[at].astype(np.uint32)).astype("<u4")
    sizes = (block * width.astype(np.int64) + 7) // 8
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.nonzero(width == w)[0]
        kind, full = ("<u2", 16) if w <= 16 else ("<u4", 32)
        part = (diff[rows] & np.uint32((1 << int(w)) - 1)).astype(kind)
        if w < full:
            out = np.packbits(np.unpackbits(part.view(np.uint8).reshape(len(rows), block, full // 8), axis=2, bitorder="little")[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
        else:
            out = part.view(np.uint8).reshape(len(rows), -1)
        packed[starts[rows][:, None] + np.arange(sizes[rows[0]])] = out
    counts = over.sum(1).astype("<u4") if blocks else np.zeros(0, "<u4")
    head = HEAD.pack(b"PFR1", n, block, blocks, len(excess))
    return b"".join([head, low.astype("<u4").tobytes(), width.tobytes(), starts.astype("<u8").tobytes(), counts.tobytes(), where.astype("<u2").tobytes(), excess.tobytes(), packed.tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload, as unsigned 32-bit integers."""
    magic, n, block, blocks, exceptions = HEAD.unpack_from(payload)
    if magic != b"PFR1":
        raise ValueError("not a packed id payload")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    low, width, starts, counts = take("<u4", blocks), take("u1", blocks), take("<u8", blocks).astype(np.int64), take("<u4", blocks)
    where, excess = take("<u2", exceptions), take("<u4", exceptions)
    packed = np.frombuffer(payload, np.uint8, offset=at)
    diff = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.nonzero(width == w)[0]
        kind, full = ("<u2", 16) if w <= 16 else ("<u4", 32)
        part = packed[starts[rows][:, None] + np.arange((block * int(w) + 7) // 8)]
        if w < full:
            bits = np.zeros((len(rows), block, full), np.uint8)
            bits[:, :, :w] = np.unpackbits(part, axis=1, count=block * int(w), bitorder="little").reshape(len(rows), block, int(w))
            part = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        diff[rows] = np.ascontiguousarray(part).view(kind)
    rows = np.repeat(np.arange(blocks), counts)
    diff[rows, where] |= excess << width[rows].astype(np.uint32)
    return (diff + low[:, None].astype(np.uint32)).reshape(-1)[:n]


class Known:
    """Ids of pieces, one after the other in an array, and each piece's number in it."""

    def __init__(self, kind: str):
        self.number: dict[str, int] = {}
        self.flat, self.ends, self.size = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), 0

    def add(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.number)
        used = int(self.ends[n])
        for name, need in (("flat", used + len(flat)), ("ends", n + 1 + len(pieces))):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, len(old) * 3 // 2), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.flat[used : used + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(pieces)] = used + np.cumsum(sizes)
        self.number.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.size += sum(map(len, pieces)) + 2 * len(flat) + 160 * len(pieces)

    def of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of known pieces, one after the other."""
        return self.ids(np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the pieces with the numbers ``at``."""
        start = self.ends[at]
        sizes = self.ends[at + 1] - start
        return self.flat[_runs(start, sizes)], sizes


def _runs(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(start) or int(start.max()) + total < 1 << 31) else np.int64
    out = np.repeat((start - ends + sizes).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


class Encoder:
    """Encodes texts with a tokenizer file whose pre-tokens never reach across a single space between two other characters.

    So a text is the concatenation of pieces cut before such spaces and line feeds, and of its ids the
    concatenation of theirs. Pieces recur; their ids are remembered, in two generations of about ``most`` bytes.
    A text whose spaces touch other white space is cut by a pattern instead of at every space.
    """

    CUT, SEPARATOR = re.compile(r"(?<=\S) (?=\S)"), "\0"
    #: White space other than space and line feed, as Python's ``\s`` has it.
    RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
    #: Pieces that start a text or a line, and those that follow a space.
    FIRST, LATER = 0, 1

    def __init__(self, path: str, most: int = 80_000_000, end_id: int = 2):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # Its own memory of words would never be read: each piece is encoded once.
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u4" if size > 65536 else "<u2"
        #: By kind of piece. What an older generation knows is taken over when it recurs.
        self.known, self.older = [Known(self.kind), Known(self.kind)], [Known(self.kind), Known(self.kind)]
        self.end = np.array([end_id], "<u4")
        self.starts = np.array([(self.tokenizer.id_to_token(k) or "")[:1] == "\u0120" for k in range(size)])
        self.ends = {x: self._ids([x])[0] for x in ".,"}
        self.line = self._ids(["\n"])[0]

    def joined(self, text: str) -> str:
        """The text's pieces with ``SEPARATOR``, which it doesn't hold, between them.

        It is cut before spaces, which are left out, and before single line feeds between other characters, which stay.
        """
        double = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        uneven = double or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(map(text.__contains__, self.RARE))
        return self.CUT.sub(self.SEPARATOR, text) if uneven else text.replace("\n", " \n").replace(" ", self.SEPARATOR)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unknown(self, kind: int, pieces: Iterable[str], missing: bool = False) -> list[str]:
        """The pieces that neither generation remembers, ``missing`` ones not the newer; those of the older one are taken over to the newer."""
        known, older = self.known[kind], self.older[kind]
        new = list(pieces) if missing else [w for w in pieces if w not in known.number]
        if new and older.number:
            back = [w for w in new if w in older.number]
            known.add(back, *older.of(back))
            back = set(back)
            new = [w for w in new if w not in back]
        return new

    def _alone(self, kind: int, pieces: list[str]) -> None:
        found = self._ids([" " * kind + w for w in pieces])
        self.known[kind].add(pieces, np.concatenate([*found, np.zeros(0, self.kind)]), np.array([len(x) for x in found], np.int64))

    def _extended(self, kind: int, pieces: list[str], stems: list[str], of: int, before: np.ndarray, after: list[np.ndarray]) -> None:
        """Learns pieces whose ids are those of their stems with ``before`` before, and ``after``, one each or none, behind them."""
        flat, sizes = self.known[of].of(stems)
        more = len(before) + (len(after[0]) if after else 0)
        out = np.zeros(len(flat) + more * len(stems), self.kind)
        ends = np.cumsum(sizes + more)
        out[_runs(ends - sizes - more + len(before), sizes)] = flat
        for k, x in enumerate(before):
            out[ends - sizes - more + k] = x
        if after:
            out[_runs(ends - len(after[0]), np.full(len(ends), len(after[0])))] = np.concatenate(after)
        self.known[kind].add(pieces, out, sizes + more)

    def _learn(self, kind: int, pieces: Iterable[str], missing: bool = False) -> None:
        """Ids of pieces of a kind, of which the newer generation knows none if they are ``missing``.

        New words are encoded in one text, a space or a line feed before each: a word's ids start at a
        token that starts with a space, or behind the line feed's. A full stop or comma after a letter,
        and a line feed between other characters, are pre-tokens of their own; so such pieces take the
        ids of their parts. Pieces with white space inside are encoded alone.
        """
        new = self._unknown(kind, pieces, missing)
        lines = [w for w in new if w[:1] == "\n"] if kind else []
        if lines:
            rest = [w[1:] for w in lines]
            self._learn(self.FIRST, dict.fromkeys(rest))
            self._extended(kind, lines, rest, self.FIRST, self.line, [])
        ended = [w for w in new if w[-1:] in self.ends and w[-2:-1].isalpha() and (not kind or w[0] != "\n")]
        plain = set(new).difference(lines, ended)
        plain = list(plain.union(self._unknown(kind, {w[:-1] for w in ended})))
        if " ".join(plain).split() != plain:  # some piece is empty or holds white space
            alone = [w for w in plain if w.split() != [w]]
            self._alone(kind, alone)
            plain = [w for w in plain if w.split() == [w]]
        sign = " " if kind else "\n"
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            raw = self._ids([sign + sign.join(some)])[0]
            mark = np.nonzero(self.starts[raw] if kind else raw == self.line[0])[0]
            if len(mark) == len(some) and mark[0] == 0 and len(self.line) == 1:
                sizes = np.diff(np.append(mark, len(raw))) - (not kind)
                self.known[kind].add(some, raw if kind else np.delete(raw, mark), sizes)
            else:
                self._alone(kind, some)
        if ended:
            self._extended(kind, ended, [w[:-1] for w in ended], kind, self.line[:0], [self.ends[w[-1]] for w in ended])

    def _numbers(self, kind: int, pieces: list[str]) -> np.ndarray:
        """The number of each piece, which is learned if new."""
        known = self.known[kind].number
        at = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.nonzero(at < 0)[0]
        new = [pieces[k] for k in missing.tolist()]
        self._learn(kind, dict.fromkeys(new), True)
        at[missing] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the end id after them.

        Pieces are cut and numbered by Arrow, so that only different ones become Python strings;
        ids are gathered from those of the different pieces.
        """
        for k, known in enumerate(self.known):
            if known.size > self.most:
                self.older[k], self.known[k] = known, Known(self.kind)
        whole = {k: np.append(self._ids([t])[0].astype("<u4"), self.end) for k, t in enumerate(texts) if self.SEPARATOR in t}
        cut = pc.split_pattern(pa.array(["" if k in whole else self.joined(t) for k, t in enumerate(texts)], pa.large_string()), self.SEPARATOR)
        at = cut.offsets.to_numpy().astype(np.int64)
        numbered = cut.flatten().dictionary_encode()
        words, piece = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy().astype(np.int32)
        first = [words[k] for k in piece[at[:-1]].tolist()]
        # Lines' pieces may be learned with later ones: so ids are taken when all are known.
        in_first, in_later = self._numbers(self.FIRST, first), self._numbers(self.LATER, words)
        # The ids of pieces that follow others, of first pieces, and the end id, one after the other.
        (later, m), (early, n) = self.known[self.LATER].ids(in_later), self.known[self.FIRST].ids(in_first)
        flat, size = np.concatenate([later, early, self.end]).astype("<u4"), np.concatenate([m, n, [1]])
        piece[at[:-1]] = len(words) + np.arange(len(texts))
        piece = np.insert(piece, at[1:], len(size) - 1)
        ids = flat[_runs((np.cumsum(size) - size)[piece], size[piece])]
        ends = np.cumsum(size[piece])[at[1:] + np.arange(len(texts))]
        out = np.split(ids, ends[:-1]) if len(texts) else []
        return [whole.get(k, x) for k, x in enumerate(out)]


def tokenizer_path(name_or_path: str) -> str:
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def encode_to_shards(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Rows of the file format, in ascending doc_id order (nulls first, equal ids by the hash of their text).

    Rows are dealt out by ranges of (doc_id, text hash), so even one id on very many rows spreads
    over tasks where its texts differ. A task holds one chunk and one Arrow batch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = remembered(("token-files", tokenizer, end_id), lambda: Encoder(tokenizer_path(tokenizer), end_id=end_id))
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, ids, held = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal doc_ids, ids, held, seq, first
            row = pd.DataFrame({"part": [part], "seq": [seq], "first": [first], "n_ids": [held], "doc_ids": [doc_ids], "lengths": [[len(x) for x in ids]], "payload": [pack(np.concatenate(ids))]})
            first, seq, held, doc_ids, ids = first + held, seq + 1, 0, [], []
            return row

        for b in batches:
            names = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
            texts = b["text"].tolist()
            for at in range(0, len(texts), 1024):
                found = encoder.encode([x if isinstance(x, str) else "" for x in texts[at : at + 1024]])
                for name, x in zip(names[at : at + 1024], found, strict=True):
                    doc_ids.append(name)
                    ids.append(x)
                    held += len(x)
                    if held >= chunk:
                        yield flush()
            give_back()
        if ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = sent.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, SCHEMA)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the shards below ``path`` (any file system that Spark can write)."""
    encode_to_shards(docs, **options).write.option("compression", "none").parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards."""
    totals = sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row per writing task
    before, sums = {}, 0
    for part, n in totals:
        before[part], sums = sums, sums + n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                ids, lengths = unpack(row.payload), np.asarray(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                names = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": names, "start": before[row.part] + row.first + ends - lengths, "n_tokens": lengths, "ids_crc32": np.array(sums, np.int64)})

    return shards.select("part", "first", "doc_ids", "lengths", "payload").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as shards to the shared folder and reads them back.

    Null and empty texts are the end id alone. Repeated rows each take their place. An empty table
    gives no rows.
    """
    return read_shards(saved(encode_to_shards(docs, tokenizer, end_id), "token-shards"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
