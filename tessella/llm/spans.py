"""Spans of regular expressions in texts, with DataFrame functions only.

Patterns are Java's, matched from the left without overlaps. Their repetitions are possessive
where nothing after them could need a character back, so that long texts neither overflow the
stack nor take quadratic time. Offsets count code points; ends are exclusive. Folds over a text's
matches run in blocks of the square root of their number, so that a list grows by copying blocks;
a text of a hundred thousand matches takes about a second.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,place:int,end:bigint,kind:string>"
#: Characters of a piece that a text is cut into, so that a substring costs no walk from its start.
CHUNK = 4096


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, and which matches to keep (a function of the matched string's column)."""

    name: str
    pattern: str
    keep: Callable[[Column], Column] | None = None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """A list that isn't empty, cut into about as many blocks as a block has items."""
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / w).cast("int")), lambda b: F.slice(items, b * w + 1, w)))


def running(numbers: Column) -> Column:
    """The sums of a list's first one, two, and so on numbers. The list isn't empty."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
    join = lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.transform(b["out"], lambda x: x + a["at"])).alias("out"))
    return let(numbers, lambda n: F.aggregate(F.transform(_blocks(n), lambda b: F.aggregate(b, none, step)), none, join, lambda a: a["out"]))


def located(words: Column, gaps: Column, value: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """(start, end, value) of the kept ones of ``words``, the matches of a text, from the ``gaps`` around them: one more than matches.

    Matches and the gaps between them add up to the text; so a match's end is the sum of the lengths so far.
    """
    kept = lambda w: F.coalesce(keep(w), F.lit(False)) if keep else w.isNotNull()
    steps = F.zip_with(words, gaps, lambda w, g: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(w), F.lit(0)).alias("size"), kept(w).alias("kept"), F.when(w.isNotNull(), value(w)).alias("value")))

    def placed(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: (x["gap"] + x["size"]).cast("long")))
        both = F.zip_with(s, ends, lambda x, e: F.struct((e - x["size"]).alias("start"), e.alias("end"), x["value"].alias("value"), x["kept"].alias("kept")))
        return F.filter(both, lambda x: x["kept"])

    return let(steps, placed)


def find(df: DataFrame, text: str, kinds: list[Kind], out: str, first_place: int = 0) -> DataFrame:
    """Adds ``out``: the spans of ``kinds`` in column ``text`` (not null), by start, then by the kinds' order. Texts without a match cost the search alone."""
    names = df.columns
    m, g = (lambda k, p=p: f"__{p}{k}_{out}" for p in "mg")
    df = df.select("*", *(F.regexp_extract_all(F.col(text), F.lit(x.pattern), F.lit(0)).alias(m(k)) for k, x in enumerate(kinds)))
    df = df.select("*", *(F.when(F.size(m(k)) > 0, F.split(F.col(text), x.pattern, -1)).alias(g(k)) for k, x in enumerate(kinds)))

    def spans(k: int, kind: Kind) -> Column:
        found = located(F.col(m(k)), F.col(g(k)), lambda w: F.lit(0), kind.keep)
        named = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(first_place + k).alias("place"), x["end"].alias("end"), F.lit(kind.name).alias("kind")))
        return F.when(F.size(m(k)) > 0, named).otherwise(F.array().cast(f"array<{SPAN}>"))

    return df.select(*names, F.sort_array(F.concat(*(spans(k, x) for k, x in enumerate(kinds)))).alias(out))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def chunked(text: Column) -> Column:
    """A text as a list of pieces of ``CHUNK`` characters, for ``part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` (0-based) of a text cut by ``chunked``."""
    first = F.floor(start / CHUNK).cast("int")
    count = F.floor((start + length - 1) / CHUNK).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(chunks, first + 1, count), ""), (start % CHUNK).cast("int") + 1, length.cast("int"))


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced by ``label(kind)``. Of overlapping spans the first one counts, and the rest of a later one goes with it."""
    none = F.array().cast("array<struct<start:bigint,size:bigint,kind:string>>")

    def step(a: Column, x: Column) -> Column:
        new = F.array(F.struct(a["at"].alias("start"), (x["start"] - a["at"]).alias("size"), x["kind"].alias("kind")))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["out"], new)).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.lit(-1).cast("long").alias("size"), x["kind"].alias("kind"))))).alias("out"))

    def state(at: Column) -> Column:
        return F.struct(at.alias("at"), none.alias("out"))

    def block(a: Column, b: Column) -> Column:
        return let(F.aggregate(b, state(a["at"]), step), lambda n: F.struct(n["at"].alias("at"), F.concat(a["out"], F.filter(n["out"], lambda x: x["size"] >= 0)).alias("out")))

    def written(chunks: Column) -> Column:
        folded = F.aggregate(_blocks(spans), state(F.lit(0).cast("long")), block)
        pieces = lambda a: F.transform(a["out"], lambda x: F.concat(part(chunks, x["start"], x["size"]), label(x["kind"])))
        return let(folded, lambda a: F.concat(F.array_join(pieces(a), ""), part(chunks, a["at"], F.greatest(F.lit(0), F.length(text) - a["at"]))))

    return F.when(F.size(spans) > 0, let(chunked(text), written)).otherwise(text)
