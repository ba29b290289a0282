"""Personal data in texts: patterns, and terms that give a protected entity away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import row_key, saved, with_text
from tessella.llm.secrets import digest
from tessella.llm.spans import SPAN, Kind, chunked, find, let, located, part, replaced


def _digits(w: Column) -> Column:
    return F.regexp_replace(w, "[^0-9]", "")


def _luhn(w: Column) -> Column:
    """Whether every second digit from the right, doubled and reduced, and the others add up to a multiple of ten."""
    back = F.reverse(_digits(w))
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _between(w: Column, low: int, high: int) -> Column:
    return F.length(_digits(w)).between(low, high)


_LOCAL = "[A-Za-z0-9._%+-]"
BASE = [
    # A match starts where its run of local characters does, or where the last match ended: elsewhere it would have started earlier.
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda w: F.forall(F.split(w, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))).cast("int"), F.lit(999)) <= 255))),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda w: F.when(_between(w, 12, 19), _luhn(w)).otherwise(False)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda w: _between(w, 9, 15)),
]
#: Words on either side of an entity; different texts that must show a term with it; shares of an entity's information from which a term is generalised, or removed.
NEAR, SUPPORT, GENERALISE, REMOVE = 6, 3, 0.8, 0.9
#: Terms that are sent to every executor; more of them meet the texts' words in a shuffled join.
SENT = 500_000
_WORD = r"\p{L}++"
#: Spans of terms that are removed, and of those that are generalised.
REMOVED, GENERAL = "term", "hint"


def words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)


def _contexts(text: Column, base: Column) -> Column:
    """(entity, words) of each strong span: its string, and the ``NEAR`` words on either side of it that come before the neighbouring spans."""
    first = rf"^(?:\P{{L}}*+\p{{L}}++){{1,{NEAR}}}"
    head = lambda piece: words(F.regexp_extract(piece, first, 0))
    tail = lambda piece: F.transform(words(F.regexp_extract(F.reverse(piece), first, 0)), F.reverse)

    def context(chunks: Column, size: Column, spans: Column, s: Column, i: Column) -> Column:
        before = F.least(s["start"], F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0)))
        after = F.greatest(s["end"], F.coalesce(F.get(spans, i + 1)["start"], size))
        left, right = part(chunks, before, s["start"] - before), part(chunks, s["end"], after - s["end"])
        return F.struct(part(chunks, s["start"], s["end"] - s["start"]).alias("entity"), F.array_distinct(F.concat(tail(left), head(right))).alias("words"))

    found = let(chunked(text), lambda chunks: let(F.length(text).cast("long"), lambda size: let(base, lambda spans: F.transform(spans, lambda s, i: context(chunks, size, spans, s, i)))))
    return F.when(F.size(base) > 0, found).otherwise(F.array().cast("array<struct<entity:string,words:array<string>>>"))


def disclosing(contexts: DataFrame, texts: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(term, entity, together, term_rows, entity_rows, information, bits, disclosure): terms that tell of an entity.

    ``contexts`` has a row's text hash and its (entity, words) list, ``texts`` each row's text. An
    entity's information is -log2 of its share of all rows; ``bits`` is its pointwise mutual
    information with the term near it, log2(p(term, entity) / (p(term) p(entity))); and the disclosure
    is the share of the information that these bits are: 1 if the term always comes with the entity,
    0 if independently. Terms from ``threshold`` up that ``support`` different texts show with the
    entity are returned. An entity in every row has no information to disclose.

    All counts are of rows, copies included, and of all rows: partial sums by term, entity, or pair
    are shuffled, never occurrences, so neither a common word nor a group of copies meets one task.
    """
    total = texts.count()
    # One text a pair, as lists of texts lose repeats by hashing and lists of pairs do not; neither part holds the separator.
    pairs = F.array_distinct(F.flatten(F.transform("found", lambda x: F.transform(x["words"], lambda w: F.concat(w, F.lit("\x01"), x["entity"])))))
    seen = contexts.where(F.size("found") > 0)
    together = seen.select("hash", F.explode(pairs).alias("pair")).groupBy("pair", "hash").agg(F.count("*").alias("n"))
    together = together.groupBy("pair").agg(F.sum("n").alias("together"), F.count("*").alias("different")).where(F.col("different") >= support)
    together = saved(together.select(F.substring_index("pair", "\x01", 1).alias("term"), F.substring_index("pair", "\x01", -1).alias("entity"), "together"), "pii-pairs")
    entities = seen.select(F.explode(F.array_distinct("found.entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("entity_rows"))
    terms = texts.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("term_rows"))
    got = together.join(entities, "entity").join(terms, "term")
    information = F.log2(F.lit(total) / F.col("entity_rows"))
    bits = F.log2(F.lit(total) * F.col("together") / (F.col("term_rows") * F.col("entity_rows")))
    got = got.select("term", "entity", "together", "term_rows", "entity_rows", information.alias("information"), bits.alias("bits"))
    return got.where("information > 0").withColumn("disclosure", F.col("bits") / F.col("information")).where(F.col("disclosure") >= threshold)


def personal(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, sent: int = SENT) -> DataFrame:
    """(doc_id, key, base, extra) of each row of ``docs``: strong spans, and disclosing terms wherever they occur.

    A term's span is of kind ``term`` if it discloses the share ``remove`` of some entity's information
    or more, and of kind ``hint`` if the share ``generalise``. Terms, and the keys of rows that hold one,
    go to every executor if there are ``sent`` of them at most; more terms join the texts' words in a
    shuffle, and of more rows all are searched. Texts are never shuffled.

    Null texts count as empty; long ones are searched whole. Rows that agree in id and text give
    the same result, an empty table none. Other columns of ``docs``, whatever their names, play no part.
    """
    rows = docs.select("doc_id", row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    base = find(rows, "text", BASE, "base").select("doc_id", "key", "base", "text")
    base = saved(base.select("doc_id", "key", "base", _contexts(F.col("text"), F.col("base")).alias("found")), "pii-spans")
    told = disclosing(base.select(F.col("key.hash").alias("hash"), "found"), rows, support, generalise)
    told = saved(told.groupBy("term").agg((F.max("disclosure") >= remove).alias("removed")), "pii-told")
    base, none = base.drop("found"), F.array().cast(f"array<{SPAN}>")
    n = told.count()
    if not n:
        return base.withColumn("extra", none)
    terms = F.broadcast(told) if n <= sent else told
    held = rows.select("key", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(terms, "term", "left_semi")
    held = saved(held.select("key").distinct(), "pii-held")
    some = rows.join(F.broadcast(held), "key", "left_semi") if held.count() <= sent else rows  # texts stay where they lie
    found = some.select("key", "text", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("m"))
    found = found.select("key", "m", F.split("text", _WORD, -1).alias("g")).where(F.size("m") > 0)
    found = found.select("key", F.explode(located(F.col("m"), F.col("g"), F.lower)).alias("w")).select("key", "w.start", "w.end", F.col("w.value").alias("term"))
    found = found.join(terms, "term")
    span = F.struct("start", F.lit(len(BASE)).alias("place"), "end", F.when(F.col("removed"), REMOVED).otherwise(GENERAL).alias("kind"))
    per_row = found.select("key", span.alias("p")).groupBy("key").agg(F.sort_array(F.collect_set("p")).alias("extra"))
    return base.join(per_row, "key", "left").withColumn("extra", F.coalesce("extra", none))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with each strong span generalised to its kind, as ``<EMAIL>``, terms that tell most of an entity removed, and
    other disclosing terms generalised to ``<HINT>``. Rows without text keep their null; all columns stay, whatever their names."""
    found = personal(docs).select("key", F.sort_array(F.concat("base", "extra")).alias("spans")).dropDuplicates(["key"])
    label = lambda kind: F.when(kind == REMOVED, "").otherwise(F.concat(F.lit("<"), F.upper(kind), F.lit(">")))
    return with_text(docs, found, lambda text: replaced(text, F.col("spans"), label))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
