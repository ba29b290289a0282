"""Secrets in texts: strong patterns, and weak parts of a credential linked where they complement each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import row_key, saved, with_text
from tessella.llm.spans import SPAN, Kind, count_of, find, listed, replaced

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Kind("assign", _ASSIGN, lambda w: F.length(F.regexp_extract(w, _ASSIGN, 1)) >= 8),
    Kind("access", "AKIA[A-Z0-9]+", lambda w: F.length(w) >= 16),
    Kind("hex", "[0-9a-f]{32,}"),  # of runs of [0-9a-f]+ those of 32 and more
]
#: Where neighbours differ in lower case, upper case or digit. Random strings do in six of ten places, words and paths seldom.
_TURN = "[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"


def _random(w: Column) -> Column:
    kinds = w.rlike("[0-9]") & w.rlike("[a-z]") & w.rlike("[A-Z]")
    return kinds & (F.regexp_count(w, F.lit(_TURN)) >= F.length(w) * 0.3)


#: Parts that mean little alone: a name to log in with, a random-looking string, a place to log in to.
WEAK = [
    Kind("weak_access", r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{4,}"""),
    Kind("weak_secret", "[A-Za-z0-9+/_-]{20,}", _random),
    Kind("weak_endpoint", r"""(?:https?|ftp|jdbc:[a-z]+|mongodb|postgres|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""),
]
ACCESS, SECRET = ("access", "weak_access"), ("assign", "hex", "weak_secret")
#: Characters on either side of a part that are its scope.
SCOPE = 300


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans ``p`` of rows (key, p) that a complement stands beside.

    A complement is disjoint from the part and begins or ends at most ``scope`` characters from its
    ends. An access name needs a secret (weak, assigned or hexadecimal); a weak secret an access name or
    identifier; an endpoint one of each. Weak parts that overlap a strong span neither count nor are
    reported again, and neither does a random-looking string inside an endpoint.

    The interval join runs as sweeps: of the complements before a part the one that ends last
    decides, of those after it the one that starts first. So a key takes sorts and running extremes,
    never pairs, however many parts it has.
    """
    start, end, kind = F.col("p.start"), F.col("p.end"), F.col("p.kind")
    strong, place = F.col("p.place") < len(BASE), kind == "weak_endpoint"
    per = Window.partitionBy("key")
    up = lambda *order: per.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = lambda which: F.coalesce(F.max(F.when(which, end)).over(up("start")) > start, F.lit(False)) | F.coalesce(F.min(F.when(which, start)).over(up(F.desc("start"))) < end, F.lit(False))
    parts = parts.select("key", "p", start.alias("start"))
    parts = parts.select("key", "p", crossed(strong).alias("in_strong"), crossed(place).alias("in_place"))
    parts = parts.where(strong | ~(F.col("in_strong") | ((kind == "weak_secret") & F.col("in_place")))).select("key", "p")

    def nearest(df: DataFrame, at: Column, asked: Column, order, extreme, name: str) -> DataFrame:
        none = F.lit(None).cast("long")
        event = lambda at, asks, a, s: F.struct(at.alias("at"), F.lit(asks).alias("asks"), a.alias("a"), s.alias("s"))
        events = F.array(event(at, 0, F.when(kind.isin(*ACCESS), at), F.when(kind.isin(*SECRET), at)), event(asked, 1, none, none))
        df = df.select("*", F.explode(events).alias("e"))
        df = df.select("*", *(extreme(F.col(f"e.{c}")).over(up(order("e.at"), "e.asks")).alias(f"{name}_{c}") for c in "as"))
        return df.where("e.asks = 1").drop("e")

    parts = nearest(parts, end, start, F.asc, F.max, "before")
    parts = nearest(parts, start, end, F.desc, F.min, "after")
    near = lambda c: F.coalesce(start - F.col(f"before_{c}") <= scope, F.lit(False)) | F.coalesce(F.col(f"after_{c}") - end <= scope, F.lit(False))
    found = ((kind == "weak_access") & near("s")) | ((kind == "weak_secret") & near("a")) | (place & near("s") & near("a"))
    return parts.where(~strong & found).select("key", "p")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, key, base, extra) of each row of ``docs``: strong spans, and weak ones that are ``linked``.

    Null texts count as empty; long ones are searched whole, in time that grows little faster than
    their matches. Rows that agree in id and text give the same result, an empty table none. Other
    columns of ``docs``, whatever their names, play no part.
    """
    rows = docs.select("doc_id", row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = find(find(rows, "text", BASE, "base"), "text", WEAK, "weak", len(BASE))
    rows = saved(rows.select("doc_id", "key", "base", "weak"), "secret-spans")
    some = rows.where(F.size("weak") > 0).select("key", F.concat("base", "weak").alias("all"))
    some = some.where(F.exists("all", lambda x: x["kind"].isin(*ACCESS)) & F.exists("all", lambda x: x["kind"].isin(*SECRET)))
    found = linked(some.dropDuplicates(["key"]).select("key", F.explode("all").alias("p")), scope)
    found = found.groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("extra"))
    return rows.drop("weak").join(found, "key", "left").withColumn("extra", F.coalesce("extra", F.array().cast(f"array<{SPAN}>")))


def digest(found: DataFrame, kinds: list[Kind]) -> DataFrame:
    """A row's counts, the hash of its strong spans, the list of all spans and their number."""
    base = F.col("base")
    every = F.sort_array(F.concat("base", "extra"))
    counts = (count_of(base, k.name).alias(f"n_{k.name}") for k in kinds)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret replaced by ``<SECRET>``. Rows without text keep their null; all columns stay, whatever their names."""
    found = secrets(docs).select("key", F.sort_array(F.concat("base", "extra")).alias("spans")).dropDuplicates(["key"])
    return with_text(docs, found, lambda text: replaced(text, F.col("spans"), lambda _: F.lit("<SECRET>")))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
