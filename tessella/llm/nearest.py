"""Nearest neighbours by inner product, through multiprobe p-stable hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import saved

#: Tables; projections of a table's hash; rows the index is fitted on; recall to reach on them; queries of one pass; rows of one step; queries that are measured.
TABLES, PROJECTIONS, SAMPLE, RECALL, QUERIES, STEP, MEASURED = 8, 4, 3000, 0.96, 4096, 4096, 64

SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass
class Index:
    """Hash functions floor((a.x + b) / w), ``PROJECTIONS`` to a table, over vectors with a component added.

    The largest inner product is the least distance once every row x gets the component
    sqrt(top^2 - |x|^2), and queries get 0.
    """

    a: np.ndarray
    b: np.ndarray
    width: float
    top: float
    probes: int = 1
    whole: bool = False

    def project(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """(rows, tables, projections) in units of the width."""
        return (np.einsum("nd,tpd->ntp", x, self.a[:, :, :-1]) + extra[:, None, None] * self.a[None, :, :, -1] + self.b) / self.width

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.floor(self.project(x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0)))).astype(np.int64)

    def probe(self, q: np.ndarray) -> np.ndarray:
        """Buckets (queries, tables, probes, projections) in order of their estimated success: least squared distance to the bucket first."""
        at = self.project(q, np.zeros(len(q)))
        home = np.floor(at)
        inside = (at - home)[:, :, None, :]
        steps = np.array(list(product((-1, 0, 1), repeat=self.a.shape[1])))
        cost = np.where(steps == 0, 0, np.where(steps == 1, (1 - inside) ** 2, inside**2)).sum(3)
        order = np.argsort(cost, 2, kind="stable")[:, :, : self.probes]
        return home[:, :, None, :].astype(np.int64) + steps[order]


def _packed(buckets: np.ndarray) -> np.ndarray:
    return ((np.clip(buckets, -(1 << 14), (1 << 14) - 1) + (1 << 14)) << (15 * np.arange(buckets.shape[-1]))).sum(-1)


def candidates(row_keys: np.ndarray, probe_keys: np.ndarray) -> np.ndarray:
    """(queries, rows): whether any table has the row in a bucket that the query visits."""
    seen = np.zeros((len(probe_keys), len(row_keys)), bool)
    for t in range(row_keys.shape[1]):
        keys, back = np.unique(row_keys[:, t], return_inverse=True)
        place = np.minimum(np.searchsorted(keys, probe_keys[:, t]), len(keys) - 1)
        hit = np.zeros((len(probe_keys), len(keys)), bool)
        q, p = np.nonzero(keys[place] == probe_keys[:, t])
        hit[q, place[q, p]] = True
        seen |= hit[:, back]
    return seen


def fit(x: np.ndarray, k: int, longest: float = 0.0, tables: int = TABLES, projections: int = PROJECTIONS, recall: float = RECALL, seed: int = 9) -> Index:
    """Draws the hashes, and takes the fewest probes that find ``recall`` of the sample's own neighbours.

    A sample's neighbours lie farther off than those among all rows, and so are harder to find.
    ``longest`` is the largest norm of all rows. ``whole`` is set where no number of probes is enough.
    """
    rng = np.random.default_rng(seed)
    top = max(longest, float(np.sqrt((x * x).sum(1).max())) if len(x) else 0.0) * 1.0000001 or 1.0
    a = rng.normal(size=(tables, projections, x.shape[1] + 1))
    width = top
    index = Index(a, rng.uniform(0, width, (tables, projections)), width, top)
    queries = np.arange(0, len(x), max(1, len(x) // 200))
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    true = np.argsort(-score, 1)[:, : max(1, min(k, len(x) - 1))]
    keys = _packed(index.rows(x))
    for probes in (1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 81):
        index.probes = min(probes, 3**projections)
        seen = candidates(keys, _packed(index.probe(x[queries])))
        if len(x) < 2 or np.take_along_axis(seen, true, 1).mean() >= recall:
            return index
    index.whole = True
    return index


def _scores(q: np.ndarray, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Inner products of the pairs ``seen``, -inf of others. Where few pairs are, only those are computed; else one matrix product is cheaper."""
    if seen.mean() > 0.1:
        return np.where(seen, q @ x.T, -np.inf)
    score = np.full(seen.shape, -np.inf)
    at, place = np.nonzero(seen)
    for k in range(0, len(at), 65_536):
        a, b = at[k : k + 65_536], place[k : k + 65_536]
        score[a, b] = np.einsum("nd,nd->n", q[a], x[b])
    return score


def _best(score: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vec_id, exact score) of each query's best ``k`` of one step; ``ids`` ascend, -inf bars a row."""
    n = score.shape[1]
    most = np.abs(score[np.isfinite(score)]).max(initial=1e-300)
    coarse = np.where(np.isfinite(score), score / most, -4.0)
    key = (coarse * (1 << 42)).astype(np.int64) * (1 << 18) + (n - np.arange(n))
    take = min(n, 2 * k)
    found = np.argpartition(-key, take - 1, 1)[:, :take]
    at, place = np.repeat(np.arange(len(score)), take), found.reshape(-1)
    ok = np.isfinite(score[at, place])
    at, place = at[ok], place[ok]
    exact = (x[place] * q[at]).sum(1)
    order = np.lexsort((ids[place], -exact, at))
    at, place, exact = at[order], place[order], exact[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], ids[place[rank < k]], exact[rank < k]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of doubles that is not empty, null, zero, or with a null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by inner product, its own id apart.

    Queries, the stated ids divisible by ``every``, pass over all rows in blocks of 4,096, whatever
    their number; rows stay where they lie, and a task sends ``k`` rows a query. Each step merges the
    tables' buckets into candidates and reranks those alone, on the original vectors. A query that
    the probes leave with too few neighbours is then held against all rows. Some 64 queries are first
    searched both ways over all rows; where the probes find less than ``RECALL`` of what is there, or
    did so in the sample, every query is held against all rows.

    Repeated ids are searched each by its own vector and may be found repeatedly. Vectors are compared
    with those of their own length, each length under an index of its own. An empty table gives no
    rows. Other columns of ``vectors``, whatever their names, play no part.
    """
    rows = saved(usable(vectors), "nearest-rows")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # lengths of vectors, one in a table that was made by one model
    found = [_nearest(rows.where(F.size("v") == r["d"]), r["d"], r["count"], every, k) for r in sizes]
    return reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], SCHEMA)


def _nearest(rows: DataFrame, dims: int, total: int, every: int, k: int) -> DataFrame:
    spark, schema = rows.sparkSession, SCHEMA
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("m")).first()["m"] ** 0.5
    some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / total)).limit(2 * SAMPLE).collect()
    index = fit(np.array([r["v"] for r in sorted(some, key=lambda r: r["vec_id"])]).reshape(-1, dims), k, top)

    def search(queries: list, whole: bool) -> DataFrame:
        names = np.array([r["vec_id"] for r in queries], np.int64)
        sent = spark.sparkContext.broadcast((index, names, np.array([r["v"] for r in queries])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index, names, q = sent.value
            probes = None if whole else _packed(index.probe(q))
            held: list[pd.DataFrame] = []
            for b in batches:
                b = b.sort_values("vec_id", kind="stable")
                buckets = None if whole else _packed(index.rows(np.stack(b["v"].to_numpy())))
                for at in range(0, len(b), STEP):
                    ids, x = b["vec_id"].to_numpy()[at : at + STEP], np.stack(b["v"].to_numpy()[at : at + STEP])
                    for of in range(0, len(q), 1024):
                        some = q[of : of + 1024]
                        seen = names[of : of + 1024, None] != ids[None, :]
                        if not whole:
                            seen &= candidates(buckets[at : at + STEP], probes[of : of + 1024])
                        score = _scores(some, x, seen)
                        place, found, exact = _best(score, ids, x, q[of : of + 1024], k)
                        held.append(pd.DataFrame({"query": place + of, "query_id": names[place + of], "vec_id": found, "score": exact}))
                merged = pd.concat(held).sort_values(["query", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                held = [merged.groupby("query").head(k)]
            if held:
                yield held[0]

        return rows.mapInPandas(run, "query int, query_id long, vec_id long, score double")

    def passes(wanted: DataFrame, whole: bool) -> DataFrame | None:
        out, block, number = None, [], 0
        for r in wanted.toLocalIterator():
            block.append(r)
            if len(block) == QUERIES:
                found = search(block, whole).withColumn("pass", F.lit(number))
                out, block, number = found if out is None else out.union(found), [], number + 1
        if block:
            found = search(block, whole).withColumn("pass", F.lit(number))
            out = found if out is None else out.union(found)
        return out

    def recall(queries: list) -> float:
        """Share of the true neighbours of ``queries`` that probes find; ties with the last of them count as found."""
        scores = []
        for whole in (True, False):
            per = search(queries, whole).groupBy("query").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("s"))
            scores.append({r["query"]: np.array(r["s"]) for r in per.collect()})
        hits = [(scores[1].get(q, np.zeros(0)) >= s[-1] - 1e-12 * abs(s[-1])).sum() for q, s in scores[0].items()]
        return sum(hits) / max(1, sum(len(s) for s in scores[0].values()))

    wanted = rows.where(F.col("vec_id") % every == 0)
    if not index.whole:
        measured = wanted.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(MEASURED).collect()
        index.whole = bool(measured) and total > 1 and recall(measured) < RECALL
    found = passes(wanted, index.whole)
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("pass", "query").orderBy(F.desc("score"), "vec_id"))
    best = saved(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "pass", "query"), "nearest-found")
    # Of a repeated id all are redone if one is short.
    per = best.groupBy("query_id").agg(F.count_if(F.col("rank") == min(k, total - 1)).alias("full"))
    ids = wanted.groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("asked"))
    enough = ids.join(per, "query_id").where("full >= asked").select("query_id")
    short = wanted.join(enough, wanted["vec_id"] == enough["query_id"], "left_anti")
    again = passes(short, True) if total > 1 and not index.whole and not short.isEmpty() else None
    out = best.select("query_id", "rank", "vec_id", "score")
    if again is None:
        return out
    redone = again.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out.join(enough, "query_id", "left_semi").union(redone)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
