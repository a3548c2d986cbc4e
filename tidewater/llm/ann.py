"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order and posted in the inverted files of those POSTED pivots only. A
query visits the files of its own VISITED nearest pivots. In a file it sees the vectors whose first common pivot the file's
is, so that no pair meets twice; they are ranked by footrule distance, the nearer part by cosine of vectors rounded to
8 bits, and the best of all files by the exact cosine in double precision. Files of many vectors or queries are split into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

PIVOTS, DRAWN, PER_PIVOT = 1024, 4, 8  # at most so many pivots, from DRAWN times as many drawn vectors; one for 8 vectors at most
POSTED, VISITED, SHARE, LEAST = 16, 32, 0.9, 256
BLOCK, TOP, KEPT = 4096, 5, 64  # vectors or queries of a block; neighbours; candidates of a query that are scored exactly


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    v = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    # scaling by the largest component keeps squares of very large and very small ones in range
    scaled = v / np.abs(v).max(1, keepdims=True) if len(v) else v
    return v, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def spread(unit: np.ndarray, n: int, apart: float = 0.7) -> np.ndarray:
    """The first n vectors, passing over those close to an earlier one: pivots in one dense cluster would outvote the rest."""
    kept: list[int] = []
    for i in range(len(unit)):
        if len(kept) < n and (not kept or (unit[kept] @ unit[i]).max() <= apart):
            kept.append(i)
    rest = [i for i in range(len(unit)) if i not in set(kept)] if len(kept) < min(n, len(unit)) else []
    return unit[kept + rest[: n - len(kept)]]


def orders(unit: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """[vector, place]: the n nearest pivots, nearest first; ties by the pivot's number."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int16)


def rounded(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as whole numbers up to 127."""
    return np.rint(unit / np.abs(unit).max(1, keepdims=True) * 127).astype(np.int8) if len(unit) else unit.astype(np.int8)


def search_file(pivot: int, near: np.ndarray, coded: np.ndarray, query_near: np.ndarray, query_unit: np.ndarray, kept: int, share: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, members, cosines to 8 bits) for each query of a pivot's file: the best of the footrule's nearest part.

    A pivot that isn't posted has a place far behind all that are.
    """
    n, far = len(near), 4 * query_near.shape[1]
    size = int(max(near.max(), query_near.max())) + 1
    place = np.full((size, n), far, np.int16)
    place[near, np.arange(n)[:, None]] = np.arange(near.shape[1], dtype=np.int16)
    vectors = coded.astype(np.float32)
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-9)
    asked = np.arange(query_near.shape[1], dtype=np.int16)[:, None]
    for q, mine in enumerate(query_near):
        files = place[mine]
        here = int(np.flatnonzero(mine == pivot)[0])
        own = np.flatnonzero((files[:here] == far).all(0))
        part = max(LEAST, int(np.ceil(share * len(own))))
        if part < len(own):
            distance = np.abs(files[:, own] - asked).sum(0, dtype=np.int32)
            own = own[np.argpartition(distance, part - 1)[:part]]
        score = vectors[own] @ query_unit[q].astype(np.float32)
        best = np.argpartition(-score, kept - 1)[:kept] if len(own) > kept else np.arange(len(own))
        yield q, own[best], score[best]


def vectors_of(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows with an id whose vectors aren't null, empty or zero and have finite components only."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def drawn(classes: DataFrame, dim: int, most: int) -> DataFrame:
    """(cid, h) of the `most` vectors of a dimension with the smallest hashes, which each task cuts to that number."""
    return classes.filter(F.col("dim") == dim).select("cid", F.xxhash64("v").alias("h")).orderBy("h", "cid").limit(most)


def _described(rows: DataFrame, shipped, posted: int) -> DataFrame:
    """(dim, cid, near, code, v): the nearest pivots of each vector, and the vector to 8 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for dim, part in x.groupby("dim"):
                unit = _unit(part["v"])[1]
                near = orders(unit, shipped.value[dim], posted)
                yield pd.DataFrame({"dim": part["dim"], "cid": part["cid"], "near": list(near), "code": [c.tobytes() for c in rounded(unit)], "v": part["v"]})

    return rows.select("dim", "cid", "v").mapInPandas(run, "dim int, cid long, near array<short>, code binary, v array<double>")


def nearest(rows: DataFrame, is_query, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, posted: int = POSTED, visited: int = VISITED, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest by cosine for each row that `is_query` (a Column over id) picks.

    Equal vectors enter the index once, with their top + 1 smallest ids; equal queries are searched once. The
    pivots come from the DRAWN * `pivots` distinct vectors with the smallest hashes, a bound that doesn't grow. Vectors
    of different lengths aren't comparable: each length is an index of its own. Vectors that are null,
    zero or hold null or non-finite components take no part; of a repeated id with different vectors the one with the smallest hash counts; fewer candidates
    than `top` are all returned; an empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    have = vectors_of(rows, id_col, vector_col).groupBy("id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("x")).select("id", "x.v")
    members = have.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("n") <= top + 1)
    classes = stored(members.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "v", "ids", F.size("v").alias("dim")))
    queries = stored(have.filter(is_query).join(classes.select("cid", F.col("v").alias("cv")), F.col("v") == F.col("cv")).select("id", "cid"))
    asked = stored(queries.select("cid").distinct().join(classes, "cid").select("cid", "v", "dim"))
    chosen: dict[int, np.ndarray] = {}
    for dim, n in classes.groupBy("dim").count().collect():
        ids = [r["cid"] for r in drawn(classes, dim, DRAWN * pivots).collect()]
        held = {r["cid"]: r["v"] for r in classes.filter(F.col("cid").isin(ids)).select("cid", "v").collect()}
        chosen[dim] = spread(_unit(pd.Series([held[i] for i in ids]))[1], min(pivots, max(posted, n // PER_PIVOT)))
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shipped = spark.sparkContext.broadcast(chosen)
    index = stored(_described(classes, shipped, posted))
    calls = stored(_described(asked, shipped, visited))
    files = index.select("dim", "cid", "code", "near", F.explode("near").alias("pivot"))
    visits = calls.select("dim", "cid", "code", "near", F.explode("near").alias("pivot"))
    # at most `pivots` rows a dimension
    size = lambda df, name: df.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = F.broadcast(size(index.select("dim", F.explode("near").alias("pivot")), "bs").join(size(calls.select("dim", F.explode("near").alias("pivot")), "qs"), ["dim", "pivot"]))
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    files = files.join(blocks, ["dim", "pivot"]).withColumn("b", deal("bs")).withColumn("q", every("qs")).select("dim", "pivot", "b", "q", "cid", "code", "near")
    visits = visits.join(blocks, ["dim", "pivot"]).withColumn("q", deal("qs")).withColumn("b", every("bs")).select("dim", "pivot", "b", "q", "cid", "code", "near")

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": np.zeros(0, np.int64), "cid": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        coded, query = (np.frombuffer(b"".join(x["code"]), np.int8).reshape(len(x), -1) for x in (left, right))
        near, query_near = (np.stack(x["near"]).astype(np.int64) for x in (left, right))
        unit = query / np.maximum(np.sqrt((query.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-9)
        ids, asks = left["cid"].to_numpy(), right["cid"].to_numpy()
        found = [(np.full(len(m), asks[q]), ids[m], s) for q, m, s in search_file(key[1], near, coded, query_near, unit, 4 * (top + 1), share)]
        return pd.DataFrame(dict(zip(("qid", "cid", "score"), map(np.concatenate, zip(*found)))))

    keys = ["dim", "pivot", "b", "q"]
    found = files.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(search, "qid long, cid long, score double")
    kept = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "cid"))).filter(F.col("r") <= max(KEPT, top + 1)).select("qid", "cid")
    pairs = stored(kept).join(classes.select("cid", "v"), "cid").join(asked.select(F.col("cid").alias("qid"), F.col("v").alias("qv")), "qid")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            score = np.zeros(len(x))
            for _, at in x.groupby(x["v"].map(len)).indices.items():
                # a sum in a fixed order, so that equal vectors score equally wherever they are
                score[at] = np.einsum("ij,ij->i", _unit(x["v"].iloc[at])[1], _unit(x["qv"].iloc[at])[1])
            yield pd.DataFrame({"qid": x["qid"], "cid": x["cid"], "score": np.clip(score, -1.0, 1.0)})

    scored = pairs.select("qid", "cid", "v", "qv").mapInPandas(exact, "qid long, cid long, score double")
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "cid"))).filter(F.col("r") <= top + 1)
    every_id = best.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    every_id = every_id.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= top + 1)
    lists = every_id.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))).alias("found"))
    mine = queries.join(lists, F.col("cid") == F.col("qid")).select("id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, top).alias("found"))
    return mine.select(F.col("id").alias("query_id"), F.posexplode("found").alias("i", "f")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.d")).alias("score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
