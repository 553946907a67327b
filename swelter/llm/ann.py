"""Nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample (SAMPLE vectors): each node splits its sample at
the median of the projection on the difference of two of its vectors. Every vector is
indexed in one leaf of each tree. A query takes the leaves of all trees in one shared
order of priority, by the largest margin that it crosses on the way to them, and the best
of the forest, whichever tree they are in, give the candidates. How many leaves that is
follows from the table: the true neighbours of RECALL_QUERIES queries are looked up, and
as many leaves are taken as find RECALL of them. Candidates are reranked exactly, leaf by
leaf, in blocks of bounded size.

Inner products become distances by one more component, sqrt(max norm^2 - norm^2), 0 for
queries. Equal vectors are indexed once with their smallest ids, as many as a result
can name, so copies cost nothing and none that a result needs is lost. Index and routes
hold vectors as bytes, in the table's own precision, so scores are of the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.llm.common import written

SAMPLE, TREES, LEAF_ROWS, LEAVES = 1 << 14, 12, 256, 96
#: Share of the true neighbours that is found at least, and queries it is measured on.
RECALL, RECALL_QUERIES = 0.9, 256
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512


@dataclass
class Forest:
    """normals[t, node], offsets[t, node] of complete binary trees; leaves are numbered after the inner nodes."""

    depth: int
    normals: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, n_rows: int, trees: int, leaf_rows: int, seed: int = 7) -> Forest:
        """Deep enough for leaf_rows a leaf, but no deeper than the sample can tell."""
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        depth = max(0, min(int(np.ceil(np.log2(max(1, n_rows / leaf_rows)))), int(np.log2(max(1, n / 8)))))
        normals, offsets = np.zeros((trees, 2**depth - 1, d), dtype=np.float32), np.zeros((trees, 2**depth - 1), dtype=np.float32)
        for t in range(trees):
            held = {0: np.arange(n)}
            for node in range(2**depth - 1):
                own = held.pop(node)
                pick = rng.choice(own, 2) if len(own) else None
                normal = sample[pick[0]] - sample[pick[1]] if pick is not None else np.zeros(d)
                if not normal.any():
                    normal = rng.standard_normal(d)
                normal = normal / np.linalg.norm(normal)
                at = sample[own] @ normal
                normals[t, node], offsets[t, node] = normal, np.median(at) if len(own) else 0
                right = at > offsets[t, node]
                held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
        return cls(depth, normals, offsets)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.normals)), dtype=np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - (2**self.depth - 1)
        return out

    def costs(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, leaves): the largest margin that each row crosses on its way to a leaf, 0 for its own."""
        at = np.zeros((len(x), len(self.normals), 1), dtype=np.float32)
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            margin = np.tensordot(x.astype(np.float32), self.normals[:, nodes], ([1], [2])) - self.offsets[:, nodes]
            far, right = np.maximum(at, np.abs(margin)), margin > 0
            at = np.stack([np.where(right, far, at), np.where(right, at, far)], axis=3).reshape(len(x), len(self.normals), -1)
        return at

    def search(self, x: np.ndarray, n_leaves: int) -> np.ndarray:
        """(rows, n_leaves): the best leaves of all trees for each row, as tree x leaves a tree + leaf."""
        flat = self.costs(x).reshape(len(x), -1)
        return np.argsort(flat, axis=1, kind="stable")[:, :n_leaves]


def distinct_vectors(rows: DataFrame, key: str, vector: str, n_ids: int) -> DataFrame:
    """(vid, vec, ids, norm2): each usable vector once, with its n_ids smallest ids.

    Null, empty and zero vectors and those with null or non-finite components are left
    out, as are null ids. The window keeps n_ids rows of a vector in each task before it
    shuffles. vid is the smallest id.
    """
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    found = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), vec.alias("vec")).where(F.coalesce(ok, F.lit(False)))
    first = found.withColumn("rn", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("rn") <= n_ids)
    out = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return out.select(F.element_at("ids", 1).alias("vid"), "vec", "ids", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"))


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vecs])


def _packed(x: np.ndarray, precision: str) -> list[bytes]:
    return [v.tobytes() for v in x.astype(precision)]


def _unpacked(vecs: pd.Series, precision: str) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype=precision).reshape(len(vecs), -1).astype(np.float64)


def leaves_needed(forest: Forest, base: DataFrame, asked: DataFrame, k: int, most: float) -> int:
    """The fewest leaves a query that find RECALL of the k nearest of RECALL_QUERIES queries among base (vid, vec).

    Two standard errors less than the measured mean must reach it, unless no query is
    left out. Each neighbour is found from the first of its leaves in the query's order.
    """
    drawn = asked.select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(RECALL_QUERIES + 1).toPandas()
    partial, drawn = len(drawn) > RECALL_QUERIES, drawn.iloc[:RECALL_QUERIES]
    everything = forest.normals.shape[0] * 2**forest.depth
    if not len(drawn):
        return everything
    q, qid = _matrix(drawn["vec"]), drawn["vid"].to_numpy()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vid, vec, score = (np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0, q.shape[1])), np.zeros((len(q), 0)))
        for b in batches:
            if not len(b):
                continue
            own, v = b["vid"].to_numpy(), _matrix(b["vec"])
            near = np.where(own[None, :] == qid[:, None], -np.inf, q @ v.T)
            top = np.argpartition(-near, min(k, len(own)) - 1, axis=1)[:, :k]
            vid, vec = np.hstack([vid, own[top]]), np.concatenate([vec, v[top]], axis=1)
            score = np.hstack([score, np.take_along_axis(near, top, axis=1)])
            keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
            vid, score = np.take_along_axis(vid, keep, axis=1), np.take_along_axis(score, keep, axis=1)
            vec = np.take_along_axis(vec, keep[:, :, None], axis=1)
        at = forest.leaves(_lifted(vec.reshape(-1, q.shape[1]), most).astype(np.float32)).tolist() if vid.size else []
        out = pd.DataFrame({"q": np.repeat(np.arange(len(q)), vid.shape[1]), "vid": vid.ravel(), "score": score.ravel(), "leaves": at})
        yield out[np.isfinite(out["score"])]

    found = base.select("vid", "vec").mapInPandas(nearest, "q int, vid long, score double, leaves array<long>")
    found = found.withColumn("rn", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vid"))).where(F.col("rn") <= k).select("q", "leaves").toPandas()
    if not len(found):
        return everything
    places = []
    for i, group in found.groupby("q"):
        order = forest.search(_asked(q[i : i + 1], most), everything)[0]
        rank = np.empty(everything, dtype=np.int64)
        rank[order] = np.arange(everything)
        at = np.stack(group["leaves"].to_list()) + np.arange(len(forest.normals)) * 2**forest.depth
        places.append(np.sort(rank[at].min(axis=1)))
    tries = np.unique(np.concatenate(places)) + 1
    share = np.stack([np.searchsorted(p, tries) / len(p) for p in places])
    sure = share.mean(axis=0) - (2 * share.std(axis=0, ddof=1) / np.sqrt(len(share)) if partial else 0)
    return int(tries[np.argmax(sure >= RECALL)])


def searched(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaves: int = LEAVES, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query but itself.

    rows, queries: tables with key and vector; queries are rows of the table. Vectors
    must share one length; those of another length than most are left out. Ties go to
    the smaller id. Ids that repeat with different vectors are candidates with each.
    leaves: visited at least; more are if recall needs them (leaves_needed).
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    precision = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    base = distinct_vectors(rows, key, vector, k + 1)
    base = written(base, "vectors")
    sizes = base.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max("norm2").alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n_rows, most = sizes[0]
    base = base.where(F.size("vec") == d)
    drawn = base.select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(sample).toPandas()
    # travels with the tasks: at most trees x sample / 8 nodes
    forest = Forest.fit(_lifted(_matrix(drawn["vec"]), most), n_rows, trees, LEAF_ROWS)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["vec"])
                at, vec = forest.leaves(_lifted(x, most).astype(np.float32)), _packed(x, precision)
                for t in range(at.shape[1]):
                    yield pd.DataFrame({"tree": t, "leaf": at[:, t], "vid": b["vid"], "vec": vec})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["vec"])
                vec, x = np.array(_packed(x, precision), dtype=object), _asked(x, most)
                for first in range(0, len(x), 128):  # bounds the memory of the costs
                    got = forest.search(x[first : first + 128], visited)
                    i = first + np.repeat(np.arange(len(got)), got.shape[1])
                    yield pd.DataFrame({"tree": got.ravel() >> forest.depth, "leaf": got.ravel() & (2**forest.depth - 1), "qid": b["vid"].to_numpy()[i], "qvec": vec[i]})

    places = written(base.select("vid", "vec").mapInPandas(index, "tree int, leaf long, vid long, vec binary"), "forest")
    # of each query vector one row, named by its vector's vid
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("vec"))
    asked = asked.join(base.select("vid", F.col("vec").alias("_v")), F.col("vec") == F.col("_v")).select("query_id", "vid")
    asked = written(asked, "asked")
    unique = base.join(asked.select("vid").distinct(), "vid", "left_semi").select("vid", "vec").repartition(max(8, spark.sparkContext.defaultParallelism), "vid")
    visited = max(leaves, leaves_needed(forest, base, unique, k, most))
    routes = written(unique.mapInPandas(walk, "tree int, leaf long, qid long, qvec binary"), "routes")

    # leaves are cut into blocks of rows and queries, each pair of blocks one group
    blocks = places.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rb")).join(
        routes.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qb")), ["tree", "leaf"])
    blocks = written(blocks, "blocks")
    of = lambda df, i, own, other: df.join(blocks, ["tree", "leaf"]).withColumns({own: F.pmod(F.xxhash64(i), F.col(own + "b")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other + "b") - 1))}).drop("rb", "qb")
    left, right = of(places, "vid", "r", "q"), of(routes, "qid", "q", "r")
    group = ["tree", "leaf", "r", "q"]

    def rerank(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"qid": [], "vid": [], "score": []}).astype({"qid": "int64", "vid": "int64", "score": "float64"})
        order = np.argsort(rows["vid"].to_numpy(), kind="stable")
        vid, v, q = rows["vid"].to_numpy()[order], _unpacked(rows["vec"], precision)[order], _unpacked(asks["qvec"], precision)
        near = q @ v.T
        n = min(k + 1, len(vid))
        # one more than needed at the edge of rounding; the sums that count are made row by row
        top = np.argpartition(-near, n - 1, axis=1)[:, : n + 1] if n < len(vid) else np.tile(np.arange(len(vid)), (len(q), 1))
        i = np.repeat(np.arange(len(q)), top.shape[1])
        j = top.ravel()
        return pd.DataFrame({"qid": asks["qid"].to_numpy()[i], "vid": vid[j], "score": (q[i] * v[j]).sum(axis=1)})

    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(rerank, "qid long, vid long, score double")
    found = found.groupBy("qid", "vid").agg(F.max("score").alias("score"))
    best = found.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vid"))).where(F.col("rn") <= k + 1)
    # copies come in, then the k + 1 nearest ids of each query vector
    spread = best.join(base.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("id"))
    spread = spread.withColumn("rn", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rn") <= k + 1)
    lists = spread.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))).alias("l"))
    own = asked.join(lists, asked.vid == lists.qid).select("query_id", F.slice(F.filter("l", lambda x: x["id"] != F.col("query_id")), 1, k).alias("l"))
    return own.select("query_id", F.posexplode("l").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _asked(x: np.ndarray, most: float) -> np.ndarray:
    """Query vectors with the rows' largest norm and 0 for their last component."""
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(most), np.zeros((len(x), 1))]).astype(np.float32)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1, keepdims=True)))
    return np.hstack([x, rest])
