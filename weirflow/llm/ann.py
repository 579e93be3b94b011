"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weirflow.llm.common import once, written

#: Bounds of the sample that the tree is fitted on and of the queries that calibrate it.
SAMPLE, CALIBRATION = 20_000, 400
#: Members of a leaf, and queries, that one task compares at once.
MEMBER_BLOCK, QUERY_BLOCK = 4096, 2048
#: Vectors that a leaf should hold, one block of members, as each leaf that a query visits returns its k best; a node has
#: at most BRANCH children, and the broadcast tree at most LEAVES leaves.
LEAF, BRANCH, LEAVES = MEMBER_BLOCK, 12, 1728


@dataclass(frozen=True)
class Tree:
    """A k-means tree by rows: centre, children and, at the leaves, the leaf's number."""

    centres: np.ndarray
    children: tuple[tuple[int, ...], ...]
    leaf: tuple[int, ...]
    leaves: int
    visits: int = 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, going down to the nearest centre of each level."""
        out, at = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        todo = np.arange(len(x))
        while len(todo):
            for node in np.unique(at[todo]).tolist():
                own, kids = todo[at[todo] == node], self.children[node]
                if not kids:
                    out[own], at[own] = self.leaf[node], -1
                    continue
                c = self.centres[list(kids)]
                at[own] = np.array(kids)[(x[own] @ c.T * 2 - (c * c).sum(axis=1)).argmax(axis=1)]
            todo = np.flatnonzero(at >= 0)
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first: a queue holds every branch not taken by its inner product."""
        score = self.centres @ q
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = sorted(self.children[node], key=lambda k: -score[k])
                for k in kids[1:]:
                    heapq.heappush(queue, (-float(score[k]), k))
                node = kids[0]
            found.append(self.leaf[node])
        return found


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(axis=1)).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else x[rng.integers(len(x))] for j in range(len(c))])
    return c


def shape(n: int) -> tuple[int, int]:
    """(branch, depth) of the tree for ``n`` vectors: about n / LEAF leaves, LEAVES at most."""
    leaves = min(LEAVES, max(1.0, n / LEAF))
    depth = max(1, int(np.ceil(np.log(leaves) / np.log(BRANCH) - 1e-9)))
    return max(2, int(np.ceil(leaves ** (1 / depth) - 1e-9))), depth


def fit_tree(x: np.ndarray, branch: int, depth: int, seed: int = 5) -> Tree:
    """Split the sample by k-means on ``depth`` levels; a node that can't be split is a leaf."""
    rng = np.random.default_rng(seed)
    centres, children, leaf, leaves = [x.mean(axis=0)], [()], [-1], 0
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, level, rows = todo.pop()
        near = np.zeros(len(rows), np.int64)
        if level < depth:
            c = k_means(x[rows], branch, rng)
            near = (x[rows] @ c.T * 2 - (c * c).sum(axis=1)).argmax(axis=1)
        if len(np.unique(near)) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        kids = []
        for j in np.unique(near):
            kids.append(len(centres))
            centres.append(c[j])
            children.append(())
            leaf.append(-1)
            todo.append((kids[-1], level + 1, rows[near == j]))
        children[node] = tuple(kids)
    return Tree(np.stack(centres), tuple(children), tuple(leaf), leaves)


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float) -> Tree:
    """Widen the visits until ``recall`` of the true neighbours of the sample's first vectors lie in the visited leaves.

    The tree was not fitted on these. A sample's neighbours are farther than the whole table's, so that it needs no fewer visits.
    """
    own, leaf = x[: min(CALIBRATION, max(1, len(x) // 2))], tree.assign(x)
    rank = np.full((len(own), tree.leaves), tree.leaves, np.int64)
    for i, q in enumerate(own):
        for r, at in enumerate(tree.best_first(q, tree.leaves)):
            rank[i, at] = r + 1
    score = own @ x.T
    score[np.arange(len(own)), np.arange(len(own))] = -np.inf
    top = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(own), 0), np.int64)
    needed = np.sort(np.take_along_axis(rank, leaf[top], axis=1).ravel())
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else tree.leaves
    return Tree(tree.centres, tree.children, tree.leaf, tree.leaves, max(1, visits))


def usable(vec: Column) -> Column:
    """Vectors that take part: not null, not all zero, without null or non-finite components."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda v: v != 0)


def train(vectors: DataFrame, k: int, recall: float, sample: int = SAMPLE) -> Tree | None:
    """Tree and visits from at most ``sample`` vectors, those with the smallest hash of id and place."""
    n = vectors.count()
    share = min(1.0, 1.5 * sample / n) if n else 1.0
    h = F.xxhash64("id", F.lit("sample"))
    few = vectors.where(h <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    x = few.orderBy(h, "id").limit(sample).select("x").toArrow().column("x").combine_chunks()
    if not len(x):
        return None
    x = x.flatten().to_numpy().reshape(len(x), -1)
    held = min(CALIBRATION, len(x) // 2)
    return calibrate(fit_tree(x[held:], *shape(n)), x, k, recall)


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``queries`` holds.

    Nearness is the largest inner product in double precision; ties go to the smaller id. A query's own row is no
    candidate. Every usable vector is in the index, on the leaf that the tree assigns; a query goes to as many
    leaves, best bin first, as calibration needed for ``recall``. A leaf is searched in blocks of bounded size, and
    each block returns its ``k`` best, so that neither a hot leaf nor a query gathers unbounded rows. A query with
    fewer than ``k`` candidates found is searched again in all leaves.
    The tree has about a leaf for LEAF vectors, up to LEAVES, which bounds the broadcast; beyond LEAF * LEAVES vectors
    the leaves grow, and with them the comparisons of a query.
    Vectors that are null, zero or hold null or non-finite components take no part, as do null ids and vectors of
    another length than most, which have no inner product with them. Rows that repeat an id are rows of their own: each
    is a candidate for the others and, if asked for, answered by itself under its id. Empty tables give empty results;
    other columns are not read.
    """
    vec = F.col(vec_col)
    good = vectors.where(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("x"), F.coalesce(queries, F.lit(False)).alias("q"))
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], result)
    good = good.where(F.size("x") == lengths["d"])
    tree = train(good, k, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), *b.columns, pa.array(shared.value.assign(x))], names=["row", "id", "x", "q", "leaf"])
            row += b.num_rows

    # Written once, so that a row keeps its number.
    index = written(good.mapInArrow(place, "row bigint, id bigint, x array<double>, q boolean, leaf bigint"), "vectors")
    asked = index.where("q").select("row", "x")

    def visit(all_leaves: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shared.value
            for b in batches:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
                where = [t.best_first(q, t.leaves if all_leaves else t.visits) for q in x]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("x"), pa.array(where, pa.list_(pa.int64()))], names=["row", "x", "leaves"])

        return run

    blocks = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("blocks"))
    members = index.join(blocks, "leaf").select("leaf", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "id", "x")

    def search(rows: DataFrame, all_leaves: bool) -> DataFrame:
        went = rows.mapInArrow(visit(all_leaves), "row bigint, x array<double>, leaves array<bigint>").select("row", "x", F.explode("leaves").alias("leaf"))
        per_leaf = went.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
        left = went.join(blocks, "leaf").join(per_leaf, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row", "x")
        right = members.join(per_leaf, "leaf").select("leaf", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row", "id", "x")

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype({"query": "int64", "vec_id": "int64", "score": "float64"})
            q, c = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
            qi, cr, ci = a["row"].to_numpy(), b["row"].to_numpy(), b["id"].to_numpy()
            out = []
            for lo in range(0, len(q), 256):
                # One order of summation, whatever the block: equal vectors score exactly alike.
                s = np.einsum("id,jd->ij", q[lo : lo + 256], c, optimize=False)
                for i in range(len(s)):
                    ok = np.flatnonzero(cr != qi[lo + i])
                    row = s[i, ok]
                    if len(ok) > k:
                        least = -np.partition(-row, k - 1)[k - 1]
                        ok = ok[row >= least]
                        row = s[i, ok]
                    order = np.lexsort((ci[ok], -row))[:k]
                    out.append((np.full(len(order), qi[lo + i]), ci[ok][order], row[order]))
            return pd.DataFrame({"query": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

        key = ["leaf", "block", "part"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: compare(a, b), "query bigint, vec_id bigint, score double")
        order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(search(asked, False), "found")
    few = first.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = asked.join(few, asked["row"] == few["query"], "left_anti")
    rest = search(short, True) if not short.isEmpty() else first.limit(0)
    done = first.join(few.select("query"), "query", "left_semi")
    names = index.where("q").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return done.unionByName(rest).join(names, "query").select("query_id", "rank", "vec_id", "score")
