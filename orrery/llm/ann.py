"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Vectors get one more component, so that the largest inner product is the least Euclidean distance, and are
rotated at random, so that any leading components estimate a whole distance. Lists, about as many as the
square root of the rows, come from k-means. Every probed list is scanned in blocks of columns; after each
block a hypothesis test on the partial distances (Gao and Long 2023) abandons the vectors that can hardly
be among a query's best. The bound for that comes from the query's nearest lists, which are scanned first
and have none yet. What is left is scored in double precision on the original vectors.

Lists, their vectors and the queries that probe them meet in tasks of bounded size: a list's vectors and
its queries are each cut into chunks, and every chunk of one meets every chunk of the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Rows of each list, on average, that the index is fitted on at most; every row is indexed.
SAMPLE_PER_LIST = 64
LEAST_SAMPLE = 20_000
ROUNDS = 6
#: Centres are broadcast: at most so many bytes of them. At 64 columns that is half a million lists, the square root of 2.6e11 rows.
CENTRE_BYTES = 128 << 20
#: Rows that a query's first lists hold at least, as a multiple of k.
FIRST_ROWS = 2
#: Columns of the first block, for which all distances are one product, and of the later ones.
FIRST_COLUMNS, BLOCK_COLUMNS = 32, 16
#: Of the hypothesis test: larger keeps more candidates.
EPSILON = 3.0
TARGET_RECALL = 0.97
#: Queries whose neighbours within the sample tell how many lists to probe.
TRIALS = 256
#: Vectors, and queries, that a task holds, in bytes; pairs and distances that it looks at together.
CHUNK_BYTES, PAIRS = 16 << 20, 4 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vector is not null, has only finite components and is not zero, of the most frequent length."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null")
    rows = rows.filter(F.size(v) > 0).filter(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (width.n if width else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rows_dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, so that equal vectors get equal scores."""
    return (x * q).sum(1)


@dataclass
class Index:
    centres: np.ndarray  # of the lists, lengthened and rotated, in single precision
    rotation: np.ndarray
    longest: float  # squared norm
    probes: int = 1
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # rows of each list

    def points(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))
        return np.c_[x, more] @ self.rotation

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Of unit length: a query's scale doesn't change what is nearest."""
        return np.c_[q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros(len(q))] @ self.rotation

    def lists(self, points: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each point, a block of points at a time."""
        n = min(n, len(self.centres))
        norms, out = (self.centres**2).sum(1)[None, :], np.zeros((len(points), n), np.int64)
        step = max(1, PAIRS // len(self.centres))
        for a in range(0, len(points), step):
            d = norms - 2 * points[a : a + step].astype(np.float32) @ self.centres.T
            near = np.argpartition(d, n - 1, 1)[:, :n]
            out[a : a + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1), 1)
        return out


def _centres(sample: DataFrame, index: Index, rounds: int) -> np.ndarray:
    """Rounds of k-means over the sample, in tasks: each sums up its rows list by list, the sums of a list meet, and a round's centres come back. A list without rows keeps its centre."""
    spark = sample.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            i: Index = shared.value
            total, n = {}, {}
            for batch in batches:
                p = i.points(matrix(batch.column(0)))
                own = i.lists(p)[:, 0]
                by = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(own[by]) > 0])
                for k, s, c in zip(own[by[first]].tolist(), np.add.reduceat(p[by], first), np.diff(np.r_[first, len(by)])):
                    total[k], n[k] = total.get(k, 0) + s, n.get(k, 0) + int(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], ["list", "n", "total"])

        def mean(group: pa.Table) -> pa.Table:
            return pa.table({"list": pa.array([group.column("list")[0].as_py()]), "centre": pa.array([(matrix(group.column("total")).sum(0) / sum(group.column("n").to_pylist())).tolist()], pa.list_(pa.float64()))})

        sums = sample.select("v").mapInArrow(run, "list long, n long, total array<double>")
        got = sums.groupBy("list").applyInArrow(mean, "list long, centre array<double>").toArrow()  # a row per list, at most CENTRE_BYTES of them
        centres = index.centres.copy()
        if got.num_rows:
            centres[got.column("list").to_numpy()] = matrix(got.column("centre"))
        index = Index(centres, index.rotation, index.longest)
        shared.unpersist()
    return index.centres


def _probes(sample: DataFrame, index: Index, trials: np.ndarray, ids: np.ndarray, k: int, target: float) -> int:
    """The least number of probes that reaches the target recall for the trial rows' neighbours within the sample."""
    shared = sample.sparkSession.sparkContext.broadcast((index, trials, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, q, own = shared.value
        asked = i.queries(q)
        order = i.lists(asked, len(i.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        for batch in batches:
            p, at = i.points(matrix(batch.column(1))), batch.column(0).to_numpy()
            held = i.lists(p)[:, 0]
            score = asked @ p.T
            score[own[:, None] == at[None, :]] = -np.inf
            n = min(k, len(p))
            top = np.argpartition(-score, n - 1, 1)[:, :n]
            which = np.repeat(np.arange(len(q)), n)
            s = np.take_along_axis(score, top, 1).ravel()
            keep = s > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(which[keep]), pa.array(s[keep]), pa.array(place[which, held[top.ravel()]][keep])], ["q", "s", "place"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "place")
    best = sample.select("vec_id", "v").mapInArrow(run, "q long, s double, place long").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    needed = np.sort(best.select("place").toArrow().column("place").to_numpy())  # at most k rows of each trial
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1 if len(needed) else 1


def fit(vectors: DataFrame, *, sample_per_list: int = SAMPLE_PER_LIST, centre_bytes: int = CENTRE_BYTES, target: float = TARGET_RECALL, k: int = 20, seed: int = 11) -> Index | None:
    """An index of about sqrt(rows) lists, fitted on at most sample_per_list rows of each list (LEAST_SAMPLE at least), and the number of lists to probe. None without rows."""
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"), F.first(F.size("v")).alias("width")).first()
    if not stats.n:
        return None
    rng, d = np.random.default_rng(seed), stats.width + 1
    lists = int(max(1, min(round(stats.n**0.5), centre_bytes // (4 * d))))
    rows = min(stats.n, max(LEAST_SAMPLE, sample_per_list * lists))
    # the rows of least hash; twice the share is more than enough of them, and the rest goes before anything is sorted
    part = vectors if rows == stats.n else vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 2 * rows / stats.n) * (1 << 30)))
    sample = written(part.repartition(max(1, rows * d * 8 // CHUNK_BYTES), "vec_id"), "sample")
    index = Index(np.zeros((1, d), np.float32), np.linalg.qr(rng.normal(size=(d, d)))[0], stats.longest * (1 + 1e-12))
    seeds = matrix(sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(lists, TRIALS)).select("v").toArrow().column("v"))  # as many as centres
    distinct = np.unique(index.points(seeds[:lists]).astype(np.float32), axis=0)
    index.centres = distinct[rng.permutation(len(distinct))]
    index.centres = _centres(sample, index, ROUNDS)
    picked = sample.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(TRIALS).toArrow()
    index.probes = _probes(sample, index, matrix(picked.column("v")), picked.column("vec_id").to_numpy(), k, target)
    discard(sample)
    return index


def scan(points: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs that may be within each query's bound (a squared distance): column block by column block, abandoning what the test rejects."""
    d = points.shape[1]
    points, queries = points.astype(np.float32), queries.astype(np.float32)
    limit = lambda b: (bound * (b / d) * (1 + EPSILON / np.sqrt(b)) ** 2 if b < d else bound) * (1 + 1e-5) + 1e-5
    b = min(d, FIRST_COLUMNS)
    x, y = points[:, :b], queries[:, :b]
    part = y @ x.T
    part *= -2
    part += (y * y).sum(1)[:, None]
    part += (x * x).sum(1)[None, :]
    q, p = np.nonzero(part <= limit(b)[:, None])
    part = part[q, p]
    for a in range(b, d, BLOCK_COLUMNS):
        b = min(d, a + BLOCK_COLUMNS)
        more = points[p, a:b] - queries[q, a:b]
        part = part + np.einsum("ij,ij->i", more, more)
        keep = part <= limit(b)[q]
        q, p, part = q[keep], p[keep], part[keep]
    return q, p


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, ties to the smaller id."""
    by = np.lexsort((ids, -score, q))
    first = np.searchsorted(q[by], q[by])
    return by[np.arange(len(by)) - first < k]


def scanned(i: Index, v_ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, qv: np.ndarray, worst: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vec ids, scores) of the k best of some vectors for each of some queries, a block of queries at a time. worst: the score a query has k of already, else null."""
    points, asked = i.points(v), i.queries(qv)
    # a score of `worst` is this squared distance between a lengthened vector and the query at unit length
    bound = np.where(np.isnan(worst), np.inf, i.longest + 1 - 2 * worst / np.sqrt((qv * qv).sum(1)))
    step = max(1, PAIRS // len(v))
    for a in range(0, len(qv), step):
        q, p = scan(points, asked[a : a + step], bound[a : a + step])
        q += a
        other = v_ids[p] != q_ids[q]
        q, p = q[other], p[other]
        score = np.concatenate([rows_dot(v[p[c : c + 65536]], qv[q[c : c + 65536]]) for c in range(0, len(p), 65536)] or [np.zeros(0)])
        top = best_of(q, v_ids[p], score, k)
        yield q_ids[q[top]], v_ids[p[top]], score[top]


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", index: Index | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found, itself left out; ties to the smaller vec_id.

    Vectors that are null, zero, of another length or hold null or non-finite components take no part, as
    queries or candidates, and neither do rows without an id. A row that repeats an id is a candidate of its own.
    Other columns are ignored. No usable vectors, or no queries: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    index = index or fit(rows, k=k)
    out = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], out)
    width = index.rotation.shape[0] - 1
    chunk = max(1, chunk_bytes // (8 * width))
    shared = spark.sparkContext.broadcast(index)
    asked = usable(queries, id_col, vector_col).filter(F.size("v") == width)

    def listed(of: Callable[[Index, np.ndarray], list]):
        @F.pandas_udf("array<int>")
        def lists(v: pd.Series) -> pd.Series:
            return pd.Series(of(shared.value, np.stack(v.to_numpy())))

        return lists("v")

    placed = written(rows.withColumn("list", listed(lambda i, x: list(i.lists(i.points(x)).astype(np.int32)))[0]), "placed")
    counts = placed.groupBy("list").count().collect()  # a row per list
    index.sizes = np.bincount([r.list for r in counts], [r["count"] for r in counts], len(index.centres)).astype(np.int64)
    shared = spark.sparkContext.broadcast(index)

    def probed(i: Index, x: np.ndarray) -> list:
        """Twice each probed list's number; odd: of the first ones, which hold enough rows for a bound."""
        near = i.lists(i.queries(x), i.probes)
        size = i.sizes[near]
        return list((2 * near + (np.cumsum(size, 1) - size < FIRST_ROWS * k)).astype(np.int32))

    probing = written(asked.select("vec_id", "v", F.explode(listed(probed)).alias("code")).select("vec_id", "v", F.expr("code div 2").cast("int").alias("list"), (F.col("code") % 2 == 1).alias("first")), "probing")

    def met(probing: DataFrame) -> DataFrame:
        """Every chunk of a list's vectors with every chunk of the queries that probe it."""
        chunks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
        # a row per list, of which the centres' bytes bound the number; hot lists are dealt by chunk, not by list
        sizes = F.broadcast(chunks(placed, "v_chunks").join(chunks(probing, "q_chunks"), "list"))
        own = F.pmod(F.xxhash64("vec_id"), F.col("own")).cast("int")
        none = F.lit(None).cast("double").alias("worst")
        a = placed.join(sizes, "list").withColumn("own", F.col("v_chunks")).select("list", own.alias("vc"), F.explode(F.expr("sequence(0, q_chunks - 1)")).alias("qc"), F.lit(False).alias("query"), "vec_id", "v", none)
        b = probing.join(sizes, "list").withColumn("own", F.col("q_chunks")).select("list", F.explode(F.expr("sequence(0, v_chunks - 1)")).alias("vc"), own.alias("qc"), F.lit(True).alias("query"), "vec_id", "v", "worst")

        def meet(group: pa.Table) -> pa.Table:
            is_query = group.column("query").to_numpy()
            ids, x, worst = group.column("vec_id").to_numpy(), matrix(group.column("v")), group.column("worst").to_numpy()
            got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if is_query.any() and not is_query.all():
                got += scanned(shared.value, ids[~is_query], x[~is_query], ids[is_query], x[is_query], worst[is_query], k)
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*got)))))

        return a.unionByName(b).groupBy("list", "vc", "qc").applyInArrow(meet, "query_id long, vec_id long, score double")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = met(probing.filter("first").withColumn("worst", F.lit(None).cast("double")))
    near = written(near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "near")
    bound = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    found = near.drop("rank").unionByName(met(probing.filter("not first").join(bound, "vec_id", "left")))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
