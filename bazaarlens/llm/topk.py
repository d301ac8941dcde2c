"""Exact top-k inner products: a dual-tree search over cover trees that hold queries and data together.

The top of the tree is fitted on a bounded sample: its pivots, a farthest-first net, cut space into regions, and every row
belongs to the region of its nearest pivot. Regions carry the covering radii of their queries and of their data and the
worst kth score of their queries so far (against the sample, which is part of the data). A pair of regions whose bound

    <p, q> + R_p |q| + R_q |p| + R_p R_q

stays under that score is dropped. What is left becomes cells of a grid, a chunk of queries by a block of one region's
data, both of bounded size however many rows a region has. Within a cell one cover tree is built over both, node pairs are
pruned by the same bound, and leaf pairs are scored from the best bound down. Scores are whole numbers, ties stay in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centroids import integer_vectors, matrix
from .common import stage

__all__ = ["CoverTree", "search_cell", "top_products"]

SAMPLE_ROWS = 4096     # rows that pivots are chosen from; also the first candidates of every query
PIVOTS = 64
CHUNK_QUERIES = 8192   # about so many queries meet
BLOCK_ROWS = 4096      # about so many rows of data in one cell
LEAF = 64
FAN = 8
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min


def farthest_first(x: np.ndarray, start: int, most: int, stop) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, each the point farthest from those before, until ``most`` or until no point is farther than stop(radius)."""
    centres = [start]
    far = np.sqrt(((x - x[start]) ** 2).sum(axis=1))
    owner, least = np.zeros(len(x), np.int64), stop(far.max())
    while len(centres) < most and far.max() > least:
        new = int(far.argmax())
        d = np.sqrt(((x - x[new]) ** 2).sum(axis=1))
        closer = d < far
        owner[closer], far[closer] = len(centres), d[closer]
        centres.append(new)
    return centres, owner, far


class CoverTree:
    """Nodes over points: a centre that is one of them and is kept by the first child, a covering radius, and children
    whose centres lie farther apart than half that radius (at most FAN of them). ``order`` lists the points so that every
    node owns a run [lo, hi)."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.centre, self.lo, self.hi, self.first, self.count = [], [], [], [], []
        if len(x):
            self._add(0, 0, len(x))
        i = 0
        while i < len(self.centre):
            own = self.order[self.lo[i]:self.hi[i]].copy()
            if len(own) > LEAF:
                start = int(np.flatnonzero(own == self.centre[i])[0])
                centres, owner, far = farthest_first(x[own], start, FAN, lambda r: r / 2)
                if len(centres) > 1:
                    places = np.argsort(owner, kind="stable")
                    self.order[self.lo[i]:self.hi[i]] = own[places]
                    at = self.lo[i] + np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(centres)))])
                    self.first[i], self.count[i] = len(self.centre), len(centres)
                    for c, a, b in zip(centres, at, at[1:]):
                        self._add(int(own[c]), int(a), int(b))
            i += 1
        for name in ("centre", "lo", "hi", "first", "count"):
            setattr(self, name, np.array(getattr(self, name), dtype=np.int64))

    def _add(self, centre: int, lo: int, hi: int) -> None:
        for name, value in (("centre", centre), ("lo", lo), ("hi", hi), ("first", 0), ("count", 0)):
            getattr(self, name).append(value)


def _radii(x: np.ndarray, tree: CoverTree, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node, how many of the masked points it holds and how far from its centre they lie at most."""
    n, r = np.zeros(len(tree.centre), np.int64), np.zeros(len(tree.centre))
    for i, (c, lo, hi) in enumerate(zip(tree.centre, tree.lo, tree.hi)):
        own = tree.order[lo:hi]
        own = own[mask[own]]
        n[i] = len(own)
        if len(own):
            r[i] = np.sqrt(((x[own] - x[c]) ** 2).sum(axis=1).max()) * (1 + SLACK)
    return n, r


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:   # whole numbers stay exact in doubles
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _best(query: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: score from high to low, then rank."""
    order = np.lexsort((rank, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[nth < k]


def search_cell(queries: np.ndarray, own: np.ndarray, least: np.ndarray, data: np.ndarray, ids: np.ndarray, rank: np.ndarray,
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, data, score) of each query's k best rows of data with at least score ``least``.

    ``own`` is each query's id and ``ids`` that of each row of data; a row of the query's own id is no candidate. ``rank``
    orders ties. Pruning keeps pairs that reach the bound exactly, so no tie is lost.
    """
    x = np.concatenate([queries, data])
    p = x.astype(float)
    tree = CoverTree(p)
    is_query = np.arange(len(x)) < len(queries)
    n_q, r_q = _radii(p, tree, is_query)
    n_d, r_d = _radii(p, tree, ~is_query)
    centre = p[tree.centre]
    norm = np.sqrt((centre ** 2).sum(axis=1)) * (1 + SLACK)
    worst = np.array([least[o].min(initial=np.iinfo(np.int64).max) for o in (tree.order[a:b][is_query[tree.order[a:b]]] for a, b in zip(tree.lo, tree.hi))], dtype=float)

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = (centre[a] * centre[b]).sum(axis=1) + r_q[a] * norm[b] + r_d[b] * norm[a] + r_q[a] * r_d[b]
        return top + SLACK * (norm[a] + r_q[a]) * (norm[b] + r_d[b]) + 1e-6

    a = b = np.zeros(1, np.int64)
    leaf_pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(a):
        top = bound(a, b)
        keep = (n_q[a] > 0) & (n_d[b] > 0) & (top >= worst[a])
        a, b, top = a[keep], b[keep], top[keep]
        done = (tree.count[a] == 0) & (tree.count[b] == 0)
        leaf_pairs.append((a[done], b[done], top[done]))
        a, b = a[~done], b[~done]
        wide_a = (tree.count[b] == 0) | ((tree.count[a] > 0) & (r_q[a] >= r_d[b]))   # split the wider node
        split = np.where(wide_a, a, b)
        times = tree.count[split]
        child = np.repeat(tree.first[split], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        wide = np.repeat(wide_a, times)
        a, b = np.where(wide, child, np.repeat(a, times)), np.where(wide, np.repeat(b, times), child)
    a, b, top = (np.concatenate([t[i] for t in leaf_pairs]) for i in range(3)) if leaf_pairs else (np.zeros(0, np.int64),) * 3
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for leaf in np.unique(a):
        mine = np.flatnonzero(a == leaf)
        mine = mine[np.argsort(-top[mine], kind="stable")]
        q = tree.order[tree.lo[leaf]:tree.hi[leaf]]
        q = q[is_query[q]]
        kth, hits = least[q].copy(), []
        best = np.full((len(q), k), LEAST)
        for i in range(0, len(mine), 4):
            if top[mine[i]] < kth.min():
                break
            d = np.concatenate([o[~is_query[o]] for o in (tree.order[tree.lo[n]:tree.hi[n]] for n in b[mine[i:i + 4]])])
            s = _products(x[q], x[d])
            good = (s >= kth[:, None]) & (ids[d - len(queries)][None] != own[q][:, None])
            r, c = np.nonzero(good)
            hits.append((q[r], d[c] - len(queries), s[r, c]))
            both = np.concatenate([best, np.where(good, s, LEAST)], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            kth = np.maximum(kth, best.min(axis=1))
        if hits:
            hq, hd, hs = (np.concatenate([h[i] for h in hits]) for i in range(3))
            top_k = _best(hq, hs, rank[hd], k)
            found.append((hq[top_k], hd[top_k], hs[top_k]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def _pivots(sample: np.ndarray) -> np.ndarray:
    x = sample.astype(float)
    centres, _, _ = farthest_first(x, 0, PIVOTS, lambda r: 0.0)
    return sample[centres]


def _placed(pivots: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int):
    """Region, distance to its pivot and, for queries, the kth score against the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.astype(float)
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"))
            x = v.astype(float)
            region = ((x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1)[None]).argmin(axis=1)
            far = np.sqrt(((x - centres[region]) ** 2).sum(axis=1)) * (1 + SLACK)
            least = np.full(len(v), LEAST)
            q = np.flatnonzero(b.column("is_query").to_numpy(zero_copy_only=False))
            if len(q) and len(sample) >= k:
                own = b.column("vec_id").to_numpy(zero_copy_only=False)[q]
                s = _products(v[q], sample)
                s[sample_ids[None] == own[:, None]] = LEAST
                least[q] = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k]
            yield pa.record_batch([*b.columns, pa.array(region.astype(np.int32)), pa.array(far), pa.array(least)], [*b.schema.names, "region", "far", "least"])
    return run


def _searched(k: int):
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        q, d = q.combine_chunks(), d.combine_chunks()
        out = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if q.num_rows and d.num_rows:
            flat = lambda t: np.concatenate([matrix(c) for c in t.column("v").chunks])
            ids = d.column("vec_id").combine_chunks()
            none = ids.is_null().to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            rank = np.empty(len(known), np.int64)
            rank[np.lexsort((known, none))] = np.arange(len(known))   # rows without an id come last
            own = q.column("vec_id").to_numpy()
            # a query has an id divisible by ``every``; a row without one is nobody's own
            same = np.where(none, LEAST, known)
            at, row, score = search_cell(flat(q), own, q.column("least").to_numpy(), flat(d), same, rank, k)
            out = {"query_id": pa.array(own[at]), "vec_id": ids.take(pa.array(row)), "score": pa.array(score)}
            out["query"] = q.column("query").combine_chunks().take(pa.array(at))
        else:
            out["query"] = pa.array([], pa.int64())
        return pa.table({c: out[c] for c in ("query", "query_id", "vec_id", "score")})
    return run


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``, the k highest whole-number inner
    products with all rows of another id, ties to the smaller vec_id (rows without an id last).

    Vectors that are null or hold a null or non-finite component take no part; a component of 2**18 or more in magnitude
    counts as non-finite at the default scale, since products would outgrow a long. A shorter vector is taken to end in
    zeros. Repeated rows of data count each; query rows equal in id and vector are one query, rows of one id and
    different vectors are queries each. Fewer candidates than k give fewer rows, an empty table gives none. Other columns
    are not carried.

    Only the pivots come from a sample (SAMPLE_ROWS rows, least hashes); every row is indexed and searched. Equal vectors,
    however many, are dealt over blocks by a row hash, and no cell holds more than about CHUNK_QUERIES + BLOCK_ROWS rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_e"))
    rows = integer_vectors(named, scale, 2 ** 28, "_e").select("vec_id", "v")
    size = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if not size:
        rows = rows.limit(0)
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).to(spark.createDataFrame([], schema).schema)
    rows = rows.select("vec_id", F.concat("v", F.array_repeat(F.lit(0), F.lit(size) - F.size("v"))).alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE_ROWS).collect()
    points = np.array([r["v"] for r in sample], dtype=np.int64)
    ids = np.array([LEAST if r["vec_id"] is None else r["vec_id"] for r in sample], dtype=np.int64)
    pivots = _pivots(points)
    asked = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    placed = stage(rows.select("vec_id", "v", asked.alias("is_query"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")).mapInArrow(
        _placed(pivots, points, ids, k), "vec_id long, v array<int>, is_query boolean, salt long, region int, far double, least long"))
    queries = placed.where("is_query").groupBy("vec_id", "v").agg(*[F.min(c).alias(c) for c in ("region", "far", "least", "salt")])
    queries = stage(queries.withColumn("query", F.xxhash64("vec_id", "v")))
    data_regions = {r["region"]: r for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    query_regions = {r["region"]: r for r in queries.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min("least").alias("least")).collect()}
    chunks, cells = _grid(pivots.astype(float), query_regions, data_regions)
    q = queries.join(F.broadcast(spark.createDataFrame(chunks, "region int, chunk int, chunks int")), "region")   # at most PIVOTS rows
    q = q.withColumn("chunk", F.col("chunk") + F.pmod(F.col("salt"), "chunks"))
    met = spark.createDataFrame(cells, "region int, data_region int, blocks int")   # at most PIVOTS ** 2 rows
    q = q.join(F.broadcast(met), "region").select("query", "vec_id", "v", "least", "chunk", "data_region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked_by = q.select("chunk", F.col("data_region"), "block").distinct()   # cells with a query
    blocks = {d: b for _, d, b in cells}
    sizes = spark.createDataFrame(list(blocks.items()), "data_region int, blocks int")
    d = placed.join(F.broadcast(sizes), F.col("region") == F.col("data_region")).select("vec_id", "v", "data_region", F.pmod("salt", "blocks").cast("int").alias("block"))
    d = d.join(stage(asked_by), ["data_region", "block"])
    key = ["chunk", "data_region", "block"]
    found = q.groupBy(*key).cogroup(d.groupBy(*key)).applyInArrow(_searched(k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _grid(pivots: np.ndarray, queries: dict, data: dict) -> tuple[list, list]:
    """Chunks of queries, (region, first chunk, chunks), and the region pairs that may hold a result, (query region, data
    region, blocks). Small regions share a chunk with the region placed nearest before them."""
    norm = np.sqrt((pivots ** 2).sum(axis=1))
    left, order = set(queries), []
    while left:
        near = min(left, key=lambda r: (((pivots[r] - pivots[order[-1]]) ** 2).sum() if order else 0.0, r))
        order.append(near)
        left.discard(near)
    chunks, next_chunk, fill = [], 0, 0
    for r in order:
        n = queries[r]["n"]
        if fill and fill + n > CHUNK_QUERIES:
            next_chunk, fill = next_chunk + 1, 0
        many = -(-n // CHUNK_QUERIES)
        chunks.append((r, next_chunk, many))
        next_chunk, fill = (next_chunk + many, 0) if many > 1 else (next_chunk, fill + n)
    pairs = []
    for r, q in queries.items():
        for s, d in data.items():
            top = pivots[r] @ pivots[s] + q["far"] * norm[s] + d["far"] * norm[r] + q["far"] * d["far"]
            if top + SLACK * (norm[r] + q["far"]) * (norm[s] + d["far"]) + 1e-6 >= q["least"]:
                pairs.append((r, s, -(-d["n"] // BLOCK_ROWS)))
    return chunks, pairs
