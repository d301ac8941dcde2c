"""Customer profile, rule cells, quintile segments, k-means and agreement of labelings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clipped_log1p, ratio
from ..params import CLUSTER_KS, CLUSTER_RESTARTS, RECENCY_ACTIVE_DAYS, REPEAT_ORDERS, SEED
from ..sources.recovery import cut_lineage
from .ordering import ntile, quantiles

__all__ = ["user_profile", "rfm_code", "rfm_cells", "rfm_summary", "rfm_segments", "log_standardise",
           "kmeans_sweep", "assign", "silhouette", "silhouettes", "euclidean_silhouette", "crosstab", "adjusted_rand", "cluster_profile",
           "RFM_COLUMNS"]

RFM_COLUMNS = ("recency_days", "order_cnt", "monetary")


def user_profile(orders: DataFrame) -> DataFrame:
    """Recency, order count and money per customer over delivered orders (our definition)."""
    snapshot = orders.agg(F.max("purchase_ts").cast("date")).scalar()
    return (orders.where("is_delivered = 1").groupBy("customer_unique_id")
            .agg(F.max("purchase_ts").cast("date").alias("last_day"),
                 F.count(F.lit(1)).alias("order_cnt"), F.sum("order_amount").alias("monetary"))
            .select("customer_unique_id", F.datediff(snapshot, F.col("last_day")).alias("recency_days"),
                    "order_cnt", "monetary"))


def rfm_code(recency: Column, orders: Column, money: Column, r_days, m_limit, f_orders=REPEAT_ORDERS) -> Column:
    """Three bits: recent (<=), repeated (>=), high value (strictly above)."""
    bits = [recency <= r_days, orders >= f_orders, money > m_limit]
    return F.concat(*[b.cast("int").cast("string") for b in bits])


def rfm_cells(profile: DataFrame, r_days: int = RECENCY_ACTIVE_DAYS, f_orders: int = REPEAT_ORDERS) -> DataFrame:
    """Adds ``rfm_code``; the money threshold is the exact median over customers."""
    limit = quantiles(profile, "monetary", {"m": 0.5}).scalar()
    return profile.withColumns({
        "thr_recency_days": F.lit(r_days), "thr_monetary": limit,
        "rfm_code": rfm_code(F.col("recency_days"), F.col("order_cnt"), F.col("monetary").cast("double"),
                             F.lit(r_days), limit, f_orders)})


def rfm_summary(cells: DataFrame) -> DataFrame:
    """One row per cell, all eight, with its size, means and the thresholds; an empty cell has zero customers and money and
    no means."""
    found = cells.groupBy("rfm_code").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("monetary"),
        F.avg("order_cnt").alias("avg_order_cnt"), F.avg("recency_days").alias("avg_recency_days"))
    limits = cells.agg(F.max("thr_recency_days").alias("thr_recency_days"), F.max("thr_monetary").alias("thr_monetary"))
    every = cells.sparkSession.range(8).select(F.lpad(F.conv(F.col("id").cast("string"), 10, 2), 3, "0").alias("rfm_code"))
    return every.crossJoin(F.broadcast(limits)).join(found, "rfm_code", "left").withColumns({
        "customers": F.coalesce("customers", F.lit(0)).cast("long"), "monetary": F.coalesce("monetary", F.lit(0)).cast(found.schema["monetary"].dataType)})


def rfm_segments(profile: DataFrame) -> DataFrame:
    """Quintile scores 1..5 (5 is best) and eight named groups (the names are ours)."""
    key = "customer_unique_id"
    p = cut_lineage(profile)  # read by three rankings
    for value, out in ((-F.col("recency_days"), "r_score"), (F.col("order_cnt"), "f_score"), (F.col("monetary"), "m_score")):
        tiles = ntile(p.select(key, value.cast("double").alias("_x")), "_x", key, 5, out)
        p = cut_lineage(p.join(tiles.select(key, out), key))
    r, f, m = (F.col(c) >= 4 for c in ("r_score", "f_score", "m_score"))
    name = (F.when(r & f & m, "champion").when(r & f, "loyal").when(r & m, "big_recent").when(r, "new")
            .when(f & m, "at_risk_top").when(f, "at_risk_regular").when(m, "lapsed_big").otherwise("lapsed"))
    return p.withColumn("rfm_segment", name)


def log_standardise(df: DataFrame, cols) -> DataFrame:
    """log1p (clipped at 0), then mean 0 and population standard deviation 1; adds ``z_<col>``."""
    x = {c: clipped_log1p(F.col(c)) for c in cols}
    s = df.agg(*[f(x[c]).alias(f"{p}_{c}") for c in cols for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return df.withColumns({f"z_{c}": (x[c] - float(s[f"m_{c}"])) / float(s[f"s_{c}"] or 1.0) for c in cols})


def _uniform(rows: np.ndarray, *labels: int) -> np.ndarray:
    """A draw in (0, 1) for each row hash under the labels; any task makes the same one."""
    h = rows.astype(np.int64).view(np.uint64)
    for v in labels:
        h = (h ^ np.uint64(v + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _spread_starts(data: DataFrame, cols: list[str], models: list[tuple[int, int]], seed: int) -> list[np.ndarray]:
    """Starting centres over all rows, each with probability proportional to its squared distance from those before.

    A row waits an exponential time divided by its squared distance; the row that comes first is drawn with exactly that
    probability. So one pass gives the next centre of all models, and each task returns one row per model.
    """
    centres: list[list] = [[] for _ in models]
    for step in range(max(k for k, _ in models)):
        active = {m: np.array(centres[m]) for m, (k, _) in enumerate(models) if step < k}

        def first_rows(frames, active=active, step=step):
            best: dict = {}
            for f in frames:
                rows, x = f["_row"].to_numpy(), f[cols].to_numpy(dtype=float)
                for m, c in active.items():
                    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1) if step else np.ones(len(x))
                    wait = np.where(d > 0, -np.log(_uniform(rows, seed, m, step)) / np.maximum(d, 1e-300), 1e300)
                    i = np.lexsort((rows, wait))[0] if len(x) else None
                    if i is not None and (m not in best or (wait[i], rows[i]) < best[m][:2]):
                        best[m] = (wait[i], rows[i], *x[i])
            yield pd.DataFrame([(m, *r) for m, r in best.items()], columns=["m", "wait", "row", *[f"x{j}" for j in range(len(cols))]])

        schema = "m int, wait double, row long, " + ", ".join(f"x{j} double" for j in range(len(cols)))
        drawn = data.mapInPandas(first_rows, schema).groupBy("m").agg(F.min(F.struct("wait", "row", *[f"x{j}" for j in range(len(cols))])).alias("b"))
        for r in drawn.collect():
            centres[r["m"]].append([r["b"][f"x{j}"] for j in range(len(cols))])
    return [np.array(c) for c in centres]


def kmeans_sweep(df: DataFrame, key: str, cols: list[str], ks=CLUSTER_KS, restarts: int = CLUSTER_RESTARTS,
                 seed: int = SEED, max_iter: int = 100, tol: float = 1e-4) -> dict:
    """Best centres per K. All K x restarts models move together: one pass over the data per
    iteration returns only per-cluster sums, so fifty fits read the data as often as one.
    """
    data = cut_lineage(df.select(F.xxhash64(F.lit(seed), key).alias("_row"), *cols))
    models = [(k, r) for k in ks for r in range(restarts)]
    centres = _spread_starts(data, cols, models, seed)
    moving, cost = set(range(len(models))), np.full(len(models), np.inf)
    points = data.select(*cols)

    def one_pass(active: dict) -> pd.DataFrame:
        def partial(frames):
            acc: dict = {}
            for f in frames:
                x = f.to_numpy(dtype=float)
                sq = (x ** 2).sum(axis=1)
                for m, c in active.items():
                    d = sq[:, None] - 2 * x @ c.T + (c ** 2).sum(axis=1)[None, :]
                    lab = d.argmin(axis=1)
                    near = np.maximum(d[np.arange(len(x)), lab], 0)
                    n = np.bincount(lab, minlength=len(c))
                    rows = np.column_stack([n, np.bincount(lab, weights=near, minlength=len(c))] + [
                        np.bincount(lab, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])])
                    acc[m] = acc[m] + rows if m in acc else rows
            for m, rows in acc.items():
                out = pd.DataFrame(rows, columns=["n", "cost"] + [f"s{j}" for j in range(rows.shape[1] - 2)])
                out.insert(0, "cluster", range(len(rows)))
                out.insert(0, "model", m)
                yield out
        names = ["n", "cost"] + [f"s{j}" for j in range(len(cols))]
        schema = "model int, cluster int, " + ", ".join(f"{n} double" for n in names)
        return (points.mapInPandas(partial, schema).groupBy("model", "cluster")
                .agg(*[F.sum(n).alias(n) for n in names]).toPandas())

    for _ in range(max_iter):
        sums = one_pass({m: centres[m] for m in moving})
        for m, g in sums.groupby("model"):
            g = g.sort_values("cluster")
            n = g["n"].to_numpy()
            mean = g[[f"s{j}" for j in range(len(cols))]].to_numpy() / np.maximum(n, 1)[:, None]
            new = np.where(n[:, None] > 0, mean, centres[m])
            cost[m] = g["cost"].sum()
            if ((new - centres[m]) ** 2).sum() <= tol * len(cols):
                moving.discard(m)
            centres[m] = new
        if not moving:
            break
    final = one_pass(dict(enumerate(centres))).groupby("model")["cost"].sum()
    best = {}
    for i, (k, r) in enumerate(models):
        c = float(final.loc[i])
        if k not in best or c < best[k]["cost"]:
            best[k] = {"centres": centres[i][np.lexsort(centres[i].T[::-1])], "cost": c, "restart": r}
    return best


def assign(df: DataFrame, cols: list[str], centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """Nearest centre as a column expression (ties: lower number)."""
    def dist(c):
        d = F.lit(0.0)
        for name, v in zip(cols, c):
            d = d + (F.col(name) - float(v)) * (F.col(name) - float(v))
        return d
    near = F.array_min(F.array(*[F.struct(dist(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return df.withColumn(out, near.getField("i"))


def silhouette(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Mean silhouette of a labelling over all rows, with squared Euclidean distances.

    The mean squared distance of a row to a cluster follows from the cluster's count, sums and squared norms, so no pairs
    are made. A row alone in its cluster counts 0, as does every row when there is one cluster; labels must be few.
    """
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols])
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"), *[F.sum(c).alias(f"s{j}") for j, c in enumerate(cols)]).collect()
    inf = F.lit(float("inf"))
    own, other = inf, inf
    for r in stats:
        total = r["n"] * norm + r["q"]   # of squared distances to the cluster
        for j, c in enumerate(cols):
            total = total - 2 * float(r[f"s{j}"]) * F.col(c)
        mine = F.col(label) == F.lit(r[label])
        own = F.when(mine, total / (r["n"] - 1) if r["n"] > 1 else F.lit(None)).otherwise(own)
        other = F.least(other, F.when(mine, inf).otherwise(total / r["n"]))
    if len(stats) < 2:
        return df.agg(F.lit(0.0).alias("silhouette"))
    s = F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0))
    return df.select(s.alias("s")).agg(F.avg("s").alias("silhouette"))


TILE_ROWS = 16_384         # distinct points of a tile, where sixteen tiles hold all
MOST_TILE_ROWS = 262_144   # and where they do not: a point is copied to every tile, so tiles are to be few
SIDE = 96, 1024      # points by points whose distances are held at a time


def _distance_sums(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point of x the weighted sums of its distances to those of y, one a column of wy, and for each of y those to x."""
    sx, sy = np.zeros((len(x), wy.shape[1])), np.zeros((len(y), wx.shape[1]))
    total, one = np.empty(SIDE), np.empty(SIDE)
    for a in range(0, len(x), SIDE[0]):
        for b in range(0, len(y), SIDE[1]):
            u, v = x[a:a + SIDE[0]], y[b:b + SIDE[1]]
            d, t = total[:len(u), :len(v)], one[:len(u), :len(v)]
            for j in range(x.shape[1]):
                part = t if j else d
                np.subtract(u[:, j, None], v[None, :, j], out=part)
                np.multiply(part, part, out=part)
                if j:
                    np.add(d, t, out=d)
            np.sqrt(d, out=d)
            sx[a:a + SIDE[0]] += d @ wy[b:b + SIDE[1]]
            sy[b:b + SIDE[1]] += d.T @ wx[a:a + SIDE[0]]
    return sx, sy


def _tiles(n: int) -> int:
    """Tiles of n points. A small table makes small ones, so that several tasks share it."""
    return max(-(-n // MOST_TILE_ROWS), min(16, -(-4 * n // TILE_ROWS)))


def _met(points: DataFrame, tiles: int) -> DataFrame:
    """Each point once for every tile, its own too; rows of one (_x, _y), where _x <= _y, are the meeting of two tiles."""
    dealt = points.withColumn("_own", F.pmod("_id", F.lit(tiles)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return dealt.withColumns({"_x": F.least("_own", "_other"), "_y": F.greatest("_own", "_other")}).drop("_other")


def _tile_sums(cols: list[str], labels: list):
    """For each point of two tiles that meet, the sums of its distances to the points of each label in the other tile."""
    def run(rows: pa.Table) -> pa.Table:
        own = rows.column("_own").to_numpy()
        points = np.column_stack([rows.column(c).to_numpy() for c in cols]).astype(float)
        weight = np.zeros((rows.num_rows, len(labels)))
        weight[np.arange(rows.num_rows), rows.column("_l").to_numpy()] = rows.column("_w").to_numpy()
        x, y = (own == rows.column(c).to_numpy() for c in ("_x", "_y"))
        sums = np.zeros(weight.shape)
        to_y, to_x = _distance_sums(points[x], points[y], weight[x], weight[y])
        sums[y] = to_x
        sums[x] = to_y
        return pa.table({"_id": rows.column("_id"), **{f"s{k}": pa.array(sums[:, k]) for k in range(len(labels))}})
    return run


def euclidean_silhouette(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """silhouette: the mean over all rows, with Euclidean distances, of (b - a) / max(a, b), where a is a row's mean distance
    to the others of its label and b the least mean distance to another label.

    Equal points of a label are one with a weight. Points are dealt into sixteen tiles, or more of MOST_TILE_ROWS, any two
    tiles meet once, and a meeting gives one row of sums per point of both; no table of pairs is made, and what is shuffled are
    the points times the tiles. The time grows with the square of the distinct points, the memory of a task does not. A row alone in its label counts 0,
    as does every row when there is one label; a table without rows gives null. Labels must be few; rows with a null
    label or coordinate are left out.
    """
    known = df.where(F.col(label).isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    labels = sorted(sizes)
    if len(labels) < 2:
        return known.agg(F.avg(F.lit(0.0)).alias("silhouette"))
    number = F.element_at(F.create_map(*[F.lit(v) for k in labels for v in (k, labels.index(k))]), F.col(label))
    points = known.groupBy(number.alias("_l"), *[F.col(c).cast("double").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("_w"))
    points = cut_lineage(points.withColumn("_id", F.xxhash64(F.monotonically_increasing_id())))
    tiles = _tiles(points.count())
    schema = "_id long, " + ", ".join(f"s{k} double" for k in range(len(labels)))
    met = _met(points, tiles).repartition(min(10_000, tiles * (tiles + 1) // 2), "_x", "_y")   # few bytes, much work: tasks are not to be joined
    sums = met.groupBy("_x", "_y").applyInArrow(_tile_sums(cols, labels), schema)
    total = sums.groupBy("_id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(labels))]).join(points, "_id")
    inf = F.lit(float("inf"))
    own, other = inf, inf
    for k, name in enumerate(labels):
        mine = F.col("_l") == k
        own = F.when(mine, F.col(f"s{k}") / (sizes[name] - 1) if sizes[name] > 1 else F.lit(None)).otherwise(own)
        other = F.least(other, F.when(mine, inf).otherwise(F.col(f"s{k}") / sizes[name]))
    s = F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0))
    return total.agg((F.sum(s * F.col("_w")) / F.sum("_w")).alias("silhouette"))


def silhouettes(df: DataFrame, cols: list[str], models: dict) -> dict[int, float]:
    """The silhouette of each K's clustering."""
    return {k: silhouette(assign(df, cols, m["centres"], "_c"), cols, "_c").first()[0] for k, m in models.items()}


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings; may be slightly negative."""
    t = crosstab(df, a, b)
    two = lambda c: c.cast("double") * (c - 1) / 2
    # sums of row and column totals from the contingency table, which is labels x labels
    rows = t.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("v")).scalar()
    cols = t.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("v")).scalar()
    g = t.agg(F.sum(two(F.col("n"))).alias("idx"), F.sum("n").alias("n")).withColumns({"r": rows, "c": cols})
    expected = ratio(F.col("r") * F.col("c"), two(F.col("n")))
    top = (F.col("r") + F.col("c")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("idx") - expected) / (top - expected))
    return g.select(ari.alias("ari"))


def cluster_profile(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, means, exact median, repeat share and percent share per cluster."""
    g = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("recency_days").alias("avg_recency"),
        F.avg(F.col("monetary").cast("double")).alias("avg_monetary"), F.avg("order_cnt").alias("avg_order_cnt"),
        F.avg((F.col("order_cnt") >= 2).cast("double")).alias("repeat_rate"))
    med = quantiles(df, "monetary", {"med_monetary": 0.5}, [cluster])
    whole = Window.partitionBy(F.lit(0))  # one row per cluster
    return g.join(med, cluster).withColumn("share_pct", F.col("customers") / F.sum("customers").over(whole) * 100)
