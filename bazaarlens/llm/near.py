"""MinHash near-dedup with an LSH forest.

Every distinct shingle set (class) has a sketch of 128 min-hash values. A tree orders the classes by a sequence of those
values; classes with a common prefix of the tree's depth form a region. Two sets of similarity s meet in a region of depth
d with probability s^d per tree, so ``trees`` trees that share no values miss a pair with (1 - s^d)^trees: at s = 0.8 with
5e-8 on the first level. Regions too large for it are looked at deeper, by trees over min-hash values of their own that are
worked out for these classes alone: 2e-8 and 1e-8 there.

1. Some trees are sorted whole. A class's candidates are its neighbours in the order, those with the longest common prefix,
   where their sketches come near the threshold: groups of copies link up along the order, a few pairs per class whatever
   their size.
2. Regions that still hold two components or more are searched: each class takes its best partner by sketch in another
   component.
3. What is left are components whose sketches may still reach the threshold somewhere. They form clusters, and the full
   sets of a cluster's different components are compared in blocks, so that nothing near the threshold is lost and no
   table of pairs is made.
4. Regions too large to search in one task are searched deeper, with as many more trees as the depth costs; what is still
   too large at the last depth is searched in blocks.

Every link is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, parts, small_enough, stage, text_batches, tidied
from .components import connected_components, looked_up
from .shingles import SKETCH, hash_functions, set_digest, shingle_sets, sketches

__all__ = ["near_duplicates", "keep_one", "describe_sets", "forest", "deep_forest", "tree_neighbours", "search_regions", "cluster_blocks", "compare_clusters", "confirm"]

LEVELS = [(4, 32), (8, 96), (12, 256)]   # depth and trees, none of which share values: at 0.8 a pair is missed with 5e-8, 2e-8, 1e-8
ORDER_TREES = 4                          # trees that are sorted whole
NEIGHBOURS = 2                           # places up the order that a class is compared with
REGION_ROWS = 20_000                     # classes of a region searched in one task: 5 MB of sketches
WANTED_ROWS = 400_000                    # of two longs, broadcast to find the texts whose full sets are needed
BLOCK_ROWS = 512                         # classes of a block whose full sets are compared with another block's
SIGMAS = 5.0                             # sketch agreement this far below the threshold rules a pair out


def _values(tree: int, depth: int) -> np.ndarray:
    """Places in the sketch that a tree of the first level reads, in order; none are shared up to its depth."""
    return (np.arange(2 * depth) + tree * depth) % SKETCH


def _least_agreement(similarity: float) -> int:
    return max(1, math.floor(SKETCH * similarity - SIGMAS * math.sqrt(SKETCH * similarity * (1 - similarity))))


def describe_sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_a, text_b (they name the text), n (shingles), set_id, sketch of each row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(11), text_col).alias("text_a"), F.xxhash64(F.lit(29), text_col).alias("text_b"),
                         F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", BATCH_BYTES):
                sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), words)
                some = [s for s in sets if len(s)]
                sketch = iter(sketches(some) if some else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_a"), part.column("text_b"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([next(sketch).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "text_a", "text_b", "n", "set_id", "sketch"])

    return text_batches(source).mapInArrow(tidied(run), "doc_id long, text_a long, text_b long, n long, set_id long, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SKETCH)


def _hashed(m: np.ndarray, tree: int, places: np.ndarray) -> np.ndarray:
    h = np.full(len(m), np.uint64(tree * 2654435761 + len(places)))
    for p in places:
        h = (h ^ m[:, p]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def forest(classes: DataFrame, depth: int, trees: int) -> DataFrame:
    """(region, id): the regions of each class (id, sketch) on the first level, one per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("sketch"))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(_hashed(m, t, _values(t, depth)[:depth])), batch.column("id")], names=["region", "id"])

    return classes.select("id", "sketch").mapInArrow(tidied(run), "region long, id long")


def deep_forest(sets: DataFrame, level: int, depth: int, trees: int) -> DataFrame:
    """(region, id): the regions of each class (id, values) on a deeper level, by depth * trees min-hash values of its own."""
    functions = hash_functions(level, depth * trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "values", BATCH_BYTES):
                m = sketches([np.frombuffer(v, np.uint64) for v in part.column("values").to_pylist()], functions)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(_hashed(m, t, np.arange(t * depth, t * depth + depth))), part.column("id")], names=["region", "id"])

    return text_batches(sets.select("id", "values")).mapInArrow(tidied(run), "region long, id long")


def tree_neighbours(classes: DataFrame, depth: int, trees: int, least: int) -> DataFrame:
    """(a, b): classes at most NEIGHBOURS places apart in a tree's order with a common prefix of ``depth`` or more, whose
    sketches agree in ``least`` values. The order is cut into ranges, so a region of any size spreads over tasks; a pair
    across a cut is left to the search of regions."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("sketch"))
            for t in range(trees):
                key = np.empty(len(m), [("tree", "u1"), ("v", ">u2", 2 * depth)])
                key["tree"], key["v"] = t, m[:, _values(t, depth)]
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key], pa.binary()), batch.column("id"), batch.column("sketch")], names=["place", "id", "sketch"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = np.zeros((0, 1 + 2 * depth), np.uint8)
        ids, m = np.zeros(0, np.int64), np.zeros((0, SKETCH), np.uint16)   # of the last rows of the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column("place").to_pylist()), np.uint8).reshape(batch.num_rows, -1)[:, :1 + 2 * depth]
            prefix, ids, m = (np.concatenate(x) for x in ((prefix, keys), (ids, batch.column("id").to_numpy()), (m, _matrix(batch.column("sketch")))))
            found = []
            for lag in range(1, NEIGHBOURS + 1):
                lo = np.arange(max(0, len(ids) - batch.num_rows - lag), len(ids) - lag)
                near = (prefix[lo] == prefix[lo + lag]).all(axis=1) & (ids[lo] != ids[lo + lag])
                lo = lo[near]
                found.append(np.stack([lo, lo + lag])[:, (m[lo] == m[lo + lag]).sum(axis=1) >= least])
            p, q = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q]))], names=["a", "b"])
            prefix, ids, m = prefix[-NEIGHBOURS:], ids[-NEIGHBOURS:], m[-NEIGHBOURS:]

    rows = classes.select("id", "sketch").mapInArrow(tidied(ordered), "place binary, id long, sketch binary")
    return rows.repartitionByRange("place", "id").sortWithinPartitions("place", "id").mapInArrow(tidied(paired), "a long, b long").distinct()


class _Union:
    """Labels of items under unions that come in arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            p, q = self.root[a], self.root[b]
            apart = p != q
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _tasks(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str], matrix: bool) -> Iterator[list]:
    """Columns of whole tasks, from batches sorted by the keys; a batch's last task is held for the next."""
    held = None
    for batch in batches:
        got = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys + columns] + ([_matrix(batch.column("sketch"))] if matrix else [])
        held = got if held is None else [np.concatenate(v) for v in zip(held, got)]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in held[:len(keys)]], axis=0)) + 1
        if len(cut):
            yield [v[:cut[-1]] for v in held]
            held = [v[cut[-1]:] for v in held]
    if held is not None and len(held[0]):
        yield held


def search_regions(rows: DataFrame, least: int, best: bool) -> DataFrame:
    """(a, b) across components (comp) of a task (region, x, y) whose sketches agree in ``least`` values or more; rows of
    block x meet those of block y. With ``best`` the classes: of each its best partner. Without: the components that such
    pairs connect, as links to the smallest of each group, so at most one row per component and task."""

    def search(region, x, y, block, comp, ids, m):
        """Lag by lag over rows sorted by region, so no pair matrix is held."""
        n = len(ids)
        number = np.concatenate(([0], np.cumsum((region[1:] != region[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        top, partner = np.full(n, least - 1, np.int64), np.full(n, -1, np.int64)
        name, at_name = np.unique(comp, return_inverse=True)
        groups = _Union(len(name))
        at = np.arange(n)
        for lag in range(1, n):
            at = at[at + lag < n]
            at = at[number[at] == number[at + lag]]
            if not len(at):
                break
            to = at + lag
            across = (comp[at] != comp[to]) & ((x[at] == y[at]) | (block[at] != block[to]))
            if not best:
                across &= groups.root[at_name[at]] != groups.root[at_name[to]]
            i, j = at[across], to[across]
            for s in range(0, len(i), 4096):
                p, q = i[s:s + 4096], j[s:s + 4096]
                same = (m[p] == m[q]).sum(axis=1)
                ok = same >= least
                p, q, same = p[ok], q[ok], same[ok]
                if not best:
                    groups.join(at_name[p], at_name[q])
                    continue
                for u, v in ((p, q), (q, p)):
                    better = same > top[u]
                    top[u[better]], partner[u[better]] = same[better], v[better]
        if best:
            p = np.flatnonzero(partner >= 0)
            return ids[p], ids[partner[p]]
        p = np.flatnonzero(groups.root != np.arange(len(name)))
        return name[p], name[groups.root[p]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches, ["region", "x", "y"], ["block", "comp", "id"], True):
            p, q = search(*task)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    tasks = rows.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y", "id")
    return tasks.select("region", "block", "x", "y", "comp", "id", "sketch").mapInArrow(tidied(run), "a long, b long").distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, as products of 0-1 matrices over common values."""
    flat = [np.concatenate(v) for v in (left, right)]
    owner = [np.repeat(np.arange(len(v)), [len(x) for x in v]) for v in (left, right)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    side = []
    for values, own in zip(flat, owner):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        order = np.argsort(at[hit], kind="stable")
        side.append((at[hit][order], own[hit][order]))
    for c in range(0, len(common), width):
        ones = []
        for (at, own), v in zip(side, (left, right)):
            lo, hi = np.searchsorted(at, (c, c + width))
            ones.append(np.zeros((len(v), width), np.float32))
            ones[-1][own[lo:hi], at[lo:hi] - c] = 1
        out += ones[0] @ ones[1].T
    return out


def compare_clusters(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components (comp) of a task (cluster, x, y), confirmed on full sets (values); rows of
    block x meet those of block y. Of the links that join the same components one is given."""

    def links(sets, block, x, y, comp, ids):
        left, right = np.flatnonzero(block == x[0]), np.flatnonzero(block == y[0])
        if not len(left) or not len(right) or (comp == comp[0]).all():
            return [], []
        size = np.array([len(v) for v in sets])
        common = _shared([sets[i] for i in left], [sets[i] for i in right])
        near = 100 * common >= percent * (size[left][:, None] + size[right][None] - common)
        near &= comp[left][:, None] != comp[right][None]
        p, q = np.nonzero(near)
        p, q = left[p], right[q]
        name, at = np.unique(comp, return_inverse=True)
        one = np.unique(np.minimum(at[p], at[q]) * len(name) + np.maximum(at[p], at[q]), return_index=True)[1] if len(p) else []
        root, kept = list(range(len(name))), []

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i
        for k in one:
            u, v = find(at[p[k]]), find(at[q[k]])
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append(k)
        return ids[p[kept]], ids[q[kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cluster, x, y, block, comp, ids, values in _tasks(batches, ["cluster", "x", "y"], ["block", "comp", "id", "values"], False):
            edges = np.flatnonzero((cluster[1:] != cluster[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)]):
                sets = [np.frombuffer(v, np.uint64) for v in values[a:b]]
                p, q = links(sets, block[a:b], x[a:b], y[a:b], comp[a:b], ids[a:b])
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    tasks = rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "id")
    return tasks.select("cluster", "x", "y", "block", "comp", "id", "values").mapInArrow(tidied(run), "a long, b long").distinct()


def cluster_blocks(members: DataFrame) -> DataFrame:
    """members (cluster, comp, id) dealt to tasks (x, y) of two blocks. Blocks of the cluster's largest component come last
    and only meet the blocks of the others, so one huge component next to a few small ones is dealt out once."""
    sizes = members.groupBy("cluster", "comp").count()
    shape = stage(sizes.groupBy("cluster").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("all")).select(
        "cluster", F.col("top.comp").alias("largest"), F.ceil(F.col("top.count") / BLOCK_ROWS).cast("int").alias("big"),
        F.ceil((F.col("all") - F.col("top.count")) / BLOCK_ROWS).cast("int").alias("small")))
    rows = members.join(shape, "cluster")
    large = F.col("comp") == F.col("largest")
    block = F.when(large, F.col("small") + F.pmod(F.xxhash64("id"), F.col("big"))).otherwise(F.pmod(F.xxhash64("id"), F.col("small"))).cast("int")
    others = F.when(large, F.col("small")).otherwise(F.col("small") + F.col("big"))
    dealt = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return dealt.select("cluster", "comp", "id", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * |intersection| >= percent * |union| of their full sets (id, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                p, q = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_u = pairs.join(sets.select(F.col("id").alias("a"), F.col("values").alias("u")), "a")
    return with_u.join(sets.select(F.col("id").alias("b"), F.col("values").alias("v")), "b").select("a", "b", "u", "v").mapInArrow(tidied(run), "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, values): the whole shingle sets of the wanted classes (id, doc, text_a, text_b), made again from one row of each."""
    source = docs.select(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(F.lit(11), text_col).alias("_a"), F.xxhash64(F.lit(29), text_col).alias("_b"), F.col(text_col).alias("text"))
    if small_enough(wanted, WANTED_ROWS):
        wanted = F.broadcast(wanted)   # else the texts are shuffled to it
    same = F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_a") == F.col("text_a")) & (F.col("_b") == F.col("text_b"))
    texts = source.join(wanted, same).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", BATCH_BYTES):
                sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "values"])

    # rows that repeat in id and text give a set each, which are one again before the shuffle
    return stage(text_batches(texts).mapInArrow(tidied(run), "id long, values binary").groupBy("id").agg(F.first("values").alias("values")))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _mixed(rows: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows (region, id, comp) of the regions with more than one component, and these regions' sizes."""
    marked = _labelled(rows, labels)
    regions = stage(marked.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("region", "size"))
    return marked, regions


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (id, comp) after links (a, b) between ids: the components are contracted and relabelled."""
    if labels is None:
        return connected_components(links)
    roots = connected_components(looked_up(looked_up(links, "a", labels, "comp"), "b", labels, "comp"))
    known = looked_up(labels, "comp", roots, "comp")
    return stage(known.unionByName(roots.join(labels.select("id"), "id", "left_anti")))


def _search_tasks(rows: DataFrame, labels: DataFrame | None, sketched: DataFrame, everything: bool) -> DataFrame:
    """Rows (region, id) of regions with two components or more, dealt to tasks of at most REGION_ROWS rows a block, with
    their sketches. Larger regions are left out unless ``everything`` is wanted."""
    marked, regions = _mixed(rows, labels)
    here = marked.join(regions if everything else regions.where(F.col("size") <= REGION_ROWS), "region")
    here = here.withColumn("blocks", F.ceil(F.col("size") / REGION_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    here = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = here.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    return here.join(sketched, "id")


def _links(classes: DataFrame, sets_of, percent: int) -> DataFrame | None:
    """(id, comp) of the classes that have links."""
    least, labels, sets, pending = _least_agreement(percent / 100), None, None, classes
    sketched = classes.select("id", "sketch")
    for level, (depth, trees) in enumerate(LEVELS):
        rows = forest(pending, depth, trees) if level == 0 else deep_forest(sets.join(pending.select("id"), "id", "left_semi"), level, depth, trees)
        _, regions = _mixed(rows, labels)
        rows = stage(rows.join(regions, "region").select("region", "id"))
        if rows.isEmpty():
            break
        met = stage(rows.select("id").distinct())
        if level == 0:
            sets = sets_of(met)
            pairs = stage(tree_neighbours(classes.join(met, "id", "left_semi"), depth, ORDER_TREES, least))
            if not pairs.isEmpty():
                labels = connected_components(stage(confirm(pairs, sets, percent)))
        last = level == len(LEVELS) - 1
        pairs = stage(search_regions(_search_tasks(rows, labels, sketched, last), least, True))
        if not pairs.isEmpty():
            labels = _joined(labels, stage(confirm(pairs, sets, percent)))
        groups = stage(search_regions(_search_tasks(rows, labels, sketched, last), least, False))
        if not groups.isEmpty():
            cluster = connected_components(groups).select(F.col("id").alias("comp"), F.col("comp").alias("cluster"))
            members = stage(_labelled(sets.select("id"), labels).join(cluster, "comp").select("cluster", "comp", "id"))
            labels = _joined(labels, stage(compare_clusters(cluster_blocks(members).join(sets, "id"), percent)))
        if last:
            break
        large = _mixed(rows, labels)[1].where(F.col("size") > REGION_ROWS)
        if large.isEmpty():
            break
        pending = classes.join(stage(rows.join(large.select("region"), "region", "left_semi").select("id").distinct()), "id", "left_semi")
    return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, links of equal sets included, for every row.

    Sets are distinct shingles of ``words`` words, lower-cased in A-Z; with fewer words the whole sequence is one. Two
    rows are linked when 100 * |intersection| >= percent * |union|. component_id is the smallest doc_id reachable, and
    the row that has it is kept.

    Null, empty and blank texts have no set, are linked with nothing and kept. Equal texts, repeated rows included, are
    one class. Null doc_ids are never the smallest; a component of nulls only has a null id and is kept. Other columns
    are not carried, so their names cannot clash. An empty table gives an empty result.
    """
    return _components(docs, words, percent, id_col, text_col).drop("text_a", "text_b", "comp")


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with the names of the texts (text_a, text_b) and of the component (comp; null without a set)."""
    rows = stage(describe_sets(docs, words, id_col, text_col))
    classes = stage(rows.where("n > 0").groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_a", "text_b")).alias("text")))   # the row that stands for all of a set
    labels = _links(classes, lambda met: _full_sets(docs, stage(classes.join(met, "id", "left_semi").select("id", "doc", "text.text_a", "text.text_b")), words, id_col, text_col), percent)
    owned = _labelled(classes.select("id", "doc"), labels)
    if labels is not None:
        least = stage(owned.groupBy("comp").agg(F.min("doc").alias("component_id")))
        owned = owned.join(least, "comp")
    else:
        owned = owned.withColumnRenamed("doc", "component_id")
    owned = stage(owned.select(F.col("id").alias("set_id"), "component_id", "comp"))
    some = rows.where("n > 0").drop("sketch").join(owned, "set_id").select("doc_id", "n", "component_id", "text_a", "text_b", "comp")
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_a", "text_b", F.lit(None).cast("long").alias("comp"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_a", "text_b", "comp")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates: the first by id (nulls last) and text hashes; of fully repeated
    rows any. Rows without words are in no component and all stay."""
    place = ["doc_id", "text_a", "text_b"]
    keys = stage(_components(docs, words, percent, id_col, text_col).where("comp is not null").groupBy("comp", "kept", *place).agg(F.count(F.lit(1)).alias("n")))
    ranked = F.struct(*[F.col(c) for c in place])
    won = keys.where("kept").groupBy("comp").agg(F.min(ranked).alias("won"))   # one id each, or none, so the hashes decide
    kept = stage(keys.where("kept").join(won, "comp").withColumn("gone", ~ranked.eqNullSafe(F.col("won"))).select(*place, "n", "gone"))
    named = [F.col(c).alias(f"__{c}") for c in place]
    gone = stage(keys.where("not kept").select(named).unionByName(kept.where("gone").select(named)))

    def same(there: DataFrame) -> Column:
        here = [F.col(id_col).cast("long"), F.xxhash64(F.lit(11), text_col), F.xxhash64(F.lit(29), text_col)]
        return here[0].eqNullSafe(there["__doc_id"]) & (here[1] == there["__text_a"]) & (here[2] == there["__text_b"])

    left = docs.join(gone, same(gone), "left_anti")
    repeated = stage(kept.where("n > 1 and not gone").select(named))
    if repeated.isEmpty():
        return left
    few = F.broadcast(repeated) if small_enough(repeated, WANTED_ROWS) else repeated
    # aggregated before the shuffle, so a row that is everywhere is no large task
    once = left.select(F.struct(*docs.columns).alias("__row"), *docs.columns).join(few, same(repeated)).groupBy("__doc_id", "__text_a", "__text_b").agg(F.first("__row").alias("__row"))
    return left.join(few, same(repeated), "left_anti").unionByName(once.select("__row.*"))
