"""Clustering, top-k search and spelling variants against brute-force versions, and on hostile rows."""
import collections
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm.centroids import cluster_vectors, nearest_by_bounds
from bazaarlens.llm.common import read, stage
from bazaarlens.llm.topk import CoverTree, farthest_first, search_cell, top_products
from bazaarlens.llm.variants import acceptor, close_pairs, near_words, spelling_variants

BASE = "/root/testdata/sf0.001"


def whole(v, scale):
    return [int(np.floor(float(x) * scale)) for x in v]


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def hostile(spark):
    """Equal vectors in a third of the rows, ties, repeated rows, nulls, bad components, other lengths, clashing columns."""
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 0.1]) * r.random() for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 64) for i in range(150)]
    rows += [rows[0], rows[100], rows[100], (100, rows[3][1]), (None, rows[5][1]), (None, None), (7000, None), (7100, [None] * 64),
             (7200, [float("nan")] * 64), (7300, [float("inf")] + [0.0] * 63), (7400, [0.5] * 63), (7500, [])]
    return spark.createDataFrame([(i, v, "?", "?", "?", "?") for i, v in rows], "vec_id long, embedding array<float>, v string, cluster string, rank string, region string")


def brute_clusters(rows, k, rounds):
    kept = [(i, np.array(whole(v, 256))) for i, v in rows if fine(v) and len(v) == 64]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))
    c = np.array([v for _, v in order[:k]])
    x = np.array([v for _, v in kept])
    for t in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if t < rounds:
            c = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    near = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    return collections.Counter((i, int(j), int(n), int(near[own == j].sum()), int(near.sum()), sha[j]) for (i, _), j, n in zip(kept, own, near))


@pytest.mark.parametrize("k,rounds", [(40, 5), (7, 3), (500, 2)])
def test_clusters_equal_plain_lloyd(spark, hostile, k, rounds):
    rows = [tuple(r) for r in hostile.select("vec_id", "embedding").collect()]
    assert collections.Counter(map(tuple, cluster_vectors(hostile, k, rounds).collect())) == brute_clusters(rows, k, rounds)


def test_clusters_of_nothing(spark, hostile):
    out = cluster_vectors(hostile.limit(0))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not out.collect()


def test_history_bounds_save_work_and_stay_exact():
    """Clusters that have nearly settled: most distances are never measured again, and a centroid that comes back to where it
    was loosens nothing."""
    r = np.random.default_rng(0)
    centres = r.integers(-400, 400, (20, 16))
    x = (centres[r.integers(0, 20, 3000)] + r.integers(-30, 30, (3000, 16))).astype(np.int64)
    c = centres.astype(np.int64)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    cluster, near, at = d.argmin(1).astype(np.int32), d.min(1), np.zeros(len(x), np.int16)
    bounds, times = np.nextafter(np.sqrt(d.astype(float)).astype(np.float32), np.float32(-np.inf)), np.zeros(d.shape, np.int16)
    history, measured = [c], []
    for t in range(1, 6):
        history.append(c if t % 2 == 0 else c + r.integers(-3, 4, c.shape))
        measured.append(nearest_by_bounds(x, history, cluster, near, at, bounds, times))
        assert (cluster == ((x[:, None] - history[-1][None]) ** 2).sum(2).argmin(1)).all()
    assert sum(measured) < 0.02 * len(x) * len(c) * len(measured)
    far = [c, c + 500, c]   # summed drifts would be 1000 a component; the displacement is none
    cluster, near, at = d.argmin(1).astype(np.int32), d.min(1), np.zeros(len(x), np.int16)
    bounds, times = np.sqrt(d.astype(float)).astype(np.float32), np.zeros(d.shape, np.int16)
    assert nearest_by_bounds(x, far, cluster, near, at, bounds, times) < 0.02 * d.size


def brute_top(rows, k, every):
    size = max(len(v) for _, v in rows if fine(v))
    kept = [(i, np.array(whole(v, 1024) + [0] * (size - len(v)))) for i, v in rows if fine(v)]
    queries = {(i, tuple(v.tolist())): v for i, v in kept if i is not None and i % every == 0}
    out = collections.Counter()
    for (q, _), x in queries.items():
        best = sorted(((-int(v @ x), i is None, i or 0) for i, v in kept if i != q))[:k]
        out.update((q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(best))
    return out


@pytest.mark.parametrize("k,every", [(10, 100), (3, 7), (1000, 50)])
def test_top_products_equal_brute_force(spark, hostile, k, every):
    rows = [tuple(r) for r in hostile.select("vec_id", "embedding").collect()]
    assert collections.Counter(map(tuple, top_products(hostile, k, every).collect())) == brute_top(rows, k, every)


def test_top_products_over_many_cells(spark, hostile, monkeypatch):
    """Regions cut into many chunks and blocks."""
    from bazaarlens.llm import topk
    for name, value in (("SAMPLE_ROWS", 12), ("PIVOTS", 4), ("CHUNK_QUERIES", 10), ("BLOCK_ROWS", 20)):
        monkeypatch.setattr(topk, name, value)
    rows = [tuple(r) for r in hostile.select("vec_id", "embedding").collect()]
    assert collections.Counter(map(tuple, top_products(hostile, 5, 10).collect())) == brute_top(rows, 5, 10)


def test_top_products_of_nothing(hostile):
    for none in (hostile.limit(0), hostile.where("vec_id = 7000"), hostile.where("vec_id = 7500")):
        out = top_products(none)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and not out.collect()


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(1).normal(size=(2000, 5))
    tree = CoverTree(x)
    assert sorted(tree.order) == list(range(2000))
    for i in range(len(tree.centre)):
        own = tree.order[tree.lo[i]:tree.hi[i]]
        assert tree.centre[i] in own
        if tree.count[i]:
            radius = np.sqrt(((x[own] - x[tree.centre[i]]) ** 2).sum(1)).max()
            kids = range(tree.first[i], tree.first[i] + tree.count[i])
            assert sorted(own) == sorted(p for j in kids for p in tree.order[tree.lo[j]:tree.hi[j]])
            assert all(np.linalg.norm(x[tree.centre[a]] - x[tree.centre[b]]) > radius / 2 for a, b in combinations(kids, 2))


def test_dual_tree_prunes_clustered_data(monkeypatch):
    """Well apart clusters: few products are worked out, and the result is that of all of them."""
    from bazaarlens.llm import topk
    r = np.random.default_rng(2)
    centres = r.integers(-1000, 1000, (30, 16))
    x = centres[r.integers(0, 30, 4000)] + r.integers(-5, 6, (4000, 16))
    q, made, plain = x[::50], [], topk._products
    monkeypatch.setattr(topk, "_products", lambda a, b: made.append(len(a) * len(b)) or plain(a, b))
    ids = np.arange(len(x))
    least = np.sort(q @ x.T, axis=1)[:, -12]
    at, row, score = search_cell(q, ids[::50], least, x, ids, ids, 10)
    assert sum(made) < 0.3 * len(q) * len(x)
    s = q @ x.T
    s[np.arange(len(q)), ids[::50]] = -10 ** 9
    for i in range(len(q)):
        want = np.lexsort((ids, -s[i]))[:10]
        assert row[at == i].tolist() == want.tolist() and score[at == i].tolist() == s[i][want].tolist()


# spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_variants(rows, ratio=10):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    holes = collections.defaultdict(set)   # words that are equal when a place is left out, or a letter
    for w in n:
        for p in range(len(w)):
            holes[w[:p] + "\0" + w[p + 1:]].add(w)
            holes[w[:p] + w[p + 1:]].add(w)
    near = collections.defaultdict(set)
    for key, ws in holes.items():
        for a, b in combinations(ws, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
        if key in n:
            for w in ws:
                near[w].add(key)
                near[key].add(w)
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * k else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), k, len(near[w]), n[form[w]] if form[w] else None) for w, k in n.items()}


def test_pairs_of_random_words_once_each():
    r = random.Random(3)
    for letters, longest in (("ab", 8), ("abc", 6), ("a", 12), ("abcdefgh", 4)):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(200)})
        got = [frozenset(p) for p in close_pairs(words)]
        assert len(got) == len(set(got)) and set(got) == {frozenset((a, b)) for a, b in combinations(words, 2) if one_edit(a, b)}


def test_acceptor_is_minimal():
    words = sorted({a + m + z for a in ("un", "re", "") for m in ("do", "tie", "pack") for z in ("", "s", "ing")})
    arcs, final = acceptor(words)

    def accepted(s, x=""):
        return ([x] if final[s] else []) + [w for c, t in arcs[s].items() for w in accepted(t, x + c)]
    assert sorted(accepted(0)) == words
    reached, todo = {0}, [0]
    while todo:
        new = set(arcs[todo.pop()].values()) - reached
        reached |= new
        todo += new
    assert len({frozenset(accepted(s)) for s in reached}) == len(reached)   # no two states accept the same


@pytest.mark.parametrize("large", [5000, 3, 1])
def test_near_words_however_partitions_are_cut(spark, large):
    r = random.Random(4)
    words = {"commonprefix" + "".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(60)}
    words |= {"".join(r.choice("aé") for _ in range(r.randint(7, 9))) for _ in range(100)} | {"x" * 900, "x" * 899, "y" + "x" * 899, "x" * 500 + "z" + "x" * 399}
    n = {w: r.randint(2, 5) for w in sorted(words)}
    got = near_words(stage(spark.createDataFrame(list(n.items()), "word string, n long")), large).collect()
    want = {}
    for w in n:
        near = [v for v in n if v != w and one_edit(w, v)]
        if near:
            want[w] = (len(near), *min((-n[v], v) for v in near))
    assert {g["word"]: (g["n_near"], g["best"]["minus_n"], g["best"]["word"]) for g in got} == want


def test_variants_equal_brute_force(spark, edge):
    text = " ".join(["Mississippi"] * 900 + ["missisippi"] * 40 + ["missisipi"] * 2 + ["missisippi's", "MISSISSIPPI", "Übermaß"] * 2)
    planted = spark.createDataFrame([(i, text) for i in range(40)] + [(3, None), (None, text), (4, "a" * 30_000), (5, "a" * 30_000)], "doc_id long, text string")
    for docs in (read(spark, BASE), edge, planted):
        got = spelling_variants(docs)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert {r["word"]: tuple(r)[1:] for r in got.collect()} == brute_variants(rows) and got.count() == len(brute_variants(rows))
    chains = {r["word"]: r["root"] for r in spelling_variants(planted).collect()}
    assert chains["missisipi"] == "mississippi"   # two steps


def test_variants_of_nothing(spark, empty):
    assert not spelling_variants(empty).collect()
    assert not spelling_variants(empty.sparkSession.createDataFrame([(1, "one two 三"), (None, None), (2, "")], "doc_id long, text string")).collect()
