"""Each operator against a brute-force version, and on rows that are null, empty, long, equal or repeated."""
import collections
import hashlib
import random
import re
import string
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import near
from bazaarlens.llm.common import read, stage
from bazaarlens.llm.components import connected_components
from bazaarlens.llm.exact import exact_dedup
from bazaarlens.llm.html import extract_pages, page_text
from bazaarlens.llm.licenses import PHRASES, TEMPLATES, scan_licenses
from bazaarlens.llm.lines import dedup_lines
from bazaarlens.llm.packing import encode_pieces, pack_documents, packing_plan
from bazaarlens.llm.passages import MIN_RUN_WORDS, dedup_passages, removed_passages, repeated_spans, split_units
from bazaarlens.llm.pieces import PieceModel, decode_column, encode_column, token_digests
from bazaarlens.llm.quality import analyse, fit_lines, fit_on_labels, keep_good, quality_report, viterbi
from bazaarlens.llm.sharding import kd_shards

BASE = "/root/testdata/sf0.001"
SPACE = "[\x20\x09-\x0D]"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def tables(spark, edge):
    return [read(spark, BASE), edge]


# near-duplicates

def shingles(text, k):
    w = re.findall(f"[^{SPACE[1:]}+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(sets[i]), d if not sets[i] else min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates_match_brute_force(spark, edge):
    for docs, words in zip(tables(spark, edge), (5, 4)):
        got = near.near_duplicates(docs, words=words).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows_of(docs), words, 80)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_regions_are_searched_deeper_and_in_blocks(spark, monkeypatch):
    """A chain of texts, each near only to its neighbours, and a family around the threshold; regions never fit a task."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(80):
        base = [w if rng.random() > 0.02 else f"v{rng.randrange(10**6)}" for w in base]
        rows.append((i, " ".join(base)))
    root = [f"r{rng.randrange(10**6)}" for _ in range(200)]   # copies of one text, many of them just below the threshold to each other
    for i in range(80, 200):
        rows.append((i, " ".join(w if rng.random() > 0.028 else f"v{rng.randrange(10**6)}" for w in root)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "REGION_ROWS", 4)
    monkeypatch.setattr(near, "BLOCK_ROWS", 5)
    got = near.near_duplicates(docs, words=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, 4, 80)


def test_pairs_at_the_threshold_meet_on_every_level(spark):
    """Planted pairs of sets at 0.80 to 0.82: each level by itself brings all of them together."""
    rng, sets = np.random.default_rng(6), []
    for k in range(400):
        common, own = 400, 44 + k % 7
        values = rng.integers(1, 2**63, common + 2 * own, np.uint64)
        assert 0.80 <= common / (common + 2 * own) < 0.82
        sets += [np.unique(np.concatenate((values[:common], values[common + side * own:common + (side + 1) * own]))) for side in (0, 1)]
    rows = [(i, s.tobytes(), x.tobytes()) for i, (s, x) in enumerate(zip(sets, near.sketches(sets)))]
    classes = stage(spark.createDataFrame(rows, "id long, values binary, sketch binary"))
    for level, (depth, trees) in enumerate(near.LEVELS):
        forest = near.forest(classes, depth, trees) if level == 0 else near.deep_forest(classes, level, depth, trees)
        met = forest.groupBy("region", F.floor(F.col("id") / 2).alias("pair")).count().where("count > 1").select("pair").distinct().count()
        assert met == 400


def test_neighbours_in_sorted_orders_are_near(spark):
    """Copies with a few words changed are found by the sorted orders alone, a few pairs each however many there are."""
    rng = random.Random(7)
    root = [f"r{i}" for i in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"v{rng.randrange(10**6)}" for w in root)) for i in range(300)]
    classes = near.describe_sets(spark.createDataFrame(rows, "doc_id long, text string"), 5, "doc_id", "text").select(F.col("doc_id").alias("id"), "sketch")
    pairs = near.tree_neighbours(stage(classes), 4, near.ORDER_TREES, 90).collect()
    assert len(pairs) <= 300 * near.ORDER_TREES * near.NEIGHBOURS
    assert len({x for p in pairs for x in p}) > 290


def test_sets_of_rows_that_share_ids(spark):
    """Half the rows have no id or one id, with texts that differ or repeat: each set is made once, from its own text."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)] * 3 + [(100 + i, t + " more") for i, t in enumerate(texts)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, 5, 80)


def test_components_of_long_chains(spark):
    order = list(range(2000))
    random.Random(1).shuffle(order)
    links = list(zip(order, order[1:1500])) + list(zip(order[1500:], order[1501:]))
    got = {r["id"]: r["comp"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in order[:1500]}) == 1 and len({got[i] for i in order[1500:]}) == 1
    assert got[order[0]] != got[order[-1]]


def test_near_dedup_on_nothing(spark, empty):
    assert near.near_duplicates(empty).collect() == [] and near.keep_one(empty).columns == empty.columns


def test_keep_one_leaves_one_row_of_each_group(spark):
    """Repeated rows, near copies with one id, and groups without ids."""
    words = [[f"{c}{i}" for i in range(100)] for c in "abcd"]
    near_copy = [" ".join(w[:99] + ["other"]) for w in words]
    a, b, c, d = map(" ".join, words)
    rows = [(1, a, None)] * 5 + [(2, a, "x"), (3, b, "x"), (3, near_copy[1], "y"), (None, c, "x"), (None, c, "x"), (None, near_copy[2], "y"), (None, d, "x"), (7, d, "x"), (8, "", "x"), (8, "", "x"), (None, None, "x")]
    got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    assert got.columns == ["doc_id", "text", "kept"]
    got = [tuple(r) for r in got.collect()]
    groups = [[r for r in got if r[1] and r[1][0] == g] for g in "abcd"]
    assert [len(g) for g in groups] == [1] * 4 and groups[0] == [(1, a, None)] and groups[3] == [(7, d, "x")] and len(got) == 7


# passages and lines

def brute_passages(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, units = {}, []
    for i, (_, t) in enumerate(rows):
        units.append(split_units(t or ""))
        for k, u in enumerate(units[-1]):
            first.setdefault(u[3], (i, k))
    out = []
    for i, us in enumerate(units):
        late = [k for k, u in enumerate(us) if first[u[3]] != (i, k)]
        for _, g in groupby(enumerate(late), lambda x: x[1] - x[0]):
            run = [x for _, x in g]
            words = sum(us[k][2] for k in run)
            if words >= MIN_RUN_WORDS:
                out.append((rows[i][0], rows[first[us[run[0]][3]][0]][0], us[run[0]][0], us[run[-1]][1], words))
    return sorted(out)


def test_passages_match_brute_force(spark):
    docs = read(spark, BASE)
    text = dict(rows_of(docs))
    got = removed_passages(docs).collect()
    assert sorted((r["doc_id"], r["first_doc_id"], r["start"], r["end"], r["n_words"]) for r in got) == brute_passages(rows_of(docs))
    assert all(text[r["doc_id"]][r["start"]:r["end"]] == r["passage"] for r in got) and got
    cut = dict(text)
    for r in sorted(got, key=lambda r: -r["start"]):
        cut[r["doc_id"]] = cut[r["doc_id"]][:r["start"]] + cut[r["doc_id"]][r["end"]:]
    left = {i: t for i, t in cut.items() if t == text[i] or t.strip(" \t\n\r\x0b\x0c")}
    assert dict(rows_of(dedup_passages(docs))) == left


def test_planted_passage_is_cut_wherever_it_stands(spark):
    rng = random.Random(2)

    def prose(n):
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) + (rng.random() < 0.12) * "." for _ in range(n))
    passage = "Here begins what all repeat. " + prose(60).capitalize() + "."
    rows = [(i, prose(80) + (" " + passage + " " if i in (3, 5, 9) else " ") + prose(80)) for i in range(12)]
    out = {i: t for i, t in rows_of(dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")))}
    for i, t in rows:
        if i in (5, 9):
            assert passage[10:-10] not in out[i] and len(out[i]) < len(t)
        else:
            assert out[i] == t


def repeated_words(rows, n=MIN_RUN_WORDS):
    """Per text, which of its words stand in a window of n words that stood anywhere earlier; no units."""
    seen, out = set(), {}
    for i, t in rows:
        w = t.lower().split()
        windows = [" ".join(w[k:k + n]) for k in range(len(w) - n + 1)]
        out[i] = {k + j for k, x in enumerate(windows) if x in seen for j in range(n)}
        seen.update(windows)
    return out


def test_passages_against_word_windows(spark):
    """Passages of 60 words put into other texts, in styles where the old unit ends hung on what stood before them."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    styles = [" ".join, lambda w: " ".join(w).upper(), " | ".join, lambda w: "\n".join(" ".join(w[k:k + 2]) for k in range(0, len(w), 2)),
              lambda w: ". ".join(" ".join(w[k:k + 13]) for k in range(0, len(w), 13)).title()]
    rows = []
    for style in styles:
        for _ in range(40):
            passage = style(rng.choices(words, k=60))
            for _ in range(2):
                rows.append((len(rows), style(rng.choices(words, k=rng.randint(30, 50))) + " " + passage + " " + style(rng.choices(words, k=30))))
    want, got = repeated_words(rows), collections.defaultdict(set)
    for r in removed_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        before = len(dict(rows)[r["doc_id"]][:r["start"]].split())
        got[r["doc_id"]] |= set(range(before, before + len(r["passage"].split())))
    for i, _ in rows:
        assert got[i] <= want[i] and (not want[i] or len(got[i]) >= MIN_RUN_WORDS)
    assert sum(map(len, got.values())) > 0.75 * sum(map(len, want.values()))


def test_units_of_short_lines_and_of_text_without_spaces():
    """Common lines in a new order are no copy; a passage without spaces is found inside other text."""
    lines = [f"item{i}\n" for i in range(60)]
    a, b = ("".join(x) for x in (lines, lines[::2] + lines[1::2]))
    digests = {u[3] for u in split_units(a)}
    assert sum(u[2] for u in split_units(b) if u[3] in digests) < 5
    rng = random.Random(4)
    a, passage, b = ("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n)) for n in (150, 120, 170))
    same = {u[3] for u in split_units(a + passage)} & {u[3] for u in split_units(b + passage + a)}
    assert sum(u[2] for u in split_units(b + passage) if u[3] in same) >= 40


def test_many_spans_of_one_text_are_cut_in_one_walk(spark):
    """Thousands of copied passages in one long text, each between words of its own."""
    line = [f"this sentence number {i} is told in {i % 7} ways and it has words enough to be one that goes when it comes again here." for i in range(4000)]
    rows = [(1, "\n".join(line)), (2, "\n".join(f"{x}\nown {i} {i * 31}." for i, x in enumerate(line)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed_passages(df).count() == 4000
    assert dict(rows_of(dedup_passages(df)))[2].split("\n")[:3] == ["own 0 0.", "own 1 31.", "own 2 62."]


def test_passages_on_edge_rows(edge, empty):
    out = dedup_passages(edge)
    assert out.columns == edge.columns
    marked = repeated_spans(edge, out="spans")
    assert marked.columns == [c for c in edge.columns if c != "spans"] + ["spans"] and marked.count() == edge.count()
    assert marked.where("spans is not null and doc_id = 50").count() == 2
    kept = collections.Counter(r["doc_id"] for r in out.collect())
    assert kept[50] == 0 and kept[0] == 1 and kept[60] == 1 and kept[2] == 1 and kept[4] == 1   # copies of 0 go, null and empty stay
    assert dedup_passages(empty).collect() == [] and removed_passages(empty).collect() == []


def brute_lines(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for key in rows:
        lines = (key[1] or "").split("\n")
        tidy = [re.sub(SPACE + "+", " ", x).strip(" ") for x in lines]
        full = [i for i, x in enumerate(tidy) if x]
        gone = set()
        for j in range(len(full) - 2):
            window = tuple(tidy[i] for i in full[j:j + 3])
            if window in seen:
                gone.update(full[j:j + 3])
            seen.add(window)
        out[key] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else key[1])
    return out


def test_lines_match_brute_force(spark, edge):
    loop = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc\n\nd"), (2, "x\n\na\n b \nc"), (3, "a\na\na\na\na"), (4, "b\nc")], "doc_id long, text string")
    for docs in [*tables(spark, edge), loop]:
        rows = rows_of(docs)
        marked = docs.withColumn("was", F.col("text"))
        got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(marked).collect()), key=str)
        want = brute_lines(rows)
        assert got == sorted(((d, *want[d, t]) for d, t in rows), key=str)


def test_lines_on_nothing(empty):
    assert dedup_lines(empty).collect() == []


# sharding and exact dedup

def test_shards_of_rows_that_repeat(spark):
    """Half the rows have no id and one text: their bytes are spread like all others."""
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("text "), F.col("id"))).otherwise("the same text").alias("text"))
    got = collections.defaultdict(int)
    for r in kd_shards(df, shards=40).collect():
        got[r["shard"]] += r["size"]
    assert len(got) == 40 and max(got.values()) < 1.25 * min(got.values())


def test_packing_of_rows_that_repeat(spark):
    """Twelve hundred equal rows without ids: each has its own place."""
    df = spark.range(1200).select(F.lit(None).cast("long").alias("doc_id"), F.lit("seven words stand here in each row").alias("text"))
    got = pack_documents(df).collect()
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(got) == len(places) == 1200 and len({s for s, _ in places}) == -(-1200 * got[0]["length"] // 4096)


def test_shards(spark, edge, empty):
    for docs in tables(spark, edge):
        rows, got = rows_of(docs), kd_shards(docs, shards=8).collect()
        want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
        held = collections.defaultdict(list)
        for r in got:
            held[r["shard"]].append(r["slot"])
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        assert all(sorted(s) == list(range(len(s))) for s in held.values())
    weight = collections.Counter()
    where = collections.defaultdict(set)
    for r in kd_shards(read(spark, BASE), shards=8).collect():
        weight[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert max(weight.values()) - min(weight.values()) <= 35_000 and all(len(s) == 1 for s in where.values())
    assert kd_shards(empty).collect() == []


def test_a_group_that_outweighs_a_shard_is_split(spark):
    rows = [(i, "the same text " * 20) for i in range(600)] + [(600 + i, f"text {i} " * 20) for i in range(400)]
    got = kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).toPandas().groupby("shard")["size"].sum()
    assert len(got) == 10 and got.max() < 1.3 * got.mean()


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[re.sub(SPACE, "", t or "")].append((d, t or ""))
    out = []
    for n, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(d, best[0], len(g), (d, len(t)) == (best[0], len(best[1])), hashlib.sha256(n.encode()).hexdigest()) for d, t in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_exact_dedup(spark, edge, empty, monkeypatch, limit):
    monkeypatch.setattr("bazaarlens.llm.exact.BROADCAST_ROWS", limit)
    for docs in tables(spark, edge):
        got = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_dedup(docs).collect()]
        assert sorted(got, key=str) == brute_exact(rows_of(docs))
    assert exact_dedup(empty).collect() == []


# pages

def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article class="post-17"><h1>Head&nbsp;line</h1><p>First &lt;b&gt;  paragraph
    here, with <a href=y>a link</a>.<p>Second one<br>after a break.</p><aside>see also</aside><form><p>mail</p></form><script>var x = "</p>";</script>
    <div class="comments"><p>I disagree with all of this, and at length, really, as readers do in comments.</p></div></article>
    <div class="sidebar"><p>Other things that are long enough to count as some text on their own.</p></div><footer>&copy; me</footer></body>"""
    want = "Head line\nFirst <b> paragraph here, with a link.\nSecond one\nafter a break."
    rows = [(1, "http://a.org/1", page), (1, "http://a.org/1", page), (2, None, page), (None, "http://a.org/3", None), (4, "http://a.org/4", ""), (5, "x", "plain & simple"), (6, "http://a.org/5", "<p>broken <b>text<!-- gone")]
    pages = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, host string, paths string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract_pages(pages).collect())
    texts = [("1", want), ("1", want), ("2", want), ("None", ""), ("4", ""), ("5", "plain & simple"), ("6", "broken text")]
    assert got == sorted((i, t, len(t)) for i, t in texts)
    assert extract_pages(pages.limit(0)).collect() == []


def test_names_of_containers():
    page = """<body class="has-sidebar"><div class="content with-sidebar"><p>The story is told here in some words.</p></div>
    <article class="comment"><p>A reader has more to say about this than the story itself, and says it at length.</p></article></body>"""
    assert page_text(page, None) == "The story is told here in some words."


def test_title_and_lead_beside_the_body_are_kept(spark):
    """The best-scored container is only a part of the article; menus and side columns stay out."""
    title, lead, body = "A title of some words", "The lead tells in short what came to pass. " * 7, "<p>" + "The story goes on and on here. " * 100 + "</p>"
    inner = f"<h1>{title}</h1><div class=lead>{lead}</div><div class=body>{body}</div>"
    side = "<div class=links><a href=x>one link to elsewhere and</a><a href=y>another one</a></div><div class=sidebar>" + "Side text. " * 30 + "</div>"
    two = f"<div class=a>{body * 7}</div><div class=b>{body * 3}</div>"
    shapes = [f"<body>{side}<article>{inner}</article></body>", f"<body>{side}<div class=post>{inner}</div></body>", f"<body>{side}<main><h1>{title}</h1><article>{lead}{body}</article></main></body>",
              f"<body>{side}<div class=post>{two}</div></body>", f"<body>{side}<article>{two}</article></body>"]
    rows = [(10 * k + i, f"http://h{k}.net/{i}", page) for k, page in enumerate(shapes) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        assert "Side" not in text and "link" not in text
        if i < 30:
            assert text.startswith(title) and lead.strip() in text and text.count("goes on") == 100
        else:
            assert text.count("goes on") == 1000


def test_names_of_paragraphs_and_headings():
    page = """<article><h1 class="page-header">Title</h1><p>The story is told here in some words.<p class="advert">Buy this.<p>It goes on.
    <h2 class="related">More like this</h2><p class='comment'>I <b>say<br>no</b></p>and ends<address class="notice"><p>Mind</p>the step</address>
    <p>at last.</p><p class="cookie-notice">We <span class="ad">bake</article>"""
    assert page_text(page, None) == "Title\nThe story is told here in some words.\nIt goes on.\nand ends\nat last."


BODY = "".join(f"<p>This is paragraph {i} of the article, long enough to be real text.</p>" for i in range(5))
STORY = "Title\n" + "\n".join(f"This is paragraph {i} of the article, long enough to be real text." for i in range(5))
READERS = "".join(f"<div class=comment><p>A reader, the {i}th of them, says this and that at length and goes on.</p></div>" for i in range(20))


@pytest.mark.parametrize("tag", ["div class='article-with-comments'", "div class='post share-page'", "div class='search-article content'",
                                 "article class='article notice-board'", "article class='notice-board'", "div class='sidebar-layout'"])
def test_a_name_alone_discards_no_article(spark, tag):
    """Nor do the readers' comments in it, or beside it and longer than it, make it one."""
    end, inner = tag.split()[0], f"<h1>Title</h1>{BODY}"
    side = "<div class=sidebar><a href=x>one</a> side</div>"
    shapes = [f"<body>{side}<{tag}>{inner}</{end}><footer>f</footer></body>",
              f"<body>{side}<{tag}>{inner}<div id=comments>{READERS}</div></{end}></body>"]
    assert [page_text(page, None) for page in shapes] == [STORY] * 2
    rows = [(i, f"http://h.net/{i}", page) for i, page in enumerate(shapes * 2)]
    assert {r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {STORY}


def test_asides_stay_out_whatever_their_share():
    inner = f"<h1>Title</h1>{BODY}"
    for name in ("adBox", "cookieBar", "reader-responses", "postComments", "article-footer", "content-sidebar"):
        assert page_text(f"<body><div class=x>{inner}<div class='{name}'><p>Some text that is long enough to be real text here.</p></div></div></body>", None) == STORY
    assert page_text(f"<body><div class=post>{inner}</div><div id=comments>{READERS}</div></body>", None) == STORY
    assert page_text("<body><nav>x</nav><div class=ad>Just an advert of some length and nothing else</div></body>", None) == ""
    assert page_text(f"<body><div class=sidebar><a href=x>not closed</a><article>{inner}</article></body>", None) == STORY
    assert page_text("<body><article><p><a href=x>all of it in a link</a></p></article></body>", None) == "all of it in a link"
    assert page_text("<div class=ad>" * 20000 + "deep", None) == ""


def test_a_winning_path_is_no_aside(spark):
    """A short article in a container of a doubtful name, with more text beside it, follows the host's other pages."""
    def page(story, beside):
        return f"<html><body><div class='share-page'><h1>Title</h1><p>{story}</p></div><div class='box'><p>{beside}</p></div></body></html>"
    rows = [(i, f"http://h.net/{i}", page("word " * 60, "short")) for i in range(9)] + [(9, "http://h.net/9", page("a brief story", "word " * 90))]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Title\na brief story"


def test_consensus_overrules_a_page(spark):
    """A page whose side column is longer than its story follows the host's path."""
    def page(story, side):
        return f"<html><body><div class='story'><p>{story}</p></div><div class='column'><p>{side}</p></div></body></html>"
    rows = [(i, f"http://h.net/{i}", page("word " * 60, "short")) for i in range(9)] + [(9, "http://h.net/9", page("a brief story", "word " * 90))]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "a brief story" and page_text(rows[9][2], None).startswith("word")


# tokens

def test_sentencepiece_round_trip(spark, edge, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in tables(spark, edge):
        got = decode_column(encode_column(docs)).select("doc_id", "text", "ids", "decoded").collect()
        for r in got:
            ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == library.decode(ids)
    assert encode_column(empty).collect() == [] and token_digests(empty).collect() == []


def test_sentencepiece_on_odd_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    rng = random.Random(3)
    letters = "ab▁ \n\t'é中文日本語𝔘😀<s></s>theTHEiń‍\x00\x01ÿ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * 3000, " " * 500, "abab" * 200, "▁▁"]
    encoded = library.encode(texts, add_bos=True, add_eos=True)
    assert model.encode(texts) == [np.array(e, "<u4").tobytes() for e in encoded]
    odd = [[rng.randrange(0, 400) for _ in range(20)] for _ in range(200)]
    assert model.decode([np.array(e, "<u4").tobytes() for e in odd]) == [library.decode(e) for e in odd]


def test_packing(spark, edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in tables(spark, edge):
        got, want = pack_documents(docs).collect(), []
        for d, t in rows_of(docs):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            want += [(d, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        held = collections.defaultdict(list)
        for r in got:
            held[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in held.values():
            end = 0
            for at, n in sorted(s):
                assert at == end
                end += n
            assert end <= 4096
    assert pack_documents(empty).collect() == [] and encode_pieces(empty).collect() == []


def test_plain_words_skip_the_normaliser():
    """Words of lower-case letters go to the model itself, signs after a letter are a word of their own, ids stay the library's."""
    from tokenizers import Tokenizer

    from bazaarlens.llm.packing import _WordTokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, ours = Tokenizer.from_file(path), _WordTokenizer(path)
    texts = ["The größte thing&&& isn't it's. a-b?! x²; ''. end", "stra\u00dfe,### l'eau <|endoftext|> He said:", "", "ÀÉ été... 12,5 a"]
    assert [np.frombuffer(b, "<u4").tolist() for b in ours.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert "thing&&&" not in ours.cache and "&&&" in ours.cache

    class Counted:
        words = []

        def encode_batch_fast(self, texts, **how):
            self.words += texts
            return whole.encode_batch_fast(texts, **how)
    ours.tokenizer = Counted()
    ours.encode(["plain größte words, anew"])
    assert "".join(Counted.words).strip() in ("", ",")


def test_packing_plan_fills_sequences():
    rng = random.Random(4)
    for most in (40, 1400, 4096):
        counts = collections.Counter(rng.randint(1, most) for _ in range(2000))
        plan = packing_plan(dict(counts))
        fill, large = collections.Counter(), collections.Counter()
        for n, lo, hi, first, each, _ in plan:
            for r in range(lo, hi):
                fill[first + (r - lo) // each] += n
                large[first + (r - lo) // each] += 3 * n > 4096
        total = sum(n * c for n, c in counts.items())
        assert sum(hi - lo for _, lo, hi, *_ in plan) == 2000 and max(fill.values()) <= 4096 and max(large.values()) <= 2
        assert len(fill) <= max(-(-total // 4096) * 1.02 + 1, sum(c for n, c in counts.items() if 2 * n > 4096) * 1.1 + 1)


# licenses and quality

def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses(spark, edge, empty):
    twice = spark.createDataFrame([(1, "MIT license mit licensE, cc-by Cc by"), (2, "KMIT x license")], "doc_id long, text string")
    for docs in [*tables(spark, edge), twice]:
        got = scan_licenses(docs).collect()
        assert sorted((str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)) == sorted(str((d, *brute_phrases(t))) for d, t in rows_of(docs))
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert scan_licenses(empty).collect() == []


def test_license_text_with_a_word_put_in_is_found(spark):
    text = ("Lead in words. Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files "
            "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software and so on")
    got = scan_licenses(spark.createDataFrame([(1, text), (2, text[:120])], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {1: "text-mit", 2: ""}


def test_reserved_notices_and_scattered_words(spark):
    """The notice stands with or without a year and name; a template's words dealt over a long text are no license text."""
    words = re.findall(r"[a-z0-9]+", TEMPLATES["text-mit"].lower())
    pieces = [words[k:k + 3] for k in range(0, len(words), 3)]
    scattered = " ".join(" ".join(p) + " x y" for p in pieces)
    rows = [(1, "All rights reserved."), (2, "Copyright 2024 Some Name. All rights reserved. More text."), (3, "Copyright. All rights reserved."), (4, "All of the rights reserved"),
            (5, scattered), (6, scattered + " " + TEMPLATES["text-mit"] + " " + scattered)]
    got = {r["doc_id"]: r["labels"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "notice-reserved", 2: "notice-reserved", 3: "notice-reserved", 4: "", 5: "", 6: "text-mit"}


def brute_quality(text):
    w = re.findall(f"[^{SPACE[1:]}+", text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(f"[^{SPACE[1:]}", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, edge, empty):
    labels = read(spark, BASE, "labels")
    for docs in tables(spark, edge):
        got = quality_report(docs, labels).collect()
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted((str(tuple(r[c] for c in names)) for r in got)) == sorted(str((d, *brute_quality(t))) for d, t in rows_of(docs))
        assert all(not r["kept"] or not r["base_failed"] for r in got)
    none = labels.limit(0)
    assert fit_on_labels(edge, none) is None and quality_report(empty, none).collect() == []
    assert all(r["kept"] != r["base_failed"] for r in quality_report(edge, none).collect())
    assert keep_good(edge, labels).columns == edge.columns


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = read(spark, base), read(spark, base, "labels")
    got = quality_report(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    texts = [("\n".join(" ".join(["word"] * rng.integers(1, 9)) + rng.choice(["", "!!", " #$%"]) for _ in range(rng.integers(1, 8)))).encode() for _ in range(40)]
    _, line_doc, _, x = analyse(texts)
    label = (x[:, 3] == 0).astype(int)
    model = fit_lines(x, line_doc, label, len(texts), rounds=60)
    got = viterbi(model, x, line_doc, len(texts))
    for d in range(len(texts)):
        s = x[line_doc == d] @ model.emit.T
        paths = [[p >> k & 1 for k in range(len(s))] for p in range(2 ** len(s))]
        value = [sum(s[k, y] for k, y in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:])) for p in paths]
        assert got[line_doc == d].tolist() == paths[int(np.argmax(value))]
    assert (got == label).mean() > 0.9
