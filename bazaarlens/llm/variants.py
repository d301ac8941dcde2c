"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and with itself.

The composition's states are (state of the first word, edits so far, state of the second). While no edit is made both
words have read the same, so a pair is one path through the acceptor, one edit arc, and a common right language of the two
states that follow. The edit's place is made canonical, the longest common prefix, so every pair has one accepting path.

The initial states of the composition are dealt over tasks: a partition is a range of places for the edit together with
what both words read before it and after it. Every word lies in four of them: both halves of its length, and of the length
one above, for pairs with a longer word. A partition with too many words is cut into two ranges, down to a single place,
where words differ in one letter only and the alphabet bounds it. Each task minimises the acceptor of its partition's words
and enumerates its pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, release, stage, text_batches

__all__ = ["acceptor", "close_pairs", "vocabulary", "near_words", "spelling_variants"]

LARGE = 5_000       # words of a partition from which its range of places is cut in two
LONG = 256          # places of a range from which it is cut too: what is enumerated at a time stays short
HELD_WORDS = 200_000   # counts that a task holds before it sends them on
LETTERS = r"A-Za-zÀ-ÿ"


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """The minimal deterministic acceptor of sorted distinct words: arcs and finality by state, 0 is where it starts.
    Words are added in order; a state is shared as soon as no later word can change it."""
    arcs: list[dict[str, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[int] = [0]   # states of the last word
    last = ""

    def settle(depth: int) -> None:
        for i in range(len(last), depth, -1):
            s = path.pop()
            key = (final[s], tuple(arcs[s].items()))
            t = known.setdefault(key, s)
            arcs[path[-1]][last[i - 1]] = t
    for w in words:
        common = 0
        while common < len(last) and common < len(w) and last[common] == w[common]:
            common += 1
        settle(common)
        for c in w[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = w
    settle(0)
    return arcs, final


def close_pairs(words: list[str], after: str = "") -> Iterator[tuple[str, str]]:
    """Every pair of the sorted distinct words that is one edit apart, once; of different lengths the longer one first.

    ``after`` is the letter that follows all of them: a pair whose edit may as well be made there belongs to another range.
    """
    arcs, final = acceptor(words)
    shared: dict[tuple[int, int], list[str]] = {}

    def common(s: int, t: int) -> list[str]:
        """What both states accept."""
        key = (s, t) if s < t else (t, s)
        got = shared.get(key)
        if got is None:
            got = [""] if final[s] and final[t] else []
            a, b = (arcs[s], arcs[t]) if len(arcs[s]) <= len(arcs[t]) else (arcs[t], arcs[s])
            for c, u in a.items():
                v = b.get(c)
                if v is not None:
                    got += [c + y for y in (common(u, v) if u != v else right(u))]
            shared[key] = got
        return got

    def right(s: int) -> list[str]:
        got = shared.get((s, s))
        if got is None:
            got = shared[s, s] = ([""] if final[s] else []) + [c + y for c, u in arcs[s].items() for y in right(u)]
        return got

    def shorter(c: str, u: int, s: int) -> Iterator[str]:
        """What stands after the deleted c: it may not start with c, or the edit could be made later."""
        if final[u] and final[s] and after != c:
            yield ""
        for d, v in arcs[s].items():
            w = arcs[u].get(d)
            if d != c and w is not None:
                yield from (d + y for y in (common(w, v) if w != v else right(w)))

    todo = [("", 0)]
    while todo:
        x, s = todo.pop()
        own = arcs[s]
        letters = list(own.items())
        for i, (c, u) in enumerate(letters):
            todo.append((x + c, u))
            for y in shorter(c, u, s):
                yield x + c + y, x + y
            for d, v in letters[i + 1:]:
                for y in (common(u, v) if u != v else right(u)):
                    yield x + c + y, x + d + y


def vocabulary(docs: DataFrame, least_chars: int = 7, least_count: int = 2, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters (A-Z lower-cased) after the noise rule, those of enough code points and occurrences.

    The noise rule deletes one letter of a run where ``noise`` divides the crc32 of ``<id>:<run>``; a null id reads as
    nothing. Whole texts are read, a bounded piece of a batch at a time, and counts are added up before they are shuffled.
    """
    runs = re.compile("[" + LETTERS + "]{%d,}" % least_chars)   # shorter ones only get shorter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made
        for batch in batches:
            for b in parts(batch, "text"):
                for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                    if not t:
                        continue
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    found = Counter(runs.findall(t))
                    lowered: Counter = Counter()
                    for r, n in found.items():
                        lowered[r.encode().lower().decode() if not r.islower() else r] += n
                    for r, n in lowered.items():
                        h = zlib.crc32(r.encode(), start)
                        if not h % noise:
                            p = h % len(r)
                            r = r[:p] + r[p + 1:]
                            if len(r) < least_chars:
                                continue
                        held[r] += n
                    if len(held) > HELD_WORDS:
                        yield out()
        if held:
            yield out()
    words = text_batches(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))).mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _key(word: Column, m: Column, lo: Column, hi: Column) -> list[Column]:
    """What a word reads before and after the places lo to hi of words of length m."""
    n = F.length(word)
    return [F.substring(word, F.lit(1), lo).alias("before"), F.substring(word, n - (m - hi) + 1, m - hi).alias("after")]


KEY = ["m", "lo", "hi", "before", "after"]


def _dealt(words: DataFrame) -> DataFrame:
    """Each word in its four partitions."""
    n = F.length("word")
    w = words.select("word", "n", F.explode(F.array(n, n + 1)).alias("m"))
    half = F.ceil(F.col("m") / 2).cast("int")
    w = w.select("word", "n", "m", F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("m").alias("hi")))).alias("r"))
    return w.select("word", "n", "m", "r.lo", "r.hi").select("word", "n", "m", "lo", "hi", *_key(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")))


def _cut(words: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    w = words.select("word", "n", "m", F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))).alias("r"))
    return w.select("word", "n", "m", "r.lo", "r.hi").select("word", "n", "m", "lo", "hi", *_key(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")))


def _pairs_of(group: list[tuple[str, int]], m: int, lo: int, hi: int, after: str) -> Iterator[tuple[str, int, int, str]]:
    """word, its near words in this partition, and the best of them (most occurrences, then code points)."""
    middle = {w[lo:len(w) - (m - hi)]: (w, n) for w, n in group}
    count: Counter = Counter()
    best: dict[str, tuple[int, str]] = {}
    for a, b in close_pairs(sorted(middle), after[:1]):
        (v, n), (w, k) = middle[a], middle[b]
        if len(v) < m and len(w) < m:   # found among words of their own length
            continue
        count[v] += 1
        count[w] += 1
        best[v] = min(best.get(v, (-k, w)), (-k, w))
        best[w] = min(best.get(w, (-n, v)), (-n, v))
    for w, k in count.items():
        yield w, k, -best[w][0], best[w][1]


def _enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions stand together, in order; one is held at a time."""
    names = ["word", "near", "near_n", "near_word"]
    rows: list[tuple] = []
    now, group = None, []

    def flush() -> None:
        if len(group) > 1:
            m, lo, hi, _, after = now
            rows.extend(_pairs_of(group, m, lo, hi, after))

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names)
        rows.clear()
        return out
    for b in batches:
        keys = zip(*[b.column(c).to_pylist() for c in KEY])
        for key, w, n in zip(keys, b.column("word").to_pylist(), b.column("n").to_pylist()):
            if key != now:
                flush()
                now, group = key, []
            group.append((w, n))
            if len(rows) > 10_000:
                yield made()
    flush()
    yield made()


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """word, n_near and ``best`` (least of (-n, word) over its near words) of every word of a stored vocabulary that has one.

    What a partition gives is one row per word, not its pairs; a pair lies in exactly one partition, so counts add up.
    """
    done, open_ = None, _dealt(words)
    while True:
        sizes = open_.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
        places = F.col("hi") - F.col("lo")
        big = stage(sizes.where(((F.col("size") > large) & (places > 1)) | ((F.col("size") > 1) & (places > LONG))).drop("size"))
        if big.isEmpty():
            release(big)
            break
        small = open_.join(big, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = stage(_cut(open_.join(big, KEY, "left_semi")))
    dealt = open_ if done is None else done.unionByName(open_)
    together = dealt.repartition(*[F.col(c) for c in KEY]).sortWithinPartitions(*KEY)
    found = together.mapInArrow(_enumerated, "word string, near long, near_n long, near_word string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near_word").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) along the forms, which grow tenfold at every step: the distance doubles each round."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = stage(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(now)
        now = then
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = 10, least_chars: int = 7, least_count: int = 2, noise: int = 31,
                      id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    Null and empty texts have no words. A word's form is its near word (one code point inserted, deleted or replaced) of
    most occurrences, ties to the first in code-point order, where that has ``ratio`` times its own; the root is the end
    of the chain of forms. Repeated rows count each; a null id reads as nothing in the noise rule. Very long runs are words
    like others. An empty table gives an empty result. Other columns are not carried, so their names cannot clash.
    """
    words = stage(vocabulary(docs, least_chars, least_count, noise, id_col, text_col))
    near = near_words(words, large)
    form = F.when(-F.col("best.minus_n") >= ratio * F.col("n"), F.col("best.word"))
    with_form = stage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
                                                              F.when(form.isNotNull(), -F.col("best.minus_n")).alias("form_n")))
    release(words)
    roots = _roots(with_form.where("form IS NOT NULL"))
    return with_form.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
