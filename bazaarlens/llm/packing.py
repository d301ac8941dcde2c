"""Best-fit packing of token pieces into sequences: large-item matching, then best fit, planned on length counts."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stage, text_batches, tidied

__all__ = ["CAPACITY", "END_ID", "encode_pieces", "packing_plan", "pack_pieces", "pack_documents"]

CAPACITY, END_ID = 4096, 1
CACHE_WORDS = 250_000     # words a Python worker remembers; then it starts anew
SIGNS = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[a-zß-öø-ÿ].)[!-&(-/:-@\[-`{-~]*(?= )")   # signs after a letter; no apostrophe, which may begin a run with letters
PLAIN = re.compile(r"^[a-zß-öø-ÿ]+$", re.MULTILINE)


class _WordTokenizer:
    """Ids of whole texts, word by word: the vocabulary's pre-tokenizer drops white space and never joins across it.

    In Latin-1 texts, where lower-casing goes character by character, words are also remembered in lower case and
    without the signs after their last letter, which are a token run of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        # words of lower-case letters need no normalising and are one run: the model takes them as they are, and a run's last token is told by its end
        self.runs, suffix = None, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.runs = Tokenizer(self.tokenizer.model)
            self.runs.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        # a special token stands between words that are encoded as one string, and is found among the ids again
        self.mark = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|")), None)

    @staticmethod
    def _words(text: str) -> list[str]:
        text = text.replace("\n", " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        # "<|" may begin a special token, which is told by its case
        return (text if "<|" in text else SIGNS.sub(r" \g<0>", text.lower() + " ")).split(" ")

    def _add_runs(self, new: set[str]) -> list[str]:
        """Remember the new words of lower-case letters alone; returns the others."""
        runs = PLAIN.findall("\n".join(new)) if self.runs else []
        for a in range(0, len(runs), 2000):
            part = runs[a:a + 2000]
            ids = np.array(self.runs.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), strict=True):
                self.cache[w] = raw[start:end]
                start = end
        return list(new.difference(runs))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self._words(t or "") for t in texts]
        seen = set().union(*split)
        if len(self.cache) > CACHE_WORDS:   # what is in use stays
            self.cache = {w: self.cache[w] for w in seen if w in self.cache}
        new = self._add_runs(seen.difference(self.cache))
        plain = [w for w in new if "<|" not in w] if self.mark else []
        for a in range(0, len(plain), 2000):
            part = plain[a:a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(part)], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, [*np.flatnonzero(ids == self.mark[1]).tolist(), len(ids)]):
                self.cache[w] = raw[4 * start:4 * end]
                start = end + 1
        rest = [w for w in new if "<|" in w] if self.mark else new
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _WordTokenizer:
    return _WordTokenizer(path)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                  tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document's pieces of at most capacity."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in parts(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), _tokenizer(path).encode(part.column("text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(cut) // 4, cut)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return text_batches(source).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids binary")


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, pieces per sequence, offset of the first) for counts of each length.

    Pieces longer than a third of the capacity are matched first: the longest takes the longest that still fits, so a
    sequence holds at most two of them. The others go, longest first, into the tightest gaps, and last into new
    sequences. Sequences of equal make-up are one entry, so the plan's size hangs on the capacity, not on the input.
    """
    plan, used, next_sequence = [], defaultdict(int), 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)   # gap -> [(first sequence, sequences)]
    left = {n: c for n, c in counts.items() if c > 0}

    def put(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + pieces, first, each, offset))
        used[length] += pieces
        left[length] -= pieces

    def place(length: int, gap: int, first: int, number: int) -> None:
        """Fill up to ``number`` sequences of one gap; the unfilled rest goes back."""
        each, offset = gap // length, capacity - gap
        full = min(number, left[length] // each)
        if full:
            put(length, full * each, first, each, offset)
            gaps[gap - each * length].append((first, full))
        first, number, rest = first + full, number - full, min(left[length], each)
        if number and rest:
            put(length, rest, first, rest, offset)
            gaps[gap - rest * length].append((first, 1))
            first, number = first + 1, number - 1
        if number:
            gaps[gap].append((first, number))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:
            if m > n or m + n > capacity or not left[m]:
                continue
            pairs = min(left[n], left[m]) if m != n else left[n] // 2
            if pairs:
                first, next_sequence = next_sequence, next_sequence + pairs
                if m == n:
                    put(n, 2 * pairs, first, 2, 0)
                else:
                    put(n, pairs, first, 1, 0)
                    put(m, pairs, first, 1, n)
                gaps[capacity - n - m].append((first, pairs))
            if not left[n]:
                break
        if left[n]:
            first, alone = next_sequence, left[n]
            next_sequence += alone
            put(n, alone, first, 1, 0)
            gaps[capacity - n].append((first, alone))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity):
            while left[n] and gaps.get(gap):
                place(n, gap, *gaps[gap].pop())
            if not left[n]:
                break
        if left[n]:
            number = -(-left[n] // (capacity // n))
            first, next_sequence = next_sequence, next_sequence + number
            place(n, capacity, first, number)
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, row: str | None = None) -> DataFrame:
    """pieces (doc_id, piece, length and any more) with sequence_id and offset.

    The lengths are counted over all pieces (at most ``capacity`` counts), the plan is made from the counts, and pieces
    take its places by their rank among those of their length. Ranks are dealt within hash groups of a length, so
    neither a common length nor the whole table meets in one task. ``pieces`` is read twice: pass a stored table. ``row``
    names a stored number of each row, dropped here, which tells repeated rows apart; without it they are numbered together.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    key = ["doc_id", "piece"] + ([row] if row else [])
    group = max(250, sum(counts.values()) // 50_000)   # rows numbered together
    plan = spark.createDataFrame(packing_plan(counts, capacity), "length long, lo long, hi long, first long, each long, at long")
    salts = spark.createDataFrame([(n, -(-c // group)) for n, c in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*key), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt")
    starts = salted.groupBy("length", "salt").count().select("length", "salt", (F.sum("count").over(before) - F.col("count")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy(*key)
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= lo AND rank < hi")
    step = F.col("rank") - F.col("lo")
    return placed.withColumns({"sequence_id": (F.col("first") + F.floor(step / F.col("each"))).cast("long"),
                               "offset": (F.col("at") + F.pmod(step, F.col("each")) * F.col("length")).cast("long")}).drop(
        "salt", "own", "before", "rank", "lo", "hi", "first", "each", "at", *([row] if row else []))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed each. Ties in length are ordered by
    doc_id (nulls first) and piece. Other columns are not carried, so their names cannot clash. An empty table gives an
    empty result. Token ids themselves come from encode_pieces; pack_pieces keeps whatever columns it is given.
    """
    digest = encode_pieces(docs, capacity=capacity, **columns).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(stage(digest.withColumn("row", F.monotonically_increasing_id())), capacity, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
