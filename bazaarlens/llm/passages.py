"""Substring dedup: units of text hashed, digests grouped globally, later occurrences cut out with their offsets."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, WORD, parts, stage, text_batches, tidied
from .shingles import _R, _RI, _power, mixed

__all__ = ["MIN_RUN_WORDS", "split_units", "unit_digests", "repeated_units", "repeated_spans", "dedup_passages", "removed_passages"]

UNIT_WORDS = 5        # the digest of a shorter unit also covers the words before it, up to so many in all
NEAR_WORDS = 4        # a unit also ends where the hash of the last two words is the least among so many places on either side
MIN_RUN_WORDS = 20    # repeated units in a row are removed from so many words on

# Scripts without spaces, whose letters count as half a word each and between which a unit may end.
UNSPACED = [(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFFEF)]
BLANK, LETTER, SOLO, MARK = range(4)
_PLANE = [chr(c) for c in range(0x10000)]
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in _PLANE], np.uint32)
_KIND = np.array([BLANK if c.isspace() else LETTER for c in _PLANE], np.uint8)
for _a, _b in UNSPACED:
    for _c in range(_a, _b + 1):
        if _KIND[_c] == LETTER:
            _KIND[_c] = MARK if unicodedata.category(_PLANE[_c])[0] == "M" else SOLO
_BREAK, _STOP, _FULL, _CLOSER = (np.isin(np.arange(0x10000), [ord(c) for c in x]) for x in ("\n\r\x0b\x0c\x85\u2028\u2029", ".!?…", "。！？｡", "\"')]}»”’"))


def _units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Text number, start, end, words and digest of the units of all texts, in order; see split_units."""
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    raw = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(raw, 0xFFFF)
    kind = _KIND[low]
    kind[(raw >= 0x20000) & (raw < 0x40000)] = SOLO
    before = np.concatenate(([BLANK], kind[:-1]))
    first = np.flatnonzero((kind == SOLO) | ((kind == LETTER) & (before != LETTER)) | ((kind == MARK) & (before == BLANK)))
    n = len(first)
    if not n:
        return *(np.zeros(0, np.int64) for _ in range(4)), []
    blank = np.flatnonzero(kind == BLANK)
    last = np.minimum(np.append(first[1:], len(raw)), blank[np.searchsorted(blank, first)])
    doc = np.searchsorted(ends, first, side="right")
    # hashes of the lower-cased words
    letters = mixed(np.where(raw < 0x10000, _LOWER[low], raw).astype(np.uint64) + np.uint64(1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * _power(_R, len(raw)))))
    word = mixed((total[last] - total[first]) * _power(_RI, len(raw))[first] + (last - first).astype(np.uint64))
    # unit ends: lines, sentences, texts, and places whose hash is the least around
    breaks = np.concatenate(([0], np.cumsum(_BREAK[low] & (raw < 0x10000))))
    following = np.append(first[1:], len(raw))
    tail, inner = low[last - 1], low[np.maximum(last - 2, first)]
    stop = (_STOP[tail] | (_CLOSER[tail] & _STOP[inner])) & (kind[last] == BLANK)
    fixed = (breaks[following] > breaks[last]) | stop | _FULL[tail] | np.append(doc[1:] != doc[:-1], True)
    value = np.where(fixed, np.uint64(0), mixed(word * np.uint64(3) + np.append(word[:1], word[:-1]) * np.uint64(5)) | np.uint64(1))
    value[np.append(True, fixed[:-1]) & ~fixed] = np.iinfo(np.uint64).max   # the word before is of another line or sentence
    value = np.concatenate((np.zeros(1, np.uint64), value))                 # the first text begins behind an end, as all others do
    least = value.copy()
    for k in range(1, min(NEAR_WORDS, n) + 1):
        least[k:] = np.minimum(least[k:], value[:-k])
        least[:-k] = np.minimum(least[:-k], value[k:])
    at = np.flatnonzero((value == least)[1:])          # last word of each unit
    begin = np.append(0, at[:-1] + 1)            # and its first
    # a unit takes the white space behind it, up to the last line break in there
    line = np.flatnonzero(_BREAK[low] & (raw < 0x10000))
    stop_at = following[at]
    broken = breaks[stop_at] > breaks[last[at]]
    stop_at = np.where(broken, line[np.maximum(np.searchsorted(line, stop_at) - 1, 0)] + 1, stop_at)
    of = doc[at]
    own_start = np.append(0, ends[:-1])
    closing = np.append(of[1:] != of[:-1], True)
    end = np.where(closing, ends[of] - 1, stop_at) - own_start[of]
    start = np.where(np.append(True, of[1:] != of[:-1]), 0, np.append(0, end[:-1]))
    solo = np.concatenate(([0], np.cumsum(kind[first] == SOLO)))
    words = at + 1 - begin - (solo[at + 1] - solo[begin]) // 2
    seen = np.maximum(np.minimum(begin, at + 1 - UNIT_WORDS), np.searchsorted(doc, of))
    held = word.tobytes()
    return of, start, end, words, [xxhash.xxh3_128_digest(held[8 * i:8 * j]) for i, j in zip(seen.tolist(), (at + 1).tolist())]


def split_units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text, gapless and in order; offsets in code points.

    A unit ends at each line break and sentence end, and between them after each word where the hash of the last two words is
    the least of all within NEAR_WORDS words. That hangs on these words alone, never on where the unit before ended, so copies
    of a passage have the same unit ends from its first NEAR_WORDS + 1 words on up to its last NEAR_WORDS. The digest is of the
    lower-cased words, so white space and case do not tell units apart; that of a unit of fewer than UNIT_WORDS words covers
    words before it, so that common short lines in another order are not taken for a copy. In scripts without spaces each
    letter is a place and half a word.
    """
    _, start, end, words, digests = _units([text])
    return list(zip(start.tolist(), end.tolist(), words.tolist(), digests))


NAME = ["r0", "r1", "r2", "r3"]


def _order(id_col: str, text_col: str) -> list[Column]:
    """A row's name and global order: id (nulls last), then two hashes that tell rows with one id apart."""
    return [F.col(id_col).isNull(), F.col(id_col).cast("long"), F.xxhash64(F.lit(11), text_col), F.xxhash64(F.lit(29), text_col)]


def unit_digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """r0..r3, start, size (its length and words), d0, d1 of every unit. What comes later works on these rows, not on texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", BATCH_BYTES):
                row, start, end, words, digests = _units(part.column("text").to_pylist())
                d0, d1 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in NAME] + [
                    pa.array(start.astype(np.int32)), pa.array((end - start) << 32 | words), pa.array(np.ascontiguousarray(d0)), pa.array(np.ascontiguousarray(d1))],
                    names=[*NAME, "start", "size", "d0", "d1"])

    named = docs.select(*[c.alias(n) for c, n in zip(_order(id_col, text_col), NAME)], F.col(text_col).alias("text"))
    return text_batches(named).mapInArrow(tidied(run), "r0 boolean, r1 long, r2 long, r3 long, start int, size long, d0 long, d1 long")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """r0..r3, start, size, first (r1 of the earliest occurrence) of every unit that has occurred earlier."""
    units = unit_digests(docs, id_col, text_col)
    place = F.struct(*NAME, "start")
    # the first places are stored, so that the join shuffles both sides and can split a unit that is everywhere
    first = stage(units.groupBy("d0", "d1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = units.join(first, ["d0", "d1"]).where(place != F.col("first"))
    return later.select(*NAME, "start", "size", F.col("first.r1").alias("first"))


@dataclass
class _Runs:
    """Repeated units in a row with enough words, of a batch of rows: row number, start, end, words, earliest document."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    first: pa.Array

    def lists(self, rows: int, *columns: pa.Array) -> pa.Array:
        """The columns as one list of structs (named as SPANS) for each row."""
        ends = np.concatenate(([0], np.cumsum(np.bincount(self.row, minlength=rows)))).astype(np.int32)
        fields = [pa.array(self.start, pa.int64()), pa.array(self.end, pa.int64()), pa.array(self.words, pa.int64()), self.first, *columns]
        items = pa.StructArray.from_arrays(fields, names=[*SPAN, "passage"][:len(fields)])
        return pa.ListArray.from_arrays(pa.array(ends), items, mask=pa.array(np.diff(ends) == 0) if rows else None)


def _runs(starts: pa.Array, sizes: pa.Array, firsts: pa.Array, min_words: int) -> _Runs:
    """Units come as lists in order of their start; they have no gaps, so a run goes on where the next starts at its end."""
    row = np.repeat(np.arange(len(starts)), pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False))
    start = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = sizes.flatten().to_numpy(zero_copy_only=False)
    if not len(row):
        return _Runs(row, start, start, start, firsts.flatten())
    end, words = start + (size >> 32), size & 0xFFFFFFFF
    opens = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != end[:-1]))))
    total = np.add.reduceat(words, opens)
    closes = np.append(opens[1:], len(row)) - 1
    keep = total >= min_words
    opens, closes = opens[keep], closes[keep]
    return _Runs(row[opens], start[opens], end[closes], total[keep], firsts.flatten().take(pa.array(opens)))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """r0..r3 and units: the repeated units of each row that has any. Repeated rows count once, so a row has no more units than its text."""
    units = repeated_units(docs, id_col, text_col)
    return units.groupBy(NAME).agg(F.collect_set(F.struct("start", "size", "first")).alias("units"))


SPAN = ["start", "end", "words", "first"]
SPANS = "array<struct<start:long,end:long,words:long,first:long>>"
UNITS = ["__starts", "__sizes", "__firsts"]


def _marked(docs: DataFrame, id_col: str, text_col: str, out: str, made: Column) -> DataFrame:
    """docs with ``out`` made from UNITS, the row's repeated units in order, and from __found, its text if it has any."""
    found = _found(docs, id_col, text_col).withColumnsRenamed({n: f"__{n}" for n in [*NAME, "units"]})
    keyed = docs.drop(out).withColumns({f"__o{i}": c for i, c in enumerate(_order(id_col, text_col))})
    same = F.lit(True)
    for i in range(len(NAME)):
        same = same & keyed[f"__o{i}"].eqNullSafe(found[f"__r{i}"])
    units = F.array_sort("__units")
    both = text_batches(keyed.join(found, same, "left")).withColumns({
        "__found": F.when(F.col("__units").isNotNull(), F.col(text_col)), **{n: units[n[2:-1]] for n in UNITS}})
    return both.withColumn(out, made).select(*[c for c in docs.columns if c != out], out)


def repeated_spans(docs: DataFrame, min_words: int = MIN_RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with ``out``: [start, end, words, first doc_id] of later occurrences, offsets into the original text; null if
    none. A column of that name is replaced.

    Units are ordered by doc_id (nulls last) and place; of equal units the first stays. Later ones go in runs of at least
    ``min_words`` words, so single short repeats stay. Null and empty texts have no units. Rows that agree in id and text
    are one occurrence and come out alike. An empty table gives an empty result.
    """
    def spans(starts: pa.Array, sizes: pa.Array, firsts: pa.Array) -> pa.Array:
        return _runs(starts, sizes, firsts, min_words).lists(len(starts))
    return _marked(docs, id_col, text_col, out, F.arrow_udf(spans, SPANS)(*UNITS))


def dedup_passages(docs: DataFrame, min_words: int = MIN_RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the later occurrences of repeated passages (see repeated_spans); documents made up of nothing else go.
    Only texts with repeated units go to Python, where each is walked once however many spans it has."""
    def rest(text: pa.Array, starts: pa.Array, sizes: pa.Array, firsts: pa.Array) -> pa.Array:
        runs = _runs(starts, sizes, firsts, min_words)
        out: list[str | None] = [None] * len(text)
        ends = np.searchsorted(runs.row, np.arange(len(text) + 1))
        for i in np.unique(runs.row).tolist():
            t, own = text[i].as_py(), slice(ends[i], ends[i + 1])
            out[i] = "".join(t[a:b] for a, b in zip([0] + runs.end[own].tolist(), runs.start[own].tolist() + [len(t)]))
        return pa.array(out, pa.string())
    cut = _marked(docs, id_col, text_col, "__rest", F.arrow_udf(rest, "string")("__found", *UNITS))
    left = cut.where(F.col("__rest").isNull() | F.col("__rest").rlike(WORD))
    return left.withColumn(text_col, F.coalesce("__rest", text_col)).select(docs.columns)


def removed_passages(docs: DataFrame, min_words: int = MIN_RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_doc_id, start, end, n_words, passage of every span that dedup_passages cuts."""
    def passages(text: pa.Array, starts: pa.Array, sizes: pa.Array, firsts: pa.Array) -> pa.Array:
        runs, last, t, out = _runs(starts, sizes, firsts, min_words), -1, "", []
        for i, a, b in zip(runs.row.tolist(), runs.start.tolist(), runs.end.tolist()):
            if i != last:
                last, t = i, text[i].as_py()
            out.append(t[a:b])
        return runs.lists(len(text), pa.array(out, pa.string()))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = _marked(named, "doc_id", "text", "s", F.arrow_udf(passages, SPANS[:-2] + ",passage:string>>")("__found", *UNITS))
    s = F.col("s")
    return marked.select("doc_id", F.explode("s").alias("s")).select(
        "doc_id", s["first"].alias("first_doc_id"), s["start"].alias("start"), s["end"].alias("end"), s["words"].alias("n_words"), s["passage"].alias("passage"))
