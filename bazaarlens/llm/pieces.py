"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, text_batches

__all__ = ["PieceModel", "encode_column", "decode_column", "token_digests"]

MARK = "▁"                 # stands for a space inside pieces
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
CACHE_WORDS = 300_000           # words a Python worker remembers; then it starts anew
BLOCK_CHARS = 100_000           # characters merged in one numpy block; larger ones leave the CPU's cache
NONE = np.int32(2**31 - 1)
TABLE_BITS = 20                  # slots of the pair table, as a power of two
TABLE = 1 << TABLE_BITS


class PieceModel:
    """Encodes and decodes like the sentencepiece library does for a BPE model with identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        kinds = [p.type for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)}
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.byte = np.array([next(i for i, p in enumerate(model.pieces) if p.piece == f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([p.score for p in model.pieces])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # equal scores share a rank: the left one goes first
        self.char = np.full(0x110000, -1, np.int32)
        pairs, follows = {}, set()
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            follows.update(zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self._hash_pairs(pairs, rank)
        # ranks whose pieces never join in a better-ranked pair: all their places in a segment may merge at once
        self.calm = np.ones(rank.max() + 1, bool)
        for k, i in pairs.items():
            for part in (k >> 32, k & 0xFFFFFFFF):
                if rank[i] <= rank[part]:
                    self.calm[rank[part]] = False
        # two characters that no piece holds side by side are never merged across
        self.follows = np.array(sorted(ord(a) << 32 | ord(b) for a, b in follows), np.int64)
        # what each id decodes to
        text = [p.piece.replace(MARK, " ").encode() if k in (1, 4, 5) else b"" for p, k in zip(model.pieces, kinds)]
        for b, i in enumerate(self.byte.tolist()):
            text[i] = bytes([b])
        text[model.trainer_spec.unk_id] = model.trainer_spec.unk_surface.encode()
        self.size = np.array([len(t) for t in text], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.is_byte = np.zeros(len(text), bool)
        self.is_byte[self.byte] = True
        self.cache: dict[str, bytes] = {}

    def _hash_pairs(self, pairs: dict[int, int], rank: np.ndarray) -> None:
        """An open hash table of the pairs, probed with array operations."""
        self.keys, self.merged = np.full(TABLE, -1, np.int64), np.zeros(TABLE, np.int32)
        left, self.probes = np.array(list(pairs), np.int64), 0
        value, slot = np.array(list(pairs.values()), np.int32), self._slot(left)
        while len(left):  # of those that want a slot the first gets it if it is free, the others try the next one
            self.probes += 1
            first = np.unique(slot, return_index=True)[1]
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.merged[slot[first]] = left[first], value[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, value, slot = left[rest], value[rest], (slot[rest] + 1) % TABLE
        self.rank = np.where(self.keys >= 0, rank[self.merged], NONE)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the pairs (a, b) in the table, -1 where none."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        at = np.where(self.keys[slot] == key, slot, -1)
        # a used slot with another key: look further
        open_ = np.flatnonzero((at < 0) & (self.keys[slot] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + step) % TABLE
            hit = self.keys[s] == key[open_]
            at[open_[hit]] = s[hit]
            open_ = open_[~hit & (self.keys[s] >= 0)]
        return at

    def _merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over all segments at once until none has a pair: each merges its best-ranked pair, leftmost first."""
        done_sym, done_seg = [], []
        slot = np.full(len(sym), -1, np.int64)
        fresh = np.arange(len(sym) - 1)
        while len(sym):
            # pairs of a symbol with its right neighbour, where one of them is new
            fresh = fresh[(seg[fresh] == seg[fresh + 1]) & (sym[fresh] >= 0) & (sym[fresh + 1] >= 0)]
            slot[fresh] = self._lookup(sym[fresh], sym[fresh + 1])
            rank = np.where(slot >= 0, self.rank[slot], NONE)
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            low = np.minimum.reduceat(rank, starts)
            best = np.repeat(low, np.diff(np.append(starts, len(seg))))
            if (low == NONE).any():
                settled = best == NONE
                done_sym.append(sym[settled])
                done_seg.append(seg[settled])
                live = ~settled
                sym, seg, slot, rank, best = sym[live], seg[live], slot[live], rank[live], best[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            # of places in a row, which overlap, every second one
            new_run = np.concatenate(([True], np.diff(at) != 1))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - run_start) % 2 == 0
            first = np.concatenate(([True], seg[at[1:]] != seg[at[:-1]]))
            at = at[(take & self.calm[rank[at]]) | first]
            sym[at] = self.merged[slot[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            slot[at] = -1
            slot[np.maximum(at - 1, 0)] = -1
            at = at - np.arange(len(at))  # each merge before moves a place one to the left
            sym, seg, slot = sym[keep], seg[keep], slot[keep]
            fresh = np.concatenate((at, at - 1))
            fresh = fresh[(fresh >= 0) & (fresh < len(sym) - 1)]
        if not done_sym:
            return sym, seg
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def _encode_block(self, words: list[str]) -> list[bytes]:
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.char[code]
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int32)
        near = code[:-1] << 32 | code[1:]
        at = np.minimum(np.searchsorted(self.follows, near), len(self.follows) - 1)
        cut = (word[:-1] != word[1:]) | (self.follows[at] != near)
        seg = np.concatenate(([0], np.cumsum(cut)))
        word_of = word[np.concatenate(([True], cut))]
        sym, seg = self._merge(sym, seg)
        word = word_of[seg]
        if (sym < 0).any():  # unknown characters fall back to their bytes
            ids = [[s] if s >= 0 else self.byte[list(chr(-1 - s).encode())].tolist() for s in sym.tolist()]
            word = np.repeat(word, [len(x) for x in ids])
            sym = np.array([s for x in ids for s in x], np.int32)
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        data = sym.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _learn(self, words: list[str]) -> None:
        block, chars = [], 0
        for w in words:
            block.append(w)
            chars += len(w)
            if chars > BLOCK_CHARS:
                self.cache.update(zip(block, self._encode_block(block)))
                block, chars = [], 0
        if block:
            self.cache.update(zip(block, self._encode_block(block)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, with the begin and end ids."""
        split = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.cache))
        if new:
            self._learn(new)
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        return [begin + b"".join(map(self.cache.__getitem__, words)) + end for words in split]

    def decode(self, rows: list[bytes | None]) -> list[str]:
        """Texts of id rows. Bytes that are no UTF-8 become one U+FFFD each."""
        ids = np.frombuffer(b"".join(r or b"" for r in rows), "<u4").astype(np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.text[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.cumsum([len(r or b"") // 4 for r in rows])
        visible = np.append(np.flatnonzero(size), len(ids))
        lead = visible[np.searchsorted(visible, np.append(0, at[:-1]))]  # the first id of each row that has text
        bounds = [0, *(int(ends[a - 1]) if a else 0 for a in at)]
        out = []
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            raw = data[a:b]
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = self._decode_broken(np.frombuffer(rows[k], "<u4").astype(np.int64))
            dummy = text.startswith(" ") and not self.is_byte[ids[lead[k]]]
            out.append(text[1:] if dummy else text)
        return out

    def _decode_broken(self, ids: np.ndarray) -> str:
        parts, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.text[self.start[i]:self.start[i] + 1].tobytes()
                continue
            parts.append(run.decode(errors="surrogateescape"))
            run = b""
            if i >= 0:
                parts.append(self.text[self.start[i]:self.start[i] + self.size[i]].tobytes().decode())
        return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in "".join(parts))


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, convert) -> DataFrame:
    """df with one more column made from another, in Arrow batches; a column of that name is replaced."""
    df = df.drop(target) if target != source else df
    schema = T.StructType([f for f in df.schema.fields if f.name != target] + [T.StructField(target, kind)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, source):
                made = pa.array(convert(part.column(source).to_pylist()), arrow)
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns) if n != target]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [made], names=[n for n, _ in kept] + [target])

    return text_batches(df).mapInArrow(run, schema)


def encode_column(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """df with ids_col: the ids of the whole text as little-endian unsigned 32-bit integers, begin and end ids included.

    Null text is empty: begin and end only. Rows are independent, so repeated rows, ties and ids do not matter. A column
    named as the result is replaced; all others stay. An empty table gives an empty result.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return _mapped(df, text_col, ids_col, T.BinaryType(), lambda texts: _model(path).encode(texts))


def decode_column(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str | None = None) -> DataFrame:
    """df with text_col: the text of ids_col (see encode_column). Null ids are none: the empty text."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return _mapped(df, ids_col, text_col, T.StringType(), lambda rows: _model(path).decode(rows))


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    both = decode_column(encode_column(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
