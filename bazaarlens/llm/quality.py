"""Quality rules: counts over whole texts, and a linear-chain CRF that labels lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, parts, text_batches, tidied
from .shingles import mixed, word_hashes

__all__ = ["LineModel", "analyse", "fit_lines", "viterbi", "fit_on_labels", "measure", "judge", "quality_report", "keep_good"]

TRAIN_ROWS = 1500        # labelled documents that a model is fitted on; the only sample in this module
TRAIN_LINES = 64         # lines of each that it sees
TRAIN_BYTES = 200_000    # longer texts are not chosen for the fit
MIN_WORDS, MAX_REPEAT = 50, 50   # base rule: fewer words, or more than this percentage of words in repeated windows
CONTENT_SHARE = 0.5      # of a document's words that must stand in content lines

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CLASSES = {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "shout": b"!", "stop": b".,;:?", "digit": b"0123456789"}
FEATURES = ["bias", "words", "length", "symbol", "upper", "shout", "stop", "digit", "again", "repeat"]


@dataclass
class LineModel:
    """Weights (2 labels x FEATURES) and transitions (2 x 2) of the CRF; label 1 is content."""

    emit: np.ndarray
    move: np.ndarray


def analyse(texts: list[bytes | None]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text, and doc, words and features of every line that has a word, in order."""
    n = len(texts)
    w = word_hashes(texts, lower=False, gap=b"\n")
    raw, doc, first, last = w.raw, w.doc, w.first, w.last
    n_words = np.bincount(doc, minlength=n)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))       # code points before each byte
    word_chars = np.bincount(doc, lead[last] - lead[first], n).astype(np.int64)
    symbol_at = np.flatnonzero(SYMBOLS[raw])
    n_symbols = np.bincount(np.searchsorted(w.ends, symbol_at, side="right"), minlength=n)
    # words in three-word windows that a text holds twice or more
    covered = np.zeros(len(doc), bool)
    if len(doc) > 2:
        same = np.flatnonzero(doc[:-2] == doc[2:])
        window = mixed(w.hash[same] * np.uint64(3) + w.hash[same + 1] * np.uint64(5) + w.hash[same + 2] * np.uint64(7) + doc[same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
        twice = same[counts[inverse] > 1]
        for j in range(3):
            covered[twice + j] = True
    n_repeat = np.bincount(doc[covered], minlength=n)
    # lines with a word: every text ends with a line break in raw
    line_end = np.flatnonzero(raw == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    of_word = np.searchsorted(line_end, first)
    full, line_words = np.unique(of_word, return_counts=True)
    start, end = line_start[full], line_end[full]
    line_doc = np.searchsorted(w.ends, start, side="right")
    name = mixed(w.span_hash(start, end) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.ones(len(full), bool)
    again[np.unique(name, return_index=True)[1]] = False
    n_dup = np.bincount(line_doc[again], minlength=n)
    x = np.ones((len(full), len(FEATURES)))
    chars = np.maximum(lead[end] - lead[start], 1)
    x[:, 1] = np.log1p(line_words) / 5
    x[:, 2] = np.minimum(chars / line_words, 30) / 10
    for k, letters in enumerate(CLASSES.values(), 3):
        table = np.zeros(256, np.int64)
        table[list(letters)] = 1
        total = np.concatenate(([0], np.cumsum(table[raw])))
        x[:, k] = np.minimum((total[end] - total[start]) / (chars if k in (4, 7) else line_words), 3)
    x[:, 8] = again
    x[:, 9] = np.bincount(of_word[covered], minlength=len(line_end))[full] / line_words
    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    return counts, line_doc, line_words, x


def _padded(line_doc: np.ndarray, n: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and length of each line in a (text, line) matrix."""
    length = np.bincount(line_doc, minlength=n)
    column = np.arange(len(line_doc)) - np.repeat(np.cumsum(length) - length, length)
    return line_doc, column, length if most is None else np.minimum(length, most)


def fit_lines(x: np.ndarray, line_doc: np.ndarray, label: np.ndarray, n: int, rounds: int = 200, rate: float = 0.1, penalty: float = 3e-4) -> LineModel:
    """Maximum likelihood of the chains by gradient steps (Adam); marginals by forward and backward sums over all chains at once."""
    row, col, length = _padded(line_doc, n, TRAIN_LINES)
    use = col < TRAIN_LINES
    row, col, x, label = row[use], col[use], x[use], label[use]
    steps = int(length.max(initial=0))
    real = np.arange(steps)[None] < length[:, None]
    y = np.zeros((n, steps), int)
    y[row, col] = label
    theta = np.zeros(2 * x.shape[1] + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    true_emit = np.stack([x[label == k].sum(0) for k in (0, 1)])
    both = real[:, 1:]
    true_move = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    for k in range(1, rounds + 1):
        emit, move = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        s = np.zeros((n, steps, 2))
        s[row, col] = x @ emit.T
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0]
        for t in range(1, steps):
            fwd[:, t] = np.where(real[:, t, None], s[:, t] + np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]), fwd[:, t - 1])
        for t in range(steps - 2, -1, -1):
            ahead = s[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.where(real[:, t + 1, None], np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:]), 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - z[:, None, None])[row, col]
        pair = np.exp(fwd[:, :-1, :, None] + move + (s + bwd)[:, 1:, None, :] - z[:, None, None, None])
        gradient = np.concatenate(((true_emit - p.T @ x).ravel(), (true_move - pair[both].sum(0)).ravel())) / max(1, len(x)) - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient ** 2
        theta = theta + rate * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.999 ** k)) + 1e-8)
    return LineModel(theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2))


def viterbi(model: LineModel, x: np.ndarray, line_doc: np.ndarray, n: int) -> np.ndarray:
    """The best label of every line; texts advance together, longest first, so a long one costs only its own lines."""
    _, _, length = _padded(line_doc, n)
    start = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    score = x @ model.emit.T
    back = np.zeros((len(x), 2), np.int8)
    active = order[length[order] > 0]
    best = score[start[active]]
    last = np.zeros((n, 2))
    last[active] = best
    for t in range(1, int(length.max(initial=0))):
        active = active[:np.searchsorted(-length[active], -t, side="left")]
        at = start[active] + t
        ways = best[:len(active), :, None] + model.move
        back[at] = ways.argmax(1)
        best = ways.max(1) + score[at]
        last[active] = best
    out = np.zeros(len(x), np.int8)
    active = order[length[order] > 0]
    state = last[active].argmax(1)
    for t in range(int(length.max(initial=0)) - 1, -1, -1):
        alive = np.searchsorted(-length[active], -t, side="left")
        at = start[active[:alive]] + t
        out[at] = state[:alive]
        state[:alive] = back[at, state[:alive]]
    return out


def fit_on_labels(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> LineModel | None:
    """A model from at most ``rows`` labelled documents, those with the smallest hash of doc_id; None where none is labelled
    or the labels are all alike.

    Lines of documents of quality 0 count as boilerplate, those of quality 1 as content. Marking single repeated lines of
    good documents as boilerplate was tried and turned whole good documents, since labels stick from line to line.

    The sample is bounded: one text of each id, texts of more than TRAIN_BYTES are not chosen, and the first TRAIN_LINES lines
    of each are fitted. Only the fit is; every row is judged by its whole text.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    text = text.where(F.octet_length("text") <= TRAIN_BYTES)
    got = text.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    got = sorted((r["doc_id"], r["text"], r["quality"]) for r in got)
    quality = np.array([q for _, _, q in got], int)
    _, line_doc, _, x = analyse([t.encode() for _, t, _ in got])
    label = quality[line_doc]
    if len(np.unique(label)) < 2:
        return None
    return fit_lines(x, line_doc, label, len(got))


def measure(docs: DataFrame, model: LineModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words.
    Columns of these names are replaced."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words"]
    fields = [f for f in docs.schema.fields if f.name in keep and f.name not in made]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in made])
    text = text_col if text_col in keep and text_col not in made else "__text"   # a kept text is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text, BATCH_BYTES):
                n = part.num_rows
                counts, line_doc, line_words, x = analyse(part.column(text).cast(pa.binary()).to_pylist())
                content = np.ones(len(x), int) if model is None else viterbi(model, x, line_doc, n)
                counts["content_words"] = np.bincount(line_doc, line_words * content, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(counts[c], pa.int64()) for c in made], names=names + made)

    names = [f.name for f in fields]
    return text_batches(docs).select(*names, *([] if text in names else [F.col(text_col).alias(text)])).mapInArrow(tidied(run), schema)


def judge(measured: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """measured with base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_words") >= share * F.col("n_words")))


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words of every row.

    A row is kept when it passes the base rules (50 words; at most half the words in repeated three-word windows) and at
    least half its words stand in lines that the CRF labels as content.

    Null and empty texts have no words and fail. Repeated rows come out alike. Without usable labels every line is
    content. Extra columns are not carried. An empty table gives an empty result.
    """
    model = fit_on_labels(docs, labels, id_col=id_col, text_col=text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return judge(measure(named, model, ["doc_id"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    model = fit_on_labels(docs, labels, id_col=id_col, text_col=text_col)
    inner = docs.withColumnsRenamed({c: f"__{i}" for i, c in enumerate(docs.columns)})   # no name can clash
    text = inner.columns[docs.columns.index(text_col)]
    return judge(measure(inner, model, inner.columns, text)).where("kept").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
