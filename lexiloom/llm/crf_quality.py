"""Quality classifier: a linear-chain conditional random field over a text's lines.

Each line with a word is labelled good or bad from its own figures and its neighbours' (shares of capitals, digits,
symbols, bars, repeated words, repeated lines, lengths). Weights are trained in numpy by gradient ascent on the chains'
conditional likelihood; a training line bears its document's label. A text's score is the mean of its lines' forward-
backward marginals of good, weighted by length.

The field is fitted on at most `max_train` labelled rows, the first by a hash of the id, as long as their lines do not exceed
`max_lines` together; every text is scored whole. Texts become figures of their lines on executors, and only the figures of
the rows that are fitted on come to the driver. A training line bears its document's label, so transitions learn how much
neighbouring lines agree. Null
and empty texts, and texts without words, are one empty line. Rows that repeat an id are scored each; labels that are null
are not used; with fewer than two classes in training all scores are the share of good ones (0.5 without any). Empty tables
give empty results; other columns and their names don't matter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, dropped, text_or_empty, written
from .shingles import word_hashes

#: Labelled rows, and lines of all of them, that a model is fitted on at most.
MAX_TRAIN, MAX_LINES = 4000, 200_000


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_KINDS = [
    _class(bytes(range(65, 91))),  # capitals
    _class(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])),  # letters: ASCII, or the first byte of others
    _class(b"0123456789"),
    _class(b"#*$%&<>@^~=+\\{}[]_"),
    _class(b"|"),
    _class(b"!?"),
    _class(b".,;:"),
    _class(bytes(range(0xC0, 0xF8))),  # first bytes of other than ASCII
    1 - _class(bytes(range(0x80, 0xC0))),  # characters
]
N_FIGURES = 15


def line_figures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of texts in lines, the lines' figures and their lengths in characters."""
    lines: list[bytes] = []
    again: list[bool] = []
    bounds = [0]
    for t in texts:
        own = [x for x in t.split(b"\n") if x.strip(b" \t\v\f\r")] or [b""]
        seen: set[bytes] = set()
        for x in own:
            again.append(x in seen)
            seen.add(x)
        lines += own
        bounds.append(len(lines))
    buf = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    lens = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    starts = np.cumsum(lens) - lens
    count = [np.add.reduceat(kind[buf], starts, dtype=np.int64).astype(float) for kind in _KINDS]
    capital, letter, digit, symbol, bar, bang, stop, other, chars = count
    chars = chars - 1
    at, hashes = word_hashes(buf)
    line = np.searchsorted(starts, at, side="right") - 1
    words = np.bincount(line, minlength=len(lines)).astype(float)
    same_line = line[1:] == line[:-1]
    next_alike = np.bincount(line[1:][same_line & (hashes[1:] == hashes[:-1])], minlength=len(lines))
    order = np.lexsort((hashes, line))
    h, n = hashes[order], line[order]
    distinct = np.bincount(n[np.concatenate([[True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])])] if len(n) else n, minlength=len(lines))
    share = lambda x, of: x / np.maximum(of, 1)
    x = np.stack([np.log1p(chars), np.log1p(words), share(capital, letter), share(digit, chars), share(symbol, words), share(bar, words), share(bang, words), share(stop, words), share(next_alike, words), 1 - share(distinct, np.maximum(words, 1)), share(chars, words), share(other, chars), share(letter, chars), np.array(again, float), (words < 8).astype(float)], axis=1)
    return np.array(bounds, np.int64), x, np.maximum(chars, 1)


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Figures of each line, of the line before and after it, and whether it is the first or last."""
    n = len(x)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((n, 1))], axis=1)


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of good against bad
    moves: np.ndarray  # scores of a label after a label

    def emissions(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, bounds) @ self.weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        bounds, x, chars = line_figures(texts)
        good, _, _ = marginals(self.emissions(x, bounds), bounds, self.moves)
        return np.add.reduceat(good * chars, bounds[:-1]) / np.add.reduceat(chars, bounds[:-1])


def marginals(emission: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good of every line, expected counts of moves and the log partition function of all chains together.
    Chains go step by step at once; the longest come first, so those that still run are a prefix."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, n = bounds[:-1][order], n[order]
    e = np.stack([np.zeros_like(emission), emission], axis=1)
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    longest = int(n[0]) if len(n) else 0
    running = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(longest):
        at = start[: running[t]] + t
        forward[at] = e[at] if t == 0 else e[at] + np.logaddexp(forward[at - 1, :1] + moves[0], forward[at - 1, 1:] + moves[1])
    for t in range(longest - 2, -1, -1):
        at = start[: running[t + 1]] + t
        follow = e[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(moves[:, 0] + follow[:, :1], moves[:, 1] + follow[:, 1:])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(e), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + moves[None] + (e[at] + backward[at])[:, None, :] - total[at][:, None, None]
    return good, np.exp(pair).sum(axis=0), float(total[bounds[:-1]].sum())


def fit(bounds: np.ndarray, x: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.08, decay: float = 1e-3) -> Field | None:
    """A field from texts as their bounds in lines and the lines' figures, and the texts' labels (1: good); None with fewer
    than two classes."""
    if len(set(labels.tolist())) < 2:
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    phi = with_neighbours((x - mean) / scale, bounds)
    y = np.repeat(labels.astype(float), np.diff(bounds))
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    # Each document weighs alike, else the longest would set the weights.
    params = np.zeros(phi.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        moves = params[-4:].reshape(2, 2)
        good, pairs, _ = marginals(phi @ params[:-4], bounds, moves)
        grad = np.concatenate([phi.T @ (y - good), (seen - pairs).ravel()]) / len(labels) - decay * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, params[:-4], params[-4:].reshape(2, 2))


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_lines: int = MAX_LINES) -> tuple[Field | None, float]:
    """A field and the share of good rows, from docs (doc_id, text) and labels (doc_id, quality) that are not held out.
    A labelled id gives one row: of repeated labels the lowest, of repeated documents the text with the least hash."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    chosen = chosen.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            bounds, x, _ = line_figures(batch.column("text").cast(pa.binary()).to_pylist())
            raw = [x[a:b].astype("<f4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("hash"), pa.array(np.diff(bounds)), pa.array(raw, pa.binary())], names=["doc_id", "quality", "hash", "lines", "x"])

    found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("hash"), "text")
    made = written(found.mapInArrow(figures, f"doc_id {kind}, quality int, hash long, lines long, x binary"), "quality-train")
    sizes = made.groupBy("doc_id").agg(F.min_by("lines", "hash").alias("lines")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # max_train rows
    within = np.cumsum([r.lines for r in sizes]) <= max_lines
    ids = [r.doc_id for r, w in zip(sizes, within, strict=True) if w]
    use = made.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind}")), "doc_id")
    rows = sorted(use.groupBy("doc_id").agg(F.min_by("x", "hash").alias("x"), F.first("quality").alias("quality")).collect())
    dropped(made)
    if not rows:
        return None, 0.5
    y = np.array([r.quality for r in rows], int)
    x = [np.frombuffer(r.x, "<f4").reshape(-1, N_FIGURES).astype(float) for r in rows]
    return fit(np.concatenate([[0], np.cumsum([len(p) for p in x])]), np.concatenate(x), y), float(y.mean())


def scored(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    docs = documents.select("doc_id", text_or_empty("text").alias("text"))
    field, share = train(docs, labels.select("doc_id", "quality"), max_train)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 << 20):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            score = field.score(texts) if field else np.full(len(texts), share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])

    out = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
