"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are the shapes of three neighbouring characters, hashed words, and bins of a few whole-text counts. A bounded
sample of labelled texts (`sample` rows by hash, never of the held-out part) gives term weights, a truncated singular
value decomposition and the labelled vectors; all of them are broadcast and their size is fixed by parameters. Every
document's vector meets all labelled vectors in blocks of exact cosine products; its `neighbours` nearest vote with
weights that fall with the angle, and the score is the weighted share of label 1.

Edge cases: a null text counts as empty; an empty text has the vector of its counts and is scored like any other;
without labels, or with one class, the score is the share of label 1 (0.5 without any); of repeated labels of one
document the highest counts; rows with null labels aren't learned from; extra columns pass through `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality_rules, textkernel

#: Classes of bytes: 0 other lower-case letters, 1 vowels, 2 capitals, 3 digits, 4 space, 5 line ends, 6 ".", 7 ",",
#: 8 "!", 9 "|", 10 other symbols, 11 other ASCII, 12 beyond ASCII.
SHAPES = 13
_SHAPE = np.full(256, 11, np.int64)
_SHAPE[128:] = 12
_SHAPE[97:123] = 0
_SHAPE[[ord(c) for c in "aeiou"]] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[[ord(c) for c in "#*$%&<>"]] = 10
_SHAPE[[32, 10, 46, 44, 33, 124]] = [4, 5, 6, 7, 8, 9]
_STATS, _BINS = 6, 12


@dataclass(frozen=True)
class Voting:
    sample: int = 6000
    word_terms: int = 1024
    rank: int = 48
    neighbours: int = 25
    sharpness: float = 12.0
    block: int = 2048
    keep_from: float = 0.7


def terms(v: Voting) -> int:
    return SHAPES**3 + v.word_terms + _STATS * _BINS


def features(raw: np.ndarray, at: np.ndarray, v: Voting) -> np.ndarray:
    """Term weights (row by row, before the corpus weights): damped relative frequencies."""
    n, width = len(at) - 1, terms(v)
    out = np.zeros((n, width), np.float32)
    if not n:
        return out
    size = np.diff(at)
    if len(raw) > 2:
        text = np.repeat(np.arange(n), size)
        shape = _SHAPE[raw]
        inside = text[2:] == text[:-2]
        code = (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:]
        flat = np.bincount((text[2:] * SHAPES**3 + code)[inside], minlength=n * SHAPES**3).reshape(n, -1)
        out[:, : SHAPES**3] = np.sqrt(flat / np.maximum(1, size)[:, None])
    hashes, _, _, first = textkernel.words(raw, at, lower=True)
    count = np.diff(first)
    if len(hashes):
        owner = np.repeat(np.arange(n), count)
        flat = np.bincount(owner * v.word_terms + (hashes % textkernel.U(v.word_terms)).astype(np.int64), minlength=n * v.word_terms).reshape(n, -1)
        out[:, SHAPES**3 : SHAPES**3 + v.word_terms] = 0.5 * np.sqrt(flat / np.maximum(1, count)[:, None])
    grams, whole = textkernel.shingles(hashes, first, 5)
    space = textkernel.SPACE[raw]
    for i in range(n):
        part = raw[at[i] : at[i + 1]]
        words = int(count[i])
        own = slice(first[i], first[i + 1])
        lines = [x for x in part.tobytes().split(b"\n") if x.strip(quality_rules.WHITE)]
        letters = max(1, int(((_SHAPE[part] <= 2) | (_SHAPE[part] == 12)).sum()))
        rates = (
            quality_rules.repeated_words(grams[own][whole[own]], words) / max(1, words),
            1 - len(set(lines)) / max(1, len(lines)),
            int(np.isin(_SHAPE[part], (8, 9, 10)).sum()) / max(1, words) / 2,
            int((_SHAPE[part] == 2).sum()) / letters,
            min(1.0, (len(part) - int(space[at[i] : at[i + 1]].sum())) / max(1, words) / 16),
            min(1.0, np.log1p(words) / 9),
        )
        for k, r in enumerate(rates):
            out[i, SHAPES**3 + v.word_terms + k * _BINS + min(_BINS - 1, int(np.sqrt(r) * _BINS))] = (0.6, 0.6, 0.6, 0.6, 0.3, 0.2)[k]
    return out


def pack(row: np.ndarray) -> bytes:
    """Places and values, in float16, of what isn't 0 in a row."""
    row = row.astype(np.float16)
    at = np.flatnonzero(row)
    return at.astype(np.uint32).tobytes() + row[at].tobytes()


class Rows:
    """Packed rows as a matrix; a slice opens them."""

    def __init__(self, packed: list[bytes], width: int):
        self.shape = (len(packed), width)
        size = np.array([len(r) // 6 for r in packed], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.at, self.value = np.zeros(self.first[-1], np.uint32), np.zeros(self.first[-1], np.float16)
        for r, lo, n in zip(packed, self.first.tolist(), size.tolist()):
            self.at[lo : lo + n] = np.frombuffer(r, np.uint32, n)
            self.value[lo : lo + n] = np.frombuffer(r, np.float16, n, 4 * n)

    def __getitem__(self, part: slice) -> np.ndarray:
        lo, hi, _ = part.indices(self.shape[0])
        own = slice(self.first[lo], self.first[hi])
        out = np.zeros((hi - lo, self.shape[1]), np.float32)
        out[np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1])), self.at[own]] = self.value[own]
        return out


class Space:
    """Weights, projection and labelled vectors. The rows are opened and weighted part by part, so the driver never holds them whole."""

    def __init__(self, x: np.ndarray | Rows, labels: np.ndarray, v: Voting, part: int = 512):
        n, width = x.shape
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        seen = np.zeros(width, np.int64)
        for lo in range(0, n, part):
            seen += (x[lo : lo + part] > 0).sum(0)
        self.weights = (np.log((1 + n) / (1 + seen)) + 0.3).astype(np.float32)
        if not n:
            self.basis, self.known = np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32)
            return

        def parts() -> Iterator[tuple[int, np.ndarray]]:
            for lo in range(0, n, part):
                yield lo, x[lo : lo + part] * self.weights

        random = np.random.default_rng(7).standard_normal((n, min(n, v.rank + 16))).astype(np.float32)
        basis = np.linalg.qr(sum(p.T @ random[lo : lo + part] for lo, p in parts()))[0]
        for _ in range(6):  # subspace iteration for the leading right singular vectors
            basis = np.linalg.qr(sum(p.T @ (p @ basis) for _, p in parts()))[0]
        _, _, turn = np.linalg.svd(np.concatenate([p @ basis for _, p in parts()]), full_matrices=False)
        self.basis = (basis @ turn.T[:, : v.rank]).astype(np.float32)
        self.known = np.concatenate([self.project(p, weighted=True) for _, p in parts()])

    def project(self, x: np.ndarray, weighted: bool = False) -> np.ndarray:
        y = (x if weighted else x * self.weights) @ self.basis
        return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)

    def score(self, x: np.ndarray, v: Voting) -> np.ndarray:
        n = len(self.labels)
        if n == 0 or self.prior in (0.0, 1.0):
            return np.full(len(x), self.prior)
        k, y = min(v.neighbours, n), self.project(x)
        top, vote = np.full((len(y), 0), 0, np.float32), np.full((len(y), 0), 0, np.float32)
        for lo in range(0, n, v.block):
            cosine = y @ self.known[lo : lo + v.block].T
            take = min(k, cosine.shape[1])
            at = np.argpartition(cosine, cosine.shape[1] - take, axis=1)[:, cosine.shape[1] - take :]
            top = np.concatenate([top, np.take_along_axis(cosine, at, 1)], axis=1)
            vote = np.concatenate([vote, self.labels[lo + at]], axis=1)
        at = np.argpartition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
        top, vote = np.take_along_axis(top, at, 1), np.take_along_axis(vote, at, 1)
        weight = np.exp(v.sharpness * (top - top.max(1, keepdims=True)))
        return np.clip((weight * vote).sum(1) / weight.sum(1), 0, 1).astype(np.float64)


def held_out(doc_id):
    return common.crc_remainder(doc_id, 4) == 2


def learn(documents: DataFrame, labels: DataFrame, v: Voting = Voting()) -> Space:
    """From at most `sample` labelled documents outside the held-out part, the lowest by hash."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = common.hash_sample(known, "doc_id", v.sample)  # ids and labels only, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.utf8(batch.column("text"))
            for lo, hi in common.slices(at, 1 << 20):
                x = features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], v)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("quality").slice(lo, hi - lo), pa.array([pack(r) for r in x], pa.binary())], ["doc_id", "quality", "x"])

    common.tune(documents.sparkSession)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("double").alias("quality"), "text")
    got = texts.mapInArrow(run, "doc_id long, quality double, x binary").toArrow()
    ids, quality, rows = (got.column(c).to_pylist() for c in ("doc_id", "quality", "x"))
    del got
    order = sorted(range(len(ids)), key=lambda i: (ids[i], rows[i]))
    x = Rows([rows[i] for i in order], terms(v))
    del rows
    pa.default_memory_pool().release_unused()
    return Space(x, np.array([quality[i] for i in order], float), v)


def scorer(spark: SparkSession, space: Space, v: Voting):
    shared = spark.sparkContext.broadcast(space)

    def score(texts: pa.Array) -> np.ndarray:
        raw, at = common.utf8(texts)
        out = [shared.value.score(features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], v), v) for lo, hi in common.slices(at, 1 << 20)]
        return np.concatenate(out) if out else np.zeros(0)

    return score


def judge(documents: DataFrame, labels: DataFrame, v: Voting = Voting()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    score = scorer(documents.sparkSession, learn(documents, labels, v), v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= v.keep_from).cast("int").alias("predicted"))


def filter_documents(documents: DataFrame, labels: DataFrame, v: Voting = Voting()) -> DataFrame:
    """The documents with a score from `keep_from` on, with their own columns."""
    score = scorer(documents.sparkSession, learn(documents, labels, v), v)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(text)) >= v.keep_from))

    return documents.mapInArrow(run, documents.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
