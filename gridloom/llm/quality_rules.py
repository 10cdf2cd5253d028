"""Quality rules by compression bands.

A text passes when its base counts are sound and its zstandard ratio (compressed over raw bytes) lies inside the
band for its length, both as a whole and in every fixed chunk from 4096 bytes on, the last of
which ends with the text and overlaps the one before (below 8192 bytes, in the text's own band). Very low ratios mean repetition, very high ones
noise that no language compresses like.

Edge cases: a null text counts as empty; an empty text, or one of white space, has no words and fails; repeated
rows each get their own row; columns of other names pass through `filter_documents` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common, textkernel

SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio. whole: (bytes from, lowest, highest), by ascending length; the last that applies counts."""

    level: int = 3
    chunk_bytes: int = 4096
    whole: tuple[tuple[int, float, float], ...] = ((0, 0.65, 1.60), (128, 0.50, 1.05), (512, 0.45, 0.80), (2048, 0.415, 0.65), (8192, 0.39, 0.60), (32768, 0.36, 0.58))
    chunk: tuple[float, float] = (0.42, 0.65)

    def limits(self, size: int) -> tuple[float, float]:
        low, high = self.whole[0][1:]
        for least, lo, hi in self.whole:
            if size >= least:
                low, high = lo, hi
        return low, high


def ratios(raw: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Of the whole text, and the lowest and highest of its chunks, the last of which ends with the text (those of the whole where there is none)."""
    whole = len(pack.compress(raw)) / max(1, len(raw))
    step = bands.chunk_bytes
    if len(raw) < step:
        return whole, whole, whole
    starts = [*range(0, len(raw) - step, step), len(raw) - step]
    each = [len(pack.compress(raw[i : i + step])) / step for i in starts]
    return whole, min(each), max(each)


def verdict(raw: bytes, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[bool, float, float, float]:
    whole, low, high = ratios(raw, bands, pack)
    least, most = bands.limits(len(raw))
    fits = least <= whole <= most
    if len(raw) >= bands.chunk_bytes:
        lowest, highest = bands.chunk if len(raw) >= 2 * bands.chunk_bytes else (least, most)
        fits = fits and lowest <= low and high <= highest
    return fits, whole, low, high


def repeated_words(grams: np.ndarray, n_words: int, k: int = 5) -> int:
    """Words that lie in a k-word window found twice or more. grams: the hash of each window, in order."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(ids: list, raw: np.ndarray, at: np.ndarray, bands: Bands, pack: zstandard.ZstdCompressor) -> dict[str, list]:
    hashes, _, _, first = textkernel.words(raw, at)
    grams, whole = textkernel.shingles(hashes, first, 5)
    out: dict[str, list] = {k.split()[0]: [] for k in RESULT.split(", ")}
    for i, doc in enumerate(ids):
        text = raw[at[i] : at[i + 1]].tobytes()
        n = int(first[i + 1] - first[i])
        inner = text.translate(None, WHITE)
        lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
        repeat = repeated_words(grams[first[i] : first[i + 1]][whole[first[i] : first[i + 1]]], n)
        failed = n < 10 or 100 * repeat > 20 * n
        fits, ratio, low, high = verdict(text, bands, pack)
        row = (doc, n, len(inner.decode("utf-8", "surrogatepass")), len(text.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)), repeat, failed, fits and not failed, ratio, low, high)
        for values, v in zip(out.values(), row, strict=True):
            values.append(v)
    return out


def judge(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: its counts, ratios and the verdict `kept`. A narrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        schema = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (c.split() for c in RESULT.split(", "))])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw, at = common.utf8(batch.column("text"))
            for lo, hi in common.slices(at, 1 << 21):
                part = measure(ids[lo:hi], raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bands, pack)
                yield pa.RecordBatch.from_pydict(part, schema)

    common.tune(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def filter_documents(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their own columns: whole rows go through one narrow pass, so no join is needed."""
    schema = documents.schema
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
        for batch in batches:
            raw, at = common.utf8(batch.column(text))
            kept: list[bool] = []
            for lo, hi in common.slices(at, 1 << 21):
                kept += measure([0] * (hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bands, pack)["kept"]
            yield batch.filter(pa.array(kept, pa.bool_()))

    common.tune(documents.sparkSession)
    return documents.mapInArrow(run, schema)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"))
