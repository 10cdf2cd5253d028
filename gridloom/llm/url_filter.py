"""URL filter: rules by host and path, and character language models for the URLs that no rule decides.

Two variable-order Markov models over the bytes of host and path, one of accepted and one of rejected URLs, are learned
from all URLs that a rule decides, but for a fifth that is held back. Every context of up to `order` bytes is kept with
all of its counts, however many there are: the models are a table that grows with the URLs. Probabilities interpolate
from short contexts to long (Witten-Bell). The score is the difference of log-likelihoods a character; the held-back
URLs give a histogram of scores for either class, and the threshold that separates them best decides.

A URL's score is a mean of gains, and a gain depends on a character and the `order` before it only. So URLs are dealt into
chunks, a chunk names its distinct codes (context and character), and each distinct code's gain is computed once, where the
counts of its last two context bytes lie; all longer contexts lie there too. Contexts of no byte and of one, 258^2 codes at most,
are broadcast. Gains then go back to the chunks that named them. Nothing else leaves the executors but histograms.

Edge cases: a null URL, or one without "://", has an empty host and path, scores 0 and is allowed, as nothing in it can be
judged; ties between rules can't occur between different rules of equal length for one URL, as both their host and path
parts would be equal; without any URL for one of the classes all other URLs score 0 and are allowed; repeated rows are
judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: rule, verdict
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


#: Symbols: bytes, the end, and what stands before the beginning.
END, BEFORE, SYMBOLS = 256, 257, 258


@dataclass(frozen=True)
class Markov:
    order: int = 4
    chunk: int = 1 << 14  # URLs
    bins: int = 400
    reach: float = 4.0
    hold: int = 5


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path; both empty for a null URL or one without "://"."""
    found = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(found, pattern, 1), UPPER, LOWER), F.regexp_extract(found, pattern, 2)


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds host, path, rule and decided (the rule's verdict, else null)."""
    host, path = parts(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule = decided = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit("/" + rest))
        rule, decided = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    return pages.withColumn("rule", rule).withColumn("decided", decided)


def symbols(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols that are predicted (bytes, and the end of each text), the codes of their contexts for each length (the
    nearest symbol is the lowest digit), and the text of each."""
    raw, at = common.utf8(texts)
    n, size = len(at) - 1, np.diff(at)
    text = np.repeat(np.arange(n), size + 1)
    stream = np.full(len(raw) + n, END, np.int64)
    ends = np.cumsum(size + 1) - 1
    is_end = np.zeros(len(stream), bool)
    is_end[ends] = True
    stream[~is_end] = raw
    place = np.arange(len(stream)) - np.repeat(ends - size, size + 1)
    contexts = np.zeros((order + 1, len(stream)), np.int64)
    for k in range(1, order + 1):
        back = np.full(len(stream), BEFORE)
        back[k:] = stream[:-k] if k <= len(stream) else BEFORE
        back[place < k] = BEFORE
        contexts[k] = contexts[k - 1] + back * SYMBOLS ** (k - 1)
    return stream, contexts, text


def count(decided: DataFrame, m: Markov) -> DataFrame:
    """decided (class), k (length of context), code (context * SYMBOLS + character), n; summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            kind = np.array(batch.column("decided").to_pylist())
            stream, contexts, text = symbols(batch.column("text"), m.order)
            for c in ("allow", "block"):
                mine = (kind == c)[text] if len(text) else np.zeros(0, bool)
                for k in range(m.order + 1):
                    codes, n = np.unique(contexts[k][mine] * SYMBOLS + stream[mine], return_counts=True)
                    old = total.get((c, k))
                    if old is not None:
                        codes, inverse = np.unique(np.concatenate([old[0], codes]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([old[1], n]), len(codes)).astype(np.int64)
                    total[c, k] = codes, n
        for (c, k), (codes, n) in total.items():
            for lo in range(0, len(codes), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                size = len(codes[part])
                yield pa.RecordBatch.from_arrays([pa.array([c] * size, pa.string()), pa.array([k] * size, pa.int32()), pa.array(codes[part]), pa.array(n[part])], ["decided", "k", "code", "n"])

    return decided.mapInArrow(run, "decided string, k int, code long, n long").groupBy("decided", "k", "code").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated probabilities of one class. The tables are sorted arrays, looked up by halving."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, np.ndarray]], order: int):
        self.order, self.tables = order, []
        for k in range(order + 1):
            code, n = rows.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            context, at = np.unique(code // SYMBOLS, return_index=True)
            total = np.add.reduceat(n, at) if len(n) else n
            kinds = np.diff(np.append(at, len(code)))
            self.tables.append((code, n.astype(float), context, total.astype(float), kinds.astype(float)))

    def log_probability(self, stream: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        p = np.full(len(stream), 1 / SYMBOLS)
        for k, (code, n, context, total, kinds) in enumerate(self.tables):
            if not len(code):
                continue
            i = np.minimum(np.searchsorted(context, contexts[k]), len(context) - 1)
            known = context[i] == contexts[k]
            whole = contexts[k] * SYMBOLS + stream
            j = np.minimum(np.searchsorted(code, whole), len(code) - 1)
            seen = np.where(code[j] == whole, n[j], 0.0)
            p = np.where(known, (seen + kinds[i] * p) / (total[i] + kinds[i]), p)
        return np.log(p)


CLASSES = ("allow", "block")


def tables(kind: np.ndarray, k: np.ndarray, code: np.ndarray, n: np.ndarray, order: int) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For each class the sorted codes of each length and their counts."""
    out = []
    for c in range(len(CLASSES)):
        rows = {}
        for i in range(order + 1):
            mine = np.flatnonzero((kind == c) & (k == i))
            mine = mine[np.argsort(code[mine])]
            if len(mine):
                rows[i] = code[mine], n[mine]
        out.append(rows)
    return out


def named_codes(urls: DataFrame, m: Markov) -> DataFrame:
    """chunk, code: the distinct codes of each chunk's URLs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(held), 1 << 16):
                part = held[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now, np.int64)), pa.array(part)], ["chunk", "code"])

        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            stream, contexts, text = symbols(batch.column("text"), m.order)
            code = contexts[m.order] * SYMBOLS + stream
            for c in dict.fromkeys(chunks.tolist()):
                if c != now:
                    yield from flush()
                    now, held = c, np.zeros(0, np.int64)
                held = np.union1d(held, code[(chunks == c)[text]])
        yield from flush()

    return urls.select("chunk", "text").mapInArrow(run, "chunk long, code long")


def gains(counts: DataFrame, codes: DataFrame, m: Markov) -> DataFrame:
    """code, gain: log-likelihood of a code's character under the accepted less that under the rejected URLs."""
    spark = counts.sparkSession
    kind = F.when(F.col("decided") == CLASSES[0], 0).otherwise(1)
    counts = counts.select(kind.alias("kind"), "k", "code", "n")
    low = counts.filter("k < 2").toArrow()  # 2 * (258 + 258^2) rows at most
    low_rows = spark.sparkContext.broadcast(tuple(low.column(c).to_numpy() for c in ("kind", "k", "code", "n")))
    near = F.floor(F.col("code") / SYMBOLS) % SYMBOLS**2  # the last two symbols of the context
    asked = codes.select(F.lit(-1).alias("kind"), F.lit(m.order).alias("k"), "code", F.lit(0).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy() for c in ("kind", "k", "code", "n")] for batch in batches]
        if not parts:
            return
        kind, k, code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        ask = code[kind < 0]
        if not len(ask):
            return
        both = [np.concatenate(x) for x in zip(low_rows.value, (kind, k, code, n), strict=True)]
        models = [Model(rows, m.order) for rows in tables(*both, m.order)]
        contexts = np.stack([ask // SYMBOLS % SYMBOLS**i for i in range(m.order + 1)])
        gain = models[0].log_probability(ask % SYMBOLS, contexts) - models[1].log_probability(ask % SYMBOLS, contexts)
        for lo in range(0, len(ask), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(ask[lo : lo + (1 << 16)]), pa.array(gain[lo : lo + (1 << 16)])], ["code", "gain"])

    dealt = counts.filter("k >= 2").unionByName(asked).repartition(common.partitions(spark), near)
    return dealt.mapInArrow(run, "code long, gain double")


def mean_gains(texts: pa.Array, code: np.ndarray, gain: np.ndarray, order: int) -> np.ndarray:
    """The mean gain of each text's characters; code is sorted and holds all of them."""
    stream, contexts, text = symbols(texts, order)
    own = gain[np.searchsorted(code, contexts[order] * SYMBOLS + stream)]
    return np.bincount(text, own, len(texts)) / np.maximum(1, np.bincount(text, minlength=len(texts)))


def scored(urls: DataFrame, counts: DataFrame, m: Markov, work: common.Workspace) -> DataFrame:
    """urls (chunk, row, text, ...) with score."""
    codes = work.keep(named_codes(urls, m), "codes")
    known = codes.join(gains(counts, codes.select("code").distinct(), m), "code")
    names = [c for c in urls.columns if c != "text"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in urls.schema if f.name in names)

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        code, gain = found.column("code").to_numpy(), found.column("gain").to_numpy()
        code, at = np.unique(code, return_index=True)  # a chunk read by two tasks names a code twice
        own = own.combine_chunks()
        texts = own.column("text").combine_chunks()
        score = mean_gains(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, code, gain[at], m.order)
        return own.select(names).append_column("score", pa.array(score))

    return urls.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, f"{kind}, score double")


def threshold(histogram: list[tuple[str, int, int]], m: Markov) -> float:
    """The score from which URLs are allowed: the best mean of the shares of either class that it judges rightly; the middle of the best range."""
    counts = {c: np.zeros(m.bins) for c in ("allow", "block")}
    for c, b, n in histogram:
        counts[c][b] += n
    if not all(x.any() for x in counts.values()):
        return 0.0
    above = np.append(np.cumsum(counts["allow"][::-1])[::-1], 0) / counts["allow"].sum()
    below = np.append(0, np.cumsum(counts["block"])) / counts["block"].sum()
    right = above + below
    good = np.flatnonzero(right >= right.max() - 1e-12)
    return float((good[0] + good[-1]) / 2 / m.bins * 2 * m.reach - m.reach)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, m: Markov = Markov()) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    spark = pages.sparkSession
    work = common.Workspace(spark, "urls")
    judged = ruled(pages.select("page_id", "url"), rules).withColumn("text", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit("")).otherwise(F.concat("host", "path")))
    judged = judged.withColumn("held", F.col("decided").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(m.hold)) == 0)).withColumn("chunk", F.floor(F.monotonically_increasing_id() / m.chunk))
    judged = work.keep(judged.select("page_id", "host", "path", "rule", "decided", "held", "chunk", "text"), "judged")
    counts = work.keep(count(judged.filter("decided is not null and not held").select("decided", "text"), m), "counts")
    asked = judged.filter((F.col("decided").isNull() & (F.col("text") != "")) | F.col("held"))
    if counts.select("decided").distinct().count() == len(CLASSES):
        tried = work.keep(scored(asked, counts, m, work), "scored")
    else:
        tried = asked.drop("text").withColumn("score", F.lit(0.0))
    place = F.greatest(F.lit(0), F.least(F.lit(m.bins - 1), F.floor((F.col("score") + m.reach) / (2 * m.reach) * m.bins))).cast("int")
    cut = threshold([tuple(r) for r in tried.filter("held").groupBy("decided", place.alias("bin")).agg(F.count("*").alias("n")).collect()], m)
    work.drop("counts", "codes")
    by_model = tried.filter("decided is null").select("page_id", "host", "path", "rule", F.when(F.col("score") >= cut, "allow").otherwise("block").alias("verdict"), "score")
    by_rule = judged.filter("decided is not null").select("page_id", "host", "path", "rule", F.col("decided").alias("verdict"), F.lit(None).cast("double").alias("score"))
    empty = judged.filter("decided is null and text = ''").select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(0.0).alias("score"))
    return by_model.unionByName(by_rule).unionByName(empty)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"))
