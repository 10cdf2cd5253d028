"""Substring dedup with compact windows.

Tokens are hashes of five-word shingles. For each of `hashes` min-hash functions, the Cartesian tree over a text's
min-hashes has a node for every token c that is the least within some stretch [a, b]; the node stands for all
subsequences of [a, b] that hold c, as they share that signature. Only nodes with `least` tokens or more matter; they
are the minima of a sliding window of that size, and the tree over them alone gives the same stretches.

1. One pass makes the windows (value, document, c, a, b, and the least token some places to either side, up to `apart`,
   which tell apart the passages in which a frequent shingle occurs).
2. Windows meet by value: each document is paired with the first (smallest doc_id) and with the one before it. Where
   three or more windows share a value, the same is done among those of equal token on the left, or on the right. All
   of it is linear in the windows, however many share a passage. Collisions of a pair add up by alignment; pairs that share too few are dropped.
3. Where three or more windows share value and side token (a frequent line in different passages), the first and the
   previous document needn't hold the same passage. A second pass hashes every stretch of `least` tokens whose least
   token under any function has such a value, and each document is paired with the first that holds the same stretch:
   exact repeats are found however frequent the line in them is. The values are known by a bit filter; values that it
   marks by chance only add work.
4. The pairs' stretches are cut from the token rows of the documents they name (a bit filter keeps other texts out of
   the shuffle), aligned, and verified (where a few words repeat over and over, by what the other stretch holds anywhere): spans of `least` tokens or more of which 80 % lie in the other text.

A verified span is a repeat of an earlier document's passage; overlapping spans of a document merge.

Edge cases: null and empty texts and texts below fifty words have no spans; rows without doc_id take no part and stay as
they are; rows that share doc_id and text count as one document and aren't held against each other, while different texts
of one doc_id are documents of their own, in an order of their own; a passage repeated only within one document isn't touched; other columns pass through `cut_documents`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textkernel
from .jaccard_join import bit_filter, split_by

U = np.uint64
PLACE = U((1 << 28) - 1)
WINDOW = np.dtype([("value", "<u8"), ("doc", "<i8"), ("c", "<u4"), ("left", "<u2"), ("right", "<u2"), ("before", "<u4"), ("after", "<u4"), ("chain", "<i4")])
#: Keys of the min-hash functions: fixed arbitrary odd numbers.
SEEDS = (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Passages:
    words: int = 5
    least: int = 46  # tokens: fifty words
    hashes: int = 4
    needed: int = 2  # collisions of a pair
    percent: int = 80
    apart: int = 22
    beside: int = 9  # places that a side token is the least of
    margin: int = 64
    slack: int = 8
    band: int = 6  # alignments are grouped by shifts of 2^band


def token_rows(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts end to end, and how many lie before each text. Token i of a text begins at its word i."""
    hashes, _, _, first = textkernel.words(raw, at, lower=True)
    grams, whole = textkernel.shingles(hashes, first, k)
    return grams[whole], np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(first) - k + 1))])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each stretch of `width` values, by doubling."""
    w = 1
    while 2 * w <= width:
        values = np.minimum(values[:-w], values[w:])
        w *= 2
    return values if w == width else np.minimum(values[: len(values) - (width - w)], values[width - w :])


def tree(values: list[int], place: list[int], owner: list[int], start: list[int], end: list[int]) -> tuple[list[int], list[int]]:
    """First and last token of each node's stretch: up to the nearest lesser value on either side, within its text."""
    a, b, stack, now = [], [0] * len(values), [], -1
    for i, v in enumerate(values):
        if owner[i] != now:
            for s in stack:
                b[s] = end[now] - 1
            stack, now = [], owner[i]
        while stack and values[stack[-1]] > v:
            b[stack.pop()] = place[i] - 1
        a.append(place[stack[-1]] + 1 if stack else start[now])
        stack.append(i)
    for s in stack:
        b[s] = end[now] - 1
    return a, b


def windows(tokens: np.ndarray, first: np.ndarray, docs: np.ndarray, p: Passages) -> np.ndarray:
    """All compact windows of the texts, as rows of WINDOW."""
    n = len(tokens)
    if n < p.least:
        return np.zeros(0, WINDOW)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][owner]
    valid = np.flatnonzero((end - np.arange(n) >= p.least)[: n - p.least + 1])
    if not len(valid):
        return np.zeros(0, WINDOW)
    out = []
    for seed in SEEDS[: p.hashes]:
        h = textkernel.mix(tokens ^ U(seed))
        packed = (h & ~PLACE) | np.arange(n).astype(U)
        c = np.unique(sliding_least(packed, p.least)[valid] & PLACE).astype(np.int64)
        own = owner[c]
        a, b = tree(packed[c].tolist(), c.tolist(), own.tolist(), first[:-1].tolist(), first[1:].tolist())
        rows = np.zeros(len(c), WINDOW)
        rows["value"], rows["doc"], rows["c"] = h[c], docs[own], c - first[own]
        rows["left"], rows["right"] = np.minimum(c - np.array(a), 65535), np.minimum(np.array(b) - c, 65535)
        wide = min(p.beside, p.apart)
        least = sliding_least(tokens, wide)
        for name, lo in (("before", c - p.apart), ("after", c + p.apart - wide + 1)):
            inside = (lo >= first[own]) & (lo + wide <= first[own + 1])
            rows[name] = np.where(inside, (least[np.where(inside, lo, 0)] >> U(32)) | U(1), U(0)).astype(np.uint32)
        out.append(rows)
    return np.concatenate(out)


def unchained(rows: np.ndarray, p: Passages) -> np.ndarray:
    """Of windows of one value that follow each other in a text within `least` tokens, as where a few words repeat over and
    over, the first and the last. Each says in `chain` how far off the other is, so that a pair's stretches reach over all of it."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows["c"], rows["value"], rows["doc"]))]
    near = (rows["doc"][1:] == rows["doc"][:-1]) & (rows["value"][1:] == rows["value"][:-1]) & (rows["c"][1:].astype(np.int64) - rows["c"][:-1] < p.least)
    head, tail = np.flatnonzero(~np.append(False, near)), np.flatnonzero(~np.append(near, False))
    rows["chain"][tail] = rows["c"][head].astype(np.int64) - rows["c"][tail]
    rows["chain"][head] -= rows["chain"][tail]  # a chain of one window keeps 0
    return rows[~(np.append(False, near) & np.append(near, False))]


def stretch_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each stretch of `width` tokens, by doubling."""
    n = len(tokens) - width + 1
    out, done, part, w = np.zeros(n, U), 0, textkernel.mix(tokens), 1
    while w <= width:
        if width & w:
            out = textkernel.mix(out * U(3) + part[done : done + n])
            done += w
        part, w = textkernel.mix(part[:-w] * U(3) + part[w:]), 2 * w
    return out


def stretches(tokens: np.ndarray, first: np.ndarray, docs: np.ndarray, p: Passages, hot: np.ndarray) -> np.ndarray:
    """Every stretch of `least` tokens whose least token under any function has a marked value, as rows of WINDOW: value is the stretch's hash, c its first token."""
    n = len(tokens)
    if n < p.least:
        return np.zeros(0, WINDOW)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero((first[1:][owner] - np.arange(n) >= p.least)[: n - p.least + 1])
    any_hot = np.zeros(len(at), bool)
    for seed in SEEDS[: p.hashes]:
        h = textkernel.mix(tokens ^ U(seed))
        place = h & U(8 * len(hot) - 1)
        is_hot = (hot[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8) & 1).astype(bool)
        any_hot |= is_hot[(sliding_least((h & ~PLACE) | np.arange(n).astype(U), p.least)[at] & PLACE).astype(np.int64)]
    at = at[any_hot]
    out = np.zeros(len(at), WINDOW)
    if len(at):
        own = owner[at]
        out["value"], out["doc"], out["c"], out["right"] = stretch_hashes(tokens, p.least)[at], docs[own], at - first[own], p.least - 1
    return out


def make_windows(documents: DataFrame, p: Passages, buckets: int, hot=None) -> DataFrame:
    """bucket, rows: packed windows, or the stretches around values that a broadcast bit filter marks, dealt by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = np.concatenate(held)
            bucket = (rows["value"] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            names, at = np.unique(bucket, return_index=True)
            ends = np.append(at[1:], len(rows))
            for lo in range(0, len(names), 64):
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 64].astype(np.int32)), pa.array([rows[at[i] : ends[i]].tobytes() for i in range(lo, min(lo + 64, len(names)))], pa.binary())], ["bucket", "rows"])
            held, size = [], 0

        for batch in batches:
            docs = np.asarray(batch.column("doc_id"))
            raw, at = common.utf8(batch.column("text"))
            for lo, hi in common.slices(at, 1 << 21):
                tokens, first = token_rows(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], p.words)
                rows = unchained(windows(tokens, first, docs[lo:hi], p) if hot is None else stretches(tokens, first, docs[lo:hi], p, hot.value), p)
                if not len(rows):
                    continue
                held.append(rows)
                size += len(rows)
                if size > 1 << 19:
                    yield from flush()
        if size:
            yield from flush()

    return documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "bucket int, rows binary")


MEETING = "early long, late long, shift long, n int, first long, last long, low long, high long, early_first long, early_last long, chained int, hot boolean"
PAIR = 11  # columns of met()


def runs_of(rows: np.ndarray, *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of these keys, document and place, and where runs of equal keys begin."""
    rows = rows[np.lexsort((rows["c"], rows["doc"], *(rows[k] for k in reversed(keys))))]
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= rows[k][1:] != rows[k][:-1]
    return rows, new


def met(own: np.ndarray, at: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Rows `at` met with earlier documents' rows `o`: columns early, late, c in late, alignment, reach to the left and
    right, first and last c of the chain in late and in early, and whether there is a chain."""
    part = np.zeros((len(at), PAIR), np.int64)
    part[:, 0], part[:, 1], part[:, 2] = own["doc"][o], own["doc"][at], own["c"][at]
    part[:, 3] = own["c"][at].astype(np.int64) - own["c"][o]
    part[:, 4] = np.minimum(own["left"][at], own["left"][o])
    part[:, 5] = np.minimum(own["right"][at], own["right"][o])
    for k, i in ((6, at), (8, o)):
        c, chain = own["c"][i].astype(np.int64), own["chain"][i].astype(np.int64)
        part[:, k], part[:, k + 1] = c + np.minimum(chain, 0), c + np.maximum(chain, 0)
    part[:, 10] = (own["chain"][at] != 0) | (own["chain"][o] != 0)
    return part


def meet_first(own: np.ndarray, new: np.ndarray, previous: bool) -> list[np.ndarray]:
    """Each document of a run with the run's first, and with the one before it."""
    lead = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    change = np.append(True, new[1:] | (own["doc"][1:] != own["doc"][:-1]))
    begin = np.maximum.accumulate(np.where(change, np.arange(len(own)), 0))  # of the document within the run
    at = np.flatnonzero(own["doc"][lead] != own["doc"])
    found = [met(own, at, lead[at])]
    if previous:
        at = np.flatnonzero((begin > lead) & (begin - 1 > lead))
        found.append(met(own, at, begin[at] - 1))
    return found


def meetings(rows: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Windows of two documents that share a value, as rows of met(); and the values of which three or more windows share a
    side token too, in two documents or more."""
    if len(rows) < 2:
        return np.zeros((0, PAIR), np.int64), np.zeros(0, U)
    rows, new = runs_of(rows, "value")
    found, hot = meet_first(rows, new, True), [np.zeros(0, U)]
    head = np.flatnonzero(new)
    many = rows[np.repeat(np.diff(np.append(head, len(rows))) > 2, np.diff(np.append(head, len(rows))))]
    for side in ("before", "after"):
        own, new = runs_of(many[many[side] != 0], "value", side)
        if len(own) < 2:
            continue
        found += meet_first(own, new, True)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(own)) - 1
        hot.append(own["value"][head[(tail > head + 1) & (own["doc"][head] != own["doc"][tail])]])
    return np.concatenate(found), np.unique(np.concatenate(hot))


def pairs(packed: DataFrame, p: Passages, buckets: int, exact: bool = False) -> DataFrame:
    """Collisions added up by pair and alignment: early, late, shift, the tokens of late from first to last, the alignments
    from low to high. Rows marked hot hold a value in `early` and are no pairs. One exact stretch is enough for a pair."""
    names = [c.split()[0] for c in MEETING.split(", ")]

    def batches_of(columns: list[np.ndarray], hot: bool) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(columns[0]), 1 << 16):
            part = [pa.array(c[lo : lo + (1 << 16)].astype(np.int32 if n in ("n", "chained") else np.int64)) for c, n in zip(columns, names, strict=False)]
            yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(part[0]), hot))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("rows").to_pylist()]
        rows = np.frombuffer(b"".join(blobs), WINDOW)
        if exact:
            m, hot = np.concatenate(meet_first(*runs_of(rows, "value"), False)) if len(rows) else np.zeros((0, PAIR), np.int64), np.zeros(0, U)
        else:
            m, hot = meetings(rows, p)
        if len(hot):
            none = np.zeros(len(hot), np.int64)
            yield from batches_of([hot.view(np.int64), none, none, none + p.needed, *[none] * 7], True)
        if not len(m):
            return
        m = np.unique(m, axis=0) if len(m) < 1 << 22 else m
        shift = m[:, 3] >> p.band
        order = np.lexsort((m[:, 2], shift, m[:, 1], m[:, 0]))
        m, shift = m[order], shift[order]
        at = np.flatnonzero(np.append(True, (np.diff(m[:, 0]) != 0) | (np.diff(m[:, 1]) != 0) | (np.diff(shift) != 0)))
        hit = np.append(True, (np.diff(m[:, 2]) != 0)) | np.isin(np.arange(len(m)), at)  # a token counts once
        n = np.full(len(at), p.needed) if exact else np.add.reduceat(hit.astype(np.int32), at)
        left, right = np.minimum(m[:, 4], p.margin), np.minimum(m[:, 5], p.margin)
        low = [np.minimum(m[:, 2] - left, m[:, 6]), np.minimum(m[:, 2] - m[:, 3] - left, m[:, 8]), m[:, 3]]
        high = [np.maximum(m[:, 2] + right, m[:, 7]), np.maximum(m[:, 2] - m[:, 3] + right, m[:, 9]), m[:, 3], m[:, 10]]
        (first, early_first, least), (last, early_last, most, chained) = ([f.reduceat(x, at) for x in xs] for f, xs in ((np.minimum, low), (np.maximum, high)))
        yield from batches_of([m[at, 0], m[at, 1], shift[at], n, first, last, least, most, early_first, early_last, chained], False)

    return added_up(packed.repartitionById(buckets, "bucket").mapInArrow(run, MEETING), p)


def added_up(met: DataFrame, p: Passages) -> DataFrame:
    least, most = ("first", "low", "early_first"), ("last", "high", "early_last", "chained")
    total = met.groupBy("early", "late", "shift", "hot").agg(F.sum("n").cast("int").alias("n"), *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    return total.filter(F.col("n") >= p.needed)


def token_table(documents: DataFrame, p: Passages, wanted, size: int) -> DataFrame:
    """doc_id and tokens (u32 each) of the documents that pass the bit filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (np.asarray(batch.column("place")) % size).astype(np.int64)
            batch = batch.filter(pa.array((wanted.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            raw, at = common.utf8(batch.column("text"))
            for lo, hi in common.slices(at, 1 << 21):
                tokens, first = token_rows(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], p.words)
                short = (tokens >> U(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([short[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["doc_id", "tokens"])

    hashed = documents.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(0x7FFFFFFFFFFFFFFF).alias("place"))
    return hashed.mapInArrow(run, "doc_id long, tokens binary")


def spans_of(hit: np.ndarray, p: Passages) -> list[tuple[int, int, int]]:
    """(begin, end, matches) of the stretches with enough matches; runs of matches join from left to right while the share holds."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, now = [], None
    for b, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if now is not None and 100 * (now[2] + e - b) >= p.percent * (e - now[0]):
            now = (now[0], e, now[2] + e - b)
            continue
        if now is not None and now[1] - now[0] >= p.least:
            out.append(now)
        now = (b, e, e - b)
    if now is not None and now[1] - now[0] >= p.least:
        out.append(now)
    return out


def aligned(late: np.ndarray, early: np.ndarray, shift: int, slack: int) -> np.ndarray:
    """Whether each token of late equals one of early at its place less the shift, or up to `slack` beside it."""
    hit = np.zeros(len(late), bool)
    for d in range(-slack, slack + 1):
        at = np.arange(len(late)) - shift + d
        ok = (at >= 0) & (at < len(early))
        hit[ok] |= late[ok] == early[at[ok]]
    return hit


SPAN = "doc_id long, begin long, end long, kept_doc_id long, matches long"


def verify(found: DataFrame, tokens: DataFrame, p: Passages) -> DataFrame:
    """Spans of tokens [begin, end) of doc_id that repeat a passage of kept_doc_id."""
    m = p.margin
    lo_e = F.greatest(F.lit(0), F.least(F.col("first") - F.col("high"), "early_first") - m)
    hi_e = F.greatest(F.col("last") - F.col("low"), "early_last") + m + 1
    lo_l, hi_l = F.greatest(F.lit(0), F.col("first") - m), F.col("last") + m + 1

    def piece(lo, hi):
        return F.substring(F.col("tokens"), (4 * lo + 1).cast("int"), (4 * (hi - lo)).cast("int"))

    early = found.join(tokens.withColumnRenamed("doc_id", "early"), "early").select("early", "late", "first", "last", "low", "high", "chained", lo_e.alias("early_at"), piece(lo_e, hi_e).alias("early_tokens"))
    both = early.join(tokens.withColumnRenamed("doc_id", "late"), "late").select("early", "late", "low", "high", "chained", "early_at", "early_tokens", lo_l.alias("late_at"), piece(lo_l, hi_l).alias("late_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["late_tokens"], "<u4"), np.frombuffer(r["early_tokens"], "<u4")
                middle = (r["low"] + r["high"]) // 2
                hit = aligned(x, y, middle - r["late_at"] + r["early_at"], p.slack + (r["high"] - r["low"] + 1) // 2)
                if r["chained"]:  # words over and over have no one alignment
                    hit |= np.isin(x, y)
                rows += [(r["late"], r["late_at"] + b, r["late_at"] + e, r["early"], n) for b, e, n in spans_of(hit, p)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in SPAN.split(", ")])

    return both.mapInArrow(run, SPAN)


def repeats(documents: DataFrame, p: Passages = Passages()) -> DataFrame:
    """doc_id, first_word, n_words, kept_doc_id, similarity: passages that repeat one of an earlier document."""
    named, ids = common.apart(documents.select("doc_id", "text"), common.Workspace(documents.sparkSession, "passages"))
    return common.own_ids(spans(named, p), ids, "doc_id", "kept_doc_id")


def spans(documents: DataFrame, p: Passages) -> DataFrame:
    """repeats() of documents whose doc_id names one text."""
    spark = documents.sparkSession
    work = common.Workspace(spark, "passages")
    buckets = common.partitions(spark)
    met = work.keep(pairs(make_windows(documents, p, buckets), p, buckets), "met")
    hot = met.filter("hot").select(F.col("early").bitwiseAND(0x7FFFFFFFFFFFFFFF).alias("place"))
    near, n_hot = met.filter("not hot"), hot.count()
    if n_hot:
        marks = spark.sparkContext.broadcast(bit_filter(hot, 1 << min(28, max(20, int(16 * n_hot).bit_length())), F.col("place")))
        near = added_up(near.unionByName(pairs(make_windows(documents, p, buckets, marks), p, buckets, exact=True)), p)
    found = work.keep(near.drop("n", "shift", "hot"), "pairs")
    work.drop("met")
    ids = found.select(F.col("early").alias("doc_id")).unionByName(found.select(F.col("late").alias("doc_id"))).distinct()
    ids = work.keep(ids, "ids")
    size = 1 << min(28, max(20, int(16 * max(1, ids.count())).bit_length()))
    wanted = spark.sparkContext.broadcast(bit_filter(ids, size))
    tokens = token_table(documents, p, wanted, size).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    tokens = work.keep(tokens, "tokens")
    verified = work.keep(verify(found, tokens, p), "spans")
    work.drop("pairs", "ids", "tokens")
    in_order = Window.partitionBy("doc_id").orderBy("begin", "end", "kept_doc_id")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = verified.distinct().withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(in_order))
    merged = marked.groupBy("doc_id", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("kept_doc_id").alias("kept_doc_id"), F.max(F.col("matches") / (F.col("end") - F.col("begin"))).alias("similarity"))
    return merged.select("doc_id", F.col("begin").alias("first_word"), (F.col("end") - F.col("begin") + p.words - 1).alias("n_words"), "kept_doc_id", "similarity")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these words; white space around a passage stays on its left."""
    raw = np.frombuffer(text, np.uint8)
    _, starts, _, _ = textkernel.words(raw, np.array([0, len(raw)]))
    out, at = [], 0
    for first, n in sorted(spans):
        begin = int(starts[first])
        end = int(starts[first + n]) if first + n < len(starts) else len(text)
        out.append(text[at:begin])
        at = max(at, end)
    return b"".join(out) + text[at:]


def cut_documents(documents: DataFrame, p: Passages = Passages()) -> DataFrame:
    """The documents without their repeated passages, with their own columns (n_chars, if there, follows the text).
    A document that held nothing else goes."""
    columns, schema, own = documents.columns, documents.schema, "spans"
    while own in columns:
        own += "_"
    work = common.Workspace(documents.sparkSession, "cut")
    documents, ids = common.apart(documents, work)
    found = work.keep(spans(documents, p).groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "n_words")).alias(own)), "spans")
    maybe, whole = split_by(documents, found.select("doc_id"))
    joined = maybe.join(found, "doc_id", "left").select(*columns, own)
    text, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, texts = batch.column(len(columns)).to_pylist(), batch.column(text).to_pylist()
            sizes = batch.column(chars).to_pylist() if chars is not None else []
            stay = []
            for i, s in enumerate(cuts):
                stay.append(True)
                if s:
                    texts[i] = without(texts[i].encode(), [(x["first_word"], x["n_words"]) for x in s]).decode()
                    stay[i] = bool(texts[i].strip(" \t\n\x0b\f\r"))
                    if chars is not None:
                        sizes[i] = len(texts[i])
            new = [pa.array(texts, pa.string()) if i == text else pa.array(sizes, batch.column(i).type) if i == chars else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(new, columns).filter(pa.array(stay, pa.bool_()))

    return common.own_ids(whole.unionByName(joined.mapInArrow(run, schema)), ids, "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.read(spark, sf_dir, "documents"))
