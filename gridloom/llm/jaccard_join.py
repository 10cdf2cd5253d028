"""N-gram Jaccard join with a token-group matrix, and the components of its links.

A document's set holds the hashes of its distinct word shingles (64 bits). Documents with equal sets form one class, so
copies are never paired. Classes meet in groups of about `members`. A group's matrix has a row for each shingle of the
union of its sets, with a bit for each member.

1. One pass gives each document its class, `hashes` min-hashes and set size, and a count sketch of shingle frequencies (fixed size).
2. Classes that share a min-hash form groups; a frequent min-hash makes many groups, and a few of its classes (leaders)
   stand in all of them. Every overlap within a group is counted in its matrix, and links make first components: the
   first min-hash over all classes that share one, then frequent values of the others over one class of each component,
   the one with the most links (an original among its edited copies). However many near copies there are, this work is linear in them, and leaves them
   in one component or few.
3. A second pass orders each set by (frequency level, hash) and sends on a prefix: two sets of similarity t share at
   least one shingle in the first n - a + 1 of each, where a is the overlap they need. Groups now hold classes of one
   component. Shingles meet by hash ranges; two groups of different components that share one are a pair, if sizes and
   places in the prefixes allow the similarity. The prefix is no longer than that: in a longer one, texts that have most
   of a template in common, but too little to link, would all meet in the template's shingles.
4. Each set has a bitmap of one to two bits a shingle; a member's bits that the other group's union lacks bound its overlap
   from above. Pairs of groups in which no member of either side can reach what it needs end here, before any set travels.
   A third pass builds the matrices of groups that are left, from texts that a bit filter lets through, and joins them:
   a member stays in play while its overlap with the other group's union reaches t times its size; for those that
   stay, one product of bit matrices gives every overlap exactly. Each pair of groups sends on a spanning forest of
   its links only.

Step 2 only saves work: step 3 finds every pair of classes that can be similar and isn't linked yet, and all links are
counted exactly. The sketch and the bit filters are broadcast; their sizes are bounded by parameters, and none of them
can lose a link: the order of shingles is free as long as it is the same everywhere, and classes that a filter marks by
chance are treated like those marked on purpose. Equal hashes of different shingles (64 bits, drawn by byte and place)
or components (64 bits) are left to chance, some 1 in 10^19 for two of them.

Edge cases: null and empty texts, and texts of white space, have an empty set and no links; texts with fewer words than
a shingle have their whole sequence as the one shingle; a null doc_id takes part but can't name a component unless all
of it is null; repeated rows are copies; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkernel
from .components import Forest, components

U = np.uint64


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80
    members: int = 96
    hashes: int = 4
    often: int = 24  # components that share a value of the other min-hashes, for it to be used
    leaders: int = 8  # classes that stand in each group of a frequent min-hash
    sketch_bits: int = 22
    filter_bits: int = 28

    def prefix(self, n):
        return n - (self.percent * n + 99) // 100 + 1

    def overlap(self, n, m):
        """Shingles that sets of these sizes must share."""
        return -(-self.percent * (n + m) // (100 + self.percent))


def sets(raw: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, _, first = textkernel.words(raw, at, lower=True)
    grams, whole = textkernel.shingles(hashes, first, k)
    for i in range(len(at) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= k:
            yield np.unique(grams[lo:hi][whole[lo:hi]])
        elif hi > lo:
            h = np.full(1, hi - lo, U)
            for w in hashes[lo:hi]:
                h = textkernel.mix(h * U(5) + w + U(0x9E37))
            yield h
        else:
            yield np.zeros(0, U)


def each_set(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    raw, at = common.utf8(batch.column("text"))
    for lo, hi in common.slices(at, 1 << 21):
        yield from enumerate(sets(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k), lo)


def class_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


#: Factors of the min-hash functions beyond the first, which takes the shingle's hash as it is: fixed arbitrary odd numbers.
FACTORS = (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273)


def minhashes(s: np.ndarray, j: Join) -> list[int]:
    return signed(np.array([s[0], *((s * U(f)).min() for f in FACTORS[: j.hashes - 1])])).tolist()


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the shingles by their low bits: the least power of two that isn't below the set's size, 64 at least."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    bits = np.zeros(size // 8, np.uint8)
    place = (s & U(size - 1)).astype(np.int64)
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return bits.tobytes()


def short(keys: list[bytes]) -> np.ndarray:
    """The number of a class outside first components: the first 8 bytes of its key."""
    return np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64)


def named(doc_id, key):
    """A class's name: its smallest doc_id (a null one last) in bytes that sort like it, then its key. A component's
    smallest name begins with its smallest doc_id."""
    digits = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.when(doc_id.isNull(), "01FFFFFFFFFFFFFFFF").otherwise(F.concat(F.lit("00"), digits))), key)


def smallest_id(name):
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number)


# ---- arrays of counts that all tasks add up


SLICE = 1 << 16
COUNTS = "part int, counts binary"


def pack_counts(total: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Slices with anything in them, compressed."""
    pack = zstandard.ZstdCompressor(level=1)
    parts, blobs = [], []
    for i in range(0, len(total), SLICE):
        if total[i : i + SLICE].any():
            parts.append(i // SLICE)
            blobs.append(pack.compress(total[i : i + SLICE].astype("<u4").tobytes()))
    return parts, blobs


FAN = 64


def merged(rows: DataFrame, merge, kind: str) -> DataFrame:
    """One row for each slice. Tasks' rows meet in rounds of FAN, so that no task reads a slice of every task."""
    spark = rows.sparkSession
    n = common.partitions(spark)
    sources = rows.rdd.getNumPartitions()
    rows = rows.withColumn("salt", F.spark_partition_id())
    names = [c.split()[0] for c in kind.split(", ")]
    while sources > FAN:
        sources = -(-sources // FAN)
        rows = rows.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int"))
        rows = rows.repartitionById(n, F.pmod(F.xxhash64("part", "salt"), F.lit(n)).cast("int")).sortWithinPartitions("salt", "part").mapInArrow(_by_salt(merge, names), f"{kind}, salt int")
    return rows.select(*names).repartitionById(n, F.pmod("part", F.lit(n))).mapInArrow(merge, kind)


def _by_salt(merge, names: list[str]):
    """merge applied to each run of rows of equal salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            salts = batch.column("salt").to_pylist()
            for i, salt in enumerate(salts):
                if salt != now and held:
                    for out in merge(iter(held)):
                        yield out.append_column("salt", pa.array([now] * out.num_rows, pa.int32()))
                    held = []
                now = salt
                held.append(batch.select(names).slice(i, 1))
        if held:
            for out in merge(iter(held)):
                yield out.append_column("salt", pa.array([now] * out.num_rows, pa.int32()))

    return run


def add_counts(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' arrays, slice by slice on the executors. Its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = np.frombuffer(unpack.decompress(blob), "<u4").astype(np.uint32)
                total[part] = total[part] + own if part in total else own
        for part, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.compress(own.tobytes(), 1)], pa.binary())], ["part", "counts"])

    out = np.zeros(size, np.uint32)
    for part, blob in merged(rows, run, COUNTS).collect():
        own = np.frombuffer(zstandard.decompress(bytes(blob)), "<u4")
        out[part * SLICE : part * SLICE + len(own)] += own
    return out


# ---- 1: classes


def describe(documents: DataFrame, j: Join) -> DataFrame:
    """Per document: doc_id, n_shingles, key (null for an empty set), minhashes, and the bitmap, once a class and task; and each task's part of the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("minhashes", pa.list_(pa.int64())), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, waiting, held = np.zeros(1 << j.sketch_bits, np.int64), set(), [], 0

        def settle() -> None:
            nonlocal waiting, held
            if waiting:
                total[:] += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(total))
            waiting, held = [], 0

        for batch in batches:
            n, key, low, bits = [], [], [], []
            for _, s in each_set(batch, j.words):
                n.append(len(s))
                bits.append(None)
                if not len(s):
                    key.append(None)
                    low.append(None)
                    continue
                key.append(class_key(s))
                low.append(minhashes(s, j))
                if key[-1] not in seen:
                    seen.add(key[-1])
                    bits[-1] = bitmap(s)
                    waiting.append((s >> U(64 - j.sketch_bits)).astype(np.uint32))
                    held += len(s)
                    if held > 1 << 20:
                        settle()
            size = len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(low, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=schema)
        settle()
        parts, blobs = pack_counts(total)
        size = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.binary()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(common.lean(run), f"doc_id long, n_shingles long, key binary, minhashes array<long>, bits binary, {COUNTS}")


def levels(counts: np.ndarray) -> np.ndarray:
    """The place of each bucket of the sketch in the order of shingles, rare first: 128 steps up to a load that chance explains, 4 for each
    doubling beyond. Even where the load is mostly chance, a shingle of some ten documents seldom lies among the first."""
    mean = float(counts.mean())
    ordinary = mean + 4 * np.sqrt(mean) + 6
    over = np.log2(np.maximum(1, counts / ordinary))
    return np.where(counts <= ordinary, 127 * (counts / ordinary), 128 + np.minimum(127, 4 * over)).astype(np.uint8)


# ---- 2: first components


def shared_groups(rows: DataFrame, j: Join, work: common.Workspace, name: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """rows: h, m (function and min-hash), name, size and degree (those with the greatest lead), unique in (h, m, name). Returns members (name, group) of min-hashes that `least`
    rows or more share, and the leaders (name, groups: all groups of their min-hash) of those with more than `members`."""
    rows = work.keep(rows, f"{name}-rows")
    sizes = work.keep(rows.groupBy("h", "m").agg(F.count("*").alias("n")).filter(F.col("n") >= least), f"{name}-sizes")
    chunks = F.ceil(F.col("n") / j.members).cast("long")
    group = lambda chunk: F.xxhash64(F.col("h"), F.col("m"), chunk)
    sized = common.attach(rows, sizes.withColumn("weight", F.col("n")), ["h", "m"], "weight", rows.count(), "inner")
    members = sized.select("name", group(F.pmod(F.xxhash64("name"), chunks)).alias("group"))
    few = rows.groupBy("h", "m", F.pmod(F.xxhash64("name", F.lit(1)), F.lit(j.leaders)).alias("b")).agg(F.max(F.struct("size", "degree", "name")).alias("best"))
    leaders = few.join(sizes.filter(F.col("n") > j.members), ["h", "m"]).select(F.col("best.name").alias("name"), F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), group).alias("groups"))
    return members, leaders


def first_links(members: DataFrame, leaders: DataFrame, sets: DataFrame, j: Join) -> DataFrame:
    """Links within groups, and each linked class's degree in a group (a, b null, n); sets: name, tokens. A leader's set is
    copied to its groups after the join by name."""
    own = members.join(sets, "name").select("group", "name", "tokens")
    more = leaders.join(sets, "name").select(F.explode("groups").alias("group"), "name", "tokens")
    return links_within(own.unionByName(more), j)


# ---- 3: pairs of groups

POSTING = np.dtype([("token", "<u8"), ("component", "<i8"), ("group", "<i8"), ("least", "<u4"), ("most", "<u4"), ("place", "<u4")])


class Dealer:
    """Prefixes of sets as packed rows, dealt by hash ranges of the shingles."""

    def __init__(self, j: Join, level: np.ndarray, buckets: int):
        self.j, self.level, self.buckets = j, level, buckets
        self.held, self.n_held = [], 0

    def add(self, s: np.ndarray, component: int, group: int) -> None:
        j, n = self.j, len(s)
        own = self.level[(s >> U(64 - j.sketch_bits)).astype(np.int64)]
        part = (s[np.argsort(own, kind="stable")] if own.any() else s)[: int(j.prefix(n))]
        rows = np.zeros(len(part), POSTING)
        rows["token"], rows["component"], rows["group"], rows["least"], rows["most"], rows["place"] = part, component, group, n, n, np.arange(len(part))
        self.held.append(rows)
        self.n_held += len(rows)

    def full(self) -> bool:
        return self.n_held > 1 << 19

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows = np.concatenate(self.held)
        bucket = (textkernel.mix(rows["token"]) % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        names, at = np.unique(bucket, return_index=True)
        ends = np.append(at[1:], len(rows))
        for lo in range(0, len(names), 64):
            part = range(lo, min(lo + 64, len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 64].astype(np.int32)), pa.array([rows[at[i] : ends[i]].tobytes() for i in part], pa.binary())], ["bucket", "rows"])
        self.held, self.n_held = [], 0


def is_marked(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    place = (number & np.int64((1 << 63) - 1)) % (8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def postings(documents: DataFrame, j: Join, level, marks, buckets: int) -> DataFrame:
    """bucket, rows (POSTING) of all classes whose key isn't marked; each is a component and a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, dealer = set(), Dealer(j, level.value, buckets)
        for batch in batches:
            for _, s in each_set(batch, j.words):
                if not len(s):
                    continue
                key = class_key(s)
                if key in seen:
                    continue
                seen.add(key)
                own = short([key])
                if is_marked(marks.value, own)[0]:
                    continue
                dealer.add(s, int(own[0]), int(own[0]))
                if dealer.full():
                    yield from dealer.flush()
        yield from dealer.flush()

    return documents.select("text").mapInArrow(common.lean(run), "bucket int, rows binary")


def set_postings(sets: DataFrame, j: Join, level, buckets: int) -> DataFrame:
    """The same of sets at hand: component, group, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(j, level.value, buckets)
        for batch in batches:
            for component, group, tokens in zip(*(batch.column(c).to_pylist() for c in ("component", "group", "tokens")), strict=True):
                dealer.add(np.frombuffer(tokens, "<u8"), component, group)
                if dealer.full():
                    yield from dealer.flush()
        yield from dealer.flush()

    return sets.select("component", "group", "tokens").mapInArrow(common.lean(run), "bucket int, rows binary")


class Pairs:
    """Pairs of groups, each once."""

    MOST = 1 << 20

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        self.size += len(a)
        if self.size > self.MOST:
            self.parts = [self.settled()]
            self.size = len(self.parts[0]) // 2  # what stays counts half, so that sorting stays rare

    def settled(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((0, 2), np.int64)
        pairs = np.concatenate(self.parts)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))]


def folded(rows: np.ndarray, *by: str) -> np.ndarray:
    """One row for each run of equal `by`, with the least and greatest size and the first place."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in by:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    at = np.flatnonzero(new)
    out = rows[at].copy()
    for c, f in (("least", np.minimum), ("most", np.maximum), ("place", np.minimum)):
        out[c] = f.reduceat(rows[c], at)
    return out


def meet(rows: np.ndarray, j: Join, found: Pairs) -> None:
    """Adds every pair of groups of different components that share a shingle of these postings and may hold similar
    members. Components meet first, and only those that may be similar group by group."""
    if not len(rows):
        return
    groups = folded(rows[np.lexsort((rows["group"], rows["component"], rows["token"]))], "token", "component", "group")
    whole = folded(groups, "token", "component")
    first = np.flatnonzero(np.append(True, (groups["token"][1:] != groups["token"][:-1]) | (groups["component"][1:] != groups["component"][:-1])))
    count = np.diff(np.append(first, len(groups)))  # groups of each row of whole
    start = np.flatnonzero(np.append(True, whole["token"][1:] != whole["token"][:-1]))
    size = np.diff(np.append(start, len(whole)))

    def fits(of: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        least, most, place = (of[c].astype(np.int64) for c in ("least", "most", "place"))
        a = j.overlap(least[x], least[y])
        return (100 * most[x] >= j.percent * least[y]) & (100 * most[y] >= j.percent * least[x]) & (place[x] <= most[x] - a) & (place[y] <= most[y] - a)

    def pairs(x: np.ndarray, y: np.ndarray) -> None:
        ok = fits(whole, x, y)
        x, y = x[ok], y[ok]
        each = count[x] * count[y]
        for lo, hi in common.slices(np.concatenate([[0], np.cumsum(each)]), 1 << 21):
            n = each[lo:hi]
            i = common.ragged(np.zeros(hi - lo, np.int64), n)
            p, q = np.repeat(x[lo:hi], n), np.repeat(y[lo:hi], n)
            p, q = first[p] + i // count[q], first[q] + i % count[q]
            ok = fits(groups, p, q)
            p, q = p[ok], q[ok]
            if len(p):
                found.add(groups["group"][p], groups["group"][q])

    for m in np.unique(size[size > 1]).tolist():
        begin = start[size == m]
        if m <= 64:
            left, right = np.triu_indices(m, 1)
            step = max(1, (1 << 20) // len(left))
            for i in range(0, len(begin), step):
                f = begin[i : i + step, None]
                pairs((f + left).ravel(), (f + right).ravel())
        else:  # by size, so that each member meets only those that are large enough, block by block
            for f in begin.tolist():
                order = f + np.argsort(whole["least"][f : f + m], kind="stable")
                floor = np.minimum.accumulate(whole["least"][order][::-1])[::-1]
                for i in range(0, m, 256):
                    mine = order[i : i + 256]
                    end = int(np.searchsorted(floor, 100 * int(whole["most"][mine].max()) // j.percent, "right"))
                    for lo in range(i, max(end, i + 1), 4096):
                        other = np.arange(lo, min(lo + 4096, max(end, i + 1)))
                        x, y = np.meshgrid(np.arange(i, i + len(mine)), other, indexing="ij")
                        ok = x < y
                        pairs(order[x[ok]], order[y[ok]])


def group_pairs(packed: DataFrame, j: Join, buckets: int) -> DataFrame:
    """a, b: pairs of groups of different components that share a prefix shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("rows").to_pylist()]
        found = Pairs()
        meet(np.frombuffer(b"".join(blobs), POSTING), j, found)
        pairs = found.settled()
        for lo in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + (1 << 16), i]) for i in (0, 1)], ["a", "b"])

    return packed.repartitionById(buckets, "bucket").mapInArrow(common.lean(run), "a long, b long").distinct()


# ---- 4: bounds, matrices


def folded_bits(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap at a smaller size (bytes, a power of two)."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_link(left: list, right: list, j: Join) -> bool:
    """Whether a member of each side (n, bits) may have the overlap it needs with one of the other side, as far as the bitmaps tell."""
    for own, other in ((left, right), (right, left)):
        size = min(len(m["bits"]) for m in other)
        union = np.bitwise_or.reduce([folded_bits(np.frombuffer(m["bits"], np.uint8), size) for m in other], axis=0)
        least = min(m["n"] for m in other)
        for m in own:
            n, bits = m["n"], np.frombuffer(m["bits"], np.uint8)
            small = min(size, len(bits))
            missing = folded_bits(bits, small) & ~folded_bits(union, small)
            if n - int(np.bitwise_count(missing).sum()) >= j.overlap(n, max(least, -(-j.percent * n // 100))):
                break
        else:
            return False
    return True


def within_bounds(pairs: DataFrame, bitmaps: DataFrame, j: Join) -> DataFrame:
    """Pairs of groups that may hold a link. bitmaps: group, n, bits of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([may_link(x, y, j) for x, y in sides], pa.bool_()))

    whole = bitmaps.groupBy("group").agg(F.collect_list(F.struct("n", "bits")).alias("members"))
    both = pairs.join(whole.select(F.col("group").alias("a"), F.col("members").alias("left")), "a").join(whole.select(F.col("group").alias("b"), F.col("members").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(common.lean(run), "a long, b long")


MATRIX = "group long, names binary, sizes binary, tokens binary, bits binary"
NAME = 25  # bytes
LINK = "a binary, b binary"


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, as a batch of matrices is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def bit_rows(bits: bytes, m: int) -> np.ndarray:
    return np.frombuffer(bits, np.uint8).reshape(-1, (m + 7) // 8)


def overlaps(x: np.ndarray, y: np.ndarray, m: int, k: int) -> np.ndarray:
    """Common shingles of each two members, from the bit rows of common shingles."""
    out = np.zeros((m, k), np.int64)
    for lo in range(0, len(x), 1 << 14):
        p = np.unpackbits(x[lo : lo + (1 << 14)], axis=1, count=m).astype(np.float32)
        q = np.unpackbits(y[lo : lo + (1 << 14)], axis=1, count=k).astype(np.float32)
        out += np.rint(p.T @ q).astype(np.int64)
    return out


def link_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def by_group(candidates: DataFrame) -> DataFrame:
    """Rows (group, name, tokens) of one class each, group by group in streams."""
    n = common.partitions(candidates.sparkSession)
    return candidates.repartition(n, "group").sortWithinPartitions("group").select("group", "name", "tokens")


def matrix(group: int, members: dict[bytes, np.ndarray]) -> pa.RecordBatch:
    names = sorted(members)
    every = np.concatenate([members[k] for k in names])
    owner = np.repeat(np.arange(len(names)), [len(members[k]) for k in names])
    tokens, inverse = np.unique(every, return_inverse=True)
    bits = np.zeros((len(tokens), (len(names) + 7) // 8), np.uint8)
    np.bitwise_or.at(bits, (inverse, owner // 8), (128 >> (owner % 8)).astype(np.uint8))
    sizes = np.array([len(members[k]) for k in names], "<u4")
    cells = [group, b"".join(names), sizes.tobytes(), tokens.astype("<u8").tobytes(), bits.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(cells)], ["group", "names", "sizes", "tokens", "bits"])


def each_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, members = None, {}
    for batch in batches:
        for group, name, tokens in zip(*(batch.column(c).to_pylist() for c in ("group", "name", "tokens")), strict=True):
            if group != now and members:
                yield matrix(now, members)
                members = {}
            now = group
            members[name] = np.frombuffer(tokens, "<u8")
    if members:
        yield matrix(now, members)


def matrices(candidates: DataFrame) -> DataFrame:
    """Rows of MATRIX."""
    return by_group(candidates).mapInArrow(common.lean(each_matrix), MATRIX)


def similar(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n[:, None] + m[None, :] - inter)


def links_within(candidates: DataFrame, j: Join) -> DataFrame:
    """Matrices are built and read in one pass, so that a task needs one worker."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(each_matrix(batches)):
            sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            m = len(sizes)
            if m < 2:
                continue
            rows = bit_rows(row["bits"], m)
            ok = similar(overlaps(rows, rows, m, m), sizes, sizes, j.percent)
            forest, names = Forest(m), [row["names"][NAME * x : NAME * x + NAME] for x in range(m)]
            out = [(names[x], names[y], None) for x, y in np.argwhere(np.triu(ok, 1)).tolist() if forest.join(x, y)]
            out += [(names[x], None, d) for x, d in enumerate((ok.sum(1) - 1).tolist()) if d > 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return by_group(candidates).mapInArrow(common.lean(run), f"{LINK}, n int")


def links_between(pairs: DataFrame, groups: DataFrame, j: Join) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            n, m = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("sizes", "sizes2"))
            _, x, y = np.intersect1d(np.frombuffer(r["tokens"], "<u8"), np.frombuffer(r["tokens2"], "<u8"), assume_unique=True, return_indices=True)
            if not len(x):
                continue
            p, q = bit_rows(r["bits"], len(n))[x], bit_rows(r["bits2"], len(m))[y]
            # the bound: a member's overlap with the other group's whole union
            reach_n = np.unpackbits(p, axis=1, count=len(n)).sum(0, dtype=np.int64)
            reach_m = np.unpackbits(q, axis=1, count=len(m)).sum(0, dtype=np.int64)
            if not (100 * reach_n >= j.percent * n).any() or not (100 * reach_m >= j.percent * m).any():
                continue
            ok = similar(overlaps(p, q, len(n), len(m)), n, m, j.percent)
            forest, out = Forest(len(n) + len(m)), []
            for a, b in np.argwhere(ok).tolist():
                if forest.join(a, len(n) + b):
                    out.append((r["names"][NAME * a : NAME * a + NAME], r["names2"][NAME * b : NAME * b + NAME]))
            if out:
                yield link_batch(out)

    left = pairs.join(groups.withColumnRenamed("group", "a"), "a")
    both = left.join(groups.select(F.col("group").alias("b"), *(F.col(c).alias(f"{c}2") for c in ("names", "sizes", "tokens", "bits"))), "b")
    return both.select("names", "sizes", "tokens", "bits", "names2", "sizes2", "tokens2", "bits2").mapInArrow(common.lean(run), LINK)


def set_rows(documents: DataFrame, classes: DataFrame, j: Join) -> DataFrame:
    """name, tokens of these classes (key, doc_id, name), each from the text of its smallest doc_id. A bit filter keeps
    the other texts out; a task sends on a class once."""
    size = 1 << min(j.filter_bits, max(20, int(16 * max(1, classes.count())).bit_length()))
    wanted = documents.sparkSession.sparkContext.broadcast(bit_filter(classes, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, bytes]] = set()
        for batch in batches:
            batch = batch.filter(pa.array(is_marked(wanted.value, np.asarray(batch.column("place")))))
            ids, keys, tokens = batch.column("doc_id").to_pylist(), [], []
            rows = []
            for i, s in each_set(batch, j.words):
                key = class_key(s)
                if len(s) and (ids[i], key) not in seen:
                    seen.add((ids[i], key))
                    rows.append(ids[i])
                    keys.append(key)
                    tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "key", "tokens"])

    hashed = documents.select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(0x7FFFFFFFFFFFFFFF).alias("place"))
    found = hashed.mapInArrow(common.lean(run), "doc_id long, key binary, tokens binary").withColumn("name", named(F.col("doc_id"), F.col("key")))
    return found.select("name", "tokens").join(classes.select("name"), "name", "left_semi").dropDuplicates(["name"])


def marked_classes(classes: DataFrame, marks) -> DataFrame:
    """Those whose key is marked, by chance or on purpose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(marks.value, np.asarray(batch.column("number")))))

    return classes.mapInArrow(run, classes.schema)


def linked(documents: DataFrame, j: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    spark = documents.sparkSession
    work = common.Workspace(spark, "jaccard")
    described = work.keep(describe(documents, j), "described")
    docs = described.filter("part is null").select("doc_id", "n_shingles", "key", "minhashes", "bits")
    sketch = add_counts(described.filter("part is not null").select("part", "counts"), 1 << j.sketch_bits)
    level = spark.sparkContext.broadcast(levels(sketch))
    classes = docs.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("minhashes").alias("minhashes"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bits", True).alias("bits"))
    number = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")  # as short() has it
    classes = work.keep(classes.withColumn("name", named(F.col("doc_id"), F.col("key"))).withColumn("number", number), "classes")

    def by_hash(rows: DataFrame, first: int, last: int) -> DataFrame:
        each = F.posexplode(F.slice("minhashes", first + 1, last - first))
        return rows.select("name", "component", each.alias("h", "m")).withColumn("h", F.col("h") + first)

    # 2: first components
    alone = classes.withColumn("component", F.col("name"))
    every = by_hash(alone, 0, j.hashes)
    often = every.groupBy("h", "m").agg(F.count("*").alias("n")).filter((F.col("h") == 0) & (F.col("n") > 1) | (F.col("n") >= j.often))
    near = common.attach(every, often.withColumn("weight", F.col("n")), ["h", "m"], "weight", every.count(), "inner").select("name").distinct()
    chosen = work.keep(classes.select("name", "number").join(near, "name", "left_semi"), "chosen")
    size = 1 << min(j.filter_bits, max(20, int(16 * max(1, chosen.count())).bit_length()))
    marks = spark.sparkContext.broadcast(bit_filter(chosen, size, F.col("number").bitwiseAND(0x7FFFFFFFFFFFFFFF)))
    marked_ = work.keep(marked_classes(classes.select("key", "doc_id", "name", "number", "minhashes"), marks), "marked")
    sets = work.keep(set_rows(documents, marked_, j), "sets")
    links = first_links(*shared_groups(by_hash(marked_.withColumn("component", F.col("name")), 0, 1).select("h", "m", "name", F.lit(1).cast("long").alias("size"), F.lit(0).alias("degree")), j, work, "groups0"), sets, j)
    links = work.keep(links, "links0")
    roots = work.keep(components(links.filter("b is not null"), work, "components0"), "roots0")
    if j.hashes > 1:
        degrees = links.filter("b is null").groupBy(F.col("a").alias("name")).agg(F.max("n").alias("degree"))
        rooted = marked_.join(roots.withColumnRenamed("vertex", "name"), "name", "left").join(degrees, "name", "left").withColumn("component", F.coalesce("root", "name"))
        own = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "name")
        one_each = by_hash(rooted.withColumn("name", own), 1, j.hashes).groupBy("h", "m", "component").agg(F.max("name").alias("best"), F.count("*").alias("size"))
        links = first_links(*shared_groups(one_each.select("h", "m", "best.name", "size", "best.degree"), j, work, "groups1", j.often), sets, j)
        links = roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).unionByName(links.filter("b is not null").drop("n"))
        roots = work.keep(components(work.keep(links, "links1"), work, "components1"), "roots1")

    # 3: pairs of groups of different components
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).withColumn("weight", F.col("n"))
    split = common.attach(roots, sizes, ["root"], "weight", roots.count(), "inner")
    chunk = F.pmod(F.xxhash64("vertex"), F.ceil(F.col("n") / j.members).cast("long"))
    split = split.select(F.col("vertex").alias("name"), F.xxhash64("root").alias("component"), F.xxhash64("root", chunk).alias("group"))
    grouped = classes.select("name", "key", "doc_id", "number", "n", "bits").join(split, "name", "left")
    grouped = work.keep(grouped.select("name", "key", "doc_id", "n", "bits", F.coalesce("component", "number").alias("component"), F.coalesce("group", "number").alias("group")), "grouped")
    buckets = common.partitions(spark)
    dealt = postings(documents, j, level, marks, buckets).unionByName(set_postings(sets.join(grouped.select("name", "component", "group"), "name"), j, level, buckets))
    met = work.keep(group_pairs(dealt, j, buckets), "met")

    # 4: bounds, matrices
    def of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("group")).unionByName(pairs.select(F.col("b").alias("group"))).distinct()

    pairs = work.keep(within_bounds(met, grouped.join(of(met), "group", "left_semi").select("group", "n", "bits"), j), "pairs")
    opened = work.keep(grouped.join(of(pairs), "group", "left_semi").select("name", "key", "doc_id", "group"), "opened")
    built = work.keep(matrices(set_rows(documents, opened, j).join(opened.select("name", "group"), "name")), "matrices")
    links = roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).unionByName(links_between(pairs, built, j))
    roots = components(work.keep(links, "links"), work)
    found = classes.select("key", "name", "copies").join(roots.withColumnRenamed("vertex", "name"), "name", "left").select("key", "copies", smallest_id(F.coalesce("root", "name")).alias("component_id"))
    found = work.keep(found, "found")
    n = docs.count()
    work.drop("met", "pairs", "matrices", "links", "links0", "links1", "roots0", "roots1", "opened", "grouped", "classes", "chosen", "marked", "sets", *(f"groups{i}-{k}" for i in (0, 1) for k in ("rows", "sizes")))
    with_words = common.attach(docs.filter("key is not null").select("doc_id", "n_shingles", "key"), found, ["key"], "copies", n, "inner")
    without = docs.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.select("doc_id", "n_shingles", "component_id").unionByName(without)


def bit_filter(ids: DataFrame, size: int, place=None) -> np.ndarray:
    """Bits (little-endian bytes) of the hashes of all ids, or of another `place` of 63 bits. Each task marks its own; the marks are merged slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            place = (np.asarray(batch.column("place")) % size).astype(np.int64)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        for i in range(0, len(bits), SLICE):
            if bits[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([zstandard.compress(bits[i : i + SLICE].tobytes(), 1)], pa.binary())], ["part", "marks"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                own = np.frombuffer(zstandard.decompress(blob), np.uint8)
                total[part] = total[part] | own if part in total else own
        for part, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.compress(own.tobytes(), 1)], pa.binary())], ["part", "marks"])

    kind = "part int, marks binary"
    place = F.xxhash64("doc_id").bitwiseAND(0x7FFFFFFFFFFFFFFF) if place is None else place
    rows = ids.select(place.alias("place")).mapInArrow(run, kind)
    out = np.zeros(size // 8, np.uint8)
    for part, blob in merged(rows, merge, kind).collect():  # size / 8 bytes at most
        own = np.frombuffer(zstandard.decompress(bytes(blob)), np.uint8)
        out[part * SLICE : part * SLICE + len(own)] |= own
    return out


def marked(doc_id, bits: np.ndarray):
    """Whether a bit filter has the id's bit; a byte of a literal, so no Python and no shuffle."""
    place = F.pmod(F.xxhash64(doc_id).bitwiseAND(0x7FFFFFFFFFFFFFFF), F.lit(8 * len(bits)))
    byte = F.conv(F.hex(F.substring(F.lit(bits.tobytes()), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def split_by(documents: DataFrame, ids: DataFrame, most_bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """(those that may have one of the ids, those that surely don't). Only the first need a join, and so a shuffle of their
    texts. The filter is a literal of the plan and has 2^most_bits bits at most; with far more ids than that it lets all through to the join."""
    size = 1 << min(most_bits, max(19, int(16 * max(1, ids.count())).bit_length()))
    hit = F.coalesce(marked(F.col("doc_id"), bit_filter(ids, size)), F.lit(False))
    return documents.filter(hit), documents.filter(~hit)


def keep_one(documents: DataFrame, j: Join = Join()) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns. Documents without words
    and rows without doc_id stay; of rows that share doc_id and text, one stays, while different texts of one doc_id are
    documents of their own."""
    work = common.Workspace(documents.sparkSession, "keep")
    documents, ids = common.apart(documents, work)
    return common.own_ids(_keep_one(documents, j, work), ids, "doc_id")


def _keep_one(documents: DataFrame, j: Join, work: common.Workspace) -> DataFrame:
    found = work.keep(linked(documents, j).filter("doc_id is not null"), "found")
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    n, distinct = kept.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n != distinct:
        stay = documents.join(kept, "doc_id", "left_semi").select(*documents.columns)
        empty = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")), F.lit("")) == ""
        return stay.filter(~empty).dropDuplicates(["doc_id"]).unionByName(stay.filter(empty)).unionByName(documents.filter(F.col("doc_id").isNull()))
    gone = work.keep(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    maybe, stay = split_by(documents, gone)
    return stay.unionByName(maybe.join(gone, "doc_id", "left_anti").select(*documents.columns))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.read(spark, sf_dir, "documents"), Join(words=4, percent=85))
