import math

import numpy as np
import pytest
from corpus_texts import prose

from gridloom.llm import piece_scan, sharding, topk_search

VEC = "vec_id long, embedding array<double>, label int"


def plain_topk(rows, every, k):
    sound = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q in sorted({i for i, _ in sound if i % every == 0}):
        mine = next(v for i, v in sound if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=False)), i) for i, v in sound if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("case", ["random", "copies", "odd", "few", "large", "repeated"])
def test_topk(spark, case):
    r = np.random.default_rng(1)
    if case == "random":
        rows = [(i, r.normal(size=8).round(3).tolist()) for i in range(400)]
    elif case == "copies":
        rows = [(i, [0.5, 0.25, -0.5] if i % 3 else r.normal(size=3).round(2).tolist()) for i in range(300)]
    elif case == "odd":
        rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (10, [1.0]), (20, []), (None, [1.0, 1.0]), (7, [-1.0, 0.003]), (8, [1.0, 2.0]), (8, [3.0, 2.0])]
    elif case == "large":  # products beyond float64's whole numbers, and components beyond the index
        rows = [(i, r.normal(size=3).round(3).tolist()) for i in range(120)]
        rows += [(130, [1e5, 0.5, -1.0]), (131, [3e6 + 0.25, 1.0, 0.5]), (132, [-2e6, 7.25, 1.0]), (140, [2e6 + 0.5, 1.0, 1.25]), (141, [3.0, 1e6, 0.125])]
    elif case == "repeated":  # a query's row over and over, beyond many blocks
        rows = [(i, r.normal(size=6).round(3).tolist()) for i in range(200)]
        rows += [rows[50]] * 500
    else:
        rows = [(0, [1.0]), (10, [2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VEC).withColumnRenamed("label", "score")
    got = {tuple(x) for x in topk_search.search(df, 10, 5, topk_search.Index(block_rows=16, pivots=6)).collect()}
    assert got == plain_topk(rows, 10, 5)


def test_topk_saturates(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [-1e308, 1.0], 1), (3, [0.0, 2.0], 1)], VEC)
    got = [tuple(x) for x in topk_search.search(df, 10, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1, (1 << 63) - 1), (0, 2, 3, 256 * 512), (0, 3, 2, -(1 << 63))]


def test_topk_empty(spark):
    assert topk_search.search(spark.createDataFrame([], VEC)).count() == 0


def test_sharding(spark, frame, odd_texts, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", sharding.Tiers(target_bytes=60_000, least_bytes=1000, fan=3))
    texts = odd_texts + [prose(i, 50) for i in range(200)]
    schema = frame([]).withColumnRenamed("lang", "shard").schema
    for i in range(0, len(texts), 30):
        store.append(frame(texts[i : i + 30], i).withColumnRenamed("lang", "shard").coalesce(2))
    store.append(frame([]).withColumnRenamed("lang", "shard"))
    before, version = store.manifest().count(), store.version()
    old = store.read(schema, version)
    assert old.count() == len(texts)
    assert store.compact(schema) > version
    assert store.manifest().count() < before
    assert sorted((r.doc_id, r.text or "") for r in store.read(schema).collect()) == [(i, t or "") for i, t in enumerate(texts)]
    assert sorted(r.doc_id for r in store.read(schema, version).collect()) == list(range(len(texts)))  # a reader's version stays
    sizes = store.tiered(store.manifest()).filter("tier is not null").groupBy("tier").count().collect()
    assert all(r["count"] < 3 for r in sizes)
    store.vacuum()  # all of it is younger than the time that readers and writers have
    assert store.read(schema, version).count() == store.read(schema).count() == len(texts)
    sharding.ShardStore(spark, store.root, sharding.Tiers(keep_hours=-1)).vacuum()
    assert store.read(schema).count() == len(texts)
    with pytest.raises(Exception):  # noqa: B017
        store.read(schema, version).count()


def test_ingest_compacts_any_table(spark, tmp_path):
    """A table of one file: more than one version, and fewer shards than arrivals."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = sharding.ingest(documents, f"file://{tmp_path}/s")
    assert store.version() > 8 and store.manifest().count() < 8
    assert store.read(documents.schema).exceptAll(documents).isEmpty() and store.read(documents.schema).count() == documents.count()


def test_commit_is_exclusive(spark, frame, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(frame(["a", "b"]))
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(store.manifest(), 0)
    assert store.version() == 1 and store.read(frame([]).schema).count() == 2


def test_empty_store(spark, frame, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(frame([]))
    assert store.compact(frame([]).schema) == 1 and store.read(frame([]).schema).count() == 0


MODEL = piece_scan.model_path()


def scanned(text, chunk):
    m, whole = piece_scan.pieces(MODEL), piece_scan.normal(text)
    chunks = []
    for b in range(0, len(whole), chunk):
        e, base = min(b + chunk, len(whole)), max(0, b - 64)
        chunks.append(piece_scan.Chunk(m, whole[base : e + 64], base, b, e, len(whole)))
    return [i for c, s in zip(chunks, piece_scan.choose([c.matrix() for c in chunks]), strict=True) for i in c.trace(*s)]


@pytest.mark.parametrize("chunk", [64, 100, 1000])
def test_scan_equals_the_library(chunk):
    import random

    r, sp = random.Random(chunk), piece_scan.pieces(MODEL).library
    texts = [prose(i, 120) for i in range(8)] + [prose(i, 120).replace(" ", "") for i in range(8)]
    texts += ["".join(r.choice("ab cé日本 \n\tthe ▁in") for _ in range(300)) for _ in range(25)] + [" " * 150, "a" * 400, "日" * 200, " x" * 90]
    for t in texts:
        assert scanned(t, chunk) == sp.encode(t)


def test_products_are_associative():
    r = np.random.default_rng(0)
    a, b, c = (np.where(r.random(s) < 0.5, 0.0, -np.inf) for s in ((3, 4), (4, 2), (2, 5)))
    p = piece_scan.product
    assert (p(p(a, b), c) == p(a, p(b, c))).all()
    assert all((x == y).all() for x, y in zip(piece_scan.scan([a, b, c]), [a, p(a, b), p(p(a, b), c)], strict=True))


def test_encode_documents(spark, frame, odd_texts):
    texts = odd_texts + [prose(3, 2000), prose(4, 900).replace(" ", "")]
    df = frame(texts).withColumnRenamed("lang", "key")
    rows = piece_scan.encode(df, MODEL, piece_scan.Cut(chunk=500), with_ids=True)
    sp = piece_scan.pieces(MODEL).library
    got = {r.doc_id: r for r in rows.collect()}
    for i, t in enumerate(texts):
        want = sp.encode(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].n_tokens == len(want) and got[i].round_trip
        assert got[i].ids_crc32 == piece_scan.digest(want)
    assert max(r.n_chunks for r in got.values()) > 10
    assert {r.doc_id: r.text for r in piece_scan.decode(rows, MODEL).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert piece_scan.encode(frame([]), MODEL).count() == 0
