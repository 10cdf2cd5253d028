import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus_texts import prose
from tokenizers import Tokenizer

from gridloom.llm import common, cutting_stock, packing, textkernel, token_output, tokens

PATH = tokens.byte_bpe_path()


LIBRARY = Tokenizer.from_file(PATH)


def library(texts, end):
    t = LIBRARY
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def thue_morse(steps: int) -> list[str]:
    """Two words of 2^steps letters whose hashes agree under any polynomial modulo 2^64 from 10 steps on."""
    word = "a"
    for _ in range(steps):
        word += word.translate({97: 98, 98: 97})
    return [word, word.translate({97: 98, 98: 97})]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_the_library(odd_texts):
    texts = odd_texts + ["a.b,c!d", "it's.\nNext", "x \n y", "1a 2b", "<|endoftext|>", "  two", "end.\n", "é, à", "\n\nx", "a\n b", "'s 's", "A\u00a0b c", "word\tword"]
    raw, at = common.utf8(pa.array(texts, pa.string()))
    ids, before = tokens.encoder(PATH).encode(raw, at)
    assert [ids[before[i] : before[i + 1]].tolist() for i in range(len(texts))] == [x[:-1] for x in library(texts, 0)]


@pytest.mark.parametrize("hashes", ["own", "few"])
def test_ids_do_not_rest_on_hashes(odd_texts, hashes, monkeypatch):
    """Long words of two letters, added tokens, and hashes that nearly all collide."""
    if hashes == "few":
        plain = textkernel.segment_hashes
        monkeypatch.setattr(textkernel, "segment_hashes", lambda *a: plain(*a) % textkernel.U(7))
    one, other = thue_morse(10)
    texts = [one, other, f"{one} {other}", "hello <|endoftext|> world", "<|endo", "ftext|>", "a<|endoftext|><|endoftext|>"] + odd_texts
    raw, at = common.utf8(pa.array(texts, pa.string()))
    ids, before = tokens.BpeEncoder(PATH).encode(raw, at)
    assert [ids[before[i] : before[i + 1]].tolist() for i in range(len(texts))] == [x[:-1] for x in library(texts, 0)]


def test_units_are_forgotten_beyond_the_bound(odd_texts, monkeypatch):
    e = tokens.BpeEncoder(PATH)
    monkeypatch.setattr(e, "MOST", 5)
    for _ in range(2):
        raw, at = common.utf8(pa.array(odd_texts, pa.string()))
        ids, before = e.encode(raw, at)
        assert len(ids) == sum(len(x) - 1 for x in library(odd_texts, 0))


@pytest.mark.parametrize("texts", ["odd", "empty", "large"])
def test_token_output_round_trip(spark, frame, odd_texts, texts, tmp_path):
    texts = {"odd": odd_texts, "empty": [], "large": [prose(i, 60 + i % 50) for i in range(400)]}[texts]
    ids = [(i * 7919) % 100003 for i in range(len(texts))]
    df = frame(texts, ids=ids).withColumnRenamed("source", "shard")
    root = f"file://{tmp_path}/out"
    form = token_output.Format(dictionary_bytes=2048, sample_documents=300)
    manifest = token_output.write(df, root, PATH, form, shards=3)
    got = sorted(tuple(r)[:4] for r in token_output.read_index(spark, root, manifest).collect())
    want, start = [], 0
    for i in sorted(range(len(texts)), key=lambda i: ids[i]):
        own = library([texts[i]], form.end_id)[0]
        want.append((ids[i], start, len(own), crc(own)))
        start += len(own)
    assert got == want
    if texts:
        row = manifest.first()
        dictionary = (tmp_path / "out/dictionary").read_bytes()
        assert dictionary
        shard = token_output.ShardReader(root, row.path, dictionary)
        assert [x.tolist() for x in shard.find(int(shard.doc_ids[0]))] == [library([texts[ids.index(int(shard.doc_ids[0]))]], form.end_id)[0]]
        with pytest.raises(ValueError):
            token_output.ShardReader(root, row.path, dictionary + b"x")


def test_token_output_null_and_repeated_ids(spark, frame, tmp_path):
    df = frame(["b", "a", "a", "c"], ids=[None, 1, 1, 0])
    root = f"file://{tmp_path}/o"
    got = token_output.read_index(spark, root, token_output.write(df, root, PATH, shards=2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 1] and [r.start for r in got] == [0, 2, 4, 6]


def test_plan_covers_and_fills():
    r = np.random.default_rng(3)
    lengths = np.minimum(64, r.geometric(0.05, 3000))
    sizes, demand = np.unique(lengths, return_counts=True)
    patterns, uses = cutting_stock.plan(sizes, demand, 64)
    assert ((patterns * sizes).sum(1) <= 64).all() and ((patterns * uses[:, None]).sum(0) >= demand).all()
    assert uses.sum() <= 1.02 * (sizes * demand).sum() / 64 + 2


def test_knapsack_is_the_best():
    sizes, values = np.array([3, 4, 7]), np.array([2.0, 3.0, 5.5])
    best = max(a * 2 + b * 3 + c * 5.5 for a in range(6) for b in range(5) for c in range(3) if 3 * a + 4 * b + 7 * c <= 17)
    assert cutting_stock.knapsack(values, sizes, 17)[0] == pytest.approx(best)


def test_packing(frame, odd_texts):
    texts = odd_texts + [prose(i, 30) for i in range(150)] + ["same words here"] * 60
    shape = packing.Shape(tokens=256)
    rows = packing.pack(frame(texts).withColumnRenamed("lang", "offset"), PATH, shape).toPandas()
    own = library(texts, shape.end_id)
    for d, g in rows.groupby("doc_id"):
        g = g.sort_values("start")
        assert g.length.sum() == len(own[d]) == g.doc_tokens.iloc[0]
        assert (g.start == g.length.cumsum() - g.length).all()
        assert [crc(own[d][s : s + n]) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    assert set(rows.doc_id) == set(range(len(texts)))
    q = rows.sort_values(["sequence_id", "offset"])
    assert (q.groupby("sequence_id").length.cumsum() - q.length == q.offset).all()
    filled = q.groupby("sequence_id").length.sum()
    assert filled.max() <= 256 and filled.sum() >= 0.9 * 256 * (len(filled) - 1)


def test_packing_empty(frame):
    assert packing.pack(frame([]), PATH).count() == 0
