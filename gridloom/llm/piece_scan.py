"""Encoding with a SentencePiece model by a max-plus scan over chunks, and decoding.

The model at hand merges pairs by rank, so its segmentation isn't the one with the greatest sum of scores. It is the
only one in which every two neighbouring pieces stay apart when their text alone is merged. Paths are therefore scored
0 where all neighbours agree and minus infinity elsewhere, and the ids equal the library's.

A giant text is cut every `chunk` characters. The state at a cut is the piece that covers the character before it. A
chunk yields a matrix from the states at its beginning to those at its end; matrices combine by max-plus products, in
any grouping; a scan over a text's matrices finds the state at each cut, after which every chunk is traced back alone.
Inside a chunk, no piece crosses the beginning of a space after another character, so whole words go to the library and
only the parts before the first and after the last word, or a text without spaces, need the programme over positions.
Texts up to `chunk` characters are encoded by the library in the first pass.

Bounds: a matrix has at most `longest`^2 / 2 states a side, in practice some ten; a text of 2 GB has at most 2^31 / chunk
matrices. Edge cases: null counts as empty, an empty text has no ids; U+2581 in a text decodes as a space, as with the
library; repeated rows are encoded each; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NONE = -np.inf
#: A state: first character (in the whole text) and id of the piece; the id of a character that has no piece is OTHER.
OTHER = -1


@dataclass(frozen=True)
class Cut:
    chunk: int = 1 << 15


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: sp.get_score(i) for t, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        if any("▁" in t[1:] and t.strip("▁") for t in self.id):
            raise ValueError("a piece of this model crosses the beginning of a word")
        self._apart: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The model's segmentation of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def apart(self, a: str, b: str) -> bool:
        """Whether b may follow a."""
        if a[-1] not in self.id and len(a) == 1 or b[0] not in self.id and len(b) == 1:
            return True
        key = (a, b)
        if key not in self._apart:
            if len(self._apart) > 1 << 20:
                self._apart.clear()
            self._apart[key] = self.merge(a + b) == [a, b]
        return self._apart[key]

    def at(self, text: str, i: int) -> list[str]:
        """Pieces that begin at character i; a character without a piece stands for itself."""
        found = [text[i:j] for j in range(i + 1, min(i + self.longest, len(text)) + 1) if text[i:j] in self.id]
        return found if text[i] in self.id else [text[i]]

    def ids(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.bytes[b] for b in piece.encode()]

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        """(first character, piece) of all pieces that cover character at - 1."""
        return [(i, p) for i in range(max(0, at - self.longest), at) for p in self.at(text, i) if i + len(p) >= at]


def normal(text: str) -> str:
    """What the model segments: spaces as U+2581, one more in front."""
    return "▁" + text.replace(" ", "▁") if text else ""


class Chunk:
    """Characters [begin, end) of a normal text, given with some characters on either side."""

    def __init__(self, model: Pieces, text: str, base: int, begin: int, end: int, total: int):
        self.m, self.text, self.base, self.total = model, text, base, total
        self.lo, self.hi = begin - base, end - base
        self.entries = [(0, "")] if begin == 0 else [(base + i, p) for i, p in model.states(text, self.lo)]
        self.exits = [(base + i, p) for i, p in model.states(text, self.hi) if end < total or base + i + len(p) == total]
        # beginnings of words: a space after another character
        marks = np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x2581
        word = np.flatnonzero(marks[1:] & ~marks[:-1]) + 1
        word = word[(word >= self.lo + model.longest) & (word <= self.hi - model.longest)]
        self.first, self.last = (int(word[0]), int(word[-1])) if len(word) else (None, None)

    def _walk(self, starts: list[tuple[int, str]], stop: int, goal=None) -> dict[tuple[int, str], list[tuple[int, str]]]:
        """All valid nodes (position after a piece, the piece) reached, with the nodes before them; up to those at or past stop."""
        m, text = self.m, self.text
        before: dict[tuple[int, str], list] = {s: [] for s in starts}
        waiting: dict[int, list[tuple[int, str]]] = {}
        for s in before:
            waiting.setdefault(s[0], []).append(s)
        for pos in range(min(waiting, default=stop), stop):
            here = waiting.pop(pos, [])
            if not here:
                continue
            for p in m.at(text, pos):
                if goal is not None and pos + len(p) > goal:
                    continue
                ok = [n for n in here if not n[1] or m.apart(n[1], p)]
                if ok:
                    node = (pos + len(p), p)
                    if node not in before:
                        before[node] = []
                        waiting.setdefault(node[0], []).append(node)
                    before[node] += ok
        return before

    def _nodes(self, states: list[tuple[int, str]]) -> list[tuple[int, str]]:
        return [(i + len(p) - self.base, p) for i, p in states]

    def _reach(self, before: dict, sources: list[tuple[int, str]]) -> dict[tuple[int, str], set[int]]:
        """For each node, the sources that reach it."""
        own: dict[tuple[int, str], set[int]] = {}
        index = {s: i for i, s in enumerate(sources)}
        for node in sorted(before, key=lambda n: n[0]):
            got = {index[node]} if node in index else set()
            for b in before[node]:
                got |= own[b]
            own[node] = got
        return own

    def matrix(self) -> np.ndarray:
        entry, leave = self._nodes(self.entries), self._nodes(self.exits)
        out = np.full((len(entry), len(leave)), NONE)
        if self.first is None:
            own = self._reach(self._walk(entry, self.hi), entry)
            for j, n in enumerate(leave):
                out[list(own.get(n, ())), j] = 0
            return out
        own = self._reach(self._walk(entry, self.first, self.first), entry)
        into = sorted(set().union(*(v for n, v in own.items() if n[0] == self.first)))
        tail = self._walk([(self.last, "")], self.hi)
        out[np.ix_(into, [j for j, n in enumerate(leave) if n in tail])] = 0
        return out

    def _path(self, before: dict, node: tuple[int, str], start: tuple[int, str] | None) -> list[str]:
        """Pieces from start (any source where None) to node; a start's own piece isn't among them."""
        seen, stack = set(), [(node, ())]
        while stack:
            n, path = stack.pop()
            if n == start or start is None and not before[n]:
                out = []
                while path:
                    out.append(path[0])
                    path = path[1]
                return out
            if n in seen:
                continue
            seen.add(n)
            stack += [(b, (n[1], path)) for b in before[n]]
        raise ValueError("no path")

    def trace(self, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the path between two states."""
        start, goal = self._nodes(self.entries)[entry], self._nodes(self.exits)[leave]
        if self.first is None:
            return [i for p in self._path(self._walk([start], self.hi), goal, start) for i in self.m.ids(p)]
        before = self._walk([start], self.first, self.first)
        ends = [n for n in before if n[0] == self.first]
        head = self._path(before, ends[0], start)
        middle = self.text[self.first + 1 : self.last].replace("▁", " ")
        inner = self.m.library.encode(middle) if self.first < self.last else []
        tail = self._path(self._walk([(self.last, "")], self.hi), goal, (self.last, ""))
        return [i for p in head for i in self.m.ids(p)] + inner + [i for p in tail for i in self.m.ids(p)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all prefixes, by halves: neighbours combine first, so the depth is logarithmic."""
    if len(matrices) <= 1:
        return list(matrices)
    pairs = [product(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
    even = scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(even[i // 2] if i % 2 else product(even[i // 2 - 1], matrices[i]))
    return out


def choose(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and after each chunk on the best path."""
    prefix = scan(matrices)
    state = int(prefix[-1][0].argmax())
    if prefix[-1][0][state] == NONE:
        raise ValueError("no segmentation")
    out = []
    for i in range(len(matrices) - 1, -1, -1):
        came = int((prefix[i - 1][0] + matrices[i][:, state]).argmax()) if i else 0
        out.append((came, state))
        state = came
    return out[::-1]


CHUNK = "key string, doc_id long, chunk int, text string, base long, begin long, end long, total long"
DONE = "doc_id long, n_tokens long, ids_crc32 long, n_chunks int, round_trip boolean"


def digest(ids: list[int] | np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def encode(documents: DataFrame, path: str, cut: Cut = Cut(), with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chunks, round_trip[, ids: little-endian u32] for every document."""
    spark = documents.sparkSession
    work = common.Workspace(spark, "pieces")
    margin = 64

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            done: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                if len(text) <= cut.chunk:
                    ids = m.library.encode(text)
                    done.append((doc, len(ids), digest(ids), 1, m.library.decode(ids) == text.replace("▁", " "), np.asarray(ids, "<u4").tobytes() if with_ids else None))
                    continue
                whole, key = normal(text), uuid.uuid4().hex
                for c, begin in enumerate(range(0, len(whole), cut.chunk)):
                    end = min(begin + cut.chunk, len(whole))
                    base = max(0, begin - margin)
                    yield row(doc, None, (key, c, whole[base : end + margin], base, begin, end, len(whole)))
            if done:
                columns = list(zip(*done, strict=True))
                n = len(done)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[:6], strict=True)] + [pa.nulls(n, t) for t in types[6:]], names)

    names = ["doc_id", "n_tokens", "ids_crc32", "n_chunks", "round_trip", "ids", "key", "chunk", "text", "base", "begin", "end", "total"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def row(doc, _, chunk) -> pa.RecordBatch:
        cells = [doc, None, None, None, None, None, *chunk]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names)

    kind = f"{DONE}, ids binary, key string, chunk int, text string, base long, begin long, end long, total long"
    common.tune(spark)
    started = work.keep(documents.select("doc_id", "text").mapInArrow(first, kind), "first")
    parts = common.partitions(spark)
    chunks = started.filter("key is not null").select("key", "doc_id", "chunk", "text", "base", "begin", "end", "total").repartition(parts, "key", "chunk")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            for r in batch.to_pylist():
                found = Chunk(m, r["text"], r["base"], r["begin"], r["end"], r["total"]).matrix()
                yield pa.RecordBatch.from_pydict({"key": [r["key"]], "chunk": [r["chunk"]], "rows": [found.shape[0]], "matrix": [found.astype("<f4").tobytes()]}, pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("rows", pa.int32()), ("matrix", pa.binary())]))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        found = choose([np.frombuffer(x, "<f4").reshape(n, -1).astype(float) for x, n in zip(group["matrix"], group["rows"], strict=True)])
        return pd.DataFrame({"key": group["key"].to_numpy(), "chunk": group["chunk"].to_numpy(), "enter": [a for a, _ in found], "leave": [b for _, b in found]})

    states = chunks.mapInArrow(transfer, "key string, chunk int, rows int, matrix binary").groupBy("key").applyInPandas(settle, "key string, chunk int, enter int, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(path)
        for batch in batches:
            for r in batch.to_pylist():
                ids = Chunk(m, r["text"], r["base"], r["begin"], r["end"], r["total"]).trace(r["enter"], r["leave"])
                text = r["text"][r["begin"] - r["base"] :] if r["chunk"] else r["text"][1:]
                inner = text[: r["end"] - r["begin"] - (r["chunk"] == 0)].replace("▁", " ")
                yield pa.RecordBatch.from_pydict({"key": [r["key"]], "doc_id": [r["doc_id"]], "chunk": [r["chunk"]], "ids": [np.asarray(ids, "<u4").tobytes()], "crc": [zlib.crc32(inner.encode())], "size": [len(inner.encode())]}, pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("ids", pa.binary()), ("crc", pa.int64()), ("size", pa.int64())]))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        """All ids of one text; decoded text against the chunks of the original."""
        group = group.sort_values("chunk")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in group["ids"]])
        back, at, same = pieces(path).library.decode(ids.tolist()).encode(), 0, True
        for crc, size in zip(group["crc"], group["size"], strict=True):
            same &= zlib.crc32(back[at : at + size]) == crc
            at += size
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "n_tokens": [len(ids)], "ids_crc32": [digest(ids)], "n_chunks": [len(group)], "round_trip": [bool(same and at == len(back))], "ids": [ids.tobytes() if with_ids else None]}).astype({"doc_id": "Int64"})

    traced = chunks.join(states, ["key", "chunk"]).select("key", "doc_id", "chunk", "text", "base", "begin", "end", "total", "enter", "leave").mapInArrow(trace, "key string, doc_id long, chunk int, ids binary, crc long, size long")
    giant = traced.groupBy("key").applyInPandas(join, f"{DONE}, ids binary")
    names_out = [c.split()[0] for c in DONE.split(", ")] + ["ids"] * with_ids
    return started.filter("key is null").select(*names_out).unionByName(giant.select(*names_out))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids (little-endian u32). Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces(path).library
        for batch in batches:
            texts = [None if x is None else sp.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.read(spark, sf_dir, "documents"), model_path())
