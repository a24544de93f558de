"""Encoding of texts with a public byte-level BPE vocabulary by a pair occurrence index."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_WORDS = 300_000
CHUNK_CHARS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: printable bytes stand for themselves, others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE over batches of distinct words.

    All words of a batch are laid out in one array of ids. An index maps each adjacent pair to all its
    positions; the active ranks wait in a heap. Taking ranks in ascending order, every position of a
    pair is merged in one go and the positions of the pairs that arise are added. A merge only makes
    pairs with the new id, whose ranks are larger, so one ascending pass gives the same ids as merging
    word by word.
    """

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.single = np.zeros(256, dtype=np.int64)
        for ch, b in byte_alphabet().items():
            self.single[b] = vocab[ch]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
        total = int(sizes.sum())
        ids = self.single[np.frombuffer(b"".join(raw), dtype=np.uint8)].tolist()
        ends = np.cumsum(sizes)
        nxt = list(range(1, total + 1))
        prv = list(range(-1, total - 1))
        for e, s in zip(ends.tolist(), sizes.tolist()):
            if s:
                nxt[e - 1] = -1
                prv[e - s] = -1
        # index of the pairs: positions by pair, found for the whole batch at once
        first = np.array(ids[:-1], dtype=np.int64) << 32 | np.array(ids[1:], dtype=np.int64) if total > 1 else np.zeros(0, np.int64)
        inner = np.ones(max(total - 1, 0), dtype=bool)
        cuts = ends[:-1] - 1
        inner[cuts[(cuts >= 0) & (cuts < total - 1)]] = False
        at = np.flatnonzero(inner)
        order = at[np.argsort(first[at], kind="stable")]
        keys, starts = np.unique(first[order], return_index=True)
        bounds = [*starts.tolist(), len(order)]
        where: dict[int, list[int]] = {}
        heap: list[tuple[int, int]] = []
        ranks = self.ranks
        for i, key in enumerate(keys.tolist()):
            if key in ranks:
                where[key] = order[bounds[i] : bounds[i + 1]].tolist()
                heap.append((ranks[key][0], key))
        heapq.heapify(heap)
        dead = bytearray(total)
        while heap:
            _, key = heapq.heappop(heap)
            positions = where.pop(key, None)
            if not positions:
                continue
            left, right, new = key >> 32, key & 0xFFFFFFFF, ranks[key][1]
            positions.sort()
            for p in positions:
                q = nxt[p]
                if dead[p] or q < 0 or ids[p] != left or ids[q] != right:
                    continue
                ids[p] = new
                dead[q] = 1
                r = nxt[q]
                nxt[p] = r
                if r >= 0:
                    prv[r] = p
                    pair = new << 32 | ids[r]
                    if pair in ranks:
                        if pair not in where:
                            where[pair] = []
                            heapq.heappush(heap, (ranks[pair][0], pair))
                        where[pair].append(p)
                o = prv[p]
                if o >= 0:
                    pair = ids[o] << 32 | new
                    if pair in ranks:
                        if pair not in where:
                            where[pair] = []
                            heapq.heappush(heap, (ranks[pair][0], pair))
                        where[pair].append(o)
        out: list[list[int]] = []
        begin = 0
        for e in ends.tolist():
            word = []
            p = begin if e > begin else -1
            while p >= 0:
                word.append(ids[p])
                p = nxt[p]
            out.append(word)
            begin = e
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text, a few megabytes of text at a time."""
        out: list[list[int]] = []
        part: list[str | None] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t) if t else 0
            if size >= CHUNK_CHARS:
                out += self._encode_part(part)
                part, size = [], 0
        return out + self._encode_part(part)

    def _encode_part(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in self.cache})
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache = {}
            fresh = list({w for words in split for w in words})
        self.cache.update(zip(fresh, self.encode_words(fresh)))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Any) -> Encoder:
    """The worker's encoder, kept between tasks with its cache of words."""
    if vocabulary.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.id] = Encoder(vocabulary.data)
    return _ENCODERS[vocabulary.id]


class _Vocabulary:
    def __init__(self, broadcast: Any):
        self.broadcast = broadcast
        self.id = broadcast._jbroadcast.id() if hasattr(broadcast, "_jbroadcast") and broadcast._jbroadcast is not None else id(broadcast)

    def __getstate__(self) -> dict:
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def data(self) -> bytes:
        return self.broadcast.value


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> _Vocabulary:
    """The vocabulary file, read where the driver runs and broadcast (1.5 MB, whatever the corpus)."""
    with open(path, "rb") as f:
        return _Vocabulary(spark.sparkContext.broadcast(f.read()))


def encode(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc, ids array<int>): the ids of every text without special tokens, in one pass without shuffle.

    Empty and null texts give an empty list; the strings of special tokens are ordinary text; repeated
    rows give one row each; whole texts are encoded however long they are.
    """
    vocabulary = read_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for b in batches:
            ids = encoder.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[doc, "ids"])

    kind = dict(docs.dtypes)[doc]
    return docs.select(doc, text).mapInArrow(run, f"{doc} {kind}, ids array<int>")


def sizes(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc, tokens): the number of ids of every text."""
    vocabulary = read_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for b in batches:
            n = [len(x) for x in encoder.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[doc, "tokens"])

    kind = dict(docs.dtypes)[doc]
    return docs.select(doc, text).mapInArrow(run, f"{doc} {kind}, tokens long")
