"""SentencePiece encoding for merge-type vocabularies by a score-ordered agenda, checked against the library.

No piece of such a vocabulary holds the blank mark after another character (this is asserted), so no merge crosses the
begin of a run of blank marks: a text falls into segments (blank marks and what follows them) that are encoded alone.
A segment's symbols start as characters; an agenda holds the adjacent pairs whose join is a piece, best score first, then
leftmost, and each merge enters the two new pairs. Symbols left without an id become bytes.

Segments are remembered by worker processes in two generations of bounded size. The segments that are new in an
Arrow batch are joined and encoded by the library as well; where it differs, the segment takes the library's ids, and every
document that holds it says so: `n_borrowed` counts a document's segments whose ids are the library's, not the agenda's.

Defined results: a null or empty text is its begin and end id and decodes to ""; repeated rows are encoded one by one;
texts of any length go through whole, in time n log n at worst; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import textkit

BLANK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Segments remembered by a worker in each of two generations.
REMEMBERED = 150_000
_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*")
_workers: dict[str, "Encoder"] = {}


def model_path(name: str = DEFAULT_MODEL) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """Encodes and decodes with one vocabulary; ids are bytes, four little-endian ones each."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.cost):
            raise ValueError("the vocabulary has pieces across blanks")
        pack = lambda i: i.to_bytes(4, "little")
        self.ids = {lib.id_to_piece(i): pack(i) for i in plain}
        self.of_byte = [pack(lib.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.head, self.tail = pack(lib.bos_id()), pack(lib.eos_id())
        self.borrowed: set[str] = set()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, segment: str) -> bytes:
        """Ids of a segment by the agenda of adjacent pairs."""
        symbols, cost = list(segment), self.cost
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue
            symbols[left], symbols[right] = piece, None
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if (p := piece + symbols[nxt]) in cost:
                    heapq.heappush(agenda, (cost[p], left, nxt, p))
            prv = before[left]
            if prv >= 0 and (p := symbols[prv] + piece) in cost:
                heapq.heappush(agenda, (cost[p], prv, left, p))
        ids = self.ids
        return b"".join([ids[s] if s in ids else b"".join([self.of_byte[b] for b in s.encode()]) for s in symbols if s is not None])

    def _library_ids(self, segments: list[str]) -> bytes:
        text = "".join(segments)[1:].replace(BLANK, " ")
        return np.array(self.library.encode(text, num_threads=1) if text else [self.library.piece_to_id(BLANK)], dtype="<u4").tobytes()

    def _learn(self, segments: list[str]) -> None:
        """Encodes segments that are not remembered and checks them against the library."""
        solid = [s for s in segments if s[-1] != BLANK]
        for group in (solid, *([s] for s in segments if s[-1] == BLANK)):
            found = [self.merge(s) for s in group]
            if group and b"".join(found) != self._library_ids(group):
                own, found = found, [self._library_ids([s]) for s in group]
                self.borrowed.update(s for s, x, y in zip(group, own, found) if x != y)
            self.young.update(zip(group, found))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[int]]:
        """Ids of each text, with begin and end ids; how many of its segments took the library's ids instead of the agenda's."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        split = [_SEGMENT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        young, old, new = self.young, self.old, {}
        for segments in split:
            for s in segments:
                if s not in young:
                    if s in old:
                        young[s] = old[s]
                    else:
                        new[s] = None
        self._learn(list(new))
        get = young.__getitem__
        borrowed = [sum(s in self.borrowed for s in segments) for segments in split] if self.borrowed else [0] * len(split)
        return [self.head + b"".join(map(get, segments)) + self.tail for segments in split], borrowed

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, dtype="<u4").tolist() for x in ids], num_threads=1)


def encoder(path: str) -> Encoder:
    """The worker process's encoder of a model."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def _mapped(path: str, out: Callable[[Encoder, pa.Array, list[bytes], list[int]], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in textkit.slices(texts):
                ids, borrowed = encoder(path).encode(texts.slice(a, b - a).to_pylist())
                yield out(encoder(path), batch.column("doc_id").slice(a, b - a), ids, borrowed)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) and n_borrowed of each row of `docs` (doc_id, text)."""

    def out(coder: Encoder, doc_ids: pa.Array, ids: list[bytes], borrowed: list[int]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(offsets, flat), pa.array(coder.decode(ids), type=pa.large_string()), pa.array(borrowed, type=pa.int64())], names=["doc_id", "ids", "decoded", "n_borrowed"])

    return _rows(docs).mapInArrow(_mapped(path or model_path(), out), "doc_id long, ids array<int>, decoded string, n_borrowed long")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_borrowed of the same ids and texts, which don't leave the Python workers."""

    def out(coder: Encoder, doc_ids: pa.Array, ids: list[bytes], borrowed: list[int]) -> pa.RecordBatch:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(t.encode()) for t in coder.decode(ids)]), pa.array(borrowed, type=pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_borrowed"])

    return _rows(docs).mapInArrow(_mapped(path or model_path(), out), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_borrowed long")
