"""Language-model scoring by a weighted backoff automaton over words.

Model: a text is its words (A-Z folded) and one end token. p(w) = (c(w) + A) / (N + A (V + 1)) over training tokens, an
unseen word being the one extra type. States are the root, every training word (and the begin of a text) and every
training word pair; every training pair (u, w) is an arc of u, every training triple (u, v, w) an arc of (u, v). With
Dirichlet smoothing, an arc of state h weighs (c(h, w) + M p(w | shorter h)) / (c(h) + M) and the failure arc of h
M / (c(h) + M), so each state's probabilities sum to 1. Text is read once from left to right: the state is the longest
suffix that training holds; an arc is taken where there is one, else failure arcs lead down to a state that has it or
to the root, and log10 weights add up.

The automaton grows with the input, has no cut-offs, and is never held in one place. Rows are cut into blocks of about
`BLOCK_BYTES` in the order in which they are read. A block's distinct words, pairs and triples leave as sorted 64-bit
hashes with their training counts, one pack for each length and range of hashes; a range's packs are summed together and
the sums go back in the order in which the hashes came, so a block reads them against its own sorted hashes. Nothing is dealt
by a word or a document, so no word, pair or repeated document makes a task longer than others.

Held out: documents with crc32 of doc_id as text modulo 10 equal to 0 (a null doc_id counts as the empty text); they are
scored, not learned. Defined results: a null or empty text is one end token; without training tokens all words are
unseen; words, pairs and triples are told apart by 64-bit hashes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import textkit
from quirework.llm.shared import fix_splits, stored, tasks_for

BLOCK_BYTES = 8 << 20
#: Text whose n-grams are summed in one task.
BUCKET_BYTES = 8 << 20
ADDED = 0.1
#: Prior counts of the words' and of the pairs' states.
PRIOR = {2: 1000.0, 3: 3.0}
ORDERS = (1, 2, 3)
#: Begin of a text as the first, end of a text as the last word of a pair.
EDGE = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD1342543DE82EF95)
_TEXTS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.large_string())])
_PACKS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)


def with_ends(values: np.ndarray, sizes: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text followed by `end`, and where each text begins."""
    ends = np.cumsum(sizes)
    out = np.insert(values, ends, np.full(len(sizes), end, dtype=values.dtype))
    return out, ends - sizes + np.arange(len(sizes))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows of about `limit` bytes and their numbers: they depend on the rows alone, not on the size of batches."""
    number, held, room = TaskContext.get().partitionId() << 32, [], limit
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            stop = min(batch.num_rows, int(np.searchsorted(ends - before, room)) + 1)
            held.append(batch.slice(start, stop - start))
            room -= int(ends[stop - 1] - before)
            start = stop
            if room <= 0:
                yield number, held
                number, held, room = number + 1, [], limit
    if held:
        yield number, held


class _Tokens:
    """The tokens of some texts as hashes, text by text."""

    def __init__(self, columns: list[pa.Array]):
        parts = [textkit.words(c.slice(i, j - i)) for c in columns for i, j in textkit.slices(c)]
        words, sizes = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint64, np.int64), zip(*parts)))
        self.tokens, self.first = with_ends(words, sizes, EDGE)
        self.sizes = sizes + 1

    def grams(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each length n the hash of the n tokens that end at each token; the begin of a text counts as one token."""
        own = self.tokens
        yield 1, own
        # what stands before a text's first token is the end of another text: the same edge
        pairs = textkit.mix(np.roll(own, 1) * _FACTOR + own)
        yield 2, pairs
        triples = textkit.mix(np.roll(pairs, 1) * _FACTOR + own)
        triples[self.first] = pairs[self.first]  # no two tokens stand before: never looked up
        yield 3, triples


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, as many as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    width = planes[0]
    out = np.zeros(((len(planes) - 1) // width, 8), dtype=np.uint8)
    out[:, 8 - width :] = np.frombuffer(planes, np.uint8, offset=1).reshape(width, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def _rising(grams: np.ndarray) -> bytes:
    return _packed(np.diff(grams, prepend=np.uint64(0)))


def _buckets(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Range numbers that sorted hashes fall in, and where each range begins."""
    return np.unique(((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), return_index=True)


def _packer(buckets: int, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _blocks(batches, limit):
            own = _Tokens([b.column("text") for b in held])
            learned = np.repeat(~np.concatenate([np.asarray(b.column("held_out")) for b in held]), own.sizes).astype(np.uint64)
            for n, grams in own.grams():
                # the lowest bit makes room for whether the token is learned: one sort gives distinct hashes and counts
                keys = (grams & ~np.uint64(1)) | learned
                keys.sort()
                grams = keys & ~np.uint64(1)
                at = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
                counts = np.add.reduceat(keys & np.uint64(1), at)
                grams = grams[at]
                ranges, begins = _buckets(grams, buckets)
                parts = list(zip(begins, [*begins[1:], len(grams)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(parts), pa.int64()), pa.array(ranges.astype(np.int64)), pa.array([n] * len(parts), pa.int32()),
                    pa.array([_rising(grams[i:j]) for i, j in parts], pa.binary()), pa.array([_packed(counts[i:j]) for i, j in parts], pa.binary()),
                ], schema=_PACKS)

    return pack


def _sum_packs(packs: pa.Table) -> pa.Table:
    """Each pack's sums over all packs in the order of its hashes, and a check of these; the range's words and their sum once."""
    blocks, lengths = packs.column("block"), np.asarray(packs.column("n"))
    out = []
    for n in ORDERS:
        at = np.flatnonzero(lengths == n)
        if not len(at):
            continue
        some = packs.take(at)
        grams = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in some.column("grams").to_pylist()]
        ends = np.cumsum([len(x) for x in grams])
        counts = np.concatenate([_unpacked(x) for x in some.column("counts").to_pylist()])
        flat = np.concatenate(grams)
        order = np.argsort(flat)
        flat = flat[order]
        starts = np.flatnonzero(np.diff(flat, prepend=~flat[:1]))
        sums = np.add.reduceat(counts[order], starts)
        back = np.empty(len(flat), dtype=np.uint64)
        back[order] = np.repeat(sums, np.diff(np.append(starts, len(flat))))
        stats = np.zeros((2, len(at)), dtype=np.int64)
        if n == 1:
            stats[:, 0] = np.count_nonzero(sums), sums.sum()
        out.append(pa.table({
            "block": blocks.take(at), "bucket": some.column("bucket"), "n": some.column("n"), "sums": pa.array([_packed(x) for x in np.split(back, ends[:-1])], pa.binary()),
            "check": pa.array([int(x[-1]) >> 1 for x in grams], pa.int64()), "types": stats[0], "tokens": stats[1],
        }))
    return pa.concat_tables(out)


def _tagger(limit: int):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _blocks(batches, limit):
            for b in held:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, number)), b.column("doc_id"), b.column("held_out"), b.column("text").cast(pa.large_string())], schema=_TEXTS)

    return tag


def weights(c: dict[int, np.ndarray], first: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 weights that each token adds: those of the root's arcs, and those of the whole automaton.

    c: training counts of the 1, 2 and 3 tokens that end at each token. first: where texts begin.
    """
    shorter = (c[1] + ADDED) / total
    root = walked = np.log10(shorter)
    for n in ORDERS[1:]:
        held = np.roll(c[n - 1], 1)  # uses of the state: the count of the n - 1 tokens before
        count = c[n]
        if n > 2:
            held[first] = 0  # the begin of a text is the longest suffix there is
            count = count.copy()
            count[first] = 0
        prior = PRIOR[n]
        shorter = (count + prior * shorter) / (held + prior)
        failure = np.log10(prior / (held + prior))
        walked = np.where(count > 0, np.log10(shorter), failure + walked)
    return root, walked


def _scorer(tokens: int, total: float):
    def score_block(texts: pa.Table, sums: pa.Table) -> pa.Table:
        own = _Tokens(texts.column("text").chunks)
        lengths, c = np.asarray(sums.column("n")), {}
        for n, grams in own.grams():
            some = sums.take(np.flatnonzero(lengths == n)).sort_by("bucket")
            grams = grams & ~np.uint64(1)
            order = np.argsort(grams)
            ranked = grams[order]
            new = np.ones(len(ranked), dtype=bool)
            new[1:] = ranked[1:] != ranked[:-1]
            values = np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, some.column("sums").to_pylist())]).astype(np.float64)
            numbers = np.cumsum(new) - 1
            if len(values) != numbers[-1] + 1 or int(ranked[-1]) >> 1 != some.column("check")[-1].as_py():
                raise ValueError("the texts have changed between two readings")
            c[n] = np.empty(len(grams))
            c[n][order] = values[numbers]
        root, walked = weights(c, own.first, total)
        summed = lambda x: np.add.reduceat(x, own.first)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": own.sizes, "n_known": summed((c[1] > 0).astype(np.int64)),
            "train_tokens": np.full(len(own.sizes), tokens), "base_score": np.round(summed(root), 6), "score": np.round(summed(walked), 6),
        })

    return score_block


def score(docs: DataFrame, stable: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs` (doc_id, text).

    The texts are read twice and must come in the same partitions and order: stable says that `docs` is the plain scan of a
    table, which does; else it is stored first.
    """
    rows = _texts(docs)
    fix_splits(docs.sparkSession)
    rows = rows if stable else stored(rows, "lm-texts")
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    tasks = tasks_for(docs.sparkSession, 3 * size)  # a text's n-grams take up to three times its bytes
    packs = rows.select("doc_id", "held_out", "text").mapInArrow(_packer(max(1, -(-size // bucket_bytes)), block_bytes), "block long, bucket long, n int, grams binary, counts binary")
    sums = stored(packs.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_sum_packs, "block long, bucket long, n int, sums binary, check long, types long, tokens long"), "lm-sums")
    tokens, types = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tagged = rows.select("doc_id", "held_out", "text").mapInArrow(_tagger(block_bytes), "block long, doc_id long, held_out boolean, text string")
    scorer = _scorer(tokens, tokens + ADDED * (types + 1))
    held = sums.select("block", "bucket", "n", "sums", "check").repartition(tasks, "block")
    return tagged.repartition(tasks, "block").groupBy("block").cogroup(held.groupBy("block")).applyInArrow(scorer, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
