"""Exact top-k search by integer inner product with block-at-a-time pruning.

Rows are ordered so that neighbours are alike: a tree of median splits, each along the component that varies most,
is fitted on a sample of at most SAMPLE_ROWS rows and sends every row to a leaf; document ranges of (leaf, id) make the blocks.
A block is a forward index (ids and a matrix of components) with the largest and smallest value of each component ("term").
A query's bound for a block is the sum over its terms of the better product with one of the two. In a group of blocks a query
visits them by falling bound, in waves of 1, 2, 4 and more blocks that it shares with other queries, and leaves out those whose
bound has fallen below its k-th score. A block is scored through its forward
index in two parts: after the components that vary most, a row's bound is its score so far plus the product of the norms of
what is left, and only rows whose bound reaches the k-th score are scored to the end. Equal bounds are still scored, because ties go
to the smaller id. The sample moves rows between blocks, never a result.

Blocks and chunks of queries meet in groups of bounded size: every group of blocks gets each chunk once, and the group's best k of
each query are merged by a window over at most k rows for each query and group.

Products are exact: float64 matrix products where all sums stay below 2 ** 53, else Python integers, which saturate as
64-bit scores.

Defined results: missing trailing components count as 0; rows with a null id or vector take no part; rows that repeat are
candidates of each other, only the query's own row is not; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import cut

BLOCK_ROWS = 256
CHUNK_QUERIES = 512
#: Blocks that meet a chunk in one group, on average.
GROUP_BLOCKS = 128
#: Rows that the tree is fitted on, and its leaves, at most.
SAMPLE_ROWS, LEAVES = 20_000, 1024
#: Share of the components in the first part of a score.
HEAD = 0.75
_EXACT = 2.0**53
_NONE = np.iinfo(np.int64).min


def _packer(rows: int, width: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, lines = [], [], []

        def flush() -> pa.RecordBatch:
            matrix = np.zeros((len(ids), width), dtype="<i8")
            for i, line in enumerate(lines):
                matrix[i, : len(line)] = line
            if len(matrix) and width and np.abs(matrix, dtype=np.float64).max() < 2**31:
                matrix = matrix.astype("<i4")
            columns = [[marks[0]], [np.array(ids, dtype="<i8").tobytes()], [np.array(marks, dtype="<i8").tobytes()], [matrix.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int64()), *(pa.array(c, type=pa.binary()) for c in columns[1:])], names=["block", "ids", "marks", "matrix"])

        for batch in batches:
            vectors = batch.column("vector")
            flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.offsets)
            base = offsets[0]
            for i, (vec_id, mark) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("mark").to_pylist())):
                ids.append(vec_id)
                marks.append(mark)
                lines.append(flat[offsets[i] - base : offsets[i + 1] - base])
                if len(ids) == rows:
                    yield flush()
                    ids, marks, lines = [], [], []
        if ids:
            yield flush()

    return pack


_PACKED = "block long, ids binary, marks binary, matrix binary"


def _unpack(table: pa.Table, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for ids, marks, matrix in zip(*(table.column(c).to_pylist() for c in ("ids", "marks", "matrix"))):
        n = len(ids) // 8
        kind = "<i4" if len(matrix) == 4 * n * width else "<i8"
        out.append((np.frombuffer(ids, "<i8"), np.frombuffer(marks, "<i8"), np.frombuffer(matrix, kind).reshape(n, width).astype(np.int64)))
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b as int64, exact or saturated."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), dtype=np.int64)
    if float(np.abs(a, dtype=np.float64).max()) * float(np.abs(b, dtype=np.float64).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.astype(object)
    return np.clip(whole, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Tree:
    """Median splits of a sample; nodes are numbered as in a heap, leaves by their place."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(leaves - 1, 0).bit_length() if len(sample) else 0
        self.axis, self.at = np.zeros(2**self.depth, dtype=np.int64), np.full(2**self.depth, np.inf)
        parts = {1: np.arange(len(sample))}
        for node in range(1, 2**self.depth):
            own = parts.pop(node)
            if len(own) > 1:
                axis = int(sample[own].var(axis=0).argmax())
                self.axis[node], self.at[node] = axis, np.median(sample[own, axis])
            low = sample[own, self.axis[node]] <= self.at[node]
            parts[2 * node], parts[2 * node + 1] = own[low], own[~low]
        self.order = np.argsort(-sample.var(axis=0), kind="stable") if len(sample) else np.arange(sample.shape[1])

    def leaf(self, matrix: np.ndarray) -> np.ndarray:
        node, lines = np.ones(len(matrix), dtype=np.int64), np.arange(len(matrix))
        for _ in range(self.depth):
            node = 2 * node + (matrix[lines, self.axis[node]] > self.at[node])
        return node - 2**self.depth


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.asarray(vectors.offsets)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _placer(tree: Tree, width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.leaf(_matrix(batch.column("vector"), width))))

    return place


def best_of(queries: tuple, blocks: list[tuple], k: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(scores, ids, marks) of each query's best k, and how many (query, row) pairs were scored to the end.

    order: components by falling variance.
    """
    _, marks, matrix = queries
    n, width = matrix.shape
    order = np.arange(width) if order is None else order
    cut = -(-int(width * HEAD * 8) // 8) if width > 3 else width
    head, tail = order[:cut], order[cut:]
    scores, ids, own = np.full((n, k), _NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    high, low = (np.stack([f(m, axis=0) for _, _, m in blocks], axis=1) for f in (np.max, np.min))
    plus, minus = np.maximum(matrix, 0), np.minimum(matrix, 0)
    first, second = _product(plus, high), _product(minus, low)
    with np.errstate(over="ignore"):
        bounds = first + second
    bounds[((first > 0) & (second > 0) & (bounds < 0))] = np.iinfo(np.int64).max
    largest = lambda m: float(np.abs(m, dtype=np.float64).max()) if m.size else 0.0
    exact = largest(matrix) * max(largest(m) for _, _, m in blocks) * width < _EXACT
    norm = lambda m: np.sqrt((m[:, tail].astype(np.float64) ** 2).sum(axis=1))
    left, kept = norm(matrix), [norm(m) for _, _, m in blocks]
    visits = np.argsort(-bounds.astype(np.float64), axis=1, kind="stable")
    ended, begin, end = 0, 0, 1
    while begin < len(blocks):
        wave = visits[:, begin:end]
        begin, end = end, min(2 * end + 1, len(blocks))
        for b in np.unique(wave):
            who = np.flatnonzero((wave == b).any(axis=1) & (bounds[:, b] >= scores[:, k - 1]))
            if not len(who):
                continue
            block_ids, block_marks, block = blocks[b]
            kth = scores[who, k - 1][:, None]
            if exact and len(tail):
                found = _product(matrix[np.ix_(who, head)], block[:, head].T)
                q, r = np.nonzero(found + left[who][:, None] * kept[b][None, :] * (1 + 1e-9) + 1 >= kth)
                if 4 * len(q) > found.size:  # many are left: one product is cheaper than picking them
                    value = (found + _product(matrix[np.ix_(who, tail)], block[:, tail].T))[q, r]
                else:
                    value = found[q, r] + np.einsum("ij,ij->i", matrix[np.ix_(who, tail)][q], block[:, tail][r])
            else:
                found = _product(matrix[who], block.T)
                q, r = (x.ravel() for x in np.indices(found.shape))
                value = found.ravel()
            ended += len(q)
            good = (value >= kth[q, 0]) & (block_marks[r] != marks[who][q])
            q, r, value = q[good], r[good], value[good]
            begins = np.searchsorted(q, np.arange(len(who) + 1))
            for j in np.unique(q):
                part = slice(begins[j], begins[j + 1])
                i = who[j]
                s = np.concatenate([scores[i], value[part]])
                names, m = np.concatenate([ids[i], block_ids[r[part]]]), np.concatenate([own[i], block_marks[r[part]]])
                pick = np.lexsort((m, names, np.where(s == _NONE, np.iinfo(np.int64).max, -s)))[:k]
                scores[i], ids[i], own[i] = s[pick], names[pick], m[pick]
    return scores, ids, own, ended


def search(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (vec_id long, vector array<long>) with is_query, its best k other rows."""
    rows = rows.filter("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<long>").alias("vector"), is_query.alias("asks"))
    rows = cut(rows.withColumn("mark", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or 0
    some = rows.filter(F.pmod(F.xxhash64("vec_id", "mark"), F.lit(-(-n // SAMPLE_ROWS) or 1)) == 0).select("vector").limit(SAMPLE_ROWS).toArrow()
    sample = np.concatenate([np.zeros((0, width), np.int64), *(_matrix(c, width) for c in some.column("vector").chunks)])
    tree = Tree(sample.astype(np.float64), min(LEAVES, -(-n // BLOCK_ROWS)))
    placed = rows.mapInArrow(_placer(tree, width), "vec_id long, vector array<long>, asks boolean, mark long, leaf long")
    ranges = max(1, -(-n // (GROUP_BLOCKS * BLOCK_ROWS)))
    ranged = placed.repartitionByRange(ranges, "leaf", "vec_id", "mark").sortWithinPartitions("leaf", "vec_id", "mark")
    blocks = cut(ranged.select("vec_id", "mark", "vector").mapInArrow(_packer(BLOCK_ROWS, width), _PACKED))
    chunks = cut(rows.filter("asks").select("vec_id", "mark", "vector").mapInArrow(_packer(CHUNK_QUERIES, width), _PACKED))
    groups, n_chunks = max(1, -(-blocks.count() // GROUP_BLOCKS)), max(1, chunks.count())
    place = lambda count: F.pmod(F.xxhash64("block"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = chunks.withColumn("chunk", place(n_chunks)).withColumn("group", each(groups)).groupBy("chunk", "group")
    right = blocks.withColumn("group", place(groups)).withColumn("chunk", each(n_chunks)).groupBy("chunk", "group")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        parts = [[], [], [], [], []]
        index = _unpack(held, width)
        for queries in _unpack(asked, width) if index else []:
            scores, ids, own, _ = best_of(queries, index, k, tree.order)
            real = scores != _NONE
            for part, values in zip(parts, (np.broadcast_to(queries[1][:, None], real.shape), np.broadcast_to(queries[0][:, None], real.shape), ids, own, scores)):
                part.append(values[real])
        names = ["mark", "query_id", "vec_id", "other", "score"]
        return pa.table({c: np.concatenate(p) if p else np.zeros(0, np.int64) for c, p in zip(names, parts)})

    found = left.cogroup(right).applyInArrow(meet, "mark long, query_id long, vec_id long, other long, score long")
    order = Window.partitionBy("mark").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
