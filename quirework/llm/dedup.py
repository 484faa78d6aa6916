"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find by stars.

`near_duplicates` takes the distinct five-word shingles of whole texts. Its steps:

1. One pass over the texts makes for each row the number of shingles, a 128-bit fingerprint of its set and a
   SuperMinHash signature. All elements of a batch advance together, one permutation rank a round; a row stops
   as soon as every slot holds a smaller rank than the next one, which for long texts is after the first round.
2. Rows with equal sets collapse to one vertex, the smallest row mark, with partial aggregation, before anything else.
3. Banding: in each bucket (band, hash) the member that meets most others over all its buckets leads: the likeliest
   centre of its group. Every other member makes a pair with it, so rows stay linear in the size of a bucket. Pairs are
   verified on the full sets, built again from the whole texts.
4. Verified links are closed by alternating large-star and small-star steps. A bucket that then still holds several
   components has pairs that its leader has not tested. Its members fall in blocks of bounded number and size, each large
   component in blocks of its own, and blocks that can hold pairs of different components meet two by two: every such
   pair whose sizes allow the similarity is verified on the full sets, in cells that hold each text once.
5. Components are closed once more and handed back to all copies.

So every pair that shares a bucket is either verified, or in one component already, or too different in size. A pair is
lost only if it meets in no band: with 25 bands of five slots at the threshold of 0.85 with probability 4e-7, at 0.80 with
5e-5.

Defined results: a null or blank text has an empty set, no links and itself as its component. Rows with the same
doc_id and words are one vertex, whatever their texts. A row without doc_id is a vertex of its own and takes the smallest id of
its component, null if that has none; it is kept only in the latter case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import textkit
from quirework.llm.shared import cut, fix_splits, stored

SHINGLE_WORDS = 5
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
THRESHOLD_PERCENT = 85
#: About so many members of a bucket, and so many shingles of theirs, meet in one task on each side.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 200_000
_FACTORS = textkit.mix(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each row; number of them in each row)."""
    hashes, counts = textkit.words(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    if len(hashes) >= SHINGLE_WORDS:
        n = len(hashes) - SHINGLE_WORDS + 1
        windows = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE_WORDS):
            windows += hashes[k : k + n] * _FACTORS[k]
        windows = textkit.mix(windows)
    sets, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, c in enumerate(counts):
        if c >= SHINGLE_WORDS:
            part = np.unique(windows[begins[i] : ends[i] - SHINGLE_WORDS + 1])
        elif c:
            part = textkit.mix((hashes[begins[i] : ends[i]] * _FACTORS[:c]).sum(keepdims=True) + np.uint64(c))
        else:
            continue
        sets.append(part)
        sizes[i] = len(part)
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), sizes


def signatures(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each row's elements: rank in the upper, random fraction in the lower half of each slot.

    Element e takes at rank j the slot p_j(e) of its own permutation with the value j + r_j(e); a slot keeps its
    smallest value. Rows whose slots are all below the next rank have ended.
    """
    out = np.full((len(sizes), slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    perm = None
    for rank in range(slots):
        if not len(elements):
            break
        z = textkit.mix(elements + np.uint64((rank + 1) * _STEP % 2**64))
        pick = rank + (((z >> np.uint64(32)) * np.uint64(slots - rank)) >> np.uint64(32)).astype(np.int64)
        if rank == 0:
            slot = pick
        else:
            lines = np.arange(len(elements))
            slot = perm[lines, pick].astype(np.int64)
            perm[lines, pick] = perm[:, rank]
        value = (np.uint64(rank) << np.uint64(32)) | (z & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, row * slots + slot, value)
        open_rows = out.max(axis=1) >= (np.uint64(rank + 1) << np.uint64(32))
        stay = open_rows[row]
        elements, row = elements[stay], row[stay]
        if rank == 0:
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            first = slot[stay]
            lines = np.arange(len(elements))
            perm[lines, first] = perm[:, 0]
        elif not stay.all():
            perm = perm[stay]
    return out


_FEATURES = "n_shingles long, fp_a long, fp_b long, bands array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns of the rows (text, …) and the features of their texts."""
    powers = textkit.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        texts, others = batch.column("text"), [c for c in batch.schema.names if c != "text"]
        for a, b in textkit.slices(texts):
            sets, sizes = shingle_sets(texts.slice(a, b - a))
            sig = signatures(sets, sizes)
            bands = textkit.mix((sig.reshape(b - a, BANDS, ROWS) * powers).sum(axis=2)).view(np.int64)
            ends = np.cumsum(sizes)
            prints = [xxhash.xxh3_128_digest(sets[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
            halves = np.frombuffer(b"".join(prints), dtype=np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands.reshape(-1)))
            columns = [batch.column(c).slice(a, b - a) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists], names=[*others, "n_shingles", "fp_a", "fp_b", "bands"])


def _verifier(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a"), batch.column("text_b")
            linked = np.zeros(batch.num_rows, dtype=bool)
            for start, stop in textkit.slices(left, right):
                x, nx = shingle_sets(left.slice(start, stop - start))
                y, ny = shingle_sets(right.slice(start, stop - start))
                ex, ey = np.cumsum(nx), np.cumsum(ny)
                for i in range(stop - start):
                    both = len(np.intersect1d(x[ex[i] - nx[i] : ex[i]], y[ey[i] - ny[i] : ey[i]], assume_unique=True))
                    linked[start + i] = 100 * both >= percent * (nx[i] + ny[i] - both) and both > 0
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=schema)

    return verify


_CELLS = pa.schema([("cell", pa.int64()), ("rep", pa.int64()), ("pairs", pa.binary())])


def _comparer(percent: int):
    """Pairs of different components and of sizes that allow the similarity, of one bucket's blocks `i` and `j`.

    They leave as one packed row for the cell (the two blocks) and a row for each document in them, so a text is sent to a
    cell once, however many of its pairs there are.
    """

    def compare(group: pa.Table) -> pa.Table:
        band, bucket, i, j = (group.column(c)[0].as_py() for c in ("band", "hash", "i", "j"))
        block, rep, component, size = (np.asarray(group.column(c)) for c in ("block", "rep", "component", "n_shingles"))
        bands = np.asarray(group.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for start in range(0, len(rows), 64):
            x = rows[start : start + 64]
            fit = (component[x, None] != component[columns]) & (100 * np.minimum(size[x, None], size[columns]) >= percent * np.maximum(size[x, None], size[columns]))
            if i == j:
                fit &= rep[x, None] < rep[columns]
            p, q = np.nonzero(fit)
            u, v = x[p], columns[q]
            new = ~(bands[u, :band] == bands[v, :band]).any(axis=1)  # a bucket of an earlier band has emitted the others
            out.append(np.stack([rep[u[new]], rep[v[new]]]))
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        if not pairs.size:
            return _CELLS.empty_table()
        cell = np.int64(xxhash.xxh3_64_intdigest(repr((band, bucket, i, j))) >> 1)
        docs = np.unique(pairs)
        return pa.table({"cell": np.full(len(docs) + 1, cell), "rep": pa.array([*docs.tolist(), None], type=pa.int64()), "pairs": pa.array([None] * len(docs) + [pairs.astype("<i8").tobytes()], type=pa.binary())})

    return compare


def common(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many elements each pair (u, v) of sets has in common: by products of a 0/1 matrix where pairs are many, else one by one."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # an element of one set only is in no intersection
    keep = shared[number]
    column, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    width = int(shared.sum())
    if len(sets) ** 2 * width * 1e-10 > (sizes[u] + sizes[v]).sum() * 2e-8:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(u, v)])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for start in range(0, width, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(sets), min(4096, width - start)), dtype=np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        total += part @ part.T
    return total[u, v].astype(np.int64)


def _cell_verifier(percent: int):
    def verify(packed: pa.Table, docs: pa.Table) -> pa.Table:
        """Links of a cell's pairs, without those between documents that earlier links connect."""
        ids, sets = [], []
        for texts, reps in zip(docs.column("text").chunks, docs.column("rep").chunks):
            for start, stop in textkit.slices(texts):
                flat, sizes = shingle_sets(texts.slice(start, stop - start))
                sets += np.split(flat, np.cumsum(sizes)[:-1])
            ids += reps.to_pylist()
        place = np.argsort(ids)
        ranked = np.array(ids)[place]
        pairs = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in packed.column("pairs").to_pylist()], axis=1)
        u, v = (place[np.searchsorted(ranked, x)] for x in pairs)
        root = list(range(len(sets)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        sizes = np.array([len(s) for s in sets])
        linked = []
        both = common(sets, u, v)
        for k in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[u] + sizes[v] - both))):
            a, b = find(u[k]), find(v[k])
            if a != b:
                root[a] = b
                linked.append(k)
        return pa.table({"a": pairs[0, linked], "b": pairs[1, linked]})

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    rows = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return cut(rows.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(percent), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id in the links (a, b) reaches, by alternating star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = cut(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def _untested(members: DataFrame, reach: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket, by cell.

    A bucket's blocks are numbered: first those of its large components, one after the other, then those that its
    other members share. A member meets all blocks but those of its own large component.
    """
    bucket = ["band", "hash"]
    owned = members.join(reach.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sized = owned.groupBy(*bucket, "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks_of = lambda n, s: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    large = F.col("n") >= BLOCK_MEMBERS
    # a bucket of k members has at most k / BLOCK_MEMBERS large components
    seen = F.array_sort(F.collect_list(F.when(large, F.struct("component", blocks_of(F.col("n"), F.col("s")).alias("blocks")))))
    others = blocks_of(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~large, F.col("s"))), F.lit(0)))
    plans = sized.groupBy(*bucket).agg(F.sum("n").alias("k"), F.count("*").alias("kinds"), seen.alias("large"), others.alias("others")).filter("k > 2 and kinds > 1")
    taken = F.aggregate("large", F.lit(0), lambda s, x: s + x["blocks"])
    held = owned.join(plans.withColumn("taken", taken).drop("k", "kinds"), bucket)
    own = F.get(F.filter("large", lambda x: x["component"] == F.col("component")), F.lit(0))
    begin = F.aggregate(F.filter("large", lambda x: x["component"] < F.col("component")), F.lit(0), lambda s, x: s + x["blocks"])
    held = held.withColumn("begin", F.when(own.isNotNull(), begin).otherwise(F.col("taken"))).withColumn("width", F.coalesce(own["blocks"], "others"))
    held = held.withColumn("block", (F.col("begin") + F.pmod(F.xxhash64("rep"), F.col("width"))).cast("int")).withColumn("mine", own.isNotNull())
    meets = F.filter(F.sequence(F.lit(0), F.col("taken") + F.col("others") - 1), lambda b: ~(F.col("mine") & (b >= F.col("begin")) & (b < F.col("begin") + F.col("width"))))
    meetings = held.select(*bucket, "rep", "component", "n_shingles", "bands", "block", F.explode(meets).alias("other")).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return meetings.drop("other").groupBy(*bucket, "i", "j").applyInArrow(_comparer(percent), "cell long, rep long, pairs binary")


def grouped(docs: DataFrame, percent: int = THRESHOLD_PERCENT, stable: bool = False, unite_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, group (null for an empty set), low (the group's smallest doc_id) and `carry` of each row of `docs`.

    unite_ids: rows with the same doc_id are linked. The texts are read twice and must come in the same partitions and order:
    stable says that `docs` is the plain scan of a table, which does; else it is stored first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in carry))
    fix_splits(docs.sparkSession)
    rows = (rows if stable else stored(rows, "texts")).withColumn("mark", F.monotonically_increasing_id())
    rows = rows.withColumn("check", F.xxhash64("text"))
    others = rows.drop("text").schema
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    feats = cut(rows.mapInArrow(_features, f"{declared}, {_FEATURES}"))
    exact = feats.filter("n_shingles > 0").groupBy("fp_a", "fp_b").agg(F.min("mark").alias("rep"), F.min("doc_id").alias("low"))
    exact = cut(exact)
    reps = cut(feats.withColumnRenamed("mark", "rep").join(exact.select("rep"), "rep", "left_semi").select("rep", "n_shingles", "bands", "check"))
    placed = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = placed.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(placed.join(shared, ["band", "hash"]))
    # who meets most others is the likeliest centre of its group
    degrees = met.groupBy("rep").agg(F.sum("n").alias("degree"))
    met = met.select("band", "hash", "rep").join(degrees, "rep")
    leaders = met.groupBy("band", "hash").agg((-F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).minus).alias("a"))
    members = cut(met.join(leaders, ["band", "hash"]).join(reps.drop("check"), "rep"))
    wanted = degrees.select("rep").join(reps.select("rep", F.col("check").alias("_check")), "rep")
    same = F.when(F.col("check") == F.col("_check"), F.col("text")).otherwise(F.raise_error(F.lit("the texts have changed between two readings")))
    texts = stored(rows.select(F.col("mark").alias("rep"), "text", "check").join(wanted, "rep").select("rep", same.alias("text")), "texts")

    tested = cut(members.filter("rep <> a").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct())
    links = _verified(tested, texts, percent)
    reach = cut(components(links))
    rest = cut(_untested(members, reach, percent))
    needed = rest.filter("rep is not null").select("cell", "rep").join(texts, "rep").select(F.col("cell").alias("at"), "rep", "text")
    more = cut(rest.filter("pairs is not null").select("cell", "pairs").groupBy("cell").cogroup(needed.groupBy("at")).applyInArrow(_cell_verifier(percent), "a long, b long"))
    if unite_ids:
        more = more.unionByName(_of_one_id(feats, exact))
    if not more.isEmpty():
        reach = cut(components(links.unionByName(more)))

    classes = exact.join(reach.withColumnRenamed("id", "rep"), "rep", "left").select("fp_a", "fp_b", F.coalesce("component", "rep").alias("group"), "low")
    lows = classes.groupBy("group").agg(F.min("low").alias("low"))
    classes = classes.drop("low").join(lows, "group")
    full = F.when(F.col("n_shingles") > 0, F.col("fp_a")).alias("fp_a")
    return feats.select("doc_id", "n_shingles", full, "fp_b", *carry).join(classes, ["fp_a", "fp_b"], "left").select("doc_id", "n_shingles", "group", "low", *carry)


def _of_one_id(feats: DataFrame, exact: DataFrame) -> DataFrame:
    """Links (a, b) between the vertices of rows that have one doc_id and different sets."""
    known = feats.filter("doc_id is not null and n_shingles > 0").select("doc_id", "fp_a", "fp_b")
    several = known.groupBy("doc_id").agg(F.min(F.struct("fp_a", "fp_b")).alias("x"), F.max(F.struct("fp_a", "fp_b")).alias("y")).filter("x <> y").select("doc_id")
    held = known.join(several, "doc_id", "left_semi").distinct().join(exact.select("fp_a", "fp_b", "rep"), ["fp_a", "fp_b"])
    first = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return cut(held.join(first, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")))


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, stable: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `docs` (doc_id long, text string; others are ignored)."""
    found = grouped(docs, percent, stable, unite_ids=True)
    component = F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
