import random

import numpy as np
import pyarrow as pa

from quirework.llm import dedup, textkit

FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, percent):
    sets, ids = [], []
    for doc_id, text in rows:
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in (text or "")).translate(FOLD).split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        ids.append(doc_id)
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if ids[i] == ids[j] or (both and 100 * both >= percent * len(sets[i] | sets[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    return sorted((ids[i], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def rows_of(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_groups_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 150]))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, " \t\n "), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "x" * 5000 + " y" * 300)]
    got = dedup.near_duplicates(spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, component string"))
    assert rows_of(got) == brute(rows, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_a_group_with_many_untested_pairs(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(i % 9):
            words[rng.randrange(120)] = f"z{rng.randrange(5000)}"
        rows.append((i, " ".join(words)))
    assert rows_of(dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 85)


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    text = "a b c d e f g"
    got = dedup.near_duplicates(spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (None, "q r s t u v")], schema)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3)]


def test_words_are_hashed_alike():
    texts = ["The  the\tTHE x", None, "", "é É", "a" * 100 + " " + "A" * 100, "tail"]
    hashes, counts = textkit.words(pa.array(texts))
    assert counts.tolist() == [4, 0, 0, 2, 2, 1]
    assert hashes[0] == hashes[1] == hashes[2] and hashes[3] != hashes[0] and hashes[4] != hashes[5] and hashes[6] == hashes[7]
    sliced, _ = textkit.words(pa.array(texts).slice(3, 2))
    assert sliced.tolist() == hashes[4:8].tolist()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 60, 900):
        errors = []
        for _ in range(40):
            k = int(2 * n * 0.85 / 1.85 + 0.5)
            u = rng.integers(0, 2**63, 2 * n - k).astype(np.uint64)
            s = dedup.signatures(np.concatenate([u[:n], u[n - k :]]), np.array([n, n]))
            errors.append((s[0] == s[1]).mean() - k / (2 * n - k))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_rows_of_one_doc_id_are_one_vertex(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(0, a), (1, a), (1, b), (2, b), (7, c), (1, ""), (9, None)]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got) == [(0, 3, 0), (1, 0, 1), (1, 3, 0), (1, 3, 0), (2, 3, 0), (7, 3, 7), (9, 0, 9)]


def test_rows_without_doc_id_are_linked(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base, "x"])
    got = dedup.near_duplicates(spark.createDataFrame([(None, near), (4, " ".join(base)), (None, "p q r s t u"), (6, " ".join([*base, "y"]))], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=repr) == [(4, 4, True), (6, 4, False), (None, 4, False), (None, None, True)]


def test_blocks_of_large_buckets_meet(spark, monkeypatch):
    rng = random.Random(12)
    rows, n = [], 0
    base = [f"w{i}" for i in range(90)]
    for _ in range(5):
        core = list(base)
        for _ in range(4):
            core[rng.randrange(90)] = f"y{rng.randrange(9)}"
        for _ in range(40):
            words = list(core)
            for _ in range(rng.randrange(7)):
                words[rng.randrange(90)] = f"z{rng.randrange(900)}"
            rows.append((n, " ".join(words)))
            n += 1
    monkeypatch.setattr(dedup, "BLOCK_MEMBERS", 8)
    assert rows_of(dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)) == brute(rows, 80)


def test_common_elements_by_both_ways(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    u, v = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(u, v)]
    assert dedup.common(sets, u, v).tolist() == want and dedup.common(sets, u[:1], v[:1]).tolist() == want[:1]
