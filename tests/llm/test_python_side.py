"""Top-k, archives, language model and token ids against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import sentencepiece

from quirework.llm import lm, pieces, q_lm, q_topk, topk, warc

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_topk_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.3, 1.0]) for _ in range(6)]) for i in range(260)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [1.0]), (1250, []), (100, [9.0] * 6)]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").write.parquet(str(tmp_path / "embeddings.parquet"))
    valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, x) in enumerate(valid):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), v) for k, (v, y) in enumerate(valid) if k != at)[:5]
            want += [(q, rank + 1, v, -s) for rank, (s, v) in enumerate(scored)]
    got = q_topk.op5_block_pruning(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_blocks_are_pruned_without_loss():
    rng = np.random.default_rng(0)
    blocks = []
    for b in range(12):
        m = rng.integers(-20, 20, (50, 8)) + (200 if b == 3 else 0)
        blocks.append((np.arange(b * 50, b * 50 + 50), np.arange(b * 50, b * 50 + 50), m))
    queries = (np.array([-1, -2]), np.array([-1, -2]), rng.integers(1, 20, (2, 8)))
    scores, ids, _, scored = topk.best_of(queries, blocks, 5)
    everything = np.concatenate([m for _, _, m in blocks])
    for q in range(2):
        s = everything @ queries[2][q]
        order = np.lexsort((np.arange(len(s)), -s))[:5]
        assert scores[q].tolist() == s[order].tolist() and ids[q].tolist() == order.tolist()
    assert scored < 2 * len(everything) / 2


def test_own_table_is_pruned():
    """The query's own vectors: no block bound holds for directions without clusters, but most rows are left before the end."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x = np.floor(256 * np.stack(table.column("embedding").to_pylist()).astype(np.float64)).astype(np.int64)
    tree = topk.Tree(x.astype(np.float64), 8)
    rows = np.lexsort((np.arange(len(x)), tree.leaf(x)))
    blocks = [(rows[i : i + 256], rows[i : i + 256], x[rows[i : i + 256]]) for i in range(0, len(x), 256)]
    asked = np.arange(0, len(x), 50)
    scores, ids, _, scored = topk.best_of((asked, asked, x[asked]), blocks, 5, tree.order)
    for at, q in enumerate(asked):
        s = x @ x[q]
        s[q] = -(10**12)
        assert ids[at].tolist() == np.lexsort((np.arange(len(x)), -s))[:5].tolist()
    assert scored < 0.5 * len(asked) * len(x), scored / len(asked) / len(x)


def test_clusters_are_pruned_by_blocks():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (32, 16))
    x = np.concatenate([c + rng.integers(-9, 10, (100, 16)) for c in centres])[rng.permutation(3200)]
    tree = topk.Tree(x.astype(np.float64), 32)
    rows = np.lexsort((np.arange(len(x)), tree.leaf(x)))
    blocks = [(rows[i : i + 50], rows[i : i + 50], x[rows[i : i + 50]]) for i in range(0, len(x), 50)]
    _, ids, _, scored = topk.best_of((np.arange(40), np.arange(40), x[:40]), blocks, 5, tree.order)
    for q in range(40):
        s = x @ x[q]
        s[q] = -(10**12)
        assert ids[q].tolist() == np.lexsort((np.arange(len(x)), -s))[:5].tolist()
    assert scored < 0.1 * 40 * len(x)


def test_large_products_are_exact():
    a = np.array([[2**40, 3]])
    assert topk._product(a, np.array([[2**20], [1]]))[0, 0] == 2**60 + 3


def test_loser_tree():
    rng = random.Random(1)
    for k in range(7):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert [runs[r][i] for r, i in warc.LoserTree(runs)] == sorted(x for run in runs for x in run)


def test_archives(spark, tmp_path):
    rows = [(1, "http://B.com/x", "<p>hi</p>\r\n\r\nWARC/1.1"), (7, "https://www.a.com:443/", "same"), (3, None, "same"), (None, "http://a.com/\r\nX: y", "same"), (5, "http://a.com", None), (9, "é://", ""), (9, "z", ""), (4, "http://[bad", "x" * 100_000), (None, "u", "lonely"), (None, "v", "lonely")]
    for at, least in (("zero", 0), ("many", 1000)):
        warc.write(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, first int"), str(tmp_path / at), least)
        index = warc.merged(warc.read(spark, str(tmp_path / at))).collect()
        want = []
        for page, _, html in rows:
            payload = (html or "").encode()
            same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
            first = max(same) if same and len(payload) >= least else None
            revisit = first is not None and first != page
            want.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
        got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        ordered = [(r["url_key"], r["captured"]) for r in sorted(index, key=lambda r: (r["range"], r["rank"]))]
        assert ordered == sorted(ordered)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.merged(warc.read(spark, str(tmp_path / "none"))).collect() == []


def test_archives_are_bounded_and_seekable(spark, tmp_path):
    rng = random.Random(4)
    # a hot url, and payloads beyond the size at which a member's last byte is no longer 0
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", "".join(chr(97 + rng.randrange(26)) for _ in range(3000))) for i in range(300)]
    rows += [(1000, "http://big.org/", "ab" * 9_000_000), (1001, None, "é" * 9_000_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    path = str(tmp_path / "archives")
    warc.write(pages, path, archive_bytes=40_000)
    index = warc.read(spark, path).collect()
    assert sorted(r["page_id"] for r in index) == sorted(r[0] for r in rows)
    html = {r[0]: r[2] for r in rows}
    files = {r["run"] for r in index}
    assert len(files) > 10
    for r in rng.sample(index, 40) + [r for r in index if r["page_id"] >= 1000]:
        with open(r["run"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            text = gzip.decompress(f.read(r["length"]))
        assert text.startswith(b"WARC/1.1") and text.endswith(html[r["page_id"]].encode() + b"\r\n\r\n")
    for run in rng.sample(sorted(files), 5):
        with open(run.removeprefix("file:"), "rb") as f:
            whole = f.read()
        assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == sum(r["run"] == run for r in index)
        assert len(whole) < 60_000 or any(r["page_id"] >= 1000 for r in index if r["run"] == run)


def test_url_keys():
    assert warc.url_key("HTTPS://www.Example.org:443/a?b=1#c") == "org,example)/a?b=1" and warc.url_key(None) == ""
    assert warc.page_of(warc.record_id(-7)) == -7


def brute_scores(rows):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    count = Counter()
    for t, h in zip(tokens, held):
        if not h:
            padded = ["<s>", *t]
            count.update((w,) for w in t)
            count.update(zip(padded, t))
            count.update(zip(padded, t, t[1:]))
            count[("<s>",)] += 1
    types = {k[0] for k in count if len(k) == 1 and k != ("<s>",)}
    n = sum(count[(w,)] for w in types)
    base = lambda w: (count[(w,)] + 0.1) / (n + 0.1 * (len(types) + 1))

    def p(h, w):
        if not h:
            return base(w)
        prior = lm.PRIOR[len(h) + 1]
        return (count[(*h, w)] + prior * p(h[1:], w)) / (count[h] + prior)

    want = []
    for (i, _), t, h in zip(rows, tokens, held):
        padded = ["<s>", *t]
        s = sum(math.log10(p(tuple(padded[max(0, k - 1) : k + 1]), w)) for k, w in enumerate(t))
        want.append((i or -1, h, len(t), sum(count[(w,)] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), s))
    every = [*types, "never seen"]
    for h in [("<s>",), *list(count)[:40]]:
        if h[-1] is not None and len(h) < 3:
            assert abs(sum(p(h, w) for w in every) - 1) < 1e-9
    return sorted(want)


def scored(df, **more):
    rows = lm.score(df, **more).collect()
    return sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows)


def alike(got, want):
    return len(got) == len(want) and all(g[:5] == w[:5] and abs(g[5] - w[5]) < 2e-6 and abs(g[6] - w[6]) < 2e-6 for g, w in zip(got, want))


def test_scores(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "The", "of", "cat", "sat", f"r{rng.randrange(60)}"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "zzz the"), (7, rows[7][1]), (102, "the cat " * 3000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    assert alike(scored(df), brute_scores(rows))
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = q_lm.op9_automaton(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, round(r["score"], 4)) for r in got) == sorted((w[0], round(w[6], 4)) for w in brute_scores(rows))
    held = [(i, t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0]
    assert alike(scored(spark.createDataFrame(held, "doc_id long, text string")), brute_scores(held))


def test_scores_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefg") + rng.choice("xyz") for _ in range(rng.randrange(200)))) for i in range(120)] + [(500, "hot text of ours")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_scores(rows)
    assert alike(scored(df), want)
    assert alike(scored(df, block_bytes=700, bucket_bytes=900), want)
    assert alike(scored(df.repartition(5), block_bytes=50, bucket_bytes=10**9), want)


def test_token_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(2)
    texts = ["", None, " ", "  a  b\n c ", "a\x00b<s>▁x", "▁▁ x  ", "é日本​𝄞", "x" * 20_000, " " * 99 + "a" + " " * 37, "ab " * 4000, "<0x41></s>"]
    texts += ["".join(rng.choice(" ▁ab\nthe日\x00é.<>0") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    whole = {r["doc_id"]: r for r in pieces.encode(df).collect()}
    digests = {r["doc_id"]: r for r in pieces.encode_digests(df).collect()}
    coder = pieces.Encoder(pieces.model_path())
    for i, t in enumerate(texts):
        ids = [library.bos_id(), *library.encode(t or ""), library.eos_id()]
        assert whole[i]["ids"] == ids and whole[i]["decoded"] == library.decode(ids)
        assert whole[i]["n_borrowed"] == digests[i]["n_borrowed"] == 0
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and digests[i]["n_tokens"] == len(ids)
        for segment in pieces._SEGMENT.findall("▁" + (t or "").replace(" ", "▁")):
            if segment[-1] != "▁":
                assert coder.merge(segment) == np.array(library.encode(segment[1:].replace("▁", " ")), "<u4").tobytes()
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_broken_agenda_shows():
    coder = pieces.Encoder(pieces.model_path())
    right = coder.encode(["the text of the book"])[0]
    coder = pieces.Encoder(pieces.model_path())
    coder.merge = lambda segment: coder.of_byte[65]
    assert coder.encode(["the text of the book", None]) == ([*right, coder.head + coder.tail], [5, 0])
