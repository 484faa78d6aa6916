"""The pipeline against a brute-force version that shares no code with it but constants."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import sentencepiece

from quirework.llm import mixing, pieces
from quirework.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key_a int, copies int, `group` string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def js(p, r):
    a, b = sum(p), sum(r)
    if not a or not b:
        return None
    total = 0.0
    for x, y in zip(p, r):
        x, y = x / a, y / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(total / 2, 0))


def features(text, lang):
    t = text or ""
    words = WORD.findall(t)
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    covered = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(3)}
    kinds = Counter()
    for c in t:
        kinds["space" if c in " \t\n\v\f\r" else "symbol" if c in "#*$%&|<>" else "upper" if "A" <= c <= "Z" else "wide" if c > "\x7f" else "digit" if "0" <= c <= "9" else "punct" if 33 <= ord(c) < 127 and not c.isalnum() else "lower"] += 1
    common = q.COMMON_WORDS.get(lang)
    runs = re.findall(r"[^\x00-\x60\x7B-\x7F]+", t.translate(FOLD)) if common else []
    count = Counter(runs)
    listed = [count[w] for w in common or []]
    return {
        "n": len(words), "failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
        "chars": [kinds[k] for k in ("lower", "upper", "wide", "digit", "punct", "symbol", "space")], "words": [len(runs) - sum(listed), *listed],
    }


def kept_by_quality(rows):
    found = [features(r[1], r[2]) for r in rows]

    def references(use):
        out = {}
        for r, f in zip(rows, found):
            if r[2] in q.COMMON_WORDS and not f["failed"] and use(r, f):
                a, b = out.setdefault(r[2], ([0] * 7, [0] * 21))
                a[:] = [x + y for x, y in zip(a, f["chars"])]
                b[:] = [x + y for x, y in zip(b, f["words"])]
        return out

    rough = references(lambda r, f: True)
    fine = references(lambda r, f: js(f["chars"], rough[r[2]][0]) <= q.ROUGH_CHAR_DISTANCE and js(f["words"], rough[r[2]][1]) <= q.ROUGH_WORD_DISTANCE)
    out = []
    for r, f in zip(rows, found):
        bad = f["failed"]
        if r[2] in fine:
            c, w = js(f["chars"], fine[r[2]][0]), js(f["words"], fine[r[2]][1])
            limit = lambda x: x[0] + x[1] / math.sqrt(f["n"])  # noqa: B023, E731
            bad = bad or (f["n"] >= q.MIN_WORDS_CHARS and c > limit(q.CHAR_LIMIT)) or (f["n"] >= q.MIN_WORDS_COMMON and w is not None and w > limit(q.WORD_LIMIT)) or (f["n"] >= q.MIN_WORDS_BOTH and c > q.BOTH_LIMITS[0] and w is not None and w > q.BOTH_LIMITS[1])
        if not bad:
            out.append(r)
    return out


def groups_of(rows):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) if s else ("blank", i) for i, s in enumerate(sets)]


def mixed(rows):
    """Copies of each row: targets by raising the level, chances by capping one size after the other, then the ordered prefix."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for r, n in zip(rows, size) if r[3] == s) for s in names}
    capped = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / max(sum(weight[s] for s in names if s not in capped), 1)
        more = {s for s in names if s not in capped and level * weight[s] > 3 * total[s]}
        if not more:
            break
        capped |= more
    copies = {}
    for s in names:
        target = 3 * total[s] if s in capped else level * weight[s]
        whole = math.floor(target / total[s])
        rest = target - whole * total[s]
        own = [i for i, r in enumerate(rows) if r[3] == s]
        sure = set()
        while True:
            c = (rest - sum(size[i] for i in sure)) / sum(size[i] ** 2 for i in own if i not in sure)
            over = [i for i in own if i not in sure and c * size[i] >= 1]
            if not over:
                break
            largest = max(size[i] for i in over)
            sure |= {i for i in over if size[i] == largest}
        rank = {}
        for i in own:
            digest = hashlib.md5(f"{mixing.SEED}\n{'' if rows[i][0] is None else rows[i][0]}\n{rows[i][1] or ''}".encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / 16**13
            rank[i] = -1.0 if i in sure else u / (1 - u) * (1 - c * size[i]) / (c * size[i])
        taken = 0
        for value in sorted(set(rank.values())):
            tied = [i for i in own if rank[i] == value]
            words = sum(size[i] for i in tied)
            chosen = rest > 0 and (value < 0 or taken + words / 2 < rest)
            taken += words
            for i in tied:
                copies[i] = whole + chosen
    return copies


def corpus():
    rng = random.Random(6)
    letters = lambda k: "".join(rng.choice("etaoinshrdlu") for _ in range(k))

    def prose(lang, n):
        return " ".join(rng.choice(q.COMMON_WORDS[lang]) if rng.random() < 0.45 else letters(rng.randint(2, 9)).capitalize() if rng.random() < 0.1 else letters(rng.randint(2, 9)) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    rows = [(i, prose(lang, rng.randint(60, 400)), lang, rng.choice(["a", "b", "a", None, "é"]), i, 1, 2, "g") for i, lang in enumerate(["en"] * 60 + ["de"] * 25)]
    salad = [(200 + i, " ".join(letters(5) for _ in range(260)), "en", "a", 0, 1, 2, "g") for i in range(5)]
    wrong = [(210 + i, prose("de", 260), "en", "b", 0, 1, 2, "g") for i in range(5)]
    odd = [(220, " ".join(f"{letters(4)}&&& %%%" for _ in range(120)), "en", "a", 0, 1, 2, "g"), (221, None, None, None, None, None, None, None), (222, "", "en", "a", 0, 1, 2, "g"), (223, "short text", "fr", "b", 0, 1, 2, "g")]
    near = [(300 + i, " ".join([*rows[i][1].split(" ")[:-1], f"other{i}"]), rows[i][2], "b", 7, 1, 2, "g") for i in range(12)]
    same_id = [(5, prose("en", 200), "en", "a", 0, 1, 2, "g"), (None, prose("en", 220), "en", None, 0, 1, 2, "g"), (None, rows[3][1], "en", "a", 0, 1, 2, "g")]
    unknown = [(400, prose("en", 150), "xx", "é", 0, 1, 2, "g"), (401, prose("en", 9000), "en", "b", 0, 1, 2, "g")]
    return rows + salad + wrong + odd + near + same_id + unknown + [rows[8]] * 3, salad + wrong + odd


def test_run_equals_brute_force(spark, tmp_path):
    rows, rejected = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

    want = kept_by_quality(rows)
    assert not {r[0] for r in rejected} & {r[0] for r in want} and len(want) > 90
    stage = cp.quality(spark, docs, "")
    assert stage.columns == docs.columns and plain(stage) == sorted(want, key=repr)
    stage.write.parquet(str(tmp_path / "one"))

    best = {}
    for r, g in zip(want, groups_of(want)):
        key = (r[0] is None, r[0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, r)
    want = [r for _, r in best.values()]
    assert sum(r[0] == 5 for r in want) == 2 and not {r[0] for r in want} & set(range(300, 312))
    stage = cp.dedup(spark, spark.read.parquet(str(tmp_path / "one")), "")
    assert stage.columns == docs.columns and plain(stage) == sorted(want, key=repr)
    stage.write.parquet(str(tmp_path / "two"))

    copies = mixed(want)
    want = [r for i, r in enumerate(want) for _ in range(copies[i])]
    stage = cp.mixing(spark, spark.read.parquet(str(tmp_path / "two")), "")
    assert stage.columns == docs.columns and plain(stage) == sorted(want, key=repr)

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    ids = {r[1]: [1, *library.encode(r[1]), 2] for r in want}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    last = sorted(((r[0], len(ids[r[1]]), digest(b"".join(i.to_bytes(4, "little") for i in ids[r[1]])), digest(library.decode(ids[r[1]]).encode())) for r in want), key=repr)
    got = cp.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert plain(got) == last


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
