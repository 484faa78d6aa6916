"""Dynamic programmes over short sequences, for Arrow-batched workers. Plain Python and numpy; no Spark here."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Fixed values: (seen, truth) glyph pairs that recognizers confuse, and the cost of each.
CONFUSIONS = {
    ("rn", "m"): 0.2, ("m", "rn"): 0.3, ("cl", "d"): 0.3, ("d", "cl"): 0.4, ("vv", "w"): 0.2, ("w", "vv"): 0.3,
    ("li", "h"): 0.4, ("h", "li"): 0.4, ("ri", "n"): 0.4, ("in", "m"): 0.4, ("ni", "m"): 0.4, ("iii", "m"): 0.4,
    ("1", "l"): 0.2, ("l", "1"): 0.3, ("1", "i"): 0.3, ("i", "1"): 0.4, ("I", "l"): 0.1, ("l", "I"): 0.1,
    ("0", "o"): 0.2, ("o", "0"): 0.3, ("5", "s"): 0.3, ("s", "5"): 0.4, ("8", "B"): 0.3, ("6", "b"): 0.4,
    ("e", "c"): 0.4, ("c", "e"): 0.4, ("a", "o"): 0.5, ("o", "a"): 0.5, ("u", "v"): 0.4, ("v", "u"): 0.4,
    ("n", "u"): 0.5, ("u", "n"): 0.5, ("h", "b"): 0.5, ("b", "h"): 0.5, ("i", "l"): 0.3, ("l", "i"): 0.3,
    ("t", "f"): 0.5, ("f", "t"): 0.5, ("i", "j"): 0.5, ("j", "i"): 0.5, ("y", "v"): 0.5, ("g", "q"): 0.5,
    ("!", "l"): 0.3, ("|", "l"): 0.2, ("|", "I"): 0.2, ("ii", "u"): 0.4, ("fi", "h"): 0.5, ("tl", "d"): 0.5,
}
EXTRA_GLYPH = 1.4
CASE_COST = 0.6


def levenshtein_table(a: Sequence, b: Sequence) -> np.ndarray:
    """Edit distances of all prefixes."""
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    left, right = np.array([codes[x] for x in a], dtype=np.int64), np.array([codes[x] for x in b], dtype=np.int64)
    steps = np.arange(len(b) + 1)
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int64)
    table[0] = steps
    for i in range(1, len(a) + 1):
        above = table[i - 1]
        row = np.concatenate([[i], np.minimum(above[1:] + 1, above[:-1] + (right != left[i - 1]))])
        table[i] = np.minimum.accumulate(row - steps) + steps  # insertions run from left to right
    return table


@lru_cache(maxsize=1 << 15)
def _places(word: str) -> dict[str, int]:
    """For each character the set of its places, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


@lru_cache(maxsize=1 << 17)
def folded_gap(a: str, b: str) -> float:
    """Distance of two different lower-cased words, over the longer length.

    A column of the table goes through at once: two bit sets hold where it rises and falls (Myers 1999).
    """
    if not a or not b:
        return 1.0
    return bit_distance(_places(a), len(a), b) / max(len(a), len(b))


def bit_distance(places: dict, size: int, b: Sequence) -> int:
    """Distance of b to a sequence that isn't empty, of which the size and each member's places are given, as bits."""
    every, last = (1 << size) - 1, 1 << size - 1
    rises, falls, distance = every, 0, size
    for c in b:
        same = places.get(c, 0)
        still = ((((same & rises) + rises) ^ rises) | same) & every
        up, down = falls | (every & ~(still | rises)), rises & still
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        held = same | falls
        rises, falls = down | (every & ~(held | up)), up & held
    return distance


#: Pairs, members and diagonals of all pairs of one table of distances(); diagonals on either side of those that a pair must cross.
_TABLE_PAIRS, _TABLE_SIZE, _TABLE_CELLS, _SLACK = 512, 1 << 19, 1 << 14, 4


def distances(first: Sequence[Sequence], second: Sequence[Sequence]) -> np.ndarray:
    """Levenshtein distances of pairs of strings, or of pairs of lists of words.

    The cost grows with the square of the distance, not with that of the lengths; from a distance on at which bit sets are
    cheaper a pair goes through those.
    """
    out = np.zeros(len(first), dtype=np.int64)
    open_ = []
    for k, (a, b) in enumerate(zip(first, second)):
        if not len(a) or not len(b):
            out[k] = len(a) + len(b)
        elif a != b:
            open_.append((k, a, b) if len(a) <= len(b) else (k, b, a))
    slack = _SLACK
    while open_:
        open_.sort(key=lambda p: (len(p[1]).bit_length(), len(p[2]) - len(p[1])))
        start, late = 0, []
        while start < len(open_):
            end, size = start, 0
            while end < len(open_) and (end == start or end - start < _TABLE_PAIRS and size <= _TABLE_SIZE and (end - start) * (len(open_[end][2]) - len(open_[end][1]) + 2 * slack) < _TABLE_CELLS):
                size += len(open_[end][1]) + len(open_[end][2])
                end += 1
            part = open_[start:end]
            found = _furthest([p[1] for p in part], [p[2] for p in part], slack)
            out[[p[0] for p in part]] = found
            late += [p for p, d in zip(part, found) if d < 0]
            start = end
        open_, slack = late, 4 * slack
    return out


def _numbered(sequences: list[Sequence]) -> np.ndarray:
    """The members of all sequences as numbers from 2 on, equal ones alike, in the narrowest type."""
    if isinstance(sequences[0], str):
        codes = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        present = np.zeros(int(codes.max()) + 1, dtype=bool)
        present[codes] = True
        numbers = np.cumsum(present) + 1
        kinds, codes = int(numbers[-1]), numbers[codes]
    else:
        known: dict = {}
        codes = np.array([known.setdefault(w, len(known) + 2) for s in sequences for w in s])
        kinds = len(known) + 1
    return codes.astype(np.uint8 if kinds < 256 else np.uint16 if kinds < 65536 else np.uint32)


def _packed(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """At each place the next 8 bytes of its sequence and of the ends after it, and where each sequence begins."""
    room = 8 // codes.itemsize
    begins = np.cumsum(sizes + room) - sizes - room
    held = np.full(int((sizes + room).sum()) + room, end, dtype=codes.dtype)
    held[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)) * room, sizes)] = codes
    return np.ascontiguousarray(np.ndarray((len(held) - room + 1,), "<u8", held.tobytes(), 0, (codes.itemsize,))), begins


def _furthest(first: list[Sequence], second: list[Sequence], slack: int) -> np.ndarray:
    """Distances of pairs, the shorter first, neither empty: for 0, 1, ... edits how far each diagonal gets, all pairs at once (Ukkonen 1985).

    A path that leaves the diagonals from -slack to the difference g of the lengths + slack costs g + 2 * slack + 2 or more: pairs without
    a cheaper one get -1. The sequences end in numbers of their own, so no run of equal members passes an end.
    """
    n, m = np.array([len(a) for a in first]), np.array([len(b) for b in second])
    goal = m - n
    codes = _numbered([*first, *second])
    unit, room = 3 + codes.itemsize // 2, 8 // codes.itemsize
    left, a0 = _packed(codes[: n.sum()], n, 0)
    right, b0 = _packed(codes[n.sum() :], m, 1)
    limit = np.sqrt(n * (20 + m / 128)).astype(np.int64)
    out = np.full(len(n), -1)
    rows, edits, top = np.arange(len(n)), 0, int(goal.max()) + slack
    reach = np.full((len(n), slack + top + 3), -1 << 40)  # column k + slack + 1 is diagonal k
    reach[:, slack + 1] = -1
    ahead = np.arange(8) * room
    while True:
        low, high = -min(edits, slack), min(edits, top)
        diagonal = np.arange(low, high + 1)
        c0, c1 = low + slack + 1, high + slack + 2
        x = np.maximum(reach[:, c0:c1], reach[:, c0 + 1 : c1 + 1])
        x += 1
        np.maximum(x, reach[:, c0 - 1 : c1 - 1], out=x)
        np.minimum(x, np.minimum(n[rows, None], m[rows, None] - diagonal), out=x)
        ia = (x + a0[rows, None]).ravel()
        ib = (x + (b0[rows, None] + diagonal)).ravel()
        x = x.ravel()
        differ = left.take(ia, mode="clip") ^ right.take(ib, mode="clip")
        run = (np.bitwise_count((differ & -differ) - np.uint64(1)) >> unit).astype(np.int64)
        x += run
        at = np.flatnonzero(run == room)
        ia, ib = ia[at] + room, ib[at] + room
        while len(at):  # long runs, eight steps at once
            differ = left.take(ia[:, None] + ahead, mode="clip") ^ right.take(ib[:, None] + ahead, mode="clip")
            first_ = (differ != 0).argmax(axis=1)
            differ = differ[np.arange(len(at)), first_]
            run = (np.bitwise_count((differ & -differ) - np.uint64(1)) >> unit).astype(np.int64) + first_ * room
            whole = differ == 0
            run[whole] = 8 * room
            x[at] += run
            at, ia, ib = at[whole], ia[whole] + 8 * room, ib[whole] + 8 * room
        reach[:, c0:c1] = x.reshape(len(rows), -1)
        done = reach[np.arange(len(rows)), goal[rows] + slack + 1] >= n[rows]
        out[rows[done]] = edits
        late = ~done & (limit[rows] <= edits)
        for k in rows[late]:
            out[k] = _by_bits(first[k], second[k])
        done |= late | (edits > goal[rows] + 2 * slack)
        if done.any():
            rows, reach = rows[~done], reach[~done]
            if not len(rows):
                return out
            top = int(goal[rows].max()) + slack
        edits += 1


_MARKS = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
_DROPPED = bytes([*range(9), *range(14, 28), 127])
_PLAIN = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--"}


def joined_cores(text: str) -> str:
    """The lower-case cores of a text's words in plain ASCII, joined by blanks."""
    if not text.isascii():
        for mark, plain in _PLAIN.items():
            text = text.replace(mark, plain)
        text = " ".join(text.split()).encode("ascii", "ignore").decode()
    plain = text.encode().translate(None, _DROPPED).decode().lower()
    return " ".join([w.strip(_MARKS) for w in plain.split()])


def shared_words(a: Sequence[str], b: Sequence[str]) -> int:
    """How many words two lists have in common as multisets."""
    left, shared = Counter(a), 0
    for w in b:
        n = left.get(w, 0)
        if n:
            left[w] = n - 1
            shared += 1
    return shared


def bow_f1(reference: str, reading: str) -> float:
    """F1 of the word multisets of two texts."""
    r, h = reference.split(), reading.split()
    if not r:
        return 0.0 if h else 1.0
    return 2 * (len(r) if r == h else shared_words(r, h)) / (len(r) + len(h))


def n_deletes(word: str) -> int:
    """How many different strings a word and up to two deletions leave.

    A prefix leaves what the shorter prefix leaves, with its last character or without, less what an equal character one or two places
    before it has left already.
    """
    one = one_before = two = 0
    a = b = ""  # the two characters before
    for k, c in enumerate(word):
        fresh = 1 + one - (k > 0 and c == b)
        two += one - (one_before if k > 0 and c == b else k > 1 and c == a)
        one_before, one, a, b = one, fresh, b, c
    return 1 + one + two


def _by_bits(a: Sequence, b: Sequence) -> int:
    rows: dict = {}
    for i, c in enumerate(a):
        rows.setdefault(c, []).append(i)
    places = {}
    for c, found in rows.items():
        bits = np.zeros(len(a) // 8 + 1, dtype=np.uint8)
        np.bitwise_or.at(bits, np.array(found) >> 3, (1 << (np.array(found) & 7)).astype(np.uint8))
        places[c] = int.from_bytes(bits.tobytes(), "little")
    return bit_distance(places, len(a), b)


def align(ref: Sequence[str], hyp: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """The cheapest word alignment; among equals substitution goes before deletion and deletion before insertion, seen from the end."""
    known: dict[str, int] = {}
    codes = [np.array([known.setdefault(w.lower(), len(known)) for w in x], dtype=np.int64) for x in (ref, hyp)]
    ri, hi = alignments(codes[:1], codes[1:], list(known))[0]
    return [(None if i < 0 else i, None if j < 0 else j) for i, j in zip(ri.tolist(), hi.tolist())]


#: Cells of one table of alignments(), pairs of one, and how often one is filled by bounds before every gap of its band is asked for.
_BAND_CELLS, _BAND_PAIRS, _BAND_ROUNDS, _TIE = 1 << 20, 2048, 6, 1e-9


class _Open:
    """A pair whose alignment is not settled: rows from the first to the last difference, the band's slack, gaps known by (row, column)."""

    __slots__ = ("at", "a", "b", "begin", "end", "last", "low", "width", "slack", "rounds", "gaps", "steps")

    def __init__(self, at: int, a: np.ndarray, b: np.ndarray, begin: int, end: int, last: int):
        self.at, self.a, self.b, self.begin, self.end, self.last = at, a, b, begin, end, last
        self.gaps: dict[tuple[int, int], float] = {}
        self.rounds, self.steps = 0, None
        self.widen(1)

    def widen(self, slack: int) -> None:
        self.slack, self.low = slack, min(0, len(self.b) - len(self.a)) - slack
        self.width = abs(len(self.b) - len(self.a)) + 2 * slack + 1


def alignments(first: Sequence[np.ndarray], second: Sequence[np.ndarray], vocabulary: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pairs of lists of word numbers their alignments as two arrays of places, -1 for what one side lacks.

    A step to equal words is never dearer than the others, so the ends of two lists pair up while they are equal, and after an equal
    beginning each prefix costs its difference in length. In between many pairs go through their bands at once. A path that leaves
    the diagonals from 0 to the difference g of the lengths by more than s costs g + 2 * s + 2 or more, so a cheaper one in the band is the
    cheapest. Gaps start as bounds (characters that one word has and the other lacks); the gaps on the path found are asked for, and
    pairs in which one was higher are filled again. A path all of whose gaps are true is the one that true gaps everywhere lead to.
    """
    out: list = [None] * len(first)
    asked: dict[int, float] = {}
    kinds = len(vocabulary)

    def gap(x: int, y: int) -> float:
        key = x * kinds + y
        if key not in asked:
            asked[key] = folded_gap(vocabulary[x], vocabulary[y])
        return asked[key]

    open_ = []
    for at, (a, b) in enumerate(zip(first, second)):
        n, m = len(a), len(b)
        short = min(n, m)
        if n == m:
            differ = np.flatnonzero(a != b)
            if not len(differ) or len(differ) < 32 and sum(gap(*p) for p in zip(a[differ].tolist(), b[differ].tolist())) < 2 - _TIE:
                out[at] = (np.arange(n), np.arange(n))  # any other path misses and inserts a word
                continue
            begin, same = int(differ[0]), n - 1 - int(differ[-1])
        else:
            ahead, behind = a[:short] != b[:short], a[n - short :][::-1] != b[m - short :][::-1]
            begin = int(ahead.argmax()) if ahead.any() else short
            same = int(behind.argmax()) if behind.any() else short
        pair = _Open(at, a, b, min(begin, n - same), n - same, m - same)
        if pair.begin == pair.end or pair.last == 0:
            pair.steps = np.zeros((0, 2), dtype=np.int64)
            out[at] = _whole(pair, pair.end, pair.last)
        else:
            open_.append(pair)
    if not open_:
        return out
    marks = np.array([_marks(w) for w in vocabulary] + [0], dtype=np.uint64)
    sizes = np.array([len(w) for w in vocabulary] + [0], dtype=np.int32)
    while open_:
        open_.sort(key=lambda p: (p.rounds >= _BAND_ROUNDS, p.width.bit_length(), p.end - p.begin))
        late, start = [], 0
        while start < len(open_):
            full = open_[start].rounds >= _BAND_ROUNDS
            end, width = start, 0
            while end < len(open_) and end - start < _BAND_PAIRS and (open_[end].rounds >= _BAND_ROUNDS) == full:
                width = max(width, open_[end].width)
                if end > start and (end - start + 1) * width * (open_[end].end - open_[end].begin) > _BAND_CELLS:
                    break
                end += 1
            for pair, (i, j), low, high in _filled(open_[start:end], marks, sizes, gap, full):
                g = abs(len(pair.b) - len(pair.a))
                if high - low <= 1e-12 and low < g + 2 * pair.slack + 2 - _TIE:
                    out[pair.at] = _whole(pair, i, j)
                    continue
                if high >= g + 2 * pair.slack + 2 - _TIE:  # no wider than the path found asks for
                    pair.widen(max(pair.slack, min(int((high - g) / 2 + _TIE), 3 * pair.slack + 3)))
                pair.rounds += high - low > 1e-12
                late.append(pair)
            start = end
        open_ = late
    return out


def _marks(word: str) -> int:
    """A bit for the first and one for the second of each kind of character."""
    one = two = 0
    for c in word:
        bit = 1 << (ord(c) & 31)
        two |= one & bit
        one |= bit
    return one | two << 32


def _whole(pair: _Open, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of an alignment of which the steps between (i, j) and the equal ends are known: what comes before has equal beginnings."""
    a, b, head = pair.a, pair.b, []
    while i != j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            head.append((i, j))
        elif i > j:
            i -= 1
            head.append((i, -1))
        else:
            j -= 1
            head.append((-1, j))
    same = len(a) - pair.end
    parts = [(np.arange(i), np.arange(j))]
    if head:
        parts.append(tuple(np.array(head[::-1]).T))
    parts += [(pair.steps[:, 0], pair.steps[:, 1]), (pair.end + np.arange(same), pair.last + np.arange(same))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _filled(pairs: list[_Open], marks: np.ndarray, sizes: np.ndarray, gap, full: bool) -> list:
    """(pair, where its path enters the equal beginning, cost by the gaps in the table, cost of the path by true gaps) of each pair; sets steps.

    Arrays are (row, diagonal, pair). Tables beyond _BAND_CELLS keep the first row of each block of rows and fill the blocks again on
    the way back.
    """
    count, width = len(pairs), max(p.width for p in pairs)
    begin, low = np.array([p.begin for p in pairs]), np.array([p.low for p in pairs])
    height = np.array([p.end - p.begin for p in pairs])
    rows, none = int(height.max()), len(sizes) - 1
    left = np.full((rows, count), none)
    right = np.full((rows + width, count), none)
    for c, p in enumerate(pairs):
        left[: height[c], c] = p.a[p.begin : p.end]
        t = p.begin + p.low  # row r and diagonal k meet word t + r + k of b
        x, y = max(t, 0), min(t + rows + width, p.last)
        if y > x:
            right[x - t : y - t, c] = p.b[x:y]
    lack = np.where(right == none, np.inf, 0.0)
    their_marks, their_sizes = marks[right], sizes[right]

    def band(x: np.ndarray, r0: int, r1: int) -> np.ndarray:
        return np.lib.stride_tricks.as_strided(x[r0:], (r1 - r0, width, count), (x.strides[0], x.strides[0], x.strides[1]), writeable=False)

    def changes(r0: int, r1: int) -> np.ndarray:
        own, size = marks[left[r0:r1]][:, None], sizes[left[r0:r1]][:, None]
        theirs, other = band(their_marks, r0, r1), band(their_sizes, r0, r1)
        edits = np.maximum(np.bitwise_count(own & ~theirs), np.bitwise_count(theirs & ~own))
        edits = np.maximum(np.maximum(edits, np.abs(size - other)), 1)
        change = edits / np.maximum(np.maximum(size, other), 1)
        codes = band(right, r0, r1)
        own = left[r0:r1][:, None]
        change[own == codes] = 0.0
        if full:
            asked = np.nonzero((own != codes) & (codes != none) & (own != none))
            both = np.stack([np.broadcast_to(own, codes.shape)[asked], codes[asked]], axis=1)
            kinds, back = np.unique(both, axis=0, return_inverse=True)
            change[asked] = np.array([gap(x, y) for x, y in kinds.tolist()])[back.ravel()]
        change += band(lack, r0, r1)
        for c, p in enumerate(pairs):
            for (i, j), known in p.gaps.items():
                r, k = i - p.begin, j - i - p.low
                if r0 <= r < r1 and 0 <= k < width:
                    change[r - r0, k, c] = known
        return change

    steps = np.arange(width, dtype=np.float64)[:, None]

    def costs(first: np.ndarray, change: np.ndarray) -> np.ndarray:
        cost = np.full((len(change) + 1, width + 1, count), np.inf)
        cost[0, :width] = first
        for r in range(len(change)):
            best = np.minimum(cost[r, :width] + change[r], cost[r, 1:] + 1)
            best -= steps
            np.minimum.accumulate(best, axis=0, out=best)
            np.add(best, steps, out=cost[r + 1, :width])
        return cost

    j = begin + low + np.arange(width)[:, None]
    start = np.where((j >= 0) & (j <= [p.last for p in pairs]), np.abs(j - begin), np.inf)
    size = max(1, _BAND_CELLS // (width * count)) if rows * width * count > 2 * _BAND_CELLS else rows
    blocks = [(r, min(r + size, rows)) for r in range(0, rows, size)]
    firsts = [start]
    for r0, r1 in blocks:
        change = changes(r0, r1)
        cost = costs(firsts[-1], change)
        firsts.append(cost[-1, :width].copy())
    row, column = height.copy(), np.array([p.last - p.end for p in pairs]) - low
    found, total = [], np.zeros(count)
    for number in range(len(blocks) - 1, -1, -1):
        r0, r1 = blocks[number]
        if number < len(blocks) - 1:
            change = changes(r0, r1)
            cost = costs(firsts[number], change)
        ends = np.flatnonzero((height > r0) & (height <= r1))
        total[ends] = cost[height[ends] - r0, column[ends], ends]
        active = np.flatnonzero(row > r0)
        while len(active):
            r, k = row[active] - r0, column[active]
            limit, above = cost[r, k, active] + _TIE, cost[r - 1, k, active]
            changed = change[r - 1, k, active]
            slant = above + changed
            slant = (slant <= limit) & (slant >= limit - 2 * _TIE)
            down = ~slant & (cost[r - 1, k + 1, active] + 1 <= limit)
            kind = np.where(slant, 0, np.where(down, 1, 2))
            found.append((active, r + r0, k, kind, changed))
            row[active] -= kind != 2
            column[active] += (kind == 1).astype(np.int64) - (kind == 2)
            active = active[row[active] > r0]
    which, r, k, kind, changed = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(which, kind="stable")[::-1]
    which, r, k, kind, changed = which[order], r[order], k[order], kind[order], changed[order]
    i = r + begin[which] - 1
    j = i + k + low[which]
    bounds = np.searchsorted(-which, [-c for c in range(count)], side="left"), np.searchsorted(-which, [-c for c in range(count)], side="right")
    places = np.stack([np.where(kind == 2, -1, i), np.where(kind == 1, -1, j)], axis=1)
    high = total.copy()
    for x in np.flatnonzero((kind == 0) & (changed > 0)):
        p = pairs[which[x]]
        true = gap(int(p.a[i[x]]), int(p.b[j[x]]))
        if true > changed[x] + 1e-12:
            p.gaps[int(i[x]), int(j[x])] = true
            high[which[x]] += true - changed[x]
    out = []
    for c, p in enumerate(pairs):
        p.steps = places[bounds[0][c] : bounds[1][c]]
        out.append((p, (p.begin, p.begin + int(low[c] + column[c])), total[c], high[c]))
    return out


def _band(a: list[str], b: list[str], half: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Costs of the prefixes within the band, and the cost of changing a row's word into each word of its band: one pair, every gap asked for.

    With _path() the plain form of alignments(), which tests compare it with.
    """
    low, high = 0, min(len(b), half)
    costs, changes = [np.arange(high + 1, dtype=np.float64)], [np.zeros(0)]
    for i, word in enumerate(a, 1):
        before = low
        low, high = max(0, i - half), min(len(b), i + half)
        change = np.array([0.0 if word == w else folded_gap(word, w) for w in b[max(low - 1, 0) : high]])
        above = np.full(high - before + 2, np.inf)  # the last row from one place left of the band to its end
        above[1 : len(costs[-1]) + 1] = costs[-1]
        above = above[low - before :]
        down = above[1:] + 1
        slant = np.full(len(down), np.inf)
        slant[len(slant) - len(change) :] = above[len(above) - 1 - len(change) : -1] + change
        steps = np.arange(len(down))
        best = np.minimum(down, slant)
        costs.append(np.minimum.accumulate(best - steps) + steps)
        changes.append(change)
    return costs, changes


def _path(costs: list[np.ndarray], changes: list[np.ndarray], end: int, half: int) -> list[tuple[int | None, int | None]]:
    cost = lambda i, j: costs[i][j - max(0, i - half)] if 0 <= j - max(0, i - half) < len(costs[i]) else np.inf
    i, j, back = len(costs) - 1, end, []
    while i or j:
        now = cost(i, j) - 1e-9
        if i and j and cost(i - 1, j - 1) + changes[i][j - 1 - max(0, max(0, i - half) - 1)] >= now and cost(i - 1, j - 1) + changes[i][j - 1 - max(0, max(0, i - half) - 1)] <= now + 2e-9:
            i, j = i - 1, j - 1
            back.append((i, j))
        elif i and cost(i - 1, j) + 1 <= now + 2e-9:
            i -= 1
            back.append((i, None))
        else:
            j -= 1
            back.append((None, j))
    return back[::-1]


def edit_blocks(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Changed ranges (a0, a1, b0, b1) of a cheapest edit script; what lies between is equal."""
    table = levenshtein_table(a, b)
    i, j, same = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1] and table[i, j] == table[i - 1, j - 1]:
            i, j = i - 1, j - 1
            same.append((i, j))
        elif table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    out, x, y = [], 0, 0
    for p, q in [*same[::-1], (len(a), len(b))]:
        if p > x or q > y:
            out.append((x, p, y, q))
        x, y = p + 1, q + 1
    return out


def ballots(word: str, reading: str) -> list[tuple[int, int, str]]:
    """What a reading says of a word, as (place, kind, text): kind 1 is the character at the place, kind 0 what stands before it."""
    at, out = 0, []
    for a0, a1, b0, b1 in [*edit_blocks(word, reading), (len(word), len(word), 0, 0)]:
        out += [(k, 1, word[k]) for k in range(at, a0)]
        even = a1 - a0 == b1 - b0
        out += [(k, 1, reading[b0 + k - a0] if even else "") for k in range(a0, a1)]
        if b1 > b0 and not even:
            out.append((a0, 0, reading[b0:b1]))
        at = a1
    return out


def confusion_costs(seen: Sequence[str], truth: Sequence[str]) -> np.ndarray:
    """Weighted edit costs of reading each `truth` as its `seen`; pairs of the same two lengths go through one table together.

    Extra glyphs cost EXTRA_GLYPH, but 1 while nothing of the truth has been read.
    """
    out = np.zeros(len(seen))
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(seen, truth)):
        shapes.setdefault((len(a), len(b)), []).append(k)
    for (n, m), rows in shapes.items():
        for start in range(0, len(rows), 1 << 14):
            part = rows[start : start + (1 << 14)]
            out[part] = _cost_table([seen[k] for k in part], [truth[k] for k in part], n, m)
    return out


def _cost_table(seen: list[str], truth: list[str], n: int, m: int) -> np.ndarray:
    letters = {c: i for i, c in enumerate(sorted({c for w in (*seen, *truth) for c in w}))}
    small: dict[str, int] = {}
    fold = np.array([small.setdefault(c.lower(), len(small)) for c in letters], dtype=np.int64)
    a = np.array([[letters[c] for c in w] for w in seen], dtype=np.int64).reshape(len(seen), n)
    b = np.array([[letters[c] for c in w] for w in truth], dtype=np.int64).reshape(len(truth), m)

    def begins(codes: np.ndarray, glyphs: str) -> np.ndarray | None:
        """Where the glyphs begin in each word."""
        if any(c not in letters for c in glyphs) or codes.shape[1] < len(glyphs):
            return None
        width = codes.shape[1] - len(glyphs) + 1
        return np.logical_and.reduce([codes[:, k : k + width] == letters[c] for k, c in enumerate(glyphs)])

    known = [(len(x), len(y), begins(a, x), begins(b, y), cost) for (x, y), cost in CONFUSIONS.items()]
    known = [k for k in known if k[2] is not None and k[3] is not None and k[2].any() and k[3].any()]
    costs = np.full((n + 1, m + 1, len(seen)), np.inf)
    costs[0] = np.arange(m + 1, dtype=np.float64)[:, None]
    costs[:, 0] = np.arange(n + 1, dtype=np.float64)[:, None]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            change = np.where(a[:, i - 1] == b[:, j - 1], 0.0, np.where(fold[a[:, i - 1]] == fold[b[:, j - 1]], CASE_COST, 1.0))
            best = np.minimum(costs[i - 1, j] + EXTRA_GLYPH, costs[i, j - 1] + 1.0)
            for p, q, x, y, cost in known:
                if p <= i and q <= j:
                    here = x[:, i - p] & y[:, j - q]
                    if p == q == 1:  # case is cheaper to tell than a confusion
                        change = np.where(here & (change == 1.0), cost, change)
                    else:
                        best = np.where(here, np.minimum(best, costs[i - p, j - q] + cost), best)
            costs[i, j] = np.minimum(best, costs[i - 1, j - 1] + change)
    return costs[n, m]


def confusion_cost(seen: str, truth: str) -> float:
    return float(confusion_costs([seen], [truth])[0])
