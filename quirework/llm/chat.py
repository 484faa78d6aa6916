"""Chat formatting with a grammar round trip: whatever is rendered is parsed again before it leaves.

Grammar: conversation = turn*; a turn is an opening marker, a blank, the content, a blank and the closing marker of its
role. A marker after one or more backslashes is content and loses one backslash when read. A turn is first rendered
as it stands, then reparsed; where the parser does not give back exactly (role, text), the control strings that conflict
get one backslash more, until it does.

`format_chat` keeps memory bounded for any conversation: rows are sorted by conversation and turn within partitions and
go through one at a time; a conversation leaves as parts of about `PART_CHARS` characters. `read_chat` parses parts.

Defined results: turns are ordered by turn, role, text with nulls first; a null role or text is empty; rows with a null
conv_id form one conversation; an empty table gives no rows; an empty text is an empty turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The opening and closing marker of each role, and those of any other role and its name.
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAME, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
MARKERS = [m for pair in ROLES.values() for m in pair] + [NAME, TEXT, END]
PART_CHARS = 1 << 18
LOSS_ROLE = "assistant"

_MARKER = re.compile(r"(\\*)(" + "|".join(map(re.escape, MARKERS)) + ")")
_OPENS = {opening: (role, closing) for role, (opening, closing) in ROLES.items()}
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.large_string()), ("loss_spans", pa.list_(pa.list_(pa.int64())))])


class Conflict(ValueError):
    """The text is not a sentence of the grammar."""


def escape(text: str) -> str:
    return _MARKER.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _MARKER.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's rendered form and where its content begins; escapes more until the parser agrees."""
    for shield in (str, escape):
        if role in ROLES:
            opening, closing = ROLES[role]
            head = f"{opening} "
        else:
            closing, head = END, f"{NAME} {shield(role)} {TEXT} "
        out = f"{head}{shield(text)} {closing}"
        try:
            if [(r, t) for r, t, _, _ in parse(out)] == [(role, text)]:
                return out, len(head)
        except Conflict:
            pass
    raise Conflict(f"a turn of role {role!r} cannot be rendered")


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin and end of the content) of each turn; one scan over the bare markers, no backtracking."""
    bare = ((m.start(2), m[2]) for m in _MARKER.finditer(formatted) if not m[1])

    def content(begin: int, closing: str) -> tuple[str, int, int]:
        at, marker = next(bare, (len(formatted), ""))
        if marker != closing or at <= begin or formatted[begin] != " " or formatted[at - 1] != " " or at - begin < 2:
            raise Conflict(f"{closing} expected at {at}")
        return formatted[begin + 1 : at - 1], begin + 1, at - 1

    place = 0
    for at, marker in bare:
        if at != place:
            raise Conflict(f"text outside of turns at {place}")
        if marker in _OPENS:
            role, closing = _OPENS[marker]
            begin = at + len(marker)
        elif marker == NAME:
            name, _, end = content(at + len(NAME), TEXT)
            role, closing, begin = unescape(name), END, end + 1 + len(TEXT)
            if role in ROLES:
                raise Conflict(f"{role} has markers of its own")
        else:
            raise Conflict(f"{marker} at {at} opens no turn")
        text, start, stop = content(begin, closing)
        yield role, unescape(text), start, stop
        place = stop + 1 + len(closing)
    if place != len(formatted):
        raise Conflict(f"text outside of turns at {place}")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, part, pieces, spans, size = object(), 0, [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv_id": now, "part": part, "formatted": "".join(pieces), "loss_spans": spans}], schema=_FORMATTED)

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if pieces and (conv != now or size >= PART_CHARS):
                out.append(flush())
                part = part + 1 if conv == now else 0
                pieces, spans, size = [], [], 0
            now = conv
            piece, head = render_turn(role or "", text or "")
            if role == LOSS_ROLE:
                closing = ROLES[LOSS_ROLE][1]
                spans.append([size + head, size + len(piece) - len(closing) - 1])
            pieces.append(piece)
            size += len(piece)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if pieces:
        yield flush()


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss_spans ([begin, end) in the part) of rows (conv_id, turn, role, text), in order within partitions."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_parts, "conv_id long, part long, formatted string, loss_spans array<array<long>>")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None

    def row() -> dict:
        turns, n_turns, loss, loss_chars, chars = state
        return {"conv_id": now, "n_turns": n_turns, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
            if state is None or conv != now:
                if state:
                    rows.append(row())
                now, state = conv, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text, _, _ in parse(formatted):
                state[0].update(f"{role}\n{text}\n".encode())
                state[1] += 1
            for begin, end in spans:
                learned = unescape(formatted[begin:end])
                state[2].update(learned.encode())
                state[3] += len(learned)
            state[4] += len(formatted)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGESTS)
    if state:
        yield pa.RecordBatch.from_pylist([row()], schema=_DIGESTS)


def read_chat(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """Counts and digests of the turns parsed from parts. ordered: the parts still lie as format_chat leaves them."""
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
