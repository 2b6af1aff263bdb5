"""Chat formatting in budgeted windows.

A conversation becomes one text per window. Prefix sums of its turns' tokens choose spans of whole
turns that fit the budget; every window begins with the system turn, repeats a limited history from
before its span, and then holds its own turns. The loss mask covers the assistant's texts among the
own turns, so a target that a later window repeats is masked out there and each is learned once.

Turns are marked by control strings. The same strings inside a text are escaped by one more tilde
behind their angle bracket, which unescape() takes out again, so no text can forge a turn.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of them for repeated history at most, and turns of that history at most.
BUDGET, HISTORY, HISTORY_TURNS = 1024, 256, 4
#: Windows that a task holds before it hands them on.
HELD = 500

_OPEN, _OPENED = re.compile(r"<(~*)\|"), re.compile(r"<~(~*)\|")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _OPEN.sub(r"<~\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: its line ends and backslashes are written as two characters."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def estimated_tokens(text: str) -> int:
    """Words and signs, a long word counting once more for every six characters."""
    return sum(1 + len(x) // 6 for x in _TOKEN.findall(text))


@dataclasses.dataclass
class Window:
    number: int
    text: str
    first: int  # the first own turn
    turns: int  # own turns
    repeated: int  # turns before them, the system turn included
    mask: list[tuple[int, int]]  # code points of text that the loss counts


def plan(sizes: Iterable[tuple[str, int]], budget: int, history: int, history_turns: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated turn, first own turn, end) of each window. sizes: role and tokens of each turn.
    A turn that is larger than the budget has a window of its own and is never cut."""
    sums: list[int] = [0]  # tokens of all turns so far, as far back as a history can reach
    back = 0  # the turn that sums[0] stands before
    system = first = begin = 0
    at = -1
    for at, (role, n) in enumerate(sizes):
        if at == 0 and role == "system":
            system = n
        sums.append(sums[-1] + n)
        used = system * (begin > 0) + sums[-1] - sums[begin - back]
        if at > first and used > budget:
            yield begin, first, at
            first = begin = at
            # As much history as its own limits and the budget beside this turn allow.
            room = min(history, budget - system - n)
            while begin > max(0, first - history_turns, back) and sums[first - back] - sums[begin - 1 - back] <= room:
                begin -= 1
            if cut := max(0, first - history_turns - back):
                sums, back = sums[cut:], back + cut
    if at >= 0:
        yield begin, first, at + 1


def windows(turns: Iterable[tuple[str, str]], *, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, tokens: Callable[[str], int] = estimated_tokens) -> Iterator[Window]:
    """The windows of one conversation of (role, text) turns, as they are read: no more turns are
    held than a window and its history have."""
    ahead, here = itertools.tee(turns)
    held: list[str] = []
    owns: list[tuple[int, int] | None] = []  # where an assistant's text is in its turn
    base = at = 0
    system = ""
    for number, (begin, first, end) in enumerate(plan(((r, tokens(r) + tokens(t) + 3) for r, t in ahead), budget, history, history_turns)):
        while at < end:
            role, text = next(here)
            head = f"{START}{escape_role(role)}\n"
            body = escape(text)
            held.append(f"{head}{body}{END}\n")
            owns.append((len(head), len(head) + len(body)) if role == "assistant" else None)
            if at == 0 and role == "system":
                system = held[0]
            at += 1
        keep_system = bool(system) and begin > 0
        parts = [system] * keep_system + held[begin - base : end - base]
        size = sum(map(len, parts[: keep_system + first - begin]))
        mask = []
        for part, own in zip(held[first - base : end - base], owns[first - base : end - base], strict=True):
            if own:
                mask.append((size + own[0], size + own[1]))
            size += len(part)
        yield Window(number, "".join(parts), first, end - first, keep_system + first - begin, mask)
        drop = max(0, end - history_turns - base)
        held, owns, base = held[drop:], owns[drop:], base + drop


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window's text."""
    out = []
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line, end = text.index("\n", at), text.index(END, at)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def format_windows(conversations: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, window, text, first_turn, n_turns, n_repeated, mask) for each window of each
    conversation; mask is an array of (start, end) code points.

    Rows are taken by turn; equal turns by role and then text, repeated rows each; a null turn comes
    first. Null roles and texts count as empty; rows without conv_id are one conversation. Other
    columns play no part. A conversation streams through its task sorted, a few turns at a time, so
    its length needs no memory; an empty table gives an empty result.
    """
    bounded_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select("conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "window", "text", "first_turn", "n_turns", "n_repeated", "mask"]
            types = [arrow_kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        first = next(batches, None)
        if first is None:
            return
        arrow_kind = first.schema.field(0).type
        for conv, turns in itertools.groupby(_grouped(itertools.chain([first], batches)), key=lambda r: r[0]):
            for w in windows(((r[2], r[3]) for r in turns), budget=budget, history=history, history_turns=history_turns):
                out.append((conv, w.number, w.text, w.first, w.turns, w.repeated, [{"start": a, "end": b} for a, b in w.mask]))
                size += len(w.text)
                if len(out) >= HELD or size > 8 << 20:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, window bigint, text string, first_turn bigint, n_turns bigint, n_repeated bigint, mask array<struct<start:bigint,end:bigint>>")


def digests(formatted: DataFrame, *, dealt: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) read back
    from format_windows()' texts and masks alone: own turns in order, and all text under the mask,
    unescaped. dealt: formatted comes from format_windows() as it is, whose tasks give a conversation's
    windows one after the other, so they are read where they were made. No windows give no rows."""
    kind = formatted.schema["conv_id"].dataType
    rows = formatted.select("conv_id", "window", "text", "n_repeated", "mask")
    rows = rows if dealt else rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        first = next(batches, None)
        if first is None:
            return
        found = []
        for conv, group in itertools.groupby(_grouped(itertools.chain([first], batches)), key=lambda r: r[0]):
            all_turns, loss = sha256(), sha256()
            n = loss_chars = chars = count = 0
            for _, _, text, repeated, mask in group:
                count += 1
                chars += len(text)
                for role, own in read_back(text)[repeated:]:
                    n += 1
                    all_turns.update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                for span in mask:
                    own = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
            found.append((conv, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, count))
        if found:
            types = [first.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
