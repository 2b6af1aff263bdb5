"""Secret scans with one combined deterministic automaton.

The rules' patterns are parsed here, joined into one nondeterministic automaton, made deterministic
by subset construction over byte classes and minimised; what runs is an array of transitions. Read
from a text's last byte to its first, the combined automaton of the reversed patterns tells at each
byte which rules have a match that begins there: one pass for all rules. From a rule's leftmost
begin, its own automaton finds the longest end, and the search goes on behind it.
"""

from __future__ import annotations

import array
import dataclasses
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.common import bounded_batches, with_text


@dataclasses.dataclass(frozen=True)
class Rule:
    """A match is head, then tail. It counts if tail, or the whole, has the least length in bytes.
    any_case: letters of head stand for both cases."""

    kind: str
    head: str
    tail: str
    least_tail: int = 0
    least: int = 0
    any_case: bool = False


# The base rules, in the order in which kinds are listed, and further rules for
# publicly documented token formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_tail=12, any_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", least=18),
    Rule("hex", r"", r"[0-9a-f]+", least=16),
)
MORE = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", least_tail=36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", least_tail=10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", least=40),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY", r"-----"),
)

# -- patterns to trees: ("set", bytes) | ("seq", [..]) | ("alt", [..]) | ("rep", node, least, most) --


class _Parser:
    """Literals, escapes, classes, groups, alternatives and the repeats ? * + {m} {m,} {m,n}."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.at, self.any_case = pattern, 0, any_case

    def whole(self):
        node = self.alternatives()
        if self.at < len(self.p):
            raise ValueError(f"unmatched ) at {self.at} in {self.p!r}")
        return node

    def alternatives(self):
        found = [self.sequence()]
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        found = []
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            found.append(self.repeated(self.atom()))
        return ("seq", found)

    def repeated(self, node):
        while self.at < len(self.p):
            c = self.p[self.at]
            if c in "?*+":
                self.at += 1
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
            elif c == "{":
                end = self.p.index("}", self.at)
                low, comma, high = self.p[self.at + 1 : end].partition(",")
                self.at = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                break
        return node

    def atom(self):
        c = self.p[self.at]
        if c == "(":
            self.at += 1
            if self.p.startswith("?:", self.at):
                self.at += 2
            node = self.alternatives()
            if self.p[self.at : self.at + 1] != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.at += 1
            return node
        if c == "[":
            return self.char_class()
        if c == ".":
            self.at += 1
            return ("set", frozenset(range(256)) - {10})
        return self.cased({self.byte()})

    def byte(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("patterns are ASCII")
            return ord(c)
        c = self.p[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        if c in "dwsDWSbB":
            raise ValueError(f"\\{c} isn't known; write the class out")
        return {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}.get(c, ord(c))

    def char_class(self):
        self.at += 1
        negate = self.p[self.at] == "^"
        self.at += negate
        found: set[int] = set()
        first = True
        while first or self.p[self.at] != "]":
            first = False
            low = self.byte()
            if self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                found |= set(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.at += 1
        return ("set", frozenset(range(256)) - found) if negate else self.cased(found)

    def cased(self, found: set[int]):
        if self.any_case:
            found = found | {ord(c) for b in found if b < 128 for c in (chr(b).lower(), chr(b).upper())}
        return ("set", frozenset(found))


def reverse(node):
    kind = node[0]
    if kind == "seq":
        return ("seq", [reverse(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), *node[2:]) if kind == "rep" else node


# -- trees to automata ----------------------------------------------------------------------------


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Adds node behind start and returns where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.on[start].append((node[1], end))
            return end
        if kind == "seq":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(x, own)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start] += [loop, end]
            self.free[self.add(inner, loop)] += [loop, end]
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end


@dataclasses.dataclass(frozen=True)
class Automaton:
    """step[state + class] is the next state; states are multiples of width, and those from accepting
    on accept; marks[state // width] has a bit for each rule. classes maps a byte to its class."""

    classes: bytes
    width: int
    step: list[int]
    accepting: int
    marks: list[int]
    start: int
    dead: int


def compile_automaton(trees: list, anywhere: bool) -> Automaton:
    """The minimal automaton that marks the rules whose tree matches what was read; with anywhere,
    what was read last."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        own = nfa.state()
        nfa.free[root].append(own)
        ends[nfa.add(tree, own)] = k

    # Bytes that no set tells apart are one class.
    sets = {s for edges in nfa.on for s, _ in edges}
    groups: dict[tuple, int] = {}
    ordered = sorted(sets, key=sorted)
    classes = bytes(groups.setdefault(tuple(b in s for s in ordered), len(groups)) for b in range(256))
    width = len(groups)
    sample = [classes.index(c) for c in range(width)]

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    # Subset construction.
    first = closed([root])
    number, order, table = {first: 0}, [first], []
    for subset in order:
        row = []
        for byte in sample:
            moved = {end for s in subset for chars, end in nfa.on[s] if byte in chars}
            to = closed(moved | {root} if anywhere else moved)
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    marks = [sum({1 << ends[s] for s in subset if s in ends}) for subset in order]

    # Minimisation by refinement: states stay together while marks and successors' blocks agree.
    block = marks
    while True:
        names: dict[tuple, int] = {}
        finer = [names.setdefault((block[s], *(block[t] for t in table[s])), len(names)) for s in range(len(table))]
        if len(names) == len(set(block)):
            break
        block = finer
    kept: dict[int, int] = {}
    for s, b in enumerate(block):
        kept.setdefault(b, s)
    ranked = sorted(kept.values(), key=lambda s: (marks[s] != 0, s))
    place = {block[s]: k for k, s in enumerate(ranked)}
    step = [place[block[t]] * width for s in ranked for t in table[s]]
    accepting = sum(marks[s] == 0 for s in ranked) * width
    dead = next((k * width for k, s in enumerate(ranked) if not marks[s] and all(block[t] == block[s] for t in table[s])), -1)
    return Automaton(classes, width, step, accepting, [marks[s] for s in ranked], place[block[0]] * width, dead)


class Scanner:
    """All rules, compiled."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        parse = lambda text, any_case: _Parser(text, any_case).whole()
        heads = [parse(r.head, r.any_case) for r in rules]
        tails = [parse(r.tail, False) for r in rules]
        whole = [("seq", [h, t]) for h, t in zip(heads, tails, strict=True)]
        self.begins = compile_automaton([reverse(self._marked(r, h, t)) for r, h, t in zip(rules, heads, tails, strict=True)], True)
        self.ends = [compile_automaton([x], False) for x in whole]
        self.heads = [compile_automaton([x], False) for x in heads]

    @staticmethod
    def _marked(rule: Rule, head, tail):
        """What marks a begin. A rule that is one run of a class has no shorter match worth marking:
        a run too short is dropped as a whole, so only runs of the least length are looked for."""
        if not rule.head and tail[0] == "seq" and len(tail[1]) == 1 and tail[1][0][0] == "rep" and tail[1][0][3] is None:
            return ("rep", tail[1][0][1], max(1, rule.least, rule.least_tail), max(1, rule.least, rule.least_tail))
        return ("seq", [head, tail])

    @staticmethod
    def longest(machine: Automaton, data: bytes, at: int) -> int:
        """Where the longest match of machine that begins at at ends; -1 without one."""
        step, state, end = machine.step, machine.start, at if machine.start >= machine.accepting else -1
        for k in range(at, len(data)):
            state = step[state + data[k]]
            if state >= machine.accepting:
                end = k + 1
            elif state == machine.dead:
                break
        return end

    def begins_of(self, text: bytes) -> list[array.array]:
        """For each rule where its matches may begin, from right to left: the last and the first place
        of each stretch of neighbouring begins, so that a long run takes no memory."""
        machine = self.begins
        step, accepting, state, width = machine.step, machine.accepting, machine.start, machine.width
        found = [array.array("q") for _ in self.rules]
        marked = [tuple(found[k] for k in range(len(found)) if m >> k & 1) for m in machine.marks]
        data = text.translate(machine.classes)
        at = len(data)
        for c in reversed(data):
            at -= 1
            state = step[state + c]
            if state >= accepting:
                for own in marked[state // width]:
                    if own and own[-1] == at + 1:
                        own[-1] = at
                    else:
                        own.append(at)
                        own.append(at)
        return found

    def scan(self, text: bytes) -> list[tuple[int, int, int]]:
        """(begin, rule, end) in bytes, by begin and then rule: of each rule the leftmost
        non-overlapping longest matches, without those that are too short."""
        found = []
        for k, stretches in enumerate(self.begins_of(text)):
            if not stretches:
                continue
            rule, behind = self.rules[k], 0
            own = text.translate(self.ends[k].classes)
            head = text.translate(self.heads[k].classes) if rule.least_tail else b""
            for x in range(len(stretches) - 2, -1, -2):
                last, at = stretches[x], max(stretches[x + 1], behind)
                while at <= last:
                    end = behind = self.longest(self.ends[k], own, at)
                    if end - at >= rule.least and (not rule.least_tail or end - self.longest(self.heads[k], head, at) >= rule.least_tail):
                        found.append((at, k, end))
                    at = max(end, at + 1)
        return sorted(found)


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find(docs: DataFrame, *, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """docs with secrets: array of (kind, start, end) in code points, end exclusive, by start and then
    in the order of rules. Null texts count as empty and have none. Texts are read whole, whatever
    their length; a column named secrets is replaced; an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    machine = scanner(rules)
    kinds = [r.kind for r in rules]

    def spans(t: str) -> list[dict]:
        raw = t.encode("utf-8", "surrogatepass")
        found = machine.scan(raw)
        if len(raw) != len(t):  # bytes to code points, for the matches only
            place, last, points = {}, 0, 0
            for x in sorted({y for a, _, b in found for y in (a, b)}):
                points += len(raw[last:x].decode("utf-8", "surrogatepass"))
                place[x], last = points, x
            found = [(place[a], k, place[b]) for a, k, b in found]
        return [{"kind": kinds[k], "start": a, "end": b} for a, k, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = [spans(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kind)], names=[*b.schema.names[:-1], "secrets"])

    rows, types = with_text(docs, text, ("secrets",))
    return rows.mapInArrow(run, ", ".join([*types, "secrets array<struct<kind:string,start:bigint,end:bigint>>"]))
