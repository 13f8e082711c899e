"""One deterministic automaton for many patterns, which reports every place where any of them can end.

Patterns are written as regular expressions without look-around, back-references or anchors; they
are parsed to one nondeterministic automaton, whose sets of states are made deterministic when they
are first reached.  A text is scanned in one pass, one step for each character, in chunks of any
size: the state is carried from chunk to chunk, so where a chunk ends has no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

_ESCAPES = {"t": "\t", "n": "\n", "r": "\r"}
_DIGITS = frozenset("0123456789")
_ASCII = frozenset(map(chr, range(128)))
_WORDS = frozenset(c for c in _ASCII if c.isalnum() or c == "_")
_SPACES = frozenset(" \t\n\r\x0b\x0c")
#: Stands for all characters that are not ASCII.
OTHER = "￿"
_ALL = _ASCII | {OTHER}


class _Parser:
    """Parses one pattern into the automaton's arcs."""

    def __init__(self, owner: Automaton, pattern: str, ignore_case: bool) -> None:
        self.o, self.p, self.at, self.ignore = owner, pattern, 0, ignore_case

    def alternatives(self) -> tuple[int, int]:
        start, end = self.o.state(), self.o.state()
        while True:
            a, b = self.sequence()
            self.o.empty[start].add(a)
            self.o.empty[b].add(end)
            if self.at >= len(self.p) or self.p[self.at] != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.o.state()
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            begin = self.at
            a, b = self.atom()
            stop = self.at
            low, high = self.count()
            after = self.at
            if (low, high) == (1, 1):
                self.o.empty[end].add(a)
                end = b
                continue
            # the first copy is the one parsed; further copies parse the same text again
            copies = [(a, b)]
            for _ in range(max(low, high or 0, 1) - 1):
                self.at = begin
                copies.append(self.atom())
                assert self.at == stop
            self.at = after
            exits = []
            for k, (a, b) in enumerate(copies):
                if k >= low:
                    exits.append(end)
                self.o.empty[end].add(a)
                end = b
            if high is None:
                self.o.empty[end].add(copies[-1][0])
            last = self.o.state()
            for x in [*exits, end]:
                self.o.empty[x].add(last)
            end = last
        return start, end

    def count(self) -> tuple[int, int | None]:
        c = self.p[self.at] if self.at < len(self.p) else ""
        if c and c in "*+?":
            self.at += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if c == "{":
            stop = self.p.index("}", self.at)
            low, comma, high = self.p[self.at + 1 : stop].partition(",")
            self.at = stop + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            if self.p.startswith("?:", self.at):
                self.at += 2
            a, b = self.alternatives()
            assert self.p[self.at] == ")"
            self.at += 1
            return a, b
        if c == "[":
            chars = self.charset()
        elif c == ".":
            chars = _ALL - {"\n"}
        elif c == "\\":
            chars = self.escape()
        else:
            chars = {c if c in _ASCII else OTHER}
        if self.ignore:
            chars = {x for c in chars for x in ((c.lower(), c.upper()) if c in _ASCII else (c,))}
        a, b = self.o.state(), self.o.state()
        self.o.arcs[a].append((frozenset(chars), b))
        return a, b

    def escape(self) -> set[str] | frozenset[str]:
        c = self.p[self.at]
        self.at += 1
        sets = {"d": _DIGITS, "w": _WORDS | {OTHER}, "s": _SPACES, "S": _ALL - _SPACES, "W": _ASCII - _WORDS, "D": _ALL - _DIGITS}
        return sets.get(c) or {_ESCAPES.get(c, c)}

    def charset(self) -> set[str]:
        no = self.p[self.at] == "^"
        self.at += no
        out: set[str] = set()
        while self.p[self.at] != "]":
            c = self.p[self.at]
            self.at += 1
            some = self.escape() if c == "\\" else {c if c in _ASCII else OTHER}
            if self.p[self.at] == "-" and self.p[self.at + 1] != "]" and len(some) == 1:
                self.at += 1
                d = self.p[self.at]
                self.at += 1
                if d == "\\":
                    d = next(iter(self.escape()))
                some = {chr(x) for x in range(ord(next(iter(some))), ord(d) + 1)}
            out |= some
        self.at += 1
        return set(_ALL - out) if no else out


class Automaton:
    """patterns: name -> (pattern, whether case is ignored)."""

    #: States kept; when there are more, the table begins anew.
    MOST = 20_000

    def __init__(self, patterns: dict[str, tuple[str, bool]]) -> None:
        self.arcs: list[list[tuple[frozenset[str], int]]] = []
        self.empty: list[set[int]] = []
        self.names = list(patterns)
        begin = self.state()
        self.final: dict[int, int] = {}
        for k, (pattern, ignore) in enumerate(patterns.values()):
            parser = _Parser(self, pattern, ignore)
            a, b = parser.alternatives()
            assert parser.at == len(pattern), pattern
            self.empty[begin].add(a)
            self.final[b] = k
        # characters that no pattern tells apart are one class
        tables: dict[tuple, int] = {}
        sets = sorted({s for arcs in self.arcs for s, _ in arcs}, key=sorted)
        self.class_of = {}
        for c in sorted(_ALL):
            self.class_of[c] = tables.setdefault(tuple(c in s for s in sets), len(tables))
        self.classes = len(tables)
        self.example = {k: c for c, k in self.class_of.items()}
        self.map = {ord(c): chr(k) for c, k in self.class_of.items() if c != OTHER}
        self.begin = self._closure({begin})
        self._reset()

    def state(self) -> int:
        self.arcs.append([])
        self.empty.append(set())
        return len(self.arcs) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(x for x in out if self.arcs[x] or x in self.final)

    def _reset(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.next: list[list[int]] = []
        self.ends: list[tuple[int, ...]] = []
        self._add(self.begin)

    def _add(self, states: frozenset[int]) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.next.append([-1] * self.classes)
            self.ends.append(tuple(sorted({self.final[x] for x in states if x in self.final})))
        return self.number[states]

    def _step(self, at: int, kind: int) -> int:
        c = self.example[kind]
        states = self._closure({b for x in self.sets[at] for chars, b in self.arcs[x] if c in chars} | self.begin)
        self.next[at][kind] = to = self._add(states)
        return to

    def scan(self, text: str, chunk: int = 1 << 16) -> Iterator[tuple[str, int]]:
        """(name, end) of every pattern that matches some stretch of the text up to end."""
        other = self.class_of[OTHER]
        at = 0
        for begin in range(0, len(text), chunk):
            part = text[begin : begin + chunk]
            if len(self.sets) > self.MOST:  # carried on from the same set of states
                here = self.sets[at]
                self._reset()
                at = self._add(here)
            table, ends = self.next, self.ends
            classes = part.translate(self.map) if part.isascii() else "".join(self.map.get(ord(c)) or chr(other) for c in part)
            for k, c in enumerate(classes.encode("latin-1"), begin + 1):
                to = table[at][c]
                if to < 0:
                    to = self._step(at, c)
                at = to
                if ends[at]:
                    for e in ends[at]:
                        yield self.names[e], k
