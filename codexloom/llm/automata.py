"""Deterministic automata over bytes: regex parser, subset construction, minimisation.

The syntax: literals, escapes (\\xHH and escaped punctuation), ``.``, classes,
groups, ``|``, and the repeats ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from collections.abc import Iterable


class _Parser:
    """Thompson construction; ``edges[state]`` lists (byte set or None, target)."""

    def __init__(self, any_case: bool, edges: list, shortest: bool) -> None:
        self.any_case, self.edges, self.shortest = any_case, edges, shortest

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def parse(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        out = self.choice()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at}")
        return out

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self) -> tuple[int, int]:
        branches = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        begin, end = self.state(), self.state()
        for a, b in branches:
            self.edges[begin].append((None, a))
            self.edges[b].append((None, end))
        return begin, end

    def sequence(self) -> tuple[int, int]:
        begin = end = self.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.edges[end].append((None, a))
            end = b
        return begin, end

    def repeated(self) -> tuple[int, int]:
        start = self.at
        self.atom()  # only to find its extent; copies are parsed anew
        stop = self.at
        least, most = self.bounds()
        after = self.at
        if self.shortest and after == len(self.text):  # a search tells the first end of a match
            most = max(least, 1)

        def copy() -> tuple[int, int]:
            self.at = start
            made = self.atom()
            assert self.at == stop
            return made

        begin = end = self.state()
        for _ in range(least):
            a, b = copy()
            self.edges[end].append((None, a))
            end = b
        if most is None:
            a, b = copy()
            loop = self.state()
            self.edges[end].append((None, loop))
            self.edges[loop].append((None, a))
            self.edges[b].append((None, loop))
            end = loop
        else:
            last = self.state()
            for _ in range(most - least):
                self.edges[end].append((None, last))
                a, b = copy()
                self.edges[end].append((None, a))
                end = b
            self.edges[end].append((None, last))
            end = last
        self.at = after
        return begin, end

    def bounds(self) -> tuple[int, int | None]:
        found = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(self.peek())
        if found:
            self.at += 1
            return found
        if self.peek() == "{":
            body = self.text[self.at + 1 : self.text.index("}", self.at)]
            self.at += len(body) + 2
            low, comma, high = body.partition(",")
            return int(low), int(high) if high else None if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.at += 1
            out = self.choice()
            self.at += 1
            return out
        members = self.members() if c == "[" else self.one()
        if self.any_case:
            members = members | {b ^ 32 for b in members if 65 <= b & ~32 <= 90 and b < 128}
        begin, end = self.state(), self.state()
        self.edges[begin].append((frozenset(members), end))
        return begin, end

    def one(self, listed: bool = False) -> set[int]:
        c = self.text[self.at]
        self.at += 1
        if c == "." and not listed:
            return set(range(256)) - {10}
        if c != "\\":
            return {ord(c)}
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return {int(self.text[self.at - 2 : self.at], 16)}
        return {ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))}

    def members(self) -> set[int]:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        out: set[int] = set()
        while self.peek() != "]":
            low = self.one(True)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                out |= set(range(min(low), max(self.one(True)) + 1))
            else:
                out |= low
        self.at += 1
        return set(range(256)) - out if negated else out


class Automaton:
    """A minimal deterministic automaton over byte classes.

    ``classes`` maps a byte to its class (for ``bytes.translate``); ``table`` is the
    flat transition array, whose entries are the offset of the next state's row, and
    ``outputs[row]`` has the rules that a state accepts.  Rows of accepting states come
    last, from ``accepting``; ``start`` and ``dead`` (or -1) are rows as well.
    With ``search``, a match may begin anywhere and its first end is told.
    """

    def __init__(self, patterns: Iterable[tuple[str, bool]], search: bool, backward: bool = False) -> None:
        edges: list = [[]]
        finals: dict[int, int] = {}
        for rule, (pattern, any_case) in enumerate(patterns):
            first = len(edges)
            a, b = _Parser(any_case, edges, search).parse(pattern)
            if backward:
                turned: list = [[] for _ in range(len(edges) - first)]
                for s in range(first, len(edges)):
                    for label, t in edges[s]:
                        turned[t - first].append((label, s))
                edges[first:] = turned
                a, b = b, a
            edges[0].append((None, a))
            finals[b] = rule
        self._build(edges, finals, search)

    def _build(self, edges: list, finals: dict[int, int], search: bool) -> None:
        signs: dict[tuple, int] = {}
        sets = sorted({label for es in edges for label, _ in es if label is not None}, key=sorted)
        self.classes = bytes(signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256))
        width = len(signs)
        sample = [self.classes.index(k) for k in range(width)]

        def closed(state: int) -> frozenset[int]:
            """States with a labelled edge or a rule's end that empty steps lead to."""
            todo, seen = [state], {state}
            while todo:
                for label, t in edges[todo.pop()]:
                    if label is None and t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if s in finals or any(x is not None for x, _ in edges[s]))

        steps: dict[int, list[frozenset[int]]] = {}

        def stepped(state: int) -> list[frozenset[int]]:
            if state not in steps:
                to = [[closed(t) for label, t in edges[state] if label is not None and b in label] for b in sample]
                steps[state] = [frozenset().union(*x) for x in to]
            return steps[state]

        root = closed(0)
        again = root if search else frozenset()
        index, rows, outputs, todo = {root: 0}, [], [], [root]
        for states in todo:
            outputs.append(frozenset(finals[s] for s in states if s in finals))
            row = []
            for k in range(width):
                new = again.union(*(stepped(s)[k] for s in states))
                if new not in index:
                    index[new] = len(index)
                    todo.append(new)
                row.append(index[new])
            rows.append(row)
        self._minimise(rows, outputs, width)

    def _minimise(self, rows: list[list[int]], outputs: list[frozenset[int]], width: int) -> None:
        names: dict = {}
        block = [names.setdefault(o, len(names)) for o in outputs]
        while True:  # Moore: refine until stable
            names = {}
            new = [names.setdefault((block[s], *(block[t] for t in rows[s])), len(names)) for s in range(len(rows))]
            if len(names) == len(set(block)):
                break
            block = new
        one_of = {b: s for s, b in reversed(list(enumerate(block)))}
        order = sorted(one_of, key=lambda b: (bool(outputs[one_of[b]]), b))
        row_of = {b: k * width for k, b in enumerate(order)}
        self.width = width
        self.start = row_of[block[0]]
        self.table = [row_of[block[t]] for b in order for t in rows[one_of[b]]]
        self.outputs = {row_of[b]: sorted(outputs[one_of[b]]) for b in order}
        self.accepting = min((r for r, o in self.outputs.items() if o), default=len(self.table))
        trap = [r for r in self.outputs if not self.outputs[r] and set(self.table[r : r + width]) == {r}]
        self.dead = trap[0] if trap else -1

    def longest(self, data: Iterable[int]) -> int:
        """Length of the longest accepted prefix of translated bytes, or -1."""
        state, best = self.start, 0 if self.start >= self.accepting else -1
        table, accepting, dead = self.table, self.accepting, self.dead
        for n, c in enumerate(data, 1):
            state = table[state + c]
            if state >= accepting:
                best = n
            elif state == dead:
                break
        return best
