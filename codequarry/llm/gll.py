"""Generalised LL recognition with a graph-structured stack.

Grammars are written as text, one nonterminal a line: `Name = alternatives`, with `|`, `?`,
`*`, `+` and parentheses; quoted words are terminals, `P:A`, `S:A` and `B:A` stand for a
round, square or curly group whose content is an A, `EOF` for the end. Each nonterminal
becomes a small automaton; descriptors (state, stack node, position) are worked off once
each, and stack nodes are shared by (nonterminal, position), so ambiguous and left-recursive
rules cost no more than cubic time. Several start symbols run together on one stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_LEX = re.compile(r"\s*('[^']*'|[PSB]:\w+|\w+|[()|?*+])")


class Grammar:
    def __init__(self, text: str, terminal: Callable[[str], str]):
        """terminal: maps a quoted word to its one-character token."""
        self.of: list[str] = []
        self.moves: list[list[tuple[str, str, int]]] = []
        self.final: list[bool] = []
        self.start: dict[str, int] = {}
        self._terminal = terminal
        rules: dict[str, str] = {}
        for line in text.strip().splitlines():
            if line.strip() and not line.strip().startswith("//"):
                name, _, body = line.partition(" =")
                rules[name.strip()] = body
        for name, body in rules.items():
            tokens = _LEX.findall(body)
            self._name = name
            begin = self._state()
            self.start[name] = begin
            end = self._state()
            self.final[end] = True
            if tokens:
                rest = self._alternatives(tokens, begin, end)
                assert not rest, (name, rest)
        # Empty steps are closed, so the run knows only real symbols.
        closed = [self._closure(s) for s in range(len(self.moves))]
        final = [any(self.final[x] for x in c) for c in closed]
        moves = [[m for x in c for m in self.moves[x] if m[0] != "e"] for c in closed]
        self.final, self.moves = final, moves
        self._firsts()

    def _state(self) -> int:
        self.moves.append([])
        self.final.append(False)
        self.of.append(self._name)
        return len(self.moves) - 1

    def _alternatives(self, t: list[str], a: int, b: int) -> list[str]:
        while True:
            t = self._sequence(t, a, b)
            if not t or t[0] != "|":
                return t
            t = t[1:]

    def _sequence(self, t: list[str], a: int, b: int) -> list[str]:
        at = a
        while t and t[0] not in "|)":
            x, t = t[0], t[1:]
            i, o = self._state(), self._state()
            if x == "(":
                t = self._alternatives(t, i, o)[1:]
            elif x[0] == "'":
                self.moves[i].append(("t", self._terminal(x[1:-1]), o))
            elif x == "EOF" or x[1:2] == ":":
                self.moves[i].append(("t", x, o))
            else:
                self.moves[i].append(("n", x, o))
            self.moves[at].append(("e", "", i))
            if t and t[0] in "?*+":
                if t[0] in "?*":
                    self.moves[i].append(("e", "", o))
                if t[0] in "*+":
                    self.moves[o].append(("e", "", i))
                t = t[1:]
            at = o
        self.moves[at].append(("e", "", b))
        return t

    def _closure(self, s: int) -> list[int]:
        seen, todo = {s}, [s]
        while todo:
            for kind, _, x in self.moves[todo.pop()]:
                if kind == "e" and x not in seen:
                    seen.add(x)
                    todo.append(x)
        return sorted(seen)

    def _firsts(self) -> None:
        self.first: dict[str, set[str]] = {n: set() for n in self.start}
        self.empty: dict[str, bool] = dict.fromkeys(self.start, False)
        changed = True
        while changed:
            changed = False
            for n, s0 in self.start.items():
                seen, todo, first = {s0}, [s0], set()
                empty = False
                while todo:
                    s = todo.pop()
                    empty |= self.final[s]
                    for kind, x, to in self.moves[s]:
                        if kind == "t":
                            first.add(x)
                            if x == "EOF" and to not in seen:
                                seen.add(to)
                                todo.append(to)
                        else:
                            first |= self.first[x]
                            if self.empty[x] and to not in seen:
                                seen.add(to)
                                todo.append(to)
                if not first <= self.first[n] or empty and not self.empty[n]:
                    self.first[n] |= first
                    self.empty[n] |= empty
                    changed = True
        self.on: list[dict[str, list[int]]] = []
        self.calls: list[list[tuple[str, int, set[str], bool]]] = []
        for s in range(len(self.moves)):
            on: dict[str, list[int]] = {}
            for kind, x, to in self.moves[s]:
                if kind == "t":
                    on.setdefault(x, []).append(to)
            self.on.append(on)
            self.calls.append([(x, to, self.first[x], self.empty[x]) for kind, x, to in self.moves[s] if kind == "n"])

    def accepted(self, tokens: str, starts: Iterable[str], labels: Callable[[str], tuple[str, ...]]) -> frozenset[str]:
        """Those of the start symbols that derive the whole of tokens.

        labels: gives the terminals that a character stands for (a group may be several).
        """
        n = len(tokens)
        at = [labels(c) for c in tokens] + [("EOF",)]
        on, calls, final, start = self.on, self.calls, self.final, self.start
        nodes: dict[tuple[str, int], tuple[list, list, set]] = {}
        done: set[tuple[int, int, int]] = set()
        todo: list = []
        roots = {}
        for x in starts:
            node = nodes[x, 0] = ([], [], set())  # edges, ends, known edges
            roots[x] = node
            todo.append((start[x], node, 0))
        while todo:
            d = todo.pop()
            s, node, i = d
            key = (s, id(node), i)
            if key in done:
                continue
            done.add(key)
            if final[s] and i not in node[1]:
                node[1].append(i)
                for to, parent in node[0]:
                    todo.append((to, parent, i))
            here = at[i]
            moves = on[s]
            if moves:
                for x in here:
                    for to in moves.get(x, ()):
                        todo.append((to, node, i + 1 if i < n else i))
            for x, to, first, empty in calls[s]:
                if not empty:
                    for y in here:
                        if y in first:
                            break
                    else:
                        if "EOF" not in first or i < n:
                            continue
                child = nodes.get((x, i))
                if child is None:
                    child = nodes[x, i] = ([], [], set())
                    todo.append((start[x], child, i))
                edge = (to, id(node))
                if edge not in child[2]:
                    child[2].add(edge)
                    child[0].append((to, node))
                    for j in child[1]:
                        todo.append((to, node, j))
        return frozenset(x for x, node in roots.items() if n in node[1])
