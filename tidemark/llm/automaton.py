"""Regular expressions over bytes, compiled to one deterministic automaton for all rules.

Each rule is parsed to a nondeterministic automaton.  The search automaton of a
rule is built by subset construction over *generations*: the sets of positions
that attempts begun at successive starts have reached, oldest first; a younger
attempt gives up what an older one also reaches, and all younger ones go once
the oldest accepts, which makes matches leftmost, longest and non-overlapping.
The rules' search automata run side by side as one product, which is minimised
by partition refinement into flat transition arrays.  A text is then read once,
byte by byte, for all rules.  Where a match ends is known from the automaton;
where it begins is found by the reversed rule, read backwards from that end.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np

ANY = frozenset(range(256))
ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """Literals, classes, groups, |, ?, *, +, {m}, {m,} and {m,n}; the syntax tree is of tuples."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.s, self.i, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def parse(self):
        tree = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unbalanced ) in {self.s!r}")
        return tree

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("seq", parts)

    def repeat(self, tree):
        while (c := self.peek()) in ("?", "*", "+", "{") and c:
            self.i += 1
            if c == "{":
                low, _, high = self.s[self.i : (end := self.s.index("}", self.i))].partition(",")
                low, high, self.i = int(low), (int(high) if high else None) if "," in self.s[self.i : end] else int(low), end + 1
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, low, high)
        return tree

    def both_cases(self, x: set[int]) -> frozenset[int]:
        return frozenset(x | {b ^ 32 for b in x if chr(b & ~32) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and b < 128} if self.fold else x)

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ESCAPES.get(c, ord(c))

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            if self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.either()
            self.i += 1
            return tree
        if c == ".":
            self.i += 1
            return ("set", ANY - {10})
        if c != "[":
            return ("set", self.both_cases({self.byte()}))
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        x: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                x |= set(range(low, self.byte() + 1))
            else:
                x.add(low)
        self.i += 1
        return ("set", ANY - self.both_cases(x) if negated else self.both_cases(x))


@dataclass
class Nfa:
    """Edges by byte set, and empty edges; state 0 begins, `end` accepts."""

    steps: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    end: int = 0

    def new(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def add(self, tree, a: int) -> int:
        """Where one is after the tree, from state a."""
        kind = tree[0]
        if kind == "set":
            self.steps[a].append((tree[1], b := self.new()))
            return b
        if kind == "seq":
            for part in tree[1]:
                a = self.add(part, a)
            return a
        if kind == "or":
            out = self.new()
            for part in tree[1]:
                self.empty[a].append(b := self.new())
                self.empty[self.add(part, b)].append(out)
            return out
        _, part, low, high = tree
        for _ in range(low):
            a = self.add(part, a)
        if high is None:
            self.empty[a].append(loop := self.new())
            self.empty[self.add(part, loop)].append(loop)
            return loop
        out = self.new()
        self.empty[a].append(out)
        for _ in range(high - low):
            a = self.add(part, a)
            self.empty[a].append(out)
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def move(self, states, byte: int) -> frozenset[int]:
        return self.closure({to for s in states for allowed, to in self.steps[s] if byte in allowed})

    def reversed(self) -> Nfa:
        """Reads what this one reads from its end; state 0 is the old end."""
        name = lambda s: 0 if s == self.end else s + 1
        out = Nfa([[] for _ in range(len(self.steps) + 1)], [[] for _ in range(len(self.steps) + 1)])
        for s in range(len(self.steps)):
            for allowed, to in self.steps[s]:
                out.steps[name(to)].append((allowed, name(s)))
            for to in self.empty[s]:
                out.empty[name(to)].append(name(s))
        out.end = name(0)
        return out


def compile_nfa(pattern: str, ignore_case: bool = False) -> Nfa:
    nfa = Nfa()
    nfa.end = nfa.add(_Parser(pattern, ignore_case).parse(), nfa.new())
    return nfa


class _Search:
    """Subset construction over generations for one rule."""

    def __init__(self, nfa: Nfa):
        self.nfa, self.start, self.memo = nfa, nfa.closure({0}), {}
        if nfa.end in self.start:
            raise ValueError("a rule must not match the empty text")

    def accepting(self, state: tuple) -> bool:
        return bool(state) and self.nfa.end in state[0]

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended before this byte."""
        if (state, byte) not in self.memo:
            self.memo[state, byte] = self._step(state, byte)
        return self.memo[state, byte]

    def _step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        ended = False
        if self.accepting(state):
            if on := self.nfa.move(state[0], byte):
                if self.nfa.end not in on:
                    raise ValueError("a rule must keep matching or die once it has matched")
                return (on,), False
            state, ended = (), True
        seen: set[int] = set()
        out = []
        for old in (*state, self.start):
            if new := self.nfa.move(old, byte) - seen:
                seen |= new
                out.append(frozenset(new))
        for k, new in enumerate(out):
            if self.nfa.end in new:
                if k:
                    raise ValueError("a later start must not match before an earlier one is decided")
                out = out[:1]
                break
        return tuple(out), ended


@dataclass
class Scanner:
    """Flat transition arrays of the minimised product, and the reversed rules.

    next[state + class] is a state (a multiple of `width`), or ~k for events[k]:
    the state and the rules whose match ended before the byte just read.
    """

    rules: list[str]
    classes: bytes
    width: int
    next: list[int]
    events: list[tuple[int, tuple[int, ...]]]
    final: dict[int, tuple[int, ...]]
    reverse: list[Nfa]
    states_before: int
    states: int

    def __post_init__(self):
        self._back: list[dict] = [{} for _ in self.rules]

    def _begin(self, rule: int, data: bytes, end: int, low: int) -> int:
        """The leftmost start, from low on, of a match of the rule that ends at `end`."""
        nfa, memo = self.reverse[rule], self._back[rule]
        state, best, i = nfa.closure({0}), end, end
        while i > low:
            i -= 1
            key = (state, data[i])
            if key not in memo:
                memo[key] = nfa.move(*key)
            state = memo[key]
            if not state:
                break
            if nfa.end in state:
                best = i
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of all matches in bytes, by end; leftmost and non-overlapping in each rule."""
        nxt, state, found = self.next, 0, []
        ends = [0] * len(self.rules)
        for i, c in enumerate(data.translate(self.classes)):
            state = nxt[state + c]
            if state < 0:
                state, over = self.events[~state]
                for rule in over:
                    found.append((rule, self._begin(rule, data, i, ends[rule]), i))
                    ends[rule] = i
        for rule in self.final.get(state, ()):
            found.append((rule, self._begin(rule, data, len(data), ends[rule]), len(data)))
        return found


def _byte_classes(nfas: list[Nfa]) -> list[list[int]]:
    sets = list({allowed for nfa in nfas for edges in nfa.steps for allowed, _ in edges})
    by: dict[tuple, list[int]] = {}
    for b in range(256):
        by.setdefault(tuple(b in x for x in sets), []).append(b)
    return list(by.values())


def compile_scanner(rules: dict[str, tuple[str, bool]], limit: int = 60_000) -> Scanner:
    """rules: name to (pattern, ignore case).  ValueError beyond `limit` states of the product."""
    nfas = [compile_nfa(*x) for x in rules.values()]
    groups = _byte_classes(nfas)
    searches = [_Search(x) for x in nfas]
    first = tuple(() for _ in searches)
    number, todo, to, over = {first: 0}, deque([first]), [], []
    while todo:
        state = todo.popleft()
        row, ended = [], []
        for group in groups:
            parts = [s.step(x, group[0]) for s, x in zip(searches, state, strict=True)]
            new = tuple(x for x, _ in parts)
            if new not in number:
                if len(number) >= limit:
                    raise ValueError("the combined automaton is too large")
                number[new] = len(number)
                todo.append(new)
            row.append(number[new])
            ended.append(sum(1 << k for k, (_, e) in enumerate(parts) if e))
        to.append(row)
        over.append(ended)
    to, over = np.array(to), np.array(over)
    final = np.array([sum(1 << k for k, (s, x) in enumerate(zip(searches, state, strict=True)) if s.accepting(x)) for state in number])
    # Partition refinement: states are one if they end the same matches and lead to the same blocks.
    _, block = np.unique(np.column_stack([final, over]), axis=0, return_inverse=True)
    block = block.ravel()
    while True:
        _, finer = np.unique(np.column_stack([block, block[to]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    order[block[0]] = 0
    for b in block:
        if order[b] < 0:
            order[b] = order.max() + 1
    block = order[block]
    width = len(groups)
    one = np.zeros(block.max() + 1, int)
    one[block] = np.arange(len(block))
    bits = lambda m: tuple(k for k in range(len(nfas)) if m >> k & 1)
    events: dict[tuple, int] = {}
    flat: list[int] = []
    for s in one:
        for c in range(width):
            target = int(block[to[s, c]]) * width
            flat.append(~events.setdefault((target, bits(int(over[s, c]))), len(events)) if over[s, c] else target)
    classes = bytearray(256)
    for c, group in enumerate(groups):
        for b in group:
            classes[b] = c
    return Scanner(list(rules), bytes(classes), width, flat, list(events), {k * width: bits(int(final[s])) for k, s in enumerate(one) if final[s]}, [x.reversed() for x in nfas], len(number), len(one))
