"""Grammars of marked values as one deterministic automaton.

A grammar is a context and a value that follows it. The contexts of all grammars are joined in one
machine that starts anew at every character, so one pass over a text, each character read once,
tells where the values of which grammars may begin. From such a place the value's own machine
gives its longest end; a value that begins inside another one of its grammar stops where both are
in the same state. States are made by subset construction when a text first reaches them.
Characters beyond ASCII share one class.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from typing import NamedTuple

_ASCII = "".join(map(chr, range(128)))
_BEYOND = "\x80"
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: States kept of the machine over all contexts; beyond, they are made anew with the next text.
MOST_STATES = 30_000


class Part:
    """A piece of a grammar: ``build(machine, state, back)`` adds it behind ``state``, mirrored if ``back``, and returns its end."""

    def __init__(self, build) -> None:
        self.build = build

    def __add__(self, other: Part) -> Part:
        def build(m, s, back):
            first, second = (other, self) if back else (self, other)
            return second.build(m, first.build(m, s, back), back)

        return Part(build)


def chars(allowed: str) -> Part:
    """One character of ``allowed``; ``\\x80`` in it stands for every character beyond ASCII."""
    return Part(lambda m, s, back: m.step(s, frozenset(allowed)))


def but(excluded: str) -> Part:
    """One character that is not in ``excluded``."""
    return chars("".join(c for c in _ASCII + _BEYOND if c not in excluded))


def word(text: str, any_case: bool = False) -> Part:
    def build(m, s, back):
        for c in reversed(text) if back else text:
            s = m.step(s, frozenset((c.lower(), c.upper())) if any_case else frozenset((c,)))
        return s

    return Part(build)


def one_of(*parts: Part) -> Part:
    def build(m, s, back):
        end = m.state()
        for p in parts:
            m.free(p.build(m, s, back), end)
        return end

    return Part(build)


def words(*texts: str, any_case: bool = True) -> Part:
    return one_of(*[word(t, any_case) for t in texts])


def maybe(part: Part) -> Part:
    return one_of(part, Part(lambda m, s, back: s))


def many(part: Part, least: int = 0) -> Part:
    """``least`` or more in a row."""

    def build(m, s, back):
        for _ in range(least):
            s = part.build(m, s, back)
        loop = m.state()
        m.free(s, loop)
        m.free(part.build(m, loop, back), loop)
        return loop

    return Part(build)


class Grammar(NamedTuple):
    """``lead``: how many of the context's last characters are part of the value; ``located``: whether ``accept`` looks at the context's beginning."""

    name: str
    context: Part
    value: Part
    lead: int = 0
    located: bool = False


class Found(NamedTuple):
    name: str
    start: int
    end: int


class _Machine:
    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.frees: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.frees.append([])
        return len(self.steps) - 1

    def step(self, s: int, allowed: frozenset) -> int:
        to = self.state()
        self.steps[s].append((allowed, to))
        return to

    def free(self, s: int, to: int) -> None:
        self.frees[s].append(to)

    def closure(self, states: set[int], marks: dict[int, int]) -> frozenset:
        """What ``states`` reach without a character, as far as it reads one or is marked."""
        seen, todo = set(states), list(states)
        while todo:
            for t in self.frees[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.steps[s] or s in marks)


class _States:
    """Subsets of a machine's states, made when first reached. State 0 is the empty one."""

    def __init__(self, moves: list[dict[int, frozenset]], marks: dict[int, int], start: frozenset, always: frozenset, width: int) -> None:
        self.moves, self.marks, self.begin, self.always, self.width = moves, marks, start, always, width
        self.forget()

    def forget(self) -> None:
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.table: list[list[int]] = [[0] * self.width]
        self.marked: list[tuple[int, ...]] = [()]
        self.start = self.of(self.begin)

    def of(self, states: frozenset) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.table.append([-1] * self.width)
            self.marked.append(tuple(sorted({self.marks[s] for s in states if s in self.marks})))
        return self.number[states]

    def made(self, s: int, c: int) -> int:
        to = set(self.always) if s else set()
        for x in self.sets[s]:
            if (more := self.moves[x].get(c)) is not None:
                to |= more
        self.table[s][c] = t = self.of(frozenset(to))
        return t


class Automaton:
    """Made once from ``grammars``; plain lists, so it can be sent to the tasks."""

    def __init__(self, grammars: list[Grammar]) -> None:
        m = _Machine()
        self.grammars = [(g.name, g.lead, g.located) for g in grammars]
        begins: dict[int, int] = {}
        starts, ends, mirrored = [], [], []
        for i, g in enumerate(grammars):
            starts.append(m.state())
            begins[g.context.build(m, starts[-1], False)] = i
        contexts = range(len(m.steps))
        for g in grammars:
            at = m.state()
            ends.append((at, g.value.build(m, at, False)))
            back = m.state()
            mirrored.append((back, g.context.build(m, back, True)) if g.located else None)
        sets = list({allowed for steps in m.steps for allowed, _ in steps})
        classes: dict[tuple, int] = {}
        of = [classes.setdefault(tuple(c in s for s in sets), len(classes)) for c in _ASCII + _BEYOND]
        self.classes = bytes([*of[:128], *[of[128]] * 128])
        sample = {k: c for c, k in zip(_ASCII + _BEYOND, of)}
        marks = begins | {end: 0 for _, end in ends} | {p[1]: 0 for p in mirrored if p}
        moves: list[dict[int, frozenset]] = [{} for _ in m.steps]
        for s, steps in enumerate(m.steps):
            for k, c in sample.items():
                if to := {t for allowed, t in steps if c in allowed}:
                    moves[s][k] = m.closure(to, marks)
        made = lambda states, always=frozenset(): _States(moves, marks, m.closure(states, marks), always, len(classes))
        self.contexts = made(set(starts), m.closure(set(starts), marks))
        self.every_context = frozenset(s for s in contexts if m.steps[s] or s in marks)
        self.values = [made({at}) for at, _ in ends]
        self.behind = [made({p[0]}) if p else None for p in mirrored]

    def coded(self, text: str) -> bytes:
        plain = text if text.isascii() else _NOT_ASCII.sub(_BEYOND, text)
        return plain.encode("latin-1").translate(self.classes)

    def _begins(self, coded: bytes, own: int, head_open: bool) -> tuple[list[tuple[int, tuple[int, ...]]], bool]:
        """Places where values may begin, with their grammars, and whether those from ``own`` on are all known.

        With an open head the text before is unknown: the state lies between the one of a fresh
        start and the one of every possible state, and is known from where both are the same.
        """
        m = self.contexts
        if len(m.sets) > MOST_STATES:
            m.forget()
        table, marked, out, at = m.table, m.marked, [], 0
        s = m.start
        if head_open:
            high = m.of(self.every_context)
            while s != high and at < own:
                c = coded[at]
                s, high = (t if (t := table[s][c]) >= 0 else m.made(s, c)), (t if (t := table[high][c]) >= 0 else m.made(high, c))
                at += 1
            if s != high:
                return [], False
        for j, c in enumerate(coded[at:] if at else coded, at + 1):
            t = table[s][c]
            s = t if t >= 0 else m.made(s, c)
            if marked[s]:
                out.append((j, marked[s]))
        return out, True

    def found(self, text: str, accept, own: tuple[int, int] | None = None, head_open: bool = False, tail_open: bool = False) -> Iterator[Found | None]:
        """The values that ``accept(name, text, match_start, start, end)`` confirms, by the place behind their context.

        At each such place a grammar's longest value counts; what lies inside a confirmed one is
        left out. ``accept`` returns the end to use, which may be before the match's, or None.

        ``own``: the places, from and to, that are looked at. An open head or tail says that the
        text goes on there; None comes for what cannot be told without the rest.
        """
        coded, n = self.coded(text), len(text)
        low, high = own or (0, n + 1)
        begins, known = self._begins(coded, low, head_open)
        if not known:
            yield None
            return
        last: dict[int, tuple[int, list[int], int]] = {}
        covered = 0
        for j, marked in begins:
            if not low <= j < high:
                continue
            some = []
            for g in marked:
                end, alive = self._longest(g, coded, j, last)
                if alive and tail_open:
                    yield None
                if end > covered:
                    some.append((-end, g))
            for minus_end, g in sorted(some):
                end, (name, lead, located) = -minus_end, self.grammars[g]
                if end <= covered:
                    continue
                starts, open_ = self._starts(g, coded, j) if located else ([j - lead], False)
                if head_open and (open_ or 0 in starts):
                    yield None
                for at in starts:
                    kept = accept(name, text, at, j - lead, end)
                    if kept is not None:
                        yield Found(name, j - lead, kept)
                        covered = max(covered, kept)
                        break

    def _longest(self, g: int, coded: bytes, j: int, last: dict[int, tuple[int, list[int], int]]) -> tuple[int, bool]:
        """The longest end of a value of ``g`` from ``j``, -1 for none, and whether it may go on behind the text."""
        m = self.values[g]
        table, marked = m.table, m.marked
        s, end, path, i, n = m.start, -1, [], j, len(coded)
        from_, before, before_end = last.get(g, (0, [], -1))
        reach = from_ + len(before)
        while i < n:
            t = table[s][coded[i]]
            s = t if t >= 0 else m.made(s, coded[i])
            if not s:
                last[g] = (j, path, end)
                return end, False
            i += 1
            if marked[s]:
                end = i
            # ``before[x]`` is the state behind character ``from_ + x``.
            if i <= reach and before[i - 1 - from_] == s:
                return max(end, before_end), reach == n
            path.append(s)
        last[g] = (j, path, end)
        return end, True

    def _starts(self, g: int, coded: bytes, j: int) -> tuple[list[int], bool]:
        """Where contexts of ``g`` that end at ``j`` begin, and whether one may begin before the text."""
        m, out = self.behind[g], []
        s, i = m.start, j
        while i:
            i -= 1
            t = m.table[s][coded[i]]
            s = t if t >= 0 else m.made(s, coded[i])
            if not s:
                return out, False
            if m.marked[s]:
                out.append(i)
        return out, True


LETTERS, DIGITS = string.ascii_letters, string.digits
ALNUM = LETTERS + DIGITS
