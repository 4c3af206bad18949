"""Byte automata: a small regular-expression language, subset construction, minimisation, transition arrays.

Patterns know literals, ``\\xHH`` and ``\\.`` escapes, ``[...]`` classes, ``(a|b)`` groups and ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from operator import length_hint

import numpy as np

ALL = frozenset(range(256))


def _escape(p: str, i: int) -> tuple[int, int]:
    if p[i] == "x":
        return int(p[i + 1 : i + 3], 16), i + 3
    return ord(p[i]), i + 1


def parse(pattern: str):
    """Tree of ('set', bytes), ('cat', [..]), ('alt', [..]), ('rep', node, least, most or None)."""
    pos = 0

    def alternatives():
        nonlocal pos
        found = [sequence()]
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            found.append(sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence():
        parts = []
        while pos < len(pattern) and pattern[pos] not in "|)":
            parts.append(repeated(atom()))
        return ("cat", parts)

    def atom():
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c == "(":
            inner = alternatives()
            pos += 1
            return inner
        if c == "[":
            return ("set", byte_class())
        if c == "\\":
            code, pos = _escape(pattern, pos)
            return ("set", frozenset([code]))
        return ("set", frozenset([ord(c)]))

    def byte_class():
        nonlocal pos
        negated = pattern[pos] == "^"
        pos += negated
        codes: set[int] = set()
        while pattern[pos] != "]":
            low, pos = _escape(pattern, pos + 1) if pattern[pos] == "\\" else (ord(pattern[pos]), pos + 1)
            high = low
            if pattern[pos] == "-" and pattern[pos + 1] != "]":
                high, pos = _escape(pattern, pos + 2) if pattern[pos + 1] == "\\" else (ord(pattern[pos + 1]), pos + 2)
            codes.update(range(low, high + 1))
        pos += 1
        return ALL - codes if negated else frozenset(codes)

    def repeated(node):
        nonlocal pos
        while pos < len(pattern) and pattern[pos] in "?*+{":
            c = pattern[pos]
            pos += 1
            if c == "{":
                stop = pattern.index("}", pos)
                low, _, high = pattern[pos:stop].partition(",")
                least, most = int(low), int(high) if high else (None if "," in pattern[pos:stop] else int(low))
                pos = stop + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, least, most)
        return node

    return alternatives()


def mirrored(node):
    """The tree for the reversed language."""
    if node[0] == "cat":
        return ("cat", [mirrored(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [mirrored(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", mirrored(node[1]), *node[2:])
    return node


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Wire ``node`` behind ``start``; the state behind it."""
        if node[0] == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if node[0] == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if node[0] == "alt":
            end = self.state()
            for x in node[1]:
                self.free[self.add(x, self.copy(start))].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        end = self.state()
        self.free[start].append(end)
        if most is None:
            loop = self.copy(start)
            back = self.add(inner, loop)
            self.free[back] += [loop, end]
        for _ in range((most or least) - least):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end

    def copy(self, start: int) -> int:
        new = self.state()
        self.free[start].append(new)
        return new


def compile_rules(trees: list, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """One minimal automaton for all trees: next state [state, byte] and bit mask of accepted trees by state.

    State 0 starts. Unanchored: a tree may begin at any byte. Anchored: state -1 is replaced by a dead state.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        ends[nfa.add(tree, nfa.copy(root))] = 1 << k
    if not anchored:
        nfa.moves[root].append((ALL, root))

    def closed(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    sets = {s for moves in nfa.moves for s, _ in moves}
    marks = np.array([[b in s for s in sets] for b in range(256)]) if sets else np.zeros((256, 1), bool)
    _, first, group = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    group = group.reshape(-1)
    # Subset construction over the classes of bytes that no rule tells apart.
    start = closed([root])
    number, order, rows = {start: 0}, [start], []
    for subset in order:
        row = []
        for b in first:
            target = closed({t for x in subset for s, t in nfa.moves[x] if int(b) in s})
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    step = np.array(rows, dtype=np.int64)
    accept = np.array([sum({ends[x] for x in s if x in ends}) for s in order], dtype=np.int64)
    # Minimisation: split blocks until members of a block agree on the blocks that they reach.
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, leader = np.unique(block, return_index=True)
    renamed = np.empty(len(leader), dtype=np.int64)
    renamed[block[np.sort(leader)]] = np.arange(len(leader))  # in order of discovery, so that 0 starts
    small = np.empty((len(leader), len(first)), dtype=np.int64)
    small[renamed] = renamed[block[step[leader]]]
    masks = np.empty(len(leader), dtype=np.int64)
    masks[renamed] = accept[leader]
    return small[:, group].astype(np.int32), masks


class Hit:
    """Stands for an accepting state in the linked lists; not subscriptable, so that a plain scan loop stops there."""

    __slots__ = ("mask", "row")

    def __init__(self, mask: int):
        self.mask, self.row = mask, None


def linked(table: np.ndarray, masks: np.ndarray) -> list:
    """The arrays as lists of 256 next states each; accepting states are ``Hit`` objects that hold their list."""
    states = [Hit(m) if m else [] for m in masks.tolist()]
    for state, targets in zip(states, table.tolist(), strict=True):
        row = [states[t] for t in targets]
        if isinstance(state, Hit):
            state.row = row
        else:
            state.extend(row)
    return states


def accepted(state, data) -> list[tuple[int, int]]:
    """(index, mask) of each byte of ``data`` behind which the automaton accepts, from ``state`` on."""
    found, rest = [], iter(data)
    n = len(data)
    if isinstance(state, Hit):
        state = state.row
    while True:
        try:
            for b in rest:
                state = state[b]
            break
        except TypeError:  # the byte before b led to a Hit
            found.append((n - length_hint(rest) - 2, state.mask))
            state = state.row[b]
    if isinstance(state, Hit):
        found.append((n - 1, state.mask))
    return found
