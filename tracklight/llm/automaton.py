"""Finite automata over bytes, run over many texts at once and composed from their chunks.

A chunk of a text can't know the state that it is entered in, so it gives, for each state, the state that it leaves in and
how many units begin in it: a function that composes associatively. Chunks are cut into lanes of LANE bytes that numpy steps
through side by side; a lane's function, a chunk's and a text's are of one kind.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

LANE = 256


@dataclass(frozen=True)
class Automaton:
    """goes[state, byte] is the next state; begins[state, byte] whether a unit begins with this byte. The first state is 0."""

    goes: np.ndarray
    begins: np.ndarray

    @property
    def states(self) -> int:
        return len(self.goes)


def code_points() -> Automaton:
    """Units are the code points of UTF-8; the state is the number of bytes that still belong to one."""
    goes, begins = np.zeros((4, 256), np.uint8), np.zeros((4, 256), bool)
    for b in range(256):
        goes[0, b] = 3 if b >= 0xF0 else 2 if b >= 0xE0 else 1 if b >= 0xC0 else 0
    for s in (1, 2, 3):
        goes[s] = s - 1
    begins[0] = True
    return Automaton(goes, begins)


def words(space: bytes = b" \t\n\r\x0b\x0c") -> Automaton:
    """Units are words: runs of bytes other than ASCII white space."""
    goes, begins = np.ones((2, 256), np.uint8), np.zeros((2, 256), bool)
    goes[:, list(space)] = 0
    begins[0] = goes[0] == 1
    return Automaton(goes, begins)


def lines() -> Automaton:
    """Units are lines; a line feed ends its line."""
    goes, begins = np.ones((2, 256), np.uint8), np.zeros((2, 256), bool)
    goes[:, 0x0A] = 0
    begins[0] = True
    return Automaton(goes, begins)


def contains(patterns: Iterable[bytes]) -> tuple[Automaton, int]:
    """An automaton that looks for any of these patterns, and the state that it stays in once one was seen."""
    patterns = list(patterns)
    known = sorted({p[:k] for p in patterns for k in range(len(p))}, key=lambda x: (len(x), x))
    seen, number = len(known), {p: k for k, p in enumerate(known)}
    goes = np.zeros((seen + 1, 256), np.uint8)
    for prefix, k in number.items():
        for b in range(256):
            now = prefix + bytes([b])
            if any(now.endswith(p) for p in patterns):
                goes[k, b] = seen
            else:
                goes[k, b] = number[next(now[i:] for i in range(len(now) + 1) if now[i:] in number)]
    goes[seen] = seen
    return Automaton(goes, np.zeros_like(goes, bool)), seen


UNITS = {"code_point": code_points, "word": words, "line": lines}


def _lanes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in rows of LANE, how many of each row count, and each text's first row."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // LANE)
    first = np.concatenate([[0], np.cumsum(rows)])
    grid = np.zeros((int(first[-1]), LANE), np.uint8)
    flat = grid.reshape(-1)
    for t, at in zip(texts, first[:-1].tolist(), strict=True):
        flat[at * LANE : at * LANE + len(t)] = np.frombuffer(t, np.uint8)
    used = np.full(len(grid), LANE, np.int64)
    last = rows > 0
    used[first[1:][last] - 1] = (sizes - (rows - 1) * LANE)[last]
    return grid, used, first


def scan_lanes(own: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each lane's function, as next states and counts for all states, and each text's first lane."""
    grid, used, first = _lanes(texts)
    n, s = len(grid), own.states
    state, count = np.tile(np.arange(s, dtype=np.intp), (n, 1)), np.zeros((n, s), np.int64)
    goes, begins = own.goes.reshape(-1).astype(np.intp), own.begins.reshape(-1)
    counting, columns = bool(begins.any()), np.ascontiguousarray(grid.T).astype(np.intp)
    full = bool((used == LANE).all())
    for k in range(LANE if n else 0):
        at = state * 256 + columns[k][:, None]
        if full:
            state = goes[at]
            if counting:
                count += begins[at]
        else:
            live = (used > k)[:, None]
            if counting:
                count += begins[at] & live
            state = np.where(live, goes[at], state)
    return state, count, first


def compose(states: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions of texts from those of their lanes, in order; a text without lanes leaves states as they are."""
    n, s = len(first) - 1, states.shape[1]
    state, count = np.tile(np.arange(s), (n, 1)), np.zeros((n, s), np.int64)
    length = np.diff(first)
    for k in range(int(length.max(initial=0))):
        own = np.flatnonzero(length > k)
        lane, entered = first[own] + k, state[own]
        count[own] += np.take_along_axis(counts[lane], entered, 1)
        state[own] = np.take_along_axis(states[lane], entered, 1)
    return state, count


def scan(own: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, for each state that it may be entered in, the state that it leaves in and how many units begin."""
    return compose(*scan_lanes(own, texts))


def place(own: Automaton, text: bytes, entered: int, unit: int, lanes: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """The byte with which the unit of this number (from 0) begins, in a text that is entered in this state; its length if there are no more."""
    states, counts = lanes or scan_lanes(own, [text])[:2]
    state, left = entered, unit
    for k in range(len(states)):
        if counts[k, state] > left:
            for at in range(k * LANE, min(len(text), (k + 1) * LANE)):
                if own.begins[state, text[at]]:
                    if not left:
                        return at
                    left -= 1
                state = own.goes[state, text[at]]
        left -= counts[k, state]
        state = states[k, state]
    return len(text)
