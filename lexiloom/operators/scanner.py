"""Finding many byte strings at once: an automaton over bytes with a dense table of next moves.

A state is a prefix of some string; the state after a byte is the longest suffix of what was read that is such a prefix.
The table is built one depth at a time. Texts are read in lanes, many at a time: a state depends on no more bytes than the
longest string has, so a text may be cut anywhere if each part starts that many bytes early."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a text that one lane reads.
LANE = 512


@dataclass(frozen=True)
class Scanner:
    moves: np.ndarray  #: (states, 256): the next state
    longest: int
    first: np.ndarray  #: outputs of state s are output[first[s]:first[s + 1]]
    output: np.ndarray  #: places of strings in the list that was given

    @property
    def states(self) -> int:
        return len(self.moves)


def build(strings: list[bytes]) -> Scanner:
    """The automaton of distinct strings; an empty one is an error."""
    if any(not s for s in strings):
        raise ValueError("an empty string is everywhere")
    if len(set(strings)) < len(strings):
        raise ValueError("strings repeat")
    longest = max(map(len, strings), default=0)
    by_prefix: dict[bytes, int] = {b"": 0}
    levels: list[list[bytes]] = [[b""]]
    for depth in range(1, longest + 1):
        level = sorted({s[:depth] for s in strings if len(s) >= depth})
        by_prefix |= {p: i for i, p in enumerate(level, len(by_prefix))}
        levels.append(level)
    moves = np.zeros((len(by_prefix), 256), np.int32)
    fail = np.zeros(len(by_prefix), np.int32)
    start = 1
    for depth, level in enumerate(levels[1:], 1):
        state = np.arange(start, start + len(level), dtype=np.int32)
        parent = np.fromiter((by_prefix[p[:-1]] for p in level), np.int32, len(level))
        byte = np.fromiter((p[-1] for p in level), np.int32, len(level))
        if depth > 1:
            fail[state] = moves[parent, byte]  # still the move of what the parent falls back to
        moves[parent, byte] = state
        start += len(level)
        moves[state] = moves[fail[state]]  # complete: a fallback is shorter, so its children are named
    own = np.full(len(by_prefix), -1, np.int64)
    for i, s in enumerate(strings):
        own[by_prefix[s]] = i
    found: list[list[int]] = []
    for s in range(len(by_prefix)):
        found.append(([int(own[s])] if own[s] >= 0 else []) + (found[fail[s]] if s else []))
    first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    return Scanner(moves, longest, first, np.array([i for x in found for i in x], np.int64))


def state_trace(scanner: Scanner, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The state after each byte of all texts, one after the other, and where each text ends."""
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    total = int(ends[-1]) if len(ends) else 0
    buf = np.frombuffer(b"".join(texts), np.uint8)
    trace = np.zeros(total, np.int32)
    if not total or scanner.states == 1:
        return trace, ends
    begins = ends - np.fromiter((len(t) for t in texts), np.int64, len(texts))
    lanes = -(-(ends - begins) // LANE)
    of = np.repeat(np.arange(len(texts)), lanes)
    lane = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    count_from = begins[of] + lane * LANE
    until = np.minimum(count_from + LANE, ends[of])
    at = np.maximum(count_from - (scanner.longest - 1), begins[of])
    order = np.argsort(at - until, kind="stable")  # the longest first, so lanes that are done are the last
    at, until, count_from = at[order], until[order], count_from[order]
    steps = until - at
    flat = scanner.moves.reshape(-1)
    state = np.zeros(len(at), np.int32)
    active = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")
    warm = int((count_from - at).max(initial=0))
    for i, n in enumerate(active.tolist()):
        place = at[:n] + i
        state = flat[(state[:n].astype(np.int64) << 8) + buf[place]]
        if i >= warm:
            trace[place] = state
        else:
            real = place >= count_from[:n]
            trace[place[real]] = state[real]
    return trace, ends


def state_counts(scanner: Scanner, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, state, n) of the states with outputs, in order of texts and states."""
    trace, ends = state_trace(scanner, texts)
    says = np.diff(scanner.first) > 0
    at = np.flatnonzero(says[trace])
    key, n = np.unique(np.searchsorted(ends, at, side="right") * scanner.states + trace[at], return_counts=True)
    text, state = np.divmod(key, scanner.states)
    return text, state, n


def search(scanner: Scanner, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, string, n): how often each string is found in each text, overlapping ones included."""
    text, state, n = state_counts(scanner, texts)
    many = scanner.first[state + 1] - scanner.first[state]
    before = np.cumsum(many) - many
    string = scanner.output[np.arange(int(many.sum())) - np.repeat(before - scanner.first[state], many)]
    key, back = np.unique(np.repeat(text, many) * max(1, len(scanner.output)) + string, return_inverse=True)
    total = np.bincount(back, weights=np.repeat(n, many), minlength=len(key)).astype(np.int64)
    return *np.divmod(key, max(1, len(scanner.output))), total
