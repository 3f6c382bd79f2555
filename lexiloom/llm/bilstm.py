"""A character-level bidirectional LSTM with CRF transitions, in numpy: training from labelled spans, and decoding.

Characters are ASCII codes, with one class for letters and one for other characters beyond. Labels are O and, for each
kind, B (first character) and I (further ones); I never follows anything but B or I of its kind. Gates open by a clipped
line and cells go through x / (1 + |x|), in training and decoding alike: the functions cost as much as all the rest where
they are tanh. A PAD closes all gates, so it leaves a zero state behind."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
N_LABELS = 1 + 2 * len(KINDS)
LETTER, OTHER, PAD, N_CHARS = 128, 129, 130, 131
_MASK = -1e4
SLOPE = np.float32(0.2)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(points, OTHER).astype(np.uint8)
    far = np.flatnonzero(points > 127)
    if len(far):
        kinds, which = np.unique(points[far], return_inverse=True)
        out[far] = np.array([LETTER if chr(c).isalpha() else OTHER for c in kinds.tolist()], np.uint8)[which]
    return out


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Masks of starts and of moves between labels."""
    start, move = np.zeros(N_LABELS, np.float32), np.zeros((N_LABELS, N_LABELS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        start[inside] = _MASK
        move[:, inside] = _MASK
        move[inside - 1, inside] = move[inside, inside] = 0
    return start, move


def opened(x: np.ndarray) -> np.ndarray:
    return np.clip(SLOPE * x + np.float32(0.5), 0, 1)


def bent(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Tagger:
    params: dict[str, np.ndarray]
    hidden: int

    def states(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction for a batch of windows (rows), and what going back needs."""
        h = self.hidden
        w, u = self.params["w" + way], self.params["u" + way]
        state, cell = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        out, kept = np.empty((len(x), x.shape[1], h), np.float32), []
        steps = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
        for t in steps:
            gate = w[x[:, t]] + state @ u
            s = opened(gate[:, : 3 * h])
            g = bent(gate[:, 3 * h :])
            new = s[:, :h] * g + s[:, h : 2 * h] * cell
            tc = bent(new)
            kept.append((t, s, g, cell, tc, state))
            cell, state = new, s[:, 2 * h :] * tc
            out[:, t] = state
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores by position, label and window (a row of x). Both directions go in one step; windows are the last axis, so
        that every gate is one run of memory."""
        h, (n, length) = self.hidden, x.shape
        gates = np.arange(4 * h)[:, None] < 3 * h
        slope, middle = np.where(gates, SLOPE, np.float32(1)), np.where(gates, np.float32(0.5), np.float32(0))
        w = [np.ascontiguousarray(self.params["w" + way].T * slope + middle) for way in "fb"]
        u = np.stack([self.params["u" + way].T * slope for way in "fb"])
        v = np.stack([self.params["v"][:h].T, self.params["v"][h:].T])
        at = np.ascontiguousarray(x.T).astype(np.intp)
        out = np.broadcast_to(self.params["c"][:, None], (length, N_LABELS, n)).copy()
        state, cell, size = (np.zeros((2, h, n), np.float32) for _ in range(3))
        gate, more = np.empty((2, 4 * h, n), np.float32), np.empty((2, 4 * h, n), np.float32)
        opening, new = gate[:, : 3 * h], gate[:, 3 * h :]
        for t in range(length):
            for k, place in enumerate((t, length - 1 - t)):
                np.take(w[k], at[place], axis=1, out=gate[k], mode="clip")
            gate += np.matmul(u, state, out=more)
            np.clip(opening, 0, 1, out=opening)
            np.abs(new, out=size)
            size += 1
            new /= size
            new *= gate[:, :h]
            cell *= gate[:, h : 2 * h]
            cell += new
            np.abs(cell, out=size)
            size += 1
            np.divide(cell, size, out=state)
            state *= gate[:, 2 * h : 3 * h]
            one = v @ state
            out[t] += one[0]
            out[length - 1 - t] += one[1]
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labels of each window. Moves are traced back only where a path beats that of O alone: the same sums in the
        same order tell this exactly, and ties go to O."""
        e = self.emissions(x)
        start, move = allowed()
        move = move + self.params["m"]
        best, none = e[0] + start[:, None], e[0, 0] + start[0]
        for t in range(1, len(e)):
            best = (best[:, None] + move[:, :, None]).max(axis=0) + e[t]
            none = (none + move[0, 0]) + e[t, 0]
        out = np.zeros(x.shape, np.int8)
        rows = np.flatnonzero(best.max(axis=0) > none)
        if len(rows):
            out[rows] = self._trace(e[:, :, rows].transpose(2, 0, 1), start, move)
        return out

    @staticmethod
    def _trace(e: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
        best = e[:, 0] + start
        back = np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            way = best[:, :, None] + move
            back[:, t] = way.argmax(axis=1)
            best = way.max(axis=1) + e[:, t]
        out = np.zeros(e.shape[:2], np.int8)
        out[:, -1] = best.argmax(axis=1)
        for t in range(e.shape[1] - 1, 0, -1):
            out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t : t + 1].astype(np.int64), axis=1)[:, 0]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood a window, and its gradient."""
        f, kept_f = self.states(x, "f")
        b, kept_b = self.states(x, "b")
        both = np.concatenate([f, b], axis=2)
        e = both @ self.params["v"] + self.params["c"]
        start, mask = allowed()
        move = mask + self.params["m"]
        n, length, _ = e.shape
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + start
        add = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for t in range(1, length):
            forward[:, t] = e[:, t] + add(forward[:, t - 1, :, None] + move, 1)
        for t in range(length - 2, -1, -1):
            backward[:, t] = add(move + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = add(forward[:, -1], 1)
        marginal = np.exp(forward + backward - total[:, None, None])
        pair = np.exp(forward[:, :-1, :, None] + move + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        gold = np.take_along_axis(e, y[:, :, None], axis=2).sum() + self.params["m"][y[:, :-1], y[:, 1:]].sum()
        de = marginal.copy()
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], axis=2) - 1, axis=2)
        seen = np.zeros_like(pair)
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad = {"m": (pair - seen) / n, "v": np.einsum("nth,ntl->hl", both, de) / n, "c": de.sum(axis=(0, 1)) / n}
        dboth = de @ self.params["v"].T
        for way, kept, dh in (("f", kept_f, dboth[:, :, : self.hidden]), ("b", kept_b, dboth[:, :, self.hidden :])):
            grad["w" + way], grad["u" + way] = self._back(x, way, kept, dh)
            grad["w" + way] /= n
            grad["u" + way] /= n
        return float(total.sum() - gold) / n, grad

    def _back(self, x: np.ndarray, way: str, kept: list, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, u = self.hidden, self.params["u" + way]
        du = np.zeros_like(u)
        dstate, dcell = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
        gates = np.empty((x.shape[1], len(x), 4 * h), np.float32)
        for t, s, g, cell, tc, before in reversed(kept):
            d = dh[:, t] + dstate
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dc = dcell + d * o * (1 - np.abs(tc)) ** 2
            moves = SLOPE * ((s > 0) & (s < 1))  # the slope of the gates' line, flat where it is clipped
            dgate = gates[t]
            dgate[:, :h], dgate[:, h : 2 * h], dgate[:, 2 * h : 3 * h] = dc * g, dc * cell, d * tc
            dgate[:, : 3 * h] *= moves
            dgate[:, 3 * h :] = dc * i * (1 - np.abs(g)) ** 2
            du += before.T @ dgate
            dstate, dcell = dgate @ u.T, dc * f
        which = np.zeros((x.size, N_CHARS), np.float32)
        which[np.arange(x.size), x.T.ravel()] = 1
        return which.T @ gates.reshape(x.size, 4 * h), du


def train(windows: np.ndarray, labels: np.ndarray, hidden: int = 12, steps: int = 500, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Tagger:
    """A tagger from windows of character codes and their labels, by Adam."""
    rng = np.random.default_rng(seed)
    shape = {"wf": (N_CHARS, 4 * hidden), "uf": (hidden, 4 * hidden), "wb": (N_CHARS, 4 * hidden), "ub": (hidden, 4 * hidden), "v": (2 * hidden, N_LABELS), "c": (N_LABELS,), "m": (N_LABELS, N_LABELS)}
    params = {k: (rng.normal(0, 0.3, s) if len(s) > 1 and k != "m" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    tagger = Tagger(params, hidden)
    closed = np.where(np.arange(4 * hidden) < 3 * hidden, np.float32(_MASK), np.float32(0))
    params["wf"][PAD] = params["wb"][PAD] = closed
    one, two = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}
    for step in range(1, steps + 1):
        at = rng.integers(0, len(windows), batch)
        _, grad = tagger.gradient(windows[at], labels[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * np.float32(min(1.0, 5 / (norm + 1e-9)))
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            params[k] -= (now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        params["wf"][PAD] = params["wb"][PAD] = closed
    return tagger
