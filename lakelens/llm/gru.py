"""A gated recurrent unit with a class-factored softmax, in numpy: training by truncated backpropagation, scoring of whole texts."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

#: Words of the network, of which the last stands for all others, in classes of equal size, as many as a class has words.
WORDS, CLASSES, EMBED, STATE = 1024, 32, 24, 32
SIZE = WORDS // CLASSES
STEPS = 32
SHAPES = (WORDS + 1, EMBED), (EMBED, 3 * STATE), (3 * STATE,), (STATE, 3 * STATE), (STATE, CLASSES), (CLASSES,), (CLASSES, STATE, SIZE), (CLASSES, SIZE)


class Room:
    """Arrays by name whose memory is used again and again: fresh memory of this size costs more than the work in it."""

    def __init__(self, kind: type = np.float32) -> None:
        self.kind, self.held = np.dtype(kind), {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)

    def take(self, name: str, x: np.ndarray, at: np.ndarray, axis: int = 0) -> np.ndarray:
        return np.take(x, at, axis=axis, out=self(name, *x.shape[:axis], *at.shape, *x.shape[axis + 1 :]), mode="clip")


def by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of targets by class, where each stands in the flat outputs (of classes, of words), and the ends of the classes."""
    k = (target // SIZE).astype(np.uint8)
    order = np.argsort(k, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(k, minlength=CLASSES))])
    row, y = np.arange(len(order)) * SIZE, target[order]
    return order, np.stack([row + y // SIZE, row + y % SIZE + len(order) * SIZE]), ends


def sums_of_runs(x: np.ndarray, first: np.ndarray, long: int = 16) -> np.ndarray:
    """Of the rows from each `first` to the next; long runs by products, as reduceat walks down the columns."""
    n = np.diff(first, append=len(x))
    out = np.empty((len(first), x.shape[1]), x.dtype)
    short = n < long
    if short.any():
        at = np.flatnonzero(np.repeat(short, n))
        out[short] = np.add.reduceat(x[at], np.cumsum(n[short]) - n[short], axis=0)
    ones = np.ones(int(n.max()), x.dtype)
    for k in np.flatnonzero(~short):
        i = first[k]
        np.matmul(ones[: n[k]], x[i : i + n[k]], out=out[k])
    return out


@dataclass
class Net:
    embed: np.ndarray  # a row for each word and one for the start
    into: np.ndarray
    bias: np.ndarray
    again: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) * s[-2] ** -0.5).astype(np.float32)
        zero = lambda *s: np.zeros(s, np.float32)
        return cls(draw(WORDS + 1, EMBED), draw(EMBED, 3 * STATE), zero(3 * STATE), draw(STATE, 3 * STATE), draw(STATE, CLASSES) * np.float32(0.1), zero(CLASSES), draw(CLASSES, STATE, SIZE) * np.float32(0.1), zero(CLASSES, SIZE))

    def with_counts(self, counts: np.ndarray) -> Net:
        """Biases at the words' own frequencies, from which the network then departs."""
        c = (counts + 1.0).reshape(CLASSES, SIZE)
        self.group_bias[:] = np.log(c.sum(1) / c.sum())
        self.word_bias[:] = np.log(c / c.sum(1, keepdims=True))
        return self

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def size(cls) -> int:
        return sum(math.prod(s) for s in SHAPES)

    @classmethod
    def views(cls, flat: np.ndarray) -> Net:
        """The arrays within one."""
        ends = np.cumsum([math.prod(s) for s in SHAPES])
        return cls(*[flat[e - math.prod(s) : e].reshape(s) for s, e in zip(SHAPES, ends, strict=True)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Net:
        return cls.views(flat.astype(np.float32))

    def gates(self, words: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """What words add to the three gates, and what the state does: (3, words, STATE) and (3, STATE, STATE), negated for the first two."""
        table = (self.embed[words] @ self.into + self.bias).reshape(-1, 3, STATE).transpose(1, 0, 2).copy()
        again = self.again.reshape(STATE, 3, STATE).transpose(1, 0, 2).copy()
        np.negative(table[:2], out=table[:2])
        np.negative(again[:2], out=again[:2])
        return table, again

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The plain unit, for single steps: next states, z, r, n; `advance` does the same without fresh memory."""
        u = h @ self.again
        z, r = (1 / (1 + np.exp(-x[:, i : i + STATE] - u[:, i : i + STATE])) for i in (0, STATE))
        n = np.tanh(x[:, 2 * STATE :] + r * u[:, 2 * STATE :])
        return n + z * (h - n), z, r, n

    @staticmethod
    def advance(x: np.ndarray, again: np.ndarray, h: np.ndarray, u: np.ndarray, zr: np.ndarray, q: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
        """The next states into `out`; x are the words' shares of the gates, the others are filled: the state's shares, z and r, r times the state's share of n, n."""
        np.matmul(h, again, out=u)
        np.add(u[:2], x[:2], out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], u[2], out=q)
        np.add(q, x[2], out=n)
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[0]
        out += n

    def bounded(self) -> bool:
        """Whether exp of any output stays within single precision without a shift, as states are between -1 and 1."""
        most = lambda w, b: (np.abs(w).sum(-2) + np.abs(b)).max()
        return bool(max(most(self.group, self.group_bias), most(self.word, self.word_bias)) < 60)

    def outputs(self, s: np.ndarray, ends: np.ndarray, room: Room) -> np.ndarray:
        """(2, states, SIZE): outputs for the classes and for the words of the class, of states sorted by class; shifted by row where exp asks for it."""
        out = room("outputs", 2, len(s), SIZE)
        np.matmul(s, self.group, out=out[0])
        out[0] += self.group_bias
        for c in np.flatnonzero(np.diff(ends)):
            i, j = ends[c], ends[c + 1]
            np.matmul(s[i:j], self.word[c], out=out[1, i:j])
            out[1, i:j] += self.word_bias[c]
        if not self.bounded():
            out -= out.max(-1, keepdims=True)
        return out

    def log_probability(self, h: np.ndarray, target: np.ndarray, room: Room | None = None) -> np.ndarray:
        """Of each target after its state: class, then word in it."""
        room = room or Room(self.embed.dtype)
        order, at, ends = by_class(target)
        x = self.outputs(room.take("sorted", h, order), ends, room)
        got = np.take(x.reshape(-1), at).sum(0)
        np.exp(x, out=x)
        got -= np.log(x @ np.ones(SIZE, x.dtype)).sum(0)
        out = np.empty_like(got)
        out[order] = got
        return out

    def score(self, ids: np.ndarray, offsets: np.ndarray, side: int = 512) -> np.ndarray:
        """Natural log-probability of each sequence ids[offsets[i]:offsets[i + 1]].

        `side` sequences run side by side, longest first, in windows of STEPS; states go on from window to
        window, so every token is read after all that precede it, however long the text.
        """
        n = np.diff(offsets)
        out, (table, again), room = np.zeros(len(n)), self.gates(), Room()
        order = np.argsort(-n, kind="stable")
        for a in range(0, len(order), side):
            part = order[a : a + side]
            out[part] = self._score(ids, offsets[:-1][part], n[part], table, again, room)
        return out

    def _score(self, ids: np.ndarray, starts: np.ndarray, n: np.ndarray, table: np.ndarray, again: np.ndarray, room: Room) -> np.ndarray:
        out, at, live = np.zeros(len(n)), 0, len(n)
        states, u, zr, new = (room(name, x, live, STATE) for name, x in (("states", STEPS + 1), ("u", 3), ("zr", 2), ("new", 1)))
        states[0] = 0
        while True:
            live = int(np.searchsorted(-n[:live], -at, side="left"))  # longer than `at`
            if live == 0:
                return out
            steps = min(STEPS, int(n[0]) - at)
            t = at + np.arange(steps)
            on = t[:, None] < n[None, :live]
            place = np.where(on, starts[:live] + t[:, None], 0)
            xs = room.take("xs", table, np.where(t[:, None] > 0, ids[np.maximum(place - 1, 0)], WORDS), 1)
            for i, rows in enumerate(on.sum(1)):  # a text that has ended needs no states
                self.advance(xs[:, i, :rows], again, states[i, :rows], u[:, :rows], zr[:, :rows], new[0, :rows], new[0, :rows], states[i + 1, :rows])
            i, owner = np.nonzero(on)
            p = self.log_probability(room.take("flat", states.reshape(-1, STATE), (i + 1) * len(n) + owner), ids[place[i, owner]], room)
            out += np.bincount(owner, weights=p, minlength=len(out))
            states[0, :live] = states[steps, :live]
            at += steps

    def learn(self, before: np.ndarray, target: np.ndarray, on: np.ndarray, h: np.ndarray, into: np.ndarray | None = None, room: Room | None = None) -> tuple[float, list[np.ndarray], np.ndarray]:
        """Loss, gradients and last states over a window of (rows, steps); gradients stop at its beginning and are written to the zeros of `into`.

        `on` holds for the first steps of a row; the last state of a row that ends within the window means nothing.
        """
        rows, steps = before.shape
        kind, b = self.embed.dtype, before.T.ravel()
        room = room or Room(kind)
        sorted_ = np.argsort(b.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(b[sorted_], prepend=-1))
        words = b[sorted_[first]]
        number = np.empty(len(b), np.int64)
        number[sorted_] = np.repeat(np.arange(len(words)), np.diff(first, append=len(b)))
        table, again = self.gates(words)
        xs = room.take("xs", table, number, 1).reshape(3, steps, rows, STATE)
        u, zr, states = room("u", 3, rows, STATE), room("zr", 2, steps, rows, STATE), room("states", steps + 1, rows, STATE)
        q, new = (room(name, steps, rows, STATE) for name in ("q", "new"))
        states[0] = h
        for t in range(steps):
            self.advance(xs[:, t], again, states[t], u, zr[:, t], q[t], new[t], states[t + 1])
        place = np.flatnonzero(on.T)
        order, at, ends = by_class(target.T.ravel()[place])
        place = place[order]
        s, m = room.take("sorted", states[1:].reshape(-1, STATE), place), max(1, len(place))
        g = Net.views(np.zeros(self.size(), kind) if into is None else into)
        d = self.outputs(s, ends, room)
        got = np.take(d.reshape(-1), at)
        np.exp(d, out=d)
        whole = d @ np.ones(SIZE, kind)
        loss = np.log(whole).sum() - got.sum()
        d *= (1 / (whole * m))[:, :, None]
        d.reshape(-1)[at] -= kind.type(1 / m)
        np.matmul(s.T, d[0], out=g.group)
        ones = np.ones(len(s), kind)
        np.matmul(ones, d[0], out=g.group_bias)
        ds = room("ds", len(place) + 1, STATE)
        ds[-1] = 0  # for steps that have no target
        np.matmul(d[0], self.group.T, out=ds[:-1])
        for c in np.flatnonzero(np.diff(ends)):
            i, j = ends[c], ends[c + 1]
            np.matmul(s[i:j].T, d[1, i:j], out=g.word[c])
            np.matmul(ones[i:j], d[1, i:j], out=g.word_bias[c])
            ds[i:j] += d[1, i:j] @ self.word[c].T
        back_at = np.full(rows * steps, len(place))
        back_at[place] = np.arange(len(place))
        dh_out = room.take("dh", ds, back_at).reshape(steps, rows, STATE)
        # what a state's gradient is multiplied by on its way to z, r, the state's share of n and n
        z, r = zr
        way, left = room("way", 4, steps, rows, STATE), room("left", steps, rows, STATE)
        np.subtract(1, z, out=left)
        np.multiply(new, new, out=way[3])
        np.subtract(1, way[3], out=way[3])
        way[3] *= left
        np.subtract(states[:-1], new, out=way[0])
        left *= z
        way[0] *= left
        np.multiply(way[3], r, out=way[2])
        np.subtract(1, r, out=left)
        left *= q
        np.multiply(way[3], left, out=way[1])
        back = self.again.reshape(STATE, 3, STATE).transpose(1, 2, 0).copy()
        dh = np.zeros((rows, STATE), kind)
        for t in reversed(range(steps)):
            dh += dh_out[t]
            np.multiply(dh, way[:, t], out=way[:, t])
            np.matmul(way[:3, t], back, out=u)
            dh *= z[t]
            for x in u:
                dh += x
        flat = way.reshape(4, -1, STATE)
        np.matmul(states[:-1].reshape(-1, STATE).T, flat[:3], out=g.again.reshape(STATE, 3, STATE).transpose(1, 0, 2))
        # one row for each word that stands before another
        sums = np.concatenate([sums_of_runs(room.take("gate", flat[x], sorted_), first) for x in (0, 1, 3)], axis=1)
        g.into[:], g.bias[:], g.embed[words] = self.embed[words].T @ sums, sums.sum(0), sums @ self.into.T
        return float(loss), g.arrays(), states[-1].copy()


class Adam:
    """Works on all weights as one array, of which the network's arrays become views."""

    def __init__(self, net: Net, rate: float = 1e-2) -> None:
        self.w, self.rate, self.t = net.flat(), rate, 0
        for f, a in zip(fields(Net), Net.views(self.w).arrays(), strict=True):
            setattr(net, f.name, a)
        self.m, self.v, self.a, self.b = (np.zeros_like(self.w) for _ in range(4))

    def apply(self, g: np.ndarray, share: float = 1.0) -> None:
        """A step, shorter where fewer tokens speak for it; g is used up."""
        self.t += 1
        m, v, a, b = self.m, self.v, self.a, self.b
        g *= np.float32(min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-12)))
        m += np.multiply(np.subtract(g, m, out=a), np.float32(0.1), out=a)
        np.multiply(g, g, out=g)
        v += np.multiply(np.subtract(g, v, out=a), np.float32(0.01), out=a)
        np.sqrt(np.multiply(v, np.float32(1 / (1 - 0.99**self.t)), out=b), out=b)
        b += np.float32(1e-6)
        np.multiply(m, np.float32(self.rate * share / (1 - 0.9**self.t)), out=a)
        self.w -= np.divide(a, b, out=a)


def train(net: Net, ids: np.ndarray, offsets: np.ndarray, adam: Adam, rows: int = 256) -> int:
    """One pass over the sequences, `rows` at a time side by side; states are carried from window to window.

    Sequences wait in groups of like length, the longest first, the others in mixed order; in each window
    the next ones take the places of those that have ended. A window counts by its tokens.
    """
    n = np.diff(offsets)
    seen, grads, room = 0, np.empty(Net.size(), np.float32), Room()
    order = np.argsort(-n, kind="stable")
    groups = [order[a : a + rows] for a in range(0, len(order), rows)]
    waiting = np.concatenate([order[:0], *groups[:1], *(groups[g] for g in np.random.default_rng(len(order)).permutation(np.arange(1, len(groups))))])
    waiting = waiting[n[waiting] > 0]
    live, at, h = waiting[:0], np.zeros(0, np.int64), np.zeros((0, STATE), np.float32)
    while len(live) or len(waiting):
        new, waiting = np.split(waiting, [max(0, rows - len(live))])
        live, at, h = np.concatenate([live, new]), np.concatenate([at, np.zeros(len(new), np.int64)]), np.concatenate([h, np.zeros((len(new), STATE), np.float32)])
        t = at[:, None] + np.arange(min(STEPS, int((n[live] - at).max())))
        on = t < n[live][:, None]
        place = np.where(on, offsets[live][:, None] + t, 0)
        before = np.where(t > 0, ids[np.maximum(place - 1, 0)], WORDS)
        grads[:] = 0
        _, _, h = net.learn(before, ids[place], on, h, grads, room)
        tokens = int(on.sum())
        adam.apply(grads, tokens / (min(rows, len(order)) * STEPS))
        seen += tokens
        at += t.shape[1]
        stay = at < n[live]
        live, at, h = live[stay], at[stay], h[stay]
    return seen
