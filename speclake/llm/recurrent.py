"""A gated recurrent language model with a class-factored softmax, in numpy.

Symbols are numbers: ``0 .. words - 1`` are frequent words, in classes of
``width`` words by rank, and ``words .. words + rare - 1`` stand for all other
words, each a class of its own whose members share its probability by a
distribution the model is not concerned with.  So

    log p(symbol | past) = log p(class | state) + log p(word | class, state),

and a step costs (classes + width) outputs instead of one per word.

Several texts run side by side in *lanes*.  A lane reads text after text; at a
text's start its state is zero, and otherwise the state goes on from window to
window, whatever the text's length.  Texts are taken from a stream, the longest
of those at hand first, so that few lanes are left waiting for a long one; no
more is held than a text per lane and ``POOL`` symbols.  In training, gradients go back to the
window's start only (truncated backpropagation through time), and a text of more
than ``PART`` symbols is read in parts, side by side, each from a zero state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np

POOL = 1 << 21
PART = 1 << 10
AHEAD = 16

Parameters = dict[str, np.ndarray]


class Shape(NamedTuple):
    words: int  # frequent words; number 0 ends a text
    rare: int  # classes of other words
    width: int = 32  # words of a class
    state: int = 16

    @property
    def classes(self) -> int:
        """Classes of frequent words."""
        return -(-self.words // self.width)

    @property
    def symbols(self) -> int:
        return self.words + self.rare


def initial(shape: Shape, counts: np.ndarray, seed: int = 7) -> Parameters:
    """Parameters whose outputs are the symbols' own frequencies, with small random weights."""
    rng = np.random.default_rng(seed)
    h, c, w = shape.state, shape.classes, shape.width

    def weights(*size: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, size).astype(np.float32)

    padded = np.full(c * w, -30.0)
    padded[: shape.words] = np.log(counts[: shape.words] + 0.5)
    inside = padded.reshape(c, w)
    peak = inside.max(axis=1)
    mass = peak + np.log(np.exp(inside - peak[:, None]).sum(axis=1))
    outer = np.concatenate((mass, np.log(counts[shape.words :] + 0.5)))
    # Every class starts from its own mean, so that its weights learn small differences.
    return {
        "input": weights(shape.symbols, 3 * h, scale=0.3),  # update, reset, new state
        "again": weights(3 * h, h, scale=h**-0.5),
        "reset_bias": np.zeros((h, 1), np.float32),
        "outer": weights(c + shape.rare, h, scale=0.05),
        "outer_bias": (outer - outer.max()).astype(np.float32)[:, None],
        "inner": weights(c, w, h, scale=0.05),
        "inner_bias": (inside - peak[:, None]).astype(np.float32)[:, :, None],
    }


def flat(parameters: Parameters) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parameters.values()])


def unflat(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for name, p in like.items():
        out[name] = values[at : at + p.size].reshape(p.shape).astype(np.float32)
        at += p.size
    return out


class Window(NamedTuple):
    """Some steps of all lanes.  Lanes that go on for longer come first."""

    order: np.ndarray  # the lanes' numbers in the window before
    read: np.ndarray  # [step, lane]: the symbol read
    wanted: np.ndarray  # the symbol to foretell
    active: np.ndarray  # lanes that go on, by step
    texts: np.ndarray  # [step, lane]: place of the text in ``keys``
    keys: list  # texts of this window
    ended: list  # those that end in it


def _longest_first(texts: Iterable[tuple[object, np.ndarray]]) -> Iterator[tuple[object, np.ndarray]]:
    """The texts, the longest of ``POOL`` symbols at hand first."""
    heap, size = [], 0
    for number, (key, symbols) in enumerate(texts):
        heapq.heappush(heap, (-len(symbols), number, key, symbols))
        size += len(symbols)
        while size > POOL:
            n, _, key, symbols = heapq.heappop(heap)
            size += n
            yield key, symbols
    while heap:
        _, _, key, symbols = heapq.heappop(heap)
        yield key, symbols


def windows(texts: Iterable[tuple[object, np.ndarray]], many: int, steps: int) -> Iterator[Window]:
    """Deals texts (key, symbols; each ends with 0) to lanes, a lane's next text when one ends.

    Symbols of a text that fills the window are taken from all lanes at once, out of a
    table with the next ``AHEAD`` windows of every lane.
    """
    source = _longest_first(texts)
    # [key, symbols, place where the lane's row of ``ahead`` begins]
    running: list[list | None] = [None] * many
    ahead = np.zeros((many, 1 + AHEAD * steps), np.int32)  # behind the symbol before
    place, left = np.zeros((2, many), np.int64)
    span = np.arange(steps + 1)
    while True:
        read = np.zeros((len(running), steps), np.int32)
        wanted = np.zeros_like(read)
        owner = np.zeros_like(read)
        filled = np.full(len(running), steps)
        going = left > steps
        full = np.flatnonzero(going)
        both = ahead[full[:, None], place[full, None] + span]
        read[full], wanted[full] = both[:, :-1], both[:, 1:]
        owner[full] = np.arange(len(full))[:, None]
        place[full] += steps
        left[full] -= steps
        keys, ended = [running[lane][0] for lane in full.tolist()], []
        for lane in np.flatnonzero(~going).tolist():
            now, t = running[lane], 0
            if now is not None:
                now[2] += int(place[lane])
            while t < steps:
                if now is None:
                    following = next(source, None)
                    if following is None:
                        break
                    now = [*following, 0]
                key, symbols, at = now
                n = min(steps - t, len(symbols) - at)
                wanted[lane, t : t + n] = symbols[at : at + n]
                read[lane, t] = symbols[at - 1] if at else 0
                read[lane, t + 1 : t + n] = symbols[at : at + n - 1]
                owner[lane, t : t + n] = len(keys)
                keys.append(key)
                t += n
                now[2] += n
                if now[2] == len(symbols):
                    ended.append(key)
                    now = None
            running[lane] = now
            filled[lane] = t
            place[lane] = left[lane] = 0
            if now is not None:
                following = now[1][now[2] - 1 : now[2] + AHEAD * steps]
                ahead[lane, : len(following)] = following
                left[lane] = len(following) - 1
        if (filled == steps).all():
            order = np.arange(len(running))
            active = np.full(steps, len(running))
        else:
            order = np.argsort(-filled, kind="stable")
            order = order[filled[order] > 0]
            if not len(order):
                return
            running = [running[i] for i in order]
            ahead, place, left = ahead[order], place[order], left[order]
            read, wanted, owner = read[order], wanted[order], owner[order]
            active = np.searchsorted(-filled[order], -np.arange(steps), "left")
            active = active[active > 0]
        yield Window(
            order,
            *(np.ascontiguousarray(x.T[: len(active)]) for x in (read, wanted)),
            active,
            np.ascontiguousarray(owner.T[: len(active)]),
            keys,
            ended,
        )


class Space:
    """Arrays for a window of given size, used again and again.

    Lanes are the last axis, so all sums over states and outcomes run along
    whole rows of lanes.  What only backpropagation reads is kept of all steps to
    learn from, and of the last one otherwise.
    """

    def __init__(self, shape: Shape, steps: int, many: int, kind: type = np.float32, learn: bool = True):
        h, c, kept = shape.state, shape.classes + shape.rare, steps if learn else 1
        self.learn = learn
        self.state = np.zeros((h, many), kind)
        self.out = np.empty((steps, h, many), kind)
        self.before = np.empty((kept, h, many), kind)
        self.gates = np.empty((kept, 2 * h, many), kind)
        self.inner = np.empty((kept, h, many), kind)
        self.new = np.empty((kept, h, many), kind)
        self.past = np.empty((3 * h, many), kind)
        self.outer = np.empty((steps, c, many), kind)
        if learn:
            self.back = np.empty((steps, h, many), kind)
            # Gradients by place: new state as the input sees it, update, reset, new state as the past does.
            self.places = np.empty((steps, 4 * h, many), kind)

    def fitted(self, shape: Shape, window: Window) -> Space:
        """A space of half the lanes, once half of them have no more texts."""
        steps, _, many = self.out.shape
        if 2 * len(window.order) > many or many == 1:
            return self
        less = Space(shape, steps, many // 2, self.out.dtype.type, self.learn)
        less.state = self.state
        return less.fitted(shape, window)


def _sigmoid(x: np.ndarray) -> None:
    """Of twice the numbers, in place."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5


def _states(p: Parameters, space: Space, window: Window) -> None:
    """States after each step, and all that backpropagation needs.  Lanes that end go on as zeros."""
    _, h, many = space.out.shape
    state = np.zeros((h, many), space.out.dtype)
    state[:, : len(window.order)] = space.state[:, window.order]
    steps = len(window.active)
    space.before[:] = 0
    goes_on = (window.read != 0).astype(state.dtype)  # a text starts at zero
    weights, again = p["input"].copy(), p["again"].copy()
    weights[:, : 2 * h] *= 0.5  # half of what the gates are to see, once for all steps
    again[: 2 * h] *= 0.5
    kept = len(space.before)
    for t, n in enumerate(window.active.tolist()):
        k = t % kept
        before = space.before[k, :, :n]
        np.multiply(state[:, :n], goes_on[t, :n], out=before)
        own = weights.take(window.read[t, :n], axis=0).T
        past = np.matmul(again, before, out=space.past[:, :n] if n == many else None)
        gates, inner, new = space.gates[k, :, :n], space.inner[k, :, :n], space.new[k, :, :n]
        np.add(own[: 2 * h], past[: 2 * h], out=gates)
        _sigmoid(gates)
        np.add(past[2 * h :], p["reset_bias"], out=inner)
        np.multiply(gates[h:], inner, out=new)
        new += own[2 * h :]
        np.tanh(new, out=new)
        state = space.out[t]
        state[:, n:] = 0
        here = state[:, :n]
        np.subtract(before, new, out=here)
        here *= gates[:h]
        here += new
    space.state = state.copy()


def _by_class(shape: Shape, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the frequent words among the symbols, by class, and the classes' borders."""
    frequent = np.flatnonzero((symbols < shape.words) & (symbols >= 0))
    classes = symbols[frequent] // shape.width
    order = frequent[np.argsort(classes.astype(np.uint16), kind="stable")]
    return order, np.concatenate(([0], np.cumsum(np.bincount(classes, minlength=shape.classes))))


def _classes(shape: Shape, symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < shape.words, symbols // shape.width, symbols - shape.words + shape.classes)


def _exponentials(x: np.ndarray, axis: int) -> np.ndarray:
    """Exponentials in place and their sums along an axis."""
    if x.size and x.max() > 60:  # a look at all is cheaper than one per column
        x -= x.max(axis=axis, keepdims=True)
    np.exp(x, out=x)
    return x.sum(axis=axis)


def _outputs(p: Parameters, shape: Shape, space: Space, window: Window, learn: bool) -> tuple[np.ndarray, Parameters]:
    """Natural log of each symbol's probability, [step, lane].

    To learn from them, gradients of the outputs' parameters come along, and
    ``space.back`` holds those of the states.  Places behind a lane's end count
    for nothing.
    """
    steps, many = len(window.active), space.out.shape[2]
    on = np.arange(many)[None, :] < window.active[:, None]
    symbols = np.zeros((steps, many), np.int64)
    symbols[:, : window.wanted.shape[1]] = window.wanted
    out, outer = space.out[:steps], space.outer[:steps]
    np.matmul(p["outer"], out, out=outer)
    outer += p["outer_bias"]
    sums = _exponentials(outer, 1)
    step, lane = np.indices((steps, many), sparse=True)
    wanted = (step * outer.shape[1] + _classes(shape, symbols)) * many + lane
    all_outer = outer.reshape(-1)
    found = np.log(np.maximum(all_outer.take(wanted) / sums, 1e-35)).astype(np.float64)
    g: Parameters = {}
    if learn:
        outer *= (on / sums)[:, None, :].astype(outer.dtype)
        all_outer[wanted] -= on
        g["outer"] = np.matmul(outer, out.transpose(0, 2, 1)).sum(axis=0)
        g["outer_bias"] = outer.sum(axis=2).sum(axis=0)[:, None]
        np.matmul(p["outer"].T, outer, out=space.back[:steps])
        g["inner"], g["inner_bias"] = np.zeros_like(p["inner"]), np.zeros_like(p["inner_bias"])
    rows = out.transpose(0, 2, 1).reshape(-1, shape.state)
    words = np.where(on, symbols, -1).ravel()
    order, borders = _by_class(shape, words)
    rows, numbers = rows.take(order, axis=0), words[order] % shape.width
    inside = np.ones(steps * many, outer.dtype)
    chances, back = np.empty(len(order), outer.dtype), np.empty_like(rows)
    every = np.arange(int(np.diff(borders).max(initial=0)))
    for k, (start, end) in enumerate(pairwise(borders.tolist())):
        if start == end:
            continue
        mine = rows[start:end]
        inner = np.matmul(p["inner"][k], mine.T)
        inner += p["inner_bias"][k]
        sums = _exponentials(inner, 0)
        wanted = numbers[start:end] * (end - start) + every[: end - start]
        all_inner = inner.reshape(-1)
        np.divide(all_inner.take(wanted), sums, out=chances[start:end])
        if learn:
            inner *= 1 / sums
            all_inner[wanted] -= 1
            g["inner"][k] = inner @ mine
            g["inner_bias"][k] = inner.sum(axis=1)[:, None]
            back[start:end] = (p["inner"][k].T @ inner).T
    inside[order] = chances
    found += np.log(np.maximum(inside, 1e-35)).reshape(found.shape)
    if learn:
        more = np.zeros((steps * many, shape.state), outer.dtype)
        more[order] = back
        space.back[:steps] += more.reshape(steps, many, -1).transpose(0, 2, 1)
    found *= on
    return found, g


def score(
    p: Parameters, shape: Shape, texts: Iterable[tuple[object, np.ndarray]], many: int = 256, steps: int = 32
) -> Iterator[tuple[object, float]]:
    """(key, natural log of the text's probability), each text when it has been read to its end."""
    space = Space(shape, steps, many, learn=False)
    total: dict = {}
    for window in windows(texts, many, steps):
        space = space.fitted(shape, window)
        _states(p, space, window)
        found, _ = _outputs(p, shape, space, window, learn=False)
        lanes = window.texts.shape[1]
        sums = np.bincount(window.texts.ravel(), found[:, :lanes].ravel(), len(window.keys))
        for key, value in zip(window.keys, sums.tolist(), strict=True):
            total[key] = total.get(key, 0.0) + value
        for key in window.ended:
            yield key, total.pop(key)


def gradients(p: Parameters, shape: Shape, space: Space, window: Window) -> tuple[int, float, Parameters]:
    """Symbols of a window, their mean loss, and its gradients; ``space.state`` goes on."""
    h = shape.state
    steps = len(window.active)
    n = int(window.active.sum())
    _states(p, space, window)
    found, g = _outputs(p, shape, space, window, learn=True)
    ahead = np.zeros_like(space.state)  # gradient that comes from the next step
    symbols = np.zeros((steps, ahead.shape[1]), np.int64)
    symbols[:, : window.read.shape[1]] = window.read
    goes_on = (symbols != 0).astype(ahead.dtype)
    weights = p["again"].T
    for t in range(steps - 1, -1, -1):
        before, new = space.before[t], space.new[t]
        update, reset = space.gates[t, :h], space.gates[t, h:]
        m = window.active[t]
        if m < ahead.shape[1]:  # lanes that are over: nothing was read there
            for x in (new, space.gates[t], space.inner[t]):
                x[:, m:] = 0
        d_new, d_update, d_reset, d_inner = space.places[t].reshape(4, h, -1)
        total = space.back[t]
        total += ahead
        np.multiply(total, update, out=ahead)
        np.subtract(total, ahead, out=d_new)
        np.multiply(new, new, out=d_reset)
        d_reset *= d_new
        d_new -= d_reset
        np.subtract(before, new, out=d_update)
        d_update *= ahead
        np.multiply(d_update, update, out=d_reset)
        d_update -= d_reset
        np.multiply(d_new, reset, out=d_inner)
        np.subtract(1, reset, out=d_reset)
        d_reset *= d_inner
        d_reset *= space.inner[t]
        ahead += weights @ space.places[t, h:]
        ahead *= goes_on[t]
    g["input"] = np.roll(_gathered(symbols, space.places[:steps, : 3 * h], p["input"]), -h, axis=1)
    g["again"] = np.matmul(space.places[:steps, h:], space.before[:steps].transpose(0, 2, 1)).sum(axis=0)
    g["reset_bias"] = space.places[:steps, 3 * h :].sum(axis=2).sum(axis=0)[:, None]
    for x in g.values():
        x /= n
    return n, -float(found.sum()) / n, g


def _gathered(symbols: np.ndarray, columns: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Sums of the columns [step, number, lane] of equal symbols."""
    symbols = symbols.ravel()
    rows = columns.transpose(1, 0, 2).reshape(like.shape[1], -1)
    return np.stack([np.bincount(symbols, row, len(like)) for row in rows], axis=1).astype(like.dtype)


class Adam:
    """Adam steps with the gradient's norm held to ``most``."""

    def __init__(self, p: Parameters, rate: float, most: float = 1.0):
        self.rate, self.most, self.turn = rate, most, 0
        self.mean, self.square = np.zeros((2, flat(p).size), flat(p).dtype)

    def step(self, p: Parameters, g: Parameters) -> None:
        self.turn += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        by = min(1.0, self.most / max(norm, 1e-12))
        rate = self.rate * float(np.sqrt(1 - 0.999**self.turn)) / (1 - 0.9**self.turn)
        x = flat({name: g[name] for name in p})  # all parameters at once
        x *= by
        self.mean += 0.1 * (x - self.mean)
        x *= x
        self.square += 0.001 * (x - self.square)
        now, at = rate * self.mean / (np.sqrt(self.square) + 1e-8), 0
        for y in p.values():
            y -= now[at : at + y.size].reshape(y.shape)
            at += y.size


def train(
    p: Parameters, shape: Shape, adam: Adam, texts: Iterable[tuple[object, np.ndarray]], many: int = 256, steps: int = 16
) -> tuple[int, float]:
    """One pass over texts, parameters changed in place; symbols met and the sum of their losses."""
    space = Space(shape, steps, many)
    met, total = 0, 0.0
    parts = ((key, symbols[i : i + PART]) for key, symbols in texts for i in range(0, len(symbols), PART))
    for window in windows(parts, many, steps):
        space = space.fitted(shape, window)
        n, loss, g = gradients(p, shape, space, window)
        adam.step(p, g)
        met, total = met + n, total + loss * n
    return met, total
