"""A gated recurrent language model: the numbers, without Spark.

Tokens are 64-bit word ids whose low bits are a *tail class* (from the word's last two bytes).
The ``HEAD`` most frequent words have classes of ``WIDTH`` by rank; all other words belong to
their tail class. The output is factored: a softmax over classes, then, for head words, a
softmax inside the class, both from the GRU state; inside a tail class a word has its add-one
relative frequency in the training tokens. So every word, seen or not, has a probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

TAIL_BITS = 5
TAILS = 1 << TAIL_BITS
WIDTH = 64
HEAD_CLASSES = 32
HEAD = WIDTH * HEAD_CLASSES
HIDDEN = 32
WINDOW = 32  # steps of truncated backpropagation
LANES = 128  # documents that are trained side by side
SCORE_LANES = 384
SCORE_WINDOW = 32
RUN = 2048  # states whose classes are scored at once, so that they stay in cache
RATE = 0.1  # while all lanes are live
LAYERS = 8  # rows of a symbol that are added one by one
END = np.uint64(TAILS)  # the end token's id: hash 1, tail class 0

_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_is_space = np.zeros(256, bool)
_is_space[[9, 10, 11, 12, 13, 32]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list = []


def _power_tables(n: int):
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _MULT))), dtype=np.uint64)
            down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _MULT_INV))), dtype=np.uint64)
        _powers[:] = [up, down]
    return _powers


def word_ids(texts: list[bytes]) -> tuple:
    """(ids, lengths): the ids of all words of all texts, each text followed by END; lengths count it.

    A-Z are lower-cased, words end at ASCII white space. The hash of a word is polynomial, taken
    for all words at once from prefix sums.
    """
    raw = np.frombuffer(b" ".join(t.translate(_lower) for t in texts) + b" ", np.uint8)
    space = _is_space[raw]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ids = np.zeros(len(start), np.uint64)
    # powers repeat per block, so a block is a run of whole words; small ones stay in cache
    block = (1 << 16) - 1
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(stop, start[a] + block, side="right")))
            lo, hi = start[a], stop[b - 1]
            up, down = _power_tables(int(hi - lo) + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            h = (sums[stop[a:b] - lo] - sums[start[a:b] - lo]) * down[start[a:b] - lo]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            ids[a:b] = h
            a = b
        last = raw[stop - 1].astype(np.uint64) if len(stop) else np.zeros(0, np.uint64)
        before = np.where(stop - start > 1, raw[stop - 2], 0).astype(np.uint64) if len(stop) else last
        tail = ((last * np.uint64(31) + before * np.uint64(17)) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(TAILS)
    ids = (ids >> np.uint64(TAIL_BITS) << np.uint64(TAIL_BITS)) | tail
    ids = np.where(ids >> np.uint64(TAIL_BITS) <= 1, ids | np.uint64(1 << 63), ids)  # END stays alone
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.searchsorted(start, ends)
    out = np.full(len(ids) + len(texts), END, np.uint64)
    place = np.arange(len(ids)) + np.searchsorted(ends, start, side="right")
    out[place] = ids
    return out, np.diff(words, prepend=0) + 1


@dataclass
class Vocabulary:
    """Head words and the training counts that are known everywhere.

    ``ids``/``counts``: frequent words, ids ascending. ``rank``: place of each in the head, or -1.
    ``tail_norm``: log10 of N + V + 1 for each tail class; ``base_norm`` the same over all tokens.
    """

    ids: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    tail_norm: np.ndarray
    base_norm: float
    train_tokens: int

    @classmethod
    def of(cls, ids, counts, tokens_by_tail, words_by_tail):
        """From frequent words and, per tail class, all training tokens and distinct words."""
        ids, counts = np.asarray(ids, np.uint64), np.asarray(counts, np.int64)
        best = np.lexsort((ids, -counts))[:HEAD]
        order = np.argsort(ids)
        rank = np.full(len(ids), -1, np.int64)
        rank[best] = np.arange(len(best))
        n, v = np.array(tokens_by_tail, np.int64), np.array(words_by_tail, np.int64)
        total = int(n.sum()), int(v.sum())
        tails = (ids[best] % np.uint64(TAILS)).astype(int)
        n -= np.bincount(tails, weights=counts[best], minlength=TAILS).astype(np.int64)
        v -= np.bincount(tails, minlength=TAILS)
        return cls(ids[order], counts[order], rank[order], np.log10(n + v + 1), float(np.log10(total[0] + total[1] + 1)), total[0])

    @cached_property
    def _starts(self) -> tuple:
        """(first place of each value of the ids' first bits, most places of a value, shift)."""
        bits = min(len(self.ids).bit_length() + 1, 20)
        start = np.searchsorted(self.ids >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        return start, int(np.diff(start).max()), np.uint64(64 - bits)

    def look_up(self, ids) -> tuple:
        """(place in the frequent list or -1, symbol): symbol is the rank, or HEAD + tail class."""
        if not len(self.ids):
            return np.full(len(ids), -1), HEAD + (ids % np.uint64(TAILS)).astype(np.int64)
        start, most, shift = self._starts
        bucket = (ids >> shift).astype(np.int64)
        at = np.minimum(start[bucket], len(self.ids) - 1)
        hit = self.ids[at] == ids
        rest = np.flatnonzero(~hit)
        for _ in range(1, most):  # words that share their first bits
            rest = rest[at[rest] + 1 < start[bucket[rest] + 1]]
            at[rest] += 1
            same = self.ids[at[rest]] == ids[rest]
            hit[rest[same]] = True
            rest = rest[~same]
        rank = np.where(hit, self.rank[at], -1)
        return np.where(hit, at, -1), np.where(rank >= 0, rank, HEAD + (ids & np.uint64(TAILS - 1)).astype(np.int64))


SYMBOLS = HEAD + TAILS
CLASSES = HEAD_CLASSES + TAILS


def new_model(seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    f = np.float32
    return {
        "x": (rng.standard_normal((SYMBOLS, 3 * HIDDEN)) * 0.1).astype(f),
        "h": (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
        "c": (rng.standard_normal((HIDDEN, CLASSES)) * 0.1).astype(f),
        "cb": np.zeros(CLASSES, f),
        "w": (rng.standard_normal((HEAD_CLASSES, HIDDEN, WIDTH)) * 0.1).astype(f),
        "wb": np.zeros((HEAD_CLASSES, WIDTH), f),
    }


def seeded_biases(model: dict, symbol_counts) -> None:
    """Start the output at the relative frequencies of symbols."""
    n = np.asarray(symbol_counts, float) + 0.5
    head = n[:HEAD].reshape(HEAD_CLASSES, WIDTH)
    mass = np.concatenate((head.sum(axis=1), n[HEAD:]))
    model["cb"][:] = np.log(mass / mass.sum())
    model["wb"][:] = np.log(head / head.sum(axis=1, keepdims=True))


def _squash(v):
    """Rational stand-in for tanh, in place: v (27 + v^2) / (27 + 9 v^2), which is 1 at 3; here v (1/9 + 8/3 / (3 + v^2))."""
    v.clip(-3, 3, out=v)
    s = v * v
    s += np.float32(3)
    np.divide(np.float32(8 / 3), s, out=s)
    s += np.float32(1 / 9)
    v *= s
    return v


def _gate(v):
    """(1 + squash(v / 2)) / 2, in place and without the passes for the halves."""
    v.clip(-6, 6, out=v)
    s = v * v
    s += np.float32(12)
    np.divide(np.float32(8 / 3), s, out=s)
    s += np.float32(1 / 36)
    v *= s
    v += np.float32(0.5)
    return v


def _inputs(model, x):
    """The inputs' rows of symbols ``x`` (the last axis), gate by gate: each gate's numbers lie side by side."""
    return model["x"].reshape(-1, HIDDEN).take(_places(x), axis=0)


def _places(x):
    return 3 * x[..., None, :] + np.arange(3)[:, None]


def _by_gate(weights):
    return np.ascontiguousarray(weights.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


def _advance(g, weights, h, new, a, n):
    """One GRU step from the inputs' rows ``g``, all gate by gate: fills the new state, ``n`` and, in ``a``, z, r and what n has from the state before r."""
    np.matmul(h, weights, out=a)
    zr = a[:2]
    zr += g[:2]
    _gate(zr)
    np.multiply(a[1], a[2], out=n)
    n += g[2]
    _squash(n)
    np.subtract(h, n, out=new)
    new *= a[0]
    new += n


def _step(model, x, h):
    """One GRU step over symbols ``x``: new state, z, r, n and what n has from the state before r."""
    new, n = np.empty((2, *h.shape), h.dtype)
    a = np.empty((3, *h.shape), h.dtype)
    _advance(_inputs(model, x), _by_gate(model["h"]), h, new, a, n)
    return new, a[0], a[1], n, a[2]


def _exp(v):
    """exp, in place, and its sums over rows. States are within 1, so logits stay small."""
    v.clip(-60, 60, out=v)
    np.exp(v, out=v)
    return v, v @ np.ones(v.shape[1], v.dtype)


def _summed(left, right, parts):
    """left.T @ right, added up over runs of rows that stay in cache."""
    return np.matmul(left.reshape(parts, -1, left.shape[1]).transpose(0, 2, 1), right.reshape(parts, -1, right.shape[1])).sum(axis=0)


def _log_sum(v):
    """log of the sum of exp over rows; overwrites ``v``. States are within 1, so logits stay small."""
    return np.log(_exp(v)[1])


def _by_symbol(rows, x):
    """(sums, symbols): ``rows`` added up by symbol, the most frequent first. A frequent symbol's rows are one product, the others are added in layers."""
    order = np.argsort(x.astype(np.int16), kind="stable")
    rows, x = rows.take(order, axis=0), x[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    n = np.diff(first, append=len(x))
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    out, ones = rows.take(first, axis=0), np.ones(n[0], rows.dtype)
    many = int(np.searchsorted(-n, -LAYERS))
    for i, (a, k) in enumerate(zip(first[:many].tolist(), n[:many].tolist())):
        np.dot(ones[:k], rows[a : a + k], out=out[i])
    for j in range(1, LAYERS):
        k = int(np.searchsorted(-n, -j))
        if k <= many:
            break
        out[many:k] += rows.take(first[many:k] + j, axis=0)
    return out, x[first]


def log10_of(model, states, target):
    """log10 P(class) + log10 P(word | class) of head words, log10 P(class) of tail classes."""
    cls = np.where(target < HEAD, target // WIDTH, HEAD_CLASSES + target - HEAD)
    out = np.empty(len(states), np.result_type(states, model["c"]))
    for a in range(0, len(states), RUN):
        v, own = states[a : a + RUN] @ model["c"], cls[a : a + RUN]
        v += model["cb"]
        out[a : a + RUN] = v[np.arange(len(v)), own] - _log_sum(v)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))
    for k in range(HEAD_CLASSES):
        for a in range(bounds[k], bounds[k + 1], RUN):
            rows = order[a : min(a + RUN, bounds[k + 1])]
            u = states.take(rows, axis=0) @ model["w"][k]
            u += model["wb"][k]
            out[rows] += u[np.arange(len(u)), target[rows] % WIDTH] - _log_sum(u)
    return out.astype(np.float64) / np.log(10)


def _lanes(lengths, lanes: int):
    """Deal documents to lanes, longest first; lanes as lists, longest lane first."""
    import heapq

    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out = [[] for _ in heap]
    for d in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        total, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (total + int(lengths[d]), k))
    return sorted(out, key=lambda docs: -sum(int(lengths[d]) for d in docs))


class Lanes:
    """Symbols of documents dealt to lanes. Windows are cut on demand, so memory follows the number of symbols."""

    def __init__(self, symbols, lengths, lanes: int):
        dealt = _lanes(lengths, lanes)
        first = np.cumsum(lengths) - lengths
        docs = np.array([d for lane in dealt for d in lane], np.int32)
        runs = np.asarray(lengths)[docs] if len(docs) else np.zeros(0, np.int64)
        ends = np.cumsum(runs)
        small = np.int32 if len(symbols) < 1 << 31 else np.int64
        self.order = np.repeat((first[docs] - ends + runs).astype(small), runs) + np.arange(int(runs.sum()), dtype=small)  # symbols, lane by lane
        self.doc = np.repeat(docs, runs)
        self.size = np.array([sum(int(lengths[d]) for d in lane) for lane in dealt], np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.symbols, self.is_first = symbols, np.zeros(len(symbols), bool)
        self.is_first[first] = True
        self.steps = int(self.size.max(initial=0))

    def window(self, t0: int, steps: int):
        """(target, source, document, active): step by lane, over the lanes that have a step ``t0``.

        ``source`` is the symbol before, -1 at a document's start; beyond a lane's end its last
        step is repeated and not ``active``.
        """
        k = int(np.searchsorted(-self.size, -t0))
        t = np.arange(t0, min(t0 + steps, self.steps))[:, None]
        place = self.base[:k] + np.minimum(t, self.size[:k] - 1)
        at = self.order[place]
        source = np.where(self.is_first[at], -1, self.symbols[at - 1])
        return self.symbols[at], source, self.doc[place], t < self.size[:k]


def score_documents(model: dict, symbols, lengths, end_symbol: int):
    """log10 of what the network says of each document's symbols, its state carried to the document's end."""
    lanes = Lanes(symbols, lengths, SCORE_LANES)
    out = np.zeros(len(lengths))
    h, weights, rows = np.zeros((len(lanes.size), HIDDEN), np.float32), _by_gate(model["h"]), model["x"].reshape(-1, HIDDEN)
    t0 = 0
    while t0 < lanes.steps:
        live = int(np.searchsorted(-lanes.size, -t0))  # the fewer, the longer a window, while none of them ends
        steps = max(SCORE_WINDOW, min(SCORE_LANES * SCORE_WINDOW // live, int(lanes.size[live - 1]) - t0))
        target, source, doc, active = lanes.window(t0, steps)
        t0, k = t0 + steps, target.shape[1]
        h, states = h[:k], np.empty((len(target), k, HIDDEN), np.float32)
        a, n = np.empty((3, k, HIDDEN), np.float32), np.empty((k, HIDDEN), np.float32)
        start = source < 0
        places, starts = _places(np.where(start, end_symbol, source)), start.any(axis=1)
        for t in range(len(source)):
            if starts[t]:
                h = np.where(start[t][:, None], np.float32(0), h)
            _advance(rows.take(places[t], axis=0), weights, h, states[t], a, n)
            h = states[t]
        whole, active = bool(active.all()), active.ravel()
        states, target = states.reshape(-1, HIDDEN), target.ravel()
        said = log10_of(model, states, target) if whole else log10_of(model, states[active], target[active])
        out += np.bincount(doc.ravel()[active], weights=said, minlength=len(out))
    return out


class Trainer:
    """Truncated backpropagation through time with AdaGrad; the state runs on between windows.

    Lanes end at different times. AdaGrad makes any gradient's step as long as another's, so the
    few long texts that are left at the end would draw the network to themselves; the rate
    therefore falls with the square root of the share of lanes that are live. Every token trains.
    """

    def __init__(self, model: dict, rate: float = RATE, seen: float = 0.01):
        self.model, self.rate, self.now = model, rate, rate
        self.seen = {k: np.full_like(v, seen) for k, v in model.items()}

    def _update(self, name, grad, rows=None):
        seen = self.seen[name] if rows is None else self.seen[name].take(rows, axis=0)
        seen += grad * grad
        step = np.multiply(grad, np.float32(self.now))
        step /= np.sqrt(seen)
        if rows is None:
            self.model[name] -= step
        else:
            self.seen[name][rows] = seen
            self.model[name][rows] -= step

    def documents(self, symbols, lengths, end_symbol: int) -> float:
        """One pass over every symbol; returns the mean log10 probability before each update."""
        lanes = Lanes(symbols, lengths, LANES)
        h = np.zeros((len(lanes.size), HIDDEN), np.float32)
        total = 0.0
        for t0 in range(0, lanes.steps, WINDOW):
            target, source, _, active = lanes.window(t0, WINDOW)
            self.now = self.rate * float(np.sqrt(active.sum() / (len(active) * len(lanes.size))))
            total += self._window(target, source, active, h[: target.shape[1]], end_symbol, len(lanes.size))
        return total / max(len(symbols), 1)

    def _window(self, target, source, active, h, end_symbol, lanes) -> float:
        """One update; steps behind a lane's end are not ``active`` and weigh nothing."""
        m, steps, k = self.model, *target.shape
        active = active.ravel()
        start = source < 0
        x, starts = np.where(start, end_symbol, source).ravel(), start.any(axis=1)
        inputs = _inputs(m, x).reshape(3, steps, k, HIDDEN)
        states, before, n = np.empty((3, steps, k, HIDDEN), h.dtype)
        a, weights = np.empty((3, steps, k, HIDDEN), h.dtype), _by_gate(m["h"])
        for t in range(steps):
            before[t] = states[t - 1] if t else h
            if starts[t]:
                before[t][start[t]] = 0
            _advance(inputs[:, t], weights, before[t], states[t], a[:, t], n[t])
        h[:] = states[-1]
        states, before, n = (v.reshape(steps * k, HIDDEN) for v in (states, before, n))
        z, r, an = a.reshape(3, steps * k, HIDDEN)
        goal = target.ravel()
        cls = np.where(goal < HEAD, goal // WIDTH, HEAD_CLASSES + goal - HEAD)
        rows = np.arange(len(goal))
        scale = active * np.float32(1 / lanes)  # the same for every symbol, however many lanes are left
        p = states @ m["c"]
        p += m["cb"]
        p, total = _exp(p)
        said = (np.log10(np.maximum(p[rows, cls] / total, 1e-30)) * active).sum()
        p *= (scale / total)[:, None]
        p[rows, cls] -= scale
        dh = p @ m["c"].T
        self._update("c", _summed(states, p, steps))
        self._update("cb", np.ones(len(p), p.dtype) @ p)
        order = np.argsort(cls.astype(np.int16), kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(HEAD_CLASSES + 1))
        order = order[: bounds[-1]]  # head words, class by class
        word, live, scale = goal[order] % WIDTH, active[order], scale[order]
        by_class = np.ones((len(order), HIDDEN + 1), np.float32)  # the last number goes with the biases
        by_class[:, :HIDDEN] = states.take(order, axis=0)
        words = np.concatenate((m["w"], m["wb"][:, None]), axis=1)
        some, own = np.flatnonzero(np.diff(bounds)).tolist(), [slice(*x) for x in zip(bounds, bounds[1:])]
        q, back, at = np.empty((len(order), WIDTH), np.float32), np.empty((len(order), HIDDEN), np.float32), (np.arange(len(order)), word)
        grad = np.zeros_like(words)
        for c in some:  # products by class, the rest for all classes at once
            np.matmul(by_class[own[c]], words[c], out=q[own[c]])
        q, total = _exp(q)
        said += (np.log10(np.maximum(q[at] / total, 1e-30)) * live).sum()
        q *= (scale / total)[:, None]
        q[at] -= scale
        for c in some:
            np.matmul(q[own[c]], m["w"][c].T, out=back[own[c]])
            np.matmul(by_class[own[c]].T, q[own[c]], out=grad[c])
        of_words = np.zeros_like(dh)
        of_words[order] = back
        dh += of_words
        self._update("w", grad[:, :HIDDEN])
        self._update("wb", grad[:, HIDDEN])
        # what doesn't depend on the gradient from behind, for all steps at once: of z, r and n before the reset gate
        factor = inputs.reshape(3, steps * k, HIDDEN)  # the inputs are of no more use
        rest = 1 - z
        to_n = n * n
        np.subtract(np.float32(1), to_n, out=to_n)
        to_n *= rest
        np.subtract(before, n, out=factor[0])
        factor[0] *= z
        factor[0] *= rest
        np.multiply(to_n, r, out=factor[2])
        np.multiply(factor[2], an, out=factor[1])
        factor[1] *= np.subtract(np.float32(1), r, out=rest)
        split = np.empty((steps * k, 3, HIDDEN), h.dtype)  # gradients lie symbol by symbol
        back, back_h = split.reshape(steps * k, 3 * HIDDEN), np.ascontiguousarray(m["h"].T)
        carry, factor = np.zeros((k, HIDDEN), np.float32), factor.transpose(1, 0, 2)
        for t in range(steps - 1, -1, -1):
            at = slice(t * k, t * k + k)
            d = dh[at]
            d += carry
            np.multiply(d[:, None], factor[at], out=split[at])
            np.matmul(back[at], back_h, out=carry)
            carry += d * z[at]
            if starts[t]:
                carry[start[t]] = 0
        grad_h = _summed(before, back, steps)
        np.multiply(dh, to_n, out=split[:, 2])
        self._update("x", *_by_symbol(back, x))
        norm = np.abs(grad_h).max()
        self._update("h", grad_h / max(norm, 1.0))
        return float(said)


def averaged(models: list, weights: list) -> dict:
    total = float(sum(weights)) or 1.0
    return {k: sum(m[k].astype(np.float64) * (w / total) for m, w in zip(models, weights)).astype(np.float32) for k in models[0]}
