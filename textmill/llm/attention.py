"""A small causal self-attention model over ids, in numpy: scores, gradients and fitting.

One layer, one head, with a residual: ``h = x + softmax(q k / sqrt(d), causal) v o`` where ``x``
is the sum of an id's and a place's embedding. The output is a two-level softmax over classes
of ``SIDE`` ids and the ids of a class, on top of a prior: the logits are added to the logs of shares
of smoothed counts (``Prior``), so the attention learns what these counts do not tell.
"""

from __future__ import annotations

import numpy as np

SIDE = 32
SIZE = SIDE * SIDE  # ids, the last one ends a text
END = SIZE - 1
PAIRS = 15 * SIZE
WIDTH = 16
WINDOW = 32
STRIDE = 24
SHAPES = {"ids": (SIZE, WIDTH), "places": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "classes": (SIDE, WIDTH), "members": (SIZE, WIDTH)}
N_WEIGHTS = sum(a * b for a, b in SHAPES.values())
FUTURE = np.where(np.arange(WINDOW)[None, :] > np.arange(WINDOW)[:, None], np.float32(-1e9), np.float32(0))
Weights = dict[str, np.ndarray]


def unpack(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, (a, b) in SHAPES.items():
        out[name] = flat[at : at + a * b].reshape(a, b)
        at += a * b
    return out


def fresh(seed: int = 1) -> np.ndarray:
    """Starting weights; zero output weights, so that the model starts as the pair counts."""
    rng = np.random.default_rng(seed)
    w = unpack(np.zeros(N_WEIGHTS, dtype=np.float32))
    for name, scale in (("ids", 0.3), ("places", 0.1), ("q", 0.4), ("k", 0.4), ("v", 0.4), ("o", 0.4)):
        w[name][:] = rng.normal(0, scale, w[name].shape)
    return np.concatenate([w[n].ravel() for n in SHAPES])


def pair_of(last: np.ndarray, before: np.ndarray, begins_word: np.ndarray) -> np.ndarray:
    """The pair context of the next id after ``before`` and ``last``; ``PAIRS`` where ``last`` begins a word, since what
    came before it then belongs to another word."""
    pair = (before.astype(np.uint32) * np.uint32(SIZE) + last.astype(np.uint32)) * np.uint32(0x9E3779B1) >> np.uint32(12)
    return np.where(begins_word[last], PAIRS, pair % np.uint32(PAIRS)).astype(np.int64)


def cells_of(last: np.ndarray, before: np.ndarray, ids: np.ndarray, begins_word: np.ndarray) -> np.ndarray:
    """The numbers of the cells that ``Prior`` counts: each id after the last one, and after the last two."""
    pair = pair_of(last, before, begins_word)
    two = pair < PAIRS
    return np.concatenate([last.astype(np.int64) * SIZE + ids, (SIZE + pair[two]) * SIZE + ids[two]])


class Prior:
    """Shares of the next id by counts: those after the last two ids, drawn towards those after the last one,
    which are drawn towards those of all ids; each by as much as it has seen different ids (Witten and Bell).
    Tables of float32, ``(PAIRS + SIZE) * SIZE`` in all."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, begins_word: np.ndarray):
        """``counts`` of ``cells``, ascending."""
        self.begins_word = begins_word
        cut = int(np.searchsorted(cells, SIZE * SIZE))
        single = np.zeros(SIZE * SIZE, dtype=np.float32)
        single[cells[:cut]] = counts[:cut]
        single = single.reshape(SIZE, SIZE)
        all_ids = single.sum(axis=0) + np.float32(0.5)
        kinds = (single > 0).sum(axis=1, keepdims=True).astype(np.float32) + 1
        self.single = (single + kinds * (all_ids / all_ids.sum())) / (single.sum(axis=1, keepdims=True) + kinds)
        self.pair = np.zeros((PAIRS + 1, SIZE), dtype=np.float32)
        self.pair.ravel()[cells[cut:] - SIZE * SIZE] = counts[cut:]
        self.back = np.empty(PAIRS + 1, dtype=np.float32)
        for k in range(0, PAIRS + 1, SIZE):  # a few at a time, for memory
            some = self.pair[k : k + SIZE]
            kinds = (some > 0).sum(axis=1).astype(np.float32) + 1
            total = some.sum(axis=1) + kinds
            self.back[k : k + SIZE] = kinds / total
            some /= total[:, None]
        self.single_classes = self.single.reshape(SIZE, SIDE, SIDE).sum(axis=2)
        self.pair_classes = self.pair.reshape(PAIRS + 1, SIDE, SIDE).sum(axis=2)

    def classes(self, last: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Shares of all classes after each context."""
        out = np.take(self.single_classes, last, axis=0)
        out *= np.take(self.back, pair)[:, None]
        out += np.take(self.pair_classes, pair, axis=0)
        return out

    def members(self, last: np.ndarray, pair: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Shares, of all ids, of those of class ``c``."""
        out = np.take(self.single.reshape(-1, SIDE), last * SIDE + c, axis=0)
        out *= np.take(self.back, pair)[:, None]
        out += np.take(self.pair.reshape(-1, SIDE), pair * SIDE + c, axis=0)
        return out


def _exp(logits: np.ndarray) -> np.ndarray:
    """In place; where exponents could leave the range, the largest of each row becomes 0."""
    if logits.max(initial=0) > 30 or logits.min(initial=0) < -40:
        logits -= logits.max(axis=-1, keepdims=True)
    return np.exp(logits, out=logits)


class Scorer:
    """Log probabilities of ids in windows, from tables made once of the weights: for each place and
    id its key, value and a one (which sums the attention), and its query and embedding."""

    def __init__(self, flat: np.ndarray, prior: Prior):
        w = unpack(flat)
        self.prior = prior
        e = w["ids"][None] + w["places"][:, None]
        ones = np.ones((WINDOW, SIZE, 1), dtype=flat.dtype)
        self.keys = np.concatenate([e @ w["k"], e @ (w["v"] @ w["o"]), ones], axis=2).reshape(WINDOW * SIZE, -1)
        self.queries = np.concatenate([e @ w["q"] * flat.dtype.type(WIDTH**-0.5), e], axis=2).reshape(WINDOW * SIZE, -1)
        longest = lambda z: float(np.sqrt((z[:, :WIDTH] ** 2).sum(axis=1).max()))
        self.clip = longest(self.keys) * longest(self.queries) > 60
        self.classes, self.members = w["classes"].T.copy(), w["members"].reshape(SIDE, SIDE, WIDTH).transpose(0, 2, 1).copy()
        self.at = np.arange(WINDOW) * SIZE
        self.one = np.ones(SIDE, dtype=flat.dtype)

    def windows(self, x: np.ndarray, y: np.ndarray, before: np.ndarray) -> np.ndarray:
        """``x`` (n, WINDOW) previous ids; ``y`` (n, STRIDE) the ids to score, those after the last STRIDE
        of ``x``; ``before``: windows whose first half lies before the text and is masked."""
        tail = WINDOW - STRIDE
        place = x + self.at
        keys = np.take(self.keys, place, axis=0)
        queries = np.take(self.queries, place[:, tail:], axis=0)
        a = queries[:, :, :WIDTH] @ keys[:, :, :WIDTH].transpose(0, 2, 1)
        if self.clip:
            np.minimum(a, 60, out=a)
        a[:, :, tail:] += FUTURE[tail:, tail:]
        a[before, :, :tail] = -1e9
        np.exp(a, out=a)
        mixed = a @ keys[:, :, WIDTH:]
        h = mixed[:, :, :WIDTH] / mixed[:, :, WIDTH:]
        h += queries[:, :, WIDTH:]
        pair = pair_of(x[:, tail:], x[:, tail - 1 : -1], self.prior.begins_word)
        return self._outputs(h.reshape(-1, WIDTH), x[:, tail:].ravel().astype(np.int64), pair.ravel(), y.ravel()).reshape(y.shape)

    def _outputs(self, h: np.ndarray, last: np.ndarray, pair: np.ndarray, y: np.ndarray) -> np.ndarray:
        c = (y // SIDE).astype(np.uint8)
        order = np.argsort(c, kind="stable")
        c, last, pair, y = c[order], last[order], pair[order], y[order]
        h = np.take(h, order, axis=0)
        bounds = np.searchsorted(c, np.arange(SIDE + 1))
        flat = np.arange(len(y)) * SIDE
        logits = h @ self.classes
        if logits.max(initial=0) > 60:
            np.minimum(logits, 60, out=logits)
        share = np.exp(logits, out=logits)
        share *= self.prior.classes(last, pair)
        score = np.take(share.ravel(), flat + c)
        total = share @ self.one
        for k in range(SIDE):
            np.matmul(h[bounds[k] : bounds[k + 1]], self.members[k], out=logits[bounds[k] : bounds[k + 1]])
        if logits.max(initial=0) > 60:
            np.minimum(logits, 60, out=logits)
        share = np.exp(logits, out=logits)
        share *= self.prior.members(last, pair, c)
        out = np.empty_like(score)
        out[order] = np.log(score / total) + np.log(np.take(share.ravel(), flat + y % SIDE) / (share @ self.one))
        return out

    def ids(self, ids: np.ndarray, ends: np.ndarray, batch: int = 512) -> np.ndarray:
        """Natural log probability of each id; ``ids``: all texts, each with its END; ``ends``: where each
        one ends. Windows overlap, and each id is scored in one of them."""
        begins = np.concatenate([[0], ends[:-1]])
        per_text = -(-(ends - begins) // STRIDE)
        first = np.repeat(begins - (np.cumsum(per_text) - per_text) * STRIDE, per_text) + np.arange(per_text.sum()) * STRIDE
        stop, start = np.repeat(ends, per_text), np.repeat(begins, per_text)
        edge = np.full(WINDOW, END, dtype=ids.dtype)
        padded = np.concatenate([edge, ids, edge])
        out = np.empty(len(ids), dtype=np.float32)
        for b in range(0, len(first), batch):
            at, here = first[b : b + batch], slice(b, b + batch)
            before = at == start[here]
            x = padded[at[:, None] + np.arange(STRIDE - 1, STRIDE + WINDOW - 1)]  # ids at - 1 - (WINDOW - STRIDE) and on
            x[before, : WINDOW - STRIDE + 1] = END  # what precedes a text's first id
            place = at[:, None] + np.arange(STRIDE)
            score = self.windows(x, padded[place + WINDOW], before)
            inside = place < stop[here][:, None]
            out[place[inside]] = score[inside]
        return out


def loss_and_gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, prior: Prior) -> tuple[float, np.ndarray]:
    """Mean negative log probability of ``y`` (n, WINDOW), where negative ids are left out, after
    ``x`` (n, WINDOW), and its gradient. Softmaxes stay undivided, so that few passes go over their weights: the sums divide what is multiplied with them."""
    w, grad = unpack(flat), np.zeros_like(flat)
    g, n, kind = unpack(grad), len(x), flat.dtype.type
    scale = kind(WIDTH**-0.5)
    e = (np.take(w["ids"], x, axis=0) + w["places"]).reshape(-1, WIDTH)
    into = np.concatenate([w["q"] * scale, w["k"], w["v"]], axis=1)
    q, k, v = np.split((e @ into).reshape(n, WINDOW, -1), 3, axis=2)
    v1 = np.concatenate([v, np.ones((n, WINDOW, 1), dtype=flat.dtype)], axis=2)
    a = q @ k.transpose(0, 2, 1)
    wide = max(a.max(initial=0), -a.min(initial=0)) > 40
    a += FUTURE.astype(flat.dtype, copy=False)
    if wide:
        a -= a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    mixed = a @ v1
    total = mixed[:, :, WIDTH:]
    mixed = (mixed[:, :, :WIDTH] / total).reshape(-1, WIDTH)
    h = e + mixed @ w["o"]
    keep = np.flatnonzero(y.ravel() >= 0)
    keep = keep[np.argsort((y.ravel()[keep] // SIDE).astype(np.uint8), kind="stable")]  # by class, whose members then are one matrix
    pair = pair_of(x, np.concatenate([np.full((n, 1), END), x[:, :-1]], axis=1), prior.begins_word)
    hk, lk, zk, yk = np.take(h, keep, axis=0), x.ravel()[keep].astype(np.int64), pair.ravel()[keep], y.ravel()[keep].astype(np.int64)
    c = yk // SIDE
    bounds = np.searchsorted(c, np.arange(SIDE + 1)).tolist()
    spans = [(slice(a_, b_), slice(i * SIDE, (i + 1) * SIDE)) for i, (a_, b_) in enumerate(zip(bounds, bounds[1:])) if a_ < b_]
    pc = _exp(hk @ w["classes"].T)
    pc *= prior.classes(lk, zk)
    pm = np.empty((len(keep), SIDE), dtype=flat.dtype)
    for some, own in spans:
        np.matmul(hk[some], w["members"][own].T, out=pm[some])
    pm = _exp(pm)
    pm *= prior.members(lk, zk, c)
    loss, at, one = 0.0, np.arange(len(keep)) * SIDE, np.ones(SIDE, dtype=flat.dtype)
    for p, own in ((pc, c), (pm, yk % SIDE)):
        sums = p @ one
        loss -= np.mean(np.log(np.maximum(np.take(p.ravel(), at + own) / sums, 1e-30)))
        p *= (1 / (sums * kind(len(keep))))[:, None]
        p.ravel()[at + own] -= kind(1 / len(keep))
    g["classes"][:] = pc.T @ hk
    dhk = pc @ w["classes"]
    for some, own in spans:
        np.matmul(pm[some].T, hk[some], out=g["members"][own])
        dhk[some] += pm[some] @ w["members"][own]
    dh = np.zeros_like(h)
    dh[keep] = dhk
    np.matmul(mixed.T, dh, out=g["o"])
    # The gradient of a logit is a / total * (dmixed . v - dmixed . mixed): one product of rows with a place more.
    dmixed = dh @ w["o"].T
    d1 = np.concatenate([dmixed, -(dmixed * mixed).sum(axis=1, keepdims=True)], axis=1).reshape(n, WINDOW, -1) / total
    dinto = np.empty((n, WINDOW, 3 * WIDTH), dtype=flat.dtype)
    np.matmul(a.transpose(0, 2, 1), d1[:, :, :WIDTH], out=dinto[:, :, 2 * WIDTH :])
    a *= d1 @ v1.transpose(0, 2, 1)
    np.matmul(a, k, out=dinto[:, :, :WIDTH])
    np.matmul(a.transpose(0, 2, 1), q, out=dinto[:, :, WIDTH : 2 * WIDTH])
    dinto = dinto.reshape(-1, 3 * WIDTH)
    g["q"][:], g["k"][:], g["v"][:] = np.split(e.T @ dinto, 3, axis=1)
    g["q"][:] *= scale
    de = dh
    de += dinto @ into.T
    g["ids"].ravel()[:] = np.bincount((x.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel(), weights=de.ravel(), minlength=SIZE * WIDTH)
    g["places"][:] = de.reshape(n, WINDOW, WIDTH).sum(axis=0)
    return float(loss), grad


class Fitter:
    """Adam over windows (n, WINDOW + 1) in the order given; negative ids end a short window."""

    def __init__(self, flat: np.ndarray, prior: Prior, rate: float, batch: int = 16):
        self.flat, self.prior, self.rate, self.batch = flat.copy(), prior, np.float32(rate), batch
        self.m, self.s, self.t, self.seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
        self.waiting = np.empty((0, WINDOW + 1), dtype=np.int16)

    def add(self, windows: np.ndarray, last: bool = False) -> None:
        """Take windows; what does not fill a batch waits, unless they are the last."""
        rows = np.concatenate([self.waiting, windows])
        whole = len(rows) if last else len(rows) // self.batch * self.batch
        for b in range(0, whole, self.batch):
            self._step(rows[b : b + self.batch].astype(np.int64))
        self.seen += len(windows)
        self.waiting = rows[whole:]

    def _step(self, rows: np.ndarray) -> None:
        if not (rows[:, 1:] >= 0).any():
            return
        self.t += 1
        _, g = loss_and_gradient(self.flat, np.maximum(rows[:, :-1], 0), rows[:, 1:], self.prior)
        self.m += (g - self.m) * np.float32(0.1)
        g *= g
        g -= self.s
        g *= np.float32(0.02)
        self.s += g
        self.flat -= self.rate * (self.m / (1 - 0.9**self.t)).astype(np.float32) / (np.sqrt(self.s / (1 - 0.98**self.t)).astype(np.float32) + np.float32(1e-8))


def fit(flat: np.ndarray, windows: np.ndarray, prior: Prior, rate: float, batch: int = 16) -> np.ndarray:
    """The weights after one pass over ``windows``."""
    fitter = Fitter(flat, prior, rate, batch)
    fitter.add(windows.astype(np.int16), last=True)
    return fitter.flat
