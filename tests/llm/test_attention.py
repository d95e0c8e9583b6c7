import numpy as np

from textmill.llm import attention as a


def model(seed=0):
    rng = np.random.default_rng(seed)
    flat = a.fresh(3) + rng.normal(0, 0.1, a.N_WEIGHTS).astype(np.float32)
    cells = np.unique(rng.integers(0, (a.PAIRS + a.SIZE) * a.SIZE, 300_000))
    return flat, a.Prior(cells, rng.integers(1, 9, len(cells)), rng.random(a.SIZE) < 0.5)


def test_gradient():
    flat, prior = model()
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, a.SIZE, (3, a.WINDOW)), rng.integers(0, a.SIZE, (3, a.WINDOW))
    y[1, 20:] = -1
    flat = flat.astype(np.float64)
    loss, g = a.loss_and_gradient(flat, x, y, prior)
    at = 0
    for name, (n, m) in a.SHAPES.items():
        top = at + np.argsort(-np.abs(g[at : at + n * m]))[:3]
        for i in top:
            step = np.zeros_like(flat)
            step[i] = 1e-5
            num = (a.loss_and_gradient(flat + step, x, y, prior)[0] - a.loss_and_gradient(flat - step, x, y, prior)[0]) / 2e-5
            assert abs(num - g[i]) < 1e-5 + 1e-3 * abs(g[i]), (name, num, g[i])
        at += n * m


def plain(flat, prior, ids):
    """Score of one text, window by window and id by id."""
    w, total = a.unpack(flat.astype(np.float64)), 0.0
    for t, y in enumerate(ids):
        first = (t // a.STRIDE) * a.STRIDE - (a.WINDOW - a.STRIDE)
        x = [ids[i - 1] if i else a.END for i in range(max(first, 0), t + 1)]
        e = w["ids"][x] + w["places"][max(first, 0) - first :][: len(x)]
        s = (e[-1] @ w["q"]) @ (e @ w["k"]).T / a.WIDTH**0.5
        s = np.exp(s - s.max())
        h = e[-1] + (s / s.sum()) @ (e @ w["v"]) @ w["o"]
        last, before = np.array([ids[t - 1] if t else a.END]), np.array([ids[t - 2] if t > 1 else a.END])
        z = a.pair_of(last, before, prior.begins_word)[0]
        share = prior.pair[z].astype(np.float64) + float(prior.back[z]) * prior.single[last[0]]
        assert abs(share.sum() - 1) < 1e-4
        share = share.reshape(a.SIDE, a.SIDE)
        for logits, k in ((w["classes"] @ h + np.log(share.sum(axis=1)), y // a.SIDE), (w["members"].reshape(a.SIDE, a.SIDE, -1)[y // a.SIDE] @ h + np.log(share[y // a.SIDE]), y % a.SIDE)):
            total += logits[k] - np.log(np.exp(logits).sum())
    return total


def test_batched_scores_are_those_of_each_id():
    flat, prior = model(2)
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(0, a.SIZE, n), a.END) for n in (0, 1, 15, 16, 17, 31, 32, 33, 100)]
    ids, ends = np.concatenate(texts).astype(np.uint16), np.cumsum([len(t) for t in texts])
    got = np.add.reduceat(a.Scorer(flat, prior).ids(ids, ends, batch=4), ends - np.diff(ends, prepend=0))
    assert np.allclose(got, [plain(flat, prior, t) for t in texts], rtol=1e-4, atol=1e-3)


def test_probabilities_sum_to_one():
    flat, prior = model(4)
    scorer = a.Scorer(flat, prior)
    p = 0.0
    for y in range(a.SIZE):
        ids = np.array([7, 9, y], dtype=np.uint16)
        p += np.exp(scorer.ids(ids, np.array([3]))[2])
    assert abs(p - 1) < 1e-3


def test_fit_learns_what_pairs_do_not_tell():
    rng = np.random.default_rng(0)
    mode = rng.integers(0, 2, 3000)
    windows = np.stack([rng.integers(10, 20, (3000, a.WINDOW + 1)) + 40 * mode[:, None]] * 1)[0]
    windows[:, 1::2] = rng.integers(100, 104, windows[:, 1::2].shape)  # the mode shows two back only
    cells, counts = np.unique(windows[:, :-1] * a.SIZE + windows[:, 1:], return_counts=True)
    prior = a.Prior(cells, counts, np.ones(a.SIZE, dtype=bool))
    flat = a.fresh()
    before, _ = a.loss_and_gradient(flat, windows[:200, :-1], windows[:200, 1:], prior)
    flat = a.fit(a.fit(flat, windows[200:], prior, 0.01), windows[200:], prior, 0.01)
    after, _ = a.loss_and_gradient(flat, windows[:200, :-1], windows[:200, 1:], prior)
    assert after < before - 0.2, (before, after)


def test_gradient_of_large_logits():
    flat, prior = model()
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, a.SIZE, (2, a.WINDOW)), rng.integers(0, a.SIZE, (2, a.WINDOW))
    for factor in (1, 12):  # the second leaves the range of float32 unless the largest are taken off
        (low, g), (high, exact) = (a.loss_and_gradient((flat * factor).astype(kind), x, y, prior) for kind in (np.float32, np.float64))
        assert np.isfinite(g).all() and abs(low - high) < 1e-3 * high and np.abs(g - exact).max() < 2e-3 * np.abs(exact).max()
