"""A bidirectional gated recurrent network with attention pooling over word windows, in numpy.

A word's input is its own vector (words of the vocabulary have one, all others
share one) beside the mean of the vectors of its hashed character trigrams. Both
directions run as one batch. Attention over the states of a window gives its
pooled state and that its logit; a text's logit is that of its highest window.
"""

from __future__ import annotations

import numpy as np

from .hashing import Words

WINDOW, STRIDE = 24, 8
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
TRIGRAMS = 4096
#: Windows that run at once, and bytes of texts.
BATCH, CHUNK = 2048, 1 << 20
EPOCHS, RATE, STEP = 4, 0.01, 64
#: Epochs before which the model picks each text's highest window anew, and last epochs whose steps' parameters are averaged.
RESCORED, AVERAGED = (1, 2, 3), 2

f32 = np.float32


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_model(vocabulary: np.ndarray, prior: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """vocabulary: ascending word hashes; prior: a value for each that its vector begins with."""
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    words = r.normal(0, 0.05, (len(vocabulary) + 1, WORD_DIM))
    words[:-1, 0] += prior
    return {
        "vocabulary": vocabulary,
        "words": words.astype(f32),
        "chars": r.normal(0, 0.1, (TRIGRAMS, CHAR_DIM)).astype(f32),
        "w": r.normal(0, 0.3, (2, d, 3 * h)).astype(f32),
        "b": np.zeros((2, 3 * h), f32),
        "u": r.normal(0, 0.3, (2, h, 3 * h)).astype(f32),
        "wa": r.normal(0, 0.3, (2 * h, ATTENTION)).astype(f32),
        "ba": np.zeros(ATTENTION, f32),
        "va": r.normal(0, 0.3, ATTENTION).astype(f32),
        "wo": r.normal(0, 0.3, 2 * h).astype(f32),
        "bo": np.zeros(1, f32),
    }


class Inputs:
    """The distinct words of a batch of texts, and the windows over them."""

    def __init__(self, m: dict[str, np.ndarray], w: Words):
        _, at, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        hashes = w.hash[at]
        k = np.minimum(np.searchsorted(m["vocabulary"], hashes), max(0, len(m["vocabulary"]) - 1))
        known = m["vocabulary"][k] == hashes if len(m["vocabulary"]) else np.zeros(len(hashes), bool)
        self.own = np.where(known, k, len(m["vocabulary"]))
        # trigrams of each distinct word, a space before and behind it
        length = w.end[at] - w.start[at]
        self.n_tri = length
        self.tri_first = np.cumsum(length) - length
        centre = np.repeat(w.start[at] - self.tri_first, length) + np.arange(int(length.sum()))
        b = w.bytes.astype(np.uint32)
        before = np.where(centre > 0, b[np.maximum(centre - 1, 0)], 32)
        self.tri = ((before * 7919 + b[centre] * 104729 + b[centre + 1] * 1299709) >> 3) % TRIGRAMS
        n = np.diff(w.first)
        m_windows = np.where(n == 0, 0, np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1))
        self.doc = np.repeat(np.arange(len(n)), m_windows)
        self.first = np.cumsum(m_windows) - m_windows
        nth = np.arange(len(self.doc)) - self.first[self.doc]
        self.start = w.first[self.doc] + np.minimum(STRIDE * nth, np.maximum(n[self.doc] - WINDOW, 0))
        self.size = np.minimum(n[self.doc], WINDOW)
        self.n_windows = m_windows

    def vectors(self, m) -> np.ndarray:
        chars = np.add.reduceat(m["chars"][self.tri], self.tri_first, axis=0) / self.n_tri[:, None] if len(self.tri) else np.zeros((0, CHAR_DIM), f32)
        return np.concatenate([m["words"][self.own], chars], axis=1).astype(f32)

    def at(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of windows k, and which places they fill."""
        place = np.arange(WINDOW)
        fills = place < self.size[k][:, None]
        return self.word[np.where(fills, self.start[k][:, None] + place, self.start[k][:, None])], fills


def forward(m, projected: np.ndarray, words: np.ndarray, fills: np.ndarray, keep: bool = False):
    """Logits of windows. projected: (2, distinct words, 3 * HIDDEN), the inputs to the gates. keep: with all that backward() needs."""
    h, n = HIDDEN, len(words)
    ids = words.T
    state = np.zeros((2, n, h), f32)
    states = np.empty((WINDOW, 2, n, h), f32)
    whole = fills.all()
    trace = []
    for t in range(WINDOW):
        x = np.stack([projected[0][ids[t]], projected[1][ids[WINDOW - 1 - t]]])
        g = state @ m["u"]
        zr = x[..., : 2 * h] + g[..., : 2 * h]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[..., :h], zr[..., h:]
        c = np.tanh(x[..., 2 * h :] + r * g[..., 2 * h :])
        new = c + z * (state - c)
        if not whole:
            on = np.stack([fills[:, t], fills[:, WINDOW - 1 - t]])[..., None]
            new = np.where(on, new, state)
        if keep:
            trace.append((state, z, r, c, g[..., 2 * h :]))
        state = new
        states[t] = new
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    a = np.tanh(both @ m["wa"] + m["ba"])
    s = a @ m["va"]
    s = np.where(fills.T, s, -1e9)
    e = np.exp(s - s.max(axis=0))
    weight = e / e.sum(axis=0)
    pooled = (both * weight[..., None]).sum(axis=0)
    logit = pooled @ m["wo"] + m["bo"]
    return (logit, (both, a, weight, pooled, trace, ids, fills)) if keep else logit


def backward(m, kept, d_logit: np.ndarray, n_words: int):
    """Gradients of the parameters, and of `projected`."""
    both, a, weight, pooled, trace, ids, fills = kept
    h, n = HIDDEN, len(d_logit)
    g = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * m["wo"]
    d_weight = (both * d_pool).sum(axis=2)
    d_s = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_a = d_s[..., None] * m["va"] * (1 - a * a)
    g["va"] = np.einsum("tn,tnk->k", d_s, a)
    g["wa"] = np.einsum("tni,tnk->ik", both, d_a)
    g["ba"] = d_a.sum(axis=(0, 1))
    d_both = weight[..., None] * d_pool + d_a @ m["wa"].T
    d_states = np.stack([d_both[..., :h], d_both[::-1, :, h:]], axis=1)
    g["u"] = np.zeros_like(m["u"])
    d_projected = np.zeros((2, n_words, 3 * h), f32)
    d = np.zeros((2, n, h), f32)
    for t in range(WINDOW - 1, -1, -1):
        state, z, r, c, gn = trace[t]
        d = d + d_states[t]
        on = np.stack([fills[:, t], fills[:, WINDOW - 1 - t]])[..., None]
        dn = np.where(on, d, 0)
        d_z = dn * (state - c) * z * (1 - z)
        d_c = dn * (1 - z) * (1 - c * c)
        d_r = d_c * gn * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_c], axis=2)
        d_g = np.concatenate([d_z, d_r, d_c * r], axis=2)
        g["u"] += np.swapaxes(state, 1, 2) @ d_g
        np.add.at(d_projected[0], ids[t], d_x[0])
        np.add.at(d_projected[1], ids[WINDOW - 1 - t], d_x[1])
        d = np.where(on, dn * z, d) + d_g @ np.swapaxes(m["u"], 1, 2)
    return g, d_projected


def project(m, vectors: np.ndarray) -> np.ndarray:
    return vectors @ m["w"] + m["b"][:, None]


def window_logits(m, x: Inputs) -> np.ndarray:
    if not len(x.doc):
        return np.zeros(0, f32)
    p = project(m, x.vectors(m))
    out = []
    for k in range(0, len(x.doc), BATCH):
        out.append(forward(m, p, *x.at(np.arange(k, min(len(x.doc), k + BATCH)))))
    return np.concatenate(out)


def chunks(texts: list[str | None]):
    """Runs of texts of about CHUNK characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "") + 1
        if size >= CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


def scores(m, texts: list[str | None]) -> np.ndarray:
    """For each text the probability of its highest window; 0 without words."""
    out = []
    for run in chunks(texts):
        x = Inputs(m, Words(run, bare=True))
        best = np.zeros(len(run))
        has = np.flatnonzero(x.n_windows)
        if len(has):
            best[has] = sigmoid(np.maximum.reduceat(window_logits(m, x).astype(np.float64), x.first[has]))
        out.append(best)
    return np.concatenate(out) if out else np.zeros(0)


def value_of(value: np.ndarray, x: Inputs, k: int) -> np.ndarray:
    """The highest value of a word in each of BATCH windows from k on."""
    places = x.start[k : k + BATCH, None] + np.arange(WINDOW)
    return np.where(np.arange(WINDOW) < x.size[k : k + BATCH, None], value[np.minimum(places, len(value) - 1)], -9).max(axis=1)


def fit(texts: list[str], labels: np.ndarray, max_words: int = 100_000, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """A model from labelled texts (0 or 1, both present). In each epoch a text is its highest window by the model so far, a clean text another window besides."""
    r = np.random.default_rng(seed)
    w = Words(texts, bare=True)
    y = labels.astype(np.int64)
    pairs = np.unique(np.stack([w.hash, w.doc.astype(np.uint64)]), axis=1)
    hashes, at, n = np.unique(pairs[0], return_index=True, return_counts=True)
    toxic = np.add.reduceat(y[pairs[1].astype(np.int64)], at) if len(at) else np.zeros(0)
    some = np.flatnonzero(n >= 2 + len(texts) // 1000)
    some = np.sort(some[np.argsort(-n[some], kind="stable")[:max_words]])
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    prior = np.log((toxic[some] + 0.5) / (n1 + 1)) - np.log((n[some] - toxic[some] + 0.5) / (n0 + 1))
    m = start_model(hashes[some], prior, seed)
    x = Inputs(m, w)
    docs = np.flatnonzero(x.n_windows)
    value = np.concatenate([prior, [0.0]])[x.own][x.word]  # by word of the texts
    logits = np.concatenate([value_of(value, x, k) for k in range(0, len(x.doc), BATCH)] or [np.zeros(0)])
    names = [k for k in m if k != "vocabulary"]
    total, n_averaged = {k: np.zeros(m[k].shape) for k in names}, 0
    mean, square, step = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    for epoch in range(epochs):
        if epoch in RESCORED:
            logits = window_logits(m, x)
        order = np.lexsort((-logits, x.doc))
        top = order[x.first[docs]]
        clean = docs[y[docs] == 0]
        other = x.first[clean] + r.integers(0, x.n_windows[clean])
        picked = r.permutation(np.concatenate([top, other]))
        for k in range(0, len(picked), STEP):
            some = picked[k : k + STEP]
            words, fills = x.at(some)
            ids, local = np.unique(words, return_inverse=True)
            part = Part(x, ids)
            vectors = part.vectors(m)
            logit, kept = forward(m, project(m, vectors), local.reshape(words.shape), fills, keep=True)
            d_logit = ((sigmoid(logit) - y[x.doc[some]]) / len(some)).astype(f32)
            g, d_p = backward(m, kept, d_logit, len(ids))
            g["w"] = np.swapaxes(np.broadcast_to(vectors, (2, *vectors.shape)), 1, 2) @ d_p
            g["b"] = d_p.sum(axis=1)
            d_v = (d_p @ np.swapaxes(m["w"], 1, 2)).sum(axis=0)
            g["words"], g["chars"] = np.zeros_like(m["words"]), np.zeros_like(m["chars"])
            np.add.at(g["words"], part.own, d_v[:, :WORD_DIM])
            np.add.at(g["chars"], part.tri, np.repeat(d_v[:, WORD_DIM:] / part.n_tri[:, None], part.n_tri, axis=0))
            step += 1
            for name in names:
                mean[name] += 0.1 * (g[name] - mean[name])
                square[name] += 0.001 * (g[name] ** 2 - square[name])
                m[name] -= (RATE * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-7)).astype(f32)
                if epoch >= epochs - AVERAGED:
                    total[name] += m[name]
            n_averaged += epoch >= epochs - AVERAGED
    return m | {name: (t / n_averaged).astype(f32) for name, t in total.items()} if n_averaged else m


class Part(Inputs):
    """Some of the distinct words of x."""

    def __init__(self, x: Inputs, ids: np.ndarray):
        self.own, self.n_tri = x.own[ids], x.n_tri[ids]
        self.tri_first = np.cumsum(self.n_tri) - self.n_tri
        at = np.repeat(x.tri_first[ids] - self.tri_first, self.n_tri) + np.arange(int(self.n_tri.sum()))
        self.tri = x.tri[at]
