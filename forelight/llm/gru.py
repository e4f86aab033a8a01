"""A gated recurrent unit with a class-factored softmax, in numpy.

Symbols are the most frequent words, an end mark, and classes of all other words.
The output first picks one of the classes (frequent words are split into classes of
near equal square-root frequency; every class of other words is one more), then, for a
frequent word, the word inside its class. Training is truncated backpropagation over
windows; the state is carried from window to window and cleared at a text's start.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, EMBED = 24, 24
WINDOW, LANES, PIECE = 32, 192, 512
CLIP = 5.0
#: of Adam: gradients well below it move little, so classes that never occur keep near their shares
EPSILON = 1e-6


class Layout:
    """Symbols 0..words-1 are frequent words by falling count, 0 among them the end mark
    at ``end``; words..words+rare-1 are the classes of other words."""

    def __init__(self, counts: np.ndarray, rare: int, classes: int = 32):
        self.words, self.rare = len(counts), rare
        root = np.cumsum(np.sqrt(counts + 1.0))
        self.class_of = np.minimum((root - np.sqrt(counts + 1.0) / 2) / root[-1] * classes, classes - 1).astype(np.int32)
        _, self.class_of = np.unique(self.class_of, return_inverse=True)
        self.split = int(self.class_of.max()) + 1
        self.classes = self.split + rare
        self.first = np.searchsorted(self.class_of, np.arange(self.split + 1))
        # the class that every symbol, frequent or not, belongs to
        self.target = np.concatenate([self.class_of, self.split + np.arange(rare)]).astype(np.int32)


def start(layout: Layout, freq: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Initial weights; output biases start at the symbols' frequencies."""
    r = np.random.default_rng(seed)
    n = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
    share = (freq + 0.5) / (freq + 0.5).sum()
    by_class = np.bincount(layout.target, weights=share, minlength=layout.classes)
    p = {
        "E": n(layout.words + layout.rare, EMBED, scale=0.1), "Wx": n(EMBED, 3 * HIDDEN, scale=0.18), "Wh": n(HIDDEN, 3 * HIDDEN, scale=0.18), "b": np.zeros(3 * HIDDEN, np.float32),
        "Uc": n(HIDDEN, layout.classes, scale=0.05), "bc": np.log(by_class).astype(np.float32), "Uw": n(layout.words, HIDDEN, scale=0.05), "bw": np.log(share[: layout.words]).astype(np.float32),
    }
    p["b"][:HIDDEN] = 1.0  # keep the state by default
    return p


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def _gates(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input and state weights of both gates, and of the new value."""
    return tuple(np.ascontiguousarray(p[k][:, part]) for k in ("Wx", "Wh") for part in (slice(0, 2 * HIDDEN), slice(2 * HIDDEN, None)))


def input_tables(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol adds to the gates and to the new value: for weights that stay."""
    x = p["E"] @ p["Wx"] + p["b"]
    return np.ascontiguousarray(x[:, : 2 * HIDDEN]), np.ascontiguousarray(x[:, 2 * HIDDEN :])


def run_window(p: dict, xg: np.ndarray, xn: np.ndarray, gates: tuple, fresh: np.ndarray | None, h: np.ndarray, keep: bool = False):
    """States after each of the T inputs (given as their parts of the gates, T x B x 2H, and of
    the new value, T x B x H), starting from h; fresh marks where the state is cleared before
    the input. ``keep`` adds the states before each input, both gates side by side, new values and
    their state parts. What is kept is worked out where it stays."""
    t_max, lanes = xg.shape[:2]
    out = np.empty((t_max, lanes, HIDDEN), xg.dtype)
    slots = t_max if keep else 1
    before, parts, news = (np.empty((slots, lanes, HIDDEN), xg.dtype) for _ in range(3))
    both = np.empty((slots, lanes, 2 * HIDDEN), xg.dtype)
    less, wn = -gates[2], gates[3]
    clear = fresh.any(axis=1) if fresh is not None else None
    for t in range(t_max):
        if clear is not None and clear[t]:
            h = h * ~fresh[t][:, None]
        at = t if keep else 0
        if keep:
            before[t] = h
        zr = np.matmul(h, less, out=both[at])
        zr -= xg[t]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        part = np.matmul(h, wn, out=parts[at])
        n = np.multiply(part, zr[:, HIDDEN:], out=news[at])
        n += xn[t]
        np.tanh(n, out=n)
        new = np.subtract(h, n, out=out[t])
        new *= zr[:, :HIDDEN]
        new += n
        h = new
    return (out, h, (before, both, news, parts)) if keep else (out, h)


_ONES = np.ones(1 << 16, np.float32)


def _sums(x: np.ndarray) -> np.ndarray:
    """Row sums."""
    n = x.shape[1]
    return x @ (_ONES[:n] if x.dtype == np.float32 and n <= len(_ONES) else np.ones(n, x.dtype))


def _columns(x: np.ndarray) -> np.ndarray:
    """Column sums."""
    n = len(x)
    return (_ONES[:n] if x.dtype == np.float32 and n <= len(_ONES) else np.ones(n, x.dtype)) @ x


def _tame(p: dict, layout: Layout) -> bool:
    """Whether no state, whose numbers lie within -1 and 1, can give a softmax that needs scaling
    before exp: no output is over 40, and each softmax has one over -40."""
    c, w = np.abs(p["Uc"]).sum(axis=0), np.abs(p["Uw"]).sum(axis=1)
    top = np.maximum.reduceat(p["bw"] - w, layout.first[:-1]).min() if layout.words else 0
    return max((p["bc"] + c).max(), (p["bw"] + w).max(initial=0)) < 40 and min((p["bc"] - c).max(), top) > -40


def _exp_rows(x: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of x, scaled alike within a row, in place, and its row sums."""
    if not tame:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, _sums(x)


def _by_class(layout: Layout, cls: np.ndarray):
    """(rows, first word, last word + 1) of each frequent class with several words; cls is sorted."""
    ends = np.searchsorted(cls, np.arange(layout.split + 1)).tolist()
    first = layout.first.tolist()
    for k in range(layout.split):
        if ends[k + 1] > ends[k] and first[k + 1] - first[k] > 1:
            yield slice(ends[k], ends[k + 1]), first[k], first[k + 1]


def log_probs(p: dict, layout: Layout, h: np.ndarray, target: np.ndarray, tame: bool = False) -> np.ndarray:
    """Natural log probability of each target symbol given its state (rows)."""
    if not len(h):
        return np.zeros(0, np.float32)
    cls = layout.target[target]
    order = _order(cls)
    h, y, cls = h[order], target[order], cls[order]
    each = np.arange(len(h))
    x = h @ p["Uc"]
    x += p["bc"]
    e, total = _exp_rows(x, tame)
    share = e[each, cls] / total
    for rows, lo, hi in _by_class(layout, cls):
        x = h[rows] @ p["Uw"][lo:hi].T
        x += p["bw"][lo:hi]
        e, total = _exp_rows(x, tame)
        share[rows] *= e[each[: len(e)], y[rows] - lo] / total
    out = np.empty_like(share)
    out[order] = np.log(np.maximum(share, 1e-37))
    return out


def gradients(p: dict, layout: Layout, ids, fresh, target, weight, h0, into: dict | None = None):
    """Mean negative log probability of the window, its gradients, and the last state.
    ``into``: arrays that take the gradients."""
    t_max, lanes = ids.shape
    gates, tame = _gates(p), _tame(p, layout)
    # each symbol of the window goes through the input weights once, as do the gradients it gets
    flat_ids = ids.ravel()
    order_in = _order(flat_ids)
    sorted_ids = flat_ids[order_in]
    firsts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    used = sorted_ids[firsts]
    row_of = np.empty(len(p["E"]), np.intp)
    row_of[used] = np.arange(len(used))
    flat_ids, emb = row_of[flat_ids], p["E"][used]
    xg, xn = (emb @ gates[0] + p["b"][: 2 * HIDDEN])[flat_ids], (emb @ gates[1] + p["b"][2 * HIDDEN :])[flat_ids]
    states, last, (before, both, new, part) = run_window(p, xg.reshape(t_max, lanes, -1), xn.reshape(t_max, lanes, -1), gates, fresh, h0, keep=True)
    y, w = target.ravel(), weight.ravel().astype(emb.dtype)
    total = max(1.0, float(w.sum()))
    g = {k: np.zeros_like(v) for k, v in p.items()} if into is None else into
    g["E"][:], g["Uw"][:], g["bw"][:] = 0, 0, 0
    cls = layout.target[y]
    order = _order(cls)
    h, y, cls, w = states.reshape(-1, HIDDEN)[order], y[order], cls[order], w[order]
    scale = (w / total).astype(emb.dtype)
    each = np.arange(len(h))
    x = h @ p["Uc"]
    x += p["bc"]
    d, sums = _exp_rows(x, tame)
    d *= (scale / sums)[:, None]
    share = d[each, cls] / np.maximum(scale, 1e-30)
    d[each, cls] -= scale
    g["Uc"][:], g["bc"][:] = h.T @ d, _columns(d)
    dh = d @ p["Uc"].T
    for rows, lo, hi in _by_class(layout, cls):
        hr, wr, own = h[rows], scale[rows], p["Uw"][lo:hi]
        x = hr @ own.T
        x += p["bw"][lo:hi]
        e, sums = _exp_rows(x, tame)
        at = (each[: len(e)], y[rows] - lo)
        share[rows] *= e[at] / sums
        e *= (wr / sums)[:, None]
        e[at] -= wr
        g["Uw"][lo:hi] = e.T @ hr
        g["bw"][lo:hi] = _columns(e)
        dh[rows] += e @ own
    loss = -float((np.log(np.maximum(share, 1e-37)) * w).sum())
    back = np.empty_like(dh)
    back[order] = dh
    dh = back.reshape(t_max, lanes, HIDDEN)
    z, r = both[:, :, :HIDDEN], both[:, :, HIDDEN:]
    # side by side: of the new value's input, of both gates, of the new value's state part; the first
    # three go to the inputs and the last three to the states, each in one product
    d = np.empty((t_max, lanes, 4 * HIDDEN), emb.dtype)
    carry = np.zeros((lanes, HIDDEN), emb.dtype)
    clear = fresh.any(axis=1) if fresh is not None else None
    # what does not depend on the carried gradient, for all steps at once
    rest = 1 - z
    keep_n = new * new
    np.subtract(1, keep_n, out=keep_n)
    keep_n *= rest
    keep_z = before - new
    keep_z *= z
    keep_z *= rest
    keep_r = np.subtract(1, r, out=rest)
    keep_r *= r
    keep_r *= part
    to_state, to_input = np.ascontiguousarray(p["Wh"].T), np.concatenate([gates[1].T, gates[0].T])
    for t in range(t_max - 1, -1, -1):
        now = carry
        now += dh[t]
        dn = np.multiply(now, keep_n[t], out=d[t, :, :HIDDEN])
        np.multiply(now, keep_z[t], out=d[t, :, HIDDEN : 2 * HIDDEN])
        np.multiply(dn, keep_r[t], out=d[t, :, 2 * HIDDEN : 3 * HIDDEN])
        np.multiply(dn, r[t], out=d[t, :, 3 * HIDDEN :])
        carry = now * z[t]
        carry += d[t, :, HIDDEN:] @ to_state
        if clear is not None and clear[t]:
            carry *= ~fresh[t][:, None]
    d, before = d.reshape(-1, 4 * HIDDEN), before.reshape(-1, HIDDEN)
    g["Wh"][:] = before.T @ d[:, HIDDEN:]
    inner = np.add.reduceat(d[order_in, : 3 * HIDDEN], firsts, axis=0)
    for k, x in (("b", _columns(inner)), ("Wx", emb.T @ inner)):
        g[k][..., : 2 * HIDDEN], g[k][..., 2 * HIDDEN :] = x[..., HIDDEN:], x[..., :HIDDEN]
    g["E"][used] = inner @ to_input
    return loss / total, g, last


class Trainer:
    """Adam over windows of lanes; every text is one run of symbols that ends in the end mark."""

    def __init__(self, p: dict, layout: Layout, end: int, rate: float):
        self.flat, self.layout, self.end, self.rate = pack(p), layout, end, rate
        self.p = views(self.flat, p)
        self.m, self.q, self.g, self.room = (np.zeros_like(self.flat) for _ in range(4))
        self.grads = views(self.g, p)
        self.steps, self.tokens, self.loss = 0, 0, 0.0

    def lanes(self, texts: list[np.ndarray]):
        """Deal texts to lanes of near equal length. In training a long text goes on in
        another lane after PIECE symbols, from a clear state; every symbol is learnt."""
        pieces = [(t[at : at + PIECE], t[at - 1] if at else self.end) for t in texts for at in range(0, len(t), PIECE)]
        pieces.sort(key=lambda x: -len(x[0]))
        fill: list[list] = [[] for _ in range(LANES)]
        load = [(0, k) for k in range(LANES)]
        for x in pieces:
            n, k = load[0]
            heapq.heapreplace(load, (n + len(x[0]), k))
            fill[k].append(x)
        fill.sort(key=lambda some: -sum(len(t) for t, _ in some))
        size = -(-sum(len(t) for t, _ in fill[0]) // WINDOW) * WINDOW
        target = np.full((size, LANES), self.end, np.int32)
        ids = np.full((size, LANES), self.end, np.int32)
        fresh, weight = np.zeros((size, LANES), bool), np.zeros((size, LANES), bool)
        for k, some in enumerate(fill):
            at = 0
            for t, before in some:
                target[at : at + len(t), k] = t
                ids[at, k] = before
                ids[at + 1 : at + len(t), k] = t[:-1]
                fresh[at, k] = True
                weight[at : at + len(t), k] = True
                at += len(t)
        return ids, fresh, target, weight

    def learn(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        ids, fresh, target, weight = self.lanes(texts)
        h = np.zeros((LANES, HIDDEN), np.float32)
        for at in range(0, len(ids), WINDOW):
            live = max(1, int(weight[at].sum()))
            cut = (slice(at, at + WINDOW), slice(0, live))
            n = int(weight[cut].sum())
            loss, _, h = gradients(self.p, self.layout, ids[cut], fresh[cut], target[cut], weight[cut], h[:live], self.grads)
            self.tokens += n
            self.loss += loss * n
            self._step()

    def _step(self) -> None:
        g, m, q, room = self.g, self.m, self.q, self.room
        norm = float(np.sqrt(g @ g))
        if norm > CLIP:
            g *= np.float32(CLIP / norm)
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / 20) * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        m *= np.float32(0.9)
        m += np.multiply(g, np.float32(0.1), out=room)
        g *= g
        q *= np.float32(0.999)
        q += np.multiply(g, np.float32(0.001), out=room)
        np.sqrt(q, out=room)
        room += np.float32(EPSILON)
        np.divide(m, room, out=room)
        room *= np.float32(rate)
        self.flat -= room


def deal(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its lane and its place there, and the lanes' loads by falling load: the longest
    texts first, each to the lane with the least so far."""
    load = [(0, k) for k in range(min(lanes, len(sizes)))]
    lane, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, k = load[0]
        lane[i], place[i] = k, n
        heapq.heapreplace(load, (n + int(sizes[i]), k))
    loads = np.zeros(len(load), np.int64)
    for n, k in load:
        loads[k] = n
    by = np.argsort(-loads, kind="stable")
    rank = np.empty_like(by)
    rank[by] = np.arange(len(by))
    return rank[lane], place, loads[by]


def score_texts(p: dict, layout: Layout, end: int, texts: list[np.ndarray], lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log probability of each whole text (symbols that end in the end mark). Texts stand
    one after another in lanes of near equal length; a text starts from a clear state."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    lane, place, loads = deal(np.fromiter(map(len, texts), np.int64, len(texts)), lanes)
    # the input is the symbol before, an end mark before a text's first one
    symbols = np.full((len(loads), int(loads[0]) + 1), end, np.int32)
    owner = np.zeros((len(loads), int(loads[0])), np.int32)
    fresh = np.zeros((len(loads), int(loads[0])), bool)
    for i, (k, at) in enumerate(zip(lane.tolist(), place.tolist(), strict=True)):
        symbols[k, at + 1 : at + 1 + len(texts[i])] = texts[i]
        owner[k, at : at + len(texts[i])] = i
        fresh[k, at] = True
    gates, (tg, tn), tame = _gates(p), input_tables(p), _tame(p, layout)
    h = np.zeros((len(loads), HIDDEN), np.float32)
    for at in range(0, int(loads[0]), window):
        live = int((loads > at).sum())
        width = min(window, int(loads[0]) - at)
        turned = lambda x, by=0: np.ascontiguousarray(x[:live, at + by : at + by + width].T)  # noqa: B023, E731
        begins = turned(fresh)
        ids = np.where(begins, np.int32(end), turned(symbols))
        states, h = run_window(p, tg[ids], tn[ids], gates, begins, h[:live])
        valid = (np.arange(width)[:, None] + at < loads[None, :live]).ravel()
        lp = log_probs(p, layout, states.reshape(-1, HIDDEN)[valid], turned(symbols, 1).ravel()[valid], tame)
        total += np.bincount(turned(owner).ravel()[valid], lp, len(texts))
    return total


def pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def views(flat: np.ndarray, like: dict) -> dict:
    """The arrays of a flat vector, without copies."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def unpack(flat: np.ndarray, like: dict) -> dict:
    return views(np.array(flat, np.float32), like)
