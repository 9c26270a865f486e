"""A byte convolutional network in numpy: filters of several widths over bytes, max pooling, softmax.

Filters act on one-hot bytes, so a filter of width k is k tables of one number per byte code. For inference the tables
of neighbouring bytes are summed into tables over byte pairs, and a batch is one array of fixed-length windows.
"""

import numpy as np

WINDOW, WIDTHS, FILTERS = 64, (2, 3, 4), 24

#: Byte codes: 0 pads; letters, blank and apostrophe have their own, other ASCII shares one, high bytes have their own.
CODES = np.ones(256, np.uint8)
CODES[0] = 0
for _i, _c in enumerate(b" 'abcdefghijklmnopqrstuvwxyz", 2):
    CODES[_c] = _i
    CODES[ord(chr(_c).upper())] = _i
CODES[128:] = np.arange(128) + 30
N_CODES = 158


def windows(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of codes, first window of each unit). A unit longer than a window goes on in further windows, which overlap by the widest filter less one."""
    step = WINDOW - max(WIDTHS) + 1
    n = np.fromiter((len(u) for u in units), np.int64, len(units))
    per = np.maximum(1, -(-(n - max(WIDTHS) + 1) // step))
    first = np.cumsum(per) - per
    buf = np.frombuffer(b"".join(units) + bytes(WINDOW), np.uint8)
    offset = np.cumsum(n) - n
    unit = np.repeat(np.arange(len(units)), per)
    at = (np.arange(per.sum()) - first[unit]) * step
    idx = offset[unit][:, None] + at[:, None] + np.arange(WINDOW)
    out = CODES[buf[np.minimum(idx, len(buf) - 1)]]
    out[at[:, None] + np.arange(WINDOW) >= n[unit][:, None]] = 0
    return out, first


class Net:
    """tables[k][j]: (N_CODES, FILTERS) of the filters of width WIDTHS[k] at place j; head: features to classes."""

    def __init__(self, tables, bias, head, out):
        self.tables, self.bias, self.head, self.out = tables, bias, head, out
        self._pairs = None

    @classmethod
    def new(cls, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        tables = [[r.normal(0, 0.3, (N_CODES, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        for t in tables:
            for x in t:
                x[0] = -0.5
        n = FILTERS * len(WIDTHS)
        return cls(tables, np.zeros(n, np.float32), r.normal(0, 0.1, (n, classes)).astype(np.float32), np.zeros(classes, np.float32))

    def weights(self):
        return [x for t in self.tables for x in t] + [self.bias, self.head, self.out]

    def _convolve(self, win: np.ndarray, argmax: bool):
        """Max over the places of each window, for every filter."""
        if self._pairs is None:
            self._pairs = [((t[0][:, None] + t[1][None]).reshape(-1, FILTERS), (t[2][:, None] + t[3][None]).reshape(-1, FILTERS) if len(t) == 4 else t[2] if len(t) == 3 else None) for t in self.tables]
        c = win.astype(np.int32)
        pair = c[:, :-1] * N_CODES + c[:, 1:]
        best, where = [], []
        for w, (a, b) in zip(WIDTHS, self._pairs):
            m = WINDOW - w + 1
            h = a[pair[:, :m]]
            if w == 3:
                h += b[c[:, 2:]]
            elif w == 4:
                h += b[pair[:, 2:]]
            if argmax:
                where.append(h.argmax(1))
            best.append(h.max(1))
        return np.concatenate(best, 1), where

    def logits(self, units: list[bytes], batch: int = 1024) -> np.ndarray:
        """Class scores of each unit, over all of its windows."""
        out = []
        for i in range(0, len(units), batch):
            win, first = windows(units[i : i + batch])
            pooled = np.concatenate([self._convolve(win[j : j + batch], False)[0] for j in range(0, len(win), batch)])
            out.append(np.maximum(np.maximum.reduceat(pooled, first, axis=0) + self.bias, 0) @ self.head + self.out)
        return np.concatenate(out) if out else np.zeros((0, len(self.out)), np.float32)

    def fit(self, units: list[bytes], y: np.ndarray, epochs: int, seed: int = 7, rate: float = 0.004, batch: int = 128, smooth: float = 0.05):
        """Adam on the cross-entropy of single windows' units; labels are smoothed against mistaken ones."""
        r = np.random.default_rng(seed)
        params = self.weights()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        classes = len(self.out)
        for epoch in range(epochs):
            order = r.permutation(len(units))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                win, first = windows([units[k] for k in own])
                self._pairs = None
                pooled, where = self._convolve(win, True)
                top = np.maximum.reduceat(pooled, first, axis=0)
                # the window that holds the maximum, per unit and filter
                unit = np.repeat(np.arange(len(own)), np.diff([*first, len(win)]))
                hit = pooled == top[unit]
                h = np.maximum(top + self.bias, 0)
                z = h @ self.head + self.out
                z = np.exp(z - z.max(1, keepdims=True))
                p = z / z.sum(1, keepdims=True)
                target = np.full((len(own), classes), smooth / classes, np.float32)
                target[np.arange(len(own)), y[own]] += 1 - smooth
                d = (p - target) / len(own)
                grads = {len(params) - 2: h.T @ d, len(params) - 1: d.sum(0)}
                dh = (d @ self.head.T) * (h > 0)
                grads[len(params) - 3] = dh.sum(0)
                k = 0
                for q, w in enumerate(WIDTHS):
                    lo = q * FILTERS
                    g = dh[unit, lo : lo + FILTERS] * hit[:, lo : lo + FILTERS]
                    rows, cols = np.nonzero(g)
                    at, val = where[q][rows, cols], g[rows, cols]
                    for j in range(w):
                        flat = win[rows, at + j].astype(np.int64) * FILTERS + cols
                        grads[k] = np.bincount(flat, weights=val, minlength=N_CODES * FILTERS).reshape(N_CODES, FILTERS)
                        k += 1
                t += 1
                lr = rate * (1 - 0.9 * epoch / max(1, epochs))
                for n, g in grads.items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    params[n] -= (lr * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self._pairs = None
        return self

    def dump(self) -> dict:
        return {"tables": [[x.astype(np.float16) for x in t] for t in self.tables], "bias": self.bias, "head": self.head, "out": self.out}

    @classmethod
    def load(cls, d: dict):
        return cls([[x.astype(np.float32) for x in t] for t in d["tables"]], d["bias"], d["head"], d["out"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)
