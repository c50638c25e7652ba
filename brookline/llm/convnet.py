"""A convolutional classifier over sequences of small integers, in numpy.

Embeddings, filters of several widths, the maximum of each filter over the whole
sequence, and a softmax.  Sequences lie one after the other in one flat array,
with padding between them (id 0, whose embedding stays zero), so that a batch is
one matrix product and a sequence may have any length.  Training follows the
gradient through the position of each maximum only, so over long sequences embeddings
should begin small (``scale``): what is learned of an id then soon outweighs the chance
values of all others, and the maxima move to telling ids.
"""

from __future__ import annotations

import numpy as np

#: Positions of the flat array that are multiplied at once.
AT_ONCE = 1 << 15


class ConvNet:
    def __init__(self, vocab: int, classes: int, embed: int = 8, widths=(2, 3, 4), filters: int = 16, stride: int = 1, scale: float = 0.3, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed, self.stride, self.width = embed, stride, max(widths)
        self.table = rng.normal(0, scale, (vocab, embed)).astype(np.float32)
        self.table[0] = 0
        k, n = self.width * embed, len(widths) * filters
        self.mask = np.zeros((k, n), np.float32)
        for i, w in enumerate(widths):
            self.mask[: w * embed, i * filters : (i + 1) * filters] = 1
        spread = np.sqrt(2 / (np.repeat(widths, filters) * embed * 0.1))
        self.kernel = (rng.normal(0, 0.3, (k, n)) * spread).astype(np.float32) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, np.sqrt(1 / n), (n, classes)).astype(np.float32)
        self.shift = np.zeros(classes, np.float32)

    def windows(self, flat: np.ndarray) -> np.ndarray:
        """The embedded ids from each position on; ``width - 1`` fewer than ``flat`` has."""
        rows = self.table.take(flat, axis=0)
        n = len(flat) - self.width + 1
        step = rows.strides[0]
        view = np.lib.stride_tricks.as_strided(rows, (-(-n // self.stride), self.width * self.embed), (step * self.stride, rows.strides[1]))
        return np.ascontiguousarray(view)

    def join(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The flat array of sequences, and where each begins, in strides.

        A sequence has one position at least, and padding before it, as wide as a filter
        can reach: a window over the end of one sequence never sees the next.
        """
        sizes = np.array([max(1, len(s)) for s in sequences])
        room = -(-(sizes + self.width - 1) // self.stride) * self.stride
        ends = np.cumsum(room)
        flat = np.zeros(int(ends[-1]) + self.width, sequences[0].dtype)
        for s, a in zip(sequences, (ends - room + self.width - 1).tolist()):
            flat[a : a + len(s)] = s
        return flat, (ends - room) // self.stride

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each sequence, before bias and cut-off."""
        total = (len(flat) - self.width) // self.stride
        best = np.full((len(starts), self.kernel.shape[1]), -np.inf, np.float32)
        for a in range(0, total, AT_ONCE):
            b = min(total, a + AT_ONCE)
            z = self.windows(flat[a * self.stride : b * self.stride + self.width - 1])[: b - a] @ self.kernel
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, b - 1, "right")
            cuts = np.maximum(starts[first:last] - a, 0)
            best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(z, cuts, axis=0))
        return best

    def peaks(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each filter has its maximum in each sequence, the first of equal ones, and the maximum."""
        total = (len(flat) - self.width) // self.stride
        cuts = np.append(starts, total)
        at = np.zeros((len(starts), self.kernel.shape[1]), np.int64)
        best = np.full(at.shape, -np.inf, np.float32)
        for a in range(0, total, AT_ONCE):
            b = min(total, a + AT_ONCE)
            z = self.windows(flat[a * self.stride : b * self.stride + self.width - 1])[: b - a] @ self.kernel
            for i in range(np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b - 1, "right")):
                p, q = max(cuts[i] - a, 0), min(cuts[i + 1], b) - a
                k = z[p:q].argmax(0)
                top = np.take_along_axis(z[p:q], k[None], 0)[0]
                more = top > best[i]
                at[i][more], best[i][more] = (k + p + a)[more], top[more]
        return at, best

    def logits(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(flat, starts) + self.bias, 0) @ self.out + self.shift

    def fit(self, sequences: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, drop: float = 0.2, hide: float = 0.0, seed: int = 11) -> ConvNet:
        """Adagrad on the cross entropy.

        ``drop`` of the pooled values, and ``hide`` of the ids, are left out at random; the
        latter lets other ids than the most telling one of a sequence be learned.
        """
        rng = np.random.default_rng(seed)
        classes = np.eye(self.out.shape[1], dtype=np.float32)
        names = ("table", "kernel", "bias", "out", "shift")
        seen = {n: np.full_like(getattr(self, n), 1e-2) for n in names}
        for epoch in range(epochs):
            order = rng.permutation(len(sequences))
            now = rate * (1 - epoch / epochs * 0.8)
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                flat, starts = self.join([sequences[i] for i in some])
                if hide:
                    flat[rng.random(len(flat)) < hide] = 0
                at, top = self.peaks(flat, starts)
                top += self.bias
                keep = (rng.random(top.shape) >= drop).astype(np.float32) / (1 - drop)
                h = np.maximum(top, 0) * keep
                logit = h @ self.out + self.shift
                logit -= logit.max(1, keepdims=True)
                p = np.exp(logit)
                p /= p.sum(1, keepdims=True)
                d = (p - classes[labels[some]]) / len(some)
                dh = d @ self.out.T * keep * (top > 0)
                dx = (dh[:, :, None] * self.kernel.T[None]).reshape(-1, self.embed)
                ids = flat[(at * self.stride)[:, :, None] + np.arange(self.width)]
                own = self.table[ids].reshape(*at.shape, -1)
                ids = ids.reshape(-1)
                rows, back = np.unique(ids, return_inverse=True)
                dt = np.zeros((len(rows), self.embed), np.float32)
                np.add.at(dt, back.reshape(-1), dx)
                dt[rows == 0] = 0
                steps = {
                    "kernel": (np.einsum("bfk,bf->kf", own, dh) + decay * self.kernel) * self.mask,
                    "bias": dh.sum(0),
                    "out": h.T @ d + decay * self.out,
                    "shift": d.sum(0),
                }
                for n, g in steps.items():
                    seen[n] += g * g
                    setattr(self, n, getattr(self, n) - now * g / np.sqrt(seen[n]))
                seen["table"][rows] += dt * dt
                self.table[rows] -= now * dt / np.sqrt(seen["table"][rows])
        return self


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)
