"""A recurrent block labeller: a bidirectional LSTM in numpy over the leaf sequence of a page."""

from __future__ import annotations

import functools
import zlib

import numpy as np

from .blocks_html import Element, Leaf, leaves
from .hashing import words
from .synthetic_pages import MARK, marked_pages

PATH, WORDS, NUMBERS = 256, 32, 7
WIDTH = PATH + WORDS + NUMBERS
HIDDEN = 24
#: Blocks of a page that are run through the network at once; longer pages go through it in portions.
LONG = 4096


@functools.lru_cache(1 << 16)
def _slots(names: tuple[str, ...]) -> tuple[int, int]:
    """Bits of an element's names, and the bit of its tag as the innermost one."""
    own = 0
    for n in names:
        own |= 1 << zlib.crc32(n.encode()) % PATH
    return own, 1 << zlib.crc32(("own " + names[0]).encode()) % PATH


def _path_bits(element: Element | None) -> int:
    """The bits of all names on the path to an element, kept with each element, so that depth costs nothing."""
    if element is None:
        return 0
    missing, at = [], element
    while at is not None and at.memo is None:
        missing.append(at)
        at = at.parent
    bits = at.memo if at is not None else 0
    for e in reversed(missing):
        e.memo = bits = bits | _slots(e.names)[0]
    return element.memo | _slots(element.names)[1]


def features(blocks: list[Leaf], first: int = 0, of: int = 0) -> np.ndarray:
    """(blocks, WIDTH): hashed tag path, hashed words, and figures on lengths, links, marks and place.

    The blocks are those from `first` on of a page of `of` blocks, or a whole page.
    """
    n, of = len(blocks), of or len(blocks)
    x = np.zeros((n, WIDTH), np.float32)
    bits = b"".join(_path_bits(b.element).to_bytes(PATH // 8, "little") for b in blocks)
    x[:, :PATH] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").reshape(n, PATH)
    data = [b.text.lower().encode() for b in blocks]
    edges = np.cumsum([0, *(len(d) + 1 for d in data)])
    hashed, start, _ = words(b"\n".join(data))
    owner = np.searchsorted(edges, start, "right") - 1
    counts = np.bincount(owner * WORDS + (hashed % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    x[:, PATH : PATH + WORDS] = np.sqrt(counts / size[:, None])
    chars = np.array([len(b.text) for b in blocks])
    place = first + np.arange(n)
    x[:, PATH + WORDS :] = np.stack([
        np.log1p(chars) / 6,
        np.log1p(size) / 5,
        [b.linked / len(b.text) for b in blocks],
        [sum(map(b.text.count, ".,;:!?")) / len(b.text) * 10 for b in blocks],
        [b.text[-1] in ".!?\"'”»)" for b in blocks],
        1 / (1 + place),
        1 / (of - place),
    ], 1)
    return x


class Labeller:
    """Probability that each block belongs to the main text."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            w["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # gates: in, forget, out, new
        w["o"], w["q"] = rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
        return cls(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple | None = None):
        """Outputs (steps, pages, HIDDEN) of one direction, what training needs, and the last state; x: (steps, pages, WIDTH)."""
        w, steps = self.weights, range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        fed = x @ w["x" + d] + w["c" + d]
        h, c = state or (np.zeros((x.shape[1], HIDDEN), np.float32),) * 2
        out, trace = np.zeros((*x.shape[:2], HIDDEN), np.float32), {}
        for t in steps:
            z = fed[t] + h @ w["h" + d]
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, new = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * new, c)
            th = np.tanh(c2)
            if keep:
                trace[t] = (h, c, i, f, o, new, th, m)
            h, c = np.where(m, o * th, h), c2
            out[t] = h
        return out, trace, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]), 2)
        return both @ self.weights["o"] + self.weights["q"]

    def loss_gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), 2)
        z = both @ self.weights["o"] + self.weights["q"]
        n = mask.sum()
        loss = float(((np.logaddexp(0, z) - y * z) * mask).sum() / n)
        dz = ((1 / (1 + np.exp(-z)) - y) * mask / n).astype(np.float32)
        grad = {"o": (both * dz[..., None]).sum((0, 1)), "q": np.array([dz.sum()], np.float32)}
        outer = dz[..., None] * self.weights["o"]
        for d, part in (("f", outer[..., :HIDDEN]), ("b", outer[..., HIDDEN:])):
            trace, wh = runs[d][1], self.weights["h" + d]
            dfed = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh, dh, dc = np.zeros_like(wh), np.zeros_like(part[0]), np.zeros_like(part[0])
            for t in reversed(trace):
                h, c, i, f, o, new, th, m = trace[t]
                dh = dh + part[t]
                on, off = np.where(m, dh, 0), np.where(m, 0, dh)
                inner = np.where(m, dc, 0) + on * o * (1 - th * th)
                dzt = np.concatenate((inner * new * i * (1 - i), inner * c * f * (1 - f), on * th * o * (1 - o), inner * i * (1 - new * new)), 1)
                dfed[t] = dzt
                gh += h.T @ dzt
                dh, dc = dzt @ wh.T + off, inner * f + np.where(m, 0, dc)
            flat = dfed.reshape(-1, 4 * HIDDEN)
            grad |= {"x" + d: x.reshape(-1, WIDTH).T @ flat, "h" + d: gh, "c" + d: flat.sum(0)}
        return loss, grad

    def label(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """For each page, whether each block is main text. Pages of like lengths run side by side."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order) and len(pages[order[a]]) <= LONG:
            b = a + 1
            while b < len(order) and len(pages[order[b]]) <= LONG and b - a < 128 and (b - a + 1) * len(pages[order[b]]) <= 8192:
                b += 1
            x, mask = batch([features(pages[i]) for i in order[a:b]])
            z = self.logits(x, mask)
            for k, i in enumerate(order[a:b]):
                out[i] = z[: len(pages[i]), k] > 0
            a = b
        for i in order[a:]:
            out[i] = self._label_long(pages[i])
        return out

    def _label_long(self, blocks: list[Leaf]) -> np.ndarray:
        """The same for one page, LONG blocks at a time in each direction; only a number for each block is held for the whole page."""
        z = np.full(len(blocks), self.weights["q"][0], np.float32)
        starts = range(0, len(blocks), LONG)
        for d, order, own in (("f", starts, slice(0, HIDDEN)), ("b", reversed(starts), slice(HIDDEN, None))):
            state = None
            for a in order:
                x = features(blocks[a : a + LONG], a, len(blocks))[:, None]
                out, _, state = self._run(x, np.ones(x.shape[:2], bool), d, False, state)
                z[a : a + LONG] += out[:, 0] @ self.weights["o"][own]
        return z > 0


def labelled(blocks: list[Leaf]) -> tuple[list[Leaf], np.ndarray]:
    """Blocks of a marked page without the marks, and which of them had one."""
    main = np.array([b.text.startswith(MARK) for b in blocks], np.float32)
    return [Leaf(b.text.replace(MARK, "") or "-", b.element, b.linked) for b in blocks], main


def batch(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, xs))
    x, mask = np.zeros((longest, len(xs), WIDTH), np.float32), np.zeros((longest, len(xs)), bool)
    for k, part in enumerate(xs):
        x[: len(part), k], mask[: len(part), k] = part, True
    return x, mask


@functools.lru_cache(1)
def trained(pages: int = 1000, rounds: int = 12, seed: int = 3) -> Labeller:
    """A labeller fitted to invented pages whose blocks are known; the same one in every run."""
    rng = np.random.default_rng(seed)
    data = [labelled(leaves(page)) for page in marked_pages(pages, seed)]
    data = [(features(found), main) for found, main in data]
    model = Labeller.fresh(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(rounds):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) + rng.random() * 8)
        for a in rng.permutation(range(0, len(order), 24)):
            part = [data[i] for i in order[a : a + 24]]
            x, mask = batch([f for f, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, label) in enumerate(part):
                y[: len(label), k] = label
            x[..., PATH:] *= rng.random((*mask.shape, WIDTH - PATH), np.float32) > 0.25  # no word or figure is relied on alone
            _, grad = model.loss_gradient(x, mask, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = 0.01 * (1 - epoch / rounds) + 0.001
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.weights[k] = (model.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model
