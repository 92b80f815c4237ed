"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, emissions and decoding."""

from __future__ import annotations

import io

import numpy as np

F4 = np.float32
#: Punctuation that has a class of its own; other characters fall into letters, digits, spaces, rest.
MARKS = "@.-+()_%/:,#='\"\n "
N_CLASSES = len(MARKS) + 7


def classes(text: str) -> np.ndarray:
    """The class of each character; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.zeros(128, np.uint8)
    table[:] = 5
    table[48:58], table[65:91], table[97:123] = 1, 2, 3
    for i, mark in enumerate(MARKS):
        table[ord(mark)] = 6 + i
    return np.where(points < 128, table[np.minimum(points, 127)], 4).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags are 0 (outside) and for kind i 2i + 1 (begin), 2i + 2 (inside)."""

    def __init__(self, tags: int, embed: int = 10, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F4)
        self.h, self.tags = hidden, tags
        self.p = {"E": init(N_CLASSES, embed), "W": np.stack([init(embed, 4 * hidden) for _ in "12"]), "U": np.stack([init(hidden, 4 * hidden) for _ in "12"]), "b": np.zeros((2, 1, 4 * hidden), F4), "O": init(2 * hidden, tags), "o": np.zeros(tags, F4), "A": np.zeros((tags, tags), F4), "s": np.zeros(tags, F4)}
        self.p["b"][..., hidden : 2 * hidden] = 1
        self.blocked = np.zeros((tags, tags), bool)
        for t in range(2, tags, 2):
            self.blocked[:, t] = True
            self.blocked[[t - 1, t], t] = False

    def saved(self) -> bytes:
        """The parameters as an archive of named arrays."""
        out = io.BytesIO()
        np.savez_compressed(out, **self.p)
        return out.getvalue()

    @classmethod
    def loaded(cls, content: bytes) -> Tagger:
        with np.load(io.BytesIO(content), allow_pickle=False) as held:
            p = {k: held[k] for k in held.files}
        out = cls(p["o"].shape[0], p["E"].shape[1], p["U"].shape[1])
        out.p = p
        return out

    def _run(self, chars: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states of both directions, which go side by side, and what their gradients need.

        Inside, time comes first, then direction (the second reads backwards), then window.
        """
        n, length = chars.shape
        x = np.ascontiguousarray(self.p["E"][np.stack([chars, chars[:, ::-1]])].transpose(2, 0, 1, 3))
        pre, H = x @ self.p["W"] + self.p["b"], self.h
        h, c = np.zeros((2, n, H), F4), np.zeros((2, n, H), F4)
        out, kept = np.empty((length, 2, n, H), F4), []
        for t in range(length):
            z = pre[t] + h @ self.p["U"]
            gates, g = _sigmoid(z[..., : 3 * H]), np.tanh(z[..., 3 * H :])
            i, f, o = gates[..., :H], gates[..., H : 2 * H], gates[..., 2 * H :]
            new = f * c + i * g
            tc = np.tanh(new)
            kept.append((h, c, i, f, o, g, tc))
            h, c = o * tc, new
            out[t] = h
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return both.transpose(1, 0, 2), [x, kept]

    def _back(self, state: list, grad: np.ndarray, into: dict) -> np.ndarray:
        """Gradients of the recurrent parameters, and of the characters' embeddings (window, place)."""
        x, kept = state
        length, H = len(kept), self.h
        grad = grad.transpose(1, 0, 2)
        grad = np.stack([grad[..., :H], grad[::-1, :, H:]], axis=1)
        dz_all = np.empty((*grad.shape[:3], 4 * H), F4)
        dh, dc, back = np.zeros(grad.shape[1:], F4), np.zeros(grad.shape[1:], F4), self.p["U"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            _, c, i, f, o, g, tc = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[..., :H], dz[..., H : 2 * H] = dc * g * i * (1 - i), dc * c * f * (1 - f)
            dz[..., 2 * H : 3 * H], dz[..., 3 * H :] = dh * tc * o * (1 - o), dc * i * (1 - g * g)
            dh, dc = dz @ back, dc * f
        flat = lambda a: a.transpose(1, 0, 2, 3).reshape(2, -1, a.shape[-1])
        dz, before = flat(dz_all), flat(np.stack([k[0] for k in kept]))
        into["U"], into["W"], into["b"] = before.transpose(0, 2, 1) @ dz, flat(x).transpose(0, 2, 1) @ dz, dz.sum(1, keepdims=True)
        dx = dz_all @ self.p["W"].transpose(0, 2, 1)
        return (dx[:, 0] + dx[::-1, 1]).transpose(1, 0, 2)

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores of each character of windows of equal length."""
        return self._run(chars)[0] @ self.p["O"] + self.p["o"]

    def _transitions(self) -> np.ndarray:
        return np.where(self.blocked, F4(-1e4), self.p["A"])

    def _start(self) -> np.ndarray:
        start = self.p["s"].copy()
        start[2::2] = -1e4
        return start

    def _loss(self, emit: np.ndarray, gold: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """CRF negative log likelihood, gradients of its scores, gradient of the emissions."""
        n, length, tags = emit.shape
        a, s = self._transitions(), self._start()
        # both recursions go side by side, sums of exponentials as products: states before a place, and from it to the end
        step, both = np.exp(np.stack([a, a.T])), np.stack([emit, emit[:, ::-1]]).transpose(2, 0, 1, 3).copy()
        both[0, 0] += s
        for t in range(1, length):
            top = both[t - 1].max(2, keepdims=True)
            both[t] += np.log(np.exp(both[t - 1] - top) @ step + F4(1e-37)) + top
        alpha, onward = both[:, 0].transpose(1, 0, 2), both[::-1, 1].transpose(1, 0, 2)
        z = _logsumexp(alpha[:, -1], 1)
        marginal = np.exp(alpha + onward - emit - z[:, None, None])
        rows = np.arange(n)[:, None]
        places = np.arange(length)[None, :]
        score = emit[rows, places, gold].sum(1) + s[gold[:, 0]] + a[gold[:, :-1], gold[:, 1:]].sum(1)
        d_emit = marginal.copy()
        d_emit[rows, places, gold] -= 1
        ahead = alpha[:, :-1, :, None] + a + onward[:, 1:, None, :] - z[:, None, None, None]
        d_a = np.exp(ahead).sum((0, 1), dtype=np.float64)
        np.add.at(d_a, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        d_a[self.blocked] = 0
        d_s = marginal[:, 0].sum(0)
        np.add.at(d_s, gold[:, 0], -1)
        d_s[2::2] = 0
        return float((z - score).mean()), {"A": (d_a / n).astype(F4), "s": (d_s / n).astype(F4)}, d_emit / n

    def train(self, chars: np.ndarray, gold: np.ndarray, steps: int = 240, batch: int = 64, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random batches; returns the mean loss of the last tenth."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            take = rng.integers(0, len(chars), batch)
            c, y = chars[take], gold[take]
            hidden, state = self._run(c)
            loss, grad, d_emit = self._loss(hidden @ self.p["O"] + self.p["o"], y)
            losses.append(loss)
            grad["O"], grad["o"] = hidden.reshape(-1, hidden.shape[2]).T @ d_emit.reshape(-1, self.tags), d_emit.sum((0, 1))
            d_hidden = d_emit @ self.p["O"].T
            dx = self._back(state, d_hidden, grad)
            grad["E"] = np.zeros_like(self.p["E"])
            np.add.at(grad["E"], c.ravel(), dx.reshape(-1, dx.shape[2]))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = (g * scale).astype(F4)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(F4)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def decode(self, emit: np.ndarray) -> np.ndarray:
        """The best tag sequence of one stretch of emissions."""
        a, score, back = self._transitions(), self._start() + emit[0], []
        for t in range(1, len(emit)):
            step = score[:, None] + a
            best = step.argmax(0)
            back.append(best)
            score = step[best, np.arange(self.tags)] + emit[t]
        tag = int(score.argmax())
        path = [tag]
        for best in reversed(back):
            tag = int(best[tag])
            path.append(tag)
        return np.array(path[::-1])


def stitched(tagger: Tagger, texts: list[np.ndarray], places: list[list[int]], size: int) -> list[list[tuple[int, np.ndarray]]]:
    """Decodes the windows of ``size`` at the given starts of each text, overlaps reconciled.

    Where windows overlap, their emissions are averaged with weights that rise from a window's edges; each
    stretch of windows that touch is then decoded once as a whole. Returns (start, tags) of each stretch.
    """
    stack = [(i, s) for i, starts in enumerate(places) for s in starts]
    chars = np.zeros((len(stack), size), np.int64)
    for row, (i, s) in enumerate(stack):
        part = texts[i][s : s + size]
        chars[row, : len(part)] = part
    emit = [tagger.emissions(chars[x : x + 512]) for x in range(0, len(stack), 512)]
    emit = np.concatenate(emit) if emit else np.empty((0, size, tagger.tags), F4)
    weight = np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)).astype(F4)
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    row = 0
    while row < len(stack):
        i, begin = stack[row]
        last = row
        while last + 1 < len(stack) and stack[last + 1][0] == i and stack[last + 1][1] <= stack[last][1] + size:
            last += 1
        stop = min(len(texts[i]), stack[last][1] + size)
        total, mass = np.zeros((stop - begin, tagger.tags), F4), np.zeros(stop - begin, F4)
        for r in range(row, last + 1):
            a = stack[r][1] - begin
            n = min(size, stop - begin - a)
            total[a : a + n] += emit[r, :n] * weight[:n, None]
            mass[a : a + n] += weight[:n]
        out[i].append((begin, tagger.decode(total / mass[:, None])))
        row = last + 1
    return out
