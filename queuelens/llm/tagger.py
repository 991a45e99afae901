"""A character-level bidirectional LSTM with a conditional random field on top, in numpy."""

import numpy as np

#: Characters told apart: ASCII one by one, letters and everything else beyond it as one class each.
VOCABULARY = 130


def codes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, 129))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Tags each character; tag 0 is outside. Weights are plain arrays, so it travels by pickling."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        self.w = {"out": r.normal(0, 0.3, (2 * hidden, tags)), "bias": np.zeros(tags), "move": np.zeros((tags, tags)), "begin": np.zeros(tags)}
        for side in ("f", "b"):
            self.w[f"in_{side}"] = r.normal(0, 0.3, (VOCABULARY, 4 * hidden))
            self.w[f"in_{side}"][:, hidden : 2 * hidden] += 1.0  # remember by default
            self.w[f"rec_{side}"] = r.normal(0, 0.2, (hidden, 4 * hidden))

    def _pass(self, codes: np.ndarray, side: str, keep: bool = False):
        """Hidden states of one direction over rows of equal length."""
        n, length = codes.shape
        k = self.hidden
        h, c = np.zeros((n, k)), np.zeros((n, k))
        states, trail = np.empty((length, n, k)), []
        steps = range(length) if side == "f" else range(length - 1, -1, -1)
        for t in steps:
            z = self.w[f"in_{side}"][codes[:, t]] + h @ self.w[f"rec_{side}"]
            gates, new = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            last_c, last_h = c, h
            c = f * last_c + i * new
            shown = np.tanh(c)
            h = o * shown
            states[t] = h
            if keep:
                trail.append((t, i, f, o, new, last_c, last_h, shown))
        return states, trail

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Score of every tag: rows, places, tags."""
        both = np.concatenate((self._pass(codes, "f")[0], self._pass(codes, "b")[0]), 2)
        return (both @ self.w["out"] + self.w["bias"]).transpose(1, 0, 2)

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each sequence by Viterbi; sequences of about equal length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
        for first in range(0, len(order), 128):
            some = order[first : first + 128]
            sizes = np.array([len(scores[i]) for i in some])
            padded = np.zeros((len(some), sizes.max(), self.tags))
            for row, i in enumerate(some):
                padded[row, : sizes[row]] = scores[i]
            best = padded[:, 0] + self.w["begin"]
            back = np.zeros(padded.shape, np.int8)
            ends = np.empty((len(some), self.tags))
            ends[sizes == 1] = best[sizes == 1]
            for t in range(1, padded.shape[1]):
                paths = best[:, :, None] + self.w["move"]
                back[:, t] = paths.argmax(1)
                best = paths.max(1) + padded[:, t]
                ends[sizes == t + 1] = best[sizes == t + 1]
            for row, i in enumerate(some):
                tags = np.empty(sizes[row], np.int64)
                tags[-1] = ends[row].argmax()
                for t in range(sizes[row] - 1, 0, -1):
                    tags[t - 1] = back[row, t, tags[t]]
                out[i] = tags
        return out

    def _gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, length = codes.shape
        k, w = self.hidden, self.w
        f_states, f_trail = self._pass(codes, "f", True)
        b_states, b_trail = self._pass(codes, "b", True)
        both = np.concatenate((f_states, b_states), 2)
        scores = both @ w["out"] + w["bias"]
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + w["begin"]

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

        for t in range(1, length):
            ahead[t] = total(ahead[t - 1][:, :, None] + w["move"], 1) + scores[t]
        for t in range(length - 2, -1, -1):
            behind[t] = total(w["move"] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        z = total(ahead[-1], 1)
        rows = np.arange(n)
        share = np.exp(ahead + behind - z[None, :, None])
        g = {name: np.zeros_like(x) for name, x in w.items()}
        loss = z.sum() - w["begin"][gold[:, 0]].sum()
        g["begin"] = share[0].sum(0) - np.bincount(gold[:, 0], minlength=self.tags)
        for t in range(length):
            loss -= scores[t, rows, gold[:, t]].sum()
            if t:
                loss -= w["move"][gold[:, t - 1], gold[:, t]].sum()
                pairs = np.exp(ahead[t - 1][:, :, None] + w["move"] + (scores[t] + behind[t])[:, None, :] - z[:, None, None])
                g["move"] += pairs.sum(0)
                np.add.at(g["move"], (gold[:, t - 1], gold[:, t]), -1)
        d = share
        for t in range(length):
            d[t, rows, gold[:, t]] -= 1
        g["bias"] = d.sum((0, 1))
        g["out"] = np.tensordot(both, d, ((0, 1), (0, 1)))
        d_states = d @ w["out"].T
        for side, trail, mine in (("f", f_trail, d_states[:, :, :k]), ("b", b_trail, d_states[:, :, k:])):
            dh, dc = np.zeros((n, k)), np.zeros((n, k))
            for t, i, f, o, new, last_c, last_h, shown in reversed(trail):
                dh = dh + mine[t]
                dc = dc + dh * o * (1 - shown**2)
                dz = np.concatenate(
                    (dc * new * i * (1 - i), dc * last_c * f * (1 - f), dh * shown * o * (1 - o), dc * i * (1 - new**2)), 1
                )
                np.add.at(g[f"in_{side}"], codes[:, t], dz)
                g[f"rec_{side}"] += last_h.T @ dz
                dh, dc = dz @ w[f"rec_{side}"].T, dc * f
        return float(loss), g

    def train(self, codes: np.ndarray, gold: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam on the negative log-likelihood; returns the loss per character of each round."""
        r = np.random.default_rng(seed)
        first = {name: np.zeros_like(x) for name, x in self.w.items()}
        second = {name: np.zeros_like(x) for name, x in self.w.items()}
        step, losses = 0, []
        for turn in range(rounds):
            order, lost = r.permutation(len(codes)), 0.0
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                loss, g = self._gradients(codes[some], gold[some])
                lost += loss
                step += 1
                scale = min(1.0, 5.0 * len(some) / (1e-9 + np.sqrt(sum((x**2).sum() for x in g.values()))))
                for name, x in g.items():
                    x = x * scale / len(some)
                    first[name] = 0.9 * first[name] + 0.1 * x
                    second[name] = 0.99 * second[name] + 0.01 * x**2
                    move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.w[name] -= rate * (0.5 if turn > rounds * 0.6 else 1.0) * move
            losses.append(lost / max(1, codes.size))
        return losses
