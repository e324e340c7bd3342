"""Linear chains of a few states over whole texts: exact scaled forward and backward recursions, for many texts at once.

A text is handled in pieces of at most PIECE tokens, without loss: the product of a piece's transitions and token weights (its
transfer matrix) carries the forward vector from the piece before into it, and the backward vector from the piece after.
When those are known at each piece's ends, all pieces go on side by side, and only a batch of them is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

PIECE = 2048
#: Tokens of the pieces that are held at once.
BATCH = 1_000_000


class Chains:
    """Chains of texts with `lengths` tokens, which lie one text after the other.

    start (k) and trans (k, k) are factors of the first state and of steps from state to state; weigh(at) gives the factors (n, k)
    of the tokens at the flat places `at`. Texts without tokens have no pieces and a log sum of 0."""

    def __init__(self, lengths: np.ndarray, weigh: Callable[[np.ndarray], np.ndarray], start: np.ndarray, trans: np.ndarray, piece: int = PIECE, batch: int = BATCH) -> None:
        lengths = np.asarray(lengths, np.int64)
        self.weigh, self.start, self.trans, self.batch, self.n_texts = weigh, np.asarray(start, float), np.asarray(trans, float), batch, len(lengths)
        many = -(-lengths // piece)
        self.text = np.repeat(np.arange(len(lengths)), many)
        self.ordinal = np.arange(len(self.text)) - np.repeat(np.cumsum(many) - many, many)
        self.begin = (np.cumsum(lengths) - lengths)[self.text] + self.ordinal * piece
        self.size = np.minimum(piece, lengths[self.text] - self.ordinal * piece)
        k = len(self.start)
        self.enter = np.tile(self.start, (len(self.text), 1))  # forward vector before a piece's first weight
        self.before = np.zeros((len(self.text), k))  # that at the end of the piece before; 0 where there is none
        self.leave = np.ones((len(self.text), k))  # backward vector at a piece's end
        self._link(np.flatnonzero(many[self.text] > 1))

    def _groups(self, pieces: np.ndarray, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces by falling size, in groups: the group, how many of it are alive at each step, the steps' starts, and the tokens' places step by step."""
        pieces = pieces[np.argsort(-self.size[pieces], kind="stable")]
        turn = (np.cumsum(self.size[pieces]) - self.size[pieces]) // batch
        for g in np.split(pieces, np.flatnonzero(np.diff(turn)) + 1) if len(pieces) else ():
            size = self.size[g]
            alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
            starts = np.concatenate(([0], np.cumsum(alive)))
            rank = np.arange(starts[-1]) - np.repeat(starts[:-1], alive)
            yield g, alive, starts, self.begin[g][rank] + np.repeat(np.arange(len(alive)), alive)

    def _link(self, pieces: np.ndarray) -> None:
        """The vectors at the ends of the pieces of texts that have more than one."""
        if not len(pieces):
            return
        k = len(self.start)
        place = np.zeros(len(self.text), np.int64)
        place[pieces] = np.arange(len(pieces))
        transfer = np.empty((len(pieces), k, k))
        for g, alive, starts, at in self._groups(pieces, max(1, self.batch // k)):
            w = self.weigh(at).astype(float)
            m = np.eye(k) * w[: alive[0], None, :]
            for t in range(1, len(alive)):
                n = alive[t]
                x = m[:n]
                x[:] = (x.reshape(n * k, k) @ self.trans).reshape(n, k, k)
                x *= w[starts[t] : starts[t + 1], None, :]
                if t % 4 == 3:
                    x /= (x.reshape(n, k * k) @ np.ones(k * k))[:, None, None]
            transfer[place[g]] = m / m.sum((1, 2), keepdims=True)
        last = np.append(self.text[1:] != self.text[:-1], True)
        by_ordinal = pieces[np.argsort(self.ordinal[pieces], kind="stable")]
        rounds = np.split(by_ordinal, np.flatnonzero(np.diff(self.ordinal[by_ordinal])) + 1)
        for now in rounds[1:]:
            v = np.einsum("ni,nij->nj", self.enter[now - 1], transfer[place[now - 1]])
            self.before[now] = v / v.sum(1, keepdims=True)
            self.enter[now] = self.before[now] @ self.trans
        for now in rounds[::-1]:
            now = now[~last[now]]
            v = np.einsum("nij,nj->ni", transfer[place[now + 1]], self.leave[now + 1]) @ self.trans.T
            self.leave[now] = v / v.sum(1, keepdims=True)

    def log_sums(self) -> np.ndarray:
        """For each text the natural logarithm of the sum over all its state sequences."""
        out = np.zeros(len(self.text))
        for g, alive, starts, at in self._groups(np.arange(len(self.text)), self.batch):
            w = self.weigh(at).astype(float)
            a, ones = self.enter[g], np.ones(len(self.start))
            following = np.append(alive[1:], 0)
            for t, n in enumerate(alive.tolist()):
                a = (a[:n] @ self.trans if t else a) * w[starts[t] : starts[t + 1]]
                if t % 4 == 3 or following[t] < n:
                    z = a @ ones
                    a /= z[:, None]
                    out[g[:n]] += np.log(z)
        return np.bincount(self.text, out, self.n_texts)

    def marginals(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
        """Batch by batch: tokens' places, their state probabilities, sums of those of first tokens, expected steps from state to state, and the logarithm.

        It works at the precision of the weights, and scales vectors every other step if that is single."""
        k = len(self.start)
        for g, alive, starts, at in self._groups(np.arange(len(self.text)), self.batch):
            w = self.weigh(at)
            single = w.dtype == np.float32
            every = 2 if single else 4
            trans, ones, a = self.trans.astype(w.dtype), np.ones(k, w.dtype), self.enter[g].astype(w.dtype)
            alpha, scales, log = np.empty_like(w), {}, 0.0
            following = np.append(alive[1:], 0)
            for t, n in enumerate(alive.tolist()):
                x = alpha[starts[t] : starts[t + 1]]
                x[:] = a[:n] @ trans if t else a
                x *= w[starts[t] : starts[t + 1]]
                a = x
                if t % every == every - 1:
                    scales[t] = z = x @ ones
                    a = x / z[:, None]
                    log += float(np.log(z).sum())
                elif following[t] < n:
                    log += float(np.log(x[following[t] :] @ ones).sum())
            moves, beta = np.zeros((k, k)), np.zeros((0, k), w.dtype)
            for t in range(len(alive) - 1, -1, -1):
                lo, hi, n = starts[t], starts[t + 1], alive[t]
                if len(beta) < n:  # pieces that end here
                    beta = np.concatenate((beta, self.leave[g[len(beta) : n]].astype(w.dtype)))
                x = alpha[lo:hi]
                x *= beta
                z = x @ ones
                x /= z[:, None]
                right = w[lo:hi] * beta
                by = z if t - 1 not in scales else z * scales[t - 1][:n]
                before = alpha[starts[t - 1] : starts[t - 1] + n] if t else self.before[g].astype(w.dtype)
                moves += before.T @ (right / by[:, None])
                if t:
                    beta = right @ trans.T
                    if t % every == 0:
                        beta /= (beta @ ones)[:, None]
            first = alpha[: alive[0]][self.ordinal[g] == 0].sum(0)
            yield at, alpha, first, moves * self.trans, log
