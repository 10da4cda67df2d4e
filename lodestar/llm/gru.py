"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state."""

from __future__ import annotations

import copy
import math

import numpy as np


#: Rows whose output probabilities are made at once: what fits a core's cache.
BLOCK = 2048


def _with_ones(x: np.ndarray) -> np.ndarray:
    """``x`` with a last column of ones, the input of a bias."""
    out = np.ones((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1] = x
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sums(x: np.ndarray, classes: int, bounded: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sum over both parts of the rows (classes, then members) of the log of the sum of exponentials of each column.

    ``x`` is overwritten by the exponentials, less the largest of a part's column unless ``bounded``; the sums of both parts are returned too.
    """
    parts, top = (x[:classes], x[classes:]), 0
    if not bounded:
        for part in parts:
            most = part.max(0)
            part -= most
            top = top + most
    np.exp(x, out=x)
    totals = [part.sum(0) for part in parts]
    log = np.log(totals[0])
    log += np.log(totals[1])
    log += top
    return log, totals


class GatedModel:
    """Next-token probabilities p(class | state) * p(token | class, state); token i is in class i // ``members``.

    Output biases start at the unigram log probabilities, so the untrained model is the unigram model.
    """

    NAMES = ("emb", "wx", "bx", "u", "wc", "bc", "ww", "bw")

    def __init__(self, weights: np.ndarray, members: int = 64, emb: int = 24, hidden: int = 32, seed: int = 3):
        r = np.random.default_rng(seed)
        f = np.float32
        self.members, self.hidden, v = members, hidden, len(weights)
        self.classes = v // members
        p = (weights + 0.5).reshape(self.classes, members)
        self.emb = (r.standard_normal((v, emb)) * 0.3).astype(f)
        self.wx = (r.standard_normal((emb, 3 * hidden)) / np.sqrt(emb)).astype(f)
        self.bx = np.zeros(3 * hidden, f)
        self.u = (r.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f)
        self.wc = np.zeros((hidden, self.classes), f)
        self.bc = np.log(p.sum(1) / p.sum()).astype(f)
        self.ww = np.zeros((self.classes, hidden, members), f)
        self.bw = np.log(p / p.sum(1, keepdims=True)).astype(f)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rooms"}

    def room(self, name: str, shape: tuple[int, ...], kind: type = np.float32) -> np.ndarray:
        """An array to write over, the same one for each window: fresh memory costs more than the arithmetic on it."""
        rooms, size = self.__dict__.setdefault("rooms", {}), math.prod(shape)
        if name not in rooms or rooms[name].size < size or rooms[name].dtype != kind:
            rooms[name] = np.empty(size, kind)
        return rooms[name][:size].reshape(shape)

    def step(self, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.hidden
        gh = h @ self.u
        zr = _sigmoid(gx[:, : 2 * n] + gh[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
        return c + z * (h - c), z, r, c, gh[:, 2 * n :]

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, list[tuple[int, slice]]]]]:
        """Rows ordered by the target's class; blocks of BLOCK rows of that order with the rows of each class inside a block."""
        k = (target // self.members).astype(np.int16)
        order = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[order], np.arange(self.classes + 1, dtype=np.int16)).tolist()
        blocks, c = [], 0
        for a in range(0, len(target), BLOCK):
            b, own, at = min(a + BLOCK, len(target)), [], a
            while at < b:
                while cut[c + 1] <= at:
                    c += 1
                end = min(cut[c + 1], b)
                own.append((c, slice(at - a, end - a)))
                at = end
            blocks.append((slice(a, b), own))
        return order, blocks

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Input weights with their bias and recurrent weights, outputs first; halves for both gates, whose sigmoid is a hyperbolic tangent of half."""
        half = np.repeat(np.array([0.5, 1], self.u.dtype), [2 * self.hidden, self.hidden])
        return np.concatenate([self.wx, self.bx[None]]).T * half[:, None], self.u.T * half[:, None]

    def outputs(self) -> tuple[np.ndarray, bool]:
        """For each class: weights of all classes and of its members, with the biases as a last input. And whether no logit of
        states between -1 and 1 leaves the range in which exponentials are safe as they are."""
        c, n = self.classes, self.hidden
        w = self.room("outputs", (c, n + 1, c + self.members), self.ww.dtype)
        w[:, :n, :c], w[:, n, :c], w[:, :n, c:], w[:, n, c:] = self.wc, self.bc, self.ww, self.bw
        size = lambda a: np.abs(a, out=self.room("size", a.shape, a.dtype))
        most = max(float(size(a).sum(-2).max()) + float(size(b).max()) for a, b in ((self.wc, self.bc), (self.ww, self.bw)))
        return w, bool(most < 60)

    def places(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the logits (one after another, targets as columns) have those of each target's class and of its place in the class."""
        k, at = target // self.members, np.arange(len(target))
        return k * len(target) + at, (target - k * self.members + self.classes) * len(target) + at

    def log_probabilities(self, states: np.ndarray, target: np.ndarray, outputs: tuple[np.ndarray, bool] | None = None) -> np.ndarray:
        """Natural log probability of each target at its state. ``outputs``: what that method gives, if it has been asked."""
        order, blocks = self.by_class(target)
        w, bounded = outputs or self.outputs()
        bounded = bounded and len(states) > 0 and max(states.max(), -states.min()) <= 1
        out = np.empty(len(target))
        for span, own in blocks:
            rows = order[span]
            s, (a, b) = _with_ones(states[rows]), self.places(target[rows])
            x = self.room("logits", (w.shape[2], len(rows)), s.dtype)
            for k, part in own:
                np.matmul(w[k].T, s[part].T, out=x[:, part])
            flat = x.reshape(-1)
            log = flat[a].astype(np.float64)
            log += flat[b]
            log -= _log_sums(x, self.classes, bounded)[0]
            out[rows] = log
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients over one window (time, lane), the state after it, and the mean loss. ``first``: a text begins here.

        Inside, lanes are the last axis, so that every operation runs over contiguous numbers.
        """
        steps, lanes = inputs.shape
        n, f = self.hidden, np.float32
        emb = self.room("emb", (len(self.emb), self.emb.shape[1] + 1), self.emb.dtype)
        emb[:, :-1], emb[:, -1] = self.emb, 1
        x = np.take(emb, inputs, 0, out=self.room("x", (steps, lanes, emb.shape[1]), emb.dtype), mode="clip")
        wx, u = self.inputs()
        gx = np.matmul(wx, x.transpose(0, 2, 1), out=self.room("gx", (steps, 3 * n, lanes)))
        before, states, cs = self.room("states", (3, steps, n, lanes))
        gh = self.room("gh", (steps, 3 * n, lanes))
        starts = [np.flatnonzero(s) for s in first]
        h = h.T
        for t in range(steps):
            before[t] = h
            if len(starts[t]):
                before[t][:, starts[t]] = 0
            h, c, g, zr = states[t], cs[t], gh[t], gx[t, : 2 * n]
            np.matmul(u, before[t], out=g)
            zr += g[: 2 * n]
            np.tanh(zr, out=zr)
            zr += f(1)
            zr *= f(0.5)
            np.multiply(zr[n:], g[2 * n :], out=c)
            c += gx[t, 2 * n :]
            np.tanh(c, out=c)
            np.subtract(before[t], c, out=h)
            h *= zr[:n]
            h += c
        last, target, count = h, targets.ravel(), targets.size
        order, blocks = self.by_class(target)
        flat = self.room("flat", (steps, lanes, n + 1), states.dtype)
        flat[..., :n] = states.transpose(0, 2, 1)
        flat[..., n] = 1
        flat = flat.reshape(-1, n + 1)
        w, bounded = self.outputs()
        gw, loss, share = self.room("gw", w.shape, w.dtype), 0.0, w.dtype.type(1 / count)
        gw[...] = 0
        width = min(BLOCK, count)
        back, kept = self.room("back", (count, n), w.dtype), self.room("kept", (width, n + 1), flat.dtype)
        for span, own in blocks:
            rows = order[span]
            s, (a, b) = np.take(flat, rows, 0, out=kept[: len(rows)], mode="clip"), self.places(target[rows])
            x_s, to_s = self.room("logits", (w.shape[2], len(rows)), w.dtype), self.room("to_s", (len(rows), n), w.dtype)
            for k, part in own:
                np.matmul(w[k].T, s[part].T, out=x_s[:, part])
            line = x_s.reshape(-1)
            loss -= float(line[a].sum(dtype=np.float64) + line[b].sum(dtype=np.float64))
            log, totals = _log_sums(x_s, self.classes, bounded)
            loss += float(log.sum(dtype=np.float64))
            x_s[: self.classes] *= share / totals[0]
            x_s[self.classes :] *= share / totals[1]
            line[a] -= share
            line[b] -= share
            for k, part in own:
                x_k = x_s[:, part].T
                gw[k] += s[part].T @ x_k
                np.matmul(x_k, w[k, :n].T, out=to_s[part])
            back[rows] = to_s
        gc, gw = gw[..., : self.classes].sum(0), gw[..., self.classes :]
        g = {"wc": gc[:n], "bc": gc[n], "ww": gw[:, :n], "bw": gw[:, n]}
        turned = self.room("turned", (steps, n, lanes))
        turned[...] = back.reshape(steps, lanes, n).transpose(0, 2, 1)
        back = turned
        d = self.room("d", (steps, 4 * n, lanes))  # of the candidate's input, of z, of r, of the candidate's recurrent part
        carry = np.zeros((n, lanes), f)
        for t in range(steps - 1, -1, -1):
            dh, c, z, r, (dc, dz, dr, dcr) = back[t], cs[t], gx[t, :n], gx[t, n : 2 * n], d[t].reshape(4, n, lanes)
            dh += carry
            rest = 1 - z
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= rest
            dc *= dh
            np.subtract(states[t], c, out=dz)  # z (h - c)
            dz *= rest
            dz *= dh
            np.multiply(dc, r, out=dcr)
            np.subtract(1, r, out=dr)
            dr *= dcr
            dr *= gh[t, 2 * n :]
            carry = self.u @ d[t, n:]
            dh *= z
            carry += dh
            if len(starts[t]):
                carry[:, starts[t]] = 0
        passed = flat.reshape(steps, lanes, n + 1)  # the states as inputs of the next step
        for t in range(1, steps):
            if len(starts[t]):
                passed[t - 1, starts[t]] = 0
        g["u"] = before[0] @ d[0, n:].T + (d[1:, n:] @ passed[:-1]).sum(0).T[:n]
        d = d[:, : 3 * n]
        both = np.roll((d @ x).sum(0).T, -n, 1)  # from (candidate, z, r) to the order of the parameters
        g["wx"], g["bx"] = both[:-1], both[-1]
        dx = np.matmul(d.transpose(0, 2, 1), np.roll(self.wx, n, 1).T, out=self.room("dx", (steps, lanes, emb.shape[1] - 1))).reshape(count, -1)
        token = inputs.ravel()
        order = np.argsort(token.astype(np.int16) if len(self.emb) < 1 << 15 else token, kind="stable")
        token = token[order]
        heads = np.append(0, np.flatnonzero(token[1:] != token[:-1]) + 1)
        g["emb"] = self.room("g", self.emb.shape, dx.dtype)
        g["emb"][...] = 0
        g["emb"][token[heads]] = np.add.reduceat(np.take(dx, order, 0, out=self.room("turned", dx.shape, dx.dtype), mode="clip"), heads, 0)
        return g, last.T, loss / count

    def descend(self, before: np.ndarray, target: np.ndarray, first: np.ndarray, lanes: int, window: int, epochs: int, rate: float, moments: tuple | None = None, decay: bool = True) -> tuple:
        """Truncated backpropagation over a stream of tokens cut into parallel lanes, each filled up from the stream's start.

        Returns the moments of the steps taken, with which a later call goes on.
        """
        lanes = max(1, min(lanes, len(target) // window))
        long = -(-len(target) // lanes)
        cut = lambda a: np.resize(a, long * lanes).reshape(lanes, long).T
        x, y, s = cut(before), cut(target), cut(first)
        at = self.parameters()
        self.see(at)
        m1, m2, n0 = moments or (np.zeros_like(at), np.zeros_like(at), 0)
        d, parts, place = np.empty_like(at), [], 0
        for k in self.NAMES:
            own = getattr(self, k)
            parts.append((k, d[place : place + own.size].reshape(own.shape)))
            place += own.size
        n, total = 0, epochs * -(-long // window)
        for _ in range(epochs):
            h = np.zeros((lanes, self.hidden), np.float32)
            for t in range(0, long, window):
                g, h, _ = self.gradients(x[t : t + window], y[t : t + window], s[t : t + window], h)
                n += 1
                scale = rate * (1 - n / (total + 1) if decay else 1) * math.sqrt(1 - 0.99 ** (n0 + n)) / (1 - 0.9 ** (n0 + n))
                for k, own in parts:
                    own[...] = g[k]
                # Means of gradients and of squares are kept as sums, ten and a hundred times as large: so is the root's least value.
                m1 *= 0.9
                m1 += d
                d *= d
                m2 *= 0.99
                m2 += d
                np.sqrt(m2, out=d)
                d += 1e-6
                np.divide(m1, d, out=d)
                d *= scale
                at -= d
        moments = m1, m2, n0 + n
        return moments

    def fit(self, texts: list[np.ndarray], end: int, lanes: int = 32, window: int = 32, epochs: int = 2, rate: float = 0.006) -> GatedModel:
        """Fit over whole texts (each ends with ``end``), laid end to end."""
        stream = np.concatenate(texts)
        starts = np.zeros(len(stream), bool)
        starts[np.cumsum([0, *map(len, texts[:-1])])] = True
        before = np.where(starts, end, np.roll(stream, 1))
        epochs = max(epochs, min(40, 250 * window * lanes // max(len(stream), 1)))  # a small sample still gets some hundred steps
        self.descend(before, stream, starts, lanes, window, epochs, rate)
        return self

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def see(self, flat: np.ndarray) -> None:
        """Take the parameters from the parts of ``flat``, which stay one memory."""
        at = 0
        for k in self.NAMES:
            own = getattr(self, k)
            setattr(self, k, flat[at : at + own.size].reshape(own.shape))
            at += own.size

    def with_parameters(self, flat: np.ndarray) -> GatedModel:
        """This model with other parameters, in the order of ``parameters``."""
        out = copy.copy(self)
        out.see(flat.astype(np.float32))
        return out

    def score(self, texts: list[np.ndarray], end: int, lanes: int = 256, window: int = 64) -> np.ndarray:
        """Natural log probability of each whole text: lanes of texts laid end to end, state carried over windows, zero at a text's start."""
        out = np.zeros(len(texts))
        if not texts:
            return out
        n, f = self.hidden, np.float32
        emb, (wx, u), outputs = _with_ones(self.emb), self.inputs(), self.outputs()
        longest = max(map(len, texts))
        load = np.zeros(min(lanes, -(-sum(map(len, texts)) // longest)), np.int64)  # no more lanes than the longest text fills
        owned: list[list[int]] = [[] for _ in load]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            k = int(load.argmin())
            owned[k].append(i)
            load[k] += len(texts[i])
        rank = np.argsort(-load, kind="stable")  # lanes that last longest come first
        owned, load = [owned[k] for k in rank], load[rank]
        steps = int(load[0])
        y_all = np.full((len(load), steps), end, np.int32)
        who_all = np.full((len(load), steps), -1, np.int32)
        for k, own in enumerate(owned):
            y_all[k, : load[k]] = np.concatenate([texts[i] for i in own])
            who_all[k, : load[k]] = np.repeat(own, [len(texts[i]) for i in own])
        first_all = np.diff(who_all, axis=1, prepend=-1) != 0
        x_all = np.where(first_all, end, np.roll(y_all, 1, axis=1))
        h = np.zeros((n, len(load)), f)
        for t0 in range(0, steps, window):
            live = int(np.searchsorted(-load, -t0, "left"))
            span = slice(t0, min(t0 + window, steps))
            x, y, who, first = (np.ascontiguousarray(a[:live, span].T) for a in (x_all, y_all, who_all, first_all))
            h = np.ascontiguousarray(h[:, :live])
            states = self.room("states", (len(x), n, live))
            gx = np.matmul(wx, np.take(emb, x, 0, out=self.room("x", (*x.shape, emb.shape[1]), emb.dtype), mode="clip").transpose(0, 2, 1), out=self.room("gx", (len(x), 3 * n, live)))
            for t in range(len(x)):
                if first[t].any():
                    h[:, first[t]] = 0
                gh = u @ h
                zr = gx[t, : 2 * n]
                zr += gh[: 2 * n]
                np.tanh(zr, out=zr)
                zr += f(1)
                zr *= f(0.5)
                c = gh[2 * n :]
                c *= zr[n:]
                c += gx[t, 2 * n :]
                np.tanh(c, out=c)
                h = h - c
                h *= zr[:n]
                h += c
                states[t] = h
            used = who >= 0
            out += np.bincount(who[used], self.log_probabilities(states.transpose(0, 2, 1)[used], y[used], outputs), len(out))
        return out
