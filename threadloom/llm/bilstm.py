"""Character-level bidirectional LSTM with a linear-chain CRF, in numpy: forward pass, training and global decoding.

The input projection of an LSTM over characters is a table lookup, so the forward pass costs one small product a
character and direction. Texts are cut into overlapping windows; the emissions of each character are taken from the window
in which it lies farthest from an edge, and the CRF then decodes the whole text at once, so no window border can split or
double an item.
"""

from __future__ import annotations

import numpy as np

from .glyphs import base_pairs

TYPES = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
PAD, OTHER_LETTER, OTHER_SIGN, DROP = 0, 97, 98, -1
VOCAB = 99


def _char_ids() -> dict[int, tuple[int, ...]]:
    """Code point to model ids: ASCII as it is, look-alike and accented letters as their plain letters, invisible as none."""
    import unicodedata

    ids = {c: (c - 31,) for c in range(32, 127)}
    ids[10] = (96,)
    ids |= {9: (1,), 13: ()}
    for form, plain in base_pairs():
        if len(form) == 1 and all(31 < ord(p) < 127 for p in plain):
            ids.setdefault(ord(form), tuple(ord(p) - 31 for p in plain))
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base.isascii():
            ids.setdefault(c, (ord(base) - 31,))
    return ids


class Encoder:
    """Turns text into model ids together with the place in the text each id came from.

    One table over all code points gives the id; a code point that stands for none or several letters is marked in it."""

    NONE, SEVERAL = -1, -2

    def __init__(self) -> None:
        own = _char_ids()
        self.table = np.full(0x110000, OTHER_SIGN, np.int16)
        letters = [c for c in range(0x80, 0x110000) if chr(c).isalpha()]
        self.table[letters] = OTHER_LETTER
        self.table[0x300:0x370] = self.NONE
        self.several = {c: ids for c, ids in own.items() if len(ids) > 1}
        for c, ids in own.items():
            self.table[c] = ids[0] if len(ids) == 1 else self.SEVERAL if ids else self.NONE

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, at = self.table[codes], np.arange(len(codes), dtype=np.int32)
        if (ids < 0).any():
            many = np.array([len(self.several[c]) for c in codes[ids == self.SEVERAL].tolist()], np.int64)
            times = (ids >= 0).astype(np.int64)
            times[ids == self.SEVERAL] = many
            out = np.repeat(ids, times)
            out[out == self.SEVERAL] = [i for c in codes[ids == self.SEVERAL].tolist() for i in self.several[c]]
            ids, at = out, np.repeat(at, times)
        return ids, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Model:
    """Parameters: E embeds characters, W projects them to the gates of both directions, U is recurrent, V emits tags.

    Gates are ordered input, forget, output, candidate. A has the scores of tag pairs, with start and end scores."""

    NAMES = ("E", "W", "b", "U", "V", "c", "A", "start", "end")

    def __init__(self, hidden: int = 40, embed: int = 24, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        k, h = len(TAGS), hidden
        self.E = rng.normal(0, 0.3, (VOCAB, embed)).astype(np.float32)
        self.W = rng.normal(0, 1 / np.sqrt(embed), (2, embed, 4 * h)).astype(np.float32)
        self.b = np.zeros((2, 4 * h), np.float32)
        self.b[:, h : 2 * h] = 1
        self.U = rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)).astype(np.float32)
        self.V = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, k)).astype(np.float32)
        self.c = np.zeros(k, np.float32)
        self.A = np.zeros((k, k), np.float32)
        self.start = np.zeros(k, np.float32)
        self.end = np.zeros(k, np.float32)

    @property
    def hidden(self) -> int:
        return self.U.shape[1]

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{n: getattr(self, n).astype(np.float16) for n in self.NAMES})

    @classmethod
    def load(cls, path: str) -> Model:
        own = cls.__new__(cls)
        with np.load(path) as z:
            for n in cls.NAMES:
                setattr(own, n, z[n].astype(np.float32))
        return own

    # ---- forward -------------------------------------------------------------------------------------------------
    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (T, N, K) of windows x (N, T); padding at the end of a window must be PAD."""
        n, t_all = x.shape
        h = self.hidden
        # a sigmoid is half a tanh of the half plus a half, so that one call serves all gates
        scale = np.repeat(np.float32([0.5, 1.0]), [3 * h, h])
        table = ((np.einsum("ve,deg->dvg", self.E, self.W) + self.b[:, None, :]) * scale).astype(np.float32)
        u = self.U * scale
        lengths = (x != PAD).sum(1)
        steps = np.stack([x.T, _reverse(x, lengths).T]).astype(np.intp)
        hs = np.empty((2, t_all, n, h), np.float32)
        hid, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        g, seen = np.empty((2, n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        for t in range(t_all):
            np.matmul(hid, u, out=g)
            for d in (0, 1):
                g[d] += np.take(table[d], steps[d, t], axis=0, out=seen)
            np.tanh(g, out=g)
            gates, cand = g[:, :, : 3 * h], g[:, :, 3 * h :]
            gates *= 0.5
            gates += 0.5
            cell *= gates[:, :, h : 2 * h]
            cand *= gates[:, :, :h]
            cell += cand
            hid = hs[:, t]
            np.tanh(cell, out=hid)
            hid *= gates[:, :, 2 * h :]
        back = _reverse_time(hs[1], lengths)
        return hs[0] @ self.V[:h] + back @ self.V[h:] + self.c

    # ---- training ------------------------------------------------------------------------------------------------
    def loss_and_grad(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tag paths y (N, T) and its gradient (back-propagation through time)."""
        n, t_all = x.shape
        h = self.hidden
        lengths = (x != PAD).sum(1)
        rev = _reverse(x, lengths)
        xs = (x, rev)
        keep = []
        hid = np.zeros((2, n, h), np.float32)
        cell = np.zeros((2, n, h), np.float32)
        hs = np.empty((2, t_all, n, h), np.float32)
        table = np.einsum("ve,deg->dvg", self.E, self.W) + self.b[:, None, :]
        for t in range(t_all):
            g = np.matmul(hid, self.U)
            g[0] += table[0][x[:, t]]
            g[1] += table[1][rev[:, t]]
            s = _sigmoid(g[:, :, : 3 * h].copy())
            cand = np.tanh(g[:, :, 3 * h :])
            new = s[:, :, h : 2 * h] * cell + s[:, :, :h] * cand
            tc = np.tanh(new)
            keep.append((hid, cell, s, cand, tc))
            hid, cell = s[:, :, 2 * h :] * tc, new
            hs[:, t] = hid
        back = _reverse_time(hs[1], lengths)
        em = hs[0] @ self.V[:h] + back @ self.V[h:] + self.c
        mask = (np.arange(t_all)[:, None] < lengths[None, :]).astype(np.float32)
        loss, d_em, d_a, d_start, d_end = self._crf_grad(em, y.T, mask, lengths)
        d_em /= n
        flat = d_em.reshape(-1, d_em.shape[2])
        grad = {"V": np.concatenate([hs[0].reshape(-1, h).T @ flat, back.reshape(-1, h).T @ flat]), "c": flat.sum(0), "A": d_a / n, "start": d_start / n, "end": d_end / n}
        d_hs = np.stack([d_em @ self.V[:h].T, _reverse_time(d_em @ self.V[h:].T, lengths)])
        d_u = np.zeros_like(self.U)
        d_table = np.zeros_like(table)
        d_gates = np.empty((2, t_all, n, 4 * h), np.float32)
        dh = np.zeros((2, n, h), np.float32)
        dc = np.zeros((2, n, h), np.float32)
        u_t = self.U.transpose(0, 2, 1).copy()
        for t in range(t_all - 1, -1, -1):
            prev_h, prev_c, s, cand, tc = keep[t]
            dh = dh + d_hs[:, t]
            i, f, o = s[:, :, :h], s[:, :, h : 2 * h], s[:, :, 2 * h :]
            dc = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate([dc * cand * i * (1 - i), dc * prev_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], axis=2)
            d_u += np.matmul(prev_h.transpose(0, 2, 1), dg)
            d_gates[:, t] = dg
            dh = np.matmul(dg, u_t)
            dc = dc * f
        for d in (0, 1):
            seen = xs[d].T.ravel()
            order = np.argsort(seen, kind="stable")
            ids, first = np.unique(seen[order], return_index=True)
            d_table[d][ids] = np.add.reduceat(d_gates[d].reshape(-1, 4 * h)[order], first, axis=0)
        d_table[:, PAD] = 0
        grad |= {"U": d_u, "b": d_table.sum(1), "W": np.einsum("ve,dvg->deg", self.E, d_table), "E": np.einsum("dvg,deg->ve", d_table, self.W)}
        return loss / n, grad

    def _crf_grad(self, em, y, mask, lengths):
        t_all, n, k = em.shape
        alpha = np.empty_like(em)
        alpha[0] = self.start + em[0]
        for t in range(1, t_all):
            a = alpha[t - 1][:, :, None] + self.A[None]
            top = a.max(1)
            step = top + np.log(np.exp(a - top[:, None, :]).sum(1)) + em[t]
            m = mask[t][:, None]
            alpha[t] = m * step + (1 - m) * alpha[t - 1]
        last = alpha[-1] + self.end
        top = last.max(1, keepdims=True)
        log_z = (top + np.log(np.exp(last - top).sum(1, keepdims=True)))[:, 0]
        beta = np.empty_like(em)
        beta[-1] = self.end
        d_a = np.zeros_like(self.A)
        for t in range(t_all - 2, -1, -1):
            b = self.A[None] + (em[t + 1] + beta[t + 1])[:, None, :]
            top = b.max(2)
            step = top + np.log(np.exp(b - top[:, :, None]).sum(2))
            m = mask[t + 1][:, None]
            beta[t] = m * step + (1 - m) * self.end
            pair = np.exp(alpha[t][:, :, None] + b - log_z[:, None, None]) * m[:, :, None]
            d_a += pair.sum(0)
        post = np.exp(alpha + beta - log_z[None, :, None]) * mask[:, :, None]
        rows = np.arange(n)
        ends = lengths - 1
        gold = self.start[y[0]] + self.end[y[ends, rows]]
        d_em = post.copy()
        d_start = post[0].sum(0)
        d_end = post[ends, rows].sum(0)
        np.add.at(d_start, y[0], -1)
        np.add.at(d_end, y[ends, rows], -1)
        for t in range(t_all):
            m = mask[t]
            gold = gold + m * em[t, rows, y[t]]
            d_em[t, rows, y[t]] -= m
            if t:
                gold = gold + m * self.A[y[t - 1], y[t]]
                np.add.at(d_a, (y[t - 1], y[t]), -m)
        return float((log_z - gold).sum()), d_em, d_a, d_start, d_end

    # ---- decoding ------------------------------------------------------------------------------------------------
    def viterbi(self, ems: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag path of each whole text, from its emissions (T, K); texts of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(len(e), np.int8) for e in ems]
        order = sorted((i for i in range(len(ems)) if len(ems[i]) and not self._empty(ems[i])), key=lambda i: len(ems[i]))
        at = 0
        while at < len(order):
            part = order[at : at + max(1, min(256, 400_000 // len(ems[order[min(at + 255, len(order) - 1)]])))]
            at += len(part)
            self._viterbi(ems, part, out)
        return out

    def _empty(self, em: np.ndarray) -> bool:
        """Whether the best path is surely without items: no stretch of other tags, with the best emissions and transitions that it could
        have, gains anything against staying outside."""
        a, start, end = self.A, self.start, self.end
        stay, go_on = float(a[0, 0]), float(a[1:, 1:].max())
        enter = max(float(a[0, 1:].max()) - stay, float(start[1:].max() - start[0]))
        leave = max(float(a[1:, 0].max()) - stay, float(end[1:].max() - end[0]))
        sums = np.concatenate([[0.0], np.cumsum(em[:, 1:].max(1) - em[:, 0] + (go_on - stay), dtype=np.float64)])
        best = float((sums[1:] - np.minimum.accumulate(sums[:-1])).max())
        return best - (go_on - stay) + enter + leave < 0

    def _viterbi(self, ems: list[np.ndarray], part: list[int], out: list[np.ndarray]) -> None:
        lengths = np.array([len(ems[i]) for i in part])
        t_all, n, k = lengths.max(), len(part), len(TAGS)
        em = np.zeros((t_all, n, k), np.float32)
        for r, i in enumerate(part):
            em[: lengths[r], r] = ems[i]
        score = self.start + em[0]
        back = np.empty((t_all, n, k), np.int8)
        final = np.where((lengths == 1)[:, None], score, 0)
        to = self.A.T[None]
        for t in range(1, t_all):
            a = score[:, None, :] + to
            best = a.argmax(2)
            back[t] = best
            score = np.take_along_axis(a, best[:, :, None], 2)[:, :, 0] + em[t]
            ended = lengths == t + 1
            if ended.any():
                final[ended] = score[ended]
        tag = (final + self.end).argmax(1)
        paths = np.zeros((t_all, n), np.int8)
        rows = np.arange(n)
        for t in range(t_all - 1, -1, -1):
            live = lengths > t
            paths[t] = np.where(live, tag, 0)
            if t:
                tag = np.where(live, back[t, rows, tag], tag)
        for r, i in enumerate(part):
            out[i] = paths[: lengths[r], r]


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's own ids in reverse, the padding left at the end."""
    at = lengths[:, None] - 1 - np.arange(x.shape[1])[None, :]
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), 1), PAD)


def _reverse_time(hs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for values (T, N, H); zero where there is padding."""
    at = lengths[None, :] - 1 - np.arange(hs.shape[0])[:, None]
    got = hs[np.maximum(at, 0), np.arange(hs.shape[1])[None, :]]
    got[at < 0] = 0
    return got


def windows(length: int, size: int, margin: int) -> list[tuple[int, int, int, int]]:
    """Overlapping windows over a text: (begin, end, own begin, own end); the own parts tile the text.

    As many as are needed, all about as long, so that a text a little longer than one window isn't read twice."""
    if length <= size:
        return [(0, length, 0, length)]
    n = -((2 * margin - length) // (size - 2 * margin))
    each = -(-(length + (n - 1) * 2 * margin) // n)
    out = []
    for i in range(n):
        begin = i * (each - 2 * margin)
        end = length if i == n - 1 else begin + each
        out.append((begin, end, begin + margin if i else 0, end if i == n - 1 else end - margin))
    return out


def spans(path: np.ndarray) -> list[tuple[int, int, str]]:
    """Items of a tag path as (begin, end, type); an I after another type opens an item of its own."""
    out: list[list] = []
    for t, k in enumerate(path):
        if k == 0:
            continue
        kind, begins = TYPES[(k - 1) // 2], k % 2 == 1
        if not begins and out and out[-1][1] == t and out[-1][2] == kind:
            out[-1][1] = t + 1
        else:
            out.append([t, t + 1, kind])
    return [tuple(x) for x in out]
