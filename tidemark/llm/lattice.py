"""Subword lattices over an existing piece vocabulary: arcs, best paths, marginals, boundary-state matrices (numpy)."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = "▁"
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
NEG = -np.inf


@dataclass
class Vocabulary:
    """Pieces with ids and scores; an unknown character is spelled by byte pieces, as one arc."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray  # 256 ids
    normal: np.ndarray  # ids that may label an arc

    @classmethod
    def read(cls, model: bytes) -> Vocabulary:
        """From the bytes of a SentencePiece model file.  Scores are kept to multiples of 2**-8, so that sums are exact
        whatever the order."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        scores = np.round(np.array([sp.get_score(i) for i in range(n)], np.float64) * 256) / 256
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in byte_ids):
            raise ValueError("the vocabulary needs all 256 byte pieces to spell unknown characters")
        normal = np.array([i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))], np.int32)
        return cls(pieces, scores, byte_ids, normal)


class Lattice:
    """Finds the arcs of many strings at once and runs dynamic programs over all of them position by position.

    A piece is found by a rolling hash over code points; extending only while the string so far is the head of some piece
    keeps the number of probes near the number of arcs.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        texts = [vocab.pieces[i] for i in vocab.normal]
        self.width = max(map(len, texts))
        heads: dict[int, int] = {}
        mask = (1 << 64) - 1
        for i, t in zip(vocab.normal.tolist(), texts):
            h = 1
            for k, c in enumerate(t):
                h = ((h ^ ord(c)) * int(_R)) & mask
                h = (h ^ (h >> 29)) & mask
                if k == len(t) - 1:
                    heads[h] = i
                else:
                    heads.setdefault(h, -1)
        self.main, self.spill = _table(heads)
        # no piece goes on over a space that follows a non-space: such places cut every lattice
        self.cuts_at_spaces = not any(SPACE in t.lstrip(SPACE) for t in texts)
        # the vocabulary's own scores; the bytes of an unknown character cost more than any piece
        self.own = vocab.scores.copy()
        self.own[vocab.byte_ids] = self.own[vocab.normal].min() - 10

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the first table, or past its size in the second, -1 if in neither."""
        slot = (h >> _SHIFT).astype(np.int64)
        hit = self.main[0][slot] == h
        second = ((h >> np.uint64(20)) & np.uint64(len(self.spill[0]) - 1)).astype(np.int64)
        return np.where(hit, self.main[1][slot], np.where(self.spill[0][second] == h, self.spill[1][second], -2))

    def arcs(self, codes: np.ndarray, stride: int = 1) -> np.ndarray:
        """Ids (width, n) of the pieces that start at each of the n characters, -1 where none does.

        ``codes`` holds ``stride`` strings of equal length, character by character.  A character that is no piece gets an arc
        of id -2 - code."""
        n = len(codes)
        ids = np.full((self.width, n), -1, np.int64)
        at = np.arange(n)
        h = np.ones(n, np.uint64)
        plain = codes.astype(np.uint64)
        for k in range(self.width):
            if k:
                inside = int(np.searchsorted(at, n - k * stride))  # ``at`` ascends
                at, h = at[:inside], h[:inside]
            if not len(at):
                break
            h = (h ^ plain[at + k * stride]) * _R
            h ^= h >> np.uint64(29)
            piece = self._find(h)
            whole = np.flatnonzero(piece >= 0)
            ids[k, at[whole]] = piece[whole]
            live = np.flatnonzero(piece >= -1)
            at, h = at[live], h[live]
        lone = np.flatnonzero(ids[0] == -1)
        ids[0, lone] = -2 - codes[lone]
        return ids

    def weighed(self, ids: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """The arcs' scores, -inf without an arc; an unknown character has its bytes' sum."""
        score = np.append(logp, NEG)[np.maximum(ids, -1)]
        lone = np.flatnonzero(ids[0] < -1)
        if len(lone):
            some, where = np.unique(-2 - ids[0, lone], return_inverse=True)
            score[0, lone] = np.array([logp[self.vocab.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]].sum() for c in some.tolist()])[where]
        return score

    def _groups(self, words: list[str], characters: int = 100_000):
        """Words of equal length together, at most about ``characters`` at a time: their places, and code points by position."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            n = int(size[run[0]]) if len(run) else 0
            step = max(1, characters // max(1, n))
            for s in range(0, len(run) if n else 0, step):
                some = run[s:s + step]
                text = "".join([words[i] for i in some]).encode("utf-32-le", "surrogatepass")
                yield some, n, np.ascontiguousarray(np.frombuffer(text, np.uint32).reshape(len(some), n).T).astype(np.int64)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentations; of equal scores, the longest last piece.  Returns places in ``words``, ids of all pieces one word
        after the other in that order, their number per word and the words' scores.  Empty words are left out."""
        places, tokens, lens, scores = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0)]
        for some, n, codes in self._groups(words):
            m = len(some)
            ids = self.arcs(codes.ravel(), m)
            longest = int(np.flatnonzero((ids != -1).any(1))[-1]) + 1
            score = self.weighed(ids[:longest], self.own).reshape(longest, n, m)
            best, back = np.empty((n + 1, m)), np.zeros((n + 1, m), np.int64)
            best[0] = 0.0
            each = np.arange(m)
            for j in range(1, n + 1):
                w = min(j, longest)
                cand = best[j - w:j] + _ending(score, j, w)[::-1]  # longest first: a tie keeps it
                pick = cand.argmax(0)
                back[j] = w - pick
                best[j] = cand[pick, each]
            left, who, steps = np.full(m, n), each, []
            while len(who):
                k = back[left[who], who]
                left[who] -= k
                step = np.full(m, -1, np.int64)
                step[who] = ids[k - 1, left[who] * m + who]
                steps.append(step)
                who = who[left[who] > 0]
            grid = np.stack(steps[::-1], 1)
            there = grid != -1
            flat, count = self._spelled(grid[there], there.sum(1))
            places.append(some)
            tokens.append(flat)
            lens.append(count)
            scores.append(best[n])
        return np.concatenate(places), np.concatenate(tokens), np.concatenate(lens), np.concatenate(scores)

    def _spelled(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by the ids of their bytes."""
        strange = np.flatnonzero(flat < 0)
        if not len(strange):
            return flat.astype(np.int32), count
        some, where = np.unique(-2 - flat[strange], return_inverse=True)
        spelled = [self.vocab.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in some.tolist()]
        times = np.ones(len(flat), np.int64)
        times[strange] = np.array([len(x) for x in spelled])[where]
        out, start = np.repeat(flat, times).astype(np.int32), np.cumsum(times) - times
        for c, ids in enumerate(spelled):
            at = start[strange[where == c]]
            for j, i in enumerate(ids.tolist()):
                out[at + j] = i
        return out, np.add.reduceat(times, np.cumsum(count) - count)

    def marginals(self, words: list[str], logps: list[np.ndarray], weights: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the summed probability of all segmentations (words, logps), by the forward recursion in log space,
        under each of several weightings of the pieces.

        With ``weights`` (occurrences per word) the expected uses of each piece under the last weighting are added to ``counts``
        by id; an unknown character counts for its byte pieces."""
        out = np.zeros((len(words), len(logps)))
        for some, n, codes in self._groups(words):
            m = len(some)
            ids = self.arcs(codes.ravel(), m)
            longest = int(np.flatnonzero((ids != -1).any(1))[-1]) + 1
            ids = ids[:longest]
            for z, logp in enumerate(logps):
                score = self.weighed(ids, logp).reshape(longest, n, m)
                alpha = np.zeros((n + 1, m))
                for j in range(1, n + 1):
                    w = min(j, longest)
                    alpha[j] = _logsum(alpha[j - w:j] + _ending(score, j, w)[::-1])
                out[some, z] = alpha[n]
            if counts is None:
                continue
            beta = np.zeros((n + 1, m))
            for p in range(n - 1, -1, -1):
                w = min(n - p, longest)
                beta[p] = _logsum(beta[p + 1:p + w + 1] + score[:w, p])
            k, at = np.nonzero(ids != -1)
            p, word = at // m, at % m
            use = np.exp(alpha[p, word] + score[k, p, word] + beta[p + k + 1, word] - alpha[n][word]) * np.asarray(weights, np.float64)[some][word]
            piece = ids[k, at]
            known = piece >= 0
            counts += np.bincount(piece[known], use[known], len(counts))
            for c, u in zip(piece[~known].tolist(), use[~known].tolist()):
                for b in chr(-2 - c).encode("utf-8", "surrogatepass"):
                    counts[self.vocab.byte_ids[b]] += u
        return out

    def cuts(self, text: str) -> list[int]:
        """Places where no piece crosses: a space mark after another character."""
        if not self.cuts_at_spaces:
            return []
        out, at = [], text.find(SPACE, 1)
        while at >= 0:
            if text[at - 1] != SPACE:
                out.append(at)
            at = text.find(SPACE, at + 1)
        return out

    def between(self, text: str, entries: int, exits_from: int) -> np.ndarray:
        """Max-plus matrix of a piece of text: best scores from start i (below ``entries``) to end ``exits_from`` + j."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(codes)
        score = self.weighed(self.arcs(codes), self.own)
        best = np.full((n + 1, entries), NEG)
        for i in range(min(entries, n + 1)):
            best[i, i] = 0.0
        for p in range(n):
            for k in np.flatnonzero(score[:, p] > NEG).tolist():
                np.maximum(best[p + k + 1], best[p] + score[k, p], out=best[p + k + 1])
        return best[exits_from:].T


def _ending(score: np.ndarray, j: int, w: int) -> np.ndarray:
    """Of scores (length, start, word), those of the arcs that end at ``j``, by length from 1 to ``w``; a view."""
    length, start, word = score.strides
    return np.lib.stride_tricks.as_strided(score[0, j - 1], (w, score.shape[2]), (length - start, word), writeable=False)


def _logsum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(0)
    return top + np.log(np.exp(terms - top).sum(0))


_SHIFT = np.uint64(64 - 18)


def _table(heads: dict[int, int]):
    """Two hash tables of 2**18 or more slots: what collides in the first goes to the second, made larger until nothing collides."""
    keys, values = np.fromiter(heads, np.uint64, len(heads)), np.fromiter(heads.values(), np.int64, len(heads))
    slot = (keys >> _SHIFT).astype(np.int64)
    _, first = np.unique(slot, return_index=True)
    rest = np.setdiff1d(np.arange(len(keys)), first)
    main = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -2, np.int64)
    main[0][slot[first]], main[1][slot[first]] = keys[first], values[first]
    for bits in range(18, 31):
        second = ((keys[rest] >> np.uint64(20)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        if len(np.unique(second)) == len(rest):
            break
    else:
        raise ValueError("piece hashes collide")
    spill = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int64)
    spill[0][second], spill[1][second] = keys[rest], values[rest]
    return main, spill


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of boundary-state matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)
