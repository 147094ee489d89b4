"""Sampled SentencePiece encodings, distinct by Gumbel top-k, and their decoding.

The pieces of a published model span a lattice over each text; a segmentation
is a path through it. Path weights are sums of piece weights; a backward pass
gives every lattice node the exact log-sum of its completions, so the perturbed
score of a set of paths is known before it is searched. A best-first search
(A-star with that exact bound) takes the set with the highest perturbed score,
splits off its best path and leaves the rest as smaller sets: the k paths that
come out are a sample without replacement, best first.

A piece never goes across a blank, so a text's lattice is a chain of the
lattices of its blank-separated chunks. Chunks that occur again share one.

A published BPE model has merge ranks for scores, not log-probabilities; pieces
are weighted by Zipf's law on their rank. Nothing is trained here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix, text_blocks, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 1_000_000
#: Chunks too few to be worth the search for common ends.
_FEW = 64
_BLANK = 0x2581
#: Stands for a blank sign that is in the text itself: it has no piece, its bytes encode it.
_OWN_SIGN = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROUND = np.uint64(0xD1B54A32D192ED03)


def _times(k: int, odd: np.uint64) -> np.uint64:
    """k * odd modulo 2^64."""
    return np.uint64(k * int(odd) & (1 << 64) - 1)


@dataclass
class Lexicon:
    """A model's pieces as arrays: a trie over code points, weights, and each piece's bytes.

    The trie's root is node 0; the child of a node by a letter is jump[node] + letter, if owner there is the node.
    """

    alpha: np.ndarray  # code point -> letter of the trie, 0 if in no piece
    jump: np.ndarray
    owner: np.ndarray  # node -> its parent, -1 if there is no such node
    piece: np.ndarray  # node -> piece id or -1
    weight: np.ndarray  # piece id -> log weight
    byte_id: np.ndarray
    flat: np.ndarray  # bytes of all pieces
    start: np.ndarray
    size: np.ndarray


def _trie(words: dict[str, int], alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(jump, owner, piece) of the words: children of different nodes interleave where they leave room."""
    kids: list[dict[int, int]] = [{}]
    ends = {}
    for text, i in words.items():
        node = 0
        for c in text:
            node = kids[node].setdefault(int(alpha[ord(c)]), len(kids))
            if node == len(kids):
                kids.append({})
        ends[node] = i
    letters, window = int(alpha.max()) + 1, 1 << 11
    free = np.zeros(letters, dtype=bool)  # so that no jump is negative
    place = np.zeros(len(kids), dtype=np.int32)
    base = np.zeros(len(kids), dtype=np.int32)
    last = letters
    for node in sorted((n for n, own in enumerate(kids) if len(own) > 1), key=lambda n: -len(kids[n])):
        own = np.array([*kids[node]])
        fits, start = [], max(letters, last - 2 * window)  # nodes with one child fill the room left before
        while not len(fits):
            if len(free) < start + window + letters:
                free = np.concatenate((free, np.ones(len(free) + window, dtype=bool)))
            fits = start + np.flatnonzero(free[start : start + window]) - own.min()
            for letter in own.tolist():
                fits = fits[free[fits + letter]]
            start += window
        base[node] = fits[0]
        free[fits[0] + own] = False
        place[[*kids[node].values()]] = fits[0] + own
        last = max(last, int(fits[0]) + int(own.max()))
    single = [(n, *next(iter(own.items()))) for n, own in enumerate(kids) if len(own) == 1]
    free = np.concatenate((free, np.ones(len(single) + 1, dtype=bool)))
    for (node, letter, kid), gap in zip(single, np.flatnonzero(free).tolist()):
        base[node], place[kid] = gap - letter, gap
    jump = np.zeros(len(free), dtype=np.int32)
    jump[place] = base
    owner = np.full(len(free) + letters, -1, dtype=np.int32)
    for node, own in enumerate(kids):
        owner[place[[*own.values()]]] = place[node]
    piece = np.full(len(free), -1, dtype=np.int32)
    piece[place[[*ends]]] = [*ends.values()]
    return jump, owner, piece


def load_lexicon(model: str = MODEL, temperature: float = 1.0) -> Lexicon:
    """Read a SentencePiece model with byte fallback. Higher temperature: flatter samples."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(read.get_piece_size())
    byte_id = np.full(256, -1, dtype=np.int32)
    words: dict[str, int] = {}
    content = [b""] * len(ids)
    for i in ids:
        text = read.id_to_piece(i)
        if read.is_byte(i):
            byte_id[int(text[3:5], 16)] = i
            content[i] = bytes([int(text[3:5], 16)])
        elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
            content[i] = text.replace("▁", " ").encode()
            if "▁" not in text[1:]:
                words[text] = i
    if (byte_id < 0).any():
        raise ValueError("the model has no byte fallback; its encodings could not be decoded exactly")
    rank = {i: k for k, i in enumerate(sorted(words.values(), key=lambda i: (-read.get_score(i), i)))}
    weight = np.full(len(ids), -np.log(len(rank) + 2.0))
    for i, k in rank.items():
        weight[i] = -np.log(k + 2.0)
    weight = (weight - np.log(np.exp(weight).sum())) / temperature
    alpha = np.zeros(0x110001, dtype=np.int32)
    for k, c in enumerate(sorted({c for w in words for c in w}), start=1):
        alpha[ord(c)] = k
    size = np.array([len(b) for b in content], dtype=np.int64)
    return Lexicon(alpha, *_trie(words, alpha), weight, byte_id, np.frombuffer(b"".join(content), np.uint8), np.cumsum(size) - size, size)


class Lattices:
    """The lattices of distinct chunks: the edges of a position are neighbours, longest first.

    What can follow a position hangs on the rest of its chunk alone, so chunks
    share the positions of a common end. Positions are numbered by falling distance
    to the end; those of one distance are a slice, and so are their edges.
    prob: of an edge among those of its position, by the backward pass; upto:
    running sum of prob; end: the position it leads to, ``stop`` at a chunk's end.
    An edge with a negative piece is the bytes of code point -piece - 1.
    """

    def __init__(self, lexicon: Lexicon, chunks: list[str] | pa.LargeStringArray):
        texts = chunks if isinstance(chunks, pa.LargeStringArray) else pa.array(chunks, pa.large_string())
        points, after, level = self._positions(texts)
        total = self.stop = len(points)
        letter = np.zeros(total + 1, dtype=np.int32)  # none at ``stop``
        letter[:-1] = lexicon.alpha[points]

        found = []
        at = here = np.arange(total, dtype=np.int32)
        node = np.zeros(total, dtype=np.int32)
        while len(at):
            to = lexicon.jump[node]
            to += letter[here]
            on = np.flatnonzero(lexicon.owner[to] == node)
            at, node, here = at[on], to[on], after[here[on]]
            piece = lexicon.piece[node]
            hit = np.flatnonzero(piece >= 0)
            starts, ids, ends = at[hit], piece[hit], here[hit]
            if not found:
                lost = np.ones(total, dtype=bool)
                lost[starts] = False
                lost = np.flatnonzero(lost).astype(np.int32)
                starts, ends = np.concatenate((starts, lost)), np.concatenate((ends, after[lost]))
                ids = np.concatenate((ids, -(np.where(points[lost] == _OWN_SIGN, _BLANK, points[lost]).astype(np.int32)) - 1))
            found.append((starts, ids, ends))

        degree = self.degree = np.zeros(total, dtype=np.int32)
        for starts, _, _ in found:
            degree[starts] += 1
        bounds = np.zeros(total + 1, dtype=np.int32)
        np.cumsum(degree, out=bounds[1:])
        self.first = bounds[:-1]
        edges = int(bounds[-1])
        self.piece = np.empty(edges, dtype=np.int32)
        self.end = np.empty(edges, dtype=np.int32)
        used = self.first.copy()
        while found:
            starts, ids, ends = found.pop()
            slot = used[starts]
            used[starts] = slot + 1
            self.piece[slot] = ids
            self.end[slot] = ends
        del used, letter, points, after
        weight = lexicon.weight[np.maximum(self.piece, 0)]
        lost = np.flatnonzero(self.piece < 0)
        point = -self.piece[lost] - 1
        weight[lost] = (1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)) * lexicon.weight[lexicon.byte_id[0]]

        back = np.zeros(total + 1)
        self.prob = np.empty(edges)
        cuts, level = bounds[level].tolist(), level.tolist()
        for low, high, a, b in zip(level[1:], level[:-1], cuts[1:], cuts[:-1]):
            x = weight[a:b]
            x += back[self.end[a:b]]
            cut, many = bounds[low:high] - a, degree[low:high]
            top = np.maximum.reduceat(x, cut)
            x -= np.repeat(top, many)
            np.exp(x, out=x)
            mass = np.add.reduceat(x, cut)
            back[low:high] = top + np.log(mass)
            np.divide(x, np.repeat(mass, many), out=self.prob[a:b])
        del weight, back
        self.upto = self.prob.copy()
        step, at = 1, np.flatnonzero(degree > 1)
        while len(at):
            edge = self.first[at] + step
            self.upto[edge] += self.upto[edge - 1]
            step += 1
            at = at[degree[at] > step]
        self.upto[bounds[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        self.log_prob = np.log(self.prob)

    def _positions(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code point of each position, the position after it, and the falling bounds of each distance; sets ``base``."""
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False) + 1
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0, 0]
        data = texts.buffers()[2]
        own = np.frombuffer((data[ends[0] : ends[-1]].to_pybytes() if data else b"").decode().encode("utf-32-le"), dtype="<u4")
        over = np.cumsum(lengths)
        body = np.ones(int(lengths.sum()), dtype=bool)
        body[over - lengths] = False
        all_points = np.full(len(body), _BLANK, dtype=np.int64)
        all_points[body] = np.where(own == _BLANK, _OWN_SIGN, own)

        order = np.argsort(-lengths, kind="stable")
        over = over[order]
        width = np.cumsum(np.bincount(lengths)[::-1])[::-1]  # distance -> chunks that have it, the first so many in order
        base = np.zeros(len(lengths), dtype=np.int64)
        points, after, level = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
        rest = np.zeros(len(lengths), dtype=np.int64)  # of each chunk: which of the positions one nearer to the end
        bits, nearer, distance, apart = 1, 0, 1, False
        while distance < len(width) and width[distance] >= _FEW and not apart:
            n = int(width[distance])
            coded = pa.array(all_points[over[:n] - distance] << bits | rest[:n]).dictionary_encode()
            distinct, rest = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            points.append(distinct >> bits)
            after.append((distinct & (1 << bits) - 1) + nearer)
            nearer = level[-1]
            level.append(nearer + len(distinct))
            base[:n] = nearer + rest  # stands for those that begin here
            bits, apart = len(distinct).bit_length(), len(distinct) == n
            distance += 1
        if distance < len(width):  # the rests of the chunks differ from here on, or the chunks are few: all of theirs at once
            many = width[distance:]
            start = level[-1] + np.cumsum(many) - many
            chunk = np.arange(int(many.sum())) - np.repeat(start - level[-1], many)
            points.append(all_points[over[chunk] - np.repeat(np.arange(distance, len(width)), many)])
            after.append(level[-1] + np.arange(len(chunk)) - np.repeat(width[distance - 1 : -1], many))
            after[-1][: many[0]] = nearer + rest[: many[0]]
            base[: many[0]] = start[lengths[order[: many[0]]] - distance] + np.arange(many[0])
            level += (start + many).tolist()
        # So far the nearest positions have the lowest numbers; from here on the farthest, where the longest chunk begins.
        points = np.concatenate(points)[::-1]
        top = len(points) - 1
        self.base = np.empty_like(base)
        self.base[order] = top - base
        after = (top - np.concatenate(after)[::-1]).astype(np.int32)
        bounds = top + 1 - np.array(level)
        after[bounds[min(1, len(level) - 1)] :] = top + 1
        return points, after, bounds

    def walk(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Draw a path from each position to its chunk's end: (pool of edges, first and number of each path's, log-prob)."""
        total = np.zeros(len(at))
        count = np.zeros(len(at), dtype=np.int32)
        live, pos, steps = np.arange(len(at)), at, []
        step = 0
        while len(live):
            step += 1
            u = uniform(mix(keys[live] + _times(step, _STEP)))
            edge = self.first[pos]
            miss = np.flatnonzero(u >= self.upto[edge])
            while len(miss):
                edge[miss] += 1
                miss = miss[u[miss] >= self.upto[edge[miss]]]
            total[live] += self.log_prob[edge]
            count[live] = step
            steps.append((live, edge))
            pos = self.end[edge]
            going = np.flatnonzero(pos != self.stop)
            live, pos = live[going], pos[going]
        first = np.cumsum(count, dtype=np.int64) - count
        pool = np.empty(int(count.sum()), dtype=np.int32)
        for k, (who, edge) in enumerate(steps):
            pool[first[who] + k] = edge
        return pool, first, count, total


class _Draws:
    """Uniform numbers of one document and sample, one after the other, for the few steps taken singly."""

    def __init__(self, key: int, sample: int):
        self.x = (key * 0x9E3779B97F4A7C15 + sample * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (1 << 64) - 1

    def __call__(self) -> float:
        self.x = (self.x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = self.x
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return ((z ^ z >> 31) >> 12) * 2.0**-52 + 2.0**-53


def _below(top: float, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels at locations ``mass``, given that they lie below ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - mass)


def _gone(log_prob: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)), also for an x that rounding left at 0 or above."""
    return np.log(np.maximum(-np.expm1(log_prob), 0.0))


class Search:
    """Gumbel top-k over all documents of a block at once; ``types``: the lattice of each chunk."""

    def __init__(self, lattices: Lattices, types: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        self.l, self.types, self.offsets, self.keys = lattices, types, offsets, keys
        self.full = np.flatnonzero(np.diff(offsets))
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.pool = np.zeros(0, dtype=np.int32)
        self.samples: list[tuple] = []  # (first, count, log-prob) of each chunk; (score, there) of each document
        self.open: list[np.ndarray] = []  # of each sample: perturbed score of "another path in this chunk, any after"
        self.nodes: dict[int, list[tuple]] = {}  # of a document: sets within one chunk, (score, sample, chunk, from, but)

    def _chunk_keys(self, sample: int) -> np.ndarray:
        within = np.arange(len(self.types)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        return mix(self.keys[self.doc] + _times(sample, _ROUND) + mix(within.astype(np.uint64)))

    def _add(self, first, count, log_prob, score, there, begin, sample) -> None:
        """Keep a sample; open the sets that leave it at or after chunk ``begin`` of its document."""
        self.samples.append((first, count, log_prob, score, there))
        lead = np.cumsum(log_prob) - log_prob
        lead -= np.repeat(lead[self.offsets[:-1][self.full]], np.diff(self.offsets)[self.full])
        rest = -np.expm1(np.minimum(log_prob, 0.0))
        with np.errstate(divide="ignore"):
            mass = lead + np.log(rest)
        u = uniform(mix(self._chunk_keys(sample) ^ _STEP))
        with np.errstate(invalid="ignore"):
            value = -np.logaddexp(-score[self.doc], np.log(-np.log(u)) - mass)
        within = np.arange(len(self.types)) - self.offsets[:-1][self.doc]
        shut = ~there[self.doc] | (within < begin[self.doc]) | (rest <= 0) | np.isnan(value)
        value[shut] = -np.inf
        self.open.append(value)

    def _best_open(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, sample and chunk of each document's best set; sample -1: in ``nodes``."""
        docs = len(self.offsets) - 1
        score, owner, chunk = np.full(docs, -np.inf), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for r, value in enumerate(self.open):
            top = np.full(docs, -np.inf)
            top[self.full] = np.maximum.reduceat(value, self.offsets[:-1][self.full])
            better = top > score
            hits = np.flatnonzero((value == top[self.doc]) & better[self.doc])[::-1]
            chunk[self.doc[hits]] = hits  # the first of equals, as the order is reversed
            score, owner = np.where(better, top, score), np.where(better, r, owner)
        for d, nodes in self.nodes.items():
            top = max((x[0] for x in nodes), default=-np.inf)
            if top > score[d]:
                score[d], owner[d] = top, -1
        return score, owner, chunk

    def run(self, k: int) -> np.ndarray:
        """Draw up to k samples of each document; returns the perturbed score of the best set left."""
        docs = len(self.offsets) - 1
        score = -np.log(-np.log(uniform(mix(self.keys))))
        there = np.zeros(docs, dtype=bool)
        there[self.full] = True
        pool, first, count, log_prob = self.l.walk(self.l.base[self.types].astype(np.int32), self._chunk_keys(0))
        self.pool = pool
        self._add(first, count, log_prob, score, there, np.zeros(docs, np.int64), 0)
        for sample in range(1, k):
            self._next(sample)
        return self._best_open()[0]

    def _next(self, sample: int) -> None:
        score, owner, chunk = self._best_open()
        there = score > -np.inf
        first, count, log_prob = (x.copy() for x in self.samples[0][:3])
        begin = np.zeros(len(score), np.int64)
        extra: list[int] = []
        at_extra = len(self.pool)
        redo = np.zeros(len(self.types), dtype=bool)
        for d in np.flatnonzero(there):
            draw = _Draws(int(self.keys[d]), sample)
            mine = self.nodes.setdefault(int(d), [])
            if owner[d] < 0:
                node = max(mine)
                mine.remove(node)
                _, parent, c, base, but = node
            else:
                parent, c, base, but = int(owner[d]), int(chunk[d]), 0, None
                self.open[parent][c] = -np.inf
            low, high = self.offsets[d], self.offsets[d + 1]
            if parent:
                for mark, theirs in zip((first, count, log_prob), self.samples[parent][:3]):
                    mark[low:high] = theirs[low:high]
            lead = float(self.samples[parent][2][low:c].sum())
            path = self.pool[first[c] : first[c] + count[c]].tolist()
            with np.errstate(divide="ignore"):
                path = self._leave(path, base, but, lead, float(score[d]), draw, mine, parent, c, sample)
            first[c], count[c] = at_extra + len(extra), len(path)
            log_prob[c] = self.l.log_prob[path].sum()
            extra += path
            begin[d] = c + 1 - low
            redo[c + 1 : high] = True
        again = np.flatnonzero(redo)
        pool, f, n, p = self.l.walk(self.l.base[self.types[again]].astype(np.int32), self._chunk_keys(sample)[again])
        first[again], count[again], log_prob[again] = f + at_extra + len(extra), n, p
        self.pool = np.concatenate((self.pool, np.array(extra, dtype=np.int32), pool))
        self._add(first, count, log_prob, score, there, begin, sample)

    def _leave(self, path, base, but, lead, score, draw, nodes, parent, chunk, sample) -> list[int]:
        """Split the set of paths that leave ``path`` at or after its edge ``base`` (``but``: edges barred there, then
        exactly there): return its best path, put what is left into ``nodes``."""
        l = self.l
        lp = l.log_prob[path]
        before = np.cumsum(lp) - lp
        if but is None:
            mass = before[base:] + _gone(lp[base:])
            odds = np.exp(mass - mass.max())
            pick = min(int(np.searchsorted(np.cumsum(odds), draw() * odds.sum(), side="right")), len(odds) - 1)
            others = [t for t, m in enumerate(mass.tolist()) if t != pick and m > -np.inf]
            if others:
                scores = _below(score, lead + mass[others], np.array([draw() for _ in others])).tolist()
                nodes += [(x, parent, chunk, base + t, (path[base + t],)) for x, t in zip(scores, others)]
            at, barred = base + pick, (path[base + pick],)
        else:
            at, barred = base, but
        pos_first = self._first_edge(path, at, chunk)
        edges = [e for e in range(pos_first, pos_first + self._degree(path, at, chunk)) if e not in barred]
        odds = l.prob[edges]
        pick = edges[min(int(np.searchsorted(np.cumsum(odds), draw() * odds.sum(), side="right")), len(edges) - 1)]
        if len(edges) > 1:
            left = float(np.log(l.prob[[e for e in edges if e != pick]].sum()))
            nodes.append((float(_below(score, lead + before[at] + left, draw())), parent, chunk, at, (*barred, pick)))
        new = [*path[:at], pick]
        pos = int(l.end[pick])
        while pos != l.stop:
            u, edge = draw(), int(l.first[pos])
            while u >= l.upto[edge]:
                edge += 1
            new.append(edge)
            pos = int(l.end[edge])
        tail = float(_gone(l.log_prob[new[at + 1 :]].sum())) if len(new) > at + 1 else -np.inf
        if tail > -np.inf:
            nodes.append((float(_below(score, lead + float(l.log_prob[new[: at + 1]].sum()) + tail, draw())), sample, chunk, at + 1, None))
        return new

    def _position(self, path, at, chunk) -> int:
        return int(self.l.base[self.types[chunk]]) if at == 0 else int(self.l.end[path[at - 1]])

    def _first_edge(self, path, at, chunk) -> int:
        return int(self.l.first[self._position(path, at, chunk)])

    def _degree(self, path, at, chunk) -> int:
        return int(self.l.degree[self._position(path, at, chunk)])

    def ids(self, lexicon: Lexicon, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of one sample of all documents, and the offsets of the documents."""
        first, count = self.samples[sample][:2]
        there = self.samples[sample][4]
        count = np.where(there[self.doc], count, 0).astype(np.int64)
        begin = np.cumsum(count) - count
        where = np.repeat(first - begin, count) + np.arange(int(count.sum()))
        piece = self.l.piece[self.pool[where]]
        tokens = np.concatenate(([0], np.cumsum(count)))[self.offsets]
        lost = np.flatnonzero(piece < 0)
        if len(lost):
            points, inverse = np.unique(-piece[lost] - 1, return_inverse=True)
            coded = [chr(p).encode() for p in points]
            sizes = np.array([len(b) for b in coded])
            table = lexicon.byte_id[np.array([list(b.ljust(4, b"\0")) for b in coded])]
            reps = np.ones(len(piece), dtype=np.int64)
            reps[lost] = sizes[inverse]
            place = np.cumsum(reps) - reps
            tokens = np.concatenate((place, [reps.sum()]))[tokens]
            piece = np.repeat(piece, reps)
            for k in range(int(sizes.max())):
                has = sizes[inverse] > k
                piece[place[lost[has]] + k] = table[inverse[has], k]
        return piece, tokens


def decode_block(lexicon: Lexicon, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; the blank before a text goes."""
    ends = np.concatenate((lexicon.start, [len(lexicon.flat)]))
    content = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lexicon.start), [None, pa.py_buffer(ends), pa.py_buffer(lexicon.flat)])
    taken = content.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset + offsets]
    data = taken.buffers()[2]
    out = np.frombuffer(data, dtype=np.uint8)[: at[-1]] if data else np.zeros(0, dtype=np.uint8)
    blank = np.diff(offsets) > 0
    blank[blank] = out[at[:-1][blank]] == 32
    keep = np.ones(len(out), dtype=bool)
    keep[at[:-1][blank]] = False
    at[1:] -= np.cumsum(blank)
    return out[keep], at


def _chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """Distinct chunks of a block, the number of each chunk, and the first chunk of each text."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(raw))
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    types = coded.indices.to_numpy().astype(np.int64)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    # An empty text has no chunk, though it splits into one empty string.
    empty = np.diff(offsets) == 0
    keep = np.ones(len(types), dtype=bool)
    keep[bounds[:-1][empty]] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return coded.dictionary, types[keep], kept[bounds]


def encode(docs: DataFrame, lexicon: Lexicon, k: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sample, ids, n_tokens, log_prob, perturbed, log_inclusion, round_trip): k distinct sampled encodings.

    Samples are numbered from 1 by falling perturbed score. log_inclusion is the
    log-probability that a sample without replacement holds this segmentation,
    given the best perturbed score left out; 0 if nothing was left out.
    Numbers depend on seed and id alone (a null id: on the text), so a row gets
    the same samples on every run and repeated rows get equal ones. A text with
    fewer than k segmentations gets all it has; an empty or null text has one,
    without pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(lexicon))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(**shared.value)
        for part, raw, offsets in text_blocks(batches, "t", BLOCK_BYTES):
            chunks, types, bounds = _chunks(raw, offsets)
            keys = part.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            search = Search(Lattices(own, chunks), types, bounds, mix(keys))
            left = search.run(k) if len(types) else np.full(len(keys), -np.inf)
            empty = np.diff(bounds) == 0
            for sample in range(k if len(types) else 1):
                yield _rows(part, raw, offsets, search, own, sample, left, empty)

    kind = docs.schema[id_col].dataType.simpleString()
    key = F.coalesce(F.xxhash64(id_col, F.lit(seed)), F.lit(0)) if kind == "void" else F.when(
        F.col(id_col).isNull(), F.xxhash64(text_col, F.lit(seed))
    ).otherwise(F.xxhash64(id_col, F.lit(seed)))
    schema = f"id {kind}, sample int, ids array<int>, n_tokens int, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), key.alias("k"))
    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def _rows(part, raw, offsets, search, lexicon, sample, left, empty) -> pa.RecordBatch:
    docs = len(empty)
    if search.samples:
        ids, bounds = search.ids(lexicon, sample)
        _, _, chunk_log, score, there = search.samples[sample]
        total = np.zeros(docs)
        total[search.full] = np.add.reduceat(chunk_log, search.offsets[:-1][search.full])
    else:
        ids, bounds = np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        total, score, there = np.zeros(docs), np.zeros(docs), np.zeros(docs, dtype=bool)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        ahead = np.where(left > -np.inf, total - left, np.inf)
        inclusion = np.where(ahead < -30, ahead, np.log(-np.expm1(-np.exp(np.minimum(ahead, 700)))))
    shown = np.flatnonzero(there | (empty & (sample == 0)))
    score, inclusion = np.where(empty, 0.0, score), np.where(empty, 0.0, inclusion)
    text, at = decode_block(lexicon, ids, bounds)
    exact = [text[at[d] : at[d + 1]].tobytes() == raw[offsets[d] : offsets[d + 1]].tobytes() for d in shown]
    sizes = np.diff(bounds)[shown]
    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(ids))
    return pa.RecordBatch.from_arrays(
        [
            part.column(0).take(pa.array(shown)), pa.array(np.full(len(shown), sample + 1, np.int32)), lists, pa.array(sizes.astype(np.int32)),
            pa.array(total[shown]), pa.array(score[shown]), pa.array(inclusion[shown]), pa.array(exact, pa.bool_()),
        ],
        names=["id", "sample", "ids", "n_tokens", "log_prob", "perturbed", "log_inclusion", "round_trip"],
    )


def decode(tokens: DataFrame, lexicon: Lexicon, ids_col: str = "ids") -> DataFrame:
    """The rows with their text: ``text`` is what the ids encode. Null ids give a null text, no ids an empty one."""
    plain = [c for c in tokens.columns if c != "text"]
    shared = tokens.sparkSession.sparkContext.broadcast(vars(lexicon))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(**shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            text, at = decode_block(own, lists.flatten().to_numpy(zero_copy_only=False), bounds)
            known = lists.is_valid().to_pylist()
            texts = [text[a:b].tobytes().decode() if ok else None for a, b, ok in zip(at, at[1:], known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*plain, "text"])

    schema = tokens.select(*plain).schema.add("text", "string")
    return tokens.select(*plain).mapInArrow(task, schema)
