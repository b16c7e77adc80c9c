"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

A text's lattice falls into segments, as pieces never run over a space and characters outside the vocabulary (line feeds)
stand alone; its segmentations are the product of its segments'. Forward sums over each distinct segment's lattice give,
for every end position, the chances of the lengths of the last piece.

The search is A* over the tree of segmentations, segment by segment, on perturbed values. The root's best value is a
Gumbel draw; its leaf is drawn from the chances, since which leaf is best and how good it is are independent. A drawn leaf
leaves, at each segment j, one open node: the same choices before j and another one at j. Its best value is a Gumbel draw
at the log of its mass, cut off at its parent's. The next segmentation lies in the open node with the highest value: one
draw at its segment that avoids what went before (exact, by the remaining mass along the avoided paths), and free draws
after it; it leaves open nodes in turn. So k leaves come out in the order of their values, as if every segmentation had
its own Gumbel draw, without a queue of more than segments x k nodes. With kappa the highest value left, a leaf's
inclusion probability is ``1 - exp(-exp(log_prob - kappa))``.

The model file holds merges in order of rank and no probabilities; a piece of rank r weighs 1 / (r + 10), to the power
``theta``. Draws hash the row key, so a row's result does not depend on partitions or retries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triago.llm.common import release_memory, table

BATCH_CHARS = 1_500_000
#: Characters whose drawn pieces are put together at once.
OUT_CHARS = 100_000
SLOT_BITS = 18
BELOW_ONE = np.nextafter(np.float32(1), np.float32(0))
_STEP, _MIX, _PLACE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D
U64 = np.uint64


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """The pieces of a model: text with ``▁`` as a space, log weights, byte pieces, and a hash table for lookups."""

    pieces: list[str | None]  # None: control and byte pieces
    byte_ids: list[int]
    theta: float
    decoded: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        n = len(self.pieces)
        ranks = np.cumsum([p is not None for p in self.pieces])
        weight = np.log(1.0 / (ranks + 9.0))
        weight -= np.log(np.exp(weight[[p is not None for p in self.pieces]]).sum())
        self.rare = self.theta * math.log(1e-6)  # a byte of a character outside the vocabulary
        self.logs = self.theta * weight
        self.logs[self.byte_ids] = self.rare
        self.weights, self.low = np.exp(self.logs), np.array(self.byte_ids[:128])
        self.decoded = [b"" if p is None else p.encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(self.decoded), dtype=np.uint8)
        self.raw_size = np.fromiter(map(len, self.decoded), dtype=np.int64, count=n)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.longest = max(len(p) for p in self.pieces if p)
        ids = np.array([i for i in range(n) if self.pieces[i]])
        keys = np.array([self.key(self.pieces[i]) for i in ids], dtype=U64)
        keys *= U64(_MIX)
        self.tables, self.key_of = [], np.zeros(n + 1, dtype=U64)
        self.key_of[ids] = keys
        shift = 64 - SLOT_BITS
        while len(ids):  # a piece whose slot is taken goes to the next table
            slots = ((keys >> U64(shift)) & U64((1 << SLOT_BITS) - 1)).view(np.int64)
            _, first = np.unique(slots, return_index=True)
            own = np.full(1 << SLOT_BITS, n, dtype=np.int32)
            own[slots[first]] = ids[first]
            self.tables.append((shift, own))
            rest = np.ones(len(ids), dtype=bool)
            rest[first] = False
            ids, keys, shift = ids[rest], keys[rest], shift - 7
        self.taken = self.tables[0][1] < n

    @staticmethod
    def key(piece: str) -> int:
        k = 0
        for c in piece:
            k = (k * _STEP + ord(c) + 1) % (1 << 64)
        return k

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys times ``_MIX`` are those of pieces, and their ids. 64 bits tell 32,000 pieces from other strings."""
        keys = keys.ravel()
        shift, own = self.tables[0]
        slots = (keys >> U64(shift)).view(np.int64)
        at = np.flatnonzero(self.taken.take(slots))  # only a taken slot sends a piece to the next table
        ids, keys = own.take(slots.take(at)), keys.take(at)
        hit = self.key_of[ids] == keys
        for shift, own in self.tables[1:]:
            rest = np.flatnonzero(~hit)
            ids[rest] = own[((keys[rest] >> U64(shift)) & U64((1 << SLOT_BITS) - 1)).view(np.int64)]
            hit[rest] = self.key_of[ids[rest]] == keys[rest]
        hit &= ids < len(self.pieces)
        return at[hit], ids[hit]


def load(path: str, theta: float = 0.5) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [None if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ") for i in range(n)]
    bytes_ = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
    return Vocabulary(plain, [bytes_[b] for b in range(256)], theta)


@dataclass
class Lattice:
    """The lattices of several segments of one length: for each length of the last piece, end position and segment the
    piece's id (-1: none, below -1: a character outside the vocabulary), and from 0 on the summed chances of lengths
    below and, one row on, up to it."""

    ids: np.ndarray
    cum: np.ndarray
    rough: np.ndarray  # sums up to each length in single precision, a row of 8 or 16 for each end position and segment
    total: np.ndarray


def lattice(codes: np.ndarray, vocab: Vocabulary) -> Lattice:
    """Forward sums over the lattices of segments (rows) of one length. Segments come last in the arrays, so that every
    step runs along them. Sums are of weights, with a common factor taken out every few positions: a character weighs
    1e-12 at least, and the positions between hold no more than 24."""
    s, n = codes.shape
    most = min(vocab.longest, n)
    codes, step, power = np.ascontiguousarray(codes.T), U64(_STEP), 1
    prefix = np.zeros((n + 1, s), dtype=U64)
    for e in range(n):
        prefix[e + 1] = prefix[e] * step + codes[e] + U64(1)
    prefix *= U64(_MIX)
    ids, cum = np.full((most, n, s), -1, dtype=np.int32), np.zeros((most + 1, n, s))
    for w in range(1, most + 1):
        power = power * _STEP % (1 << 64)
        at, found = vocab.found(prefix[w:] - prefix[:-w] * U64(power))
        ids[w - 1, w - 1 :].reshape(-1)[at] = found
        cum[w, w - 1 :].reshape(-1)[at] = vocab.weights[found]
    outside = ids[0] < 0
    if outside.any():
        own = codes[outside].astype(np.int64)
        ids[0][outside] = np.where(own < 0x80, vocab.low[own & 0x7F], -2 - own)
        cum[1][outside] = np.exp(vocab.rare * utf8_size(own))
    sums, factor = np.ones((n + 1, s)), np.zeros(s)
    for e in range(1, n + 1):
        m = min(most, e)
        run = cum[1 : m + 1, e - 1]
        run *= sums[e - m : e][::-1]
        for w in range(1, m):
            run[w] += run[w - 1]
        sums[e] = run[-1]
        run /= sums[e]
        cum[m + 1 :, e - 1] = 1.0
        if e % 8 == 0:
            factor += np.log(sums[e])
            sums[max(0, e - most) : e + 1] /= sums[e].copy()
    rough = np.full((n, s, 8 if most <= 8 else 16), 2.0, dtype=np.float32)
    rough[:, :, :most] = cum[1:].transpose(1, 2, 0)
    return Lattice(ids, cum, rough.reshape(n * s, -1), factor + np.log(sums[n]))


def uniforms(seed: np.ndarray, salt: int, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes of a row's seed, a salt and a place."""
    return _mixed(seed + U64(salt * 0xD1342543DE82EF95 % (1 << 64)) + at.astype(U64) * U64(_PLACE))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    x >>= U64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 1.0 / (1 << 53)
    return out


def uniform(seed: int, salt: int, at: int) -> float:
    """``uniforms`` for one number."""
    m = (1 << 64) - 1
    x = (seed + salt * 0xD1342543DE82EF95 + at * _PLACE) & m
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return (((x ^ (x >> 31)) >> 11) + 0.5) / (1 << 53)


class Batch:
    """The texts of a batch, cut into segments, with one lattice for each distinct segment."""

    def __init__(self, texts: list[str], seeds: list[int], vocab: Vocabulary):
        self.vocab, self.n = vocab, len(texts)
        joined = " ".join(["", *texts])  # the space before each text stands for the dummy prefix
        self.bytes = joined.encode("utf-8", "surrogatepass")
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)  # of texts, in characters
        space, line = codes == 0x20, codes == 0x0A
        opens = line.copy()
        opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        opens[self.base[:-1]] = True
        self.start = np.append(np.flatnonzero(opens), len(codes))  # of segments, in characters of the whole batch
        self.size, self.first = np.diff(self.start), np.searchsorted(self.start, self.base)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        in_bytes = np.arange(len(codes) + 1) if len(self.bytes) == len(codes) else np.concatenate([[0], np.cumsum(utf8_size(codes))])
        self.bytes_base = in_bytes[self.base].tolist()
        spans = [None, pa.py_buffer(in_bytes[self.start]), pa.py_buffer(self.bytes)]
        distinct = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.size), spans).dictionary_encode()
        self.which = distinct.indices.to_numpy().astype(np.int64)
        head = np.flatnonzero(np.diff(np.maximum.accumulate(self.which), prepend=-1))  # they are numbered as they first come
        lengths = self.size[head]
        self.seeds = np.array(seeds, dtype=U64)
        self.group, self.row = np.zeros(len(head), dtype=np.int64), np.zeros(len(head), dtype=np.int64)
        self.lattices: list[Lattice] = []
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(head) else []:
            own = codes[self.start[head[part]][:, None] + np.arange(lengths[part[0]])]
            self.group[part], self.row[part] = len(self.lattices), np.arange(len(part))
            self.lattices.append(lattice(own.astype(U64), vocab))
        offset = np.concatenate([[0], np.cumsum([len(x.total) for x in self.lattices])]).astype(np.int64)
        flat = offset[self.group] + self.row
        self.total = np.concatenate([x.total for x in self.lattices] or [np.zeros(0)])[flat]

    def draw(self, places: np.ndarray, salt: int, slots: np.ndarray, mass: np.ndarray) -> None:
        """Draws a segmentation of each segment occurrence in ``places``: piece ids go to ``slots`` at the pieces' first
        characters (the rest of a segment must hold -1), and the probability of all other segmentations, summed along the
        path so that it is not a small difference, to ``mass``."""
        kinds = self.group[self.which[places]]
        order = np.argsort(kinds.astype(np.int16) if len(self.lattices) < 1 << 15 else kinds, kind="stable")
        cuts = np.flatnonzero(np.diff(kinds[order])) + 1
        for part in np.split(places[order], cuts) if len(places) else []:
            g, n = self.lattices[self.group[self.which[part[0]]]], int(self.size[part[0]])
            row, begin, s = self.row[self.which[part]], self.start[part], len(g.total)
            own = (begin - self.base[self.doc[part]]).astype(U64)
            seed = self.seeds[self.doc[part]] + U64(salt * 0xD1342543DE82EF95 % (1 << 64)) + own * U64(_PLACE)
            steps = np.arange(n, dtype=U64) * U64(_PLACE)
            end, same, other = np.full(len(part), n), np.ones(len(part)), np.zeros(len(part))
            most, ids, cum = len(g.ids), g.ids.ravel(), g.cum.ravel()
            while True:
                end -= 1
                at = end * s
                at += row
                u = np.minimum(_mixed(seed + steps.take(end)).astype(np.float32), BELOW_ONE)
                passed = np.bitwise_count((g.rough.take(at, axis=0) <= u[:, None]).view(U64))
                width = np.minimum(passed[:, 0] if passed.shape[1] == 1 else passed.sum(axis=1), most - 1).astype(np.int64)
                at += width * (n * s)
                below, upto = cum.take(at), cum.take(at + n * s)
                other += same * (below + (1.0 - upto))
                same *= upto - below
                end -= width
                slots[begin + end] = ids.take(at)
                live = np.flatnonzero(end)
                if len(live) < len(end):
                    mass[part] = other  # right where a path has come to its start, and set again elsewhere
                    if not len(live):
                        break
                    part, row, begin, seed, end, same, other = (x.take(live) for x in (part, row, begin, seed, end, same, other))

    def logs(self, slots: np.ndarray) -> np.ndarray:
        """The log probability of each segment's drawn segmentation."""
        drawn = slots != -1
        gained = self._logs(slots[drawn])
        gained = np.add.reduceat(gained, (np.cumsum(drawn) - 1)[self.start[:-1]]) if len(gained) else gained
        return np.minimum(gained - self.total[self.which], 0.0)

    def _logs(self, piece: np.ndarray) -> np.ndarray:
        v = self.vocab
        out = v.logs[np.maximum(piece, 0)]
        far = piece < -1
        if far.any():
            out[far] = v.rare * utf8_size(-2 - piece[far].astype(np.int64))
        return out

    def widths(self, place: int, slots: np.ndarray) -> tuple[int, ...]:
        """The lengths of a drawn segment's pieces, from the last to the first."""
        a, b = self.start[place], self.start[place + 1]
        at = np.flatnonzero(slots[a:b] != -1)
        return tuple(np.diff(np.append(at, b - a))[::-1].tolist())

    def _chances(self, place: int, end: int) -> list[float]:
        """The chances of the lengths 1, 2, ... of the last piece before an end position."""
        run = self.lattices[self.group[self.which[place]]].cum[:, end - 1, self.row[self.which[place]]].tolist()
        return [b - a for a, b in pairwise(run)]

    def _tree(self, place: int, avoided: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[list[float]], list[float]]:
        """The prefix tree of avoided segmentations: children by length, what each length has left, and each node's sum."""
        children, ends = [{}], [int(self.size[place])]
        for path in avoided:
            at = 0
            for w in path:
                if w not in children[at]:
                    children[at][w] = len(children)
                    children.append({})
                    ends.append(ends[at] - w)
                at = children[at][w]
        chances, left = [[] for _ in children], [0.0] * len(children)
        for i in range(len(children) - 1, -1, -1):
            if ends[i]:
                chances[i] = self._chances(place, ends[i])
                for w, child in children[i].items():
                    chances[i][w - 1] *= left[child]
                left[i] = sum(chances[i])
        return children, chances, left

    def draw_other(self, place: int, avoided: list[tuple[int, ...]], salt: int, slots: np.ndarray, mass: np.ndarray) -> None:
        """Draws a segmentation of one segment other than those avoided; ``mass`` gets the probability of all but those
        and the drawn one."""
        children, chances, _ = self._tree(place, avoided)
        g, row = self.lattices[self.group[self.which[place]]], self.row[self.which[place]]
        a, end, node, path = int(self.start[place]), int(self.size[place]), 0, []
        own, seed = a - int(self.base[self.doc[place]]), int(self.seeds[self.doc[place]])
        slots[a : a + end] = -1
        while end:
            chance = chances[node] if node is not None else self._chances(place, end)
            u, w = uniform(seed, salt, own + end - 1) * sum(chance), 0
            while w < len(chance) - 1 and u >= chance[w]:
                u -= chance[w]
                w += 1
            while not chance[w]:  # rounding has run past the last length that is left
                w -= 1
            piece = int(g.ids[w, end - 1, row])
            w += 1
            node = children[node].get(w) if node is not None else None
            end -= w
            path.append(w)
            slots[a + end] = piece
        mass[place] = self._tree(place, [*avoided, tuple(path)])[2][0]

    def pieces(self, drawn: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of texts' drawn segmentations, one after another, and where each begins and the last ends."""
        slots = np.concatenate(drawn)
        taken = slots != -1
        ids = slots[taken]
        ends = np.cumsum(taken)[np.cumsum([len(x) for x in drawn]) - 1]
        far = ids < -1
        if far.any():  # characters outside the vocabulary become the pieces of their bytes
            c, count = -2 - ids[far].astype(np.int64), np.ones(len(ids), dtype=np.int64)
            count[far] = utf8_size(c)
            raw = "".join(map(chr, c.tolist())).encode("utf-8", "surrogatepass")
            ids = np.repeat(ids, count)
            ids[np.repeat(far, count)] = np.array(self.vocab.byte_ids, dtype=np.int32)[np.frombuffer(raw, dtype=np.uint8)]
            ends = np.cumsum(count)[ends - 1]
        return ids, np.concatenate([[0], ends])


def utf8_size(codes: np.ndarray) -> np.ndarray:
    """Bytes of characters in UTF-8."""
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def decoded(ids: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """The bytes of each run of piece ids, with the dummy prefix."""
    size = vocab.raw_size[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = vocab.raw[np.repeat(vocab.raw_start[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    return [raw[a:b] for a, b in pairwise(ends[bounds].tolist())]


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of piece ids, without the dummy prefix."""
    return decoded(ids, np.array([0, len(ids)]), vocab)[0].decode("utf-8", "surrogatepass")[1:]


class _Search:
    """The open nodes of one text's tree: for each drawn leaf the values of its open nodes, one for each segment."""

    def __init__(self, batch: Batch, doc: int):
        self.b, self.doc, self.leaves = batch, doc, []
        self.lo, self.hi = int(batch.first[doc]), int(batch.first[doc + 1])
        self.open: list[tuple[np.ndarray, int, int, int]] = []  # values, first segment, number of the leaf, the highest
        self.avoided: dict[tuple[int, int], list[tuple[int, ...]]] = {}

    def best(self) -> tuple[float, int, int, int]:
        """The highest open value, with its list, segment and leaf."""
        value, k, at = max(((float(v[i]), k, i) for k, (v, _, _, i) in enumerate(self.open)), default=(-math.inf, 0, 0))
        return (value, k, at + self.open[k][1], self.open[k][2]) if self.open else (value, 0, 0, 0)

    def close(self, k: int, at: int) -> None:
        """Takes a node out of an open list."""
        values, start, leaf, _ = self.open[k]
        values[at - start] = -math.inf
        self.open[k] = (values, start, leaf, int(values.argmax()))


def open_nodes(b: Batch, found: list[tuple[_Search, float, int]], number: int, slots: np.ndarray, logs: np.ndarray, mass: np.ndarray) -> None:
    """Adds to each search its drawn leaf, of the given value and differing from its parent from segment ``start`` on, and
    the open nodes that it leaves from there on."""
    docs, values, starts = (np.array(x) for x in zip(*((s.doc, v, at) for s, v, at in found), strict=True))
    lo, n = b.first[docs] + starts, b.first[docs + 1] - b.first[docs] - starts
    at = np.arange(int(n.sum())) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    # summed for each text by itself, so that a row's digits don't depend on its batch
    before = [np.cumsum(own)[start:] - own[start:] for own, start in ((logs[s.lo : s.hi], start) for s, _, start in found)]
    place = np.log(mass[at]) + np.concatenate(before)
    noise = np.log(uniforms(b.seeds[b.doc[at]], 10_000 + number, at - b.first[b.doc[at]]))
    highest = -np.logaddexp(-np.repeat(values, n), np.log(-noise) - place)
    end = 0
    for (s, value, start), count in zip(found, n.tolist(), strict=True):
        own, end = highest[end : end + count], end + count
        s.leaves.append((slots[b.base[s.doc] : b.base[s.doc + 1]].copy(), logs[s.lo : s.hi].copy(), value))
        s.open.append((own, start, len(s.leaves) - 1, int(own.argmax())))


@dataclass
class Samples:
    """Segmentations of a few texts following each other: of row i the text's number, the sample's, log probability,
    perturbed value, log inclusion probability, and ids[bounds[i]:bounds[i + 1]]; ``decoded``: these give back the text."""

    doc: list[int]
    sample: list[int]
    log_prob: list[float]
    perturbed: list[float]
    log_inclusion: list[float]
    ids: np.ndarray
    bounds: np.ndarray
    decoded: list[bool]


def drawn_samples(texts: list[str], seeds: list[int], vocab: Vocabulary, k: int) -> Iterator[Samples]:
    """Up to k distinct segmentations of each text, for about OUT_CHARS characters of texts at once."""
    b = Batch(texts, seeds, vocab)
    slots, mass = np.full(int(b.start[-1]), -1, dtype=np.int32), np.zeros(len(b.which))
    b.draw(np.arange(len(b.which)), 1, slots, mass)
    logs, searches = b.logs(slots), [_Search(b, d) for d in range(b.n)]
    roots = -np.log(-np.log(uniforms(b.seeds, 0, np.zeros(b.n))))
    with np.errstate(divide="ignore"):  # a node without mass has the value minus infinity
        if searches:
            open_nodes(b, [(s, float(roots[s.doc]), 0) for s in searches], 0, slots, logs, mass)
        for r in range(2, k + 1):
            todo, places = [], []
            for s in searches:
                value, which, at, leaf = s.best()
                if value == -math.inf:
                    continue
                s.close(which, at)
                slots[b.base[s.doc] : b.base[s.doc + 1]] = s.leaves[leaf][0]
                avoided = [*s.avoided.get((leaf, at), ()), b.widths(s.lo + at, slots)]
                slots[b.start[s.lo + at] : b.base[s.doc + 1]] = -1
                b.draw_other(s.lo + at, avoided, 100 * r, slots, mass)
                s.avoided[len(s.leaves), at] = avoided
                places.append(np.arange(s.lo + at + 1, s.hi))
                todo.append((s, value, at))
            if todo:
                b.draw(np.concatenate(places), r, slots, mass)
                open_nodes(b, todo, r, slots, b.logs(slots), mass)
    step = 0
    while step < b.n:
        upto = max(step + 1, int(np.searchsorted(b.base, b.base[step] + OUT_CHARS, side="right")) - 1)
        rows = []
        for s in searches[step:upto]:
            kappa = s.best()[0]
            for i, (_, chosen, value) in enumerate(s.leaves):
                p = float(chosen.sum())
                # log(1 - exp(-exp(d))): d itself where exp(d) is tiny
                d = p - kappa
                rows.append((s.doc, i + 1, p, value, 0.0 if d > 30 else d if d < -30 else math.log(-math.expm1(-math.exp(d)))))
        doc, *numbers = map(list, zip(*rows, strict=True))
        ids, bounds = b.pieces([own for s in searches[step:upto] for own, *_ in s.leaves])
        same = [raw == b.bytes[b.bytes_base[d] : b.bytes_base[d + 1]] for d, raw in zip(doc, decoded(ids, bounds, vocab), strict=True)]
        yield Samples(doc, *numbers, ids, bounds, same)
        step = upto


def top_k(texts: list[str], seeds: list[int], vocab: Vocabulary, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k distinct segmentations: ids, log probability, perturbed value, log inclusion probability.
    There are fewer only where a text has no more."""
    out = [[] for _ in texts]
    for s in drawn_samples(texts, seeds, vocab, k):
        for d, a, z, *numbers in zip(s.doc, s.bounds[:-1], s.bounds[1:], s.log_prob, s.perturbed, s.log_inclusion, strict=True):
            out[d].append((s.ids[a:z], *numbers))
    return out


SAMPLES = "key string, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids array<int>, ids_xxh64 string, decoded boolean"


def sampled(docs: DataFrame, k: int = 2, theta: float = 0.5, key: str = "doc_id", path: str | None = None, seed: int = 42, with_ids: bool = True, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """key, sample (1 to k, in falling order of the perturbed value), n_pieces, log_prob, perturbed, log_inclusion, ids
    (null without ``with_ids``), ids_xxh64 and decoded (the ids give back the text) of each row's segmentations.

    A null text counts as empty; an empty text has one segmentation, the piece of the dummy prefix's space. Rows with
    equal keys and texts get equal samples; a null key is a key of its own. Whole texts of any length; an empty table
    gives an empty result; columns other than key and text are not read. The vocabulary goes to executors with the task.
    A worker holds the lattices of about ``batch_chars`` characters of texts at once, or of one longer text.
    """
    vocab, kind = load(path or model_path(), theta), docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("key"), [t or "" for t in batch.column("text").to_pylist()]
            seeds = [xxhash.xxh64_intdigest(x or "", seed) for x in names.to_pylist()]
            ends, at = np.cumsum([len(t) for t in texts]), 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_chars, side="right")))
                for s in drawn_samples(texts[at:upto], seeds[at:upto], vocab, k):
                    digests = [xxhash.xxh64_hexdigest(s.ids[a:z].astype("<i4", copy=False).data) for a, z in pairwise(s.bounds.tolist())]
                    ids = pa.ListArray.from_arrays(pa.array(s.bounds, pa.int32()), pa.array(s.ids, pa.int32())) if with_ids else pa.nulls(len(s.doc), pa.list_(pa.int32()))
                    columns = [names.take(pa.array(np.array(s.doc) + at)), pa.array(s.sample, pa.int32()), pa.array(np.diff(s.bounds), pa.int64()), *(pa.array(x, pa.float64()) for x in (s.log_prob, s.perturbed, s.log_inclusion))]
                    yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(digests, pa.string()), pa.array(s.decoded, pa.bool_())], names=[x.split()[0] for x in SAMPLES.split(", ")])
                at = upto
                release_memory()

    plain = docs.select(F.col(key).cast("string").alias("key"), F.col("text"))
    found = plain.mapInArrow(task, SAMPLES)
    return found.select(F.col("key").cast(kind).alias(key), *(x.split()[0] for x in SAMPLES.split(", ")[1:]))


def op8_gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sampled`` over all documents; its docstring tells what null and empty texts, repeated rows and empty tables give."""
    return sampled(table(spark, sf_dir, "documents"))
