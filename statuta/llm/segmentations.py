"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

The lattice of a text holds every way to cut it into pieces of the vocabulary; pieces weigh by a Zipf law of
their merge rank (a BPE model stores ranks, no probabilities).  A perturbed A* search emits segmentations in the order of
their Gumbel-perturbed log-probabilities: the first k are a sample of k without replacement.  Its agenda
holds regions of the lattice, each with its largest perturbed value; the lattice's exact backward sums give a region's
mass, so the heuristic is exact.  Popping a region walks to its best segmentation and splits the rest, word by
word, into ``same words up to here, another cut of this word``; their largest values are Gumbels cut off at the popped
one.  Only the best few regions of a walk can ever be popped, and only those are kept.

No piece has a space after another character, nor a letter beside punctuation (the vocabulary is searched for both), so
the lattice of a text is a chain of word lattices, a word's is built once, and the walks of a batch of texts go in step in numpy.  Noise is a hash of row key, walk, word place and
step: a row's samples depend on nothing else.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import id_and_text, slices

SPACE = "▁"
#: Where a text may be cut into words: before spaces and, if no piece goes across, where Latin letters begin or end.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
COARSE = re.compile(f"{SPACE}+[^{SPACE}]*")
FINE = re.compile(f"{SPACE}*(?:[{LATIN}]+|[^{LATIN}{SPACE}]+)|{SPACE}+")
ALPHA, UNKNOWN_PENALTY = 0.5, 10.0
#: The pool of word lattices starts anew beyond so many edges (32 bytes each).
MOST_EDGES = 2_000_000
_open: dict[tuple, PieceLattice] = {}
_gold = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform noise in (0, 1) from words to be hashed."""
    u = (mixed(x) >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def gumbel(x: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise."""
    return -np.log(-np.log(uniform(x)))


def times_gold(n: int) -> np.uint64:
    return np.uint64(n * int(_gold) % (1 << 64))


class Numbers(dict):
    """Words' first nodes; a word asked for that isn't there is noted, and its number is minus its place among those."""

    def __init__(self) -> None:
        super().__init__()
        self.missing: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        return self.missing.setdefault(word, -1 - len(self.missing))


class Pool:
    """Word lattices side by side: edges by node, likeliest first.

    Of an edge: its log-probability given that its node was reached, the same for the node's other edges together, and
    the node's running probability up to it (over 1 at the last).
    """

    def __init__(self) -> None:
        self.word = Numbers()
        self.release()

    def release(self) -> None:
        """Forgets all words and gives their memory back."""
        self.first = self.lp = self.rest = self.upto = self.to = self.id = np.zeros(0)
        self.word.clear()
        self.n_nodes = self.n_edges = 0

    def clear(self) -> None:
        self.word.clear()
        self.n_nodes = self.n_edges = 0
        if not len(self.lp):
            size = MOST_EDGES + (MOST_EDGES >> 2)
            self.first = np.zeros(size >> 1, np.int64)
            self.lp, self.rest, self.upto = (np.zeros(size) for _ in range(3))
            self.to, self.id = np.zeros(size, np.int32), np.zeros(size, np.int32)

    def extend(self, degrees: np.ndarray, **columns: np.ndarray) -> None:
        def put(name: str, at: int, values: np.ndarray) -> None:
            array = getattr(self, name)
            if at + len(values) > len(array):
                setattr(self, name, array := np.concatenate([array, np.zeros(at + len(values) - len(array) + (len(array) >> 2), array.dtype)]))
            array[at : at + len(values)] = values

        put("first", self.n_nodes + 1, self.n_edges + np.cumsum(degrees))
        for name, values in columns.items():
            put(name, self.n_edges, values)
        self.n_nodes += len(degrees)
        self.n_edges += int(degrees.sum())


class PrefixTable:
    """Open-address hash table of all prefixes of the pieces, probed for many places of a text at once."""

    def __init__(self, pieces: list[tuple[str, int, float]], bits: int = 20):
        found: dict[str, tuple[int, float]] = {p[:k]: (-1, 0.0) for p, _, _ in pieces for k in range(1, len(p) + 1)}
        found.update({p: (i, w) for p, i, w in pieces})
        self.longest = max(len(p) for p in found)
        bits = max(bits, (2 * len(found)).bit_length())  # at most half full
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        by_length: dict[int, list[str]] = {}
        for p in found:
            by_length.setdefault(len(p), []).append(p)
        # hashes begin with a number under which no two prefixes share one
        self.begin, hashes = 0, self._hashes(by_length, 0)
        while len(np.unique(hashes)) < len(hashes):
            self.begin += 1
            hashes = self._hashes(by_length, self.begin)
        keys, slots = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        self.id, self.weight = np.zeros(len(found) + 1, np.int64), np.zeros(len(found) + 1)
        named = (p for group in by_length.values() for p in group)
        for n, (p, x, slot) in enumerate(zip(named, hashes.tolist(), self._slot(hashes).tolist(), strict=True), 1):
            self.id[n], self.weight[n] = found[p]
            while slots[slot]:
                slot = (slot + 1) & self.mask
            keys[slot], slots[slot] = x, n
        self.keys, self.slots = keys, slots

    def _hashes(self, by_length: dict[int, list[str]], begin: int) -> np.ndarray:
        out = []
        for group in by_length.values():
            h = np.full(len(group), begin, np.uint64)
            for column in np.frombuffer("".join(group).encode("utf-32-le"), "<u4").reshape(len(group), -1).T:
                h = self._next(h, column)
            out.append(h)
        return np.concatenate(out)

    @staticmethod
    def _next(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h + code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hashed prefix, 0 where there is none."""
        slot = self._slot(h)
        number = self.slots[slot]
        wrong = np.flatnonzero((number > 0) & (self.keys[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            number[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(number[wrong] > 0) & (self.keys[slot[wrong]] != h[wrong])]
        return number

    def matches(self, code: np.ndarray, end: np.ndarray) -> list[tuple]:
        """By length, ``(places, length, ids, weights)`` of the pieces that stand in the text and end by ``end`` of their place."""
        at, h = np.arange(len(code)), np.full(len(code), self.begin, np.uint64)
        out = []
        for length in range(1, self.longest + 1):
            h = self._next(h, code[at + (length - 1)])
            number = self._find(h)
            ok = number > 0
            at, h, number = at[ok], h[ok], number[ok]
            piece = np.flatnonzero(self.id[number] >= 0)
            out.append((at[piece], length, self.id[number[piece]], self.weight[number[piece]]))
            more = at + length < end[at]
            at, h = at[more], h[more]
            if not len(at):
                break
        return out


def piece_weights(scores: list[float], alpha: float = ALPHA) -> list[float]:
    """Log weights of pieces from a model's scores in order of their ids: the scores themselves where they are log-probabilities.

    Scores that are all whole numbers only rank the pieces (a BPE model's): those weigh by a Zipf law of their place with exponent ``alpha``.
    """
    if not all(float(s).is_integer() for s in scores):
        return [float(s) for s in scores]
    total = math.log(sum((r + 2.0) ** -alpha for r in range(len(scores))))
    return [-alpha * math.log(r + 2.0) - total for r in range(len(scores))]


class PieceLattice:
    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [(i, model.id_to_piece(i)) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for _, p in pieces):
            raise ValueError("the vocabulary has pieces with a space inside")
        self.words = (FINE if all(FINE.fullmatch(p) for _, p in pieces) else COARSE).findall
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte):
            raise ValueError("the vocabulary has no pieces for bytes")
        self.weight = {p: (i, w) for (i, p), w in zip(pieces, piece_weights([model.get_score(i) for i, _ in pieces], alpha), strict=True)}
        self.unknown = min(w for _, w in self.weight.values()) - UNKNOWN_PENALTY
        self.table = PrefixTable([(p, i, self.weight[p][1]) for i, p in pieces])
        self.bytes = [b""] * n
        for i, p in pieces:
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.spelling = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spelt_in = np.array([len(b) for b in self.bytes], np.int64)
        self.spelt_at = np.cumsum(self.spelt_in) - self.spelt_in
        self.pool = Pool()

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the space that encoding puts in front goes."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def spellings(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of segmentations that stand one after another in ``ids`` and end at ``ends``."""
        size = self.spelt_in[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        text = self.spelling[np.repeat(self.spelt_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cuts = upto[np.concatenate([[0], ends])].tolist()
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: list[str]) -> np.ndarray:
        """Puts the lattices of new words into the pool, edges from the prefix table, then backward sums; their first nodes."""
        pool = self.pool
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        n = len(code)
        end = np.repeat(ends, sizes)
        groups = self.table.matches(code, end)
        single = np.zeros(n, bool)
        single[groups[0][0]] = True
        odd = np.flatnonzero(~single)
        if len(odd):
            known = np.array([self.byte[c] if c < 128 else -1 - c for c in code[odd].tolist()], np.int64)
            groups.append((odd, 1, known, np.full(len(odd), self.unknown)))
        degree = np.zeros(n, np.int64)
        for at, *_ in groups:
            degree[at] += 1
        first = np.cumsum(degree) - degree
        # a node's edges, longest first: those take most of its probability
        put = first + degree
        size = int(degree.sum())
        at_, to, ids, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
        for at, length, piece, w in groups[-1:] * bool(len(odd)) + groups[: len(groups) - bool(len(odd))]:
            put[at] -= 1
            place = put[at]
            at_[place], to[place], ids[place], weight[place] = at, at + length, piece, w
        # backward sums, for all words at once, from the last character on
        left = end - np.arange(n)
        by_left = np.argsort(left.astype(np.uint16) if sizes.max() < 1 << 16 else left, kind="stable")
        cuts = np.cumsum(np.append(0, np.bincount(left)[1:]))
        beta = np.zeros(n + 1)
        last = np.zeros(n + 1, bool)
        last[ends] = True
        stop = last[to]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            node = by_left[lo:hi]
            d = degree[node]
            start = np.cumsum(d) - d
            edge = np.repeat(first[node] - start, d) + np.arange(int(d.sum()))
            value = weight[edge] + np.where(stop[edge], 0.0, beta[to[edge]])
            top = np.maximum.reduceat(value, start)
            beta[node] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, d)), start))
        lp = weight + np.where(stop, 0.0, beta[to]) - beta[at_]
        p = np.exp(lp)
        large = p >= 0.5  # one edge of a node at most: the sum of the others keeps its digits
        others = np.add.reduceat(np.where(large, 0.0, p), first)
        with np.errstate(divide="ignore"):
            rest = np.where(large, np.log(others)[at_], np.log1p(-np.where(large, 0.0, p)))
        run = np.cumsum(p)
        upto = run - (run[first] - p[first])[at_]
        upto[first + degree - 1] = 2.0
        firsts = pool.n_nodes + ends - sizes
        pool.word.update(zip(words, firsts.tolist(), strict=True))
        pool.extend(degree, to=np.where(stop, -1, pool.n_nodes + to), id=ids, lp=lp, rest=rest, upto=upto)
        return firsts

    def _walk(self, node: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A drawn way through each word from its first node: the edges of all words in order, and each word's first."""
        pool = self.pool
        place, steps = np.arange(len(node)), []
        count = np.zeros(len(node), np.int64)
        while len(place):
            edge = pool.first[node]
            u = uniform(salt[place] + times_gold(len(steps) + 1))
            far = np.flatnonzero(u >= pool.upto[edge])
            while len(far):
                edge[far] += 1
                far = far[u[far] >= pool.upto[edge[far]]]
            steps.append((place, edge))
            node = pool.to[edge]
            go = np.flatnonzero(node >= 0)
            count[place] += 1
            place, node = place[go], node[go]
        begin = np.cumsum(count) - count
        edges = np.zeros(int(count.sum()), np.int64)
        for n, (at, edge) in enumerate(steps):
            edges[begin[at] + n] = edge
        return edges, begin

    def _others(self, node: int, taken: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], float]]:
        """The least prefixes that lead away from all the taken ways through a word, with log-probabilities."""
        pool, out = self.pool, []
        full = set(taken)
        prefixes = sorted({t[:n] for t in taken for n in range(len(t))}, key=lambda x: (len(x), x))
        known = set(prefixes) | full
        mass = {(): 0.0}
        for prefix in prefixes:
            at = int(pool.to[prefix[-1]]) if prefix else node
            for e in range(int(pool.first[at]), int(pool.first[at + 1])):
                way, lp = (*prefix, e), mass[prefix] + float(pool.lp[e])
                if way in known:
                    mass[way] = lp
                else:
                    out.append((way, lp))
        return out

    def _another(self, node: int, taken: list[tuple[int, ...]], salt: int) -> tuple[tuple[int, ...], float]:
        """A drawn way through a word other than the taken ones, and the log-probability of those still left."""
        pool = self.pool
        ways = self._others(node, taken)
        noise = gumbel(np.arange(salt, salt + len(ways), dtype=np.uint64))
        way = ways[int(np.argmax(noise + [lp for _, lp in ways]))][0]
        step, at = 0, int(pool.to[way[-1]])
        while at >= 0:
            step += 1
            u = float(uniform(np.array([salt + (1 << 32) + step], np.uint64))[0])
            e = int(pool.first[at])
            while u >= pool.upto[e]:
                e += 1
            way, at = (*way, e), int(pool.to[e])
        left = self._others(node, [*taken, way])
        return way, float(np.logaddexp.reduce([lp for _, lp in left])) if left else -math.inf

    def samples(self, texts: list[str | None], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k distinct segmentations: ``(ids, log-probability, perturbed value, inclusion score)``.

        They come in falling perturbed value.  The inclusion score is the chance of being among the k, given
        the (k+1)th value; it is 1 where the text has no more segmentations.
        """
        pool = self.pool
        each = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if pool.n_edges > MOST_EDGES or not len(pool.lp):
            pool.clear()
        sizes = np.array([len(w) for w in each], np.int64)
        base = np.fromiter(map(pool.word.__getitem__, chain.from_iterable(each)), np.int64, int(sizes.sum()))
        if pool.word.missing:
            new = list(pool.word.missing)
            pool.word.missing.clear()
            firsts = self._learn(new)
            unknown = np.flatnonzero(base < 0)
            base[unknown] = firsts[-1 - base[unknown]]
        start = np.concatenate([[0], np.cumsum(sizes)])
        inside = (np.arange(len(base)) - np.repeat(start[:-1], sizes)).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        root = mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(1))
        value = gumbel(root)
        out: list[list] = [[] for _ in texts]
        # of a region: minus its value, the walk it left, the word that is cut otherwise, and that word's ways already taken
        agenda: list[list[tuple[float, int, int, list]]] = [[(-float(value[d]), -1, -1, [])] if sizes[d] else [] for d in range(len(texts))]
        paths: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for d in np.flatnonzero(sizes == 0).tolist():
            out[d].append((np.zeros(0, np.int32), 0.0, float(value[d]), 1.0))
        for walk in range(k):
            popped = [(d, *heapq.heappop(agenda[d])) for d in range(len(texts)) if agenda[d] and len(out[d]) == walk]
            if not popped:
                break
            heads, prior, begin = [], np.zeros(len(popped)), np.zeros(len(popped), np.int64)
            for n, (d, minus, old, word, taken) in enumerate(popped):
                if word < 0:
                    heads.append(None)
                    begin[n] = start[d]
                    continue
                edges, first = paths[d, old]
                w = word - int(start[d])
                cut = int(first[w])
                if not taken:
                    taken = [tuple(edges[cut : int(first[w + 1]) if w + 1 < len(first) else len(edges)].tolist())]
                salt = int(mixed(root[d : d + 1] + times_gold(walk + 1) + inside[word : word + 1] + np.uint64(7))[0]) >> 1
                way, left = self._another(int(base[word]), taken, salt)
                heads.append((np.concatenate([edges[:cut], way]), first[: w + 1]))
                before = float(pool.lp[edges[:cut]].sum())
                prior[n] = before + float(pool.lp[list(way)].sum())
                begin[n] = word + 1
                if left > -math.inf:
                    t = before + left + float(gumbel(np.array([salt + (1 << 33)], np.uint64))[0])
                    heapq.heappush(agenda[d], (float(np.logaddexp(minus, -t)), old, word, [*taken, way]))
            where = np.array([p[0] for p in popped])
            top = np.array([-p[1] for p in popped])
            lengths = start[where + 1] - begin
            opens = np.cumsum(lengths) - lengths
            occ = np.repeat(begin - opens, lengths) + np.arange(int(lengths.sum()))
            salt = mixed(np.repeat(root[where], lengths) + times_gold(walk + 1) + inside[occ])
            edges, first = self._walk(base[occ], salt)
            lp = pool.lp[edges]
            total = np.concatenate([[0.0], np.cumsum(lp)])
            word_at = np.append(total[first], total[-1])
            doc_at = word_at[np.append(opens, len(first))]
            if len(first):
                upto = word_at[:-1] + np.repeat(prior - doc_at[:-1], lengths)  # log-probability before each word
                count = np.diff(np.append(first, len(edges)))
                with np.errstate(divide="ignore"):
                    other = np.log(np.add.reduceat(np.exp(total[:-1] - np.repeat(word_at[:-1], count) + pool.rest[edges]), first))
                self._regions(upto + other + gumbel(salt + np.uint64(3)), opens, lengths, occ, top, where, walk, k - walk, agenda)
            bounds = np.append(first, len(edges))[np.append(opens, len(first))]
            for n, (d, *_) in enumerate(popped):
                mine, at = edges[bounds[n] : bounds[n + 1]], first[opens[n] : opens[n] + lengths[n]] - bounds[n]
                if heads[n] is not None:
                    head, head_first = heads[n]
                    mine, at = np.concatenate([head, mine]), np.concatenate([head_first, at + len(head)])
                paths[d, walk] = mine, at
                ids = pool.id[mine]
                if ids.min() < 0:
                    ids = self._spelt(ids)
                out[d].append((ids, float(prior[n] + doc_at[n + 1] - doc_at[n]), float(top[n]), 1.0))
        for d, found in enumerate(out):
            if agenda[d]:
                kappa = -agenda[d][0][0]
                out[d] = [(ids, lp, g, -math.expm1(-math.exp(min(lp - kappa, 700.0)))) for ids, lp, g, _ in found]
        return out

    @staticmethod
    def _regions(t: np.ndarray, opens: np.ndarray, lengths: np.ndarray, occ: np.ndarray, top: np.ndarray, where: np.ndarray, walk: int, want: int, agenda: list[list]) -> None:
        """Puts each walk's ``want`` best regions on the agenda.

        Below a walk's value G a region's is -log(exp(-G) + exp(-t)), which rises with t.
        """
        some = np.flatnonzero(lengths)
        seg, reps = opens[some], lengths[some]
        for _ in range(want):
            high = np.maximum.reduceat(t, seg)
            hits = np.flatnonzero(t == np.repeat(high, reps))
            own = np.searchsorted(seg, hits, "right") - 1
            hits = hits[np.concatenate([[True], own[1:] != own[:-1]])]
            for h, n, best in zip(hits.tolist(), some.tolist(), high.tolist(), strict=True):
                if best > -math.inf:
                    heapq.heappush(agenda[where[n]], (float(np.logaddexp(-top[n], -best)), walk, int(occ[h]), []))
            t[hits] = -np.inf

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        """Ids with unknown characters spelt in byte pieces."""
        full: list[int] = []
        for i in ids.tolist():
            full.extend([i] if i >= 0 else [self.byte[b] for b in chr(-1 - i).encode()])
        return np.array(full, np.int32)


def lattice(path: str, alpha: float = ALPHA) -> PieceLattice:
    if (path, alpha) not in _open:
        _open[path, alpha] = PieceLattice(path, alpha)
    return _open[path, alpha]


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, alpha: float = ALPHA, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k rows for each row: doc_id, sample (from 1), n_tokens, log_prob, perturbed, inclusion, round_trip, ids_crc32 and, if asked, ids.

    ``round_trip`` tells whether decoding gives the text back (with U+2581 read as a space).  Null and empty
    texts have one segmentation without tokens; very long texts are segmented whole.  Noise is seeded by doc_id (null: zero), so
    repeated rows repeat their samples, and a text with fewer than k segmentations gives all of them.  Other columns
    are not read, and no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path, alpha)
        for batch in slices(batches, 192 << 10):
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").fill_null(0).to_numpy()
            found = model.samples(texts, keys, k)
            each = [x for f in found for x in f]
            of = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            sample = np.concatenate([np.arange(1, len(f) + 1) for f in found])
            flat = np.concatenate([x[0] for x in each]).astype("<i4")
            ends = np.cumsum([len(x[0]) for x in each])
            offsets = np.concatenate([[0], ends])
            plain = [(" " + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            same = [plain[d] == s for d, s in zip(of.tolist(), model.spellings(flat, ends), strict=True)]
            data = memoryview(flat).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), ends.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(of)), pa.array(sample.astype(np.int32)), pa.array(np.diff(offsets)),
                *(pa.array([x[n] for x in each], pa.float64()) for n in (1, 2, 3)), pa.array(same, pa.bool_()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "sample", "n_tokens", "log_prob", "perturbed", "inclusion", "round_trip", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        model.pool.release()

    rows = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, sample int, n_tokens long, log_prob double, perturbed double, inclusion double, round_trip boolean, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
