"""SentencePiece encoding with sampled segmentations, and decoding.

A text's lattice has its characters' borders as nodes and the vocabulary's pieces as arcs. Pieces
get log-probabilities from their place in the vocabulary (Zipf: the piece of rank r has weight
1 / (r + 2), to the power ``alpha``), so a segmentation has a probability. ``k`` distinct
segmentations are drawn without replacement by Gumbel top-k: each one's log-probability plus
Gumbel noise is its perturbed score, and the k best are the sample.

The noise is never drawn for all of them. A best-first (A*) search keeps an agenda of disjoint
sets of segmentations, each "equal to a known path up to a node, and none of some arcs there",
with its exact perturbed maximum as its bound: the maximum of a set is a Gumbel around the log of
the set's mass, cut off at the maximum of the set it came from. Taking the best set off the
agenda draws the segmentation that attains it, by walking the lattice with the backward sums, and
splits the rest of the set along that path. A sample's inclusion score is the probability of
being drawn given the perturbed score just below the sample, 1 - exp(-exp(log p - kappa)).

No piece of the vocabulary has a word mark after another character, so all paths pass the start
of every unit (a word with its mark), and a unit's lattice and sums are built once and shared by
its occurrences; the search itself runs over the whole text. Random numbers are a function of
(seed, row key, sample, place), so a retried task repeats itself. Characters without a piece are
spelled in bytes. Decoding concatenates the pieces' bytes.

Defined results: null counts as the empty text, whose one segmentation is empty, with inclusion
1; a text with fewer than k segmentations has fewer rows, each with inclusion 1; rows with equal
key and text have equal samples; an empty table gives no rows. A literal word mark decodes to a
space, as in the library. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import slices, text_of
from ticketlens.llm.shingles import mixed
from ticketlens.llm.token_counts import MARK, tokenizer_path

TOKENIZER = "piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 0.5, 1
#: Units a task remembers, to bound its memory (about two kilobytes each), and how many of them, the most used
#: ones, stay when they become too many.
UNITS, KEPT = 160_000, 90_000
#: Units whose lattices are built together.
ADDED = 16_000
#: Bytes of text searched at a time; a search holds some fifty bytes per byte of text.
SLICE_BYTES = 1_500_000
#: Log-weight of one byte of a character that has no piece.
BYTE_LOGIT = -14.0
_HASH_BITS = 21
_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def unit_interval(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64 mixed bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sums_before(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of the elements from ``start`` (per element, its group's first) up to each, exclusive.

    In whole units of 2 ** -40, so that a group's sums don't depend on what stands before it.
    """
    units = np.rint(x * 2.0**40).astype(np.int64)
    run = np.cumsum(units) - units
    return (run - run[start]) * 2.0**-40


def _times(step: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(step) * n % 2**64)


def row_keys(ids: list, seed: int) -> np.ndarray:
    """A 64-bit stream key per row id."""
    return np.array(
        [int.from_bytes(hashlib.blake2b(f"{seed}|{i}".encode(), digest_size=8).digest(), "little") for i in ids],
        dtype=np.uint64,
    )


class Vocabulary:
    """Pieces of a model file as a trie of sorted (state, character) keys."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.byte_id = np.full(256, -1, dtype=np.int64)
        edges: dict[tuple[int, str], int] = {}
        self.texts: list[bytes] = []
        ends: dict[int, int] = {}
        logits = np.full(size, -np.inf)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.texts.append(bytes([int(piece[1:-1], 16)]))
                continue
            self.texts.append(piece.replace(MARK, " ").encode())
            rank = -model.get_score(i)
            # Pieces far below all others are never made by merges, so the library never emits them.
            # A single character needs no merge.
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if rank > size and len(piece) > 1:
                continue
            if MARK in piece[1:]:
                raise ValueError(f"piece {i} has a word mark inside; units would not be independent")
            logits[i] = -alpha * np.log(min(rank, size) + 2)
            state = 0
            for c in piece:
                state = edges.setdefault((state, c), len(edges) + 1)
            ends[state] = i
        self.logits = logits
        keys = np.array([(s << 21) | ord(c) for s, c in edges], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.child = np.array(list(edges.values()), dtype=np.int64)[order]
        # Where a key is, by its hash; the few keys that share a hash are looked up in the sorted list.
        slot = self._slot(self.keys)
        self.place = np.zeros(1 << _HASH_BITS, dtype=np.int32)
        self.place[slot] = np.arange(len(slot))
        self.shared = np.zeros(1 << _HASH_BITS, dtype=bool)
        self.shared[slot[self.place[slot] != np.arange(len(slot))]] = True
        self.piece_at = np.full(len(edges) + 1, -1, dtype=np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        self.alpha = alpha
        lengths = np.array([len(t) for t in self.texts])
        self.text_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.text_len = lengths
        self.blob = np.frombuffer(b"".join(self.texts), dtype=np.uint8)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _STEP) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)

    def edges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the trie has, and the states that those lead to."""
        slot = self._slot(keys)
        found = self.place[slot]
        hit = self.keys[found] == keys
        again = np.flatnonzero(~hit & self.shared[slot])
        if len(again):
            found[again] = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            hit[again] = self.keys[found[again]] == keys[again]
        return hit, self.child[found[hit]]

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces, end to end, and where each piece ends."""
        lengths = self.text_len[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return self.blob[:0], ends
        shift = np.repeat(self.text_start[ids] - (ends - lengths), lengths)
        return self.blob[shift + np.arange(ends[-1])], ends

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes, with the space that stands for the first word mark."""
        return self.spelled(ids)[0].tobytes()

    def decodes_to(self, ids: np.ndarray, ends: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether each list of ids (lists end to end, ``ends`` begins with 0) spells its text; a flat comparison."""
        found, piece_ends = self.spelled(ids)
        stops = np.concatenate(([0], piece_ends))[ends]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        same = np.diff(stops) == sizes
        if not same.all():
            # Only a bug brings us here; lists of other lengths are compared one by one.
            raw = [found[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]
            return np.array([a == b for a, b in zip(raw, texts, strict=True)], dtype=bool)
        wrong = np.flatnonzero(found != np.frombuffer(b"".join(texts), dtype=np.uint8))
        same[np.searchsorted(stops[1:], wrong, side="right")] = False
        return same


@lru_cache(maxsize=2)
def vocabulary(name: str, alpha: float) -> Vocabulary:
    return Vocabulary(tokenizer_path(name), alpha)


class Lattices:
    """Lattices of units in flat arrays: nodes, arcs by node, backward sums, arc probabilities."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.uses = np.zeros(0, dtype=np.int64)
        self.base = np.zeros(0, dtype=np.int64)
        self.end = np.zeros(0, dtype=np.int64)
        self.nodes = 0
        self.arc_start = np.zeros(1, dtype=np.int64)
        self.arc_node = np.zeros(0, dtype=np.int32)
        self.arc_next = np.zeros(0, dtype=np.int32)
        self.arc_id = np.zeros(0, dtype=np.int32)
        self.arc_logp = np.zeros(0)
        self.arc_upto = np.zeros(0)

    def indices(self, texts: list[list[str]]) -> np.ndarray:
        """The unit number of every unit of every text."""
        needed = set(chain.from_iterable(texts))
        fresh = list(needed - self.known.keys())
        if len(self.known) + len(fresh) > UNITS:
            self._forget()
            fresh = list(needed - self.known.keys())
        for i in range(0, len(fresh), ADDED):
            self._add(fresh[i : i + ADDED])
        every = map(self.known.__getitem__, chain.from_iterable(texts))
        out = np.fromiter(every, np.int64, sum(map(len, texts)))
        self.uses = np.bincount(out, minlength=len(self.known)) + np.pad(self.uses, (0, len(self.known) - len(self.uses)))
        return out

    def _forget(self) -> None:
        """Keep the most used units; their nodes and arcs close ranks. Uses halve, so that old ones fade."""
        often = np.flatnonzero(self.uses > 1)
        keep = np.sort(often[np.argsort(-self.uses[often], kind="stable")[:KEPT]])
        if not len(keep):
            self.clear()
            return

        def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
            ends = np.cumsum(count)
            return np.repeat(start - (ends - count), count) + np.arange(ends[-1])

        base, end = self.base[keep], self.end[keep]
        nodes = ranges(base, end - base + 1)
        first, arcs_of = self.arc_start[base], self.arc_start[end + 1] - self.arc_start[base]
        arcs = ranges(first, arcs_of)
        moved = np.cumsum(end - base + 1) - (end - base + 1)
        shift = np.repeat(moved - base, arcs_of).astype(np.int32)
        per_node = self.arc_start[nodes + 1] - self.arc_start[nodes]
        self.arc_start = np.concatenate(([0], np.cumsum(per_node)))
        self.arc_node, self.arc_next = self.arc_node[arcs] + shift, self.arc_next[arcs] + shift
        self.arc_id, self.arc_logp, self.arc_upto = self.arc_id[arcs], self.arc_logp[arcs], self.arc_upto[arcs]
        self.base, self.end, self.nodes = moved, moved + end - base, len(nodes)
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.uses = self.uses[keep] // 2

    def _add(self, units: list[str]) -> None:
        v = self.vocab
        first = len(self.known)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        chars = np.frombuffer("".join(MARK + u for u in units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter((len(u) + 1 for u in units), np.int64, len(units))
        # A node per character, and one for the end of each unit.
        stop_char = np.cumsum(sizes)
        unit_of_char = np.repeat(np.arange(len(units)), sizes)
        last = stop_char[unit_of_char]
        pos, state = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64)
        at, length, ids = [], [], []
        depth = 0
        while len(pos):
            key = (state.astype(np.uint64) << np.uint64(21)) | chars[pos + depth].astype(np.uint64)
            hit, state = v.edges(key)
            pos = pos[hit]
            piece = v.piece_at[state]
            whole = piece >= 0
            depth += 1
            at.append(pos[whole])
            length.append(np.full(whole.sum(), depth))
            ids.append(piece[whole])
            go = pos + depth < last[pos]
            pos, state = pos[go], state[go]
        single = np.zeros(len(chars), dtype=bool)
        if at:
            single[at[0]] = True
        lone = np.flatnonzero(~single)
        at.append(lone)
        length.append(np.ones(len(lone), dtype=np.int64))
        # One byte has an id; other characters are spelled later, and carry their code here.
        code = chars[lone].astype(np.int64)
        ids.append(np.where(code < 128, v.byte_id[np.minimum(code, 127)], -1 - code))
        # Long arcs first: they are mostly the likely ones, where a draw looks first.
        at, length, ids = (np.concatenate(x[::-1]) for x in (at, length, ids))
        order = np.argsort(at, kind="stable")
        at, length, ids = at[order], length[order], ids[order]
        weight = v.logits[np.maximum(ids, 0)]
        spelled = np.isinf(weight) | (ids < 0)
        bytes_of = 1 + (ids < -1 - 0x7F) + (ids < -1 - 0x7FF) + (ids < -1 - 0xFFFF)
        weight = np.where(spelled, v.alpha * BYTE_LOGIT * bytes_of, weight)
        node = at + unit_of_char[at]
        ahead = node + length
        n_nodes = len(chars) + len(units)
        starts = np.searchsorted(node, np.arange(n_nodes + 1))
        beta = np.zeros(n_nodes)
        # Backward sums, all units at once, one distance from the end after the other.
        left = last[np.arange(len(chars))] - np.arange(len(chars))
        char_node = np.arange(len(chars)) + unit_of_char
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, left.max() + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            here = char_node[by_left[a:b]]
            count = starts[here + 1] - starts[here]
            ends = np.cumsum(count)
            arcs = np.repeat(starts[here] - (ends - count), count) + np.arange(ends[-1])
            value = weight[arcs] + beta[ahead[arcs]]
            begin = ends - count
            top = np.maximum.reduceat(value, begin)
            beta[here] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), begin))
        logp = np.minimum(weight + beta[ahead] - beta[node], 0.0)
        p = np.exp(logp)
        upto = sums_before(p, starts[node]) + p
        shift = self.nodes
        closing = starts[node + 1] - 1 == np.arange(len(node))
        upto = np.where(closing, 1.0, upto)
        unit_base = np.concatenate(([0], stop_char[:-1])) + np.arange(len(units)) + shift
        self.base = np.concatenate((self.base, unit_base))
        self.end = np.concatenate((self.end, unit_base + sizes))
        self.arc_start = np.concatenate((self.arc_start[:-1], starts + len(self.arc_node)))
        self.arc_node = np.concatenate((self.arc_node, (node + shift).astype(np.int32)))
        self.arc_next = np.concatenate((self.arc_next, (ahead + shift).astype(np.int32)))
        self.arc_id = np.concatenate((self.arc_id, ids.astype(np.int32)))
        self.arc_logp = np.concatenate((self.arc_logp, logp))
        self.arc_upto = np.concatenate((self.arc_upto, upto))
        self.nodes += n_nodes

    def walk(self, node: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw paths from nodes to the ends of their units: all arcs in order, and how many each."""
        node = node.copy()
        active = np.flatnonzero(node < end)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(node), dtype=np.int64)
        while len(active):
            here = node[active]
            u = unit_interval(mixed(key[active] + _times(_STEP, len(steps))))
            arc = self.arc_start[here]
            later = np.flatnonzero(u > self.arc_upto[arc])
            while len(later):
                arc[later] += 1
                later = later[u[later] > self.arc_upto[arc[later]]]
            steps.append((active, arc))
            counts[active] += 1
            node[active] = self.arc_next[arc]
            active = active[node[active] < end[active]]
        out = np.empty(counts.sum(), dtype=np.int64)
        begin = np.cumsum(counts) - counts
        for step, (who, arc) in enumerate(steps):
            out[begin[who] + step] = arc
        return out, counts

    def ids_of(self, arcs: np.ndarray) -> np.ndarray:
        ids = self.arc_id[arcs]
        if (ids >= 0).all():
            return ids
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.vocab.byte_id[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass"))
        return np.array(out, dtype=np.int64)


def cut_gumbel(mass: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers around ``mass`` that are at most ``most``; no mass gives -inf."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = mass - np.log(np.exp(mass - most) - np.log(u))
    return np.where(np.isneginf(mass), -np.inf, np.minimum(out, most))


def _others(logp: np.ndarray) -> np.ndarray:
    """log(1 - p)."""
    with np.errstate(divide="ignore"):
        out = np.log(-np.expm1(logp))
    return np.where(logp > -1e-12, -np.inf, out)


class _Sets:
    """Agenda entries of one generation: one per arc of each text's newest path."""

    def __init__(self, arcs, offsets, before, bounds, parent, cut, excluded):
        self.arcs, self.offsets, self.before, self.bounds = arcs, offsets, before, bounds
        self.parent, self.cut, self.excluded = parent, cut, excluded


class Sampler:
    def __init__(self, vocab: Vocabulary, k: int):
        self.lattices, self.k = Lattices(vocab), k

    def sample(self, texts: list[str], keys: np.ndarray) -> list[list[tuple[np.ndarray, float, float]]]:
        """Per text up to k of (ids, log-probability, inclusion score), best perturbed score first."""
        lat, n = self.lattices, len(texts)
        units = [t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        unit = lat.indices(units)
        sizes = np.fromiter(map(len, units), np.int64, n)
        first = np.cumsum(sizes) - sizes
        base, end = lat.base[unit], lat.end[unit]
        place = np.arange(len(unit)) - np.repeat(first, sizes)
        stream = lambda number: mixed(keys + _times(_PLACE, number + 1))
        occurrence_key = lambda number: mixed(np.repeat(stream(number), sizes) + place.astype(np.uint64) * _PLACE)

        arcs, counts = lat.walk(base, end, occurrence_key(0))
        owner = np.repeat(np.repeat(np.arange(n), sizes), counts)
        offsets = np.searchsorted(owner, np.arange(n + 1))
        logp = lat.arc_logp[arcs]
        before = sums_before(logp, offsets[owner])
        top = -np.log(-np.log(unit_interval(mixed(stream(0)))))
        noise = unit_interval(mixed(stream(0)[owner] ^ (np.arange(len(arcs), dtype=np.uint64) - offsets[owner].astype(np.uint64)) * _STEP))
        bounds = cut_gumbel(before + _others(logp), top[owner], noise)
        place_of_arc = np.repeat(np.arange(len(unit)), counts)
        gens = [_Sets(arcs, offsets, before, bounds, None, None, None)]
        gens[0].place = place_of_arc
        ends_of = before + logp
        total = [float(ends_of[offsets[t + 1] - 1]) if offsets[t + 1] > offsets[t] else 0.0 for t in range(n)]
        drawn: list[list[tuple[int, float]]] = [[(0, total[t])] for t in range(n)]
        kappa = np.full(n, -np.inf)
        live = range(n)
        for number in range(1, self.k + 1):
            popped = []
            for t in live:
                best, where = -np.inf, None
                for g, s in enumerate(gens):
                    a, b = s.offsets[t], s.offsets[t + 1]
                    if b > a:
                        i = a + int(s.bounds[a:b].argmax())
                        if s.bounds[i] > best:
                            best, where = s.bounds[i], (g, i)
                if where:
                    popped.append((t, best, *where))
            if number == self.k:
                for t, best, _, _ in popped:
                    kappa[t] = best
                break
            live = [p[0] for p in popped]
            if not popped:
                break
            fresh = self._split(gens, popped, stream(number), occurrence_key(number), base, end, first, sizes, n)
            gens.append(fresh)
            for t, _, _, _ in popped:
                drawn[t].append((number, fresh.total[t]))
        return [
            [
                (lat.ids_of(self._path(gens, g, t)), lp, float(-np.expm1(-np.exp(min(lp - kappa[t], 50.0)))))
                for g, lp in drawn[t]
            ]
            for t in range(n)
        ]

    def _path(self, gens: list[_Sets], g: int, t: int) -> np.ndarray:
        s = gens[g]
        own = s.arcs[s.offsets[t] : s.offsets[t + 1]]
        if s.parent is None:
            return own
        parent, cut = s.parent[t], s.cut[t]
        return np.concatenate((self._path(gens, parent, t)[:cut], own))

    def _split(self, gens, popped, stream, occurrence_key, base, end, first, sizes, n) -> _Sets:
        """Draw the segmentation that attains each popped bound; its path's sets replace the popped one."""
        lat = self.lattices
        nodes, ends, keys, lengths, new, prefix, tops, parent, cut, excluded, places = ([] for _ in range(11))
        pick = unit_interval(mixed(stream + _STEP))
        parents, cuts, bans = {}, {}, {}
        for t, best, g, i in popped:
            s = gens[g]
            a = s.offsets[t]
            arc = int(s.arcs[i])
            node = int(lat.arc_node[arc])
            ban = s.excluded[t] if s.excluded is not None and i == a else (arc,)
            s.bounds[i] = -np.inf
            choice = [c for c in range(lat.arc_start[node], lat.arc_start[node + 1]) if c not in ban]
            p = np.exp(lat.arc_logp[choice])
            at = min(int(np.searchsorted(np.cumsum(p), pick[t] * p.sum(), side="right")), len(choice) - 1)
            arc = choice[at]
            place = int(s.place[i])
            stop = int(first[t] + sizes[t])
            nodes.append(np.append(lat.arc_next[arc], base[place + 1 : stop]))
            ends.append(end[place:stop])
            keys.append(occurrence_key[place:stop])
            lengths.append(stop - place)
            places.append(np.arange(place, stop))
            new.append(arc)
            prefix.append(s.before[i])
            tops.append(best)
            parents[t], bans[t] = g, (*ban, arc)
            # The cut counts arcs of the parent's whole path.
            cuts[t] = (i - a) + (s.cut[t] if s.cut is not None else 0)
        walked, counts = lat.walk(np.concatenate(nodes), np.concatenate(ends), np.concatenate(keys))
        place_of = np.repeat(np.concatenate(places), counts)
        starts = np.cumsum(lengths) - lengths
        per_text = np.add.reduceat(counts, starts)
        begin = np.cumsum(per_text) - per_text
        arcs = np.insert(walked, begin, new)
        place_of = np.insert(place_of, begin, [p[0] for p in places])
        own = per_text + 1
        head = np.cumsum(own) - own
        who = np.repeat(np.arange(len(popped)), own)
        logp = lat.arc_logp[arcs]
        before = sums_before(logp, head[who]) + np.array(prefix)[who]
        mass = before + _others(logp)
        for j, (t, *_) in enumerate(popped):
            rest = 1.0 - float(np.exp(lat.arc_logp[list(bans[t])]).sum())
            node = lat.arc_node[new[j]]
            open_arcs = lat.arc_start[node + 1] - lat.arc_start[node] > len(bans[t])
            mass[head[j]] = prefix[j] + np.log(rest) if open_arcs and rest > 1e-15 else -np.inf
        texts = np.array([p[0] for p in popped])
        noise = unit_interval(mixed(mixed(stream[texts])[who] ^ (np.arange(len(arcs)) - head[who]).astype(np.uint64) * _STEP))
        bounds = cut_gumbel(mass, np.array(tops)[who], noise)
        offsets = np.zeros(n + 1, dtype=np.int64)
        offsets[texts + 1] = own
        out = _Sets(arcs, np.cumsum(offsets), before, bounds, parents, cuts, bans)
        out.place = place_of
        tail = head + own - 1
        out.total = dict(zip(texts.tolist(), (before[tail] + logp[tail]).tolist(), strict=True))
        return out


def _encode(tokenizer: str, k: int, alpha: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer, alpha)
        sampler = Sampler(vocab, k)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts, ids = part.column("text").to_pylist(), part.column("key").to_pylist()
                at, rank, lists, logp, inclusion, spell = [], [], [], [], [], []
                for i, found in enumerate(sampler.sample(texts, row_keys(ids, seed))):
                    text = (" " + texts[i].replace(MARK, " ")).encode("utf-8", "surrogatepass") if texts[i] else b""
                    for r, (own, lp, q) in enumerate(found):
                        at.append(i)
                        rank.append(r + 1)
                        lists.append(own)
                        logp.append(lp)
                        inclusion.append(q)
                        spell.append(text)
                ends = np.cumsum([0] + [len(x) for x in lists])
                values = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, dtype=np.int32)
                same = vocab.decodes_to(values, ends, spell)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(at, pa.int64())),
                        pa.array(rank, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                        pa.array(logp, pa.float64()),
                        pa.array(inclusion, pa.float64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "sample", "ids", "log_prob", "inclusion", "round_trip"],
                )

    return run


def encode(
    docs: DataFrame,
    k: int = SAMPLES,
    alpha: float = ALPHA,
    seed: int = SEED,
    tokenizer: str = TOKENIZER,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, sample (1 to k), ids, log_prob, inclusion and round_trip (ids decode to the text)."""
    if k < 1:
        raise ValueError("at least one sample")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), text_of(F.col(text_col)).alias("text")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        _encode(tokenizer, k, alpha, seed),
        f"doc_id {kind}, sample int, ids array<int>, log_prob double, inclusion double, round_trip boolean",
    )


def _decode(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer, ALPHA)
        for batch in batches:
            texts = [
                None if not x.is_valid else vocab.decode(np.array(x.as_py(), dtype=np.int64))[1:].decode("utf-8", "replace")
                for x in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sample"), pa.array(texts, pa.string())], ["doc_id", "sample", "text"]
            )

    return run


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, sample and text of rows with ids; null ids decode to null, no ids to the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "sample", "ids").mapInArrow(
        _decode(tokenizer), f"doc_id {kind}, sample int, text string"
    )
