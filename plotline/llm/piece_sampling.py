"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

A text is cut into units where no piece can cross: between characters that are neighbours in no piece,
such as before a space that follows a word. The library encodes each distinct unit, and the encoding of a
text is that of its units, one after the other; the library decodes whole texts. A unit's
lattice has an edge for every vocabulary piece that fits; an edge weighs (2 + rank) ** -alpha, as the
model's scores are ranks and no log-probabilities, and backward sums turn weights into the chance of
each edge given its start. The chance of a text's segmentation is the product over its edges.

Distinct segmentations come from a perturbed A-star search over subsets of them. The root, all
segmentations, gets a Gumbel draw for its maximum. The subset with the largest maximum is opened next:
a path of it is drawn in proportion to its chance and attains the maximum; what remains is split into
the paths that leave the known ones earlier, later or at the same place, each with a Gumbel draw for
its mass, truncated at the opened maximum. The k paths so found are a sample without replacement; with
the (k+1)-th maximum as threshold each has an inclusion score. Masses are sums over all levels at which
a path may be left. Draws are hashes of row key, seed and counters, so they depend on the row alone.
Cutting, lattices and walks run over all units of a block of rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from plotline.llm._text import arrow_pass, give_back, list_of, mix64
from plotline.llm._vocabulary import TOKENIZERS, broadcast_file

VOCABULARY = "piece_bpe_32k.model"
SAMPLES = 2
ALPHA = 1.0
#: Units whose lattices a worker keeps, characters of the rows that are sampled at once, and of units that are hashed at once.
KEPT_UNITS = 300_000
BLOCK_CHARS = 300_000
SLICE_CHARS = 1 << 18
#: Terms below this share (e ** -45) of a sum don't change it in double precision.
NOTHING = -45.0
#: Levels whose masses are summed before it is seen whether more weigh anything, and so many of these that are looked up at once.
_LEVELS, _STRIDES = 160, 3
_SPACE = "▁"
_BASE = 0x2545F4914F6CDD1D
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNKNOWN = -30.0


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix64(keys) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class _Column:
    """A growing flat array."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.empty(1 << 20, kind), 0

    def extend(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            grown = np.empty(max(end, 3 * len(self.room) // 2), self.room.dtype)
            grown[: self.size] = self.room[: self.size]
            self.room = grown
        self.room[self.size : end] = more
        self.size = end

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class _Hashed:
    """Places of 64-bit keys by their upper bits; keys that meet there go to the next table, by other bits."""

    BITS = 20

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables, left = keys, [], np.arange(len(keys))
        while len(left):
            at = self._slots(keys[left], len(self.tables))
            table = np.full(1 << self.BITS, -1, np.int32)
            table[at] = left
            self.tables.append(table)
            left = left[table[at] != left]

    def _slots(self, keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys * np.uint64(2 * table + 1)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        found = self.tables[0][self._slots(keys, 0)]
        # A key of a later table stands where the earlier ones have another.
        left = np.flatnonzero(found >= 0)
        left = left[self.keys[found[left]] != keys[left]]
        found[left] = -1
        for k, table in enumerate(self.tables[1:], 1):
            at = table[self._slots(keys[left], k)]
            met = at >= 0
            left, at = left[met], at[met]
            hit = self.keys[at] == keys[left]
            found[left[hit]] = at[hit]
            left = left[~hit]
        return found


class Lattices:
    """The model, and the lattices of the units seen so far, as flat arrays of nodes and edges.

    A node is a position in a unit; its edges lie together, the longest piece first. An edge has its
    target (-1 at the unit's end), its piece (or minus the code point of a character without one), its
    log chance, the log chance of its node's other edges, and the chance of its node's edges up to it.
    """

    def __init__(self, model: bytes, alpha: float) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.processor.vocab_size()
        known = [i for i in range(n) if not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i))]
        pieces = [self.processor.id_to_piece(i) for i in known]
        self.bytes = np.array([self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.longest = max(map(len, pieces))
        # Neighbouring characters of any piece, as a table over those characters; where others meet no piece crosses.
        pairs = np.array(sorted({(ord(a), ord(b)) for p in pieces for a, b in zip(p, p[1:])}), np.int64).reshape(-1, 2)
        chars = np.unique(pairs)
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[chars] = np.arange(1, len(chars) + 1)
        self.pairs = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.pairs[self.classes[pairs[:, 0]], self.classes[pairs[:, 1]]] = True
        self.weights = np.array([-alpha * np.log(2.0 + min(-self.processor.get_score(i), float(n))) for i in known])
        self.numbers = np.array(known, np.int32)
        self._powers(1 << 12)
        codes, lengths = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32), np.array([len(p) for p in pieces])
        starts = np.cumsum(lengths) - lengths
        self._powers(len(codes) + 1)
        self.pieces = _Hashed(self._hashes(self._sums(codes), starts, starts + lengths))
        kinds = {
            "roots": np.int64, "first": np.int32, "targets": np.int32, "ids": np.int32, "logs": np.float64, "rest": np.float64, "upto": np.float64,
            "best": np.int32, "best_ends": np.int64,
        }
        self.columns = {name: _Column(kind) for name, kind in kinds.items()}
        self.clear()

    def clear(self) -> None:
        """Forget all units; their room stays."""
        for column in self.columns.values():
            column.size = 0
        self.keys, self.places, self.hits = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self._extend({})

    def forget(self) -> None:
        """Forget units that were met once since the last time, or all where more than half of them were met again."""
        kept = np.flatnonzero(self.hits > 1)
        if 2 * len(kept) > len(self.hits):
            return self.clear()
        nodes, edges, pieces = np.append(self.roots, len(self.first)), np.append(self.first, len(self.ids)).astype(np.int64), np.append(0, self.best_ends)
        edges = edges[nodes]
        sizes = lambda bounds: np.diff(bounds)[kept]
        moved = lambda bounds: np.cumsum(sizes(bounds)) - sizes(bounds) - bounds[kept]
        at = lambda bounds: np.arange(int(sizes(bounds).sum())) - np.repeat(moved(bounds), sizes(bounds))
        node, edge = at(nodes), at(edges)
        targets = self.targets[edge]
        left = {
            "roots": self.roots[kept] + moved(nodes), "first": self.first[node] + np.repeat(moved(edges), sizes(nodes)),
            "targets": np.where(targets < 0, -1, targets + np.repeat(moved(nodes), sizes(edges))), "ids": self.ids[edge], "logs": self.logs[edge],
            "rest": self.rest[edge], "upto": self.upto[edge], "best": self.best[at(pieces)], "best_ends": np.cumsum(sizes(pieces)),
        }
        numbers = np.full(len(self.hits), -1, np.int32)
        numbers[kept] = np.arange(len(kept))
        keys, places = self.keys, numbers[self.places]
        self.clear()
        self.keys, self.places, self.hits = keys[places >= 0], places[places >= 0], np.zeros(len(kept), np.int32)
        self._extend(left)

    def _extend(self, more: dict[str, np.ndarray]) -> None:
        for name, values in more.items():
            self.columns[name].extend(values)
        self.roots, self.first, self.targets, self.ids, self.logs, self.rest, self.upto, self.best, self.best_ends = (c.values for c in self.columns.values())

    def _powers(self, n: int) -> None:
        """Powers of the hash's base and of its inverse, n of each at least."""
        if n > len(getattr(self, "up", ())):
            self.up = np.cumprod(np.full(n, _BASE, np.uint64))
            self.down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix64(codes) * self.up[: len(codes)], out=sums[1:])
        return sums

    def _hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the strings between positions, wherever they stand."""
        return (sums[ends] - sums[starts]) * self.down[starts]

    def units_of(self, texts: list[str]) -> list[np.ndarray]:
        """The units of each text, by number; lattices that are missing are built."""
        shown = [_SPACE + t.replace(" ", _SPACE) if t else "" for t in texts]
        joined = "".join(shown)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, shown), np.int64, len(shown))
        text_ends = np.cumsum(lengths)
        kinds = self.classes[codes]
        begins = np.ones(len(codes) + 1, bool)
        begins[1:-1] = ~self.pairs[kinds[:-1], kinds[1:]]
        begins[text_ends] = True
        begins[text_ends - lengths] = True
        bounds = np.flatnonzero(begins)
        units = np.empty(len(bounds) - 1, np.int32)
        low = 0
        while low < len(units):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SLICE_CHARS, "right")) - 1)
            part = slice(bounds[low], bounds[high])
            units[low:high] = self._numbers(joined[part], codes[part], bounds[low : high + 1] - bounds[low])
            low = high
        cuts = np.searchsorted(bounds, text_ends)
        return np.split(units, cuts[:-1]) if len(texts) else []

    def _numbers(self, text: str, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        self._powers(len(codes) + 1)
        sums = self._sums(codes)
        keys = mix64(self._hashes(sums, bounds[:-1], bounds[1:]) + np.diff(bounds).astype(np.uint64))
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(slot, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            numbers = np.arange(len(self.roots), len(self.roots) + len(new), dtype=np.int32)
            starts, ends = bounds[at[new]], bounds[at[new] + 1]
            self._encode([text[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
            self._build(codes, sums, starts, ends)
            self.keys, self.places = np.insert(self.keys, slot[new], keys[new]), np.insert(self.places, slot[new], numbers)
            self.hits = np.append(self.hits, np.zeros(len(new), np.int32))
            slot = np.searchsorted(self.keys, keys)
        places = self.places[slot]
        self.hits[places] += 1
        return places[back]

    def _encode(self, units: list[str]) -> None:
        """Encodings of units; the library puts a space before a text, so other units follow a line break, which is cut off."""
        own = [u[0] == _SPACE and u.strip(_SPACE) != "" for u in units]
        ids = self.processor.encode([u[1:] if o else "\n" + u for u, o in zip(units, own, strict=True)], num_threads=1)
        ids = [x if o else x[2:] for x, o in zip(ids, own, strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self._extend({"best": np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), "best_ends": len(self.best) + np.cumsum(counts)})

    def encoded(self, units: np.ndarray) -> np.ndarray:
        """Piece ids of units, one after the other."""
        return self.encoded_texts([units])[0]

    def encoded_texts(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of each text's units."""
        if not texts:
            return []
        units = np.concatenate(texts)
        starts = np.where(units > 0, self.best_ends[units - 1], 0)
        counts = self.best_ends[units] - starts
        ends = np.cumsum(counts)
        ids = self.best[np.arange(int(counts.sum())) + np.repeat(starts - ends + counts, counts)]
        return np.split(ids, np.append(0, ends)[np.cumsum([len(t) for t in texts])][:-1])

    def _build(self, codes: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Lattices of the units between the given positions of a text."""
        lengths = ends - starts
        roots = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        place = np.arange(total) + np.repeat(starts - roots, lengths)
        rest = np.repeat(roots + lengths, lengths) - np.arange(total)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        counts = np.zeros(total, np.int64)
        lone = np.ones(total, bool)
        node = np.arange(total)
        for span in range(1, min(self.longest, int(rest.max())) + 1):
            # The nodes that have so many characters before them in their unit.
            node = node[rest[node] >= span]
            at = place[node]
            piece = self.pieces.find((sums[at + span] - sums[at]) * self.down[at])
            hit = piece >= 0
            mine = node[hit]
            found.append((span, mine, piece[hit]))
            counts[mine] += 1
            if span == 1:
                lone[mine] = False
        counts[lone] += 1
        first = np.cumsum(counts) - counts
        edges = int(counts.sum())
        owner, spans, ids, weight = np.repeat(np.arange(total), counts), np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        filled = first.copy()
        for span, mine, piece in reversed(found):
            at = filled[mine]
            spans[at], ids[at], weight[at] = span, self.numbers[piece], self.weights[piece]
            filled[mine] += 1
        at = filled[lone]
        spans[at], ids[at], weight[at] = 1, -codes[place[lone]].astype(np.int32), _UNKNOWN
        # Log mass of what follows each position, from the units' ends backwards.
        mass, left = np.zeros(total + 1), rest[owner]
        by_rest = np.argsort(rest.astype(np.uint16) if rest.max() < 1 << 16 else rest, kind="stable")
        many = counts[by_rest]
        ends_by_rest = np.cumsum(many)
        order = np.arange(edges) + np.repeat(first[by_rest] - ends_by_rest + many, many)
        target = np.where(spans == left, total, owner + spans)
        by_target, by_weight, heads = target[order], weight[order], ends_by_rest - many
        cuts = np.flatnonzero(np.diff(rest[by_rest], prepend=-1, append=-1))
        bounds = np.append(heads, edges)[cuts]
        for low, high, a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mass[by_rest[a:b]] = np.logaddexp.reduceat(by_weight[low:high] + mass[by_target[low:high]], heads[a:b] - low)
        logs = weight + mass[target] - mass[owner]
        # Summed node by node, so that a unit's sums don't depend on the units that are built with it.
        upto, other, widest = np.exp(logs), np.full(edges, -np.inf), int(counts.max())
        # The edges that have so many of their node before them.
        later, node = [first], np.arange(total)
        for k in range(1, widest):
            node = node[counts[node] > k]
            later.append(first[node] + k)
        for k in range(1, widest):
            edge = later[k]
            upto[edge] += upto[edge - 1]
            other[edge] = np.logaddexp(other[edge - 1], logs[edge - 1]) if k > 1 else logs[edge - 1]
        behind = np.full(edges, -np.inf)
        for k in range(widest - 1, 0, -1):
            edge = later[k] - 1
            behind[edge] = np.logaddexp(behind[edge + 1], logs[edge + 1])
        upto[first + counts - 1] = 2.0
        base = len(self.first)
        self._extend({
            "roots": base + roots, "first": first + len(self.ids), "targets": np.where(spans == left, -1, base + owner + spans),
            "ids": ids, "logs": logs, "rest": np.logaddexp(other, behind), "upto": upto,
        })

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each node to its unit's end: all edges, and how many each path has."""
        owner = np.arange(len(nodes))
        at = nodes
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(nodes), np.int64)
        while len(owner):
            edge = self.first[at].astype(np.int64)
            # A node with one edge needs no draw.
            open_ = np.flatnonzero(self.upto[edge] < 2.0)
            draw = _uniform(keys[owner[open_]] + np.full(1, len(steps), np.uint64) * _GOLDEN)
            going = draw >= self.upto[edge[open_]]
            while going.any():
                open_, draw = open_[going], draw[going]
                edge[open_] += 1
                going = draw >= self.upto[edge[open_]]
            steps.append((owner, edge))
            counts[owner] += 1
            at = self.targets[edge]
            owner, at = owner[at >= 0], at[at >= 0]
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            out[starts[who] + k] = edge
        return out, counts

    def others(self, edge: int, taken: tuple[int, ...]) -> list[int]:
        """The edges of the node that an edge leaves, without it and those taken."""
        node = int(np.searchsorted(self.first, np.int32(edge), side="right")) - 1
        end = int(self.first[node + 1]) if node + 1 < len(self.first) else len(self.ids)
        return [e for e in range(int(self.first[node]), end) if e != edge and e not in taken]

    def spelled(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of each path; a character without a piece is spelled in bytes."""
        ids = self.ids[np.concatenate(paths)] if paths else np.empty(0, np.int32)
        ends = np.cumsum([len(p) for p in paths])
        alone = np.flatnonzero(ids < 0)
        if len(alone):
            codes = -ids[alone]
            widths = np.ones(len(ids), np.int64)
            widths[alone] = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            spelt = self.bytes[np.frombuffer(codes.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)]
            lone = np.zeros(len(ids), bool)
            lone[alone] = True
            ids = np.repeat(ids, widths)
            ids[np.repeat(lone, widths)] = spelt
            ends = np.append(0, np.cumsum(widths))[ends]
        return np.split(ids, ends[:-1]) if paths else []


class _Path:
    """A segmentation of one text: its edges, the unit of each, and the log chances up to each level."""

    def __init__(self, lattices: Lattices, edges: np.ndarray, units: np.ndarray, value: float) -> None:
        self.edges, self.units, self.value = edges, units, value
        self.before = np.zeros(len(edges) + 1)
        np.cumsum(lattices.logs[edges], out=self.before[1:])

    @property
    def log_p(self) -> float:
        return float(self.before[-1])


@dataclass
class _Subset:
    """The segmentations that leave ``path`` at a level from low to high, exclusive.

    ``sums`` are running sums of the levels' masses, relative to e ** scale. ``taken`` are edges of the
    level low that are in other subsets, besides the path's own.
    """

    path: _Path
    low: int
    taken: tuple[int, ...]
    sums: np.ndarray
    scale: float
    value: float = 0.0


def _subset(lattices: Lattices, path: _Path, low: int, high: int, taken: tuple[int, ...] = ()) -> _Subset | None:
    """The subset with its masses; None where it has no segmentation."""
    parts, upto, scale = [], 0.0, None
    for begin in range(low, high, _STRIDES * _LEVELS):
        stop = min(high, begin + _STRIDES * _LEVELS)
        all_logs = path.before[begin:stop] + lattices.rest[path.edges[begin:stop]]
        if taken and begin == low:
            left = lattices.others(int(path.edges[low]), taken)
            all_logs[0] = path.before[low] + (np.logaddexp.reduce(lattices.logs[left]) if left else -np.inf)
        chances = None if scale is None else np.exp(all_logs - scale)
        for at in range(begin, stop, _LEVELS):
            end = min(stop, at + _LEVELS)
            if scale is None:
                if (most := float(all_logs[at - begin : end - begin].max())) == -np.inf:
                    parts.append(np.zeros(end - at))
                    continue
                scale = most
                chances = np.exp(all_logs - scale)
            parts.append(upto + chances[at - begin : end - begin].cumsum())
            upto = float(parts[-1][-1])
            if upto and path.before[end] - scale < NOTHING + math.log(upto):  # all that is left weighs no more than this
                return _Subset(path, low, taken, np.concatenate(parts), scale)
    return None if not upto else _Subset(path, low, taken, np.concatenate(parts), scale)


class _Search:
    """The search of one row: its open subsets and its paths, best first."""

    def __init__(self, lattices: Lattices, units: np.ndarray, key: np.uint64, draws: list[float]) -> None:
        self.lattices, self.units, self.key, self.draws = lattices, units, key, iter(draws)
        self.open: list[_Subset] = []
        self.found: list[_Path] = []

    def _gumbel(self) -> float:
        return -math.log(-math.log(next(self.draws)))

    def _add(self, value: float, subsets: list[_Subset | None]) -> None:
        for s in subsets:
            if s is not None:
                s.value = -float(np.logaddexp(-value, -(s.scale + math.log(s.sums[-1]) + self._gumbel())))
                self.open.append(s)

    def start(self) -> tuple:
        return self._gumbel(), None, 0, -1, -1

    def next(self) -> tuple | None:
        """Take the best subset and draw where it leaves its path: value, subset, level, edge, its target."""
        if not self.open:
            return None
        s = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i].value))
        u, v = next(self.draws), next(self.draws)
        level = s.low + min(len(s.sums) - 1, int(np.searchsorted(s.sums, u * s.sums[-1], "right")))
        left = self.lattices.others(int(s.path.edges[level]), s.taken if level == s.low else ())
        logs = self.lattices.logs[left]
        chances = np.cumsum(np.exp(logs - logs.max()))
        edge = left[min(len(left) - 1, int(np.searchsorted(chances, v * chances[-1], "right")))]
        return s.value, s, level, edge, int(self.lattices.targets[edge])

    def close(self, step: tuple, edges: np.ndarray, units: np.ndarray) -> None:
        """Take in the path that was walked from a step, and split what remains of its subset."""
        value, s, level, edge, _ = step
        lattices = self.lattices
        if s is None:
            path = _Path(lattices, edges, units, value)
            self.found.append(path)
            self._add(value, [_subset(lattices, path, 0, len(edges))])
            return
        parent, high = s.path, s.low + len(s.sums)
        path = _Path(lattices, np.concatenate([parent.edges[:level], [edge], edges]), np.concatenate([parent.units[: level + 1], units]), value)
        self.found.append(path)
        taken = (*(s.taken if level == s.low else ()), edge)
        self._add(value, [
            _subset(lattices, parent, s.low, level, s.taken), _subset(lattices, parent, level, level + 1, taken),
            _subset(lattices, parent, level + 1, high), _subset(lattices, path, level + 1, len(path.edges)),
        ])


def sample_rows(lattices: Lattices, units: list[np.ndarray], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each row up to k distinct (edges, log chance, perturbed value, log inclusion score), best first.

    ``units`` has the numbers of a row's units, ``keys`` a hash of its key.
    """
    # A row's first path takes two draws, each further one up to six.
    numbers = np.arange(1, 6 * k + 3, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    draws = _uniform((keys[:, None] + numbers).ravel()).reshape(len(keys), -1).tolist()
    searches = [_Search(lattices, u, key, d) for u, key, d in zip(units, keys, draws, strict=True)]
    going = [s for s in searches if len(s.units)]
    for rank in range(k):
        steps = [(s, step) for s in going if (step := s.next() if rank else s.start()) is not None]
        if not steps:
            break
        # Each walk goes through the rest of the unit it begins in, if any, and through all later units.
        nodes, numbers = [], []
        for s, (_, subset, level, _, target) in steps:
            unit = int(subset.path.units[level]) if subset else -1
            nodes.append(np.concatenate([[target] if target >= 0 else [], lattices.roots[s.units[unit + 1 :]]]).astype(np.int64))
            numbers.append(np.arange(unit + (target < 0), len(s.units)))
        sizes = np.array([len(n) for n in nodes])
        number = np.concatenate(numbers)
        row_keys = np.repeat(np.array([s.key for s, _ in steps], np.uint64), sizes)
        walk_keys = mix64(row_keys + (number.astype(np.uint64) * np.uint64(64) + np.uint64(rank)) * np.uint64(0xA24BAED4963EE407))
        edges, counts = lattices.walk(np.concatenate(nodes), walk_keys)
        unit_of = np.repeat(number, counts)
        ends = np.append(0, np.cumsum(counts))[np.cumsum(sizes)]
        begin = 0
        for (s, step), end in zip(steps, ends, strict=True):
            s.close(step, edges[begin:end], unit_of[begin:end])
            begin = end
        going = [s for s, _ in steps]
    out = []
    for s in searches:
        threshold, rows = max((x.value for x in s.open), default=-np.inf), []
        for p in s.found:
            gap = p.log_p - threshold
            inclusion = 0.0 if gap > 30 else float(gap) if gap < -30 else float(np.log(-np.expm1(-np.exp(gap))))
            rows.append((p.edges, p.log_p, p.value, inclusion))
        out.append(rows)
    return out


_built: dict[tuple[int, float], Lattices] = {}


def lattices_of(file: Broadcast, alpha: float) -> Lattices:
    key = (hash(file.value), alpha)
    if key not in _built:
        _built[key] = Lattices(file.value, alpha)
    return _built[key]


SCHEMA = (
    "doc_id long, ids array<int>, round_trip boolean, "
    "samples array<struct<ids:array<int>,log_p:double,value:double,log_inclusion:double>>"
)


def encode(df: DataFrame, id_col: str, text_col: str, samples: int = SAMPLES, seed: int = 0, alpha: float = ALPHA, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``doc_id, ids, round_trip, samples``: the encoding of every whole text and sampled segmentations.

    ``round_trip`` tells whether decoding the whole of ``ids`` gives the text. ``samples`` has up to ``samples`` distinct
    segmentations, fewer where the text has fewer. A null or empty text has no ids and no samples. Repeated
    rows get the same samples, as draws depend on id and seed alone; null ids share one key. An empty table
    gives an empty result. Other columns are ignored.
    """
    file = broadcast_file(df.sparkSession.sparkContext, VOCABULARY, tokenizers)
    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows(doc_ids: pa.Array, texts: list[str], lattices: Lattices) -> pa.RecordBatch:
        keys = np.array([xxh3_64_intdigest(f"{seed}:{d}".encode()) for d in doc_ids.to_pylist()], np.uint64)
        if len(lattices.roots) > KEPT_UNITS:
            lattices.forget()
        units = lattices.units_of(texts)
        ids = lattices.encoded_texts(units)
        back = [(lattices.processor.decode(i.tolist(), num_threads=1) if len(i) else "") == t for i, t in zip(ids, texts, strict=True)]
        drawn = sample_rows(lattices, units, keys, samples)
        flat = [s for found in drawn for s in found]
        items = pa.StructArray.from_arrays(
            [list_of(lattices.spelled([s[0] for s in flat]), pa.int32()), *(pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3))],
            names=["ids", "log_p", "value", "log_inclusion"],
        )
        offsets = np.concatenate([[0], np.cumsum([len(found) for found in drawn])]).astype(np.int32)
        return pa.record_batch([doc_ids, list_of(ids, pa.int32()), pa.array(back, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["doc_id", "ids", "round_trip", "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(file, alpha)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # blocks of bounded size, each given back before the next
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and (not texts or size < BLOCK_CHARS):
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1]) + 1
                yield rows(batch.column(0).slice(at, len(texts)), texts, lattices)
                at += len(texts)
        give_back()

    return picked.mapInArrow(run, SCHEMA)


def decode(df: DataFrame, ids_col: str, text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``df`` with the text of ``ids_col`` as ``text_col``; null ids give a null text."""
    file = broadcast_file(df.sparkSession.sparkContext, VOCABULARY, tokenizers)
    kept = df.drop(text_col)
    at = kept.columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        processor = lattices_of(file, ALPHA).processor
        texts = [None if ids is None else processor.decode(ids) if ids else "" for ids in batch.column(at).to_pylist()]
        return pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return arrow_pass(kept, run, kept.select("*", F.lit("").cast("string").alias(text_col)).schema)


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, encoded, decoded and sampled."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return found.withColumn("n_tokens", F.size("ids").cast("long"))
