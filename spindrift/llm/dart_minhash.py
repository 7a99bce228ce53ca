"""Word shingles as hashes, and DartMinHash signatures of weighted sets.

DartMinHash throws darts at the plane of (weight, rank) of every element, the same darts for the same element wherever it
occurs. A set keeps the darts under its elements' weights. Each dart also hits one of k coordinates, and the kept dart of
lowest rank in each coordinate is the signature there: two sets agree in a coordinate with the probability of their
weighted Jaccard similarity. Darts are made in cells of the plane, from rank 0 upwards, only as far as every coordinate is
hit, which takes about k log k darts for a set of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

U = np.uint64
SHINGLE_WORDS = 5
#: Bytes of text whose words are hashed at once.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_is_word = (_lower >= 0x80) | ((_lower >= 0x30) & (_lower <= 0x39)) | ((_lower >= 0x61) & (_lower <= 0x7A))
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased; all else is 0.
WORD_BYTES = np.where(_is_word, _lower, 0).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, U(0x100000001B3), dtype=U)
    p[0] = 1
    return np.multiply.accumulate(p)


_COEFFICIENTS = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=U) * U(_BASE)) | U(1)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, in order. Blocks end between words."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        while end < n and WORD_BYTES[raw[end - 1]] and WORD_BYTES[raw[end]]:
            step = WORD_BYTES[raw[end : end + BLOCK_BYTES]] == 0
            end = end + int(step.argmax()) if step.any() else min(n, end + BLOCK_BYTES)
        b = WORD_BYTES[raw[at:end]]
        at = end
        where = np.flatnonzero(b)
        if not len(where):
            continue
        first = np.flatnonzero(np.diff(where, prepend=-2) != 1)
        lengths = np.diff(first, append=len(where))
        inside = np.arange(len(where)) - np.repeat(first, lengths)
        values = (b[where].astype(U) + U(1)) * _powers(int(lengths.max()))[inside]
        out.append(mix(np.add.reduceat(values, first) + lengths.astype(U) * U(_BASE)))
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def shingles(raw: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE_WORDS`` words; a text of fewer words, but not none, is one shingle."""
    w = word_hashes(raw)
    if len(w) == 0:
        return w
    if len(w) < SHINGLE_WORDS:
        return mix((w * _COEFFICIENTS[: len(w)]).sum(keepdims=True, dtype=U) + U(len(w)))
    n = len(w) - SHINGLE_WORDS + 1
    total = np.zeros(n, dtype=U)
    for j in range(SHINGLE_WORDS):
        total += w[j : j + n] * _COEFFICIENTS[j]
    return mix(total)


#: Rank cells: [0, 2**-8), then doubling up to 1, then of width 1.
_FINEST = 8


def _cells(upto: float) -> int:
    """How many cells reach from rank 0 to ``upto``."""
    return _FINEST + math.ceil(upto) if upto > 1 else max(1, _FINEST + 1 + math.ceil(math.log2(upto)) if upto > 2.0**-_FINEST else 1)


def _edges(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of the cells first to last - 1."""
    c = np.arange(first, last)
    starts = np.where(c > _FINEST, c - float(_FINEST), np.where(c > 0, 2.0 ** (np.minimum(c, _FINEST) - 1 - _FINEST), 0.0))
    return starts, np.where(c > _FINEST, 1.0, np.where(c > 0, starts, 2.0**-_FINEST))


_MOST = 24


def _poisson_steps(mean: float) -> np.ndarray:
    p, total, out = math.exp(-mean), 0.0, []
    for i in range(1, _MOST):
        total += p
        out.append(min(total, 1.0))
        p *= mean / i
    return np.array(out)


#: By kind of cell (its number, all of width 1 alike): i + the steps of the distribution of its darts.
_STEPS = np.concatenate([i + _poisson_steps(w) for i, w in enumerate([2.0**-_FINEST, *(2.0**-j for j in range(_FINEST, 0, -1)), 1.0])])
_SALTS = mix(np.arange(1, 1 << 12, dtype=U) * U(_BASE))
_SCALE = 2.0**-32
#: Element-cells worked on at once.
_AT_ONCE = 1 << 18


def _darts(elements: np.ndarray, limit: np.ndarray | None, k: int, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranks, coordinates and names of all darts of the elements in cells first to last - 1."""
    starts, widths = _edges(first, last)
    salts = _SALTS[first:last] if last < len(_SALTS) else mix(np.arange(first + 1, last + 1, dtype=U) * U(_BASE))
    kind = np.minimum(np.arange(first, last), _FINEST + 1)
    step = max(1, _AT_ONCE // len(salts))
    for at in range(0, len(elements), step):
        block = elements[at : at + step]
        names = mix(block[:, None] ^ salts[None, :]).ravel()
        u = (names >> U(32)) * _SCALE
        count = np.searchsorted(_STEPS, (u.reshape(len(block), -1) + kind).ravel(), side="right") - np.tile(kind * (_MOST - 1), len(block))
        hit = np.flatnonzero(count)
        many = count[hit]
        owner = np.repeat(hit, many)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        darts = mix(names[owner] + (number + 1).astype(U) * U(0xD1342543DE82EF95))
        if limit is not None:
            keep = (mix(darts) >> U(32)) * _SCALE <= limit[at + owner // len(salts)]
            darts, owner = darts[keep], owner[keep]
        cell = owner % len(salts)
        yield starts[cell] + widths[cell] * ((darts >> U(32)) * _SCALE), (((darts & U(0xFFFFFFFF)) * U(k)) >> U(32)).astype(np.int64), darts


def signature(elements: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The k lowest darts (their 64-bit names) of a set of distinct element hashes, each of weight 1 unless given. Elements of
    no or negative weight are left out; a set without weight has no signature (an empty array)."""
    limit = None
    if weights is not None:
        elements, weights = elements[weights > 0], weights[weights > 0]
        rows = np.ceil(weights).astype(np.int64)  # strips of weight 1; darts above the weight in the last are dropped
        strip = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        limit = np.repeat(weights, rows) - strip
        elements = mix(np.repeat(elements, rows) + strip.astype(U) * U(_BASE))
    if not len(elements):
        return np.zeros(0, dtype=U)
    reach = k * (math.log(k) + 3) / float(len(elements) if weights is None else weights.sum())
    lowest, best, done = np.full(k, np.inf), np.zeros(k, dtype=U), 0
    while True:
        upto = max(_cells(reach), done + 1)
        for rank, place, darts in _darts(elements, limit, k, done, upto):
            order = np.argsort(-rank)
            place = place[order]
            first, name = np.full(k, np.inf), np.zeros(k, dtype=U)
            first[place], name[place] = rank[order], darts[order]  # the last written is the lowest
            better = first < lowest
            lowest[better], best[better] = first[better], name[better]
        done = upto
        low = float(sum(x[0] for x in _edges(upto - 1, upto)))
        if lowest.max() < low:
            return best
        reach = 1.5 * low


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` coordinates, different for different places."""
    parts = mix(sig).reshape(-1, rows)
    keys = np.arange(1, len(parts) + 1, dtype=U) * U(_BASE)
    for j in range(rows):
        keys = mix(keys + parts[:, j] * (U(2 * j) + U(3)))
    return keys


def texts_of(column) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text of an Arrow string column, without copies; None for null."""
    import pyarrow as pa

    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else None
