"""Lines and sentences of texts as hashed messages, whole Arrow batches at a time.

Texts are handled as bytes: places of line ends, sentence ends and words come from
comparisons of whole arrays, and a word's or message's hash from prefix sums of a
polynomial, so no text is looked at word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: the part of a message that is a whole line
WHOLE = -1
#: a word with a digit stands for any other
VARIABLE = b"<*>"

#: sentence ends that need no space behind them, in UTF-8
_WIDE_ENDS = ((0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F))
_BYTE_BASE, _WORD_BASE, _OTHER_BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


# kinds of bytes by comparisons of whole arrays: a look-up table takes several times as long


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)


def _digit(data: np.ndarray) -> np.ndarray:
    return data - np.uint8(48) < 10


def _ends(data: np.ndarray) -> np.ndarray:
    return (data == 46) | (data == 33) | (data == 63)  # . ! ?


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: powers are products of one below BLOCK and one of whole blocks, so no table grows with the texts
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


#: by base: its powers modulo 2^64 below BLOCK, and those of its inverse
_SMALL = {int(x): (_powers(int(x), BLOCK), _powers(_inverse(int(x)), BLOCK)) for x in (_BYTE_BASE, _WORD_BASE, _OTHER_BASE)}


def _raise(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """``values``, each times the power of ``base`` of its place; in place."""
    small, blocks = _SMALL[int(base)][0], len(values) // BLOCK
    large = _powers(pow(int(base), BLOCK, 1 << 64), blocks + 1)
    whole, rest = values[: blocks * BLOCK].reshape(-1, BLOCK), values[blocks * BLOCK :]
    whole *= small
    whole *= large[:blocks, None]
    rest *= small[: len(rest)]
    rest *= large[blocks]
    return values


def _lower(sums: np.ndarray, base: np.uint64, at: np.ndarray) -> np.ndarray:
    """Sums from the places ``at`` on as they would be from place 0; in place."""
    large = _powers(_inverse(pow(int(base), BLOCK, 1 << 64)), int(at.max(initial=0)) // BLOCK + 1)
    sums *= _SMALL[int(base)][1][at & (BLOCK - 1)]
    sums *= large[at >> BLOCK_BITS]
    return sums


def _ranges(values: np.ndarray, base: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of ``values[lo:hi]`` for each range, the same wherever the range stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_raise(values + np.uint64(1), base), out=sums[1:])
    return _lower(sums[hi] - sums[lo], base, lo)


def _word_hashes(data: np.ndarray, inside: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``begin``; white space weighs nothing, so a word's sum may run up to the next word."""
    weights = data.astype(np.uint64)
    weights += np.uint64(1)
    weights *= inside
    sums = np.cumsum(_raise(weights, _BYTE_BASE), out=weights)[np.append(begin[1:], len(data)) - 1]
    hashes = _lower(np.diff(sums, prepend=np.uint64(0)), _BYTE_BASE, begin)
    return mix(hashes ^ (length.astype(np.uint64) << np.uint64(48)))


_VARIABLE_HASH = _word_hashes(np.frombuffer(VARIABLE, np.uint8), np.ones(len(VARIABLE), bool), np.array([0]), np.array([len(VARIABLE)]))


def _words(data: np.ndarray, space: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes; a word ends at white space and at ``breaks``."""
    inside = ~space
    starts = inside.copy()
    starts[1:] &= space[:-1]
    ends = inside.copy()
    ends[:-1] &= space[1:]
    within = breaks[(breaks > 0) & (breaks < len(data))]
    starts[within] |= inside[within]
    ends[within - 1] |= inside[within - 1]
    begin = np.flatnonzero(starts)
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    length = np.flatnonzero(ends) + 1 - begin
    hashes = _word_hashes(data, inside, begin, length)
    hashes[np.searchsorted(begin, np.flatnonzero(_digit(data)), side="right") - 1] = _VARIABLE_HASH
    return begin, hashes


@dataclass
class Messages:
    """Arrays of one length, a place for each message; ``tokens[lo:hi]`` are a message's."""

    text: np.ndarray
    pos: np.ndarray
    part: np.ndarray
    at: np.ndarray  # -1: a line of several sentences
    lo: np.ndarray
    hi: np.ndarray
    a: np.ndarray
    b: np.ndarray
    leaf: np.ndarray
    tokens: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return self.hi - self.lo


def _described(tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray, leading: int) -> tuple[np.ndarray, ...]:
    n = (hi - lo).astype(np.uint64)
    a = mix(_ranges(tokens, _WORD_BASE, lo, hi) ^ n)
    b = mix(_ranges(mix(tokens ^ _OTHER_BASE), _OTHER_BASE, lo, hi) + n)
    leaf = n * _WORD_BASE
    padded = np.concatenate((tokens, np.zeros(leading + 1, np.uint64)))
    for k in range(leading):
        leaf = mix(leaf ^ np.where(lo + k < hi, padded[lo + k], np.uint64(k)))
    return a, b, leaf


def _on_end(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts with line ends between them, and where each text begins."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    data = np.frombuffer(pc.binary_join(whole, pa.scalar("\n", texts.type))[0].as_buffer(), np.uint8)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return data, np.cumsum(sizes) - sizes


def messages(texts: pa.Array, least_tokens: int, leading: int) -> Messages:
    """The messages of some texts (no nulls): sentences that are not blank, and lines of several sentences.

    A line of one sentence is that sentence, with ``part`` WHOLE.  ``at`` counts the
    sentences of a text; lines of several have none and at least ``least_tokens`` words.
    """
    data, text_begin = _on_end(texts)
    space = _space(data)
    line_ends = np.flatnonzero(data == 10)
    line = np.concatenate(([0], line_ends + 1))
    first_line = np.searchsorted(line, text_begin)
    line_text = np.repeat(np.arange(len(texts)), np.diff(np.append(first_line, len(line))))
    line_pos = np.arange(len(line)) - first_line[line_text]

    ends = np.flatnonzero(_ends(data[:-1])) + 1
    cuts = ends[(data[ends] == 32) | (data[ends] == 9)]
    wide = np.zeros(0, np.int64)
    if len(data) > 3 and (data >= 0xE3).any():
        for x, y, z in _WIDE_ENDS:
            found = np.flatnonzero(data[:-3] == x)
            found = found[(data[found + 1] == y) & (data[found + 2] == z) & (data[found + 3] != 10)] + 3
            wide = np.concatenate((wide, found))
        cuts = np.concatenate((cuts, wide))
    unit = np.sort(np.concatenate((line, cuts)))
    unit_line = np.searchsorted(line, unit, side="right") - 1
    first_unit = np.searchsorted(unit, line)
    units_of = np.diff(np.append(first_unit, len(unit)))

    begin, tokens = _words(data, space, unit)
    lo = np.searchsorted(begin, unit)
    hi = np.append(lo[1:], len(begin))
    keep = np.flatnonzero(hi > lo)
    of = unit_line[keep]
    part = np.where(units_of[of] == 1, WHOLE, keep - first_unit[of])
    text = line_text[of]
    at = np.arange(len(keep)) - np.searchsorted(text, np.arange(len(texts)))[text]
    sentences = (text, line_pos[of], part, at, lo[keep], hi[keep])

    several = np.flatnonzero(units_of > 1)
    line_lo, line_hi = np.searchsorted(begin, line), np.searchsorted(begin, np.append(line[1:], len(data) + 1))
    if len(wide):
        # such ends part words of a sentence but not of its line
        more_begin, more = _words(data, space, line)
        line_lo = np.searchsorted(more_begin, line) + len(tokens)
        line_hi = np.searchsorted(more_begin, np.append(line[1:], len(data) + 1)) + len(tokens)
        tokens = np.concatenate((tokens, more))
    several = several[line_hi[several] - line_lo[several] >= least_tokens]
    blank = np.full(len(several), -1)
    lines = (line_text[several], line_pos[several], blank, blank, line_lo[several], line_hi[several])

    text, pos, part, at, lo, hi = (np.concatenate(x) for x in zip(sentences, lines))
    return Messages(text, pos, part, at, lo, hi, *_described(tokens, lo, hi, leading), tokens)


def template_tree(tokens: np.ndarray, same: float, constant: float) -> np.ndarray:
    """For lines of one leaf (rows of equal length) a number by template, from 1; 0 for lines that fit none.

    Lines that agree at ``constant`` of their places, each of these in ``same`` of the
    lines, share a template, which those have that agree at all of them.  The rest parts
    by the token at the place where most lines have one that others have too, though not all,
    and fewest such tokens occur; then again, until nothing parts.
    """
    found = np.zeros(len(tokens), np.int64)
    width, number = tokens.shape[1], 0
    pending = [np.arange(len(tokens))]
    while pending:
        rows = pending.pop()
        size = len(rows)
        if size < 2:
            continue
        node = tokens[rows]
        if size == 2:  # the two agree enough or not; nothing else can recur
            agree = int((node[0] == node[1]).sum())
            if agree and agree >= constant * width:
                number += 1
                found[rows] = number
            continue
        # runs of equal tokens, place by place
        flat = np.sort(node, axis=0).T.ravel()
        begins = np.concatenate(([True], flat[1:] != flat[:-1]))
        begins[::size] = True
        begin = np.flatnonzero(begins)
        counts, place = np.diff(np.append(begin, len(flat))), begin // size
        firsts = np.searchsorted(place, np.arange(width))
        most = np.maximum.reduceat(counts, firsts)
        some = (counts > 1) & (counts < size)
        fixed = most >= max(2, same * size)
        fits = np.zeros(size, bool)
        if fixed.any() and fixed.sum() >= constant * width:
            # at most one token can hold more than half of a place
            top = np.flatnonzero((counts == most[place]) & fixed[place])
            token = flat[begin[top[np.searchsorted(place[top], np.flatnonzero(fixed))]]]
            fits = (node[:, fixed] == token).all(axis=1)
            number += 1
            found[rows[fits]] = number
        if some.any() and not fits.all():
            of, kinds = np.bincount(place, counts * some, width).astype(np.int64), np.bincount(place, some, width).astype(np.int64)
            at = max(np.flatnonzero(kinds).tolist(), key=lambda k: (of[k], -kinds[k], -k))
            rest = rows[~fits]
            order = np.argsort(tokens[rest, at], kind="stable")
            pending += np.split(rest[order], np.flatnonzero(np.diff(tokens[rest[order], at])) + 1)
    return found
