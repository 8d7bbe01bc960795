"""Hamming distances of many fingerprints at once, on bit planes.

A block holds 64 fingerprints. Plane p of a block is one 64-bit word: bit p of each of them. A query
meets a block by XOR of every plane with its own bit (all ones or all zeros), which gives one word of
differences per plane; carry-save adders count these words vertically, 64 distances in a few words.
"""

from __future__ import annotations

import numpy as np

LANES = 64
GROUP = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


def planes(words: np.ndarray) -> np.ndarray:
    """Fingerprints ``[n, w]`` of w 64-bit words → bit planes ``[ceil(n / 64), 64 * w]``."""
    n, w = words.shape
    blocks = -(-n // LANES)
    padded = np.zeros((blocks * LANES, w), np.uint64)
    padded[:n] = words
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little").reshape(blocks, LANES, 64 * w)
    packed = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(blocks, 64 * w)


def _add(a, b, c):
    """Full adder on words: sum and carry of three words, lane by lane."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds ``radius``."""
    greater = np.zeros_like(counter[0])
    equal = np.full_like(counter[0], ALL)
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counter[i]
        else:
            greater |= equal & counter[i]
            equal &= ~counter[i]
    return greater


def within(stored: np.ndarray, words: np.ndarray, rows: np.ndarray, blocks: np.ndarray, masks: np.ndarray,
           radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``(rows[i], blocks[i])`` have lanes of ``masks[i]`` at distance ``radius`` or less.

    Returns positions into ``rows`` and the words of such lanes. After each group of eight planes,
    blocks in which every wanted lane is already beyond the radius are abandoned.
    """
    total = stored.shape[1]
    high = max(1, total.bit_length() - 3)
    at = np.flatnonzero(masks)
    alive = masks[at]
    zero = lambda: np.zeros(len(at), np.uint64)
    ones, twos, fours, eights = zero(), zero(), zero(), [zero() for _ in range(high)]
    for first in range(0, total, GROUP):
        if not len(at):
            break
        word, shift = first // 64, np.arange(first % 64, first % 64 + GROUP, dtype=np.uint64)
        own = np.uint64(0) - ((words[rows[at], word][:, None] >> shift) & ONE)
        d = stored[blocks[at], first:first + GROUP] ^ own
        ones, a = _add(ones, d[:, 0], d[:, 1])
        ones, b = _add(ones, d[:, 2], d[:, 3])
        twos, e = _add(twos, a, b)
        ones, a = _add(ones, d[:, 4], d[:, 5])
        ones, b = _add(ones, d[:, 6], d[:, 7])
        twos, f = _add(twos, a, b)
        fours, carry = _add(fours, e, f)
        for i in range(high):
            eights[i], carry = eights[i] ^ carry, eights[i] & carry
        alive = alive & ~_beyond([ones, twos, fours, *eights], radius)
        stay = alive != 0
        if not stay.all():
            at, alive, ones, twos, fours = at[stay], alive[stay], ones[stay], twos[stay], fours[stay]
            eights = [x[stay] for x in eights]
    return at, alive


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of ``a[i]`` and ``b[i]``; ``label`` holds each element's smallest member seen."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(above := label[label], label):
            label[:] = above


def forest(words: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``radius`` in each run of equal ``run`` values (sorted rows).

    Compares every row with all later rows of its run, block by block, and returns at most one link
    per row: (row, smallest row of its set). The sets are exact; pairs are never listed.
    """
    n = len(run)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    end = np.searchsorted(run, run, side="right")
    stored = planes(words)
    index = np.arange(n)
    offset = 0
    while True:
        rows = index[end > np.maximum(index + 1, (index // LANES + offset) * LANES)]
        if not len(rows):
            break
        blocks = rows // LANES + offset
        low = np.maximum(rows + 1 - blocks * LANES, 0).astype(np.uint64)
        count = np.minimum(end[rows] - blocks * LANES, LANES)
        masks = np.where(low < LANES, ALL << np.minimum(low, np.uint64(63)), np.uint64(0))
        masks &= np.where(count < LANES, (ONE << count.astype(np.uint64) % np.uint64(64)) - ONE, ALL)
        hit, lanes = within(stored, words, rows, blocks, masks, radius)
        if len(hit):
            bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), bitorder="little").reshape(-1, LANES)
            r, lane = np.nonzero(bits)
            merge(label, rows[hit[r]], blocks[hit[r]] * LANES + lane)
        offset += 1
    linked = np.flatnonzero(label != index)
    return linked, label[linked]
