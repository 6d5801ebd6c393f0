"""Simple-8b: unsigned integers packed into 64-bit words, in numpy.

A word's low four bits select how many values of how many bits its other 60 bits hold. The two selectors
that the published scheme uses for runs are escapes here: a value of more than 60 bits takes a word with its
low 60 bits and one with the rest, which gives no value of its own. Values are packed in blocks; the word
at which each block begins is kept, so that any run of blocks can be decoded alone, all words at once.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: the number of values and the bits of each, by selector.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([60, 4, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
LOW, HIGH = 0, 1
#: Values in a block.
BLOCK = 256
BEYOND = np.uint8(65)
#: Bits of the numbers below 2**17, enough for the ids of most vocabularies.
SHORT = np.maximum(np.frexp(np.arange(1 << 17))[1], 1).astype(np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 for zero."""
    if values.max() < len(SHORT):
        return SHORT[values]
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)  # both halves are exact as floats
    bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]) if high.any() else np.frexp(low)[1]
    return np.maximum(bits, 1).astype(np.uint8)


def selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of a block (rows) the selector that takes the most values from there on."""
    blocks, size = bits.shape
    apart = np.full((blocks, size + COUNTS.max()), BEYOND, dtype=np.uint8)  # no word reaches over a block's end
    apart[:, :size] = bits
    bits, most = apart.reshape(-1), {1: apart.reshape(-1)}
    best = np.full(len(bits), LOW, dtype=np.uint8)
    for selector in range(len(COUNTS) - 1, HIGH, -1):
        count, width = int(COUNTS[selector]), np.uint8(WIDTHS[selector])
        half = 1 << (count.bit_length() - 1)
        if half not in most:
            last = most[half // 2]
            most[half] = np.maximum(last[: -(half // 2)], last[half // 2 :])
        window = np.maximum(most[half][: len(bits) - count + 1], most[half][count - half :]) if count > half else most[half]
        np.copyto(best[: len(window)], np.uint8(selector), where=window <= width)
    return best.reshape(blocks, -1)[:, :size]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the number of the word at which each block begins."""
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    blocks = -(-len(values) // BLOCK)
    bits = np.full(blocks * BLOCK, BEYOND, dtype=np.uint8)
    bits[: len(values)] = bit_lengths(values)
    best = selectors(bits.reshape(blocks, BLOCK)).reshape(-1)
    # all blocks take their next word at the same time
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, len(values))
    place, taken = np.arange(blocks) * BLOCK, []
    while len(place):
        taken.append(place)
        place = place + COUNTS[best[place]]
        going = place < ends
        place, ends = place[going], ends[going]
    taken = np.sort(np.concatenate(taken))
    chosen = best[taken]
    at = np.cumsum(1 + (chosen == LOW)) - 1 - (chosen == LOW)  # an escape takes two words
    words = np.zeros(int(at[-1]) + 1 + int(chosen[-1] == LOW), dtype=np.uint64)
    for selector in np.unique(chosen):
        here = np.flatnonzero(chosen == selector)
        first = taken[here]
        if selector == LOW:
            words[at[here]] = values[first] << np.uint64(4) | np.uint64(LOW)
            words[at[here] + 1] = values[first] >> np.uint64(60) << np.uint64(4) | np.uint64(HIGH)
            continue
        word = np.full(len(here), selector, dtype=np.uint64)
        for k in range(COUNTS[selector]):
            word |= values[first + k] << np.uint64(4 + k * WIDTHS[selector])
        words[at[here]] = word
    begins = at[np.searchsorted(taken, np.arange(blocks) * BLOCK)]
    return words, begins.astype(np.uint32)


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of the words, which must begin and end with a block."""
    chosen = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[chosen]
    at = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector in np.unique(chosen):
        here = np.flatnonzero(chosen == selector)
        if selector == HIGH:
            values[at[here - 1]] |= words[here] >> np.uint64(4) << np.uint64(60)
            continue
        mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
        for k in range(COUNTS[selector]):
            values[at[here] + k] |= words[here] >> np.uint64(4 + k * WIDTHS[selector]) & mask
    return values


def unpack_range(words: np.ndarray, begins: np.ndarray, first: int, last: int) -> np.ndarray:
    """Values ``first`` up to ``last``, decoding only the blocks that hold them."""
    if last <= first:
        return np.zeros(0, dtype=np.uint64)
    block, end = first // BLOCK, -(-last // BLOCK)
    upto = int(begins[end]) if end < len(begins) else len(words)
    return unpack(words[int(begins[block]) : upto])[first - block * BLOCK : last - block * BLOCK]
