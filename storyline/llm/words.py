"""Words of texts as hash values in numpy arrays, for the operators that work on word sequences.

A word is a run of bytes other than the six ASCII white space bytes, which is what bytes.split() cuts at. Words are hashed all at once: a
word's hash is the sum of its bytes times the powers of an odd number, as a difference of running sums over the whole buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the polynomials over a word's bytes and over a sequence's word hashes.
LETTER, BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(LETTER), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Bytes that are hashed in one go.
STEP = 1 << 19
#: White space of words becomes a space.
_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of LETTER and of its inverse."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", LETTER), ("down", _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    up, down = _powers["up"][:n], _powers["down"][:n]
    if len(_powers["up"]) > 1 << 21:  # not kept for the sake of one very long text
        _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
    return up, down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of texts, how many each text has, and where each word starts and ends in its text."""
    data = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(_TO_SPACE), np.uint8)
    space = data == 32
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    h, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):  # some bytes at a time, so that a very long text needs few numbers besides its words'
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP, "right")))
        origin, some = starts[first], data[starts[first] : ends[last - 1]]
        up, down = _powers_to(len(some))
        sums = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(up * (some.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        h[first:last] = (sums[ends[first:last] - origin] - sums[starts[first:last] - origin]) * down[starts[first:last] - origin]
        first = last
    h = mixed(h)
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    n = np.diff(np.searchsorted(starts, at))
    origin = np.repeat(at[:-1], n)
    return h, n, starts - origin, ends - origin


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of n consecutive words; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    power, size, part = np.array([BASE]), 1, h  # arrays wrap round without a warning
    out, done = None, 0
    while True:  # by the binary digits of n: `part` covers `size` words, `out` the first `done`
        if n & size:
            out = part if out is None else out[: len(h) - done - size + 1] * power + part[done : done + len(h) - done - size + 1]
            done += size
        if done == n:
            return mixed(out[: len(h) - n + 1])
        part = part[: len(part) - size] * power + part[size:]
        power, size = power * power, size * 2


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n consecutive values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h = np.minimum(h[: len(h) - step], h[step:])
        size += step
    return h


def batches_of(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes, so that few words are held at a time."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, k
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
