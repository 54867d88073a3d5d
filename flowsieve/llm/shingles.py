"""Sets of word shingles as 64-bit hashes, worked out for many texts at a time.

Words are runs of bytes other than space and tab to carriage return, with A-Z lower-cased. A text's set
holds the hashes of its distinct shingles of five words; a text of fewer words has its whole sequence as the
only one, and a text without words has none. A word's hash is a polynomial of its bytes in two prime fields, as a difference
of running sums, so that no word is cut out as an object. Two words of up to n bytes share both values with a probability of
about (n / 2^31)^2 at a random base, whatever the words (a power of two as modulus would not do: words of the Thue-Morse kind agree at any base).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from flowsieve.llm.tables import raw_values

WIDTH = 5
PIECE = 1 << 19
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)  # Mersenne's, and the greatest prime below it

random_values = np.random.default_rng(20240229)
BASES = [int(random_values.integers(1 << 30, p)) for p in PRIMES]
VALUES = [random_values.integers(1, p, 256, dtype=np.uint64) for p in PRIMES]
for values in VALUES:
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = random_values.integers(0, 1 << 64, WIDTH, dtype=np.uint64) | np.uint64(1)


def powers(base: int, n: int, prime: int) -> np.ndarray:
    run = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        run[done : done + more] = run[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return run


UP = [powers(b, PIECE, p) for b, p in zip(BASES, PRIMES)]
DOWN = [powers(pow(b, -1, p), PIECE, p) for b, p in zip(BASES, PRIMES)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other, and how many words stand before each text's end.

    `begins` has the first byte of each text and, last, the end of all.
    """
    n = len(raw)
    word = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[begins] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = (ends - starts).astype(np.uint64)
    for k, p in enumerate(PRIMES):
        up, down = (UP[k], DOWN[k]) if n <= PIECE else (powers(BASES[k], n, p), powers(pow(BASES[k], -1, p), n, p))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(VALUES[k][raw] * up[:n] % np.uint64(p), out=sums[1:])  # of fewer than 2^32 numbers below 2^31
        inside = (sums[ends] - sums[starts]) % np.uint64(p) * down[starts] % np.uint64(p)
        found = mixed(found ^ inside << np.uint64(16 * k))
    return found, np.searchsorted(starts, begins)


def long_text_hashes(raw: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece; pieces end at white space."""
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):
            gaps = np.flatnonzero(SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(raw), end + PIECE)  # one word longer than a piece
        parts.append(word_hashes(raw[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    width = min(WIDTH, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    windows = len(words) - width + 1
    total = np.full(windows, width, dtype=np.uint64)
    for j in range(width):
        total = total + words[j : j + windows] * STEP[j]
    total = mixed(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text; `texts` comes from `filled`. Short texts are hashed together."""
    waiting: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        begins = np.concatenate([[0], np.cumsum([len(w) for w in waiting])]).astype(np.int64)
        hashes, upto = word_hashes(np.concatenate(waiting), begins)
        for i in range(len(waiting)):
            yield shingle_set(hashes[upto[i] : upto[i + 1]])

    for value in raw_values(texts):
        raw = np.frombuffer(value, dtype=np.uint8)
        if waiting and size + len(raw) > PIECE:
            yield from flush()
            waiting, size = [], 0
        if len(raw) > PIECE:
            yield shingle_set(long_text_hashes(raw))
        else:
            waiting.append(raw)
            size += len(raw)
    if waiting:
        yield from flush()
