"""Word shingles as 64-bit hashes, computed for many texts at once."""

import numpy as np
import pyarrow as pa

_WORD = np.array([(0x9E3779B97F4A7C15 * (i + 1) ** 3 + 0x2545F4914F6CDD1D * (i + 7)) % (1 << 64) for i in range(256)], np.uint64)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    A-Z are lowered; words are runs of bytes other than the ``blank`` ones, by default the
    six ASCII blanks (a space must be one). A word's hash is a difference of running
    sums, so no loop over words is needed.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _LOWER[data]
    inside = ~blank[data]
    edge = np.diff(inside, prepend=False)
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_WORD[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes, np.diff(np.searchsorted(starts, begin))


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; all its words if it has fewer; empty without words."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[j:j + len(total)]
    total = mix(total)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(total[end - n:end - words + 1]))
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashes[end - n:end]:
                    short = short * np.uint64(0xA0761D6478BD642F) + h
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batch_sets(batch: pa.RecordBatch, column: str, words: int = 5) -> list[np.ndarray]:
    """Shingle sets of a text column of a record batch; null counts as empty."""
    return shingle_sets([t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()], words)
