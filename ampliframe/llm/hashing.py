"""64-bit codes of a text's words and word runs, computed over whole arrays of bytes."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20_200_501)
_byte_code = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13  # 3 mod 8: its powers repeat as late as they can
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of a text that are hashed at a time (cut between words).
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_BASE, 1 << 14), _powers(_INVERSE, 1 << 14)


def byte_class(inside: bytes) -> np.ndarray:
    """Which byte values belong to words."""
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


#: Everything but space, tab, line feed, vertical tab, form feed, return.
NOT_SPACE = byte_class(bytes(b for b in range(256) if b not in b" \t\n\x0b\x0c\r"))
#: ASCII letters, digits, the underscore, and all bytes of other characters.
WORD_LIKE = byte_class(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


def _chunks(data: bytes, inside: np.ndarray):
    """``(offset, part)`` with cuts between words."""
    start = 0
    while len(data) - start > CHUNK:
        end = start + CHUNK
        while end < len(data) and inside[data[end]]:
            end += 1
        yield start, data[start:end]
        start = end
    yield start, data[start:]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of the base and of its inverse."""
    global _up, _down
    if n > len(_up):
        size = 1 << n.bit_length()
        _up, _down = _powers(_BASE, size), _powers(_INVERSE, size)
    return _up, _down


def word_codes(text: str, inside: np.ndarray) -> np.ndarray:
    """The code of each word (run of ``inside`` bytes of the UTF-8 text), A-Z in lower case."""
    return words_at(text.encode(), inside)[0]


def words_at(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words, and the bytes where each begins and ends."""
    parts = [_codes(c, inside, at) for at, c in _chunks(data.lower(), inside)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _codes(data: bytes, inside: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    up, down = powers(n + 1)
    mark = np.zeros(n + 2, np.int8)
    mark[1:-1] = inside[raw]
    edges = np.flatnonzero(mark[1:] != mark[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_code[raw] * up[:n], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out ^= out >> np.uint64(32)
    out *= _ODD
    out ^= out >> np.uint64(29)
    return out, starts + at, ends + at


def range_codes(codes: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The code of each range of words ``first`` to before ``behind``."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=total[1:])
    out = (total[behind] - total[first]) * down[first]
    out ^= out >> np.uint64(31)
    return out * _ODD


def run_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The code of each run of ``k`` words."""
    n = len(codes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ codes[i:i + n]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
