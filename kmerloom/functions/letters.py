"""Arrays over the letters of many texts at once, for use inside tasks: windows, their hashes, minima and exact keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Letters that are held as arrays at once; a longer text is cut into pieces that overlap.
GROUP = 1 << 18
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def groups(texts: list[str | None], overlap: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(rows, firsts, pieces) of some GROUP letters each: the texts' rows, each piece's first letter in its text, and the pieces; pieces of one text share ``overlap`` letters."""
    rows, firsts, pieces, held = [], [], [], 0
    for row, text in enumerate(texts):
        for first in range(0, max(len(text) - overlap, 1), GROUP) if text else ():
            piece = text[first : first + GROUP + overlap]
            rows.append(row)
            firsts.append(first)
            pieces.append(piece)
            held += len(piece)
            if held >= GROUP:
                yield rows, firsts, pieces
                rows, firsts, pieces, held = [], [], [], 0
    if rows:
        yield rows, firsts, pieces


def complete(lengths: np.ndarray, k: int) -> np.ndarray:
    """Whether a window of ``k`` letters that begins at each letter of the joined pieces lies in one piece."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + k <= np.repeat(ends, lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _P2
    return h ^ (h >> np.uint64(29))


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of ``k`` letters, built up from windows of half their length."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, "u8")
    half, size, power, out, done = codes.astype("u8") + np.uint64(1), 1, _P1, None, 0
    while True:
        if k & size:
            out = half[:n].copy() if out is None else out * power + half[done : done + n]
            done += size
        if size * 2 > k:
            return mixed(out)
        half, power, size = half[:-size] * power + half[size:], np.uint64(int(power) ** 2 % (1 << 64)), size * 2


def sliding(least: Callable, a: np.ndarray, w: int) -> np.ndarray:
    """``least`` of every ``w`` values in a row; the result is ``w`` - 1 shorter."""
    size = 1
    while size * 2 <= w:
        a, size = least(a[:-size], a[size:]), size * 2
    return least(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def narrow(codes: np.ndarray) -> np.ndarray:
    """Letters in as few bytes as they need, the high one first."""
    top = int(codes.max()) if len(codes) else 0
    return np.ascontiguousarray(codes, "u1" if top < 1 << 8 else ">u2" if top < 1 << 16 else ">u4")


def letters_of(text: bytes) -> np.ndarray:
    """The letters of UTF-8 text, in as few bytes as they need."""
    return np.frombuffer(text, "u1") if text.isascii() else narrow(codes_of(text.decode("utf-8", "surrogatepass")))


def words(letters: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """The windows of ``k`` of ``narrow`` letters at ``starts`` as 64-bit words, first letters first: equal and ordered as the windows are."""
    size = letters.itemsize
    each = min(k, 8 // size)
    padded = np.zeros(len(letters) + 8 // size, letters.dtype)
    padded[: len(letters)] = letters
    at_each = np.ndarray((len(letters) + 1,), ">u8", padded, strides=(size,))
    places = list(range(0, k - each + 1, each))
    out = []
    for at in places + ([k - each] if places[-1] != k - each else []):
        w = at_each[starts + at].astype("u8")
        out.append(w >> np.uint64(64 - 8 * size * k) if 8 * size * k < 64 else w)
    return out


def windows_at(letters: np.ndarray, starts: np.ndarray, k: int) -> pa.Array:
    """The windows of ``k`` of ``narrow`` letters at ``starts`` as text."""
    if letters.itemsize == 1 and len(starts) and int(letters.max()) < 128:
        own = letters[starts[:, None] + np.arange(k)]
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.arange(len(starts) + 1, dtype="i4") * k), pa.py_buffer(np.ascontiguousarray(own)))
    text = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + k] for i in starts.tolist()], pa.string())
