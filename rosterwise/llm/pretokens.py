"""Splits texts into the pre-tokens of public_tokenizers.PATTERN, many at a time.

The pattern's classes (letters, numbers, white space, the rest) are runs of code points, so the
matches follow from class changes and two local rules: a blank before a run belongs to it, and the
last white space before other text stands alone. Arrays do that for millions of code points at once;
distinct pre-tokens are then found by Arrow's dictionary encoding.
"""

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Code points that are worked on together, unless one text has more.
CHUNK = 2_000_000
_SPACE, _LETTER, _NUMBER, _REST, _END = range(5)
_STOP = 0x110000  # no code point: stands between texts


@functools.cache
def _classes() -> np.ndarray:
    import regex

    kinds = np.full(_STOP + 1, _REST, np.uint8)
    points = [chr(c) for c in range(_STOP) if not 0xD800 <= c < 0xE000]
    everything = "".join(points)
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        hits = "".join(regex.findall(pattern, everything))
        kinds[np.frombuffer(hits.encode("utf-32-le"), np.uint32)] = kind
    kinds[_STOP] = _END
    return kinds


def _starts(points: np.ndarray) -> np.ndarray:
    """True where a match starts; ``points`` ends with _STOP."""
    kind = _classes()[points]
    start = np.empty(len(points), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _END
    space = kind == _SPACE
    # The last white space before text of another kind: a match of its own, or part of the next.
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != _END))
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # Contractions, where a match starts with the apostrophe.
    mark = np.flatnonzero(start[:-1] & (points[:-1] == 0x27) & (kind[1:] == _LETTER))
    if len(mark):
        one, two = points[mark + 1], points[np.minimum(mark + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size in ((mark[short], 1), (mark[long], 2)):
            start[at + 1] = False
            after = at + 1 + size
            start[after] |= kind[after] == _LETTER
    return start


def _chunks(texts):
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def ragged(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Places in a flat array of the items of each code, one after another."""
    each = sizes[codes]
    ends = np.cumsum(each)
    return np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0), ends


def encode_texts(texts: list[str], encode: Callable[[list[bytes]], list[bytes]]):
    """Yields the ids (uint32 array) of each text.

    ``encode`` gives the ids of distinct pre-tokens, as little-endian 32-bit integers.
    """

    def ids_of(words):
        found = encode(words.to_pylist())
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    return encode_pieces(texts, ids_of)


def encode_pieces(texts: list[str], ids_of: Callable[[pa.LargeBinaryArray], tuple[np.ndarray, np.ndarray]]):
    """Yields the ids (uint32 array) of each text; ``ids_of`` gives all ids of distinct pre-tokens, and how many each has."""
    for held in _chunks(texts):
        joined = "".join(t + "\0" for t in held)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in held])
        points[ends - 1] = _STOP
        data = joined.encode()
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        width[ends - 1] = 1
        start = np.flatnonzero(_starts(points))
        offsets = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offsets[1:])
        begin = offsets[start]
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[begin, len(data)]), pa.py_buffer(data)]
        ).dictionary_encode()
        stop = points[start] == _STOP
        flat, sizes = ids_of(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        keep = ~stop
        at, cum = ragged(codes[keep], np.cumsum(sizes) - sizes, sizes)
        ids = flat[at]
        # How many pre-tokens, and so ids, lie before the end of each text.
        count = np.cumsum(keep)[np.flatnonzero(stop)]
        bounds = np.r_[0, np.where(count > 0, cum[np.maximum(count, 1) - 1] if len(cum) else 0, 0)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield ids[lo:hi]
