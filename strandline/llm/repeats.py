"""Bytes of a text that another text has too, for tasks: anchors, and bucket-pointer refinement.

Of every stretch of ``LENGTH`` bytes the q-grams with the smallest hash are its anchors, so equal
stretches have equal anchors at equal places. The surroundings of an anchor are all stretches
that can have it.
"""

import numpy as np

from strandline.llm.bytetext import hashed, mixed, ragged, rolling

LENGTH = 50
Q = 16
#: q-grams of a stretch.
_GRAMS = LENGTH - Q + 1
_SIDE = _GRAMS // 2  # bytes that a shared stretch has at least, before or after the q-gram
_FIRST = 8  # bytes of the first buckets


def _sliding(x: np.ndarray, pick, size: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``size`` consecutive numbers."""
    width = 1
    while 2 * width <= size:
        x = pick(x[: len(x) - width], x[width:])
        width *= 2
    rest = size - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all texts: place in ``data``, number of the text, and four identifiers.

    They are those of the q-gram, of its surroundings together with the anchor's place in them,
    and of the q-gram with the bytes right before it, and right after it. A stretch that two
    surroundings share has enough of the bytes on one side, so these agree on one of the sides;
    near a text's end, where a side has fewer bytes, nothing else has the same identifier.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, *[none.astype(np.uint64)] * 4
    sums = rolling(data)
    at = np.arange(len(data) - Q + 1)
    gram = hashed(sums, at, at + Q)
    order = (gram >> np.uint64(32)).astype(np.uint32)
    # stretches that lie inside one text
    sizes = np.diff(places)
    whole = np.zeros(len(data) - LENGTH + 1, bool)
    whole[ragged(places[:-1], np.maximum(sizes - LENGTH + 1, 0))] = True
    least = np.where(whole, _sliding(order, np.minimum, _GRAMS), 0)
    room = np.zeros(_GRAMS - 1, np.uint32)
    chosen = np.flatnonzero(
        _sliding(np.concatenate((room, least, room)), np.maximum, _GRAMS) == order
    )
    text = np.searchsorted(places, chosen, side="right") - 1
    begins, ends = surroundings(chosen, places[text], places[text + 1])
    around = hashed(sums, begins, ends)
    around = mixed(around + (chosen - begins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sides = []
    for low, high in ((-_SIDE, Q), (0, Q + _SIDE)):
        a, b = chosen + low, chosen + high
        inside = (a >= places[text]) & (b <= places[text + 1])
        side = mixed(around)
        side[inside] = hashed(sums, a[inside], b[inside])
        sides.append(side)
    return chosen, text, gram[chosen], around, *sides


def surroundings(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors at these places, in texts that begin and end there."""
    return np.maximum(at - _GRAMS + 1, begin), np.minimum(at + LENGTH, end)


def refined(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all places with the same next ``LENGTH`` bytes in one text.

    Bucket-pointer refinement: places are sorted into buckets by their first q-gram. A bucket is
    then refined by the bucket pointers of the places as many bytes on as its places are known to
    agree, which doubles the bytes, and so on with the pointers just updated. A place alone in
    its bucket keeps its pointer and is not sorted again. Returns the places whose last bucket
    has others, and its number.
    """
    sizes = np.diff(places)
    size = len(data)
    if size < _FIRST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(size - _FIRST + 1, np.uint64)
    for byte in range(_FIRST):
        value = value << np.uint64(8) | data[byte : size - _FIRST + 1 + byte]
    pointer = np.zeros(size, np.int64)
    live = ragged(places[:-1], np.maximum(sizes - _FIRST + 1, 0))
    end = np.repeat(places[1:], np.maximum(sizes - _FIRST + 1, 0))
    _, pointer[live] = np.unique(value[live], return_inverse=True)
    free = size  # the next bucket's number
    depth = _FIRST
    while True:
        order = np.argsort(pointer[live], kind="stable")
        own = pointer[live][order]
        same = own[1:] == own[:-1]
        several = np.zeros(len(live), bool)
        several[order[1:]] = same
        several[order[:-1]] |= same
        live, end = live[several], end[several]
        if depth == LENGTH or not len(live):
            return live, pointer[live]
        step = min(depth, LENGTH - depth)
        reach = live + depth + step <= end
        live, end = live[reach], end[reach]
        pairs = pointer[live].astype(np.uint64) * np.uint64(free) + pointer[live + step].astype(
            np.uint64
        )
        _, found = np.unique(pairs, return_inverse=True)
        pointer[live] = free + found
        free += len(live)
        depth += step
