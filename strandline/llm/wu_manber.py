"""Wu-Manber search for many patterns at once, over words instead of letters.

Patterns of one length make a searcher. Its shift table has, for each hash of a block of words,
how far the search may move on from a place where the block ends; a shift of zero leads to the
bucket of the patterns that end with such a block, and those are compared with the text word by
word. A text is cut into lanes, and numpy moves all lanes on together.
"""

from dataclasses import dataclass, field

import numpy as np

from strandline.llm.bytetext import encoded, hashed, mixed, ragged, rolling, spans

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LOWER = np.where(_UPPER, _BYTES + 0x20, _BYTES).astype(np.uint8)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_WORD = _DIGIT | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_BYTES >= 0x80)

_BLOCK = 3
_BITS = 20
_LANE = 512


@dataclass
class Words:
    """The words of some texts: where they lie, their hashes, and each text's first word."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray = field(repr=False)
    firsts: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, column) -> "Words":
        data, places = encoded(column)
        data = _LOWER[data]
        begins, ends = spans(_WORD[data], places)
        return cls(
            data, begins, ends, hashed(rolling(data), begins, ends), np.searchsorted(begins, places)
        )

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


def _block(hashes: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the blocks of ``size`` words that end at ``last``."""
    out = hashes[last]
    for back in range(1, size):
        out = mixed(out) + hashes[last - back]
    return mixed(out)


def _same(
    one: "Words | Searcher",
    first: np.ndarray,
    other: "Words | Searcher",
    others: np.ndarray,
    size: int,
) -> np.ndarray:
    """Whether the ``size`` words from ``first`` are those of ``other`` from ``others``."""
    same = np.ones(len(first), bool)
    for nth in range(size):
        theirs, ours = first + nth, others + nth
        width = one.ends[theirs] - one.begins[theirs]
        same &= width == other.ends[ours] - other.begins[ours]
        i = np.flatnonzero(same)
        if not len(i):
            break
        differs = one.data[ragged(one.begins[theirs[i]], width[i])] != other.data[
            ragged(other.begins[ours[i]], width[i])
        ]
        heads = np.cumsum(width[i]) - width[i]
        same[i] = ~np.logical_or.reduceat(differs, heads)
    return same


class Searcher:
    """All distinct windows of ``size`` words of some items, ready to be searched for."""

    def __init__(self, words: Words, firsts: np.ndarray, owners: np.ndarray, size: int):
        """``firsts``: the first word of each window; ``owners``: the item it is from."""
        self.size = size
        self.block = block = min(_BLOCK, size)
        whole = _block(words.hashes, firsts + size - 1, size)
        order = np.argsort(whole, kind="stable")
        new = np.ones(len(order), bool)
        # neighbours in this order are one pattern if their words are equal, not only their hashes
        new[1:] = whole[order][1:] != whole[order][:-1]
        twin = np.flatnonzero(~new)
        new[twin] = ~_same(words, firsts[order[twin]], words, firsts[order[twin - 1]], size)
        pattern = np.cumsum(new) - 1
        self.whole = whole[order][new]
        self.first = firsts[order][new]
        # the items of each pattern, end to end
        pairs = np.unique(np.stack((pattern, owners[order])), axis=1)
        self.owners = pairs[1]
        self.owner_begins = np.searchsorted(pairs[0], np.arange(len(self.first) + 1))
        # the words that the patterns are compared with, moved together
        used = np.unique(ragged(self.first, np.full(len(self.first), size)))
        widths = words.ends[used] - words.begins[used]
        self.data = words.data[ragged(words.begins[used], widths)]
        self.ends = np.cumsum(widths)
        self.begins = self.ends - widths
        self.first = np.searchsorted(used, self.first)
        # shifts, and the buckets of the patterns by their last block
        hashes = words.hashes[used]
        self.shift = np.full(1 << _BITS, size - block + 1, np.uint8)
        for left in range(size - block, -1, -1):
            ending = _block(hashes, self.first + size - 1 - left, block)
            self.shift[ending >> np.uint64(64 - _BITS)] = left
        last = _block(hashes, self.first + size - 1, block) >> np.uint64(64 - _BITS)
        self.by_last = np.argsort(last, kind="stable")
        self.slots, begins = np.unique(last[self.by_last], return_index=True)
        self.slot_begins = np.append(begins, len(last))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence in the texts."""
        last = self._candidates(words)
        if not len(last):
            return last, last
        slot = _block(words.hashes, last, self.block) >> np.uint64(64 - _BITS)
        at = np.searchsorted(self.slots, slot)
        sizes = self.slot_begins[at + 1] - self.slot_begins[at]
        pattern = self.by_last[ragged(self.slot_begins[at], sizes)]
        last = np.repeat(last, sizes)
        likely = _block(words.hashes, last, self.size) == self.whole[pattern]
        first, pattern = last[likely] - self.size + 1, pattern[likely]
        same = _same(words, first, self, self.first[pattern], self.size)
        return first[same], pattern[same]

    def _candidates(self, words: Words) -> np.ndarray:
        """Last words of the windows whose last block may end a pattern."""
        begins, ends = words.firsts[:-1] + self.size - 1, words.firsts[1:]
        lanes = np.maximum(-(-(ends - begins) // _LANE), 0)
        at = ragged(np.zeros(len(lanes), np.int64), lanes) * _LANE + np.repeat(begins, lanes)
        stop = np.minimum(at + _LANE, np.repeat(ends, lanes))
        found = []
        while len(at):
            block = _block(words.hashes, at, self.block)
            shift = self.shift[block >> np.uint64(64 - _BITS)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def searchers(words: Words, window: int) -> list[Searcher]:
    """One searcher for the windows of ``window`` words, and one for each length of the items
    that have fewer words and so are one window each."""
    counts = words.counts
    sizes = np.minimum(counts, window)
    out = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        items = np.flatnonzero(sizes == size)
        each = counts[items] - size + 1
        out.append(
            Searcher(words, ragged(words.firsts[items], each), np.repeat(items, each), size)
        )
    return out
