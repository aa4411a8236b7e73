"""A run-length compressed Burrows-Wheeler transform with sampled run ends, and matching statistics over it.

The transform is kept as runs: first row, symbol, where the last-to-first mapping takes the first row, and the text
positions of the suffixes at the run's two ends. Matching statistics are streamed from right to left, all patterns in
step: while a pattern's next symbol is that of its row's run it follows the mapping; else it jumps to the end of the
nearest run of that symbol above or below, whichever shares more with the text matched so far. The samples at run ends
are what tells where the jump lands in the text (Bannai et al. 2020; Boucher et al., 2021).

Symbols are numbers of any size, so that contents with alphabets of their own (a collection each) share one index
without ever matching each other.
"""

from __future__ import annotations

import numpy as np

#: A byte that no UTF-8 text has; it ends each content where texts are compared byte by byte.
END = np.uint8(0xFF)


def _suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling of the sorted length; each round sorts only what is still tied."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    wide = int(rank.max()).bit_length()
    depth = 1
    while wide * 2 <= 62 and depth < 4:  # pack several symbols into the first key
        rank = (rank << wide) | np.append(rank[depth:], np.zeros(min(depth, n), dtype=rank.dtype))[:n]
        wide, depth = wide * 2, depth * 2
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    head = np.ones(n, dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        # rows of a rank that more than one suffix has
        alone = head & np.append(head[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return order
        at = order[rows]
        far = at + depth
        key = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        group = rank[at]
        by = np.argsort((group << 31) | key, kind="stable")
        order[rows] = at[by]
        group, key = group[by], key[by]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        head[rows] = new
        rank[order[rows]] = np.maximum.accumulate(np.where(new, rows, 0))
        depth *= 2


class RunIndex:
    """The index of contents laid end to end, each ended by the byte ``END``, with a symbol for each byte."""

    def __init__(self, text: np.ndarray, symbols: np.ndarray):
        order = _suffix_order(symbols)
        self.alphabet, coded = np.unique(symbols, return_inverse=True)
        last = coded[order - 1].astype(np.int32)  # the text is read as a circle
        head = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        lengths = np.diff(np.append(head, len(last)))
        self.symbol = last[head]
        by = np.argsort(self.symbol, kind="stable")
        mapped = np.empty(len(head), dtype=np.int64)
        mapped[by] = np.cumsum(lengths[by]) - lengths[by]
        self.tail, self.shift = head + lengths - 1, mapped - head
        self.head = head
        self.top, self.bottom = order[head], order[self.tail]  # samples: the suffixes at the run's ends
        self.by, self.by_key = by, self.symbol[by] * np.int64(len(head)) + by
        self.run_of = np.repeat(np.arange(len(head), dtype=np.int32), lengths)
        self.lanes = np.ndarray(len(text), dtype="<u8", buffer=np.append(text, np.full(8, END)).tobytes(), strides=(1,))
        self.size = len(text)

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the texts at a and b share, at most ``most``."""
        out, live = np.zeros(len(a), dtype=np.int64), np.flatnonzero(most > 0)
        a, b = a[live], b[live]
        for at in range(0, int(most.max(initial=0)), 8):
            differ = self.lanes[a] ^ self.lanes[b]
            low = differ & (~differ + np.uint64(1))
            out[live] += np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
            on = np.flatnonzero((differ == 0) & (most[live] > at + 8) & (a + 8 < self.size) & (b + 8 < self.size))
            if not len(on):
                break
            live, a, b = live[on], a[on] + 8, b[on] + 8
        return np.minimum(out, most)

    def matching_statistics(self, symbols: np.ndarray, begins: np.ndarray, lengths: np.ndarray, enough: int) -> np.ndarray:
        """For each position of the patterns, laid end to end, the length of its longest match; exact below ``enough``."""
        found = np.zeros(len(symbols), dtype=np.int32)
        code = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        code = np.where(self.alphabet[code] == symbols, code, -1).astype(np.int32)
        longest_first = np.argsort(-lengths, kind="stable")
        at = (begins + lengths)[longest_first]
        counts = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(1, int(lengths.max(initial=0)) + 1), side="left")
        row, run = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int32)
        place, matched = np.full(len(lengths), self.top[0]), np.zeros(len(lengths), dtype=np.int64)
        for step, m in enumerate(counts, start=1):
            want = code[at[:m] - step]
            jump = np.flatnonzero(self.symbol[run[:m]] != want)
            if len(jump):
                w = want[jump]
                # runs of a symbol are in the order of their rows
                below = np.searchsorted(self.by_key, w * np.int64(len(self.by)) + run[jump])
                up, down = self.by[np.maximum(below - 1, 0)], self.by[np.minimum(below, len(self.by) - 1)]
                has_up, has_down = self.symbol[up] == w, self.symbol[down] == w
                most, here = np.minimum(matched[jump], enough), place[jump]
                over = np.where(has_up, self._shared(here, self.bottom[up], most * has_up), -1)
                # no need to look below where the run above shares all
                under = np.where(has_down, self._shared(here, self.top[down], most * (has_down & (over < most))), -1)
                go_up = over >= under
                to = np.where(go_up, up, down)
                row[jump] = np.where(go_up, self.tail[to], self.head[to])
                place[jump] = np.where(go_up, self.bottom[to], self.top[to])
                matched[jump] = np.maximum(over, under)
                run[jump] = to
            row[:m] += self.shift[run[:m]]
            place[:m] -= 1
            matched[:m] += 1
            lost = jump[matched[jump] == 0] if len(jump) else jump
            if len(lost):  # a symbol that the index does not have
                row[lost], place[lost] = 0, self.top[0]
            run[:m] = self.run_of[row[:m]]
            found[at[:m] - step] = matched[:m]
        return found


def in_smaller(raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, docs: np.ndarray, groups: np.ndarray, width: int, piece: int = 128) -> np.ndarray:
    """Whether each string of ``width`` bytes of contents, which begin in ``raw`` where told, is in a smaller document's content.

    Only contents of one group are compared. The documents of a group are halved in their order, and halved again: each
    time the contents of the lower half are indexed and those of the upper half streamed over them, so whatever matches
    is in a smaller document, and any two documents are apart in one halving. All groups are halved together.
    """
    counts = lengths - width + 1
    first = np.cumsum(counts) - counts
    marked = np.zeros(int(counts.sum()), dtype=bool)
    order = np.lexsort((docs, groups))
    new_group = np.append(True, groups[order][1:] != groups[order][:-1])
    new_doc = np.append(True, docs[order][1:] != docs[order][:-1]) | new_group
    number = np.cumsum(new_doc) - 1
    place = np.empty(len(order), dtype=np.int64)
    place[order] = number - number[np.maximum.accumulate(np.where(new_group, np.arange(len(order)), 0))]
    _, group = np.unique(groups, return_inverse=True)
    for level in range(int(place.max(initial=0)).bit_length()):
        # a block is two adjacent runs of 2 ** level documents of a group
        key = group * (int(place.max()) + 2) + (place >> (level + 1))
        _, block = np.unique(key, return_inverse=True)
        upper = (place >> level & 1).astype(bool)
        both = (np.bincount(block, weights=upper) > 0) & (np.bincount(block, weights=~upper) > 0)
        lower_ones, upper_ones = np.flatnonzero(~upper & both[block]), np.flatnonzero(upper & both[block])
        if not len(upper_ones):
            continue
        # an alphabet of its own for each block; 0 ends a content
        text, owner, _ = _laid_out(raw, begins[lower_ones], lengths[lower_ones], True)
        index = RunIndex(text, np.where(text == END, 0, block[lower_ones][owner] * 256 + text + 1))
        # long contents are streamed in pieces, so that few steps do
        pieces = -(-counts[upper_ones] // piece)
        source = np.repeat(upper_ones, pieces)
        offset = (np.arange(len(source)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
        size = np.minimum(counts[source] - offset, piece)
        text, owner, starts = _laid_out(raw, begins[source] + offset, size + width - 1, False)
        found = index.matching_statistics(block[source][owner].astype(np.int64) * 256 + text + 1, starts, size + width - 1, width)
        inner = np.arange(len(text)) - starts[owner]
        window = inner < size[owner]
        at = (first[source] + offset)[owner[window]] + inner[window]
        marked[at] |= found[window] >= width
    return marked


def _laid_out(raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ended: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of ``raw`` end to end, each followed by END if asked: bytes, the piece of each byte, begins."""
    room = lengths + ended
    starts = np.cumsum(room) - room
    owner = np.repeat(np.arange(len(begins)), room)
    inner = np.arange(len(owner)) - starts[owner]
    text = raw[np.minimum(begins[owner] + inner, len(raw) - 1)]
    if ended:
        text = np.where(inner == lengths[owner], END, text)
    return text, owner, starts
