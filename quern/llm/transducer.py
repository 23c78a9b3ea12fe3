"""A minimal acyclic transducer from sorted terms to their places, and its run over whole texts in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Bytes of a term: ASCII letters and all that is not ASCII; only A-Z become small.
TERM_BYTE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of text that are matched at a time.
SLICE = 1 << 22


class Transducer:
    """Rows of ``cells`` are states, columns the classes of bytes that occur. A cell holds the next state and, in its upper half, what the step adds to the place.

    State 0 is dead and state 1 the start. What is added up on the way to a final state is the number of terms before the one
    read, so places are lexicographic and no term is stored.
    """

    def __init__(self, classes: np.ndarray, cells: np.ndarray, final: np.ndarray, terms: int, longest: int) -> None:
        self.classes, self.cells, self.final, self.terms, self.longest = classes, cells, final, terms, longest

    def places(self, small: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, place): the tokens (small-letter bytes from ``starts`` on) that are terms. All tokens read a byte at a step, and those that no term begins with drop out."""
        which = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        at, left = starts[which], lengths[which]
        state, place = np.ones(len(which), np.int64), np.zeros(len(which), np.int64)
        found: list[np.ndarray] = []
        placed: list[np.ndarray] = []
        while len(which):
            cell = self.cells[state, self.classes[small[at]]]
            state, place = cell & 0xFFFFFFFF, place + (cell >> 32)
            left = left - 1
            done = (left == 0) & self.final[state]
            if done.any():
                found.append(which[done])
                placed.append(place[done])
            go = (state > 0) & (left > 0)
            which, at, left, state, place = which[go], at[go] + 1, left[go], state[go], place[go]
        none = np.zeros(0, np.int64)
        return (np.concatenate(found), np.concatenate(placed)) if found else (none, none)


def build(terms: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(source state, byte, target state) of every transition, the final states, and the longest term, of the minimal automaton of sorted distinct terms.

    Each term shares its beginning with the one before; what the one before has beyond that can't grow any more, so its states
    give way to equal ones that are registered, from the end on. States are numbered from 1, the start.
    """
    edges: list[dict[int, int]] = [{}, {}]
    final = [False, False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path = [1]
    before, longest = b"", 0

    def settle(down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            label = before[len(path) - 1]
            key = (final[state], *edges[state].items())
            same = register.setdefault(key, state)
            if same != state:
                edges[path[-1]][label] = same
                edges[state] = {}
                free.append(state)

    for term in terms:
        shared = 0
        while shared < min(len(before), len(term)) and before[shared] == term[shared]:
            shared += 1
        settle(shared)
        for b in term[shared:]:
            if free:
                new = free.pop()
                final[new] = False
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[path[-1]][b] = new
            path.append(new)
        final[path[-1]] = True
        before, longest = term, max(longest, len(term))
    settle(0)
    rows = np.array([(s, b, t) for s, out in enumerate(edges) for b, t in out.items()], np.int64).reshape(-1, 3)
    used = np.unique(np.append(rows[:, [0, 2]], 1))  # the freed states aren't; the start stays 1, the least
    rows[:, 0], rows[:, 2] = np.searchsorted(used, rows[:, 0]) + 1, np.searchsorted(used, rows[:, 2]) + 1
    ends = np.array([k + 1 for k, s in enumerate(used.tolist()) if final[s]], np.int64)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))], ends, used, longest


def pack(terms: Iterable[bytes]) -> bytes:
    """The automaton of sorted distinct terms as bytes."""
    rows, ends, used, longest = build(terms)
    head = np.array([len(rows), len(ends), len(used), longest], np.int64)
    return head.tobytes() + rows[:, 0].astype(np.int32).tobytes() + rows[:, 2].astype(np.int32).tobytes() + ends.astype(np.int32).tobytes() + rows[:, 1].astype(np.uint8).tobytes()


def cells_of(packed: bytes) -> int:
    """Cells of the unpacked table."""
    n, _, states, _ = np.frombuffer(packed, np.int64, 4)
    labels = np.frombuffer(packed, np.uint8)[-int(n) :] if n else np.zeros(0, np.uint8)
    return int((states + 1) * (len(np.unique(labels)) + 1))


def unpack(packed: bytes) -> Transducer:
    """The table, with how many terms each step leaves behind: those that end in its state, and those of its earlier siblings."""
    n, m, states, longest = np.frombuffer(packed, np.int64, 4).tolist()
    ints = np.frombuffer(packed, np.int32, 2 * n + m, 32).astype(np.int64)
    source, target, ends = ints[:n], ints[n : 2 * n], ints[2 * n :]
    labels = np.frombuffer(packed, np.uint8, n, 32 + 4 * (2 * n + m))
    final = np.zeros(states + 1, bool)
    final[ends] = True
    # Terms from each state on. States have no order by depth, so counts settle from the ends backwards, a round for each byte of the longest term.
    below = final.astype(np.int64)
    for _ in range(longest):
        new = final + np.bincount(source, weights=below[target], minlength=states + 1).astype(np.int64)
        if (new == below).all():
            break
        below = new
    ahead = np.cumsum(below[target]) - below[target]
    first = np.searchsorted(source, source)  # rows are sorted by state and byte
    adds = ahead - ahead[first] + final[source] if n else ahead
    present = np.unique(labels)
    classes = np.zeros(256, np.int64)
    classes[present] = np.arange(1, len(present) + 1)
    cells = np.zeros((states + 1, len(present) + 1), np.int64)
    cells[source, classes[labels]] = target | (adds << 32)
    return Transducer(classes, cells, final, int(below[1]) if states else 0, longest)


def tokens(data: np.ndarray, offsets: np.ndarray, size: int = SLICE):
    """Yield (small-letter bytes, starts, lengths, document) of the tokens of documents that lie end to end in ``data``, document k between offsets k and k + 1.

    About ``size`` bytes at a time, cut where no token is.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    while begin < end:
        stop = min(begin + size, end)
        while stop < end and TERM_BYTE[data[stop]]:  # a token goes on: to its end, by growing looks ahead
            gap = np.flatnonzero(~TERM_BYTE[data[stop : min(stop + size, end)]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + size, end)
        part = data[begin:stop]
        inside = TERM_BYTE[part]
        edges = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, stop)] - begin
        new, last = inside.copy(), inside.copy()
        new[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        new[edges] = inside[edges]
        last[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
        starts = np.flatnonzero(new)
        bounds = np.searchsorted(starts, np.clip(offsets - begin, 0, len(part)))
        yield SMALL[part], starts, np.flatnonzero(last) - starts + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        begin = stop
