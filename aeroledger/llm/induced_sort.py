"""External suffix sorting by recursive induction, with common-prefix lengths.

Suffixes are of type S if they are smaller than the next suffix, else L; an S
suffix after an L suffix is a left-most one. Scanning sorted suffixes upwards
puts every L suffix in place by its successor, scanning downwards then every S
suffix. Both scans run on a priority queue of tuples (key, position, common
prefix): a tuple taken out puts its predecessor in, which never sorts before
it. Left-most substrings are sorted by the same scans, named, and the string of
names is sorted by recursion; a short one is sorted in memory.

The queue is disk-backed: tuples wait in a bucket for each range of keys, in
files once more than ``limit`` are held, and are taken out in batches. A batch
ends before a tuple that something put in by the batch would precede. A bucket
of one key is a first-in first-out file, read piece by piece, so a shard may be
much larger than memory; the text itself is memory-mapped.

The common prefix of two neighbours that one scan puts in is one more than the
least common prefix between their successors; the running minimum for each
character is all that is kept. Lengths are capped, nothing beyond is needed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

LIMIT = 1 << 21
BATCH = 1 << 17
#: Strings of at most so many names are sorted in memory.
BASE = 1 << 21
_BUCKETS = 512
NAMED_AT_ONCE = 1 << 16


def _number(n: int) -> type:
    """A type for keys and positions below n."""
    return np.int32 if n < 1 << 30 else np.int64


class TupleQueue:
    """Tuples (key, position, common prefix) by key, then in the order in which they were put in."""

    def __init__(self, edges: np.ndarray, single: bool, folder: str, name: str, limit: int, number: type) -> None:
        self.edges, self.single, self.limit = edges, single, limit
        self._row = np.dtype([("key", number), ("pos", number), ("lcp", np.int16)])
        self.path = os.path.join(folder, name)
        self.held: list[list[tuple]] = [[] for _ in edges]
        self.n_held, self.files = 0, [0] * len(edges)
        self.read = [0] * len(edges)
        self.now, self.current = 0, None

    def put(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(key):
            return
        rows = np.empty(len(key), self._row)
        rows["key"], rows["pos"], rows["lcp"] = key, pos, lcp
        # The edges of buckets of one key are the keys themselves; small numbers sort by radix.
        bucket = (key if self.single else np.searchsorted(self.edges, key, "right") - 1).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(bucket[order])), len(order) - 1) + 1
        first = 0
        for end in ends.tolist():
            b = int(bucket[order[first]])
            part = rows[order[first:end]]
            if b == self.now and not self.single and self.current is not None:
                at = np.searchsorted(self.current["key"], part["key"], "right")
                by_key = np.argsort(part["key"], kind="stable")
                self.current = np.insert(self.current, at[by_key], part[by_key])
            else:
                self.held[b].append(part)
                self.n_held += len(part)
            first = end
        if self.n_held > self.limit:
            self._spill()

    def _file(self, bucket: int) -> str:
        return f"{self.path}-{bucket}"

    def _spill(self) -> None:
        for b, parts in enumerate(self.held):
            if parts:
                with open(self._file(b), "ab") as out:
                    for part in parts:
                        part.tofile(out)
                        self.files[b] += len(part)
                self.held[b] = []
        self.n_held = 0

    def _take(self, bucket: int, most: int | None) -> np.ndarray:
        """Next rows of a bucket: those on disk first, they were put in first."""
        left = self.files[bucket] - self.read[bucket]
        if left:
            n = left if most is None else min(left, most)
            rows = np.fromfile(self._file(bucket), self._row, n, offset=self.read[bucket] * self._row.itemsize)
            self.read[bucket] += n
            if most is not None:
                return rows
            parts = [rows]
        else:
            parts = []
        parts += self.held[bucket]
        self.held[bucket] = []
        self.n_held -= sum(len(p) for p in parts[bool(left):])
        return np.concatenate(parts) if parts else np.empty(0, self._row)

    def peek(self, n: int) -> np.ndarray:
        """Up to n next rows; empty at the end."""
        while self.current is None or not len(self.current):
            if self.single:
                self.current = self._take(self.now, n)
            elif self.current is None:
                rows = self._take(self.now, None)
                self.current = rows[np.argsort(rows["key"], kind="stable")]
            if len(self.current):
                break
            if self.now + 1 == len(self.edges):
                return self.current
            if self.files[self.now]:
                os.remove(self._file(self.now))
            self.now, self.current = self.now + 1, None
        return self.current[:n]

    def advance(self, n: int) -> None:
        self.current = self.current[n:]

    def close(self) -> None:
        for b, n in enumerate(self.files):
            if n and os.path.exists(self._file(b)):
                os.remove(self._file(b))


def suffix_types(text: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """True for S suffixes; the last one counts as S."""
    n = len(text)
    out = np.ones(n, bool)
    right = True
    for end in range(n - 1, 0, -piece):
        begin = max(0, end - piece)
        part = np.asarray(text[begin:end + 1]).astype(np.int64)
        step = np.diff(part)
        m = len(step)
        where = np.where(step != 0, np.arange(m), m)
        following = np.minimum.accumulate(where[::-1])[::-1]
        out[begin:end] = np.where(following < m, step[np.minimum(following, m - 1)] > 0, right)
        right = out[begin]
    return out


class _Scan:
    """One scan: takes tuples in key order and puts in the predecessors of the wanted type."""

    def __init__(self, text, types, want: bool, down: bool, most: int, cap: int, folder: str, name: str, limit: int) -> None:
        self.text, self.types, self.want, self.cap, self.down, self.most = text, types, want, cap, down, most
        keys = 2 * (most + 1)
        self.single = keys <= 2 * _BUCKETS
        edges = np.arange(keys) if self.single else np.linspace(0, keys, _BUCKETS, endpoint=False).astype(np.int64)
        self.queue = TupleQueue(edges, self.single, folder, name, limit, _number(max(len(text), keys)))
        self.since = np.full(most + 1, -1, np.int64) if cap else None
        self.last: tuple[int, int] | None = None  # key and position of the tuple before the batch

    def key(self, char: np.ndarray, late: int) -> np.ndarray:
        """Tuples that a scan starts from (late) come after those it puts in under the same character."""
        char = char.astype(np.int64)
        return 2 * (self.most - char if self.down else char) + late

    def start(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.queue.put(self.key(np.asarray(self.text[pos]), 1), pos, lcp)

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, common prefixes with the tuple before, whether the scan put it in)."""
        while len(rows := self.queue.peek(BATCH)):
            key, pos = rows["key"].astype(np.int64), rows["pos"].astype(np.int64)
            before = np.maximum(pos - 1, 0)
            put = (pos > 0) & (self.types[before] == self.want)
            char = np.asarray(self.text[before])
            new = self.key(char, 0)
            if not self.single:
                least = np.minimum.accumulate(np.where(put, new, np.iinfo(np.int64).max))
                # A tuple stays if nothing put in before it has a smaller key.
                early = np.flatnonzero(key[1:] > least[:-1])
                if len(early):
                    n = int(early[0]) + 1
                    key, pos, rows, put, char, new = (x[:n] for x in (key, pos, rows, put, char, new))
            lcp = self._prefixes(key, pos, rows["lcp"]) if self.cap else rows["lcp"]
            out = np.flatnonzero(put)
            shared = self._induced(lcp, out, char[out]) if self.cap else np.zeros(len(out), np.int16)
            late = (key & 1).astype(bool)
            self.queue.advance(len(pos))
            self.queue.put(new[out], pos[out] - 1, shared)
            yield pos, lcp, ~late
        self.queue.close()

    def _prefixes(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """Common prefix of each tuple with the one before it in the scan."""
        first_key, first_pos = self.last if self.last is not None else (-2, 0)
        was_key, was_pos = np.concatenate(([first_key], key[:-1])), np.concatenate(([first_pos], pos[:-1]))
        out = np.where(was_key >> 1 == key >> 1, lcp, 0).astype(np.int16)
        for i in np.flatnonzero((was_key >> 1 == key >> 1) & (was_key != key)).tolist():
            out[i] = min(self._run(int(was_pos[i])), self._run(int(pos[i])))
        self.last = int(key[-1]), int(pos[-1])
        return out

    def _run(self, pos: int) -> int:
        """Length of the run of one character at a position, capped."""
        part = np.asarray(self.text[pos:pos + self.cap])
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def _induced(self, lcp: np.ndarray, out: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Common prefix of each new tuple with the last one put in under its character."""
        n = len(lcp)
        padded = np.append(lcp, np.iinfo(np.int16).max).astype(np.int16)
        order = np.argsort(char, kind="stable")  # of a small type at the level of bytes, sorted by radix
        heads = np.flatnonzero(np.diff(char[order].astype(np.int64), prepend=-1))
        groups = len(heads)
        size = np.diff(np.append(heads, len(order)))
        # For each character: from the batch's start to its first source, between sources, and to the batch's end.
        at = np.full(len(order) + 2 * groups, n, np.int64)
        begin = heads + 2 * np.arange(groups)
        at[begin] = 0
        inner = np.arange(len(order)) + 2 * np.repeat(np.arange(groups), size) + 1
        at[inner] = out[order] + 1
        least = np.minimum.reduceat(padded, at).astype(np.int64)
        own = char[order[heads]].astype(np.int64)
        least[begin] = np.minimum(least[begin], self.since[own])
        shared = np.empty(len(order), np.int64)
        shared[order] = least[inner - 1]
        self.since = np.minimum(self.since, int(lcp.min()) if n else self.since)
        self.since[own] = least[begin + size]
        return np.minimum(shared + 1, self.cap).astype(np.int16)


def _induce(text, types, start, lcp, most, cap, folder, name, limit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes from the largest down, from the sorted left-most ones: (positions, common prefixes, whether of type S)."""
    up = _Scan(text, types, False, False, most, cap, folder, f"{name}-up", limit)
    for i in range(0, len(start), BATCH):
        up.start(start[i:i + BATCH], lcp[i:i + BATCH])
    log = os.path.join(folder, f"{name}-sorted")
    row = np.dtype([("pos", _number(len(text))), ("lcp", np.int16)])
    n = 0
    with open(log, "wb") as out:
        for pos, shared, is_new in up.batches():
            rows = np.empty(int(is_new.sum()), row)
            # Within a character the scan starts with what it puts in, so these neighbours were neighbours in it.
            rows["pos"], rows["lcp"] = pos[is_new], shared[is_new]
            rows.tofile(out)
            n += len(rows)
    down = _Scan(text, types, True, True, most, cap, folder, f"{name}-down", limit)
    following = np.zeros(1, np.int16)
    for end in range(n, 0, -BATCH):
        begin = max(0, end - BATCH)
        rows = np.fromfile(log, row, end - begin, offset=begin * row.itemsize)
        # Downwards the neighbour is the next larger one, whose common prefix was noted with that one.
        down.start(rows["pos"][::-1], np.concatenate((rows["lcp"][1:], following))[::-1])
        following = rows["lcp"][:1]
    os.remove(log)
    yield from down.batches()


def _in_memory(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in suffix order by doubling, settled to ``depth`` characters."""
    n = len(text)
    rank = np.unique(np.asarray(text), return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth and n > 1 and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
        k *= 2
        if k >= n:
            break
    return np.argsort(rank, kind="stable")


def _names(text, sorted_starts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Name of each left-most substring, in text order; equal substrings have equal names."""
    ends = np.append(starts[1:], len(text) - 1) + 1
    one, two = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    piece = NAMED_AT_ONCE
    for i in range(0, len(starts), piece):
        begin, end = starts[i:i + piece], ends[i:i + piece]
        # Neighbours overlap in one character, which the first hash leaves to the second.
        base = int(begin[0])
        part = np.asarray(text[base:int(end[-1])]).astype(np.uint64) + np.uint64(1)
        inside = np.arange(len(part)) - np.repeat(begin - base, np.append(np.diff(begin), len(part) - (begin[-1] - base)))
        power = np.full(int(inside.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        scaled = part * np.multiply.accumulate(power)[inside]
        scaled[-1] = 0
        one[i:i + piece] = np.add.reduceat(scaled, begin - base)
        two[i:i + piece] = part[end - 1 - base] * np.uint64(0xD6E8FEB86659FD93) + (end - begin).astype(np.uint64)
    where = np.searchsorted(starts, sorted_starts)
    differs = np.ones(len(where), bool)
    differs[1:] = (one[where[1:]] != one[where[:-1]]) | (two[where[1:]] != two[where[:-1]])
    names = np.empty(len(starts), np.int64)
    names[where] = np.cumsum(differs) - 1
    return names


def _sorted_starts(text, types, most, depth, folder, level, limit, base) -> np.ndarray:
    """Left-most S positions in the order of their suffixes."""
    starts = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    if len(starts) < 2:
        return starts
    zero = np.zeros(len(starts), np.int16)
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    parts = [pos[is_start[pos]] for pos, _, is_s in _induce(text, types, starts, zero, most, 0, folder, f"{level}-names", limit)]
    ordered = np.concatenate(parts)[::-1]
    # The last position is not put in by a scan; its suffix is the smallest.
    ordered = np.concatenate(([len(text) - 1], ordered)) if len(ordered) < len(starts) else ordered
    names = _names(text, ordered, starts)
    if names.max() == len(names) - 1:
        return ordered
    return starts[sort_suffixes(names, depth, folder, level + 1, limit, base)]


def sort_suffixes(text, depth: int, folder: str, level: int = 0, limit: int = LIMIT, base: int = BASE) -> np.ndarray:
    """Positions in suffix order. The last character must be the smallest one and occur once."""
    if len(text) <= base:
        return _in_memory(text, depth)
    types, most = suffix_types(text), int(text.max())
    starts = _sorted_starts(text, types, most, depth, folder, level, limit, base)
    parts = [pos for pos, _, _ in _induce(text, types, starts, np.zeros(len(starts), np.int16), most, 0, folder, str(level), limit)]
    ordered = np.concatenate(parts)[::-1]
    return np.concatenate(([len(text) - 1], ordered)) if len(ordered) < len(text) else ordered


def _common(text, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffixes a and b, capped."""
    n = len(text)
    out = np.zeros(len(a), np.int16)
    going = np.arange(len(a))
    for step in range(cap):
        x, y = a[going] + step, b[going] + step
        inside = (x < n) & (y < n)
        going = going[inside]
        going = going[np.asarray(text[x[inside]]) == np.asarray(text[y[inside]])]
        if not len(going):
            break
        out[going] += 1
    return out


def sorted_with_prefixes(
    text, cap: int, folder: str, limit: int = LIMIT, base: int = BASE
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the position before, at most ``cap``) of all suffixes from the largest down.

    The last character must be the smallest one and occur once. Suffixes that agree in ``cap`` characters may come in any order.
    """
    types, most = suffix_types(text), int(text.max())
    starts = _sorted_starts(text, types, most, 2 * cap, folder, 0, limit, base)
    shared = np.zeros(len(starts), np.int16)
    for i in range(1, len(starts), BATCH):
        shared[i:i + BATCH] = _common(text, starts[i:i + BATCH], starts[i - 1:i - 1 + len(starts[i:i + BATCH])], cap)
    for pos, lcp, _ in _induce(text, types, starts, shared, most, cap, folder, "0", limit):
        yield pos, lcp
