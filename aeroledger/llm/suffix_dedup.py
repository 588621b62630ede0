"""Removal of repeated byte strings: external induced suffix sorting of shards.

A text is UTF-8 bytes. Every string of ``LENGTH`` bytes that also starts
earlier (in a smaller document, or earlier in the same one) is removed.

Equal strings must meet in one shard. Each window of ``LENGTH`` bytes has an
anchor, the least hashed ``GRAM``-gram in it, so equal windows have equal
anchors, and anchors deal windows to shards. Successive windows with one anchor
form a segment. Anchors that occur once are left out, by a Bloom filter of
fixed size over those that do not; what it lets through wrongly costs time only.
Equal segments become one class with its earliest occurrence, so a passage that
a third of all documents share is one entry. The anchor
lies in one of ``ZONES`` zones of a window, and two classes that share a window with
their anchor in a zone agree in all bytes that these windows have in common; so a
class keeps the windows of zones in which it agrees with another one, if any. What
is left of a shard is laid end to end and suffix-sorted with common prefixes (see ``induced_sort``); a run of neighbours that
agree in ``LENGTH`` bytes is one window, kept only at its earliest occurrence. An anchor of more than ``CROWDED`` classes is dealt to
several shards by the hash of each window.

Occurrences are never stored: a document finds its segments again when it is
cut, and loses those that are not the earliest of their class. So only classes
are shuffled back to documents.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing;
rows with the same id and text are one document and each gets its result; with
the same id, documents are ordered by a hash of their text; a null id comes
last; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..workspace import materialise
from .bloom import filter_of, in_filter
from .induced_sort import sorted_with_prefixes
from .scratch import BATCH_ROWS, small_batches
from .text import bytes_of, mix, sliced

LENGTH, GRAM = 100, 24
#: Windows are taken in pieces of so many bytes.
PIECE = 1 << 18
#: Bytes of classes in a shard, and classes of an anchor from which on it is split.
SHARD_BYTES, CROWDED = 1 << 20, 50_000
#: Zones of a window in which its anchor may begin, and where they begin.
ZONES = 11
ZONE_STARTS = [i * (LENGTH - GRAM + 1) // ZONES for i in range(ZONES + 1)]
_LAST_ID = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on: a polynomial, put together from runs of doubled length."""
    # A value times the factor of a width makes room for that many more bytes.
    widths, size, factor = {1: data.astype(np.uint64) + np.uint64(1)}, 1, {1: int(_P)}
    while 2 * size <= GRAM:
        half = widths[size]
        widths[2 * size] = half[:len(half) - size] * np.uint64(factor[size]) + half[size:]
        factor[2 * size] = factor[size] ** 2 % (1 << 64)
        size *= 2
    out, done = widths[size], size
    while done < GRAM:
        step = max(w for w in widths if w <= GRAM - done)
        more = widths[step][done:]
        n = min(len(out), len(more))
        out = out[:n] * np.uint64(factor[step]) + more[:n]
        done += step
    return mix(out)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` successive values."""
    n = len(values)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, row, place): texts or overlapping parts of long ones, of about PIECE bytes together.

    Part i is the bytes from starts[i] to starts[i + 1], belongs to ``row`` and begins at byte ``place`` of it.
    """
    data, at = bytes_of(column)
    parts, rows, places, size = [], [], [], 0
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for place in range(0, max(1, b - a - LENGTH + 1), PIECE):
            part = data[a + place:min(b, a + place + PIECE + LENGTH - 1)]
            if len(part) < LENGTH:
                continue
            parts.append(part)
            rows.append(row)
            places.append(place)
            size += len(part)
            if size >= PIECE:
                yield _joined(parts, rows, places)
                parts, rows, places, size = [], [], [], 0
    if parts:
        yield _joined(parts, rows, places)


def _joined(parts, rows, places):
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return np.concatenate(parts), starts, np.array(rows), np.array(places)


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, part, first window, number of windows, hash of the segment's bytes and anchor, bytes before the anchor) of each segment."""
    n = len(data)
    grams = gram_hashes(data)
    # The low bits hold the position, so of equal grams the first is the least.
    places = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_least(places, LENGTH - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    part = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:len(at)]
    inside = np.arange(len(at)) + LENGTH <= starts[part + 1]
    window = np.flatnonzero(inside)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (np.diff(at[window]) != 0) | (np.diff(part[window]) != 0)
    first = window[fresh]
    count = np.diff(np.append(np.flatnonzero(fresh), len(window)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=sums[1:])
    end = first + count + LENGTH - 1
    own = (sums[end] - sums[first]) * _powers(_P_INVERSE, n)[first]
    offset = at[first] - first
    own = mix(own + (count * 4096 + offset).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return grams[at[first]], part[first], first, count, own, offset


def _anchors(texts: DataFrame) -> DataFrame:
    def find(batches):
        for batch in batches:
            for data, starts, _, _ in pieces(batch.column(0)):
                # Shorter numbers pass the shuffle in fewer bytes; the filter allows for wrong matches anyway.
                short = segments(data, starts)[0] >> np.uint64(24)
                yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64))], ["anchor"])

    return texts.select("text").mapInArrow(find, "anchor bigint")


def repeated_anchors(texts: DataFrame) -> np.ndarray:
    """Filter of the anchors that occur more than once, by their high bits."""
    return filter_of(_anchors(texts).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))


def _kept_segments(column: pa.Array, repeated: np.ndarray):
    """(bytes, row, place in the row's text, anchor, first byte, windows, hash, bytes before the anchor) of segments whose anchor is in the filter."""
    for data, starts, rows, places in pieces(column):
        anchor, part, first, count, own, offset = segments(data, starts)
        kept = np.flatnonzero(in_filter(repeated, (anchor >> np.uint64(24)).view(np.int64)))
        part, first = part[kept], first[kept]
        yield data, rows[part], first - starts[part] + places[part], anchor[kept], first, count[kept], own[kept], offset[kept]


def _occurrences(texts: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(anchor, segment, doc, tie, first, windows) of segments whose anchor occurs more than once."""
    shared = texts.sparkSession.sparkContext.broadcast(repeated)

    def find(batches):
        for batch in batches:
            doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for _, row, place, anchor, _, count, own, _ in _kept_segments(batch.column(0), shared.value):
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), pa.array(doc[row]), pa.array(tie[row]),
                    pa.array(place), pa.array(count.astype(np.int32)),
                ], ["anchor", "segment", "doc", "tie", "first", "windows"])

    return texts.select("text", "doc", "tie").mapInArrow(
        find, "anchor bigint, segment bigint, doc bigint, tie bigint, first bigint, windows int")


def _at(doc: np.ndarray, tie: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for a place in a document."""
    return mix(mix(doc.astype(np.uint64) + np.uint64(1)) + mix(tie.astype(np.uint64)) + first.astype(np.uint64)).view(np.int64)


def _with_bytes(texts: DataFrame, repeated: np.ndarray, classes: DataFrame) -> DataFrame:
    """``classes`` with the bytes of each, read from the text of its earliest occurrence."""
    context = texts.sparkSession.sparkContext

    def number(batches):
        for batch in batches:
            places = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(_at(*places))], ["key"])

    wanted = filter_of(classes.select("doc", "tie", "first").mapInArrow(number, "key bigint"))
    shared = context.broadcast((repeated, wanted))

    def read(batches):
        repeated, wanted = shared.value
        for batch in batches:
            doc, tie = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for data, row, place, anchor, first, count, own, offset in _kept_segments(batch.column(0), repeated):
                here = np.flatnonzero(in_filter(wanted, _at(doc[row], tie[row], place)))
                row, begin = row[here], first[here]
                raw = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + count[here] + LENGTH - 1).tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor[here].view(np.int64)), pa.array(own[here].view(np.int64)), pa.array(doc[row]),
                    pa.array(tie[row]), pa.array(place[here]), pa.array(raw, pa.binary()), pa.array(offset[here]),
                ], ["anchor", "segment", "doc", "tie", "first", "bytes", "offset"])

    found = texts.select("text", "doc", "tie").mapInArrow(
        read, "anchor bigint, segment bigint, doc bigint, tie bigint, first bigint, bytes binary, offset bigint")
    return classes.join(found, ["anchor", "segment", "doc", "tie", "first"])


def _shards(classes: DataFrame, n_shards: int) -> DataFrame:
    """Classes with a shard: one for the anchor, or for crowded anchors one for each window's hash, as classes of one window."""
    columns = ["anchor", "doc", "tie", "first", "windows", "bytes", "offset"]
    by_anchor = F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).alias("shard")
    plain = classes.where(F.col("crowd") <= CROWDED).select(*columns, F.lit(0).alias("skipped"), by_anchor)
    crowded = classes.where(F.col("crowd") > CROWDED).withColumn("skipped", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    window = F.expr(f"substring(bytes, skipped + 1, {LENGTH})")
    split = crowded.select(
        "anchor", "doc", "tie", "first", F.lit(1).alias("windows"), window.alias("bytes"),
        (F.col("offset") - F.col("skipped")).alias("offset"), "skipped",
    ).withColumn("shard", F.pmod(F.xxhash64("anchor", "bytes"), F.lit(n_shards)))
    return plain.unionByName(split)


def _later_windows(shards: DataFrame, n_shards: int) -> DataFrame:
    """(doc, tie, first, again): windows of a class, by the byte where they start, whose string another class has earlier."""

    def sort(batches):
        folder = tempfile.mkdtemp(prefix="shard-")
        try:
            yield from _sorted_shard(batches, folder)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return shards.repartition(n_shards, "shard").select("doc", "tie", "first", "windows", "skipped", "offset", "bytes").mapInArrow(
        sort, "doc bigint, tie bigint, again array<bigint>")


def zone_hashes(data: np.ndarray, at: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each zone and class, hash of the bytes that all windows with the anchor in that zone have; 0 if there is no such window."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), out=sums[1:])
    back, anchor = _powers(_P_INVERSE, len(data) + 1), at[:-1] + offset
    found = np.zeros((ZONES, len(offset)), np.uint64)
    for zone, (low, high) in enumerate(zip(ZONE_STARTS, ZONE_STARTS[1:])):
        size = LENGTH - (high - low - 1)
        there = (offset >= low) & (anchor - low + size <= at[1:])
        start = (anchor - low)[there]
        found[zone, there] = mix((sums[start + size] - sums[start]) * back[start]) | np.uint64(1)
    return found


def in_several(hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once; 0 stands for none."""
    _, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return (count[number] > 1) & (hashes != 0)


def _sorted_shard(batches, folder: str):
    """Lays the classes of a shard that may share a window end to end in a file, sorts its suffixes, and finds the first of each window."""
    tables, zones, offsets = [], [], []
    raw, path = os.path.join(folder, "bytes"), os.path.join(folder, "text")
    with open(raw, "wb") as out:
        for batch in batches:
            data, at = _raw(batch.column(6))
            data.tofile(out)
            *columns, offset = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            zones.append(zone_hashes(data, at, offset))
            offsets.append(offset)
            tables.append(np.stack([*columns, np.diff(at)]))
    if not tables or not sum(t.shape[1] for t in tables):
        return
    agrees = np.stack([in_several(hashes) for hashes in np.concatenate(zones, axis=1)])
    if not agrees.any():
        return
    done, place = 0, 0
    with open(path, "wb") as out:
        for i, (table, offset) in enumerate(zip(tables, offsets)):
            here, size = agrees[:, done:done + len(offset)], table[5]
            done += len(offset)
            data = np.fromfile(raw, np.uint8, int(size.sum()), offset=place)
            place += len(data)
            kept = np.flatnonzero(here.any(axis=0))
            here, offset, size, start = here[:, kept], offset[kept], size[kept], (np.cumsum(size) - size)[kept]
            lowest, highest = here.argmax(axis=0), ZONES - 1 - here[::-1].argmax(axis=0)
            bounds = np.array(ZONE_STARTS)
            low = np.maximum(0, offset - bounds[highest + 1] + 1)
            size = np.minimum(size, offset - bounds[lowest] + LENGTH) - low
            end = np.cumsum(size + 1)
            text = np.ones(end[-1] if len(end) else 0, np.uint16)  # a 1 ends a class
            inside = np.ones(len(text), bool)
            inside[end - 1] = False
            text[inside] = data[np.repeat(start + low - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype(np.uint16) + 2
            text.tofile(out)
            doc, tie, first, _, skipped, _ = table[:, kept]
            tables[i] = np.stack([doc, tie, first + low, size - LENGTH + 1, skipped, size + 1])
        np.zeros(1, np.uint16).tofile(out)
    doc, tie, first, windows, skipped, size = np.concatenate(tables, axis=1)
    first = first + skipped
    begin = np.cumsum(size) - size
    text = np.memmap(path, np.uint16, "r")
    log = os.path.join(folder, "windows")
    number = np.int32 if len(text) < 1 << 31 else np.int64
    entry = np.dtype([("run", number), ("pos", number)])
    run, n = 0, 0
    with open(log, "wb") as out:
        for pos, lcp in sorted_with_prefixes(text, LENGTH, folder):
            runs = run + np.cumsum(lcp < LENGTH)
            run = int(runs[-1]) if len(runs) else run
            owner = np.searchsorted(begin, pos, "right") - 1
            full = pos < begin[np.minimum(owner, len(begin) - 1)] + windows[np.minimum(owner, len(begin) - 1)]
            # Only strings that several suffixes share matter; a run may go on in the next batch, so its ends stay.
            shares = np.ones(len(pos), bool)
            if len(pos) > 2:
                shares[1:-1] = (runs[1:-1] == runs[:-2]) | (runs[1:-1] == runs[2:])
            keep = full & shares
            rows = np.empty(int(keep.sum()), entry)
            rows["run"], rows["pos"] = runs[keep], pos[keep]
            rows.tofile(out)
            n += len(rows)
    later: list[np.ndarray] = []
    rest = np.empty(0, entry)
    piece = 1 << 20
    for i in range(0, n, piece):
        rows = np.concatenate((rest, np.fromfile(log, entry, min(piece, n - i), offset=i * entry.itemsize)))
        cut = len(rows) if i + piece >= n else int(np.searchsorted(rows["run"], rows["run"][-1]))
        rows, rest = rows[:cut], rows[cut:]
        owner = np.searchsorted(begin, rows["pos"], "right") - 1
        place = first[owner] + rows["pos"] - begin[owner]
        order = np.lexsort((place, tie[owner], doc[owner], rows["run"]))
        run_of = rows["run"][order]
        heads = np.flatnonzero(np.diff(run_of, prepend=-1))
        head = order[np.repeat(heads, np.diff(np.append(heads, len(order))))]
        # A repeated row of the table brings the earliest place itself again.
        again = (place[order] != place[head]) | (doc[owner[order]] != doc[owner[head]]) | (tie[owner[order]] != tie[owner[head]])
        later.append(rows["pos"][order[again]].astype(np.int64))
    found = np.sort(np.concatenate([*later, np.empty(0, np.int64)]))
    del text
    owner = np.searchsorted(begin, found, "right") - 1
    start = found - begin[owner] + first[owner]
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(heads[1:], len(owner))
    for i in range(0, len(heads), 10_000):
        part = slice(i, i + 10_000)
        who = owner[heads[part]]
        yield pa.RecordBatch.from_arrays([
            pa.array(doc[who]), pa.array(tie[who]),
            pa.array([start[a:b] for a, b in zip(heads[part].tolist(), ends[part].tolist())], pa.list_(pa.int64())),
        ], ["doc", "tie", "again"])


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def earliest_places(texts: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(doc, tie, firsts, again) by document: segments that are the earliest of their class, and windows of these that go all the same."""
    found = _occurrences(texts, repeated).groupBy("anchor", "segment").agg(
        F.min(F.struct("doc", "tie", "first")).alias("e"), F.first("windows").alias("windows"))
    classes = materialise(found.select("anchor", "segment", "e.doc", "e.tie", "e.first", "windows"), "repeat-classes")
    # A class alone under its anchor has nothing to be compared with.
    crowds = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    rivals = materialise(classes.join(crowds, "anchor"), "repeat-rivals")
    size = rivals.agg(F.coalesce(F.sum(F.col("windows") + LENGTH), F.lit(0))).first()[0]
    n_shards = max(1, math.ceil(size / SHARD_BYTES))
    again = materialise(_later_windows(_shards(_with_bytes(texts, repeated, rivals), n_shards), n_shards), "repeat-windows")
    firsts = classes.select("doc", "tie", "first", F.lit(None).cast("array<bigint>").alias("again"))
    both = firsts.unionByName(again.withColumn("first", F.lit(None).cast("bigint")))
    return both.groupBy("doc", "tie").agg(F.collect_list("first").alias("firsts"), F.flatten(F.collect_list("again")).alias("again"))


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(
        F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(id_col).alias("id"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > reach[:-1]
    return starts[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)]


def _spans(column: pa.Array, repeated: np.ndarray, firsts: pa.Array, again: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, start, end) of byte strings to remove from a batch of texts."""

    def flat(lists):
        lists = pc.fill_null(lists, pa.scalar([], lists.type))
        return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()

    kept_rows, kept = flat(firsts)
    known = np.sort(kept + (kept_rows << 40))  # texts are shorter than 2**31
    row, start = flat(again)
    parts = [(row, start, start + LENGTH)]
    for _, row, place, _, _, count, _, _ in _kept_segments(column, repeated):
        key = place + (row << 40)
        at = np.searchsorted(known, key)
        later = np.ones(len(key), bool)
        later[at < len(known)] = known[at[at < len(known)]] != key[at < len(known)]
        parts.append((row[later], place[later], (place + count + LENGTH - 1)[later]))
    return tuple(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` is the bytes that stay."""
    texts = _keyed(documents, id_col, text_col)
    # What reads texts runs here, in small batches; the caller's action only packs and cuts them.
    with small_batches(documents.sparkSession):
        repeated = repeated_anchors(texts)
        places = earliest_places(texts, repeated)
    kind = dict(documents.dtypes)[id_col]
    shared = texts.sparkSession.sparkContext.broadcast(repeated)

    def pack(batches):  # half the bytes in the shuffle
        packer = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, BATCH_ROWS):
            packed = [packer.compress((t.as_py() or "").encode()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], batch.schema.names)

    packed = texts.mapInArrow(pack, f"text binary, doc bigint, tie bigint, id {kind}")
    joined = packed.join(places, ["doc", "tie"], "left").select("id", "text", "firsts", "again")

    def cut(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in sliced(batches, BATCH_ROWS):
            raws = [unpacker.decompress(t.as_py()) for t in batch.column(1)]
            row, start, end = _spans(pa.array(raws, pa.large_binary()).cast(pa.large_string()), shared.value, batch.column(2), batch.column(3))
            order = np.argsort(row, kind="stable")
            upto = np.searchsorted(row[order], np.arange(len(raws) + 1))
            rows = []
            for i, raw in enumerate(raws):
                mine = order[upto[i]:upto[i + 1]]
                starts, ends = merged(start[mine], end[mine]) if len(mine) else (start[mine], end[mine])
                edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(raw), len(raw) - len(kept), len(starts), kept))
            numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array([r[3] for r in rows], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    made = joined.mapInArrow(cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return made.withColumnRenamed("id", id_col)
