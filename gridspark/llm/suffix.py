"""Byte-substring dedup: maximal repeats from common-prefix intervals of sparse enhanced suffix arrays.

Every window of ``width`` bytes contains an anchor: the position whose
``gram``-byte hash is least in the window (the leftmost of equals). Equal windows have
the same anchor at the same offset, so the suffixes that start at anchors, put
together by the anchor's bytes, are all that repeats of ``width`` bytes need.
Windows of one text with the same anchor are consecutive and form a segment.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from .common import BUCKET_BYTES, PACKED, Rolling, bucket_count, checkpointed, deltas, id_array, integer_id, mixed, numbered, packed, part_of, powers, runs, shipped, squeezed, unpacked, unshipped, unsqueezed, without_columns

BASE = 0x9E3779B97F4A7C15
#: Bytes whose anchors one flush of a map task looks for; a longer text is taken in overlapping blocks.
FLUSH_BYTES = 1 << 21
#: Low bits of a sliding-minimum key hold the position in a flush, the others the gram's hash.
PLACE_BITS = 24
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
#: Segments around one gram that a task takes; of a gram with more, each two chunks of them are a task of their own.
HOT = 1 << 16
#: Such grams that are broadcast at most, 8 bytes each; with very many anchors HOT rises instead.
MOST_HOT = 1 << 20


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i, from prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    grid = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchor_runs(raw: np.ndarray, lengths: np.ndarray, width: int, gram: int, rolling: Rolling, settle: bool = True) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: (gram hash, text number, first window, windows, anchor's offset in the segment)."""
    n = len(raw)
    if n < width:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    h = mixed(rolling.windows(_BYTE[raw], gram))
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((h & ~place) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
    anchor = (least & place).astype(np.int64)
    # Windows that would run over the end of their text are none.
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - width + 1))
    inside = np.concatenate([np.arange(a, a + m - width + 1) for a, m in zip(first.tolist(), lengths.tolist(), strict=True) if m >= width] or [np.zeros(0, np.int64)])
    anchor = anchor[inside]
    cut = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(anchor) else np.zeros(0, bool)
    at = np.flatnonzero(cut)
    count = np.diff(np.append(at, len(anchor)))
    found = h[anchor[at]], text[at], inside[at], count, anchor[at] - inside[at]
    h, text, start, count, offset = _settled(raw, *found, width, gram) if settle else found
    return h, text, start - first[text], count, offset


#: Stands as a segment's offset where its windows all repeat within the text itself; at most so many windows a segment.
WHOLE, MOST_WINDOWS = 0xFFFF, 50_000


def _settled(raw: np.ndarray, h: np.ndarray, text: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments with those of a short period's stretch put together.

    Anchors of one gram at a steady distance d under ``gram`` bytes show that the
    bytes from the first to the end of the last have period d. If that stretch has
    2 * d windows or more, each of them recurs in it. Its first segments, of d windows
    and more, stand for it elsewhere; the others become one, marked WHOLE.
    """
    anchor = start + offset
    d = np.diff(anchor)
    steady = (h[1:] == h[:-1]) & (text[1:] == text[:-1]) & (d < gram)
    lo, hi = runs(np.where(steady, d, -1))
    keep, more = np.ones(len(h), bool), []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if not steady[a] or b - a < 4:
            continue
        step, begin, end = int(d[a]), int(anchor[a]), int(anchor[b]) + gram
        if end - begin - width + 1 < 2 * step or not np.array_equal(raw[begin : end - step], raw[begin + step : end]):
            continue
        whole = np.flatnonzero((start[a : b + 1] >= begin) & (start[a : b + 1] + count[a : b + 1] + width - 1 <= end)) + a
        rest = whole[np.cumsum(count[whole]) - count[whole] >= step]  # those after the first step windows
        if len(rest) > 1:
            keep[rest] = False
            first, last = int(start[rest[0]]), int(start[rest[-1]] + count[rest[-1]])
            more += [(h[a], text[a], s, min(MOST_WINDOWS, last - s), WHOLE) for s in range(first, last, MOST_WINDOWS)]
    if not more:
        return h, text, start, count, offset
    columns = [np.concatenate([x[keep], np.array(y, x.dtype)]) for x, y in zip((h, text, start, count, offset), zip(*more, strict=True), strict=True)]
    order = np.lexsort((columns[2], columns[1]))
    return tuple(c[order] for c in columns)


def _place_blob(tag: np.ndarray, doc: np.ndarray, ids: np.ndarray, tags: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> bytes:
    """Segments in order of (text, start), with tag (a hash, or nothing) for each."""
    a, b = runs(doc)
    step = np.diff(start, prepend=0)
    step[a] = start[a]
    return packed(tag, deltas(ids[doc[a]]), tags[doc[a]], (b - a).astype(np.uint32), step.astype(np.int32), count.astype(np.uint16), offset.astype(np.uint16))


def _place_unblob(raw: bytes) -> tuple[np.ndarray, ...]:
    """(tag, id, text tag, start, windows, offset)."""
    tag, ids, tags, counts, step, count, offset = unpacked(raw, np.uint64, np.int64, np.uint32, np.uint32, np.int32, np.uint16, np.uint16)
    counts = counts.astype(np.int64)
    total = np.cumsum(step.astype(np.int64))
    first = np.cumsum(counts) - counts
    start = total - np.repeat(total[first] - step[first], counts) if len(step) else total
    return tag, np.repeat(np.cumsum(ids), counts), np.repeat(tags, counts), start, count.astype(np.int64), offset.astype(np.int64)


_NO_TAG = np.zeros(0, np.uint64)


def _by_part(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    if not len(ids):
        return
    part = part_of(ids, parts)
    order = np.lexsort((start, tags, ids, part))
    ids, tags, start, count, offset, part = (x[order] for x in (ids, tags, start, count, offset, part))
    doc = np.zeros(len(ids), np.int64)
    np.cumsum((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), out=doc[1:])
    first = runs(doc)[0]
    for a, b in zip(*runs(part), strict=True):
        yield int(part[a]), _place_blob(_NO_TAG, doc[a:b], ids[first], tags[first], start[a:b], count[a:b], offset[a:b])


def _rows(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _anchors(width: int, gram: int, buckets: int, settle: bool = True):
    """documents -> gram hashes by bucket (kind 0), and segments that this flush shows to repeat (kind 1)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASE)
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:3])
            ids, tags, shift = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint32), np.array([x[2] for x in held], np.int64)
            raw = np.frombuffer(b"".join([x[3] for x in held]), np.uint8)
            h, doc, start, count, offset = anchor_runs(raw, np.array([len(x[3]) for x in held], np.int64), width, gram, rolling, settle)
            start = start + shift[doc]
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            again = offset == WHOLE
            again[order[1:][same]] = again[order[:-1][same]] = True
            yield from _rows((part % buckets, 1, blob) for part, blob in _by_part(ids[doc[again]], tags[doc[again]], start[again], count[again], offset[again], buckets)).to_batches()
            # One of each repeated hash still tells its bucket that the hash exists: kind 2, already settled here.
            once, settled = ~again, order[np.concatenate([[True], ~same])] if len(h) else order
            settled = settled[again[settled]]
            bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            out = []
            at = np.flatnonzero(once)
            at = at[np.argsort(bucket[at], kind="stable")]
            for a, b in zip(*runs(bucket[at]), strict=True):
                x = at[a:b]
                out.append((int(bucket[x[0]]), 0, _place_blob(h[x], doc[x], ids, tags, start[x], count[x], offset[x])))
            at = settled[np.argsort(bucket[settled], kind="stable")]
            times = np.diff(np.append(np.flatnonzero(np.concatenate([[True], ~same])), len(h))).astype(np.uint32) if len(h) else np.zeros(0, np.uint32)
            times = dict(zip(h[order[np.concatenate([[True], ~same])]].tolist(), times.tolist(), strict=True)) if len(at) else {}
            for a, b in zip(*runs(bucket[at]), strict=True):
                some = h[at[a:b]]
                out.append((int(bucket[at[a]]), 2, packed(some, np.array([times[x] for x in some.tolist()], np.uint32))))
            yield from _rows(iter(out)).to_batches()

        for batch in batches:
            for doc, tag, text in zip(id_array(batch.column(0)).tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                for at in range(0, max(1, len(raw) - width + 1), FLUSH_BYTES):
                    block = raw[at : at + FLUSH_BYTES + width - 1]
                    if len(block) < width:
                        continue
                    held.append((doc, tag, at, block))
                    size += len(block)
                    if size >= FLUSH_BYTES:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return kernel


def _repeated(parts: int, hot: int):
    """Gram hashes of a bucket -> segments whose gram occurs more than once, by partition of their texts; part -1: grams of more than ``hot`` segments, with how many."""

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        out, blobs, settled, counts = [], [], [], []
        for kind, raw in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if kind == 1:
                ids = unpacked(raw, np.uint64, np.int64)[1]
                out.append((int(part_of(ids[:1], parts)[0]), raw))
            elif kind == 2:
                for x, y in zip(unpacked(raw, np.uint64, np.uint32), (settled, counts), strict=True):
                    y.append(x)
            else:
                blobs.append(_place_unblob(raw))
        alone = [b[0] for b in blobs]
        every = np.concatenate([np.zeros(0, np.uint64), *alone, *settled])
        value, at = np.unique(every, return_inverse=True)
        times = np.bincount(at, np.concatenate([np.zeros(0, np.uint32), *(np.ones(len(x), np.uint32) for x in alone), *counts]), len(value))
        if (times > hot).any():
            out.append((-1, packed(value[times > hot], times[times > hot].astype(np.int64))))
        if blobs:
            h, ids, tags, start, count, offset = (np.concatenate(x) for x in zip(*blobs, strict=True))
            del blobs
            every = np.sort(np.concatenate([h, *settled]))
            many = every[1:][every[1:] == every[:-1]]
            at = np.minimum(np.searchsorted(many, h), max(0, len(many) - 1))
            again = many[at] == h if len(many) else np.zeros(len(h), bool)
            out += _by_part(ids[again], tags[again], start[again], count[again], offset[again], parts)
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "payload": pa.array([r for _, r in out], pa.binary())})

    return kernel


def gram_hashes(grams: np.ndarray) -> np.ndarray:
    """The hash that anchor_runs gives to each row of bytes."""
    up = powers(BASE, grams.shape[1])
    return mixed(np.concatenate([np.zeros(0, np.uint64), *((_BYTE[grams[at : at + 4096]] * up).sum(axis=1, dtype=np.uint64) for at in range(0, len(grams), 4096))]))


def _segments(width: int, gram: int, buckets: int, text_col: str, id_col: str, reach: int | None, hot: dict[int, tuple[int, int]]):
    """Texts and their segments of repeated grams -> segment bytes by bucket of their gram.

    Segments that are equal within the partition are covered whole (kind 1), and
    one of them goes on for comparison, without places. With reach, all go on, with
    so many bytes more on either side.
    hot: chunks and first bucket of each gram that is cut into chunks by the
    segments' bytes; a segment goes to each pair of chunks that has its own.
    """

    def kernel(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = defaultdict(set)  # places that identical rows double count once
        for raw in right.column("payload").to_pylist():
            _, ids, tags, start, count, offset = _place_unblob(raw)
            for row in zip(ids.tolist(), tags.tolist(), start.tolist(), count.tolist(), offset.tolist(), strict=True):
                wanted[row[:2]].add(row[2:])
        found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = defaultdict(list)
        whole: list[tuple[int, int, int, int]] = []
        for table in unshipped(left.column("payload")):
            for doc, tag, text in zip(id_array(table.column(id_col)).tolist(), table.column("tag").to_pylist(), table.column(text_col).to_pylist(), strict=True):
                places = wanted.pop((doc, tag), None)  # identical rows count once
                if places:
                    raw = text.encode()
                    for start, count, offset in places:
                        if offset == WHOLE:
                            whole.append((doc, tag, start, start + count + width - 1))
                            continue
                        before = min(start, reach or 0)
                        # With reach the place of the segment's windows goes in the tag's stead.
                        found[offset + before, raw[start - before : start + count + width - 1 + (reach or 0)]].append((doc, tag if reach is None else before << 16 | count, start - before))
        by_bucket = defaultdict(list)
        hashes = gram_hashes(np.frombuffer(b"".join([raw[o : o + gram] for o, raw in found]), np.uint8).reshape(-1, gram))
        for h, ((offset, raw), places) in zip(hashes.tolist(), found.items(), strict=True):
            if h in hot:
                chunks, base = hot[h]
                k = xxh3_64_intdigest(raw) % chunks
                at = [base + max(k, j) * (max(k, j) + 1) // 2 + min(k, j) for j in range(chunks)]
            else:
                at = [(h >> 20) % buckets]
            rows = [(*place, offset, raw) for place in places]
            if reach is None and len(places) > 1:
                whole += [(doc, tag, start, start + len(raw)) for doc, tag, start in places]
                rows = [(0, 0, -1, offset, raw)]
            for bucket in at:
                by_bucket[bucket] += rows
        out = [(bucket, 0, _segment_blob(rows)) for bucket, rows in by_bucket.items()]
        out += [(part % buckets, 1, blob) for part, blob in span_rows(whole, buckets)]
        return _rows(iter(out))

    return kernel


def _segment_blob(rows: list[tuple[int, int, int, int, bytes]]) -> bytes:
    doc, tag, start, offset, raw = zip(*rows, strict=True)
    head = packed(np.array(doc, np.int64), np.array(tag, np.uint32), np.array(start, np.int32), np.array(offset, np.int32), np.array([len(x) for x in raw], np.int32), np.frombuffer(b"".join(raw), np.uint8))
    return squeezed(head)


def _segment_unblob(raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    doc, tag, start, offset, length, text = unpacked(unsqueezed(raw), np.int64, np.uint32, np.int32, np.int32, np.int32, np.uint8)
    text, end = text.tobytes(), np.cumsum(length.astype(np.int64))
    for d, t, s, o, a, b in zip(doc.tolist(), tag.tolist(), start.tolist(), offset.tolist(), (end - length).tolist(), end.tolist(), strict=True):
        yield d, t, s, o, text[a:b]


def span_rows(spans: list[tuple[int, int, int, int]], parts: int) -> Iterator[tuple[int, bytes]]:
    """(id, tag, start, end) by partition of the id."""
    if not spans:
        return
    ids, tags, start, end = (np.array(x, kind) for x, kind in zip(zip(*spans, strict=True), (np.int64, np.uint32, np.int32, np.int32), strict=True))
    part = part_of(ids, parts)
    order = np.lexsort((start, tags, ids, part))
    for a, b in zip(*runs(part[order]), strict=True):
        x = order[a:b]
        yield int(part[x[0]]), packed(deltas(ids[x]), tags[x], start[x], (end - start)[x])


# -- the enhanced suffix array of one anchor gram -----------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree, bottom-up: (depth, first, last) of each node of depth least or more.

    lcp[i] is the common prefix of suffixes i and i + 1. One stack scan.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                yield d, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def repeats_at(offsets: list[int], texts: list[bytes], width: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Maximal repeats of width bytes or more through the anchor that the given texts share.

    Yields (right extent, members, left extents): the members, numbers of
    texts, agree from the anchor over the right extent and no further as a
    group; a member's left extent is the longest that it shares with another
    member. Members that share a left extent and differ before it are
    neighbours in the order of the reversed left contexts.
    """
    right = [t[o:] for o, t in zip(offsets, texts, strict=True)]
    back = [t[:o][::-1] for o, t in zip(offsets, texts, strict=True)]
    order = sorted(range(len(texts)), key=right.__getitem__)
    lcp = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    for depth, first, last in prefix_intervals(lcp, width - max(map(len, back))):
        members = sorted(order[first : last + 1], key=back.__getitem__)
        shared = [common_prefix(back[a], back[b]) for a, b in zip(members, members[1:], strict=False)]
        extents = [max(x) for x in zip([0, *shared], [*shared, 0], strict=True)]
        if max(extents) + depth >= width:  # else the left extensions are too diverse for a repeat of this width
            yield depth, members, extents


def repeat_groups(depth: int, members: list[int], back: list[bytes], width: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left extent, right extent, members) of each maximal repeat within one interval."""
    shared = [common_prefix(back[a], back[b]) for a, b in zip(members, members[1:], strict=False)]
    need = max(0, width - depth)
    for left, first, last in prefix_intervals(shared, need):
        yield left, depth, members[first : last + 1]


def _covered(width: int, gram: int, parts: int):
    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        groups: dict[bytes, dict[tuple[int, bytes], list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for kind, raw in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if kind == 1:
                out.append((int(part_of(unpacked(raw, np.int64)[0][:1], parts)[0]), raw))
                continue
            for doc, tag, start, offset, text in _segment_unblob(raw):
                groups[text[offset : offset + gram]][offset, text].append((doc, tag, start))
        spans: list[tuple[int, int, int, int]] = []

        def add(places: list[tuple[int, int, int]], a: int, b: int) -> None:
            spans.extend((doc, tag, start + a, start + b) for doc, tag, start in places if start >= 0)

        for group in groups.values():
            # Equal segments are two suffixes, however many they are; those that a partition has settled are one.
            keys = [k for k, places in group.items() for _ in range(min(2, len(places)))]
            if len(keys) < 2:
                continue
            best: dict[tuple[int, bytes, int, int], None] = {}
            for depth, members, extents in repeats_at([o for o, _ in keys], [t for _, t in keys], width):
                for m, left in zip(members, extents, strict=True):
                    if left + depth >= width:
                        best[*keys[m], left, depth] = None
            for offset, text, left, depth in best:
                add(group[offset, text], offset - left, offset + depth)
        out += span_rows(spans, parts)
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "payload": pa.array([r for _, r in out], pa.binary())})

    return kernel


def _merged(width: int, id_col: str, text_col: str, names: list[str], schema: pa.Schema, keep: bool):
    def kernel(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for raw in right.column("payload").to_pylist():
            ids, tags, start, size = unpacked(raw, np.int64, np.uint32, np.int32, np.int32)
            ids = np.cumsum(ids)
            doc = np.zeros(len(ids), np.int64)
            np.cumsum((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), out=doc[1:])
            for a, b in zip(*runs(doc), strict=True):
                found[int(ids[a]), int(tags[a])].append(np.stack([start[a:b], start[a:b] + size[a:b]]))
        tables = [_kept(t, found, id_col, text_col, names, keep) for t in unshipped(left.column("payload"))]
        return pa.concat_tables(tables or [_kept(schema.append(pa.field("tag", pa.int64())).empty_table(), found, id_col, text_col, names, keep)])

    return kernel


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _kept(table: pa.Table, found: dict, id_col: str, text_col: str, names: list[str], keep: bool) -> pa.Table:
    rows = []
    for doc, tag, text in zip(id_array(table.column(id_col)).tolist(), table.column("tag").to_pylist(), table.column(text_col).to_pylist(), strict=True):
        raw = (text or "").encode()
        spans = found.get((doc, tag))
        cut: list[int] = []
        if spans is not None:
            edge = np.zeros(len(raw) + 1, np.int32)
            a, b = np.concatenate(spans, axis=1)
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
            cut = np.flatnonzero(np.diff((np.cumsum(edge[:-1]) > 0).astype(np.int8), prepend=0, append=0)).tolist()
        kept = b"".join([raw[a:b] for a, b in zip([0, *cut[1::2]], [*cut[::2], len(raw)], strict=True)])
        rows.append((len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in zip(cut[::2], cut[1::2], strict=True)], hashlib.sha256(kept).hexdigest(), kept if keep else None))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    new = [pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), SPANS, pa.string(), pa.binary()), strict=True)]
    return pa.table([*(table.column(c) for c in names), *new], names=[*names, "n_bytes", "n_removed", "removed", "kept_sha256", "kept"])


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 64, keep: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of df with n_bytes, n_removed, removed (array of {start, end}), kept_sha256, and kept (binary) on request.

    A byte of a text's UTF-8 form is removed if a string of ``width`` bytes that
    covers it also starts anywhere else, in the same text or another; overlaps
    count, and strings never cross texts. removed holds the maximal intervals.
    Columns of df with these names, in capitals or not, are replaced, all others pass through. Null
    and empty texts have no bytes. Identical rows (same id and text) count as
    one text and each carry its result; rows that share an id but not a text
    are texts of their own, told apart by CRC-32. An empty df gives no rows.
    Ids must be integers.

    Three shuffles carry, in turn: the hashes of all anchors, about one in 70
    bytes; the bytes around anchors that occur more than once; the intervals.
    Texts cross compressed. What repeats within a task is settled there, so the
    anchors and segments of a passage that a third of all texts share reach
    their bucket once per task. A partition holds about ``bucket_bytes`` of text.
    A gram around which more than HOT segments lie is cut into chunks of them, and
    each two chunks are compared in a task of their own.
    """
    made = {"n_bytes": "bigint", "n_removed": "bigint", "removed": "array<struct<start:int,end:int>>", "kept_sha256": "string", "kept": "binary"}
    base = without_columns(df, made)
    at_id, at_text = (f"c{base.columns.index(c)}" for c in (id_col, text_col))
    integer_id(base, id_col)
    rows = numbered(base)
    parts = bucket_count(rows, at_text, bucket_bytes)
    docs, segments = _segment_frames(rows, at_id, at_text, width, gram, parts, bucket_bytes)
    spans = segments.groupBy("bucket").applyInArrow(_covered(width, gram, parts), PACKED).repartitionById(parts, F.col("part"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"{k} {v}" for k, v in made.items())])
    out = docs.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_merged(width, at_id, at_text, rows.columns, to_arrow_schema(rows.schema), keep), schema)
    out = out.toDF(*base.columns, *made)
    return out if keep else out.drop("kept")


def _segment_frames(rows: DataFrame, id_col: str, text_col: str, width: int, gram: int, parts: int, bucket_bytes: int, reach: int | None = None) -> tuple[DataFrame, DataFrame]:
    tag = F.crc32(F.col(text_col).cast("binary"))
    place = rows.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))
    kinds = "bucket int, kind int, payload binary"
    # An anchor takes a byte at least. Groups whose members are to be listed can't be cut.
    limit = max(HOT, parts * bucket_bytes // MOST_HOT) if reach is None else 1 << 62
    anchors = place.mapInArrow(_anchors(width, gram, parts, reach is None), kinds).repartitionById(parts, F.col("bucket"))
    repeated = checkpointed(anchors.groupBy("bucket").applyInArrow(_repeated(parts, limit), PACKED))
    hot, base = {}, parts
    for (raw,) in repeated.where("part < 0").select("payload").collect():  # MOST_HOT grams at most
        for h, n in sorted(zip(*(x.tolist() for x in unpacked(raw, np.uint64, np.int64)), strict=True)):
            chunks = -(-2 * n // limit)
            hot[h] = chunks, base
            base += chunks * (chunks + 1) // 2
    docs = shipped(rows.withColumn("tag", tag), id_col, parts)
    of = repeated.where("part >= 0").repartitionById(parts, F.col("part"))
    segments = docs.groupBy("part").cogroup(of.groupBy("part")).applyInArrow(_segments(width, gram, parts, text_col, id_col, reach, hot), kinds)
    return docs, segments.repartitionById(base, F.col("bucket"))


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 64, reach: int = 4096, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(length int, occurrences array of {id, start}): maximal repeats of ``width`` bytes or more, each once, with all occurrences.

    A repeat's occurrences have equal bytes, and neither a byte before nor a byte
    after is equal in all of them. Each anchor's interval tree looks ``reach`` bytes
    beyond its segment. A longer repeat comes out of several trees in pieces, and
    pieces with the same occurrences are joined where they overlap; it stays in
    pieces only where more than 2 * reach bytes of it recur in further places.
    ``reach`` is under 65,536. Null and empty texts have no repeats; ids must be integers; rows that are equal
    in id and text count once; an empty df gives no rows. All occurrences of a
    repeat are in one row and are listed by one task.
    """
    parts = bucket_count(df, text_col, bucket_bytes)
    rows = df.select(integer_id(df, id_col).alias("id"), F.col(text_col).alias("text"))
    _, segments = _segment_frames(rows, "id", "text", width, gram, parts, bucket_bytes, reach)

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        groups = defaultdict(list)
        for raw in table.column("payload").to_pylist():
            for doc, tag, start, offset, text in _segment_unblob(raw):
                groups[text[offset : offset + gram]].append((doc, start, offset, text, tag >> 16, tag & 0xFFFF))
        out = []
        for group in groups.values():
            if len(group) < 2:
                continue
            offsets, texts = [g[2] for g in group], [g[3] for g in group]
            back = [t[:o][::-1] for o, t in zip(offsets, texts, strict=True)]
            for depth, members, _ in repeats_at(offsets, texts, width):
                for left, right, some in repeat_groups(depth, members, back, width):
                    # Every occurrence has this anchor if a window inside the repeat has it; else another anchor tells of the repeat.
                    if not any(max(first, offsets[m] - left) <= min(first + count - 1, offsets[m] + right - width) for m in some for first, count in [group[m][4:]]):
                        continue
                    out.append((left + right, sorted(({"id": group[m][0], "start": group[m][1] + offsets[m] - left} for m in some), key=lambda x: (x["id"], x["start"]))))
        return pa.table({"length": pa.array([x[0] for x in out], pa.int32()), "occurrences": pa.array([x[1] for x in out], pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int64())])))})

    found = segments.where("kind = 0").groupBy("bucket").applyInArrow(kernel, "length int, occurrences array<struct<id:bigint,start:bigint>>")
    begin = F.get("occurrences", 0)["start"]
    steps = F.transform("occurrences", lambda x: F.struct(x["id"], (x["start"] - begin).alias("step")))
    pieces = found.select("length", "occurrences", begin.alias("begin"), (begin + F.col("length")).alias("end"), F.get("occurrences", 0)["id"].alias("first"), steps.alias("steps"))
    w = Window.partitionBy("first", "steps").orderBy("begin", "end")
    ahead = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("island", F.sum(F.when(F.col("begin") <= F.coalesce(ahead, F.lit(-1)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("first", "steps", "island").agg(F.min_by("occurrences", "begin").alias("occurrences"), (F.max("end") - F.min("begin")).cast("int").alias("length"))
    return whole.select("length", "occurrences")
