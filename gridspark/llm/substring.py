"""Substring dedup: repeated fixed-length word windows, by Rabin-Karp hashes counted over all documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BUCKET_BYTES, PACKED, Rolling, bucket_count, deltas, id_array, integer_id, numbered, packed, part_of, runs, shipped, unpacked, unshipped, without_columns, word_hashes

#: Two independent odd multipliers: the first hash tells windows apart, the second deals them to buckets.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words whose windows one flush of a map task holds.
FLUSH_WORDS = 2_000_000
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def window_blob(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> bytes:
    """Windows of one bucket, ordered by (doc, pos): hashes, a row per document, and steps between positions."""
    starts, ends = runs(doc)
    own = doc[starts]
    step = np.diff(pos, prepend=np.int32(0))
    step[starts] = pos[starts]
    wide = step >= 65_535
    short = np.where(wide, 65_535, step).astype(np.uint16)
    return packed(h, deltas(ids[own]), tags[own], (ends - starts).astype(np.uint32), short, step[wide].astype(np.int32))


def window_unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, id, tag, pos) of each window."""
    h, ids, tags, counts, short, wide = unpacked(raw, np.uint64, np.int64, np.uint32, np.uint32, np.uint16, np.int32)
    step = short.astype(np.int64)
    step[short == 65_535] = wide
    ids = np.cumsum(ids)
    counts = counts.astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    pos = total - np.repeat(total[first] - step[first], counts)
    return h, np.repeat(ids, counts), np.repeat(tags, counts), pos


def mark_rows(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Window starts to remove, one payload per partition of their documents."""
    part = part_of(ids, parts)
    order = np.lexsort((pos, tags, ids, part))
    ids, tags, pos, part = ids[order], tags[order], pos[order].astype(np.int32), part[order]
    for a, b in zip(*runs(part), strict=True):
        doc = np.zeros(b - a, np.int64)
        np.cumsum((ids[a + 1 : b] != ids[a : b - 1]) | (tags[a + 1 : b] != tags[a : b - 1]), out=doc[1:])
        starts, ends = runs(doc)
        step = np.diff(pos[a:b], prepend=np.int32(0))
        step[starts] = pos[a:b][starts]
        yield int(part[a]), packed(deltas(ids[a:b][starts]), tags[a:b][starts], (ends - starts).astype(np.uint32), step.astype(np.int32))


def marks_by_document(payloads: list[bytes]) -> dict[tuple[int, int], list[np.ndarray]]:
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for raw in payloads:
        ids, tags, counts, step = unpacked(raw, np.int64, np.uint32, np.uint32, np.int32)
        cut = np.cumsum(counts.astype(np.int64))
        for doc, tag, a, b in zip(np.cumsum(ids).tolist(), tags.tolist(), (cut - counts).tolist(), cut.tolist(), strict=True):
            found.setdefault((doc, tag), []).append(np.cumsum(step[a:b]))
    return found


def later(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions whose hash has an occurrence of a smaller key."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return np.zeros(0, np.int64)
    inside = np.zeros(len(h), bool)
    inside[1:] |= same
    inside[:-1] |= same
    at = order[inside]
    at = at[np.lexsort((key[at], h[at]))]
    starts, ends = runs(h[at])
    least = np.repeat(key[at][starts], ends - starts)
    return at[key[at] > least]


def _windows(width: int, buckets: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = [Rolling(b) for b in BASES]
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:2])
            ids, tags = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint32)
            n = [max(0, len(x[2]) - width + 1) for x in held]
            h = np.concatenate([rolling[0].windows(x[2], width) for x in held])
            bucket = (np.concatenate([rolling[1].windows(x[2], width) for x in held]) >> np.uint64(24)) % np.uint64(buckets)
            doc = np.repeat(np.arange(len(held), dtype=np.int32), n)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
            # Identical rows share a rank, so that they aren't each other's earlier occurrence.
            rank = np.zeros(len(held), np.int64)
            np.cumsum((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]), out=rank[1:])
            gone = later(h, rank[doc] << 32 | pos)
            # What has an earlier occurrence in this flush is settled; only the first goes to its bucket.
            yield from _rows((part % buckets, 1, raw) for part, raw in mark_rows(ids[doc[gone]], tags[doc[gone]], pos[gone], parts))
            keep = np.ones(len(h), bool)
            keep[gone] = False
            h, bucket, doc, pos = h[keep], bucket[keep].astype(np.int32), doc[keep], pos[keep]
            order = np.argsort(bucket, kind="stable")
            h, bucket, doc, pos = h[order], bucket[order], doc[order], pos[order]
            yield from _rows((int(bucket[a]), 0, window_blob(h[a:b], doc[a:b], pos[a:b], ids, tags)) for a, b in zip(*runs(bucket), strict=True))

        for batch in batches:
            for doc, tag, text in zip(id_array(batch.column(0)).tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if len(words) < width:
                    continue
                held.append((doc, tag, word_hashes(words)))
                size += len(words)
                if size >= FLUSH_WORDS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return kernel


def _rows(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary())], ["bucket", "kind", "payload"])


def _counted(parts: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        kinds, raws = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        out = []
        for kind, raw in zip(kinds, raws, strict=True):
            if kind == 1:
                ids, tags, counts, step = unpacked(raw, np.int64, np.uint32, np.uint32, np.int32)
                out.append((int(part_of(ids[:1], parts)[0]), raw))
        blobs = [window_unblob(raw) for kind, raw in zip(kinds, raws, strict=True) if kind == 0]
        if blobs:
            h, ids, tags, pos = (np.concatenate(x) for x in zip(*blobs, strict=True))
            del blobs
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            inside = np.zeros(len(h), bool)
            inside[order[1:][same]] = inside[order[:-1][same]] = True
            h, ids, tags, pos = h[inside], ids[inside], tags[inside], pos[inside]
            order = np.lexsort((pos, tags, ids))
            key_ = np.zeros(len(h), np.int64)
            if len(h):
                step = (ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1]) | (pos[order][1:] != pos[order][:-1])
                rank = np.concatenate([[0], np.cumsum(step)])
                key_[order] = rank
            gone = later(h, key_)
            out += mark_rows(ids[gone], tags[gone], pos[gone], parts)
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "payload": pa.array([r for _, r in out], pa.binary())})

    return kernel


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of starts; the maximal removal intervals are its runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, keep_text: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove every word that a repeated window covers; all columns of df stay.

    Words are runs of characters other than ASCII white space; a window is
    ``width`` consecutive words of one text. A word is removed if a window that
    covers it has the same words as a window of a smaller id, or of the same id
    at an earlier start. Ids must be integers. Added columns (replacing any of
    the same names, in capitals or not): n_words, n_removed, removed (array of {start, end}, maximal intervals of
    word positions), kept_sha256 (SHA-256 of the kept words joined by one
    space). With keep_text, text_col becomes the text without the removed words:
    unchanged where nothing is removed, else the kept stretches as written.

    Null and empty texts have no words and stay as they are. Identical rows
    (same id and text) count as one document. Rows that share an id but not a
    text are ordered by CRC-32 of the text. A null id is smaller than any other.

    One shuffle carries every window's 64-bit hash and place, in buckets dealt
    by a second, independent hash, so the bits that tell windows apart grow with
    the number of buckets; windows that repeat within one flush of a map task
    are settled there and sent once, so a passage that a third of all documents
    share reaches its bucket once per flush. Payloads are counted in the bucket
    by sorting. A second shuffle brings the documents, compressed, to their marks.
    A bucket holds the windows of about ``bucket_bytes`` of text and has a task of
    its own. A payload holds what one flush sends to one bucket; there are at most
    as many as windows.
    """
    made = {"n_words": "bigint", "n_removed": "bigint", "removed": "array<struct<start:int,end:int>>", "kept_sha256": "string"}
    base = without_columns(df, made)
    at_id, at_text = (f"c{base.columns.index(c)}" for c in (id_col, text_col))
    integer_id(base, id_col)
    rows = numbered(base)
    buckets = bucket_count(rows, at_text, bucket_bytes)
    tag = F.crc32(F.col(at_text).cast("binary"))
    place = rows.select(F.col(at_id).cast("long").alias("id"), tag.alias("tag"), F.col(at_text).alias("text"))
    windows = place.mapInArrow(_windows(width, buckets, buckets), "bucket int, kind int, payload binary").repartitionById(buckets, F.col("bucket"))
    marks = windows.groupBy("bucket").applyInArrow(_counted(buckets), PACKED).repartitionById(buckets, F.col("part"))
    docs = shipped(rows.withColumn("tag", tag), at_id, buckets)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), *(f"{k} {v}" for k, v in made.items())])
    names, arrow = rows.columns, to_arrow_schema(rows.schema)

    def kernel(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = marks_by_document(right.column("payload").to_pylist())
        tables = [_removed(table, found, names, at_id, at_text, width, keep_text) for table in unshipped(left.column("payload"))]
        return pa.concat_tables(tables) if tables else _removed(None, {}, names, at_id, at_text, width, keep_text, base_schema=arrow)

    return docs.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(kernel, schema).toDF(*base.columns, *made)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _removed(table: pa.Table | None, found: dict, names: list[str], id_col: str, text_col: str, width: int, keep_text: bool, base_schema: pa.Schema | None = None) -> pa.Table:
    if table is None:
        table = base_schema.append(pa.field("tag", pa.int64())).empty_table()
    n_words, n_removed, spans, digests, texts = [], [], [], [], []
    for doc, tag, text in zip(id_array(table.column(id_col)).tolist(), table.column("tag").to_pylist(), table.column(text_col).to_pylist(), strict=True):
        raw = (text or "").encode()
        words = raw.split()
        starts = found.get((doc, tag if tag is not None else 0))
        n_words.append(len(words))
        if starts is None:
            n_removed.append(0)
            spans.append([])
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            texts.append(text)
            continue
        gone = covered(np.concatenate(starts), width, len(words))
        cut = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
        n_removed.append(int(gone.sum()))
        spans.append([{"start": a, "end": b} for a, b in zip(cut[::2], cut[1::2], strict=True)])
        digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
        texts.append(_cut(raw, cut) if keep_text else text)
    columns = [pa.array(texts, table.column(c).type) if c == text_col else table.column(c) for c in names]
    new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, SPANS), pa.array(digests, pa.string())]
    return pa.table([*columns, *new], names=[*names, "n_words", "n_removed", "removed", "kept_sha256"])


def _cut(raw: bytes, cut: list[int]) -> str:
    """raw without the word intervals that cut bounds, and without the white space that follows each."""
    begins = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for a, b in zip(cut[::2], cut[1::2], strict=True):
        out.append(raw[at : begins[a]])
        at = begins[b]
    return b"".join([*out, raw[at:]]).decode()


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """df's own columns, whatever their names, with text_col less the words of repeated windows; a text that loses all its words goes."""
    at = lambda c: f"c{df.columns.index(c)}"
    out = repeated_windows(numbered(df), at(id_col), at(text_col), width).where("n_removed = 0 or n_removed < n_words")
    return out.select(*numbered(df).columns).toDF(*df.columns)
