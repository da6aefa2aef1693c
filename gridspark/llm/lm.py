"""Stupid-backoff scores: n-gram counts by hash partition, joined back to each partition's documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, checkpointed, deltas, integer_id, mixed, packed, runs, shipped, squeezed, unpacked, unshipped, unsqueezed, word_hashes

#: Scores are sums of natural logarithms, each rounded to this part of one, so their order doesn't matter.
UNIT = 1_000_000
#: Hash ranges of the count table for each partition of documents, so that a range takes less memory than a partition.
RANGES = 4
#: Bytes of text in a partition of documents.
PART_BYTES = 12 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _logs(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log(x) * UNIT).astype(np.int64)


def gram_hashes(before: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that end at each position, 0 where the text has fewer before it.

    words and before are the hashes of orders 1 and n - 1 over texts laid end to end.
    """
    out = np.zeros(len(words), np.uint64)
    out[1:] = mixed((before[:-1] ^ np.uint64(n)) * _STEP + words[1:])
    return out


class _Part:
    """The words of one partition's documents, laid end to end."""

    def __init__(self, payloads: pa.ChunkedArray) -> None:
        ids, n_words, words = [pa.array([], pa.int64())], [], [np.zeros(0, np.uint64)]
        for table in unshipped(payloads):
            ids += table.column("id").chunks
            for text in table.column("text").to_pylist():
                words.append(word_hashes((text or "").encode().lower().split()))
                n_words.append(len(words[-1]))
        self.ids, self.n_words, self.words = pa.chunked_array(ids), np.array(n_words, np.int64), np.concatenate(words)
        self.at = (np.arange(len(self.words)) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)).astype(np.int32)
        self.doc = np.repeat(np.arange(len(n_words), dtype=np.int32), self.n_words)

    def orders(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per order n: which positions end n words of their text, and those n-grams' hashes. One order is held at a time."""
        grams = self.words
        for n in range(1, order + 1):
            if n > 1:
                grams = gram_hashes(grams, self.words, n)
            has = self.at >= n - 1
            yield has, grams[has]


def _places(grams: np.ndarray) -> np.ndarray:
    """Where each hash is among the sorted distinct ones."""
    order = np.argsort(grams)
    new = np.zeros(len(grams), bool)
    new[1:] = grams[order[1:]] != grams[order[:-1]]
    out = np.empty(len(grams), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _within(place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each n-gram, given by place, occurs in its own document."""
    key = doc.astype(np.int64) << 32 | place
    order = np.argsort(key, kind="stable")
    starts, ends = runs(key[order])
    out = np.empty(len(key), np.uint32)
    out[order] = np.repeat((ends - starts).astype(np.uint32), ends - starts)
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The range of hashes that each belongs to; it rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _requests(order: int, buckets: int):
    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        part = _Part(table.column("payload"))
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(lambda: [none] * order)
        for k, (_, grams) in enumerate(part.orders(order)):
            distinct, counts = np.unique(grams, return_counts=True)
            bucket = _bucket(distinct, buckets)
            for i, j in zip(*runs(bucket), strict=True):
                asked[int(bucket[i])][k] = deltas(distinct[i:j]), counts[i:j].astype(np.uint32)
        payload = [squeezed(packed(*(h for h, _ in x), *(n for _, n in x))) for x in asked.values()]
        return pa.table({"bucket": pa.array(list(asked), pa.int32()), "part": pa.array([key[0].as_py()] * len(asked), pa.int32()), "payload": pa.array(payload, pa.binary())})

    return kernel


def _counted(order: int):
    """Add up each n-gram's counts over all partitions; reply in the order asked."""

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        raws = table.column("payload").to_pylist()
        asked = [unpacked(unsqueezed(raw), *[np.uint64] * order, *[np.uint32] * order) for raw in raws]
        replies: list[list[np.ndarray]] = [[] for _ in raws]
        for k in range(order):
            hashes = [np.cumsum(a[k]) for a in asked]
            distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(place, np.concatenate([a[order + k] for a in asked]), len(distinct)).astype(np.int64)
            each = np.split(total[place].astype(np.uint32), np.cumsum([len(h) for h in hashes])[:-1])
            for reply, counts in zip(replies, each, strict=True):
                reply.append(counts)
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "payload": pa.array([squeezed(packed(*r)) for r in replies], pa.binary())})

    return kernel


def _summed(order: int, alpha: float, least: int, leave_out: bool):
    penalty = int(np.rint(np.log(alpha) * UNIT))

    def kernel(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Part(left.column("payload"))
        replies = [unsqueezed(raw) for _, raw in sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))]
        words = len(part.words)
        score, level = np.zeros(words, np.int32), np.zeros(words, np.int8)
        before = None
        for k, (has, grams) in enumerate(part.orders(order)):
            place = _places(grams)
            totals = np.concatenate([np.zeros(0, np.uint32), *(unpacked(raw, *[np.uint32] * order)[k] for raw in replies)])[place]
            if leave_out:
                totals -= _within(place, part.doc[has])
            own, kept = np.zeros(words, np.int32), np.zeros(words, bool)
            own[has], kept[has] = _logs(np.maximum(totals, 1)), totals >= least if k else True
            del place, totals, grams
            if before is None:
                score = own.copy()
            else:
                # The best order so far loses a factor alpha for backing off, unless this order's n-gram is kept.
                score[has] += penalty
                score[1:] = np.where(kept[1:], own[1:] - before[:-1], score[1:])
            level[kept] = k + 1
            before = own
        n = len(part.n_words)
        sums = np.zeros(n, np.int64)
        np.add.at(sums, part.doc, score.astype(np.int64))
        levels = [np.bincount(part.doc[level == k], minlength=n).astype(np.int64) for k in range(1, order + 1)]
        arrays = [part.ids, pa.array(part.n_words), pa.array(sums), *map(pa.array, levels)]
        return pa.table(arrays, names=["id", "n_words", "part_score", *(f"n_{k}" for k in range(1, order + 1))])

    return kernel


def backoff_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, alpha: float = 0.4, least: int = 1, leave_out: bool = True, bucket_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_words, n_1 .. n_<order>, score_micro): the log score of each text under the n-grams of all other texts.

    Words are runs of characters other than ASCII white space, A-Z lowered. A
    word scores count(n-gram ending there) / count(the n-gram less its last
    word) for the longest n-gram, up to ``order`` words within the text, that
    occurs ``least`` times or more, times ``alpha`` for each longer one tried
    before; a single word scores its share of all words, and one that never
    occurs counts as if it did once. Counts are those of all rows of df less, with
    ``leave_out``, those of the row itself; without it a text is scored by itself
    too, so no n-gram is ever unseen at ``least`` 1. score_micro is the
    sum over the text of the natural logarithms, in millionths, each rounded;
    n_k counts the words scored by order k. Null and empty texts have no words
    and score 0. Every row counts, repeated ones too: a copy of a text scores it.
    Rows that share an id are scored each on their own. A null id comes back as
    null. No rows, no result. Other columns of df are ignored.

    Texts are dealt to partitions; each sends its distinct n-grams with local
    counts to the hash ranges that hold the count table, which answer in the same
    order, so neither a frequent n-gram nor a long text gathers rows in one task.
    A partition holds about ``bucket_bytes`` of text and has a task of its own, as
    has a range. A message goes from a partition to a range; there are at most as
    many as n-grams.
    """
    parts = bucket_count(df, text_col, bucket_bytes)
    ranges = RANGES * parts
    docs = shipped(df.select(integer_id(df, id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id", parts)
    asked = docs.groupBy("part").applyInArrow(_requests(order, ranges), "bucket int, part int, payload binary")
    answers = asked.repartitionById(ranges, F.col("bucket")).groupBy("bucket").applyInArrow(_counted(order), "part int, bucket int, payload binary")
    levels = [f"n_{k}" for k in range(1, order + 1)]
    schema = "id long, n_words long, part_score long, " + ", ".join(f"{k} long" for k in levels)
    answers = answers.repartitionById(parts, F.col("part"))
    sums = checkpointed(docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_summed(order, alpha, least, leave_out), schema))
    total = sums.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(total) - (F.col("n_words") if leave_out else F.lit(0)), F.lit(1))
    share = F.round(F.log(others) * UNIT).cast("long")
    return sums.select("id", "n_words", *levels, (F.col("part_score") - F.col("n_1") * share).alias("score_micro"))
