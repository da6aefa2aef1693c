"""SimHash fingerprints and their near-duplicate groups, found by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bucket_count, checkpointed, mixed, runs
from .components import connected_components

#: Rows that a task takes of one cell, and about as many as it takes of several.
CELL_ROWS = 1 << 19
#: Node pairs that the traversal holds at once.
FRONT = 1 << 19


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over the word shingles of text; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        block = h[at : at + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) for every row; null and empty texts get fingerprint 0."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(kernel, "id long, fp long")


# -- the traversal of one pair of subtrees ------------------------------------


def trie_pairs(fps: np.ndarray, front: list[tuple[int, int, int, int, int]], depth: int, budget: int, bottom: int = 64, labels: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in the sorted uint64 array fps whose top ``bottom`` bits differ in budget bits or fewer.

    A node of the binary trie at depth d is the range of fps that shares its
    top d bits; its children are cut by the number of set bits at d. front
    holds the node pairs to start from, as (lo, hi, lo, hi, differing bits) at
    the given depth, the second node not before the first. Pairs over the
    budget are dropped before they are opened. The stack is depth-first over
    blocks of FRONT pairs, so its memory is bounded. With labels, which the
    caller updates between yields, two nodes that carry one label throughout are
    not opened against each other. Equal values are leaves of several positions.
    """
    if not front:
        return
    counts: dict[int, np.ndarray] = {}
    stack = [(depth, *(np.array(x, np.int32) for x in zip(*front, strict=True)))]
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONT:
            half = len(alo) // 2
            stack += [(d, *(x[half:] for x in (alo, ahi, blo, bhi, diff))), (d, *(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        if labels is not None:
            steps = np.concatenate([[0, 0], np.cumsum(labels[1:] != labels[:-1])])
            apart = (labels[alo] != labels[blo]) | (steps[ahi] > steps[alo + 1]) | (steps[bhi] > steps[blo + 1])
            alo, ahi, blo, bhi, diff = alo[apart], ahi[apart], blo[apart], bhi[apart], diff[apart]
        single = (ahi - alo == 1) & (bhi - blo == 1) | (d == bottom)
        if single.any():
            for a, b in _leaf_pairs(alo[single], ahi[single], blo[single], bhi[single]):
                near = np.bitwise_count((fps[a] ^ fps[b]) >> np.uint64(64 - bottom)) <= budget
                if labels is not None:
                    near &= labels[a] != labels[b]
                if near.any():
                    yield a[near], b[near]
            rest = ~single
            alo, ahi, blo, bhi, diff = alo[rest], ahi[rest], blo[rest], bhi[rest], diff[rest]
        if not len(alo):
            continue
        if d not in counts:
            counts[d] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int32)
        ones = counts[d]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        same, more = alo == blo, diff < budget
        below = []
        for (al, ah, bl, bh), extra, keep in (
            ((alo, amid, blo, bmid), 0, None),
            ((amid, ahi, bmid, bhi), 0, None),
            ((alo, amid, bmid, bhi), 1, more),
            ((amid, ahi, blo, bmid), 1, more & ~same),
        ):
            full = (ah > al) & (bh > bl)
            full &= (ah - al > 1) | (al != bl)  # a leaf has no pair with itself
            if keep is not None:
                full &= keep
            below.append((al[full], ah[full], bl[full], bh[full], diff[full] + np.int32(extra)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*below, strict=True))))


def _leaf_pairs(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions of leaf pairs, each pair once, in blocks of about FRONT."""
    wide = bhi - blo
    # One row per position of the first leaf.
    a = np.repeat(alo, ahi - alo) + (np.arange((ahi - alo).sum()) - np.repeat(np.cumsum(ahi - alo) - (ahi - alo), ahi - alo)).astype(np.int32)
    lo, n = np.repeat(blo, ahi - alo), np.repeat(wide, ahi - alo)
    inside = (lo <= a) & (a < lo + n)  # a leaf with itself: only later positions
    n = np.where(inside, lo + n - a - 1, n)
    lo = np.where(inside, a + 1, lo)
    total, at = np.cumsum(n), 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FRONT)))
        k = n[at:end]
        yield np.repeat(a[at:end], k), (np.repeat(lo[at:end] - (np.cumsum(k) - k), k) + np.arange(k.sum())).astype(np.int32)
        at = end


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None) -> np.ndarray:
    """A label for each of n nodes, equal within each component of pairs; a label array that is given is updated in place."""
    label = np.arange(n) if label is None else label
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            lo, hi = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
            np.minimum.at(label, hi, lo)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
    return label


# -- pairs that meet in a cell ---------------------------------------------------


class _Forest:
    """Spanning forest over positions, closest first within each call, with a label array for each to prune by."""

    def __init__(self, n: int) -> None:
        self.labels, self.edges = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        order = np.argsort(distance, kind="stable")
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for i, j, d in zip(a[order].tolist(), b[order].tolist(), distance[order].tolist(), strict=True):
            x, y = root(int(self.labels[i])), root(int(self.labels[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                self.edges.append((i, j, d))
        if up:
            new = np.arange(len(self.labels))
            new[list(up)] = [root(x) for x in up]
            self.labels[:] = new[self.labels]


def rotations(width: int, budget: int) -> tuple[int, list[int]]:
    """How many top bits a cell fixes, and by how many bits a key is turned to bring each of its budget + 1 segments there.

    Two keys of ``width`` bits that differ in ``budget`` bits or fewer agree in
    one whole segment, so they share a cell, however many keys there are.
    """
    top = width // (budget + 1)
    return top, [r * top for r in range(budget + 1)]


def cells_of(cells: DataFrame, cell_rows: int, n: int, each: int) -> tuple[DataFrame, int]:
    """cells (cell, rep, ...) with bucket (a task's work) and right, and the number of buckets.

    There are ``each`` rows for each of n reps, no two of a rep in one cell.

    Cells are dealt to buckets of about ``cell_rows`` rows. A cell of more rows
    than that, such as a large group of copies has, is cut into chunks by a hash
    of rep, and each two chunks are a bucket of their own. Only such cells reach
    the driver, with their counts: at most ``each * n / cell_rows`` of them.
    """
    shuffle = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, -(-each * n // cell_rows))
    hot = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).collect() if n > cell_rows else []
    plain = F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int")
    if not hot:
        return cells.withColumns({"bucket": plain, "right": F.lit(False)}), parts
    rows, base = [], parts
    for cell, n in sorted(tuple(r) for r in hot):
        chunks = -(-n // cell_rows)
        rows.append((cell, chunks, base))
        base += chunks * (chunks + 1) // 2
    large = cells.sparkSession.createDataFrame(rows, "cell long, chunks int, base int")
    k, c = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"), F.col("chunks")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    # Buckets of the chunk pairs (i, j), i <= j, of a cell, numbered j * (j + 1) / 2 + i.
    place = lambda i, j, right: F.struct((F.col("base") + F.floor(j * (j + 1) / 2).cast("int") + i).alias("bucket"), F.lit(right).alias("right"))
    left = F.transform(F.filter(F.sequence(F.lit(0), c - 1), lambda j: j >= k), lambda j: place(k, j, False))
    right = F.transform(upto(k), lambda i: place(i, k, True))
    places = F.when(c.isNull(), F.array(F.struct(plain.alias("bucket"), F.lit(False).alias("right")))).otherwise(F.concat(left, right))
    out = cells.join(F.broadcast(large), "cell", "left").withColumn("_p", F.explode(places))
    return out.select(*cells.columns, "_p.bucket", "_p.right"), base


def _met(top: int, bottom: int, budget: int, most: int | None = None):
    """A bucket's rows -> spanning forests of the pairs of each cell whose keys differ in ``budget`` of ``bottom`` bits or fewer.

    With ``most``, ends must also differ in no more bits of ``check``, and each
    edge carries that distance.
    """

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, keys, rep, right = (table.column(c).to_numpy() for c in ("cell", "key", "rep", "right"))
        order = np.lexsort((keys.view(np.uint64), cell, right))
        cell, keys, rep = cell[order], keys.view(np.uint64)[order], rep[order]
        n = len(right) - int(right.sum())
        lo, hi = runs(cell[:n])
        if n == len(cell):
            some = hi - lo > 1
            front = lo[some], hi[some], lo[some], hi[some]
        else:
            lo2, hi2 = runs(cell[n:])
            _, i, j = np.intersect1d(cell[lo], cell[n + lo2], return_indices=True)
            front = lo[i], hi[i], n + lo2[j], n + hi2[j]
        nodes = [(*x, 0) for x in zip(*(f.tolist() for f in front), strict=True)]
        if most is None:
            labels = np.arange(len(keys))
            spanning(len(keys), trie_pairs(keys, nodes, top, budget, bottom, labels), labels)
            out = labels != np.arange(len(keys))
            return pa.table({"a": rep[labels[out]], "b": rep[out], "d": np.zeros(out.sum(), np.int64)})
        check = np.frombuffer(b"".join(table.column("check").to_pylist()), np.uint64).reshape(len(keys), -1)[order]
        forest = _Forest(len(keys))
        for a, b in trie_pairs(keys, nodes, top, budget, bottom, forest.labels):
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                open_ = forest.labels[x] != forest.labels[y]
                x, y = x[open_], y[open_]
                d = np.bitwise_count(check[x] ^ check[y]).sum(axis=1, dtype=np.int32)
                forest.add(x[d <= most], y[d <= most], d[d <= most])
        i, j, d = (np.array(x, np.int64) for x in zip(*forest.edges, strict=True)) if forest.edges else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j]), "d": d})

    return kernel


def trie_links(reps: DataFrame, budget: int = 2, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between representatives whose fingerprints differ in budget bits or fewer.

    reps has distinct (fp, rep). There are budget + 1 tries, each over the bits
    in a turned order that begins with another segment of them; a link's ends
    agree in one segment at least, where both are below one node. So each
    fingerprint is sent budget + 1 times, however large reps is. The subtrees
    below are traversed as in ``trie_pairs``. Each task returns a spanning
    forest of its links, at most one edge per fingerprint it holds, so dense
    groups never emit all their pairs and no connection is lost.
    """
    top, turns = rotations(64, budget)
    turned = F.array(*(F.shiftleft("fp", t).bitwiseOR(F.shiftrightunsigned("fp", 64 - t)) if t else F.col("fp") for t in turns))
    cell = lambda x, k: F.struct((F.shiftrightunsigned(x, 64 - top) * len(turns) + k).alias("cell"), x.alias("key"))
    rows = reps.select("rep", F.explode(F.transform(turned, cell)).alias("x")).select("x.cell", "x.key", "rep")
    dealt, buckets = cells_of(rows, cell_rows, reps.count(), len(turns))
    return dealt.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_met(top, 64, budget), "a long, b long, d long").select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2) -> DataFrame:
    """(id, fp, component) for every row of df.

    Rows link when their fingerprints differ in ``budget`` bits or fewer;
    component is the smallest id reachable over links, the row's own included.
    Null or empty texts have fingerprint 0 and link like any other. Rows that
    share an id count as one node each and fall into one component only if
    linked by fingerprints; a null id is carried through with its fingerprint's
    component. An empty table gives no rows; other columns are ignored.
    Equal fingerprints are reduced to their smallest id before the join, so a
    group of copies of any size is one trie leaf.
    """
    fps = checkpointed(fingerprints(df, id_col, text_col))
    reps = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"))
    groups = connected_components(trie_links(reps, budget))
    whole = reps.join(groups, reps.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return fps.join(whole, "fp", "left").select("id", "fp", "component")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2) -> DataFrame:
    """The rows of df of which each group keeps the one with the smallest id; all columns stay.

    Rows that share the kept id all stay, as do rows with a null id.
    """
    return _without(df, id_col, near_duplicates(df, id_col, text_col, budget))


def _without(df: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """The rows of df less those with ids that aren't the component of any of their rows in found (id, component); null ids stay."""
    own = F.max(F.col("id") == F.col("component"))
    gone = checkpointed(found.where("id is not null").groupBy("id").agg(own.alias("own")).where("not own").select(F.col("id").alias("_gone")))
    small = gone.count() <= BROADCAST_IDS
    return df.join(F.broadcast(gone) if small else gone, df[id_col].cast("long") == gone["_gone"], "left_anti")


# -- near copies by similarity -------------------------------------------------

#: Words of a wide SimHash; the first KEY_WORDS give the keys' bits, the others are compared.
WORDS, KEY_WORDS, KEYS = 16, 10, 26
#: Random pairs that a key of budget 1 leads to for each text grow with the texts; from this many on keys grow instead.
KEY_TEXTS = 1 << 26
#: Texts of fewer shingles than this are too short for a sketch; they meet by exact shingles.
SHORT = 64
#: Rows that one side of a task takes of a common shingle, or of a group that is compared in full.
SIDE = 4096
FULL = 1024
#: Ids of texts in candidate pairs, or of those to remove, that are broadcast; with more, texts are shuffled once to meet them.
BROADCAST_IDS = 1 << 20
#: Edges of a hub that one copy of its text serves.
HUB = 64
_SALTS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words)] if 0 < len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles), np.uint64))


def sketch(h: np.ndarray) -> bytes:
    """A SimHash of 64 * WORDS bits over a set of shingles; all zero for an empty one."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), 255):  # 255 rows add up within a byte
        block = mixed(h[at : at + 255, None] + _SALTS)
        ones += np.unpackbits(block.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).tobytes()


def prefix(h: np.ndarray, similarity: float) -> np.ndarray:
    """The least shingles of a sorted set, so many that two sets of this Jaccard similarity share one of theirs."""
    return h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def parity(h: np.ndarray) -> bytes:
    """256 bits, each flipped by the shingles that fall on it: two sets' differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((mixed(h) & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8).tobytes()


def differing(similarity: float, deviations: float, bits: int) -> int:
    """Of ``bits``, how many differ between sketches of equally large sets of this Jaccard similarity: the angle's share, and so many deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(share * bits + deviations * (bits * share * (1 - share)) ** 0.5)


def key_budget(n: int) -> int:
    """Bits in which two keys may differ, for n texts.

    A key has 8 * budget + 12 bits, so at any budget a pair at similarity 0.8
    meets in a key with the same chance (0.17 to 0.19), while random pairs meet
    in 13 times fewer keys with each bit more. It is 1 up to 2**26 texts, 2 up
    to 13 times as many, and so on: the pairs compared for a text stay bounded.
    """
    budget = 1
    while n > KEY_TEXTS * 13 ** (budget - 1):
        budget += 1
    return budget


def _keys(width: int, budget: int):
    """(rep, sketch) -> a row for each key of each sketch and each of the key's turns, with the bits to compare."""
    top, turns = rotations(width, budget)
    span = 64 * KEY_WORDS

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, 8 * WORDS)
            every = np.unpackbits(raw[:, : 8 * KEY_WORDS], axis=1)
            kept = np.ascontiguousarray(raw[:, 8 * KEY_WORDS :])
            check = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * kept.shape[1]), pa.py_buffer(kept)])
            for k in range(KEYS):
                key = np.zeros(n, np.uint64)
                for b in range(width):
                    key = key << np.uint64(1) | every[:, (k * width + b) % span]
                for r, t in enumerate(turns):
                    turned = (key << np.uint64(64 - width + t) | key << np.uint64(64 - width) >> np.uint64(width - t)) if t else key << np.uint64(64 - width)
                    cell = (turned >> np.uint64(64 - top)).astype(np.int64) + ((k * len(turns) + r) << top)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(turned.view(np.int64)), batch.column(0), check], ["cell", "key", "rep", "check"])

    return kernel


def _long_links(reps: DataFrame, similarity: float, budget: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Candidate edges (a, b, d) among (rep, sketch) by trie self-joins of keys; each sketch is sent KEYS * (budget + 1) times."""
    n = reps.count()
    budget = budget or key_budget(n)
    width = 8 * budget + 12
    top, turns = rotations(width, budget)
    rows = reps.select("rep", "sketch").mapInArrow(_keys(width, budget), "cell long, key long, rep long, check binary")
    dealt, buckets = cells_of(rows, cell_rows, n, KEYS * len(turns))
    most = differing(similarity, 3.5, 64 * (WORDS - KEY_WORDS))
    return dealt.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_met(top, width, budget, most), "a long, b long, d long")


def _close(similarity: float):
    """Rows of short texts by shingle -> a spanning forest of the pairs that sizes and parities allow; none that is similar is ruled out."""

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        token, rep, n, left = (table.column(c).to_numpy() for c in ("token", "rep", "n", "left"))
        order = np.lexsort((~left, token))
        token, n, left = token[order], n[order], left[order]
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, 4)[order]
        reps, at = np.unique(rep[order], return_inverse=True)
        lo, hi = runs(token)
        mid = lo + np.add.reduceat(left, lo, dtype=np.int64)
        inner = key[1].as_py() == key[2].as_py()
        front = (lo, mid, lo, mid) if inner else (lo, mid, mid, hi)
        forest = _Forest(len(reps))
        for a, b in _leaf_pairs(*(x.astype(np.int32) for x in front)):
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                fits = (forest.labels[at[x]] != forest.labels[at[y]]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
                x, y = x[fits], y[fits]
                d = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int32)
                near = d <= (n[x] + n[y]) * (1 - similarity) / (1 + similarity) + 1e-9
                forest.add(at[x[near]], at[y[near]], d[near])
        i, j, d = (np.array(x, np.int64) for x in zip(*forest.edges, strict=True)) if forest.edges else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": reps[np.minimum(i, j)], "b": reps[np.maximum(i, j)], "d": d})

    return kernel


def _short_links(reps: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b, d) that connect all pairs of this similarity among texts with a prefix; a shingle of many texts is dealt into pairs of chunks."""
    rows = reps.where("prefix is not null").select("rep", "n", "parity", F.explode("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token", F.ceil(F.col("c") / SIDE).cast("int").alias("chunks"))
    rows = rows.join(shared, "token").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    shuffle = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(8 * shuffle, (reps.agg(F.sum(F.size("prefix"))).first()[0] or 0) // (16 * SIDE))
    cell = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("token"), F.lit(parts))).otherwise(F.col("token")).alias("cell")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    left = rows.select(cell, F.col("chunk").alias("i"), F.explode(F.filter(every, lambda j: j >= F.col("chunk"))).alias("j"), "token", "rep", "n", "parity", F.lit(True).alias("left"))
    right = rows.where("chunk > 0").select(cell, F.explode(F.filter(every, lambda i: i < F.col("chunk"))).alias("i"), F.col("chunk").alias("j"), "token", "rep", "n", "parity", F.lit(False).alias("left"))
    dealt = left.union(right).repartition(max(shuffle, parts // 8), "cell", "i", "j")
    return dealt.groupBy("cell", "i", "j").applyInArrow(_close(similarity), "a long, b long, d long")


def _verified(edges: DataFrame, texts: DataFrame, width: int, similarity: float, partitions: int) -> DataFrame:
    """The edges whose texts' shingle sets are this similar.

    An edge's end of more edges is its hub. A hub's text is sent once for HUB of
    its edges, the other end's once for each edge; a hub's edges lie next to each
    other, so its shingles are made once for them.
    """
    pairs = checkpointed(edges.select("a", "b"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    of = lambda end: degree.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
    first = F.col("n_a") >= F.col("n_b")
    turned = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("leaf"), F.greatest("n_a", "n_b").alias("n"))
    turned = checkpointed(turned.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("n") / HUB)).alias("salt")))
    hubs = turned.select("hub", "salt").distinct().select("hub", "salt", F.lit(None).cast("long").alias("leaf"), F.col("hub").alias("id"))
    leaves = turned.select("hub", "salt", "leaf", F.col("leaf").alias("id"))
    sent = hubs.unionByName(leaves).join(texts, "id").select("hub", "salt", "leaf", "t")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, p = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, leaf, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q = shingle_set(text, width)
                if leaf is None:  # comes first
                    at, p = (hub, salt), q
                    continue
                assert at == (hub, salt)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if shared >= similarity * (len(p) + len(q) - shared):
                    a.append(min(hub, leaf))
                    b.append(max(hub, leaf))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = sent.repartition(partitions, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("leaf").asc_nulls_first())
    return dealt.mapInArrow(kernel, "a long, b long")


def shared_counts(sets: list[np.ndarray], block: int = 1 << 12) -> np.ndarray:
    """How many members each two of the sets have in common, by products of 0/1 blocks over the members that occur twice."""
    owner, member = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    _, column, times = np.unique(member, return_inverse=True, return_counts=True)
    twice = times[column] > 1
    _, column = np.unique(column[twice], return_inverse=True)
    owner = owner[twice]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 2**24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, block):
        a, b = np.searchsorted(column, [at, at + block])
        part = np.zeros((len(sets), block), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _compared(similarity: float):
    """All texts of a task against each other by their whole shingle sets -> links between parts that weren't linked yet."""

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets], np.float64)
        shared = shared_counts(sets)
        _, first, part = np.unique(table.column("part").to_numpy(), return_index=True, return_inverse=True)
        a, b = [], []
        label = first[part]
        for i in range(len(ids)):
            j = i + 1 + np.flatnonzero(shared[i, i + 1 :] >= similarity * (n[i] + n[i + 1 :] - shared[i, i + 1 :]))
            while len(j := j[label[j] != label[i]]):
                a.append(i)
                b.append(int(j[0]))
                label[label == label[j[0]]] = label[i]
        return pa.table({"a": ids[np.array(a, np.int64)], "b": ids[np.array(b, np.int64)]})

    return kernel


def _completed(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between the parts of clusters of nodes (id, part, cluster) in several parts, by whole shingle sets.

    The texts outside a cluster's largest part are compared with each other and
    with those in it; both are dealt into chunks, and two chunks are a task.
    """
    sizes = nodes.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("cluster").agg(F.sum("n").alias("total"), F.max(F.struct("n", "part")).alias("most"))
    torn = checkpointed(whole.where("total > most.n").select("cluster", F.col("most.part").alias("main"), F.ceil(F.col("most.n") / FULL).cast("int").alias("m"), F.ceil((F.col("total") - F.col("most.n")) / FULL).cast("int").alias("r")))
    open_ = checkpointed(nodes.join(torn, "cluster").withColumn("rest", F.col("part") != F.col("main")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "shingles"])

    some = texts.join(open_.select("id").distinct(), "id", "left_semi")
    dealt = open_.join(some.mapInArrow(kernel, "id long, shingles binary"), "id").withColumn("k", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m"))).cast("int"))
    upto, k, r, m = (lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)), F.col("k"), F.col("r"), F.col("m")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    among = F.transform(upto(r), lambda x: cell(F.least(x, k), F.greatest(x, k)))
    cells = F.when(F.col("rest"), F.concat(among, F.transform(upto(m), lambda x: cell(r + x, k)))).otherwise(F.transform(upto(r), lambda x: cell(r + k, x)))
    sent = dealt.select("cluster", "id", "part", "shingles", F.explode(cells).alias("c")).select("cluster", "c.i", "c.j", "id", "part", "shingles")
    pairs = torn.agg(F.sum(F.col("r") * (F.col("r") + 1) / 2 + F.col("r") * F.col("m"))).first()[0] or 0
    shuffle = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(max(shuffle, int(pairs) // 16), "cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(_compared(similarity), "a long, b long")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) after links (a, b) between nodes or components; only what crosses parts is walked."""
    groups = connected_components(_crossing(parts, links, "of_a", "of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    moved = groups.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return checkpointed(parts.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _crossing(parts: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """The edges whose ends are in different parts, with of_a and of_b, the parts."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    return edges.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(*columns)


def _groups(edges: DataFrame, texts: DataFrame, width: int, similarity: float, partitions: int, rounds: int = 2) -> DataFrame:
    """(node, component) by links of this similarity alone, for candidate edges (a, b, d) that connect every such pair; texts (id, t) are those of their ends.

    Each round verifies every text's closest edge out of its part. What verified
    links then leave apart within a cluster of candidates is compared in full.
    """
    parts, left = texts.select(F.col("id").alias("node"), F.col("id").alias("component")), edges
    for _ in range(rounds):
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w"), "d").union(left.select(F.col("b").alias("v"), F.col("a").alias("w"), "d"))
        picks = checkpointed(both.groupBy("v").agg(F.min(F.struct("d", "w")).alias("m")).select(F.least("v", "m.w").alias("a"), F.greatest("v", "m.w").alias("b")).distinct())
        parts = _joined(parts, _verified(picks, texts, width, similarity, partitions))
        left = checkpointed(_crossing(parts, left.join(picks, ["a", "b"], "left_anti"), "a", "b", "d"))
        if not left.take(1):
            break
    torn = checkpointed(_crossing(parts, edges, F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
    if not torn.take(1):
        return parts
    clusters = connected_components(torn).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    nodes = parts.join(clusters, "component").select(F.col("node").alias("id"), F.col("component").alias("part"), "cluster")
    return _joined(parts, _completed(nodes, texts, width, similarity))


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, budget: int | None = None) -> DataFrame:
    """(id, component) for every row: groups of texts linked by sets of word shingles of Jaccard similarity ``similarity`` or more.

    Every link is verified by the exact shingle sets. Texts of 64 shingles or
    more are compared by a SimHash of 1,024 bits, whose share of differing bits
    follows the angle between the shingle sets. Pairs to compare come from trie
    self-joins of 26 keys of 8 * budget + 12 bits, in each of which a pair at
    similarity 0.8 differs in ``budget`` bits or fewer with a chance of 0.17 or
    more (None: the budget that ``key_budget`` gives for the number of texts). A
    distance of 3.5 deviations over the threshold's, in 384 bits that no key
    uses, ends a pair. A text is sent 26 * (budget + 1) times.
    Texts of up to 80 shingles (at 0.8) meet by a shared shingle of their prefixes
    and are ruled out by sizes and parities only, which never loses a pair.
    Within a task pairs that are already connected aren't opened, so what leaves
    it are forests of candidates. Where verified links don't connect all of such a
    cluster, its parts are compared in full. So no link is wrong, and a link is
    only missed where no path of candidates joins its ends: for a lone pair
    of long texts at exactly the threshold the chance is under one in a hundred.
    Texts without words form one group. Rows that share an id are compared by
    the first of their texts; a null id has a null component. An empty
    table gives no rows; other columns are ignored.
    """
    brief = int(SHORT / similarity + 1e-9)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            small = [0 < len(h) <= brief for h in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sketch(h) for h in sets], pa.binary()),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([prefix(h, similarity).view(np.int64) if x else None for h, x in zip(sets, small, strict=True)], pa.list_(pa.int64())),
                    pa.array([parity(h) if x else None for h, x in zip(sets, small, strict=True)], pa.binary()),
                ],
                ["id", "sketch", "n", "prefix", "parity"],
            )

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    sketches = checkpointed(texts.mapInArrow(kernel, "id long, sketch binary, n long, prefix array<long>, parity binary"))
    reps = checkpointed(sketches.where("id is not null").groupBy("sketch").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity")))
    found = _long_links(reps.where(F.col("n") >= SHORT).select("rep", "sketch"), similarity, budget)
    edges = checkpointed(found.union(_short_links(reps, similarity)).where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d")))
    ends = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    small = ends.count() <= BROADCAST_IDS
    some = checkpointed(texts.join(F.broadcast(ends) if small else ends, "id", "left_semi").groupBy("id").agg(F.min("t").alias("t")))
    groups = _groups(edges, some, width, similarity, bucket_count(some, "t"))
    whole = reps.join(groups, reps.rep == groups.node, "left").select("sketch", F.coalesce("component", "rep").alias("component"))
    out = sketches.join(whole, "sketch", "left")
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def without_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df of which each group of similar texts keeps the one with the smallest id; rows with a null id stay."""
    return _without(df, id_col, similar_documents(df, id_col, text_col, width, similarity))
