"""SimHash groups, repeated windows and repeated bytes against brute force, and their edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import common, components, simhash, substring, suffix

from .helpers import components as brute_components
from .helpers import corpus, fingerprint, repeated_bytes, repeated_words, similar_groups, words

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module", params=[1, 2])
def docs(request):
    return corpus(request.param)


def test_fingerprints_and_groups(spark, docs):
    rows = simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    want = {k: fingerprint(t) for k, t in docs}
    assert {r.id: r.fp % 2**64 for r in rows} == want
    assert {r.id: r.component for r in rows} == brute_components(want, 2)


def test_trie_finds_all_pairs_of_a_dense_ball():
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(500)}
    fps = np.array(sorted(values), np.uint64)
    for budget in (0, 1, 2, 3):
        found = {(int(a), int(b)) for x, y in simhash.trie_pairs(fps, [(0, len(fps), 0, len(fps), 0)], 0, budget) for a, b in zip(x, y)}
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= budget
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}
        assert {(min(p), max(p)) for p in found} == want


@pytest.mark.parametrize("cell_rows", [7, 40, 1 << 19])
def test_cells_and_chunks_lose_no_link(spark, cell_rows):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(60)}
    nodes = dict(enumerate(values))
    signed = [(v - 2**64 if v >> 63 else v, k) for k, v in nodes.items()]
    edges = simhash.trie_links(spark.createDataFrame(signed, "fp long, rep long"), 2, cell_rows=cell_rows)
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert {k: found.get(k, k) for k in nodes} == brute_components(nodes, 2)


def near_copies(seed: int, n: int) -> list[tuple[int, str]]:
    """A group of texts with more and more words changed, among others."""
    rng = random.Random(seed)
    base = words(rng, 400)
    out = []
    for k in range(n):
        some = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 14, 20])):
            some[rng.randrange(400)] = f"new{rng.randrange(10**9)}"
        out.append((2 * k, " ".join(some)))
        out.append((2 * k + 1, " ".join(words(rng, rng.choice([2, 30, 300])))))
    return out


def exact_groups(docs: list[tuple[int, str]], least: float = 0.8) -> dict[int, int]:
    """Groups by shingle sets from one product over the shingles that occur twice."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    at = {s: k for k, s in enumerate(s for s, n in Counter(s for x in sets for s in x).items() if n > 1)}
    holds = np.zeros((len(sets), len(at)), np.float32)
    for k, x in enumerate(sets):
        holds[k, [at[s] for s in x if s in at]] = 1
    size, shared = np.array([len(x) for x in sets]), holds @ holds.T
    near = shared >= least * (size[:, None] + size - shared)
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while not np.array_equal(low := np.where(near, label, len(sets)).min(axis=1), label):
        label = low
    return {k: docs[x][0] for (k, _), x in zip(docs, label)}


def test_similar_documents(spark):
    docs, want = [], {}
    for seed in (3, *range(11, 20)):
        own = [(1000 * seed + k, f"seed{seed} {t}" if len(t) < 20 else t) for k, t in near_copies(seed, 90)]
        docs += own
        want |= similar_groups(dict(own))
    out = simhash.similar_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(out) == len(docs)
    assert {r.id: r.component for r in out} == want


@pytest.mark.parametrize("budget,cell_rows", [(1, 50), (3, 1 << 19)])
def test_wider_keys_and_chunks_give_the_same_groups(spark, monkeypatch, budget, cell_rows):
    monkeypatch.setattr(simhash._long_links, "__defaults__", (None, cell_rows))
    docs = near_copies(12, 90)
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(docs, SCHEMA), budget=budget).collect()}
    assert got == similar_groups(dict(docs))


def test_rows_sent_for_a_text_do_not_depend_on_the_number_of_texts(spark):
    def sent(n: int, cell_rows: int) -> float:
        reps = spark.createDataFrame([(k, simhash.sketch(np.random.default_rng(k).integers(0, 2**63, 80).astype(np.uint64))) for k in range(n)], "rep long, sketch binary")
        rows = reps.mapInArrow(simhash._keys(20, 1), "cell long, key long, rep long, check binary")
        return simhash.cells_of(rows, cell_rows, n, simhash.KEYS * 2)[0].count() / n

    assert sent(60, 1 << 19) == sent(240, 1 << 19) == sent(240, 64) == 2 * simhash.KEYS


def test_a_template_group_around_the_threshold(spark):
    rng = random.Random(11)
    base = words(rng, 300)
    docs = []
    for k in range(2000):  # pairs from 0.6 to 0.9 alike, most of them under 0.8
        some = list(base)
        for at in rng.sample(range(300), rng.choice([3, 5, 6, 7, 8, 9])):
            some[at] = f"new{rng.randrange(10**9)}"
        docs.append((k, " ".join(some)))
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    want = exact_groups(docs)
    assert 20 < len(set(want.values())) < len(docs)
    assert got == want


def test_parts_of_a_cluster_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FULL", 16)
    monkeypatch.setattr(simhash, "SIDE", 16)
    rng = random.Random(12)
    base, short = words(rng, 200), words(rng, 40)
    docs = []
    for k in range(240):
        some = list(base if k % 2 else short)
        for at in rng.sample(range(len(some)), rng.choice([3, 4, 5, 6]) if k % 2 else rng.choice([0, 1, 2])):
            some[at] = f"new{rng.randrange(10**9)}"
        docs.append((k, " ".join(some)))
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == exact_groups(docs)


def test_short_texts_by_exact_shingles(spark):
    rng = random.Random(13)
    docs = []
    for k in range(300):
        w = words(rng, 100)
        n, more = [(8, 1), (10, 2), (18, 4), (24, 5), (64, 16), (68, 16), (83, 20)][k % 7]  # at 0.8, 0.75, 0.778, 0.8, 0.789, 0.8, 0.798
        docs += [(2 * k, " ".join(w[:n])), (2 * k + 1, " ".join(w[: n + more]))]
    got = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == exact_groups(docs)


def test_similar_documents_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "two words", "z"), (3, "two words", "z"), (4, "Two  WORDS", "q"), (None, "two words", "n"), (9, "other", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted((r.id or -1, r.component or -1) for r in simhash.similar_documents(df).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (9, 9)]
    kept = simhash.without_similar(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 3, 9]
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_pairs_of_equal_keys_come_once():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.choice(rng.integers(0, 2**28, 30, dtype=np.uint64) << np.uint64(36), 90))
    got = [(int(a), int(b)) for x, y in simhash.trie_pairs(keys, [(0, 90, 0, 90, 0)], 0, 2, 28) for a, b in zip(x, y)]
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 2
    assert len(got) == len(set(got)) and set(got) == {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, 1000 + i) for i in range(200)]
    odd = [(5, 5), (3, 2), (2, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(path + hub + odd, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {1000 + i: 7 for i in range(200)} | {2: 2, 3: 2}


def test_dedup_keeps_one_of_each_group_and_all_columns(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(k, t, "s", k) for k, t in docs], "doc_id long, text string, component string, fp long")
    kept = simhash.deduplicated(df)
    want = brute_components({k: fingerprint(t) for k, t in docs}, 2)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_repeated_windows(spark, docs):
    out = substring.repeated_windows(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == repeated_words(docs)
    for r in out:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
        if r.text:
            assert len(r.text.encode().split()) == r.n_words - r.n_removed


def test_window_repeats_across_flushes(spark, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH_WORDS", 50)
    docs = corpus(3)
    kernel = substring._windows(20, 3, 3)
    import pyarrow as pa
    from zlib import crc32

    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs]), pa.array([crc32((t or "").encode()) for _, t in docs]), pa.array([t for _, t in docs])], ["id", "tag", "text"])
    rows = pa.Table.from_batches(list(kernel(iter([batch]))))
    marks = [substring._counted(3)((pa.scalar(b),), rows.filter(pa.compute.equal(rows["bucket"], b))) for b in range(3)]
    found = substring.marks_by_document([x for t in marks for x in t.column("payload").to_pylist()])
    want = repeated_words(docs)
    for k, text in docs:
        starts = found.get((k, crc32((text or "").encode())))
        n = len((text or "").encode().split())
        gone = 0 if starts is None else int(substring.covered(np.concatenate(starts), 20, n).sum())
        assert gone == want[k][1]


def test_repeated_bytes(spark, docs):
    out = suffix.repeated_bytes(spark.createDataFrame(docs, SCHEMA), keep=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in out} == repeated_bytes(docs)
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in out)


def test_byte_blocks_of_a_long_text(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix, "FLUSH_BYTES", 700)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = pa.Table.from_batches(list(suffix._anchors(200, 64, 1)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([text, text])], ["id", "tag", "text"])]))))
    out = suffix._repeated(1, 1 << 30)((pa.scalar(0),), rows)
    places = {(int(d), int(s) + w) for raw in out.column("payload").to_pylist() for d, _, s, n, _ in zip(*suffix._place_unblob(raw)[1:]) for w in range(int(n))}
    assert places == {(d, s) for d in (1, 2) for s in range(5000 - 199)}


def maximal_by_brute_force(raws: dict[int, bytes], width: int) -> set[tuple[int, tuple[tuple[int, int], ...]]]:
    """Every maximal repeat: for each two occurrences of a window, the longest equal stretch, and all places of it."""
    places, found = {}, set()
    for k, raw in raws.items():
        for i in range(len(raw) - width + 1):
            places.setdefault(raw[i : i + width], []).append((k, i))
    strings = set()
    for at in places.values():
        for x in range(len(at)):
            for y in range(x):
                (p, i), (q, j) = at[x], at[y]
                a, b = raws[p], raws[q]
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                n = width
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                strings.add(a[i : i + n])
    for s in strings:
        where = tuple(sorted((k, i) for k, raw in raws.items() for i in range(len(raw) - len(s) + 1) if raw.startswith(s, i)))
        left = {raws[k][i - 1] if i else (k, i) for k, i in where}
        right = {raws[k][i + len(s)] if i + len(s) < len(raws[k]) else (k, i) for k, i in where}
        if len(left) > 1 and len(right) > 1:
            found.add((len(s), where))
    return found


@pytest.mark.parametrize("reach", [4096, 100])
def test_maximal_repeats_with_all_occurrences(spark, reach):
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    short, long, wide = draw(230), draw(700), draw(1500)
    docs = [(k, draw(80) + chr(65 + k) + short + chr(80 + k) + draw(80)) for k in range(4)]
    docs += [(10, draw(50) + "A" + long + "B" + draw(50)), (11, draw(60) + "C" + long + "D"), (12, wide + "E" + draw(90)), (13, draw(9) + "F" + wide), (14, "G" + long[150:500] + "H" + draw(30)), (15, None), (16, ""), (17, "I" + "xy" * 103 + "J"), (18, "K" + "xy" * 103)]
    groups = suffix.maximal_repeats(spark.createDataFrame(docs, SCHEMA), reach=reach).collect()
    got = [(g.length, tuple((o.id, o.start) for o in g.occurrences)) for g in groups]
    want = maximal_by_brute_force({k: (t or "").encode() for k, t in docs}, 200)
    assert len(got) == len(set(got))
    if reach > 1000:
        assert set(got) == want and {len(w) for _, w in want} >= {2, 3, 4, 6}
    else:  # the wide one has no further places, so it is whole
        assert {(1500, ((12, 0), (13, 10)))} <= set(got) and all(g in want or g[0] < 700 for g in got)


@pytest.mark.parametrize("hot", [12])
def test_grams_of_many_segments_are_cut_into_chunks(spark, monkeypatch, docs, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "FLUSH_BYTES", 3000)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(250))
    more = [(1000 + k, "".join(rng.choice("klmnop") for _ in range(k)) + line[k % 40 :] + "".join(rng.choice("qrst") for _ in range(30))) for k in range(60)]
    out = suffix.repeated_bytes(spark.createDataFrame(docs + more, SCHEMA), bucket_bytes=2000).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in out} == repeated_bytes(docs + more)


def test_short_periods_are_settled_in_few_segments():
    raw = np.frombuffer(b"head of it " + b"=" * 100_000 + b" middle " + b"-+*" * 9000 + b" tail" + b"abcdefghij" * 25, np.uint8)
    rolling = common.Rolling(suffix.BASE)
    h, text, start, count, offset = suffix.anchor_runs(raw, np.array([len(raw)]), 200, 64, rolling)
    assert len(h) < 1500 and count.sum() == len(raw) - 199 and (offset == suffix.WHOLE).sum() >= 3
    at = np.concatenate([np.arange(s, s + c) for s, c in zip(start, count)])
    assert np.array_equal(np.sort(at), np.arange(len(raw) - 199))


def test_periodic_texts_by_brute_force(spark):
    rng = random.Random(15)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    docs = [(1, draw(50) + "=" * 900 + draw(90)), (2, "=" * 200), (3, draw(20) + "=" * 199 + "x"), (4, "ab" * 400), (5, "ab" * 100), (6, draw(40) + "ab" * 101), (7, "0123456789" * 60 + draw(300)), (8, "5678901234" * 21), (9, "=" * 201), (10, draw(30) + "q" * 250 + draw(10)), (11, draw(17) * 40), (12, "z" * 200)]
    out = suffix.repeated_bytes(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in out} == repeated_bytes(docs)


def test_a_long_run_of_one_byte(spark):
    out = {r.doc_id: (r.n_removed, len(r.removed)) for r in suffix.repeated_bytes(spark.createDataFrame([(1, "=" * 800_000), (2, "ab" * 300_000 + "c")], SCHEMA)).collect()}
    assert out == {1: (800_000, 1), 2: (600_000, 1)}


def test_a_doubled_row_is_one_text(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    out = suffix.repeated_bytes(spark.createDataFrame([(1, text), (1, text), (2, "x" * 300)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 0), (1, 0), (2, 300)]


def test_prefix_intervals_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        lcp = [rng.randint(0, 4) for _ in range(rng.randint(0, 9))]
        got = set(suffix.prefix_intervals(lcp, 1))
        want = set()
        for a in range(len(lcp)):
            for b in range(a + 1, len(lcp) + 1):
                depth = min(lcp[a:b])
                if depth >= 1 and (a == 0 or lcp[a - 1] < depth) and (b == len(lcp) or lcp[b] < depth):
                    want.add((depth, a, b))
        assert got == want


@pytest.mark.parametrize("operator", [substring.repeated_windows, suffix.repeated_bytes])
def test_null_ids_repeated_rows_and_clashing_columns(spark, operator):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, text, 1, "p"), (4, text, 2, "p"), (4, text, 2, "p"), (9, text, 3, "p"), (9, "short", 4, "q"), (11, None, None, None)]
    own = ["part", "tag", "_tag", "bucket", "payload", "c0", "c1", "kind"]
    df = spark.createDataFrame([(*r[:3], *[r[3]] * len(own)) for r in rows], ", ".join(["doc_id long, text string, N_removed long", *(f"{c} string" for c in own)]))
    result = operator(df)
    out = result.collect()
    assert len({c.lower() for c in result.columns}) == len(result.columns)
    assert len(out) == len(rows) and all(sorted((r[c] or "" for r in out)) == ["", "p", "p", "p", "p", "q"] for c in own)
    by = sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in out)
    whole = 80 if operator is substring.repeated_windows else len(text)
    first = 0 if operator is substring.repeated_windows else whole  # the earliest window stays, bytes go everywhere
    assert by == [(False, 0, first), (True, 4, whole), (True, 4, whole), (True, 9, 0), (True, 9, whole), (True, 11, 0)]


def test_cleaned_keeps_own_columns(spark):
    text = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 99, "k"), (2, "x y " + text, 98, "m"), (3, text, 97, "n"), (4, None, 96, None)], "doc_id long, text string, n_words long, kept_sha256 string")
    assert sorted(map(tuple, substring.cleaned(df).collect())) == [(1, text, 99, "k"), (2, "x y ", 98, "m"), (4, None, 96, None)]


@pytest.mark.parametrize("operator", [substring.repeated_windows, suffix.repeated_bytes])
def test_ids_must_be_integers(spark, operator):
    with pytest.raises(TypeError):
        operator(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_payloads_grow_no_faster_than_windows(spark):
    def payloads(n: int) -> tuple[int, int]:
        rng = random.Random(n)
        df = spark.createDataFrame([(k, k, " ".join(words(rng, 60))) for k in range(n)], "id long, tag long, text string").repartition(4)
        buckets = n // 10  # as a bucket holds a fixed size of text
        return df.mapInArrow(substring._windows(20, buckets, buckets), "bucket int, kind int, payload binary").count(), n * 41

    for n in (100, 400):
        found, most = payloads(n)
        assert found <= min(most, 4 * (n // 10))


@pytest.mark.parametrize("operator", [substring.repeated_windows, suffix.repeated_bytes, simhash.near_duplicates, simhash.deduplicated])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string, other string")).count() == 0


def test_null_ids_in_groups(spark):
    rows = [(None, "same words here now"), (2, "same words here now"), (2, "other"), (None, None), (5, "")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.id or -1, r.component) for r in out) == [(-1, 2), (-1, 5), (2, 2), (2, 2), (5, 5)]
    assert simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).count() == 5
