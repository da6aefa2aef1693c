"""Audio fingerprints, shard placement, and the pipeline stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from gridspark.llm import media, quality, sharding

from ..conftest import DATA
from .helpers import repeated_words, sha, similar_groups
from .test_text import brute_contamination


def tune(seed: int, notes: int = 200) -> np.ndarray:
    rng = np.random.default_rng(seed)
    pitch = rng.integers(0, 24, notes)
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (p / 12) * np.arange(256) / media.RATE) for p in pitch]) * 12_000


def pcm(x: np.ndarray) -> bytes:
    return np.clip(x, -32768, 32767).astype("<i2").tobytes()


def test_integral_image_filters():
    image = np.random.default_rng(1).random((40, 12))
    total = np.zeros((41, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    got = media._box(total, np.arange(10), 2, 9, 3, 8)
    assert np.allclose(got, [image[t + 2 : t + 9, 3:8].sum() for t in range(10)])
    assert media.packed_integers(image).dtype == np.uint32 and len(media.packed_integers(image)) == 40 - media.SPAN + 1


def test_chroma_by_brute_force():
    x = tune(5, 12)
    got = media.chroma(x)
    for k in (0, 3, len(got) - 1):
        frame = x[k * media.HOP : k * media.HOP + media.FRAME] * np.hanning(media.FRAME)
        energy = np.zeros(12)
        for b in range(media.FRAME // 2 + 1):
            f = b * media.RATE / media.FRAME
            if media.LOW <= f <= media.HIGH:
                wave = np.exp(-2j * np.pi * b * np.arange(media.FRAME) / media.FRAME)
                energy[round(12 * np.log2(f / 440)) % 12] += abs((frame * wave).sum()) ** 2
        assert np.allclose(got[k], energy / np.linalg.norm(energy))


def test_filters_by_brute_force():
    image = np.random.default_rng(2).random((20, 12))
    for t, value in enumerate(media.packed_integers(image).tolist()):
        want = 0
        for shape, p, h, w in media.FILTERS:
            box = image[t : t + w, p : p + h]
            top = {"pitch": box[:, : h // 2].sum(), "time": box[: w // 2].sum(), "cross": box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum(), "middle": box[w // 3 : w - w // 3].sum()}[shape]
            answer = np.log1p(top) - np.log1p(box.sum() - top)
            want = want * 4 + [0, 1, 3, 2][sum(answer > c for c in media.CUTS)]
        assert value == want


def test_alignment_finds_an_excerpt_with_noise(spark):
    rng = np.random.default_rng(4)
    whole = tune(1)
    cut = whole[256 * 60 : 256 * 160] + rng.normal(0, 300, 256 * 100)
    rows = [(0, bytearray(pcm(whole))), (1, bytearray(pcm(cut))), (2, bytearray(pcm(tune(2)))), (3, bytearray(pcm(whole))), (4, None), (5, bytearray(b"")), (6, bytearray(b"\0" * 99))]
    got = {r.id: r for r in media.aligned(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio", F.col("id") == 0).collect()}
    near = got[0].nearest
    assert got[0].n_links == 1 and near.class_id == 1 and abs(near.offset + 120) <= 1 and near.bit_errors < 0.1 * 32 * near.overlap
    assert got[3].class_id == 0 and got[4].class_id is None and got[5].n_ints == got[6].n_ints == 0 and not got[1].is_query


def test_links_by_brute_force_on_integers(spark):
    rng = np.random.default_rng(3)
    fps = [rng.integers(0, 40, rng.integers(36, 60)) for _ in range(30)]
    fps += [np.concatenate([rng.integers(0, 40, k), f[5:45], rng.integers(0, 40, 3)]) for k, f in enumerate(fps[:12])]
    classes = spark.createDataFrame([(f.tolist(), k, k % 2 == 0) for k, f in enumerate(fps)], "fp array<int>, class_id long, is_query boolean")
    got = {(r["query"], r.class_id): tuple(r)[2:] for r in media.links(classes, 1.0, 1, least_hits=1, hot=1 << 20).collect()}
    want = {}
    for q in range(0, len(fps), 2):
        for c in range(len(fps)):
            fp, other = fps[c], fps[q]
            votes = {d: sum(fp[i] == other[i - d] for i in range(len(fp)) if 0 <= i - d < len(other)) for d in range(-len(other) + 1, len(fp))}
            best = min(votes, key=lambda d: (-votes[d], d))
            if c != q and votes[best]:
                pairs = [(int(fp[i]), int(other[i - best])) for i in range(len(fp)) if 0 <= i - best < len(other)]
                want[q, c] = (best, votes[best], sum((a ^ b).bit_count() for a, b in pairs), len(pairs))
    assert got == want


def links_by_brute_force(fps: list, queries, least_hits: int) -> dict:
    want = {}
    for q in queries:
        for c, fp in enumerate(fps):
            votes = {d: sum(fp[i] == fps[q][i - d] for i in range(max(0, d), min(len(fp), len(fps[q]) + d))) for d in range(-len(fps[q]) + 1, len(fp))}
            best = min(votes, key=lambda d: (-votes[d], d))
            if c != q and votes[best] >= least_hits:
                want[q, c] = (best, votes[best], *media.differing(np.array(fp), np.array(fps[q]), best))
    return want


def test_common_integers_count_like_any_other(spark):
    """Few integers, all of them common, in no runs of four that repeat; every vote counts, in one round or several."""
    rng = np.random.default_rng(13)
    fps = [rng.integers(0, 6, rng.integers(5, 30)).tolist() for _ in range(40)] + [[3] * 12, [3] * 9, [7], [3, 5]]
    classes = spark.createDataFrame([(f, k, k % 3 == 0) for k, f in enumerate(fps)], "fp array<int>, class_id long, is_query boolean")
    want = links_by_brute_force(fps, range(0, len(fps), 3), 2)
    for options in ({"hot": 1}, {}, {"per_round": 60}):
        got = {(r["query"], r.class_id): tuple(r)[2:] for r in media.links(classes, 1.0, 1, **options).collect()}
        assert got == want and len(want) > 300


def test_votes_in_slices():
    """Slices smaller than a row's equals, and than a pair's, give the same offsets."""
    rng = np.random.default_rng(14)
    fps = [rng.integers(0, 4, rng.integers(1, 40)).astype(np.int32) for _ in range(25)]
    prints = media.Prints.of(np.arange(25), np.array([len(f) for f in fps]), np.concatenate(fps))
    want = {k: v[:2] for k, v in links_by_brute_force(fps, range(25), 2).items()}
    for pairs in (1, 50, 3000, media.PAIRS):
        rows = [r for part in media.best_offsets(prints, prints, 2, pairs) for r in zip(*(x.tolist() for x in part), strict=True)]
        assert {(q, c): (d, h) for c, q, d, h in rows} == want and len(rows) == len(want)


def aligned_by_brute_force(fps: dict, queries, most_errors: float, least: int) -> set:
    """Pairs with any offset whose overlap has few enough wrong bits."""
    found = set()
    for q in queries:
        for c, fp in fps.items():
            offsets = range(least - len(fps[q]), len(fp) - least + 1)
            if c != q and any(w <= most_errors * 32 * n for w, n in (media.differing(fp, fps[q], d) for d in offsets)):
                found.add((q, c))
    return found


def test_recall_against_all_pairs(spark):
    """Excerpts with noise, louder and softer, among others and behind a common jingle; at least 0.9 of all that align are found."""
    rng = np.random.default_rng(9)
    jingle, rows = tune(999, 20), []
    for k in range(60):
        x = tune(k, 90)
        rows.append((100 * k, pcm(np.concatenate([jingle, x]))))
        for j, noise in enumerate((100, 400, 900)):
            a = int(rng.integers(0, 40))
            y = x[256 * a : 256 * (a + 50)] * rng.uniform(0.4, 1.5)
            rows.append((100 * k + j + 1, pcm(y + rng.normal(0, noise, len(y)))))
    df = spark.createDataFrame([(i, bytearray(a)) for i, a in rows], "id long, audio binary")
    _, classes = media.classed(df, "id", "audio", F.col("id") % 100 == 0)
    fps = {r.class_id: np.array(r.fp, np.int32) for r in classes.collect()}
    want = aligned_by_brute_force(fps, [100 * k for k in range(0, 60, 4)], media.MOST_ERRORS, 32)
    assert len(want) > 30
    for hot in (media.HOT, 20):  # at 20 the jingle's integers count only as runs
        got = {(r["query"], r.class_id) for r in media.links(classes, hot=hot).collect()}
        recall = len(want & got) / len(want)
        print(f"recall {recall:.3f} of {len(want)} at hot {hot}")
        assert recall >= 0.9 and all(q == c - c % 100 for q, c in got)


def test_silence_and_hot_runs(spark):
    quiet = np.zeros(256 * 80)
    rows = [(k, bytearray(pcm(np.concatenate([tune(k, 40), quiet])))) for k in range(40)] + [(100, bytearray(pcm(quiet)))]
    _, classes = media.classed(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio", F.col("id") % 10 == 0)
    assert media.links(classes, hot=10).where("bit_errors > 0.15 * 32 * overlap").count() == 0


def test_media_edge_cases(spark):
    rows = [(1, None), (2, []), (3, [float("nan"), None, 0.5]), (None, [0.1] * 64), (3, [0.1] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = media.aligned(media.played(df, "vec_id", "embedding"), "id", "audio", F.col("id") % 3 == 0).collect()
    assert len(out) == 5 and {r.class_id for r in out if r.n_ints} == {3}
    assert media.aligned(media.played(df.limit(0), "vec_id", "embedding"), "id", "audio", F.col("id") > 0).count() == 0


def test_table_by_brute_force():
    names, slots = ["a", "b", "c"], 31
    import hashlib

    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
    want: dict[int, int] = {}
    while len(want) < slots:
        for k, order in enumerate(orders):
            if len(want) < slots:
                want[next(s for s in order if s not in want)] = k
    assert sharding.lookup_table(names, slots) == [want[s] for s in range(slots)]


def test_rows_go_to_their_slots(spark):
    keys = [0, 1, -5, 2**40, None, 7, 7]
    names = ["a", "b", "c"]
    table = sharding.lookup_table(names, 31)
    out = sharding.sharded(spark.createDataFrame([(k, "old", "x") for k in keys], "k long, slot string, Shard string"), "k", names, 31).collect()
    want = []
    for k in keys:
        h = 42 if k is None else xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42)
        slot = (h - 2**64 if h >> 63 else h) % 31
        want.append((k, slot, names[table[slot]]))
    assert sorted(map(repr, (tuple(r) for r in out))) == sorted(map(repr, want))


def test_written_shards_are_cut_by_rows(spark, tmp_path):
    df = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(900)], "k long, _file0 long")
    sharding.write_shards(df, str(tmp_path / "out"), "k", ["a", "b"], rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.k, r._file0, r.shard) for r in sharding.sharded(df, "k", ["a", "b"]).collect()}
    assert {(r.k, r._file0, r.shard) for r in back.collect()} == want
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 4 * 50  # the hot key's 600 rows are in many files


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(50)]
    table = sharding.lookup_table(names)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 49)
    assert moved / len(table) < 0.1
    weighted = np.bincount(sharding.lookup_table(["x", "y"], 1009, {"x": 3}))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_placement(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "q"), (1, "y", "q"), (None, "z", "q")], "doc_id long, text string, shard string")
    rows = sharding.sharded(df, "doc_id", ["a", "b", "c"]).collect()
    table = sharding.lookup_table(["a", "b", "c"])
    assert len(rows) == 3 and all(r.shard == "abc"[table[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.sharded(df.limit(0), "doc_id", ["a"]).count() == 0
    big = spark.range(2000).withColumnRenamed("id", "doc_id")
    sharding.write_shards(big, str(tmp_path / "out"), "doc_id", ["a", "b", "c"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000


@pytest.fixture(scope="module")
def stages(spark):
    frames = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], DATA).cache())
    return frames


def test_stages_keep_the_columns(stages):
    assert [f.columns for f in stages[:-1]] == [stages[0].columns] * 5


def test_each_stage_against_brute_force(spark, stages):
    rows = [{r.doc_id: r.text for r in f.collect()} for f in stages[:-1]]
    model = quality.trained(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert rows[1] == {k: t for k, t in rows[0].items() if model.score(t) >= 0.3}
    groups = similar_groups(rows[1])
    assert set(rows[2]) == set(groups.values())
    cut = repeated_words(list(rows[2].items()))
    assert {k: sha(" ".join(t.encode().decode().split())) for k, t in rows[3].items()} == {k: s for k, (n, gone, s) in cut.items() if not gone or gone < n}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    judged = brute_contamination(list(rows[3].items()), items)
    assert set(rows[4]) == {k for k in rows[3] if not judged[k][4]}


def test_last_stage(stages):
    from tokenizers import Tokenizer

    from gridspark.llm.queries import tokenizer_path

    tokenizer, texts = Tokenizer.from_file(tokenizer_path()), {r.doc_id: r.text for r in stages[-2].collect()}
    for r in stages[-1].collect():
        assert r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages(spark, stages):
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, DATA).collect()} == {r.doc_id: r.ids_sha256 for r in stages[-1].collect()}


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    good = "This is a plain sentence about rivers and towns. " * 12
    texts = [good, good, None, "", "buy!!! now!!! $$$ ||| ||| click", good + "And one more line here.\nWith another one.", "x" * 3000]
    own = ["score", "predicted", "N_WORDS", "n_removed", "removed", "kept_sha256", "contaminated", "_kept", "id", "tag", "bucket", "c1"]
    df = spark.createDataFrame([(k if k != 5 else None, t, *[f"{c}{k}" for c in own]) for k, t in enumerate(texts)], ", ".join(["doc_id long, text string", *(f"{c} string" for c in own)])).cache()
    before = {r.tag: r for r in df.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DATA)
        rows = out.collect()
        assert out.columns == df.columns and rows
        assert all(r[c] == before[r.tag][c] for r in rows for c in own) and all(r.doc_id == before[r.tag].doc_id for r in rows)
        assert stage(spark, df.limit(0), DATA).count() == 0
    assert corpus_pipeline.encode(spark, df, DATA).count() == len(texts)
