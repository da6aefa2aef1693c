"""Operators on small frames: ties, nulls, empty frames, and both ways of a join."""

import random

from pyspark.sql import functions as F

from gridspark.operators import blocks, layout, ledger, ranking, scans, segments


def test_ranks_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, None, 1.0, 1.0, float("nan"), 2.5, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double")
    out = ranking.ranked(df, "v", "id").collect()
    key = lambda r: (r[1] is not None, r[1] != r[1], 0 if r[1] is None or r[1] != r[1] else r[1], r[0])
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=key), 1)}
    assert {r.id: r["rank"] for r in out} == want and all(r.total == 3000 for r in out)
    # Nulls, NaNs and ties are cut by the second column: no range holds much more than its share.
    sizes = [r["count"] for r in ranking.ordered(df, ["v", "id"]).groupBy("range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8


def test_ranks_of_nothing(spark):
    assert ranking.ranked(spark.createDataFrame([], "id long, v double"), "v", "id").count() == 0


def test_ranges_broadcast_and_bucketed_agree(spark):
    ranges = spark.createDataFrame([(k, k * 7, k * 7 + 7) for k in range(20)], "k long, start long, end long")
    rows = spark.range(0, 200).select(F.col("id").alias("v"))
    some = {(r.v, r.k) for r in scans.in_ranges(rows, ranges, "v").select("v", "k").collect()}
    other = {(r.v, r.k) for r in scans.in_ranges(rows, ranges, "v", limit=1).select("v", "k").collect()}
    assert some == other == {(v, min(v // 7, 19)) for v in range(200)}
    uneven = spark.createDataFrame([("a", 3, 5), ("b", 5, 150), ("c", 160, 161)], "k string, start long, end long")
    want = {(v, "a") for v in (3, 4)} | {(v, "b") for v in range(5, 150)} | {(v, "c") for v in range(160, 200)}
    for limit in (64, 1):
        assert {(r.v, r.k) for r in scans.in_ranges(rows.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), uneven, "v", limit=limit).select("v", "k").collect()} == want


def test_as_of_strict_and_not(spark):
    probes = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 1, 3)], "k string, at long, id int")
    marks = spark.createDataFrame([("a", 5, 50), ("a", 7, 70), ("a", 10, 100), ("c", 0, 0)], "k string, at long, x int")
    strict = {r.id: r.found_x for r in scans.as_of(probes, marks, ["k"], "at", ["x"]).collect()}
    loose = {r.id: r.found_x for r in scans.as_of(probes, marks, ["k"], "at", ["x"], strict=False).collect()}
    assert strict == {1: None, 2: 70, 3: None} and loose == {1: 50, 2: 100, 3: None}


def test_deltas_restore(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randint(-9, 9)) for k in range(5) for i in range(23)]
    df = spark.createDataFrame(rows, "k long, rn long, v long")
    back = scans.undeltas(scans.deltas(df, ["k"], ["rn"], "v", restart=5), ["k"], ["rn"])
    assert back.where("restored <> v").count() == 0 and back.count() == len(rows)


def test_islands(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 1, 0, 1, 0, 0, 1, 1, 1])] + [(2, 0, None), (2, 1, 1)], "k int, i int, m int")
    got = sorted((r.k, r.island, r["first"], r.length) for r in scans.islands(df, ["k"], ["i"], F.col("m") == 1).collect())
    assert got == [(1, 1, 1, 2), (1, 2, 4, 1), (1, 3, 7, 3), (2, 1, 2, 1)]


def test_codes_are_prefix_free(spark):
    counts = spark.createDataFrame([(s, (s * 7919) % 101 + 1) for s in range(150)], "symbol int, cnt long")
    codes = [format(r.code, f"0{r.len}b") for r in scans.canonical_codes(scans.ranked_lengths(counts)).collect()]
    assert len(set(codes)) == 150
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_splits_cover_all_rows(spark):
    rng = random.Random(8)
    lists = []
    for n in (1, 2, 3, 5, 40, 200):
        total, sizes = 0, []
        for _ in range(n):
            total += rng.randint(0, 9000)
            sizes.append(total)
        lists += [(n, i, s) for i, s in enumerate(sizes)]
    found = {}
    for r in scans.balanced_splits(spark.createDataFrame(lists, "k int, i int, s long"), "k", ["i"], "s").orderBy("k", "split_id").collect():
        found.setdefault(r.k, []).append((r.first_row, r.last_row, r.size))
    for k, splits in found.items():
        sizes = [s for n, _, s in lists if n == k]
        assert splits[0][0] == 0 and splits[-1][1] == k - 1 and all(a[1] == b[0] for a, b in zip(splits, splits[1:]))
        assert all(size == sizes[last] - sizes[first] for first, last, size in splits) and all(a < b for a, b, _ in splits[:-1])


def test_packets_cover_the_stream(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 256, 257, 4352, 4353, 69888, 69889, 300000)], "size long")
    rows = layout.packets(df, F.col("size")).groupBy("size").agg(F.sum("len").alias("n"), F.min("len").alias("least")).collect()
    assert {r.size: r.n for r in rows} == {n: n for n in (1, 256, 257, 4352, 4353, 69888, 69889, 300000)} and all(r.least > 0 for r in rows)


def test_neighbours_of_one_block(spark):
    df = spark.createDataFrame([(0, 0, 0, 5)], "image_id long, by int, bx int, v int")
    r = blocks.with_neighbours(df, v=F.col("v")).first()
    assert r.left_v is None and r.above_v is None and r.corner_v is None


def test_bill_of_nothing(spark):
    empty = spark.createDataFrame([], "category string, is_compressed boolean, bits long")
    assert ledger.billed(empty).count() == 0


def test_segments_of_broken_headers(spark):
    whole = bytes.fromhex("FFD8" + "FFE00004AABB" + "FFDB0005000107" + "FFDA0008010100003F00" + "FFDB0005000107")
    raws = [whole, whole[:7], b"", b"\xff\xd8", whole[:8] + b"\x00" + whole[9:], None]
    rows = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in enumerate(raws)], "k int, raw binary").select("k", segments.segments(F.col("raw")).alias("s")).collect()
    kinds = {r.k: [s.kind for s in r.s or []] for r in rows}
    assert kinds == {0: [0xE0, 0xDB, 0xDA], 1: [], 2: [], 3: [], 4: [0xE0], 5: []}


def test_a_header_of_a_hundred_segments(spark):
    many = bytes.fromhex("FFD8") + b"".join(bytes.fromhex("FFE0") + (2 + k % 5).to_bytes(2, "big") + b"\xff" * (k % 5) for k in range(100)) + bytes.fromhex("FFC00003AAFFDA0008010100003F00FFE00002")
    row = spark.createDataFrame([(bytearray(many),)], "raw binary").select(segments.segments(F.col("raw")).alias("s")).select("s", F.hex(segments.rebuilt(F.col("s"))).alias("r")).first()
    assert [s.kind for s in row.s] == [0xE0] * 100 + [0xC0, 0xDA] and [len(s.payload) for s in row.s[:100]] == [k % 5 for k in range(100)]
    assert row.r == "FFD8FFC00003AAFFDA0008010100003F00"


def test_handoffs_round_trip(spark):
    df = spark.createDataFrame([(1, 65535, 2**32 - 1, 255, 7, -32768, 32767)], "k int, start long, size long, o int, b int, x int, y int")
    one = segments.handoff(F.col("start"), F.col("size"), F.col("o"), F.col("b"), [F.col("x"), F.col("y")])
    back = df.select(segments.read_handoffs(segments.handoff_list(F.array(one, one))).alias("h")).first().h
    assert [(h.start, h.end, h.size, h.overhang, h.overhang_bits, h["last"]) for h in back] == [(65535, 65535, 2**32 - 1, 255, 7, [-32768, 32767, 0]), (65535, None, 2**32 - 1, 255, 7, [-32768, 32767, 0])]


def test_stored_texts(spark):
    from gridspark.operators import bytestreams
    from gridspark.streaming.jobs import shared_folder

    df = spark.createDataFrame([(1, "a" * 1000), (2, "xy"), (3, ""), (4, None)], "id long, t string")
    rows = {r.id: r for r in bytestreams.stored(df, "id", "t", shared_folder(spark)).collect()}
    assert [rows[k].n_bytes for k in (1, 2, 3, 4)] == [1000, 2, 0, 0] and all(r.equal for r in rows.values())


def test_runs_give_bits_back(spark):
    from gridspark.operators import bytestreams

    rng = random.Random(3)
    rows = [(k, i, int(rng.random() < share)) for k, share in enumerate((0.0, 1.0, 0.5, 0.02)) for i in range(400)]
    got = {r.k: r for r in bytestreams.run_coded(spark.createDataFrame(rows, "k int, i int, b int"), "k", ["i"], "b").collect()}
    for k in range(4):
        bits_ = [b for x, _, b in rows if x == k]
        assert (got[k].n_bits, got[k].ones, got[k].runs, got[k].equal) == (400, sum(bits_), 1 + sum(a != b for a, b in zip(bits_, bits_[1:])), True)


def test_gcd(spark):
    import math

    rng = random.Random(1)
    pairs = [(rng.randint(1, 2**40), rng.randint(1, 2**40)) for _ in range(50)] + [(1, 1), (12, 18), (7, 7)]
    for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", layout.gcd(F.col("a"), F.col("b")).alias("g")).collect():
        assert r.g == math.gcd(r.a, r.b)


def test_scan_orders_of_whole_images_by_walking(spark):
    images = [(1, 333, 211, c, h, v) for c, h, v in ((0, 2, 2), (1, 1, 1), (2, 1, 1))] + [(3, 97, 50, 0, 1, 2), (3, 97, 50, 1, 1, 1)]
    g = layout.geometry(spark.createDataFrame(images, "image_id long, width long, height long, component int, sh int, sv int"))
    both = {(r.image_id, r.component): [] for r in g.collect()}
    for r in layout.interleaved(g).orderBy("unit", "sub").collect():
        both[r.image_id, r.component].append((r.dpos, r.padding))
    single = {k: [] for k in both}
    for r in layout.non_interleaved(g.withColumn("every", 2 * F.col("image_id") + 1)).orderBy("step").collect():
        single[r.image_id, r.component].append((r.dpos, r.restart))
    for r in g.collect():
        x = [(my * r.sv + y, mx * r.sh + z) for my in range(r.mcuv) for mx in range(r.mcuh) for y in range(r.sv) for z in range(r.sh)]
        assert both[r.image_id, r.component] == [(a * r.bch + b, a >= r.ncv or b >= r.nch) for a, b in x]
        dpos, left, want, restart = 0, 2 * r.image_id + 1, [], False
        while dpos < r.bc:  # one step after another
            want.append((dpos, restart))
            dpos += 1
            if r.bch != r.nch and dpos % r.bch == r.nch:
                dpos += r.bch - r.nch
            if r.bcv != r.ncv and dpos // r.bch == r.ncv:
                dpos = r.bc
            left -= 1
            restart = left == 0
            left = left or 2 * r.image_id + 1
        assert single[r.image_id, r.component] == want


def test_scan_totals_in_closed_form(spark):
    rng = random.Random(6)
    images = [(k, rng.randint(1, 300), rng.randint(1, 200), c, h if c == 0 else 1, v if c == 0 else 1) for k in range(40) for h, v in [(rng.randint(1, 2), rng.randint(1, 2))] for c in range(3)]
    images += [(7, 41, 90, c, 1, 1) for c in range(3)]  # shares its id
    images += [(90, 100, 0, 0, 1, 1), (91, None, 50, 0, 1, 1), (None, 20, 30, 0, 1, 1)]  # no blocks, no width, no id
    g = layout.geometry(spark.createDataFrame(images, "image_id long, width long, height long, component int, sh int, sv int")).withColumn("every", F.col("image_id") % 9)
    order = F.col("unit") * F.col("sh") * F.col("sv") + F.col("sub") + 1
    whole = layout.interleaved(g).groupBy("image_id", "component").agg(F.count("*").alias("n"), F.max("dpos").alias("last"), F.sum(F.col("dpos") * order).alias("checksum"), F.sum(F.col("padding").cast("long")).alias("padding"))
    single = layout.non_interleaved(g).groupBy("image_id", "component").agg(F.count("*").alias("n"), F.max("dpos").alias("last"), F.sum(F.col("dpos") * (F.col("step") + 1)).alias("checksum"), F.sum(F.col("restart").cast("long")).alias("restarts"), F.sum("countdown").alias("countdown"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert len(rows(whole)) == 121
    assert rows(layout.interleaved_totals(g)) == rows(whole)
    assert rows(layout.non_interleaved_totals(g)) == rows(single)


def test_scans_of_large_images(spark, tmp_path):
    """Images of 160,000 blocks and more, whose rows were made one by one; the plans hold no generator but that of components."""
    from gridspark.plans import layout_queries

    spark.range(20_000).selectExpr("id AS p_partkey", "49 + cast(id % 2 AS int) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    for query in (layout_queries.scan_positions_whole, layout_queries.scan_positions_single):
        df = query(spark, str(tmp_path))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
        assert df.count() == 60_000


def test_frames_are_made_once_a_row(spark):
    """The header's bytes are told from a value that is computed once, not from its expression wherever a fold looks at it."""
    from gridspark.plans import container_queries

    from .conftest import DATA

    plan = container_queries.frame_components(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p_size") < 20


def test_components_of_broken_headers(spark):
    frame = "FFC0000B080010002001" + "012203"
    raws = [bytes.fromhex("FFD8" + x + "FFDA0008010100003F00") for x in (frame, "FFDB0043" + "03" + "09" * 64 + frame, "FFDB0005000107" + frame, "")] + [None]
    rows = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in enumerate(raws)], "k int, raw binary").select("k", segments.components(segments.segments(F.col("raw"))).alias("c")).collect()
    assert {r.k: [tuple(c) for c in r.c] if r.c else None for r in rows} == {0: [(1, 2, 2, 3, None)], 1: [(1, 2, 2, 3, 9)], 2: [(1, 2, 2, 3, None)], 3: None, 4: None}
