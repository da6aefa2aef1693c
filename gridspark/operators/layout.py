"""Image geometry, row plans, packets and memory estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits


def geometry(images: DataFrame) -> DataFrame:
    """(image_id, width, height, component, sh, sv) -> with block counts of each component.

    mcuh, mcuv: units across and down, from the largest sampling factors of the
    image; bch, bcv, bc: blocks in whole units; nch, ncv, nc: blocks that hold
    pixels; share: the component's part of the image's blocks in hundredths.
    """
    image = Window.partitionBy("image_id")
    out = images.withColumns({"smh": F.max("sh").over(image), "smv": F.max("sv").over(image)})
    out = out.withColumns({"mcuh": bits.ceil_div(F.col("width"), 8 * F.col("smh")), "mcuv": bits.ceil_div(F.col("height"), 8 * F.col("smv"))})
    out = out.withColumns({"bch": F.col("mcuh") * F.col("sh"), "bcv": F.col("mcuv") * F.col("sv")})
    out = out.withColumns({"nch": bits.ceil_div(F.col("width") * F.col("sh"), 8 * F.col("smh")), "ncv": bits.ceil_div(F.col("height") * F.col("sv"), 8 * F.col("smv"))})
    out = out.withColumns({"bc": F.col("bch") * F.col("bcv"), "nc": F.col("nch") * F.col("ncv")})
    return out.withColumn("share", bits.int_div(F.col("bc") * 100, F.sum("bc").over(image))).drop("smh", "smv")


def row_plan(images: DataFrame) -> DataFrame:
    """(image_id, mcuv, heights array, coded array) -> a row for each block row, in the order of coding.

    heights: block rows by component, coded: how many of them hold data. Within a
    unit row components come from last to first. skip: nothing to code in this
    row; done: nor in any component but the last from this unit row on.
    """
    rows = images.withColumn("multiple", F.transform("heights", lambda h: bits.int_div(h, F.col("mcuv"))))
    rows = rows.withColumn("per_unit", F.aggregate("multiple", F.lit(0).cast("long"), lambda a, b: a + b))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("per_unit") * F.col("mcuv") - 1)))
    rows = rows.withColumns({"mcu_row": bits.int_div(F.col("i"), F.col("per_unit")), "place": F.col("i") % F.col("per_unit")})
    # Rows of the components after each one, which come before it.
    after = lambda c: F.aggregate(F.slice("multiple", c + 2, F.size("multiple")), F.lit(0).cast("long"), lambda a, b: a + b)
    fits = F.filter(F.sequence(F.lit(0), F.size("multiple") - 1), lambda c: (F.col("place") >= after(c)) & (F.col("place") < after(c) + F.get("multiple", c)))
    rows = rows.withColumn("component", F.get(fits, 0))
    rows = rows.withColumn("within", F.col("place") - after(F.col("component")))
    rows = rows.withColumn("y", F.col("mcu_row") * F.get("multiple", F.col("component")) + F.col("within"))
    skip = F.col("y") >= F.get("coded", F.col("component"))
    open_ = F.exists(F.sequence(F.lit(0), F.size("multiple") - 2), lambda c: F.col("mcu_row") * F.get("multiple", c) < F.get("coded", c))
    last = (F.col("component") == 0) & (F.col("within") + 1 == F.get("multiple", 0))
    return rows.select("image_id", "i", "mcu_row", "component", "y", last.alias("last_of_unit"), skip.alias("skip"), (skip & ~open_).alias("done"))


#: Sizes of a stream's first and second packet, and of all later ones.
SCHEDULE = (256, 4096, 65536)


def packets(df: DataFrame, size: Column) -> DataFrame:
    """df with a row per packet of a stream of size bytes: (round, start, len, header).

    Streams take turns: round, then stream, is the order in the file. A packet of
    exactly 4,096, 16,384 or 65,536 bytes has a header of one byte, any other of three.
    """
    first, second, later = SCHEDULE
    rest = F.greatest(size - first - second, F.lit(0))
    count = F.when(size <= 0, 0).when(size <= first, 1).otherwise(2 + bits.ceil_div(rest, later))
    rows = df.withColumn("_n", count.cast("int")).withColumn("round", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))))
    start = F.when(F.col("round") == 0, 0).otherwise(first + F.when(F.col("round") == 1, 0).otherwise(second + (F.col("round") - 2) * later))
    most = F.when(F.col("round") == 0, first).when(F.col("round") == 1, second).otherwise(later)
    rows = rows.withColumn("start", start.cast("long")).withColumn("len", F.least(most.cast("long"), size - F.col("start")))
    return rows.withColumn("header", F.when(F.col("len").isin(4096, 16384, 65536), 1).otherwise(3)).drop("_n")


def packet_list(size: Column) -> Column:
    """The packets of one stream as an array of {round, start, len}."""
    first, second, later = SCHEDULE
    count = F.when(size <= 0, 0).when(size <= first, 1).otherwise(2 + bits.ceil_div(F.greatest(size - first - second, F.lit(0)), later)).cast("int")

    def packet(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(first + F.when(k == 1, 0).otherwise(second + (k - 2) * later)).cast("long")
        most = F.when(k == 0, first).when(k == 1, second).otherwise(later).cast("long")
        return F.struct(k.alias("round"), start.alias("start"), F.least(most, size - start).alias("len"))

    return F.transform(F.filter(F.sequence(F.lit(0), count), lambda k: k < count), packet)


def laid_end_to_end(df: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """df with begin_at, where each row's bytes start when a key's rows are laid end to end in order, and member, its number from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return df.withColumn("begin_at", before).withColumn("member", F.row_number().over(w))


def turns(df: DataFrame, keys: list[str], component: str, batch: str, target: str) -> DataFrame:
    """df with step: whose batch comes next is the component that is least far along, the lower one of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col(batch) / F.col(target), component)
    return df.withColumn("step", F.row_number().over(w))


# Bytes of the coder's model, of its multiplexer and of a bit writer.
MODEL_BYTES = 721_564 * 3
MUX_BYTES = 4096 * 1024 + 131_072
WRITER_BYTES = 65_536 + 64


def memory_bound(streaming: Column, file_size: Column, header: Column, packed_header: Column) -> Column:
    """Bytes that decoding needs: two block rows of each component, the file, the model, and header buffers."""
    doubled = packed_header * 2
    grown = F.when((packed_header > 0) & (doubled < header), doubled * (bits.next_power_of_two(bits.ceil_div(header, doubled)) - 1)).otherwise(0)
    garbage = bits.next_power_of_two(header)
    return streaming + WRITER_BYTES + file_size + MODEL_BYTES + garbage + header + packed_header * 3 + grown + MUX_BYTES


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm on numbers from 1 up to 2**40, sixty steps at most."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))["a"]


def unit_position(unit: Column, sub: Column, mcuh: Column, sh: Column, sv: Column) -> Column:
    """A block's number in raster order from its unit and its place there, units and places both in raster order."""
    row = bits.int_div(unit, mcuh) * sv + bits.int_div(sub, sh)
    return row * (mcuh * sh) + (unit % mcuh) * sh + sub % sh


def interleaved(g: DataFrame) -> DataFrame:
    """(image_id, component, unit, sub, dpos): every block of a geometry in interleaved scan order."""
    rows = g.where("bc > 0").withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mcuh") * F.col("mcuv") - 1)))
    rows = rows.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("sh") * F.col("sv") - 1)))
    place = unit_position(F.col("unit"), F.col("sub"), F.col("mcuh"), F.col("sh"), F.col("sv"))
    return rows.withColumn("dpos", place).withColumn("padding", (F.col("dpos") % F.col("bch") >= F.col("nch")) | (bits.int_div(F.col("dpos"), F.col("bch")) >= F.col("ncv")))


def grid_sums(g: DataFrame, made: dict[str, Column]) -> DataFrame:
    """(image_id, component, n, last, ..) of grids' own totals: rows that share an image and a component are added up; grids without blocks have none."""
    own = g.where((F.col("bc") > 0) & (F.col("nc") > 0)).select("image_id", "component", *(c.alias(k) for k, c in made.items()))
    return own.groupBy("image_id", "component").agg(*((F.max if k == "last" else F.sum)(k).alias(k) for k in made))


def total(m: Column) -> Column:
    """0 + 1 + .. + (m - 1)."""
    return bits.int_div(m * (m - 1), 2)


def squares(m: Column) -> Column:
    """0 + 1 + 4 + .. + (m - 1)**2."""
    return bits.int_div((m - 1) * m * (2 * m - 1), 6)


def interleaved_totals(g: DataFrame) -> DataFrame:
    """(image_id, component, n, last, checksum, padding) of ``interleaved`` in closed form, without a row per block.

    checksum adds up place times number in the scan, from 1. Both are linear in a
    unit's row and column, so their products' sum over the grid takes only the sums
    of numbers and of squares; each of a unit's blocks, four by four at most, has a
    term of its own.
    """
    m, r, sh, own = F.col("mcuh"), F.col("mcuv"), F.col("sh").cast("long"), (F.col("sh") * F.col("sv")).cast("long")

    def term(sub: Column) -> Column:
        place, number = bits.int_div(sub, sh) * F.col("bch") + sub % sh, sub + 1  # of the first unit's block
        by_row, number_by_row = F.col("sv") * F.col("bch"), m * own
        product = r * place * number + (place * number_by_row + by_row * number) * total(r) + by_row * number_by_row * squares(r)
        single = own * (r * place + by_row * total(r)) + sh * (r * number + number_by_row * total(r))
        return m * product + total(m) * single + r * sh * own * squares(m)

    checksum = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), own - 1), term), F.lit(0).cast("long"), lambda a, b: a + b)
    return grid_sums(g, {"n": F.col("bc"), "last": F.col("bc") - 1, "checksum": checksum, "padding": F.col("bc") - F.col("nc")})


def non_interleaved_totals(g: DataFrame) -> DataFrame:
    """(image_id, component, n, last, checksum, restarts, countdown) of ``non_interleaved`` in closed form, without a row per block.

    checksum adds up place times number in the scan, from 1. The block in row y and
    column x has place y * bch + x and number y * nch + x + 1. Countdowns run from
    ``every`` to 1 over and over, and the last run may end early.
    """
    m, r, wide, n, every = F.col("nch"), F.col("ncv"), F.col("bch"), F.col("nc"), F.col("every").cast("long")
    checksum = m * wide * (m * squares(r) + total(r)) + total(m) * ((wide + m) * total(r) + r) + r * squares(m)
    runs, left = bits.int_div(n, F.greatest(every, F.lit(1).cast("long"))), n % F.greatest(every, F.lit(1).cast("long"))
    past = runs * total(every) + total(left)  # blocks since the last restart, added up
    counted = lambda c: F.when(every > 0, c).otherwise(F.lit(0).cast("long"))
    restarts = bits.int_div(n - 1, F.greatest(every, F.lit(1).cast("long")))
    return grid_sums(g, {"n": n, "last": (r - 1) * wide + m - 1, "checksum": checksum, "restarts": counted(restarts), "countdown": counted(n * every - past)})


def non_interleaved(g: DataFrame) -> DataFrame:
    """(.., step, dpos, countdown, restart): a component's blocks that hold pixels in raster order; a restart comes before each one that ``every`` blocks precede since the last (0: none)."""
    rows = g.where("nc > 0").withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nch") * F.col("ncv") - 1)))
    past = F.col("step") % F.greatest(F.col("every"), F.lit(1).cast("long"))
    rows = rows.withColumn("dpos", bits.int_div(F.col("step"), F.col("nch")) * F.col("bch") + F.col("step") % F.col("nch"))
    return rows.withColumn("countdown", F.when(F.col("every") > 0, F.col("every") - past).otherwise(F.lit(0).cast("long"))).withColumn("restart", (F.col("every") > 0) & (F.col("step") > 0) & (past == 0))


def truncated_rows(rows: Column, coded: Column, multiple: Column) -> Column:
    """Block rows that hold the first ``coded`` parts in a hundred of an image, raised to whole units."""
    return F.least(rows, bits.ceil_div(bits.ceil_div(rows * coded, 100), multiple) * multiple)


# -- packets as bytes ------------------------------------------------------------

# Sizes that a packet's header of one byte tells, by their class, and the end of a file.
SIZE_CLASSES = {4096: 1, 16384: 2, 65536: 3}
END_OF_FILE = "FFFEFF"


def packet_bytes(stream: Column, payload: Column) -> Column:
    """A header and the payload: the stream in the low four bits, the size class above; other sizes, less one, in two more bytes."""
    n = F.length(payload)
    kind = F.lit(0)
    for size, k in SIZE_CLASSES.items():
        kind = F.when(n == size, k).otherwise(kind)
    first = bits.little_endian(stream + 16 * kind, 1)
    return F.concat(F.when(kind > 0, first).otherwise(F.concat(first, bits.little_endian(n - 1, 2))), payload)


PACKET = "struct<stream:int,start:int,len:int>"


def parsed_packets(raw: Column) -> Column:
    """The packets of a file up to its end mark, as an array of {stream, start, len}; start counts from 0.

    The fold goes on as long as a packet can begin: one in four bytes at most.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(f"array<{PACKET}>").alias("found"))
    byte = lambda at: bits.from_big_endian(raw, at + 1, F.lit(1)).cast("int")

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        head = byte(at)
        kind = bits.int_div(head, 16) % 4
        size = F.when(kind == 0, byte(at + 1) + 256 * byte(at + 2) + 1).otherwise(F.pow(F.lit(4), kind).cast("int") * 1024).cast("int")
        begin = at + F.when(kind == 0, 3).otherwise(1)
        over = (at >= F.length(raw)) | (F.hex(F.substring(raw, at + 1, F.lit(3))) == END_OF_FILE)
        item = F.struct((head % 16).alias("stream"), begin.alias("start"), size.alias("len")).cast(PACKET)
        ended = F.struct(at.alias("at"), F.lit(True).alias("done"), state["found"].alias("found"))
        grown = F.struct((begin + size).alias("at"), F.lit(False).alias("done"), F.concat(state["found"], F.array(item)).alias("found"))
        return F.when(state["done"], state).when(over, ended).otherwise(grown)

    return F.aggregate(F.sequence(F.lit(1), bits.int_div(F.length(raw), 4) + 1), start, step)["found"]
