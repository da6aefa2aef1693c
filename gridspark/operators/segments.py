"""Header segments and hand-off records as bytes, and block tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.layouts import COLUMN, ROW
from .blocks import once

# Marker bytes of header segments.
START, END, QUANT_TABLE, FRAME, CODE_TABLE, RESTART, SCAN = 0xD8, 0xD9, 0xDB, 0xC0, 0xC4, 0xDD, 0xDA
KEPT = (CODE_TABLE, QUANT_TABLE, FRAME, 0xC1, 0xC2, RESTART, SCAN)


def byte(v: Column | int) -> Column:
    return bits.little_endian(F.lit(v) if isinstance(v, int) else v, 1)


def segment(kind: int, payload: Column) -> Column:
    """A marker, the length of what follows (itself included), and the payload."""
    return F.concat(byte(0xFF), byte(kind), bits.big_endian(F.length(payload) + 2), payload)


SEGMENT = "struct<kind:int,offset:int,len:int,payload:binary>"


def segments(raw: Column) -> Column:
    """The segments of a header up to its scan, as an array; it ends early where a marker or a length doesn't fit.

    A header has no more segments than bytes 0xFF, which bounds the fold.
    """
    return once(raw, _segments)


def _segments(raw: Column) -> Column:
    latin = F.decode(raw, "ISO-8859-1")
    most = F.length(latin) - F.length(F.replace(latin, F.lit("\xff"), F.lit("")))
    start = F.struct(F.lit(3).alias("at"), F.lit(False).alias("done"), F.array().cast(f"array<{SEGMENT}>").alias("found"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        kind = bits.from_big_endian(raw, at + 1, 1).cast("int")
        size = bits.from_big_endian(raw, at + 2).cast("int")

        def grown(size: Column) -> Column:
            whole = F.coalesce((F.hex(F.substring(raw, at, F.lit(1))) == "FF") & (size >= 2) & (at + 1 + size <= F.length(raw)), F.lit(False))
            item = F.struct(kind.alias("kind"), (at - 1).alias("offset"), size.alias("len"), F.substring(raw, at + 4, size - 2).alias("payload")).cast(SEGMENT)
            more = once(item, lambda item: F.struct((at + 2 + size).alias("at"), (item["kind"] == SCAN).alias("done"), F.concat(state["found"], F.array(item)).alias("found")))
            over = F.struct(at.alias("at"), F.lit(True).alias("done"), state["found"].alias("found"))
            return F.when(whole, more).otherwise(over)

        return F.when(state["done"], state).otherwise(once(size, grown))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), start, step)["found"]


def scan_parts(raw: Column, found: Column) -> Column:
    """{scan, restarts, trailing} of a whole image: the bytes between its header and its end without fillers and restart marks, how many marks there were, and what follows the end.

    scan is null where the header has no scan segment; an image without an end has no trailing bytes.
    """
    last = F.get(F.filter(found, lambda s: s["kind"] == SCAN), 0)
    body = F.decode(F.substring(raw, last["offset"] + last["len"] + 3, F.length(raw)), "ISO-8859-1")
    end = F.instr(body, F.lit("\xff\xd9"))
    data = F.when(end > 0, F.substring(body, F.lit(1), end - 1)).otherwise(body)
    plain = F.regexp_replace(data, "\xff[\xd0-\xd7]", "")
    encode = lambda s: F.encode(s, "ISO-8859-1")
    return F.struct(
        bits.unstuffed(encode(plain), 0xFF).alias("scan"),
        F.size(F.regexp_extract_all(data, F.lit("(\xff[\xd0-\xd7])"), F.lit(1))).alias("restarts"),
        encode(F.when(end > 0, F.substring(body, end + 2, F.length(body))).otherwise("")).alias("trailing"),
    )


def rebuilt(found: Column) -> Column:
    """A header of the needed segments alone, in their order."""
    kept = F.filter(found, lambda s: s["kind"].isin(*KEPT))
    parts = F.transform(kept, lambda s: F.concat(byte(0xFF), byte(s["kind"]), bits.big_endian(s["len"]), s["payload"]))
    return F.aggregate(parts, F.concat(byte(0xFF), byte(START)), lambda a, b: F.concat(a, b))


def frame_fields(found: Column) -> dict[str, Column]:
    """Height, width, components and first sampling factors from the frame segment; an error where a frame or a table is missing."""
    frame = F.get(F.filter(found, lambda s: s["kind"].isin(FRAME, 0xC1, 0xC2)), 0)["payload"]
    restart = F.get(F.filter(found, lambda s: s["kind"] == RESTART), 0)["payload"]
    factors = bits.from_big_endian(frame, F.lit(8), 1)
    has = lambda kind: F.exists(found, lambda s: s["kind"] == kind)
    error = F.when(frame.isNull(), "no frame").when(~has(QUANT_TABLE), "no table").when((bits.int_div(factors, 16) > 2) | (factors % 16 > 2), "sampling").otherwise("ok")
    return {
        "height": bits.from_big_endian(frame, F.lit(2)),
        "width": bits.from_big_endian(frame, F.lit(4)),
        "components": bits.from_big_endian(frame, F.lit(6), 1),
        "sh": bits.int_div(factors, 16),
        "sv": factors % 16,
        "restart": F.coalesce(bits.from_big_endian(restart, F.lit(1)), F.lit(0).cast("long")),
        "error": error,
    }


def components(found: Column) -> Column:
    """The frame's components as an array of {jid, sh, sv, quant, first_quant}; first_quant is the first value of its quantiser table, null where the header lacks it.

    Tables of 8-bit values are read, several in a segment or one.
    """
    at = lambda raw, i: bits.from_big_endian(raw, i, F.lit(1))
    cut = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), bits.int_div(s["len"] - 2, 65) - 1), lambda k: F.substring(s["payload"], (65 * k + 1).cast("int"), F.lit(65)))
    tables = F.flatten(F.transform(F.filter(found, lambda s: (s["kind"] == QUANT_TABLE) & (s["len"] >= 67)), cut))
    firsts = F.transform(tables, lambda t: F.struct(at(t, F.lit(1)).alias("id"), at(t, F.lit(2)).alias("first")))

    def told(frame: Column, firsts: Column) -> Column:
        def component(k: Column) -> Column:
            read = F.struct(at(frame, 3 * k + 7).alias("jid"), at(frame, 3 * k + 8).alias("factors"), at(frame, 3 * k + 9).alias("quant"))
            own = lambda c: F.get(F.filter(firsts, lambda t: t["id"] == c["quant"]), 0)
            return once(read, lambda c: F.struct(c["jid"].alias("jid"), bits.int_div(c["factors"], 16).alias("sh"), (c["factors"] % 16).alias("sv"), c["quant"].alias("quant"), own(c)["first"].alias("first_quant")))

        return F.transform(F.sequence(F.lit(0), (at(frame, F.lit(6)) - 1).cast("int")), component)

    frame = F.get(F.filter(found, lambda s: s["kind"].isin(FRAME, 0xC1, 0xC2)), 0)["payload"]
    return once(frame, lambda frame: once(firsts, lambda firsts: told(frame, firsts)))


def handoff(start: Column, size: Column, overhang: Column, overhang_bits: Column, last: list[Column]) -> Column:
    """16 bytes: first row, segment size, overhang byte and its bits, and four last values."""
    values = [*last, *[F.lit(0)] * (4 - len(last))]
    return F.concat(bits.little_endian(start, 2), bits.little_endian(size, 4), byte(overhang), byte(overhang_bits), *(bits.little_endian(bits.wrap16(v), 2) for v in values))


def handoff_list(records: Column) -> Column:
    return F.aggregate(records, F.concat(F.encode(F.lit("H"), "UTF-8"), byte(F.size(records))), lambda a, b: F.concat(a, b))


def read_handoffs(raw: Column) -> Column:
    """An array of records; the end of one is the start of the next, the last one's is null."""
    n = bits.from_little_endian(raw, 2, 1).cast("int")

    def signed(at: Column) -> Column:
        v = bits.from_little_endian(raw, at, 2)
        return F.when(v >= 32768, v - 65536).otherwise(v)

    def record(i: Column) -> Column:
        at = 16 * i + 3
        end = F.when(i + 1 < n, bits.from_little_endian(raw, at + 16, 2))
        return F.struct(
            bits.from_little_endian(raw, at, 2).alias("start"),
            end.alias("end"),
            bits.from_little_endian(raw, at + 2, 4).alias("size"),
            bits.from_little_endian(raw, at + 6, 1).alias("overhang"),
            bits.from_little_endian(raw, at + 7, 1).alias("overhang_bits"),
            F.array(*(signed(at + 8 + 2 * k) for k in range(3))).alias("last"),
        )

    return F.transform(F.sequence(F.lit(0), n - 1), record)


# -- tokens --------------------------------------------------------------------

# Categories of a coefficient's size bits, by their place.
SIZE_BITS = ["BITMAP", "EXP1", "EXP2", "EXP3", "EXPN"]


def coefficient_tokens(v: Column, suffix: Column) -> Column:
    """The (category, bit) tokens of one coefficient: its size in unary, its sign, and the bits below its highest."""
    size = bits.bit_length(v)
    name = lambda s: F.concat(s, F.lit("_"), suffix)
    token = lambda c, b: F.struct(name(c).alias("category"), b.cast("int").alias("bit"))
    unary = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(10))), lambda i: token(F.element_at(F.array(*map(F.lit, SIZE_BITS)), F.least(i, F.lit(4)) + 1), size != i))
    sign = F.when(size > 0, F.array(token(F.lit("SIGN"), v >= 0))).otherwise(F.array().cast("array<struct<category:string,bit:int>>"))
    low = F.when(size > 1, F.sequence(F.lit(0), size - 2)).otherwise(F.array().cast("array<int>"))
    rest = F.transform(low, lambda i: token(F.lit("RES"), F.call_function("shiftright", F.abs(v), i) % 2))
    return F.concat(unary, sign, rest)


#: Regions of a block in the order of coding: name, first coefficient, how many, and bits of the count.
REGIONS = [("7x7", 0, 49, 6), ("EDGE", ROW.start, 7, 3), ("EDGE", COLUMN.start, 7, 3)]


def token_list(coef: Column) -> Column:
    """A block's tokens in order as an array of {category, bit}.

    A region's coefficients are told up to its last nonzero one, after their
    count: six bits for the interior, three for each edge.
    """

    def told(suffix: str, first: int, n: int, width: int) -> list[Column]:
        some = F.slice(coef, first + 1, n)
        count = F.size(F.filter(some, lambda x: x != 0))
        last = F.array_max(F.transform(some, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
        counted = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(F.lit(f"NZ_{suffix}").alias("category"), (F.call_function("shiftright", count, i) % 2).cast("int").alias("bit")))
        return [counted, F.flatten(F.transform(F.slice(some, 1, last), lambda v: coefficient_tokens(v, F.lit(suffix))))]

    return F.concat(*(c for r in REGIONS for c in told(*r)))


def tokens(blk: DataFrame) -> DataFrame:
    """(category, zeros, ones) over the interior and edge coefficients of all blocks."""
    rows = blk.select(F.explode(token_list(F.col("coef"))).alias("t")).select("t.*")
    return rows.groupBy("category").agg(F.sum((F.col("bit") == 0).cast("long")).alias("zeros"), F.sum((F.col("bit") == 1).cast("long")).alias("ones"))
