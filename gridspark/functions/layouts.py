"""Coordinate orders of an 8 x 8 block and the tables that go with them.

Three orders number the 64 coefficients: raster (8 * row + column), zigzag (by
anti-diagonals, alternating in direction), and aligned (the 49 coefficients off
the first row and column in zigzag order, then DC, the rest of the first row,
the rest of the first column).
"""

from __future__ import annotations


def _zigzag() -> list[int]:
    cells = [(r, c) for r in range(8) for c in range(8)]
    # Odd diagonals run downwards, even ones upwards.
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return [8 * r + c for r, c in cells]


def inverse(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for k, v in enumerate(order):
        out[v] = k
    return out


ZIGZAG_TO_RASTER = _zigzag()
ALIGNED_TO_RASTER = [r for r in ZIGZAG_TO_RASTER if r >= 8 and r % 8] + [0] + list(range(1, 8)) + list(range(8, 64, 8))
RASTER_TO_ZIGZAG = inverse(ZIGZAG_TO_RASTER)
RASTER_TO_ALIGNED = inverse(ALIGNED_TO_RASTER)
ZIGZAG_TO_ALIGNED = [RASTER_TO_ALIGNED[r] for r in ZIGZAG_TO_RASTER]
ALIGNED_TO_ZIGZAG = inverse(ZIGZAG_TO_ALIGNED)

INTERIOR, DC, ROW, COLUMN = range(0, 49), 49, range(50, 57), range(57, 64)

# The cosine basis scaled by 8192, by frequency, for the eight pixels of a line.
COSINE = [
    [8192, 8192, 8192, 8192, 8192, 8192, 8192, 8192],
    [11363, 9633, 6436, 2260, -2260, -6436, -9633, -11363],
    [10703, 4433, -4433, -10703, -10703, -4433, 4433, 10703],
    [9633, -2260, -11363, -6436, 6436, 11363, 2260, -9633],
    [8192, -8192, -8192, 8192, 8192, -8192, -8192, 8192],
    [6436, -11363, 2260, 9633, -9633, -2260, 11363, -6436],
    [4433, -10703, 10703, -4433, -4433, 10703, -10703, 4433],
    [2260, -6436, 9633, -11363, 11363, -9633, 6436, -2260],
]

# The largest coefficient at each raster position before quantisation.
FREQUENCY_MAX = [
    1024, 931, 985, 968, 1020, 968, 1020, 1020,
    932, 858, 884, 840, 932, 838, 854, 854,
    985, 884, 871, 875, 985, 878, 871, 854,
    967, 841, 876, 844, 967, 886, 870, 837,
    1020, 932, 985, 967, 1020, 969, 1020, 1020,
    969, 838, 878, 886, 969, 838, 969, 838,
    1020, 854, 871, 870, 1010, 969, 1020, 1020,
    1020, 854, 854, 838, 1020, 838, 1020, 838,
]

#: Bits of a residual that are coded without context.
NOISE_FLOOR = 7

# The first nonzero count of each of the ten bins that counts 0 to 49 fall into.
COUNT_BINS = [0, 1, 2, 3, 4, 6, 9, 13, 21, 32]

#: A quantisation table for the tests' blocks: coarser with frequency.
QUANT = [1 + (r // 8 + r % 8) // 3 for r in range(64)]
