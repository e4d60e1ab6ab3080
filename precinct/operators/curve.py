"""A curve through all boxes of halved sides: neighbouring points are sorted beside each other and cut into tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.runtime import send_to_workers

# Bits of the key that neighbouring locations are sorted by.
KEY_BITS = 60

send_to_workers(__name__)


def keyed_along(locs: DataFrame, root: dict, dims: list[str]) -> DataFrame:
    """The locations with the place `tile` of each on the curve: the bits of its dimensions in turn."""
    used = dims[:KEY_BITS]
    bits = KEY_BITS // len(used)
    key = F.lit(0).cast("bigint")
    kept = locs.select("pid", "w", *dims)
    for j, d in enumerate(used):
        low, high = root[f"lo_{d}"], root[f"hi_{d}"]
        if low < high:
            step = F.floor((F.col(d) - low) / (high - low) * float(1 << bits)).cast("bigint")
            step = F.least(step, F.lit((1 << bits) - 1).cast("bigint"))
            for i in range(bits):
                bit = F.shiftright(F.col(f"_step{j}"), i).bitwiseAND(F.lit(1).cast("bigint"))
                key = key + F.shiftleft(bit, i * len(used) + len(used) - 1 - j)
            kept = kept.withColumn(f"_step{j}", step)
    return kept.withColumn("tile", key).select("tile", "pid", "w", *dims)


def tile_ends(keys: np.ndarray, most: int) -> list[int]:
    """Where tiles of sorted keys end: boxes are halved until one holds `most` locations."""
    ends, waiting = [], [(0, len(keys))] if len(keys) else []
    while waiting:
        a, b = waiting.pop()
        apart = int(keys[a]) ^ int(keys[b - 1])
        if b - a <= most:
            ends.append(b)
        elif not apart:
            ends += [*range(a + most, b, most), b]
        else:
            half = 1 << (apart.bit_length() - 1)
            middle = a + int(np.searchsorted(keys[a:b], (int(keys[b - 1]) // half) * half))
            waiting += [(middle, b), (a, middle)]
    return ends
