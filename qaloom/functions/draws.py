"""Hash draws: randomness that depends on a key, not on partitioning, retries or row order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.staging import let

# As many bits as a DOUBLE holds exactly: unit draws stay below 1, and remainders reach every row of a large table.
SPAN = 1 << 52


def of_text(text: Column) -> Column:
    """A BIGINT in [0, SPAN) that is a function of the text only."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def draw(seed: str, *keys: Column) -> Column:
    """A BIGINT in [0, 2**52) that is a function of the seed and the key columns only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return of_text(text)


def unit(seed: str, *keys: Column) -> Column:
    """A DOUBLE in [0, 1)."""
    return draw(seed, *keys) / F.lit(float(SPAN))


def normal(seed: str, *keys: Column) -> Column:
    """A standard normal draw (Box-Muller on two unit draws)."""
    radius = F.sqrt(-2.0 * F.log((draw(f"{seed}:r", *keys) + 1) / F.lit(float(SPAN))))
    return radius * F.cos(2.0 * math.pi * unit(f"{seed}:a", *keys))


def pick(options: list, seed: str, *keys: Column) -> Column:
    """One of a fixed list of options, evenly."""
    array = F.array(*[F.lit(o) for o in options])
    return F.get(array, (draw(seed, *keys) % len(options)).cast("int"))


def weighted(options: dict[str, float], seed: str, *keys: Column) -> Column:
    """One of a fixed list of options with the given shares, by one draw against running totals."""

    def chosen(u: Column) -> Column:
        out, total, names = F, 0.0, list(options)
        for name in names[:-1]:
            total += options[name]
            out = out.when(u < F.lit(round(total, 9)), F.lit(name))
        return F.lit(names[-1]) if out is F else out.otherwise(F.lit(names[-1]))

    return let(unit(seed, *keys), chosen)
