"""Alignment of two arrays as one expression: the rows of the table are folded, a band of it at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import let

#: Cost of what is not reached.
FAR = 1 << 29


def alignment_cost(a: Column, b: Column, band: int, gap: int = 1, mismatch: int = 1) -> Column:
    """Least cost of turning ``a`` into ``b`` by gaps and mismatches of items; null if that takes more than ``band`` gaps off the diagonal, or an array is null.

    A row of the table is an array of the ``2 * band + 1`` cells around the diagonal,
    made from the row above in a few passes: first steps from above, then steps
    along the row, which are doubled until they span the band. Work is in proportion to
    the length of ``a`` times the band. A cost of up to ``gap * band`` is that of the
    full table; a larger one is the least within the band and may be too high.
    """
    wide = 2 * band + 1
    reach = [1 << i for i in range(wide.bit_length()) if 1 << i < wide]

    def along(row: Column) -> Column:
        """Each cell may be reached from any to its left, at a gap a step."""
        for step in reach:
            row = _stepped(row, step, gap)
        return row

    def table(b: Column) -> Column:
        cells = F.sequence(F.lit(0), F.lit(wide - 1))
        top = F.transform(cells, lambda d: F.when((d >= band) & (d - band <= F.size(b)), (d - band) * gap).otherwise(FAR))

        def below(acc: Column, x: Column) -> Column:
            """Row ``i`` from the row above; its cell ``d`` stands at ``j = i + d - band``."""
            i = acc["i"] + 1

            def cell(up: Column, d: Column) -> Column:
                j = i + d - band
                same = F.get(b, j - 1).eqNullSafe(x)
                diagonal = F.when(j >= 1, F.get(acc["row"], d) + F.when(same, 0).otherwise(mismatch)).otherwise(FAR)
                return F.when((j < 0) | (j > F.size(b)), FAR).otherwise(F.least(diagonal, up + gap, F.lit(FAR)))

            shifted = F.concat(F.slice(acc["row"], 2, wide - 1), F.array(F.lit(FAR)))
            return F.struct(i.alias("i"), along(F.transform(shifted, cell)).alias("row"))

        folded = F.aggregate(a, F.struct(F.lit(0).alias("i"), top.alias("row")), below, lambda acc: acc["row"])
        found = F.get(folded, F.size(b) - F.size(a) + band)
        return F.when((F.abs(F.size(a) - F.size(b)) <= band) & (found < FAR), found)

    return F.when(a.isNotNull() & b.isNotNull(), let(b, table))


def _stepped(row: Column, step: int, gap: int) -> Column:
    """The least of each cell and that ``step`` to its left with its gaps."""

    def both(r: Column) -> Column:
        left = F.concat(F.array_repeat(F.lit(FAR), step), F.slice(r, F.lit(1), F.size(r) - step))
        return F.zip_with(r, left, lambda x, y: F.least(x, y + step * gap, F.lit(FAR)))

    return let(row, both)


def sequence_similarity(a: Column, b: Column, band: int) -> Column:
    """1 less edits over the longer length, 1 if both are empty; null beyond the band."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 1.0).otherwise(1 - alignment_cost(a, b, band) / longest)
