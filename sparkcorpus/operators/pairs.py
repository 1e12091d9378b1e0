"""All pairs of two tables with an equal key, where few keys make very many pairs.

A join by key deals out keys, so that a few large keys keep a few tasks busy, and Spark plans tasks by the bytes that it reads
and not by the pairs that it makes. Here the rows of a key are dealt into parts of about PART on both sides, and a part of the one side
meets a part of the other in a cell, which is dealt by key and both parts. In a cell the right part is one short array, which each left
row expands: Spark holds all that one row expands to. What is shuffled is about a PART-th of what comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.text import fresh

#: Rows of a key that go together, about, and tasks at most: more cells than that share a task.
PART, TASKS = 4096, 20_000


def matched(left: DataFrame, right: DataFrame, key: str, n_right: str | None = None, part: int = PART) -> DataFrame:
    """The inner join by `key`: columns of left and, without the key, of right; as n_right the rows of right with that key.

    Rows with a null key have no pair. Equal rows are rows of their own.
    """
    n, m, x, y, l, r = fresh({*left.columns, *right.columns}, "n", "m", "x", "y", "l", "r")
    of = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    sizes = materialize(of(left, n).join(of(right, m), key))
    parts = lambda c: F.ceil(F.col(c) / part)
    tasks = max(1, min(sizes.agg(F.sum(parts(n) * parts(m))).first()[0] or 0, TASKS))

    def dealt(rows: DataFrame, own: str, at: str, name: str) -> DataFrame:
        """Rows (key, name, n, m, at): each row as a struct, with its part of the key."""
        # by place, as equal rows would all go to one part by hash; kept, as places can change when rows are made again
        placed = rows.select(key, F.struct(*(f"`{c}`" for c in rows.columns if c != key)).alias(name), F.monotonically_increasing_id().alias(at))
        return materialize(placed.join(sizes, key).withColumn(at, F.pmod(at, parts(own))))

    each = lambda other: F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1))
    cell = [key, x, y]
    one = dealt(left, n, x, l).select(key, x, each(m).alias(y), l, m)
    two = dealt(right, m, y, r).groupBy(key, y, n).agg(F.collect_list(r).alias(r)).select(key, each(n).alias(x), y, r)
    # merged, so that it is the left rows that are streamed
    cells = one.repartition(tasks, *cell).hint("merge").join(two.repartition(tasks, *cell), cell).select(key, l, m, F.explode(r).alias(r))
    own = lambda side, rows: [F.col(side)[c].alias(c) for c in rows.columns if c != key]
    return cells.select(key, *own(l, left), *own(r, right), *([] if n_right is None else [F.col(m).alias(n_right)]))
