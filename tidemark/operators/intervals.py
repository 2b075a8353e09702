"""Which intervals hold which instants, for two tables: an equi-join on dyadic ranges of time.

Time is cut into cells of `grain_us`, and 2^k neighbouring cells that begin at a multiple of 2^k make a node of level k. A
half-open interval is the union of at most two nodes a level; an instant lies in one node a level. So an interval and an
instant meet in exactly one node if the interval holds the instant's cell, and only cells an interval begins or ends in need
the exact comparison. The work is the rows that match plus what shares such an edge cell, however many intervals and instants
there are, and open ends are the last cell's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import visible_at

HOUR_US = 3_600_000_000
#: Levels of nodes: 2^22 cells of an hour are 478 years, half of them before 1970. Instants beyond fall into the edge cells.
LEVELS = 22


def _cell(at: Column, grain_us: int) -> Column:
    shifted = F.floor(at / F.lit(grain_us)) + (1 << (LEVELS - 1))
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit((1 << LEVELS) - 1).cast("bigint"), shifted))


def covering_nodes(start: Column, end: Column, grain_us: int = HOUR_US) -> Column:
    """The nodes (level, node) whose union is the cells from the one `start` lies in to the one just before `end`; NULL never ends."""
    low = _cell(start, grain_us)
    high = F.coalesce(_cell(end - 1, grain_us), F.lit((1 << LEVELS) - 1).cast("bigint")) + 1

    def of_level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("bigint")
        lo, hi = F.ceil(low / size), F.floor(high / size)
        node = lambda x, odd: F.when((lo < hi) & (odd % 2 == 1), F.struct(k.cast("int").alias("level"), x.alias("node")))
        return F.array_compact(F.array(node(lo, lo), node(hi - 1, hi)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))


def nodes_of(at: Column, grain_us: int = HOUR_US) -> Column:
    """The node of every level that an instant lies in."""
    cell = _cell(at, grain_us)
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(cell / F.pow(F.lit(2.0), k)).alias("node")))


def as_of_cutoffs(df: DataFrame, cutoffs: DataFrame, name: str = "cutoff", grain_us: int = HOUR_US, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Every row of df at every cutoff that sees it: the as-of predicate for a table of cutoffs of any size.

    df has known_at and superseded_at, cutoffs a bigint column `name` and whatever else is asked of a cutoff. A NULL cutoff
    sees nothing, equal cutoffs are told apart as rows, an inverted or empty interval is never seen. Columns `by`, which both sides have and which
    the result takes from the cutoffs, must agree; NULL agrees with NULL.
    """
    kept = columns or df.columns
    held = df.filter(F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("known_at")))
    agreed = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    held = held.select("*", *agreed, F.explode(covering_nodes(F.col("known_at"), F.col("superseded_at"), grain_us)).alias("_n")).drop(*by)
    asked = cutoffs.filter(F.col(name).isNotNull()).select("*", F.explode(nodes_of(F.col(name), grain_us)).alias("_m"))
    on = (F.col("_n.level") == F.col("_m.level")) & (F.col("_n.node") == F.col("_m.node"))
    for i, c in enumerate(by):
        on = on & F.col(f"_by{i}").eqNullSafe(F.col(c))
    met = held.join(asked, on)
    return met.filter(visible_at("known_at", "superseded_at", F.col(name))).select(*[c for c in kept if c not in by], *cutoffs.columns)
