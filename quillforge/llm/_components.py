"""Connected components of an edge table by large-star and small-star rounds (Kiveris et al. 2014), and the links that groups still lack."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm._common import checkpointed, release
from quillforge.llm._shingles import unpacked


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest member) of all nodes in ``edges`` (a, b); nodes are longs.

    Least neighbours are combined before each shuffle; no group is ever gathered. Every round is
    checkpointed, as plans would grow with the rounds.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 31)), F.lit(0))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = checkpointed(small.distinct())
        release(large)
        release(e)
        e = after


def dealt(group: DataFrame, x: str, most: int) -> DataFrame:
    """Rows for tasks (group, i, j) in which every ``alone`` member of a group meets every member: side a has the alone ones, the other side all.

    ``group`` has ``alone`` (boolean) and the group's counts n, of members, and s, of alone ones. A task has
    some ``most`` members on either side; a group makes n * s / most rows at least, and n where few are alone.
    """
    left, right = F.ceil(F.col("s") / most).cast("int"), F.ceil(F.col("n") / most).cast("int")
    rest = [c for c in group.columns if c not in ("n", "s", "alone")]
    mine = lambda blocks: F.pmod(F.xxhash64(x, F.lit(7)), blocks)
    every = group.select(*rest, F.lit(False).alias("a"), F.explode(F.sequence(F.lit(0), left - 1)).alias("i"), mine(right).alias("j"))
    alone = group.where("alone").select(*rest, F.lit(True).alias("a"), mine(left).alias("i"), F.explode(F.sequence(F.lit(0), right - 1)).alias("j"))
    return every.unionByName(alone)


def across(percent: int):
    """Links (a, b) of similar members, one of each side of a task (x, c, a, set), that unite components c; links inside what is united already are left out."""

    def run(table: pa.Table) -> pa.Table:
        node, side = table.column("x").to_numpy(), table.column("a").to_numpy()
        names, comp = np.unique(table.column("c").to_numpy(), return_inverse=True)
        sets = [unpacked(s) for s in table.column("set").to_pylist()]
        size = np.array([len(s) for s in sets])
        there = np.flatnonzero(~side)
        row = np.repeat(there, size[there])
        flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in there]])
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        united = np.arange(len(names))  # of each component
        a, b = [], []
        for i in np.flatnonzero(side):
            low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            both = np.bincount(np.concatenate([row[:0], *[row[p:q] for p, q in zip(low, high, strict=True) if q > p]]), minlength=len(sets))
            hits = np.flatnonzero((both > 0) & (100 * both >= percent * (size + size[i] - both)))
            for c in np.unique(united[comp[hits]]):
                own = united[comp[i]]
                if c != own:
                    a.append(node[i])
                    b.append(node[hits[united[comp[hits]] == c][0]])
                    united[united == c] = own
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _open(labelled: DataFrame) -> DataFrame:
    """The members (g, x, c, more) of groups in several components, with counts n and s and ``alone`` for those outside the largest one."""
    sizes = labelled.groupBy("g", "c").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("large"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("s")).where("s > 0")
    return checkpointed(labelled.join(sizes, "g").select(*labelled.columns, "n", "s", (F.col("c") != F.col("large")).alias("alone")))


def rest(members: DataFrame, edges: DataFrame, sets, percent: int, most: int, marked: DataFrame | None = None, screen=None) -> DataFrame:
    """Links between members of a group (g, x, and what ``marked`` needs) that ``edges`` leave in different components; ``sets`` gives (x, set) for the members (x) of such groups.

    Of a group's components the largest is compared with the others, and these with each other. ``screen``
    leaves of a task's members, with their sketches of ``marked``, those that may have a link across.
    """
    known = components(edges)
    labelled = checkpointed(members.join(known, F.col("x") == F.col("node"), "left").select(*members.columns, F.coalesce("component", "x").alias("c")))
    group = _open(labelled)
    if screen is not None:
        left = dealt(group, "x", most).join(marked, [c for c in marked.columns if c in group.columns]).groupBy("g", "i", "j").applyInArrow(screen, "g long, x long")
        group = _open(labelled.join(checkpointed(left.distinct()), ["g", "x"]))
    return dealt(group, "x", most).join(sets(group.select("x")), "x").groupBy("g", "i", "j").applyInArrow(across(percent), "a long, b long")
