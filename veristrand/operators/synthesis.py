"""Coverage orders, hierarchical reduction, and packing of contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GROUP, KIND_PRIORITY, MAX_SELECTED, RELATION_CHARS, REPRESENTATIVES
from ..functions.text import bounded
from ..session import cut_lineage


def coverage_seat(n: Column, pos: Column) -> Column:
    """Where the item at pos of a list of n comes in coverage order, as a struct to order by.

    Coverage order takes the ends of the range and its middle, then those of both inner
    ranges, level by level. The range that names pos is found by halving: its level, its place
    among those of the level, and which of its three it is.
    """
    start = F.struct(F.lit(0).cast("long").alias("low"), (n - 1).cast("long").alias("high"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("path"), F.lit(None).cast("int").alias("which"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2)
        which = F.when(pos == s["low"], 0).when(pos == s["high"], 1).when(pos == mid, 2)
        right = pos > mid
        low, high = F.when(right, mid + 1).otherwise(s["low"] + 1), F.when(right, s["high"] - 1).otherwise(mid - 1)
        inner = F.struct(low.alias("low"), high.alias("high"), (s["level"] + 1).alias("level"), (s["path"] * 2 + right.cast("int")).alias("path"), F.lit(None).cast("int").alias("which"))
        here = F.struct(s["low"].alias("low"), s["high"].alias("high"), s["level"].alias("level"), s["path"].alias("path"), which.alias("which"))
        return F.when(s["which"].isNotNull(), s).when(which.isNotNull(), here).otherwise(inner)

    depth = F.ceil(F.log2(n + 1)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), depth), start, halve, lambda s: F.struct(s["level"].alias("level"), s["path"].alias("path"), s["which"].alias("which")))


def coverage_order(rows: DataFrame, by: list[str], sort: list[str], given: str) -> DataFrame:
    """rows with ``ord`` (from 0): coverage order within groups of by.

    Items are sorted by sort, ties as given; groups of less than three stay as given. The
    permutation depends on a group's size alone.
    """
    group = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(group)
    place = lambda *o: F.row_number().over(group.orderBy(*o)) - 1
    rows = rows.withColumns({"__n": n.cast("int"), "__pos": F.when(n < 3, place(given)).otherwise(place(*sort, given)).cast("int")})
    rows = rows.withColumn("__seat", coverage_seat(F.col("__n"), F.col("__pos")))
    return rows.withColumn("ord", (F.row_number().over(group.orderBy("__seat")) - 1).cast("int")).drop("__n", "__pos", "__seat")


def remainder_order(items: DataFrame, section: str) -> DataFrame:
    """items with ``ord`` (from 1) in their paper: the section's kinds first, then page and id."""
    rank = F.array_position(F.array(*map(F.lit, KIND_PRIORITY[section])), F.col("kind"))
    rank = F.when(rank == 0, len(KIND_PRIORITY[section])).otherwise(rank - 1)
    order = Window.partitionBy("paper").orderBy(rank, "page", "evidence_id")
    return items.withColumn("ord", F.row_number().over(order))


def groups_of(rows: DataFrame, order: str, size: int = GROUP) -> DataFrame:
    """rows with ``grp`` (from 0): consecutive groups of size in each paper."""
    return rows.withColumn("grp", F.floor((F.row_number().over(Window.partitionBy("paper").orderBy(order)) - 1) / size).cast("int"))


def group_level(dossiers: DataFrame, items: DataFrame) -> DataFrame:
    """Consecutive groups of four dossiers: paper, grp, page_start, page_end, reps, available.

    dossiers: paper, idx (from 0), page_start, page_end, ids. items: paper, evidence_id,
    page. reps: two representatives of each child in coverage order; available: all ids of
    the group, each once, in order.
    """
    child = groups_of(dossiers, "idx").select("paper", "grp", "idx", F.posexplode("ids").alias("nth", "evidence_id"))
    known = child.join(items.select("paper", "evidence_id", "page"), ["paper", "evidence_id"])
    spread = coverage_order(known, ["paper", "grp", "idx"], ["page"], "nth")
    first = F.when(F.col("ord") < REPRESENTATIVES, F.struct("idx", "ord", "evidence_id"))
    met = spread.groupBy("paper", "grp").agg(_ids(first).alias("reps"), F.array_distinct(_ids(F.struct("idx", "nth", "evidence_id"))).alias("available"))
    bounds = groups_of(dossiers, "idx").groupBy("paper", "grp").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    none = F.array().cast("array<string>")
    return bounds.join(met, ["paper", "grp"], "left").select("paper", "grp", "page_start", "page_end", F.coalesce("reps", none).alias("reps"), F.coalesce("available", none).alias("available"))


def _ids(c: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(c)), lambda x: x["evidence_id"])


def select_level(groups: DataFrame, items: DataFrame, wanted: Column) -> DataFrame:
    """The dossiers that groups (as ``group_level`` gives them) become: paper, idx, page_start, page_end, ids.

    Representatives come first, then those of wanted that are available; all of it in
    coverage order, sixteen at most.
    """
    named = F.array_distinct(F.concat("reps", F.array_intersect(wanted, F.col("available"))))
    met = groups.select("paper", "grp", F.posexplode(named).alias("nth", "evidence_id")).join(items.select("paper", "evidence_id", "page"), ["paper", "evidence_id"])
    kept = coverage_order(met, ["paper", "grp"], ["page"], "nth").where(F.col("ord") < MAX_SELECTED)
    kept = kept.groupBy("paper", "grp").agg(_ids(F.struct("ord", "evidence_id")).alias("ids"))
    out = groups.select("paper", "grp", "page_start", "page_end").join(kept, ["paper", "grp"], "left")
    return out.select("paper", F.col("grp").alias("idx"), "page_start", "page_end", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def reduce_level(dossiers: DataFrame, items: DataFrame, choose: Column | None = None) -> DataFrame:
    """One level of reduction. choose: picks further ids out of ``available`` (an array column), none by default."""
    return select_level(group_level(dossiers, items), items, F.array().cast("array<string>") if choose is None else choose)


def levels_of(n: Column) -> Column:
    """How often n dossiers are reduced until one is left."""
    steps = F.sequence(F.lit(1), F.lit(40))
    size = F.aggregate(steps, F.struct(n.cast("long").alias("n"), F.lit(0).alias("k")), lambda a, _: F.when(a["n"] > 1, F.struct(F.ceil(a["n"] / GROUP).cast("long").alias("n"), (a["k"] + 1).alias("k"))).otherwise(a), lambda a: a["k"])
    return size


def reduce_all(dossiers: DataFrame, items: DataFrame, choose: Column | None = None) -> DataFrame:
    """Root dossier of each paper: paper, page_start, page_end, ids, levels.

    Levels are planned on the driver from the largest paper's count; a paper with one dossier
    left is carried over. Each level is checkpointed, so a lost executor costs one level.
    """
    dossiers, items = cut_lineage(dossiers), cut_lineage(items)
    count = dossiers.groupBy("paper").count()
    most = count.agg(F.max("count")).first()[0] or 0
    levels = count.select("paper", levels_of(F.col("count")).alias("levels"))
    while most > 1:
        n = F.count(F.lit(1)).over(Window.partitionBy("paper"))
        open_ = dossiers.withColumn("n", n)
        done = open_.where("n = 1").drop("n")
        dossiers = cut_lineage(done.unionByName(reduce_level(open_.where("n > 1").drop("n"), items, choose)))
        most = -(-most // GROUP)
    return dossiers.join(levels, "paper").drop("idx")


def valid_relationships(rows: DataFrame) -> DataFrame:
    """rows (ids, description, selected) that hold: two or more different ids, all selected, and a description."""
    ids = F.array_distinct("ids")
    text = bounded("description", RELATION_CHARS)
    good = (F.size(ids) >= 2) & (F.size(F.array_except(ids, "selected")) == 0) & text.isNotNull()
    return rows.withColumns({"ids": ids, "description": text, "__good": good}).where("__good").drop("__good")


def skip_fit(entries: Column, size, used: Column | int, cap: Column | int) -> Column:
    """Entries in order, each included if it still fits; one that doesn't is skipped."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kept = F.filter(entries, lambda e: F.lit(False))
    start = F.struct(lit(used).cast("long").alias("used"), kept.alias("kept"))
    step = lambda a, e: F.when(a["used"] + size(e) <= lit(cap), F.struct((a["used"] + size(e)).cast("long").alias("used"), F.array_append(a["kept"], e).alias("kept"))).otherwise(a)
    return F.aggregate(entries, start, step, lambda a: a["kept"])


def prefix_fit(rows: DataFrame, by: list[str], order: str, size: Column, cap: Column | int) -> DataFrame:
    """rows up to the first that no longer fits, by a running sum."""
    run = F.sum(size).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", run).where(F.col("__run") <= cap).drop("__run")
