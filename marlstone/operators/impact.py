"""What a change may affect: the members of a target, what depends on them, level by level, and how serious that is.

Many targets are analysed at once. Edges are looked up by the end that is depended on: in an Adjacency they are written bucketed by it, so that
no level moves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.stored import bucketed, settle

# In what order the relations of a thing are followed.
RELATION_ORDER = ["calls", "inherits", "imports"]
#: Nesting that is followed at most.
MOST_NESTED = 64


class Adjacency:
    """Edges (src, dst, relation, ...) by either end, written once: into by what is depended on, out by what depends."""

    def __init__(self, edges: DataFrame) -> None:
        self.into, self.out = bucketed(edges, "dst", "edges-into"), bucketed(edges, "src", "edges-out")


def members(contains: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, rank) of targets (target): each itself, and what contains (parent, child, ord) says it holds, at any depth.

    rank is the order of a walk that lists a thing's children and goes on with the last of them first. Each level is one join of what is new
    with contains; a child that is reached twice counts where the walk meets it first.
    """
    nth = contains.select("parent", "child", F.row_number().over(Window.partitionBy("parent").orderBy("ord", "child")).alias("nth"))
    start = targets.select("target", F.col("target").alias("id"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("nth"), F.array().cast("array<int>").alias("key")).distinct()
    found, frontier = start, start
    for _ in range(MOST_NESTED):
        below = nth.withColumnRenamed("nth", "n").join(frontier.select("target", "id", F.col("key").alias("up")), F.col("parent") == F.col("id"))
        below = below.select("target", F.col("child").alias("id"), F.col("up").alias("at"), F.col("n").alias("nth"), F.concat("up", F.array(-F.col("n"))).alias("key"))
        first = below.groupBy("target", "id").agg(F.min(F.struct("at", "nth", "key")).alias("x")).select("target", "id", "x.*")
        frontier = settle(first.join(found.select("target", "id"), ["target", "id"], "left_anti"), "members")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.select("target", "id", F.row_number().over(Window.partitionBy("target").orderBy("at", "nth")).alias("rank"))


def affected(into: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """(target, id, depth, via, through, nth) of what depends on seeds (target, id, rank), as a first-in-first-out walk from them finds it;
    most + 1 of a target at most, so that more than most means that some were left out.

    A node is found through the node before it, by calls, then inherits, then imports (the last only from files), then by its id; the first
    finding counts. Seeds of a target and what isn't among entities (id, type) are never found. The order of the walk is that of an
    array of steps, so that no level is numbered in one place; of a level, no more than most + 1 of a target go on.
    """
    order = F.array_position(F.array(*map(F.lit, RELATION_ORDER)), F.col("relation")).cast("long")
    links = into.select(F.col("dst").alias("at"), F.col("src").alias("id"), "relation", order.alias("via_ord")).filter("via_ord > 0")
    kinds = entities.select("id", (F.col("type") == "file").alias("is_file"))
    frontier = seeds.join(kinds, "id", "left").select("target", F.col("id").alias("at"), F.array(F.col("rank").cast("long")).alias("steps"), F.coalesce("is_file", F.lit(False)).alias("is_file"))
    seen, found = seeds.select("target", "id"), None
    for level in range(1, depth + 1):
        reached = links.join(frontier, "at").filter("relation <> 'imports' or is_file")
        reached = reached.select("target", "id", F.struct(F.concat("steps", F.array("via_ord", F.col("id").cast("long"))).alias("steps"), F.col("relation").alias("via"), F.col("at").alias("through")).alias("how"))
        first = reached.groupBy("target", "id").agg(F.min("how").alias("how")).join(seen, ["target", "id"], "left_anti").join(kinds, "id")
        first = first.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("how.steps"))).filter(F.col("k") <= most + 1)
        new = settle(first.select("target", "id", F.lit(level).alias("depth"), "how.via", "how.through", "how.steps", "is_file"), "level")
        found = new if found is None else found.unionByName(new)
        seen = seen.union(new.select("target", "id"))
        frontier = new.select("target", F.col("id").alias("at"), "steps", "is_file")
    nth = F.row_number().over(Window.partitionBy("target").orderBy("depth", "steps"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= most + 1).select("target", "id", "depth", "via", "through", "nth")


def report(found: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """The first most of affected() with type, name, file, start_line and is_test of entities, and position in the order of a report: nearer ones first,
    tests last among those, then by file and line."""
    cut = found.filter(F.col("nth") <= most).join(entities.select("id", "type", "name", "file", "start_line", "is_test"), "id")
    place = F.row_number().over(Window.partitionBy("target").orderBy("depth", "is_test", "file", "start_line", "nth"))
    return cut.select("target", "id", "depth", "via", "through", "type", "name", "file", "start_line", "is_test", place.alias("position"))


def level_of(direct: Column, files: Column, subclasses: Column, all_: Column) -> Column:
    return F.when((direct >= 4) | (files >= 4) | (subclasses >= 2), "HIGH").when(all_ >= 1, "MEDIUM").otherwise("LOW")


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def assessed(targets: DataFrame, reported: DataFrame, members_: DataFrame, found: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(target, callers, importers, subclasses, transitive, files, tests, level, reasons, truncated) of each of targets (target).

    entities: (id, type, file, is_entry). files counts those affected, without the target's own unless it is affected as a file; what is direct
    and no test counts for the level.
    """
    own = entities.select(F.col("id").alias("target"), F.col("type").alias("kind"), F.col("file").alias("home"), "is_entry")
    one = F.col("depth") == 1
    by = lambda via: F.count_if(one & (F.col("via") == via)).alias(via)
    counted = reported.join(own, "target").groupBy("target").agg(
        by("calls"), by("imports"), by("inherits"), F.count_if(F.col("depth") > 1).alias("transitive"),
        F.count_distinct(F.when((F.col("file") != F.col("home")) | (F.col("type") == "file"), F.col("file"))).alias("files"), F.count_distinct(F.when(F.col("is_test"), F.col("file"))).alias("tests"), F.count_if(one & ~F.col("is_test")).alias("untested"),
    )
    held = members_.groupBy("target").agg((F.count(F.lit(1)) - 1).alias("members"))
    cut = found.groupBy("target").agg((F.max("nth") > most).alias("truncated"))
    row = targets.select("target").distinct().join(own, "target").join(counted, "target", "left").join(held, "target", "left").join(cut, "target", "left")
    row = row.na.fill(0, ["calls", "imports", "inherits", "transitive", "files", "tests", "untested", "members"]).na.fill(False, ["truncated"])
    c = F.col
    direct = c("calls") + c("imports") + c("inherits")
    level = level_of(c("untested"), c("files"), c("inherits"), direct + c("transitive"))
    reasons = F.array_compact(F.array(
        F.when(c("calls") > 0, F.concat(c("calls").cast("string"), _plural(c("calls"), F.lit(" direct caller"), F.lit(" direct callers")))),
        F.when(c("imports") > 0, F.concat(F.lit("imported by "), c("imports").cast("string"), _plural(c("imports"), F.lit(" file"), F.lit(" files")))),
        F.when(c("inherits") > 0, F.concat(c("inherits").cast("string"), _plural(c("inherits"), F.lit(" subclass"), F.lit(" subclasses")), F.lit(" inherit from it"))),
        F.when(c("transitive") > 0, F.concat(c("transitive").cast("string"), _plural(c("transitive"), F.lit(" transitive dependent"), F.lit(" transitive dependents")))),
        F.when(c("tests") > 0, F.concat(F.lit("covered by "), c("tests").cast("string"), _plural(c("tests"), F.lit(" test file"), F.lit(" test files")))).otherwise(F.lit("no test file references it")),
        F.when((c("kind") == "class") & (c("members") > 0), F.concat(F.lit("changing the class touches its "), c("members").cast("string"), _plural(c("members"), F.lit(" member"), F.lit(" members")))),
        F.when(c("is_entry"), F.lit("lives in an entry point")),
        F.when(level == "LOW", F.lit("no static dependents found")),
    ))
    return row.select("target", c("calls").alias("callers"), c("imports").alias("importers"), c("inherits").alias("subclasses"), "transitive", "files", "tests", level.alias("level"), reasons.alias("reasons"), "truncated")


def analysed(adjacency: Adjacency, entities: DataFrame, contains: DataFrame, targets: DataFrame, depth: int = 2, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """report() and assessed() of targets (target) with all their members; depth is 1 to 3. Targets that aren't among entities have no row."""
    known = targets.join(entities.select(F.col("id").alias("target")), "target", "left_semi")
    held = settle(members(contains, known).join(entities.select("id"), "id", "left_semi"), "members")
    found = settle(affected(adjacency.into, entities, held, max(1, min(3, depth)), most), "affected")
    reported = report(found, entities, most)
    return reported, assessed(known, reported, held, found, entities, most)
