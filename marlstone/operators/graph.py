"""Dependency graphs: aggregated edges, degrees, neighbourhoods, closures, change impact.

Edges are (src, dst, relation); entities (id, file, ...). Closures are loops over joins with a bound depth; each
level is one join of a frontier with the edges, written to the shared folder, so that no level is worked out twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.impact import RELATION_ORDER as RELATION_ORDER
from marlstone.operators.impact import Adjacency, affected, members
from marlstone.operators.impact import level_of as impact_level
from marlstone.operators.stored import settle

__all__ = ["RELATION_ORDER", "impact_level"]


def file_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, relation, n) between files; edges within a file are left out."""
    ends = entities.select("id", "file")
    found = edges.join(ends.toDF("src", "source"), "src").join(ends.toDF("dst", "target"), "dst")
    return found.filter("source <> target").groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("file"), "n").unionAll(edges.select("target", "n"))
    return ends.groupBy("file").agg(F.sum("n").alias("degree"))


def most_connected(edges: DataFrame, k: int) -> DataFrame:
    return weighted_degree(edges).orderBy(F.desc("degree"), "file").limit(k)


def file_graph(edges: DataFrame, entities: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (file, degree) and edges of the best connected files."""
    found = file_edges(edges, entities)
    nodes = most_connected(found, most)
    names = nodes.select("file")
    kept = found.join(names, found["source"] == names["file"], "left_semi").join(names, found["target"] == names["file"], "left_semi")
    return nodes, kept


def entity_degree(edges: DataFrame) -> DataFrame:
    """In and out edges of each entity; an edge to itself counts twice."""
    return edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def best_target(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, level): nodes within depth undirected steps of seeds, at their first level."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = settle(both, "steps")
    seen = seeds.select("id").distinct().withColumn("level", F.lit(0))
    frontier = seen.select("id")
    for level in range(1, depth + 1):
        new = both.join(frontier, both["src"] == frontier["id"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = settle(new, "level")
        seen = seen.unionByName(new.withColumn("level", F.lit(level)))
        frontier = new
    return seen


def focus_graph(edges: DataFrame, seeds: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, level, degree) by (level, -degree, id) up to ``most``, and the edges among them."""
    near = neighbourhood(edges, seeds, max(1, min(3, depth))).join(entity_degree(edges), "id", "left").fillna(0, ["degree"])
    nodes = near.orderBy("level", F.desc("degree"), "id").limit(most)
    ids = nodes.select("id")
    kept = edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")
    return nodes, kept


class UnknownFocus(Exception):
    """No entity has this id."""


def focus_view(adjacency: Adjacency, entities: DataFrame, contains: DataFrame, focus: object, depth: int, most: int) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes (id, level, degree), edges (src, dst, relation) and counts of what lies around an entity of entities (id) and its members.

    Levels go along calls, inherits and imports in either direction, depth of them (1 to 3), but none after there are more than 3 * most nodes. Of the
    nodes, most are kept by (level, -degree, id); edges are those among them, with contains (parent, child) as another relation. counts: what was
    found, what is shown, and whether that is less.
    """
    target = entities.filter(F.col("id") == F.lit(focus)).select(F.col("id").alias("target"))
    if target.isEmpty():
        raise UnknownFocus(focus)
    seen = settle(members(contains, target).join(entities.select("id"), "id", "left_semi").select("id", F.lit(0).alias("level")), "focus")
    frontier, n = seen.select("id"), seen.count()
    into, out = (x.filter(F.col("relation").isin(RELATION_ORDER)) for x in (adjacency.into, adjacency.out))
    for level in range(1, max(1, min(3, depth)) + 1):
        near = out.join(frontier, out["src"] == frontier["id"]).select(F.col("dst").alias("id")).union(into.join(frontier, into["dst"] == frontier["id"]).select(F.col("src").alias("id")))
        new = settle(near.distinct().join(seen, "id", "left_anti"), "level")
        seen = seen.unionByName(new.withColumn("level", F.lit(level)))
        frontier, n = new, n + new.count()
        if n > 3 * most:
            break
    ends = [x.join(seen.select("id"), x[end] == seen["id"], "left_semi").select(F.col(end).alias("id")) for x, end in ((into, "dst"), (out, "src"))]
    degree = ends[0].unionAll(ends[1]).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = settle(seen.join(degree, "id", "left").fillna(0, ["degree"]).orderBy("level", F.desc("degree"), "id").limit(most), "nodes")
    all_ = out.select("src", "dst", "relation").unionByName(contains.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit("contains").alias("relation")))
    ids = nodes.select("id")
    edges = all_.join(ids, all_["src"] == ids["id"], "left_semi").join(ids, all_["dst"] == ids["id"], "left_semi").distinct()
    shown = min(n, most)
    return nodes, edges, {"total": n, "shown": shown, "truncated": shown < n}


def descendants(tree: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, level): what roots contain, themselves at level 0; depth bounds the nesting."""
    found = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"))
    frontier = found
    for level in range(1, depth + 1):
        frontier = tree.join(frontier, tree["parent"] == frontier["id"]).select("root", F.col("child").alias("id"), F.lit(level).alias("level"))
        frontier = settle(frontier, "level")
        found = found.unionByName(frontier)
    return found


def has_ancestor(tree: DataFrame, wanted: Column, depth: int) -> DataFrame:
    """(child, inside): whether one of the things around child fulfils ``wanted`` (over column ``parent``)."""
    up = tree.select("child", F.col("parent").alias("at"), F.when(wanted, 1).otherwise(0).alias("hit"))
    links = tree.select(F.col("child").alias("at"), "parent", F.when(wanted, 1).otherwise(0).alias("more"))
    for _ in range(depth - 1):
        up = up.join(links, "at", "left").select("child", F.col("parent").alias("at"), F.greatest("hit", F.coalesce("more", F.lit(0))).alias("hit"))
    return up.select("child", (F.col("hit") == 1).alias("inside"))


def impact(into: DataFrame, entities: DataFrame, targets: DataFrame, depth: int, most: int) -> DataFrame:
    """What depends on targets (id), all taken as one: id, depth, via, through of affected(), at most ``most``, without members of theirs."""
    seeds = targets.select(F.lit(0).alias("target"), "id", F.col("id").alias("rank"))
    return affected(into, entities, seeds, depth, most).filter(F.col("nth") <= most).select("id", "depth", "via", "through")


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The most imported: in and out counts over imports."""
    imports = edges.filter("relation = 'imports'")
    into = imports.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("imported_by"))
    out = imports.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("imports"))
    return into.join(out, "id", "left").fillna(0, ["imports"]).orderBy(F.desc("imported_by"), "id").limit(k)


def package_rollup(entities: DataFrame, k: int) -> DataFrame:
    return (
        entities.groupBy("package")
        .agg(F.countDistinct("file").alias("n_files"), F.count_if(F.col("type") == "class").alias("n_classes"), F.count_if(F.col("type").isin("function", "method")).alias("n_functions"))
        .orderBy(F.desc("n_files"), "package")
        .limit(k)
    )


def key_concepts(edges: DataFrame, entities: DataFrame, classes: int, functions: int) -> DataFrame:
    """The classes and the functions that most calls and inherits lead to."""
    degree = edges.filter(F.col("relation").isin("calls", "inherits")).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    found = entities.join(degree, "id", "left").fillna(0, ["degree"])
    top = lambda kind, k, least: found.filter((F.col("type") == kind) & (F.col("degree") >= least)).orderBy(F.desc("degree"), "id").limit(k)
    return top("class", classes, 0).unionByName(top("function", functions, 1)).select("id", "type", "degree")


def dependents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")
