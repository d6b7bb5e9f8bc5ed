"""Names to entities: imports to files, calls and base classes to definitions, as prioritised joins.

A name is tried on self, on its own file, on imported symbols, on imported modules (the longest prefix), and on
wildcard imports if exactly one of them has it. The first way that applies decides, even if it finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.operators.graph import first_of


def module_map(files: DataFrame) -> DataFrame:
    """(module, module_file): a .py shadows a .pyi of the same module."""
    named = files.filter(F.col("path").rlike(r"\.pyi?$")).select(paths.module_of(F.col("path")).alias("module"), F.col("path").alias("module_file")).filter("module is not null")
    return first_of(named, ["module"], F.col("module_file").endswith(".pyi"), F.col("module_file"))


def absolute(imports: DataFrame) -> DataFrame:
    """imports with the absolute module in ``base``; null where a relative import climbs above the root."""
    folder = F.filter(F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1), lambda x: x != "")
    kept = F.size(folder) - (F.col("level") - 1)
    up = F.array_join(F.slice(folder, 1, F.greatest(kept, F.lit(0))), ".")
    joined = F.when(up == "", F.coalesce("module", F.lit(""))).otherwise(F.concat_ws(".", up, "module"))
    return imports.withColumn("base", F.when(F.col("level") == 0, F.col("module")).when(kept >= 0, joined))


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(source, target, line): the base module, then each name as a module in it; the first statement counts."""
    names = F.transform("names", lambda n: F.when(F.col("base") == "", n["name"]).otherwise(F.concat_ws(".", "base", n["name"])))
    wanted = absolute(imports).select("file", "ord", "line", F.posexplode(F.concat(F.array("base"), names)).alias("nth", "module"))
    hit = wanted.join(modules, "module").filter("file <> module_file")
    first = hit.groupBy("file", "module_file").agg(F.min(F.struct("ord", "nth", "line")).alias("x"))
    return first.select(F.col("file").alias("source"), F.col("module_file").alias("target"), F.col("x.line").alias("line"))


def _bindings(imports: DataFrame) -> DataFrame:
    """(file, local, base, symbol): what each local name stands for; the last binding counts."""
    known = absolute(imports).filter("base is not null")
    plain = known.filter("size(names) = 0").select("file", F.coalesce("alias", "module").alias("local"), "base", F.lit(None).cast("string").alias("symbol"), "ord", F.lit(0).alias("nth"))
    named = known.select("file", "base", "ord", F.posexplode("names").alias("nth", "n")).filter("n.name <> '*'")
    named = named.select("file", F.coalesce("n.alias", "n.name").alias("local"), "base", F.col("n.name").alias("symbol"), "ord", "nth")
    return first_of(plain.unionByName(named), ["file", "local"], F.desc("ord"), F.desc("nth")).drop("ord", "nth")


def resolved(uses: DataFrame, imports: DataFrame, modules: DataFrame, entities: DataFrame) -> DataFrame:
    """uses (use_id, file, name, enclosing) with the target entity's id, or null."""
    ids = entities.select(F.col("id").alias("known"))
    bound = _bindings(imports)
    parts = F.split("name", r"\.")
    base = uses.withColumn("head", parts[0]).withColumn("n", F.size(parts))

    def exists(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(ids, F.col(column) == F.col("known"), "left").withColumn(name, F.col("known")).drop("known")

    own = base.withColumn("try_self", F.when((F.col("head") == "self") & (F.col("n") == 2) & F.col("enclosing").isNotNull(), F.concat_ws(".", "enclosing", parts[1])))
    own = exists(own, "try_self", "self_id").withColumn("try_local", F.concat_ws("::", "file", "name"))
    own = exists(own, "try_local", "local_id")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.col("n") - 1, F.lit(0))), ".")
    symbols = bound.filter("symbol is not null").withColumnRenamed("local", "head")
    sym = own.join(symbols, ["file", "head"], "left").withColumn("rest", rest)
    sym = sym.join(modules.select(F.col("module").alias("base"), F.col("module_file").alias("base_file")), "base", "left")
    sym = sym.withColumn("sub", F.concat_ws(".", "base", "symbol")).join(modules.select(F.col("module").alias("sub"), F.col("module_file").alias("sub_file")), "sub", "left")
    sym = sym.withColumn("try_symbol", F.when(F.col("base_file").isNotNull(), F.concat_ws("::", "base_file", F.concat_ws(".", "symbol", F.nullif("rest", F.lit(""))))))
    sym = sym.withColumn("try_sub", F.when(F.col("sub_file").isNotNull() & (F.col("rest") != ""), F.concat_ws("::", "sub_file", "rest")))
    sym = exists(exists(sym, "try_symbol", "symbol_id"), "try_sub", "sub_id")

    prefixes = base.filter("n > 1").select("use_id", "file", "name", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), ".").alias("local"), F.array_join(F.slice(parts, k + 1, F.col("n")), ".").alias("rest")))).alias("p")).select("use_id", "file", "p.*")
    mods = prefixes.join(bound.filter("symbol is null"), ["file", "local"]).join(modules.withColumnRenamed("module", "base"), "base", "left")
    mods = first_of(mods, ["use_id"], F.desc("k")).select("use_id", F.lit(True).alias("by_module"), F.concat_ws("::", "module_file", "rest").alias("try_module"), "module_file")
    mods = exists(mods.withColumn("try_module", F.when(F.col("module_file").isNotNull(), F.col("try_module"))), "try_module", "module_id").select("use_id", "by_module", "module_id")

    stars = absolute(imports).filter(F.exists("names", lambda n: n["name"] == "*")).join(modules.withColumnRenamed("module", "base"), "base").select("file", "module_file")
    wild = exists(base.select("use_id", "file", "name").join(stars, "file").withColumn("try", F.concat_ws("::", "module_file", "name")), "try", "hit").filter("hit is not null")
    wild = wild.groupBy("use_id").agg(F.count(F.lit(1)).alias("hits"), F.min("hit").alias("wild_id")).filter("hits = 1").select("use_id", "wild_id")

    all_ = sym.join(mods, "use_id", "left").join(wild, "use_id", "left")
    target = (
        F.when(F.col("head") == "self", F.col("self_id"))
        .when(F.col("local_id").isNotNull(), F.col("local_id"))
        .when(F.col("symbol").isNotNull(), F.coalesce("symbol_id", "sub_id"))
        .when(F.col("by_module"), F.col("module_id"))
        .otherwise(F.col("wild_id"))
    )
    return all_.select("use_id", "file", "name", target.alias("target"))


def call_edges(calls: DataFrame, imports: DataFrame, modules: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, line): distinct by caller and target, with the first line; recursion stays."""
    parent = F.regexp_replace("caller", r"\.[^.]+$", "")
    classes = entities.filter("type = 'class'").select(F.col("id").alias("enclosing"))
    uses = calls.withColumn("up", parent).join(classes, F.col("up") == F.col("enclosing"), "left")
    uses = uses.withColumn("use_id", F.concat_ws("#", "file", "ord")).withColumn("name", F.col("callee"))
    found = resolved(uses.select("use_id", "file", "name", "enclosing"), imports, modules, entities).filter("target is not null")
    kept = uses.select("use_id", "caller", "ord", "line").join(found, "use_id").join(entities.filter("type <> 'file'").select(F.col("id").alias("target")), "target", "left_semi")
    return kept.groupBy(F.col("caller").alias("source"), "target").agg(F.min(F.struct("ord", "line")).alias("x")).select("source", "target", F.col("x.line").alias("line"))


def inherit_edges(entities: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(source, target): class to base class, generics stripped, not to itself."""
    bases = entities.filter("type = 'class'").select("file", F.col("id").alias("source"), F.posexplode("bases").alias("nth", "base_text"))
    uses = bases.withColumn("name", F.trim(F.split("base_text", r"\[")[0])).withColumn("use_id", F.concat_ws("#", "source", "nth"))
    uses = uses.filter(F.col("name").rlike(r"^[A-Za-z_][\w]*(\.[A-Za-z_]\w*)*$"))
    found = resolved(uses.select("use_id", "file", "name", F.lit(None).cast("string").alias("enclosing")), imports, modules, entities).filter("target is not null")
    classes = entities.filter("type = 'class'").select(F.col("id").alias("target"))
    return uses.select("use_id", "source").join(found, "use_id").join(classes, "target", "left_semi").filter("source <> target").select("source", "target").distinct()
