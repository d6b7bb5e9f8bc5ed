"""A session's entities and edges as an index that is kept while its tables don't change, and that is checked when it is loaded."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import vectors as vec
from marlstone.operators.impact import Adjacency
from marlstone.operators.session import Session

#: Indexes that are kept.
MOST_KEPT = 4


class IndexProblem(Exception):
    """Vectors that are missing or don't fit their chunks or model."""


@dataclass
class Knowledge:
    """entities, and edges (src, dst, relation) by either end."""

    entities: DataFrame
    adjacency: Adjacency

    def found(self, id_or_name: str) -> DataFrame:
        return self.entities.filter((F.col("id") == id_or_name) | (F.col("name") == id_or_name))


_KEPT: OrderedDict[tuple, Knowledge] = OrderedDict()


def load(session: Session) -> Knowledge:
    """The index of the session's tables as they are now; written anew only where they have changed since, of the last MOST_KEPT sessions."""
    key = (session.path("entities"), session.version("entities"), session.version("relationships"))
    if key[1] is None:
        raise FileNotFoundError(key[0])
    if key in _KEPT:
        _KEPT.move_to_end(key)
        return _KEPT[key]
    for old in [k for k in _KEPT if k[0] == key[0]]:
        _KEPT.pop(old)
    edges = session.read("relationships").select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation")
    _KEPT[key] = Knowledge(session.read("entities"), Adjacency(edges))
    while len(_KEPT) > MOST_KEPT:
        _KEPT.popitem(last=False)
    return _KEPT[key]


def checked_vectors(chunks: DataFrame, vectors: DataFrame, meta: DataFrame, model: str) -> DataFrame:
    """vectors (chunk_id, embedding) if meta's one row (model, dimension, n) is of this model, there are n of them, all of that dimension and of unit
    length, and each names a chunk; else an error that says what is wrong."""
    row = meta.first()
    if row is None:
        raise IndexProblem("no metadata of the index")
    if row["model"] != model:
        raise IndexProblem(f"the index was made with {row['model']}, not {model}")
    state = vec.check_index(vectors, row["dimension"]).first()
    lost = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()
    wrong = [f"{state['n']} vectors, {row['n']} expected"] * (state["n"] != row["n"]) + [f"{state['n_other_dimension']} of another dimension"] * (state["n_other_dimension"] > 0)
    wrong += [f"{state['n_not_unit']} not of unit length"] * (state["n_not_unit"] > 0) + [f"{lost} without a chunk"] * (lost > 0)
    if wrong:
        raise IndexProblem("; ".join(wrong))
    return vectors


def index_meta(vectors: DataFrame, model: str) -> DataFrame:
    """The one row that checked_vectors() holds vectors (embedding) against: model, dimension, n."""
    return vectors.agg(F.lit(model).alias("model"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"), F.count(F.lit(1)).alias("n"))


#: What is put before a question for models that were trained so. Fixed value.
QUESTION_PREFIX = "Represent this sentence for searching relevant passages: "


def question_text(question: Column, model: str) -> Column:
    return F.concat(F.lit(QUESTION_PREFIX), question) if "bge" in model.lower() else question


def finding_by(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each of wanted (wanted) the finding whose id or fingerprint it is: its columns, null where there is none."""
    either = findings.select(F.explode(F.array_distinct(F.array("id", "fingerprint"))).alias("wanted"), F.struct(*findings.columns).alias("f"))
    first = either.groupBy("wanted").agg(F.min_by("f", "f.id").alias("f"))
    return wanted.join(first, "wanted", "left").select("wanted", "f.*")


def recent(opened: DataFrame, most: int = 8) -> DataFrame:
    """(user, id, position): the last sessions of each user, each once, the last opened first, of opened (user, id, at)."""
    last = opened.groupBy("user", "id").agg(F.max("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("at"), "id"))
    return last.withColumn("position", place).filter(F.col("position") <= most).select("user", "id", "position")


def by_depth(reported: DataFrame) -> DataFrame:
    """(target, depth, n, ids) of a report of impact, in its order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"])
    return reported.groupBy("target", "depth").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
