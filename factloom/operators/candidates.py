"""Candidates: n-ary combinations of a document's mentions.

Every join has ``doc_id`` (and any equality that a throttler implies) as its key, so
that no plan ever holds a product across documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class CandidateSpec:
    """A relation: its name, one mention table an argument, and what may be combined.

    ``throttler`` gets the argument structs and gives a boolean column. ``equal``
    names fields that all arguments share (such as ``sent_pos``): they become keys of
    the join. ``self_relations``, ``nested_relations`` and ``symmetric_relations``
    bear on binary relations only.

    Arguments are spans (with char_start and char_end) or other contexts, such as cells and figures (with
    context_type and position). Mentions of different kinds are never the same, nor inside one another; with
    ``legacy_mixed_nesting`` they count as nested, so that a binary relation over two kinds is empty
    unless ``nested_relations`` is on.
    """

    name: str
    arguments: list[DataFrame]
    throttler: Callable[..., Column] | None = None
    equal: tuple[str, ...] = ()
    self_relations: bool = False
    nested_relations: bool = False
    symmetric_relations: bool = True
    nullables: tuple[bool, ...] = ()
    legacy_mixed_nesting: bool = False


#: What tells a mention of a kind from others of its document.
SPAN, CONTEXT = ("sent_pos", "char_start", "char_end"), ("context_type", "position")


def key_fields(columns: list[str]) -> tuple[str, ...]:
    """The fields that identify a mention, by what columns it has."""
    for fields in (SPAN, CONTEXT):
        if set(fields) <= set(columns):
            return fields
    raise ValueError("a mention has sent_pos, char_start and char_end, or context_type and position")


def index_mentions(mentions: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """Adds mention_idx, a mention's place in its document's list: spans by sentence and order of generation, contexts by position."""
    if order is None:
        order = ("sent_pos", "ord") if "ord" in mentions.columns else key_fields(mentions.columns)
    return mentions.withColumn("mention_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def index_each(mentions: DataFrame, n: int) -> list[DataFrame]:
    """The mention tables of the ``n`` matchers of ``matchers.ngrams_each``, each with its mention_idx.

    They are told apart behind the exchange that numbers them, by a condition on a number that all of them have. So the exchange, and the
    pass over the texts before it, is the same for all of them, and Spark runs it once, however often they are joined.
    """
    order = Window.partitionBy("doc_id").orderBy("sent_pos", "ord")
    out = []
    for k in range(n):
        mine = F.col("which").bitwiseAND(F.lit(1 << k)) != 0
        place = F.count(F.when(mine, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
        numbered = mentions.withColumns({"mention_idx": place.cast("int"), "_number": F.row_number().over(order)})
        out.append(numbered.where(mine & (F.col("_number") > 0)).drop("which", "_number"))
    return out


def _same(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    return F.struct(*(a[f] for f in fields)).eqNullSafe(F.struct(*(b[f] for f in fields)))


def _within(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    if fields == CONTEXT:
        return _same(a, b, fields)
    return (a["sent_pos"] == b["sent_pos"]) & (a["char_start"] >= b["char_start"]) & (a["char_end"] <= b["char_end"])


def extract(spec: CandidateSpec) -> DataFrame:
    """Columns doc_id and a0, a1, ... (structs of the mentions' columns; null for a nullable argument left out).

    The combination with a missing argument is made for every document that has one
    of the other arguments, whether or not there is a full one.
    """
    n = len(spec.arguments)
    nullables = tuple(spec.nullables) + (False,) * (n - len(spec.nullables))
    sides = []
    for i, (mentions, nullable) in enumerate(zip(spec.arguments, nullables)):
        keys = () if nullable else spec.equal
        side = mentions.select(F.col("doc_id"), *(F.col(k).alias(f"_{k}{i}") for k in keys), F.struct(*[c for c in mentions.columns if c != "doc_id"]).alias(f"a{i}"))
        sides.append((side, keys))
    out, first_keys = sides[0]
    if nullables[0]:
        documents = None
        for other in spec.arguments:
            d = other.select("doc_id").distinct()
            documents = d if documents is None else documents.union(d)
        out = out.unionByName(documents.distinct().withColumn("a0", F.lit(None).cast(out.schema["a0"].dataType)))
    for i, (side, keys) in enumerate(sides[1:], 1):
        side = side.withColumnRenamed("doc_id", f"_doc{i}")
        on = F.col("doc_id") == F.col(f"_doc{i}")
        for k in keys:
            if k in first_keys:
                on = on & (F.col(f"_{k}0") == F.col(f"_{k}{i}"))
        if nullables[i]:  # a mention without a document belongs to none; what there is goes on twice, to be joined and to be left alone, so that it isn't made twice
            out = out.where("doc_id is not null").withColumn(f"_with{i}", F.explode(F.array(F.lit(False), F.lit(True))))
            out = out.join(side.withColumn(f"_is{i}", F.lit(True)), on & (F.col(f"_with{i}") == F.col(f"_is{i}")), "left").where(f"not _with{i} or _is{i} is not null")
        else:
            out = out.join(side, on)
    args = [F.col(f"a{i}") for i in range(n)]
    if n == 2:
        a, b = args
        kinds = [key_fields(x.columns) for x in spec.arguments]
        both = a.isNotNull() & b.isNotNull()
        alike = kinds[0] == kinds[1]
        same = _same(a, b, kinds[0]) if alike else F.lit(False)
        # contexts of two types are of two kinds; whatever is the same is inside itself as well
        mixed = ~F.coalesce(a["context_type"] == b["context_type"], F.lit(False)) if alike and kinds[0] == CONTEXT else F.lit(not alike)
        nested = (_within(a, b, kinds[0]) | _within(b, a, kinds[0])) if alike else F.lit(False)
        if not spec.self_relations:
            out = out.where(~((a.isNull() & b.isNull()) | (both & same)))
        if not spec.nested_relations:
            out = out.where(~F.coalesce(both & (nested | (mixed if spec.legacy_mixed_nesting else F.lit(False))), F.lit(False)))
        if not spec.symmetric_relations:
            out = out.where(F.coalesce(a["mention_idx"] <= b["mention_idx"], F.lit(True)))
    if spec.throttler is not None:
        out = out.where(F.coalesce(spec.throttler(*args), F.lit(False)))
    return out.select("doc_id", *(f"a{i}" for i in range(n)))


def mention_id(doc: Column, a: Column, fields: tuple[str, ...] = SPAN) -> Column:
    """A key of a mention that doesn't depend on the run: null-safe, so that a missing argument has one too."""
    return F.when(a.isNull(), F.lit("-")).otherwise(F.concat_ws(":", doc.cast("string"), *(a[f].cast("string") for f in fields)))


def _ids(candidates: DataFrame, n: int) -> list[Column]:
    return [mention_id(F.col("doc_id"), F.col(f"a{i}"), key_fields(candidates.schema[f"a{i}"].dataType.names)) for i in range(n)]


def with_ids(candidates: DataFrame, name: str, n: int) -> DataFrame:
    """Adds candidate_id, a hash of the relation and its arguments' keys."""
    return candidates.withColumn("candidate_id", F.sha2(F.concat_ws("|", F.lit(name), *_ids(candidates, n)), 256))


def new_only(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates that the store doesn't have yet."""
    return candidates.join(stored.select("candidate_id").distinct(), "candidate_id", "left_anti").dropDuplicates(["candidate_id"])


def with_split(candidates: DataFrame, split: Column) -> DataFrame:
    return candidates.withColumn("split", split)


def docs_from_split(candidates: DataFrame, documents: DataFrame, split: int) -> DataFrame:
    """Documents that hold a candidate of the split."""
    return documents.join(candidates.where(F.col("split") == split).select("doc_id").distinct(), "doc_id", "left_semi")


def get_candidates(candidates: DataFrame, docs: DataFrame | None = None, split: int = 0, n: int = 2, sort: bool = False) -> DataFrame:
    """Candidates of some documents (of all splits), or of a split; sorted by their arguments' keys if asked."""
    out = candidates.join(docs.select("doc_id").distinct(), "doc_id", "left_semi") if docs is not None else candidates.where(F.col("split") == split)
    return out.orderBy(F.concat_ws("_", *_ids(out, n))) if sort else out


def get_mentions(classes: list[DataFrame], docs: DataFrame | None = None, sort: bool = False) -> list[DataFrame]:
    """The mentions of each class, of some documents or of all; sorted by their keys if asked."""
    out = []
    for mentions in classes:
        if docs is not None:
            mentions = mentions.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        key = F.concat_ws(":", F.col("doc_id").cast("string"), *(F.col(f).cast("string") for f in key_fields(mentions.columns)))
        out.append(mentions.orderBy(key) if sort else mentions)
    return out
