"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of a budget of words. A source whose
share is above ``max_epochs`` times its size is clamped there, and what it
leaves is shared among the others by weight, until no one is above. That fixed
point has a closed form: in the order of cap / weight, a source is clamped if
its cap is no larger than its share of what the clamped ones before it left.

A source with target t and size s takes floor(t / s) whole repetitions of every
document, and the rest of its target from its documents in a seeded random order:
whole documents, and of the one document at the end a fractional repetition. The
order is never sorted as a whole. A table of ids, sizes and draws is written once;
in it the end of each source is found by sums of 4096 buckets of the draw, then of
4096 buckets inside the one where it lies, and only what is left of that (some
millionth of the source) is ordered. The end is one row a source, which every document is
compared with; texts are joined to nothing else. All sums are combined map-side, so
that one source with a third of all rows is like any other.

The water level is worked out over a row a source, in one task: 60 bytes for each
of the sources, which are the parts of a mix.

Defined results: a null text has size 0; a null source is a source, the last
one. Repeated rows count each; where the end falls among rows equal in id, text and
source, they share what is left evenly, rounded down. A source of size 0 has target
0. A very long document is cut like any other, by words. An empty table gives an
empty table. Null ids are allowed; such rows are ordered by their size's draw, then
by a hash of their text. Extra columns, also such as ``size`` or ``target``, are
carried along by ``mixed_rows``; they may not be called ``_id``, ``_source``,
``_size``, ``_text``, ``_draw`` or ``_row``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelight.llm.columns import WORD, read, word_count
from sidelight.workspace import Workspace

WEIGHTS = (5, 2, 1)
BUDGET = (3, 2)  # words to take, as a fraction of all words
DIGITS = 3  # hex digits of a draw that make a bucket: 4096 of them


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_epochs: int = 2) -> DataFrame:
    """``(_source, _source_size)``, a row per source, to the same with ``_target`` double.

    Integers decide who is clamped; only the quotient at the end is a double.
    """
    num, den = budget
    big = "decimal(38,0)"
    in_order = Window.orderBy(F.col("_source").asc_nulls_last())
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = sizes.withColumn("_rank", F.row_number().over(in_order)).withColumns({
        "_weight": F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"),
        "_cap": F.col("_source_size") * max_epochs,
    })
    # in units of 1 / den words, so that the budget is an integer
    filled = ranked.withColumns({
        "_left": F.sum("_source_size").over(everyone).cast(big) * num - F.coalesce(F.sum("_cap").over(before), F.lit(0)).cast(big) * den,
        "_rest": F.sum("_weight").over(onwards).cast(big),
    }).withColumn("_clamped", F.col("_cap").cast(big) * den * F.col("_rest").cast("decimal(18,0)") <= F.col("_left") * F.col("_weight"))
    free = F.when(~F.col("_clamped"), F.struct(F.col("_left").alias("l"), F.col("_rest").alias("r")))
    first_free = F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.withColumn("_free", first_free).select(
        "_source", "_source_size",
        F.when(F.col("_clamped"), F.col("_cap").cast("double"))
        .otherwise(F.col("_free.l").cast("double") * F.col("_weight").cast("double") / (F.col("_free.r").cast("double") * den)).alias("_target"),
    )


_KEY = ("_draw", "_id", "_text")


def _of_source(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Each row with what ``ends`` (a row a source) says of its source."""
    return rows.join(ends.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")


def _end_among(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Of groups ``by`` of a source's rows, in their order, the one in which the ``_need`` of ``ends`` is met:
    a row a source, with what is needed of it, its words and its rows. No row where nothing is needed."""
    sums = rows.groupBy("_source", *by).agg(F.sum("_size").alias("_in"), F.count("*").alias("_rows"))
    ahead = Window.partitionBy("_source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = _of_source(sums.withColumn("_ahead", F.coalesce(F.sum("_in").over(ahead), F.lit(0))), ends.select("_source", "_need"))
    met = placed.where((F.col("_need") > F.col("_ahead")) & (F.col("_need") <= F.col("_ahead") + F.col("_in")))
    return met.select("_source", *by, (F.col("_need") - F.col("_ahead")).alias("_need"), "_rows")


def _ends(lean: DataFrame, ws: Workspace) -> DataFrame:
    """A row a source: ``_source_size``, ``_target``, ``_whole`` repetitions, and where the further one ends (``_end``, with ``_share`` words there)."""
    first, second = (F.substring("_draw", 1 + k * DIGITS, DIGITS) for k in (0, 1))
    coarse = lean.withColumn("_first", first)
    targets = source_targets(lean.groupBy("_source").agg(F.sum("_size").alias("_source_size")))
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn("_need", F.round("_target").cast("long") - F.col("_whole") * F.col("_source_size"))
    targets = ws.table(targets, "targets")

    def inside(rows, end, by):  # the rows of the group where the end lies
        marks = end.select(F.col("_source").alias("_s"), F.col(by).alias("_b"))
        return rows.join(marks, F.col("_source").eqNullSafe(F.col("_s")) & (F.col(by) == F.col("_b"))).drop("_s", "_b")

    one = ws.table(_end_among(coarse, targets, ["_first"]), "first")
    fine = inside(coarse, one, "_first").withColumn("_second", second)
    two = ws.table(_end_among(fine, one, ["_second"]), "second")
    last = _end_among(inside(fine, two, "_second"), two, list(_KEY))
    ends = last.select(F.col("_source").alias("_s"), F.struct(*_KEY).alias("_end"), F.floor(F.col("_need") / F.col("_rows")).alias("_share"))
    return ws.table(targets.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s", "_need"), "ends")


def _planned(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, whole_rows: bool = False) -> DataFrame:
    """``_id``, ``_size``, ``_source_size``, ``_target``, ``_taken`` for each row, and the row itself as ``_row`` if asked for."""
    text = F.col(text_col)
    carried = [F.struct(*df.columns).alias("_row")] if whole_rows else []
    sized = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text).alias("_size"), F.xxhash64(text).alias("_text"), *carried)
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_size").cast("string")).cast("binary"))
    drawn = sized.withColumn("_draw", draw)
    ws = Workspace(df.sparkSession, "mixing")
    lean = ws.table(drawn.drop("_row"), "drawn")
    placed = _of_source(drawn if whole_rows else lean, _ends(lean, ws))
    key = F.struct(*_KEY)
    extra = F.when(key < F.col("_end"), F.col("_size")).when(key == F.col("_end"), F.col("_share")).otherwise(F.lit(0))
    return placed.withColumn("_taken", (F.col("_whole") * F.col("_size") + F.when(F.col("_end").isNull(), F.lit(0)).otherwise(extra)).cast("long"))


def mix_plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """A row for each row of ``df``: ``id_col``, ``size``, ``source_size``, ``target`` (its source's), ``taken`` (words, repeats counted)."""
    return _planned(df, id_col, source_col, text_col, seed).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for every whole repetition, and for a
    fractional one a row whose text holds its first words. A document without words stays once,
    as it costs nothing.
    """
    plan = _planned(df, id_col, source_col, text_col, seed, whole_rows=True)
    size, taken = F.col("_size"), F.col("_taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(1).cast("int")
    part = F.when(size > 0, taken % size).otherwise(0).cast("int")
    rows = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    text = F.col("_row")[text_col]
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    lead = F.array_join(F.slice(words, F.lit(1), F.col("_words")), "")
    out = plan.select("_row", F.explode(rows).alias("_words"))
    return out.select(*(F.when(F.col("_words") < 0, text).otherwise(lead).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns))


def op5_mixing(spark, sf_dir):
    return mix_plan(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), per as (
  select source, sum(size)::hugeint as source_size, 2 * sum(size)::hugeint as cap,
         row_number() over (order by source nulls last) as rnk
  from sized group by source
), weighed as (
  select *, case (rnk - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, sum(source_size) over () as total from per
), filled as (
  select *,
    3 * total - 2 * coalesce(sum(cap) over (order by cap::double / weight, rnk rows between unbounded preceding and 1 preceding), 0) as left_over,
    sum(weight) over (order by cap::double / weight, rnk rows between current row and unbounded following) as rest
  from weighed
), clamped as (
  select *, 2 * cap * rest <= left_over * weight as is_clamped from filled
), free as (
  select left_over as fl, rest as fr from clamped where not is_clamped order by cap::double / weight, rnk limit 1
), targets as (
  select source, source_size, case when is_clamped then cap::double else (select fl from free)::double * weight / ((select fr from free)::double * 2) end as target
  from clamped
), drawn as (
  select s.*, t.source_size, t.target, md5('17:' || coalesce(doc_id::varchar, '') || ':' || size::varchar) as draw,
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole
  from sized s join targets t on s.source is not distinct from t.source
), placed as (
  select *, round(target)::hugeint - whole::hugeint * source_size as need,
    coalesce(sum(size) over (partition by source order by substr(draw, 1, 3), draw, doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
  from drawn
)
select doc_id, size, source_size::bigint as source_size, target::double as target,
       (whole * size + greatest(0, least(size, need - ahead)))::bigint as taken
from placed
"""
