"""Line dedup: a line that many documents hold stays only in the first of them.

Lines are exploded to 128-bit hashes of their normalised form (white space
stripped at both ends, A-Z lower-cased), which are written once; the distinct documents of each hash are
counted, and documents drop their lines over the threshold and are put together
again by position. Only hashes and ids are shuffled by line; a hash that a third
of the documents hold is combined map-side in the count, and adaptive execution
splits it in the join. The text itself moves once, in the join by document.

Defined results: a null or empty text is one empty line. Rows with the same id
are one document; rows with a null id are together one document that sorts after
all others. A text of any length is cut as a whole; where several documents hold a line,
the smallest id keeps it. Repeated lines inside one document are no reason to drop them. An
empty table gives an empty table. Columns named like the added ones are
replaced; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelight.llm.columns import SPACES, ascii_lower, read
from sidelight.workspace import Workspace


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _without(lines: Column, positions: Column) -> Column:
    """The lines at all other positions, joined; array_except hashes, so long documents stay linear."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
    both = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))  # bound once by the outer lambda
    return F.transform(both, lambda b: F.array_join(F.transform(b["kept"], lambda i: F.get(b["lines"], i)), "\n"))[0]


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``df`` with ``text`` cleaned, and ``n_lines`` (before), ``n_dropped``.

    Lines whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents are dropped except in the smallest id.
    """
    text = F.col(text_col)
    lines = df.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text).alias("_text"),
        F.posexplode(F.transform(_lines(text), _key)).alias("_pos", "_key"),
    ).where(F.length("_key") >= min_chars)
    ws = Workspace(df.sparkSession, "lines")
    # read twice, and so cut and hashed once
    lines = ws.table(lines.select("_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2")), "lines")
    repeated = (
        lines.select("_h1", "_h2", "_id").distinct()
        .groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_first"))
        .where(F.col("_docs") >= min_docs).drop("_docs")
    )
    # a table of its own, so that the join shuffles both sides itself and a hot line can be split
    repeated = ws.table(repeated, "repeated")
    drops = (
        lines.join(repeated, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_first")))
        .groupBy(F.col("_id").alias("_d_id"), F.col("_text").alias("_d_text")).agg(F.collect_set("_pos").alias("_d_pos"))
    )
    on = df[id_col].eqNullSafe(drops["_d_id"]) & (F.xxhash64(df[text_col]) == drops["_d_text"])
    joined = df.join(drops, on, "left")
    return joined.withColumns({
        "n_lines": F.size(_lines(text)).cast("long"),
        "n_dropped": F.coalesce(F.size("_d_pos"), F.lit(0)).cast("long"),
        text_col: F.when(F.col("_d_pos").isNull(), text).otherwise(_without(_lines(text), F.col("_d_pos"))),
    }).drop("_d_id", "_d_text", "_d_pos")


def op10_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
  from lines
), repeated as (
  select line_key, min(doc_id) as first_id from keyed where length(line_key) >= 10
  group by line_key having count(distinct doc_id) >= 2
), marked as (
  select k.*, r.line_key is not null and k.doc_id <> r.first_id as dropped
  from keyed k left join repeated r on k.line_key = r.line_key
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where dropped))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""
