"""SpotSigs fingerprints, by DataFrame functions alone.

A spot is a chain: the ``CHAIN`` content words that follow a common word (an
anchor). Words are runs of letters and digits, lower-cased; anchors are the
common words of several languages, and do not count as content words. The set of
a text's spots, each hashed to 32 bits, is its fingerprint, written as sorted hex.
A text with words but no spot (it has no anchor, or less than ``CHAIN`` content
words after its last one) has its pairs of adjacent words instead, or its only word.

Likeness is the exact Jaccard similarity; with a ``floor`` it is 0 where the sizes
alone keep it below. A search (``alike``) finds all sets at least as alike as a floor:
sizes fall into partitions of powers of 1 / floor, so that only partitions that touch
meet. In them, sets meet through an index of their spots: as spots are hashes, two sets
as alike as the floor share one among the first n - ceil(floor * n) + 1 in the order of
their values, and those alone are filed. What meets, and whose sizes allow it, is
intersected once.

Defined results: a null text is empty. A text without words has the empty
fingerprint. Equal fingerprints have likeness 1, the empty one and any other 0.
Documents are in descending order of their id, rows with null ids last; rows with
equal ids are in the order of a hash of their texts, so that one id's rows are dealt
out like any others, and equal rows follow each other. A text of any length is read
as a whole. An empty table gives an empty table. Extra columns, whatever their
names, are not returned.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidelight.llm.columns import read
from sidelight.workspace import Workspace

CHAIN = 2
RANGE_ROWS, RANGE_CHARS = 4000, 1 << 23  # of the rows that one window orders, about
MAX_RANGES, PER_RANGE = 1 << 14, 16  # at most so many ranges, whose borders come from so many sampled keys each

# Common words of English, German, French and Spanish.
ANCHORS = """
the of and to a in is that it for was on with by be as this are at from or an not but have has had were which their they
der die und das den von zu mit sich auf des für ist nicht im dem ein eine als auch es an werden aus er hat dass sie nach
de la le et les en un du une que pour est qui par dans sur pas au avec ne se ce il sont plus ou son
el y los del las por no con su para al lo una como más pero sus le ya o este sí porque esta entre cuando
""".split()


def _any_of(words) -> str:
    """A pattern for a set of words, by first letters, so that a word is tried against few."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[:1], []).append(w[1:])
    return "(?:" + "|".join(k if tails == [""] else k + ("(?:" + "|".join(sorted(filter(None, tails), reverse=True)) + ")") + ("?+" if "" in tails else "") for k, tails in by_first.items()) + ")"


_ANCHOR = " " + _any_of(ANCHORS) + "(?= )"


def spots(text: Column) -> Column:
    """The sorted, distinct, 32-bit hashes of a text's spots."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " "), F.lit(" "))
    words = F.regexp_replace(words, "^ ++| ++$", " ")

    def runs(w):  # every anchor becomes a bar; what lies between two bars is a run of content words
        return F.struct(F.split(F.regexp_replace(w, _ANCHOR, "|"), r"(?:\|\s*)++").alias("r"), w.alias("w"))

    def chain(run, i, all_runs):
        """The first words of a run, and where it has only one, the first of the next; null without."""
        after = F.when(i + 1 < F.size(all_runs), F.nullif(F.substring_index(F.get(all_runs, i + 1), " ", 1), F.lit("")))
        first = F.when(F.instr(run, " ") > 0, F.substring_index(run, " ", CHAIN)).otherwise(F.concat(run, F.lit(" "), after))
        return F.when((i > 0) & (run != ""), first)

    def of(bound):
        trimmed = F.transform(bound["r"], lambda r: F.trim(r))  # F.trim alone would take the index for what to trim
        found = F.transform(F.array(F.struct(trimmed.alias("a"))), lambda s: F.array_compact(F.transform(s["a"], lambda r, i: chain(r, i, s["a"]))))[0]
        plain = F.trim(bound["w"])
        each = F.split(plain, " ")
        pairs = F.zip_with(F.slice(each, F.lit(1), F.size(each) - 1), F.slice(each, F.lit(2), F.size(each) - 1), lambda x, y: F.concat(x, F.lit(" "), y))
        whole = F.when(F.instr(plain, " ") > 0, pairs).when(plain != "", F.array(plain)).otherwise(F.array().cast("array<string>"))
        chosen = F.transform(F.array(F.struct(found.alias("c"), whole.alias("w"))), lambda s: F.when(F.size(s["c"]) > 0, s["c"]).otherwise(s["w"]))[0]
        return F.array_sort(F.array_distinct(F.transform(chosen, lambda c: F.hash(c))))

    # each step is bound by a lambda, and so computed once
    return F.transform(F.transform(F.array(words), runs), of)[0]


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two sets of spots, with a floor 0 where their sizes alone keep it below."""
    na, nb = F.size(a), F.size(b)

    common = F.size(F.array_intersect(a, b))
    out = F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0))
    if floor > 0:
        out = out.when((F.abs(_length_partition(na, floor) - _length_partition(nb, floor)) > 1) | (F.least(na, nb) < F.lit(floor) * F.greatest(na, nb)), F.lit(0.0))
    return out.otherwise(common / (na + nb - common))


def _borders(keys: DataFrame, ranges: int, rows: int) -> list:
    """About ``ranges`` - 1 evenly spaced keys, of a sample of ``PER_RANGE`` keys a range."""
    if ranges == 1:
        return []
    draw = F.pmod(F.xxhash64(*keys.columns), F.lit(1 << 30)) < int((1 << 30) * min(1.0, PER_RANGE * ranges / rows))
    some = sorted(tuple(r) for r in keys.where(draw).collect())
    return sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []


def _range_of(key: Column, borders: list) -> Column:
    """How many borders do not exceed a key; borders stand in groups, so that few are compared."""
    if not borders:
        return F.lit(0)
    width = ceil(len(borders) ** 0.5)
    groups = [borders[k : k + width] for k in range(0, len(borders), width)]
    lit = lambda t: F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(t, ("at", "hash", "place"))))
    heads, inner = F.array(*(lit(g[0]) for g in groups)), F.array(*(F.array(*map(lit, g)) for g in groups))

    def count(found, k):
        return F.size(F.filter(found, lambda b: b <= k))

    # the key and its group are bound by lambdas, and so computed once
    group = lambda k: F.struct(k.alias("k"), count(heads, k).alias("g"))
    within = lambda s: F.when(s["g"] == 0, F.lit(0)).otherwise((s["g"] - 1) * width + count(F.get(inner, s["g"] - 1), s["k"]))
    return F.transform(F.transform(F.array(key), group), within)[0]


def _length_partition(n: Column, floor: float) -> Column:
    # the margin lets a size that is a whole power fall where its value says
    return F.floor(F.log(n.cast("double")) / F.lit(log(1 / floor)) + F.lit(1e-9)).cast("int")


def alike(df: DataFrame, asks: Column, floor: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query_id``, ``id``, ``likeness``: for each row where ``asks``, all rows of other ids that are as alike as ``floor``.

    Rows with a null id, and texts without words, take no part; rows with one id are one for each different fingerprint,
    and of its likenesses the highest counts. Only ids and single spots meet; spots of whole texts are joined to pairs
    that met. A spot that many sets file brings as many ids to each query that files it, which a join can split.
    """
    ws = Workspace(df.sparkSession, "alike")
    sets = ws.table(df.select(F.col(id_col).alias("id"), spots(F.col(text_col)).alias("spots"), F.coalesce(asks, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & (F.size("spots") > 0)).distinct(), "sets")
    n = F.size("spots")
    filed = F.slice("spots", F.lit(1), n - F.ceil(n * F.lit(floor) - F.lit(1e-9)).cast("int") + 1)
    index = sets.select("id", n.alias("n"), _length_partition(n, floor).alias("part"), F.explode(filed).alias("spot"))
    near = F.sequence(_length_partition(n, floor) - 1, _length_partition(n, floor) + 1)
    asked = sets.where("asks").select(F.col("id").alias("query_id"), n.alias("q_n"), near.alias("near"), F.explode(filed).alias("spot")).withColumn("part", F.explode("near"))
    fits = F.least("n", "q_n") >= F.greatest("n", "q_n") * F.lit(floor - 1e-9)
    met = asked.join(index, ["spot", "part"]).where(fits & (F.col("id") != F.col("query_id"))).select("query_id", "id").distinct()
    theirs = sets.select("id", "spots")
    full = met.join(theirs, "id").join(theirs.select(F.col("id").alias("query_id"), F.col("spots").alias("q_spots")), "query_id")
    scored = full.select("query_id", "id", likeness(F.col("q_spots"), F.col("spots")).alias("likeness")).where(F.col("likeness") >= floor - 1e-12)
    return scored.groupBy("query_id", "id").agg(F.max("likeness").alias("likeness"))


def with_next(df: DataFrame, ws: Workspace) -> DataFrame:
    """``id``, ``text`` of each row and its ``spots``, with ``next_text``, ``next_spots`` of the row after it
    in descending order of ``id``; after the last comes the first.

    Rows are dealt out by ranges of their key: the id turned round, a hash of the text, and the
    row's place in the scan, which spreads equal rows. A window orders each range; where it
    ends, the first row of the next range follows. Borders are bounded in number and drawn from
    a sample; they decide where a row is ordered, not what follows it.
    """
    at = F.coalesce(F.bitwise_not(F.col("id").cast("long")), F.lit((1 << 63) - 1))
    keys = F.struct(at.alias("at"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    rows = df.select("id", "text", keys.alias("key"))
    size = df.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    ranges = min(MAX_RANGES, max(1, -(-size["n"] // RANGE_ROWS), -(-(size["chars"] or 0) // RANGE_CHARS)))
    borders = _borders(rows.select("key.*"), ranges, size["n"])
    dealt = rows.withColumn("range", _range_of(F.col("key"), borders))
    heads = ws.table(dealt.groupBy("range").agg(F.min("key").alias("head")), "heads")
    on = Window.orderBy("range")  # a row a range
    follows = ws.table(heads.select("range", F.coalesce(F.lead("head").over(on), F.first("head").over(on)).alias("after")), "follows")
    wanted = follows.select(F.col("after.at").alias("at"), F.col("after.hash").alias("hash")).distinct()
    firsts = rows.select("key.at", "key.hash", "text").join(F.broadcast(wanted), ["at", "hash"]).groupBy("at", "hash").agg(F.min("text").alias("edge_text"))
    edges = follows.select("range", "after.at", "after.hash").join(firsts, ["at", "hash"]).select("range", "edge_text")
    edges = ws.table(edges, "edges").withColumn("edge_spots", spots(F.col("edge_text")))
    # dealt out before the spots are made, so that the text alone is shuffled
    dealt = dealt.repartition("range").withColumn("spots", spots(F.col("text")))
    inside = Window.partitionBy("range").orderBy("key", "text")
    led = dealt.withColumns({"lead_text": F.lead("text").over(inside), "lead_spots": F.lead("spots").over(inside)})
    return led.join(edges, "range").select(
        "id", "text", "spots", F.coalesce("lead_text", "edge_text").alias("next_text"), F.coalesce("lead_spots", "edge_spots").alias("next_spots")
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` of every row."""
    return df.select(id_col, fingerprint(spots(F.col(text_col))).alias("fingerprint"))


def op8_spotsigs(spark, sf_dir):
    ws = Workspace(spark, "spots")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, ws)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = pairs.select(
        "id", "spots", "next_spots", n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"),
    )
    coded = edited.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "spots", "next_spots", spots(F.col("edited")).alias("edited_spots"))
    return coded.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
