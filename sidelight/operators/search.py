"""Hybrid ranked search: cosine of embeddings plus bonuses for people, places and dates.

What matching needs of a record is worked out once, when it is indexed (``keyed``):
the first letters of the words of its people and places. The index is scored in one
projection after its scope filter, so that a scan reads only what the scope keeps, and
ranked by TakeOrderedAndProject. What the query says is worked out once, before the
scan. Ties keep the order of the index (``seq``).

A batch of queries is met in blocks of bounded size, which a scan scores as matrices;
a task keeps the best of each query it has seen, and what the best are called is
worked out for them alone.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sidelight.functions.dates import date_label, parse_query
from sidelight.functions.text import MIN_WORD, has_cjk, let, match_key, normalised, split_letters, words
from sidelight.functions.vectors import TINY, cosine_to
from sidelight.schemas import QUERY_DATE

DEFAULT_SOURCES = ("photos",)
PERSON, PER_HIT, PLACE = 1.0, 0.01, 0.7
DAY, MONTH, YEAR = 0.9, 0.6, 0.3
TOP = 48
MAX_BATCH, MAX_BATCH_BYTES = 1000, 32 << 20  # queries of a block, and bytes of their vectors
_SLICE = 4096  # records that are scored at a time
_PAIRS = 1 << 16  # pairs of a record and a query that are scored in double at a time
_BLOCKS, _KEPT = 16, 16 * 1000 * TOP  # blocks that one scan serves, and results that it keeps

# Examples of places by other names; a file adds more.
ALIASES = {
    "germany": ["deutschland"],
    "austria": ["osterreich"],
    "czech republic": ["cesko", "czechia"],
    "vienna": ["wien"],
    "munich": ["munchen"],
    "prague": ["praha"],
}


def load_aliases(spark: SparkSession, path: str | None = None) -> dict[str, list[str]]:
    """The built-in aliases with those of a JSON file appended, normalised."""
    out = {k: list(v) for k, v in ALIASES.items()}
    if path:
        text = "\n".join(r.value for r in spark.read.text(path).collect())
        fold = lambda s: (s or "").casefold().replace("ё", "е")
        for key, values in json.loads(text).items():
            out.setdefault(fold(key), []).extend(map(fold, values))
    return out


def _keys(found: Column) -> Column:
    return F.transform(found, lambda w: match_key(w))  # match_key alone would take the index for its n


def people_keys(people: Column) -> Column:
    """For each name, the keys of its words."""
    return F.transform(people, lambda p: _keys(words(p)))


def place_parts(location: Column) -> Column:
    """City, province and country where they are given, normalised."""
    given = F.filter(F.array(*(location[k] for k in ("city", "province", "country"))), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.when(location.isNotNull(), F.transform(given, normalised)).otherwise(F.array().cast("array<string>"))


def place_keys(parts: Column, name: Column) -> Column:
    """The keys of the words of a place's parts and of its name; a part without a word counts as one itself."""

    def words_of(part):
        return let(split_letters(part), lambda inner: F.when(F.size(inner) > 0, inner).otherwise(F.array(part)))

    return _keys(F.array_distinct(F.concat(F.flatten(F.transform(parts, words_of)), words(name))))


def keyed(index: DataFrame) -> DataFrame:
    """``index`` with what matching needs of it, as ``people_keys``, ``place_parts``, ``place_keys``; an index that has them is left as it is."""
    if "people_keys" in index.columns:
        return index
    none = F.array().cast("array<string>")
    added = index.withColumns({"people_keys": people_keys(F.coalesce("people", none)), "place_parts": place_parts(F.col("location"))})
    return added.withColumn("place_keys", place_keys(F.col("place_parts"), F.col("location.name")))


def aliased_parts(query_keys: list[str], aliases: dict[str, list[str]]) -> list[str]:
    """The parts of places, by their normalised name, that have an alias which the query hits."""
    asked, letters = set(query_keys), re.compile(r"[^\W\d_]{%d,}" % MIN_WORD)
    key = lambda w: w[:4]
    return sorted(part for part, others in aliases.items() if any(asked & set(map(key, letters.findall(t) or [t])) for t in others))


def match_person(query_keys: Column, people: Column, keys: Column) -> Column:
    """struct<name, hits> of the name with the most matching pairs of words, the first of equals; null without a hit."""

    def hits(name):
        return F.aggregate(name, F.lit(0), lambda n, w: n + F.size(F.filter(query_keys, lambda q: q == w)))

    scored = F.zip_with(people, keys, lambda p, k: F.struct(p.alias("name"), hits(k).alias("hits")))
    nobody = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("hits"))
    best = F.aggregate(scored, nobody, lambda a, b: F.when(b["hits"] > a["hits"], b).otherwise(a))
    return F.when(F.arrays_overlap(F.flatten(keys), query_keys), best)


def match_location(query_keys: Column, query_parts: Column, location: Column, parts: Column, keys: Column) -> Column:
    """The most specific part of a place that a query word hits, itself or by an alias; null if none does or all parts are empty."""
    hit = F.arrays_overlap(keys, query_keys) | F.arrays_overlap(parts, query_parts)
    return F.when(hit, F.coalesce(*(F.nullif(location[k], F.lit("")) for k in ("city", "province", "country"))))


def match_date(asked: Column, date: Column) -> Column:
    """struct<bonus, label> where a date has every part that is asked for, else null."""

    def agrees(part, test):
        return part.isNull() | F.coalesce(test, F.lit(False))

    fits = (
        asked.isNotNull() & date.isNotNull() & agrees(asked["year"], asked["year"] == date["year"])
        & agrees(asked["months"], F.array_contains(asked["months"], date["month"])) & agrees(asked["day"], asked["day"] == date["day"])
    )
    bonus = F.when(asked["day"].isNotNull(), DAY).when(F.size(asked["months"]) == 1, MONTH).otherwise(YEAR)
    return F.when(fits, F.struct(bonus.alias("bonus"), date_label(date).alias("label")))


def scored(index: DataFrame, query_keys: Column, query_parts: Column, asked: Column, query_unit: Column) -> DataFrame:
    """A keyed ``index`` with ``cosine``, ``score``, ``match_type``, ``match_label``.

    A person outranks a place, and a place a date, in what the match is called; bonuses add up.
    """
    out = index.withColumns({
        "cosine": cosine_to(F.col("vector"), query_unit),
        "_person": match_person(query_keys, F.col("people"), F.col("people_keys")),
        "_place": match_location(query_keys, query_parts, F.col("location"), F.col("place_parts"), F.col("place_keys")),
        "_date": match_date(asked, F.col("date")),
    })
    zero = F.lit(0.0)
    return out.withColumns({
        "score": F.col("cosine")
        + F.coalesce(F.lit(PERSON) + F.lit(PER_HIT) * F.col("_person.hits"), zero)
        + F.when(F.col("_place").isNotNull(), F.lit(PLACE)).otherwise(zero)
        + F.coalesce(F.col("_date.bonus"), zero),
        "match_type": F.when(F.col("_person").isNotNull(), "person").when(F.col("_place").isNotNull(), "location").when(F.col("_date").isNotNull(), "date"),
        "match_label": F.coalesce(F.col("_person.name"), F.col("_place"), F.col("_date.label")),
    }).drop("_person", "_place", "_date", "people_keys", "place_parts", "place_keys")


def clean(index: DataFrame) -> DataFrame:
    """The index as it is searched: without glitched records and those without a vector, missing parts as empty ones, keyed."""
    none = F.array().cast("array<string>")
    return keyed(index.where(~has_cjk(F.col("description"), F.col("keywords")) & F.col("vector").isNotNull()).withColumns({
        "keywords": F.coalesce("keywords", none), "people": F.coalesce("people", none),
        "source": F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("photos")),
    }))


def _said(spark: SparkSession, texts: list[str], aliases: dict | None) -> list[tuple]:
    """What each query says: the keys of its words, the parts of places that it names by an alias, its date."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    found = rows.select("i", _keys(words(F.col("q"))).alias("w"), parse_query(F.col("q")).alias("d")).collect()
    known = ALIASES if aliases is None else aliases
    return [(r.w, aliased_parts(r.w, known), r.d) for r in sorted(found, key=lambda r: r.i)]


def _unit(vector: list[float]) -> list[float]:
    length = sum(float(x) * float(x) for x in vector) ** 0.5 + TINY
    return [float(x) / length for x in vector]


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def search(index: DataFrame, query: str, vector: list[float], top: int = TOP, sources=DEFAULT_SOURCES, aliases: dict | None = None) -> DataFrame:
    """The ``top`` records of a cleaned index for one query, best first. A blank query has no results."""
    scope = index.where(F.col("source").isin(*sources) & (F.size("vector") == len(vector)))
    (given, parts, date), = _said(index.sparkSession, [query], aliases)
    asked = F.lit(None).cast(QUERY_DATE)
    if date is not None:
        months = F.lit(None) if date.months is None else F.array(*map(F.lit, date.months))
        asked = F.struct(F.lit(date.year).cast("int").alias("year"), months.cast("array<int>").alias("months"), F.lit(date.day).cast("int").alias("day"))
    query_unit = F.array(*map(F.lit, _unit(vector))).cast("array<double>")
    out = scored(scope, _strings(given), _strings(parts), asked, query_unit)
    if not query.strip():
        out = out.where(F.lit(False))
    return out.orderBy(F.col("score").desc(), F.col("seq")).limit(max(0, top))


def _cosines(vectors: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order in which ``cosine_to`` sums, so that equal vectors tie wherever they stand."""
    dot, square = np.zeros(len(vectors)), np.zeros(len(vectors))
    for x, u in zip(vectors.T, units.T):
        dot += x * u
        square += x * x
    norm = np.sqrt(square)
    return dot / np.where(norm == 0, TINY, norm)


class _Block:
    """At most ``MAX_BATCH`` queries as matrices over records, and the best of each so far.

    Queries that say the same in the same scope are of one kind, and bonuses are worked out by kind. A product in
    single precision tells which records can be among the best; those are scored in double.
    """

    def __init__(self, said: list[tuple], units: list[list[float]], kinds: list[int], top: int) -> None:
        """``said``: words, parts, date and sources of each kind; ``kinds``: that of each query, in order."""
        self.units, self.top, self.kinds = np.array(units, np.float64), top, np.array(kinds)
        self.narrow = self.units.astype(np.float32)
        self.dates, self.sources, many = [d for *_, d, _ in said], [set(s) for *_, s in said], len(said)
        words, parts = {}, {}  # word key to (kind, times); part to kinds
        for q, (keys, named, *_) in enumerate(said):
            for k in set(keys):
                words.setdefault(k, []).append((q, keys.count(k)))
            for p in named:
                parts.setdefault(p, []).append((q, 1))
        self.words, self.parts, self.spans = words, parts, np.searchsorted(self.kinds, np.arange(many + 1))
        self.together = len(units) < 8 * many  # many kinds of few queries: not kind by kind
        self.start()

    def start(self) -> None:
        self.best, self.floor = [(np.empty(0), np.empty(0, np.int64))] * len(self.units), np.full(len(self.units), -np.inf)

    def _hits(self, lists: pa.ListArray, known: dict[str, list]) -> np.ndarray:
        """Rows x kinds: how many pairs of a row's strings and a query's are the same."""
        out = np.zeros((len(lists), len(self.dates)), np.int32)
        if known:
            place = pc.index_in(lists.flatten(), value_set=pa.array(list(known), pa.string()))
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            met = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
            found = place.take(pa.array(met)).to_numpy(zero_copy_only=False)
            for k, asked in enumerate(known.values()):
                rows = row[met[found == k]]
                for q, times in asked if len(rows) else ():
                    np.add.at(out[:, q], rows, times)
        return out

    def _dated(self, date: pa.StructArray) -> np.ndarray:
        out = np.zeros((len(date), len(self.dates)))
        year, month, day = (pc.fill_null(pc.struct_field(date, [k]), -1).to_numpy(zero_copy_only=False) for k in ("year", "month", "day"))
        for q, asked in enumerate(self.dates):
            if asked is not None:
                fits = np.ones(len(date), bool)
                for part, wanted in ((year, asked.year), (day, asked.day)):
                    fits &= True if wanted is None else part == wanted
                fits &= True if asked.months is None else np.isin(month, asked.months)
                one_month = asked.months is not None and len(asked.months) == 1
                out[fits & date.is_valid().to_numpy(zero_copy_only=False), q] = DAY if asked.day is not None else MONTH if one_month else YEAR
        return out

    def _bonuses(self, batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows x kinds: what people, places and dates add, and what is in scope."""
        source, people, parts, places, date = (batch.column(c) for c in ("source", "people_keys", "place_parts", "place_keys", "date"))
        named = self._hits(people.flatten(), self.words)
        best = np.zeros((len(batch), len(self.dates)), np.int32)
        if named.any():  # of a record's names the best one counts
            np.maximum.at(best, pc.list_parent_indices(people).to_numpy(zero_copy_only=False), named)
        placed = np.where((self._hits(places, self.words) > 0) | (self._hits(parts, self.parts) > 0), PLACE, 0.0) * self._labelled(parts)[:, None]
        names = source.dictionary_encode()
        scope = np.array([[n in s for s in self.sources] for n in names.dictionary.to_pylist()], bool).reshape(-1, len(self.sources))
        return [np.where(best > 0, PERSON + PER_HIT * best, 0.0), placed, self._dated(date)], scope[names.indices.to_numpy(zero_copy_only=False)]

    @staticmethod
    def _labelled(parts: pa.ListArray) -> np.ndarray:
        """A place of which only a name is known matches nothing."""
        return pc.list_value_length(parts).to_numpy(zero_copy_only=False) > 0

    def take(self, batch: pa.RecordBatch, seq: np.ndarray, vectors: np.ndarray, narrow: np.ndarray) -> None:
        """The best of each query with the records of ``batch``, ``vectors`` as they are and ``narrow`` at length 1."""
        bonuses, scope = self._bonuses(batch)
        total = sum(bonuses)
        off = np.float64(2.0**-23) * (vectors.shape[1] + 20 + 4 * total.max(initial=0.0))  # above what single precision is off by
        for rows, queries in self._candidates(narrow, total, scope, off):
            for at in range(0, len(rows), _PAIRS):
                r, q = rows[at : at + _PAIRS], queries[at : at + _PAIRS]
                score = _cosines(vectors[r], self.units[q])
                for part in bonuses:
                    score += part[r, self.kinds[q]]
                self._keep(q, score, seq[r])

    def _candidates(self, narrow: np.ndarray, total: np.ndarray, scope: np.ndarray, off: float):
        """(rows, queries) of pairs that can be among the best."""
        if self.together or np.isneginf(self.floor).any():
            scores = narrow @ self.narrow.T
            scores += np.where(scope, total, -np.inf).astype(np.float32)[:, self.kinds]
            low = self.floor - off
            if len(scores) > self.top and (open_ := np.flatnonzero(np.isneginf(low))).size:
                ranked = np.nan_to_num(scores[:, open_], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                low[open_] = np.partition(ranked, -self.top, axis=0)[-self.top] - 2 * off
            yield np.nonzero((scores >= low.astype(np.float32)) & (scores > -np.inf))
            return
        for k, (first, last) in enumerate(zip(self.spans, self.spans[1:])):
            # no cosine is above 1, so that most records without a bonus need no product once the best have one
            rows = np.flatnonzero(scope[:, k] & (total[:, k] + 1 + off >= self.floor[first:last].min()))
            values, of = np.unique(total[rows, k], return_inverse=True)
            for v, value in sorted(enumerate(values.tolist()), key=lambda x: -x[1]):
                mine, low = rows[of == v], self.floor[first:last] - value - off
                asked = np.flatnonzero(low <= 1)
                r, q = np.nonzero(narrow[mine] @ self.narrow[first:last][asked].T >= low[asked].astype(np.float32))
                if len(r):
                    yield mine[r], asked[q] + first

    def _keep(self, queries: np.ndarray, score: np.ndarray, seq: np.ndarray) -> None:
        new = np.flatnonzero((score >= self.floor[queries]) & (score > -np.inf))
        new = new[np.argsort(queries[new], kind="stable")]
        asked, starts = np.unique(queries[new], return_index=True)
        for q, mine in zip(asked.tolist(), np.split(new, starts[1:])):
            s, v = np.concatenate((self.best[q][0], score[mine])), np.concatenate((self.best[q][1], seq[mine]))
            order = np.lexsort((v, -s))[: self.top]
            self.best[q] = s[order], v[order]
            if len(order) == self.top:
                self.floor[q] = s[order[-1]]


def _best(blocks: list[_Block]):
    """Of the records of a task, the best of each query; queries are numbered through all blocks."""

    def run(batches):
        for block in blocks:
            block.start()
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                seq = batch.column("seq").to_numpy(zero_copy_only=False)
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                norm = np.sqrt((x * x).sum(axis=1))
                narrow = (x / np.where(norm == 0, TINY, norm)[:, None]).astype(np.float32)
                for block in blocks:
                    block.take(batch, seq, x, narrow)
        for q, (s, v) in enumerate(found for block in blocks for found in block.best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q), pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["_q", "seq", "_s"])

    return run


def search_many(index: DataFrame, queries: DataFrame, top: int = TOP, aliases: dict | None = None) -> DataFrame:
    """A batch of queries (``query_id, query, vector, sources array<string>``): ``query_id``, ``rank`` and the record.

    Queries are scored in blocks of at most ``MAX_BATCH``. One scan of the index serves several blocks, of together
    about ``MAX_BATCH_BYTES``, dealt by a hash of ``query_id``; the queries of one scan are on the driver at a time.
    ``index`` is cleaned, and ``seq`` tells its records apart.
    Blank queries, and records whose vectors have another width than the query's, have no results.
    """
    spark, top = index.sparkSession, max(0, top)
    asked = queries.where((F.trim("query") != "") & F.col("vector").isNotNull()).select("query_id", "query", F.col("vector").cast("array<double>").alias("vector"), "sources")
    sizes = [(r["width"], r["n"]) for r in asked.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).collect()]
    found = []
    for width, n in sorted(sizes):
        most = max(1, min(max(MAX_BATCH, min(_BLOCKS * MAX_BATCH, _KEPT // max(1, top))), MAX_BATCH_BYTES // (8 * max(1, width))))
        blocks = 1 if n <= most else -(-2 * n // most)
        of_width = asked.where(F.size("vector") == width)
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        for b in range(blocks):
            rows = of_width.where(block == b).collect()
            for at in range(0, len(rows), most):  # a hash may deal unevenly, or ids repeat
                found.append(_ranked(index.where(F.size("vector") == width), rows[at : at + most], asked.schema["query_id"].dataType.simpleString(), top, aliases))
    if not found:
        found = [_ranked(index.where(F.lit(False)), [], asked.schema["query_id"].dataType.simpleString(), top, aliases)]
    return reduce(DataFrame.unionByName, found)


def _ranked(index: DataFrame, rows: list[Row], id_type: str, top: int, aliases: dict | None) -> DataFrame:
    spark = index.sparkSession
    texts = list(dict.fromkeys(r.query for r in rows))
    known = dict(zip(texts, _said(spark, texts, aliases))) if rows else {}
    alike: dict = {}  # what is said in which scope, to its queries
    for r in rows:
        alike.setdefault((r.query, frozenset(r.sources)), []).append(r)
    rows = [r for of in alike.values() for r in of]
    kind = [k for k, of in enumerate(alike.values()) for _ in of]
    said, units = [(*known[text], scope) for text, scope in alike], [_unit(r.vector) for r in rows]
    blocks = []
    for at in range(0, len(rows), MAX_BATCH):
        mine = kind[at : at + MAX_BATCH]
        blocks.append(_Block(said[mine[0] : mine[-1] + 1], units[at : at + MAX_BATCH], [k - mine[0] for k in mine], top))
    read = index.select("seq", "source", "people_keys", "place_parts", "place_keys", "date", "vector")
    near = read.mapInArrow(_best(blocks), "_q int, seq long, _s double") if rows and top else spark.createDataFrame([], "_q int, seq long, _s double")
    order = Window.partitionBy("_q").orderBy(F.col("_s").desc(), F.col("seq"))
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("_s")
    told = [(q, r.query_id, *known[r.query], u) for q, (r, u) in enumerate(zip(rows, units))]
    kinds = f"_q int, query_id {id_type}, _keys array<string>, _parts array<string>, _asked {QUERY_DATE}, _unit array<double>"
    # at most _KEPT rows of three numbers, or MAX_BATCH x top, and a scan's queries
    met = index.join(F.broadcast(best), "seq").join(F.broadcast(spark.createDataFrame(told, kinds)), "_q")
    return scored(met, F.col("_keys"), F.col("_parts"), F.col("_asked"), F.col("_unit")).drop("_q", "_keys", "_parts", "_asked", "_unit")


def stats(index: DataFrame) -> DataFrame:
    """One row: ``indexed``, ``total`` and ``skipped_cjk`` records, and the count of each source."""
    none = F.array().cast("array<string>")
    rows = index.select(
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("photos")).alias("source"),
        has_cjk(F.col("description"), F.coalesce("keywords", none)).alias("glitch"),
    )
    per = rows.groupBy("source").agg(F.count_if(~F.col("glitch")).alias("n"), F.count_if(F.col("glitch")).alias("bad"))
    return per.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("indexed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("bad"), F.lit(0)).alias("skipped_cjk"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("source", "n"))))).alias("by_source"),
    )


def scope_total(index: DataFrame, sources=DEFAULT_SOURCES) -> DataFrame:
    """Records in scope, whether or not they match."""
    return index.where(F.col("source").isin(*sources)).agg(F.count("*").alias("total"))


def printed(results: DataFrame) -> DataFrame:
    """Ranked results as lines of text."""
    order = Window.orderBy(F.col("score").desc(), F.col("seq"))
    tag = F.when(F.col("match_type").isNotNull(), F.concat(F.lit(" ["), F.col("match_type"), F.lit(": "), F.col("match_label"), F.lit("]"))).otherwise(F.lit(""))
    return results.select(F.row_number().over(order).alias("rank"), F.concat(F.format_string("%.3f", F.col("score")), tag, F.lit("  "), F.col("path"), F.lit("\n  "), F.col("description"), F.lit("\n  "), F.array_join("keywords", ", ")).alias("line"))
