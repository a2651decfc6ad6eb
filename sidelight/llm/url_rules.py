"""URL filter: a list of rules, and association rules mined for the URLs it does not decide.

A list rule names a host and a path; it fits that host and all its subdomains
where the URL's path starts with the rule's, and the longest that fits wins.
The URLs that the list decides are the labelled rows: every URL becomes a set of
tokens (parts of the host, the first path segment, the file ending, the scheme),
and Spark's FP-growth mines the token combinations that go with each verdict.
Rules below the support or the confidence are pruned, as are rules that have a
shorter rule of the same verdict and no less confidence inside them. What is left
matches by an inverted index from each rule's rarest token to the rule; of the
rules that match, the one of highest confidence decides, ties to the verdict of
more support, then to ``allow``. Without a match the verdict is ``allow``.

A URL has at most ``MAX_TOKENS`` tokens (one of each kind), so at most
2 ** MAX_TOKENS / support combinations can be frequent: that bounds what is
collected and sent to the executors, whatever the input. Counting is FP-growth's
own, over all labelled rows. Training is cut from the rest by a written table.

A very long URL is read as a whole; it has no more tokens than another. Rows with null
or repeated ids are judged like any others, as no id is read.

Defined results: a null URL, or one without ``://``, has an empty host and path,
no tokens, no rule and the verdict ``allow``. Repeated rows are judged alike and
count each in training. With no labelled row nothing is mined. An empty table
gives an empty table. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelight.llm.columns import ascii_lower, read
from sidelight.workspace import Workspace

MAX_TOKENS = 9
SUPPORT, CONFIDENCE = 0.002, 0.95
LIST = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    first = F.regexp_extract(url, r"(?s)^(.*?)://", 0)
    rest = F.substring(url, F.length(first) + 1, F.length(url))
    return F.coalesce(F.when(F.length(first) > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def list_rule(host: Column, path: Column, rules=LIST) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``, or null. ``rules`` is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        at, start = text.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """At most one token of each kind; a kind that the URL lacks gives none."""
    labels = F.split(host, r"\.")

    def label(n):
        return F.get(F.reverse(labels), F.lit(n))

    found = {
        "scheme": ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
        "top": label(0),
        "site": F.when(F.size(labels) >= 2, F.concat_ws(".", label(1), label(0))),
        "name": label(2),
        "stem": F.regexp_extract(label(2), "^([^-]+)-", 1),
        "sub": label(3),
        "dir": F.regexp_extract(path, "^/([^/]+)/", 1),
        "end": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
        "query": F.regexp_extract(url, r"\?([^=&#]*)", 1),
    }
    assert len(found) <= MAX_TOKENS
    kinds = F.array(*(F.when(F.length(c) > 0, F.concat(F.lit(k + "="), c)) for k, c in found.items()))
    return F.when(F.length(host) > 0, F.array_compact(kinds)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Rules (tokens, verdict, confidence, support) from rows of ``tokens array<string>`` and ``verdict string``."""
    items = labelled.select(F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict"))))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rows = (
        model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("verdict=")))
        .where(~F.exists("antecedent", lambda t: F.startswith(t, F.lit("verdict="))))
        .select("antecedent", "consequent", "confidence", "support").collect()
    )
    found = {(tuple(sorted(r[0])), r[1][0].removeprefix("verdict=")): (r[2], r[3]) for r in rows}
    best: dict = {((), v): 0.0 for v in ("allow", "block")}

    def inside(ante: tuple[str, ...], verdict: str) -> float:
        """The highest confidence of a rule whose tokens are some of these, but not all."""
        return max((most(ante[:i] + ante[i + 1 :], verdict) for i in range(len(ante))), default=0.0)

    def most(ante: tuple[str, ...], verdict: str) -> float:
        key = ante, verdict
        if key not in best:
            best[key] = max(found.get(key, (0.0, 0.0))[0], inside(ante, verdict))
        return best[key]

    return [(a, v, *found[a, v]) for a, v in sorted(found, key=lambda k: (len(k[0]), k)) if found[a, v][0] > inside(a, v)]


class RuleIndex:
    """Inverted index: a rule is filed under its rarest token and tried only where a URL has that."""

    def __init__(self, rules) -> None:
        often: dict[str, int] = {}
        for ante, *_ in rules:
            for t in ante:
                often[t] = often.get(t, 0) + 1
        self.filed: dict[str, list] = {}
        for ante, verdict, conf, supp in rules:
            key = min(ante, key=lambda t: (often[t], t))
            self.filed.setdefault(key, []).append(((-conf, -supp, verdict), frozenset(ante), verdict))
        for under in self.filed.values():
            under.sort(key=lambda r: r[0])

    def verdict(self, found) -> str:
        have, best = set(found), None
        for t in have:
            for rank, ante, verdict in self.filed.get(t, ()):
                if best is not None and rank >= best[0]:
                    break
                if ante <= have:
                    best = rank, verdict
        return best[1] if best else "allow"


def judge(df: DataFrame, url_col: str = "url", rules=LIST, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    ws = Workspace(df.sparkSession, "urls")
    url = F.col(url_col)
    listed = F.struct(host_of(url).alias("host"), path_of(url).alias("path"))

    def parsed(rows):
        return rows.withColumn("_u", listed).withColumn("_list", list_rule(F.col("_u.host"), F.col("_u.path"), rules)).withColumn("_tokens", tokens(url, F.col("_u.host"), F.col("_u.path")))

    labelled = parsed(df.select(url_col)).where(F.col("_list").isNotNull()).select(F.col("_tokens").alias("tokens"), F.col("_list.verdict").alias("verdict"))
    labelled = ws.table(labelled, "labelled")
    mined = mine(labelled, support, confidence) if not labelled.isEmpty() else []
    ws.drop(labelled)

    rules_sent = df.sparkSession.sparkContext.broadcast(mined)  # bounded, see above

    @F.pandas_udf("string")
    def by_index(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = RuleIndex(rules_sent.value)
        for found in batches:
            memo: dict = {}
            keys = [tuple(ts) for ts in found]
            for key in set(keys):
                memo[key] = index.verdict(key)
            yield pd.Series([memo[key] for key in keys], dtype=object)

    return parsed(df).withColumns({
        "host": F.col("_u.host"), "path": F.col("_u.path"), "rule": F.col("_list.rule"),
        "verdict": F.coalesce(F.col("_list.verdict"), by_index(F.col("_tokens"))),
    }).drop("_u", "_list", "_tokens")


def op7_url_rules(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
