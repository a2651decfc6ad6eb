"""A model's answer: parsing it, and what becomes of the image it was about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sidelight.functions.text import split_words, strip

SHORT, LONG_LIST, LONG = 3, 5, 5  # words of a keyword; items of a list that may hold longer ones; their words
# What logs say.
SILENT = "provider returned null content (silent refusal?)"
UNPARSED = "failed to parse description/keywords"
UNPARSED_REPAIR = "failed to parse"


def _strings() -> Column:
    return F.array().cast("array<string>")


def as_keywords(line: Column) -> Column:
    """The items of a comma-separated list, or none where the line reads as prose."""
    items = F.transform(F.filter(F.split(line, ","), lambda x: strip(x) != ""), lambda x: F.regexp_replace(strip(x), r"\.+$", ""))
    longest = F.array_max(F.transform(items, lambda x: F.size(split_words(x))))
    n = F.size(items)
    good = (n >= 2) & ((longest <= SHORT) | ((n >= LONG_LIST) & (longest <= LONG)))
    return F.when(good, items).otherwise(_strings())


def _around_last(text: Column, sep: str) -> tuple[Column, Column]:
    """What stands before and after the last separator; nothing and all, where there is none."""
    tail = F.substring_index(text, sep, -1)
    head = F.left(text, F.greatest(F.length(text) - F.length(tail) - len(sep), F.lit(0)))
    return F.when(F.instr(text, sep) > 0, head).otherwise(F.lit("")), tail


def parse_answer(text: Column) -> Column:
    """struct<description, keywords>: keywords after the last blank line, else on the last line, else none."""
    text = F.coalesce(text, F.lit(""))
    head, tail = _around_last(text, "\n\n")
    first, last = _around_last(text, "\n")
    by_gap = F.when(head != "", as_keywords(tail)).otherwise(_strings())
    by_line = F.when(first != "", as_keywords(last)).otherwise(_strings())
    gap, line = F.size(by_gap) > 0, F.size(by_line) > 0
    return F.struct(
        strip(F.when(gap, head).when(line, first).otherwise(text)).alias("description"),
        F.when(gap, by_gap).otherwise(by_line).alias("keywords"),
    )


def transient(error: Column) -> Column:
    """Worth another attempt: rate limits and content inspection, not failed requests."""
    return F.coalesce(F.startswith(error, F.lit("HTTP 429")) | F.contains(error, F.lit("data_inspection_failed")), F.lit(False))


def outcome(answer: Column, done: Column, has_sidecar: Column, merge_error: Column) -> Column:
    """struct<status, error> of one image, from its answer and what merging it would say."""
    parsed = parse_answer(answer["text"])
    refused = F.contains(merge_error, F.lit("already has"))

    def is_(status, error=None):
        return F.struct(F.lit(status).alias("status"), (F.lit(error) if error is None or isinstance(error, str) else error).cast("string").alias("error"))

    return (
        F.when(done, is_("skipped_done"))
        .when(answer["error"].isNotNull(), is_("error", answer["error"]))
        .when(answer["text"].isNull(), is_("error", SILENT))
        .when((parsed["description"] == "") | (F.size(parsed["keywords"]) == 0), is_("error", UNPARSED))
        .when(has_sidecar & merge_error.isNotNull() & refused, is_("skipped_has_subject", merge_error))
        .when(has_sidecar & merge_error.isNotNull(), is_("error", merge_error))
        .when(has_sidecar, is_("merged")).otherwise(is_("created"))
    )


def repair_outcome(answer: Column, glitched: Column, replace_error: Column) -> Column:
    """struct<status, error> of one repair: an answer that is still glitched is not written."""
    parsed = parse_answer(answer["text"])

    def is_(status, error=None):
        return F.struct(F.lit(status).alias("status"), (F.lit(error) if error is None or isinstance(error, str) else error).cast("string").alias("error"))

    return (
        F.when(answer["error"].isNotNull(), is_("error", answer["error"]))
        .when(answer["text"].isNull(), is_("error", SILENT))
        .when((parsed["description"] == "") | (F.size(parsed["keywords"]) == 0), is_("error", UNPARSED_REPAIR))
        .when(glitched, is_("still_glitched"))
        .when(replace_error.isNotNull(), is_("xmp_error", replace_error)).otherwise(is_("fixed"))
    )
