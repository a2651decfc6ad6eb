"""Reading and editing XMP sidecars as text.

Sidecars are never parsed into a tree and written back: that would lose comments,
spacing and foreign namespaces. Reading is regular expressions on a column;
editing is a function on one document's text, without side effects.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sidelight.functions.dates import date_chain
from sidelight.functions.text import let, strip
from sidelight.schemas import DATE, LOCATION

DC = "http://purl.org/dc/elements/1.1/"
TOOL = "sidelight"
# Log texts; what is said of a subject begins as ``answers.outcome`` looks for it.
HAS_SUBJECT = "already has a subject, left as it is"
NO_CLOSE = "its rdf:Description is never closed, left as it is"
NO_BLOCK = "holds no rdf:Description, left as it is"
NOT_THERE = "lacks a dc:subject or a dc:description to exchange"

# The elements and attributes that are read.
_DESCRIPTION = r"(?s)<dc:description>.*?<rdf:li[^>]*>(.*?)</rdf:li>"
_SUBJECT = r"(?s)<dc:subject>.*?</dc:subject>"
_ITEM = r"<rdf:li>(.*?)</rdf:li>"
_PERSON = r"(?s)<Iptc4xmpExt:PersonInImage\b(?:[^>]*/>|[^>]*>.*?</Iptc4xmpExt:PersonInImage>)"
_PLACE = r"(?s)<Iptc4xmpExt:LocationShown\b(?:[^>]*/>|[^>]*>.*?</Iptc4xmpExt:LocationShown>)"
_PLACE_NAME = r"(?s)<Iptc4xmpExt:LocationName>.*?<rdf:li[^>]*>(.*?)</rdf:li>"
_PREFIX = r"""xmlns:([A-Za-z_][\w.\-]*)\s*=\s*["']""" + re.escape(DC) + r"""["']"""


_TEXTS = ("description", "country", "city", "province", "name")
_LISTS = ("keywords", "people")


def _plain(values: pa.Array) -> pa.Array:
    """All HTML entities, named and numeric; only what holds an ampersand becomes a Python string."""
    found = pc.fill_null(pc.match_substring(values, "&"), False)
    if not pc.any(found).as_py():
        return values
    return pc.replace_with_mask(values, found, pa.array([html.unescape(x) for x in values.filter(found).to_pylist()], values.type))


def _plain_lists(lists: pa.ListArray) -> pa.ListArray:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    starts = pa.array(np.concatenate(([0], ends)), pa.int32())
    return pa.ListArray.from_arrays(starts, _plain(lists.flatten()), mask=lists.is_null())


@F.arrow_udf(StructType([StructField(c, StringType()) for c in _TEXTS] + [StructField(c, ArrayType(StringType())) for c in _LISTS]))
def unescaped(raw: pa.Array) -> pa.Array:
    """The entities in all fields of a sidecar at once; the JVM has no such function."""
    columns = {name: values for name, values in zip((f.name for f in raw.type), raw.flatten())}
    made = [_plain(columns[c]) for c in _TEXTS] + [_plain_lists(columns[c]) for c in _LISTS]
    return pa.StructArray.from_arrays(made, names=[*_TEXTS, *_LISTS])


def _strings() -> Column:
    return F.array().cast("array<string>")


def fields(content: Column) -> Column:
    """struct<description, country, city, province, name, keywords, people> of a sidecar.

    The first item of the description, null where there is none; bare items of the first subject, on one
    line each, not stripped; people that are not blank; the place's parts, empty strings where they are missing.
    """
    found = F.regexp_extract(content, _DESCRIPTION, 1)
    people = F.regexp_extract_all(F.regexp_extract(content, _PERSON, 0), F.lit(_ITEM), F.lit(1))
    place = F.transform(
        F.array(F.regexp_extract(content, _PLACE, 0)),
        lambda block: F.array(
            *(F.regexp_extract(block, f'Iptc4xmpExt:{name}="([^"]*)"', 1) for name in ("CountryName", "City", "ProvinceState")), F.regexp_extract(block, _PLACE_NAME, 1)
        ),
    )[0]
    raw = F.struct(
        # an empty match is told from none by a second look, which few need
        F.when((found != "") | F.regexp_like(content, F.lit(_DESCRIPTION)), found).alias("description"),
        *(place[k].alias(name) for k, name in enumerate(("country", "city", "province", "name"))),
        F.regexp_extract_all(F.regexp_extract(content, _SUBJECT, 0), F.lit(_ITEM), F.lit(1)).alias("keywords"),
        F.filter(people, lambda x: strip(x) != "").alias("people"),
    )
    return unescaped(raw)


def location_of(found: Column) -> Column:
    """country, city, province, name of ``fields``; null where all four are empty."""
    place = F.struct(*(found[k].alias(k) for k in ("country", "city", "province")), strip(found["name"]).alias("name"))
    return let(place, lambda p: F.when(F.concat(*(p[k] for k in ("country", "city", "province", "name"))) != "", p)).cast(LOCATION)


def stem_of(path: Column) -> Column:
    """The path without its last extension; a name that only starts with a dot has none."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def folders(path: Column, root: str) -> Column:
    """Folder names below ``root``; none for a path outside it."""
    base = root.rstrip("/") + "/"
    inside = let(F.split(F.substring(path, len(base) + 1, 1 << 30), "/"), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.when(F.startswith(path, F.lit(base)), inside).otherwise(_strings())


def folder_hint(path: Column, root: str) -> Column:
    """``2019 / Summer trip`` for a prompt; the root's name for files right in it, the parent's outside it."""
    base = root.rstrip("/")
    inside = F.startswith(path, F.lit(base + "/"))
    joined = F.array_join(folders(path, root), " / ")
    parent = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    return F.when(~inside, parent).when(joined == "", F.lit(base.rsplit("/", 1)[-1])).otherwise(joined)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(stem_of(path), r"([^/]*)$", 1)


def extracted(content: Column, path: Column, root: str) -> Column:
    """Everything of one sidecar as a struct; without a description all of it is empty."""

    def whole(found):
        has = found["description"].isNotNull()
        return F.struct(
            strip(found["description"]).alias("description"),
            F.when(has, found["keywords"]).otherwise(_strings()).alias("keywords"),
            F.when(has, F.transform(found["people"], strip)).otherwise(_strings()).alias("people"),
            F.when(has, location_of(found)).alias("location"),
            F.when(has, date_chain(content, file_stem(path), folders(path, root))).cast(DATE).alias("date"),
        )

    return let(fields(content), whole)


# --- what a document already holds -------------------------------------------------------------


def dc_prefixes(content: Column) -> Column:
    """Prefixes bound to the Dublin Core namespace, and always ``dc``."""
    return F.array_union(F.regexp_extract_all(content, F.lit("(?U)" + _PREFIX), F.lit(1)), F.array(F.lit("dc")))


def subject_present(content: Column) -> Column:
    return F.coalesce(F.exists(dc_prefixes(content), lambda p: F.regexp_like(content, F.concat(F.lit(r"(?U)<\Q"), p, F.lit(r"\E:subject\b")))), F.lit(False))


# --- writing -----------------------------------------------------------------------------------


def escaped(c: Column) -> Column:
    out = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def subject_xml(words: Column) -> Column:
    items = F.array_join(F.transform(words, lambda w: F.concat(F.lit("<rdf:li>"), escaped(w), F.lit("</rdf:li>"))), "")
    return F.concat(F.lit("<dc:subject><rdf:Bag>"), items, F.lit("</rdf:Bag></dc:subject>"))


def description_xml(text: Column) -> Column:
    return F.concat(F.lit('<dc:description><rdf:Alt><rdf:li xml:lang="x-default">'), escaped(text), F.lit("</rdf:li></rdf:Alt></dc:description>"))


def new_document(subject: Column, told: Column, model: str) -> Column:
    """A minimal sidecar for an image that had none."""
    toolkit = html.escape(f"{TOOL}/{model}", quote=False)
    start = (
        f'<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{toolkit}">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
        f'  <rdf:Description rdf:about=""\n    xmlns:dc="{DC}">\n   '
    )
    return F.concat(F.lit(start), subject, F.lit("\n   "), told, F.lit("\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n"))


def backup_name(path: Column) -> Column:
    """``<stem>__<digest>.xmp``: the same for a sidecar on every run."""
    return F.concat(file_stem(path), F.lit("__"), F.substring(F.sha1(path.cast("binary")), 1, 16), F.lit(".xmp"))


# The tags and attributes that an edit goes by.
_TAG = re.compile(r"<(/?)rdf:Description\b[^>]*?(/?)>", re.S)
_DECLARES = re.compile(r"xmlns:dc\s*=")
_BINDS = re.compile(_PREFIX)

Span = tuple[int, int, str]  # what stands from one place to another becomes a text


def outer_blocks(content: str) -> list[tuple[int, int, int | None]]:
    """(start, end of the opening tag, start of the closing tag or None) of each outermost block, in order."""
    found, stack = [], []
    for tag in _TAG.finditer(content):
        closing, empty = tag.groups()
        if closing:
            if stack:
                opened = stack.pop()
                if not stack:
                    found.append((opened.start(), opened.end(), tag.start()))
        elif not empty:
            stack.append(tag)
        elif not stack:
            found.append((tag.start(), tag.end(), None))
    return found


def _with(content: str, spans: list[Span]) -> str:
    """``content`` after all edits at once; spans do not overlap."""
    out, at = [], 0
    for start, end, text in sorted(spans):
        out += content[at:start], text
        at = end
    return "".join(out) + content[at:]


def _element(prefix: str, name: str) -> str:
    return rf"<{re.escape(prefix)}:{name}\b"


def _noise(content: str, prefixes: list[str]) -> tuple[list[Span], str]:
    """The first description under each prefix, as spans to take out, and the text with as many NULs in their place."""
    spans: list[Span] = []
    for p in prefixes:
        if met := re.search(rf"(?s)\s*{_element(p, 'description')}.*?</{re.escape(p)}:description>", content):
            spans = [x for x in spans if x[0] < met.start() or x[1] > met.end()] + [(*met.span(), "")]
            content = content[: met.start()] + "\0" * len(met[0]) + content[met.end() :]
    return spans, content


def merged_text(content: str, subject: str, told: str) -> tuple[str | None, str | None]:
    """(new text, None), or (None, why the document is left as it is).

    An old description goes: without a subject it is camera noise. The fields go
    into the block that declares ``dc``, else one that binds its namespace under
    another prefix, else the first; where ``dc`` is not declared it is.
    """
    prefixes = sorted({"dc", *_BINDS.findall(content)})
    if re.search("|".join(_element(p, "subject") for p in prefixes), content):
        return None, HAS_SUBJECT
    spans, bare = _noise(content, prefixes)
    blocks = outer_blocks(bare)
    if not blocks:
        return None, NO_CLOSE if re.search(r"<rdf:Description\b", bare) else NO_BLOCK
    declaring = [b for b in blocks if _DECLARES.search(bare, b[0], b[1])]
    binding = [b for b in blocks if _BINDS.search(bare, b[0], b[1])]
    _, end, close = (declaring or binding or blocks)[0]
    if not declaring and not _DECLARES.search(bare, 0, blocks[0][0]):
        at = end - (2 if close is None else 1)
        spans.append((at, at, f'\n    xmlns:dc="{DC}"'))
    if close is None:  # an empty element is opened
        spans.append((end - 2, end, f">\n   {subject}\n   {told}\n  </rdf:Description>"))
    else:
        spans.append((close, close, f"{subject}\n{told}\n"))
    return _with(content, spans), None


def replaced_text(content: str, subject: str, told: str) -> tuple[str | None, str | None]:
    """Exchanges the first bare subject and description, both of which must be there."""
    new = {"subject": subject, "description": told}
    if any(f"<dc:{name}>" not in content for name in new):
        return None, NOT_THERE
    for name, text in new.items():
        met = re.search(rf"(?s)<dc:{name}>.*?</dc:{name}>", content)
        if met is None:
            return None, f"its dc:{name} is never closed"
        content = _with(content, [(*met.span(), text)])
    return content, None


def _edited(edit):
    def run(content: pd.Series, subject: pd.Series, told: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edit(*x) if x[0] is not None else (None, None) for x in zip(content, subject, told)], columns=["content", "error"])

    run.__annotations__ = {"content": pd.Series, "subject": pd.Series, "told": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, StructType([StructField("content", StringType()), StructField("error", StringType())]))


merged = _edited(merged_text)
replaced = _edited(replaced_text)
