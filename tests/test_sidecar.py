from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sidelight.functions import sidecar

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SUBJECT, TOLD = "<dc:subject><rdf:Bag><rdf:li>a</rdf:li></rdf:Bag></dc:subject>", '<dc:description><rdf:Alt><rdf:li xml:lang="x-default">told</rdf:li></rdf:Alt></dc:description>'


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def document(*blocks, outer=""):
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/" {outer}><rdf:RDF xmlns:rdf="{RDF}" xmlns:i="i:">' + "\n ".join(blocks) + "</rdf:RDF></x:xmpmeta>"


def merge(content):
    text, error = sidecar.merged_text(content, SUBJECT, TOLD)
    if text is not None:
        root = ElementTree.fromstring(text)
        assert len(list(root.iter(f"{{{sidecar.DC}}}subject"))) == len(list(root.iter(f"{{{sidecar.DC}}}description"))) == 1
    return text, error


DC_ATTR = f'xmlns:dc="{sidecar.DC}"'


@pytest.mark.parametrize("blocks, outer, where", [
    ([f"<rdf:Description {DC_ATTR}><i:a/></rdf:Description>"], "", 0),
    (["<rdf:Description><i:a/></rdf:Description>"], "", 0),
    (['<rdf:Description rdf:about=""/>'], "", 0),
    ([f'<rdf:Description {DC_ATTR} rdf:about=""/>'], "", 0),
    (["<rdf:Description><i:a><rdf:Description><i:b/></rdf:Description></i:a></rdf:Description>"], "", 0),
    ([f"<rdf:Description {DC_ATTR}><i:a/></rdf:Description>", "<rdf:Description><i:b/></rdf:Description>"], "", 0),
    (["<rdf:Description><i:a/></rdf:Description>", "<rdf:Description/>", f"<rdf:Description {DC_ATTR}><i:b/></rdf:Description>"], "", 2),
    (["<rdf:Description><i:a/></rdf:Description>", "<rdf:Description><i:b/></rdf:Description>"], "", 0),
    (["<rdf:Description><i:a/></rdf:Description>", f'<rdf:Description xmlns:d="{sidecar.DC}"><d:title/></rdf:Description>'], "", 1),
    (["<rdf:Description><i:a/></rdf:Description>"], DC_ATTR, 0),
])
def test_fields_go_into_the_right_block(blocks, outer, where):
    text, error = merge(document(*blocks, outer=outer))
    assert error is None
    top = [e for e in ElementTree.fromstring(text).find(f"{{{RDF}}}RDF")]
    assert [e.find(f"{{{sidecar.DC}}}subject") is not None for e in top] == [k == where for k in range(len(blocks))]
    if outer:
        assert text.count("xmlns:dc") == 1


def test_noise_goes_and_foreign_fields_stay():
    text, _ = merge(document(f'<rdf:Description {DC_ATTR} xmlns:d="{sidecar.DC}">\n  <dc:description><i:n>noise</i:n></dc:description><i:keep>k</i:keep> <d:description>more</d:description></rdf:Description>'))
    assert "noise" not in text and "more" not in text and "<i:keep>k</i:keep>" in text


@pytest.mark.parametrize("content, error", [
    (document(f"<rdf:Description {DC_ATTR}><dc:subject/></rdf:Description>"), sidecar.HAS_SUBJECT),
    (document(f'<rdf:Description xmlns:d="{sidecar.DC}"><d:subject/></rdf:Description>'), sidecar.HAS_SUBJECT),
    ("<x/>", sidecar.NO_BLOCK), ("<rdf:Description><i:a>", sidecar.NO_CLOSE),
])
def test_refusals(content, error):
    assert sidecar.merged_text(content, SUBJECT, TOLD) == (None, error)


def test_a_description_inside_another_goes_with_it():
    inner = "<d:description>in</d:description>"
    text, error = merge(document(f'<rdf:Description {DC_ATTR} xmlns:d="{sidecar.DC}"><dc:description>x {inner}</dc:description><i:k/></rdf:Description>'))
    assert error is None and "in</d" not in text and "<i:k/>" in text


def test_replace():
    text, error = sidecar.replaced_text("<dc:subject>x</dc:subject>-<dc:description>y</dc:description>-<dc:subject>z</dc:subject>", "\\1<s>", "\\g<0>")
    assert (text, error) == ("\\1<s>-\\g<0>-<dc:subject>z</dc:subject>", None)
    assert sidecar.replaced_text("<dc:subject>x</dc:subject>", "", "") == (None, sidecar.NOT_THERE)
    assert sidecar.replaced_text("<dc:subject>x<dc:description>y</dc:description>", "", "")[1] == "its dc:subject is never closed"


@pytest.mark.parametrize("content, want", [
    (f"<dc:subject/>", True), (f'<r xmlns:q.1="{sidecar.DC}"><q.1:subject/></r>', True), ("<dc:subjectMatter/>", False), (f'<r xmlns:q="{sidecar.DC}"><p:subject/></r>', False), (None, False),
])
def test_subject_present(spark, content, want):
    assert one(spark, sidecar.subject_present(F.lit(content).cast("string"))) is want


FULL = """<rdf:Description xmp:CreateDate="2019-02-03T00:00">
<dc:description><rdf:Alt><rdf:li xml:lang="x-default"> Tom &amp; Jerry &lt;3 </rdf:li></rdf:Alt></dc:description>
<dc:subject><rdf:Bag><rdf:li>cat</rdf:li> <rdf:li>Fish &amp; chips</rdf:li></rdf:Bag></dc:subject>
<Iptc4xmpExt:PersonInImage rdf:x="y"><rdf:Bag><rdf:li> Anna </rdf:li><rdf:li> </rdf:li><rdf:li>Boris</rdf:li></rdf:Bag></Iptc4xmpExt:PersonInImage>
<Iptc4xmpExt:LocationShown Iptc4xmpExt:CountryName="Austria" Iptc4xmpExt:City="Vienna" Iptc4xmpExt:ProvinceState=""><Iptc4xmpExt:LocationName><rdf:Alt><rdf:li xml:lang="x"> Caf&eacute; </rdf:li></rdf:Alt></Iptc4xmpExt:LocationName></Iptc4xmpExt:LocationShown>
</rdf:Description>"""


def test_full_record(spark):
    x = one(spark, sidecar.extracted(F.lit(FULL), F.lit("/r/a.jpg"), "/r"))
    assert (x.description, x.keywords, x.people) == ("Tom & Jerry <3", ["cat", "Fish & chips"], ["Anna", "Boris"])
    assert tuple(x.location) == ("Austria", "Vienna", "", "Café") and tuple(x.date) == (2019, 2, 3, "exif")


def test_without_description_all_is_empty(spark):
    x = one(spark, sidecar.extracted(F.lit(FULL.replace("dc:description", "dc:other")), F.lit("/r/a.jpg"), "/r"))
    assert (x.description, x.keywords, x.people, x.location, x.date) == (None, [], [], None, None)


@pytest.mark.parametrize("block, want", [
    ('<Iptc4xmpExt:LocationShown Iptc4xmpExt:City="Rome" />', ("", "Rome", "", "")), ("<Iptc4xmpExt:LocationShown></Iptc4xmpExt:LocationShown>", None), ("", None),
])
def test_location_forms(spark, block, want):
    x = one(spark, sidecar.location_of(sidecar.fields(F.lit(block))))
    assert (None if x is None else tuple(x)) == want


def test_created_document_is_read_back(spark):
    made = sidecar.new_document(sidecar.subject_xml(F.array(F.lit("a&b"), F.lit("c"))), sidecar.description_xml(F.lit("x < y")), "some/model")
    content = one(spark, made)
    ElementTree.fromstring(content)
    x = one(spark, sidecar.extracted(F.lit(content), F.lit("/r/a.jpg"), "/r"))
    assert (x.description, x.keywords) == ("x < y", ["a&b", "c"])


@pytest.mark.parametrize("path, hint, stem", [("/r/2019/Summer trip/IMG.jpg", "2019 / Summer trip", "IMG"), ("/r/IMG.x.jpg", "r", "IMG.x"), ("/other/deep/a.jpg", "deep", "a"), ("/r/.hid", "r", ".hid")])
def test_hints_and_stems(spark, path, hint, stem):
    assert one(spark, sidecar.folder_hint(F.lit(path), "/r/")) == hint
    assert one(spark, sidecar.file_stem(F.lit(path))) == stem


def test_entities_in_all_fields_and_lists(spark):
    kinds = "description string, country string, city string, province string, name string, keywords array<string>, people array<string>"
    rows = [("&lt;a&gt; &amp;lt; &eacute;&#233; &amp", None, "", "b", "&quot;", ["x", "&amp;", None], None), (None, "c", "&nope;", None, "d", [], ["&#x41;"])]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, raw struct<{kinds}>").coalesce(1)
    got = [tuple(r.x) for r in df.select("i", sidecar.unescaped("raw").alias("x")).orderBy("i").collect()]
    assert got == [("<a> &lt; éé &", None, "", "b", '"', ["x", "&", None], None), (None, "c", "&nope;", None, "d", [], ["A"])]
