"""Queries over files of many formats: each row of a table is written as a file, and the readers bring its values back.

The writers are as small as a format allows; what they write is what the SQL expects to be read.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.plans.registry import query, table
from sparkfolio.session import ship_package
from sparkfolio.sources import detect, images, office, pdf, pdf_signals

RELATIONS = '<Relationships xmlns="urn:rel">{}</Relationships>'
WORD = 'xmlns:w="urn:w" xmlns:r="urn:r"'


def _pack(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            # the media type of a book is stored as it is, so that it can be read without unpacking
            archive.writestr(name, body, zipfile.ZIP_STORED if name == "mimetype" else None)
    return out.getvalue()


def _docx(name: str, address: str, phone: str) -> bytes:
    para = lambda text, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{escape(text)}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = para(name, '<w:pStyle w:val="H"/>') + para("About " + address) + "<w:tbl>" + row("field", "value") + row("phone", phone) + "</w:tbl>"
    return _pack(
        {
            "_rels/.rels": RELATIONS.format('<Relationship Id="a" Type="x/officeDocument" Target="word/document.xml"/>'),
            "word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>",
            "word/styles.xml": f'<w:styles {WORD}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>',
        }
    )


def _xlsx(name: str, address: str, phone: str) -> bytes:
    strings = ["name", "phone", "row", name, phone]
    cell = lambda at, n: f'<c r="{at}" t="s"><v>{n}</v></c>'
    sheet = f'<row>{cell("A1", 0)}{cell("B1", 1)}{cell("C1", 2)}</row><row>{cell("A2", 3)}{cell("B2", 4)}<c r="C2"><v>2.0</v></c></row>'
    return _pack(
        {
            "xl/workbook.xml": '<workbook xmlns="urn:s" xmlns:r="urn:r"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": RELATIONS.format('<Relationship Id="r1" Type="x/worksheet" Target="worksheets/s1.xml"/>'),
            "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
            "xl/worksheets/s1.xml": f"<worksheet><sheetData>{sheet}</sheetData></worksheet>",
        }
    )


def _pptx(name: str, address: str, phone: str) -> bytes:
    def shape(kind: str, text: str, y: int) -> str:
        holder = f'<nvPr><ph type="{kind}"/></nvPr>' if kind else ""
        return f'<sp>{holder}<off x="0" y="{y}"/><txBody><p><pPr lvl="0"/><r><t>{escape(text)}</t></r></p></txBody></sp>'

    return _pack(
        {
            "ppt/presentation.xml": '<presentation xmlns:r="http://x/r"><sldIdLst><sldId id="256" r:id="r1"/></sldIdLst></presentation>',
            "ppt/_rels/presentation.xml.rels": RELATIONS.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/>'),
            "ppt/slides/slide1.xml": "<sld><spTree>" + shape("", phone, 9_000_000) + shape("", address, 4_000_000) + shape("title", name, 100_000) + "</spTree></sld>",
            "ppt/slides/_rels/slide1.xml.rels": RELATIONS.format('<Relationship Id="n" Type="x/notesSlide" Target="../notesSlides/n1.xml"/>'),
            "ppt/notesSlides/n1.xml": "<notes><spTree>" + shape("body", "call " + phone, 0) + "</spTree></notes>",
        }
    )


def _epub(name: str, address: str, phone: str) -> bytes:
    return _pack(
        {
            "mimetype": "application/epub+zip",
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
            "O/p.opf": '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
            "O/a.xhtml": f"<html><body><p>{escape(address)}</p></body></html>",
            "O/b.xhtml": f"<html><body><h1>{escape(name)}</h1><p>{escape(phone)}</p></body></html>",
        }
    )


def _pdf(name: str, address: str, phone: str) -> bytes:
    line = lambda size, y, text: b"BT /F1 %d Tf 1 0 0 1 50 %d Tm (%s) Tj ET\n" % (size, y, text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)"))
    data = zlib.compress(line(20, 700, name) + line(10, 660, "Phone " + phone + " and") + line(10, 648, "more of it.") + line(10, 600, "Second paragraph."))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 6 0 R /PageLabels << /Nums [0 << /S /r /St 3 >>] >> >>",
        b"<< /Type /Pages /Count 1 /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Kids [4 0 R] >>",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [" + b" ".join([b"500"] * 95) + b"] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data),
        b"<< /First 7 0 R >>",
        b"<< /Title (%s) /First 8 0 R >>" % name.encode("ascii", "replace"),
        b"<< /Title (Inner) >>",
    ]
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1))
    return b"%PDF-1.7\n" + body + b"trailer << /Root 1 0 R >>\n%%EOF"


WRITERS: dict[str, Callable[[str, str, str], bytes]] = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "epub": _epub, "pdf": _pdf}


def _files(spark, d, kind: str) -> DataFrame:
    """(path, format, content): one file for each supplier. Its path has no extension, so that only the content tells the format."""
    ship_package(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [WRITERS[kind](*row) for row in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["path", "content"])

    named = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_name", F.concat(F.lit("Lane "), F.col("s_nationkey").cast("string")).alias("a"), F.format_string("%05d", "s_suppkey").alias("p"))
    files = named.mapInArrow(write, "path string, content binary")
    return files.withColumn("format", detect.detect(F.col("path"), F.col("content")))


def _read(spark, d, kind: str) -> DataFrame:
    return office.convert(_files(spark, d, kind)).select(F.col("path").cast("long").alias("s_suppkey"), "number", "label", "markdown", "error")


_S = "WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name AS n, 'Lane ' || s_nationkey AS a, printf('%05d', s_suppkey) AS p FROM supplier)"


@query(f"""{_S} SELECT s_suppkey, 1 AS number, 'document' AS label, '# ' || n || chr(10) || chr(10) || 'About ' || a || chr(10) || chr(10) || '|field|value|' || chr(10) || '|---|---|' || chr(10) || '|phone|' || p || '|' AS markdown,
    CAST(NULL AS VARCHAR) AS error FROM s""")
def read_docx(spark, d):
    return _read(spark, d, "docx")


@query(f"""{_S} SELECT s_suppkey, 1 AS number, 'Data' AS label, '## Data' || chr(10) || chr(10) || '|name|phone|row|' || chr(10) || '|---|---|---|' || chr(10) || '|' || n || '|' || p || '|2|' AS markdown,
    CAST(NULL AS VARCHAR) AS error FROM s""")
def read_xlsx(spark, d):
    return _read(spark, d, "xlsx")


@query(f"""{_S} SELECT s_suppkey, 1 AS number, 'slide 1' AS label, '# ' || n || chr(10) || chr(10) || '- ' || a || chr(10) || chr(10) || '- ' || p || chr(10) || chr(10) || '> call ' || p AS markdown,
    CAST(NULL AS VARCHAR) AS error FROM s""")
def read_pptx(spark, d):
    return _read(spark, d, "pptx")


@query(f"""{_S} SELECT s_suppkey, 1 AS number, 'chapter 1: ' || n AS label, '# ' || n || chr(10) || chr(10) || p AS markdown, CAST(NULL AS VARCHAR) AS error FROM s
    UNION ALL SELECT s_suppkey, 2, 'chapter 2', a, NULL FROM s""")
def read_epub(spark, d):
    return _read(spark, d, "epub")


@query(f"""{_S} SELECT s_suppkey, 1 AS number, 'page 1' AS label, '# ' || n || chr(10) || chr(10) || 'Phone ' || p || ' and more of it.' || chr(10) || chr(10) || 'Second paragraph.' AS markdown,
    CAST(NULL AS VARCHAR) AS error FROM s""")
def read_pdf(spark, d):
    return _read(spark, d, "pdf")


@query(f"""{_S}, l AS (SELECT s_suppkey, 1 AS item, n AS text, 700 AS bottom, 20 AS size FROM s UNION ALL SELECT s_suppkey, 2, 'Phone ' || p || ' and', 660, 10 FROM s
      UNION ALL SELECT s_suppkey, 3, 'more of it.', 648, 10 FROM s UNION ALL SELECT s_suppkey, 4, 'Second paragraph.', 600, 10 FROM s)
    SELECT s_suppkey, item, text, 50 AS "left", bottom, CAST(round(50 + length(text) * size / 2) AS INTEGER) AS "right", bottom + size AS top FROM l""")
def pdf_lines(spark, d):
    """Positioned lines of the PDF files."""
    found = pdf.items(_files(spark, d, "pdf"))
    return found.select(F.col("path").cast("long").alias("s_suppkey"), "item", "text", *(F.round(c).cast("int").alias(c) for c in ("left", "bottom", "right", "top")))


@query(f"{_S} SELECT s_suppkey, 0 AS depth, n AS title FROM s UNION ALL SELECT s_suppkey, 1, 'Inner' FROM s")
def pdf_outlines(spark, d):
    return pdf_signals.signals(_files(spark, d, "pdf"), "outline").select(F.col("path").cast("long").alias("s_suppkey"), "depth", "title")


@query(f"{_S} SELECT s_suppkey, 1 AS page, 'iii' AS label FROM s")
def pdf_labels(spark, d):
    return pdf_signals.signals(_files(spark, d, "pdf"), "labels").select(F.col("path").cast("long").alias("s_suppkey"), "page", "label")


@query(f"{_S} SELECT s_suppkey, false AS structure, false AS form, false AS annotations, false AS attachments, true AS outline, true AS labels, false AS encrypted FROM s")
def pdf_presence(spark, d):
    return pdf_signals.presence(_files(spark, d, "pdf")).withColumnRenamed("path", "s_suppkey").withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query(f"""{_S} SELECT s_suppkey, format FROM s, (VALUES ('docx'), ('xlsx'), ('pptx'), ('epub'), ('pdf')) AS v(format)""")
def src_sniff_content(spark, d):
    """Formats told by content alone, as the paths have no extension."""
    found = [_files(spark, d, kind).select("path", "format") for kind in WRITERS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("path").cast("long").alias("s_suppkey"), "format")


def _delimited(spark, d, mark: str, kind: str) -> DataFrame:
    text = F.concat(F.lit(f"key{mark}name{mark}note\n"), F.col("c_custkey").cast("string"), F.lit(f'{mark}"'), F.col("c_name"), F.lit(f', ""Ltd"""{mark}a|b\n'))
    files = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit(kind).alias("format"), F.encode(text, "UTF-8").alias("content"))
    return office.convert(files).select(F.col("path").cast("long").alias("c_custkey"), "number", "markdown", "error")


_DELIMITED = """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 1 AS number, '|key|name|note|' || chr(10) || '|---|---|---|' || chr(10) || '|' || c_custkey || '|' || c_name || ', "Ltd"|a\\|b|' AS markdown,
    CAST(NULL AS VARCHAR) AS error FROM customer"""


@query(_DELIMITED)
def read_csv(spark, d):
    return _delimited(spark, d, ",", "csv")


@query(_DELIMITED)
def read_tsv(spark, d):
    return _delimited(spark, d, "\t", "tsv")


@query("SELECT doc_id, v.mark, md5(coalesce(text, '')) AS markdown FROM documents, (VALUES ('utf-8'), ('utf-16-le'), ('utf-16-be')) AS v(mark)")
def read_marked_text(spark, d):
    """Whole texts in three encodings with byte order marks."""
    text = F.coalesce("text", F.lit(""))
    kinds = [("utf-8", "EFBBBF", "UTF-8"), ("utf-16-le", "FFFE", "UTF-16LE"), ("utf-16-be", "FEFF", "UTF-16BE")]
    made = F.array(*[F.struct(F.lit(name).alias("mark"), F.concat(F.unhex(F.lit(bom)), F.encode(text, codec)).alias("content")) for name, bom, codec in kinds])
    rows = table(spark, d, "documents").select(F.col("doc_id"), F.explode(made).alias("f"))
    files = rows.select(F.concat_ws("/", F.col("doc_id").cast("string"), "f.mark").alias("path"), F.lit("text").alias("format"), F.col("f.content").alias("content"))
    place = F.split("path", "/")
    return office.convert(files).select(place[0].cast("long").alias("doc_id"), place[1].alias("mark"), F.md5("markdown").alias("markdown"))


def _little(n: Column) -> Column:
    """A number below 65536 as two bytes, the low one first."""
    return F.unhex(F.format_string("%02X%02X", n % 256, F.floor(n / 256)))


@query("""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, kind, CAST(p_size * 7 AS INTEGER) AS width, CAST(p_partkey % 60000 AS INTEGER) AS height, p_size * 7 < 48 OR p_partkey % 60000 < 48 AS small
    FROM part, (VALUES ('gif'), ('bmp')) AS v(kind)""")
def image_facts(spark, d):
    """Kinds and sizes from the headers of images."""
    width, height = (F.col("p_size") * 7).cast("int"), (F.col("p_partkey") % 60_000).cast("int")
    gif = F.concat(F.encode(F.lit("GIF89a"), "UTF-8"), _little(width), _little(height))
    bmp = F.concat(F.encode(F.lit("BM"), "UTF-8"), F.unhex(F.lit("00" * 16)), _little(width), F.unhex(F.lit("0000")), _little(height), F.unhex(F.lit("0000")))
    files = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.explode(F.array(gif, bmp)).alias("content"))
    found = images.facts(files)
    return found.select(F.col("path").cast("long").alias("p_partkey"), "kind", "width", "height", images.decorative(F.col("width"), F.col("height")).alias("small"))
