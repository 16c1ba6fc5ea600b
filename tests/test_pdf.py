"""PDF files built by hand, and text that survives damage."""

import random
import zlib

import pytest

from sparkfolio.sources import office, pdf


def build(pages, compress=True, info=True, outline=False, as_objstm=False):
    """A PDF of pages, each a list of (size, x, y, text)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R" + (b" /Outlines 20 0 R" if outline else b"") + b" >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [" + b" ".join([b"500"] * 95) + b"] >>"}
    kids = []
    for k, lines in enumerate(pages):
        body = b"".join(b"BT /F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET\n" % (s, x, y, t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")) for s, x, y, t in lines)
        data = zlib.compress(body) if compress else body
        objects[100 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (101 + 2 * k)
        objects[101 + 2 * k] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if compress else b"", data)
        kids.append(b"%d 0 R" % (100 + 2 * k))
    objects[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Kids [%s] >>" % (len(pages), b" ".join(kids))
    if info:
        objects[4] = b"<< /Title (A \\(test\\)) /Author <FEFF00C9006C> >>"
    if outline:
        objects[20] = b"<< /First 21 0 R >>"
        objects[21] = b"<< /Title (One) /First 22 0 R /Next 23 0 R >>"
        objects[22] = b"<< /Title (Inner) >>"
        objects[23] = b"<< /Title (Two) /Next 21 0 R >>"
    if as_objstm:
        inner = {n: objects.pop(n) for n in (1, 2, 3)}
        body, heads = b"", []
        for n, v in inner.items():
            heads += [n, len(body)]
            body += v + b" "
        head = " ".join(map(str, heads)).encode() + b" "
        data = zlib.compress(head + body)
        objects[50] = b"<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(head), len(data), data)
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, v) for n, v in objects.items())
    return out + b"trailer << /Root 1 0 R%s >>\n%%%%EOF" % (b" /Info 4 0 R" if info else b"")


def test_text_headings_and_paragraphs():
    page = [(20, 50, 700, "A Big Title"), (10, 50, 660, "First line of a para-"), (10, 50, 648, "graph (joined) here."), (10, 50, 600, "• item one"), (10, 50, 560, "Last.")]
    for options in ({}, {"compress": False}, {"as_objstm": True}):
        assert pdf.convert_bytes(build([page], **options)) == [("page 1", "# A Big Title\n\nFirst line of a paragraph (joined) here.\n\n- item one\n\nLast.")]
    assert office.convert_bytes("pdf", build([page]))[0][0] == "page 1"


def test_columns_and_margins():
    body = [(10, 50, 700 - 12 * k, f"left {k}") for k in range(12)] + [(10, 350, 700 - 12 * k, f"right {k}") for k in range(12)]
    pages = [[*body, (8, 250, 760, "Journal of Things"), (8, 300, 30, f"Page {n}")] for n in range(1, 5)]
    text = pdf.convert_bytes(build(pages))[0][1]
    assert "Journal" not in text and "Page" not in text
    assert text.index("left 11") < text.index("right 0")


def test_info_and_outline():
    file = pdf.File(build([[(10, 0, 0, "x")]], outline=True))
    assert file.info() == {"title": "A (test)", "author": "Él"}
    assert file.outline() == [(0, "One"), (1, "Inner"), (0, "Two")]


def test_unicode_map_and_glyph_names():
    width, table = pdf._unicode_map(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0062> <D83DDE00>] endbfrange")
    assert width == 2 and table[3] == "A" and table[0x11] == "b" and table[0x21] == "😀"
    assert [pdf.glyph_text(x) for x in ("A", "uni00E9", "eacute", "seven", "endash", "nosuch")] == ["A", "é", "é", "7", "–", ""]


def test_predictor():
    rows = [[1, 2, 3], [4, 6, 9]]
    up = bytes([2, *rows[0]]) + bytes([2, *[b - a for a, b in zip(*rows, strict=True)]])
    assert pdf._predict(up, {"Predictor": 12, "Columns": 3}) == bytes(rows[0] + rows[1])


def test_damage_is_an_error_or_less_text_never_a_hang():
    good = build([[(10, 50, 700, "word " * 20)]] * 3)
    rng = random.Random(7)
    for _ in range(60):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 12)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            pdf.convert_bytes(bytes(bad[: rng.randrange(10, len(bad))]))
        except Exception as e:
            assert not isinstance(e, (MemoryError, RecursionError)), e
    with pytest.raises(ValueError):
        pdf.File(b"no")
    with pytest.raises(ValueError):
        pdf.File(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))


def test_items(spark):
    files = spark.createDataFrame([("a.pdf", build([[(10, 50, 700, "hello")]])), ("b.pdf", b"broken")], "path string, content binary")
    rows = {r["path"]: r for r in pdf.items(files).collect()}
    a = rows["a.pdf"]
    assert (a["page"], a["text"], a["left"], a["bottom"], a["right"], a["top"], a["size"]) == (1, "hello", 50.0, 700.0, 75.0, 710.0, 10.0)
    assert rows["b.pdf"]["error"]


def with_signals():
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [10 0 R] >> /PageLabels << /Nums [0 << /S /r >> 2 << /S /D /P (A-) /St 5 >>] >> /MarkInfo << /Marked true >> /StructTreeRoot 30 0 R /Names << /EmbeddedFiles << /Names [(n) 40 0 R] >> >> >>",
        2: b"<< /Type /Pages /MediaBox [0 0 600 800] /Kids [3 0 R 4 0 R 5 0 R] >>",
        3: b"<< /Type /Page /Parent 2 0 R /CropBox [10 10 700 790] /Rotate 450 /Annots [20 0 R 21 0 R] /Resources << /XObject << /I1 22 0 R >> >> >>",
        4: b"<< /Type /Page /Parent 2 0 R >>", 5: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] /UserUnit 2 >>",
        10: b"<< /T (form) /FT /Tx /Kids [11 0 R 12 0 R] >>", 11: b"<< /T (a) /V (one) /Rect [1 2 3 4] >>", 12: b"<< /T (b) /FT /Btn /V /Yes >>",
        20: b"<< /Subtype /Link /Rect [5 6 1 2] /A << /URI (http://h/) >> >>", 21: b"<< /Subtype /Link /A << /URI (javascript:x) >> /Contents (note) >>",
        22: b"<< /Subtype /Image /Width 3 /Height 4 >>", 30: b"<< /K [31 0 R 31 0 R] >>", 31: b"<< /S /H1 /K << /S /P >> >>",
        40: b"<< /UF (dir/x.txt) /EF << /F 41 0 R >> >>", 41: b"<< /Length 3 >>\nstream\nabc\nendstream",
    }
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, v) for n, v in objects.items()) + b"trailer << /Root 1 0 R >>"


def test_signals(spark):
    from sparkfolio.sources import pdf_signals as ps

    file = pdf.File(with_signals())
    assert [(g["box"], g["rotation"], g["user_unit"]) for g in ps.page_geometry(file)] == [((10.0, 10.0, 600.0, 790.0), 90, 1.0), ((0.0, 0.0, 600.0, 800.0), 0, 1.0), ((0.0, 0.0, 100.0, 100.0), 0, 2.0)]
    assert [(a["url"], a["unsafe"], a["contents"], a["box"]) for a in ps.annotations(file)] == [("http://h/", False, None, (1.0, 2.0, 5.0, 6.0)), ("javascript:x", True, "note", None)]
    assert ps.page_labels(file) == ["i", "ii", "A-5"]
    assert [(f["name"], f["kind"], f["value"]) for f in ps.form_fields(file)] == [("form.a", "text", "one"), ("form.b", "button", "Yes")]
    assert [(a["name"], a["size"]) for a in ps.attachments(file)] == [("x.txt", 3)]
    assert ps.structure(file) == {"tagged": True, "has_tree": True, "roles": {"H1": 1, "P": 1}}
    assert [(i["page"], i["width"], i["height"]) for i in ps.image_signals(file)] == [(1, 3, 4)]
    assert ps.permissions(0b100100) == ["print", "modify_annotations"] and not ps.linearized(with_signals())
    files = spark.createDataFrame([("a.pdf", with_signals()), ("b.pdf", b"broken")], "path string, content binary")
    for kind in ps._KINDS:
        rows = ps.signals(files, kind).collect()
        assert any(r["path"] == "a.pdf" for r in rows) or kind == "outline"
        assert [r["path"] for r in rows if r["error"]] == ["b.pdf"]
    assert ps.presence(files).filter("structure AND form AND attachments AND labels AND NOT encrypted").count() == 1
