import base64
import zlib

import numpy as np
import pytest

from lectern.__main__ import main, pages_between
from lectern.functions.preprocess import isolate_text
from lectern.settings import Settings, expand, save
from lectern.sources.parsers import Section, parse_bytes, pdf, pdfobjects


def make(contents: list[bytes], fonts: bytes = b"<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >>", labels: bytes = b"", filters: bytes = b"", more: list[bytes] = []) -> bytes:
    n = len(contents)
    objects = [b"<< /Type /Catalog /Pages 2 0 R " + labels + b" >>", b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font %s >> >>" % (n, b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(n)), fonts)]
    for k, c in enumerate(contents):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * k))
        objects.append(b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(c), filters, c))
    objects += more
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + b"trailer << /Root 1 0 R /Info << /Title (My \\050T\\051) >> >>\n%%EOF"


def lines(*rows):
    return b"BT " + b" ".join(b"/F1 %d Tf 1 0 0 1 %d %d Tm (%s) Tj" % (s, x, y, t) for s, x, y, t in rows) + b" ET"


PAGE = lines((24, 72, 700, b"Big Heading"), (12, 72, 670, b"first line of the body"), (12, 72, 656, b"and the second line"), (12, 72, 642, b"then the third"), (12, 72, 628, b"and a fourth"), (12, 72, 614, b"with hyphen-"), (12, 72, 600, b"ation done"), (12, 72, 550, b"a new paragraph"))


def test_headings_and_paragraphs():
    d = pdf.parse(make([PAGE]))
    assert d.title == "My (T)"
    assert [(s.level, s.heading, s.page_physical) for s in d.sections] == [(1, "Big Heading", 1)]
    assert d.sections[0].content == "first line of the body and the second line then the third and a fourth with hyphenation done\na new paragraph"


@pytest.mark.parametrize("name,data", [(b"/FlateDecode", zlib.compress(PAGE)), (b"/ASCII85Decode", base64.a85encode(PAGE) + b"~>"), (b"/ASCIIHexDecode", PAGE.hex().encode() + b">"), (b"[/ASCII85Decode /FlateDecode]", base64.a85encode(zlib.compress(PAGE)) + b"~>")])
def test_filters(name, data):
    assert pdf.parse(make([data], filters=b"/Filter " + name)).sections[0].heading == "Big Heading"


def test_predictors_and_lzw():
    rows = np.arange(24, dtype=np.uint8).reshape(4, 6) * 9
    coded = b""
    for i, row in enumerate(rows.astype(int)):
        up = rows[i - 1].astype(int) if i else np.zeros(6, int)
        coded += bytes([2]) + bytes(((row - up) % 256).astype(np.uint8))
    assert pdfobjects.unpredict(coded, {"Predictor": 12, "Columns": 6}) == rows.tobytes()
    # 256, then "-----A---B" as in the PDF specification's example, 257
    codes, bits = [256, 45, 258, 258, 65, 259, 66, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert pdfobjects.lzw(raw) == b"-----A---B"


def test_two_columns():
    rows = [(12, 72, 700 - 14 * k, b"left words %d" % k) for k in range(15)] + [(12, 320, 700 - 14 * k, b"right words %d" % k) for k in range(15)]
    text = pdf.parse(make([lines(*sorted(rows, key=lambda r: -r[2]))])).sections[0].content
    assert text.index("left words 14") < text.index("right words 0")


def test_labels_and_tj():
    labels = b"/PageLabels << /Nums [0 << /S /r >> 1 << /S /D /St 42 >>] >>"
    d = pdf.parse(make([b"BT /F1 12 Tf [(Hel) -50 (lo) -300 (world)] TJ ET", lines((12, 72, 700, b"next page text"))], labels=labels))
    assert d.sections[0].content == "Hello world"
    assert [(s.page_physical, s.page_logical, s.page_section, s.page_roman) for s in d.sections] == [(1, 1, 1, True), (2, 42, 2, False)]


def test_to_unicode_and_differences():
    fonts = b"<< /F1 << /Type /Font /Encoding << /Differences [1 /fi /eacute /uni20AC] >> >> >>"
    assert pdf.parse(make([b"BT /F1 12 Tf <0141020342> Tj ET"], fonts)).sections[0].content == "fiAé€B"
    m = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00660066> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    assert pdf.cmap(m) == ({1: "ff", 2: "a", 3: "b", 4: "c"}, 2)


def test_object_stream():
    inner = b"5 0 << /Type /Page /Parent 2 0 R /Contents 4 0 R >>"
    data = zlib.compress(inner)
    raw = make([PAGE]).replace(b"/Kids [3 0 R]", b"/Kids [5 0 R]").replace(b"trailer", b"9 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\ntrailer" % (len(data), data))
    assert pdf.parse(raw).sections[0].heading == "Big Heading"


def test_broken_files_are_empty():
    assert parse_bytes("pdf", b"junk").sections == [] and parse_bytes("pdf", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog").error is None


def test_isolate_text():
    page = np.full((12, 12, 3), 200, np.uint8)
    page[5, 5] = 10
    out = np.frombuffer(isolate_text(page.tobytes(), 12, 12, 3), np.uint8).reshape(12, 12, 3)
    assert (out[2:9, 2:9] == page[2:9, 2:9]).all() and (out[0] == 255).all() and (out[:, 9:] == 255).all()
    with pytest.raises(ValueError):
        isolate_text(b"12", 1, 1, 3)


def test_settings(tmp_path):
    env = {"A": "x", "E": "", "LECTERN_SEARCH_LIMIT": "7"}
    assert [expand(t, env) for t in ("$A", "${A}y", "$$A", "${B:-d}", "${E:-d}", "${E-d}", "${B-${A}}", "$B")] == ["x", "xy", "$A", "d", "d", "", "x", ""]
    (tmp_path / "p.ini").write_text("[search]\nlimit = 3\nmode = $A\n")
    s = Settings({"index.path": "i"}, env, tmp_path / "p.ini")
    assert (s.get("search.limit"), s.get("search.mode"), s.get("index.path"), s.source("search.mode"), s.source("chunk.max_tokens")) == ("7", "x", "i", "project", "default")
    save(tmp_path / "s.ini", {"search.limit": "3"})
    assert "limit = 3" in (tmp_path / "s.ini").read_text() and "# mode = hybrid" in (tmp_path / "s.ini").read_text()


def test_extract(tmp_path, capsys):
    (tmp_path / "a.md").write_text("# One\ntext\n# Two\nmore\n# Three\nend\n")
    assert main(["extract", str(tmp_path / "a.md"), "--from-page", "2"]) == 0
    assert capsys.readouterr().out == "Two\nmore\nThree\nend\n"
    assert main(["extract", str(tmp_path / "a.md"), "--as", "markdown", "--to-page", "1"]) == 0
    assert capsys.readouterr().out == "# One\n\ntext\n"
    assert [s.heading for s in pages_between([Section(1, "a"), Section(2, "b", parent=0), Section(1, "c")], 2, None)] == ["c"]
