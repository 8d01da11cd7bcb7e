"""Text of PDF files that the tests write: pages, fonts, maps, object streams, and damage."""

import random
import zlib

import pytest

from loomwork.plans import uploads
from loomwork.sources import pages
from loomwork.sources.pdf import File, Lexer, Ref, glyph, pdf_text, unicode_map
from tests.oracles import same_as_sql

LINES = ["Scheme Name: Mahila Samridhi (phase 2)", "Interest rate: 4.5 %", "Maximum loan: Rs. 1,40,000", "Back\\slash and (nested (round)) brackets"]


def shown(text: str) -> bytes:
    return b"(" + text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def stream(data: bytes, packed: bool = True, more: bytes = b"") -> bytes:
    data = zlib.compress(data) if packed else data
    return b"<</Length %d%s%s>>\nstream\n%s\nendstream" % (len(data), b"/Filter/FlateDecode" if packed else b"", more, data)


def pdf(contents: list[bytes], font: bytes = b"<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>", extra: dict[int, bytes] | None = None, packed: bool = True) -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]/Count %d/Resources<</Font<</F1 3 0 R>>>>>>" % (kids, len(contents)), 3: font} | (extra or {})
    for i, c in enumerate(contents):
        objects |= {10 + 2 * i: b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * i), 11 + 2 * i: stream(c, packed)}
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for n, body in sorted(objects.items(), reverse=True):
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % places.get(n, 0) for n in range(max(objects) + 1))
    return bytes(out) + b"xref\n0 %d\n%strailer<</Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (max(objects) + 1, table, len(out))


def page(lines: list[str]) -> bytes:
    return b"BT /F1 12 Tf 14 TL 72 720 Td " + b" ".join(shown(x) + b" Tj T*" for x in lines) + b" ET"


@pytest.mark.parametrize("packed", [True, False])
def test_lines_come_back_page_by_page(packed):
    assert pdf_text(pdf([page(LINES), page(["page two", "été – größer"])], packed=packed)).split("\n") == [*LINES, "page two", "été – größer"]


def test_operators_that_move_and_show():
    content = (
        b"BT /F1 10 Tf 1 0 0 1 72 700 Tm (left) Tj 200 0 Td (right) Tj ET\n% a comment (\nBT 72 680 Td [(ker) -20 (ned) -400 (words)] TJ 0 -14 Td (next) Tj 14 TL (quoted) ' 0 0 (twice) \" ET"
        b" BT 72 600 TD <48656C6C6F> Tj (\\050oct\\141l\\) \\\nsplit) Tj ET q BI /W 1 ID \x00(\xff EI Q BT 72 500 Td (after the image) Tj ET"
    )
    assert pdf_text(pdf([content])).split("\n") == ["left right", "kerned words", "next", "quoted", "twice", "Hello(octal) split", "after the image"]


def test_fonts_with_maps_and_differences():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0930> <0002> <0041030A> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <D83DDE00>] endbfrange"
    assert unicode_map(cmap) == {(2, 1): "र", (2, 2): "A\u030a", (2, 16): "a", (2, 17): "b", (2, 18): "c", (2, 32): "x", (2, 33): "😀"}
    wide = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>"
    text = "abc x " + "र" * 40
    hexed = b"".join({"a": b"0010", "b": b"0011", "c": b"0012", "x": b"0020", "र": b"0001", " ": b"0099"}[c] for c in text)
    assert pdf_text(pdf([b"BT /F1 9 Tf <" + hexed + b"> Tj ET"], wide, {4: stream(cmap)})) == text.replace(" ", "")
    assert pdf_text(pdf([b"BT /F1 9 Tf <" + hexed + b"> Tj ET"], b"<</Type/Font/Subtype/Type0/Encoding/Identity-H>>")) is None  # glyph numbers say nothing
    odd = b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/MacRomanEncoding/Differences[1/eacute/n/uni0905 200/bullet/ccedilla/nosuchglyph]>>>>"
    assert pdf_text(pdf([b"BT /F1 9 Tf (" + b"\x01\x02\x03\xc8\xc9\xca \x8e" * 12 + b") Tj ET"], odd)) == "énअ•ç é" * 12
    assert [glyph(x) for x in ("A", "Adieresis", "ntilde", "fi", "zero", "u1F600", "g12")] == ["A", "Ä", "ñ", "fi", "0", "😀", ""]


def test_object_streams_and_forms():
    inside = [b"<</Type/Catalog/Pages 21 0 R>>", b"<</Type/Pages/Kids[22 0 R]/Resources<</Font<</F1 23 0 R>>/XObject<</X 30 0 R>>>>>>", b"<</Type/Page/Contents[31 0 R 32 0 R]>>", b"<</Type/Font/Subtype/TrueType>>"]
    head = b" ".join(b"%d %d" % (20 + i, sum(len(x) + 1 for x in inside[:i])) for i in range(4)) + b"\n"
    data = b"%PDF-1.5\n" + b"".join(
        b"%d 0 obj %s endobj\n" % (n, x)
        for n, x in ((40, stream(head + b"\n".join(inside), True, b"/Type/ObjStm/N 4/First %d" % len(head))), (30, stream(b"BT /F1 8 Tf 0 5 Td (shown by a form, which pages share) Tj ET", True, b"/Subtype/Form")),
                     (31, stream(b"BT /F1 8 Tf 0 9 Td (first half of the page) Tj ET /X")), (32, stream(b"Do BT /F1 8 Tf 0 1 Td (second half) Tj ET")))
    )
    assert pdf_text(data).split("\n") == ["first half of the page", "shown by a form, which pages share", "second half"]


def test_broken_files_pass_with_what_is_left():
    whole = pdf([page(LINES), page(["page two of the file, long enough to count"])])
    for broken in (whole.replace(b"/Kids", b"/Sdik"), whole[: whole.index(b"xref")], whole.replace(b"/Type/Catalog", b"/Type/Unknown"), b"junk before\n" + whole, whole.replace(b"/Length", b"/Htgnel")):
        assert set(pdf_text(broken).split("\n")) == {*LINES, "page two of the file, long enough to count"}
    for none in (None, b"", b"%PDF", b"no mark " + whole[9:], whole + b"trailer<</Encrypt 9 0 R>>", pdf([b"q 1 0 0 1 0 0 cm Q"])):
        assert pdf_text(none) is None
    loops = whole.replace(b"/Kids[", b"/Kids[2 0 R ")
    assert pdf_text(loops) == pdf_text(whole)
    bomb = pdf([b"BT (" + b" " * (65 << 20) + b") Tj ET", page(LINES)])
    assert pdf_text(bomb).split("\n") == LINES


def test_damage_never_ends_the_job():
    rng, whole = random.Random(1), pdf([page(LINES)] * 3)
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 30)):
            at = rng.randrange(len(data))
            data[at : at + rng.choice([0, 1, 1, 5])] = bytes(rng.choice(b"()<>[]/ 0R\\\xff") for _ in range(rng.randint(0, 3)))
        pdf_text(bytes(b"%PDF" + data))
    deep = b"%PDF 1 0 obj " + b"[" * 5000 + b" endobj 2 0 obj 2 0 R endobj 3 0 obj 4 0 R endobj 4 0 obj 3 0 R endobj"
    assert pdf_text(deep) is None and File(deep).get(Ref(3)) is None
    assert Lexer(b"<< /A 1 /B [2 3 0 R (x)] >>").value() == {"A": 1, "B": [2, Ref(3), b"x"]}


def test_uploads_read_pdf_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(pdf([page(LINES)]))
    (tmp_path / "b.pdf").write_bytes(pdf([page(["short"])]))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 nothing")
    got = {r.url: (r.raw_text, r.problem) for r in pages.uploads(spark, str(tmp_path)).collect()}
    assert got == {"manual://a.PDF": ("\n".join(LINES), None), "manual://b.pdf": ("short", "too little text"), "manual://c.pdf": (None, "unreadable")}
    small = {r.url: r.problem for r in pages.uploads(spark, str(tmp_path), 100).collect()}
    assert small["manual://a.PDF"] == "unreadable"


def test_queries_equal_sql(spark):
    same_as_sql(spark, uploads, "pdf_text", "uploaded_schemes")
