import io
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from veilframe.operators.files import mask_files
from veilframe.sources import documents, formats, ocr, ooxml, pdf

CORE = "<w:document xmlns:w='x'><w:body><w:p w:rsidR=\"10000000146\"><w:r><w:t>Kurulum Notu</w:t></w:r></w:p>\n  <w:p><w:t xml:space=\"preserve\">parola: &quot;x&quot; &amp; y</w:t></w:p><!-- 10000000146 <w:t> --><![CDATA[raw <b>]]></w:body></w:document>"


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, compress_type=method)
    return out.getvalue()


DOCX = archive([("[Content_Types].xml", "<Types>skip</Types>", zipfile.ZIP_DEFLATED), ("word/document.xml", CORE, zipfile.ZIP_DEFLATED), ("word/media/image1.png", b"\x89PNG", zipfile.ZIP_STORED), ("docProps/app.xml", "<a>app</a>", zipfile.ZIP_STORED), ("xl/sharedStrings.xml", "<sst><si><t>Musteri</t></si></sst>", zipfile.ZIP_STORED)])


def pdf_file(body, compress=False, pages=1):
    stream = f"BT /F1 12 Tf 40 700 Td ({body}) Tj ET".encode()
    data = zlib.compress(stream) if compress else stream
    head = f"<< /Length {len(data)}{' /Filter /FlateDecode' if compress else ''} >>".encode()
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n" % i for i in range(10, 10 + pages)) + b"4 0 obj\n" + head + b"\nstream\n" + data + b"\nendstream\nendobj\n%%EOF\n"


def test_formats(spark):
    paths = {"a/b.DOCX": "ooxml", "x.pptm": "ooxml", "p.HEIC": "image", "s.pdf": "pdf", "t.csv": "text", "noext": "text", "d.pdf/file": "text", ".pdf": "text", "a.tar.pdf": "pdf"}
    for p, f in paths.items():
        assert formats.format_of(p) == f, p
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", formats.format_column(F.col("p")).alias("f")).collect()
    assert {r["p"]: r["f"] for r in rows} == paths


def test_text_nodes_alone_change():
    out = ooxml.transform_text_nodes(CORE, lambda t: t.replace("Notu", "<Not>").replace("y", "z"))
    assert out == CORE.replace("Kurulum Notu", "Kurulum &lt;Not&gt;").replace("&quot;x&quot; &amp; y", '"x" &amp; z')
    assert ooxml.transform_text_nodes(CORE, lambda t: t) == CORE
    assert ooxml.extract_text(DOCX) == 'Kurulum Notu\nparola: "x" & y\nMusteri\n'
    labelled = ooxml.extract_text(DOCX, lambda b: "seen")
    assert labelled.endswith("\n[text recognised in embedded image word/media/image1.png]\nseen\n")
    for bad in ("<a", "</a>", "<a>&nope;</a>"):
        with pytest.raises(ooxml.DocumentError):
            ooxml.transform_text_nodes(bad, str)


def test_archives_keep_everything_else():
    done, n = ooxml.replace_text(DOCX, "Kurulum", "Setup")
    assert n == 1 and "Setup Notu" in ooxml.extract_text(done)
    with zipfile.ZipFile(io.BytesIO(DOCX)) as a, zipfile.ZipFile(io.BytesIO(done)) as b:
        assert a.namelist() == b.namelist()
        assert [e.compress_type for e in a.infolist()] == [e.compress_type for e in b.infolist()]
        assert all(a.read(x) == b.read(x) for x in a.namelist() if x != "word/document.xml")
    with pytest.raises(ooxml.DocumentError):
        ooxml.extract_text(b"plain text")


def test_pdf_layers_and_scans():
    line = "Musteri kaydi tckn 10000000146 eposta a.b@example.com"
    for compress in (False, True):
        assert line in documents.document_text("x.pdf", pdf_file(line, compress))
    scan = documents.document_text("x.pdf", pdf_file("1"))
    assert "WARNING" in scan
    engine, renderer = lambda b: [ocr.Recognized("page " + b.decode())], lambda c, n: [b"1", b"2"][:n]
    assert documents.document_text("x.pdf", pdf_file("1"), engine, renderer) == "page 1\npage 2" + pdf.NOTE_OCR
    assert documents.document_text("x.pdf", pdf_file("1", pages=51), engine, renderer).endswith(pdf.NOTE_TRUNCATED)
    with pytest.raises(ooxml.DocumentError):
        documents.document_text("x.pdf", b"not a pdf")


def composite_file(text, table=True, packed=False, simple=""):
    """Two-byte codes that are no characters; their table, if any, in a stream of its own; objects in a packed stream or plain."""
    codes = {c: 3 + i for i, c in enumerate(dict.fromkeys(text))}
    pairs = list(codes.items())
    chars = "".join(f"<{n:04X}> <{c.encode('utf-16-be').hex()}>\n" for c, n in pairs[::2])
    ranges = "".join(f"<{n:04X}> <{n:04X}> " + (f"<{c.encode('utf-16-be').hex()}>\n" if n % 4 else f"[<{c.encode('utf-16-be').hex()}>]\n") for c, n in pairs[1::2])
    cmap = f"begincmap\n{len(pairs)} beginbfchar\n{chars}endbfchar\n1 beginbfrange\n{ranges}endbfrange\nendcmap".encode()
    shown = "".join(f"{codes[c]:04X}" for c in text)
    content = f"BT /F1 12 Tf 40 700 Td <{shown}> Tj ET BT /F2 9 Tf ({simple}) Tj ET".encode()
    objects = {3: b"<< /Type /Page /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> /Contents 4 0 R >>", 5: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H" + (b" /ToUnicode 6 0 R" if table else b"") + b" >>", 7: b"<< /Type /Font /Subtype /Type1 >>"}
    streams = {4: content, 6: cmap}
    out = b"%PDF-1.5\n"
    if packed:
        bodies = list(objects.values())
        starts = [sum(len(x) + 1 for x in bodies[:i]) for i in range(len(bodies))]
        head = " ".join(f"{n} {a}" for n, a in zip(objects, starts)).encode() + b" "
        data = zlib.compress(head + b" ".join(bodies))
        out += b"9 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >>\nstream\n" % len(head) + data + b"\nendstream\nendobj\n"
    else:
        out += b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    return out + b"".join(b"%d 0 obj\n<< /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (n, zlib.compress(x)) for n, x in streams.items()) + b"%%EOF\n"


@pytest.mark.parametrize("packed", [False, True])
def test_composite_fonts_are_read_or_warned_of(packed):
    line = "Müşteri kaydı tckn 10000000146 e-posta a.b@example.com"
    read = documents.document_text("x.pdf", composite_file(line, packed=packed))
    assert read == line + "\n\n" and pdf.page_count(composite_file(line, packed=packed)) == 1
    blind = documents.document_text("x.pdf", composite_file(line, table=False, packed=packed))
    assert blind.endswith(pdf.NOTE_WARNING) and pdf.needs_ocr(pdf.extract_text(composite_file(line, table=False, packed=packed)))
    partly = documents.document_text("x.pdf", composite_file(line, table=False, packed=packed, simple="a text layer of some length"))
    assert "a text layer of some length" in partly and partly.endswith(pdf.NOTE_PARTLY)
    engine, renderer = lambda b: [ocr.Recognized("seen")], lambda c, n: [b"1"]
    assert documents.document_text("x.pdf", composite_file(line, table=False), engine, renderer) == "seen" + pdf.NOTE_OCR


def test_control_characters_are_no_text_layer():
    codes = "".join(f"\\{i:03o}" for i in range(1, 32) if i not in (9, 10, 13))
    assert "WARNING" in documents.document_text("x.pdf", pdf_file(codes))


def test_unread_pictures_are_told():
    assert "word/media/image1.png" in documents.document_text("x.docx", DOCX)
    assert "WARNING" not in documents.document_text("x.docx", DOCX, lambda b: [ocr.Recognized("seen")])


def test_read_documents(spark, tmp_path):
    for name, data in {"a.txt": "düz metin".encode(), "b.csv": b"ad,tckn\nAli,10000000146\n", "bad.txt": b"\xff\xfe", "c.docx": DOCX, "broken.docx": b"text", "d.pdf": pdf_file("A text layer that is long enough"), "e.png": b"\x89PNG", "empty.md": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rpartition("/")[2]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "düz metin" and rows["b.csv"]["text"].startswith("ad,tckn") and "empty.md" not in rows
    assert rows["c.docx"]["text"].startswith("Kurulum") and "long enough" in rows["d.pdf"]["text"]
    assert all(rows[x]["text"] is None and rows[x]["error"] for x in ("bad.txt", "broken.docx", "e.png"))
    limited = {r["path"].rpartition("/")[2]: r["error"] for r in documents.read_documents(spark, str(tmp_path), max_bytes=15).collect()}
    assert limited["b.csv"] == "file exceeds the size limit" and limited["a.txt"] is None


def test_folders_are_masked(spark, tmp_path):


    for i, (name, data) in enumerate({"z.txt": b"a@b.com", "a.csv": b"c@d.com,a@b.com", "d.docx": DOCX, "plain.md": b"nothing", "bad.pdf": b"no pdf", "s.pdf": pdf_file("1")}.items()):
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    done = mask_files(spark, str(tmp_path))
    rows = {r["path"].rpartition("/")[2]: r for r in done.df.collect()}
    assert rows["z.txt"]["masked"] == "EPOSTA_1" and rows["a.csv"]["masked"] == "EPOSTA_2,EPOSTA_1"
    assert rows["a.csv"]["note"] == "\n\n(2 masked: 2 EPOSTA)" and rows["plain.md"]["note"].endswith("(no sensitive values found)")
    assert rows["bad.pdf"]["error"] and rows["bad.pdf"]["note"] is None and "WARNING" in rows["s.pdf"]["masked"]
    done.release()
