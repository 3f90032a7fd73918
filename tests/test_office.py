"""Tables of DOCX, XLSX and ODS files made here, and damaged ones."""

import io
import zipfile

from lexspark.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("DOT", "."), text)
    return out.getvalue()


def paragraph(text, style=None):
    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


def cell(text, span=1, merge=None, inner=""):
    m = {None: "", "restart": '<w:vMerge w:val="restart"/>', "on": "<w:vMerge/>"}[merge]
    return f'<w:tc><w:tcPr>{f"""<w:gridSpan w:val="{span}"/>""" if span > 1 else ""}{m}</w:tcPr>{"".join(map(paragraph, text.split("|")))}{inner}</w:tc>'


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(*body):
    return archive(word__document_xml=f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")


def test_docx_tables():
    inner = table([cell("tief")], [cell("tiefer")])
    content = docx(
        paragraph("Gebühren &amp; Fristen", "Heading1"), paragraph("Text"),
        table([cell("Art"), cell("Frist"), cell("Betrag")], [cell("Hund", merge="restart"), cell("zwei|Wochen"), cell("5")], [cell("", merge="on"), cell("breit", 2)], [cell(""), cell(""), cell("")], [cell("x"), cell("x"), cell("y")]),
        paragraph("Überschrift 2", "berschrift2"), table([cell("nur Kopf")]), table([cell("A"), cell("B")], [cell("außen", inner=inner), cell("b")]),
    )
    assert list(office.docx_rows(content)) == [
        (0, "", "Gebühren & Fristen", 0, ["Art", "Frist", "Betrag"], ["Hund", "zwei Wochen", "5"]), (0, "", "Gebühren & Fristen", 1, ["Art", "Frist", "Betrag"], ["Hund", "breit"]),
        (0, "", "Gebühren & Fristen", 3, ["Art", "Frist", "Betrag"], ["x", "y"]), (2, "", "Überschrift 2", 0, ["A", "B"], ["außen", "b"])]
    assert list(office.docx_rows(docx())) == []


def xlsx(*sheets, strings=""):
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
    parts = {f"xl__worksheets__s{i}_xml": f"<worksheet><sheetData>{data}</sheetData></worksheet>" for i, (_, data) in enumerate(sheets)}
    rels = "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    return archive(xl__workbook_xml=f'<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>', xl___rels__workbook_xmlDOTrels=f"<Relationships>{rels}</Relationships>", **({"xl__sharedStrings_xml": strings} if strings else {}), **parts)


def test_xlsx_sheets():
    strings = "<sst><si><t>Name</t></si><si><r><t>Re</t></r><r><t>x</t></r><rPh><t>nicht</t></rPh></si><si><t>Alter</t></si></sst>"
    first = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row r="2"/><row r="5"><c r="A5" t="s"><v>1</v></c><c r="C5"><v>3</v></c><c r="AB5" t="b"><v>1</v></c></row><row r="6"><c r="B6" t="inlineStr"><is><t>mitte</t></is></c></row>'
    second = '<row><c t="inlineStr"><is><t>x</t></is></c></row><row><c t="inlineStr"><is><t>Kopf</t></is></c><c t="inlineStr"><is><t>Zwei</t></is></c></row><row><c><v>1,5</v></c><c t="e"><v>#N/A</v></c></row>'
    got = list(office.xlsx_rows(xlsx(("Hunde", first), ("Leer", ""), ("Kopf", '<row><c t="str"><v>allein</v></c></row>'), ("Zweites", second), strings=strings)))
    names = ["Name", "Unnamed: 1", "Alter", *(f"Unnamed: {i}" for i in range(3, 28))]
    assert got == [
        (0, "Hunde", "", 0, names, ["Rex", "", "3", *[""] * 24, "True"]), (0, "Hunde", "", 1, names, ["", "mitte", *[""] * 26]), (1, "Zweites", "", 0, ["Kopf", "Zwei"], ["1,5", "#N/A"])]


def ods(tables):
    n = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    return archive(content_xml=f"<office:document-content {n}><office:body><office:spreadsheet>{tables}</office:spreadsheet></office:body></office:document-content>")


def test_ods_sheets():
    s = lambda t, extra="": f"<table:table-cell {extra}><text:p>{t}</text:p></table:table-cell>"
    rows = [s("Ort") + s("Zahl"), '<table:table-cell table:number-columns-repeated="16384"/>', s("Celle") + '<table:table-cell office:value-type="float" office:value="12.0"><text:p>12,00</text:p></table:table-cell>', s("gleich", 'table:number-columns-repeated="3"')]
    body = "".join(f'<table:table-row {"" if i != 3 else "table:number-rows-repeated=" + chr(34) + "2" + chr(34)}>{r}</table:table-row>' for i, r in enumerate(rows)) + '<table:table-row table:number-rows-repeated="1048572"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    got = list(office.ods_rows(ods(f'<table:table table:name="Orte">{body}</table:table><table:table table:name="leer"/>')))
    assert got == [(0, "Orte", "", 0, ["Ort", "Zahl"], ["Celle", "12"]), (0, "Orte", "", 1, ["Ort", "Zahl"], ["gleich"] * 3), (0, "Orte", "", 2, ["Ort", "Zahl"], ["gleich"] * 3)]


def test_files_are_read_side_by_side(spark, tmp_path):
    good = docx(paragraph("Kapitel", "Heading2"), table([cell("Art"), cell("Frist")], [cell("Hund"), cell("5")]))
    book = xlsx(("Hunde", '<row><c t="str"><v>A</v></c><c t="str"><v>B</v></c><c t="str"><v>C</v></c></row><row><c><v>1</v></c><c><v>2</v></c><c><v>3</v></c><c><v>4</v></c></row>'))
    for doc, name, content in (("1", "a.DOCX", good), ("2", "b.xlsx", book), ("3", "c.docx", good[:-30]), ("4", "d.ods", b"nichts"), ("5", "e.txt", b"x"), ("6", "f.docx", archive(other_xml="<a/>")), ("7", "g.docx", docx("<w:p>")), ("8", "h.xlsx", b"PK")):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / name).write_bytes(content)
    from lexspark.sources.files import listing

    rows = office.table_rows(listing(spark, str(tmp_path)).repartition(3)).collect()
    assert {(r["doc_id"], r["filename"], r["caption"], r["section"], tuple(r["cells"])) for r in rows if r["error"] is None} == {("1", "a.DOCX", "", "Kapitel", ("Hund", "5")), ("2", "b.xlsx", "Hunde", "", ("1", "2", "3", "4"))}
    assert {r["doc_id"]: r["error"].split(":")[0] for r in rows if r["error"]} == {"3": "BadZipFile", "4": "BadZipFile", "6": "KeyError", "7": "ParseError", "8": "BadZipFile"}
    prose = office.table_prose(office.table_rows(listing(spark, str(tmp_path)))).collect()
    assert sorted((r["doc_id"], r["prose"]) for r in prose) == [("1", 'Art "Hund": Frist ist "5".'), ("2", "Hunde: A: 1. B: 2. C: 3. Unnamed: 3: 4.")]
    assert office.table_rows(spark.createDataFrame([("1", None, None), ("2", "x.docx", None)], "doc_id string, filename string, content binary")).collect()[0]["error"].startswith("BadZipFile")
    assert office.table_rows(spark.createDataFrame([], "doc_id string, filename string, content binary")).count() == 0
