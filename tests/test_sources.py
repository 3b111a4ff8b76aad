import io
import zipfile

from pyspark.sql import functions as F

from signalmill.sources import files, messages, office
from signalmill.streaming import jobs


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Top", "Heading2") + p("plain") + p("one", "ListBullet") + f"<w:tbl><w:tr>{cell('A')}{cell('A')}</w:tr><w:tr>{cell('x|y')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx():
    text = office.docx(_docx())
    assert "## Top" in text and "- one" in text and "| A | A_2 |" in text and "x\\|y" in text
    assert office.docx(b"no zip").startswith("# Parse Error")


def test_sheet():
    assert office.header_names(["Name", "", "Name"]) == ["Name", "column_2", "Name_2"]
    header, rows = office.cleaned([["a", "b", None], ["1", None, None], [None, "2", None]])
    assert header == ["a", "b"] and rows == [["1", "b"], ["1", "2"]]
    assert len(office.grid([["x"], [""], ["y"], ["z"]])) == 2


def test_rendered(spark):
    rows = [("in/a.md", b"# hi"), ("in/b.txt", b"  ok \xff "), ("in/c.bin", b"\x00"), ("in/d.docx", _docx()), ("e.csv", b" ")]
    got = {r["object_key"]: r for r in files.rendered(spark.createDataFrame(rows, "object_key string, content binary")).collect()}
    assert got["in/a.md"]["content"] == "# hi" and "\n\nok\n" in got["in/b.md"]["content"]
    assert "(unsupported binary content)" in got["in/c.md"]["content"] and "## Top" in got["in/d.md"]["content"] and "(empty content)" in got["e.md"]["content"]


def test_repaired():
    assert messages.repaired('x ```json {"a": [1, 2,],} ``` y') == '{"a": [1, 2]}'
    assert messages.repaired("nothing") is None and messages.repaired(None) is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"job_id": "1", "payload": {"additional_context": "x"}}\nbroken\n')
    q = jobs.run(jobs.requests(spark, str(tmp_path / "in")), lambda df: df.select(F.col("msg.job_id").alias("job_id")), *(str(tmp_path / n) for n in ("out", "bad", "checkpoint")))
    q.awaitTermination(60)
    assert [r["job_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]
    assert [r["body"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["broken"]


def workbook(sheets):
    """A workbook as spreadsheet programs write it: shared and inline strings, numbers, gaps between rows and cells."""
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared, out = [], io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (_, rows) in enumerate(sheets, 1):
            xml = []
            for r, cells in rows.items():
                own = []
                for c, v in cells.items():
                    if isinstance(v, str) and v.startswith("inline:"):
                        own.append(f'<c r="{c}{r}" t="inlineStr"><is><t>{v[7:]}</t></is></c>')
                    elif isinstance(v, str):
                        shared.append(v)
                        own.append(f'<c r="{c}{r}" t="s"><v>{len(shared) - 1}</v></c>')
                    else:
                        own.append(f'<c r="{c}{r}"><v>{v}</v></c>')
                xml.append(f'<row r="{r}">{"".join(own)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{''.join(xml)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
    return out.getvalue()


def test_workbook():
    from signalmill.sources import office

    data = workbook([("Tasks", {1: {"A": "Name", "C": "Points"}, 2: {"A": "inline:Login", "C": 5}, 3: {"C": 8}, 6: {"B": "Other"}, 7: {"B": "x|y"}}), ("Empty", {})])
    got = office.xlsx(data)
    assert got.startswith("## Sheet: Tasks\n\n### Table 1\n\n") and "### Table 2" in got and got.endswith("## Sheet: Empty\n\n(empty sheet)")
    lines = got.split("\n")
    rows = [x for x in lines if x.startswith("|")]
    assert rows[0] == "| Name | Points |" and rows[2] == "| Login | 5 |" and rows[3] == "| Login | 8 |"  # blanks are filled from above
    assert "x\\|y" in rows[-1]
    assert office.xlsx(b"no workbook").startswith("# Parse Error")


def test_repaired_takes_the_first_value_that_decodes():
    """The same as a decoder at each bracket in turn, on short texts of all kinds; long broken ones are read once."""
    import json
    import random
    import re
    import time

    def plain(text):
        for m in re.finditer(r"[{\[]", text):
            try:
                return True, json.JSONDecoder(strict=False).raw_decode(text, m.start())[0]
            except ValueError:
                continue
        return False, None

    rnd = random.Random(1)
    pool = ["[", "]", "{", "}", '"', ",", ":", "1", '"a"', "x", " ", "\\", '\\"', "null", '"k":', "\n", "[1,2]", '{"a":[1]}', '"[3]"', '"{"']
    for _ in range(20_000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))
        assert messages.first_value(text) == plain(text), text
    began = time.process_time()
    assert messages.repaired("[" * 1_000_000) is None
    assert messages.repaired("[" * 300_000 + "x" + "]" * 300_000) is None
    assert messages.repaired('{"a":' * 100_000 + '[1]') == "[1]"
    assert time.process_time() - began < 20


def test_replacement_characters_of_the_file_stay(spark):
    rows = [(1, "a�b".encode()), (2, b"a\xffb"), (3, "a�".encode() + b"\xff\xfe" + "ü".encode()), (4, b""), (5, None)]
    got = {r["k"]: r["t"] for r in spark.createDataFrame(rows, "k int, c binary").select("k", files.decoded(F.col("c")).alias("t")).collect()}
    assert got == {1: "a�b", 2: "ab", 3: "a�ü", 4: "", 5: None}
