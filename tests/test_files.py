import io
import json
import zipfile

import pytest

from rulespark import catalog
from rulespark.operators import emit as X
from rulespark.operators import model as M
from rulespark.sources import files as S
from rulespark.sources import settings
from rulespark.streaming import metrics

Q = catalog.queries()
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{p('Intro')}{p('One', 'Heading1')}{p('first')}{table}{p('Two', 'Heading2')}{p('second part')}{p('Three', 'Heading1')}{p('x')}</w:body></w:document>"})


def xlsx():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>rate</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2.5</v></c></row><row r="3"><c r="C3"><v>3</v></c></row>'
    return zipped({
        "xl/workbook.xml": f'<workbook {main}><sheets><sheet name="Fees" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>name</t></si><si><r><t>lo</t></r><r><t>an</t></r></si></sst>", "xl/worksheets/a.xml": f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>", "xl/worksheets/b.xml": f"<worksheet {main}><sheetData/></worksheet>",
    })


def test_office_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "_b").mkdir()
    (tmp_path / "a" / "doc.docx").write_bytes(docx())
    (tmp_path / "a" / "fees.XLSX").write_bytes(xlsx())
    (tmp_path / "a" / "note.txt").write_text("é plain")
    (tmp_path / "a" / "image.png").write_bytes(b"x")
    (tmp_path / "_b" / "hidden.txt").write_text("no")
    got = {}
    for r in S.chunks(spark, str(tmp_path)).orderBy("path", "chunk").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.title, r.section_path, r.content))
    assert got == {
        "doc.docx": [("", "", "Intro"), ("One", "One", "first\na | b"), ("Two", "One > Two", "second part"), ("Three", "Three", "x")],
        "fees.XLSX": [("Fees rows 2-3", "Fees", "Columns: name, , rate\nRow 2: name: loan | rate: 2.5\nRow 3: rate: 3")], "note.txt": [("note.txt", "", "é plain")],
    }
    assert [c[4] for c in S.document_chunks("p", docx(), 6)] == ["Intro", "first\na | b", "second part\nThree\nx"]
    assert S.chunker_of("x.pdf") is None


def test_table_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,size\na,1\n\"b,c\",2\nd,3,4,5\ne,\n")
    rows = S.table_rows(spark, str(tmp_path))
    assert [(r.name, r["size"]) for r in rows.orderBy("_line").collect()] == [("a", "1"), ("b,c", "2"), ("e", None)]
    one = S.row_chunks(rows, ["name", "size"], "_file", "_line").collect()
    assert [r.content for r in one] == ["Columns: name, size\nname: a | size: 1\nname: b,c | size: 2\nname: e"]


def test_settings(monkeypatch):
    monkeypatch.setenv("FOO_X", "1")
    assert settings.resolved({"a": ["${FOO_X}/${NOT_SET_AT_ALL}", 2]}) == {"a": ["1/", 2]}
    assert settings.lookup({"a": {"b": 0}}, "a.b") == 0 and settings.lookup({"a": 1}, "a.b", "d") == "d"
    assert settings.stages("3-6, 09,4", 12) == [3, 4, 5, 6, 9]
    for bad in ("", "6-3", "x", "0", "13"):
        with pytest.raises(ValueError):
            settings.stages(bad, 12)
    names = settings.StageNames(["read", "check"], {"verify": "check"})
    assert names.number("verify") == 2 and names.folder("read") == "01_read"
    with pytest.raises(KeyError):
        names.canonical("other")


def test_limits(spark, sf):
    rows = {}
    for r in Q["concurrency_limits"](spark, sf).collect():
        rows.setdefault(r.key, []).append(r)
    for got in rows.values():
        limit, good, bad = 8, 0, 0
        for r in sorted(got, key=lambda r: (r.ts, r.id)):
            wait = 0.0
            if r.id % 6:
                good, bad = good + 1, 0
                if good == 5 and limit < 16:
                    limit, good = limit + 1, 0
                elif limit == 16:
                    good = min(good, 10**9)
            else:
                good, bad = 0, bad + 1
                if r.id % 12 == 0:
                    limit, wait = max(1, limit // 2), min(60.0, 2.0 ** min(bad, 5))
            assert (r.current_limit, r.backoff_s) == (limit, wait)


def test_checkpoints(spark, tmp_path):
    items, seen = spark.createDataFrame([(k, f"f{k}") for k in range(6)], "k long, fp string"), []

    def work(df):
        seen.append(sorted(r.k for r in df.collect()))
        return df.withColumn("result", df["k"] * 2)

    for part in (items.where("k < 4"), items, items):
        out = metrics.checkpointed(part, f"{tmp_path}/done", "fp", work)
    assert seen == [[0, 1, 2, 3], [4, 5], []] and {(r.fp, r.result) for r in out.collect()} == {(f"f{k}", 2 * k) for k in range(6)}


def test_proposals(spark):
    rows = [
        (1, "a", "Loan", None, None, "high"), (2, "a", "Loan", None, None, "high"), (3, "zz", "Loan", None, None, "high"), (4, "b", "Nobody", None, None, "low"), (5, "c", "Loan", None, None, "certain"), (6, "d", "Loan", None, None, "unclear"), (7, "e", None, None, None, "low"),
        (8, "n1", None, "new thing", None, "low"), (9, "n2", None, "new thing", None, "low"), (10, "n3", None, "new thing", None, "low"), (11, "f1", None, "flags", None, "low"), (12, "f2", None, "flags", None, "low"), (13, "f3", None, "flags", None, "low"), (14, "s", None, "small", None, "low"),
        (15, "v1", None, None, "range", "low"), (16, "v2", None, None, "range", "low"), (17, "v3", None, None, "alone", "low"),
    ]
    known = [(s, "Boolean" if s[0] == "f" else "Money") for s in ("a", "b", "c", "d", "e", "n1", "n2", "n3", "f1", "f2", "f3", "s", "v1", "v2", "v3")]
    got = M.accepted_proposals(spark.createDataFrame(rows, "pos long, symbol string, owner string, new_class string, value_object string, confidence string"), spark.createDataFrame(known, "symbol string, type string"), spark.createDataFrame([("Loan",)], "class string"))
    assert [r.outcome for r in got.orderBy("pos").collect()] == ["accepted", "unknown_symbol", "unknown_symbol", "unknown_class", "bad_shape", "unclear", "unclear", *["accepted"] * 3, *["flag_class"] * 3, "too_few", "value_object", "value_object", "unclear"]


def test_renderers(spark, tmp_path):
    a = [{"class": "Loan", "name": "amount", "type": "Money", "required": True}, {"class": "Loan", "name": "grade", "type": "Grade", "values": ["a", "b"]}, {"class": "Loan", "name": "signed", "type": "Date"}]
    schema = X.json_schema(a)["$defs"]["Loan"]
    assert schema["required"] == ["amount"] and schema["properties"] == {"amount": {"type": "number"}, "grade": {"enum": ["a", "b"]}, "signed": {"type": "string", "format": "date"}}
    link = [{"source": "Loan", "verb": "has", "target": "Party"}]
    assert X.class_diagram(a, link) == "classDiagram\nclass Loan {\n  Money amount\n  Grade grade\n  Date signed\n}\nLoan --> Party : has"
    assert X.class_diagram(a, link, "plantuml").startswith("@startuml") and "amount: Money" in X.class_diagram(a, link, "plantuml")
    assert "range: Money" in X.yaml_schema(a)
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k long, t string")
    assert X.markdown_table(df) == "| k | t |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    X.write_table(df, f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    rule = {"rule_id": "R1", "condition_predicates": [{"predicate_id": "a", "variable": "x", "operator": ">", "value": 1}, {"predicate_id": "b", "variable": "y", "operator": "in", "value": ["p", "q"]}], "condition_logic": {"any": [{"all": [{"predicate_ref": "a"}, {"predicate_ref": "b"}]}, {"predicate_ref": "a"}]}}
    assert X.condition_text(rule) == '(x > 1 AND y in ["p", "q"]) OR x > 1'
    models = X.emitted(spark.createDataFrame([("R1", json.dumps(rule))], "rule_id string, rule string"), X.decision)
    assert X.document(models, X.DMN).count("<") > 10 and X.feel("2024-01-01", "date") == 'date("2024-01-01")'
