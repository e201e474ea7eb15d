import io
import json
import zipfile

from pyspark.sql import functions as F

from quire.sources import files


def test_csv():
    text = "Name,Language,Cost\nBook 1,Arabic,0.02\nBook 2,\"a\nb|c\"\nBook 3,x,1,extra\n"
    assert files.csv_markdown(text.encode("utf-8-sig")).split("\n") == ["| Name | Language | Cost |", "| --- | --- | --- |", "| Book 1 | Arabic | 0.02 |", "| Book 2 | a<br>b\\|c |  |", "| Book 3 | x | 1 |"]
    assert "Résumé" in files.csv_markdown("a\nRésumé".encode("latin-1")) and files.csv_markdown(b"") == files.EMPTY_CSV


def test_json():
    verses = [{"surah": 1, "text_ar": "ا"}, {"surah": 2, "text_en": "b"}]
    assert files.json_markdown(json.dumps(verses).encode()).split("\n")[2] == "| surah | text_ar | text_en |"
    assert files.json_markdown(b'{"book_title": "X", "rows": [{"a": 1}], "n": {"k": 2}}').startswith("## Book Title\n\nX\n\n## Rows\n\n| a |")
    assert files.json_markdown(b'[1, "b"]') == '- 1\n\n- "b"'


def test_workbook():
    out = io.BytesIO()
    name = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {name}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {name}><si><t>h1</t></si><si><t>h2</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {name}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row/><row><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    assert files.workbook_markdown(out.getvalue()) == "## One\n\n| h1 | h2 |\n| --- | --- |\n|  | 5 |"
    assert files.workbook_markdown(b"garbage") == files.EMPTY_BOOK


def test_files_and_router(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in {"in/a.csv": b"x,y\n1,2\n", "in/deep/b.TXT": "Résumé".encode("latin-1"), "in/c.pdf": b"%PDF /Type /Page /Type/Page /Type /Pages", "in/d.exe": b"no", "in/e.pdf": b"/Type /Pages /Count 7"}.items():
        (tmp_path / name).write_bytes(content)
    found = files.files(spark, str(tmp_path / "in"))
    pages = lambda b: [f"{'long enough text ' * 3}"] if b"%PDF" in b else []
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.markdown(found, pdf_provider=pages).collect()}
    assert sorted(rows) == ["a.csv", "b.TXT", "c.pdf", "e.pdf"]
    assert rows["a.csv"]["raw_markdown"].endswith("| 1 | 2 |") and rows["b.TXT"]["raw_markdown"] == "Résumé"
    assert rows["c.pdf"]["raw_markdown"].startswith("## Page 1") and rows["c.pdf"]["page_count"] == 2
    assert rows["e.pdf"]["raw_markdown"] is None and rows["e.pdf"]["page_count"] == 7 and rows["a.csv"]["page_count"] == 1
    cache = found.filter("path like '%e.pdf'").select(F.sha2("content", 256).alias("file_hash"), F.lit("read before").alias("raw_markdown"))
    again = files.markdown(found, pages, cache).filter("path like '%e.pdf'").first()
    assert again["raw_markdown"] == "read before"


def test_content_address(spark):
    df = spark.createDataFrame([("Hello World",)], "x string")
    assert df.select(F.sha2("x", 256)).first()[0] == "a591a6d40bf420404a011733cfb7b190d62c65bf0bcda32b57b277d9ad9f146e"


def test_price_list(spark):
    feed = json.dumps({"data": [{"id": "Maker/Pro", "pricing": {"prompt": "0.00000125", "completion": "0.00001"}}, {"id": "x", "pricing": {"prompt": "n/a"}}]})
    rows = files.price_list(spark.createDataFrame([(feed,)], "value string")).collect()
    assert rows[0]["model"] == "maker/pro" and float(rows[0]["completion"]) == 1e-5 and rows[1]["prompt"] is None
