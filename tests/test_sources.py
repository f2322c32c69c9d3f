import json

import pytest
from pyspark.sql import functions as F

from tallysheaf.sources import readers, schema, writers


def test_function_dimension(spark):
    rows = readers.schema.functions(spark).collect()
    assert len(schema.leaf_codes()) == 46 and schema.leaf_codes()[0] == "F01.a" and schema.leaf_codes()[-1] == "F16"
    assert len(rows) == 59 and sum(r["class_idx"] is not None for r in rows) == 46


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_sheet_to_dataset(spark, tmp_path):
    head = "row_no,FEJEZET,CIM,ALCIM,JOGCIM1,JOGCIM2,MEGNEVEZÉS,ÁHT-T,Funkció,Működési kiadás,Működési bevétel,Felhalmozási kiadás,Felhalmozási bevétel\n"
    body = ["1,1,,,,,ORSZÁGGYŰLÉS NAGY háza,,F01.a,,,,", "2,1.0,1,,,,Hivatal,7,,,,,", "3,1,,1,,,Bér,8,,\"1 234,5\",,2,", "4,1,,2,,,Ház,9,F02,3,1,,", "5,1,2,,,,Egyéb,,,4,,,", "6,,,,,,nincs,,,9,,,", "7,2,,,,,VÉG,,,1,,,"]
    path = write(tmp_path / "s.csv", head + "\n".join(body) + "\n")
    rows = readers.normalised(readers.sheet(spark, path, 2019), 2019)
    assert [r["fid"] for r in rows.orderBy("row_no").collect()] == ["1", "1.1", "1.1.1", "1.1.2", "1.2", "2"]
    texts = readers.texts(spark, write(tmp_path / "t.csv", 'fid,text\n1.1.2,"több\nsor, vessző"\n1.1.1,Nincs indoklás\n'))
    got = {r["fid"]: r for r in readers.dataset(rows, texts).collect()}
    assert set(got) == {"1.1.1", "1.1.2", "1.2"}
    assert got["1.1.1"]["spending"] == 1234.5 and got["1.1.1"]["function"] == "F01.a" and got["1.1.2"]["function"] == "F02"
    assert got["1.1.2"]["indoklas"] == "több\nsor, vessző" and got["1.1.1"]["indoklas"] is None and got["1.2"]["section_name"] == "ORSZÁGGYŰLÉS Nagy Háza"


def test_texts_belong_to_their_year(spark, tmp_path):
    head = "row_no,FEJEZET,CIM,ALCIM,JOGCIM1,JOGCIM2,MEGNEVEZÉS,ÁHT-T,Funkció,Működési kiadás,Működési bevétel,Felhalmozási kiadás,Felhalmozási bevétel\n"
    body = ["1,1,,,,,FEJEZET,,F01.a,,,,", "2,1,1,,,,Hivatal,7,,1,,,", "3,1,2,,,,Bér,8,,2,,,", "4,2,,,,,VÉG,,,1,,,"]
    path = write(tmp_path / "s.csv", head + "\n".join(body) + "\n")
    rows = readers.normalised(readers.sheet(spark, path, 2018), 2018).unionByName(readers.normalised(readers.sheet(spark, path, 2019), 2019))
    one = readers.texts(spark, write(tmp_path / "a.csv", "fid,text\n1.1,zebra első\n1.1,alma második\n"), 2018)
    two = readers.texts(spark, write(tmp_path / "b.csv", "fid,text\n1.1,másik év\n"), 2019)
    got = {(r["year"], r["fid"]): r["indoklas"] for r in readers.dataset(rows, one.unionByName(two)).collect()}
    assert got == {(2018, "1.1"): "zebra első", (2018, "1.2"): None, (2019, "1.1"): "másik év", (2019, "1.2"): None}
    with pytest.raises(ValueError):
        readers.dataset(rows, one.drop("year"))


def test_a_chapter_without_names_keeps_its_year_and_number(spark, tmp_path):
    head = "row_no,FEJEZET,CIM,ALCIM,JOGCIM1,JOGCIM2,MEGNEVEZÉS,ÁHT-T,Funkció,Működési kiadás,Működési bevétel,Felhalmozási kiadás,Felhalmozási bevétel\n"
    path = write(tmp_path / "s.csv", head + "1,7,,,,,,,F01.a,,,,\n2,7,1,,,,,8,,2,,,\n3,8,,,,,VÉG,,,1,,,\n")
    (got,) = readers.dataset(readers.normalised(readers.sheet(spark, path, 2019), 2019)).collect()
    assert (got["year"], got["section"], got["section_name"], got["fid"], got["spending"]) == (2019, "7", None, "7.1", 2.0)


def test_json_and_optional(spark, tmp_path):
    one = {"fid": "1.1", "name": "Árvíz", "spending": 2.0}
    (tmp_path / "ds").mkdir()
    write(tmp_path / "ds" / "2018.json", json.dumps(one, ensure_ascii=False) + "\n")
    got = readers.datasets(spark, str(tmp_path / "ds")).collect()
    assert [(r["fid"], r["name"], r["year"], r["income"]) for r in got] == [("1.1", "Árvíz", 2018, None)]
    assert {r["key"]: r["value"] for r in readers.json_map(spark, write(tmp_path / "m.json", '{"a": "F01", "b": "F02"}')).collect()} == {"a": "F01", "b": "F02"}
    assert readers.optional(spark, lambda: spark.read.parquet(str(tmp_path / "none")), schema.TEXTS).count() == 0


def test_html_rows(spark):
    page = "<p>x</p><table><tr><td>1</td><td> a &amp;\n b</td></tr><tr><th>2<td>c<tr></tr></table><td>no</td>"
    got = readers.html_rows(spark.createDataFrame([(1, page), (2, None)], "page_no int, html string")).collect()
    assert [(r["row_no"], r["cells"]) for r in got] == [(1, ["1", "a & b"]), (2, ["2", "c"])]


def test_pdf_pages_with_an_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo\f")
    pages = readers.pdf_pages(spark, str(tmp_path / "*.pdf"), lambda b: b.decode().split("\f"))
    assert [(r["doc_id"], r["page_no"], r["text"]) for r in pages.orderBy("page_no").collect()] == [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("a.pdf", 3, "")]
    assert readers.page_counts(pages).first()["pages"] == 3
    texts = readers.structured_texts(pages, lambda t: [(w, w.upper()) for w in t.split()])
    assert sorted(r["text"] for r in texts.collect()) == ["ONE", "TWO"]


def test_chapter_titles(spark):
    got = readers.chapter_titles(spark, {2020: " I. A \n\n II. B\n"}).collect()
    assert [(r["ord"], r["title"]) for r in got] == [(1, "I. A"), (2, "II. B")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(2020, "é;x", [1, 2])], "year int, name string, nums array<int>").coalesce(1)
    writers.semicolon_csv(rows.drop("nums"), str(tmp_path / "a"), bom=True)
    assert next((tmp_path / "a").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfyear;name")
    assert readers.semicolon_csv(spark, str(tmp_path / "a")).collect()[0]["name"] == "é;x"
    writers.headless_csv(rows, F.lit("XI"), str(tmp_path / "b"))
    assert next((tmp_path / "b").glob("part-*")).read_text(encoding="utf-8") == 'XI;2020;"é;x";1;2\n'
    writers.json_lines(rows, str(tmp_path / "c"), "year")
    assert "é" in next((tmp_path / "c" / "year=2020").glob("part-*")).read_text(encoding="utf-8")
    writers.quoted_csv(rows.select("name"), str(tmp_path / "d"))
    writers.by_year(rows, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1
    got = writers.json_object(spark.createDataFrame([("b", "x.pdf"), ("a", "y.pdf")], "s string, f string"), "s", F.struct(F.col("f").alias("file_path"))).first()["json"]
    assert json.loads(got) == {"a": {"file_path": "y.pdf"}, "b": {"file_path": "x.pdf"}}
    titled = writers.with_title(rows.drop("nums"), "Cím").orderBy("part").collect()
    assert titled[0]["year"] == "Cím" and titled[1]["name"] == "é;x"
    pages = spark.createDataFrame([("d", i) for i in range(1, 6)], "doc_id string, page_no int")
    bounds = spark.createDataFrame([("d", 1, 2, "A"), ("d", 3, 5, "B")], "doc_id string, start int, end int, section string")
    assert sorted((r["page_no"], r["section"]) for r in writers.ranges_of_pages(pages, bounds, ["doc_id"]).collect()) == [(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "B")]
    with pytest.raises(ValueError):
        writers.workbook(pages, str(tmp_path / "x.xlsx"), "s", most=2)


def test_a_large_object_is_refused(spark, monkeypatch):
    monkeypatch.setattr(writers, "MOST_OBJECT", 100)
    few, many = (spark.createDataFrame([(f"k{i}", "v") for i in range(n)], "s string, f string") for n in (3, 30))
    assert writers.json_object(few, "s", F.col("f")).first()["json"] == '{"k0":"v","k1":"v","k2":"v"}'
    with pytest.raises(ValueError):
        writers.json_object(many, "s", F.col("f"))
