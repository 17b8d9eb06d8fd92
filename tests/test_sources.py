import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import files


def docx(text):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("\n# The title\nbody")
    (tmp_path / "sub" / "b.docx").write_bytes(docx("First\nSecond"))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r.doc_id: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "bad"}
    assert got["a"].title == "The title" and got["b"].text == "First\nSecond" and got["bad"].text is None and "BadZipFile" in got["bad"].error
    assert files.list_files(spark, str(tmp_path)).count() == 3
    assert all(len(r.sha256) == 64 for r in files.fingerprints(spark, str(tmp_path)).collect())


def test_json_golden_jsonl_csv(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"doc_id": "d", "chunks": [{"chunk_id": "own", "text": "x"}, {"text": "y"}]}]')
    ids = [r.chunk_id for r in files.read_chunked_json(spark, str(tmp_path / "d.json")).orderBy("pos").collect()]
    assert ids[0] == "own" and ids[1].startswith("d:1:")
    (tmp_path / "g.json").write_text('[{"question": "why?", "gold_chunk_ids": ["a"]}, {"id": "q2", "question": "?"}]')
    golden = {r.question: r for r in files.read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert golden["why?"].id.startswith("case-") and golden["?"].gold_chunk_ids == [] and golden["?"].answer_type == "free_text"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int")
    assert sorted(r.a for r in good.where("a is not null").collect()) == [1, 2] and [r.value for r in bad.collect()] == ["broken"]
    (tmp_path / "m.csv").write_text("model,score\n[M](http://m),91.5%\nplain,n/a\n")
    assert sorted(map(tuple, files.read_benchmark_csv(spark, str(tmp_path / "m.csv")).collect()), key=str) == [("M", "http://m", 91.5), ("plain", None, None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "yes", ["p"])], "question_id string, answer string, pages array<string>")
    files.write_results(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("question_id", "result.answer").first() == ("q1", "yes")
    index = spark.createDataFrame([("t", 1, 2)], "term string, id int, tf int")
    files.write_postings(index, "postings_test", 2)
    assert spark.table("postings_test").where(F.col("term") == "t").count() == 1
