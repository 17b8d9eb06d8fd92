"""PDF text, folders as a data source, manifests, logs and compiled records."""

import io
import os
import random
import zipfile
import zlib

import pytest

from tessera.operators import compiling
from tessera.sources import files, folders, logs, manifest, pdf


def test_pdf_round_trips():
    rng = random.Random(3)
    pages = [[(50, 700 - 12 * k, "".join(rng.choice("abc é日😀()\\<>") for _ in range(rng.randrange(1, 30))).strip() or "x") for k in range(rng.randrange(1, 40))] for _ in range(5)]
    got, how = pdf.page_texts(pdf.document(pages))
    assert got == ["\n".join(t for _, _, t in runs) for runs in pages] and how == "stream"
    short = [[(50, 100, "last"), (200, 700, "right"), (50, 700, "left")]]
    assert pdf.page_texts(pdf.document(short)) == (["left right\nlast"], "layout")
    assert pdf.page_texts(pdf.document([[], []])) == (["", ""], "none") and pdf.page_texts(pdf.document([])) == ([], "none")


def old_pdf(content, extra=b"", filters=b""):
    """A file by hand: simple fonts, a form, objects in a stream, no cross-reference table."""
    packed = zlib.compress(b"7 0 8 34 << /Type /Font /Subtype /Type1 >> << /Fonts 1 >>")
    body = b"/Fm 1 0 obj"
    return (
        b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Kids [3 0 R 3 0 R] /Count 1 >> endobj\n"
        b"3 0 obj << /Type /Page /Contents [4 0 R] /Resources << /Font << /F1 7 0 R >> /XObject << /X 6 0 R >> >> >> endobj\n"
        b"4 0 obj << /Length 5 0 R " + filters + b">> stream\n" + content + b"\nendstream endobj\n5 0 obj " + str(len(content)).encode() + b" endobj\n"
        b"6 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -300] /Length 46 >> stream\nBT /F1 9 Tf 50 400 Td (inside \\(a form\\)) Tj ET\nendstream endobj\n"
        b"9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >> stream\n" + packed + b"\nendstream endobj\n" + extra + body[:0] + b"trailer << /Root 1 0 R >>"
    )


def test_pdf_operators():
    content = b"q 1 0 0 1 10 20 cm BT /F1 12 Tf 14 TL 50 700 Td [(Hel) -20 (lo) -300 (world)] TJ T* (caf\\351 \\\nend) Tj (next) ' ET Q % comment\n/X Do BI /W 1 ID xx EI"
    assert pdf.page_texts(old_pdf(content)) == (["Hello world\ncafé end\nnext\ninside (a form)"], "layout")
    assert pdf.page_texts(old_pdf(content.hex().encode() + b">", filters=b"/Filter /ASCIIHexDecode "))[0][0].startswith("Hello world")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.page_texts(old_pdf(content).replace(b"trailer << ", b"trailer << /Encrypt 5 0 R "))
    with pytest.raises(ValueError, match="filter"):
        pdf.page_texts(old_pdf(content, filters=b"/Filter /JBIG2Decode "))
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.page_texts(b"plain text")
    # damage ends in text or an error, never in a hang
    whole, rng = old_pdf(content), random.Random(0)
    for _ in range(200):
        broken = bytearray(whole[: rng.randrange(10, len(whole))])
        for _ in range(rng.randrange(4)):
            broken[rng.randrange(9, len(broken))] = rng.randrange(256)
        assert len(folders.parse("pdf", bytes(broken))) == 4


def test_enough_text():
    assert not pdf.enough("short") and pdf.enough("w " * 80) and pdf.enough("x" * 400) and not pdf.enough("." * 390 + "x" * 10) and not pdf.enough("  ")


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_a_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "law.md").write_text("# Data Law No. 3 of 2020\nof the United Kingdom, not the U.S.")
    (tmp_path / "deep" / "a.docx").write_bytes(docx("In Singapore"))
    (tmp_path / "deep" / "er" / "p.PDF").write_bytes(pdf.document([[(50, 700, "First page")], [], [(50, 700, "Third page")]]))
    (tmp_path / "deep" / "q.pdf").write_bytes(pdf.document([[(50, 700, "Lower case suffix")]]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "skip.bin").write_bytes(b"x")
    spark.dataSource.register(folders.DocumentSource)
    rows = spark.read.format("tessera_documents").option("path", str(tmp_path)).option("files", "2").load()
    got = {r.doc_id: r for r in rows.collect()}
    assert set(got) == {"law", "a", "p", "q", "bad"} and rows.count() == 7 and rows.rdd.getNumPartitions() == 4
    assert got["p"].pages == ["First page", "", "Third page"] and got["p"].text == "First page\n\nThird page" and got["p"].read == "layout"
    bad = {r.suffix: r for r in rows.where("doc_id = 'bad'").collect()}
    assert bad["pdf"].read == "none" and "BadZipFile" in bad["docx"].error and "UnicodeDecodeError" in bad["txt"].error
    same = folders.documents(spark, str(tmp_path)).where("suffix <> 'pdf' or doc_id <> 'p'").select("doc_id", "suffix", "text", "pages", "read", "error")
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, rows.where("doc_id <> 'p'").select(*same.columns).collect()), key=str)
    told = {r.doc_id: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert told["law"].jurisdiction == "UK" and told["a"].jurisdiction == "SG" and told["q"].jurisdiction == "" and told["law"].title == "Data Law No. 3 of 2020" and told["law"].type == "statute"
    assert [(r.page, r.heading, r.text) for r in folders.page_sections(rows.where("doc_id = 'p'")).orderBy("page").collect()] == [(1, "Page 1", "First page"), (3, "Page 3", "Third page")]


def test_a_file_that_goes_meanwhile(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    reader = folders.DocumentReader({"path": str(tmp_path), "bytes": "1"})
    parts = reader.partitions()
    os.remove(tmp_path / "a.txt")
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 2 and "FileNotFoundError" in rows[0][-1] and rows[1][3] == "y"


# ------------------------------------------------------------------ manifests


def test_guards_and_lost_runs(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "doc_id long, digest string"
    rows = lambda n: spark.range(n).selectExpr("id as doc_id", "'d' as digest")
    held = lambda *v: (manifest.load(spark, path, schema, *v)[0].count(), *manifest.load(spark, path, schema, *v)[1:])
    assert held(1, "a") == (0, "missing", 0)
    assert manifest.save(rows(3), path, 1, "a", after=0) == 1
    assert held(1, "a") == (3, "ok", 1) and held(2, "a") == (0, "schema", 1) and held(1, "b") == (0, "ingest", 1)
    # a run that dies while it writes its table, or its commit
    rows(9).write.parquet(f"{path}/versions/dead")
    (tmp_path / "m" / "commits" / ".x.tmp").write_text('{"number": 7, "folder"')
    (tmp_path / "m" / "commits" / "000000000002.json").write_text('{"number": 2, "fol')
    assert held(1, "a") == (3, "ok", 1)
    os.remove(tmp_path / "m" / "commits" / "000000000002.json")
    with pytest.raises(manifest.Conflict):
        manifest.save(rows(4), path, 1, "a", after=0)
    assert held(1, "a") == (3, "ok", 1)
    assert manifest.save(rows(5), path, 1, "a", after=1) == 2 and held(1, "a") == (5, "ok", 2)
    assert manifest.prune(spark, path, 1) == 3 and held(1, "a") == (5, "ok", 2)
    assert manifest.prune(spark, str(tmp_path / "none")) == 0


# ----------------------------------------------------------------------- logs


@pytest.mark.parametrize("size", ["64", "1m"])
def test_records_across_the_parts_of_a_file(spark, tmp_path, size):
    rng = random.Random(1)
    whole = [f"2024-01-{k % 28 + 1:02d} 10:00:{k % 60:02d} {rng.choice(['INFO', 'WARN', 'oops'])} agent=a{k % 3} message {k}" + "".join(f"\n  more {rng.random()}" for _ in range(rng.randrange(5))) + ("\n" if k % 9 == 0 else "") for k in range(120)]
    (tmp_path / "a.log").write_text("left over\nlines\n" + "\n".join(whole) + "\n")
    (tmp_path / "b.log").write_text("\n".join(whole[:7]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = logs.read(spark, str(tmp_path), "team").collect()
        parts = logs.records(spark, str(tmp_path), "^2024").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 0
    texts = {(r.file[-5:], r.record): r for r in got}
    assert [texts["a.log", k + 1].text for k in range(120)] == whole and [texts["b.log", k + 1].text for k in range(7)] == whole[:7]
    assert texts["a.log", 0].error == "no start" and texts["a.log", 0].text == "left over\nlines"
    assert all((r.error == "cut off") == ("oops" in r.text) for r in got if r.record) and {r.agent for r in got if r.record} == {"a0", "a1", "a2"}


def test_formats(spark, tmp_path):
    texts = {
        "evaluation": '{\n "summary": {"matched_count": 5, "g_score": 0.5,\n "exact_match_rate": 0.25}\n}\n{\n "summary": {"total_cases"',
        "matrix": '{"leaderboard_summary": {"team_name": "T", "rank": 3, "s": 0.5}, "summary": {"current_g": 0.25}}\n{"summary": {}}',
        "benchmark": "# One\n- F_beta: **0.91**\n- orphan rate 0.1\n- slot_recall: 1.0\n- cases: 12\n\n# Two\nnothing",
        "judge": '{"case_id": "c1", "judge_result": {"verdict": "PASS", "scores": {"accuracy": 4}}}\n{"case_id": "c2"}\n{broken',
        "team": "[2024-05-01T10:00:00] ERROR agent=x it broke\nTraceback\n2024-05-01 10:00:01 nothing",
    }
    got = {}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        got[name] = logs.read(spark, str(tmp_path / name), name).orderBy("record").collect()
    assert [(r.total_cases, r.grounding, r.exact, r.error) for r in got["evaluation"]] == [(5, 0.5, 0.25, None), (None, None, None, "not JSON")]
    assert [(r.team, r["rank"], r.s, r.g, r.error) for r in got["matrix"]] == [("T", 3, 0.5, 0.25, None), (None, None, None, None, "cut off")]
    assert [(r.title, r.f_beta, r.orphan_rate, r.slot_recall, r.cases, r.error) for r in got["benchmark"]] == [("One", 0.91, 0.1, 1.0, 12, None), ("Two", None, None, None, None, "cut off")]
    assert [(r.case_id, r.verdict, r.accuracy, r.error) for r in got["judge"]] == [("c1", "PASS", 4.0, None), ("c2", None, None, "cut off"), (None, None, None, "not JSON")]
    assert [(r["at"], r.level, r.agent, r.message, r.error) for r in got["team"]] == [("2024-05-01T10:00:00", "ERROR", "x", "agent=x it broke", None), ("2024-05-01 10:00:01", None, None, None, "cut off")]


# ------------------------------------------------------------------- compile


def test_compiled_records(spark):
    pages = [
        (1, 2, "Corrected date: 5 May 2021\nIssued by: Late Office"), (1, 1, "\n 12 \n Data Law \nLaw No. 4 of 2019. Issued by: First Office"), (1, 3, "Law No. 4 of 2019 may be cited as the Data Act"), (1, 4, None),
        (2, 1, "ABC 1/2020 Smith v Jones\nClaimant: A Firm\nRespondent: B Firm\nClaimant: A Firm"), (2, 2, "Before Justice Ann Lee. It is ordered that costs follow. See ABC 1/2020 and XY 9/2001"),
        (3, 1, None), (4, 1, "Memo\nwe note this practice direction"),
    ]
    got = {r.doc: r for r in compiling.compile_records(spark.createDataFrame(pages, "doc long, page long, text string")).collect()}
    law, case = got[1], got[2]
    assert (law.type, law.title, law.n_pages) == ("law", "Data Law", 4) and law.fields["number"].value == "4" and law.fields["number"].pages == [1, 3] and law.fields["year"].value == "2019"
    assert law.fields["date"].value == "5 May 2021" and law.fields["date"]["pass"] == 2 and law.fields["issued_by"].value == "First Office" and law.fields["issued_by"].pages == [1] and law.fields["short_title"].value == "Data Act"
    assert case.type == "case" and [x.value for x in case.lists["parties"]] == ["A Firm", "B Firm"] and [(x.value, x.pages) for x in case.lists["cites"]] == [("ABC 1/2020", [1, 2]), ("XY 9/2001", [2])]
    assert case.fields["outcome"].value == "costs follow" and case.lists["judges"][0].value == "Ann Lee"
    assert (got[3].type, got[3].title, got[3].fields, got[3].lists) == ("other", "", {}, {}) and got[4].type == "practice_direction"
