import io
import json
import sqlite3
import tarfile
import zipfile

from siltstone.sources import files as S
from siltstone.sources import stores as W


def test_readers(tmp_path):
    status, _, text, counts = S.read_delimited(b"a,b\n" + b"".join(b"%d,x\n" % i for i in range(25)))
    assert status == "sampled" and json.loads(counts) == {"columns": 2, "rows": 25, "truncated": True} and text.count("\n") == 10
    assert S.read_delimited(b"")[0] == "empty"
    status, _, text, counts = S.read_json_lines(b'{"a":1}\nbad\n{"b":2}\n\n')
    assert status == "sampled_with_errors" and json.loads(counts) == {"columns": 2, "errors": 1, "rows": 3}
    assert json.loads(S.read_json(b'{"k":[{"a":1},{"b":2}]}')[3]) == {"columns": 2, "rows": 2} and S.read_json(b"{")[0] == "invalid"
    assert S.read_subtitle(b"WEBVTT\n\nNOTE x\ny\n\n1\n00:01 --> 00:02\nHello <b>you</b>\n")[2:] == ("Hello you", '{"cues": 1}')
    mail = b"Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nContent-Type: text/plain; charset=utf-8\n\nbody\n"
    assert S.read_mail(mail)[1:3] == ("Grüße", "Subject: Grüße\nbody")
    assert json.loads(S.read_mail(b"From a\n" + mail + b"\nFrom b\n" + mail)[3])["messages"] == 2
    assert S.read_calendar(b"BEGIN:VEVENT\nSUMMARY:A long\n  title\\, here\nDTSTART;TZID=x:2024\nEND:VEVENT\n")[2] == "Summary: A long title, here\nStart: 2024"
    assert json.loads(S.read_report(b'<testsuite><testcase name="a"><failure/></testcase><testcase name="b"/></testsuite>')[3]) == {"failures": 1, "format": "junit", "tests": 2}
    assert json.loads(S.read_report(b'{"runs":[{"results":[{"ruleId":"r","message":{"text":"m"}}]}]}')[3])["results"] == 1
    assert json.loads(S.read_report(b"ok 1 a\nnot ok 2 b\n")[3])["failures"] == 1 and json.loads(S.read_report(b"SF:x\nLF:4\nLH:3\n")[3])["hit"] == 3
    assert S.read_report(b"<a")[0] == "invalid" and S.read_report(b"plain")[0] == "unsupported"
    path = tmp_path / "x.db"
    with sqlite3.connect(path) as c:
        c.execute("create table t (a int, b text)")
    assert S.read_database(path.read_bytes())[2] == "t: a, b" and S.read_database(b"no")[0] == "invalid"
    assert S.read_html(b"<title>T</title><script>x</script><p>a</p>b")[1:3] == ("T", "a\nb")
    assert S.sanitised_html('<a href="javascript:x" onclick="y">l</a><a href="https://e.example/?a=1&b=2">m</a><script>z</script>') == '<a>l</a><a href="https://e.example/?a=1&amp;b=2" rel="noopener">m</a>'


def test_containers():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "x")
        z.writestr("../evil.txt", "y")
    assert [(n, s) for n, s, _ in S.members(buffer.getvalue(), most=1)] == [("a.txt", "extracted"), ("../evil.txt", "over_member_cap")]
    assert [s for _, s, _ in S.members(buffer.getvalue(), most_bytes=0)] == ["over_size_cap", "unsafe_name"]
    assert [(n, s) for n, s, _ in S.members(buffer.getvalue())] == [("a.txt", "extracted"), ("../evil.txt", "unsafe_name")]
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as t:
        info = tarfile.TarInfo("b.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"z"))
    assert list(S.members(buffer.getvalue())) == [("b.txt", "extracted", b"z")]
    assert next(S.members(b"junk"))[1].startswith("invalid")


def test_scan_and_extract(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "src" / "a.py").write_text("x = 1\n")
    (root / "src" / "b.csv").write_text("a,b\n1,2\n")
    (root / "node_modules" / "c.py").write_text("y")
    (root / "d.bin").write_bytes(b"\x00\x01")
    (root / "bad.json").write_text("{")
    scanned = S.scan(spark, str(root), exclude=["node_modules/"])
    assert {(r["path"], r["kind"], r["tier"]) for r in scanned.collect()} == {("src/a.py", "code", "inline"), ("src/b.csv", "structured_data", "metadata_only"), ("d.bin", "binary", "metadata_only"), ("bad.json", "code", "inline")}
    manifest = scanned.where("path = 'src/a.py'").selectExpr("path", "size", "mtime_ns", "quick_hash", "'h' as content_hash")
    assert {r["path"] for r in S.unchanged(scanned, manifest).where("skip").collect()} == {"src/a.py"}
    got = {r["path"].rpartition("/")[2]: r["status"] for r in S.extract(S.contents(spark, str(root))).collect()}
    assert got == {"a.py": "extracted", "b.csv": "sampled", "c.py": "extracted", "d.bin": "metadata_only", "bad.json": "invalid"}


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "t"), ("b", 2, None)], "id string, n int, text string")
    docs = W.index_documents(rows, "chunks", "id", ["text"])
    assert {r["document_id"] for r in docs.collect()} == {"chunks--a", "chunks--b"}
    feed = spark.createDataFrame([("chunks--a", "remove", 2, None), ("chunks--a", "put", 1, "x"), ("chunks--c", "put", 1, "new")], "document_id string, operation string, at int, text string")
    assert {tuple(r) for r in W.apply_feed(docs, feed).collect()} == {("chunks--b", None), ("chunks--c", "new")}
    folder = str(tmp_path / "index")
    one = W.write_generation(docs, folder, "document_id")
    two = W.write_generation(docs.repartition(3), folder, "document_id")
    assert one["checksum"] == two["checksum"] and one["rows"] == 2
    W.activate(spark, folder, one)
    W.activate(spark, folder, two)
    assert W.read_current(spark, folder).count() == 2
    artifacts = spark.createDataFrame([("p1", b"same"), ("p2", b"same"), ("p3", b"other")], "path string, content binary")
    for _ in range(2):
        receipts = W.store_artifacts(artifacts, str(tmp_path / "cas"))
    assert receipts.select("sha256").distinct().count() == 2 and spark.read.parquet(str(tmp_path / "cas")).count() == 2
    W.export_pages(rows.withColumnRenamed("id", "title"), str(tmp_path / "wiki"), "title", "text")
    assert (tmp_path / "wiki" / "slug=a").is_dir()


def zipped(**entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), text)
    return buffer.getvalue()


def test_keys_are_never_decoded(spark):
    secret = b"-----BEGIN PRIVATE KEY-----\nc2VjcmV0\n-----END PRIVATE KEY-----\n"
    rows = [("a/x.pem", secret), ("a/x.KEY", b"plain"), ("a/id_rsa", secret), ("a/x.txt", b"  \n" + secret), ("a/x.p12", b"\x30"), ("a/y.txt", b"BEGIN of a note"), ("a/x.dwg", b"AC10"), ("a/none.pem", None)]
    got = {r["path"]: (r["status"], r["text"]) for r in S.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k: v for k, v in got.items() if k != "a/y.txt"} == {p: ("metadata_only", "") for p, _ in rows if p != "a/y.txt"}
    assert got["a/y.txt"] == ("extracted", "BEGIN of a note")


def test_every_mail_and_block_is_read(spark):
    box = b"".join(b"From x\nSubject: m%d\nFrom: a%d@b.example\n\nbody %d\n\n" % (i, i, i) for i in range(51))
    assert json.loads(S.read_mail(box)[3])["messages"] == 51 and "body 50" in S.read_mail(box)[2]
    rows = S.mail_messages(spark.createDataFrame([("in.mbox", box), ("one.eml", b"Subject: s\n\nt"), ("none.eml", None)], "path string, content binary")).collect()
    assert len(rows) == 52 and [(r["number"], r["subject"], r["sender"], r["text"]) for r in rows if r["path"] == "in.mbox"][50] == (51, "m50", "a50@b.example", "body 50")
    assert S.read_calendar(b"".join(b"BEGIN:VEVENT\nSUMMARY:e%d\nEND:VEVENT\n" % i for i in range(60)))[2].count("Summary") == 60
    assert S.read_report("\n".join(f"not ok {i} x" for i in range(1, 71)).encode())[2].count("not ok") == 70


def test_markup_by_blocks():
    page = "<html><head><title>A <b>B</b></title><style>x{}</style></head><body><h1>Top</h1><p>one <i>two</i>\n three<br>four<ul><li>a<li>b</ul><svg><title>no</title></svg><noscript>no</noscript>end &amp; all</body>"
    assert S.readable_html(page) == ("A B", "Top\none two three\nfour\na\nb\nend & all")
    assert S.readable_html("</p>x<script>y") == ("", "x") and S.readable_html("") == ("", "")
    assert S.sanitised_html("<p onclick=x>a &lt;b&gt;<object><p>no</p></object><iframe src=x></iframe>c</p>") == "<p>a &lt;b&gt;c</p>"


def test_office_packages():
    core = "<c xmlns:dc='d'><dc:title>Plan</dc:title></c>"
    word = zipped(word__document_xml="<w:d xmlns:w='w'><w:body><w:p><w:r><w:t>One </w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:d>", docProps__core_xml=core)
    assert S.read_word(word) == ("extracted", "Plan", "One \ttwo\ncell", '{"paragraphs": 2}')
    slides = zipped(**{f"ppt__slides__slide{n}_xml": f"<p:s xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>text {n}</a:t></a:r></a:p></p:s>" for n in (10, 2, 1)})
    assert S.read_slides(slides)[2] == "Slide 1\ntext 1\n\nSlide 2\ntext 2\n\nSlide 3\ntext 10"
    rows = "".join(f"<row><c r='A{i}'><v>{i}</v></c><c r='C{i}' t='s'><v>1</v></c></row>" for i in range(2, 20))
    book = zipped(xl__workbook_xml="<w><sheets><sheet name='Sums'/></sheets></w>", xl__sharedStrings_xml="<s><si><t>n</t></si><si><r><t>na</t></r><r><t>me</t></r></si></s>", xl__worksheets__sheet1_xml=f"<w><sheetData><row/><row><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>x</t></is></c><c r='C1' t='s'><v>1</v></c></row>{rows}</sheetData></w>")
    status, _, text, counts = S.read_workbook(book)
    assert status == "sampled" and json.loads(counts) == {"columns": 3, "rows": 18, "sheets": ["Sums"], "truncated": True}
    assert text.split("\n")[:2] == ["Columns: n, x, name", "Sums: n=2 | name=name"] and text.count("\n") == S.SAMPLE
    odt = zipped(content_xml="<o:d xmlns:o='o' xmlns:t='t'><o:text><t:h>Head</t:h><t:p>a <t:span>b</t:span></t:p></o:text></o:d>")
    assert S.read_open_document(odt)[2] == "Head\na b"
    epub = zipped(**{"META-INF__container_xml": "<c><rootfile full-path='o/b.opf'/></c>"}) and io.BytesIO()
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("META-INF/container.xml", "<c><rootfile full-path='o/b.opf'/></c>")
        z.writestr("o/b.opf", "<p xmlns:dc='d'><dc:title>Tale</dc:title><item id='1' href='one.html'/><item id='2' href='two.html'/><itemref idref='2'/><itemref idref='1'/></p>")
        z.writestr("o/one.html", "<p>first</p>")
        z.writestr("o/two.html", "<p>second</p>")
    assert S.read_epub(epub.getvalue())[1:3] == ("Tale", "second\n\nfirst")
    assert S.read_fiction_book(b"<f><d><book-title>T</book-title></d><body><p>a</p><section><p>b</p></section></body></f>")[1:3] == ("T", "a\nb")
    assert S.read_rich_text(b"{\\rtf1{\\fonttbl{\\f0 Arial;}}Caf\\'e9 \\b bold\\b0\\par next \\{x\\}}")[2] == "Caf\u00e9 bold\nnext {x}"
    assert S.read_diagram(b"<svg><title>T</title><text>a <tspan>b</tspan></text></svg>")[2] == "T\na b"


def test_pdf():
    import zlib

    shown = zlib.compress(rb"BT /F1 12 Tf 72 700 Td (Hello \(all\)) Tj 0 -14 Td [(Wor) 20 (ld) -300 (two)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj <</Type /Page /R <</a 1>> >> endobj\n2 0 obj <</Length " + str(len(shown)).encode() + b" /Filter /FlateDecode>>\nstream\n" + shown + b"\nendstream endobj"
    assert S.read_pdf(data) == ("extracted", "", "Hello (all)\nWorld two", '{"pages": 1}')
    assert S.read_pdf(b"%PDF-1.4\n1 0 obj <</Type /Page>>") == ("metadata_only", "", "", '{"pages": 1}') and S.read_pdf(b"x")[0] == "invalid"


def test_files_still_written_wait(spark):
    seen = "path string, size long, mtime_ns long"
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("gone", 1, 1)], seen)
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("new", 1, 1)], seen)
    assert [r["path"] for r in S.settled(before, after).collect()] == ["a"]


def test_spool(spark, tmp_path):
    from siltstone.sources import spool as L

    one = tmp_path / "ready" / "x1"
    (one / "attachments").mkdir(parents=True)
    (one / "manifest.json").write_text(json.dumps({"export_id": "x1", "subject": "s", "recipients": ["a", "b"], "exported_at_epoch": 7}))
    (one / "body.txt").write_text("body\n")
    (one / "attachments" / "b.pdf").write_bytes(b"1")
    (one / "attachments" / "a.txt").write_bytes(b"2")
    (tmp_path / "ready" / "x2").mkdir()
    (tmp_path / "ready" / "x2" / "body.txt").write_text("no manifest yet")
    rows = L.read_spool(spark, str(tmp_path)).collect()
    assert [(r["export_id"], r["recipients"], r["text_body"], r["html_body"], r["attachments"], r["exported_at_epoch"]) for r in rows] == [("x1", ["a", "b"], "body\n", None, ["a.txt", "b.pdf"], 7)]
    mails = spark.createDataFrame([("m.eml", b"Message-ID: <1@x>\nSubject: s\nFrom: f@x\nTo: a@x, b@x\nContent-Type: text/html\n\n<p>hi</p>"), ("n.eml", b"Subject: t\n\nplain"), ("o.eml", None)], "path string, content binary")
    first, again = ({tuple(r) for r in L.exported(mails, "p", "in").select("export_id", "subject", "text_body", "html_body").collect()} for _ in range(2))
    assert first == again and {r[1:] for r in first} == {("s", None, "<p>hi</p>"), ("t", "plain", None)}


def test_schemas(spark, sf):
    from siltstone.sources import schemas as H

    for name in H.TABLES:
        frame = spark.read.parquet(f"{sf}/{name}.parquet")
        assert [(f.name, f.dataType.simpleString()) for f in H.schema(name).fields] == [(f.name, f.dataType.simpleString()) for f in frame.schema.fields], name
    odd = spark.createDataFrame([("a", "x", "9"), ("b", "7", None)], "id string, usage_count string, more string")
    assert [(r["id"], r["usage_count"], r["title"]) for r in H.conform(odd, "episodes").orderBy("id").collect()] == [("a", None, None), ("b", 7, None)]
