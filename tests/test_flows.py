"""Tables from file to commit, documents from text to records, the command line, the service."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from rinsework import cli, exports
from rinsework.operators import entities, governance, loss, relations
from rinsework.plans import flow
from rinsework.plans.ir import Step
from rinsework.service import Service, make_token, read_token, serve
from rinsework.sources import documents
from rinsework.sources.versions import VersionStore

TEXT = """# CUSTOMERS

Customer Name: Rajesh Kumar
Phone: 9876543210
Email: Rajesh.Kumar@Acme.com
City: Hyd
State: Telengana
Joined: 15/03/2024
Invoice Number: INV-9988
Balance: $4,500.00

Customer Name: Rajesh Kumarr
Phone: +91-98765-43210
City: Hyderabad
Address: 12 Park Street

Customer Name: Sarah Jenkins
Email: sjenkins@techcorp.io
City: San Francisco
Date: 2024-01-05

| Name | Phone | City |
|---|---|---|
| Priya Sharma | 8765432109 | Pune |
"""


@pytest.fixture(scope="module")
def found(spark):
    return entities.dedupe(entities.extract(spark.createDataFrame([("d", 1, TEXT)], "doc_id string, page int, text string"), skip_tables=True)).persist()


def values(df, kind, column="normalized_value"):
    return sorted(r[column] for r in df.filter(df.type == kind).collect())


def test_entities(found):
    assert values(found, "Email") == ["rajesh.kumar@acme.com", "sjenkins@techcorp.io"]
    assert values(found, "CustomerName") == ["Rajesh Kumar", "Rajesh Kumarr", "Sarah Jenkins"]
    assert "San Francisco" in values(found, "City") and "Hyderabad" in values(found, "City")
    assert values(found, "State") == ["Telangana"] and values(found, "Date") == ["2024-01-05", "2024-03-15"]
    assert "$4,500.00" in values(found, "Amount") and "12 Park Street" in values(found, "Address") and values(found, "InvoiceNo") != []
    for r in found.collect():
        assert TEXT[r.span_start : r.span_end].strip() == r.value
    assert found.select("entity_id").distinct().count() == found.count()


def test_links_and_issues(found):
    edges = relations.link(found)
    clusters = {r.name: r.attributes for r in relations.clusters(found, edges).collect()}
    assert clusters["Rajesh Kumar"]["Email"] == ["rajesh.kumar@acme.com"] and "Email" not in clusters["Rajesh Kumarr"]
    assert clusters["Sarah Jenkins"]["City"] == ["San Francisco"]
    issues = relations.issues(found, relations.clusters(found, edges))
    kinds = {(r.type, r.field) for r in issues.collect()}
    assert {("missing", "Email"), ("missing", "Phone"), ("duplicate", "CustomerName"), ("format_inconsistent", "Date"), ("semantic", "City"), ("semantic", "State")} <= kinds
    wide = {r.name: r for r in relations.records(found, edges).collect()}
    assert wide["Rajesh Kumar"].State == "Telangana" and wide["Sarah Jenkins"].State == "California"


def test_page_proximity(spark):
    rows = [("d", t, v, v, a, a + 2, 1, r, 0.9, f"{t}{a}") for t, v, a, r in [("CustomerName", "A B", 0, "r1"), ("CustomerName", "C D", 1000, "r2"), ("Phone", "1", 200, None), ("Email", "x", 1300, "r3"), ("City", "Pune", 600, None), ("Date", "z", 1001, "r2")]]
    df = spark.createDataFrame(rows, "doc_id string, type string, value string, normalized_value string, span_start int, span_end int, page int, record_id string, confidence double, entity_id string")
    got = {(r.source_id, r.target_id): r.confidence for r in relations.link(df).collect()}
    assert got == {("CustomerName0", "Phone200"): 0.88, ("CustomerName1000", "Email1300"): 0.88, ("CustomerName1000", "Date1001"): 0.98}
    alone = relations.link(df.filter("entity_id <> 'CustomerName1000'"))
    assert {r.target_id: r.confidence for r in alone.collect()} == {"Phone200": 0.95, "Email1300": 0.95, "City600": 0.95, "Date1001": 0.95}


def test_risk_table(spark):
    rows = [("conflict", "City"), ("duplicate", "Phone"), ("format_inconsistent", "Phone"), ("semantic", "City"), ("format_inconsistent", "Date"), ("missing", "Email"), ("invalid", "Email")]
    issues = spark.createDataFrame([("d", t, f, None, None, "low", "", f"i{n}") for n, (t, f) in enumerate(rows)], "doc_id string, type string, field string, current_value string, other_value string, severity string, evidence string, issue_id string")
    got = [(r.loss_score, r.risk_level, r.is_reversible, r.is_blocked, r.requires_approval) for r in governance.recommend(issues).orderBy("issue_id").collect()]
    assert got == [(0.9, "high", False, True, True), (0.5, "medium", True, False, True), (0.2, "low", True, False, False), (0.15, "low", True, False, False), (0.1, "low", True, False, False), (0.35, "medium", True, False, True), (0.15, "low", True, False, True)]
    people = governance.Approvals(all_but_high_risk=True)
    people.reject("i3", "no")
    people.approve("i0")
    decided = people.decide(governance.recommend(issues))
    assert governance.Approvals.summary(decided).first().asDict() == {"total": 7, "approved": 6, "rejected": 1, "pending": 0, "automatic": 3}


def test_documents(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text(TEXT.replace("Rajesh Kumar\n", "Rajesh\x00 Kumar\n"))
    docs = documents.read_documents(spark, str(folder)).persist()
    d = docs.first()
    assert d.doc_id == "a" and d.headings[0].title == "CUSTOMERS" and d.tables[0].header == ["Name", "Phone", "City"] and "\x00" not in d.text
    assert {(r.column_name, r.value) for r in documents.table_cells(docs).collect()} == {("Name", "Priya Sharma"), ("Phone", "8765432109"), ("City", "Pune")}
    store = VersionStore(spark, str(tmp_path / "store"))
    done = flow.clean_documents(spark, documents.texts(docs), docs, governance.Approvals(all_but_high_risk=True), store)
    assert [e["operation"] for e in reversed(store.history())] == ["EXTRACT", "NORMALIZE", "RESOLVE_AND_DEDUPLICATE", "VALIDATE"]
    assert "Priya Sharma" in {r.name for r in done.records.collect()}
    assert done.validation["bad_dates"] == done.validation["repeats"] == done.validation["types_lost"] == 0
    assert store.restore(0) == 4 and store.read().count() == store.read(0).count()
    files = exports.export_all(done, str(tmp_path / "out"))
    assert "## Validation" in open(files["report"]).read() and json.load(open(files["json"]))
    import zipfile

    with zipfile.ZipFile(files["xlsx"]) as z:
        assert z.testzip() is None and sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 4
    assert documents.rejected(spark, str(folder)).count() == 0 and documents.read_documents(spark, str(folder), most=10).count() == 0


def test_other_documents(tmp_path):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'Heading1')}{p('One')}{p('Two')}<w:tbl>{row('Item', 'Qty', 'Item')}{row('a', '1', 'b')}</w:tbl></w:body></w:document>")
    own = documents.parse("x.docx", buffer.getvalue())
    assert own["headings"] == [{"title": "Title", "level": 1, "section": 0}] and own["tables"][0]["header"] == ["Item", "Qty", "Item_2"] and own["tables"][0]["rows"] == [["a", "1", "b"]]
    with pytest.raises(documents.UnsupportedFormat):
        documents.parse("x.odt", b"")
    with pytest.raises(ValueError):
        documents.parse("x.txt", b" " * (documents.MAX_BYTES + 1))
    assert documents.ocr(b"")["skipped"] and documents.ocr(b"x", lambda b: "t")["text"] == "t"


# ---- tables


def test_versions_of_a_plan(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 30, "Hyd"), (1, "a", 30, "Hyd"), (2, "b", -10, "Pune"), (3, "c", 150, "Hyd")], "id int, name string, age int, city string")
    steps = [Step(1, "ALL", "", "", "deduplicate_exact"), Step(2, "city", "", "", "standardize_values", {"mapping": {"Hyd": "Hyderabad"}}), Step(3, "age", "", "", "clamp_bounds", {"lower": 0, "upper": 120})]
    tried = flow.dry_run(df, steps)
    assert not (tmp_path / "s").exists() and tried.df.count() == 3
    store = VersionStore(spark, str(tmp_path / "s"))
    done = flow.execute(df, steps, store, filter_invalid=False)
    assert done.version == 3 and sorted(map(tuple, done.df.collect())) == [(1, "a", 30, "Hyderabad"), (2, "b", 0, "Pune"), (3, "c", 120, "Hyderabad")]
    assert sorted(map(tuple, store.read(0).collect())) == sorted(map(tuple, df.collect()))
    one = VersionStore(spark, str(tmp_path / "one"))
    assert flow.execute(df, steps, one, per_step=False).version == 1


def test_gate(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as double) as v", "case when id % 3 = 0 then 'bad' else concat('u', id, '@x.org') end as email")
    with pytest.raises(flow.Blocked) as e:
        flow.clean_table(df)
    assert e.value.report.volumetric == 0 or e.value.report.reasons
    found, done = flow.clean_table(df, limits=loss.Limits(volumetric=0.5, cosine=1, utility=False))
    assert done.loss.safe and found.plan.auto


CSV = "CustomerID,Age,Email,State,PostalCode\n1,30,a@b.co,Telangana,500081\n2,41,c@d.co,Telangana,500082\n2,41,c@d.co,Telangana,500082\n3,150,e@f.co,Telengana,500081\n4,35,g@h.co,Telangana,500082\n"


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "in.csv"
    source.write_text(CSV)
    argv = ["clean", str(source), "-o", str(tmp_path / "out.csv"), "--store", str(tmp_path / "store"), "--report-dir", str(tmp_path / "report"), "--auto-approve"]
    assert cli.main(argv) == 0
    out = spark.read.csv(str(tmp_path / "out.csv"), header=True, inferSchema=True)
    assert out.count() == 4 and out.agg({"Age": "max"}).first()[0] <= 120 and {r.State for r in out.collect()} == {"Telangana"}
    report = json.loads((tmp_path / "report" / "report.json").read_text())
    assert report["rows_in"] == 5 and (tmp_path / "report" / "provenance.html").exists() and (tmp_path / "report" / "suite.json").exists()
    assert cli.main(["clean", str(tmp_path / "none.csv"), "-o", "x"]) == 1
    lossy = tmp_path / "lossy.csv"
    lossy.write_text("name,email\n" + "".join(f"n{i},{'bad' if i % 2 else f'u{i}@x.org'}\n" for i in range(40)))
    assert cli.main(["clean", str(lossy), "-o", str(tmp_path / "x.csv")]) == 2 and not (tmp_path / "x.csv").exists()
    assert cli.main(["profile", str(source)]) == 0 and '"rows":5' in capsys.readouterr().out
    (tmp_path / "d.txt").write_text(TEXT)
    assert cli.main(["clean-document", str(tmp_path / "d.txt"), "-o", str(tmp_path / "docs")]) == 0 and (tmp_path / "docs" / "records.csv").exists()


# ---- service


def test_tokens():
    t = make_token("u", "admin", b"k" * 16)
    assert read_token(t, b"k" * 16)["role"] == "admin"
    for bad in (t + "x", "a.b", make_token("u", "admin", b"k" * 16, -5)):
        with pytest.raises(Exception, match="token"):
            read_token(bad, b"k" * 16)


def test_service(spark, tmp_path):
    with pytest.raises(ValueError):
        Service(spark, "x", b"short", lambda u, p: None)
    service = Service(spark, str(tmp_path), b"s" * 32, lambda u, p: {"ann": "admin", "bob": "auditor"}.get(u) if p == "pw" else None)
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None, token=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                raw = r.read().decode()
                return r.status, json.loads(raw) if r.headers["Content-Type"] == "application/json" else raw
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/healthz")[0] == 200 and call("/nowhere")[0] == 404
        assert call("/api/v1/auth/token", {"username": "ann", "password": "no"})[0] == 401
        ann, bob = (call("/api/v1/auth/token", {"username": u, "password": "pw"})[1]["access_token"] for u in ("ann", "bob"))
        rows = [{"ID": i, "Age": 30 + i, "City": "Hyd" if i % 2 else "Hyderabad"} for i in range(6)]
        assert call("/api/v1/clean", {"records": rows})[0] == 401 and call("/api/v1/clean", {"records": rows}, bob)[0] == 403
        assert call("/api/v1/clean", {"records": []}, ann)[0] == 400 and call("/api/v1/provenance", token=ann)[0] == 404
        status, said = call("/api/v1/clean", {"records": rows, "approve": True}, ann)
        assert status == 200 and {r["City"] for r in said["records"]} == {"Hyderabad"}
        assert call("/api/v1/provenance", token=bob)[1]["signature"]
        assert call("/api/v1/rollback", {"version": 0}, bob)[0] == 403
        status, back = call("/api/v1/rollback", {"version": 0}, ann)
        assert status == 200 and {r["City"] for r in back["records"]} == {"Hyd", "Hyderabad"} and call("/api/v1/rollback", {"version": 99}, ann)[0] == 404
        assert call("/api/v1/clean-document", {"filename": "a.exe", "text": "x"}, ann)[0] == 400 and call("/api/v1/clean-document", {"filename": "a.txt", "text": "x"}, bob)[0] == 403
        status, doc = call("/api/v1/clean-document", {"filename": "in/a.txt", "text": TEXT, "approve": True}, ann)
        assert status == 200 and doc["doc_id"] == "a" and doc["version"] == 3 and doc["entities"] and doc["records"]
        status, old = call("/api/v1/rollback-document", {"doc_id": "a", "version": 0}, ann)
        assert status == 200 and old["version"] == 4 and len(old["entities"]) >= len(doc["entities"]) and call("/api/v1/rollback-document", {"doc_id": "b"}, ann)[0] == 404
        assert 'requests_total{path="/api/v1/clean"}' in call("/metrics")[1]
    finally:
        server.shutdown()
