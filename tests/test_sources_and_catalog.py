import pytest
from pyspark.sql import functions as F

from evistrata.operators import catalog as C
from evistrata.operators import runs
from evistrata.sources import bibliography as B
from evistrata.sources import ledgers as L


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_catalog_fixture(spark):
    collections = spark.createDataFrame([(1, "Theme", None), (2, "Subtheme", 1), (3, "Empty", 1)], "collection_id bigint, name string, parent_id bigint")
    items = spark.createDataFrame([(101, 2), (102, 2)], "item_id bigint, collection_id bigint")
    attachments = spark.createDataFrame([(102, 101, "K1", "storage:mock.pdf", "application/pdf", 1)], "item_id bigint, parent_id bigint, key string, path string, content_type string, seq bigint")
    notes = spark.createDataFrame([], "item_id bigint, parent_id bigint")
    files = spark.createDataFrame([("/lib/storage/K1/mock.pdf",)], "path string")
    resolved = C.resolve_attachments(C.attachment_candidates(attachments, "/lib"), files)
    found = C.item_attachment(attachments, resolved)
    members = C.parent_items(items, attachments, notes)
    paths = C.collection_paths(collections)
    assert rows(C.collection_coverage(paths, members, found).select("name", "total", "has_attachment", "missing"), "name") == [("Theme > Subtheme", 1, 1, 0)]
    assert C.find_collections(paths, "Theme > Subtheme").first().collection_id == 2
    fields = C.item_fields(spark.createDataFrame([(101, "title", "<b>T</b>"), (101, "DOI", "10.1/x")], "item_id bigint, field string, value string"))
    authors = C.item_authors(spark.createDataFrame([(101, 1, "Roe", None), (101, 0, "Smith", "John")], "item_id bigint, order_index int, last string, first string"))
    paper = C.catalog_papers(members.select("item_id"), fields, authors, found).first()
    assert (paper.title, paper.authors, paper.doi, paper.pdf_available) == ("T", "Smith, John; Roe", "10.1/x", True)


def test_attachment_paths(spark):
    data = [(1, "storage:a.pdf"), (2, "/abs/b.pdf"), (3, "attachments:sub/test.pdf"), (4, "attachments:sub\\test.pdf"), (5, "C:\\path\\to\\file.pdf"), (6, "c:/gone.pdf"), (7, "relative.pdf")]
    a = spark.createDataFrame([(i, 100 + i, f"K{i}", p) for i, p in data], "item_id bigint, parent_id bigint, key string, path string")
    files = spark.createDataFrame([(p,) for p in ("/z/storage/K1/a.pdf", "/abs/b.pdf", "/linked/sub/test.pdf", "/second/to/file.pdf")], "path string")
    candidates = C.attachment_candidates(a, "/z", "/linked", [("C:\\path\\", "/first/"), ("c:/PATH/", "/second/")])
    got = dict(rows(C.resolve_attachments(candidates, files).select("item_id", "full_path"), "item_id"))
    assert got == {1: "/z/storage/K1/a.pdf", 2: "/abs/b.pdf", 3: "/linked/sub/test.pdf", 4: "/linked/sub/test.pdf", 5: "/second/to/file.pdf"}


ARTICLE = """<PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><Journal><JournalIssue><PubDate><Year>2025</Year></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>A <i>mock</i> title.</ArticleTitle><Abstract><AbstractText Label="OBJECTIVE">To test <b>XML</b> parsing.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>John</ForeName></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1234/mock.doi</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.9/x</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>"""


def test_article_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<PubmedArticleSet>\n{ARTICLE}\n{ARTICLE.replace(">12<", ">13<")}\n</PubmedArticleSet>\n')
    got = B.read_articles(spark, str(tmp_path)).orderBy("pmid").collect()
    assert [r.pmid for r in got] == ["12", "13"]
    r = got[0]
    assert (r.title, r.year, r.doi, r.abstract, r.journal, [a.name for a in r.authors]) == ("A mock title.", 2025, "10.1234/mock.doi", "OBJECTIVE: To test XML parsing.", "J", ["Doe John"])


def test_ris_never_writes_pmid_as_doi(spark):
    none = F.lit(None).cast("string")
    def entry(doi):
        return spark.range(1).select(B.ris_entry(F.lit(1), F.lit("T"), F.array(F.lit("A")), F.lit(2020), F.lit(doi), F.lit("J"), none, none, none, F.lit("rag; screen:A; score:7"))).first()[0]

    assert "DO  - " not in entry("PMID:9") and "DO  - 10.1/x" in entry("10.1/x") and entry("10.1/x").count("KW  - ") == 3


def test_ledger_files(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "id bigint, note string"
    assert L.read_jsonl(spark, path, schema).count() == 0
    L.append(spark.createDataFrame([(1, "a")], schema), path)
    L.append(spark.createDataFrame([(2, None)], schema), path)
    assert rows(L.read_jsonl(spark, path, schema), "id") == [(1, "a"), (2, None)]


def test_publishing_never_touches_what_is_read(spark, tmp_path):
    base = str(tmp_path / "artifact")
    L.publish(spark.range(3), base, "r1")
    first = L.read_published(spark, base)
    L.publish(first.filter("id > 0"), base, "r2")
    assert first.count() == 3 and L.read_published(spark, base).count() == 2


def test_csv_import(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\ufeffid,status,why\nR1, include ,\nR2,exclude,wrong_outcome\n", encoding="utf-8")
    path = str(tmp_path / "in.csv")
    got = L.import_csv(spark, path, {"record_id": "id", "decision": "status", "reason_code": "why"}, ["record_id", "decision"])
    assert rows(got, "record_id") == [("R1", "include", ""), ("R2", "exclude", "wrong_outcome")]
    with pytest.raises(ValueError):
        L.import_csv(spark, path, {"record_id": "id", "decision": "nope"})
    with pytest.raises(ValueError):
        L.import_csv(spark, path, {"record_id": "id"}, ["record_id", "decision"])


def test_result_files_skip_corrupt_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc": 1,\n "findings": [{"claim": "x"}]}')
    (tmp_path / "b.json").write_text('{"doc": 2, "findings": [')
    got = L.read_results(spark, str(tmp_path), "doc bigint, findings array<struct<claim:string>>")
    assert rows(got.select("doc", F.col("findings")[0]["claim"]), "doc") == [(1, "x")]


def test_fingerprints(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    prints = L.file_fingerprints(spark, str(tmp_path)).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "fingerprint")
    wanted = spark.createDataFrame([("a.bin",), ("b.bin",)], "path string")
    assert rows(L.with_fingerprints(wanted, prints), "path") == [("a.bin", hashlib.sha256(b"abc").hexdigest()), ("b.bin", "missing")]


def test_text_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.md").write_text("no")
    assert [r.text for r in L.read_texts(spark, str(tmp_path)).collect()] == ["one\ntwo\n"]


def test_drift_and_pending(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "name string, value string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "name string, value string")
    assert rows(runs.config_drift(old, new).select("name", "change"), "name") == [("b", "changed"), ("d", "added")]
    assert rows(runs.pending(old.select("name"), new.select("name").filter("name = 'a'"), ["name"]), "name") == [("b",), ("c",)]


def test_batches_of_fifty(spark):
    b = B.upsert_batches(spark.range(120).select(F.col("id").alias("seq"), F.lit("x").alias("item")))
    assert rows(b.select("batch", F.size("payload")), "batch") == [(1, 50), (2, 50), (3, 20)]
