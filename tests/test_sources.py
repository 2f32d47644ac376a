import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunking, evaluate, lexical
from corvane.sources import content, settings, store
from corvane.streaming.ingest import current, ingest_documents

FILES = {
    "posts/toml.md": '+++\ntitle = "A title"\ndate = "2024-01-02"\ndescription = "d"\ntags = ["x", "y"]\n+++\nBody **here**\n',
    "posts/_index.md": "---\ntitle: \"Section\"\ntags: [a, 'b']\nempty:\nnext: value\n---\nText {{< note >}}",
    "draft.md": "---\ndraft: true\n---\nno",
    "open.md": "---\ntitle: x\nno end",
    "broken.md": "+++\ntitle = \n+++\nx",
    "Plain-file.MD": "only text",
    "blank.md": "---\ntitle: b\n---\n  \n",
    "notes.txt": "skipped",
}


@pytest.fixture()
def site(tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    return tmp_path


def test_hugo_folder(spark, site):
    docs, errors = content.parse_files(content.read_files(spark, str(site)), "hugo")
    got = {r["source_path"]: r for r in docs.collect()}
    assert set(got) == {"posts/toml.md", "posts/_index.md", "Plain-file.MD"}
    t = got["posts/toml.md"]
    assert (t["title"], t["url"], t["date"], t["description"], t["tags"], t["body"]) == ("A title", "/posts/toml/", "2024-01-02", "d", ["x", "y"], "Body **here**")
    assert (got["posts/_index.md"]["url"], got["posts/_index.md"]["tags"], got["posts/_index.md"]["body"]) == ("/posts/", ["a", "b"], "Text")
    assert got["Plain-file.MD"]["title"] == "Plain file"
    assert {r["source_path"] for r in errors.collect()} == {"open.md", "broken.md"}
    stats = content.content_stats(spark, str(site)).first()
    assert stats["files"] == len(FILES) and stats["bytes"] == sum(len(b) for b in FILES.values())


@pytest.mark.parametrize("cms,path,front,url", [("jekyll", "_posts/2026-01-15-hi.md", "title: t", "/2026/01/15/hi/"), ("jekyll", "a.md", "permalink: /blog/hello", "/blog/hello/"), ("docusaurus", "a.md", "slug: x/y", "/x/y/"), ("eleventy", "a/README.md", "title: t", "/a/"), ("mkdocs", "index.md", "title: t", "/"), ("astro", "p.mdx", "title: t", "/p/")])
def test_other_profiles(spark, cms, path, front, url):
    files = spark.createDataFrame([(path, f"---\n{front}\n---\nimport a;\nBody")], "source_path string, content string")
    docs, _ = content.parse_files(files, cms)
    row = docs.first()
    assert row["url"] == url and ("import" in row["body"]) == (cms != "astro")


def test_even_sample(spark):
    df = spark.range(10).toDF("x")
    assert sorted(r["x"] for r in content.even_sample(df, ["x"], 4).collect()) == [int(i * 2.5) for i in range(4)]
    assert content.even_sample(df, ["x"], 20).count() == 10


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "spark shuffle"), (2, "pasta")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    store.write_index(str(tmp_path), "m", 2, chunks=docs, postings=lexical.postings(docs, "chunk_id"), doc_len=lexical.lengths(docs, "chunk_id"), vectors=vectors)
    assert store.read_manifest(spark, str(tmp_path))["model_id"] == "m"
    assert store.read_lane(spark, str(tmp_path), "postings").count() == 3
    with pytest.raises(ValueError):
        store.read_lane(spark, str(tmp_path), "qa")
    with pytest.raises(Exception):
        store.write_index(str(tmp_path / "b"), "m", 3, vectors=vectors)


def test_small_files(spark, tmp_path):
    p = tmp_path / "edits.toml"
    p.write_text('[[add]]\nsubject = "S"\npredicate = "p"\nobject = "o"\n[[redact]]\ncontains = "x"\n')
    adds, rules = settings.read_claim_edits(spark, str(p))
    assert adds.first()["object"] == "o" and rules.first()["contains"] == "x"
    p = tmp_path / "suite.json"
    p.write_text(json.dumps({"name": "n", "cases": [{"id": "1", "query": "q", "must_match_any": ["a"]}, {"id": "2", "query": "r", "must_include_all": ["b"], "weight": 2.0, "user_rating": 1}]}))
    assert [r["weight"] for r in settings.read_suite(spark, str(p)).orderBy("place").collect()] == [1.0, 2.0]
    p.write_text(json.dumps({"name": "n", "cases": [{"id": "1", "query": " "}]}))
    with pytest.raises(ValueError):
        settings.read_suite(spark, str(p))
    p = tmp_path / "queries.json"
    p.write_text(json.dumps({"dataset_id": "d", "queries": [{"query": "x"}, {"query": " "}, {"id": "z", "query": "y"}]}))
    assert [r["query_id"] for r in settings.read_queries(spark, str(p)).orderBy("query").collect()] == ["q001", "z"]
    p = tmp_path / "labels.toml"
    p.write_text('[[labels]]\ndataset = "d"\nquery_id = "q"\nrelevant_urls = ["https://h/A/"]\nweight = 0\n[labels.graded_urls]\n"/b" = 3\n"/c" = 0\n')
    assert {(r["url"], r["grade"], r["weight"]) for r in settings.read_labels(spark, str(p)).collect()} == {("/a", 1.0, 1.0), ("/b", 3.0, 1.0)}
    p = tmp_path / "cache.jsonl"
    p.write_text('{"key": "a", "v": 1}\nbroken\n{"key": "a", "v": 2}\n')
    assert [json.loads(r["value"])["v"] for r in settings.read_judgements(spark, str(p)).collect()] == [2]
    assert settings.number_list("3,1,3") == [1, 3]
    with pytest.raises(ValueError):
        settings.number_list("0")


def test_evaluation(spark):
    cases = spark.createDataFrame([("1", ["Alpha", "beta"], [], 1.0), ("2", [], ["missing"], 2.0), ("3", [" "], [], 1.0)], "case_id string, must_match_any array<string>, must_include_all array<string>, weight double")
    context = spark.createDataFrame([("1", "some  BETA here"), ("2", "x")], "case_id string, context string")
    done = {r["case_id"]: r for r in evaluate.evaluate_cases(cases, context).collect()}
    assert done["1"]["passed"] and done["1"]["matched_any"] == "beta"
    assert not done["2"]["passed"] and done["2"]["missing_all"] == ["missing"] and done["3"]["passed"]
    results = spark.createDataFrame([("q", "/x/", 1), ("q", "https://h/A", 2), ("q", "/a/", 3)], "query_id string, url string, rank int")
    labels = spark.createDataFrame([("q", "/a", 1.0), ("q", "/z", 0.0)], "query_id string, url string, grade double")
    row = evaluate.relevance_metrics(results, labels).first()
    assert (row["first_rank"], row["mrr"], row["hit_at_1"], row["hit_at_3"]) == (2, 0.5, 0.0, 1.0)


def test_streaming_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "t", "/u/", None, "# A\nhello spark")], "doc_id long, title string, url string, date string, body string")
    docs.write.parquet(source)
    ingest_documents(spark, source, "doc_id long, title string, url string, date string, body string", target, str(tmp_path / "cp")).awaitTermination()
    docs.withColumn("doc_id", docs.doc_id + 1).write.mode("append").parquet(source)
    ingest_documents(spark, source, "doc_id long, title string, url string, date string, body string", target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target + "/chunks").count() == 2
    docs.withColumn("body", F.lit("# A\nhello again world")).write.mode("append").parquet(source)
    ingest_documents(spark, source, "doc_id long, title string, url string, date string, body string", target, str(tmp_path / "cp")).awaitTermination()
    assert {r["doc_id"]: "again" in r["text"] for r in current(spark, target, "chunks").collect()} == {1: True, 2: False}
    assert current(spark, target, "doc_len").count() == 2 and current(spark, target, "postings").filter("term = 'spark'").count() == 1
    assert chunking.chunk_documents(docs).count() == 1
