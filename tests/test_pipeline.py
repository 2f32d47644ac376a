from corvane import cli
from corvane.operators.chunking import chunk_documents
from corvane.plans import pipeline
from corvane.sources import store

FILES = {
    "about.md": "---\ntitle: About\ndate: 2024-05-01\n---\nAnn Lee has been programming for 12 years. She worked for Acme and Globex.\n\n## Skills\n\nSkills: Rust, Spark and SQL",
    "posts/shuffle.md": "---\ntitle: Shuffle notes\n---\nA shuffle moves rows between executors. Shuffle files are written to disk before they are read.",
    "posts/cooking.md": "---\ntitle: Cooking\n---\nPasta needs water, salt and patience. The sauce needs tomatoes.",
}


def test_index_search_answer(spark, tmp_path, capsys):
    root, out = tmp_path / "site", str(tmp_path / "index")
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    cli.main(["index", str(root), "--output", out, "--coarse-chunk-size", "512", "--summary-lane", "--qa", "--claims"], spark)
    chunks = store.read_lane(spark, out, "chunks")
    ids = sorted(r["chunk_id"] for r in chunks.select("chunk_id").collect())
    assert ids == list(range(len(ids))) and {r["granularity"] for r in chunks.collect()} == {"fine", "coarse", "summary"}
    asked = spark.createDataFrame([("a", "shuffle executors"), ("b", "Who has Ann worked for?")], "query_id string, query string")
    for mode in pipeline.MODES:
        found = pipeline.search(spark, out, asked, mode, "chunks", 3)["chunks"]
        assert found.filter("query_id = 'a' and rank = 1").first()["url"] == "/posts/shuffle/"
    assert set(pipeline.search(spark, out, asked, "keyword", "all", 3)) == {"chunks"}
    pages, answers = pipeline.search_with_answer(spark, out, asked, 2026.0)
    assert pages.filter("query_id = 'a'").groupBy("url").count().filter("count > 1").isEmpty()
    text = {r["query_id"]: r["text"] for r in answers.collect()}
    assert "Acme" in text["b"] or "Globex" in text["b"]
    cli.main(["qa-corpus", out, str(tmp_path / "qa")], spark)
    assert spark.read.text(str(tmp_path / "qa")).count() == 1 + store.read_lane(spark, out, "qa").count()
    bare = str(tmp_path / "bare")
    cli.main(["index", str(root), "--output", bare], spark)
    for name in ("qa", "claims"):  # drawn anew from the chunks
        cli.main([f"{name}-corpus", bare, str(tmp_path / f"new-{name}")], spark)
        assert spark.read.text(str(tmp_path / f"new-{name}")).count() == 1 + store.read_lane(spark, out, name).count()
    cli.main(["search", out, "shuffle", "--top-k", "2", "--answer"], spark)
    assert "/posts/shuffle/" in capsys.readouterr().out


def test_tune(spark):
    docs = spark.createDataFrame([(1, "t", "/a/", None, "# A\nspark shuffle\n# B\npasta"), (2, "u", "/b/", None, "tomato sauce")], "doc_id long, title string, url string, date string, body string")
    suite = spark.createDataFrame([("1", "pasta", ["pasta"], [], 2.0, None), ("2", "sauce", [], ["nothing"], 1.0, 1)], "case_id string, query string, must_match_any array<string>, must_include_all array<string>, weight double, top_k int")
    best = pipeline.tune(docs, suite, [64, 128], [0, 2], mode="keyword").collect()
    assert [(r["chunk_size"], r["overlap"]) for r in best] == [(64, 0), (64, 2), (128, 0), (128, 2)]
    assert best[0]["passed"] == 1 and best[0]["score"] == 2.0 and chunk_documents(docs).count() == 3


def test_tune_gives_each_case_its_own_number_of_hits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", f"/{i}/", None, "pasta" + " last" * (i == 59)) for i in range(60)], "doc_id long, title string, url string, date string, body string")
    suite = spark.createDataFrame([("1", "pasta", [], ["pasta last"], 1.0, 60), ("2", "pasta", [], ["pasta last"], 1.0, None)], "case_id string, query string, must_match_any array<string>, must_include_all array<string>, weight double, top_k int")
    best = pipeline.tune(docs, suite, [64], [0], mode="keyword").collect()
    assert [(r["total"], r["passed"]) for r in best] == [(2, 1)]
    asked, retrieve = [], pipeline.retrieve
    monkeypatch.setattr(pipeline, "retrieve", lambda lanes, queries, mode, k, make: asked.append((mode, k)) or retrieve(lanes, queries, mode, k, make))
    assert pipeline.tune(docs, suite, [64], [0]).count() == 1 and asked == [("hybrid", 5), ("hybrid", 60)]
