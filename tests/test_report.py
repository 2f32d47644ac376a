import json

import numpy as np
import pytest

from corvane import cli
from corvane.operators import embed, ranking, report
from corvane.sources import content, settings, store


def test_report_of_a_folder(spark, tmp_path):
    (tmp_path / "index_runs.csv").write_text("dataset_id,model_id,run,size_tier,index_duration_s,index_size_bytes,model_cache_bytes,model_weights_bytes,dataset_file_count,dataset_doc_count,dataset_total_bytes\nb,m/x,1,large,4,1048576,0,0,3,2,2097152\na,m/x,1,small,2,0,,0,1,1,0\na,m/x,2,small,4,0,0,0,9,9,0\n")
    (tmp_path / "search_results.csv").write_text("dataset_id,model_id,latency_ms,relevance_labeled,mrr,hit_at_1\na,m/x,10,1,0.5,0\na,m/x,30,0,1,1\na,m/x,20,1,1,1\nz,m/x,1,1,1,1\n")
    cli.main(["report", str(tmp_path)], spark)
    text = (tmp_path / "report.md").read_text().split("\n")
    assert [line.split(" | ")[0] for line in text if line.startswith(("| a", "| b"))] == ["| a", "| b"] * 2
    table = report.benchmark_report(report.read_rows(spark, str(tmp_path / "index_runs.csv")), report.read_rows(spark, str(tmp_path / "search_results.csv")))
    rows = {r["dataset_id"]: r for r in table.collect()}
    assert set(rows) == {"a", "b"} and (rows["a"]["index_s"], rows["a"]["query_median_ms"], rows["a"]["query_p95_ms"], rows["a"]["labelled"], rows["a"]["mrr"]) == (3.0, 20.0, 30.0, 2, 0.75)
    assert (rows["b"]["query_median_ms"], rows["b"]["labelled"], rows["b"]["index_mb"]) == (0.0, 0, 1.0)
    report.write_rows(table.drop("place"), str(tmp_path / "out"))
    assert report.read_rows(spark, str(tmp_path / "out.csv")).count() == spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2
    with pytest.raises(FileNotFoundError):
        cli.main(["report", str(tmp_path / "none")], spark)


def test_judging(spark):
    hits = [(1, "T", "/u/", "s"), (2, "U", "/v/", "t")]
    rows = [("d", "m", "q1", "What?", "factual", ["x"], hits), ("d", "m", "q2", "Why?", None, None, []), ("d", "m", "q3", "How?", None, None, hits)]
    df = spark.createDataFrame(rows, "dataset_id string, model_id string, query_id string, query string, intent string, expected_terms array<string>, results array<struct<rank:int,title:string,url:string,snippet:string>>")
    reply = lambda ask: "no idea" if "Why?" in ask else 'Well: {"relevance_score": 4, "grounding_score": 3.5, "verdict": "good"}'
    done = {r["query_id"]: r for r in report.judge(df, reply).collect()}
    assert (done["q1"]["relevance_score"], done["q1"]["grounding_score"], done["q1"]["verdict"]) == (4.0, 3.5, "good")
    assert (done["q2"]["relevance_score"], done["q2"]["verdict"]) == (0.0, report.NO_VERDICT)
    known = spark.createDataFrame([(done["q1"]["key"],)], "key string")
    assert {r["query_id"] for r in report.judge(df, reply, known).collect()} == {"q2", "q3"}


def test_written_queries_and_excerpts(spark, tmp_path):
    docs = spark.createDataFrame([(f"p{i}.md", f" text  {i}\n" * 9) for i in range(7)] + [("x.md", " ")], "source_path string, body string")
    excerpt = content.corpus_excerpt(docs, 3, 12)
    assert excerpt.split("\n\n") == ["p0.md:\ntext 0 tex", "p2.md:\ntext 2 tex", "p4.md:\ntext 4 tex"]
    made = json.loads(report.write_queries(excerpt, "d", lambda ask: json.dumps({"queries": [{"query": f"q {i}"} for i in range(6)] + [{"query": " "}]})))
    assert len(made["queries"]) == 6 and made["queries"][5]["id"] == "q006"
    with pytest.raises(ValueError):
        report.write_queries(excerpt, "d", lambda ask: "nothing")
    (tmp_path / "a").write_text("12345")
    (tmp_path / "b").hardlink_to(tmp_path / "a")
    assert report.folder_bytes([str(tmp_path), str(tmp_path / "none")]) == {str(tmp_path): 5, str(tmp_path / "none"): 0}


def test_run_settings(tmp_path):
    p = tmp_path / "run.toml"
    p.write_text('[index]\nchunk_size = 100\nqa = true\n[judge]\nmodel = "j"\n[query_generation]\nqueries_per_dataset = 3\n[[datasets]]\nid = "d"\n[[models]]\nid = "m"\n')
    got = settings.read_settings(str(p))
    assert (got.chunk_size, got.judge, got.query_generation, got.options) == (100, {"model": "j"}, {"queries_per_dataset": 3}, {"qa": True})
    p.write_text('[index]\n')
    with pytest.raises(ValueError):
        settings.read_settings(str(p))


def test_suites_and_judgements_round_trip(spark, tmp_path):
    p = tmp_path / "suite.json"
    p.write_text(json.dumps({"name": "n", "cases": [{"id": "1", "query": "q", "must_match_any": ["a"]}]}))
    text = settings.dump_suite(settings.read_suite(spark, str(p)))
    assert json.loads(text)["cases"][0]["must_match_any"] == ["a"]
    rows = spark.createDataFrame([("k", 1.0)], "key string, relevance_score double")
    settings.append_judgements(rows, str(tmp_path / "cache"))
    settings.append_judgements(rows.withColumn("key", rows.relevance_score.cast("string")), str(tmp_path / "cache"))
    assert {r["key"] for r in settings.read_judgements(spark, str(tmp_path / "cache")).collect()} == {"k", "1.0"}


def test_a_failed_write_leaves_the_index(spark, tmp_path):
    root = str(tmp_path / "index")
    lane = lambda n: spark.createDataFrame([(i, f"t{n}", "fine") for i in range(n)], "chunk_id long, text string, granularity string")
    store.write_index(root, "m", 2, chunks=lane(2))
    with pytest.raises(Exception):
        store.write_index(root, "m", 2, chunks=lane(3), vectors=spark.createDataFrame([(0, [1.0])], "chunk_id long, embedding array<float>"))
    assert store.read_lane(spark, root, "chunks").count() == 2
    store.write_index(root, "m", 2, chunks=lane(4))
    store.drop_old_versions(spark, root)
    assert store.read_lane(spark, root, "chunks").count() == 4


def test_vector_search_in_blocks_and_odd_shapes(spark, monkeypatch):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5, 9.0]), (3, [2.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0, 1.0]), ("c", None)], "query_id string, vector array<float>")
    want = {"a": [3, 0, 6, 2, 1, 5], "b": [2, 1, 5, 0, 3, 6]}
    for most, scores in ((10_000, 4_000_000), (1, 2)):
        monkeypatch.setattr(ranking, "QUERIES_AT_ONCE", most)
        monkeypatch.setattr(ranking, "SCORES_AT_ONCE", scores)
        for k in (2, 9):
            got = {}
            for r in ranking.semantic_search(vectors, queries, k).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append(r["vec_id"])
            assert got["a"] == want["a"][:k] and got["b"][0] == 2 and set(got) == {"a", "b"}


@pytest.mark.parametrize("cms", sorted(content.PROFILES))
def test_rendered_sites_read_back(spark, tmp_path, cms):
    pages = [("one-page", 'A "first" page', "short", "2024-03-05", ["x", "y"], "# Head\n\nSome text."), ("two", "Second", None, "2023-01-02", [], "Plain.")]
    df = spark.createDataFrame(pages, "slug string, title string, description string, date string, tags array<string>, body string")
    assert content.write_files(content.render_site(df, cms), str(tmp_path)) == 2
    docs, errors = content.parse_files(content.read_files(spark, str(tmp_path)), cms)
    got = {r["title"]: r for r in docs.collect()}
    assert errors.count() == 0 and set(got) == {"A 'first' page", "Second"}
    one = got["A 'first' page"]
    assert (one["description"], one["date"][:10], one["tags"]) == ("short", "2024-03-05", ["x", "y"]) and "Some text." in one["body"]
    assert one["url"].endswith("one-page/")


def test_named_ids_and_pooling(spark):
    df = spark.createDataFrame([("a",), ("b",)], "dataset_id string")
    assert report.only(df, "dataset_id", []).count() == 2 and report.only(df, "dataset_id", ["b"]).count() == 1
    with pytest.raises(ValueError):
        report.only(df, "dataset_id", ["b", "z"])
    pooled = embed.mean_pool(np.array([[[3.0, 0.0], [1.0, 0.0], [9.0, 9.0]], [[0.0, 0.0]] * 3]), np.array([[1, 1, 0], [0, 0, 0]]))
    assert pooled.tolist() == [[1.0, 0.0], [0.0, 0.0]]
