import json

from corvane.operators import answer, facts
from pyspark.sql import functions as F


def objects(text, predicate="worked_for", **about):
    return [c[1] for c in facts.claims_of(text, **about) if c[0] == predicate]


def test_employers():
    assert objects("From 2011 on Mira worked for Dunlin, Heron and Avocet.") == ["Dunlin", "Heron", "Avocet"]
    assert set(objects("Places they worked for or with: Plover, Curlew (a mill), Redshank and Knot")) == {"Plover", "Curlew", "Redshank", "Knot"}
    assert objects("Mira worked with Gradle on most days.") == []


def test_role_lines():
    assert objects("Surveyor at Tern Harbour") == ["Tern Harbour"]
    assert objects("Lead Engineer at Sandpiper (two winters)") == ["Sandpiper"]
    assert objects("Whimbrel Rail (consulting)") == ["Whimbrel Rail"]


def test_experience_and_skills():
    assert objects("Ann has been programming for 20+ years.", "years_programming") == ["20+ years"]
    assert objects("Coding as a hobby since age 11", "since_age_programming") == ["11"]
    assert objects("- Rust\n- [Spark](http://x)\n- 10 years of SQL", "has_skill", url="/skills/") == ["Rust", "Spark"]
    assert objects("- Rust", "has_skill") == []
    assert objects("Skills: Rust, rust and SQL", "has_skill") == ["Rust", "SQL"]


def test_pairs():
    asked = [q for q, *_ in facts.pairs_of("Ann has been programming for 9 years. She worked for Acme and Globex.")]
    assert "How many years has the subject been programming?" in asked and "Who has the subject worked for?" in asked
    assert facts.pairs_of("Nothing to see") == []


def test_edits(spark):
    claims = spark.createDataFrame([(0, "S", "worked_for", "Old", "e.", "t", "/u/", None, ["a"], 0.8), (1, "S", "worked_for", "Keep", "e.", "t", "/u/", None, ["a"], 0.8), (2, "S", "worked_for", " keep", "e.", "t", "/u/", None, ["a"], 0.8)], "place int, subject string, predicate string, object string, evidence string, source_title string, source_url string, source_section string, tags array<string>, confidence float")
    rules = spark.createDataFrame([(None, None, "old ", None, None), (None,) * 5], "subject string, predicate string, object string, source_url string, contains string")
    adds = spark.createDataFrame([("S", "worked_for", "New")], "subject string, predicate string, object string")
    for c, kind in (("evidence", "string"), ("source_title", "string"), ("source_url", "string"), ("source_section", "string"), ("tags", "array<string>"), ("confidence", "float")):
        adds = adds.withColumn(c, F.lit(None).cast(kind))
    out = {r["object"]: r for r in facts.apply_edits(claims, rules, adds, ["place"]).collect()}
    assert set(out) == {"Keep", "New"} and out["New"]["confidence"] == 1.0


def test_generated_pairs(spark):
    rows = spark.createDataFrame([(1, '{"qa": [{"question": "Q?", "answer": " A ", "tags": ["t"]}]}'), (2, "broken ["), (3, None), (4, '{"qa": [{"question": "", "answer": "A"}]}'), (5, '[{"question": "Q?", "answer": "A"}]'), (6, 'Here: {"qa": [{"question": "Q?", "answer": "A"}]}')], "id long, reply string")
    assert [(r["id"], r["question"], r["answer"], round(r["confidence"], 1)) for r in facts.parse_generated_pairs(rows, "id", "reply").collect()] == [(1, "Q?", "A", 0.6)]


def test_written_pairs(spark):
    chunks = spark.createDataFrame([(3, "It has 3 parts."), (1, "It runs since 2001."), (2, "Nothing here"), (4, None)], "chunk_id long, text string")
    reply = lambda text: json.dumps({"qa": [{"question": f"What of {text}", "answer": text, "confidence": 0.9}]})
    out = facts.generate_pairs(chunks, reply, most=1).collect()
    assert [(r["chunk_id"], r["answer"], round(r["confidence"], 1)) for r in out] == [(1, "It runs since 2001.", 0.9)]


def test_wanted_rules():
    text = "Mira has been programming for 9 years. She worked for Dunlin.\nSkills: SQL"
    assert {c[0] for c in facts.claims_of(text)} == {"years_programming", "worked_for", "has_skill"}
    assert {c[0] for c in facts.claims_of(text, wanted={"worked_for"}.__contains__)} == {"worked_for"}


def test_question_reading(spark):
    df = spark.createDataFrame([("Does Ann Lee know machine-learning?",), ("Who has Ann worked for?",), ("How long has Ann been coding?",), ("hello there",)], "q string")
    rows = df.select(answer.intent("q").alias("i"), answer.is_yes_no("q").alias("y"), answer.meaning_terms("q").alias("t")).collect()
    assert [r["i"] for r in rows] == ["knowledge", "work_history", "duration", "generic"]
    assert rows[0]["y"] and rows[0]["t"] == ["machine-learning", "machinelearning", "machine", "learning"]
    assert "ann" not in rows[1]["t"]


def test_answers(spark):
    rows = [("q", "Does Ann know Rust?", "claims", "Has skill Rust.", "/s/", 0.9, "has_skill", 1), ("q", "Does Ann know Rust?", "claims", "Worked for Rust Works.", "/w/", 0.9, "worked_for", 2), ("n", "Does Ann know Go?", "qa", "Something else.", "/x/", 0.1, None, 1)]
    evidence = spark.createDataFrame(rows, "query_id string, query string, lane string, text string, url string, raw_score double, predicate string, place int")
    scored = {r["text"]: r["score"] for r in answer.score_evidence(evidence).collect()}
    assert scored["Has skill Rust."] > scored["Worked for Rust Works."]
    out = {r["query_id"]: r for r in answer.answers(evidence).collect()}
    assert out["q"]["text"] == "Has skill Rust." and out["q"]["citations"] == ["/s/"]
    assert out["n"]["text"] == answer.NO_EVIDENCE and out["n"]["lane"] == "search"
