
from corvane.operators import chunking as C


def chunks(spark, body, tokens=256, overlap=0, strategy="heading"):
    docs = spark.createDataFrame([(1, "t", body)], "doc_id long, title string, body string")
    return [(r["section"], r["text"]) for r in C.chunk_documents(docs, tokens, overlap, strategy).orderBy("chunk_index").collect()]


def test_short_text_is_one_chunk(spark):
    assert chunks(spark, "just a few words") == [(None, "just a few words")]
    assert chunks(spark, None) == chunks(spark, " \n ") == []


def test_sections(spark):
    assert chunks(spark, "intro\n# One\ntext one\n## Two\n\n### Three\ntext three") == [(None, "intro"), ("One", "text one"), ("Three", "text three")]


def test_paragraphs_and_oversized_paragraph(spark):
    a, b = " ".join(["a"] * 200), " ".join(["b"] * 150)
    assert [t for _, t in chunks(spark, f"{a}\n\n{b}")] == [a, b]
    assert [t for _, t in chunks(spark, a)] == [a]


def test_overlap_is_taken_from_the_extended_chunk(spark):
    out = [t for _, t in chunks(spark, "# A\none two\n# B\nthree\n# C\nfour", overlap=3)]
    assert out == ["one two", "one two three", "one two three four"]


def test_strategies(spark):
    out = chunks(spark, "First sentence here. " * 60, 64, 0, "semantic")
    assert len(out) > 1 and all(s is None for s, _ in out)


def model(pieces, limit, sep):
    done, cur = [], None
    for p in (x.strip() for x in pieces):
        if not p:
            continue
        if cur is None:
            cur = p
        elif len(cur.split()) + len(p.split()) <= limit:
            cur += sep + p
        else:
            done.append(cur)
            cur = p
    return done + ([cur] if cur is not None else [])


def test_merging_follows_the_plain_model(spark):
    bodies = ["\n\n".join(" ".join(["w"] * n) for n in sizes) for sizes in ([3, 4, 50, 1, 2], [60, 60], [1] * 80, [0, 5, 0, 70, 3])]
    for body in bodies:
        assert [t for _, t in chunks(spark, body, 64)] == (model(body.split("\n\n"), 48, "\n\n") if len(body.split()) > 48 else [body.strip()])


def test_numbers_are_consecutive(spark):
    df = spark.range(1000).selectExpr("id % 37 as a", "id as b").repartition(7)
    rows = C.number_rows(df, ["a", "b"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1000))
    assert [(r["a"], r["b"]) for r in rows] == sorted((i % 37, i) for i in range(1000))
    assert C.number_rows(df.limit(0), ["a", "b"], "n").count() == 0
