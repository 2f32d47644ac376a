from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import urls as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


def test_tokens_keep_two_bytes_and_drop_one(spark):
    assert one(spark, "Hello, a é World-2!", T.tokens) == ["hello", "é", "world"]
    assert one(spark, "", T.tokens) == []
    assert one(spark, None, T.tokens) is None


def test_words_know_unicode_space(spark):
    assert one(spark, "a b c\r\nd  e", T.word_count) == 5
    assert one(spark, " \n", T.word_count) == 0
    assert one(spark, " a  b ", T.one_space) == "a b"


def test_strip_markdown(spark):
    assert one(spark, "<table><tr><td>Lock</td><td>No. 7</td></tr></table><em>open</em> <br/>daily", T.strip_markdown) == "LockNo. 7open daily"
    assert one(spark, "# Title\n\nA [link](http://x) and ![alt](y.png)\n\n> quoted\n---\n```\ncode\n```\nend", T.strip_markdown) == "Title\n\nA link and alt\n\nquoted\n\nend"


def test_shortcodes_and_mdx(spark):
    assert one(spark, "{{< rawhtml >}}<b>x</b>{{< /rawhtml >}}{{< mermaid >}}gone{{< /mermaid >}}", T.strip_shortcodes) == "<b>x</b>"
    assert one(spark, "import A from 'a';\n# Hi {props.x}", T.strip_mdx).strip() == "# Hi"


def test_draft_lines(spark):
    assert one(spark, "+++\ndraft = true\n+++\n", T.is_draft)
    assert one(spark, "text\npublished: false\n", T.is_draft)
    assert not one(spark, "draft: truely", T.is_draft)


def test_sentences_and_summary(spark):
    assert one(spark, "One. Two! Three\nFour?", T.sentences) == ["One.", "Two!", "Three", "Four?"]
    assert one(spark, "Pi is 3.14. Ok", T.fact_sentences) == ["Pi is 3", "14", "Ok"]
    assert one(spark, "Short. This sentence is long enough to be kept here. No", T.summary_sentences) == "This sentence is long enough to be kept here"
    assert one(spark, "Short.", T.summary_sentences) is None


def test_snippet(spark):
    assert one(spark, "short text", T.snippet) == "short text"
    long = "word " * 50
    assert one(spark, long, T.snippet) == ("word " * 30).strip() + "…"
    assert one(spark, "x" * 200, T.snippet) == "x" * 150 + "…"


def test_urls(spark):
    page = lambda p: one(spark, p, lambda c: U.page_url(c, ["index.md", "_index.md"]))
    assert [page(p) for p in ("posts/my-post.md", "about/index.md", "index.md", "a.b/c.d.md")] == ["/posts/my-post/", "/about/", "/", "/a.b/c.d/"]
    assert one(spark, "_posts/2026-01-15-my-first-post.md", lambda c: U.dated_url(c, ["index.md"])) == "/2026/01/15/my-first-post/"
    assert one(spark, "my_old-file.md", U.file_title) == "my old file"
    assert one(spark, "https://Host/A//b/?q#f", U.normal_path) == "/a/b"
    assert one(spark, "/a?q=1", U.normal_path) == "/a?q=1"


def test_recency(spark):
    at = lambda d: one(spark, d, lambda c: F.round(U.recency(c, 2026.0), 6))
    assert at(None) == at("n/a") == 1.0
    assert at("2030-01") == 1.18
    assert at("2022-01-01") < at("2025-13") < at("2025-12") < 1.18
