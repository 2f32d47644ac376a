"""Named queries over the driver tables, each with its DuckDB counterpart where SQL can express it.

Every query runs over its whole tables. Doubles are rounded, ties are broken by id and lists are joined to texts, so that two
engines can be compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import urls as U
from corvane.operators import answer as A
from corvane.operators import chunking as C
from corvane.operators import embed, evaluate, facts, lexical, ranking, report
from corvane.plans import pipeline
from corvane.session import cut, spread
from corvane.streaming import ingest

NOW = 2026.0
S = T.SPACE
QUERIES = [("a", "index compression and link checking"), ("b", "The build cache of the release script"), ("c", "search search widget"), ("d", "réglage de la page d'accueil"), ("e", "Which ranking profile is stale?")]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def named(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def asked(spark: SparkSession, rows: list[tuple[str, str]] = QUERIES) -> DataFrame:
    return spark.createDataFrame(rows, "query_id string, query string")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# SQL counterparts of the text functions


def s_lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def s_values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join("NULL" if v is None else s_lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


def s_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{S}]+', ''), '[{S}]+$', '')"


def s_one_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{S}]+', ' ', 'g'))"


def s_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{S}]+')"


def s_tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t_: strlen(t_) >= 2)"


def s_fact_sentences(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '[\n.!?]+\s*'), lambda q_: {s_strip('q_')}), lambda q_: q_ <> '')"


def s_sentences(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\n]+[.!?]?'), lambda q_: {s_strip('q_')}), lambda q_: q_ <> '')"


def s_recency(d: str) -> str:
    month = f"CASE WHEN strlen({d}) >= 7 THEN TRY_CAST(substr({d}, 6, 2) AS INT) END"
    month = f"CASE WHEN ({month}) BETWEEN 1 AND 12 THEN ({month}) ELSE 6 END"
    year = f"CASE WHEN regexp_matches({d}, '^[0-9]{{4}}') THEN TRY_CAST(substr({d}, 1, 4) AS INT) END"
    age = f"({NOW} - (({year}) + (({month}) - 0.5::DOUBLE) / 12))"
    return f"coalesce(1 + 0.18::DOUBLE * pow(2::DOUBLE, -(CASE WHEN {age} < 0 THEN 0 ELSE {age} END) / 4), 1.0)"


def s_merge(pieces: str, limit: int, sep: str) -> str:
    clean = f"list_filter(list_transform({pieces}, lambda p_: {s_strip('p_')}), lambda p_: p_ <> '')"
    sized = f"list_transform({clean}, lambda p_: {{'d': [p_], 'n': len({s_words('p_')})::INT}})"
    step = f"lambda a_, x_: CASE WHEN a_.n + x_.n <= {limit} THEN {{'d': a_.d[:-2] || [a_.d[-1] || {sep} || x_.d[1]], 'n': a_.n + x_.n}} ELSE {{'d': a_.d || x_.d, 'n': x_.n}} END"
    return f"CASE WHEN len({clean}) = 0 THEN [] ELSE list_reduce({sized}, {step}).d END"


def s_pieces(x: str, limit: int) -> str:
    paragraphs, parts = f"string_split({x}, E'\\n\\n')", rf"regexp_split_to_array({x}, '[.!?]+\s+')"
    return f"CASE WHEN len({s_words(x)}) <= {limit} THEN [{x}] WHEN len({paragraphs}) > 1 THEN {s_merge(paragraphs, limit, chr(69) + s_lit(chr(92) + 'n' + chr(92) + 'n'))} WHEN len({parts}) > 1 THEN {s_merge(parts, limit, s_lit('. '))} ELSE [{x}] END"


def s_query_table() -> str:
    return s_values(QUERIES, "query_id, query")


_TF = f"""q AS (SELECT query_id, t AS term, count(*) AS times FROM (SELECT query_id, unnest({s_tokens('query')}) AS t FROM {s_query_table()}) GROUP BY ALL),
d AS (SELECT doc_id, {s_tokens('text')} AS toks FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.search_texts(read(spark, sf_dir, "documents"), asked(spark), k)


# Lexical retrieval


@named(f"SELECT count(*)::BIGINT AS n, round(coalesce(avg(len(t)), 0), 6) AS avgdl FROM (SELECT {s_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)")
def bm25_stats(spark, sf_dir):
    stats = lexical.corpus_stats(lexical.lengths(read(spark, sf_dir, "documents").filter("text is not null")))
    return stats.select("n", r6("avgdl", "avgdl"))


@named(f"SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({s_tokens('text')}) AS term FROM documents WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY term")
def bm25_df(spark, sf_dir):
    post = lexical.postings(read(spark, sf_dir, "documents"))
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@named(f"WITH {_TF} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM bm WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 20).select("query_id", "doc_id", r6("score", "score"), "rank")


_INDEX_TERMS = [("a", "map pipeline"), ("b", "docs engineer docs"), ("c", "question thread")]


@named(
    f"""WITH q AS (SELECT query_id, t AS term, count(*) AS times FROM (SELECT query_id, unnest({s_tokens('query')}) AS t FROM {s_values(_INDEX_TERMS, 'query_id, query')}) GROUP BY ALL),
p AS (SELECT DISTINCT term, chunk_id, tf FROM postings WHERE tf >= 1 AND term IN (SELECT term FROM q)),
l AS (SELECT DISTINCT chunk_id, dl FROM doc_len WHERE dl IS NOT NULL), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query_id, chunk_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM p JOIN q USING (term) JOIN df USING (term) JOIN l USING (chunk_id) CROSS JOIN st GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 10"""
)
def bm25_index_topk(spark, sf_dir):
    found = lexical.search_index(read(spark, sf_dir, "postings"), read(spark, sf_dir, "doc_len"), asked(spark, _INDEX_TERMS), 10)
    return found.select("query_id", "chunk_id", r6("score", "score"), "rank")


@named(f"SELECT lane, term, count(*)::BIGINT AS times FROM (SELECT 'q' AS lane, unnest({s_tokens('question')}) AS term FROM qa UNION ALL SELECT 'a', unnest({s_tokens('answer')}) FROM qa) GROUP BY ALL")
def tokens_pairs(spark, sf_dir):
    qa = read(spark, sf_dir, "qa")
    both = qa.select(F.lit("q").alias("lane"), F.explode(T.tokens("question")).alias("term")).unionByName(qa.select(F.lit("a").alias("lane"), F.explode(T.tokens("answer")).alias("term")))
    return both.groupBy("lane", "term").agg(F.count(F.lit(1)).alias("times"))


# Vectors and fusion

_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


@named(f"""SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT q.vec_id::VARCHAR AS query_id, e.vec_id, {_DOT.format('q.embedding', 'e.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format('q.embedding', 'e.embedding')}, 9) DESC, e.vec_id) AS rank
FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10""")
def semantic_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    asking = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return _rounded_top(ranking.semantic_search(vectors, asking, 10))


def _rounded_top(found: DataFrame, id_column: str = "vec_id") -> DataFrame:
    return found.select("query_id", id_column, r6("score", "score"), "rank")


_VECTOR_OF = [(q, n + 1) for n, (q, _) in enumerate(QUERIES)]
_SEM = f"""qv AS (SELECT query_id, embedding AS qe FROM embeddings JOIN {s_values(_VECTOR_OF, 'query_id, vec_id')} USING (vec_id)),
sem AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round({_DOT.format('qe', 'embedding')}, 9) DESC, vec_id) AS rank FROM embeddings CROSS JOIN qv)"""
_RRF = f"""{_TF}, {_SEM}, both_ AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank FROM sem WHERE rank <= 30),
fu AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM both_ GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM fu)"""


def _hybrid(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asking = vectors.join(F.broadcast(spark.createDataFrame(_VECTOR_OF, "query_id string, doc_id long")), "doc_id").select("query_id", F.col("embedding").alias("vector"))
    return ranking.reciprocal_rank_fusion([_bm25(spark, sf_dir, 30), ranking.semantic_search(vectors, asking, 30, "doc_id")], k, "doc_id")


@named(f"WITH {_RRF} SELECT query_id, doc_id, round(score, 9) AS score, rank::INT AS rank FROM rrf WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


_PAGE_URL = "'/' || source || '/' || (doc_id % 7)::VARCHAR || '/'"


@named(
    f"""WITH {_RRF}, h AS (SELECT query_id, doc_id, score * {s_recency('date')} AS s, {_PAGE_URL} AS url, CASE WHEN doc_id % 2 = 0 THEN 'fine' ELSE 'coarse' END AS g FROM rrf JOIN documents USING (doc_id) WHERE rank <= 30),
l AS (SELECT query_id, url, g, max(s) AS m FROM h GROUP BY ALL), b AS (SELECT query_id, url, max(m) + 0.12::DOUBLE * (sum(m) - max(m)) AS score FROM l GROUP BY ALL),
i AS (SELECT query_id, url, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY round(s, 12) DESC, doc_id) AS n FROM h) WHERE n = 1)
SELECT query_id, url, doc_id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM b JOIN i USING (query_id, url)) WHERE rank <= 8"""
)
def page_search(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "date", F.concat(F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 7).cast("string"), F.lit("/")).alias("url"), F.when(F.col("doc_id") % 2 == 0, "fine").otherwise("coarse").alias("granularity"))
    found = ranking.page_ranking(_hybrid(spark, sf_dir, 30), docs, 8, NOW, "doc_id")
    return found.select("query_id", "url", "doc_id", F.round("score", 9).alias("score"), "rank")


@named(f"SELECT url, round(max({s_recency('date')}), 9) AS boost FROM chunks GROUP BY url")
def recency_by_url(spark, sf_dir):
    return ranking.recency_by_url(read(spark, sf_dir, "chunks"), NOW).select("url", F.round("boost", 9).alias("boost"))


@named(f"SELECT o_orderkey, round({s_recency('strftime(o_orderdate, ' + s_lit('%Y-%m-%d') + ')')}, 9) AS boost FROM orders")
def recency_boost(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(U.recency(F.date_format("o_orderdate", "yyyy-MM-dd"), NOW), 9).alias("boost"))


_CLAIM_SEARCH = f"""WITH v AS (SELECT vec_id, item_id, embedding FROM vectors WHERE lane = 'claim_embeddings' AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x_: isnan(x_)))),
n AS (SELECT q.vec_id::VARCHAR AS query_id, v.item_id AS claim_id, {_DOT.format('q.embedding', 'v.embedding')} AS s FROM v CROSS JOIN (SELECT * FROM v WHERE vec_id % 50 = 0) q),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, claim_id) AS r FROM n) WHERE r <= 6),
b AS (SELECT url, max({s_recency('date')}) AS boost FROM site_docs GROUP BY url),
x AS (SELECT query_id, claim_id, s * coalesce(boost, 1.0) AS score FROM t JOIN claims USING (claim_id) LEFT JOIN b ON source_url = url)
SELECT query_id, claim_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, claim_id))::INT AS rank FROM x"""


@named(_CLAIM_SEARCH)
def claim_lane_search(spark, sf_dir):
    v = read(spark, sf_dir, "vectors").filter("lane = 'claim_embeddings' and size(embedding) = 64 and not exists(embedding, x -> isnan(x))")
    claims = read(spark, sf_dir, "claims").select("claim_id", "source_url").join(v.select(F.col("item_id").alias("claim_id"), "embedding"), "claim_id")
    asking = v.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return _rounded_top(ranking.claim_search(claims, asking, ranking.recency_by_url(read(spark, sf_dir, "site_docs"), NOW), 6), "claim_id")


_QA_SEARCH = f"""WITH v AS (SELECT vec_id, item_id, embedding FROM vectors WHERE lane = 'qa_embeddings' AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x_: isnan(x_)))),
n AS (SELECT q.vec_id::VARCHAR AS query_id, v.item_id AS qa_id, {_DOT.format('q.embedding', 'v.embedding')} AS s FROM v CROSS JOIN (SELECT * FROM v WHERE vec_id % 50 = 0) q),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, qa_id) AS r FROM n)
SELECT query_id, r::INT AS rank, qa_id, round(s, 6) AS score, question, {s_strip("coalesce(answer, '')")} AS answer, source_url FROM t JOIN qa USING (qa_id) WHERE r <= 6"""


@named(_QA_SEARCH)
def qa_lane_search(spark, sf_dir):
    v = read(spark, sf_dir, "vectors").filter("lane = 'qa_embeddings' and size(embedding) = 64 and not exists(embedding, x -> isnan(x))")
    lane = v.select(F.col("item_id").alias("qa_id"), "embedding")
    asking = v.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    found = _rounded_top(ranking.semantic_search(lane, asking, 6, "qa_id"), "qa_id")
    return found.join(read(spark, sf_dir, "qa"), "qa_id").select("query_id", "rank", "qa_id", "score", "question", T.strip(F.coalesce("answer", F.lit(""))).alias("answer"), "source_url")


# Text, addresses, front matter


def _s_steps(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        pattern = pattern.replace("(?md)", "(?m)")
        new = new.replace("$1", "\\1")
        x = f"regexp_replace({x}, {s_lit(pattern)}, {'E' + s_lit(new.replace(chr(10), chr(92) + 'n')) if chr(10) in new else s_lit(new)}, 'g')"
    return x


@named(f"SELECT doc_id, {s_strip(_s_steps('body', T.MARKDOWN_STEPS))} AS clean FROM site_docs WHERE body IS NOT NULL")
def strip_markup_pages(spark, sf_dir):
    return read(spark, sf_dir, "site_docs").filter("body is not null").select("doc_id", T.strip_markdown("body").alias("clean"))


_SHORT = """'{{< rawhtml >}}<b>' || title || '</b>{{< /rawhtml >}} {{< ref "/x" >}}' || title || '{{< mermaid >}}graph ' || doc_id::VARCHAR || '{{< /mermaid >}}{{< note a=1 >}}' || url || '{{< closing >}}'"""


@named(f"SELECT doc_id, {_s_steps('x', T.SHORTCODE_STEPS)} AS clean FROM (SELECT doc_id, {_SHORT} AS x FROM site_docs)")
def strip_shortcodes(spark, sf_dir):
    return read(spark, sf_dir, "site_docs").select("doc_id", T.strip_shortcodes(F.expr(_SHORT.replace("doc_id::VARCHAR", "cast(doc_id as string)"))).alias("clean"))


_MDX = "'import X from ' || title || E';\\nexport const y = 1;\\n' || title || ' {props.x} and ' || url || E'\\nimport not closed'"


@named(f"SELECT doc_id, {_s_steps('x', T.MDX_STEPS)} AS clean FROM (SELECT doc_id, {_MDX} AS x FROM site_docs)")
def strip_mdx(spark, sf_dir):
    return read(spark, sf_dir, "site_docs").select("doc_id", T.strip_mdx(F.expr(_MDX.replace("E'", "'"))).alias("clean"))


_FRONT = "E'\\ntitle: \"' || title || E'\"\\ntags: [\"' || coalesce(array_to_string(tags, '\", \"'), '') || E'\"]\\n' || CASE WHEN doc_id % 3 = 0 THEN E'draft: true\\n' WHEN doc_id % 3 = 1 THEN E'published = false\\n' ELSE E'draft: false\\n' END || coalesce('date: ' || date, 'date:') || E'\\nslug: ' || url"
_FRONT_SPARK = _FRONT.replace("E'", "'").replace("array_to_string(tags, '\", \"')", "array_join(tags, '\", \"')")


@named(rf"SELECT doc_id FROM (SELECT doc_id, {_FRONT} AS f FROM site_docs) WHERE NOT regexp_matches(f, '(?m)^draft\s*[:=]\s*true\s*$') AND NOT regexp_matches(f, '(?m)^published\s*[:=]\s*false\s*$')")
def draft_filter(spark, sf_dir):
    return read(spark, sf_dir, "site_docs").withColumn("f", F.expr(_FRONT_SPARK)).filter(~T.is_draft("f")).select("doc_id")


def _s_yaml(key: str) -> str:
    line = rf'(?m)^{key}\s*:\s*"?([^"\n]+)"?\s*$'
    return f"CASE WHEN regexp_matches(f, {s_lit(line)}) THEN {s_strip(f'regexp_extract(f, {s_lit(line)}, 1)')} END"


_FM = "E'title: \"' || title || E'\"\\ndate: ' || coalesce(date, 'none') || E'\\ntags: [' || coalesce(array_to_string(tags, ', '), '') || E']\\nslug: ' || url || E'\\n'"


@named(f"SELECT doc_id, {_s_yaml('title')} AS title, {_s_yaml('date')} AS date, {_s_yaml('slug')} AS slug, array_to_string(list_filter(list_transform(string_split(regexp_extract({_s_yaml('tags')}, '^\\[(.*)\\]$', 1), ','), lambda t_: trim(t_)), lambda t_: t_ <> ''), '|') AS tags FROM (SELECT doc_id, {_FM} AS f FROM site_docs)")
def front_matter_fields(spark, sf_dir):
    from corvane.sources.content import yaml_list, yaml_value

    rows = read(spark, sf_dir, "site_docs").withColumn("f", F.expr(_FM.replace("E'", "'").replace("array_to_string(tags, ', ')", "array_join(tags, ', ')")))
    return rows.select("doc_id", yaml_value("f", "title").alias("title"), yaml_value("f", "date").alias("date"), yaml_value("f", "slug").alias("slug"), F.array_join(yaml_list("f", "tags"), "|").alias("tags"))


_INDEXES = ["index.md", "README.md", "_index.md"]
_S_BARE = rf"CASE WHEN regexp_extract(p, '([^/]*)$', 1) IN ('index.md', 'README.md', '_index.md') THEN regexp_replace(p, '/?[^/]*$', '') ELSE regexp_replace(p, '([^/])\.[^./]*$', '\1') END"
_S_URL = f"CASE WHEN u LIKE '%/' THEN u ELSE u || '/' END"


@named(f"SELECT doc_id, {_S_URL} AS page FROM (SELECT doc_id, replace('/' || ({_S_BARE}), '//', '/') AS u FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(source_path, '[^/]*$', '') || 'index.md' ELSE source_path END AS p FROM site_docs))")
def derive_url(spark, sf_dir):
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.regexp_replace("source_path", "[^/]*$", ""), F.lit("index.md"))).otherwise(F.col("source_path"))
    return read(spark, sf_dir, "site_docs").withColumn("p", path).select("doc_id", U.page_url("p", _INDEXES).alias("page"))


@named("SELECT doc_id, '/' || strftime(parsed_at, '%Y/%m/%d') || '/' || 'post-' || doc_id::VARCHAR || '/' AS page FROM site_docs")
def dated_url(spark, sf_dir):
    path = F.concat(F.lit("_posts/"), F.date_format("parsed_at", "yyyy-MM-dd"), F.lit("-post-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "site_docs").withColumn("p", path).select("doc_id", U.dated_url("p", _INDEXES).alias("page"))


_RAW_URL = "CASE doc_id % 4 WHEN 0 THEN 'https://Docs.Site.example' || url || '?a=1#b' WHEN 1 THEN url || '//X/' WHEN 2 THEN trim(url, '/') ELSE 'http://h.example' END"


@named(rf"""SELECT doc_id, lower(CASE WHEN length(q) > 1 THEN regexp_replace(q, '/$', '') ELSE q END) AS path FROM (SELECT doc_id, regexp_replace('/' || trim(CASE WHEN regexp_matches(u, '^[a-z]+://') THEN regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) ELSE u END), '/+', '/', 'g') AS q FROM (SELECT doc_id, {_RAW_URL} AS u FROM site_docs))""")
def normalize_url_path(spark, sf_dir):
    raw = F.expr(_RAW_URL.replace("trim(url, '/')", "trim(both '/' from url)"))
    return read(spark, sf_dir, "site_docs").withColumn("u", raw).select("doc_id", U.normal_path("u").alias("path"))


@named(f"SELECT doc_id, len({s_words('body')})::INT AS words, md5({s_one_space('body')}) AS text_hash FROM site_docs WHERE body IS NOT NULL")
def word_stats(spark, sf_dir):
    return read(spark, sf_dir, "site_docs").filter("body is not null").select("doc_id", T.word_count("body").alias("words"), F.md5(T.one_space("body")).alias("text_hash"))


@named(f"SELECT doc_id, (s.place - 1)::INT AS place, s.x AS sentence FROM (SELECT doc_id, unnest(list_transform(range(1, len(q) + 1), lambda i_: {{'place': i_, 'x': q[i_]}})) AS s FROM (SELECT doc_id, {s_sentences('text')} AS q FROM documents WHERE text IS NOT NULL))")
def sentences_kept(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents").filter("text is not null")).select("doc_id", F.posexplode(T.sentences("text")).alias("place", "sentence"))


@named(f"SELECT doc_id, len({s_fact_sentences('text')})::INT AS n, coalesce({s_fact_sentences('text')}[1], '') AS first FROM documents WHERE text IS NOT NULL")
def sentences_bare(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "documents").filter("text is not null")).withColumn("s", T.fact_sentences("text"))
    return rows.select("doc_id", F.size("s").alias("n"), F.coalesce(F.get("s", F.lit(0)), F.lit("")).alias("first"))


def _s_set(x: str) -> str:
    return rf"list_distinct(list_filter(list_transform({s_words(x)}, lambda w_: lower(regexp_replace(regexp_replace(w_, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', ''))), lambda w_: strlen(w_) > 2))"


@named(
    f"""WITH s AS (SELECT doc_id, {s_sentences('body')} AS q FROM site_docs WHERE body IS NOT NULL),
w AS (SELECT doc_id, list_transform(q, lambda x_: {_s_set('x_')}) AS w FROM s),
p AS (SELECT doc_id, unnest(range(1, len(w))) AS place, w FROM w),
i AS (SELECT doc_id, place, w[place] AS a, w[place + 1] AS b FROM p)
SELECT doc_id, (place - 1)::INT AS place, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END, 6) AS likeness FROM i"""
)
def adjacent_jaccard(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "site_docs").filter("body is not null")).select("doc_id", F.transform(T.sentences("body"), T.token_set).alias("w"))
    pairs = rows.filter("size(w) > 1").withColumn("x", F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), T.jaccard))
    return pairs.select("doc_id", F.posexplode("x").alias("place", "likeness")).withColumn("likeness", F.round("likeness", 6))


@named(f"""SELECT doc_id, CASE WHEN length(body) <= 150 THEN body ELSE regexp_replace(CASE WHEN regexp_matches(left(body, 150), '(?s)^.+[{S}]') THEN regexp_extract(left(body, 150), '(?s)^(.+)[{S}]', 1) ELSE left(body, 150) END, '[{S}]+$', '') || '…' END AS snippet FROM site_docs WHERE body IS NOT NULL""")
def snippets(spark, sf_dir):
    return read(spark, sf_dir, "site_docs").filter("body is not null").select("doc_id", T.snippet("body").alias("snippet"))


@named(f"SELECT doc_id, array_to_string(list_filter({s_fact_sentences('body')}, lambda x_: strlen(x_) >= 30)[1:4], ' ') AS summary FROM site_docs WHERE len(list_filter({s_fact_sentences('body')}, lambda x_: strlen(x_) >= 30)) > 0")
def summary_lane(spark, sf_dir):
    return C.summary_lane(read(spark, sf_dir, "site_docs").filter("body is not null").select("doc_id", "body")).select("doc_id", F.col("text").alias("summary"))


@named("SELECT 'q' || qa_id::VARCHAR AS key, (contains(t, '?') OR regexp_matches(t, '^(?:who|what|when|where|why|how|which|does|do|is|are|can|has|have)\\b') OR len(regexp_extract_all(t, '[^" + S + "]+')) >= 5) AS asks FROM (SELECT qa_id, lower(" + s_strip("question") + ") AS t FROM qa)")
def factual_queries(spark, sf_dir):
    return read(spark, sf_dir, "qa").select(F.concat(F.lit("q"), F.col("qa_id").cast("string")).alias("key"), T.is_factual_query("question").alias("asks"))


# Chunks


def _s_sections(body: str) -> str:
    parts = f"string_split(regexp_replace({body}, '(?m)^(#{{1,6}}[ \\t]+\\S)', E'\\x01' || '\\1', 'g'), E'\\x01')"
    return f"list_filter(list_transform({parts}, lambda p_: {{'h': CASE WHEN regexp_matches(p_, '^#{{1,6}}[ \\t]+[^\\n]+') THEN {s_strip(chr(39).join(['regexp_extract(p_, ', '^#{1,6}[ ' + chr(92) + 't]+([^' + chr(92) + 'n]+)', ', 1)']))} END, 't': {s_strip('regexp_replace(p_, ' + s_lit('^#{1,6}[ ' + chr(92) + 't]+([^' + chr(92) + 'n]+)') + ', ' + s_lit('') + ')')}}}), lambda p_: p_.t <> '')"


@named(f"SELECT doc_id, (place - 1)::INT AS place, s[place].h AS section, s[place].t AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS place FROM (SELECT doc_id, {_s_sections('body')} AS s FROM site_docs WHERE body IS NOT NULL))")
def heading_sections(spark, sf_dir):
    rows = read(spark, sf_dir, "site_docs").filter("body is not null").select("doc_id", F.posexplode(C.sections("body")).alias("place", "s"))
    return rows.select("doc_id", "place", F.col("s.section").alias("section"), F.col("s.text").alias("text"))


def _s_chunks(tokens: int) -> str:
    limit = C.max_words(tokens)
    return f"""SELECT doc_id, sec, place, unnest(range(1, len(p) + 1)) AS n, p FROM (SELECT doc_id, place, s[place].h AS sec, {s_pieces('s[place].t', limit)} AS p FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS place FROM (SELECT doc_id, {_s_sections('body')} AS s FROM site_docs WHERE body IS NOT NULL)))"""


def _s_lane(tokens: int, name: str) -> str:
    return f"SELECT doc_id, '{name}' AS granularity, (row_number() OVER (PARTITION BY doc_id ORDER BY place, n) - 1)::INT AS chunk_index, sec AS section, p[n] AS text FROM ({_s_chunks(tokens)})"


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "site_docs").select("doc_id", "body")


@named(_s_lane(256, "fine"))
def chunk_fine(spark, sf_dir):
    return C.chunk_documents(_site(spark, sf_dir), 256, 0)


@named(_s_lane(640, "coarse"))
def chunk_coarse(spark, sf_dir):
    return C.chunk_documents(_site(spark, sf_dir), 640, 0, granularity="coarse")


@named(f"SELECT (row_number() OVER (ORDER BY doc_id, o, chunk_index) - 1)::BIGINT AS chunk_id, doc_id, granularity, chunk_index FROM (SELECT doc_id, granularity, chunk_index, 0 AS o FROM ({_s_lane(256, 'fine')}) UNION ALL SELECT doc_id, granularity, chunk_index, 1 FROM ({_s_lane(640, 'coarse')}) UNION ALL SELECT doc_id, 'summary', 0, 2 FROM site_docs WHERE len(list_filter({s_fact_sentences('body')}, lambda x_: strlen(x_) >= 30)) > 0)")
def chunk_ids(spark, sf_dir):
    lanes = C.all_lanes(_site(spark, sf_dir), 256, 0, coarse_tokens=640, summary=True)
    lanes = lanes.withColumn("o", F.when(F.col("granularity") == "fine", 0).when(F.col("granularity") == "coarse", 1).otherwise(2)).drop("text", "section")
    return C.number_rows(lanes, ["doc_id", "o", "chunk_index"]).select("chunk_id", "doc_id", "granularity", "chunk_index")


_OVERLAP = f"""WITH RECURSIVE c AS ({_s_lane(128, 'fine')}), r AS (SELECT doc_id, chunk_index, section, text FROM c WHERE chunk_index = 0 UNION ALL
SELECT c.doc_id, c.chunk_index, c.section, CASE WHEN len({s_words('r.text')}) <= 8 THEN r.text ELSE array_to_string({s_words('r.text')}[-8:], ' ') END || ' ' || c.text FROM r JOIN c ON c.doc_id = r.doc_id AND c.chunk_index = r.chunk_index + 1)
SELECT doc_id, chunk_index, section, text FROM r"""


@named(_OVERLAP)
def chunk_overlap(spark, sf_dir):
    return C.chunk_documents(_site(spark, sf_dir), 128, 8).select("doc_id", "chunk_index", "section", "text")


def _s_semantic(tokens: int) -> str:
    limit = C.max_words(tokens)
    sized = f"list_transform({s_sentences('body')}, lambda x_: {{'d': [x_], 'n': len({s_words('x_')})::INT, 'w': {_s_set('x_')}}})"
    like = "CASE WHEN len(a_.w) = 0 OR len(b_.w) = 0 THEN 0.0 ELSE len(list_intersect(a_.w, b_.w))::DOUBLE / len(list_distinct(a_.w || b_.w)) END"
    step = f"lambda a_, b_: CASE WHEN a_.n >= {max(limit // 3, 40)} AND (a_.n + b_.n > {limit} OR {like} < 0.14) THEN {{'d': a_.d || b_.d, 'n': b_.n, 'w': b_.w}} ELSE {{'d': a_.d[:-2] || [a_.d[-1] || ' ' || b_.d[1]], 'n': a_.n + b_.n, 'w': b_.w}} END"
    return f"""WITH q AS (SELECT doc_id, {sized} AS q FROM site_docs WHERE body IS NOT NULL), f AS (SELECT doc_id, list_reduce(q, {step}).d AS d FROM q WHERE len(q) > 0),
t AS (SELECT doc_id, place, d[place] AS x FROM (SELECT doc_id, unnest(range(1, len(d) + 1)) AS place, d FROM f)),
u AS (SELECT doc_id, place, unnest(range(1, len(p) + 1)) AS n, p FROM (SELECT doc_id, place, {s_pieces('x', limit)} AS p FROM t))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place, n) - 1)::INT AS chunk_index, p[n] AS text FROM u"""


@named(_s_semantic(128))
def semantic_chunks(spark, sf_dir):
    return C.chunk_documents(_site(spark, sf_dir), 128, 0, "semantic").select("doc_id", "chunk_index", "text")


# Facts

_PROSE = "'Customer has been programming for ' || (p_size % 40 + 1)::VARCHAR || ' years. She has done engineering at home since age ' || (p_size % 30 + 8)::VARCHAR || E'. The team worked for ' || p_brand || ', ' || upper(p_type) || ' and Plain Works. He worked with tools.\\nLead engineer at ' || replace(p_brand, '#', ' ') || E' (2 years)\\nNova ' || p_partkey::VARCHAR || E' (consulting)\\n1. Orbit ' || p_partkey::VARCHAR || E' - search work\\nSkills: ' || p_name || ', Rust and SQL'"


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(_PROSE.replace("E'", "'").replace("(p_size % 40 + 1)::VARCHAR", "cast(p_size % 40 + 1 as string)").replace("(p_size % 30 + 8)::VARCHAR", "cast(p_size % 30 + 8 as string)").replace("p_partkey::VARCHAR", "cast(p_partkey as string)"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), text.alias("text"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("section"), F.concat(F.lit("/p/"), (F.col("p_partkey") % 97).cast("string"), F.lit("/")).alias("url"))


_ROLE_ORGS = "SELECT p_partkey AS chunk_id, replace(p_brand, '#', ' ') AS object, 0.88::FLOAT AS confidence FROM part UNION ALL SELECT p_partkey, 'Nova ' || p_partkey::VARCHAR, 0.85 FROM part UNION ALL SELECT p_partkey, 'Orbit ' || p_partkey::VARCHAR, 0.83 FROM part"
_WORK_ORGS = "SELECT p_partkey AS chunk_id, p_brand AS object, 0.86::FLOAT AS confidence FROM part UNION ALL SELECT p_partkey, upper(p_type), 0.86 FROM part UNION ALL SELECT p_partkey, 'Plain Works', 0.86 FROM part"


def _claims(spark: SparkSession, sf_dir: str, *predicates: str) -> DataFrame:
    return facts.extract_claims(_prose(spark, sf_dir), predicates=predicates or None)


@named(f"SELECT chunk_id, object, round(confidence, 2) AS confidence FROM ({_WORK_ORGS} UNION ALL {_ROLE_ORGS})")
def claims_employers(spark, sf_dir):
    return _claims(spark, sf_dir, "worked_for").select("chunk_id", "object", F.round("confidence", 2).alias("confidence"))


@named("SELECT p_partkey AS chunk_id, 'years_programming' AS predicate, (p_size % 40 + 1)::VARCHAR || ' years' AS object FROM part UNION ALL SELECT p_partkey, 'since_age_engineering', (p_size % 30 + 8)::VARCHAR FROM part")
def claims_experience(spark, sf_dir):
    return _claims(spark, sf_dir, "years_{}", "since_age_{}").select("chunk_id", "predicate", "object")


@named("SELECT p_partkey AS chunk_id, p_name AS object FROM part UNION ALL SELECT p_partkey, 'Rust' FROM part UNION ALL SELECT p_partkey, 'SQL' FROM part")
def claims_skills(spark, sf_dir):
    return _claims(spark, sf_dir, "has_skill").select("chunk_id", "object")


@named("SELECT arg_min(o, (c, n)) AS object, u AS url, count(*)::BIGINT AS copies FROM (SELECT object AS o, lower(object) AS k, '/p/' || (chunk_id % 97)::VARCHAR || '/' AS u, chunk_id AS c, 0 AS n FROM (" + _WORK_ORGS + " UNION ALL " + _ROLE_ORGS + ")) GROUP BY k, u")
def claims_dedup(spark, sf_dir):
    claims = _claims(spark, sf_dir, "worked_for")
    counts = claims.groupBy(F.lower("object").alias("_k"), F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    first = facts.dedup_claims(claims, ["chunk_id", "place"]).select("object", F.lower("object").alias("_k"), F.col("source_url").alias("url"))
    return first.join(counts, ["_k", "url"]).select("object", "url", "copies")


_RULES = [(None, "has_skill", None, None, None), (None, None, "plain works", None, None), (None, None, None, None, "nova 1"), (None, None, None, None, None)]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "subject string, predicate string, object string, source_url string, contains string")


@named("""SELECT claim_id FROM claims c WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('has_skill', NULL, NULL), (NULL, 'banili mutual', NULL), (NULL, NULL, 'nipigi')) AS r(p, o, t)
WHERE (r.p IS NULL OR c.predicate = r.p) AND (r.o IS NULL OR lower(coalesce(""" + s_strip("c.object") + """, '')) = r.o) AND (r.t IS NULL OR contains(lower(concat_ws(' ', c.subject, c.predicate, c.object, c.evidence)), r.t)))""")
def claims_redact(spark, sf_dir):
    rules = [(None, "has_skill", None, None, None), (None, None, " Banili Mutual", None, None), (None, None, None, None, "NIPIGI"), (None, None, None, None, None)]
    return facts.redact(read(spark, sf_dir, "claims"), spark.createDataFrame(rules, "subject string, predicate string, object string, source_url string, contains string")).select("claim_id")


@named(
    "WITH w AS (SELECT chunk_id, object, '/p/' || (chunk_id % 97)::VARCHAR || '/' AS url FROM (" + _WORK_ORGS + " UNION ALL " + _ROLE_ORGS + ") WHERE lower(object) <> 'plain works' AND NOT contains(lower(object), 'nova 1')), "
    "t AS (SELECT url, lower(object) AS k FROM w GROUP BY ALL) "
    "SELECT predicate, count(*)::BIGINT AS n FROM (SELECT 'worked_for' AS predicate FROM t UNION ALL SELECT predicate FROM (SELECT DISTINCT 'years_programming' AS predicate, (p_size % 40 + 1) AS o, p_partkey % 97 AS u FROM part) UNION ALL SELECT predicate FROM (SELECT DISTINCT 'since_age_engineering' AS predicate, (p_size % 30 + 8) AS o, p_partkey % 97 AS u FROM part) UNION ALL SELECT 'knows') GROUP BY predicate"
)
def claims_edited(spark, sf_dir):
    adds = spark.createDataFrame([("Subject", "knows", "Spark", None, None, None, None, None, None), ("Subject", "knows", "spark ", None, None, None, None, None, None)], "subject string, predicate string, object string, evidence string, source_title string, source_url string, source_section string, tags array<string>, confidence float")
    edited = facts.apply_edits(_claims(spark, sf_dir), _rules(spark), adds, ["chunk_id", "place"])
    return edited.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


_QA = f"""SELECT p_partkey AS chunk_id, question, answer FROM (SELECT *, (p_size % 40 + 1)::VARCHAR AS y, (p_size % 30 + 8)::VARCHAR AS a FROM part) CROSS JOIN LATERAL (VALUES
('How many years has the subject been programming?', 'Customer has been programming for ' || y || ' years.'), ('How long has the subject been programming?', 'Customer has been programming for ' || y || ' years.'),
('Does the subject programming very well?', 'Customer has been programming for ' || y || ' years.'), ('Does the subject programming very well?', 'the subject has been programming for ' || y || ' years.'),
('How long has the subject been programming?', 'the subject has been programming for ' || y || ' years.'), ('How many years has the subject been engineering?', 'She has done engineering at home since age ' || a || '.'),
('How long has the subject been engineering?', 'She has done engineering at home since age ' || a || '.'), ('Does the subject engineering very well?', 'She has done engineering at home since age ' || a || '.'),
('Who has the subject worked for?', 'the subject has worked for ' || p_brand || ', ' || upper(p_type) || ' and Plain Works.'),
('How many years has the subject been programming?', 'the subject has been programming for ' || y || ' years.'), ('Since what age has the subject been engineering?', 'the subject has been engineering since age ' || a || '.'),
('Does the subject know ' || p_name || '?', 'the subject has skill in ' || p_name || '.'), ('Does the subject know Rust?', 'the subject has skill in Rust.'), ('Does the subject know SQL?', 'the subject has skill in SQL.'),
('Who has the subject worked for?', 'the subject has worked for ' || p_brand || ', ' || upper(p_type) || ', Plain Works, ' || replace(p_brand, '#', ' ') || ', Nova ' || p_partkey::VARCHAR || ', Orbit ' || p_partkey::VARCHAR || '.'),
('What skills does the subject have?', 'the subject has skills in ' || p_name || ', Rust, SQL.')) AS t(question, answer)"""


@named(_QA)
def qa_pairs(spark, sf_dir):
    return facts.extract_pairs(_prose(spark, sf_dir)).select("chunk_id", "question", "answer")


@named(f"SELECT min(qa_id)::BIGINT AS qa_id, count(*)::BIGINT AS copies FROM (SELECT qa_id, lower({s_strip('question')}) AS q, lower({s_strip('coalesce(answer, ' + s_lit('') + ')')}) AS a FROM qa) GROUP BY q, a")
def qa_dedup(spark, sf_dir):
    qa = read(spark, sf_dir, "qa")
    same = [F.lower(T.strip("question")).alias("_q"), F.lower(T.strip(F.coalesce("answer", F.lit("")))).alias("_a")]
    first = facts.dedup_pairs(qa, ["qa_id"]).select("qa_id", *same)
    return first.join(qa.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), ["_q", "_a"]).select("qa_id", "copies")


@named("SELECT doc_id FROM documents WHERE contains(lower(text), 'years') OR contains(lower(text), 'since') OR contains(lower(text), 'worked for') OR contains(lower(text), 'worked at') OR regexp_matches(text, '[0-9]')")
def fact_dense(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(T.is_fact_dense("text")).select("doc_id")


@named("SELECT qa_id, " + s_strip("question") + " AS question, " + s_strip("answer") + " AS answer, round(coalesce(confidence, 0.6::FLOAT), 2) AS confidence FROM qa WHERE qa_id % 5 <> 0 AND answer IS NOT NULL AND " + s_strip("answer") + " <> '' AND " + s_strip("question") + " <> ''")
def llm_json_parse(spark, sf_dir):
    one = F.to_json(F.struct(F.array(F.struct("question", "answer", F.array(F.lit("t")).alias("tags"), "confidence")).alias("qa")))
    reply = F.when(F.col("qa_id") % 5 == 0, F.concat(F.lit("Here you are: "), one)).otherwise(one)
    rows = read(spark, sf_dir, "qa").filter("answer is not null").select("qa_id", reply.alias("reply"))
    return facts.parse_generated_pairs(rows, "qa_id", "reply").select("qa_id", "question", "answer", F.round("confidence", 2).alias("confidence"))


@named("SELECT qa_id, 'Q: ' || question || ' A: ' || answer AS text FROM qa WHERE answer IS NOT NULL")
def embedding_texts(spark, sf_dir):
    return read(spark, sf_dir, "qa").filter("answer is not null").select("qa_id", embed.pair_text().alias("text"))


@named()
def hashed_embeddings(spark, sf_dir):
    rows = embed.embed_texts(read(spark, sf_dir, "qa"), "qa_id", embed.pair_text())
    return rows.select("qa_id", F.size("embedding").alias("dim"), F.round(F.sqrt(ranking.dot("embedding", "embedding")), 4).alias("norm"))


# Answers

_ASKED = "lower(regexp_replace(lower(question), '[^a-z0-9 _+-]', ' ', 'g'))"


def _s_has(x: str, cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {s_lit(c)})" for c in cues) + ")"


@named(f"SELECT qa_id, CASE {' '.join(f'WHEN {_s_has(chr(39) + ' ' + chr(39) + ' || q || ' + chr(39) + ' ' + chr(39), cues)} THEN {s_lit(n)}' for n, cues in A.INTENTS)} ELSE 'generic' END AS intent, regexp_matches(q, '{A.YES_NO}') AS yes_no FROM (SELECT qa_id, {s_one_space(_ASKED)} AS q FROM qa)")
def query_intents(spark, sf_dir):
    return read(spark, sf_dir, "qa").select("qa_id", A.intent("question").alias("intent"), A.is_yes_no("question").alias("yes_no"))


def _s_readable(q: str) -> str:
    return s_one_space(f"regexp_replace(lower({q}), '[^a-z0-9 _+-]', ' ', 'g')")


def _s_subject(q: str) -> str:
    """The subject's words, by every frame."""
    inner = [f"trim(regexp_extract({_s_readable(q)}, '^{start}(.*?)({'|'.join(ends)})', 1))" for start, ends in A.SUBJECT_FRAMES]
    return "flatten([" + ", ".join(f"CASE WHEN {x} <> '' AND len(string_split({x}, ' ')) <= 4 THEN string_split({x}, ' ') ELSE []::VARCHAR[] END" for x in inner) + "])"


def _s_terms(q: str) -> str:
    plain = f"list_filter(regexp_split_to_array(regexp_replace(lower({q}), '[^a-z0-9+/ _-]', ' ', 'g'), ' +'), lambda t_: t_ <> '')"
    every = f"list_distinct(flatten(list_transform({plain}, lambda t_: CASE WHEN regexp_matches(t_, '[-/_]') THEN [t_, regexp_replace(t_, '[-/_]', '', 'g')] || regexp_split_to_array(t_, '[-/_]') ELSE [t_] END)))"
    return f"list_filter({every}, lambda u_: length(u_) > 1 AND u_ NOT IN ({', '.join(map(s_lit, A.STOP_WORDS))}) AND NOT list_contains({_s_subject(q)}, u_))"


def _s_intent(q: str) -> str:
    spoken = f"(' ' || {_s_readable(q)} || ' ')"
    return "CASE " + " ".join(f"WHEN {_s_has(spoken, cues)} THEN {s_lit(n)}" for n, cues in A.INTENTS) + " ELSE 'generic' END"


@named(f"SELECT qa_id, unnest({_s_terms('question')}) AS term FROM qa")
def query_terms(spark, sf_dir):
    return read(spark, sf_dir, "qa").select("qa_id", F.explode(A.meaning_terms("question")).alias("term"))


@named(f"""SELECT claim_id, CASE WHEN predicate = 'worked_for' THEN 'Worked for ' || o || '.' WHEN predicate = 'has_skill' THEN 'Has skill ' || o || '.' WHEN predicate LIKE 'years!_%' ESCAPE '!' THEN o || ' of ' || replace(substr(predicate, 7), '_', ' ') || ' experience.'
WHEN predicate LIKE 'since!_age!_%' ESCAPE '!' THEN 'Since age ' || o || ' in ' || replace(substr(predicate, 11), '_', ' ') || '.' ELSE {s_one_space("replace(predicate, '_', ' ') || ' ' || o || '.'")} END AS sentence FROM (SELECT claim_id, predicate, {s_strip('object')} AS o FROM claims WHERE object IS NOT NULL)""")
def claim_sentences(spark, sf_dir):
    return read(spark, sf_dir, "claims").filter("object is not null").select("claim_id", A.claim_sentence("predicate", "object").alias("sentence"))


_QUESTIONS = [("k", "Does Nipigi Muru know vector ranking?"), ("w", "Who has the maintainer worked for?"), ("d", "How many years has the editor been programming?"), ("g", "Tell me about schema-design")]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim against each of a stated set of questions, as evidence of one lane."""
    claims = read(spark, sf_dir, "claims").filter("object is not null and subject is not null")
    questions = cut(A.analyse(asked(spark, _QUESTIONS)))
    return claims.crossJoin(F.broadcast(questions)).select("query_id", "query", "intent", "terms", "yes_no", "claim_id", F.lit("claims").alias("lane"), T.one_space(F.concat(F.coalesce("subject", F.lit("")), F.lit(": "), A.claim_sentence("predicate", "object"))).alias("text"), F.col("source_url").alias("url"), F.col("confidence").cast("double").alias("raw_score"), "predicate", F.col("claim_id").alias("place"))


_CLAIM_SENTENCE = """CASE WHEN predicate = 'worked_for' THEN 'Worked for ' || o || '.' WHEN predicate = 'has_skill' THEN 'Has skill ' || o || '.' WHEN predicate LIKE 'years!_%' ESCAPE '!' THEN o || ' of ' || replace(substr(predicate, 7), '_', ' ') || ' experience.' ELSE 'Since age ' || o || ' in ' || replace(substr(predicate, 11), '_', ' ') || '.' END"""
_Q_FACTS = f"(SELECT query_id, {_s_intent('query')} AS intent, regexp_matches({_s_readable('query')}, '{A.YES_NO}') AND {_s_intent('query')} = 'knowledge' AS yes_no, {_s_terms('query')} AS terms FROM {s_values(_QUESTIONS, 'query_id, query')})"
_SCORED = f"""WITH e AS (SELECT claim_id, predicate, source_url, confidence, {s_one_space(f"subject || ': ' || {_CLAIM_SENTENCE}")} AS text FROM (SELECT *, {s_strip('object')} AS o FROM claims WHERE object IS NOT NULL AND subject IS NOT NULL)),
m AS (SELECT query_id, intent, yes_no, claim_id, predicate, text, source_url, confidence, terms, list_filter(terms, lambda t_: contains(lower(text), t_)) AS matched FROM e CROSS JOIN {_Q_FACTS}),
s AS (SELECT *, 0.9::DOUBLE + 1.4::DOUBLE * len(matched) / len(terms) + 0.25::DOUBLE * coalesce(least(greatest(confidence::DOUBLE, 0), 1), 0) + CASE intent WHEN 'knowledge' THEN CASE WHEN predicate = 'has_skill' THEN 0.95 WHEN predicate = 'worked_for' THEN -1.1 ELSE -0.45 END WHEN 'work_history' THEN CASE WHEN predicate = 'worked_for' THEN 0.95 WHEN predicate = 'has_skill' THEN -0.7 ELSE -0.3 END
 WHEN 'duration' THEN CASE WHEN predicate = 'worked_for' THEN -0.8 WHEN predicate = 'has_skill' THEN -0.4 ELSE 0.95 END ELSE 0.0 END + CASE WHEN yes_no AND predicate = 'has_skill' THEN 0.22 WHEN yes_no AND predicate = 'worked_for' THEN -0.2 ELSE 0.0 END AS score FROM m)"""


@named(f"{_SCORED} SELECT query_id, claim_id, array_to_string(list_sort(matched), '|') AS matched, round(score, 6) AS score FROM s")
def evidence_scores(spark, sf_dir):
    return A.score_evidence(_evidence(spark, sf_dir)).select("query_id", "claim_id", F.array_join(F.array_sort("matched"), "|").alias("matched"), r6("score", "score"))


def _s_closed(x: str) -> str:
    return f"CASE WHEN regexp_matches({s_strip(x)}, '[.!?…]$') THEN {s_strip(x)} ELSE {s_strip(x)} || '.' END"


@named(
    f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, claim_id) AS k FROM s),
g AS (SELECT * FROM r WHERE k <= 12 AND round(score, 9) >= CASE intent WHEN 'knowledge' THEN 1.1 WHEN 'generic' THEN 0.95 ELSE 1.0 END AND (len(terms) = 0 OR len(matched) > 0)),
a AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k) = 1),
b AS (SELECT g.* FROM g JOIN a ON g.query_id = a.query_id AND g.k > a.k WHERE len(list_filter(g.matched, lambda t_: NOT list_contains(a.matched, t_))) > 0 QUALIFY row_number() OVER (PARTITION BY g.query_id ORDER BY g.k) = 1)
SELECT i.query_id, CASE WHEN a.k IS NULL THEN {s_lit(A.NO_EVIDENCE)} ELSE {_s_closed('a.text')} || coalesce(' ' || {_s_closed('b.text')}, '') END AS text,
CASE WHEN a.k IS NULL THEN '' WHEN b.k IS NULL OR b.source_url = a.source_url THEN a.source_url ELSE a.source_url || '|' || b.source_url END AS citations, CASE WHEN a.k IS NULL THEN 'search' ELSE 'claims' END AS lane
FROM (SELECT DISTINCT query_id FROM s) i LEFT JOIN a ON i.query_id = a.query_id LEFT JOIN b ON i.query_id = b.query_id"""
)
def answers(spark, sf_dir):
    scored = A.score_evidence(_evidence(spark, sf_dir))
    best = lexical.top(scored.select("query_id", "claim_id", "score"), 12, "claim_id").select("query_id", "claim_id", "rank")
    evidence = _evidence(spark, sf_dir).join(F.broadcast(best), ["query_id", "claim_id"]).withColumn("place", F.col("rank"))
    return A.answers(evidence).select("query_id", "text", F.array_join("citations", "|").alias("citations"), "lane")


# Evaluation


@named("SELECT item_id, contains(d, c) AS passed, CASE WHEN contains(d, c) THEN coalesce(w, 1.0) ELSE 0.0 END AS score FROM (SELECT item_id, weight::DOUBLE AS w, " + s_one_space("lower(text)") + " AS d, " + s_one_space("lower(case_id)") + " AS c0, CASE item_id % 3 WHEN 0 THEN 'unless' WHEN 1 THEN 'which' ELSE 'asked about' END AS c FROM eval_items WHERE text IS NOT NULL)")
def acceptance_eval(spark, sf_dir):
    items = read(spark, sf_dir, "eval_items").filter("text is not null")
    phrase = F.when(F.col("item_id") % 3 == 0, "Unless").when(F.col("item_id") % 3 == 1, " WHICH ").otherwise("asked  about")
    cases = items.select(F.col("item_id").alias("case_id"), F.array(phrase, F.lit(" ")).alias("must_match_any"), F.array(phrase).alias("must_include_all"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    done = evaluate.evaluate_cases(cases, items.select(F.col("item_id").alias("case_id"), F.col("text").alias("context")))
    return done.select(F.col("case_id").alias("item_id"), "passed", "score")


@named()
def tune_sweep(spark, sf_dir):
    """The default grid of chunk sizes and overlaps over all pages, judged by hybrid search."""
    cases = [("1", "release script nightly builds", ["release"], []), ("2", "who looks after the access policy", ["access policy", "owner"], []), ("3", "tag cloud offline reading", [], ["tag cloud"])]
    suite = spark.createDataFrame([(*c, 1.0) for c in cases], "case_id string, query string, must_match_any array<string>, must_include_all array<string>, weight double")
    docs = read(spark, sf_dir, "site_docs").select("doc_id", "title", "url", "body")
    return pipeline.tune(docs, suite)


_RANKED = "SELECT query_id, '/c/' || (chunk_id % 50)::VARCHAR || '/' AS url, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, max(score) AS s FROM search_result WHERE lane = 'judge' AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL))"


@named(
    f"""WITH r AS ({_RANKED}), u AS (SELECT query_id, rtrim(url, '/') AS url, min(rank) AS rank FROM r GROUP BY ALL), v AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS rank FROM u),
l AS (SELECT query_id, '/c/' || c::VARCHAR AS url, g FROM (SELECT query_id, chunk_id % 50 AS c, max(CASE WHEN score > 0.5 THEN 2.0 ELSE 1.0 END) AS g FROM search_result WHERE lane = 'semantic' AND score > 0.3 AND NOT isnan(score) GROUP BY ALL)),
i AS (SELECT query_id, sum((pow(2, g) - 1) / log2(n + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, url) AS n FROM l) WHERE n <= 5 GROUP BY query_id),
p AS (SELECT query_id, min(CASE WHEN g IS NOT NULL THEN rank END) AS f, sum(CASE WHEN rank <= 5 AND g IS NOT NULL THEN (pow(2, g) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM v LEFT JOIN l USING (query_id, url) GROUP BY query_id)
SELECT query_id, f::INT AS first_rank, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_1, CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_5, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM i LEFT JOIN p USING (query_id)"""
)
def relevance_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "search_result").filter("score is not null and not isnan(score)").withColumn("url", F.concat(F.lit("/C/"), (F.col("chunk_id") % 50).cast("string"), F.lit("/")))
    judged = rows.filter("lane = 'judge'").groupBy("query_id", "chunk_id", "url").agg(F.max("score").alias("score"))
    ranked = lexical.top(judged, None, "chunk_id").select("query_id", "url", "rank")
    labels = rows.filter("lane = 'semantic' and score > 0.3").select("query_id", "url", F.when(F.col("score") > 0.5, 2.0).otherwise(1.0).alias("grade"))
    found = evaluate.relevance_metrics(ranked, labels, (1, 5), 5)
    return found.select("query_id", "first_rank", r6("mrr", "mrr"), "hit_at_1", "hit_at_5", r6("ndcg", "ndcg"))


@named("SELECT event_type, count(*)::BIGINT AS runs, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(list_sort(list(value))[(round_even(0.95::DOUBLE * (count(*) - 1), 0))::INT + 1], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_report(spark, sf_dir):
    found = evaluate.latency_report(read(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", "runs", r6("mean", "mean"), r6("median", "median"), r6("p95", "p95"))


@named("SELECT md5_ AS text_hash, count(*)::BIGINT AS copies, min(doc_id)::BIGINT AS first_id FROM (SELECT md5(text) AS md5_, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY md5_")
def duplicates_by_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text is not null").groupBy(F.md5("text").alias("text_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@named("SELECT r, CASE r WHEN 1 THEN 2.0 WHEN 2 THEN 1.75 WHEN 3 THEN 1.5 WHEN 4 THEN 1.25 ELSE 1.0 END::DOUBLE AS weight, count(*)::BIGINT AS n FROM (SELECT (p_size % 6)::INT AS r FROM part) GROUP BY r")
def rating_weights(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select((F.col("p_size") % 6).cast("int").alias("r"))
    return rows.groupBy("r").agg(F.count(F.lit(1)).alias("n")).select("r", evaluate.rating_weight("r").alias("weight"), "n")


# Reports

_RUNS = "SELECT 'd' || (c_custkey % 7)::VARCHAR AS dataset_id, 'org/m:' || (c_custkey % 3)::VARCHAR AS model_id, c_custkey AS run, CASE c_custkey % 7 WHEN 0 THEN 'Large' WHEN 1 THEN 'medium' WHEN 2 THEN 'other' ELSE 'small' END AS size_tier, c_acctbal AS index_duration_s, c_custkey * 1000 AS index_size_bytes, c_nationkey * 500 AS model_cache_bytes, CASE WHEN c_nationkey > 5 THEN c_nationkey * 300 END AS model_weights_bytes, c_nationkey AS dataset_file_count, c_nationkey * 2 AS dataset_doc_count, c_custkey * 4096 AS dataset_total_bytes FROM customer"
_SEARCHES = "SELECT 'd' || (o_custkey % 9)::VARCHAR AS dataset_id, 'org/m:' || (o_orderkey % 4)::VARCHAR AS model_id, o_totalprice AS latency_ms, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS relevance_labeled, 1.0 / (1 + o_orderkey % 5) AS mrr, CASE WHEN o_orderkey % 5 < 1 THEN 1.0 ELSE 0.0 END AS hit_at_1, 1.0 / (1 + o_orderkey % 3) AS ndcg_at_5 FROM orders"
_JUDGED = "SELECT 'd' || (s_suppkey % 5)::VARCHAR AS dataset_id, 'org/m:' || (s_suppkey % 3)::VARCHAR AS model_id, s_nationkey % 6 AS relevance_score, s_suppkey % 6 AS grounding_score FROM supplier"
_TIER = "CASE lower(size_tier) WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'large' THEN 3 ELSE 4 END"


def _frame(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return read(spark, sf_dir, table).selectExpr(*[c.strip() for c in re.split(r",(?![^(]*\))", sql.removeprefix("SELECT ").rsplit(" FROM ", 1)[0].replace("::VARCHAR", "").replace("(c_custkey % 7)", "string(c_custkey % 7)"))])


@named(
    f"""WITH i AS (SELECT dataset_id, model_id, min(size_tier) AS size_tier, count(*) AS index_runs, avg(index_duration_s) AS index_s, avg(index_size_bytes) / 1048576 AS index_mb, avg(model_cache_bytes) / 1048576 AS cache_mb, avg(coalesce(model_weights_bytes, 0)) / 1048576 AS weights_mb FROM ({_RUNS}) GROUP BY ALL),
s AS (SELECT dataset_id, model_id, median(latency_ms) AS m, list_sort(list(latency_ms))[(round_even(0.95::DOUBLE * (count(*) - 1), 0))::INT + 1] AS p FROM ({_SEARCHES}) GROUP BY ALL),
l AS (SELECT dataset_id, model_id, count(*) AS labelled, avg(mrr) AS mrr, avg(hit_at_1) AS hit_at_1, avg(ndcg_at_5) AS ndcg_at_5 FROM ({_SEARCHES}) WHERE relevance_labeled > 0 GROUP BY ALL),
j AS (SELECT dataset_id, model_id, avg(relevance_score) AS r, avg(grounding_score) AS g FROM ({_JUDGED}) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY {_TIER}, dataset_id, model_id)::INT AS place, dataset_id, replace(replace(model_id, '/', '__'), ':', '_') AS model, index_runs, round(index_s, 4) AS index_s, round(index_mb, 6) AS index_mb, round(cache_mb, 6) AS cache_mb, round(weights_mb, 6) AS weights_mb, round(coalesce(m, 0), 4) AS query_median_ms, round(coalesce(p, 0), 4) AS query_p95_ms, coalesce(labelled, 0) AS labelled,
round(coalesce(mrr, 0)::DOUBLE, 6) AS mrr, round(coalesce(hit_at_1, 0)::DOUBLE, 6) AS hit_at_1, round(coalesce(ndcg_at_5, 0)::DOUBLE, 6) AS ndcg_at_5, round(coalesce(r, 0), 6) AS judged_relevance, round(coalesce(g, 0), 6) AS judged_grounding
FROM i LEFT JOIN s USING (dataset_id, model_id) LEFT JOIN l USING (dataset_id, model_id) LEFT JOIN j USING (dataset_id, model_id)"""
)
def benchmark_report(spark, sf_dir):
    found = report.benchmark_report(_frame(spark, sf_dir, "customer", _RUNS), _frame(spark, sf_dir, "orders", _SEARCHES), _frame(spark, sf_dir, "supplier", _JUDGED))
    place = F.row_number().over(Window.orderBy("place"))  # one row a combination
    return found.select(place.alias("place"), "dataset_id", report.slug("model_id").alias("model"), "index_runs", F.round("index_s", 4).alias("index_s"), *[r6(c, c) for c in ("index_mb", "cache_mb", "weights_mb")], F.round("query_median_ms", 4).alias("query_median_ms"), F.round("query_p95_ms", 4).alias("query_p95_ms"), "labelled", *[r6(c, c) for c in ("mrr", "hit_at_1", "ndcg_at_5", "judged_relevance", "judged_grounding")])


@named(f"SELECT dataset_id, size_tier, arg_min(dataset_file_count, (model_id, run))::INT AS files, arg_min(dataset_doc_count, (model_id, run))::INT AS docs, round(arg_min(dataset_total_bytes, (model_id, run)) / 1048576, 6) AS total_mb FROM ({_RUNS}) GROUP BY dataset_id, size_tier")
def dataset_profile(spark, sf_dir):
    found = report.dataset_profile(_frame(spark, sf_dir, "customer", _RUNS))
    return found.select("dataset_id", "size_tier", F.col("files").cast("int").alias("files"), F.col("docs").cast("int").alias("docs"), r6("total_mb", "total_mb"))


@named("SELECT c.dataset, m.model, r.run::INT AS run FROM (SELECT DISTINCT c_mktsegment AS dataset FROM customer) c CROSS JOIN (SELECT DISTINCT p_brand AS model FROM part) m CROSS JOIN (VALUES (1), (2)) AS r(run)")
def run_matrix(spark, sf_dir):
    datasets = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset")).distinct()
    return report.run_matrix(datasets, read(spark, sf_dir, "part").select(F.col("p_brand").alias("model")).distinct(), 2)


@named("SELECT query_id, sha256('d' || 'org/m' || query_id || '[' || string_agg('{\"chunk_id\":' || chunk_id::VARCHAR || '}', ',' ORDER BY r) || ']') AS key FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS r FROM (SELECT DISTINCT query_id, chunk_id FROM search_result WHERE lane = 'judge')) WHERE r <= 5 GROUP BY query_id")
def result_keys(spark, sf_dir):
    hits = read(spark, sf_dir, "search_result").filter("lane = 'judge'").select("query_id", "chunk_id").distinct().withColumn("score", -F.col("chunk_id"))
    five = lexical.top(hits, 5, "chunk_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id"))).alias("results"))
    return five.withColumn("dataset_id", F.lit("d")).withColumn("model_id", F.lit("org/m")).select("query_id", report.result_key().alias("key"))


@named("SELECT qa_id, CASE WHEN contains(answer, '{') AND regexp_matches(answer, '(?s)\\{.*\\}') THEN regexp_extract(answer, '(?s)(\\{.*\\})', 1) END AS object FROM (SELECT qa_id, CASE WHEN qa_id % 3 = 0 THEN 'Sure: {\"a\": {\"b\": ' || qa_id::VARCHAR || E'}}\\nDone.' ELSE question END AS answer FROM qa)")
def json_in_replies(spark, sf_dir):
    reply = F.when(F.col("qa_id") % 3 == 0, F.concat(F.lit('Sure: {"a": {"b": '), F.col("qa_id").cast("string"), F.lit("}}\nDone."))).otherwise(F.col("question"))
    return read(spark, sf_dir, "qa").select("qa_id", report.outermost_json(reply).alias("object"))


# Streams


@named("SELECT user_id, arg_max(t, ts) AS text FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, event_type || '-' || event_id::VARCHAR AS t, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 HOUR THEN 0 ELSE 1 END AS n FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, g")
def settled_queries(spark, sf_dir):
    keys = read(spark, sf_dir, "events").select("user_id", "ts", F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("text"))
    return ingest.settled_queries(keys, "3 hours").select("user_id", "text")
