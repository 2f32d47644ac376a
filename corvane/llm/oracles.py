"""DuckDB counterparts of the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

SPACE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _letters(x: str) -> str:
    return rf"regexp_replace(lower(upper(nfc_normalize({x}))), '[^\p{{L}}\p{{N}}]', '', 'g')"


P1 = """WITH s AS (SELECT query_id, lane, chunk_id, max(score) AS s FROM search_result WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY ALL),
m AS (SELECT query_id, lane, median(s) AS med FROM s GROUP BY ALL), d AS (SELECT *, abs(s - med) AS d FROM s JOIN m USING (query_id, lane)),
k AS (SELECT query_id, lane, CASE WHEN median(d) > 0 THEN 1.4826 * median(d) ELSE nullif(avg(d), 0) END AS scale FROM d GROUP BY ALL),
x AS (SELECT query_id, chunk_id, sum(ln(greatest(coalesce(1 / (1 + exp(-greatest(least((s - med) / scale, 40), -40))), 0.5), 1e-9)) - ln(0.5)) AS x FROM d JOIN k USING (query_id, lane) GROUP BY ALL),
n AS (SELECT query_id, count(DISTINCT lane) AS n FROM s GROUP BY ALL)
SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(x / n, 12) DESC, chunk_id) AS r FROM x JOIN n USING (query_id)) WHERE r = 1"""

P2 = """WITH p AS (SELECT term, chunk_id, max(tf) AS tf FROM postings WHERE term IS NOT NULL AND chunk_id IS NOT NULL AND tf >= 1 GROUP BY ALL),
l AS (SELECT chunk_id, max(dl) AS dl, max(s) AS s FROM (SELECT chunk_id, dl, 0 AS s FROM doc_len UNION ALL SELECT chunk_id, NULL, sum(tf) FROM p GROUP BY chunk_id) GROUP BY chunk_id),
z AS (SELECT chunk_id, CASE WHEN dl > 0 THEN dl WHEN s > 0 THEN s END::DOUBLE AS len FROM l), c AS (SELECT count(*) AS n, avg(len) AS a FROM z),
f AS (SELECT term, sum(tf) AS f FROM p GROUP BY term),
w AS (SELECT chunk_id, term, tf * log2(1 + a / len) AS t, f / n::DOUBLE AS m FROM p JOIN f USING (term) JOIN z USING (chunk_id) CROSS JOIN c)
SELECT chunk_id, term FROM (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY (log2(1 + m) + t * log2((1 + m) / m)) / (t + 1) DESC, term) AS r FROM w) WHERE r = 1"""

P5 = f"""WITH k AS (SELECT 'qa' AS lane, qa_id AS id, '' AS p, {_letters("question")} AS a, 'x' AS b FROM qa UNION ALL
SELECT 'claims', claim_id, predicate, least(s, o), greatest(s, o) FROM (SELECT claim_id, predicate, {_letters("subject")} AS s, {_letters("object")} AS o FROM claims) WHERE s <> '' AND o <> ''),
g AS (SELECT *, min(id) OVER (PARTITION BY lane, p, a, b) AS first_id FROM k WHERE a <> '')
SELECT lane, first_id, id AS copy_id FROM g WHERE id <> first_id"""

P6 = """WITH v AS (SELECT vec_id, lane, embedding::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x_: isnan(x_))) AND list_bool_or(list_transform(embedding, lambda x_: x_ <> 0)))
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM v a JOIN v b ON a.lane = b.lane AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9"""



def _count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE}]+'))"


_PARTS = rf"regexp_split_to_array(t, '\n[{SPACE}]*\n')"
_SENTENCES = rf"string_split(regexp_replace(x_, '([.!?…])[{SPACE}]', '\1' || chr(1), 'g'), chr(1))"
P7 = f"""WITH i AS (SELECT 'doc' AS item_kind, doc_id AS item_id, body AS t FROM site_docs UNION ALL SELECT 'chunk', chunk_id, text FROM chunks),
n AS (SELECT item_kind, item_id, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM i WHERE {_count("t")} > 192)
SELECT item_kind, item_id, CASE WHEN list_max(list_transform({_PARTS}, lambda x_: {_count("x_")})) <= 192 THEN 'paragraph'
WHEN list_max(flatten(list_transform({_PARTS}, lambda x_: list_transform({_SENTENCES}, lambda y_: {_count("y_")})))) <= 192 THEN 'sentence' ELSE 'word' END AS boundary FROM n"""

_GRAMS = r"SELECT id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {id} AS id, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL))"
P9 = f"""WITH i AS ({_GRAMS.format(id="item_id", text="text", table="eval_items")}), d AS ({_GRAMS.format(id="doc_id", text="text", table="documents")})
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p5_found": P5, "p6_found": P6, "p7_found": P7, "p9_found": P9}
