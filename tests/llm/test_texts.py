import random
import time

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from corvane.llm import leakage, markup, mojibake, pairs, split, tokenize

ODD = ["", None, " ", "\n\n  x", "naïve café 日本語 🚀👩\u200d💻", "a" * 3000, "<|endoftext|> don't I'LL 12345 ...!!", "\u200b\xa0\u2003tab\tnew\r\n", "ﬁ Ⅷ ½ e\u0301", "x" + " " * 50 + "y  "]


def test_encoding_equals_a_public_library(spark):
    import base64
    from pathlib import Path

    path = Path(tokenize.VOCABULARY).with_name("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
    known = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab eéЖ語\n.1'") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_texts(df).collect()}
    assert got == {i: known.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokenize.encode_texts(df.limit(0)).count() == 0


def test_leaks(spark):
    item = "Under rule 191 of Madupe no archive may weigh more than 213 barrels of wool unless Fesopi is copper."
    other = "Under rule 77 of Tokuda no windmill may lose more than 12 crates of tallow unless Rimo is frozen today."
    items = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, "too short", 0), (4, None, 0), (1, item, 1)], "item_id long, text string, d int")
    w = item.split()
    docs = [(1, "x " + item), (2, "RULE\n191 – of_Madupe, **no** archive may\u200b weigh more than 213 barrels"), (3, " ".join(w[:11])), (4, " ".join(w[:9] + ["break"] + w[9:])), (5, None), (6, ""), (7, " ".join(reversed(w))), (8, other + " filler " * 400 + item), (8, other)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, i int")
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(df, items).collect())
    assert got == [(1, 1), (2, 1), (8, 1), (8, 2)]
    assert leakage.leaks(df, items.limit(0)).count() == leakage.leaks(df.limit(0), items).count() == 0


def test_retrieval_equals_a_full_scan():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 30)))) for i in range(150)]
    index = leakage.ItemIndex(texts, 12)
    for _ in range(200):
        base = rng.choice(texts)[1].split()
        words = list(dict.fromkeys(base[: rng.randint(3, 14)] + rng.choices(vocabulary, k=rng.randint(0, 12))))
        terms = [index.vocabulary[w] for w in words if w in index.vocabulary]
        score = {}
        for t in terms:
            for k in range(index.first[t], index.first[t + 1]):
                score[index.where[k]] = score.get(index.where[k], 0) + index.weight[k]
        rows, places = index.retrieve(np.array([terms + [-1, -1], [-1, -1] + terms[::-1]]))
        for k in (0, 1):
            assert sorted(places[rows == k]) == sorted(a for a, s in score.items() if s >= 1 - 1e-9)


def test_leaks_of_many_items_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(300)]
    docs = []
    for d in range(120):
        w = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items)[1].split()
            a, n = rng.randint(0, max(0, len(source) - 12)), rng.randint(10, 14)
            w += source[a : a + n] + rng.choices(words, k=3)
        docs.append((d, " ".join(w)))
    grams = lambda t: {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
    want = sorted((d, i) for d, t in docs for i, x in items if grams(t) & grams(x))
    for size in (10**6, 4000, 400):  # one part, some, more than one pass
        monkeypatch.setattr(leakage, "INDEX_BYTES", size)
        found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == want and want


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437"])
def test_round_trips(encoding):
    back = mojibake.CODECS[encoding][1]
    garble = lambda t: "".join(c if c < "\x80" else "".join(back[b] for b in c.encode()) for c in t)
    for text in ("Le café est fermé – l’équipe préfère été.", "Größe prüfen, Übersicht ändern", "La opción más rápida del menú"):
        assert mojibake.repair(garble(text)) == (text, 1)
    if encoding == "cp1252":
        assert mojibake.repair(garble(garble("déjà vu"))) == ("déjà vu", 2)


@pytest.mark.parametrize("read", ["latin-1", "cp1252"])
@pytest.mark.parametrize(
    "text,meant",
    [
        ("Συντακτης του κειμενου", "cp1253"), ("Συντακτης του κειμενου", "iso8859-7"), ("РЕДАКТОР", "cp1251"), ("Редактор хранит текст", "cp1251"), ("Редактор хранит текст", "koi8-r"), ("РЕДАКТОР ХРАНИТ", "iso8859-5"),
        ("索引和搜索结果都在这里可以看到", "gbk"), ("검색 결과를 확인하고 색인을 다시 만듭니다", "euc_kr"), ("検索の結果をここで確認します", "euc_jp"),
    ],
)
def test_other_alphabets_come_back(text, meant, read):
    back = mojibake.CODECS[read][1]
    garbled = "".join(chr(b) if b < 128 else back[b] for b in text.encode(meant))
    assert mojibake.repair(garbled) == (text, 1)


def test_no_wrong_alphabet():
    for text in ("Ça ÿ", "naïve ÀÉÎ", "¡¿Ñ?", "ÄÖÜ ÄÖÜß", "Ÿ Œ", "ĄĆĘŁ ąćęł", "ÀÈÌÒÙ"):
        assert mojibake.repair(text) == (text, 0)
    assert mojibake.repair("“cafÃ©” – «prÃªt»")[0] == "“café” – «prêt»"


def test_correct_texts_are_left_alone(spark):
    fine = ["NAVEGAÇÃO e SEÇÃO até AMANHÃ.", "Её список сборки", "检索結果を確認します。", "20 °C ± 2 with a façade of 3 “legacy” pages", "Το ευρετήριο ✓", "👩‍💻 🚀", "quotes `cafÃ©` for `café`", "d’été – l’été, “Đã lưu”", "Ångström (Å), 5 µm ©"]
    assert all(mojibake.repair(t) == (t, 0) for t in fine)
    assert mojibake.repair("Ðåäàêòîð õðàíèò") == ("Редактор хранит", 1)
    rows = [(i, t) for i, t in enumerate(fine)] + [(20, "lost � here"), (21, None), (22, ""), (23, "cafÃ©"), (23, "cafÃ©"), (24, "only `�` shown")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, layers int")
    assert sorted((r["doc_id"], r["recovery"]) for r in mojibake.repair_texts(df).collect()) == [(20, "lossy"), (23, "full"), (23, "full")]


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("Why?", None, "empty"), ("Why?", " \u200b", "empty"), ("Why?", "n/a.", "empty"), ("Why?", "(no answer)", "empty"), ("Why?", "Yes", None), ("How many?", "42", None),
        ("Where does it keep the index?", "Answer: where does it keep the index?", "copied_question"), ("Is the map of Ann needed for sites?", "Yes, the map of Ann is needed for sites.", None), ("Explain how Ann handles builds.", "Explain how Ann handles builds. Explain how Ann handles builds.", "copied_question"),
        ("What is the index?", "I'm sorry, but I can't help with that.", "refusal"), ("What is the index?", 'The server answers "Sorry, I can\'t do that" while it is locked.', None), ("Pourquoi le modèle est-il lent ?", "Je suis désolé, mais je ne peux pas répondre à cette question.", "refusal"), ("Warum ist der Index langsam?", "Diese Frage kann ich leider nicht beantworten.", "refusal"), ("What is it?", "I cannot praise the index enough: it needs it to cache pages.", None),
        ("What does the index of Ann do when it is full?", "La recherche continue de fonctionner, mais la page n’est plus dans le sommaire.", "other_language"), ("What is the page called?", "The page is called « Réglages de l’index et de la page » and sits next to it.", None),
        ("What is the index?", "It is a table. The second part of", "truncated"), ("What is the index?", "1. Open it.\n2.", "truncated"), ("What is the index?", "1. Open it.\n\n2.  \n\n", "truncated"), ("What is the index?", "1. Open it.\n2.\nClose it.", None), ("What is the index?", "7.", None), ("What is the index?", "Set it in `config.", "truncated"), ("What is the index?", "- one\n- two", None), ("What is the index?", "Use the name „Übersicht“, since it is there.", None), ("What is the index?", "A table, a map and a list", None), ("", "Some answer.", None), (None, "It is open (", "truncated"),
    ],
)
def test_pairs(question, answer, defect):
    assert pairs.defect_of(question, answer) == defect


def test_copied_questions_of_any_length_and_script():
    asked = "Where does it keep the index?"
    for question, answer in ((asked, " ".join([asked] * 7)), (asked, "Answer: " + " ".join([asked] * 400)), ("Backups?", "Backups!"), ("Backups?", "backups, backups"), ("索引とは何ですか？", "索引とは何ですか"), ("什么是索引？", "什么是索引什么是索引")):
        assert pairs.defect_of(question, answer) == "copied_question"
    for question, answer in ((asked, " ".join([asked] * 7) + " It keeps it in Oslo."), ("Backups?", "Yes, backups."), ("Backups?", "Nightly backups."), ("この索引は必要ですか？", "この索引は必要です。"), ("索引とは何ですか？", "索引とは表です。")):
        assert pairs.defect_of(question, answer) is None


def test_pairs_of_a_table(spark):
    df = spark.createDataFrame([(1, "Why?", None, "x"), (2, None, None, "x"), (3, "Why?", "Because it is so. " * 5000, "x"), (1, "Why?", None, "x")], "qa_id long, question string, answer string, defect string")
    assert sorted((r["qa_id"], r["defect"]) for r in pairs.broken_pairs(df).collect()) == [(1, "empty"), (1, "empty"), (2, "empty")]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


def test_tiles_cover_repetitions():
    assert pairs.tiles(["a", "b", "c"], ["a", "b", "c", "x", "b", "c"]) == [True, True, True, False, True, True]


@pytest.mark.parametrize(
    "body,found",
    [
        ("Plain text costs $5 and $7, a < b and c > d, snake_case_name, List[Int], note [1], 5 * 3 * 2.", []), ("Copy C:\\new\\table\\x.txt and keep x^2, use (*) and ~, R&D # 2.", []), ("", []),
        ("<p>Hi &amp; bye</p>", ["html"]), ("text <!-- more --> text", ["html"]), ("a &eacute; b", ["html"]), ("see [it](/x/)", ["markdown"]), ("**bold**", ["markdown"]), ("### Head\n\ntext", ["markdown"]), ("```\n<b>x</b> [[y]]\n```", ["markdown"]), ("use `<b>` now", ["markdown"]),
        ("A [[page]] here", ["wiki"]), ("== Head ==\n\n* item\n# one", ["wiki"]), ("'''bold'''", ["wiki"]), ("\\section{A}\n\\item x", ["latex"]), ("the $k_1 = 1$ value", ["latex"]), ("# Head\n\n$$\nx^2\n$$\n\n[a](/b)", ["markdown", "latex"]), ("<p>\\( x \\)</p>", ["html", "latex"]), ("* a\n* b", []), ("* a\n\nsee [[b]]", ["wiki"]), ("<pre><code># x\n[[y]] **z**</code></pre>", ["html"]),
    ],
)
def test_markup(body, found):
    assert markup.languages_of(body) == found


def test_clean_text(spark):
    clean = lambda b: markup.clean_text(b)[0]
    assert clean("<h1>A</h1><ul><li>x</li><li>y</li></ul><script>z</script><pre><code>c &lt; d</code></pre>") == "# A\n\n- x\n- y\n\n```\nc < d\n```"
    assert clean("A\n=\n\nHead\n====\n\n* x **y**\n\n[r]: /u/\n\n```py\n[a](b)\n```").startswith("A\n=\n\n# Head\n\n- x y")
    assert clean("== Head ==\n\n* one\n# two\n\n'''b''' [[P|label]] [[Category:x]]") == "## Head\n\n- one\n1. two\n\nb label"
    assert clean("\\section{A}\n\\begin{itemize}\n  \\item x \\emph{y}\n\\end{itemize}\nthe $k_1$ formula.") == "# A\n- x y\nthe $k_1$ formula."
    rows = [(1, None, 0), (2, "", 0), (3, "plain\r\n", 0), (4, "<b>x</b>", 0)]
    df = spark.createDataFrame(rows, "doc_id long, body string, text int")
    got = {r["doc_id"]: (r["markup"], r["text"]) for r in markup.clean_bodies(df).collect()}
    assert got == {1: ([], None), 2: ([], ""), 3: ([], "plain\r\n"), 4: (["html"], "x")}


def test_boilerplate_goes_and_short_content_stays():
    body = "[a](/x) | [b](/y) | [c](/z)\n\nReal text stands here for the reader.\n\n* short **one**\n\n[r]: /u/"
    assert markup.clean_text(body)[0] == "Real text stands here for the reader.\n\n- short one"


def test_deep_marks_go_with_the_rest_of_the_page():
    assert markup.languages_of("See [[page]]\n\n# one\n## two\n### three") == ["wiki"]
    assert markup.languages_of("See [page](/p)\n\n## two\n### three") == markup.languages_of("## two") == ["markdown"]
    assert markup.languages_of("See [[page]]\n\n  ## two") == ["wiki", "markdown"][::-1]


def test_long_formulas_and_deep_nesting():
    formula = "a_1 + " * 80 + "a_2"
    assert markup.languages_of(f"The sum ${formula}$ stays.") == ["latex"]
    assert markup.clean_text(f"The sum ${formula}$ **stays**.")[0] == f"The sum ${formula}$ stays."
    assert markup.languages_of("It costs $5 " + "and more " * 60 + "or $7.") == []
    nested = "<!-- a -->Sum $x_1 + <code>b \\verb|c <nowiki>d</nowiki>| e</code>$ here."
    assert "\ue000" not in markup.clean_text(nested)[0]
    deep = "Sum $x + `a <code>b \\verb|c <nowiki>d</nowiki> c| b</code> a`$ here."
    text = markup.clean_text(deep)[0]
    assert "\ue000" not in text and "d" in text
    assert markup.clean_text("**b** `\ue0000\ue001`")[0].startswith("b")


def test_figures_and_signs_are_content():
    clean = lambda b: markup.clean_text(b)[0]
    assert clean("**Sales**\n\n| Year | Sold |\n|---|---|\n| 2023 | 14 |\n| 2024 | 17 |\n\nThe table ends here.") == "Sales\n\nYear | Sold\n2023 | 14\n2024 | 17\n\nThe table ends here."
    assert clean("Winning numbers of the **week**:\n\n- 42\n- 7\n- ✓\n\nThey are drawn daily.") == "Winning numbers of the week:\n\n- 42\n- 7\n- ✓\n\nThey are drawn daily."
    assert clean("<table>\n<tr>\n<td>3.5</td>\n<td>4.25</td>\n<td>9</td>\n</tr>\n</table>\n<p>The end is here.</p>").split() == ["3.5", "4.25", "9", "The", "end", "is", "here."]
    assert "2021" not in clean("[2020](/a) [2021](/b) [2022](/c)\n\nReal text stands here for the reader.")


def test_rows_rest_on_the_cut(monkeypatch):
    pages = {
        "See [[page]]\n\n# one\n## two\n### three": ["wiki"],
        "If a <b and c> d holds, it is fine.": [],
        "<p>If a <i one> d holds</p>": ["html"],
        "The file C:\\today is old.": [],
        "\\section{A} and \\today": ["latex"],
    }
    assert {p: markup.languages_of(p) for p in pages} == pages
    monkeypatch.setattr(markup, "cut_labels", lambda first, second, links: [a > b for a, b in zip(first, second)])
    assert markup.languages_of("See [[page]]\n\n# one\n## two\n### three") == ["markdown", "wiki"]
    near = "Set <a href='x'>it</a> as <i now> a rule."
    doubtful = [markup.Mark(0, 0, 0, 8.0, 0.0), markup.Mark(5, 0, 0, 1.0, 1.5)]
    assert markup.label_marks(doubtful) == [True, False] and markup.languages_of(near) == ["html"]
    monkeypatch.undo()
    assert markup.label_marks(doubtful) == [True, True]


def test_code_comes_back_as_it_was():
    code = "def f():  \n\n\n\n    return '[a](b)'\n"
    assert markup.clean_text(f"Text **here**.\n\n```python\n{code}```\n\nMore.")[0] == f"Text here.\n\n```python\n{code}```\n\nMore."
    assert markup.clean_text("<p>Text</p><pre>\na  \n\n\n b &lt; c</pre>")[0] == "Text\n\n```\na  \n\n\n b < c\n```"
    own = "An \ue0000\ue001 sign and \ue000 and **bold** `x`"
    assert markup.clean_text(own)[0] == "An \ue0000\ue001 sign and \ue000 and bold x"


def test_costs_are_fitted_to_labelled_blocks():
    assert markup.fit_weights(["<p>only a few words here.</p>"]) == markup.WEIGHTS
    bodies = [f"<nav>\n<a href='/{n}'>Part {n}</a> · <a href='/x'>Up</a> · <a href='/y'>Down</a>\n</nav>\n<main>\nReal text number {n} stands here for its readers.\n</main>" for n in range(80)]
    fitted = markup.fit_weights(bodies)
    assert fitted != markup.WEIGHTS
    bar, prose = "[a](/x) | [b](/y) | [c](/z)", "Real text stands here for the reader."
    assert markup.block_costs(bar, "a | b | c", fitted)[1] > 0 == markup.block_costs(prose, prose, fitted)[1]
    assert markup.clean_text(bar + "\n\n" + prose + " **x**", fitted)[0].startswith("Real text")


def test_minimum_cut():
    assert markup.cut_labels([3, 0, 0], [0, 0, 2], [(0, 1, 1), (1, 2, 0.5)]) == [True, True, False]
    n = 4000
    assert markup.cut_labels([5.0] + [0.0] * (n - 1), [0.0] * (n - 1) + [4.0], [(k, k + 1, 9.0) for k in range(n - 1)]) == [True] * n


def plain_pieces(text, limit, overlap):
    """The cutting rule over whole lists of words and ends."""
    n, sentences, paragraphs, *_ = split.scan(text, "", "")
    sentences = sorted(set(map(int, sentences)) | set(map(int, paragraphs)))
    out, at = [], 0
    while at < n > limit:
        first = max(0, at - overlap)
        end = min(first + limit, n)
        if end < n:
            for ends in (map(int, paragraphs), sentences):
                if fits := [e for e in ends if at < e <= first + limit]:
                    end = fits[-1]
                    break
        out.append((len(out), first, end - first))
        at = end
    longest = lambda ends: max(b - a for a, b in zip([0, *ends], [*ends, n]))
    inner = lambda ends: [int(e) for e in ends if 0 < e < n]
    kind = None if n <= limit else "paragraph" if longest(inner(paragraphs)) <= limit else "sentence" if longest(inner(sentences)) <= limit else "word"
    return kind, out


def test_ranges_give_the_same_pieces(spark, tmp_path):
    rng = random.Random(1)
    parts = ["a", "bb", " ", "\n", "\r\n", "\n \n", ". ", "! ", "é", "\xa0", "。", "yy… "]
    for _ in range(400):
        t = "".join(rng.choices(parts, k=rng.randint(1, 80)))
        limit = rng.randint(1, 9)
        overlap = rng.randint(0, limit - 1)
        for size in (rng.randint(1, 7), rng.randint(8, 40), 1000):
            cutter = split.Cutter(limit, overlap)
            got = [p for _, table in split._ranges(t, size) for p in cutter.feed(*table[:5])]
            kind, rest = cutter.finish()
            assert (kind, got + rest) == plain_pieces(t, limit, overlap)
    text = " ".join(rng.choice(["wort", "größe", "日本語", "…ende.", "x!", "\n\n"]) for _ in range(6000))
    path = tmp_path / "big.txt"
    path.write_text(text)
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "short.txt").write_text("a few words")
    files = split.file_sizes(spark, [str(path), f"file://{path.with_name('short.txt')}", str(path.with_name("empty.txt")), str(path)])
    a, b = ([r["text"] for r in split.split_files(files, range_bytes=n).orderBy("piece").collect()] for n in (3000, 1 << 20))
    df = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "short", 0)], "id long, text string, words int")
    c = split.split_texts(df, "id", "text", range_chars=1999).orderBy("piece").collect()
    assert a == b == [r["text"] for r in c] and max(r["words"] for r in c) <= 192
    words = [w for n, r in enumerate(c) for w in r["text"].split()[16 if n else 0 :]]
    assert words == text.split()
    assert [r["pieces"] for r in split.split_plan(df, "id", "text", overlap=16, range_chars=777).collect()] == [len(c)]
    with pytest.raises(ValueError):
        split.Cutter(4, 4)


def test_pieces_of_a_long_file_take_linear_time(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("Some words stand here, one after the other, and end. " * 160_000)  # 8.5 MB
    found = split.split_files(split.file_sizes(spark, [str(path)]), range_bytes=1 << 18)
    began = time.time()
    assert found.agg(F.sum(F.col("words")) - 16 * (F.count("piece") - 1)).first()[0] == 1_600_000
    assert time.time() - began < 60


def test_boundaries(spark):
    w = lambda n, end=".": " ".join(["w"] * (n - 1) + ["w" + end])
    cases = {1: w(192), 2: w(100) + "\n \t\n" + w(100), 3: w(100) + " " + w(100), 4: w(300), 5: "\u2009".join(["w"] * 200), 6: w(100) + "\r\n\r\n" + w(150) + "\u00a0" + w(100)}
    df = spark.createDataFrame(list(cases.items()) + [(7, None), (None, w(300))], "id long, text string")
    assert {r["id"]: r["boundary"] for r in split.split_plan(df, "id", "text").collect()} == {2: "paragraph", 3: "sentence", 4: "word", 5: "word", 6: "sentence"}
    assert split.split_plan(df.filter(F.lit(False)), "id", "text").count() == 0
