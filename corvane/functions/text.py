"""Text functions as Spark columns. Patterns are written so that Java and RE2 read them alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode white space, as a character class without its brackets.
SPACE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"

#: What is stripped from Markdown, in this order, as (pattern, replacement).
MARKDOWN_STEPS = [
    (r"(?m)^#{1,6}\s+", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?s)```.*?```", ""),
    (r"<[^>]+>", ""),
    (r"(?m)^>\s*", ""),
    (r"(?md)^[-*_]{3,}\s*$", ""),
    (r"\n{3,}", "\n\n"),
]
#: Short codes; the body of a mermaid pair goes too, of other pairs only the tags.
SHORTCODE_STEPS = [
    (r"\{\{<\s*/?\s*rawhtml\s*>\}\}", ""),
    (r'\{\{<\s*ref\s+"[^"]*"\s*>\}\}', ""),
    (r"\{\{<\s*certimage\s+[^>]*>\}\}", ""),
    (r"(?s)\{\{<\s*mermaid\s*>\}\}.*?\{\{<\s*/mermaid\s*>\}\}", ""),
    (r"\{\{<\s*closing\s*>\}\}", ""),
    (r"\{\{<\s*/?[^>]*>\}\}", ""),
]
MDX_STEPS = [(r"(?md)^import\s+.*?;\s*$", ""), (r"(?md)^export\s+.*?;\s*$", ""), (r"\{[^\n{}]*\}", "")]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col(c), F.lit(SPACES))


def one_space(c: Column | str) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(col(c), SPACES, " " * len(SPACES)), " +", " "))


def words(c: Column | str) -> Column:
    """The words of a text: runs without white space."""
    return F.filter(F.split(F.trim(F.translate(col(c), SPACES, " " * len(SPACES))), " +"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    plain = F.trim(F.translate(col(c), SPACES, " " * len(SPACES)))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +")))


def tokens(c: Column | str) -> Column:
    """Search terms: lower-case runs of letters and digits of at least two UTF-8 bytes."""
    return F.filter(F.split(F.lower(col(c)), NOT_WORD), lambda x: F.octet_length(x) >= 2)


def _steps(c: Column | str, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, col(c))


def strip_markdown(c: Column | str) -> Column:
    return strip(_steps(c, MARKDOWN_STEPS))


def strip_shortcodes(c: Column | str) -> Column:
    return _steps(c, SHORTCODE_STEPS)


def strip_mdx(c: Column | str) -> Column:
    return _steps(c, MDX_STEPS)


def is_draft(c: Column | str) -> Column:
    """A line says draft: true or published: false, in front matter or body."""
    return col(c).rlike(r"(?md)^draft\s*[:=]\s*true\s*$") | col(c).rlike(r"(?md)^published\s*[:=]\s*false\s*$")


def sentences(c: Column | str) -> Column:
    """Sentences that keep one closing sign, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(col(c), F.lit(r"([^.!?\n]+[.!?]?)"), 1), strip), lambda s: s != "")


def fact_sentences(c: Column | str) -> Column:
    """Sentences without their closing signs; decimals and host names are split too."""
    return F.filter(F.transform(F.split(col(c), r"[\n.!?]+\s*"), strip), lambda s: s != "")


def token_set(c: Column | str) -> Column:
    """Distinct lower-case words of over two bytes, without signs at their ends."""
    bare = F.transform(words(c), lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, f"^{NOT_WORD}", ""), f"{NOT_WORD}$", "")))
    return F.array_distinct(F.filter(bare, lambda w: F.octet_length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def closed(c: Column | str, also: str = "") -> Column:
    """With a full stop unless the trimmed text ends with . ! ? or one of `also`."""
    t = strip(c)
    return F.when(t.rlike(f"[.!?{also}]$"), t).otherwise(F.concat(t, F.lit(".")))


def snippet(c: Column | str, most: int = 150) -> Column:
    """Up to `most` characters; a longer text is cut back to its last white space and gets an ellipsis."""
    head = F.substring(col(c), 1, most)
    back = F.regexp_extract(head, f"(?s)^(.+)[{SPACE}]", 1)
    cut_back = F.regexp_replace(F.when(back != "", back).otherwise(head), f"[{SPACE}]+$", "")
    return F.when(F.char_length(col(c)) <= most, col(c)).otherwise(F.concat(cut_back, F.lit("…")))


def summary_sentences(c: Column | str, least_bytes: int = 30, most: int = 4) -> Column:
    """The first sentences of some length, joined; null if there is none."""
    picked = F.slice(F.filter(fact_sentences(c), lambda s: F.octet_length(s) >= least_bytes), 1, most)
    return F.when(F.size(picked) > 0, F.array_join(picked, " "))


def is_fact_dense(c: Column | str) -> Column:
    low = F.lower(col(c))
    return low.contains("years") | low.contains("since") | low.contains("worked for") | low.contains("worked at") | low.rlike("[0-9]")


def is_factual_query(c: Column | str, mode: str = "auto") -> Column:
    """Whether a search asks for an answer: a question mark, a question word in front, or five words."""
    if mode != "auto":
        return F.lit(mode == "always")
    t = F.lower(strip(c))
    return t.contains("?") | t.rlike(r"^(?:who|what|when|where|why|how|which|does|do|is|are|can|has|have)\b") | (word_count(t) >= 5)


def activity(c: Column | str) -> Column:
    low = F.lower(strip(c))
    return F.when(low.contains("consult"), "consulting").when(low.contains("program") | low.contains("coding") | low.contains("software"), "programming").when(low.contains("engineer"), "engineering").otherwise("")
