"""Claims and question–answer pairs drawn from chunks by pattern."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import spread

SUBJECT, SUBJECT_IN_QUESTIONS = "Subject", "the subject"

#: Fixed values of the extraction: cues, lead-ins, rejected phrases, patterns and confidences.
SKILL_CONTEXT = ("skill", "technology", "tool", "framework", "language", "machine learning", "/skills/")
SKILL_HINTS = ("skills:", "technologies:", "tools:", "frameworks:", "languages:", "experience with", "familiar with", "proficient in", "knowledge of")
ORG_LEAD_INS = ("or with:", "with:", "for:", "or with", "with ", "for ", "or ", "and ", "such as ", "companies like ", "company like ", "clients like ", "banks like ", "healthcare like ", "organizations like ", "orgs like ")
ORG_REJECTED = ("they had", "needed ", "behavior ", "services", " not ", "events ", "head of ")
SKILL_REJECTED = ("http://", "https://", " years", "age ", "worked ", "consult")
SKILL_REJECTED_STARTS = ("i have ", "i've ")
WHO = r"\b(?:i|we|he|she|they|[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)\b"
DOING = r"programming|coding|consulting|engineering|building software"
ORG = r"[A-Z][A-Za-z0-9&/.+,' -]{1,100}"
LINE_START = r"^\s*(?:[-*]\s*)?(?:\d+\.\s*)?(?:#+\s*)?"


def activity_of(raw: str) -> str:
    low = raw.strip().lower()
    for name, cues in (("consulting", ("consult",)), ("programming", ("program", "coding", "software")), ("engineering", ("engineer",))):
        if any(c in low for c in cues):
            return name
    return ""


def fact_sentences(text: str) -> list[str]:
    return [s for p in re.split(r"[\n.!?]+\s*", text) if (s := p.strip())]


def closed(text: str) -> str:
    t = text.strip()
    return t if t.endswith((".", "!", "?")) else t + "."


def organisation(raw: str) -> str | None:
    """A candidate without lead-ins, label and parenthesis, or None if it doesn't look like a name."""
    s = raw.strip().strip(".;:-*").strip()
    for lead in ORG_LEAD_INS:
        if s.lower().startswith(lead):
            s = s[len(lead) :].strip()
    label, colon, rest = s.partition(":")
    if colon and len(label.encode()) < 24:
        s = rest.strip()
    s = s.split(" (", 1)[0].strip().strip(".;,()").strip()
    parts = s.split()
    sound = s and s.lower() not in ("etc", "and more") and len(parts) <= 8 and re.match(r"[A-Z0-9]", s) and sum(bool(re.match(r"[a-z]", p)) for p in parts) <= 1
    return s if sound and not any(x in s.lower() for x in ORG_REJECTED) else None


def skill(raw: str) -> str | None:
    """A candidate without link, backticks and signs around it, or None if it doesn't look like a skill."""
    s = raw.strip()
    if (m := re.fullmatch(r"\[(.*?)\]\(.*\)", s, re.S)) and m[1].strip():
        s = m[1].strip()
    s = s.replace("`", "").strip().strip(".;:-*()\"'").strip()
    low = s.lower()
    if not s or len(s.encode()) > 48 or len(s.split()) > 6 or not re.search("[A-Za-z]", s):
        return None
    return None if low.startswith(SKILL_REJECTED_STARTS) or any(x in low for x in SKILL_REJECTED) else " ".join(s.split())


def _listed(cleaner: Callable[[str], str | None], also: str) -> Callable[[str], list[str]]:
    return lambda raw: [x for p in raw.replace(" and ", ",").replace(also, ",").split(",") if (x := cleaner(p))]


def _one(cleaner: Callable[[str], str | None]) -> Callable[[str], list[str]]:
    return lambda raw: [x] if (x := cleaner(raw)) else []


@dataclass(frozen=True)
class Rule:
    """One pattern: where it is looked for, what becomes of its match and how sure the claim is.

    scope is "sentence" or "text"; evidence is the sentence, the whole match ("match") or the captured part ("part").
    """

    predicate: str
    pattern: str
    scope: str
    objects: Callable[[str], list[str]]
    evidence: str
    confidence: float
    tags: tuple[str, ...]
    flags: int = re.I


RULES = [
    [Rule("years_{}", rf"\b(?:i|he|she|they|[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)\s+has\s+been\s+({DOING})\s+for\s+(\d{{1,2}}\+?\s*years?)", "sentence", _one(str.strip), "sentence", 0.85, ("experience",)), Rule("since_age_{}", rf"\b({DOING})\b[^.\n]{{0,80}}?\bsince age\s+(\d{{1,2}})", "sentence", _one(str.strip), "sentence", 0.8, ("experience",))],
    [Rule("worked_for", rf"{WHO}[^.\n]{{0,80}}\bworked\s+(?:for|at)\s+([^.\n]{{3,260}})", "sentence", _listed(organisation, " & "), "sentence", 0.86, ("work-history",)), Rule("worked_for", rf"{WHO}[^.\n]{{0,80}}\bworked\s+for\s+or\s+with[:\s]+([^.\n]{{3,260}})", "sentence", _listed(organisation, " & "), "sentence", 0.86, ("work-history",))],
    [Rule("worked_for", rf"{LINE_START}(?:[A-Za-z][A-Za-z0-9,&/.+:' -]{{1,90}})\s+at\s+({ORG})\s*(?:\(|$)", "text", _one(organisation), "match", 0.88, ("work-history", "role-line"), re.I | re.M)],
    [Rule("worked_for", rf"{LINE_START}({ORG})\s*\((?:consulting|contract|freelance|advisor|advisory|part[- ]time)[^)]*\)\s*$", "text", _one(organisation), "match", 0.85, ("work-history", "role-line"), re.I | re.M)],
    [Rule("worked_for", r"^\s*\d+\.\s+([A-Z][A-Za-z0-9&/.+,' ]{1,100}?)\s+-\s+", "text", _one(organisation), "match", 0.83, ("work-history", "numbered-list"), re.I | re.M)],
    [Rule("has_skill", r"^\s*[-*]\s+([^\n]{1,100})\s*$", "text", _one(skill), "part", 0.8, ("skills", "bullet-list"), re.M)],
    [Rule("has_skill", r"\b(?:skills?|technologies|tools|frameworks?|languages?)\s*[:\-]\s*([^\n]{3,260})", "text", _listed(skill, " / "), "part", 0.78, ("skills", "labeled-list"), re.I | re.M)],
    [Rule("has_skill", r"\b(?:experience with|familiar with|proficient in|knowledge of)\s+([^\n.;]{3,220})", "text", _listed(skill, " / "), "part", 0.74, ("skills", "experience-phrase"), re.I | re.M)],
]


COMPILED = {(r.pattern, r.flags): re.compile(r.pattern, r.flags) for group in RULES for r in group}


def claims_of(text: str, title: str = "", section: str | None = "", url: str = "", wanted: Callable[[str], bool] = lambda predicate: True) -> list[tuple[str, str, str, list[str], float]]:
    """(predicate, object, evidence, tags, confidence) of a chunk, in the order of the rules. Only rules of wanted predicates run."""
    about = f"{title or ''} {section or ''} {url or ''}".lower()
    skills_here = any(c in about for c in SKILL_CONTEXT) or any(h in text.lower() for h in SKILL_HINTS)
    out, seen = [], set()
    for group in RULES:
        for scope in fact_sentences(text) if group[0].scope == "sentence" else [text]:
            for rule in group:
                if not wanted(rule.predicate) or (rule.predicate == "has_skill" and not skills_here):
                    continue
                for m in COMPILED[rule.pattern, rule.flags].finditer(scope):
                    act = activity_of(m[1]) if "{}" in rule.predicate else ""
                    for found in rule.objects(m[2] if act else m[1]):
                        if rule.predicate == "has_skill":
                            if found.lower() in seen:
                                continue
                            seen.add(found.lower())
                        shown = {"sentence": scope, "match": m[0], "part": m[1]}[rule.evidence]
                        out.append((rule.predicate.format(act), found, closed(shown), [*rule.tags, act] if act else list(rule.tags), rule.confidence))
    return out


#: Patterns of the question–answer pairs.
QA_DOING = re.compile(r"\b(programming|coding|software engineering|engineering|consulting|developer relations|building software)\b[^.\n]{0,120}", re.I)
DURATION = re.compile(r"\b\d{1,2}\+?\s*years?\b|\bsince age\s+\d{1,2}\b|\bsince\s+(?:19\d{2}|20\d{2})\b", re.I)
HAS_BEEN = re.compile(r"\b(?:i|he|she|they|the subject|[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)\s+has\s+been\s+([a-z][a-z\s\-]{2,40})\s+for\s+([^\n.,;]{2,50})", re.I)
WORKED = re.compile(r"\bworked\s+(?:for|at|with)\s+([^.\n]{8,240})", re.I)


def pairs_of(text: str, title: str = "", section: str | None = "", url: str = "") -> list[tuple[str, str, list[str], float]]:
    """(question, answer, tags, confidence) of a chunk: from its sentences, its work history, then its claims."""
    who, out = SUBJECT_IN_QUESTIONS, []
    for s in fact_sentences(text):
        for m in QA_DOING.finditer(s):
            if (act := activity_of(m[1])) and DURATION.search(s):
                for question, sure in ((f"How many years has {who} been {act}?", 0.75), (f"How long has {who} been {act}?", 0.75), (f"Does {who} {act} very well?", 0.65)):
                    out.append((question, closed(s), ["experience", act], sure))
        for m in HAS_BEEN.finditer(s):
            if (act := m[1].strip().lower()) and (span := m[2].strip()):
                for question in (f"Does {who} {act} very well?", f"How long has {who} been {act}?"):
                    out.append((question, f"{who} has been {act} for {span}.", ["experience", act], 0.8))
    for m in WORKED.finditer(text):
        if orgs := m[1].strip().strip(",").strip():
            out.append((f"Who has {who} worked for?", f"{who} has worked for {orgs}.", ["work-history"], 0.8))
    employers: dict[str, None] = {}
    skills: dict[str, None] = {}
    for predicate, found, *_ in claims_of(text, title, section, url):
        if predicate == "worked_for":
            employers.setdefault(found)
        elif predicate == "has_skill":
            if found not in skills:
                out.append((f"Does {who} know {found}?", f"{who} has skill in {found}.", ["claim-backed", "skills"], 0.8))
            skills.setdefault(found)
        elif predicate.startswith("years_"):
            act = predicate.removeprefix("years_")
            out.append((f"How many years has {who} been {act}?", f"{who} has been {act} for {found}.", ["claim-backed", "experience"], 0.82))
        else:
            act = predicate.removeprefix("since_age_")
            out.append((f"Since what age has {who} been {act}?", f"{who} has been {act} since age {found}.", ["claim-backed", "experience"], 0.8))
    if employers:
        out.append((f"Who has {who} worked for?", f"{who} has worked for {', '.join(employers)}.", ["claim-backed", "work-history"], 0.86))
    if skills:
        out.append((f"What skills does {who} have?", f"{who} has skills in {', '.join(skills)}.", ["claim-backed", "skills"], 0.82))
    return out


def _each_chunk(chunks: DataFrame, of: Callable, columns: str, id_column: str) -> DataFrame:
    """One row per finding of each chunk with its place; null texts give none. Chunks are (id, text, title, section, url)."""
    kind = chunks.schema[id_column].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, *f, t, u, s) for i, x, t, s, u in zip(pdf["id"], pdf["text"], pdf["title"], pdf["section"], pdf["url"]) for n, f in enumerate(of(x, t, s, u))]
            yield pd.DataFrame(rows, columns=["id", "place", *names, "source_title", "source_url", "source_section"])

    rows = spread(chunks.select(F.col(id_column).alias("id"), "text", "title", "section", "url").filter("text is not null"))
    return rows.mapInPandas(run, f"id {kind}, place int, {columns}, source_title string, source_url string, source_section string").withColumnRenamed("id", id_column)


def extract_claims(chunks: DataFrame, id_column: str = "chunk_id", predicates: Sequence[str] | None = None) -> DataFrame:
    """(id, place, subject, predicate, object, evidence, tags, confidence, source_…) of chunks (id, text, title, section, url).

    predicates names the rules to run ("worked_for", "has_skill", "years_{}", "since_age_{}"), all by default."""
    of = claims_of if predicates is None else functools.partial(claims_of, wanted=set(predicates).__contains__)
    return _each_chunk(chunks, of, "predicate string, object string, evidence string, tags array<string>, confidence float", id_column).withColumn("subject", F.lit(SUBJECT))


def extract_pairs(chunks: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """(id, place, question, answer, tags, confidence, source_…) of chunks (id, text, title, section, url)."""
    return _each_chunk(chunks, pairs_of, "question string, answer string, tags array<string>, confidence float", id_column)


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row in order of each group of equal keys. A partial aggregate, so popular keys don't pile up."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[k.alias(f"_k{n}") for n, k in enumerate(keys)]).agg(first.alias("_r")).select("_r.*")


def _same(c: str) -> Column:
    return F.lower(T.strip(F.coalesce(c, F.lit(""))))


def dedup_claims(claims: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(claims, [_same(c) for c in ("subject", "predicate", "object", "source_url")], order)


def dedup_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(pairs, [_same(c) for c in ("question", "answer")], order)


def redact(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """claims without those a rule matches: all fields a rule gives must agree (trimmed, without case), `contains` must occur
    in the claim's text. A rule that gives nothing matches nothing. Rules are an editor's file, far below a broadcast's bound."""
    if rules.limit(100_001).count() > 100_000:
        raise ValueError("too many redaction rules for one pass")
    r = rules.select(*[F.col(c).alias(f"_r_{c}") for c in ("subject", "predicate", "object", "source_url", "contains")])
    whole = F.lower(F.concat_ws(" ", "subject", "predicate", "object", "evidence"))
    match = F.coalesce(*[F.col(f"_r_{c}") for c in ("subject", "predicate", "object", "source_url", "contains")]).isNotNull()
    for c in ("subject", "predicate", "object", "source_url"):
        match = match & (F.col(f"_r_{c}").isNull() | (F.lower(T.strip(f"_r_{c}")) == _same(c)))
    match = match & (F.col("_r_contains").isNull() | F.contains(whole, F.lower(T.strip("_r_contains"))))
    return claims.join(F.broadcast(r), match, "left_anti")


def apply_edits(claims: DataFrame, rules: DataFrame, adds: DataFrame, order: list[str]) -> DataFrame:
    """Redacted claims plus the added ones, with defaults for what an addition leaves out, then without repetitions.

    claims carry a numeric first order column; additions follow all others.
    """
    cols = ["subject", "predicate", "object", "evidence", "source_title", "source_url", "source_section", "tags", "confidence"]
    kept = redact(claims, rules).select(*order, *cols)
    given = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    evidence = F.coalesce("evidence", T.closed(F.concat_ws(" ", "subject", F.translate("predicate", "_", " "), "object")))
    extra = adds.select(
        *[F.lit(2**31 - 1).cast(claims.schema[o].dataType).alias(o) for o in order],
        "subject", "predicate", "object", evidence.alias("evidence"), given("source_title", "Manual"), given("source_url", "/manual/"), "source_section",
        F.coalesce("tags", F.array(F.lit("manual"))).alias("tags"), F.coalesce("confidence", F.lit(1.0)).cast("float").alias("confidence"),
    )
    return dedup_claims(kept.unionByName(extra), order)


def parse_generated_pairs(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, question, answer, tags, confidence) from a model's reply, which must be one JSON object with a list `qa`; any other
    reply and blank pairs give no row."""
    shape = "struct<qa:array<struct<question:string,answer:string,tags:array<string>,confidence:float>>>"
    rows = df.select(id_column, F.explode(F.from_json(text, shape)["qa"]).alias("_e")).select(id_column, T.strip("_e.question").alias("question"), T.strip("_e.answer").alias("answer"), F.coalesce("_e.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("_e.confidence", F.lit(0.6)).cast("float").alias("confidence"))
    return rows.filter("question <> '' and answer <> ''")


def generate_pairs(chunks: DataFrame, client: Callable[[str], str], most: int = 48, id_column: str = "chunk_id") -> DataFrame:
    """Pairs written by a language model for the first `most` fact-dense chunks; client(text) returns the model's reply."""
    first = chunks.filter(T.is_fact_dense("text")).orderBy(id_column).limit(most)
    kind = chunks.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "reply": [client(t) for t in pdf["text"]]})

    replies = first.select(F.col(id_column).alias("id"), "text").mapInPandas(run, f"id {kind}, reply string")
    return parse_generated_pairs(replies, "id", "reply").withColumnRenamed("id", id_column)


def corpus_json(df: DataFrame, name: str) -> DataFrame:
    """Lines of JSON: a header with the version, then one entry per line."""
    head = df.sparkSession.createDataFrame([(json.dumps({"version": 1, "kind": name}),)], "value string")
    return head.unionByName(df.select(F.to_json(F.struct(*df.columns)).alias("value")))


def in_order(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
