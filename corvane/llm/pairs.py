"""Broken prompt and response pairs, by kind of defect."""

from __future__ import annotations

import re as plain_re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

#: Stand-ins for a missing value, as letters and digits.
STAND_INS = set("na none null nil nan nat tbd tba todo fixme xxx undefined unknown missing empty blank noanswer noanswergiven noanswerprovided noresponse nodata notavailable notapplicable novalue placeholder pending tobedetermined tobedone tobedefined aucun aucune aucunereponse sansreponse keine keineantwort keineangabe ninguno ninguna sinrespuesta sindatos".split())
#: Words that may stand around a copied question without answering it.
FILLERS = set("a q answer answers question questions asked ask you your so well ok okay the is re regarding about réponse reponse question vous demandez demandé donc alors antwort frage du fragst gefragt also nun respuesta pregunta preguntas preguntaste entonces pues user assistant prompt response here it".split())
YES_NO = set("yes no oui non ja nein sí si never always jamais toujours nie immer nunca siempre".split())
#: Words that show a language.
FUNCTION_WORDS = {
    "en": set("a an the of and is are was to for in that when with who which what does do how why at by it its not from on your our be has have can will this these there while every each than then only".split()),
    "fr": set("le la les l des du d de et est sont une un que qu qui pour dans par avec sur à il elle ne n pas ce cette chez quand pourquoi comment puis je faut où se s en au aux plus sans mais si on nous vous y expliquez décrivez explique quel quelle quels quelles".split()),
    "de": set("der die das den dem des und ist sind ein eine einen einer nicht wird mit für von zu zum auf wenn wer was wie warum ich kann man sich bis bei im in es am darf muss sollte aus noch nach seit weil wo erkläre erklären beschreibe welche welcher welches".split()),
    "es": set("el la los las de del y es son una un que para por con no se cuando cómo quién qué está están su al más en lo si pero hay debe solo según sin porque también muy después dónde cuál explica describe cuántos cuántas".split()),
    "pt": set("o a os as de da do das dos e é são uma um que para por com não se quando como quem está ao mais em na no nas nos mas também já foi sem muito porque".split()),
    "it": set("il lo la i gli le di della del e è sono una un che per con non si quando come chi dove più in al ma anche nel nella perché questo".split()),
    "nl": set("de het een en van is zijn dat die niet voor met op te wanneer hoe wie waarom bij er om aan ook maar naar nog worden".split()),
    "pl": set("i w na nie się jest są z do że to jak kto kiedy dlaczego przez dla od po za oraz ale może należy każda".split()),
}
#: Pairs of quotation marks and of brackets, and words after which a sentence can't end.
QUOTES = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
HANGING = set("a an the and or but of to in on at by for with from as than that which who whose because if when while into un une le la les des et ou mais de du dans par pour avec sur que qui der die das den dem ein eine und oder aber von zu mit für auf dass weil wenn el los las una y o pero del en para por con sin porque".split())

WORD = re.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*")
VISIBLE = re.compile(r"[^\s\p{Z}\p{C}­͏ᅟᅠ⠀ㅤ]")
INVISIBLE = re.compile(r"[\s\p{Z}\p{C}­͏ᅟᅠ⠀ㅤ]+")

#: What speakers who decline say they can't, won't or mayn't do, by language.
_ACT_EN = r"(?:answer|respond|reply|help|assist|discuss|share|provide|give|offer|comment|tell|say|talk|speak|disclose|reveal|describe|explain|do (?:that|this|so)|comply|guess|be answering|be able|engage|go into|support|fulfil+|complete|process|access|find|determine|confirm|advise)"
_NOT_EN = r"(?:cannot|can ?not|can['’]t|could(?: not|n['’]t)|will not|won['’]t|would(?: not|n['’]t)|may not|must not|should not|shouldn['’]t|(?:am|['’]m|are|['’]re)(?: simply| just| really| currently| afraid)?(?: not (?:able|allowed|permitted|authori[sz]ed|comfortable|going|in a position|willing)|n['’]t able| unable| sorry)(?: to)?)"
REFUSALS = [
    rf"\b(?:I|we)(?: am| ['’]m)? ?(?:really |simply |just |currently |also )?{_NOT_EN} (?:\p{{L}}+ly )?(?:to )?{_ACT_EN}\b",
    r"\b(?:I|we)(?:['’]m| am|['’]re| are)(?: \p{L}+ly)? (?:unable|not able|not allowed|not permitted|not authori[sz]ed|not in a position|not comfortable|not willing|afraid I)\b",
    r"\b(?:I|we) (?:must|have to|need to|will|would|['’]ll|am going to)?(?: \p{L}+ly)? ?(?:decline|refuse|refrain)\b",
    r"\b(?:I|we)(?:['’]d| would) (?:rather|prefer)(?: to)? not\b",
    r"\b(?:I|we) (?:do not|don['’]t) (?:have|possess) (?:(?:any|enough|the|sufficient|direct|real-time) )*(?:access|information|permission|knowledge|data|details)\b",
    r"\b(?:I|we) (?:do not|don['’]t) know (?:the answer|that|this|what|how|who|where|why|when)\b",
    r"\b(?:I['’]m|I am|we['’]re|we are) (?:very |so |really )?sorry,? (?:but )?(?:I|we|this|that)\b",
    r"^(?:sorry|my apologies|apologies|unfortunately|regrettably)\b[^.!?]*\b(?:I|we|me|my)\b",
    r"\b(?:outside|beyond) (?:of )?(?:what|the scope|my|our)\b[^.!?]*\b(?:I|we|can|discuss|scope|abilities)\b",
    r"\bnot something (?:that )?(?:I|we)\b",
    r"\bno (?:answer|response|information) can be (?:given|provided|offered)\b",
    r"\b(?:context|text|passage|document|source|information)s?(?: \p{L}+)? (?:does|do|did) ?(?:not|n['’]t) (?:contain|provide|include|mention|give|have|state|say|allow)\b[^.!?]*\b(?:enough|sufficient|answer|information|respond)\b",
    r"\bnot (?:be )?(?:appropriate|right|possible|proper) for (?:me|us) to\b",
    r"\bas an? (?:AI|artificial|language model|virtual|digital)\b[^.!?]*\b(?:I|my)\b[^.!?]*\b(?:not|unable|cannot|can['’]t|n['’]t)\b",
    r"\bje (?:suis|me vois)(?: vraiment| sincèrement)? (?:désolée?|navrée?|au regret|dans l['’]impossibilité|dans l['’]incapacité|incapable|contrainte?)\b",
    r"\bje (?:ne|n['’]) ?(?:peux|puis|suis|saurais|souhaite|veux|dois|ai|sais|dispose|connais)\b[^.!?]*?\b(?:pas|aucune?)\b[^.!?]*\b(?:répondre|aider|accès|informations?|en mesure|autorisée?|partager|donner|fournir|dire|discuter|parler|commenter|réponse|sais|connais)",
    r"\bje (?:refuse|préfère ne pas|dois (?:refuser|décliner))\b",
    r"\bne (?:permet|permettent|contient|contiennent|fournit|mentionne) (?:pas|aucune?)\b[^.!?]*\b(?:répondre|réponse|informations?)\b",
    r"\b(?:il m['’]est|m['’]est) impossible\b|\bimpossible (?:pour moi )?de (?:vous )?répondre\b",
    r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|möchten|werde|werden|will|habe|haben)\b[^.!?]*\b(?:nicht|keine?n?|leider)\b[^.!?]*\b(?:beantworten|antworten|helfen|Auskunft|sagen|geben|mitteilen|weitergeben|äußern|besprechen|Zugriff|Zugang|Informationen|Angaben|dienen)\b",
    r"\b(?:kann|können|darf|dürfen|möchte|werde) (?:ich|wir)\b[^.!?]*\b(?:nicht|keine?n?)\b[^.!?]*\b(?:beantworten|antworten|helfen|Auskunft|sagen|geben|mitteilen|weitergeben|äußern|besprechen|dienen|unterstützen)\b",
    r"\b(?:ich|wir)\b[^.!?]*\bpassen\b|\b(?:muss|müssen) (?:ich|wir)\b[^.!?]*\b(?:passen|ablehnen)\b|\blehne (?:ich|es)\b[^.!?]*\bab\b",
    r"\b(?:tut|täte) mir (?:sehr )?leid\b|\bich bedau(?:e)?re\b|\bich weiß (?:es|das|die Antwort)[^.!?]*nicht\b",
    r"\b(?:enthält|enthalten|gibt|geben)\b[^.!?]*\bkeine (?:ausreichenden |genügenden )?(?:Angaben|Informationen|Antwort|Auskunft)\b",
    r"\b(?:lo siento|lo lamento|me temo que|disculpa|perdona|lamentablemente|lamento)\b[^.!?]*\b(?:no|pero)\b",
    r"\bno (?:me |te |le |os |les )?(?:puedo|podemos|podré|debo|quiero|dispongo|tengo|estoy|sé|conozco|cuento)\b[^.!?]*\b(?:ayudar\p{L}*|responder\p{L}*|contestar\p{L}*|información|acceso|autorizad[oa]|compartir\p{L}*|dar\p{L}*|decir\p{L}*|hablar\p{L}*|comentar\p{L}*|respuesta|condiciones|permitido)\b",
    r"\bno (?:me|nos) (?:es posible|está permitido|corresponde)\b|\bprefiero no\b|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)\b",
    r"\bno (?:contiene|ofrece|incluye|permite|proporciona|menciona)\b[^.!?]*\b(?:suficiente|información|responder|respuesta)\b",
    r"\bcomo (?:asistente|modelo|inteligencia)\b[^.!?]*\bno\b|\ben tant qu['’](?:assistante?|IA|intelligence|modèle)\b[^.!?]*\b(?:pas|ne)\b|\bals (?:KI|Assistent\p{L}*|Sprachmodell)\b[^.!?]*\b(?:nicht|keine?n?)\b",
]
#: For each of REFUSALS words of which it needs one (of each group), so that most texts need no pattern.
NEEDS = [
    *["i we"] * 6,
    "sorry", "sorry apologies unfortunately regrettably", "outside beyond", "something", "no; answer response information", "context contexts text texts passage passages document documents source sources information informations", "not; me us", "as; i my",
    "je", "je", "je", "ne", "impossible",
    "ich wir", "ich wir", "ich wir lehne", "leid ich", "keine",
    "siento lamento temo disculpa perdona lamentablemente", "no", "no prefiero debo tengo", "no", "como tant als",
]
REFUSAL = [(re.compile(p, re.I), [set(g.split()) for g in need.split(";")]) for p, need in zip(REFUSALS, NEEDS, strict=True)]
CUES: dict[str, list[int]] = {}
for _k, (_, _needs) in enumerate(REFUSAL):
    for _word in _needs[0]:
        CUES.setdefault(_word, []).append(_k)
#: Letters of scripts that set no space between words.
UNBROKEN = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


LETTERS, RUNS, ALNUM = plain_re.compile(r"[^\W\d_]+"), plain_re.compile(r"[^\W_]+"), plain_re.compile(r"[^\W_]")
#: No stand-in has more letters and digits than this.
MOST_STAND_IN = max(map(len, STAND_INS))


def words(text: str) -> list[str]:
    return RUNS.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).casefold())


def is_empty(answer: str | None) -> bool:
    """Null, nothing visible, or only a stand-in for a missing value."""
    if answer is None:
        return True
    if sum(1 for _ in zip(ALNUM.finditer(answer), range(MOST_STAND_IN + 1))) > MOST_STAND_IN:
        return False
    seen = INVISIBLE.sub("", answer)
    core = "".join(c for c in unicodedata.normalize("NFKD", seen).casefold() if c.isalnum())
    return not core or core in STAND_INS


def tiles(question: list[str], answer: list[str], least: int = 2) -> list[bool]:
    """Which words of the answer greedy string tiling covers by runs of `least` or more words of the question.

    The longest common run is marked first, then the next longest among unmarked words. The question's words are
    given free again when no tile is left, so repetitions of the question are covered too.
    """
    covered = [False] * len(answer)
    grown = True
    while grown:
        grown, used = False, [False] * len(question)
        while True:
            best, at_q, at_a = least - 1, -1, -1
            previous = [0] * (len(answer) + 1)
            for i, w in enumerate(question):
                current = [0] * (len(answer) + 1)
                if not used[i]:
                    for j, v in enumerate(answer):
                        if v == w and not covered[j]:
                            current[j + 1] = previous[j] + 1
                            if current[j + 1] > best:
                                best, at_q, at_a = current[j + 1], i, j
                previous = current
            if at_q < 0:
                break
            for k in range(best):
                used[at_q - k] = covered[at_a - k] = True
            grown = True
    return covered


def runs(question: list[str], answer: list[str], least: int = 2) -> list[bool]:
    """As tiles(), from left to right and in linear time: each word starts the longest run of the question that fits there."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(question):
        places.setdefault(w, []).append(i)
    covered, at = [False] * len(answer), 0
    while at < len(answer):
        best = 0
        for i in places.get(answer[at], ()):
            n = 1
            while i + n < len(question) and at + n < len(answer) and question[i + n] == answer[at + n]:
                n += 1
            best = max(best, n)
        if best >= least:
            covered[at : at + best] = [True] * best
        at += max(best, 1)
    return covered


def copies_question(question: str, answer: str) -> bool:
    """The answer repeats the question, whole or nearly, and adds no content of its own.

    A question of one word, or in a script without word breaks, must be repeated whole, letter by letter. An answer much
    longer than the question is covered by runs() and may hold nothing else but fillers.
    """
    q, a = words(question), words(answer)
    if not q or not a:
        return False
    if q == a:
        return True
    if len(q) < 2 or UNBROKEN.search(question):
        one, given = "".join(q), "".join(w for w in a if w not in FILLERS or w in q or w in YES_NO)
        if given and given == one * (len(given) // len(one)):
            return True
    if len(q) < 2:
        return False
    asked = set(q)
    if sum(map(asked.__contains__, a)) < 0.85 * len(q):  # no tiling can cover more
        return False
    long = len(a) > 4 * len(q) + 12
    covered = runs(q, a) if long else tiles(q, a)
    rest = [w for w, c in zip(a, covered) if not c]
    if sum(covered) < 0.85 * len(q) or any(w in YES_NO or w.isdigit() for w in rest if w not in q):
        return False
    return all(w in FILLERS for w in rest) or (not long and len(rest) <= 0.1 * len(a))


class Structure:
    """A pushdown parser over fences, code, list items, brackets, quotations and tags; `open` is the stack at the end of the text.

    A list item is open until something stands in it; a mark alone at the start of a text isn't an item.
    """

    TOKEN = re.compile(r"(?m)^[ \t]*(`{3,}|~{3,})|^[ \t]*(\d+[.)]|[-*+•])[ \t]*$|(`+)|(<(/?)([A-Za-z][\w-]*)[^<>]*?(/?)>)|([(\[{)\]}])|([“”„«»‹›「」])|(\")")
    VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "empty", "null", "none"}

    def __init__(self, text: str) -> None:
        self.open: list[str] = []
        for m in self.TOKEN.finditer(text):
            top = self.open[-1] if self.open else ""
            fence, item, tick, tag, closing, name, single, bracket, quote, plain = m.groups()
            if top[:3] in ("```", "~~~"):
                if fence and fence[0] == top[0] and len(fence) >= len(top):
                    self.open.pop()
            elif top[:1] == "`":
                if tick == top:
                    self.open.pop()
            elif fence:
                self.open.append(fence)
            elif item:
                if m.start() and m.end() == len(text):
                    self.open.append(item)
            elif tick:
                self.open.append(tick)
            elif tag:
                if closing:
                    self._close("<" + name.lower())
                elif not single and name.lower() not in self.VOID:
                    self.open.append("<" + name.lower())
            elif bracket:
                if bracket in BRACKETS:
                    self.open.append(bracket)
                else:
                    self._close(next(k for k, v in BRACKETS.items() if v == bracket))
            elif quote:
                opener = next((k for k in reversed(self.open) if k in QUOTES and quote in QUOTES[k]), None)
                if opener:
                    self._close(opener)
                elif quote in QUOTES:
                    self.open.append(quote)
            elif plain:
                if '"' in self.open:
                    self._close('"')
                elif not text[m.start() - 1 : m.start()].isdecimal():
                    self.open.append('"')

    def _close(self, what: str) -> None:
        if what in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(what) :]


ITEM_MARK = re.compile(r"(?m)^\s*(?:\d+[.)]|[-*+•])\s+")
BREAKS_OFF = re.compile(r"(?:[,:;(\[{“„«–—/&=+]|\p{L}-|…)$")
SENTENCE_END, ADDRESS = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+"), re.compile(r"\S*(?:://|[\\/@]|\.\w)\S*")


def is_truncated(answer: str) -> bool:
    """The answer breaks off: something opened isn't closed, a list item is empty, or the last sentence isn't complete."""
    text = answer.strip() if VISIBLE.search(answer) else ""
    if not text:
        return False
    if Structure(text).open:
        return True
    if BREAKS_OFF.search(text[-2:]) or (text.endswith("...") and len(words(text)) > 1):
        return True
    if not text[-1].isalnum():
        return False
    at = len(text)
    while at and (text[at - 1].isalnum() or text[at - 1] in "'’"):
        at -= 1
    if text[at:].casefold() in HANGING and len(WORD.findall(text)) > 2:
        return True
    # earlier sentences end in a full stop, this one doesn't: it isn't a style without full stops
    prose = ITEM_MARK.sub("", text.splitlines()[-1])
    ended = SENTENCE_END.split(prose)
    return len(ended) > 1 and len(WORD.findall(ended[-2])) > 2 and not ADDRESS.fullmatch(ended[-1])


QUOTED = re.compile(r"`[^`\n]*`|“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"")
SCRIPTS = {name: re.compile(p) for name, p in (("Latin", r"\p{Latin}"), ("Cyrillic", r"\p{Cyrillic}"), ("Greek", r"\p{Greek}"), ("Arabic", r"\p{Arabic}"), ("Hebrew", r"\p{Hebrew}"), ("Han", r"[\p{Han}\p{Hiragana}\p{Katakana}]"), ("Hangul", r"\p{Hangul}"), ("Devanagari", r"\p{Devanagari}"), ("Thai", r"\p{Thai}"))}
OTHER_LETTER = re.compile(r"(?V1)[\p{L}\p{M}--\p{Latin}--\p{Inherited}]")
#: For each function word the languages that have it, as bits in the order of FUNCTION_WORDS.
LANGUAGES_OF = {}
for _bit, _known in enumerate(FUNCTION_WORDS.values()):
    for _word in _known:
        LANGUAGES_OF[_word] = LANGUAGES_OF.get(_word, 0) | 1 << _bit


def _unquoted(text: str) -> str:
    return QUOTED.sub(" ", text)


def _script(text: str) -> str:
    if text.isascii() or not OTHER_LETTER.search(text):
        return "Latin" if sum(1 for _ in zip(SCRIPTS["Latin"].finditer(text), range(3))) == 3 else ""
    counts = {name: len(p.findall(text)) for name, p in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] >= 3 else ""


IN_MASK = {mask: [k for k in range(len(FUNCTION_WORDS)) if mask >> k & 1] for mask in set(LANGUAGES_OF.values())}


def _function_words(found: list[str]) -> tuple[Counter, list[int]]:
    """How many words are function words of which languages (as bits), and of each language."""
    bits, each = Counter(filter(None, map(LANGUAGES_OF.get, found))), [0] * len(FUNCTION_WORDS)
    for mask, n in bits.items():
        for k in IN_MASK[mask]:
            each[k] += n
    return bits, each


def language_scores(text: str) -> dict[str, int]:
    """How many function words of each language a text has."""
    return dict(zip(FUNCTION_WORDS, _function_words(LETTERS.findall(text.casefold()))[1]))


class Said:
    """What an answer says outside quotations, and its words."""

    def __init__(self, answer: str) -> None:
        self.text = _unquoted(answer)
        self.words = LETTERS.findall(self.text.casefold())


def in_other_language(question: str, said: Said) -> bool:
    """The answer, apart from quotations, is written in another script or language than the question."""
    asked, given = _script(question), _script(said.text)
    if asked and given and asked != given:
        return True
    if asked != "Latin" or given != "Latin":
        return False
    q = _function_words(LETTERS.findall(question.casefold()))[1]
    own = q.index(max(q))
    if not q[own] or sorted(q)[-2] >= q[own]:
        return False
    bits, each = _function_words(said.words)
    for other, theirs in enumerate(each):
        if other == own or theirs < max(3, each[own] + 1, 0.12 * len(said.words)):
            continue
        only_theirs = sum(n for mask, n in bits.items() if mask >> other & 1 and not mask >> own & 1)
        only_ours = sum(n for mask, n in bits.items() if mask >> own & 1 and not mask >> other & 1)
        if only_theirs >= 2 and only_theirs > 2 * only_ours:
            return True
    return False


def is_refusal(said: Said) -> bool:
    """The answer, apart from quotations, declines or says that it can't answer."""
    there = set(said.words)
    cues = there & CUES.keys()
    likely = [p for p, needs in (REFUSAL[k] for k in sorted(set().union(*(CUES[w] for w in cues)))) if all(not g.isdisjoint(there) for g in needs)] if cues else []
    if not likely:
        return False
    plain = INVISIBLE.sub(" ", said.text).strip()
    return any(p.search(plain) for p in likely)


def defect_of(question: str | None, answer: str | None) -> str | None:
    """empty, copied_question, refusal, other_language or truncated, whichever holds first; None for a sound pair."""
    if is_empty(answer):
        return "empty"
    question = question or ""
    if copies_question(question, answer):
        return "copied_question"
    said = Said(answer)
    if is_refusal(said):
        return "refusal"
    if in_other_language(question, said):
        return "other_language"
    return "truncated" if is_truncated(answer) else None


def broken_pairs(df: DataFrame, id_column: str = "qa_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(id, defect) of the pairs whose answer doesn't serve the question; sound pairs give no row.

    A null answer is empty; a null or empty question is compared as an empty text, so only empty, refusal and truncated can
    come out. Repeated rows are each reported. Very long texts are parsed whole. Other columns are ignored. A narrow operator.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, d) for i, q, a in zip(pdf["id"], pdf["q"], pdf["a"]) if (d := defect_of(q, a))]
            yield pd.DataFrame(found, columns=["id", "defect"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"))
    return spread(rows).mapInPandas(run, f"id {kind}, defect string").withColumnRenamed("id", id_column)
