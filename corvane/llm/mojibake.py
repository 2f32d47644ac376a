"""Text that was decoded with the wrong character encoding: find and restore it."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

#: Encodings with which text gets decoded by mistake, and those it was meant to have.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-2", "iso8859-15")
MEANT_LEGACY = ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7")
#: Encodings of several bytes: those with which UTF-8 gets read, and those that get read as single bytes.
READ_AS_WIDE, MEANT_WIDE = ("gbk", "shift_jis", "euc_kr", "big5"), ("gbk", "euc_kr", "euc_jp")
MOST_LAYERS = 6
#: A repair must lower the cost by more than this.
LEAST_GAIN = 0.9
LOST = "�"
EXAMPLE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)", re.S)
RUN = re.compile(r"[^\x00-\x7f]+")
#: What the first two bytes of a letter or sign show as when UTF-8 is read as a single-byte encoding of Western Europe; longest part looked for.
#: cost of a letter of a run of which only parts decode, above which it isn't correct text now.
SUSPECT, MOST_PART, MOST_COST = re.compile(r"[Â-ßà-ïð-ô][\x80-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]"), 64, 1.6

#: Letters and signs that are usual in correct text of the languages at hand.
USUAL = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœąćęłńóśźżčšžřěůďťňğışőűÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒĄĆĘŁŃÓŚŹŻČŠŽ" "’‘“”„«»–—…€£§°±®©™•·  ​‍¿¡")
QUOTES = set("’‘“”„«»–—…·•¿¡    　​‍")
CYRILLIC = re.compile(r"[а-яА-ЯёЁ]")
#: How often letters occur in a hundred of Russian and of Greek text.
FREQUENCY = {
    "C": dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (11.0, 8.5, 8.0, 7.4, 6.7, 6.3, 5.5, 4.7, 4.5, 4.4, 3.5, 3.2, 3.0, 2.8, 2.6, 2.0, 1.9, 1.7, 1.7, 1.65, 1.6, 1.4, 1.2, 1.0, 0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.26, 0.04, 0.04))),
    "G": dict(zip("αοιετσνηυρπκμλωδγχθφβξζψς", (12.0, 9.8, 9.4, 8.0, 7.9, 5.0, 7.9, 6.5, 4.3, 4.0, 4.0, 4.1, 3.3, 3.2, 2.0, 1.7, 2.0, 1.4, 1.3, 1.2, 0.8, 0.6, 0.4, 0.2, 4.5))),
}
#: A letter the tables lack counts as this often. The best reading of a text's foreign words must be this much likelier a letter
#: than the next, over so many letters at least, and no less likely than this on average.
RARE, LEAST_LEAD, LEAST_LETTERS, LEAST_LIKELY = 0.01, 0.25, 6, -3.6


def _codec(name: str) -> tuple[dict[str, int], dict[int, str]]:
    """Both directions of a single-byte encoding; bytes it leaves undefined stand for the control characters."""
    there: dict[int, str] = {}
    for b in range(128, 256):
        try:
            there[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            there[b] = chr(b)
    return {c: b for b, c in reversed(there.items())}, there


CODECS = {name: _codec(name) for name in dict.fromkeys(READ_AS + MEANT_LEGACY)}


@lru_cache(maxsize=65536)
def _char_cost(c: str) -> float:
    n = ord(c)
    if c == LOST or 0x80 <= n < 0xA0:
        return 6.0
    if c in USUAL or CYRILLIC.match(c):
        return 1.0
    kind = unicodedata.category(c)
    if 0x3040 <= n <= 0x30FF or 0x4E00 <= n <= 0x9FFF or 0xAC00 <= n <= 0xD7A3 or 0x3000 <= n <= 0x303F or 0xFF00 <= n <= 0xFFEF:
        return 1.0
    if 0x370 <= n <= 0x3FF or 0x590 <= n <= 0x6FF or 0x1E00 <= n <= 0x1EFF or n >= 0x1F000 or kind == "Mn":
        return 1.5
    if 0x2500 <= n <= 0x25FF:
        return 4.0
    if kind in ("Cn", "Co", "Cs", "Cc"):
        return 6.0
    if kind[0] in "SN" or kind == "Cf":
        return 2.0
    if 0x100 <= n <= 0x17F or kind[0] == "P":
        return 2.0
    if 0x400 <= n <= 0x52F:
        return 3.0
    return 4.0


def _script(c: str) -> str:
    n = ord(c)
    if not c.isalpha() or c in "ªº":
        return ""
    if n < 0x250 or 0x1E00 <= n <= 0x1EFF:
        return "L"
    return "C" if 0x400 <= n <= 0x52F else "G" if 0x370 <= n <= 0x3FF else "o"


def garbling_cost(text: str, before: str = "", after: str = "") -> float:
    """How unlike correct text a passage looks: unusual characters, letters joined to signs or to another script, odd capitals.

    before and after are the characters around it; ASCII costs nothing by itself.
    """
    cost = sum(_char_cost(c) for c in text if c > "\x7f")
    whole = before + text + after
    for a, b, c in zip(whole, whole[1:], whole[2:] + " "):
        x, y = _script(a), _script(b)
        if x and y and x != y and not ({x, y} <= {"o"}):
            cost += 2.0
        elif x and y and a.islower() and b.isupper() and (a > "\x7f" or b > "\x7f"):
            cost += 1.5
        elif x and not y and b > "\x7f" and b not in QUOTES and unicodedata.category(b) != "Mn":
            cost += 1.0
        if y == "L" and b > "\x7f" and b.isupper() and not a.isalpha() and not c.isalpha() and c != " ":
            cost += 1.5
    return cost


@lru_cache(maxsize=65536)
def _peel(run: str, before: str, after: str) -> str | None:
    """One layer off a run of non-ASCII characters: the best strictly decoded reading that lowers the cost, or None."""
    best, least = None, garbling_cost(run, before, after) - LEAST_GAIN
    for name in READ_AS:
        back = CODECS[name][0]
        try:
            data = bytes([back[c] for c in run])
        except KeyError:
            continue
        try:
            reading = data.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if (cost := garbling_cost(reading, before, after)) < least:
            best, least = reading, cost
    if any(ord(c) > 0x2E7F for c in run):
        for name in READ_AS_WIDE:
            try:
                reading = run.encode(name).decode("utf-8")
            except UnicodeError:
                continue
            if (cost := garbling_cost(reading, before, after)) < least:
                best, least = reading, cost
    return best


def _foreign(run: str) -> bool:
    """A row of three or more accented Latin letters, which no Latin script has."""
    return len(run) >= 3 and all(_script(c) in ("L", "") for c in run) and sum(c.isalpha() for c in run) >= 3


def _likelihood(reading: str) -> tuple[float, int] | None:
    """(log likelihood, letters) of a word of one alphabet in a usual case, None for anything else."""
    letters = [c for c in reading if c.isalpha()]
    scripts = {_script(c) for c in letters}
    if len(letters) < 3 or len(scripts) != 1 or not scripts <= FREQUENCY.keys() or any(c.isalpha() is False and c not in QUOTES for c in reading):
        return None
    word = "".join(letters)
    if not (word.islower() or word.isupper() or (word[0].isupper() and word[1:].islower())):
        return None
    table = FREQUENCY[scripts.pop()]
    plain = (unicodedata.normalize("NFD", c)[0] if c not in "йёЙЁ" else c for c in word.lower())
    return sum(math.log(table.get(c, RARE) / 100) for c in plain), len(word)


def _alphabet(runs: list[str]) -> tuple[str, str] | None:
    """(read as, meant): the encodings by which a text's foreign words read best, judged over all of them together; None where no
    reading is a clear winner."""
    scored: list[tuple[float, tuple[str, str], tuple[str, ...]]] = []
    times = Counter(runs)
    for name in READ_AS:
        back = CODECS[name][0]
        own = [r for r in times if all(c in back for c in r)]
        if 10 * sum(times[r] for r in own) < 9 * len(runs):
            continue
        for meant in MEANT_LEGACY:
            there = CODECS[meant][1]
            readings = tuple("".join(there[back[c]] for c in r) for r in own)
            known = [(x[0] * times[r], x[1] * times[r], times[r]) for r, new in zip(own, readings) if (x := _likelihood(new))]
            letters = sum(n for _, n, _ in known)
            if 10 * sum(n for _, _, n in known) >= 9 * len(runs) and letters >= LEAST_LETTERS:
                scored.append((sum(x for x, _, _ in known) / letters, (name, meant), readings))
    scored.sort(reverse=True)
    if not scored or scored[0][0] < LEAST_LIKELY:
        return None
    rival = next((x for x, _, readings in scored if readings != scored[0][2]), -math.inf)
    return scored[0][1] if scored[0][0] - rival >= LEAST_LEAD else None


def _wide(runs: list[str]) -> str | None:
    """The East Asian encoding that a text's foreign runs were meant to have, read as Latin-1 or its like; None without a clear winner.

    Each of the three fills its rows differently: Japanese text is rich in kana (rows 36 and 37 of EUC-JP), Korean text is Hangul
    (lead bytes up to 0xC8), and Chinese text uses the common characters of GBK, of which many lie beyond.
    """
    back = CODECS["cp1252"][0]
    data = b"".join(bytes(back[c] for c in r) for r in runs if all(c in back for c in r) and len(r) % 2 == 0)
    lead = data[::2]
    if len(lead) < 6 or any(b < 0xA1 for b in data):
        return None
    share = lambda low, high: sum(low <= b <= high for b in lead) / len(lead)
    kana, hangul, common = share(0xA4, 0xA5), share(0xB0, 0xC8), share(0xB0, 0xD7)
    if kana >= 0.2 and kana + share(0xB0, 0xF4) + share(0xA1, 0xA1) >= 0.95:
        return "euc_jp"
    if hangul >= 0.95 and len(lead) >= 10:
        return "euc_kr"
    return "gbk" if common >= 0.85 and hangul <= 0.85 else None


def _read_wide(run: str, meant: str) -> str | None:
    back = CODECS["cp1252"][0]
    try:
        return bytes(back[c] for c in run).decode(meant) if all(c in back for c in run) else None
    except UnicodeDecodeError:
        return None


def _legacy(text: str) -> tuple[str, bool]:
    """Words of another alphabet that show as rows of accented Latin letters, in their own letters, where the text as a whole
    tells which alphabet it was."""
    runs = [r for r in RUN.findall(text) if _foreign(r)]
    if not runs:
        return text, False
    pair = _alphabet(runs)
    if pair:
        back, there = CODECS[pair[0]][0], CODECS[pair[1]][1]
        read = lambda r: "".join(there[back[c]] for c in r) if all(c in back for c in r) else None
    elif meant := _wide([r for r in RUN.findall(text) if len(r) >= 2]):
        read = lambda r: _read_wide(r, meant)
    else:
        return text, False
    changed = False

    def fix(m: re.Match) -> str:
        nonlocal changed
        new = read(m[0]) if (_foreign(m[0]) if pair else len(m[0]) >= 2) else None
        if new is None or (pair and _likelihood(new) is None):
            return m[0]
        changed = True
        return new

    return RUN.sub(fix, text), changed


def _maximal(run: str, before: str, after: str) -> str | None:
    """A run of which only parts decode: its longest garbled parts from left to right, the rest as it is."""
    out, at, changed = [], 0, False
    while at < len(run):
        best = None
        for end in range(min(len(run), at + MOST_PART), at + 1, -1):
            best = _peel(run[at:end], run[at - 1 : at] or before, run[end : end + 1] or after)
            if best is not None:
                break
        if best is None:
            out.append(run[at])
            at += 1
        else:
            out.append(best)
            at, changed = end, True
    new = "".join(out)
    return new if changed and garbling_cost(new, before, after) <= MOST_COST * len(new) else None


def _each_run(text: str, read) -> tuple[str, bool]:
    changed = False

    def fix(m: re.Match) -> str:
        nonlocal changed
        run, before, after = m[0], text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        got = read(run, before, after) if len(run) > 1 else None
        changed |= got is not None
        return run if got is None else got

    return RUN.sub(fix, text), changed


def _once(text: str) -> tuple[str, bool]:
    """One layer off: whole runs first; where none decodes, another alphabet; then parts of runs, as a garbled part may touch
    correct letters and signs."""
    out, changed = _each_run(text, _peel)
    if not changed:
        out, changed = _legacy(text)
    if not changed and SUSPECT.search(text):
        out, changed = _each_run(text, lambda run, before, after: _maximal(run, before, after) if SUSPECT.search(run) else None)
    return out, changed


def repair(text: str) -> tuple[str, int]:
    """(the text restored where possible, the number of layers taken off). Passages in backticks stay as they are."""
    keep = [m.span() for m in EXAMPLE.finditer(text)]
    parts, at = [], 0
    for a, b in keep + [(len(text), len(text))]:
        parts.append((text[at:a], text[a:b]))
        at = b
    out, layers = [], 0
    for part, example in parts:
        for n in range(MOST_LAYERS):
            part, changed = _once(part)
            if not changed:
                break
            layers = max(layers, n + 1)
        out += [part, example]
    return "".join(out), layers


def repair_texts(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, recovery, layers, text) of the garbled rows only: the repaired text and the number of layers taken off.

    Each run of non-ASCII characters is re-encoded under candidate legacy encodings and decoded strictly as the intended one;
    a reading is accepted when the garbling cost drops, and the same is done again for nested layers. Text of another alphabet
    or of East Asian encodings, read as single bytes, is read back where the text as a whole has one clear winner among the
    encodings, and left alone elsewhere. recovery is "lossy"
    where the text shows U+FFFD, whose characters can't be restored (layers may then be 0), else "full".
    Null, empty and ASCII texts, correct text of any language and passages in backticks are no case. Repeated rows are each
    reported. Other columns are ignored. A narrow operator: no shuffle beyond spreading a table of too few splits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                fixed, layers = repair(t)
                lost = LOST in t and LOST in EXAMPLE.sub("", t)
                if layers or lost:
                    rows.append((i, "lossy" if lost else "full", layers, fixed))
            yield pd.DataFrame(rows, columns=["id", "recovery", "layers", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7f]{2}|\x{fffd}"))
    return spread(rows).mapInPandas(run, f"id {kind}, recovery string, layers int, text string").withColumnRenamed("id", id_column)
