"""Items over a size limit, cut at natural boundaries with an overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import cut, spread

#: Characters (bytes for files) a worker looks at in one go.
RANGE = 1 << 20
#: Unicode white space, line ends among it, and the signs that end a sentence.
SPACES = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
LINE_ENDS = [10, 11, 12, 13, 133, 8232, 8233]
SENTENCE_ENDS = [ord(c) for c in ".!?…"]

_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[SPACES] = True

TABLE = "words int, sentences array<int>, paragraphs array<int>, lead int, tail int"
def scan(text: str, before: str, after: str) -> tuple[int, np.ndarray, np.ndarray, int, int, np.ndarray]:
    """The boundary table of a range: words begun in it; sentence and paragraph ends, as the number of words begun before each;
    line ends before its first and after its last begun word; offsets of the words begun.

    before and after are the neighbouring characters (the halo), empty at the ends of the item.
    """
    if not text:
        none = np.zeros(0, np.int64)
        return 0, none, none, 0, 0, none
    c = np.frombuffer((before[-1:] + text + after[:1]).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _IS_SPACE[np.minimum(c, 0x3001)]
    a, b = len(before[-1:]), len(c) - len(after[:1])
    own, own_space = c[a:b], space[a:b]
    previous = np.concatenate([[True] if not a else space[:1], own_space[:-1]])
    following = np.concatenate([own_space[1:], space[-1:] if b < len(c) else [True]])
    starts = np.flatnonzero(~own_space & previous)
    ends = np.flatnonzero(~own_space & following & np.isin(own, SENTENCE_ENDS))
    lines = np.isin(own, LINE_ENDS)
    lines &= ~((own == 10) & np.concatenate([[bool(a) and c[0] == 13], own[:-1] == 13]))
    gaps = np.searchsorted(starts, np.flatnonzero(lines))  # words begun before each line end
    gap, times = np.unique(gaps, return_counts=True)
    n = len(starts)
    paragraphs = gap[(times >= 2) & (gap > 0) & (gap < n)]
    lead = int(times[gap == 0].sum()) if n else int(lines.sum())
    tail = int(times[gap == n].sum()) if n else 0
    return n, np.unique(np.searchsorted(starts, ends, side="right")), paragraphs, lead, tail, starts


class Cutter:
    """Cuts an item while the boundary tables of its ranges come in, in order; holds no more than the boundaries within reach.

    A piece has at most `limit` words, of which the first `overlap` repeat the end of the piece before. It ends at the last
    paragraph end within reach, else at the last sentence end, else after the last word that fits.
    """

    def __init__(self, limit: int, overlap: int) -> None:
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be from 0 to under limit")
        self.limit, self.overlap = limit, overlap
        self.total = self.gap = self.at = self.piece = 0
        self.ends = {"paragraph": np.zeros(0, np.int64), "sentence": np.zeros(0, np.int64)}
        self.last, self.longest = {"paragraph": 0, "sentence": 0}, {"paragraph": 0, "sentence": 0}

    def feed(self, words: int, sentences: Sequence[int], paragraphs: Sequence[int], lead: int, tail: int) -> list[tuple[int, int, int]]:
        """(piece, first word, words) of the pieces that are settled now that a further range is known."""
        self.gap += lead
        blank = []
        if words:
            if self.gap >= 2 and self.total:
                blank.append(np.array([self.total], np.int64))
            blank.append(np.asarray(paragraphs, np.int64) + self.total)
            self.gap = tail
        blank = np.concatenate([*blank, np.zeros(0, np.int64)])
        self._add("paragraph", blank)
        self._add("sentence", np.union1d(blank, np.asarray(sentences, np.int64) + self.total))
        self.total += words
        return self._cut(False)

    def _add(self, kind: str, ends: np.ndarray) -> None:
        ends = ends[ends > self.last[kind]]
        if len(ends):
            self.longest[kind] = max(self.longest[kind], int(np.diff(ends, prepend=self.last[kind]).max()))
            self.last[kind] = int(ends[-1])
            self.ends[kind] = np.concatenate([self.ends[kind], ends])

    def _cut(self, over: bool) -> list[tuple[int, int, int]]:
        out = []
        while self.at < self.total:
            first = max(0, self.at - self.overlap)
            reach = first + self.limit
            if reach >= self.total:
                if not over:
                    break
                end = self.total
            else:
                end = reach
                for kind in ("paragraph", "sentence"):
                    k = int(np.searchsorted(self.ends[kind], reach, side="right")) - 1
                    if k >= 0 and self.ends[kind][k] > self.at:
                        end = int(self.ends[kind][k])
                        break
            out.append((self.piece, first, end - first))
            self.piece, self.at = self.piece + 1, end
        for kind, ends in self.ends.items():
            self.ends[kind] = ends[np.searchsorted(ends, self.at, side="right") :]
        return out

    def finish(self) -> tuple[str | None, list[tuple[int, int, int]]]:
        """(boundary, remaining pieces): the coarsest boundary at which every part fits; None and no piece for an item within the limit."""
        if self.total <= self.limit:
            return None, []
        longest = {k: max(n, self.total - min(self.last[k], self.total)) for k, n in self.longest.items()}
        boundary = "paragraph" if longest["paragraph"] <= self.limit else "sentence" if longest["sentence"] <= self.limit else "word"
        return boundary, self._cut(True)


def _ranges(text: str, size: int) -> Iterator[tuple]:
    """The boundary tables of a text's ranges, each with the place where its range starts."""
    for a in range(0, len(text), size):
        yield a, scan(text[a : a + size], text[a - 1 : a] if a else "", text[a + size : a + size + 1])


def _oversized(df: DataFrame, id_column: str, text: str, limit: int) -> DataFrame:
    """(id, text, h) of the rows that may be over the limit; rows repeated with id and text once. Only repeated rows are moved."""
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).filter("id is not null").filter(F.length("text") > 2 * limit)
    rows = rows.withColumn("h", F.xxhash64("text"))
    again = cut(rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if not again.isEmpty():
        rows = rows.join(again, ["id", "h"], "left_anti").unionByName(rows.join(again, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]))
    return spread(rows.select("id", "text", "h"))


def split_plan(df: DataFrame, id_column: str, text: str, limit: int = 192, overlap: int = 0, range_chars: int = RANGE) -> DataFrame:
    """(id, text_hash, words, boundary, pieces): how each item over `limit` words is to be cut; items within the limit give no row.

    A word is a run without Unicode white space; boundary is the coarsest of paragraph (between blank lines), sentence (ending at
    . ! ? … before white space, or at a blank line) and word at which every part fits. pieces is the number of pieces.
    Null and blank texts, null ids and short items are no case; rows repeated with the same id and text count once, an id with
    several texts has a row for each. Other columns are ignored. Texts are looked at in ranges of `range_chars` with a halo of
    one character, whose tables are stitched as they come. A narrow operator.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, h in zip(pdf["id"], pdf["text"], pdf["h"]):
                cutter = Cutter(limit, overlap)
                for _, table in _ranges(t, range_chars):
                    cutter.feed(*table[:5])
                boundary, _ = cutter.finish()
                if boundary:
                    out.append((i, h, cutter.total, boundary, cutter.piece))
            yield pd.DataFrame(out, columns=["id", "text_hash", "words", "boundary", "pieces"])

    found = _oversized(df, id_column, text, limit).mapInPandas(plan, f"id {kind}, text_hash bigint, words bigint, boundary string, pieces int")
    return found.withColumnRenamed("id", id_column)


_TRIM = "".join(map(chr, SPACES))


class _Places:
    """Where the words of the last ranges begin."""

    def __init__(self) -> None:
        self.held: list[tuple[int, np.ndarray]] = []
        self.total = 0

    def add(self, starts: np.ndarray) -> None:
        self.held.append((self.total, starts))
        self.total += len(starts)

    def of(self, word: int) -> int | None:
        for base, starts in reversed(self.held):
            if word >= base:
                return int(starts[word - base]) if word < base + len(starts) else None
        raise IndexError(word)

    def forget(self, word: int) -> None:
        """Drops ranges that end before a word."""
        while len(self.held) > 1 and self.held[1][0] <= word:
            self.held.pop(0)


def split_texts(df: DataFrame, id_column: str, text: str, limit: int = 192, overlap: int = 16, range_chars: int = RANGE) -> DataFrame:
    """(id, piece, words, text): the pieces of all items over `limit` words, numbered from 0. See split_plan for the cases.

    Each piece is one slice of its text, by the offsets of its first word and of the word after its last."""
    kind = df.schema[id_column].dataType.simpleString()

    def pieces_of(t: str) -> Iterator[tuple[int, int, str]]:
        cutter, places = Cutter(limit, overlap), _Places()
        waiting: list[tuple[int, int, int]] = []
        for a, table in _ranges(t, range_chars):
            waiting += cutter.feed(*table[:5])
            places.add(table[5] + a)
            yield from emit(t, waiting, places)
            waiting = []
            places.forget(max(0, cutter.at - overlap))
        yield from emit(t, cutter.finish()[1], places)

    def emit(t: str, pieces: list[tuple[int, int, int]], places: _Places) -> Iterator[tuple[int, int, str]]:
        for piece, first, n in pieces:
            yield piece, n, t[places.of(first) : places.of(first + n)].rstrip(_TRIM)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for i, t in zip(pdf["id"], pdf["text"]):
                for piece in pieces_of(t):
                    out.append((i, *piece))
                    size += len(piece[2])
                    if size >= 8 * RANGE:
                        yield pd.DataFrame(out, columns=["id", "piece", "words", "text"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["id", "piece", "words", "text"])

    return _oversized(df, id_column, text, limit).mapInPandas(run, f"id {kind}, piece int, words int, text string").withColumnRenamed("id", id_column)


def _file(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read_range(path: str, start: int, size: int) -> tuple[str, str, str]:
    """(text, the character before, the character after) of the UTF-8 characters whose first byte lies in a range of a file."""
    system, name = _file(path)
    low = max(0, start - 8)
    with system.open_input_file(name) as f:
        whole = f.size()
        data = f.read_at(min(start - low + size + 8, max(0, whole - low)), low) if low < whole else b""

    def begin(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(data))

    a, b = begin(start - low), begin(start - low + size)
    back, ahead = a, begin(b + 1)
    while back > 0:
        back -= 1
        if data[back] & 0xC0 != 0x80:
            break
    text = lambda x, y: data[x:y].decode("utf-8", "replace")
    return text(a, b), text(back, a), text(b, ahead)


def file_sizes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, length) of some files, as split_files takes them."""
    sizes = [(p, system.get_file_info(name).size) for p in paths for system, name in [_file(p)]]
    return spark.createDataFrame(sizes, "path string, length long")


def split_files(files: DataFrame, limit: int = 192, overlap: int = 16, range_bytes: int = RANGE) -> DataFrame:
    """(path, piece, words, text): the pieces of UTF-8 files (path, length) over `limit` words; smaller files give no row, empty ones
    neither. Bytes that aren't UTF-8 read as U+FFFD. A path given twice counts once.

    No worker loads a file whole. Workers find the boundaries in byte ranges with halos; the boundary tables of a file, far
    smaller than its text, pass in order through a cutter that holds only what is within reach; it tells for every range which
    pieces start there, and each range is read once more to emit them by their offsets. The paths must be readable on all
    workers.
    """
    sizes = files.select(F.col("path").alias("key"), F.col("length").cast("long").alias("size")).dropDuplicates(["key"])
    last = F.greatest(F.lit(1), F.ceil(F.col("size") / range_bytes)).cast("int") - 1
    ranges = sizes.withColumn("range", F.explode(F.sequence(F.lit(0), last))).select("key", "range")
    wide = 2 * files.sparkSession.sparkContext.defaultParallelism

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, r in zip(pdf["key"], pdf["range"]):
                yield pd.DataFrame([(path, r, *scan(*_read_range(path, int(r) * range_bytes, range_bytes))[:5])], columns=["key", "range", "words", "sentences", "paragraphs", "lead", "tail"])

    def stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((r.key, r) for pdf in batches for r in pdf.itertuples(index=False))
        for key, own in groupby(rows, lambda x: x[0]):
            cutter, bases, waiting = Cutter(limit, overlap), [], []
            for _, r in own:
                bases.append((r.range, cutter.total))
                waiting += cutter.feed(r.words, r.sentences, r.paragraphs, r.lead, r.tail)
                if waiting:
                    yield from placed(key, waiting, bases)
                    waiting = []
                    low = max(0, cutter.at - overlap)
                    bases = bases[max([k for k, (_, base) in enumerate(bases) if base <= low]) :]
            waiting = cutter.finish()[1]
            if waiting:
                yield from placed(key, waiting, bases)

    def placed(key: str, pieces: list[tuple[int, int, int]], bases: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        """A row for each range in which pieces start, with their numbers, first words in it and lengths."""
        where = np.array([base for _, base in bases])
        numbers, first, words = (np.array(x, np.int64) for x in zip(*pieces))
        at = np.searchsorted(where, first, side="right") - 1
        for k in np.unique(at):
            own = at == k
            yield pd.DataFrame([(key, bases[k][0], numbers[own], first[own] - where[k], words[own])], columns=["key", "range", "pieces", "skips", "words"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, r, pieces, skips, words in zip(pdf["key"], pdf["range"], pdf["pieces"], pdf["skips"], pdf["words"]):
                text, before, after = _read_range(path, int(r) * range_bytes, range_bytes)
                starts, k, last = scan(text, before, after)[5], int(r), int(max(skips[-1] + words[-1], (skips + words).max()))
                while len(starts) <= last:  # a piece goes on in the next range
                    k += 1
                    more, before, after = _read_range(path, k * range_bytes, range_bytes)
                    if not more:
                        break
                    starts = np.concatenate([starts, scan(more, before, after)[5] + len(text)])
                    text += more
                ends = np.append(starts, len(text))
                out = [(path, p, n, text[starts[a] : ends[min(a + n, len(starts))]].rstrip(_TRIM)) for p, a, n in zip(pieces, skips, words)]
                yield pd.DataFrame(out, columns=["path", "piece", "words", "text"])

    found = ranges.repartition(wide, "key", "range").mapInPandas(tables, f"key string, range int, {TABLE}")
    plan = found.repartition("key").sortWithinPartitions("key", "range").mapInPandas(stitched, "key string, range int, pieces array<bigint>, skips array<bigint>, words array<bigint>")
    return plan.repartition(wide, "key", "range").mapInPandas(emit, "path string, piece int, words int, text string")
