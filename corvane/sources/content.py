"""Content folders of static sites: files in, documents out."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import urls as U


@dataclass(frozen=True)
class Profile:
    """How a content system writes its files."""

    index_names: tuple[str, ...]
    extensions: tuple[str, ...] = ("md", "markdown")
    toml: bool = False
    override: str | None = None
    shortcodes: bool = False
    mdx_noise: bool = False
    dated_posts: bool = False


README = ("index.md", "README.md", "readme.md")
PROFILES = {
    "hugo": Profile(("_index.md", "index.md"), toml=True, shortcodes=True),
    "astro": Profile(("index.md", "index.mdx"), ("md", "markdown", "mdx"), mdx_noise=True),
    "docusaurus": Profile(("index.md", "index.mdx"), ("md", "markdown", "mdx"), override="slug"),
    "eleventy": Profile(README, override="permalink"),
    "jekyll": Profile(README, override="permalink", dated_posts=True),
    "mkdocs": Profile(README),
}


def yaml_value(front: Column | str, key: str) -> Column:
    """The first line `key: value`, double quotes optional; null if there is none. Block lists give their first line."""
    line = r"(?md)^" + key + r'\s*:\s*"?([^"\n]+)"?\s*$'
    return F.when(T.col(front).rlike(line), T.strip(F.regexp_extract(front, line, 1)))


def yaml_list(front: Column | str, key: str) -> Column:
    """An inline list [a, "b"] without quotes and empty entries; any other value as the only entry."""
    raw = yaml_value(front, key)
    bare = lambda v: F.regexp_replace(F.regexp_replace(T.strip(v), '^"+|"+$', ""), "^'+|'+$", "")
    inline = F.filter(F.transform(F.split(F.regexp_replace(raw, r"^\[|\]$", ""), ","), bare), lambda v: v != "")
    return F.when(raw.rlike(r"(?s)^\[.*\]$"), inline).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, source_path, length) of all files under root with one of the extensions, whatever their case.

    Spark's own readers skip names that begin with an underscore, which content systems use for index files and posts, so the
    names (not the contents) are listed by the driver.
    """
    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.extension.lower() in extensions]
    cut_off = len(base.rstrip("/")) + 1
    rows = sorted((f.path, f.path[cut_off:], f.size) for f in found)
    return spark.createDataFrame(rows, "path string, source_path string, length long")


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "markdown")) -> DataFrame:
    """(source_path, content) of the files of list_files; text that isn't UTF-8 is null. Files are read by the workers."""
    files = list_files(spark, root, extensions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for pdf in batches:
            texts = []
            for path in pdf["path"]:
                with store.open_input_stream(path) as f:
                    try:
                        texts.append(f.read().decode("utf-8"))
                    except UnicodeDecodeError:
                        texts.append(None)
            yield pd.DataFrame({"source_path": pdf["source_path"], "content": texts})

    return files.repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(run, "source_path string, content string")


def _toml_fields(fronts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Fields of TOML front matter; anything but strings (and lists of strings for tags) reads as absent."""
    for batch in fronts:
        rows = []
        for front in batch:
            try:
                table, error = tomllib.loads(front or ""), None
            except tomllib.TOMLDecodeError as e:
                table, error = {}, str(e)
            text = lambda k: v if isinstance(v := table.get(k), str) else None  # noqa: B023, E731
            tags = [t for t in table.get("tags", []) if isinstance(t, str)] if isinstance(table.get("tags"), list) else []
            rows.append((text("title"), text("description"), tags, text("date"), error))
        yield pd.DataFrame(rows, columns=["title", "description", "tags", "date", "error"])


def parse_files(files: DataFrame, cms: str = "hugo") -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of (source_path, content).

    documents: source_path, title, url, description, tags, date, body; drafts and blank bodies are left out. Files whose front
    matter isn't closed or isn't readable go to errors (source_path, error) instead of ending the run.
    """
    p = PROFILES[cms]
    yaml, toml = F.substring("content", 1, 3) == "---", F.lit(p.toml) & (F.substring("content", 1, 3) == "+++")
    fence = F.when(yaml, F.lit("---")).when(toml, F.lit("+++"))
    unread = files.filter("content is null").select("source_path", F.lit("not UTF-8").alias("error"))
    rows = files.filter(F.col("content").isNotNull() & ~T.is_draft("content")).withColumn("_fence", fence)
    closing = F.expr("locate(concat('\n', _fence), content, 4)")
    rows = rows.withColumn("_end", F.when(F.col("_fence").isNotNull(), closing))
    rows = rows.withColumn("_front", F.when(F.col("_end") > 0, F.expr("substring(content, 4, _end - 4)")))
    rows = rows.withColumn("_body", F.when(F.col("_fence").isNull(), F.col("content")).when(F.col("_end") > 0, F.expr("substring(content, _end + 4)")))
    front = F.when(yaml, F.col("_front"))
    fields = {"title": yaml_value(front, "title"), "description": yaml_value(front, "description"), "date": yaml_value(front, "date"), "tags": yaml_list(front, "tags")}
    rows = rows.withColumn("_error", F.when(F.col("_end") == 0, F.concat(F.lit("no closing "), F.col("_fence"))))
    if p.toml:
        parsed = F.pandas_udf(_toml_fields_typed(), "title string, description string, tags array<string>, date string, error string")
        rows = rows.withColumn("_toml", F.when(toml & (F.col("_end") > 0), parsed(F.when(toml, F.col("_front")))))
        fields = {k: F.when(toml, F.col(f"_toml.{k}")).otherwise(v) for k, v in fields.items()}
        rows = rows.withColumn("_error", F.coalesce("_error", "_toml.error"))
    missing = F.when(F.col("_fence").isNotNull(), F.lit("")).otherwise(U.file_title("source_path")) if cms == "hugo" else U.file_title("source_path")
    url = (U.dated_url if p.dated_posts else U.page_url)("source_path", list(p.index_names))
    if p.override:
        given = yaml_value(front, p.override)
        url = F.when(given.isNotNull(), U.closed_path(given)).otherwise(url)
    body = F.col("_body")
    if p.shortcodes:
        body = T.strip_shortcodes(body)
    if p.mdx_noise:
        body = T.strip_mdx(body)
    errors = rows.filter("_error is not null").select("source_path", F.col("_error").alias("error")).unionByName(unread)
    docs = rows.filter("_error is null").select("source_path", F.coalesce(fields["title"], missing).alias("title"), url.alias("url"), fields["description"].alias("description"), F.coalesce(fields["tags"], F.array().cast("array<string>")).alias("tags"), fields["date"].alias("date"), T.strip_markdown(body).alias("body"))
    return docs.filter(T.strip("body") != ""), errors


def _toml_fields_typed():
    def run(fronts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _toml_fields(fronts)

    run.__annotations__ = {"fronts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def content_stats(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "markdown", "mdx", "txt", "rst", "html")) -> DataFrame:
    """One row (files, bytes) of the text files under a folder; the files' contents aren't read."""
    return list_files(spark, root, extensions).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def even_sample(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """`count` rows at even steps of the given order: those at floor(i * rows / count)."""
    from corvane.operators.chunking import number_rows

    numbered = number_rows(df, order, "_n")
    total = numbered.count()
    if total <= count:
        return numbered.drop("_n")
    step = total / count
    return numbered.filter(F.floor(F.ceil(F.col("_n") / step) * step) == F.col("_n")).filter(F.ceil(F.col("_n") / step) < count).drop("_n")


def corpus_excerpt(df: DataFrame, files: int = 40, chars: int = 1200) -> str:
    """The starts of evenly sampled texts (source_path, body), white space collapsed: a prompt of bounded size."""
    rows = even_sample(df.filter(F.trim("body") != ""), ["source_path"], files)
    start = F.trim(F.regexp_replace(F.substring(F.trim("body"), 1, chars), r"\s+", " "))
    return "\n\n".join(f"{r['source_path']}:\n{r['t']}" for r in rows.select("source_path", start.alias("t")).orderBy("source_path").collect())


#: Where each content system keeps a page: the folder, and the key under which an address of its own stands.
LAYOUT = {"hugo": "posts/", "astro": "", "docusaurus": "docs/", "eleventy": "", "jekyll": "_posts/", "mkdocs": ""}


def render_site(pages: DataFrame, cms: str) -> DataFrame:
    """(path, content): pages (slug, title, description, date, tags, body) as the files of a content system, for fixtures.

    Front matter is TOML for Hugo, else YAML; dated posts carry their date in the name. Double quotes and line ends in fields
    become single quotes and spaces; null fields are left out, null bodies are empty.
    """
    profile = PROFILES[cms]
    plain = lambda c: F.translate(F.col(c), '"\n\r\\\\', "'  /")
    equals = " = " if profile.toml else ": "
    field = lambda key, c: F.concat(F.lit(f'{key}{equals}"'), plain(c), F.lit('"\n'))
    quote = '"' if profile.toml else "'"
    tags = F.concat(F.lit(f"tags{equals}["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit(quote), F.translate(t, '"\'\n', "   "), F.lit(quote))), ", "), F.lit("]\n"))
    parts = [field(k, k) for k in ("title", "description", "date")] + [F.when(F.size("tags") > 0, tags)]
    if profile.override:
        parts.append(F.concat(F.lit(f'{profile.override}: "/'), F.col("slug"), F.lit('/"\n')))
    fence = "+++" if profile.toml else "---"
    front = F.concat(F.lit(fence + "\n"), *[F.coalesce(x, F.lit("")) for x in parts], F.lit(fence + "\n\n"))
    name = F.concat(F.substring("date", 1, 10), F.lit("-"), "slug") if profile.dated_posts else F.col("slug")
    return pages.select(F.concat(F.lit(LAYOUT[cms]), name, F.lit(".md")).alias("path"), F.concat(front, F.coalesce("body", F.lit(""))).alias("content"))


def write_files(files: DataFrame, root: str) -> int:
    """Writes (path, content) as UTF-8 files under a folder that all workers reach; how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                target = f"{base}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
