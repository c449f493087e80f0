"""Reading documents and run files. Every reader goes through Spark, so paths may be in any store."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Sequence
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources.html import markdown_of

#: Formats by file suffix; fixed values.
FORMATS = {".epub": "epub", ".markdown": "markdown", ".md": "markdown", ".pdf": "pdf", ".txt": "text"}
#: What asset folders are made from; text files are not.
ASSETS = [".epub", ".markdown", ".md", ".pdf"]
#: Bytes sent at once, bits a second, least window in seconds.
AUDIO_BYTES, AUDIO_BITS, AUDIO_LEAST = 24_000_000, 32_000, 60


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def source_format(path: Column) -> Column:
    """The format by suffix; others are an error."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in FORMATS.items() for x in p]), suffix(path))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unsupported source: "), path)).cast("string"))


def supported(path: Column) -> Column:
    return suffix(path).isin(ASSETS)


def binary_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_epub(content: bytes) -> tuple[str, list[str], list[str]]:
    """Title, authors and the XHTML of the spine's documents in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names:
            raise ValueError("the archive is encrypted")

        def read(name: str) -> str:
            clean = posixpath.normpath(name)
            if clean.startswith(("/", "..")) or clean not in names:
                raise ValueError(f"not in the archive: {name}")
            return z.read(clean).decode("utf-8")

        local = lambda e: e.tag.rpartition("}")[2]
        container = ElementTree.fromstring(read("META-INF/container.xml"))
        package = next(e.get("full-path", "") for e in container.iter() if local(e) == "rootfile")
        root = ElementTree.fromstring(read(package))
        said = lambda tag: [" ".join("".join(e.itertext()).split()) for e in root.iter() if local(e) == tag]
        manifest = {e.get("id"): e.get("href", "") for e in root.iter() if local(e) == "item" and e.get("media-type") in ("application/xhtml+xml", "text/html")}
        spine = [e.get("idref") for e in root.iter() if local(e) == "itemref"]
        order = [manifest[i] for i in spine if i in manifest] if spine else list(manifest.values())
        base = posixpath.dirname(package)
        pages = [read(posixpath.join(base, unquote(h.partition("#")[0]))) for h in order]
        return next((t for t in said("title") if t), ""), [a for a in said("creator") if a], pages


def epub_markdown(content: bytes) -> str:
    title, authors, pages = read_epub(content)
    head = [f"# {title}"] * bool(title) + [f"By {', '.join(authors)}"] * bool(authors)
    return "\n\n".join([*head, *filter(None, map(markdown_of, pages))]).strip() + "\n"


def documents(spark: SparkSession, path: str, pdf: Callable[[bytes], str] | None = None, recursive: bool = False) -> DataFrame:
    """(path, source_format, title, authors, sha256, markdown) of files of any supported format.

    pdf turns a PDF's bytes into Markdown; without it PDFs are an error. Text and Markdown are
    decoded in the JVM, archives are opened in Arrow batches.
    """

    @F.pandas_udf("string")
    def opened(content: pd.Series, kind: pd.Series) -> pd.Series:
        def one(data: bytes, name: str) -> str:
            if name == "epub":
                return epub_markdown(bytes(data))
            if pdf is None:
                raise ValueError("no converter for PDF")
            return pdf(bytes(data))

        return pd.Series([one(c, k) for c, k in zip(content, kind, strict=True)])

    files = binary_files(spark, path, recursive=recursive).withColumn("source_format", source_format(F.col("path")))
    plain = files.where("source_format IN ('markdown', 'text')").withColumn("markdown", F.decode("content", "UTF-8"))
    other = files.where("source_format NOT IN ('markdown', 'text')").withColumn("markdown", opened("content", "source_format"))
    every = plain.unionByName(other)
    return every.select("path", "source_format", T.document_title(F.col("markdown"), stem(F.col("path"))).alias("title"), T.document_authors(F.col("markdown")).alias("authors"), F.sha2("content", 256).alias("sha256"), "markdown")


def choose_converter(remote: Callable | None, alternate: Callable | None, default: Callable) -> Callable:
    """The remote converter if there is one, then the alternate one, then the default."""
    return remote or alternate or default


def corpus(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """(name, text) of a folder's Markdown files in order of name; a named file must exist."""
    found = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(file_name(F.input_file_name()).alias("name"), F.col("value").alias("text"))
    if names is None:
        return found.orderBy("name")
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    there = wanted.join(found, "name", "left")
    checked = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("missing document: "), F.col("name"))).cast("string")).otherwise(F.col("text"))
    return there.select("name", checked.alias("text")).orderBy("name")


_DOC = "doc_name string, blended double, error string"
_RUN = "run_id string, mean_blended double, prompt_versions map<string,string>"


def eval_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """runs (run_id, kind, path, mtime, mean_blended, prompt_versions) and scores (run_id, kind, pos,
    doc_name, blended, error) of three layouts of run files: flat scores, and scores one level down."""
    flat = f"{_RUN}, docs array<struct<{_DOC.replace(' ', ':').replace(',:', ',')}>>"
    deep = f"{_RUN}, docs array<struct<doc_name:string,error:string,score:struct<blended:double,error:string>>>"

    def read(path: str, schema: str, kind: str, nested: bool) -> DataFrame | None:
        try:
            raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))
            raw.schema  # noqa: B018
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        one = lambda d: F.struct(d["doc_name"].alias("doc_name"), (d["score"]["blended"] if nested else d["blended"]).alias("blended"), (F.coalesce(d["error"], d["score"]["error"]) if nested else d["error"]).alias("error"))
        return raw.select("run_id", F.lit(kind).alias("kind"), "path", "mtime", "mean_blended", "prompt_versions", F.transform("docs", one).alias("docs"))

    parts = [p for p in (read(f"{folder}/runs/*.json", flat, "standard", False), read(f"{folder}/claim_graph/*/run.json", deep, "graph", True), read(f"{folder}/merged_summary/*/run.json", deep, "merged", True)) if p is not None]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    scores = every.select("run_id", "kind", F.posexplode("docs").alias("pos", "d")).select("run_id", "kind", "pos", "d.*")
    return every.drop("docs").orderBy("run_id", "kind"), scores


def calibration_cases(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, pos, item, expected): facts and claims with what judges should say; arrays of
    unequal length are an error."""
    schema = "name string, facts array<string>, summary string, expected_covered array<boolean>, claims array<string>, document string, expected_supported array<boolean>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)

    def part(kind: str, items: str, expected: str) -> DataFrame:
        pairs = F.when(F.size(items) == F.size(expected), F.arrays_zip(F.col(items).alias("item"), F.col(expected).alias("expected"))).otherwise(F.raise_error(F.lit(f"{items} and {expected} differ in length")))
        return raw.select("name", F.lit(kind).alias("kind"), F.posexplode(pairs).alias("pos", "x")).select("name", "kind", "pos", F.col("x.item").alias("item"), F.col("x.expected").alias("expected"))

    return part("coverage", "facts", "expected_covered").unionByName(part("support", "claims", "expected_supported"))


def outline_candidates(spark: SparkSession, root: str, entries: Column) -> DataFrame:
    """(path, size_bytes, text, entry_count) of headers.md files with entries, smallest first.

    entries counts the headings of column text.
    """
    files = binary_files(spark, root, "headers.md", True).select("path", F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("text"))
    return files.where(T.strip(F.col("text")) != "").withColumn("entry_count", entries).where("entry_count > 0").orderBy("entry_count", "size_bytes", "path")


def trusted_corpus(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest cases (id, sha256, size_bytes, ...) with content of files (id, content): ids must be
    the same set and unique, sizes and hashes must agree."""
    twice = manifest.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = manifest.join(twice, "id").withColumn("listed", F.lit(True)).join(files.withColumn("there", F.lit(True)), "id", "full_outer")
    wrong = (
        F.when(F.col("there").isNull(), "not in the folder").when(F.col("listed").isNull(), "not in the manifest").when(F.col("n") > 1, "listed twice")
        .when(F.octet_length("content") != F.col("size_bytes"), "size differs").when(F.sha2("content", 256) != F.col("sha256"), "SHA-256 differs")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.col("id"), F.lit(": "), wrong)).cast("string")).otherwise(F.col("id"))
    return both.withColumn("id", checked).drop("n", "listed", "there")


def audio_window_seconds() -> int:
    """The width of windows that keeps each below the size limit."""
    return max(AUDIO_LEAST, int(AUDIO_BYTES * 8 * 0.8 / AUDIO_BITS))


def asset_sources(files: DataFrame, generated: Sequence[str] = ("headers.md", "metadata.json", "summary.md")) -> DataFrame:
    """(asset_dir, markdown, original) from (asset_dir, name): one Markdown file, at most one other."""
    own = files.where(~F.col("name").isin(list(generated)))
    markdown = suffix(F.col("name")).isin(".md", ".markdown")
    grouped = own.groupBy("asset_dir").agg(F.count_if(markdown).alias("m"), F.count_if(~markdown & supported(F.col("name"))).alias("o"), F.min(F.when(markdown, F.col("name"))).alias("markdown"), F.min(F.when(~markdown & supported(F.col("name")), F.col("name"))).alias("other"))
    wrong = F.when(F.col("m") != 1, "not one Markdown file").when(F.col("o") > 1, "more than one source")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.col("asset_dir"), F.lit(": "), wrong)).cast("string")).otherwise(F.col("asset_dir"))
    return grouped.select(checked.alias("asset_dir"), "markdown", F.coalesce("other", "markdown").alias("original"))


def vault_sources(files: DataFrame, asset_root: str, types: Sequence[str] = (".epub", ".pdf")) -> DataFrame:
    """Top-level sources of a vault: no hidden files, no other types, nothing below the asset root."""
    name = file_name(F.col("path"))
    return files.where(~name.startswith(".") & suffix(F.col("path")).isin(list(types)) & ~F.contains("path", F.lit(asset_root.rstrip("/") + "/"))).orderBy("path")


def samples(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(line, sample): the first lines that aren't blank."""
    if limit < 1:
        raise ValueError("limit must be positive")
    text = spark.read.text(path, wholetext=True).select(F.posexplode(T.lines(F.col("value"))).alias("line", "sample"))
    return text.select("line", T.strip(F.col("sample")).alias("sample")).where("sample <> ''").orderBy("line").limit(limit)


def dotenv(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, value) of lines (line, text); comments and blanks go, the last of equal keys counts, keys
    that are known already are left out."""
    text = F.regexp_replace(T.strip(F.col("text")), r"^export\s+", "")
    parts = F.split(text, "=", 2)
    raw = T.strip(parts[1])
    bare = F.when(raw.rlike(r"""^(".*"|'.*')$"""), F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw)
    read = lines.where(~text.startswith("#") & F.contains(text, F.lit("="))).select("line", T.strip(parts[0]).alias("key"), bare.alias("value")).where("key <> ''")
    last = read.groupBy("key").agg(F.max(F.struct("line", "value")).alias("x")).select("key", F.col("x.value").alias("value"))
    return last if known is None else last.join(known, "key", "left_anti")


def prompt_versions(prompts: DataFrame) -> DataFrame:
    """prompts (name, version 'v001', text, active version) in numeric order with is_active; a name's
    active version must exist."""
    number = F.substring("version", 2, 9).cast("int")
    active = F.col("version") == F.col("active")
    there = prompts.groupBy("name").agg(F.count_if(active).alias("n"))
    checked = F.when(F.col("n") < 1, F.raise_error(F.concat(F.lit("no active version of "), F.col("name"))).cast("string")).otherwise(F.col("name"))
    return prompts.join(there, "name").select(checked.alias("name"), number.alias("number"), "version", "text", active.alias("is_active")).orderBy("name", "number")
