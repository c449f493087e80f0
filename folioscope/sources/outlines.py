"""Outline corpora: lists of headings that people annotate with levels, their manifest, and runs' names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evals, structure

#: What an annotation says, in order; fixed values.
SAYS = {
    "document": ("title", "level", "line"),
    "section": ("level", "first_heading", "line"),
    "chapter": ("level", "first_heading", "line"),
    "subchapter": ("level", "first_heading", "line"),
}
#: Names of runs and cases, and a hash in hexadecimal; fixed values.
RUN_ID, CASE_ID, DIGEST = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,63}\z", r"\A[a-z0-9][a-z0-9-]{0,254}\z", r"\A[0-9a-f]{64}\z"

_CASE = {"id": "STRING", "source": "STRING", "sha256": "STRING", "entry_count": "BIGINT", "size_bytes": "BIGINT"}


def _pending_lines() -> list[str]:
    """The lines above an outline that nobody has annotated yet."""
    parts = [f"{part}:\n" + "\n".join(f"  {key}: TODO" for key in keys) for part, keys in SAYS.items()]
    return ["---", *"\n\n".join(parts).split("\n"), "---"]


def pending(outline: Column) -> Column:
    """An outline (binary) with an empty annotation above it."""
    return F.concat(F.lit("".join(x + "\n" for x in _pending_lines()).encode()), outline)


def annotations(cases: DataFrame) -> DataFrame:
    """cases (id, input, output; both binary) with annotation and problem.

    An output is an annotation of fixed lines above the unchanged input. annotation maps 'chapter.level'
    and the like to what is said, TODO included; a heading in quotes is a JSON string. problem is the
    first thing that is wrong, null if nothing is; annotation is null where there is a problem.
    """
    above = F.substring("output", F.lit(1), F.length("output") - F.length("input"))
    split = cases.withColumn("_above", above).withColumn("_text", F.when(F.is_valid_utf8(F.col("_above").cast("string")), F.col("_above").cast("string"))).withColumn("_lines", T.lines(F.col("_text")))
    expected = _pending_lines()
    problems = [
        F.when(~F.coalesce(F.endswith("output", F.col("input")), F.lit(False)), "the input is changed"),
        F.when(F.col("_text").isNull(), "not UTF-8"),
        F.when(F.size("_lines") != len(expected), f"not {len(expected)} lines"),
    ]
    said: list[Column] = []
    part = ""
    for at, line in enumerate(expected):
        actual = F.get("_lines", F.lit(at))
        if not line.startswith("  "):
            part = line.rstrip(":") or part
            problems.append(F.when(actual != line, f"line {at + 1} isn't '{line}'"))
            continue
        mark = line.removesuffix("TODO")
        name = f"{part}.{mark.strip(' :')}"
        raw = F.substring(actual, F.lit(len(mark) + 1), F.length(actual))
        problems.append(F.when(~actual.startswith(mark) | (T.strip(raw) == ""), f"no {name}"))
        if name.endswith(".level"):
            value = raw
            problems.append(F.when(~raw.rlike(r"\A(TODO|H[1-6])\z"), f"{name} is neither TODO nor H1 to H6"))
        elif name.endswith(".line"):
            value = F.when(raw == "TODO", raw).otherwise(F.regexp_replace(raw, "^0+", ""))
            problems.append(F.when(~raw.rlike(r"\A(TODO|0*[1-9][0-9]*)\z"), f"{name} is neither TODO nor a positive number"))
        else:
            quoted = F.try_parse_json(F.when(raw.startswith('"'), raw))
            decoded = F.when(F.schema_of_variant(quoted) == "STRING", F.try_variant_get(quoted, "$", "string"))
            value = F.when(raw.startswith('"'), decoded).otherwise(T.strip(raw))
            problems.append(F.when(F.coalesce(value, F.lit("")) == "", f"{name} isn't a string"))
        said += [F.lit(name), value]
    problems.append(F.when(~F.col("_text").startswith("---\n") | ~F.col("_text").endswith("---\n"), "the fences don't end with a line feed"))
    judged = split.withColumn("problem", F.coalesce(*problems))
    return judged.withColumn("annotation", F.when(F.col("problem").isNull(), F.create_map(*said))).drop("_above", "_text", "_lines")


def evaluate(cases: DataFrame) -> DataFrame:
    """(id, predicted, expected, status, problem) of annotated cases (id, input, output): the level that
    chapters are split at against the annotated one; null expected is pending."""
    read = annotations(cases)
    toc = F.decode("input", "UTF-8")
    levels = structure.chapter_levels(read.select(F.col("id").alias("doc_id"), F.explode(structure.listed_levels(toc)).alias("level")))
    both = read.join(levels.withColumnRenamed("doc_id", "id"), "id", "left").withColumn("predicted", F.concat(F.lit("H"), F.col("chapter_level").cast("string")))
    level = F.get(F.array(F.col("annotation")["chapter.level"]), F.lit(0))
    known = both.withColumn("expected", F.when(level != "TODO", level))
    problem = F.coalesce("problem", F.when(F.col("predicted").isNull(), "no level in the outline"))
    return known.select("id", "predicted", "expected", F.when(problem.isNull(), evals.case_status(F.col("expected"), F.col("predicted"))).alias("status"), problem.alias("problem"))


def case_id(source: Column, content: Column) -> Column:
    """A slug of the source's path with the beginnings of the path's and the content's SHA-256."""
    trimmed = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    slug = F.coalesce(F.nullif(trimmed(F.regexp_replace(F.lower(source), "[^a-z0-9]+", "-")), F.lit("")), F.lit("outline"))
    short = lambda c: F.substring(F.sha2(c, 256), 1, 12)
    return F.concat_ws("-", F.regexp_replace(F.substring(slug, 1, 48), "-+$", ""), short(source.cast("binary")), short(content))


def corpus(candidates: DataFrame, count: int) -> DataFrame:
    """(id, source, sha256, entry_count, size_bytes, input, output): count candidates (source,
    entry_count, content) at even ranks by entries, size and source, each with an empty annotation.
    Too few candidates are an error."""
    if count < 1:
        raise ValueError("count must be positive")
    sized = candidates.withColumn("size_bytes", F.length("content").cast("bigint"))
    there = sized.count()
    if there < count:
        raise ValueError(f"{there} outlines with headings; {count} are needed")
    order = ["entry_count", "size_bytes", "source"]
    # One case is the upper median; quantile_sample takes the lower one of an even number.
    taken = evals.quantile_sample(sized, order, count) if count > 1 else evals.global_rank(sized, order).where(F.col("rank") == there // 2)
    named = taken.select(case_id(F.col("source"), F.col("content")).alias("id"), "source", F.sha2("content", 256).alias("sha256"), F.col("entry_count").cast("bigint").alias("entry_count"), "size_bytes", F.col("content").alias("input"), pending(F.col("content")).alias("output"))
    return named.orderBy("entry_count", "size_bytes", "source")


def manifest(cases: DataFrame) -> DataFrame:
    """One row with the manifest of a corpus (as many cases as were asked for) as JSON, in order."""
    order = F.struct("entry_count", "size_bytes", "source", "id", "sha256")
    listed = F.transform(F.array_sort(F.collect_list(order)), lambda c: F.struct(*[c[k].alias(k) for k in _CASE]))
    return cases.agg(F.to_json(F.struct(F.lit(1).alias("version"), listed.alias("cases"))).alias("manifest"))


def manifest_cases(manifests: DataFrame) -> DataFrame:
    """(id, source, sha256, entry_count, size_bytes) of manifests (manifest): version 1, at least one
    case, exactly these keys with values of the right kind, sources that are relative paths."""
    whole = F.try_parse_json("manifest")
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    cases = F.try_variant_get(whole, "$.cases", "array<variant>")
    keys = lambda v: F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    wrong = lambda bad, why: F.when(F.coalesce(bad, F.lit(True)), why)
    top = F.coalesce(
        wrong(keys(whole) != F.array(F.lit("cases"), F.lit("version")), "not a manifest"),
        wrong((kind(whole, "$.version") != "BIGINT") | (F.try_variant_get(whole, "$.version", "bigint") != 1), "not version 1"),
        wrong(F.size(cases) < 1, "no cases"),
    )
    rows = manifests.select(F.when(top.isNotNull(), F.raise_error(F.concat(F.lit("manifest: "), top)).cast("array<variant>")).otherwise(cases).alias("cases")).select(F.explode("cases").alias("c"))
    c = F.col("c")
    typed = reduce(lambda a, b: a & b, [kind(c, f"$.{k}") == t for k, t in _CASE.items()])
    read = rows.select("c", *[F.try_variant_get(c, f"$.{k}", t.lower()).alias(k) for k, t in _CASE.items()])
    up = F.array_contains(F.split("source", "/"), "..")
    bad = F.coalesce(
        wrong((keys(c) != F.array(*[F.lit(k) for k in sorted(_CASE)])) | ~typed, "keys or their values"),
        wrong(~F.col("id").rlike(CASE_ID), "id"),
        wrong((F.col("source") == "") | F.col("source").startswith("/") | F.col("source").endswith("/") | up, "source"),
        wrong(~F.col("sha256").rlike(DIGEST), "sha256"),
        wrong((F.col("entry_count") < 0) | (F.col("size_bytes") < 0), "counts"),
    )
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("manifest case: "), bad)).cast("string")).otherwise(F.col("id"))
    return read.select(checked.alias("id"), *[k for k in _CASE if k != "id"])


def write_corpus(cases: DataFrame, path: str) -> None:
    """Cases as a table and their manifest beside it; a corpus that is there is never replaced. The
    manifest is written last, so a corpus with a manifest is whole."""
    cases.write.mode("errorifexists").parquet(f"{path}/cases")
    written = cases.sparkSession.read.parquet(f"{path}/cases")
    manifest(written).write.mode("errorifexists").text(f"{path}/manifest")


def is_run_id(c: Column) -> Column:
    """Names that are safe as a folder's."""
    return F.coalesce(c.rlike(RUN_ID), F.lit(False))


def prompt_overrides(values: Column) -> Column:
    """A map of texts NAME=VERSION; the last of equal names counts; anything else is an error."""
    cut_at = lambda v: F.instr(v, "=")
    pair = lambda v: F.struct(F.substring(v, F.lit(1), cut_at(v) - 1).alias("key"), F.substring(v, cut_at(v) + 1, F.length(v)).alias("value"))
    good = F.forall(values, lambda v: (cut_at(v) > 1) & (cut_at(v) < F.length(v)))
    pairs = F.transform(values, pair)
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    return F.when(good, F.map_from_entries(F.filter(pairs, lambda p, i: ~later(p, i)))).otherwise(F.raise_error(F.lit("expected NAME=VERSION")).cast("map<string,string>"))


def unknown_names(overrides: Column, known: Column) -> Column:
    """Names of overrides that there is no prompt for, in order."""
    return F.array_sort(F.array_except(F.map_keys(overrides), known))
