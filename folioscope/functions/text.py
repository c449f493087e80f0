"""Text functions as column expressions: all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's line boundaries.
LINE_BREAK = "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"
#: White space as Python's \s has it for text.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[^\s\x1c-\x1f\x85\p{Z}]+"
#: Markdown headings: marks, title, optional closing marks.
HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*(?:#+\s*)?$"
#: Lines in which the fence that closes a front matter is looked for first, and what may stand around it.
HEAD_LINES, FENCE_SPACE = 64, " \t\x0b\x0c\xa0"
#: The place of a value in a template.
PLACE = r"(?U)\{\{(\w+)\}\}"
#: Words without content; fixed values.
STOP_WORDS = [
    "about", "after", "against", "because", "before", "between", "could", "from", "have", "into", "more", "most",
    "that", "their", "there", "these", "this", "through", "when", "where", "which", "while", "with", "would",
]
#: Secrets and local paths in messages, in the order of replacement; fixed values.
SECRETS = [
    (r"\bsk-ant-[A-Za-z0-9_-]{10,}\b", "[REDACTED_ANTHROPIC_KEY]"),
    (r"\bsk-(?:proj-)?[A-Za-z0-9_-]{10,}\b", "[REDACTED_OPENAI_KEY]"),
    (r"\bAIza[A-Za-z0-9_-]{20,}\b", "[REDACTED_GEMINI_KEY]"),
    (r"(?i)\b((?:api|provider)[_-]?(?:key|token)\s*[:=]\s*)[A-Za-z0-9._~+/=-]{24,}\b", "$1[REDACTED_PROVIDER_TOKEN]"),
    (r"\bBearer\s+[A-Za-z0-9._~+/=-]+", "[REDACTED_BEARER_TOKEN]"),
    (r"(?<![\w:/])/(?!/)(?:[^/\s\x00,;)'\"<>]+(?: [^/\s\x00,;)'\"<>]+)?/)+[^/\s\x00,;)'\"<>]+(?: [^/\s\x00,;)'\"<>]+)?\.[A-Za-z0-9]+", "[REDACTED_LOCAL_PATH]"),
    (r"\b[A-Za-z]:[\\/](?:[^\\/\s\x00,;)'\"<>]+(?: [^\\/\s\x00,;)'\"<>]+)?[\\/])+[^\\/\s\x00,;)'\"<>]+(?: [^\\/\s\x00,;)'\"<>]+)?\.[A-Za-z0-9]+", "[REDACTED_LOCAL_PATH]"),
    (r"(?<![\w:/])/(?!/)[^\s\x00,;)'\"<>]*", "[REDACTED_LOCAL_PATH]"),
    (r"\b[A-Za-z]:[\\/][^\s\x00,;)'\"<>]*", "[REDACTED_LOCAL_PATH]"),
]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row. A column that is named several times inside of lambdas
    is computed anew each time, and for each element."""
    return F.transform(F.array(value), body)[0]


def lines(c: Column) -> Column:
    """Lines without their breaks; a last break starts no line."""
    return without_last_blank(F.split(c, LINE_BREAK, -1))


def without_last_blank(parts: Column) -> Column:
    """Lines split at every break: nothing behind the last break is no line."""
    return F.slice(parts, 1, F.size(parts) - (F.element_at(parts, -1) == "").cast("int"))


def strip_markup(c: Column) -> Column:
    """Without emphasis and code marks."""
    return F.regexp_replace(c, r"\*\*|__|\*|_|`", "")


def slug(c: Column, limit: int = 120, default: str = "section") -> Column:
    """Lower-case words joined by underscores."""
    kept = F.regexp_replace(F.lower(strip_markup(c)), r"(?U)[^\p{L}\p{N}_\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(joined, 1, limit), F.lit("")), F.lit(default))


def first_line_slug(c: Column, words: int = 8) -> Column:
    """The slug of the first words of the first line that isn't blank."""
    line = F.element_at(F.filter(lines(c), lambda x: strip(x) != ""), 1)
    return slug(F.coalesce(F.array_join(F.slice(F.split(squeeze(line), " "), 1, words), " "), F.lit("")))


def ascii_slug(c: Column, limit: int = 80) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    edges = "^-+|-+$"
    joined = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), edges, "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(joined, 1, limit), edges, ""), F.lit("")), F.lit("item"))


def trim_text(c: Column, limit: int = 600) -> Column:
    """Squeezed; beyond the limit cut one short of it and marked by three dots."""
    flat = squeeze(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("...")))


def unwrap_bold_headings(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^(#{1,6}\s+)\*\*(.+?)\*\*[^\S\n]*$", "$1$2")


def rewrite_image_paths(c: Column, names: list[str], prefix: str) -> Column:
    """Image links by bare name get a folder in front."""
    for name in names:
        c = F.replace(F.replace(c, F.lit(f"({name})"), F.lit(f"({prefix}{name})")), F.lit(f'src="{name}"'), F.lit(f'src="{prefix}{name}"'))
    return c


def chunk_image_paths(c: Column) -> Column:
    """Markdown images in images/ as seen from a folder below; other links stay."""
    return F.regexp_replace(c, r"!\[([^\]]*)\]\((images/[^)]+)\)", "![$1](../$2)")


def canonical_name(parts: list[Column], limit: int = 150) -> Column:
    """Title, authors and the like as one file name."""
    texts = F.filter(F.transform(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), strip), lambda x: x != "")
    kept = F.regexp_replace(F.lower(F.array_join(texts, "_")), r"(?U)[^\p{L}\p{N}_\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(joined, 1, limit), F.lit("")), F.lit("document"))


def authors(c: Column) -> Column:
    """Names split at commas and 'and'."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"(?U)\s+and\s+", ","), ","), strip), lambda x: x != "")


def authors_for_display(c: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(authors(c), ", "), F.lit("")), F.lit("Unknown"))


def front_matter(c: Column) -> Column:
    """The flat map between the fences at the top, keys in lower case, blank values left out; of equal
    keys the last counts; empty if not closed."""
    # Nearly all end within the first lines; all others are looked for in all lines.
    head = lambda parts: F.slice(parts, 1, HEAD_LINES)
    ended = lambda parts: (strip(parts[0]) != "---") | F.exists(F.slice(parts, 2, HEAD_LINES - 1), lambda x: F.btrim(x, F.lit(FENCE_SPACE)) == "---")
    return once(F.split(c, LINE_BREAK, HEAD_LINES + 1), lambda parts: once(F.when(F.size(parts) <= HEAD_LINES, without_last_blank(parts)).when(ended(parts), head(parts)).otherwise(once(F.split(c, LINE_BREAK, -1), without_last_blank)), _front_matter))


def _front_matter(every: Column) -> Column:
    rest = F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0)))
    # Only lines up to the closing fence are looked at closely, so finding it must be cheap.
    place = F.array_position(F.transform(rest, lambda x: F.btrim(x, F.lit(FENCE_SPACE))), "---")
    usable = (F.size(every) > 1) & (strip(F.element_at(every, 1)) == "---")

    def entries_of(close: Column) -> Column:
        pairs = F.filter(F.slice(every, 2, F.greatest(close - 1, F.lit(0)).cast("int")), lambda x: F.instr(x, ":") > 0)
        every_entry = F.transform(pairs, lambda x: F.struct(F.lower(strip(F.split(x, ":", 2)[0])).alias("key"), F.regexp_replace(strip(F.split(x, ":", 2)[1]), r"""^["']+|["']+$""", "").alias("value")))
        return F.filter(every_entry, lambda e: (e["key"] != "") & (e["value"] != ""))

    last = lambda entries: F.map_from_entries(F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"])))
    return once(F.when(usable, place).otherwise(F.lit(0)), lambda close: once(entries_of(close), last))


def first_heading(c: Column) -> Column:
    """The title of the first level-one heading without markup, null if none."""
    found = F.filter(lines(c), lambda x: x.rlike(r"(?U)^#\s+\S"))
    return strip(strip_markup(F.regexp_extract(F.try_element_at(found, F.lit(1)), r"(?U)^#\s+(.*)$", 1)))


def byline(c: Column, within: int = 40) -> Column:
    """What follows 'by' at the start of one of the first lines, null if none."""
    found = F.filter(F.transform(F.slice(lines(c), 1, within), lambda x: strip(strip_markup(x))), lambda x: F.lower(x).startswith("by "))
    return strip(F.regexp_replace(F.try_element_at(found, F.lit(1)), "^...", ""))


def stem_title(c: Column) -> Column:
    """A file stem as a title."""
    return F.initcap(strip(F.translate(c, "_-", "  ")))


def document_title(markdown: Column, stem: Column) -> Column:
    meta = front_matter(markdown)
    return F.coalesce(F.nullif(F.try_element_at(meta, F.lit("title")), F.lit("")), F.nullif(first_heading(markdown), F.lit("")), stem_title(stem))


def document_authors(markdown: Column) -> Column:
    """Authors of the front matter, else of the byline, as one text; null if there are none."""
    meta = front_matter(markdown)
    return F.coalesce(F.try_element_at(meta, F.lit("authors")), F.try_element_at(meta, F.lit("author")), byline(markdown))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def word_count(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def probe_text(c: Column, chars: int = 20_000, tokens: int = 7_500) -> Column:
    """The beginning that an embedding model is asked about, without a tokenizer at hand."""
    return F.substring(F.substring(c, 1, chars), 1, tokens)


def terms(c: Column) -> Column:
    """Distinct content words."""
    return F.array_except(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))


def entities(c: Column) -> Column:
    """Distinct runs of capitalised words, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*\b"), F.lit(0)), lambda x: F.length(x) > 1))


def dates(c: Column) -> Column:
    """Distinct years, then distinct written-out dates."""
    years = F.regexp_extract_all(c, F.lit(r"(?U)\b(?:1[6-9]\d{2}|20\d{2}|21\d{2})\b"), F.lit(0))
    written = F.regexp_extract_all(c, F.lit(r"(?U)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"), F.lit(0))
    return F.array_distinct(F.concat(years, written))


def quantities(c: Column) -> Column:
    """Distinct numbers; a fraction gives both of its parts."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\b\d+(?:\.\d+)?%?|\b\d+/\d+\b"), F.lit(0)))


def redact(c: Column, limit: int = 500) -> Column:
    """A message without secrets and local paths, on one line."""
    clean = reduce(lambda x, p: F.regexp_replace(x, f"(?U){p[0]}", p[1]), SECRETS, F.replace(c, F.lit("\x00"), F.lit("")))
    return F.substring(squeeze(clean), 1, limit)


def numbered(items: Column, empty: str = "(none)") -> Column:
    text = F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return F.when(F.size(items) > 0, text).otherwise(empty)


def bulleted(items: Column, empty: str = "- (none)") -> Column:
    text = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, text).otherwise(empty)


def normal_fact(c: Column) -> Column:
    """Facts that differ in case and spacing only are one. Lower-casing stands for case folding."""
    return squeeze(F.lower(c))


def timestamp(seconds: Column) -> Column:
    """[HH:]MM:SS.mmm, never below zero."""
    ms = F.greatest(F.round(seconds * 1000).cast("bigint"), F.lit(0))
    hours, minutes, rest = (ms / 3_600_000).cast("bigint"), ((ms % 3_600_000) / 60_000).cast("bigint"), ms % 60_000
    short = F.format_string("%02d:%02d.%03d", minutes, (rest / 1000).cast("bigint"), rest % 1000)
    return F.when(hours > 0, F.concat(F.format_string("%02d:", hours), short)).otherwise(short)


def diarised_line(text: Column, speaker: Column, start: Column, end: Column) -> Column:
    """[start - end] speaker: text; no range unless both ends are known."""
    said = F.concat(F.coalesce(speaker, F.lit("Speaker 1")), F.lit(": "), text)
    span = F.concat(F.lit("["), timestamp(start), F.lit(" - "), timestamp(end), F.lit("] "))
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(span, said)).otherwise(said)


def heading_path(c: Column, fallback: Column) -> Column:
    """All heading lines' titles, outermost first, or the fallback."""
    titles = F.transform(F.filter(lines(c), lambda x: x.startswith("#")), lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
    found = F.coalesce(F.nullif(F.array_join(F.filter(titles, lambda x: x != ""), " > "), F.lit("")), fallback)
    return F.when(F.contains(c, F.lit("#")), found).otherwise(fallback)  # most texts have none, and aren't split


def key_of(*parts: Column, length: int = 24) -> Column:
    """A content key: the beginning of the SHA-256 of the parts as JSON."""
    named = F.struct(*[p.cast("string").alias(f"p{i:03d}") for i, p in enumerate(parts)])
    return F.substring(F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256), 1, length)


def evidence_id(node_id: Column) -> Column:
    return F.concat(F.lit("ev:"), F.regexp_replace(F.regexp_replace(node_id, "[^a-zA-Z0-9._:-]+", "-"), "^-+|-+$", ""))


def relative_path(path: Column, root: Column) -> Column:
    """The path below a root, or as it is."""
    base = F.concat(F.rtrim(root), F.lit("/"))
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def render(template: Column, values: Column) -> Column:
    """{{name}} places filled from a map in one pass: values are not looked at again. Names that are
    missing or that the template doesn't have are an error; a null value is empty."""
    names = F.regexp_extract_all(template, F.lit(PLACE), F.lit(1))
    texts = F.split(template, PLACE, -1)
    filled = F.array_join(F.transform(texts, lambda x, i: F.concat(x, F.when(i < F.size(names), F.coalesce(F.try_element_at(values, F.get(names, i)), F.lit(""))).otherwise(""))), "")
    wrong = placeholder_errors(F.map_keys(values), names)
    said = F.concat(F.lit("no values for: "), F.array_join(wrong["missing"], ", "), F.lit("; no places for: "), F.array_join(wrong["unknown"], ", "))
    return F.when((F.size(wrong["missing"]) > 0) | (F.size(wrong["unknown"]) > 0), F.raise_error(said).cast("string")).otherwise(filled)


def placeholder_errors(given: Column, wanted: Column) -> Column:
    """Names that a template wants and are not given, and names that are given for nothing."""
    return F.struct(F.array_sort(F.array_except(wanted, given)).alias("missing"), F.array_sort(F.array_except(given, wanted)).alias("unknown"))


def placeholders(template: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(template, F.lit(PLACE), F.lit(1))))
