"""Text functions, vectors, scores and strict JSON against expected values."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import jsonx, scores, vectors
from folioscope.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_lines(spark):
    for text, want in (("a\nb\n", ["a", "b"]), ("a\r\nb\rc", ["a", "b", "c"]), ("a\n\nb", ["a", "", "b"]), ("x\u2028y\x0bz", ["x", "y", "z"])):
        assert one(spark, T.lines(F.col("t")), t=text) == want == text.splitlines()


@pytest.mark.parametrize(("text", "want"), [("**Été-Ünï** x!", "été_ünï_x"), ("  A -- B__C ", "a_bc"), ("!!!", "section"), ("a" * 200, "a" * 120)])
def test_slug(spark, text, want):
    assert one(spark, T.slug(F.col("t")), t=text) == want


def test_other_names(spark):
    assert one(spark, T.ascii_slug(F.col("t"), 7), t="Claims & more") == "claims"
    assert one(spark, T.ascii_slug(F.col("t")), t="--- É") == "item"
    assert one(spark, T.canonical_name([F.lit(" The Book "), F.lit(""), F.lit("Ann Lee")])) == "the_book_ann_lee"
    assert one(spark, T.first_line_slug(F.col("t")), t="\n  one two three four five six seven eight nine\nten") == "one_two_three_four_five_six_seven_eight"
    assert one(spark, T.authors(F.col("t")), t="Ann Lee and Bo, , Cy") == ["Ann Lee", "Bo", "Cy"]
    assert one(spark, T.authors_for_display(F.col("t")), t=" ") == "Unknown"


def test_trimmed_text_may_pass_its_limit(spark):
    assert one(spark, T.trim_text(F.col("t"), 5), t="abcdefgh") == "abcd..."
    assert one(spark, T.trim_text(F.col("t"), 5), t=" a \n b ") == "a b"


def test_front_matter_of_long_texts(spark):
    """The closing fence stands beyond the first lines; text without one; lines are split once a row."""
    keys = "".join(f"k{i}: {i % 7}\n" for i in range(100)) + "k3: last\n"
    for rest in ("", "text\n" * 300):
        found = one(spark, T.front_matter(F.col("t")), t=f"---\n{keys} --- \n{rest}")
        assert found == {f"k{i}": "last" if i == 3 else str(i % 7) for i in range(100)}
        assert one(spark, T.front_matter(F.col("t")), t=f"---\n{keys}{rest}") == {}
        assert one(spark, T.front_matter(F.col("t")), t=f"{keys}---\n{rest}") == {}
        assert one(spark, T.front_matter(F.col("t")), t=f"---\na: 1\n---\n{rest}b: 2\n---\n") == {"a": "1"}
    plan = spark.range(1).select(T.front_matter(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(cast(id") == 2


def test_markdown_metadata(spark):
    text = "---\ntitle: One\nname: x: y\ntitle: \"Two\"\n---\n# Heading ##\nBy Ann and Bo\n"
    assert one(spark, T.front_matter(F.col("t")), t=text) == {"title": "Two", "name": "x: y"}
    assert one(spark, T.front_matter(F.col("t")), t="---\na: b\n") == {}
    assert one(spark, T.byline(F.col("t")), t=text) == "Ann and Bo"
    assert one(spark, T.document_title(F.col("t"), F.lit("my_file")), t="no heading") == "My File"
    assert one(spark, T.unwrap_bold_headings(F.col("t")), t="## **Bold** \ntext **b**") == "## Bold\ntext **b**"
    assert one(spark, T.chunk_image_paths(F.col("t")), t="![a](images/x.png)") == "![a](../images/x.png)"
    assert one(spark, T.rewrite_image_paths(F.col("t"), ["x.png"], "images/"), t='(x.png) src="x.png"') == '(images/x.png) src="images/x.png"'
    assert one(spark, T.heading_path(F.col("t"), F.lit("f")), t="# A\ntext\n## B") == "A > B"


def test_extraction(spark):
    assert sorted(one(spark, T.terms(F.col("t")), t="The quick fox, which ran; fox ab a-1b")) == ["a-1b", "fox", "quick", "ran", "the"]
    assert one(spark, T.entities(F.col("t")), t="Ann Lee met Bo. A B Ann Lee") == ["Ann Lee", "Bo", "A B Ann Lee"]
    assert one(spark, T.dates(F.col("t")), t="In 1999 and on Jan 5, 2020 or 1500") == ["1999", "2020", "Jan 5, 2020"]
    assert one(spark, T.entities(F.col("t")), t="\u00c9Ann met Bo\u00a0Lee") == ["Bo\u00a0Lee"]
    assert one(spark, T.dates(F.col("t")), t="in 1999\u00e9 or 2001, May\u00a05, 2010") == ["2001", "2010", "May\u00a05, 2010"]
    assert one(spark, T.quantities(F.col("t")), t="\u00e912 and 7%") == ["7%"]
    assert one(spark, T.quantities(F.col("t")), t="5/8 of 12.5% and 12.5%") == ["5", "8", "12.5%"]


def test_redaction(spark):
    text = "key sk-abcdefghij1234 at /home/me/my notes/a.txt and C:\\Users\\me\\b.md\x00\nBearer abc.def api_key = abcdefghijklmnopqrstuvwxyz plain words"
    clean = one(spark, T.redact(F.col("t")), t=text)
    assert "sk-" not in clean and "/home" not in clean and "C:" not in clean and "abc.def" not in clean and "\n" not in clean
    assert clean.endswith("plain words") and clean.count("[REDACTED") == 5


def test_rendering(spark):
    assert one(spark, T.render(F.lit("{{a}}-{{b}}-{{a}}"), F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("2")))) == "{{b}}-2-{{b}}"
    assert one(spark, T.placeholders(F.lit("{{b}} {{a}} {{b}}"))) == ["a", "b"]
    assert one(spark, T.numbered(F.array(F.lit("x"), F.lit("y")))) == "1. x\n2. y"
    assert one(spark, T.bulleted(F.array().cast("array<string>"))) == "- (none)"
    assert one(spark, T.timestamp(F.lit(3661.0015))) == "01:01:01.002" and one(spark, T.timestamp(F.lit(-1.0))) == "00:00.000"
    assert one(spark, T.diarised_line(F.lit("hi"), F.lit(None).cast("string"), F.lit(1.0), F.lit(None).cast("double"))) == "Speaker 1: hi"
    assert one(spark, T.relative_path(F.lit("/a/b/c.md"), F.lit("/a"))) == "b/c.md"


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(2**-0.5)
    assert one(spark, vectors.cosine(v(0.0, 0.0), v(1.0, 1.0))) == 0.0
    assert one(spark, vectors.cosine(F.lit(None).cast("array<double>"), v(1.0))) == 0.0
    assert one(spark, vectors.mean(F.array(v(1.0, 3.0), v(3.0, 5.0)))) == [2.0, 4.0]
    with pytest.raises(Exception, match="differ in size"):
        one(spark, vectors.cosine(v(1.0), v(1.0, 2.0)))


def test_scores(spark):
    for covered, words, want in ((5, 500, 1.0), (2, 400, 0.5), (50, 100, 1.0), (0, 0, 0.0)):
        assert one(spark, scores.density_score(F.lit(covered), F.lit(words))) == want
    assert one(spark, scores.rubric_normal([F.lit(5.0), F.lit(3.0)])) == 0.75
    assert one(spark, scores.blended(*[F.lit(1.0)] * 4)) == pytest.approx(1.0)
    fit = one(spark, scores.claim_score(F.lit(0.9), F.lit("solar panels convert light"), F.lit("solar panels convert light to power in the home")))
    assert fit > one(spark, scores.claim_score(F.lit(0.0), F.lit("solar panels convert light"), F.lit("a cat")))


def test_strict_json(spark):
    v = jsonx.salvage(F.col("t"))
    assert one(spark, jsonx.strict_string(v, "$.a"), t='```json\n{"a": "x"}\n```') == "x"
    assert one(spark, jsonx.strict_string(v, "$.a"), t='noise {"a": "x"} more') == "x"
    for bad in ('{"a": 3}', '{"a": " "}', '{"a": null}', "{}", "no json"):
        assert one(spark, jsonx.strict_string(v, "$.a"), t=bad) is None
    for text, want in (("4", 4), ("true", None), ("0", None), ("6", None), ('"3"', None), ("null", None)):
        assert one(spark, jsonx.rubric_grade(v, "$.g"), t=f'{{"g": {text}}}') == want
    good = '{"verdicts": [{"covered": true, "evidence": "e"}, {"covered": false, "evidence": "f"}]}'
    assert [tuple(x) for x in one(spark, jsonx.verdicts(v, "covered", F.lit(2)), t=good)] == [(True, "e", "SUPPORTED", []), (False, "f", "NOT_IN_SOURCE", [])]
    told = '{"verdicts": [{"covered": true, "evidence": " e ", "status": "AMBIGUOUS", "issue_categories": ["a", " ", 3]}, {"covered": false, "evidence": "f", "status": 5, "issue_categories": "b"}]}'
    assert [tuple(x) for x in one(spark, jsonx.verdicts(v, "covered", F.lit(2)), t=told)] == [(True, "e", "AMBIGUOUS", ["a"]), (False, "f", "NOT_IN_SOURCE", [])]
    assert one(spark, jsonx.verdicts(v, "covered", F.lit(3)), t=good) is None
    assert one(spark, jsonx.string_list(v, "$.f"), t='{"f": ["a", "b"]}') == ["a", "b"]
    assert one(spark, jsonx.string_list(v, "$.f"), t='{"f": ["a", 3]}') is None
    assert one(spark, jsonx.one_of(v, "$.s", ["ok", "bad"], "ok"), t='{"s": "other"}') == "ok"
    assert one(spark, jsonx.strip_code_fence(F.col("t")), t="```\nopen") == "open"
    assert one(spark, jsonx.strip_code_fence(F.col("t"), True), t="```\nopen") == "```\nopen"


def test_responses(spark):
    data = '{"data": [{"index": 1, "embedding": [2, 3]}, {"index": 0, "embedding": [0, 1]}]}'
    assert one(spark, jsonx.embedding_rows(jsonx.salvage(F.col("t")), F.lit(2)), t=data) == [[0.0, 1.0], [2.0, 3.0]]
    said = '{"segments": [{"text": " a ", "start": "1.5", "end": 2}, {"text": " "}], "language": "en"}'
    found = one(spark, jsonx.transcript(jsonx.salvage(F.col("t"))), t=said)
    assert found["text"] == "a" and [tuple(s) for s in found["segments"]] == [("a", None, 1.5, 2.0)]
    assert [s["text"] for s in one(spark, jsonx.transcript(jsonx.salvage(F.col("t"))), t='{"text": "all"}')["segments"]] == ["all"]


def test_texts_without_headings_have_the_fallback(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "## A ##\nx # y\n# B"), (3, None), (4, "x # y\n#\n"), (5, "")], "id int, text string")
    assert [r["p"] for r in rows.orderBy("id").select(T.heading_path(F.col("text"), F.lit("f")).alias("p")).collect()] == ["f", "A ## > B", "f", "f", "f"]
