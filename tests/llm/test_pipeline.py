import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import registry
from folioscope.llm.runtime import durable

from .conftest import words
from .test_near_dedup import brute


def test_stages_against_brute_force(spark, tmp_path):
    base = [words(i, 80) for i in range(60)]
    near = [" ".join([*t.split()[:40], "odd", *t.split()[41:]]) for t in base[:10]]
    texts = [*base, *base[:15], *near, *(t.upper().replace(" ", "!! ") for t in base[:8]), None, ""]
    rows = [(i, t, ["en", "fr"][i % 2], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left.append({r["doc_id"]: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(str(tmp_path / f"stage{len(left)}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{len(left)}"))
    good, distinct, single, mixed, ids = left
    assert set(good) == set(range(85))
    assert set(distinct) == {max(j for j in good if texts[j] == texts[i]) for i in good}
    assert set(single) == {c for _, c in brute([(i, texts[i]) for i in distinct], 5, 80).values()}
    assert set(mixed) < set(single) and set(ids) == set(mixed)
    kept, all_ = (sum(len(texts[i].split()) for i in part) for part in (mixed, single))
    assert abs(kept / all_ - corpus_pipeline.MIXTURE) < 0.15
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in ids.items():
        assert r["ids"] == library.encode(texts[i], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert np.array_equal(sorted(ids), sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_every_operator_is_registered_once():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_odd_rows_and_copies(spark, tmp_path):
    """Null ids, repeated rows, copies under one id and an extra column: no exact copy is left."""
    from .conftest import words

    rows = [(i, words(i, 50), "en", "s", i, "x") for i in range(60)]
    rows += [(7, words(3, 50), "en", "s", 1, "y"), (7, words(3, 50), "en", "s", 1, "y"), (None, words(4, 50), None, None, 1, "z"), (None, None, "en", "s", 0, "z"), (3, "", "en", "s", 0, None), (5, words(5, 50) + " more", "en", "s", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row_number string").repartition(4)
    left = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = durable(stage(spark, left, str(tmp_path)), "odd")
        assert left.columns == docs.columns
    texts = [r["text"] for r in left.collect()]
    assert len(texts) == len(set(texts)) and not (words(5, 50) in texts and words(5, 50) + " more" in texts)
    last = corpus_pipeline.STAGES[4][1](spark, left, str(tmp_path))
    assert last.count() == left.count() > 0


def test_stages_on_an_empty_table(spark, empty, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
