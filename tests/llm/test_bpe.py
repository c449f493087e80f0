import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(bpe.definition_at())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_and_text_as_the_library(own, library, texts):
    for t in [*(t or "" for t in texts), "  \n\n \t x", " 　x", "՘\U0001e6c0a1", "naïve café №５"]:
        want = library.encode(t, add_special_tokens=False).ids
        pieces = list(own.encode(t))
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == want
        assert "".join(own.decode(iter(pieces))) == library.decode(want, skip_special_tokens=False)


def test_stream_needs_lookahead_only(own):
    small = bpe.ByteBpe(bpe.definition_at())
    small.buffer = small.lookahead + 24
    rng = random.Random(5)
    for letters in ("ab", "aeinrst", "0123456789", "=-", "\n ", "é日"):
        data = "".join(rng.choice(letters) for _ in range(1500)).encode()
        chunks = (data[i : i + 11] for i in range(0, len(data), 11))
        assert [i for part in small.stream(chunks) for i in part] == own.merged(data)


def test_decoder_is_incremental(own):
    ids = np.frombuffer(b"".join(own.encode("日本 é \U0001f600")), "<u4")
    assert "".join(own.decode(iter([np.array([i], "<u4").tobytes() for i in ids]))) == "日本 é \U0001f600"
    assert "�" in "".join(own.decode(iter([np.array([own.byte[0xE6]], "<u4").tobytes()])))


def test_digests_of_documents(docs, odd, empty, library):
    for r, d in zip(sorted(bpe.token_digests(docs).collect(), key=lambda r: r["doc_id"]), sorted(docs.collect(), key=lambda r: r["doc_id"]), strict=True):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert bpe.token_digests(odd).count() == odd.count() and bpe.token_digests(empty).count() == 0
    back = bpe.decode_column(bpe.encode_column(docs))
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())


def test_lookahead_of_a_small_list():
    assert bpe.lookahead([]) == 0
    assert bpe.lookahead([(b"a", b"b")]) == 1
    assert bpe.lookahead([(b"b", b"c"), (b"a", b"bc")]) == 2


def test_every_word_goes_through_the_transducer(monkeypatch, library):
    own = bpe.ByteBpe(bpe.definition_at())
    seen = []
    stream = own.stream
    monkeypatch.setattr(own, "stream", lambda chunks: (seen.append(1), stream(chunks))[1])
    text = "some words, and some words again; " + "x" * 5000
    ids = np.frombuffer(b"".join(own.encode(text)), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert len(seen) == len(set(own.words.findall(text)))


def test_blocks_make_no_difference(monkeypatch, own, library):
    rng = random.Random(8)
    monkeypatch.setattr(bpe, "_BLOCK", 7)
    pieces = ["a", "word", "'s", "12", "!?", " ", "  ", "\n", "\t ", "é日", " ", "don't", "　", "x" * 30]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        assert np.frombuffer(b"".join(own.encode(text)), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts(own, library):
    for text in ("words of a long text. " * 300_000, "ab" * 500_000, " " * 1_000_000 + "x", "日本" * 200_000):
        count, ids, back = own.digest(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert count == len(want) and ids == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert back == hashlib.sha256(text.encode()).hexdigest()


def test_newer_code_points_are_looked_for_once_a_text():
    """The pattern of some 17,000 code points meets a text's distinct characters only, and none of texts without any."""
    own = bpe.ByteBpe(bpe.definition_at())
    last, first = "\U0003fc3f", "՘"
    assert own.has_newer(f"a{first}") and own.has_newer(f"{last}é") and not own.has_newer("aé’中") and not own.has_newer("plain")
    met = []

    class Counting:
        def search(self, text):
            met.append(len(text))

    own.newer = Counting()
    text = "é’" * 1000 + "naïve text " * 1000
    assert b"".join(own.encode(text)) and b"".join(own.encode("é" * 50))
    assert sum(met) <= len(set(text))
