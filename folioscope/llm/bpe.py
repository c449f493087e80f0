"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Merges are applied to a buffer as the merge list says (lowest rank first, leftmost on ties). What
follows the buffer can change its tokens only near its end: the known part ends at a token
boundary, and a rule (u, v) moves that boundary back by u only if u ends there and the unknown
token after it may be v. Since that token starts with whatever was given back before, the distance
is bounded over chains of rules of rising rank, which ``lookahead`` computes from the merge list.
Tokens that end that far before the buffer's end are stable and are emitted at once, so a word of
any length needs one buffer of fixed size. Decoding feeds token bytes to an incremental UTF-8
decoder.

Text is cut into words by the pre-tokenizer's pattern first, after strings of special tokens. A word
never holds white space behind anything else, so the pattern is matched in blocks that end there,
and every word goes through the transducer; what it emitted for short words is remembered.

Defined cases: a null text counts as empty and has no tokens; null ids and repeated rows are encoded
like any other; a text of any length takes one block and one buffer at a time beside itself and its
ids, also if it is one word; an empty table gives an empty result; other columns are passed on, but
the output column replaces one of its name.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import documents

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that the regex module counts as letters or numbers and the tokenizers
#: library, with its older Unicode tables, does not.
NEWER = (
    r"\U00000558\U0000058B-\U0000058C\U0000088F\U00000C5C\U00000CDC\U0000208F\U0000209D-\U0000209F\U0000A7CE-\U0000A7CF\U0000A7D2\U0000A7D4\U0000A7DD\U0000A7E2\U0000A7F1"
    r"\U0000AB6C-\U0000AB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1"
    r"\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81"
    r"\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
STRICT = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{NEWER}]]+| ?[\p{{N}}--[{NEWER}]]+| ?(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])+|\s+(?!\S)|\s+"
_NONE = 1 << 30
_BUFFER = 2048
#: Words kept in each of two generations of the cache.
_CACHE = 125_000
_BLOCK = 1 << 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes before a buffer's end within which later text may still change tokens."""
    best: dict[bytes, int] = {}
    most = 0
    for left, right in rules:
        back = len(left) + max((best.get(right[:n], 0) for n in range(1, len(right) + 1)), default=0)
        best[left] = max(best.get(left, 0), back)
        most = max(most, back)
    return most


class ByteBpe:
    def __init__(self, definition: str, buffer: int = _BUFFER) -> None:
        model = json.loads(definition)
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = np.full(size, b"", object)
        for text, number in vocab.items():
            self.token[number] = bytes(back[c] for c in text)
        for text, number in self.special.items():
            self.token[number] = text.encode()
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.result = [vocab[a + b] for a, b in pairs]
        self.byte = [vocab[c] for c in letters]
        self.lookahead = lookahead([(self.token[vocab[a]], self.token[vocab[b]]) for a, b in pairs])
        self.buffer = max(buffer, 2 * self.lookahead)
        self.words, self.strict, self.newer = regex.compile(PATTERN), regex.compile(STRICT), regex.compile(f"[{NEWER}]")
        # The least to the last of the newer code points, which most texts have none between.
        self.high = re.compile("[\u0558-\U0003fc3f]")
        self.edge = regex.compile(r"\S(?=\s)")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a buffer."""
        ids = list(map(self.byte.__getitem__, data))
        get, result = self.rank.get, self.result
        ranks = list(map(get, zip(ids, ids[1:]), repeat(_NONE)))
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = new = result[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), _NONE)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), _NONE)
        return ids

    def stream(self, chunks: Iterator[bytes]) -> Iterator[list[int]]:
        """Tokens of one word that comes in chunks, emitted once stable."""
        rest = b""
        for chunk in chunks:
            rest += chunk
            while len(rest) >= self.buffer:
                ids, stable, size = self.merged(rest[: self.buffer]), [], 0
                for i in ids:
                    if size + len(self.token[i]) > self.buffer - self.lookahead:
                        break
                    stable.append(i)
                    size += len(self.token[i])
                yield stable
                rest = rest[size:]
        if rest:
            yield self.merged(rest)

    def word(self, text: str) -> bytes:
        """The ids of a word as little-endian 32-bit numbers."""
        found = self.new.get(text)
        if found is not None:
            return found
        found = self.old.get(text)
        if found is None:
            data = text.encode()
            chunks = (data,) if len(data) <= self.buffer else (data[at : at + self.buffer] for at in range(0, len(data), self.buffer))
            found = b"".join([struct.pack(f"<{len(part)}I", *part) for part in self.stream(chunks)])
            if len(data) > 64:
                return found
        if len(self.new) >= _CACHE:
            self.old, self.new = self.new, {}
        self.new[text] = found
        return found

    def blocks(self, text: str) -> Iterator[str]:
        """The text in pieces that end before white space, where a word ends in any case."""
        at = 0
        while len(text) - at > 2 * _BLOCK and (edge := self.edge.search(text, at + _BLOCK)):
            yield text[at : edge.end()]
            at = edge.end()
        yield text[at:] if at else text

    def has_newer(self, text: str) -> bool:
        """Whether a text has newer code points, which are looked for among its distinct ones."""
        return not text.isascii() and self.high.search(text) is not None and self.newer.search("".join(set(text))) is not None

    def _plain(self, text: str) -> Iterator[bytes]:
        pattern = self.strict if self.has_newer(text) else self.words
        for block in self.blocks(text):
            words = pattern.findall(block)
            out = list(map(self.new.get, words))
            if None in out:
                out = [self.word(w) if x is None else x for w, x in zip(words, out, strict=True)]
            yield b"".join(out)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids in pieces, as little-endian 32-bit numbers."""
        if self.specials is None or not any(s in text for s in self.special):
            yield from self._plain(text)
            return
        for part in self.specials.split(text):
            if part in self.special:
                yield np.array([self.special[part]], "<u4").tobytes()
            elif part:
                yield from self._plain(part)

    def decode(self, pieces: Iterator[bytes]) -> Iterator[str]:
        """Text in pieces; bytes that are not UTF-8 become replacement characters."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield state.decode(b"".join(self.token[np.frombuffer(ids, "<u4")]))
        yield state.decode(b"", True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Tokens, SHA-256 of the ids and of the decoded text."""
        count, ids, back = 0, hashlib.sha256(), hashlib.sha256()

        def counted() -> Iterator[bytes]:
            nonlocal count
            for piece in self.encode(text):
                count += len(piece) // 4
                ids.update(piece)
                yield piece

        for part in self.decode(counted()):
            back.update(part.encode())
        return count, ids.hexdigest(), back.hexdigest()


_ready: dict[int, ByteBpe] = {}


def tokenizer(definition: str) -> ByteBpe:
    """The tokenizer of a definition, built once in each Python worker."""
    key = hash(definition)
    if key not in _ready:
        _ready.clear()
        _ready[key] = ByteBpe(definition)
    return _ready[key]


def definition_at(path: str | None = None) -> str:
    """The tokenizer's definition; the driver reads it and sends it along (a few MB at most)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_column(docs: DataFrame, path: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of docs, and the ids of the text as array<int>."""
    shipped = docs.sparkSession.sparkContext.broadcast(definition_at(path))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = tokenizer(shipped.value)
        return pd.Series([np.frombuffer(b"".join(own.encode(t or "")), "<u4").astype(np.int32) for t in texts])

    return docs.withColumn(out, ids(F.col(text_col)))


def decode_column(docs: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of docs, and the text of the ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(definition_at(path))

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        own = tokenizer(shipped.value)
        return pd.Series(["".join(own.decode(iter([np.asarray([] if i is None else i, "<u4").tobytes()]))) for i in ids])

    return docs.withColumn(out, texts(F.col(ids_col)))


def token_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256."""
    shipped = docs.sparkSession.sparkContext.broadcast(definition_at(path))

    def run(batches):
        own = tokenizer(shipped.value)
        for b in batches:
            found = [own.digest(t or "") for t in b["body"].tolist()]
            yield pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(id=b["id"].values)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInPandas(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op8(spark, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
