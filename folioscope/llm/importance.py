"""Importance resampling towards a target corpus, through a dictionary of distinct n-grams.

Texts are read in chunks. A chunk's words are encoded by a dictionary of its own, so its runs of three
words are exact numbers; equal ones become one entry with the documents that have it and how often. A
run of one or two words is the beginning of a run of three (what follows a text's end counts as a word
of its own), so entries of three carry all features. Entries are dealt to owners by their words: an
owner puts the chunks' dictionaries together, counts every distinct string over all chunks and hashes it
once, the shorter beginnings on the way to the longer. What owners give are sums by bucket, and the
features of the documents as buckets with counts. The sums of source and target make the gains, a list of
``BUCKETS`` numbers, which are joined to the documents' features and summed up.

An entry goes to an owner as often as there are chunks that have it, however frequent it is, so no
owner is hot. Owners follow the bytes of the input. Counts and gains cover all rows and whole texts.

Of the documents with enough words, those with the highest scores (log-weight plus Gumbel noise that is
seeded by the id) are drawn; ranks come from ranges of the order, not from one task.

Defined cases: a null or wordless text has no features and weight 0; long texts are read in pieces that
share two words, a word of any length is one word; a null id is hashed as an empty one and comes last
among ties; repeated rows count and are scored like any other; an empty table, or an empty target, gives
defined gains and an empty draw; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import documents, durable, settings, tidy, utf8
from folioscope.scans import numbered

BUCKETS, SEED = 10_000, 42
LEAST_WORDS, PERCENT = 20, 5
#: Rows of an Arrow batch: blocks are some hundred kilobytes each.
ROWS = "32"
#: Bytes of text of a chunk, of a piece of a long text, and that make one more owner.
CHUNK, PIECE, OWNED = 4 << 20, 4 << 20, 16 << 20
#: Rounds in which owners are served: texts are read in each, and only its share of the entries is shuffled.
ROUNDS = 2

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_CODEC = pa.Codec("zstd", compression_level=3)
_POLY = 0xEDB88320
#: What stands for the end of a text among words.
END = b"!"


def word_edges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[b], [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A lowered text in pieces, and whether a piece is the last; the last two words of another one
    are the first two of the next."""
    at, size = 0, PIECE
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        starts, _ = word_edges(np.frombuffer(text, np.uint8, gap.start() - at, at))
        if len(starts) < 3:
            size *= 2
            continue
        yield text[at : gap.start()], False
        at, size = at + int(starts[-2]), PIECE
    yield text[at:], True


def chunk_runs(parts: list[tuple[int, bytes, bool]]) -> tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of parts (document's place, piece, last): the distinct words in ascending order, three columns of
    numbers of the runs that begin at each word, the documents' places, and the words of each part. The
    number of distinct words stands for the end of a text."""
    data = b"\n".join(p for _, p, _ in parts)
    b = np.frombuffer(data, np.uint8)
    start, end = word_edges(b)
    counts = np.diff(np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for _, p, _ in parts)])))
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    packed = b[_WORD[b]]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    found = words.dictionary.take(pa.array(order))
    one = place[words.indices.to_numpy()] if len(start) else place[:0]
    del start, end, offsets, packed, words
    runs = [one]
    last_word = np.zeros(len(one) + 1, bool)
    last_word[np.cumsum(counts)[counts > 0] - 1] = True
    stop = last_word[:-1]
    for k in (1, 2):
        column = np.append(one[k:], np.full(min(k, len(one)), len(found), np.int32))
        column[stop] = len(found)
        runs.append(column)
        stop = stop | np.append(stop[1:], np.zeros(min(1, len(one)), bool))
    docs = np.repeat(np.array([d for d, _, _ in parts], np.int32), counts)
    over = np.array([0 if last else 2 for _, _, last in parts])
    if over.any():
        # The last two words of a piece that isn't the last begin nothing here: the next piece has them.
        keep = np.ones(len(one), bool)
        for at in np.cumsum(counts)[over > 0].tolist():
            keep[at - 2 : at] = False
        runs, docs = [c[keep] for c in runs], docs[keep]
    return found, runs, docs, counts - over


def entry_order(runs: list[np.ndarray], n: int) -> np.ndarray:
    """The stable order of runs (three columns) whose numbers are n at most.

    Numbers are packed with their places, as sorting is much faster than finding an order.
    """
    size = len(runs[0])
    bits, at = int(n).bit_length(), max(size - 1, 1).bit_length()
    if max(2 * bits, at + bits) + at > 63:
        return np.lexsort(runs[::-1])
    mask = (1 << at) - 1
    packed = _packed(runs[0], bits, runs[1], at)
    packed.sort()
    pair = np.empty(size, np.int32)
    first = fresh(packed >> at)
    packed &= mask
    pair[packed] = np.cumsum(first, dtype=np.int32) - 1
    del packed, first
    packed = _packed(pair, bits, runs[2], at)
    packed.sort()
    packed &= mask
    return packed


def _packed(high: np.ndarray, bits: int, low: np.ndarray, at: int) -> np.ndarray:
    """Two numbers and the place in one, without more copies than needed."""
    out = high.astype(np.int64)
    out <<= bits
    out |= low
    out <<= at
    out |= np.arange(len(out))
    return out


def fresh(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def small_order(x: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers below a bound; two bytes are sorted by counting."""
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 byte by byte: high bytes are mostly zero and take no room."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


class Reader:
    """The other way: sections of an uncompressed block."""

    def __init__(self, block: bytes) -> None:
        size = int.from_bytes(block[:8], "little")
        self.data, self.at = _CODEC.decompress(block[8:], size, asbytes=True), 0

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def longs(self, n: int) -> np.ndarray:
        return np.frombuffer(self.raw(8 * n), "<i8")

    def numbers(self, n: int) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(self.raw(4 * n), np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def sealed(*sections: bytes) -> bytes:
    data = b"".join(sections)
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def word_bytes(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words' bytes one after the other, and where each begins and the last ends."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return (data.to_pybytes() if data is not None else b"")[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_list(words: pa.Array) -> list[bytes]:
    data, offsets = word_bytes(words)
    at = offsets.tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def word_keys(words: pa.Array) -> np.ndarray:
    """A number for each word that depends on its bytes only, and one for the end."""
    return np.array([*map(zlib.crc32, word_list(words)), 0x5BD1E995], np.uint64)


def owner_of(keys: np.ndarray, runs: list[np.ndarray], owners: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys[runs[0]]
        for column in runs[1:]:
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + keys[column]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)


def chunk_blocks(parts: list[tuple[int, bytes, bool]], rows: np.ndarray, owners: int, served: range | None = None) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """A chunk's entries as a block for each owner (or each served one) that has any, and the words of
    each document."""
    words, runs, doc, n_words = chunk_runs(parts)
    per_doc = np.bincount([d for d, _, _ in parts], weights=n_words, minlength=len(rows)).astype(np.int64)
    if not len(doc):
        return [], per_doc
    none = len(words)
    order = entry_order(runs, none)
    runs, doc = [c[order] for c in runs], doc[order]
    new = fresh(*runs)
    first = np.flatnonzero(new | fresh(doc))  # documents ascend within an entry
    times = np.diff(np.append(first, len(doc)))
    doc, entry = doc[first], (np.cumsum(new) - 1)[first]
    runs = [c[new] for c in runs]
    owner = owner_of(word_keys(words), runs, owners)
    by = small_order(owner, owners)
    runs = [c[by] for c in runs]
    cuts = np.searchsorted(owner[by], np.arange(owners + 1))
    held = np.bincount(entry, minlength=len(by))[by]
    posted = small_order(owner[entry], owners)
    doc, times = doc[posted], times[posted]
    ends = np.append(0, np.cumsum(held))
    spelled = pa.concat_arrays([pc.binary_join_element_wise(words, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary())), pa.array([END + b" "], pa.large_binary())])
    out = []
    for o in range(owners) if served is None else served:
        lo, hi = cuts[o], cuts[o + 1]
        if lo == hi:
            continue
        a, b, c = (x[lo:hi] for x in runs)
        # Runs are sorted, so each first word is written once and each second one once for it.
        one, two = fresh(a), fresh(a, b)
        text = [word_bytes(spelled.take(pa.array(x)))[0] for x in (a[one], b[two], c)]
        mine = doc[ends[lo] : ends[hi]]
        docs = np.flatnonzero(np.bincount(mine, minlength=len(rows)))
        slot = np.searchsorted(docs, mine)
        head = np.array([rows[0], *map(len, text), int(one.sum()), int(two.sum()), hi - lo, len(mine), len(docs)], "<i8")
        sizes = [np.diff(np.append(np.flatnonzero(one[two]), int(two.sum()))), np.diff(np.append(np.flatnonzero(two), hi - lo))]
        out.append((o, sealed(head.tobytes(), *text, *map(planes, sizes), planes(held[lo:hi]), rows[docs].astype("<i8").tobytes(), planes(slot), planes(times[ends[lo] : ends[hi]]))))
    return out, per_doc


def token_array(text: bytes) -> pa.DictionaryArray:
    """Words that are followed by a space each, encoded."""
    b = np.frombuffer(text, np.uint8)
    space = np.flatnonzero(b == 32)
    offsets = np.append(0, space + 1 - np.arange(1, len(space) + 1)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(space), [None, pa.py_buffer(offsets), pa.py_buffer(b[b != 32])]).dictionary_encode()


@lru_cache(4096)
def _crc_tables(length: int) -> np.ndarray:
    """Tables that carry a CRC-32 over so many further zero bytes, one for each of its bytes."""

    def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        out = np.zeros_like(vector)
        for bit in range(32):
            out ^= np.where((vector >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
        return out

    step = np.array([_POLY, *[1 << i for i in range(31)]], np.uint32)  # one zero bit
    power, whole = 8 * length, (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    while power:
        if power & 1:
            whole = times(step, whole)
        step, power = times(step, step), power >> 1
    every = np.arange(256, dtype=np.uint32)
    return np.stack([times(whole, every << np.uint32(8 * k)) for k in range(4)])


def crc_tables(lengths: np.ndarray) -> np.ndarray:
    return np.stack([_crc_tables(n) for n in lengths.tolist()])


def crc_join(tables: np.ndarray, first: np.ndarray, second: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """CRC-32 of two texts one after the other, from those of both; kind says which of the tables is
    for the second one's length."""
    out, flat = second.copy(), tables.ravel()
    for lo in range(0, len(out), 1 << 17):
        here = slice(lo, lo + (1 << 17))
        base, x = kind[here].astype(np.int64) * 1024, first[here]
        for k in range(4):
            out[here] ^= flat[base + (256 * k + ((x >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64))]
    return out


def entry_buckets(words: list[bytes], runs: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    """Three columns: the buckets of the strings of one to three words that entries (distinct, sorted)
    begin with; ``buckets`` where there is no such string. Each distinct string is hashed once."""
    none, size = len(words), np.uint32(buckets)
    alone = np.array([*map(zlib.crc32, words), 0], np.uint32)
    spaced = np.array([*(zlib.crc32(b" " + w) for w in words), 0], np.uint32)
    length = np.array([*(len(w) + 1 for w in words), 0], np.int64)
    kinds, kind = np.unique(length, return_inverse=True)
    tables, kind = crc_tables(kinds), kind.astype(np.int32)
    one = (alone % size).astype(np.int32)[runs[0]]
    pair = fresh(runs[0], runs[1])
    a, b = runs[0][pair], runs[1][pair]
    crc2 = crc_join(tables, alone[a], spaced[b], kind[b])
    of = np.cumsum(pair, dtype=np.int32) - 1
    two = np.where(b < none, (crc2 % size).astype(np.int32), np.int32(buckets))[of]
    c = runs[2]
    crc3 = crc_join(tables, crc2[of], spaced[c], kind[c])
    return [one, two, np.where(c < none, (crc3 % size).astype(np.int32), np.int32(buckets))]


def owned(blocks: list[bytes], buckets: int, postings: bool) -> tuple[np.ndarray, list[bytes]]:
    """Sums by bucket of what an owner holds, and for each block the features of its documents: bucket
    and how often, in order of document and bucket."""
    held, spelled = [], []
    while blocks:  # taken one by one, so that what is read goes as the rest comes
        r = Reader(blocks.pop())
        chunk, *text, n_one, n_two, n, n_posted, n_docs = r.longs(9).tolist()
        tokens = token_array(r.raw(sum(text)))
        spelled.append(tokens.dictionary)
        one, two = (r.numbers(k).astype(np.int32) for k in (n_one, n_two))
        sizes, rows, slot, times = r.numbers(n).astype(np.int32), r.longs(n_docs).copy(), r.numbers(n_posted).astype(np.int32), r.numbers(n_posted).astype(np.int32)
        held.append((tokens.indices.to_numpy(), one, two, sizes, rows, slot, times, chunk))
    every = pa.concat_arrays(spelled).dictionary_encode()
    number, words, none = every.indices.to_numpy(), every.dictionary, len(every.dictionary)
    end = pc.index(words, END).as_py()
    if end >= 0:  # the end of a text stands last
        swap = np.arange(none, dtype=np.int32)
        swap[[end, none - 1]] = none - 1, end
        number, words, none = swap[number], words.take(pa.array(swap[: none - 1])), none - 1
    total, at, word = sum(len(h[3]) for h in held), 0, 0
    runs, counts = [np.empty(total, np.int32) for _ in range(3)], np.empty(total, np.int32)
    for k, (tokens, one, two, sizes, rows, slot, times, chunk) in enumerate(held):
        mine = number[word : word + len(spelled[k])][tokens]
        word += len(spelled[k])
        here = slice(at, at + len(sizes))
        at += len(sizes)
        runs[0][here] = np.repeat(np.repeat(mine[: len(one)], one), two)
        runs[1][here] = np.repeat(mine[len(one) : len(one) + len(two)], two)
        runs[2][here] = mine[len(one) + len(two) :]
        counts[here] = np.add.reduceat(times, np.cumsum(sizes) - sizes)
        held[k] = sizes, rows, slot, times, chunk
    del every, number, spelled
    order = entry_order(runs, none)
    for k in range(3):
        runs[k] = runs[k][order]
    new = fresh(*runs)
    totals = np.add.reduceat(counts[order], np.flatnonzero(new), dtype=np.int64)
    del counts
    for k in range(3):
        runs[k] = runs[k][new]
    found = entry_buckets(word_list(words), runs, buckets)
    sums = np.zeros(buckets + 1, np.int64)
    for column in found:
        np.add.at(sums, column, totals)
    if not postings:
        return sums[:buckets], []
    own = np.empty(len(order), np.int32)
    own[order] = np.cumsum(new, dtype=np.int32) - 1
    del order, runs, new, totals
    out, at = [], 0
    for sizes, rows, slot, times, chunk in held:
        entry = np.repeat(own[at : at + len(sizes)], sizes)
        at += len(sizes)
        bucket = np.concatenate([column[entry] for column in found])
        slots, n = np.tile(slot, 3), np.tile(times, 3)
        there = bucket < buckets
        bucket, slots, n = bucket[there], slots[there], n[there]
        by = small_order(bucket, buckets)
        by = by[small_order(slots[by], len(rows))]
        bucket, slots = bucket[by], slots[by]
        first = np.flatnonzero(fresh(slots, bucket))
        n, bucket, slots = np.add.reduceat(n[by], first), bucket[first], slots[first]
        # Buckets ascend in a document, so most steps are small.
        step = np.where(fresh(slots), bucket, np.diff(bucket, prepend=0))
        each = np.bincount(slots, minlength=len(rows))
        out.append(sealed(np.array([chunk, len(rows), len(step)], "<i8").tobytes(), rows.tobytes(), planes(each), planes(step), planes(n)))
    return sums[:buckets], out


def joined(block: bytes, gains: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A block's chunk (its first document's row), rows and the weights that the features add to them."""
    r = Reader(block)
    chunk, n_docs, n = r.longs(3).tolist()
    rows, each = r.longs(n_docs), r.numbers(n_docs)
    step, times = r.numbers(n), r.numbers(n)
    ends = np.cumsum(each)
    bucket = np.append(0, np.cumsum(step))
    bucket = bucket[1:] - np.repeat(bucket[ends - each], each)
    return chunk, rows, np.diff(np.append(0, np.cumsum(gains[bucket] * times))[np.append(0, ends)])


def dictionary(texts: DataFrame, buckets: int = BUCKETS, postings: bool = True, owners: int | None = None) -> DataFrame:
    """texts (row, id as a string, body) as owners leave them, written round by round: rows (row, id, n_words)
    of the documents, a row with the sums of each owner, and, with postings, rows with the blocks."""
    if owners is None:
        owners = max(1, -(-int(texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // OWNED))
    rounds = max(1, min(ROUNDS, owners))

    def dealt(served: range) -> DataFrame:
        """The entries of some owners, each in a partition of its own. The first round brings the documents."""
        first = served.start == 0

        def flushed(parts, rows, ids):
            blocks, n_words = chunk_blocks(parts, np.array(rows, np.int64), owners, served)
            if blocks:
                yield pd.DataFrame({"owner": [o - served.start for o, _ in blocks], "row": None, "id": None, "n_words": None, "block": [b for _, b in blocks]})
            if rows and first:
                yield pd.DataFrame({"owner": np.array(rows) % len(served), "row": rows, "id": pd.Series(ids, dtype=object), "n_words": n_words, "block": None})

        def chunks(batches):
            parts, rows, ids, size = [], [], [], 0
            for b in batches:
                for row, id_, text in zip(b["row"].tolist(), b["id"].tolist(), utf8(b["body"].tolist()), strict=True):
                    rows.append(row)
                    ids.append(id_)
                    for piece, last in pieces(text.lower()):
                        parts.append((len(rows) - 1, piece, last))
                        size += len(piece)
                        if size >= CHUNK:
                            yield from flushed(parts, rows, ids)
                            # The rest of a long text adds its words to the same row, whose id is known already.
                            parts, rows, ids, size = [], [] if last else [row], [] if last else [None], 0
            yield from flushed(parts, rows, ids)

        return texts.mapInPandas(tidy(chunks), "owner int, row bigint, id string, n_words bigint, block binary").repartitionById(len(served), F.col("owner"))

    def merged(batches):
        blocks = []
        for b in batches:
            is_block = b["row"].isna()
            blocks += [bytes(x) for x in b.loc[is_block, "block"]]
            rest = b[~is_block]
            if len(rest):
                yield pd.DataFrame({"row": rest["row"], "id": rest["id"], "n_words": rest["n_words"], "sums": None, "hashed": None})
        if blocks:
            sums, hashed = owned(blocks, buckets, postings)
            yield pd.DataFrame({"row": [None], "id": None, "n_words": None, "sums": [sums], "hashed": None})
            for at in range(0, len(hashed), 16):
                yield pd.DataFrame({"row": None, "id": None, "n_words": None, "sums": None, "hashed": hashed[at : at + 16]})

    out = None
    for k in range(rounds):
        made = dealt(range(owners * k // rounds, owners * (k + 1) // rounds)).mapInPandas(tidy(merged), "row bigint, id string, n_words bigint, sums array<bigint>, hashed binary")
        made = durable(made, "importance-owned")
        out = made if out is None else out.unionByName(made)
    return out


def bucket_sums(made: DataFrame) -> DataFrame:
    """(bucket, n) of all owners, buckets without a feature left out."""
    return made.where("sums IS NOT NULL").select(F.posexplode("sums").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: a list of ``buckets`` numbers."""
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    every = every.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    both = every.crossJoin(F.broadcast(every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return [r["gain"] for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def _scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, buckets: int, seed: int, owners: int | None, stable: bool) -> DataFrame:
    """(row, id, n_words, n_features, weight, score) of all documents, written."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("body"))
    made = dictionary(texts if stable else durable(texts, "importance-texts"), buckets, True, owners)
    aims = dictionary(target.select(F.lit(0).cast("bigint").alias("row"), F.lit(None).cast("string").alias("id"), F.col(target_col).alias("body")), buckets, False, owners)
    gains = np.array(gains_of(bucket_sums(made), bucket_sums(aims), buckets), np.int64)

    def run(batches):
        for b in batches:
            found = [joined(bytes(block), gains) for block in b["hashed"]]
            yield pd.DataFrame({"chunk": [c for c, _, _ in found], "rows": [r.tobytes() for _, r, _ in found], "weights": [w.tobytes() for _, _, w in found]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        rows, weights = (np.frombuffer(b"".join(map(bytes, part[c])), "<i8") for c in ("rows", "weights"))
        row, place = np.unique(rows, return_inverse=True)
        weight = np.zeros(len(row), np.int64)
        np.add.at(weight, place, weights)
        return pd.DataFrame({"row": row, "weight": weight})

    # A chunk's documents meet in one task as arrays, one for each owner.
    parts = made.where("hashed IS NOT NULL").select("hashed").mapInPandas(tidy(run), "chunk bigint, rows binary, weights binary")
    weights = parts.groupBy("chunk").applyInPandas(summed, "row bigint, weight bigint")
    kind = docs.schema[id_col].dataType.simpleString()
    # A row's id came as text, once.
    own = made.where("row IS NOT NULL").select("row", "id", "n_words", F.lit(0).cast("bigint").alias("weight"))
    every = own.unionByName(weights.select("row", F.lit(None).cast("string").alias("id"), F.lit(0).cast("bigint").alias("n_words"), "weight"))
    each = every.groupBy("row").agg(F.max("id").cast(kind).alias("id"), F.sum("n_words").alias("n_words"), F.sum("weight").alias("weight"))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    n = F.col("n_words")
    features = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    return durable(each.select("row", "id", "n_words", features.alias("n_features"), "weight", (F.col("weight") + noise).alias("score")), "importance-scored")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, owners: int | None = None, stable: bool = False) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null if not drawn).

    Texts are read once a round and told apart by their place, so they are written first unless they are
    ``stable``: a table that is read alike each time.
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=ROWS):
        scored = _scored(docs, target, id_col, text_col, target_col, buckets, seed, owners, stable)
    enough = scored.where(F.col("n_words") >= least)
    draw = enough.count() * percent // 100
    placed = numbered(enough, [], [F.desc("score"), F.asc_nulls_last("id"), F.col("row")], "place").withColumn("rank", F.when(F.col("place") <= draw, F.col("place")))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint"))
    out = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return placed.select(*out).unionByName(rest.select(*out))


def op12(spark, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), stable=True)
