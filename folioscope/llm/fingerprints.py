"""Bottom-k sketches of shingle hashes as document fingerprints.

A sketch holds the k smallest distinct 48-bit hashes of a text's word shingles. The sketch of a
union is the k smallest of the sketches' hashes, so parts of a document or of a corpus can be
sketched apart and merged. Two sketches estimate resemblance from the k smallest hashes of their
union, and with the counts of distinct shingles ((k - 1) / k-th smallest hash; exact below k) also
containment.

Defined cases: null and empty texts have the empty sketch, alike 1.0 to each other and 0.0 to any
other; a text with fewer words than a shingle is one shingle; documents of equal id are ordered
by a hash of their text, so repeated rows follow each other; a null id comes last, as the least
64-bit number would; the only document is its own successor; a text of any length is hashed piece
by piece; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from folioscope.llm.runtime import documents, durable, spread_join, utf8
from folioscope.llm.words import shingles, word_hashes
from folioscope.scans import numbered

K = 128
SHINGLE = 5
BITS = 48
#: Documents drawn for each run to find where runs begin.
DRAWN = 20
#: Rows of one output row that stands for equal ones.
_TIMES = 1000
#: Stands for a null id; as an id of its own it would count as null.
_LEAST = -(1 << 63)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, cut to 48 bits."""
    return np.unique(hashes >> np.uint64(64 - BITS))[:k]


def merge(*parts: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what the parts stand for."""
    return reduce(np.union1d, parts, np.zeros(0, np.uint64))[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**BITS / float(s[k - 1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of the union's shingles that both have."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k=k)
    return float(len(np.intersect1d(np.intersect1d(both, a, True), b, True)) / len(both))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    both = merge(a, b, k=k)
    return min(1.0, resemblance(a, b, k) * distinct(both, k) / distinct(a, k))


def pack(s: np.ndarray) -> str:
    """A sketch as text: six big-endian bytes a hash, in base 64."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def sketches(texts: list[bytes], k: int = K, width: int = SHINGLE) -> list[np.ndarray]:
    return [sketch(shingles(w, width), k) for w in word_hashes(texts)]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = SHINGLE) -> DataFrame:
    """One row per document: id, fingerprint, n_distinct (estimated)."""

    def run(batches):
        for b in batches:
            found = sketches(utf8(b["body"].tolist()), k, width)
            yield pd.DataFrame({"id": b["id"], "fingerprint": [pack(s) for s in found], "n_distinct": [distinct(s, k) for s in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInPandas(run, f"id {kind}, fingerprint string, n_distinct double").withColumnRenamed("id", id_col)


def run_starts(keys: DataFrame, runs: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], tuple[int, int] | None]:
    """Where runs of documents in descending (id, tie) begin: the first key of each run but run 0, the
    keys that are so frequent that they would begin several, and the largest key.

    They are documents' keys from a sample of about ``DRAWN`` a run, so any ids give even runs; the
    result doesn't depend on which are drawn.
    """
    whole = keys.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "tie")).alias("top")).first()
    if not whole["n"]:
        return [], [], None
    share = min(1.0, DRAWN * runs / whole["n"])
    drawn = sorted((tuple(r) for r in keys.sample(share, 7).collect()), reverse=True)  # DRAWN * runs rows
    at = drawn[DRAWN::DRAWN][: runs - 1]
    top = tuple(whole["top"])
    return sorted({k for k in at if k != top}, reverse=True), sorted({a for a, b in zip(at, at[1:], strict=False) if a == b}), top


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = SHINGLE, runs: int | None = None) -> DataFrame:
    """One row per document, with its fingerprint, that of its edited text and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next
    document in descending id. Documents are dealt to as many runs of neighbours as there are shuffle
    partitions (or ``runs``), each sorted and streamed by one task. A run's last document meets the
    first of the next run, which is sent there too; so texts are shuffled once. Ids that aren't whole
    numbers are ordered by their own type's order: their places in it take part instead.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return _by_place(docs, id_col, text_col, k, width, runs)
    runs = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("id")
    rows = docs.select(number, F.coalesce(F.col(text_col), F.lit("")).alias("body")).select("id", F.xxhash64("body").alias("tie"), "body")
    starts, frequent, top = run_starts(rows.select("id", "tie"), runs)
    ids, ties = (np.array([s[i] for s in reversed(starts)], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def run_of(i: pd.Series, t: pd.Series) -> pd.Series:
        i, t = i.to_numpy(np.int64), t.to_numpy(np.int64)
        before, until = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
        for at in np.unique(before[until > before]).tolist():
            same = (before == at) & (until > at)
            before[same] += np.searchsorted(ties[at : until[same][0]], t[same], "left")
        return pd.Series(len(ids) - before).astype("int32")

    key = "id bigint, tie bigint"
    often = F.broadcast(spark.createDataFrame(frequent, key))  # a row a run at most
    # Rows that repeat one id and text very often are one row with their number.
    once = rows.join(often, ["id", "tie"], "left_anti").withColumn("n", F.lit(1).cast("bigint")) if frequent else rows.withColumn("n", F.lit(1).cast("bigint"))
    if frequent:
        once = once.unionByName(rows.join(often, ["id", "tie"], "left_semi").groupBy("id", "tie", "body").agg(F.count(F.lit(1)).alias("n")))
    dealt = once.select(run_of("id", "tie").alias("run"), F.lit(False).alias("tail"), "id", "tie", "body", "n")
    following = [(*s, n) for n, s in enumerate(starts)] + ([(*top, len(starts))] if top else [])
    wanted = F.broadcast(spark.createDataFrame(following, f"{key}, run int"))
    tails = rows.join(wanted, ["id", "tie"]).groupBy("run", "id", "tie").agg(F.max("body").alias("body"))
    every = dealt.unionByName(tails.select("run", F.lit(True).alias("tail"), "id", "tie", "body", F.lit(1).cast("bigint").alias("n")))
    ordered = every.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "tail", F.desc("id"), F.desc("tie"), F.desc("body"))

    def streamed(batches):
        held = []  # the last document so far, whose successor comes in the next batch
        for b in batches:
            texts = b["body"].tolist()
            new = list(zip(b["id"].tolist(), texts, sketches(utf8(texts), k, width), b["n"].tolist(), b["tail"].tolist(), strict=True))
            pairs = []
            for own, after in zip([*held, *new], [*held, *new][1:], strict=False):
                if own[4]:
                    continue
                left = own[3] - 1
                pairs += [(own, own, min(_TIMES, left - at)) for at in range(0, left, _TIMES)]
                pairs.append((own, after, 1))
            held = new[-1:]
            if pairs:
                yield paired(pairs)

    def paired(pairs):
        edited = utf8([a[1][: len(a[1]) - len(a[1]) // 2] + z[1][: len(a[1]) // 2] for a, z, _ in pairs])
        theirs = sketches(edited, k, width)
        return pd.DataFrame(
            {
                "id": [a[0] for a, _, _ in pairs],
                "n_chars": [len(a[1]) for a, _, _ in pairs],
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
                "fingerprint": [pack(a[2]) for a, _, _ in pairs],
                "edited_fingerprint": [pack(t) for t in theirs],
                "near_edited": [resemblance(a[2], t, k) for (a, _, _), t in zip(pairs, theirs, strict=True)],
                "near_next": [resemblance(a[2], z[2], k) for a, z, _ in pairs],
                "times": [n for _, _, n in pairs],
            }
        )

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times int"
    found = ordered.select("id", "body", "n", "tail").mapInPandas(streamed, schema)
    if frequent:
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return found.select(F.when(F.col("id") != _LEAST, F.col("id")).cast(docs.schema[id_col].dataType).alias(id_col), *schema_names(schema))


def _by_place(docs: DataFrame, id_col: str, text_col: str, k: int, width: int, runs: int | None) -> DataFrame:
    """edited_fingerprints of documents whose ids are texts or other values: by their places in order."""
    sizes = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("weight"))
    places = durable(numbered(sizes, [], [F.col("id")], "place"), "fingerprint-places")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    placed = spread_join(rows.where("id IS NOT NULL"), places, ["id"], "weight").select("place", "body")
    found = edited_fingerprints(placed.unionByName(rows.where("id IS NULL").select(F.lit(None).cast("bigint").alias("place"), "body")), "place", "body", k, width, runs)
    named = spread_join(found.where("place IS NOT NULL"), places, ["place"], "weight").drop("place")
    unnamed = found.where("place IS NULL").drop("place").withColumn("id", F.lit(None).cast(docs.schema[id_col].dataType))
    return named.unionByName(unnamed).select(F.col("id").alias(id_col), *[c for c in found.columns if c != "place"])


def schema_names(schema: str) -> list[str]:
    """Names of the columns between the first and the last."""
    return [c.split()[0] for c in schema.split(", ")[1:-1]]


def op10(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
