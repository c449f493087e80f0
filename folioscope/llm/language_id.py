"""Language identification by nearest centroids of TF-IDF character n-grams.

A text's vector holds hashed counts of the 1-, 2- and 3-grams of its lower-case letters (anything
else is a space), damped by a logarithm, weighted by inverse document frequency over all training
documents and normalised. Each language has several centroids, clustered by spherical k-means on
about ``SAMPLE`` of its documents, drawn by a hash of id and text; one task clusters one language. A text gets the language
of the centroid nearest by cosine. It is also told apart as rejected where the cosine is below what
nearly all of that centroid's own members have.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
nothing could be learned; documents of null language are not learned from; equal cosines go to the
first language in order; a null id counts as the empty text in the split; rows that repeat an id and
a text count for the document frequencies as often as they occur, are clustered once and predicted
alike; a text of any length is counted piece by piece; an empty table gives an empty result; other
columns are not looked at, whatever their names. Nothing but the text is an input of a prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import documents, durable, small

DIMS = 8192
CLUSTERS = 4
#: About so many documents of each language are clustered.
SAMPLE = 1000
ROUNDS = 8
_CHUNK = 256
_PIECE = 1 << 18
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of one text, ``_PIECE`` characters at a time."""
    out = np.zeros(DIMS, np.int64)
    held = np.zeros(0, np.uint32)  # the last two characters so far
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate([held, np.where(letter_table()[c], c, np.uint32(32))])
        c = np.concatenate([c[:1], c[1:][(c[1:] != 32) | (c[:-1] != 32)]])
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
        new = len(held)
        every = np.concatenate([c[new:] * np.uint32(0xC2B2AE3D), two[max(0, new - 1) :] * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
        out += np.bincount((every ^ (every >> np.uint32(15))) & np.uint32(DIMS - 1), minlength=DIMS)
        held = c[-2:]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, one row a text."""
    x = np.log1p(np.stack([counts(t) for t in texts])).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means from far-apart first members, and each one's lowest cosine
    but for the last hundredth of its members."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    centre = x[start]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    cosine = x @ centre.T
    own = np.argmax(cosine, axis=1)
    floor = np.array([np.quantile(cosine[own == j, j], 0.01) if (own == j).any() else 1.0 for j in range(len(centre))])
    return centre, floor


def fit(training: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> dict | None:
    """Centroids from (id, body, lang); every training document counts for the IDF."""

    def gather(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b["body"].tolist():
                if has_letter(t):
                    seen += counts(t) > 0
                    n += 1
        yield pd.DataFrame({"dim": np.append(np.arange(DIMS), -1), "n": np.append(seen, n)})

    sums = training.select("body").mapInPandas(gather, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    found = {r["dim"]: r["n"] for r in sums}
    total = found.get(-1, 0)
    if not total:
        return None
    df = np.array([found.get(d, 0) for d in range(DIMS)])
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)
    per_lang = durable(training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    place = F.pmod(F.xxhash64("id", "body", F.lit("language sample")), F.lit(1 << 30))
    drawn = training.join(small(per_lang), "lang").where(place < F.lit(sample) / F.col("n") * (1 << 30)).select("id", "body", "lang").distinct()
    shipped = training.sparkSession.sparkContext.broadcast(idf)

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "body"], kind="stable")
        texts = [t for t in group["body"] if has_letter(t)]
        if not texts:
            # Columns of objects: Arrow takes an empty list for numbers.
            return pd.DataFrame({"lang": [], "centre": [], "floor": []}, dtype=object)
        x = np.concatenate([vectors(texts[i : i + _CHUNK], shipped.value) for i in range(0, len(texts), _CHUNK)])
        centre, floor = cluster(x, clusters)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": list(centre.astype(np.float32)), "floor": floor})

    rows = drawn.groupBy("lang").applyInPandas(clustered, "lang string, centre array<float>, floor double").collect()  # languages times clusters
    rows.sort(key=lambda r: (r["lang"], tuple(r["centre"])))
    if not rows:
        return None
    return {"idf": idf, "lang": [r["lang"] for r in rows], "centre": np.array([r["centre"] for r in rows], np.float32), "floor": np.array([r["floor"] for r in rows])}


def predict(docs: DataFrame, model: dict | None, columns: list[Column]) -> DataFrame:
    """columns (named), lang_pred, score and rejected for the text in column body."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for b in batches:
            texts = b["body"].tolist()
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            usable = [i for i, t in enumerate(texts) if own and has_letter(t)]
            for at in range(0, len(usable), _CHUNK):
                part = usable[at : at + _CHUNK]
                cosine = vectors([texts[i] for i in part], own["idf"]) @ own["centre"].T
                best = np.argmax(cosine, axis=1)
                for i, j, c in zip(part, best.tolist(), cosine[np.arange(len(part)), best].tolist(), strict=True):
                    lang[i], score[i], rejected[i] = own["lang"][j], min(1.0, max(0.0, c)), c < own["floor"][j]
            yield b.drop(columns="body").assign(lang_pred=lang, score=score, rejected=rejected)

    rows = docs.select(*columns, "body")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")
    return rows.mapInPandas(run, f"{schema}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from all but one fold, predict every document: id, held_out, lang_pred, score, rejected."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang"), fold.alias("held_out"))
    model = fit(rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select("id", "body", "lang"))
    return predict(rows, model, [F.col("id"), F.col("held_out")]).withColumnRenamed("id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
