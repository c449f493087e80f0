"""Text quality from weak labels: EM over overlapping heuristics, then a hashed linear scorer.

Each labelling heuristic votes bad (-1), good (1) or not at all (0). The table of vote patterns,
counted over all documents, is all that expectation-maximisation needs: it estimates the share of
good documents and how each heuristic votes on good and on bad ones, and gives each pattern its
posterior. A logistic scorer over hashed words and word shapes is then trained on the posteriors
of a sample of about ``SAMPLE`` different documents, drawn by a hash of id and text, and scores
every document; it generalises beyond the heuristics and is what decides. The sample's rows are the
scorer's labelled rows, with labels by EM, and its size is the documented bound of fitting; the
vote patterns that the labels come from are counted over all documents.

Defined cases: a null text counts as empty; a text without words scores 0 and is rejected; rows that
repeat an id and a text are counted as often as they occur, drawn together and train the scorer
once; null ids are drawn by their text; ties don't occur, as a score decides for itself; a table
from which nothing can be learned keeps every document that has words; a text of any length is
hashed piece by piece; an empty table gives an empty result; other columns are passed on or not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.runtime import documents, tidy, utf8
from folioscope.llm.words import word_hashes

DIMS = 1 << 15
#: About so many documents train the scorer.
SAMPLE = 8000
#: A document goes if the scorer holds it bad at seven to three or more.
KEEP = 0.3
EPOCHS = 6
#: Prior of the share of good documents that a heuristic calls bad, and its weight in documents for each
#: document there is.
WRONG, TRUST = 0.003, 0.1
#: Frequent short words of some languages; a fixed list.
COMMON = frozenset(b"the of and to in is that it was for on are with as be at by this from or an le la les de des du et un une est en que qui dans pour pas sur au der die das und ist von den mit sich auf nicht ein eine zu dem im el los las del y una por con para se su al no".split())
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_MARKS = b"#$%&*@^~=<>{}[]\\/+_"
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def _share(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


#: Names of the heuristics, in the order of a vote pattern.
HEURISTICS = ("capitals", "shouting", "marks", "marked words", "bars", "few common words", "repeated lines", "repeated words", "odd word length", "prose")


def votes(text: bytes) -> list[int]:
    """What each heuristic says of a text: all but the last say bad or nothing, the last good or nothing."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * 8 + [-1, 0]
    upper, lower = _share(text, _UPPER), _share(text, _LOWER)
    lines = [x for x in text.split(b"\n") if x.strip()]
    common = sum(w in COMMON for w in words) / n
    marks, shouts, bars = _share(text, _MARKS), text.count(b"!"), text.count(b"|")
    runs = sum(map(bytes.__eq__, words, words[1:]))
    bad = [
        n >= 5 and upper > 0.5 * (upper + lower),
        n >= 5 and shouts > 0.25 * n,
        n >= 5 and marks > 0.06 * len(text),
        n >= 5 and sum(w[-1:] in b"#$%&*" for w in words) > 0.25 * n,
        n >= 5 and bars > 0.2 * n,
        n >= 40 and common < 0.02,
        len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines),
        n >= 8 and runs > 0.2 * n or n >= 40 and len(set(words)) < 0.2 * min(n, 500),
        not 2.0 <= len(text) / n <= 25.0,
    ]
    return [-int(x) for x in bad] + [int(common > 0.1 and marks < 0.01 * len(text) and bars < 0.02 * n and shouts < 0.05 * n and runs < 0.05 * n)]


def posteriors(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """The chance that a document of each vote pattern is good, and each heuristic's accuracy.

    EM over one class of good documents and one kind of bad ones for each heuristic that can say
    bad; heuristics answer independently given the class. A kind starts from the documents that its
    heuristic calls bad, so defects that never come together don't compete, and heuristics that
    overlap share their kinds. All rates are estimated; how often a heuristic is wrong about good
    documents has a beta prior of mean ``WRONG``. Accuracies are the share of a heuristic's answers
    that the posteriors agree with, -1 where it never answers.
    """
    if not patterns:
        return {}, np.zeros(0)
    seen = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    answers = np.stack([seen == a for a in (-1, 0, 1)], axis=2).astype(float)
    called = (seen < 0).astype(float)
    held = np.concatenate([np.where(called.any(axis=1), 0.1, 0.95)[:, None], called + 0.05 / seen.shape[1]], axis=1)
    held[:, 1:] *= ((1 - held[:, 0]) / held[:, 1:].sum(axis=1))[:, None]
    for _ in range(rounds):
        mass = weight[:, None] * held
        table = np.einsum("pc,pha->cha", mass, answers) + 0.1
        # The prior's answers other than bad are split as the documents' are.
        rest = table[0, :, 1:] / table[0, :, 1:].sum(axis=1, keepdims=True)
        table[0] += TRUST * weight.sum() * np.concatenate([np.full((len(rest), 1), WRONG), (1 - WRONG) * rest], axis=1)
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log((mass.sum(axis=0) + 0.1) / (weight.sum() + 1)) + np.einsum("pha,cha->pc", answers, np.log(table))
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved, held = np.abs(new - held).max(), new
        if moved < 1e-6:
            break
    good = held[:, 0]
    right = np.einsum("p,ph->h", weight * good, seen == 1) + np.einsum("p,ph->h", weight * (1 - good), seen == -1)
    said = np.einsum("p,ph->h", weight, seen != 0)
    return dict(zip(map(tuple, seen.tolist()), good.tolist(), strict=True)), np.where(said > 0, right / np.maximum(1, said), -1.0)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dims and normalised values of each text's hashed words and word shapes; the last dim counts
    words that repeat the one before."""
    half = np.uint64(DIMS // 2 - 1)
    for words, shapes in zip(word_hashes(texts), word_hashes([t.translate(_SHAPE) for t in texts], lower=False), strict=True):
        again = np.full(int((words[1:] == words[:-1]).sum()), DIMS - 1, np.uint64)
        dims, tf = np.unique(np.concatenate([words % half, shapes % half + half, again]).astype(np.int32), return_counts=True)
        value = np.sqrt(tf)
        yield dims, (value / max(1e-9, np.sqrt((value**2).sum()))).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft targets, by AdaGrad over small batches. Small
    tables are gone through more often, so there are always as many steps."""
    epochs = max(epochs, EPOCHS * SAMPLE // len(rows))
    weights, bias, squares, bias_square = np.zeros(DIMS, np.float64), 0.0, np.full(DIMS, 1e-3), 1e-3
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 32)):
            dims = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            margin = np.bincount(row, value * weights[dims], len(part)) + bias
            error = 1 / (1 + np.exp(-margin)) - target[part]
            at, inverse = np.unique(dims, return_inverse=True)
            slope = np.bincount(inverse, value * error[row]) / len(part) + decay * weights[at]
            squares[at] += slope**2
            weights[at] -= rate * 0.3 * slope / np.sqrt(squares[at])
            bias_square += error.mean() ** 2
            bias -= rate * 0.3 * error.mean() / np.sqrt(bias_square)
    return weights.astype(np.float32), float(bias)


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from (id, body): pattern posteriors from all rows, a scorer from a sample."""

    def voted(batches):
        for b in batches:
            found = pd.Series(["".join("-0+"[v + 1] for v in votes(t)) for t in utf8(b["body"].tolist())]).value_counts()
            yield pd.DataFrame({"pattern": found.index, "n": found.values})

    table = rows.select("body").mapInPandas(tidy(voted), "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 2 ** 10 rows at most
    total = sum(r["n"] for r in table)
    patterns = sorted((tuple("-0+".index(c) - 1 for c in r["pattern"]), r["n"]) for r in table)
    posterior, accuracy = posteriors(patterns)
    if not total:
        return {"posterior": {}, "accuracy": accuracy, "weights": None, "bias": 0.0}
    drawn = rows if total <= sample else rows.where(F.pmod(F.xxhash64("id", "body", F.lit("quality sample")), F.lit(1 << 30)) < F.lit(int(sample / total * (1 << 30))))

    def sampled(batches):
        for b in batches:
            texts = utf8(b["body"].tolist())
            found = list(features(texts))
            yield pd.DataFrame({"dims": [d.tobytes() for d, _ in found], "value": [v.tobytes() for _, v in found], "target": [posterior[tuple(votes(t))] for t in texts], "tie": [f"{i}" for i in b["id"]], "text_key": b["text_key"]})

    # Rows that repeat an id and a text are one, so the sample is bounded whatever repeats.
    once = drawn.select("id", "body", F.xxhash64("body").alias("text_key")).mapInPandas(tidy(sampled), "dims binary, value binary, target double, tie string, text_key bigint").groupBy("tie", "text_key")
    kept = once.agg(F.first("dims").alias("dims"), F.first("value").alias("value"), F.first("target").alias("target")).orderBy("tie", "text_key").toArrow()
    if not kept.num_rows:
        return {"posterior": posterior, "accuracy": accuracy, "weights": None, "bias": 0.0}
    vectors = [(np.frombuffer(d, np.int32), np.frombuffer(v, np.float32)) for d, v in zip(kept["dims"].to_pylist(), kept["value"].to_pylist(), strict=True)]
    weights, bias = train(vectors, kept["target"].to_numpy())
    return {"posterior": posterior, "accuracy": accuracy, "weights": weights, "bias": bias}


def score(rows: DataFrame, model: dict, columns: list[Column], keep: float = KEEP) -> DataFrame:
    """columns (named), weak_posterior, quality and kept for the text in column body."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for b in batches:
            texts = utf8(b["body"].tolist())
            good = []
            for t, (dims, value) in zip(texts, features(texts), strict=True):
                if not len(dims):
                    good.append(0.0)
                elif own["weights"] is None:
                    good.append(1.0)
                else:
                    good.append(float(1 / (1 + np.exp(-(float(value @ own["weights"][dims]) + own["bias"])))))
            yield b.drop(columns="body").assign(weak_posterior=[own["posterior"].get(tuple(votes(t)), 0.5) for t in texts], quality=good, kept=[g >= keep for g in good])

    picked = rows.select(*columns, "body")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "body")
    return picked.mapInPandas(tidy(run), f"{schema}, weak_posterior double, quality double, kept boolean")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per document: id, weak_posterior, quality, kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return score(rows, fit(rows), [F.col("id")], keep).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with all their columns, judged where they stand."""
    model = fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")))
    shipped = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        weights, bias = shipped.value
        out = []
        for dims, value in features(utf8(texts.tolist())):
            out.append(bool(len(dims)) and (weights is None or 1 / (1 + np.exp(-(float(value @ weights[dims]) + bias))) >= keep))
        return pd.Series(out, dtype=bool)

    return docs.where(good(F.col(text_col)))


def op9(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
