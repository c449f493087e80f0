import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import lm_score as S

from .conftest import words


def brute(rows):
    counts = Counter()
    split = lambda t: [*(t or "").encode().lower().split(), 0]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (held(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(9)
    table = words(1, 30).split()
    follow = {w: rng.permutation(30)[:3] for w in table}
    rows = []
    for i in range(260):
        w, out = table[0], []
        for _ in range(60):
            w = table[int(rng.choice(follow[w]))]
            out.append(w)
        rows.append((i, " ".join(out), "en", "s"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


@pytest.mark.parametrize("heavy", [2_000_000, 40])
def test_base_against_brute_force(corpus, odd, monkeypatch, heavy):
    monkeypatch.setattr(S, "HEAVY", heavy)
    rows = odd.where("doc_id IS NULL OR doc_id <> 7").select("doc_id", "text").unionByName(corpus.selectExpr("doc_id + 1000 AS doc_id", "text"))
    want = brute([tuple(r) for r in rows.collect()])
    found = S.score_documents(rows).collect()
    assert len(found) == len(want)
    for r in found:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert math.isclose(r["base_score"], w[4], rel_tol=1e-9)


def test_model_beats_base_where_history_tells(corpus):
    held = [r for r in S.score_documents(corpus).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_chances_sum_to_one():
    rng = np.random.default_rng(0)
    top = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    m = S.Model(top, np.arange(40, 0, -1.0), np.full(S.RARE, 7.0), 1000)
    for t in m.tables:
        t[:] = rng.normal(0, 0.5, t.shape)
    one, two = (np.full(1, x, np.uint64) for x in (5, 9))
    total = sum(10 ** m.log_chances(np.array([w]), one, two, m.ranks(np.array([w])))[0] for w in m.top)
    rare = [np.array([k], np.uint64) for k in range(S.RARE)]
    total += sum(10 ** m.log_chances(w, one, two, np.array([-1]))[0] for w in rare)
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_training_folds_of_many_tasks_agree(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "FAN", 2)
    found = S.score_documents(corpus.repartition(7)).collect()
    assert all(r["score"] < 0 for r in found)


def test_empty_table(empty):
    assert S.score_documents(empty).count() == 0


def test_rare_words_have_32_classes():
    (found,) = S.tokens([" ".join(f"{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop").encode()])
    assert len({int(t & S._LOW) for t in found}) > 16
    rare = np.arange(64, dtype=np.uint64)
    m = S.Model(np.zeros(0, np.uint64), np.zeros(0), np.ones(S.RARE), 1)
    assert len(set(m.classes(rare, m.ranks(rare)).tolist())) == 32


def test_words_beyond_the_most_frequent_follow_their_history():
    """A rare word that always follows another gains on those of its class; the whole still sums to one."""
    m = S.Model(np.array([1 << 40], np.uint64), np.array([9.0]), np.full(S.RARE, 16.0), 1000, np.full((S.RARE, 64), 1.0))
    leaves = np.array([leaf << 58 | 5 for leaf in range(64)], np.uint64)
    one, two = (np.full(64, x, np.uint64) for x in (7, 9))
    learner = S.Learner(m)
    for _ in range(200):
        learner.step(np.full(64, leaves[3]), one, two)
    after, other = (m.log_chances(leaves, np.full(64, x, np.uint64), two, np.full(64, -1)) for x in (7, 8))
    assert after[3] > np.delete(after, 3).max() + 1 and after[3] > other[3] + 0.3
    kinds = np.array([leaf << 58 | k for leaf in range(64) for k in range(S.RARE)], np.uint64)
    every = np.append(m.top, kinds)
    total = (10 ** m.log_chances(every, *(np.full(len(every), x, np.uint64) for x in (7, 9)), m.ranks(every))).sum()
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_tables_grow_with_the_training_types():
    sizes = [tuple(t.size for t in m.tables) for types in (1000, 10**7) for m in [S.Model(np.zeros(0, np.uint64), np.zeros(0), np.ones(S.RARE), 1, np.ones((S.RARE, 8)), types)]]
    assert all(a < b for a, b in zip(*sizes, strict=True))


def slow_score(model, known, tokens):
    """The log-probability of one text, token by token and way by way with plain numbers."""
    mask = (1 << 64) - 1

    def mixed(x):
        x &= mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def log_softmax(table, bias, hashes, right):
        rows = [mixed(h) >> 64 - model.bits[table] for h in hashes]
        z = [float(b) + sum(float(model.tables[table][r][k]) for r in rows) for k, b in enumerate(bias)]
        return z[right] - math.log(sum(math.exp(x) for x in z))

    a, b, c = int(S._A), int(S._B), int(S._C)
    count = dict(zip(known["token"].tolist(), known["count"].tolist(), strict=True))
    place = dict(zip(model.top.tolist(), model.place.tolist(), strict=True))
    one = two = int(S._START)
    total = 0.0
    for t in map(int, tokens):
        rank = place.get(t, -1)
        group = rank // S.PER_CLASS if rank >= 0 else S.WORD_CLASSES + (t & S.RARE - 1)
        side, at = divmod(group, S.SIDE)
        total += log_softmax(0, model.group_bias, (one * a, two * b, one * a + two * c), side)
        own = (side + 1) * c
        total += log_softmax(1, model.class_bias[side], (one * b + own, two * a + own, one * c + two * b + own), at)
        if rank >= 0:
            own = group * b
            total += log_softmax(2, model.word_bias[group], (one * a + own, one * c + two * a + own), rank % S.PER_CLASS)
        else:
            kind, leaf = t & S.RARE - 1, t >> 64 - model.depth if model.depth else 0
            for level in range(model.levels):
                node = kind * int(model.firsts[-1]) + int(model.firsts[level]) + (leaf >> model.depth - S.STEP * level)
                way = leaf >> model.depth - S.STEP * (level + 1) & S.WAYS - 1
                total += log_softmax(3, model.tree_bias[node], (one * a + node * b, two * c + node * b), way)
            total += (math.log10(count.get(t, 0) + 1) - model.log_cells[kind << model.depth | leaf]) * math.log(10)
        one, two = t, one
    return total / math.log(10)


def test_scores_against_a_slow_model(spark, corpus):
    more = spark.createDataFrame([(5000 + i, words(i, 40)) for i in range(40)] + [(6000, ""), (6001, None), (6002, words(1, 20_000))], "doc_id bigint, text string")
    rows = corpus.select("doc_id", "text").unionByName(more)
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    training = spark.createDataFrame([(i, t) for i, t in texts.items() if not fold(i)], "id bigint, body string")
    model, known = S.fit(S.token_counts(training), training)
    assert model.levels > 0 and all(np.abs(t).max() > 0 for t in model.tables)
    docs = [next(S.tokens([texts[i].encode()])) for i in (0, 5, 9, 5003, 5017, 6000)]
    every, one, two = S.histories(docs)
    rank = model.ranks(every)
    chance = model.log_chances(every, one, two, rank)
    count = dict(zip(known["token"].tolist(), known["count"].tolist(), strict=True))
    n = np.array([count.get(int(t), 0) for t in every])
    chance[rank < 0] += np.log10(n + 1.0)[rank < 0] - model.log_cells[model.cells(every[rank < 0])]
    ends = np.cumsum([len(d) for d in docs])
    for d, end in zip(docs, ends, strict=True):
        assert math.isclose(chance[end - len(d) : end].sum(), slow_score(model, known, d), rel_tol=1e-4)
    found = {r["doc_id"]: r["score"] for r in S.score_documents(rows).collect()}
    assert math.isclose(found[6000], found[6001], rel_tol=1e-9) and found[6002] < found[0]


def test_repeated_rows_are_scored_alike(odd):
    found = [r["score"] for r in S.score_documents(odd).collect() if r["doc_id"] == 7 and r["n_tokens"] == 5]
    assert len(found) == 2 and found[0] == found[1]


@pytest.mark.parametrize("most", [1, 2, 7, 4000])
def test_sums_of_rows_are_those_of_one_pass_over_all(most):
    """Rows of weights that are met once are not added up, and the others give the same bits as before."""
    rng = np.random.default_rng(most)
    rows = (np.arange(4000) if most == 1 else rng.integers(0, 4000 // most + 1, 4000)).astype(np.uint32)
    slope = rng.standard_normal((4000, 8)).astype(np.float32)
    order, ordered = S.in_order(rows)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    n = np.diff(np.append(first, len(rows)))
    want = np.add.reduceat(slope.take(order, axis=0), first, axis=0) * (1 / np.sqrt(n.astype(np.float32)))[:, None]
    got = S.row_sums(slope, order, first, n)
    assert got.dtype == np.float32 and np.array_equal(got, want)


def test_a_step_is_adagrad_on_each_row_once():
    """A row that several features of a step meet changes once, by the slopes of all of them."""
    rng = np.random.default_rng(3)
    for table in range(4):
        m = S.Model(np.zeros(0, np.uint64), np.zeros(0), np.ones(S.RARE), 1, np.ones((S.RARE, 8)), 1000)
        width = m.tables[table].shape[1]
        bias, right = rng.normal(0, 1, (50, width)).astype(np.float32), rng.integers(0, width, 50)
        features = [rng.integers(0, 30, 50).astype(np.uint16) for _ in range(2)]
        weights, squares = np.zeros((30, width)), np.full((30, width), S.DAMP)
        learner = S.Learner(m)
        for _ in range(3):
            learner._softmax(table, bias, features, right)
            z = np.exp(bias + weights[features[0]] + weights[features[1]])
            slope = z / z.sum(axis=1, keepdims=True) - np.eye(width)[right]
            for row in range(30):
                met = np.concatenate([slope[f == row] for f in features])
                if len(met):
                    g = met.sum(axis=0) / math.sqrt(len(met))
                    squares[row] += g * g
                    weights[row] -= S.RATES[table] * g / np.sqrt(squares[row])
        assert np.allclose(m.tables[table][:30], weights, atol=1e-5) and not m.tables[table][30:].any()
        changes = learner.changes()
        found = np.frombuffer(changes["delta"].iloc[0], np.float16).reshape(-1, width)
        met = np.unique(np.concatenate(features))
        assert len(changes) == 1 and np.allclose(found, weights[met], atol=1e-3)
        assert np.flatnonzero(np.unpackbits(np.frombuffer(changes["tasks"].iloc[0], np.uint8))).tolist() == met.tolist()


def test_tables_in_tasks_are_aligned():
    """A row of 32 bytes isn't in two lines of the CPU's caches."""
    m = S.Model(np.zeros(0, np.uint64), np.zeros(0), np.ones(S.RARE), 1, np.ones((S.RARE, 8)), 1000)
    for t in m.tables:
        t[:] = np.arange(t.size).reshape(t.shape)
    there = pickle.loads(pickle.dumps(m))
    learner = S.Learner(pickle.loads(pickle.dumps(m)))
    for table, pairs, want in zip(there.tables, learner.pairs, m.tables, strict=True):
        assert np.array_equal(table, want) and np.array_equal(pairs[::2], want)
        assert table.ctypes.data % 64 == 0 and pairs.ctypes.data % 64 == 0


def test_ranks_of_tokens_that_begin_alike():
    top = np.array([5 << 48, (5 << 48) + 1, (5 << 48) + 9, 0, (1 << 64) - 1, 7 << 48], np.uint64)
    m = S.Model(top, np.arange(6, 0, -1.0), np.ones(S.RARE), 1)
    every = np.concatenate([top, np.array([1, (5 << 48) + 2, 6 << 48, (7 << 48) + 1, (1 << 64) - 2], np.uint64)])
    assert m.ranks(every).tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1, -1, -1]
    assert S.Model(top[:0], np.zeros(0), np.ones(S.RARE), 1).ranks(every).tolist() == [-1] * 11
