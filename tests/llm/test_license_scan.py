import random
import re

from folioscope.llm import license_scan as L


def brute(text):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
    places = []
    for phrase, label in L.PHRASES.items():
        p = phrase.encode().split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark, docs, texts):
    extra = ["under the mit license under the MIT-license! cc by nc cc by nc", "apache license version 2 apache license version", "été under the mit license", "under the\x00mit license"]
    rows = spark.createDataFrame(list(enumerate([*texts, *extra])), "doc_id bigint, text string")
    for r in L.license_scan(rows).collect():
        text = [*texts, *extra][r["doc_id"]]
        first = None if r["n_base"] == 0 else r["first_word"]
        assert (r["n_words"], r["n_base"], first, r["last_word"], r["base_labels"]) == brute(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_chained_matches_cover_templates():
    own = L.Scanner()
    grant = L.TEMPLATES[0][1].split()
    broken = " ".join([*grant[:20], "INSERTED", *grant[20:]])
    found = own.scan(b"some words " + broken.encode() + b" more words")
    assert found["labels"] == "mit" and found["spans"][0]["first"] == 2
    assert own.scan(" ".join(grant[:10]).encode())["labels"] == ""
    assert own.scan(b"GNU General Public License, version 3.")["labels"] == "gpl-3"


def test_words_that_licences_share_tell_none():
    own = L.Scanner()
    shared = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program"
    assert own.scan(shared.encode())["labels"] == ""
    assert own.scan(f"{shared}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.".encode())["labels"] == "gpl-2"
    assert own.scan(f"{shared}. If not, see https://www.gnu.org/licenses/.".encode())["labels"] == "gpl-3"
    # With the grant of one version the shared words belong to that one.
    grant = next(t for label, t in L.TEMPLATES if label == "gpl-3")
    assert own.scan(f"{grant}. {shared}".encode())["labels"] == "gpl-3"


def test_matching_statistics():
    sequences = [[1, 2, 3, 4], [2, 3, 5]]
    a = L.SuffixAutomaton(sequences)
    text = [0, 1, 2, 3, 5, 2, 3, 4, 9]
    _, found = a.stream(text)
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for at, n in enumerate(found):
        assert n == max((k for k in range(at + 2) if k == 0 or tuple(text[at + 1 - k : at + 1]) in parts))


def test_odd_and_empty_tables(odd, empty):
    assert L.license_scan(odd).count() == odd.count() and L.license_scan(empty).count() == 0


def slow_cover(scanner, number, words):
    """The most words of a template that a chain in the text covers: parts of the longest runs that end
    at each word and go no further, in every order that text and template allow."""
    template = scanner.sequences[number]
    ids = [scanner.ids.get(w, -1) for w in words]
    ends = []
    for x in range(len(ids)):
        n = 0
        while n <= x and any(template[t : t + n + 1] == ids[x - n : x + 1] for t in range(len(template) - n)):
            n += 1
        ends.append(n)
    pieces = set()
    for x, n in enumerate(ends):
        if n >= L.MIN_MATCH and (x + 1 == len(ids) or ends[x + 1] <= n):
            for t in range(len(template) - n + 1):
                if template[t : t + n] == ids[x - n + 1 : x + 1]:
                    pieces |= {(x - n + 1 + i, t + i, k) for i in range(n) for k in range(1, n - i + 1)}
    best = {}
    for x, t, n in sorted(pieces):
        best[x, t, n] = n + max((v for (a, b, m), v in best.items() if a + m <= x <= a + m + L.GAP and b + m <= t <= b + m + L.GAP), default=0)
    return max(best.values(), default=0)


def test_chains_against_all_chains():
    rng = random.Random(2)
    for _ in range(60):
        template = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(9, 16))]
        own = L.Scanner({}, [("x", " ".join(template))])
        text = []
        for w in template:
            text += [w] * rng.choice([1, 1, 1, 1, 1, 0]) + ["zz"] * rng.choice([0, 0, 0, 0, 1, 3])
        text = ["zz"] * 2 + text + text[: rng.randrange(8)]
        want = slow_cover(own, 0, [w.encode() for w in text])
        found = own.scan(" ".join(text).encode())
        assert found["score"] == min(1.0, want / len(template))


def test_a_run_that_stands_twice_in_a_template():
    own = L.Scanner({}, [("x", "one two three four five one two three six seven eight nine ten")])
    found = own.scan(b"one two three four five inserted one two three inserted six seven eight nine ten")
    assert found["score"] == 1.0 and found["labels"] == "x"
    assert [(s["first"], s["last"]) for s in found["spans"]] == [(0, 14)]


def test_two_copies_give_two_spans_and_long_texts_are_scanned():
    own = L.scanner()
    grant = L.TEMPLATES[0][1]
    twice = own.scan(f"{grant} {grant} {'filler ' * 30} {grant}".encode())
    assert [s["label"] for s in twice["spans"] if s["cover"] == 1.0 and s["last"] - s["first"] > 30].count("mit") == 3
    long = own.scan(("some words of no licence at all " * 700_000 + "released under the mit license").encode())
    assert long["n_base"] == 1 and long["n_words"] == 4_900_005 and long["labels"] == "mit"


def test_bodies_of_licences():
    own = L.scanner()
    for label, body in L.TEMPLATES:
        words = L.words_of(body.encode())
        changed = b" ".join([*words[: len(words) // 2], b"verily", *words[len(words) // 2 :]]) if len(words) > 8 else b" ".join(words)
        assert label in own.scan(b"before " + changed + b" after")["labels"].split(",")


def test_repeated_rows_and_null_ids_are_scanned_alike(spark):
    rows = [(7, "Released under the MIT License"), (7, "Released under the MIT License"), (None, "Released under the MIT License"), (None, None)]
    found = L.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["7", "7", "None", "None"]
    for r in found:
        empty = r["n_words"] == 0
        assert tuple(r)[1:7] == ((0, 0, None, None, "", "") if empty else (5, 1, 1, 1, "mit", "mit")) or r["doc_id"] == 7
    assert sum(r["n_words"] == 5 and r["labels"] == "mit" and r["first_word"] == 1 for r in found) == 3
