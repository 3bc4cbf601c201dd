import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from paperlane.llm import arrays as A, substring as S

DATA = "/root/testdata/sf0.001/documents.parquet"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least=S.MIN_WORDS):
    """Word by word, with a set of seen passages: {doc_id: set of cut word numbers}."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\t-\r\x1c-\x20]+", text or "")
        h = A.spaced_words(pa.array([text]))[2].hash.tolist()
        roll = [(h[i] + (h[i - 1] << 1 if i else 0) + (h[i - 2] << 2 if i > 1 else 0)) % 2**64 for i in range(len(h))]
        hits = [g & 6 == 0 for g in roll]

        def quiet(i, q=S.QUIET):
            near = range(i - q, i + q + 1)
            return near[0] >= 0 and near[-1] < len(h) and not any(hits[j] for j in near) and roll[i] == min(roll[j] for j in near) and roll[i] != roll[i - 1]

        ends = [i + 1 for i in range(len(h)) if (hits[i] and not (i and hits[i - 1])) or i == len(h) - 1 or quiet(i)]
        gone = set()
        for begin in [0, *ends[:-1]]:
            end = next((e for e in ends if e >= begin + least), None)
            if end:
                key = tuple(words[begin:end])
                if key in seen:
                    gone.update(range(begin, end))
                seen.add(key)
        out[doc_id] = [w for i, w in enumerate(words) if i not in gone]
    return out


def test_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(DATA, columns=["doc_id", "text"]).to_pylist()]
    want = brute(rows)
    got = {r.doc_id: re.findall(r"[^\t-\r\x1c-\x20]+", r.text) for r in S.dedup(spark.read.parquet(DATA)).collect()}
    assert got == want
    assert sum(len(w) for w in want.values()) < sum(len(t.split()) for _, t in rows)


def test_passages_of_fifty_words_are_found_and_insertions_move_nothing(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(55) for _ in range(40)]
    rows = [(i, f"{prose(60)} {shared[i % 40]}\n{prose(rng.randint(1, 90))}", "en", "s", 0) for i in range(80)]
    clean = [(1000 + i, prose(150), "en", "s", 0) for i in range(40)]
    got = {r.doc_id: r for r in S.dedup(spark.createDataFrame(rows + clean, DOCS)).collect()}
    caught = [i for i in range(40, 80) if got[i].kept_in == [i - 40]]
    assert len(caught) >= 38
    assert all(shared[i - 40] not in got[i].text for i in caught)
    for i, text, *_ in rows[:40] + clean:
        assert got[i].text == text and got[i].cut_chars == 0 and got[i].kept_in == []


def test_passages_that_repeat_a_line_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = ["\n".join([prose(p)] * (120 // p)) for p in (2, 3, 4, 6, 8, 12) for _ in range(20)]
    rows = [(i, f"{prose(40)}\n{shared[i % 120]}\n{prose(40)}", "en", "s", 0) for i in range(240)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in S.dedup(docs).collect()}
    assert {i: got[i].text.split() for i, *_ in rows} == brute([(i, t) for i, t, *_ in rows])
    assert all(i - 120 in got[i].kept_in for i in range(120, 240))


def test_edges_of_data(spark):
    prose = " ".join(f"w{i * i % 977}x{i}" for i in range(300))
    rows = [
        (None, prose, "en", "a", 9), (2, prose, "en", "a", 9), (2, prose, "en", "a", 9), (1, "vor é " + prose + " después 😀", None, None, None),
        (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n ", "en", "a", 0), (6, "one two", "en", "a", 7), (7, "one two", "en", "a", 7),
        (8, "Orre " * 60000, "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    wide = docs.selectExpr("*", "1 AS digest", "2 AS doc", "3 AS mark", "4 AS spans", "5 AS kept_in", "6 AS a", "7 AS cut_chars")
    for d in (docs, wide):
        got = S.dedup(d).collect()
        assert len(got) == len(rows)
        texts = {}
        for r in got:
            texts.setdefault(r.doc_id, set()).add(r.text)
        assert texts[1] == {rows[3][1]} and texts[3] == {None} and texts[4] == {""} and texts[5] == {" \n "} and texts[6] == texts[7] == {"one two"}
        assert texts[8] == {rows[9][1]}
        assert all(len(t) < 100 for t in (*texts[2], *texts[None])) and len(texts[2]) == 1
        kept = S.without_copies(d)
        assert kept.columns == d.columns
    assert S.dedup(docs.limit(0)).count() == 0
