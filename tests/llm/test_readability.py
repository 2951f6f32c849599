import os
import statistics

import pytest

from quarrylight.llm import readability as R

DATA = "/root/testdata/sf0.001"

EASY = "The dog sees the cat. The cat sees the box. The box has a key. " * 12
HARD = "The idiosyncratic instrumentation of every probabilistic quantization necessitates, notwithstanding the heterogeneous admissibility of its canonicalization, a commutative reconciliation of the monotonicity that the asymptotic approximation circumscribes. " * 6


def test_prose():
    text = "# Title Here\n\nThis is one line\nand goes on. More.\n\n```\ncode here\n```\n- an item\n- more of it\n\n| a | b |\n|---|---|\n\n2025-01-01T00:00:00Z INFO x\nfunc main() {\n    return x\n}\nconst a = 1;\n"
    got = " ".join(R.prose(text).split())
    assert got == "This is one line and goes on. More. an item more of it"


def test_code_holds_no_prose():
    text = 'def f(a):\n    """Sort the ledger before the index is warm and the cell is cold.\n\n    see the notes for the plain case and keep the score in step\n    """\n    return a\n' * 8
    assert R.measured(text) is None


def test_measured():
    assert R.measured(None) is None and R.measured("") is None and R.measured("word " * 49 + ".") is None
    lang, words, sentences, counts = R.measured(EASY)
    assert (lang, words, sentences) == ("en", 60 * 3, 36)
    assert counts["dog"] == [12, 12]
    assert R.measured("Der Hund sieht die Katze und das Haus. " * 20)[0] == "de"


def table(spark, docs, labels=()):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame(list(labels), "doc_id bigint, annotator string, reading_level int")
    return {r.doc_id: r.reading_level for r in R.reading_levels(d, lab).collect()}


def test_levels_follow_labels(spark):
    docs = [(i, EASY) for i in range(10)] + [(100 + i, HARD) for i in range(10)] + [(200, None), (201, ""), (202, "short text."), (203, EASY)]
    labels = [(i, "a", 1) for i in range(5)] + [(100 + i, "a", 5) for i in range(5)] + [(0, "b", None), (0, "c", 9), (0, "a", 1), (100, "d", 0), (999, "a", 3)]
    got = table(spark, docs, labels)
    assert set(got) == {*range(10), *range(100, 110), 203}
    assert {got[i] for i in (*range(10), 203)} == {1} and {got[100 + i] for i in range(10)} == {5}


def test_without_labels_and_empty(spark):
    got = table(spark, [(1, EASY), (2, HARD)])
    assert got[1] < got[2]
    assert table(spark, []) == {}


def test_joined_vocabulary_gives_the_same(spark):
    d = spark.createDataFrame([(1, EASY), (2, HARD), (3, EASY + HARD)], "doc_id bigint, text string")
    found = R.measures(d)
    ranks = R.word_ranks(found)
    a = {(r.doc_id, round(r.x, 9), round(r.y, 9)) for r in R.coverage(found, ranks).collect()}
    for k in (0, 1, 5, 40):
        assert a == {(r.doc_id, round(r.x, 9), round(r.y, 9)) for r in R.coverage(found, ranks, known=k).collect()}
    assert len(a) == 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_agreement(spark):
    sf = os.path.join(os.path.dirname(DATA), "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/level_labels.parquet")
    held = {}
    for r in labels.filter("doc_id % 3 = 0 and reading_level between 1 and 5").collect():
        held.setdefault(r.doc_id, []).append(r.reading_level)
    got = {r.doc_id: r.reading_level for r in R.reading_levels(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    near = [abs(got[d] - statistics.mean(v)) <= 0.5 for d, v in held.items() if d in got]
    assert len(near) > 10 and sum(near) / len(near) >= 0.75
