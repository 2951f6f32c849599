import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import encode as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    with open(E.VOCABULARY, "rb") as f:
        return E.Encoder(f.read())


def same(enc, texts):
    got = enc.encode(pa.array(texts, pa.string())).to_pylist()
    assert got == [enc.whole.encode_ordinary(t or "") for t in texts]


def test_edge_cases(enc):
    same(enc, [None, "", " ", "\n", "a", "'s", "#'s", "x's", "<|endoftext|>", "a  b", "a \n b", "\u00a0x\u3000y", "e\u0301", "\U0001f600", "\x00\x1c a", "a" * 5000, "don't  stop"])
    assert enc.encode(pa.array([], pa.string())).to_pylist() == []
    assert enc.encode(pa.array(["zz", "a b", None], pa.string()).slice(1)).to_pylist()[1] == []


def test_random_mixtures(enc):
    rnd = random.Random(7)
    alphabet = list("abcs'trelvmd  \n\t.,#$%(_-=019Z") + ["\u3000", "\xa0", "é", "ß", "中", "😀", "\u0301", "'ll", " 's", "#'s"]
    same(enc, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(20_000)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(enc, texts):
    same(enc, [t for t in texts if t.encode("utf-8", "ignore").decode() == t])


def test_small_memory(enc, monkeypatch):
    monkeypatch.setattr(E, "REMEMBERED", 3)
    for _ in range(3):
        same(enc, ["one two three four five", "six seven eight nine"])


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (2, "", 5), (3, "Hello world", 5)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in E.encode_documents(df).collect()]
    assert got == [(1, [15496, 995]), (2, []), (2, []), (3, [15496, 995])]
    assert E.encode_documents(df.limit(0)).count() == 0
