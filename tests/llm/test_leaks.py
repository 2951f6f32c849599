import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import leaks as L

VOCAB = [a + b for a in ("ka", "lo", "mi", "ru", "te", "no", "sha", "pel") for b in ("dor", "fin", "gam", "lex", "mon", "pra", "quo", "sten", "ti", "vel")]
LEAD = "Read the following text and answer the question below."


def passage(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice(VOCAB) for _ in range(n)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 4), max_size=70))
def test_myers_is_the_edit_distance(a, b):
    assert L.myers(a, b) == edit_distance(a, b)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, words string")
    return d, e


def test_forms_and_decoys(spark):
    items = [passage(s, 80) for s in range(8)]
    texts = [LEAD + "\n" + " ".join(w) + "." for w in items]
    w = items[0]
    noise = lambda s: " ".join(passage(900 + s, 60))
    edited = [x if i % 6 else "also" for i, x in enumerate(w[10:55])]
    shuffled = w[:]
    random.Random(1).shuffle(shuffled)
    docs = {
        "whole": noise(1) + " " + " ".join(w) + " " + noise(2), "part": noise(3) + " " + " ".join(w[20:50]) + " " + noise(4), "upper": " ".join(w[20:60]).upper(), "edited": " ".join(edited), "markup": "<p>" + "</p>\n<p><b>".join(" ".join(w[i : i + 8]) for i in range(0, 48, 8)) + "</b></p>", "hidden": "\u200b".join(" ".join(w[:40])),
        "wide": " ".join(w[:40]).replace("a", "\uff41").replace("o", "\u043e"), "quoted": "\n> ".join(" ".join(w[i : i + 7]) for i in range(0, 49, 7)), "two": " ".join(w[5:22]) + " " + noise(5) + " " + " ".join(w[40:58]), "hyphen": " ".join(w[:30])[:40] + "-\n" + " ".join(w[:30])[40:], "json": '{"prompt": "' + "\\n".join(" ".join(w[i : i + 6]) for i in range(0, 48, 6)) + '"}',
    }
    free = {"lead": LEAD + " " + noise(6), "quote": noise(7) + " " + " ".join(w[30:40]) + " " + noise(8), "shuffled": " ".join(shuffled), "none": None, "empty": "", "noise": noise(9), "quotes": " ".join(" ".join(items[k][10:19]) + " " + noise(20 + k) for k in range(8))}
    names = [*docs, *free]
    d, e = frames(spark, [*docs.values(), *free.values()], [*texts, None, "", "too short", texts[0]])
    got = {(names[r.doc_id], r.item_id) for r in L.leaked(d, e).collect()}
    assert got == {(n, i) for n in docs for i in (100, 111)}


def block(item, shared=()):
    return L.Items([(1, item, [[], [], list(shared)])])


def kept(item, doc):
    got = {i: k for _, i, k in L.matches(block(item), [" ".join(doc)])}
    return got.get(1, 0)


def planted(seed, pieces, edits, kind):
    """An item and a document that holds pieces of it, ten item words apart, with edits at random places."""
    rnd = random.Random(seed)
    item = [f"{rnd.choice(VOCAB)}{rnd.randint(0, 9)}" for _ in range(90)]
    noise = lambda n: [rnd.choice(VOCAB) + "x" for _ in range(n)]
    places = [(i, j) for i, n in enumerate(pieces) for j in range(n)]
    hit = set(rnd.sample(places, edits))
    at, doc = rnd.randint(0, 40), noise(40)
    for i, n in enumerate(pieces):
        for j, w in enumerate(item[at : at + n]):
            how = kind if kind != "mixed" else rnd.choice(["replaced", "inserted", "left out"])
            if (i, j) not in hit:
                doc.append(w)
            elif how == "replaced":
                doc.append(f"sub{rnd.randint(0, 99)}")
            elif how == "inserted":
                doc += [w, f"ins{rnd.randint(0, 99)}"]
        at += n + 10
        doc += noise(20)
    return item, doc


def recall(pieces, edits, kind, rounds=100):
    return sum(kept(*planted(s, pieces, edits, kind)) > 0 for s in range(rounds)) / rounds


@pytest.mark.parametrize("kind", ["replaced", "inserted", "mixed"])
@pytest.mark.parametrize("edits", range(7))
def test_recall_by_edits(kind, edits):
    assert recall([25], edits, kind) >= 0.9
    assert recall([30], edits + 1, kind) >= 0.95


@pytest.mark.parametrize("first", range(13, 25))
def test_recall_by_split(first):
    assert recall([first, 25 - first], 0, "replaced") == 1
    assert recall([25 - first, first], 0, "replaced") == 1
    for edits in (1, 2, 3):
        assert recall([first + 2, 27 - first], edits, "mixed", 80) >= 0.9


def test_fewer_words_than_asked_for():
    for n in range(10, 25):
        assert recall([n], 0, "replaced", 60) == 0


def test_edits_against_shared_wording_prove_nothing():
    w = [f"own{a}{b}" for a in VOCAB[:9] for b in VOCAB[:9]]
    doc = [x if i % 4 else "other" for i, x in enumerate(w[:29])]
    assert L.WORDS <= max(k for _, _, k in L.matches(block(w), [" ".join(doc)]))
    assert not list(L.matches(block(w, range(1, 27)), [" ".join(doc)]))
    assert list(L.matches(block(w, range(1, 27)), [" ".join(w[:29])]))


def test_shared_wording_is_counted_over_different_items(spark):
    form = passage(50, 12)
    items = [" ".join([*passage(s, 20), *form, *passage(s + 100, 20)]) for s in range(3)]
    _, e = frames(spark, [], [*items, *[" ".join(passage(9, 40))] * 4])
    rows = {r.item_id: r for r in L.own_wording(e, "item_id", "text").collect()}
    assert all(set(range(20, 30)) <= set(rows[100 + i].m3) for i in range(3))
    assert not any(rows[103 + i].m3 for i in range(4))


def test_repeated_and_crossing_copies():
    w = [f"own{a}{b}" for a in VOCAB[:9] for b in VOCAB[:9]]
    gap = lambda s: passage(700 + s, 40)
    assert kept(w, w[0:13] + gap(1) + w[30:43] + gap(2) + w[0:15]) >= 26
    # four longer pieces in reverse order, a shorter fifth in front of one of them
    doc = w[3:13] + gap(1) + w[60:75] + gap(2) + w[45:60] + gap(3) + w[30:45] + gap(4) + w[15:30]
    assert kept(w, doc) >= 25
    assert kept(w, w[60:75] + gap(2) + w[45:60] + gap(3) + w[30:45] + gap(4) + w[15:30]) == 0
    # many copies are all looked at, each once
    many = [x for s in range(300) for x in [*w[0:13], *gap(s)]]
    assert kept(w, w[30:43] + many) == 0 and kept(w, many + w[30:43]) >= 26


def test_short_pieces_and_single_hits():
    w = [f"own{a}{b}" for a in VOCAB[:9] for b in VOCAB[:9]]
    noise = passage(800, 40)
    for first in (19, 20, 21):
        for at in range(6):
            two = w[at : at + first] + noise + w[at + 40 : at + 65 - first]
            assert kept(w, two) == 25, (first, at)
            assert kept(w, w[at : at + 25 - first] + noise + w[at + 40 : at + 40 + first]) == 25, (first, at)
            assert kept(w, w[at + 40 : at + 65 - first] + noise + w[at : at + first]) == 0, (first, at)
    # 25 words in order, seven words inserted among them: one whole piece of the item is left
    cut = [2, 5, 8, 11, 14, 17, 20]
    doc = [x for n, y in enumerate(w[:25]) for x in ((y, f"in{n}") if n - 1 in cut else (y,))]
    assert len(block(w).hits([[block(w).code.get(x, -1) for x in doc]])[0]) == 1
    assert kept(w, doc) == 25
    assert kept(w, noise + w[30:40] + noise) == 0


def test_best_pair_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        found = []
        for _ in range(rnd.randint(0, 12)):
            q, p, n = rnd.randint(0, 40), rnd.randint(0, 60), rnd.randint(1, 15)
            found.append((rnd.randint(0, 3), q, q + n - 1, p, p + n - 1))
        best = L.held(found)
        size = lambda f: f[2] - f[1] + 1
        long = lambda a, b: size(a) >= L.RUN and size(b) >= L.RUN
        pairs = [size(a) + size(b) + min(min(a[0], L.ENDS) + min(b[0], L.ENDS), L.ENDS) + long(a, b) for a in found for b in found if a[2] < b[1] and a[4] < b[3]]
        assert best[0] == max([size(f) + min(f[0], L.ENDS) for f in found] + pairs, default=0)


def test_blocks_give_the_same(spark, monkeypatch):
    items = [passage(s, 50) for s in range(7)]
    d, e = frames(spark, [" ".join(w[5:45]) for w in items], [" ".join(w) for w in items])
    want = {(i, 100 + i) for i in range(7)}
    assert {(r.doc_id, r.item_id) for r in L.leaked(d, e).collect()} == want
    monkeypatch.setattr(L, "BLOCK", 120)
    assert {(r.doc_id, r.item_id) for r in L.leaked(d, e).collect()} == want


def test_empty_tables(spark):
    d, e = frames(spark, ["a b c"], [" ".join(passage(1, 40))])
    assert L.leaked(d.limit(0), e).count() == 0
    assert L.leaked(d, e.limit(0)).count() == 0
