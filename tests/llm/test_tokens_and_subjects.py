import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.subjects import document_subjects, fit_subjects, sentences
from weftline.llm.tokens import VOCABULARIES, Vocabulary, count_tokens, decode, encode

LIB = Tokenizer.from_file(os.path.join(VOCABULARIES, "byte_bpe_50k.json"))
LIB.encode_special_tokens = True
MINE = Vocabulary()
HARD = ["don't it's 'tis I'll we've", " \n  a", "a \n\n b\t\tc  ", "　x  y", "<|endoftext|>", "\x1c\x1d a\x85b", "'s", "' s", "x'v 'l 'r", "x're", "  ", "\n", "ａ１½²", "a" * 3000, "é🙂‍", "0" * 2000]


def same(texts):
    ids, off, _, _ = MINE.encode_batch(texts)
    want = [e.ids for e in LIB.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[off[i] : off[i + 1]] for i in range(len(texts))] == want


def test_hard_texts():
    same([*HARD, None, ""])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(texts):
    same(texts)


@settings(max_examples=150, deadline=None)
@given(st.text("ab'stvrelmd \n\t1.é", max_size=60))
def test_boundaries_where_they_are_hard(text):
    same([text, text])


def test_round_trip_and_edges(spark):
    rows = [(i, t, 0) for i, t in enumerate([*HARD, None, "", HARD[0]])]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode(d, "doc_id", "text").collect()}
    assert all(decode(got[i]) == (t or "") for i, t, _ in rows) and got[len(HARD)] == got[len(HARD) + 1] == []
    assert {r.doc_id: r.tokens for r in count_tokens(d, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    for r in encode(d, "doc_id", "text", offsets=True).collect():
        t = rows[r.doc_id][1] or ""
        cuts = sorted(set(r.starts)) + [len(t)]
        assert len(r.starts) == len(r.ids)
        assert all(decode([i for i, s in zip(r.ids, r.starts) if s == a]) == t[a:b] for a, b in zip(cuts, cuts[1:]))
    assert encode(d.limit(0), "doc_id", "text").count() == 0


def test_sentences():
    assert sentences("One. Two!\nThree", "note") == ["One.", "Two!", "Three"]
    assert sentences("You: a. b\nBot: c", "chat") == ["a. b", "c"]


def corpus(n=160):
    words = {"x": ["the ball wins", "the goal scores", "the team plays"], "y": ["the nurse heals", "the dose helps", "the ward sleeps"]}
    fill = ["it rained today", "a nurse like patience", "keep it short"]
    docs = []
    for i in range(n):
        y = [{"x"}, {"y"}, {"x", "y"}][i % 3]
        body = [words[s][(i + k) % 3] + "." for s in sorted(y) for k in range(3)] + [fill[i % 3] + "."]
        docs.append((i, " ".join(body), "note", y))
    return docs


def test_held_out_subjects(spark):
    docs = corpus()
    d = spark.createDataFrame([(i, t, k, "z") for i, t, k, _ in docs] + [(900, None, None, "z"), (901, "", "note", "z"), (902, "the ball wins. it rained.", "note", "z")], "doc_id long, text string, doc_kind string, subject string")
    lab = spark.createDataFrame([(i, s) for i, _, _, y in docs[::2] for s in y] + [(None, "x"), (1, None), (docs[0][0], "x")], "doc_id long, subject string")
    sub = spark.createDataFrame([("x",), ("y",), (None,)], "subject string")
    got = {(r.doc_id, r.subject) for r in document_subjects(d, lab, sub).collect()}
    want = {(i, s) for i, _, _, y in docs for s in y}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert document_subjects(d, lab.limit(0), sub).count() == 0 and document_subjects(d.limit(0), lab, sub).count() == 0


def test_no_documents():
    assert fit_subjects([], ["x"]).subjects_of([None, "", "a b c"], [None] * 3) == [[], [], []]
