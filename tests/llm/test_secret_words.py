"""Ordinary words in a credential context are no secrets."""

from lastrum.llm import secrets


def test_words_of_the_documents_are_cheap(spark):
    prose = [(i, "The string is required here; an identifier follows.") for i in range(3)]
    given = ["token: string", "auth: required", "secret = Identifier", "password: Zk3vQ9xLm2", "token: xkqjvbwzpf", "token: xkqjvbwzpf", "token: xkqjvbwzpf", "token: xkqjvbwzpf"]
    docs = spark.createDataFrame([*prose, *((i + 10, t) for i, t in enumerate(given))], "doc_id long, text string")
    got = {r.doc_id: r.n_guess for r in secrets.digest(secrets.scan(docs)).collect()}
    assert [got[i + 10] for i in range(len(given))] == [0, 0, 0, 1, 1, 1, 1, 1]


def test_vocabulary(spark):
    docs = spark.createDataFrame([("b b aaa bbb",), ("AAA bbb x9abc",), ("aaa ccc token=abcdefgh",), ("aaa abcdefgh",), (None,)], "text string")
    assert secrets.vocabulary(docs, least_docs=2) == ["aaa", "bbb"] and secrets.vocabulary(docs, 1, 1) == ["aaa"]


def test_short_values_of_dear_characters():
    assert secrets.spans('password: "éçüñø"') == [(11, 3, 16)] and secrets.spans("pwd=éçü") == [] and secrets.spans("pwd=Zk3v") == []
    assert secrets.guess_cost("éçüñ") <= secrets.LEAST_COST and secrets.guess_cost("éçü") < secrets.LEAST_COST
