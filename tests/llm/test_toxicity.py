"""Toxicity without caps: long words that begin alike are told apart, and every telling word is learnt."""

from signalmill.llm import toxicity


def tables(spark, docs):
    """docs: (text, toxic)"""
    rows = [(k, t) for k, (t, _) in enumerate(docs)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(k, y) for k, (_, y) in enumerate(docs)], "doc_id long, toxic int")


def test_long_words_stay_whole(spark):
    head = "q" * 70
    assert toxicity.names(head + "bad")[0] == head + "bad"
    docs = [(f"some words {head}bad here number {'abc'[k % 3]}", 1) for k in range(30)] + [(f"some words {head}good here number {'abc'[k % 3]}", 0) for k in range(300)]
    model = toxicity.train(*tables(spark, docs))
    assert head + "bad" in model.weights and head + "good" not in model.weights
    assert model.score(docs[0][0])[0] > 0.7 > 0.3 > model.score(docs[-1][0])[0]


def test_every_telling_word_is_learnt(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    telling = [f"{a}{b}{c}z" for a in letters for b in letters for c in "abcd"]  # 2,704 words
    docs = [(" ".join(telling[k % 3 :: 3]), 1) for k in range(30)] + [(f"plain text of {letters[k % 26]} words", 0) for k in range(400)]
    model = toxicity.train(*tables(spark, docs))
    assert set(telling) <= set(model.weights)
    assert model.score(" ".join(telling[-9:]))[0] > 5 * model.score("plain text of x words")[0]
