from loomtok.plans.reference import QUERIES


def test_every_word_has_an_entropy(spark, data):
    n = QUERIES["word_totals"](spark, data).first().n_words
    assert n > 500 and QUERIES["token_entropy_all"](spark, data).count() == n
