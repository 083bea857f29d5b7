"""Plans that the driver holds: every stage that ends gives it the whole plan again, so none may nest others many times."""

from __future__ import annotations

from hearthline.llm import mixing, ngram_join


def shuffles(df, capsys) -> int:
    """Shuffles and broadcasts in the plan; parts that adaptive execution may use again count each time."""
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.count("Exchange ")


def documents(spark):
    texts = [" ".join(f"w{(k // 3) * 7 + i}" for i in range(30 + k % 3)) for k in range(30)]
    return spark.createDataFrame([(k, text, f"s{k % 4}") for k, text in enumerate(texts)], "doc_id bigint, text string, source string")


def test_the_plan_of_the_mix_does_not_nest_its_small_tables(spark, capsys):
    assert shuffles(mixing.take(documents(spark)), capsys) <= 12


def test_no_plan_of_the_join_nests_others(spark, monkeypatch, capsys):
    sizes = []

    def counted(function):
        def call(df, *args):
            sizes.append(shuffles(df, capsys))
            return function(df, *args)

        return call

    monkeypatch.setattr(ngram_join, "stored", counted(ngram_join.stored))
    monkeypatch.setattr(ngram_join, "components", counted(ngram_join.components))
    assert ngram_join.keep_one(documents(spark)).count() == 10
    assert max(sizes) <= 16, sizes
