"""Keys that a third of the rows have, and numbers beyond 16 bits."""

from pyspark.sql import functions as F

from tidemark.llm import common, secrets, sharding


def test_more_shards_than_16_bits():
    held = sharding._dealt(0, tuple([1] * 40_000), 42)
    assert sorted(held.tolist()) == list(range(40_000))


def test_a_secret_that_a_third_of_the_rows_have(spark, monkeypatch):
    """The hot value's verdict is broadcast; results are those of a plain join."""
    texts = [(i, f"password=hunter2secret{i if i % 3 else 0}", f"s{i % 4}", "en") for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")
    plain = sorted(map(str, secrets.secret_spans(df).collect()))
    clean = sorted(r.text for r in secrets.redacted(df).collect())
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert sorted(map(str, secrets.secret_spans(df).collect())) == plain and sorted(r.text for r in secrets.redacted(df).collect()) == clean
    hot = [r for r in secrets.secret_spans(df).collect() if r.id % 3 == 0]
    assert {tuple(r.owners) for r in hot} == {(4,)} and {tuple(r.live) for r in hot} == {(False,)}
    assert secrets.ownership(df.select(F.lit(1).alias("hash"), F.col("source").alias("owner"), F.col("lang").alias("repository"))).first().n == 300


def test_repositories_decide(spark):
    """One owner with many repositories: a copied example, also where nobody else has the value."""
    rows = [(i, "token=abcdef123456", "one", f"repo{i}") for i in range(secrets.MOST_REPOSITORIES + 1)] + [(99, "token=zyxwvu654321", "one", "repo0")]
    got = {r.id: (r.owners[0], r.repositories[0], r.live[0]) for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[0] == (1, secrets.MOST_REPOSITORIES + 1, False) and got[99] == (1, 1, True)
