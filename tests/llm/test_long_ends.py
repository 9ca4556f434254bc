from fieldcheck.llm import truncation


def test_ends_beyond_400_characters(spark):
    word = "x" * 25 + "y" * 25
    data = [(1, "Seen here\nhttp://a.example/" + "p" * 700 + "/1"), (2, f"It was {word} here."), (3, f"That {word} again."), (4, "It ended.\n-- \nann " + word[:45]), (5, "It ended.\n-- \nann " + word)]
    df = spark.createDataFrame(data, "id long, text string").selectExpr("*", "'s' source")
    assert {r.key: r.reason for r in truncation.cut_texts(df, "id", "text", "source").collect()} == {1: None, 2: None, 3: None, 4: "word", 5: None}
