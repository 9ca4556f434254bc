from fieldcheck.llm import truncation


def test_copies_of_a_cut_post_are_no_closing_line(spark):
    cut = "The warm balloon drifted over the valley.\n> Nobody measured the\nrain over the"
    data = [(i, cut if i % 2 else cut.replace(".", " ..."), f"a{i % 50}") for i in range(1000)]
    data += [(2000 + i, f"Reading {i} was taken in the valley, rain over the river.\nbye for now", f"b{i % 9}") for i in range(1000)]
    data += [(4000 + i, "[removed here]", f"c{i % 9}") for i in range(20)]
    got = {r.key: r.truncated for r in truncation.cut_texts(spark.createDataFrame(data, "id long, text string, author string").selectExpr("*", "'s' source"), "id", "text", "source", "author").collect()}
    assert all(got[i] for i in range(1000)) and not any(v for k, v in got.items() if k >= 2000)
