import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcheck.llm import leaks, packing, truncation
from fieldcheck.llm.text_queries import QUERIES


def test_words():
    t = "<p>The&nbsp;Ca­fe​ [quote=a b]is [b]ﬁne[/b]&amp;x</p> a < b [link] Ünder_score 12²"
    assert leaks.words(t) == ["the", "cafe", "is", "fine", "x", "a", "b", "link", "ünder", "score", "122"]
    assert leaks.words(None) == leaks.words("") == leaks.words("<br>—!") == []


def test_align():
    p = np.arange(1, 31)
    assert leaks.align(np.r_[[0, 0], p, [0]], p) == (60, 30)
    edited = np.r_[p[:10], [0], p[11:]]
    assert leaks.align(edited, p) == (57, 19)
    assert leaks.align(np.r_[p[:15], p[16:]], p)[1] == 15 and leaks.align(np.zeros(4, int), p) == (0, 0)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def runs(texts):
    for i, t in texts:
        x = leaks.words(t)
        for k in range(len(x) - 11):
            yield i, tuple(x[k : k + 12])


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)] + PASSAGE.split()
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[3:] + ["w1", "w2", "w3"])), (3, None), (4, ""), (5, "too short"), (6, " ".join(["w1"] * 20))]
    w = PASSAGE.split()
    docs = [(1, "x " + " ".join(w[:12])), (2, " ".join(w[:11]) + " w1"), (3, "<p>" + "</p>\n> ".join(w) + "</p>"), (4, None), (5, ""), (6, "w1 " * 5000), (7, "> " + PASSAGE.upper().replace(" ", " <b> ")), (8, " ".join(w[:7] + ["oops"] + w[8:]))]
    docs += [(100 + i, " ".join(rng.choice(vocab, 60)) + (" " + " ".join(w[2:14]) if i % 7 == 0 else "")) for i in range(60)] + [(300 + i, docs[0][1]) for i in range(30)]
    ix = {}
    for i, run in runs(items):
        ix.setdefault(run, set()).add(i)
    truth = {(i, d) for d, run in runs(docs) for i in ix.get(run, ())}
    a = spark.createDataFrame(docs, "id long, text string").withColumn("gram", F.lit(1)).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "id long, passage string").withColumn("doc_id", F.lit(1))
    got = leaks.leaked(a, "id", "text", b, "id", "passage").collect()
    assert {(r.item_id, r.doc_id) for r in got if r.run >= 12} == truth and (1, 3) in truth and (6, 6) in truth and (1, 2) not in truth
    assert [r.share for r in got if (r.item_id, r.doc_id) == (1, 8)] == [pytest.approx(27 / 30)]
    assert leaks.leaked(a.where("false"), "id", "text", b, "id", "passage").count() == leaks.leaked(a, "id", "text", b.where("false"), "id", "passage").count() == 0


def test_leaks_with_a_crowded_filter_are_the_same(spark, monkeypatch):
    a = spark.createDataFrame([(i, PASSAGE if i % 3 else "nothing of it in these six words") for i in range(9)], "id long, text string")
    b = spark.createDataFrame([(1, PASSAGE)], "id long, passage string")
    want = sorted(map(tuple, leaks.leaked(a, "id", "text", b, "id", "passage").collect()))
    monkeypatch.setattr(leaks, "FILTER_BITS", 5)
    assert sorted(map(tuple, leaks.leaked(a, "id", "text", b, "id", "passage").collect())) == want and len(want) == 6


def test_short_passages_and_escaped_tags(spark):
    a = spark.createDataFrame([(1, "it is too short, yes"), (2, "too long"), (3, "quoted: &lt;b&gt;too&lt;/b&gt; short &lt;span class=&quot;x&quot;&gt;now")], "id long, text string")
    b = spark.createDataFrame([(5, "too short"), (6, "short")], "id long, passage string")
    got = {(r.item_id, r.doc_id): r.share for r in leaks.leaked(a, "id", "text", b, "id", "passage").collect()}
    assert got == {(5, 1): 1, (5, 3): 1, (6, 1): 1, (6, 3): 1}


def test_hilbert_neighbours():
    n = 8
    p = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = packing.hilbert(p, 3)
    assert sorted(k) == list(range(n**3))
    o = p[np.argsort(k)]
    assert (np.abs(np.diff(o, axis=0)).sum(1) == 1).all()


def test_packing(spark):
    rng = np.random.default_rng(2)
    sizes = np.r_[rng.integers(1, 700, 900), [0, 0, 2048, 2049, 4096, 9000, 5], np.full(400, 37)]
    df = spark.createDataFrame([(i, int(t), int(rng.integers(0, 1 << 40)) if i < 907 else 5) for i, t in enumerate(sizes)], "doc_id long, tokens long, place long").withColumn("container", F.lit(1)).repartition(3)
    got = packing.packed(df).toPandas()
    by = got.groupby("doc_id")
    assert dict(by.tokens.sum()) == dict(enumerate(sizes.tolist()))
    assert got.groupby("container").tokens.sum().max() <= 2048 and (by.size()[sizes <= 2048] == 1).all()
    assert by.size()[905 - 0] >= 1 and dict(by.size())[int(np.flatnonzero(sizes == 9000)[0])] == 5
    for _, g in got.groupby("container"):
        g = g[g.tokens > 0].sort_values("start")
        assert (g.start.to_numpy()[1:] >= (g.start + g.tokens).to_numpy()[:-1]).all()
    f = packing.fill(packing.packed(df), 2048).first()
    assert f.containers <= f.least + 3 and f.tokens == sizes.sum()
    assert packing.packed(df.where("false")).count() == 0


def test_sized(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> " * 3000), (5, "hello world")], "id long, text string").withColumn("tokens", F.lit("clash"))
    got = {r.doc_id: (r.tokens, r.place) for r in packing.sized(df, "id", "text").collect()}
    assert got[1] == got[5] and got[1][0] == 2 and got[2] == got[3] and got[2][0] == 0 and got[4][0] > 3000


SENTENCES = ["The warm balloon drifted over the valley.", "A cold anemometer stood near the river!", "Nobody measured the thunder yesterday?"]


def test_truncation(spark):
    whole = [" ".join(SENTENCES), "Yes. :)", "See this\nhttp://a.example/img/12.png", "Log\n12:10   11.3  1013.2", "Log\n12:10 [i][/i]  11.3  1013.2", "Log\n12:10   11.3 &quot; 1013.2", "Log\n12:10&amp;   -1.3  <b></b> 1013.2", "<p>It was here</p>", "A short quote ...[/quote]\nThe river rose.", "It ended.\n-- \nann | Mk3 logger", "Buy now! 0abh2e", "It ended.\nregards, ann", None, "", "  \n", "雪大。", "Really!!!!!!!!", "He said &quot;no.&quot;"]
    cut = ["The warm ballo", "The warm balloon drifted over the", "The warm balloon drif...", "The warm balloon… ", "The warm balloon [more]", "The warm ball <b", "The warm ball [url=http", "The warm ball &am", "Log\n12:10   11.3  10", "The warm balloon dr�", "雪大", "See\nhttp://a.exampl", "It ended.\n-- \nann | Mk3 logg", "> -- \n> ann\nThe warm balloon drifted", "The warm balloon drifted over the valley. " * 2000 + "The ane"]
    data = [(i, t, "ann") for i, t in enumerate(whole)] + [(100 + i, t, "ann") for i, t in enumerate(cut)] + [(200 + i, f"{SENTENCES[i % 3]} http://a.example/img/12.png is a Mk3 logger link.", None) for i in range(60)] + [(300 + i, f"{SENTENCES[i % 3]}\nregards, ann{i % 4}", None) for i in range(20)]
    data += [(400 + i, f"{SENTENCES[i % 3]} Log {chr(97 + i)} of mine.\n0{i}:10  -{i}.3   99{i}.2", f"bob{i}") for i in range(6)]  # rows of tables are learned
    df = spark.createDataFrame(data, "doc_id long, text string, author string").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")).withColumn("last", F.lit(1)).withColumn("token", F.lit(1)).repartition(3)
    got = {r.key: r for r in truncation.cut_texts(df, "doc_id", "text", "source", "author").collect()}
    assert len(got) == len(data)
    assert [whole[k] for k in got if k < 100 and got[k].truncated] == []
    assert [cut[k - 100] for k in got if 100 <= k < 200 and not got[k].truncated] == []
    assert not any(got[k].truncated for k in got if k >= 200)
    assert (got[100].reason, got[101].reason, got[102].reason, got[105].reason) == ("word", "sentence", "mark", "markup")
    shares = {r.source: r for r in truncation.cut_shares(truncation.cut_texts(df, "doc_id", "text", "source")).collect()}
    assert shares["a"].n + shares[None].n == len(data)
    assert truncation.cut_texts(df.where("false"), "doc_id", "text", "source").count() == 0


def test_length_peaks(spark):
    d = [("a", 480)] * 50 + [("a", n) for n in range(440, 520)] + [(None, 7)] * 3
    got = {(r.source, r.length) for r in truncation.length_peaks(spark.createDataFrame(d, "s string, n int"), "s", "n").collect() if r.peak}
    assert got == {("a", 480)}


def test_trie_and_length_decide(spark):
    body = [f"Reading {chr(97 + i // 26)}{chr(97 + i % 26)} was taken near the river before the balloon." for i in range(60)]
    data = [(i, t, f"a{i}") for i, t in enumerate(body)]
    data += [(100, body[0] + " q7zxk2", "b"), (101, body[1] + " river", "b"), (102, body[2] + " riv", "b")]  # a code; a word and the beginning of one
    data += [(200 + i, (body[i] + " Then the anemo")[:40] + "x" * 30 + " riv", f"c{i}") for i in range(8)]  # 74 characters each, cut
    data += [(300, "A short note was written.\n-- \nMargaret of the " + "y" * 19 + " river".rjust(9), "d"), (301, "A short note was written.\n-- \nMargaret of the river", "e")]
    df = spark.createDataFrame(data, "id long, text string, author string").selectExpr("*", "'s' source")
    assert len(data[-2][1]) == 74
    got = {r.key: r.reason for r in truncation.cut_texts(df, "id", "text", "source", "author").collect()}
    assert [got[i] for i in (100, 101, 102)] == [None, "sentence", "word"] and not any(got[i] for i in range(60))
    assert got[200] == "word" and got[300] == "limit" and got[301] is None


def test_a_signature_inside_a_quote_signs_nothing_after_it(spark):
    data = [(1, "[quote=x]It was cold.\n-- \nann\nA ridge[/quote]\nThe trough is n", "b"), (2, "[quote=x]It was cold.\n-- \nann[/quote]\nIt rose.\n-- \nbob", "bob")]
    got = {r.key: r.truncated for r in truncation.cut_texts(spark.createDataFrame(data, "id long, text string, author string").selectExpr("*", "'s' source"), "id", "text", "source", "author").collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize("name", ["p9_found", "p10_found"])
def test_found_rows_are_distinct(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() == df.distinct().count()
