import numpy as np

from fieldcheck.llm import leaks
from fieldcheck.llm.text_queries import QUERIES


def test_edited_copies(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(90)]
    passages = [list(rng.choice(vocab, n)) for n in (24, 30, 64, 65, 90)]
    edits = lambda p, k, j: [f"other{i}" if i % k == j else w for i, w in enumerate(p)]
    docs = [list(p) for p in passages] + [edits(p, k, k - 1) for p in passages for k in (8, 6, 4, 3)] + [list(rng.choice(vocab, n)) for n in (3, 40, 200, 900)]
    docs += [list(rng.choice(vocab, 300)) + [w for x in p for w in (x, "between")] + list(rng.choice(vocab, 300)) for p in passages] + [[w for i, w in enumerate(p) if i % 5] for p in passages]
    spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(1000, None), (1001, " ".join(docs[5]))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)] + [(9, None)], "item_id long, passage string").write.parquet(str(tmp_path / "eval_items.parquet"))
    number = lambda x: np.array([leaks.word_number(w) for w in x])
    want = {}
    for i, p in enumerate(passages):
        for k, d in [*enumerate(docs), (1001, docs[5])]:
            score, run = leaks.align(number(d), number(p))
            if run >= 12 or score >= len(p):
                want[i, k] = (run, score)
    got = QUERIES["p9_leaks"](spark, str(tmp_path)).collect()
    assert {(r.item_id, r.doc_id): (r.run, r.score) for r in got} == want and len(got) == len(want)
    assert {(0, 5), (0, 1001), (0, 8)} <= set(want) and min(r for r, _ in want.values()) < 6


def test_recall_of_edited_copies(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocab = [f"v{i}" for i in range(400)]
    passages = [list(rng.choice(vocab, 40)) for _ in range(20)]
    docs, planted = [], {}
    for i, p in enumerate(passages):
        for share in (0.05, 0.1, 0.2):
            for _ in range(3):
                d = list(p)
                for k in rng.choice(len(p), round(share * len(p)), replace=False):
                    d[k] = ["gone", f"new{k}", d[k] + " more"][rng.integers(3)]
                planted.setdefault(share, set()).add((i, len(docs)))
                docs.append(list(rng.choice(vocab, 50)) + d + list(rng.choice(vocab, 50)))
    spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, passage string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = {(r.item_id, r.doc_id) for r in QUERIES["p9_leaks"](spark, str(tmp_path)).collect()}
    assert all(len(got & want) >= 0.9 * len(want) for want in planted.values())
