"""Evaluation passages in training text: rare n-gram seeds, then local alignment."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Markup that counts as a space, characters that count as nothing, and what a word is.
MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|\[/?(?:b|i|u|s|url|img|quote|size|colou?r|font|code|list|center|spoiler|email|\*)(?:[= ][^\[\]]*)?\]", re.IGNORECASE | re.DOTALL)
UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter of passage n-grams that every task gets, whatever their number (8 MB); hits are joined exactly afterwards.
FILTER_BITS = 26
#: Passages that are compared with a text at once, all of about one length.
TOGETHER = 50


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, lower case, after markup (also where its brackets are character references), references, NFKC and unseen characters are dealt with."""
    if not text:
        return []
    t = MARKUP.sub(" ", text)
    if "&" in t:
        t = MARKUP.sub(" ", html.unescape(t))
    if not t.isascii():
        t = UNSEEN.sub("", unicodedata.normalize("NFKC", t))
    return WORD.findall(t.lower())


def word_number(w: str) -> int:
    """A 63-bit number of a word, the same in every task."""
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") >> 1


def ngrams(numbers: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` word numbers."""
    m = len(numbers) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    x = numbers.astype(np.uint64)
    h = np.full(m, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * BASE + x[j : j + m]
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def passage_words(items: DataFrame, key: str, passage: str) -> DataFrame:
    """``item_id, numbers``: the word numbers of each passage; null and wordless passages are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, [word_number(w) for w in words(t)]) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["item_id", "numbers"])

    return items.select(F.col(key).cast("long"), passage).mapInPandas(run, "item_id long, numbers array<long>")


def passage_grams(passages: DataFrame, n: int, window: int) -> DataFrame:
    """``item_id, window_no, size, gram``: for each run of ``window`` words of a passage (or the whole, if shorter), the hashes of its n-grams; a passage of fewer than ``n`` words is one gram of its own size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x in zip(b["item_id"], b["numbers"], strict=True):
                size = min(n, len(x))
                g = ngrams(np.asarray(x, np.int64), size)
                reach = min(window, len(x)) - size + 1
                out += [(i, w, size, int(v)) for w in range(len(g) - reach + 1) for v in g[w : w + reach]]
            yield pd.DataFrame(out, columns=["item_id", "window_no", "size", "gram"])

    return passages.mapInPandas(run, "item_id long, window_no int, size int, gram long")


def gram_filter(grams: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The sizes of the grams, and a filter of 2 ** FILTER_BITS bits with the bit of each gram set, as its words that aren't zero and their places.

    Its size is fixed, so what reaches the driver and the tasks doesn't grow with the passages; with very many of them it lets more n-grams pass to the exact join.
    """
    bit = F.pmod("gram", F.lit(1 << FILTER_BITS)).cast("long")
    w = grams.groupBy(F.shiftright(bit, 5).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(gram, {1 << FILTER_BITS}) % 32 as int)))").alias("bits")).toPandas()
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n
    return sizes, w["at"].to_numpy(np.int64), w["bits"].to_numpy(np.int64)


def text_hits(texts: DataFrame, key: str, text: str, grams: DataFrame) -> DataFrame:
    """``doc_id, sig, numbers, grams``: texts that may hold any of the n-grams, with their word numbers, those n-grams, and a signature shared by equal word sequences.

    Texts are read and split into words once; their n-grams are held against a filter of fixed size, so all but a few texts without hit end here. What passes is joined exactly by the caller.
    """
    sizes, at, bits = gram_filter(grams)
    kind = pa.schema([("doc_id", pa.int64()), ("sig", pa.string()), ("numbers", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        held[at] = bits
        seen: dict[str, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                yield found(part.column(0).to_pylist(), [words(t) for t in part.column(1).to_pylist()], seen, held)

    def found(doc_ids: list[int], texts_words: list[list[str]], seen: dict[str, int], held: np.ndarray) -> pa.RecordBatch:
        """The hits among some texts, whose n-grams are hashed and looked up all at once."""
        if len(seen) > 500_000:
            seen.clear()
        for ws in texts_words:
            for w in ws:
                if w not in seen:
                    seen[w] = word_number(w)
        ends = np.cumsum([len(ws) for ws in texts_words])
        x = np.fromiter((seen[w] for ws in texts_words for w in ws), np.int64, int(ends[-1]) if len(ends) else 0)
        docs, hits = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in sizes:
            g = ngrams(x, n)
            bit = g & ((1 << FILTER_BITS) - 1)
            ok = np.flatnonzero((held[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1)
            doc = np.searchsorted(ends, ok, "right")
            inside = ok + n <= ends[doc] if len(ok) else np.zeros(0, bool)
            docs.append(doc[inside])
            hits.append(g[ok[inside]])
        doc, g = np.concatenate(docs), np.concatenate(hits)
        o = np.argsort(doc, kind="stable")
        doc, g = doc[o], g[o]
        ids, sigs, nums, grams_of = [], [], [], []
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, int)
        for a, e in zip(edge[:-1], edge[1:], strict=True):
            k = doc[a]
            y = x[ends[k] - len(texts_words[k]) : ends[k]]
            ids.append(doc_ids[k])
            sigs.append(hashlib.blake2b(y.tobytes(), digest_size=16).hexdigest())
            nums.append(y)
            grams_of.append(np.unique(g[a:e]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.string()), pa.array(nums, kind.field(2).type), pa.array(grams_of, kind.field(3).type)], schema=kind)

    return texts.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, sig string, numbers array<long>, grams array<long>")


def align(doc: np.ndarray, passage: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> tuple[int, int]:
    """The best local alignment score (Smith-Waterman, linear gaps) and the longest run of equal words, row by row of the passage."""
    m = len(doc)
    h, run, at = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), gap * np.arange(m + 1)
    best = longest = 0
    for w in passage:
        same = doc == w
        e = np.zeros(m + 1, np.int64)
        e[1:] = np.maximum(h[:-1] + np.where(same, match, -miss), h[1:] - gap)
        np.maximum(e, 0, out=e)
        h = np.maximum.accumulate(e + at) - at
        run[1:] = np.where(same, run[:-1] + 1, 0)
        best, longest = max(best, int(h.max())), max(longest, int(run.max()))
    return best, longest


def best_scores(doc: np.ndarray, passage: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> np.ndarray:
    """The scores of ``align`` for many pairs at once: rows of ``doc`` and ``passage``, padded with numbers that equal nothing."""
    h, at = np.zeros((len(doc), doc.shape[1] + 1), np.int32), gap * np.arange(doc.shape[1], dtype=np.int32)
    best = np.zeros(len(doc), np.int32)
    for w in passage.T:
        e = np.maximum(h[:, :-1] + np.where(doc == w[:, None], np.int32(match), np.int32(-miss)), np.maximum(h[:, 1:] - gap, 0))
        h[:, 1:] = np.maximum.accumulate(e + at, axis=1) - at
        np.maximum(best, h.max(1), out=best)
    return best


def common_words(words_at: np.ndarray, lengths: np.ndarray, row: np.ndarray, masks: np.ndarray, owner: np.ndarray, item: np.ndarray) -> np.ndarray:
    """At least the longest common subsequence of pairs of a text (``row``) and a passage (``item``), bit-parallel over all pairs.

    ``words_at`` has the words of the texts by position and ``masks`` the places of each word in pieces of at most 64 words of
    passages (``owner``, sorted); the subsequences of a passage's pieces are added, which is never too little.
    """
    first = np.searchsorted(owner, item)
    pieces = np.searchsorted(owner, item, "right") - first
    pair = np.repeat(np.arange(len(row)), pieces)
    piece = np.repeat(first - np.cumsum(pieces) + pieces, pieces) + np.arange(len(pair))
    order = np.argsort(-lengths[row[pair]], kind="stable")
    pair, piece = pair[order], piece[order]
    text = row[pair]
    active = np.searchsorted(-lengths[text], -np.arange(len(words_at)), "left")
    v = np.full(len(pair), np.iinfo(np.uint64).max, np.uint64)
    for t, k in enumerate(active):
        u = v[:k] & masks[words_at[t, text[:k]], piece[:k]]
        v[:k] = (v[:k] + u) | (v[:k] - u)
    return np.bincount(pair, np.bitwise_count(~v), len(row))


class Searched:
    """Some passages of about one length, prepared to find every text whose alignment with one reaches ``share`` of a full copy.

    A score of ``share`` needs share * L words of the passage in order, within (3 - 2 * share) * L words of the text: with M equal words and E errors
    2M - E >= 2 * share * L and M <= L. So overlapping windows of the text are held against the passages, first by the words they have, then by the words
    they have in order, then aligned. None of these steps can lose a text.
    """

    def __init__(self, ids: list[int], passages: list[np.ndarray], n_words: int, share: float) -> None:
        self.ids, self.passages = ids, passages
        lengths = np.array([len(p) for p in passages])
        self.need, self.score = share * lengths - 1e-6, 2 * share * lengths - 1e-6
        longest = int(lengths.max())
        self.reach, self.step = int(np.ceil((3 - 2 * share) * longest)), max(1, longest // 2)
        pieces = [(c, p[b : b + 64]) for c, p in enumerate(passages) for b in range(0, len(p), 64)]
        self.owner = np.array([c for c, _ in pieces])
        self.masks = np.zeros((n_words + 1, len(pieces)), np.uint64)
        for q, (_, p) in enumerate(pieces):
            np.bitwise_or.at(self.masks[:, q], p, np.uint64(1) << np.arange(len(p), dtype=np.uint64))
        self.counts = np.stack([np.bincount(p, minlength=n_words + 1) for p in passages], 1).astype(np.float32)
        self.padded = np.full((len(passages), longest), -1, np.int32)
        for c, p in enumerate(passages):
            self.padded[c, : len(p)] = p

    def pairs(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, passage) positions of all that reach the share. Texts are word positions in the vocabulary of all passages, its size standing for other words."""
        windows = [(k, x[s : s + self.reach + self.step]) for k, x in enumerate(texts) for s in range(0, max(1, len(x) - self.reach), self.step)]
        other = len(self.masks) - 1
        out: set[tuple[int, int]] = set()
        for begin in range(0, len(windows), 2000):
            some = windows[begin : begin + 2000]
            has = np.zeros((len(some), other + 1), np.float32)
            for r, (_, x) in enumerate(some):
                has[r, x] = 1
            row, item = np.nonzero(has @ self.counts >= self.need)
            if not len(row):
                continue
            known = [x[x < other] for _, x in some]
            lengths = np.array([len(x) for x in known])
            words_at = np.full((lengths.max(), len(some)), other, np.int32)
            for r, x in enumerate(known):
                words_at[: len(x), r] = x
            ok = common_words(words_at, lengths, row, self.masks, self.owner, item) >= self.need[item]
            row, item = row[ok], item[ok]
            for at in range(0, len(row), 500):
                r, c = row[at : at + 500], item[at : at + 500]
                doc = np.full((len(r), max(len(some[k][1]) for k in r)), other, np.int32)
                for k, i in enumerate(r):
                    doc[k, : len(some[i][1])] = some[i][1]
                good = best_scores(doc, self.padded[c]) >= self.score[c]
                out |= {(some[i][0], int(j)) for i, j in zip(r[good], c[good], strict=True)}
        return out


def alike(texts: DataFrame, key: str, text: str, passages: DataFrame, share: float, n: int) -> DataFrame:
    """``item_id, doc_id, run, score, share`` of every text whose alignment with a passage of at least ``n`` words reaches ``share``, whatever runs are left intact.

    The passages, a table of fixed size, are sent to every task, where texts are read once and nothing is shuffled; texts of equal words are aligned once per 1,000.
    """
    rows = sorted(((r.item_id, np.asarray(r.numbers, np.int64)) for r in passages.collect() if len(r.numbers) >= n), key=lambda r: len(r[1]))
    vocabulary = {w: k for k, w in enumerate(sorted({int(w) for _, p in rows for w in p}))}
    items = [(i, np.array([vocabulary[int(w)] for w in p], np.int32)) for i, p in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = len(vocabulary)
        groups = [Searched([i for i, _ in items[g : g + TOGETHER]], [p for _, p in items[g : g + TOGETHER]], other, share) for g in range(0, len(items), TOGETHER)]
        seen: dict[str, int] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                if len(seen) > 500_000:
                    seen.clear()
                same: dict[bytes, list[int]] = {}
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ws = words(t)
                    for w in ws:
                        if w not in seen:
                            seen[w] = vocabulary.get(word_number(w), other)
                    same.setdefault(np.array([seen[w] for w in ws], np.int32).tobytes(), []).append(d)
                bodies, docs, out = [np.frombuffer(x, np.int32) for x in same], list(same.values()), []
                for g in groups:
                    for k, c in g.pairs(bodies):
                        p = g.passages[c]
                        score, longest = align(bodies[k], p)
                        out += [(g.ids[c], d, longest, score, score / (2 * len(p))) for d in docs[k]]
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=kind.names), schema=kind, preserve_index=False)

    kind = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("run", pa.int32()), ("score", pa.int32()), ("share", pa.float64())])
    return texts.select(F.col(key).cast("long"), text).mapInArrow(run, "item_id long, doc_id long, run int, score int, share double")


def leaked(texts: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, window: int = 12, n: int = 6, least: float | None = None, salts: int = 8, seeds_each: int = 3) -> DataFrame:
    """``item_id, doc_id, run, score, share``: text-passage pairs that share a rare seed, aligned; with ``least`` also all whose ``share`` reaches it, seed or not.

    Of each run of ``window`` words of a passage the ``seeds_each`` n-grams that the fewest texts hold are seeds (one is enough for whole runs, more find more edited copies), so every text that
    holds ``window`` consecutive words of a passage holds a seed of it, and common phrases seed nothing where rarer ones stand in the
    window. Texts with a seed are aligned with the passage: ``run`` is the longest run of equal words, ``score`` the local alignment score, ``share`` the
    score over that of a full copy; edited and paraphrased copies score high with short runs. Such copies may hold no seed, so they are only whole with ``least``.
    Texts of the same word sequence are aligned once and each come out, spread over ``salts`` tasks. One plan serves every number of passages.
    Null and empty texts hold nothing; repeated items each come out; a passage of fewer than ``n`` words is found where it stands whole.
    """
    passages = written(passage_words(items, item, passage))
    grams = written(passage_grams(passages, n, window))
    hits = written(text_hits(texts, key, text, grams))
    held = written(hits.select("doc_id", "sig", F.explode("grams").alias("gram")).join(grams.select("gram").distinct(), "gram"))
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = grams.select("item_id", "window_no", "gram").join(df, "gram").groupBy("item_id", "window_no").agg(F.collect_set(F.struct("df", "gram")).alias("s"))  # at most window - n + 1 grams each
    seeds = ranked.select("item_id", F.explode(F.slice(F.array_sort("s"), 1, seeds_each)).alias("s")).select("item_id", F.col("s.gram").alias("gram")).distinct()
    pairs = held.select("sig", "gram").distinct().join(seeds, "gram").select("sig", "item_id").distinct()
    bodies = hits.groupBy("sig").agg(F.first("numbers").alias("numbers"))
    full = pairs.join(bodies, "sig").join(passages.withColumnRenamed("numbers", "passage"), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                p = np.asarray(r.passage, np.int64)
                score, longest = align(np.asarray(r.numbers, np.int64), p)
                rows.append((r.item_id, r.sig, longest, score, score / (2 * len(p))))
            yield pd.DataFrame(rows, columns=["item_id", "sig", "run", "score", "share"])

    scored = full.select("item_id", "sig", "numbers", "passage").mapInPandas(run, "item_id long, sig string, run int, score int, share double")
    scored = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    posts = hits.select("doc_id", "sig", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    seeded = scored.join(posts, ["sig", "salt"]).select("item_id", "doc_id", "run", "score", "share")
    return seeded if least is None else seeded.unionByName(alike(texts, key, text, passages, least, n)).distinct()
