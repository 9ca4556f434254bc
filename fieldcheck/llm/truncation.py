"""Text cut off by field limits or in transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# Marks that are put where a text was cut.
MARKS = r"(?:\.\.\.|…|\[more\]|\(more\)|\(truncated\)|\[truncated\]|\[\.\.\.\]|\[…\]|\(\.\.\.\)|\(…\)|read more|\x{FFFD})$"
# Ends of whole texts, each at the end of the last line.
SENTENCE = r"[.!?。！？][\"'”’»)\]]*$"
SMILEY = r"(?:^|\s|[.!?])(?:[:;=8][-'^]?[)(\]\[/\\|DPpOo3*]+|<3|\^\^|[xX]D)$"
CLOSED_TAG = r"(?:</[a-zA-Z][a-zA-Z0-9]*>|\[/[a-zA-Z]+\])$"
LINK = r"(?:^|\s)https?://\S+$"
#: A lone lower-case token after the end of a sentence: a code if the trie doesn't know it, else a cut sentence.
AFTER_SENTENCE = r"[.!?][\"')]*\s+[\p{Ll}\p{N}]+$"
# Markup that is open where the text ends.
OPEN_MARKUP = r"(?:<[a-zA-Z/!][^<>]*|<|\[/?[a-zA-Z]*(?:=[^\]\s]*)?|&(?:#?[a-zA-Z0-9]{0,8}))$"
NOTICE = r"^\[[^\[\]]+\]$"
SEPARATOR = r"^(?:--\s?|_{3,}|-{3,}|—+)\s*$"
TAGS = r"<[^<>]*>|\[/?[a-zA-Z]+(?:=[^\[\]]*)?\]|&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);"
UNSEEN = "\u200b\u200c\u200d\ufeff\u00ad"
LINE_END = r"\n|\[/quote\]|</(?:p|blockquote)>"
QUOTE_END = r"(?i)</blockquote>|\[/quote\]"


def known_words(texts: DataFrame, text: str, least: int = 2) -> DataFrame:
    """``word, n``: words that stand in at least ``least`` texts, without the last word of each line or quote, which may be cut or a code.

    Counted over all texts, words of a text once; partial counts are made before the shuffle, so common words cost one row per task.
    """
    w = F.split(F.regexp_replace(F.lower(F.col(text)), LINE_END, " \u0001 "), r"[^\p{L}\p{N}\x01]+")
    after = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
    followed = F.zip_with("w", after, lambda a, b: F.when(~a.isin("", "\u0001") & ~b.isin("", "\u0001"), a))  # null where no word follows
    inner = F.array_distinct(F.array_compact(followed))
    return texts.where(F.col(text).isNotNull()).select(w.alias("w")).select(F.explode(inner).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def trie(words: DataFrame, longest: int) -> DataFrame:
    """``node, word``: every node of the trie of the words (each prefix of at most ``longest`` characters once), and if it is a word itself."""
    n = F.length("word")
    ends = F.explode(F.sequence(F.lit(1), F.least(n, F.lit(longest)))).alias("i")
    return words.select("word", n.alias("len"), ends).groupBy(F.expr("substring(word, 1, i)").alias("node")).agg(F.max((F.col("i") == F.col("len")).cast("int")).alias("is_word"))


def length_peaks(texts: DataFrame, source: str, length: str, sure: str | None = None, times: float = 5.0, least: int = 5, reach: int = 10, share: float = 0.2) -> DataFrame:
    """``source, length, peak, limit``: lengths that a source has ``times`` as often as the ``reach`` lengths on either side on average; a limit is a peak
    of which the share ``share`` of texts are ``sure`` to be cut, as the notices and stock phrases that also pile up at one length aren't."""
    n_sure = F.count(F.when(F.col(sure), 1)) if sure else F.lit(0)
    c = texts.groupBy(F.col(source).alias("source"), F.col(length).alias("length")).agg(F.count("*").alias("n"), n_sure.alias("n_sure"))
    w = Window.partitionBy("source").orderBy("length").rangeBetween(-reach, reach)
    around = (F.sum("n").over(w) - F.col("n")) / (2 * reach)
    c = c.withColumn("around", around).withColumn("peak", (F.col("n") >= least) & (F.col("n") > times * F.col("around")))
    return c.select("source", "length", "peak", (F.col("peak") & (F.col("n_sure") >= share * F.col("n")) & (F.col("n_sure") > 0)).alias("limit"))


def masked(line: Column, author: Column) -> Column:
    """What lines of one kind share: the author as ``@``, capitalised words as ``A``, numbers as ``9``, tags and character references as blanks, a name after a comma as ``@``.

    Numbers of a line without letters are only masked in rows of two or more fields, so that a number that stands alone is a phrase of its own.
    """
    x = F.regexp_replace(line, r"^[>|\s]+", "")
    x = F.coalesce(F.nullif(F.trim(F.regexp_replace(x, TAGS, " ")), F.lit("")), x)
    x = F.when(F.length(author) > 0, F.replace(x, author, F.lit("@"))).otherwise(x)
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{N}]*", "A")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    x = F.when(x.rlike(r"\p{L}|\S\s+\S"), F.regexp_replace(x, r"-?\p{N}+", "9")).otherwise(x)
    return F.nullif(F.regexp_replace(x, r",\s*\S+$", ", @"), F.lit(""))


def closing_lines(ends: DataFrame, share: float, least: int, unfinished: float = 0.1) -> DataFrame:
    """``shape``: masked last lines that end the share ``share`` of all distinct texts, and ``least`` texts of ``least`` authors.

    A shape that begins another and ends fewer than ``unfinished`` times its texts is a cut one, no closing line. Texts are counted once per words before
    the last line, so copies of one post teach nothing. As each text has one last line, at most 1 / ``share`` shapes come out; that bounds the table that is compared with itself.
    """
    counts = ends.select("head", "end").distinct().agg(F.count("*").alias("n_all"))
    # One row per distinct text and author, then per author, so that no task holds the texts or authors of a closing line.
    once = ends.where(F.col("shape").isNotNull()).select("shape", "by", F.when(F.col("notice"), F.xxhash64("key")).otherwise(F.col("head")).alias("head")).distinct()
    n_texts = once.select("shape", "head").distinct().groupBy("shape").agg(F.count("*").alias("n_shape")).where(F.col("n_shape") >= least)
    n_texts = n_texts.crossJoin(F.broadcast(counts)).where(F.col("n_shape") >= share * F.col("n_all")).drop("n_all")  # counts is one row
    n_authors = once.select("shape", "by").distinct().groupBy("shape").agg(F.count("*").alias("n_by")).where(F.col("n_by") >= least)
    found = written(n_texts.join(n_authors, "shape").select("shape", "n_shape"))
    other = F.broadcast(found.select(F.col("shape").alias("_longer"), F.col("n_shape").alias("_n")))  # at most 1 / share rows
    begins = F.col("_longer").startswith(F.col("shape")) & (F.col("_longer") != F.col("shape")) & (F.col("n_shape") < unfinished * F.col("_n"))
    return found.join(other, begins, "left_anti").select("shape")


def cut_texts(df: DataFrame, key: str, text: str, source: str, author: str | None = None, share: float = 1e-3, least: int = 3) -> DataFrame:
    """A row per text: ``key, source, length, truncated, reason`` and the evidence ``word``, ``peak`` and ``limit``.

    A text is whole if its last line ends in a sentence, smiley or closing tag. Three other ends are learned rather than listed: closing lines, signatures and rows of
    tables are masked last lines that many texts of several authors have in common (``closing_lines``); a token after the end of a sentence is a code if the
    trie of the corpus vocabulary has it neither as a word nor as the beginning of one; and lengths are field limits if a source piles up there and many of those texts surely are cut.
    At loose ends (closing line, line under a signature's mark, link) the trie and the length decide: an unknown proper prefix of known words means a cut, unless it
    is the author's name; so does a limit, unless the closing line is learned, a link or the author's name. A signature that ended inside a quote signs nothing after the quote.
    Otherwise a text is cut: at a mark, in open markup, in a word (the trie's evidence), at a field limit or in a sentence.
    Null, empty and blank texts are whole; null sources count as one source. Every text and every line is read whole. Joins are on keys that are all but unique,
    tokens and (source, length) are aggregated first.
    """
    t = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), (F.col(author) if author else F.lit(None).cast("string")).alias("author"))
    seen = F.replace("text", F.lit("&nbsp;"), F.lit(" "))
    for c in UNSEEN:
        seen = F.replace(seen, F.lit(c), F.lit(""))
    t = t.withColumn("body", F.rtrim(seen, F.lit(" \t\n\x0b\f\r")))
    body, lines = F.col("body"), F.split(F.substring_index("body", "\n", -4), "\n")  # the lines that can belong to a signature
    end = F.element_at(lines, -1)
    last = F.regexp_replace(end, r"(?:&quot;|&#34;|&#39;|&apos;)$", "'")
    n = F.size(lines)
    quoted = F.regexp_extract(last, r"^[>|\s]*", 0)
    unquoted = lambda x: F.substring(x, F.length(quoted) + 1, F.length(x))
    before = lambda i: F.when(n > i, F.get(lines, n - 1 - i))
    mark = lambda i: before(i).startswith(quoted) & unquoted(before(i)).rlike(SEPARATOR)
    plain = lambda i: (before(i) != "") & ~before(i).rlike(QUOTE_END)
    signed = F.coalesce((last != "") & (mark(1) | (plain(1) & (mark(2) | (plain(2) & mark(3))))), F.lit(False))
    head = F.regexp_replace(F.lower(F.substring(body, F.lit(1), F.length(body) - F.length(end))), r"[^\p{L}\p{N}]+", " ")
    ends = t.select(
        "key", "source", "author", F.length("text").alias("length"), (F.coalesce(body, F.lit("")) == "").alias("blank"), last.alias("last"),
        signed.alias("signed"), F.xxhash64(F.trim(head)).alias("head"), F.coalesce(~body.contains("\n") & last.rlike(NOTICE), F.lit(False)).alias("notice"),
    )
    last = F.col("last")
    token = F.lower(F.regexp_extract(last, r"((?<![\p{L}\p{N}])[\p{L}\p{N}]+)$", 1))
    ends = ends.withColumn("token", token)
    for name, pattern in (("mark", MARKS), ("sentence", SENTENCE), ("link", LINK), ("open", OPEN_MARKUP), ("after", AFTER_SENTENCE)):
        ends = ends.withColumn(name, last.rlike(pattern))
    ends = ends.withColumn("firm", F.col("sentence") | last.rlike(SMILEY) | last.rlike(CLOSED_TAG))
    ends = ends.withColumn("own", F.coalesce(last.endswith(F.col("author")), F.lit(False))).withColumn("shape", F.when(~F.col("sentence") & ~F.col("mark"), masked(last, F.col("author"))))
    ends = ends.withColumn("end", F.xxhash64("last")).withColumn("by", F.when(F.col("author").isNotNull(), F.xxhash64("author")).otherwise(F.col("head")))
    ends = written(ends.drop("author", "last"))  # small rows that the aggregates below read
    closing = closing_lines(ends, share, least).withColumn("formula", F.lit(True))
    longest = ends.agg(F.max(F.length("token"))).first()[0] or 1  # longer prefixes can't be a token
    nodes = trie(known_words(t, "text"), longest).join(ends.select(F.col("token").alias("node")).where("node <> ''").distinct(), "node", "left_semi").select(F.col("node").alias("token"), (F.col("is_word") == 0).alias("word"))
    x = ends.join(F.broadcast(closing), "shape", "left").join(nodes, "token", "left")  # at most 1 / share closing lines
    known, formula = F.col("word").isNotNull(), F.coalesce("formula", F.lit(False))
    word = F.coalesce("word", F.lit(False)) & ~(formula & ~F.col("shape").rlike("[@A]$"))  # the last word of a learned line is complete
    loose = F.col("signed") | formula | F.col("link")
    x = x.withColumn("code", F.col("after") & ~known).withColumn("sure", F.col("mark") | (~F.col("firm") & ~loose & (F.col("open") | (word & ~F.col("code")))))
    x = written(x.select("key", "source", "length", "blank", "mark", "firm", "own", "open", "link", "code", "sure", word.alias("word"), formula.alias("formula"), loose.alias("loose")))
    limits = length_peaks(x, "source", "length", "sure").select(F.col("source").alias("_s"), F.col("length").alias("_l"), "peak", "limit")
    x = x.join(limits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("length") == F.col("_l")), "left")
    limit = F.coalesce("limit", F.lit(False))
    at_limit = limit & ~F.col("formula") & ~F.col("link")
    reason = (
        F.when(F.col("blank"), None)
        .when(F.col("mark"), "mark")
        .when(F.col("firm") | F.col("code"), None)
        .when(F.col("loose") & (F.col("own") | ~(F.col("word") | at_limit)), None)
        .when(F.col("open") & ~F.col("formula"), "markup")
        .when(F.col("word"), "word")
        .when(limit, "limit")
        .otherwise("sentence")
    )
    return x.select("key", "source", "length", reason.isNotNull().alias("truncated"), reason.alias("reason"), "word", F.coalesce("peak", F.lit(False)).alias("peak"), limit.alias("limit"))


def cut_shares(cut: DataFrame) -> DataFrame:
    """``source, n, n_truncated, share, n_at_peak, n_at_limit``: how often each source truncates, and how many of the cut texts have a peak length or stand at a field limit."""
    n = F.count(F.when(F.col("truncated"), 1))
    at = lambda c: F.count(F.when(F.col("truncated") & F.col(c), 1))
    return cut.groupBy("source").agg(F.count("*").alias("n"), n.alias("n_truncated"), F.round(n / F.count("*"), 6).alias("share"), at("peak").alias("n_at_peak"), at("limit").alias("n_at_limit"))
