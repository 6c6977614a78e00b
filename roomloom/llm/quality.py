"""Quality rules: cross-document line frequency, in DataFrame functions only.

Each document gives its distinct normalised lines, as hashes, and for each host the
documents that hold a line are counted.  A line is common when it occurs in at least
``min_docs`` documents and either more than ``max_share`` of the host's or at least
``max_docs``: that limit does not grow with the host.  It must also stand in at
least ``min_texts`` different texts, as the lines of one text that was copied many
times are no boilerplate: copies are the business of near-dedup.  Copies are counted
together before lines are taken apart.  Up to ``max_broadcast_lines`` common lines in all, they
are broadcast in buckets of about 32 a host, and texts are judged in place: no
text is shuffled.  Beyond, each distinct text is joined with its own common
lines, by host and line with the texts dealt over salts, and the documents with
the result by host and text.

A document is rejected when it fails the base rules or is depleted: it has
common lines and, without them, fewer than ``min_words`` words or less than
``min_left`` of its words.

Defined cases: a null text is empty and fails (no words); a null host is a host
of its own; repeated rows are documents of their own, judged alike; an empty table
gives no rows; columns of the input are kept, except that they are replaced by
an output column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, if_small, let, words, written

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"


def _has_word(line: Column) -> Column:
    return F.translate(line, _SPACES, "") != ""


def n_repeat_words(word: Column, window: int = 5) -> Column:
    """Words covered by windows found twice or more; ``word`` is an array column.

    Windows are compared as 64-bit hashes.  Only texts with an equal pair sort
    them with their places.
    """
    none = F.lit(0).cast("long")

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

        def length(at: Column) -> Column:
            step = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(window)), F.lit(window)))
            return F.aggregate(step, none, lambda a, x: a + x)

        return let(placed, lambda s: let(repeated(s), length))

    hashes = F.transform(F.sequence(F.lit(0), F.size(word) - window), lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(window))))
    return F.when(F.size(word) < window + 1, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    )


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), _has_word)
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("r")))
    return let(
        by_words,
        lambda b: F.struct(
            b["n"].alias("n_words"),
            F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            b["r"].alias("n_repeat_words"),
        ),
    )


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " "))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text_col, F.length(text_col))


def distinct_texts(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """(host, text_hash, lines, copies): each distinct text of a host with its distinct lines' hashes and its documents."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), normalised), lambda x: x != "")
    return docs.select(
        F.col(host_col).alias("host"), text_hash(text_col).alias("text_hash"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines")
    ).groupBy("host", "text_hash").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))


def common_lines(texts: DataFrame, max_share: float, min_docs: int, max_docs: int, min_texts: int) -> DataFrame:
    """(host, line): the hashes of the hosts' common lines."""
    hosts = if_small(written(texts.groupBy("host").agg(F.sum("copies").alias("n_docs"))))
    counted = texts.select("host", "copies", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("texts"), F.sum("copies").alias("n"))
    often = counted.filter((F.col("texts") >= min_texts) & (F.col("n") >= min_docs))
    common = (F.col("n") > max_share * F.col("n_docs")) | (F.col("n") >= max_docs)
    return often.alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host"))).filter(common).select("c.host", "line")


def bucketed(common: DataFrame) -> DataFrame:
    """(host, common): a host's lines in an array of buckets, by the hash modulo their number."""
    sizes = common.groupBy("host").agg(F.ceil(F.count("*") / 32).cast("long").alias("n"))
    placed = common.alias("c").join(sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host"))).select("c.host", F.pmod("line", "n").alias("bucket"), "line")
    every = sizes.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bucket"), F.lit(None).cast("long").alias("line"))
    buckets = placed.unionByName(every).groupBy("host", "bucket").agg(F.collect_list("line").alias("own"))
    return buckets.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("bucket", "own"))).alias("all")).select("host", F.transform("all", lambda x: x["own"]).alias("common"))


def own_lines(texts: DataFrame, common: DataFrame, salts: int = 32) -> DataFrame:
    """(host, text_hash, common): those common lines that a text holds, in buckets of about 32."""
    lines = texts.select("host", "text_hash", F.explode("lines").alias("line"), F.pmod("text_hash", F.lit(salts)).alias("salt")).alias("l")
    spread = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).alias("c")
    held = lines.join(spread, F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.line") == F.col("c.line")) & (F.col("l.salt") == F.col("c.salt")))
    own = held.groupBy("l.host", "text_hash").agg(F.collect_list("l.line").alias("own"))
    n = F.ceil(F.size("own") / 32).cast("long")
    in_bucket = lambda k: F.filter("own", lambda x: F.pmod(x, n) == k)
    return own.select("host", "text_hash", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), in_bucket).alias("common"))


def judge(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_share: float = 0.05,
    min_docs: int = 10,
    max_docs: int = 50,
    min_texts: int = 10,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_left: float = 0.3,
    max_broadcast_hosts: int = 20_000,
    max_broadcast_lines: int = 1_000_000,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_left_words (outside common lines), clean_text (without them) and kept.

    Common lines are broadcast up to ``max_broadcast_hosts`` hosts with any and
    ``max_broadcast_lines`` lines, and joined by host and text beyond.
    """
    texts = written(distinct_texts(docs, host_col, text_col))
    common = written(common_lines(texts, max_share, min_docs, max_docs, min_texts))
    size = common.agg(F.count("*").alias("lines"), F.count_distinct(F.struct("host")).alias("hosts")).first()
    base, host, hashed, found, clean = fresh(docs, "_base", "_host", "_hash", "_common", "_clean")
    same = F.col(host_col).eqNullSafe(F.col(host))
    if size.lines <= max_broadcast_lines and size.hosts <= max_broadcast_hosts:
        hosts = F.broadcast(written(bucketed(common)).withColumnsRenamed({"host": host, "common": found}))
    else:
        hosts = written(own_lines(texts, common)).withColumnsRenamed({"host": host, "text_hash": hashed, "common": found})
        same &= text_hash(text_col) == F.col(hashed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    among = lambda h: F.array_contains(F.get(found, F.pmod(h, F.size(found).cast("long")).cast("int")), h)
    left_lines = F.filter(F.split(text, "\n"), lambda x: ~let(F.xxhash64(normalised(x)), among))
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left_words", "clean_text", "kept")
    old = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    counted = docs.withColumn(base, base_counts(F.col(text_col)))
    joined = counted.join(hosts, same, "left")
    judged = joined.withColumn(clean, F.when(F.col(found).isNull(), text).otherwise(F.array_join(left_lines, "\n")))
    left = F.when(F.col(clean) == text, F.col(f"{base}.n_words")).otherwise(F.size(words(F.col(clean)))).cast("long")
    judged = judged.select(*old, f"{base}.*", F.col(clean).alias("clean_text"), left.alias("n_left_words")).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    depleted = (F.col("n_left_words") < F.col("n_words")) & ((F.col("n_left_words") < min_words) | (F.col("n_left_words") < min_left * F.col("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted)
