"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

An item's windows are all runs of `width` consecutive words, or the whole item if it has fewer. A window occurs in a
document only if all of its words do, in order and next to each other, so one word is a sufficient prefix: the one that
is rarest in the documents. Words are ordered by their counts over all documents. Document words meet the prefix words
in an equi-join, then the window must fit between the document's first and last word (position and length bounds), then
its words must equal the document's words there.

Defined results: a null or wordless text has n_words = 0 and is never contaminated; null, wordless and repeated
benchmark items give no windows or the same windows again. Items are told apart by item_id, null ids left out. A row is
known by doc_id and text: equal rows get equal results, each once, and null doc_ids are kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import materialize, rows_without, unclash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of an index that is broadcast; a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: Rows of 64 marks, by hash, that tell which words an index joined by a shuffle may hold: 2 MB at most, whatever its size.
MARK_ROWS = 1 << 17


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _rows(docs: DataFrame) -> DataFrame:
    """The document rows with their key and words."""
    return unclash(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, win): the windows of each item."""
    items = unclash(benchmark, ["item_id", "text"]).where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1)))
    return items.withColumn("i", start).select("item_id", F.slice("w", F.col("i"), width).alias("win")).distinct()


def _marked(said: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of said whose token may be one of `tokens`: all that are, and few others."""
    place = lambda df: df.withColumns({"_row": F.expr(f"pmod(xxhash64(token), {MARK_ROWS})"), "_bit": F.expr(f"shiftleft(1L, cast(pmod(xxhash64(token) div {MARK_ROWS}, 64) as int))")})
    marks = place(tokens).groupBy("_row").agg(F.bit_or("_bit").alias("_bits"))
    return place(said).join(F.broadcast(marks), "_row").where("_bits & _bit <> 0").drop("_row", "_bit", "_bits")


def occurrences(docs: DataFrame, wins: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, h, start, len, win): every place where a window of wins (win array<string>) occurs in a document."""
    index = materialize(wins.select("win").distinct().withColumn("win_id", F.xxhash64("win")), "windows")
    small = index.count() <= broadcast_windows
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = index.select(F.explode("win").alias("token")).distinct()
    said = _rows(docs).select(F.explode_outer("w").alias("token"))
    # Beyond a broadcast, words are counted where they are read, so that only one row of each goes through a shuffle.
    known = said.join(hint(vocabulary), "token").groupBy("token").count() if small else _marked(said, vocabulary).groupBy("token").count().join(vocabulary, "token")
    counts = materialize(known, "counts")
    prefix = (
        index.select("win_id", "win", F.posexplode("win").alias("offset", "token")).join(hint(counts), "token")
        .groupBy("win_id", "win").agg(F.min(F.struct("count", "token", "offset")).alias("p"), F.count("*").alias("found"))
        .where("found = size(win)").select("win_id", "win", F.size("win").alias("len"), "p.token", "p.offset")
    )
    fits = "pos >= offset and pos - offset + len <= n"
    same = "case when start >= 0 and start + len <= size(w) then slice(w, start + 1, len) = win else false end"
    if small:
        placed = _rows(docs).select("doc_id", "h", "w", F.size("w").alias("n"), F.posexplode_outer("w").alias("pos", "token"))
        found = placed.join(hint(prefix), "token").where(fits).withColumn("start", F.col("pos") - F.col("offset"))
        return found.where(f"get(w, start) = win[0] and {same}").select("doc_id", "h", "start", "len", "win_id")
    # The words stay behind: only keys and places of words that the index may hold meet it, and only documents with
    # candidates are read again.
    prefix = materialize(prefix, "prefix")
    placed = _rows(docs).select("doc_id", "h", F.size("w").alias("n"), F.posexplode_outer("w").alias("pos", "token"))
    found = _marked(placed, prefix.select("token")).join(prefix.drop("win"), "token").where(fits).select("doc_id", "h", (F.col("pos") - F.col("offset")).alias("start"), "len", "win_id").distinct()
    texts = _rows(docs).dropDuplicates(["doc_id", "h"]).withColumnRenamed("doc_id", "d").withColumnRenamed("h", "e")
    found = found.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("e"))).join(prefix.select("win_id", "win"), "win_id")
    return found.where(same).select("doc_id", "h", "start", "len", "win_id")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs (doc_id, text).

    n_hit counts the words inside any occurrence of a window, n_items the items with occurring windows; a row is
    contaminated if n_hit > 0 and share * n_hit >= n_words. items_sha256 digests the sorted item_ids.
    """
    wins = materialize(windows(benchmark, width), "items")
    hits = materialize(occurrences(docs, wins, broadcast_windows).distinct(), "hits")
    spans = hits.groupBy("doc_id", "h", "start").agg(F.max("len").alias("len"))
    # Words of a span that no earlier span covers.
    new = "start + len - greatest(start, coalesce(max(start + len) over (partition by doc_id, h order by start rows between unbounded preceding and 1 preceding), 0))"
    covered = spans.select("doc_id", "h", F.greatest(F.lit(0), F.expr(new)).alias("new")).groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    owners = wins.select("item_id", F.xxhash64("win").alias("win_id"))
    found = hits.select("doc_id", "h", "win_id").distinct().join(owners, "win_id").groupBy("doc_id", "h").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    per = covered.join(found.withColumnsRenamed({"doc_id": "d", "h": "e"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("e"))).select("d", "e", "n_hit", "items")
    rows = _rows(docs).select("doc_id", "h", F.size("w").cast("long").alias("n_words"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("e")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (n_hit > 0).__and__(share * n_hit >= F.col("n_words")).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    bad = contamination(docs, benchmark, width, share).where("contaminated").select("doc_id", "h").distinct()
    return rows_without(docs, bad, {"doc_id": docs["doc_id"], "h": F.xxhash64(docs["text"])})
