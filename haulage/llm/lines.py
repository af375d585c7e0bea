"""Operator 4, line dedup: content-defined chunks of lines.

Each line is hashed. At each line one chunk begins, the fewest lines that hold ``min_words`` words, and one ends, the
fewest lines back that do; where both are the same it counts once. Chunks depend on their lines alone, and those that
lie in a passage of at least ``min_words`` words cover it to its edges. So a line goes exactly if it lies in a run of
whole lines of so many words that an earlier place (lowest doc_id, then place) has as well, once its bytes are
compared with the line there; the first occurrence stays. A chunk that overlaps its own first occurrence stays too.

Nulls: a null text stays null, a null doc_id sorts before others (its occurrence is the first). Rows equal in
doc_id and text are one document: they are treated alike. Empty texts stay. A document of whose lines nothing
with a word is left is dropped unless ``keep_empty``: all it said is said elsewhere. An empty table gives an
empty result. Extra columns are carried as they are, whatever their names; ``n_chars`` is brought up to date
where there is one. Texts of any length are taken whole, as rows of lines; one line of any length is one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, carried

#: Shorter passages stay.
MIN_WORDS = 25


def chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), lo, hi (first and last line), h (hash of the lines)."""
    one = lambda x: F.struct(F.xxhash64(x).alias("h"), (F.char_length(x) - F.char_length(F.translate(x, " \t", "")) + 1).alias("words"))
    lines = docs.where("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.transform(F.split("text", "\n"), one)).alias("at", "l")).select("doc_id", "th", "at", "l.*")
    # rows equal in doc_id and text give each line once; dealt out by document, the windows below need no other exchange
    lines = lines.repartition("doc_id", "th").groupBy("doc_id", "th", "at").agg(*[F.first(c).alias(c) for c in ("h", "words")])
    doc = Window.partitionBy("doc_id", "th")
    lines = lines.withColumn("upto", F.sum("words").over(doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("words"))
    # a line has one word at least, so that both sums grow from line to line and a frame has min_words lines at most
    ahead, back = doc.orderBy("before").rangeBetween(0, min_words - 1), doc.orderBy("upto").rangeBetween(1 - min_words, 0)
    begins = F.struct(F.col("at").alias("lo"), F.max("at").over(ahead).alias("hi"), F.xxhash64(F.collect_list("h").over(ahead)).alias("h"), (F.max("upto").over(ahead) - F.col("before") >= min_words).alias("whole"))
    ends = F.struct(F.min("at").over(back).alias("lo"), F.col("at").alias("hi"), F.xxhash64(F.collect_list("h").over(back)).alias("h"), (F.col("before") - F.min("before").over(back) >= min_words).alias("whole"))
    lines = lines.select("doc_id", "th", begins.alias("begins"), ends.alias("ends"))
    return lines.select("doc_id", "th", F.explode(F.array("begins", "ends")).alias("c")).where("c.whole").select("doc_id", "th", "c.lo", "c.hi", "c.h")


def repeated(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, lo of each line to remove, before bytes are compared, with the place (first) that it repeats, and that place's hash h."""
    all_ = scratch.keep(chunks(docs, max(min_words, 1)))
    again = all_.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "lo")).alias("first")).where("n > 1")
    again = scratch.keep(again.select("h", "first"))
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    # the same plan at every size; Spark splits hot hashes
    hit = all_.join(again.hint("merge"), "h").where(~(own & (F.col("lo") <= F.col("first.lo") + F.col("hi") - F.col("lo"))))
    hit = hit.select("doc_id", "th", "lo", "hi", "first").repartition("doc_id", "th")
    line = hit.select("doc_id", "th", (F.col("first.lo") - F.col("lo")).alias("by"), "first", F.explode(F.sequence("lo", "hi")).alias("lo"))
    first = F.min(F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), (F.col("lo") + F.col("by")).alias("lo")))
    out = line.groupBy("doc_id", "th", "lo").agg(first.alias("first"))
    out = scratch.keep(out.select("doc_id", "th", "lo", F.xxhash64("first").alias("h"), "first"))
    scratch.drop(all_, again)
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, keep_empty: bool = False) -> DataFrame:
    """docs with repeated passages taken out of ``text``."""
    scratch = Scratch(docs.sparkSession, "lines")
    mark = repeated(scratch, docs.select("doc_id", "text"), min_words)
    here = mark.select("doc_id", "th", "lo", "h", F.lit(False).alias("is_first"))
    there = mark.select("first.*", "h").distinct().select("doc_id", "th", "lo", "h", F.lit(True).alias("is_first"))
    wanted = here.unionByName(there).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "h", "is_first")).alias("wanted"))  # at most twice a document's own lines
    wanted = scratch.keep(wanted.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "wanted"))
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    lines = F.split("text", "\n")
    # the bytes of every line that may go and of every first occurrence, read from the texts once
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(wanted.hint("merge"), on)
    texts = texts.select("doc_id", "th", lines.alias("l"), F.explode("wanted").alias("w")).select("doc_id", "th", "w.*", F.get("l", F.col("w.lo")).alias("bytes"))
    texts = scratch.keep(texts)
    # one h is one first occurrence: lines with its very bytes go, others (a collision of hashes) stay
    first = texts.where("is_first").groupBy("h").agg(F.min("bytes").alias("first"))
    sure = texts.where("not is_first").join(first.hint("merge"), "h").where(F.col("bytes") == F.col("first"))
    gone = sure.groupBy("doc_id", "th").agg(F.collect_set("lo").alias("gone"))
    gone = scratch.keep(gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "gone"))
    scratch.drop(mark, wanted, texts)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", carried(docs, "text").alias("row"))
    out = rows.join(gone.hint("merge"), on, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    out = out.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")))
    if not keep_empty:
        out = out.where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length("text").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns])
