"""Operator 2, n-gram Jaccard join: signature trees.

A document is its set of distinct 5-word shingles (64-bit hashes). Two documents of similarity t or more
share at least one of the first |x| - ceil(t |x|) + 1 shingles of each under any order common to all, so every
document is hung under the roots of those shingles only; shingles that a sample shows to be frequent come
last in the order, which keeps roots small but decides nothing about results.

Under each root stands a tree: bands of set size, nodes of documents of one class, documents. A node has the
OR of its documents' token bitmaps, the range of their sizes, and their class, and is the same under every root.
Pairs of nodes are traversed together from the top and left where no pair below can reach the threshold: where
the size ranges are too far apart, where too few shingles follow the root in the common order, where the
bitmaps' common bits (plus what shingles share a bit) are too few, or where both are of one class already. A pair
of nodes goes down once, however many roots it shares. The pairs of documents that remain are verified on their whole sets.

The traversal is done twice. First each root's least document is paired with the root's others; the links
found join most of a large group of copies into one class. Then all trees are traversed with these classes, so
that only pairs between different classes remain: links of a group grow with its size, not with its square,
and no link between different classes is lost.

Documents with equal sets (128-bit digest) are one node from the start. Nulls: a null text is empty and linked
with nothing; rows with a null doc_id are returned with a null component_id and link nothing. Repeated rows
are returned each. Rows that share a doc_id are one document. An empty table gives an empty result. Texts of
any length are taken whole. ``ngram_join`` reads doc_id and text alone, ``one_of_each`` carries the others as
they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, components, released, ship, shuffle_files_end_with_query
from .words import blocks, shingle_sets

BITS = 512
_LONGS = BITS // 64
#: Frequent shingles are looked for in one of so many documents (in more where that is under SAMPLE_ROWS), and at most so many are kept.
SAMPLE = 8
SAMPLE_ROWS = 8_000
FREQUENT = 500_000
#: One in so many shingles is compared before whole sets are.
PART = 4
#: Documents of one class and band make nodes of about this many.
NODE = 16


def _sets_job(words: int, frequent: np.ndarray, need: int, of: int, whole: bool):
    rank = np.arange(len(frequent))
    by_hash = np.argsort(frequent)
    sorted_frequent, sorted_rank = frequent[by_hash], rank[by_hash]

    def run(batches):
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            ids = batch.column("doc_id")
            n, f1, f2, excess, flat, hung = [], [], [], [], [], []
            bits = []
            for _, b in blocks(batch.column("text").to_pylist(), lower=True):
                for s in shingle_sets(b, words):
                    m = len(s)
                    n.append(m)
                    f1.append(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)) if m else np.uint64(0))
                    f2.append(np.add.reduce((s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64) if m else np.uint64(0))
                    bit = np.zeros(BITS, np.uint8)
                    bit[(s >> np.uint64(55)).astype(np.int64)] = 1
                    bits.append(np.packbits(bit).view("<i8"))
                    excess.append(m - int(bit.sum()))
                    hung.append(m - (need * m + of - 1) // of + 1 if m else 0)
                    if m and len(frequent):  # rare shingles by hash, then frequent ones, the most frequent last
                        at = np.minimum(np.searchsorted(sorted_frequent, s), len(frequent) - 1)
                        common = sorted_frequent[at] == s
                        s = np.concatenate((s[~common], s[common][np.argsort(-sorted_rank[at[common]], kind="stable")]))
                    flat.append((s if whole else s[: hung[-1]]).view(np.int64))
            lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32)), pa.array(np.concatenate(xs) if xs else np.empty(0, np.int64)))
            wide = np.stack(bits) if bits else np.empty((0, _LONGS), np.int64)
            cols = [ids, pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(excess, pa.int64()), lists(flat), *[pa.array(wide[:, i]) for i in range(_LONGS)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "f1", "f2", "excess", "shingles", *[f"b{i}" for i in range(_LONGS)]])

    return run


_SETS = "doc_id long, n long, f1 long, f2 long, excess long, shingles array<long>, " + ", ".join(f"b{i} long" for i in range(_LONGS))


def shingle_table(docs: DataFrame, words: int = 5, frequent: np.ndarray | None = None, need: int = 80, of: int = 100, whole: bool = False) -> DataFrame:
    """The set of every row of docs: its size, digest and bitmap, and in ``shingles`` the first ones in the common order under which it hangs, or the whole set."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(released(_sets_job(words, frequent if frequent is not None else np.empty(0, np.uint64), need, of, whole)), _SETS)


def frequent_shingles(docs: DataFrame, words: int = 5, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> np.ndarray:
    """Shingles in at least three different sets of a sample, the most frequent first. Only the order of shingles depends on them."""
    n = docs.count()
    if not n:
        return np.empty(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, max(rows / n, 1 / SAMPLE)) * (1 << 30)))
    seen = shingle_table(some, words, whole=True).where("n > 0").select(F.hash("f1").alias("f1"), F.explode("shingles").alias("s"))
    top = seen.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("k >= 3 and lo <> hi").orderBy(F.col("k").desc(), "s").select("s").limit(most)
    with shuffle_files_end_with_query(docs.sparkSession):
        got = top.toArrow().column("s").to_numpy()  # at most ``most`` hashes
    return got.astype(np.int64).view(np.uint64)


def _common(a: str, b: str) -> Column:
    """Bits that two bitmaps have in common."""
    return sum((F.bit_count(F.col(f"{a}b{i}").bitwiseAND(F.col(f"{b}b{i}"))) for i in range(1, _LONGS)), F.bit_count(F.col(f"{a}b0").bitwiseAND(F.col(f"{b}b0"))))


def _may(a: str, b: str, lo: str, hi: str, need: int, of: int) -> Column:
    """Whether some pair below two nodes can reach need / of: by size range, and by the largest overlap their bitmaps allow."""
    most = F.least(_common(a, b) + F.least(f"{a}excess", f"{b}excess"), F.col(f"{a}{hi}"), F.col(f"{b}{hi}"))
    return (F.col(f"{a}{hi}") * of >= F.col(f"{b}{lo}") * need) & (F.col(f"{b}{hi}") * of >= F.col(f"{a}{lo}") * need) & (most * (need + of) >= (F.col(f"{a}{lo}") + F.col(f"{b}{lo}")) * need)


def _as(df: DataFrame, prefix: str, *but: str) -> DataFrame:
    return df.select(*[F.col(c) if c in but else F.col(c).alias(prefix + c) for c in df.columns])


def _verify(scratch: Scratch, pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, need: int, of: int) -> DataFrame:
    """Of the pairs (a, b) those whose bitmaps may, and whose whole sets do reach the threshold.

    Whole sets are several times their texts, so they are made from the texts again, and only for documents of
    pairs whose bitmaps may. The set of b travels to a's once for each pair. Joins end in a written table before
    pairs are made distinct, so that Spark may split a document with very many pairs among tasks.
    """
    info = sets.select("doc_id", "n", "excess", *[f"b{i}" for i in range(_LONGS)])
    pairs = pairs if hasattr(pairs, "_kept_at") else scratch.keep(pairs)

    def once(df: DataFrame) -> DataFrame:
        all_ = scratch.keep(df.select("a", "b"))
        out = scratch.keep(all_.distinct())
        scratch.drop(all_)
        return out

    met = _as(info, "x_").join(pairs, F.col("x_doc_id") == F.col("a"))
    may = once(met.join(_as(info, "y_"), F.col("y_doc_id") == F.col("b")).where(_may("x_", "y_", "n", "n", need, of)))
    held = scratch.keep(may.select(F.col("a").alias("_held")).union(may.select("b")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(held, F.col("doc_id") == F.col("_held"), "left_semi")
    sets = scratch.keep(shingle_table(texts, words, whole=True).select("doc_id", "n", "shingles"))
    # a quarter of the shingles first: what they share, and all of the rest at most, bounds the overlap
    part = F.filter("shingles", lambda h: F.pmod(h, F.lit(PART)) == 0)
    reach = lambda both, x, y: both * (need + of) >= (x + y) * need

    def meet(own: DataFrame, pairs: DataFrame) -> DataFrame:
        y = _as(own, "y_").join(pairs, F.col("y_doc_id") == F.col("b")).drop("y_doc_id")
        x = _as(own, "x_").join(pairs.select(F.col("a").alias("_a")).distinct(), F.col("x_doc_id") == F.col("_a"), "left_semi")
        return y.join(x, F.col("x_doc_id") == F.col("a")).withColumn("both", F.size(F.array_intersect("x_s", "y_s")))

    some = meet(sets.select("doc_id", "n", part.alias("s")), may)
    most = F.col("both") + F.least(F.col("x_n") - F.size("x_s"), F.col("y_n") - F.size("y_s"))
    left = once(some.where(reach(most, F.col("x_n"), F.col("y_n"))))
    full = meet(sets.select("doc_id", "n", F.col("shingles").alias("s")), left)
    out = once(full.where(reach(F.col("both"), F.col("x_n"), F.col("y_n"))))
    scratch.drop(pairs, may, held, sets, left)
    return out


def ngram_join(docs: DataFrame, words: int = 5, need: int = 80, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, verified_links for every row of docs.

    verified_links counts the links of the document's set that were verified: enough for classes, not all that there are.

    Documents link when their sets' Jaccard similarity is at least need / of.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    sets = scratch.keep(shingle_table(docs, words, frequent_shingles(docs, words), need, of))
    # one node for each distinct set, named by its least doc_id
    nodes = sets.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"))
    nodes = scratch.keep(nodes)
    # at a pair's first common root neither set can share more than what follows from there: ``rest``
    hung = sets.where("n > 0 and doc_id is not null").select("doc_id", "f1", "n", F.posexplode("shingles").alias("at", "root")).withColumn("rest", F.col("n") - F.col("at"))
    # roots of one set alone lead nowhere
    shared = hung.groupBy("root").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("root")
    shared = scratch.keep(shared)
    # written before the next join, which must not move below explode(): lists of roots are long, rows of the tree are not
    met = scratch.keep(hung.select("doc_id", "n", "rest", "root").join(shared, "root"))
    tree = scratch.keep(met.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct())
    scratch.drop(shared, met)
    # first traversal: each root's least document against the root's others
    lead = tree.groupBy("root").agg(F.min(F.struct("doc_id", "n", "rest")).alias("l")).select("root", F.col("l.doc_id").alias("a"), F.col("l.n").alias("an"), F.col("l.rest").alias("arest"))
    met = tree.join(lead, "root").where((F.col("doc_id") != F.col("a")) & (F.col("n") * of >= F.col("an") * need) & (F.col("an") * of >= F.col("n") * need) & (F.least("rest", "arest") * (need + of) >= (F.col("n") + F.col("an")) * need))
    links = _verify(scratch, met.select("a", F.col("doc_id").alias("b")).distinct(), sets, docs, words, need, of)
    first = scratch.keep(components(scratch, links))
    # second traversal: nodes of one class and one band of sizes each, the same nodes under every root
    own = sets.where("n > 0 and doc_id is not null").select("doc_id", "n", "excess", *[f"b{i}" for i in range(_LONGS)])
    own = own.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct()
    own = own.join(first, F.col("doc_id") == F.col("node"), "left").withColumn("cls", F.coalesce("component", "doc_id")).drop("node", "component")
    own = own.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(of / need)) + 1e-9).cast("int"))
    held = own.groupBy("cls", "band").agg(F.count(F.lit(1)).alias("k"))
    own = own.join(held, ["cls", "band"]).withColumn("node", F.xxhash64("cls", "band", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / NODE))))
    own = scratch.keep(own.drop("k"))
    place = own.select("doc_id", "n", "cls", "band", "node")
    top = scratch.keep(own.groupBy("node").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("excess").alias("excess"), *[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(_LONGS)]))
    under = tree.join(place, ["doc_id", "n"]).groupBy("root", "node", "cls", "band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    under = scratch.keep(under)
    mixed = under.groupBy("root").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("root")
    met = under.join(mixed, "root")
    x, y = _as(met, "x_"), _as(met, "y_").withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("y_band") - F.col("step"))
    sizes = (F.col("x_hi") * of >= F.col("y_lo") * need) & (F.col("y_hi") * of >= F.col("x_lo") * need) & (F.least("x_rest", "y_rest") * (need + of) >= (F.col("x_lo") + F.col("y_lo")) * need)
    pairs = x.join(y, (F.col("x_root") == F.col("y_root")) & (F.col("x_band") == F.col("at")) & (F.col("x_cls") != F.col("y_cls")) & ((F.col("step") == 1) | (F.col("x_cls") < F.col("y_cls"))) & sizes)
    pairs = scratch.keep(pairs.select("x_node", "y_node").distinct())  # once, however many roots they share
    scratch.drop(tree, under)
    pairs = pairs.join(_as(top, "x_"), "x_node").join(_as(top, "y_"), "y_node").where(_may("x_", "y_", "lo", "hi", need, of)).select("x_node", "y_node")
    # leaves: documents below the node pairs that are left; their own bitmaps are compared before their sets are
    leaf = place.select("doc_id", "n", "node")
    down = pairs.join(_as(leaf, "x_"), "x_node").join(_as(leaf, "y_"), "y_node").where((F.col("x_n") * of >= F.col("y_n") * need) & (F.col("y_n") * of >= F.col("x_n") * need))
    down = scratch.keep(down.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct())
    scratch.drop(own, top)
    more = _verify(scratch, down, sets, docs, words, need, of)
    # classes of the first traversal are joined by the second's links
    name = first.select("node", "component")
    over = more.join(name.withColumnRenamed("component", "ca"), F.col("a") == F.col("node"), "left").drop("node").join(name.withColumnRenamed("component", "cb"), F.col("b") == F.col("node"), "left").drop("node")
    second = scratch.keep(components(scratch, over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).select(F.col("node").alias("cls"), F.col("component").alias("top")))
    final = nodes.join(first.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").withColumn("cls", F.coalesce("component", "node")).join(second, "cls", "left").withColumn("class_of", F.coalesce("top", "cls"))
    count = links.unionByName(more).select("a", "b").distinct()
    count = count.select(F.col("a").alias("node")).unionByName(count.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("verified_links"))
    final = scratch.keep(final.join(count, "node", "left").select("f1", "f2", "n", F.col("class_of"), F.coalesce("verified_links", F.lit(0)).cast("long").alias("verified_links")))
    out = sets.select("doc_id", "n", "f1", "f2").join(final, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_of", "doc_id")).alias("component_id"), F.coalesce("verified_links", F.lit(0)).cast("long").alias("verified_links"))


def one_of_each(docs: DataFrame, words: int = 5, need: int = 80, of: int = 100) -> DataFrame:
    """docs without all but one of each class: the document that the class is named by. Rows without a doc_id stay."""
    scratch = Scratch(docs.sparkSession, "ngrams-kept")
    known = ngram_join(docs.select("doc_id", "text"), words, need, of)
    gone = scratch.keep(known.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select("doc_id", carried(docs).alias("row"))
    return rows.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select("row.*")
