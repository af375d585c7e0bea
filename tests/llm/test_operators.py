"""Each operator against a brute-force version, a round trip or held-out labels, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from haulage.llm import fingerprints, html, langid, lines, mixing, ngram_join, packing, quality, queries, shards, toxicity
from haulage.llm.common import Scratch, components, running

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, "one two three four five six seven", "en", None, 33),
    (3, "one two three four five six seven", "en", None, 33),
    (None, "one two three four five six seven", "en", "b", 33),
    (5, "short", "de", "b", 5),
    (6, " \n\t ", None, None, 4),
    (7, "word " * 20000, "en", "a", 100000),
    (8, "été 東京 o’clock <|endoftext|> # $", "fr", "", 30),
]


#: Names that operators use inside or return.
CLASHES = tuple(
    "_key size shard n h at score ids copies root component _th _d _t th lo gone ratio n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept row q wanted bytes first "
    "_rank _before _part _p _n0 _v0 _g0 _s _kept _crc taken target source_size expected _held _gone a b _doc _l _j offending _node _leaves _tie _d0 dim left border bin _row rest whole g k _h _own _bucket "
    "near_group fingerprint toxic quality weird.name".split()
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.orderBy("doc_id").collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows and a column whose name clashes with what operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


# -- shared ---------------------------------------------------------------------------------------------------


def test_running_counts_within_groups(spark):
    data = [(i % 3 if i % 7 else None, i, i % 5) for i in range(500)]
    df = spark.createDataFrame(data, "g int, v long, w long")
    got = {(r.g, r.v): (r._rank, r._before) for r in running(Scratch(spark, "t"), df, ["g"], ["v"], "w").collect()}
    for g in (0, 1, 2, None):
        own = sorted((v, w) for a, v, w in data if a == g)
        for i, (v, _) in enumerate(own):
            assert got[g, v] == (i, sum(w for _, w in own[:i]))


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    got = {r.node: r.component for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(1, 40)} == {1}
    assert {got[i] for i in range(200, 207)} == {200}


# -- 1 --------------------------------------------------------------------------------------------------------


def check_shards(source, out, n):
    assert len(out) == len(source)
    by = defaultdict(list)
    total = Counter()
    for r in out:
        by[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert set(by) <= set(range(n))
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in source)
    assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    return total


def test_shards_hold_near_equal_bytes(docs, rows):
    total = check_shards(rows, shards.shard_documents(docs, 16).collect(), 16)
    mean = sum(total.values()) / 16
    largest = max(len((d.text or "").encode()) for d in rows)
    assert all(abs(v - mean) < largest for v in total.values())
    seven = check_shards(rows, shards.shard_documents(docs, 7).collect(), 7)
    assert max(seven.values()) - min(seven.values()) < 2 * largest


def test_shards_by_target_bytes(docs, rows):
    total = sum(len(d.text.encode()) + 1 for d in rows)
    got = check_shards(rows, shards.shard_documents(docs, target_bytes=-(-total // 5)).collect(), 5)
    assert len(got) == 5


def test_shards_of_odd_rows(odd, none):
    check_shards([type("R", (), dict(zip(("doc_id", "text"), r, strict=False))) for r in ODD], shards.shard_documents(odd, 4).collect(), 4)
    assert shards.shard_documents(none, 4).collect() == []


def test_shards_split_one_hot_value(spark):
    df = spark.createDataFrame([(i, "same text", "en", "hot", 9) for i in range(400)], SCHEMA)
    got = Counter(r.shard for r in shards.shard_documents(df, 8).collect())
    assert len(got) == 8 and max(got.values()) - min(got.values()) <= 2


# -- 2 --------------------------------------------------------------------------------------------------------


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(data):
    """Brute force: all pairs that share a shingle, then union-find."""
    sets = [shingles(t) for _, t in data]
    up = {d: d for d, _ in data if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            index[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index[x] if j < i}:
            both = len(s & sets[j])
            if data[i][0] is not None and data[j][0] is not None and 100 * both >= 80 * len(s | sets[j]):
                a, b = find(data[i][0]), find(data[j][0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(data, sets, strict=True)]


def key(x):
    return tuple((v is None, v) for v in x)


def test_ngram_join_is_brute_force(docs, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()]
    assert sorted(got) == sorted(classes([(r.doc_id, r.text) for r in rows]))


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_on_edited_groups(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    data = []
    common = rng.choices(vocabulary, k=12)
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 20, 60, 150]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                own = common + own
            data.append((len(data) * 3 % 1009, " ".join(own)))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(classes(data))


def test_ngram_join_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(odd).collect()), key=key)
    assert got == sorted(classes([r[:2] for r in ODD]), key=key)
    assert ngram_join.ngram_join(none).collect() == []
    one = ngram_join.one_of_each(odd)
    assert one.columns == odd.columns and all(r[c] == "clash" for r in one.collect() for c in CLASHES)
    assert sorted((r.doc_id for r in one.collect()), key=lambda v: (v is None, v)) == [1, 2, 3, 3, 5, 6, 7, 8, None]


def test_near_stage_keeps_one_row_of_each_class(spark):
    from corpus_pipeline import dedup_near

    rng = random.Random(4)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(5)]
    edited = lambda b: " ".join(b[:40] + ["other"] + b[41:])
    data = [(1, bases[0]), (1, bases[0]), (2, bases[1]), (None, bases[1]), (None, bases[2]), (None, bases[2]), (7, bases[3]), (5, bases[4]), (9, None)]
    data = [(d, b and " ".join(b)) for d, b in data] + [(None, edited(bases[3])), (4, edited(bases[4])), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in data], SCHEMA)
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    named = classes([(k, data[i][1]) for k, i in enumerate(order)])
    want = [data[i] for (k, _, c), i in zip(named, order, strict=True) if k == c]
    got = [(r.doc_id, r.text) for r in dedup_near(spark, df, SF).collect()]
    odd_first = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(got, key=odd_first) == sorted(want, key=odd_first) and len(got) == 7


# -- 3 --------------------------------------------------------------------------------------------------------


def test_html_is_the_article(spark):
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    out = html.extract(pages).collect()
    assert len(out) == len(source)
    for r in out:
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", source[r.page_id].html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(x.replace("<b>", "").replace("</b>", ""))).strip() for x in re.split(r"</?p>|<br>|</?h1>", inner)]
        assert r.text == " ".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_html_of_odd_pages(spark):
    body = "<p>The main text of the page goes here, with a <a href=x>link</a> or two &amp; more.</p>" * 3
    page = f"<html><body><div class='sidebar-2'><p>side</p></div><div class='post-content n7'>{body}<!-- <p>no</p> --><form>f</form><div class='comments'><p>says who</p></div></div><div id=footer>foot</div></body></html>"
    data = [(1, "http://a.b/1", page), (2, None, None), (3, "", ""), (4, "http://a.b/2", "plain &lt;text&gt; 1 < 2"), (5, "http://a.b/3", "<div><p>open"), (6, "http://a.b/1", page), (None, "x", "<p>a<p>b<script>x</p>"), (8, "http://a.b/9", "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[1].text == " ".join(["The main text of the page goes here, with a link or two & more."] * 3) == got[6].text
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "")
    assert got[4].text == "plain <text> 1 < 2" and got[5].text == "open" and got[None].text == "a b" and got[8].text == "deep"
    more = spark.createDataFrame(data, "page_id long, url string, html string").select("*", *[F.lit("clash").alias(c) for c in ("host", "_host", "path", "depth", "text", "n_chars", "votes")])
    assert {r.page_id: r for r in html.extract(more).collect()} == got
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "page, n",
    [
        ("<div>x" * 100_000, 100_000),
        ("<div class=a1>x</p></b>" * 30_000, 30_000),
        ("<b><div><i>" + "<i>" * 30_000 + "</b>" * 30_000 + "x", 1),
        ("<p>x" * 50_000 + "</div>" * 50_000, 50_000),
        ("x" + "<a 'b " * 30_000 + "<a \"" * 30_000, 1),
        ("x" + "<![CDATA[" * 50_000, 1),
        ("x " + "< " * 100_000, 100_001),
        ("<title></head>" * 50_000 + "x", 1),
        ("x<!-- " * 50_000, 1),
    ],
)
def test_html_is_read_in_linear_time(page, n):
    began = time.process_time()
    got = html.parse(page)
    text = html.take(got, html.best_path(html.scores(got)))
    assert time.process_time() - began < 4
    assert len(html.take(got, None).split()) == n or page.startswith("x")
    assert text or n == 1


# -- 4 --------------------------------------------------------------------------------------------------------


def passage(rng, n_lines, n_words):
    return "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10**6)) for _ in range(n_words)) for _ in range(n_lines))


def test_line_dedup_takes_repeated_passages_only(spark):
    rng = random.Random(3)
    shared = [passage(rng, 4, 20), passage(rng, 2, 40), "\n".join([passage(rng, 1, 30), passage(rng, 1, 4), passage(rng, 1, 30)])]
    own = [passage(rng, 6, 12) for _ in range(40)]
    data = []
    for i, t in enumerate(own):
        ls = t.split("\n")
        if i % 2:
            at = rng.randrange(len(ls))
            ls[at:at] = [shared[i % 3]]
        data.append((i, "\n".join(ls), len("\n".join(ls))))
    got = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(data, "doc_id long, text string, n_chars long")).collect()}
    assert sorted(got) == list(range(40))
    seen = set()
    for i, t, _ in data:
        if i % 2 and shared[i % 3] in seen:
            assert got[i].text == own[i]  # nothing but the passage went
        else:
            assert got[i].text == t
        if i % 2:
            seen.add(shared[i % 3])
        assert got[i].n_chars == len(got[i].text)


def test_line_dedup_keeps_every_first_line(docs, rows):
    out = {r.doc_id: r.text for r in lines.line_dedup(docs, keep_empty=True).collect()}
    assert sorted(out) == [r.doc_id for r in rows]
    left = Counter(x for t in out.values() for x in t.split("\n"))
    for r in rows:
        have = out[r.doc_id].split("\n")
        it = iter(r.text.split("\n"))
        assert r.text == out[r.doc_id] or have == [""] or all(x in it for x in have)  # a subsequence
        assert all(left[x] or not x.strip() for x in r.text.split("\n"))  # every line is still somewhere
    copies = Counter(r.text for r in rows)
    for r in rows:
        if copies[r.text] > 1 and len(words(r.text)) > 60 and r.doc_id != min(x.doc_id for x in rows if x.text == r.text):
            assert len(words(out[r.doc_id])) < 25


def brute_lines(texts, min_words):
    """Lines left of each text, by comparing every line with every line of the texts before."""
    n = lambda x: len(re.findall("[ \t]", x)) + 1
    split, out = [t.split("\n") for t in texts], []
    for j, b in enumerate(split):
        gone = set()
        for a in split[:j]:
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                        k = 0
                        while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                            k += 1
                        if sum(map(n, b[y : y + k])) >= min_words:
                            gone |= set(range(y, y + k))
        out.append("\n".join(x for i, x in enumerate(b) if i not in gone))
    return out


@pytest.mark.parametrize("n_lines", [5, 9, 17, 25])
def test_line_dedup_takes_passages_of_short_lines_to_their_edges(spark, n_lines):
    rng = random.Random(n_lines)
    line = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(6))
    data, own, shared = [], [], []
    for i in range(30):
        ls = [line() for _ in range(20)]
        at = rng.randrange(21)
        if i % 2 == 0:
            shared.append([line() for _ in range(n_lines)])
        data.append((i, "\n".join(ls[:at] + shared[-1] + ls[at:])))
        own.append("\n".join(ls))
    assert max(len(x) for _, t in data for x in t.split("\n")) < 40
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(30)] == [own[i] if i % 2 else data[i][1] for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_is_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join("x" * rng.randint(1, 9) + str(k) for _ in range(rng.choice([1, 2, 3, 6, 12, 30]))) for k in range(120)]
    texts = []
    for _ in range(40):  # runs of the pool, so that passages of all lengths repeat, begin and end anywhere
        ls = []
        for _ in range(3):
            at = rng.randrange(len(pool))
            ls += [x for x in pool[at : at + rng.randint(1, 12)] if x not in ls]
        texts.append("\n".join(ls))
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep_empty=True).collect()}
    want = brute_lines(texts, 25)
    assert any(w and w != t for w, t in zip(want, texts))
    assert [got[i] for i in range(len(texts))] == want


def test_line_dedup_keeps_one_turn_of_a_refrain(spark):
    text = "\n".join(["la la la"] * 40)
    out = lines.line_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), keep_empty=True)
    got = {r.doc_id: r.text for r in out.collect()}
    assert 25 <= len(words(got[1])) < 60 and got[2] == ""


def test_line_dedup_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.text) for r in lines.line_dedup(odd).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert [g[0] for g in got] == [1, 2, 3, 3, 5, 6, 7, 8, None]
    assert got == sorted(((r[0], r[1]) for r in ODD), key=lambda x: (x[0] is None, x[0] or 0))
    out = lines.line_dedup(odd.unionByName(odd.where("doc_id = 7").withColumn("doc_id", F.lit(99).cast("long"))))
    assert out.columns == odd.columns and all(r[c] == "clash" for r in out.collect() for c in CLASHES)
    assert 99 not in {r.doc_id for r in out.collect()}
    assert lines.line_dedup(none).collect() == []


# -- 5 --------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, rows):
    out = queries.op5_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in rows}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)


def test_language_of_odd_rows(odd, docs, none):
    p = langid.train(docs)
    got = [r._l for r in odd.select(langid.identify(odd, p).alias("_l"), "text").collect()]
    texts = [r.text for r in odd.select("text").collect()]
    for g, t in zip(got, texts, strict=True):
        assert (g.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert langid.train(none).langs == [] and langid.predict(["abc"], langid.train(none)).lang_pred[0] == "und"


def test_bundle_is_the_sum_of_bound_trigrams():
    def slow(t):
        v = np.zeros(langid.DIM)
        kind = langid._kinds()
        s = [0, *(int(kind[ord(c)]) for c in t), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            if b:
                v += np.roll(langid._LETTER[a], 2).astype(int) * np.roll(langid._LETTER[b], 1) * langid._LETTER[c]
        return v

    texts = ["Hello, world", "a", "été x", "", None, "12 34", "zz top"]
    for t, v in zip(texts, langid.bundles(texts), strict=True):
        assert np.array_equal(v, slow(t or ""))


# -- 6 --------------------------------------------------------------------------------------------------------


def untouched(texts):
    """The contract: the tokenizer as its file makes it."""
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(queries.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def check_packing(source, out, window=2048):
    full = [ids + [1] for ids in untouched([t or "" for _, t in source])]
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    ids_of = defaultdict(list)
    for (d, _), ids in zip(source, full, strict=True):
        ids_of[d].append(np.array(ids, "<u4"))
    for d, have in ids_of.items():
        cover = Counter()
        for r in by_doc[d]:
            fits = [x for x in have if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
            assert fits
            cover.update((r.doc_tokens, i) for i in range(r.start, r.start + r.length))
        assert cover == Counter((len(x), i) for x in have for i in range(len(x)))
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for ps in windows.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= window
    return sum(map(len, full)) / (len(windows) * window) if windows else 1.0


def test_packing_round_trip_with_little_padding(docs, rows):
    assert check_packing([(r.doc_id, r.text) for r in rows], packing.pack(docs, queries.tokenizer_path()).collect()) > 0.97


def test_packing_of_odd_rows(odd, none):
    check_packing([r[:2] for r in ODD], packing.pack(odd, queries.tokenizer_path()).collect())
    assert packing.pack(none, queries.tokenizer_path()).collect() == []


def test_encoder_is_the_tokenizer():
    enc = packing.Encoder(queries.tokenizer_path())
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab'stredvlm  \n\t1²½.,!é\xa0\x85\x1c-") for _ in range(rng.randrange(40))) for _ in range(3000)] + ["東京 o’clock", "it's we'll 'd"]
    texts += ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>", "<|endoftext", "x <|endoftext|>\n"]
    assert [x.tolist() for x in enc.encode(texts)] == untouched(texts)
    assert next(enc.encode(["a<|endoftext|>b"])).tolist() == [64, 50256, 65]


def test_encoder_tells_pieces_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(packing, "_CHAR", np.full_like(packing._CHAR, 3))  # pieces of one length have one hash
    enc = packing.Encoder(queries.tokenizer_path())
    texts = ["one two six ten", "ten cat dog 123", "", "one one"]
    assert [x.tolist() for x in enc.encode(texts)] == untouched(texts)


@pytest.mark.parametrize("how", ["little memory", "small calls", "nothing between"])
def test_encoder_forgets_and_learns_again(monkeypatch, how):
    enc = packing.Encoder(queries.tokenizer_path())
    assert enc.between is not None
    if how == "little memory":
        monkeypatch.setattr(packing, "_REMEMBER", 5)
    if how == "small calls":
        monkeypatch.setattr(packing, "_TOGETHER", 7)
    if how == "nothing between":
        enc.between = None
    monkeypatch.setattr(packing, "_CHUNK", 300)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcé.1ÿĀ") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(30))) for _ in range(100)] + ["x" * 5000, "", None]
    assert [x.tolist() for x in enc.encode(texts)] == untouched([t or "" for t in texts])


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.normal(size=12)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g < 1e-6).all() and abs(x @ g) < 1e-6


# -- 7 --------------------------------------------------------------------------------------------------------


def test_fingerprints_and_edits(docs, rows):
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(rows, key=lambda r: -r.doc_id)
    assert len(out) == len(rows)
    for i, r in enumerate(order):
        after = order[(i + 1) % len(order)].text
        e = fingerprints.edited(r.text, after)
        k = len(r.text) // 2
        assert e == r.text[: len(r.text) - k] + after[:k]
        g = out[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(e.encode()).hexdigest())
        if i % 20 == 0:
            a, b, c = fingerprints.fingerprints([r.text, e, after])
            assert (g.fingerprint, g.edited_fingerprint) == (a.hex(), b.hex())
            assert g.near_edited == fingerprints.likeness(a, b) and g.near_next == fingerprints.likeness(a, c)
    assert np.median([g.near_edited for g in out.values()]) > 0.4 > 0.1 > np.median([g.near_next for g in out.values()])


def test_fingerprints_of_odd_rows(odd, none, spark):
    out = fingerprints.fingerprint_documents(odd).collect()
    assert len(out) == len(ODD)
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter((r[0], hashlib.sha256(fingerprints.edited(r[1] or "", order[(i + 1) % len(order)][1] or "").encode()).hexdigest()) for i, r in enumerate(order))
    assert want == Counter((r.doc_id, r.edited_sha256) for r in out)
    assert len({r.fingerprint for r in out if r.n_chars == 33}) == 1
    assert fingerprints.fingerprint_documents(none).collect() == []
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_near_pairs_find_small_edits(spark):
    rng = random.Random(5)
    text = lambda: " ".join(str(rng.random()) for _ in range(80))
    base = [text() for _ in range(6)]
    data = [(i, t) for i, t in enumerate(base)] + [(10 + i, t[:700] + "x" + t[700:]) for i, t in enumerate(base)] + [(20, base[0])]
    prints = dict(zip((i for i, _ in data), fingerprints.fingerprints([t for _, t in data]), strict=True))
    marks = spark.createDataFrame([(i, f.hex()) for i, f in prints.items()], "doc_id long, fingerprint string")
    got = {(r.a, r.b) for r in fingerprints.near_pairs(marks, 0.5).collect()}
    bands = lambda f: {(i, f[i : i + 8]) for i in range(0, fingerprints.SAMPLES, 8)}
    want = {(a, b) for a in prints for b in prints if a < b < 20 and prints[a] != prints[b] and bands(prints[a]) & bands(prints[b]) and fingerprints.likeness(prints[a], prints[b]) >= 0.5}
    assert got == want and sum(prints[i] == prints[10 + i] or (i, 10 + i) in want for i in range(6)) >= 4


def test_near_groups_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [str(rng.random()) for _ in range(500)]
    data = []
    for g in range(12):
        base = rng.choices(vocabulary, k=80)
        for _ in range(rng.choice([1, 2, 5, 40])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(40, 80)] = rng.choice(vocabulary)
            data.append((len(data) * 7 % 1009, " ".join(own)))
    data += [(2000, ""), (2001, ""), (2002, None)]
    prints = {d: f.hex() for (d, _), f in zip(data, fingerprints.fingerprints([t for _, t in data]), strict=True)}
    marks = spark.createDataFrame([*prints.items(), (None, prints[0])], "doc_id long, fingerprint string")
    got = {r.fingerprint: r.near_group for r in fingerprints.near_groups(Scratch(spark, "t"), marks).collect()}
    links = defaultdict(set)
    bands = lambda f: {(i, f[i : i + 16]) for i in range(0, 2 * fingerprints.SAMPLES, 16)}
    for a, fa in prints.items():
        for b, fb in prints.items():
            if fa == fb or (bands(fa) & bands(fb) and fingerprints.likeness(bytes.fromhex(fa), bytes.fromhex(fb)) >= fingerprints.LEAST):
                links[a].add(b)
    for d in prints:
        seen, todo = {d}, [d]
        while todo:
            todo += links[todo.pop()] - seen
            seen |= set(todo)
        assert got[prints[d]] == min(seen)
    assert len(set(got.values())) < len(set(prints.values()))


def test_near_leads_are_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [str(rng.random()) for _ in range(500)]
    data = []
    for g in range(10):
        base = rng.choices(vocabulary, k=60)
        for _ in range(rng.choice([1, 3, 30])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(30, 60)] = rng.choice(vocabulary)
            data.append((len(data) * 7 % 1009, " ".join(own)))
    data += [(2000, ""), (2001, "")]
    prints = {d: f for (d, _), f in zip(data, fingerprints.fingerprints([t for _, t in data]), strict=True)}
    marks = [(d, f.hex()) for d, f in prints.items()] + [(None, prints[0].hex()), (None, fingerprints.fingerprints(["alone"])[0].hex())]
    got = {r.fingerprint: (r.near_lead, r.lead_likeness) for r in fingerprints.near_leads(Scratch(spark, "t"), spark.createDataFrame(marks, "doc_id long, fingerprint string")).collect()}
    bands = lambda f: {(i, f[i : i + fingerprints.BAND]) for i in range(0, fingerprints.SAMPLES, fingerprints.BAND)}
    lead = {b: min(d for d, f in prints.items() if b in bands(f)) for f in prints.values() for b in bands(f)}
    want = {}
    for f in set(prints.values()):
        found = [(fingerprints.likeness(f, prints[a]), -a) for a in {lead[b] for b in bands(f)} if prints[a] != f]
        if found and max(found)[0] >= fingerprints.LEAST:
            want[f.hex()] = (-max(found)[1], pytest.approx(max(found)[0]))
    assert got == want and len(want) > 5


def test_near_groups_hold_small_edits(docs, rows):
    """Likeness against edit distance, and recall of banding and verification: one character in a long text."""
    rng = random.Random(7)
    own = [r.text for r in rows if len(r.text) > 400][:60]
    changed = []
    for t in own:
        at = rng.randrange(len(t) // 2, len(t))
        changed.append(t[:at] + "#" + t[at + 1 :])
    a, b = fingerprints.fingerprints(own), fingerprints.fingerprints(changed)
    alike = [fingerprints.likeness(x, y) for x, y in zip(a, b, strict=True)]
    bands = [any(x[i : i + 8] == y[i : i + 8] for i in range(0, fingerprints.SAMPLES, 8)) for x, y in zip(a, b, strict=True)]
    assert np.mean([s >= fingerprints.LEAST and k for s, k in zip(alike, bands, strict=True)]) >= 0.9


@pytest.mark.parametrize("hot", [5, None])
def test_fingerprints_of_one_doc_id_in_most_rows(spark, hot):
    data = [(i if i % 3 == 0 else hot, f"text number {i % 37} " * (i % 5)) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    dealt = fingerprints.with_next(df)
    sizes = Counter(r._bucket for r in dealt.select("_bucket").collect())
    assert max(sizes.values()) < 200 and len(sizes) > 4
    out = fingerprints.fingerprint_documents(df).collect()
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((d, len(t)) for d, t in data)
    texts = defaultdict(list)
    for d, t in data:
        texts[d].append(t)
    order = sorted(texts, key=lambda d: (d is None, -(d or 0)))
    for d, later in zip(order, order[1:] + order[:1], strict=True):
        if len(texts[d]) == 1:
            made = {hashlib.sha256(fingerprints.edited(texts[d][0], o).encode()).hexdigest() for o in texts[later]}
            assert {r.edited_sha256 for r in out if r.doc_id == d} <= made


# -- 8 --------------------------------------------------------------------------------------------------------


def check_mix(source, out):
    size = [(r[0], r[3], len(words(r[1]))) for r in source]
    by = Counter()
    for _, s, n in size:
        by[s] += n
    names = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(by.values()), {}, set(names)
    left = float(total)
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 3 * by[s]}
        if not over:
            target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= 3 * by[s]
        free -= over
    assert Counter((r.doc_id, r.size) for r in out) == Counter((d, n) for d, _, n in size)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    got, most = Counter(), Counter()
    for r in out:
        got[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert r.source_size == by[r.source] and r.target == pytest.approx(target[r.source])
    for s in names:
        assert abs(got[s] - target[s]) <= 1 + 2 * most[s]


def test_mix_meets_targets(docs, rows):
    out = mixing.mix(docs).collect()
    check_mix(rows, out)
    assert sorted(out) == sorted(mixing.mix(docs).collect())


@pytest.mark.parametrize("sizes", [(100, 100, 100, 100, 100, 100), (1000, 1, 1, 1), (1, 1000, 2, 500), (3, 200, 200)])
def test_mix_shares_below_and_above_the_caps(spark, sizes):
    data = [(i * 100 + j, "w " * (n // 10 + (j < n % 10)), "en", f"s{i}", 0) for i, n in enumerate(sizes) for j in range(10)]
    check_mix(data, mixing.mix(spark.createDataFrame(data, SCHEMA)).collect())


def test_mix_of_odd_rows(odd, none):
    check_mix(ODD, mixing.mix(odd).collect())
    carried = mixing.mix(odd, keep=odd.columns)
    assert carried.columns == ["doc_id", "source", *(c for c in odd.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken")), "size", "source_size", "target", "copies", "taken"]
    check_mix(ODD, carried.collect())
    assert mixing.mix(none).collect() == []


# -- 9 --------------------------------------------------------------------------------------------------------


def base(t):
    t = t or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_features_are_brute_force(rows):
    texts = [r.text for r in rows] + [r[1] for r in ODD] + ["a b c d e a b c d e x", "x\nx\n\n\ny\nx", "a " * 9]
    got = quality.base_features(texts)
    assert [tuple(x) for x in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False)] == [base(t) for t in texts]


def test_quality_keeps_good_rows(spark, rows):
    out = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(out) == len(rows)
    for r in out.values():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    good = [out[x.doc_id] for x in labels if x.quality == 1 and x.doc_id in out and not out[x.doc_id].base_failed]
    bad = [out[x.doc_id] for x in labels if x.quality == 0 and x.doc_id in out]
    assert np.mean([r.kept for r in good]) >= 0.97 and np.mean([r.kept for r in bad]) <= 0.2


def test_quality_ratio_is_brute_force(rows):
    texts = [r.text for r in rows[:40]]
    slot = lambda b: int(((int.from_bytes(bytes(b), "big") * 0 + _poly(b)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.SLOT_BITS))
    raw = Counter(slot(t.encode()[i : i + 4]) for t in texts for i in range(len(t.encode()) - 3))
    assert {i: n for i, n in enumerate(quality.count_grams(texts)) if n} == raw
    ratio = np.random.default_rng(0).normal(size=1 << quality.SLOT_BITS).astype(np.float32)
    want = [np.mean([ratio[slot(t.encode()[i : i + 4])] for i in range(len(t.encode()) - 3)]) if len(t.encode()) > 3 else 0 for t in texts]
    assert np.allclose(quality.ratios(texts, ratio), want, atol=1e-5)


def _poly(b):
    h = 0
    for x in b:
        h = h * 257 + x
    return h


def best_cut(ratio, good, trusted_pass):
    """The border by trying every one."""
    g, bad = np.sort(ratio[good == 1]), np.sort(ratio[good == 0])
    values = np.unique(ratio)
    cuts = [values[0] - 1.0, *((values[1:] + values[:-1]) / 2)]
    share = [(1 - np.searchsorted(g, c) / len(g), np.searchsorted(bad, c) / len(bad)) for c in cuts]
    return cuts[int(np.argmax([k + b if k >= trusted_pass else -1 for k, b in share]))]


def test_quality_learns_from_every_label(spark):
    n = 21_000  # beyond any sample of 20,000
    text = "concat('t', hex(hash(id)), if(id % 3 = 0, ' good word ', ' bad one '), id, if(id % 50 = 7, ' good word', ''))"
    docs = spark.range(n + 500).selectExpr("id as doc_id", f"if(id % 100 = 9, null, {text}) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "if(id % 3 = 0, 1, 0) as quality")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    model = quality.train(docs, labels, trusted_pass=0.9)
    want = quality.log_ratio(quality.count_grams(texts[:n:3]), quality.count_grams(texts)).astype(np.float32)
    assert (model.ratio == want).all()
    there = [i for i in range(n) if texts[i] is not None]
    ratio = quality.ratios([texts[i] for i in there], want)
    assert model.threshold == pytest.approx(best_cut(ratio, np.array([i % 3 == 0 for i in there]).astype(int), 0.9), abs=1e-12)


def test_quality_threshold_is_brute_force(spark):
    rng = np.random.default_rng(3)
    for share in (0.5, 0.9, 0.997):
        data = [(int(q), float(r)) for q, r in zip(rng.integers(0, 2, 400), rng.integers(-20, 20, 400) / 8)] + [(1, 2.0)] * 300
        got = quality.pick(Scratch(spark, "t"), spark.createDataFrame(data, "quality int, r double"), share)
        assert got == best_cut(np.array([r for _, r in data]), np.array([q for q, _ in data]), share)
    near = [(0, 1.0), (1, float(np.nextafter(1.0, 2.0)))]  # no number lies between
    assert quality.pick(Scratch(spark, "t"), spark.createDataFrame(near, "quality int, r double"), 0.9) == near[1][1]
    assert quality.pick(Scratch(spark, "t"), spark.createDataFrame(near[1:], "quality int, r double"), 0.9) == -np.inf


def test_quality_of_odd_rows(odd, docs, spark, none):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs.select("doc_id", "text"), labels)
    got = quality.quality(odd, model).collect()
    assert len(got) == len(ODD) and all(r.kept == (not r.base_failed) for r in got)
    assert all(r.score == r._th == r["weird.name"] == "clash" for r in got) and sorted(r.n_words for r in got) == sorted(len(words(r[1])) for r in ODD)
    assert quality.quality(none.select("doc_id", "text"), model).collect() == []


# -- 10 -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    held = [(out[x.doc_id].score, x.toxic) for x in labels if out[x.doc_id].held_out]
    one, zero = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in one for b in zero]) > 0.85 and np.mean([s >= 0.3 for s in zero]) < 0.1


def test_toxicity_is_noisy_or_of_sentences(spark, monkeypatch):
    data = [("You are a fool. The day is fine", 1), ("The day is fine. The sea is calm", 0), ("A calm day! The fool sleeps", 1), ("Fine sea", 0)] * 6
    f = list(toxicity.features([t for t, _ in data]))
    m = toxicity.fit([a for a, _ in f], [b for _, b in f], np.array([y for _, y in data]))
    with monkeypatch.context() as no_weak:
        no_weak.setattr(toxicity, "WEAK", 1e-300)
        s = toxicity.score_texts(["a calm sea. one fool here. the day is fine", "a calm sea. the day is fine", None, "", "fool. fool"], m)
        one = [toxicity.score_texts([x], m)[0] for x in ("a calm sea.", "one fool here.", "the day is fine")]
        assert s[0] == pytest.approx(1 - np.prod([1 - x for x in one]))
    s = toxicity.score_texts(["a calm sea. one fool here. the day is fine", "a calm sea. the day is fine", None, "", "fool. fool"], m)
    one = [toxicity.score_texts([x], m)[0] for x in ("a calm sea.", "one fool here.", "the day is fine")]
    loss = -np.log1p(-np.array(one))  # by the rule: weak sentences count as one, their mean
    weak = np.array(one) < toxicity.WEAK
    assert 0 < weak.sum() < len(one)
    assert s[0] == pytest.approx(1 - np.exp(-loss[~weak].sum() - loss[weak].mean()))
    assert s[0] > 0.5 > s[1] and s[2] == s[3] == 0 and s[4] > s[0] - 0.2
    spans = toxicity.offending(spark.createDataFrame([(1, "a calm sea. one fool here. fine")], "doc_id long, text string"), m).collect()
    assert [(r.doc_id, r.start, r.end) for r in spans] == [(1, 12, 25)]


def test_toxicity_trained_in_spark_is_trained_in_place(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.train(docs, labels, n_features=10**6)
    own = sorted((toxic[r.doc_id], r.text) for r in rows if r.doc_id in toxic)
    f = list(toxicity.features([t for _, t in own]))
    y = np.array([y for y, _ in own])
    want = toxicity.fit([a for a, _ in f], [b for _, b in f], y, n_features=10**6)
    assert np.array_equal(got.check, want.check) and got.check.any()
    texts = [r.text for r in rows]
    assert toxicity.score_texts(texts, got) == pytest.approx(toxicity.score_texts(texts, want), abs=1e-3)


def test_toxicity_bags_count_alike_sentences_once():
    text = "One fool here. A calm day. " * 50 + "Two fools. One fool here."
    (words, firsts), = toxicity.features([text])
    ones = toxicity.features(["fool"]), toxicity.features(["fools"])
    chosen = np.unique(np.concatenate([w[w > 0] for f in ones for w, _ in f]))
    b = toxicity.bags(words, firsts, chosen)
    assert b.plain == 50 and sorted(b.times.tolist()) == [1, 51] and b.size.sum() == len(b.feature)
    none = toxicity.bags(words, firsts, np.empty(0, np.uint32))
    assert none.plain == len(firsts) == 102 and not len(none.times)


def test_toxicity_of_long_clean_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    m = queries.toxic_model(docs, labels)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").limit(600).collect()]
    alone = toxicity.score_texts(clean, m)
    assert np.mean(alone < 0.3) > 0.98
    clean = [t for t, s in zip(clean, alone, strict=True) if s < 0.1]
    long = ["\n".join(clean[i::3]) for i in range(3)]
    assert min(map(len, long)) > 100_000
    assert max(toxicity.score_texts(long, m)) < 0.3
    toxic = [r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").orderBy("doc_id").limit(20).collect()]
    score, spans = toxicity.judge_texts([f"{a}\n{b}" for a, b in zip(long * 7, toxic, strict=False)], m)
    assert np.mean(score >= 0.3) > 0.8
    for s, own in zip(score, spans, strict=True):
        assert bool(own) == (s >= 0.3)


def test_weak_bound_is_chosen_among_learnable_rows(monkeypatch):
    """Rows of remainder 2 are not looked at: trained on 0 and 1, judged on 3."""
    sf = "/root/testdata/sf0.1"
    data = duckdb.sql(f"SELECT d.doc_id, coalesce(text, ''), toxic FROM '{sf}/documents.parquet' d JOIN '{sf}/labels.parquet' l ON d.doc_id = l.doc_id WHERE toxic IS NOT NULL ORDER BY 1").fetchall()
    rest = lambda i: zlib.crc32(str(i).encode()) % 4
    learned, judged = [r for r in data if rest(r[0]) < 2], [r for r in data if rest(r[0]) == 3]
    f = list(toxicity.features([t for _, t, _ in learned]))
    m = toxicity.fit([a for a, _ in f], [b for _, b in f], np.array([y for *_, y in learned]))
    score = lambda weak, texts: (monkeypatch.setattr(toxicity, "WEAK", weak), toxicity.score_texts(texts, m))[1]
    toxic, clean = ([t for _, t, y in judged if y == x] for x in (1, 0))
    plain = 1e-300
    quiet = np.array([t for t, s in zip(clean, score(plain, clean), strict=True) if s < 0.1], object)
    rng = np.random.default_rng(0)
    long = ["\n".join(rng.choice(quiet, 100)) for _ in range(50)]
    caught = {w: (score(w, toxic) >= 0.3).sum() for w in (plain, 0.005, 0.01, 0.02, 0.05, 0.1)}
    wrong = {w: (score(w, long) >= 0.3).sum() for w in caught if caught[w] >= caught[plain]}
    chosen = min(wrong, key=lambda w: (wrong[w], w))
    monkeypatch.undo()
    assert chosen == toxicity.WEAK, (caught, wrong)


def test_toxicity_of_a_doc_id_in_many_rows(spark):
    data = [(1, "you fool"), (1, "a fool"), (2, "calm day"), (2, "calm day"), (3, "fool fool"), (4, "old fool"), (5, None), (6, ""), (None, "x")] + [(i, f"calm sea {i}") for i in range(10, 40)]
    labels = [(1, 1), (2, 0), (3, 1), (4, 1), (4, 0), (5, 0), (6, 1), (None, 1), (7, None)] + [(i, 0) for i in range(10, 40)]
    m = toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.score_texts(["fool", "calm day"], m)[0] > 0.5 > toxicity.score_texts(["fool", "calm day"], m)[1]


def test_toxicity_of_odd_rows(odd, spark, docs, none):
    m = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.s for r in odd.select(toxicity.toxicity(odd, m).alias("s")).collect()] == [0.0] * len(ODD)
    assert none.select(toxicity.toxicity(none, m).alias("s")).collect() == []


# -- SQL ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(r) for r in rel.fetchall())
    got = sorted(tuple(r) for r in queries.queries()[name](spark, SF).select(*cols).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)
