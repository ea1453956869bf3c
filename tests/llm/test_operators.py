"""Every operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import re
import tracemalloc
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from lupa.llm import edit_counts, leaks, lines, long_bpe, near_dups, quality, substring, token_files, toxicity, warc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
BLANKS = r"[^\x20\x09-\x0D]+"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 400, n))


@pytest.fixture
def odd(make_docs):
    long = prose(9, 9000)
    rows = [
        (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 78) + " other end"), (4, None), (5, ""), (6, "one two"), (7, "one two"),
        (8, long), (9, "x " + long), (9, "x " + long), (None, prose(3, 70)), (None, None), (10, prose(3, 70), None), (11, "a\n\nb\n", None),
        (12, "z" * 40000), (13, "é漢 " * 30), (14, "na\0me " * 30), (15, prose(4, 60) + " " + prose(4, 60)),
    ]
    return make_docs(rows, clashing=True)


@pytest.fixture
def none(make_docs):
    return make_docs([], clashing=True)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(row):
    return repr(tuple(row))


# -- 1 ------------------------------------------------------------------------


def plain_groups(rows, idf, similarity=near_dups.SIMILARITY):
    sets = near_dups.Shingles(pa.array([t for _, t in rows], pa.string()))
    weight = (sets.times * idf[sets.bucket()]).astype(float)
    held = defaultdict(dict)
    for text, run, w in zip(sets.text.tolist(), sets.run.tolist(), weight.tolist(), strict=True):
        held[text][run] = w
    label = list(range(len(rows)))
    for i in held:
        for j in held:
            if i < j and held[i].keys() & held[j].keys():
                low = sum(min(w, held[j].get(r, 0)) for r, w in held[i].items())
                if low / (sum(held[i].values()) + sum(held[j].values()) - low) >= similarity:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
    return [rows[x][0] for x in label]


def test_near_duplicates_equal_all_pairs(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    docs = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    expected = plain_groups(rows, near_dups.inverse_frequencies(docs, 5))
    found = {r.doc_id: r for r in near_dups.groups(documents).collect()}
    assert [found[i].group_id for i, _ in rows] == expected
    assert {r.doc_id for r in near_dups.deduplicated(documents).collect()} == set(expected)


def test_blocks_find_what_pivots_leave(spark, make_docs):
    """A family whose members are like their source but not like each other."""
    base = prose(5, 200).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        copy = list(base)
        copy[5 * i - 3] = copy[(5 * i + 90) % 200] = f"new{i}"
        rows.append((100 - i, " ".join(copy)))
    found = near_dups.groups(make_docs(rows)).collect()
    docs = make_docs(rows).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    expected = plain_groups(sorted(rows), near_dups.inverse_frequencies(docs, 5))
    assert [r.group_id for r in sorted(found, key=lambda r: r.doc_id)] == expected


def test_near_duplicates_of_odd_rows(odd, none):
    found = {r.doc_id: r for r in near_dups.groups(odd).collect() if r.doc_id is not None}
    assert found[2].class_id == 1 and found[3].group_id == 1 and found[7].class_id == 6
    assert found[4].group_id == 4 and found[5].group_id == 5 and found[9].group_id == 8
    assert found[10].group_id < -(2**62)  # its twin has no id
    kept = near_dups.deduplicated(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 8, 11, 12, 13, 14, 15, None}
    assert near_dups.groups(none).count() == near_dups.deduplicated(none).count() == 0


def test_ids_do_not_decide_what_is_compared(make_docs):
    """One id with two texts, each near another document, and rows without id that are copies."""
    a, b, c = prose(21, 90).split(), prose(22, 90).split(), prose(23, 90)
    near_a, near_b = " ".join(["x", *a[1:]]), " ".join(["y", *b[1:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near_a), (3, near_b)] + [(None, c)] * 5 + [(7, c)] + [(None, "")] * 3 + [(8, ""), (9, "")]
    docs = make_docs(rows, clashing=True)
    found = [(r.doc_id, r.class_id, r.group_id, r.stays) for r in near_dups.groups(docs).collect()]
    assert sorted(x[:3] for x in found if x[0] in (1, 2, 3)) == [(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1)]
    assert sum(x[3] for x in found if x[2] == 1) == 2  # two groups, both of lowest id 1
    copies = [x for x in found if x[0] in (None, 7) and x[2] < 0 and x[1] == min(y[1] for y in found)]
    assert sum(x[3] for x in found) == near_dups.deduplicated(docs).count() == 2 + 1 + 3
    kept = sorted(((r.doc_id, r.text) for r in near_dups.deduplicated(docs).collect()), key=repr)
    assert kept == sorted([(1, " ".join(a)), (1, " ".join(b)), (None, c), (None, ""), (8, ""), (9, "")], key=repr)
    assert copies


# -- 2 and 3 --------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "none", "documents"])
def test_token_files(spark, request, table):
    docs = request.getfixturevalue(table)
    folder = token_files.new_folder(spark, "test")
    token_files.write(docs, folder, WORDS, end_id=1)
    found = [tuple(r) for r in token_files.checksums(token_files.read(spark, folder)).orderBy("start").collect()]
    library, expected, start = Tokenizer.from_file(WORDS), [], 0
    for row in docs.select("doc_id", "text").orderBy("doc_id", "text").collect():
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 1]
        expected.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected


@pytest.mark.parametrize("table", ["odd", "none", "documents"])
def test_tree_encoding(request, table):
    docs = request.getfixturevalue(table)
    library = Tokenizer.from_file(BYTES)
    found = long_bpe.encode_decode(docs, BYTES, part=500).collect()
    expected = []
    for row in docs.select("doc_id", "text").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        expected.append((row.doc_id, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    got = [(r[0], r[1], bytes(r[2]), r[3]) for r in found]
    assert sorted(map(key, got)) == sorted(map(key, expected))


# -- 4 ------------------------------------------------------------------------


def plain_leaks(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(text):
        return pattern.findall("".join(c.lower() if c.isascii() else c for c in text or ""))

    wanted = defaultdict(set)
    for name, text in items:
        words = split(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            if size:
                wanted[tuple(words[i : i + size])].add(str(name))
    out = []
    for doc, text in docs:
        words, hit, names = split(text), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(words) - size + 1):
                if found := wanted.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((doc, len(words), len(hit), sorted(names)))
    return out


def test_decontamination(spark, documents, odd, none):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    more = spark.createDataFrame([(900, "one two"), (901, None), (902, ""), (903, "W1-w1"), (904, prose(1, 30))], "item_id long, text string")
    for docs, items in ((documents, benchmark.select("item_id", "text")), (odd, more), (documents, more), (none, more), (odd, more.limit(0))):
        found = leaks.find(docs, items).collect()
        got = [(r.doc_id, r.n_words, r.n_hit, sorted(set(r["items"]))) for r in found]
        expected = plain_leaks([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
        assert sorted(map(repr, got)) == sorted(map(repr, expected))
        assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit for r in found)
        kept = leaks.decontaminated(docs, items)
        assert kept.columns == docs.columns and kept.count() == sum(not x[2] for x in expected)


def plain_matches(docs, items, window=10):
    out = []
    for doc, text in docs:
        words, found = re.findall("[0-9a-zà-ÿ]+", (text or "").lower()), []
        for name, item in items:
            wanted = re.findall("[0-9a-zà-ÿ]+", (item or "").lower())
            for i in range(len(words)):
                for j in range(len(wanted)):
                    n = 0
                    while i + n < len(words) and j + n < len(wanted) and words[i + n] == wanted[j + n]:
                        n += 1
                    left = i and j and words[i - 1] == wanted[j - 1]
                    if not left and n >= min(window, len(wanted)):
                        found.append((str(name), i, j, n))
        out.append((doc, max((x[3] for x in found), default=0), sorted(found)))
    return out


def test_longest_matches_do_not_depend_on_the_shard(spark, make_docs):
    """Two texts of one shard share 10 and 30 words with one item; others share several places."""
    item = prose(70, 40).split()
    twice = item[5:20] + ["other"] + item[5:20]
    rows = [(1, " ".join(["x", *item[:10], "y"])), (2, " ".join(["x", *item[:30], "y"])), (3, " ".join(twice)),
            (4, " ".join(item[:9])), (5, "a b a b a b"), (6, None), (7, " ".join(item + item))]
    items = [(800, " ".join(item)), (801, "a b a"), (802, " ".join(twice)), (803, None)]
    docs, benchmark = make_docs(rows).coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    whole = {r.doc_id: (r.longest, sorted(map(tuple, r.matches))) for r in leaks.find(docs, benchmark).collect()}
    assert [(i, *whole[i]) for i, _ in rows] == plain_matches(rows, items)
    assert whole[1][0] == 10 and whole[2][0] == 30 and whole[4][0] == 0
    apart = leaks.find(docs.repartition(7, "doc_id"), benchmark).collect()
    assert {r.doc_id: (r.longest, sorted(map(tuple, r.matches))) for r in apart} == whole


def test_repetitive_texts_make_no_pairs():
    """800 equal words in an item, 80,000 in a text: 63 million pairs of places, 80,781 longest matches."""
    items = leaks.Items(["i", "j"], ["a " * 800, "b a b"], 10)
    tracemalloc.start()
    shard = leaks.shard_of(pa.array(["a " * 80_000, "b", "a b a b a b"]), items)
    hit, matches, pairs = leaks.hit_words(shard), leaks.longest_matches(shard, items), leaks.items_in_texts(shard, items)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    assert hit[:80_000].all() and not hit[80_000] and hit[80_002:].sum() == 5
    assert len(matches[0]) == 80_781 + 2 and matches[-1].max() == 800 and (matches[-1][:-2] >= 10).all()
    assert [x.tolist() for x in pairs] == [[0, 2], [0, 1]]


def test_periodic_texts_against_all_matches(spark, make_docs):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["a", "b"], rng.integers(1, 60)))) for i in range(25)] + [(90, "a b " * 30), (91, "a " * 50)]
    items = [(str(i), " ".join(rng.choice(["a", "b"], rng.integers(1, 30)))) for i in range(12)] + [("x", "b a " * 12), ("x", "b a " * 12)]
    docs, benchmark = make_docs(rows).coalesce(2), spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: (r.longest, sorted(map(tuple, r.matches))) for r in leaks.find(docs, benchmark, window=4).collect()}
    assert [(i, *found[i]) for i, _ in rows] == plain_matches(rows, items, 4)


def test_a_benchmark_in_parts(spark, documents, odd):
    more = [(900, "one two"), (901, None), (902, ""), (903, "W1-w1"), (904, prose(1, 30)), (905, prose(1, 12)), (906, prose(4, 40))]
    benchmark = spark.createDataFrame(more, "item_id long, text string").repartition(3)
    for docs in (odd, documents):
        whole, parts = (leaks.find(docs, benchmark, most_words=m) for m in (leaks.MOST_WORDS, 20))
        shown = [sorted(repr((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.longest, r.spans, sorted(r.matches))) for r in x.collect()) for x in (whole, parts)]
        assert shown[0] == shown[1]
        assert leaks.decontaminated(docs, benchmark, most_words=20).count() == leaks.decontaminated(docs, benchmark).count()


# -- 5 ------------------------------------------------------------------------


def plain_measures(text):
    words = re.findall(BLANKS, text or "")
    rows = [x for x in (text or "").split("\n") if re.search(BLANKS, x)]
    runs = defaultdict(list)
    for i in range(len(words) - 2):
        runs[tuple(words[i : i + 3])].append(i)
    again = {j for found in runs.values() if len(found) > 1 for i in found for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), len(again), n < 50 or 100 * len(again) > 50 * n


@pytest.mark.parametrize("table", ["odd", "none", "documents"])
def test_quality_measures(request, table):
    docs = request.getfixturevalue(table)
    found = [tuple(r)[:7] for r in quality.judged(docs).collect()]
    assert sorted(map(repr, found)) == sorted(repr((r.doc_id, *plain_measures(r.text))) for r in docs.collect())


def test_the_order_of_rules_does_not_change_the_verdict(documents, odd):
    texts = pa.array([r.text for d in (documents, odd) for r in d.collect()], pa.string())
    alone = np.ones(len(texts), bool)
    for rule in quality.RULES:
        alone &= ~rule.rejects(quality.Texts(texts))
    for rules in (quality.RULES, quality.RULES[::-1], quality.ordered(documents)):
        assert (quality.passes(texts, rules) == alone).all()
    kept = quality.accepted(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, 9, 10, None, 15} - ({15} if not alone[-1] else set())


def test_quality_agrees_with_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judged(documents).join(labels, "doc_id").filter("n_words >= 50").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


# -- 6 and 7 --------------------------------------------------------------------


def plain_lines(rows, ratio, least):
    pages, held = defaultdict(int), defaultdict(int)
    for _, text, host in rows:
        pages[host] += 1
        for line in set((text or "").split("\n")):
            held[host, line] += 1
    out = []
    for doc, text, host in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        all_ = text.split("\n")
        left = [x for x in all_ if not re.search(BLANKS, x) or held[host, x] < least or held[host, x] <= ratio * pages[host]]
        out.append((doc, "\n".join(left), len(all_), len(all_) - len(left)))
    return out


def test_line_dedup(odd, none, documents, make_docs):
    shared = make_docs([(i, f"menu\nown {i}\n\nmenu" if i % 2 else "menu", None if i % 3 else "h") for i in range(20)] + [(99, None, "h")])
    for docs, least in ((odd, 2), (none, 2), (documents, 5), (shared, 2)):
        found = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.without_boilerplate(docs, "source", "text", 0.2, least).collect()]
        expected = plain_lines([(r.doc_id, r.text, r.source) for r in docs.collect()], 0.2, least)
        assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_boilerplate_of_many_hosts(documents, odd, monkeypatch):
    """Joined by host where the lines are too many to be sent to all tasks."""
    for docs in (odd, documents):
        few = lines.without_boilerplate(docs, "source", "text", 0.2, 2)
        with monkeypatch.context() as patch:
            patch.setattr(lines, "MOST_SENT", -1)
            many = lines.without_boilerplate(docs, "source", "text", 0.2, 2)
        assert many.columns == few.columns and sorted(map(key, many.collect())) == sorted(map(key, few.collect()))


def test_copies_keep_one_text_in_the_pipeline(spark, make_docs, odd, none):
    """Five copies in a source of 40 pages; the menu is in 30 other pages."""
    clean = prose(50, 60) + "\n" + prose(51, 60)
    rows = [(i, clean) for i in range(5)] + [(i, ("menu of all\n" if i < 35 else "") + prose(60 + i, 60)) for i in range(5, 40)]
    docs = make_docs([(i, text, "s" if i % 2 or i < 5 else None) for i, text in rows] + [(90, None), (91, None)])
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert all(left[i] == clean for i in range(5)) and left[90] is None
    assert all(left[i] == text.removeprefix("menu of all\n") for i, text in rows[5:])
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs, ""), "").collect()
    assert [r.doc_id for r in kept if r.text == clean] == [0] and not [r for r in kept if r.text == ""]
    for docs in (odd, none, docs):
        every, texts = docs.collect(), {(r.text, r.source) for r in docs.collect()}
        expected = {t: x[1:] for t, x in zip(texts, plain_lines([(0, *t) for t in texts], 0.2, 2), strict=True)}
        found = lines.without_boilerplate(docs, "source", "text", 0.2, 2, distinct=True).collect()
        got = sorted(repr((r.doc_id, r.source, r.text, r.n_lines, r.n_dropped)) for r in found)
        assert got == sorted(repr((r.doc_id, r.source, *expected[r.text, r.source])) for r in every)


def plain_repeats(rows, k):
    first, words = {}, {}
    for place, (doc, text) in enumerate(rows):
        words[place] = re.findall(BLANKS, text or "")
        for i in range(len(words[place]) - k + 1):
            window = tuple(words[place][i : i + k])
            rank = -(2**63) if doc is None else doc
            first[window] = min(first.get(window, rank), rank)
    out = []
    for place, (doc, _) in enumerate(rows):
        own, gone, seen = words[place], set(), set()
        for i in range(len(own) - k + 1):
            window = tuple(own[i : i + k])
            if window in seen or first[window] < (-(2**63) if doc is None else doc):
                gone |= set(range(i, i + k))
            seen.add(window)
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


@pytest.mark.parametrize("sample", [1, 64])
@pytest.mark.parametrize("table", ["odd", "none", "documents", "common"])
def test_substring_dedup(request, make_docs, monkeypatch, table, sample):
    monkeypatch.setattr(substring, "SAMPLE", sample)
    passage = prose(8, 40)
    docs = make_docs([(i, f"{prose(100 + i, 30)} {passage} {prose(200 + i // 2, 30)}") for i in range(60)]) if table == "common" else request.getfixturevalue(table)
    found = [tuple(r) for r in substring.remove_repeats(docs).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, plain_repeats([(r.doc_id, r.text) for r in docs.collect()], 20)))


# -- 8 ------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) > 0
    chain = toxicity.fit(documents, labels.filter(half), ("low_quality", "toxic"), folds=2)
    rows = toxicity.score(documents, chain).join(labels.filter(~half), "doc_id").collect()
    assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in rows) >= 0.85 * len(rows)
    assert chain.weights[1].shape[0] == toxicity.BUCKETS + 1


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, 0), (None, 1), (6, None), (1, 1), (8, 1), (9, 0)], "doc_id long, bad int")
    chain = toxicity.fit(odd, labels, ("bad",), folds=2)
    rows = toxicity.score(odd, chain).collect()
    assert len(rows) == odd.count() and all(0 <= r.p_bad <= 1 for r in rows)
    assert toxicity.score(none, chain).count() == 0
    same = toxicity.fit(none, labels, ("bad",), folds=2)
    assert {r.p_bad for r in toxicity.score(odd, same).collect()} == {0.5}


# -- 9 and 10 -------------------------------------------------------------------


@pytest.mark.parametrize("table", ["odd", "none", "documents"])
def test_counts_after_masking(request, table):
    docs = request.getfixturevalue(table)
    library = Tokenizer.from_file(BYTES)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    trees = edit_counts.build(docs, BYTES)
    rows = edit_counts.recount(trees, None, BYTES, edits_of=edit_counts.masking_edits).collect()
    assert all(r.n_tokens == count(r.text) and r.tree[0] == r.n_tokens for r in rows)
    assert sorted(r.n_tokens_before for r in rows) == sorted(count(r.text) for r in docs.collect())


def test_counts_after_given_edits(spark, odd):
    edits = spark.createDataFrame([(1, [(0, 2, "new"), (9, 9, None)]), (5, [(0, 0, "text")]), (777, [(0, 1, "")]), (13, [(1, 2, "x"), (None, 3, "y")])],
                                  f"doc_id long, edits {edit_counts.EDITS}")
    rows = {r.doc_id: r for r in edit_counts.recount(edit_counts.build(odd, BYTES), edits, BYTES).collect()}
    assert rows[1].text.startswith("new") and rows[5].text == "text" and rows[13].text.startswith("éx ") and 777 not in rows
    library = Tokenizer.from_file(BYTES)
    assert all(rows[i].n_tokens == len(library.encode(rows[i].text, add_special_tokens=False).ids) for i in (1, 5, 13))


def test_archives(spark):
    large = "x" * 2000
    rows = [(1, None, large), (2, "u v", large), (2, "u v", large), (None, "n", large), (3, "a", None), (4, "a\nb", "y"), (5, "b", "y"),
            (None, None, "q" * 1500), (None, None, "q" * 1500), (6, "é", "é" * 600), (7, "c", "é" * 600)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, _digest string")
    folder = token_files.new_folder(spark, "test")
    warc.write(pages, folder)
    found = [tuple(r) for r in warc.payload_sizes(warc.read(spark, folder)).collect()]
    held = {large: 2, "é" * 600: 7}
    expected = []
    for page, _, html in rows:
        other = held.get(html) if held.get(html) != page else None
        data = (html or "").encode()
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", other))
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    one = warc.fetch(spark, folder, spark.createDataFrame([(6,), (7,)], "page_id long")).collect()
    assert {(r.page_id, r.refers_to, r.payload and bytes(r.payload).decode()) for r in one} == {(6, 7, None), (7, None, "é" * 600)}
    empty = token_files.new_folder(spark, "test")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0
