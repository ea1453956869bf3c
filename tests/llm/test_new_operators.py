"""URL filters, whitening and fill-in-middle against plain versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from lupa.llm import infill, queries, token_files, urls, whitening
from lupa.llm.spectra import Spectrum, solve
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
CLASHING = ("_id", "_x", "_at", "_text", "_host", "_path", "_label", "host", "path", "rule", "score", "n", "form", "component", "whitened")


def with_clashes(df):
    return df.select("*", *(F.lit("x").alias(name) for name in CLASHING if name not in df.columns))


# -- whitening ----------------------------------------------------------------


MATRICES = {
    "normal": lambda r: np.floor(r.normal(size=(300, 24)) * 40),
    "fewer than dimensions": lambda r: np.floor(r.normal(size=(7, 24)) * 40),
    "copies": lambda r: np.repeat(np.floor(r.normal(size=(9, 24)) * 40), 20, 0),
    "scales": lambda r: r.normal(size=(200, 24)) * 10.0 ** r.uniform(-4, 6, 24),
    "low rank": lambda r: np.floor(r.normal(size=(200, 3)) * 9) @ np.floor(r.normal(size=(3, 24)) * 9),
    "axes": lambda r: np.eye(24),
    "one dimension": lambda r: r.normal(size=(5, 1)),
    "two dimensions": lambda r: r.normal(size=(50, 2)),
    "equal": lambda r: np.ones((6, 24)),
    "far from zero": lambda r: 1e9 + r.normal(size=(100, 24)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_spectra_equal_a_whole_decomposition(name):
    x = MATRICES[name](np.random.default_rng(1))
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    top = max(np.linalg.eigvalsh(scatter)[-1], 1e-300)
    one, two = Spectrum(x.shape[1]), Spectrum(x.shape[1])
    for row in x:
        one.add(row)
    for row in x[::2]:
        two.add(row)
    other = Spectrum(x.shape[1])
    for row in x[1::2]:
        other.add(row)
    two.merge(other)
    for found in (one, two):
        assert found.n == len(x)
        assert np.abs(found.mean - x.mean(0)).max() <= 1e-12 * np.abs(x).max()
        assert np.abs(found.vectors.T @ found.vectors - np.eye(x.shape[1])).max() < 1e-12
        near = 1e-11 if name != "far from zero" else 1e-6
        assert np.abs(found.vectors * found.values @ found.vectors.T - scatter).max() <= near * max(top, np.abs(x).max() ** 2 * 1e-15)
        assert np.all(np.diff(found.values) >= 0)


def test_secular_equation_with_close_poles():
    for gap in (1e-3, 1e-9, 1e-13):
        d = np.array([1.0, 1.0 + gap, 2.0, 2.0 + gap, 5.0])
        z = np.array([0.5, 1e-7, 0.3, 0.4, 0.6])
        values, vectors = solve(d, z, 2.5)
        whole = np.diag(d) + 2.5 * np.outer(z, z)
        assert np.abs(np.linalg.eigvalsh(whole) - values).max() < 1e-13
        assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-13
        assert np.abs(vectors * values @ vectors.T - whole).max() < 1e-13


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def plain_whitening(rows, k=4):
    """Rows of (id, vector), decomposed at once."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(256.0 * np.float64(np.float32(c)))) for c in v] for _, v in kept]
    distinct = sorted(set(map(tuple, x)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array(distinct, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    whitened = (np.array(x) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    return [i for i, _ in kept], n, deviation, whitened, values[order] / values.sum()


def check_whitening(df, rows):
    ids, n, deviation, whitened, explained = plain_whitening(rows)
    found = df.collect()
    k = whitened.shape[1]
    assert len(found) == len(ids) * k and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    sign = [0] * k
    expected = {}
    for j, i in enumerate(ids):
        expected.setdefault((i, deviation[j]), []).append(j)
    assert {key: len(v[1]) for key, v in got.items()} == {key: len(v) for key, v in expected.items()}
    for key, parts in got.items():
        j = expected[key][0]
        for c, held in parts.items():
            sign[c - 1] = sign[c - 1] or np.sign(held[0].whitened * whitened[j, c - 1])
            for r in held:
                assert abs(r.whitened * sign[c - 1] - whitened[j, c - 1]) < 1e-8
                assert abs(r.explained / explained[c - 1] - 1) < 1e-9


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(37)
    check_whitening(queries.op12_embedding_whitening(spark, SF), [(r.vec_id, r.embedding) for r in table.collect()])
    check_whitening(whitening.components(table), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(r.normal(size=(60, 6)))]
    rows += [(100, rows[0][1])] * 30 + [(None, rows[1][1]), (None, rows[2][1])]
    odd = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [1.0, 2.0])]
    df = with_clashes(spark.createDataFrame(rows + odd, VECTORS))
    check_whitening(whitening.components(df), rows)
    none = whitening.components(df.filter("false"))
    assert none.count() == 0 and none.columns == whitening.components(df).columns
    flat = whitening.components(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], VECTORS)).collect()
    assert [(x.whitened, x.explained, x.identity_error) for x in flat] == [(0.0, 0.0, 0.0)] * 4


def test_exact_deviations_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [3e15, 1.0]), (2, [-3e15, 2.0]), (3, [1e13, 3.0])], VECTORS)
    model = whitening.fit(df)
    x = [[int(np.floor(256.0 * np.float64(np.float32(c)))) for c in v] for v in ([3e15, 1.0], [-3e15, 2.0], [1e13, 3.0])]
    sums = [sum(c) for c in zip(*x, strict=True)]
    expected = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(df, model).collect()} == expected
    assert {r.deviation for r in whitening.components(df).filter("vec_id < 3").collect()} == {None}


# -- fill in the middle -------------------------------------------------------


def plain_infill(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    digest = hashlib.sha256(text.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, digest, digest
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, a, b - a, hashlib.sha256(out.encode()).hexdigest(), digest


def infilled(df, frame=infill.FRAME, bundle=infill.BUNDLE):
    folder = token_files.new_folder(df.sparkSession, "infill")
    infill.store(df, f"{folder}/a", frame=frame, bundle=bundle)
    infill.transform(df.sparkSession, f"{folder}/a", f"{folder}/b", frame=frame)
    return folder, infill.read(df.sparkSession, f"{folder}/b")


ODD_TEXTS = [
    (1, None), (2, ""), (3, "a"), (4, "é漢😀" * 40), (5, "ends with <"), (6, "<P"), (7, "holds <M> itself"), (8, "<S" * 50), (9, "\0\n\r" * 9),
    (None, "no id"), (None, "no id"), (None, None), (10, "twice"), (10, "twice"), (10, "other"), (-5, "negative " * 30),
    (11, "x" * 300_000 + "ü" * 100_000), (12, "<" * 5000), (13, "x" * 9998 + "<P>"), (2**62, "😀"),
] + [(100 + i, "wörd " * i) for i in range(60)]


@pytest.mark.parametrize(("frame", "bundle"), [(infill.FRAME, infill.BUNDLE), (7, 200), (64, 1)])
def test_fill_in_middle_of_odd_rows(spark, make_docs, frame, bundle):
    rows = [r for r in ODD_TEXTS if frame > 60 or len(r[1] or "") < 5001]
    df = with_clashes(make_docs(rows))
    folder, found = infilled(df, frame, bundle)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_infill(*r) for r in rows), key=repr)
    rebuilt = infill.texts(spark, f"{folder}/b", rebuilt=True)
    assert sorted(((r.doc_id, r.text) for r in rebuilt.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert infilled(df.filter("false"))[1].count() == 0


def test_fill_in_middle_of_the_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.op13_fill_in_middle(spark, SF)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op13_fill_in_middle"]).fetchall())
    assert got == sorted(plain_infill(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_cuts_decompress_their_frames_only(tmp_path):
    random.seed(2)
    text = "".join(random.choice("aé漢😀\n") for _ in range(20_000))
    out = infill.Writer(str(tmp_path), frame=100)
    for doc_id, part in ((1, "first"), (2, text), (3, "")):
        out.begin(doc_id)
        out.put(part.encode())
        out.end()
    bundle = infill.Reader(str(tmp_path), out.close()["bundle"])
    listed = list(bundle.texts())
    assert [(x[0], x[4]) for x in listed] == [(1, 5), (2, 20_000), (3, 0)]
    _, byte, size, unit, units, _ = listed[1]
    assert bundle.byte_of(unit + 12_345) == byte + len(text[:12_345].encode()) and bundle.unpacked == 1
    assert bundle.byte_of(unit + units) == byte + size
    assert b"".join(bundle.stream(byte + 0, byte + size)).decode() == text


# -- URLs ---------------------------------------------------------------------


PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_rule(url, rules):
    """Host, path and the deciding rule, straight from the definition."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = []
    for r in rules:
        name, slash, begin = r.rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + begin):
            fits.append(r)
    best = min(fits, key=lambda r: (-len(r.rule), r.rule), default=None)
    return host, path, best


ODD_URLS = [
    None, "", "no scheme/x", "http://", "http:///only/path", "HTTP://WWW.Example.NET/EN/x", "http://example.net/en/", "http://a.example.net/en",
    "http://net/", "http://net", "x://a.net?q=/", "x://a.net#f", "http://xnet/", "http://a.example.com/de/é?x", "http://ÄB.org/fr/1", "http://org/fr/",
    "a://b://c/d", "http://a.org/fr\n/x", "http://u:p@b.net:80/", "http://" + "long" * 3000 + ".com/" + "y" * 30_000, "http://a..net/", "http://.org/fr/",
    "http://example.com.evil.org/de/", "http://\ud7ff漢.com/", "http://a.com/<b>?", "http://net./",
]


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(ODD_URLS)] + [(None, "http://a.net/", None)] * 2
    df = with_clashes(spark.createDataFrame(rows, PAGE))
    model = urls.Model(urls.words_model(urls.word_counts(df), ("casino",)))
    found = urls.judge(df, model, queries.RULES).collect()
    expected = [(i, *plain_rule(u, queries.RULES)) for i, u, _ in rows]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found), key=repr)
    assert got == sorted(((i, h, p, b and b.rule, b.verdict if b else "allow") for i, h, p, b in expected), key=repr)
    assert urls.judge(df.filter("false"), model, queries.RULES).count() == 0
    extra = [*queries.RULES, urls.Rule("block", "a.net"), urls.Rule("allow", "")]
    by_id = {r.page_id: r for r in urls.judge(df, model, extra).collect()}
    assert all(by_id[i].rule == (plain_rule(u, extra)[2].rule if plain_rule(u, extra)[2] else None) for i, u, _ in rows if i is not None)


def best_split(run, words):
    """All ways to cut a short run."""
    if not run:
        return 0.0
    return max(words.of(run[:i]) + best_split(run[i:], words) for i in range(1, len(run) + 1))


def test_segments_are_the_most_probable(spark):
    words = urls.Words({w: np.log(n / 1000) for w, n in {"free": 40, "bets": 10, "online": 30, "on": 90, "line": 30, "a": 100, "be": 50, "ts": 1}.items()}, 1000.0)
    assert urls.segment("freebetsonline", words) == ["free", "bets", "online"]
    assert urls.segment("", words) == []
    for run in ("freebets", "abeon", "zzz", "onlinea", "qbetsq", "tsts"):
        pieces = urls.segment(run, words)
        assert "".join(pieces) == run
        assert abs(sum(map(words.of, pieces)) - best_split(run, words)) < 1e-9
    assert "".join(urls.segment("ab" * 5000, words)) == "ab" * 5000


def test_visible_words():
    html = b"<!-- hidden --><style>p{}</style><script>var no;</script><p>The (word), a <b>site.example</b> x1 re-do End.</p>caf\xc3\xa9 <open never closed"
    assert urls.visible_words(html) == [b"the", b"word", b"a", b"end", b"open", b"never", b"closed"]
    assert urls.visible_words(b"<!--" * 200_000) == [] and urls.visible_words(b"<script " * 100_000 + b"a")[-1] == b"a"


BAD, GOOD = ("bets", "casino", "poker", "slots", "jackpot"), ("garden", "river", "music", "school", "bread", "stone", "winter")
FILL = ("best", "my", "online", "shop", "the", "blog", "world")


def made_pages(seed, n):
    """Pages with names run together; block where the name has a bad word."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad = r.random() < 0.3
        host = "".join(r.choice(FILL) for _ in range(r.randint(0, 2))) + r.choice(BAD if bad else GOOD) + "".join(r.choice(FILL) for _ in range(r.randint(0, 2)))
        text = " ".join(r.choice(BAD + GOOD + FILL) for _ in range(20))
        rows.append((i, f"https://www.{host}.com/{r.choice(FILL)}/{i}.html", f"<p>{text}.</p>", "block" if bad else "allow"))
    return rows


def test_classifier_on_held_out_hosts(spark):
    schema = T.StructType([*PAGE.fields, T.StructField("label", T.StringType())])
    train, test = spark.createDataFrame(made_pages(1, 600), schema), spark.createDataFrame(made_pages(2, 300), schema)
    words = urls.words_model(urls.word_counts(train))
    model = urls.fit(train, words, "label")
    truth = {r[0]: r[3] for r in made_pages(2, 300)}
    found = {r.page_id: r.verdict for r in urls.judge(test, model, ()).collect()}
    wrong = sum(truth[i] != v for i, v in found.items())
    assert len(found) == 300 and wrong <= 3
    # by seeds alone, and the same from other partitions
    seeded = urls.fit(train, words, urls.weak_label(("bets", "casino", "poker", "slots", "jackpot")))
    again = urls.fit(train.repartition(9), words, urls.weak_label(("bets", "casino", "poker", "slots", "jackpot")))
    assert np.array_equal(seeded.odds, again.odds) and np.array_equal(seeded.odds, model.odds) and seeded.prior == model.prior


def test_odds_equal_plain_counts(spark):
    schema = T.StructType([*PAGE.fields, T.StructField("label", T.StringType())])
    rows = [*made_pages(3, 80), (900, "http://a.com/", None, None), (901, None, None, "block")]
    df = spark.createDataFrame(rows, schema)
    words = urls.words_model(urls.word_counts(df))
    model = urls.fit(df, words, "label")
    tokens = urls.Tokens(words)
    counts = {"block": {}, "allow": {}}
    for _, url, _, label in rows:
        host, path, _ = plain_rule(url, ())
        for t in tokens.of(host, path) if label else ():
            counts[label][urls.bucket(t)] = counts[label].get(urls.bucket(t), 0) + 1
    seen = counts["block"].keys() | counts["allow"].keys()
    size = {v: sum(c.values()) + len(seen) for v, c in counts.items()}
    for b in seen:
        plain = np.log((counts["block"].get(b, 0) + 1) / size["block"]) - np.log((counts["allow"].get(b, 0) + 1) / size["allow"])
        assert abs(model.odds[b] - plain) < 1e-12
    labels = [r[3] for r in rows]
    assert abs(model.prior - np.log(labels.count("block") / labels.count("allow"))) < 1e-12


def test_pages_of_the_table(spark):
    # large enough a table for some pages of each seeded name
    table = "/root/testdata/sf0.1"
    found = queries.op11_url_filters(spark, table).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{table}/pages.parquet").collect()}
    assert len(found) == len(pages)
    names = re.compile("casino|pills|bets|adult|spam|ads-")
    for r in found:
        host, path, rule = plain_rule(pages[r.page_id], queries.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.rule)
        assert r.verdict == (rule.verdict if rule else "block" if names.search(host) else "allow")


def test_labels_of_one_kind(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "x")], PAGE)
    words = urls.words_model(urls.word_counts(df))
    for label in ("block", "allow"):
        model = urls.fit(df.withColumn("label", F.lit(label)), words, "label")
        assert [r.verdict for r in urls.judge(df, model, ()).collect()] == [label]
    assert urls.fit(df.withColumn("label", F.lit(None).cast("string")), words, "label").score([1]) < 0
