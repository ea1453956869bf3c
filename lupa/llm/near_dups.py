"""Near-duplicate groups by improved consistent weighted sampling.

A document is the weighted set of its runs of five words: weight = times in the document x inverse
document frequency. Two documents are linked when the weighted Jaccard similarity, the sum of the
lower weights over the sum of the higher ones, is at least the threshold; groups are the connected
components of the links.

1. Document frequencies are counted over all documents into a table of fixed size (``BUCKETS``
   numbers, about 1 MB), as feature hashing does. Runs that share a bucket share a frequency, so all
   documents see the same weights. This table is the only thing that is broadcast. The logarithm is
   damped by a power, since the runs of a text with thousands of near copies are frequent because of
   these copies, and undamped their few different words would outweigh all that they share.
2. Documents of equal words are one class, and only one of them is compared further.
3. Consistent weighted sampling draws, for each of ``bands x rows`` hash functions, the same run from
   two documents with a probability equal to their similarity. Classes whose draws agree in all rows
   of a band meet in a bucket.
4. In each bucket one class, the pivot, is compared exactly with all others. Links join classes to
   components, and a bucket that is in one component is done. The classes of the others are dealt to
   blocks of about ``BLOCK`` and each two blocks are compared in full by a matrix product in one task,
   which returns only the links that join components. So no pairs of a group are emitted, and no
   candidate pair is left undecided.
5. Every comparison is exact, on whole texts.

Null and empty texts have no words: each is a class and group of its own. Texts of one to four words
are one run. Rows of one id with different texts are documents of their own, which are compared as any others. A
document without id takes a number below ``-2**62`` made from its text. One row of each group stays, also where rows agree in
id and text: that of the lowest id, then of the lowest text hash. Ties cannot change groups: links and components do
not depend on any order. Very long texts are compared whole; a task holds one at a time beside its slice. An empty
table gives empty results. Columns of any name may come along with ``deduplicated`` and are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.session import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 4
BUCKETS = 1 << 18
DAMPING = 0.25
BLOCK = 256

_SLICE = 1 << 20
_DEFAULTS = {"k": SHINGLE, "similarity": SIMILARITY, "bands": BANDS, "rows": ROWS}
_COLUMNS = 4096
_SIZED = 1e-9


class Shingles:
    """Distinct runs of words of each text of a column, with how often each occurs."""

    def __init__(self, column, k: int = SHINGLE):
        words = W.words_of(column, W.split_table())
        runs, starts = W.windows(words.hash, k), W.whole_windows(words, k)
        text = np.searchsorted(words.first, starts, "right") - 1
        runs = runs[starts]
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            alone = np.array([_run(words.hash[words.first[i] : words.first[i + 1]]) for i in short], dtype=np.uint64)
            runs, text = np.append(runs, alone), np.append(text, short)
        order = np.lexsort((runs, text))
        runs, text = runs[order], text[order]
        fresh = np.ones(len(runs), bool)
        fresh[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(fresh)
        self.words, self.run, self.text = words, runs[head], text[head]
        self.times = np.diff(np.append(head, len(runs)))
        self.texts = len(counts)

    def bucket(self) -> np.ndarray:
        return (self.run % np.uint64(BUCKETS)).astype(np.int64)


def _run(hashes: np.ndarray) -> np.uint64:
    out = np.array([len(hashes)], dtype=np.uint64)
    for one in hashes:
        out = W.mix(out * W._BASE + one)
    return out[0]


def _frequencies(k: int):
    """Documents per bucket, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                total += np.bincount(Shingles(batch.column("_text"), k).bucket(), minlength=BUCKETS)
        held = np.flatnonzero(total)
        for part in np.array_split(held, max(1, len(held) // 65536)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "n"])

    return run


def inverse_frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Weight of one occurrence of a run, by bucket; ``BUCKETS`` numbers reach the driver."""
    counted = docs.select("_text").mapInArrow(_frequencies(k), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    held = counted.toPandas()
    total = np.ones(BUCKETS)
    total[held["bucket"].to_numpy()] = held["n"].to_numpy()
    n = max(1, docs.count())
    return ((np.log1p(n / total) / np.log1p(n)) ** DAMPING).astype(np.float32)


def _gamma_two() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2."""
    share = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low.astype(np.float32)


class Sampler:
    """Consistent weighted samples; each function draws from 64 bits made of run and function number."""

    def __init__(self, functions: int, seed: int = 1):
        self.gamma = _gamma_two()
        self.exponential = -np.log((np.arange(65536) + 0.5) / 65536).astype(np.float32)
        self.uniform = ((np.arange(65536) + 0.5) / 65536).astype(np.float32)
        self.salts = W.mix(np.arange(1, functions + 1, dtype=np.uint64) + np.uint64(seed << 32))

    def draw(self, run: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One row for each text, one column for each function."""
        out = np.empty((len(starts), len(self.salts)), dtype=np.uint64)
        log_weight = np.log(weight).astype(np.float32)
        owner = np.repeat(np.arange(len(starts)), sizes)
        for i, salt in enumerate(self.salts):
            bits = (run ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            bits ^= bits >> np.uint64(32)
            bits *= np.uint64(0x94D049BB133111EB)
            bits ^= bits >> np.uint64(29)
            part = bits.view(np.uint16).reshape(-1, 4)
            r, beta = self.gamma[part[:, 0]], self.uniform[part[:, 1]]
            c = self.exponential[part[:, 2]] + self.exponential[part[:, 3]]
            t = np.floor(log_weight / r + beta)
            rank = np.log(c) - r * (t - beta + 1)
            least = np.minimum.reduceat(rank, starts)
            spot = np.flatnonzero(rank == np.repeat(least, sizes))
            first = np.ones(len(spot), bool)
            first[1:] = owner[spot[1:]] != owner[spot[:-1]]
            spot = spot[first]
            out[:, i] = W.mix(run[spot] ^ W.mix(t[spot].astype(np.int64).view(np.uint64)))
        return out


def _signatures(k: int, bands: int, rows: int, weights):
    """Class, total weight and bucket of each band of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        sampler = Sampler(bands * rows)
        for whole in batches:
            for batch in W.text_batches(whole, "_text", _SLICE):
                yield signed(batch, idf, sampler)

    def signed(batch, idf, sampler):
        sets = Shingles(batch.column("_text"), k)
        weight = sets.times * idf[sets.bucket()]
        full, starts, sizes = np.unique(sets.text, return_index=True, return_counts=True)
        bucket = np.zeros((sets.texts, bands), np.uint64)
        total = np.zeros(sets.texts)
        if len(full):
            drawn = sampler.draw(sets.run, weight, starts, sizes)
            for band in range(bands):
                mixed = np.full(len(full), band + 1, dtype=np.uint64)
                for row in range(rows):
                    mixed = W.mix(mixed * W._BASE + drawn[:, band * rows + row])
                bucket[full, band] = mixed
            total[full] = np.add.reduceat(weight.astype(np.float64), starts)
        one, other = _digests(sets.words)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(bucket.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
        lists = pa.compute.if_else(pa.array(total > 0), lists, pa.scalar(None, lists.type))
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_key"), batch.column("_code"), pa.array(one.view(np.int64)), pa.array(other.view(np.int64)),
             pa.array(total), lists],
            ["_id", "_key", "_code", "_one", "_other", "_weight", "_buckets"],
        )

    return run


def _digests(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the word sequence of each text."""
    counts = np.diff(words.first)
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], counts)
    out = []
    for seed in (3, 5):
        power = W._powers(int(counts.max()) if len(counts) else 0, seed)
        value = W.mix(words.hash + np.uint64(seed)) * power[place]
        total = np.zeros(len(counts), np.uint64)
        full = np.flatnonzero(counts)
        if len(full):
            total[full] = np.add.reduceat(value, words.first[:-1][full])
        out.append(W.mix(total + counts.astype(np.uint64)))
    return out[0], out[1]


def _similarity(k: int, weights):
    """Weighted Jaccard similarity of two texts in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = weights.value
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                a, b = Shingles(batch.column("_text"), k), Shingles(batch.column("_with"), k)
                run_, text = np.append(a.run, b.run), np.append(a.text, b.text)
                times = np.append(a.times, b.times)
                weight = idf[(run_ % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float64)
                order = np.lexsort((run_, text))
                run_, text, times, weight = run_[order], text[order], times[order], weight[order]
                both = np.flatnonzero((run_[1:] == run_[:-1]) & (text[1:] == text[:-1]))
                rows = len(batch)
                lower = np.bincount(text[both], np.minimum(times[both], times[both + 1]) * weight[both], rows)
                higher = np.bincount(text, times * weight, rows) - lower
                same = np.where(higher > 0, lower / np.maximum(higher, _SIZED), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), pa.array(same)], ["_a", "_b", "similarity"])

    return run


def _block_links(k: int, similarity: float, weights):
    """Links among the texts of a block pair that join components, found by one product of matrices.

    A run that occurs twice is two features, so the sum of the lower weights of two texts is the
    weight of the features they share."""

    def run(table: pa.Table) -> pa.Table:
        idf = weights.value
        sets = Shingles(table.column("_text"), k)
        total = np.bincount(sets.text, sets.times * idf[sets.bucket()].astype(np.float64), sets.texts)
        owner, run_ = np.repeat(sets.text, sets.times), np.repeat(sets.run, sets.times)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(sets.times) - sets.times, sets.times)
        _, first, feature, many = np.unique(
            W.mix(run_ + level.astype(np.uint64) * W._BASE), return_index=True, return_inverse=True, return_counts=True
        )
        weight = idf[(run_[first] % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float64)
        common = np.flatnonzero(many > 1)
        column = np.full(len(many), -1)
        column[common] = np.arange(len(common))
        column = column[feature]
        owner, column = owner[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((sets.texts, sets.texts))
        for a in range(0, len(common), _COLUMNS):
            x, y = np.searchsorted(column, (a, a + _COLUMNS))
            part = np.zeros((sets.texts, min(_COLUMNS, len(common) - a)))
            part[owner[x:y], column[x:y] - a] = 1
            shared += (part * weight[common[a : a + _COLUMNS]]) @ part.T
        either = total[:, None] + total[None, :] - shared
        label = table.column("label").to_numpy()
        linked = (shared >= (similarity - _SIZED) * either) & (label[:, None] != label[None, :]) & (either > 0)
        node, root, out = table.column("node").to_numpy(), {}, []

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            a, b = find(label[i]), find(label[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"_a": pa.array([x[0] for x in out], pa.int64()), "_b": pa.array([x[1] for x in out], pa.int64())})

    return run


def components(links: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """Lowest node reachable from each node that has a link, as (node, label).

    Every turn, each node takes the lowest label among its neighbours, then the label of its label.
    Tables are written between turns, and only a count of changes reaches the driver.
    """
    both = stage(links.select(F.col(a).alias("node"), F.col(b).alias("near")).union(links.select(b, a)).distinct(), "edges")
    labels = stage(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("near"), F.col("label").alias("other"))
        lower = both.join(seen, "near").groupBy("node").agg(F.min("other").alias("lower"))
        taken = labels.join(lower, "node").select("node", F.col("label").alias("old"), F.least("label", "lower").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        changed = stage(
            taken.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels"
        )
        labels = changed.select("node", "label")
        if not changed.filter("old <> label").limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only components that a link joins are looked at."""
    one = labels.select(F.col("node").alias("_a"), F.col("label").alias("_la"))
    two = labels.select(F.col("node").alias("_b"), F.col("label").alias("_lb"))
    between = links.select("_a", "_b").join(one, "_a", "left").join(two, "_b", "left").select(
        F.coalesce("_la", "_a").alias("_la"), F.coalesce("_lb", "_b").alias("_lb")
    ).filter("_la <> _lb").distinct()
    between = stage(between, "between")
    if not between.limit(1).count():
        return labels
    roots = components(between, "_la", "_lb").select(F.col("node").alias("_root_of"), F.col("label").alias("_root"))
    nodes = labels.union(links.select("_a", "_a")).union(links.select("_b", "_b")).groupBy("node").agg(F.min("label").alias("label"))
    return stage(
        nodes.join(roots, F.col("label") == F.col("_root_of"), "left").select("node", F.coalesce("_root", "label").alias("label")), "labels"
    )


def groups(documents: DataFrame, id: str = "doc_id", text: str = "text", k: int = SHINGLE,
           similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``id``, ``class_id`` (lowest id with the same words), ``group_id``
    (lowest id of the group) and ``stays`` (whether it is the one of its group that stays)."""
    members, _, _ = linked(documents, id, text, k, similarity, bands, rows)
    return members.select(F.col("_id").alias(id), "class_id", "group_id", (F.col("_row") == F.col("_head._row")).alias("stays"))


def _key(id: str, text: str):
    unnamed = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64(text), 2)
    return F.coalesce(F.col(id).cast("long"), unnamed)


def linked(documents: DataFrame, id: str, text: str, k: int, similarity: float, bands: int, rows: int):
    """Members with their class and group, links between classes, and labels of linked classes.

    Classes are numbered as they are stored; ``_head`` of a member is the row of its group that stays.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.col(id).cast("long").alias("_id"), _key(id, text).alias("_key"), F.xxhash64(text).alias("_code"), F.col(text).alias("_text")
    )
    weights = spark.sparkContext.broadcast(inverse_frequencies(docs, k))
    drawn = stage(
        docs.mapInArrow(
            _signatures(k, bands, rows, weights),
            "_id long, _key long, _code long, _one long, _other long, _weight double, _buckets array<long>",
        ).withColumn("_row", F.monotonically_increasing_id()),
        "signatures",
    )
    wordless = F.col("_buckets").isNull()
    own = F.struct("_key", "_code", "_row")
    classes = stage(
        drawn.filter(~wordless).groupBy("_one", "_other").agg(
            F.min("_key").alias("class_id"), F.min(own).alias("_first"), F.count("*").alias("_n"), F.first("_weight").alias("_weight"),
            F.first("_buckets").alias("_buckets"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )

    met = classes.select("node", "_weight", F.explode("_buckets").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    met = stage(met.join(shared.select("bucket"), "bucket"), "buckets")
    # the texts that are compared: one of each class that meets another
    wanted = classes.join(met.select("node").distinct(), "node").select("node", "_first._key", "_first._code")
    texts = stage(docs.join(wanted, ["_key", "_code"]).groupBy("node").agg(F.min("_text").alias("_text")), "texts")

    def compared(pairs: DataFrame) -> DataFrame:
        close = F.least("_wa", "_wb") >= F.lit(similarity * (1 - 1e-6)) * F.greatest("_wa", "_wb")
        pairs = pairs.filter(close).select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
        one = texts.select(F.col("node").alias("_a"), "_text")
        two = texts.select(F.col("node").alias("_b"), F.col("_text").alias("_with"))
        rows_ = pairs.join(one, "_a").join(two, "_b").select("_a", "_b", "_text", "_with")
        scored = rows_.mapInArrow(_similarity(k, weights), "_a long, _b long, similarity double")
        return stage(scored.filter(F.col("similarity") >= similarity - _SIZED), "links")

    def with_pivot(buckets: DataFrame, pivots: DataFrame) -> DataFrame:
        pivots = pivots.select("bucket", F.col("node").alias("b"), F.col("_weight").alias("_wb"))
        return buckets.join(pivots, "bucket").filter("node <> b").select(F.col("node").alias("a"), F.col("_weight").alias("_wa"), "b", "_wb")

    first = met.groupBy("bucket").agg(F.min(F.struct("node", "_weight")).alias("p")).select("bucket", "p.*")
    links = compared(with_pivot(met, first))
    labels = components(links)
    open_ = stage(_unjoined(met, first, labels), "open")

    size = open_.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = dealt.select("bucket", "node", "label", "block", other.alias("other")).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label"
    )
    more = stage(
        paired.join(texts, "node").groupBy("bucket", "low", "high").applyInArrow(_block_links(k, similarity, weights), "_a long, _b long"),
        "links",
    )
    links = links.select("_a", "_b").union(more).distinct()
    labels = merged(labels, more)
    heads = classes.join(labels, "node").groupBy("label").agg(F.min("class_id").alias("_lowest"), F.min("_first").alias("_foremost"))
    groups_ = labels.join(heads, "label").select("node", "_lowest", "_foremost")
    whole = classes.join(groups_, "node", "left").select(
        "_one", "_other", "_n", "class_id", F.coalesce("_lowest", "class_id").alias("group_id"), F.coalesce("_foremost", "_first").alias("_head")
    )
    row = ["_id", "_key", "_code", "_row"]
    members = drawn.filter(~wordless).select(*row, "_one", "_other").join(whole, ["_one", "_other"]).select(
        *row, "_n", "class_id", "group_id", "_head"
    ).union(_wordless(drawn.filter(wordless).select(*row)))
    return members, links, labels


def _wordless(rows: DataFrame) -> DataFrame:
    """Rows without words as members: rows that agree in id and text are one class, all others are alone."""
    own = F.struct("_key", "_code", "_row")
    classes = rows.groupBy(F.col("_key").alias("_k"), F.col("_code").alias("_c")).agg(F.min(own).alias("_head"), F.count("*").alias("_n"))
    same = (F.col("_key") == F.col("_k")) & (F.col("_code") == F.col("_c"))
    return rows.join(classes, same).select(
        "_id", "_key", "_code", "_row", "_n", F.col("_key").alias("class_id"), F.col("_key").alias("group_id"), "_head"
    )


def _unjoined(buckets: DataFrame, pivots: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, without the pivots, of buckets that are still in several components."""
    rest = buckets.select("bucket", "node").join(pivots.select("bucket", "node"), ["bucket", "node"], "left_anti")
    tagged = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = tagged.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return tagged.join(several.select("bucket"), "bucket").select("bucket", "node", "label")


def deduplicated(documents: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group."""
    members, _, _ = linked(documents, id, text, **{**_DEFAULTS, **settings})
    key, code = (W.free_name(documents.columns, name) for name in ("_near_key", "_near_code"))
    stays = (F.col("_key") == F.col("_head._key")) & (F.col("_code") == F.col("_head._code"))
    pair = [F.col("_key").alias(key), F.col("_code").alias(code)]
    gone = members.filter(~stays).select(*pair).distinct()
    # rows that agree in id and text are the same pair
    again = stage(members.filter(stays & (F.col("_n") > 1)).groupBy(*pair).count().filter("count > 1").drop("count"), "again")
    marked = documents.withColumns({key: _key(id, text), code: F.xxhash64(text)})
    left = marked.join(gone, [key, code], "left_anti")
    if again.limit(1).count():
        one = left.join(again, [key, code], "left_semi").dropDuplicates([key, code])
        left = left.join(again, [key, code], "left_anti").unionByName(one)
    return left.select(*documents.columns)
