"""Filtering of pages by their URLs: rules, and a classifier over the words that names are made of.

Names in hosts are often several words run together. ``segment`` splits them with a unigram model: of all
ways to cut a run of letters into pieces, Viterbi's recursion finds the one with the highest product of
word probabilities; a piece that is no word has a probability that falls with its length. The words are
those of the visible text of all pages, counted in one pass; names of hosts in it (words with inner dots,
hyphens or digits) are no words. Words below the share ``RAREST`` of all words are left out of the model,
so it has fewer than ``1 / RAREST`` words whatever the data: that is what makes it small enough for all tasks.

A multinomial naive Bayes model scores the tokens of the segmented host and of the path. Tokens are counted
in ``BUCKETS`` hashed buckets for each verdict, over all pages with a label; every task returns at most one
count for each bucket, so the model has a fixed size too. ``weak_label`` makes labels from seed words: a URL is
an example of ``block`` if one of its tokens is a seed, which a name like ``freebetsonline`` only shows once it is
segmented, and of ``allow`` if not. The model then also knows the words that come along with the seeds.

Both passes over the pages are maps: hosts are segmented where they are met and remembered in the task, so
a host that holds a third of the pages is segmented once for each task and is no group anywhere.

A rule is a host and a path, written ``host/path``; it fits the host and its subdomains if the URL's path
starts with the rule's path, so a rule ending in ``host/`` does not fit a URL without any path. The longest
fitting rule decides, of equally long ones the first in order. Without a rule the model decides; it allows where
there are no tokens to tell more than the shares of the labels, and if there are no labels of ``block``.

A null URL, or one without ``://``, has an empty host and an empty path, no rule, and is judged by the shares
of the labels alone. Null pages have no words. Repeated rows count each time. Very long hosts and paths are
used whole; their cost grows with their length. An empty table gives an empty result. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.session import stage

BLOCK, ALLOW = "block", "allow"
RAREST = 4e-6
BUCKETS = 1 << 18
SMOOTHING = 1.0
LONGEST = 24  # letters of a word
REMEMBERED = 1 << 15

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_WORD = re.compile(rb"(?<!\S)[\"'(]*([a-z]{1,%d})[.,;:!?\"')]*(?!\S)" % LONGEST)
_HIDDEN = ((b"<!--", b"-->"), (b"<script", b"</script>"), (b"<style", b"</style>"), (b"<", b">"))
_RUN = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
_PENDING = 200_000


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, capitals in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _CAPITALS, _CAPITALS.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


# -- words ----------------------------------------------------------------------------


def visible(html: bytes) -> bytes:
    """The text of a page outside of tags, comments, scripts and styles, in lower case.

    One pass: what is opened and never closed is looked for once.
    """
    html = html.lower()
    out, at, unclosed = [], 0, set()
    while True:
        opened = html.find(b"<", at)
        if opened < 0:
            out.append(html[at:])
            return b" ".join(out)
        out.append(html[at:opened])
        at = opened + 1
        for begin, close in _HIDDEN:
            if html.startswith(begin, opened):
                break
        if close not in unclosed:
            closed = html.find(close, at)
            if closed < 0:
                unclosed.add(close)
            else:
                at = closed + len(close)


def visible_words(html: bytes) -> list[bytes]:
    """Words of letters a to z in the text of a page."""
    return _WORD.findall(visible(html))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )
        held.clear()
        return out

    for whole in batches:
        for batch in W.text_batches(whole, "_text"):
            for page in batch.column("_text").cast(pa.large_binary()):
                if page.is_valid:
                    held.update(visible_words(page.as_py()))
            if len(held) > _PENDING:
                yield rows()
    yield rows()


def word_counts(pages: DataFrame, text: str = "html") -> DataFrame:
    """How often each word occurs in all pages: ``word``, ``n``."""
    found = pages.select(F.col(text).alias("_text")).mapInArrow(_count_words, "word string, n long")
    return stage(found.groupBy("word").agg(F.sum("n").alias("n")), "words")


@dataclass
class Words:
    """Logarithms of the probabilities of words; ``total`` is the number of counted words."""

    weight: dict[str, float]
    total: float

    def of(self, piece: str) -> float:
        known = self.weight.get(piece)
        return known if known is not None else log(10 / self.total) - len(piece) * log(10)


def words_model(counts: DataFrame, also: Sequence[str] = (), rarest: float = RAREST) -> Words:
    """The model of counted words; words of ``also`` are known even if they are rare.

    Fewer than ``1 / rarest`` words come to the driver.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = {r["word"]: r["n"] for r in counts.filter(F.col("n") > rarest * total).collect()}
    for word in also:
        held[word] = max(held.get(word, 0), 1, round(rarest * total))
    return Words({w: log(n / max(total, 1)) for w, n in held.items()}, float(max(total, 10)))


def segment(run: str, words: Words) -> list[str]:
    """The most probable pieces of a run of letters; of equally probable ones that with the shortest last piece."""
    best, last = [0.0], [0]
    for end in range(1, len(run) + 1):
        top, cut = -inf, end - 1
        for start in range(end - 1, max(-1, end - 1 - LONGEST), -1):
            score = best[start] + words.of(run[start:end])
            if score > top:
                top, cut = score, start
        best.append(top)
        last.append(cut)
    pieces, end = [], len(run)
    while end:
        pieces.append(run[last[end] : end])
        end = last[end]
    return pieces[::-1]


class Remembered(dict):
    """Results of a function by argument. Forgets all when it holds many, never holds those of long arguments."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        made = self.make(key)
        if len(key) <= 256:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = made
        return made


class Tokens:
    """Tokens of URLs in one task: the words of names, and one token for any run of digits."""

    def __init__(self, words: Words):
        self.pieces = Remembered(lambda run: segment(run, words))
        self.bucket = Remembered(bucket)

    def words_of(self, name: str) -> list[str]:
        out = []
        for run in _RUN.findall(name):
            if "a" <= run[0] <= "z":
                out += self.pieces[run]
            else:
                out.append("0" if run.isascii() else run)
        return out

    def of(self, host: str, path: str) -> list[str]:
        """Words of host and path; those of the path are told apart by a slash."""
        return self.words_of(host) + [f"/{t}" for t in self.words_of(path.lower())]


# -- rules ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


class Rules:
    """Rules by their hosts."""

    def __init__(self, rules: Iterable[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
            self.by_host.setdefault(rule.host, []).append(rule)

    def of_host(self, host: str) -> list[Rule]:
        """Rules of a host and of the domains it belongs to, the longest first."""
        found, at = [], 0
        while True:
            found += self.by_host.get(host[at:], [])
            dot = host.find(".", at)
            if dot < 0:
                return sorted(found, key=lambda r: (-len(r.rule), r.rule))
            at = dot + 1


# -- classifier -----------------------------------------------------------------------


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Model:
    """Log odds of ``block`` for each bucket, and those of the labels alone."""

    words: Words
    odds: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    prior: float = -inf

    def score(self, buckets: list[int]) -> float:
        return self.prior + float(self.odds[buckets].sum()) if np.isfinite(self.prior) else self.prior


def weak_label(seeds: Sequence[str]) -> Callable[[list[str]], str]:
    """Labels URLs by their tokens: ``block`` if one of them is a seed, in host or path."""
    known = frozenset([*seeds, *(f"/{s}" for s in seeds)])
    return lambda tokens: BLOCK if not known.isdisjoint(tokens) else ALLOW


def _split(urls: DataFrame, id: str, url: str, *more: Column) -> DataFrame:
    return urls.select(F.col(id).alias("_id"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"), *more)


def _tally(shared, label):
    """Counts of buckets and of URLs (bucket -1) for each verdict, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        total, urls = np.zeros((2, BUCKETS), np.int64), [0, 0]
        for batch in batches:
            given = batch.column("_label").to_pylist() if label is None else [None] * len(batch)
            for host, path, verdict in zip(batch.column("_host").to_pylist(), batch.column("_path").to_pylist(), given, strict=True):
                found = tokens.of(host, path)
                if label is not None:
                    verdict = label(found)
                if verdict not in (BLOCK, ALLOW):
                    continue
                side = int(verdict == BLOCK)
                urls[side] += 1
                np.add.at(total[side], [tokens.bucket[t] for t in found], 1)
        held = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(total[1, held], urls[1])), pa.array(np.append(total[0, held], urls[0]))],
            ["bucket", "block", "allow"],
        )

    return run


def fit(urls: DataFrame, words: Words, label: Callable[[list[str]], str] | str, url: str = "url", smoothing: float = SMOOTHING) -> Model:
    """Naive Bayes over all URLs with a label: a column with ``block`` or ``allow`` (others are passed over), or
    a function of the tokens. At most one row for each bucket comes to the driver."""
    shared = urls.sparkSession.sparkContext.broadcast(words)
    by_column = isinstance(label, str)
    rows = _split(urls, url, url, *([F.col(label).cast("string").alias("_label")] if by_column else []))
    tally = rows.mapInArrow(_tally(shared, None if by_column else label), "bucket long, block long, allow long")
    found = tally.groupBy("bucket").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).toPandas()
    all_urls, found = found[found["bucket"] < 0], found[found["bucket"] >= 0]
    block, allow = int(all_urls["block"].sum()), int(all_urls["allow"].sum())
    if not block or not allow:
        return Model(words, prior=inf if block else -inf)
    counts = np.full((2, BUCKETS), smoothing)
    at = found["bucket"].to_numpy()
    counts[0, at] += found["block"].to_numpy()
    counts[1, at] += found["allow"].to_numpy()
    seen = np.zeros(BUCKETS, bool)
    seen[at] = True
    sums = [counts[side, seen].sum() for side in (0, 1)]
    odds = np.where(seen, np.log(counts[0] / sums[0]) - np.log(counts[1] / sums[1]), 0.0)
    return Model(words, odds, log(block / allow))


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rules = shared.value
        tokens, fitting = Tokens(model.words), Remembered(rules.of_host)
        for batch in batches:
            rule, verdict, score = [], [], []
            for host, path in zip(batch.column("_host").to_pylist(), batch.column("_path").to_pylist(), strict=True):
                value = model.score([tokens.bucket[t] for t in tokens.of(host, path)])
                first = next((r for r in fitting[host] if path.startswith(r.path)), None)
                rule.append(first.rule if first else None)
                verdict.append(first.verdict if first else BLOCK if value > 0 else ALLOW)
                score.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_host"), batch.column("_path"), pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
                ["_id", "host", "path", "rule", "verdict", "score"],
            )

    return run


def judge(pages: DataFrame, model: Model, rules: Iterable[Rule], id: str = "page_id", url: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``score`` (log odds of ``block``) of every
    row. No shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast((model, Rules(rules)))
    kind = pages.schema[id].dataType.simpleString()
    schema = f"_id {kind}, host string, path string, rule string, verdict string, score double"
    return _split(pages, id, url).mapInArrow(_judge(shared), schema).withColumnRenamed("_id", id)
