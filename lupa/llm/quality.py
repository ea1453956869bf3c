"""Quality rules as a cascade that stops at the first rejection.

Each rule measures a batch of texts and rejects some. On a sample of about ``SAMPLE`` documents every
rule is timed and its share of rejections counted; the rules then run in descending order of
rejections per second, and each only sees the texts that passed those before it. The order changes the
work, never the verdict: a document stays if no rule rejects it.

Words are runs without blanks (space, tab to carriage return). Null and empty texts have no words and are
rejected for it. A verdict depends on the text alone, so repeated rows get the same and ties of rules change nothing.
Very long texts are measured whole, in a slice of their own. Empty tables give empty results. Other columns,
whatever their names, stay in ``accepted`` and are not read by ``judged``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W

SAMPLE = 500

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Texts:
    """A column of texts; measures are made when first asked for."""

    def __init__(self, column):
        self.column = column
        self.data, self.offsets = W.column_bytes(column)
        self.rows = len(self.offsets) - 1
        self._held: dict = {}

    def once(self, name: str, make: Callable):
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    @property
    def words(self) -> W.Words:
        return self.once("words", lambda: W.words_of(self.column, W.split_table(), seed=11))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        total = np.append(0, np.cumsum(mask))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def count_words(self, mask: np.ndarray) -> np.ndarray:
        """Marked words of each text."""
        total = np.append(0, np.cumsum(mask))
        return total[self.words.first[1:]] - total[self.words.first[:-1]]

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of the lines that have a word."""
        return self.once("lines", self._lines)

    def _lines(self):
        breaks = np.flatnonzero(self.data == 0x0A)
        start = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        start = start[start < len(self.data)]
        end = np.append(start[1:], len(self.data))[: len(start)]
        end = np.where((self.data[np.maximum(end, 1) - 1] == 0x0A) & (end > start), end - 1, end)
        held = np.searchsorted(self.words.start, end) > np.searchsorted(self.words.start, start)
        start, end = start[held], end[held]
        return start, end, np.searchsorted(self.offsets, start, "right") - 1


def word_chars(texts: Texts) -> np.ndarray:
    """Characters inside words."""
    blank = np.isin(texts.data, W.BLANKS)
    return texts.count(~blank & ((texts.data & 0xC0) != 0x80))


def n_symbols(texts: Texts) -> np.ndarray:
    return texts.count(np.isin(texts.data, [ord(c) for c in SYMBOLS]))


def n_dup_lines(texts: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    start, end, owner = texts.lines
    keys = np.stack([W.hashes(texts.data, start, end, seed) for seed in (13, 17)])
    order = np.lexsort((keys[1], keys[0], owner))
    same = np.zeros(len(order), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (keys[:, order][:, 1:] == keys[:, order][:, :-1]).all(axis=0)
    return np.bincount(owner[order][same], minlength=texts.rows)


def n_repeat_words(texts: Texts) -> np.ndarray:
    """Words in runs of three that occur at least twice in their text."""
    words, k = texts.words, 3
    start = W.whole_windows(words, k)
    run = W.windows(words.hash, k)[start]
    owner = np.searchsorted(words.first, start, "right") - 1
    key = W.mix(run ^ W.mix(owner.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = start[order[twice]]
    edge = np.bincount(at, minlength=len(words.start) + 1) - np.bincount(at + k, minlength=len(words.start) + 1)
    return texts.count_words(np.cumsum(edge)[: len(words.start)] > 0)


def n_letter_words(texts: Texts) -> np.ndarray:
    """Words with a letter or a character beyond ASCII."""
    data = texts.data
    letter = ((data | 0x20) - 0x61 < 26) | (data >= 0x80)
    total = np.append(0, np.cumsum(letter))
    return texts.count_words(total[texts.words.end] > total[texts.words.start])


def measure(texts: Texts, name: str) -> np.ndarray:
    if name == "n_words":
        return texts.n_words
    return texts.once(name, lambda: globals()[name](texts))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


def _ratio(texts: Texts, name: str, per: str = "n_words") -> np.ndarray:
    return measure(texts, name) / np.maximum(1, measure(texts, per))


def few_words(texts: Texts) -> np.ndarray:
    return texts.n_words < MIN_WORDS


def repetitive(texts: Texts) -> np.ndarray:
    return 100 * measure(texts, "n_repeat_words") > REPEAT_PERCENT * texts.n_words


def odd_word_length(texts: Texts) -> np.ndarray:
    length = _ratio(texts, "word_chars")
    return (length < 2) | (length > 12)


def many_symbols(texts: Texts) -> np.ndarray:
    return _ratio(texts, "n_symbols") > 0.1


def few_letter_words(texts: Texts) -> np.ndarray:
    return _ratio(texts, "n_letter_words") < 0.7


def repeated_lines(texts: Texts) -> np.ndarray:
    lines = np.bincount(texts.lines[2], minlength=texts.rows)
    return measure(texts, "n_dup_lines") / np.maximum(1, lines) > 0.3


def shouting(texts: Texts) -> np.ndarray:
    upper = texts.count((texts.data - 0x41) < 26)
    lower = texts.count((texts.data - 0x61) < 26)
    return upper > 0.5 * np.maximum(1, upper + lower)


def exclamations(texts: Texts) -> np.ndarray:
    return texts.count(texts.data == 0x21) > 0.3 * np.maximum(1, texts.n_words)


BASE_RULES = (Rule("few_words", few_words), Rule("repetitive", repetitive))
RULES = (
    *BASE_RULES, Rule("odd_word_length", odd_word_length), Rule("many_symbols", many_symbols),
    Rule("few_letter_words", few_letter_words), Rule("repeated_lines", repeated_lines), Rule("shouting", shouting),
    Rule("exclamations", exclamations),
)


def _tried(rules):
    """Seconds and rejections of each rule over a sample, each from scratch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, out = np.zeros(len(rules)), np.zeros(len(rules))
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    out[i] += rule.rejects(Texts(batch.column("_text"))).sum()
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent), pa.array(out)], ["rule", "seconds", "rejected"])

    return run


def ordered(documents: DataFrame, rules=RULES, text: str = "text", sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules by rejections per second on a sample of about ``sample`` documents.

    Rows are taken by a hash of their place, so all partitions have the same share and copies don't come
    together; the texts stay in the tasks, which return one row for each rule.
    """
    one_of = max(1, documents.count() // sample)
    some = documents.select(F.col(text).alias("_text")).filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(one_of)) == 0)
    found = some.mapInArrow(_tried(rules), "rule string, seconds double, rejected double").groupBy("rule").agg(
        F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")
    )
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in found.collect()}
    return tuple(sorted(rules, key=lambda rule: -gain.get(rule.name, 0.0)))


def passes(column, rules) -> np.ndarray:
    """Which texts no rule rejects; each rule sees only those that passed the ones before."""
    alive = np.arange(len(column))
    texts = Texts(column)
    for rule in rules:
        stays = ~rule.rejects(texts)
        if stays.all():
            continue
        alive = alive[stays]
        if not len(alive):
            break
        texts = Texts(column.take(pa.array(alive)))
    out = np.zeros(len(column), bool)
    out[alive] = True
    return out


def _judge(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(r for r in rules if r not in BASE_RULES)
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                column = batch.column("_text")
                texts = Texts(column)
                base = [measure(texts, name).astype(np.int64) for name in BASE]
                failed = few_words(texts) | repetitive(texts)
                kept = ~failed
                left = np.flatnonzero(kept)
                kept[left] = passes(column.take(pa.array(left)), rest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), *map(pa.array, base), pa.array(failed), pa.array(kept)], ["_id", *BASE, "base_failed", "kept"]
                )

    return run


def judged(documents: DataFrame, id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``id``, the base measures of every document, ``base_failed`` and ``kept`` (no rule rejects it)."""
    docs = documents.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = documents.schema[id].dataType.simpleString()
    measures = ", ".join(f"{name} long" for name in BASE)
    return docs.mapInArrow(
        _judge(ordered(documents, rules, text)), f"_id {kind}, {measures}, base_failed boolean, kept boolean"
    ).withColumnRenamed("_id", id)


def _keep(rules, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.text_batches(whole, text):
                yield batch.filter(pa.array(passes(batch.column(text), rules)))

    return run


def accepted(documents: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    return documents.mapInArrow(_keep(ordered(documents, rules, text), text), documents.schema)
