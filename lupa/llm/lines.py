"""Removal of lines that are boilerplate of their site.

For each host the pages with a line are divided by the pages of the host. A line in more than ``RATIO``
of them, and in at least ``PAGES`` pages, is boilerplate of that host and dropped from its pages. A host
has fewer than (lines per page) / ``RATIO`` such lines.

Only DataFrame functions are used. Lines count once per page and by a 64-bit hash, so the counts that
are shuffled are small and combined in the map tasks. The boilerplate lines of all hosts are stored and, if there are
no more than ``MOST_SENT``, sent to all tasks, so that texts do not move. Lines are what ``\\n`` separates; lines without a
word are never dropped. A null host is a host of its own. Null texts stay null and count as pages; a
text that loses all lines becomes empty, and its row stays. Repeated rows are pages of their own, so a
group of copies with more than ``RATIO`` of its host makes its own lines boilerplate. With ``distinct``
equal texts of a host are one page (null texts too), for numerator and denominator, and copies no longer
remove their own content; texts that are near copies, but not equal, still count one by one. Very long texts are
split as a whole in their row. Empty tables give empty results. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.operators.keys import spread_left_join
from lupa.session import stage

RATIO = 0.1
PAGES = 5
#: Boilerplate lines and hosts that are sent to all tasks, some 10 MB; more are joined by host.
MOST_SENT = 1_000_000

_WORD = "[^ \\t-\\r]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = PAGES, distinct: bool = False
) -> DataFrame:
    """Hashes of the boilerplate lines of each host: ``_host``, ``_dropped``."""
    held_lines = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: x.rlike(_WORD)), lambda x: F.xxhash64(x)))
    rows = pages.select(F.col(host).alias("_host"), F.col(text).alias("_text"), held_lines.alias("_lines"))
    if distinct:  # equal texts have equal lines; copies meet as partial results, by a 128-bit digest
        rows = rows.groupBy("_host", F.md5("_text").alias("_digest")).agg(F.any_value("_lines").alias("_lines"))
    total = rows.groupBy("_host").agg(F.count("*").alias("_pages"))
    line = F.explode("_lines")
    held = rows.select("_host", line.alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    other = total.withColumnRenamed("_host", "_at")
    common = held.join(other, F.col("_host").eqNullSafe(F.col("_at"))).filter(F.col("_n") > ratio * F.col("_pages"))
    return common.groupBy("_host").agg(F.collect_list("_line").alias("_dropped"))


def without_boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = PAGES, distinct: bool = False
) -> DataFrame:
    """All columns, with the text that is left in ``text``, and ``n_lines`` and ``n_dropped`` before and
    by the removal, which take the place of columns of these names."""
    taken = [*pages.columns, "n_lines", "n_dropped"]
    at, gone, kept_lines = (W.free_name(taken, name) for name in ("_boilerplate_host", "_boilerplate", "_kept"))
    found = stage(boilerplate(pages, host, text, ratio, least, distinct), "boilerplate")
    marks = found.withColumnsRenamed({"_host": at, "_dropped": gone})
    size = found.agg(F.count("*") + F.coalesce(F.sum(F.size("_dropped")), F.lit(0))).first()[0]
    if size <= MOST_SENT:
        joined = pages.join(F.broadcast(marks), pages[host].eqNullSafe(marks[at]), "left")
    else:  # texts of hot hosts are spread over tasks; a null host is told from all others by a second key
        known, name, other = (W.free_name([*taken, at, gone], x) for x in ("_known", "_name", "_other"))
        left_side = pages.withColumns({known: F.col(host).isNotNull(), name: F.coalesce(F.col(host).cast("string"), F.lit(""))})
        right_side = marks.select(F.col(at).isNotNull().alias(at), F.coalesce(F.col(at).cast("string"), F.lit("")).alias(other), gone)
        joined = spread_left_join(left_side, right_side, [(known, at), (name, other)])
    lines = _lines(F.col(text))
    left = F.filter(lines, lambda x: ~(x.rlike(_WORD) & F.array_contains(gone, F.xxhash64(x))))
    kept = F.when(F.col(gone).isNull(), lines).otherwise(left)
    held = joined.withColumn(kept_lines, kept)
    return held.select(
        *(F.array_join(kept_lines, "\n").alias(text) if c == text else F.col(c) for c in pages.columns if c not in ("n_lines", "n_dropped")),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(kept_lines), F.lit(0)).alias("n_dropped"),
    )
