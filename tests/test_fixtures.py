"""How the warehouse tables are derived from the test tables."""

import re

from pyspark.sql import functions as F

from checks import fixtures
from checks.fixtures import Source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_orders_are_joined_once(source):
    """Tables that select from the same join read it from one stored table, and join nothing again."""
    for name in ("documents", "ledger", "activity_links"):
        text = plan(source[name])
        assert re.search(r"/sold-[0-9a-f]{32}", text), name
        assert "Join" not in text, name
    assert "l_partkey" not in plan(source["documents"].select("dhdr_folio", "dhdr_mnt_total"))


def test_a_table_of_many_files_is_not_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    numbers = spark.range(1000).select("id", F.lit("x" * 50).alias("text"))
    for files, moved in ((1, True), (4 * cores, False)):
        path = str(tmp_path / f"files-{files}")
        numbers.repartition(files).write.option("parquet.block.size", 1 << 20).parquet(path)
        read = spark.read.parquet(path)
        found = fixtures.dealt(read)
        assert ("RoundRobinPartitioning" in plan(found)) == moved
        assert found.agg(F.sum("id"), F.count("*")).first() == (499500, 1000)


def test_derived_tables_equal_their_own_join(spark, source):
    """The stored join changes no row of a table."""
    for name in ("documents", "ledger"):
        text = fixtures.TABLES[name].replace("{hours}", fixtures.HOURS["spark"])
        plainly = spark.sql(text, **{t: source.base[t] for t in ("lineitem", "orders")})
        assert plainly.count() == source[name].count()
        columns = plainly.columns
        assert source[name].select(*columns).exceptAll(plainly.select(*(F.col(c).cast(source[name].schema[c].dataType) for c in columns))).isEmpty()


def test_tables_are_read_once(spark, source):
    assert Source(spark, source.directory).base is source.base
