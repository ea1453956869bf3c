
from lupa import vocab as v
from lupa.operators import sampling as s
from lupa.operators import taxpayers as t
from lupa.sources import tables


def inputs(source):
    return tables.invoices(source["documents"]), t.profile(source).cache()


def test_class_sizes_and_fractions(spark, rows):
    classed = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("b", "x"), ("c", "y")], "dhdr_rut_emisor string, tipo_contribuyente string"
    )
    sizes = s.class_sizes(classed)
    assert rows(sizes) == [("x", 2), ("y", 1)]
    assert rows(s.class_sizes(classed, count_key=None)) == [("x", 3), ("y", 1)]
    assert rows(s.fractions(sizes)) == [("x", 0.5), ("y", 1.0)]


def test_stratified_is_a_subset_free_of_partitioning(source, rows):
    docs, profile = inputs(source)
    classed = s.with_class(docs, profile, v.ISSUER)
    shares = s.fractions(s.class_sizes(classed))
    whole = rows(classed)
    a = rows(s.stratified(classed.repartition(3), shares))
    assert a == rows(s.stratified(classed.repartition(11, "dhdr_folio"), shares))
    assert set(a) <= set(whole) and 0 < len(a) < len(whole)
    assert {r[-1] for r in whole} >= {v.UNDEFINED}


def test_equalise_thins_only_the_larger_side(spark):
    big = spark.range(5000).withColumnRenamed("id", "k")
    small = spark.range(5000, 6000).withColumnRenamed("id", "k")
    a, b = s.equalise(big, small, key=["k"])
    assert 850 < a.count() < 1150 and b.count() == 1000
    b, a = s.equalise(small, big, key=["k"])
    assert 850 < a.count() < 1150 and b.count() == 1000


def test_balanced_equals_the_steps(source, rows):
    docs, profile = inputs(source)
    samples = []
    for role in (v.ISSUER, v.RECEIVER):
        classed = s.with_class(docs, profile, role)
        shares = s.fractions(s.class_sizes(classed))
        samples.append(s.stratified(classed, shares).drop(s.CLASS))
    steps = s.union_distinct(*s.equalise(*samples))
    assert rows(s.balanced(docs, profile), *docs.columns) == rows(steps, *docs.columns)


def test_split_parts_are_disjoint_and_complete(source):
    docs = tables.invoices(source["documents"])
    train, test = s.split(docs)
    assert train.count() + test.count() == docs.count()
    keys = list(v.DOCUMENT_KEY)
    assert train.join(test, keys, "left_semi").count() == 0
    assert 0.15 < test.count() / docs.count() < 0.25


def test_union_is_by_name(spark, rows):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(2, 1), (4, 3)], "y int, x int")
    assert rows(s.union_distinct(a, b)) == [(1, 2), (3, 4)]
