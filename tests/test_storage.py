from statweave.operators import plots, rows, stats
from statweave.sources import files
from statweave.sources.storage import Stored, release, shared_dir, tables


def test_nothing_stays_behind(spark):
    """What results still read goes when they have been used."""
    before = tables()
    df = spark.range(5000).selectExpr("id", "id * 1.5D AS x")
    assert plots.indexed(df, ["id"]).count() == 5000
    assert rows.sample_exact(df, 0.1).count() == 500
    assert stats.quantiles(df, "x", [0.5], gather=10) == [2499.5 * 1.5]
    release(before)
    assert tables() == before
    left = {p.rsplit("/", 1)[1] for p in files.ls(spark, shared_dir(spark))}
    assert {p.rsplit("/", 1)[1] for p in before} == {p for p in left if p.startswith("statweave-")}


def test_tables_given_to_release_stay(spark):
    one = Stored(spark.range(3))
    two = Stored(spark.range(4))
    release({one.path} | (tables() - {two.path}))
    assert one.df.count() == 3 and not files.exists(spark, two.path)
    one.drop()
