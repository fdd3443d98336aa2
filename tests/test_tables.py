import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from statweave.operators import rows, stats
from statweave.plans.jobs import run_job
from statweave.sources import files
from statweave.sources import schema as S
from statweave.sources import tables as T

SCHEMA = S.def_schema("name", S.STRING, "columna", S.INTEGER, "columnb", S.FLOAT)


@pytest.fixture
def write(tmp_path):
    def put(text, name="in.csv"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return put


def values(df):
    return [tuple(r) for r in df.collect()]


def test_import_keeps_quotes_and_reopens(spark, write, tmp_path):
    t = T.import_dataset(spark, write('"one",1,1.0\n"two",2,2.0\n"three",3,3.0\n'), str(tmp_path / "out"), SCHEMA)
    assert sorted(values(t.df)) == [('"one"', 1, 1.0), ('"three"', 3, 3.0), ('"two"', 2, 2.0)]
    again = T.open_dataset(spark, t.path)
    assert [again.column_type(c) for c in again.ordered_columns] == [S.STRING, S.INTEGER, S.FLOAT]
    assert again.numeric_columns() == ["columna", "columnb"] and again.column_position("COLUMNB") == 2
    assert sorted(r[0] for r in again.rows()) == ['"one"', '"three"', '"two"']


def test_regex_delimiter_drops_extra_cells(spark, write):
    t = T.wrap_dataset(spark, write('"one".1.1.0\n"two".2.2.0\n'), SCHEMA, r"\.")
    assert sorted(values(t.df)) == [('"one"', 1, 1.0), ('"two"', 2, 2.0)]


def test_skip_and_header(spark, write):
    text = "title\nname,a,b\nx,1,1.0\ny,2,2.0\n"
    assert T.wrap_dataset(spark, write(text), SCHEMA, skip=2).df.count() == 2
    assert T.wrap_dataset(spark, write(text), SCHEMA, skip=1, header=True).df.count() == 2


def test_nulls_and_parse_failures(spark, write):
    t = T.wrap_dataset(spark, write(',1 , 1.0\n"two", NULL , 2.0\n"three",3,\nx,2.0,null\ny\n'), SCHEMA)
    assert sorted(values(t.df), key=str) == sorted([(None, 1, 1.0), ('"two"', None, 2.0), ('"three"', 3, None), ("x", None, None), ("y", None, None)], key=str)
    assert rows.count_lines(t.df).first()[0] == 5


def test_filter_mapper_and_separator(spark, write):
    t = T.wrap_dataset(spark, write("a,1,1\r#x\rb,2,2\r"), SCHEMA, line_sep="\r", line_filter=lambda c: ~F.startswith(c, F.lit("#")), mapper=lambda a: F.transform(a, lambda c: F.upper(c)))
    assert sorted(values(t.df)) == [("A", 1, 1.0), ("B", 2, 2.0)]


def test_null_rows_count(spark, write):
    assert run_job(spark, "table-count-lines", table=T.wrap_dataset(spark, write("NULL,NULL,NULL\n,,\n"), SCHEMA)).output().first()[0] == 2


def test_dates_parse_by_format(spark, write):
    s = S.def_schema("name", S.STRING, "at", S.DATE_TIME, date_formats={"at": "dd/mm/yyyy"})
    t = T.wrap_dataset(spark, write("a,01/05/1982\nb,no date\n"), s)
    assert values(rows.vectorize(t.df, ["at"])) == [([378691500000.0],)]
    assert stats.centrality(t.df, "at").first()["avg"] == 378691500000.0


def test_vectorize_drops_rows_that_lack_a_value(spark, write):
    t = T.wrap_dataset(spark, write("a,1,1.5\nb,,2\nc,3,NULL\n"), SCHEMA)
    assert values(rows.vectorize(t.df, ["columnb", "columna"])) == [([1.5, 1.0],)]
    sparse = rows.vectorize(spark.createDataFrame([(0.0, 2.0)], "x double, y double"), ["x", "y"], "sparse").first()
    assert sparse["size"] == 2 and sparse["entries"] == {1: 2.0}
    assert rows.vectorize(t.df, ["name"]).count() == 0


def test_normalization(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (None, 1.0)], "a int, b double")
    assert sorted(values(rows.normalize(df, ["a", "b"], [1, 1], [3, 3]))) == [(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)]
    odd = [r[0] for r in rows.normalize(df, ["b"], [2], [2]).collect()]
    assert sorted(map(str, odd)) == ["-inf", "-inf", "inf", "nan"]


def test_samples(spark):
    df = spark.range(10)
    assert run_job(spark, "sample-file", table=df, percentage_to_sample=0.2).output().count() == 2
    big = spark.range(10_000)
    got = [r[0] for r in rows.sample_exact(big, 0.25, seed=3).collect()]
    assert len(got) == len(set(got)) == 2500
    assert max(r[0] for r in rows.sample_exact(df, 1.0).collect()) == 9
    assert 4000 < rows.sample_bernoulli(big, 0.5, 1).count() < 6000
    for sample in (lambda d: rows.sample_exact(d, 0.25, seed=3, key=["id"]), lambda d: rows.sample_bernoulli(d, 0.25, 3, ["id"])):
        found = [sorted(r[0] for r in sample(big.repartition(parts)).collect()) for parts in (1, 2, 37)]
        assert found[0] == found[1] == found[2] and 2300 < len(found[0]) < 2700
    copies = big.select((F.col("id") % 3).alias("k"))
    assert rows.sample_exact(copies, 0.5, key=["k"]).count() == big.count() / 2  # rows of one key, cut where the sample is full


def test_filter_and_map(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "x int, s string")
    assert [r.s for r in rows.filter_table(df, "x > 0").collect()] == ["a", "c"]
    least = 2
    assert [r.s for r in rows.filter_table(df, lambda r: r["x"] >= least).collect()] == ["c"]  # None >= 2 raises: dropped
    assert [r.s for r in rows.filter_table(df, lambda r: 1).collect()] == []
    assert values(rows.map_table(df, {"y": F.col("x") * 2}).select("y")) == [(2,), (None,), (6,)]
    assert values(rows.map_table(df, lambda r: {"n": len(r["s"])}, "n int")) == [(1,), (1,), (1,)]


def test_stf(spark, write):
    t = T.read_stf(spark, write("# comment\n2\nx Real\nname String\n1.5 a\nbad b\n", "t.stf"))
    assert sorted(values(t.df)) == [(0.0, "b"), (1.5, "a")]


def test_combine_and_vectors(spark, tmp_path):
    one = T.combine(spark, spark.range(100).repartition(7), str(tmp_path / "one"))
    assert one.df.count() == 100 and len(one.df.inputFiles()) == 1
    v = spark.createDataFrame([([1.0, 0.0, 3.0],)], "point array<double>")
    assert values(T.read_vectors(v, S.def_schema("a", S.INTEGER, "b", S.DOUBLE, "c", S.LONG))) == [(1, 0.0, 3)]


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        run_job(spark, "no-such-job")
    with pytest.raises(KeyError):
        stats.centrality(spark.range(3), "nope")
    with pytest.raises(ValueError):
        S.def_schema("x", "no kind")
    assert S.build_dimensions(["b", "a", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_files_and_values(spark, tmp_path):
    at = files.join(f"file://{tmp_path}", "a", "/b/")
    files.mkdir(spark, at)
    T.write_value(spark, files.join(at, "v"), 7.5)
    assert T.read_value(spark, files.join(at, "v")) == 7.5
    assert [x.rsplit("/", 1)[1] for x in files.ls(spark, at)] == ["v"] and files.ls(spark, at, files_only=True) == []
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert files.show(spark, str(tmp_path / "t.txt"), 1) == ["one"]
    assert files.delete(spark, at) and not files.exists(spark, at) and not files.delete(spark, at)


def test_views_and_draws(spark):
    T.Dataset(spark.range(5)).view("five")
    assert spark.sql("SELECT sum(id) FROM five").first()[0] == 10
    assert rows.draw(spark.range(100), 7).count() == 7 and rows.draw(spark.range(3), 7).count() == 3


def test_rows_like_the_head_of_an_stf_file_stay(spark, write):
    text = "# c\n1\nn Integer\n1\n2\n1\n\n# more\nn Integer\n3\n"
    assert [r.n for r in T.read_stf(spark, write(text, "a.stf")).df.collect()] == [1, 2, 1, 0, 3]
    two = T.read_stf(spark, write("2\nn Integer\ns String\n\t1 \tx\t\n2\n", "b.stf")).df.collect()
    assert [tuple(r) for r in two] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        T.read_stf(spark, write("2\nn Integer\n", "c.stf"))
    with pytest.raises(ValueError):
        T.read_stf(spark, write("", "d.stf"))


def test_functions_of_many_rows(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "c", 4.0)], "n int, s string, x double")
    assert [r.n for r in rows.filter_table(df, rows.arrow_function(lambda b: pc.greater(b["x"], 1.0))).collect()] == [1, 3]
    assert [r.n for r in rows.filter_table(df, rows.pandas_function(lambda p: p["s"].isna())).collect()] == [2]
    made = rows.map_table(df, rows.pandas_function(lambda p: p.assign(y=p["x"] + 1)[["y", "n", "s"]]), "n long, y double")
    assert sorted(map(tuple, made.collect())) == [(1, 3.0), (2, None), (3, 5.0)]
    same = rows.map_table(df, rows.arrow_function(lambda b: pa.Table.from_batches([b])))
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    point = rows.vectorize(df, rows.arrow_function(lambda b: [None if x is None else [x, 1.0] for x in b["x"].to_pylist()]), keep=["n"])
    assert sorted(map(tuple, point.collect())) == [(1, [2.0, 1.0]), (3, [4.0, 1.0])]
    thin = rows.vectorize(df, rows.pandas_function(lambda p: np.stack([p["n"] - 1, p["n"]], 1)), "sparse")
    assert sorted(r.entries.get(0, 0.0) for r in thin.collect()) == [0.0, 1.0, 2.0]
    assert rows.filter_table(df.where("false"), rows.arrow_function(lambda b: [True] * b.num_rows)).count() == 0
    with pytest.raises(Exception, match="values for"):
        rows.filter_table(df, rows.arrow_function(lambda b: [True] * (b.num_rows + 1))).collect()
    with pytest.raises(ValueError):
        rows.Batches(len, "rows")


def test_configuration_files(spark, write):
    text = "<configuration><property><name>statweave.probe</name><value>{}</value></property></configuration>"
    files.use_config(spark, write(text.format("one"), "a.xml"), write(text.format("two"), "b.xml"))
    assert spark._jsc.hadoopConfiguration().get("statweave.probe") == "two"
    assert files.bootstrap(spark).startswith("file:")
    with pytest.raises(FileNotFoundError):
        files.use_config(spark, "/no/such.xml")
