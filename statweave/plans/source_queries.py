"""Queries over sources, sinks, rows and jobs: the driver's tables are written in some form, read back and held against SQL on the tables themselves."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.parsing import parse_datum, parse_date_time
from ..operators import rows
from ..operators.clustering import common
from ..sources import files, schema, tables
from ..sources.schema import CATEGORICAL, DATE_TIME, DOUBLE, FLOAT, INTEGER, LONG, STRING, def_schema
from ..sources.storage import Scratch
from . import jobs
from .queries import plain_time, query, rounded, table

CUSTOMER = ("c_custkey", LONG, "c_name", STRING, "c_nationkey", INTEGER, "c_acctbal", DOUBLE, "c_mktsegment", CATEGORICAL)


def _lines(df: DataFrame, separator: str = ",") -> DataFrame:
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def _written(lines: DataFrame, parts: int | None = None, head: list[str] = ()) -> str:
    """Lines as text files (with ``head`` as one file that begins with these lines)."""
    spark, path = lines.sparkSession, Scratch(lines.sparkSession).path
    if head:
        lines = spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).union(lines).coalesce(1)
    (lines.repartition(parts) if parts else lines).write.text(path)
    return path


# Sources


@query("""SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS c_mktsegment FROM customer""")
def import_dataset(spark, sf):
    """Typed copy of delimited text; null tokens and cells that can't be read are null."""
    customer = table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")))
    customer = customer.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "HOUSEHOLD", " null ").otherwise(F.col("c_mktsegment")))
    return tables.import_dataset(spark, _written(_lines(customer)), Scratch(spark).path, def_schema(*CUSTOMER)).df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def import_skip_and_header(spark, sf):
    """``skip`` lines and a header at the start of a file are left out."""
    path = _written(_lines(table(spark, sf, "nation")), head=["made by hand", "1,2,3", "n_nationkey,n_name,n_regionkey"])
    names = def_schema("n_nationkey", INTEGER, "n_name", STRING, "n_regionkey", INTEGER)
    return tables.import_dataset(spark, path, Scratch(spark).path, names, skip=2, header=True).df


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0")
def import_line_filter(spark, sf):
    """A condition on the raw line, before it is cut."""
    supplier = table(spark, sf, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "# ").otherwise(""), F.col("s_suppkey")).alias("k"), "s_name")
    kept = tables.import_dataset(spark, _written(_lines(supplier)), Scratch(spark).path, def_schema("s_suppkey", LONG, "s_name", STRING), line_filter=lambda line: ~F.startswith(line, F.lit("#")))
    return kept.df


@query("SELECT upper(p_name) AS p_name, p_size * 2 AS p_size FROM part")
def import_mapper(spark, sf):
    """A function of the cells, nulls set: here in capitals, in another order and with a cell computed."""
    path = _written(_lines(table(spark, sf, "part").select("p_size", "p_name"), ";"))
    mapper = lambda c: F.array(F.upper(c[1]), (c[0].cast("int") * 2).cast("string"))
    return tables.import_dataset(spark, path, Scratch(spark).path, def_schema("p_name", STRING, "p_size", INTEGER), delim=";", mapper=mapper).df


@query("""SELECT '"' || r_name || '"' AS r_name, r_regionkey FROM region""")
def import_keeps_quotes(spark, sf):
    region = table(spark, sf, "region").select(F.concat(F.lit('"'), "r_name", F.lit('"')).alias("r_name"), "r_regionkey")
    return tables.import_dataset(spark, _written(_lines(region, "|")), Scratch(spark).path, def_schema("r_name", STRING, "r_regionkey", INTEGER), delim=r"\|").df


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS c_nationkey, c_acctbal FROM customer")
def wrap_dataset(spark, sf):
    """A folder of text files read in place, with null tokens of its own."""
    customer = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 7, "-").otherwise(F.col("c_nationkey").cast("string")).alias("n"), "c_acctbal")
    names = def_schema("c_custkey", LONG, "c_nationkey", INTEGER, "c_acctbal", DOUBLE)
    return tables.wrap_dataset(spark, _written(_lines(customer, ";"), parts=3), names, separator=";", nulls=("-",)).df


@query("SELECT n_nationkey, n_name, NULL::DOUBLE AS missing FROM nation")
def wrap_trims_and_pads(spark, sf):
    """Lines are trimmed once; short lines get nulls and cells beyond the schema are dropped."""
    nation = table(spark, sf, "nation").select(F.concat(F.lit("  "), F.col("n_nationkey")).alias("k"), "n_name")
    lines = _lines(nation).select(F.concat("value", F.when(F.length("value") % 2 == 0, " \t ").otherwise(",,extra,cells")).alias("value"))
    return tables.wrap_dataset(spark, _written(lines), def_schema("n_nationkey", INTEGER, "n_name", STRING, "missing", DOUBLE)).df


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 4 <> 0")
def wrap_date_formats(spark, sf):
    """Dates in a format of their own; what can't be read has no instant."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "31/31/1999 00h00").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH'h'mm")).alias("o_orderdate"))
    names = def_schema("o_orderkey", LONG, "o_orderdate", DATE_TIME, date_formats={"o_orderdate": "dd/MM/yyyy HH'h'mm"})
    wrapped = tables.wrap_dataset(spark, _written(_lines(orders)), names)
    at = parse_date_time(F.col("o_orderdate"), wrapped.schema["o_orderdate"])
    return plain_time(wrapped.df.select("o_orderkey", at.alias("o_orderdate")).where("o_orderdate is not null"), "o_orderdate")


_KINDS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(zip(CUSTOMER[::2], CUSTOMER[1::2], strict=True))) + ') t("position", name, kind)'


def _accessors(spark: SparkSession, data: tables.Dataset) -> DataFrame:
    rows_ = [(data.column_position(n), n, data.column_type(n)) for n in data.ordered_columns]
    return spark.createDataFrame(rows_, "position int, name string, kind string")


_HELD = f"""SELECT k.*, CASE name {" ".join(f"WHEN '{n}' THEN (SELECT count(DISTINCT {n}) FROM customer)" for n in CUSTOMER[::2])} END AS different FROM ({_KINDS}) k"""


def _different(df: DataFrame) -> DataFrame:
    """(name, different): how many values each column holds."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "name", "different")


@query(_HELD)
def open_dataset(spark, sf):
    """Schema, order, kinds and values of columns outlive the write."""
    path = tables.import_dataset(spark, _written(_lines(table(spark, sf, "customer"))), Scratch(spark).path, def_schema(*CUSTOMER)).path
    data = tables.open_dataset(spark, path)
    return _accessors(spark, data).join(F.broadcast(_different(data.df)), "name")  # a row per column


@query(_HELD)
def declared_schema(spark, sf):
    """What a declared schema says of the columns, and how many values they have under it."""
    wrapped = tables.wrap_dataset(spark, _written(_lines(table(spark, sf, "customer"))), def_schema(*CUSTOMER))
    said = spark.createDataFrame([(i, *h) for i, h in enumerate(schema.header(wrapped.schema))], "position int, name string, kind string")
    return said.join(F.broadcast(_different(wrapped.df)), "name")  # a row per column


@query("SELECT 'c_custkey' AS name, sum(c_custkey)::DOUBLE AS total FROM customer UNION ALL SELECT 'c_nationkey', sum(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', round(sum(c_acctbal), 2) FROM customer")
def numeric_columns(spark, sf):
    """The columns of numbers, and their sums."""
    data = tables.Dataset(table(spark, sf, "customer"))
    names = data.numeric_columns()
    return rounded(data.df.agg(*[F.sum(c).cast("double").alias(c) for c in names]).unpivot([], names, "name", "total"), 2)


@query("SELECT count(*) AS rows, max(o_orderkey) AS last FROM orders")
def table_files(spark, sf):
    """A written table's files hold all its rows."""
    path = tables.write_table(tables.Dataset(table(spark, sf, "orders")), Scratch(spark).path).path
    held = spark.read.parquet(*[f for f in files.ls(spark, path, files_only=True) if f.endswith(".parquet")])
    return held.agg(F.count("*").alias("rows"), F.max("o_orderkey").alias("last"))


@query("SELECT n_nationkey, n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def row_values(spark, sf):
    """Rows made anew from the values of others, by position and by name."""
    data = tables.Dataset(table(spark, sf, "nation"))
    at = data.column_position("N_NAME")
    made = [schema.make_row(data.schema, [r["n_nationkey"], r[at], r["n_regionkey"] + 1]) for r in data.rows()]
    return spark.createDataFrame(made, data.schema)


_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 9) AS r FROM customer" for a, b in schema.build_dimensions(_NUMBERS)))
def dimension_pairs(spark, sf):
    """Every pair of numeric columns, with their correlation; one scan."""
    pairs = schema.build_dimensions(_NUMBERS)
    parts = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(F.corr(a, b), 9).alias("r")) for a, b in pairs]
    return table(spark, sf, "customer").agg(F.array(*parts).alias("all")).select(F.inline("all"))


@query("SELECT c_acctbal FROM customer")
def single_column(spark, sf):
    return tables.Dataset(table(spark, sf, "customer")).points("C_ACCTBAL")


@query("SELECT r_regionkey, r_name FROM region")
def table_rows(spark, sf):
    """Rows by iteration, made again from their values."""
    data = tables.Dataset(table(spark, sf, "region"))
    return spark.createDataFrame([schema.make_row(data.schema, [r["r_regionkey"], r["r_name"]]) for r in data.rows()], data.schema)


@query("SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2] AS b, trunc(embedding[3] * 100)::INTEGER AS c, embedding[64]::DOUBLE AS z FROM embeddings")
def vector_scan(spark, sf):
    """Vectors, here with a weight each, as typed columns in full width."""
    names = def_schema(*[x for i in range(64) for x in ({0: "a", 1: "b", 2: "c", 63: "z"}.get(i, f"x{i}"), {1: FLOAT, 2: INTEGER}.get(i, DOUBLE))])
    scaled = F.transform("embedding", lambda x, i: F.when(i == 2, x.cast("double") * 100).otherwise(x.cast("double")))
    weighted = table(spark, sf, "embeddings").select(F.struct(F.lit(1.0).alias("weight"), F.concat(scaled, F.array(F.col("vec_id").cast("double"))).alias("vector")).alias("point"))
    names = names.add("vec_id", T.LongType(), True, {"kind": LONG})
    return tables.read_vectors(weighted, names).select("vec_id", "a", "b", "c", "z")


@query("SELECT n_nationkey::DOUBLE AS nation_key, n_name AS nation_name, 0.0::DOUBLE AS words FROM nation WHERE NOT contains(n_name, ' ')")
def stf_file(spark, sf):
    """Comments, the number of columns, their names and types, then rows; text in a numeric column counts as 0."""
    rows_ = table(spark, sf, "nation").where("NOT contains(n_name, ' ')").select(F.concat_ws(" \t ", "n_nationkey", "n_name", F.lit("words")).alias("value"))
    return tables.read_stf(spark, _written(rows_, head=["# a comment", "", "3", "nation_key Integer", "# another", "nation_name String", "words Real"])).df


@query("SELECT n_nationkey::DOUBLE AS n_nationkey FROM nation")
def stf_rows_like_the_head(spark, sf):
    """The head is what stands first; rows with the same text stay."""
    lines = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("value"))
    return tables.read_stf(spark, _written(lines, head=["1", "n_nationkey Integer"])).df


@query("SELECT n_nationkey, n_name FROM nation")
def sequence_file(spark, sf):
    path = Scratch(spark).path
    tables.write_pairs(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return tables.read_pairs(spark, path, "n_nationkey int, n_name string")


@query("SELECT label::INTEGER AS cluster, count(*) AS n FROM embeddings WHERE vec_id % 11 <> 10 GROUP BY 1")
def last_clusters(spark, sf):
    """The last iteration of a stored clustering, by number and not by name."""
    path, points = Scratch(spark).path, table(spark, sf, "embeddings")
    for n in (0, 9, 10):
        clusters = points.where(F.col("vec_id") % 11 != n).groupBy(F.col("label").cast("int").alias("cluster")).agg(F.count("*").alias("n"))
        clusters.write.parquet(f"{path}/clusters-{n}{'-final' * (n == 10)}")
    return tables.open_last_clusters(spark, path)


@query("SELECT TRUE AS there, 3::BIGINT AS parts, (SELECT count(*) FROM nation) AS shown, FALSE AS afterwards")
def file_listing(spark, sf):
    """What stands in a folder and not below it, its lines, and deletion."""
    nation = table(spark, sf, "nation")
    path = _written(_lines(nation), parts=3)
    files.mkdir(spark, files.join(path, "below"))
    there, parts, shown = files.exists(spark, path), sum("part-" in p for p in files.ls(spark, path, files_only=True)), len(files.show(spark, path, 2 * nation.count()))
    files.delete(spark, path)
    return spark.createDataFrame([(there, parts, shown, files.exists(spark, path))], "there boolean, parts long, shown long, afterwards boolean")


# Sinks


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 1")
def write_table(spark, sf):
    """A second write replaces the first."""
    path, orders = Scratch(spark).path, table(spark, sf, "orders")
    tables.write_table(tables.Dataset(orders), path)
    return tables.write_table(tables.Dataset(orders.where("o_orderkey % 2 = 1"), path)).df


@query("SELECT count(*) AS value FROM orders")
def single_value(spark, sf):
    path = Scratch(spark).path
    tables.write_value(spark, path, table(spark, sf, "orders").count())
    return spark.createDataFrame([(tables.read_value(spark, path),)], "value long")


@query("SELECT s_suppkey, 1::BIGINT AS n_files FROM supplier")
def combine(spark, sf):
    """All rows in one file."""
    path = Scratch(spark).path
    made = tables.combine(spark, table(spark, sf, "supplier").repartition(4), path).df
    n = sum("part-" in p for p in files.ls(spark, path))
    return made.select("s_suppkey", F.lit(n).cast("long").alias("n_files"))


@query("SELECT 'cheap' AS name, event_id AS row_id, 0.5::DOUBLE AS weight FROM events WHERE value < 5")
def brush_file(spark, sf):
    path = Scratch(spark).path
    tables.write_brush(table(spark, sf, "events").where("value < 5").select(F.col("event_id").alias("row_id"), F.lit(0.5).alias("weight")), path, "cheap")
    name, brush = tables.read_brush(spark, path)
    return brush.select(F.lit(name).alias("name"), "row_id", "weight")


# Cells and rows


@query("""SELECT o_orderkey, o_custkey::INTEGER AS i, (o_orderkey * 1000)::BIGINT AS l, o_totalprice AS d, (o_custkey / 4)::FLOAT AS f, o_orderstatus AS s,
  NULL::INTEGER AS bad FROM orders""")
def parse_cells(spark, sf):
    """Text cells as values; spaces in numbers don't count, and what can't be read is null."""
    text = lambda c: F.concat(F.lit(" "), c.cast("string"), F.lit("  "))
    cells = table(spark, sf, "orders").select(
        "o_orderkey", text(F.col("o_custkey")).alias("i"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" 000")).alias("l"), text(F.col("o_totalprice")).alias("d"),
        text(F.col("o_custkey") / 4).alias("f"), F.col("o_orderstatus").alias("s"), F.lit("12x").alias("bad"),
    )
    kinds = {"i": INTEGER, "l": LONG, "d": DOUBLE, "f": FLOAT, "s": STRING, "bad": INTEGER}
    return cells.select("o_orderkey", *[parse_datum(F.col(c), k).alias(c) for c, k in kinds.items()])


@query("SELECT o_orderkey, make_timestamp(epoch_ms(o_orderdate) * 1000) AS o_orderdate FROM orders")
def parse_milliseconds(spark, sf):
    """Numbers are milliseconds since 1970."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    return plain_time(orders.select("o_orderkey", parse_date_time(F.col("ms"), orders.schema["ms"]).alias("o_orderdate")), "o_orderdate")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def filter_wrapped_text(spark, sf):
    """A filtered view of text is a table like others."""
    wrapped = tables.wrap_dataset(spark, _written(_lines(table(spark, sf, "customer"))), def_schema(*CUSTOMER)).df
    path = Scratch(spark).path
    return tables.write_table(tables.Dataset(rows.filter_table(wrapped, "c_acctbal > 5000").select("c_custkey", "c_acctbal")), path).df


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def filter_null_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return rows.filter_table(events, F.col("value").isNotNull()).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def filter_function_errors(spark, sf):
    """Of a Python function only True keeps a row; errors and other values drop it."""
    answer = {0: lambda: 1 / 0, 1: lambda: True, 2: lambda: 1}
    return rows.filter_table(table(spark, sf, "orders").select("o_orderkey"), lambda r: answer[r["o_orderkey"] % 3]())


@query("SELECT p_partkey + 9007199254740992 AS p_partkey, upper(p_name) AS p_name, CASE WHEN p_size > 25 THEN p_size END AS p_size FROM part")
def map_table_function(spark, sf):
    """A Python function of a row; whole numbers beyond 2 ** 53 and nulls keep their value."""
    part = table(spark, sf, "part").select((F.col("p_partkey") + 9007199254740992).alias("p_partkey"), "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"))
    return rows.map_table(part, lambda r: {**r, "p_name": r["p_name"].upper()})


@query("SELECT s_suppkey, 3::INTEGER AS size, s_nationkey::DOUBLE AS x1, (CASE WHEN s_suppkey = 0 THEN 0 ELSE 1 END + CASE WHEN s_nationkey = 0 THEN 0 ELSE 1 END)::INTEGER AS entries FROM supplier")
def vectorize_sparse(spark, sf):
    """Zeros aren't stored."""
    supplier = table(spark, sf, "supplier").withColumn("zero", F.lit(0))
    made = rows.vectorize(supplier, ["s_suppkey", "s_nationkey", "zero"], "sparse", keep=["s_suppkey"])
    return made.select("s_suppkey", "size", F.coalesce(F.col("entries")[1], F.lit(0.0)).alias("x1"), F.size("entries").alias("entries"))


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0")
def vectorize_drops_nulls(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "ts")
    return rows.vectorize(events, ["value", "ts"], keep=["event_id"]).select("event_id")


@query("SELECT count(*) AS numbers, count(*) FILTER (1 = 0) AS text, max(p_size)::DOUBLE AS most FROM part")
def vectorize_text(spark, sf):
    """Text is no number, so no row has a vector."""
    part = table(spark, sf, "part")
    text = rows.vectorize(part, ["p_size", "p_name"]).agg(F.count("*").alias("text"))
    numbers = rows.vectorize(part, ["p_size", "p_retailprice"]).agg(F.count("*").alias("numbers"), F.max(F.get("point", F.lit(0))).alias("most"))
    return numbers.join(F.broadcast(text)).select("numbers", "text", "most")  # one row each


@query("SELECT event_id, ts, value FROM events WHERE value > 50 AND event_type = 'click'")
def filter_arrow_function(spark, sf):
    """A condition on many rows at a time."""
    wanted = rows.arrow_function(lambda b: pc.and_(pc.greater(b["value"], 50.0), pc.equal(b["event_type"], "click")))
    return rows.filter_table(table(spark, sf, "events").select("event_id", "ts", "value", "event_type"), wanted).drop("event_type")


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice * 2 AS doubled FROM orders")
def map_pandas_function(spark, sf):
    """New rows from many at a time."""

    def double(rows_):
        return rows_.assign(priority=rows_["o_orderpriority"].str.upper(), doubled=rows_["o_totalprice"] * 2)

    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.map_table(orders, rows.pandas_function(double), "o_orderkey long, priority string, doubled double")


@query("SELECT s_suppkey, s_acctbal / 100 AS x0, sqrt(s_nationkey) AS x1 FROM supplier WHERE s_nationkey <> 3")
def vectorize_function(spark, sf):
    """Vectors of a user's own making; a row without one is left out."""

    def made(rows_):
        both = np.stack([rows_["s_acctbal"] / 100, np.sqrt(rows_["s_nationkey"])], 1)
        return [None if k == 3 else v for k, v in zip(rows_["s_nationkey"], both, strict=True)]

    point = rows.vectorize(table(spark, sf, "supplier"), rows.pandas_function(made), keep=["s_suppkey"])
    return point.select("s_suppkey", *[F.get("point", F.lit(i)).alias(f"x{i}") for i in range(2)])


@query("SELECT CASE WHEN s_nationkey > 3 THEN 'Infinity' WHEN s_nationkey < 3 THEN '-Infinity' ELSE 'NaN' END AS x, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1")
def normalization_without_extent(spark, sf):
    """Equal bounds divide by zero as doubles do; rows without a value are left out."""
    supplier = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("x"))
    return rows.normalize(supplier, ["x"], [3], [3]).groupBy(F.col("x").cast("string").alias("x")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey::DOUBLE AS x0, p_size::DOUBLE AS x1, p_retailprice AS x2 FROM part")
def auto_projection(spark, sf):
    """Clustering takes all columns but text."""
    return common.as_points(table(spark, sf, "part")).select(*[F.get("point", F.lit(i)).alias(f"x{i}") for i in range(3)])


# Samples: what must hold whatever is drawn


def _members(spark, sf, sample: DataFrame) -> DataFrame:
    known = table(spark, sf, "events").select("event_id")
    own = sample.select("event_id")
    return own.join(known, "event_id", "left_semi").agg(F.count("*").alias("known"), F.count_distinct("event_id").alias("different")).join(own.agg(F.count("*").alias("n")))


@query("SELECT n, n AS known, n AS different, TRUE AS in_order FROM (SELECT floor(count(*) * 0.1 + 0.5)::BIGINT AS n FROM events)")
def sample_exact_members(spark, sf):
    """Rows of the table, none twice, exactly as many as asked for, in the table's order."""
    sample = rows.sample_exact(table(spark, sf, "events").coalesce(1), 0.1, seed=1)
    ids = sample.select("event_id", F.monotonically_increasing_id().alias("at"))
    up = ids.agg(F.max(F.struct("event_id", "at"))["at"].alias("a"), F.max("at").alias("b"))
    return _members(spark, sf, sample).join(up.select((F.col("a") == F.col("b")).alias("in_order")))


@query("SELECT TRUE AS about_right, 0::BIGINT AS unknown, 0::BIGINT AS again FROM events LIMIT 1")
def sample_bernoulli_members(spark, sf):
    """Rows of the table, none twice, and a number within six deviations."""
    total, p = table(spark, sf, "events").count(), 0.1
    m = _members(spark, sf, rows.sample_bernoulli(table(spark, sf, "events"), p, 1))
    near = F.abs(F.col("n") - total * p) < 6 * (total * p * (1 - p)) ** 0.5
    return m.select(near.alias("about_right"), (F.col("n") - F.col("known")).alias("unknown"), (F.col("n") - F.col("different")).alias("again"))


@query("SELECT * FROM events ORDER BY substr(md5('3:' || event_id), 1, 13) LIMIT 10")
def draw_rows(spark, sf):
    """Exactly k rows."""
    return rows.draw(table(spark, sf, "events"), 10, 3, ["event_id"])


# Jobs


@query("SELECT count(*) AS count FROM orders")
def job_count_lines(spark, sf):
    """By name, on a table given as a path, written and read again."""
    job = jobs.run_job(spark, "table-count-lines", table=f"{sf}/orders.parquet", output_path=Scratch(spark).path)
    return spark.read.parquet(job.output_path())


@query("SELECT 'c_custkey' AS \"column\", min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max FROM customer UNION ALL SELECT 'c_nationkey', min(c_nationkey), max(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', min(c_acctbal), max(c_acctbal) FROM customer")
def job_table_stats(spark, sf):
    return jobs.run_job(spark, "table-stats", table=tables.Dataset(table(spark, sf, "customer"))).output("stats").select("column", "min", "max")


@query("SELECT * FROM orders WHERE o_custkey % 2 = 0")
def job_chain(spark, sf):
    """A job's output is the next one's table."""
    first = jobs.run_job(spark, "filter-table", table=table(spark, sf, "orders"), filter_function="o_custkey % 2 = 0")
    return jobs.run_job(spark, "time-series-sort", table=first.output(), column="o_orderdate").output()


@query("""SELECT label, round(value, 4) AS value FROM (SELECT avg(c_acctbal) AS avg, min(c_acctbal) AS min, max(c_acctbal) AS max, count(c_acctbal)::DOUBLE AS count FROM customer)
  UNPIVOT (value FOR label IN (avg, min, max, count))""")
def job_visualize(spark, sf):
    """The labels and values that a plot of a job's result draws."""
    return rounded(jobs.run_job(spark, "centrality-stats", table=table(spark, sf, "customer"), column="c_acctbal").visualize())


@query("SELECT o_orderdate AS date, max(o_totalprice) AS value FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, o_totalprice FROM orders) GROUP BY 1")
def job_visualize_series(spark, sf):
    job = jobs.run_job(spark, "time-series-aggregate", table=table(spark, sf, "orders").select("o_orderdate", "o_totalprice"), column="o_orderdate", period="month", aggregation_function="max")
    return plain_time(job.visualize(column="o_totalprice").toDF("date", "value"), "date")


_NAMES = ["table-count-lines", "sample-file", "probabilistic-sample-table", "vectorize-table", "filter-table", "map-table", "normalization", "centrality-stats", "dispersion-stats", "frequency-distribution", "table-stats", "time-series-sort", "time-series-aggregate", "time-series-stationarity", "time-series-stationality", "canopy", "kmeans", "dirichlet", "proclus", "davies-bouldin-index"]


#: Jobs by name, with the options to run them on suppliers, and the number of rows of their result in SQL.
_RUNS = {
    "table-count-lines": ({}, "1"),
    "filter-table": ({"filter_function": "s_nationkey > 9"}, "(SELECT count(*) FROM supplier WHERE s_nationkey > 9)"),
    "frequency-distribution": ({"column": "s_nationkey"}, "(SELECT count(DISTINCT s_nationkey) FROM supplier)"),
    "vectorize-table": ({"column_names": ["s_suppkey", "s_acctbal"]}, "(SELECT count(*) FROM supplier)"),
    "centrality-stats": ({"column": "s_acctbal"}, "1"),
}


@query("SELECT name, has_info, n FROM (VALUES " + ", ".join(f"('{n}', TRUE, {_RUNS[n][1] if n in _RUNS else 'NULL'}::BIGINT)" for n in _NAMES) + ") t(name, has_info, n)")
def job_registry(spark, sf):
    """All jobs by name; some are run, with the number of rows that they give."""
    supplier, made = table(spark, sf, "supplier"), []
    for name in jobs.names():
        n = jobs.run_job(spark, name, table=supplier, **_RUNS[name][0]).output().count() if name in _RUNS else None
        made.append((name, len(jobs.job_info(name)) > len(name), n))
    return spark.createDataFrame(made, "name string, has_info boolean, n long")


@query("SELECT 'c_acctbal' AS \"column\", '100.0' AS average, round(avg((c_acctbal - 100) ** 2), 2) AS var FROM customer")
def job_options(spark, sf):
    """A job knows what it was configured with, before it runs and after."""
    job = jobs.make_job(spark, "dispersion-stats", table=table(spark, sf, "customer"), column="c_acctbal", average=100.0)
    told = {k: str(v) for k, v in job.options.items()}
    return job.run().output().select(F.lit(told["column"]).alias("column"), F.lit(told["average"]).alias("average"), F.round("var", 2).alias("var"))


@query("""SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS named,
  round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS unknown FROM embeddings""")
def distance_by_name(spark, sf):
    """Distances by keyword; unknown names give the Euclidean one."""
    points = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("point"))
    one = F.broadcast(points.where("vec_id = 1").select(F.col("point").alias("one")))  # one row
    return rounded(points.join(one).select("vec_id", *[vectors.build_distance(n)(F.col("point"), F.col("one")).alias(c) for n, c in (("euclidean", "named"), ("no such", "unknown"))]), 6)
