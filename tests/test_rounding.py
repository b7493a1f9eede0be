import duckdb

from tessera.functions import text as T


def test_doubles_are_rounded_as_sql_engines_round_them(spark):
    """Halves behind the last digit: the decimal text and the scaled double fall to different sides."""
    values = [k * 0.01 * (1 + i * 0.00001) for k in range(5, 4000, 10) for i in range(1, 60)] + [0.0, -0.0, -4.0500405, 1e300, -1e15, 1 / 3, float("inf"), float("-inf"), 4503599627.370497, 20.1100005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(len(values), None)], "i long, v double").repartition(8)
    got = {r.i: r.r for r in df.select("i", T.half_away("v", 6).alias("r")).collect()}
    con = duckdb.connect()
    want = [con.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values[-10:]]
    con.execute("create table t as select unnest(?::double[]) as v", [values[:-10]])
    want = [r[0] for r in con.execute("select round(v, 6) from t").fetchall()] + want
    assert [got[i] for i in range(len(values))] == want and got[len(values)] is None


def test_logarithms_are_those_of_the_c_library(spark):
    """log(exp(x)) of halves behind the sixth digit: the last bit says to which side they are rounded."""
    values = [k * 0.01 * (1 + i * 0.00001) for k in range(5, 2999, 2) for i in range(1, 60)] + [0.3500105, 0.0, -800.0, 29.9999999, 30.0, 1e9, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(len(values), None)], "i long, v double").repartition(8)
    got = {r.i: r.r for r in df.select("i", T.half_away(T.log(T.perplexity("v")), 6).alias("r")).collect()}
    con = duckdb.connect()
    con.execute("create table t as select unnest(?::double[]) as v", [values])
    sql = "select round(ln(case when v < 30 then exp(v) else 'inf'::double end), 6) from t where v > -700 or v is null"
    want = [r[0] for r in con.execute(sql).fetchall()]
    assert [got[i] for i, v in enumerate(values) if v != -800.0] == want
    assert got[values.index(-800.0)] is None and got[len(values)] == float("inf")
