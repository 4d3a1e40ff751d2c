import math

from barloom.operators.strategy import Strategy, composition, drawdown, report, simulate

PATH = [  # k, close, high, low, p
    (0, 100.0, 101.0, 99.0, 0.9), (1, 101.0, 103.0, 100.5, 0.9), (2, 102.0, 102.5, 90.0, 0.1), (3, 95.0, 120.0, 80.0, 0.8), (4, 96.0, 96.5, 95.5, None), (5, 96.0, 96.5, 95.5, 0.2), (6, 97.0, 97.5, 96.0, 0.7),
]


def ledger(spark, *strategies):
    path = spark.createDataFrame([("x", *r) for r in PATH], "symbol string, k long, close double, high double, low double, p double")
    return simulate(path, list(strategies))


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("k_entry").collect()]


def test_take_profit_stop_and_expiry(spark):
    one = Strategy("one", 0.5, take=0.02, stop=0.05, horizon=2)
    got = rows(ledger(spark, one), "k_entry", "k_exit", "exit_reason")
    # entered at 0, profit at 1; entered again at 1, stopped at 2 (its low is under the stop); entered at 3, expires at 5; 6 stays open
    assert got == [(0, 1, "tp"), (1, 2, "sl"), (3, 5, "expiry")]


def test_both_barriers_in_one_row_count_as_the_stop(spark):
    wide = Strategy("wide", 0.85, take=0.15, stop=0.15, horizon=9)
    assert rows(ledger(spark, wide), "k_entry", "k_exit", "exit_reason") == [(0, 3, "sl")]


def test_more_positions_and_reports(spark):
    many = Strategy("many", 0.5, take=0.02, stop=0.0, horizon=2, max_open=3)
    one = Strategy("one", 0.5, take=0.02, stop=0.05, horizon=2)
    made = ledger(spark, many, one).cache()
    assert made.filter("strategy = 'many'").count() == 3
    r = {x.strategy: x for x in report(made, cost=0.001).collect()}["one"]
    net = [0.02 - 0.001, -0.05 - 0.001, math.log(96 / 95) - 0.001]
    assert r.trades == 3 and math.isclose(r.hit_rate, 1 / 3) and math.isclose(r.net_return, sum(net))
    d = {x.strategy: x for x in drawdown(made).collect()}["one"]
    assert math.isclose(d.max_drawdown, 0.05) and math.isclose(d.final_return, sum(net) + 0.003)
    assert {(x.strategy, x.exit_reason): x.trades for x in composition(made).collect()}[("one", "sl")] == 1
