from civlake.operators import units as u

S = "record_id string, activity_year int, unit_note string, income string, loan_amount string, property_value string, unit string"
RULES = [("hmda", v, "USD_thousands", "USD", 1000.0, 2004, 9999) for v in u.VARIABLES]
RS = "dataset string, variable string, source_unit string, canonical_unit string, scale_factor double, year_start int, year_end int"


def run(spark, rows):
    out = u.harmonise(spark.createDataFrame([(f"r{i}", 2020, *r, "x") for i, r in enumerate(rows)], S), spark.createDataFrame(RULES, RS)).collect()
    return {(int(r.record_id[1:]), r.variable): r for r in out}


def test_written_noted_and_inferred(spark):
    got = run(spark, [(None, "85", "$250,000", "0.5 Mio USD"), ("income (whole dollars) / loan amount in $1,000s", "90", "300", "NA"), (None, "85000", "250", "400000"), ("n.b. property value (dollars, not thousands)", "", None, "300"), (None, "9500000 cents", "120K", "Exempt"), (None, "110 (000s)", "US$9,000.50", "1.2M")])
    unit = {k: r.unit for k, r in got.items()}
    assert unit == {(0, "income"): "USD_thousands", (0, "loan_amount"): "USD", (0, "property_value"): "USD_millions", (1, "income"): "USD", (1, "loan_amount"): "USD_thousands", (2, "income"): "USD", (2, "loan_amount"): "USD_thousands", (2, "property_value"): "USD", (3, "property_value"): "USD", (4, "income"): "USD_cents", (4, "loan_amount"): "USD_thousands", (5, "income"): "USD_thousands", (5, "loan_amount"): "USD", (5, "property_value"): "USD_millions"}
    assert got[4, "income"].canonical_value == 95000.0 and got[0, "property_value"].canonical_value == 500000.0


def test_repeats_nulls_zero_and_empty(spark):
    assert run(spark, []) == {}
    d = spark.createDataFrame([("a", None, None, "0", "-5", None, "x")] * 2, S)
    out = u.harmonise(d, spark.createDataFrame(RULES, RS)).collect()
    assert sorted((r.variable, r.number, r.unit, r.source_unit) for r in out) == [("income", 0.0, "USD", None), ("loan_amount", -5.0, "USD", None)]


def test_ambiguous_combinations_are_flagged(spark):
    got = run(spark, [(None, "2000", None, None), (None, "80", None, None)])
    assert not got[0, "income"].is_unique and got[1, "income"].is_unique


def test_units_and_factors_come_from_the_table(spark):
    rules = [("hmda", "income", "USD_hundreds", "USD", 100.0, 2004, 9999), ("hmda", "loan_amount", "USD_thousands", "USD", 1000.0, 2004, 9999)]
    rows = [(f"r{i}", 2020, None, income, loan, None, "x") for i, (income, loan) in enumerate([("850", "250"), ("9 USD_hundreds", "2 TUSD"), ("80000", "200000")])]
    out = u.harmonise(spark.createDataFrame(rows, S), spark.createDataFrame(rules, RS)).collect()
    got = {(r.record_id, r.variable): (r.unit, r.canonical_value) for r in out}
    assert got["r0", "income"] == ("USD_hundreds", 85000.0) and got["r1", "income"] == ("USD_hundreds", 900.0)
    assert got["r1", "loan_amount"] == ("USD_thousands", 2000.0) and got["r2", "income"] == ("USD", 80000.0)
