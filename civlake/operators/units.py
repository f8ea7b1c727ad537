"""Quantities recorded in different units.

The unit of an amount is the one written with the value; else the one that the file's note states for
the variable; else it is inferred: the amounts of a record are tied by identities that hold in any unit
(log property - log loan, log loan - log income, and the log level of each), whose centre and spread are
estimated over all amounts of known unit.  Of the unit combinations of a record's open amounts, the one
with the least sum of squared, scaled log residuals is chosen; it is flagged as not unique if another
combination comes within ``MARGIN``.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, table

VARIABLES = ["income", "loan_amount", "property_value"]
#: Units that a value or note can state by common words, in dollars; others, and their factors, come from the unit table.
FACTOR = {"USD": 1.0, "USD_thousands": 1e3, "USD_millions": 1e6, "USD_cents": 0.01}
#: Units that compete for an amount of which none is stated, besides those the unit table lists for the variables.
OPEN = ("USD", "USD_thousands")
#: Ties between the amounts of a record: level of one, or ratio of two.
IDENTITIES = [("income",), ("loan_amount",), ("property_value",), ("property_value", "loan_amount"), ("loan_amount", "income"), ("property_value", "income")]
#: Centre and spread (natural log) used for an identity with fewer than LEAST_KNOWN known records.
FALLBACK = {("income",): (11.2, 0.8), ("loan_amount",): (12.4, 0.8), ("property_value",): (12.8, 0.8), ("property_value", "loan_amount"): (0.35, 0.6), ("loan_amount", "income"): (1.1, 0.8), ("property_value", "income"): (1.5, 0.8)}
LEAST_KNOWN = 200
MARGIN = 4.0
#: A rule table of at most so many rows is broadcast; a longer one is joined by shuffle.
RULES_MOST = 10_000
NAMES = {"income": r"income", "loan_amount": r"loan\s+amount|amount\s+of\s+(?:the\s+)?loan", "property_value": r"property\s+value|value\s+of\s+(?:the\s+)?property"}

THOUSANDS = r"thousand|\b000\s*s\b|1,?000\s*s?\b"
MILLIONS = r"million|\bmio\b|\bmn\b"


def listed_factors(units: DataFrame, dataset: str) -> dict[str, float]:
    """Dollars in each unit that the table lists for the variables; units of other canonical units are left out.

    What is collected is the distinct units of three variables, not the table."""
    u = units.where((F.col("dataset") == dataset) & F.col("variable").isin(VARIABLES) & (F.col("canonical_unit") == "USD") & (F.col("scale_factor") > 0))
    return {r["source_unit"]: r["f"] for r in u.groupBy("source_unit").agg(F.max("scale_factor").alias("f")).collect() if r["source_unit"]}


def _written(raw: Column, own_units: list[str]) -> tuple[Column, Column]:
    """Number and unit of an amount as text; the unit is null where none is written with it."""
    t = F.lower(F.trim(F.regexp_replace(raw, r"[\s ]+", " ")))
    digits = F.regexp_extract(t, r"(-?\d[\d,]*\.?\d*|-?\.\d+)", 1)
    number = F.regexp_replace(digits, ",", "").try_cast("double")
    rest = F.trim(F.replace(t, digits, F.lit(" ")))
    unit = F
    for u in sorted(set(own_units) - set(FACTOR)):
        unit = unit.when(rest.contains(u.lower()), u)
    unit = (
        unit.when(rest.rlike(r"\bcents?\b|^c$|¢"), "USD_cents")
        .when(rest.rlike(r"million|\bmio\b|\bmn\b|\bmm\b|^[\s$a-z]*\bm\b|^\$?\s*m$"), "USD_millions")
        .when(rest.rlike(r"thousand|\(\s*000s?\s*\)|\btusd\b|\btsd\b|^\$?\s*k$|\bk\b"), "USD_thousands")
        .when(rest.rlike(r"\$|usd|dollar"), "USD")
    )
    # most amounts are bare numbers and skip all of the above; digits inside "(000s)" belong to the unit, as the first number is the amount
    plain = F.trim(raw)
    bare = plain.rlike(r"^[0-9]+(\.[0-9]+)?$")
    return F.when(bare, plain.try_cast("double")).when(digits != "", number), F.when(~bare & (digits != ""), unit)


def note_unit(note: Column, variable: str) -> Column:
    """The unit that a file's note states for the variable, else null.  Statements are parted by `` / `` or ``;``."""
    low = F.lower(note)
    parts = F.split(F.when(low.rlike(NAMES[variable]), low), r"\s+/\s+|;")
    own = F.filter(parts, lambda p: p.rlike(NAMES[variable]))
    text = F.regexp_replace(F.get(own, F.lit(0)), NAMES[variable], " ")
    whole = text.rlike(r"not\s+(?:in\s+)?(?:thousand|\$?1,?000)|whole\s+dollar|full\s+(?:\$|dollar)|in\s+(?:full\s+)?dollars|units?\s+of\s+1\s+(?:usd|dollar)")
    return (
        F.when(whole, "USD")
        .when(text.rlike(THOUSANDS + r"|\btusd\b|\$k\b"), "USD_thousands")
        .when(text.rlike(MILLIONS), "USD_millions")
        .when(text.rlike(r"\bcents?\b"), "USD_cents")
        .when(text.rlike(r"usd|dollar|\$"), "USD")
    )


def _absent(raw: Column) -> Column:
    return raw.isNull() | F.trim(raw).isin("", "NA", "Exempt", "N/A", "na", "exempt")


def read_amounts(lar: DataFrame, own_units: list[str] = ()) -> DataFrame:
    """record_id, activity_year and per variable <v>_number and <v>_unit (stated, else null)."""
    out = [F.col("record_id"), F.col("activity_year")]
    for v in VARIABLES:
        number, unit = _written(F.col(v), list(own_units))
        number = F.when(~_absent(F.col(v)), number)
        out += [number.alias(f"{v}_number"), F.when(number.isNotNull(), F.coalesce(unit, note_unit(F.col("unit_note"), v))).alias(f"{v}_unit"), unit.isNotNull().alias(f"{v}_written")]
    return lar.select(*out)


def _log_dollars(v: str, factors: dict[str, float]) -> Column:
    factor = F.lit(None).cast("double")
    for u, f in factors.items():
        factor = F.when(F.col(f"{v}_unit") == u, f).otherwise(factor)
    return F.when(F.col(f"{v}_number") > 0, F.log(F.col(f"{v}_number") * factor))


def _over(parts: tuple[str, ...], logs: dict[str, Column]) -> Column:
    return logs[parts[0]] - logs[parts[1]] if len(parts) == 2 else logs[parts[0]]


def fit_identities(amounts: DataFrame, factors: dict[str, float] = FACTOR) -> dict[tuple[str, ...], tuple[float, float]]:
    """Centre and spread of each identity over all records whose units are stated; one pass, one row to the driver."""
    logs = {v: _log_dollars(v, factors) for v in VARIABLES}
    aggs = [a for i, parts in enumerate(IDENTITIES) for x in [_over(parts, logs)] for a in (F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"))]
    r = amounts.agg(*aggs).first()
    return {parts: (r[f"m{i}"], max(r[f"s{i}"], 0.3)) if r[f"n{i}"] >= LEAST_KNOWN else FALLBACK[parts] for i, parts in enumerate(IDENTITIES)}


def infer_units(amounts: DataFrame, fitted: dict[tuple[str, ...], tuple[float, float]], factors: dict[str, float] = FACTOR, competing: tuple[str, ...] = OPEN) -> DataFrame:
    """Complete the units: <v>_unit for every number, <v>_unique false where two combinations fit about equally.

    Zero and negative amounts take no part in identities; without any identity the smaller factor (dollars) wins.  Only
    arithmetic over the terms of the identities: the unit of a variable in the best combination is the one whose own
    best combination costs least.
    """
    competing = tuple(sorted(competing, key=lambda u: (factors[u], u)))
    logs = {}
    for v in VARIABLES:
        amounts = amounts.withColumns({f"{v}_open": F.when(F.col(f"{v}_unit").isNull() & (F.col(f"{v}_number") > 0), F.log(f"{v}_number")), f"{v}_known": _log_dollars(v, factors)})
        logs[v] = {u: F.coalesce(F.col(f"{v}_known"), F.col(f"{v}_open") + math.log(factors[u])) for u in competing}
    terms = {}
    for i, parts in enumerate(IDENTITIES):
        m, s = fitted[parts]
        for pick in product(range(len(competing)), repeat=len(parts)):
            x = (_over(parts, {v: logs[v][competing[k]] for v, k in zip(parts, pick, strict=True)}) - float(m)) / float(s)
            terms[f"__t{i}_" + "_".join(map(str, pick))] = F.coalesce(x * x, F.lit(0.0))
    amounts = amounts.withColumns(terms)
    place = {v: i for i, v in enumerate(VARIABLES)}
    costs = {}
    for pick in product(range(len(competing)), repeat=len(VARIABLES)):
        # a combination that scales a variable without an open amount is the same as the one that doesn't; the small cost settles it
        cost = F.lit(1e-9 * sum(pick))
        for i, parts in enumerate(IDENTITIES):
            cost = cost + F.col(f"__t{i}_" + "_".join(str(pick[place[v]]) for v in parts))
        costs[pick] = cost
    amounts = amounts.withColumns({"__c" + "_".join(map(str, p)): c for p, c in costs.items()})
    out = [F.col("record_id"), F.col("activity_year")]
    for i, v in enumerate(VARIABLES):
        by = [F.least(*[F.col("__c" + "_".join(map(str, p))) for p in costs if p[i] == k]) for k in range(len(competing))]
        least = F.least(*by)
        unit = F
        for k, u in enumerate(competing):
            unit = unit.when(by[k] == least, u)
        near = sum(((c < least + MARGIN).cast("int") for c in by), F.lit(0)) > 1
        open_ = F.col(f"{v}_unit").isNull() & F.col(f"{v}_number").isNotNull()
        out += [F.col(f"{v}_number"), F.when(open_, unit).otherwise(F.col(f"{v}_unit")).alias(f"{v}_unit"), F.when(open_, ~near).otherwise(F.lit(True)).alias(f"{v}_unique"), F.when(F.col(f"{v}_number").isNull(), None).when(open_, "inferred").when(F.col(f"{v}_written"), "value").otherwise("note").alias(f"{v}_source")]
    return amounts.select(*out)


def harmonise(lar: DataFrame, units: DataFrame, dataset: str = "hmda") -> DataFrame:
    """All amounts in the canonical unit: record_id, variable, activity_year, number, unit, stated_by, is_unique,
    source_unit, canonical_unit, canonical_value.

    ``units``: dataset, variable, source_unit, canonical_unit, scale_factor, year_start, year_end.  Absent amounts
    (null, blank, NA, Exempt) and amounts without a digit give no row.  A record delivered again gives its rows once.
    A variable or year that ``units`` does not list keeps a null source_unit and the canonical unit USD.  An amount in the
    source unit is multiplied by the row's scale_factor; units that ``units`` lists for a variable compete for amounts
    of which none is stated, and are read where a value names them.
    """
    listed = listed_factors(units, dataset)
    factors = FACTOR | listed
    # A delivered copy has the same content: hashing by record id combines them before the shuffle.
    amounts = durable(read_amounts(lar, list(listed)).dropDuplicates())  # read by the fit and by the inference
    done = infer_units(amounts, fit_identities(amounts, factors), factors, tuple({*OPEN, *listed}))
    long = done.select("record_id", "activity_year", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_number").alias("number"), F.col(f"{v}_unit").alias("unit"), F.col(f"{v}_source").alias("stated_by"), F.col(f"{v}_unique").alias("is_unique")) for v in VARIABLES])).alias("a")).select("record_id", "activity_year", "a.*").where("number IS NOT NULL")
    u = units.where(F.col("dataset") == dataset).select(F.col("variable").alias("__v"), "source_unit", "canonical_unit", "scale_factor", "year_start", "year_end")
    u = F.broadcast(u) if u.count() <= RULES_MOST else u
    joined = long.join(u, (F.col("variable") == F.col("__v")) & (F.coalesce("activity_year", F.lit(-1)) >= F.coalesce("year_start", F.lit(-9999))) & (F.coalesce("activity_year", F.lit(-1)) <= F.coalesce("year_end", F.lit(9999))), "left")
    factor = F.create_map(*[x for k, f in factors.items() for x in (F.lit(k), F.lit(f))])
    canonical = F.coalesce("canonical_unit", F.lit("USD"))
    return joined.select("record_id", "variable", "activity_year", "number", "unit", "stated_by", "is_unique", "source_unit", canonical.alias("canonical_unit"), (F.col("number") * F.when(F.col("unit") == F.col("source_unit"), F.col("scale_factor")).otherwise(factor[F.col("unit")] / factor[canonical])).alias("canonical_value"))


def p4_amounts(spark, d: str) -> DataFrame:
    return harmonise(table(spark, d, "hmda_lar"), table(spark, d, "hmda_units"))


def p4_found(spark, d: str) -> DataFrame:
    return p4_amounts(spark, d).where("source_unit IS NOT NULL AND unit <> source_unit").select("record_id", "variable").distinct()


QUERIES = {"p4_found": p4_found, "p4_amounts": p4_amounts}
SQL = {
    "p4_found": """
WITH u AS (
  SELECT DISTINCT record_id, activity_year, unnest([
    struct_pack(variable := 'income', raw := income, pat := 'income'),
    struct_pack(variable := 'loan_amount', raw := loan_amount, pat := 'loan amount|amount of loan'),
    struct_pack(variable := 'property_value', raw := property_value, pat := 'property value|value of property')], recursive := true), lower(unit_note) AS note
  FROM hmda_lar
), w AS (
  SELECT *, lower(trim(raw)) AS t, list_filter(regexp_split_to_array(note, ' +/ +'), lambda x: regexp_matches(x, pat))[1] AS stated FROM u
  WHERE trim(raw) NOT IN ('', 'NA', 'Exempt')
), n AS (
  SELECT *, try_cast(replace(regexp_extract(t, '[0-9][0-9,]*\\.?[0-9]*'), ',', '') AS DOUBLE) AS number,
    CASE WHEN regexp_matches(t, 'cent|c$') THEN 'USD_cents' WHEN regexp_matches(t, 'million|mio|mn|m$') THEN 'USD_millions'
         WHEN regexp_matches(t, 'thousand|\\(000s\\)|tusd|k$') THEN 'USD_thousands' WHEN regexp_matches(t, '\\$|usd|dollar') THEN 'USD'
         WHEN regexp_matches(stated, 'not thousands|whole dollar|full \\$') THEN 'USD' WHEN regexp_matches(stated, 'thousand|000s') THEN 'USD_thousands'
         WHEN regexp_matches(stated, 'usd|dollar|\\$') THEN 'USD' END AS known
  FROM w
)
SELECT DISTINCT n.record_id, n.variable FROM n JOIN hmda_units h ON h.dataset = 'hmda' AND h.variable = n.variable AND n.activity_year BETWEEN h.year_start AND h.year_end
WHERE coalesce(known, CASE WHEN number < 10000 THEN 'USD_thousands' ELSE 'USD' END) <> h.source_unit
""",
}
