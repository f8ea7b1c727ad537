"""Entity-attribute-value rows into wide tables.

1. Values are read and normalised by built-in expressions; each task combines the rows of a cell before the shuffle
   (last arrival, smallest and largest value), so a hot cell never gathers.
2. Entities are hash-bucketed, in the only shuffle of the values.  A bucket's rows are dictionary-encoded by entity and
   attribute and scattered into one numpy array per type, which leaves as an Arrow batch.

An attribute has a place among those of its own table id and type: the wide table has as many columns of a type as the
table with the most of them, however many tables there are, and ``attribute_places`` says which column stands for what.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import BLANKS, durable, pad_left, table

ENTITY = ["table_id", "year", "geo_id"]
CELL = [*ENTITY, "variable_id"]
MISSING_AT_MOST = -555555555
GEO_WIDTH = {"state": 2, "county": 5, "msa": 5, "place": 7, "tract": 11}
#: Cells that a task scatters at once; a bucket with more leaves in several Arrow batches, never splitting an entity.
BLOCK_CELLS = 400_000
#: Up to so many attributes the table of their places is broadcast; more are joined by shuffle.
BROADCAST_PLACES = 500_000


def text_number(c: Column) -> Column:
    """A number as text: blanks, thousands commas, a leading $ and a trailing % or + do not count; else null."""
    t = F.regexp_replace(c, r"\s+", "")
    t = F.regexp_replace(t, r"^\$|[%+]$", "")
    bare = F.regexp_replace(t, ",", "")
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


def row_value(estimate: Column, annotation: Column) -> Column:
    usable = estimate.isNotNull() & ~F.isnan(estimate) & (estimate > MISSING_AT_MOST)
    return F.when(usable, estimate).when(annotation.isNotNull(), text_number(annotation))


def normal_geo(level: Column, geo_id: Column) -> Column:
    g = F.btrim(geo_id, F.lit(BLANKS))
    out = g
    for name, width in GEO_WIDTH.items():
        out = F.when(F.lower(level) == name, pad_left(g, width)).otherwise(out)
    return out


def cells(values: DataFrame) -> DataFrame:
    """One row per (table_id, year, geo_id, variable_id): last_value, low, high.

    last_value is the value that arrived last (largest loaded_at; a null loaded_at counts as earliest;
    of rows that arrived at once, the larger value).  Rows without a value, a geography or a variable
    give no cell.  Repeated rows change nothing.
    """
    rows = value_rows(values)
    return rows.groupBy(*ENTITY, "variable_id").agg(F.max(F.struct("at", "v")).alias("last"), F.min("v").alias("low"), F.max("v").alias("high")).select(*ENTITY, "variable_id", F.col("last.v").alias("last_value"), "low", "high")


def _codes(batch: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row code by the named columns, and the first row of each code."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for name in names:
        enc = batch[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    first = np.full(int(code.max()) + 1 if len(code) else 0, -1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def combined(t: pa.Table) -> pa.Table:
    """One row per cell: the last arrival (of several at once the larger value), least and greatest value."""
    code, first = _codes(t, CELL)
    if len(first) == t.num_rows:
        return t
    order = np.lexsort((t["v"].to_numpy(), t["at"].to_numpy(), code))
    starts = np.searchsorted(code[order], np.arange(len(first)))
    last = order[np.append(starts[1:], len(order)) - 1]
    out = t.take(pa.array(last))
    for name, of in (("low", np.minimum), ("high", np.maximum)):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(of.reduceat(t[name].to_numpy()[order], starts)))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches of a partition sorted by entity, put together up to ``most`` rows and cut only between entities.

    The rows of one entity that exceed this are combined as they come, so it holds no more than it has attributes."""
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.concat_tables(held)
        e = t["entity"].to_numpy()
        cut = int(np.searchsorted(e, e[-1]))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
        held = [combined(rest) if rest.num_rows > most // 2 else rest]
        rows = held[0].num_rows
        most = max(most, 2 * rows)
    if rows:
        yield pa.concat_tables(held)


def value_rows(values: DataFrame) -> DataFrame:
    """The rows that give a value to a cell: table_id, year, geo_id, variable_id, v, loaded (microseconds; null counts as earliest)."""
    return values.select(
        F.col("table_id"),
        F.col("year"),
        normal_geo(F.col("geo_level"), F.col("geo_id")).alias("geo_id"),
        F.upper(F.btrim("variable_id", F.lit(BLANKS))).alias("variable_id"),
        row_value(F.col("estimate"), F.col("annotation")).alias("v"),
        F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp_ltz")), F.lit(-(1 << 55))).alias("at"),
    ).where("v IS NOT NULL AND geo_id <> '' AND variable_id <> ''")


def _bucketed(rows: DataFrame) -> DataFrame:
    """Combine the rows of each cell within a task and hash-bucket the entities; in a bucket an entity's rows stand together.

    ``rows``: the columns of ``value_rows`` and others, which go along as they are for a cell."""
    e = rows.withColumn("entity", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in ENTITY]))
    e = e.withColumns({"low": F.col("v"), "high": F.col("v")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK_CELLS:
                yield from combined(pa.Table.from_batches(held)).to_batches()
                held = []
        if held:
            yield from combined(pa.Table.from_batches(held)).to_batches()

    return e.mapInArrow(run, e.schema).repartition("entity").sortWithinPartitions("entity")


def _grid(t: pa.Table, row: np.ndarray, col: np.ndarray, lo: int, hi: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's rows of entities lo to hi scattered by attribute and entity: place of the last arrival, least, greatest, and the rows used."""
    k = np.nonzero((row >= lo) & (row < hi) & (col >= 0))[0]
    k = k[np.lexsort((t["v"].to_numpy()[k], t["at"].to_numpy()[k]))]  # the last one written to a place stays
    where = (col[k], row[k] - lo)
    last = np.full((width, hi - lo), -1, dtype=np.int64)
    low, high = np.full(last.shape, np.inf), np.full(last.shape, -np.inf)
    last[where] = k
    np.minimum.at(low, where, t["low"].to_numpy()[k])
    np.maximum.at(high, where, t["high"].to_numpy()[k])
    return last, low, high, k


def scatter_conflicts(values: DataFrame) -> DataFrame:
    """table_id, year, geo_id, variable_id of the cells whose rows give two or more different values.

    Rows without a value, a geography or a variable give no cell; repeated rows change nothing; an empty table has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, BLOCK_CELLS):
            row, first = _codes(t, ENTITY)
            attr, at = _codes(t, ["table_id", "variable_id"])
            owner = _codes(t, ["table_id"])[0][at]
            col = (np.arange(len(at)) - np.searchsorted(owner, owner))[attr]  # place among the columns of its own table
            width = int(col.max()) + 1
            step = max(1, 4 * BLOCK_CELLS // width)
            for lo in range(0, len(first), step):
                last, low, high, _ = _grid(t, row, col, lo, min(lo + step, len(first)), width)
                differ = pa.array(last[low < high])
                yield pa.RecordBatch.from_arrays([t[n].combine_chunks().take(differ) for n in CELL], names=CELL)

    return _bucketed(value_rows(values)).mapInArrow(run, "table_id string, year int, geo_id string, variable_id string")


def attribute_places(values: DataFrame) -> DataFrame:
    """table_id, variable_id, type, place, column_name: where each attribute stands in the wide table.

    type: ``bigint`` where every value given is a whole number under 2^53, else ``double``.  place: from 0, in order of
    variable_id among the attributes of one table id and type; column_name: ``whole_<place>`` or ``real_<place>``.
    """
    whole = F.bool_and((F.col("v") == F.floor("v")) & (F.abs("v") < 2**53))
    a = value_rows(values).groupBy("table_id", "variable_id").agg(whole.alias("w"))
    a = a.withColumn("type", F.when(F.col("w"), "bigint").otherwise("double"))
    place = F.row_number().over(W.partitionBy("table_id", "type").orderBy("variable_id")) - 1
    return a.select("table_id", "variable_id", "type", place.alias("place"), F.concat(F.when(F.col("w"), "whole_").otherwise("real_"), place.cast("string")).alias("column_name"))


def scatter_wide(values: DataFrame, places: DataFrame) -> DataFrame:
    """One row per entity: table_id, year, geo_id, n_cells, whole_0 .. (bigint) and real_0 .. (double), as ``places`` has them.

    A cell holds the value that arrived last (largest loaded_at; a null one counts as earliest; of rows that arrived at
    once, the larger value); cells an entity lacks are null.  No two attributes share a column of one table id.
    """
    places = durable(places.select("table_id", "variable_id", "type", "place"))
    size = {r["type"]: r["n"] for r in places.groupBy("type").agg((F.max("place") + 1).alias("n")).collect()}
    names = [f"whole_{i}" for i in range(size.get("bigint", 0))], [f"real_{i}" for i in range(size.get("double", 0))]
    schema = ", ".join(["table_id string, year int, geo_id string, n_cells bigint", *[f"{n} bigint" for n in names[0]], *[f"{n} double" for n in names[1]]])
    p = places.select(F.col("table_id").alias("__t"), F.col("variable_id").alias("__v"), (F.col("type") == "bigint").alias("is_whole"), "place")
    few = places.count() <= BROADCAST_PLACES
    rows = value_rows(values)
    rows = rows.join(F.broadcast(p) if few else p, F.col("table_id").eqNullSafe(F.col("__t")) & (F.col("variable_id") == F.col("__v"))).drop("__t", "__v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, BLOCK_CELLS):
            row, first = _codes(t, ENTITY)
            is_whole, place = t["is_whole"].to_numpy(), t["place"].to_numpy().astype(np.int64)
            value = t["v"].to_numpy()
            step = max(1, 4 * BLOCK_CELLS // max(1, *map(len, names)))
            for lo in range(0, len(first), step):
                hi = min(lo + step, len(first))
                cells_of = np.zeros(hi - lo, dtype=np.int64)
                out = []
                for part, kind, pick in ((names[0], np.int64, is_whole), (names[1], np.float64, ~is_whole)):
                    last = _grid(t, row, np.where(pick, place, -1), lo, hi, len(part))[0]
                    there = last >= 0
                    cells_of += there.sum(axis=0)
                    grid = np.where(there, value[last], 0).astype(kind)
                    out += [pa.array(grid[i], mask=~there[i]) for i in range(len(part))]
                keys = [t[k].combine_chunks().take(pa.array(first[lo:hi])) for k in ENTITY]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(cells_of), *out], names=[*ENTITY, "n_cells", *names[0], *names[1]])

    return _bucketed(rows).mapInArrow(run, schema)


def wide_table(values: DataFrame, table_id: str) -> DataFrame:
    """The wide table of one table id, with a typed column for each variable_id under its own name.

    An id that equals one of table_id, year, geo_id, n_cells or another id but for case has an underscore put before it."""
    own = values.where(F.col("table_id") == table_id)
    places = attribute_places(own).collect()  # the columns of one table
    taken = {"table_id", "year", "geo_id", "n_cells"}
    out = []
    for r in sorted(places, key=lambda r: r["variable_id"]):
        name = r["variable_id"]
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(F.col(r["column_name"]).alias(name))
    return scatter_wide(own, attribute_places(own)).select(*ENTITY, "n_cells", *out)


def melted(wide: DataFrame, places: DataFrame) -> DataFrame:
    """A wide table back to cells: table_id, year, geo_id, variable_id, last_value."""
    columns = [c for c in wide.columns if c.startswith(("whole_", "real_"))]
    each = F.filter(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("last_value")) for c in columns]), lambda x: x.last_value.isNotNull())
    long = wide.select(*ENTITY, F.explode(each).alias("x")).select(*ENTITY, "x.*")
    p = places.select(F.col("table_id").alias("__t"), "column_name", "variable_id")
    return long.join(p, F.col("table_id").eqNullSafe(F.col("__t")) & (long["column_name"] == p["column_name"])).select(*CELL, "last_value")


def p3_wide(spark, d: str) -> DataFrame:
    """Every entity of every table in one wide table; ``p3_columns`` names the columns of each table."""
    v = table(spark, d, "stat_values")
    return scatter_wide(v, attribute_places(v))


def p3_columns(spark, d: str) -> DataFrame:
    return attribute_places(table(spark, d, "stat_values"))


def p3_cells(spark, d: str) -> DataFrame:
    """The wide table read back as cells: what went in comes out."""
    v = table(spark, d, "stat_values")
    places = durable(attribute_places(v))
    return melted(scatter_wide(v, places), places)


def p3_found(spark, d: str) -> DataFrame:
    return scatter_conflicts(table(spark, d, "stat_values"))


def p3_last_values(spark, d: str) -> DataFrame:
    """The long form of the wide table: the value of each cell that arrived last, summed up per table and year."""
    return cells(table(spark, d, "stat_values")).groupBy("table_id", "year").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("last_value"), 2).alias("total"))


_SQL_CELLS = """
WITH r AS (
  SELECT table_id, year, upper(trim(variable_id, E' \\t\\n\\r\\f\\v')) AS variable_id, trim(geo_id, E' \\t\\n\\r\\f\\v') AS g,
         CASE lower(geo_level) WHEN 'state' THEN 2 WHEN 'county' THEN 5 WHEN 'msa' THEN 5 WHEN 'place' THEN 7 WHEN 'tract' THEN 11 ELSE 0 END AS w,
         CASE WHEN estimate IS NOT NULL AND NOT isnan(estimate) AND estimate > -555555555 THEN estimate
              ELSE try_cast(replace(regexp_replace(regexp_replace(annotation, '\\s+', '', 'g'), '^\\$|[%+]$', '', 'g'), ',', '') AS DOUBLE) END AS v,
         loaded_at
  FROM stat_values
), n AS (
  SELECT table_id, year, CASE WHEN length(g) < w THEN lpad(g, w::INT, '0') ELSE g END AS geo_id, variable_id, v, loaded_at FROM r
  WHERE v IS NOT NULL AND g <> '' AND variable_id <> ''
), c AS (
  SELECT table_id, year, geo_id, variable_id, min(v) AS low, max(v) AS high, arg_max(v, (loaded_at, v)) AS last_value FROM n GROUP BY ALL
)
"""

_SQL_KINDS = _SQL_CELLS + """
, k AS (SELECT table_id, variable_id, bool_and(v = floor(v) AND abs(v) < 9007199254740992) AS w FROM n GROUP BY ALL),
p AS (SELECT table_id, variable_id, w, row_number() OVER (PARTITION BY table_id, w ORDER BY variable_id) - 1 AS place FROM k)
"""

QUERIES = {"p3_found": p3_found, "p3_wide": p3_wide, "p3_columns": p3_columns, "p3_cells": p3_cells, "p3_last_values": p3_last_values}
SQL = {
    "p3_found": _SQL_CELLS + "SELECT table_id, year, geo_id, variable_id FROM c WHERE low < high",
    "p3_columns": _SQL_KINDS + "SELECT table_id, variable_id, CASE WHEN w THEN 'bigint' ELSE 'double' END AS type, place::INT AS place, CASE WHEN w THEN 'whole_' ELSE 'real_' END || place AS column_name FROM p",
    "p3_cells": _SQL_CELLS + "SELECT table_id, year, geo_id, variable_id, last_value FROM c",
    "p3_last_values": _SQL_CELLS + "SELECT table_id, year, count(*) AS n_cells, round(sum(last_value), 2) AS total FROM c GROUP BY ALL",
}
