"""The five raw retail tables, derived from a TPC-H-like star schema.

Lets every operator run on order data: a line item is a sale, the supplier's place is the store, the
part's type and size class is the item, the ship date is the day.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.sources.statistics import column_ends

# One year of holidays covering every rule branch
# (month, day, type, locale, locale_name, description, transferred).
HOLIDAYS = [
    (1, 1, "Holiday", "National", "Country", "New year", False),
    (1, 12, "Work Day", "National", "Country", "Make-up day", False),
    (2, 8, "Holiday", "National", "Country", "Carnival", True),
    (2, 9, "Transfer", "National", "Country", "Carnival moved", False),
    (3, 5, "Holiday", "Local", "Capital", "Foundation", False),
    (5, 2, "Bridge", "National", "Country", "Bridge day", False),
    (7, 1, "Event", "National", "Country", "Match", False),
    (12, 24, "Additional", "National", "Country", "Christmas eve", False),
]

# The columns read from each table. Stated, so that opening a table runs no job.
COLUMNS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_type STRING, p_size INT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


@dataclass(frozen=True)
class Grain:
    """How stores and items are cut from the star schema."""

    store: str = "region"  # region (5 stores), nation (25) or supplier

    @property
    def store_column(self) -> str:
        return {"region": "n_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey"}[self.store]


class StarSchemaTables(Mapping):
    """The raw retail tables by name. A table is put together when it is first asked for."""

    NAMES = ("train", "transactions", "stores", "items", "holidays_events")

    def __init__(self, spark: SparkSession, folder: str, grain: Grain = Grain()):
        self._spark, self._folder, self._grain = spark, folder, grain
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.schema(COLUMNS[name]).parquet(f"{self._folder}/{name}.parquet")

    @property
    def _store(self) -> Column:
        return F.col(self._grain.store_column).cast("int")

    @property
    def _large(self) -> Column:
        return (F.col("p_size") > 25).cast("int")

    def _products(self) -> DataFrame:
        """Parts with their item: two size classes of each type, types in alphabetical order."""
        part = self._table("part")
        types = part.select("p_type").distinct()  # a handful
        position = F.row_number().over(Window.orderBy(F.col("p_type").asc_nulls_last())) - 1
        numbered = types.withColumn("position", position).withColumnRenamed("p_type", "type")
        return part.join(numbered, F.col("p_type").eqNullSafe(F.col("type"))).withColumns({
            "class": F.coalesce(self._large, F.lit(0)),
            "item_nbr": (2 * F.col("position") + F.coalesce(self._large, F.lit(0))).cast("int"),
        })

    def _lines(self) -> DataFrame:
        """Line items with their store and day."""
        lines = self._table("lineitem")
        return (  # one after the other: Spark knows the size of a table, and overrates that of a join
            lines.join(self._table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self._table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(*lines.columns, self._store.alias("store_nbr"))
            .withColumn("date", F.col("l_shipdate").cast("date"))
        )

    def _train(self) -> DataFrame:
        products = self._products().select(F.col("p_partkey").alias("l_partkey"), "item_nbr")
        returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
        return self._lines().join(products, "l_partkey").select(
            F.col("l_orderkey").alias("id"), "date", "store_nbr", "item_nbr",
            F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("unit_sales"),
            F.when(F.col("l_discount") != 0, F.col("l_discount") >= 0.09).alias("onpromotion"),
        )

    def _transactions(self) -> DataFrame:
        return self._lines().groupBy("date", "store_nbr").agg(
            F.count_distinct("l_orderkey").cast("int").alias("transactions"))

    def _stores(self) -> DataFrame:
        places = self._table("nation").join(self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        if self._grain.store == "supplier":
            places = places.join(self._table("supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
        return (
            places.groupBy(self._store.alias("store_nbr"))
            .agg(F.min("r_name").alias("city"), F.min("n_name").alias("state"),
                 F.min("n_regionkey").cast("int").alias("cluster"))
            .select("store_nbr", "city", "state", F.when(F.col("cluster") < 2, "A").otherwise("B").alias("type"), "cluster")
        )

    def _items(self) -> DataFrame:
        return (
            self._products().select("item_nbr", F.col("p_type").alias("family"), "class").distinct()
            .withColumn("perishable", (F.col("item_nbr") % 3 == 0).cast("int"))
        )

    def _holidays_events(self) -> DataFrame:
        """Every year from the first to the last that ships anything gets the same entries. The two ends come from the
        footers of the files, read when the table is first asked for; no row is."""
        fields = ("month", "day", "type", "locale", "locale_name", "description", "transferred")
        entries = F.array(*[
            F.struct(*[F.lit(value).alias(field) for field, value in zip(fields, row)]) for row in HOLIDAYS
        ])
        ends = column_ends(self._spark, f"{self._folder}/lineitem.parquet", "l_shipdate")
        years = range(ends.first.year, ends.last.year + 1) if ends.first else range(0)
        return (
            self._spark.range(years.start, years.stop).select(F.col("id").cast("int").alias("year"))
            .select("year", F.inline(entries))
            .select(F.make_date("year", "month", "day").alias("date"), *fields[2:])
        )
