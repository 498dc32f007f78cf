"""Column expressions over entry rows. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.plans.model import KEY


def exact(name: str, value: bytes, fields: str = "fields") -> Column:
    """Whether any field `name` has exactly these bytes."""
    return F.array_contains(F.col(fields), F.struct(F.lit(name).alias("name"), F.lit(value).alias("value")))


def present(name: str, fields: str = "fields") -> Column:
    return F.array_contains(F.col(f"{fields}.name"), F.lit(name))


def get(name: str, fields: str = "fields") -> Column:
    """The first value of a field, as bytes; null if it is absent."""
    return F.get(F.filter(F.col(fields), lambda f: f["name"] == name), 0)["value"]


def text(value: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(value.cast("string"))


def explode_fields(entries: DataFrame) -> DataFrame:
    """One row for each field, in entry order, duplicates included: all other columns, pos, name, value."""
    return entries.select(*(c for c in entries.columns if c != "fields"), F.posexplode("fields").alias("pos", "f")).select("*", "f.name", "f.value").drop("f")


def first_per_name(entries: DataFrame) -> DataFrame:
    """explode_fields with the first duplicate of each name only."""
    w = Window.partitionBy(*KEY, "name").orderBy("pos")
    return explode_fields(entries).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_fields(fields: str = "fields") -> Column:
    """The same without exploding: fields whose name doesn't occur before. The names are drawn out once a row."""
    names = F.array(F.col(f"{fields}.name"))
    return F.transform(names, lambda n: F.filter(F.col(fields), lambda f, i: F.array_position(n, f["name"]) == i + 1))[0]


def wide(entries: DataFrame, names: list[str]) -> DataFrame:
    """A presentation view: the key and one text column for each name (first value)."""
    return entries.select(*KEY, *(text(get(n)).alias(n) for n in names))


def little_endian(x: Column) -> Column:
    """A BIGINT as 16 hex digits, low byte first."""
    h = F.lpad(F.hex(x), 16, "0")
    return F.lower(F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2))))


def cursor_text() -> Column:
    """The entry-key cursor of a row, as text."""
    return F.concat(F.lit("SJ1:04"), F.lower(F.hex("file_id")), little_endian(F.col("entry_offset")), little_endian(F.col("seqnum")), little_endian(F.col("realtime_usec")))
