"""Unit conversion by a joined table of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit, category, factor and offset to the category's base (base = (x + offset) * factor).
UNITS = (
    ("m", "length", 1.0, 0.0), ("km", "length", 1000.0, 0.0), ("cm", "length", 0.01, 0.0), ("mm", "length", 0.001, 0.0), ("mi", "length", 1609.344, 0.0), ("ft", "length", 0.3048, 0.0), ("in", "length", 0.0254, 0.0),
    ("kg", "weight", 1.0, 0.0), ("g", "weight", 0.001, 0.0), ("lb", "weight", 0.45359237, 0.0), ("oz", "weight", 0.028349523125, 0.0),
    ("l", "volume", 1.0, 0.0), ("ml", "volume", 0.001, 0.0), ("gal", "volume", 3.785411784, 0.0), ("cup", "volume", 0.2365882365, 0.0),
    ("s", "time", 1.0, 0.0), ("min", "time", 60.0, 0.0), ("h", "time", 3600.0, 0.0), ("day", "time", 86400.0, 0.0),
    ("c", "temperature", 1.0, 0.0), ("f", "temperature", 5 / 9, -32.0), ("k", "temperature", 1.0, -273.15),
)
#: Spanish, English and Portuguese names of the units, without accents.
NAMES = {
    "m": "metro metros meter meters metre metres", "km": "kilometro kilometros quilometro quilometros kilometer kilometers kilometre kilometres",
    "cm": "centimetro centimetros centimeter centimeters centimetre centimetres", "mm": "milimetro milimetros millimeter millimeters millimetre millimetres",
    "mi": "milla millas milha milhas mile miles", "ft": "pie pies pe pes foot feet", "in": "pulgada pulgadas polegada polegadas inch inches",
    "kg": "kilogramo kilogramos kilo kilos quilo quilos quilograma quilogramas kilogram kilograms", "g": "gramo gramos grama gramas gram grams",
    "lb": "libra libras pound pounds", "oz": "onza onzas onca oncas ounce ounces", "l": "litro litros liter liters litre litres",
    "ml": "mililitro mililitros milliliter milliliters millilitre millilitres", "gal": "galon galones galao galoes gallon gallons", "cup": "taza tazas xicara xicaras cups",
    "s": "segundo segundos second seconds", "min": "minuto minutos minute minutes", "h": "hora horas hour hours", "day": "dia dias days",
    "c": "celsius centigrados grados graus grau degree degrees", "f": "fahrenheit", "k": "kelvin",
}


def unit_table(spark: SparkSession) -> DataFrame:
    """(name, unit, category, factor, offset) of every name of a unit: a fixed table."""
    of = {u[0]: u for u in UNITS}
    rows = [(name, *of[unit]) for unit, names in NAMES.items() for name in (unit, *names.split())]
    return spark.createDataFrame(rows, "name string, unit string, category string, factor double, offset double")


def convert(df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """``df`` with ``converted`` and ``error``: null, or unknown, mismatch, or cold (below the absolute zero)."""
    units = unit_table(df.sparkSession)
    name = lambda c: F.replace(F.lower(F.trim(F.translate(c, "áéíóúâêôãõç", "aeiouaeoaoc"))), F.lit("°"), F.lit(""))
    side = lambda p: F.broadcast(units.select(*[F.col(c).alias(f"__{p}_{c}") for c in units.columns]))
    both = df.join(side("a"), name(source) == F.col("__a_name"), "left").join(side("b"), name(target) == F.col("__b_name"), "left")
    base = (F.col(value) + F.col("__a_offset")) * F.col("__a_factor")
    cold = (F.col("__a_category") == "temperature") & (base < -273.15 - 1e-9)
    error = F.when(F.col("__a_unit").isNull() | F.col("__b_unit").isNull(), "unknown").when(F.col("__a_category") != F.col("__b_category"), "mismatch").when(cold, "cold")
    made = F.when(error.isNull(), base / F.col("__b_factor") - F.col("__b_offset"))
    return both.select(*df.columns, made.alias("converted"), error.alias("error"))
