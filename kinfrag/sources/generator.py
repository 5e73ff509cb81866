"""Generated relations, the same ones for a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Persons and draws of diseases for a scale factor of 1; the one prescription; ages are below ``AGES``.
PERSONS, DRAWS, PRESCRIPTION, AGES = 50, 100, "rest and tea", 120

GIVEN = ("Ada", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gail", "Hugo", "Iris", "Jan")
FAMILY = ("Abel", "Berg", "Cole", "Dorn", "Esser", "Falk", "Gram", "Hahn", "Ivers", "Jost")
STREET = ("Oak Street", "Mill Lane", "High Road", "Park Row", "Lake View")


def generate(spark: SparkSession, terms: DataFrame, scale: int, seed: int = 1) -> dict[str, DataFrame]:
    """Persons and who has which term and prescription, by ``scale``; some persons may have no term.

    ``terms`` has ``term`` and may have ``cui``.
    """
    if scale < 0:
        raise ValueError("scale must not be negative")

    def draw(what: str, n: int, *of: str):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(n))

    def pick(values: tuple[str, ...], what: str):
        return F.element_at(F.array(*map(F.lit, values)), (draw(what, len(values), "id") + 1).cast("int"))

    persons = max(1, PERSONS * scale)
    info = spark.range(PERSONS * scale).select(
        F.col("id").cast("int").alias("id"),
        F.concat_ws(" ", pick(GIVEN, "given"), pick(FAMILY, "family")).alias("name"),
        F.concat_ws(" ", pick(STREET, "street"), (draw("number", 200, "id") + 1).cast("string")).alias("address"),
        draw("age", AGES, "id").cast("int").alias("age"),
    )
    cui = F.col("cui") if "cui" in terms.columns else F.lit(None).cast("string")
    # The terms of an attribute are few: one task numbers them.
    numbered = terms.select("term", cui.alias("cui")).dropDuplicates(["term"]).withColumn("n", F.row_number().over(Window.orderBy("term")) - 1)
    count = max(1, numbered.count())
    drawn = spark.range(DRAWS * scale).select(draw("person", persons, "id").cast("int").alias("person"), draw("term", count, "id").cast("int").alias("n"))
    drawn = drawn.join(numbered, "n")
    return {
        "INFO": info,
        "ILL": drawn.select(F.col("person").alias("id"), F.col("term").alias("disease"), "cui").dropDuplicates(["id", "disease"]),
        "TREAT": drawn.select(F.col("person").alias("id"), F.lit(PRESCRIPTION).alias("prescription"), F.lit(None).cast("boolean").alias("success")).dropDuplicates(["id", "prescription"]),
    }
