"""Which of several methods of one name a call means: by the number of its arguments and how far their types are from the parameters'.

A candidate fits if it takes as many arguments and each of them can stand for the parameter: the same type, a wider number,
the box of a number or what is in it, a class or interface above it, ``java.lang.Object``. The nearest candidate wins: least sum
of distances, then the class that is nearest to the receiver's, then the one declared first. An argument whose type is not known
(null) fits everywhere; what it decides nothing about is told apart: ``sure`` is false if candidates are left between which only
unknown types would tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators.lookup import linearised

# Numbers in the order in which each can stand for those behind it, and their boxes.
WIDER = {
    "byte": ["short", "int", "long", "float", "double"], "short": ["int", "long", "float", "double"], "char": ["int", "long", "float", "double"],
    "int": ["long", "float", "double"], "long": ["float", "double"], "float": ["double"],
}
BOXES = {
    "boolean": "java.lang.Boolean", "byte": "java.lang.Byte", "char": "java.lang.Character", "short": "java.lang.Short", "int": "java.lang.Integer",
    "long": "java.lang.Long", "float": "java.lang.Float", "double": "java.lang.Double",
}
#: Distances of boxing and of Object are beyond those of widening and of any class.
BOXED, OBJECT = 1000, 2000


def _numbers(spark: SparkSession) -> DataFrame:
    """(given, wanted, far) of numbers and boxes."""
    rows = [(a, b, k + 1) for a, wider in WIDER.items() for k, b in enumerate(wider)]
    rows += [x for a, b in BOXES.items() for x in ((a, b, BOXED), (b, a, BOXED))]
    values = ", ".join(f"('{a}', '{b}', {d})" for a, b, d in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(given, wanted, far)")


def candidates(asked: DataFrame, methods: DataFrame, closure: DataFrame) -> DataFrame:
    """asked (site_id, class_name, method, given) with each method of that name and number of parameters in the class or above it:
    owner, ordinal, wanted, away (how far the owner is)."""
    above = closure.select(F.col("name").alias("class_name"), F.col("ancestor").alias("owner"), F.col("rank.distance").alias("away"))
    rows = asked.withColumn("n", F.size("given")).join(above, "class_name", "left")
    own = rows.where("owner is null").withColumn("owner", F.col("class_name")).withColumn("away", F.lit(0))  # classes that no hierarchy names
    rows = rows.where("owner is not null").unionByName(own)
    taken = methods.select(F.col("class_name").alias("owner"), F.col("method_name").alias("method"), "ordinal", F.col("param_types").alias("wanted"), F.size("param_types").alias("n"))
    return rows.join(taken, ["owner", "method", "n"]).drop("n")


def choose(asked: DataFrame, methods: DataFrame, supers: DataFrame) -> DataFrame:
    """(site_id, owner, method, ordinal, far, sure) for each call of asked (site_id, class_name, method, given: types of its
    arguments, null where unknown) that a method of methods (class_name, method_name, ordinal, param_types) fits. ``supers`` has
    (name, super, ord)."""
    spark = asked.sparkSession
    closure = linearised(supers)
    every = candidates(asked, methods, closure)
    key = ["site_id", "owner", "method", "ordinal", "away"]
    pairs = every.select(*key, F.posexplode_outer(F.arrays_zip("given", "wanted")).alias("pos", "z"))
    pairs = pairs.select(*key, "pos", F.col("z.given").alias("given"), F.col("z.wanted").alias("wanted"))
    above = closure.select(F.col("name").alias("given"), F.col("ancestor").alias("wanted"), F.col("rank.distance").alias("up"))
    met = pairs.join(_numbers(spark), ["given", "wanted"], "left").join(above, ["given", "wanted"], "left")
    far = (
        F.when(F.col("pos").isNull() | F.col("given").isNull() | (F.col("given") == F.col("wanted")), 0)
        .when((F.col("wanted") == "java.lang.Object"), OBJECT)
        .otherwise(F.coalesce("far", "up"))
    )
    unknown = F.count_if(F.col("pos").isNotNull() & F.col("given").isNull())
    told = met.groupBy(*key).agg(F.bool_and(far.isNotNull()).alias("fits"), F.sum(far).alias("far"), unknown.alias("unknown"))
    fit = told.where("fits")
    best = fit.groupBy("site_id").agg(
        F.min(F.struct("far", "away", "ordinal", "owner", "method")).alias("best"), F.max("unknown").alias("unknown"), F.count("*").alias("n"),
        F.count_distinct("owner", "ordinal").alias("different"),
    )
    sure = (F.col("unknown") == 0) | (F.col("different") == 1)
    return best.select("site_id", "best.owner", "best.method", "best.ordinal", F.col("best.far").alias("far"), sure.alias("sure"))
