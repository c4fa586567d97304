"""Answer keys: reading them, and which entity each listed person is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.operators.resolution import LEAST, similar_names

FIELDS = ["person_type", "storyline", "name", "phone", "account", "handle"]


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """(person, person_type, storyline, name, phone, account, handle) of a key
    file {"entities": {person: {...}}}; what is missing is empty, and a missing
    type is background."""
    text = spark.read.option("wholetext", "true").text(path)
    shape = "struct<entities: map<string, struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ">>>"
    rows = text.select(F.explode(F.from_json("value", shape)["entities"]).alias("person", "x")).select("person", "x.*")
    return rows.na.fill({"person_type": "background"}).na.fill("", FIELDS[1:])


def _normal(name: str):
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")), " ")


def to_entities(key: DataFrame, mapping: DataFrame, named: DataFrame, least: float = LEAST) -> DataFrame:
    """(person, entity_id): the entities that a person's account, phone or handle
    belong to; for persons without any, that of their name or, failing it, of
    the names alike it. ``mapping`` has (identifier, entity_id), ``named`` (name,
    entity_id). Persons nobody knows have no row."""
    ids = key.select("person", F.explode(F.array("account", "phone", "handle")).alias("identifier")).where("identifier <> ''")
    found = ids.join(mapping, "identifier").select("person", "entity_id").distinct()
    left = key.join(found, "person", "left_anti").select("person", _normal("name").alias("name")).where("name <> ''")
    known = cut(named.select(_normal("name").alias("known"), "entity_id").where("known <> ''").distinct())
    exact = left.join(known, left.name == known.known).select("person", "entity_id")
    rest = cut(left.join(exact, "person", "left_anti"))
    # Names of the list meet those of the entities alone, which then all are cut.
    pairs = similar_names(rest.select("name").distinct(), least, known.select(F.col("known").alias("name")).distinct())
    alike = rest.join(pairs.toDF("name", "known"), "name").join(known, "known").select("person", "entity_id")
    return found.union(exact).union(alike).distinct()
