"""Entity resolution: which identifiers belong to one actor.

An identifier always means the same entity. Names are joined where they are alike
or where one identifier goes by both; identifiers of such a person of different
sources are one entity, with at most one identifier a source. Within a person,
identifiers known to several sources take a place each; the k-th identifier of one
source alone (by hash cell, then id) takes the k-th place that no other of its
source holds. That rule does not depend on the order of rows.

Alike names (``LEAST`` by sorted tokens) are found without comparing all pairs:
two names whose indel distance is at most d share one of d + 1 segments, so
names meet only on equal segments near the same place, then are measured. Keys
grow with the names; what meets on a key by chance, with their square.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.lineage import cut
from tidewatch.functions.similarity import ratio

LEAST = 88.0
#: Places at which identifiers of one name and source are numbered side by side.
CELLS = 64


def _allowed(least: float, shorter: str, longer: str) -> str:
    """SQL: the largest indel distance of two lengths at ``least`` percent."""
    return f"cast(floor({1 - least / 100:.6f} * ({shorter} + {longer}) + 1e-9) as int)"


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _lengths(names: DataFrame) -> DataFrame:
    """(size, n, total, mids) for each length of the names (``name``, ``size``):
    how many there are, and where the middle of each place lies on a scale of
    bits. A place has -log2 of the chance that two names agree there, and a
    little more, so that places at which all agree are cut as well."""
    letters = names.select("size", F.posexplode(F.split("name", "")).alias("at", "letter")).groupBy("size", "at", "letter").agg(F.count("*").alias("k"))
    places = letters.groupBy("size", "at").agg(F.sum("k").alias("n"), (0.01 + 2 * F.log2(F.sum("k")) - F.log2(F.sum(F.col("k").cast("double") * F.col("k")))).alias("bits"))
    upto = places.withColumn("upto", F.sum("bits").over(Window.partitionBy("size").orderBy("at")))
    listed = upto.groupBy("size").agg(F.max("n").alias("n"), F.max("upto").alias("total"), F.array_sort(F.collect_list(F.struct("at", (F.col("upto") - F.col("bits") / 2).alias("mid")))).alias("x"))
    return listed.select("size", "n", "total", F.col("x.mid").alias("mids"))


def _windows(lengths: DataFrame, least: float, longer: bool, apart: bool = False) -> DataFrame:
    """(size, cut, e, i, start, width, d): the places of names of ``size`` that are
    keys, either their own segments or, of the ``longer``, the stretches at which
    the i-th of e + 1 segments of a name of length ``cut`` may stand; ``d`` is the
    largest indel distance of the two lengths. Of two lengths the more frequent one
    is cut, for which fewer keys are made; two ``apart`` sets have sides by ``cuts``."""
    # Without counts the longer is cut, and evenly.
    known = lengths if "mids" in lengths.columns else lengths.select("size", F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(None).cast("array<double>").alias("mids"))
    sides = [known.where("cuts"), known.where("not cuts")] if apart else [known, known]
    cut_, other = sides[0].select(F.col("size").alias("cut"), F.col("n").alias("nc"), "total", "mids"), sides[1].select(F.col("size").alias("p"), F.col("n").alias("np"))
    t, own = _allowed(least, "cut", "p"), _allowed(least, "cut", "cut")
    # Indels change the summed length by one each: its parity is that of their number.
    met = cut_.crossJoin(other).withColumn("d", F.expr(f"{t} - pmod(cut + p - {t}, 2)")).where("d >= abs(cut - p)")
    if not apart:
        met = met.where("struct(nc, cut) >= struct(np, p)")
    # As many segments as its own length needs serve the smaller distances too.
    met = met.withColumn("e", F.expr(f"greatest(d, {own} - pmod({own}, 2))"))
    bound = "CASE WHEN j = 0 THEN 0 WHEN j > e THEN cut WHEN mids IS NULL THEN cast(floor(j * cut / (e + 1)) as int) ELSE size(filter(mids, x -> x < j * total / (e + 1))) END"
    met = met.withColumn("at", F.expr(f"transform(sequence(0, e + 1), j -> {bound})"))
    if not longer:
        each = met.select("cut", "e", "at").distinct().select("cut", "e", "at", F.explode(F.expr("sequence(0, e)")).alias("i"))
        return each.selectExpr("cut AS size", "cut", "e", "i", "at[i] AS start", "at[i + 1] - at[i] AS width")
    shifted = met.select("p", "cut", "d", "e", "at", F.explode(F.expr("sequence(0, d)")).alias("i")).select("*", F.explode(F.expr("sequence(-i, i, 2)")).alias("x"))
    reached = shifted.where("abs(p - cut - x) <= d - i and at[i] + x >= 0 and at[i + 1] + x <= p")
    # An empty segment is met once, wherever it stands.
    return reached.selectExpr("p AS size", "cut", "e", "i", "if(at[i + 1] > at[i], at[i] + x, 0) AS start", "at[i + 1] - at[i] AS width", "d").distinct()


def _keys(names: DataFrame, lengths: DataFrame, least: float, longer: bool, apart: bool = False) -> DataFrame:
    """(key, ...) for each window of each name, with the names' other columns."""
    kept = [c for c in names.columns if c not in ("name", "size")] + ["d"] * longer
    tried = names.join(F.broadcast(_windows(lengths, least, longer, apart)), "size")
    return tried.select(F.expr("xxhash64(cut, e, i, substr(name, start + 1, width))").alias("key"), *kept)


def similar_names(names: DataFrame, least: float = LEAST, to: DataFrame | None = None) -> DataFrame:
    """(a, b) of different normal names that are alike; ``names`` has ``name``,
    each once. Every such pair comes once, shorter name first. With ``to``, other
    names, all pairs of one of ``names``, a, and one of ``to``, b.

    Of d + 1 segments or more under d indels some i-th is whole with exactly i indels
    before it: take the last that has at least as many before it. It stands in the
    other name shifted by -i, -i + 2, ... or i, and the rest allows d - i at most.
    Segments hold about equal shares of what tells names apart. Each indel turns one
    bit of ``sig``, the numbers of the letters in Gray code, two bits a letter.
    Keys travel with numbers; only for what is left are names looked up.
    """
    odd = "cast((shiftrightunsigned(x, {0}) ^ shiftrightunsigned(x, {0} + 32)) & 1 as int)".format("ascii(c) % 32")
    sig = F.expr(f"aggregate(split(name, ''), 0L, (x, c) -> x ^ shiftleft(1L, ascii(c) % 32 + 32 * {odd}))")
    both = names.select("name", F.lit(False).alias("cuts"))
    both = both.union(to.select("name", F.lit(True).alias("cuts"))) if to is not None else both
    sized = cut(both.where("name <> ''").select(F.monotonically_increasing_id().alias("id"), "name", "cuts", F.length("name").alias("size"), sig.alias("sig")))
    if to is None:
        one = two = sized.drop("cuts")
        lengths = cut(_lengths(one))
    else:
        one, two = sized.where("cuts").drop("cuts"), sized.where("not cuts").drop("cuts")
        lengths = cut(_lengths(one).withColumn("cuts", F.lit(True)).union(_lengths(two).withColumn("cuts", F.lit(False))))
    one = _keys(one, lengths, least, False, to is not None).toDF("key", "a", "sa")
    two = _keys(two, lengths, least, True, to is not None).toDF("key", "b", "sb", "d")
    # Merged, as the planner takes exploded rows for no larger than the names.
    met = two.hint("merge").join(one, "key").where("bit_count(sa ^ sb) <= d and a <> b")
    pairs = (met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d") if to is None else met.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct()
    told = pairs.join(sized.select(F.col("id").alias("a"), F.col("name").alias("na")), "a").join(sized.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
    near = told.where(F.expr("levenshtein(na, nb, d) >= 0")).select("na", "nb")
    turned = "length(na) > length(nb) or length(na) = length(nb) and na > nb" if to is None else "false"
    return near.selectExpr(f"if({turned}, nb, na) AS a", f"if({turned}, na, nb) AS b").where(_ratio("a", "b") >= least)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, cluster): the smallest name reachable. Smallest labels spread over
    edges and jump to their label's label, until none changes."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = cut(both.select(F.col("a").alias("name")).distinct().withColumn("cluster", F.col("name")))
    while True:
        near = both.join(linked, both.b == linked.name).groupBy("a").agg(F.min("cluster").alias("near"))
        spread = linked.join(near, linked.name == near.a).select("name", F.col("cluster").alias("was"), F.least("cluster", "near").alias("cluster"))
        leap = spread.select(F.col("name").alias("cluster"), F.col("cluster").alias("further"))
        after = cut(spread.join(leap, "cluster").select("name", "was", F.least("cluster", "further").alias("cluster")))
        if after.where("was <> cluster").isEmpty():
            break
        linked = after.select("name", "cluster")
    return nodes.select("name").join(linked, "name", "left").select("name", F.coalesce("cluster", "name").alias("cluster"))


def _numbered(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with ``nth`` from 1 in each group, by hash cell, then identifier."""
    celled = rows.withColumn("cell", F.pmod(F.xxhash64("identifier"), F.lit(CELLS)))
    counts = celled.groupBy(*group, "cell").agg(F.count("*").alias("k"))
    below = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "cell", F.coalesce(F.sum("k").over(below), F.lit(0)).alias("below"))
    own = F.row_number().over(Window.partitionBy(*group, "cell").orderBy("identifier"))
    return celled.withColumn("own", own).join(offsets, [*group, "cell"]).withColumn("nth", F.col("below") + F.col("own")).drop("cell", "own", "below")


def persons(named: DataFrame, least: float = LEAST) -> DataFrame:
    """(identifier, person) over the distinct (identifier, name): components of the
    graph of identifiers and alike names, under the smallest of a component's names."""
    names = named.select("name").distinct()
    of = cut(named.join(components(names, similar_names(names, least)), "name").select("identifier", "cluster").distinct())
    home = of.groupBy("identifier").agg(F.min("cluster").alias("home"))
    # Who goes by names of several clusters joins them.
    bridges = cut(of.join(home, "identifier").where("cluster <> home").select(F.col("home").alias("a"), F.col("cluster").alias("b")).distinct())
    if bridges.isEmpty():
        return home.withColumnRenamed("home", "person")
    joined = components(of.select(F.col("cluster").alias("name")).distinct(), bridges)
    return home.join(joined.select(F.col("name").alias("home"), F.col("cluster").alias("person")), "home").select("identifier", "person")


def resolve(events: DataFrame, least: float = LEAST) -> DataFrame:
    """(identifier, entity_id) for each actor of ``events`` (actor_raw,
    actor_name, source). An entity is named after its smallest identifier. Without
    a name an identifier stands alone; null identifiers have no entity; a null
    source is one of its own."""
    normal = F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim("actor_name")), r"\s+"), lambda w: w != "")), " ")
    known = events.where("actor_raw is not null")
    told = cut(known.select(F.col("actor_raw").alias("identifier"), F.coalesce(normal, F.lit("")).alias("name"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    person = persons(told.where("name <> ''").select("identifier", "name").distinct(), least)
    sources = told.groupBy("identifier").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    placed = cut(sources.join(person, "identifier", "left"))
    several = cut(_numbered(placed.where("person is not null and size(sources) > 1"), ["person"]))
    single = _numbered(placed.where("person is not null and size(sources) = 1").withColumn("source", F.col("sources")[0]), ["person", "source"])
    # Places that an identifier of several sources leaves open to another source.
    sides = single.select("person", "source").distinct()
    left = several.join(sides, "person").where(~F.array_contains("sources", F.col("source"))).select("person", "source", F.col("nth").alias("open"))
    left = cut(left.withColumn("nth", F.row_number().over(Window.partitionBy("person", "source").orderBy("open"))))
    taken = several.groupBy("person").agg(F.count("*").alias("taken"))
    opened = left.groupBy("person", "source").agg(F.count("*").alias("opened"))
    met = single.join(left, ["person", "source", "nth"], "left").join(taken, "person", "left").join(opened, ["person", "source"], "left")
    behind = F.coalesce("taken", F.lit(0)) + F.col("nth") - F.coalesce("opened", F.lit(0))
    rows = cut(met.select("identifier", "person", F.coalesce("open", behind).alias("place")).unionByName(several.select("identifier", "person", F.col("nth").alias("place"))))
    firsts = rows.groupBy("person", "place").agg(F.min("identifier").alias("first"))
    found = rows.join(firsts, ["person", "place"]).select("identifier", "first")
    alone = placed.where("person is null").select("identifier", F.col("identifier").alias("first"))
    return found.union(alone).select("identifier", F.concat(F.lit("E:"), "first").alias("entity_id"))


def apply(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """``events`` with entity_id and counterparty_id; a counterparty that is no
    actor stays null."""
    actor = mapping.withColumnRenamed("identifier", "actor_raw")
    other = mapping.select(F.col("identifier").alias("counterparty_id_raw"), F.col("entity_id").alias("counterparty_id"))
    return events.join(actor, "actor_raw", "left").join(other, "counterparty_id_raw", "left")


def cross_source(resolved: DataFrame) -> DataFrame:
    """One row (n_entities, n_cross_source)."""
    per = resolved.where("entity_id is not null").groupBy("entity_id").agg(F.count_distinct("source").alias("k"))
    return per.agg(F.count("*").alias("n_entities"), F.count_if(F.col("k") > 1).alias("n_cross_source"))
