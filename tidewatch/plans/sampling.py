"""Samples for evaluation that keep every kind of labelled case.

Every choice takes the lowest by a digest of an identifier, so the sample is the
same however the rows are dealt, and quotas are exact: of each group tasks keep no
more candidates than the quota, and only those meet. The quotas are the feature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut

#: Cells of digests by which accounts are counted up to the target.
CELLS = 4096


@dataclass(frozen=True)
class Quotas:
    """Accounts of each kind of case, rows of an account, rows in which a chosen
    account is the other party, sent rows from which an account may be background,
    and rows to stop at (the last account counts whole)."""

    per_kind: int = 40
    rows: int = 150
    context: int = 20
    active: int = 30
    total: int = 150_000


def digest(c: Column) -> Column:
    return F.md5(c.cast("string"))


def _lowest(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, picked in the map tasks already."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most)


def chosen_accounts(rows: DataFrame, sent: DataFrame, q: Quotas) -> DataFrame:
    """(account, kind): of each kind the accounts that sent most rows; one that has
    several kinds counts for each and is listed once, under the least."""
    cases = rows.where("labelled").select("account", "kind").distinct().join(sent, "account")
    return _lowest(cases, "kind", [F.desc("sent"), digest(F.col("account"))], q.per_kind).groupBy("account").agg(F.min("kind").alias("kind"))


def background(sent: DataFrame, chosen: DataFrame, room: int, q: Quotas) -> DataFrame:
    """(account): active accounts in the order of their digests until their rows,
    at most ``q.rows`` each, fill the room."""
    place = digest(F.col("account"))
    cell = F.conv(F.substring(place, 1, 3), 16, 10).cast("int")
    pool = sent.where(F.col("sent") >= q.active).join(chosen.select("account"), "account", "left_anti")
    pool = cut(pool.select("account", place.alias("place"), cell.alias("cell"), F.least("sent", F.lit(q.rows)).alias("n")))
    counts = {r["cell"]: r["n"] for r in pool.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most CELLS rows
    before, last, start = 0, -1, 0
    for c in range(CELLS):
        if before >= room:
            break
        last, start = c, before
        before += counts.get(c, 0)
    # Only the cell in which the room runs out is counted account by account.
    upto = F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    edge = pool.where(F.col("cell") == last).withColumn("upto", F.coalesce(upto, F.lit(0)) + F.lit(start)).where(F.col("upto") < room)
    return pool.where(F.col("cell") < last).select("account").unionByName(edge.select("account"))


def stratified(rows: DataFrame, q: Quotas = Quotas()) -> DataFrame:
    """(event_id, part) over ``rows(event_id, account, other, kind, labelled)``.

    ``part`` is case (labelled rows of chosen accounts, all of them), own (further
    rows that they sent, up to ``q.rows`` with the cases), context (rows sent to
    them by others), or background. An event has the first part that it has. Null
    labels are none; rows without an account are context at most.
    """
    rows = cut(rows.select("event_id", "account", "other", "kind", F.coalesce("labelled", F.lit(False)).alias("labelled")))
    sent = cut(rows.where("account is not null").groupBy("account").agg(F.count("*").alias("sent")))
    chosen = cut(chosen_accounts(rows, sent, q))
    mine = rows.join(chosen.select("account"), "account", "left_semi")
    cases = mine.where("labelled").select("event_id", "account")
    held = cases.groupBy("account").agg(F.count("*").alias("cases"))
    by_event = [digest(F.col("event_id"))]
    more = _lowest(mine.where("not labelled").select("event_id", "account"), "account", by_event, q.rows).join(held, "account", "left")
    own = more.where(F.col("nth") <= q.rows - F.coalesce("cases", F.lit(0)))
    met = rows.where("account is null or account <> other").join(chosen.select(F.col("account").alias("other")), "other", "left_semi")
    context = _lowest(met.select("event_id", "other"), "other", by_event, q.context)
    parts = [cases.select("event_id", F.lit(0).alias("at")), own.select("event_id", F.lit(1).alias("at")), context.select("event_id", F.lit(2).alias("at"))]
    core = cut(parts[0].union(parts[1]).union(parts[2]).groupBy("event_id").agg(F.min("at").alias("at")))
    others = background(sent, chosen, q.total - core.count(), q)
    pad = _lowest(rows.join(others, "account", "left_semi").select("event_id", "account"), "account", by_event, q.rows).select("event_id", F.lit(3).alias("at"))
    every = core.union(pad).groupBy("event_id").agg(F.min("at").alias("at"))
    return every.select("event_id", F.element_at(F.array(*map(F.lit, ("case", "own", "context", "background"))), F.col("at") + 1).alias("part"))


def stratified_sql(rows: str, q: Quotas) -> str:
    """DuckDB SQL of ``stratified`` over a CTE list that ends with ``rw`` (event_id,
    account, other, kind, labelled)."""
    first = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY {1}) <= {2}"
    return f"""WITH {rows}, se AS (SELECT account, count(*) AS sent FROM rw WHERE account IS NOT NULL GROUP BY 1),
ch AS (SELECT DISTINCT account FROM (SELECT * FROM (SELECT DISTINCT account, kind FROM rw WHERE labelled) JOIN se USING (account)
  {first.format("kind", "sent DESC, md5(account::VARCHAR)", q.per_kind)})),
ca AS (SELECT event_id, account FROM rw JOIN ch USING (account) WHERE labelled), hc AS (SELECT account, count(*) AS cases FROM ca GROUP BY 1),
ow AS (SELECT event_id FROM rw JOIN ch USING (account) LEFT JOIN hc USING (account) WHERE NOT coalesce(labelled, false)
  QUALIFY row_number() OVER (PARTITION BY account ORDER BY md5(event_id::VARCHAR)) <= {q.rows} - coalesce(cases, 0)),
cx AS (SELECT event_id FROM rw WHERE (account IS NULL OR account <> other) AND other IN (SELECT account FROM ch) {first.format("other", "md5(event_id::VARCHAR)", q.context)}),
co AS (SELECT event_id, min(pl) AS pl FROM (SELECT event_id, 0 AS pl FROM ca UNION ALL SELECT event_id, 1 FROM ow UNION ALL SELECT event_id, 2 FROM cx) GROUP BY 1),
po AS (SELECT account, coalesce(sum(least(sent, {q.rows})) OVER (ORDER BY md5(account::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
  FROM se WHERE sent >= {q.active} AND account NOT IN (SELECT account FROM ch)),
pa AS (SELECT event_id FROM rw JOIN po USING (account) WHERE upto < {q.total} - (SELECT count(*) FROM co) {first.format("account", "md5(event_id::VARCHAR)", q.rows)})
SELECT event_id, ['case', 'own', 'context', 'background'][min(pl) + 1] AS part FROM (SELECT event_id, pl FROM co UNION ALL SELECT event_id, 3 FROM pa) GROUP BY event_id"""
