"""Synthetic event tables with planted behaviour, for end-to-end tests.

Everything is a projection of ``spark.range``: each value is a hash of the seed,
the person and the event's number, so a table is the same on every cluster.
People beyond the ``background`` ones follow a storyline; the last ``surprise``
ones are a hold-out set whose storylines stand alone instead of in groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORIES = ["structuring", "silence", "chain", "colocation", "dormant_flip", "fan_io", "post_burst"]
THRESHOLD = 10_000.0
START, DAYS = "2025-08-04 00:00:00", 150
#: Normal events a person: bank rows, calls, posts.
NORMAL = {"bank": 40, "cdr": 20, "social": 10}
KINDS = {"bank": "transaction", "cdr": "call", "social": "post"}

# Headers of each source's exports in three styles.
HEADERS = {
    "bank": ["txn_date debit/credit amount beneficiary branch_code account_holder account_id", "posted_at dr_cr value payee branch customer_name account_number",
             "transaction_date txn_type amount recipient_account branch_code account_name account_no"],
    "cdr": ["call_time msisdn remote_number tower_id duration_seconds subscriber_name", "start_time caller_msisdn callee cell_id length subscriber",
            "timestamp originating_number terminating_number tower duration_secs name"],
    "social": ["created_utc user_handle mentions geo_tag display_name", "post_time handle tagged_users location name", "timestamp username hashtags place full_name"],
}


def _uniform(seed: int, *keys: Column | str) -> Column:
    """0 to 1, from a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def people(spark: SparkSession, seed: int = 11, background: int = 90, per_story: int = 3, surprise: int = 12) -> DataFrame:
    """(entity_id, kind, surprise, lead, total): kind is null for background;
    lead is the first entity of a storyline's group."""
    planted = len(STORIES) * per_story
    total = background + planted + surprise
    i = F.col("entity_id")
    extra = F.when(i < background + planted, F.floor((i - background) / max(per_story, 1))).otherwise(i - background - planted)
    story = F.get(F.array(*map(F.lit, STORIES)), F.pmod(extra, F.lit(len(STORIES))).cast("int"))
    held = i >= background + planted
    lead = F.when(held | (i < background), i).otherwise(background + extra * per_story)
    rows = spark.range(total).withColumnRenamed("id", "entity_id")
    return rows.select("entity_id", F.when(i >= background, story).alias("kind"), held.alias("surprise"), lead.alias("lead"), F.lit(total).cast("long").alias("total"))


def _rows(who: DataFrame, n: int, source: str, seconds: Column, amount: Column | None = None, direction: Column | None = None, other: Column | None = None,
          place: Column | None = None, tag: str = "") -> DataFrame:
    """``n`` events for each person; expressions may use column ``k``."""
    null = F.lit(None)
    each = who.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.select(
        F.xxhash64("entity_id", "k", F.lit(source + tag)).alias("event_id"), "entity_id", F.lit(source).alias("source"), F.lit(KINDS[source]).alias("event_type"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(seconds).cast("decimal(18,6)"))).alias("timestamp"),
        (null if amount is None else F.round(amount, 2)).cast("double").alias("amount"), (null if other is None else other).cast("long").alias("counterparty_id"),
        (null if direction is None else direction).cast("string").alias("direction"), (null if place is None else place).cast("long").alias("location"), "kind",
    )


def events(who: DataFrame, seed: int = 11) -> DataFrame:
    """Event rows of ``people``: normal ones and those of their storylines."""
    me, total, k, day = F.col("entity_id"), F.col("total"), F.col("k"), 86400
    u = lambda tag: _uniform(seed, "entity_id", "k", F.lit(tag))
    near = F.pmod(me + 1 + F.floor(u("who") * 6), total)
    far = lambda step: F.pmod(me + 7 + step * k, total)
    whole = u("when") * DAYS * day
    side = F.when(u("side") < 0.4, "credit").otherwise("debit")
    home = F.pmod(me, F.lit(40))
    parts = [
        _rows(who, NORMAL["bank"], "bank", whole, F.exp(4 + 3 * u("much")), side, near, home),
        _rows(who, NORMAL["cdr"], "cdr", whole, other=near, place=home),
        _rows(who, NORMAL["social"], "social", whole, other=near, place=home),
    ]
    # Two storylines take normal events away.
    quiet = F.lit(START).cast("timestamp_ntz") + F.expr("INTERVAL 110 DAYS")
    late = F.col("timestamp") > quiet
    kind = F.coalesce("kind", F.lit(""))
    normal = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(~((kind == "silence") & late) & ~((kind == "dormant_flip") & ~late & (F.col("source") == "bank")))
    of = lambda story: who.where(F.col("kind") == story)
    meet = (30 + 3 * k) * day + F.pmod(F.col("lead"), F.lit(12)) * 3600
    shared = F.pmod(F.col("lead") * 3 + 1, total)
    hour = F.lit(3600)
    told = [
        _rows(of("structuring"), 12, "bank", (60 + 2 * k + u("s")) * day, THRESHOLD * (0.89 + 0.1 * u("band")), F.lit("credit"), far(3), tag="s"),
        _rows(of("silence"), 1, "bank", F.lit(110.0 * day - 60), F.lit(250_000.0), F.lit("debit"), near, tag="q"),
        _rows(of("chain"), 1, "bank", (70 * day + (me - F.col("lead")) * 6 * hour), 150_000 + 40_000 * u("c"), F.lit("debit"), F.pmod(me + 1, total), tag="c"),
        _rows(of("colocation"), 10, "cdr", meet + u("m") * 300, other=shared, place=F.pmod(F.col("lead"), F.lit(40)) + 100, tag="m"),
        _rows(of("colocation"), 10, "bank", meet + 300 + u("b") * 600, 500 + 400 * u("a"), F.lit("debit"), shared, tag="m"),
        _rows(of("dormant_flip"), 8, "bank", (120 + 3 * k) * day, 20_000 + 5_000 * u("d"), F.lit("credit"), far(2), tag="d"),
        _rows(of("fan_io"), 28, "bank", (50 + k / 3) * day, 2_000 + 900 * u("f"), F.when(k % 2 == 0, "credit").otherwise("debit"), far(4), tag="f"),
        _rows(of("post_burst"), 24, "social", (80 * day + k * hour), other=far(5), tag="p"),
    ]
    for rows in told:
        normal = normal.unionByName(rows)
    return normal.where("counterparty_id is null or counterparty_id <> entity_id").drop("kind")


def truth(who: DataFrame, surprise: bool | None = False) -> DataFrame:
    """(entity_id, kind) of planted people; the hold-out set, the rest, or all."""
    rows = who.where("kind is not null")
    return (rows if surprise is None else rows.where(F.col("surprise") == surprise)).select("entity_id", "kind")


def _identifier(c: str, source: str) -> Column:
    """How a source names a person."""
    digits = F.lpad(F.col(c).cast("string"), 7, "0")
    made = {"bank": F.concat(F.lit("ACCT"), digits), "cdr": F.concat(F.lit("639"), F.lpad(F.col(c).cast("string"), 9, "0")), "social": F.concat(F.lit("@user."), F.lpad(F.col(c).cast("string"), 4, "0"))}
    return F.when(F.col(c).isNotNull(), made[source])


def person_name(c: str) -> Column:
    """A two-word name, far from every other person's."""
    spelt = F.sha2(F.col(c).cast("string"), 256)
    return F.concat(F.translate(spelt.substr(1, 8), "0123456789", "ghijklmnop"), F.lit(" "), F.translate(spelt.substr(9, 8), "0123456789", "qrstuvwxyz"))


def exports(rows: DataFrame, style: int = 0) -> dict[str, DataFrame]:
    """The events of each source as its system would export them, under one of
    three header styles, with text in every column and one column of noise."""
    at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    length = (30 + F.pmod(F.xxhash64("event_id"), F.lit(600))).cast("string")
    columns = {
        "bank": [at, F.col("direction"), F.col("amount").cast("decimal(18,2)").cast("string"), _identifier("counterparty_id", "bank"), F.concat(F.lit("BRANCH"), F.lpad(F.col("location").cast("string"), 2, "0")), person_name("entity_id"), _identifier("entity_id", "bank")],
        "cdr": [at, _identifier("entity_id", "cdr"), _identifier("counterparty_id", "cdr"), F.concat(F.lit("T"), F.lpad(F.col("location").cast("string"), 3, "0")), length, person_name("entity_id")],
        "social": [at, _identifier("entity_id", "social"), _identifier("counterparty_id", "social"), F.concat(F.lit("T"), F.lpad(F.col("location").cast("string"), 3, "0")), person_name("entity_id")],
    }
    made = {}
    for source, cells in columns.items():
        names = HEADERS[source][style].split()
        noise = F.hex(F.xxhash64("event_id")).alias(("batch_id", "device", "notes")[style])
        made[source] = rows.where(F.col("source") == source).select(*(c.alias(n) for c, n in zip(cells, names, strict=True)), noise)
    return made
