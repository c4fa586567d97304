"""Registered queries for the scoring operators, fusion and reports, each with
DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut
from tidewatch.functions.scaling import rounded
from tidewatch.operators import charts, digits, evaluation, features, fusion, graph, insights, meta, outliers, rules, temporal, temporal_graph
from tidewatch.sources.views import EVENTS_SQL, LEDGER_SQL, ORDERS_SQL, events_view, ledger_view, orders_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Our thresholds for the stream table, whose amounts end near 500.
EV = {"threshold": 400.0, "tolerance": 60, "chain_amount": 50.0}


def _model(name: str, view: Query, op: Callable[[DataFrame], DataFrame], digits_: int = 6) -> None:
    QUERIES[name] = lambda spark, sf: rounded(op(view(spark, sf)), digits_)


def _sql(view: str, body: str, digits_: int = 6) -> str:
    return f"WITH {view}, {body} SELECT entity_id, round(score, {digits_}) AS score FROM scored"


SCOREMIN = (
    "scored AS (SELECT entity_id, pow((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9), 2) AS score FROM raws)"
)
OVER_MAX = "scored AS (SELECT entity_id, raw / m AS score FROM (SELECT *, max(raw) OVER () AS m FROM raws) WHERE m > 0)"

# --- features -------------------------------------------------------------
_FEATURE_SQL = """gaps AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id)) / 1e6 AS gap,
  hour(timestamp) AS hr FROM {v} WHERE entity_id IS NOT NULL),
ent AS (SELECT entity_id, -sum(k * 1.0 / n * ln(k * 1.0 / n + 1e-9)) AS hour_entropy FROM
  (SELECT entity_id, hr, count(*)::DOUBLE AS k, sum(count(*)) OVER (PARTITION BY entity_id)::DOUBLE AS n FROM gaps GROUP BY 1, 2) GROUP BY 1),
feat AS (SELECT g.entity_id, count(*)::DOUBLE AS n_events, count(*) FILTER (event_type = 'call')::DOUBLE AS n_calls,
  count(*) FILTER (event_type = 'transaction')::DOUBLE AS n_txns, count(*) FILTER (event_type = 'post')::DOUBLE AS n_posts,
  count(*) FILTER (event_type = 'credit')::DOUBLE AS n_credit, count(*) FILTER (event_type = 'debit')::DOUBLE AS n_debit,
  coalesce(sum(amount) FILTER (amount > 0), 0) AS amt_total, coalesce(avg(amount) FILTER (amount > 0), 0) AS amt_mean,
  coalesce(max(amount) FILTER (amount > 0), 0) AS amt_max, coalesce(stddev_samp(amount) FILTER (amount > 0), 0) AS amt_std,
  count(DISTINCT CASE WHEN coalesce(direction, '') <> 'credit' THEN counterparty_id END)::DOUBLE AS fan_out,
  count(DISTINCT CASE WHEN direction = 'credit' THEN counterparty_id END)::DOUBLE AS fan_in,
  coalesce(max(gap), 0) AS gap_max, coalesce(min(gap), 0) AS gap_min, coalesce(stddev_samp(gap), 0) AS gap_std,
  any_value(hour_entropy) AS hour_entropy,
  count(*) FILTER (hr >= 22 OR hr <= 5)::DOUBLE / count(*) AS night_ratio, count(*) FILTER (isodow(timestamp) >= 6)::DOUBLE / count(*) AS weekend_ratio
  FROM gaps g JOIN ent USING (entity_id) GROUP BY g.entity_id)"""


#: Means of cents often end in a 5 that rounds either way after a sum in another order.
_DIGITS = dict.fromkeys(features.FEATURES, 3) | {"amt_mean": 8}


def _features(view: Query) -> Query:
    return lambda spark, sf: features.build_features(view(spark, sf)).select("entity_id", *((F.round(c, k) + 0.0).alias(c) for c, k in _DIGITS.items()))


for _name, _view, _sql_view, _alias in (("features_events", events_view, EVENTS_SQL, "ev"), ("features_ledger", ledger_view, LEDGER_SQL, "lg")):
    QUERIES[_name] = _features(_view)
    ORACLE[_name] = f"WITH {_sql_view}, {_FEATURE_SQL.format(v=_alias)} SELECT entity_id, " + ", ".join(
        f"round({c}, {k}) + 0.0 AS {c}" for c, k in _DIGITS.items()
    ) + " FROM feat"

# --- time -----------------------------------------------------------------
_model("time_correlation", events_view, lambda e: temporal.time_correlation(e, EV["tolerance"]))
_model("time_correlation_backward", events_view, lambda e: temporal.time_correlation_backward(e, EV["tolerance"]))
_model("time_correlation_same_entity", events_view, lambda e: temporal.time_correlation(e, 1440, same_entity=True))


def _asof_sql(first: str, second: str, txn: str, minutes: int, part: str = "") -> str:
    return _sql(EVENTS_SQL, f"""u AS (SELECT *, 0 AS side FROM ev WHERE {first} AND counterparty_id IS NOT NULL
  UNION ALL SELECT *, 1 AS side FROM ev WHERE {second} AND counterparty_id IS NOT NULL),
m AS (SELECT *, first_value(CASE WHEN side = 1 THEN {{'t': timestamp, 'i': event_id, 'c': counterparty_id}} END IGNORE NULLS)
  OVER ({part} ORDER BY timestamp, side, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM u),
scored AS (SELECT entity_id, least(count(DISTINCT {txn}) / 3.0::DOUBLE, 1.0::DOUBLE) AS score FROM m
  WHERE side = 0 AND x IS NOT NULL AND epoch_us(x.t) - epoch_us(timestamp) <= {minutes * 60_000_000} AND x.c = counterparty_id GROUP BY 1)""")


ORACLE["time_correlation"] = _asof_sql("source <> 'bank'", "source = 'bank'", "x.i", EV["tolerance"])
ORACLE["time_correlation_backward"] = _asof_sql("source = 'bank'", "source <> 'bank'", "event_id", EV["tolerance"])
ORACLE["time_correlation_same_entity"] = _asof_sql("source <> 'bank'", "source = 'bank'", "x.i", 1440, "PARTITION BY entity_id")

_model("time_correlation_anypair", events_view, lambda e: temporal.time_correlation_anypair(e, 1440, 1))
ORACLE["time_correlation_anypair"] = _sql(EVENTS_SQL, """scored AS (SELECT a.entity_id, least(count(*)::DOUBLE, 1.0) AS score FROM ev a JOIN ev b
  ON a.entity_id = b.entity_id AND a.counterparty_id = b.counterparty_id AND a.source <> 'bank' AND b.source = 'bank'
  AND abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) <= 86400000000 GROUP BY 1 HAVING count(*) >= 1)""")

_model("time_velocity", events_view, temporal.time_velocity)
ORACLE["time_velocity"] = _sql(EVENTS_SQL, f"""p AS (SELECT entity_id, count(DISTINCT counterparty_id) AS n, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400e6 AS d
  FROM ev WHERE counterparty_id IS NOT NULL GROUP BY 1), raws AS (SELECT entity_id, n / CASE WHEN d > 0 THEN d ELSE 1 / 24.0::DOUBLE END AS raw FROM p), {SCOREMIN}""")

_BURST = """b AS (SELECT entity_id, max(n) AS burst FROM (SELECT a.entity_id, a.event_id, count(DISTINCT b.counterparty_id) AS n FROM ev a JOIN ev b
  ON a.entity_id = b.entity_id AND abs(epoch_us(a.timestamp) - epoch_us(b.timestamp)) <= {h} * 3600000000 WHERE a.counterparty_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
_model("burst", events_view, temporal.burst)
ORACLE["burst"] = _sql(EVENTS_SQL, _BURST.format(h=36) + """, q AS (SELECT quantile_cont(burst, 0.7) AS lo, quantile_cont(burst, 0.98) AS hi FROM b),
scored AS (SELECT entity_id, greatest(0.0, least(1.0, (burst - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END)) AS score FROM b, q)""")

# --- graph ----------------------------------------------------------------
_EDGES = "e AS (SELECT entity_id AS src, counterparty_id AS dst, count(*) AS w FROM {v} WHERE entity_id IS NOT NULL AND counterparty_id IS NOT NULL GROUP BY 1, 2)"
_FIT = _EDGES + """, xy AS (SELECT src AS entity_id, ln(count(*)::DOUBLE) AS x, ln(1 + sum(w)::DOUBLE) AS y FROM e GROUP BY 1),
f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM xy),
r AS (SELECT entity_id, y - (s * x + i) AS resid FROM xy, f WHERE n >= 8)"""
for _tag, _view, _sql_view, _alias in (("", events_view, EVENTS_SQL, "ev"), ("_ledger", ledger_view, LEDGER_SQL, "lg")):
    _model(f"network_oddball{_tag}", _view, graph.oddball)
    ORACLE[f"network_oddball{_tag}"] = _sql(_sql_view, _FIT.format(v=_alias) + f""", raws AS (SELECT entity_id, abs(resid / CASE WHEN sd > 0 THEN sd ELSE 1 END) AS raw
  FROM (SELECT *, stddev_pop(resid) OVER () AS sd FROM r)), {SCOREMIN}""")
    _model(f"oddball_signed{_tag}", _view, graph.oddball_signed)
    ORACLE[f"oddball_signed{_tag}"] = _sql(_sql_view, _FIT.format(v=_alias) + f", raws AS (SELECT entity_id, resid AS raw FROM r), {SCOREMIN}")
_model("degree_deviation", events_view, graph.degree_deviation)
ORACLE["degree_deviation"] = _sql(EVENTS_SQL, f"""d AS (SELECT entity_id, count(DISTINCT counterparty_id) AS d FROM ev WHERE counterparty_id IS NOT NULL GROUP BY 1),
s AS (SELECT avg(d) AS m, stddev_samp(d) AS s, count(DISTINCT d) AS k FROM d),
raws AS (SELECT entity_id, abs((d - m) / (s + 1e-9)) AS raw FROM d, s WHERE k >= 3), {SCOREMIN}""")
_IN_OUT = """io AS (SELECT entity_id, count(DISTINCT CASE WHEN {out} THEN counterparty_id END) AS o,
  count(DISTINCT CASE WHEN direction = 'credit' THEN counterparty_id END) AS i, count(DISTINCT counterparty_id) AS d,
  count(*) FILTER (direction IN ('credit', 'debit')) AS sided FROM {v} WHERE counterparty_id IS NOT NULL GROUP BY 1)"""
_model("reciprocity", ledger_view, graph.reciprocity)
ORACLE["reciprocity"] = _sql(LEDGER_SQL, _IN_OUT.format(out="coalesce(direction, 'out') <> 'credit'", v="lg") + f", raws AS (SELECT entity_id, ln(1 + (o * i)::DOUBLE) AS raw FROM io), {OVER_MAX}")
_model("scatter_gather", ledger_view, graph.scatter_gather)
ORACLE["scatter_gather"] = _sql(LEDGER_SQL, _IN_OUT.format(out="direction = 'debit'", v="lg") + f", raws AS (SELECT entity_id, o * i / (d + 1e-9) AS raw FROM io WHERE sided > 0), {OVER_MAX}")

_ROUNDS = 30  # of the SQL, which has no tolerance to stop at
_model("pagerank_deviation", events_view, graph.pagerank_deviation, 4)


def _pagerank_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT v.node, 0.15 / n.n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r.rank), 0) FROM r{i} r WHERE r.node NOT IN (SELECT src FROM e)) / n.n) AS rank
  FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(r.rank * p) AS got FROM sh JOIN r{i} r ON r.node = sh.src GROUP BY 1) g ON g.dst = v.node)""")
    return f"""{_EDGES.format(v="ev")}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v),
sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src)::DOUBLE AS p FROM e), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, n), {", ".join(steps)},
dg AS (SELECT node, count(*) AS deg FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), m AS (SELECT count(*) AS m FROM e),
raws AS (SELECT node AS entity_id, greatest(0.0::DOUBLE, rank - (deg + 1) / (m + 1)::DOUBLE) AS raw FROM r{rounds} JOIN dg USING (node), m WHERE node IN (SELECT src FROM e)), {SCOREMIN}"""


ORACLE["pagerank_deviation"] = _sql(EVENTS_SQL, _pagerank_sql(_ROUNDS), 4)


_model("community_motif", events_view, graph.community_motif)
_model("network_tgn", events_view, temporal_graph.network_tgn)


def _labels_sql(rounds: int) -> str:
    steps = "".join(
        f""", l{i + 1} AS MATERIALIZED (SELECT a AS node, label FROM (SELECT a, label, count(*) AS n FROM bo JOIN l{i} ON node = b GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, label) = 1)""" for i in range(rounds)
    )
    return f"""WITH {EVENTS_SQL}, {_EDGES.format(v="ev")}, bo AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a <> b),
l0 AS (SELECT DISTINCT a AS node, a AS label FROM bo){steps} SELECT node, label FROM l{rounds}"""


QUERIES["spread_labels"] = lambda spark, sf: graph.spread_labels(graph.edges(events_view(spark, sf)))
ORACLE["spread_labels"] = _labels_sql(5)

# --- digits ---------------------------------------------------------------
_DIGIT = "d AS (SELECT entity_id, {digit} AS g FROM lg WHERE amount > 0 {and_})"
_FIRST = "greatest(1, least(9, floor(amount / pow(10.0::DOUBLE, floor(log10(amount))) + 1e-9)))::INT"
_SECOND = "(floor(amount / pow(10.0::DOUBLE, floor(log10(amount)) - 1) + 1e-9)::BIGINT % 10)::INT"


def _cells(digit: str, and_: str, low: int, least: int, more: str = "") -> str:
    return _DIGIT.format(digit=digit, and_=and_) + f""", n AS (SELECT entity_id, count(*) AS n FROM d GROUP BY 1), a AS (SELECT count(*) AS n FROM d),
q AS (SELECT x.g, coalesce(t.k, 0) / a.n::DOUBLE AS q FROM range({low}, 10) x(g) LEFT JOIN (SELECT g, count(*) AS k FROM d GROUP BY 1) t ON t.g = x.g, a),
p AS (SELECT n.entity_id, q.g, coalesce(c.k, 0) / n.n::DOUBLE AS p, q.q FROM n CROSS JOIN q CROSS JOIN a LEFT JOIN (SELECT entity_id, g, count(*) AS k FROM d GROUP BY 1, 2) c
  ON c.entity_id = n.entity_id AND c.g = q.g WHERE n.n >= {least} {more})"""


_CHI = "x AS (SELECT entity_id, sum(pow(p - q, 2) / (q + 1e-9)) / 2 AS h FROM p GROUP BY 1)"
_model("benford", ledger_view, digits.benford)
ORACLE["benford"] = _sql(LEDGER_SQL, _cells(_FIRST, "", 1, 8) + f", {_CHI}, scored AS (SELECT entity_id, 1 - exp(-h) * (1 + h + h * h / 2 + h * h * h / 6) AS score FROM x)")
_model("benford_ks", ledger_view, digits.benford_ks)
ORACLE["benford_ks"] = _sql(LEDGER_SQL, _cells(_FIRST, "", 1, 8) + """, k AS (SELECT entity_id, abs(sum(p - q) OVER (PARTITION BY entity_id ORDER BY g)) AS gap FROM p),
scored AS (SELECT entity_id, least(4 * max(gap), 1.0) AS score FROM k GROUP BY 1)""")
_model("benford_second", ledger_view, digits.benford_second)
_ODD9 = "sum(pow(h, j + 4.5) / {g}) "
ORACLE["benford_second"] = _sql(LEDGER_SQL, _cells(_SECOND, "AND amount >= 1", 0, 20, "AND a.n >= 30") + f""", {_CHI},
scored AS (SELECT entity_id, greatest(0.0, least(1.0, exp(-h) * list_sum(list_transform(range(0, 60), lambda j: pow(h, 4.5 + j) / gamma(5.5 + j))))) AS score FROM x)""")

# --- rules ----------------------------------------------------------------
_model("structuring", orders_view, rules.structuring)
ORACLE["structuring"] = _sql(ORDERS_SQL, f"raws AS (SELECT entity_id, pow(count(*) FILTER (amount >= 8800 AND amount < 10000), 1.5) / sqrt(count(*)) AS raw FROM od GROUP BY 1 HAVING count(*) FILTER (amount >= 8800 AND amount < 10000) > 0), {OVER_MAX}")
_model("structuring_banded", orders_view, rules.structuring_banded)
ORACLE["structuring_banded"] = _sql(ORDERS_SQL, f"raws AS (SELECT entity_id, pow(count(*), 1.2) AS raw FROM od WHERE amount >= 8000 AND amount < 10000 GROUP BY 1), {OVER_MAX}")
_model("structuring_events", events_view, lambda e: rules.structuring(e, EV["threshold"], 0.8))
ORACLE["structuring_events"] = _sql(EVENTS_SQL, f"raws AS (SELECT entity_id, pow(count(*) FILTER (amount >= 320 AND amount < 400), 1.5) / sqrt(count(*)) AS raw FROM ev WHERE source = 'bank' AND amount IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (amount >= 320 AND amount < 400) > 0), {OVER_MAX}")
_model("behavioral", events_view, lambda e: rules.behavioral(e, 2, 1.5, 0.2, 0.9, 4, 1.5))
ORACLE["behavioral"] = _sql(EVENTS_SQL, """sp AS (SELECT min(timestamp) FILTER (source = 'bank') AS ws, max(timestamp) FILTER (source = 'bank') AS we,
  coalesce(quantile_cont(amount, 0.9) FILTER (amount > 0), 1e12) AS q FROM ev),
sq AS (SELECT *, row_number() OVER w AS i, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 86400e6 AS gap FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY timestamp, event_id)),
md AS (SELECT entity_id, median(amount) AS mid FROM ev WHERE source = 'bank' AND amount > 0 GROUP BY 1),
pr AS (SELECT s.entity_id, count(*) AS n, any_value(ws) AS ws, any_value(we) AS we, min(timestamp) FILTER (source = 'bank') AS fb,
  count(*) FILTER (source = 'bank' AND amount > 0 AND (epoch_us(we) - epoch_us(timestamp)) / 86400e6 <= 2) AS late, max(gap) AS g, median(gap) AS gm,
  arg_max(i, {'g': gap, 'i': -i}) FILTER (gap IS NOT NULL) AS gi, max(timestamp) AS last,
  max(timestamp) FILTER (source = 'bank' AND amount >= greatest(q, 1.5 * mid)) AS lump
  FROM sq s CROSS JOIN sp LEFT JOIN md ON md.entity_id = s.entity_id GROUP BY 1 HAVING count(*) >= 3),
z AS (SELECT *, (epoch_us(fb) - epoch_us(ws)) / 86400e6 AS lag_, (epoch_us(we) - epoch_us(last)) / 86400e6 AS tail, (epoch_us(last) - epoch_us(lump)) / 86400e6 AS aft, gi - 2 AS p FROM pr),
scored AS (SELECT * FROM (SELECT entity_id, greatest(
  CASE WHEN n >= 5 AND lag_ >= 2 AND late >= 3 THEN least(0.5 + lag_ / 200, 1.0) ELSE 0.0 END,
  CASE WHEN n >= 15 AND g >= 1.5 AND g >= 4 * gm AND p >= 2 AND p < n - 2 THEN least(0.4 + g / 90, 1.0) ELSE 0.0 END,
  CASE WHEN n >= 10 AND aft <= 2 AND tail >= 0.2 THEN least(0.4 + tail / 45, 1.0) ELSE 0.0 END) AS score FROM z) WHERE score > 0)""")


def _chain_sql(min_amount: float, hop_days: float, min_nodes: int, factor: float) -> str:
    near = f'bg.src = p.tip AND abs(bg."at" - p."at") <= {int(hop_days * 86_400_000_000)} AND NOT list_contains(p.nodes, bg.dst)'
    rows = f"""WITH RECURSIVE {EVENTS_SQL}, bk AS (SELECT * FROM ev WHERE source = 'bank' AND amount > 0 AND counterparty_id IS NOT NULL),
q AS (SELECT quantile_cont(amount, 0.9) AS q FROM bk), md AS (SELECT entity_id, median(amount) AS mid FROM bk GROUP BY 1),
bg AS (SELECT entity_id AS src, counterparty_id AS dst, amount, epoch_us(timestamp) AS "at" FROM bk JOIN md USING (entity_id), q
  WHERE amount >= {min_amount} AND amount >= q AND amount >= {factor} * mid),
p AS (SELECT [src, dst] AS nodes, [amount] AS am, dst AS tip, "at" FROM bg WHERE (SELECT count(*) FROM bg) >= {min_nodes}
  UNION ALL SELECT list_append(p.nodes, bg.dst), list_append(p.am, bg.amount), bg.dst, bg."at" FROM p JOIN bg ON {near}),
dn AS (SELECT nodes, am FROM p WHERE len(nodes) >= {min_nodes} AND NOT EXISTS (SELECT 1 FROM bg WHERE {near})),
ex AS (SELECT nodes, am, unnest(range(1, len(am) + 1)) AS i FROM dn),
rw AS (SELECT nodes[i] AS entity_id, max(least(1.0, 0.5 + len(am) / (2.0::DOUBLE * {min_nodes})) * (0.6 + 0.4 * least(1.0, am[i] / (20 * {min_amount})))) AS raw FROM ex GROUP BY 1)
SELECT entity_id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9), 6) AS score FROM rw"""
    return rows


for _name, _args in (("chain", (EV["chain_amount"], 2, 3, 1.2)), ("chain_deep", (20.0, 4, 4, 1.1))):
    _model(_name, events_view, lambda e, a=_args: rules.chain(e, a[0], a[1], a[2], factor=a[3]))
    ORACLE[_name] = _chain_sql(*_args)

# --- outliers -------------------------------------------------------------
_LOGGED = set(features.LOGGED)
_MATRIX = _FEATURE_SQL.format(v="ev") + ", lf AS (SELECT entity_id, " + ", ".join(
    f"ln(1 + greatest({c}, 0)) AS {c}" if c in _LOGGED else c for c in features.FEATURES
) + " FROM feat), mx AS (SELECT entity_id, " + ", ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-9), 0) AS {c}" for c in features.FEATURES
) + " FROM lf)"
_model("statml_zscore", events_view, outliers.max_zscore)
ORACLE["statml_zscore"] = _sql(EVENTS_SQL, _MATRIX + f", raws AS (SELECT entity_id, greatest({', '.join(f'abs({c})' for c in features.FEATURES)}) AS raw FROM mx), {SCOREMIN}")
_model("statml_hbos", events_view, outliers.hbos, 4)
ORACLE["statml_hbos"] = _sql(EVENTS_SQL, _MATRIX + ", lng AS (" + " UNION ALL ".join(f"SELECT entity_id, {i} AS f, {c} AS x FROM mx" for i, c in enumerate(features.FEATURES)) + f"""),
eg AS (SELECT f, min(x) - 1e-9 AS lo, max(x) + 1e-9 AS hi, count(*) AS n FROM lng GROUP BY 1),
pl AS (SELECT entity_id, f, n, least(9, floor((x - lo) / (hi - lo) * 10)) AS b FROM lng JOIN eg USING (f)),
raws AS (SELECT entity_id, sum(-ln(greatest(k / n::DOUBLE, 1e-9))) AS raw FROM pl JOIN (SELECT f, b, count(*) AS k FROM pl GROUP BY 1, 2) USING (f, b) GROUP BY 1), {SCOREMIN}""", 4)
for _name, _op in {
    "statml_isolation_forest": outliers.isolation_forest, "statml_extended_forest": outliers.extended_isolation_forest,
    "statml_lof": outliers.local_outlier_factor, "statml_mahalanobis": outliers.mahalanobis, "statml_pca": outliers.pca_error,
    "statml_ocsvm": outliers.one_class_svm, "statml_autoencoder": outliers.autoencoder, "statml_gmm": outliers.gaussian_mixture, "statml_kde": outliers.kernel_density,
}.items():
    _model(_name, events_view, _op)

_SQUARES = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in features.FEATURES)
ORACLE["statml_kde"] = _sql(EVENTS_SQL, _MATRIX + f""", nn AS (SELECT count(*)::DOUBLE AS n FROM mx), ex AS (SELECT a.entity_id, n, -({_SQUARES}) / (2 * pow(n, -2.0 / {len(features.FEATURES) + 4})) AS e FROM mx a, mx b, nn WHERE n >= 16),
tp AS (SELECT *, max(e) OVER (PARTITION BY entity_id) AS top FROM ex), raws AS (SELECT entity_id, -(any_value(top) + ln(sum(exp(e - top)) / any_value(n))) AS raw FROM tp GROUP BY 1), {SCOREMIN}""")
ORACLE["statml_lof"] = _sql(EVENTS_SQL, _MATRIX + f""", pr AS (SELECT a.entity_id, b.entity_id AS id, sqrt({_SQUARES}) AS d FROM mx a JOIN mx b ON a.entity_id <> b.entity_id
  QUALIFY row_number() OVER (PARTITION BY a.entity_id ORDER BY sqrt({_SQUARES}), b.entity_id) <= 20),
rc AS (SELECT entity_id AS id, max(d) AS reach FROM pr GROUP BY 1), ds AS (SELECT entity_id, 1 / (avg(greatest(d, reach)) + 1e-10) AS density FROM pr JOIN rc USING (id) GROUP BY 1),
ot AS (SELECT pr.entity_id, avg(density) AS other FROM pr JOIN ds ON ds.entity_id = pr.id GROUP BY 1), raws AS (SELECT entity_id, other / density AS raw FROM ds JOIN ot USING (entity_id)), {SCOREMIN}""")

# --- fusion ---------------------------------------------------------------
_FUSED = ["time_correlation", "network_oddball", "structuring_events", "behavioral", "statml_zscore"]


def _scores(spark: SparkSession, sf: str, own: dict[str, Query] | None = None) -> DataFrame:
    """Each model is run once, however often its scores are read; the jobs that
    models need on the way to their plans share the cluster. ``own`` stands in for
    queries whose inputs the caller needs too."""
    found = QUERIES | (own or {})
    with ThreadPoolExecutor(len(_FUSED)) as pool:
        models = dict(zip(_FUSED, pool.map(lambda name: found[name](spark, sf), _FUSED), strict=True))
    return cut(fusion.stack(models))


_SCORES_SQL = "sc AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({ORACLE[m]})" for m in _FUSED) + ")"
_RANKS_SQL = _SCORES_SQL + """, rk AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY model) > 1 THEN (row_number() OVER (PARTITION BY model ORDER BY score, entity_id) - 1)
  / (count(*) OVER (PARTITION BY model) - 1)::DOUBLE ELSE 0.0 END AS points FROM sc), nm AS (SELECT count(DISTINCT model) AS nm FROM sc)"""
_BORDA_SQL = _RANKS_SQL + ", fu AS (SELECT entity_id, least(sum(points) / any_value(nm) + 0.25 * max(score), 1.0) AS score FROM rk, nm GROUP BY 1)"
_WEIGHTS = {"time_correlation": 2.0, "structuring_events": 0.5}
QUERIES["fusion_borda"] = lambda spark, sf: rounded(fusion.borda(_scores(spark, sf)))
ORACLE["fusion_borda"] = f"WITH {_BORDA_SQL} SELECT entity_id, round(score, 6) AS score FROM fu"
QUERIES["fusion_top2"] = lambda spark, sf: rounded(fusion.top2(_scores(spark, sf)))
ORACLE["fusion_top2"] = f"WITH {_SCORES_SQL} SELECT entity_id, round(0.7 * s[1] + 0.3 * coalesce(s[2], 0), 6) AS score FROM (SELECT entity_id, list(score ORDER BY score DESC) AS s FROM sc GROUP BY 1)"
QUERIES["fusion_rank_average"] = lambda spark, sf: rounded(fusion.rank_average(_scores(spark, sf)))
ORACLE["fusion_rank_average"] = f"WITH {_RANKS_SQL} SELECT entity_id, round(avg(points), 6) AS score FROM rk GROUP BY 1"
QUERIES["fusion_score_mean"] = lambda spark, sf: rounded(fusion.score_mean(_scores(spark, sf)))
ORACLE["fusion_score_mean"] = f"WITH {_RANKS_SQL} SELECT entity_id, round(sum(score) / any_value(nm), 6) AS score FROM sc, nm GROUP BY 1"
QUERIES["fusion_weighted_sum"] = lambda spark, sf: rounded(fusion.weighted_sum(_scores(spark, sf), _WEIGHTS))
ORACLE["fusion_weighted_sum"] = f"""WITH {_SCORES_SQL}, wt AS (SELECT *, CASE model WHEN 'time_correlation' THEN 2.0 WHEN 'structuring_events' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM sc)
SELECT entity_id, round(sum(w * score) / greatest(sum(w), 1.0), 6) AS score FROM wt GROUP BY 1"""


def risk_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: fused ranking with fired models, risk and explanation."""
    scores = _scores(spark, sf)
    return fusion.ranking(events_view(spark, sf), scores, fusion.borda(scores))


_RANKING_SQL = _BORDA_SQL + f""", {EVENTS_SQL}, ne AS (SELECT entity_id, count(*) AS n_events FROM ev GROUP BY 1),
fi AS (SELECT entity_id, coalesce(string_agg(model, ',' ORDER BY model) FILTER (score > 0.6), '') AS models_fired, coalesce(string_agg(model, ',' ORDER BY model) FILTER (score > 0.5), '') AS named FROM sc GROUP BY 1),
rn AS (SELECT entity_id, round(score, 4) AS score, coalesce(n_events, 0) AS n_events, models_fired,
  CASE WHEN round(score, 4) >= 0.7 THEN 'HIGH' WHEN round(score, 4) >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN round(score, 4) > 0.6 THEN 'flagged by ' || named END AS explanation FROM fu LEFT JOIN ne USING (entity_id) LEFT JOIN fi USING (entity_id))"""
QUERIES["risk_ranking"] = risk_ranking
ORACLE["risk_ranking"] = f"WITH {_RANKING_SQL} SELECT * FROM rn"
QUERIES["risk_ranking_top10"] = lambda spark, sf: fusion.top_k(risk_ranking(spark, sf), 10)
ORACLE["risk_ranking_top10"] = f"WITH {_RANKING_SQL} SELECT * FROM rn ORDER BY score DESC, entity_id LIMIT 10"


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in answer key: every seventh entity, of one of two kinds."""
    e = events_view(spark, sf).select("entity_id").distinct().where("entity_id % 7 = 0")
    return e.select("entity_id", F.when(F.col("entity_id") % 2 == 0, "even").otherwise("odd").alias("kind"))


_TRUTH_SQL = "tr AS (SELECT DISTINCT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM ev WHERE entity_id % 7 = 0)"


def fusion_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Features are made once, for the learners and for the model that reads them."""
    with ThreadPoolExecutor(1) as pool:
        made = pool.submit(lambda: cut(features.build_features(events_view(spark, sf))))
        scores = _scores(spark, sf, {"statml_zscore": lambda *_: rounded(outliers.largest_deviation(features.standardised(made.result())))})
    return rounded(meta.learned(scores, made.result(), _truth(spark, sf)))


QUERIES["fusion_learned"] = fusion_learned
QUERIES["evaluation_recall_precision"] = lambda spark, sf: evaluation.recall_precision(risk_ranking(spark, sf), _truth(spark, sf))
ORACLE["evaluation_recall_precision"] = f"""WITH {_RANKING_SQL}, {_TRUTH_SQL}, pl AS (SELECT entity_id, row_number() OVER (ORDER BY score DESC, entity_id) AS place FROM rn),
k AS (SELECT unnest([5, 10, 20]) AS k), pn AS (SELECT (SELECT count(*) FROM tr) AS p, (SELECT count(*) FROM rn) AS n)
SELECT k, hits, round(hits / greatest(p, 1)::DOUBLE, 4) AS recall, round(hits / k::DOUBLE, 4) AS precision, round(hits / (k * p / n::DOUBLE), 4) AS lift
FROM (SELECT k.k::INT AS k, count(tr.entity_id) AS hits FROM k JOIN pl ON pl.place <= k.k LEFT JOIN tr USING (entity_id) GROUP BY 1), pn"""
QUERIES["evaluation_by_part"] = lambda spark, sf: evaluation.by_part(cut(risk_ranking(spark, sf)), _truth(spark, sf), "odd")
ORACLE["evaluation_by_part"] = f"""WITH {_RANKING_SQL}, {_TRUTH_SQL}, pl AS (SELECT entity_id, row_number() OVER (ORDER BY score DESC, entity_id) AS place FROM rn),
k AS (SELECT unnest([5, 10]) AS k), pt AS (SELECT CASE kind WHEN 'odd' THEN 'held' ELSE 'main' END AS part, count(*) AS p FROM tr GROUP BY 1)
SELECT part, k, hits, round(hits / p::DOUBLE, 4) AS recall, round(hits / k::DOUBLE, 4) AS precision, round(hits / (k * p / (SELECT count(*) FROM rn)::DOUBLE), 4) AS lift
FROM (SELECT pt.part, p, k.k::INT AS k, count(tr.entity_id) AS hits FROM pt CROSS JOIN k JOIN pl ON pl.place <= k.k
  LEFT JOIN tr ON tr.entity_id = pl.entity_id AND (tr.kind = 'odd') = (pt.part = 'held') GROUP BY 1, 2, 3)"""
QUERIES["evaluation_type_recall"] = lambda spark, sf: evaluation.type_recall(risk_ranking(spark, sf), _truth(spark, sf), 20)
ORACLE["evaluation_type_recall"] = f"""WITH {_RANKING_SQL}, {_TRUTH_SQL}, hd AS (SELECT entity_id, 1 AS f FROM rn ORDER BY score DESC, entity_id LIMIT 20)
SELECT kind, count(*) AS n, count(f) AS found, round(count(f) / count(*)::DOUBLE, 4) AS recall FROM tr LEFT JOIN hd USING (entity_id) GROUP BY 1"""
QUERIES["evaluation_ablation"] = lambda spark, sf: evaluation.ablation(_scores(spark, sf), _truth(spark, sf), _FUSED)
ORACLE["evaluation_ablation"] = f"WITH {_SCORES_SQL}, {EVENTS_SQL}, {_TRUTH_SQL} " + " UNION ALL ".join(
    f"SELECT '{m}' AS left_out, count(*) AS hits FROM (SELECT entity_id FROM sc WHERE model <> '{m}' GROUP BY 1 ORDER BY round(sum(score) / {len(_FUSED) - 1}, 6) DESC, entity_id LIMIT 10) WHERE entity_id IN (SELECT entity_id FROM tr)"
    for m in _FUSED
)

# --- insights -------------------------------------------------------------
QUERIES["insights"] = lambda spark, sf: insights.build_insights(events_view(spark, sf), 1440, EV["threshold"], 1.2, 0.2)
ORACLE["insights"] = f"""WITH {EVENTS_SQL}, {_BURST.format(h=48)}, al AS (SELECT entity_id, count(*) AS n FROM ev GROUP BY 1),
cp AS (SELECT entity_id, count(*) AS n FROM ev WHERE counterparty_id IS NOT NULL GROUP BY 1),
io AS (SELECT entity_id, count(DISTINCT counterparty_id) FILTER (direction = 'credit') AS i, count(DISTINCT counterparty_id) FILTER (direction = 'debit') AS o FROM ev WHERE amount IS NOT NULL GROUP BY 1),
gp AS (SELECT entity_id, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY entity_id ORDER BY timestamp, event_id)) / 86400e6 AS gap FROM ev),
lq AS (SELECT entity_id, quantile_cont(amount, 0.95) AS q FROM ev WHERE amount IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
ls AS (SELECT e.entity_id, (epoch_us(max(timestamp)) - epoch_us(max(timestamp) FILTER (amount >= q))) / 86400e6 AS quiet FROM ev e JOIN lq USING (entity_id) WHERE q > 0 AND amount IS NOT NULL GROUP BY 1)
SELECT entity_id, 'call_then_transfer' AS kind, count(*) AS detail FROM ev b WHERE source = 'bank' AND EXISTS (SELECT 1 FROM ev c WHERE c.source <> 'bank' AND c.entity_id = b.entity_id AND c.counterparty_id = b.counterparty_id
  AND abs(epoch_us(c.timestamp) - epoch_us(b.timestamp)) <= 86400000000) GROUP BY 1
UNION ALL SELECT entity_id, 'under_threshold', count(*) FROM ev WHERE amount >= 352 AND amount < 400 GROUP BY 1 HAVING count(*) >= 3
UNION ALL SELECT entity_id, 'hub', CASE WHEN i >= 5 AND o >= 8 THEN i + o WHEN i >= 10 THEN i ELSE o END FROM io WHERE (i >= 5 AND o >= 8) OR i >= 10 OR o >= 10
UNION ALL SELECT entity_id, 'burst', burst FROM b JOIN cp USING (entity_id) WHERE cp.n >= 10 AND burst >= 12
UNION ALL SELECT entity_id, 'dormancy', floor(max(gap))::BIGINT FROM gp JOIN al USING (entity_id) GROUP BY entity_id, al.n HAVING al.n >= 10 AND max(gap) >= 1.2
UNION ALL SELECT entity_id, 'lump_then_silence', floor(quiet)::BIGINT FROM ls WHERE quiet >= 0.2
UNION ALL SELECT entity_id, 'round_amounts', count(*) FILTER (abs(amount % 1) < 0.01) FROM ev WHERE amount IS NOT NULL GROUP BY 1
  HAVING count(*) >= 15 AND count(*) FILTER (abs(amount % 1) < 0.01) / count(*)::DOUBLE >= 0.5"""

QUERIES["insights_worded"] = lambda spark, sf: insights.worded(insights.build_insights(events_view(spark, sf), 1440, EV["threshold"], 1.2, 0.2), 1440, EV["threshold"])
ORACLE["insights_worded"] = f"""SELECT * EXCLUDE (n), CASE kind WHEN 'call_then_transfer' THEN n || ' transfers to a party called or posted to within 1440 minutes' WHEN 'under_threshold' THEN n || ' amounts just under the limit of 400'
  WHEN 'hub' THEN 'money moved with ' || n || ' different parties' WHEN 'burst' THEN 'dealt with ' || n || ' different parties within 48 hours'
  WHEN 'dormancy' THEN 'silent for ' || n || ' days, then active again' WHEN 'lump_then_silence' THEN 'a large amount, then quiet for ' || n || ' days'
  WHEN 'round_amounts' THEN n || ' amounts without cents, half of all or more' END AS sentence FROM (SELECT * FROM ({ORACLE["insights"]})) t, LATERAL (SELECT format('{{:,}}', t.detail) AS n) x"""
QUERIES["largest_per_party"] = lambda spark, sf: insights.largest_per_party(ledger_view(spark, sf), 5)
ORACLE["largest_per_party"] = f"""WITH {LEDGER_SQL}, b AS (SELECT entity_id, counterparty_id, amount, event_id FROM lg WHERE amount IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entity_id, counterparty_id ORDER BY amount DESC, event_id) = 1)
SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY amount DESC, event_id)::INT AS place FROM b QUALIFY place <= 5"""

# --- chart aggregates -----------------------------------------------------
QUERIES["chart_daily_by_source"] = lambda spark, sf: charts.daily_by_source(events_view(spark, sf))
ORACLE["chart_daily_by_source"] = f"""WITH {EVENTS_SQL}, dy AS (SELECT unnest(generate_series(min(timestamp)::DATE::TIMESTAMP, max(timestamp)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM ev)
SELECT strftime(dy.day, '%Y-%m-%d') AS day, count(*) FILTER (source = 'bank') AS bank, count(*) FILTER (source = 'cdr') AS cdr, count(*) FILTER (source = 'social') AS social FROM dy LEFT JOIN ev ON timestamp::DATE = dy.day GROUP BY dy.day"""
QUERIES["chart_model_peaks"] = lambda spark, sf: charts.model_peaks(_scores(spark, sf))
ORACLE["chart_model_peaks"] = f"WITH {_SCORES_SQL} SELECT model, round(max(score), 6) AS peak, count(*) FILTER (score > 0.6) AS fired FROM sc GROUP BY 1"
QUERIES["chart_shared_counterparties"] = lambda spark, sf: charts.shared_counterparties(events_view(spark, sf), _truth(spark, sf))
ORACLE["chart_shared_counterparties"] = f"""WITH {EVENTS_SQL}, {_TRUTH_SQL}, {_EDGES.format(v="ev")}
SELECT dst AS counterparty_id, count(DISTINCT src) AS hubs, sum(w)::BIGINT AS w FROM e WHERE src IN (SELECT entity_id FROM tr) GROUP BY 1 HAVING count(DISTINCT src) >= 2"""
QUERIES["chart_location_volume"] = lambda spark, sf: charts.location_volume(events_view(spark, sf), _truth(spark, sf), "counterparty_id", 50)
ORACLE["chart_location_volume"] = f"""WITH {EVENTS_SQL}, {_TRUTH_SQL}, tp AS (SELECT counterparty_id AS location, count(*) AS n, bool_or(entity_id IN (SELECT entity_id FROM tr)) AS flagged
  FROM ev WHERE counterparty_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, location LIMIT 50)
SELECT location, n, flagged, round(((rank() OVER (ORDER BY n) - 1) + (count(*) OVER (PARTITION BY n) + 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS pct FROM tp"""
