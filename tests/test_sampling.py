"""The stratified sampler: quotas, and the same sample however rows are dealt."""

import collections
import hashlib
import random

from tidewatch.plans import sampling

SCHEMA = "event_id long, account long, other long, kind string, labelled boolean"
Q = sampling.Quotas(per_kind=2, rows=12, context=3, active=8, total=120)


def _rows():
    rng, out = random.Random(6), []
    for i in range(900):
        account = rng.choice([None, *range(40), *range(6)])
        labelled = account is not None and account < 9 and rng.random() < (0.9 if account == 3 else 0.1)
        out.append((i, account, rng.choice([None, *range(40)]), f"k{(account or 0) % 3}" if labelled else rng.choice([None, "x"]), labelled or rng.choice([False, None])))
    return out


def _md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


def _brute(rows, q):
    sent = collections.Counter(r[1] for r in rows if r[1] is not None)
    chosen = set()
    for kind in {r[3] for r in rows if r[4]}:
        cases = {r[1] for r in rows if r[4] and r[3] == kind}
        chosen |= set(sorted(cases, key=lambda a: (-sent[a], _md5(a)))[: q.per_kind])
    part = {}
    for a in chosen:
        cases = [r[0] for r in rows if r[1] == a and r[4]]
        rest = sorted((r[0] for r in rows if r[1] == a and not r[4]), key=_md5)
        part |= dict.fromkeys(sorted((r[0] for r in rows if r[2] == a and r[1] != a), key=_md5)[: q.context], "context") | part
        part |= dict.fromkeys(rest[: max(0, q.rows - len(cases))], "own") | dict.fromkeys(cases, "case")
    room, upto = q.total - len(part), 0
    for a in sorted((a for a in sent if sent[a] >= q.active and a not in chosen), key=_md5):
        if upto >= room:
            break
        upto += min(sent[a], q.rows)
        for event in sorted((r[0] for r in rows if r[1] == a), key=_md5)[: q.rows]:
            part.setdefault(event, "background")
    return part


def test_quotas_hold_under_any_dealing(spark):
    rows = _rows()
    want = _brute(rows, Q)
    assert set(want.values()) == {"case", "own", "context", "background"} and len(want) >= Q.total
    for parts in (1, 7):
        table = spark.createDataFrame(rows, SCHEMA).repartition(parts, "event_id")
        assert {r["event_id"]: r["part"] for r in sampling.stratified(table, Q).collect()} == want


def test_no_cases_and_no_rows(spark):
    table = spark.createDataFrame([(i, i % 2, 5, None, None) for i in range(30)], SCHEMA)
    got = sampling.stratified(table, sampling.Quotas(active=10, total=1)).collect()
    assert len(got) == 15 and {r["part"] for r in got} == {"background"}
    assert sampling.stratified(table.limit(0)).count() == 0
