"""From files to a report: loaders, detection, resolution, screening."""

import datetime
import gzip
import json
import random

import pytest

from tidewatch.functions import dates, similarity
from tidewatch.operators import resolution
from tidewatch.plans import screening
from tidewatch.sources import detect, loaders
from tidewatch.streaming import windows

LAYOUTS = {
    "semicolon.csv": ('d;a;a\n2025-01-01;"1;2";3\n', "csv", [("2025-01-01", "1;2", "3")]),
    "records.json": ('[{"a":1,"b":"x"},{"a":2}]', "json", [("1", "x"), ("2", None)]),
    "wrapped.json": ('{"meta":1,"data":[{"a":1},{"a":2}]}', "json", [("1",), ("2",)]),
    "lists.json": ('{"a":[1,2],"b":[3,4]}', "json", [("1", "3"), ("2", "4")]),
    "cells.json": ("[[1,2],[3]]", "json", [("1", "2"), ("3", None)]),
    "single.json": ('{"a":1}', "json", [("1",)]),
    "lines.ndjson": ('# c\n\n{"a":1}\nbad\n{"b":2}\n', "ndjson", [("1", None), (None, "2")]),
    "lines.log": ('{"a":1}\n{"a":2}\nx\n', "ndjson", [("1",), ("2",)]),
    "pairs.log": ('ts="2024-01-19 09:00" amt=5\nts=x amt=6 k=1 k=2\n', "kv", [("5", None, "2024-01-19 09:00"), ("6", "2", "x")]),
    "bars.txt": ("a|b\n1|2\n3|4\n5|\n", "delimited", [("1", "2"), ("3", "4"), ("5", "")]),
    "notes.txt": ("hello\nworld\n", "text", [("hello",), ("world",)]),
    "empty.txt": ("", "text", []),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, tmp_path, name):
    text, kind, rows = LAYOUTS[name]
    (tmp_path / name).write_text(text, encoding="utf-8")
    got = loaders.load_any(spark, f"file://{tmp_path}/{name}")
    assert got.format == kind
    assert sorted(map(tuple, got.df.collect()), key=str) == sorted(rows, key=str)


def test_latin1_gzip_and_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "l.csv").write_bytes("date,name\n2025-01-01,José\n".encode("latin-1"))
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"a,b\n1,2\n"))
    (tmp_path / "x.bin").write_bytes(b"?")
    files = loaders.collect_files(spark, [f"file://{tmp_path}"])
    assert [f.rpartition("/")[2] for f in files] == ["l.csv", "z.csv.gz"]
    got = loaders.load_any(spark, files[0])
    assert got.df.first()["name"] == "José" and "latin-1" in got.warning
    assert tuple(loaders.load_any(spark, files[1]).df.first()) == ("1", "2")
    with pytest.raises(ValueError):
        loaders.load_any(spark, "x.bin")


def test_prose(spark, tmp_path):
    (tmp_path / "p.log").write_text(
        "2026-01-09 09:00:10 INFO transfer from ACCT-1001 to ACCT-4001 amount 1,000.00 USD\n"
        "2026-01-09 call from +639171234567 to @a.b12 lasted 30 sec\nUSD 500 deposit into 09171234567\nnothing here\n"
    )
    got = loaders.load_any(spark, f"file://{tmp_path}/p.log")
    assert got.format == "prose"
    assert [tuple(r) for r in got.df.collect()] == [
        ("2026-01-09 09:00:10", "1000.00", None, "ACCT-1001", "ACCT-4001", "debit", "transaction"),
        ("2026-01-09", None, "30", None, "@a.b12", None, "call"),
        (None, "500", None, None, "09171234567", "credit", "transaction"),
    ]


def test_dates(spark):
    cases = {
        "2025-01-25": "2025-01-25 00:00:00", "25/01/2025": "2025-01-25 00:00:00", "01/02/2025 03:04:05": "2025-01-02 03:04:05",
        "2025-01-25T10:11:12Z": "2025-01-25 10:11:12", "2025-01-25 10:11:12+05:30": "2025-01-25 10:11:12", "1700000000": "2023-11-14 22:13:20",
        "1700000000000": "2023-11-14 22:13:20", "Jan 5, 2025 10:00": "2025-01-05 10:00:00", "1st Mar 2024": "2024-03-01 00:00:00",
        "31/02/2025": None, "12345": None, "junk": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["at"] and str(r["at"]) for r in rows.select("t", dates.parse_timestamp(rows.t).alias("at")).collect()}
    assert got == cases
    assert dates.is_day_first(spark.createDataFrame([("25/01/2025",), ("01/02/2025",)], "t string"), "t")
    assert not dates.is_day_first(spark.createDataFrame([("01/25/2025",), ("01/02/2025",)], "t string"), "t")


def test_headers():
    want = {" TxN Date ": "timestamp", "AMOUNT (USD)": "amount", "ReCiPiEnT aCcOuNt": "counterparty", "acct no": "actor_id", "caller_msisdn": "actor_id",
            "subscriber": "actor_name", "length": "duration", "tower_id": "location", "dr_cr": "direction", "cuenta": "actor_id", "internal_ref": None}
    assert {h: (detect.best_header(h) or (None,))[0] for h in want} == want


def test_content_probe(spark):
    rng = random.Random(3)
    rows = [(f"{1_600_000_000 + i * 977}", f"{rng.uniform(1, 9999):.2f}", f"+63917{i:07d}", f"T{i % 40:03d}", f"Ana{chr(97 + i % 26)} Cruz{chr(97 + i // 26)}", "", f"@u{i}") for i in range(120)]
    found = detect.detect_columns(spark.createDataFrame(rows, "x0 string, x1 string, x2 string, x3 string, x4 string, x5 string, x6 string"), "content")
    assert {r.column: r.slot for r in found} == {"x0": "timestamp", "x1": "amount", "x2": "counterparty", "x3": "location", "x4": "actor_name", "x6": "actor_id"}
    assert detect.classify_source(found) == "bank"
    ids = [(f"T{100 + i}", f"ACCT{1_000_000 + i}", f"BRANCH{10 + i % 7}", f"2024-01-{1 + i % 28:02d}", f"{i % 90 + 10},{i % 90 + 10} EUR") for i in range(120)]
    found = detect.detect_columns(spark.createDataFrame(ids, "x0 string, x1 string, x2 string, x3 string, x4 string"), "content")
    assert {r.column: r.slot for r in found} == {"x0": "location", "x1": "counterparty", "x2": "location", "x3": "timestamp", "x4": "amount"}


def test_similar_names_against_brute_force(spark):
    rng = random.Random(1)
    names = {"maria cruz", "john michael smith", "ana lee", "josé garcia lopez", "li wu", "a", "bo", "katherine johnson-williams"}
    for base in sorted(names):
        for _ in range(25):
            letters = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e", "x"])
            names.add("".join(letters))
    names = sorted(filter(None, names))
    got = {tuple(sorted(r)) for r in resolution.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if similarity.ratio(a, b) >= 88}
    assert got == want and len(want) > 100


def test_similar_names_of_hashes(spark):
    """Pairs as far apart as is allowed; exploded keys are never sent to the driver
    and stay near a hundred a name."""
    rng = random.Random(5)
    names = {"".join(rng.choices("0123456789abcdef", k=rng.randint(33, 37))) for _ in range(150)}
    for base in sorted(names)[:100]:
        letters = list(base)
        for _ in range(4):
            del letters[rng.randrange(len(letters))]
            letters.insert(rng.randrange(len(letters) + 1), rng.choice("0123456789abcdef"))
        names.add("".join(letters))
    table = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    found = resolution.similar_names(table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
    listed = sorted(names)
    want = {(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if similarity.ratio(a, b) >= 88}
    assert {tuple(sorted(r)) for r in found.collect()} == want and len(want) >= 90
    sized = table.selectExpr("name", "length(name) AS size", "0L AS sig")
    keys = resolution._keys(sized, sized.select("size").distinct(), 88.0, True).count()
    assert keys < 130 * len(names)


def _met(spark, names):
    """Rows that names of one list make of pairs on equal keys."""
    sized = spark.createDataFrame([(n,) for n in names], "name string").selectExpr("monotonically_increasing_id() AS id", "name", "length(name) AS size", "0L AS sig")
    lengths = resolution._lengths(sized)
    return resolution._keys(sized, lengths, 88.0, False).join(resolution._keys(sized, lengths, 88.0, True).toDF("key", "b", "sb", "d"), "key").where("id <> b").count()


def test_similar_names_are_cut_where_they_differ(spark):
    """Stretches that all names share are no keys of their own; else all names
    would meet there."""
    rng = random.Random(6)
    names = sorted({"".join(rng.choices("0123456789abcdef", k=18)) + "same in all" + "".join(rng.choices("0123456789abcdef", k=8)) for _ in range(600)})
    assert _met(spark, names) < 30 * len(names)


def test_similar_names_of_two_lists(spark):
    rng = random.Random(7)
    known = sorted({"".join(rng.choices("abcdef", k=rng.randint(9, 26))) for _ in range(120)} | {"aaaaaaaaaaaaa", "aaaaaaaaaaaaaa", "josé 𝒶bc def ghi", "😀😁 smith jones"})
    listed = sorted({n[:k] + x + n[k + c :] for n in known for k, x, c in [(rng.randrange(len(n)), rng.choice("abcx"), rng.randint(0, 1))]} - set(known))
    tables = [spark.createDataFrame([(n,) for n in names], "name string") for names in (listed, known)]
    want = sorted((a, b) for a in listed for b in known if similarity.ratio(a, b) >= 88)
    assert sorted(map(tuple, resolution.similar_names(tables[0], to=tables[1]).collect())) == want and len(want) > 100


def test_resolve(spark):
    rows = [("A1", "Maria Cruz", "bank"), ("A2", "Cruz  Maria", "bank"), ("P1", "maria cruz", "cdr"), ("H1", "Maria Crus", "social"), ("X", None, "bank"), (None, "Zed", "bank"), ("X", None, "bank")]
    events = spark.createDataFrame(rows, "actor_raw string, actor_name string, source string")
    got = {r["identifier"]: r["entity_id"] for r in resolution.resolve(events).collect()}
    assert got.keys() == {"A1", "A2", "P1", "H1", "X"}
    assert got["A1"] != got["A2"] and got["P1"] == got["H1"] and got["P1"] in (got["A1"], got["A2"]) and got["X"] == "E:X"
    linked = resolution.apply(events.selectExpr("*", "'P1' AS counterparty_id_raw"), resolution.resolve(events))
    assert resolution.cross_source(linked).first() == (3, 1)
    assert resolution.resolve(events.limit(0)).count() == 0


def _exports(folder):
    """A bank file and a call file of the same people, one of whom structures."""
    rng = random.Random(5)
    at = lambda: datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=rng.randrange(150 * 1440))
    people = [("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)).title() + " " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)).title()) for _ in range(15)]
    bank, calls = [], []
    for i, name in enumerate(people):
        for _ in range(40):
            amount = rng.uniform(8900, 9990) if i == 0 else rng.lognormvariate(5, 1)
            bank.append((at().strftime("%d/%m/%Y %H:%M"), f"ACCT{i:07d}", name, f"{amount:.2f}", f"ACCT{rng.randrange(15):07d}", rng.choice(["credit", "debit"])))
            calls.append({"call_time": at().isoformat(), "msisdn": f"6391700000{i:02d}", "subscriber": name, "callee": f"6391700000{rng.randrange(15):02d}", "duration_secs": rng.randrange(600)})
    head = "posted_at,account_number,customer_name,amount,payee,dr_cr\n"
    (folder / "bank.csv").write_text(head + "".join(",".join(r) + "\n" for r in [*bank, bank[0]]))
    (folder / "cdr.jsonl").write_text("".join(json.dumps(r) + "\n" for r in calls))


def test_screening(spark, tmp_path):
    _exports(tmp_path)
    fast = {k: screening.MODELS[k] for k in ("structuring", "benford", "network", "time_correlation")}
    run = screening.screen(spark, [f"file://{tmp_path}"], models=fast)
    assert {s["source"]: s["rows"] for s in run.sources} == {"bank": 601, "cdr": 600}
    assert run.events.count() == 1200
    assert resolution.cross_source(run.events).first() == (15, 15)
    assert set(run.verdicts.values()) == {"SUPPORTED"}
    best = run.scores.where("model = 'structuring'").orderBy("score", ascending=False).first()
    assert best["entity_id"] == "E:6391700000" + "00" and best["score"] == 1.0
    made = screening.save(run, str(tmp_path / "out"))
    told = json.loads(open(made[0], encoding="utf-8").read())
    assert told["summary"]["entities"] == 15 and len(told["rankings"]) == 15
    assert all(len(r["trail"]) == 25 and r["trail"] == sorted(r["trail"], key=lambda t: t["timestamp"]) for r in told["rankings"])
    assert "Records behind them" in open(made[1], encoding="utf-8").read()
    assert "Entities that stand out" in open(made[1], encoding="utf-8").read() and "<table>" in open(made[2], encoding="utf-8").read()


def test_sparse_files_block_models(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("txn_date,amount,beneficiary,account_no\n" + "".join(f"2025-01-{i + 1:02d},{100 + i}.50,B{i}XY,A1\n" for i in range(12)))
    run = screening.screen(spark, [f"file://{tmp_path}"])
    assert run.ranking is None and run.verdicts["benford"] == "BLOCKED"


def test_stream_interval_join(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("c1", 7, "2025-01-01 10:00:00", "call"), ("t1", 7, "2025-01-01 10:20:00", "bank"), ("t2", 7, "2025-01-01 11:00:00", "bank"), ("t3", 8, "2025-01-01 10:01:00", "bank")]
    schema = "event_id string, counterparty_id long, timestamp string, source string"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/in")
    for read in (spark.read, spark.readStream):
        e = read.schema(schema).parquet(f"{tmp_path}/in").selectExpr("event_id", "counterparty_id", "cast(timestamp AS timestamp_ntz) AS timestamp", "source")
        met = windows.call_then_transfer(e.where("source = 'call'"), e.where("source = 'bank'"))
        if met.isStreaming:
            met.writeStream.format("memory").queryName("met").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
            met = spark.table("met")
        assert [(r["call_id"], r["event_id"]) for r in met.collect()] == [("c1", "t1")]


def _resolved_brute(rows):
    """identifier -> entity by the rule, over equal names alone."""
    names, sources = {}, {}
    for i, name, source in rows:
        if i is not None:
            sources.setdefault(i, set()).add(source or "")
            names.setdefault(i, set()).update([" ".join(sorted(name.lower().split()))] if name and name.strip() else [])
    person, out = {n: n for ns in names.values() for n in ns}, {}
    for _ in person:
        for ns in names.values():
            least = min((person[n] for n in ns), default=None)
            person.update(dict.fromkeys(ns, least))
    places = {}
    order = {i: k for k, i in enumerate(sorted(names, key=lambda i: (CELL[i], i)))}
    for p in set(person.values()):
        mine = sorted((i for i in names if names[i] and person[min(names[i])] == p), key=order.get)
        held = {}
        for k, i in enumerate((i for i in mine if len(sources[i]) > 1), 1):
            places[i] = (p, k)
            held[k] = sources[i]
        for source in {s for i in mine for s in sources[i]}:
            free = (k for k in range(1, 10_000) if source not in held.get(k, ()))
            for i in mine:
                if sources[i] == {source}:
                    places[i] = (p, next(free))
    for i in names:
        out[i] = "E:" + min((j for j in places if places[j] == places[i]), default=i) if i in places else f"E:{i}"
    return out


CELL = {}


def test_resolve_with_aliases_against_brute_force(spark):
    """Identifiers of several names and sources: at most one a source and entity."""
    rng = random.Random(8)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(12)]
    rows = [(f"I{rng.randrange(40)}", rng.choice([None, "", *letters, *letters]), rng.choice(["bank", "cdr", "social", None])) for _ in range(90)]
    rows += [(None, letters[0], "bank"), rows[0], ("I3", letters[0].upper() + " ", "bank")]
    events = spark.createDataFrame(rows, "actor_raw string, actor_name string, source string")
    cells = events.where("actor_raw is not null").select("actor_raw").distinct().selectExpr("actor_raw", f"pmod(xxhash64(actor_raw), {resolution.CELLS}) AS cell")
    CELL.update({r["actor_raw"]: r["cell"] for r in cells.collect()})
    got = {r["identifier"]: r["entity_id"] for r in resolution.resolve(events.repartition(3)).collect()}
    assert got == _resolved_brute(rows) and len(set(got.values())) < len(got)
    claims = {}
    for i, _, source in rows:
        if i is not None:
            claims.setdefault((got[i], source), set()).add(i)
    assert all(len(c) == 1 for (e, _), c in claims.items())
