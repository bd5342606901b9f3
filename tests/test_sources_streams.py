"""File readers, validation and the stream of events."""

import json
import os

from pyspark.sql import functions as F

from tributary.operators import features as fe
from tributary.sources import files as fs
from tributary.streaming import ingest as ing

AUTH = {"event_id": "1", "event_type": "auth", "sender_id": "a", "receiver_id": "b", "amount_cents": 100, "currency": "usd", "timestamp_utc": "2024-01-01T00:00:00Z", "authorization_code": "abc123", "approved": True, "terminal_id": "t", "merchant_category_code": "1234", "merchant_name": "m"}
SETTLE = {"event_id": "2", "event_type": "SETTLEMENT", "sender_id": "a", "receiver_id": "b", "amount_cents": 100, "currency": "USD", "timestamp_utc": "2024-01-01T01:00:00+00:00", "authorization_code": "ABC123", "settlement_amount_cents": 120}


def events(spark, *rows):
    return ing.normalise(spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string"))


def test_validation_and_dead_letters(spark):
    e = events(spark, AUTH, SETTLE, "{broken", {**AUTH, "timestamp_utc": "2024-01-01T00:00:00"}, {**AUTH, "amount_cents": 0})
    assert e.filter("size(errors) = 0").count() == 2 and ing.dead_letters(e).count() == 3


def test_settlements(spark):
    e = events(spark, AUTH, SETTLE, {**SETTLE, "event_id": "3", "authorization_code": "ZZZZZZ"}, {**SETTLE, "event_id": "4", "settlement_amount_cents": 5})
    got = {r["event_id"]: r["status"] for r in ing.match_settlements(e.filter("event_type = 'AUTH'"), e.filter("event_type = 'SETTLEMENT'")).collect()}
    assert got == {"2": "SETTLED", "3": "ORPHANED", "4": "DECLINED"}


def test_stream_equals_batch_and_counts_a_repeat_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        rows = [{**SETTLE, "event_id": f"{k}-{i}"} for i in range(5)] + [{**SETTLE, "event_id": "0-0"}]
        (folder / f"{k}.txt").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(folder))
    ing.start_ingest(stream, str(tmp_path / "out")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out" / "flows" / "2")).first()
    assert (last["tx_count"], last["total_amount"]) == (15, 15 * 120)


def test_live_scores(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k, pairs in enumerate([[("a", "b"), ("b", "c")], [("c", "d")], []]):
        rows = [{**SETTLE, "event_id": f"{k}-{i}", "sender_id": x, "receiver_id": y} for i, (x, y) in enumerate(pairs)]
        (folder / f"{k}.txt").write_text("\n".join(map(json.dumps, rows)) or "{broken")
        os.utime(folder / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in the order of their times
    seen = []

    def model(matrix):
        assert matrix.columns[1:] == fe.FEATURES
        seen.append({r["account"]: (r["in_degree"], r["out_degree"]) for r in matrix.collect()})
        return matrix.select("account", (F.col("in_degree") / 2 + 0.45).alias("score"))

    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(folder))
    ing.start_ingest(stream, out, on_batch=ing.live_scorer(out, model, hops=1)).awaitTermination()
    assert seen == [{"a": (0, 1), "b": (1, 1), "c": (1, 0)}, {"b": (0, 1), "c": (1, 1), "d": (1, 0)}, {}]
    scores = {(r["batch"], r["account"]): (r["score"], r["tier"], r["distance"]) for r in spark.read.parquet(f"{out}/scores").collect()}
    assert len(scores) == 6 and scores[0, "a"] == (0.45, "medium", 0) and scores[1, "d"] == (0.95, "critical", 0) and scores[1, "b"][2] == 1
    assert {(r["batch"], r["account"]) for r in spark.read.parquet(f"{out}/flags").collect()} == {(0, "a"), (0, "b"), (0, "c"), (1, "c"), (1, "d")}


def test_csv_and_patterns(spark, tmp_path):
    row = "2022/09/01 00:20,10,AAA,11,BBB,1.99,US Dollar,1.99,US Dollar,ACH,1"
    (tmp_path / "t.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n" + row + "\nbad,1,a,2,b,x,US Dollar,x,US Dollar,ACH,0\n")
    t = fs.to_transfers(fs.read_transactions(spark, str(tmp_path / "t.csv"))).collect()
    assert len(t) == 1 and t[0]["amount_cents"] == 199 and t[0]["rail"] == "IBM_AML_US Dollar" and t[0]["ts"] == 1661991600
    (tmp_path / "p.txt").write_text(f"BEGIN LAUNDERING ATTEMPT - CYCLE\n{row}\n{row.replace('AAA', 'CCC')}\nEND LAUNDERING ATTEMPT\nnoise,1,2,3,4,5,6,7,8\nBEGIN LAUNDERING ATTEMPT - FAN-OUT: Max 3\n{row}\n")
    rows = fs.read_patterns(spark, str(tmp_path / "p.txt"))
    assert {(r["typology"], r["n_hops"], len(r["accounts"])) for r in fs.pattern_groups(rows).collect()} == {("CYCLE", 2, 3), ("FAN-OUT", 1, 2)}


def test_wallets_and_generator(spark):
    ok = spark.range(1).select(ing.wallet_ok(F.lit("ETHEREUM"), F.lit("0x" + "a" * 40)), ing.wallet_ok(F.lit("BITCOIN"), F.lit("0x")), ing.wallet_ok(F.lit("OTHER"), F.lit("x"))).first()
    assert list(ok) == [True, False, False]
    assert sorted(fs.generate(spark, 50).collect()) == sorted(fs.generate(spark, 50).repartition(3).collect())


def test_elliptic(spark, tmp_path):
    (tmp_path / "f").write_text("1,1,0.5\n2,2,0.1\n3,40,0.2\n")
    (tmp_path / "c").write_text("txId,class\n1,1\n2,2\n3,unknown\n")
    (tmp_path / "e").write_text("txId1,txId2\n1,2\n1,3\n")
    nodes, edges = fs.read_elliptic(spark, *[str(tmp_path / x) for x in "fce"], last_step=34)
    assert {(r["node"], r["y"]) for r in nodes.collect()} == {("1", 3), ("2", 0)} and edges.count() == 1


def test_events_are_parsed_once_below_a_filter(spark):
    raw = spark.createDataFrame([('{"event_type": "AUTH"}',), ("{",), (None,)], "value string")
    valid = ing.normalise(raw).filter("size(errors) = 0 AND event_type = 'AUTH'")
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert valid.count() == 0
    assert sorted("not JSON" in r.errors for r in ing.normalise(raw).collect()) == [False, False, True]
