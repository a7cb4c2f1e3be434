import datetime as dt
import json
import os

import pytest

from tickframe.operators import export as X
from tickframe.operators.bars import date_range, ohlc_bars
from tickframe.schemas import MARKET, PREDICTIONS, conform
from tickframe.session import broadcast_if_small, shared_dir
from tickframe.sources import readers as R
from tickframe.sources import writers as W
from tickframe.streaming import jobs


def record(i, when="2024-01-01T00:00:00.000Z", price=10.0, **more):
    return {"id": i, "name": f"coin {i}", "symbol": i.upper(), "current_price": price, "last_updated": when,
            "price_change_percentage_24h": 1.0, "market_cap": price * 100, **more}


def land(folder, name, records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(100)
    big = spark.range(1_000_000).withColumnRenamed("id", "k")
    for bound, hinted in ((100, True), (99, False)):
        side = broadcast_if_small(df, bound)
        plan = big.join(side, big.k == side.id)._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) is hinted


def test_market_scan_and_rows(spark, tmp_path):
    land(tmp_path / "m", "a.json", [record("a", price=5.0), record("b", price=9.0, extra=1), record("c", when="soon")])
    top = R.scan_market_top(spark, str(tmp_path / "m"), 2).collect()
    assert [r.id for r in top] == ["c", "b"]
    rows = R.market_rows(R.scan_market(spark, str(tmp_path / "m")))
    assert rows.columns == MARKET.fieldNames()
    got = {r.id: r for r in rows.collect()}
    assert got["a"].last_updated == dt.datetime(2024, 1, 1) and got["c"].last_updated is None
    assert got["b"].price_day_2 == pytest.approx(9 * 1.01**2)


def test_csv_per_symbol_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("my coin", "2024-01-01", 1.5), ("my coin", "2024-01-02", None), ("b", "2024-01-01", 3.0)],
        "symbol string, timestamp string, price double",
    )
    path = str(tmp_path / "csv")
    W.write_csv_per_symbol(df, path)
    assert (tmp_path / "csv" / "symbol=my_coin").is_dir()
    back = R.scan_prices_csv(spark, path).orderBy("symbol", "ts").collect()
    assert [(r.symbol, r.price) for r in back] == [("b", 3.0), ("my_coin", 1.5), ("my_coin", None)]
    assert back[0].ts == dt.datetime(2024, 1, 1)


def test_single_csv_files_name_their_symbol(spark, tmp_path):
    (tmp_path / "BTC.csv").write_text("Timestamp,price\n2024-01-01 10:00:00,7.5\nrubbish,x\n")
    rows = R.scan_prices_csv(spark, str(tmp_path / "*.csv")).collect()
    assert [(r.symbol, r.price) for r in rows] == [("BTC", 7.5), ("BTC", None)]
    assert rows[0].ts == dt.datetime(2024, 1, 1, 10) and rows[1].ts is None


def test_json_table_lines_and_document(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert R.scan_json_table(spark, str(tmp_path / "doc.json"), "a int", multi_line=True).count() == 2
    W.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'


def test_symbol_list(spark, tmp_path):
    (tmp_path / "s.txt").write_text("BTC-USD\n\n  ETH-USD \n\t\nXRP-USD\n")
    assert [r.symbol for r in R.scan_symbol_list(spark, str(tmp_path / "s.txt")).collect()] == ["BTC-USD", "ETH-USD", "XRP-USD"]
    assert R.symbol_list(spark, ["A", "B"]).count() == 2


def test_points_since(spark):
    df = spark.createDataFrame(
        [("m", dt.datetime(2024, 1, d)) for d in range(1, 11)] + [("n", dt.datetime(2024, 1, 9))],
        "measurement string, time timestamp_ntz",
    )
    assert R.scan_points_since(df, "m", 3, as_of="2024-01-10").count() == 4
    assert R.scan_points_since(df, None, 1, as_of="2024-01-10").count() == 3
    assert R.scan_points_since(df, "m", 7).count() == 0


def test_parse_records(spark):
    bodies = ['[{"symbol":"a","text":"x"},{"symbol":"b"}]', "{}", "[]", "nope", '[{"symbol":" ","text":"y"}]']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    out = R.parse_json_records(df, "body", "symbol string, text string", ["symbol", "text"], keep=["i"])
    assert sorted((r.i, r.valid) for r in out.collect()) == [(0, False), (0, True), (1, False), (2, False), (3, False), (4, False)]


def test_points_from_nested_cells(spark):
    df = spark.sql(
        "select timestamp_ntz'2024-01-01' as time, 1 as n, 'x' as s, named_struct('a', 1, 'b', 2.5) as col, "
        "map('k', 3.0d) as m, cast(null as double) as gone union all "
        "select timestamp_ntz'2024-01-02', 2, null, null, null, null"
    )
    assert set(X.flatten_fields(df).columns) == {"time", "n", "s", "col_a", "col_b", "m", "gone"}
    got = sorted((str(r.time)[:10], r.field, r.value, r.text) for r in X.flatten_points(df, "p").collect())
    assert got == [
        ("2024-01-01", "col_a", 1.0, None), ("2024-01-01", "col_b", 2.5, None), ("2024-01-01", "m_k", 3.0, None),
        ("2024-01-01", "n", 1.0, None), ("2024-01-01", "s", None, "x"), ("2024-01-02", "n", 2.0, None),
    ]


def test_points_land_by_measurement_and_day(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-01' as time, 1.0d as v")
    path = str(tmp_path / "points")
    W.write_points(X.flatten_points(df, "p"), path)
    assert (tmp_path / "points" / "measurement=p" / "date=2024-01-01").is_dir()
    assert W.read_points(spark, path).count() == 1


def test_json_shapes(spark, series):
    row = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' as t, date'2024-01-02' as d, cast(null as int) as n, 1.5d as x")
    assert X.json_rows(row).first()[0] == '{"t":"2024-01-01T10:00:00","d":"2024-01-02","n":null,"x":1.5}'
    bars = series({"a": [1, 2, 3], "b": [5, 6, None]}, name="close")
    got = {r.symbol: json.loads(r.json) for r in X.columnar_json(
        bars, ["close"], "2024-01-02", "2024-01-04", step_seconds=86_400).collect()}
    assert got["a"] == {"ts": ["2024-01-02", "2024-01-03"], "close": [2.0, 3.0]}
    assert got["b"]["close"] == [6.0, None]
    parts = X.columnar_json(bars, ["close"], step_seconds=86_400, points=2).where("symbol = 'a'").orderBy("part").collect()
    assert len(parts) > 1 and len({r.part for r in parts}) == len(parts)
    whole = json.loads(X.columnar_json(bars, ["close"], step_seconds=86_400).where("symbol = 'a'").first().json)
    assert [v for r in parts for v in json.loads(r.json)["close"]] == whole["close"]


def test_prediction_table(spark, tmp_path):
    name = "predictions_test"
    W.ensure_table(spark, name, PREDICTIONS, path=str(tmp_path / "t"))
    df = spark.createDataFrame([("a", [1.5, 2.0]), ("b", [])], "symbol string, prices array<double>")
    W.append_table(X.prediction_rows(df, "r1"), name, PREDICTIONS)
    again = W.ensure_table(spark, name, PREDICTIONS)
    assert sorted((r.cryptocurrency, r.predicted_price) for r in again.collect()) == [("a", 1.5), ("b", None)]
    assert again.select("id").distinct().count() == 2
    plain = X.prediction_rows(df.selectExpr("symbol", "7 as prices"), "r1")
    assert {r.predicted_price for r in plain.collect()} == {7.0}
    with pytest.raises(ValueError):
        W.ensure_table(spark, name, MARKET)


def test_latest_view_versions_and_replay(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "id string, last_updated int, seq int, price double"

    def put(n, rows):
        W.append_changes(spark.createDataFrame(rows, schema), root, n)

    def view(df):
        return sorted((r.id, r.price) for r in df.collect())

    with pytest.raises(FileNotFoundError):
        W.read_latest(spark, root)
    put(0, [("a", 1, 0, 1.0), ("b", 1, 1, 2.0)])
    put(1, [("a", 2, 0, None)])
    want = [("a", None), ("b", 2.0)]
    assert view(W.read_latest(spark, root)) == want
    put(1, [("a", 2, 0, None)])
    assert view(W.read_latest(spark, root)) == want
    assert W.compact(spark, root) == 1 and W.committed_version(spark, root) == 1
    put(2, [("b", 1, 0, 9.0), ("c", 0, 0, 3.0)])
    assert view(W.read_latest(spark, root)) == [("a", None), ("b", 9.0), ("c", 3.0)]
    assert view(W.read_version(spark, root)) == want
    assert W.compact(spark, root) == 2 == W.compact(spark, root)
    # a version whose write did not finish is not read
    (tmp_path / "store" / "base" / "version=7").mkdir()
    assert W.committed_version(spark, root) == 2


def test_stream_upsert_is_idempotent(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    land(landing, "1.json", [record("a"), record("b")])

    def run():
        jobs.stream_upsert(
            spark, str(landing), root, root + "/checkpoint", points=root + "/points", serve=True, once=True
        ).awaitTermination()

    run()
    land(landing, "2.json", [record("a", "2024-01-01T00:05:00.000Z", 20.0), record("a", price=10.0)])
    run()
    run()
    latest = {r.id: r.current_price for r in W.read_version(spark, root).collect()}
    assert latest == {"a": 20.0, "b": 10.0}
    points = W.read_points(spark, root + "/points")
    assert points.where("field = 'current_price' and measurement = 'a'").count() == 3


def test_last_to_arrive_wins_whatever_the_size_of_its_file(spark, tmp_path):
    for large in (False, True):
        landing, root = tmp_path / f"landing{large}", str(tmp_path / f"store{large}")
        filler = [record(f"x{k}") for k in range(400)]
        land(landing, "1.json", [record("a", price=1.0), record("b", price=1.0), record("b", price=2.0)] + ([] if large else filler))
        os.utime(landing / "1.json", (1_700_000_000, 1_700_000_000))
        land(landing, "2.json", ([record("a", price=3.0)] + filler if large else []) + [record("a", price=2.0)])
        jobs.stream_upsert(spark, str(landing), root, root + "/checkpoint", once=True).awaitTermination()
        latest = {r.id: r.current_price for r in W.read_latest(spark, root).where("id in ('a', 'b')").collect()}
        assert latest == {"a": 2.0, "b": 2.0}


def test_log_keeps_no_derived_columns_and_points_are_shuffled_as_changes(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    land(landing, "1.json", [record("a"), record("b", "2024-02-01T00:00:00.000Z", 20.0), record("c", price_change_percentage_24h=None)])
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    jobs.stream_upsert(
        spark, str(landing), root, root + "/checkpoint", points=root + "/points", serve=True, once=True
    ).awaitTermination()
    log = spark.read.parquet(root + "/log")
    base = spark.read.parquet(root + "/base")
    assert not {"expected_return", "price_day_1", "price_day_7"} & {*log.columns, *base.columns}
    for view in (W.read_latest(spark, root), W.read_version(spark, root)):
        assert view.columns[: len(MARKET)] == MARKET.names
        got = {r.id: (r.expected_return, r.price_day_7) for r in view.collect()}
        assert got["b"] == pytest.approx((1.01, 20 * 1.01**7)) and got["c"] == (None, None)
    points = {(r.measurement, r.field): (r.value, str(r.month)) for r in W.read_points(spark, root + "/points").collect()}
    assert len(points) == 11 + 11 + 2 and points["a", "price_day_2"] == (pytest.approx(10 * 1.01**2), "2024-01-01")
    assert points["b", "expected_return"] == (pytest.approx(1.01), "2024-02-01")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before


def test_stream_dedupe_keeps_late_coins_and_bad_times(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    polls = [
        [record("a", "2024-01-01T12:00:00Z"), record("a", "2024-01-01T12:00:00Z"), record("d", "garbled", 1.0)],
        [record("b", "2024-01-01T09:00:00Z"), record("a", "2024-01-01T12:05:00Z"), record("d", "garbled", 2.0)],
        [record("c", "2023-01-01T10:00:00Z"), record("a", "2024-01-01T12:00:00Z"), record("d", "garbled", 2.0)],
    ]
    for k, rows in enumerate(polls):
        land(landing, f"{k}.json", rows)
        for _ in range(2):
            jobs.stream_dedupe(spark, str(landing), out, out + "-cp", once=True).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted((r.id, r.last_updated.hour, r.last_updated.minute) for r in rows.collect()) == [
        ("a", 12, 0), ("a", 12, 5), ("b", 9, 0), ("c", 10, 0)
    ]
    bad = spark.read.parquet(out + "-quarantine").collect()
    assert sorted((r.id, json.loads(r.record)["current_price"]) for r in bad) == [("d", 1.0), ("d", 2.0)]


def test_stream_dedupe_keeps_no_state_and_may_run_a_batch_again(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    for k in range(4):
        land(landing, f"{k}.json", [record(c, f"2024-01-0{d}T12:00:00Z") for c in "ab" for d in range(1, k + 2)])
        run = jobs.stream_dedupe(spark, str(landing), out, out + "-cp", once=True)
        run.awaitTermination()
        assert all(not p["stateOperators"] for p in run.recentProgress)
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("id", "last_updated").distinct().count() == 8
    assert sorted({r.batch_id for r in rows.select("batch_id").collect()}) == [0, 1, 2, 3]
    # batch 3 once more: what it wrote itself does not count as written before
    again = rows.where("batch_id = 3").drop("batch_id").union(rows.where("batch_id = 1").drop("batch_id"))
    fresh = jobs._new_rows(again, out, 3, ["id", "last_updated"], "month")
    assert sorted((r.id, r.last_updated.day) for r in fresh.collect()) == [("a", 4), ("b", 4)]


def test_dedupe_writes_few_files_and_sorts_no_history(spark, tmp_path, capsys):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    rows = spark.range(0, 4000, numPartitions=4).selectExpr(
        "concat('c', id % 800) as id", "date_format(timestamp'2024-01-01' + make_interval(0, id % 5), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as last_updated"
    )
    rows.write.mode("append").json(str(landing))
    jobs.stream_dedupe(spark, str(landing), out, out + "-cp", once=True).awaitTermination()
    files = list((tmp_path / "out").rglob("part-*.parquet"))
    written = spark.read.parquet(out)
    assert written.count() == 800 and len(files) == len({f.parent for f in files})
    fresh = jobs._new_rows(written.drop("batch_id"), out, 1, ["id", "last_updated"], "month")
    assert fresh.count() == 0
    fresh.explain()
    assert "ShuffledHashJoin" in capsys.readouterr().out


def test_dedupe_reads_only_the_days_it_brings(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    rows = spark.range(300).selectExpr("cast(id as string) as id", "timestamp'2024-01-01' + make_interval(0,0,0,id) as last_updated")
    rows = rows.withColumn("date", rows.last_updated.cast("date"))
    rows.write.partitionBy("date").parquet(f"{out}/batch_id=0")
    batch = rows.where("id in ('7', '8')").union(rows.selectExpr("'new'", "last_updated", "date").where("date = '2024-01-08'"))
    fresh = jobs._new_rows(batch, out, 1, ["id", "last_updated"], "date")
    assert [r.id for r in fresh.collect()] == ["new"]
    fresh.explain()
    filters = capsys.readouterr().out.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "2024-01-08" in filters and "2024-01-09" in filters and "2024-01-07" not in filters


def test_stores_are_pruned_by_day(spark, tmp_path, capsys):
    rows = spark.range(400).selectExpr(
        "concat('m', id % 2) as measurement", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,id) as time", "cast(id as double) as value"
    )
    path = str(tmp_path / "points")
    W.write_points(rows, path)
    points = W.read_points(spark, path)
    near = R.scan_points_since(points, "m1", 2, as_of="2024-01-10")
    assert near.count() == rows.where("measurement = 'm1' and time >= '2024-01-08'").count()
    near.explain()
    shown = capsys.readouterr().out
    assert "PartitionFilters" in shown and "(date#" in shown.split("PartitionFilters")[1].split("]")[0]
    days = "cast(col1 as timestamp_ntz) as start, cast(col2 as timestamp_ntz) as stop"
    windows = spark.sql(
        f"select measurement, w, {days} from values ('m0', 1, '2024-01-03 22:00', '2024-01-04 02:00'), ('m0', 2, '2024-01-03', '2024-01-05'), "
        "('m1', 3, '2024-01-05', '2024-01-05') as t(measurement, w, col1, col2)"
    )
    windows.write.parquet(str(tmp_path / "windows"))
    got = R.scan_points_windows(points, spark.read.parquet(str(tmp_path / "windows")))
    want = [(1, float(v)) for v in (70, 72)] + [(2, float(v)) for v in range(48, 96, 2)]
    assert sorted((r.w, r.value) for r in got.select("w", "value").collect()) == want
    got.explain()
    assert "dynamicpruning" in capsys.readouterr().out
    bars = rows.withColumnsRenamed({"measurement": "symbol", "time": "ts"})
    W.write_dated(bars, str(tmp_path / "bars"), ["symbol"])
    part = date_range(spark.read.parquet(str(tmp_path / "bars")), "2024-01-02", "2024-01-04")
    assert part.count() == 48
    part.explain()
    assert "(date#" in capsys.readouterr().out.split("PartitionFilters")[1].split("]")[0]


def test_stream_bars_take_late_ticks_and_open_intervals(spark, tmp_path):
    landing, out = str(tmp_path / "ticks"), str(tmp_path / "bars")

    def land_ticks(rows):
        df = spark.createDataFrame(rows, "tick_id bigint, symbol string, t string, price double")
        df.selectExpr("tick_id", "symbol", "cast(t as timestamp_ntz) as ts", "price").coalesce(1).write.mode("append").parquet(landing)

    def run():
        jobs.stream_bars(spark, landing, out, out + "-cp", "1 hour", once=True).awaitTermination()

    land_ticks([(1, "a", "2024-01-01 00:05:00", 5.0), (2, "a", "2024-01-01 00:30:00", 7.0), (3, "a", "2024-01-01 02:30:00", 1.0)])
    run()
    land_ticks([(4, "a", "2024-01-01 00:40:00", 99.0), (5, "a", "2024-01-01 05:00:00", 2.0), (6, "a", "2024-01-01 05:01:00", None)])
    run()
    got = {r.ts.hour: (r.open, r.high, r.low, r.close, r.ticks) for r in jobs.read_bars(spark, out).collect()}
    assert got == {0: (5.0, 99.0, 5.0, 99.0, 3), 2: (1.0, 1.0, 1.0, 1.0, 1), 5: (2.0, 2.0, 2.0, 2.0, 1)}
    batch = ohlc_bars(spark.read.parquet(landing).where("price is not null"), "1 hour")
    assert {r.ts.hour: (r.open, r.high, r.low, r.close) for r in batch.collect()} == {h: v[:4] for h, v in got.items()}


def test_conform_fills_missing(spark):
    got = conform(spark.range(1), PREDICTIONS).first()
    assert tuple(got) == (0, None, None)


def test_files_per_symbol_do_not_grow_with_tasks(spark, tmp_path):
    out = str(tmp_path / "csv")
    rows = spark.range(0, 400, numPartitions=16).selectExpr("concat('s ', id % 3) as symbol", "id as price")
    W.write_csv_per_symbol(rows, out)
    files = [p for p in (tmp_path / "csv").rglob("part-*.csv")]
    assert len(files) == 3 and spark.read.option("header", True).csv(out).count() == 400
