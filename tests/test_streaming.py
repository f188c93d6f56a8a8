"""Streams run to their end over files, and the admission rule against a plain loop."""

import datetime as dt
import random
import time

from textloom.streaming import admission, exports, jobs

NOW = dt.datetime(2024, 3, 1)


def stream(spark, tmp_path, rows, schema):
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return jobs.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema), 1)


def test_daily_usage(spark, tmp_path):
    rows = [(NOW + dt.timedelta(hours=i), "ko", "không") for i in range(50)]
    source = stream(spark, tmp_path, rows, "ts timestamp, abbr string, expanded_chosen string")
    out = jobs.snapshots(jobs.daily_usage(source, "3 days"), ["usage_date", "abbr", "expanded_chosen"], f"{tmp_path}/out")
    assert sorted((r.usage_date.day, r.usage_count) for r in out.collect()) == [(1, 24), (2, 24), (3, 2)]


def test_replays(spark, tmp_path):
    """Thirty seconds from the last one that counted; repeats don't prolong them, failures aren't remembered."""
    rows = [(NOW + dt.timedelta(seconds=s), "ko", "g", s, True) for s in (0, 10, 20, 30, 31, 45, 61, 62)] + [(NOW, "dk", "g", 100, False), (NOW + dt.timedelta(seconds=5), "dk", "g", 105, True), (NOW + dt.timedelta(seconds=9), "dk", "g", 109, False)]
    source = stream(spark, tmp_path, rows, "ts timestamp, abbr string, domain string, request_id long, ok boolean")
    out = jobs.appended(jobs.without_replays(source), f"{tmp_path}/out")
    assert sorted((r.abbr, r.request_id) for r in out.collect()) == [("dk", 100), ("dk", 105), ("ko", 0), ("ko", 31), ("ko", 62)]


def test_replays_over_batches(spark, tmp_path):
    """State lasts from one micro-batch to the next, and is gone once the watermark has passed its term."""
    for i, seconds in enumerate(((0,), (20, 40), (300,), (310, 331))):
        rows = [(NOW + dt.timedelta(seconds=s), "ko", "g", s, True) for s in seconds]
        spark.createDataFrame(rows, "ts timestamp, abbr string, domain string, request_id long, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    source = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in"), 1)
    out = jobs.appended(jobs.without_replays(source), f"{tmp_path}/out")
    assert sorted(r.request_id for r in out.collect()) == [0, 40, 300, 331]


def test_admission(spark, tmp_path):
    pick = random.Random(0)
    rows = [(NOW + dt.timedelta(seconds=i * 2 + pick.random()), "acc", f"u{pick.randrange(3)}", i, pick.choice([0.5, 3.0, None])) for i in range(60)]
    source = stream(spark, tmp_path, rows, "ts timestamp, account string, owner string, request_id long, took double")
    out = {r.request_id: r.admitted for r in jobs.appended(admission.admitted(source.coalesce(1)), f"{tmp_path}/out").collect()}
    held, good = [], {}
    for ts, _, owner, request, took in rows:
        now = ts.replace(tzinfo=dt.UTC).timestamp()
        recent = [h for h in held if h[1] > now - 60 or h[2] > now]
        live = [h for h in recent if h[2] > now]
        good[request] = len(recent) < 30 and sum(h[0] == owner for h in recent) < 10 and len(live) < 4 and sum(h[0] == owner for h in live) < 2
        if good[request]:
            held.append((owner, now, now + (91 if took is None else min(took, 91))))
    assert out == good and 0 < sum(good.values()) < 60


def test_breaker(spark, tmp_path):
    rows = [(NOW + dt.timedelta(seconds=s), 1, s, status, after) for s, status, after in ((0, 200, None), (1, 429, 5), (3, 200, None), (7, 200, None), (8, 429, None), (60, 200, None), (69, 200, None))]
    rows.append((NOW + dt.timedelta(seconds=9), 2, 9, 200, None))
    source = stream(spark, tmp_path, rows, "ts timestamp, account long, call_id long, status int, retry_after int")
    out = jobs.appended(jobs.breaker(source), f"{tmp_path}/out")
    assert {r.call_id: r.blocked for r in out.collect()} == {0: False, 1: False, 3: True, 7: False, 8: False, 60: True, 69: False, 9: False}


def test_bursts_of_edits(spark, tmp_path):
    """The highest version of a burst stands, also if it came out of order; the last burst is still open."""
    rows = [(NOW + dt.timedelta(milliseconds=ms), "s", text, version) for ms, text, version in ((0, "a", 1), (300, "abc", 3), (500, "ab", 2), (5000, "x", 4), (60_000, "y", 5))]
    source = stream(spark, tmp_path, rows, "ts timestamp, session_id string, text string, version long")
    out = jobs.appended(jobs.latest_versions(source), f"{tmp_path}/out")
    assert sorted((r.version, r.text) for r in out.collect()) == [(3, "abc"), (4, "x")]


def test_revisions(spark, tmp_path):
    """A reader sees whole revisions; a repeated batch changes nothing; what was cut off isn't seen."""
    folder, schema = f"{tmp_path}/export", "abbr string, expanded string, updated_at int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert exports.read_revision(spark, folder, schema).count() == 0
    assert exports.publish(rows(("ko", "không", 1)), folder, 0)
    before = exports.read_revision(spark, folder, schema)
    rows(("cut", "off", 9)).write.parquet(f"{folder}/data/000000000001-cut-off")  # a writer that was lost before its manifest
    assert exports.publish(rows(("ko", "không", 1), ("dc", "được", 2)), folder, 1)
    assert not exports.publish(rows(("again", "again", 3)), folder, 1)
    assert [r.abbr for r in before.collect()] == ["ko"]
    assert sorted(r.abbr for r in exports.read_revision(spark, folder, schema).collect()) == ["dc", "ko"]
    assert [r.abbr for r in exports.read_revision(spark, folder, schema, 0).collect()] == ["ko"]
    assert sorted((r.revision, r.n_rows) for r in exports.revisions(spark, folder).collect()) == [(0, 1), (1, 2)]
