"""Dictionaries, mutations, evidence and the store's reads."""

import datetime as dt
import hmac

import pytest
from pyspark.sql import functions as F

from textloom.operators import dictionary, evidence, mining, mutate, store
from textloom.sources import readers, writers
from textloom.streaming import jobs

NOW = dt.datetime(2024, 3, 1, 12)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_layers_and_phrases(spark):
    layer = lambda *r: spark.createDataFrame(list(r), "abbr string, domain string, expanded string")
    out = dictionary.layered([layer(("Ko", "g", "a"), ("x", "g", "b")), layer(("ko ", "g", "c"))], ["abbr", "domain"])
    assert rows(out) == [("ko", "g", "c"), ("x", "g", "b")]
    phrase = lambda *r: spark.createDataFrame(list(r), "phrase string, expanded string, source string, confidence string")
    table = dictionary.phrase_table([phrase(("a  B", "m", "mined", "0")), phrase(("a b", "o", "override", None), ("one", "x", None, None)), phrase(("a b c d e f", "y", "db", "1"))])
    assert [(r.phrase, r.expanded, r.n, r.priority) for r in table.collect()] == [("a b", "o", 2, 3)]
    with pytest.raises(ValueError):
        dictionary.phrase_table([], 1)


def test_usage(spark):
    usage = spark.createDataFrame([("ko", "không", dt.date(2024, 2, d), 2, "live") for d in (1, 20, 29)], "abbr string, expanded_chosen string, usage_date date, usage_count long, source_kind string")
    assert rows(store.top_usage(usage, dt.date(2024, 3, 1), 10)) == [("ko", "không", 4, dt.date(2024, 2, 29), 2)]
    assert store.daily_usage(usage, dt.date(2024, 3, 1), 1).count() == 1
    with pytest.raises(ValueError):
        store.top_usage(usage, dt.date(2024, 3, 1), 366)
    merged = mutate.merge_usage(usage, usage.filter("usage_date = '2024-02-01'"))
    assert rows(merged.select("usage_count")) == [(2,), (2,), (4,)]


def test_roles(spark):
    users = spark.createDataFrame([("1", "an", "a@x", None), ("2", "bo", "b@x", NOW)], "id string, username string, email string, locked_until timestamp")
    roles = spark.createDataFrame([("r1", "user"), ("r2", "admin")], "id string, role_name string")
    owned = spark.createDataFrame([("1", "r1"), ("1", "r2")], "user_id string, role_id string")
    out = {r.username: r.roles_csv for r in store.with_roles(users, owned, roles).collect()}
    assert out == {"an": "admin,user", "bo": None}
    assert rows(store.assign(users, roles, "bo", "user")) == [("2", "r1")] and store.assign(users, roles, "bo", "none").count() == 0
    assert store.find_user(users, "a@x").first().id == "1"
    assert [r[0] for r in users.orderBy("id").select(store.is_locked(NOW - dt.timedelta(hours=1))).collect()] == [False, True]


def test_terms(spark):
    docs = spark.createDataFrame([(1, "toi dk hoc phan"), (2, "adkb xyz thoi khoa bieu")], "doc_id int, text string")
    terms = spark.createDataFrame([("dk",), ("thoi khoa",), ("hoc phan",)], "term string")
    assert rows(store.select_terms(docs, terms)) == [(1, "dk"), (1, "hoc phan"), (2, "thoi khoa")]


def test_submissions(spark):
    t = lambda m: NOW + dt.timedelta(minutes=m)
    events = [(t(0), "Ko", "g", "u1", None), (t(2), "ko", "g", "u2", "b"), (t(1), "ko ", "g", "u3", "a"), (t(3), "ko", "g", "u4", "b")]
    (r,) = mutate.fold_submissions(spark.createDataFrame(events, "ts timestamp, abbr string, domain string, user_id string, suggestion string")).collect()
    assert (r.abbr, r.submission_count, r.submitted_by, r.suggestions) == ("ko", 4, "u1", ["a", "b"])


def test_moderation(spark):
    pending = spark.createDataFrame([("1", "PENDING", "m", None), ("2", "PENDING", None, None), ("3", "PENDING", "x", None), ("4", "REJECTED", "y", None)], "id string, status string, suggested string, reviewed_by string")
    decisions = [(1, "1", "APPROVE", "a", " n "), (2, "1", "APPROVE", "b", None), (1, "2", "APPROVE", "a", None), (1, "3", "APPROVE", "a", None), (2, "3", "REJECT", "b", None), (1, "4", "APPROVE", "a", None)]
    out = mutate.moderate(pending, spark.createDataFrame(decisions, "ts int, id string, action string, reviewer string, expanded string"))
    assert rows(out.fillna("-")) == [("1", "APPROVED", "n", "a"), ("2", "PENDING", "-", "-"), ("3", "REJECTED", "x", "b"), ("4", "REJECTED", "y", "-")]


def test_upserts(spark):
    schema = "abbr string, domain string, expanded string, alternatives array<string>, approved_by string"
    state = spark.createDataFrame([("ko", "g", "không", ["ko"], "json_seed"), ("mn", "g", "mọi người", ["miền"], "anna")], schema)
    seed = spark.createDataFrame([("ko", "g", "kô", ["ko", "x"], "json_seed"), ("mn", "g", "mẹ nó", [], "json_seed"), ("z", "g", "zz", [], "json_seed")], schema)
    out = {r.abbr: (r.expanded, r.alternatives) for r in mutate.upsert_seed(state, seed).collect()}
    assert out == {"ko": ("không", ["ko", "kô", "x"]), "mn": ("mọi người", ["miền"]), "z": ("zz", [])}
    assert {r.abbr: r.expanded for r in mutate.upsert_admin(state, seed).collect()} == {"ko": "kô", "mn": "mẹ nó", "z": "zz"}
    mine = "user_id string, abbr string, domain string, expanded string, alternatives array<string>"
    over = mutate.upsert_override(spark.createDataFrame([("u", "a", "g", "old", ["b"])], mine), spark.createDataFrame([("u", "a", "g", "new", ["b", "c"])], mine)).first()
    assert (over.expanded, over.alternatives) == ("new", ["old", "b", "c"])


def test_rewrites(spark):
    state = spark.createDataFrame([("u", "k", "1", 1), ("u", "l", "2", 1)], "user_id string, k string, v string, updated_at int")
    changes = spark.createDataFrame([("u", "k", "9", 2, False), ("u", "l", None, 2, True)], "user_id string, k string, v string, updated_at int, gone boolean")
    assert rows(mutate.last_wins(state, changes, ["user_id", "k"], deleted="gone")) == [("u", "k", "9", 2)]
    table = spark.createDataFrame([("1", True, "a"), ("2", True, "b")], "id string, is_active boolean, name string")
    assert rows(mutate.deactivate(table, table.filter("id = '1'"))) == [("1", False, "a"), ("2", True, "b")]
    assert rows(mutate.conditional_update(table, spark.createDataFrame([("2", "c")], "id string, name string"), "id", ["name"])) == [("1", True, "a"), ("2", True, "c")]
    assert rows(mutate.delete_rows(table, table.filter("id = '1'"), ["id"])) == [("2", True, "b")]
    gone = mutate.delete_user("u", {"p": state}, {"r": (state.withColumnRenamed("user_id", "by"), ["by"])})
    assert gone["p"].count() == 0 and {r.by for r in gone["r"].collect()} == {None}


def test_sessions_logins_retention(spark):
    later, past = NOW + dt.timedelta(days=1), NOW - dt.timedelta(days=100)
    s = spark.createDataFrame([("1", "u", "h", later, None, True), ("2", "v", "i", past, None, True)], "id string, user_id string, token_hash string, expires_at timestamp, revoked_at timestamp, is_active boolean")
    assert [r.id for r in store.active_sessions(s, NOW).collect()] == ["1"]
    assert rows(mutate.end_sessions(s, NOW, user_id="u").select("id", "is_active")) == [("1", False), ("2", False)]
    t = lambda m: NOW + dt.timedelta(minutes=m)
    tries = spark.createDataFrame([(t(i), "u", ok) for i, ok in enumerate([False] * 5 + [True, False])], "ts timestamp, user_id string, ok boolean")
    out = mutate.failed_logins(tries).orderBy("ts").collect()
    assert [r.failures for r in out] == [1, 2, 3, 4, 5, 0, 1] and [r.locked_until is not None for r in out] == [False] * 4 + [True, False, False]
    old = spark.createDataFrame([(past, past), (NOW, later), (None, None)], "created_at timestamp, expires_at timestamp")
    given = dict(history=old, errors=old, cache=old, sessions=old, as_of=NOW)
    assert rows(store.retention_counts(**given)) == [("cache", 1), ("errors", 1), ("history", 0), ("sessions", 1)]
    assert {k: v.count() for k, v in store.retention_keep(**given).items()} == {"history": 3, "errors": 2, "cache": 2, "sessions": 2}


def _evidence(spark, items):
    schema = "ts int, abbr string, meaning string, domain string, context string, request_id string, user_id string, session_id string, confidence double, from_cache boolean, retry boolean, reused boolean"
    return spark.createDataFrame([(i, "ct", m, "g", c, r, u, s, 0.9, False, False, False) for i, (m, c, r, u, s) in enumerate(items)], schema)


def test_evidence(spark):
    same = [("chia tay", f"ct voi em{'!' * i}", f"r{i}", "u", f"s{i}") for i in range(3)]
    assert evidence.candidates(evidence.distinct_evidence(_evidence(spark, same), "k")).first().evidence_count == 1
    good = [("chia tay", f"ct voi em {w}", f"r{w}", f"u{w}", f"s{w}") for w in "abc"]
    found = evidence.distinct_evidence(_evidence(spark, good), "k")
    assert evidence.candidates(found).first().status == "conditional_shared"
    assert evidence.reusable(evidence.candidates(found)).count() == 1
    rival = [*good, ("cong ty", "ct voi em x", "rx", "ux", "sx")]
    assert {r.status for r in evidence.candidates(evidence.distinct_evidence(_evidence(spark, rival), "k")).collect()} == {"needs_review"}
    gone = evidence.candidates(found).limit(1)
    assert evidence.candidates(found, revoked=gone).first().status == "revoked"
    short = [("chia tay", "ct", f"r{w}", f"u{w}", f"s{w}") for w in "abc"]
    assert {r.status for r in evidence.candidates(evidence.distinct_evidence(_evidence(spark, short), "k")).collect()} == {"candidate"}


def test_evidence_hides_ids_and_literals(spark):
    """Hashes are keyed; contexts that differ in a number or an address alone are one."""
    items = [("chia tay", f"ct voi em luc {t}", f"r{i}", f"u{i}", f"s{i}") for i, t in enumerate(["10:30", "11:45", "www.kho.vn/x"])]
    found = evidence.distinct_evidence(_evidence(spark, items), "one").collect()
    assert len(found) == 1 and found[0].user_id == hmac.new(b"one", b"user_id\0u0", "sha256").hexdigest()
    other = evidence.distinct_evidence(_evidence(spark, items), "x" * 80).first()
    assert other.request_id == hmac.new(b"x" * 80, b"request_id\0r0", "sha256").hexdigest() and other.context_key != found[0].context_key
    cut = spark.range(1).select(evidence.redact(F.lit("xin ct voi em nhe"), F.lit("ct"))).first()[0]
    assert cut == "ct > voi em"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿no_diacritics,with_diacritics,extra\n toi ,tôi,1\n,x,2\n", encoding="utf-8")
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n", encoding="utf-8")
    got = readers.pairs(spark, str(tmp_path / "a.csv"), weights={"a.csv": 3.0}).collect()
    assert [(r.no_diacritics, r.with_diacritics, r.weight) for r in got] == [("toi", "tôi", 3.0)]
    with pytest.raises(ValueError):
        readers.pairs(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.txt").write_text("ko\tkhông\ndk  đăng ký  x\nnothing\n", encoding="utf-8")
    assert rows(readers.teencode(spark, str(tmp_path / "t.txt"))) == [("dk", "đăng ký  x"), ("ko", "không")]
    (tmp_path / "e.txt").write_text("# group: Smileys\n# subgroup: face\n1F600 ; fully-qualified # x\n# subgroup: other\n1F468 200D 1F469 ; minimally-qualified # y\n", encoding="utf-8")
    assert [tuple(r) for r in readers.emoji_test(spark, str(tmp_path / "e.txt")).collect()] == [("😀", "fully-qualified", "Smileys", "face"), ("👨‍👩", "minimally-qualified", "Smileys", "other")]
    (tmp_path / "s.txt").write_text("# Version: 16\n231A..231B ; Basic_Emoji ; watch # z\n1F1E6 1F1E8 ; Flag ; f # z\n", encoding="utf-8")
    assert [tuple(r) for r in readers.emoji_sequences(spark, str(tmp_path / "s.txt")).collect()] == [("Basic_Emoji", 0x231A, 0x231B, None), ("Flag", None, None, "🇦🇨")]
    assert rows(readers.file_header(spark, str(tmp_path / "s.txt"))) == [("Version", "16")]
    (tmp_path / "j.json").write_text('{"abbreviations": [{"abbr": "KO", "expanded": "không", "alternative_expansions": ["k"]}, {"abbr": "x", "expanded": "y", "approved": false}]}', encoding="utf-8")
    assert rows(readers.abbreviations(spark, str(tmp_path / "j.json"))) == [("ko", "không", '["k"]', "general", "json_seed")]
    (tmp_path / "p.json").write_text('{"phrases": [{"phrase": "A b", "expanded": "c", "confidence": 0}]}', encoding="utf-8")
    assert rows(readers.phrases(spark, str(tmp_path / "p.json"), "mined")) == [("a b", "c", "mined", "1.0")]
    (tmp_path / "broken.json").write_text("{", encoding="utf-8")
    assert readers.phrases(spark, str(tmp_path / "broken.json"), "mined").count() == 0
    (tmp_path / "y.json").write_text('{"entries": [{"wrong": "xing", "correct": "xin"}]}', encoding="utf-8")
    assert readers.typos(spark, str(tmp_path / "y.json")) == {"xing": "xin"}


def test_writers(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "á")], "no_diacritics string, with_diacritics string")
    writers.corpus_csv(pairs, str(tmp_path / "c"))
    assert rows(readers.pairs(spark, str(tmp_path / "c")).select("no_diacritics", "with_diacritics")) == [("a", "á")]
    results = spark.createDataFrame([(1, "a", "A", ["ABBR"])], "doc_id int, text string, normalized_text string, error_types array<string>")
    writers.append(writers.history_rows(results, "2024-01-01 00:00:00"), str(tmp_path / "h"))
    writers.append(writers.history_rows(results, "2024-01-01 00:00:00"), str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.select("id").distinct().count() == 1 and back.select(writers.error_types("error_types_json")).first()[0] == ["ABBR"]
    assert spark.createDataFrame([("{",)], "j string").select(F.size(writers.error_types("j"))).first()[0] == 0


def test_seeded_sample(spark):
    """The same rows for the same seed, however the table is dealt; others for another seed."""
    rows = spark.range(200).withColumnRenamed("id", "key")
    take = lambda df, seed: [r.key for r in store.seeded_sample(df, "key", 20, seed).collect()]
    assert take(rows, 42) == take(rows.repartition(7), 42) != take(rows, 43) and len(set(take(rows, 42))) == 20


def test_asset_manifest(spark):
    words = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "nd string, rank int")
    row = mining.asset_manifest(words, words.limit(2), words.limit(0)).first()
    assert (row.word_map_entries, row.bigram_entries, row.phrase_entries) == (2, 2, 0)


def test_fresh_results(spark):
    assert [r.id for r in jobs.fresh(spark.createDataFrame([(1, 3), (2, 4), (3, None)], "id int, revision int"), 4).collect()] == [2]
