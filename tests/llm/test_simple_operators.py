"""Operators that look at one document at a time, against plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from textloom.llm import bpe, chat, media, quality, token_counts, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def by_text(rows, texts):
    """Output rows in the order of the inputs they belong to, matched as multisets by doc_id."""
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, *_ in texts)
    return {r.doc_id: r for r in rows}


def test_quality_counts(docs, texts):
    out = by_text(quality.quality_rules(docs).collect(), texts)
    for i, text, _ in texts:
        text, r = text or "", out[i]
        words = WORDS.findall(text)
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_hosts(spark, docs):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "bad", "a") for i in range(100)] + [(200 + i, good, "b") for i in range(50)] + [(300, good, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.quality_rules(frame).collect()}
    assert not out[0].kept and out[200].kept and out[300].kept and out[300].host_rate is None
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i].kept}
    assert quality.quality_rules(frame.limit(0)).count() == 0 and quality.keep_good(frame.limit(0)).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a ~1 <|user|> [INST]"), (1, 2, "assistant", "</s>"), (1, 3, "user", None), (2, 0, "assistant", ""), (2, None, "sys|tem", "~"), (3, 0, None, "x"), (None, 0, "user", "q"), (4, 1, "user", "dup"), (4, 1, "user", "dup")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_chats(frame)
    one = formatted.filter("conv_id = 1").first()
    assert one.formatted == "<s>[INST]<|user|>hi[/INST]<|assistant|>a ~01 ~1|user|> ~2INST]<|assistant|>~1/s>[INST]<|user|>[/INST]</s>"
    assert [one.formatted[m.start : m.start + m.length] for m in one.loss_mask] == ["a ~01 ~1|user|> ~2INST]", "~1/s>"]
    out = {r.conv_id: r for r in chat.chat_digests(frame).collect()}
    groups: dict = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(said.encode()), len(loss), sha(loss.encode()))
        assert r.n_blocks == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:], strict=False))
        assert r.formatted_chars == len(formatted.filter("conv_id <=> " + ("NULL" if c is None else str(c))).first().formatted)
    assert chat.chat_digests(frame.limit(0)).count() == 0


def test_warc_round_trip(spark, monkeypatch):
    rows = [(3, "u", "x" * 50_000), (1, "v", "x" * 50_000), (2, "w", "x" * 50_000), (4, None, None), (5, "a", ""), (None, "z", "é" * 9_000), (7, "q\r\nEvil: 1", "hello\r\n\r\nWARC/1.1"), (7, "q", "hello\r\n\r\nWARC/1.1"), (8, "q", "hello\r\n\r\nWARC/1.1")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    out = warc.archive_pages(frame).collect()
    assert len(out) == len(rows)
    first: dict = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    for r in out:
        html = next(h or "" for p, _, h in rows if p == r.page_id)
        payload, own = html.encode(), first.get(html)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own == r.page_id else ("revisit", own))
    assert warc.archive_pages(frame.limit(0)).count() == 0
    monkeypatch.setattr(warc, "if_small", lambda df: df)  # beyond the bound of a broadcast
    assert sorted(map(str, warc.archive_pages(frame).collect())) == sorted(map(str, out))
    written = b"".join(r.warc for r in warc.write_archives(frame).collect())
    revisits = [(fields, block) for fields, block in warc.parse(written) if fields["warc-type"] == "revisit"]
    assert all(not warc.payload_of(block) for _, block in revisits)
    assert sorted(fields.get("warc-refers-to-target-uri", "") for fields, _ in revisits) == ["", "q", "v", "v"]  # page 4 has no url


def test_warc_damage():
    block = warc.page_records(1, "u", b"y" * 40_000, None, "urn:x")
    assert len(block) == 3 and b"WARC-Segment-Total-Length" in block[-1]
    assert warc.unchunked(b"4;ext=1\r\nabcd\r\n0\r\nTrailer: x\r\n\r\n") == b"abcd"
    with pytest.raises(ValueError):
        warc.unchunked(b"4\r\nabcdXX0\r\n\r\n")


def test_byte_bpe(docs, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = bpe.encoder(path, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    out = by_text(bpe.bpe_digests(docs, path).collect(), texts)
    for i, text, _ in texts:
        ids = known.encode_ordinary(text or "")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()))
    decoded = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert all(decoded[i] == (t or "").encode() for i, t, _ in texts)
    assert bpe.bpe_digests(docs.limit(0), path).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(5000))
    assert sorted(table.keys) == sorted(keys)
    assert table.get(b"other") == -1 and bpe.PerfectHash([]).get(b"x") == -1


def test_media(docs, texts):
    out = by_text(media.media_digests(media.write_media(docs)).collect(), texts)
    for i, text, _ in texts:
        payload = media.pad((text or "").encode())
        r = out[i]
        stream = media.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), sha(stream))
        back, units, _ = media.demux(stream)
        assert back == payload and units[0] == (9000, 0, True)
        n = -(-len(payload) // 4096)
        last = 9000 + 3600 * (n - 1)
        assert r.feature == f"packets={len(stream) // 188};units={n};pts=9000-{last};random_access={-(-n // 8)};last_point={9000 + 3600 * 8 * ((n - 1) // 8)}"
    assert all(len(media.pad(b"x" * n)) == max(64, -(-n // 64) * 64) for n in range(200))
    read = media.read_media(media.write_media(docs)).filter("doc_id = 61").first()
    assert [u.random_access for u in read.units] == [k % 8 == 0 for k in range(len(read.units))]
    assert media.media_digests(media.write_media(docs.limit(0))).count() == 0


def test_media_damage():
    stream = media.mux(b"a" * 10_000)
    with pytest.raises(ValueError, match="missing"):
        media.demux(stream[: 188 * 10] + stream[188 * 11 :])
    with pytest.raises(ValueError, match="table"):
        media.demux(stream[:8] + b"\x55" + stream[9:])
    assert all(media.demux(media.mux(b"b" * n))[0] == b"b" * n for n in range(1, 600))


def packet(pid: int, counter: int, payload: bytes, start: bool = False) -> bytes:
    """A transport packet; a short payload is filled up by an adaptation field."""
    room = 184 - len(payload)
    head = bytes([0x47, start << 6 | pid >> 8, pid & 255, (0x10 if not room else 0x30 if payload else 0x20) | counter])
    return head + (bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"") if room else b"") + payload


def test_streams_as_others_write_them():
    """Stuffing, doubled packets, tables over several packets, several programs and streams."""
    data = bytes(range(256)) * 50
    cut = [media.mux(data)[i : i + 188] for i in range(0, len(media.mux(data)), 188)]
    _, index, _ = media.demux(media.mux(data))
    padded = []
    for p in cut:
        padded += [p, b"\x47\x1f\xff\x10" + bytes(184), p, packet((p[1] & 31) << 8 | p[2], p[3] & 15, b"")]
    assert media.demux(b"".join(padded))[:2] == (data, index)
    with pytest.raises(ValueError, match="missing"):
        media.demux(b"".join(cut[:4] + cut[5:]))
    with pytest.raises(ValueError, match="missing"):
        media.demux(b"".join(cut[:4] + [cut[3]] * 2 + cut[4:]))
    programs = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x100 + n).to_bytes(2, "big") for n in (0, *range(7, 90)))
    association = b"\0" + media._section(0, 1, programs)
    streams = b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x03\x0a\x01x" for kind, pid in [(2, 0x901)] * 40 + [(6, 0x902), (6, 0x903)])
    table = b"\0" + media._section(2, 7, (0xE000 | 0x902).to_bytes(2, "big") + b"\xf0\x00" + streams)
    tables = [packet(pid, n, t[at : at + 184], at == 0) for pid, t in ((0, association), (0x107, table)) for n, at in enumerate(range(0, len(t), 184))]
    pes = lambda text, stamp: b"\0\0\1\xbd" + (len(text) + (8 if stamp else 3)).to_bytes(2, "big") + (b"\x80\x80\x05" + media._pts(stamp) if stamp else b"\x80\0\0") + text
    body = [packet(0x902, 0, pes(b"one", 2**33 - 1), True), packet(0x903, 0, pes(b"other", 5), True), packet(0x901, 9, b"video"), packet(0x902, 1, pes(b"two", 0), True)]
    assert media.demux(b"".join(tables + body))[:2] == (b"onetwo", [(2**33 - 1, 0, False), (None, 3, False)])
    assert media.demux(b"".join(tables + body), program=8)[0] == b""
    tables[1] = tables[1][:-1] + bytes([tables[1][-1] ^ 1])
    with pytest.raises(ValueError, match="table"):
        media.demux(b"".join(tables + body))


def brute_unigram(word: str, scores: dict, byte_score: float) -> tuple[int, float]:
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        found = [(best[k][0] + scores[word[k:i]], -best[k][1] - 1) for k in range(i) if scores.get(word[k:i], 1) <= 0]
        if scores.get(word[i - 1], 1) > 0:
            n = len(word[i - 1].encode())
            found.append((best[i - 1][0] + n * byte_score, -best[i - 1][1] - n))
        top = max(found)
        best.append((top[0], -top[1]))
    return best[-1][1], best[-1][0]


def test_token_counts(docs, texts, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, byte_score = token_counts.vocabulary(path)
    out = by_text(token_counts.unigram_counts(docs, path).collect(), texts)
    for i, text, _ in texts:
        if text and len(text) > 20_000:
            continue
        parts = [brute_unigram(token_counts.START + w, scores, byte_score) for w in (text or "").split()]
        assert (out[i].n_pretokens, out[i].n_tokens) == (len(parts), sum(p[0] for p in parts))
        assert math.isclose(out[i].log10_prob, sum(p[1] for p in parts), abs_tol=1e-6)
    monkeypatch.setattr(token_counts, "MOST_NODES", 10)
    trie = token_counts.Trie(scores, byte_score)
    assert [trie.insert(w)[0] for w in PLAIN] == [brute_unigram(token_counts.START + w, scores, byte_score)[0] for w in PLAIN]
    assert token_counts.unigram_counts(docs.limit(0), path).count() == 0


PLAIN = "the theme there thing things thinking Ünï 日本 the".split()


def test_media_query_reads_the_stored_column(spark, tmp_path):
    from textloom.llm import registry

    docs = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.op6_media_columns(spark, str(tmp_path))
    files = out.inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
    assert sorted(map(str, out.collect())) == sorted(map(str, media.media_digests(media.write_media(docs)).collect()))
