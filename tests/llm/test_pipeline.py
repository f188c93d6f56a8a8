"""The pipeline's stages against plain Python: what goes, what stays, and the columns."""

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textloom.llm import registry

sys.path.insert(0, str(Path(__file__).parent))
from test_corpus_operators import WORDS, brute_classes, lowered  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def failures(text):
    """The four rules on one text."""
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [len(words) < 50, 2 * len(covered) > len(words), 10 * symbols > sum(map(len, words)), 10 * (len(lines) - len(set(lines))) > len(words)]


def brute_quality(rows):
    hosts = defaultdict(list)
    for r in rows:
        if r.source is not None:
            hosts[r.source].append(failures(r.text))
    bad = set()
    for rule in range(4):
        rate = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in hosts.items()}
        mean = sum(rate.values()) / max(1, len(rate))
        spread = sum((x - mean) ** 2 for x in rate.values()) / max(1, len(rate))
        strength = min(max(mean * (1 - mean) / spread - 1, 1), 10_000) if spread else 10_000
        bad |= {h for h, x in rate.items() if (x * len(hosts[h]) + mean * strength) / (len(hosts[h]) + strength) > 0.6}
    return [r for r in rows if r.source not in bad and not any(failures(r.text)[:2])]


def brute_near(rows):
    """Of each class the least id's rows, a repeated one once."""
    ids = {low for _, low, _ in brute_classes([(r.doc_id, r.text) for r in rows])}
    return list({(r.doc_id, r.text): r for r in rows if r.doc_id in ids}.values())


def windows(text):
    words = lowered(text)
    return {tuple(words[i : i + 50]) for i in range(len(words) - 49)}


def test_run_is_what_plain_python_does(spark, docs, tmp_path, monkeypatch):
    """Nulls, repeated rows, copies, shared passages and a host of junk, through ``run``."""
    docs.select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    stages = []

    def watched(stage):
        def run(spark, given, sf_dir):
            out = stage(spark, given, sf_dir)
            stages.append((given, out))
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for given, out in stages[:-1]:
        assert out.columns == COLUMNS and out.dtypes == given.dtypes
    before = [stages[0][0].collect(), *(given.collect() for given, _ in stages[1:])]
    named = lambda rows: sorted((str(r.doc_id), r.text or "") for r in rows)
    assert named(before[1]) == named(brute_quality(before[0])) and len(before[1]) < len(before[0])
    assert named(before[2]) == named(brute_near(before[1])) and len(before[2]) < len(before[1])

    was, seen = {r.doc_id: r for r in before[2]}, {}
    for r in sorted(before[3], key=lambda r: -1 if r.doc_id is None else r.doc_id):
        left, source = iter(lowered(was[r.doc_id].text)), lowered(r.text)
        assert all(any(w == x for x in left) for w in source)  # nothing but cuts
        assert r.n_chars == (was[r.doc_id].n_chars if r.text == was[r.doc_id].text else len(r.text))
        if r.doc_id is not None:
            assert all(seen.get(g, r.doc_id) == r.doc_id for g in windows(r.text))  # no exact passage of 50 words stands twice
            seen.update(dict.fromkeys(windows(r.text), r.doc_id))
    shared = Counter(g for r in before[2] for g in windows(r.text))
    untouched = {r.doc_id for r in before[2] if all(shared[g] == 1 for g in windows(r.text))}
    assert {2, 3, 4, 5, 63} <= untouched and {r.doc_id: r.text for r in before[3] if r.doc_id in untouched} == {i: was[i].text for i in untouched}

    known, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in before[3]:
        ids = np.array([*known.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        pieces.update((r.doc_id, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
    assert all(a == b for parts in sequences.values() for (_, a), (b, _) in zip([(0, 0), *sorted(parts)], sorted(parts), strict=False))
    assert max(b for parts in sequences.values() for _, b in parts) <= 2048


def test_run_of_an_empty_table(spark, docs, tmp_path):
    docs.select(COLUMNS).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() == 0


def test_registry():
    numbers = {name.split("_")[0] for name in registry.queries()}
    assert numbers == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(registry.oracle_sql()) <= set(registry.queries())
