"""Nearest neighbours, collocations and tokenizer alignment, against brute force."""

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import alignment, collocations, neighbours
from textloom.session import new_folder


def _written(frame):
    """The path of a table with the rows: one that gives the same rows in the same tasks each time."""
    path = new_folder(frame.sparkSession, "input")
    frame.write.parquet(path)
    return path


def brute_neighbours(rows, k=5):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max((len(v) for _, v in usable), default=0)
    usable = sorted((i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in usable)
    out = []
    for i, q in usable:
        if i % 50 == 0:
            near = sorted((-float(q @ v / (np.sqrt(q @ q) * np.sqrt(v @ v))), j) for j, v in usable if j != i)
            out += [(i, rank, j, -score) for rank, (score, j) in enumerate(near[:k], 1)]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=8) * 0.3]) for i in range(900)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(300)]  # a third of a kind, six queries among them
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2050, [float("nan")] * 8), (2100, [1.0, None]), (2150, [float("inf"), 1.0]), (2200, [1.0, 2.0]), (None, [1.0] * 8)]
    return rows + rows[:3]  # repeated rows


def same(found, wanted):
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())
    assert [x[:3] for x in found] == [x[:3] for x in sorted(wanted)]
    assert np.allclose([x[3] for x in found], [x[3] for x in sorted(wanted)], atol=1e-12, rtol=0)


def test_neighbours_exact_with_factor_one(spark, vectors):
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, cell string, part int, request int").repartition(5)
    marked = F.col("vec_id") % 50 == 0
    wanted = brute_neighbours(vectors)
    for sizes in ({}, {"tree_rows": 64, "query_rows": 7}):  # one tree; cells of several parts and blocks of queries
        out = neighbours.nearest_neighbours(frame, marked, factor=1.0, **sizes)
        assert out.columns == ["query_id", "rank", "vec_id", "score"]
        same(out, wanted)
    few = frame.filter("vec_id IN (0, 50, 2200)")
    same(neighbours.nearest_neighbours(few, marked), brute_neighbours([r for r in vectors if r[0] in (0, 50, 2200)]))
    assert neighbours.nearest_neighbours(frame.limit(0), marked).count() == 0
    assert neighbours.nearest_neighbours(frame.filter("vec_id = 50"), marked).count() == 0


def test_neighbours_recall(spark):
    """At the production factor nearly all are found, and a larger factor visits less."""
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    wanted = {x[:1] + x[2:3] for x in brute_neighbours(rows)}
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(frame, F.col("vec_id") % 50 == 0, tree_rows=500).collect()}
    assert len(found & wanted) >= 0.97 * len(wanted)
    u = neighbours.units(np.array([v for _, v in rows]))
    visited = []
    for factor in (1.0, 4.0, 12.0):
        tree = neighbours.VantageTree(u, np.arange(len(u)))
        tree.search(u[::50], 6, factor)
        visited.append(tree.visited)
    assert visited[0] >= visited[1] > visited[2]


def brute_collocations(rows, least, longest, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        total = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = {p[i:j] for p, c in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and candidates[p[i:j]] <= c}
        ranked = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * total // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, total, -s) for i, (s, a, p, left, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def test_collocations(spark, texts):
    pick = random.Random(4)
    rows = [("en", t) for _, t, _ in texts] + [(None, t) for _, t, _ in texts[:20]] + [("fr", "Un deux, trois. Un deux! trois quatre\tcinq six sept"), ("fr", None), ("fr", "\t ,;")] * 3
    rows += [(pick.choice(["en", "fr", None]), " ".join(pick.choice("AbCde") for _ in range(pick.randrange(60))) + pick.choice("., \n")) for _ in range(60)]
    frame = spark.createDataFrame([(x, t, "x", 1) for x, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    frame = spark.read.parquet(_written(frame))
    for least, longest, top, sizes in ((3, 5, 2000, {}), (2, 4, 30, {"block_bytes": 3000, "range_bytes": 2000})):
        out = collocations.collocations(frame, least, longest, top, **sizes)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == brute_collocations(rows, least, longest, top)
    assert collocations.collocations(frame.limit(0)).count() == 0


def test_automaton_states():
    """States against end position sets by brute force."""
    strings = ["abcbc", "abcab", "bcbcb"]
    words = np.array([ord(c) - 97 for x in strings for c in x])
    reach = np.concatenate([np.arange(len(x)) for x in strings])
    ends = defaultdict(set)
    for at in range(len(words)):
        for n in range(1, min(reach[at] + 1, 4) + 1):
            ends[tuple(words[at - n + 1 : at + 1])].add(at)
    by_state = defaultdict(list)
    for p, e in ends.items():
        by_state[frozenset(e)].append(len(p))
    wanted = sorted((max(n), min(n), len(e)) for e, n in by_state.items())
    found = [(n, int(m), int(c)) for n, _, count, shortest in collocations.Automaton(words, reach, 4).states() for c, m in zip(count, shortest, strict=True)]
    assert sorted(found) == wanted


A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(rows):
    """Whole texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    tokenizer.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    found, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = pieces.encode(text)
            spelled = [bytes(letters[c] for c in tokenizer.id_to_token(i)) for i in a]
            other = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("\u2581", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
            if b"".join(spelled) == b"".join(other) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in t]).tolist() for t in (spelled, other)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in cuts]
                for side, (ids, at) in enumerate(zip((a, b), ends, strict=True)):
                    for i, end in zip(ids, at, strict=True):
                        groups[bisect_left(cuts, end)][side].append(i)
        links = Counter()
        for x, y in groups:
            x, y = Counter(x), Counter(y)
            links.update({(i, j): x[i] * y[j] for i in x for j in y})
        counts.update(set(links))
        found.append((doc_id, groups, links))
    top = Counter()
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for doc_id, groups, links in found:
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sizes = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()))
        best = sum(n for p, n in links.items() if counts[p] == top[p[0]])
        out.append((doc_id, *sizes, best, sum(n * counts[p] for p, n in links.items()), hashlib.sha256(digest.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD_TEXTS = ["  two  spaces ", " ", "\n\tx\u00a0 y \u2003z  \n ", "don't we'll I 'm 'S", "<|endoftext|> <s> </s> <unk> <0x41>", "a\u2581b c", "Größe naïve œuvre ça été", "日本語 の テキスト", "\U0001f600 \U0001f468\u200d\U0001f469 x",
             "e\u0301 a\u0308o", "x\x00y \x01", "\u00a0lead trail\u3000", "1234 56,789.0 --- ///", "ﬁ ﬂ Ａ", "w \u0301mark \u200b zero", "\u1680 a \u0085 b"]


def test_alignment(spark, texts):
    rows = [(i, t) for i, t, _ in texts] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(2000, "aaaab " * 3000 + "zzz" * 5000)]
    pick = random.Random(9)
    rows += [(3000 + i, "".join(chr(pick.choice([32, 32, 65, 97, 98, 39, 10, 233, 0x3042, 0x2581, 0xA0, 48])) for _ in range(80))) for i in range(200)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, a string").repartition(3)
    wanted = brute_alignment(rows)
    for sizes in ({}, {"chunk_bytes": 2000}):
        out = alignment.alignment(frame, A_PATH, B_PATH, **sizes)
        assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, out.collect()), key=str) == wanted
    assert alignment.alignment(frame.limit(0), A_PATH, B_PATH).count() == 0
    assert [tuple(r) for r in alignment.alignment(frame.filter("text IS NULL"), A_PATH, B_PATH).collect()] == [(50, 0, 0, 0, 0, 0, 0, "")]
