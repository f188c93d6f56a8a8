"""Operators that compare documents with each other, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from textloom.llm import _text, lm, near_dedup, packing, substrings
from textloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORDS.findall(text or "")]


def shingles(text, n=5):
    w = lowered(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for x in range(len(sets)):
        groups[find(x)].append(sets[x][0])
    return sorted((str(i), min((j for j in g if j is not None), default=None), len(g)) for g in groups.values() for i in g)


def test_near_duplicates(docs, texts):
    out = near_dedup.near_duplicates(docs)
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in out.collect()) == brute_classes([(i, t) for i, t, _ in texts])
    small = near_dedup.near_duplicates(docs, split_pairs=0)  # rare shingles choose among all that turns leave
    assert sorted(map(str, small.collect())) == sorted(map(str, out.collect()))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.class_id for r in out.collect()}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_rare_shingles_lose_no_pair(spark):
    """All pairs at the threshold share a rare shingle, though all texts share a passage."""
    pick = random.Random(5)
    word = lambda: f"w{pick.randrange(10**9)}"
    passage, rows = [word() for _ in range(60)], []
    for i in range(0, 80, 4):
        own = [word() for _ in range(40)]
        whole = own + passage
        rows += [(i, " ".join(whole)), (i + 1, " ".join([*own[:-1], word(), *passage])), (i + 2, " ".join([word() for _ in range(40)] + passage)), (i + 3, " ".join(whole[:81]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_dedup.signatures(frame).select("node", "doc_id")
    sets = near_dedup.shingle_tables(nodes, frame, 5)
    ids = {r.node: r.doc_id for r in nodes.collect()}
    for weights in ("set", "count"):
        rare = near_dedup._rare(sets, nodes.select("node", nodes["node"].alias("root")), 0.8, weights).collect()
        pairs = {tuple(sorted((ids[r.a], ids[r.b]))) for r in rare}
        assert {(i, i + k) for i in range(0, 80, 4) for k in (1, 3)} <= pairs and len(pairs) < 100


def test_near_duplicates_by_chain(spark):
    """Links that only later copies make join classes; a hub of many copies costs a pair each."""
    pick = random.Random(3)
    word = lambda: f"w{pick.randrange(10**9)}"
    text = [word() for _ in range(150)]
    rows = []
    for i in range(120):
        if i % 3 == 0:
            at = pick.randrange(len(text) - 1)
            text = [*text[:at], word(), *text[at + 1 :]]
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_duplicates(frame).collect()
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in out) == brute_classes(rows)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 6, 300), rng.uniform(0.2, 6, 300)
    doc = np.repeat([0, 1], 300)
    both = near_dedup.dart_signatures(np.r_[elements, elements], np.r_[a, b], doc, 2, 4000)
    assert abs((both[0] == both[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    alone = near_dedup.dart_signatures(elements, b, np.zeros(300, int), 1, 4000)
    assert (alone[0] == both[1]).all()  # a signature doesn't depend on its neighbours
    assert (near_dedup.dart_signatures(elements[:1], b[:1], np.zeros(1, int), 2, 64)[1] == 0).all()


def test_components(spark):
    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    edges += [(pick.randrange(2000, 2100), pick.randrange(2000, 2100)) for _ in range(60)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and find(a) != find(b):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    assert out == {x: find(x) for x in parent if any(x in e and e[0] != e[1] and None not in e for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(docs, texts):
    out = substrings.repeated_passages(docs).collect()
    said = {i: lowered(t) for i, t, _ in texts if i is not None}
    covered = defaultdict(set)
    for r in out:
        assert r.other_id < r.doc_id and r.identity >= 0.8 and min(r.end - r.start, r.other_end - r.other_start) >= 50
        assert r.end <= len(said[r.doc_id]) and r.other_end <= len(said[r.other_id])
        if r.identity == 1:
            assert said[r.doc_id][r.start : r.end] == said[r.other_id][r.other_start : r.other_end]
        covered[r.doc_id] |= set(range(r.start, r.end))
    seen: dict = {}
    for i in sorted(said):
        grams = [tuple(said[i][k : k + 50]) for k in range(len(said[i]) - 49)]
        for k, g in enumerate(grams):
            assert g not in seen or set(range(k, k + 50)) <= covered[i], (i, k)
        for g in grams:
            seen.setdefault(g, i)
    found = {r.doc_id for r in out}
    assert {21, 31, 41, 42, 43} <= found and not found & {3, 4, 5, 40, 50, 51, 53, 63}
    assert substrings.repeated_passages(docs.limit(0)).count() == 0


def test_fuzzy_passage_is_found(spark):
    pick = random.Random(5)
    word = lambda: f"w{pick.randrange(10**9)}"
    passage = [word() for _ in range(90)]
    fuzzy = [*passage[:30], word(), *passage[31:60], *passage[62:]]  # a word replaced, two left out
    rows = [(1, " ".join([word() for _ in range(40)] + passage)), (2, " ".join(fuzzy + [word() for _ in range(40)]))]
    (r,) = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert (r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end, r.matched) == (2, 1, 0, 88, 40, 130, 87)


def test_passage_whose_parts_stood_earlier(spark):
    """Two overlapping or adjacent stock sentences, first seen in A1 and A2; B and C have both."""
    pick, rows, whole = random.Random(6), [], {}
    word = lambda: f"w{pick.randrange(10**9)}"
    own = lambda n: [word() for _ in range(n)]
    for size, low, high in ((50, 30, 20), (60, 30, 30), (60, 40, 20), (60, 45, 12), (80, 48, 33), (96, 48, 48)):
        i, passage = len(rows), own(size)
        a, b, c = own(20), own(30), own(40)
        rows += [(i, " ".join(a + passage[:low] + own(9))), (i + 1, " ".join(b + passage[high:] + own(9))), (i + 2, " ".join(c + passage + own(9))), (i + 3, " ".join(b + passage + own(9)))]
        whole[i + 3, i + 2] = (30, 30 + size, 40, 40 + size)
    out = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.other_id): (r.start, r.end, r.other_start, r.other_end) for r in out if r.other_id == r.doc_id - 1}
    assert found == whole


def test_long_rows_are_cut_into_pieces():
    """Hashes don't depend on the piece a word, or a part of it, falls into."""
    pick = random.Random(9)
    texts = ["", " ".join("w" * pick.randint(1, 9) + str(i) for i in range(90_000)), "z" * 450_000 + " A b", "end"]
    column = pa.array(texts)
    data, offsets = _text.text_bytes(column)
    whole = _text.words(data, offsets)
    said = [(i, w) for i, t in enumerate(texts) for w in lowered(t)]
    assert [(d, bytes(data[s:e]).decode().lower()) for d, s, e in zip(whole.doc.tolist(), whole.start.tolist(), whole.end.tolist(), strict=True)] == said
    own = {}
    for i in [*range(0, len(said), 997), len(said) - 3]:
        raw = said[i][1].encode()
        terms, power = 0, 1
        for x in raw:
            terms = (terms + int(_text._BYTE[x]) * power) % 2**64
            power = power * int(_text._BASE) % 2**64
        own[i] = int(_text.mix(np.array([(terms + len(raw) * int(_text._GOLD)) % 2**64], np.uint64))[0])
    assert {i: int(whole.hash[i]) for i in own} == own


@pytest.mark.parametrize("kind", ["replaced", "mixed"])
@pytest.mark.parametrize(("identity", "words", "least"), [(0.9, 56, 0.97), (0.8, 56, 0.9), (0.85, 60, 0.9), (0.8, 60, 0.9), (0.8, 100, 0.9)])
def test_recall_by_identity(spark, identity, words, least, kind):
    """Passages with exactly so many words replaced, left out or put in, in unlike texts; overlap counts as found."""
    pick, rows, n = random.Random(words), [], 200
    word = lambda: f"w{pick.randrange(10**9)}"
    for i in range(n):
        passage = [word() for _ in range(words)]
        other = [[x] for x in passage]
        for at in pick.sample(range(words), round(words * (1 - identity))):
            other[at] = [word()] if kind == "replaced" else pick.choice(([word()], [], [passage[at], word()]))
        other = [x for xs in other for x in xs]
        rows += [(2 * i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])), (2 * i + 1, " ".join([word() for _ in range(50)] + other + [word() for _ in range(50)]))]
    out = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in out}
    print("recall", kind, identity, words, len(found) / n)
    assert all(r.other_id == r.doc_id - 1 for r in out) and len(found) / n >= least


@pytest.mark.parametrize("kind", ["replaced", "mixed"])
@pytest.mark.parametrize("identity", [0.9, 0.8])
@pytest.mark.parametrize("cuts", [(48,), (32, 64), (20, 45, 70)])
def test_recall_of_passages_whose_parts_stood_earlier(spark, identity, kind, cuts):
    """Parts of a passage of 96 words stood in earlier documents, B has the whole, C an edited copy of B."""
    pick, rows, n, size = random.Random(len(cuts)), [], 100, 96
    word = lambda: f"w{pick.randrange(10**9)}"
    own = lambda k: [word() for _ in range(k)]
    step, bounds = len(cuts) + 3, (0, *cuts, size)
    for i in range(n):
        passage = own(size)
        other = [[x] for x in passage]
        for at in pick.sample(range(size), round(size * (1 - identity))):
            other[at] = [word()] if kind == "replaced" else pick.choice(([word()], [], [passage[at], word()]))
        other = [x for xs in other for x in xs]
        parts = [own(pick.randrange(60)) + passage[a:b] + own(20) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rows += [(step * i + j, " ".join(t)) for j, t in enumerate([*parts, own(40) + passage + own(30), own(25) + other + own(50)])]
    out = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id // step for r in out if r.doc_id % step == step - 1 and r.other_id == r.doc_id - 1}
    print("recall", kind, identity, cuts, len(found) / n)
    assert len(found) / n >= 0.9


def test_without_repeats(docs, texts):
    out = substrings.without_repeats(docs, length="n_chars")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    left = {r.doc_id: r for r in out.collect()}
    said = {i: t for i, t, _ in texts}
    assert all(left[i].text == said[i] for i in (3, 4, 5, 40, 50, 51, 53, None))
    assert not {30, 31, 32, 33} & set(left)  # whole copies of document 1
    assert 0 < len(left[42].text) < len(said[42]) and left[42].n_chars == len(left[42].text)
    assert substrings.cut_words("a b  c\nd", [(1, 3)]) == "a d" and substrings.cut_words(None, []) == ""


def test_chains_are_collinear():
    anchors = [(i, i) for i in range(0, 50, 5)] + [(7, 300), (30, 2)]
    best, *rest = substrings.chain(anchors)
    assert best == [(i, i) for i in range(0, 50, 5)] and sorted(rest) == [[(7, 300)], [(30, 2)]]


def test_interpolation(docs, texts):
    out = lm.interpolation_scores(docs, block_bytes=30_000, range_bytes=50_000).collect()
    rows = [(i, lowered(t) + [None]) for i, t, _ in texts]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    count = Counter(w for i, ws in rows if fold(i) != 1 for w in ws)
    total, types = sum(count.values()), len(count)

    def tables(folds):
        one, two = Counter(), Counter()
        for i, ws in rows:
            if fold(i) in folds:
                one["<start>"] += 1
                one.update(ws)
                two.update(zip(["<start>", *ws], ws, strict=False))
        return one, two

    one, two = tables({2, 3, 4})
    kept = sum(v for k, v in one.items() if k != "<start>")
    step = lambda p: 0 if not p else min(399, max(0, round(-math.log(p) / 0.1))) + 1
    cells = Counter()  # events by bucket and the steps of both estimates
    for i, ws in rows:
        if fold(i) == 0:
            for h, w in zip(["<start>", *ws], ws, strict=False):
                cells[one[h].bit_length(), step(two[h, w] / one[h] if one[h] else 0), step(one[w] / max(1, kept))] += 1
    estimate = lambda s: math.exp(-(s - 1) * 0.1) if s else 0.0
    weights = {b: [1 / 3] * 3 if b else [0, 0.5, 0.5] for b in range(48)}
    for _ in range(40):
        sums = {b: [1.0 if b else 0.0, 1.0, 1.0] for b in range(48)}
        for (b, pair, token), n in cells.items():
            share = [w * p for w, p in zip(weights[b], (estimate(pair), estimate(token), 1 / (types + 1)), strict=True)]
            for j in range(3):
                sums[b][j] += n * share[j] / sum(share)
        weights = {b: [x / sum(v) for x in v] for b, v in sums.items()}
    one, two = tables({0, 2, 3, 4})
    expected = []
    for i, ws in rows:
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        score = 0.0
        for h, w in zip(["<start>", *ws], ws, strict=False):
            a, b, c = weights[one[h].bit_length()]
            score += math.log10(a * (two[h, w] / one[h] if one[h] else 0) + b * count[w] / total + c / (types + 1))
        expected.append((str(i), fold(i) == 1, len(ws), sum(count[w] > 0 for w in ws), total, round(base, 4), round(score, 4)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in out]
    for x, y in zip(sorted(got), sorted(expected), strict=True):
        assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-6) and math.isclose(x[6], y[6], rel_tol=1e-6), (x, y)
    assert lm.interpolation_scores(docs.limit(0)).count() == 0


def test_interpolation_beats_the_base_on_held_out_texts(spark):
    pick = random.Random(2)
    follow = {w: [pick.randrange(200) for _ in range(3)] for w in range(200)}

    def text():
        w, out = pick.randrange(200), []
        for _ in range(200):
            out.append(f"w{w}")
            w = pick.choice(follow[w])
        return " ".join(out)

    frame = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    held = [r for r in lm.interpolation_scores(frame).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    out = packing.pack_documents(docs, path).collect()
    expected = Counter()
    for i, text, _ in texts:
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            expected[i, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def one_by_one(lengths, size):
    gaps: list[int] = []
    used = 0
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gap = min(fitting)
            gaps.remove(gap)
        else:
            gap, used = size, used + 1
        gaps.append(gap - n)
    return used


@pytest.mark.parametrize("high", [1, 3, 40, 2000])
def test_gaps_offer_no_more_places_than_pieces_need(high):
    rng = np.random.default_rng(high)
    for n in (1, 7, 300, 100_000):
        counts = {int(g): int(rng.integers(1, 50)) for g in rng.integers(high // 2 + 1, 2048, 200)}
        places = packing.offers(counts, high, n)
        wide = [g for g in counts if g >= high]
        assert all(places[g] == 1 for g in counts if g < high) and all(places[g] <= g // high for g in wide)
        offered = sum(places[g] * counts[g] for g in wide)
        assert min(n, sum(g // high * counts[g] for g in wide)) <= offered < n + max([counts[g] for g in wide], default=1)
        ends = [g // (g // high) for g in wide if places[g]], [g // (g // high) for g in wide if places[g] < g // high]
        assert not all(ends) or max(ends[0]) <= min(ends[1])  # the tightest ones


@pytest.mark.parametrize(("size", "n", "rows_each"), [(256, 300, 40), (100, 200, 10**6), (7, 1, 5)])
def test_best_fit_is_as_good_as_one_by_one(spark, size, n, rows_each):
    """As many sequences as one-by-one best-fit decreasing (one more at most), each piece once, however the ranges are cut."""
    pick = random.Random(size)
    lengths = [pick.randint(1, size) if pick.random() < 0.7 else size // 3 + 1 for _ in range(n)]
    rows = spark.createDataFrame([(i, 0, 0, x, 7) for i, x in enumerate(lengths)], packing._PIECE_TYPE)
    out = packing.pack(rows, size, rows_each).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(lengths))
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [a + b for a, b in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= size
    assert len(sequences) <= one_by_one(lengths, size) + 1


def test_ranges_match_as_one():
    """What ranges leave over and match by rank is what one sweep over all rows matches."""
    pick = random.Random(3)
    for _ in range(200):
        gap = np.array([pick.random() < 0.5 for _ in range(pick.randint(1, 40))])
        opening, closing, alone = packing.nest(gap)
        expected, stack = set(), []
        for i, g in enumerate(gap.tolist()):
            if g:
                stack.append(i)
            elif stack:
                expected.add((stack.pop(), i))
        assert set(zip(opening.tolist(), closing.tolist(), strict=True)) == expected
        edges = sorted({0, len(gap), *(pick.randrange(len(gap)) for _ in range(4))})
        found, left, rows = set(), {}, {}
        for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            x, y, rest = packing.nest(gap[a:b])
            found |= set(zip((x + a).tolist(), (y + a).tolist(), strict=True))
            for kind, own in ((packing._GAP, rest[gap[a:b][rest]]), (packing._LEFT, rest[~gap[a:b][rest]])):
                rows.update({(part, kind, r): i + a for r, i in enumerate(own.tolist())})
            left[part] = (int((~gap[a:b][rest]).sum()), int(gap[a:b][rest].sum()))
        runs, pairs, new = packing.across(left)
        sides = {packing._GAP: {}, packing._LEFT: {}}
        for run in runs:
            if not run.new:
                sides[run.kind].update({run.number + run.step * k: rows[run.part, run.kind, run.rank + k] for k in range(run.count)})
        assert len(sides[packing._GAP]) == pairs and sides[packing._GAP].keys() == sides[packing._LEFT].keys()
        found |= {(sides[packing._GAP][k], sides[packing._LEFT][k]) for k in range(pairs)}
        assert found == expected and new == sum(not g for g in gap) - len(expected)


HARD = [
    "a b. c, d!",
    "ΑΣ İstanbul \x1c a\x1db x　y it's 123. don't É",
    "it's. end.. v1, 'Sure' rock'n'roll o'clock we'LL 'T",
    ". , x.",
    "a <|endoftext|> b",
    "x<|startoftext|>y <|ENDOFTEXT|> <|endoftext",
    "E\u0301te\u0301 café\u0301 ñ×÷ œŒ ŉ ſ ĸ Ĳ 12٣４ ½² ª",
    "a\u00a0b\u2003c\u0085d\u200be \ufeff",
    "''s '' 's'' &&&'s a'b' #'re",
    "日本語 テスト 한국어 नमस्ते 🙂👍🏽 ﬁ ǅ ẞ",
    "",
    " \n\t ",
    "z" * 30_000,
]


def test_word_tokenizer_is_the_tokenizer(monkeypatch):
    """Ids are those of the untouched tokenizer, also when a worker forgets what it learned."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    pick = random.Random(8)
    signs = "abzAZéÉÀß'’.,!&09 \n\t\u0301\u00a0sStTlLİŉ×Σςøœ日<|>"
    texts = [*HARD, *("".join(pick.choice(signs) for _ in range(60)) for _ in range(400))]
    expected = [known.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (3_000_000, 40):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        tokenizer = packing.WordTokenizer(path)
        for part in (pa.array(texts), pa.array(texts[::-1])):
            got = [x.tolist() for i in range(0, len(part), 7) for x in tokenizer.rows(part[i : i + 7])]
            assert got == (expected if part[0].as_py() == texts[0] else expected[::-1])
        assert [x.tolist() for x in tokenizer.rows(pa.array([None, "a"]))] == [[], known.encode("a").ids]


def test_common_words_against_the_plain_table():
    pick = np.random.default_rng(4)
    for _ in range(300):
        a, b = (pick.integers(0, pick.integers(2, 9), pick.integers(0, 40)).astype(np.uint32) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert substrings._common(a, b) == table[-1][-1]


def test_texts_without_turns_take_no_keys(monkeypatch):
    """Most texts have matches with one document only, and need nothing worked out."""
    made = []
    real = substrings._text.mix
    monkeypatch.setattr(substrings._text, "mix", lambda x: made.append(1) or real(x))
    at = np.arange(0, 300, 3, dtype=np.int32)
    one = np.full(len(at), 7, np.int64)
    assert [len(c) for c in substrings._turns(at, one, at + 5, 5, 50)] == [0] * 4 and not made
    two = np.repeat(np.array([7, 9]), 12)
    assert substrings._turns(at[:24], two, at[:24] + 5, 5, 50)[1].tolist() == [33, 33]


def test_packed_matches_are_small_and_come_back():
    """Matches and seeds travel between tasks as packed arrays, texts compressed: disk is what bounds this job."""
    pick = np.random.default_rng(9)
    ids = np.sort(pick.integers(0, 300, 6000)) * 1_000_003 - 5
    at = pick.integers(0, 900, 6000).astype(np.int32)
    keys = np.repeat(pick.integers(0, 2**63, 3000).astype(np.uint64), 2)[pick.permutation(6000)]
    dealt = pa.Table.from_batches(substrings._dealt(keys, ids, at, 1))
    assert substrings._values(dealt.column("keys"), np.uint64, 5).tolist() == (keys >> np.uint64(24)).tolist()
    assert substrings._values(dealt.column("ids"), np.int64).tolist() == ids.tolist() and substrings._values(dealt.column("at"), np.int32).tolist() == at.tolist()
    assert sum(len(p.as_py()) for c in ("keys", "ids", "at") for p in dealt.column(c)) < 8 * 6000
    held = substrings._first_rows(dealt, 4)
    lists = substrings._list_rows(held)
    want = defaultdict(list)
    for pair in np.argsort(keys, kind="stable").reshape(-1, 2).tolist():
        first, later = sorted((int(ids[i]), int(at[i])) for i in pair)
        if first[0] != later[0]:
            for doc, place in (first, later):
                want[doc].append((place, *first))
    rows = lists.to_pylist()
    assert {r["doc_id"]: sorted(zip(r["at"], r["other_id"], r["other_at"], strict=True)) for r in rows} == {d: sorted(m) for d, m in want.items()}
    assert lists.num_rows == len(want) and held.nbytes < 14 * sum(map(len, want.values()))


def test_texts_are_compressed_and_come_back():
    texts = ["the same words again and again " * 40, None, "", "Ünï çødé 日本語", "z" * 700_000, *("some words more " * n for n in range(60))]
    (closed,) = substrings._closed_rows([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])
    back = [t for part in substrings._opened(closed.column("size").to_numpy(), closed.column("closed")) for t in part.to_pylist()]
    assert [t.decode() for t in back] == [t or "" for t in texts] and closed.nbytes < 20_000


def test_turns_whatever_order_matches_come_in():
    """A seed that both texts repeat has several matches at one place."""
    at = np.repeat(np.arange(0, 120, 4, dtype=np.int32), 2)
    other = np.repeat(np.array([7, 9]), len(at) // 2)
    other_at = at + np.tile(np.array([3, 90], np.int32), len(at) // 2)
    want = [c.tolist() for c in substrings._turns(at, other, other_at, 5, 50)]
    back = np.arange(len(at))[::-1]
    assert want[0] and [c.tolist() for c in substrings._turns(at[back], other[back], other_at[back], 5, 50)] == want
