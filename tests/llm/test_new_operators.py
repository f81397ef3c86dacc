"""Alignment, mixing and hard negatives against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import regex
from pyspark.sql import functions as F

from jabcheck.llm import alignment, mixing, negatives
from jabcheck.llm.bpe import byte_letters
from jabcheck.llm.queries import BYTE_LEVEL, PIECES

PATHS = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)

# --- op 11


def plain_groups(text):
    """The groups of a text as pairs of id lists, by the two libraries and a walk over both."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letter = {c: i for i, c in enumerate(byte_letters())}
    left = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if not text or any(b"".join(t for _, t in side) != raw for side in (left, right)):
        return []
    groups, x, y, at = [], 0, 0, [0, 0]
    open_ = ([], [])
    while x < len(left) or y < len(right):
        if at[0] <= at[1] and x < len(left):
            open_[0].append(left[x][0])
            at[0] += len(left[x][1])
            x += 1
        else:
            open_[1].append(right[y][0])
            at[1] += len(right[y][1])
            y += 1
        if at[0] == at[1]:
            groups.append(open_)
            open_ = ([], [])
    return groups


def plain_alignment(rows):
    groups = {t: plain_groups(t) for t in {t or "" for _, t in rows}}
    links = {t: Counter((a, b) for xs, ys in g for a in xs for b in ys) for t, g in groups.items()}
    holding = Counter()
    for _, t in rows:
        holding.update(links[t or ""].keys())
    most = defaultdict(int)
    for (a, _), n in holding.items():
        most[a] = max(most[a], n)
    out = Counter()
    for doc, t in rows:
        g, pairs = groups[t or ""], links[t or ""]
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in pairs.items() if holding[p] == most[p[0]])
        out[
            doc,
            sum(len(x) for x, _ in g),
            sum(len(y) for _, y in g),
            len(g),
            sum(pairs.values()),
            best,
            sum(n * holding[p] for p, n in pairs.items()),
            hashlib.sha256(spelt.encode()).hexdigest() if spelt else "",
        ] += 1
    return out


@pytest.mark.parametrize("block, crowded", [(alignment.BLOCK, alignment.CROWDED), (3000, 2)])
def test_alignment(docs, rows, monkeypatch, block, crowded):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "CROWDED", crowded)
    clash = docs.withColumns({c: F.lit(c) for c in ("block", "pair", "times", "a", "b", "n_docs", "key", "place")})
    got = alignment.align(clash, *PATHS)
    expected = plain_alignment([(d, t) for d, t, *_ in rows])
    assert Counter(tuple(r[c] for c in ("doc_id", *alignment.MEASURES, "groups_sha256")) for r in got.collect()) == expected


def test_alignment_of_odd_texts(spark, empty):
    texts = ["<s> </s> <unk> <0x41> <|endoftext|>", " lead", "two  blanks", "tab\tand\nline", "ﬁ ① ½", "▁x", "🙂🙂", "trail ", "﻿x", "é é"]
    rows = list(enumerate(texts))
    got = alignment.align(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), *PATHS).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", *alignment.MEASURES, "groups_sha256")) for r in got) == plain_alignment(rows)
    assert alignment.align(empty, *PATHS).count() == 0


# --- op 12


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, weights = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / weights > 3 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / weights for s in free}
        capped |= {s: 3 * sizes[s] for s in over}


def words(text):
    return len(regex.findall(r"[^\x20\x09-\x0D]+", text or ""))


def many_sources(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        source = rng.choice(["a", "b", "B", "é", "\U0001f642", "￮", None, "hot", "hot", "hot", "hot", "hot"])
        rows.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(400))), source))
    rows += [(9007, "x y z " * 300, "small")] * 4 + [(None, "p q r " * 50, None), (None, None, "none"), (9001, " \n", "none")]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")


def test_mixing_nears_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 50)
    monkeypatch.setattr(mixing, "SLOTS", 256)
    monkeypatch.setattr(mixing, "TOGETHER", 3)
    monkeypatch.setattr(mixing, "CHUNK", 3)
    rows, docs = many_sources(spark)
    got = mixing.taken(docs.withColumns({c: F.lit(c) for c in ("number", "start", "copies", "block", "n", "level", "size", "target")})).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, _ in rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    targets = plain_targets(sizes)
    by_id = defaultdict(set)
    for d, _, source in rows:
        by_id[d].add(source)
    taken, seen = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is None:
            continue
        (source,) = by_id[r.doc_id]
        assert r.source_size == sizes[source] and math.isclose(r.target, targets[source], rel_tol=1e-12)
        taken[source] += r.taken
        seen[source] = targets[source]
    for source, target in seen.items():
        slack = 450 if source is None else 0  # rows without an id are not counted above
        assert abs(taken[source] - target) <= 0.02 * target + 64 + slack, source


def test_mixing_agrees_with_itself(spark):
    rows, docs = many_sources(spark)
    again = docs.repartition(7)
    key = ("doc_id", "size", "source_size", "target", "taken")
    first, second = (Counter(tuple(r[c] for c in key) for r in mixing.taken(d).collect()) for d in (docs, again))
    assert first == second
    assert mixing.taken(docs.limit(0)).count() == 0


def test_mix_holds_whole_blocks(spark):
    """Every block a slot holds is whole, in order, and no slot holds two blocks."""
    rows, docs = many_sources(spark)
    mix, placed, sources = mixing.mixture(docs)
    size = {r.number: r.source_size for r in sources.collect()}
    slots = defaultdict(list)
    for r in mix.collect():
        slots[r.shard, r.slot].append((r.number, r.block, r.start + r["first"], r.words))
    times = Counter()
    for pieces in slots.values():
        (number, block), = {p[:2] for p in pieces}
        times[number, block] += 1
        spans = sorted(p[2:] for p in pieces)
        assert spans[0][0] == block * mixing.BLOCK
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) == min(mixing.BLOCK, size[number] - block * mixing.BLOCK)
    assert max(times.values()) <= 3


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        for key in (0, 1, -5, 2**62):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 3)).tolist() != list(range(1000))


# --- op 13


def plain_negatives(rows):
    kept = []
    for i, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((i, [math.floor(float(np.float32(v)) * 256) for v in x], label))
    out = Counter()
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for at, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, other == label) for k, (j, y, other) in enumerate(kept) if k != at]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=first)[:5]:
            fits = [s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score]
            for rank, s in enumerate(sorted(fits, key=first)[:10], 1):
                out[anchor, positive, rank, s[1], score, s[0]] += 1
    return out


def embedded(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(900):
        x = centres[i % 12] + 0.4 * rng.normal(size=8)
        rows.append((i, [float(np.float32(v)) for v in x], int(i % 5)))
    same = rows[3][1]
    rows += [(1000 + i, same, i % 3) for i in range(400)]  # ties
    rows += [(5000, None, 1), (5100, [0.1] * 8, None), (5200, [0.5, None] + [0.1] * 6, 2), (5300, [float("nan")] + [0.1] * 7, 2)]
    rows += [(5400, [float("inf")] + [0.1] * 7, 2), (None, same, 3), (5500, [1.0, 2.0], 4), (5600, [], 4), (5700, [0.0] * 8, 0), (-700, same, 9)]
    return rows, spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")


@pytest.mark.parametrize("cells, block, first, exact", [(512, 1024, 4096, 2.0**53), (8, 16, 20, 2.0**53), (30, 40, 64, 0.0)])
def test_negatives(spark, monkeypatch, cells, block, first, exact):
    for name, value in (("CELL_ROWS", cells), ("BLOCK", block), ("TILE", 5), ("FIRST", first), ("EXACT", exact)):
        monkeypatch.setattr(negatives, name, value)
    rows, frame = embedded(spark)
    got = negatives.hard_negatives(frame.withColumns({c: F.lit(c) for c in ("row", "id", "vec", "cell", "anchor", "score")}))
    key = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert Counter(tuple(r[c] for c in key) for r in got.collect()) == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    _, frame = embedded(spark)
    assert negatives.hard_negatives(frame.limit(0)).count() == 0
    assert negatives.hard_negatives(frame.filter("vec_id = 100")).count() == 0


def test_cells_come_in_order_of_bounds_that_hold():
    rng = np.random.default_rng(1)
    points = rng.integers(-200, 200, (300, 6)).astype(float)
    halves = [negatives._fitted(p, 4) for p in (points[:, :3], points[:, 3:])]
    near = [negatives._nearest(p, c) for p, c in zip((points[:, :3], points[:, 3:]), halves)]
    far = [np.sqrt(((p - c[n]) ** 2).sum(1)) for p, c, n in zip((points[:, :3], points[:, 3:]), halves, near)]
    radii = [np.array([f[n == k].max(initial=0) for k in range(4)]) for f, n in zip(far, near)]
    books = negatives.Books(halves, radii, np.zeros((4, 4)), 1e6)
    for query in points[:5]:
        cells = list(books.visits(query))
        bounds = [b for *_, b in cells]
        assert bounds == sorted(bounds, reverse=True) and len({c[:2] for c in cells}) == 16
        for i, j, bound in cells:
            inside = points[(near[0] == i) & (near[1] == j)] @ query
            assert (inside <= bound + 1e-6).all()
