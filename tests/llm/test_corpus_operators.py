"""Near duplicates, repeated substrings, fingerprints and the two models against plain Python."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from jabcheck.llm import fingerprint, graph, language, neardup, quality, substrings
from jabcheck.llm.common import release, table

# --- op 3


def brute_repeats(rows, length):
    """Order: id, NULL last, then a hash of the text, given here as rows in that order."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                cut[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        runs = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((doc, len(raw), sum(cut), runs, bytes(b for b, c in zip(raw, cut) if not c)))
    return Counter(out)


@pytest.mark.parametrize("crowded, length, gram", [(substrings.CROWDED, 100, 24), (1, 100, 24), (2, 40, 8), (2, 37, 16)])
def test_repeats(docs, rows, monkeypatch, crowded, length, gram):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "TOGETHER", 7)
    got = substrings.remove_repeats(docs, length, gram).collect()
    order = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).select("doc_id", "text")
    expected = brute_repeats([tuple(r) for r in order.collect()], length)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected


def test_repeats_of_very_many_rows_without_an_id(spark):
    texts = ["".join(chr(97 + (i * j + j // 7) % 26) for j in range(1, 131)) for i in range(40)]
    rows = [(None, texts[0])] * 1500 + [(None, t) for t in texts] + [(7, texts[3] + "!")] * 300 + [(1, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert substrings._texts(docs).select("d", "k").distinct().count() == len(rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(docs).collect())
    order = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(F.col("text").cast("binary"))).collect()
    assert got == brute_repeats([tuple(r) for r in order], 100)


def test_anchors_choose_the_same_offset_everywhere():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 101, 3000).astype(np.uint8)
    again = np.concatenate([rng.integers(97, 101, 77).astype(np.uint8), raw])
    for text, shift in ((raw, 0), (again, 77)):
        bucket, own, first, last = substrings.anchors(text, np.array([len(text)]), 100, 24)
        owner = np.concatenate([np.full(b - a + 1, o) for o, a, b in zip(own, first, last)])
        assert (first[0], last[-1]) == (0, len(text) - 100) and (np.abs(owner - np.arange(len(owner))) <= 76).all()
        if shift:
            assert (owner[shift:] - shift == before).all()
        before = owner


def test_refined_buckets_are_equal_strings():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    raw[2000:2400] = raw[:400]
    starts = np.arange(len(raw) - 100)
    identifier = substrings.refined(raw, starts, 100)
    by_bytes = defaultdict(set)
    for s, i in zip(starts, identifier):
        by_bytes[raw[s : s + 100].tobytes()].add(i)
    assert all(len(v) == 1 for v in by_bytes.values()) and len(by_bytes) == len(set(identifier.tolist()))


def test_texts_keep_their_columns(docs, rows):
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)


# --- op 5


def shingled(text):
    words = (text or "").lower().encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute_near(rows):
    sets = defaultdict(list)
    for doc, text, *_ in rows:
        if doc is not None and shingled(text):
            sets[shingled(text)].append(doc)
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] is not k:
            k = root[k]
        return k

    links = Counter()
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(a & b) >= 0.8 * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for k in keys:
        classes[find(k)] += sets[k]
    out = Counter()
    for doc, text, *_ in rows:
        key = shingled(text)
        if doc is None or not key:
            out[doc, doc, 0, 1, 1] += 1
        else:
            members = classes[find(key)]
            out[doc, min(members), links[key], len(members), len(sets[key])] += 1
    return out


@pytest.mark.parametrize("block", [neardup.BLOCK, 2])
def test_near_duplicates(docs, rows, block):
    got = neardup.near_duplicates(docs, block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.class_size, r.copies) for r in got) == brute_near(rows)
    kept = Counter(r.class_id for r in got if r.kept and r.doc_id is not None)
    assert set(kept.values()) == {1} and set(kept) == {r.class_id for r in got if r.doc_id is not None}


def test_one_of_each_keeps_rows_whole(docs):
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and {0, 1, 2, 3} <= set(ids)


def test_near_duplicates_of_the_given_table(spark):
    """Recall of links against brute force over all pairs that share a shingle."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sets, index, expected = {}, defaultdict(list), Counter()
    for doc, text in docs.select("doc_id", "text").collect():
        sets.setdefault(shingled(text), []).append(doc)
    keys = list(sets)
    for i, k in enumerate(keys):
        shared = Counter(j for s in k for j in index[s])
        for j, n in shared.items():
            if n >= 0.8 * len(k | keys[j]):
                expected[i] += 1
                expected[j] += 1
        for s in k:
            index[s].append(i)
    got = {r.doc_id: r.n_links for r in neardup.near_duplicates(docs).collect()}
    found = sum(min(got[sets[keys[i]][0]], n) for i, n in expected.items())
    assert found >= 0.9 * sum(expected.values()) > 0


def test_depth_follows_recall():
    assert neardup.depth_for(0.99, 0.8, 16, 8) == 6 and neardup.depth_for(0.5, 0.8, 16, 8) == 8


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (3, 2)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# --- op 10


def test_fingerprints(spark, docs, rows):
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = [tuple(r) for r in ordered.collect()]
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][1][: len(t) // 4] for i, (_, t) in enumerate(texts)]
    both = spark.createDataFrame(list(enumerate([t for _, t in texts] + edited)), "i INT, text STRING")
    keys = {r.i: set(r.k) for r in both.select("i", fingerprint.digests(F.col("text")).alias("k")).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    n = len(texts)
    expected = Counter(
        (
            doc,
            len(text),
            hashlib.sha256(edited[i].encode()).hexdigest(),
            round(like(keys[i], keys[n + i]), 9),
            round(like(keys[i], keys[(i + 1) % n]), 9),
        )
        for i, (doc, text) in enumerate(texts)
    )
    got = fingerprint.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected
    by_text = defaultdict(set)
    for r in got:
        by_text[r.doc_id].add(r.fingerprint)
    assert by_text[5] == by_text[6] and len(by_text[5]) == 1


def test_likeness_follows_the_words_in_common(spark):
    """Edits that change a text's length, and shifts: likeness is near that of the words, counted here."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))

    def prose(chars, stops):
        out = ""
        while len(out) < chars:
            out += word() + (rng.choice([" "] * 7 + [". "]) if stops else " ")
        return out[:chars]

    texts = []
    for stops in (True, False):
        for chars in (526, 2220, 9946, 40_000):
            text = prose(chars, stops)
            texts += [text, "word", prose(300, stops) + text, text]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    like = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        if len(text) < 500:
            continue
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        most = 0.2 if len(text) > 2000 else 0.3  # short texts have few paragraphs
        assert abs(got[i].near_edited - like(text, edited)) < most, i
        assert abs(got[i].near_next - like(text, after)) < most, i
    keys = spark.createDataFrame([(t,) for t in texts[:12:4]], "text STRING").select(F.size(fingerprint.digests(F.col("text"))).alias("n"))
    few, more, most = sorted(r.n for r in keys.collect())
    assert 3 * few < more and 3 * more < most


def test_order_over_many_runs(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "RUN", 3)
    got, _ = fingerprint.with_next(docs)
    order = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = [(r.doc_id, r.text or "") for r in order.collect()]
    expected = Counter((d, t, texts[(i + 1) % len(texts)][1]) for i, (d, t) in enumerate(texts))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got.collect()) == expected


def pairs_of_arrays(spark, *arrays):
    return spark.createDataFrame([(i, *a) for i, a in enumerate(arrays)], "i INT, left ARRAY<BIGINT>, right ARRAY<BIGINT>")


def test_recovered_digests_are_the_set_difference(spark):
    rng = random.Random(3)
    number = lambda: rng.randrange(1 << 48)
    arrays = [([], []), ([number()], []), ([], [number()])]
    for common, left, right in ((40, 0, 0), (40, 3, 2), (0, 20, 20), (300, 30, 0), (0, 500, 1), (10, 3000, 4000)):
        same = [number() for _ in range(common)]
        arrays.append(([number() for _ in range(left)] + same, same[::-1] + [number() for _ in range(right)]))
    got = {r.i: r for r in fingerprint.differences(pairs_of_arrays(spark, *arrays), ["i"], "left", "right").collect()}
    for i, (left, right) in enumerate(arrays):
        only = sorted(set(left) - set(right)), sorted(set(right) - set(left))
        if not any(only):
            assert i not in got
        else:
            assert (got[i].left_only, got[i].right_only) == only and got[i].changes == sum(map(len, only))
    counted = fingerprint.differences(pairs_of_arrays(spark, *arrays), ["i"], "left", "right", lists=False).collect()
    assert {r.i: r.changes for r in counted} == {i: r.changes for i, r in got.items()}


def test_digests_that_share_a_short_hash(spark):
    """Two digests with one 32-bit hash must still part company in some table."""
    numbers = spark.range(200_000).select(F.xxhash64("id").bitwiseAND(F.lit(fingerprint.KEY)).alias("k"))
    twins = numbers.groupBy(F.hash("k")).agg(F.collect_list("k").alias("k")).filter("size(k) > 1").limit(5).collect()
    assert twins
    got = fingerprint.differences(pairs_of_arrays(spark, *[(r.k, []) for r in twins]), ["i"], "left", "right").collect()
    assert sorted(r.left_only for r in got) == sorted(sorted(r.k) for r in twins)


def test_larger_sketches_when_one_is_too_small(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "estimated", lambda left, right, most: F.lit(1.0))
    rng = random.Random(4)
    arrays = [([rng.randrange(1 << 48) for _ in range(n)], []) for n in (1, 30, 200, 1000)]
    pairs = pairs_of_arrays(spark, *arrays)
    small = fingerprint.peeled(pairs.withColumn("bits", F.lit(4)), ["i"], "left", "right").filter("cell >= 0")
    assert small.filter("i = 3").count() and not small.filter("i = 0").count()
    got = fingerprint.differences(pairs, ["i"], "left", "right").collect()
    assert {r.i: r.left_only for r in got} == {i: sorted(a) for i, (a, _) in enumerate(arrays)}


def test_no_try_moves_the_arrays(spark, docs, monkeypatch):
    """Pairs to be tried again are found in their bucket, and are the same as by a join that moves them."""
    from jabcheck.llm.common import bucketed

    rng = random.Random(6)
    arrays = [[rng.randrange(1 << 48) for _ in range(n)] for n in (1, 30, 200, 30, 0, 500)]
    pairs = [(i % 3, i, a, a[:1]) for i, a in enumerate(arrays)]
    pairs = spark.createDataFrame(pairs, "run INT, pair BIGINT, left ARRAY<BIGINT>, right ARRAY<BIGINT>")
    dealt = bucketed(pairs, "run", buckets=3)
    plans, peeled = [], fingerprint.peeled

    def seen(todo, *rest):
        plans.append(todo._jdf.queryExecution().executedPlan().toString())
        return peeled(todo, *rest)

    monkeypatch.setattr(fingerprint, "peeled", seen)
    monkeypatch.setattr(fingerprint, "estimated", lambda left, right, most: F.lit(1.0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where many are tried again
    try:
        got = fingerprint.differences(dealt, ("run", "pair"), "left", "right", lists=False, buckets=3).collect()
        assert len(plans) > 2 and not any("Exchange" in p for p in plans)
        plans.clear()
        fingerprint.fingerprints(docs).collect()
        assert len(plans) > 2 and not any(line for p in plans for line in p.splitlines() if "hashpartitioning" in line and "pair" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.run, r.pair, r.changes) for r in got} == {(i % 3, i, len(a) - 1) for i, a in enumerate(arrays) if len(a) > 1}


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(blocks.apply, range(blocks.size())) if f.getName().startswith("shuffle_")}


def test_texts_do_not_stay_on_disk(spark):
    """Neither the shuffle that sorts the texts nor the table of them outlives the digests."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, rng.randbytes(50_000).hex()) for i in range(20)], "doc_id BIGINT, text STRING")
    most = 200_000  # bytes, of two million
    release(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key)
    got = fingerprint.fingerprints(docs)
    staged = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).rglob("*.parquet")
    assert sum(p.stat().st_size for p in staged if p.is_file()) < most
    for _ in range(50):  # files are deleted in the background
        if (left := sum(n for name, n in shuffle_files(spark).items() if name not in before)) < most:
            break
        time.sleep(0.2)
    assert left < most
    assert got.count() == 20
    assert spark.conf.get(key) == setting


def test_fingerprints_run_no_python(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- op 2


def test_quality_on_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scored = quality.score(docs, labels)
    assert scored.count() == docs.count()
    held = scored.filter("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in held)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.98


def test_quality_of_odd_texts(spark, docs, rows):
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(30)] + [(3, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id BIGINT, quality INT, toxic INT"
    )
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.score(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.score(docs.limit(0), labels).count() == 0


def test_trees_descend_as_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x, y, trees=30, depth=3)
    total = np.full(len(x), trees.base)
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
        for i in range(len(x)):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[i, feature[node]] > cut[node])
            total[i] += leaf[node - len(feature)]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-total)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


# --- op 7


@pytest.mark.parametrize("known", [language.KNOWN, 100])
def test_language_counts_and_base(docs, rows, monkeypatch, known):
    monkeypatch.setattr(language, "KNOWN", known)
    split = lambda t: (t or "").encode().translate(language._LOWER).split() + [b""]
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode())
    counts = Counter(w for d, t, *_ in rows if crc(d) % 10 for w in split(t))
    total, kinds = sum(counts.values()), len(counts)
    expected = Counter()
    for doc, text, *_ in rows:
        words = split(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        expected[doc, crc(doc) % 10 == 0, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)] += 1
    got = language.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score <= 0 for r in got)


def test_language_model_is_better_than_counts(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    held = language.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (held[0] - held[1]) / held[2] > 0.2


def plain_language(rows):
    """The scores of one round, token by token."""
    split = lambda t: (t or "").encode().translate(language._LOWER).split() + [b""]
    known = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0
    learned = [split(t) for d, t, *_ in rows if known(d)]
    counts = Counter(w for words in learned for w in words)
    shape = language.Shape.of(len(counts))
    wrap = 2**64 - 1
    key = lambda w: int(language.hashes(np.array([w], dtype=object))[0]) & wrap
    keys = {w: key(w) for words in [split(t) for _, t, *_ in rows] for w in words}
    signed = lambda w: keys[w] - 2**64 if keys[w] >> 63 else keys[w]
    ranks = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (w != b"", -counts[w], signed(w)))[:512])}

    def path(w):
        if w in ranks:
            return ((ranks[w] // 32,), (ranks[w] % 32,))
        k = keys[w]
        digits = tuple(k >> 55 - 5 * i & 31 for i in range(shape.depth))
        return ((16 + (k >> 60),), *((d,) for d in digits))

    def steps(words):
        """Softmax, part and features of each decision."""
        for i, w in enumerate(words):
            one, two = (keys[words[i - j]] if i >= j else 0 for j in (1, 2))
            a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
            pair = one * a & wrap ^ two * b & wrap
            seen = one * a & wrap, two * a & wrap, (pair ^ pair >> 31) * a & wrap
            before = ()
            for level, (part,) in enumerate(path(w)):
                slots = max(1, shape.rows // ([1, 32] + [16 * 32**n for n in range(1, 9)])[level])
                yield before, part, [(before, kind, (h >> 24) % slots) for kind, h in enumerate(seen)]
                before += (part,)

    parts, cells = Counter(), Counter()
    for w, c in counts.items():
        before = ()
        for (part,) in path(w):
            parts[before, part] += c
            before += (part,)
        cells[before] += c
    kinds = Counter(tuple(p for (p,) in path(w)) for w in counts)
    shares = {}

    def share(node):
        if node not in shares:
            row = np.array([parts[node, i] + 0.05 for i in range(32)])
            shares[node] = row / row.sum()
        return shares[node]

    seen = {}
    for words in learned:
        for _, part, features in steps(words):
            for f in features:
                seen.setdefault(f, np.zeros(32))[part] += 1
    out = Counter()
    for doc, text, *_ in rows:
        words, total = split(text), 0.0
        for node, part, features in steps(words):
            z = np.log(share(node))
            for f in features:
                n = seen.get(f, np.zeros(32))
                z = z + language.RATE * np.log((n + language.PRIOR * share(node)) / ((n.sum() + language.PRIOR) * share(node)))
            total += (z - np.log(np.exp(z).sum()))[part] / math.log(10)
        for w in words:
            if w not in ranks:
                cell = tuple(p for (p,) in path(w))
                total += math.log10((counts[w] + 0.1) / (cells[cell] + 0.1 * (kinds[cell] + 1)))
        out[doc, round(total, 2)] += 1
    return out


def test_language_scores_are_those_of_a_plain_version_for_any_files(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    expected = plain_language(rows)
    one, many = ({r.doc_id: r.score for r in language.score(docs.repartition(n)).collect()} for n in (1, 7))
    assert len(one) == len(rows) and all(abs(one[d] - many[d]) < 1e-6 * abs(one[d]) for d in one)
    assert all(abs(one[d] - s) < 0.01 + 1e-5 * abs(s) for d, s in expected)


def test_language_model_grows_with_the_words_and_sums_to_one():
    shapes = [language.Shape.of(n) for n in (0, 1000, 10**5, 10**7, 10**9)]
    assert all(a.rows * a.cells < b.rows * b.cells for a, b in zip(shapes[1:], shapes[2:]))
    rng = np.random.default_rng(4)
    shape = language.Shape(2, 1 << 12)
    model = language.Model.from_counts(shape, rng.random(language.FREQUENT), rng.random(shape.cells))
    keys = rng.integers(-(2**63), 2**63 - 1, 3000)
    ranks = np.where(rng.random(3000) < 0.5, rng.integers(0, language.FREQUENT, 3000), -1)
    ends = np.array([100, 300, 3000])
    observed = model.tables(np.int64)
    model.observe(observed, keys, ranks, ends)
    trained, last = model.updated(observed, None), -1e9
    for _ in range(3):  # every later step makes the texts likelier
        now = trained.log10(keys, ranks, ends).sum()
        assert now > last
        last = now
        expected = trained.tables(np.float64)
        trained.expect(expected, keys, ranks, ends)
        trained = trained.updated(observed, expected)
    every = np.r_[np.arange(language.FREQUENT), np.arange(shape.cells).astype(np.uint64) << np.uint64(50)].astype(np.uint64).view(np.int64)
    rank = np.r_[np.arange(language.FREQUENT), np.full(shape.cells, -1)]
    n = len(every)
    words, place = np.tile(keys[:3], n), np.tile(ranks[:3], n)
    words[2::3], place[2::3] = every, rank
    likely = 10 ** trained.log10(words, place, np.arange(3, 3 * n + 1, 3))[2::3]
    assert abs(likely.sum() - 1) < 1e-3


def test_nothing_to_learn_from(empty, docs):
    assert language.score(empty).count() == 0
    got = language.score(docs.filter("doc_id is null")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_empty_tables(empty):
    assert substrings.remove_repeats(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert fingerprint.fingerprints(empty).count() == 0


def test_release_deletes_what_was_staged(spark, docs, tmp_path):
    from jabcheck.llm.common import staged

    (file, *_) = staged(docs).inputFiles()
    path = Path(file.removeprefix("file://"))
    assert path.exists() and path.is_relative_to(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    release(spark)
    assert not path.exists()


def test_runs_that_share_a_bucket_are_few_rows(spark):
    for docs in (52_000, 257_000):
        runs = docs // fingerprint.RUN
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(runs))
        most = spark.range(runs).groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0]
        assert most * fingerprint.RUN <= 3500, (docs, most)
