"""BPE, exact groups, lines, packing and archives against plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from jabcheck.llm import bpe, exact, linededup, packing, warc
from jabcheck.llm.queries import tokenizer_path

SPACE = r"[\x20\x09-\x0D]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op 1


def test_bpe_equals_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, tokenizer_path()).collect())
    expected = Counter()
    for doc, text, *_ in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = reference.decode(ids, skip_special_tokens=False)
        expected[doc, len(ids), hashlib.sha256(raw).hexdigest(), sha(decoded)] += 1
    assert got == expected


def test_bpe_returns_ids_and_text(spark):
    row = bpe.encode(spark.createDataFrame([(1, "Hello  HELLO aaaa")], "doc_id BIGINT, text STRING"), tokenizer_path()).first()
    model = bpe.loaded(tokenizer_path())
    assert row.decoded == model.decode(row.ids) and row.n_tokens == len(row.ids) and row.ids[0] == row.ids[1]


def test_overlapping_pairs_merge_from_the_left():
    from tokenizers import Tokenizer

    reference, model = Tokenizer.from_file(tokenizer_path()), bpe.loaded(tokenizer_path())
    for word in ("a" * n for n in range(1, 40)):
        assert model.encode([word])[0].tolist() == reference.encode(word, add_special_tokens=False).ids


# --- op 6


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[regex.sub(SPACE, "", text or "")].append((-len(text or ""), doc is None, doc))
    expected = Counter()
    for members in groups.values():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for m in members:
            expected[m[2], best[2], len(members), m == best] += 1
    got = exact.exact_groups(docs, {"text_sha256": F.sha2(exact.normalised(docs["text"]), 256)})
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == expected
    digests = {r.doc_id: r.text_sha256 for r in got.collect() if r.doc_id is not None}
    assert all(digests[d] == sha(regex.sub(SPACE, "", t or "")) for d, t, *_ in rows if d is not None)


# --- op 9


def test_lines(docs, rows):
    pages = Counter(source for _, _, _, source, _ in rows)
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r")
    on = Counter()
    for _, text, _, source, _ in rows:
        on.update({(source, strip(x)) for x in (text or "").split("\n")} if text is not None else ())
    expected = Counter()
    for doc, text, _, source, _ in rows:
        if text is None:
            expected[doc, source, None, 0, 0] += 1
            continue
        lines = text.split("\n")
        common = [x for x in lines if strip(x) and on[source, strip(x)] >= 2 and on[source, strip(x)] > 0.2 * pages[source]]
        kept = [x for x in lines if x not in common]
        expected[doc, source, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = linededup.dedup_lines(docs, ratio=0.2)
    assert got.columns == [*docs.columns[:1], *docs.columns[1:], "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.source, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == expected
    assert got.agg(F.sum("n_dropped")).first()[0] > 0


@pytest.mark.parametrize("hosts", [1, 2, 10, 40])
def test_lines_of_hosts_of_any_size(spark, hosts):
    """A line on a third of the pages goes on every host of more than a few pages, one on 4 % of them never."""
    pages = 200 // hosts
    rows = [
        (h * pages + p, "\n".join([f"only {h} {p}"] + ["menu"] * (p % 3 == 0) + ["now and then"] * (p % 25 == 0)), f"host {h}")
        for h in range(hosts)
        for p in range(pages)
    ]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING"))
    for r, (doc, text, _) in zip(sorted(got.collect(), key=lambda r: r.doc_id), rows, strict=True):
        assert r.doc_id == doc and r.text == "\n".join(x for x in text.split("\n") if x != "menu")


# --- op 8


def brute_padding(counts, buckets):
    from itertools import combinations

    lengths = [n for n, c in enumerate(counts) if c]
    best = None
    for cut in combinations(lengths[:-1], min(buckets, len(lengths)) - 1):
        bounds = [*cut, lengths[-1]]
        waste = sum((next(b for b in bounds if b >= n) - n) * counts[n] for n in lengths)
        best = waste if best is None else min(best, waste)
    return best


def test_bounds_waste_least():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(0, 9, 12) * (rng.random(12) < 0.8)
        counts[0] = 0
        if not counts.any():
            continue
        bounds = packing.bucket_bounds(counts, 3)
        waste = sum((next(b for b in bounds if b >= n) - n) * c for n, c in enumerate(counts) if c)
        assert waste == brute_padding(counts.tolist(), 3)


@pytest.mark.parametrize("shard", [packing.SHARD, 5])
def test_packing_holds_every_token(docs, rows, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    got = packing.pack(docs, longest=100, buckets=4, budget=1000).collect()
    expected = Counter()
    for doc, text, *_ in rows:
        n = len(regex.findall(r"[^\x20\x09-\x0D]+", text or ""))
        for piece in range(-(-n // 100)):
            expected[doc, piece, piece * 100, min(100, n - piece * 100)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == expected
    assert len({r.bucket for r in got}) <= 4 and all(r.padding == r.bucket - r.n_tokens >= 0 for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[r.bucket, r.batch].append(r.slot)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= 1000 // bucket
        if (bucket, batch + 1) in batches:
            assert len(slots) == 1000 // bucket


# --- op 4


@pytest.fixture(scope="module")
def pages(spark):
    long, short = "<p>" + "y" * 2000 + "é</p>", "<p>short</p>"
    rows = [(1, "http://a", long), (2, "http://b\nx", long), (3, None, long), (4, "u", short), (5, "u", short)]
    rows += [(6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "z" * 400_000), (9, "u", "z" * 1000), (10, "u", "z" * 999)]
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").withColumn("digest", F.lit(1)).repartition(3)


def test_archives_round_trip(spark, pages, tmp_path):
    files = warc.archive(pages, f"file://{tmp_path}/w", file_bytes=3000)
    assert files.count() > 3 and not list(tmp_path.rglob("*.draft"))
    got = {r.record_id: r for r in warc.read(files).collect()}
    for page, url, html, _ in pages.collect():
        r = got[f"<urn:page:{'' if page is None else page}>"]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = page in (1, 2, None)
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == ("<urn:page:3>" if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == raw
        assert r.url == " ".join((url or "").split())


def test_each_record_is_a_gzip_member(pages, tmp_path):
    import gzip

    path = warc.archive(pages.coalesce(1), str(tmp_path / "w")).orderBy(F.desc("records")).first().path
    whole = gzip.open(path).read()
    with open(path, "rb") as stream:
        parts = list(warc.members(stream, chunk=7))
    assert b"".join(parts) == whole and len(parts) > 1


def test_bad_archives_raise(pages, tmp_path):
    path = warc.archive(pages, str(tmp_path / "w")).first().path
    with open(path, "rb") as stream:
        record = next(warc.members(stream))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(record[:-6] + b"!" + record[-5:])
    with pytest.raises(ValueError, match="long"):
        warc.parsed(record[:-4])
    with open(path, "rb") as stream, open(tmp_path / "cut.gz", "wb") as out:
        out.write(stream.read()[:-3])
    with pytest.raises(ValueError, match="ends inside"), open(tmp_path / "cut.gz", "rb") as stream:
        list(warc.members(stream))


def test_empty_tables(empty, pages):
    assert bpe.encode(empty, tokenizer_path()).count() == 0
    assert exact.exact_groups(empty).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert warc.read(warc.archive(pages.limit(0))).count() == 0


def test_far_fewer_tasks_than_files(spark, tmp_path):
    pages = spark.range(300, numPartitions=4).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat('x', int(id % 50)) AS html")
    files = warc.archive(pages, f"file://{tmp_path}/w", file_bytes=1)
    assert files.count() > 200
    read = warc.read(files)
    parallel = spark.sparkContext.defaultParallelism
    assert read.rdd.getNumPartitions() <= max(parallel, -(-files.count() // warc.FILES_A_TASK))
    assert {(r.record_id, r.payload_bytes) for r in read.collect()} == {(f"<urn:page:{i}>", i % 50) for i in range(300)}


def test_lengths_then_prefixes_then_whole_texts(spark):
    """Groups that part at each of the steps: by length, by the start, by the rest."""
    head = "h" * exact.PREFIX
    texts = ["a", "bb", "bb", head + "x", head + "y", head + "y", "g" + head[1:] + "y", head + " y", head + "long", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    groups = {(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_groups(docs).collect()}
    assert groups == {(0, 0, 1), (1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 7, 3), (5, 7, 3), (6, 6, 1), (7, 7, 3), (8, 8, 1), (9, 10, 2), (10, 10, 2)}
