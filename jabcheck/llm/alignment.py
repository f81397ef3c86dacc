"""Alignment of the tokens of two vocabularies, each distinct text once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jabcheck.llm.bpe import byte_letters
from jabcheck.llm.common import staged, text_blocks

#: Bytes of text of a block; its links are counted together and looked up together.
BLOCK = 2_000_000
#: Links of one group beyond which its ids are counted before they are paired.
CROWDED = 1_000_000

#: How byte-level vocabularies of this kind split a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these letters alone split alike under every version of the Unicode tables.
SETTLED = re.compile("[\\t\\n\\r -~¡-ɏЀ-ӿ一-龥]*")

_ROWS = (
    "block string, key string, n_docs bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "groups_sha256 string, pair array<int>, times array<bigint>, a array<int>, b array<int>"
)
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Vocabularies:
    """A byte-level BPE file (A) and a sentence-piece model (B), with the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.fast = _merger(a_path, byte)
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [_level(names.get(i, ""), byte) for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8")
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        self.sizes = [np.array([len(t) for t in ts], np.int64) for ts in (self.a_bytes, self.b_bytes)]
        most = max(map(len, self.sizes))
        #: Ids in decimal, followed by what comes after a token: the next one, the other side, the next group.
        self.after = {sep: np.array([f"{i}{sep}" for i in range(most)], object) for sep in ",|;"}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text in both; none where the bytes of either are not a space and the text."""
        spaced = [" " + t for t in texts]
        left = [self.fast.encode_ordinary(t) if self.fast and SETTLED.fullmatch(t) else None for t in spaced]
        slow = [i for i, ids in enumerate(left) if ids is None]
        for i, e in zip(slow, self.a.encode_batch([spaced[i] for i in slow], add_special_tokens=False)):
            left[i] = e.ids
        right = self.b.encode(texts, out_type=int, num_threads=1)
        out = []
        for text, a, b in zip(spaced, left, right):
            raw = text.encode("utf-8")
            same = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same else (np.empty(0, np.int64),) * 2)
        return out


def _level(name: str, byte: dict[str, int]) -> bytes:
    """The bytes of a byte-level entry; entries of other letters, as special tokens have, are taken as text."""
    return bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode("utf-8")


def _merger(path: str, byte: dict[str, int]):
    """A faster encoder with the file's own merges, or None where the file asks for anything else.

    It gives the file's ids where these rise with the merges, and words are split as
    :data:`WORDS` says.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    asks = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][c] for c in byte] + [model["vocab"][m] for m in merges]
    if not plain or asks or spec["normalizer"] or ids[len(byte) :] != sorted(ids[len(byte) :]) or max(ids[: len(byte)]) > min(ids[len(byte) :]):
        return None
    ranks = {_level(t, byte): model["vocab"][t] for t in [*byte, *merges]}
    return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def loaded(a_path: str, b_path: str) -> Vocabularies:
    """One pair of vocabularies per worker process."""
    return Vocabularies(a_path, b_path)


class Aligned:
    """The groups and links of some texts, in flat arrays.

    Tokens of all texts lie behind one another, so offsets where a token ends are unique, and
    those that occur on both sides cut the tokens into groups. ``text``, ``code`` and ``times``
    are the distinct links: the place of the text, A id and B id in one number, and how often
    the text has the link.
    """

    def __init__(self, both: list[tuple[np.ndarray, np.ndarray]], sizes: list[np.ndarray]):
        self.n = [np.array([len(x[side]) for x in both], np.int64) for side in range(2)]
        self.ids = [np.concatenate([x[side] for x in both] or [np.empty(0, np.int64)]) for side in range(2)]
        ends = [np.cumsum(sizes[side][self.ids[side]]) for side in range(2)]
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)
        self.group = [np.searchsorted(cuts, e) for e in ends]
        count = [np.bincount(g, minlength=len(cuts)) for g in self.group]
        text = np.repeat(np.arange(len(both)), self.n[0])
        first = np.cumsum(count[0]) - count[0]
        self.text_of = text[first] if len(cuts) else np.empty(0, np.int64)
        links = count[0] * count[1]
        self.n_groups = np.bincount(self.text_of, minlength=len(both))
        self.n_links = np.zeros(len(both), np.int64)
        np.add.at(self.n_links, self.text_of, links)
        self.text, self.code, self.times = self._links(count, links)

    def _links(self, count: list[np.ndarray], links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (left, right), (ga, gb) = self.ids, self.group
        start = [np.cumsum(c) - c for c in count]
        plain = links[ga] <= CROWDED
        g = ga[plain]
        n = count[1][g]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = [(np.repeat(self.text_of[g], n) << 32) | (np.repeat(left[plain], n) << 16) | right[np.repeat(start[1][g], n) + within]]
        times = [np.ones(len(keys[0]), np.int64)]
        for group in np.flatnonzero(links > CROWDED):
            sides = [
                np.unique(ids[s[group] : s[group] + c[group]], return_counts=True) for ids, s, c in zip(self.ids, start, count)
            ]
            (a, na), (b, nb) = sides
            keys.append(((self.text_of[group] << 32) | (a[:, None] << 16) | b[None, :]).ravel())
            times.append((na[:, None] * nb[None, :]).ravel())
        flat, weight = np.concatenate(keys), np.concatenate(times)
        distinct, place = np.unique(flat, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, weight)
        return distinct >> 32, distinct & 0xFFFFFFFF, total

    def written(self, after: dict[str, np.ndarray]) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        parts = []
        for side, sep in ((0, "|"), (1, ";")):
            last = np.r_[self.group[side][1:] != self.group[side][:-1], True] if len(self.ids[side]) else np.empty(0, bool)
            ids = self.ids[side]
            parts.append(np.where(last, after[sep][ids], after[","][ids]))
        order = np.argsort(np.concatenate([2 * self.group[0], 2 * self.group[1] + 1]), kind="stable")
        flat = np.concatenate(parts)[order].tolist()
        ends = np.cumsum(self.n[0] + self.n[1])
        return ["".join(flat[e - n : e])[:-1] for e, n in zip(ends.tolist(), (self.n[0] + self.n[1]).tolist())]


def _key(text: Column) -> Column:
    return F.sha2(text, 256)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, text_column: str = "text") -> DataFrame:
    """Each distinct text that is not empty, tokenised and aligned once, and the links of each block.

    Rows with a ``key`` are texts: the number of documents, the measures, and as ``pair`` and
    ``times`` the links by their place in the list of the block. Rows without one are such
    lists: the ids ``a`` and ``b`` and, as ``times``, how many documents of the block have the
    link. Texts meet by their full content, counted before they move.
    """
    text = docs[text_column]
    distinct = docs.select(text.alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n_docs"))
    rows = distinct.select(_key(F.col("text")).alias("key"), "n_docs", "text")
    schema = pa.schema(
        [("block", pa.string()), ("key", pa.string()), ("n_docs", pa.int64())]
        + [(n, pa.int64()) for n in MEASURES[:4]]
        + [("groups_sha256", pa.string()), ("pair", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
        + [("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(a_path, b_path)
        for block in text_blocks(batches, "text", BLOCK):
            keys, docs_of = block.column("key").to_pylist(), block.column("n_docs").to_numpy(zero_copy_only=False)
            found = Aligned(words.encode(block.column("text").to_pylist()), words.sizes)
            pairs, place = np.unique(found.code, return_inverse=True)
            holding = np.zeros(len(pairs), np.int64)
            np.add.at(holding, place, docs_of[found.text])
            cuts = np.searchsorted(found.text, np.arange(len(keys) + 1))
            spelt = found.written(words.after)
            n = len(keys)
            columns = {
                "block": [keys[0]] * (n + 1),
                "key": [*keys, None],
                "n_docs": [*docs_of.tolist(), None],
                "n_a": [*found.n[0].tolist(), None],
                "n_b": [*found.n[1].tolist(), None],
                "n_groups": [*found.n_groups.tolist(), None],
                "n_links": [*found.n_links.tolist(), None],
                "groups_sha256": [*[hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelt], None],
                "pair": [*[place[s:e].astype(np.int32) for s, e in zip(cuts, cuts[1:])], None],
                "times": [*[found.times[s:e] for s, e in zip(cuts, cuts[1:])], holding],
                "a": [None] * n + [(pairs >> 16).astype(np.int32)],
                "b": [None] * n + [(pairs & 0xFFFF).astype(np.int32)],
            }
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return rows.mapInArrow(run, _ROWS)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``a, b, n, best``: in how many documents the ids are linked, and whether that is the most of any link of ``a``.

    The lists of blocks are counted already, so a link that most documents have is a row for
    each block.
    """
    lists = texts.filter("key is null").select(F.explode(F.arrays_zip("a", "b", "times")).alias("x"))
    counts = staged(lists.groupBy("x.a", "x.b").agg(F.sum("x.times").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _measured(texts: pa.Table, links: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of the texts of one block, from the looked-up list of its links."""
    order = np.argsort(links.column("place").to_numpy())
    n = links.column("n").to_numpy()[order]
    best = links.column("best").to_numpy()[order].astype(np.int64)
    pair, times = texts.column("pair").combine_chunks(), texts.column("times").combine_chunks()
    sizes = np.diff(pair.offsets.to_numpy())
    text = np.repeat(np.arange(texts.num_rows), sizes)
    place, weight = pair.flatten().to_numpy(), times.flatten().to_numpy()
    sums = [np.zeros(texts.num_rows, np.int64) for _ in range(2)]
    np.add.at(sums[0], text, weight * best[place])
    np.add.at(sums[1], text, weight * n[place])
    kept = texts.drop_columns(["block", "pair", "times"])
    return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures of the alignment for each row: ``doc_id``, :data:`MEASURES` and ``groups_sha256``.

    Vocabulary A encodes a space and the text, B the text; offsets where tokens of both end cut
    them into groups, and all pairs of an A and a B token in a group are links. ``n_best`` are
    the links that as many documents have as any link of their A id, ``count_sum`` sums over
    links the number of documents that have them. Special tokens in texts are plain text.
    NULL and empty texts, and those that either vocabulary does not give back byte for byte,
    have zeros and ''. Ids may be NULL or repeat; each row gives one row. Extra columns are
    ignored. The paths must name files that every executor can read.

    Each distinct text is aligned once and counts as often as it occurs. Tasks count links by
    blocks of about 2 MB, so what is summed, looked up and sent back is one row for a link and
    block; the lookups of a block and its texts, both bounded by the block, meet in one group.
    """
    texts = staged(aligned_texts(docs, a_path, b_path, text_column))
    counts = staged(pair_counts(texts))
    lists = texts.filter("key is null").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "x"))
    links = lists.select("block", "place", "x.a", "x.b").join(counts, ["a", "b"])
    links = links.select("block", "place", "n", "best").toDF("block", "place", "n", "best")
    held = texts.filter("key is not null and n_links > 0").select(
        "block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"
    )
    schema = "key string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    measures = staged(held.groupBy("block").cogroup(links.groupBy("block")).applyInArrow(_measured, schema))
    rows = docs.select(docs[id_column].alias("id"), _key(docs[text_column]).alias("text_key"))
    joined = rows.join(measures, rows["text_key"] == measures["key"], "left")
    return joined.select(
        F.col("id").alias(id_column),
        *[F.coalesce(F.col(m), F.lit(0).cast("bigint")).alias(m) for m in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
