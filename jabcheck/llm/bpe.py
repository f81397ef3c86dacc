"""Byte-pair encoding and decoding with a public vocabulary, merged in batched numpy rounds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame

from jabcheck.llm.common import text_blocks

#: Distinct words a worker remembers; it starts anew beyond that.
REMEMBERED = 200_000

#: The white space of Unicode, in which the vocabulary's patterns see one blank.
WHITE = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 stands for itself, the other bytes for the letters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE vocabulary with word ends, read from a tokenizer file.

    Encoding follows the file: special tokens are cut out of the raw text; the rest is brought
    to NFC, white space becomes one blank, letters go to lower case one by one, and the words
    that the file's pattern finds are merged on their bytes. Decoding joins the tokens by
    blanks, since the file has no decoder.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocabulary = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = dict(zip(vocabulary.values(), vocabulary)) | {i: t for t, i in special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.words = regex.compile(_find_pattern(spec["pre_tokenizer"]))
        self.white = regex.compile(WHITE + "+")
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + end] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = len(self.names)
        keys = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.known: dict[str, np.ndarray] = {}

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search over the sorted pair keys."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word. All words lie in one flat array and are merged together.

        A round finds the lowest rank of each word and merges every pair of that rank, from
        the left where pairs overlap. Words without a pair left leave the array.
        """
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(sizes)
        symbols[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        none = len(self.keys)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self.ranked(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            over = lowest == none
            if over.any():
                for s, n in zip(starts[over], lengths[over]):
                    done[word[s]] = symbols[s : s + n]
                keep = np.repeat(~over, lengths)
                symbols, word, rank = symbols[keep], word[keep], rank[keep]
                lowest, lengths = lowest[~over], lengths[~over]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1  # overlapping pairs, as in "aaa"
            first = at[np.flatnonzero(np.r_[True, np.diff(at) != 1])]
            at = at[(at - first[run]) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        return done

    def split(self, text: str) -> list[str | int]:
        """Words as text and special tokens as ids, in order."""
        parts: list[str | int] = []
        start = 0
        for match in self.cut.finditer(text):
            parts += self._plain(text[start : match.start()])
            parts.append(self.special[match.group()])
            start = match.end()
        return parts + self._plain(text[start:]) if start else self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        # str.lower() looks at the neighbours of a capital sigma, the vocabulary does not
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return self.words.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [self.split(t) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        every = [p for ps in parts for p in ps]
        if not every:
            return [np.empty(0, np.int64) for _ in texts]
        codes, distinct = pd.factorize(pd.Series(every, dtype=object))
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = [w for w in distinct if type(w) is str and w not in self.known]
        if fresh:
            self.known.update(zip(fresh, self.merged(fresh)))
        ids = [self.known[w] if type(w) is str else np.array([w], np.int64) for w in distinct]
        sizes = np.array([len(i) for i in ids], np.int64)
        pool, offset = np.concatenate(ids), np.cumsum(sizes) - sizes
        n = sizes[codes]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat = pool[np.repeat(offset[codes], n) + within]
        words_end = np.cumsum(counts)
        ends = np.r_[0, np.cumsum(n)][words_end]
        return np.split(flat, ends[:-1])

    def decode(self, ids: Iterable[int]) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


def _find_pattern(pre_tokenizer: dict) -> str:
    """The pattern of the step that keeps what it matches."""
    steps = pre_tokenizer.get("pretokenizers", [pre_tokenizer])
    pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and s["invert"])
    return pattern.replace(r"[^\s", "[^" + WHITE[1:-1])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One vocabulary per worker process."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_tokens, ids, ids_sha256, decoded, decoded_sha256`` for each row.

    ``path`` names a tokenizer file that every executor can read. A NULL text counts as empty,
    and an empty text has no ids and decodes to ''. Ids may be NULL or repeat; each row gives
    one row. Other columns are ignored.
    """
    return _applied(docs, path, id_column, text_column, full=True)


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``encode``, without the ids and the decoded text themselves."""
    return _applied(docs, path, id_column, text_column, full=False)


def _applied(docs: DataFrame, path: str, id_column: str, text_column: str, full: bool) -> DataFrame:
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if full else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for block in text_blocks(batches, "text"):
            ids = bpe.encode([t or "" for t in block.column("text").to_pylist()])
            decoded = [bpe.decode(i.tolist()) for i in ids]
            columns = {
                "id": block.column("id"),
                "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded], pa.string()),
            }
            if full:
                columns |= {
                    "ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                    "decoded": pa.array(decoded, pa.string()),
                }
            yield pa.RecordBatch.from_pydict(columns)

    out = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_column)
