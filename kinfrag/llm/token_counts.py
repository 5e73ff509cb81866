"""Token counts by rank-synchronous merging of byte-pair encodings.

Pre-tokens that a task has not met before are held together as one ragged numpy array: all
symbols end to end, with the offset where each pre-token begins. In every round each pre-token
finds the lowest merge rank among its own adjacent pairs, and all pre-tokens apply theirs at
once. A pre-token whose pairs have no rank is finished, and its surviving symbols are counted.

Only pre-tokens are cached (up to ``CACHE`` of them, then the cache starts anew), so a task's
memory is bounded whatever the corpus. There is no shuffle: one pass over the texts.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
CACHE = 1_000_000
#: Code points of a text that are split into pre-tokens at once; a cut falls between words only.
PIECE = 1_000_000
#: Bytes of new pre-tokens that are merged together.
MERGE_BYTES = 300_000

#: Where a long text may be cut: pre-tokens and normal forms are the same on either side.
CUT = re.compile(r" (?=[A-Za-z])")
#: No code point of these is assigned, though the matcher takes a few of them for letters.
LETTERS = r"[\p{L}--[\U00032800-\U0003FFFF]]"
#: U+0130 counts as beyond because its lower case has a combining mark.
BEYOND_LATIN = re.compile("[^\u0000-\u012f\u0131-\u024f]")
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def latin_class(kind: str) -> str:
    """The code points below U+0250 of a general category, for a character class."""
    return "".join(f"\\u{i:04x}" for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


class RankMerger:
    """Counts the symbols of pre-tokens by the merges of a vocabulary with word-end symbols."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.normalizer = Tokenizer.from_file(path).normalizer
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        split = split.replace(r"[\p{L}]", r"\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\p{L}", LETTERS)
        self.words = regex.compile(split, regex.V1)
        fixed = split.split("|" + LETTERS)[0]
        letters, digits = (latin_class(kind) for kind in "LN")
        spaces = r"\t-\r\x20\x85\xa0"
        self.latin_words = re.compile(f"{fixed}|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in model["merges"]], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks = pairs[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.known: dict[str, int] = {}

    def pair_ranks(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The merge rank of each symbol with the next; none across two pre-tokens."""
        ranks = np.full(len(symbols), NO_RANK, np.int32)
        keys = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ranks[:-1] = np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)
        ranks[starts[1:] - 1] = NO_RANK
        return ranks

    def symbol_counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each (non-empty) pre-token keeps after all merges."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        symbols = self.inner[raw]
        symbols[starts + lengths - 1] = self.last[raw[starts + lengths - 1]]
        counts, ids = np.zeros(len(words), np.int64), np.arange(len(words))
        while len(ids):
            lengths = np.diff(np.append(starts, len(symbols)))
            ranks = self.pair_ranks(symbols, starts)
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest != NO_RANK
            counts[ids[~going]] = lengths[~going]
            if not going.any():
                break
            if not going.all():
                keep = np.repeat(going, lengths)
                symbols, ranks = symbols[keep], ranks[keep]
                ids, lengths, lowest = ids[going], lengths[going], lowest[going]
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            hit = ranks == np.repeat(lowest, lengths)
            if (hit[1:] & hit[:-1]).any():
                # In a run such as "aaa" pairs overlap; every second one counts, from the left.
                index = np.arange(len(hit))
                begins = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
                hit &= (index - begins) % 2 == 0
            symbols[hit] = self.merged[ranks[hit]]
            stays = np.append(True, ~hit[:-1])
            lengths = np.add.reduceat(stays.astype(np.int64), starts)
            symbols = symbols[stays]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return counts

    def learn(self, fresh: list[str]) -> None:
        at = 0
        raw = [w.encode() for w in fresh]
        while at < len(raw):
            end, held = at, 0
            while end < len(raw) and (end == at or held + len(raw[end]) <= MERGE_BYTES):
                held += len(raw[end])
                end += 1
            self.known.update(zip(fresh[at:end], self.symbol_counts(raw[at:end]).tolist(), strict=True))
            at = end

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in parts, each with whether it is a special string."""
        for i, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if part:
                yield part, i % 2 == 1

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE and (found := CUT.search(text, at + PIECE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """The token count of each text; new pre-tokens of about ``PIECE`` code points are merged together."""
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part, special in self.segments(text):
                if special:
                    totals[i] += 1
                    continue
                for piece in self.pieces(part):
                    held.append((i, self.split(piece)))
                    size += len(piece)
                    if size >= PIECE:
                        self.settle(held, totals)
                        held, size = [], 0
        self.settle(held, totals)
        return totals

    def split(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; those of Latin letters alone take a shorter way to the same ones."""
        if piece.isascii() or not BEYOND_LATIN.search(piece) and unicodedata.is_normalized("NFC", piece):
            return self.latin_words.findall(piece.lower())
        return self.words.findall(self.normalizer.normalize_str(piece))

    def settle(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        words = set().union(*(w for _, w in held))
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = words
        self.learn(list(fresh))
        for i, found in held:
            totals[i] += sum(map(self.known.__getitem__, found))


@functools.cache
def merger(vocabulary: str) -> RankMerger:
    import os

    import public_tokenizers

    return RankMerger(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null or empty text has no bytes and no tokens; a null ``doc_id`` and repeated rows pass
    through, one row each. Other columns of ``docs``, whatever their names, are not read.
    ``vocabulary`` is a file of the public tokenizers or a path that every executor can open.
    """
    narrow = docs.select(F.col("doc_id"), F.col("text").alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", narrow.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = m.count_all(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=schema.names,
            )

    return narrow.mapInArrow(run, schema)
