"""Packing by powers of two: each document is cut into pieces whose lengths are powers of two.

A piece is a training sequence of its own; batches draw sequences from one length bucket, so no sequence
holds tokens of two documents and none needs padding.
"""

from __future__ import annotations

import functools
import json
import re
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeloom.llm.shared import CHUNK, chunks, slices, written

LONGEST = 4096
END_ID = 2
#: White space for every tokenizer that drops white space; words between are encoded on their own.
_WORD = re.compile(r"[^ \t\n\r]+")
#: Texts of these characters alone keep their ids in lower case and when cut at blanks: ASCII without the separators
#: 1C to 1F, letters and signs of Latin-1, dashes, quotes and the euro sign.
_PLAIN = re.compile("[\x00-\x1b -\x7f\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xff\u2010-\u2027\u2030-\u205e\u20ac]*")
#: Stands between words that are encoded together; no plain text holds it.
_BETWEEN = "\x1f"
#: Words whose ids a worker has in each of two memories, the newer and the older; a full one becomes the older.
WORDS_KEPT = 400_000
#: Words that are encoded in one call.
TOGETHER = 2048
#: The steps before the model that this module relies on (fixed values, as written in tokenizer files).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Sub-buckets of a length, numbered apart so that no task sorts a whole length bucket.
DEALS = 256

PIECES = "rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file, as little-endian unsigned 32-bit numbers.

    A tokenizer that lowers letters and drops white space gives a text the ids of its words in order, so each word
    is encoded once while it is remembered. Words of plain texts are remembered in lower case. A tokenizer with
    other steps before its model encodes whole texts.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self._tokenizer.to_str())
        self._marks = [token["content"] for token in steps["added_tokens"]]
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        between = self._tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        relied_on = (_NORMALIZER, _PRE_TOKENIZER, "</w>", 1)
        self._by_words = (steps["normalizer"], steps["pre_tokenizer"], steps["model"].get("end_of_word_suffix"), len(between)) == relied_on
        self._between = between[0] if between else -1
        self._words: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn_plain(self, words: list[str]) -> None:
        """Words without the ASCII punctuation behind their last letter or digit are encoded, and so is that punctuation."""
        cut = []
        for word in words:
            stem = word.rstrip(string.punctuation)
            if not (stem and stem[-1].isalnum()):
                stem = word
            cut.append((word, stem, word[len(stem):]))
        parts = {stem for _, stem, _ in cut}
        parts.update(tail for _, _, tail in cut if tail)
        new = parts.difference(self._words)
        letters = [part for part in new if part.isalpha()]
        for start in range(0, len(letters), TOGETHER):
            self._learn_letters(letters[start:start + TOGETHER])
        rest = list(new.difference(letters))
        for start in range(0, len(rest), TOGETHER):
            self._learn_parts(rest[start:start + TOGETHER])
        known = self._words
        known.update([(word, known[stem] + known[tail]) for word, stem, tail in cut if tail])

    def _learn_letters(self, stems: list[str]) -> None:
        """Stems of letters alone: each is one word to the model, and ends with the first piece that closes a word."""
        ids = self._encode(" ".join(stems))
        ends = (4 * (np.flatnonzero(self._closes[ids]) + 1)).tolist()
        found = ids.tobytes()
        self._words.update((stem, found[a:b]) for stem, a, b in zip(stems, [0, *ends], ends))

    def _learn_parts(self, words: list[str]) -> None:
        ids = self._encode(f" {_BETWEEN} ".join([*words, ""]))
        ends = np.flatnonzero(ids == self._between)
        found, starts = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
        self._words.update((word, found[a:b]) for word, a, b in zip(words, starts, (4 * ends).tolist()))

    def _learn_others(self, words: list[str]) -> None:
        for start in range(0, len(words), TOGETHER):
            self._learn_whole(words[start:start + TOGETHER])

    def _learn_whole(self, words: list[str]) -> None:
        found = self._tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(found.ids, dtype="<u4").tobytes()
        ends = (4 * np.searchsorted(np.asarray(found.word_ids, dtype=np.int64), np.arange(1, len(words) + 1))).tolist()
        self._words.update((word, ids[a:b]) for word, a, b in zip(words, [0, *ends], ends))

    def _recall(self, words: set[str], learn: Callable[[list[str]], None]) -> None:
        """Have the ids of all ``words`` in the newer memory."""
        missing = words.difference(self._words)
        if len(self._words) > WORDS_KEPT:
            self._words, self._older = {}, self._words
            missing = words
        older = self._older
        self._words.update([(word, older[word]) for word in missing if word in older])
        new = [word for word in missing if word not in older]
        if new:
            learn(new)

    def _joined(self, texts: list[str]) -> list[bytes]:
        if not self._by_words:
            return [self._encode(text).tobytes() for text in texts]
        plain, others = [], []
        lists: list[list[str]] = []
        for text in texts:
            if _PLAIN.fullmatch(text) and not any(mark in text for mark in self._marks):
                lists.append(text.lower().split())
                plain.append(lists[-1])
            else:
                lists.append(_WORD.findall(text))
                others.append(lists[-1])
        found: dict[int, bytes] = {}
        for part, learn in ((plain, self._learn_plain), (others, self._learn_others)):
            if part:
                self._recall(set().union(*part), learn)
                found.update((id(words), b"".join(map(self._words.__getitem__, words))) for words in part)
        return [found[id(words)] for words in lists]

    def ids_of(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; a null one counts as empty. Texts are taken together up to about a million characters."""
        waiting, size = [], 0
        for text in texts:
            text = text or ""
            if len(text) > CHUNK:
                yield from (found + self._end for found in self._joined(waiting))
                waiting, size = [], 0
                parts = chunks(text) if self._by_words else [text]
                yield b"".join([*(self._joined([part])[0] for part in parts), self._end])
                continue
            waiting.append(text)
            size += len(text)
            if size > CHUNK:
                yield from (found + self._end for found in self._joined(waiting))
                waiting, size = [], 0
        yield from (found + self._end for found in self._joined(waiting))


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, end_id: int | None = END_ID) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that words are remembered from task to task."""
    return WordEncoder(path, end_id)


def binary_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, none above ``longest``, largest first, that add up to ``tokens``."""
    found = [longest] * (tokens // longest)
    rest = tokens % longest
    return found + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST,
                 keep_ids: bool = True) -> DataFrame:
    """Each document's tokens, cut into binary lengths.

    A null text counts as empty and gives the end id alone. Rows with the same id, repeated rows included, are
    documents of their own (``rid`` tells them apart). Other columns are not looked at. ``ids`` holds a piece's
    ids as little-endian unsigned 32-bit numbers, or null where ``keep_ids`` is off.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in PIECES.split(", "))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in slices(batches):
            rows = []
            rids, names, texts = (batch.column(i).to_pylist() for i in range(3))
            for rid, doc, ids in zip(rids, names, map(memoryview, encoder.ids_of(texts))):
                start = 0
                tokens = len(ids) // 4
                for n in binary_lengths(tokens, longest):
                    part = ids[4 * start:4 * (start + n)]
                    rows.append((rid, doc, start, n, zlib.crc32(part), tokens, bytes(part) if keep_ids else None))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST,
         keep_ids: bool = True) -> DataFrame:
    """``token_pieces`` with ``sequence_id`` (gapless from 0, short buckets first) and ``offset`` (always 0).

    Pieces are written once to the shared folder, so texts are encoded once. They are numbered inside
    (length, deal) groups; a table of at most ``13 * DEALS`` group counts gives each group its first number.
    An empty table gives no rows.
    """
    deal = F.pmod(F.xxhash64("doc_id", "rid", "start"), F.lit(DEALS)).alias("deal")
    pieces = written(token_pieces(docs, path, id_col, text_col, longest, keep_ids).select("*", deal), "pieces")
    counts = pieces.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = Window.orderBy("length", "deal").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("length", "deal").orderBy("doc_id", "rid", "start"))
    return (pieces.withColumn("place", place.cast("long") - 1).join(F.broadcast(firsts), ["length", "deal"])
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), "ids"))
