"""Sampled segmentations of texts into the pieces of a SentencePiece model, and lossless decoding.

All ways to cut a text into pieces form a lattice. Forward filtering adds up, for each place, the weights of all cuts
that lead there; backward sampling then draws a cut from the end, each with its exact chance. A draw hangs on the
row's key and the place alone, so a row is always cut alike.

No piece holds a blank behind another character. So every cut has a border before a blank that follows another
character, and the lattice falls into words: those of a batch of texts are filtered once each, all places at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from codeloom.llm.shared import slices

#: Texts are taken together up to about this many code points.
TOGETHER = 1 << 21
#: Longer words are filtered one by one, with logarithms.
LONG_WORD = 48
SEED = 10
_WORD = re.compile(" *[^ ]+| +")
_BORDER = re.compile("[^ ](?= )")
_DENSE = 1024


class Lattice:
    """Pieces of a model with weights: the likelier, the earlier the piece was merged when the model was made.

    A piece of rank r has weight (r + 2) ** -sharpness, 2 being the first rank; a character without a piece is
    spelt in bytes, with the weight of the last piece.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_ids = np.zeros(256, dtype=np.int64)
        self.weights = np.zeros(self.size)
        self.pieces: dict[str, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" "):
                    raise ValueError("a piece holds a blank behind another character")
                self.pieces[text] = i
                self.bytes_of[i] = text.encode()
                self.weights[i] = (min(-model.get_score(i), self.size) + 2) ** -sharpness
        self.spelt = (self.size + 2) ** -sharpness
        self.longest = max(map(len, self.pieces))
        self._trie()

    def _trie(self) -> None:
        """Nodes of all beginnings of pieces; ``next[node, code]`` is a node or 0. Node 1 is the root."""
        letters = sorted({c for p in self.pieces for c in p})
        self.code = np.zeros(0x110000, dtype=np.int32)
        for i, c in enumerate(letters, 1):
            self.code[ord(c)] = i
        numbers, edges, inner = {"": 1}, {}, {1: 1}
        piece_of = [-1, -1]
        for piece in self.pieces:
            at = 1
            for n in range(1, len(piece) + 1):
                below = numbers.get(piece[:n])
                if below is None:
                    below = numbers[piece[:n]] = len(numbers) + 1
                    piece_of.append(-1)
                    edges[(at, int(self.code[ord(piece[n - 1])]))] = below
                    inner.setdefault(at, len(inner) + 1)
                at = below
            piece_of[at] = self.pieces[piece]
        self.piece_of = np.array(piece_of, dtype=np.int64)
        self.row = np.zeros(len(piece_of), dtype=np.int64)
        self.row[list(inner)] = list(inner.values())
        self.dense = np.zeros((len(inner) + 1, _DENSE), dtype=np.int32)
        rare = []
        for (at, code), below in edges.items():
            if code < _DENSE:
                self.dense[self.row[at], code] = below
            else:
                rare.append((at * (1 << 20) + code, below))
        rare.sort()
        self.rare_keys, self.rare_nodes = (np.array([r[i] for r in rare] + [1 << 62 if i == 0 else 0], dtype=np.int64) for i in range(2))

    def _below(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        found = self.dense[self.row[node], np.where(code < _DENSE, code, 0)].astype(np.int64)
        rare = np.flatnonzero(code >= _DENSE)
        if len(rare):
            keys = node[rare] * (1 << 20) + code[rare]
            at = np.searchsorted(self.rare_keys, keys)
            found[rare] = np.where(self.rare_keys[at] == keys, self.rare_nodes[at], 0)
        return found

    def _edges(self, words: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, id, weight) of all pieces in ``words``, laid end to end. An id from ``size`` on is a character to spell."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        codes = self.code[letters]
        end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
        start = np.arange(len(codes))
        node, parts = np.ones(len(codes), dtype=np.int64), []
        single = np.zeros(len(codes), dtype=bool)
        live = start
        for n in range(1, self.longest + 1):
            node = self._below(node, codes[live + n - 1])
            on = node > 0
            live, node = live[on], node[on]
            whole = self.piece_of[node] >= 0
            if n == 1:
                single[live[whole]] = True
            parts.append((live[whole], live[whole] + n, self.piece_of[node[whole]]))
            more = (self.row[node] > 0) & (live + n < end[live])
            live, node = live[more], node[more]
            if not len(live):
                break
        bare = np.flatnonzero(~single)
        parts.append((bare, bare + 1, self.size + letters[bare].astype(np.int64)))
        a, b, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return a, b, ids, np.where(ids < self.size, self.weights[np.minimum(ids, self.size - 1)], self.spelt)

    def _filtered(self, words: list[str], ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each place: its first incoming piece; of pieces, by place: from, id and the sum of chances so far."""
        a, b, ids, weights = self._edges(words, ends)
        begins = np.concatenate(([0], ends[:-1]))
        depth = b - np.repeat(begins, np.diff(np.concatenate(([0], ends))))[b - 1]
        order = np.argsort((depth * (int(ends[-1]) + 1) + b) * (self.longest + 1) + b - a)  # by depth, then place, then length
        a, b, ids, weights, depth = a[order], b[order], ids[order], weights[order], depth[order]
        # ahead[p]: the weights of all cuts of a word up to its place p. A word's first place has none before it,
        # and shares its number with the last place of the word before: `ahead` is kept by the piece's last character.
        ahead = np.zeros(int(ends[-1]))
        chance = np.empty(len(a))
        steps = np.flatnonzero(np.diff(depth, prepend=0))
        fresh = np.zeros(int(ends[-1]) + 1, dtype=bool)
        fresh[begins] = True
        for i, at in enumerate(steps):
            stop = steps[i + 1] if i + 1 < len(steps) else len(a)
            before = np.where(fresh[a[at:stop]], 1.0, ahead[a[at:stop] - 1])
            chance[at:stop] = before * weights[at:stop]
            groups = np.flatnonzero(np.diff(b[at:stop], prepend=-1))
            ahead[b[at:stop][groups] - 1] = np.add.reduceat(chance[at:stop], groups)
        chance /= ahead[b - 1]
        groups = np.flatnonzero(np.diff(b, prepend=-1))
        sums = np.cumsum(chance)
        base = np.repeat(np.concatenate(([0.0], sums[groups[1:] - 1])), np.diff(np.append(groups, len(b))))
        sums -= base
        sums[np.append(groups[1:], len(b)) - 1] = 2.0
        first = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
        first[b[groups]] = groups
        return first, a, ids, sums

    def _long_word(self, word: str, key: int, place: int) -> list[tuple[int, int]]:
        """(place, id) of the pieces of one long word; only one number is kept for each of its places."""
        n = len(word)
        ahead = np.full(n + 1, -np.inf)
        ahead[0] = 0.0

        def into(j: int) -> list[tuple[int, int, float]]:
            found = [(i, self.pieces[word[i:j]]) for i in range(max(0, j - self.longest), j) if word[i:j] in self.pieces]
            known = [(i, p, ahead[i] + np.log(self.weights[p])) for i, p in found]
            if not found or found[-1][0] != j - 1:
                known.append((j - 1, self.size + ord(word[j - 1]), ahead[j - 1] + np.log(self.spelt)))
            return known

        for j in range(1, n + 1):
            parts = np.array([x[2] for x in into(j)])
            top = parts.max()
            ahead[j] = top + np.log(np.exp(parts - top).sum())
        cut, j = [], n
        while j:
            u = float(_draws(np.array([key], dtype=np.uint64), np.array([place + j]))[0])
            for i, piece, weight in into(j):
                u -= np.exp(weight - ahead[j])
                if u < 0:
                    break
            cut.append((place + i, piece))
            j = i
        return cut

    def sampled(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, a blank put before it. ``keys``: a 64-bit number for each text."""
        found: list[np.ndarray] = []
        waiting: list[tuple[str, int, int, bool]] = []
        held = 0
        for text, key in zip(texts, keys.tolist()):
            place, whole = 0, " " + text
            while len(whole) - place > TOGETHER and (border := _BORDER.search(whole, place + TOGETHER)):
                waiting.append((whole[place:border.end()], key, place, False))
                place = border.end()
                found += self._cut(waiting)
                waiting, held = [], 0
            waiting.append((whole[place:] if place else whole, key, place, True))
            held += len(whole) - place
            if held > TOGETHER:
                found += self._cut(waiting)
                waiting, held = [], 0
        found += self._cut(waiting)
        return self._joined(found)

    @staticmethod
    def _joined(parts: list[tuple[np.ndarray, bool]]) -> list[np.ndarray]:
        texts, open_parts = [], []
        for ids, last in parts:
            open_parts.append(ids)
            if last:
                texts.append(open_parts[0] if len(open_parts) == 1 else np.concatenate(open_parts))
                open_parts = []
        return texts

    def _cut(self, parts: list[tuple[str, int, int, bool]]) -> list[tuple[np.ndarray, bool]]:
        """Ids of each (part of a text, key, place of the part, whether it is the text's last)."""
        if not parts:
            return []
        lists = [_WORD.findall(p[0]) for p in parts]
        words = [w for ws in lists for w in ws]
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        which = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        distinct = list(known)
        lengths = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
        counts = [len(ws) for ws in lists]
        sizes = np.array([len(p[0]) for p in parts])
        part_begins = np.cumsum(sizes) - sizes
        key = np.repeat(np.array([p[1] for p in parts], dtype=np.uint64), counts)
        shift = np.repeat(np.array([p[2] for p in parts]) - part_begins, counts)  # from a place here to one in the text
        begins = np.cumsum(lengths[which]) - lengths[which]
        placed = np.full(int(sizes.sum()), -1, dtype=np.int64)
        short = np.flatnonzero(lengths <= LONG_WORD)
        if len(short):
            number = np.full(len(distinct), -1, dtype=np.int64)
            number[short] = np.arange(len(short))
            ends = np.cumsum(lengths[short])
            first, origin, ids, sums = self._filtered([distinct[i] for i in short], ends)
            live = np.flatnonzero(number[which] >= 0)
            own = number[which[live]]
            zero = (ends - lengths[short])[own]
            at, to_text, row_key = ends[own], begins[live] - zero, key[live]
            moved = shift[live]
            while len(at):
                u = _draws(row_key, at + to_text + moved)
                edge = first[at]
                later = np.flatnonzero(u >= sums[edge])
                while len(later):
                    edge[later] += 1
                    later = later[u[later] >= sums[edge[later]]]
                at = origin[edge]
                placed[at + to_text] = ids[edge]
                on = at > zero
                at, to_text, row_key, moved, zero = at[on], to_text[on], row_key[on], moved[on], zero[on]
        for i in np.flatnonzero(lengths[which] > LONG_WORD):
            for place, piece in self._long_word(words[i], int(key[i]), int(begins[i] + shift[i])):
                placed[place - shift[i]] = piece
        return [(self._spelt(part[part >= 0]), p[3]) for part, p in zip(np.split(placed, part_begins[1:]), parts)]

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        """``ids`` with characters that have no piece spelt in bytes."""
        odd = ids >= self.size
        if not odd.any():
            return ids.astype(np.int32)
        spelt = [chr(c).encode() for c in (ids[odd] - self.size).tolist()]
        lengths = np.ones(len(ids), dtype=np.int64)
        lengths[odd] = np.fromiter(map(len, spelt), dtype=np.int64, count=len(spelt))
        found = np.repeat(ids, lengths)
        found[np.repeat(odd, lengths)] = self.byte_ids[np.frombuffer(b"".join(spelt), dtype=np.uint8)]
        return found.astype(np.int32)

    def decoded(self, ids: np.ndarray) -> str:
        """The text that was cut into ``ids``."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()[1:]


def _draws(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers from 0 up to 1 that hang on a row's key and a place in its text alone (a mixed counter)."""
    x = keys + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def segmented(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", seed: int = SEED, sharpness: float = 1.0,
              keep_ids: bool = True) -> DataFrame:
    """(key, n_pieces, ids_crc32, lossless, ids): a sampled segmentation of each whole text. Map-only.

    A null or empty text gives the pieces of the blank that is put before each text. Rows with the same key and text
    are cut alike; a null key is a key of its own. ``lossless`` tells whether decoding gave the text back; ``ids`` is
    null where ``keep_ids`` is off.
    """
    schema = T.StructType([docs.schema[key_col], T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("lossless", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, sharpness)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in batch.column(0).to_pylist()], dtype=np.uint64)
            found = lattice.sampled(texts, keys)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                pa.array([lattice.decoded(f) == t for f, t in zip(found, texts)], pa.bool_()),
                pa.array([f if keep_ids else None for f in found], pa.list_(pa.int32()))], names=schema.names)

    return docs.select(key_col, docs[text_col].cast("string").alias("_text")).mapInArrow(cut, schema)


def joined(segments: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``segments`` with the text that its ids spell in column ``out``; null ids give null."""
    kept = segments.drop(out)
    at = kept.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path)
        for batch in slices(batches):
            texts = [None if i is None else lattice.decoded(np.asarray(i, dtype=np.int64)) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(decode, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))
