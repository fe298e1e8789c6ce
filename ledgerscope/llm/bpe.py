"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a partition's texts lie behind one another in one symbol array. An index maps each pair of
neighbouring symbols that has a merge rank to all its positions there. The active ranks are applied in ascending
order, each to all its positions at once, and every merge enters the two new neighbour pairs into their lists. A
merged symbol is first made by its own rank, so that a pair that holds it always has a higher one (checked when the
vocabulary is read) and one ascending pass over the ranks equals merging each piece by itself.

Encoding and decoding are narrow passes: a task holds the texts of one record batch and a bounded memo of pieces.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerscope.llm.common import map_with_columns

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed values of the vocabulary's kind: the pre-token pattern, in Unicode, and its classes written out for texts of Latin-1 or ASCII alone.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+"
                          r"| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Pieces kept in the memo of a worker process (it is emptied when full), and the longest one that is kept.
MEMO, MEMO_CHARS = 500_000, 64
#: Characters of distinct pieces in one index (a longer piece has its own).
INDEX_CHARS = 1_000_000
_CODECS: dict[str, "ByteBpe"] = {}
_UNASSIGNED: list[re.Pattern] = []


def byte_characters() -> dict[str, int]:
    """Character of a vocabulary entry -> byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20,) and not 0x7F <= b <= 0xA0]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def unassigned() -> re.Pattern:
    """One character that ``unicodedata`` does not know: there the libraries' Unicode versions may differ."""
    if not _UNASSIGNED:
        spans: list[list[int]] = []
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c)) == "Cn":
                if spans and spans[-1][1] == c - 1:
                    spans[-1][1] = c
                else:
                    spans.append([c, c])
        _UNASSIGNED.append(re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"))
    return _UNASSIGNED[0]


class ByteBpe:
    """Vocabulary, merge ranks and a memo piece -> ids (little-endian unsigned 32-bit)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_characters()
        self.path, self.vocab = path, model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(max(self.vocab.values()), max(self.special.values(), default=0)) + 1
        self.bytes_of = [b""] * self.size
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(map(to_byte.__getitem__, token))
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for token, b in to_byte.items():
            self.byte_ids[b] = self.vocab[token]
        self.rank: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        made = {self.vocab[c] for c in to_byte}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, new = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if x not in made or y not in made or new in made:
                raise ValueError(f"merge {r} does not follow the merges that make its parts")
            made.add(new)
            self.rank[x * self.size + y] = r
            self.rules.append((x, y, new))
        self.byte_ranks = np.full((256, 256), -1, np.int64)
        for (a, x), (b, y) in itertools.product([(b, self.vocab[c]) for c, b in to_byte.items()], repeat=2):
            self.byte_ranks[a, b] = self.rank.get(x * self.size + y, -1)
        self.memo: dict[str, bytes] = {}
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._library = None

    @classmethod
    def of(cls, path: str) -> "ByteBpe":
        """One codec a worker process."""
        if path not in _CODECS:
            _CODECS[path] = cls(path)
        return _CODECS[path]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii():
            return ASCII_PIECES.findall(text)
        try:
            text.encode("latin-1")
            return LATIN_PIECES.findall(text)
        except UnicodeEncodeError:
            pass
        if not unassigned().search(text):
            return PIECES.findall(text)
        if self._library is None:  # the library's own Unicode tables decide
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def merge(self, pieces: Iterable[str]) -> list[bytes]:
        """Ids of each piece, by one pair occurrence index over all of them."""
        data = [p.encode("utf-8") for p in pieces]
        ends = np.cumsum([0, *map(len, data)])
        starts = ends.tolist()
        raw = np.frombuffer(b"".join(data), np.uint8)
        flat = self.byte_ids[raw]
        size, rank_of, rules = self.size, self.rank.get, self.rules
        # neighbours by place; -1 at the two ends of a piece
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        filled = ends[1:] > ends[:-1]
        after[ends[1:][filled] - 1] = before[ends[:-1][filled]] = -1
        # the first entries of the index, pairs of single bytes, come from a table; the lists are cut from one sorted array
        follows = np.flatnonzero(after >= 0)
        ranks = self.byte_ranks[raw[follows], raw[follows + 1]]
        follows, ranks = follows[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        follows, ranks = follows[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts_of = [0, *cuts.tolist()] if len(ranks) else []
        flat_places = follows.tolist()
        places = {r: flat_places[i:j] for r, i, j in zip(ranks[starts_of].tolist(), starts_of, [*starts_of[1:], len(flat_places)])}
        symbols, after, before = flat.tolist(), after.tolist(), before.tolist()
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, new = rules[r]
            for p in sorted(places.pop(r)):
                q = after[p]
                if symbols[p] != left or q < 0 or symbols[q] != right:
                    continue  # an earlier merge took one of the two
                symbols[p], symbols[q] = new, -1
                n, b = after[q], before[p]
                after[p] = n
                if n >= 0:
                    before[n] = p
                    k = rank_of(new * size + symbols[n])
                    if k is not None:
                        if k in places:
                            places[k].append(p)
                        else:
                            places[k] = [p]
                            heapq.heappush(active, k)
                if b >= 0:
                    k = rank_of(symbols[b] * size + new)
                    if k is not None:
                        if k in places:
                            places[k].append(b)
                        else:
                            places[k] = [b]
                            heapq.heappush(active, k)
        out = np.array(symbols, np.int64)
        kept = np.concatenate([[0], np.cumsum(out >= 0)])[starts].tolist()
        data = out[out >= 0].astype("<u4").tobytes()
        return [data[4 * a:4 * b] for a, b in zip(kept, kept[1:])]

    def encode(self, texts: list[str], group: int = 1_000_000) -> Iterator[bytes]:
        """Ids of each text; about ``group`` characters of texts share one index (a longer text has its own)."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= group:
                yield from self._encode_group(held)
                held, chars = [], 0
        if held:
            yield from self._encode_group(held)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        split: list[list[str]] = []
        special: list[dict[int, int]] = []
        for text in texts:
            parts = [text]
            if self._split_special is not None and any(s in text for s in self.special):
                parts = self._split_special.split(text)
            if len(parts) == 1:
                split.append(self.pieces(text))
                special.append({})
                continue
            row, at = [], {}
            for k, part in enumerate(parts):
                if k % 2:
                    at[len(row)] = self.special[part]
                    row.append("")
                else:
                    row += self.pieces(part)
            split.append(row)
            special.append(at)
        missing = set().union(*split).difference(self.memo)
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            missing = set().union(*split)
        missing = sorted(missing)
        known = self.memo
        part, chars = [], 0
        for piece in missing:
            part.append(piece)
            chars += len(piece)
            if chars >= INDEX_CHARS:
                known.update(zip(part, self.merge(part)))
                part, chars = [], 0
        known.update(zip(part, self.merge(part)))
        out = []
        for row, at in zip(split, special):
            ids = map(known.__getitem__, row)
            if at:
                ids = [at[k].to_bytes(4, "little") if k in at else x for k, x in enumerate(ids)]
            out.append(b"".join(ids))
        for piece in missing:
            if len(piece) > MEMO_CHARS:
                del known[piece]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text", names: tuple[str, str] = ("n_tokens", "ids")) -> DataFrame:
    """All columns of ``docs`` plus the number of ids (long) and the ids (binary, little-endian unsigned 32-bit).

    ``vocabulary`` is the path of a byte-level BPE file, readable by every task. Null and empty texts have no ids (0, empty).
    Special tokens' strings become their own ids. Repeated rows are encoded once each; a column of ``docs`` that has an
    added name is replaced; an empty table gives an empty one. The texts of one record batch are held at a time.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        codec = ByteBpe.of(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids = list(codec.encode([x.as_py() or "" for x in texts]))
            yield [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return map_with_columns(docs, [(names[0], T.LongType()), (names[1], T.BinaryType())], run)


def decode_ids(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` plus the text of its ids; null ids are an empty text.

    An id beyond the vocabulary, or a binary whose length is no multiple of four, is an error.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        codec = ByteBpe.of(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            yield [pa.array([codec.decode(x.as_py() or b"") for x in column], pa.string())]

    return map_with_columns(encoded, [(name, T.StringType())], run)
