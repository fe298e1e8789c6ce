"""Exact, memoised subword encoding for a tokenizer whose words end at white space.

``word_bpe_49k`` lower-cases, drops white space and never merges across it, so the ids of a text are the ids of
its white-space chunks in order. Each distinct lower-case word is encoded once per worker process and kept in a
bounded memo; only unusual chunks go through the tokenizer one by one. ``tests/llm`` compares with plain encoding.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerscope.llm.common import worker_memo

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Characters for which lower-casing and NFC are per character, so that the word memo applies.
_PLAIN = re.compile(r"[!-±´-¸º»¿-ɏ \t\n\r\x0b\x0c]*")
#: Pre-token pattern of the tokenizer on such characters (a fixed value of the vocabulary file).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")  # white space to str.split, but not to the tokenizer
_LETTERS = re.compile(r"[a-zß-öø-ɏ]+")
_LETTER_WORDS = re.compile(r"[a-zß-öø-ɏ]+(?: [a-zß-öø-ɏ]+)*")
_ENDS = tuple(".,!?;:")  # marks that are pieces by themselves
_ENCODERS: dict[str, "SubwordEncoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class SubwordEncoder:
    """Encoder with a memo (lower-case word or white-space chunk -> ids) that is cleared when full."""

    def __init__(self, path: str, memo: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = memo
        self.memo_of: dict[str, tuple[int, ...]] = worker_memo()
        self.bytes_of: dict[str, bytes] = worker_memo()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        ends = np.zeros(self.size, bool)
        ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.ends = ends

    @classmethod
    def of(cls, path: str) -> "SubwordEncoder":
        """One encoder a worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _plain(self, text: str) -> tuple[int, ...]:
        return tuple(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _learn_words(self, words: list[str]) -> None:
        """Encode many words of letters at once; a word ends at an id that carries the end mark."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(stops) != len(words) or (len(stops) and stops[-1] != len(ids)):
            for w in words:
                self.memo_of[w] = self._plain(w)
            return
        flat, start = ids.tolist(), 0
        for w, stop in zip(words, stops.tolist()):
            self.memo_of[w] = tuple(flat[start:stop])
            start = stop

    def learn(self, chunks: set[str]) -> None:
        """Fill the memo for chunks that are lower-case and plain, or (marked by a leading space) as they are."""
        words, later = [], []
        for c in chunks:
            if c.isalpha():
                words.append(c)
            elif c[:1] == " ":
                self.memo_of[c] = self._plain(c)
            else:
                later.append((c, [c[:-1], c[-1]] if c[:-1].isalpha() and c[-1] in ".,!?;:" else _PIECES.findall(c)))
        known = self.memo_of
        words += {p for _, ps in later for p in ps if p not in known}.difference(words)
        letters = [w for w in words if _LETTERS.fullmatch(w)]
        for i in range(0, len(letters), 2000):
            self._learn_words(letters[i:i + 2000])
        for w in words:
            if w not in known:
                known[w] = self._plain(w)
        for c, ps in later:
            known[c] = known[ps[0]] + known[ps[1]] if len(ps) == 2 else tuple(itertools.chain.from_iterable(map(known.__getitem__, ps)))

    @staticmethod
    def _chunks(text: str) -> list[str]:
        special = "<|" in text  # a special token's string keeps its case and its own id
        if not special and _PLAIN.fullmatch(text):
            return text.lower().split()
        if _SEPARATORS.search(text):
            return [" " + c for c in re.split(r"[ \t\n\r]+", text) if c]
        return [" " + c if special or not _PLAIN.fullmatch(c) else c.lower() for c in text.split()]

    def encode(self, texts: list[str], group: int = 64) -> list[array]:
        """Ids of each text, as unsigned 32-bit arrays; ``group`` texts share a look at the memo."""
        out = []
        for start in range(0, len(texts), group):
            split = [self._chunks(t) for t in texts[start:start + group]]
            missing = set(itertools.chain.from_iterable(split)).difference(self.memo_of)
            if len(self.memo_of) + len(missing) > self.memo and missing:
                self.memo_of.clear()
                missing = set(itertools.chain.from_iterable(split))
            if missing:
                self.learn(missing)
            get = self.memo_of.__getitem__
            out += [array("I", itertools.chain.from_iterable(map(get, s))) for s in split]
        return out

    def _pack(self, text: str) -> bytes:
        ids = self._plain(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn_bytes(self, chunks: set[str]) -> None:
        """As ``learn``, for ``bytes_of``: chunk -> ids as little-endian unsigned 32-bit integers."""
        known, words, pairs, pieces = self.bytes_of, [], [], []
        for c in chunks:
            if c.isalpha():
                words.append(c)
            elif c[:1] == " ":
                known[c] = self._pack(c)
            elif c[-1:] in _ENDS and c[:-1].isalpha():
                pairs.append((c, c[:-1], c[-1]))
            else:
                pieces.append((c, _PIECES.findall(c)))
        wanted = {p for _, *ps in pairs for p in ps}.union(*(ps for _, ps in pieces)).difference(known).union(words)
        letters = wanted if _LETTER_WORDS.fullmatch(" ".join(wanted)) else {w for w in wanted if _LETTERS.fullmatch(w)}
        some = list(letters)
        for i in range(0, len(some), 4000):
            part = some[i:i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                known.update((w, self._pack(w)) for w in part)
                continue
            data, at = ids.tobytes(), 0
            for w, stop in zip(part, (4 * stops).tolist()):
                known[w] = data[at:stop]
                at = stop
        for w in wanted.difference(letters):
            known[w] = self._pack(w)
        for c, head, end in pairs:
            known[c] = known[head] + known[end]
        for c, ps in pieces:
            known[c] = b"".join(map(known.__getitem__, ps))

    def _bytes_of_all(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; the memo is emptied when the distinct chunks asked for do not fit beside it."""
        known = self.bytes_of
        missing = set(chunks).difference(known)
        if missing:
            if len(known) + len(missing) > self.memo:
                known.clear()
                missing = set(chunks)
            known[""] = b""
            missing.discard("")
            self._learn_bytes(missing)
        return list(map(known.__getitem__, chunks))

    def encode_bytes(self, texts: list[str], group: int = 12_000_000) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; as ``encode``.

        About ``group`` characters of plain texts are cut and their chunks numbered by Arrow; only the distinct ones are looked
        up or encoded, and the ids are gathered by number.
        """
        held, chars = [], 0
        for text in texts:
            plain = "<|" not in text and _PLAIN.fullmatch(text)
            held.append((text.lower().replace("\x85", " ").replace("\xa0", " "), True) if plain else (text, False))
            chars += len(text)
            if chars >= group:
                yield from self._encode_group(held)
                held, chars = [], 0
        if held:
            yield from self._encode_group(held)

    def _encode_group(self, held: list[tuple[str, bool]]) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(pa.array([t for t, plain in held if plain], pa.large_string()))
        cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist() if len(lists) else [0]
        chunks = lists.flatten().dictionary_encode()
        del lists
        number = chunks.indices.to_numpy(zero_copy_only=False)
        values = self._bytes_of_all(chunks.dictionary.to_pylist())
        del chunks
        spans = self._gathered(values, number, cuts)
        for text, plain in held:
            yield next(spans) if plain else b"".join(self._bytes_of_all(self._chunks(text)))

    @staticmethod
    def _gathered(values: list[bytes], number: np.ndarray, cuts: list[int], at_once: int = 300_000) -> Iterator[bytes]:
        """Ids of the texts whose chunk numbers lie between two ``cuts``; texts of about ``at_once`` chunks are gathered together."""
        size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(values), "<u4")
        i = 0
        while i < len(cuts) - 1:
            j = max(i + 1, bisect.bisect_right(cuts, cuts[i] + at_once) - 1)
            own = number[cuts[i]:cuts[j]]
            lengths = size[own]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            small = np.int32 if max(upto[-1], len(flat)) < 1 << 31 else np.int64  # half the memory, but for the ids of a gigabyte of text
            data = flat[np.repeat((first[own] - upto[:-1]).astype(small), lengths) + np.arange(upto[-1], dtype=small)].tobytes()
            ends = (4 * upto[np.array(cuts[i:j + 1]) - cuts[i]]).tolist()
            for a, b in zip(ends, ends[1:]):
                yield data[a:b]
            i = j

    @staticmethod
    def _chunks_of_words(words: list[str]) -> list[str]:
        if any("<|" in w for w in words) or not _PLAIN.fullmatch("\n".join(words)):
            return [w.lower() if "<|" not in w and _PLAIN.fullmatch(w) else " " + w for w in words]
        return "\n".join(words).lower().split("\n")

    def encode_words_bytes(self, words: list[str]) -> list[bytes]:
        """As ``encode_words``, in little-endian unsigned 32-bit integers."""
        return self._bytes_of_all(self._chunks_of_words(words))

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words that hold no ASCII white space; as ``encode``, without cutting each word again."""
        chunks = self._chunks_of_words(words)
        missing = set(chunks).difference(self.memo_of)
        missing.discard("")
        if len(self.memo_of) + len(missing) > self.memo:
            self.memo_of.clear()
            missing = set(chunks)
            missing.discard("")
        self.learn(missing)
        get = self.memo_of.get
        return [get(c, ()) for c in chunks]
