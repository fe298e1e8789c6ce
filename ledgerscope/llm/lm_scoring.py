"""LM scoring: a causal self-attention model over subword ids, learnt from the training texts, scores every text.

Texts are cut into blocks of ``BLOCK_BYTES`` and written as the numbers of their words, beside the block's dictionary with
the subword ids of each word (subwords never cross words, so a block's distinct words are tokenised once). Training texts
are written as subword ids too.

Learning. Word counts come from all training texts (a shuffle of the dictionaries' partial counts), subword counts from
the dictionaries. Attention weights are learnt from all windows of all training texts: each round cuts another slice of
the windows from the written ids in one narrow pass, every task trains a copy of the weights on its part, in mixed order,
and the copies are averaged by Spark, piece by piece.

Scoring. The dictionaries' words are joined to the corpus counts, and a block's numbers meet its own dictionary in a
cogroup: nothing that grows with the corpus is broadcast, and no text is shuffled. Overlapping
context windows score each subword once in batches. The score of a text is the log probability under a mixture,
word by word, of the attention model and the word frequencies, with a uniform prior over the mixture weight of
each text. White space is not modelled. An unknown word has the frequencies' unknown share times its attention
probability.
"""

from __future__ import annotations

import binascii
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm import attention as A
from ledgerscope.llm.common import materialise, text_or_empty, words_of
from ledgerscope.llm.subwords import SubwordEncoder

BLOCK_BYTES = 28 << 20
#: Learning rate of each round.
RATES = (0.02, 0.014, 0.007, 0.002)
BATCH_WINDOWS = 48
#: Mixture weights of the attention model.
WEIGHTS = (0.0, 0.15, 0.4, 0.7, 1.0)
TOKENS_A_TASK = 1_000_000
#: Windows that a task holds to mix their order.
MIXED = 16_384
_PIECE = 8192
#: Words whose subwords are gathered at once.
GATHERED = 300_000
_TYPES = {"block": pa.int64(), "doc_id": pa.int64(), "train": pa.bool_(), "numbers": pa.binary(), "number": pa.int32(), "word": pa.binary(), "n": pa.int64(),
          "ids": pa.binary()}
_BLOCKS = "block long, doc_id long, train boolean, numbers binary, number int, word binary, n long, ids binary"


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _blocks(tokenizer: str):
    """Blocks of neighbouring rows, (partition << 32) + block within the partition, as rows of two kinds.

    A text: doc_id, train, the numbers of its words in the block's dictionary (unsigned 32-bit; the empty word ends it), and
    if it is a training text the ids of its subwords, with the end's.
    A word: its number, how often training texts of the block have it, and its subword ids. Ids take as few bytes as fit; the
    end of a text has the id after the last. A block holds ``BLOCK_BYTES`` of texts, or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, size = TaskContext.get().partitionId(), 0, 0
        encoder = SubwordEncoder.of(tokenizer)
        kind = _id_type(encoder.size)
        number = _Numbers()
        ids, trains, texts = [], [], []

        def of(rows, /, **columns):
            columns["block"] = np.full(rows, (part << 32) + block, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in _TYPES.items()], names=list(_TYPES))

        def flush():
            words = list(number)
            spelt = encoder.encode_words_bytes([w.decode("utf-8", "replace") for w in words])
            spelt[number[b""]] = np.array([encoder.size], "<u4").tobytes()
            lengths = np.fromiter(map(len, spelt), np.int64, len(spelt)) >> 2
            flat = np.frombuffer(b"".join(spelt), "<u4").astype(kind)
            starts = np.cumsum(lengths) - lengths
            n = np.zeros(len(words), np.int64)
            for a, b in _groups_of(texts, GATHERED):
                learnt = [t for t, train in zip(texts[a:b], trains[a:b]) if train]
                slices = iter(())
                if learnt:
                    own = np.concatenate(learnt)
                    n += np.bincount(own, minlength=len(words))
                    data = flat[_spread(starts[own], lengths[own])].tobytes()
                    stops = (kind.itemsize * np.cumsum(np.add.reduceat(lengths[own], np.cumsum([0, *map(len, learnt[:-1])])))).tolist()
                    slices = (data[i:j] for i, j in zip([0, *stops], stops))
                yield of(b - a, doc_id=ids[a:b], train=trains[a:b], numbers=[t.tobytes() for t in texts[a:b]],
                         ids=[next(slices) if train else None for train in trains[a:b]])
            step, data = kind.itemsize, flat.tobytes()
            yield of(len(words), number=np.arange(len(words)), word=words, n=n,
                     ids=[data[step * i:step * j] for i, j in zip(starts.tolist(), (starts + lengths).tolist())])

        for b in batches:
            for doc_id, train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = words_of(text.as_py())
                words.append(b"")
                here = sum(map(len, words)) + len(words)
                if size and size + here > BLOCK_BYTES:
                    yield from flush()
                    number, ids, trains, texts, block, size = _Numbers(), [], [], [], block + 1, 0
                size += here
                ids.append(doc_id)
                trains.append(train)
                texts.append(np.fromiter(map(number.__getitem__, words), "<u4", len(words)))
        if ids:
            yield from flush()
    return run


def _groups_of(texts: list[np.ndarray], most: int) -> Iterator[tuple[int, int]]:
    """Slices of neighbouring texts that hold about ``most`` words."""
    a = held = 0
    for b, t in enumerate(texts, 1):
        held += len(t)
        if held >= most or b == len(texts):
            yield a, b
            a, held = b, 0


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its length, end to end."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _subword_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            flat, lengths = _flat_ids(b.column(1), size - 1)
            total += np.bincount(flat, weights=np.repeat(b.column(0).to_numpy(), lengths), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64))], names=["id", "n"])
    return run


def _id_type(end: int) -> np.dtype:
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def _flat_ids(column, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of binaries end to end, and how many each row has (``end``: the largest id)."""
    data, kind = column.to_pylist(), _id_type(end)
    return np.frombuffer(b"".join(data), kind), np.fromiter(map(len, data), np.int64, len(data)) // kind.itemsize


def _windows(doc_id: int | None, ids: np.ndarray, vocabulary: A.Vocabulary, round: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text that ``round`` takes, one a row: a slot before and up to ``WINDOW`` slots; and how many each has.

    ``ids``: the text's, with the end's; an end comes before it.
    """
    of_text = binascii.crc32(f"{doc_id}/".encode())
    starts = range(0, len(ids), A.WINDOW)
    taken = np.array([i for i in starts if binascii.crc32(b"%d" % i, of_text) % len(RATES) == round], np.int64)
    slots = np.zeros(len(starts) * A.WINDOW + 1, vocabulary.slot_of.dtype)
    slots[0] = vocabulary.slot_of[-1]
    vocabulary.slot_of.take(ids, out=slots[1:len(ids) + 1], mode="clip")
    return slots[taken[:, None] + np.arange(A.WINDOW + 1)], np.minimum(A.WINDOW, len(ids) - taken)


def _local_training(weights: dict[str, np.ndarray], vocabulary: A.Vocabulary, round: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([round, TaskContext.get().partitionId()])
        kind = _id_type(len(vocabulary.slot_of) - 1)

        def mixed(held: list[tuple[np.ndarray, np.ndarray]]):
            windows, n = (np.concatenate(x) for x in zip(*held))
            order = rng.permutation(len(n))  # an order without runs of one text
            for i in range(0, len(order), BATCH_WINDOWS):
                some = order[i:i + BATCH_WINDOWS]
                x = windows[some].astype(np.int64)
                yield x[:, :-1], x[:, 1:], np.arange(A.WINDOW) < n[some][:, None]

        def groups():
            held, count = [], 0
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1)):
                    held.append(_windows(doc_id, np.frombuffer(ids.as_py(), kind), vocabulary, round))
                    count += len(held[-1][1])
                    if count >= MIXED:
                        yield from mixed(held)
                        held, count = [], 0
            if count:
                yield from mixed(held)

        trained, tokens = A.train_locally(weights, groups(), RATES[round])
        if tokens:
            flat = A.flatten(trained).astype(np.float32)
            pieces = [flat[i:i + _PIECE].tobytes() for i in range(0, len(flat), _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([tokens] * len(pieces), pa.int64()),
                                              pa.array(pieces, pa.binary())], names=["piece", "tokens", "values"])
    return run


def _average(table: pa.Table) -> pa.Table:
    """Mean of one piece over all tasks, weighted by their tokens."""
    total, mass = 0.0, 0
    for tokens, values in zip(table.column("tokens"), table.column("values")):
        total = total + tokens.as_py() * np.frombuffer(values.as_py(), np.float32).astype(np.float64)
        mass += tokens.as_py()
    return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "values": pa.array([(total / mass).astype(np.float32).tobytes()], pa.binary())})


def train_attention(texts: DataFrame, vocabulary: A.Vocabulary, ids_col: str) -> dict[str, np.ndarray]:
    """Weights learnt from all windows of ``texts``: doc_id, and in ``ids_col`` the subword ids with the end's (see ``_blocks``).

    ``vocabulary`` counts the subwords of these texts. Each round reads the ids again and takes its slice of the windows.
    """
    tasks = max(1, -(-int(vocabulary.counts.sum()) // (len(RATES) * TOKENS_A_TASK)))
    weights = A.initial_weights(vocabulary)
    for r in range(len(RATES)):
        rows = (texts.select("doc_id", ids_col).coalesce(tasks)  # narrow: few tokens are not spread over many copies
                .mapInArrow(_local_training(weights, vocabulary, r), "piece int, tokens long, values binary")
                .groupBy("piece").applyInArrow(_average, "piece int, values binary").orderBy("piece").collect())
        if rows:
            weights = A.unflatten(np.concatenate([np.frombuffer(x["values"], np.float32) for x in rows]), weights)
    return weights


def _score_block(weights: dict[str, np.ndarray], vocabulary: A.Vocabulary, denominator: float):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("number")
        counts = words.column("c").to_numpy()
        flat, lengths = _flat_ids(words.column("ids"), len(vocabulary.slot_of) - 1)
        starts = np.cumsum(lengths) - lengths
        slots, inside = vocabulary.slot_of[flat], vocabulary.inside[flat]
        base10, base = np.log10((counts + 1) / denominator), np.log((counts + 1) / denominator)
        end_slot = int(vocabulary.slot_of[-1])
        doc_ids = texts.column("doc_id").to_pylist()
        out: list[tuple] = []

        def score(group: list[np.ndarray]) -> None:
            n_words = np.fromiter(map(len, group), np.int64, len(group))
            word = np.concatenate(group)
            n = lengths[word]
            token = _spread(starts[word], n)
            first_word = np.cumsum(n_words) - n_words
            lp = A.score_tokens(weights, slots[token], np.add.reduceat(n, first_word), end_slot) + inside[token]
            upto = np.concatenate([[0.0], np.cumsum(lp, dtype=np.float64)])
            ends = np.cumsum(n)
            a = upto[ends] - upto[ends - n]
            known = counts[word] > 0
            b = np.where(known, base[word], a - math.log(denominator))
            with np.errstate(divide="ignore"):
                mixed = np.stack([np.add.reduceat(np.logaddexp(a + np.log(g), b + np.log(1 - g)) if 0 < g < 1 else a if g else b, first_word) for g in WEIGHTS])
            top = mixed.max(0)
            total = (top + np.log(np.exp(mixed - top).mean(0))) / math.log(10)
            out.append((n_words, np.add.reduceat(known.astype(np.int64), first_word), np.add.reduceat(base10[word], first_word), total,
                        np.add.reduceat(a, first_word) / math.log(10)))

        group, held = [], 0
        for x in texts.column("numbers"):
            own = np.frombuffer(x.as_py(), "<u4").astype(np.int64)
            group.append(own)
            held += len(own)
            if held > 30_000:
                score(group)
                group, held = [], 0
        if group:
            score(group)
        n_tokens, n_known, base_score, total, alone = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": n_tokens, "n_known": n_known, "base_score": base_score,
                         "score": total, "attention_score": alone})
    return run


def score_texts(docs: DataFrame, training: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score, attention_score.

    ``training`` (over the columns of ``docs``; null counts as false) says which rows are learnt from; all are scored.
    Tokens are words after lower-casing A-Z, and one end a text. ``base_score``: add-one word frequencies, log10;
    ``score``: the model's log10 probability of the text; ``attention_score``: that of the attention model alone.
    Null and empty texts have the end alone. Without training rows nothing is known and the model is unfitted.
    Null ids stay null; repeated rows are counted and scored each; other columns are not read. An empty table gives none.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"),
                       text_or_empty(f"`{text_col}`").alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks(tokenizer), _BLOCKS), compression="zstd")
    words = blocks.where("word is not null").select(F.col("block").alias("own_block"), "number", "word", "n", "ids")
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), compression="zstd")
    total = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    denominator = float(total.n + 1 * (total.v + 1))
    frequency = np.zeros(SubwordEncoder.of(tokenizer).size + 1)
    for r in (words.where("n > 0").select("n", "ids").mapInArrow(_subword_counts(len(frequency)), "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).limit(len(frequency)).collect()):
        frequency[r.id] = r.n
    vocabulary = A.vocabulary_of(frequency)
    weights = train_attention(blocks.where("numbers is not null and train").select("doc_id", "ids"), vocabulary, "ids")
    dictionary = words.select("own_block", "number", "word", "ids").join(counts.hint("merge"), "word").select("own_block", "number", "c", "ids")
    scored = (blocks.where("numbers is not null").select("block", "doc_id", "numbers").groupBy("block").cogroup(dictionary.groupBy("own_block"))
              .applyInArrow(_score_block(weights, vocabulary, denominator),
                            "doc_id long, n_tokens long, n_known long, base_score double, score double, attention_score double"))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(int(total.n)).cast("long").alias("train_tokens"), "base_score", "score", "attention_score")
