"""Decontamination, quality classifier and LM scoring."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import attention as A
from ledgerscope.llm import decontamination as D
from ledgerscope.llm import lm_scoring, quality
from ledgerscope.llm.queries import QUERIES, id_remainder
from ledgerscope.llm.subwords import SubwordEncoder, tokenizer_path
from tests.conftest import SF_MID, SF_SMALL


def brute_bm25(items, query, k1=1.2, b=0.75):
    bags = [Counter(D.words_in(t)) for _, t in items]
    n, mean = len(bags), sum(sum(x.values()) for x in bags) / len(bags)
    df = Counter(w for x in bags for w in x)
    out = {}
    for i, x in enumerate(bags):
        size = sum(x.values())
        impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)) for w, tf in x.items()}
        out[i] = sum(v for w, v in impact.items() if w in query) / sum(impact.values())
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_wand_retrieves_all_above_the_threshold(threshold):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, weights, k=r.randint(1, 25)))) for i in range(300)]
    df = Counter(w for _, t in items for w in set(D.words_in(t)))
    mean = sum(len(D.words_in(t)) for _, t in items) / len(items)
    index = D.build_index(items, df, len(items), mean, threshold)
    for _ in range(150):
        query = set(r.choices(vocabulary, k=r.randint(0, 30)))
        want = {i: s for i, s in brute_bm25(items, query).items() if s >= threshold - 1e-9}
        got = dict(D.search(index, query))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        assert not want or D.may_retrieve(index, query & index.heavy.keys())


ITEMS = [(1, "What colour is the quiet river at dawn near the old mill?\nIt is a pale silver grey with thin bands of copper."),
         (2, "Name the seven bridges that cross the northern canal. Answer them in order from east to west please."), (3, ""), (4, None)]


def test_leaks_need_question_and_answer(spark, docs_of, odd_docs, clashing, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    noise = " ".join(f"filler{i}" for i in range(200))
    question, answer = ITEMS[0][1].split("\n")
    docs = docs_of([(1, f"{noise} {ITEMS[0][1].upper()} {noise}"), (2, f"{noise} {question} {noise}"), (3, f"{answer}"), (4, noise),
                    (5, ITEMS[1][1].replace(" ", "\n\t ")), (6, f"{ITEMS[0][1]} {noise} {ITEMS[1][1]}"), (7, None)])
    for block_words in (1_000_000, 20):  # one block, and one of each item
        marked = D.mark_leaks(docs, bench, block_words=block_words)
        got = {x.doc_id: sorted(y.item_id for y in x.leaks) for x in marked.collect()}
        assert got == {1: [1], 2: [], 3: [], 4: [], 5: [2], 6: [1, 2], 7: []}
    assert sorted(x.doc_id for x in D.drop_contaminated(docs, bench).collect()) == [2, 3, 4, 7]
    for df in (odd_docs, clashing):
        kept = D.drop_contaminated(df, bench)
        assert kept.columns == df.columns and kept.count() == df.count()
    assert D.mark_leaks(no_docs, bench).count() == 0
    assert D.drop_contaminated(docs, bench.where("false")).count() == 7


def test_leaks_match_brute_force_on_given_documents(spark):
    """Every item whose whole word sequence is in a text is found; nothing is that shares few of its shingles."""
    items = [(x.item_id, D.words_in(x.text)) for x in spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()]
    texts = {x.doc_id: D.words_in(x.text) for x in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = {(x.doc_id, x.item_id) for x in QUERIES["op4_benchmark_decontamination"](spark, SF_MID).collect()}
    whole = {(d, i) for d, t in texts.items() for i, w in items if w and " ".join(w) in " ".join(t)}
    assert whole and whole <= got
    for d, i in got - whole:
        own = D.shingles(dict(items)[i])
        assert len(own & D.shingles(texts[d])) >= 0.8 * len(own)


def test_prior_estimate_and_risk(spark):
    """Unlabelled rows in several partitions, of which one holds positives alone: prior and network come from all of them."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    none, one = np.zeros(3), np.ones(3)
    for share in (0.3, 0.8):
        k = int(3000 * share)
        u = np.concatenate([good[1000:1000 + k], bad[:3000 - k]])
        mixed = u[np.concatenate([np.arange(200), 200 + rng.permutation(2800)])]
        measures = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(mixed)], "id long, x array<float>").repartitionByRange(4, "id")
        prior = quality.estimate_prior(measures, good[:1000], none, one)
        assert abs(prior - share) < 0.1
        w = quality.averaged_training(measures, good[:1000], quality.initial_weights(3), prior, quality.RATES, none, one)
        s = quality._sigmoid(quality._forward(w, np.concatenate([good[3500:], bad[3500:]]))[1])
        assert np.mean((s >= 0.5) == (np.arange(1000) < 500)) > 0.9


def test_risk_by_brute_force_and_its_gradients():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (7, 4)), rng.normal(0, 1, (9, 4))
    seen = set()
    for prior, push in ((None, 0), (0.3, 0), (0.9, 0), (0.9, -4)):
        w = quality.initial_weights(4, seed=5)
        w[4][0] = push  # a low bias makes the unlabelled part nearly all negative, and its estimate falls below zero
        loss = lambda x, y, w: float(np.mean(np.logaddexp(0, -y * quality._forward(w, x)[1])))
        rp, rn, ru = loss(p, 1, w), loss(p, -1, w), loss(u, -1, w)
        risk, grads = quality.risk_gradients(w, p, u, prior)
        negative = None if prior is None else ru - prior * rn
        assert abs(risk - (rp + ru if prior is None else prior * rp + max(0, negative))) < 1e-12
        seen.add(negative is None or negative >= 0)
        down = (lambda w: loss(p, 1, w) + loss(u, -1, w)) if prior is None else \
            (lambda w: prior * loss(p, 1, w) + loss(u, -1, w) - prior * loss(p, -1, w)) if negative >= 0 else (lambda w: prior * loss(p, -1, w) - loss(u, -1, w))
        for i, a in enumerate(w):
            for at in list(np.ndindex(a.shape))[:8]:
                step = [x.copy() for x in w]
                step[i][at] += 1e-6
                assert abs((down(step) - down(w)) / 1e-6 - grads[i][at]) < 1e-5
    p, u = rng.normal(3, 0.1, (50, 4)), rng.normal(3, 0.1, (50, 4))
    w = quality.train(quality.initial_weights(4), p, u, 0.98, 0.02, rng)
    seen.add(quality.risk_gradients(w, p, u, 0.98)[0] > 0.98 * float(np.mean(np.logaddexp(0, -quality._forward(w, p)[1]))) - 1e-9)
    assert True in seen


def test_training_goes_through_every_row(monkeypatch):
    used = []
    real = quality.risk_gradients
    monkeypatch.setattr(quality, "STEPS", 1)
    monkeypatch.setattr(quality, "BATCH", 4)
    monkeypatch.setattr(quality, "risk_gradients", lambda w, zp, zu, prior: used.extend(zu[:, 0].tolist()) or real(w, zp, zu, prior))
    quality.train(quality.initial_weights(2), np.ones((3, 2)), np.stack([np.arange(11.0), np.zeros(11)], 1), 0.5, 0.01, np.random.default_rng(0))
    assert set(used) == set(range(11)) and len(used) == 12


def test_quality_on_held_out_labels(spark):
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = QUERIES["op10_quality_classifier"](spark, SF_MID).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == (x.score >= 0.3) and 0 <= x.score <= 1 for x in rows)
    seen = [(x.predicted, labels[x.doc_id]) for x in rows if x.held_out and x.doc_id in labels]
    assert np.mean([p == q for p, q in seen]) > 0.93


def test_quality_of_odd_input(spark, odd_docs, clashing, no_docs):
    ids = spark.createDataFrame([(1,), (2,), (6,), (6,), (7,), (99,), (None,)], "doc_id long")
    for df in (odd_docs, clashing):
        model = quality.fit_quality(df, ids)
        got = quality.score_quality(df, model).collect()
        assert len(got) == df.count() and all(0 <= x.score <= 1 for x in got)
        assert len({x.score for x in got if not (x.text or "").strip(" \t\n\r\x0b\x0c")}) == 1
    empty = quality.fit_quality(no_docs, ids)
    assert [x.score for x in quality.score_quality(odd_docs, empty).collect()] == [0.5] * odd_docs.count()
    assert quality.score_quality(no_docs, empty).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 50, 6000).astype(float)
    w = {k: v.astype(np.float64) for k, v in A.initial_weights(A.vocabulary_of(counts)).items()}
    x, y = rng.integers(0, A.SLOTS, (3, A.WINDOW)), rng.integers(0, A.SLOTS, (3, A.WINDOW))
    valid = np.arange(A.WINDOW) < np.array([[32], [5], [17]])
    g, loss = A.gradients(w, x, y, valid)
    for name in w:
        flat, at = w[name].reshape(-1), int(np.argmax(np.abs(g[name])))
        old = flat[at]
        flat[at] = old + 1e-4
        up = A.gradients(w, x, y, valid)[1]
        flat[at] = old - 1e-4
        down = A.gradients(w, x, y, valid)[1]
        flat[at] = old
        assert abs((up - down) / 2e-4 - g[name].reshape(-1)[at]) < 1e-3 * max(1, abs(g[name].reshape(-1)[at])), name


def test_windows_score_each_token_once_and_causally():
    rng = np.random.default_rng(6)
    w = A.initial_weights(A.vocabulary_of(rng.integers(1, 50, 5000).astype(float)))
    lengths = np.array([1, 31, 32, 33, 56, 57, 200, 3])
    slots = rng.integers(0, A.SLOTS, lengths.sum()).astype(np.uint16)
    got = A.score_tokens(w, slots, lengths, 5)
    want = []
    first = 0
    for n in lengths:
        own = slots[first:first + n]
        inputs = np.concatenate([[5], own[:-1]])
        for t in range(n):
            k = 0 if t < A.WINDOW else -(-(t - A.WINDOW + 1) // A.STRIDE)
            h = A._attend(w, inputs[None, k * A.STRIDE:t + 1].astype(np.int64))[6][0, -1:]
            want.append(A.log_probs(w, h, own[t:t + 1].astype(np.int64))[0])
        first += n
    assert np.allclose(got, want, atol=1e-4)
    total = np.exp(A.log_probs(w, np.repeat(rng.normal(size=(1, A.WIDTH)).astype(np.float32), A.SLOTS, 0), np.arange(A.SLOTS))).sum()
    assert abs(total - 1) < 1e-3


def base_of(rows, remainder=7, held=2):
    words = {k: lm_scoring.words_of(t) for k, (_, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if zlib.crc32(("" if i is None else str(i)).encode()) % remainder != held]
    c = Counter()
    for k in train:
        c.update(words[k])
        c[b""] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for k, (i, _) in enumerate(rows):
        own = words[k] + [b""]
        out.append((i, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    return out


def test_base_scores_match_brute_force(odd_docs, clashing, no_docs):
    for df in (odd_docs, clashing):
        rows = [(x.doc_id, x.text) for x in df.collect()]
        got = lm_scoring.score_texts(df, id_remainder(7) != 2, tokenizer_path()).collect()
        got = sorted(((x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in got), key=repr)
        want = sorted(base_of(rows), key=repr)
        assert [x[:4] for x in got] == [x[:4] for x in want]
        assert np.allclose([x[4] for x in got], [x[4] for x in want], rtol=1e-9)
        assert lm_scoring.score_texts(df, F.lit(False), tokenizer_path()).where("n_known = 0 and train_tokens = 0").count() == df.count()
    assert lm_scoring.score_texts(no_docs, F.lit(True), tokenizer_path()).count() == 0


def test_model_beats_word_frequencies_on_held_out_texts(spark):
    rows = QUERIES["op2_lm_scoring"](spark, SF_MID).collect()
    want = {i: x for i, *x in base_of([(x.doc_id, x.text) for x in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()])}
    assert all([x.n_tokens, x.n_known, x.train_tokens] == want[x.doc_id][:3] and abs(x.base_score - want[x.doc_id][3]) < 1e-6 * abs(x.base_score) for x in rows)
    held = [x for x in rows if x.held_out]
    assert held and all(x.score <= 0 for x in rows)
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_model_is_trained_on_every_training_text(docs_of, monkeypatch):
    seen = []
    text = "alpha beta gamma delta " * 500
    rows = [(i, text) for i in range(300)]  # 600 000 words

    def train(texts, vocabulary, tokenizer, *share):
        assert share in ((), (1,))
        seen.extend(x.doc_id for x in texts.select("doc_id").collect())
        return A.initial_weights(vocabulary)
    monkeypatch.setattr(lm_scoring, "train_attention", train)
    lm_scoring.score_texts(docs_of(rows), F.lit(True), tokenizer_path())
    assert sorted(seen) == list(range(300))


def test_training_reads_ids_written_with_the_blocks(docs_of):
    """A text is tokenised once: training texts carry their ids, of which the rounds take every window once."""
    texts = ["Alpha beta\tGAMMA, delta. É😀 <|x", "", "one two " * 400, "held out words", "  \n"]
    rows = docs_of(list(enumerate(texts)), 1).select("doc_id", (F.col("doc_id") != 3).alias("train"), "text")
    blocks = rows.mapInArrow(lm_scoring._blocks(tokenizer_path()), lm_scoring._BLOCKS).collect()
    encoder = SubwordEncoder.of(tokenizer_path())
    end = encoder.size
    spelt = lambda w: np.array(encoder.encode_words([w.decode()])[0] if w else [end], "<u2").tobytes()
    assert all(x.ids == spelt(bytes(x.word)) for x in blocks if x.word is not None)
    got = {x.doc_id: x.ids for x in blocks if x.numbers is not None}
    assert got[3] is None and all(got[i] == b"".join(map(spelt, [*lm_scoring.words_of(texts[i]), b""])) for i in (0, 1, 2, 4))
    vocabulary = A.vocabulary_of(np.bincount(np.concatenate([np.frombuffer(x, "<u2") for x in got.values() if x]), minlength=end + 1).astype(float))
    for i in (0, 1, 2, 4):
        ids = np.frombuffer(got[i], "<u2")
        slots = vocabulary.slot_of[np.concatenate([[end], ids])].tolist()
        want = sorted(slots[k:k + A.WINDOW + 1] for k in range(0, len(ids), A.WINDOW))
        cut = [lm_scoring._windows(i, ids, vocabulary, r) for r in range(len(lm_scoring.RATES))]
        assert sorted(x[:k + 1].tolist() for windows, n in cut for x, k in zip(windows, n)) == want


def test_training_steps_equal_plain_adam():
    """Updates in pieces, with moments kept without their factors, against Adam as written down; and large logits stay finite."""
    rng = np.random.default_rng(9)
    start = {k: v.astype(np.float64) for k, v in A.initial_weights(A.vocabulary_of(rng.integers(1, 50, 6000).astype(float))).items()}
    batches = [(rng.integers(0, A.SLOTS, (4, A.WINDOW)), rng.integers(0, A.SLOTS, (4, A.WINDOW)), np.arange(A.WINDOW) < np.array([[32], [32], [9], [32]]))
               for _ in range(5)]
    got, tokens = A.train_locally(start, batches, 0.02)
    w = {k: v.copy() for k, v in start.items()}
    m, s = {k: 0 for k in w}, {k: 0 for k in w}
    for step, b in enumerate(batches, 1):
        g, _ = A.gradients(w, *b)
        for k in w:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] = w[k] - 0.02 * step / 20 / (1 - 0.9 ** step) * m[k] / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)
    assert tokens == 5 * 105 and all(np.allclose(got[k], w[k], rtol=1e-8, atol=1e-10) for k in w)
    large = {k: (40 * v if k in ("ein", "ecl", "eout", "wk", "wq") else v).astype(np.float32) for k, v in start.items()}
    g, _ = A.gradients(large, *batches[0])
    assert all(np.isfinite(x).all() for x in g.values())


def test_subwords_equal_plain_encoding():
    encoder = SubwordEncoder.of(tokenizer_path())
    r = random.Random(1)
    letters = "abcdeXYZ012 \t\n\r\x0b\x0c\x1c\x85\xa0éÉßİŉ²½ªº_-'.,!?Σσς中文😀́​<|>#"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "it's we'll '' 's", "__##__'s", ""]
    plain = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in encoder.encode(texts)] == plain
    words = sorted({w.decode("utf-8", "surrogatepass") for t in texts for w in lm_scoring.words_of(t)} | {"", "<|endoftext|>", "a\xa0b"})
    alone = [x.ids for x in encoder.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert [list(x) for x in encoder.encode_words(words)] == alone
    latin = [w for w in words if w.isascii() and "<|" not in w]
    assert [list(x) for x in encoder.encode_words(latin)] == [a for w, a in zip(words, alone) if w in set(latin)]
    small = SubwordEncoder(tokenizer_path(), memo=50)
    assert [list(x) for x in small.encode(texts[:500], group=8)] == plain[:500]
