"""Ranked search, periodic runs and BPE against brute force and the tokenizers library, with odd rows and skewed lists."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerscope.llm import bpe, ranked_search, runs
from ledgerscope.llm.queries import QUERIES, with_planted_periods
from ledgerscope.llm.subwords import tokenizer_path
from tests.conftest import SF_SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document in full."""
    texts = [(i, Counter(t)) for i, x in docs for t in [plain_terms(x)] if t]
    n_docs, total = len(texts), sum(sum(t.values()) for _, t in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, tf in texts:
            m = 100 - 75 + (75 * sum(tf.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t in plain_terms(text) if tf[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item_id, r, f[2], -f[0]) for r, f in enumerate(found[:k], 1)]
    return out


def by_text(rows):
    return sorted(rows, key=repr)


def item_table(spark, items):
    return spark.createDataFrame(items, "item_id LONG, text STRING").repartition(2)


def searched(spark, docs, items, k=10):
    return by_text(tuple(r) for r in ranked_search.search(docs, item_table(spark, items), k=k).collect())


def random_corpus(rnd, n, words=60):
    vocab = [f"w{i}" for i in range(words)]
    return [(i, " ".join(rnd.choices(vocab, [1 / (j + 1) for j in range(words)], k=rnd.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("postings", [3_000_000, 40])
def test_search_matches_full_scoring(spark, docs_of, monkeypatch, postings):
    """One block a task and many blocks a task, copies (ties) and repeated terms included."""
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "GROUP_WORDS", 100)
    rnd = random.Random(4)
    docs = random_corpus(rnd, 120)
    docs += [(1000 + i, docs[3][1].upper()) for i in range(40)] + [(7, "rare W1")]
    items = [(i, " ".join(rnd.choices([f"w{j}" for j in range(70)], k=rnd.randint(1, 25)))) for i in range(12)] + [(50, docs[3][1]), (51, "rare rare RARE")]
    assert searched(spark, docs_of(docs), items) == by_text(brute_search(docs, items))


def test_search_reads_lists_only_as_far_as_needed():
    """A document with the top of every list is final before the long lists are read."""
    n = 20_000
    term = np.concatenate([np.zeros(n, np.int64), np.ones(n, np.int64)])
    doc = np.concatenate([np.arange(n), np.arange(n)])
    tf = np.ones(2 * n, np.int64)
    tf[[5, n + 5]] = 50
    index = ranked_search.ImpactIndex(term, doc, tf, np.full(n, 10), np.arange(n), np.zeros(n, bool), 2, n, 10 * n)

    read = []

    class Counting(np.ndarray):
        def __mul__(self, weight):  # parts are read as impact slices times the list's weight
            read.append(len(self))
            return np.asarray(self) * weight
    index.impact = index.impact.view(Counting)
    best = ranked_search.Best(1)
    index.search([(0, 900), (1, 900)], best)
    assert best.id.tolist() == [5] and sum(read) <= 4 * 64 and not index.low.any() and (index.slot == -1).all()
    read.clear()
    index.search([(0, 1), (1, 1)], best)  # what is known already keeps the block from being read
    assert best.id.tolist() == [5] and read == []


def test_search_ties_go_to_the_least_ids_and_weights_of_common_terms_are_zero(spark, docs_of):
    docs = [(i, "same text here") for i in range(300)] + [(-5, "same text here"), (None, "same text here"), (900, "other thing")]
    items = [(1, "same"), (2, "other same"), (3, "missing")]
    got = searched(spark, docs_of(docs), items)
    assert got == by_text(brute_search(docs, items))
    assert not [r for r in got if r[0] == 3]


def test_search_odd_rows(spark, docs_of, odd_docs, clashing, no_docs):
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "hello AGAIN again"), (1, "hello AGAIN again"), (None, "alpha Éé gamma"), (2, None), (3, ""), (4, "É😀"), (5, " \n")]
    want = by_text(brute_search(odd, items))
    assert searched(spark, odd_docs, items) == want and searched(spark, clashing, items) == want
    assert searched(spark, no_docs, items) == [] and searched(spark, odd_docs, []) == []
    assert ranked_search.search(no_docs, item_table(spark, [])).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_many_blocks_of_items(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 60)
    rnd = random.Random(9)
    docs = random_corpus(rnd, 40)
    items = [(i, " ".join(rnd.choices([f"w{j}" for j in range(60)], k=8))) for i in range(9)]
    assert searched(spark, docs_of(docs), items, k=3) == by_text(brute_search(docs, items, k=3))


def test_search_query_on_small_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = by_text(tuple(r) for r in QUERIES["op11_ranked_search"](spark, SF_SMALL).collect())
    assert got == by_text(brute_search(docs, items))


def brute_runs(words, min_length=6, exponent=4):
    """(start, length, period) of every longest stretch, diagonal by diagonal."""
    best = {}
    for d in range(1, len(words) // exponent + 1):
        i = d
        while i < len(words):
            if words[i] != words[i - d]:
                i += 1
                continue
            j = i
            while j < len(words) and words[j] == words[j - d]:
                j += 1
            if j - i + d >= max(min_length, exponent * d):
                best.setdefault((i - d, j - i + d), d)
            i = j
    return sorted(((s, n, d) for (s, n), d in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rnd = random.Random(2)
    cases = []
    for _ in range(1500):
        letters, words = "abcdefgh"[:rnd.choice([1, 2, 3, 8])], ""
        for _ in range(rnd.randint(0, 5)):
            words += "".join(rnd.choices(letters, k=rnd.randint(0, 9)))
            words += ("".join(rnd.choices(letters, k=rnd.randint(1, 12))) * 9)[:rnd.randint(0, 60)]
        cases.append([w.encode() for w in words])
    found = [r for a in range(0, len(cases), 100) for r in runs.runs_of_texts(cases[a:a + 100])]
    assert found == [brute_runs(c) for c in cases]
    assert sum(map(len, found)) > 1000
    for min_length, exponent in ((1, 4), (20, 4), (6, 5)):
        assert runs.runs_of_texts(cases[:300], min_length, exponent) == [brute_runs(c, min_length, exponent) for c in cases[:300]]
    with pytest.raises(ValueError):
        runs.runs_of_texts(cases[:1], exponent=3)


def test_runs_of_frequent_words_are_linear():
    """One repeated word, a long period, and a text full of squares but without a fourth power."""
    assert runs.runs_of_texts([[b"x"] * 300_000]) == [[(0, 300_000, 1)]]
    block = [str(i).encode() for i in range(5_000)]
    assert runs.runs_of_texts([block * 7 + block[:17]]) == [[(0, 35_017, 5_000)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 50_000:
        a, b = b, b + a
    assert runs.runs_of_texts([b]) == [[]]


def test_diagonal_table_emits_when_a_diagonal_ends():
    table = runs.DiagonalTable(6, 4)
    for i in range(5, 9):
        table.end_before(i)
        table.word(i, [(1, 3)])
    assert table.runs == []
    table.end_before(10)
    assert table.runs == [(2, 7, 1)] and not table.active


def test_runs_over_documents(spark, docs_of, odd_docs, clashing, no_docs):
    texts = {1: "a b c " + "x y " * 6 + "d", 2: "q\x0bq\x0cq q\tq\nq q", 3: "none here"}
    rows = {r.doc_id: r for r in runs.find_runs(docs_of(list(texts.items()))).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(3, 12, 2)] and rows[1].collapsed == "a b c x y d"
    assert [tuple(x) for x in rows[2].runs] == [(0, 7, 1)] and rows[2].collapsed == "q"
    assert rows[3].runs == [] and rows[3].collapsed == "none here"
    for docs in (odd_docs, clashing):
        got = runs.find_runs(docs)
        assert set(got.columns) == set(docs.columns) | {"runs", "collapsed"}
        for r in got.collect():
            words = runs.text_words(r.text)
            assert [tuple(x) for x in r.runs] == brute_runs(words[:200] if r.doc_id == 6 else words) or r.doc_id == 6
            assert r.doc_id != 6 or [tuple(x) for x in r.runs] == [(0, 120_000, 4)]
    assert runs.find_runs(no_docs).collect() == []


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_query_by_brute_force(spark, odd_docs):
    for docs in (spark.read.parquet(f"{SF_SMALL}/documents.parquet"), odd_docs):
        assert by_text((r.doc_id, tuple((r.text or "").encode().split())) for r in with_planted_periods(docs).collect()) == \
            by_text((r.doc_id, tuple(planted(r.doc_id, r.text))) for r in docs.collect())
    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        words = planted(r.doc_id, r.text)
        found = brute_runs(words)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        dropped = {i for s, n, p in found for i in range(s + p, s + n)}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want[r.doc_id] = (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                          sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF_SMALL).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 5


PARTS = ["aaaa", "a", "'s", "'S", "t", "re", "12", " ", "  ", "\n", "\t", "\xa0", "　", "!", "é", "<|endoftext|>", "<|endof", "\x1c", "\x85", "͸",
         "՘", "\U00010940", " the", "ing", "😀", "́", "²", "\r\n", "ſ", "Ⅷ", "中文", "\U000e0001"]


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.ByteBpe(path)
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(8000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000, "!" * 3001, "\n" * 2000 + "x", "é" * 1000, "<|endoftext|>" * 50]
    for group in (1_000_000, 1, 500):
        ids = list(codec.encode(texts, group))
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [w.ids for w in want]
    assert [codec.decode(i) for i in ids] == texts == [library.decode(w.ids, skip_special_tokens=False) for w in want]
    draw = np.random.default_rng(1)
    for _ in range(500):  # ids whose bytes are no UTF-8
        some = draw.integers(0, codec.size, 12)
        assert codec.decode(some.astype("<u4").tobytes()) == library.decode(some.tolist(), skip_special_tokens=False)


def test_bpe_memo_may_be_emptied(monkeypatch):
    codec = bpe.ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    texts = [f"word{i} and w{i * 7}" for i in range(300)]
    want = list(codec.encode(texts))
    monkeypatch.setattr(bpe, "MEMO", 10)
    assert list(codec.encode(texts, 50)) == want


def test_bpe_refuses_merges_out_of_order(tmp_path):
    import json
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].reverse()
    (tmp_path / "odd.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.ByteBpe(str(tmp_path / "odd.json"))


def test_bpe_over_documents(spark, odd_docs, clashing, no_docs):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for docs in (odd_docs, clashing):
        rows = bpe.decode_ids(bpe.encode_texts(docs, path), path).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == (r.text or "")
    assert bpe.decode_ids(bpe.encode_texts(no_docs, path), path).collect() == []
    null_ids = bpe.encode_texts(odd_docs, path).selectExpr("doc_id", "cast(null as binary) ids")
    assert {r.decoded for r in bpe.decode_ids(null_ids, path).collect()} == {""}


def test_bpe_query_by_the_library(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_bpe"](spark, SF_SMALL).collect()} == want
