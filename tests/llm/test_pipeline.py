"""The pipeline's stages against brute force: the rows after every stage, and the pieces at the end."""

import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from ledgerscope.llm import decontamination as D
from ledgerscope.llm import line_dedup, packing, quality
from ledgerscope.llm.common import table
from ledgerscope.llm.queries import id_remainder, quality_model
from ledgerscope.llm.subwords import SubwordEncoder, tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.test_exact_and_near import brute_components, brute_fingerprint
from tests.llm.test_lines_and_licenses import brute_lines


def plain_score(model, text):
    """The network written out, one text at a time."""
    z = [max(-6.0, min(6.0, (x - m) / s)) for x, m, s in zip(quality.features_of(text), model.mean, model.scale)]
    w1, b1, w2, direct, bias = model.weights
    hidden = [math.tanh(sum(a * w1[i][j] for i, a in enumerate(z)) + b1[j]) for j in range(len(b1))]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, w2)) + sum(a * w for a, w in zip(z, direct)) + bias[0])))


def leaky(texts, items, threshold=D.THRESHOLD, overlap=D.OVERLAP, k1=1.2, b=0.75):
    """Which texts hold an item: every passage scored against every item in full, then question and answer compared."""
    items = [t for t in dict.fromkeys(t or "" for t in items) if D.words_in(t)]
    bags = [Counter(D.words_in(t)) for t in items]
    n, mean, df = len(bags), sum(sum(x.values()) for x in bags) / len(bags), Counter(w for x in bags for w in x)
    impact = []
    for x in bags:
        size = sum(x.values())
        one = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)) for w, tf in x.items()}
        impact.append((one, sum(one.values())))
    longest = max(sum(x.values()) for x in bags)
    parts = [[p for p in D.split_item(t) if p] for t in items]

    def holds(part, passage):
        size = min(D.SHINGLE, len(part))
        own = {tuple(part[i:i + size]) for i in range(len(part) - size + 1)}
        return len(own & {tuple(passage[i:i + size]) for i in range(len(passage) - size + 1)}) >= overlap * len(own)

    found = []
    for text in texts:
        words = D.words_in(text)
        hit = False
        for start in range(0, len(words), longest):
            passage = words[start:start + 2 * longest]
            query = set(passage)
            hit = hit or any(sum(v for w, v in one.items() if w in query) >= threshold * whole - 1e-9 and all(holds(p, passage) for p in ps)
                             for (one, whole), ps in zip(impact, parts))
        found.append(hit)
    return found


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_stage_by_brute_force(spark, tmp_path):
    docs = table(spark, SF_SMALL, "documents")
    items = [r.text for r in table(spark, SF_SMALL, "benchmark").collect()]
    kept, after = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, SF_SMALL).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        after[name] = rows_of(kept)
    assert list(after) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]

    want = rows_of(docs)
    model = quality_model(spark, SF_SMALL, docs.select("doc_id", "text"), id_remainder(5) != 0)
    want = [r for r in want if plain_score(model, r[1]) >= quality.THRESHOLD]
    assert after["quality_classifier"] == want and 0 < len(want) < docs.count()

    cleaned = {r[0]: r for r in brute_lines([(r[0], r[1], r[3]) for r in want], line_dedup.RATIO, line_dedup.MIN_PAGES)}
    want = sorted(((i, cleaned[i][1], lang, source, len(cleaned[i][1]) if cleaned[i][3] else chars) for i, _, lang, source, chars in want), key=repr)
    assert after["line_dedup"] == want

    prints = {r[0]: brute_fingerprint(r[1]) for r in want}
    root = brute_components(set(prints.values()))
    least = {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
    want = [r for r in want if least[root[prints[r[0]]]] == r[0]]
    assert after["simhash_near_dedup"] == want and len(want) < len(prints)

    want = [r for r, hit in zip(want, leaky([r[1] for r in want], items)) if not hit]
    assert after["benchmark_decontamination"] == want and len(want) < len(after["simhash_near_dedup"])

    tokenizer = SubwordEncoder.of(tokenizer_path()).tokenizer
    pieces = []
    for r in want:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        start = 0
        for length in packing.binary_lengths(len(ids), 2048):
            pieces.append((r[0], start, length, zlib.crc32(ids[start:start + length].tobytes()), ids[start:start + length].tobytes()))
            start += length
    got = kept.select("doc_id", "start", "length", "ids_crc32", "ids").collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(pieces)


def test_whole_benchmark_in_blocks_finds_the_same(spark):
    docs, bench = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark")
    flat = lambda df: sorted((r.doc_id, tuple(sorted((x.item_id, x.first_word, x.end_word) for x in r.leaks))) for r in df.collect())
    one = flat(D.mark_leaks(docs, bench))
    assert flat(D.mark_leaks(docs, bench, block_words=600)) == one and any(x for _, x in one)
