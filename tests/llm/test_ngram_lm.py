import functools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from screenspark.llm import common, ngram_lm
from tests.llm.helpers import docs_frame, random_docs, same_rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_exact_columns_equal_brute_force_and_scores_beat_the_base(spark):
    rows = random_docs()
    docs = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    count = Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter(
        (i, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6))
        for i, ws in docs
    )
    got = ngram_lm.score_documents(docs_frame(spark, rows), ~ngram_lm.held_out(F.col("doc_id"))).collect()
    assert Counter((r[0], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    held_out = ngram_lm.held_out(F.col("doc_id"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ngram_lm.score_documents(docs, ~held_out).filter(held_out).collect()
    assert len(got) > 100
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    unlike = sum(r["score"] < 1.1 * r["base_score"] for r in got)
    assert unlike < 0.05 * len(got)


def trained(spark, texts):
    """Shards and model of some texts, and the level that the filter reads for one gram."""
    bits = 4
    shards = ngram_lm.filter_shards(spark.createDataFrame([(t,) for t in texts], "text string"), bits)
    found = {(r["bucket"], r["size"]): np.frombuffer(r["bits"], np.uint64) for r in shards.collect()}

    def levels(size, hashes):
        hashes = np.asarray(hashes, np.uint64)
        out = np.zeros(len(hashes), np.int64)
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        for b in np.unique(bucket):
            if (int(b), size) in found:
                out[bucket == b] = ngram_lm.read_levels(found[int(b), size], hashes[bucket == b])
        return out

    return shards, ngram_lm.model(shards), levels


def pair_hashes(before, words):
    return ngram_lm.mixed(before * ngram_lm.PAIR + words) & ngram_lm.PAIR_BITS


def test_scores_equal_a_slow_version_with_the_same_filter(spark):
    rows = random_docs(60, vocabulary=200)
    shards, m, levels = trained(spark, [r[1] for r in rows if not held(r[0])])
    n, v = m.n, m.v
    single = functools.cache(lambda size, gram: int(levels(size, [gram])[0]))
    got = ngram_lm.score_documents(docs_frame(spark, rows), ~ngram_lm.held_out(F.col("doc_id"))).collect()
    want = []
    for r in rows:
        words = ngram_lm.Tokens([(r[1] or "").encode()]).grams
        score, before = 0.0, ngram_lm.END
        for w in words:
            word, context = (m.mean[1][single(1, int(x))] for x in (w, before))
            both = single(2, int(pair_hashes(np.array([before]), np.array([w]))[0]))
            pair = min(m.mean[2][both], word, context)
            if both == 1:
                pair *= context**m.growth1 / (context**m.growth1 + m.false_followers)
            types = context**m.growth
            alone = (word + 1) / (n + v + 1)
            score += math.log10((pair + types * alone) / (context + types) if context else alone)
            before = w
        want.append((r[0], round(score, 5)))
    # Buckets differ between the two filters, so false answers do: none of the pairs here gets one.
    assert same_rows([(r["doc_id"], round(r["score"], 5)) for r in got], want)


def test_probabilities_sum_to_one_for_rare_and_frequent_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000)
    texts = [r["text"] for r in docs.select("text").collect()]
    shards, m, levels = trained(spark, texts)
    tokens = ngram_lm.Tokens([(t or "").encode() for t in texts])
    words, counts = np.unique(tokens.grams, return_counts=True)
    seen = levels(1, words)
    assert abs(((m.mean[1][seen] + 1) / (m.n + m.v + 1)).sum() - 1) < 0.01
    assert m.v == len(words) and m.n == len(tokens.grams)
    pick = np.random.default_rng(1)
    for count in (1, 10, 100, 1000, counts.max()):
        some = words[(counts >= count) & (counts <= 1.05 * count)]
        sums = []
        for u in pick.choice(some, min(8, len(some)), replace=False):
            before = levels(1, [u])[0]
            both = levels(2, pair_hashes(np.full(len(words), u), words))
            sums.append(float((10 ** m.log10(seen, np.full(len(words), before), both)).sum()))
        assert 0.9 <= np.mean(sums) <= 1.1, (count, sums)
        # One false yes after a word seen once is worth half a probability; on average there are few.
        assert all(0.75 <= x <= 1.6 for x in sums), (count, sums)


def test_false_answers_are_counted_from_the_set_bits(spark):
    texts = [r[1] for r in random_docs(120, vocabulary=2000, lines=60)]
    _, m, levels = trained(spark, texts)
    rate = m.false_followers / m.v
    assert 0 < rate < 1e-4
    assert (levels(2, ngram_lm.mixed(np.arange(100_000)) & ngram_lm.PAIR_BITS) > 0).mean() < 1e-3
    # A crowded filter has enough false answers to count.
    grams = ngram_lm.mixed(np.arange(20_000))
    words = ngram_lm.filled(grams, np.ones(len(grams)))[: 20_000 * 10 // 64].copy()
    for word, bits in ngram_lm._drawn_words(grams, np.ones(len(grams)), len(words)):
        np.bitwise_or.at(words, word, bits)
    seen = (ngram_lm.read_levels(words, ngram_lm.mixed(np.arange(10**6, 10**6 + 200_000))) > 0).mean()
    assert seen > 0.001 and 0.8 < ngram_lm.false_rate(words) / seen < 1.25


def test_a_weak_filter_still_gives_probabilities(spark, monkeypatch):
    """Two bits in one word: many absent pairs get a yes, and the weights undo it."""
    monkeypatch.setattr(ngram_lm, "WORDS", 1)
    monkeypatch.setattr(ngram_lm, "BITS_PER_EVENT", 6)
    pick = np.random.default_rng(2)
    names = [f"w{i}" for i in range(3000)]
    share = 1 / np.arange(1, 3001)
    texts = [" ".join(pick.choice(names, 200, p=share / share.sum())) for _ in range(300)]
    shards = [ngram_lm._counted(2)([batch]) for batch in [texts_batch(texts)]]
    table = pa.Table.from_batches(list(shards[0]))
    rows = [ngram_lm._shard(table.filter(pc.and_(pc.equal(table["bucket"], b), pc.equal(table["size"], s)))) for b in range(4) for s in (1, 2)]
    parts = {(r["bucket"], r["size"]): r for t in rows for r in t.to_pylist()}
    grams, mass = ({s: sum(np.array(r[k]) for (_, x), r in parts.items() if x == s) for s in (1, 2)} for k in ("grams", "mass"))
    pairs = [r for (_, x), r in parts.items() if x == 2]
    m = ngram_lm.Model(grams, mass, sum(r["false_events"] for r in pairs) / sum(len(r["bits"]) / 8 for r in pairs))
    assert m.false_followers > 0.03 * m.v
    tokens = ngram_lm.Tokens([t.encode() for t in texts])
    words, counts = np.unique(tokens.grams, return_counts=True)

    def levels(size, hashes):
        out = np.zeros(len(hashes), np.int64)
        bucket = (hashes >> np.uint64(62)).astype(np.int64)
        for b in range(4):
            out[bucket == b] = ngram_lm.read_levels(np.frombuffer(parts[b, size]["bits"], np.uint64), hashes[bucket == b])
        return out

    seen = levels(1, words)
    sums = []
    for u in words[np.argsort(counts)[:: len(words) // 20]]:
        both = levels(2, pair_hashes(np.full(len(words), u), words))
        before = levels(1, np.array([u]))[0]
        sums.append(float((10 ** m.log10(seen, np.full(len(words), before), both)).sum()))
    assert np.mean(sums) < 3  # unweighted it would be far larger


def texts_batch(texts):
    return pa.record_batch({"text": pa.array([t.encode() for t in texts], pa.binary())})


def test_empty_tables(spark):
    empty = docs_frame(spark, [])
    assert ngram_lm.score_documents(empty, F.lit(True)).collect() == []
    untrained = ngram_lm.score_documents(docs_frame(spark, [(1, "a b", None, None, 0)]), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in untrained] == [(3, 0, 0, 0.0)]


def test_filter_grows_with_the_events_and_no_gram_is_left_out(spark):
    texts = [r[1] for r in random_docs(vocabulary=300)]
    shards, _, levels = trained(spark, texts)
    tokens = ngram_lm.Tokens([(t or "").encode() for t in texts])
    events = {}
    for size, grams in ((1, tokens.grams), (2, tokens.pairs)):
        hashes, counts = np.unique(grams, return_counts=True)
        assert (levels(size, hashes) >= ngram_lm.level(counts)).all()
        events[size] = int(ngram_lm.level(counts).sum())
    for size in (1, 2):
        bits = shards.filter(f"size = {size}").agg(F.sum(8 * F.length("bits"))).first()[0]
        assert bits >= ngram_lm.BITS_PER_EVENT * events[size]


def test_chunks_and_buckets_grow_with_the_text(spark, monkeypatch):
    docs = docs_frame(spark, random_docs())
    least = 2 * common.partitions(spark)
    assert common.chunk_plan(docs, "text")[0] == least
    monkeypatch.setattr(common, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(common, "BUCKET_BYTES", 500)
    chunks, bits = common.chunk_plan(docs, "text")
    total = sum(len((r[1] or "").encode()) for r in random_docs())
    assert chunks == -(-total // 1000) and 2**bits >= total // 500
