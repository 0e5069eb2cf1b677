from pathlib import Path

import numpy as np
import pytest

from screenspark.llm import pieces as P
from tests.llm.helpers import docs_frame, random_docs

VOC = P.Vocabulary(Path(P.MODEL).read_bytes(), P.SHARPNESS)


def ways(text):
    """All segmentations of a short text with their probabilities."""
    names = {VOC.raw[i].decode(): i for i in range(len(VOC.raw)) if VOC.raw[i] and i >= 259}

    def cut(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in names:
                for ids, logp in cut(rest[n:]):
                    yield (names[rest[:n]], *ids), logp + VOC.logp[names[rest[:n]]]

    found = dict(cut(text))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: float(np.exp(v - total)) for k, v in found.items()}


def test_samples_follow_the_lattice():
    want = ways(" then")
    n = 20_000
    count, ids = P.encode_texts([" then"] * n, np.arange(n).astype(np.uint64), VOC)
    ends = np.cumsum(count)
    seen = {}
    for a, b in zip(ends - count, ends):
        key = tuple(ids[a:b].tolist())
        seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= set(want)
    for key, p in want.items():
        assert abs(seen.get(key, 0) / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_round_trip_and_same_cut_on_every_run(spark):
    rows = random_docs() + [(5000, "日本 \U0001f600▁\n ▁▁é  ", None, None, 0), (5001, "y" * 30_000, None, None, 0)]
    docs = docs_frame(spark, rows)
    got = P.decode(P.encode(docs)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted((r[:2] for r in rows), key=repr)
    assert all((r["ids"] is None) == (r["text"] is None) for r in got)
    again = P.encode(docs.repartition(7)).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == sorted(map(tuple, again), key=repr)
    other = P.encode(docs, seed=1).collect()
    assert sorted(map(tuple, other), key=repr) != sorted(map(tuple, again), key=repr)


def test_batches_do_not_change_the_cut(monkeypatch, spark):
    texts = [r[1] or "" for r in random_docs()]
    keys = np.arange(len(texts)).astype(np.uint64)
    count, ids = P.encode_texts(texts, keys, VOC)
    parts = [P.encode_texts([t], keys[i : i + 1], VOC) for i, t in enumerate(texts)]
    assert count.tolist() == [int(c[0]) for c, _ in parts]
    assert ids.tolist() == [x for _, p in parts for x in p.tolist()]


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_texts_cut_between_chunks_keep_their_ids(monkeypatch, size):
    texts = [*(r[1] for r in random_docs()), " " * 40, "\n\n  \n x" * 20]
    keys = list(range(len(texts)))

    def every():
        ends, counts, ids = zip(*P._row_ids(texts, keys, VOC))
        assert ends[-1] == len(texts) and all(len(c) == b - a for a, b, c in zip((0, *ends), ends, counts))
        return np.concatenate(counts).tolist(), np.concatenate([x for part in ids for x in part]).tolist()

    whole = every()
    monkeypatch.setattr(P, "BATCH_CHARS", size)
    assert every() == whole
    assert all("".join(p for p, _ in P._parts(t or "")) == (t or "") for t in texts)


def test_kept_columns_and_empty_table(spark):
    docs = docs_frame(spark, [(1, "a b", "en", "s", 0)])
    assert P.encode(docs, keep=["source", "key"]).select("source", "key").first() == ("s", "d")
    assert P.decode(P.encode(docs_frame(spark, []))).collect() == []


def test_models_without_byte_pieces_are_refused():
    with pytest.raises(Exception):
        P.Vocabulary(b"no model", 1.0)
