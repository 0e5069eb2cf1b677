import hashlib
import io
import random
import zlib

import pytest

from screenspark.llm import warc
from screenspark.llm.common import shared_folder

PAGES = "page_id long, url string, html string, path string, sha string, n string"


def pages(n=60):
    pick = random.Random(1)
    rows = [(i, f"http://h/{i} x", pick.choice(["", "<p>é", f"<p>{i}", "z" * 40_000, None])) for i in range(n)]
    rows += [(n, None, "\x1f\x8b\x08 WARC/1.0\r\n\r\n"), (None, "u\nv", "<p>é"), (None, None, "only null"), rows[3], rows[3]]
    return [(*r, "p", "s", "n") for r in rows]


def want(rows, least=0):
    best, out = {}, []
    for r in rows:
        h = (r[2] or "").encode()
        best[h] = max((i for i in (best.get(h), r[0]) if i is not None), default=None)
    for r in rows:
        h = (r[2] or "").encode()
        again = len(h) >= least and r[0] != best[h]
        digest = warc.base64.b32encode(hashlib.sha1(h).digest()).decode()
        out.append((r[0], len(h), digest, "revisit" if again else "response", best[h] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = pages()
    assert sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()), key=repr) == want(rows)


@pytest.mark.parametrize("split", [777, 5000, 1 << 20])
def test_payloads_come_back_whole_for_any_split(spark, split):
    rows, folder = pages(), shared_folder(spark)
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), folder, least_bytes=100, file_bytes=3000)
    assert manifest.count() > 3
    got = warc.read_archives(spark, manifest, folder, split_bytes=split).collect()
    kinds = sorted(((r["record_id"], r["type"]) for r in got))
    assert kinds == sorted((f"<urn:page:{w[0]}>", w[3]) for w in want(rows, 100))
    texts = {f"<urn:page:{r[0]}>": (r[2] or "").encode() for r in rows}
    for r in got:
        if r["type"] == "response" and r["record_id"] != "<urn:page:None>":
            assert r["payload"] == texts[r["record_id"]]
    assert all(r["headers"]["warc-target-uri"].isprintable() and " " not in r["headers"]["warc-target-uri"] for r in got)


def test_ranges_own_the_records_that_begin_inside():
    pick = random.Random(4)
    members = [warc.record(i, "u", pick.randbytes(pick.randint(0, 3000)) + warc.MAGIC) for i in range(30)]
    data, starts = b"".join(members), [0]
    for m in members:
        starts.append(starts[-1] + len(m))
    whole = [zlib.decompress(m, 31) for m in members]
    for step in (1, 50, 999, len(data)) if len(data) < 200 else (64, 999, len(data)):
        found = [r for a in range(0, len(data), step) for r in warc.read_range(io.BytesIO(data), a, a + step)]
        assert found == list(zip(starts, whole))


def test_damaged_archives_are_refused(spark):
    member = warc.record(1, "u", b"x" * 1000)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_range(io.BytesIO(member[:-20]), 0, 10_000))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
