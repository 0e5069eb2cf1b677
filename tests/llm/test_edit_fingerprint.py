import hashlib
import random

import pytest

from screenspark.llm import edit_fingerprint as E
from tests.llm.helpers import docs_frame, random_docs


def slow_fingerprint(text):
    level = int(E.level_of(E.np.array([len(text)]))[0])
    out, at, step = "", 0, 0
    while at < len(text):
        kind = int(E._CLASS[ord(text[at])])
        if E._levels(E.np.array([step]), level)[0] >= level:
            out += "0123456789abcdef"[int(E._DIGITS[step % E.PERIOD][kind])]
        at += int(E._MOVES[step % E.PERIOD][kind])
        step += 1
    return E.LEVELS[level] + out


def test_walks_equal_one_character_at_a_time():
    texts = [r[1] or "" for r in random_docs()][:60] + ["é" * 200, "日本語" * 50, "q" * 3000]
    assert E.fingerprints(texts) == [slow_fingerprint(t) for t in texts]


def test_rows_equal_brute_force(spark):
    rows = [r for r in random_docs() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in E.fingerprint_documents(docs_frame(spark, rows)).collect()}
    docs = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        a, b, c = E.fingerprints([text, edited, after])
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a, b)
        assert (r["near_edited"], r["near_next"]) == (E.likeness(a, b), E.likeness(a, c))


def test_repeated_null_and_few_rows(spark):
    rows = random_docs()
    got = E.fingerprint_documents(docs_frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    one = E.fingerprint_documents(docs_frame(spark, [(7, "abcdef", None, None, 0)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert one["near_next"] == 1.0
    none = E.fingerprint_documents(docs_frame(spark, [(None, "abc", None, None, 0), (None, "def", None, None, 0)])).collect()
    assert len(none) == 2
    assert E.fingerprint_documents(docs_frame(spark, [])).collect() == []


def test_likeness_of_edits():
    pick = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for n in (50, 700, 9000):
        text = "".join(pick.choices(letters, k=n))
        edits = list(text)
        for at in pick.sample(range(n), max(1, n // 200)):
            edits[at] = ""
        other = "".join(pick.choices(letters, k=n))
        a, b, c = E.fingerprints([text, "".join(edits), other])
        assert E.likeness(a, a) == 1 and E.likeness(a, b) > 0.4 and E.likeness(a, c) < 0.3
    assert E.likeness(*E.fingerprints(["", ""])) == 1 and E.likeness(*E.fingerprints(["", "x"])) == 0


def test_near_groups_find_nearly_all_links_and_no_other(spark):
    pick = random.Random(9)
    words = [f"{pick.getrandbits(40):x}" for _ in range(4000)]
    texts = []
    for _ in range(60):
        base = pick.choices(words, k=pick.randint(5, 300))
        texts += [" ".join(base)] + [" ".join([*base[:-1], pick.choice(words)]) for _ in range(4)]
    fps = E.fingerprints(texts)
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fingerprint string")
    group = dict(map(tuple, E.near_groups(rows).collect()))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if E.likeness(fps[i], fps[j]) >= E.THRESHOLD]
    met = sum(group[fps[i]] == group[fps[j]] for i, j in near)
    assert met >= 0.95 * len(near) and len(near) > 300
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in near:
        parent[root(i)] = root(j)
    for i in range(len(fps)):
        assert root(i) == root(group[fps[i]])


def test_packed_fingerprints_unpack(spark):
    fps = [*E.fingerprints(["", "a", "ab", "abc" * 50, "x y" * 400]), "zabc", "3", "30"]
    rows = spark.createDataFrame([(f,) for f in fps], "fingerprint string").select("fingerprint", E.packed(E.F.col("fingerprint")).alias("b"))
    for r in rows.collect():
        level, digits = E._unpacked(bytes(r["b"]))
        assert E.LEVELS[level] + digits.tobytes().decode() == r["fingerprint"]


@pytest.mark.parametrize("n", [16, 24, 48, 90])
def test_bands_meet_for_short_texts(n):
    pick, met, near = random.Random(n), 0, 0
    for _ in range(400):
        a = _digits(pick, n)
        b = list(a)
        for i in pick.sample(range(n), max(1, int(0.1 * n))):
            b[i] = pick.choice("0123456789abcdef")
        a, b = "0" + a, "0" + "".join(b)
        if E.likeness(a, b) >= E.THRESHOLD:
            near += 1
            met += bool(set(E.band_keys(a)) & set(E.band_keys(b)))
    assert near > 300 and met >= 0.95 * near


def test_recall_on_edited_texts_of_the_documents(spark):
    """Whole documents with words replaced in front, in the middle, at the end or all over, against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200").limit(150).collect()
    pick, met, near = random.Random(8), 0, 0
    for r in docs:
        for where in ("front", "middle", "end", "spread"):
            words = r["text"].split(" ")
            n = max(1, len(words) // pick.choice([10, 20, 40]))
            first = {"front": 0, "middle": (len(words) - n) // 2, "end": len(words) - n}.get(where)
            for i in pick.sample(range(len(words)), n) if first is None else range(first, first + n):
                words[i] = pick.choice(docs)["text"][:6]
            a, b = E.fingerprints([r["text"], " ".join(words)])
            if E.likeness(a, b) >= E.THRESHOLD:
                near += 1
                met += bool(set(E.band_keys(a)) & set(E.band_keys(b)))
    assert near > 200 and met >= 0.95 * near


def test_too_large_bands_are_split(spark, monkeypatch):
    fps = E.fingerprints(["the same beginning of a text " * 9 + str(i) for i in range(50)])
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fingerprint string")
    whole = E.near_groups(rows, band_limit=10).collect()
    assert len({r["group_id"] for r in whole}) == len({r["group_id"] for r in E.near_groups(rows).collect()})


def _digits(pick, n):
    return "".join(pick.choices("0123456789abcdef", k=n))


@pytest.mark.parametrize("where", ["front", "middle", "end", "spread"])
@pytest.mark.parametrize("n", [128, 192, 255])
def test_bands_meet_wherever_near_texts_differ(where, n):
    pick, met, near = random.Random(n), 0, 0
    for _ in range(300):
        a = _digits(pick, n)
        k = int(0.17 * n)
        at = {"front": 0, "middle": (n - k) // 2, "end": n - k}.get(where)
        places = pick.sample(range(n), k) if at is None else range(at, at + k)
        b = list(a)
        for i in places:
            b[i] = pick.choice("0123456789abcdef")
        a, b = "3" + a, "3" + "".join(b)
        if E.likeness(a, b) >= E.THRESHOLD:
            near += 1
            met += bool(set(E.band_keys(a)) & set(E.band_keys(b)))
    assert near > 200 and met >= 0.95 * near


def test_bands_meet_across_a_level_boundary():
    pick, met, near = random.Random(4), 0, 0
    for _ in range(600):
        a = _digits(pick, 252)
        level, x = E._split("3" + a)
        raised = list(E._raised(level, x, 4).tobytes().decode())
        for i in pick.sample(range(len(raised)), 20):
            raised[i] = pick.choice("0123456789abcdef")
        a, b = "3" + a, "4" + "".join(raised) + _digits(pick, 2)
        if E.likeness(a, b) >= E.THRESHOLD:
            near += 1
            met += bool(set(E.band_keys(a)) & set(E.band_keys(b)))
    assert near > 300 and met >= 0.95 * near


def test_large_bands_keep_every_link(spark):
    """All digits but the last 44 are the same, so no further digits split a band; each pair differs in a few."""
    pick, fps = random.Random(5), []
    same = _digits(pick, 84)
    for _ in range(15):
        tail = _digits(pick, 44)
        for _ in range(4):
            other = list(tail)
            for at in pick.sample(range(44), 6):
                other[at] = pick.choice("0123456789abcdef")
            fps.append("3" + same + "".join(other))
    near = [(i, j) for i in range(60) for j in range(i) if E.likeness(fps[i], fps[j]) >= E.THRESHOLD]
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fingerprint string")
    group = dict(map(tuple, E.near_groups(rows, band_limit=8).collect()))
    assert len(near) > 60 and all(group[fps[i]] == group[fps[j]] for i, j in near)
    cells = spark.createDataFrame([(1, 40, n) for n in range(40)], "key long, n long, node long").select(
        "node", E.F.inline(E._cells(8))
    )
    members = {}
    for r in cells.collect():
        members.setdefault(r["key"], []).append((r["node"], r["side"]))
    pairs = [
        frozenset((a, b)) for m in members.values() for a, s in m for b, t in m if a < b and (s < 0 or s != t)
    ]
    assert len(pairs) == len(set(pairs)) == 40 * 39 // 2
    assert max(map(len, members.values())) < 40


def test_splitting_every_band_changes_no_group(spark):
    pick, fps = random.Random(6), []
    for _ in range(100):
        a = _digits(pick, 160)
        b = list(a)
        for at in pick.sample(range(160), 28):
            b[at] = pick.choice("0123456789abcdef")
        fps += ["3" + a, "3" + "".join(b)]
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fingerprint string")
    whole = sorted(map(tuple, E.near_groups(rows).collect()))
    assert len({g for _, g in whole}) <= 105
    assert sorted(map(tuple, E.near_groups(rows, band_limit=1).collect())) == whole
