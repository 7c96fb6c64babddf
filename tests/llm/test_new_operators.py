"""Personal data, whitening and periodic runs against brute force, and on odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import catalog, pii, runs, whiten

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_are_those_of_the_plain_patterns():
    random.seed(1)
    seen = 0
    for _ in range(20_000):
        letters = random.choice(["a@.-1", "0129.", "+1 ()-.9", "01234567 -", "a@b.c_ +1é9"])
        text = "".join(random.choice(letters) for _ in range(random.randrange(60))) + random.choice(["", " 4111 1111 1111 1111", " +1 (743) 555-3824x"])
        found = [(s.start, s.kind, s.end) for s in pii.propose(text) if s.base]
        assert found == base_spans(text), text
        seen += len(found)
    assert seen > 5000


def test_long_runs_of_characters_cost_no_more_than_their_length():
    for unit in ("a", "1", "1.", "+1 ", "a@", "1-", "1:", "(12) 345 "):
        pii.judged(unit * (100_000 // len(unit)))


def test_personal_data_of_the_documents(spark):
    out = {r["doc_id"]: r for r in catalog.op11_pii(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(rows)
    for r in rows:
        base, got = base_spans(r["text"] or ""), out[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        assert [got["n_" + k] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, written(base).split(","))) <= set(got["spans"].split(","))
        assert (got["spans"] == written(base)) == (got["n_added"] == 0)


def test_the_method_adds_spans_that_the_patterns_miss_and_spares_other_numbers(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    d = lambda n: "".join(random.choice("123456789") for _ in range(n))
    rows = [(i, f"{words(20)} mail {word()}@{word()}.com {words(5)} call +1 ({d(3)}) 555-{d(4)} {words(9)}") for i in range(200)]
    rows += [(1000 + i, f"{words(20)} email: {word()} [at] {word()} [dot] com {words(8)} phone: ({d(3)}) 555-{d(4)}, {words(9)}") for i in range(30)]
    rows += [(2000 + i, f"{words(20)} version 1.{d(1)}.{d(3)} of order {d(16)[:-1]}x {words(5)} page {d(3)} {words(3)}") for i in range(30)]
    out = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert all(out[i]["n_added"] == 0 and out[i]["n_email"] == out[i]["n_phone"] == 1 for i in range(200))
    assert all(re.fullmatch(r"email:\d+:\d+,phone:\d+:\d+", out[1000 + i]["spans"]) and out[1000 + i]["n_added"] == 2 for i in range(30))
    assert all(out[2000 + i]["n_added"] == 0 for i in range(30))


def test_reliabilities_are_found_without_labels():
    """Votes drawn from known rates: the estimates separate the classes better than any one labeler."""
    rng = np.random.default_rng(3)
    right = np.array([0.9, 0.8, 0.75, 0.7, 0.7, 0.65, 0.8])
    truth = rng.random(20_000) < 0.3
    agree = rng.random((20_000, 7)) < right
    votes = np.where(rng.random((20_000, 7)) < 0.3, 1, np.where(agree == truth[:, None], 2, 0))
    codes = votes @ 3 ** np.arange(7)
    found = pii.weigh(dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True)))
    guess = np.array([found[c] >= 0.5 for c in codes.tolist()])
    best = ((votes - 1) @ np.log(right / (1 - right)) + np.log(0.3 / 0.7) > 0) == truth  # with the true rates
    assert (guess == truth).mean() > best.mean() - 0.005
    assert abs(np.mean([found[c] for c in codes.tolist()]) - 0.3) < 0.03


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 100_000 + " a@b.org"), (4, "a@b.org"), (4, "a@b.org"), (None, "😀 1.2.3.4 a@b.org")]
    docs = documents(spark, rows).withColumns({"spans": F.lit("clash"), "kind": F.lit(1)})
    out = [(r["doc_id"], r["n_email"], r["n_ip"], r["spans"]) for r in pii.find_personal_data(docs).collect()]
    assert sorted(out, key=str) == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:100001:100008"), (4, 1, 0, "email:0:7"), (4, 1, 0, "email:0:7"), (None, 1, 1, "ip:2:9,email:10:17")], key=str)
    assert pii.find_personal_data(documents(spark, [])).count() == 0
    masked = {r["doc_id"]: (r["text"], r["spans"]) for r in pii.mask(docs).collect()}
    assert masked[None] == ("😀 <ip> <email>", "clash") and masked[1] == (None, "clash") and masked[2] == ("", "clash")


# ---- whitening


def plain_whitening(vectors):
    x = np.array([[int(np.floor(1024.0 * float(v))) + 100_000 for v in e] for e in vectors], object)
    n, s = len(x), x.sum(0)
    centred = (n * x - s).astype(float) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    return ((n * x - s) ** 2).sum(1), centred @ parts[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def test_whitening_equals_plain_arithmetic(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [r for r in rows if r["embedding"] is not None and all(v is not None and np.isfinite(v) for v in r["embedding"])]
    deviation, whitened, explained = plain_whitening([r["embedding"] for r in rows])
    out = catalog.op12_whitening(spark, SF).toPandas().set_index(["vec_id", "component"]).sort_index()
    assert len(out) == 8 * len(rows) and set(out.n) == {len(rows)} and out.identity_error.max() < 1e-9
    signs = np.sign([out.loc[(rows[0]["vec_id"], k + 1), "whitened"] * whitened[0, k] for k in range(8)])
    for i, r in enumerate(rows):
        mine = out.loc[r["vec_id"]]
        assert set(mine.deviation) == {deviation[i]}
        assert np.allclose(mine.whitened, whitened[i] * signs, rtol=1e-8, atol=1e-9) and np.allclose(mine.explained, explained)


def test_scatter_is_exact_for_large_numbers_and_any_partitioning(spark):
    random.seed(4)
    rows = [(i, [random.uniform(-1, 1) * 10 ** random.randrange(0, 9) for _ in range(5)]) for i in range(300)]
    x = [[int(np.floor(1024 * v)) + 100_000 for v in e] for _, e in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    plain = [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) // n for j in range(5)] for i in range(5)]
    seen = {}
    whole = whiten.Whitening.of
    try:
        whiten.Whitening.of = staticmethod(lambda n, total, scatter, k: seen.setdefault("scatter", scatter) and whole(n, total, scatter, k))
        for parts in (1, 7):
            seen.clear()
            df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
            out = whiten.whiten(df).where("component = 1").orderBy("vec_id").collect()
            assert seen["scatter"] == plain
            exact = [sum((n * a - t) ** 2 for a, t in zip(r, s, strict=True)) for r in x]
            assert [r["deviation"] for r in out] == [v if v < 2**63 else None for v in exact]
    finally:
        whiten.Whitening.of = staticmethod(whole)


def test_chinese_remainders_give_signed_numbers():
    for x in (0, 1, -1, 10**30, -(10**30) + 7):
        assert whiten.remainder({p: x % p for p in whiten.primes(2 * abs(x) + 1)}) == x


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.5]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (10, [0.5, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("clash"), "e": F.lit(1)})
    out = whiten.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted(2 * ["1", "1", "None", "10"]) and {r["n"] for r in out} == {4} and {r["component"] for r in out} == {1, 2}
    same = whiten.whiten(df.where("vec_id = 1")).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in same)
    assert whiten.whiten(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [(-1.0) ** i * 10.0 ** (i % 300), float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    assert whiten.whiten(huge).where("component = 1 and whitened is not null").count() == 20


# ---- periodic runs


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            begin = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - begin + q >= max(6, 4 * q) and i > begin:
                out.setdefault((begin, i - begin + q), q)
            i += 1
    return sorted((a, n, q) for (a, n), q in out.items())


@pytest.mark.parametrize("heavy", [None, 3])
def test_runs_equal_those_of_all_lags(monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(runs, "heavy_count", lambda n: heavy)
    random.seed(5)
    texts = []
    for _ in range(1500):
        n, kinds = random.randrange(140), random.choice([1, 2, 3, 8, 40])
        w = [random.randrange(kinds) for _ in range(n)]
        if n and random.random() < 0.7:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randrange(3, 11)
            w = w[:a] + (w[a : a + p] * n)[: n - a]
        texts.append(np.array(w, np.int64))
    for at in range(0, len(texts), 100):
        for t, found in zip(texts[at : at + 100], runs.runs_of(texts[at : at + 100]), strict=True):
            assert found == plain_runs(t.tolist())


def test_long_texts_of_few_words():
    rng = np.random.default_rng(6)
    assert runs.runs_of([np.zeros(100_000, np.int64)]) == [[(0, 100_000, 1)]]
    unit = rng.integers(0, 2, 5_000)
    t = np.r_[rng.integers(2, 4, 1000), np.tile(unit, 9), rng.integers(4, 6, 700)]
    assert (1000, 45_000, 5_000) in runs.runs_of([t])[0]


def test_periodic_runs_of_the_documents(spark):
    out = {r["doc_id"]: r for r in catalog.op13_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(rows)
    planted = 0
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found, got = plain_runs(w), out[r["doc_id"]]
        gone = {i for a, m, q in found for i in range(a + q, a + m)}
        top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        assert (got["n_runs"], got["runs_sha256"]) == (len(found), hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()).hexdigest())
        assert got["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        assert (got["start"], got["length"], got["period"], got["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
    assert planted > 5


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b " * 5), (4, "a b " * 5), (None, "x " * 50_000), (6, "a a a a a"), (7, "a\x0ba\x0ca\ta\ra\na b")]
    docs = documents(spark, rows).withColumns({"start": F.lit("clash"), "n_runs": F.lit(0)})
    out = [(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"]) for r in runs.periodic_runs(docs).collect()]
    want = [(1, 0, None, None, None), (2, 0, None, None, None), (3, 0, None, None, None), (4, 1, 0, 10, 2), (4, 1, 0, 10, 2), (None, 1, 0, 50_000, 1), (6, 0, None, None, None), (7, 1, 0, 6, 1)]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert runs.periodic_runs(documents(spark, [])).count() == 0
    left = {r["doc_id"]: (r["text"], r["n_runs"]) for r in runs.collapse(docs).collect()}
    assert left[None] == ("x", 0) and left[4] == ("a b", 0) and left[6][0] == "a a a a a" and left[1][0] is None and left[3][0] == " \n "
