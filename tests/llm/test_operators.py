"""Each operator against a brute-force version, a round trip or held-out labels, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, catalog, chat, decontaminate, jaccard, langid, linededup, neighbours, quality, shards, shingles, warc
from graphloom.llm.shingles import WordHashes, shingle_set, shingle_sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
VOCAB = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


def words(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    """Null and empty texts, a null id, a very long text, copies, near copies and a repeated row."""
    base = words(120)
    near = base.replace(" ", "  ", 1).rsplit(" ", 1)[0] + " changed"
    return [(1, None), (2, ""), (3, " \n\t"), (4, base), (5, base), (6, near), (7, words(30_000)), (8, "x"), (8, "x"), (9, "éà ñ"), (None, words(20)), (10, "a b c")]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return documents(spark, odd_rows).withColumns({"key": F.lit(1), "size": F.lit("clash"), "n": F.lit(2)})


def empty(spark):
    return documents(spark, [])


# ---- sharding


def test_shards_are_even_gapless_and_complete(spark):
    out = catalog.op1_sharding(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(out.doc_id) == sorted(texts)
    for r in out.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    for _, slots in out.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    assert set(out.law) == {"bytes"} and out.shard.between(0, 39).all()


def test_shard_sizes_differ_little_where_records_are_small(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 20).alias("size"), F.expr("if(id % 3 = 0, 0, id)").alias("group"))
    out = shards.assign_shards(rows, 10).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()
    assert len(out) == 10 and out.b.max() - out.b.min() < 0.04 * out.b.mean()


def test_shards_of_odd_rows(spark, odd, odd_rows):
    out = shards.shard_documents(odd, 4).collect()
    assert len(out) == len(odd_rows) and {r["size"] for r in out if r["doc_id"] in (1, 2)} == {16}
    assert shards.shard_documents(empty(spark), 4).count() == 0


def test_written_shards_hold_all_documents(spark, odd, odd_rows, tmp_path):
    docs = odd.drop("size").withColumn("shard", F.lit("clash"))
    shards.write_shards(docs, 3, str(tmp_path / "s"))
    out = spark.read.parquet(str(tmp_path / "s"))
    assert out.count() == len(odd_rows)
    found = sorted((r["doc_id"] or 0, r["shard"], r["slot"]) for r in out.collect())
    assert found == sorted((r["doc_id"] or 0, r["shard"], r["slot"]) for r in shards.shard_documents(docs, 3).collect())
    for r in out.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("slots")).collect():
        assert r["slots"] == list(range(len(r["slots"])))


def test_a_third_of_the_rows_may_be_one_row(spark):
    rows = spark.range(6000).select(F.expr("if(id % 3 = 0, 7, id)").alias("doc_id"), F.lit(50).cast("long").alias("size"), F.expr("if(id % 3 = 0, 0, id)").alias("group"))
    out = shards.assign_shards(rows, 10).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).toPandas()
    assert len(out) == 10 and out.n.sum() == 6000 and out.n.max() - out.n.min() <= 6 and (out.n == out.s).all() and (out.m == out.n - 1).all()


def test_shards_equal_a_plain_version(spark, monkeypatch):
    """The law by a loop over all records in the operator's order: each lies in the shard in which the
    middle of its bytes does."""
    rows = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 13 + 20).alias("size"), F.col("id").alias("group"))
    key = F.shiftleft(F.shiftright(F.xxhash64("group"), 32), 32) + F.xxhash64("doc_id", F.lit(1)).bitwiseAND(0xFFFFFFFF)
    ordered = rows.withColumn("k", key).orderBy("k").collect()
    total, at, want, n = sum(r["size"] for r in ordered), 0, [], [0] * 7
    for r in ordered:
        s = int((at + r["size"] / 2) * 7 / total)
        want.append((r["doc_id"], s, n[s]))
        n[s], at = n[s] + 1, at + r["size"]
    monkeypatch.setattr(shards, "BIG", 4)
    for ranges in (1, 32):
        monkeypatch.setattr(shards, "RANGES", ranges)
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.assign_shards(rows, 7).collect()}
        assert len(got) == 900 and sum(got[i] == (s, slot) for i, s, slot in want) > 0.95 * 900  # groups at a cut go to one side


# ---- quality


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    out = catalog.op2_quality(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()


def test_ridge_weights_equal_a_plain_solution(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    described = quality.describe(docs)
    model = quality.fit(described, labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    known = [(r["doc_id"], r["x"]) for r in described.collect() if r["doc_id"] in y and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    x = np.array([v for _, v in known])
    plain = quality.Model(x.mean(0), x.std(0) + 1e-6)
    fit = np.array([zlib.crc32(str(i).encode()) % 4 != 3 for i, _ in known])
    z, t = plain.features(x[fit]), np.array([y[i] for i, _ in known], float)[fit]
    plain.weights = np.linalg.solve(z.T @ z + quality.RIDGE * max(1.0, fit.sum()) / quality.FEATURES * np.eye(z.shape[1]), z.T @ t)
    np.testing.assert_allclose(model.raw_scores(x), plain.raw_scores(x), rtol=1e-5, atol=1e-6)


def test_quality_ignores_labels_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.expr("if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality)"))
    a, b = (quality.score(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert a.equals(b)


def test_quality_of_odd_rows(spark, odd, odd_rows):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    out = quality.score(odd, labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty(spark), labels).count() == 0


def test_pooling_is_isotonic():
    y, n = np.array([1.0, 0, 3, 1, 4]), np.array([2.0, 1, 3, 2, 4])
    out = quality.pool(y, n)
    assert (np.diff(out) >= 0).all() and abs((out * n).sum() - y.sum()) < 1e-9


# ---- nearest neighbours


def test_neighbours_equal_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(300)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)] + [(20, None), (40, [0.0] * 8), (60, [float("nan")] * 8), (80, []), (None, [1.0] * 8), (100, [1.0, None] + [0.0] * 6)]
    rows = [r for r in rows if r[0] not in (20, 40, 60, 80, 100) or r[1] is None or len(r[1]) != 8 or r[1][0] != r[1][0] or None in r[1] or not any(r[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    want = set()
    for q in (i for i in good if i % 20 == 0):
        near = sorted(((-(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(near)}
    old = neighbours.BLOCK
    try:
        neighbours.BLOCK = 100
        got = {tuple(r) for r in neighbours.nearest(df.select("vec_id", "embedding", "id")).collect()}
    finally:
        neighbours.BLOCK = old
    assert got == want
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_few_candidates_give_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [3.0, 4.0]), (4, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in neighbours.nearest(df).collect()) == [(0, 1, 3, 11.0)] * 2 + [(0, 2, 0, 5.0)] * 2


# ---- language identification


def test_languages_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas()
    out = catalog.op4_langid(spark, d).toPandas().merge(lang, on="doc_id")
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.98


def test_odd_texts_are_undetermined(spark, odd, odd_rows):
    out = langid.identify(odd, langid.fit(odd)).collect()
    assert len(out) == len(odd_rows) and {r["lang_pred"] for r in out if not (r["text"] or "").strip()} == {"und"}
    assert langid.identify(documents(spark, [(1, "123 ++ 4")]), langid.fit(odd)).first()["lang_pred"] == "und"
    none = langid.identify(odd, langid.fit(empty(spark)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and langid.identify(empty(spark), langid.fit(odd)).count() == 0


def test_learnt_passages_are_bounded_and_of_any_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 50)
    monkeypatch.setattr(langid, "PASSAGE", 20)
    rows = [(1 + i, "kurz und gut" + "!" * i, "de") for i in range(12)] + [(20 + i, "long " * 30 + "x" * i, "en") for i in range(9)] + [(40, "12", "fr"), (41, None, "es"), (42, "", "es")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {"de": [t for _, t, k in rows if k == "de"], "en": [t for _, t, k in rows if k == "en"]}
    assert model.langs == ["de", "en"]
    for lang, found in texts.items():
        assert all(any(p in t for t in found) for p in model.texts[lang].split("\n")) and 12 <= len(model.texts[lang]) < 80


def test_no_language_is_lost_however_often_its_texts_repeat(spark):
    de, en = ("der Hund und die Katze liegen vor dem Haus", "das Essen steht auf dem Tisch"), "the dog and the cat {} wait before house number {}"
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, de[0]).otherwise(de[1]).alias("text"), F.lit("de").alias("lang"))
    rows = rows.unionByName(spark.createDataFrame([(300_000 + i, en.format("and" * (i % 7), i), "en") for i in range(1000)], "doc_id long, text string, lang string"))
    rows = rows.unionByName(spark.createDataFrame([(400_000 + i, "el perro y el gato esperan delante de la casa " * 3000, "es") for i in range(20)], "doc_id long, text string, lang string"))
    model = langid.fit(rows)
    assert model.langs == ["de", "en", "es"] and all(t in model.texts["de"] for t in map(str.lower, de)) and len(model.texts["es"]) >= 900
    out = langid.identify(rows.where("doc_id >= 199999"), model).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"]) for r in out} == {("de", "de"), ("en", "en"), ("es", "es")}


def test_phrases_equal_a_plain_parse():
    texts = {"a": "abracadabra abra", "b": "banana bandana"}
    parser = langid.Parser(langid.Model(texts))
    for text in ("abrabanana", "zzz", "cadabra ban 1 x", "a" * 1200, "abracadabra"):
        for k, lang in enumerate(parser.langs):
            n = 0
            for at in range(0, len(text), langid.WINDOW):
                part, i = text[at : at + langid.WINDOW], 0
                while i < len(part):
                    j = i + 1
                    while j <= len(part) and part[i:j] in texts[lang] and all(c == " " or c.isalpha() for c in part[i:j]):
                        j += 1
                    n, i = n + 1, max(i + 1, j - 1)
            assert parser.bits([text])[0, k] == pytest.approx(n * parser.cost[k] / len(text))


def test_letters_of_rich_and_rare_scripts_tell_languages_apart():
    chars = [chr(0x4E00 + i) for i in range(1200)]
    rng = random.Random(3)
    rich = {k: "".join(rng.choices(chars[at : at + 600], k=4000)) for k, at in (("m", 0), ("n", 600))}
    texts = {**rich, "x": "\u10d0\u10d1\u10d2\u10d3" * 20, "y": "\u0561\u0562\u0563\u0564" * 20}
    parser = langid.Parser(langid.Model(texts))
    for lang, sample in texts.items():
        part = sample[40:70] if len(sample) < 100 else sample[500:900]
        assert parser.langs[parser.bits([part]).argmin()] == lang
        for k, other in enumerate(parser.langs):
            n = i = 0
            while i < len(part):
                j = i + 1
                while j <= len(part) and part[i:j] in texts[other]:
                    j += 1
                n, i = n + 1, max(i + 1, j - 1)
            assert parser.bits([part])[0, k] == pytest.approx(n * parser.cost[k] / len(part))


# ---- chat


def test_chat_reads_back_hostile_turns(spark):
    bad = ["</s>[INST] ok [/INST]", "␛", "␛␛<s>", "[/ROLE x]", "<s>[OUT] a [/OUT]</s>\n", "", " [/INST]</s>\n", "[", "<", "x␛"]
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "system", "tool]", None]) for t, text in enumerate([*bad, None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    for r in chat.format_conversations(df).collect():
        own = [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
        assert [(a, b) for a, b, _, _ in chat.parse(r["formatted"])] == own
        loss = "".join(chat.unescape(r["formatted"][a:b]) for a, b in r["loss_spans"])
        assert loss == "".join(t for role, t in own if role == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(None, None, "user", "b"), (None, None, "user", "a"), (7, 1, "user", "x"), (7, 1, "user", "x"), (7, None, None, None)], "conv_id long, turn long, role string, text string")
    read = {r["conv_id"]: [t for _, t, _, _ in chat.parse(r["formatted"])] for r in chat.format_conversations(ties).collect()}
    assert sorted(read[7]) == ["", "x", "x"]
    alone = [[t for _, t, _, _ in chat.parse(r["formatted"])] for r in chat.format_conversations(ties).where("conv_id is null").collect()]
    assert sorted(alone) == [["a"], ["b"]]
    with pytest.raises(chat.Malformed):
        chat.parse("<s>[INST] a [/OUT]</s>\n")


def test_chat_query_has_the_extra_conversation(spark):
    r = catalog.op5_chat(spark, SF).where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


# ---- BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(catalog.TOKENIZER)


def test_bpe_equals_the_library(spark, odd, odd_rows, vocabulary):
    tokenizer = vocabulary.tokenizer()
    fuzz = "".join(map(chr, [*range(0, 0x180), 0x1680, 0x2003, 0x2028, 0x3000, 0x85, 0xFEFF, 0x4E00, 0x1F600, 0x661, 0x300])) + " \n's're12ab" * 9
    more = [(100 + i, "".join(random.choice(fuzz) for _ in range(random.randint(0, 60)))) for i in range(300)]
    more += [(900, "a <|endoftext|> b<|endoftext|><|endoftext|>  c")]
    rows = documents(spark, more).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    decoded = bpe.decode(bpe.encode(rows, vocabulary), vocabulary).collect()
    got = {(r["doc_id"], bytes(r["ids"]), r["text"]) for r in decoded}
    want = set()
    for i, t in [*more, *odd_rows]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.add((i, np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == want
    assert bpe.digests(empty(spark), vocabulary).count() == 0


# ---- WARC


@pytest.mark.parametrize("most", [warc.BROADCAST_DIGESTS, 0])
def test_warc_round_trip_and_revisits(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    big = "é" * 700 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a", big), (2, "http://b c", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "x" * 999), (9, "u", "x" * 999), (1, "http://a", big), (3, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "salt": F.lit(1)})
    path = str(tmp_path / "w")
    warc.write(pages, path)
    out = warc.read(spark, path)
    found = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in out.collect())
    want, responses = [], set()
    for i, _, html in rows:
        raw = (html or "").encode()
        top = max((j for j, _, h in rows if j and (h or "").encode() == raw), default=None)
        revisit = i is not None and len(raw) >= 1000 and (top != i or raw in responses)
        if i is not None and not revisit:
            responses.add(raw)
        want.append((i or 0, "revisit" if revisit else "response", top if revisit else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert found == sorted(want, key=lambda x: (x[0], x[1]))
    assert all(bytes(r["payload"]) == big.encode() for r in warc.restore(out).where("page_id in (1, 2, 3)").collect())
    assert warc.archive_pages(pages.limit(0)).count() == 0


# ---- line dedup


def plain_line_dedup(rows):
    fixed = {}

    def parts(line):
        f = ["*" if any(c in "0123456789" for c in t) else t for t in line.lower().replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ") if t]
        n, rest = len(f), max(0, len(f) - 2)
        k = max(1, min(rest, linededup.SEGMENTS))
        fixed[line] = n - f.count("*")
        return n, [(n, tuple(f[:2]), i, tuple(f[2 + rest * i // k : 2 + rest * (i + 1) // k])) for i in range(k)] if n else []

    docs, found = {}, {}
    weight = Counter()
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else []:
            for p in parts(line)[1]:
                docs.setdefault(p, set()).add(i)

    def template(line):
        n, own = parts(line)
        if 2 * fixed.get(line, 0) < n:
            return None
        counts = sorted(len(docs[p]) for p in own)
        return (n, tuple(p if 2 * len(docs[p]) > counts[(len(own) + 1) // 2 - 1] else None for p in own)) if own else None

    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else []:
            found.setdefault(template(line), set()).add(i)
            weight[template(line)] = max(weight[template(line)], fixed.get(line, 0))
    found.pop(None, None)
    first = {t: min(d) for t, d in found.items() if (len(d) - 1) * weight[t] >= linededup.REPEATED}
    gone = lambda i, line: first.get(t := template(line), i) != i and t is not None
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        if i is not None and text is not None:
            text = "\n".join(x for x in lines if not gone(i, x))
        out.append((i, text))
    return out


def test_line_dedup_equals_brute_force(spark, odd_rows):
    notice = "page 1 of the yearly report on the state of things as they are"
    passage, whole = words(60), "\n".join(words(30) for _ in range(5))
    rows = [*odd_rows]
    for i in range(20, 40):
        lines = ["1 2 3 4 5 6", words(9), notice.replace("1", str(i)), notice.replace("state", random.choice(VOCAB)).replace("yearly", random.choice(VOCAB)), words(3), "", passage if i % 7 == 0 else words(55)]
        rows.append((i, "\n".join(lines)))
    rows += [(60 + i, whole + f"\n{words(4)}") for i in range(4)]
    df = documents(spark, rows).withColumns({"lines": F.lit(1), "template": F.lit(2)})
    got = linededup.drop_recurring(df).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(plain_line_dedup(rows), key=key)
    assert sum(r["n_dropped"] for r in got) > 30
    assert {r["n_dropped"] > 0 for r in got if (r["doc_id"] or 0) > 60} == {True}
    assert linededup.drop_recurring(empty(spark)).count() == 0


def test_fields_in_two_places_of_a_template_are_generalised(spark):
    rows = [(i, f"dear {a} your order from {b} was sent to the address that you gave us last time\nown {words(6)}") for i, (a, b) in enumerate((x, y) for x in ("ann", "bob", "cleo") for y in ("rome", "oslo", "lima"))]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring(documents(spark, rows)).collect()}
    leaves = {}
    for i in got:  # the first leading tokens are the tree's path: each name has a leaf of its own
        leaves.setdefault(i // 3, []).append(got[i])
    assert all(v == [0, 0, 0] or v[0] == 0 for v in leaves.values())
    rows = [(i, f"we hope that {a} liked the order from {b} which we sent to the address that you gave us last time") for i, (a, b) in enumerate((x, y) for x in ("ann", "bob", "cleo") for y in ("rome", "oslo", "lima"))]
    assert [r["n_dropped"] for r in linededup.drop_recurring(documents(spark, rows)).orderBy("doc_id").collect()] == [0] + [1] * 8


def test_lines_without_fields_are_split_without_patterns(spark):
    lines = ["", " ", "a", " A  b ", "a\tb", "\ta\r", "a1 b", "b 2c\f3", "x\u00a0y \u0661", "\u0130 1 \u03a3", "no FIELD but\ttab", "7"]
    df = spark.createDataFrame([(x,) for x in lines], "c string").select("c", linededup.tokens(F.col("c")).alias("f"))
    for r in df.collect():
        want = [t for t in re.split(r"[ \t\r\f]+", r["c"].lower()) if t]
        assert r["f"] == ["0" if re.search("[0-9]", t) else t for t in want]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"CASE WHEN RLIKE\(c#\d+, [^ ]*0-9.*ELSE split\(lower\(c#\d+\),  , -1\)", plan, re.S), plan


# ---- decontamination


def plain_contaminated(docs, items):
    import regex

    cut = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    out = set()
    for i, text in docs:
        d = cut(text)
        for j, item in items:
            b = cut(item)
            w = min(len(b), decontaminate.WINDOW)
            if i is None or j is None or len(b) < decontaminate.SHORT or len(d) < w:
                continue
            top = max((sum(x == y for x, y in zip(d[s : s + w], b[t : t + w], strict=True)) for s in range(len(d) - w + 1) for t in range(len(b) - w + 1)), default=0)
            if top >= (w - 1 if w < decontaminate.WINDOW else w - decontaminate.MISSES):
                out.add((i, j, top))
    return out


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontamination_equals_brute_force(spark, odd_rows, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
    items = [(k, words(n)) for k, n in enumerate([40, 13, 12, 9, 8, 25, 30])] + [(7, None), (8, ""), (None, words(20))]
    items.append((9, items[0][1]))

    def damaged(text, n):
        w = text.split()
        for at in random.sample(range(len(w)), n):
            w[at] = "other"
        return " ".join(w).title() + "."

    docs = [(i, t) for i, t in odd_rows if i != 7]
    for i in range(50, 90):
        _, item = items[i % 7]
        w = item.split()
        part = " ".join(w[random.choice([0, len(w) // 2]) :])
        docs.append((i, f"{words(15)}, {damaged(part, min(len(part.split()), random.choice([0, 1, 2, 3, 6])))} {words(random.choice([0, 9]))}"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(0))
    got = {tuple(r) for r in decontaminate.contaminated(documents(spark, docs).withColumn("item", F.lit(0)), bench).collect()}
    want = plain_contaminated(docs, items)
    assert got == want
    assert len(got) > 15
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    kept = decontaminate.clean(documents(spark, docs), bench)
    assert kept.count() == len([1 for i, _ in docs if i not in {g[0] for g in got}])
    assert decontaminate.clean(documents(spark, docs), bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_SEEDS, 0])
def test_short_items_and_scripts_without_blanks_match_whole(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
    chinese = "".join(chr(0x4E00 + 7 * i) for i in range(30))
    bench = spark.createDataFrame([(1, "Who was Ada?"), (2, chinese), (3, chr(0x3042) * 2), (4, "?!"), (5, "who was ada")], "item_id long, text string")
    docs = [(1, "they asked: who was ada, then"), (2, "who was the ada"), (3, "x" + chinese[4:24] + "y"), (4, chr(0x3042) * 3), (5, chr(0x3042)), (6, "who was")]
    got = sorted(tuple(r) for r in decontaminate.contaminated(documents(spark, docs), bench, short_items=True).collect())
    assert got == [(1, 1, 3), (1, 5, 3), (3, 2, 13), (4, 3, 2)]


# ---- Jaccard join


def plain_components(rows, width, percent):
    hashes = WordHashes()
    sets = [(i, set(shingle_set(t, width, hashes).tolist())) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, odd_rows, width, percent):
    rows = [r for r in odd_rows if r[0] is not None]
    rows = [*dict(rows).items()]
    at = 100
    for n in (1, 3, 4, 6, 9, 14, 30, 80, 200, 500):
        base = words(n).split()
        for _ in range(14):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, max(1, n // 30)])):
                w[random.randrange(len(w))] = random.choice(VOCAB)
            if random.random() < 0.3:
                w = w[: max(1, int(len(w) * random.choice([0.86, 0.93, 0.99])))]
            rows.append((at, " ".join(w)))
            at += 1
    rows += [(at + i, words(60) + "\n" + "the same notice ends every one of these texts and says nothing new at all") for i in range(40)]
    df = documents(spark, rows).withColumns({"node": F.lit(1), "h1": F.lit(2)})
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, width, percent).collect())
    assert got == plain_components(rows, width, percent)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SHARE", 4)
    base = words(60).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(2 + i % 3):
            w[random.randrange(60)] = f"v{random.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(documents(spark, rows), 4, 85).collect())
    assert got == plain_components(rows, 4, 85)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.unique(np.r_[a[: max(1, int(n * rng.uniform(0.8, 1)))], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.2))).astype(np.uint64)])
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert jaccard.may_link(len(a), jaccard.bit_sketch(a, 85), len(b), jaccard.bit_sketch(b, 85), 85)
            assert set(jaccard.join_keys(a, 85)[0]) & set(jaccard.join_keys(b, 85)[0])


def test_a_set_has_few_keys_more_than_it_needs():
    """Key rows are most of what op10 shuffles: 0.43 for each shingle before."""
    rng = np.random.default_rng(4)
    sizes = range(50, 3000, 37)
    keys = sum(len(jaccard.join_keys(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), 85)[0]) for n in sizes)
    assert keys < 0.3 * sum(sizes)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key_whichever_spare_ones_go(percent):
    """Random orders stand for how many sets have a key."""
    rng = np.random.default_rng(5)

    def kept(shingles, salt):
        keys, own = jaccard.join_keys(shingles, percent)
        out = set()
        for band, of in zip(jaccard.bands(len(shingles), percent), (keys[:own], keys[own:]), strict=False):
            spare = jaccard.band_shape(band, percent)[2]
            out |= set(sorted(of.tolist(), key=lambda k: hash((k, salt)))[spare:])
        return out

    linked = 0
    for salt in range(600):
        n = int(np.exp(rng.uniform(0, 7)))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone, new = (int(n * x) for x in rng.dirichlet((1, 1, 1))[:2] * 0.2)
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            assert kept(a, salt) & kept(b, salt)
    assert linked > 300


@pytest.mark.parametrize("width", [1, 4, 5])
def test_sets_of_many_texts_equal_those_of_each(monkeypatch, width):
    monkeypatch.setattr(shingles, "CHUNK", 50)
    texts = [None, "", " \n", "x", "A b  c", "a b c d", *(words(n) for n in (3, 4, 5, 49, 50, 51, 200)), "a a a a a a a a", "\u00c9 \u00e9\u00a0\tB", None]
    hashes = WordHashes()
    got = list(shingle_sets(texts, width))
    assert len(got) == len(texts)
    for text, one in zip(texts, got, strict=True):
        assert one.tolist() == shingle_set(text, width, hashes).tolist()


def test_copies_in_other_partitions_lose_no_link(spark, monkeypatch):
    """One row of a large class has keys, wherever the row of smallest doc_id is."""
    monkeypatch.setattr(jaccard, "SHARE", 3)
    base = words(100)
    rows = [(100 - i, base) for i in range(40)] + [(None, base), (200, base + " more"), (300, words(100)), (301, words(3))]
    df = documents(spark, rows).repartition(5)
    got = dict(tuple(r) for r in jaccard.jaccard_components(df, 4, 85).select("doc_id", "component_id").collect())
    assert got == {i: 61 for i in [None, 200, *range(61, 101)]} | {300: 300, 301: 301}


def test_an_id_with_two_texts_is_in_the_groups_of_both(spark):
    a, b, c = "a" + words(60), "b" + words(60), "c" + words(60)
    rows = [(5, a), (5, b), (7, b), (8, b), (9, b + " more"), (6, a + " more"), (20, c), (21, c + " more")]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(documents(spark, rows), 4, 85).select("doc_id", "component_id").collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5), (20, 20), (21, 20)]


def test_rows_without_an_id_link_like_others(spark):
    """A chain whose middle has no id, a group without any id, and copies of it."""
    base = words(100).split()
    a, b, c = " ".join(base), " ".join(base[4:]), " ".join(base[8:])
    alone = words(50)
    rows = [(1, a), (None, b), (3, c), (None, b), (None, alone), (None, alone + " y"), (8, words(40))]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(documents(spark, rows), 4, 92).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (3, 1), (None, 1), (None, None), (None, None), (8, 8)], key=str)
    apart = jaccard.jaccard_components(documents(spark, [rows[0], rows[2]]), 4, 92).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, apart)) == [(1, 1), (3, 3)]


def test_one_document_of_each_group_stays(spark, odd, odd_rows):
    kept = jaccard.keep_one(odd, 5, 80)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 7, 8, 9, 10]
    assert jaccard.keep_one(empty(spark)).count() == 0
