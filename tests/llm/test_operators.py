"""Each operator against a brute-force version on a small table with nulls, empties, ties, copies and repeated passages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from staffline.llm import bpe, chat, decontaminate, langid, langmodel, permutation, queries, shard, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"
WORD = re.compile(r"[^ \t-\r]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus():
    rng = random.Random(3)
    vocab = {"en": [f"w{i}" for i in range(60)], "de": [f"ü{i}ß" for i in range(60)]}
    shared = " ".join(rng.choices(vocab["en"], k=35))
    rows = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        t = " ".join(rng.choices(vocab[lang], k=rng.choice([1, 5, 40, 120])))
        if i % 9 == 0:
            t = t + "\n" + shared + " end"
        rows.append((i, t, lang))
    rows += [(100 + k, rows[2][1], "en") for k in range(12)] + [(200, rows[3][1] + " more", "de")]
    rows += [(300, None, None), (301, "", "en"), (302, " \t\n", None), (303, "a " * 70, "en"), (304, "12 <|endoftext|> x y " * 9, None), (305, "w1 " * 30_000, "en")]
    return [(i, t, g, "s", None, 0.5, "x") for i, t, g in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_chat_round_trip(spark):
    texts = ["<|im_start|>x", "a\\pb\\b<|", None, "", "line\nline", "<|im_end|>\n<|im_start|>assistant ok"]
    turns = [(1, k, ("user", "assistant")[k % 2], t, 0) for k, t in enumerate(texts)] + [(2, 0, None, "t", 0), (None, 0, "we\nird<|", "u", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, valid int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, _, r, t, _ in turns:
        by[c].append((r or "", t or ""))
    for c, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in ts)) and got[c].loss_sha256 == sha(loss)
        assert (got[c].n_turns, got[c].loss_chars) == (len(ts), len(loss))
    assert got[1].valid and not got[2].valid
    assert chat.format_chats(df.filter("false")).count() == 0


def repeats(rows, window=20):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), sha(" ".join(kept)), kept)
    return out


def test_substring(docs, rows, empty):
    want = repeats(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeats(docs).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    cut = {r.doc_id: r.text for r in substring.dedup(docs).collect()}
    assert all(WORD.findall(cut[i] or "") == want[i][3] for i in want) and cut[300] is None
    assert substring.repeats(empty).count() == 0 and substring.dedup(empty).columns == empty.columns


def test_cut_reference(spark, docs, rows):
    ref = [rows[0][1]]
    got = {r.doc_id: r.text for r in substring.cut_reference(docs.filter("doc_id < 60"), ref).collect()}
    assert WORD.findall(got[0]) == [] or len(WORD.findall(rows[0][1])) < 20
    assert got[1] == rows[1][1]


def test_langmodel(docs, rows, empty):
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = {r.doc_id: r for r in langmodel.score(own, langmodel.fit(own.filter("not held_out"))).collect()}
    count = Counter()
    toks = {i: [*WORD.findall(lower(t)), None] for i, t, *_ in rows}
    for i in toks:
        if i % 7 != 2:
            count.update(toks[i])
    n, v = sum(count.values()), len(count)
    for i, ts in toks.items():
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(t in count for t in ts), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))
    assert sum(r.score for r in got.values() if r.doc_id < 80) > sum(r.base_score for r in got.values() if r.doc_id < 80)
    none = empty.select("doc_id", "text")
    assert langmodel.score(none, langmodel.fit(none)).count() == 0


def test_langmodel_shuffled_counts_and_normalisation(docs, monkeypatch):
    own = docs.select("doc_id", "text").filter("doc_id < 60")
    one = {r.doc_id: r for r in langmodel.score(own, langmodel.fit(own)).collect()}
    monkeypatch.setattr(langmodel, "TABLE", 40)
    monkeypatch.setattr(langmodel, "SYMBOLS", 20)
    model, counted = langmodel.fit(own)
    two = {r.doc_id: r for r in langmodel.score(own, (model, counted)).collect()}
    assert all((one[i].n_known, one[i].n_tokens) == (two[i].n_known, two[i].n_tokens) and abs(one[i].base_score - two[i].base_score) < 1e-6 for i in one)
    net = model.network()
    h = np.random.default_rng(1).standard_normal((3, langmodel.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.log_probs(h, np.full(3, s))[0]) for s in range(net.n + 1))
    assert np.allclose(total, 1, atol=1e-4)


def test_langmodel_trains_on_all_texts(spark, docs):
    own = docs.select("doc_id", "text").filter("doc_id < 60")
    model, _ = langmodel.fit(own.unionByName(own.withColumn("doc_id", F.lit(None).cast("long"))))
    assert model.trained == model.n > 0


def fingerprint(t, words=4):
    w = WORD.findall(lower(t))
    sh = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fp = {r[0]: fingerprint(r[1]) for r in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(fp):
        for j in fp:
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}
    assert {r.doc_id for r in simhash.keep_one(docs, words=4).collect()} == {find(i) for i in fp}
    assert simhash.near_duplicates(empty).count() == 0


def test_shard(docs, rows, empty):
    got = shard.shard(docs, n_shards=7).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((r[0], r[1] or "") for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert shard.shard(empty).count() == 0


def test_shard_maps_seeds_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i % 9, "t" * (i % 5), {"a": i}, i, -1) for i in range(400)], "doc_id long, text string, m map<string,int>, shard int, slot int").repartition(4)
    one, two = (sorted((r.doc_id, r.m["a"], r.shard, r.slot) for r in shard.shard(df, n_shards=3, bucket_bytes=500).collect()) for _ in range(2))
    other = sorted((r.doc_id, r.m["a"], r.shard, r.slot) for r in shard.shard(df, n_shards=3, seed=2, bucket_bytes=500).collect())
    assert one == two != other and {x[:2] for x in one} == {(i % 9, i) for i in range(400)}
    shard.write_shards(shard.shard(df, n_shards=3), str(tmp_path / "s"), file_bytes=1500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 400 and len(back.inputFiles()) > 3
    for f in back.inputFiles():
        slots = [r.slot for r in spark.read.parquet(f).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_keep_one_judges_rows(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=80)) for _ in range(3))
    rows = [(1, a, 1), (1, b, 2), (2, b, 3), (3, a, 4), (None, c, 5), (None, c, 6), (None, a, 7), (1, a, 8), (4, None, 9), (5, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_one(df, words=5).collect())
    assert got == sorted([(1, a), (1, b), (0, c), (4, "")])
    assert simhash.keep_one(df.filter("false")).count() == 0


def test_langid(docs, empty):
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs.filter("doc_id % 3 <> 1"))).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(80) if i % 9)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (300, 301, 302))
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_permutation(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((600, 8)), np.repeat(rng.standard_normal((1, 8)), 300, 0)])
    data = [(int(i), [float(a) for a in v], 1.0, 2) for i, v in enumerate(x)]
    bad = [(9000, None), (9001, [0.0] * 8), (9002, [math.nan] * 8), (9003, [1.0, None] * 4), (9004, []), (9005, [1.0])]
    df = spark.createDataFrame([*data, *((i, v, 1.0, 2) for i, v in bad)], "vec_id long, embedding array<float>, score double, rank int")
    got = defaultdict(list)
    for r in permutation.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y, hit = x.astype(np.float32).astype(float), 0
    for q in range(0, 900, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in mine)
        hit += len(set(want) & {v for _, v, _ in mine})
    assert hit >= 81 and len(got) == 9
    few = permutation.search(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert permutation.search(df.filter("false"), F.col("vec_id") == 0).count() == 0


def test_permutation_more_pivots_than_visited(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    monkeypatch.setattr(permutation, "VISITED", 8)
    monkeypatch.setattr(permutation, "RERANK", 40)
    y, hit, got = x.astype(float), 0, defaultdict(set)
    for r in permutation.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    for q in range(0, 4000, 50):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.98 * 800, hit


def test_footrule():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.permutation(20)[:6].astype(np.int16) for _ in range(2))
        pa, pb = ({p: k for k, p in enumerate(z.tolist())} for z in (a, b))
        want = sum(abs(pa.get(p, 6) - pb.get(p, 6)) for p in {*pa, *pb})
        assert permutation.footrule(a, b[None, :], 20)[0] == want


def test_toxicity(spark, empty):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows = []
    for i in range(400):
        t = rng.choices(words, k=30)
        if i % 4 == 0:
            t[rng.randrange(30)] = "horridscum"
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample, share = toxicity.sample_labelled(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    model = toxicity.fit(sample, share=share)
    plain = " ".join(words[:20])
    probe = [(1, plain + " h0rr1dscum"), (2, plain + " h o r r i d s c u m"), (3, plain + " hoooorridscuuum"), (4, plain), (5, None), (6, "")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert all(got[i] >= 0.5 for i in (1, 2, 3)) and all(got[i] < 0.5 for i in (4, 5, 6))
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_viterbi_against_all_paths():
    chars = toxicity.CharModel(Counter({"idiot": 9, "clown": 7, "stand": 9, "clan": 4, "at": 5}))

    def best(runs, state, word, cost, spaced):
        if not runs:
            return cost + (chars._end(state, word) if state != "^^^" else 0.0)
        out = []
        for text, price in chars.arcs(*runs[0], spaced):
            for tail in ("", " ") if spaced else ("",):
                s, w, c = state, word, cost + price
                if tail:
                    c += toxicity.COST["break"]
                for x in text + tail:
                    if x == " ":
                        c += chars._end(s, w)
                        s, w = "^^^", ""
                    else:
                        c += chars.cost(s, x)
                        s, w = s[1:] + x, (w + x if w is not None and w + x in chars.heads else None)
                if tail and s == state == "^^^":
                    continue
                out.append(best(runs[1:], s, w, c, spaced))
        return min(out)

    for token, spaced in (("1d10t", False), ("c.l0wn", False), ("sttand", False), ("c|@n", False), ("clanat", True), ("1diot", True)):
        runs = [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", token)]
        assert abs(chars.decode(token, spaced)[1] - best(runs, "^^^", "", 0.0, spaced)) < 1e-9, token
    assert chars.decode("1d10t")[0] == "idiot" and chars.decode("c.l0wn")[0] == "clown"


def test_toxicity_rare_words_and_labels(spark, empty):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    bad = [f"{a}{b}{a}x{c}" for a in "ptkz" for b in "aeiou" for c in "aeio"]  # 80 toxic words, a few texts each
    rows = [(i, " ".join(rng.choices(words, k=60) + [bad[i % 80]] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    sample, share = toxicity.sample_labelled(docs.unionByName(docs.limit(5)), labels)
    assert sample.count() == 1500 and abs(share - 1 / 3) < 0.01
    model = toxicity.fit(sample, share=share)
    probe = [(i, " ".join(rng.choices(words, k=60) + [bad[i]] * (i < 80))) for i in range(80)] + [(100 + i, " ".join(rng.choices(words, k=60))) for i in range(80)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert sum(got[i] >= 0.5 for i in range(80)) >= 72 and sum(got[100 + i] < 0.5 for i in range(80)) >= 76
    clean, share = toxicity.sample_labelled(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs.limit(3), toxicity.fit(clean, share=share)).collect()} == {0.0}
    none, share = toxicity.sample_labelled(empty, labels.filter("false"))
    assert toxicity.score(empty, toxicity.fit(none, share=share)).count() == 0


def test_toxicity_learns_from_all_rows(spark):
    """More rows than the former sample held (1,500 toxic and 4,000 clean ids): all are taken, and each counts in the model's share."""
    docs = spark.range(6600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("calm"), F.when(F.col("id") % 4 == 0, "vile").otherwise("kind"), F.when(F.col("id") % 660 == 0, "rarest")).alias("text"))
    rows, share = toxicity.sample_labelled(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    assert rows.count() == 6600 and share == 0.25
    keys, weights, _, common = toxicity.fit(rows, share=share)
    assert dict(common) == {"calm": 6600, "vile": 1650, "kind": 4950, "rarest": 10} and len(keys) == len(weights) > 0


def test_toxicity_features_do_not_hang_on_neighbours():
    texts = pa.array(["a vile one", None, "", "two of them", "!", "last"], pa.large_string())
    keys, rows = toxicity.features(texts)
    for i in range(len(texts)):
        assert toxicity.features(texts[i : i + 1])[0].tolist() == keys[rows == i].tolist()


def test_toxicity_features_against_all_counts(spark, monkeypatch):
    """The best features by counts of all rows, found a few at a time; the optimum where blocks stay in tasks and on the driver."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"]
    texts = [(int(i % 5 == 0), " ".join(rng.choices(words[:15] if i % 5 else words, k=6))) for i in range(300)]
    rows = spark.createDataFrame(texts, "toxic int, text string").repartition(3)
    count = {y: Counter() for y in (0, 1)}
    for y, t in texts:
        count[y].update(toxicity.features(pa.array([t], pa.large_string()))[0].tolist())
    n1, n0 = 60, 240
    g2 = {k: float(toxicity._g2(h, count[0][k], n1, n0)) for k, h in count[1].items() if h >= toxicity.MIN_TEXTS}
    want = sorted((k for k in g2 if g2[k] >= toxicity.MIN_G2), key=lambda k: (-g2[k], k))
    monkeypatch.setattr(toxicity, "PART", 500)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    for pool, most in ((40, 60), (40, 4000), (1 << 20, 60)):
        monkeypatch.setattr(toxicity, "POOL", pool)
        monkeypatch.setattr(toxicity, "MAX_FEATURES", most)
        keys, held = toxicity.candidates(rows, n1, n0, 3)
        assert keys.tolist() == sorted(want[:most]) and held.tolist() == [count[0][k] + count[1][k] for k in keys.tolist()]
    matrix = toxicity._matrix(rows, keys)
    w, b = toxicity.learn(matrix, held, n1, n0, 2)
    monkeypatch.setattr(toxicity, "IN_DRIVER", 0)
    w2, b2 = toxicity.learn(matrix, held, n1, n0, 2)
    assert np.allclose(w, w2, atol=1e-3) and abs(b - b2) < 1e-3
    # conditions of the optimum, by plain sums: no slope where a weight is positive, none downwards where it is zero
    at = {k: i for i, k in enumerate(keys.tolist())}
    slope, free = np.full(len(w), toxicity.LASSO) + toxicity.RIDGE * w, 0.0
    for y, t in texts:
        own = [at[k] for k in toxicity.features(pa.array([t], pa.large_string()))[0].tolist() if k in at]
        r = 1 / (1 + np.exp(-(w[own].sum() + b))) - y
        slope[own] += r
        free += r
    assert abs(free) < 0.1 and np.abs(slope[w > 0]).max() < 0.1 and slope[w == 0].min() > -0.1


def test_toxicity_long_and_mixed_disguises(spark):
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(words, k=30) + ["horridscum"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample, share = toxicity.sample_labelled(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    model = toxicity.fit(sample, share=share)
    long, spell = words[:14], lambda ws: " ".join("".join(ws))
    bad = ["h" + "o" * 90 + "rridscum", ".".join([*long, "h0rr1dsc" + "u" * 5 + "m", *long]), spell([*long, "horridscum"]), "h 0 r r 1 d s c u m", "\u00e9 h o r r i d s c u m", spell(["bal", "horridscum", "dem"])]
    good = [spell(long * 3), ".".join(long * 2), "b" + "a" * 90 + "l", "a 1 2 3", "1 2 3 4", "x9" * 3000]
    probe = [(i, t) for i, t in enumerate(bad + good)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert [got[i] >= 0.5 for i in range(len(probe))] == [True] * len(bad) + [False] * len(good)


def test_decontaminate(spark, docs, rows, empty):
    items = [(1, rows[0][1]), (2, rows[1][1]), (3, "w1 w2 w3"), (4, None), (5, ""), (None, "w1"), (11, "zz"), (6, rows[40][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(k) for k in windows}
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, t, *_ in rows:
        w = word.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(found)), i
        assert got[i].items_sha256 == sha(",".join(sorted(map(str, found)))) and got[i].contaminated == bool(hit)
    split = {r.doc_id: tuple(r) for r in decontaminate.contamination(docs, bench, shard_bytes=500).collect()}
    assert split == {i: tuple(r) for i, r in got.items()}
    assert decontaminate.decontaminate(docs, bench.filter("false")).count() == len(rows)
    assert decontaminate.contamination(empty, bench).count() == 0


def test_bpe(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    t = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path).drop("text"), path).collect()}
    assert all(back[i] == (text or "") for i, text, *_ in rows)
    assert bpe.digests(empty, path).count() == 0


def test_bpe_reuse_joins_and_text_without_blanks(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    t, own = tokenizers.Tokenizer.from_file(path), bpe.Codec(open(path, encoding="utf-8").read())
    rng = random.Random(9)
    shared = " ".join(rng.choices(["alpha", "don't", "x1", "été", "--", "<|endoftext|>"], k=4000))
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(350_000))
    texts = [f"one {shared}", f"two\n\n {shared} end", han, han[:9000] + " a b " + han[:9000], "x" * 9000, " " * 9000, "a  \n\t b" * 3000, ""]
    for text, ids in zip(texts, own.texts(pa.array(texts)), strict=True):
        assert ids == t.encode(text, add_special_tokens=False).ids and own.decode(ids) == text
    assert own.reused > 3 and own.repaired > 3
    df = spark.createDataFrame([(1, "a b", [7])], "doc_id long, text string, ids array<int>")
    assert bpe.encode(df, path).columns == ["doc_id", "text", "ids"] and bpe.decode(bpe.encode(df, path), path).first().text == "a b"


def test_langmodel_scores_against_a_plain_recurrence(docs, rows):
    own = docs.select("doc_id", "text").filter("doc_id < 40")
    model, counted = langmodel.fit(own)
    got = {r.doc_id: r for r in langmodel.score(own, (model, counted)).collect()}
    net, w = model.network(), model.weights
    sig = lambda x: 1 / (1 + np.exp(-x))
    for i, t, *_ in rows[:40]:
        h, total = np.zeros(langmodel.HIDDEN), 0.0
        hashes, _ = langmodel.tokens(pa.array([t]))
        _, symbols = model.lookup(hashes)
        for s in symbols.tolist():
            c = h @ w["c"] + w["cb"]
            k = s // langmodel.CLASS
            o = h @ w["o"][k * langmodel.CLASS : (k + 1) * langmodel.CLASS].T + w["ob"][k * langmodel.CLASS : (k + 1) * langmodel.CLASS]
            total += c[k] - np.log(np.exp(c).sum()) + o[s % langmodel.CLASS] - np.log(np.exp(o).sum())
            g, a, n = w["x"][s], h @ w["u"], langmodel.HIDDEN
            z, r = sig(g[:n] + a[:n]), sig(g[n : 2 * n] + a[n : 2 * n])
            m = np.tanh(g[2 * n :] + r * a[2 * n :])
            h = m + z * (h - m)
        assert net.n == model.n_symbols and abs(got[i].score - total / np.log(10)) < 1e-3 * max(1, abs(total)), i


def test_langmodel_trains_as_plain_backpropagation(monkeypatch):
    monkeypatch.setattr(langmodel, "LANES", 4)
    rng, k, span, rate = np.random.default_rng(4), langmodel.HIDDEN, langmodel.SPAN, 0.05
    net = langmodel.Network(100)
    p = {key: v.astype(np.float64) for key, v in net.w.items()}
    s = np.where(rng.random(330) < 0.4, 100, rng.integers(0, 90, 330)).astype(np.int16)  # 100 is the rest
    first = np.sort(rng.choice(330, 30, replace=False))
    net.train(s, first, rate)
    steps, seen, h = 330 // 4, {key: np.full(v.shape, 1e-2) for key, v in p.items()}, np.zeros((4, k))
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for t0 in range(0, steps, span):
        grad, end = {key: np.zeros_like(v) for key, v in p.items()}, min(t0 + span, steps)
        for lane in range(4):
            kept, x, dh = [], h[lane].copy(), np.zeros(k)
            for i in range(lane * steps + t0, lane * steps + end):
                x = np.zeros(k) if i in first else x
                g, a = p["x"][s[i]], x @ p["u"]
                z, r = sig(g[:k] + a[:k]), sig(g[k : 2 * k] + a[k : 2 * k])
                m = np.tanh(g[2 * k :] + r * a[2 * k :])
                kept.append((i, x, z, r, m, a[2 * k :]))
                x = m + z * (x - m)
            h[lane] = x
            for i, x, z, r, m, a in reversed(kept):
                dm = dh * (1 - z) * (1 - m * m)
                dg = np.concatenate([dh * (x - m) * z * (1 - z), dm * a * r * (1 - r), dm])
                da = dg * np.concatenate([np.ones(2 * k), r])
                grad["x"][s[i]] += dg
                grad["u"] += np.outer(x, da)
                dh = dh * z + p["u"] @ da
                cls = 2 if s[i] == 100 else s[i] // 64
                e = soft(x @ p["c"] + p["cb"]) - (np.arange(3) == cls)
                grad["c"] += np.outer(x, e)
                grad["cb"] += e
                dh += p["c"] @ e
                if cls < 2:
                    own = slice(cls * 64, cls * 64 + 64)
                    e = soft(p["o"][own] @ x + p["ob"][own]) - (np.arange(64) == s[i] % 64)
                    grad["o"][own] += np.outer(e, x)
                    grad["ob"][own] += e
                    dh += e @ p["o"][own]
                if i in first:
                    dh[:] = 0
        for key, g in grad.items():
            g = np.clip(g / 4, -1, 1)
            seen[key] += g * g
            p[key] -= rate * g / np.sqrt(seen[key])
    assert all(np.allclose(net.w[key], p[key], atol=2e-4) for key in p), {key: np.abs(net.w[key] - p[key]).max() for key in p}
    assert np.abs(net.w["x"] - langmodel.Network(100).w["x"]).max() > 0.01


def test_langmodel_few_softmaxes_for_few_texts(monkeypatch):
    """One long text among short ones is scored in long windows; before, in one softmax for every 32 words."""
    rng, net, calls = np.random.default_rng(5), langmodel.Network(100), []
    sizes = np.array([3, 6000, 1, 40, 7, 33])
    s, first = rng.integers(0, 101, sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])
    plain = langmodel.Network.log_probs
    monkeypatch.setattr(langmodel.Network, "log_probs", lambda *a: calls.append(len(a[2])) or plain(*a))
    got = net.text_scores(s, first)
    assert sum(calls) == sizes.sum() and len(calls) <= 3
    alone = [net.text_scores(s[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in zip(first, first[1:])]
    assert np.allclose(got, alone, rtol=1e-5) and len(net.text_scores(s[:0], np.zeros(1, int))) == 0


def test_langmodel_lookup():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 50, 3000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        if n == 50:
            keys = np.unique(np.concatenate([keys, np.arange(40, dtype=np.uint64), np.array([2**64 - 1], np.uint64)]))  # many of the same leading bits
        model = langmodel.Model(keys, np.ones(len(keys)), np.arange(len(keys)) % 7, 7, 1, 1, 1)
        h = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64)])
        place = {key: i for i, key in enumerate(keys.tolist())}
        want = [place.get(x, -1) for x in h.tolist()]
        pos, symbol = model.lookup(h)
        assert pos.tolist() == want and symbol.tolist() == [x % 7 if x >= 0 else 7 for x in want]


def test_queries_on_a_folder(spark, tmp_path, docs, rows):
    """The opN queries themselves: folds, laws and digests, against their definitions."""
    rng = random.Random(2)
    extra = [(1000 + i, " ".join(rng.choices(["plain", "words", "only", "here"], k=30)) + (" vilexword" if i % 3 == 0 else ""), "en", "s", None, 0.5, "x") for i in range(240)]
    table = docs.unionByName(spark.createDataFrame(extra, DOCS)).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    all_rows = {r[0]: r[1] for r in [*rows, *extra]}
    crc = lambda i: zlib.crc32(str(i).encode())
    one = {r.doc_id: r for r in queries.op3_langmodel(spark, str(tmp_path)).collect()}
    assert all(one[i].held_out == (crc(i) % 7 == 2) for i in all_rows) and len({r.train_tokens for r in one.values()}) == 1
    five = queries.op5_shard(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in five) == sorted(all_rows) and {r.law for r in five} == {"rows"}
    for r in five:
        t = all_rows[r.doc_id]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode())) and r.grown_shard is None
    sizes = Counter(r.shard for r in five)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40
    assert all(sorted(r.slot for r in five if r.shard == k) == list(range(n)) for k, n in sizes.items())
    six = {r.doc_id: r for r in queries.op6_langid(spark, str(tmp_path)).collect()}
    assert all(six[i].held_out == (crc(i) % 3 == 1) and 0 <= six[i].score <= 1 for i in all_rows)
    assert six[300].lang_pred == six[302].lang_pred == "und" and sum(six[1000 + i].lang_pred == "en" for i in range(240)) > 230
    eight = {r.doc_id: r for r in queries.op8_toxicity(spark, str(tmp_path)).collect()}
    assert all(eight[i].held_out == (crc(i) % 5 == 0) and eight[i].predicted == int(eight[i].score >= 0.5) for i in all_rows)
    assert sum(eight[1000 + i].predicted == int(i % 3 == 0) for i in range(240)) > 230


def test_langid_against_a_plain_parse(spark):
    rng = random.Random(12)
    vocab = {"aa": ["ba", "banu", "kori", "tel"], "bb": ["zumi", "xor", "qat", "ilp"]}
    rows = [(i, " ".join(rng.choices(vocab[g], k=20)), g) for i, g in enumerate(["aa", "bb"] * 10)]
    sample = langid.fit(spark.createDataFrame([*rows, (None, "ba ba", "aa"), (5, None, "bb")], "doc_id long, text string, lang string"))
    model = langid.Model(sample)

    def phrases(text, trained):
        n = k = 0
        while k < len(text):
            m = 1
            while k + m < len(text) and any(text[k : k + m + 1] in t for t in trained):
                m += 1
            k, n = k + m, n + 1
        return n

    spell = lambda t: bytes(model.symbols(np.frombuffer(t.encode(), np.uint8)))
    texts = [" ".join(rng.choices(vocab["aa"] + vocab["bb"], k=12)) for _ in range(20)]
    got = model.rates(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        for j, (_, own) in enumerate(sample):
            trained = [spell(x) for x in own]
            assert math.isclose(row[j], phrases(spell(t), trained) * math.log2(sum(map(len, trained))) / len(spell(t)))


def nasty(spark):
    """Null ids, repeated rows, ids with several texts, very long and odd texts, and columns named as the operators' own."""
    rng = random.Random(7)
    long = " ".join(rng.choices([f"v{i}" for i in range(3000)], k=60_000))
    part = " ".join(rng.choices([f"v{i}" for i in range(3000)], k=60))
    texts = [(1, part), (1, part), (1, "other text of one"), (2, part + " tail"), (None, part), (None, None), (3, ""), (4, " \t\n"), (5, long), (6, long + " x"), (7, "\u00e9\u4e2d\U0001f600 " * 50), (8, "\x00 a"), (None, "alone here")]
    clash = "doc_id long, text string, lang string, n_chars long, shard string, slot string, score string, lang_pred string, ids string, fingerprint string, component_id string, n_tokens string, part string, bucket string, id string, th string, m map<string,int>"
    return texts, spark.createDataFrame([(i, t, "en", 1, *["z"] * 12, {"a": 1}) for i, t in texts], clash).repartition(3)


def test_operators_on_nasty_rows(spark):
    texts, df = nasty(spark)
    items = spark.createDataFrame([(1, texts[3][1]), (None, "alone here"), (2, None), (1, "alone")], "item_id long, text string")
    n = len(texts)
    cut = substring.dedup(df).collect()
    want = repeats([(i if i is not None else 2**63 - 1, t) for i, t in dict.fromkeys(texts) if i not in (1, None)])
    assert len(cut) == n and all(WORD.findall(r.text or "") == want[r.doc_id][3] for r in cut if r.doc_id in (5, 6, 7, 8)) and all(r.m == {"a": 1} for r in cut)
    assert [len(WORD.findall(r.text or "")) for r in cut if r.doc_id == 2] == [1] and sorted(len(WORD.findall(r.text or "")) for r in cut if r.doc_id is None) == [0, 0, 2]
    assert sorted(len(WORD.findall(r.text)) for r in cut if r.doc_id == 1) == [4, 60, 60]  # equal rows are one document
    kept = simhash.keep_one(df, words=5)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, (r.text or "")[:10]) for r in kept.collect())[:2] == [(0, "alone here"), (1, "other text")]
    assert simhash.near_duplicates(df).count() == n
    out = shard.shard(df, n_shards=2)
    assert out.count() == n and dict(out.dtypes)["shard"] == "int" and dict(out.dtypes)["m"] == "map<string,int>"
    seen = langid.identify(df, langid.fit(df))
    assert seen.count() == n and dict(seen.dtypes)["score"] == "double" and seen.filter("lang_pred = 'und'").count() == 3
    assert langid.identify(df, langid.fit(df.withColumn("lang", F.lit(None).cast("string")))).filter("lang_pred <> 'und'").count() == 0
    scored = langmodel.score(df.select("doc_id", "text", "n_tokens", "part", "id"), langmodel.fit(df)).collect()
    assert sorted(r.n_tokens for r in scored) == sorted(len(WORD.findall(t or "")) + 1 for _, t in texts) and all(r.n_known == r.n_tokens for r in scored)
    assert len({(r.doc_id, r.n_tokens, round(r.score, 3)) for r in scored if r.doc_id == 1}) == 2  # repeated rows score alike
    hit = decontaminate.contamination(df, items).collect()
    assert len(hit) == n and sum(r.contaminated for r in hit) >= 5 and decontaminate.decontaminate(df, items).columns == df.columns
    sample, share = toxicity.sample_labelled(df, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, 1)], "doc_id long, toxic int"))
    assert sample.count() == 2 and toxicity.score(df, toxicity.fit(sample, share=share)).count() == n
    enc = bpe.encode(df, queries.vocabulary_path())
    assert dict(enc.dtypes)["ids"] == "array<int>" and {(r.doc_id, r.text) for r in bpe.decode(enc, queries.vocabulary_path()).collect()} == {(i, t or "") for i, t in texts}
    turns = spark.createDataFrame([(1, 1, "user", "b", 1), (1, 1, "user", "a", 1), (1, 1, "user", "a", 1), (1, None, "system", "x" * 200_000, 1)], "conv_id long, turn long, role string, text string, segments int")
    r = chat.digests(chat.format_chats(turns)).first()
    assert r.n_turns == 4 and r.turns_sha256 == sha("system\n" + "x" * 200_000 + "\n" + "user\na\nuser\na\nuser\nb\n")


def test_permutation_repeated_ids_and_few_hits(spark):
    v = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [0.0, 2.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = {}
    for r in permutation.search(df, F.col("vec_id") == 1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got[1]) == [(1, 2), (2, 3)]


def test_pipeline_stages_on_nasty_rows(spark, tmp_path):
    import corpus_pipeline

    texts, df = nasty(spark)
    spark.createDataFrame([(1, "no such words at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        rows = out.collect()
        if name == "near":
            assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 1, 5, 7, 8], rows
        docs = spark.createDataFrame(rows, out.schema)
    assert all(r.ids is not None for r in rows)


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {300, 301, 302, 100, 111} and len(ids) == len(out) and out[0].ids is not None
    kept = {r.doc_id: WORD.findall(r.text) for r in out}
    windows = Counter(tuple(w[k : k + 20]) for w in kept.values() for k in range(len(w) - 19))
    assert not windows or max(windows.values()) == 1


def test_worker_keeps_one_model():
    import gc
    import weakref

    from staffline.llm import _text

    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        content = f.read()
    codec = weakref.ref(bpe.codec(content))
    assert bpe.codec(content) is codec()  # kept from task to task
    _text.powers(1 << 20)
    model = langid._model((("en", ("some words",)),))
    gc.collect()
    assert codec() is None and len(_text._held[0]) == 1 and langid._model((("en", ("some words",)),)) is model
