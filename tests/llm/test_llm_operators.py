"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns; against brute force."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import chat_format, decontamination, exact_dedup, language_id, line_dedup, near_dedup, packing, secret_scan, sharding, textkit, toxicity

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
LONG = " ".join(f"w{i * i % 7919}" for i in range(30_000))
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.upper()), (4, BASE + " more"), (5, None), (6, ""), (7, " \n\t "), (8, "two words"), (9, "Two  words"), (10, LONG), (11, LONG[:-6]), (None, BASE), (None, None),
    (12, "ünïcödé ＡＢＣ don't stop. <|endoftext|> <|ENDOFTEXT|> a.b,c 3.14 …end"), (13, "same line here now ok\n" * 3),
]
EXTRA = [("en", 7.5, i, "x", True) for i in range(len(ROWS))]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, score double, keep long, kept string, hit boolean"
    return spark.createDataFrame([(*a, *b) for a, b in zip(ROWS, EXTRA)], schema).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_words_follow_the_contract():
    t = ["a  b c\x0bd", "", None, "x" * 3000, "É é\x1cz"]
    for lo, hi, buf, offs in textkit.blocks(pa.array(t), 8):
        s, e, at = textkit.words(buf, offs)
        got = [buf[a:b].tobytes().decode() for a, b in zip(s, e)]
        assert got == [w for x in t[lo:hi] for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")]


def test_near_duplicates(spark, docs, none):
    out = rows(near_dedup.near_duplicates(spark, docs))
    assert len(out) == len(ROWS) and near_dedup.near_duplicates(spark, none).count() == 0
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    text = {}
    for i, t in ROWS:
        text.setdefault(i, t)
    for i, r in by.items():
        mine = shingles(text[i])
        assert r["n_shingles"] == len(mine)
        near = {j for j in by if mine and shingles(text[j]) and 100 * len(mine & shingles(text[j])) >= 75 * len(mine | shingles(text[j]))}
        assert r["component_id"] == min(near | {i}) and r["kept"] == (r["component_id"] == i)
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)


def test_near_duplicates_of_a_large_family(spark):
    rng = np.random.default_rng(0)
    base, out = [f"v{k}" for k in rng.integers(0, 4000, 120)], []
    for i in range(160):
        w = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 9))):
            w[k] = f"n{rng.integers(10**6)}"
        out.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in rows(near_dedup.near_duplicates(spark, spark.createDataFrame(out, "doc_id long, text string")))}
    sets, top = [shingles(t) for _, t in out], list(range(len(out)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(range(len(out)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in range(len(out))}


def test_pair_is_told_in_the_first_band_that_it_shares():
    rng = np.random.default_rng(11)
    x = rng.integers(0, near_dedup.RING, near_dedup.COORDS)
    y = x.copy()
    y[: near_dedup.ROWS] ^= 1 << 8  # the first band agrees in the low 8 bits only
    keys = [[int(z) for z in (c.reshape(near_dedup.BANDS, near_dedup.ROWS) * np.arange(1, 6)).sum(axis=1)] for c in (x, y)]
    schema = pa.schema(
        [("key", pa.int64()), ("band", pa.int32()), ("part", pa.int32()), ("slice", pa.int32()), ("node", pa.binary()), ("comp", pa.binary()), ("query", pa.bool_()), ("asks", pa.bool_()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]
    )
    told = []
    for band in range(1, near_dedup.BANDS):
        a, b = ((n, n, c.astype(np.uint8).tobytes(), k) for n, c, k in ((b"a", x, keys[0]), (b"b", y, keys[1])))
        group = [(keys[0][band], band, 0, 0, *r[:2], q, asks, *r[2:]) for r, q, asks in ((a, True, True), (a, True, False), (b, False, False))]
        batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, g)) for g in group], schema=schema)
        told += [(band, r["node"], r["others"]) for out in near_dedup._crossed(iter([batch])) for r in out.to_pylist() if r["others"]]
    assert told == [(1, b"a", [b"b"])]


def test_exact_duplicates(spark, docs, none):
    out = rows(exact_dedup.exact_duplicates(spark, docs))
    assert len(out) == len(ROWS) and exact_dedup.exact_duplicates(spark, none).count() == 0
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in out:
        g = sha[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
    assert sum(r["kept"] for r in out) == len(groups)


def test_snapshot_screens_later_batches(spark, docs, none, tmp_path):
    path = str(tmp_path / "snapshot")
    old = [(i, f"text number {i % 40}") for i in range(90)] + [(500, None), (None, "nobody's")]
    exact_dedup.write_snapshot(spark, spark.createDataFrame(old, "doc_id long, text string"), path)
    new = [(1000 + i, f"text number {i}") for i in range(20, 60)] + [(2000, "text number 59"), (2001, ""), (None, "nobody's"), (None, "fresh"), (3, "fresh")]
    out = rows(exact_dedup.screen(spark, spark.createDataFrame(new, "doc_id long, text string"), path))
    assert len(out) == len(new) and exact_dedup.screen(spark, none, path).count() == 0
    held = {}
    for i, t in old:
        held[t or ""] = max(held.get(t or "", -1), -1 if i is None else i)
    for i, t in new:
        r = next(x for x in out if x["doc_id"] == i and x["text_sha256"] == hashlib.sha256(t.encode()).hexdigest())
        same = [j for j, u in new if u == t]
        assert r["in_snapshot"] == (t in held) and r["group_size"] == len(same) and r["keep_id"] == max((j for j in same if j is not None), default=None)
        assert (r["snapshot_id"] if r["snapshot_id"] is not None else -1) == held.get(t, -1)
    assert sum(r["kept"] for r in out) == len({t for _, t in new} - set(held))
    exact_dedup.write_snapshot(spark, none, str(tmp_path / "empty"))
    assert not any(r["in_snapshot"] for r in rows(exact_dedup.screen(spark, docs, str(tmp_path / "empty"))))


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    from basalt.llm import workspace

    monkeypatch.setattr(workspace, "HOT_ROWS", 50)
    left = spark.range(2000).selectExpr("case when id % 3 = 0 then 7 else id end as k", "id as v").repartition(4)
    right = left.groupBy("k").count().withColumn("w", F.col("count")).filter("k % 5 < 3")
    want = {(r.k, r.v, r["count"]) for r in left.join(right.drop("w"), "k", "left").collect()}
    assert {(r.k, r.v, r["count"]) for r in workspace.spread_join(left, right, ["k"], "w").collect()} == want
    inner = workspace.spread_join(left, right, ["k"], "w", "inner")
    assert {(r.k, r.v, r["count"]) for r in inner.collect()} == {x for x in want if x[2] is not None} and inner.columns == ["k", "v", "count"]


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 20_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
        assert f.holds(keys).all()
        if n > 50:
            assert f.holds(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    out = rows(packing.pack(spark, docs, path, ids_too=True))
    assert packing.pack(spark, none, path).count() == 0
    want = sorted(([*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in ROWS))
    pieces, got = {}, []
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        assert r["offset"] == pieces.get(r["sequence_id"], 0)
        pieces[r["sequence_id"]] = r["offset"] + r["length"]
        got = [*got[:-1], got[-1] + r["ids"]] if r["start"] else [*got, r["ids"]]
        assert r["sequence_length"] in (4096, r["sequence_tokens"])
    assert max(pieces.values()) <= 4096 and sorted(got) == want


def test_packing_of_several_blocks_and_one_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3000)
    data = [(7, "one short text. " * (i % 40)) for i in range(200)] + [(None, "a long one, without end " * 3000)] + [(8, "x " * 6000)]
    out = rows(packing.pack(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(2), packing.tokenizer_path(), ids_too=True))
    used, starts = {}, 0
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0) and len(r["ids"]) == r["length"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
        starts += r["start"] == 0
    assert max(used.values()) <= 4096 and starts == len(data) and len(used) > 5
    assert sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out if r["start"] == 0)


def test_units_straight_to_the_model():
    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    rng = np.random.default_rng(7)
    letters = [chr(c) for c in [*range(97, 123), *range(65, 91), *range(0xC0, 0x180), 0x3A3, 0x130, 0x212A, 0x301, 0xB5, 0xAA]]
    words = ["".join(rng.choice(letters[: int(rng.choice([26, 52, 120, len(letters)]))], int(rng.integers(1, 15)))) for _ in range(3000)] + ["12", "a1", "...", "<|endoftext|>", "İ", "e\u0301a", "\u3000x"]
    assert encoder.direct
    for some in (words, words[:1], words[-2:]):
        ids, first, size = encoder.encode(some)
        assert [ids[a : a + n].tolist() for a, n in zip(first, size)] == encoder.whole(some)
    encoder.direct = False
    ids, first, size = encoder.encode(words)
    assert [ids[a : a + n].tolist() for a, n in zip(first, size)] == encoder.whole(words)


def test_cut_points_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        ends = np.unique(rng.integers(1, 600, 25))
        pen = rng.integers(0, 30, ends.size).astype(float)
        cap, p = 128, [0, *ends.tolist()]
        if max(b - a for a, b in zip(p, p[1:])) > cap:
            continue

        def pad(n):
            return 0 if n & (n - 1) == 0 and n >= 1 << packing.LEAST_POWER else cap - n

        best = [0.0]
        for j in range(1, len(p)):
            best.append(min(best[i] + pad(p[j] - p[i]) for i in range(j) if p[j] - p[i] <= cap) + pen[j - 1])
        cuts = packing.cut_points(ends, pen, cap)
        cost = sum(pad(b - a) + pen[p.index(b) - 1] for a, b in zip([0, *cuts], cuts))
        assert cost == pytest.approx(best[-1])


def test_sharding(spark, docs, none):
    out = rows(sharding.shard(spark, docs, 4))
    assert len(out) == len(ROWS) and sharding.shard(spark, none).count() == 0
    assert sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 8 for _, t in ROWS)
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    hot = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the one text' else concat('text ', id * 7919 % 6000) end as text").repartition(4)
    size = {}
    for r in rows(sharding.shard(spark, hot, 8)):
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert len(size) == 8 and max(size.values()) / min(size.values()) < 1.02


def test_shards_by_brute_force(spark, docs, none, tmp_path):
    rng = np.random.default_rng(14)
    data = [(i, ["copy of a common text " * 3, f"text {i} " * int(rng.integers(1, 40)), f"pair {i // 2}"][i % 3]) for i in range(900)] + [(None, "x"), (None, "x"), (5, "again"), (5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    out = rows(sharding.shard(spark, df, 6))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in data)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in out) == want
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    size, groups, mass = {}, {}, {}
    for r in out:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        groups.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        mass[r["text_crc32"], r["size"]] = mass.get((r["text_crc32"], r["size"]), 0) + r["size"]
    largest = max(r["size"] for r in out)
    assert max(size.values()) - min(size.values()) <= 2 * largest
    assert all(len(s) == 1 for g, s in groups.items() if mass[g] <= largest)
    sharding.write_shards(spark, docs.withColumn("slot", F.lit("mine")), str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows(back)) == sorted((i or -1, t or "") for i, t in ROWS)
    sharding.write_shards(spark, none, str(tmp_path / "none"), 3)


def test_secret_scan(spark, docs, none):
    texts = ["password=hunter2222 x", 'API_KEY: "abcdefgh1234"', "secret=token: longvalue12", "é AKIA" + "Z9" * 8 + " token=short", "0123456789abcdef" * 3, "Xk29fQz81LmVw0RtYb73HsQe", "ordinary_identifier_of_the_account_manager", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    out = rows(secret_scan.scan(spark, df))
    assert len(out) == len(texts) + len(ROWS) and secret_scan.scan(spark, none).count() == 0
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for t in [*texts, *(t for _, t in ROWS)]:
        t = t or ""
        s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 8]
        s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        want.append(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s)))
    assert sorted(r["base"] for r in out) == sorted(want)
    random = {r["doc_id"]: r["n_random"] for r in out if r["n_random"]}
    assert random.get(5) == 1 and 6 not in random


def test_markov_ratio_by_brute_force_and_on_strings_not_learnt_from(spark):
    table = secret_scan.train(spark)
    k = len(secret_scan.STATES)
    state = lambda c: secret_scan.STATES.index("0" if c.isdigit() else c if c.isalpha() else "+")
    counts = [{}, {}]
    for s, y in secret_scan.labelled_samples():
        for a, b in zip(s, s[1:]):
            counts[y][state(a), state(b)] = counts[y].get((state(a), state(b)), 0) + 1
    out = [sum(counts[y].get((a, b), 0) + secret_scan.SMOOTH for b in range(k)) for y in (0, 1) for a in range(k)]
    chance = lambda y, a, b: (counts[y].get((a, b), 0) + secret_scan.SMOOTH) / out[y * k + a]
    ratio = lambda s: sum(np.log(chance(1, state(a), state(b)) / chance(0, state(a), state(b))) for a, b in zip(s, s[1:]))
    strings = [(s, y) for s, y in secret_scan.labelled_samples(99)[:3000] if len(s) >= 20]
    hand = ["=" * 25, "2024-01-31T12-00-00Z-build", "123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz", "https/www-wikipedia-org/wiki/Krakow", "Szczepanikiewiczowska"]
    hand += ["Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "Llanfairpwllgwyngyllgogerychwyrndrobwll", "a" * 24, "12345678901234567890"]
    strings += [(s, 0) for s in hand]
    df = spark.createDataFrame([(i, f"see {s} there") for i, (s, _) in enumerate(strings)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_random"] for r in rows(secret_scan.scan(spark, df, table))}
    for i, (s, _) in enumerate(strings):
        r = ratio(s)
        assert found[i] == int(r >= secret_scan.LEAST_RATIO and r >= secret_scan.LEAST_STEP * len(s) and len(set(s)) >= secret_scan.LEAST_DISTINCT), s
    caught = [found[i] for i, (_, y) in enumerate(strings) if y]
    false = [found[i] for i, (_, y) in enumerate(strings) if not y]
    assert np.mean(caught) > 0.99 and np.mean(false) < 0.005 and not any(false[-len(hand) :])


def test_language_id(spark, docs, none):
    en, fr = "the of and that with have this from they would there their".split(), "le la les des une dans pour que est avec sont nous".split()
    rng = np.random.default_rng(3)
    train = [(i, " ".join(rng.choice(v, 40)), n) for i, (v, n) in enumerate([(en, "en"), (fr, "fr")] * 60)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language_id.train(df)
    out = rows(language_id.identify(spark, df, model))
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98
    plain, logits = language_id.LENGTHS, model.logits

    def brute(t):
        z, n = np.zeros(len(model.langs)), 0
        for w in t.encode().lower().split():
            w = b"<" + w + b">"
            for k in language_id.GRAMS:
                for a in range(len(w) - k + 1):
                    h = k
                    for c in w[a : a + k]:
                        h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c * 0x9E3779B1 & 0xFFFFFFFF)
                    z, n = z + logits[(h ^ h >> 15) & (language_id.BUCKETS - 1)], n + 1
        e = np.exp((z / max(n, 1) + model.bias) / model.temperature)
        return e / e.sum()

    for r in [*out[:20], *(x for x in rows(language_id.identify(spark, docs.filter("length(text) < 500 and text like '%e%'"), model)))]:
        p = brute(r["text"])
        assert r["lang_pred"] == model.langs[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=1e-6)
        assert r["accepted"] == (p.max() >= model.thresholds[int(np.searchsorted(plain, len(r["text"].split())))])
    edge = rows(language_id.identify(spark, docs, model))
    assert len(edge) == len(ROWS) and all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in edge)
    assert all(0 <= r["score"] <= 1 for r in edge) and "kept" in edge[0]
    assert language_id.train(none) is None and language_id.identify(spark, none, model).count() == 0
    assert {r["lang_pred"] for r in rows(language_id.identify(spark, docs, None))} == {"und"}


def test_rejection_of_what_was_not_learnt(spark):
    rng = np.random.default_rng(31)
    words = {la: ["".join(rng.choice(list(letters), int(rng.integers(3, 8)))) for _ in range(400)] for la, letters in (("aa", "abdefilmnor"), ("bb", "aceghijkstu"), ("zz", "qwxyzvkpj"))}
    text = lambda la, n: " ".join(rng.choice(words[la], n))
    known = [(i, text(la, int(rng.integers(2, 80))), la) for i, la in enumerate(["aa", "bb"] * 200)]
    model = language_id.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    new = [(i, text(la, 60), la) for i, la in enumerate(["aa", "bb", "zz"] * 100)]
    out = rows(language_id.identify(spark, spark.createDataFrame(new, "doc_id long, text string, lang string"), model))
    share = {la: np.mean([r["accepted"] for r in out if r["lang"] == la]) for la in words}
    assert share["aa"] > 0.98 and share["bb"] > 0.98 and share["zz"] < 0.7, share


def test_scores_of_windows_by_brute_force(spark, docs):
    net = toxicity.Reader(3)
    w = {k: v.astype(float) for k, v in net.w.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def brute(text):
        codes = [x for x, _ in itertools.groupby((text or "").encode().lower().split())]
        best = []
        for a in range(0, max(1, len(codes) - toxicity.STRIDE), toxicity.STRIDE):
            x = net.embed(toxicity.word_inputs(codes[a : a + toxicity.WINDOW])).astype(float) if codes else np.zeros((0, 24))
            states = []
            for way, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
                s, made = np.zeros(toxicity.HIDDEN), {}
                for t in order:
                    i, g = x[t] @ w[f"in{way}"] + w[f"c{way}"], s @ w[f"u{way}"]
                    z, r, h = sig(i[:8] + g[:8]), sig(i[8:16] + g[8:16]), None
                    h = np.tanh(i[16:] + r * g[16:])
                    s = z * s + (1 - z) * h
                    made[t] = s
                states.append([made[t] for t in range(len(x))])
            both = np.array([np.concatenate(p) for p in zip(*states)]).reshape(-1, 16)
            att = np.exp(both @ w["att"])
            best.append(float((att / att.sum()) @ both @ w["out"] if len(x) else 0.0) + float(w["bias"][0]))
        return sig(max(best))

    texts = [r["text"] for r in rows(docs) if len(r["text"] or "") < 500] + [" ".join(f"w{i % 37}x{i % 11}" for i in range(n)) for n in (1, 63, 64, 65, 97, 300)]
    got = {r["doc_id"]: r["score"] for r in rows(toxicity.score(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net))}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute(t), abs=2e-5), t


def test_gradients_of_the_reader():
    net = toxicity.Reader(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words = [b"", b"one", b"two", b"three"]
    inputs, at = toxicity.word_inputs(words), np.array([[1, 2], [2, 3], [3, 0]])
    mask = np.array([[1, 1], [1, 1], [1, 0]], np.float64)
    run = lambda: net.forward(net.project(net.embed(inputs)), at, mask).sum()
    x = net.embed(inputs)
    _, saved = net.forward(net.project(x), at, mask, keep=True)
    grad = net.backward(np.ones(2), saved, x, at, mask, inputs)
    for k in ("att", "out", "uf", "ub", "inf", "cb"):
        i = (0,) * net.w[k].ndim
        net.w[k][i] += 1e-2
        up = run()
        net.w[k][i] -= 2e-2
        down = run()
        net.w[k][i] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(float(grad[k][i]), abs=2e-3), k


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(4)
    plain = [f"plain{i}" for i in range(60)]
    data = []
    for i in range(240):
        w = list(rng.choice(plain, int(rng.integers(10, 150))))
        if i % 3 == 0:
            w[int(rng.integers(len(w)))] = "nasty"
        data.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    net = toxicity.train(df, labels)
    out = {r["doc_id"]: r["score"] for r in rows(toxicity.score(spark, df, net))}
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.85
    edge = rows(toxicity.score(spark, docs, net))
    assert len(edge) == len(ROWS) and all(0 <= r["score"] <= 1 for r in edge) and toxicity.score(spark, none, net).count() == 0
    assert toxicity.train(none, labels) is not None


def test_windows_cover_every_word():
    first = np.cumsum([0, 0, 1, 64, 65, 96, 97, 500])
    text, start, size = toxicity.windows(first)
    for t in range(7):
        seen = {w for i in np.flatnonzero(text == t) for w in range(start[i], start[i] + size[i])}
        assert seen == set(range(first[t], first[t + 1]))


def test_decontamination(spark, docs, none):
    item = "In the old harbour the captain Miller counted 14 crates of 20 kg each and sold 3 of them to Baker for 90 dollars before the storm"
    other = "Take 12 apples and 30 pears then 12 plums and 30 figs then 12 nuts and 30 dates"
    again = item.replace("Miller", "Smith").replace("14", "77").replace("20", "5").replace("Baker", "Jones").replace("90", "41").replace(" 3 ", " 9 ")
    crossed, agreed = (other.replace("12", "{}").replace("30", "{}").format(*x) for x in ((5, 6, 7, 8, 9, 4), (5, 6, 5, 6, 5, 6)))
    bench = spark.createDataFrame([(1, item), (2, other), (3, "too short"), (4, None), (None, item)], "item_id long, text string")
    texts = ["Filler words. " + item + " and so on", again, crossed, "clean text about " + BASE, item.upper(), agreed]
    out = {r["doc_id"]: r["items"] for r in rows(decontamination.find_leaks(spark, spark.createDataFrame([(i + 100, t) for i, t in enumerate(texts)], "doc_id long, text string"), bench))}
    assert out == {100: [1], 101: [1], 102: [], 103: [], 104: [1], 105: [2]}
    assert decontamination.find_leaks(spark, none, bench).count() == 0
    edge = rows(decontamination.find_leaks(spark, docs, bench.limit(0)))
    assert len(edge) == len(ROWS) and not any(r["contaminated"] for r in edge)


def _leaks(spark, items, texts):
    frame = lambda x, id_: spark.createDataFrame(list(enumerate(x)), f"{id_} long, text string")
    return {r["doc_id"]: r["items"] for r in rows(decontamination.find_leaks(spark, frame(texts, "doc_id"), frame(items, "item_id")))}


def test_units_must_agree(spark):
    item = "Walk 12 km north then ride 9 km east then swim 4 km south then run 7 km west"
    texts = [item.replace(" km", " miles"), item.replace("12 km", "12 miles").replace("9 km", "9 hours").replace("4 km", "4 kg")]
    assert _leaks(spark, [item], texts) == {0: [0], 1: []}


def test_verbatim_copies_are_found_whatever_their_words(spark):
    items = ["What comes next: 3, 5, 9, 17, 33, 65, 129?", "Who wrote the Iliad and when?", "Along the wide river many old mills were built by the farmers of the valley", "yes"]
    texts = ["So. " + items[0] + " Well", "ask " + items[1] + " and so on", items[2].upper(), items[2].title(), "yes " + BASE, "What comes next: 4, 6, 9, 18, 34, 66, 130?", "Who wrote the Iliad"]
    assert _leaks(spark, items, texts) == {0: [0], 1: [1], 2: [2], 3: [2], 4: [], 5: [], 6: []}


def test_a_contradicting_slot_costs_its_windows_only(spark):
    item = "Along the wide river Orla many old mills were built by the farmers of the valley, and near Orla town a bridge of stone still stands today"
    sums = "A baker sells 14 loaves of rye bread in the morning and then 20 more of them later in the day before the shop is closed for the night"
    texts = [item.replace("near Orla", "near Vesta"), sums.replace("14", "6").replace("20", "6"), "nothing of this is here " + BASE]
    assert _leaks(spark, [item, sums], texts) == {0: [0], 1: [1], 2: []}


def test_line_dedup(spark, docs, none):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"u{k}q" if False else f"u{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in rng.integers(0, 17_000, n))
    data = [(i, f"{say(12)}\nAll rights reserved by owner number {i}\n{say(9)}\nThis very line is everywhere\nshort one") for i in range(12)]
    data += [(100 + i, data[0][1]) for i in range(8)]
    out = {r["doc_id"]: r for r in rows(line_dedup.drop_lines(spark, spark.createDataFrame(data, "doc_id long, text string")))}
    for i, t in data:
        lines = t.split("\n")
        assert out[i]["text"] == "\n".join([lines[0], lines[2], lines[4]]) and out[i]["n_dropped"] == 2 and out[i]["n_lines"] == 5
    edge = rows(line_dedup.drop_lines(spark, docs))
    assert sorted((r["text"] or "") for r in edge) == sorted((t or "") for _, t in ROWS) and line_dedup.drop_lines(spark, none).count() == 0
    copies = spark.createDataFrame([(i, "\n".join(say(10) for _ in range(1)) if i < 0 else data[0][1]) for i in range(30)], "doc_id long, text string")
    assert {r["n_dropped"] for r in rows(line_dedup.drop_lines(spark, copies))} == {0}


def _prose(rng, n):
    return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(n))


def _edited(rng, lines, rate):
    return "\n".join(" ".join(w if rng.random() > rate else _prose(rng, 1) for w in x.split()) for x in lines)


def _dropped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [n for _, n in sorted((r["doc_id"], r["n_dropped"]) for r in rows(line_dedup.drop_lines(spark, df)))]


def test_lines_shared_by_independent_texts_go(spark):
    rng = np.random.default_rng(8)
    for shared, own in ((1, 1), (4, 2), (8, 2)):
        for _ in range(3):
            lines = [_prose(rng, 10) for _ in range(shared)]
            texts = ["\n".join([*lines, *(_prose(rng, 10) for _ in range(own))]) for _ in range(100)]
            assert _dropped(spark, texts) == [shared] * 100
    base = [_prose(rng, int(rng.integers(5, 16))) for _ in range(12)]
    assert not any(_dropped(spark, [_edited(rng, base, 0.03) for _ in range(300)]))


def test_near_copies_leave_the_count_of_families(spark):
    rng = np.random.default_rng(9)
    notice, base = _prose(rng, 9), [_prose(rng, int(rng.integers(5, 16))) for _ in range(12)]
    alone = ["\n".join([*(_prose(rng, 10) for _ in range(5)), notice]) for _ in range(40)]
    assert _dropped(spark, alone + [_edited(rng, base, 0.03) + "\n" + notice for _ in range(600)]) == [1] * 640
    for n in (2, 4):
        passage, base = _prose(rng, 30), [_prose(rng, 25) for _ in range(8)]
        texts = ["\n".join([*(_prose(rng, 10) for _ in range(4)), passage]) for _ in range(n)]
        assert _dropped(spark, texts + [_edited(rng, base, 0.02) for _ in range(n)]) == [1] * n + [0] * n


def test_rows_of_numbers_stand_for_themselves(spark):
    rng = np.random.default_rng(10)
    texts = [f"{_prose(rng, 12)}\n{i} 7 {1900 + i} 3\n| {i} | {i * i} |\nPage {i} of {i + 9}\nAll rights reserved by owner number {i}\n1 2 3 4" for i in range(20)]
    assert _dropped(spark, texts) == [2] * 20


def test_templates_match_a_count_by_hand(spark):
    """Odd and even leaves, ties at exactly half, words that read like a field, and leaves with too few fixed words."""
    rng = np.random.default_rng(12)
    leaves = {}
    for leaf in range(40):
        base, n = _prose(rng, 8).split(), int(rng.integers(2, 9))
        base[5] = "<*>" if leaf % 4 == 0 else base[5]
        lines = {tuple(w if rng.random() > (0.1, 0.3, 0.5)[leaf % 3] else f"other{int(rng.integers(2))}" for w in base) for _ in range(n)}
        leaves[leaf] = sorted(lines)
    data = [(leaf, len(lines), 100 * leaf + i, list(x)) for leaf, lines in leaves.items() for i, x in enumerate(lines)]
    work = line_dedup.Workspace(spark)
    df = work.save(spark.createDataFrame(data, "leaf long, lines long, key long, tokens array<string>"))
    got, want = {(r["leaf"], r["key"]) for r in rows(line_dedup._templates(df, work))}, set()
    for leaf, n, key, tokens in data:
        shape = [([w for w in {x[i] for x in leaves[leaf]} if 2 * sum(x[i] == w for x in leaves[leaf]) > n] or ["<*>"])[0] for i in range(8)]
        words = sum(bool(re.fullmatch(r"[^0-9]*[a-z][^0-9]*", w)) for w in shape)
        if words >= line_dedup.FIXED * 8 and all(w in (x, "<*>") for w, x in zip(shape, tokens)):
            want.add((leaf, key))
    assert got == want and 0 < len(want) < len(data)


def test_lines_are_counted_by_bytes(spark):
    # going through a text character by character took most of the last stage
    texts = ["", "\n", "a\n\nb\n", "\u00e4\U0001f600\n\u2028\r\n\u6f22", None, "no end", "\n" * 500]
    out = line_dedup.drop_lines(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["n_lines"] for r in sorted(rows(out), key=lambda r: r["doc_id"])] == [0 if t is None else t.count("\n") + 1 for t in texts]
    assert "translate(" not in out._jdf.queryExecution().optimizedPlan().toString()


def brute_cost(roles):
    """Least cost over every choice of a label for each turn and of joining it to the turn before."""
    best = 1e9
    for labels in itertools.product("sua", repeat=len(roles)):
        other = sum(0 if r == x else 0.5 if r is None else 2 for r, x in zip(roles, labels))
        if other >= best:
            continue
        for joins in itertools.product((False, True), repeat=len(roles) - 1):
            if any(j and a != b for j, a, b in zip(joins, labels, labels[1:])):
                continue
            kept = [x for x, j in zip(labels, (False, *joins)) if not j]
            if "s" in kept[1:]:
                continue
            body = "".join(kept[kept[0] == "s" :])  # (ua)+ once an empty turn is put between equal neighbours, before a first a and after a last u
            empty = sum(x == y for x, y in zip(body, body[1:])) + (body[:1] == "a") + (body[-1:] == "u") + 2 * (not body)
            best = min(best, other + 0.75 * sum(joins) + 1.5 * empty)
    return best


LEGAL = re.compile(r"(?:<\|system\|>\n[^<]*<\|end\|>\n)?(?:<\|user\|>\n[^<]*<\|end\|>\n<\|assistant\|>\n[^<]*<\|end\|>\n)+")
LETTER = {"system": "s", "user": "u", "assistant": "a"}


def _chat_cost(group):
    total = 0.0
    for r in group:
        named = (r["role"] or "").strip().lower() in LETTER
        total += {"keep": 0, "relabel": 2 if named else 0.5, "merge": 0.75, "merge_relabel": 0.75 + (2 if named else 0.5)}[r["action"]]
        total += 1.5 * (len(r["inserted"]) + len(r["appended"]))
    return total


def _repaired(spark, data, parts=None):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string" + ", h string, place string, rid long" * (len(data[0]) > 4))
    out = sorted(rows(chat_format.repair(spark, df.repartition(parts) if parts else df)), key=lambda r: r["place"])
    assert chat_format.repair(spark, df.limit(0)).count() == 0
    convs = {}
    for r in out:
        convs.setdefault(r["conv_id"], []).append(r)
    return convs


def test_chat_format_has_the_least_cost(spark):
    rng = np.random.default_rng(6)
    names = ["system", "user", "assistant", "tool", None, " User "]
    data = [(c, t, names[int(rng.integers(6))], f"c{c}t{t}") for c in range(60) for t in range(int(rng.integers(1, 6)))]
    convs = _repaired(spark, data)
    assert len(convs) == 60 and sum(map(len, convs.values())) == len(data)
    for g in convs.values():
        whole = "".join(r["rendered"] for r in g)
        assert LEGAL.fullmatch(whole) and re.findall(r"c\d+t\d+", whole) == [f"c{r['conv_id']}t{r['turn']}" for r in g]
        assert _chat_cost(g) == brute_cost([LETTER.get((r["role"] or "").strip().lower()) for r in g])


def test_chat_format_over_partitions_and_segments(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "ROWS_PER_TASK", 100)
    data = [(77, t, ["user", "assistant", "user"][t % 3], f"long{t}") for t in range(900)]
    data += [(8, 5, "user", "same")] * 300  # repeated rows of one turn lie in several partitions
    convs = _repaired(spark, data)
    assert _chat_cost(convs[77]) == 299 * 0.75 + 1.5 and _chat_cost(convs[8]) == 298 * 0.75 + 2
    for c in (77, 8):
        assert LEGAL.fullmatch("".join(r["rendered"] for r in convs[c]))
    assert [r["turn"] for r in convs[77]] == list(range(900))


def test_chat_format_of_nulls_and_large_ids(spark):
    big = 1152921504606846977
    data = [(big, 0, "user", "a", "x", "y", 1), (big, 1, "assistant", "b", "x", "y", 1), (None, 1, "user", "x", None, "", 2), (None, None, None, None, "", "", 3)]
    data += [(big + 1, t, "user", None, "x", "y", 1) for t in (None, 2**62, 2**62 + 1)] + [(5, 0, "assistant", "z" * 200_000, "", "", 4)]
    convs = _repaired(spark, data, 3)
    assert set(convs) == {big, big + 1, None, 5}
    assert [(r["turn"], r["action"], r["inserted"], r["appended"]) for r in convs[big]] == [(0, "keep", [], []), (1, "keep", [], [])]
    assert [r["turn"] for r in convs[big + 1]] == [None, 2**62, 2**62 + 1] and len(convs[None]) == 2
    assert all(LEGAL.fullmatch("".join(r["rendered"] for r in g)) for g in convs.values())


def test_idle_workers_free_their_caches(monkeypatch):
    """Caches that hold their own methods go at once, both when another operator's begin and when a worker has had no work for a while."""
    import time
    import weakref

    class Cache:
        def __init__(self):
            self.memo = textkit.WordMemo(self.learn)

        def learn(self, new):
            pass

    monkeypatch.setattr(textkit, "IDLE_S", 0.2)
    first = weakref.ref(textkit.kept("first", Cache))
    second = weakref.ref(textkit.kept("second", Cache))
    assert first() is None and second() is not None
    list(textkit.tidy(lambda batches: batches)([1, 2]))
    assert second() is textkit.kept("second", Cache)  # work went on, so it stays
    time.sleep(0.4)
    assert second() is not None
    list(textkit.tidy(lambda batches: batches)([1, 2]))
    time.sleep(1.0)
    assert second() is None and not textkit._kept
