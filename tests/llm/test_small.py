"""Each operator on hard rows, and against a brute-force version."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import chat, dedup, fingerprint, html, jaccard, langid, packing, quality, sentencepiece, sharding
from meshwork.llm.components import components
from meshwork.llm.hashgrams import blocks, char_grams
from meshwork.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# exact dedup


@pytest.mark.parametrize("digest", [dedup.sha256_hex, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_dedup(docs, digest):
    """With a digest of one digit, texts that share it stay apart."""
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in dedup.duplicate_groups(docs, digest=digest).collect())
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((i, max(g), len(g), i == max(g)) for g in groups.values() for i in g)
    assert got == want


def test_deduplicate_keeps_one(docs, empty):
    out = dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 4, 5, 6, 7, 8, 9, 10]
    assert dedup.deduplicate(empty).count() == 0 and dedup.duplicate_groups(empty).count() == 0


# sharding


def test_sharding(spark, docs, empty, tmp_path):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"))
    store = str(tmp_path / "m")
    placed, slots = sharding.assign(many, 24, store)
    rows = placed.collect()
    assert len(rows) == 3000
    load = Counter()
    for r in rows:
        assert r["size"] == 2 * (r["doc_id"] % 50) + 8 and r["text_crc32"] == zlib.crc32(("é" * (r["doc_id"] % 50)).encode())
        load[r["shard"]] += r["size"]
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 8
    for shard in range(24):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert slots.version == 2 and sharding.SlotMap.load(spark, store) == slots
    assert sharding.assign(many, 24, store)[1] == slots  # balanced already: no new version
    again, moved = sharding.assign(many.filter("doc_id % 3 > 0"), 24, store)
    assert moved.version == 3 and sharding.SlotMap.load(spark, store) == moved
    kept = sum(a == b for a, b in zip(slots.owner, moved.owner, strict=True))
    assert kept > 0.5 * sharding.SLOTS  # edited, not made anew
    load = [r[1] for r in again.groupBy("shard").agg(F.sum("size")).collect()]
    assert max(load) - min(load) <= 8
    grown = slots.grow([1] * sharding.SLOTS)
    assert all(b in (a, 24) for a, b in zip(slots.owner, grown.owner, strict=True)) and 24 in grown.owner
    hard = sharding.assign(docs, 3, str(tmp_path / "h"))[0].collect()
    assert len(hard) == 11 and sharding.assign(empty, 3, str(tmp_path / "e"))[0].count() == 0
    one_id = spark.range(2000).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert sharding.assign(one_id, 4, str(tmp_path / "o"))[0].select("virtual_slot").distinct().count() > 1000


def test_unfinished_versions_are_written_over(spark, tmp_path):
    """What a driver lost within a write leaves behind: an empty folder, a version without rows, one that isn't whole."""
    docs = spark.createDataFrame([(k, "x" * k) for k in range(40)], "doc_id long, text string")
    for name, left in (("a", ["version=1/_temporary/0"]), ("b", ["."]), ("c", ["version=1", "version=2/_temporary"])):
        store = str(tmp_path / name)
        for folder in left:
            (tmp_path / name / folder).mkdir(parents=True)
        if name == "c":
            whole = sharding.SlotMap.fresh(4, 16)
            rows = spark.createDataFrame([(16, 4, k, s) for k, s in enumerate(whole.owner[:7])], "slots int, shards int, virtual_slot int, shard int")
            rows.write.mode("overwrite").parquet(f"{store}/version=1")
        assert sharding.SlotMap.load(spark, store) is None
        placed, stored = sharding.assign(docs, 4, store, slots=16)
        assert placed.count() == 40 and sharding.SlotMap.load(spark, store) == stored and sharding.SlotMap.versions(spark, store) == [1, 2]
        with pytest.raises(ValueError):
            stored.save(spark, store)


# fingerprints


def test_fingerprints(docs, empty):
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(None, "tail of the list"), (None, "zz")], "doc_id long, text string"))
    got = fingerprint.fingerprints(more).collect()
    order = sorted(rows_of(more), key=lambda r: (r[0] is None, -(r[0] or 0), zlib.crc32((r[1] or "").encode())))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    by = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=by) == sorted(want, key=by)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = defaultdict(set)
    for r in got:
        prints[r["doc_id"]].add(r["fingerprint"])
    assert len(prints[5]) == 1 and prints[1] == prints[2] and prints[3] == {""}
    assert fingerprint.fingerprints(empty).count() == 0


def test_repeated_rows_are_followed_by_their_like(spark, monkeypatch):
    """Small and large groups of equal rows: all but the last are followed by an equal one."""
    monkeypatch.setattr(fingerprint, "COPIES", 4)
    texts = {7: "one two three four five six seven eight nine", 5: "ten eleven twelve thirteen fourteen fifteen sixteen", 3: "x"}
    counts = {7: 3, 5: 23, 3: 1}
    rows = [(i, texts[i]) for i, n in counts.items() for _ in range(n)]
    got = Counter((r["doc_id"], r["next_id"], r["edited_sha256"], r["near_next"] == 1) for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    order = [i for i, n in counts.items() for _ in range(n)]
    for k, i in enumerate(order):
        t, j = texts[i], order[(k + 1) % len(order)]
        q = len(t) // 3
        want[i, j, hashlib.sha256((t[: len(t) - q] + texts[j][:q]).encode()).hexdigest(), i == j] += 1
    assert got == want


def plain_sketch(text):
    """The sketch said plainly: 64-bit hashes of words, chained over five of them, their upper halves below the fraction."""
    import struct

    import xxhash

    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))]
    found = set()
    for run in [words[k : k + 5] for k in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []:
        h = 42
        for w in run:
            h = xxhash.xxh64(struct.pack("<Q", w), seed=h).intdigest()
        found.add(h >> 32)
    return {h for h in found if h < 2**32 // fingerprint.KEEP} or set(sorted(found)[:1])


def test_fingerprints_equal_plain_sketches(docs):
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(20 + k, " ".join(f"w{j % (40 + k)}" for j in range(200 - 9 * k))) for k in range(8)], "doc_id long, text string"))
    texts = dict(rows_of(more))
    order = sorted(texts, reverse=True)
    shared = lambda a, b: (len(a & b) / len(a) if a else float(not b)) if len(a) <= len(b) else shared(b, a)
    for r in fingerprint.fingerprints(more).collect():
        i, t = r["doc_id"], texts[r["doc_id"]] or ""
        after = texts[r["next_id"]] or ""
        q = len(t) // 3
        own, edited, then = plain_sketch(t), plain_sketch(t[: len(t) - q] + after[:q]), plain_sketch(after)
        assert r["fingerprint"] == "".join(f"{h:08x}" for h in sorted(own)) and r["edited_fingerprint"] == "".join(f"{h:08x}" for h in sorted(edited))
        assert r["near_edited"] == pytest.approx(shared(own, edited)) and r["near_next"] == pytest.approx(shared(own, then))
        assert r["next_id"] in (i, order[(order.index(i) + 1) % len(order)])


def test_sketch_estimates_containment(spark):
    words = [f"w{k}" for k in range(3000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:300]), " ".join(words[:1500] + [f"x{k}" for k in range(1500)]))], "a string, b string, c string")
    a, b, c = (fingerprint.sketch(F.col(x)) for x in "abc")
    row = df.select(fingerprint.contained(b, a).alias("ba"), fingerprint.contained(a, b).alias("ab"), fingerprint.likeness(a, c).alias("ac"), (fingerprint.merged(a, a) == a).alias("same")).first()
    assert row["ba"] == 1 and row["ab"] == pytest.approx(0.1, abs=0.03) and row["ac"] == pytest.approx(0.5, abs=0.07) and row["same"]


# language and quality


def test_language(spark, docs, empty):
    table = [(k, f"the {w} and of the house {k}", "en") for k, w in enumerate("abcdefgh" * 5)] + [(100 + k, f"der {w} und die das haus ist nicht {k}", "de") for k, w in enumerate("abcdefgh" * 5)]
    known = spark.createDataFrame(table, "doc_id long, text string, lang string")
    model = langid.fit(known, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert got[3]["lang_pred"] == got[9]["lang_pred"] == got[4]["lang_pred"] == "und" and got[3]["score"] == 0
    assert got[6]["lang_pred"] == "de"
    held = langid.identify(known, model).join(known, "doc_id").filter("doc_id % 4 = 2")
    assert held.filter("lang = lang_pred").count() == held.count()
    assert langid.identify(empty, model).count() == 0
    assert langid.accept(docs, model).columns == docs.columns
    none = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_quality(spark, docs, empty):
    texts = [(k, f"a quiet walk by the river with friend {k}" if k % 2 else f"BUY!!! NOW!!! {k} CHEAP!!! PILLS!!!", k % 2) for k in range(200)]
    known = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    labels = known.select("doc_id", "quality")
    model = quality.fit(known.drop("quality"), labels, F.col("doc_id") % 3 != 1)
    got = quality.score(known, model).join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    assert all((r["score"] >= 0.5) == bool(r["quality"]) for r in got)
    hard = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert hard[3] == hard[4] and 0 <= hard[3] <= 1 and hard[1] is not None
    assert quality.score(empty, model).count() == 0 and quality.accept(docs, model).columns == docs.columns
    assert quality.fit(docs, labels.limit(0), F.lit(True)).score(["x"])[0] == 0.5


def test_samples_never_run_dry(spark):
    """A tiny share of many rows picks about as many as asked for; labels that clash count as the smallest."""
    from meshwork.llm.common import picked

    rows = spark.range(1 << 22)
    assert 5 <= rows.filter(picked(40 / (1 << 22), "id")).count() <= 120
    assert spark.range(10).filter(picked(1.0, "id")).count() == 10
    texts = spark.createDataFrame([(k, "good calm words" if k % 2 else "BAD!!! WORDS!!!") for k in range(60)], "doc_id long, text string")
    labels = texts.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    twice = labels.union(labels.withColumn("quality", F.lit(1)))
    same = quality.fit(texts, twice, F.lit(True))
    assert np.array_equal(same.margin, quality.fit(texts.union(texts), labels, F.lit(True)).margin)


def test_language_counts_equal_plain_ones(spark):
    """The model's log-probabilities from plain counts of the same hashed n-grams."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("abc abd", "x"), ("bcd", "y"), ("ABC", "x"), ("", "y"), (None, "x"), ("zz", None)])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    plain = {"x": Counter(), "y": Counter()}
    for _, t, lang in rows:
        if t is not None and lang:
            for order in langid.ORDERS:
                for k in range(len(t) - order + 1):
                    (codes, _, live), = blocks([t.lower()[k : k + order]], 0)
                    plain[lang][int(char_grams(codes, live, order, langid.BITS)[1][0])] += 1
    assert model.languages == ("x", "y")
    for i, lang in enumerate(model.languages):
        total = sum(plain[lang].values()) + 0.5 * (1 << langid.BITS)
        want = np.log((np.array([plain[lang][b] for b in range(1 << langid.BITS)]) + 0.5) / total)
        assert np.allclose(model.log_prob[:, i], want, atol=1e-5)


def test_training_step_equals_dense_gradients():
    """One step of gradient descent against dense matrices."""
    ids, n = np.array([1, 5, 9]), np.array([2.0, 1.0, 1.0])
    got = quality.train([(ids, n, 1)], epochs=1)
    rng = np.random.default_rng(quality.SEED)
    table = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM))
    x = np.zeros(1 << quality.BITS)
    x[ids] = n / n.sum()
    error = np.array([0.5, -0.5])  # of two equal outputs, label 1
    layer = -quality.RATE * np.outer(x @ table, error)
    assert np.allclose(got.margin, table @ (layer[:, 1] - layer[:, 0]), atol=1e-6)  # the layer starts at nought, so the table stays
    assert got.bias == pytest.approx(quality.RATE * 0.1)


def test_blocks_cover_long_texts(monkeypatch):
    import meshwork.llm.hashgrams as h

    text = "abcdefghij" * 7
    whole = np.sort(np.concatenate([char_grams(c, live, 3, 20)[1] for c, _, live in blocks([text], 2)]))
    monkeypatch.setattr(h, "BLOCK", 16)
    parts = np.sort(np.concatenate([char_grams(c, live, 3, 20)[1] for c, _, live in blocks([text], 2)]))
    assert (whole == parts).all()


@pytest.mark.parametrize("block", [1, 2, 7, 16, 1 << 18])
def test_scores_do_not_know_blocks(monkeypatch, block):
    """Words, pairs and n-grams of texts, whatever the block's size, against plain ones."""
    import meshwork.llm.hashgrams as h

    texts = ["extraordinary words  over\u00a0borders", "", "x", None, " a bb a bb ", "\n" * 9 + "end", "longword" * 9, "é ü " * 5, "in a line"]
    words = [[k, w] for k, t in enumerate(texts) for w in re.split("[\x00-\x20\xa0\u3000]+", t or "") if w]
    one = {}
    for _, w in words:
        (codes, owner, live), = blocks([w], 2)
        reader = h.Words()
        one[w] = int(np.concatenate([reader.take(codes, owner, live)[1], reader.rest()[1]])[0])
    want = Counter((k, one[w] >> 64 - quality.BITS) for k, w in words)
    want.update((k, (one[v] ^ one[w]) >> 64 - quality.BITS) for (k, v), (m, w) in zip(words, words[1:], strict=False) if k == m)
    for k, t in enumerate(texts):
        for order in quality.ORDERS:
            for i in range(len(t or "") - order + 1):
                (codes, _, live), = blocks([t[i : i + order]], 0)
                want[k, int(char_grams(codes, live, order, quality.BITS)[1][0])] += 1
    monkeypatch.setattr(h, "BLOCK", block)
    got = Counter()
    for owner, x in quality.features(texts):
        got.update(zip(owner.tolist(), x.tolist(), strict=True))
    assert got == want and len(one) == len(set(one.values()))


def test_language_counts_all_of_long_texts():
    """The prediction is naive Bayes', even where the score counts fewer n-grams."""
    rng = np.random.default_rng(1)
    log_prob = np.log(rng.dirichlet(np.ones(1 << langid.BITS), 2).T).astype(np.float32)
    model = langid.LanguageModel(("x", "y"), log_prob, np.log(np.array([1e-30, 1.0])))
    text = "some words of a text that goes on " * 300
    total = np.zeros(2)
    for order in langid.ORDERS:
        for codes, _, live in blocks([text], 2):
            total += log_prob[char_grams(codes, live, order, langid.BITS)[1]].sum(axis=0, dtype=np.float64)
    (named,), (score,) = model.score([text])
    assert named == model.languages[int((total + model.log_prior).argmax())] and 0 <= score <= 1
    assert langid.LanguageModel(("x", "y"), log_prob[:, ::-1], model.log_prior).score([text])[0][0] == model.languages[int((total[::-1] + model.log_prior).argmax())]


# Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("held", [8, 512])
def test_jaccard_families(spark, monkeypatch, held):
    """Families of many more members than a small bucket, about the threshold, in one part of a hub or in several."""
    monkeypatch.setattr(jaccard, "HELD", held)
    rng = np.random.default_rng(3)
    rows = []
    for f in range(3):
        base = [f"b{f}w{k}" for k in range(40 + 60 * f)]
        for k in range(70):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = f"x{rng.integers(10**6)}"
            rows.append((1000 * f + k, " ".join(w)))
    rows += [(5000 + k, " ".join(rng.choice(["a", "B", "c"], rng.integers(0, 9)))) for k in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_hard_rows(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs).collect()}
    assert got == brute_components(rows_of(docs))
    assert jaccard.near_groups(docs).count() == docs.count()
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns and 2 not in {r["doc_id"] for r in out.collect()}
    assert jaccard.near_groups(empty).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}


# packing


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    pieces = packing.tokenize(docs, path)
    got = packing.pack(pieces).collect()
    want = Counter()
    for i, t in rows_of(docs):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    laid = defaultdict(list)
    for r in got:
        laid[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in laid.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.tokenize(empty, path)).count() == 0


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.CachedEncoder(path, 1)
    for t in ("I'm she'll\tgo  Ünï²½ cöop", "<|endoftext|>x", "北京 a\u0085b", "İΣ ΑΣ. 12345 --!!", "a\x1cb", "ſŸ İ ªº ¼ x_y", ""):
        assert np.frombuffer(own(t), "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


def test_sum_of_squares_wastes_little():
    sizes = np.sort(np.random.default_rng(0).integers(1, 3000, 5000))[::-1]
    where, offset, bins = packing.sum_of_squares(sizes)
    assert np.bincount(where, weights=sizes).max() <= 4096
    assert bins <= 1.02 * -(-sizes.sum() // 4096)


def test_many_pieces_take_two_rounds(spark):
    pieces = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(4096)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    got = packing.pack(pieces).collect()
    load, total = Counter(), sum(r["length"] for r in pieces.collect())
    lengths = {r["doc_id"]: r["length"] for r in pieces.collect()}
    for r in got:
        load[r["sequence_id"]] += lengths[r["doc_id"]]
    assert len(got) == 6000 and max(load.values()) <= 4096 and len(load) <= 1.08 * total / 4096


# SentencePiece


def test_sentencepiece(docs, empty):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    library, own = SentencePieceProcessor(model_file=path), sentencepiece.PieceModel(path)
    rng = np.random.default_rng(1)
    texts = ["", " ", "  a  b ", "a" * 300, "\t\tdef f(x):\n    return 1", "日本語 😀\n\n", *("".join(rng.choice(list("theonigr "), 300)) for _ in range(20))]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t)
        assert own.decode(ids) == t
    coded = sentencepiece.encode(docs, path, digest=True)
    for r in coded.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["ids"] == library.encode(r["text"] or "") and r["round_trip"]
    assert {(r["doc_id"], r["text"]) for r in sentencepiece.decode(coded, path).collect()} == {(i, t or "") for i, t in rows_of(docs)}
    assert sentencepiece.encode(empty, path).count() == 0


def test_word_search_is_cheap(monkeypatch):
    """Pairs are decided without merging them anew, and marks behind a word don't make it another one to search."""
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    library, model = SentencePieceProcessor(model_file=path), sentencepiece.PieceModel(path)
    merges, searched = [], []
    merged, viterbi = model.merged, model.viterbi
    monkeypatch.setattr(model, "merged", lambda *a: merges.append(a) or merged(*a))
    monkeypatch.setattr(model, "viterbi", lambda t: searched.append(t) or viterbi(t))
    text = " ".join(w + end for w in ("undestation", "zeichnerei") for end in (".", "!!", ",", ".\nYes", "$$$", "–"))
    assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text)
    assert merges == [] and len(searched) == len(set(searched)) == 9, searched
    assert sentencepiece.alphabets(["de", "ab", "x", "cb"]) == [set("abc"), set("de"), {"x"}]


def test_pairs_stay_as_merging_leaves_them():
    """Against merging itself: likely pairs, blanks (whose merges don't rise in rank), and unknown characters; texts of all these against the library."""
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    library, model = SentencePieceProcessor(model_file=path), sentencepiece.PieceModel(path)
    rng = np.random.default_rng(2)
    pieces = [*sorted(model.after), *"abte▁ é日😀"]
    blanks = ["▁" * k for k in range(1, 17) if model.merged("▁" * k) == ["▁" * k]]
    pairs = [(pieces[a], pieces[b]) for a, b in rng.integers(len(pieces), size=(20_000, 2))]
    pairs += [(p[:k], p[k:]) for p in pieces[::7] for k in range(1, len(p))]
    pairs += [(a, b) for a in blanks for b in blanks]
    known = {*pieces, *blanks}
    for a, b in (x for x in pairs if known.issuperset(x)):
        assert model.stay(a, b) == (model.merged(a + b) == [a, b]), (a, b)
    signs = [*"aeinrst ETN.,\n\t_-é1▁", "  ", "      ", "ж", "Ж", "日", "😀", "\u0301", "ing", "ation", "();"]
    for _ in range(300):
        text = "".join(rng.choice(signs, int(rng.integers(1, 120))))
        assert np.frombuffer(model.encode(text), "<u4").tolist() == library.encode(text), text


def test_viterbi_commits_early():
    """A long word gives its first pieces before its end is read."""
    model = sentencepiece.PieceModel(tokenizer_path("piece_bpe_32k.model"))

    class Watched(str):
        seen = 0

        def __getitem__(self, k):
            Watched.seen = max(Watched.seen, k.stop if isinstance(k, slice) else k)
            return str.__getitem__(self, k)

    walk = model.viterbi(Watched("the" * 4000))
    next(walk)
    assert Watched.seen < 200


def test_models_encoded_otherwise_are_refused(tmp_path):
    """Messages may be appended to: each addition turns the public model into one of another kind."""
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    assert sentencepiece.unlike(model) == []
    for added, what in ((b"\x12\x02\x18\x01", "not a BPE model"), (b"\x0a\x02\x18\x04", "user-defined pieces"), (b"\x0a\x02\x18\x05", "unused pieces"), (b"\x1a\x02\x20\x01", "blanks removed"), (b"\x1a\x03\x12\x01x", "a table of characters")):
        assert sentencepiece.unlike(model + added) == [what]
        (tmp_path / "m.model").write_bytes(model + added)
        with pytest.raises(ValueError, match=what):
            sentencepiece.PieceModel(str(tmp_path / "m.model"))


# pages


def page(title, body, extra=""):
    return f'<html><head><title>{title}</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><header>Site</header>{extra}{body}<div class="comments"><p>Nice!</p></div><aside>More</aside><form><input>Go</form><footer>End</footer></body></html>'


def test_pages(spark):
    rows = [
        (1, "http://a.org/1", page("T", "<article><h1>One&amp;</h1><p>First <b>bo</b>ld&nbsp;text.<p>Second\n line</article>")),
        (2, "http://a.org/2", page("T", "<article><h1>Two</h1><p>Third</p><ul><li>x<li>y</ul></article>", '<div class="ad">Buy</div>')),
        (3, "http://b.org/1", page("T", "<div class='wrap'><p>Varies one</p></div><div><p>Same</p></div>")),
        (4, "http://b.org/2", page("T", "<div class='wrap'><p>Varies two</p></div><div><p>Same</p></div>")),
        (5, "http://b.org/3", page("T", "<div class='wrap'><p>Varies three</p></div><div><p>Same</p></div>")),
        (6, None, None),
        (7, "nonsense", "plain words <b>only"),
        (8, "http://a.org/1", "<article><p>cut off"),
    ]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {1: "One& First bold text. Second line", 2: "Two Third x y", 3: "Varies one", 4: "Varies two", 5: "Varies three", 6: "", 7: "plain words only", 8: "cut off"}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_wrapper_folds_and_aligns():
    a, b = (html.expression(f"<ul>{'<li>x</li>' * n}</ul><p>{t}</p>") for n, t in ((1, "a"), (5, "b")))
    w = html.align(a, b)
    ul, p = w
    assert ul[0] == "ul" and len(ul[5]) == 1 and ul[5][0][1] & 2
    assert p[5][0][4] is None and ul[5][0][5][0][4] == "x"


def host_texts(*pages):
    """Each page's main text under the wrapper of all pages, as one host."""
    whole = None
    for p in pages:
        own = html.expression(p)
        whole = own if whole is None else html.align(whole, own)
    known = html.slots(whole, len(pages))
    return [html.extract(p, known) for p in pages]


def test_wrapper_decides_within_articles():
    pages = [f"<article><h1>Title {n}</h1><p>Story {n}</p><div class=offer>Try our app</div><p>Ending {n}</p></article>" for n in "abcd"]
    assert host_texts(*pages) == [f"Title {n} Story {n} Ending {n}" for n in "abcd"]
    assert host_texts(*pages[:1] * 4) == ["Title a Story a Try our app Ending a"] * 4  # copies tell nothing


def test_slots_are_places():
    """Two slots with the same labels above them: the first is fixed, the second varies."""
    pages = [f"<body><p>Welcome</p><div>News {n}</div><p>Told {n}</p></body>" for n in "abcd"]
    assert host_texts(*pages) == [f"News {n} Told {n}" for n in "abcd"]
    lacking = "<body><div>News e</div><p>Told e</p></body>"
    assert host_texts(*pages, lacking)[-1] == "News e Told e"


def test_links_of_kept_blocks_stay():
    """Outside of articles a block goes only if hardly any of its characters are outside of links."""
    assert host_texts("<div class=content><p>See <a>the annual report</a> for more</p></div>") == ["See the annual report for more"]
    menu = "<div><a>One page</a> | <a>Another</a></div><ul><li><a>Third {n}</a></ul>"
    pages = [f"<body>{menu.format(n=n)}<p>By <a>them</a>: news of {n}</p></body>" for n in "abcd"]
    assert host_texts(*pages) == [f"By them: news of {n}" for n in "abcd"]


def test_long_fixed_texts_go():
    notice = "All rights are reserved and so on. " * 10
    assert host_texts(*[f"<body><div>{notice}</div><p>Story {n}</p></body>" for n in "abcd"]) == [f"Story {n}" for n in "abcd"]
    assert host_texts(*[f"<body><div>{notice}{n}</div></body>" for n in "abcd"]) == [f"{notice}{n}" for n in "abcd"]


def test_labels_keep_all_words():
    utility = "aa bb cc dd ee ff gg hh ii"
    assert host_texts(f"<div class='{utility} sidebar'>Side</div><div class='{utility} main'><p>Story</p></div><p>Other</p>") == ["Story"]


def test_wide_elements_align_exactly():
    """Of 100 neighbours with unlike labels and two with the same, each keeps its own slot."""
    pages = ["<body>" + "".join(f"<div class=c{chr(97 + k // 10)}{chr(97 + k % 10)}>{k} {n}</div>" for k in range(100) if k % 7 != ord(n) - 97) + f"<p>Fixed</p><hr><div class=z>z {n}</div><p>Story {n}</p></body>" for n in "abcd"]
    for text, n in zip(host_texts(*pages), "abcd", strict=True):
        assert "Fixed" not in text and text.endswith(f"z {n} Story {n}")


@pytest.mark.parametrize("bits", [0, 50, 1 << 26])
def test_common_is_longest(monkeypatch, bits):
    monkeypatch.setattr(html, "TABLE_BITS", bits)
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (["pqrst"[k] for k in rng.integers(0, 5, rng.integers(0, 40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))


def test_inline_words_of_articles_stay():
    body = "<article><header><h1>Title {n}</h1></header><p>A <span class=search>search</span> of {n}</p><div class=share>Share {n}</div></article>"
    assert host_texts(*[body.format(n=n) for n in "abcd"]) == [f"Title {n} A search of {n}" for n in "abcd"]


def test_deep_and_long_pages(spark, empty):
    """Elements nested 10,000 deep, a page of many megabytes, repeated rows and columns with the operator's own names."""
    deep = "<div>" * 10_000 + "<p>In the depth {n}"
    wide = "<body><p>" + "long <b>text</b> " * 200_000 + "{n}</p></body>"
    rows = [(k, "http://d.org/", deep.format(n=k), "x", "y") for k in range(3)] + [(k, "http://w.org/", wide.format(n=k), "x", "y") for k in (3, 4, 4)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string, slots string")).collect()}
    assert [got[k] for k in range(3)] == [f"In the depth {k}" for k in range(3)]
    assert got[3] == "long text " * 200_000 + "3" and len(got) == 5
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_written_wrappers_are_read():
    html.deep()
    w = html.expression("<p>a<ul><li>x<li>y</ul><div><div>z</div></div>" + "<i>" * 3000 + "t")
    assert html.read(html.written(w)) == w
    kinds = html.slots(w, 1)
    assert html.read(html.written(kinds)) == kinds


def test_positions_repeat_groups():
    wrapper = [["h", 2, []], ["p", 2, []], ["hr", 0, []], ["p", 1, []], ["i", 0, []]]
    assert html.positions(wrapper, ["h", "p", "h", "p", "hr", "i"]) == [0, 1, 0, 1, 2, 4]
    assert html.positions(wrapper, ["h", "p", "hr", "p", "x", "i"]) == [0, 1, 2, 3, -1, 4]


    ring = [["h", 2, []], ["p", 2, []], ["ul", 3, []], ["hr", 0, []], ["p", 1, []]]
    assert html.positions(ring, ["p", "h", "p", "h", "p", "ul", "p", "hr", "p"]) == [1, 0, 1, 0, 1, 2, 1, 3, 4]
    assert html.positions([["div", 1, []], ["hr", 1, []], ["div", 0, []]], ["div"]) == [2]  # what all pages have goes first


def test_groups_of_any_size_repeat():
    assert html.units([]) == []
    rng = np.random.default_rng(5)
    for size in range(1, 9):
        group = [f"e{k}" for k in range(size)]
        assert html.units(["a", *group * 4, "z"]) == [0, *[1 + k for k in range(size)] * 4, size + 1]
    for _ in range(300):
        labels = ["pqr"[k] for k in rng.integers(0, 3, rng.integers(0, 30))]
        place = html.units(labels)
        firsts = [place.index(k) for k in range(max(place, default=-1) + 1)]
        folded = [labels[k] for k in firsts]
        assert firsts == sorted(firsts) and [folded[k] for k in place] == labels  # a repeat takes the place of its like
        assert all(x != y for x, y in zip(folded, folded[1:], strict=False))
    card = "<h3>Name {n}</h3><p>Text {n}</p><hr><ul><li>Item {n}</ul><blockquote>Said {n}</blockquote>"
    w = html.expression("<body>" + "".join(card.format(n=n) for n in "abcde") + "</body>")
    assert [x[0] for x in w[0][5]] == ["h3", "p", "ul", "blockquote"] and all(x[1] & 2 for x in w[0][5])


def test_many_mixed_siblings_take_little_time():
    rng = np.random.default_rng(7)
    tags = ["p", "h2", "ul", "div", "pre"]
    pages = ["<article>" + "".join(f"<{t}>{t} {k} {n}</{t}>" for k, t in enumerate(tags[x] for x in rng.integers(0, 5, 20_000))) + "</article>" for n in "ab"]
    began = time.process_time()
    texts = host_texts(*pages)
    assert time.process_time() - began < 20
    for page, text in zip(pages, texts, strict=True):
        assert text == " ".join(re.sub("<[^>]*>", " ", page).split())


def test_headings_of_articles_stay():
    """A heading that all pages share stays over what varies, and whatever its class."""
    body = "<article><h1>On {n}</h1><p>Text of {n}</p><h2 class=related>Related work</h2><p>Work of {n}</p><h2>Sources</h2><h3>Books</h3><ul><li>Book {n}</ul><h3>Share this page</h3><p>With your friends</p></article>"
    assert host_texts(*[body.format(n=n) for n in "abcd"]) == [f"On {n} Text of {n} Related work Work of {n} Sources Books Book {n}" for n in "abcd"]


# chats


def brute_cost(roles, costs):
    """All ways, by recursion."""
    import functools

    @functools.cache
    def go(k, state):
        if k == len(roles):
            return int(chat.ending(costs)[state])
        return min(c.cost + go(k + 1, t) for t, c in enumerate(chat.step(roles[k], costs)[state]) if c)

    return go(0, chat.START)


@pytest.mark.parametrize("block", [2, 512])
def test_chats(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for conv in range(40):
        for turn in range(rng.integers(1, 9)):
            rows.append((conv, turn, str(rng.choice(["system", "user", "assistant", "User ", "tool"])), f"t{turn}"))
    rows += [(99, None, None, None), (None, 1, "user", "q"), (98, 1, "user", "same"), (98, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    costs = chat.Costs()
    got = defaultdict(list)
    for r in chat.format_chats(df, block=block).orderBy("conv_id", "block", "pos").collect():
        got[r["conv_id"]].append(r)
    for conv in range(40):
        given = [r[2].strip().lower() for r in rows if r[0] == conv]
        out = got[conv]
        roles = [r["role"] for r in out if r["role"] and not r["action"].startswith("merge")]
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        spent = sum(costs.insert * (r["action"] == "insert") + costs.merge * r["action"].startswith("merge") + costs.relabel * r["action"].endswith("relabel") for r in out)
        assert spent == brute_cost(given, costs)
        assert "".join(r["text"] for r in out) == "".join(r[3] for r in rows if r[0] == conv)
        whole = "".join(r["rendered"] for r in out)
        assert whole.count("<|end|>") == len(roles) and whole.endswith("<|end|>\n")
    assert [r["action"] for r in got[98]] == ["keep", "merge", "insert", "close"]
    assert got[99][0]["action"] == "relabel" and len(got[None]) == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_of_many_rows_a_turn(spark):
    """Rows of one turn number, or of none, are repaired in chunks; ids of any type; columns with the operator's own names."""
    rows = [("a", None, "user", f"{k:05d}", 1, 2) for k in range(1300)] + [(None, 5, str(r), f"{k:05d}", 1, 2) for k, r in enumerate(["assistant", "user"] * 300)] + [("b", 0, "user", "x" * 1_000_000, 1, 2)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, block int, chunk int")
    got = defaultdict(list)
    for r in chat.format_chats(df).orderBy("conv_id", "block", "pos").collect():
        got[r["conv_id"]].append(r)
    costs = chat.Costs()
    for conv, given in (("a", ["user"] * 1300), (None, ["assistant"] * 300 + ["user"] * 300)):
        spent = sum(costs.insert * (r["action"] == "insert") + costs.merge * r["action"].startswith("merge") + costs.relabel * r["action"].endswith("relabel") for r in got[conv])
        states = chat.walk([chat.product(given, costs)], costs)
        want = chat.product(given, costs)[chat.START, states[1]] + chat.ending(costs)[states[1]]
        assert spent == want and [r["pos"] for r in got[conv]] == list(range(len(got[conv])))
        assert sum(len(r["text"]) for r in got[conv]) == 5 * len(given)
    assert len(got["b"]) == 3 and len(got["b"][0]["rendered"]) > 1_000_000


def test_clean_chat_is_kept(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    whole = "".join(r["rendered"] for r in chat.format_chats(df).orderBy("block", "pos").collect())
    assert whole == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
