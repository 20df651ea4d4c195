"""Fill-in-middle, spelling variants and packing against plain versions."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import fill_middle, jaccard_join, lm_scoring, media, packing, secrets, spelling, token_counts, toxicity

WORDS = P.path("word_bpe_49k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- 11: fill-in-middle


def plain_cut(doc_id, text):
    t, key = text or "", sha(f"1:{'' if doc_id is None else doc_id}".encode())
    h1, h2, h3, h4 = (int(key[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if h4 % 100 < 20 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return n, "spm" if h4 % 100 < 20 else "psm", a, b - a, out


def test_fill_middle(spark, docs, rows, odd, empty):
    more = [(1000 + i, t) for i, t in enumerate(["a<P>b", "<M>", "<P", "x<S", "<", ">", "P>", "é👩‍👧ǅ", "\U0010ffff" * 9, "a" * 70 + "中" * 70, "<" * 50 + "S>", "👩" * 1_000_000, "<S>" + "y" * 100_000])]
    given_ = [(r[0], r[1]) for r in rows] + more
    made = fill_middle.restore(fill_middle.transform(docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))))
    got = {r["doc_id"]: r for r in made.collect()}
    assert len(got) == len(given_)
    for doc_id, text in given_:
        g = got[doc_id]
        assert (g["n"], g["form"], g["prefix_units"], g["middle_units"], g["output"]) == plain_cut(doc_id, text) and g["text"] == (text or "")
    forms = Counter(g["form"] for g in got.values())
    assert forms["psm"] > forms["spm"] > 3 and forms["plain"] > 10
    digests = {r["doc_id"]: r for r in fill_middle.digest(fill_middle.transform(docs)).collect()}
    assert all(digests[r[0]]["restored_sha256"] == sha((r[1] or "").encode()) and digests[r[0]]["output_sha256"] == sha(plain_cut(r[0], r[1])[4].encode()) for r in rows)
    kept = sorted(((r["doc_id"], r["output"]) for r in fill_middle.transform(odd).collect()), key=str)
    assert kept == sorted(((d, plain_cut(d, t)[4]) for d, t in [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words")]), key=str)
    assert fill_middle.transform(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>PSM\n\té中👩", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cut_by_words_and_ranked_bits(text, h1, h2):
    raw = text.encode()
    for unit, plain in (("char", list(text)), ("word", re.findall(r"^\s*\S*\s*|\S+\s*", text.replace("\n", "\n")) if text else [])):
        plain = [x for x in plain if x]
        bits = fill_middle.starts(raw, unit)
        at = np.cumsum([0, *(len(x.encode()) for x in plain)])[:-1].tolist()
        assert [fill_middle.select(bits, k) for k in range(bits.bit_count())] == at
        n, form, low, mid, out = fill_middle.cut(raw, (h1, h2, 0, h2), unit)
        if form != "plain":
            parts = dict(zip(re.findall(rb"<([PSM])>", out), re.split(rb"<[PSM]>", out)[1:]))
            assert parts[b"P"] + parts[b"M"] + parts[b"S"] == raw and parts[b"P"] == "".join(plain[:low]).encode() and parts[b"M"] == "".join(plain[low : low + mid]).encode()
        else:
            assert not text or any(m in text for m in fill_middle.MARKERS)


def test_markers_must_stand_alone(docs):
    for markers in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "abc", "d"), ("xy", "yz", "d")):
        with pytest.raises(ValueError):
            fill_middle.transform(docs, markers=markers)


# ---- 12: spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(given_, spoilt, shortest=5, rarest=3):
    counts = Counter()
    for doc_id, text in given_:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if spoilt and h % spoilt == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            counts[w] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= shortest and n >= rarest}
    around = {w: [x for x in kept if near(w, x)] for w in kept}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-kept[x], x), default=None)
        form[w] = best if best is not None and kept[best] >= 2 * kept[w] else None
    out = {}
    for w in kept:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, kept[w], len(around[w]), kept.get(form[w]))
    return out


def variants_of(df, **how):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, **how).collect()}


@pytest.mark.parametrize("spoilt", [0, 7, 97])
def test_spelling_variants(docs, rows, odd, empty, spoilt):
    want = plain_variants([(r[0], r[1]) for r in rows], spoilt)
    assert variants_of(docs, spoilt=spoilt) == want and len(want) > 100
    assert spoilt != 7 or any(f for f, *_ in want.values())
    assert variants_of(odd, shortest=1, rarest=1) == plain_variants([(1, t) for t in ("a b c d e f", "a b c d e f", "a b c d e f", "other words")], 0, 1, 1)
    assert variants_of(empty) == {}


@pytest.mark.parametrize("full", [1 << 13, 1])
def test_near_words_at_every_length(spark, full):
    """Words that differ anywhere, runs of one letter, very long words; ``full`` = 1 halves every partition down to single places."""
    import random

    rng = random.Random(3)
    words = {"a" * n for n in range(4, 12)} | {"".join(rng.choices("abé", k=rng.randint(4, 7))) for _ in range(150)}
    for n in (11, 24, 25, 26, 60, 700):
        base = "".join(rng.choices("abcdefgà", k=n))
        words.add(base)
        for i in {0, 1, n // 2, n - 1, *(rng.randrange(n) for _ in range(4))}:
            words |= {base[:i] + "z" + base[i + 1 :], base[:i] + "z" + base[i:], base[:i] + base[i + 1 :], base[:i] + base[i] + base[i:]}
        words |= {base + "q", base + "qq"}
    words = sorted(w for w in words if len(w) >= 4)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")
    got = sorted((r["word"], r["near"], r["near_n"]) for r in spelling.near_words(df, 4, full).collect())
    assert got == sorted((a, b, j) for a in words for j, b in enumerate(words) if near(a, b))


def test_roots_follow_long_paths(spark):
    """A path of forms, each three times as frequent as the last."""
    words = ["aaaaa" + "b" * i for i in range(9)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(3**i * 3))
    got = variants_of(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert {w: got[w][1] for w in words} == dict.fromkeys(words, words[-1]) and [got[w][0] for w in words] == [*words[1:], None]


# ---- 13: packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_ids_equal_library(library):
    encode = packing.Encoder(open(WORDS).read())
    texts = ["", "It's  the 'start, don''t we'll I'd '5 O'M", "ÀÉÞ×÷ßÿ\xa0\x85\x1c a", "ſ K İI ΣΑΣ é ﬁ 中文 ½²", "<|endoftext|> x<|startoftext|>y", "a" * 3000 + "12345" + "!" * 500]
    texts += ["".join(map(chr, range(a, a + 256))) for a in (0, 256, 0x300, 0x1E00, 0x2000)]
    texts.append(("é’s naïve test 12 " * 20_000) + "é")  # wide and long: goes through the library in parts
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    if "e" not in _made:
        _made.update(e=packing.Encoder(open(WORDS).read()), t=Tokenizer.from_file(WORDS))
    assert np.frombuffer(_made["e"](text), "<u4").tolist() == _made["t"].encode(text, add_special_tokens=False).ids


_made: dict = {}


def placed(made, length):
    """Every sequence's pieces in order, checked to be gapless and full but for the last."""
    by = defaultdict(list)
    for r in made:
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces[:-1])]).tolist() and min(p["length"] for p in pieces) > 0
        total = sum(p["length"] for p in pieces)
        assert total == length if s < len(by) - 1 else total <= length
    return by


@pytest.mark.parametrize("length", [4096, 64])
def test_packing(docs, rows, odd, empty, library, length):
    made = packing.pack(docs, WORDS, length)
    got = made.collect()
    by = placed(got, length)
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(whole[r["doc_id"]]) and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(r["ids"]) == 4 * r["length"]
        whole[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert dict(whole) == ids and len(by) == -(-sum(map(len, ids.values())) // length)
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.digest(packing.pack(docs, WORDS, length)).collect()}
    assert digests == {(r["doc_id"], r["start"]): zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in got}
    again = packing.sequences(made, length, 7).collect()
    assert sorted(r["sequence_id"] for r in again) == sorted(by)
    for r in again:
        tokens = b"".join(p["ids"] for p in by[r["sequence_id"]])
        assert r["n"] == len(tokens) // 4 and r["ids"] == tokens + np.full(packing.padded(r["n"], length) - r["n"], 7, "<u4").tobytes()
    few = packing.pack(odd, WORDS, length).collect()
    assert len(few) == 5 and placed(few, length) and sorted(r["doc_tokens"] for r in few) == [1, 3, 7, 7, 7]
    assert packing.pack(empty, WORDS).count() == 0 and packing.sequences(packing.pack(empty, WORDS)).count() == 0


def test_offsets_over_blocks_of_partitions(spark):
    made = spark.range(500).select((F.col("id") * 3).alias("part"), F.lit(5).alias("before"), (F.col("id") % 7).alias("n"))
    got = {r["part"]: r["base"] for r in packing.offsets(made, 16).collect()}
    total, want = 0, {}
    for i in range(500):
        want[i * 3] = total
        total += 5 + i % 7
    assert got == want


def test_power_of_two_stands():
    assert [packing.padded(n, 64) for n in (1, 2, 3, 32, 33, 64)] == [1, 2, 64, 32, 64, 64]


# ---- What large inputs ask of the earlier operators


def test_secret_rules_read_long_runs_once():
    """Runs in which every few letters could begin a secret: 20 MB take seconds."""
    scan = secrets.Scanner(secrets.RULES)
    n = 20 << 20
    for text in (b"eyJ" * (n // 3) + b".eyJ", b"a.b" * (n // 3) + b"://", b"9" * n + b"://x", b"x://" * (n // 4) + b"y:z@"):
        began = time.time()
        scan.spans([text])
        assert time.time() - began < 40


def test_tokens_and_logins_within_runs():
    scan = secrets.Scanner(secrets.RULES)
    found = lambda t: [(t[a:b], secrets.RULES[k].kind) for a, b, k in scan.spans([t.encode()])[0] if k >= len(secrets.BASE)]
    token = "eyJ" + "a" * 12 + ".eyJ" + "b" * 10 + "." + "c_-" * 4
    assert found(f"x {token} y") == [(token, "web_token")] and found(f"Bearer_{token}.more") == [(token, "web_token")]
    assert found(f"é.{token}") == [(token, "web_token")] and found(f"abc.{token}") == [(token, "web_token")]
    assert found("eyJ" + "a" * 9 + ".eyJ" + "b" * 10 + "." + "c" * 10) == [] and found("eyJ" + "a" * 20 + ".xyJ" + "b" * 10 + "." + "c" * 10) == []
    long = "s" + "cheme+" * 9 + "x"
    assert found(f"see {long}://me:pw@host") == [(f"{long}://me:pw@", "url_login")] and found("12ab://u:p@h") == [("ab://u:p@", "url_login")]


def test_frequent_pieces_come_from_a_bounded_part(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id % 7, ' and the rest ', id) AS text").repartition(20)
    every = token_counts.frequent(docs, 10_000)
    assert every[" rest"] == 4000 and every[" and"] == 4000
    few = token_counts.frequent(docs, 40)
    assert 40 <= few[" rest"] <= 60 and len(token_counts.frequent(docs, 40, 5)) == 5
    monkeypatch.setattr(token_counts, "PARTS", 4)
    assert 30 <= token_counts.frequent(docs, 40)[" rest"] <= 60
    with open(P.path("byte_bpe_50k.json")) as f:
        assert f.read(1) == "{"
    got = token_counts.count_tokens(docs.withColumn("doc_id", F.lit(None).cast("bigint")), P.path("byte_bpe_50k.json"))
    assert got.count() == 4000 and got.where("n_tokens < 4").count() == 0


def test_heavy_segments_have_lanes(spark):
    """Half of all tokens follow one word: its segment's work is dealt to many lanes, and scores are those of one lane each."""
    rng = np.random.default_rng(0)
    names = [f"w{i}" for i in range(3000)]
    texts = [" ".join(x for w in rng.choice(names, 60) for x in ("the", str(w))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(6)
    model, counts = lm_scoring.learn(docs, 4096)
    assert not model.whole and model.lanes.max() > 3 and model.lanes.sum() <= 3 * len(model.lanes)
    score = lambda m: {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, m, counts).collect()}
    import dataclasses

    one = score(dataclasses.replace(model, lanes=np.ones_like(model.lanes)))
    assert score(model) == pytest.approx(one) and len(one) == 300


def test_sums_of_lanes_come_back_packed(spark, monkeypatch):
    """a row came back for each document and segment, some per token at scale. Now it is one row of arrays for each lane of a pack, whatever its documents."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 120)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2)
    model, counts = lm_scoring.learn(docs, 4096)
    plans, real = [], lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    whole = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, model, counts).collect()}
    routed = [p for p in plans if "CoGroup" in p]
    assert len(routed) == len(model.words) and not any("Aggregate" in p for p in routed)
    monkeypatch.setattr(lm_scoring, "HELD", 500)  # many packs
    again = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, model, counts).collect()}
    assert whole == pytest.approx(again) and len(whole) == 300


def test_packs_reach_over_few_rows(monkeypatch):
    monkeypatch.setattr(lm_scoring, "REACH", 7)
    rows = [*range(5, 30), *range(1 << 33, (1 << 33) + 4), 2, 3]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(["a"] * len(x))], names=["row", "text"]) for x in (rows[:11], rows[11:])]
    each, got, bases, n = lm_scoring._within_reach(batches), [], [], 0
    item = next(each)
    while item:
        base, new, batch = item
        own = batch.column("row").to_pylist()
        assert all(0 <= r - base < 7 for r in own) and new == (base not in bases)
        got, bases, n = got + own, bases + [base] * new, n + 1
        try:
            item = each.send(n == 2)
        except StopIteration:
            break
    assert got == rows


def test_levels_of_frequent_words_are_looked_up_once():
    asked = []
    find = lambda w: asked.extend(w.tolist()) or ((w % 10).astype(np.int64), (w % 7).astype(np.int64))
    known, rng = lm_scoring.Known(), np.random.default_rng(0)
    for _ in range(20):
        own = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
        got = known.of(own, find)
        assert (got[0] == own % 10).all() and (got[1] == own % 7).all()
    often = [w for w in asked if max(w % 10, w % 7) >= known.FEW]
    assert len(often) == len(set(often)) and len(known.words) <= known.MOST


def test_kept_row_of_equal_ones_is_the_same_on_every_run(spark):
    rows = [(1, "one two three four five six", lang, "s", 5) for lang in ("de", "en", "fr", None)] * 3
    for parts in (1, 3, 5):
        got = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(parts)).collect()
        assert [(r["doc_id"], r["lang"]) for r in got] == [(1, "de")]


def plain_cosine_hash(image, side=32, low=8):
    """The same bits by sums over all samples, each cut exactly into the cells that it lies in."""
    height, width = image.shape
    share = lambda n: np.array([[max(0.0, min((i + 1) * n / side, j + 1) - max(i * n / side, j)) for j in range(n)] for i in range(side)]) * side / n
    small = share(height) @ image.astype(float) @ share(width).T
    wave = np.zeros((low, low))
    for u in range(low):
        for v in range(low):
            scale = (1 if u == 0 else 2) ** 0.5 * (1 if v == 0 else 2) ** 0.5 / side
            wave[u, v] = scale * sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / (2 * side)) * np.cos(np.pi * (2 * x + 1) * v / (2 * side)) for y in range(side) for x in range(side))
    flat = wave.ravel()
    middle = np.median(flat[1:])
    return flat, middle, np.packbits(flat > middle).tobytes()


def test_features_against_plain_cosine_sums():
    rng = np.random.default_rng(0)
    for height in (1, 3, 32, 45):
        image = rng.integers(0, 256, (height, 192)).astype(np.uint8)
        flat, middle, want = plain_cosine_hash(image)
        got = media.cosine_hash(image)
        near = np.abs(flat - middle) < 1e-6  # sums in another order may fall on the other side
        a, b = (np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in (got, want))
        assert (a == b)[~near].all() and (height < 8 or near.sum() < 8)


def test_features_of_small_files_with_large_payloads(spark):
    n = 60
    docs = spark.createDataFrame([(i, "a" * 1_000_000) for i in range(n)] + [(n, None)], "doc_id bigint, text string").coalesce(1)
    made = media.features(media.store(docs))
    got = media.digest(made).collect()
    assert len(got) == n + 1 and {r["n_bytes"] for r in got} == {0, 1_000_000} and len({r["payload_sha256"] for r in got}) == 2
    assert {r["payload_sha256"] for r in got if r["n_bytes"]} == {sha(b"a" * 1_000_000 + b" " * (192 - 1_000_000 % 192))}


def test_toxicity_scores_against_plain_sums(spark, docs):
    """A fitted model's probabilities, grades and decisions, text by text, by the definition of its features and of a cumulative link."""
    sf_dir = "/root/testdata/sf0.001"
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(model.index) > 5 and list(model.thresholds) == sorted(model.thresholds)
    seen = 0
    for given_ in (spark.read.parquet(f"{sf_dir}/documents.parquet"), docs):
        rows = {r["doc_id"]: r for r in toxicity.scores(given_, model).collect()}
        for r in given_.select("doc_id", "text").collect():
            counts = Counter()
            for word in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")):
                counts.update([f"={word}", *(f"^{word[:n]}" for n in range(3, 9) if n <= len(word))])
            x = sum(model.weights[model.index[f]] * (1 + math.log(c)) for f, c in counts.items() if f in model.index)
            p = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
            got = rows[r["doc_id"]]
            assert got["severity"] == pytest.approx(sum(p), abs=1e-9) and got["p_toxic"] == pytest.approx(p[0], abs=1e-9)
            assert got["grade"] == sum(q >= 0.5 for q in p) and got["toxic"] == (got["p_toxic"] >= model.cut)
            seen += got["toxic"]
    assert seen > 3
