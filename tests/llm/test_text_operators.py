"""Each operator against a plain, brute-force version on small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import bpe, fingerprints, jaccard_join, lm_scoring, media, mixing, secrets, substring_dedup, token_counts, toxicity
from pointloom.llm.bloom import Filter, segments_of, short_of
from pointloom.llm.pretokens import Recent, spans, splitter
from pointloom.llm.words import Words, word_hash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY, TOKENIZER = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(text):
    return SPACE.findall(text or "")


def fold(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# ---- 3 and 7: tokens


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(docs, rows, odd, empty, tik):
    got = by_id(bpe.encode(docs, VOCABULARY, P.PATTERN, digests=True))
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids = tik.encode_ordinary(text or "")
        g = got[doc_id]
        assert g["ids"] == ids and g["n_tokens"] == len(ids) and g["round_trip"]
        assert g["ids_sha256"] == sha(np.array(ids, "<u4").tobytes()) and g["decoded_sha256"] == sha((text or "").encode())
    back = by_id(bpe.decode(bpe.encode(docs, VOCABULARY, P.PATTERN), VOCABULARY))
    assert all(back[r[0]]["text"] == (r[1] or "") for r in rows)
    assert bpe.encode(odd, VOCABULARY, P.PATTERN).count() == 5 and bpe.encode(empty, VOCABULARY, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_and_counts_on_any_text(text):
    import tiktoken
    from tokenizers import Tokenizer

    data = open(VOCABULARY, "rb").read()
    if "tik" not in _once:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        spec = open(TOKENIZER).read()
        _once.update(tik=tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), hf=Tokenizer.from_str(spec), counter=token_counts.Counter(spec, token_counts.table_of(spec, Counter(["a", " the", "'s", "é", " "]))))
    ids = bpe.engine(data, P.PATTERN).encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == _once["tik"].encode_ordinary(text)
    assert bpe.engine(data, P.PATTERN).decode(ids) == text.encode()
    assert _once["counter"].counts([text, "", text]).tolist() == [(n := len(_once["hf"].encode(text, add_special_tokens=False).ids)), 0, n]


_once: dict = {}


def test_narrow_and_wide_split_agree():
    wide, narrow = splitter(P.PATTERN + "|(?!)"), splitter()
    for c in map(chr, range(256)):
        for s in (f"a{c}b 1{c}2", f" {c} {c}{c}  x", f"'{c}'s{c}"):
            assert wide(s) == narrow(s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'srtvelmd a  \n\u3000\t1é中!?", max_size=20), max_size=4))
def test_spans_equal_the_split(texts):
    points, at = token_counts._points(texts)
    start, stop = spans(points, at)
    by = np.argsort(start)
    assert ["".join(texts)[a:b] for a, b in zip(start[by], stop[by])] == [x for t in texts for x in splitter()(t)]


def test_caches_stay_bounded():
    cache = Recent(10, lambda k: k * 2)
    for i in range(100):
        assert cache[str(i)] == str(i) * 2 and cache["5"] == "55"
        assert len(cache) + len(cache.old) <= 10


def test_token_counts_equal_library(docs, rows, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = by_id(token_counts.count_tokens(docs, TOKENIZER))
    for doc_id, text, *_ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[doc_id] == {"doc_id": doc_id, "n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 1024}
    assert token_counts.count_tokens(odd, TOKENIZER).count() == 5 and token_counts.count_tokens(empty, TOKENIZER).count() == 0


# ---- 4: secrets


def plain_base(text):
    text, found = text or "", []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def test_secrets(docs, rows, odd, empty):
    found = secrets.find(docs)
    got = by_id(secrets.digest(found))
    some = 0
    for doc_id, text, *_ in rows:
        base = plain_base(text)
        g = got[doc_id]
        assert g["base_sha256"] == sha(",".join(base).encode())
        assert [g[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(g["spans"].split(",")) | set()
        some += len(base)
    assert some > 8
    last = got[rows[-1][0]]["spans"]
    assert "private_key" in last and "code_host" in last and "url_login" in last
    clean = by_id(secrets.redact(docs))
    assert clean[rows[0][0]]["text"] == rows[0][1] and secrets.redact(docs).columns == docs.columns
    assert all(not plain_base(r["text"]) for r in clean.values())
    assert secrets.find(odd).count() == 5 and secrets.find(empty).count() == 0 and secrets.redact(empty).count() == 0
    assert [r["text"] for r in secrets.redact(odd).collect()].count(None) == 1


def test_redaction_leaves_nothing_of_a_secret(spark):
    rng = np.random.default_rng(2)
    base = lambda n: "".join(rng.choice(list("ABCDEFGHabcdefgh0123+/"), n))
    body = "\n".join([*(base(64) for _ in range(20)), "Qw+/12=="])
    key = lambda label, inside, end: f"-----BEGIN {label}-----\n{inside}" + f"\n-----END {label}-----" * end
    texts = {
        "pem": key("RSA PRIVATE KEY", body, True),
        "bare": key("PRIVATE KEY", body, True),
        "headers": key("EC PRIVATE KEY", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}", True),
        "pgp": key("PGP PRIVATE KEY BLOCK", f"Version: X 1\n\n{body}\n=ab1/", True),
        "escaped": key("OPENSSH PRIVATE KEY", body, True).replace("\n", "\\n"),
        "open": key("RSA PRIVATE KEY", body, False),
        "open headers": key("EC PRIVATE KEY", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}", False),
        "open escaped": key("PRIVATE KEY", body, False).replace("\n", "\\n"),
        "other end": key("RSA PRIVATE KEY", body, False) + "\n-----END CERTIFICATE-----",
        "code": "ghp_" + "a1" * 300,
        "chat": "xoxb-" + "a1-" * 200,
        "cloud": "AIza" + "x" * 90,
        "payment": "sk_live_" + "a1" * 300,
    }
    texts["two"] = texts["open"] + "\nthe next one\n" + texts["pem"]
    docs = spark.createDataFrame([(i, f"before {t}\nafter the end") for i, t in enumerate(texts.values())], "doc_id bigint, text string")
    got = [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()]
    kinds = ["private_key"] * 9 + ["code_host", "chat", "cloud_key", "payment"]
    rest = ["\n-----END CERTIFICATE-----" if name == "other end" else "" for name in texts]
    assert got[:-1] == [f"before [{k}]{r}\nafter the end" for k, r in zip(kinds, rest)]
    assert got[-1] == "before [private_key]\nthe next one\n[private_key]\nafter the end"
    login = spark.createDataFrame([(0, "see db://me:" + "p4" * 100 + "@host/x and " + "u" * 90 + " db://" + "u" * 90 + ":pw@h")], "doc_id bigint, text string")
    assert secrets.redact(login).first()["text"] == "see [url_login]host/x and " + "u" * 90 + " [url_login]h"


@pytest.mark.parametrize(("pattern", "query"), [("abcd", {b"abc", b"bcd"}), ("[0-9]+", set()), ("AbC|xyzw", {b"abc", b"xyz", b"yzw"}), ("ab(c|d)e", {b"abc", b"bce", b"abd", b"bde"}), ("abc*", set()), ("(abc)?def", {b"def"}), ("a.cdef", {b"cde", b"def"})])
def test_trigram_queries(pattern, query):
    assert secrets.trigrams(secrets.trigram_query(pattern)) >= query
    if not query:
        assert secrets.trigram_query(pattern) == secrets.TRUE


def test_candidates_lose_no_match():
    rng = np.random.default_rng(0)
    rules = tuple(secrets.Rule(f"r{i}", p, f) for i, (p, f) in enumerate([("abca(b|c){2,3}a", False), ("(ab)+c[ab]d?", True), ("a?b?cab", False), ("[abc]abc[^c]", True), ("(?:aab|bba)c*a{3}", False)]))
    scan = secrets.Scanner(rules)
    texts = ["".join(rng.choice(list("abcABC"), 40)).encode() for _ in range(400)]
    for text, spans in zip(texts, scan.spans(texts)):
        want = sorted((m.start(), m.end(), k) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text.decode(), r.flags))
        assert sorted(spans) == want


# ---- 2: mixing


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total, share = sum(w[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            got[s] += share * w[s] / total
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                open_.discard(s)
    return got


def test_mixing(spark, docs, rows, odd, empty):
    got = mixing.plan(docs).collect()
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert math.floor(r["target"] / r["source_size"]) <= r["copies"] <= math.ceil(r["target"] / r["source_size"]) <= 3
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan(docs.repartition(3)).collect()), key=str)
    sent = Counter(r["doc_id"] for r in mixing.emit(docs).collect())
    assert sent == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]}) and mixing.emit(docs).columns == docs.columns
    assert mixing.plan(odd).count() == 5 and mixing.plan(empty).count() == 0 and mixing.emit(empty).count() == 0
    many = spark.createDataFrame([(i, "a b " * (i % 7 + 1), f"s{i % 50}") for i in range(3000)], "doc_id bigint, text string, source string")
    plan = mixing.plan(many)
    taken = plan.groupBy("source").agg({"target": "max"}).count()
    assert taken == 50
    sums = plan.selectExpr("source", "target", "copies * size t").groupBy("source").agg({"target": "max", "t": "sum"}).collect()
    assert sum(r["sum(t)"] for r in sums) == pytest.approx(sum(r["max(target)"] for r in sums), rel=0.1)
    for r in sums:  # within two of the longest documents of its source
        assert abs(r["sum(t)"] - r["max(target)"]) <= 2 * 14
    clash = docs.selectExpr("*", "1 copies", "2 copy", "3 source_size", "4 band", "5 key", "6 edge", "7 whole")
    assert mixing.emit(clash).drop("copies", "copy", "source_size", "band", "key", "edge", "whole").count() == sum(sent.values())


def test_mixing_meets_targets_of_few_long_documents(spark):
    plan = mixing.plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for r in plan.groupBy("source").agg({"target": "max", "size": "max", "taken": "sum"} if "taken" in plan.columns else {"target": "max", "size": "max"}).collect():
        taken = sum(x["copies"] * x["size"] for x in plan.where(plan["source"].eqNullSafe(r["source"])).collect())
        assert abs(taken - r["max(target)"]) <= max(0.02 * r["max(target)"], r["max(size)"])


def test_mixing_beyond_the_broadcast(docs, monkeypatch):
    a = sorted(map(tuple, mixing.plan(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST", 1)
    assert sorted(map(tuple, mixing.plan(docs).collect()), key=str) == a


# ---- 5: fingerprints


def test_edited_and_near(docs, rows, odd, empty):
    got = by_id(fingerprints.digest(fingerprints.compare_edited(docs)))
    order = sorted(rows, key=lambda r: r[0])

    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[doc_id]
        assert g["n_chars"] == len(text) and g["edited_sha256"] == sha(edited.encode())
        assert abs(g["near_edited"] - like(shingles(text), shingles(edited))) < 0.16
        assert abs(g["near_next"] - like(shingles(text), shingles(after))) < 0.16
    assert len({g["fingerprint"] for r, g in ((r, got[r[0]]) for r in rows) if r[1] == rows[0][1]}) == 1
    assert fingerprints.compare_edited(odd).count() == 5 and fingerprints.compare_edited(empty).count() == 0


def test_edited_over_many_ranges(docs, monkeypatch):
    want = by_id(fingerprints.digest(fingerprints.compare_edited(docs)))
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4000)
    assert by_id(fingerprints.digest(fingerprints.compare_edited(docs))) == want


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    a = spark.range(4000).select(F.xxhash64("id").alias("h"), (F.col("id") % 3).alias("part"))
    arrays = a.groupBy("part").agg(fingerprints.bottom(F.collect_list("h")).alias("s"))
    whole = a.agg(fingerprints.bottom(F.collect_list("h")).alias("s")).first()["s"]
    assert fingerprints.merged(arrays.withColumn("all", F.lit(1)), ["all"], "s").first()["s"] == whole
    n = spark.createDataFrame([(whole,)], "s array<bigint>").select(fingerprints.distinct(F.col("s"))).first()[0]
    assert 3000 < n < 5200
    half = a.where("part = 0").agg(fingerprints.bottom(F.collect_list("h")).alias("s")).first()["s"]
    c = spark.createDataFrame([(half, whole)], "a array<bigint>, b array<bigint>").select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.resemblance(F.col("a"), F.col("b"))).first()
    assert c[0] > 0.7 and abs(c[1] - 1 / 3) < 0.12


# ---- 6: media


def test_media(docs, rows, odd, empty):
    made = media.features(media.store(docs))
    got = by_id(media.digest(made))
    files = by_id(media.store(docs))
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        pad = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        g = got[doc_id]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(pad), sha(pad), zlib.crc32(pad[-16:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(files[doc_id]["media"]), sha(files[doc_id]["media"])) and len(g["feature"]) == 16
    assert media.features(media.store(odd)).count() == 5 and media.features(media.store(empty)).count() == 0


def test_broken_media(spark):
    good = media.encode_png(np.arange(600, dtype=np.uint8).reshape(3, 200))
    bad = good[:40] + bytes([good[40] ^ 1]) + good[41:]
    rows = by_id(media.features(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad)), (3, bytearray(good[:-5])), (4, None), (5, bytearray(b"GIF"))], "doc_id bigint, media binary")))
    assert rows[1]["error"] is None and all(rows[i]["error"] and rows[i]["payload"] is None for i in (2, 3, 4, 5))


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_filters(channels):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 9, channels), np.uint8)
    shape = (6, 9) if channels == 1 else (6, 9, channels)
    assert (media.decode_png(media.encode_png(image.reshape(shape))) == image.reshape(shape)).all()
    # every filter, encoded plainly
    flat, lines = image.reshape(6, -1).astype(int), []
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        line = [kind]
        for x in range(flat.shape[1]):
            a = flat[y, x - channels] if x >= channels else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - channels] if y and x >= channels else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        lines.append(bytes(line))
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    head = (9).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
    data = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == image.reshape(shape)).all()


def test_cosine_hash_moves_little_with_noise():
    rng = np.random.default_rng(2)
    image = np.kron(rng.integers(0, 256, (10, 16)), np.ones((10, 10)))  # all low frequencies matter
    noisy = np.clip(image + np.random.default_rng(0).normal(0, 4, image.shape), 0, 255)
    bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8))
    assert (bits(media.cosine_hash(image)) != bits(media.cosine_hash(noisy))).sum() <= 20
    assert (bits(media.cosine_hash(image)) != bits(media.cosine_hash(image[:, ::-1]))).sum() > 8


# ---- 8: substring dedup


def plain_dedup(rows, window=50):
    first = {}
    split = [(i, words(t)) for i, t, *_ in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = True
        yield i, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())


@pytest.mark.parametrize(("window", "anchor"), [(50, 25), (12, 5)])
def test_substring_dedup(docs, rows, odd, empty, window, anchor, monkeypatch):
    want = {i: (n, r, s) for i, n, r, s in plain_dedup(rows, window)}
    assert sum(r > 0 for _, r, _ in want.values()) > 10
    for held, block, size in ((1 << 18, 8 << 20, 64 << 20), (8, 2000, 1)):
        monkeypatch.setattr(substring_dedup, "HELD", held)
        monkeypatch.setattr(substring_dedup, "FILTER", size)
        monkeypatch.setattr(substring_dedup, "ARRAY_BYTES", block)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(substring_dedup.dedup(docs, window, anchor)).collect()}
        assert got == want
    assert substring_dedup.dedup(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(70))
    assert odd.count() == substring_dedup.dedup(odd).count() == 5
    rep = docs.sparkSession.createDataFrame([(5, long), (5, long), (None, long), (None, long + " x"), (7, "a " + long)], "doc_id bigint, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.dedup(rep).collect()) == [("5", 0), ("5", 0), ("7", 70), ("None", 70), ("None", 70)]


def test_factors_are_longest_matches():
    """A passage of the second half of one and the first half of another is two factors that overlap by a window less one word."""
    a, b = (np.arange(k, k + 100, dtype=np.uint32) for k in (0, 1000))
    c = np.concatenate([a[50:], b[:60]])
    passage, begin, at, n = substring_dedup.parsed(np.concatenate([a, b, c]), np.array([100, 100, 110]), np.array([1, 2, 3]), 50)
    assert list(zip(passage, begin, at, n)) == [(2, 0, 50, 50), (2, 50, 100, 60)]
    passage, begin, at, n = substring_dedup.parsed(np.concatenate([a, c[:50], a]), np.array([100, 50, 100]), np.array([5, 2, 7]), 50)
    assert sorted(zip(passage, begin, n)) == [(0, 50, 50), (2, 0, 100)]


# ---- 9: Jaccard join


def plain_classes(rows):
    sets = []
    for i, t, *_ in rows:
        w = words(fold(t))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                r, s = root(i), root(j)
                parent[max(r, s)] = min(r, s)
    return {i: (len(a), root(i)) for i, a in sets}


def test_jaccard_classes(docs, rows, odd, empty):
    want = plain_classes(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want) - 10
    assert jaccard_join.classes(empty).count() == 0
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.classes(odd).collect()) == [("1", 1, "1"), ("1", 2, "1"), ("1", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]


@pytest.mark.parametrize(("frequent", "hot", "short"), [(1 << 17, 1000, 32), (0, 1000, 2), (1 << 17, 5, 4)])
def test_jaccard_near_threshold(spark, frequent, hot, short, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "PER_MATCH", 4)
    monkeypatch.setattr(jaccard_join, "COSTLY", 1.0)
    monkeypatch.setattr(jaccard_join, "FAN", 3)
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 300)
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(30)]
    rows = []
    for g in range(25):
        base = rng.choice(pool, 40).tolist()
        for _ in range(8):
            t = base.copy()
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(0, 40)] = "z" + str(rng.integers(0, 5))
            rows.append((len(rows), " ".join(t[: rng.integers(30, 41)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = jaccard_join.classes(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_classes(rows)
    assert {r["doc_id"]: r["n_links"] for r in got} == {r[0]: n for r, n in zip(rows, plain_links(rows))}


def plain_links(rows):
    """How many other rows each row links with, by comparing all of them."""
    sets = []
    for _, t, *_ in rows:
        w = words(fold(t))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return [sum(bool(a and b) and 100 * len(a & b) >= 80 * len(a | b) for b in sets) - bool(a) for a in sets]


def test_jaccard_links(docs, rows, odd):
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.classes(docs).collect()}
    assert got == {r[0]: n for r, n in zip(rows, plain_links(rows))} and max(got.values()) > 10
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in jaccard_join.classes(odd).collect()) == [("1", 1, 0), ("1", 2, 2), ("1", 2, 2), ("None", 0, 0), ("None", 2, 2)]


def _near(n, seed):
    """A text of n words and one near it."""
    a = [f"{seed}w{i}" for i in range(n)]
    return " ".join(a), " ".join([*a[:-1], "other"])


def test_null_and_shared_ids_join_no_classes(spark):
    (a, a2), (b, b2) = _near(60, "a"), _near(60, "b")
    found = lambda rows: sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert found([(5, a), (7, b), (None, a2), (None, b2)]) == [("5", "5", 1), ("7", "7", 1), ("None", "5", 1), ("None", "7", 1)]
    assert found([(5, a), (7, b), (20, a2), (20, b2)]) == [("20", "5", 1), ("20", "7", 1), ("5", "5", 1), ("7", "7", 1)]
    assert found([(None, a), (None, a2), (3, "x")]) == [("3", "3", 0), ("None", "None", 1), ("None", "None", 1)]


def test_one_of_each_class(spark):
    (a, a2), (b, _) = _near(60, "a"), _near(60, "b")
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (1, a, "p"), (None, a2, "s"), (None, None, "t"), (None, "", "u"), (9, "", "v"), (None, b, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tie string")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, a, "p"), (5, b, "r"), (None, None, "t"), (None, "", "u"), (9, "", "v")]))
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_links_of_two_sides():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for _ in range(700):
        x = base.copy()
        x[rng.integers(0, 200, rng.integers(0, 30))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(x[: rng.integers(150, 201)]))
    order = jaccard_join.Order(4, np.sort(base[:50] >> np.uint64(28)), np.arange(50, dtype=np.uint32) + 3)
    link = np.array([[100 * (c := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - c) for b in sets[:40]] for a in sets])
    hit = jaccard_join.links_of(sets, sets[:40], order, 80)
    assert (hit == link).all() and 0 < link.mean() < 1
    assert (jaccard_join.links_of(sets[:40], None, order, 80) == link[:40] & ~np.eye(40, dtype=bool)).all()


def test_heads_are_components():
    hit = np.zeros((5, 4), bool)
    hit[[0, 2, 2, 4], [1, 1, 3, 0]] = True
    row, col = jaccard_join.heads(hit, False)
    assert row.tolist() == [0, 1, 0, 3, 4] and col.tolist() == [4, 0, 7, 0]
    chain = np.zeros((4, 4), bool)
    chain[[0, 1, 1, 3], [1, 0, 3, 1]] = True
    assert jaccard_join.heads(chain, True)[0].tolist() == [0, 0, 2, 0]


@given(st.lists(st.text(alphabet="aZé \t\n\x0b\x1c\u3000", max_size=12), max_size=5))
@settings(max_examples=200, deadline=None)
def test_words_are_cut_and_hashed_as_bytes_split(texts):
    w = Words([t.encode() for t in texts], lower=True)
    split = [t.encode().lower().split() for t in texts]
    assert w.counts.tolist() == list(map(len, split))
    assert w.hashes.tolist() == [word_hash(x) for s in split for x in s]
    assert len(set(w.hashes.tolist())) == len({x for s in split for x in s})


# ---- 1: language model


def lm_tokens(text):
    return [*words(fold(text)), ""]


def test_lm_scores(docs, rows, odd, empty):
    got = by_id(lm_scoring.score_corpus(docs, hot=50))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows}
    counts = Counter(t for i, text, *_ in rows if not held[i] for t in lm_tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text, *_ in rows:
        toks = lm_tokens(text)
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(toks), sum(counts[t] > 0 for t in toks), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks), rel=1e-9)
        assert g["score"] < 0
    assert lm_scoring.score_corpus(odd).count() == 5 and lm_scoring.score_corpus(empty).count() == 0


def test_filter_counts():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    levels = np.minimum(rng.geometric(0.4, len(keys)), 40)
    parts = segments_of(keys, 3)
    built = Filter.joined(3, {s: Filter.built(short_of(keys[parts == s]), levels[parts == s]) for s in range(8) if s != 5})
    there = parts != 5
    read = built.levels(keys, parts)
    assert (read[there] >= levels[there]).all() and (read[there] > levels[there]).mean() < 0.03 and not read[~there].any()
    assert (built.holds(parts) == there).all() and (built.segments(keys) == parts).all()
    other = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert (built.levels(other, built.segments(other)) > 0).mean() < 0.03
    assert lm_scoring.counts_of_levels(1.5)[:6].tolist() == [0, 1, 2, 3, 4.5, 6.5]


def test_lm_learns_pairs(spark):
    rows = [(i, " ".join(["the cat sat"] * 30 + [f"x{i}"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm_scoring.score_corpus(docs).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] / 2 for r in got)


def plain_bigrams(texts, learnt):
    """Scores by a bigram model with counts of the levels that the filter enters."""
    pairs_of = lambda t: list(zip(["", *lm_tokens(t)[:-1]], lm_tokens(t)))
    c1 = Counter(w for t in learnt for w in lm_tokens(t))
    c2 = Counter(p for t in learnt for p in pairs_of(t))
    word, pair = (lm_scoring.counts_of_levels(s) for s in (lm_scoring.WORD_STEP, lm_scoring.PAIR_STEP))
    read = lambda table, c, step: table[1 + math.floor(math.log(c) / math.log(step) + 1e-9)] if c else 0.0
    n, m, out = sum(c1.values()) + 0.5 * (len(c1) + 1), lm_scoring.PRIOR, []
    for t in texts:
        s = 0.0
        for v, w in pairs_of(t):
            first = read(word, c1[v], lm_scoring.WORD_STEP)
            c = min(read(pair, c2[v, w], lm_scoring.PAIR_STEP), first)
            s += math.log10((c + m * (read(word, c1[w], lm_scoring.WORD_STEP) + 0.5) / n) / (first + m))
        out.append(s)
    return out


@pytest.mark.parametrize("capacity", [lm_scoring.CAPACITY, 1500])
def test_lm_equals_bigrams_at_any_capacity(docs, rows, capacity):
    """Only false positives of the filter, about one probe in a hundred, tell the scores from a plain model's, in one shard or many. Pairs seen once count."""
    got = by_id(lm_scoring.score_corpus(docs, capacity=capacity))
    texts = {i: t for i, t, *_ in rows}
    learnt = [t for i, t in texts.items() if not got[i]["held_out"]]
    wants = dict(zip(texts, plain_bigrams(texts.values(), learnt)))
    for i, want in wants.items():
        if not got[i]["held_out"]:
            assert abs(got[i]["score"] - want) <= 0.04 * got[i]["n_tokens"] + 0.5
    held = [i for i in texts if got[i]["held_out"]]
    assert 0 <= sum(got[i]["score"] - wants[i] for i in held) <= 0.08 * sum(got[i]["n_tokens"] for i in held)
    model, _ = lm_scoring.learn(docs, capacity=1500)
    assert len(model.pairs) > 2 and all(len(model.pairs.filter(i).data) <= 3000 for i in range(len(model.pairs)))


# ---- 10: toxicity


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    n = 4000
    x = rng.integers(0, 2, (n, 5))
    z = x @ np.array([2.5, 1.5, 0.0, 0.0, 0.0]) + rng.logistic(size=n)
    grade = (z[:, None] > np.array([1.0, 2.5, 4.0])).sum(axis=1)
    w, t = toxicity.fit([[(j, 1.0) for j in np.flatnonzero(r)] for r in x], grade, 5, penalty=1e-6, steps=1500)
    assert np.allclose(w, [2.5, 1.5, 0, 0, 0], atol=0.35) and np.allclose(t, [1.0, 2.5, 4.0], atol=0.35) and (np.diff(t) > 0).all()


def test_best_cut():
    assert toxicity.best_cut(np.array([0.01, 0.02, 0.2, 0.3]), np.array([0, 0, 1, 1])) == pytest.approx(0.11)
    assert 0.3 < toxicity.best_cut(np.array([0.1, 0.9, 0.3, 0.95]), np.array([0, 1, 0, 1])) < 0.9


def test_toxicity_on_held_out_labels(spark, docs, odd, empty):
    base = "/root/testdata/sf0.1"
    docs_, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.train(docs_, labels.where("doc_id % 2 = 0"))
    rest = toxicity.scores(docs_, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F_toxic()), "doc_id")
    wrong = rest.where("toxic <> (label = 1)").count()
    assert wrong <= 0.02 * rest.count()  # some labelled examples hold nothing but repeated or mixed words
    assert rest.where("label = 1").agg({"severity": "avg"}).first()[0] > 1
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.scores(odd, none).where("toxic").count() == 0 and toxicity.scores(odd, model).count() == 5 and toxicity.scores(empty, model).count() == 0


def F_toxic():
    from pyspark.sql import functions as F

    return F.col("toxic").alias("label")
