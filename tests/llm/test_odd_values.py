"""Every registered operator's values on null, empty, repeated and very long texts, repeated and null ids, and equal rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA
from test_text_operators import TOKENIZER, fold, lm_tokens, plain_base, sha, tik, words  # noqa: F401

from pointloom.llm import toxicity
from pointloom.llm.queries import QUERIES


def long_text():
    """Some 700 KB: words, and secrets among them."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(1, 12))) for _ in range(3000)]
    text = rng.choices(vocabulary, k=100_000)
    text[500] = text[90_000] = "token=abcdefgh12"
    text[99_999] = "0123456789abcdef" * 3
    return " ".join(text)


LONG = long_text()
TEXTS = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (7, LONG), (8, ""), (9, LONG), (10, " \t\n")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, t, None, "s" if t else None, None, "t", 1, "z") for i, t in TEXTS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture
def got(spark, folder):
    """The rows of a query, as sorted values of the columns asked for."""
    return lambda name, *columns: ordered(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect())


def ordered(rows):
    return sorted(rows, key=str)


def test_language_model(got):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in TEXTS]
    counts = Counter(t for h, (_, text) in zip(held, TEXTS) if not h for t in lm_tokens(text))
    n, v = sum(counts.values()), len(counts)
    plain = lambda text: sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in lm_tokens(text))
    rows = got("op1_lm_scoring", "doc_id", "n_tokens", "held_out", "n_known", "train_tokens", "base_score", "score")
    want = ordered((i, len(lm_tokens(t)), h, sum(counts[x] > 0 for x in lm_tokens(t)), n, plain(t)) for h, (i, t) in zip(held, TEXTS))
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert [r[5] for r in rows] == pytest.approx([w[5] for w in want], rel=1e-9) and all(r[6] < 0 for r in rows)
    assert len({r[6] for r in rows if r[1] == 100_001}) == 1 and len({r[6] for r in rows if r[1] == 7}) == 1


def test_mixing(got):
    rows = got("op2_mixing", "doc_id", "size", "source_size", "target", "taken")
    assert ordered(r[:2] for r in rows) == ordered((i, len(words(t))) for i, t in TEXTS)
    assert {(r[2], r[3] > 0) for r in rows if r[1]} == {(sum(len(words(t)) for _, t in TEXTS), True)} and all(r[4] <= 3 * r[1] for r in rows)
    assert sum(r[4] for r in rows) == sum(r[1] for r in rows)


def test_bpe(got, tik):  # noqa: F811
    def want(text):
        ids = tik.encode_ordinary(text or "")
        return len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())

    assert got("op3_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered((i, *want(t)) for i, t in TEXTS)


def test_secrets(got):
    base = [(i, plain_base(t)) for i, t in TEXTS]
    assert got("op4_secrets", "doc_id", "n_assign", "n_hex", "base_sha256") == ordered((i, sum(x.startswith("assign") for x in b), sum(x.startswith("hex") for x in b), sha(",".join(b).encode())) for i, b in base)
    assert max(len(b) for _, b in base) >= 3


def test_fingerprints(got):
    rows = got("op5_fingerprints", "doc_id", "n_chars", "fingerprint", "edited_sha256", "near_edited", "near_next")
    assert [r[:2] for r in rows] == [(i, n) for i, n in ordered((i, len(t or "")) for i, t in TEXTS)]
    assert len({r[2] for r in rows if r[1] == len(LONG)}) == 1 and all(0 <= x <= 1 for r in rows for x in r[4:])
    edited = {r[0]: r[3] for r in rows if r[0] in (7, 8, 9)}
    keep = LONG[: len(LONG) - len(LONG) // 2]
    # 8 is empty, and 9 is followed by blanks
    assert edited == {7: sha(keep.encode()), 8: sha(b""), 9: sha((keep + " \t\n").encode())}


def test_media(got):
    def want(text):
        raw = (text or "").encode()
        pad = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        return len(raw), len(pad), sha(pad), zlib.crc32(pad[-16:])

    assert got("op6_media", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == ordered((i, *want(t)) for i, t in TEXTS)
    of = {}
    for digest, feature, payload in got("op6_media", "media_sha256", "feature", "payload_sha256"):
        assert of.setdefault(payload, (digest, feature)) == (digest, feature)


def test_token_counts(got):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    n = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS]
    assert got("op7_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == ordered((*x, x[2] > 1024) for x in n)


def test_substrings(got):
    """The second long text is all windows of the first."""
    want = [(i, len(words(t)), len(words(t)) if i == 9 else 0, sha(b"" if i == 9 else " ".join(words(t)).encode())) for i, t in TEXTS]
    assert got("op8_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(want)


def test_classes(got):
    def shingles(text):
        w = words(fold(text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} - {()}

    smallest = lambda i, t: {LONG: 7, "a b c d e f": 1}.get(t, i)
    assert got("op9_jaccard_join", "doc_id", "n_shingles", "component_id") == ordered((i, len(shingles(t)), smallest(i, t)) for i, t in TEXTS)


def test_toxicity(spark, folder, sf_dir):
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [r.asDict() for r in toxicity.scores(docs, model, keep=tuple(docs.columns)).collect()]
    assert ordered((r["doc_id"], r["text"]) for r in rows) == ordered(TEXTS)
    for same in ({LONG}, {"a b c d e f"}, {None, ""}):
        assert len({(r["severity"], r["p_toxic"], r["toxic"]) for r in rows if r["text"] in same}) == 1
    assert all(0 <= r["p_toxic"] <= 1 and not r["toxic"] for r in rows)
