"""The pipeline's rows against a plain version of its five stages."""

import base64
import math
from collections import Counter, defaultdict

import public_tokenizers as P
from test_text_operators import SPACE, plain_classes, plain_targets

from pointloom.llm import secrets, toxicity


def test_pipeline(spark):
    import tiktoken

    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()

    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    reader = toxicity.Reader(model.index)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if model.score(reader.read((r["text"] or "").encode())[0])[0] < model.cut]
    cls = plain_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if cls[r["doc_id"]][0] == 0 or cls[r["doc_id"]][1] == r["doc_id"]]
    scan = secrets.Scanner(secrets.RULES)
    for r in rows:
        text, out, at = r["text"], [], 0
        for a, b, k in scan.spans([text.encode()])[0]:
            if a >= at:
                out += [text[at:a], f"[{secrets.RULES[k].kind}]"]
            at = max(at, b)
        r["text"] = "".join([*out, text[at:]])
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(SPACE.findall(r["text"]))
    target = plain_targets(sizes)
    times = Counter(r["doc_id"] for r in got)
    by_id = {r["doc_id"]: r for r in rows}
    assert set(times) <= set(by_id)
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert math.floor(rate - 1e-9) <= times[r["doc_id"]] <= math.ceil(rate + 1e-9)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in got:
        assert r["round_trip"] and r["ids"] == tik.encode_ordinary(by_id[r["doc_id"]]["text"]) and r["n_tokens"] == len(r["ids"])


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, empty, sf_dir):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for docs, n in ((odd.select(columns), 5), (empty.select(columns), 0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if i < 4:
                assert out.columns == columns
            # the repeated row and the one of a null id go from its class; mixing takes words three times at most
            assert out.count() == n - 2 * (i == 1 and n > 0) if i != 3 else out.count() <= 3 * n


def test_stages_with_long_texts_clashing_columns_and_secrets(spark, sf_dir):
    import corpus_pipeline

    long = " ".join(f"w{i % 977} {i:032x}" for i in range(60_000))
    rows = [(1, long, "en", "a", len(long), 1, "k"), (2, None, None, None, None, 2, "k"), (3, "password=hunter2hunter2 é", "en", "b", 24, 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, tie bigint, __text string")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["n-gram Jaccard join"](spark, docs, sf_dir).count() == 3
    clean = {r["doc_id"]: r for r in stages["secret scans"](spark, docs, sf_dir).collect()}
    assert clean[3]["text"] == "[assign] é" and clean[3]["n_chars"] == 10 and clean[2]["text"] is None and clean[2]["n_chars"] is None and clean[1]["text"].count("[hex]") == 60_000
    coded = {r["doc_id"]: r for r in stages["byte-level BPE encoding and decoding"](spark, docs, sf_dir).collect()}
    assert all(r["round_trip"] for r in coded.values()) and coded[2]["n_tokens"] == 0
