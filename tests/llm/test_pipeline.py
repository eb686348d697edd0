"""The pipeline's stages, each on its own input, against brute force."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, cut, filled, grouped, split, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("pipeline")), random.Random(7)
    passage, out, labels = words(rng, 70, 9000), [], []
    for k in range(240):
        text = words(rng, rng.randrange(20, 160), 3000)
        if k % 6 == 0:
            text += " " + " ".join(f"grumf{rng.randrange(99)} you idiot" for _ in range(3))
        if k % 10 == 3:
            text = f"{text} {passage} {words(rng, 5)}"
        if k % 8 == 5:
            text = " ".join(w if rng.random() > 0.01 else "edited" for w in (out[-4][1] or "").split())
        out.append((k, None if k == 17 else text, "en", f"s{k % 4}" if k % 9 else None, 0, "x", 1, 2))
        labels.append((k, 1, int("idiot" in text)))
    spark.createDataFrame(out, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "near duplicates" in names
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{folder}/stage{k}")
            out = docs = spark.read.parquet(f"{folder}/stage{k}")
            after = [(r.doc_id, r.text, r.source) for r in out.collect()]
        if k == 0:
            assert sorted(a[0] for a in after) == sorted(i for i, t, _ in before if "idiot" not in (t or ""))
        if k == 1:
            component, _ = grouped([(i, t) for i, t, _ in before], 5, 0.8)
            assert sorted(a[0] for a in after) == sorted(i for i, c in component.items() if i == c) and len(after) < len(before)
        if k == 2:
            want = {}
            source_text = {i: t for i, t, _ in before}
            for i, n, kept in cut([(i, t) for i, t, _ in before], 50):
                if not n:
                    want[i] = source_text[i]
                elif kept:
                    want[i] = kept
            assert {i: t for i, t, _ in after} == want and any(source_text[i] != t for i, t in want.items())
        if k == 3:
            sizes, got = {}, {}
            for _, t, s in before:
                sizes[s] = sizes.get(s, 0) + len(split(t))
            for _, t, s in after:
                got[s] = got.get(s, 0) + len(split(t))
            assert all(abs(got.get(s, 0) - t) <= 1 for s, t in filled(sizes).items())
            known = {i: split(t) for i, t, _ in before}
            assert all(set(split(t)) <= set(known[i]) and len(split(t)) <= 2 * len(known[i]) for i, t, _ in after)
        if k == 4:
            import public_tokenizers as P

            from tessaline.llm import bpe

            code = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
            want = {(i, hashlib.sha256(np.array(code.tokens.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in before}
            assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == want
        before = after


def test_run(spark, folder):
    a, b = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert a == b and a


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
