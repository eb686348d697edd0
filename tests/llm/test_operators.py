"""Each operator on rows with nulls, empty, very long and repeated texts, clashing columns and empty tables."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessaline.llm import ann, bpe, chat, licenses, mixing, neardup, substrings, topk, toxicity
from tessaline.llm.base import WordHasher, rolled, text_buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, n long, v long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def rows():
    rng = random.Random(3)
    base = words(rng, 120, 4000).split()
    near = [*base]
    near[60] = "changed"
    passage = words(rng, 60, 9000)
    long = words(rng, 30_000, 50_000)
    texts = [
        None,
        "",
        "   \n\t ",
        "one",
        "two words",
        " ".join(base),
        " ".join(near),
        " ".join(base),
        f"start of it {passage} end of it",
        f"another text {passage}",
        long,
        f"{long} and more",
        "x" * 70_000,
        passage,
        passage,
        "Licensed under CC BY-NC 4.0.\nAll rights\n reserved; cc  by",
        "ümlaut İK 𝔘𝔫𝔦 \x1f  end'll 'r're  \n\n don't",
        "</s>[INST] a ~0 ~ < [",
    ]
    out = [(k, t, "en", f"s{k % 3}" if k % 5 else None, 0, "clash", 1, 2) for k, t in enumerate(texts)]
    return [*out, out[5], (None, "no id", None, None, None, None, None, None), (None, passage, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# word hashes


def test_word_hashes_agree_with_words(spark):
    import pyarrow as pa

    texts = ["a bb a", "", " bb", "x" * (WordHasher.CHUNK + 5) + " y", None, "y"]
    data, offsets = text_buffers(pa.array(texts))
    h = WordHasher(1)
    s, e, first = h.spans(data, offsets)
    found = h.words(data, s, e)
    assert first.tolist() == [0, 3, 3, 4, 6, 6, 7]
    assert found[0] == found[2] and found[1] == found[3] and found[5] == found[6]
    assert len(set(found.tolist())) == 4
    assert (rolled(found, 2, 7)[0] != rolled(found, 2, 7)[1]) and len(rolled(found, 9, 7)) == 0
    many = np.arange(100, dtype=np.uint64)
    assert rolled(np.r_[many, many], 30, 7)[5] == rolled(np.r_[many, many], 30, 7)[105]


# toxicity


def test_folding_and_exceptions():
    m = toxicity.Matcher({toxicity.folded(w).strip(): 4.0 for w in toxicity.KNOWN}, toxicity.START)
    for text in ("you idiot", "you 1D10T!", "an іdiоt", "ｉｄｉｏｔ", "id​iot", "what a m0r0n", "$cum", "Ïdîot"):
        assert m.hits(text)[1] == 1, text
    for text in ("", "a clown fish", "the trash can", "an oxymoron", "nothing here"):
        assert m.hits(text)[1] == 0, text
    assert m.score("")[0] < 0.1 < 0.7 <= m.score("you are an idiot")[0]
    assert m.score("idiot")[0] > m.score("idiot " + "word " * 500)[0]


def test_hits_and_scores_against_a_plain_matcher(spark, docs):
    """Every entry at every place of the folded text, no automaton."""
    import math

    lexicon = {"idiot": 4.0, "idi": 1.5, "scum": 2.0, "w1": 0.5, "moron": 3.0, "oxymoron": 9.0, "start": 0.25}
    lexicon = {toxicity.folded(k).strip(): v for k, v in lexicon.items()}
    texts = ["you 1d10t idi idiots", "pond scum scum", "an oxymoron, a moron", "scum line of scum", "w1 w10 w11", "class clown idiot", ""]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    weights = (-3.0, 2.0, 0.7)
    got = sorted((str(r.doc_id), round(r.score, 12), r.hits) for r in toxicity.scored(d, lexicon, weights).collect())

    def plain(text):
        line = toxicity.folded(text or "")
        spans = [(i, i + len(p)) for p in {toxicity.folded(x).strip() for x in toxicity.EXCEPTIONS} for i in range(len(line)) if line.startswith(" " + p, i)]
        total = n = 0
        for i in range(len(line)):
            here = [w for e, w in lexicon.items() if line.startswith(" " + e, i) and not any(a <= i <= b for a, b in spans)]
            total, n = total + max(here, default=0.0), n + bool(here)
        z = weights[0] + weights[1] * math.log1p(total) + weights[2] * math.log1p(100 * total / max(len(line.split()), 20))
        return round(1 / (1 + math.exp(-z)), 12), n

    small = [(i, t) for i, t in ((r.doc_id, r.text) for r in d.collect())]
    assert got == sorted((str(i), *plain(t)) for i, t in small)


def test_toxicity_learns_from_its_fold_only(spark, tmp_path):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = words(rng, 40, 900) + (" " + " ".join(f"grumf{rng.randrange(999)}" for _ in range(3)) if toxic else "")
        docs.append((k, text))
        labels.append((k, 1, int(toxic)))
    docs += [(1000, None), (None, "grumf1 grumf2"), (1001, ""), (0, docs[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    truth = {k: t for k, _, t in labels}
    assert all(by[k].predicted == t for k, t in truth.items() if by[k].held_out)
    assert by[None].predicted == 1 and by[1000].predicted == 0 and by[1001].score == by[1000].score
    import zlib

    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in truth)
    # held-out labels turned round change nothing
    turned = [(k, q, 1 - t if by[k].held_out else t) for k, q, t in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/other/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert toxicity.model(spark, d, f"{tmp_path}/other") == toxicity.model(spark, d, str(tmp_path))


def test_toxicity_without_labels(spark, tmp_path, none):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    assert toxicity.model(spark, d, str(tmp_path))[1] == toxicity.START
    assert [r.doc_id for r in toxicity.clean(spark, d, str(tmp_path)).collect()] == [2]
    assert toxicity.clean(spark, none, str(tmp_path)).count() == 0


# mixing


def filled(sizes: dict, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Targets by resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_against_rounds(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op2_mixing(spark, str(tmp_path)).collect()
    again = mixing.op2_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows())
    source, sizes = {}, {}
    for r in rows():
        source.setdefault(r[0], r[3])
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    target = filled(sizes)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_taken_words_against_packing_by_hand(spark, docs):
    sizes = mixing.sized(docs)
    by = mixing.targets(sizes)
    slots = mixing.plan(sizes, by, block=64, shard=32)
    got = {}
    for r in mixing.segments(sizes, slots, block=64).collect():
        got[r.uid] = got.get(r.uid, 0) + ((r["to"] - r["from"]) if r["to"] is not None else 0)
    low = lambda v: (v is not None, v or 0)
    order = sorted(sizes.collect(), key=lambda r: (r.place % 64, low(r.doc_id), r.place, r.uid))
    words = {}
    for r in order:
        words.setdefault(r.source, []).extend([r.uid] * r.size)
    want = {r.uid: 0 for r in order}
    for r in slots.collect():
        for uid in words[r.source][r.block * 64 : r.block * 64 + r.words]:
            want[uid] += 1
    assert got == want and max(want.values()) > 64


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 500}, {"é": 7, "z": 0, "a": 0}, {"a": 0}])
def test_targets(spark, sizes):
    d = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(d).collect()}
    assert got == pytest.approx(filled(sizes))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        d = spark.range(n).select(mixing.shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p"))
        assert sorted(r.p for r in d.collect()) == list(range(n))


def test_slots_make_up_the_want(spark):
    sizes = spark.createDataFrame([(k, k, f"s{k % 2}", 700 + k) for k in range(40)], "uid long, doc_id long, source string, size long")
    by = mixing.targets(sizes)
    p = mixing.plan(sizes, by, block=64, shard=32).groupBy("source").agg(F.sum("words").alias("w"), F.count("*").alias("n"), F.countDistinct("round", "block").alias("d"))
    want = {r.source: round(r.target) for r in by.collect()}
    got = p.collect()
    assert {r.source: r.w for r in got} == want and all(r.n == r.d for r in got)


def test_mixed_texts(spark, docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    got = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.source] = got.get(r.source, 0) + len(split(r.text))
    target = filled(sizes)
    assert all(abs(got.get(s, 0) - target[s]) <= 1 for s in sizes)


def test_mixing_nothing(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op2_mixing(spark, str(tmp_path)).count() == 0
    assert mixing.mixed(none).count() == 0


# licenses


def test_license_places_and_labels(spark, docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[15]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (12, 3, 2, 10, "cc-by,reserved")
    assert r.labels == "cc-by,cc-by-nc-4.0,reserved" and r.score == 1.0
    for k in (0, 1, 2):
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].labels, got[k].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(docs).count() == len(rows()) and licenses.scan(none).count() == 0


def test_containment_against_brute_force(spark):
    rng = random.Random(5)
    sets = licenses.template_sets()
    vocabulary = sorted({w for _, ws in sets for w in ws})
    texts = []
    for k in range(300):
        label, ws = rng.choice(sets)
        some = [w for w in ws if rng.random() > 0.06] + rng.sample(vocabulary, rng.randrange(6)) + [f"x{rng.randrange(50)}"]
        rng.shuffle(some)
        texts.append((k, " ".join(some)))
    got = {(r.uid, r.label, round(r.containment, 9)) for r in licenses.matches(licenses.scanned(spark.createDataFrame(texts, "doc_id long, text string"), None, "doc_id", "text").select(F.col("doc_id").alias("uid"), F.posexplode("blocks").alias("block", "tokens"))).collect()}
    want = {(k, label, round(len(set(ws) & set(t.split())) / len(ws), 9)) for k, t in texts for label, ws in sets if len(set(ws) & set(t.split())) >= np.ceil(0.9 * len(ws) - 1e-9)}
    assert got == want and want


def test_statements_wrapped_anywhere(spark):
    texts, want = [], []
    for label, text in licenses.TEMPLATES:
        words = text.split()
        for at in range(1, len(words)):
            texts.append((len(texts), "some prose before\n# " + " ".join(words[:at]) + "\n# " + " ".join(words[at:]) + " and more\nafter"))
            want.append(label)
    # words of a statement that are far from each other make none
    texts.append((len(texts), "all of it\n" + "x " * 30 + "rights\n" + "y " * 30 + "reserved"))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, label in enumerate(want)) and got[len(want)] == [""]


# repeated passages


def cut(documents, n):
    """Brute force: id, removed, kept words of each row."""
    first = {}
    for k, t in documents:
        w = split(t)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, k), k)
    out = []
    for k, t in documents:
        w, gone = split(t), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < k:
                gone |= set(range(i, i + n))
        out.append((k, len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings_of_all_kinds(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id if r.doc_id is not None else 2**63 - 1, r.n_removed, r.kept_sha256, r.n_words) for r in substrings.op5_substrings(spark, str(tmp_path)).collect()))
    pairs = [(2**63 - 1 if r[0] is None else r[0], r[1]) for r in rows()]
    want = sorted((k, n, hashlib.sha256(kept.encode()).hexdigest(), len(split(t))) for (k, n, kept), (_, t) in zip(cut(pairs, 50), pairs, strict=True))
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_substrings_random(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, 12, 6) for _ in range(6)]
    documents = [(k, " ".join(rng.choice(pool) if rng.random() < 0.6 else words(rng, rng.randrange(9), 6) for _ in range(rng.randrange(7)))) for k in range(80)]
    rng.shuffle(documents)
    keyed = substrings._keyed(spark.createDataFrame(documents, "doc_id long, text string").repartition(4))
    got = {r.id: (r.removed, r.kept) for r in substrings.cut_documents(keyed, 10).collect()}
    want = {k: (n, kept) for k, n, kept in cut(documents, 10) if n}
    assert got == want and want


def peak(run, batch) -> int:
    """Bytes that a mapped function holds at most over one batch."""
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


@pytest.mark.parametrize("step, columns", [(lambda: substrings._probed(50, 64, 64), ["rid", "text"]), (lambda: substrings._digests, ["id", "rid", "text"])], ids=["windows", "digests"])
def test_substrings_memory_follows_portions(step, columns):
    """A batch has 512 rows however long they are: what a task holds must not grow with the length of its texts."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{x:06d}" for x in rng.integers(0, 10**6, 10_000)) for _ in range(240)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(240), pa.int64()), "rid": pa.array(range(240), pa.int64()), "text": pa.array(texts)})
    run, batch = step(), batch.select(columns)
    assert peak(run, batch) < 1.5 * peak(run, batch.slice(0, 60))


def test_substrings_across_portions(spark, tmp_path):
    """A batch whose texts are worked in several portions, passages shared within and across them."""
    rng = random.Random(6)
    long = lambda n: " ".join("x" * 190 + str(rng.randrange(10**6)) for _ in range(n))
    pool = [long(70) for _ in range(8)]
    documents = [(k, f"{long(rng.randrange(300))} {rng.choice(pool)} {long(rng.randrange(300))}" if k % 7 else None) for k in range(100)]
    assert sum(len(t or "") for _, t in documents) > 1.2 * substrings.PORTION
    spark.createDataFrame(documents, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256, r.n_words) for r in substrings.op5_substrings(spark, str(tmp_path)).collect())
    want = [(k, n, hashlib.sha256(kept.encode()).hexdigest(), len(split(t))) for (k, n, kept), (_, t) in zip(cut(documents, 50), documents, strict=True)]
    assert got == want and sum(n > 0 for _, n, _, _ in want) > 50


def test_without_repeats_keeps_columns(spark, docs, none):
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    assert got[8] == rows()[8][1] and got[9] == "another text" and 14 not in got and got[0] is None
    assert substrings.without_repeats(none).count() == 0


# near duplicates


def grouped(documents, n, share):
    """Brute force: component of each id, and the set sizes of rows."""
    sets = []
    for k, t in documents:
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((k, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    label = {k: k for k, _ in sets}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 100 * share * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {k: find(k) for k, _ in sets}, sorted((k, len(s)) for k, s in sets)


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_random(spark, seed):
    rng = random.Random(seed)
    documents, k = [], 0
    for _ in range(25):
        base = words(rng, rng.randrange(1, 160), 3000).split()
        for _ in range(rng.randrange(1, 9)):
            copy = [w if rng.random() > rng.choice([0, 0.02, 0.06]) else f"e{rng.randrange(9999)}" for w in base]
            documents.append((k, " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
            k += 1
    documents = [(k, t.replace("W", "w")) for k, t in documents]
    rng.shuffle(documents)
    got = neardup.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), 4).collect()
    component, sizes = grouped(documents, 4, 0.8)
    assert {r.doc_id: r.component_id for r in got} == component
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_all_kinds(spark, docs, none):
    got = neardup.near_duplicates(docs, 4).collect()
    assert len(got) == len(rows())
    some = [(r[0], r[1]) for r in rows() if r[0] is not None]
    component, sizes = grouped(some, 4, 0.8)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == component
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert neardup.near_duplicates(none).count() == 0
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {None} | {k for k, c in grouped(some, 5, 0.8)[0].items() if k == c}


def test_near_duplicates_of_long_lists(spark, monkeypatch):
    """Many documents around one template: a shingle that all have, lists dealt into chunks, values held in parts."""
    monkeypatch.setattr(neardup, "CHUNK", 5)
    monkeypatch.setattr(neardup, "HELD", 3000)
    rng = random.Random(4)
    template, documents = words(rng, 70, 3000).split(), []
    for k in range(160):
        body = words(rng, 60, 9000).split() if k % 4 else []
        own = [w if rng.random() > 0.02 else f"e{rng.randrange(9999)}" for w in template]
        documents.append((k, " ".join(own + body[: rng.choice([3, 8, 12, 16, 60])])))
    documents += [(200 + k, " ".join([*template[:50], *words(random.Random(k // 2), 40, 5000).split()])) for k in range(60)]
    rng.shuffle(documents)
    got = neardup.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string").repartition(4), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == grouped(documents, 4, 0.8)[0]


def test_near_duplicates_white_space(spark):
    documents = [(1, "a\rb\x0cc\x0bd e\tf g"), (2, "a b c d e f g"), (3, "a\x1cb c d e f g"), (4, "a b\x0c"), (5, "\x0bA  b"), (6, "\r\x0c\x0b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(documents, "doc_id long, text string"), 4).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (3, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_near_duplicates_sql_agrees(spark, tmp_path):
    import duckdb

    documents = [(k, t) for k, t in {r[0]: r[1] for r in rows() if r[0] is not None}.items() if len(t or "") < 5000] + [(50, "a\rb\x0cc\x0bd e\tf g"), (51, "a b c d e f g"), (52, "a\x1cb c d e f g")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"select doc_id, n_shingles, component_id, kept from ({neardup.OP6_SQL})").fetchall())
    assert sorted(tuple(r) for r in neardup.op6_neardup(spark, str(tmp_path)).collect()) == want


# tokens


def test_bpe_as_the_library(spark, docs):
    import public_tokenizers as P
    import tiktoken

    rank_file = P.path("byte_bpe_50k.tiktoken")
    code = bpe.codec(rank_file, P.PATTERN, 16, 2)
    rng = random.Random(2)
    alphabet = "ab 'rev\n\t  1é𝔘.,!?　ll"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)] + [r[1] or "" for r in rows()]
    for t in texts:
        ids = code.encode(t)
        assert ids == code.tokens.encode_ordinary(t), t[:100]
        assert code.decode(ids) == t.encode()
    assert isinstance(code.tokens, tiktoken.Encoding)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, rank_file, P.PATTERN).collect()}
    want = set()
    for r in rows():
        ids = code.tokens.encode_ordinary(r[1] or "")
        want.add((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == want
    back = bpe.decode(bpe.encode(docs, rank_file, P.PATTERN), rank_file, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r[1] or "").encode() for r in rows())


def test_bpe_nothing(spark, none):
    import public_tokenizers as P

    assert bpe.digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# chats


def test_chat_round_trip(spark):
    rows_ = [(1, 1, "assistant", "~0 <|end|>~ [x]"), (1, 0, "user", "<|turn|>a\nb"), (1, None, "tool\n<", None), (2, 0, None, ""), (None, 5, "assistant", "é\n𝔘"), (1, 1, "assistant", "~0 <|end|>~ [x]")]
    d = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    f = {r.conv_id: r for r in chat.formatted(chat.canonical(d)).collect()}
    turns = chat.read_turns(f[1].formatted)
    assert turns == [("user", "<|turn|>a\nb"), ("assistant", "~0 <|end|>~ [x]"), ("assistant", "~0 <|end|>~ [x]"), ("tool\n<", "")]
    assert [chat.unescape(f[1].formatted[s.start : s.end]) for s in f[1].loss_spans] == ["~0 <|end|>~ [x]"] * 2
    b = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(d))).collect()}
    assert b[None].loss_chars == 3 and b[None].loss_sha256 == hashlib.sha256("é\n𝔘".encode()).hexdigest()
    assert b[2].n_turns == 1 and b[2].loss_chars == 0
    assert chat.read_back(chat.formatted(chat.canonical(d.limit(0)))).count() == 0


def test_chat_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    frames = [
        spark.createDataFrame([(1, "q", "a", 0)], "conv_id long, prompt string, completion string, other int"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from:string,value:string>>"),
        spark.createDataFrame([(1, "q", None, "a")], "conv_id long, instruction string, input string, output string"),
    ]
    for f in frames:
        assert [(t.role, t.text) for t in chat.canonical(f).first().turns] == want
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, 2)], "a int, b int"))
    records = ['{"conv_id": 1, "prompt": "q", "completion": "a", "x": {"y": 1}}', '{"conv_id": 2, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "{}", "no json", None]
    got = chat.canonical_json(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [[(t.role, t.text) for t in r.turns] if r.turns is not None else None for r in got] == [want, want, want, None, None, None]


def test_chat_odd_records(spark):
    """Each odd record has its defined result and none ends the job."""
    ok = '{"role": "user", "content": "q"}'
    cases = [
        ('{"conv_id": 1, "messages": [%s, null]}' % ok, 1, [("user", "q")]),
        ('{"conv_id": 1, "messages": [%s, "a"]}' % ok, None, None),
        ('{"conv_id": 1, "messages": [%s, 3]}' % ok, None, None),
        ('{"conv_id": 1, "messages": []}', 1, []),
        ('{"conv_id": 1, "messages": [null, null]}', 1, []),
        ('{"conv_id": 1, "messages": null}', None, None),
        ('{"conv_id": 1, "messages": ["a"]}', None, None),
        ('{"conv_id": 123456789012345678901234567890, "prompt": "q", "completion": "a"}', None, [("user", "q"), ("assistant", "a")]),
        ('{"conv_id": true, "prompt": "q", "completion": null}', None, [("user", "q"), ("assistant", "")]),
        ('{"conv_id": "12", "prompt": 5, "completion": false}', 12, [("user", "5"), ("assistant", "false")]),
        ('{"conv_id": "twelve", "query": "q", "response": "a"}', None, [("user", "q"), ("assistant", "a")]),
        ('{"conv_id": 1.5, "question": "q", "answer": "a"}', None, [("user", "q"), ("assistant", "a")]),
        ('{"conv_id": 2, "messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}]}', 2, [("user", "qr")]),
        ('{"conv_id": 2, "messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a"}]}', 2, [("user", "q"), ("assistant", "a")]),
        ('{"conv_id": 2, "prompt": "\\ud800", "completion": "a"}', 2, [("user", "?"), ("assistant", "a")]),
        ('{"None": [], "conv_id": 1}', None, None),
        ("[1, 2]", None, None),
        ("[" * 100_000, None, None),
        ("5", None, None),
    ]
    d = spark.createDataFrame([(k, r) for k, (r, _, _) in enumerate(cases)], "k int, record string").coalesce(1)
    got = chat.canonical_json(d.orderBy("k")).collect()
    for (record, conv_id, turns), r in zip(cases, got, strict=True):
        assert r.conv_id == conv_id, record
        assert (None if r.turns is None else [(t.role, t.text) for t in r.turns]) == turns, record
    f = spark.createDataFrame([("x", [None, ("user", [("text", "q"), ("text", "r")])])], "conv_id string, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [(r.conv_id, [(t.role, t.text) for t in r.turns]) for r in chat.canonical(f).collect()] == [(None, [("user", "qr")])]


def test_chat_very_long_and_repeated(spark):
    long = "[<~\n" * 300_000
    d = spark.createDataFrame([(1, k, "assistant", long if k == 0 else f"t{k % 3}") for k in range(3000)] * 2, "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.formatted(chat.canonical(d))).first()
    want = "".join([long, long] + [x for k in range(1, 3000) for x in [f"t{k % 3}"] * 2])
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (6000, len(want), hashlib.sha256(want.encode()).hexdigest())


# vectors


def vectors(seed=0, n=300, dim=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, dim)), 2)
    out = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    out += [(n + k, list(out[100][1])) for k in range(30)]
    bad = [(1000, None), (1050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, [2.0, 3.0]), (1201, [1.0, 3.0]), (150, out[150][1]), (1250, []), (1300, [0.0] * 6)]
    return out + bad


def test_top_k_against_brute_force(spark):
    v = vectors()
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).repartition(3)
    got = {}
    for r in topk.top_k(d, F.col("id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {k: [int(np.floor(256 * a)) for a in x] for k, x in v if k is not None and x is not None and all(a is not None and np.isfinite(a) for a in x)}
    for q, x in good.items():
        if q % 50:
            continue
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), k) for k, y in good.items() if k != q and len(y) == len(x))[:5]
        assert sorted(got.get(q, [])) == [(r, k, -s) for r, (s, k) in enumerate(best, 1)], q
    assert topk.top_k(d.limit(0), F.col("id") % 50 == 0, 5).count() == 0


def test_large_products_are_exact(spark):
    v = [(0, [2.0**40, 1.0]), (1, [2.0**20, 3.0]), (2, [-1.0, 2.0**10])]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("id") == 0, 5).collect()}
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert got == {(0, 1): wrap(2**48 * 2**28 + 256 * 768), (0, 2): wrap(-(2**48) * 256 + 256 * 2**18)}


def test_nearest_neighbours(spark):
    v = vectors(1, 600, 8)
    v = [(k, x if x is None or len(x) != 6 else [*x, 0.0, 0.0]) for k, x in v]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash")).repartition(3)
    got = {}
    for r in ann.nearest(d, F.col("id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    good = {k: np.array(x) for k, x in v if k is not None and x is not None and all(a is not None and np.isfinite(a) for a in x) and any(x)}
    hits = total = 0
    for q, x in good.items():
        if q % 20:
            continue
        best = sorted((float(np.sqrt(((x - y) ** 2).sum())), k) for k, y in good.items() if k != q and len(y) == len(x))[:10]
        hits += len({k for _, k in best} & set(got.get(q, {})))
        total += len(best)
        for k, (_, s) in got.get(q, {}).items():
            assert s == pytest.approx(np.sqrt(((x - good[k]) ** 2).sum()), rel=1e-12)
        ranked = sorted((r, s, k) for k, (r, s) in got.get(q, {}).items())
        assert [r for r, _, _ in ranked] == list(range(1, len(ranked) + 1)) and [(s, k) for _, s, k in ranked] == sorted((s, k) for _, s, k in ranked)
    assert hits / total >= 0.9
    assert ann.nearest(d.limit(0), F.col("id") % 20 == 0, 10).count() == 0


def _lists(spark, x):
    """The share of true neighbours in the lists that NN-descent finds."""
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in ann.neighbour_graph(ann.nodes_of(rows, 10)).collect():
        got.setdefault(r.a, set()).add(r.b)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.mean([len(set(np.argsort(d[k])[:10].tolist()) & got.get(k, set())) / 10 for k in range(len(x))])


def test_neighbour_lists_beside_a_huge_vector(spark):
    x = np.random.default_rng(2).standard_normal((700, 6))
    x[0] *= 1e12
    assert _lists(spark, x) >= 0.95


def test_neighbour_lists_of_near_copies(spark):
    x = 1 + 1e-6 * np.random.default_rng(3).standard_normal((700, 6))
    assert _lists(spark, x) >= 0.95


def test_search_reads_a_small_share(spark, caplog):
    """Random directions, the hardest case: the graph gives the recall, the search scores a few per cent of the nodes."""
    n, rng = 20_000, np.random.default_rng(5)
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    with caplog.at_level("INFO", logger="tessaline.llm.ann"):
        got = {}
        for r in ann.nearest(d, F.col("id") % 100 == 0, 10).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    queries, visits = next(r.args for r in reversed(caplog.records) if r.msg.startswith("width"))[4:6]
    assert visits <= 0.05 * n * queries
    hits = 0
    for q in range(0, n, 100):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & got[q])
    assert queries == n // 100 and hits >= 0.9 * 10 * queries


def test_search_goes_on_until_its_recall(spark):
    # a ring: each node knows the next one only, so a fixed number of steps from 0 ends before the far side
    n = 60
    x = [(k, [float(np.cos(2 * np.pi * k / n)), float(np.sin(2 * np.pi * k / n))]) for k in range(n)]
    nodes = ann.nodes_of(spark.createDataFrame(x, "id long, x array<double>"), 10)
    graph = spark.createDataFrame([(k, (k + 1) % n, 0.01) for k in range(n)], "a long, b long, d double")
    asked = spark.createDataFrame([(0, 0, x[0][1])], "id long, node long, x array<double>")
    got = {r.vec_id for r in ann.search(nodes, graph, asked, 20, beam=2).collect()}
    assert got == {k % n for k in range(-10, 11)} - {0}


def _found(spark, rows, k=10, every=100):
    d = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(d, F.col("id") % every == 0, k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    return {q: [i for _, i in sorted(r)] for q, r in got.items()}


def test_search_moves_answers_of_shards_and_not_visits(spark, monkeypatch):
    n, rng, rows = 3000, np.random.default_rng(11), 0
    x = rng.standard_normal((n, 16))
    kept = ann.written

    def counted(df, kind="cut"):
        nonlocal rows
        out = kept(df, kind)
        rows += out.count()
        return out

    monkeypatch.setattr(ann, "SMALL", 1000, raising=False)
    monkeypatch.setattr(ann, "written", counted)
    got = _found(spark, enumerate(x))
    hits = 0
    for q in range(0, n, 100):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & set(got[q]))
        assert len(got[q]) == len(set(got[q]) - {q}) == 10
    assert hits >= 0.9 * 10 * 30
    # nodes, queries, and from each of three shards what each query and each of the sample found
    assert rows <= n + 30 + 3 * 2 * 30 * 20


def test_near_copies_in_all_shards_are_found(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 16))
    x[7:4000:133] = x[0] + 1e-7 * rng.standard_normal((len(x[7:4000:133]), 16))
    monkeypatch.setattr(ann, "SMALL", 1000, raising=False)
    got = _found(spark, enumerate(x))
    assert len(set(got[0]) & set(range(7, 4000, 133))) == 10


def test_an_id_with_many_vectors_still_has_all_its_neighbours(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((1500, 8))
    own = [(0, x[0] + 1e-3 * rng.standard_normal(8)) for _ in range(60)]
    first = min((x[0].tolist(), *(v.tolist() for _, v in own)))
    got = _found(spark, [*enumerate(x), *own], every=2000)
    far = ((x - np.array(first)) ** 2).sum(1)
    far[0] = np.inf
    assert len(got[0]) == 10 and len(set(np.argsort(far)[:10].tolist()) & set(got[0])) >= 9


def test_recall_is_measured_on_the_sample_and_can_be_driven_to_all(spark, monkeypatch, caplog):
    n, rng = 2500, np.random.default_rng(14)
    x = rng.standard_normal((n, 24))
    monkeypatch.setattr(ann, "SMALL", 1000)
    nodes = ann.nodes_of(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>"), 10)
    asked = nodes.where("node % 50 = 0").select(F.col("node").alias("id"), "node", "x")
    with caplog.at_level("INFO", logger="tessaline.llm.ann"):
        got = {}
        # no recall is 1.1, so all is scored
        for r in ann.search(nodes, None, asked, 10, goal=1.1, probes=20).collect():
            got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    recall, due, queries, visits = next(r.args for r in reversed(caplog.records) if r.msg.startswith("width"))[2:6]
    assert (recall, due, queries, visits) == (1.0, 20 * 10, 50, 50 * n)
    for q in range(0, n, 50):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        assert [got[q][k] for k in range(1, 11)] == np.argsort(far)[:10].tolist()


def test_a_walk_scores_a_place_once(spark):
    x = np.random.default_rng(15).standard_normal((400, 5))
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, 1:9]
    shard = ann._Shard(x, x.astype(np.float32), ann._edges(near))
    keys, visits = shard.walk(x[:7], np.tile([3, 3, 9], (7, 1)), 400)
    assert all(len(set(ann._places(row[row != ann.NONE]).tolist())) == v for row, v in zip(keys, visits.tolist(), strict=True)) and (visits <= 400).all()
