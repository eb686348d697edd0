"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: lower case; homoglyphs and accented letters become plain letters, digits and signs the letters they stand
for, invisible characters go, everything else becomes a blank. As `1`, `l` and `|` stand for `i` as well as `l`, the
letter l is folded to i, in the lexicon too. Entries are word beginnings: each pattern starts with a blank.

The lexicon holds known insults and word beginnings learned from labelled rows: those that are far likelier under
label 1, by a likelihood ratio; an entry goes where a shorter one does as well. Weights are smoothed log odds. The
score is a logistic function of the summed weights, their share of the text's length, and a bias, fitted to the same
rows. Hits inside an exception phrase don't count.

Only the fit is bounded: it uses labelled rows whose hash falls into a range that holds about `SAMPLE` rows. Null and
empty texts have no hits and get the score of such a text. Ids may repeat and rows with them; every row is scored. A
null id is held out of nothing (it can't be labelled). Labels, lang and source are never inputs of a score. Without
labels of both kinds the known insults keep weight `KNOWN_WEIGHT` and the score the weights `START`.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.base import small_batches, table

#: Labelled rows in the fit, about.
SAMPLE = 6000
#: Letters in a learned word beginning.
SHORTEST, LONGEST = 4, 8
#: Least likelihood ratio of a learned entry (natural log, over distinct words of rows), the share of label 1 among
#: the rows that hold it, and how many such rows there are at least: so many, and that share of all with label 1.
RATIO, PURITY, ROWS, ROWS_SHARE = 16.0, 0.9, 3, 0.02
KNOWN_WEIGHT = 4.0
#: bias, of the log of summed weights, of the log of summed weights a hundred words.
START = (-4.0, 2.5, 1.0)
THRESHOLD = 0.7

# Insults that need no learning, phrases in which they are harmless, homoglyphs, substitutions.
KNOWN = ["idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser", "clown", "trash", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "scumbag", "filth"]
EXCEPTIONS = ["clown fish", "clownfish", "trash can", "trash bin", "trash bag", "trash collection", "class clown", "circus clown", "pond scum", "scum line", "oxymoron", "sore loser", "worthless check", "filthy rich"]
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o", "ⅼ": "l", "ⅰ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿͏"


class _Fold(dict):
    """What str.translate asks for each character, found once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE or unicodedata.combining(c):
            out = ""
        else:
            plain = HOMOGLYPHS.get(c) or "".join(HOMOGLYPHS.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(SUBSTITUTES.get(x, x if x.isalpha() else " ") for x in plain)
        self[code] = out
        return out


_fold = _Fold()


def folded(text: str) -> str:
    return " " + text.lower().translate(_fold)


class Matcher:
    def __init__(self, lexicon: dict[str, float], weights: tuple[float, ...]):
        import ahocorasick

        self.weights, self.automaton = weights, ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(f" {entry}", (weight, len(entry) + 1))
        for phrase in {folded(p).strip() for p in EXCEPTIONS}:
            self.automaton.add_word(f" {phrase}", (None, len(phrase) + 1))
        self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[float, int, int]:
        """Summed weights, number of hits and of words."""
        line = folded(text)
        found = [(end - n + 1, end, w) for end, (w, n) in self.automaton.iter(line)]
        words = len(line.split())
        if not found:
            return 0.0, 0, words
        safe = [(a, b) for a, b, w in found if w is None]
        best: dict[int, float] = {}  # the heaviest entry of each word counts
        for a, _, w in found:
            if w is not None and not any(x <= a <= y for x, y in safe):
                best[a] = max(best.get(a, 0.0), w)
        return sum(best.values()), len(best), words

    def features(self, text: str) -> tuple[float, float, float]:
        total, _, words = self.hits(text)
        return 1.0, math.log1p(total), math.log1p(100.0 * total / max(words, 20))

    def score(self, text: str) -> tuple[float, int]:
        total, n, words = self.hits(text)
        z = sum(w * x for w, x in zip(self.weights, (1.0, math.log1p(total), math.log1p(100.0 * total / max(words, 20))), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z)))), n


def beginnings(text: str) -> Counter:
    """Of how many distinct words each is the beginning."""
    return Counter(w[:n] for w in set(folded(text).split()) for n in range(SHORTEST, min(LONGEST, len(w)) + 1))


def sampled_labels(labels: DataFrame, held_out) -> DataFrame:
    """doc_id and label of about SAMPLE labelled rows that aren't held out, picked by a hash of the id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = rows.count()
    if n > SAMPLE:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * SAMPLE / n))
    return rows


def learned(rows: DataFrame) -> dict[str, float]:
    """Lexicon entries from text and label of the sample: counts by rows, over all words of whole texts.

    An entry is in ROWS_SHARE of the sample's rows with label 1 at least, so there are no more than 1 / ROWS_SHARE times
    the beginnings of such a row, however large the input.
    """

    def count(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in beginnings(text or "").items():
                    x = seen[w]
                    x[label] += 1
                    x[2 + label] += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4))], names=["entry", "neg", "pos", "neg_words", "pos_words"])

    rows = rows.dropDuplicates(["text", "label"])
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    share = n[1] / (n[0] + n[1])
    kinds = ["neg", "pos", "neg_words", "pos_words"]
    counts = rows.select("text", F.col("label").cast("int")).mapInArrow(count, "entry string, " + ", ".join(f"{k} bigint" for k in kinds)).groupBy("entry").agg(*(F.sum(k).alias(k) for k in kinds))
    pure = F.col("pos") / (F.col("pos") + F.col("neg"))
    p = F.col("pos_words") / (F.col("pos_words") + F.col("neg_words"))
    ratio = F.col("pos_words") * F.log(p / share) + F.when(p < 1, F.col("neg_words") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    top = counts.where((F.col("pos") >= max(ROWS, ROWS_SHARE * n[1])) & (pure >= PURITY)).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO).select("entry", "pos", "neg").collect()
    found: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r["entry"]), r["entry"])):
        if not any(r["entry"][:k] in found for k in range(SHORTEST, len(r["entry"]))):
            found[r["entry"]] = math.log(((r["pos"] + 0.5) / (n[1] + 1)) / ((r["neg"] + 0.5) / (n[0] + 1)))
    return found


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton's method, drawn towards START."""
    start = np.array(START)
    w = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(round(v, 9)) for v in w)


def fit(docs: DataFrame, labels: DataFrame, held_out, text_col: str = "text") -> tuple[dict[str, float], tuple[float, ...]]:
    """Lexicon and weights. labels: doc_id and label. held_out: a condition on doc_id."""
    small_batches(docs.sparkSession)
    lexicon = {folded(w).strip(): KNOWN_WEIGHT for w in KNOWN}
    sample = sampled_labels(labels, held_out)
    # at most a few hundred kB, whatever the input
    rows = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label").cache()
    try:
        lexicon |= learned(rows)
        matcher_parts = (dict(lexicon), START)

        def measure(batches):
            m = Matcher(*matcher_parts)
            for batch in batches:
                got = [m.features(t or "") for t in batch.column(0).to_pylist()]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[1] for g in got]), pa.array([g[2] for g in got]), batch.column(1).cast(pa.int64())], names=["a", "b", "label"])

        seen = rows.select("text", F.col("label").cast("long")).mapInArrow(measure, "a double, b double, label bigint").groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        rows.unpersist()
    if len({r["label"] for r in seen}) < 2:
        return lexicon, START
    seen = sorted((r["a"], r["b"], r["label"], r["n"]) for r in seen)
    x = np.array([(1.0, a, b) for a, b, _, n in seen for _ in range(n)])
    y = np.array([float(label) for _, _, label, n in seen for _ in range(n)])
    return lexicon, fitted(x, y)


def scored(docs: DataFrame, lexicon: dict[str, float], weights: tuple[float, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and hits of every row."""
    small_batches(docs.sparkSession)
    parts = (lexicon, weights)

    def run(batches):
        m = Matcher(*parts)
        for batch in batches:
            got = [m.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "score", "hits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double, hits bigint")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[dict[str, float], tuple[float, ...]]:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return fit(docs, labels, held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, *model(spark, docs, sf_dir))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below THRESHOLD; columns as they are."""
    small_batches(spark)
    parts = model(spark, docs, sf_dir)

    # only texts go to Python; whole rows stay where they are
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Matcher(*parts)
        for batch in texts:
            yield pa.array([m.score(t or "")[0] for t in batch.to_pylist()], pa.float64())

    return docs.where(score("text") < THRESHOLD)
