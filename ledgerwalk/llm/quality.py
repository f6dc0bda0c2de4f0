"""Quality classifier from weak labels.

1. Overlapping labellers vote good, bad or nothing on every document: the
   human labels where there are some, and heuristics for symbol junk, table
   debris, shouting, repetition and abuse (a share of all words, whatever the length).
2. Expectation-maximisation over the counts of vote patterns (at most 3 to the
   number of labellers, whatever the corpus size) estimates how often each
   labeller casts each vote on bad and on good documents; that gives every
   pattern the probability of being bad.
3. These posterior labels train a hashed linear scorer: words, hashed to
   ``BUCKETS``, and structural marks, weighted by the log-odds between bad and
   good.  In a score a word counts whole if it is one of every ``WORD_SPAN`` words at
   least, and less the rarer it is in the text.  Words of one stem (the first ``STEM``
   letters) are a feature of their own where one of every ``STEM_SPAN`` words has it, up
   to twice as much where three or more do: abuse comes in many forms, each of them rare.  A structural mark of fewer than ``MIN_BAD`` documents
   rejects; of more, it weighs what was learned, or nothing.  Only marks of bad documents that are large and significant are
   kept, so rare words add no noise.  A group of copies does not count as many: of
   equal texts with equal votes one is read, and of near copies (``SIMILAR`` of their
   5-word shingles, by minhashes) with equal votes one counts.  Of the distinct texts
   that have a vote, training reads about ``SAMPLE`` at most, chosen by a hash of the
   text; votes, patterns and scores cover every document.
4. A document is rejected if its score is above ``THRESHOLD``.

Null or empty texts have no words; only the bias counts and they are kept
unless labelled patterns say otherwise.  Repeated rows get equal results.
Labels with null in both columns are no vote; of repeated labels the worst
counts.  Without documents, or with fewer than ``MIN_BAD`` labelled good to compare
with, the heuristics' own marks decide where nothing is learned.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored
from .shingles import chunks, mix, shingle_sets

BUCKETS = 1 << 22
SAMPLE = 20_000
#: Near copies share so much of their shingles, as far as HASHES minhashes tell
#: (a standard error of 0.035); they are looked for by runs of ROWS of them.
SIMILAR = 0.8
HASHES, ROWS = 128, 4
#: Log-odds that a document must reach to be rejected: more than one word of
#: the least evidence gives, less than one word that is well attested.
THRESHOLD = 4.5
#: Bad documents that a bucket needs at least: with fewer, no weight is significant.
MIN_BAD = 3
MIN_WEIGHT = 2.0
#: A stem that tells less than this alone says nothing: it is one of many words.
MIN_STEM_WEIGHT = 3.5
MIN_SIGNIFICANCE = 3.5
#: Correct human votes of each class that EM takes as seen before the data.
HUMAN_PRIOR = 10.0
UNLABELLED_WEIGHT = 0.05
HEURISTICS = ("symbols", "separators", "shouting", "repetition", "abuse")
LABELLERS = ("human", *HEURISTICS)
NONE, GOOD, BAD = 0, 1, 2
#: Words of text that one insult speaks for, and that one occurrence of a learned word does.
ABUSE_SPAN, WORD_SPAN = 200, 1000
#: Letters of a stem, and words of text that one occurrence of it speaks for.
STEM, STEM_SPAN = 4, 80
#: Common insults; what else is abuse in a corpus is learned from its labels.
ABUSE = frozenset("""
asshole bastard bitch bullshit cretin dimwit disgusting douchebag dumbass halfwit idiot idiots imbecile jackass jerk loser losers
lowlife moron morons nitwit pathetic retard scum scumbag stupid worthless
abschaum arschloch dummkopf hurensohn idioten missgeburt mistkerl schwachkopf trottel vollidiot wichser
abruti connard connasse crétin débile enculé idiote imbécile minable salaud salope
cabrón capullo cretino estúpida estúpido gilipollas idiota imbécil pendejo tarado
""".split())
_WORD = re.compile(r"[^\W_]+")
_SYMBOLS = re.compile(r"[%&$#*!~^]{2,}(?=\s|$)")


def marks(text: str) -> tuple[int, ...]:
    """Votes of the heuristics on a text, in the order of HEURISTICS: bad or none."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return (NONE,) * len(HEURISTICS)
    words = _WORD.findall(text.lower())
    abuse = sum(map(ABUSE.__contains__, words))
    shares = (
        len(_SYMBOLS.findall(text)) / n >= 0.3,
        tokens.count("|") / n >= 0.15,
        n >= 5 and sum(map(str.isupper, tokens)) / n >= 0.5,
        n >= 5 and sum(map(operator.eq, tokens, tokens[1:])) / n >= 0.3,
        abuse > 0 and abuse * ABUSE_SPAN >= len(words),
    )
    return tuple(BAD if x else NONE for x in shares)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def stem_bucket(stem: str) -> int:
    return -3 - _bucket(stem)  # apart from the words, and from the totals -1 and -2


def mark_bucket(heuristic: str) -> int:
    return BUCKETS + HEURISTICS.index(heuristic)  # apart from the words


def features(text: str, mark: tuple[int, ...]) -> dict[int, float]:
    """How much the text shows of the buckets of its words (0 to 1), of its stems (1 to
    2) and of its structural marks."""
    words = _WORD.findall(text.lower())
    counts: dict[int, int] = {}
    for w, k in Counter(words).items():
        f = _bucket(w)
        counts[f] = counts.get(f, 0) + k
    shown = {f: min(1.0, k * WORD_SPAN / len(words)) for f, k in counts.items()}
    least = max(2, len(words) / STEM_SPAN)
    for stem, k in Counter([w[:STEM] for w in words if len(w) > STEM]).items():
        if k >= least:
            shown[stem_bucket(stem)] = min(2.0, (k + 1) / 2, k * STEM_SPAN / len(words))
    shown.update((mark_bucket(h), 1.0) for h, m in zip(HEURISTICS, mark) if m == BAD)
    return shown


def _texts(batch: pd.DataFrame) -> Iterator[str]:
    return (t if isinstance(t, str) else "" for t in batch["text"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def minhashes(texts: list[bytes]) -> list[bytes]:
    """HASHES least hashes of each text's 5-word shingles; nothing for a text without words."""
    seeds = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [np.array([mix(s ^ x).min() for x in seeds]).tobytes() if len(s) else b"" for part in chunks(texts) for s in shingle_sets(part)]


def near_copies(rows: list[tuple[int, int, bytes]]) -> set[tuple[int, int]]:
    """(h, pattern) of the rows (h, pattern, minhashes) that are near copies of another
    row, with the same pattern, that is not among them."""
    first: dict[tuple, np.ndarray] = {}
    out = set()
    for h, pattern, raw in sorted(rows):
        if not raw:
            continue
        own = np.frombuffer(raw, np.uint64)
        keys = [(pattern, i, raw[8 * i:8 * (i + ROWS)]) for i in range(0, HASHES, ROWS)]
        others = {id(first[k]): first[k] for k in keys if k in first}.values()
        if any((own == x).mean() >= SIMILAR for x in others):
            out.add((h, pattern))
        else:
            for k in keys:
                first.setdefault(k, own)
    return out


def votes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, pattern): every document's votes as base-3 digits."""

    def run(batches):
        for b in batches:
            code = [sum(v * 3 ** (i + 1) for i, v in enumerate(marks(t))) for t in _texts(b)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "h": b["h"], "code": code})

    own = keyed(docs).withColumn("doc_id", id_text("doc_id")).mapInPandas(run, "doc_id string, h bigint, code int")
    own = own.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), BAD).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), GOOD)
    human = labels.select(F.col("doc_id").alias("_id"), bad.alias("vote")).filter("_id is not null and vote is not null").groupBy("_id").agg(F.max("vote").alias("vote"))
    rows = own.join(human, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", "h", (F.col("code") + F.coalesce("vote", F.lit(NONE))).alias("pattern"))


def digits(pattern: int) -> list[int]:
    return [pattern // 3 ** i % 3 for i in range(len(LABELLERS))]


def fit_labellers(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], dict[str, float]]:
    """EM over vote patterns -> (probability that a pattern is bad, accuracy of each
    labeller: how often its vote, where it casts one, is right)."""
    if not counts:
        return {}, {}
    patterns = sorted(counts)
    v = np.array([digits(p) for p in patterns])
    n = np.array([counts[p] for p in patterns], dtype=float)
    bad, good = (v == BAD).sum(1), (v == GOOD).sum(1)
    human = v[:, 0]
    p = np.where(human == BAD, 0.95, np.where(human == GOOD, 0.05, np.where(bad > good, 0.8, 0.1)))
    # votes that no label checks count less: kinds of junk exclude each other, which
    # the labellers' independence does not know, and unchecked they would drift
    m = np.where(human == NONE, n * UNLABELLED_WEIGHT, n) if (human != NONE).any() else n
    for _ in range(rounds):
        prior = np.clip((m * p).sum() / m.sum(), 1e-6, 1 - 1e-6)
        logs = []
        for weight, right in ((m * p, BAD), (m * (1 - p), GOOD)):
            table = np.array([[weight[v[:, j] == k].sum() + 0.1 for k in range(3)] for j in range(v.shape[1])])
            table[0, NONE] = 0  # whether a document is labelled says nothing about it
            table[0, right] += HUMAN_PRIOR
            log = np.log(np.maximum(table / table.sum(1, keepdims=True), 1e-12))[np.arange(v.shape[1]), v]
            log[human == NONE, 0] = 0
            logs.append(log.sum(1))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0] + math.log((1 - prior) / prior), -50, 50)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    accuracy = {}
    for j, name in enumerate(LABELLERS):
        cast = v[:, j] != NONE
        right = np.where(v[:, j] == BAD, p, 1 - p)
        accuracy[name] = float((n * right)[cast].sum() / n[cast].sum()) if cast.any() else 0.5
    return dict(zip(patterns, p.tolist())), accuracy


def training_texts(docs: DataFrame, voted: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, set[tuple[int, int]]]:
    """(h, pattern, text) of the distinct texts that training reads, and the (h, pattern)
    of those that are near copies of others."""
    known = voted.filter("pattern > 0").select("h", "pattern").distinct()
    share = min(1.0, sample / max(known.count(), 1))
    chosen = F.pmod(F.xxhash64(F.lit("fit"), "h"), F.lit(1_000_000)) < int(share * 1_000_000)
    wanted = F.broadcast(known.filter(chosen))  # about ``sample`` rows
    some = stored(keyed(docs).join(wanted, "h").groupBy("h", "pattern").agg(F.min("text").alias("text")), "texts")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "pattern": b["pattern"], "least": minhashes([t.encode() for t in _texts(b)])})

    least = some.mapInPandas(run, "h bigint, pattern int, least binary").collect()  # a KB for each of the sample
    return some, near_copies([(r["h"], r["pattern"], bytes(r["least"])) for r in least])


def train(docs: DataFrame, voted: DataFrame, posterior: dict[int, float], sample: int = SAMPLE) -> tuple[dict[int, float], float]:
    """(weight of each kept bucket, bias) from the posterior labels of the sample."""
    some, copies = training_texts(docs, voted, sample)

    def run(batches):
        for b in batches:
            # of all documents, and of those that a label calls good
            total: dict[int, list[float]] = {-1: [0.0, 0.0], -2: [0.0, 0.0]}
            for h, t, pattern in zip(b["h"], _texts(b), b["pattern"]):
                if (h, pattern) in copies:
                    continue
                p = posterior[pattern]
                total[-2][1] += pattern % 3 == GOOD
                for f in (-1, *features(t, marks(t))):
                    row = total.setdefault(f, [0.0, 0.0])
                    row[0] += p
                    row[1] += 1 - p
            # whole millionths: sums do not depend on the order of the batches
            yield pd.DataFrame({"bucket": list(total), "bad": [round(x[0] * 1e6) for x in total.values()], "good": [round(x[1] * 1e6) for x in total.values()]})

    sums = some.mapInPandas(run, "bucket int, bad bigint, good bigint").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    own = F.col("bucket").isin(-1, -2) | (F.col("bucket") >= BUCKETS)  # totals and structural marks
    t = sums.filter(own | (F.col("bad") >= MIN_BAD * 1_000_000)).toPandas()  # at most sample * words / MIN_BAD rows, and 2 * BUCKETS + 7
    count = {r.bucket: (r.bad / 1e6, r.good / 1e6) for r in t[t.bucket.isin((-1, -2)) | (t.bucket >= BUCKETS)].itertuples()}
    all_bad, all_good = count.get(-1, (0.0, 0.0))
    bias = math.log((all_bad + 0.5) / (all_good + 0.5)) if all_bad >= MIN_BAD else 0.0
    # a mark too rare to be learned, or that no document labelled good could refute, still counts
    compared = count.get(-2, (0.0, 0.0))[1] >= MIN_BAD
    rare = [f for f in map(mark_bucket, HEURISTICS) if not compared or sum(count.get(f, (0.0, 0.0))) < MIN_BAD]
    default = dict.fromkeys(rare, THRESHOLD + 1 - bias)
    if all_bad < MIN_BAD:
        return default, bias
    t = t[~t.bucket.isin((-1, -2)) & (t.bad >= MIN_BAD * 1_000_000)].sort_values("bucket")
    a, b = t.bad.to_numpy() / 1e6 + 0.5, t.good.to_numpy() / 1e6 + 0.5
    c, d = np.maximum(all_bad - a + 1, 0.5), np.maximum(all_good - b + 1, 0.5)
    weight = np.log(a / c) - np.log(b / d)
    # root of the likelihood ratio against "as frequent in bad as in good documents"
    share = all_bad / (all_bad + all_good)
    ratio = 2 * (a * np.log(a / ((a + b) * share)) + b * np.log(b / ((a + b) * (1 - share))))
    keep = (weight >= np.where(t.bucket < 0, MIN_STEM_WEIGHT, MIN_WEIGHT)) & (np.sqrt(np.maximum(ratio, 0)) >= MIN_SIGNIFICANCE)
    return default | dict(zip(t.bucket[keep].tolist(), weight[keep].tolist())), bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], float, dict[str, float]]:
    """(weights, bias, labeller accuracies) learned from a corpus and its labels."""
    voted = stored(votes(docs, labels), "votes")
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded: 3^labellers
    posterior, accuracy = fit_labellers(counts)
    weights, bias = train(docs, voted, posterior, sample)
    return weights, bias, accuracy


def score(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """``docs`` with ``score`` (a column of that name is replaced)."""
    kept = docs.sparkSession.sparkContext.broadcast(weights)  # at most BUCKETS numbers

    @F.pandas_udf("double")
    def scorer(texts: pd.Series) -> pd.Series:
        w = kept.value
        plain = (t if isinstance(t, str) else "" for t in texts)
        return pd.Series([bias + math.fsum(w[f] * x for f, x in features(t, marks(t)).items() if f in w) for t in plain], dtype="float64")

    return docs.withColumn("score", scorer(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, rejected) of every document."""
    weights, bias, _ = fit(docs, labels, sample)
    out = score(docs.select("doc_id", "text"), weights, bias)
    return out.select("doc_id", "score", (F.col("score") > THRESHOLD).alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    weights, bias, _ = fit(docs, labels, sample)
    return score(docs, weights, bias).filter(F.col("score") <= THRESHOLD).drop("score")
