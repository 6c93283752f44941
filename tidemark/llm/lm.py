"""Language-model scores: marginal probability of a subword lattice whose weights are learned from training rows."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of, written
from tidemark.llm.lattice import SPACE, Lattice, Vocabulary

LN10 = float(np.log(10))
HELD_WORDS = 300_000  # counts kept by a task before it passes them on


@dataclass
class ClassModel:
    """Weights of the lattice for one class of texts.  A word is one piece that begins with a space mark, pieces that go on,
    and a stop; the two kinds of pieces are two distributions, so the probabilities of all words sum to one."""

    logp: np.ndarray
    stop: float
    words: int = 0  # training words and ends
    types: int = 0  # different ones
    ends: int = 0
    discount: float = 0.5
    share: float = 1.0  # of the training texts

    def mixed(self, spelled: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word: the lattice also has one arc over the whole word, for words of the training rows, weighted by
        their discounted share; what the discount frees goes to spelling.  ``spelled``: natural log without the stop."""
        spelled = spelled + self.stop
        if not self.words:
            return spelled / LN10
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - self.discount, 0) / self.words)
        return np.logaddexp(whole, np.log(self.discount * self.types / self.words) + spelled) / LN10

    def start(self) -> float:
        """log10 of the class and the end token."""
        return float(np.log10(self.share * ((self.ends - self.discount) / self.words if self.ends else 0.5)))


@dataclass
class SubwordModel:
    vocab: Vocabulary
    classes: list[ClassModel]
    words: int = 0
    types: int = 0
    ends: int = 0

    def base(self, counts):
        """log10 of a token by add-one counts of whole words."""
        return np.log10((counts + 1) / (self.words + self.types + 1))


def starting_weights(vocab: Vocabulary) -> np.ndarray:
    """Probabilities from the vocabulary's own scores: logs as they are, merge ranks (scores below -100) by Zipf's law."""
    s = vocab.scores
    ranked = s[vocab.normal].min() < -100
    p = 1 / (3 - np.maximum(s, -1e6)) if ranked else np.exp(s)
    p[vocab.byte_ids] = p[vocab.normal].min()
    out = np.zeros(len(s))
    used = np.concatenate([vocab.normal, vocab.byte_ids])
    out[used] = p[used] / p[used].sum()
    return out


def _weights(vocab: Vocabulary, weight: np.ndarray, stops: float) -> ClassModel:
    first = np.array([t.startswith(SPACE) for t in vocab.pieces])
    p = np.where(first, weight / weight[first].sum(), weight / (weight[~first].sum() + stops))
    with np.errstate(divide="ignore"):
        return ClassModel(np.log(p), float(np.log(stops / (weight[~first].sum() + stops))))


def word_counts(docs: DataFrame, train: Column, text_col: str, group: Column, groups: int) -> DataFrame:
    """``word`` (bytes), ``total`` occurrences and ``c0``, ``c1``, ... those in training rows of each class, over whole texts.
    Tasks count before anything is shuffled."""
    names = [f"c{k}" for k in range(groups)]

    def passed_on(found: list[Counter]) -> pd.DataFrame:
        words = list({w for c in found for w in c})
        rows = {name: np.fromiter((c[w] for w in words), np.int64, len(words)) for name, c in zip(names, found)}
        other = np.fromiter((found[-1][w] for w in words), np.int64, len(words))
        return pd.DataFrame({"word": words, "total": other + sum(rows.values()), **rows})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [Counter() for _ in range(groups + 1)]
        for b in batches:
            for text, at in zip(b["text"], b["at"]):
                found[at].update(words_of(text))
            if sum(map(len, found)) > HELD_WORDS:
                yield passed_on(found)
                found = [Counter() for _ in range(groups + 1)]
        yield passed_on(found)

    at = F.when(F.coalesce(train, F.lit(False)), group).otherwise(F.lit(groups)).cast("int")
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), at.alias("at"))
    parts = rows.mapInPandas(count, "word binary, total long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("word").agg(F.sum("total").alias("total"), *[F.sum(n).alias(n) for n in names])


def fit(counts: DataFrame, ends: list[int], model: bytes, rounds: int = 1) -> SubwordModel:
    """Weights of every class by expectation maximisation over its training words: each round sums every piece's expected
    uses over all segmentations of all words, starting from the vocabulary's own scores.  Only one number per piece and
    class reaches the driver."""
    spark = counts.sparkSession
    vocab = Vocabulary.read(model)
    start = starting_weights(vocab)
    names = [f"c{k}" for k in range(len(ends))]
    seen = sum(F.col(n) for n in names)
    one = [F.struct(F.sum(n).alias("n"), *[F.sum((F.col(n) >= 1 if k == 0 else F.col(n) == k).cast("long")).alias(f"v{k}") for k in range(3)]).alias(n) for n in names]
    stats = counts.agg(*one, F.sum(seen).alias("n"), F.sum((seen > 0).cast("long")).alias("v")).first()
    classes = [_weights(vocab, start, start.sum() / 3) for _ in names]
    for _ in range(rounds if stats["n"] else 0):
        sent = spark.sparkContext.broadcast((vocab, classes))

        def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            voc, now = sent.value  # noqa: B023
            lattice, uses = Lattice(voc), np.zeros((len(now), len(voc.pieces)))
            for b in batches:
                words = np.array([SPACE + w.decode("utf-8", "replace") for w in b["word"]], dtype=object)
                for k, c in enumerate(now):
                    n = b[f"c{k}"].to_numpy()
                    lattice.marginals(words[n > 0].tolist(), [c.logp], weights=n[n > 0], counts=uses[k])
            k, at = np.nonzero(uses)
            yield pd.DataFrame({"k": k, "piece": at, "uses": uses[k, at]})

        rows = counts.where(seen > 0).select("word", *names).mapInPandas(expected, "k int, piece long, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        for k, n in enumerate(names):
            weight = start * max(1.0, 0.001 * stats[n]["n"])  # keeps every piece possible
            mine = rows[rows["k"] == k]
            weight[mine["piece"].to_numpy()] += mine["uses"].to_numpy()
            classes[k] = _weights(vocab, weight, max(1.0, float(stats[n]["n"])))
    for c, n, e in zip(classes, names, ends):
        s = stats[n]
        if e:
            c.discount = min(0.95, max(0.05, s["v1"] / (s["v1"] + 2 * s["v2"]))) if s["v1"] + s["v2"] else 0.5
            c.ends, c.words, c.types = e, (s["n"] or 0) + e, (s["v0"] or 0) + 1
        c.share = e / sum(ends) if sum(ends) else 1 / len(ends)
    total = sum(ends)
    return SubwordModel(vocab, [c for c in classes if c.share > 0], (stats["n"] or 0) + total, (stats["v"] or 0) + (total > 0), total)


def word_scores(counts: DataFrame, model: SubwordModel, ends: list[int]) -> DataFrame:
    """``word, total, known, base`` and ``s0``, ``s1``, ...: log10 of the word in each class; every different word is scored once."""
    sent = counts.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(ends))]
    used = [n for n, e in zip(names, ends) if e or not sum(ends)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        lattice = Lattice(m.vocab)
        for b in batches:
            spelled = lattice.marginals([SPACE + w.decode("utf-8", "replace") for w in b["word"]], [c.logp for c in m.classes])
            seen = b[names].to_numpy().sum(1)
            scores = {f"s{z}": c.mixed(spelled[:, z], b[n].to_numpy(np.float64)) for z, (c, n) in enumerate(zip(m.classes, used))}
            yield pd.DataFrame({"word": b["word"], "total": b["total"], "known": (seen > 0).astype(np.int64), "base": m.base(seen), **scores})

    return counts.mapInPandas(score, "word binary, total long, known long, base double, " + ", ".join(f"s{z} double" for z in range(len(model.classes))))


def _classes(docs: DataFrame, train: Column, class_col: str | None, most: int) -> tuple[Column, list[int]]:
    """The class of a training row, and the rows of each class: the ``most`` largest values of a column, and all others as one."""
    if class_col is None:
        return F.lit(0), [docs.where(F.coalesce(train, F.lit(False))).count()]
    value = F.col(class_col).cast("string")
    found = docs.where(F.coalesce(train, F.lit(False))).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = found.where(F.col("v").isNotNull()).orderBy(F.col("n").desc(), "v").limit(most).collect()
    group = F.lit(len(top))
    for k, r in enumerate(top):
        group = F.when(value == r["v"], F.lit(k)).otherwise(group)
    return group, [r["n"] for r in top] + [total - sum(r["n"] for r in top)]


def lm_scores(
    docs: DataFrame, model_path: str, train: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None,
    most_classes: int = 8, common: int = 100_000, rounds: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of the text, A-Z lower-cased, and one end.  ``base_score`` is the add-one unigram of whole words,
    ``score`` the model's log10 probability of the text: for each word the sum over all segmentations into existing
    vocabulary pieces, whose weights start at the vocabulary's scores and are re-estimated from the rows where ``train``
    holds, and over the word as a whole if those rows have it.  Pieces never cross a space, so a text's forward recursion
    is the product of its words' and each different word runs once.

    With ``class_col`` (a language, say) the training rows of each class, the ``most_classes`` largest values and the rest
    together, learn weights of their own.  A text's probability is the sum over all classes: its own class is not looked at.

    Words that make up at least 1 in ``common`` of all occurrences, so at most ``common`` of them, are looked up in the task
    that reads the text; the others meet their scores in a join on the word, where none has more than that share.

    Null texts are empty: one end token.  Null ids pass through; null ``train`` means not a training row.  Repeated rows
    each get their scores.  Without training rows the base is 0 and the vocabulary's own weights score.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        vocabulary = f.read()
    group, ends = _classes(docs, train, class_col, most_classes)
    counts = written(word_counts(docs, train, text_col, group, len(ends)), "lm-counts")
    model = fit(counts, ends, vocabulary, rounds)
    words = written(word_scores(counts, model, ends), "lm-words")
    sums = ["known", "base", *[f"s{z}" for z in range(len(model.classes))]]
    total = words.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    frequent = words.where(F.col("total") * common >= total).select("word", *sums).toArrow()
    table = spark.sparkContext.broadcast((frequent["word"].to_pylist(), np.stack([frequent[c].to_numpy() for c in sums], 1) if len(frequent) else np.zeros((0, len(sums)))))
    end = np.array([model.ends > 0, model.base(model.ends), *[c.start() for c in model.classes]], np.float64)

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, values = table.value
        row_of = {bytes(w): i for i, w in enumerate(listed)}
        for b in batches:
            ids, hs, keys, ns, own, at = [], [], [], [], [], []
            for id_, h, text in zip(b["id"], b["h"], b["text"]):
                mine = Counter(words_of(text))
                rows, times, rare = [], [], []
                for w, n in mine.items():
                    if (i := row_of.get(w)) is not None:
                        rows.append(i)
                        times.append(n)
                    else:
                        rare.append(w)
                own.append([*(end + np.array(times, np.float64) @ values[rows] if rows else end), sum(mine.values()) + 1, 1])
                at.append(len(keys))
                # the text's own row: a key with a space is no word and meets nothing
                keys.append(b" %d %d" % (h, id_))
                ns.append(0)
                keys += rare
                ns += [mine[w] for w in rare]
                ids += [id_] * (1 + len(rare))
                hs += [h] * (1 + len(rare))
                if len(keys) > 200_000:
                    yield passed_on(ids, hs, keys, ns, own, at)
                    ids, hs, keys, ns, own, at = [], [], [], [], [], []
            yield passed_on(ids, hs, keys, ns, own, at)

    def passed_on(ids, hs, keys, ns, own, at) -> pd.DataFrame:
        sums_of: list = [None] * len(keys)
        for i, values_ in zip(at, own):
            sums_of[i] = values_
        return pd.DataFrame({"id": ids, "h": hs, "word": keys, "n": ns, "own": sums_of})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a null id travels as 0 with another hash, of odd parity; all other hashes are even
    h = F.shiftleft(F.xxhash64(text), 1) + F.col(id_col).isNull().cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), h.alias("h"), text.alias("text"))
    pairs = rows.mapInPandas(looked_up, "id long, h long, word binary, n int, own array<double>")
    joined = pairs.join(words.where(F.col("total") * common < total).drop("total"), "word", "left")
    texts = joined.groupBy("id", "h").agg(
        F.sum(F.col("own")[len(sums)]).alias("tokens"), F.sum(F.col("own")[len(sums) + 1]).alias("copies"),
        *[F.sum(F.coalesce(F.col("own")[i], F.col("n") * F.col(c), F.lit(0))).alias(c) for i, c in enumerate(sums)],
    )
    # repeated rows have summed alike
    texts = texts.select("id", "h", "copies", *[(F.col(c) / F.col("copies")).alias(c) for c in ["tokens", *sums]])
    top = F.greatest(*[F.col(c) for c in sums[2:]]) if len(sums) > 3 else F.col(sums[2])
    score = top + F.log10(sum(F.pow(F.lit(10.0), F.col(c) - top) for c in sums[2:]))
    one = texts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select(
        F.when(F.col("h") % 2 == 0, F.col("id")).alias(id_col), F.round("tokens").cast("long").alias("n_tokens"), F.round("known").cast("long").alias("n_known"),
        F.lit(model.words).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"),
    )
