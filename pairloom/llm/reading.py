"""Reading level of documents from vocabulary coverage and sentence complexity, calibrated on labelled documents.

The vocabulary is ranked by frequency over the whole corpus. A document's coverage rank is the size of the smallest
frequency-ranked vocabulary that covers SHARE of its words (words of equal frequency enter together). With the sentence
measures it goes through one logistic step a band, fitted over all labels by iteratively reweighted least squares:
SQL forms the normal equations of every label and adds them up, the driver gets the sums and solves them.

English prose is told from the text alone: most of it must be plain words, and its words must be those of documents
labelled English (the labels may be wrong one by one, over the corpus they are not).

The list of the LISTED most frequent words is broadcast; its size is that bound, and it changes only the speed: words
that are not on it go through a join with the whole vocabulary.

Defined results: null, empty and wordless texts have null measures, no level and are no prose; with no usable labels
there are no levels; equal frequencies are one step of the ranking.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import spool

SHARE = 0.5
LISTED = 20_000
PLAIN, ENGLISH = 0.7, 0.5
ROUNDS, RIDGE, SETTLED = 50, 1.0, 1e-3
BANDS = (2, 3, 4, 5)

MEASURES = "words array<string>, uses array<int>, tokens bigint, plain double, sentence double, commas double, long_words double"


class Pieces(dict):
    """What a run of characters without white space is worth: plain, words, ends a sentence, commas; met ones are kept.

    A piece with digits or signs of markup, paths or code has no words and ends nothing.
    """

    KEPT, LONGEST = 300_000, 40

    def __init__(self) -> None:
        import re

        self.odd = re.compile(r"[\d/_\\{}<>=@|~^\[\]]").search
        self.plain = re.compile(r"[\"'“”‘’(*]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"'“”‘’).,;:!?*…]*").fullmatch
        self.words = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*").findall

    def __missing__(self, piece: str) -> tuple[bool, list[str], bool, int]:
        if self.odd(piece):
            worth = (False, [], False, 0)
        else:
            worth = (self.plain(piece) is not None, self.words(piece.lower()), piece[-1] in ".!?…", piece.count(","))
        if len(piece) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[piece] = worth
        return worth


def measure_parts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Words with counts, share of plain words, and sentence measures of each text."""
    import re
    import unicodedata
    from collections import Counter

    markup = re.compile(r"<[^<>]*>|`[^`]*`")
    opening = re.compile(r"(?m)^[ \t]*(?:(?:user|assistant|system|tool|human|model)[ \t]*:[ \t]*)?(?:[-*#>]+[ \t]+)*", re.I)
    lines = re.compile(r"[\r\n]+").split
    known = Pieces()
    for part in parts:
        rows = []
        for text in part:
            if not text:
                rows.append((None, None, 0, None, None, None, None))
                continue
            if not text.isascii():
                text = unicodedata.normalize("NFKC", text)
            bare = opening.sub("", text)
            pieces = bare.split()
            share = sum([known[p][0] for p in pieces]) / len(pieces) if pieces else 0.0
            clean = opening.sub("", markup.sub(" ", text)) if "<" in text or "`" in text else bare
            said, sentences, commas = [], 0, 0
            for line in lines(clean):
                spoken = False
                for p in line.split():
                    _, words, ends, inside = known[p]
                    if words:
                        spoken = True
                        said += words
                    commas += inside
                    if ends and spoken:
                        sentences += 1
                        spoken = False
                sentences += spoken
            n = len(said)
            if not n:
                rows.append((None, None, 0, share, None, None, None))
                continue
            counts = Counter(said)
            long_words = sum([c for w, c in counts.items() if len(w) >= 9])
            rows.append((list(counts), list(counts.values()), n, share, math.log(n / sentences), math.log1p(commas / sentences), long_words / n))
        yield pd.DataFrame(rows, columns=["words", "uses", "tokens", "plain", "sentence", "commas", "long_words"])


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, english (as labelled; null if it says nothing) and the measures."""
    label = F.lower(F.trim("lang"))
    english = F.when(label.isin("en", "eng"), True).when(label.isNotNull() & ~label.isin("", "und"), False)
    return documents.select("doc_id", english.alias("labelled_english"), F.pandas_udf(measure_parts, MEASURES)("text").alias("m")).select("doc_id", "labelled_english", "m.*")


def vocabulary(measured: DataFrame) -> DataFrame:
    """word, n (count over the corpus), size (of the vocabulary down to its frequency), english (share of its labelled uses)."""
    counts = spool(
        measured.select("labelled_english", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("uses").alias("n"))))
        .groupBy("word")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("labelled_english"), F.col("n")).otherwise(0)).alias("en"),
            F.sum(F.when(F.col("labelled_english").isNotNull(), F.col("n")).otherwise(0)).alias("told"),
        ),
        "vocabulary",
    )
    # The running sum goes over distinct frequencies, which are few, not over words.
    steps = counts.groupBy("n").agg(F.count("*").alias("of_n")).withColumn("size", F.sum("of_n").over(Window.orderBy(F.desc("n"))))
    return counts.join(steps.select("n", "size"), "n").select("word", "n", "size", F.when(F.col("told") > 0, F.col("en") / F.col("told")).alias("english"))


def coverage(measured: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, rank (vocabulary size that covers SHARE of the words), english (mean over its words)."""
    listed = words.orderBy(F.desc("n"), "word").limit(LISTED).collect()
    table = measured.sparkSession.sparkContext.broadcast({r.word: (r.size, r.english) for r in listed})

    @F.pandas_udf("rank bigint, covered bigint, told bigint, english double, rest array<string>, rest_uses array<int>")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = table.value.get
        for some, counts in parts:
            out = []
            for entries, uses in zip(some, counts):
                if entries is None or not len(entries):
                    out.append((None, 0, 0, 0.0, None, None))
                    continue
                sizes, told, english, covered, rest, rest_uses = [], 0, 0.0, 0, [], []
                uses = uses.tolist()
                for word, n in zip(entries, uses):
                    hit = known(word)
                    if hit is None:
                        rest.append(word)
                        rest_uses.append(n)
                        continue
                    covered += n
                    sizes.append((hit[0], n))
                    if hit[1] is not None:
                        told += n
                        english += n * hit[1]
                need, rank = math.ceil(SHARE * sum(uses)), None
                if covered >= need:
                    for size, n in sorted(sizes):
                        need -= n
                        if need <= 0:
                            rank = size
                            break
                out.append((rank, covered, told, english, rest or None, rest_uses or None))
            frame = pd.DataFrame(out, columns=["rank", "covered", "told", "english", "rest", "rest_uses"])
            frame["rank"] = frame["rank"].astype("Int64")
            yield frame

    first = spool(measured.select("doc_id", "tokens", look_up("words", "uses").alias("c")).select("doc_id", "tokens", "c.*"), "coverage")
    # Words that are not listed are rarer than those that are, so they come after them in a document's ranking.
    rare = first.where("rest is not null").select("doc_id", "tokens", "rank", "covered", F.inline(F.arrays_zip(F.col("rest").alias("word"), F.col("rest_uses").alias("uses"))))
    met = rare.join(words.select("word", "size", F.col("english").alias("e")), "word")
    told = met.groupBy("doc_id").agg(F.sum(F.when(F.col("e").isNotNull(), F.col("uses"))).alias("more_told"), F.sum(F.col("e") * F.col("uses")).alias("more_english"))
    upto = Window.partitionBy("doc_id").orderBy("size", "word")
    ranks = (
        met.where("rank is null")
        .withColumn("reached", F.col("covered") + F.sum("uses").over(upto))
        .where(F.col("reached") >= F.ceil(F.lit(SHARE) * F.col("tokens")))
        .groupBy("doc_id")
        .agg(F.min("size").alias("exact"))
    )
    none, nothing = F.lit(0).cast("bigint"), F.lit(0.0)
    all_told = F.col("told") + F.coalesce("more_told", none)
    english = F.when(all_told > 0, (F.col("english") + F.coalesce("more_english", nothing)) / all_told)
    return first.join(told, "doc_id", "left").join(ranks, "doc_id", "left").select("doc_id", F.coalesce("rank", "exact").alias("rank"), english.alias("english"))


def design(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns x0.. of the logistic steps: the four measures and their products, measures clipped to four deviations."""
    base = [F.log("rank"), F.col("sentence"), F.col("commas"), F.col("long_words")]
    stats = df.agg(*[x for i, b in enumerate(base) for x in (F.avg(b).alias(f"m{i}"), F.stddev(b).alias(f"s{i}"))]).first()
    z = [F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (b - F.lit(float(stats[f"m{i}"] or 0))) / F.lit(float(stats[f"s{i}"] or 0) or 1.0))) for i, b in enumerate(base)]
    out = df.select("*", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    cols: list[Column] = [F.lit(1.0), *[F.col(f"z{i}") for i in range(4)], *[F.col(f"z{i}") * F.col(f"z{j}") for i in range(4) for j in range(i, 4)]]
    names = [f"x{k}" for k in range(len(cols))]
    return out.select("*", *[c.alias(n) for c, n in zip(cols, names)]).drop(*[f"z{i}" for i in range(4)]), names


def logit(names: list[str], weights: np.ndarray) -> Column:
    total = F.lit(0.0)
    for name, w in zip(names, weights):
        total = total + F.col(name) * F.lit(float(w))
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def calibrate(labelled: DataFrame) -> dict[int, np.ndarray] | None:
    """Weights of the step to each band from all label rows (``labelled``: x, array of double; band).

    Every round is one SQL aggregation: the weighted products and residuals of a row are one vector, vectors are added
    up within tasks and then over them, and the driver gets the sum, whose length depends on the measures alone.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    some = labelled.select(F.size("x").alias("k")).first()
    if some is None:
        return None
    k = some["k"]
    weights = {b: np.zeros(k) for b in BANDS}
    for _ in range(ROUNDS):
        parts = []
        for b in BANDS:
            held = F.array(*[F.lit(float(w)) for w in weights[b]])
            z = F.aggregate(F.zip_with("x", held, lambda x, w: x * w), F.lit(0.0), lambda t, v: t + v)
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
            one = F.struct(F.greatest(p * (1 - p), F.lit(1e-4)).alias("weight"), ((F.col("band") >= b).cast("double") - p).alias("miss"))
            # A list of one, so that p is worked out once a row and not once an element.
            products = F.transform(F.array(one), lambda s: F.concat(F.flatten(F.transform("x", lambda u: F.transform("x", lambda v: u * v * s["weight"]))), F.transform("x", lambda u: u * s["miss"])))
            parts.append(F.flatten(products))
        sums = labelled.select(Summarizer.sum(array_to_vector(F.concat(*parts))).alias("s")).first()["s"].toArray()
        moved, at = 0.0, 0
        for b in BANDS:
            h, g = sums[at : at + k * k].reshape(k, k), sums[at + k * k : at + k * k + k]
            at += k * k + k
            step = np.linalg.solve(h + RIDGE * np.eye(k), g - RIDGE * weights[b])
            weights[b] = weights[b] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < SETTLED:
            return weights
    warnings.warn(f"the steps still moved by {moved:.2g} after {ROUNDS} rounds", stacklevel=2)
    return weights


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, prose (English prose), level (1 to 5), rank, sentence, commas, long_words; stored.

    ``documents``: doc_id (unique), text, lang. ``labels``: doc_id, band. Several labels of a document all count.
    """
    measured = spool(measures(documents), "measures")
    covered = coverage(measured, vocabulary(measured))
    table, names = design(spool(measured.drop("words", "uses", "labelled_english").join(covered, "doc_id"), "levels"))
    known = labels.where("band between 1 and 5").select("doc_id", "band")
    labelled = spool(table.where("rank is not null").join(known, "doc_id").select("band", F.array(*names).alias("x")), "labelled")
    weights = calibrate(labelled)
    prose = F.coalesce((F.col("plain") >= PLAIN) & (F.col("english") >= ENGLISH) & F.col("rank").isNotNull(), F.lit(False))
    level = F.lit(None).cast("int")
    if weights is not None:
        steps = F.lit(1)
        for b in BANDS:
            steps = steps + (logit(names, weights[b]) >= 0).cast("int")
        level = F.when(F.col("rank").isNotNull(), steps)
    return table.select("doc_id", prose.alias("prose"), level.alias("level"), "rank", "sentence", "commas", "long_words")
