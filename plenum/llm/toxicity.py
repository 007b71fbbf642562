"""Toxicity by class-conditional Kneser-Ney models.

Two models over the letters of words, one of toxic and one of ordinary texts, both smoothed by the same lower orders: continuation counts
over all documents, labelled or not. What neither class has shown often is thus about as likely under either. A text is judged by
the difference of the two log-likelihoods, normalised by its length in letters, and by that of its three most toxic words, set against
its number of words, as a few words can make a long text toxic. A logistic function, fitted on labelled texts that the counts have
not seen, turns these into a score.

A letter is one of 32: the end of a word, a to z whatever their case, a digit, and four for bytes beyond ASCII. A gram is `ORDER` = 5 letters within a
word, its beginning filled up with ends, as a 25-bit number. So there are 2^25 grams at most whatever the corpus: every gram has its own
count and its own score, and the table of scores, 64 MB at most, goes to every task. Texts are shuffled once, to meet their labels; counting grams and
scoring texts take one pass over the rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.shared import mapped, passing, written

ORDER, BITS, DISCOUNT = 5, 5, 0.75
GRAMS = 1 << BITS * ORDER
#: Labelled rows that the logistic function is fitted on, at most; the rows of the smallest hashes of their ids. Counts use all.
LABELLED = 200_000
#: Bytes of texts handled together, and grams a task holds before it counts them.
GROUP, HELD = 1 << 19, 1 << 21
THRESHOLD = 0.3
#: What a text is judged by, and the weights and the constant where no labels are there to fit them.
FEATURES = ("normalised", "strongest", "second", "three", "size")
UNFITTED = ((20.0, 0.5, 0.0, 0.5, 0.0), -8.0)

COUNTS = ("toxic", "ordinary", "toxic_kept", "ordinary_kept")

_LETTER = np.array([b - 64 if 65 <= b < 91 else b - 96 if 97 <= b < 123 else 27 if 48 <= b < 58 else 28 + b % 4 if b >= 128 else 0 for b in range(256)], np.uint8)


@dataclass
class Grams:
    """Grams of a group of texts in order: `gram`, `text` (place of its text in the group) and `end` (is it the end of a word)."""

    gram: np.ndarray
    text: np.ndarray
    end: np.ndarray


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, their bytes, their sizes) for groups of texts of about `GROUP` bytes; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + GROUP, "right")) - 1)
        yield at, end, data[bounds[at] : bounds[end]], np.diff(bounds[at : end + 1])
        at = end


def grams_of(data: np.ndarray, sizes: np.ndarray) -> Grams:
    """The grams of texts that stand one after the other in `data`."""
    n = len(sizes)
    letters = np.zeros(len(data) + n, np.uint32)  # each text is followed by an end
    letters[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = _LETTER[data]
    gram, within = letters.copy(), np.ones(len(letters), bool)
    for j in range(1, ORDER):
        before = np.zeros(len(letters), np.uint32)
        before[j:] = letters[:-j]
        within &= before != 0
        gram |= np.where(within, before << np.uint32(BITS * j), np.uint32(0))
    real = gram != 0  # an end that follows an end is none
    return Grams(gram[real], np.repeat(np.arange(n), sizes + 1)[real], letters[real] == 0)


def grams_seen(docs: DataFrame) -> DataFrame:
    """(gram int, *COUNTS): the different grams of each task's texts, with counts of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(GRAMS, bool)
        for batch in batches:
            for _, _, data, sizes in texts_of(batch.column(0)):
                seen[grams_of(data, sizes).gram] = True
        found = np.flatnonzero(seen).astype(np.int32)
        for a in range(0, len(found), 1 << 16):
            part = found[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(np.zeros(len(part), np.int64))] * len(COUNTS)], names=["gram", *COUNTS])

    return mapped(docs.select("text"), run, "gram int, " + ", ".join(f"{c} long" for c in COUNTS))


def grams_labelled(labelled: DataFrame) -> DataFrame:
    """(gram int, *COUNTS) of rows (text, label, kept): counts by label; kept rows are not in the first two. A gram may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in COUNTS]

        def counted() -> Iterator[pa.RecordBatch]:
            for place, parts in enumerate(held):
                if parts:
                    found, n = np.unique(np.concatenate(parts), return_counts=True)
                    parts.clear()
                    for a in range(0, len(found), 1 << 16):
                        own = found[a : a + (1 << 16)].astype(np.int32)
                        columns = [n[a : a + (1 << 16)].astype(np.int64) if c == place else np.zeros(len(own), np.int64) for c in range(len(COUNTS))]
                        yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, columns)], names=["gram", *COUNTS])

        for batch in batches:
            places = np.where(batch.column(1).to_numpy() == 1, 0, 1) + 2 * batch.column(2).to_numpy(zero_copy_only=False)
            for at, end, data, sizes in texts_of(batch.column(0)):
                grams = grams_of(data, sizes)
                place = places[at:end][grams.text]
                for c, parts in enumerate(held):
                    if len(own := grams.gram[place == c]):
                        parts.append(own)
                if sum(len(x) for parts in held for x in parts) > HELD:
                    yield from counted()
        yield from counted()

    return mapped(labelled.select("text", "label", "kept"), run, "gram int, " + ", ".join(f"{c} long" for c in COUNTS))


def gram_counts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(gram int, *COUNTS) of all grams of `docs` (text) and of labelled rows (text, label, kept)."""
    return grams_seen(docs).union(grams_labelled(labelled)).groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _suffix(letters: int):
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * letters) - 1))


def _history():
    return F.shiftrightunsigned("gram", BITS)


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(gram, p) for grams of one letter less: interpolated Kneser-Ney from how many different letters come before each gram."""
    levels = [written(grams.groupBy(_suffix(ORDER - 1).alias("gram")).agg(F.count("*").alias("n")), "level")]
    for letters in range(ORDER - 2, 0, -1):
        levels.append(levels[-1].groupBy(_suffix(letters).alias("gram")).agg(F.count("*").alias("n")))
    same = Window.partitionBy("history")
    lower = None
    for letters, level in enumerate(reversed(levels), 1):
        known = level.withColumn("history", _history()).withColumns({"all": F.sum("n").over(same), "kinds": F.count("*").over(same)})
        below = F.lit(1 / (1 << BITS))
        if lower is not None:
            known = known.withColumn("tail", _suffix(letters - 1)).join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("below")), "tail")
            below = F.col("below")
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * below) / F.col("all")
        lower = known.select("gram", p.alias("p"))
    return lower


def gram_scores(grams: DataFrame, backoff: DataFrame) -> DataFrame:
    """(gram, fit, score): the difference of the log-probabilities of a gram's last letter under the toxic and the ordinary model; fit
    without kept labels, score with all."""
    every = grams.withColumns({f"every_{c}": F.col(c) + F.col(f"{c}_kept") for c in ("toxic", "ordinary")})
    classes = ("toxic", "ordinary", "every_toxic", "every_ordinary")
    same = Window.partitionBy("history")
    totals = {f"{c}_all": F.sum(c).over(same) for c in classes} | {f"{c}_kinds": F.sum((F.col(c) > 0).cast("long")).over(same) for c in classes}
    lower = backoff.select(F.col("gram").alias("tail"), "p")
    known = every.withColumn("history", _history()).withColumns(totals).withColumn("tail", _suffix(ORDER - 1)).join(lower, "tail")

    def likely(c: str):
        n, everything, kinds = F.col(c), F.col(f"{c}_all"), F.col(f"{c}_kinds")
        return F.when(everything > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("p")) / everything).otherwise(F.col("p"))

    return known.select("gram", *(F.log(likely(f"{x}toxic") / likely(f"{x}ordinary")).alias(name) for x, name in (("", "fit"), ("every_", "score"))))


@dataclass
class Scores:
    """Scores of grams for every task: as many as there are grams, 2^25 at most, of two bytes each, with their numbers if that is less."""

    packed: Broadcast

    @classmethod
    def sent(cls, scores: DataFrame, column: str) -> Scores:
        found = scores.select("gram", F.col(column).cast("float").alias("score")).toArrow()  # GRAMS rows at most
        gram, score = found.column(0).to_numpy(), found.column(1).to_numpy().astype(np.float16)
        packed = (gram.tobytes(), score.tobytes()) if 3 * len(gram) < GRAMS else (None, _dense(gram, score).tobytes())
        return cls(scores.sparkSession.sparkContext.broadcast(packed))

    def table(self) -> np.ndarray:
        gram, score = self.packed.value
        values = np.frombuffer(score, np.float16)
        return values if gram is None else _dense(np.frombuffer(gram, np.int32), values)


def _dense(gram: np.ndarray, score: np.ndarray) -> np.ndarray:
    out = np.zeros(GRAMS, np.float16)
    out[gram] = score
    return out


def text_features(column: pa.Array, scores: np.ndarray) -> np.ndarray:
    """The values of FEATURES (rows) of each text: the difference per letter, of the strongest word, of the second, the mean of the first three
    (below 0 counting as 0), and log(1 + words). All are 0 for a text without words."""
    out = np.zeros((len(FEATURES), len(column)))
    for at, end, data, sizes in texts_of(column):
        grams, n = grams_of(data, sizes), end - at
        if not len(grams.gram):
            continue
        upto = np.flatnonzero(grams.end)
        of = grams.text[upto]
        first = np.concatenate([[0], upto[:-1] + 1])
        own = np.add.reduceat(scores[grams.gram].astype(np.float64), first)
        words = np.bincount(of, minlength=n)
        letters = np.bincount(of, weights=upto - first + 1, minlength=n)
        out[0, at:end] = np.bincount(of, weights=own, minlength=n) / np.maximum(1, letters)
        value = own[np.lexsort((-own, of))]  # by text, the strongest first
        nth = np.arange(len(of)) - (np.cumsum(words) - words)[of]
        for row, keep in ((1, nth == 0), (2, nth == 1)):
            out[row, at:end] = np.bincount(of[keep], weights=value[keep], minlength=n)
        keep = nth < 3
        out[3, at:end] = np.bincount(of[keep], weights=np.maximum(value[keep], 0), minlength=n) / 3
        out[4, at:end] = np.log1p(words)
    return out


def features(rows: DataFrame, scores: Scores) -> DataFrame:
    """(id, label, *FEATURES) of rows (id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = scores.table() if table is None else table
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, text_features(batch.column(2), table))], names=["id", "label", *FEATURES])

    kind = rows.schema["id"].dataType.simpleString()
    return mapped(rows.select("id", "label", "text"), run, f"id {kind}, label int, " + ", ".join(f"{c} double" for c in FEATURES))


def _weights(examples: DataFrame) -> tuple[tuple[float, ...], float]:
    """Weights of FEATURES and the constant, by logistic regression in Spark."""
    if examples.select("label").distinct().count() < 2:
        return UNFITTED
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(examples.withColumn("label", F.col("label").cast("double")))
    model = LogisticRegression(regParam=1e-3, maxIter=100).fit(ready)
    return tuple(map(float, model.coefficients)), float(model.intercept)


@dataclass
class Model:
    scores: Scores
    weights: tuple[float, ...]
    constant: float


def fold_of(id_):
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Model:
    """The models and the logistic function, from all texts of `docs` and the labels that are not held out (see `toxicity`)."""
    fold = fold_of(F.col("id"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Labels grow with the corpus: the same join at every size, in which the side of the labels is hashed and no text is sorted.
    joined = source.where(F.col("id").isNotNull() & (fold != 2)).join(known.where(fold != 2).hint("shuffle_hash"), "id")
    with passing(docs.sparkSession):  # the model goes to the tasks; no table is read after it is made
        return _learnt(source, joined, fold, labelled)


def _learnt(source: DataFrame, joined: DataFrame, fold: Column, labelled: int) -> Model:
    taught = written(joined.select("id", F.coalesce("text", F.lit("")).alias("text"), "label", (fold == 3).alias("kept")), "labelled")
    grams = written(gram_counts(source, taught), "grams")
    scores = written(gram_scores(grams, shared_backoff(grams)), "scores")
    examples = written(features(taught.where("kept"), Scores.sent(scores, "fit")), "examples")
    fitting = examples.orderBy(F.xxhash64("id"), "id").limit(labelled)
    return Model(Scores.sent(scores, "score"), *_weights(fitting))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a column `score_col`, row by row and without a shuffle."""
    scores, weights, constant = model.scores, np.array(model.weights), model.constant
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = scores.table() if table is None else table
            score = 1 / (1 + np.exp(-np.clip(weights @ text_features(batch.column(at), table) + constant, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, score_col])

    text = [F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*text)
    return mapped(rows, run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, threshold: float = THRESHOLD,
) -> DataFrame:
    """(`id_col`, held_out, score, predicted) for every row of `docs`; score: 0 to 1, higher if toxic is likelier.

    Rows whose crc32 of the id as text leaves 2 modulo 4 are held out: their labels are never looked at. Of the other labelled rows,
    remainders 0 and 1 are counted and remainder 3 fits the logistic function; then all three are counted. Null and empty texts, and texts without words, have
    a difference of 0 and are scored like any other; a null id is never held out and never labelled; null labels are ignored, and of several labels
    of an id the largest counts; the fit takes `labelled` rows at most, the counts take all; without labels of both classes the weights are `UNFITTED`; an empty table gives an empty table. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = scored(rows, learn(docs, labels, id_col, text_col, label_col, labelled))
    held_out = F.coalesce(fold_of(F.col("id")) == 2, F.lit(False))
    return found.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
