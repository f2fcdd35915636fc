"""Language identification by hierarchical discrimination.

Features are the shares of hashed byte 3-grams of the letters of a text.  A first
level tells language families apart, a second one the languages of a family; both
levels are one-versus-one linear support vector machines.

The machines are fitted on SAMPLE texts, dealt evenly over all languages there are, one
text each at least (a bounded, documented sample: the rows with the least hashes);
everything else reads all rows.  What leaves the executors is the count of each language
and that sample's feature rows, of fixed size.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Texts the machines are fitted on, and hashed 3-grams (a power of two).
SAMPLE, DIMENSIONS = 4000, 4096
#: Classes that are told apart at once, each pair by a machine.
WIDEST = 16
#: Families of languages; a language that is not named is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi ur bn mr ne pa gu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_RUNS = re.compile(rb" {2,}")


def features(text: str) -> np.ndarray:
    """Shares of hashed byte 3-grams, as a unit vector; letters alone count, in lower case."""
    data = np.frombuffer(_RUNS.sub(b" ", b" " + text.lower().encode().translate(_TO_SPACE) + b" "), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.sqrt(np.bincount(code, minlength=DIMENSIONS)).astype(np.float32)
    return counts / np.sqrt((counts * counts).sum())


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge machine for labels +1 and -1,
    by accelerated gradient steps; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = penalty * ahead - 2 * ((share * y * slack) @ x)
        new = ahead - 0.25 * gradient
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


class OneVersusOne:
    """Votes of linear machines for each pair of classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        machines = []
        for a, b in self.pairs:
            own = np.isin(y, [self.classes[a], self.classes[b]])
            machines.append(linear_svm(x[own], np.where(y[own] == self.classes[a], 1, -1).astype(x.dtype)))
        self.weights = np.array(machines, x.dtype).reshape(len(machines), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row (ties by the sum of margins) and its least margin."""
        n = len(self.classes)
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        least = np.full((len(x), n), np.inf)
        votes = np.zeros((len(x), n))
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            for c, own in ((a, m), (b, -m)):
                least[:, c] = np.minimum(least[:, c], own)
                votes[:, c] += (own > 0) + 1e-3 * np.tanh(own)
        best = votes.argmax(axis=1)
        return np.array(self.classes, object)[best], least[np.arange(len(x)), best]


def grouped(centres: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` groups of classes, alike in size, by halving along the direction in
    which their centres differ most."""
    group = np.zeros(len(centres), int)
    while len(np.unique(group)) * 2 <= most:
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            if len(own) < 2:
                continue
            spread = centres[own] - centres[own].mean(axis=0)
            along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0]
            group[own[np.argsort(along, kind="stable")[len(own) // 2 :]]] = group.max() + 1
        if len(np.unique(group)) >= len(centres):
            break
    return group


class LanguageModel:
    """Families first, then the languages of the family that was found.

    More than WIDEST families, or languages of one, are told apart by groups of like ones
    first, so that the number of machines grows with that of languages, not its square.
    """

    def __init__(self, x: np.ndarray, languages: list[str]):
        y = np.array(languages, object)
        family = np.array([_FAMILY.get(c, c) for c in languages], object)
        self.classes = sorted(set(languages))
        self._top = _Level(x, [family, y])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names = np.full(len(texts), UNKNOWN, object)
        scores = np.zeros(len(texts))
        at = np.array([i for i, t in enumerate(texts) if t and _LETTER.search(t)], int)
        if len(at) and self.classes:
            names[at], margin = self._top.predict(np.stack([features(texts[i]) for i in at]))
            scores[at] = 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))
        return names.tolist(), scores.tolist()


class _Level:
    """One-versus-one machines over the classes of the first of ``levels``, or over groups of
    them, and a level below each."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]):
        first = levels[0]
        self.classes = sorted(set(first))
        if len(self.classes) > WIDEST:
            centres = np.stack([x[first == c].mean(axis=0) for c in self.classes])
            of = dict(zip(self.classes, grouped(centres, WIDEST).tolist()))
            first, below = np.array([of[c] for c in first], object), levels
        else:
            below = levels[1:]
        self.machines = OneVersusOne(x, first)
        self.below = {c: _Level(x[first == c], [level[first == c] for level in below]) for c in set(first)} if below else {}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, margin = self.machines.predict(x)
        for c, level in self.below.items():
            own = found == c
            if own.any():
                name, inner = level.predict(x[own])
                found[own], margin[own] = name, np.minimum(margin[own], inner)
        return found, margin


def held_out(doc_id: Column) -> Column:
    """One document of four takes no part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on ``sample`` labelled rows with a letter that are not held out; each row's own
    text goes with its label, whatever other rows have its doc_id."""
    labelled = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    each = max(1, sample // max(1, len(counts)))
    # Hashes below a share of the range leave a little more than `each` rows of a language
    # to be numbered, however many it has; their features are of fixed size.
    rare = each + 6 * each**0.5 + 20
    shares = docs.sparkSession.createDataFrame([(c, min(1.0, rare / n)) for c, n in counts.items()], "lang string, share double")
    hashed = F.xxhash64("doc_id", "text")
    few = labelled.withColumn("place", hashed).join(F.broadcast(shares), "lang").where(F.pmod("place", F.lit(1 << 30)) <= F.col("share") * (1 << 30))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(x, pa.binary())], ["lang", "place", "x"])

    made = few.select("lang", "place", "text").mapInArrow(rows, "lang string, place long, x binary")
    n = F.row_number().over(Window.partitionBy("lang").orderBy("place", "x"))
    got = made.withColumn("n", n).where(F.col("n") <= each).select("lang", "x").collect()
    got.sort()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32).reshape(len(got), DIMENSIONS)
    return LanguageModel(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    The text alone is looked at.  A null text, or one without a letter, is ``und`` with
    score 0; so is every text if there was nothing to learn from.  A null doc_id is not
    held out.  Repeated rows give repeated rows, an empty table an empty one; other
    columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or learn(docs))  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def documents_with_language(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is found, all columns, in one pass.

    If there was nothing to learn from, no language can be told: then only null texts and
    texts without a letter go.  An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column("text").to_pylist()
                if shared.value.classes:
                    keep = [n != UNKNOWN for n in shared.value.predict(texts)[0]]
                else:
                    keep = [bool(t and _LETTER.search(t)) for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
