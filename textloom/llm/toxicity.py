"""Toxicity of texts whose words may be disguised: noisy-channel deobfuscation, then a score of the restored text.

A disguised word (digits and signs for letters, letters spaced out, letters repeated) spans a lattice: at each character, the letters that it
may stand for, nothing where a repeat or a separator may go, or a boundary of words where a separator is. Viterbi decoding finds the path of the highest probability
under a character trigram model of all texts and the channel's costs. Plain words have a lattice of one path and are taken as they are. What may be a disguise or not (signs around
a word, a doubled letter) gives both words, decoded and as it stands. A logistic model over restored words and their beginnings gives the score.

What is gathered: trigram counts of all texts (28^3 cells, whatever the input), and the model, fitted on at most SAMPLE labelled rows that are not held out
(lowest hashes of doc_id first); its features are all words of these whose counts differ between the labels beyond chance. Labels, lang, source and doc_id are no inputs of a score.

Cases: null and empty texts get the score of a text without any feature. Repeated rows are each scored. Several labels of a doc_id count as toxic if half of them
are. Rows of one text count once in fitting, by the same rule. Without labels of both kinds all scores are the share of toxic labels (0 without labels). A null doc_id is not held out.
A text of any length is scored whole by one task. Extra columns are ignored, and kept by clean().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, table

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
#: The model's own choice of features within its sample: in this many texts at least, and this many standard deviations away from chance.
LEAST_TEXTS, LEAST_Z = 5, 4.0
#: Of five parts of the rows by crc32(doc_id), the one at 0 is held out.
FOLDS = 5
#: Beginnings of words that are features beside the words.
STEMS = (4, 5)
#: What signs may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Costs in nats: a sign for a letter, a letter of a run of three or more dropped, a separator dropped, a sign that may be a letter dropped, another dropped.
SIGN, REPEAT, SEPARATOR, LETTER, OTHER = 1.0, 0.5, 0.3, 9.0, 3.0
SEPARATORS = " .-_*~"
CLASSES = 28  # 0: a boundary, 1 to 26: a to z, 27: any other letter
PLAIN = re.compile(r"[^\W\d_]+")
TWICE, THRICE, LETTERS = re.compile(r"(.)\1"), re.compile(r"(.)\1\1"), re.compile(r"(.)\1+")
RUN = re.compile(r"(.)\1*", re.DOTALL)
#: A letter or a sign for one; spans of them may follow an opening sign and end before any punctuation.
_UNIT = rf"(?:[^\W_]|[{re.escape(''.join(LEET))}])"
SPACED = re.compile(rf"""(?<![^\s(\[{{<"'«“„‘*]){_UNIT}(?:[ .\-_*~]{_UNIT}){{2,}}(?=[^\w\s]*(?!\S))""")
OUTER = ".,;:?\"'()[]{}<>«»„“”’…*-_~#%&/\\="
#: Signs around a word that stand for no letter, and those that may be punctuation or a letter.
SHED, EITHER = "".join(c for c in OUTER if c not in LEET), "!|+$@€"
SIGNS, SPACES = frozenset(LEET), frozenset(SEPARATORS)
#: Words that a worker remembers in each of two generations.
REMEMBERED = 75_000


def char_class(c: str) -> int:
    o = ord(c) - 96
    return o if 1 <= o <= 26 else 27 if c.isalpha() else 0


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams of all texts, by class."""
    of_byte = np.full(256, 0, dtype=np.int32)
    of_byte[97:123] = of_byte[65:91] = np.arange(1, 27)
    of_byte[128:] = 27

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for b in batches:
            c = of_byte[np.frombuffer(b" ".join([b"", *(x.as_py() or b"" for x in b.column(0)), b""]), dtype=np.uint8)]
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
        own = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], ["code", "n"])

    small_batches(docs.sparkSession)
    got = docs.select(F.col("text").cast("binary")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES**3)
    for r in got:
        out[r["code"]] = r["n"]
    return out.reshape(CLASSES, CLASSES, CLASSES)


class Restorer:
    """Restores disguised words under a character model."""

    def __init__(self, counts: np.ndarray):
        two = counts.sum(axis=0) + 0.5  # of the last two characters, to fall back on
        back = two / two.sum(axis=1, keepdims=True)
        smooth = 2.0
        self.cost = (-np.log((counts + smooth * back[None]) / (counts.sum(axis=2, keepdims=True) + smooth))).tolist()

    def decode(self, word: str, repeats: int = 3, bounds: bool = False) -> str:
        """The likeliest letters behind a lower-case word or a span of spaced letters; letters of runs of `repeats` or more may be dropped, and separators be boundaries of words (blanks) with `bounds`."""
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # texts are chains of (before, letter)
        run_of = [len(m.group()) for m in RUN.finditer(word) for _ in m.group()]
        last = ""
        for c, run in zip(word, run_of, strict=True):
            letters = LEET.get(c, c if c.isalpha() else "")
            drop = REPEAT if c == last and run >= repeats else SEPARATOR if c in SEPARATORS else LETTER if c in LEET else OTHER if not c.isalpha() else None
            price = SIGN if c in LEET else 0.0
            if bounds and c in SEPARATORS:
                letters = " "
            last = c
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, text) in paths.items():
                if drop is not None and ((a, b) not in new or cost + drop < new[a, b][0]):
                    new[a, b] = (cost + drop, text)
                for x in letters:
                    k = char_class(x)
                    total = cost + price + self.cost[a][b][k]
                    if (b, k) not in new or total < new[b, k][0]:
                        new[b, k] = (total, (text, x))
            paths = new
        text = min(((cost + (self.cost[a][b][0] if b else 0.0), text) for (a, b), (cost, text) in paths.items()), key=lambda p: p[0])[1]
        out = []
        while text:
            text, x = text
            out.append(x)
        return "".join(reversed(out)).strip()

    def restore(self, word: str) -> str:
        """The letters of a lower-case word: as they are, or decoded where it is disguised; empty if it has none."""
        core = word.strip(OUTER)
        if PLAIN.fullmatch(core) and not THRICE.search(core):
            return core
        bare = core.strip(EITHER)
        if PLAIN.fullmatch(bare) and not THRICE.search(bare) and core[:1] == bare[:1] and not core.endswith("$"):
            return bare
        return self.decode(core) if any(c.isalpha() for c in core) else ""

    def forms(self, word: str) -> set[str]:
        """All words that a lower-case word or span may stand for: restored, and decoded with its outer signs as letters and without them, doubled letters kept and undone, and as several words if it is a span."""
        found = {w for w in (self.restore(word),) if w}
        twice = TWICE.search(word) is not None
        spaced = word[1:2] in SPACES and SPACED.fullmatch(word) is not None
        if not (twice or spaced) and SIGNS.isdisjoint(word):
            return found
        whole = {word.strip(SHED), word.strip(OUTER), word.strip(OUTER + EITHER)}
        if spaced:
            # Several words may be spaced out together; trigrams alone often hide a word of one letter at an end.
            found.update(x for w in whole for x in self.decode(w, 2, True).split())
            whole |= {x for w in whole for x in (w[2:], w[:-2], w[2:-2])}
            found.update(self.decode(w) for w in whole)
            twice = True
        for w in whole:
            if not SIGNS.isdisjoint(w):
                found.add(self.decode(w))
            if twice and TWICE.search(w):
                found.add(self.decode(w, 2))
        return found - {""}


class Reader:
    """The features of a text: ids if a vocabulary is given, else the features themselves."""

    def __init__(self, restorer: Restorer, vocabulary: dict[str, int] | None = None):
        self.restorer, self.vocabulary = restorer, vocabulary
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        #: What features come to when each run of a letter is one letter: decoding doubled letters changes a word, but not that.
        known = vocabulary or {}
        self.bare = {LETTERS.sub(r"\1", x) for x in known if not x.endswith("^")}
        self.stems = {LETTERS.sub(r"\1", x[:-1]) for x in known if x.endswith("^")}

    def _hopeless(self, core: str) -> bool:
        """Whether no form of a word of letters, with runs of letters shortened or not, has a feature of the vocabulary."""
        bare = LETTERS.sub(r"\1", core)
        return bare not in self.bare and not any(bare[:n] in self.stems for n in range(1, STEMS[-1] + 1))

    def _features(self, word: str) -> tuple:
        core, known = word.strip(SHED), self.vocabulary
        if core.isalpha() and TWICE.search(core) is None:
            forms: object = (core,)  # a plain word
        elif known is not None and core.isalpha() and self._hopeless(core):
            return ()
        else:
            forms = self.restorer.forms(word)
        found = {x for w in forms for x in (w, *(f"{w[:n]}^" for n in STEMS if len(w) > n))}
        return tuple(found) if known is None else tuple(known[x] for x in found if x in known)

    def __call__(self, text: str) -> set:
        text = text.lower()
        words = set(text.split())
        words.update(m.group() for m in SPACED.finditer(text))
        young, old = self.young, self.old
        out: set = set()
        for w in words:
            got = young.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    got = self._features(w)
                young[w] = got
            if got:
                out.update(got)
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, y) of at most SAMPLE labelled documents that are not held out, one for each text."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    rows = rows.where(~held_out("_id"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()
    first = cut(rows.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("h")).join(F.broadcast(first), "_id")
    half = lambda c: (F.avg(c) >= 0.5).cast("int").alias(c)
    return cut(texts.groupBy("h").agg(F.min("_id").alias("_id"), half("y")).groupBy("_id").agg(half("y")))


def _fit(rows: pa.Table, size: int) -> np.ndarray:
    """Weights of a ridge logistic regression over rows (f: ids of 0/1 features, y), the last the intercept; by Adam over all rows, always the same steps."""
    y = rows["y"].to_numpy().astype(float)
    lists = rows["f"].combine_chunks()
    f = lists.flatten().to_numpy()
    r = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for t in range(1, 301):
        s = np.bincount(r, w[f], minlength=len(y)) + w[size]
        d = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
        g = np.append(np.bincount(f, d[r], minlength=size), d.sum())
        g[:size] += 0.5 * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[Restorer, dict[str, int], np.ndarray]:
    """The restorer, the vocabulary and the weights."""
    spark = docs.sparkSession
    small_batches(spark)
    restorer = Restorer(trigrams(docs))
    sample = _sample(docs, labels)
    n1, n = (sample.agg(F.sum("y"), F.count(F.lit(1))).first()) or (0, 0)
    n1 = n1 or 0
    if not 0 < n1 < n:
        share = n1 / n if n else 0.0
        return restorer, {}, np.array([math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)])
    share, shared = n1 / n, spark.sparkContext.broadcast(restorer)
    # The sample is bounded by SAMPLE, so its ids may be broadcast; each sampled row is read where its text lies.
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "_id").select("text", "y", "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, own = Reader(shared.value), (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(own[0] | own[1])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in own)], ["feature", "n0", "n1"])

        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                own[y.as_py()].update(read(t.as_py() or ""))
            if len(own[0]) + len(own[1]) > REMEMBERED:
                yield out()
                own = (Counter(), Counter())
        yield out()

    chance = (F.col("n0") + F.col("n1")) / n
    z = (F.col("n1") - n1 * chance) / F.sqrt(n * share * (1 - share) * chance)
    counted = texts.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = counted.where(F.col("n0") + F.col("n1") >= LEAST_TEXTS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy("feature")
    vocabulary = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}  # bounded by the sample's words
    known = spark.sparkContext.broadcast(vocabulary)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(shared.value, known.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(read(t.as_py() or "")) for t in b.column(0)], pa.list_(pa.int32())), b.column(1), b.column(2)], ["f", "y", "id"])

    rows = texts.mapInArrow(features, "f array<int>, y int, id long").orderBy("id").toArrow()  # at most SAMPLE rows of a few ids, always in one order
    return restorer, vocabulary, _fit(rows, len(vocabulary))


def score(docs: DataFrame, labels: DataFrame, name: str = "_score") -> DataFrame:
    """docs with a column `name`, which they lack (double, 0 to 1)."""
    restorer, vocabulary, weights = train(docs.select("doc_id", "text"), labels)
    model = docs.sparkSession.sparkContext.broadcast((restorer, vocabulary, weights))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, w = model.value
        read, base = Reader(own, known), float(w[-1])
        for b in batches:
            got = [1 / (1 + math.exp(-max(-40.0, min(40.0, base + sum(w[i] for i in sorted(read(t.as_py() or ""))))))) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, name])

    at = docs.columns.index("text")
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = score(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic. All columns of docs stay, whatever their names."""
    name = "_score"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return score(docs, labels, name).where(F.col(name) < 0.5).drop(name)
