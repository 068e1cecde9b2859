"""Keys of instructions for duplicates and diversity, and the ordered claim of instructions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates, lex
from .prefix import kept, running_sum

NEAR_TOKENS, STEM_TOKENS, STEM_CHARS = 12, 5, 48
#: Rows that one task claims one by one without looking for those that are free.
AT_ONCE = 20_000
#: From so many accepted rows on, a stem that was taken twice may not pass this share.
STEM_FROM, STEM_TWICE, STEM_SHARE = 3, 2, 0.14


def normalized(c: Column) -> Column:
    """White space collapsed, case folded (with ß as ss), punctuation stripped at the ends."""
    folded = F.replace(F.lower(lex.ustrip(F.coalesce(c, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(folded, r"(?U)\s+", " "), F.lit(lex.EDGES))


def _tokens(normal: Column) -> Column:
    """ASCII tokens of two signs or more that are no stopwords, of a normalized text."""
    stop = F.array(*map(F.lit, lex.STOPWORDS))
    return F.filter(F.regexp_extract_all(normal, F.lit(lex.TOKEN), 0), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def _near(own: Column) -> Column:
    return F.sha1(F.array_join(F.slice(F.array_sort(F.array_distinct(own)), 1, NEAR_TOKENS), " ").cast("binary"))


def near_key(c: Column) -> Column:
    """with_keys()'s near_key of one text as an expression."""
    return _near(_tokens(normalized(c)))


def with_keys(df: DataFrame, text: str) -> DataFrame:
    """df with exact_key (of the normalized text), near_key (the same where the first distinct tokens, sorted, are the same) and stem_key (how the text opens).

    A row's number beside what is made once, the normalized text and then its tokens, keeps each from being made anew for every key.
    """
    made = df.withColumn("_n", F.struct(normalized(F.col(text)).alias("n"), F.monotonically_increasing_id().alias("row")))
    made = made.withColumn("_t", F.struct(_tokens(F.col("_n.n")).alias("t"), F.monotonically_increasing_id().alias("row")))
    normal, own = F.col("_n.n"), F.col("_t.t")
    keys = {
        "exact_key": F.sha1(normal.cast("binary")),
        "near_key": _near(own),
        "stem_key": F.when(F.size(own) > 0, F.array_join(F.slice(own, 1, STEM_TOKENS), " ")).otherwise(F.substring(normal, 1, STEM_CHARS)),
    }
    return made.withColumns(keys).drop("_n", "_t")


def first_of_near(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each near key, by the columns `order`: the batch form, without a cap on stems. Of rows equal in all of these one stays.

    The least of each key is pre-aggregated before the shuffle, so that a frequent key does not gather its rows in one task.
    """
    first = with_keys(df, text).groupBy("near_key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*", "near_key")


class Claims:
    """Claims instructions one by one in a total order.

    A claim fails if the instruction points at its source, if its near key was claimed (an exact duplicate has the same near key), or if its stem is over its
    share. A claim that failed leaves nothing behind. Digests are kept as 20 bytes each.
    """

    def __init__(self, near: set[bytes] | None = None, share: float = STEM_SHARE, start: int = STEM_FROM):
        self.near, self.stems, self.accepted = near or set(), {}, 0
        self.share, self.start = min(1.0, max(0.05, share)), max(1, start)

    def claim(self, near: str, stem: str, cites: bool, others: int = 0, held: int = 0) -> bool:
        """others: rows accepted so far that do not go through this object; held: those of them that came before all others and have this stem."""
        digest, taken, accepted = bytes.fromhex(near), self.stems.get(stem, held), self.accepted + others
        crowded = accepted >= self.start and taken >= STEM_TWICE and (taken + 1) / (accepted + 1) > self.share
        if cites or digest in self.near or crowded:
            return False
        self.near.add(digest)
        self.stems[stem] = taken + 1
        self.accepted += 1
        return True


def claimed(df: DataFrame, text: str, order: list[str], share: float = STEM_SHARE, start: int = STEM_FROM, earlier: DataFrame | None = None) -> DataFrame:
    """df with its keys and accepted (boolean), by claims in the order of the columns `order`, then of the keys; every row of df is there once.

    A claim depends on those before it, but only where it may fail: a row whose near key is its own, and whose stem occurs no more often than any share allows, is accepted whatever comes before it. Such
    rows are counted by a running sum and pass; only the others are claimed one by one in a task, each with the number of rows accepted without it by then. Rows that cite their source fail at once.

    earlier: near_key and stem_key of rows that were accepted before all of df. They would be accepted again, so what they hold is counted, not claimed anew.
    """
    keyed = with_keys(df, text).withColumn("_cites", gates.cites_context(F.col(text)))
    # Rows are known by a number of their own: equal or null values of the order must not meet each other's verdicts.
    keyed = kept(keyed.withColumn("_row", F.monotonically_increasing_id()))
    slim = keyed.where(~F.col("_cites")).select(*order, "near_key", "stem_key", "_row")
    held = 0
    if earlier is None:
        slim = slim.withColumn("_held", F.lit(0).cast("long"))
    else:
        held, stems = earlier.count(), earlier.groupBy("stem_key").agg(F.count(F.lit(1)).alias("_held"))
        slim = slim.join(earlier.select("near_key").distinct(), "near_key", "left_anti").join(stems, "stem_key", "left")
        slim = kept(slim.withColumn("_held", F.coalesce("_held", F.lit(0).cast("long"))))
    few = keyed.count() <= AT_ONCE
    many = lambda key, count, most, name: slim.groupBy(key).agg(count.alias("n")).where(F.col("n") > most).select(key, F.lit(True).alias(name))
    here = F.count(F.lit(1))
    if few:
        ranked = slim.withColumns({"_free": F.lit(0), "_before": F.lit(0).cast("long")})
    else:
        marked = slim.join(many("near_key", here, 1, "_near"), "near_key", "left").join(many("stem_key", here + F.max("_held"), STEM_TWICE, "_stem"), "stem_key", "left")
        marked = marked.withColumn("_free", (F.coalesce("_near", "_stem").isNull()).cast("int"))
        ranked = kept(running_sum(marked.drop("_near", "_stem"), [*order, "near_key", "stem_key", "_row"], "_free", "_before"))
    open_rows = ranked.where("_free = 0").select("_row", "near_key", "stem_key", "_before", "_held", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims = Claims(share=share, start=start)
        for b in batches:
            row, *columns = (b.column(b.schema.get_field_index(n)) for n in ("_row", "near_key", "stem_key", "_before", "_held"))
            made = [claims.claim(n, s, False, held + k, h) for n, s, k, h in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([row, pa.array(made, pa.bool_())], ["_row", "accepted"])

    made = open_rows.repartition(1).sortWithinPartitions(*[x for c in order for x in (F.col(c).isNull(), F.col(c))], "near_key", "stem_key", "_row").mapInArrow(run, "_row long, accepted boolean")
    verdicts = made if few else ranked.where("_free = 1").select("_row", F.lit(True).alias("accepted")).unionByName(made)
    return keyed.join(verdicts, "_row", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))).drop("_cites", "_row")
