"""What rounds and pools read again: earlier claims by their keys alone, chunks of several levels in one pass."""

import random

import pytest
from pyspark.sql import functions as F
from textloom import job
from textloom.generation import rounds
from textloom.operators import chunk, dedupe
from textloom.plans.text_queries import docs


@pytest.mark.parametrize("at_once", [0, 20_000])
def test_claims_after_earlier_ones_are_those_of_all(spark, monkeypatch, at_once):
    """A round's claims depend on earlier ones only by the keys that these hold; rows claimed by one task or beside it are decided alike."""
    draw = random.Random(3)
    words = ["explain", "pumps", "valves", "tanks", "rivers", "Prices", "the", "of", "according to", "laws"]
    rows = [(n // 60, n, " ".join(draw.choices(words, k=draw.choice((2, 3, 6))))) for n in range(180)]
    df = spark.createDataFrame(rows, "round int, n int, x string").repartition(3)
    monkeypatch.setattr(dedupe, "AT_ONCE", 10**9)
    want = {r.n: r.accepted for r in dedupe.claimed(df, "x", ["round", "n"]).collect()}
    monkeypatch.setattr(dedupe, "AT_ONCE", at_once)
    assert {r.n: r.accepted for r in dedupe.claimed(df, "x", ["round", "n"]).collect()} == want
    got, keys = {}, None
    for k in range(3):
        made = dedupe.claimed(df.where(F.col("round") == k), "x", ["round", "n"], earlier=keys).localCheckpoint()
        got |= {r.n: r.accepted for r in made.collect()}
        held = made.where("accepted").select("near_key", "stem_key")
        keys = held if keys is None else keys.unionByName(held)
    assert got == want and set(want.values()) == {True, False}


def test_levels_in_one_pass(spark, sf):
    d = docs(spark, sf).where("doc_id < 60")
    whole = chunk.of_documents(d, list(chunk.LEVELS))
    assert sorted(map(repr, whole.collect())) == sorted(repr(r) for level in chunk.LEVELS for r in chunk.of_documents(d, [level]).collect())
    bare = chunk.of_documents(d, ["line", "paragraph"], texts=("paragraph",))
    assert {(r.level, r.text is None, r.target_text is None) for r in bare.collect()} == {("line", True, True), ("paragraph", False, False)}
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_personas_of_one_level_share_its_chunks(spark, sf):
    d = docs(spark, sf).where("doc_id < 30")
    people = [rounds.builtin("summarizer"), rounds.Persona("other", "Reads too.", "section"), rounds.builtin("line-analyst")]
    pool = job.all_pools(d, people).groupBy("persona").count().collect()
    n = {r.persona: r["count"] for r in pool}
    assert n["summarizer"] == n["other"] > 0 and n["line-analyst"] > n["other"]
