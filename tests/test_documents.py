"""Documents read once, where their rows lie: gates in Python against those of expressions, plans without a shuffle, odd documents against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from textloom import plans
from textloom.functions import clean, gates, judge, lex
from textloom.operators import chunk

PIECES = [
    "The quick brown foxes jumped over many lazy dogs near the old river bank today", "and then rested", "Section 4.2: Scope", "METHODS AND DATA", "# References", "Contents", "page 3 of 9", "Copyright 2020 Someone",
    "all rights reserved.", "https://x.org/a", "1) Prove that x is even?", "(2) compute the sum", "12 apples", "Why does it rain?", "It follows that b equals c, because a is called d", "Introduction ........ 12", "Table of contents",
    "No part of this document may be copied", "ISBN 12-34", "see chapter 4", "as we shall see", "discussed below", "in the next\nsection", "From the previous page it was clear", "0123456789 0123456789 0123456789", "don't well-known -- a_b", "Größe über naïve Straße",
    "ÄÖÜSS Ⅷ", "١٢٣ ٤٥", "完整的句子", "x", "   ", "\t", "\x85", " ", "\x0b", "\n\n", "\n", "\n", "\n- bullet one", "\n• bullet", ". ", "? ", "! A", "…", " ", "　", "İstanbul K", "ſet", "list of figures", "version history", "therefore", "Solution",
    "to be proved later", "later on in the book", "creative commons licence 4",
]


def texts(n: int, seed: int = 5, between: tuple[str, ...] = (" ", "\n")) -> list[str]:
    draw = random.Random(seed)
    return ["", " ", "a", "\n", "#", "###", "# #"] + [draw.choice(between).join(draw.choices(PIECES, k=draw.choice((1, 2, 4, 9, 25)))) for _ in range(n)]


def test_gates_in_python_are_those_of_expressions(spark):
    df = spark.createDataFrame(list(enumerate(texts(2500))), "n int, x string").repartition(4)
    m, line = F.col("m"), lex.ustrip(F.col("x"))
    want = gates.measured(df, "x").select(
        "x", gates.is_non_content(m), gates.is_prompt_only(m), gates.is_high_value(m, 40), gates.is_high_value(m, 160), gates.is_heading(line), gates.is_bad_heading(F.col("x")), gates.is_boilerplate(line), m["letters"],
        (m["chars"] >= 40) & gates.is_useful(m),
    )
    kinds = set()
    for x, *flags in map(tuple, want.collect()):
        t, s = judge.Text(x, judge.Hints(x)), x.strip()
        got = [t.non_content(), t.prompt_only(), t.high(40), t.high(160), judge.heading(s), judge.bad_heading(x), judge.boilerplate(s), t.letters, judge.useful(s)]
        assert got == flags, x
        kinds |= {(n, f) for n, f in enumerate(flags) if isinstance(f, bool)}
    assert len(kinds) == 16  # each gate lets some pass and some not


def test_every_cue_and_reference_has_its_word():
    for said, words in (("a List of Tables b", judge.CUE_WORDS), ("Information to all users", judge.CUE_WORDS), ("reproduced by permission", judge.CUE_WORDS), ("Submission guideline", judge.CUE_WORDS),
                        ("this publication is protected", judge.CUE_WORDS), ("printed in the united states", judge.CUE_WORDS), ("change log", judge.CUE_WORDS), ("issn", judge.CUE_WORDS),
                        ("as we will see", judge.ELSEWHERE_WORDS), ("cf. the following exercise", judge.ELSEWHERE_WORDS), ("discussed above", judge.ELSEWHERE_WORDS), ("to be shown below", judge.ELSEWHERE_WORDS)):
        assert judge.CUE.search(said) or judge.CROSS_REFERENCE.search(said), said
        assert any(w in said.lower() for w in words), said


ONE_PASS = ["section_parse", "line_gates", "chunks_document", "chunks_page", "chunks_section", "chunks_line", "chunks_needle", "chunks_paragraph"]


@pytest.mark.parametrize("name", ONE_PASS)
def test_texts_are_not_shuffled(spark, sf, name):
    """A text that goes with each of its lines or sentences through a shuffle or a sort makes the disk grow with the square of the document."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with odd documents, and one long enough that a pool is cut."""
    long = "\n".join(f"Line {n} of the long text says that the pump number {n} takes in water from the upper tank each day." for n in range(5_050))
    rows = [(n, x, "en", "s", len(x)) for n, x in enumerate(x.replace("\r", "").replace("<", "").replace("\x0c", "") for x in texts(300, 9, ("", " ", "\n"))) if clean.clean_text(x) == clean.squeeze(x)]  # the SQL has no hard wraps
    rows = [r for r in rows if not any(c in r[1] for c in "İKſ\x0b")]  # RE2 folds these like i, k and s, and has no \\x0b in \\s
    rows += [(10_001, long, "en", "s", len(long))]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    return str(path), con


@pytest.mark.parametrize("name", [n for n in ONE_PASS if n != "chunks_page"])
def test_odd_documents_as_in_sql(spark, odd, name):
    path, con = odd
    got = plans.QUERIES[name](spark, path)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_sections_of_several_rows_are_those_of_documents(spark, odd):
    from textloom.functions import structure
    from textloom.plans.text_queries import docs

    d = docs(spark, odd[0]).where("doc_id < 10000")
    for level in ("section", "line", "needle", "paragraph"):
        whole, parts = chunk.of_documents(d, [level]), chunk.of_sections(structure.sections(d).repartition(5), level)
        assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect()))
