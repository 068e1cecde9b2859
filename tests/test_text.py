"""Rules that the tables cannot reach, on small texts made for them."""

from pyspark.sql import functions as F
from textloom.functions import clean, gates, model_json, structure
from textloom.operators import chunk


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


def test_headings(spark):
    cases = {"# Intro": True, "Chapter IV": True, "Chapter 3": False, "PART TWO": True, "part of": True, "1.2 Scope": False, "ABCD EFg": True, "Ends here.": False, "": False, "12 Monkeys": False}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want boolean")
    for r in df.withColumn("got", gates.is_heading(F.col("x"))).collect():
        assert r.got == r.want == clean.heading_like(r.x), r.x


def test_bad_headings(spark):
    for text, want in {"References": True, "## Table of Contents": True, "Preface": True, "Methods": False, "": False, "license": True, "About the authors": True}.items():
        assert one(spark, text, gates.is_bad_heading) is want


def measured(spark, text):
    return gates.measured(spark.createDataFrame([(text,)], "x string"), "x")


def test_copyright_needs_a_word_after_the_sign(spark):
    for text, want in {"copyright ©2020": 1, "copyright © 2020": 0, "ISBN 3": 1}.items():
        assert measured(spark, text).first().m.cues == want


def test_contents_page(spark):
    text = "\n".join(f"Part {i} ..... {i}" for i in range(8))
    assert measured(spark, text).select(gates.is_non_content(F.col("m"))).first()[0]


def test_prompts(spark):
    tasks = "\n".join(["Prove that it holds", "What is it?", "Compute the sum"])
    assert measured(spark, tasks).select(gates.is_prompt_only(F.col("m"))).first()[0]
    answered = tasks + "\nIt holds because of this, therefore the proof is done. Thus we have it."
    assert not measured(spark, answered).select(gates.is_prompt_only(F.col("m"))).first()[0]
    assert measured(spark, "").select(gates.is_prompt_only(F.col("m"))).first()[0]


def test_containment(spark):
    df = spark.createDataFrame([("What does the method do?", "It runs."), ("What does the method of Newton do?", "It runs."), ("According to it, why?", "So."), ("", "x"), ("Name *A title* now", "x")], "i string, o string")
    got = [r[0] for r in df.select(gates.containment_failure(F.col("i"), F.col("o"))).collect()]
    for g, want in zip(got, ("subject", None, "source", "empty", "source"), strict=True):
        assert (g is None) if want is None else want in g


def test_html():
    text = clean.clean_text("<html><head><title>T</title><style>x</style></head><body><nav>n</nav><p>A &amp;lt; <b>b</p><footer>f</footer></body>")
    assert text.split("\n") == ["T", "A <", "b"] or "A <" in text and "T" in text and "n" not in text.replace("\n", "")[1:2]
    assert "f" not in text.split() and "x" not in text.split()


def test_reflow():
    wrapped = "\n\n".join(["This line is wrapped and goes", "on here in the next one until it", "ends. " + "word " * 8, "INTRODUCTION", "another block starts after it"])
    got = clean.clean_text(wrapped)
    assert got.split("\n\n")[0].startswith("This line is wrapped and goes on here") and "INTRODUCTION" in got.split("\n\n")
    assert clean.squeeze("a  b\n\n\n\nc") == "a b\n\nc"


def test_plain_and_python_cleaning_agree(spark):
    texts = ["a  b\n   c\n\n\n\nd ", "", "x\r\ny\rz", "é  ß\t\tu"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in df.select(clean.squeezed(F.col("x"))).collect()] == [clean.squeeze(t.replace("\r\n", "\n").replace("\r", "\n")) for t in texts]


PROSE = "The quick brown foxes jumped over many lazy dogs near the old river bank today and then rested under the trees for a while."


def test_sections(spark):
    text = f"Lead text. {PROSE}\n# Methods\n{PROSE}\n\n{PROSE} Again it went on.\n# References\n{PROSE}"
    docs = spark.createDataFrame([("d", "Title", text)], "doc_id string, title string, cleaned string")
    got = structure.sections(docs).orderBy("section_id").collect()
    assert [(r.title, len(r.paragraphs)) for r in got] == [("Title", 1), ("Methods", 2)]
    assert text[got[1].start :].startswith(PROSE) and got[0].end == text.index("# Methods")


def test_only_references_falls_back_to_all(spark):
    docs = spark.createDataFrame([("d", "References", PROSE)], "doc_id string, title string, cleaned string")
    assert [r.title for r in structure.sections(docs).collect()] == ["References"]


def test_pages(spark):
    docs = spark.createDataFrame([("d", "T", f"{PROSE * 2}\f\f{PROSE} More of it.")], "doc_id string, title string, cleaned string")
    got = chunk.page_chunks(docs).orderBy("pool_index").collect()
    assert [r.section_path for r in got] == ["Page 1", "Page 2"] and got[1].start > got[0].end


def test_pages_packed(spark):
    text = "\n\n".join([PROSE * 8] * 4)
    docs = spark.createDataFrame([("d", "T", text)], "doc_id string, title string, cleaned string")
    got = [r.text for r in chunk.pages(docs).orderBy("page").collect()]
    assert "\n\n".join(got) == text and max(map(len, got)) <= chunk.PAGE


def test_grow():
    paragraphs = ["a" * 500, "b" * 500, "c" * 500, "d" * 500]
    assert chunk.grow(paragraphs, [True] * 4, 1) == "\n\n".join(paragraphs[:3])
    assert chunk.grow(paragraphs, [False, True, True, True], 1) == "\n\n".join(paragraphs[1:])
    assert chunk.grow(["x" * 450, "y" * 5000], [True, True], 0) == "x" * 450


def test_model_json():
    assert model_json.extract('<think>no {</think>```json\n{"a": 1}\n```') == {"a": 1}
    assert model_json.extract('Here is the JSON: {"a": "b}"} done') == {"a": "b}"}
    assert model_json.extract('{"a": "cut of') == {"a": "cut of"}
    assert model_json.extract('{"a": [1, 2,') == {"a": [1, 2]}
    assert model_json.extract('{"a": 1, "b":') == {"a": 1, "b": ""}
    for bad in ("", "<think>never ends", "no json"):
        try:
            model_json.extract(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_model_json_keeps_what_strings_hold():
    for cut in ("one,", "one ,", "key:", "use ```", "a <think>b</think>", "a <think>b", "line\u2028"):
        assert model_json.extract(f'{{"a": "{cut}') == {"a": cut}
        assert model_json.extract(f'<think>so</think>```json\n{{"a": "{cut}"}}\n```') == {"a": cut}
    assert model_json.extract('{"a": "has <think>b</think>", "b": 1,\n```') == {"a": "has <think>b</think>", "b": 1}
    assert model_json.extract('{"a": "one, \n') == {"a": "one,"}


def test_model_json_cut_in_an_escape():
    for tail, want in {"\\": "", "\\\\": "\\", "\\\\\\": "\\", "\\u00e": "", "\\\\u00e": "\\u00e", "\\ud83d": "", "\\ud83d\\ude0": "", "\\ud83d\\ude00": "😀"}.items():
        assert model_json.extract('{"a": "x' + tail) == {"a": "x" + want}


def test_model_json_field(spark):
    cases = {'{"a": "x,"}': "x,", '```json\n{"a": [1, "é"]}\n```': '[1, "é"]', '{"a": null}': None, '{"b": 1}': None, "[1]": None, "no json": None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", model_json.field(F.col("x"), "a").alias("a")).collect()
    assert {r.x: r.a for r in got} == cases


def test_model_json_long_blanks():
    assert model_json.extract('{"a": "x' + " " * 1_000_000 + 'y"}') == {"a": "x" + " " * 1_000_000 + "y"}  # hours, if each blank were a start
