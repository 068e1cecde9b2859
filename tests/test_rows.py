"""Operators on rows: claims, joins, sampling, discovery, sources, jobs and streams."""

import io
import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from textloom import job
from textloom.functions import clean
from textloom.operators import dedupe, detect, discover, references, sample
from textloom.sources import readers
from textloom.streaming import status


def test_claims_in_order(spark):
    rows = [(0, "Explain apples fully now"), (1, "Explain apples, fully now!"), (2, "According to it, why?"), (3, "Ünïçødé é"), (4, "ñandú ö"), (5, "Explain pears fully now")]
    df = spark.createDataFrame(rows, "n int, x string")
    got = {r.n: r.accepted for r in dedupe.claimed(df, "x", ["n"]).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True}  # texts without ASCII tokens share a key


def test_stem_cap_leaves_the_key_open():
    c = dedupe.Claims()
    near = [f"{i:040x}" for i in range(20)]
    assert all(c.claim(near[i], s, False) for i, s in enumerate("aabb"))
    assert not c.claim(near[9], "a", False)
    assert c.claim(near[9], "z", False) and not c.claim(near[9], "y", False)


@given(st.lists(st.sampled_from("abcdef"), max_size=60))
def test_stems_keep_their_share(stems):
    c = dedupe.Claims()
    for i, s in enumerate(stems):
        before = c.stems.get(s, 0)
        if c.claim(f"{i:040x}", s, False) and c.accepted > 3 and before >= 2:
            assert c.stems[s] / c.accepted <= dedupe.STEM_SHARE


def test_keys_ignore_order_of_tokens(spark):
    df = spark.createDataFrame([("Grow big apples",), ("apples big grow?",)], "x string")
    assert df.select(dedupe.near_key(F.col("x"))).distinct().count() == 1


def test_sampler_does_not_depend_on_partitions(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    runs = [sorted(map(tuple, sample.top_k(d.repartition(n), ["source"], sample.order_key(1, F.col("doc_id")), 2).select("doc_id", "source").collect())) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]


def test_page_numbers(spark):
    for total, limit in ((0, 5), (1, 5), (10, 5), (300, 32), (300, 0)):
        got = spark.range(1).select(sample.page_sample(F.lit(total), limit)).first()[0]
        assert len(got) == (total if limit <= 0 else min(total, limit)) and got == sorted(set(got))
        if total == 300 and limit:
            assert min(got) > 30 and max(got) <= 285


def test_projection(spark):
    long = "The engine draws its water from the upper tank through two pipes that run along the wall."
    other = "Every second valve is closed at night so that the pressure in the lower tank stays constant."
    text = f"Short one.\n{long}\n{other}"
    pool = spark.createDataFrame([("d", "s", 0, 0, 10), ("d", "s", 1, 50, 60), ("d", "p", 0, 90, 99), ("d", "l", 0, 0, 7)], "doc_id string, persona string, pool_index int, start int, end int")
    anchors = spark.createDataFrame([("d", 0, 5, 8, "five"), ("d", 1, 20, 30, text), ("d", 2, 30, 40, "no line")], "doc_id string, anchor int, a_start int, a_end int, a_text string")
    levels = spark.createDataFrame([("s", "section"), ("p", "paragraph"), ("l", "line")], "persona string, level string")
    got = {(r.anchor, r.persona): r for r in sample.projected(pool, anchors, levels, 1).collect()}
    at = {k: (r.pool_index, r.start) for k, r in got.items() if k[1] != "l"}
    assert at == {(0, "s"): (0, 0), (1, "s"): (0, 0), (2, "s"): (1, 50), (0, "p"): (None, 5), (1, "p"): (None, 20), (2, "p"): (None, 30)}
    assert got[1, "p"].own_text == text
    # Lines: one that overlaps, one made from the anchor, none.
    assert got[0, "l"].pool_index == 0 and (2, "l") not in got
    line = got[1, "l"]
    assert line.own_target in (long, other) and line.own_text == f"{long}\n{other}" and line.start == 20 + text.find(line.own_target) and line.end == line.start + len(line.own_target)


def test_claims_keep_rows(spark):
    rows = [(1, "Explain apples fully now"), (1, "Explain pears fully now"), (None, "Explain plums fully now"), (None, "Explain plums fully now"), (2, None)]
    got = dedupe.claimed(spark.createDataFrame(rows, "n int, x string"), "x", ["n"]).select("n", "x", "accepted").collect()
    assert sorted(map(repr, ((r.n, r.x) for r in got))) == sorted(map(repr, rows))
    assert {(r.x, r.accepted) for r in got if r.n == 1} == {(rows[0][1], True), (rows[1][1], True)} and sorted(r.accepted for r in got if r.n is None) == [False, True]


def test_claims_like_a_fold(spark):
    import random

    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([2, 6, 7])) + ([f"x{rng.randrange(400)}"] if rng.random() < 0.7 else []))) for i in range(400)]
    df = spark.createDataFrame(rows, "n int, x string").repartition(5)
    fold, want = dedupe.Claims(), {}
    for r in sorted(dedupe.with_keys(df, "x").collect()):
        want[r.n] = fold.claim(r.near_key, r.stem_key, False)
    assert {r.n: r.accepted for r in dedupe.claimed(df, "x", ["n"]).collect()} == want and 0 < sum(want.values()) < 400


def test_detection(spark):
    pairs = lambda n, bad: spark.createDataFrame([("q", "a")] * (n - bad) + [("q", " ")] * bad, "Prompt string, response string")
    assert detect.detect(pairs(100, 30))["already_instruct"] and not detect.detect(pairs(100, 31))["already_instruct"]
    chats = spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], "messages array<struct<role: string, content: string>>")
    assert detect.detect(chats)["format"] == "messages"
    texts = spark.createDataFrame([("long",)], "text string")
    assert detect.looks_like_corpus(texts) and not detect.detect(texts)["already_instruct"]
    assert detect.detect(texts.limit(0))["row_count"] == 0


def test_discovery(spark):
    rows = spark.createDataFrame([(f"id{i}", [("text " * 40,), (None,)], "A title") for i in range(5)], "case_id string, opinions array<struct<opinion_text: string>>, case_name string")
    schema = discover.discover(rows)
    assert (schema["text_column"], schema["id_column"], schema["title_column"]) == ("opinions[].opinion_text", "case_id", "case_name")
    d = discover.documents(rows, schema, "src").first()
    assert d.doc_id == "id0" and d.title == "A title" and d.text == ("text " * 40).strip()
    with pytest.raises(ValueError):
        discover.discover(rows.limit(0))


def test_citations(spark):
    text = "Section 2.1 and sec. 2.1, § 12, (a)(ii), sub-paragraph (b)(i), Appendices 7; " + " ".join(f"Table {i}" for i in range(12))
    got = [m.reference for m in spark.createDataFrame([(text,)], "x string").select(references.mentions(F.col("x"))).first()[0]]
    assert got[:3] == ["section 2.1", "section 12", "appendix 7"] and len(got) == 12


def test_block_is_added_once(spark):
    findings = F.array(F.struct(F.lit("section 1").alias("reference"), F.lit("It binds.").alias("statement"), F.lit(None).cast("string").alias("excerpt"), F.lit(True).alias("matched")))
    df = spark.createDataFrame([("An answer. ",)], "o string").withColumn("once", references.with_block(F.col("o"), findings)).withColumn("twice", references.with_block(F.col("once"), findings))
    r = df.first()
    assert r.once == f"An answer.\n\n{references.MARKER}\n\n[section 1]\nIt binds." and r.twice == r.once


def test_structured_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    for name, value, want in [("l", [{"a": 1}, 3, {"a": 2}], 2), ("w", {"rows": [{"a": 1}, {"a": 2}]}, 2), ("o", {"a": 5}, 1), ("e", {"rows": [], "a": 1}, 1)] + [(k, {k: [{"a": 1}]}, 1) for k in readers.WRAPPERS]:
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        assert readers.json_rows(spark, str(tmp_path / f"{name}.json")).count() == want, name
    (tmp_path / "s.json").write_text("3")
    with pytest.raises(readers.SourceError):
        readers.json_rows(spark, str(tmp_path / "s.json"))
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n')
    assert readers.csv(spark, str(tmp_path / "c.csv")).first().asDict() == {"a": "1", "b": "x\ny"}


def test_document_files(spark, tmp_path):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{readers.WORD_SPACE[1:-1]}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.docx").write_bytes(docx.getvalue())
    (tmp_path / "t.txt").write_bytes(b"text \xff")
    (tmp_path / "blank.md").write_text("  ")
    (tmp_path / "x.bin").write_text("no")
    got = {r.doc_id: r.text for r in readers.document_files(spark, str(tmp_path)).collect()}
    assert got == {"sub/d.docx": "One\n\nTwo", "t.txt": "text �"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.txt", "fine")
        z.writestr("../evil.txt", "no")
    assert [(r.doc_id, r.text) for r in readers.zipped_documents(spark, str(tmp_path / "a.zip")).collect()] == [("ok.txt", "fine")]
    with pytest.raises(readers.SourceError):
        list(readers.zip_members((tmp_path / "a.zip").read_bytes(), most=1))
    assert [readers.kind_of(x) for x in ("https://x/y", "org/name", "dir/a.txt", "/tmp")] == ["url", "dataset", "path", "path"]
    assert readers.distinct_sources(["a", "b", " a"], "c") == ["a", "b", "c"]


def test_job_from_documents_to_files(spark, sf, tmp_path):
    docs = clean.cleaned(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("title"), "text"), "text").drop("cleaned")
    got = job.run(docs, str(tmp_path / "out"), job.Config(rows=12, check_size=False))
    assert 0 < got["records"] <= 12
    train = job.combined(spark, str(tmp_path / "out"), ("line-analyst", "summarizer"))
    assert train.count() == got["records"] and train.columns == ["instruct", "output"]
    records = spark.read.json(str(tmp_path / "out/records"))
    assert records.select("doc_id", "persona", "pool_index", "round").count() == got["records"]
    with pytest.raises(job.TooSmall):
        job.suggest(docs.limit(1))


def test_streams(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    status.run_available(status.latest(stream, "user_id", "ts", ["event_type"]), lambda df, n: seen.append(df.collect()), str(tmp_path / "ck"))
    last = {}
    for batch in seen:
        last |= {r.user_id: r.event_type for r in batch}
    want = {r.user_id: r.event_type for r in status.latest(source, "user_id", "ts", ["event_type"]).collect()}
    assert set(last) == set(want)
