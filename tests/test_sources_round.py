"""Sources that queries write and read again keep every value."""

import duckdb
from textloom import plans
from textloom.sources import readers

ODD = [None, "", " ", " lead", "trail ", "\ttab", "cr\rmid", "crlf\r\nx", "\r", "\n", "\nlead", "end\n", "end\r\n", '"', '""', '"q"', 'say ""x""', "a,b", ",", "\\", '\\"', "#c", "\ufeffbom", "null", '"\n"', ' "x" ', '",\n"', 'a",b', 'a"\n', "\x0b",
       "x" * 200_000]


def test_read_csv_of_odd_texts(spark, tmp_path):
    rows = [(i, x, lang, "s") for i, x in enumerate(ODD) for lang in (None, "", "en ")]
    spark.createDataFrame([(3 * r[0] + n % 3, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, lang, source, text_md5 from ({plans.ORACLES['read_csv']})").fetchall()
    got = plans.QUERIES["read_csv"](spark, str(tmp_path)).select("doc_id", "lang", "source", "text_md5").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_csv_tells_empty_from_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'a,b,c\r\n1,"",\r\n"x\ny", z ,"q ""r"""\r\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "", None), ("x\ny", " z ", 'q "r"')]
