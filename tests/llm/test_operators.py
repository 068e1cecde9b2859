"""Operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("textloom.llm")
import duckdb
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F
from textloom.llm import bpe, common, licences, mixing, quality, registry, sharding, simhash, sql, token_files, toxicity, vectors, warc

DOCS = "doc_id long, text string, lang string, source string, size long, fp long, key string, _salt int"


def odd_docs(spark):
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", "en", None), (4, "one two three four five six " * 20, None, "b"), (5, "one two three four five six " * 20, "en", "b"), (5, "one two three four five six " * 20, "en", "b"),
        (None, "a null id with some words in it", "en", "b"), (None, None, None, None), (6, "é漢😀 x " * 3000, "de", "a"), (7, "Released under the MIT License.", "en", "c"), (8, "u" * 5000, "en", "c"),
    ]
    return spark.createDataFrame([(*r, 9, 9, "k", 1) for r in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=((4, 1, 0), (5, 1, 1), (6, 1, 1), (7, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# --- shared pieces


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x in got} and set(parent) - set(got) <= {a for a, b in edges if a == b}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_without_rounds(spark, monkeypatch):
    made, keep = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: made.append(df) or keep(df))
    path = [0, *range(300, 0, -1)]  # the smallest node is far from the next
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long").repartition(7)
    assert [tuple(r) for r in common.components(edges).orderBy("node").collect()] == [(i, 0) for i in range(301)]
    assert len(made) == 2


def test_components_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "AT_ONCE", 40)
    test_components(spark)


def test_running_sum(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).alias("v")).repartition(5)
    assert all(r.s == 2 * r.k for r in common.running_sum(df, ["k"], "v", "s").collect())


# --- 1: vectors


def brute_vectors(rows, least=vectors.COSINE):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float))]
    link = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= least:
                link[a].add(b)
                link[b].add(a)
    out = {i: (0, i) for i, *_ in rows}
    for k in link:
        seen, todo = {k}, [k]
        while todo:
            todo += [x for x in link[todo.pop()] if x not in seen and not seen.add(x)]
        out[good[k][0]] = (len(link[k]), min(good[x][0] for x in seen))
    return out


@pytest.mark.parametrize("capacity", [8192, 60])
def test_vectors(spark, capacity):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=16) * (0.0 if i % 7 == 0 else 0.25)], int(i % 40 % 2)) for i in range(300)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 16, None), (905, [None] + [1.0] * 15, 1), (906, [1.0] * 8, 1), (907, [1e-30] * 16, 1), (908, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, capacity=capacity).collect()}
    assert got == brute_vectors(rows)


def test_vectors_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_links(x, least=vectors.COSINE):
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(hit, least[None, :], len(x)).min(axis=1))
        if (new == least).all():
            return hit.sum(axis=1), least
        least = new


@pytest.mark.parametrize("case", ["groups", "crowd", "halo", "sparse", "same direction"])
def test_graph_by_brute_force(case):
    rng = np.random.default_rng(0)
    x = {
        "groups": lambda: np.repeat(rng.normal(size=(150, 32)), 10, axis=0) + rng.normal(size=(1500, 32)) * 0.2,
        "crowd": lambda: np.vstack([rng.normal(size=(1, 32)) + rng.normal(size=(1200, 32)) * 0.05, rng.normal(size=(600, 32))]),
        "halo": lambda: np.vstack([rng.normal(size=(1, 32)) + rng.normal(size=(900, 32)) * 0.3, rng.normal(size=(300, 32))]),
        "sparse": lambda: np.vstack([y := rng.normal(size=(1500, 32)), y[:9] + rng.normal(size=(9, 32)) * 0.2]),
        "same direction": lambda: np.abs(rng.normal(size=(300, 1))) * np.ones((1, 32)) + rng.normal(size=(300, 32)) * 1e-9,
    }[case]()
    x = vectors.unit(x)
    links, least = vectors.links_between(x, np.arange(len(x)))
    want, small = brute_links(x)
    assert links.sum() >= 0.995 * want.sum() and (links <= want).all() and want.sum() > 0
    assert (least == small).mean() > 0.995


def test_recall_over_shards(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x = np.vstack([x, x[:60] + rng.normal(size=(60, 24)) * 0.2])  # few links, most pairs of shards have none
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, capacity=300).collect()}
    want, _ = brute_links(vectors.unit(x))
    found = sum(min(got[i], n) for i, n in enumerate(want))
    assert want.sum() > 60 and found >= 0.95 * want.sum() and all(got[i] <= n for i, n in enumerate(want))
    seen = vectors.audits(df, capacity=300).collect()
    graphs = [r for r in seen if r.q_shard is None]
    assert len(graphs) == 11 and all(r.truth >= 100 and r.hits >= vectors.AUDIT * r.truth for r in graphs)
    assert {(r.shard, r.q_shard) for r in seen if r.q_shard is not None} == {(a, b) for b in range(11) for a in range(b + 1)}


# --- 2: WARC


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ b", "aa"), (2, "u", "aa"), (3, None, None), (4, "u", ""), (None, "u", "aa"), (5, "u", "é\r\n\r\n" * 40000), (6, "u", "zz"), (6, "u", "zz")] + [(100 + i, f"http://h/{i}", f"<p>page {i} " + "text " * (i % 50)) for i in range(400)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/w"
    warc.write(df, path, archive_bytes=4000)
    got = warc.read(spark, path, payload=True).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((p[0] is None, p[0] or 0) for p in pages)
    html = {i: (h or "").encode() for i, _, h in pages}
    for r in got:
        raw = html[r.page_id]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        least = first[raw.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == least else ("revisit", least))
        assert r.payload == (raw if r.record_type == "response" else None)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) > 1 and any(f[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") for f in files)


def test_bad_archives():
    good = next(warc.archives(iter([warc.record(i, "u", b"payload %d" % i, None, False) for i in range(50)])))
    assert len(list(warc.frames(good))) == 50
    for bad in (good[:-3], good[:100] + b"\0" + good[101:-1], good + b"junkjunk"):
        with pytest.raises(warc.BadArchive):
            [warc.parse(f) for f in warc.frames(bad)]
    r = warc.record(1, "u", b"abc", None, False)
    for bad in (r[:-1], r.replace(b"WARC/1.1", b"WARC/9"), r.replace(b"abc", b"abd"), r.replace(b"Content-Length: 3", b"Content-Length: 4"), b""):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)


def test_archives_of_nothing(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0


# --- 3: shards


@pytest.mark.parametrize("limit", [200, 1000, 10**6])
def test_shards_fit(spark, limit):
    d = odd_docs(spark)
    got = sharding.assign(d, limit).collect()
    assert len(got) == d.count()
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r)
    for shard, rows in held.items():
        total = sum(r.doc_bytes for r in rows)
        assert all(r.shard_bytes == total for r in rows) and (total <= limit or len({r.doc_id for r in rows}) == 1 and all(r.doc_bytes > limit for r in rows)), shard
    names = [s for s in held if "#" not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.assign(empty_docs(spark)).count() == 0


def test_shards_of_one_hash(spark):
    d = spark.createDataFrame([(1, "x" * 90)] * 50, "doc_id long, text string")
    got = sharding.assign(d, 200).collect()
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.doc_bytes
    assert len(got) == 50 and max(sums.values()) <= 200


def test_written_shards_fit(spark, tmp_path):
    rows = [(1, "x" * 90, "a")] * 50 + [(None, "y" * 40, "b")] * 30 + [(i, "z" * (i % 150), "c") for i in range(2, 200)] + [(7, None, "d"), (8, "w" * 500, "e"), (8, "w" * 500, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, bytes string")
    sharding.write(d, f"file://{tmp_path}/s", 200)
    got = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted(map(repr, map(tuple, got.select("doc_id", "text", "bytes").collect()))) == sorted(map(repr, rows))
    held = got.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert all((r.n or 0) <= 200 or r.rows == 1 for r in held)


def test_directory_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(h), int(b)) for h, b in zip(rng.integers(0, 1 << sharding.BITS, 3000), rng.integers(0, 90, 3000), strict=True)] + [(5, 40)] * 4 + [(6, 90)] * 2
    got = sharding.placed(spark.createDataFrame(rows, "h long, bytes long"), 100).where("not shard like '%#%'").collect()
    assert 3000 <= len(got) <= 3002
    for r in got:
        size = lambda d: sum(b for h, b in rows if h >> (sharding.BITS - d) == r.h >> (sharding.BITS - d))  # noqa: E731, B023
        if r.h % 50 == 0 or r.depth > 15:
            assert size(r.depth) == r.shard_bytes <= 100 < size(r.depth - 1) and r.shard == format(r.h >> (sharding.BITS - r.depth), f"0{r.depth}b")


# --- 4: toxicity


def test_restores():
    words = "the stupid idiot moron trash loser worthless disgusting house water people think about other".split() * 40
    counts = np.zeros((28, 28, 28))
    for w in words:
        c = [0, 0, *map(toxicity.char_class, w), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            counts[a, b, d] += 1
    r = toxicity.Restorer(counts)
    for raw, want in {"1d10t": "idiot", "stuuupid": "stupid", "s.t.u.p.i.d": "stupid", "s t u p i d": "stupid", "m0r0n": "moron", "tr4$h": "trash", "house,": "house", "": "", "123": "", "worthless": "worthless", "THE!!".lower(): "the"}.items():
        assert r.restore(raw) == want, raw


def test_disguises_at_the_edges():
    words = "you a i the stupid idiot moron trash shit class letter house water people think about other".split() * 40
    counts = np.zeros((28, 28, 28))
    for w in words:
        c = [0, *map(toxicity.char_class, w), 0]
        for a, b, d in zip(c, c[1:], c[2:], strict=False):
            counts[a, b, d] += 1
    read = toxicity.Reader(toxicity.Restorer(counts))
    cases = {"shi+": "shit", "idio+": "idiot", "the!!": "the", "letter": "letter", "iddiot": "idiot", "stupidd": "stupid", "1d10t!": "idiot", "(lass": "class", "you i d i o t.": "idiot", "s t u p i d, you": "stupid"}
    cases |= {"i d ! o t": "idiot", "so (i d i o t) there": "idiot", "a i d i o t": "idiot", "i d i o t a": "idiot", "s t u p i d": "stupid", "t r a s h !": "trash", "a s t u p i d": "stupid"}
    for raw, want in cases.items():
        assert want in read(raw), raw
    r = read.restorer
    assert r.decode("t h e i d i o t", bounds=True) == "the idiot" and r.decode("s t u p i d", bounds=True) == "stupid"
    assert len(r.decode("h o u s e " * 20000)) > 20000


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    got = toxicity.query(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    assert np.mean([r.toxic == r.predicted for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_on_odd_rows(spark):
    d = odd_docs(spark)
    for lab in (labels(spark), labels(spark, [(4, 1, 1)]), labels(spark, [(99, None, None)])):
        got = toxicity.score(d, lab).collect()
        assert len(got) == d.count() and all(0 <= r._score <= 1 for r in got)
    assert toxicity.score(empty_docs(spark), labels(spark)).count() == 0
    assert toxicity.clean(d, labels(spark)).columns == d.columns


# --- 5: licences


def test_licences_by_brute_force(spark, sf):
    got = sorted(map(tuple, licences.query(spark, sf).select("doc_id", "licence", "containment", "windows", "first_window").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert got == sorted(con.execute(sql.LICENCES).fetchall()) and got


def test_licences_in_long_and_odd_texts(spark):
    body = "some plain words of no licence at all " * 300
    rows = [(i, body[: i * 37] + " " + t + " " + body) for i, t in enumerate(licences.TEMPLATES.values())]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 1").select("doc_id", "licence").collect()}
    assert set(got) == set(range(len(rows)))
    assert {r.licence for r in licences.scan(odd_docs(spark)).collect()} == {"MIT-line"}
    assert licences.scan(empty_docs(spark)).count() == 0


# --- 6: quality


def words_of(text):
    return (text or "").encode().split()


def test_counts_by_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")))
    texts = {}
    for r in d.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in quality.counts(d).collect():
        wants = []
        for t in texts[r.doc_id]:
            w = words_of(t)
            tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            often = {x for x in tri if tri.count(x) > 1} if len(tri) < 3000 else {x for x, n in zip(*np.unique([b" ".join(x) for x in tri], return_counts=True), strict=True) if n > 1}
            covered = {i + k for i, x in enumerate(tri) if (x if len(tri) < 3000 else b" ".join(x)) in often for k in range(3)}
            lines = [x for x in t.split("\n") if words_of(x)]
            base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
            wants.append((len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered), base))
        assert tuple(r)[3:] in wants


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(2)
    clean = rng.multivariate_normal(np.arange(5), np.diag([1, 2, 3, 1, 2]), 800)
    bad = rng.normal(30, 1, (200, 5))
    df = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([clean, bad])] + [("few", *[0.0] * 5)] * 5, "grp string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    got = {r.grp: r for r in quality.mcd(df).collect()}
    assert {k: r.n for k, r in got.items()} == {"g": 1000, "few": 5}
    assert np.allclose([got["g"][f"m{i}"] for i in range(5)], clean.mean(axis=0), atol=0.25)
    assert np.allclose([got["g"][f"c{i}{i}"] for i in range(5)], [1, 2, 3, 1, 2], rtol=0.35, atol=0.3)
    assert all(abs(got["few"][f"m{i}"]) + abs(got["few"][f"c{i}{i}"]) < 1e-9 for i in range(5))


def test_estimates_by_exhaustive_search(spark):
    from itertools import combinations

    rng = np.random.default_rng(3)
    floors = np.diag([v**2 for v in quality.PARTS.values()])
    groups = {str(k): np.vstack([rng.normal(0, 1, (10, 5)) * [1, 2, 1, 0.5, 1], rng.normal(12, 1, (2, 5))]) for k in range(10)}
    df = spark.createDataFrame([(g, *map(float, x)) for g, rows in groups.items() for x in rows], "grp string, " + ", ".join(f"{n} double" for n in quality.NAMES))
    got = {r.grp: r for r in quality.concentrated(df).collect()}
    near = 0
    for g, x in groups.items():
        det = lambda rows: 0.5 * np.linalg.slogdet(quality.scale(quality.SHARE) * np.cov(rows.T, bias=True) + floors)[1]
        dets = sorted(det(x[list(s)]) for s in combinations(range(12), 9))
        near += got[g].logdet <= dets[len(dets) // 20]
        assert max(abs(got[g][f"m{i}"]) for i in range(5)) < 3  # the outliers are outside
    assert near >= 8


def test_small_groups_reject_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{rng.integers(0, 9999)}" for _ in range(60 + 5 * i)), "xx", f"s{i % 3}") for i in range(7)]
    assert quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("not kept").count() == 0


def test_quality_verdicts(spark):
    path = "/root/testdata/sf0.1"
    got = quality.query(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.99 and share[0] < 0.2
    assert quality.judge(odd_docs(spark)).count() == odd_docs(spark).count() and quality.judge(empty_docs(spark)).count() == 0


def test_passing_goes_by_row(spark):
    good = [" ".join(f"word{(i * 7 + k * k) % 997}" for k in range(80 + i)) for i in range(6)]
    rows = [(None, good[0], "en", "a"), (None, good[1], "en", None), (None, "junk", "en", "a"), (None, None, None, "en"), (5, good[2], "en", "a"), (5, "short", "en", "a"), (5, good[3], "en", "a"), (6, good[4], "de", "b"), (6, good[4], "de", "b"), (7, "", "de", "b")]
    got = quality.passing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert got.columns == ["doc_id", "text", "lang", "source"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if len((r[1] or "").split()) >= 50)
    assert quality.passing(empty_docs(spark)).count() == 0


# --- 7: mixture


def test_mixture_is_exact(spark, sf):
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert all(sum(r.taken for r in rows) == round(rows[0].target) or abs(sum(r.taken for r in rows) - rows[0].target) <= 1 for rows in by.values())
    assert all(r.taken <= 3 * r.size for r in got) and abs(sum(rows[0].target for rows in by.values()) - sum(r.size for r in got)) < 1e-3
    for d in (odd_docs(spark), empty_docs(spark)):
        assert mixing.mix(d).count() == d.count() and mixing.mixed(d).columns == d.columns


# --- 8: SimHash


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    near = [(5000 + i, "the same long text with one word changed at the end of it all " * 10 + str(i)) for i in range(40)]
    d = d.unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    for crowd in (256, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = simhash.near_duplicates(d).collect()
        rows = [(r.doc_id, brute_simhash(r.text)) for r in d.collect()]
        assert sorted((i is None, i or 0, f) for i, f in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64)) for r in got)
        fps = sorted({f for _, f in rows})
        part = {f: f for f in fps}
        for a in fps:
            for b in fps:
                if a < b and bin(a ^ b).count("1") <= 4 and part[a] != part[b]:
                    old, new = part[b], part[a]
                    part = {k: new if v == old else v for k, v in part.items()}
        least = {}
        for i, f in rows:
            if i is not None:
                least[part[f]] = min(i, least.get(part[f], i))
        assert all(r.component_id == least.get(part[r.fp % (1 << 64)]) for r in got)


def test_keep_first(spark):
    kept = simhash.keep_first(odd_docs(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 6, 7, 8] and len([r for r in kept if r.doc_id is None]) == 1
    assert simhash.keep_first(empty_docs(spark)).count() == 0


def test_keep_first_goes_by_row(spark):
    text = [" ".join(f"w{(i * 131 + k * k * (i + 3)) % 9973}" for k in range(120)) for i in range(6)]
    rows = [(5, text[0], "a"), (5, text[1], "b"), (3, text[1], "c"), (5, text[2], "d"), (None, text[3], "e"), (None, text[3], "e"), (None, text[4], "f"), (None, text[0], "g"), (9, text[5], "h"), (9, text[5], "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.keep_first(d)
    want = [(5, text[0], "a"), (3, text[1], "c"), (5, text[2], "d"), (None, text[3], "e"), (None, text[4], "f"), (9, text[5], "h")]
    assert got.columns == d.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# --- 9: token files


def test_token_files_by_brute_force(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.query(spark, sf).collect())) == want


def test_token_files_of_odd_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["Á b́", "x́ ́y", " \t a\x1cb c\x0bd  e", "İstanbul ß ǅ don't we'll  '  s", " ", "", None, "1 23 4,5. !!?", "<|endoftext|> a <|x|>b", "x <|startoftext|>y", "O\xadx ÀÉ½²ªº z", "œuf Œ., ., a.. ª. x²."]
    d = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, ids long")
    path = f"file://{tmp_path}/o"
    token_files.write(d, path, P.path("word_bpe_49k.json"))
    got = {r.doc_id: list(r.ids) for r in token_files.read(spark, path).collect()}
    assert got == {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert token_files.read(spark, path).where("doc_id = 3").count() == 1


def test_token_files_on_random_texts():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    model = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    t, own = Tokenizer.from_str(model), token_files.Encoder(model)
    rng = random.Random(1)
    signs = list("abcdeABC019 .,;'!?-_<|>\t\n\r\x0b\x1c\u00a0\u00ad\u00aa\u00b2éÉßøŒœ漢😀") + ["’s", "n't", " the ", "<|x|>", "  ", "́"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(4000)]
    for i in range(0, len(texts), 500):
        got = own(pa.array(texts[i : i + 500], pa.string()), 2).to_pylist()
        assert got == [[*e.ids, 2] for e in t.encode_batch(texts[i : i + 500], add_special_tokens=False)]


def test_stripes_are_pruned(spark, tmp_path):
    from pyarrow import orc

    # Words of chance hardly repeat, so files have several stripes of 256 KiB.
    rng = np.random.default_rng(0)
    words = np.array([f"w{x}" for x in range(50000)])
    d = spark.createDataFrame([(i * 3, " ".join(words[rng.integers(0, 50000, 400)])) for i in range(6000)], "doc_id long, text string").repartition(3)
    path = f"{tmp_path}/o"
    token_files.write(d, f"file://{path}", P.path("word_bpe_49k.json"), stripe_bytes=1 << 18)
    files = sorted(f for f in (tmp_path / "o").glob("part-*.orc"))
    read = [orc.ORCFile(f) for f in files]
    assert sum(f.nstripes for f in read) > len(files) and max(f.nstripes for f in read) >= 2
    # Of rows in ascending order, few lie in files and row groups that may hold one doc_id: a lookup reads far less than all.
    back = token_files.read(spark, f"file://{path}")

    def rows_read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return plan.metrics().apply("numOutputRows").value()

    assert rows_read(back.where("doc_id = 9000")) <= 2000 < 6000 == back.count()
    assert rows_read(back.where("doc_id = 9001")) == 0 or rows_read(back.where("doc_id = 9001")) <= 1000  # no such id: Bloom filters skip its row group
    assert back.where("doc_id = 9000").count() == 1 and back.where("doc_id = 9001").count() == 0


# --- 10: byte-level BPE


def test_bpe_like_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    texts = {}
    for r in d.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in bpe.default_round_trip(d).collect():
        wants = []
        for t in texts[r.doc_id]:
            ids = own.encode_ordinary(t)
            wants.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert tuple(r)[1:] in wants
    ids = bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode(ids, P.path("byte_bpe_50k.tiktoken")).collect()
    assert sorted(bytes(r.raw) for r in back) == sorted(t.encode() for ts in texts.values() for t in ts)


def test_bpe_on_random_texts():
    import random

    import pyarrow as pa
    import tiktoken

    raw = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    codec = bpe.Codec(raw, P.PATTERN)
    rng = random.Random(2)
    signs = list("abcdeABC0123 .,;'!?-_<|>\t\n\r\x0b\x1c\u00a0\u00ad\u2003éÉßøŒœ漢😀") + ["'s", "n't", " the ", "  ", "́"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(4000)]
    for by_space in (True, False):
        for i in range(0, len(texts), 500):
            ids, ends = codec.encode_all(pa.array(texts[i : i + 500], pa.string()), by_space)
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [own.encode_ordinary(t) for t in texts[i : i + 500]]
    # A pattern under which a space may stand anywhere: whole texts only.
    wide = tiktoken.Encoding("wide", pat_str=r"[a-z ]+|[^a-z ]+", mergeable_ranks=own._mergeable_ranks, special_tokens={})
    ids, ends = bpe.Codec(raw, r"[a-z ]+|[^a-z ]+").encode_all(pa.array(["a b c d", "the of and"], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [wide.encode_ordinary(t) for t in ("a b c d", "the of and")]


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys, list(range(5000)))
    assert [h.get(k) for k in keys] == list(range(5000)) and h.get(b"x") is None and len(h.keys) == 5000
    assert bpe.PerfectHash([], []).get(b"a") is None


# --- all


INNER = """_score _h1 _h2 _h3 _gone _g1 _g2 _id _f1 _f2 row fp component component_id _salt _source _size _words _times _rows _each _copy _more hash size key range _range prefix grp own pooled start n words lines
    windows order found distance kept v_words v_lines m0 l00 c00 bucket cell bytes h shard_bytes depth least y doc_bytes copies taken epochs rest target source_size base_failed n_words apart raw bin edge""".split()


def test_clashing_names(spark):
    """Every stage keeps columns that are named as its own inside; every operator passes over them."""
    d = odd_docs(spark).drop("size", "fp", "key", "_salt")
    good = spark.createDataFrame([(100 + i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(80 + i)), "en", "a") for i in range(6)], d.schema)
    d = d.unionByName(good)
    wide = d.withColumns({n: F.lit(f"user's {n}") for n in INNER})
    for stage in (lambda x: toxicity.clean(x, labels(spark)), quality.passing, simhash.keep_first, mixing.mixed):
        got, want = stage(wide), stage(d)
        assert got.dtypes == wide.dtypes
        assert sorted(map(repr, map(tuple, got.select(d.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))
        assert got.where(" or ".join(f"`{n}` <> \"user's {n}\"" for n in INNER)).count() == 0
    for op in (sharding.assign, licences.scan, quality.judge, mixing.mix, simhash.near_duplicates, bpe.default_round_trip):
        assert sorted(map(repr, op(wide).drop("distance").collect())) == sorted(map(repr, op(d).drop("distance").collect()))


def test_megabytes_in_a_text(spark, tmp_path):
    rng = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in rng.integers(0, 90000, 400_000)) + " s t u p i d Released under the MIT License. " + "x" * 1_000_000
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (3, "short", "en", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = len(text.split())
    assert len(text) > 3_000_000 and {r.doc_bytes for r in sharding.assign(d).collect()} == {len(text), 5}
    assert toxicity.score(d, labels(spark)).count() == 3
    assert {r.doc_id for r in licences.scan(d).where("licence = 'MIT-line'").collect()} == {1, 2}
    assert {r.n_words for r in quality.counts(d).collect()} == {size, 1} and {r.size for r in mixing.mix(d).collect()} == {size, 1}
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[1].fp % (1 << 64) == brute_simhash(text)
    back = {r.doc_id: r.decoded_sha256 for r in bpe.default_round_trip(d).collect()}
    assert back[1] == hashlib.sha256(text.encode()).hexdigest()
    token_files.write(d, f"file://{tmp_path}/o", P.path("word_bpe_49k.json"))
    assert token_files.read(spark, f"file://{tmp_path}/o").where("size(ids) > 400000").count() == 2
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    warc.write(pages, f"file://{tmp_path}/w")
    assert {r.payload_bytes for r in warc.read(spark, f"file://{tmp_path}/w").collect()} == {len(text), 5}


def brute_keep_first(rows):
    """Of rows (doc_id, text) the doc_ids that stay: the smallest of each group of fingerprints linked at 4 bits."""
    fps = {i: brute_simhash(t) for i, t in rows}
    group = {i: i for i in fps}
    for a in sorted(fps):
        for b in sorted(fps):
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    return {i for i in fps if group[i] == i}


def test_pipeline(spark, sf):
    """Each stage against a version by brute force on what the one before it kept."""
    import corpus_pipeline
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.cut(stage(spark, docs, sf))
        kept[name] = docs
        assert name == "tokens" or docs.columns == columns
        rows, after = before.collect(), docs.collect()
        ids = sorted(r.doc_id for r in after)
        if name == "toxicity":
            scores = toxicity.query(spark, sf).collect()
            assert ids == sorted(r.doc_id for r in scores if not r.predicted)
        elif name == "quality":
            good = {r.doc_id for r in quality.judge(before).collect() if r.kept}
            base = set()
            for r in rows:
                w = words_of(r.text)
                tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
                often = {x for x in set(tri) if tri.count(x) > 1}
                covered = {i + k for i, x in enumerate(tri) if x in often for k in range(3)}
                if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
                    base.add(r.doc_id)
            assert set(ids) == good <= base and len(good) > 0.7 * len(base)
        elif name == "near_duplicates":
            assert set(ids) == brute_keep_first([(r.doc_id, r.text) for r in rows]) and len(ids) == len(set(ids)) < len(rows)
        elif name == "mixture":
            con = duckdb.connect()
            con.register("frame", before.toPandas())
            con.execute("create table documents as select * from frame")
            times = con.execute(f"with m as ({sql.MIXTURE}) select doc_id, round(target)::bigint // source_size + case when 2 * (taken - (round(target)::bigint // source_size) * size) >= size then 1 else 0 end from m").fetchall()
            assert ids == sorted(i for i, n in times for _ in range(n))
            texts = {r.doc_id: r.text for r in rows}
            assert all(r.text == texts[r.doc_id] for r in after)
        else:
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
            assert sorted((r.doc_id, r.n_tokens) for r in after) == sorted((r.doc_id, len(own.encode_ordinary(r.text))) for r in rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, kept["tokens"].collect()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall()) == sorted(repr(tuple(r)) for r in got.select(columns).collect())
