import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from sparkvane.llm import _graph, _scan, _text, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, minhash_dedup, packing, quality, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
LONG = "a shared line that is certainly longer than forty characters"
ODD = [(None, None), (0, ""), (1, None), (2, " \n\t "), (3, "one"), (4, "%%% ###"), (5, "x " * 30_000), (6, f"{LONG}\nrest {LONG}"), (7, "日本語 テスト 😀"), (7, "日本語 テスト 😀"), (8, "\x00a\r\nb")]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "embeddings", "labels", "benchmark")}


@pytest.fixture(scope="module")
def rows(tables):
    return [tuple(r) for r in tables["documents"].select("doc_id", "text").collect()]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, key string, n long")


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lines(spark, odd, rows):
    got = line_dedup.query(spark, DATA)
    assert tuples(got) == sorted(brute.line_dedup(rows), key=repr)
    many = odd.union(spark.createDataFrame([(i, f"  {LONG.upper()}\t\nown {i}", "y", 2) for i in range(20, 26)], odd.schema))
    out = line_dedup.dedup_lines(many).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert tuples(out) == sorted(brute.line_dedup([(r[0], r[1]) for r in many.collect()]), key=repr)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_lines_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    docs = spark.createDataFrame([(i, f"{LONG}\n{LONG} {i % 7} and more\nline {i}") for i in range(60)], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert tuples(out) == sorted(brute.line_dedup([tuple(r) for r in docs.collect()]), key=repr)


def test_leaks(spark, odd, rows, tables):
    items = [tuple(r) for r in tables["benchmark"].collect()]
    assert tuples(decontaminate.query(spark, DATA)) == sorted(brute.leaks(rows, items), key=repr)
    few = spark.createDataFrame([(1, "One"), (2, ""), (3, None), (None, "x x")], "item_id long, text string")
    for limit in (1 << 20, 0):
        got = {(r.doc_id, r.n_words, str(r["items"])) for r in decontaminate.find_leaks(odd, few, broadcast_bytes=limit).collect()}
        assert (3, 1, "['1']") in got and (None, 0, "[]") in got and len(got) == len(ODD) - 1
        assert decontaminate.find_leaks(odd.limit(0), few, broadcast_bytes=limit).count() == 0
    assert decontaminate.find_leaks(odd, few.limit(0)).count() == len(ODD) and decontaminate.find_leaks(odd, few.limit(0), broadcast_bytes=-1).count() == len(ODD)
    # both ways, with all they return, also with items that share an id
    both = tables["benchmark"].union(few).union(few.selectExpr("item_id", "upper(text)"))
    one, other = (tuples(decontaminate.find_leaks(tables["documents"].union(tables["documents"].limit(3)), both, keep_text=True, broadcast_bytes=x)) for x in (1 << 26, 0))
    assert one == other and any(r[2] for r in one)
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(spark.createDataFrame([(1, "one " + "w " * 99), (2, "one two")], "doc_id long, text string"), few).collect()}
    assert list(kept) == [1] and "one" not in kept[1]


def test_near_copies(spark, odd, rows):
    assert tuples(minhash_dedup.query(spark, DATA)) == sorted(brute.near_copies(rows), key=repr)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_copies(odd, k=2).collect()}
    assert {(None, 0, None, True), (0, 0, 0, True), (3, 1, 3, True), (5, 1, 5, True), (7, 2, 7, True)} <= got
    assert minhash_dedup.near_copies(odd.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = b.replace("b30", "other")
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (5, near), (7, a), (9, "else")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_copies(docs, k=2).collect()}
    assert got == {(1, 1, True), (5, 1, False), (7, 1, False), (9, 9, True)}
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = spark.createDataFrame([(1, x), (1, y), (1, y), (5, [0.0, 1.0, 0.1]), (7, x), (9, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = tuples(embedding_dedup.near_vectors(rows))
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (5, 2, 1, False), (7, 1, 1, False), (9, 0, 9, True)], key=repr)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i, cut in enumerate((90, 80, 81, 79)):  # sets of cut of 100 words in common, one word a shingle
        own = words[100 * i : 100 * i + 100] if i < 3 else [f"v{j}" for j in range(100)]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:cut]))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k=1).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(4)] == [True, True, True, False]
    cosines = (1.0, 0.9501, 0.9499, -1.0)
    rows = [(10 * i + j, v) for i, c in enumerate(cosines) for j, v in enumerate((np.eye(8)[2 * i].tolist(), (c * np.eye(8)[2 * i] + np.sqrt(1 - c * c) * np.eye(8)[2 * i + 1]).tolist()))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 10: (1, 10), 11: (1, 10), 20: (0, 20), 21: (0, 21), 30: (0, 30), 31: (0, 31)}


@pytest.mark.parametrize("hubs", [(512, 500), (4, 2)])
def test_hot_keys(spark, monkeypatch, hubs):
    monkeypatch.setattr(_graph, "HUBS", hubs[0])
    monkeypatch.setattr(_graph, "HOT_ROWS", hubs[1])
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(200, 100), (300, 301)]
    got = {(r.node, r.component) for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for pair in links for x in pair}
    assert got == set(brute.components(nodes, links).items())
    base = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, base) for i in range(30)] + [(100 + i, base.replace(f"w{i}", "x")) for i in range(40)] + [(200, "alone")], "doc_id long, text string")
    assert tuples(minhash_dedup.near_copies(docs, k=2)) == sorted(brute.near_copies([tuple(r) for r in docs.collect()]), key=repr)


@pytest.mark.parametrize("most", [1 << 21, 20, 0])
def test_components_by_one_task_several_and_stars(spark, monkeypatch, most):
    """A long path takes one table, not one for each round, while its links fit one task."""
    tables = []
    monkeypatch.setattr(_graph, "materialize", lambda df, label, write=_graph.materialize: tables.append(label) or write(df, label))
    monkeypatch.setattr(_graph, "LINKS", most, raising=False)
    monkeypatch.setattr(_graph, "CHUNK", 16, raising=False)
    rng = np.random.default_rng(2)
    name = rng.permutation(200) - 50
    links = [(int(name[i]), int(name[i + 1])) for i in range(120)] * 2 + [(int(a), int(b)) for a, b in rng.integers(200, 260, (30, 2))] + [(1 << 62, 7), (999, 999)]
    got = sorted(tuple(r) for r in _graph.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect())
    links = [(a, b) for a, b in links if a != b]
    assert got == sorted(brute.components({x for link in links for x in link}, links).items())
    assert len(tables) == 1 or most < 1 << 21


def test_no_components_without_links(spark):
    assert _graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []


def test_one_bucket_of_unlike_vectors(spark):
    """Vectors at cosine 0.85 to one centre share filters, but only planted pairs are linked."""
    rng = np.random.default_rng(8)
    c = np.eye(32)[0]
    z = rng.normal(size=(500, 32))
    z[:, 0] = 0
    x = 0.85 * c + np.sqrt(1 - 0.85**2) * z / np.linalg.norm(z, axis=1)[:, None]
    x[400:] = x[:100] + 0.02 * rng.normal(size=(100, 32))
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    root = brute.components(range(500), zip(*(y.tolist() for y in np.nonzero(np.triu(u @ u.T >= 0.95, 1)))))
    assert got == root and sum(i != r for i, r in root.items()) >= 100


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, component_id long, kept string")
    assert embedding_dedup.near_vectors(empty).collect() == []


def test_nodes_of_families_are_not_broadcast(spark, monkeypatch):
    """Only a bounded filter of their ids is; rows that pass it by chance change nothing."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "other words"), (1, "a b c"), (2, "a b c"), (3, "x y z"), (None, "x y z"), (4, None)], "doc_id long, text string")
    nodes = minhash_dedup.sketches(docs.where("doc_id is not null"), 2).select(F.col("doc_id").alias("least"), "d1", "d2")
    few = nodes.where("least = 1").groupBy("least", "d1", "d2").agg(F.lit(9).cast("long").alias("family"), F.lit(1).cast("long").alias("blocks")).withColumn("node", F.col("d1"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bits in (1 << 26, 64):
            monkeypatch.setattr(minhash_dedup, "FILTER_BITS", bits, raising=False)
            sets = minhash_dedup._family_sets(docs, few, 2, 2)
            assert "Broadcast" not in sets._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.family, r.blocks, len(r.set)) for r in sets.collect()) == [(9, 1, 8), (9, 1, 16)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_families_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(40):
        own = list(base)
        for j in rng.choice(120, int(rng.integers(0, 12)), replace=False):
            own[j] = f"r{i}x{j}"
        docs.append((i, " ".join(own)))
    got = minhash_dedup.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k=2)
    assert tuples(got) == sorted(brute.near_copies(docs), key=repr)


def test_pairs_whose_buckets_have_other_firsts(spark, monkeypatch):
    for name, value in (("MARGIN", 0.0), ("BANDS", 150), ("WIDTH", 1), ("BLOCK", 64)):  # large buckets from few documents
        monkeypatch.setattr(minhash_dedup, name, value)
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(38)]
    docs = [(i, " ".join([*common, *(f"o{i}x{j}" for j in range(62))])) for i in range(600)]
    for i in range(60):  # pairs with larger ids than whatever shares a third of their words
        own = docs[10 * i][1].replace("o", f"p{i}o").split()
        docs.append((10_000 + 2 * i, " ".join(own)))
        own[40] = own[50] = own[60] = own[70] = own[80] = "other"
        docs.append((10_001 + 2 * i, " ".join(own)))
    order = rng.permutation(len(docs))
    got = minhash_dedup.near_copies(spark.createDataFrame([docs[i] for i in order], "doc_id long, text string"), k=2)
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert {d: c for d, c in found.items() if d != c} == {10_001 + 2 * i: 10_000 + 2 * i for i in range(60)}


def test_likelihood_tells_similarities_apart():
    rng = np.random.default_rng(2)
    for share, want in ((0.9, True), (0.8, True), (0.2, False)):
        both = int(1000 * share)
        a, b, c = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (both, (1000 - both) // 2, (1000 - both) // 2))
        u, v = np.append(a, b), np.append(a, c)
        assert minhash_dedup.likely(minhash_dedup.registers(u)[None], minhash_dedup.registers(v)[None], np.array([len(u)]), np.array([len(v)]), 0.8)[0] == want
        assert (minhash_dedup.registers(np.append(u, v)) == np.maximum(minhash_dedup.registers(u), minhash_dedup.registers(v))).all()


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24))
    x[100:160] = x[0] + 0.25 * rng.normal(size=(60, 24))
    x[160:170] = x[1]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (None, x[0].tolist()), (905, x[0][:5].tolist())]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    root = brute.components(range(300), zip(*(y.tolist() for y in np.nonzero(g))))
    assert {i: got[i] for i in range(300)} == {i: (int(g[i].sum()), root[i], root[i] == i) for i in range(300)}
    assert all(got[i] == (0, i, True) for i in range(900, 906)) and got[None] == (0, None, True)


@pytest.mark.parametrize("n", [300_000, 1_000_000, 10_000_000])
def test_near_pairs_share_a_filter_whatever_the_number_of_vectors(n):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, 300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (x * z).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
    met = np.zeros(300, bool)
    for i in range(embedding_dedup.CODES):
        code = embedding_dedup.Code(n, 64, i)
        met |= [len(np.intersect1d(p, q)) > 0 for p, q in zip(code.decode(x), code.decode(y))]
    assert met.all()


def test_token_counts_equal_the_library(spark, odd, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(4)
    parts = ["the", "  ", " ", "ing", "é", "日", "\n", "aaaa", "=====", "12", "▁", "<s>", "<0x0A>"]
    texts = [t for _, t in rows[:60]] + ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(300)]
    assert token_counts.compiled(path).count(pa.array(texts)).tolist() == [len(model.encode(t or "")) for t in texts]
    got = tuples(token_counts.count_tokens(odd, path))
    assert got == sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in ODD), key=repr)


def test_texts_without_spaces(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.Transducer(path)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefgh"), 5000)), "a" * 7000, "ab" * 4000, " " * 3000, "日本語" * 1500, "x" + "é" * 3000 + " the end", "thequickbrownfox" * 400, "=" * 5001, ""]
    want = [len(model.encode(t)) for t in texts]
    for segment, states in ((1 << 20, 300_000), (3000, 300_000), (3000, 50)):
        monkeypatch.setattr(_scan, "SEGMENT", segment)
        monkeypatch.setattr(token_counts, "STATES", states)
        assert counter.count(pa.array(texts)).tolist() == want


def test_parses_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(2)
    model = language_id.Model({"a": "the cat sat on the mat " + "".join(rng.choice(list("abcdef "), 2000)), "b": "der hund " + "".join(rng.choice(list("abcxyz "), 1500))})
    texts = pa.array(["".join(rng.choice(list("abcdefxyz the."), n)) for n in (10, 900, 3000, 5000, 1)] + ["a" * 4000, "", None, "the cat sat " * 500])
    monkeypatch.setattr(language_id, "SPAN", 10_000)
    whole = model.phrases(texts)[0].tolist()
    for span, segment in ((1024, 1 << 20), (50, 1 << 20), (50, 400)):
        monkeypatch.setattr(language_id, "SPAN", span)
        monkeypatch.setattr(_scan, "SEGMENT", segment)
        assert model.phrases(texts)[0].tolist() == whole


def test_packing_round_trip(spark, odd, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.createDataFrame([(900, "don't 'tis  's\n\n a''ll <|endoftext|> '"), (901, None)], "doc_id long, text string"))
    got = packing.pack(docs, path, keep_ids=True).collect()
    whole, seen = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and len(whole.get(r.doc_id, [])) == r.start
        whole.setdefault(r.doc_id, []).extend(ids)
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert whole == {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in ((r[0], r[1]) for r in docs.collect())}
    for pieces in seen.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(seen) == list(range(len(seen)))
    total = sum(len(v) for v in whole.values())
    assert len(seen) <= -(-total // 1024) * 1.05 + 1
    assert packing.pack(odd, path).where("start = 0").count() == len(ODD) and packing.pack(odd.limit(0), path).count() == 0


def test_parts_are_the_library_s():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}'s" for c in (*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x0660, 0x00BD)]
    ids, ends = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [e.whole(t).tolist() for t in texts]


def test_language(spark, odd, tables):
    docs = tables["documents"]
    model = language_id.learn(docs)
    out = language_id.identify(docs, model).withColumnRenamed("doc_id", "d").join(docs.select(F.col("doc_id").alias("d"), "lang"), "d").where(language_id.held_out(F.col("d")) & (F.length("text") > 40))
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count() > 0
    got = language_id.identify(odd, model).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (None, 0, 1, 2, 4)) and len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    nothing = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_language_equals_plain_parsing(spark, tables, monkeypatch):
    docs, learned, build = tables["documents"], {}, language_id.Model
    with monkeypatch.context() as m:
        m.setattr(language_id, "Model", lambda samples: learned.update(samples) or build(samples))
        model = language_id.learn(docs)
    few = docs.where(F.length("text") < 1200)
    got = {r.doc_id: r for r in language_id.identify(few, model).collect()}

    def phrases(text, known):
        n, i = 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in known:
                j += 1
            n, i = n + 1, j
        return n

    for r in few.collect():
        text = language_id.normal(r.text)
        text += " " * (not r.text[-1:].isalpha())  # what follows the last letter is a gap too
        if not text.strip():
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        cost = sorted((phrases(text, known) * np.log2(len(known) + 2), name) for name, known in learned.items())
        assert got[r.doc_id].lang_pred == cost[0][1]
        assert got[r.doc_id].score == pytest.approx(1 - cost[0][0] / cost[1][0])
    assert len(got) > 20
    tied = language_id.identify(few, build({"b": "the end ", "a": "the end "})).collect()
    assert {(r.lang_pred, r.score) for r in tied} <= {("a", 0.0), ("und", 0.0)}


def test_clean_short_documents_stay(spark, tables):
    learned = tables["documents"].where("doc_id % 5 > 0")
    short = [(900, "A."), (901, "a"), (902, "I am"), (903, "The end."), (904, "?!"), (905, "日本語 テスト")]
    docs = learned.unionByName(spark.createDataFrame([(i, t, None, "x", len(t)) for i, t in short], tables["documents"].schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, DATA).where("doc_id >= 900").collect()}
    assert kept == {900, 901, 902, 903}


def test_all_sampled_rows_are_learned(spark):
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    docs = spark.createDataFrame([(i, f"{w} " * (40_000 if i % 3 else 5), "xx") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    rows = docs.where(~language_id.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(language_id.SAMPLE_ROWS).collect()
    learned = []
    model = language_id.Model
    try:
        language_id.Model = lambda samples: learned.append(samples["xx"]) or model(samples)
        language_id.learn(docs)
    finally:
        language_id.Model = model
    assert {words[r.doc_id] for r in rows} <= set(learned[0].split())
    assert 19_000 < len(learned[0]) <= language_id.SAMPLE_CHARS


def test_automaton_phrases():
    text, own = "abcabdab", {"a": 0, "b": 1, "c": 2, "d": 3}
    table = language_id.automaton(np.array([own[c] for c in text]), 4)
    for query in ("abdabc", "dddd", "abcab", "cda", "bdabca"):
        state = ends = 0
        for c in query:
            v = int(table[state, own[c]])
            ends, state = ends + (v & 1), v >> 1
        want, i = 0, 0
        while i < len(query):
            j = max((j for j in range(i + 1, len(query) + 1) if query[i:j] in text), default=i + 1)
            want, i = want + 1, j
        assert ends + 1 == want


def test_quality(spark, odd, tables):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.query(spark, sf).join(labels, "doc_id").where("held_out")
    right = out.where("predicted = quality").count() / out.count()
    assert right >= 0.95
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert out.where("toxic = 1 and score >= 0.7").count() >= 0.8 * out.where("toxic = 1").count()  # 300 rows to learn from
    assert out.where("toxic = 0 and score < 0.7").count() >= 0.99 * out.where("toxic = 0").count()
    texts = [r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text").collect()]
    rng = np.random.default_rng(3)
    assert (model.score(pa.array([toxicity.misspelt(t, rng) for t in texts])) >= 0.7).mean() >= 0.75
    # repeated ids and labels, contradictory labels
    few = labels.limit(400)
    assert toxicity.learn(docs.union(docs.limit(200)), few.union(few)).bias == toxicity.learn(docs, few).bias
    assert not toxicity.learn(docs, labels.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("toxic"))).trained
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(ODD) and all(r.score < 0.5 for r in got if r.doc_id in (None, 0, 1, 2, 4))
    assert {r.score for r in toxicity.score_toxicity(odd, toxicity.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_licenses(spark, odd):
    mit = " ".join(license_scan.SENTENCES[x] for x in ("mit-grant", "mit-notice-kept", "mit-as-is"))
    docs = spark.createDataFrame([(1, f"Hello.\n{mit}\nbye"), (2, "x LICENSED under cc  by-NC 4.0! y"), (3, "The MIT licence is a licence.")], "doc_id long, text string")
    got = {r.doc_id: (r.sentences, r.licenses) for r in license_scan.scan_licenses(docs).collect()}
    assert got[1][1] == ["MIT:text"] and got[3] == ([], [])
    assert license_scan.scan_licenses(odd).where(F.size("licenses") > 0).count() == 0 and license_scan.scan_licenses(odd).count() == len(ODD)
    for name, text in license_scan.SENTENCES.items():
        assert any(a in text.lower() for a in license_scan.ANCHORS), name


def test_wrapped_licenses(spark):
    wanted = {n: r for n, r in license_scan.RULES.items() if n.endswith((":text", ":header"))}
    docs, want = [], {}
    for name, rule in wanted.items():
        for width in (40, 76):
            for mark in ("", "# ", " * ", "// "):
                for end in ("\n", "\r\n"):
                    text = "Copyright 2020 someone. " + " ".join(license_scan.SENTENCES[x] for x in rule)
                    text = text.replace(" http", "\n\nhttp").replace("LICENSE-2.0 ", "LICENSE-2.0\n\n")
                    lines = [x for p in text.split("\n") for x in textwrap.wrap(p, width, break_on_hyphens=False) or [""]]
                    want[len(docs)] = rule
                    docs.append((len(docs), f"A title{end}{mark.rstrip()}{end}" + end.join(mark + x for x in lines) + f"{end}{end}code();"))
    for text, ids in {"x\nLicensed under CC BY 4.0\ny": ["cc-by-4"], "Licensed under the\n\nMIT License": ["mit-licensed"], "Released under. The MIT License.": [], "licence\nfoo released under the MIT License": [], "Released under the MIT License.\nReleased under the MIT License": ["mit-notice"] * 2, "software " + "\n" * 200_000 + "# %" * 200_000 + "é " * 200_000: []}.items():
        want[len(docs)] = ids
        docs.append((len(docs), text))
    got = {r.doc_id: r.sentences for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_license_sentences_of_several_parts(spark):
    mpl, gpl = license_scan.SENTENCES["mpl2-terms"], license_scan.SENTENCES["gpl-hope"]
    cases = {"This software.\nVersion: 2.0": [], "2.0\nsoftware": [], mpl: ["mpl2-terms"], mpl.replace("v. ", "v.\n * "): ["mpl2-terms"], f"{gpl}\n2.0\n{mpl}": ["gpl-hope", "mpl2-terms"]}
    for name in ("apache-licensed", "gpl-free", "gpl-hope"):
        first, last = re.split("[;:] ", license_scan.SENTENCES[name])
        cases |= {license_scan.SENTENCES[name]: [name], last: [], f"{first}; licence": []}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.sentences for r in license_scan.scan_licenses(docs).collect()} == dict(enumerate(cases.values()))


def test_pipeline(spark, tables):
    docs = tables["documents"]
    sizes, at = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, DATA)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        if name == "minhash_dedup":
            before = [(r.doc_id, r.text) for r in at.collect()]
            assert {r.doc_id for r in out.collect()} == {d for d, _, _, kept in brute.near_copies(before, 5) if kept}
        if name == "line_dedup":
            texts = {r.doc_id: brute.sha(r.text) for r in out.collect()}
            assert all(texts.get(d, h) == h for d, _, _, h in brute.line_dedup([(r.doc_id, r.text) for r in at.collect()]))
        at = out
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    items = [tuple(r) for r in tables["benchmark"].collect()]
    assert not any(hit for _, _, hit, *_ in brute.leaks([(r.doc_id, r.text) for r in at.collect()], items))


def test_pipeline_of_odd_documents(spark, tables, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing names, empty tables."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = tables["documents"]
    extra = [F.lit(c).alias(c) for c in ("gone", "_carried", "key", "n", "kept", "a.b")] + [F.lit(None).cast("string").alias("items")]
    words = " ".join(docs.where("lang = 'en'").orderBy(F.length("text").desc()).first()["text"].split()[:60])
    own = [(None, f"Nobody knows this one. {words[:50]}"), (900, None), (901, ""), (902, " \n "), (903, "%% 12"), (904, f"{words} and so on"), (904, f"{words} and so on"), (905, f"{words} and so on"), (906, f"The story goes on and on {words[100:140]} " * 4000)]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in own], docs.schema)
    docs.unionByName(odd).select("*", *extra).write.parquet(str(tmp_path / "documents.parquet"))
    tables["benchmark"].write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = at.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, at, str(tmp_path)), name)
        assert out.columns == names and out.schema == at.schema
        assert out.where("gone <> 'gone' or `a.b` <> 'a.b' or _carried <> '_carried'").count() == 0
        at = out
    kept = [r.doc_id for r in at.where("doc_id >= 900 or doc_id is null").collect()]
    assert sorted(kept, key=str) == [904, 904, 906, None]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), len(library.encode(r.text, add_special_tokens=False).ids) + 1) for r in at.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n for _, n in want)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (s2, o2, _) in zip(places, places[1:]):
        assert (s2, o2) == ((s, o + n) if s2 == s else (s + 1, 0)) and o + n <= 1024
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    tables["benchmark"].limit(0).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_workers_get_bounded_batches(spark):
    """Of wide texts, too, a task doesn't get all its rows in one batch."""
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some text "), 1000).alias("text"))
    language_id.identify(docs, language_id.Model({}))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    got = docs.mapInArrow(run, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 2000 and max(r.bytes for r in got) < 5 << 20


def test_workers_keep_nothing_for_other_operators():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.record_batch({"text": ["a b", "c"]})
    first = packing.encoder(path)
    assert [b.num_rows for b in _text.parts(iter([batch, batch]), "text", keeps=path)] == [2, 2]
    assert packing.encoder(path) is first
    list(_text.parts(iter([batch]), "text"))
    assert packing.encoder(path) is not first


def test_one_python_step_a_stage(spark, monkeypatch):
    """Each further one has a worker of its own for every task."""
    plans = []

    def written(df, label, f=minhash_dedup.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, label)

    for module in (minhash_dedup, _graph):
        monkeypatch.setattr(module, "materialize", written)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join([*base[: 3 * (i % 5)], *(f"r{i}x{j}" for j in range(i % 5)), *base[3 * (i % 5) + i % 5 :]])) for i in range(40)]
    got = minhash_dedup.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), k=2)
    assert tuples(got) == sorted(brute.near_copies(docs), key=repr)
    steps = [re.findall("MapInArrow|FlatMapGroupsInArrow|Exchange", p) for p in plans]
    assert any("FlatMapGroupsInArrow" in x for x in steps)
    assert not any(a != "Exchange" != b for x in steps for a, b in zip(x, x[1:]))
