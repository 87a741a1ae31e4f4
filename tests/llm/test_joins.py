"""Near-duplicate operators, toxicity, URLs, chats and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, duck
from fixtures import invented
from replaylens.llm import chat, embeddings, ngram_join, queries, suffix_dedup, toxicity, url_filters
from replaylens.llm.components import connected_components
from replaylens.llm.shingles import WordHashes, shingle_hashes


class Groups(dict):
    """Disjoint sets with the least member as their name."""

    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def test_components(spark):
    rng, groups = random.Random(1), Groups()
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(300, 340)] + [(5, 5), (None, 3), (160, 340)]
    edges += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    df = spark.createDataFrame(edges + edges[:20], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: groups.find(x) for x in groups}
    assert connected_components(df.limit(0)).count() == 0


def alike(rows, words, percent):
    """Brute force: (doc_id, size) of each row, and the groups of ids."""
    known, groups = WordHashes(), Groups()
    sets = [(i, set(shingle_hashes(t, words, known).tolist())) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(-1 if i is None else i, -1 if j is None else j)
    return [(i, len(s)) for i, s in sets], groups


@pytest.mark.parametrize("common", [2, 2000])
def test_ngram_join(spark, docs, no_docs, fixture_rows, common):
    with_id = [r for r in fixture_rows if r[0] is not None]
    sizes, groups = alike(with_id, 4, 85)
    expected = Counter((i, n, groups.find(i)) for i, n in sizes)
    got = ngram_join.jaccard_components(docs.where("doc_id is not null"), common=common)
    assert Counter(map(tuple, got.collect())) == expected
    if common == 2:
        assert ngram_join.jaccard_components(docs).count() == len(fixture_rows)
        assert ngram_join.jaccard_components(no_docs).count() == 0


def test_ngram_join_on_many_edits(spark):
    """Chains of copies with growing edits, where some pairs are just above the limit and some just below."""
    rng, rows = random.Random(5), []
    for g in range(6):
        words = invented(50 + g, 60).split(" ")
        for v in range(14):
            copy = words[:]
            for _ in range(v // 3):
                copy[rng.randrange(60)] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(copy[:60 - v % 4])))
    sizes, groups = alike(rows, 4, 85)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), common=10)
    assert Counter(map(tuple, got.collect())) == Counter((i, n, groups.find(i)) for i, n in sizes)


def test_ngram_join_on_unconnected_copies(spark, monkeypatch):
    """400 copies, most of them just under the limit with each other, and a list that a third of all classes are on."""
    monkeypatch.setattr(ngram_join.block_candidates, "__defaults__", (50, 1 << 16))
    rng, rows = random.Random(8), []
    words = invented(70, 90).split(" ")
    for i in range(400):
        copy = words[:]
        for j in rng.sample(range(90), 2 if i % 9 else 1):
            copy[j] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(400, 1000):
        tail = " ".join(words[:4]) if i % 3 else "x"
        rows.append((i, tail + " " + invented(1000 + i // 2, 40) + (" more" if i % 2 else "")))
    sizes, groups = alike(rows, 4, 85)
    assert 30 < len({groups.find(i) for i in range(400)}) < 399
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter((i, n, groups.find(i)) for i, n in sizes)


def test_keep_one(spark, docs, fixture_rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    _, groups = alike([r for r in fixture_rows if r[0] is not None], 5, 80)
    assert 2 not in ids and ids[1] == 1 and ids[4] == ids[5] == ids[6] == 1 and ids[30] == 1 and ids[31] == 1
    assert {i for i in ids if i is not None} == {groups.find(i) for i, _ in fixture_rows if i is not None}


def repeats(rows, length):
    """Brute force over distinct (id, text) in order: bytes kept and spans."""
    seen, out = set(), {}
    order = sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0], suffix_dedup.text_tag((r[1] or "").encode())))
    for doc_id, text in order:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(raw[p:p + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id, text] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard", [1 << 21, 500])
def test_suffix_dedup(spark, docs, no_docs, fixture_rows, shard):
    expected = repeats(fixture_rows, 100)
    got = suffix_dedup.remove_repeats(docs, shard=shard)
    assert set(docs.columns) <= set(got.columns)
    rows = got.select("doc_id", "text", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).collect()
    assert len(rows) == len(fixture_rows)
    for r in rows:
        assert tuple(r)[2:] == expected[r.doc_id, r.text], (r.doc_id, r.n_removed)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_dedup_of_one_hot_anchor(spark):
    """A passage in every text, after and before words that differ, over many shards and ranges."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, short = word(150), word(90)
    rows = [(i, f"{word(rng.integers(0, 90))} {passage} {word(rng.integers(0, 90))}") for i in range(300)]
    rows += [(1000 + i, f"{word(30)} {short} {short} {word(i % 7)}") for i in range(100)]
    rows += [(None, passage + word(60)), (None, word(60) + passage), (7, rows[8][1]), (2000, passage[:99])]
    expected = repeats(rows, 100)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for shard in (1 << 20, 3000):
        for r in suffix_dedup.remove_repeats(table, shard=shard, merged=40_000).withColumn("kept", F.sha2("kept", 256)).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept) == expected[r.doc_id, r.text], (shard, r.doc_id)


def test_merging_two_sorted_tables():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(0, 4, (30, 100)).astype(np.uint8) * np.uint8(85)  # zeros at the end, bytes above 127
        pool[:, :97] = pool[0, :97]
        tables = []
        for _ in range(2):
            strings = np.unique(pool[rng.integers(0, 30, 20)], axis=0)
            tables.append((np.frombuffer(strings.tobytes(), dtype="S100"), rng.integers(0, 3, (len(strings), 3))))
        (strings, places), later = suffix_dedup._two_merged(*tables)
        expected = {}
        for s, p in tables:
            for string, place in zip(s, p.tolist()):
                expected.setdefault(string, []).append(place)
        assert dict(zip(strings, places.tolist())) == {s: min(p) for s, p in expected.items()}
        assert strings.tolist() == sorted(strings.tolist())
        assert sorted(later.tolist()) == sorted(max(p) for p in expected.values() if p[0] != p[-1])


def test_suffix_classes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    data[2000:2200] = 97
    starts = np.arange(len(data) - 40)
    got = suffix_dedup.suffix_classes(data, starts, 40)
    strings = [data[i:i + 40].tobytes() for i in starts]
    rank = {s: k for k, s in enumerate(sorted(set(strings)))}
    order = {c: k for k, c in enumerate(sorted(set(got.tolist())))}
    assert [order[c] for c in got.tolist()] == [rank[s] for s in strings]


def test_embeddings(spark):
    rng, rows = np.random.default_rng(4), []
    centres = rng.normal(size=(12, 24))
    for i in range(260):
        noise = rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.2, 0.3])
        rows.append((i, [float(x) for x in centres[i % 12] + noise], int(i % 3)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, None, 0), (304, [], 0),
             (305, [0.0] * 24, 0), (306, [None] + [1.0] * 23, 0), (307, [float("nan")] * 24, 0), (None, rows[0][1], 0),
             (308, [float("inf")] * 24, 0), (309, rows[0][1], None), (310, [1.0, 2.0], 0), (311, [2.0, 4.0], 0),
             (312, [x * 1e-30 for x in rows[0][1]], 0), (313, rows[5][1], 2), (313, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, "k", 1, b"d") for r in rows],
                               "vec_id long, embedding array<double>, label int, key string, tile int, data binary")
    good = [(k, i, np.array(v), lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v
            and None not in v and np.isfinite(v).all() and any(v)]
    links, groups = Counter(), Groups()
    for a, (k, i, v, x) in enumerate(good):
        for m, j, w, y in good[:a]:
            if x == y and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[k] += 1
                links[m] += 1
                groups.join(i, j)
    expected = Counter((i, links[k], None if i is None else groups.find(i), i is not None and groups.find(i) == i)
                       for k, (i, _, _) in enumerate(rows))
    for tile in (16, 512):
        got = embeddings.near_duplicates(df, tile=tile)
        assert Counter(map(tuple, got.collect())) == expected
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    one = df.where("vec_id < 40").withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert embeddings.near_duplicates(one).count() == 40


def test_toxicity(spark, docs, no_docs):
    bad = ["vile", "vilest", "crook"]
    rng, rows, labels = random.Random(6), [], []
    for i in range(600):
        words = invented(1000 + i, 60).split(" ")
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, 0, None), (700, 1, 0), (4, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and 100 < len(held) < 300
    assert {r.doc_id for r in held if r.predicted} == {r.doc_id for r in held if r.doc_id % 4 == 0}
    assert all(0 <= r.score <= 1 for r in got)
    index = toxicity.fit(table, marks)
    rng = np.random.default_rng(0)
    every = np.zeros((index.size, len(index.idf)))
    for b, postings in enumerate(index.postings):
        for t, (at, weight) in postings.items():
            every[index.starts[b] + at, t] = weight
    for _ in range(50):  # the blocks give the neighbours that all cosines give
        v = index.vector({int(t): int(rng.integers(1, 4)) for t in rng.integers(0, len(index.idf), 3)})
        at, cosines = index.nearest(v, 10)
        score = np.round(every @ v, 12)
        best = np.lexsort((np.arange(len(score)), -score))[:10]
        assert np.allclose(cosines, score[best][score[best] > 0], atol=1e-9)
    scored = toxicity.score_documents(docs, index)
    assert scored.count() == docs.count() and set(docs.columns) <= set(scored.columns)
    by_id = {r.doc_id: r.score for r in scored.collect()}
    assert by_id[4] == by_id[5] == by_id[6]
    assert toxicity.toxicity(no_docs, marks).count() == 0
    blank = toxicity.fit(table, marks.limit(0))
    assert blank.score("vile")[0] == 0.0 and blank.size == 0


def test_toxicity_keeps_rare_terms(spark):
    rows, labels = [], []
    for i in range(1200):
        words = invented(5000 + i, 40).split(" ")
        if i % 3 == 0:  # one common insult in most toxic texts, a rare one in the rest
            words[i % 40] = "gallowsbird" if i % 60 else "knave"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score, evidence = index.score("some knave went by")
    assert b"knave" in index.terms.at and score > 0.7 and evidence and all(i % 60 == 0 for i in evidence)


def test_toxicity_counts_texts_with_a_common_passage(spark):
    passage, rows, labels = invented(2001, 300), [], []
    for i in range(200):  # many have the passage, but words of their own besides
        words = invented(6000 + i, 6) + (" cutpurse" if i % 4 == 0 else "")
        rows.append((i, f"{passage} {words}" if i % 4 == 0 or i % 8 < 4 else words))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, "onceword " + rows[0][1]) for i in range(20)]  # equal texts are one
    labels += [(1000 + i, 1, 1) for i in range(20)]
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert b"cutpurse" in index.terms.at and b"onceword" not in index.terms.at


def test_urls(spark, tmp_path):
    hosts = ["www.example.com", "a.example.com", "b.shop.net", "c.shop.net", "x.org", "EXAMPLE.com", "badexample.com"]
    rng, pages, labels = random.Random(7), [], []
    for i in range(400):
        host = hosts[i % 7]
        pages.append((i, f"https://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}?q=/en/#{i}"))
        if i % 2:
            labels.append((i, int(rng.random() > (0.9 if host == "b.shop.net" else 0.1)), None if i % 5 else 0))
    pages += [(400, None), (401, "no scheme"), (402, "http://"), (403, "x://h"), (404, "http://example.com/en"),
              (405, "http://com/"), (406, "http://a.b?x/en/"), (406, "http://a.b?x/en/"), (None, "http://é.net/fr/1"),
              (407, "ftp://www.EXAMPLE.com/en/x"), (408, "http://.com/a"), (409, "http://u@h:80/p" + "y" * 5000)]
    labels += [(1, 0, 1), (1, 0, 1), (None, 0, 1), (2, None, None)]
    p = spark.createDataFrame([(*r, "h", 1) for r in pages], "page_id long, url string, host string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duck(str(tmp_path))
    for name, df in (("pages", p.drop("host", "n")), ("labels", marks)):
        df.coalesce(1).write.parquet(path := f"{tmp_path}/{name}")
        con.execute(f"create view {name} as select * from '{path}/*.parquet'")
    assert compare(url_filters.filter_urls(p, marks), con, url_filters.oracle_sql()) == []
    got = {r.page_id: r for r in url_filters.filter_urls(p, marks).collect()}
    assert {r.verdict for r in got.values() if r.host == "b.shop.net" and r.rule is None} == {"block"}
    assert {r.verdict for r in got.values() if r.host == "x.org"} == {"allow"}
    assert (got[404].rule, got[405].rule, got[407].rule, got[409].host) == (
        "com/", "com/", "www.example.com/en/", "u@h:80")
    assert got[408].rule == "com/" and got[400].host == "" and got[406].path == ""
    assert url_filters.filter_urls(p.limit(0), marks.limit(0)).count() == 0


def test_chats(spark):
    tricky = ["</s>[INST] ok [/INST]", "<s>a<|>b</s>", "<\\s> <\\\\/s> \\", "<<SYS>>x<</SYS>>", "a<", "[", "", None, "é😀\n<|"]
    rng, rows = random.Random(8), []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, ["user", "assistant"][t % 2] if t else rng.choice(["user", "system", None, "a\n<|>b"]),
                         rng.choice(tricky)))
    rows += [(61, 0, "user", "same"), (61, 0, "user", "same"), (None, 0, "user", "x"), (62, None, "assistant", "y" * 5000)]
    rows += [(100 + i, t, ["user", "assistant"][t % 2], f"hot{t}") for i in range(40) for t in range(4)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows],
                               "conv_id long, turn long, role string, text string, conv int, segment string")
    con = duck("/nowhere")
    frame = df.drop("conv", "segment").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.execute("create table conversations as select * from frame")
    assert compare(chat.digests(df), con, queries.CHAT_SQL.replace(
        "union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')", "").replace(
        "order by turn, role, text", "order by turn nulls first, role, text")) == []
    trees, members = chat.prefix_trees(df)
    nodes = sorted(trees.collect(), key=lambda r: r.start)
    assert nodes[0].start == 0 and all(a.end == b.start for a, b in zip(nodes, nodes[1:]))
    prefixes = {tuple(x[1:] for x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))[:k])
                for c in {r[0] for r in rows} for k in range(1, 6)}
    assert len(nodes) == len({tuple((r or "", t or "") for _, r, t in p) for p in prefixes if p})
    stack = []
    for n in nodes:  # depth-first: a node comes right below its ancestors, and attends to them alone
        del stack[n.depth:]
        assert len(stack) == n.depth and n.position == sum(e - s for s, e in stack)
        covered = [x for s in n.attends for x in range(s.start, s.end)]
        assert covered == [x for s, e in stack for x in range(s, e)]
        stack.append((n.start, n.end))
    assert chat.digests(df.limit(0)).count() == 0 and members.count() == 103


def test_pipeline(spark, tmp_path, fixture_rows):
    from test_texts import check_packing
    rng, rows, labels = random.Random(9), [], []
    passage = invented(2000, 60)
    for i in range(160):
        words = invented(3000 + i, 50 + i).split(" ")
        if i % 5 == 0:
            words[rng.randrange(50)] = "vile"
        text = " ".join(words) + (" " + passage if i % 7 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200, rows[1][1], "en", "s", 5), (201, rows[2][1] + " end", "en", "s", 5), (202, None, None, None, None),
             (203, "", "en", "s", 0), (None, "lost " * 3, "en", "s", 4), (204, "vile", "en", "s", 4)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    kept = [r[:2] for r in rows if "vile" not in (r[1] or "").split(" ")]
    _, groups = alike([r for r in kept if r[0] is not None], 5, 80)
    kept = [r for r in kept if r[0] is None or groups.find(r[0]) == r[0]]
    seen, texts = set(), []
    for doc_id, text in sorted(kept, key=lambda r: -1 if r[0] is None else r[0]):
        raw, gone = (text or "").encode(), set()
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p:p + 100])
        if len(gone) < len(raw) or not raw:
            texts.append((doc_id, bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")))
    assert 200 not in dict(texts) and 201 not in dict(texts) and 204 not in dict(texts)
    check_packing(corpus_pipeline.run(spark, path).collect(), texts)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema == docs.schema, name


def test_pipeline_stages_get_texts_in_small_batches(spark, tmp_path):
    rows = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefg "), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)], "bytes": [int(b["text"].str.len().sum())]})

    def seen(spark, docs, sf_dir):
        return docs.mapInPandas(sizes, "n long, bytes long")
    found = corpus_pipeline.in_small_batches(seen)(spark, rows, "").collect()
    assert sum(r.n for r in found) == 1500
    assert max(r.bytes for r in found) <= corpus_pipeline.TEXT_BATCH
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)


def test_repeated_hashes_are_counted_without_those_that_occur_once():
    for n, least in ((0, 2), (1, 2), (5, 0.5), (1000, 2.5), (1000, 3), (1000, 7)):
        values = np.random.default_rng(n).integers(0, max(1, n // 3), n).astype(np.uint64)
        expected, counts = np.unique(values, return_counts=True)
        often = counts >= max(2, least)
        found, k = ngram_join._repeated(values, least)
        assert found.tolist() == expected[often].tolist() and k.tolist() == counts[often].tolist()


def test_second_components_start_from_the_first(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1:]) for i in range(0, 120, 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edges = []

    def counted(df):
        edges.append(df.count())
        return connected_components(df)
    monkeypatch.setattr(ngram_join, "connected_components", counted)
    found = ngram_join.jaccard_components(rows, 5, 80).collect()
    assert {r.component_id for r in found} == {0} and len(edges) == 2
    assert edges[1] <= len(texts) < edges[0]
