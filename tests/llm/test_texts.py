"""BPE, fingerprints, packing and licences against libraries and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from compare import compare, duck
from replaylens.llm import bpe, fingerprints, licenses, packing
from replaylens.llm.shingles import WordHashes, shingle_hashes

ODD = ["", " ", "  a  b ", "ΣΑΣ Σ", "İstanbul é ́x", "<|endoftext|> hi<|startoftext|>x <|endoftext|", " \n x\n y \t",
       "a\x1cb　c\n\td it's 'S 12345 ½ 漢字 😀🙂", "x" * 300, "don'T I'LL !!! ...?", "\x00\x01 \x85 a​b", "ß ẞ ﬁ K Å"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokens():
    return packing.ByteTokens.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark, docs, no_docs, fixture_rows, vocabulary):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ODD:
        assert np.frombuffer(vocabulary.encode(text), "<i4").tolist() == library.encode(
            text, add_special_tokens=False).ids
    got = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    expected = Counter()
    for doc_id, text in fixture_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected[doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == expected
    assert bpe.decode(bpe.encode(no_docs, vocabulary), vocabulary).count() == 0


def test_the_queue_merges_like_a_scan():
    merges = {(a << 32 | b): (rank, new) for rank, (a, b, new) in enumerate(
        [(1, 2, 5), (5, 5, 6), (1, 1, 7), (7, 5, 8), (2, 1, 9), (6, 1, 10)])}

    def scan(s):
        s = s[:]
        while found := [(merges[k], i) for i in range(len(s) - 1) if (k := s[i] << 32 | s[i + 1]) in merges]:
            (_, new), i = min(found)
            s[i:i + 2] = [new]
        return s
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(1, 4, rng.integers(0, 30)).tolist()
        assert bpe.merge_symbols(s[:], merges) == scan(s)


def test_fingerprints(spark, docs, no_docs, fixture_rows):
    rows = sorted(fixture_rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    known, expected = WordHashes(), Counter()
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 2
        edited = text[:len(text) - cut] + after[:cut]
        a, e, n = (fingerprints.sketch(t, known) for t in (text, edited, after))
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.to_text(a),
                 fingerprints.to_text(e), fingerprints.likeness(a, e), fingerprints.likeness(a, n)] += 1
    for partitions in (1, 5):
        got = fingerprints.compare_with_next(docs, partitions=partitions)
        assert Counter(map(tuple, got.collect())) == expected
    assert fingerprints.compare_with_next(no_docs).count() == 0
    one = docs.where("doc_id = 13")
    assert fingerprints.compare_with_next(one).first().near_next == 1.0
    assert {r.fingerprint for r in fingerprints.fingerprint(docs).where("doc_id in (1, 2)").collect()}.__len__() == 1


def test_sketches_merge_and_estimate():
    known = WordHashes()
    words = [f"w{i}" for i in range(20_000)]
    small, large = " ".join(words[:2000]), " ".join(words)
    a, b = fingerprints.sketch(small, known), fingerprints.sketch(large, known)
    assert fingerprints.containment(a, b) == 1.0 and abs(fingerprints.likeness(a, b) - 0.1) < 0.03
    parts = [fingerprints.sketch(" ".join(words[i:i + 5004]), known) for i in range(0, 20_000, 5000)]
    whole = parts[0]
    for p in parts[1:]:
        whole = fingerprints.merge(whole, p)
    assert (whole == b).all()
    assert (fingerprints.from_text(fingerprints.to_text(b)) == b).all()
    assert len(shingle_hashes("a b", 5, known)) == 1 and len(shingle_hashes(" \n", 5, known)) == 0


def check_packing(rows, texts, capacity=1024, most_padding=None):
    """Every id of every document in one piece, sequences without gaps, and the ids those of the library."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    ids_of = {}
    for doc_id, text in texts:
        ids_of.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    assert set(by_doc) == set(ids_of)
    for doc_id, all_ids in ids_of.items():
        pieces = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
        cuts = Counter()
        for ids in all_ids:
            for s in range(0, len(ids), capacity):
                part = np.array(ids[s:s + capacity], dtype="<u4")
                cuts[s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
        assert pieces == cuts
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    if most_padding is not None:
        assert sum(r.length for r in rows) >= (1 - most_padding) * capacity * len(by_sequence)


def test_packing(spark, docs, no_docs, fixture_rows, tokens):
    for text in ODD:
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    check_packing(packing.pack(docs, tokens, ranked=7).collect(), fixture_rows)
    assert packing.pack(no_docs, tokens).count() == 0


def test_patterns_use_every_piece_and_waste_little():
    rng = np.random.default_rng(3)
    sizes, counts = np.unique(rng.integers(1, 64, 5000), return_counts=True)
    counts = dict(zip(sizes.tolist(), counts.tolist()))
    plan = packing.cutting_patterns(counts, 64)
    used = Counter()
    for pattern, times in plan:
        assert sum(c * a for c, a in pattern.items()) <= 64 and times > 0
        used.update({c: a * times for c, a in pattern.items()})
    assert used == Counter(counts)
    assert sum(n for _, n in plan) <= 1.01 * sum(c * n for c, n in counts.items()) / 64 + 1
    assert packing.cutting_patterns({}, 64) == [] and packing.cutting_patterns({40: 3}, 64) == [({40: 1}, 3)]


def test_licenses(spark, docs, no_docs, tmp_path):
    mit = next(t for n, _, t in licenses.KNOWN if n == "MIT" and len(t) > 200)
    found = spark.createDataFrame([
        (1, mit.replace("<year> <copyright holders>", "2020 A. Body").upper()), (2, mit + " and more"), (3, None),
        (4, "text\n  released under the MIT Licence \nmore"), (5, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (None, "x"), (4, "other"), (6, "© 2001 Me\nLicensed under CC BY 4.0.")], "doc_id long, text string").unionByName(
            docs.where("doc_id > 10").select("doc_id", "text"))
    path = str(tmp_path / "documents.parquet")
    found.coalesce(1).write.parquet(path)
    con = duck(str(tmp_path / "none"))
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    assert compare(licenses.scan_licenses(found), con, licenses.oracle_sql()) == []
    rows = {r.doc_id: r for r in licenses.scan_licenses(found).where("doc_id < 10").collect()}
    assert rows[1].text_license == "MIT" and rows[2].text_license is None and rows[6].text_license == "CC-BY-4.0"
    assert rows[5].notices == "CC-BY-NC-4.0,MIT" and rows[5].restricted and rows[4].notices == "MIT"
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(no_docs).count() == 0
    assert not [r for r in licenses.scan_licenses(docs).collect() if r.notices or r.text_license]
