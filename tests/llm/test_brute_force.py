"""Each operator against a plain version of its contract, on odd texts: null, empty, ties, copies, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenledger.llm import bpe, decontamination, exact_dedup, htmltext, langid, length_histogram, licenses, simhash, substring_dedup, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
sha = lambda b: hashlib.sha256(b).hexdigest()


def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "Of", "naïve", "mit", "license", "apache", "x1", "don't", "日本", "🙂", "gnu", "general", "public", "CC", "BY"]
    texts = [None, "", " \t\n", "a", "A  b\tc", "A b c", "the mit license", "one\x00two", " wide space ", "<|endoftext|> x's  \n\n y"]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[20], texts[20] + " tail", "head " + texts[21], "word " * 3000, "ab" * 400, "ab" * 400 + "c", texts[30], texts[30]]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, 1.0, "k", 7) for i, t in corpus()]
    schema = "doc_id long, text string, lang string, source string, score double, kept string, fp int"
    return spark.createDataFrame(rows, schema).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t in corpus():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for snapshot in (F.col("doc_id") < 40, F.lit(False), F.lit(True), F.lit(None).cast("boolean")):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, snapshot).collect()}
        for text, ids in groups.items():
            for i in ids:
                assert tuple(got[i]) == (i, ids[0], len(ids), i == ids[0], sha(text.encode()))
    assert exact_dedup.exact_dedup(empty, F.lit(True)).count() == 0


def test_exact_dedup_without_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows, F.lit(False)).collect()) == [(0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 30000])
def test_binary_fuse_holds_every_key(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    made = exact_dedup.BinaryFuse(keys)
    again = exact_dedup.BinaryFuse(None, made.table, made.seed, made.segment)
    assert again.may_hold(keys).all()
    assert again.may_hold(np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.02


def brute_substring(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone, own = np.zeros(len(b), bool), set()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            own.add(w)
            if w in seen:
                gone[k : k + 50] = True
        seen |= own
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, kept)
    return out


def test_substring_dedup(docs, empty):
    got = {r.doc_id: (*tuple(r)[:4], bytes(r.kept)) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_substring(corpus())
    small = {r.doc_id: (*tuple(r)[:4], bytes(r.kept)) for r in substring_dedup.remove_repeats(docs, block=2000).collect()}
    assert small == got
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_arrays_and_their_merge():
    rng = np.random.default_rng(3)
    for n in (1, 2, 60, 700):
        data = rng.integers(97, 99, n).astype(np.uint8)
        body, order = data.tobytes(), substring_dedup.suffix_array(data)
        assert [body[i:] for i in order] == sorted(body[i:] for i in range(n))
    size = rng.integers(50, 90, 60)
    pieces = [rng.integers(97, 99, 200).astype(np.uint8) for _ in range(3)]
    parts = [pieces[k % 3][(o := int(rng.integers(0, 100))) : o + s] for k, s in enumerate(size)]
    doc, count = rng.integers(0, 20, 60), size - 49
    windows = [(d, p[k : k + 50].tobytes()) for d, p in zip(doc, parts, strict=True) for k in range(len(p) - 49)]
    least = {}
    for d, w in windows:
        least[w] = min(d, least.get(w, 99))
    for part in (400, substring_dedup.PART):
        assert substring_dedup.repeated(np.concatenate(parts), size, count, doc, part).tolist() == [least[w] < d for d, w in windows]


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    prints = {i: brute_fingerprint(t) for i, t in corpus()}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_dedup(docs).collect()}
    assert got == {i: (prints[i], root[i]) for i in prints}
    assert simhash.near_dedup(empty).count() == 0


def test_links_of_crowded_groups(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)})
    root = {v: v for v in values}
    while True:
        before = dict(root)
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b], key=lambda x: x - 2**64 if x >= 2**63 else x)
        if root == before:
            break
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    for group in (4, 10_000):
        found = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.link(classes, group=group)).collect()}
        assert {v: found.get(v, v) for v in values} == root


def test_decontamination(spark, docs, empty):
    items = [(1, "the mit license"), (2, corpus()[25][1]), (3, None), (4, ""), (5, corpus()[25][1]), (6, "zz never here"), (7, "ab " * 3)]
    benchmark = spark.createDataFrame([(i, t, "en") for i, t in items], "item_id long, text string, doc_id string")
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = {}
    for i, t in corpus():
        w, hit, held = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if of := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    held |= of
        want[i] = (len(w), sorted(hit), sorted(held))
    for size in (decontamination.QUERY_BYTES, 100):
        rows = decontamination.decontaminate(docs, benchmark, query_bytes=size).collect()
        assert {r.doc_id: (r.n_words, np.frombuffer(r.hits, np.int32).tolist(), list(r["items"])) for r in rows} == want
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where(F.octet_length("hits") > 0).count() == 0


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "red big old house"), (2, "red house big"), (3, "house")], "doc_id long, text string")
    found = lambda slop: {r.doc_id for r in decontamination.search(decontamination.build_index(rows), [(9, b"red house")], None, slop).collect() if r["items"]}
    assert (found(0), found(2)) == ({2}, {1, 2})


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in corpus():
        w = WORD.findall(lower(t))
        want = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(w)
        assert sorted((d["first"], d["label"]) for d in got[i].detections if d["base"]) == want
    assert len(licenses.rules()) > 200
    found = licenses.detect([b"licensed", b"under", b"cc", b"by", b"nc", b"4", b"0"])
    assert [(d[0], d[4]) for d in found] == [("cc-by-nc", False), ("cc-by", True)]
    assert licenses.scan_licenses(empty).count() == 0


def test_license_rules_and_what_they_suppress():
    read = lambda t: [d[0] for d in licenses.detect(re.findall(rb"[a-z0-9]+", t.lower().encode())) if not d[4]]
    assert read("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0-or-later"]
    assert read("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.") == ["bsd"]
    assert read("under the Apache License, Version 2.0, or the ISC license") == ["apache-2.0", "isc"]
    assert read("an apache and a mit walk into a bar") == []
    keys = [(k, p) for _, _, keys, p in licenses.rules() for k in keys]
    assert len(licenses.rules()) > 300 and all(k in p.pattern for k, p in keys)
    rng = random.Random(3)
    for _ in range(200):
        spans = [(a := rng.randrange(12), a + rng.randrange(6)) for _ in range(rng.randrange(14))]
        kept = []
        for k, (a, b) in enumerate(spans):
            if not any(spans[j][0] <= a and b <= spans[j][1] for j in kept):
                kept.append(k)
        assert licenses.outermost(spans) == kept
    # In step with the number of detections.
    assert len(licenses.detect([b"mit", b"license", b"cc", b"by"] * 50_000)) == 200_000


def test_bpe_round_trip(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    for block in (bpe.BLOCK_BYTES, 300):
        got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.decode(bpe.encode(docs, block_bytes=block)).collect()}
        for i, t in corpus():
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert got[i] == (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    assert bpe.encode(empty).count() == 0


def test_bpe_splits_as_the_pattern_does():
    import pyarrow as pa

    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x180)] + list("  \n\n''''''sstmdrelv  \t19") * 12 + ["日", " "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(4000)] + ["", "'s", " 's", "x''s", "<|endoftext|>a"]
    split = bpe.Splitter(bpe.VOCABULARY)
    block = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    _, known, counts, codes = bpe._split_block(block, split)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert [known[c].decode() for c in codes[at[k] : at[k + 1]]] == split.words(t)


def test_token_histogram(docs, empty):
    lengths = [r.n_tokens for r in bpe.encode(docs).collect()]
    rows = length_histogram.token_counts(docs).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(lengths))
    for r in rows:
        n = r.n_tokens
        assert (r.docs_to, r.docs_longer) == (sum(x <= n for x in lengths), sum(x > n for x in lengths))
        assert r.tokens_truncated == sum(min(x, n) for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
    half = {r.share: r.n_tokens for r in length_histogram.quantiles(length_histogram.token_counts(docs)).collect()}
    assert half[0.5] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert length_histogram.token_counts(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><a href="/">Home</a></nav><div class="box">Same words on every page</div>
{body}<div class="ad">Buy</div><script>var t="</p>";</script><footer>f</footer></body></html>"""


def test_html_text(spark):
    bodies = [f"<div><p>Story {i} &amp; <b>more\n text<br>here<p>End {i}</div>" for i in range(6)]
    bodies += ["<article><header>x</header><h1>T&eacute;</h1><p>a</p><aside>no</aside><div id='comments'>no</div><form>no</form></article>", "<main>m &lt;i&gt;</main>"]
    rows = [(i, f"http://h.example.com/{i}", PAGE.format(body=b), "x") for i, b in enumerate(bodies)] + [(90, None, None, ""), (91, "u", "", ""), (92, "u", "no tags", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extract_text(pages).collect()}
    assert {i: got[i] for i in range(6)} == {i: f"Story {i} & more text here\nEnd {i}" for i in range(6)}
    assert [got[i] for i in (6, 7, 90, 91, 92)] == ["x\nTé\na", "m <i>", "", "", "no tags"]
    assert htmltext.extract_text(pages.limit(0)).count() == 0


def test_article_text_of_all_pages(spark, folder):
    import html

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"</?b>|<br>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def test_held_out_rows(docs):
    got = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in corpus()}


def test_language_id(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = langid.train(real)
    held = langid.identify(real.where(langid.held_out(F.col("doc_id"))), trees).join(real.select("doc_id", "lang"), "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()
    got = {r.doc_id: r for r in langid.identify(docs, trees).collect()}
    assert all((got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, t in corpus())
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def plain_ppm(train, text, order=3):
    """Bits of a text under one language: method C without exclusion, frozen counts, zero bytes before each text."""
    seen = {}
    for t in train:
        for i in range(len(t)):
            past = (bytes(order) + t[:i])[-order:]
            for k in range(order + 1):
                of = seen.setdefault(past[order - k :], {})
                of[t[i]] = of.get(t[i], 0) + 1
    bits = 0.0
    for i in range(len(text)):
        past = (bytes(order) + text[:i])[-order:]
        for k in range(order, -1, -1):
            of = seen.get(past[order - k :], {})
            total = sum(of.values()) + len(of)
            if text[i] in of:
                bits -= np.log2(of[text[i]] / total)
                break
            bits -= np.log2(len(of) / total) if of else 0
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_plain_ppm(spark):
    rng = random.Random(9)
    train = {k: ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(12)] for k, letters in (("a", "abc dé"), ("b", "bcx yü"))}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k in train for t in train[k])]
    counts = langid.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang").toArrow()
    trees = langid.Trees(counts)
    texts = ["", "abc", "yü x", "zz日", "é" * 30, "a\x00b"] + ["".join(rng.choices("abcdxyü é", k=30)) for _ in range(10)]
    body = [t.encode() for t in texts]
    for step in (7, 1 << 17):
        got = trees.lengths(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]), step)
        want = [[plain_ppm([x.encode() for x in train[k]], t) for k in "ab"] for t in body]
        assert np.allclose(got, want)


def test_toxicity_learns_and_tolerates_gaps():
    rng = random.Random(4)
    plain = ["the", "river", "walks", "under", "stone", "bridge", "and", "light", "moves", "idle", "riot", "close", "more"]
    texts, toxic = [], []
    for k in range(400):
        w = rng.choices(plain, k=60)
        if k % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["idiot", "moron", "loser"])
        texts.append(" ".join(w).encode())
        toxic.append(k % 4 == 0)
    machine = toxicity.fit(texts, np.array(toxic))
    p = lambda *x: machine.probabilities(np.frombuffer(b"".join(x), np.uint8), np.cumsum([0, *map(len, x)]))
    assert (p(*texts) >= 0.3).tolist() == toxic
    clean, bad = p(b"the river walks under stone", b"", b"the i-diot walks")[[0, 2]]
    assert bad > clean
    assert toxicity.fit(texts, np.zeros(400, bool)) is None


def test_toxicity_scores(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.without_toxic(docs, None).count() == len(corpus())
    assert toxicity.train(empty, labels) is None


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    real, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(real.where(langid.held_out(F.col("doc_id"))), toxicity.train(real, labels)).join(labels, "doc_id")
    hit = scored.where("score >= 0.3 AND toxic = 1").count()
    assert hit >= 0.85 * scored.where("toxic = 1").count()
    assert scored.where("score >= 0.3 AND toxic = 0").count() <= 0.05 * scored.where("toxic = 0").count()


def test_pipeline(spark, folder, tmp_path):
    import corpus_pipeline

    made = corpus_pipeline.run(spark, folder)
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = made.join(whole, "doc_id")
    assert 0 < made.count() < whole.count() and kept.count() == made.count()
    assert kept.where(F.sha2(F.col("text").cast("binary"), 256) != F.col("decoded_sha256")).count() == 0
    assert kept.select(exact_dedup.normalised(F.col("text"))).distinct().count() == kept.count()
