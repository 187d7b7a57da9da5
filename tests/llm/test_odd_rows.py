"""Ids that repeat or are absent, hashes that collide, settings that differ, and each opN_ query itself on odd rows."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenledger.llm import arrowtext, bpe, decontamination, exact_dedup, langid, licenses, queries, simhash, substring_dedup, toxicity
from tests.llm.test_brute_force import WORD, brute_fingerprint, brute_substring, lower, sha

ROWS = [
    (5, "a text that two rows of one id have in part " * 3), (5, "the other text of that id, which nothing else repeats at all, so it stays"), (2, "a text that two rows of one id have in part " * 3),
    (None, None), (None, ""), (7, None), (8, "x"), (8, "x"), (9, "\x00\x00" * 60), (10, "q" + "\x00\x00" * 60), (11, "Grüße, GNU General Public License v3 and MIT license"), (12, "😀 " * 40),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, len(t or ""), "k", 3) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, row int").repartition(3)


@pytest.fixture(scope="module")
def odd_folder(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    odd.drop("kept", "row").write.parquet(f"{at}/documents.parquet")
    item = "the other text of that id, which nothing else repeats at all"
    spark.createDataFrame([(1, "mit license"), (1, "gnu general"), (None, "x"), (3, None), (4, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 1), (5, 1, 0), (None, 0, 1), (8, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "http://a.b/c", "<article><p>x &amp; y</p></article>"), (1, None, None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, None]), (3, None), (4, [3.0, -1.0]), (None, [0.0, 0.5]), (6, [])], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def told(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_every_query_takes_odd_rows(spark, odd_folder):
    for name, query in queries.QUERIES.items():
        rows = query(spark, odd_folder).count()
        want = {"op4_html_text": 2, "op11_whitening": 8}.get(name, len(ROWS))  # four whole vectors, two components each
        assert name == "op6_token_counts" or rows == want, name


def test_op1_keeps_one_of_tied_rows(spark, odd_folder):
    got = queries.QUERIES["op1_exact_dedup"](spark, odd_folder).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    want = {}
    for i, t in ROWS:
        want.setdefault(sha(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()), []).append(i)
    assert by.keys() == want.keys()
    for digest, rows in by.items():
        ids = [i for i in want[digest] if i is not None]
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)} == {len(want[digest])}
        assert {r.keep_id for r in rows} == {min(ids) if ids else None}
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    kept = exact_dedup.without_copies(spark.read.parquet(f"{odd_folder}/documents.parquet"), F.col("doc_id") < 8)
    assert kept.count() == len(by) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_op2_judges_rows_by_their_own_text(spark, odd, odd_folder):
    got = told(queries.QUERIES["op2_substring_dedup"](spark, odd_folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    # Documents in their order; rows of one id see what smaller ids have.
    want = []
    for i, t in ROWS:
        before = [(j, u) for j, u in ROWS if i is None and j is not None or i is not None and j is not None and j < i]
        _, n, gone, spans, kept = brute_substring([(k, u) for k, (_, u) in enumerate(before)] + [("own", t)])["own"]
        want.append((i, n, gone, spans, sha(kept)))
    assert got == sorted(want, key=str)


def test_hot_anchors_are_dealt_by_window(spark):
    rng = random.Random(4)
    line = "one and the same notice"  # longer than an anchor, shorter than a window
    rows = [(i, "".join(rng.choices("abcdef ", k=40)) + line + "".join(rng.choices("abcdef ", k=40)) + line * (i % 3)) for i in range(60)]
    rows += [(100 + i, rows[i][1][10:] + "!") for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 1000):
        got = {r.doc_id: (*tuple(r)[:4], bytes(r.kept)) for r in substring_dedup.remove_repeats(df, block=500, hot_blocks=hot).collect()}
        assert got == brute_substring(rows)


def test_suffixes_of_zero_bytes_end():
    for data in (b"\0\0\0\0", b"ab\0\0\0", b"\0" * 300 + b"a" + b"\0" * 300):
        assert substring_dedup.suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_op3_and_op7_and_op8_columns(spark, odd_folder):
    prints = [f"{brute_fingerprint(t):016x}" for _, t in ROWS]
    assert [p for p, in told(queries.QUERIES["op3_simhash"](spark, odd_folder), "fingerprint")] == sorted(prints)
    empty = sha(b"")
    hits = told(queries.QUERIES["op7_decontamination"](spark, odd_folder), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = []
    for i, t in ROWS:
        n = len(WORD.findall(lower(t)))
        found = {11: (4, 1, sha(b"1"), True)}.get(i, (12, 1, sha(b"4"), True) if i == 5 and "other" in t else (0, 0, empty, False))
        want.append((i, n, *found))
    assert hits == sorted(want, key=str)
    row = next(r for r in queries.QUERIES["op8_license_scan"](spark, odd_folder).collect() if r.doc_id == 11)
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (9, 2, 1, 7, "gpl,mit")
    assert {"gpl", "mit"} <= set(row.labels.split(",")) and 0 < row.score <= 1


def test_decontamination_keeps_every_row_at_any_size(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "c d"), (None, "a b"), (None, "zz")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c d", "zz", "never there"])], "item_id long, text string")
    one, many = (told(decontamination.decontaminate(rows, items, query_bytes=n), "doc_id", "n_words", "hits", "items") for n in (1 << 20, 3))
    assert one == many and len(one) == 5


def test_stages_keep_one_python_worker_for_a_task(spark, odd, odd_folder):
    """A step in Python on another one's output would need a second worker, with its own copy of what both hold."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    encoded = bpe.encode(odd, decoded=True)
    assert plan(encoded).count("MapInArrow") == plan(bpe.encode(odd)).count("MapInArrow") == 3
    want = told(bpe.decode(bpe.encode(odd)), "doc_id", "n_tokens", "ids", "decoded")
    assert told(encoded, "doc_id", "n_tokens", "ids", "decoded") == want and len(want) == len(ROWS)
    benchmark = spark.read.parquet(f"{odd_folder}/benchmark.parquet")
    assert plan(decontamination.decontaminate(odd, benchmark)).count("MapInArrow") == 1


def test_words_that_share_a_hash_stay_apart(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((word + other).encode(), np.uint8)
    first, codes = bpe._number(data, np.array([0, 1024]), np.array([7, 7], np.uint64))
    assert codes.tolist() == [0, 1] and first.tolist() == [0, 1]
    df = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df)).collect()} == {1: word, 2: other}


@pytest.mark.parametrize("key,value", [("spark.sql.execution.arrow.maxBytesPerBatch", "64m"), ("spark.sql.execution.arrow.useLargeVarTypes", "true")])
def test_settings_change_no_result(spark, odd, key, value):
    before = spark.conf.get(key)
    want = told(bpe.encode(odd), "doc_id", "n_tokens", "ids")
    marks = told(simhash.fingerprints(odd), "doc_id", "fp"), told(licenses.scan_licenses(odd), "doc_id", "n_words"), told(substring_dedup.remove_repeats(odd), "doc_id", "kept")
    try:
        spark.conf.set(key, value)
        assert told(bpe.encode(odd), "doc_id", "n_tokens", "ids") == want
        assert (told(simhash.fingerprints(odd), "doc_id", "fp"), told(licenses.scan_licenses(odd), "doc_id", "n_words"), told(substring_dedup.remove_repeats(odd), "doc_id", "kept")) == marks
        assert langid.identify(odd, None).count() == len(ROWS)
    finally:
        spark.conf.set(key, before)
    assert [arrowtext.size_of(x) for x in ("67108864", "64m", "64MB", "1g", "5k")] == [1 << 26, 1 << 26, 1 << 26, 1 << 30, 5120]


def test_stretch_scores_are_those_of_the_explicit_kernel():
    """A machine's weight vector dotted with each stretch's subsequences, listed one by one."""
    text, n = b"you i-diot!", toxicity.STRETCH
    classes, _ = toxicity.padded(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    weights = np.random.default_rng(2).normal(size=32**toxicity.ORDER).astype(np.float32)
    got = toxicity.stretch_scores(classes, weights)
    for p in range(len(text)):
        total = norm = 0.0
        for a in range(p, p + n):
            for rest in combinations(range(a + 1, a + toxicity.SPAN), toxicity.ORDER - 1):
                w = toxicity.DECAY ** (rest[-1] - a + 1 - toxicity.ORDER)  # a factor for each character passed over
                code = 0
                for at in (a, *rest):
                    code = code * 32 + int(classes[at])
                total, norm = total + w * weights[code], norm + w * w
        assert abs(got[p] - total / np.sqrt(norm)) < 1e-4
    # The kernel of two stretches is the dot product of their listed subsequences; equal ones have 1.
    codes, w = toxicity._features(classes, np.array([0, 4]))
    dots = [[sum(x * y for c, x in zip(codes[i], w, strict=True) for d, y in zip(codes[j], w, strict=True) if c == d) for j in (0, 1)] for i in (0, 1)]
    assert dots[0][1] == dots[1][0] < min(dots[0][0], dots[1][1])


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    plain = [f"w{i}" for i in range(300)]
    say = lambda k: " ".join(rng.choices(plain, k=k))
    leak, base = say(30), say(120)
    texts = {i: say(rng.randint(40, 90)) + (" you utter idiot" if i % 4 == 0 else "") for i in range(200)}
    texts |= {300: base, 301: base + " tail", 302: texts[1], 303: say(20) + " " + leak + " " + say(20), 304: say(25), 305: None, 306: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(304, texts[304], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert kept == sorted([i for i in range(200) if i % 4] + [300, 304, 305])


def test_numerals_are_no_letters(spark):
    rows = [(1, "½"), (2, "² ³"), (3, "Ⅷ"), (4, "12 _ 34"), (5, "½ a"), (6, "中")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trees = langid.train(spark.createDataFrame([(i, "the of and", "en") for i in range(8)] + [(i, "der die das", "de") for i in range(8, 16)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, trees).collect()}
    assert {i for i, lang in got.items() if lang == "und"} == {1, 2, 3, 4}
