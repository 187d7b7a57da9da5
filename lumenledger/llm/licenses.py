"""License scan by ordered signature rules.

A text is reduced to its lower-cased words, joined by one space. The rules of license_rules are
regexes over that string: identifiers, notices, the licenses' own wording, names with and without
versions. A rule applies only if every one of its keywords is a word of the text, so nearly all
texts run no regex. Detections overlap: they are ranked by confidence, then length, then the
order of the rules, and one whose words lie within a higher one's is dropped.

Base phrases are counted apart, at every place where their words stand consecutively, and
nothing suppresses them. Null is the empty text, which has no words and no detection. A
text of any length is scanned whole. Repeated rows each get their answer; an empty table gives
an empty result. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, give_back, small_batches, texts, words
from lumenledger.llm.license_rules import SECTIONS, UNDER

#: Phrases that are always counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@cache
def rules() -> list[tuple[float, str, frozenset[bytes], re.Pattern[bytes]]]:
    """Every rule in the order of priority: confidence, label, keywords, regex."""
    made = []
    for sure, lines in SECTIONS:
        for line in lines.strip().splitlines():
            label, keys, pattern = line.split(" | ")
            made.append((sure, label, frozenset(k.encode() for k in keys.split()), re.compile(rf"(?<= )(?:{pattern.replace('{under}', UNDER)})(?= )".encode())))
    return made


@cache
def _keywords() -> frozenset[bytes]:
    return frozenset().union(*(r[2] for r in rules())) | {p.split()[0].encode() for p in BASE}


def outermost(spans: list[tuple[int, int]]) -> list[int]:
    """Which of the ranked spans (first and last, the highest first) lie within no higher one. In n log n steps.

    A span within a dropped one lies within what dropped that, so all higher spans count.
    """
    ends = sorted({a for a, _ in spans})
    place = {a: i + 1 for i, a in enumerate(ends)}
    # The greatest last word of the higher spans that begin at a place or before it.
    tree = [-1] * (len(ends) + 1)
    kept = []
    for k, (first, last) in enumerate(spans):
        i, most = place[first], -1
        while i:
            most = max(most, tree[i])
            i &= i - 1
        if most < last:
            kept.append(k)
        i = place[first]
        while i < len(tree):
            tree[i] = max(tree[i], last)
            i += i & -i
    return kept


def detect(found: list[bytes]) -> list[tuple[str, float, int, int, bool]]:
    """label, confidence, first and last word, whether a base phrase; ordered by place."""
    present = _keywords().intersection(found)
    if not present:
        return []
    line = b" " + b" ".join(found) + b" "
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))
    out = []
    for phrase, label in BASE.items():
        p, at = f" {phrase} ".encode(), -1
        while (at := line.find(p, at + 1)) >= 0:
            first = word(at)
            out.append((label, 0.6, first, first + phrase.count(" "), True))
    hits = []
    for order, (sure, label, keys, regex) in enumerate(rules()):
        if keys <= present:
            for m in regex.finditer(line):
                hits.append((-sure, m.start() - m.end(), order, word(m.start()) - 1, word(m.end()) - 1, label))
    hits.sort()
    for k in outermost([h[3:5] for h in hits]):
        sure, _, _, first, last, label = hits[k]
        out.append((label, -sure, first, last, False))
    return sorted(out, key=lambda x: (x[2], x[3], x[0], x[4]))


SCAN = "doc_id long, n_words long, detections array<struct<label:string,confidence:double,first:long,last:long,base:boolean>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Every document with its detections, one for each place."""
    kind = pa.list_(
        pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("first", pa.int64()), ("last", pa.int64()), ("base", pa.bool_())])
    )
    names = ("label", "confidence", "first", "last", "base")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 8 << 20):
            counts, rows = [], []
            for text in texts(block["text"]):
                found = words(text)
                counts.append(len(found))
                rows.append([dict(zip(names, x, strict=True)) for x in detect(found)])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": block["doc_id"].cast(pa.int64()), "n_words": pa.array(counts, pa.int64()), "detections": pa.array(rows, kind)}
            )
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(scan, SCAN)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the places of the base phrases, and the labels of all rules."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("detections", lambda d: d["base"])
    at = F.transform(base, lambda d: d["first"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
