"""The pipeline's near-copy stage against brute force, with planted copies."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lumenledger.llm import nearcopies
from lumenledger.llm.arrowtext import join_keys
from lumenledger.llm.simhash import components


def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    notice = " all rights reserved by the owner of this page and no part may be copied"
    texts = [None, "", " \t\n", "one two", "ONE  two", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j k"]
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(20, 300))
        texts.append(" ".join(words) + (notice if k % 2 else ""))
        for edits in (1, 2, 4) if k % 3 == 0 else ():
            other = list(words)
            for _ in range(edits):
                other[rng.randrange(len(other))] = "edited"
            texts.append(" ".join(other).upper() + (notice if k % 2 else ""))
    rng.shuffle(texts)
    return [(100 + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def kept(docs):
    sets = {}
    for doc_id, text, *_ in docs:
        words = (text or "").lower().split()
        short = {tuple(words)} if words else set()
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else short
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] | sets[j])
            if i < j and (not both or 5 * len(sets[i] & sets[j]) >= 4 * both):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_near_copies_of_edited_texts_go(spark):
    docs = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, df, None)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = kept(docs)
    assert len(docs) - len(want) >= 40
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), None).count() == 0


def test_rows_without_ids_link_and_stay(spark):
    """1 and 3 are near copies only by way of a row without an id; of near copies without any id one stays."""
    words = [f"w{i}" for i in range(120)]
    edit = lambda ws, *at: [f"x{i}" if i in at else w for i, w in enumerate(ws)]
    one, between, three = edit(words, 10), words, edit(words, 100)
    one, three = edit(one, 12), edit(three, 102)
    alone = [f"a{i}" for i in range(60)]
    rows = [(1, one), (None, between), (3, three), (None, alone), (None, edit(alone, 58)), (None, alone), (None, ["u", "v"]), (None, None), (9, ["z"] * 9), (None, ["z"] * 9)]
    text = lambda ws: None if ws is None else " ".join(ws)
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert alike(one, between) >= 0.8 and alike(between, three) >= 0.8 > alike(one, three) and alike(alone, edit(alone, 58)) >= 0.8
    df = spark.createDataFrame([(i, text(w), "en", "s", 0) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, None).collect()]
    assert len(got) == 5 and {(1, text(one)), (None, "u v"), (None, None), (9, text(["z"] * 9))} < set(got)
    assert {t for i, t in got if i is None and t not in ("u v", None)} <= {text(alone), text(edit(alone, 58))}
    found = {(r.doc_id, r.component_id) for r in nearcopies.near_copies(df).collect()}
    assert found == {(1, 1), (3, 1), (None, 1), (None, None), (9, 9), (None, 9)}


def test_decontamination_stage_judges_rows_without_ids(spark, tmp_path):
    spark.createDataFrame([(1, "a passage of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "here is a passage of the benchmark"), (None, "clean"), (None, None), (4, "a passage of the benchmark"), (5, "clean")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, "clean"), (None, None), (5, "clean")], key=str)


def test_the_last_plan_is_small(spark, capsys):
    """What joins name several times is stored; one plan of all had each step up to 15 times, in the driver's memory."""
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    nearcopies.near_copies(df).explain()
    assert capsys.readouterr().out.count("Exchange") < 10


def test_components_of_a_small_graph_take_few_tasks(spark):
    """Each round's edges fit one task, so a round must not have a task for each of the partitions again and again."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("small components", "")
        found = components(edges)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("small components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert tasks < 300, tasks


def test_keys_of_which_none_is_hot_are_joined_once(spark):
    rows = spark.createDataFrame([(i % 50, i) for i in range(500)], "k long, x long")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("many"))
    plain = join_keys(rows, keys, "k", "many", 50_000_000, 0)
    assert "Union" not in plain._jdf.queryExecution().optimizedPlan().toString()
    split = join_keys(rows, keys, "k", "many", 50_000_000)
    assert sorted(plain.collect()) == sorted(split.collect())
    assert sorted(plain.collect()) == sorted(join_keys(rows, keys, "k", "many", 500, 50).collect())
