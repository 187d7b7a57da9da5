"""Events appended as a stream: the same as in one batch, and nothing twice."""

from pyspark.sql import Row

from lumenledger.streaming import append as A


def batches():
    first = [(3, "s", "decision", "cat", "feed it", 100, None, ["doc:1", "doc:2"]), (1, "s", "observation", "cat", "Grey cat", 120, None, None), (2, "t", "observation", "dog", "seen", 5, None, []), (9, None, "x", "y", "z", 1, None, None)]
    second = [(3, "s", "decision", "cat", "feed it", 100, None, ["doc:1", "doc:2"]), (4, "s", "correction", "cat", "black", 90, 1, None), (4, "s", "correction", "cat", "black", 90, 1, None), (5, "t", None, "dog", "gone", 9, None, None)]
    return first, second


def plain(rows):
    """What one batch after another gives."""
    state, out = {}, []
    for batch in rows:
        for i, s, kind, subject, payload, at, supersedes, locators in sorted((r for r in batch if r[1] and r[2]), key=lambda r: r[0]):
            n, clock, digest, seen = state.get(s, (0, 0, "", ()))
            if i in seen:
                continue
            n, clock = n + 1, max(clock, at)
            digest = A.link(digest, s, n, i, kind, subject, payload)
            state[s] = (n, clock, digest, (*seen, i))
            out += [(s, i, n, clock, "event", kind), (s, i, n, clock, "graph", "about"), (s, i, n, clock, "outbox", "pending")]
            out += [(s, i, n, clock, "term", t) for t in {t.lower() for t in f"{subject} {payload}".split()}]
            out += [(s, i, n, clock, "graph", "supersedes")] * (supersedes is not None)
            for k, _ in enumerate(locators or ()):
                out += [(s, i, n, clock, "evidence", str(k)), (s, i, n, clock, "graph", "evidence")]
    return sorted(out), state


def test_stream_and_replay(spark, tmp_path):
    def put(rows, name):
        spark.createDataFrame(rows, A.INCOMING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(A.INCOMING).parquet(f"{tmp_path}/in")
        with A.rocksdb(spark):
            A.appended(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(A.APPENDED).parquet(f"{tmp_path}/out").collect()

    first, second = batches()
    before = spark.conf.get(A.rocksdb.KEY)
    put(first, "a")
    run()
    put(second, "b")
    got = run()
    want, state = plain([first, second])
    assert sorted(tuple(r)[:6] for r in got) == want
    assert {r.session_id: r.value for r in got if r.part == "event" and r.sequence == state[r.session_id][0]} == {s: x[2] for s, x in state.items()}
    put(first + second, "c")  # delivered again
    assert len(run()) == len(got) and spark.conf.get(A.rocksdb.KEY) == before


class Store:
    """A state that counts what is asked of it."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def get(self):
        return self.getValue("last")

    def update(self, value):
        self.updateValue("last", value)

    def getValue(self, key):  # noqa: N802
        self.asked += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.asked += 1
        self.held[key] = value


def test_the_store_is_asked_for_blocks_of_ids_not_for_events():
    store, appender = Store(), A.Appender()
    appender.init(store)
    incoming = Row(*(c.split()[0] for c in A.INCOMING.split(", ")))
    put = lambda ids: [(r.event_id, r.sequence) for r in appender.handleInputRows(("s",), iter([incoming(i, "s", "k", "a", "b", 1, None, None) for i in ids]), None)]
    first = [*range(-3, 2000), 65535, 65536, 1 << 40]
    assert put(first[::-1] + first) == [(i, n) for n, i in enumerate(first, 1)]
    assert put(first) == []
    assert put([*first, 5000, -70000]) == [(-70000, len(first) + 1), (5000, len(first) + 2)]
    assert store.asked < 30
