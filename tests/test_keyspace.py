import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions.fields import compare, field_value, human_bytes, number
from keyloom.model import CHANGELOG
from keyloom.operators import atomic, collections, index, placement, predicate, scan, state, stats, vector, write
from keyloom.plans import command
from keyloom.sources import backup
from keyloom.streaming import feed

S = 1_000_000


def log(spark, rows, ns="n"):
    """(version, op, key, value[, expiry_us]) as a change log whose times are the versions in seconds."""
    full = [(v, v * S, op, ns, k, val, *(rest or [None]), 1) for v, op, k, val, *rest in rows]
    return spark.createDataFrame(full, CHANGELOG)


def puts(spark, pairs, ns="n"):
    return log(spark, [(i + 1, "PUT", k, v) for i, (k, v) in enumerate(pairs)], ns)


def column(df, name="key"):
    return [r[name] for r in df.collect()]


def test_range_scan(spark):
    rows = puts(spark, [(k, "v" + k) for k in "k07 k02 k09 k00 k05 k03 k08 k01 k06 k04".split()])
    assert column(scan.range_scan(rows)) == [f"k0{i}" for i in range(10)]
    assert column(scan.range_scan(rows, "k03", "k07")) == ["k03", "k04", "k05", "k06"]
    assert column(scan.range_scan(rows, "k03", "k07", 2)) == ["k03", "k04"]
    assert column(scan.range_scan(rows, "k03", "k07", reverse=True)) == ["k06", "k05", "k04", "k03"]
    assert column(scan.range_scan(rows, limit=3, reverse=True)) == ["k09", "k08", "k07"]
    assert column(scan.range_scan(rows, "x", "z")) == []


def test_cursor_pages(spark):
    rows = puts(spark, [(f"p0{i}", "") for i in range(10)])
    both = rows.unionByName(rows.withColumn("ns", F.lit("m/%")))  # equal keys of two namespaces

    def pages(rows, limit, ns):
        cursor, out = "", []
        while True:
            page, following = scan.scan_cursor(rows, cursor, limit, ns)
            out.append([(r.ns, r.key) for r in page.collect()])
            cursor = following.first().next_cursor
            if not cursor:
                return out

    assert [len(p) for p in pages(rows, 3, "n")] == [3, 3, 3, 1]
    assert sum(pages(both, 1, None), []) == [(ns, f"p0{i}") for ns in ("m/%", "n") for i in range(10)]


def test_requests_name_their_namespace(spark):
    rows = puts(spark, [("k", "1"), ("l", "2")], "a").unionByName(puts(spark, [("k", "3")], "b"))
    asked = spark.createDataFrame([(0, "b", "k"), (1, "a", "k"), (2, "b", "l"), (3, "b", "k")], "pos int, ns string, key string")
    for n_keys in (None, 4):
        assert [(r.found, r.value) for r in scan.mget(rows, asked, n_keys).collect()] == [(True, "3"), (True, "1"), (False, None), (True, "3")]
    with pytest.raises(ValueError):
        scan.mget(rows, asked.drop("ns"))
    swaps = spark.createDataFrame([(0, "a", "k", "1", "x"), (1, "b", "k", "1", "y")], "pos int, ns string, key string, expected string, new string")
    assert {(r.ns, r.result, r.value) for r in atomic.compare_and_swap(swaps, rows).collect()} == {("a", "SUCCESS", "x"), ("b", "MISMATCH", "3")}
    added = spark.createDataFrame([(0, "a", "k", 5), (1, "b", "k", 5), (2, "c", "k", 5)], "pos int, ns string, key string, delta long")
    assert {(r.ns, r.value) for r in atomic.increment(added, rows).collect()} == {("a", 6), ("b", 8), ("c", 5)}


def test_writes(spark):
    before = state.latest_per_key(puts(spark, [("a", "1"), ("b", "2")], ""))
    asked = spark.createDataFrame([(5, "a", "x", 0), (2, "c", "y", 9), (7, "a", "z", 0), (8, "", "no", 0)], "pos long, key string, value string, ttl_s int")
    changes = write.put(asked, 50 * S, 100)
    assert [(r.version, r.key, r.expiry_us) for r in changes.orderBy("version").collect()] == [(100, "c", 59 * S), (101, "a", None), (102, "a", None)]
    after = write.apply(before, changes)
    assert {(r.key, r.value) for r in after.collect()} == {("a", "z"), ("b", "2"), ("c", "y")}
    gone, answers = write.delete(spark.createDataFrame([(1, "a"), (2, "zz"), (3, "a")], "pos long, key string"), state.live(after, 51 * S), 60 * S, 200)
    assert [r.deleted for r in answers.orderBy("pos").collect()] == [True, False, False]
    assert {r.key for r in state.live(write.apply(after, gone), 58 * S).collect()} == {"b", "c"}


def test_hash_writes(spark):
    schema = "key string, field string, value string, op string, expiry_us long, ts_us long"
    fields = spark.createDataFrame([("h", "a", "1", "PUT", None, 0), ("h", "b", "2", "PUT", 5 * S, 0), ("h", "c", None, "DEL", None, 0)], schema)
    assert collections.hgetall(fields, "h", 6 * S).collect() == [("a", "1")] and collections.hlen(fields, 4 * S).first().fields == 2
    written = spark.createDataFrame([(1, "h", "a", "x"), (2, "h", "b", "y"), (3, "h", "b", "z")], "pos int, key string, field string, value string")
    after, created = collections.hset(fields, written, 6 * S)
    assert created.first().created == 1 and {(r.field, r.value) for r in collections.hgetall(after, "h", 6 * S).collect()} == {("a", "x"), ("b", "z")}
    left, deleted = collections.hdel(after, spark.createDataFrame([("h", "a"), ("h", "zz"), ("h", "c")], "key string, field string"), 7 * S)
    assert deleted.first().deleted == 1 and column(collections.hkeys(left, "h", 7 * S), "field") == ["b"]
    assert column(collections.hget(left, "h", "b", 7 * S), "value") == ["z"] and collections.hget(left, "h", "a", 7 * S).count() == 0


def test_ttl_and_tombstones(spark):
    rows = log(spark, [(1, "PUT", "d1", "a"), (2, "PUT", "d2", "a"), (3, "PUT", "d3", "a", 4 * S), (4, "DEL", "d2", None)])
    at = lambda changes, now: sorted(column(state.live(state.latest_per_key(changes), now)))
    assert at(rows, 4 * S - 1) == ["d1", "d3"]
    assert at(rows, 4 * S) == ["d1"]
    assert at(rows.unionByName(log(spark, [(5, "PUT", "d2", "b")])), 4 * S) == ["d1", "d2"]
    assert column(state.expire(state.latest_per_key(rows), 4 * S)) == ["d3"]
    assert sorted(column(state.reap(state.latest_per_key(rows), 4 * S + 86_400 * S))) == ["d1", "d3"]


def test_latest_per_key_equals_a_dictionary(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(i, rng.choice(["PUT", "PUT", "DEL"]), f"k{rng.randrange(9)}", str(i)) for i in range(60)]
        want = {k: (op, v) for _, op, k, v in rows}
        got = {r.key: (r.op, r.value) for r in state.latest_per_key(log(spark, rng.sample(rows, len(rows)))).collect()}
        assert got == want


USERS = [
    ("u1", '{"name":"ana","age":30,"city":"berlin"}'), ("u2", '{"name":"bob","age":45,"city":"madrid"}'), ("u3", '{"name":"cyn","age":22,"city":"berlin"}'),
]


def test_field_query(spark):
    rows = puts(spark, USERS, "users")
    ask = lambda line: column(command.build(rows, command.parse(line)))
    assert ask("QUERY users WHERE age > 25") == ["u1", "u2"]
    assert ask("QUERY users WHERE city = berlin") == ["u1", "u3"]
    assert ask("QUERY users WHERE city = berlin LIMIT 1") == ["u1"]
    assert ask("QUERY users WHERE name contains o") == ["u2"]
    assert ask("QUERY users WHERE age <= 30") == ["u1", "u3"]
    for bad in ("QUERY users WHERE age LIKE 3", "QUERY users WHERE age >", "NOPE", "", "QUERY users WHERE age > 3 LIMIT"):
        with pytest.raises(ValueError):
            command.parse(bad)


@pytest.mark.parametrize(
    "value, field, want",
    [
        ('{"age":30,"o":{"x":1},"a":[1],"n":null,"b":true,"s":"x"}', f, w)
        for f, w in (("age", "30"), ("o", None), ("a", None), ("n", None), ("b", "true"), ("s", "x"), ("zz", None))
    ]
    + [
        ('{"f":1.50}', "f", "1.5"), ('{"f":1e3}', "f", "1000"), ('{"f":1e21}', "f", "1" + "0" * 21), ('  {"age":5}  ', "age", "5"),
        ("{bad age=4", "age", "4"), ('{"x":"age=4"}', "age", None), ("stage=9;age=7", "age", "7"), ("xage=1", "age", None), ("age=", "age", None),
        ("age=,age=3", "age", None), ('{"x":1} age=4', "age", "4"), ('{"f":0.000001}', "f", "0.000001"), (None, "f", None),
    ],
)
def test_field_extraction(spark, value, field, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(field_value(F.col("v"), field).alias("x")).first().x == want


def test_last_of_repeated_names_counts(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        assert spark.createDataFrame([('{"age":1,"age":2}',)], "v string").select(field_value(F.col("v"), "age").alias("x")).first().x == "2"
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_comparisons(spark):
    one = spark.range(1)
    say = lambda a, op, b: one.select(compare(F.lit(a), op, b).alias("x")).first().x
    assert say("10", ">", "9") and not say("10", ">", "9a") and say("1d", "<", "2")
    assert say("nan", ">=", "1") and not say("NaN", ">", "1") and say("inf", ">", "1e300")
    assert one.select(number(F.lit(" 1")).alias("x")).first().x is None


def test_index_follows_updates(spark):
    c = index.Catalog()
    c.create("by_age", "age")
    c.create("by_age", "age")
    with pytest.raises(ValueError):
        c.create("by_age", "city")
    with pytest.raises(ValueError):
        c.create("a/b", "x")
    old, new = puts(spark, [("user/1", "age=20"), ("user/2", "name=Al,age=30")]), puts(spark, [("user/1", "age=21"), ("user/2", "name=Al,age=30")])
    assert column(index.lookup(c.entries(old), "by_age", "30")) == ["user/2"]
    changed = {(r.change, r.field_value) for r in index.diff(c.entries(old), c.entries(new)).collect()}
    assert changed == {("remove", "20"), ("add", "21")}
    assert c.list() == [("by_age", "age")]


def test_predicates(spark):
    predicate.register("b", lambda key, value: value.startswith("b"))
    rows = puts(spark, [("a1", "bx"), ("a2", "cx"), ("b1", "by")])
    assert column(predicate.predicate_scan(rows, "b", "a")) == ["a1"]
    keys = spark.createDataFrame([(0, "n", "a2"), (1, "n", "a1"), (2, "n", "zz"), (3, "n", "a1")], "pos int, ns string, key string")
    assert column(predicate.predicate_filter(rows, keys, "b"), "matches") == [False, True, False, True]
    with pytest.raises(KeyError):
        predicate.stored("none")


def test_counters_saturate(spark):
    live = puts(spark, [("a", "5"), ("c", str(2**63 - 1)), ("d", "10"), ("e", str(-(2**63))), ("x", "no")]).drop("ns")
    asked = [(1, "a", 3), (2, "b", 42), (3, "c", 1), (4, "d", -3), (5, "e", -1), (6, "x", 1), (7, "c", -2), (8, "c", 1)]
    got = {r.key: r.value for r in atomic.increment(spark.createDataFrame(asked, "pos long, key string, delta long"), live).collect()}
    assert got == {"a": 8, "b": 42, "c": 2**63 - 2, "d": 7, "e": -(2**63), "x": None}


def test_counter_chunks_compose(spark, monkeypatch):
    monkeypatch.setattr(atomic, "CHUNK", 3)
    rng, value, asked = random.Random(2), 0, []
    for i in range(100):
        delta = rng.choice([2**62, -(2**62), 2**63 - 1, -(2**63), 5])
        asked.append((i, "k", delta))
        value = max(-(2**63), min(2**63 - 1, value + delta))
    df = spark.createDataFrame(asked, "pos long, key string, delta long")
    assert atomic.increment(df, puts(spark, [("z", "1")]).drop("ns")).first().value == value


def test_cas_setnx_txn(spark):
    live = puts(spark, [("k", "v1"), ("a", "v0")]).drop("ns")
    asked = spark.createDataFrame([(1, "k", "v1", "v2"), (2, "k", "v1", "v3"), (3, "k", "v2", "v4"), (4, "m", "x", "y")], "pos long, key string, expected string, new string")
    got = [(r.result, r.value) for r in atomic.compare_and_swap(asked, live).orderBy("pos").collect()]
    assert got == [("SUCCESS", "v2"), ("MISMATCH", "v2"), ("SUCCESS", "v4"), ("KEY_NOT_FOUND", None)]
    created = atomic.set_if_absent(spark.createDataFrame([(1, "k", "x"), (2, "n", "y"), (3, "n", "z")], "pos long, key string, value string"), live)
    assert [(r.key, r.value) for r in created.collect()] == [("n", "y")]
    ops = [(1, 1, "SETIF", "a", "1", 2 * S), (1, 2, "SET", "b", "2", None), (1, 3, "DEL", "c", None, None), (1, 4, "SET", "c", "3", None),
           (2, 1, "SETIF", "a", "1", 1), (2, 2, "SET", "d", "2", None), (3, 1, "SETIF", "new", "1", 0)]
    df = spark.createDataFrame(ops, "txn_id long, pos int, op string, key string, value string, expected_version long")
    got = {(r.txn_id, r.status, r.op, r.key, r.value) for r in atomic.commit(df, live).collect()}
    assert got == {(1, "COMMITTED", "PUT", "a", "1"), (1, "COMMITTED", "PUT", "b", "2"), (1, "COMMITTED", "DEL", "c", None),
                   (2, "CONFLICT", None, None, None), (3, "COMMITTED", "PUT", "new", "1")}


def test_lists(spark):
    ops = [(1, "RPUSH", "a"), (2, "RPUSH", "b"), (3, "RPUSH", "c"), (4, "LPUSH", "z")]
    make = lambda rows: spark.createDataFrame([(v, "l", op, x) for v, op, x in rows], "version long, key string, op string, value string")
    rows = collections.lists(make(ops))
    read = lambda a, b: [r.value for r in collections.lrange(rows, a, b).orderBy("pos").collect()]
    assert read(0, -1) == ["z", "a", "b", "c"] and read(-2, -1) == ["b", "c"] and read(1, 2) == ["a", "b"] and read(4, 1) == []
    left = collections.lists(make([*ops, (5, "LPOP", None), (6, "RPOP", None)]))
    assert sorted(column(left, "value")) == ["a", "b"] and collections.llen(left).first().length == 2
    drained = collections.lists(make([*ops, *((i, "LPOP", None) for i in range(5, 12)), (20, "RPUSH", "q")]))
    assert column(drained, "value") == ["q"]


def test_sets_and_hashes(spark):
    have = spark.createDataFrame([("s", "beta")], "key string, member string")
    added = spark.createDataFrame([(1, "s", "alpha"), (2, "s", "alpha"), (3, "s", "beta")], "pos int, key string, member string")
    assert [r.changed for r in collections.sadd(have, added).orderBy("pos").collect()] == [True, False, False]
    fields = spark.createDataFrame([("h", "a", "1", "PUT", None, 0), ("h", "b", "2", "PUT", 5 * S, 0)], "key string, field string, value string, op string, expiry_us long, ts_us long")
    ttl = {r.field: r.ttl for r in collections.httl(fields, 3 * S).collect()}
    assert ttl == {"a": -1, "b": 2} and {r.ttl for r in collections.httl(fields, 5 * S).collect()} == {-1, -2}
    assert collections.hash_maps(fields, 3 * S).first().fields == {"a": "1", "b": "2"}


def test_changes_since(spark):
    rows = state.latest_per_key(log(spark, [(1, "PUT", "c1", "a"), (2, "PUT", "c2", "b"), (3, "PUT", "c3", "c"), (4, "PUT", "c4", "d"), (5, "DEL", "c1", None)]))
    page, tail = feed.changes_since(rows, 0, 10, 9 * S)
    assert [(r.op, r.key) for r in page.collect()] == [("PUT", "c2"), ("PUT", "c3"), ("PUT", "c4"), ("DEL", "c1")] and not tail.first().more
    page, tail = feed.changes_since(rows, 3 * S, 1, 9 * S)
    assert column(page) == ["c3"] and tail.first().more and tail.first().next_us == 3 * S
    ties = rows.withColumn("ts_us", F.lit(S))  # more changes of one instant than a page holds
    seen, after = [], None
    while True:
        page, tail = feed.changes_since(ties, S, 3, 9 * S, after)
        seen += column(page)
        last = tail.first()
        if not last.more:
            break
        after = (last.next_ns, last.next_key)
    assert seen == ["c1", "c2", "c3", "c4"]


def test_restore_and_targets(spark):
    rows = log(spark, [(i, "PUT", f"k{i % 5}", f"v{i}") for i in range(1, 16)] + [(16, "DEL", "k0", None)])
    base = state.latest_per_key(rows.where("version <= 5"))
    got = {r.key: r.value for r in backup.restore_to(base, 5, rows, "version:10").collect()}
    assert got == {"k1": "v6", "k2": "v7", "k3": "v8", "k4": "v9", "k0": "v10"}
    assert backup.restore_to(base, 5, rows, "1970-01-01T00:00:16Z").where("op = 'DEL'").count() == 1
    with pytest.raises(ValueError):
        backup.restore_to(base, 5, rows, "version:5")
    for bad in ("", "version:", "version:0", "yesterday", "version:abc"):
        with pytest.raises(ValueError):
            backup.parse_target(bad)


def test_files_round_trip(spark, tmp_path):
    rows = puts(spark, [("a/1", "x\ny"), ("a/2", "é|"), ("b", "")])
    backup.write_jsonl(rows, f"{tmp_path}/j", "a/")
    assert {(r.key, r.value) for r in backup.read_jsonl(spark, f"{tmp_path}/j").collect()} == {("a/1", "x\ny"), ("a/2", "é|")}
    backup.full_backup(state.latest_per_key(rows), f"{tmp_path}/full")
    assert backup.read_changes(spark, f"{tmp_path}/full").count() == 3
    (tmp_path / "wal").write_text("5|0|k|3|77|1\n6|1|k|0|0|2|88\n7|0|torn\n")
    assert [(r.key, r.tombstone, r.version) for r in backup.read_wal(spark, f"{tmp_path}/wal").orderBy("version").collect()] == [("k", False, 1), ("k", True, 2)]
    moved = backup.migrate_schema(rows, {1: F.upper}, 2)
    assert {r.schema_version for r in moved.collect()} == {2}
    with pytest.raises(Exception, match="no step"):
        backup.migrate_schema(rows, {}, 2).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = log(spark, [(i, "DEL" if i % 7 == 0 else "PUT", f"k{i % 11}", str(i)) for i in range(1, 80)])
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    replica = feed.Replica(spark, f"file://{tmp_path}/state")
    replica.run(feed.subscribe(spark, f"{tmp_path}/in", files_per_trigger=2), f"{tmp_path}/cp")
    rows.limit(5).write.mode("append").parquet(f"{tmp_path}/in")  # replays change nothing
    replica.run(feed.subscribe(spark, f"{tmp_path}/in"), f"{tmp_path}/cp")
    as_set = lambda df: {(r.key, r.op, r.value) for r in df.collect()}
    assert as_set(replica.state()) == as_set(state.latest_per_key(rows))


def test_stream_counters_and_tokens(spark, tmp_path):
    schema = "ns string, key string, version long, ts_us long, delta long"
    spark.createDataFrame([("n", "a", i, i * S // 4, 2**62) for i in range(20)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for df, mode, name in ((feed.stream_counters(stream), "update", "c"), (feed.stream_token_bucket(stream, 1, 5), "append", "t")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("c").first().value == 2**63 - 1
    batch = feed.token_bucket(spark.read.schema(schema).parquet(f"{tmp_path}/in"), 1, 5)
    assert {(r.version, r.admitted) for r in spark.table("t").collect()} == {(r.version, r.admitted) for r in batch.collect()}
    assert 5 <= batch.where("admitted").count() < 20


def test_vectors(spark):
    df = spark.createDataFrame([("n", "x", [2.0, 0.0, 0.0]), ("n", "y", [0.0, 3.0, 0.0]), ("n", "most z", [0.3, 0.4, 5.0])], "ns string, id string, vec array<float>")
    top = vector.search(df, [0.8, 0.3, 0], 2, "n").collect()
    assert top[0].id == "x" and top[0].score >= 0.9
    assert vector.search(df, [0.0, 2.0, 0.5], 1).first().id == "y"
    with pytest.raises(Exception, match="dimension"):
        vector.search(df, [1.0, 0.0], 1).collect()
    with pytest.raises(ValueError):
        vector.search(df, [0.0, 0.0, 0.0], 1)


def test_index_recall(spark, tmp_path):
    import numpy as np

    m = np.random.default_rng(42).normal(size=(1000, 16)).astype("float32")
    df = spark.createDataFrame([("n", i, v.tolist()) for i, v in enumerate(m)], "ns string, id long, vec array<float>")
    built = vector.InvertedFile.build(df, f"file://{tmp_path}/index", cells=16)
    built = vector.InvertedFile(spark, built.path)  # the written index
    asked, hit = np.random.default_rng(43).normal(size=(20, 16)), 0
    for q in asked:
        exact = np.argsort(-(m / np.linalg.norm(m, axis=1, keepdims=True)) @ q)[:10]
        hit += len(set(exact.tolist()) & {r.id for r in built.search(q.tolist(), 10, probes=10).collect()})
    assert hit / 200 >= 0.9
    assert built.rows.count() == len(m)


def test_placement_and_stats(spark):
    shards = spark.createDataFrame([("a",), ("é",), ("",)], "k string").select("k", placement.shard_id(F.col("k")).alias("s"), placement.crc32c(F.col("k").cast("binary")).alias("c"))

    def fnv(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h & 8191

    assert all(r.s == fnv(r.k) for r in shards.collect())
    assert spark.range(1).select(placement.crc32c(F.lit("123456789").cast("binary")).alias("c")).first().c == 0xE3069283
    nodes = [("a", "r1"), ("b", "r1"), ("c", "r2"), ("d", "r3")]
    assert placement.replicas(nodes, 0, 3) == ["a", "c", "d"] and placement.replicas(nodes, 1, 4) == ["b", "c", "d", "a"]
    lat = spark.createDataFrame([("r", float(i)) for i in range(1, 101)], "op string, v double")
    p = stats.percentiles(lat, "op", "v").first()
    assert (p.p50, p.p90, p.p99, p.p999, p.max) == (50.0, 90.0, 99.0, 99.0, 100.0)
    assert stats.watermark(spark.createDataFrame([], "replica string, watermark_us long")).first().watermark_us == 2**63 - 1


def test_ring_and_checksums_equal_plain_loops(spark):
    rng = random.Random(8)
    keys = ["", "a", "é" * 9, *("".join(rng.choice("abcxyz0") for _ in range(rng.randrange(1, 40))) for _ in range(50))]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", placement.ring_hash("k").alias("h")).collect()

    def ring(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = ((h ^ h >> 33) * f) % 2**64
        return h ^ h >> 33

    assert all(int(r.h) == ring(r.k) for r in got)
    points = [(rng.randrange(1000), f"n{i}") for i in range(7)]
    asked = spark.createDataFrame([(str(i), i) for i in range(0, 1100, 7)], "key string, h long")
    for r in placement.owner(asked, spark.createDataFrame(points, "h long, node string")).collect():
        after = [p for p in sorted(points) if p[0] >= int(r.key)]
        assert r.node == (after or sorted(points))[0][1]


def test_lag_equals_pairs(spark):
    rng = random.Random(9)
    ops = [(i, rng.randrange(50)) for i in range(200)]
    acks = [(r, rng.choice([-1, 10, 10, 150, 199, 500])) for r in range(20)]
    o, a = spark.createDataFrame(ops, "seq long, size long"), spark.createDataFrame(acks, "replica long, last_ack long")
    want = {(r, sum(s > k for s, _ in ops), sum(b for s, b in ops if s > k)) for r, k in acks if k < 199}
    assert {tuple(r) for r in stats.replica_lag(o, a).select("replica", "ops_behind", "bytes_behind").collect()} == want
    assert {(r.replica, r.seq) for r in stats.anti_entropy(o, a).collect()} == {(r, s) for r, k in acks for s, _ in ops if s > k}
    assert all(r.acked == 1 + sum(k >= r.seq for _, k in acks) for r in stats.quorum(o, a, 20).collect())


def test_batch_search_over_blocks(spark):
    import numpy as np

    m = np.random.default_rng(5).normal(size=(300, 8)).astype("float32")
    m[7] = m[8]  # a tie
    df = spark.createDataFrame([("n", i, v.tolist()) for i, v in enumerate(m)] + [("n", 999, [0.0] * 8)], "ns string, id long, vec array<float>")
    got = vector.batch_search(df, df.where("id < 12").select(F.col("id").alias("query_id"), "vec"), 4, block_rows=40)
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for q in range(12):
        want = sorted(range(300), key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:4]
        assert [r.id for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want


def test_broken_backup_chain(spark, tmp_path):
    rows, path = log(spark, [(i, "PUT", f"k{i}", "v") for i in range(1, 10)]), f"file://{tmp_path}/b"
    backup.write_backup(rows.where("version <= 3"), path, "full")
    backup.write_backup(rows.where("version > 5"), path, "late", base_version=5)
    with pytest.raises(ValueError, match="chain"):
        backup.restore_backups(spark, path)
    backup.write_backup(rows.where("version <= 6"), path, "middle", base_version=3)
    assert backup.restore_backups(spark, path).count() == 9


def test_streams_of_sets_lists_and_expiry(spark, tmp_path):
    run = lambda df, mode, name: df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination()
    sets = "key string, member string, op string, version long"
    spark.createDataFrame([("s", "a", "SADD", 1), ("s", "b", "SADD", 2), ("s", "a", "SREM", 3)], sets).coalesce(1).write.parquet(f"{tmp_path}/sets")
    run(feed.stream_sets(spark.readStream.schema(sets).parquet(f"{tmp_path}/sets")), "update", "sets")
    assert {(r.member, r.present) for r in spark.table("sets").collect()} == {("a", False), ("b", True)}
    lists = "key string, op string, value string, version long"
    spark.createDataFrame([("l", "RPUSH", "a", 1), ("l", "LPUSH", "z", 2), ("l", "RPUSH", "b", 3)], lists).coalesce(1).write.parquet(f"{tmp_path}/lists")
    run(feed.stream_lists(spark.readStream.schema(lists).parquet(f"{tmp_path}/lists")), "append", "lists")
    assert [r.value for r in spark.table("lists").orderBy("seq").collect()] == ["z", "a", "b"]
    rows = [(1, "PUT", "a", "x", 10 * S), (2, "PUT", "b", "x", 12 * S), (3, "DEL", "b", None), (4, "PUT", "c", "x", 900 * S)]
    log(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    log(spark, [(500, "PUT", "d", "x")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(feed.expire_stream(feed.subscribe(spark, f"{tmp_path}/in", files_per_trigger=1)), "append", "expired")
    assert {(r.key, r.expiry_us) for r in spark.table("expired").collect()} == {("a", 10 * S)}


def test_scratch_refuses_a_local_folder_on_a_cluster(spark, monkeypatch):
    from keyloom import queries

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        queries.scratch(Cluster)
    assert queries.scratch(spark).startswith("file://")


def test_commands(spark):
    fields = spark.createDataFrame([("h", "a", "1", "PUT", None, 0)], "key string, field string, value string, op string, expiry_us long, ts_us long")
    lists = spark.createDataFrame([("l", 0, "x"), ("l", 1, "y")], "key string, seq long, value string")
    sets = spark.createDataFrame([("s", "m")], "key string, member string")
    vectors = spark.createDataFrame([("v", 1, [1.0, 0.0]), ("v", 2, [0.0, 1.0])], "ns string, id long, vec array<float>")
    rows = state.latest_per_key(puts(spark, [("a", "1"), ("b", "x=5"), ("c", "x=6")], "").unionByName(puts(spark, [("a", "9")], "other")))
    space = command.Space(rows, 50 * S, 100, fields, lists, sets, vectors)
    ask = lambda line: sorted((tuple(r) for r in command.run(space, line).collect()), key=str)
    assert ask("GET a") == [("", "a", "1")] and ask("NSGET other a") == [("other", "a", "9")] and ask("EXISTS zz") == [(False,)]
    assert [r[-1] for r in ask("MGET a zz b")] == ["1", None, "x=5"] and ask("COUNT") == [(4,)] and ask("TTL a") == [("a", -1)]
    assert [(r[3], r[4], r[5]) for r in ask("PUT k a value of words")] == [("", "k", "a value of words")]
    assert ask("PUTEX k v 10")[0][6] == 60 * S and [r[4] for r in ask("MPUT p 1 q 2")] == ["p", "q"] and ask("NSPUT n k v")[0][3] == "n"
    assert [(r[2], r[4]) for r in ask("DEL a")] == [("DEL", "a")] and ask("NSDEL other a")[0][3] == "other" and len(ask("NSDROP other")) == 1
    assert ask("INCR a 5") == [("", "a", 6)] and ask("DECR a") == [("", "a", 0)] and ask("INCR new") == [("", "new", 1)]
    assert ask("CAS a 1 2")[0][3:] == ("SUCCESS", "2") and ask("SETNX a 1") == [] and ask("VERSION a") == [("", "a", S)]
    assert ask("HGET h a") == [("1",)] and {r[1] for r in ask("HSET h b 2")} == {"a", "b"} and ask("HDEL h a")[0][3] == "DEL" and ask("HLEN h") == [("h", 1)]
    assert ask("LRANGE l 0 -1") == [("l", 0, "x"), ("l", 1, "y")] and ask("LLEN l") == [("l", 2)] and ask("LPOP l") == [("l", 0, "x")]
    assert {r[1:] for r in ask("LPUSH l z")} == {(-1, "z"), (0, "x"), (1, "y")} and ask("RPOP l") == [("l", 1, "y")]
    assert ask("SADD s m n") == [(0, "s", "m", False), (1, "s", "n", True)] and ask("SISMEMBER s m") == [("s", "m", True)] and ask("SREM s m") == []
    assert ask("VSEARCH v 1 0 2")[0][0] == 2 and ask("QUERY - WHERE x > 5") == []
    assert {r[3] for r in ask("IDXCREATE by_x x")} == {"b", "c"} and ask("IDXGET by_x 6") == [("", "c")] and ask("IDXLIST") == [("by_x", "x")] and ask("IDXDROP by_x") == []
    assert {(r[1], r[4]) for r in ask(f"TXN SET:a:2 DEL:b SETIF:c:7:{3 * S}")} == {("COMMITTED", "a"), ("COMMITTED", "b"), ("COMMITTED", "c")}
    assert ask("TXN SETIF:a:2:1") == [(1, "CONFLICT", None, None, None, None)]
    for bad in ("PUT k", "MPUT a", "TXN NO:a", "INCR a x", "IDXCREATE a/b x", "HGET h"):
        with pytest.raises(ValueError):
            command.run(space, bad)


def test_human_bytes(spark):
    n = [0, 1023, 1024, 1536, 1_023_999, 1_024_000, 2**20 - 1, 2**20, 2**30 - 1, 2**40, 5000 * 2**40, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "i int, n long").orderBy("i")
    shown = column(df.select(human_bytes(F.col("n")).alias("key")))
    assert shown == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "999.9 KiB", "1000.0 KiB", "1023.9 KiB", "1.0 MiB", "1023.9 MiB", "1.0 TiB", "4.8 PiB", None]
    capped = column(df.select(human_bytes(F.col("n"), "KiB").alias("key")))
    assert capped[:4] == shown[:4] and capped[6:10] == ["1023.9 KiB", "1024.0 KiB", "1048575.9 KiB", "1073741824.0 KiB"]
