"""Consolidation, term bitmaps, key chunks, hierarchies, orphans and skew-safe lookups against brute force."""

import datetime as dt
import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linkloom import session
from linkloom.operators import compaction, hierarchy, key_chunks, orphans, term_bitmaps
from linkloom.session import lookup_join, whole_rows_once
from linkloom.sources.parquet_blocks import read_footer


def _write(path, rows, schema, **kw):
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), path, **kw)


SCHEMA = pa.schema([("id", pa.int64()), ("name", pa.string()), ("tags", pa.list_(pa.string())), ("at", pa.timestamp("us")), ("x", pa.float64())])


def _row(i):
    return {"id": i, "name": None if i % 7 == 0 else f"näme {i % 5}", "tags": [] if i % 3 else ["a", f"t{i}"], "at": dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "x": None if i % 4 == 0 else i / 3}


@pytest.mark.parametrize("codec", ["snappy", "zstd", "gzip", "none"])
def test_blocks_are_copied_without_loss(spark, tmp_path, codec):
    src = tmp_path / "src"
    src.mkdir()
    at = 0
    for k, n in enumerate((1, 1, 50, 0, 7, 1)):
        _write(src / f"f{k}.parquet", [_row(at + i) for i in range(n)], SCHEMA, compression=codec, row_group_size=20, write_page_index=True, use_dictionary=k % 2 == 0)
        at += n
    done = compaction.consolidate(spark, [f"file://{p}" for p in src.iterdir()], f"file://{tmp_path}/out").collect()
    assert len(done) == 1 and done[0]["files"] == 6 and done[0]["rows"] == at
    back = pq.read_table(tmp_path / "out").sort_by("id").to_pylist()
    assert back == [_row(i) for i in range(at)]
    assert {r["id"]: r["name"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {i: _row(i)["name"] for i in range(at)}
    blocks = sum(pq.ParquetFile(p).num_row_groups for p in src.iterdir())
    assert pq.ParquetFile(next((tmp_path / "out").glob("*.parquet"))).num_row_groups == blocks


def test_other_schemas_and_sizes_get_files_of_their_own(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k in range(6):
        schema = pa.schema([("id", pa.int64())]) if k % 2 else pa.schema([("id", pa.string())])
        _write(src / f"f{k}.parquet", [{"id": k if k % 2 else str(k)}], schema)
    size = max(p.stat().st_size for p in src.iterdir())
    done = compaction.consolidate(spark, [str(p) for p in src.iterdir()], str(tmp_path / "out"), target_bytes=2 * size).collect()
    assert sorted(d["files"] for d in done) == [1, 1, 2, 2]


def test_damaged_file_is_refused(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really")
    with pytest.raises(Exception, match="Parquet"):
        compaction.consolidate(spark, [str(tmp_path / "bad.parquet")], str(tmp_path / "out")).collect()


def test_no_files(spark, tmp_path):
    assert compaction.consolidate(spark, [], str(tmp_path / "out")).count() == 0


def test_footer_round_trip(tmp_path):
    from pyarrow import fs

    from linkloom.sources import parquet_blocks as b

    _write(tmp_path / "a.parquet", [_row(i) for i in range(9)], SCHEMA)
    data = (tmp_path / "a.parquet").read_bytes()
    footer = read_footer(fs.LocalFileSystem(), str(tmp_path / "a.parquet"))
    out = bytearray()
    b._write_struct(footer.fields, out)
    assert bytes(out) == data[-8 - len(out) : -8]


def test_delivered_once(spark):
    rows = [(1, "A b", "x  y", 0), (2, "a_b#c", "x y ", 1), (3, "A b", "x z", 2), (4, None, "x y", 3), (5, None, "x y", 4), (6, "A b", None, 5), (7, "A b", None, 6), (1, "A b", "x  y", 0), (8, "", "", 7), (9, "é", "é", 8), (10, "É", "é", 9)]
    df = spark.createDataFrame(rows, "file_id long, title string, text string, copy_of int")
    got = {r["file_id"]: r["copy_of"] for r in compaction.delivered_once(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9}
    assert compaction.delivered_once(df.limit(0)).count() == 0


def test_term_frequencies_match_sets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None, "", "hot"] + ["hot"] * 10), rng.choice([None, *range(-5, 300)]), rng.choice([None, 1, 2, 5])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "word string, doc long, n long")
    docs, uses = defaultdict(set), defaultdict(int)
    for w, d, n in rows:
        uses[w] += n or 0
        docs[w] |= {d} - {None}
    post = term_bitmaps.term_postings(df, "word", "doc", "n")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_bitmaps.term_frequencies(post).collect()}
    assert got == {w: (uses[w], len(docs[w])) for w in docs if w is not None}
    assert term_bitmaps.record_total(post) == len(set().union(*docs.values()))


def test_containers_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    cases = [np.zeros(0, dtype=np.int64), np.array([0]), np.array([65535]), np.arange(65536), np.arange(0, 65536, 2), np.arange(100, 9000), np.array([1, 2, 3, 4, 9, 10, 11, 12, 13, 65535])]
    cases += [np.unique(rng.integers(0, 65536, n)) for n in (2, 5, 300, 4096, 5000, 60_000)]
    for places in cases:
        kind, raw = term_bitmaps.encode(places)
        assert term_bitmaps.decode(kind, raw).tolist() == places.tolist()
        assert len(raw) <= min(2 * len(places), 8192)


def test_postings_of_many_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(term_bitmaps, "OPEN_BLOCKS", 2)
    rows = spark.range(400_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 997).cast("string"))).alias("w"), (F.xxhash64("id") % 3_000_000).alias("r"))
    want = {r["w"]: (r["o"], r["n"]) for r in rows.groupBy("w").agg(F.count(F.lit(1)).alias("o"), F.countDistinct("r").alias("n")).collect()}
    post = term_bitmaps.term_postings(rows, "w", "r")
    assert post.groupBy("term", "block").count().where("count > 1").count() == 0
    assert {r["term"]: (r["occurrences"], r["records"]) for r in term_bitmaps.term_frequencies(post).collect()} == want
    assert term_bitmaps.record_total(post) == rows.select("r").distinct().count()


def test_marks_and_repeated_rows(spark):
    rows = [("rare", i, 1) for i in (1, 2)] + [("mid", i, 1) for i in (1, 2, 3)] + [("all", i, 1) for i in range(100)] + [("all", 1, 1)] * 5 + [("none", None, 2)]
    df = spark.createDataFrame(rows, "term string, records long, occurrences long")  # names that clash with the result's
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_bitmaps.marked_terms(df, "term", "records", "occurrences").collect()}
    assert got == {"rare": (2, 2, "rare"), "mid": (3, 3, None), "all": (100, 100, "common"), "none": (2, 0, "rare")}
    assert term_bitmaps.marked_terms(df.limit(0), "term", "records").count() == 0


def test_numbers_are_exact_and_cut_hot_keys(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 7}", i) for i in range(100)], "k string, v long")
    got = key_chunks.number_rows(df, ["k", "v"], 5).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(600))
    assert [(r["k"], r["v"]) for r in got] == sorted((r["k"], r["v"]) for r in got)
    assert key_chunks.number_rows(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_strongest_value(spark, chunk):
    rng = random.Random(5)
    rows = [(rng.choice(["h"] * 5 + list("abc") + [None]), rng.choice(["x", "y", "é", "z", None]), rng.choice([None, 1, 2, 3])) for _ in range(400)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "k string, v string, n long, total int")
    sums = defaultdict(lambda: defaultdict(int))
    for k, v, n in rows:
        if v is not None:
            sums[k][v] += n or 0
    want = {k: min(((-t, v) for v, t in s.items())) for k, s in sums.items()}
    got = {r["k"]: (-r["total"], r["winner"]) for r in key_chunks.strongest_value(df, ["k"], "v", "n", chunk_rows=chunk).collect()}
    assert got == want
    assert key_chunks.strongest_value(df.limit(0), ["k"], "v", "n").count() == 0


def _walk(links):
    out = {}
    for n in links:
        path, x = [], n
        while x in links and x not in path:
            path.append(x)
            x = links[x]
        out[n] = (None, None) if x in links else (x, len(path))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_roots_paths_and_loops(spark, seed):
    rng = random.Random(seed)  # local forests of few links are cut in test_small_forests
    n = 300
    links = {str(i): str(rng.randrange(n)) for i in range(n) if rng.random() < 0.93}
    links |= {f"c{i}": f"c{i + 1}" for i in range(200)}
    df = spark.createDataFrame([*links.items(), (None, "x"), ("y", None)], "source string, target string").repartition(7)
    got = {r["node"]: r for r in hierarchy.resolve_roots(df, "source", "target", with_paths=True).collect()}
    want = _walk(links)
    assert {k: (r["root"], r["depth"]) for k, r in got.items()} == want
    for k, r in got.items():
        if r["root"] is not None:
            assert r["path"][0] == k and len(r["path"]) == r["depth"]
            assert all(links[a] == b for a, b in zip(r["path"], [*r["path"][1:], r["root"]]))
    loops = {r["node"]: r["loop"] for r in hierarchy.loop_members(df.where("source is not null and target is not null"), spark.createDataFrame([(k,) for k, v in want.items() if v[0] is None] or [("-",)], "node string"), "source", "target").collect()}
    on = {}
    for k in links:
        path, x = [], links[k]
        while x in links and x not in path and x != k:
            path.append(x)
            x = links[x]
        if x == k:
            on[k] = min([k, *path])
    assert loops == on


def test_small_forests():
    import pandas as pd

    links = {str(i): str(i + 1) for i in range(50)} | {"x": "y", "y": "x"}
    forest = hierarchy.Forest()
    for a, b in links.items():
        forest.add(a, b, 1, [a])
    rows = pd.concat(forest.rows(True))
    whole = rows[rows["loop"].isna()]
    assert whole[whole["node"] == "0"].iloc[0].tolist()[:3] == ["0", "50", 50]
    assert whole[whole["node"] == "0"].iloc[0]["path"] == [str(i) for i in range(50)]
    assert set(whole[whole["looped"]]["node"]) == {"x", "y"}
    assert {(r["node"], r["loop"]) for _, r in rows[rows["loop"].notna()].iterrows()} == {("x", "x"), ("y", "x")}


def test_weights_are_distances():
    rng = random.Random(5)
    links = {str(i): str(rng.randrange(i)) for i in range(1, 400)}
    order = list(links.items())
    rng.shuffle(order)
    forest = hierarchy.Forest()
    for a, b in order:
        forest.add(a, b, 1)
    for n, (root, depth) in _walk(links).items():
        (rep, at), (_, top) = forest.find(forest.number[n]), forest.find(forest.number[root])
        assert at - top == depth and forest.size[rep] == 400


@pytest.mark.parametrize("most", [7, 40, 1000])
def test_forests_merge_over_levels(spark, most):
    rng = random.Random(most)
    links = {f"c{i}": f"c{i + 1}" for i in range(300)} | {f"o{i}": f"o{(i + 1) % 90}" for i in range(90)} | {f"i{i}": f"o{i}" for i in range(30)}
    links |= {f"h{i}": rng.choice(["c7", "c250", "hub"]) for i in range(200)} | {"s": "s", "t": "s"}
    df = spark.createDataFrame(list(links.items()), "source string, target string").repartition(5)
    full = hierarchy.resolve_roots(df, "source", "target", True, most)
    got = {r["node"]: (r["root"], r["depth"]) for r in full.collect()}
    assert got == _walk(links)
    for r in full.where("not looped").collect():
        assert r["path"][0] == r["node"] and len(r["path"]) == r["depth"] and all(links[a] == b for a, b in zip(r["path"], [*r["path"][1:], r["root"]]))
    loops = {r["node"]: r["loop"] for r in hierarchy.loop_members(df, full.where("looped"), "source", "target", most).collect()}
    assert loops == {f"o{i}": "o0" for i in range(90)} | {"s": "s"}
    assert {(r["ancestor"], r["node"]) for r in hierarchy.descendants(full).where("ancestor = 'c290'").collect()} >= {("c290", "c0"), ("c290", "c289")}


def test_hierarchy_edge_cases(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "d"), ("c", "d"), ("e", "z"), ("e", "f")], "source string, target string")
    got = {r["node"]: (r["root"], r["looped"]) for r in hierarchy.resolve_roots(df, "source", "target").collect()}
    assert got == {"a": (None, True), "b": (None, True), "c": ("d", False), "e": ("f", False)}
    assert hierarchy.resolve_roots(df.limit(0), "source", "target").count() == 0
    full = hierarchy.resolve_roots(df, "source", "target", with_paths=True)
    assert {(r["ancestor"], r["node"], r["distance"]) for r in hierarchy.descendants(full).collect()} == {("d", "c", 1), ("f", "e", 1)}


@pytest.mark.parametrize("limit", [0, 16 << 20])
def test_orphans_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(session.fits_broadcast, "__defaults__", (limit,))
    rng = random.Random(2)
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    parents = []
    for k in range(40):
        for _ in range(rng.randrange(4)):
            a = rng.randrange(200)
            parents.append((k, day(a), day(a + rng.randrange(60)) if rng.random() < 0.6 else None, "x"))
    parents += parents[:5] + [(None, day(3), None, "x"), (99, None, None, "x")]
    refs = [(i, rng.choice([None, 77, 99, *range(45)]) if i % 3 else 7, day(rng.randrange(250)), "keep") for i in range(600)]
    p = spark.createDataFrame(parents, "key long, since timestamp_ntz, deleted timestamp_ntz, status string")
    r = spark.createDataFrame(refs, "row long, key long, at timestamp_ntz, until string")
    want = {}
    for row, k, t, _ in refs:
        if k is None:
            continue
        own = [x for x in parents if x[0] == k and x[1] is not None]
        if any(x[1] <= t and (x[2] is None or x[2] > t) for x in own):
            continue
        want[row] = "missing" if not any(x[0] == k for x in parents) else "deleted" if any(x[1] <= t for x in own) else "late"
    got = orphans.find_orphans(r, p, "key", "at", "key", "since", "deleted")
    assert {x["row"]: x["status"] for x in got.collect()} == want
    assert set(got.columns) == {"row", "key", "at", "until", "status"}
    assert {x["status"] for x in orphans.find_orphans(r, p.limit(0), "key", "at", "key", "since", "deleted").collect()} == {"missing"}
    assert orphans.find_orphans(r.limit(0), p, "key", "at", "key", "since", "deleted").count() == 0
    assert orphans.orphan_report(got, "refs", "at").agg(F.sum("references")).first()[0] == len(want)


@pytest.mark.parametrize("size, most, shards", [(8 << 20, 32, 1), (1024, 32, 12), (256, 4, 4)])
def test_sharded_filters(spark, size, most, shards):
    keys = spark.range(0, 20_000, 2).select(F.xxhash64("id").alias("h"))
    made = session.materialize(orphans.bloom_shards(keys, F.col("h"), 10_000, shard_bytes=size, max_shards=most), "filters")
    assert made.count() == shards
    tested = spark.range(20_000).select("id", orphans.might_contain(made, F.xxhash64("id")).alias("may"))
    assert tested.where("id % 2 = 0 and not may").count() == 0
    wrong = tested.where("id % 2 = 1 and may").count()
    assert wrong < (300 if shards != 4 else 10_000)
    none = session.materialize(orphans.bloom_shards(keys.limit(0), F.col("h"), 0), "filters")
    assert spark.range(5).where(orphans.might_contain(none, F.xxhash64("id"))).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_equals_join(spark, monkeypatch, how):
    monkeypatch.setattr(session.fits_broadcast, "__defaults__", (0,))
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 20_000, 2).select((F.col("id") + 1).alias("k"), (F.col("id") * 2).alias("v"))
    a = lookup_join(left, right, ["k"], how)
    b = left.join(right, ["k"], how)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_without_adaptive_plans(spark, monkeypatch, how):
    monkeypatch.setattr(session.fits_broadcast, "__defaults__", (0,))
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 20_000, 2).select((F.col("id") + 1).alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a = lookup_join(left, right, ["k"], how)
        assert "__salt" in a._jdf.queryExecution().toString()
        assert a.exceptAll(left.join(right, ["k"], how).select(a.columns)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_broadcast_sizes_are_measured(spark):
    long = session.materialize(spark.range(20_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.xxhash64(i, "id")).alias("a")), "long")
    assert not session.fits_broadcast(long)
    assert session.fits_broadcast(session.materialize(long.select("id"), "short"))
    assert session.fits_broadcast(session.materialize(long.limit(0), "none"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    made = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app-x"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(made)


def test_whole_rows_once_with_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (1, {"a": 2}), (None, None), (None, None)], "i int, m map<string,int>")
    assert whole_rows_once(df).count() == 3
