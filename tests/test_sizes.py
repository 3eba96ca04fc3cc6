import os
import random

import pytest
from pyspark.sql import functions as F

from pipewise.operators import sizes
from pipewise.operators.lineage import lineage_edges, unsafe_closure
from pipewise.sources import files, scripts
from pipewise.sources.scratch import new_path

MB = 1024 * 1024


def reach(edges, seeds):
    hops, frontier = {s: 0 for s in seeds}, set(seeds)
    while frontier:
        new = {d for d, s in edges if s in frontier and d not in hops}
        for d in new:
            hops[d] = 1 + min(hops[s] for x, s in edges if x == d and s in hops)
        frontier = new
    return hops


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_on_graphs_with_cycles_and_hubs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    edges = {(rng.choice(names), "n0" if rng.random() < 0.3 else rng.choice(names)) for _ in range(90)}
    seeds = rng.sample(names, 3)
    e = spark.createDataFrame(sorted(edges), "dst string, src string")
    s = spark.createDataFrame([(n,) for n in seeds], "name string")
    got = {r.name: r for r in unsafe_closure(e, s).collect()}
    want = reach(edges, seeds)
    assert {n: r.hops for n, r in got.items()} == want
    for n, r in got.items():
        if r.hops:
            assert (n, r.derived_from) in edges and want[r.derived_from] == r.hops - 1


def test_closure_follows_long_chains(spark):
    e = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(40)], "dst string, src string")
    s = spark.createDataFrame([("n0",)], "name string")
    got = {r.name: r.hops for r in unsafe_closure(e, s).collect()}
    assert got == {f"n{i}": i for i in range(41)}


def test_closure_stays_inside_its_key(spark):
    e = spark.createDataFrame([(1, "b", "a"), (2, "b", "a")], "script_id int, dst string, src string")
    s = spark.createDataFrame([(1, "a")], "script_id int, name string")
    got = {(r.script_id, r.name) for r in unsafe_closure(e, s, ["script_id"]).collect()}
    assert got == {(1, "a"), (1, "b")}


SCRIPT = '''
import os
big = spark.read.parquet("/data/big/")
small = spark.read.parquet("/data/small")
lost = spark.read.parquet('/data/lost')
a = spark.sql("""
  SELECT * FROM big JOIN wh.dim""")
a.createOrReplaceTempView("V_A")
b = spark.sql(f"""SELECT * FROM v_a""")
b.createOrReplaceTempView("v_b")
c = spark.sql("""SELECT * FROM v_b""")
s = spark.sql("""SELECT * FROM small""")
t = spark.sql("""SELECT * FROM huge""")
# x = spark.sql("""SELECT * FROM big""")
spark.table("wh.huge")
'''


def test_unsafe_spreads_from_paths_to_views_of_views(spark):
    texts = spark.createDataFrame([(1, SCRIPT), (2, "print(1)")], "script_id int, source string")
    tables = spark.createDataFrame(
        [("wh.dim", 10 * MB), ("wh.huge", 900 * MB), ("wh.other", 1)], "name string, size_bytes bigint"
    )
    paths = spark.createDataFrame(
        [("/data/big/", 200 * MB), ("/data/small", 200 * MB - 1), ("/data/lost", -1)],
        "path string, size_bytes bigint",
    )
    kinds = {(r.kind, r.dst, r.src) for r in lineage_edges(texts).collect()}
    assert ("sql", "a", "wh.dim") in kinds and ("view", "v_a", "a") in kinds
    assert not any(d == "x" for _, d, _ in kinds)
    got = sizes.script_input_sizes(texts, tables, paths)
    rows = {r.name: (r.broadcast_safe, r.source_type, r.derived_from, r.size_mb) for r in got.collect()}
    assert rows == {
        "wh.dim": (True, "delta", None, 10.0),
        "wh.huge": (False, "delta", None, 900.0),
        "big (/data/big/)": (False, "parquet", None, 200.0),
        "small (/data/small)": (True, "parquet", None, 200.0),
        "big": (False, "parquet_var", "big (/data/big/)", 200.0),
        "lost": (False, "derived_view", "parquet lost (size not estimated → conservative)", -1.0),
        "a": (False, "derived_view", "big", -1.0),
        "v_a": (False, "derived_view", "a", -1.0),
        "b": (False, "derived_view", "v_a", -1.0),
        "v_b": (False, "derived_view", "b", -1.0),
        "c": (False, "derived_view", "v_b", -1.0),
        "t": (False, "derived_view", "huge", -1.0),
    }
    context = {r.script_id: r.size_context for r in sizes.size_context(texts, got).collect()}
    lines = context[1].split("\n")
    assert lines[0] == "TABLE SIZES ON DISK (broadcast threshold: 200 MB):"
    assert lines[1] == "  wh.huge: 900.0 MB  — ✗ NO broadcast (900 MB > threshold)"
    assert lines[5] == "  wh.dim: 10.0 MB  — ✓ broadcast OK"
    assert lines[6].endswith("size not estimable)  [derived from: big]")
    assert context[2].startswith("(sizes could not be estimated")


def test_dir_sizes(spark, tmp_path):
    root = tmp_path / "a"
    (root / "x" / "y").mkdir(parents=True)
    (root / "one").write_bytes(b"1" * 10)
    (root / "x" / "two").write_bytes(b"2" * 20)
    (root / "x" / "y" / "three %41").write_bytes(b"3" * 40)
    asked = [str(root), str(root / "x"), str(root) + "/x/y/", str(root / "one"), str(root / "none")]
    got = {r.root: r.size_bytes for r in files.path_sizes(spark, asked).collect()}
    assert got == dict(zip(asked, [70, 60, 40, 10, -1]))
    assert files.path_sizes(spark, [str(root / "none")]).first().size_bytes == -1


def test_odd_names_and_file_systems(spark, tmp_path):
    root = tmp_path / "a+b"
    (root / "c%zz" / "a+b").mkdir(parents=True)
    (root / "100%zz.bin").write_bytes(b"1" * 100)
    (root / "c%zz" / "a+b" / "x y").write_bytes(b"2" * 7)
    asked = [str(root), f"file:{root}/", f"file://{root}/c%zz", f"hdfs://h:1{root}"]
    got = {r.root: r.size_bytes for r in files.path_sizes(spark, asked[:3]).collect()}
    assert got == dict(zip(asked, [107, 107, 7]))
    listed = spark.createDataFrame([(f"hdfs://h:1{root}/x", 5)], "path string, length bigint")
    roots = spark.createDataFrame([(r,) for r in asked], "root string")
    got = {r.root: r.size_bytes for r in files.dir_sizes(listed, roots).collect()}
    assert got == dict(zip(asked, [5, -1, -1, 5]))


def test_table_sizes(spark, sf):
    place = f"{sf}/nation.parquet"
    tables = spark.createDataFrame([("WH.nation", place)], "name string, root string")
    got = files.table_sizes(files.list_files(spark, [place]), tables).first()
    assert (got.name, got.size_bytes) == ("wh.nation", os.path.getsize(place))


def test_scripts_are_read_whole(spark):
    path = new_path(spark, "texts")
    spark.createDataFrame([("a\n\nb",)], "value string").write.text(path + "/x%20y")
    got = scripts.read_scripts(spark, path).where(F.length("source") > 0).collect()
    assert [r.source for r in got] == ["a\n\nb\n"]
    assert got[0].path.startswith("/x%20y/part-")


def test_script_paths_begin_after_the_root(spark, tmp_path):
    root = tmp_path / "r+1"
    inner = root / "jobs" / str(root).strip("/") / "a+b%41"
    inner.mkdir(parents=True)
    (inner / "z.py").write_text("x")
    for asked in (str(root), f"file:{root}/", f"file://{root}"):
        got = [r.path for r in scripts.read_scripts(spark, asked).collect()]
        assert got == [f"/jobs{root}/a+b%41/z.py"]


def test_missing_roots_are_listed_with_the_others(spark, tmp_path, monkeypatch):
    for name in ("plain", "odd {a,b}*[x]?", "c^d"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f").write_bytes(b"1" * 9)
    asked = [f"{tmp_path}/{n}" for n in ("plain", "odd {a,b}*[x]?", "c^d", "none", "odd a")]
    asked += [f"file:{tmp_path}/plain", f"file:{tmp_path}/none"]
    got = {r.root: r.size_bytes for r in files.path_sizes(spark, asked).collect()}
    assert got == dict(zip(asked, [9, 9, 9, -1, -1, 9, -1]))


def test_one_path_on_two_file_systems(spark):
    rows = [("hdfs://h:1/d/x", 5), ("s3a://b/d/x", 7), ("/d/y", 11)]
    listed = spark.createDataFrame(rows, "path string, length bigint")
    asked = ["/d", "hdfs://h:1/d", "s3a://b/d", "s3a://b/e"]
    roots = spark.createDataFrame([(r,) for r in asked], "root string")
    got = {r.root: r.size_bytes for r in files.dir_sizes(listed, roots, "hdfs://h:1").collect()}
    assert got == dict(zip(asked, [16, 16, 7, -1]))


def test_sizes_of_named_tables(spark, tmp_path):
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS named LOCATION '{tmp_path}/named'")
    rows = spark.range(1000).selectExpr("id", "id % 2 AS part")
    rows.where("part = 0").write.partitionBy("part").saveAsTable("named.parted")
    rows.where("part = 1").drop("part").write.parquet(f"{tmp_path}/elsewhere")
    spark.sql(f"ALTER TABLE named.parted ADD PARTITION (part = 1) LOCATION '{tmp_path}/elsewhere'")
    rows.limit(0).write.saveAsTable("named.empty")
    spark.sql("CREATE VIEW named.seen AS SELECT 1 AS one")
    names = ["named.parted", "NAMED.Parted", "named.empty", "named.seen", "named.none", "not a name"]
    sizes_of = files.named_table_sizes(spark, names)
    got = {r.name: r.size_bytes for r in sizes_of.collect()}
    inside = sum(p.stat().st_size for p in (tmp_path / "named" / "parted").rglob("*.parquet"))
    outside = sum(p.stat().st_size for p in (tmp_path / "elsewhere").glob("*.parquet"))
    assert inside and outside
    assert got == {
        "named.parted": inside + outside, "named.empty": 0, "named.seen": -1, "named.none": -1, "not a name": -1,
    }
    assert files.named_table_sizes(spark, []).count() == 0
    spark.sql("DROP SCHEMA named CASCADE")


def test_long_chains_close_in_few_rounds(spark, monkeypatch):
    from pipewise.operators import lineage

    rounds = []

    def counted(df, name):
        rounds.append(name)
        return materialize(df, name)

    materialize = lineage.materialize
    monkeypatch.setattr(lineage, "materialize", counted)
    edges = spark.range(10_000).selectExpr("concat('n', id + 1) AS dst", "concat('n', id) AS src")
    cycle = spark.createDataFrame([("n3", "n9000"), ("x", "x"), ("y", "n0"), ("y", "a")], "dst string, src string")
    seeds = spark.createDataFrame([("n0",), ("z",), ("x",)], "name string")
    got = {r.name: r for r in unsafe_closure(edges.union(cycle), seeds).collect()}
    assert len([n for n in rounds if n.startswith("steps-")]) < 20
    assert len(got) == 10_004 and got["n10000"].hops == 10_000 and got["n10000"].derived_from == "n9999"
    assert (got["y"].hops, got["y"].derived_from, got["x"].hops) == (1, "n0", 0)


def test_closure_equals_breadth_first_search(spark):
    import random

    rng = random.Random(6)
    for n, m in ((12, 20), (40, 60), (60, 45), (30, 200)):
        rows = [(rng.randrange(2), rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        starts = [(k, rng.randrange(n)) for k in (0, 1) for _ in range(2)]
        want = {}
        for key in (0, 1):
            hops = {name: 0 for k, name in starts if k == key}
            last, hop = set(hops), 0
            while last:
                hop += 1
                last = {d for k, d, s in rows if k == key and s in last} - set(hops)
                hops.update(dict.fromkeys(last, hop))
            for name, h in hops.items():
                before = [s for k, d, s in rows if k == key and d == name and hops.get(s) == h - 1]
                want[key, name] = (min(before, key=str) if h else None, h)
        e = spark.createDataFrame([(k, str(d), str(s)) for k, d, s in rows], "key int, dst string, src string")
        s = spark.createDataFrame([(k, str(x)) for k, x in starts], "key int, name string")
        got = unsafe_closure(e, s, ["key"]).collect()
        assert {(r.key, int(r.name)): (None if r.derived_from is None else int(r.derived_from), r.hops) for r in got} == want
        assert len(got) == len(want)
