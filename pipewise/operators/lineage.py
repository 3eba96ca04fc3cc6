"""Lineage inside scripts, and how "not safe to broadcast" spreads along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewise.functions import text
from pipewise.functions.fixed_values import PARQUET_VAR, SQL_SOURCE, SQL_VAR, TEMP_VIEW
from pipewise.sources.scratch import materialize


def _pairs(code: Column, folded: Column, word: str, pattern: str) -> Column:
    """Both groups of every match, as ``array<struct<a, b>>``.

    The text is searched once for whole matches; the groups come out of those.
    """
    matches = F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
    groups = F.transform(
        matches,
        lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("a"), F.regexp_extract(m, pattern, 2).alias("b")
        ),
    )
    return F.when(folded.contains(word), groups).otherwise(
        F.array().cast("array<struct<a:string,b:string>>")
    )


def _edge(kind: str, dst: Column, src: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), dst.alias("dst"), src.alias("src"))


def lineage_edges(scripts: DataFrame) -> DataFrame:
    """Edges ``dst <- src`` found in each script, names in lower case.

    ``parquet``: a variable reads a path (its case is kept). ``sql``: a
    variable is a query over names, whole dotted names. ``view``: a temp view
    is made from a variable.
    """
    folded, code = F.col("_folded"), F.col("_code")
    hit = (
        folded.contains(".parquet")
        | folded.contains("spark.sql")
        | folded.contains("createorreplacetempview")
    )
    prepared = scripts.withColumn("_folded", text.fold(F.col("source"))).withColumn(
        "_code", F.when(hit, text.strip_comments_and_imports(F.col("source"))).otherwise("")
    )
    parquet = F.transform(
        _pairs(code, folded, ".parquet", f"(?iuU){PARQUET_VAR}"),
        lambda p: _edge("parquet", F.lower(p["a"]), p["b"]),
    )
    sql = F.flatten(
        F.transform(
            _pairs(code, folded, "spark.sql", f"(?siuU){SQL_VAR}"),
            lambda p: F.transform(
                F.regexp_extract_all(p["b"], F.lit(f"(?iuU){SQL_SOURCE}"), F.lit(1)),
                lambda name: _edge("sql", F.lower(p["a"]), F.lower(name)),
            ),
        )
    )
    view = F.transform(
        _pairs(code, folded, "createorreplacetempview", f"(?iuU){TEMP_VIEW}"),
        lambda p: _edge("view", F.lower(p["b"]), F.lower(p["a"])),
    )
    # Outer: for a plain explode Spark would scan the text twice, see match_changes.
    found = F.array_distinct(F.concat(parquet, sql, view))
    return (
        prepared.select("script_id", F.explode_outer(found).alias("e"))
        .select("script_id", "e.*")
        .where(F.col("dst").isNotNull())
    )


def lookup_names(key: Column) -> Column:
    """Names an input goes by in code: up to ``(``, and the last dotted part."""
    simple = F.lower(text.trim_all(F.split_part(key, F.lit("("), F.lit(1))))
    last = F.element_at(F.split(simple, r"\."), -1)
    return F.array_distinct(F.array(simple, last))


def closure_in_scripts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """As ``unsafe_closure`` with the key script_id, for lineage inside scripts.

    A script's edges and seeds come as arrays, bounded by its own text, and the
    closure is worked out within its row: no loop, no scratch table, one
    shuffle of either side.
    """
    reach = "struct<name:string,derived_from:string,hops:int>"
    own = edges.groupBy("script_id").agg(F.collect_set(F.struct("dst", "src")).alias("edges"))
    found = seeds.groupBy("script_id").agg(F.collect_set("name").alias("seeds"))
    none = F.lit(None).cast("string")

    def step(state: Column, hop: Column) -> Column:
        known = F.transform(state["all"], lambda r: r["name"])
        met = F.filter(
            F.col("edges"),
            lambda e: F.array_contains(state["last"], e["src"])
            & ~F.array_contains(known, e["dst"]),
        )

        def extended(met: Column) -> Column:
            names = F.array_distinct(F.transform(met, lambda e: e["dst"]))
            new = F.transform(
                names,
                lambda n: F.struct(
                    n,
                    F.array_min(
                        F.transform(F.filter(met, lambda e: e["dst"] == n), lambda e: e["src"])
                    ),
                    hop,
                ).cast(reach),
            )
            return F.struct(names.alias("last"), F.concat(state["all"], new).alias("all"))

        return F.when(F.size(state["last"]) == 0, state).otherwise(text.let(met, extended))

    start = F.struct(
        F.col("seeds").alias("last"),
        F.transform("seeds", lambda n: F.struct(n, none, F.lit(0)).cast(reach)).alias("all"),
    )
    # a longest path has as many steps as there are names to reach
    steps = F.sequence(F.lit(1), F.size("edges") + 1)
    edges_or_none = F.coalesce("edges", F.array().cast("array<struct<dst:string,src:string>>"))
    joined = found.join(own, "script_id", "left").withColumn("edges", edges_or_none)
    spread = F.aggregate(steps, start, step, lambda state: state["all"])
    return joined.select("script_id", F.explode(spread).alias("r")).select("script_id", "r.*")


def unsafe_closure(edges: DataFrame, seeds: DataFrame, keys: list[str] | None = None,
                   written: bool = False) -> DataFrame:
    """Everything that is derived, directly or not, from an unsafe input.

    ``edges`` has the keys, dst and src; ``seeds`` has the keys and name. Gives
    the keys, name, derived_from (NULL for a seed; the smallest of the sources
    that made it unsafe first) and hops, the fewest there are.

    Reach doubles: round k has steps of 2^k edges, found from two steps of half
    the length, and takes every name less than 2^k hops away on by one of them.
    A chain of n names takes log2(n) rounds. A step onto a name that is known is
    of no use any more, neither now nor as part of a longer one, and is dropped,
    so cycles end by themselves; the loop ends at the first round that finds
    nothing new. Eager: the edges (unless they are ``written`` already) and every
    round are written to the scratch folder, so the plan does not grow and a lost
    executor costs one round.
    """
    keys = keys or []
    node = [*keys, "name"]
    edges = edges.select(*keys, "dst", "src")
    if not written:
        edges = materialize(edges.distinct(), "edges")
    known = materialize(seeds.select(*node).distinct().withColumn("hops", F.lit(0)), "unsafe-0")
    steps, length = edges.where("dst <> src"), 1
    while True:
        useful = steps.join(known.select(*keys, F.col("name").alias("dst")), [*keys, "dst"], "left_anti")
        useful = materialize(useful, f"steps-{length}")
        reached = (
            useful.join(known.withColumnRenamed("name", "src"), [*keys, "src"])
            .groupBy(*keys, F.col("dst").alias("name"))
            .agg((F.min("hops") + length).cast("int").alias("hops"))
        )
        reached = materialize(reached, f"unsafe-{length}")
        if reached.isEmpty():
            break
        known = materialize(known.unionByName(reached), f"unsafe-to-{2 * length}")
        on = useful.select(*keys, F.col("src").alias("middle"), F.col("dst").alias("end"))
        longer = useful.withColumnRenamed("dst", "middle").join(on, [*keys, "middle"])
        steps = longer.select(*keys, F.col("end").alias("dst"), "src").where("dst <> src").distinct()
        length *= 2
    before = known.select(*keys, F.col("name").alias("src"), (F.col("hops") + 1).alias("hops"))
    sources = (
        edges.join(before, [*keys, "src"])
        .join(known.withColumnRenamed("name", "dst"), [*keys, "dst", "hops"])
        .groupBy(*keys, F.col("dst").alias("name"), "hops")
        .agg(F.min("src").alias("derived_from"))
    )
    return known.join(sources, [*node, "hops"], "left").select(*node, "derived_from", "hops")
