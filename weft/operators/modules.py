"""Module graph of a corpus (C11 ``pattern_recognition``): who imports whom,
import cycles as strongly connected components, and transitive dependents.

Graphs are edge tables. Each round of an iteration is a join and an aggregate
whose result is written under the shared folder and read again, so plans stay
short and a lost executor costs one round. No closure of the graph is ever
built: components need one value per module and direction, dependents are
followed for the modules asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.tabular import written


def module_edges(imports: DataFrame, modules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct (src, dst) among the corpus' own modules. ``imports`` as of
    ``import_statements``; ``modules``: (key, package, module).

    A relative import starts from the importing module's package, one package
    up per further dot. An imported name is a module of that name if the corpus
    has one, else the module it comes from is meant."""
    at = imports.join(modules.select(key, "package", F.col("module").alias("src")), key)
    parts = F.split("package", "[.]")
    up = (F.size(parts) - (F.col("level") - 1)).cast("int")
    base = F.when(F.col("level") == 0, F.lit("")).when(up > 0, F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(1))), "."))

    def dotted(a: Column, b: Column) -> Column:
        return F.concat(a, F.when((a != "") & (b != ""), ".").otherwise(""), b)

    origin = dotted(base, F.col("module"))
    at = at.withColumn("origin", origin).where(F.col("origin").isNotNull())
    both = F.filter(F.array(F.struct(F.when(F.col("name").isNotNull(), dotted(F.col("origin"), F.col("name"))).alias("dst"), F.lit(1).alias("own")),
                            F.struct(F.col("origin").alias("dst"), F.lit(0).alias("own"))), lambda c: c["dst"].isNotNull())
    each = at.select(key, "statement", "item", "src", F.explode(both).alias("c")).select(key, "statement", "item", "src", "c.dst", "c.own")
    known = each.join(modules.select(F.col("module").alias("dst")).distinct(), "dst")
    meant = known.groupBy(key, "statement", "item", "src").agg(F.max_by("dst", "own").alias("dst"))
    return meant.where("src <> dst").select("src", "dst").distinct()


def _settled(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Per vertex (v, up, down): the largest vertex that reaches it and the largest it reaches.
    After the first step only vertices that have just learned something pass it on."""
    state, none = state.withColumn("fresh", F.lit(True)), F.lit(None).cast("long")
    while True:
        news = state.where("fresh")
        told = edges.join(news.select(F.col("v").alias("src"), "up"), "src").select(F.col("dst").alias("v"), "up", none.alias("down"), none.alias("u"), none.alias("d"))
        heard = edges.join(news.select(F.col("v").alias("dst"), "down"), "dst").select(F.col("src").alias("v"), none.alias("up"), "down", none.alias("u"), none.alias("d"))
        state = state.select("v", "up", "down", F.col("up").alias("u"), F.col("down").alias("d")).unionByName(told).unionByName(heard) \
                     .groupBy("v").agg(*[F.max(c).alias(c) for c in ("up", "down", "u", "d")]) \
                     .select("v", "up", "down", F.expr("up <> u OR down <> d").alias("fresh"))
        state = written(state, "module-reach")  # one step a table: joined twice, an unwritten one would run twice
        if state.where("fresh").isEmpty():
            return state


def import_cycles(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Strongly connected components: (module, component, members), named by the
    smallest member; a module on no cycle is a component of its own.

    Modules get numbers, so that the rounds carry these and no names. In each
    round all vertices learn the largest number that reaches them and the
    largest they reach. Where both are the same vertex, it lies on a common
    cycle with it, and these vertices form a whole component. A component's
    members always learn the same two numbers, so edges between vertices that
    learned different ones are cut; all that is left goes on at once, but for
    vertices without an edge, which are components."""
    names = written(modules.select("module").where("module IS NOT NULL").distinct().withColumn("v", F.monotonically_increasing_id()), "module-numbers")
    numbers = [names.select(F.col("module").alias(c), F.col("v").alias(f"{c}_v")) for c in ("src", "dst")]
    edges = written(edges.join(numbers[0], "src").join(numbers[1], "dst").select(F.col("src_v").alias("src"), F.col("dst_v").alias("dst")), "module-edges")
    left, found = names.select("v"), []
    while True:
        ends = edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()
        found.append(left.join(ends, "v", "left_anti").select("v", F.col("v").alias("root")))
        if edges.isEmpty():
            break
        state = _settled(ends.select("v", F.col("v").alias("up"), F.col("v").alias("down")), edges)
        found.append(state.where("up = down").select("v", F.col("up").alias("root")))
        rest = state.where("up <> down")
        left = rest.select("v")
        at = [rest.select(F.col("v").alias(c), F.col("up").alias(f"up_{c}"), F.col("down").alias(f"down_{c}")) for c in ("src", "dst")]
        edges = written(edges.join(at[0], "src").join(at[1], "dst").where("up_src = up_dst AND down_src = down_dst").select("src", "dst"), "module-edges")
    rooted = found[0]
    for more in found[1:]:
        rooted = rooted.unionByName(more)
    rooted = written(rooted.join(names, "v").select("module", "root"), "module-roots")
    named = rooted.groupBy("root").agg(F.min("module").alias("component"), F.count("*").alias("members"))
    return rooted.join(named, "root").select("module", "component", "members")


def dependents(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(module, dependent) for each module of ``of``: every module that imports it,
    directly or through others (not itself), breadth first."""
    edges = written(edges, "module-edges")
    front = written(of.select("module", F.col("module").alias("dst")).distinct(), "module-front")
    seen = front
    while True:
        step = front.join(edges, "dst").select("module", F.col("src").alias("dst")).distinct()
        front = written(step.join(seen, ["module", "dst"], "left_anti"), "module-front")
        if not front.limit(1).count():
            return seen.where("module <> dst").select("module", F.col("dst").alias("dependent"))
        seen = seen.unionByName(front)
