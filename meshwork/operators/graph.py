"""The graph model and its structure metrics.

A graph is a pair of tables: vertices(id) and edges(src, dst). ``undirected``
stores each edge both ways, once, without loops. Degrees count both ends of every
stored edge, so in an undirected graph they are twice the number of neighbours;
``simple`` gives the number of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.store import cut


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def undirected(edges: DataFrame, *, src: str = "src", dst: str = "dst", vertices: DataFrame | None = None, drop_loops: bool = True, dedupe: bool = True) -> Graph:
        one = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
        if drop_loops:
            one = one.filter("src <> dst")
        both = one.unionByName(reverse(one))
        return Graph.directed(both.distinct() if dedupe else both, vertices=vertices)

    @staticmethod
    def directed(edges: DataFrame, *, vertices: DataFrame | None = None) -> Graph:
        edges = edges.select("src", "dst")
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        if vertices is not None:
            ends = ends.union(vertices.select("id"))
        return Graph(ends.distinct(), edges)

    def persist(self) -> Graph:
        return Graph(self.vertices.persist(), self.edges.persist())

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()

    def pairs(self) -> DataFrame:
        """Each undirected edge once, src < dst."""
        return self.edges.filter("src < dst")

    def induced(self, ids: DataFrame) -> Graph:
        """The subgraph of the vertices in ``ids`` (id)."""
        kept = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(self.vertices.join(ids, "id", "left_semi"), kept.select("src", "dst"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def canonical_pairs(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).filter("src <> dst").distinct()


def multiplicity(edges: DataFrame) -> DataFrame:
    """src, dst, weight: how often an edge occurs."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def encode(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary id -> code, encoded edges). Codes are unique longs, not gapless, given without a global sort and written once."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    codes = cut(ids.withColumn("code", F.monotonically_increasing_id()), "dictionary")
    src, dst = (codes.select(F.col("id").alias(c), F.col("code").alias(f"{c}_code")) for c in ("src", "dst"))
    return codes, edges.join(src, "src").join(dst, "dst").select(F.col("src_code").alias("src"), F.col("dst_code").alias("dst"))


def degrees(g: Graph, mode: str = "both") -> DataFrame:
    """id, degree of every vertex, isolated ones included. Modes: both, in, out, simple."""
    ends = {"out": ["src"], "simple": ["src"], "in": ["dst"], "both": ["src", "dst"]}[mode]
    hits = g.edges.select(F.explode(F.array(*ends)).alias("id")) if len(ends) > 1 else g.edges.select(F.col(ends[0]).alias("id"))
    found = hits.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def in_out_total(g: Graph) -> DataFrame:
    hits = g.edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(g.edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return hits.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def degree_stats(deg: DataFrame) -> DataFrame:
    d = F.col("degree")
    return deg.agg(F.avg(d).alias("avg_degree"), F.max(d).alias("max_degree"), F.min(d).alias("min_degree"), F.stddev_samp(d).alias("stddev_samp"), F.stddev_pop(d).alias("stddev_pop"))


def degree_histogram(deg: DataFrame) -> DataFrame:
    """degree, count, and the share p_k of all vertices."""
    total = deg.agg(F.count(F.lit(1)).alias("n"))
    return deg.groupBy("degree").agg(F.count(F.lit(1)).alias("count")).join(F.broadcast(total)).select("degree", "count", (F.col("count") / F.col("n")).alias("p_k"))


def power_law(deg: DataFrame) -> DataFrame:
    """The exponent of the degree distribution: minus the slope of ln p(k) over ln k, without the smallest k."""
    h = degree_histogram(deg.filter("degree > 0"))
    least = h.agg(F.min("degree").alias("least"))
    h = h.join(F.broadcast(least)).filter("degree > least")
    return h.agg((-F.regr_slope(F.log("p_k"), F.log("degree"))).alias("exponent"), F.count(F.lit(1)).alias("points"))


def top(df: DataFrame, by: str, k: int, id_col: str = "id") -> DataFrame:
    """The k rows with the largest values; ties by id."""
    return df.orderBy(F.desc(by), F.asc(id_col)).limit(k)


def summary(g: Graph) -> DataFrame:
    """nodes, edges (stored ones halved), density = 2E / (V (V - 1))."""
    v, e = g.vertices.agg(F.count(F.lit(1)).alias("nodes")), g.edges.agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    return v.join(F.broadcast(e)).select("nodes", "edges", F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"))


#: Ends that one block of the triangle search ships, about.
ENDS = 100_000_000


def _closed_blocks(g: Graph, ends: int) -> Iterator[DataFrame]:
    """a, b, cs in blocks of b: the triangles a, b, c for each c in ``cs``, in rising (degree, id), every one once.

    Edges point from lower to higher degree, which bounds out-degrees by the root
    of the number of edges. Each vertex sends those of its ends that are behind b to
    b, as one row, where they meet b's own ends; so wedges aren't rows. Blocks bound
    what is shuffled at once.
    """
    deg = degrees(g, "simple")
    d1, d2 = (deg.select(F.col("id").alias(c), F.col("degree").alias(f"d_{c}")) for c in ("src", "dst"))
    one = g.pairs().join(d1, "src").join(d2, "dst")
    up = (F.col("d_src") < F.col("d_dst")) | ((F.col("d_src") == F.col("d_dst")) & (F.col("src") < F.col("dst")))
    oriented = one.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.struct(F.greatest("d_src", "d_dst").alias("d"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")).alias("end"))
    lists = cut(oriented.groupBy("a").agg(F.sort_array(F.collect_list("end"))["b"].alias("ends")), "oriented")
    size = F.size("ends").cast("long")
    work = lists.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
    blocks = max(1, -(-int(work) // ends))
    for k in range(blocks):
        here = F.pmod(F.xxhash64("b"), F.lit(blocks)) == k if blocks > 1 else F.lit(True)
        sent = lists.filter(size > 1).select("a", "ends", F.posexplode("ends").alias("i", "b")).filter(here & (F.col("i") < size - 1)).select("b", "a", F.slice("ends", F.col("i") + 2, F.size("ends")).alias("rest"))
        own = lists.select(F.col("a").alias("b"), F.col("ends").alias("own")).filter(here)
        yield sent.join(own.hint("shuffle_hash"), "b").select("a", "b", F.array_intersect("rest", "own").alias("cs")).filter(F.size("cs") > 0)


def wedges_closed(g: Graph, ends: int = ENDS) -> DataFrame:
    """Every triangle once, as a written table: a, b, c in rising (degree, id)."""
    out = None
    for block in _closed_blocks(g, ends):
        found = cut(block.select("a", "b", F.explode("cs").alias("c")), "triangles")
        out = found if out is None else out.unionByName(found)
    return out


def triangles(g: Graph, ends: int = ENDS) -> DataFrame:
    """id, triangles through it, for every vertex."""
    hits = None
    for block in _closed_blocks(g, ends):
        n = F.size("cs").cast("long")
        each = F.concat(F.array(*[F.struct(F.col(c).alias("id"), n.alias("n")) for c in ("a", "b")]), F.transform("cs", lambda c: F.struct(c.alias("id"), F.lit(1).cast("long").alias("n"))))
        found = cut(block.select(F.inline(each)).groupBy("id").agg(F.sum("n").alias("n")), "triangles")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("id").agg(F.sum("n").alias("triangles"))
    return g.vertices.join(hits, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def open_wedges(g: Graph) -> DataFrame:
    """b, wedges: the paths a - b - c between two neighbours that aren't linked, either way round, of vertices that have any.

    They are all pairs of neighbours less those that triangles close.
    """
    both = degrees(g, "simple").join(triangles(g), "id")
    return both.select(F.col("id").alias("b"), (F.col("degree") * (F.col("degree") - 1) - 2 * F.col("triangles")).alias("wedges")).filter("wedges > 0")


def triangle_total(per_vertex: DataFrame) -> DataFrame:
    return per_vertex.agg((F.sum("triangles") / 3).cast("long").alias("triangles"))


def _share(t: Column, d: Column) -> Column:
    return F.when(d >= 2, F.try_divide(2.0 * t, d * (d - 1))).otherwise(0.0)


def local_clustering(g: Graph, degree: str = "both") -> DataFrame:
    """id, clustering. With degree ``both`` the denominator has the doubled degrees."""
    return triangles(g).join(degrees(g, degree), "id").select("id", _share(F.col("triangles"), F.col("degree")).alias("clustering"))


def clustering(g: Graph, degree: str = "both") -> DataFrame:
    """triangles, triples, global_clustering, avg_local_clustering."""
    both = triangles(g).join(degrees(g, degree), "id")
    d, t = F.col("degree"), F.col("triangles")
    out = both.agg((F.sum(t) / 3).cast("long").alias("triangles"), (F.sum(d * (d - 1)) / 2).cast("long").alias("triples"), F.avg(_share(t, d)).alias("avg_local_clustering"))
    return out.select("triangles", "triples", F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.col("triples")), F.lit(0.0)).alias("global_clustering"), F.coalesce("avg_local_clustering", F.lit(0.0)).alias("avg_local_clustering"))


def motif(edges: DataFrame, pattern: list[tuple[str, str]], absent: list[tuple[str, str]] = (), *, different: bool = False) -> DataFrame:
    """A column for each name in ``pattern``: every way to name vertices so that its edges are there and those of ``absent`` aren't.

    Of the edges that are left, one whose ends both have columns comes next, as a
    semi-join, so that rows are ruled out before others widen them; else one with
    one end, as an equi-join; a pattern in two pieces is refused. Absent edges, over
    names of the pattern, are anti-joins as soon as both ends have columns. Names
    may stand for one vertex unless ``different``.
    """
    names = {x for e in pattern for x in e}
    if not pattern or not {x for e in absent for x in e} <= names:
        raise ValueError("absent edges need names of the pattern")
    edges = edges.select("src", "dst").distinct()
    as_ = lambda a, b: edges.filter("src = dst").select(F.col("src").alias(a)) if a == b else edges.select(F.col("src").alias(a), F.col("dst").alias(b))
    todo, barred, out = list(pattern), list(absent), None
    while todo:
        have = set(out.columns) if out is not None else set()
        edge = next((e for n in (2, 1) for e in todo if len({*e} & have) >= min(n, len({*e}))), None) if have else todo[0]
        if edge is None:
            raise ValueError("the pattern falls into pieces")
        todo.remove(edge)
        both = list(dict.fromkeys(edge))
        shared = [x for x in both if x in have]
        if out is None:
            out = as_(*edge)
        elif len(shared) == len(both):
            out = out.join(as_(*edge), both, "left_semi")
        else:
            out = out.join(as_(*edge), shared)
            if different:
                new = next(x for x in both if x not in have)
                out = out.filter(~F.col(new).isin(*[F.col(x) for x in out.columns if x != new]))
        for gone in [e for e in barred if {*e} <= set(out.columns)]:
            out = out.join(as_(*gone), list(dict.fromkeys(gone)), "left_anti")
            barred.remove(gone)
    return out.select(*sorted(names))


def mutual_motif(edges: DataFrame) -> DataFrame:
    """The motif (a)-[]->(b); (b)-[]->(a): each pair once."""
    back = reverse(edges)
    return edges.join(back, ["src", "dst"], "left_semi").filter("src < dst").distinct()


def preview(edges: DataFrame, *, first: int = 900, nodes: int = 70, most: int = 180) -> DataFrame:
    """A small picture of a graph: of the first edges, the busiest nodes and the edges between them."""
    some = edges.orderBy("src", "dst").limit(first)
    deg = top(some.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degree", nodes)
    ids = deg.select("id")
    kept = some.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.orderBy("src", "dst").limit(most).select("src", "dst")


def chain(table: DataFrame, key: str) -> Graph:
    """The path through a table's keys in order, both ways. One key range a task is not enough for lead(); dimension tables only."""
    step = Window.orderBy(key)
    return Graph.undirected(table.select(F.col(key).alias("src"), F.lead(key).over(step).alias("dst")).filter("dst IS NOT NULL"))


def path_graph(spark, low: int = 101, high: int = 200) -> Graph:
    one = spark.range(low, high).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return Graph.undirected(one)
