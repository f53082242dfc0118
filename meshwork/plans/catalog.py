"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import scalars as S
from meshwork.operators import centrality, community, compare, embeddings, forest, graph, iterate, linkpred, resilience, stops, transit
from meshwork.plans import fixtures as X
from meshwork.sources import edges as sources
from meshwork.store import cut
from meshwork.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _graph_sql(least: int | None) -> str:
    rows = f"(SELECT * FROM lineitem WHERE l_quantity >= {least})" if least else "lineitem"
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM {rows} a JOIN {rows} b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey),
        e AS MATERIALIZED (SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u),
        v AS MATERIALIZED (SELECT DISTINCT src AS id FROM e),
        deg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM e GROUP BY src)"""


P, Q = _graph_sql(None), _graph_sql(45)
_TRI = """, tri AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst),
        t AS MATERIALIZED (SELECT v.id, coalesce(n, 0)::BIGINT AS t FROM v LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY id) USING (id))"""
_DIST = ", h(landmark, id, distance) AS (SELECT id, id, 0 FROM {sources} UNION SELECT h.landmark, e.dst, h.distance + 1 FROM h JOIN e ON h.id = e.src WHERE h.distance < {most}), dist AS MATERIALIZED (SELECT landmark, id, min(distance) AS distance FROM h GROUP BY ALL)"
_REACH = ", r(id, c) AS (SELECT id, id FROM v UNION SELECT e.dst, r.c FROM r JOIN e ON r.id = e.src), comp AS MATERIALIZED (SELECT id, min(c) AS component FROM r GROUP BY id)"
#: The same by rounds of minima: the co-purchase graph of all lines is far less than 12 hops wide.
_NEAR = ", m0 AS (SELECT id, id AS component FROM v)" + "".join(f", m{k + 1} AS MATERIALIZED (SELECT id, min(component) AS component FROM (SELECT * FROM m{k} UNION ALL SELECT e.dst, component FROM e JOIN m{k} ON id = e.src) GROUP BY id)" for k in range(12)) + ", comp AS (SELECT * FROM m12)"


def _pagerank_sql(n: int) -> str:
    out = ", r0 AS (SELECT id, 1.0::DOUBLE AS r FROM v)"
    for k in range(n):
        out += f", r{k + 1} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(s, 0) AS r FROM v LEFT JOIN (SELECT e.dst AS id, sum(r / d) AS s FROM e JOIN r{k} ON r{k}.id = e.src JOIN deg ON deg.id = e.src GROUP BY e.dst) USING (id))"
    return out


def _lpa_sql(n: int) -> str:
    out = ", l0 AS (SELECT id, id AS label FROM v)"
    for k in range(n):
        out += f", l{k + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT e.dst AS id, label, row_number() OVER (PARTITION BY e.dst ORDER BY count(*) DESC, label) AS n FROM e JOIN l{k} ON l{k}.id = e.src GROUP BY e.dst, label) WHERE n = 1)"
    return out


# Graph construction and structure


@query("edges_symmetric", P + " SELECT src, dst FROM e")
def _(s, d):
    return X.parts(s, d).edges.select("src", "dst")


@query("vertices", P + " SELECT id FROM v")
def _(s, d):
    return X.parts(s, d).vertices


@query("graph_summary", P + " SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM u) AS edges, 2.0::DOUBLE * (SELECT count(*) FROM u) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS density")
def _(s, d):
    return graph.summary(X.parts(s, d))


@query("edge_multiplicity", "SELECT src, dst, count(*) AS weight FROM (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey) GROUP BY ALL")
def _(s, d):
    lines = X.table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    return graph.multiplicity(lines.select("l_orderkey", F.col("l_partkey").alias("src")).join(lines.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").filter("src < dst"))


@query("degree_in_out_total", P + " SELECT id, d AS in_degree, d AS out_degree, 2 * d AS degree FROM deg")
def _(s, d):
    return graph.in_out_total(X.parts(s, d))


@query("degree_histogram", P + " SELECT 2 * d AS degree, count(*) AS count, count(*) / (SELECT count(*) FROM v)::DOUBLE AS p_k FROM deg GROUP BY d")
def _(s, d):
    return graph.degree_histogram(graph.degrees(X.parts(s, d)))


@query("degree_stats", P + " SELECT round(avg(2 * d), 6) AS avg_degree, max(2 * d) AS max_degree, min(2 * d) AS min_degree, round(stddev_samp(2 * d), 6) AS stddev_samp, round(stddev_pop(2 * d), 6) AS stddev_pop FROM deg")
def _(s, d):
    out = graph.degree_stats(graph.degrees(X.parts(s, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_degree", "stddev_samp", "stddev_pop")})


@query("power_law", P + ", h AS (SELECT 2 * d AS k, count(*) / (SELECT count(*) FROM v)::DOUBLE AS p FROM deg GROUP BY d) SELECT round(-regr_slope(ln(p), ln(k)), 6) AS exponent, count(*) AS points FROM h WHERE k > (SELECT min(k) FROM h)")
def _(s, d):
    return graph.power_law(graph.degrees(X.parts(s, d))).withColumn("exponent", F.round("exponent", 6))


@query("top_hubs", P + " SELECT id, 2 * d AS degree FROM deg ORDER BY d DESC, id LIMIT 10")
def _(s, d):
    return graph.top(graph.degrees(X.parts(s, d)), "degree", 10)


@query("degree_centrality", P + " SELECT id, round(2.0 * d / ((SELECT count(*) FROM v) - 1), 9)::DOUBLE AS degree_centrality FROM deg")
def _(s, d):
    return centrality.degree_centrality(X.parts(s, d)).withColumn("degree_centrality", F.round("degree_centrality", 9))


@query("triangles_per_vertex", P + _TRI + " SELECT id, t AS triangles FROM t")
def _(s, d):
    return graph.triangles(X.parts(s, d))


@query("triangle_total", P + _TRI + " SELECT count(*) AS triangles FROM tri")
def _(s, d):
    return graph.triangle_total(graph.triangles(X.parts(s, d)))


@query("clustering_local", P + _TRI + " SELECT id, round(2.0 * t / (2 * d * (2 * d - 1)), 9)::DOUBLE AS clustering FROM t JOIN deg USING (id)")
def _(s, d):
    return graph.local_clustering(X.parts(s, d)).withColumn("clustering", F.round("clustering", 9))


@query("clustering_global", P + _TRI + """ SELECT (SELECT count(*) FROM tri) AS triangles, sum(2 * d * (2 * d - 1) // 2)::BIGINT AS triples,
    round(3.0 * (SELECT count(*) FROM tri) / sum(2 * d * (2 * d - 1) // 2), 9)::DOUBLE AS global_clustering, round(avg(2.0 * t / (2 * d * (2 * d - 1))), 9)::DOUBLE AS avg_local_clustering FROM t JOIN deg USING (id)""")
def _(s, d):
    return graph.clustering(X.parts(s, d)).withColumns({c: F.round(c, 9) for c in ("global_clustering", "avg_local_clustering")})


@query("mutual_motif", P + " SELECT src, dst FROM u")
def _(s, d):
    return graph.mutual_motif(X.parts(s, d).edges)


@query("motif_open_wedges", P + " SELECT x.dst AS b, count(*) AS wedges FROM e x JOIN e y ON y.src = x.dst AND y.dst <> x.src LEFT JOIN e z ON z.src = x.src AND z.dst = y.dst WHERE z.src IS NULL GROUP BY x.dst")
def _(s, d):
    return graph.open_wedges(X.parts(s, d))


@query("motif_triangles", P + _TRI + " SELECT a, b, c FROM tri")
def _(s, d):
    by_id = F.sort_array(F.array("a", "b", "c"))
    return graph.wedges_closed(X.parts(s, d)).select(*[by_id[k].alias(c) for k, c in enumerate("abc")])


@query("motif_tails", Q + """ SELECT p.src AS a, p.dst AS b, q.dst AS c, t.dst AS d FROM e p JOIN e q ON q.src = p.dst JOIN e r ON r.src = p.src AND r.dst = q.dst JOIN e t ON t.src = q.dst AND t.dst <> p.src AND t.dst <> p.dst
    WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.src = t.dst AND x.dst IN (p.src, p.dst))""")
def _(s, d):
    return graph.motif(X.sparse(s, d).edges, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], [("d", "a"), ("d", "b")], different=True)


@query("network_preview", P + """, f AS (SELECT src, dst FROM e ORDER BY src, dst LIMIT 900), n AS (SELECT id, count(*) AS k FROM (SELECT unnest([src, dst]) AS id FROM f) GROUP BY id ORDER BY k DESC, id LIMIT 70)
    SELECT src, dst FROM f WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) ORDER BY src, dst LIMIT 180""")
def _(s, d):
    return graph.preview(X.parts(s, d).edges)


@query("id_dictionary", P + " SELECT count(*) AS ids, count(*) AS codes, (SELECT count(*) FROM e) AS edges FROM v")
def _(s, d):
    codes, e = graph.encode(X.parts(s, d).edges)
    return codes.agg(F.count(F.lit(1)).alias("ids"), F.countDistinct("code").alias("codes")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges"))))


@query("chain_edges", "WITH c AS (SELECT s_suppkey AS src, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS dst FROM supplier) SELECT src, dst FROM c WHERE dst IS NOT NULL UNION SELECT dst, src FROM c WHERE dst IS NOT NULL")
def _(s, d):
    return X.suppliers(s, d).edges


@query("path_graph", "SELECT a AS src, a + 1 AS dst FROM range(101, 200) t(a) UNION SELECT a + 1, a FROM range(101, 200) t(a)")
def _(s, d):
    return graph.path_graph(s).edges


# Iterative algorithms


@query("pagerank_5", P + _pagerank_sql(5) + " SELECT id, round(r, 6) AS pagerank FROM r5")
def _(s, d):
    return iterate.pagerank(X.parts(s, d), max_iter=5).withColumn("pagerank", F.round("pagerank", 6))


@query("pagerank_top100", P + _pagerank_sql(5) + " SELECT id, round(r, 6) AS pagerank FROM r5 ORDER BY round(r, 6) DESC, id LIMIT 100")
def _(s, d):
    return graph.top(iterate.pagerank(X.parts(s, d), max_iter=5).withColumn("pagerank", F.round("pagerank", 6)), "pagerank", 100)


@query("label_propagation_5", P + _lpa_sql(5) + " SELECT id, label FROM l5")
def _(s, d):
    return iterate.label_propagation(X.parts(s, d), 5)


@query("community_sizes", P + _lpa_sql(5) + " SELECT label, count(*) AS size FROM l5 GROUP BY label ORDER BY size DESC, label LIMIT 5")
def _(s, d):
    return graph.top(iterate.group_sizes(iterate.label_propagation(X.parts(s, d), 5), "label"), "size", 5, "label")


@query("connected_components", P + _NEAR + " SELECT id, component FROM comp")
def _(s, d):
    return iterate.connected_components(X.parts(s, d))


@query("component_profile", P + _NEAR + ", z AS (SELECT component, count(*) AS size FROM comp GROUP BY component) SELECT count(*) AS groups, count(*) FILTER (size > 10) AS over_ten, count(*) FILTER (size = 1) AS singletons, max(size) AS largest FROM z")
def _(s, d):
    return iterate.size_profile(iterate.group_sizes(iterate.connected_components(X.parts(s, d)), "component"))


@query("giant_component", P + _NEAR + " SELECT max(n) AS giant_size FROM (SELECT count(*) AS n FROM comp GROUP BY component)")
def _(s, d):
    return resilience.giant_component(X.parts(s, d))


_TOP3 = ", top3 AS MATERIALIZED (SELECT id FROM deg ORDER BY d DESC, id LIMIT 3)"


@query("shortest_paths_landmarks", P + _TOP3 + _DIST.format(sources="top3", most=60) + " SELECT landmark, id, distance FROM dist")
def _(s, d):
    g = X.parts(s, d)
    return iterate.hops(g, iterate.landmarks(g, "degree", 3))


@query("path_stats", P + _TOP3 + _DIST.format(sources="top3", most=60) + " SELECT count(*) AS paths, max(distance) AS diameter, round(avg(distance), 6) AS avg_distance FROM dist")
def _(s, d):
    g = X.parts(s, d)
    return iterate.path_stats(iterate.hops(g, iterate.landmarks(g, "degree", 3))).withColumn("avg_distance", F.round("avg_distance", 6))


@query("distance_maps", P + _TOP3 + _DIST.format(sources="top3", most=60) + " SELECT id, string_agg(landmark || '=' || distance, ',' ORDER BY landmark) AS distances FROM dist GROUP BY id")
def _(s, d):
    g = X.parts(s, d)
    m = iterate.distance_maps(iterate.hops(g, iterate.landmarks(g, "degree", 3)))
    pairs = F.transform(F.array_sort(F.map_entries("distances")), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string")))
    return m.select("id", F.array_join(pairs, ",").alias("distances"))


@query("shortest_path_trace", "SELECT (row_number() OVER (ORDER BY s_suppkey))::INT AS step, s_suppkey AS id FROM supplier")
def _(s, d):
    ends = X.table(s, d, "supplier").agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    return iterate.trace(X.suppliers(s, d), ends[0], ends[1])


@query("eigenvector_20")
def _(s, d):
    return iterate.eigenvector(X.parts(s, d), 20, 0.0).withColumn("eigenvector", F.round("eigenvector", 6))


def _eigen_sql(n: int) -> str:
    out = ", x0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v)"
    for k in range(n):
        out += f", y{k} AS MATERIALIZED (SELECT e.dst AS id, sum(x) AS y FROM e JOIN x{k} ON x{k}.id = e.src GROUP BY e.dst), x{k + 1} AS MATERIALIZED (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM y{k}) AS x FROM y{k})"
    return P + out + f" SELECT id, round(x, 6) AS eigenvector FROM x{n}"


ORACLE_SQL["eigenvector_20"] = _eigen_sql(20)


def _core_sql(n: int) -> str:
    out = ", c0 AS (SELECT id, d AS c FROM deg)"
    for k in range(n):
        out += f", c{k + 1} AS MATERIALIZED (SELECT id, max(least(n, c)) AS c FROM (SELECT e.src AS id, c, row_number() OVER (PARTITION BY e.src ORDER BY c DESC) AS n FROM e JOIN c{k} ON c{k}.id = e.dst) GROUP BY id)"
    return P + out + f" SELECT id, c AS coreness FROM c{n}"


@query("kcore", _core_sql(24))
def _(s, d):
    return iterate.k_core(X.parts(s, d))


@query("core_distribution", _core_sql(24).rsplit(" SELECT id", 1)[0] + " SELECT c AS coreness, count(*) AS count FROM c24 GROUP BY c")
def _(s, d):
    return iterate.k_core(X.parts(s, d)).groupBy("coreness").agg(F.count(F.lit(1)).alias("count"))


# Centralities


_SAMPLE = ", sm AS MATERIALIZED (SELECT id FROM v ORDER BY md5(concat(id::VARCHAR, ':42')), id LIMIT {n})"
_SHARE = ", sm AS MATERIALIZED (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(concat(id::VARCHAR, ':42')), id) AS n FROM v) WHERE n <= greatest(1, floor((SELECT count(*) FROM v) * {share})))"


def _brandes_sql(levels: int) -> str:
    """Levels f0, f1, ... of a search from sm with path counts, and b1, b2, ... with dependencies."""
    out = ", f0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS paths FROM sm), n0 AS (SELECT s, id FROM f0)"
    for k in range(levels):
        out += f", f{k + 1} AS MATERIALIZED (SELECT f.s, e.dst AS id, sum(paths) AS paths FROM f{k} f JOIN e ON e.src = f.id LEFT JOIN n{k} n ON n.s = f.s AND n.id = e.dst WHERE n.s IS NULL GROUP BY f.s, e.dst)"
        out += f", n{k + 1} AS MATERIALIZED (SELECT * FROM n{k} UNION ALL SELECT s, id FROM f{k + 1})"
    out += f", b{levels} AS (SELECT *, 0.0::DOUBLE AS delta FROM f{levels})"
    for k in range(levels - 1, 0, -1):
        out += f", b{k} AS MATERIALIZED (SELECT f.s, f.id, f.paths, f.paths * coalesce(x, 0) AS delta FROM f{k} f LEFT JOIN (SELECT b.s, e.src AS id, sum((1 + delta) / paths) AS x FROM b{k + 1} b JOIN e ON e.dst = b.id GROUP BY b.s, e.src) USING (s, id))"
    parts = " UNION ALL ".join(f"SELECT id, delta FROM b{k}" for k in range(1, levels + 1))
    return out + f", btw AS MATERIALIZED (SELECT id, coalesce(d, 0) * ((SELECT count(*) FROM v)::DOUBLE / (SELECT count(*) FROM sm) / (((SELECT count(*) FROM v) - 1) * ((SELECT count(*) FROM v) - 2))) AS betweenness FROM v LEFT JOIN (SELECT id, sum(delta) AS d FROM ({parts}) GROUP BY id) USING (id))"


def _levels_sql(levels: int, sources: str = "sm") -> str:
    """dist(landmark, id, distance) of a search from ``sources``, level by level."""
    out = f", h0 AS MATERIALIZED (SELECT id AS landmark, id, 0 AS distance FROM {sources}), p0 AS (SELECT * FROM h0)"
    for k in range(levels):
        out += f", h{k + 1} AS MATERIALIZED (SELECT DISTINCT h.landmark, e.dst AS id, {k + 1} AS distance FROM h{k} h JOIN e ON e.src = h.id LEFT JOIN p{k} p ON p.landmark = h.landmark AND p.id = e.dst WHERE p.id IS NULL)"
        out += f", p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT * FROM h{k + 1})"
    return out + f", dist AS (SELECT * FROM p{levels})"


#: Levels that a search over the graph of all lines needs at most.
_WIDE = 6
_CLOSE = """, k AS (SELECT id, count(*) AS n, sum(distance) AS s FROM dist WHERE distance > 0 GROUP BY id),
    cls AS MATERIALIZED (SELECT v.id, coalesce(n::DOUBLE * n / (((SELECT count(*) FROM v) - 1) * s), 0) AS closeness FROM v LEFT JOIN k USING (id))"""


@query("closeness_sampled", P + _SHARE.format(share=0.1) + _levels_sql(_WIDE) + _CLOSE + " SELECT id, round(closeness, 9) AS closeness FROM cls")
def _(s, d):
    g = X.parts(s, d)
    return centrality.closeness(g, centrality.sample(g.vertices, share=0.1)).withColumn("closeness", F.round("closeness", 9))


@query("closeness_full", Q + _levels_sql(40, "v") + _CLOSE + " SELECT id, round(closeness, 9) AS closeness FROM cls")
def _(s, d):
    return centrality.closeness(X.sparse(s, d)).withColumn("closeness", F.round("closeness", 9))


@query("global_efficiency", P + _SAMPLE.format(n=200) + _levels_sql(_WIDE) + " SELECT round(avg(1.0 / distance), 9)::DOUBLE AS efficiency FROM dist WHERE distance > 0")
def _(s, d):
    g = X.parts(s, d)
    return resilience.global_efficiency(g, centrality.sample(g.vertices, rows=200)).withColumn("efficiency", F.round("efficiency", 9))


@query("harmonic_efficiency", Q + _levels_sql(40, "v") + " SELECT round(sum(1.0 / distance) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 9)::DOUBLE AS efficiency FROM dist WHERE distance > 0")
def _(s, d):
    return resilience.global_efficiency(X.sparse(s, d), denominator="all").withColumn("efficiency", F.round("efficiency", 9))


@query("betweenness_sampled", P + _SHARE.format(share=0.05) + _brandes_sql(_WIDE) + " SELECT id, round(betweenness, 9) AS betweenness FROM btw")
def _(s, d):
    g = X.parts(s, d)
    return centrality.betweenness(g, centrality.sample(g.vertices, share=0.05)).withColumn("betweenness", F.round("betweenness", 9))


@query("betweenness_full")
def _(s, d):
    return centrality.betweenness(X.sparse(s, d)).withColumn("betweenness", F.round("betweenness", 9))


@query("burt_constraint", P + """, w AS (SELECT a.src AS i, b.dst AS j, sum(1.0::DOUBLE / d) AS x FROM e a JOIN e b ON a.dst = b.src JOIN deg ON deg.id = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst GROUP BY ALL)
    SELECT e.src AS id, round(sum(((1 + coalesce(x, 0)) / d) ** 2), 6) AS "constraint", round(1 - sum(((1 + coalesce(x, 0)) / d) ** 2), 6) AS broker FROM e LEFT JOIN w ON w.i = e.src AND w.j = e.dst JOIN deg ON deg.id = e.src GROUP BY e.src""")
def _(s, d):
    return centrality.burt_constraint(X.parts(s, d)).withColumns({c: F.round(c, 6) for c in ("constraint", "broker")})


def _converged_sql(rounds: int, tol: float = 1e-6) -> str:
    """eig: power iteration that stops where no score changes by ``tol``; it must get there within the rounds."""
    out = ", e0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v), z0 AS (SELECT false AS done)"
    for k in range(rounds):
        out += f", y{k} AS MATERIALIZED (SELECT e.dst AS id, sum(x) AS y FROM e JOIN e{k} ON e{k}.id = e.src GROUP BY e.dst)"
        out += f", e{k + 1} AS MATERIALIZED (SELECT id, CASE WHEN (SELECT done FROM z{k}) THEN x ELSE y / (SELECT sqrt(sum(y * y)) FROM y{k}) END AS x, x AS was FROM e{k} JOIN y{k} USING (id))"
        out += f", z{k + 1} AS MATERIALIZED (SELECT max(abs(x - was)) < {tol} AS done FROM e{k + 1})"
    return out + f", eig AS (SELECT id, x AS eigenvector FROM e{rounds})"


def _blend_sql() -> str:
    part = lambda c: f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)"
    return " + ".join(f"{w} * {part(c)}" for c, w in centrality.WEIGHTS.items())


@query("influence_score", _core_sql(24).rsplit(" SELECT id", 1)[0] + _SHARE.format(share=0.05) + _brandes_sql(_WIDE) + _SHARE.format(share=0.1).replace("sm AS", "sm2 AS") + _levels_sql(_WIDE, "sm2") + _CLOSE + _converged_sql(20) + f""", every AS (SELECT v.id, 2.0::DOUBLE * d / ((SELECT count(*) FROM v) - 1) AS degree_centrality, betweenness, closeness, eigenvector, c24.c AS coreness FROM v JOIN deg USING (id) JOIN btw USING (id) JOIN cls USING (id) JOIN eig USING (id) JOIN c24 USING (id))
    SELECT id, round({_blend_sql()}, 6) AS influence FROM every""")
def _(s, d):
    g = X.parts(s, d)
    some = {share: centrality.sample(g.vertices, share=share) for share in (0.05, 0.1)}
    return centrality.influence(centrality.degree_centrality(g), centrality.betweenness(g, some[0.05]), centrality.closeness(g, some[0.1]), iterate.eigenvector(g), iterate.k_core(g)).withColumn("influence", F.round("influence", 6))


# Communities given by the parts' brand


_BRAND = ", b AS MATERIALIZED (SELECT p_partkey AS id, p_brand AS c FROM part), eb AS MATERIALIZED (SELECT e.src, e.dst, x.c AS cs, y.c AS cd FROM e JOIN b x ON x.id = e.src JOIN b y ON y.id = e.dst)"


@query("modularity_edge", P + _BRAND + " SELECT round(sum(1 - a.d * z.d / (SELECT count(*) FROM e)::DOUBLE) / (SELECT count(*) FROM e), 9) AS modularity FROM eb JOIN deg a ON a.id = src JOIN deg z ON z.id = dst WHERE cs = cd")
def _(s, d):
    return community.modularity(X.parts(s, d), X.brands(s, d), edges_only=True).withColumn("modularity", F.round("modularity", 9))


@query("modularity_newman", P + _BRAND + """, i AS (SELECT cs AS c, count(*) AS n FROM eb WHERE cs = cd GROUP BY cs), t AS (SELECT c, sum(d) AS d FROM deg JOIN b USING (id) GROUP BY c)
    SELECT round(sum(coalesce(n, 0) / (SELECT count(*) FROM e)::DOUBLE - (d / (SELECT count(*) FROM e)::DOUBLE) ** 2), 9) AS modularity FROM t LEFT JOIN i USING (c)""")
def _(s, d):
    return community.modularity(X.parts(s, d), X.brands(s, d)).withColumn("modularity", F.round("modularity", 9))


@query("community_profile", P + _BRAND + """, x AS (SELECT cs AS c, count(*) FILTER (cs = cd) AS i2, count(*) FILTER (cs <> cd) AS o FROM eb GROUP BY cs), y AS (SELECT c, count(*) AS n, avg(d) AS a, max(d) AS m FROM deg JOIN b USING (id) GROUP BY c)
    SELECT c AS community, n AS size, i2 // 2 AS internal_edges, o // 2 AS external_edges, o AS external_edges_raw, round(i2::DOUBLE / (n * (n - 1)), 4) AS density, round(a, 2) AS avg_degree, m AS max_degree,
           round(i2::DOUBLE / (SELECT count(*) FROM e), 4) AS coverage, round(o::DOUBLE / (i2 + o), 4) AS conductance FROM y JOIN x USING (c)""")
def _(s, d):
    return community.profile(X.parts(s, d), X.brands(s, d))


@query("bridge_nodes", P + _BRAND + " SELECT src AS id, cs AS community, count(DISTINCT cd) AS bridge_score, array_to_string(list_sort(list(DISTINCT cd)), ',') AS connects_to FROM eb WHERE cs <> cd GROUP BY src, cs")
def _(s, d):
    return community.bridges(X.parts(s, d), X.brands(s, d)).withColumn("connects_to", F.array_join("connects_to", ","))


@query("community_jaccard", P + _BRAND + """, k AS (SELECT c FROM b GROUP BY c ORDER BY count(*) DESC, c LIMIT 20), n AS MATERIALIZED (SELECT DISTINCT cs, cd FROM eb WHERE cs <> cd AND cs IN (SELECT c FROM k)), z AS (SELECT cs, count(*) AS n FROM n GROUP BY cs)
    SELECT x.cs AS community_a, y.cs AS community_b, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*))::DOUBLE, 4) AS jaccard FROM n x JOIN n y ON x.cd = y.cd AND x.cs < y.cs JOIN z p ON p.cs = x.cs JOIN z q ON q.cs = y.cs GROUP BY x.cs, y.cs""")
def _(s, d):
    return community.similarity(X.parts(s, d), X.brands(s, d))


@query("community_members", "SELECT p_brand AS community, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY p_brand")
def _(s, d):
    return community.members(X.brands(s, d)).select("community", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("louvain_local_move")
def _(s, d):
    return community.local_moving(X.sparse(s, d))


# Link prediction


_HOP2 = ", pr AS MATERIALIZED (SELECT DISTINCT a.src AS u, b.dst AS v FROM e a JOIN e b ON a.dst = b.src WHERE a.src < b.dst AND NOT EXISTS (SELECT 1 FROM e x WHERE x.src = a.src AND x.dst = b.dst))"


@query("two_hop_pairs", Q + _HOP2 + " SELECT u, v FROM pr")
def _(s, d):
    return linkpred.two_hop_pairs(X.sparse(s, d))


@query("link_features", Q + _HOP2 + _BRAND + """, cn AS (SELECT u, v, count(*) AS n, sum(CASE WHEN d > 1 THEN 1 / ln(d + 1e-9) ELSE 0 END) AS aa, sum(1.0::DOUBLE / d) AS ra FROM pr JOIN e a ON a.src = u JOIN e z ON z.src = a.dst AND z.dst = v JOIN deg ON deg.id = a.dst GROUP BY ALL),
    n3 AS (SELECT u, v, count(*) AS n3 FROM pr JOIN e a ON a.src = u JOIN e m ON m.src = a.dst JOIN e z ON z.src = m.dst AND z.dst = v GROUP BY ALL)
    SELECT u, v, n AS common_neighbors, round(n / (x.d + y.d - n)::DOUBLE, 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation, x.d * y.d AS preferential_attachment, (p.c = q.c)::INT AS same_community, 2 AS path_distance,
           round(0.005 * n + 0.005 * 0.005 * (coalesce(n3, 0) - n), 9)::DOUBLE AS katz
    FROM cn LEFT JOIN n3 USING (u, v) JOIN deg x ON x.id = u JOIN deg y ON y.id = v JOIN b p ON p.id = u JOIN b q ON q.id = v""")
def _(s, d):
    g = X.sparse(s, d)
    out = linkpred.features(g, linkpred.two_hop_pairs(g), X.brands(s, d))
    return out.withColumns({"katz": F.round("katz", 9), **{c: F.round(c, 6) for c in ("jaccard", "adamic_adar", "resource_allocation")}})


@query("link_positives", P + " SELECT src AS u, dst AS v FROM u ORDER BY md5(concat(src::VARCHAR, ':', dst::VARCHAR, ':42')), src, dst LIMIT (SELECT (count(*) * 0.2)::DOUBLE::INT FROM u WHERE true)")
def _(s, d):
    return linkpred.dataset(X.parts(s, d)).filter("label = 1").select("u", "v")


ORACLE_SQL["link_positives"] = P + " SELECT u, v FROM (SELECT src AS u, dst AS v, row_number() OVER (ORDER BY md5(concat(src::VARCHAR, ':', dst::VARCHAR, ':42')), src, dst) AS n FROM u) WHERE n <= floor((SELECT count(*) FROM u) * 0.2)"


@query("link_dataset", Q + """, k AS (SELECT floor((SELECT count(*) FROM u) * 0.2)::BIGINT AS n, (SELECT count(*) FROM v) AS size), t AS (SELECT greatest(10, ceil(3 * n / (2.0 * size))::BIGINT + 2) AS tries FROM k),
    pl AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', id, '42a')), id) - 1 AS i FROM v), f AS (SELECT unnest(range(1, tries + 1)) AS j FROM t),
    mixed AS (SELECT DISTINCT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v FROM pl a, f, k, pl b WHERE b.i = (a.i + j) % size AND a.id <> b.id),
    ranked AS (SELECT u, v, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', u, v, '42')), u, v) AS place FROM (SELECT src AS u, dst AS v, 1 AS label FROM u UNION ALL SELECT u, v, 0 FROM mixed WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = mixed.u AND e.dst = mixed.v)))
    SELECT u, v, label FROM ranked, k WHERE place <= n""")
def _(s, d):
    return linkpred.dataset(X.sparse(s, d))


@query("link_models")
def _(s, d):
    g = X.sparse(s, d)
    rows = linkpred.dataset(g)
    data = linkpred.features(linkpred.without(g, rows), rows).join(rows, ["u", "v"])
    return linkpred.train(cut(data, "pairs"))[0].select("model", F.round("auc", 6).alias("auc"))


@query("predicted_links")
def _(s, d):
    g = X.sparse(s, d)
    rows = linkpred.dataset(g)
    data = linkpred.features(linkpred.without(g, rows), rows).join(rows, ["u", "v"])
    _, model = linkpred.train(cut(data, "pairs"))
    return linkpred.predict(model, linkpred.features(g, linkpred.two_hop_pairs(g)))


# Embeddings


@query("node2vec_walks")
def _(s, d):
    return embeddings.walks(X.sparse(s, d))


@query("node_embeddings")
def _(s, d):
    model = embeddings.word_vectors(embeddings.walks(X.sparse(s, d)))
    return embeddings.vectors(model).select("id", embeddings.vector_to_array("vector").alias("vector"))


@query("kmeans_sweep")
def _(s, d):
    return embeddings.kmeans_sweep(embeddings.as_vectors(X.table(s, d, "embeddings"), "vec_id", "embedding"))[0]


@query("pca_2d")
def _(s, d):
    return embeddings.pca_2d(embeddings.as_vectors(X.table(s, d, "embeddings"), "vec_id", "embedding"))


@query("cosine_topk", """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q WHERE vec_id <> 7 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10""")
def _(s, d):
    return embeddings.nearest(X.table(s, d, "embeddings"), 7, 10).withColumn("similarity", F.round("similarity", 6))


# Resilience


_STEPS = """, per AS (SELECT greatest(1, count(*) // 20) AS per, count(*) AS n FROM v), st AS MATERIALIZED (SELECT unnest(range(0, ceil(n / per)::BIGINT + 1)) AS step FROM per)"""


def _giants_sql(rounds: int = 24) -> str:
    """sz(step, giant, remaining) of the vertices in g(id, gone) at the steps in st, by rounds of minima."""
    out = """, vs AS MATERIALIZED (SELECT step, id FROM st JOIN g ON step < gone), es AS MATERIALIZED (SELECT step, e.src, e.dst FROM e JOIN g a ON a.id = e.src JOIN g z ON z.id = e.dst JOIN st ON step < least(a.gone, z.gone)),
    w0 AS (SELECT step, id, id AS c FROM vs)"""
    for k in range(rounds):
        out += f", w{k + 1} AS MATERIALIZED (SELECT step, id, min(c) AS c FROM (SELECT * FROM w{k} UNION ALL SELECT es.step, es.dst, w.c FROM es JOIN w{k} w ON w.step = es.step AND w.id = es.src) GROUP BY step, id)"
    return out + f", sz AS MATERIALIZED (SELECT step, max(n) AS giant, sum(n) AS remaining FROM (SELECT step, c, count(*) AS n FROM w{rounds} GROUP BY step, c) GROUP BY step)"


_CURVE = " SELECT st.step::INT AS step, (n - coalesce(remaining, 0))::BIGINT AS removed, coalesce(remaining, 0)::BIGINT AS remaining, coalesce(giant, 0) AS giant_size, round(coalesce(giant, 0) / n::DOUBLE, 4) AS giant_share FROM st LEFT JOIN sz USING (step), per"


def _placed_sql(order: str) -> str:
    return f", g AS MATERIALIZED (SELECT id, (row_number() OVER (ORDER BY {order}) - 1) // (SELECT per FROM per) + 1 AS gone FROM v JOIN deg USING (id))"


_BY_HASH, _BY_DEGREE = _placed_sql("md5(concat(id::VARCHAR, ':42')), id"), _placed_sql("d DESC, id")


@query("attack_random", P + _STEPS + _BY_HASH + _giants_sql() + _CURVE)
def _(s, d):
    g = X.parts(s, d)
    return resilience.attack_curve(g, resilience.random_order(g))


@query("attack_degree_static", P + _STEPS + _BY_DEGREE + _giants_sql() + _CURVE)
def _(s, d):
    g = X.parts(s, d)
    return resilience.attack_curve(g, resilience.degree_order(g))


def _adaptive_sql(steps: int = 17) -> str:
    """g(id, gone) of an attack on the highest degrees of what is left; ``steps`` of 20 go past the stop."""
    out = ", k0 AS (SELECT id FROM v), q0 AS (SELECT src, dst FROM e)"
    for k in range(steps):
        out += f", x{k + 1} AS MATERIALIZED (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY coalesce(d, 0) DESC, id) AS n FROM k{k} LEFT JOIN (SELECT src AS id, count(*) AS d FROM q{k} GROUP BY src) USING (id)) WHERE n <= (SELECT per FROM per))"
        out += f", k{k + 1} AS MATERIALIZED (SELECT id FROM k{k} ANTI JOIN x{k + 1} USING (id)), q{k + 1} AS MATERIALIZED (SELECT q.src, q.dst FROM q{k} q ANTI JOIN x{k + 1} a ON a.id = q.src ANTI JOIN x{k + 1} z ON z.id = q.dst)"
    parts = " UNION ALL ".join([f"SELECT id, {k + 1} AS gone FROM x{k + 1}" for k in range(steps)] + [f"SELECT id, {steps + 1} FROM k{steps}"])
    return out + f", g AS MATERIALIZED ({parts})"


@query("attack_degree_adaptive", P + _STEPS.replace("ceil(n / per)::BIGINT + 1", "18") + _adaptive_sql() + _giants_sql() + _CURVE)
def _(s, d):
    return resilience.adaptive_attack(X.parts(s, d))


@query("attack_efficiency", P + _STEPS + _BY_HASH + """, pick AS MATERIALIZED (SELECT step, id FROM (SELECT step, id, row_number() OVER (PARTITION BY step ORDER BY md5(concat_ws(':', step, id, 42)), id) AS n FROM st JOIN g ON step < gone) WHERE n <= 100),
    es AS MATERIALIZED (SELECT e.src, e.dst, least(a.gone, z.gone) AS until FROM e JOIN g a ON a.id = e.src JOIN g z ON z.id = e.dst), l0 AS (SELECT step, id AS s, id, 0 AS distance FROM pick)""" + "".join(f", l{k + 1} AS MATERIALIZED (SELECT step, s, id, min(distance) AS distance FROM (SELECT * FROM l{k} UNION ALL SELECT l.step, l.s, es.dst, {k + 1} FROM l{k} l JOIN es ON es.src = l.id AND l.step < until WHERE l.distance = {k}) GROUP BY step, s, id)" for k in range(12)) + """
    SELECT st.step::INT AS step, round(coalesce(avg(1.0 / nullif(distance, 0)), 0), 9)::DOUBLE AS efficiency FROM st LEFT JOIN l12 USING (step) GROUP BY st.step""")
def _(s, d):
    g = X.parts(s, d)
    return resilience.attack_efficiency(g, resilience.random_order(g)).withColumn("efficiency", F.round("efficiency", 9))


def _cascade_sql(slack: float, rounds: int = 8) -> str:
    """Loads round by round; it must come to rest within the rounds. A round without failures is the last."""
    out = f", s0 AS MATERIALIZED (SELECT id, d::DOUBLE AS load, {slack}::DOUBLE * d AS capacity, d, CASE WHEN sm.id IS NOT NULL THEN 0 END AS failed FROM deg LEFT JOIN sm USING (id))"
    for k in range(1, rounds + 1):
        out += f", o{k} AS MATERIALIZED (SELECT e.src, e.dst, a.d FROM e JOIN s{k - 1} a ON a.id = e.src AND a.failed IS NOT NULL JOIN s{k - 1} z ON z.id = e.dst AND z.failed IS NULL)"
        out += f", r{k} AS MATERIALIZED (SELECT o.dst AS id, sum(o.d::DOUBLE / n) AS more FROM o{k} o JOIN (SELECT src, count(*) AS n FROM o{k} GROUP BY src) USING (src) GROUP BY o.dst)"
        out += f", s{k} AS MATERIALIZED (SELECT id, load + coalesce(more, 0) AS load, capacity, d, CASE WHEN failed IS NULL AND load + coalesce(more, 0) > capacity AND ({k} = 1 OR EXISTS (SELECT 1 FROM s{k - 1} WHERE failed = {k - 1})) THEN {k} ELSE failed END AS failed FROM s{k - 1} LEFT JOIN r{k} USING (id))"
    return out + f""", st AS MATERIALIZED (SELECT unnest(range(0, coalesce((SELECT max(failed) FROM s{rounds}), 0) + 1)) AS step), g AS MATERIALIZED (SELECT id, coalesce(failed, {rounds + 1}) AS gone FROM s{rounds})"""


def _cascade_rows_sql(slack: float) -> str:
    return P + _SHARE.format(share=0.05) + _cascade_sql(slack) + _giants_sql(8) + """, n AS (SELECT count(*) AS n FROM v) SELECT st.step::INT AS round, (SELECT count(*) FROM g WHERE gone = st.step) AS new_failures, (n - coalesce(remaining, 0))::BIGINT AS failed,
    coalesce(giant, 0) / n::DOUBLE AS giant_share, coalesce(remaining, 0) / n::DOUBLE AS survival_rate FROM st LEFT JOIN sz USING (step), n"""


@query("cascade", _cascade_rows_sql(2.0))
def _(s, d):
    return resilience.cascade(X.parts(s, d))


@query("cascade_tight", _cascade_rows_sql(1.1))
def _(s, d):
    return resilience.cascade(X.parts(s, d), slack=1.1)


#: What is left around each vertex k: of each neighbour what it reaches without k, and the least id of that.
_APART = """, rk(k, n, id) AS (SELECT src, dst, dst FROM e UNION SELECT rk.k, rk.n, e.dst FROM rk JOIN e ON e.src = rk.id WHERE e.dst <> rk.k),
    piece AS MATERIALIZED (SELECT k, n, count(*) AS size, min(id) AS least FROM rk GROUP BY k, n), whole AS MATERIALIZED (SELECT component, count(*) AS size FROM comp GROUP BY component)"""


@query("vulnerability", Q + _REACH + _APART + """, big AS (SELECT component, size FROM whole ORDER BY size DESC, component LIMIT 1), m AS (SELECT k, max(size) AS size FROM piece GROUP BY k)
    SELECT id, round(((SELECT size FROM big) - CASE WHEN component = (SELECT component FROM big) THEN greatest(m.size, coalesce((SELECT max(size) FROM whole WHERE component <> (SELECT component FROM big)), 0)) ELSE (SELECT size FROM big) END) / (SELECT count(*) FROM v)::DOUBLE, 6) AS vulnerability
    FROM comp JOIN m ON m.k = id""")
def _(s, d):
    return resilience.vulnerability(X.sparse(s, d))


@query("separation", Q + _REACH + _APART + " SELECT id, component, w.size AS component_size, count(DISTINCT least) AS pieces, max(piece.size) AS largest_piece FROM comp JOIN whole w USING (component) JOIN piece ON k = id GROUP BY id, component, w.size")
def _(s, d):
    return forest.separation(X.sparse(s, d))


@query("articulation_points", Q + _REACH + _APART + " SELECT k AS id, count(DISTINCT least) AS pieces FROM piece GROUP BY k HAVING count(DISTINCT least) > 1")
def _(s, d):
    return forest.articulation_points(X.sparse(s, d))


#: Edges that meet in k are in one block if their other ends hang together without k.
_BLOCKS = _REACH + _APART + """, i AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS n FROM u), t AS MATERIALIZED (SELECT piece.k, least, i.n FROM piece JOIN i ON i.src = least(k, piece.n) AND i.dst = greatest(k, piece.n)),
    l AS MATERIALIZED (SELECT DISTINCT a.n AS a, b.n AS b FROM t a JOIN t b USING (k, least)), rb(n, c) AS (SELECT n, n FROM i UNION SELECT l.b, rb.c FROM rb JOIN l ON l.a = rb.n), bl AS MATERIALIZED (SELECT n, min(c) AS c FROM rb GROUP BY n)"""


@query("edge_blocks", Q + _BLOCKS + " SELECT i.src, i.dst, f.src AS first_src, f.dst AS first_dst FROM i JOIN bl USING (n) JOIN i f ON f.n = bl.c")
def _(s, d):
    found = forest.blocks(X.sparse(s, d))
    first = found.groupBy("block").agg(F.min(F.struct("src", "dst")).alias("first"))
    return found.join(first, "block").select("src", "dst", F.col("first.src").alias("first_src"), F.col("first.dst").alias("first_dst"))


@query("bridge_edges", Q + _BLOCKS + " SELECT any_value(i.src) AS src, any_value(i.dst) AS dst FROM i JOIN bl USING (n) GROUP BY bl.c HAVING count(*) = 1")
def _(s, d):
    return forest.bridges(X.sparse(s, d))


@query("spanning_forest", P + _NEAR + " SELECT (SELECT count(*) FROM v) - count(DISTINCT component) AS edges, count(DISTINCT component) AS trees FROM comp")
def _(s, d):
    g = X.parts(s, d)
    found = forest.spanning_forest(g.edges)
    trees = iterate.connected_components(graph.Graph(g.vertices, found)).select("component").distinct().agg(F.count(F.lit(1)).alias("trees"))
    return found.agg(F.count(F.lit(1)).alias("edges")).join(F.broadcast(trees))


@query("vulnerability_dense")
def _(s, d):
    return resilience.vulnerability(X.parts(s, d))


@query("average_clustering", P + _TRI + _SAMPLE.format(n=300) + " SELECT round(avg(CASE WHEN d >= 2 THEN 2.0 * t / (d * (d - 1)) ELSE 0 END), 9)::DOUBLE AS clustering FROM t JOIN deg USING (id) WHERE id IN (SELECT id FROM sm)")
def _(s, d):
    g = X.parts(s, d)
    return resilience.average_clustering(g, centrality.sample(g.vertices, rows=300)).withColumn("clustering", F.round("clustering", 9))


# Transit

_KM = "2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - ({a})))"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _KM.format(a=f"sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2")


_TRIPS = """WITH t AS MATERIALIZED (SELECT a.n_name AS origin, b.n_name AS destination FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey),
    od AS MATERIALIZED (SELECT 'OD-' || upper(substr(sha1(origin || ' -> ' || destination), 1, 8)) AS route_id, origin || ' -> ' || destination AS route_name, origin, destination, count(*) AS trip_count FROM t WHERE origin <> destination GROUP BY origin, destination)"""
_POINTS = _TRIPS + """, ct AS (SELECT n_name AS city, 12.0 + n_nationkey * 0.37 AS lat, 75.0 + (n_nationkey * 7 % 25) * 0.21 AS lon FROM nation),
    k0 AS (SELECT od.*, a.lat::DOUBLE AS alat, a.lon::DOUBLE AS alon, b.lat::DOUBLE AS blat, b.lon::DOUBLE AS blon, row_number() OVER (ORDER BY trip_count DESC, route_name) AS idx FROM od JOIN ct a ON a.city = origin JOIN ct b ON b.city = destination),
    k1 AS (SELECT *, sqrt((blat - alat) ** 2 + (blon - alon) ** 2) AS len FROM k0),
    k AS MATERIALIZED (SELECT *, greatest(least(0.12 * len, 0.35), 0.05) * CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END AS off FROM k1),
    pt AS MATERIALIZED (SELECT route_id, route_name, trip_count, 1 AS seq, origin AS stop, round(alat, 6) AS lat, round(alon, 6) AS lon, idx * 10 + 1 AS stop_id FROM k
        UNION ALL SELECT route_id, route_name, trip_count, 2, origin || ' ' || destination || ' corridor', round((alat + blat) / 2 - (blon - alon) / len * off, 6), round((alon + blon) / 2 + (blat - alat) / len * off, 6), idx * 10 + 2 FROM k
        UNION ALL SELECT route_id, route_name, trip_count, 3, destination, round(blat, 6), round(blon, 6), idx * 10 + 3 FROM k)"""


def _points(s: SparkSession, d: str) -> DataFrame:
    return transit.od_polylines(transit.od_routes(X.trips(s, d)), X.cities(s, d))[0]


@query("od_routes", _TRIPS + " SELECT * FROM od")
def _(s, d):
    return transit.od_routes(X.trips(s, d))


@query("route_polyline", _POINTS + " SELECT route_id, route_name, trip_count, seq, stop, lat, lon, stop_id FROM pt")
def _(s, d):
    return _points(s, d)


@query("route_catalog", _POINTS + " SELECT route_id, arg_min(stop, seq) AS origin, arg_max(stop, seq) AS destination, count(*) AS stops, any_value(trip_count) AS trip_count FROM pt GROUP BY route_id")
def _(s, d):
    return transit.route_catalog(_points(s, d))


@query("catalog_search", _TRIPS + " SELECT route_id, route_name, trip_count FROM od WHERE contains(lower(origin), 'an') OR contains(lower(destination), 'an') OR contains(lower(route_id), 'an')")
def _(s, d):
    return transit.search_catalog(transit.od_routes(X.trips(s, d)), " AN ").select("route_id", "route_name", "trip_count")


@query("catalog_totals", _TRIPS + " SELECT count(*) AS routes, sum(trip_count)::BIGINT AS trips FROM od")
def _(s, d):
    return transit.od_routes(X.trips(s, d)).agg(F.count(F.lit(1)).alias("routes"), F.sum("trip_count").alias("trips"))


@query("route_distance", _POINTS + ", n AS (SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM pt WINDOW w AS (PARTITION BY route_id ORDER BY seq)) SELECT route_id, round(sum(" + _haversine("lat", "lon", "nlat", "nlon") + "), 4) AS distance_km FROM n GROUP BY route_id")
def _(s, d):
    return transit.route_distance(_points(s, d))


@query("interpolate", _POINTS + """, n AS (SELECT *, row_number() OVER w - 1 AS place, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM pt WINDOW w AS (PARTITION BY route_id ORDER BY seq))
    SELECT route_id, place::INT AS place, k::INT AS k, round(lat + (coalesce(nlat, lat) - lat) * k / 4, 9) AS lat, round(lon + (coalesce(nlon, lon) - lon) * k / 4, 9) AS lon FROM n, range(0, 4) t(k) WHERE nlat IS NOT NULL OR k = 0""")
def _(s, d):
    return transit.interpolate(_points(s, d), 4).withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@query("circular_slice", _POINTS + """, n AS (SELECT route_id, (seq - 2 + 3) % 3 + 1 AS seq, stop, lat, lon FROM pt) SELECT route_id, seq::INT AS seq, stop, lat, lon FROM n WHERE seq <= 2""")
def _(s, d):
    return transit.circular_slice(_points(s, d), 1, 2)


@query("segment_traffic", _POINTS + ", w AS (SELECT route_id, seq - 1 AS segment, (sin(3 / 7.0::DOUBLE + 0.95 * (seq - 1)) + 1) / 2 AS w FROM pt WHERE seq < 3) SELECT route_id, segment::INT AS segment, round(w, 6) AS wave, CASE WHEN w < 0.35 THEN 'Low' WHEN w < 0.7 THEN 'Medium' ELSE 'High' END AS traffic FROM w")
def _(s, d):
    return transit.segments(_points(s, d), 3)


@query("bus_states", _TRIPS + """, w AS (SELECT route_id, bus, (sin(3 / 7.0::DOUBLE + 0.95 * bus) + 1) / 2 AS w FROM od, range(0, 6) t(bus)), x AS (SELECT *, greatest(0, 16 * (w - 0.48)) AS delay FROM w)
    SELECT route_id, bus::INT AS bus, round((bus / 6.0::DOUBLE + 0.03) % 1, 6) AS progress, round(20 + 36 * (1 - w), 6) AS speed, round(delay, 6) AS delay, CASE WHEN delay >= 4 THEN 'Delayed' WHEN delay >= 1.5 THEN 'Moderate' ELSE 'On Time' END AS status FROM x""")
def _(s, d):
    return transit.bus_states(transit.od_routes(X.trips(s, d)), 6, 3).withColumn("progress", F.round("progress", 6))


@query("fleet_split", _TRIPS + """, f AS (SELECT route_id, 1000 // count(*) OVER () + (row_number() OVER (ORDER BY route_id) <= 1000 % count(*) OVER ())::INT AS buses FROM od)
    SELECT route_id, buses::BIGINT AS buses, (coalesce(sum(buses) OVER (ORDER BY route_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_bus FROM f""")
def _(s, d):
    return transit.fleet_split(transit.od_routes(X.trips(s, d)), 1000)


@query("route_layer", _POINTS + " SELECT route_id, string_agg(lon::VARCHAR || ' ' || lat::VARCHAR, ',' ORDER BY seq) AS path, 4 AS width, '#1f77b4' AS colour FROM pt GROUP BY route_id")
def _(s, d):
    return transit.route_layer(_points(s, d)).withColumn("path", F.array_join(F.transform("path", lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ","))


@query("skyline", _POINTS + " SELECT route_id, seq, k::INT AS k, round(lat + 0.004 * sin(2 * pi() * k / 8), 6) AS lat, round(lon + 0.004 * cos(2 * pi() * k / 8), 6) AS lon, (20 + (seq * 37 + k * 11) % 60)::INT AS height FROM pt, range(0, 8) t(k)")
def _(s, d):
    return transit.skyline(_points(s, d)).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("map_view", _POINTS + ", x AS (SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(greatest(max(lat) - min(lat), max(lon) - min(lon)), 6) AS span FROM pt) SELECT *, CASE WHEN span > 4 THEN 6 WHEN span > 2 THEN 7 WHEN span > 1 THEN 8 WHEN span > 0.5 THEN 9 WHEN span > 0.2 THEN 10 ELSE 11 END AS zoom FROM x")
def _(s, d):
    return transit.map_view(_points(s, d)).withColumns({c: F.round(c, 6) for c in ("lat", "lon", "span")})


@query("additional_routes", """WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS p, count(*) OVER () AS n FROM supplier), r AS (SELECT r, k, greatest(2, 8 - r) AS size FROM range(0, 4) a(r), range(0, 8) b(k) WHERE k < greatest(2, 8 - r))
    SELECT 'X' || (r + 1) AS route_id, (k + 1)::INT AS seq, s_suppkey AS stop_id FROM r JOIN s ON s.p = (r * 8 + CASE WHEN r % 2 = 1 THEN size - 1 - k ELSE k END) % s.n""")
def _(s, d):
    return transit.additional_routes(X.table(s, d, "supplier").select(F.col("s_suppkey").alias("stop_id")))


@query("event_lag_speed", """WITH e AS (SELECT user_id::VARCHAR AS bus_id, ts, 12.0 + value / 1000 AS lat, 77.0 + (event_id % 97) / 100.0::DOUBLE AS lon FROM events), l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS us FROM e WINDOW w AS (PARTITION BY bus_id ORDER BY ts, lat, lon))
    SELECT bus_id, ts, round(greatest(least(""" + _haversine("la", "lo", "lat", "lon") + """ / (us / 3.6e9), 110), 0), 4) AS speed FROM l WHERE us > 0""")
def _(s, d):
    return transit.derive_speed(X.positions(s, d)).select("bus_id", "ts", F.round("speed", 4).alias("speed"))


@query("hourly_avg", "SELECT hour(ts)::INT AS hour, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return transit.hourly(X.table(s, d, "events"), value="value").withColumn("avg_value", F.round("avg_value", 6))


_BANDS = "CASE WHEN value BETWEEN 0 AND 10 THEN '0-10' " + " ".join(f"WHEN value > {a} AND value <= {b} THEN '{a}-{b}'" for a, b in ((10, 20), (20, 30), (30, 40), (40, 50), (50, 60), (60, 80), (80, 120))) + " END"


@query("value_bands", "SELECT (p - 1)::INT AS place, b.band, count(e.value) AS n FROM (SELECT unnest(['0-10', '10-20', '20-30', '30-40', '40-50', '50-60', '60-80', '80-120']) AS band, generate_subscripts(['0-10', '10-20', '20-30', '30-40', '40-50', '50-60', '60-80', '80-120'], 1) AS p) b LEFT JOIN events e ON " + _BANDS + " = b.band GROUP BY ALL")
def _(s, d):
    return transit.bands(X.table(s, d, "events"), "value")


@query("slow_share", "SELECT round(avg(value), 6) AS avg_value, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0 END) * 100, 6)::DOUBLE AS slow_share, count(*) FILTER (value >= 40) AS low_traffic, count(*) FILTER (value >= 20 AND value < 40) AS medium_traffic, count(*) FILTER (value < 20) AS high_traffic FROM events")
def _(s, d):
    return transit.shares(X.table(s, d, "events"), "value").withColumns({c: F.round(c, 6) for c in ("avg_value", "slow_share")})


@query("heat_weight", "SELECT event_id, round(65 - greatest(least(coalesce(CASE WHEN event_id % 5 > 0 THEN value END, 45), 65), 0) + 1, 6) AS weight FROM events")
def _(s, d):
    return X.table(s, d, "events").select("event_id", F.round(transit.heat_weight(F.when(F.col("event_id") % 5 > 0, F.col("value"))), 6).alias("weight"))


@query("latest_50", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(s, d):
    return transit.latest(X.table(s, d, "events"), "event_id", "ts").select("event_id", "ts", "user_id")


@query("dedupe_clean", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def _(s, d):
    return transit.dedupe(X.table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("normalize_names", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(substr(sha1(p_name), 1, 8)) AS code FROM part")
def _(s, d):
    return X.table(s, d, "part").select("p_partkey", S.slugify(F.col("p_name")).alias("slug"), F.substring(S.route_id(F.col("p_name")), 4, 8).alias("code"))


@query("route_name_parts", _TRIPS + " SELECT route_id, origin, destination FROM od WHERE length(route_name) >= 7 AND NOT regexp_matches(route_name, '->\\s*[A-Za-z]\\.?$')")
def _(s, d):
    r = transit.od_routes(X.trips(s, d)).filter(transit.good_route_name(F.col("route_name")))
    a, b = S.route_ends(F.col("route_name"))
    return r.select("route_id", a.alias("origin"), b.alias("destination"))


@query("community_colours", "SELECT p_partkey, ['#1f77b4', '#ff7f0e', '#2ca02c', '#d62728', '#9467bd', '#8c564b', '#e377c2', '#7f7f7f', '#bcbd22', '#17becf', '#aec7e8', '#ffbb78', '#98df8a', '#ff9896', '#c5b0d5', '#c49c94', '#f7b6d2', '#c7c7c7', '#dbdb8d', '#9edae5'][p_size % 20 + 1] AS colour FROM part")
def _(s, d):
    return X.table(s, d, "part").select("p_partkey", S.colour(F.col("p_size")).alias("colour"))


_H = """WITH RECURSIVE c AS (SELECT s_suppkey AS src, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS dst FROM supplier), u AS MATERIALIZED (SELECT src, dst FROM c WHERE dst IS NOT NULL), e AS MATERIALIZED (SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u), v AS MATERIALIZED (SELECT DISTINCT src AS id FROM e), deg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM e GROUP BY src)"""


@query("route_analysis", _H + _pagerank_sql(5) + " SELECT id AS stop_id, round(r, 6) AS pagerank, (SELECT min(id) FROM v) AS component_id, (id - (SELECT min(id) FROM v))::INT AS distance_from_source FROM r5")
def _(s, d):
    return transit.route_analysis(X.suppliers(s, d)).withColumn("pagerank", F.round("pagerank", 6))


@query("hub_names", _H + _pagerank_sql(5) + " SELECT id AS stop_id, s_name AS stop_name, round(r, 6) AS rank_score FROM (SELECT id, round(r, 6) AS r FROM r5 ORDER BY round(r, 6) DESC, id LIMIT 10) JOIN supplier ON s_suppkey = id")
def _(s, d):
    names = X.table(s, d, "supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"))
    return transit.hubs(iterate.pagerank(X.suppliers(s, d), max_iter=5).withColumn("pagerank", F.round("pagerank", 6)), names)


def _pagerank_tol_sql(most: int) -> str:
    changes = " UNION ALL ".join(f"SELECT {k + 1} AS k, max(abs(a.r - b.r)) AS change FROM r{k + 1} a JOIN r{k} b USING (id)" for k in range(most))
    rows = " UNION ALL ".join(f"SELECT {k + 1} AS k, id, r FROM r{k + 1}" for k in range(most))
    return _H + _pagerank_sql(most) + f", ch AS MATERIALIZED ({changes}), al AS MATERIALIZED ({rows}) SELECT id, round(r, 6) AS pagerank FROM al WHERE k = (SELECT min(k) FROM ch WHERE change < 1e-3)"


@query("pagerank_tol", _pagerank_tol_sql(40))
def _(s, d):
    return iterate.pagerank(X.suppliers(s, d), tol=1e-3).withColumn("pagerank", F.round("pagerank", 6))


@query("component_rollup", "SELECT p_brand, p_size // 10 AS size_band, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size // 10)")
def _(s, d):
    return X.table(s, d, "part").withColumn("size_band", F.floor(F.col("p_size") / 10).cast("int")).rollup("p_brand", "size_band").agg(F.count(F.lit(1)).alias("n"))


_STOPS = _POINTS + """, st AS MATERIALIZED (SELECT row_number() OVER (ORDER BY first.a, first.b, stop_name) AS stop_id, stop_name, lat, lon FROM (SELECT stop AS stop_name, lat, lon, min({'a': route_id, 'b': seq}) AS first FROM pt GROUP BY stop, lat, lon))"""


@query("stop_catalog", _STOPS + " SELECT * FROM st")
def _(s, d):
    return stops.stop_catalog(_points(s, d))


def _legs(s: SparkSession, d: str) -> DataFrame:
    o = X.table(s, d, "nation")
    return o.select(F.col("n_nationkey").alias("place"), (F.pmod(F.col("n_nationkey") * 7, F.lit(25)) + 1).alias("src"), (F.pmod(F.col("n_nationkey") * 11, F.lit(40)) + 1).alias("dst"), (F.col("n_regionkey") * 1.5).alias("cost"))


_LEGS = ", lg AS (SELECT n_nationkey AS place, n_nationkey * 7 % 25 + 1 AS src, n_nationkey * 11 % 40 + 1 AS dst, (n_regionkey * 1.5)::DOUBLE AS cost FROM nation)"
_ORDER = _STOPS + _LEGS + ", f AS (SELECT stop_id, min(p) AS p FROM (SELECT src AS stop_id, place * 2 AS p FROM lg UNION ALL SELECT dst, place * 2 + 1 FROM lg) WHERE stop_id IN (SELECT stop_id FROM st) GROUP BY stop_id), ro AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY p NULLS LAST, stop_id))::INT AS seq, stop_id FROM st LEFT JOIN f USING (stop_id))"


@query("route_order", _ORDER + " SELECT seq, stop_id FROM ro")
def _(s, d):
    return stops.route_order(stops.stop_catalog(_points(s, d)), _legs(s, d))


@query("route_from_graph", _ORDER + ", z AS (SELECT arg_min(stop_name, seq) || ' -> ' || arg_max(stop_name, seq) AS route_name FROM ro JOIN st USING (stop_id)) SELECT 'R101' AS route_id, route_name, seq, stop_name AS stop, lat, lon, stop_id FROM ro JOIN st USING (stop_id), z")
def _(s, d):
    return stops.route_from_graph(stops.stop_catalog(_points(s, d)), _legs(s, d))


@query("fallback_route_names", _POINTS + ", n AS (SELECT *, CASE WHEN trip_count % 3 = 0 THEN ' ' WHEN trip_count % 3 = 1 THEN route_id ELSE route_name END AS given FROM pt) SELECT route_id, seq, CASE WHEN trim(given) = '' OR given = route_id THEN first(stop) OVER w || ' -> ' || last(stop) OVER w ELSE given END AS route_name FROM n WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(s, d):
    k = F.col("trip_count") % 3
    given = _points(s, d).withColumn("route_name", F.when(k == 0, " ").when(k == 1, F.col("route_id")).otherwise(F.col("route_name")))
    return stops.fill_route_names(given).select("route_id", "seq", "route_name")


@query("path_steps", _H + " SELECT (row_number() OVER (ORDER BY s_suppkey))::INT AS step, s_name AS stop_name, s_suppkey AS stop_id FROM supplier")
def _(s, d):
    sup = X.table(s, d, "supplier")
    from pyspark.sql import Window

    steps = sup.select(F.row_number().over(Window.orderBy("s_suppkey")).alias("step"), F.col("s_suppkey").alias("id"))
    return stops.named_steps(steps.withColumnRenamed("id", "stop_id"), sup.select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name")))


@query("path_preview", "WITH x AS (SELECT 1)" + _LEGS + " SELECT (place + 1)::INT AS step, src, dst, cost FROM lg ORDER BY place LIMIT 12")
def _(s, d):
    return stops.first_legs(_legs(s, d))


@query("find_routes", _TRIPS + " SELECT route_id, route_name, trip_count FROM od WHERE origin = 'NATION_3' AND (contains(lower(route_name), 'on_1') OR contains(lower(route_id), 'on_1') OR contains(lower(destination), 'on_1'))")
def _(s, d):
    return stops.find_routes(transit.od_routes(X.trips(s, d)), "On_1", "NATION_3").select("route_id", "route_name", "trip_count")


@query("city_match", "SELECT n_nationkey, n_name FROM nation WHERE regexp_full_match(n_name, 'nation_7', 'i')")
def _(s, d):
    return X.table(s, d, "nation").filter(stops.is_city(F.col("n_name"), "Nation_7")).select("n_nationkey", "n_name")


@query("per_bus", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg_speed FROM events GROUP BY user_id")
def _(s, d):
    return stops.per_bus(X.table(s, d, "events"), "user_id", "value").withColumn("avg_speed", F.round("avg_speed", 6))


@query("dedup_counts", "SELECT (SELECT count(*) FROM lineitem) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS rows_out")
def _(s, d):
    return stops.dedup_counts(X.table(s, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("imputed_places", """WITH kn AS (SELECT n_name AS city, 12.0 + n_nationkey * 0.37 AS lat, 75.0 + (n_nationkey * 7 % 25) * 0.21 AS lon FROM nation WHERE n_regionkey > 0),
    pr AS MATERIALIZED (SELECT n_name AS a, lead(n_name, 3) OVER (ORDER BY n_nationkey) AS b FROM nation), bo AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a AS city, b AS near FROM pr UNION ALL SELECT b, a FROM pr)), k0 AS (SELECT city, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM kn)"""
    + "".join(f""", k{k + 1} AS MATERIALIZED (SELECT * FROM k{k} UNION ALL SELECT bo.city, avg(lat) + (('0x' || substr(sha1(bo.city), 1, 4))::INT / 65535.0::DOUBLE - 0.5) * 0.18, avg(lon) + (('0x' || substr(sha1(bo.city), 5, 4))::INT / 65535.0::DOUBLE - 0.5) * 0.18 FROM bo JOIN k{k} n ON n.city = bo.near WHERE bo.city NOT IN (SELECT city FROM k{k}) GROUP BY bo.city)""" for k in range(3))
    + " SELECT city, round(lat, 6) AS lat, round(lon, 6) AS lon FROM k3")
def _(s, d):
    from pyspark.sql import Window

    n = X.table(s, d, "nation")
    pairs = n.select(F.col("n_name").alias("origin"), F.lead("n_name", 3).over(Window.orderBy("n_nationkey")).alias("destination")).filter("destination IS NOT NULL")
    known = X.cities(s, d).join(n.filter("n_regionkey > 0").select(F.col("n_name").alias("city")), "city", "left_semi")
    return transit.synthesize_coordinates(pairs, known).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


# Comparison


_KEYS = ["nodes", "edges", "density", "avg_degree", "max_degree", "triangles"]


def _metrics(s: SparkSession, g: graph.Graph, triangles: bool) -> DataFrame:
    """metric, value of a run over a graph."""
    from meshwork.sources.sinks import metrics

    size, deg = graph.summary(g).first(), graph.degree_stats(graph.degrees(g)).first()
    found = size.asDict() | {k: deg[k] for k in ("avg_degree", "max_degree")}
    return metrics(s, found | ({"triangles": graph.triangle_total(graph.triangles(g)).first()[0]} if triangles else {}))


def _compared(s: SparkSession, d: str) -> DataFrame:
    """The graph of all lines against that of lines of two items or more, whose triangles aren't counted."""
    return compare.compare_metrics(_KEYS, _metrics(s, X.parts(s, d), True), _metrics(s, X._copurchase(s, d, 2), False))


def _metrics_sql() -> str:
    second = _graph_sql(2).removeprefix("WITH RECURSIVE ")
    for name in ("u", "e", "v", "deg"):
        second = second.replace(f"{name} AS MATERIALIZED", f"{name}2 AS MATERIALIZED").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"FROM {name})", f"FROM {name}2)")
    run = lambda k: f"SELECT (SELECT count(*) FROM v{k})::DOUBLE AS nodes, (SELECT count(*) FROM u{k})::DOUBLE AS edges, 2.0::DOUBLE * (SELECT count(*) FROM u{k}) / ((SELECT count(*) FROM v{k}) * ((SELECT count(*) FROM v{k}) - 1)) AS density, (SELECT avg(2 * d) FROM deg{k}) AS avg_degree, (SELECT max(2 * d) FROM deg{k})::DOUBLE AS max_degree"
    rows = " UNION ALL ".join(f"SELECT {i} AS place, '{k}' AS metric, a.{k} AS a, b.{k} AS b, {0.02 if k in ('density', 'avg_degree') else 1e-6} AS tol FROM a, b" for i, k in enumerate(_KEYS[:-1]))
    return P + ", " + second + _TRI + f", a AS ({run('')}), b AS ({run('2')}), m AS ({rows} UNION ALL SELECT 5, 'triangles', (SELECT count(*) FROM tri)::DOUBLE, NULL, 1e-6), c AS (SELECT place::INT AS place, metric, a, b, abs(a - b) <= tol AS match FROM m)"


_STATUS = "CASE WHEN match IS NULL THEN 'specific' WHEN match THEN 'matched' ELSE 'different' END AS status"


@query("metric_compare", _metrics_sql() + f" SELECT place, metric, round(a, 9) AS a, round(b, 9) AS b, match, {_STATUS} FROM c")
def _(s, d):
    return _compared(s, d).withColumns({k: F.round(k, 9) for k in ("a", "b")})


@query("metric_mismatches", _metrics_sql() + f" SELECT metric, {_STATUS} FROM c WHERE match IS NULL OR NOT match")
def _(s, d):
    return compare.not_matching(_compared(s, d)).select("metric", "status")


@query("metric_counters", _metrics_sql() + " SELECT count(match) AS comparable, count(*) FILTER (match) AS matched FROM c")
def _(s, d):
    return compare.counters(_compared(s, d))


@query("timing_compare", """WITH t AS (SELECT event_type AS algorithm, sum(value) FILTER (ts < TIMESTAMP '2024-01-15') AS a, sum(value) FILTER (ts >= TIMESTAMP '2024-01-15' AND event_type <> 'signup') AS b FROM events GROUP BY event_type)
    SELECT algorithm, round(a, 4) AS a, round(b, 4) AS b, round(a / b, 6) AS speedup, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN abs(a - b) <= 1e-9 THEN 'tie' WHEN a < b THEN 'a' ELSE 'b' END AS winner FROM t""")
def _(s, d):
    e = X.table(s, d, "events").select(F.col("event_type").alias("algorithm"), "value", (F.col("ts").cast("timestamp") < F.lit("2024-01-15").cast("timestamp")).alias("early"))
    a, b = (e.filter(c).groupBy("algorithm").agg(F.sum("value").alias("seconds")) for c in ("early", "NOT early AND algorithm <> 'signup'"))
    return compare.compare_timings(a, b).withColumns({"a": F.round("a", 4), "b": F.round("b", 4), "speedup": F.round("speedup", 6)})


@query("topk_overlap", P + _pagerank_sql(5) + """, a AS (SELECT id FROM r5 ORDER BY round(r, 6) DESC, id LIMIT 10), z AS (SELECT id FROM r2 ORDER BY round(r, 6) DESC, id LIMIT 10) SELECT count(*) AS overlap FROM a JOIN z USING (id)""")
def _(s, d):
    g = X.parts(s, d)
    a, b = (iterate.pagerank(g, max_iter=k).withColumn("pagerank", F.round("pagerank", 6)) for k in (5, 2))
    return compare.top_overlap(a, b, "pagerank")


# Sources over text


@query("edge_list_scan", "SELECT DISTINCT l_orderkey::VARCHAR AS src, l_suppkey::VARCHAR AS dst FROM lineitem WHERE l_orderkey <> l_suppkey")
def _(s, d):
    lines = X.table(s, d, "lineitem").select(F.concat(F.lit("  "), F.col("l_orderkey").cast("string"), F.lit("\t"), F.col("l_suppkey").cast("string"), F.lit(" x")).alias("value"))
    return sources.edge_lines(lines.unionByName(s.sql("SELECT explode(array('# note', '', 'one')) AS value"))).distinct()


@query("edge_list_bigint", "SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE l_orderkey <> l_suppkey")
def _(s, d):
    lines = X.table(s, d, "lineitem").select(F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("value"))
    return sources.edge_lines(lines.unionByName(s.sql("SELECT 'src,dst' AS value")), id_type="bigint").distinct()


@query("metric_reader", "SELECT p_name AS metric, p_retailprice AS value FROM part WHERE p_partkey % 3 > 0")
def _(s, d):
    t = X.table(s, d, "part").select(F.col("p_name").alias("metric"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice").cast("string")).otherwise("N/A").alias("value"))
    return sources.read_metrics(t)


@query("table_records", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(s, d):
    return sources.records(X.table(s, d, "orders"), where="o_orderstatus = 'F'", columns=["o_orderkey", "o_totalprice"], order=[F.desc("o_totalprice"), "o_orderkey"], limit=20)


@query("collection_counts", " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in ("customer", "events", "nation", "orders", "part", "supplier")))
def _(s, d):
    out = None
    for t in ("customer", "events", "nation", "orders", "part", "supplier"):
        one = X.table(s, d, t).agg(F.lit(t).alias("collection"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# Streams, against their batch meaning


@query("stream_tumbling", "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    e = X.table(s, d, "events")
    return streams.run(streams.tumbling(streams.read(s, f"{d}/events.parquet*", e.schema), late="1 hour"), "tumbling", "complete")


@query("stream_sliding", "SELECT user_id, w AS window_start, round(avg(value), 6) AS avg_value, count(*) AS n FROM (SELECT user_id, value, unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def _(s, d):
    e = X.table(s, d, "events")
    return streams.run(streams.tumbling(streams.read(s, f"{d}/events.parquet*", e.schema), "2 hours", slide="1 hour", late="1 hour"), "sliding", "complete")


@query("stream_session", """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
    SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""")
def _(s, d):
    e = X.table(s, d, "events")
    return streams.run(streams.sessions(streams.read(s, f"{d}/events.parquet*", e.schema), late="1 hour"), "session", "complete")


@query("stream_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def _(s, d):
    e = X.table(s, d, "events")
    twice = streams.read(s, f"{d}/events.parquet*", e.schema)
    twice = twice.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.run(streams.distinct_events(twice, ["event_id"], "30 days").select("event_id", "user_id"), "dedup")


@query("stream_rates", "SELECT event_id, user_id, round((value - lv) / ((epoch_us(ts) - epoch_us(lt)) / 3.6e9), 6) AS rate FROM (SELECT *, lag(value) OVER w AS lv, lag(ts) OVER w AS lt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE ts > lt")
def _(s, d):
    e = X.table(s, d, "events")
    return streams.run(streams.rates(streams.read(s, f"{d}/events.parquet*", e.schema)), "rates").withColumn("rate", F.round("rate", 6))


@query("stream_latest", "SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(s, d):
    e = X.table(s, d, "events")
    return streams.run(streams.latest(streams.read(s, f"{d}/events.parquet*", e.schema)), "latest", "complete")


# Streams that give final rows and forget the rest; what the watermark hasn't passed stays in their state

_PASSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
_PASSED_US = "((SELECT epoch_ms(max(ts)) - 3600000 FROM events) * 1000)"


def _events(s, d):
    return streams.read(s, f"{d}/events.parquet*", X.table(s, d, "events").schema)


@query("stream_tumbling_final", f"SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, round(avg(value), 6) AS avg_value, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_PASSED} GROUP BY ALL")
def _(s, d):
    return streams.run(streams.tumbling(_events(s, d), late="1 hour"), "tumbling-final")


@query("stream_session_final", f"""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o)
    SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 6 HOUR <= {_PASSED}""")
def _(s, d):
    return streams.run(streams.sessions(_events(s, d), late="1 hour"), "session-final")


@query("stream_followed", """WITH a AS (SELECT * FROM events WHERE event_type = 'view'), b AS (SELECT * FROM events WHERE event_type = 'purchase'),
    p AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 1 HOUR AS passed)
    SELECT a.event_id, a.user_id, a.ts, b.event_id AS next_id, b.ts AS next_ts FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR
    WHERE b.event_id IS NOT NULL OR a.ts + INTERVAL 1 HOUR < (SELECT passed FROM p)""")
def _(s, d):
    a, b = (_events(s, d).filter(F.col("event_type") == x) for x in ("view", "purchase"))
    return streams.run(streams.followed(a, b, "user_id"), "followed")


@query("stream_steady_rates", f"""WITH o AS (SELECT *, epoch_us(ts) AS t, lag(value) OVER w AS lv, lag(epoch_us(ts)) OVER w AS lt FROM events WHERE epoch_us(ts) <= {_PASSED_US} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, round((value - lv) / ((t - lt) / 3.6e9), 6) AS rate FROM o WHERE t > lt AND t - lt <= 21600000000""")
def _(s, d):
    return streams.run(streams.steady_rates(_events(s, d)), "steady-rates").withColumn("rate", F.round("rate", 6))
