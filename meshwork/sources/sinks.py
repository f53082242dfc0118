"""Results to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.scalars import colour, rgb
from meshwork.operators.graph import top


def write_csv(df: DataFrame, path: str, files: int = 1) -> None:
    df.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def placeholder(spark: SparkSession, columns: list[str], reason: str) -> DataFrame:
    """One row for a step that didn't run: N/A, and the reason in the last column."""
    values = ", ".join(f"'{'skipped_' + reason if c == columns[-1] else 'N/A'}' AS {c}" for c in columns)
    return spark.sql(f"SELECT {values}")


def metrics(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], "metric string, value string")


def bundle(path: str, *, ranks: DataFrame, communities: DataFrame, triangles: DataFrame, components: DataFrame, degrees: DataFrame, files: int = 1) -> None:
    """The result folders of a run."""
    write_csv(top(ranks, "pagerank", 100), f"{path}/pagerank_top100")
    write_csv(communities, f"{path}/communities", files)
    write_csv(top(triangles, "triangles", 100), f"{path}/triangles_top100")
    write_csv(components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component"), f"{path}/component_sizes")
    write_csv(degrees, f"{path}/degrees", files)


def _xml(x: Column) -> Column:
    x = F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, value: a GEXF 1.2 document, a line a row; nodes: id, community, degree and, if there, influence; edges once each."""
    spark = nodes.sparkSession
    fixed = lambda n, *lines: spark.createDataFrame([(n + i, "", x) for i, x in enumerate(lines)], "place int, key string, value string")
    size = F.greatest(F.least(2 + 0.15 * F.col("degree"), F.lit(20.0)), F.lit(2.0))
    c = rgb(colour(F.col("community")))
    more = [(str(k), name, kind) for k, (name, kind) in enumerate((("community", "integer"), ("degree", "integer"), ("influence", "double"))) if name in nodes.columns]
    values = F.concat(*[F.concat(F.lit(f'<attvalue for="{k}" value="'), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit('"/>')) for k, name, _ in more])
    node = F.format_string('<node id="%s" label="%s"><attvalues>%s</attvalues><viz:color r="%d" g="%d" b="%d"/><viz:size value="%.2f"/></node>', _xml(F.col("id")), _xml(F.col("id")), values, c[0], c[1], c[2], size)
    one = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    edge = F.format_string('<edge source="%s" target="%s"/>', _xml(F.col("a")), _xml(F.col("b")))
    head = fixed(0, '<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2"><graph defaultedgetype="undirected">', '<attributes class="node">' + "".join(f'<attribute id="{k}" title="{name}" type="{kind}"/>' for k, name, kind in more) + "</attributes>", "<nodes>")
    rows = head.unionByName(nodes.select(F.lit(10).alias("place"), F.col("id").cast("string").alias("key"), node.alias("value")))
    rows = rows.unionByName(fixed(20, "</nodes>", "<edges>")).unionByName(one.select(F.lit(30).alias("place"), F.concat_ws(":", "a", "b").alias("key"), edge.alias("value")))
    return rows.unionByName(fixed(40, "</edges>", "</graph></gexf>"))


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    gexf_lines(nodes, edges).orderBy("place", "key").select("value").coalesce(1).write.mode("overwrite").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame, *, most_nodes: int = 500, most_edges: int = 2000) -> str:
    """A picture's data: the busiest nodes and the edges between them, as JSON."""
    some = top(nodes, "degree", most_nodes)
    ids = some.select("id")
    kept = edges.filter("src < dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").orderBy("src", "dst").limit(most_edges)
    n, e = (t.agg(F.to_json(F.collect_list(F.struct("*")))).first()[0] for t in (some, kept.select("src", "dst")))
    return f'{{"nodes": {n}, "links": {e}}}'


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><canvas id="c" width="1000" height="800"></canvas><script>
const g = {data}, c = document.getElementById("c").getContext("2d"), at = {{}};
g.nodes.forEach((n, i) => at[n.id] = [500 + 380 * Math.cos(i * 2.39996) * Math.sqrt(i / g.nodes.length), 400 + 380 * Math.sin(i * 2.39996) * Math.sqrt(i / g.nodes.length)]);
g.links.forEach(l => {{ c.beginPath(); c.moveTo(...at[l.src]); c.lineTo(...at[l.dst]); c.strokeStyle = "#ccc"; c.stroke(); }});
g.nodes.forEach(n => {{ c.beginPath(); c.arc(...at[n.id], 3, 0, 7); c.fillStyle = "#1f77b4"; c.fill(); }});
</script></body></html>"""


def html_page(nodes: DataFrame, edges: DataFrame, title: str = "graph", **limits) -> str:
    """A page of its own that draws the picture."""
    return _PAGE.format(title=title, data=graph_json(nodes, edges, **limits).replace("</", "<\\/"))


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 10) -> str:
    """A report of small tables."""
    out = [f"# {title}"]
    for name, t in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(t.columns) + " |", "|" + "---|" * len(t.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in t.limit(rows).collect()]
    return "\n".join(out) + "\n"


#: Sinks by name: write(df, target). Others may be added, e.g. a document store.
SINKS: dict[str, Callable[[DataFrame, str], None]] = {
    "parquet": write_parquet,
    "csv": write_csv,
    "json": lambda df, path: df.write.mode("overwrite").json(path),
    "parquet-append": lambda df, path: df.write.mode("append").parquet(path),
}
