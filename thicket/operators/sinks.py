"""Export formats as lines of text, and what a graph view shows (survey ids SNK, VIZ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.persist import numbered
from thicket.functions.text import escape_csv, escape_cypher, escape_xml, plain_number
from thicket.operators.build import Graph
from thicket.schema import PROXIMITY

FORMATS = ("json", "csv", "graphml", "cypher")
_NODE_ORDER, _EDGE_ORDER = ["id"], ["source", "target", "relation"]


def _quoted(c: str) -> Column:
    return F.concat(F.lit('"'), escape_csv(c), F.lit('"'))


def _count(c: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("string")


def csv_nodes(nodes: DataFrame) -> DataFrame:
    """SNK-02: (id, line) below the header id,label,degree,community."""
    return nodes.select("id", F.concat_ws(",", _quoted("id"), _quoted("label"), _count("degree"), _count("community")).alias("line"))


def csv_edges(edges: DataFrame) -> DataFrame:
    """SNK-02: (source, target, relation, line) below the header source,target,relation,weight."""
    return edges.select("source", "target", "relation", F.concat_ws(",", _quoted("source"), _quoted("target"), _quoted("relation"), plain_number("weight")).alias("line"))


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    """SNK-03: (id, line): a node's element, in four lines."""
    lines = F.concat(F.lit('    <node id="'), escape_xml("id"), F.lit('">\n      <data key="label">'), escape_xml("label"), F.lit('</data>\n      <data key="degree">'), _count("degree"), F.lit("</data>\n    </node>"))
    return nodes.select("id", lines.alias("line"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """SNK-03: (edge_no, line): an edge's element; ids count up in order of source, target, relation."""
    e = numbered(edges.select("source", "target", "relation", "weight"), "edge_no", *_EDGE_ORDER)
    lines = F.concat(
        F.lit('    <edge id="e'), F.col("edge_no").cast("string"), F.lit('" source="'), escape_xml("source"), F.lit('" target="'), escape_xml("target"),
        F.lit('">\n      <data key="relation">'), escape_xml("relation"), F.lit('</data>\n      <data key="weight">'), plain_number("weight"),
        F.lit("</data>\n    </edge>"),
    )
    return e.select("edge_no", lines.alias("line"))


GRAPHML_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">
  <key id="label" for="node" attr.name="label" attr.type="string"/>
  <key id="degree" for="node" attr.name="degree" attr.type="int"/>
  <key id="relation" for="edge" attr.name="relation" attr.type="string"/>
  <key id="weight" for="edge" attr.name="weight" attr.type="double"/>
  <graph id="G" edgedefault="directed">"""
GRAPHML_FOOT = "  </graph>\n</graphml>"
#: Stands before the tag that closes a node's or an edge's element, and nowhere else, as texts have no bare <.
GRAPHML_END = "\n    </"
CYPHER_HEAD = "// Concept graph as statements for a property-graph database\nCREATE INDEX concept_id IF NOT EXISTS FOR (n:Concept) ON (n.id);"


def _text(c: str) -> Column:
    return F.concat(F.lit("'"), escape_cypher(c), F.lit("'"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """SNK-04: (id, line)."""
    line = F.concat(F.lit("CREATE (n:Concept {id: "), _text("id"), F.lit(", label: "), _text("label"), F.lit(", degree: "), _count("degree"), F.lit("});"))
    return nodes.select("id", line.alias("line"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    """SNK-04: (source, target, relation, line)."""
    line = F.concat(
        F.lit("MATCH (a:Concept {id: "), _text("source"), F.lit("}), (b:Concept {id: "), _text("target"),
        F.lit("}) CREATE (a)-[:RELATES_TO {relation: "), _text("relation"), F.lit(", weight: "), plain_number("weight"), F.lit("}]->(b);"),
    )
    return edges.select("source", "target", "relation", line.alias("line"))


def _write(spark, parts: list[tuple[DataFrame | str, list[str]]], path: str) -> None:
    """Text files in path whose order by name is the order of the lines. Heads and feet are files of their own."""
    for k, (part, order) in enumerate(parts):
        df = spark.createDataFrame([(part,)], "line string").coalesce(1) if isinstance(part, str) else part.orderBy(*order).select("line")
        df.write.mode("overwrite").text(f"{path}/{k:02d}")


def export(graph: Graph, fmt: str, path: str) -> None:
    """SNK-01 to SNK-06: json, csv, graphml or cypher under the folder path: in each, numbered folders of text files
    that make the whole when put together in order (cat path/*/part-*). json has the chunks of edges, too, if there are any."""
    spark, n, e = graph.nodes.sparkSession, graph.nodes, graph.edges
    if fmt == "json":
        for name, df in (("nodes", n), ("edges", e), *((("chunks", graph.chunks),) if graph.chunks is not None else ())):
            df.write.mode("overwrite").json(f"{path}/{name}")
    elif fmt == "csv":
        _write(spark, [("id,label,degree,community", []), (csv_nodes(n), _NODE_ORDER)], f"{path}.nodes.csv")
        _write(spark, [("source,target,relation,weight", []), (csv_edges(e), _EDGE_ORDER)], f"{path}.edges.csv")
    elif fmt == "graphml":
        _write(spark, [(GRAPHML_HEAD, []), (graphml_nodes(n), _NODE_ORDER), (graphml_edges(e), ["edge_no"]), (GRAPHML_FOOT, [])], path)
    elif fmt == "cypher":
        _write(spark, [(CYPHER_HEAD, []), (cypher_nodes(n), _NODE_ORDER), (cypher_edges(e), _EDGE_ORDER)], path)
    else:
        raise ValueError(f"format must be one of {FORMATS}")


def json_document(graph: Graph) -> DataFrame:
    """SNK-01: (part, a, b, c, line): in this order, the lines of one JSON document of nodes and edges, a row each, so that
    no row holds the graph. export() writes the rows alone."""
    spark = graph.nodes.sparkSession

    def lines(df: DataFrame, part: int, order: list[str]) -> DataFrame:
        keys = [F.coalesce(F.col(c), F.lit("")) for c in order] + [F.lit("")] * (3 - len(order))
        rows = df.select(F.lit(part).alias("part"), *[k.alias(n) for k, n in zip(keys, "abc")], F.to_json(F.struct("*")).alias("line"))
        first = rows.agg(F.min(F.struct("a", "b", "c")).alias("first"))  # one row
        comma = F.when(F.struct("a", "b", "c") == F.col("first"), "").otherwise(",")
        return rows.crossJoin(F.broadcast(first)).select("part", "a", "b", "c", F.concat(comma, "line").alias("line"))

    fixed = spark.createDataFrame([(0, "", "", "", '{"nodes": ['), (2, "", "", "", '], "edges": ['), (4, "", "", "", "]}")], "part int, a string, b string, c string, line string")
    n = lines(graph.nodes.select("id", "label", "community", "degree", "entity_type", "tenant"), 1, ["id", "tenant"])
    e = lines(graph.edges.select("source", "target", "relation", "weight"), 3, ["source", "target", "relation"])
    return fixed.unionByName(n).unionByName(e)


def view_nodes(nodes: DataFrame) -> DataFrame:
    """SNK-07."""
    number = lambda c, default: F.coalesce(c, F.lit(default)).cast("long").alias(c)
    return nodes.select("id", "label", number("community", 0), number("degree", 1), F.coalesce("entity_type", F.lit("concept")).alias("entityType"))


def view_edges(edges: DataFrame) -> DataFrame:
    """SNK-07, VIZ-04: with the width an edge is drawn in."""
    near = F.col("relation") == PROXIMITY
    return edges.select(
        F.col("source").alias("from"), F.col("target").alias("to"), F.when(near, F.lit("")).otherwise(F.col("relation")).alias("label"),
        F.col("relation").alias("fullLabel"), F.col("weight").alias("value"), near.alias("isProximity"),
        F.when(near, F.lit(0.5)).otherwise(F.least(F.greatest(F.col("weight") / 2, F.lit(1.5)), F.lit(5.0))).alias("width"),
    )


def view_counts(edges: DataFrame) -> DataFrame:
    """SNK-07: one row: explicit, proximity."""
    return edges.agg(F.count_if(F.col("relation") != PROXIMITY).alias("explicit"), F.count_if(F.col("relation") == PROXIMITY).alias("proximity"))


def type_facet(nodes: DataFrame) -> DataFrame:
    """VIZ-01."""
    return nodes.groupBy(F.coalesce("entity_type", F.lit("concept")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n")).orderBy("entity_type")


PAGE = """<!doctype html><meta charset="utf-8"><title>Concept graph</title><style>body{margin:0;font:14px sans-serif}svg{width:100vw;height:94vh}line{stroke:#999}line.near{stroke:#ddd}</style>
<p><input id=q placeholder="Search"> <label><input id=p type=checkbox checked> proximity</label> <span id=c></span></p><svg id=g></svg><pre id=d></pre>
<script>const N=%s,E=%s;const at={},W=innerWidth,H=innerHeight*.94,s=document.getElementById('g'),X=(t,a)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in a)e.setAttribute(k,a[k]);s.append(e);return e};
N.forEach((n,i)=>{const r=Math.sqrt(i/N.length)*H*.48,a=i*2.4;at[n.id]=[W/2+r*Math.cos(a),H/2+r*Math.sin(a)]});
function draw(){s.textContent='';const q=document.getElementById('q').value.toLowerCase(),p=document.getElementById('p').checked;E.filter(e=>p||!e.isProximity).forEach(e=>{const a=at[e.from],b=at[e.to];if(a&&b)X('line',{x1:a[0],y1:a[1],x2:b[0],y2:b[1],'stroke-width':e.width,class:e.isProximity?'near':''})});
N.filter(n=>n.label.toLowerCase().includes(q)).forEach(n=>{const c=X('circle',{cx:at[n.id][0],cy:at[n.id][1],r:3+Math.sqrt(n.degree),fill:'hsl('+n.community*67%%360+' 60%% 50%%)'});c.onclick=()=>{document.getElementById('d').textContent=n.label+' ('+n.entityType+')\\n'+E.filter(e=>e.from==n.id||e.to==n.id).sort((a,b)=>a.isProximity-b.isProximity).map(e=>(e.from==n.id?e.to:e.from)+': '+e.fullLabel).join('\\n')};const t=X('text',{x:at[n.id][0]+6,y:at[n.id][1]});t.textContent=n.label})}
document.getElementById('c').textContent=E.filter(e=>!e.isProximity).length+' explicit, '+E.filter(e=>e.isProximity).length+' proximity';document.getElementById('q').oninput=document.getElementById('p').onchange=draw;draw()</script>"""


def view_page(graph: Graph, most_nodes: int = 500) -> str:
    """SNK-08: a page that draws the most_nodes nodes of highest degree (a view is for the eye) and the edges between them."""
    top = graph.nodes.orderBy(F.desc("degree"), "id").limit(most_nodes)
    ids = top.select("id")
    e = graph.edges.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    rows = lambda df: "[" + ",".join(df.toJSON().collect()).replace("</", "<\\/") + "]"
    return PAGE % (rows(view_nodes(top)), rows(view_edges(e)))
