"""Drawing a history: a page that needs no network, and the graph as DOT and JSON."""

from __future__ import annotations

import html
import json
import os
import webbrowser
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagbag.operators import topology
from dagbag.operators.history import History
from dagbag.plans.lineage import cut

MOST_ENTRIES, MOST_CHARS = 20, 300

PAGE = """<!doctype html><meta charset="utf-8"><title>history</title>
<style>body{font:13px sans-serif;display:flex}svg{flex:1}rect{fill:#f4f4f0;stroke:#555}line{stroke:#888}#side{width:24em;padding:1em;overflow:auto}</style>
<svg id="graph"></svg><div id="side"></div>
<script>
const graph = __DATA__, wide = __WIDE__, ns = "http://www.w3.org/2000/svg", svg = document.getElementById("graph");
const rows = {}, at = {};
graph.nodes.forEach(n => { (rows[n.level] ||= []).push(n); });
let far = 0, deep = 0;
Object.values(rows).forEach(r => r.forEach((n, i) => { const a = 40 + i * 190, b = 30 + n.level * 90; at[n.id] = wide ? [b * 2, a / 2] : [a, b]; far = Math.max(far, at[n.id][0]); deep = Math.max(deep, at[n.id][1]); }));
const put = (kind, attributes, text) => { const e = document.createElementNS(ns, kind); for (const k in attributes) e.setAttribute(k, attributes[k]); if (text) e.textContent = text; svg.appendChild(e); return e; };
graph.edges.forEach(e => { const [a, b] = at[e.src], [c, d] = at[e.dst]; put("line", {x1: a + 70, y1: b + 18, x2: c + 70, y2: d + 18}); if (e.label) put("text", {x: (a + c) / 2 + 74, y: (b + d) / 2 + 18, "font-size": 10}, e.label); });
graph.nodes.forEach(n => { const [x, y] = at[n.id]; const box = put("rect", {x, y, width: 140, height: 36, rx: 5}); put("text", {x: x + 6, y: y + 21}, n.label.split("\\n")[0].slice(0, 20)); box.onmouseover = () => { const side = document.getElementById("side"); side.textContent = ""; const p = document.createElement("pre"); p.textContent = n.label + "\\n\\n" + n.hover.map(h => (h.owner ? "* " : "  ") + [h.name, h.mail, h.time, h.commit].join(" ")).join("\\n"); side.appendChild(p); }; });
svg.setAttribute("width", far + 200); svg.setAttribute("height", deep + 80);
</script>
"""


def label(entries: list[tuple[str, Any]]) -> str:
    """Text of a node's or an edge's map, shortened."""
    text = lambda k: k if len(k) <= MOST_CHARS else k[:MOST_CHARS] + " . . ."
    one = lambda k, v: text(k) if v == 1 else f"{text(k)} ({v} elements)" if isinstance(v, int) else f"{text(k)} -> {v}"
    out = "\n".join(one(k, v) for k, v in entries[:MOST_ENTRIES]) or " "
    return out + ("\n . . . " if len(entries) > MOST_ENTRIES else "")


def _entries(h: History) -> dict[str, list[tuple[str, Any]]]:
    out = {}
    for node, found in h:
        out[str(node)] = [(", ".join(map(str, k)) if isinstance(k, tuple) else str(k), v) for k, v in found.items()]
    return out


def graph(h: History, contract: bool = True, remove_bypass: bool = True, edge_labels: bool = False, commits: DataFrame | None = None) -> dict:
    """What is drawn: nodes with levels, labels and hover texts, and edges.

    Edges along which nothing changes are contracted on the cluster; the drawing
    itself, which must be small to be of use, is gathered on the driver.
    """
    nodes, edges = cut(h.nodes()), cut(h.edges())
    values = cut(h.values())
    h = History.from_frames(nodes, edges, values, h.keys, h.g(), h.outer, True)
    mapping = nodes.select("node", F.col("node").alias("to"))
    if contract:
        changed = cut(_edge_changes(h).select("src", "dst").distinct())
        still = edges.join(changed, ["src", "dst"], "left_anti")
        nodes, edges, mapping = topology.contract(nodes, edges, still, remove_bypass)
    level = {str(r.node): r.level for r in topology.levels(nodes, edges).toLocalIterator()}
    kept = History.from_frames(nodes, edges, values.join(nodes, "node", "left_semi"), h.keys, h.g(), h.outer, True)
    labels = {n: label(e) for n, e in _entries(kept).items()}
    ids = {n: f"n{i}" for i, n in enumerate(sorted(labels))}
    hover: dict[str, list[dict]] = {n: [] for n in ids}
    if commits is not None:
        facts = mapping.join(commits, (F.col("node.address") == F.col("address")) & (F.col("node.sha") == F.col("sha")))
        for r in facts.orderBy("time", "sha").toLocalIterator():
            hover[str(r["to"])].append({"owner": str(r["to"]) == str(r["node"]), "name": r.author_name, "mail": r.author_mail, "time": r.time, "commit": r.sha})
    changes: dict[tuple[str, str], list] = {}
    if edge_labels:
        for r in _edge_changes(h).join(edges, ["src", "dst"], "left_semi").toLocalIterator():
            changes.setdefault((str(r.src), str(r.dst)), []).append((", ".join(str(r[k]) for k in h.keys), r[h.g().columns[0]]))
    return {
        "nodes": [{"id": ids[n], "level": level[n], "label": labels[n], "hover": hover[n]} for n in sorted(labels)],
        "edges": [{"id": f"e{i}", "src": ids[s], "dst": ids[d], "label": label(changes[s, d]) if (s, d) in changes else ""} for i, (s, d) in enumerate(sorted((str(r.src), str(r.dst)) for r in edges.toLocalIterator()))],
    }


def _edge_changes(h: History) -> DataFrame:
    """(src, dst, keys..., weights...): what changes along every edge."""
    g, e, v = h.g(), h.edges(), h.values()
    side = lambda end, sign: e.join(v, e[end] == v["node"]).select("src", "dst", *h.keys, *[(F.col(c) * sign).cast(t).alias(c) for c, t in zip(g.columns, g.types)])
    return side("dst", 1).unionAll(side("src", -1)).groupBy("src", "dst", *h.keys).agg(*g.total()).filter(g.nonzero())


def dot(drawn: dict, horizontal: bool = False) -> str:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\l") + '"'
    lines = [f"{n['id']} [label={quote(n['label'])}, shape={'box' if chr(10) in n['label'] else 'ellipse'}];" for n in drawn["nodes"]]
    lines += [f"{e['src']} -> {e['dst']} [label={quote(e['label'])}];" for e in drawn["edges"]]
    return "digraph history {\n" + ('rankdir="LR";\n' if horizontal else "") + "\n".join(lines) + "\n}\n"


def show(h: History, folder: str, contract: bool = True, remove_bypass: bool = True, edge_labels: bool = False, horizontal: bool = False, commits: DataFrame | None = None, open_browser: bool = False) -> str:
    """Write ``viewer.html``, ``graph.dot`` and ``graph.json``; gives the page's path."""
    drawn = graph(h, contract, remove_bypass, edge_labels, commits)
    os.makedirs(folder, exist_ok=True)
    page = os.path.join(folder, "viewer.html")
    with open(page, "w") as f:
        f.write(PAGE.replace("__DATA__", json.dumps(drawn).replace("</", "<\\/")).replace("__WIDE__", "true" if horizontal else "false"))
    with open(os.path.join(folder, "graph.dot"), "w") as f:
        f.write(dot(drawn, horizontal))
    with open(os.path.join(folder, "graph.json"), "w") as f:
        json.dump(drawn, f)
    if open_browser:
        webbrowser.open("file://" + html.escape(os.path.abspath(page)))
    return page
