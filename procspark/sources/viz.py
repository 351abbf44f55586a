"""Pictures of small graphs, as DOT and SVG text."""

from __future__ import annotations

from html import escape

from ..functions.expr import duration_text
from ..operators.dfg import DFG

#: Larger graphs aren't collected or drawn.
MOST_EDGES, MOST_NODES = 2_000, 15


def _collected(dfg: DFG) -> tuple[list, dict[str, int]]:
    edges = dfg.top_edges(MOST_EDGES + 1).collect()
    if len(edges) > MOST_EDGES:
        raise ValueError(f"the graph has more than {MOST_EDGES} edges; filter it first")
    names = {x for e in edges for x in (e.src, e.dst)}
    counts = {r.activity: r.n for r in dfg.activities.collect() if r.activity in names}
    return edges, counts


def _heat(part: float) -> str:
    """From pale to strong."""
    return f"#{255 - int(80 * part):02x}{250 - int(130 * part):02x}{240 - int(190 * part):02x}"


def dot(dfg: DFG) -> str:
    """Nodes by how often they occur, edges by how often they are taken; dotted where most of an edge's order is assumed."""
    edges, counts = _collected(dfg)
    most, widest = max(counts.values(), default=1), max((e.n for e in edges), default=1)
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = ["digraph dfg {", "  rankdir=LR;", "  node [shape=box, style=filled];"]
    for name, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        out.append(f"  {quote(name)} [label={quote(f'{name} ({n:,})')}, fillcolor={quote(_heat(n / most))}];")
    for e in edges:
        style = ", style=dotted" if 2 * e.ties > e.n else ""
        label = f"{e.n:,} / {duration_text(e.total_s / e.n)}"
        out.append(f"  {quote(e.src)} -> {quote(e.dst)} [label={quote(label)}, penwidth={1 + 4 * e.n / widest:.2f}{style}];")
    return "\n".join([*out, "}", ""])


def _layers(edges: list, names: list[str]) -> dict[str, int]:
    """The longest path to each node, with edges that close a cycle left out."""
    layer, after = dict.fromkeys(names, 0), {}
    reach: dict[str, set[str]] = {n: {n} for n in names}
    for e in edges:
        if e.src != e.dst and e.src not in reach[e.dst]:
            after.setdefault(e.src, []).append(e.dst)
            for n in names:
                if e.src in reach[n]:
                    reach[n] |= reach[e.dst]
    for _ in names:
        for src, dsts in after.items():
            for dst in dsts:
                layer[dst] = max(layer[dst], layer[src] + 1)
    return layer


def svg(dfg: DFG) -> str:
    """A layered drawing; more than ``MOST_NODES`` activities are an error."""
    edges, counts = _collected(dfg)
    if len(counts) > MOST_NODES:
        raise ValueError(f"{len(counts)} activities; {MOST_NODES} can be drawn at most, so filter the graph first")
    layer = _layers(edges, sorted(counts))
    rows: dict[int, int] = {}
    at = {}
    for name in sorted(counts, key=lambda n: (layer[n], -counts[n], n)):
        at[name] = (20 + 210 * layer[name], 30 + 80 * rows.setdefault(layer[name], 0))
        rows[layer[name]] += 1
    width, height = 230 + 210 * max(rows, default=0), 60 + 80 * max(rows.values(), default=0)
    most, widest = max(counts.values(), default=1), max((e.n for e in edges), default=1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for e in edges:
        (x1, y1), (x2, y2) = at[e.src], at[e.dst]
        dash = ' stroke-dasharray="3 3"' if 2 * e.ties > e.n else ""
        stroke = f'stroke="#555" fill="none" stroke-width="{1 + 4 * e.n / widest:.2f}"{dash}'
        out.append(f'<path d="M{x1 + 160},{y1 + 20} C{x1 + 190},{y1 + 20} {x2 - 30},{y2 + 20} {x2},{y2 + 20}" {stroke}/>')
    for name, (x, y) in at.items():
        out.append(f'<rect x="{x}" y="{y}" width="160" height="40" fill="{_heat(counts[name] / most)}" stroke="#333"/>')
        out.append(f'<text x="{x + 80}" y="{y + 24}" text-anchor="middle" font-size="11">{escape(name)} ({counts[name]:,})</text>')
    return "\n".join([*out, "</svg>", ""])
