"""HTML scorecards and leaderboards with inline SVG, from reports alone; PDF where weasyprint is installed."""

from __future__ import annotations

from html import escape

from .functions.scores import clip, verdict
from .leaderboard import BenchmarkResult
from .registry import MetricResult
from .report import Report, is_scored, normalised_score
from .schema import GaugeError
from .texts import DIMENSION_TEXTS, about, reading

STYLE = "body{font:14px sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse;margin:.5em 0}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}.Excellent{background:#d8f0d8}.Good{background:#eaf5d8}.Fair{background:#fbf3d0}.Poor{background:#f8dcd8}.note{color:#666}"


def number(x: float | None) -> str:
    return "–" if x is None or x != x else f"{x:.4g}"


def bars(labels: list[str], real: list[float], synthetic: list[float]) -> str:
    """Two bars a label, in one SVG."""
    top, width = max([*real, *synthetic, 1e-12]), 18
    parts = []
    for i, (name, a, b) in enumerate(zip(labels, real, synthetic, strict=True)):
        for k, (v, colour) in enumerate(((a, "#4477aa"), (b, "#ee6677"))):
            h = 100 * v / top
            parts.append(f'<rect x="{i * width + k * 8}" y="{100 - h:.1f}" width="7" height="{h:.1f}" fill="{colour}"><title>{escape(name)}: {number(v)}</title></rect>')
    return f'<svg width="{len(labels) * width + 4}" height="102" role="img">{"".join(parts)}</svg>'


def scatter(real: list[list[float]], synthetic: list[list[float]]) -> str:
    points = [*real, *synthetic]
    lo, hi = [min((p[i] for p in points), default=0) for i in (0, 1)], [max((p[i] for p in points), default=1) for i in (0, 1)]
    at = lambda p, i: 200 * (p[i] - lo[i]) / ((hi[i] - lo[i]) or 1)
    dots = [f'<circle cx="{at(p, 0):.1f}" cy="{200 - at(p, 1):.1f}" r="1.5" fill="{c}" fill-opacity=".5"/>' for ps, c in ((real, "#4477aa"), (synthetic, "#ee6677")) for p in ps]
    return f'<svg width="204" height="204" role="img">{"".join(dots)}</svg>'


def plot(p: dict | None) -> str:
    if not p:
        return ""
    if p["kind"] == "scatter":
        return scatter(p["real"], p["synthetic"])
    labels = p.get("labels") or [f"{a:.4g} to {b:.4g}" for a, b in zip(p["edges"], p["edges"][1:], strict=False)]
    scale = lambda v: [x / (sum(v) or 1) for x in v] if p["kind"] == "histogram" else [x or 0 for x in v]
    return f"<p>{escape(p['column'])}</p>{bars(labels, scale(p['real']), scale(p['synthetic']))}"


def metric_rows(r: MetricResult, mode: str) -> str:
    shown = {"score": normalised_score(r)} if mode == "normalized" and is_scored(r) else r.scalars or {}
    text = ", ".join(f"{escape(k)} {number(v)}" for k, v in shown.items()) or escape(r.error or r.skip_reason or "")
    grade = verdict(normalised_score(r)) if is_scored(r) else ""
    notes = "".join(f"<div class=note>{escape(n)}</div>" for n in r.notes)
    hint = f"<div class=note>{escape(reading(r.spec.name))}</div>" if mode == "actual" else ""
    detail = ""
    if r.per_column:
        names = list(next(iter(r.per_column.values())))
        body = "".join(f"<tr><td>{escape(c)}</td>{''.join(f'<td>{number(v.get(n))}</td>' for n in names)}</tr>" for c, v in r.per_column.items())
        detail = f"<details><summary>by column</summary><table><tr><th>column</th>{''.join(f'<th>{escape(n)}</th>' for n in names)}</tr>{body}</table></details>"
    return f'<tr class="{grade}"><td>{escape(r.spec.name)}<div class=note>{escape(about(r.spec.name))}</div></td><td>{text}{hint}</td><td>{grade}</td><td>{notes}{detail}{plot(r.plot_payload)}</td></tr>'


def scorecard_html(report: Report, mode: str = "normalized", fragment: bool = False, title: str = "Scorecard") -> str:
    if mode not in ("normalized", "actual"):
        raise GaugeError(f"unknown mode {mode!r}")
    parts = [f"<h1>{escape(title)}</h1>"]
    a = report.aggregated
    parts.append("<table>" + "".join(f'<tr class="{verdict(clip(v))}"><td>{escape(c)}</td><td>{number(v)}</td><td>{verdict(clip(v))}</td></tr>' for c, v in a.items()) + "</table>")
    for c, results in report.by_c().items():
        parts.append(f"<h2>{escape(c)}</h2><p class=note>{escape(DIMENSION_TEXTS.get(c, ""))}</p><table><tr><th>metric</th><th>{'score' if mode == 'normalized' else 'values'}</th><th></th><th></th></tr>{''.join(metric_rows(r, mode) for r in results)}</table>")
    i = report.run_info
    parts.append(f"<footer class=note>seed {i.seed}, {escape(i.started_at)} to {escape(i.finished_at)}, {escape(', '.join(f'{k} {v}' for k, v in i.versions.items()))}</footer>")
    body = "\n".join(parts)
    return body if fragment else f"<!doctype html><html><head><meta charset=utf-8><title>{escape(title)}</title><style>{STYLE}</style></head><body>{body}</body></html>"


def leaderboard_html(result: BenchmarkResult, mode: str = "absolute", by: str = "overall") -> str:
    cs = result.c_scores(mode)
    dims = list(dict.fromkeys(c for v in cs.values() for c in v))
    rows = "".join(
        f"<tr><td>{i}</td><td>{escape(n)}</td><td>{number(v)}</td><td>{bars([by], [clip(v) if v == v and abs(v) != float('inf') else 0], [0])}</td>{''.join(f'<td>{number(cs[n].get(c))}</td>' for c in dims)}</tr>" for i, n, v in result.ranking(by, mode)
    )
    matrix = result.matrix(mode)
    table = "".join(f"<tr><td title='{escape(about(m))}'>{escape(m)}</td>{''.join(f'<td>{number(matrix[n].get(m))}</td>' for n in result.reports)}</tr>" for m in result.metrics)
    cards = "".join(f"<details><summary>{escape(n)}</summary>{scorecard_html(r, fragment=True, title=n)}</details>" for n, r in result.reports.items())
    notes = "".join(f"<div class=note>{escape(x)}</div>" for x in result.notes)
    heads = "".join(f"<th>{escape(n)}</th>" for n in result.reports)
    return f"<!doctype html><html><head><meta charset=utf-8><title>Leaderboard</title><style>{STYLE}</style></head><body><h1>Leaderboard</h1><table><tr><th></th><th>candidate</th><th>{escape(by)}</th><th></th>{''.join(f'<th title="{escape(DIMENSION_TEXTS.get(c, ""))}">{escape(c)}</th>' for c in dims)}</tr>{rows}</table>{notes}<h2>Metrics</h2><table><tr><th></th>{heads}</tr>{table}</table>{cards}</body></html>"


def to_pdf(html: str, path: str) -> None:
    try:
        from weasyprint import HTML
    except ImportError as e:
        raise GaugeError("PDF output needs weasyprint") from e
    HTML(string=html).write_pdf(path)
