"""Reports as JSON, Markdown and HTML: standalone, with all of the data's text escaped."""

from __future__ import annotations

import html
import json

MARKDOWN = str.maketrans({c: f"&#{ord(c)};" for c in "`*#[_|"})
STYLE = "body{font-family:sans-serif;line-height:1.5;max-width:60rem;margin:2rem auto;padding:0 1rem}section{border:1px solid #bbb;border-radius:4px;padding:0 1rem;margin:1rem 0}pre{background:#eee;overflow-x:auto;padding:1rem}"
ROWS = "Rows are named by zero-based position in the input."
COMPLETE = "Complete evidence and configuration"


def _heading(data: dict) -> str:
    return "Dataset audit" if "findings" in data else "Holdout split"


def _markdown(data: dict) -> str:
    safe = lambda x: html.escape(str(x)).translate(MARKDOWN)
    parts = [f"# {_heading(data)}", ROWS]
    for f in data.get("findings", []):
        parts += [f"## {safe(f['code'])} ({safe(f['severity'])})", safe(f["message"]), f"Rows: {safe(f['rows'])}", f"What to do: {safe(f['suggestion'])}"]
    parts += [f"## {COMPLETE}", f"<pre>\n{html.escape(json.dumps(data, indent=2))}\n</pre>"]
    return "\n\n".join(parts) + "\n"


def _html(data: dict) -> str:
    safe = lambda x: html.escape(str(x))
    title = _heading(data)
    sections = [f"<section><h2>{safe(f['code'])} ({safe(f['severity'])})</h2><p>{safe(f['message'])}</p><p>Rows: {safe(f['rows'])}</p><p>What to do: {safe(f['suggestion'])}</p></section>" for f in data.get("findings", [])]
    head = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head>'
    body = [f"<h1>{title}</h1>", f"<p>{ROWS}</p>", *sections, f"<h2>{COMPLETE}</h2>", f"<pre>{safe(json.dumps(data, indent=2))}</pre>"]
    return head + "<body>" + "\n".join(body) + "</body></html>\n"


def render(result, format: str = "json") -> str:
    """An audit report or split result as text."""
    if format == "json":
        return result.to_json()
    writers = {"markdown": _markdown, "html": _html}
    if format not in writers:
        raise ValueError("A report is json, markdown or html.")
    return writers[format](result.to_dict())


def write_new(path, text: str) -> None:
    """Write a file that must not exist yet; folders above it are made."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x", encoding="utf-8") as out:
        out.write(text)
