"""Word and spreadsheet files as markdown, with the standard library's zip and XML alone. One file at a time, on executors."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def escape(cell: str) -> str:
    return cell.replace("|", "\\|").replace("\r\n", "\n").replace("\n", "<br>")


def header_names(cells: list[str]) -> list[str]:
    """Names of columns: white space collapsed, column_n for blank ones, _2, _3 for repeated ones."""
    out, seen = [], {}
    for i, c in enumerate(cells, 1):
        name = re.sub(r"\s+", " ", c).strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def table(header: list[str], rows: list[list[str]]) -> str:
    if not header:
        return "(empty table)"
    line = lambda cells: "| " + " | ".join(map(escape, cells)) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def _doc_table(node: ET.Element) -> str:
    rows = [["\n".join(_text(p) for p in cell.iter(f"{W}p")).strip() for cell in row.findall(f"{W}tc")] for row in node.findall(f"{W}tr")]
    rows = [r for r in rows if any(r)]
    if not rows:
        return "(empty table)"
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return table(header_names(rows[0]), rows[1:])


def _text(p: ET.Element) -> str:
    return "".join("\t" if n.tag == f"{W}tab" else "\n" if n.tag == f"{W}br" else n.text or "" for n in p.iter() if n.tag in (f"{W}t", f"{W}tab", f"{W}br"))


def docx(content: bytes) -> str:
    """Headings, lists, paragraphs and tables in the order of the body. A file that cannot be read gives a note, not a failure."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
            styles = {}
            if "word/styles.xml" in z.namelist():
                for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                    name = s.find(f"{W}name")
                    styles[s.get(f"{W}styleId")] = name.get(f"{W}val", "") if name is not None else ""
        out, tables = [], 0
        for node in body if body is not None else ():
            if node.tag == f"{W}tbl":
                tables += 1
                out += [f"## Table {tables}", _doc_table(node)]
            elif node.tag == f"{W}p" and (text := _text(node).strip()):
                style = node.find(f"{W}pPr/{W}pStyle")
                name = (styles.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else "").lower()
                if m := re.search(r"heading\s*(\d+)", name):
                    out.append("#" * min(6, max(1, int(m[1]))) + " " + text)
                elif "list" in name or node.find(f"{W}pPr/{W}numPr") is not None:
                    numbered = "list number" in name or re.match(r"^\d+[.)]\s+", text)
                    out.append(("1. " if numbered else "- ") + re.sub(r"^(?:[-*•]|\d+[.)])\s+", "", text))
                else:
                    out.append(text)
        return "\n\n".join(out)
    except Exception as e:  # whatever is wrong with the file belongs in its text
        return f"# Parse Error\n\n{e}"


def grid(rows: list[list[str | None]]) -> list[list[list[str | None]]]:
    """Blocks of rows between blank rows."""
    out: list[list[list[str | None]]] = [[]]
    for r in rows:
        if any(c is not None and str(c).strip() for c in r):
            out[-1].append(r)
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def cleaned(block: list[list[str | None]]) -> tuple[list[str], list[list[str]]]:
    """Blanks filled from above first, then empty columns dropped, then the first row as header."""
    width = max(map(len, block))
    rows = [[(str(c).strip() or None) if c is not None else None for c in r] + [None] * (width - len(r)) for r in block]
    for above, here in zip(rows, rows[1:], strict=False):
        for k in range(width):
            here[k] = here[k] if here[k] is not None else above[k]
    keep = [k for k in range(width) if any(r[k] is not None for r in rows)]
    header = header_names([rows[0][k] or "" for k in keep])
    data = [[r[k] or "" for k in keep] for r in rows[1:]]
    full = [k for k in range(len(keep)) if any(r[k] for r in data)] if data else list(range(len(keep)))
    return [header[k] for k in full], [[r[k] for k in full] for r in data]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[tuple[str, list[list[str | None]]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = links[s.get(R)].lstrip("/")
            node = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows, last = [], 0
            for row in node.iter(f"{S}row"):
                at = int(row.get("r", last + 1))
                rows += [[] for _ in range(at - last - 1)]
                last, cells = at, []
                for c in row.findall(f"{S}c"):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    v = c.find(f"{S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    cells[k] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                rows.append(cells)
            out.append((s.get("name", ""), rows))
    return out


def xlsx(content: bytes) -> str:
    try:
        out = []
        for name, rows in sheets(content):
            out.append(f"## Sheet: {name}")
            blocks = grid(rows)
            if not blocks:
                out.append("(empty sheet)")
            for n, b in enumerate(blocks, 1):
                out += [f"### Table {n}", table(*cleaned(b))]
        return "\n\n".join(out) or "(empty workbook)"
    except Exception as e:  # as for documents
        return f"# Parse Error\n\n{e}"
