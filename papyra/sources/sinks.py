"""Writers: corpus texts and packages, reports, JSON artefacts, a plain HTML form of reports (K1 to K4, K6)."""

from __future__ import annotations

import html
import json
import re
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names within a package and of the preprocessed text.
CORPUS, MANIFEST, ASSETS = "corpus.md", "manifest.json", "assets"
SUFFIX = "_preprocessed.txt"


def write_text(path: str | Path, text: str) -> Path:
    """K1, K3: one text on the driver's side, folders made."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return p


def write_corpus(df: DataFrame, path: str, text: str = "text", order: str = "ord") -> None:
    """K1, K8 at any size: the parts as lines of text files, range-partitioned and sorted by place; read in name order they are the corpus."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """K4: one JSON object a row."""
    df.write.mode("overwrite").json(path)


def write_artefact(path: str | Path, value: object) -> Path:
    """K4: one JSON document on the driver's side."""
    return write_text(path, json.dumps(value, ensure_ascii=False, indent=2))


class Package:
    """A folder with a text, its assets and a manifest that lists them."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)

    @classmethod
    def create(cls, folder: str | Path, text: str, source: str = "") -> Package:
        p = cls(folder)
        (p.folder / ASSETS).mkdir(parents=True, exist_ok=True)
        write_text(p.folder / CORPUS, text)
        p._manifest({"source": source, "created": time.strftime("%Y-%m-%dT%H:%M:%S"), "assets": []})
        return p

    def _manifest(self, m: dict) -> None:
        write_artefact(self.folder / MANIFEST, m)

    def manifest(self) -> dict:
        f = self.folder / MANIFEST
        return json.loads(f.read_text(encoding="utf-8")) if f.is_file() else {"source": "", "created": ""}

    def next_name(self, ext: str = ".png") -> str:
        return f"img_{len(list((self.folder / ASSETS).glob('img_*'))) + 1:03d}{ext}"

    def add(self, data: bytes, name: str | None = None) -> Path:
        """Store an asset and list all assets, by name, in the manifest."""
        out = self.folder / ASSETS / (name or self.next_name())
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_bytes(data)
        self._manifest(self.manifest() | {"assets": sorted(f.name for f in out.parent.iterdir() if f.is_file())})
        return out

    def text(self, most: int = 0) -> str:
        f = self.folder / CORPUS
        return clipped(f.read_text(encoding="utf-8", errors="replace"), most) if f.is_file() else ""


def clipped(text: str, most: int) -> str:
    return text[:most] + f"\n\n[内容已截断，仅保留前 {most} 字]" if most and len(text) > most else text


def is_package(path: str | Path | None) -> bool:
    return path is not None and (Path(path) / CORPUS).is_file()


def load_text(path: str | Path | None, most: int = 130_000) -> str:
    """Of a package or a file; '' where there is neither."""
    if is_package(path):
        return Package(path).text(most)
    return clipped(Path(path).read_text(encoding="utf-8", errors="replace"), most) if path and Path(path).is_file() else ""


def to_html(markdown: str) -> str:
    """K6: headings, rules, quotations, lists, tables, code, emphasis and links of a report as HTML."""

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        s = re.sub(r"!\[([^\]]*)\]\(([^)]+)\)", r'<img alt="\1" src="\2">', s)
        s = re.sub(r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>', s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", s)
        return re.sub(r"\*([^*]+)\*", r"<em>\1</em>", s)

    out, kind, code = [], "", False
    tags = {"ul": "</ul>", "ol": "</ol>", "table": "</table>"}
    for line in markdown.split("\n"):
        s = line.strip()
        now = "ul" if re.match(r"[-*+]\s", s) else "ol" if re.match(r"\d+\.\s", s) else "table" if s.startswith("|") else ""
        if s.startswith("```"):
            out.append("</pre>" if code else "<pre>")
            code = not code
            continue
        if code:
            out.append(html.escape(line))
            continue
        if kind and kind != now:
            out.append(tags[kind])
        if now and kind != now:
            out.append(f"<{now}>")
        kind = now
        if now in ("ul", "ol"):
            out.append(f"<li>{inline(re.sub(r'^(?:[-*+]|[0-9]+[.])\s+', '', s))}</li>")
        elif now == "table":
            cells = [c.strip() for c in s.split("|") if c.strip()]
            if not all(re.match(r"^[-:]+$", c) for c in cells):
                out.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in cells) + "</tr>")
        elif m := re.match(r"(#{1,6})\s+(.*)", s):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif re.match(r"^[-*_]{3,}$", s):
            out.append("<hr>")
        elif s.startswith(">"):
            out.append(f"<blockquote>{inline(s[1:].strip())}</blockquote>")
        elif s:
            out.append(f"<p>{inline(s)}</p>")
    return "\n".join([*out, *([tags[kind]] if kind else []), *(["</pre>"] if code else [])])
