"""Formulas: Unicode mathematics to LaTeX, OMML to LaTeX and back. Plain functions, and pandas UDFs around them."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and their commands.
SYMBOLS = {
    "×": r"\times", "÷": r"\div", "±": r"\pm", "∓": r"\mp", "·": r"\cdot", "∞": r"\infty", "≈": r"\approx", "≠": r"\neq", "≤": r"\leq", "≥": r"\geq",
    "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq", "⊇": r"\supseteq", "∪": r"\cup", "∩": r"\cap", "∅": r"\emptyset",
    "∀": r"\forall", "∃": r"\exists", "∄": r"\nexists", "→": r"\to", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow",
    "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "√": r"\sqrt", "∝": r"\propto", "∧": r"\wedge", "∨": r"\vee", "¬": r"\neg", "∣": r"\mid",
    "⟨": r"\langle", "⟩": r"\rangle", "⌊": r"\lfloor", "⌋": r"\rfloor", "⌈": r"\lceil", "⌉": r"\rceil", "ℝ": r"\mathbb{R}", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "ℚ": r"\mathbb{Q}", "ℂ": r"\mathbb{C}",
    "′": "'", "″": "''", "‴": "'''", "ℎ": "h",
}
# Signs that a formula may hold besides mathematical ones; how many blanks it may bridge.
AROUND = "0123456789+-*/=()[]{}^_.,;:<>!|&~\\≤≥≠≈≪≫∣"
GAP = 4
# Operators with limits, accents, and the parts of OMML by name.
NARY = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "⋀": r"\bigwedge", "⋁": r"\bigvee", "⋂": r"\bigcap", "⋃": r"\bigcup"}
ACCENTS = {"\u0302": r"\hat", "\u0303": r"\tilde", "\u0304": r"\bar", "\u0307": r"\dot", "\u0308": r"\ddot", "\u20d7": r"\vec", "\u0305": r"\overline"}
OMML = "http://schemas.openxmlformats.org/officeDocument/2006/math"
_UNMAPPED = ("BOLD SCRIPT", "BOLD FRAKTUR", "SANS-SERIF BOLD ITALIC")  # styles of letters that stay as they are


def is_math(c: str) -> bool:
    return c in SYMBOLS or 0x1D400 <= ord(c) <= 0x1D7FF or script_of(c) != ""


def script_of(c: str) -> str:
    """_{x} or ^{x} of a lowered letter or digit, or a raised digit; else ''."""
    how, _, code = unicodedata.decomposition(c).partition(" ")
    plain = chr(int(code, 16)) if how in ("<sub>", "<super>") and " " not in code else ""
    if not (plain.isascii() and (plain.isdigit() or how == "<sub>" and plain.isalpha())):
        return ""
    return ("_" if how == "<sub>" else "^") + "{" + plain + "}"


def latex_of(c: str) -> str:
    """LaTeX of one sign, commands with blanks around; others stay."""
    if c in SYMBOLS:
        s = SYMBOLS[c]
        return f" {s} " if s.startswith("\\") and not s.startswith(r"\mathbb") else s
    if script_of(c):
        return script_of(c)
    name, plain = unicodedata.name(c, ""), unicodedata.normalize("NFKC", c)
    style = name.removeprefix("MATHEMATICAL ")
    if style != name and plain.isascii() and not style.startswith(_UNMAPPED):
        return plain
    if m := re.fullmatch(r"ITALIC (CAPITAL|SMALL) ([A-Z]+)", style) if not plain.isascii() else None:
        word = {"LAMDA": "lambda"}.get(m[2], m[2].lower())
        return "o" if c == "\U0001d70a" else "\\" + (word.capitalize() if m[1] == "CAPITAL" else word)
    return c


_MATH = "".join(map(re.escape, SYMBOLS)) + "\U0001d400-\U0001d7ff⁰¹²³⁴-⁹₀-₉ₐₑₒₓₕ-ₜᵢᵣᵤᵥⱼ"
_SPAN = re.compile(rf"[{_MATH}{re.escape(AROUND)}](?:[ \n\r\t]{{0,{GAP}}}[{_MATH}{re.escape(AROUND)}])*")


def math_to_latex(text: str | None, least: int = 2) -> tuple[str | None, int]:
    """(text, formulas): runs that hold ``least`` mathematical signs as $…$, alone on their line and long as $$…$$."""
    if not text:
        return text, 0
    out, last, n = [], 0, 0
    for m in _SPAN.finditer(text):
        if sum(map(is_math, m.group())) < least:
            continue
        body = re.sub(r"[\n\r\t ]+", " ", m.group()).strip()
        latex = re.sub(r"  +", " ", "".join(map(latex_of, body))).strip()
        a, z = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        alone = text[a : z if z >= 0 else len(text)].strip() == m.group().strip()
        out += [text[last : m.start()], f"\n$$\n{latex}\n$$\n" if alone and len(latex) > 10 else f"${latex}$"]
        last, n = m.end(), n + 1
    return "".join([*out, text[last:]]), n


def with_latex(c: Column) -> Column:
    """F18 as a column: struct (text, formulas)."""

    @F.pandas_udf("text string, formulas int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([math_to_latex(t) for t in s], columns=["text", "formulas"])

    return run(c)


def _named(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def omml_to_latex(e: ET.Element | None) -> str:
    """the formula of an OMML element; unknown elements give what they hold."""
    if e is None:
        return ""
    part = lambda k: "".join(map(omml_to_latex, x)) if (x := e.find(f"{{{OMML}}}{k}")) is not None else ""
    value = lambda k, d: (x.get(f"{{{OMML}}}val", d) if (x := e.find(f"{{{OMML}}}{_named(e)}Pr/{{{OMML}}}{k}")) is not None else d)
    rows = lambda x: x.findall(f"{{{OMML}}}e")
    inside = lambda x: "".join(map(omml_to_latex, x))
    low = lambda k, mark: f"{mark}{{{s}}}" if (s := part(k)) else ""
    match _named(e):
        case "r":
            return "".join(t.text or "" for t in e.iter(f"{{{OMML}}}t"))
        case "t":
            return e.text or ""
        case "f":
            return rf"\frac{{{part('num')}}}{{{part('den')}}}"
        case "sSup" | "sSub" | "sSubSup" as k:
            return part("e") + (f"_{{{part('sub')}}}" if "Sub" in k else "") + (f"^{{{part('sup')}}}" if k.endswith("Sup") else "")
        case "rad":
            return r"\sqrt" + (f"[{d}]" if (d := part("deg")).strip() else "") + f"{{{part('e')}}}"
        case "d":
            return rf"\left{value('begChr', '(')}{part('e')}\right{value('endChr', ')')}"
        case "nary":
            sign = value("chr", "∫")
            return (NARY.get(sign) or (rf"\operatorname{{{sign}}}" if sign else r"\int")) + low("sub", "_") + low("sup", "^") + " " + part("e")
        case "acc":
            return f"{ACCENTS.get(value('chr', ''), chr(92) + 'hat')}{{{part('e')}}}"
        case "bar":
            return rf"\overline{{{part('e')}}}"
        case "eqArr":
            return r"\begin{aligned} " + r" \\ ".join(map(inside, rows(e))) + r" \end{aligned}"
        case "m":
            lines = [" & ".join(map(inside, rows(r))) for r in e.findall(f"{{{OMML}}}mr")]
            return r"\begin{matrix} " + r" \\ ".join(lines) + r" \end{matrix}"
        case k if k.endswith("Pr"):
            return ""
    return inside(e)


_LEX = re.compile(r"\\(?:[A-Za-z]+|.)|[{}^_&\[\]]|\s+|.", re.S)
_SIGNS = {v: k for k, v in SYMBOLS.items() if v.startswith("\\") and "{" not in v} | {v: k for k, v in NARY.items()}
_GREEK = {"\\" + (n.capitalize() if cap else n): chr((0x391 if cap else 0x3B1) + i + (i > 16)) for cap in (1, 0) for i, n in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split())}
_FUNCTIONS = {"\\" + f for f in "sin cos tan log ln exp lim max min sup inf det dim ker gcd arg".split()}


class _Latex:
    """Recursive descent over the tokens of a formula; every method returns elements."""

    def __init__(self, text: str) -> None:
        self.t, self.i = _LEX.findall(text), 0

    def peek(self) -> str:
        while self.i < len(self.t) and self.t[self.i].isspace():
            self.i += 1
        return self.t[self.i] if self.i < len(self.t) else ""

    def next(self) -> str:
        x = self.peek()
        self.i += 1
        return x

    def row(self, *ends: str) -> list[ET.Element]:
        out: list[ET.Element] = []
        while (x := self.peek()) and x not in ends:
            out += self.scripted()
        return out

    def group(self) -> list[ET.Element]:
        if self.peek() != "{":
            return self.scripted(bare=True) if self.peek() else []
        self.next()
        inner = self.row("}")
        self.next()
        return inner

    def scripted(self, bare: bool = False) -> list[ET.Element]:
        base, sign = self.atom()
        found: dict[str, list[ET.Element]] = {}
        while not bare and self.peek() in ("^", "_") and self.peek():
            k = "sup" if self.next() == "^" else "sub"
            found[k] = self.group()
        if sign:  # an operator with limits takes what follows as its body
            body = self.scripted() if self.peek() and self.peek() not in ("}", "&", r"\\", r"\right", r"\end") else []
            return [element("nary", element("naryPr", element("chr", val=sign)), wrap("sub", found.get("sub", [])), wrap("sup", found.get("sup", [])), wrap("e", body))]
        if not found:
            return base
        tag = "sSubSup" if len(found) == 2 else "sSup" if "sup" in found else "sSub"
        return [element(tag, wrap("e", base), *[wrap(k, found[k]) for k in ("sub", "sup") if k in found])]

    def atom(self) -> tuple[list[ET.Element], str]:
        x = self.next()
        if x == "{":
            self.i -= 1
            return self.group(), ""
        if x in NARY.values():
            return [], next(k for k, v in NARY.items() if v == x)
        if x == r"\frac":
            return [element("f", wrap("num", self.group()), wrap("den", self.group()))], ""
        if x == r"\sqrt":
            deg = []
            if self.peek() == "[":
                self.next()
                deg = self.row("]")
                self.next()
            return [element("rad", element("radPr", *([] if deg else [element("degHide", val="1")])), wrap("deg", deg), wrap("e", self.group()))], ""
        if x in ACCENTS.values():
            sign = next(k for k, v in ACCENTS.items() if v == x)
            return [element("acc", element("accPr", element("chr", val=sign)), wrap("e", self.group()))], ""
        if x == r"\left":
            a, inner = self.next(), self.row(r"\right")
            self.next()
            z = self.next()
            side = lambda c: "" if c == "." else c.lstrip("\\")
            return [element("d", element("dPr", element("begChr", val=side(a)), element("endChr", val=side(z))), wrap("e", inner))], ""
        if x == r"\begin":
            return [self.environment()], ""
        if x in (r"\text", r"\mathrm", r"\mathbf", r"\mathit", r"\operatorname", r"\mathbb"):
            raw = ""
            if self.peek() == "{":
                self.next()
                while self.i < len(self.t) and self.t[self.i] != "}":
                    raw, self.i = raw + self.t[self.i], self.i + 1
                self.i += 1
            return [run({"R": "ℝ", "N": "ℕ", "Z": "ℤ", "Q": "ℚ", "C": "ℂ"}.get(raw, raw) if x == r"\mathbb" else raw)], ""
        return [run(_SIGNS.get(x) or _GREEK.get(x) or (x[1:] if x.startswith("\\") else x))] if x else [], ""

    def environment(self) -> ET.Element:
        name = "".join(iter(lambda: self.next() or "}", "}")).lstrip("{")
        rows: list[list[list[ET.Element]]] = [[]]
        while True:
            rows[-1].append(self.row("&", r"\\", r"\end"))
            x = self.next()
            if x == r"\\":
                rows.append([])
            elif x != "&":
                break
        while self.next() not in ("}", ""):
            pass
        if name == "aligned":
            return element("eqArr", *[wrap("e", [e for c in r for e in c]) for r in rows])
        m = element("m", *[element("mr", *[wrap("e", c) for c in r]) for r in rows])
        sides = {"pmatrix": "()", "bmatrix": "[]", "vmatrix": "||"}.get(name)
        return element("d", element("dPr", element("begChr", val=sides[0]), element("endChr", val=sides[1])), wrap("e", [m])) if sides else m


def element(name: str, *inner: ET.Element, **values: str) -> ET.Element:
    e = ET.Element(f"{{{OMML}}}{name}", {f"{{{OMML}}}{k}": v for k, v in values.items()})
    e.extend(inner)
    return e


def wrap(name: str, inner: list[ET.Element]) -> ET.Element:
    return element(name, *inner)


def run(text: str) -> ET.Element:
    r = element("r", element("t"))
    r[0].text = text
    return r


def latex_to_omml(text: str) -> ET.Element:
    """an oMath element of a formula."""
    p = _Latex(text)
    out: list[ET.Element] = []
    while p.peek():
        out += p.row("}", "&", r"\\", r"\right", r"\end")
        p.next()  # a stray end is passed over
    return wrap("oMath", out)
