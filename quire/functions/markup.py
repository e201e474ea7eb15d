"""Markup and Unicode that built-in expressions cannot do, as Arrow functions."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "b", "i", "strong", "em", "u", "ul", "ol", "li", "br", "hr", "table", "thead", "tbody", "tr", "th", "td", "code", "pre", "blockquote", "a", "span", "div"]
ATTRIBUTES = {"a": ["href", "title", "target"], "*": ["id", "class", "dir"]}
RTL_TAGS = ["p", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "span", "div", "td"]
ARABIC = r"\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
LATIN = "A-Za-z"


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in TAGS and not self.hidden:
            kept = [(k, v or "") for k, v in attrs if k in ATTRIBUTES["*"] or k in ATTRIBUTES.get(tag, ())]
            kept = [(k, v) for k, v in kept if k != "href" or not re.match(r"(?i)[\s\x00-\x20]*(javascript|data|vbscript):", v)]
            self.out.append(f"<{tag}{''.join(f' {k}="{html.escape(v)}"' for k, v in kept)}>")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in TAGS and tag not in ("br", "hr") and not self.hidden:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(html.escape(data, quote=False))

    def handle_entityref(self, name):
        if not self.hidden:
            self.out.append(f"&{name};")

    def handle_charref(self, name):
        if not self.hidden:
            self.out.append(f"&#{name};")


def sanitize(text: str) -> str:
    """Only the allowed tags and attributes; scripts, styles and script links go, other text stays."""
    cleaner = _Cleaner()
    cleaner.feed(text)
    cleaner.close()
    return "".join(cleaner.out)


_STRONG = re.compile(f"[{LATIN}{ARABIC}]")
_ARABIC = re.compile(f"[{ARABIC}]")
_OPENING = re.compile(rf"<({'|'.join(RTL_TAGS)})([^>]*)>", re.I)
_CLOSING = re.compile(rf"</({'|'.join(RTL_TAGS)})>", re.I)


def _with_value(attrs: str, name: str, value: str, keep: bool) -> str:
    """Attributes in which ``name`` has the value, after its own one if ``keep``."""
    if f"{name}=" not in attrs:
        return f'{attrs} {name}="{value}"'
    own = lambda q: q + (m[2] + " " if keep else "") + value + q
    out, at = [], 0
    for m in re.finditer(rf"""{name}=(["'])((?:(?!\1).)*)\1""", attrs, re.S):
        out += [attrs[at : m.start()], f"{name}=", own(m[1] if keep else '"')]
        at = m.end()
    return "".join([*out, attrs[at:]])


def tag_rtl(text: str) -> str:
    """``dir="rtl"`` and the class ``arabic-text`` on elements whose first strong letter is Arabic.

    An element goes up to the first closing tag of its name; those inside it are part of its content and
    stay as they are. Each closing tag is found once, so the time grows with the text.
    """
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSING.finditer(text):
        ends.setdefault(m[1].lower(), []).append(m.span())
    turn, out, done = dict.fromkeys(ends, 0), [], 0
    for m in _OPENING.finditer(text):
        if m.start() < done:
            continue
        tag = m[1].lower()
        closings = ends.get(tag, [])
        while turn.get(tag, 0) < len(closings) and closings[turn[tag]][0] < m.end():
            turn[tag] += 1
        if turn.get(tag, 0) >= len(closings):
            continue
        start, end = closings[turn[tag]]
        first = _STRONG.search(re.sub(r"<[^>]*>", "", text[m.end() : start]))
        attrs = m[2]
        if first and _ARABIC.match(first[0]):
            attrs = _with_value(_with_value(attrs, "dir", "rtl", False), "class", "arabic-text", True)
        out += [text[done : m.start()], f"<{m[1]}{attrs}>", text[m.end() : start], f"</{m[1]}>"]
        done = end
    return "".join([*out, text[done:]])


def render(text: str) -> str:
    """A subset of Markdown as clean HTML: headings, rules, lists, quotes, tables, fenced code, emphasis, links."""
    inline = [(r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"), (r"`(.+?)`", r"<code>\1</code>"), (r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>')]

    def spans(s: str) -> str:
        for pattern, to in inline:
            s = re.sub(pattern, to, s)
        return s

    out = []
    for block in re.split(r"\n{2,}", re.sub(r"```\w*\n(.*?)```", lambda m: "<pre><code>" + html.escape(m[1]).replace("\n\n", "\n&#8203;\n") + "</code></pre>", text, flags=re.S)):
        lines = block.strip("\n").split("\n")
        heading = re.match(r"(#{1,6})\s+(.*)", lines[0])
        if block.startswith("<pre>"):
            out.append(block)
        elif heading:
            out.append(f"<h{len(heading[1])}>{spans(heading[2])}</h{len(heading[1])}>" + (render("\n".join(lines[1:])) if lines[1:] else ""))
        elif re.fullmatch(r"\s*(-{3,}|\*{3,})\s*", block):
            out.append("<hr>")
        elif len(lines) > 1 and re.fullmatch(r"\|?[\s:|-]+\|?", lines[1]) and "|" in lines[0]:
            cells = [[spans(c.strip()) for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))] for x in [lines[0], *lines[2:]]]
            head = "".join(f"<th>{c}</th>" for c in cells[0])
            body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells[1:])
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
        elif all(re.match(r"\s*[-*]\s+", x) for x in lines):
            out.append("<ul>" + "".join(f"<li>{spans(re.sub(r'^\s*[-*]\s+', '', x))}</li>" for x in lines) + "</ul>")
        elif all(re.match(r"\s*\d+\.\s+", x) for x in lines):
            out.append("<ol>" + "".join(f"<li>{spans(re.sub(r'^\s*\d+\.\s+', '', x))}</li>" for x in lines) + "</ol>")
        elif all(x.startswith(">") for x in lines):
            out.append(f"<blockquote>{spans('<br>'.join(x[1:].strip() for x in lines))}</blockquote>")
        elif block.strip():
            out.append(f"<p>{spans('<br>'.join(lines))}</p>")
    return tag_rtl(sanitize("\n".join(out)))


def slug_unicode(text: str) -> str:
    """Letters and digits of any script, lower case, single hyphens between."""
    kept = re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKC", text).lower())
    return re.sub(r"[-\s]+", "-", kept).strip("-_")


def front_matter(text: str) -> dict:
    """YAML front matter and a trailing JSON list of questions, cut out of a model's answer."""
    yaml, pairs = "", []
    asked = re.search(r"```json\s*(\[.*?\])\s*```\s*$", text, re.S)
    if asked:
        try:
            pairs = [{"question": str(x.get("question", "")), "answer": str(x.get("answer", ""))} for x in json.loads(asked[1]) if isinstance(x, dict)]
            text = re.sub(r"\n*#{1,6}[^\n]*\n[^\n`#]*$|\n*#{1,6}[^\n]*\s*$", lambda m: "\n" + m[0].strip().split("\n", 1)[1] if "\n" in m[0].strip() else "", text[: asked.start()].rstrip())
        except ValueError:
            pairs = []
    for pattern in (r"^\s*```ya?ml\s*\n(.*?)\n```\s*\n?", r"^\s*---\s*\n(.*?)\n---\s*(?:\n|$)", r"^\s*((?:[\w-]+:[^\n]*\n)+)---\s*(?:\n|$)", r"```ya?ml\s*\n(.*?)\n```\s*\n?"):
        found = re.search(pattern, text, re.S)
        if found:
            yaml, text = found[1].strip(), text[: found.start()] + text[found.end() :]
            break
    return {"text": text.strip(), "yaml": yaml, "pairs": pairs}


def _texts(f):
    def column(text: str | Column) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: f(t or ""))

        return F.pandas_udf(run, "string")(text)

    return column


sanitized = _texts(sanitize)
rtl_tagged = _texts(tag_rtl)
rendered = _texts(render)
slugged = _texts(slug_unicode)
composed = _texts(lambda t: unicodedata.normalize("NFC", t))


def split_front_matter(text: str | Column) -> Column:
    """Struct ``text, yaml, pairs`` of a model's answer."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([front_matter(t or "") for t in texts], columns=["text", "yaml", "pairs"])

    return F.pandas_udf(run, "text string, yaml string, pairs array<struct<question:string,answer:string>>")(text)
