"""HTML with only tags, attributes, styles and addresses that are safe to show."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What may stay.
TAGS = set(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption figure font footer"
    " h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li map mark nav ol p pre q rp rt rtc ruby s samp small span strike strong sub summary sup table tbody td th thead"
    " time tr tt u ul var wbr".split()
)
VOID = {"area", "br", "col", "hr", "img", "wbr"}
HIDDEN = {"script", "style", "noscript", "iframe", "object", "template"}
EVERYWHERE = {"dir", "lang", "style", "title"}
ATTRIBUTES = {
    "a": {"href", "hreflang"}, "bdo": {"dir"}, "blockquote": {"cite"}, "col": {"align", "char", "charoff", "span"}, "colgroup": {"align", "char", "charoff", "span"},
    "del": {"cite", "datetime"}, "font": {"color", "face", "size"}, "hr": {"align", "size", "width"}, "img": {"align", "alt", "height", "src", "width"}, "ins": {"cite", "datetime"},
    "ol": {"start"}, "q": {"cite"}, "table": {"align", "border", "cellpadding", "cellspacing", "char", "charoff", "summary", "width"}, "tbody": {"align", "char", "charoff"},
    "td": {"align", "char", "charoff", "colspan", "headers", "rowspan", "valign", "width"}, "th": {"align", "char", "charoff", "colspan", "headers", "rowspan", "scope"},
    "thead": {"align", "char", "charoff"}, "tr": {"align", "char", "charoff"},
}
ADDRESSES = {"href", "src", "cite"}
SCHEMES = {"http", "https", "mailto"}
STYLES = set(
    "background-color border border-bottom border-collapse border-color border-left border-right border-style border-top border-width clear color float font font-family"
    " font-size font-style font-variant font-weight height letter-spacing line-height list-style list-style-type margin margin-bottom margin-left margin-right margin-top"
    " max-width padding padding-bottom padding-left padding-right padding-top text-align text-decoration text-indent text-transform vertical-align white-space width word-spacing".split()
)
CLASSES = {"AA_Text"}
CLASSED = {"div", "p", "pre", "span"}


def _style(value: str) -> str:
    kept = (d.strip() for d in value.split(";") if d.partition(":")[0].strip().lower() in STYLES)
    return ";".join(d for d in kept if not re.search(r"url\s*\(|expression\s*\(|[\\<]", d, re.IGNORECASE))


def _safe(tag: str, name: str, value: str) -> str | None:
    """The value an attribute keeps; None if it goes."""
    if name == "class":
        return " ".join(c for c in value.split() if tag in CLASSED and c in CLASSES) or None
    if name not in EVERYWHERE and name not in ATTRIBUTES.get(tag, ()):
        return None
    if name == "style":
        return _style(value) or None
    if name in ADDRESSES:
        scheme = re.match(r"([^/?#:]*):", re.sub(r"[\x00-\x20\x7f-\xa0]", "", value))
        return value if scheme is None or scheme[1].lower() in SCHEMES else None
    return value


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.count, self.hidden = [], [], {}, []

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in HIDDEN:
            self.hidden += [tag] * (tag in HIDDEN)
            return
        if tag not in TAGS:
            return
        kept = {n: v for n, v in ((n, _safe(tag, n, v or "")) for n, v in reversed(attrs)) if v is not None}  # the first of a name stays
        if tag == "a":
            kept["rel"] = "noopener noreferrer"
        self.out.append(f"<{tag}{''.join(f' {n}=\"{escape(v)}\"' for n, v in sorted(kept.items()))}>")
        if tag not in VOID:
            self.open.append(tag)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do, a slash ends no element

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif self.count.get(tag):
            self.close_to(tag)

    def close_to(self, tag=None):
        """End open elements down to the innermost of a tag, or all."""
        while self.open:
            last = self.open.pop()
            self.count[last] -= 1
            self.out.append(f"</{last}>")
            if last == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(escape(data, quote=False))


def clean(html: str | None) -> str | None:
    if html is None:
        return None
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    cleaner.close_to()
    return "".join(cleaner.out)


@F.pandas_udf(StringType())
def clean_html(html: pd.Series) -> pd.Series:
    """Safe HTML: unknown tags go and leave their text, scripts and the like go whole, open elements are ended. Null stays null."""
    return html.map(clean)
