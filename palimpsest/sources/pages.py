"""Web pages and mail: readable text, page cards, message parts."""

from __future__ import annotations

import email
import email.policy
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is never read, and elements that end a line.
NOISE = frozenset({"script", "style", "noscript", "template", "svg", "iframe"})
BREAKS = frozenset({"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "header", "footer", "nav", "title"})


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.meta: dict[str, str] = {}
        self.title: list[str] = []
        self.icon = ""
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in NOISE:
            self.skip.append(tag)
        if tag in BREAKS:
            self.out.append("\n")
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and a.get("content") and name not in self.meta:
                self.meta[name] = a["content"].strip()
        if tag == "link" and "icon" in a.get("rel", "").lower().split() and not self.icon:
            self.icon = a.get("href", "")
        self.in_title = tag == "title" and not self.title

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag in BREAKS:
            self.out.append("\n")
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not self.skip:
            self.out.append(data)


def read_html(html: str) -> _Reader:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader


def html_text(html: str, limit: int | None = None) -> str:
    """Text of a page, a line for each block, white space collapsed."""
    lines = (" ".join(x.split()) for x in "".join(read_html(html).out).split("\n"))
    out = "\n".join(x for x in lines if x)
    return out if limit is None else out[:limit]


def _usable(value: str | None) -> str:
    """A value without template leftovers."""
    return "" if not value or "{{" in value or "${" in value else value


def page_card(html: str, url: str) -> dict[str, str]:
    """title, description, image, site and icon of a page; empty entries are left out."""
    r = read_html(html)
    m = r.meta
    first = lambda *names: next((x for n in names if (x := _usable(m.get(n)))), "")
    card = {
        "title": first("og:title", "twitter:title") or _usable(" ".join("".join(r.title).split())) or first("title"),
        "description": first("og:description", "twitter:description", "description"),
        "image": first("og:image", "twitter:image"),
        "site": first("og:site_name"),
        "icon": urljoin(url or "", r.icon) if r.icon else "",
    }
    return {k: v for k, v in card.items() if v}


@F.pandas_udf(T.StringType())
def text_of(html: pd.Series) -> pd.Series:
    return html.map(lambda x: html_text(x or ""))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def card_of(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([page_card(h or "", u or "") for h, u in zip(html, url, strict=True)])


def pages_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", text_of("html").alias("text"))


def pages_cards(pages: DataFrame) -> DataFrame:
    c = card_of("html", "url")
    return pages.select("page_id", c.alias("c")).select("page_id", *[F.col("c").getItem(k).alias(k) for k in ("title", "description", "image", "site", "icon")])


def mail_parts(raw: bytes) -> dict:
    """Headers, body text and inline images of a message; an image is named by its content id in the body."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    body = message.get_body(preferencelist=("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_type() == "text/html":
        text = html_text(re.sub(r"<img[^>]*src=[\"']cid:([^\"']+)[\"'][^>]*>", r"[image \1]", text))
    images = [p["Content-ID"].strip("<>") for p in message.walk() if p.get_content_maintype() == "image" and p["Content-ID"]]
    return {"subject": str(message["Subject"] or ""), "sender": str(message["From"] or ""), "to": str(message["To"] or ""), "date": str(message["Date"] or ""), "text": text.strip(), "images": images}


def mails(files: DataFrame) -> DataFrame:
    """path, subject, sender, to, date, text, images from a relation with path and content (as Spark's binaryFile reads it)."""

    @F.pandas_udf("struct<subject:string,sender:string,to:string,date:string,text:string,images:array<string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mail_parts(x or b"") for x in s], columns=["subject", "sender", "to", "date", "text", "images"])

    return files.select("path", run("content").alias("m")).select("path", "m.*")
