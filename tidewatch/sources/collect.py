"""Collected feeds and channel pages as deliveries. Fetching is outside: both read what lies in a landing folder or a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree.ElementTree import ParseError, XMLPullParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values of the channel page format.
POST_CLASS, TEXT_CLASS, DATE_CLASS = "tgme_widget_message", "tgme_widget_message_text", "tgme_widget_message_date"
POST_URL = "https://t.me/"


def fetched(sources: DataFrame, client: Callable[[], Callable[[str, bool], tuple[int, str]]], delay: float = 1.0, parallelism: int = 8) -> DataFrame:
    """(source_id, body, status, error): one request for each source (source_id, url), some through the proxy. What goes wrong with one source is
    its row and stops no other; status is ok, http_<code> or failed. Requests of a task are delay seconds apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, first = client(), True
        for pdf in frames:
            out = []
            for source, url, proxy in zip(pdf["source_id"], pdf["url"], pdf["proxy"], strict=True):
                if not first:
                    time.sleep(delay)
                first = False
                try:
                    code, body = get(url, bool(proxy))
                    out.append((source, body, "ok", None) if code == 200 else (source, None, f"http_{code}", None))
                except Exception as e:  # noqa: BLE001  any error is this source's alone
                    out.append((source, None, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source_id", "body", "status", "error"])

    asked = sources.select("source_id", "url", T.needs_proxy(F.col("url")).alias("proxy")).repartition(parallelism, "source_id")
    return asked.mapInPandas(run, "source_id string, body string, status string, error string")


#: The names that a feed's fields have in either format, without their namespaces.
_FIELDS = {"title": ("title",), "link": ("link",), "summary": ("description", "summary", "content"), "published": ("pubDate", "published", "updated", "date")}


def entries(body: str | None) -> list[tuple[str | None, str | None, str | None, str | None]]:
    """(link, title, summary, published) of the items or entries of a feed; one that breaks off or is malformed keeps what came before."""
    parser, out = XMLPullParser(events=("end",)), []
    try:
        parser.feed(body or "")
        parser.close()
    except ParseError:
        pass
    try:
        for _, e in parser.read_events():
            if _local(e.tag) not in ("item", "entry"):
                continue
            found: dict[str, str | None] = {}
            for name, tags in _FIELDS.items():
                for t in tags:
                    child = next((c for c in e if _local(c.tag) == t and (t != "link" or c.get("rel", "alternate") == "alternate")), None)
                    if child is not None:
                        found[name] = child.get("href") if child.get("href") else "".join(child.itertext())
                        break
            out.append(tuple(found.get(k) for k in ("link", "title", "summary", "published")))
    except ParseError:
        pass
    return out


def _local(tag: object) -> str:
    return str(tag).rpartition("}")[2]


def feed_entries(bodies: DataFrame) -> DataFrame:
    """Fetched feeds (source_id, body) as entries in the form that parse_feed takes; RSS items and Atom entries alike."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(s, *e) for s, b in zip(pdf["source_id"], pdf["body"], strict=True) for e in entries(b)]
            yield pd.DataFrame(out, columns=["source_id", "link", "title", "summary", "published"])

    return bodies.select("source_id", "body").mapInPandas(run, "source_id string, link string, title string, summary string, published string")


def read_feed(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Entries of RSS files, in the form that parse_feed takes. Files without items give no rows."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    return items.select(F.lit(source_id).alias("source_id"), "link", "title", F.col("description").alias("summary"), F.col("pubDate").alias("published"))


class _Posts(HTMLParser):
    """Posts of a page: a div with a post id; inside it the first text element and the first dated time."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[str, str, str | None]] = []
        self.divs, self.post, self.body, self.dated = 0, None, None, 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        self.divs += tag == "div"
        if self.post is None:
            if tag == "div" and POST_CLASS in classes and "data-post" in a:
                self.post = {"at": self.divs, "ref": a["data-post"], "text": None, "time": None}
            return
        if self.body is not None:
            self.body["parts"].append(self.get_starttag_text())
            self.body["depth"] += tag == self.body["tag"]
        elif TEXT_CLASS in classes and self.post["text"] is None:
            self.body = {"tag": tag, "depth": 1, "parts": []}
        elif DATE_CLASS in classes:
            self.dated = self.divs + 1
        if tag == "time" and self.dated and self.post["time"] is None:
            self.post["time"] = a.get("datetime") or None

    def handle_endtag(self, tag):
        if self.body is not None:
            self.body["depth"] -= tag == self.body["tag"]
            if self.body["depth"]:
                self.body["parts"].append(f"</{tag}>")
            else:
                self._end_text()
        if tag == "div":
            if self.post is not None and self.divs == self.post["at"]:
                self.end_post()
            self.divs -= 1

    def handle_data(self, data):
        if self.body is not None:
            self.body["parts"].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def _end_text(self):
        self.post["text"], self.body = "".join(self.body["parts"]), None

    def end_post(self):
        if self.post is None:
            return
        if self.body is not None:
            self._end_text()
        self.found.append((self.post["ref"], self.post["text"] or "", self.post["time"]))
        self.post, self.dated = None, 0


def posts(page: str | None) -> list[tuple[str, str, str | None]]:
    """(post id, inner HTML or '', ISO time or None) of a page, in its order; a page that breaks off keeps its last post."""
    parser = _Posts()
    parser.feed(page or "")
    parser.close()
    parser.end_post()
    return parser.found


def channel_posts(pages: DataFrame) -> DataFrame:
    """Channel pages (source_id, html) as deliveries: source_id, external_ref, title, canonical_text, published_at. The title is the first 200 characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(s, *p) for s, page in zip(pdf["source_id"], pdf["html"], strict=True) for p in posts(page)]
            yield pd.DataFrame(out, columns=["source_id", "ref", "inner", "published"])

    raw = pages.select("source_id", "html").mapInPandas(run, "source_id string, ref string, inner string, published string")
    text = raw.select("source_id", F.concat(F.lit(POST_URL), "ref").alias("external_ref"), T.strip_html(F.col("inner")).alias("canonical_text"), "published")
    return text.select("source_id", "external_ref", F.substring("canonical_text", 1, 200).alias("title"), "canonical_text", F.try_to_timestamp("published").alias("published_at"))


def source_by_url(sources: DataFrame, url: str) -> str:
    """The id of the one registered source with this exact URL; anything else raises."""
    rows = sources.where(F.col("url") == url).select("source_id").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"no single source is registered for {url}")
    return rows[0].source_id


def channel_sources(sources: DataFrame) -> DataFrame:
    """Active channels whose preview page can be read."""
    return sources.where((F.col("source_type") == "telegram") & F.col("url").startswith(POST_URL + "s/") & F.col("is_active"))
