"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

A derived record refers to its response by ``WARC-Refers-To``, keeps the response's target, date and payload digest, and
carries the digest of its own block. Every response is handled by itself; nothing is shuffled.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import html
import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballgraph.llm.common import arrow_rows

#: Ends of lines in headers; a record ends with two of them.
CRLF = "\r\n"

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_INSIDE = re.compile(r"[^>\"']+")
_SPECIAL = re.compile(r"[>\"']")
#: Elements whose content is not text of the page.
_DROPPED = ("script", "style", "template")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACES = re.compile(r"[ \t\r\f\v\u00a0]+")
_BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "source": "src"}


class _Ends:
    """Places of strings that a scan looks for again and again; what is not there is looked for once."""

    def __init__(self, page: str):
        self.page, self.lower, self.next = page, None, {}
        self.dead, self.special = set(), []

    def find(self, what: str, at: int) -> int:
        """Where ``what`` comes next from ``at`` on, or the page's length. ``at`` never goes back."""
        found = self.next.get(what, -1)
        if found < at:
            found = self.page.find(what, at)
            found = self.next[what] = len(self.page) if found < 0 else found
        return found

    def closing(self, name: str, at: int) -> int:
        """Where the content of an element ends: behind its closing tag, or at the page's end."""
        if self.lower is None:
            self.lower = self.page.lower() if len(self.page.lower()) == len(self.page) else self.page
        key = "</" + name
        while True:
            found = self.next.get(key + ">", -1)
            if found < at:
                found = self.lower.find(key, at)
                found = self.next[key + ">"] = len(self.page) if found < 0 else found
            if found == len(self.page):
                return found
            end = found + len(key)
            while end < len(self.page) and self.page[end].isspace():
                end += 1
            if self.page[end:end + 1] == ">":
                return end + 1
            at = found + 1

    def tag(self, at: int) -> int:
        """The ``>`` that ends a tag from inside of it; quotes may hold others. The page's length if none does.

        What lies behind a tag that nothing ends is remembered, so other tags that come to the same place end there too.
        """
        page, n, path = self.page, len(self.page), []
        while at < n and at not in self.dead:
            path.append(at)
            if self.dead:
                k = bisect.bisect_left(self.special, at)
                at = self.special[k] if k < len(self.special) else n
            else:
                m = _INSIDE.match(page, at)
                at = m.end() if m else at
            c = page[at:at + 1]
            if c == ">":
                return at
            if c and -at not in self.dead:  # a quote that nothing closes is looked through once
                path.append(-at)
                at = page.find(c, at + 1) + 1 or n
            else:
                at = n
        if not self.dead:
            self.special = [m.start() for m in _SPECIAL.finditer(page)]
        self.dead.update(path)
        return n


def _markup(page: str):
    """(start, end, name, closes, attributes) of the markup of a page in one forward scan; no name for what is no tag.

    A ``<`` that opens no comment, declaration, instruction or whole tag is text.
    """
    ends, at, n = _Ends(page), 0, len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = min(ends.find("-->", at + 4) + 3, n)
            yield at, end, None, False, ""
            at = end
            continue
        m = _TAG.match(page, at)
        if m and m.group(1).lower() in _DROPPED and page[at + 1] != "/":
            end = ends.find(">", m.end())  # quotes do not count in these
            if end < n and page[end - 1] != "/":
                end = ends.closing(m.group(1).lower(), end + 1)
                yield at, end, None, False, ""
                at = end
                continue
        end = ends.tag(m.end()) if m else n
        if end < n:
            yield at, end + 1, m.group(1).lower(), page[at + 1] == "/", page[m.end():end]
            at = end + 1
        elif page[at + 1:at + 2] in ("!", "?", "/"):
            end = ends.find(">", at + 2)
            if end == n:
                at += 1
                continue
            yield at, end + 1, None, False, ""
            at = end + 1
        else:
            at += 1


def page_content(page: str) -> tuple[str, dict]:
    """(text, {title, metas, links}) of an HTML page. Text lines follow block elements.

    Comments, scripts, styles and templates go, unless their tag closes itself; the title of a drawing is not the page's.
    The page is scanned once from front to end, so long and broken pages take time in proportion to their length.
    """
    text, links, metas, title = [], [], [], None
    at, title_at, drawings = 0, None, 0
    for start, end, name, closes, inside in _markup(page):
        if start > at:
            text.append(page[at:start])
        at = end
        if name is None:
            continue
        if name in _BLOCKS:
            text.append("\n")
        if name == "svg" and not inside.endswith("/"):
            drawings = max(0, drawings + (-1 if closes else 1))
        if name == "title" and not drawings:
            if closes and title_at is not None and title is None:
                title = html.unescape("".join(text[title_at:])).strip()
            title_at = None if closes else len(text)
        elif not closes and (name in _LINKS or name == "meta"):
            values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(inside)}
            if name == "meta":
                metas.append(values)
            elif _LINKS[name] in values:
                links.append({"path": f"{name.upper()}@/{_LINKS[name]}", "url": values[_LINKS[name]]})
    text.append(page[at:])
    lines = (_SPACES.sub(" ", x).strip() for x in html.unescape("".join(text)).split("\n"))
    return "\n".join(x for x in lines if x), {"title": title, "metas": metas, "links": links}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, source: str) -> str:
    """The same derivative of the same response always has the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + ' ' + source)}>"


def record(kind: str, own: str, source: dict, content_type: str, block: str) -> str:
    """A WARC record without the two line ends that close it. ``source``: id, target, date, payload digest."""
    body = block.encode()
    one_line = lambda x: re.sub(r"[\r\n]+", " ", x)  # noqa: E731  a header holds no line end
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", source["date"]),
        ("WARC-Target-URI", one_line(source["target"])), ("WARC-Refers-To", source["id"]),
        ("WARC-Refers-To-Target-URI", one_line(source["target"])), ("WARC-Refers-To-Date", source["date"]),
        ("WARC-Payload-Digest", source["digest"]), ("WARC-Block-Digest", digest(body)),
        ("Content-Type", content_type), ("Content-Length", str(len(body))),
    ]
    return CRLF.join(["WARC/1.1", *(f"{k}: {v}" for k, v in headers), "", block])


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows (key, response_id, target_uri, warc_date, http_headers, payload) of (page_id, url, html)."""
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").alias("key"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("response_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
            F.octet_length(payload).cast("string"),
        ).alias("http_headers"),
        payload.cast("binary").alias("payload"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: its metadata record (JSON) and its conversion record (plain text).

    (key, record_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length, n_links,
    text_chars, record). Payloads are read as UTF-8, broken bytes replaced. Null payloads, headers and targets are
    empty; a null date is the epoch. Repeated responses give repeated records; other columns are ignored; an empty
    table gives no rows.
    """
    kind = responses.select("key").schema[0].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = responses.select(
        "key", text("response_id").alias("response_id"), text("target_uri").alias("target_uri"),
        F.coalesce(F.col("warc_date").cast("string"), F.lit("1970-01-01T00:00:00Z")).alias("warc_date"),
        text("http_headers").alias("http_headers"), F.coalesce("payload", F.lit(b"")).alias("payload"),
    )
    fields = (
        f"key {kind}, record_type string, record_id string, refers_to string, target_uri string, source_digest string,"
        " block_digest string, content_length bigint, n_links bigint, text_chars bigint, record string"
    )
    names = [f.split()[0] for f in fields.split(",")]

    def run(batch):
        cells = [batch[c] for c in ("key", "response_id", "target_uri", "warc_date", "http_headers", "payload")]
        out = []
        for key, own, target, date, headers, payload in zip(*cells):
            plain, page = page_content(payload.decode("utf-8", "replace"))
            source = {"id": own, "target": target, "date": date, "digest": digest(payload)}
            status, *fields_ = headers.split(CRLF)
            envelope = {
                "Envelope": {
                    "WARC-Header-Metadata": {
                        "WARC-Type": "response", "WARC-Record-ID": own, "WARC-Target-URI": target, "WARC-Date": date,
                        "WARC-Payload-Digest": source["digest"],
                    },
                    "Payload-Metadata": {"HTTP-Response-Metadata": {
                        "Response-Message": status,
                        "Headers": [h.split(": ", 1) for h in fields_ if ": " in h], "Entity-Length": len(payload),
                        "HTML-Metadata": {"Head": {"Title": page["title"], "Metas": page["metas"]}, "Links": page["links"]},
                    }},
                },
            }
            for what, block, content in (
                ("metadata", json.dumps(envelope, ensure_ascii=False), "application/json"), ("conversion", plain, "text/plain")
            ):
                name = record_id(what, own)
                body = block.encode()
                out.append((
                    key, what, name, own, target, source["digest"], digest(body), len(body), len(page["links"]),
                    len(plain), record(what, name, source, content, block),
                ))
        if out:
            yield dict(zip(names, zip(*out)))

    return arrow_rows(rows, run, fields)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes gzip-compressed WARC files, one per partition, with Spark's text writer."""
    records.select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
