"""File formats to blocks with locators; pure functions of bytes, run inside executors by files.py."""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

Block = dict  # text, page, chapter, item_id, char_start, char_end
Parsed = tuple[dict, list[Block]]

SUFFIXES = {".pdf": "pdf", ".epub": "epub", ".fb2": "fb2", ".fbz": "fb2", ".fb2.zip": "fb2", ".txt": "txt"}
_HEADER = re.compile(r"^(title|author|название|автор)\s*:\s*(.*)$", re.IGNORECASE)
_ADAPTERS: dict[str, Callable[[bytes, str], Parsed]] = {}


def register(name: str, adapter: Callable[[bytes, str], Parsed]) -> None:
    """A parser for a format, e.g. of PDF: (content, path) -> (metadata, blocks)."""
    if not name.strip():
        raise ValueError("a format needs a name")
    _ADAPTERS[name] = adapter


def route(path: str, head: bytes, compat: bool = False) -> str:
    """Suffix first, then what the first bytes say (compat: any zip is an epub)."""
    low = path.lower()
    if compat and head[:4] == b"PK\x03\x04" and not low.endswith(".pdf"):
        return "epub"
    for suffix in sorted(SUFFIXES, key=len, reverse=True):
        if low.endswith(suffix):
            return SUFFIXES[suffix]
    if head[:5] == b"%PDF-":
        return "pdf"
    if head[:4] == b"PK\x03\x04":
        return "epub"
    if b"<FictionBook" in head:
        return "fb2"
    if head.lstrip()[:5] == b"<?xml" or b"\0" in head:
        raise ValueError(f"No adapter registered for {path}")
    return "txt"


#: Of the letters of ordinary Russian text about this share is among the ten most frequent ones, written small.
_FREQUENT_LETTERS = "оеаинтсрвл"


def decode(content: bytes) -> str:
    """By the byte order mark, else UTF-8, else the Cyrillic code page in which the text reads most like words.

    Windows-1251 comes first where two read alike, as in a text without Cyrillic letters.
    """
    for mark, encoding in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if content.startswith(mark):
            return content.decode(encoding)
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    best, most = None, -1
    for encoding in ("cp1251", "koi8-r", "cp866"):
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        score = sum(text.count(c) for c in _FREQUENT_LETTERS)
        if score > most:
            best, most = text, score
    if best is None:
        raise ValueError("the text is in no known encoding")
    return best


def stem(path: str) -> str:
    return os.path.splitext(posixpath.basename(path))[0]


def title_from_name(path: str) -> str:
    return re.sub(r"[._-]+", " ", stem(path)).strip().title()


def block(text: str, start: int, end: int, page: int | None = None, chapter: str | None = None, item_id: str | None = None) -> Block:
    return {"text": text, "page": page, "chapter": chapter, "item_id": item_id, "char_start": start, "char_end": end}


def parse_txt(content: bytes, path: str) -> Parsed:
    text = decode(content)
    meta: dict = {}
    for line in text.splitlines()[:20]:
        m = _HEADER.match(line.strip())
        if m and m.group(2).strip():
            meta.setdefault("title" if m.group(1).casefold() in ("title", "название") else "author", m.group(2).strip())
    meta.setdefault("title", stem(path))
    blocks, at = [], 0
    for n, line in enumerate(text.splitlines(keepends=True), 1):
        body = line.strip()
        if body:
            a = at + line.index(body[0])
            blocks.append(block(body, a, a + len(body), item_id=f"line-{n}"))
        at += len(line)
    return meta, blocks


def _local(tag) -> str:
    return str(tag).rsplit("}", 1)[-1]


def _xml(content: bytes):
    if b"<!ENTITY" in content:
        raise ValueError("entity declarations are not read")
    return ElementTree.fromstring(content)


def _text(node) -> str:
    return " ".join(" ".join(node.itertext()).split())


def _first(node, *path: str):
    for name in path:
        node = next((x for x in node.iter() if _local(x.tag) == name), None) if node is not None else None
    return node


def parse_fb2(content: bytes, path: str) -> Parsed:
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            content = z.read(next((n for n in names if n.lower().endswith(".fb2")), names[0]))
    root = _xml(content)
    info = _first(root, "title-info")
    meta: dict = {}
    if info is not None:
        title, lang = _first(info, "book-title"), _first(info, "lang")
        meta["title"] = _text(title) if title is not None else None
        meta["language"] = _text(lang).lower()[:2] or None if lang is not None else None
        people = []
        for a in (x for x in info if _local(x.tag) == "author"):
            parts = {_local(x.tag): _text(x) for x in a}
            people.append(" ".join(parts[k] for k in ("first-name", "middle-name", "last-name") if parts.get(k)))
        meta["author"] = ", ".join(p for p in people if p) or None
    meta["title"] = meta.get("title") or stem(path)
    blocks, at, n = [], 0, 0
    for body in (x for x in root.iter() if _local(x.tag) == "body"):
        for section in (x for x in body.iter() if _local(x.tag) == "section"):
            n += 1
            text = _text(section)
            if not text:
                continue
            heading = next((x for x in section if _local(x.tag) == "title"), None)
            blocks.append(block(text, at, at + len(text), chapter=_text(heading) if heading is not None else None, item_id=f"section-{n}"))
            at += len(text)
    if not blocks:
        text = _text(root)
        blocks = [block(text, 0, len(text), item_id="body-1")] if text else []
    return meta, blocks


class _Html(HTMLParser):
    """Texts of h1-h6, p, li, blockquote; a nested match repeats its text in the outer one."""

    TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote"}

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, int]] = []
        self.texts: list[list[str]] = []
        self.all: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.TAGS:
            self.open.append((tag, len(self.texts)))
            self.texts.append([])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.skip:
            return
        self.all.append(data)
        for _, k in self.open:
            self.texts[k].append(data)


def html_texts(markup: str) -> list[str]:
    p = _Html()
    p.feed(markup)
    texts = [" ".join("".join(t).split()) for t in p.texts]
    return [t for t in texts if t] or [t for t in [" ".join(" ".join(p.all).split())] if t]


def parse_epub(content: bytes, path: str) -> Parsed:
    meta: dict = {}
    blocks: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = _first(_xml(z.read("META-INF/container.xml")), "rootfile").get("full-path")
        package, base = _xml(z.read(box)), posixpath.dirname(box)
        for key, tag in (("title", "title"), ("author", "creator"), ("language", "language")):
            node = _first(_first(package, "metadata"), tag) if _first(package, "metadata") is not None else None
            if node is not None and _text(node):
                meta[key] = _text(node)
        items = {x.get("id"): x for x in package.iter() if _local(x.tag) == "item"}
        for ref in (x for x in package.iter() if _local(x.tag) == "itemref"):
            item = items.get(ref.get("idref"))
            if item is None or "html" not in (item.get("media-type") or ""):
                continue
            texts, at = html_texts(decode(z.read(posixpath.normpath(posixpath.join(base, item.get("href")))))), 0
            for t in texts:
                blocks.append(block(t, at, at + len(t), chapter=texts[0], item_id=item.get("id")))
                at += len(t) + 1
    meta["title"] = meta.get("title") or title_from_name(path)
    if meta.get("language"):
        meta["language"] = meta["language"].lower()[:2]
    return meta, blocks


def order_pdf_blocks(pages: list[list[tuple[float, float, int, str]]]) -> list[Block]:
    """(x0, y0, number, text) of each page into reading order with 1-based pages and offsets per page."""
    out = []
    for page, parts in enumerate(pages, 1):
        at = 0
        for _, _, _, text in sorted(((y, x, n, t) for x, y, n, t in parts)):
            text = " ".join(text.split())
            if text:
                out.append(block(text, at, at + len(text), page=page))
                at += len(text) + 1
    return out


def ocr_status(chars: int, area: float, recognise: Callable[[], str] | None) -> tuple[str, str]:
    """(status, text) of a page: enough embedded text, else recognition if there is any."""
    if area > 0 and chars / area >= 0.001:
        return "EMBEDDED", ""
    if recognise is None:
        return "OCR_SKIPPED", ""
    try:
        text = recognise()
    except Exception:  # noqa: BLE001 - any failure of the recogniser
        return "OCR_FAILED", ""
    return ("OCR_SUCCESS", text) if text.strip() else ("OCR_EMPTY", "")


@dataclass(frozen=True)
class PdfPage:
    """What a PDF reader gives of a page: its area in points, its text blocks (x0, y0, number, text), its picture for recognition."""

    area: float
    parts: list[tuple[float, float, int, str]]
    picture: bytes | None = None


def pdf_adapter(read: Callable[[bytes], tuple[dict, list[PdfPage]]], recognise: Callable[[bytes], str] | None = None) -> Callable[[bytes, str], Parsed]:
    """A parser of PDF for register() from a reader of pages and, for pages without text of their own, a recogniser of pictures.

    A page's text is its blocks in reading order; a scanned page's, what was recognised. Every page's status goes into the
    metadata (ocr), so a file whose recognition was left out or failed can be told from an empty one.
    """

    def adapter(content: bytes, path: str) -> Parsed:
        meta, pages = read(content)
        found, states = [], []
        for page in pages:
            chars = sum(len(t.strip()) for *_, t in page.parts)
            picture = page.picture
            state, text = ocr_status(chars, page.area, (lambda: recognise(picture)) if recognise and picture else None)
            states.append(state)
            found.append([(0.0, 0.0, 0, text)] if text else page.parts)
        meta = {k: v for k, v in meta.items() if v} | {"ocr": ",".join(states)}
        meta.setdefault("title", title_from_name(path))
        return meta, order_pdf_blocks(found)

    return adapter


def parse(content: bytes, path: str, compat: bool = False) -> tuple[str, dict, list[Block]]:
    kind = route(path, content[:4096], compat)
    adapter = _ADAPTERS.get(kind)
    if adapter is None:
        raise ValueError(f"No adapter registered for {path}")
    meta, blocks = adapter(content, path)
    return kind, meta, blocks


register("txt", parse_txt)
register("fb2", parse_fb2)
register("epub", parse_epub)
