"""HTML to element arrays: the one Arrow pass of the library.

The Python side only tokenizes a page into the elements the extraction rules look
at. Which links, forms, tables or texts a page has is decided by native expressions
over that array (see ``operators.pages``). Elements are numbered in document order, and
each knows the number of its last descendant, of the labels that name it and of the head
row or part it lies in, so forms and tables are read off as ranges instead of searched for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

ELEMENTS_DDL = (
    "elements ARRAY<STRUCT<seq: INT, tag: STRING, nth: INT, attrs: MAP<STRING, STRING>, "
    "text: STRING, up: ARRAY<INT>, last: INT, label: INT, named: INT, head: INT>>, body_text STRING, main_text STRING"
)
_ARROW_ELEMENTS = pa.list_(
    pa.struct(
        [
            ("seq", pa.int32()),
            ("tag", pa.string()),
            ("nth", pa.int32()),
            ("attrs", pa.map_(pa.string(), pa.string())),
            ("text", pa.string()),
            ("up", pa.list_(pa.int32())),
            ("last", pa.int32()),
            ("label", pa.int32()),
            ("named", pa.int32()),
            ("head", pa.int32()),
        ]
    )
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_KEPT = set(
    "a nav header button form input select textarea label table thead tr th td caption "
    "img link meta title h1 h2 h3 iframe".split()
)
_KEPT_CLASSES = {"menu", "btn", "button", "cta"}
# Elements whose text is read; containers keep none unless they act as a button.
_LEAVES = set("a button label th td caption title h1 h2 h3 script".split())
_FIELDS = {"input", "select", "textarea"}
# A batch of element arrays is handed over once its pages reach this many characters; elements take several times the memory of their text.
_BATCH_CHARS = 250_000
_SILENT = {"script", "style", "noscript", "svg"}
_ODD_TAG = re.compile(r"^[A-Za-z][A-Za-z0-9:-]{0,32}$")
# start tag -> (open tags it closes, tag that ends the search)
_IMPLIED_END = {
    "p": ({"p"}, {"div", "article", "section", "td", "li", "body"}),
    "li": ({"li"}, {"ul", "ol"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table", "thead", "tbody", "tfoot"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}


class _Open:
    __slots__ = ("tag", "item", "start", "clean_start", "children", "root", "silent", "read")

    def __init__(self, tag, item, start, clean_start, root, silent, read):
        self.tag, self.item, self.start, self.clean_start = tag, item, start, clean_start
        self.children, self.root, self.silent, self.read = 0, root, silent, read


class PageTokens(HTMLParser):
    """Collects the kept elements with their text and kept ancestors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.stack = [], []
        self.parts, self.clean = [], []
        self.roots = {}
        self.silent = 0
        # Numbers of the open labels, first rows and table heads; first label for each id.
        self.labels, self.firsts, self.heads = [], [], []
        self.label_for = {}

    def handle_starttag(self, tag, attrs):
        ends, stop = _IMPLIED_END.get(tag, ((), ()))
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in ends:
                    self._close_to(i)
                    break
                if self.stack[i].tag in stop:
                    break
        if tag == "tr" and self.stack and self.stack[-1].tag == "table":
            self.handle_starttag("tbody", [])
        named = {k: (v or "") for k, v in attrs}
        nth = 1
        if self.stack:
            self.stack[-1].children += 1
            nth = self.stack[-1].children
        classes = set(named.get("class", "").split())
        item = None
        if (
            tag in _KEPT
            or classes & _KEPT_CLASSES
            or named.get("id") == "menu"
            or named.get("role") == "button"
            or (tag == "script" and named.get("type") == "application/ld+json")
        ):
            up = [o.item["seq"] for o in reversed(self.stack) if o.item]
            seq = len(self.items)
            item = {"seq": seq, "tag": tag, "nth": nth, "attrs": list(named.items()), "text": "", "up": up, "last": seq}
            self._number(item, tag, named)
            self.items.append(item)
        if tag in _VOID:
            return
        numbers = self._open_numbers(tag, nth)
        if numbers is not None:
            numbers.append(item["seq"])
        silent = tag in _SILENT or not _ODD_TAG.match(tag)
        self.silent += silent
        root = None
        if tag in ("main", "article", "body"):
            root = tag
        elif named.get("id") == "content":
            root = "#content"
        elif "entry-content" in classes:
            root = ".entry-content"
        if root in self.roots:
            root = None
        if root:
            self.roots[root] = None
        read = tag in _LEAVES or bool(classes & {"btn", "button"}) or named.get("role") == "button"
        self.stack.append(_Open(tag, item, len(self.parts), len(self.clean), root, silent, read))

    def _open_numbers(self, tag, nth):
        if tag == "label":
            return self.labels
        if tag == "thead":
            return self.heads
        return self.firsts if tag == "tr" and nth == 1 else None

    def _number(self, item, tag, named):
        if tag in _FIELDS and self.labels:
            item["label"] = self.labels[-1]
        elif tag == "label":
            self.label_for.setdefault(named.get("for", ""), item["seq"])
        elif tag in ("td", "th"):
            heads = self.firsts[-1:] + (self.heads[-1:] if tag == "th" else [])
            item["head"] = max(heads, default=None)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._close_to(i)
                return

    def handle_data(self, data):
        self.parts.append(data)
        if not self.silent:
            self.clean.append(data)

    def _close_to(self, i):
        while len(self.stack) > i:
            o = self.stack.pop()
            self.silent -= o.silent
            if o.item is not None:
                o.item["last"] = len(self.items) - 1
                if o.read:
                    o.item["text"] = "".join(self.parts[o.start :])
                numbers = self._open_numbers(o.tag, o.item["nth"])
                if numbers is not None:
                    numbers.pop()
            if o.root:
                self.roots[o.root] = ("".join(self.parts[o.start :]), "".join(self.clean[o.clean_start :]))

    def finish(self):
        self.close()
        self._close_to(0)
        for item in self.items:
            if item["tag"] in _FIELDS:
                item["named"] = self.label_for.get(dict(item["attrs"]).get("id") or None)
        body = self.roots.get("body") or ("".join(self.parts), "".join(self.clean))
        for root in ("main", "#content", ".entry-content", "article"):
            if self.roots.get(root):
                return self.items, body[0], self.roots[root][1].strip()
        return self.items, body[0], body[1].strip()


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("html")
        keep = [i for i in range(batch.num_columns) if i != at]
        names = [batch.schema.names[i] for i in keep] + ["elements", "body_text", "main_text"]
        start, chars, found = 0, 0, []
        for row, html in enumerate(batch.column(at)):
            text = html.as_py() or ""
            tokens = PageTokens()
            tokens.feed(text)
            found.append(tokens.finish())
            chars += len(text)
            if chars >= _BATCH_CHARS or row == batch.num_rows - 1:
                elements, bodies, mains = zip(*found)
                part = batch.slice(start, len(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in keep]
                    + [pa.array(elements, _ARROW_ELEMENTS), pa.array(bodies, pa.string()), pa.array(mains, pa.string())],
                    names=names,
                )
                start, chars, found = row + 1, 0, []


def tokenize_html(df: DataFrame) -> DataFrame:
    """Replaces the ``html`` column by ``elements``, ``body_text`` and ``main_text``.

    All other columns pass through untouched, so nothing has to be joined back.
    """
    kept = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "html"
    )
    return df.mapInArrow(_tokenize, f"{kept}, {ELEMENTS_DDL}")
