"""Page inventory: the controls of HTML pages as rows, by the standard library's parser. Every text that leaves is scrubbed."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import LABEL_RULES, compiled

# Input types that are never inventoried, elements without an end, and those that are never a label.
SKIP = {"password", "submit", "button", "reset", "image", "file", "hidden"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NEVER_A_LABEL = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "input", "select", "textarea", "button", "script", "style", "noscript", "template", "head"}
STOPS = {"form", "fieldset", "table", "body", "html"}
CONTROLS = ("input", "select", "textarea")
HEADINGS = {"label", "legend", "h1", "h2", "h3", "h4"}
#: Elements that an opening tag of the same kind ends, if the page hasn't.
CLOSES = {"option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}}
BARRIERS = {"table", "select", "ul", "ol", "form", "fieldset"}
LABEL_CHARS, HOPS, MOST_OPTIONS, PATH = 200, 2, 30, 4
RULES = [(compiled(p), token) for p, token in LABEL_RULES]
#: All rules take a digit or a mail sign.
MAY = re.compile(r"[\d@]")


def squash(text: str) -> str:
    return " ".join(text.split())


def scrub(text: str) -> str:
    text = squash(text)
    if MAY.search(text):
        for pattern, token in RULES:
            text = pattern.sub(token, text)
    return text


class Node:
    """An element. What its page's passes find out about it stands in the further slots, `below` leaving the element itself out."""

    __slots__ = ("attrs", "box", "button_below", "cell", "children", "comma", "count", "end", "fields_below", "first", "nth", "of_kind", "parent", "pos", "shown", "tag", "wrap")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        todo = self.elements()[::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += n.elements()[::-1]

    def text(self, without: tuple[str, ...] = ()) -> str:
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in without:
                todo += c.children[::-1]
        return squash("".join(out))

    def hides(self) -> bool:
        style = self.attrs.get("style", "").replace(" ", "").lower()
        return "hidden" in self.attrs or "display:none" in style or "visibility:hidden" in style


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.open: Counter[str] = Counter()  # tags from the root to here

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns aren't asked for."""
        return j

    def _back_to(self, n: Node) -> None:
        while self.at is not n:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            self.root.attrs.update({k: v or "" for k, v in attrs})
            return
        ends = CLOSES.get(tag, ())
        if ends and (some := sum(self.open[t] for t in ends)):
            n, last = self.at, None
            while some and n is not self.root and n.tag not in BARRIERS:
                if n.tag in ends:
                    last, some = n, some - 1
                n = n.parent
            if last:
                self._back_to(last.parent)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent:
            self._back_to(self.at.parent)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            n = self.at
            while n.tag != tag:
                n = n.parent
            self._back_to(n.parent)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


#: Shapes (the types of controls below an element, in order) are compared as numbers of this base and modulus, and by their lengths.
BASE, MODULUS = 0x5DEECE66D1B7, (1 << 61) - 1


class Page:
    """The tree of one page, with what its controls are called.

    Two passes over all elements, parents first and then children first, find where each stands, what encloses it and what it encloses. Texts, entries
    and sections that several controls ask for are found once. So time grows with the page.
    """

    def __init__(self, html: str) -> None:
        tree = Tree()
        tree.feed(html)
        tree.close()
        self.root = tree.root
        self.by_id: dict[str, Node] = {}
        self.for_id: dict[str, Node] = {}
        self.ids: dict[str, list[int]] = defaultdict(list)
        self.texts: dict[tuple[int, bool], str] = {}
        self.memo: dict[tuple[str, int], object] = {}
        every = self._parents_first()
        self._children_first(every)
        self.nodes = every[1:]

    def _parents_first(self) -> list[Node]:
        """Places, what stands in front under the same parent, numbers among those of one tag, and what encloses each element, itself included."""
        root, every = self.root, []
        root.shown, root.box, root.wrap, root.cell, root.first, root.nth, root.of_kind = not root.hides(), None, None, None, None, 1, Counter(html=1)
        todo = [root]
        while todo:
            n = todo.pop()
            n.pos = len(every)
            every.append(n)
            kinds: Counter[str] = Counter()
            last, inner = None, n.elements()
            for c in inner:
                kinds[c.tag] += 1
                c.first, c.nth, c.of_kind = last, kinds[c.tag], kinds  # the counts are full when the loop has ended
                c.shown = n.shown and not c.hides()
                c.box, c.wrap, c.cell = (c if c.tag == "fieldset" else n.box), (c if c.tag == "label" else n.wrap), (c if c.tag in ("td", "th") else n.cell)
                last = c
            todo += inner[::-1]
            if n is not root:
                if n.attrs.get("id"):
                    self.by_id.setdefault(n.attrs["id"], n)
                    self.ids[n.attrs["id"]].append(n.pos)
                if n.tag == "label" and n.attrs.get("for"):
                    self.for_id.setdefault(n.attrs["for"], n)
        return every

    def _children_first(self, every: list[Node]) -> None:
        """Where each subtree ends, whether it holds buttons, and the shape of its controls: put together from the last to the first."""
        kinds: dict[str, int] = {}
        powers = [1]
        for n in every:
            n.end, n.fields_below, n.count, n.comma, n.button_below = n.pos + 1, 0, 0, False, False
        for n in reversed(every[1:]):
            up, size, shape, comma = n.parent, n.fields_below, n.count, n.comma
            if n.tag in CONTROLS:
                kind = (n.attrs.get("type") or n.tag).lower()
                while len(powers) <= size:
                    powers.append(powers[-1] * BASE % MODULUS)
                shape = (kinds.setdefault(kind, len(kinds) + 1) * powers[size] + shape) % MODULUS
                size, comma = size + 1, comma or "," in kind
            if size:
                while len(powers) <= up.fields_below:
                    powers.append(powers[-1] * BASE % MODULUS)
                up.count = (shape * powers[up.fields_below] + up.count) % MODULUS
                up.fields_below += size
                up.comma = up.comma or comma
            up.end = max(up.end, n.end)
            up.button_below = up.button_below or n.button_below or n.tag == "button"

    def once(self, what: str, n: Node, work: Callable[[Node], object]):
        key = (what, n.pos)
        if key not in self.memo:
            self.memo[key] = work(n)
        return self.memo[key]

    def text(self, n: Node, without: tuple[str, ...] = ()) -> str:
        key = (n.pos, bool(without))
        if key not in self.texts:
            self.texts[key] = n.text(without)
        return self.texts[key]

    def raw_label(self, el: Node) -> tuple[str, str]:
        """What names a control and how that was found: nine ways, the surest first."""
        a = el.attrs
        if a.get("aria-label"):
            return a["aria-label"].strip(), "aria-label"
        parts = [self.text(self.by_id[i]) for i in a.get("aria-labelledby", "").split() if i in self.by_id]
        if any(parts):
            return " ".join(p for p in parts if p), "aria-labelledby"
        if a.get("id") in self.for_id and (t := self.text(self.for_id[a["id"]])):
            return t, "label[for]"
        if el.wrap and (t := self.text(el.wrap, CONTROLS)):
            return t, "wrapping-label"
        if el.cell and el.cell.first and (t := self.text(el.cell.first)):
            return t, "table-cell"
        if t := self.candidate(el.first):
            return t, "preceding-sibling"
        n = el.parent
        for _ in range(HOPS):
            if n is None or n.tag in STOPS:
                break
            if t := self.candidate(n.first):
                return t, "ancestor-sibling"
            n = n.parent
        if a.get("placeholder"):
            return a["placeholder"].strip(), "placeholder"
        return "", "none"

    def candidate(self, n: Node | None) -> str:
        """The text of an element that may be a label: no prose, no controls, not long."""
        if n is None or n.tag in NEVER_A_LABEL or n.fields_below or n.button_below:
            return ""
        t = self.text(n)
        return "" if len(t) > LABEL_CHARS else t

    def section(self, el: Node) -> str:
        legend = lambda box: next((scrub(n.text()) for n in box.walk() if n.tag == "legend"), "")
        return self.once("section", el.box, legend) if el.box else ""

    def bound(self, label: Node, unit: Node) -> bool:
        """Whether a label belongs to one of the unit's controls."""
        if label.tag != "label":
            return False
        at = self.ids.get(label.attrs.get("for") or "", ())
        k = bisect_right(at, unit.pos)
        return (k < len(at) and at[k] < unit.end) or bool(label.fields_below)

    def delimited(self, unit: Node) -> bool:
        """Whether a text of its own stands before the unit's first control."""
        for c in unit.elements():
            if c.tag in CONTROLS or c.fields_below:
                return False
            if not self.bound(c, unit) and self.text(c):
                return True
        return False

    def twins(self, parent: Node) -> dict[tuple[int, int], tuple[dict[int, int], bool]]:
        """By shape, the numbers of the elements under a parent that have it, and whether all of them are shown."""
        groups: dict[tuple[int, int], list[Node]] = defaultdict(list)
        for c in parent.elements():
            groups[c.fields_below, c.count].append(c)
        return {k: ({c.pos: i for i, c in enumerate(cs, 1)}, all(c.shown for c in cs)) for k, cs in groups.items()}

    def entry(self, n: Node) -> int | None:
        """Its number if an element is one of several entries of one shape under its parent."""
        if not n.fields_below:
            return None
        numbers, shown = self.once("twins", n.parent, self.twins)[n.fields_below, n.count]
        return numbers[n.pos] if len(numbers) > 1 and shown and (n.fields_below > 1 or n.comma or self.once("delimited", n, self.delimited)) else None

    def instance(self, el: Node) -> int | None:
        """Which of the entries of one shape this control is in, from 1; None if it isn't in a repeating entry. The nearest one counts."""
        path, n, found = [], el.parent, None
        while n.parent is not None and n.tag != "body":
            if ("instance", n.pos) in self.memo:
                found = self.memo["instance", n.pos]
                break
            path.append(n)
            if (found := self.entry(n)) is not None:
                break
            n = n.parent
        for n in path:
            self.memo["instance", n.pos] = found
        return found

    @staticmethod
    def selector(el: Node) -> str:
        """Its id, else its tag and name, else a path of at most four steps."""
        safe = lambda s: re.sub(r"([^\w-])", r"\\\1", s)
        if el.attrs.get("id"):
            return f"#{safe(el.attrs['id'])}"
        if el.attrs.get("name"):
            return f'{el.tag}[name="{safe(el.attrs["name"])}"]'
        steps: list[str] = []
        n: Node | None = el
        while n is not None and len(steps) < PATH:
            steps.insert(0, f"{n.tag}:nth-of-type({n.nth})" if n.of_kind[n.tag] > 1 else n.tag)
            n = n.parent
        return " > ".join(steps)

    def described(self, members: list[Node], kind: str | None) -> dict:
        """One control, or a group of them under its section's heading."""
        el = members[0]
        a, how = el.attrs, "section-heading"
        if kind:
            label, options, value = self.section(el), offered([self.raw_label(m)[0] for m in members]), any("checked" in m.attrs for m in members)
        else:
            label, how = self.raw_label(el)
            label = scrub(label)
            options = offered([o.text() for o in el.walk() if o.tag == "option"]) if el.tag == "select" else None
            value = "checked" in a if a.get("type", "").lower() in ("checkbox", "radio") else bool(chosen(el))
        most = a.get("maxlength", "")
        return {
            "tag": el.tag, "type": kind or (a.get("type") or ("select" if el.tag == "select" else "text")).lower(), "name": scrub(a.get("name", "")), "id": "" if kind else scrub(a.get("id", "")),
            "label": label, "label_source": how, "section": self.section(el), "selector": self.selector(el) if not kind else f'input[name="{a.get("name", "")}"]', "placeholder": "" if kind else scrub(a.get("placeholder", "")),
            "required": any("required" in m.attrs or (not kind and m.attrs.get("aria-required") == "true") for m in members), "disabled": all("disabled" in m.attrs for m in members), "read_only": not kind and "readonly" in a,
            "max_length": int(most) if not kind and most.isdigit() else None, "visible": any(m.shown for m in members), "options": options, "has_value": value, "instance": self.instance(el), "members": len(members),
        }

    def controls(self) -> list[dict]:
        """In document order; then radios of one name as one row each, then checkboxes of one name, two or more as one."""
        single: list[tuple[list[Node], str | None]] = []
        groups: dict[str, dict[str, list[Node]]] = {"radio": {}, "checkbox": {}}
        for n in self.nodes:
            if n.tag not in CONTROLS and n.attrs.get("contenteditable") != "true":
                continue
            kind = n.attrs.get("type", "").lower()
            if kind in SKIP:
                continue
            if kind in groups and n.attrs.get("name"):
                groups[kind].setdefault(n.attrs["name"], []).append(n)
            else:
                single.append(([n], None))
        single += [(m, "radio-group") for m in groups["radio"].values()]
        single += [(m, "checkbox-group" if len(m) > 1 else None) for m in groups["checkbox"].values()]
        return [{"ref": f"c{i}", **self.described(m, kind)} for i, (m, kind) in enumerate(single, 1)]

    def counters(self) -> dict:
        legend = next((n for n in self.nodes if n.tag == "legend"), None)
        heads = [n.text() for n in self.nodes if n.tag in HEADINGS]
        return {"step_hint": scrub(legend.text()) if legend else "", "skipped_passwords": sum(n.tag == "input" and n.attrs.get("type", "").lower() == "password" for n in self.nodes), "scrubbed_strings": sum(scrub(t) != squash(t) for t in heads)}


def chosen(el: Node) -> str:
    """A control's value as the page was written."""
    if el.tag == "select":
        options = [o for o in el.walk() if o.tag == "option"]
        o = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
        return (o.attrs["value"] if "value" in o.attrs else o.text()) if o else ""
    return el.text() if el.tag == "textarea" else el.attrs.get("value", "")


def offered(texts: list[str]) -> dict:
    """count, truncated, withheld and values of options; if scrubbing changes one of them, none is shown."""
    held = [t for t in texts if t.strip()]
    shut = any(scrub(t) != squash(t) for t in held)
    return {"count": len(held), "truncated": not shut and len(held) > MOST_OPTIONS, "withheld": shut, "values": [] if shut else [scrub(t) for t in held[:MOST_OPTIONS]]}


OPTIONS = pa.struct([("count", pa.int32()), ("truncated", pa.bool_()), ("withheld", pa.bool_()), ("values", pa.list_(pa.string()))])
CONTROL = pa.struct([
    ("ref", pa.string()), ("tag", pa.string()), ("type", pa.string()), ("name", pa.string()), ("id", pa.string()), ("label", pa.string()), ("label_source", pa.string()), ("section", pa.string()), ("selector", pa.string()), ("placeholder", pa.string()),
    ("required", pa.bool_()), ("disabled", pa.bool_()), ("read_only", pa.bool_()), ("max_length", pa.int32()), ("visible", pa.bool_()), ("options", OPTIONS), ("has_value", pa.bool_()), ("instance", pa.int32()), ("members", pa.int32()),
])
CONTROL_DDL = (
    "struct<ref:string,tag:string,type:string,name:string,id:string,label:string,label_source:string,section:string,selector:string,placeholder:string,required:boolean,disabled:boolean,read_only:boolean,"
    "max_length:int,visible:boolean,options:struct<count:int,truncated:boolean,withheld:boolean,values:array<string>>,has_value:boolean,instance:int,members:int>"
)
DUMP = pa.struct([("controls", pa.list_(CONTROL)), ("step_hint", pa.string()), ("skipped_passwords", pa.int32()), ("scrubbed_strings", pa.int32())])
DUMP_DDL = f"struct<controls:array<{CONTROL_DDL}>,step_hint:string,skipped_passwords:int,scrubbed_strings:int>"


def dumped(html: str | None) -> dict:
    page = Page(html or "")
    return {"controls": page.controls(), **page.counters()}


def dumps(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, host, control_count, step_hint, skipped_passwords, scrubbed_strings, controls) of pages (page_id, url, html): the host and never the address.

    parts: into so many the pages are dealt before they are parsed, where they come in a few files.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            html = b.column("html").dictionary_encode("encode")  # of equal texts one is parsed
            d = pa.array([dumped(x) for x in html.dictionary.to_pylist()], DUMP).take(html.indices)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), d], names=["page_id", "host", "d"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)) if "url" in pages.columns else F.lit("")
    pages = pages.select("page_id", host.alias("host"), "html")
    pages = pages.repartition(parts) if parts else pages
    # Rows, not a column: of a column that is exploded Spark tests the size first, and every page would be parsed twice.
    d = pages.mapInArrow(run, T.StructType([*pages.select("page_id", "host").schema.fields, T.StructField("d", T.DataType.fromDDL(DUMP_DDL))]))
    return d.select("page_id", "host", F.size("d.controls").alias("control_count"), "d.step_hint", "d.skipped_passwords", "d.scrubbed_strings", "d.controls")


def controls(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """A row per control of each page, in order; a null page has none."""
    return dumps(pages, parts).select("page_id", F.posexplode("controls").alias("ord", "c")).select("page_id", "ord", "c.*")


def signed(controls: Column) -> Column:
    """Type, visibility and label of each control in order; a page with another signature has changed."""
    one = F.transform(controls, lambda c: F.concat_ws(":", c["type"], c["visible"].cast("int").cast("string"), c["label"]))
    return F.array_join(one, "|")


def signature(dump: DataFrame) -> DataFrame:
    """(page_id, signature) of a dump."""
    return dump.select("page_id", signed(F.col("controls")).alias("signature"))
