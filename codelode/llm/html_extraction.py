"""Main text of web pages through wrappers inferred per host.

A wrapper is a union-free regular expression over page tokens, inferred by
aligning all of a host's pages: equal tokens are template; text that
differs becomes a text slot; what some pages lack becomes an optional run, and
equal-shaped siblings a repeated group. Alignment takes wrappers on both sides,
so each task infers its own and these merge. Text that the wrapper holds as
literal at its place is furniture of the site, inside an article too; slots and
groups are content. A page's text is read inside its article (its main
region where no element is marked as one), leaving out elements that are
marked as furniture.
"""

from __future__ import annotations

import difflib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import materialize, ship

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object select option button".split())
DROPPED = frozenset("head nav header footer aside form menu dialog label input".split()) | RAW
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
) | DROPPED
#: Elements that a start tag of the same kind closes.
SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
CLOSES_P = BLOCKS - frozenset(["body", "html", "p"])
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|cookies?|consent|"
    r"notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|related|recommend\w*|comments?|disqus|replies|respond|widget|toolbar|pagination|pager|"
    r"skip|hidden|login|search|copyright|legal|alert|tags?)(?:$|[\s_-])", re.I)
#: Words that stand beside one of furniture without naming anything else.
COMPANIONS = frozenset("area bar block box button buttons container form icon icons link links list section slot unit wrapper".split())
#: Elements of running text: inside an article their class or id says nothing.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th pre blockquote figure figcaption caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACES = re.compile(r"\s+")

Token = tuple[str, str, str]  # kind (open, close, text), name or text, attributes


def tokens(page: str) -> list[Token]:
    """Start tags, end tags and texts in page order; raw elements lose their content, comments go."""
    out: list[Token] = []
    at, end = 0, len(page)
    lower = None
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            out.append(("text", page[at:], ""))
            break
        if m.start() > at:
            out.append(("text", page[at : m.start()], ""))
        at = m.end()
        if m[1]:
            out.append(("close", m[1].lower(), ""))
        elif m[2]:
            name = m[2].lower()
            out.append(("open", name, m[3] or ""))
            if name in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg") and not (m[3] or "").endswith("/"):
                lower = page.lower() if lower is None or len(lower) != end else lower
                stop = lower.find(f"</{name}", at)
                at = end if stop < 0 else stop
    return out


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def is_furniture(name: str, raw: str) -> bool:
    """By the element's name, role or hiding, which hold everywhere."""
    if name in DROPPED:
        return True
    if name in ("html", "body", "article", "main") or not raw:
        return False
    marks = attributes(raw)
    if marks.get("role", "").lower() in ROLES or "hidden" in raw.lower().split() or marks.get("aria-hidden") == "true":
        return True
    return "display:none" in marks.get("style", "").replace(" ", "")


def named_furniture(name: str, marks: dict[str, str], article: bool) -> bool:
    """By class or id; inside an article only if every word of it names furniture, and never for running text."""
    if name in ("html", "body", "article", "main") or article and name not in BLOCKS or article and name in TEXTUAL:
        return False
    for value in (marks.get("class", ""), marks.get("id", "")):
        if FURNITURE.search(value) and (not article or all(x.lower() in COMPANIONS or FURNITURE.fullmatch(x) for x in re.split(r"[\s_-]+", value.strip()))):
            return True
    return False


class Block:
    """One block of a page: its text, the path of elements that hold it, and where it lies."""

    __slots__ = ("article", "furniture", "named", "path", "text")

    def __init__(self, text: str, path: str, furniture: bool, article: bool, named: int = 0):
        self.text, self.path, self.furniture, self.article = text, path, furniture, article
        self.named = named  # the element of the article that its class or id names furniture, from 1; 0: none


#: A wrapper node: ("tag", token), ("text", literal), ("slot",), ("maybe", nodes) or ("many", nodes, literals).
#: A page's stream has the first two kinds; its i-th text is its i-th block.
Node = tuple


def parse(page: str | None) -> tuple[list[Block], list[Node]]:
    """All blocks with text, in page order, and the page's stream, whose block elements are all closed. White space in a block is one space."""
    if not page:
        return [], []
    out: list[Block] = []
    stream: list[Node] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, furniture, article, named
    parts: list[str] = []
    count = 0

    def flush() -> None:
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                path = "/".join(x[0] for x in stack if x[0] in BLOCKS)
                out.append(Block(text, path, any(x[1] for x in stack), any(x[2] for x in stack), next((x[3] for x in stack if x[3]), 0)))
                stream.append(("text", text))
            parts.clear()

    def cut(depth: int) -> None:
        stream.extend(("tag", "</" + x[0]) for x in reversed(stack[depth:]) if x[0] in BLOCKS)
        del stack[depth:]

    def close(names: frozenset[str] | set[str], stop: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                flush()
                cut(depth)
                return
            if stack[depth][0] in stop:
                return

    scope = frozenset(["article", "section", "main", "div", "table", "ul", "ol", "dl", "td", "body", "aside", "nav", "footer", "header"])
    for kind, name, raw in tokens(page):
        if kind == "text":
            parts.append(name)
        elif kind == "open":
            if name in BLOCKS:
                flush()
                if name in CLOSES_P:
                    close({"p"}, scope)
                if name in SELF_CLOSING:
                    close(SELF_CLOSING[name], scope - SELF_CLOSING[name])
            elif name == "br":
                parts.append("\n")
            if name not in VOID and not raw.endswith("/"):
                drop = is_furniture(name, raw)
                marks = attributes(raw) if raw else {}
                inside = any(x[2] for x in stack)
                named = not drop and bool(marks) and named_furniture(name, marks, inside)
                if drop or named:
                    flush()
                count += named and inside
                stack.append((name, drop or named and not inside, name in ("article", "main") or marks.get("role") == "main" or marks.get("itemprop") == "articleBody", count if named and inside else 0))
                if name in BLOCKS:
                    stream.append(("tag", "<" + name + ("." + marks["class"] if marks.get("class") else "")))
        else:
            if name in BLOCKS or name in DROPPED:
                flush()
                close({name}, frozenset())
            else:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        if stack[depth][1]:
                            flush()
                        del stack[depth]
                        break
                    if stack[depth][0] in BLOCKS:
                        break
    flush()
    cut(0)
    return out, stream


def blocks(page: str | None) -> list[Block]:
    return parse(page)[0]


# ---- wrapper inference -------------------------------------------------------

#: Items of lists and tables are data: a text that comes again in them is no notice.
ITEMS = frozenset("li tr td th dt dd thead tbody tfoot".split())
#: Cells of the exact alignment; longer remainders are aligned by longest common runs.
CELLS = 250_000


def page_stream(page: str | None) -> list[Node]:
    return parse(page)[1]


def _folded(nodes: list[Node]) -> tuple[list[Node], list[list[int]]]:
    """Runs of equal-shaped siblings, and paragraphs even alone, as one repeated group; with the places of the texts each node holds."""
    texts = 0
    frames: list[list] = [[]]  # of items: nodes, places, shape, literals
    opened: list[Node] = []

    def close(end: Node | None) -> None:
        start, items = opened.pop(), frames.pop()
        body = [x for item in items for x in item[0]]
        held = [p for item in items for p in item[1]]
        if end is None:
            frames[-1] += [([start], [[]], None, frozenset()), *items]
            return
        name = start[1][1:].split(".")[0]
        shape = (start, *(("slot",) if x[0] == "text" else ("many", x[1]) if x[0] == "many" else x for x in body), end)
        literals = frozenset() if name in ITEMS else frozenset(x[1] for x in body if x[0] == "text").union(*(x[2] for x in body if x[0] == "many"))
        before = frames[-1][-1] if frames[-1] else None
        if before and before[2] == shape:
            literals |= before[3]
            frames[-1][-1] = ([("many", shape, literals)], [[i for p in before[1] + held for i in p]], shape, literals)
        elif name == "p":
            frames[-1].append(([("many", shape, literals)], [[i for p in held for i in p]], shape, literals))
        else:
            frames[-1].append(([start, *body, end], [[], *held, []], shape, literals))

    for x in nodes:
        if x[0] != "tag":
            frames[-1].append(([x], [[texts]], None, frozenset()))
            texts += 1
        elif not x[1].startswith("</"):
            opened.append(x)
            frames.append([])
        elif opened:
            close(x)
    while opened:
        close(None)
    return [x for item in frames[0] for x in item[0]], [p for item in frames[0] for p in item[1]]


def _fold(nodes: list[Node]) -> list[Node]:
    return _folded(nodes)[0]


def _agree(a: Node, b: Node) -> int:
    """How well two nodes match: 0 not at all."""
    if a[0] == "tag" or b[0] == "tag":
        return 2 if a == b else 0
    if a[0] == "many" and b[0] == "many":
        return 0 if a[1] != b[1] else 4 if a[2] & b[2] else 1
    if a[0] in ("text", "slot") and b[0] in ("text", "slot"):
        return 4 if a == b and a[0] == "text" else 1
    return 0


def _sure(a: Node, b: Node) -> bool:
    """Whether two nodes at the rim of what is left may be matched without a search: no literal is lost by it."""
    return a == b and a[0] != "maybe" or bool(_agree(a, b)) and (a[0] == "slot" or b[0] == "slot" or a[0] == "text" or not a[2] or not b[2])


def matched(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """The pairs of the heaviest common subsequence of two node lists."""
    lo, x, y = 0, len(a), len(b)
    while lo < x and lo < y and _sure(a[lo], b[lo]):
        lo += 1
    while x > lo and y > lo and _sure(a[x - 1], b[y - 1]):
        x, y = x - 1, y - 1
    rim = [(i, i) for i in range(lo)], [(x + t, y + t) for t in range(len(a) - x)]
    n, m = x - lo, y - lo
    middle: list[tuple[int, int]] = []
    if n * m > CELLS:
        key = lambda v: v[:2] if v[0] in ("tag", "many") else (v[0] if v[0] == "maybe" else "text",)
        same = difflib.SequenceMatcher(None, [key(v) for v in a[lo:x]], [key(v) for v in b[lo:y]], autojunk=False)
        middle = [(lo + r.a + t, lo + r.b + t) for r in same.get_matching_blocks() for t in range(r.size)]
        middle = [(i, j) for i, j in middle if _agree(a[i], b[j])]
    elif n and m:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(m - 1, -1, -1):
                w = _agree(a[lo + i], b[lo + j])
                row[j] = max(below[j], row[j + 1], below[j + 1] + w if w else 0)
        i = j = 0
        while i < n and j < m:
            w = _agree(a[lo + i], b[lo + j])
            if w and best[i][j] == best[i + 1][j + 1] + w:
                middle.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return rim[0] + middle + rim[1]


def align(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper generalized so that it also matches the page, or another wrapper.

    What one side lacks becomes one optional run, which keeps its nodes as long as there is
    one form of it; all text in it is content, whatever its form.
    """
    out: list[Node] = []
    i = j = 0
    for x, y in [*matched(wrapper, page), (len(wrapper), len(page))]:
        forms = set()
        for side in (wrapper[i:x], page[j:y]):
            if side:
                forms.add(side[0][1] if len(side) == 1 and side[0][0] == "maybe" else tuple(("slot",) if v[0] == "text" else ("many", v[1], frozenset()) if v[0] == "many" else v for v in side))
        if forms:
            out.append(("maybe", forms.pop() if len(forms) == 1 else ()))
        if x < len(wrapper):
            a, b = wrapper[x], page[y]
            out.append(a if a == b else ("many", a[1], a[2] & b[2]) if a[0] == "many" else ("slot",))
        i, j = x + 1, y + 1
    return out


def infer(pages: list[str]) -> list[Node]:
    """The wrapper of some pages of one host."""
    streams = [_fold(page_stream(x)) for x in pages]
    wrapper = streams[0] if streams else []
    for stream in streams[1:]:
        wrapper = align(wrapper, stream)
    return wrapper


def template_texts(wrapper: list[Node]) -> list[str]:
    """Texts that the wrapper holds as literal, outside optional groups."""
    return [t for x in wrapper for t in ([x[1]] if x[0] == "text" else sorted(x[2]) if x[0] == "many" else [])]


def literal_places(wrapper: list[Node], stream: list[Node]) -> set[int]:
    """Which texts of a page's stream the wrapper holds as literal at the place where it matches them."""
    nodes, places = _folded(stream)
    texts = [x[1] for x in stream if x[0] == "text"]
    out: set[int] = set()
    for i, j in matched(wrapper, nodes):
        literals = {wrapper[i][1]} if wrapper[i][0] == "text" else wrapper[i][2] if wrapper[i][0] == "many" else ()
        out.update(p for p in places[j] if texts[p] in literals)
    return out


def _freeze(x):
    return tuple(_freeze(y) for y in x) if isinstance(x, list) else x


def dump(wrapper: list[Node]) -> str:
    return json.dumps(wrapper, default=sorted)


def read(text: str) -> list[Node]:
    def node(x: Node) -> Node:
        if x[0] == "many":
            return ("many", tuple(node(y) for y in x[1]), frozenset(x[2])) if len(x) > 2 else ("many", tuple(node(y) for y in x[1]))
        return ("maybe", tuple(node(y) for y in x[1])) if x[0] == "maybe" else x

    return [node(_freeze(x)) for x in json.loads(text)]


def main_text(page: str | None, template: frozenset[str] = frozenset(), wrapper: list[Node] | None = None) -> str:
    """The page's article; blocks joined by an empty line.

    The wrapper's literals are template and go; its slots and groups stay. In a marked
    article, an element that its class or id names furniture goes only if the wrapper holds a
    literal in it (or there is no wrapper), preformatted text stays, a literal heading stays if text under it does, and a wrapper
    that would take more than half of the article was learned from copies and takes nothing of it.
    """
    all_blocks, stream = parse(page)
    literal = literal_places(wrapper, stream) if wrapper else set()
    held = [(i, b) for i, b in enumerate(all_blocks) if not b.furniture]
    article = [(i, b) for i, b in held if b.article]
    if article:
        # named furniture goes with a literal in it, or where no wrapper can tell
        named = {b.named for i, b in article if b.named and (not wrapper or i in literal)}
        article = [(i, b) for i, b in article if b.named not in named]
        gone = {i for i, b in article if i in literal and b.path.rpartition("/")[2] != "pre"}
        if 2 * sum(len(b.text) for i, b in article if i in gone) > sum(len(b.text) for _, b in article):
            gone = set()
        last = 7  # the highest heading since the last kept text: those below it head nothing that stays
        kept = []
        for i, b in reversed(article):
            name = b.path.rpartition("/")[2]
            level = int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else 0
            if i not in gone or level and level < last:
                kept.append(b.text)
                last = level or 7
        return "\n\n".join(reversed(kept))
    # without a marked article: all that is neither furniture nor template
    return "\n\n".join(b.text for i, b in held if i not in literal and b.text not in template)


#: Distinct pages that a wrapper must have seen before its literals count.
LEAST = 3


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, turn, seen, wrapper): the wrapper of a task's pages of each host; all pages take part."""
    known: dict[str, tuple[set[int], list[Node]]] = {}
    turn = 0

    def emit() -> pa.RecordBatch:
        rows = [(host, turn, sorted(seen), dump(wrapper)) for host, (seen, wrapper) in known.items()]
        known.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([xxhash.xxh3_64_intdigest(r[3]) % 64 for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.string())],
            names=["host", "turn", "seen", "wrapper"],
        )

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            stream = page_stream(page.as_py())
            texts = [x[1] for x in stream if x[0] == "text"]
            if not texts:
                continue
            shape = xxhash.xxh3_64_intdigest("\0".join(texts).encode("utf-8", "surrogatepass")) >> 1
            seen, wrapper = known.get(host, (set(), None))
            nodes = _fold(stream)
            known[host] = (_few(seen | {shape}), nodes if wrapper is None else align(wrapper, nodes))
        if len(known) > 2000:
            yield emit()
    if known:
        yield emit()


def _few(seen: set[int]) -> set[int]:
    return seen if len(seen) <= LEAST else set(sorted(seen)[:LEAST])


def _merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of a host's partial ones, in an order that doesn't hang on the tasks."""
    wrapper, seen = None, set()
    for text in sorted(set(group["wrapper"])):
        wrapper = read(text) if wrapper is None else align(wrapper, read(text))
    for some in group["seen"]:
        seen |= {int(x) for x in some}
    return pd.DataFrame({"host": [key[0]], "seen": [sorted(_few(seen))], "wrapper": [dump(wrapper)]})


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[Node]] = {}
    for batch in batches:
        texts = []
        for page, text in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            text = text or "[]"
            if text not in known:
                if len(known) > 1000:
                    known.clear()
                known[text] = read(text)
            texts.append(main_text(page.as_py(), wrapper=known[text]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame, broadcast_hosts: int = 20_000) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, ...).

    Wrappers are inferred from all pages of each host: one per task, then merged in two
    steps, so that no task holds a host's pages. Every page is then read whole. Null, empty
    and text-free html give an empty text; a page without a url, or of a host with fewer than
    LEAST different pages, is read without a wrapper. Rows that repeat a page give their
    own rows. An empty table gives an empty result. Other columns are not read, so
    their names may clash.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    partial = rows.where("host <> '' and html is not null").select("host", "html").mapInArrow(_partial, "host string, turn int, seen array<long>, wrapper string")
    merged = partial.groupBy("host", "turn").applyInPandas(_merged, "host string, seen array<long>, wrapper string")
    merged = merged.groupBy("host").applyInPandas(_merged, "host string, seen array<long>, wrapper string")
    wrappers = materialize(merged.where(F.size("seen") >= LEAST).select("host", "wrapper"), "wrappers")
    few = wrappers.count() <= broadcast_hosts
    joined = rows.join(F.broadcast(wrappers) if few else wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
