"""Main text of web pages by wrapper inference.

A page becomes a stream of leaf tokens: the path of block elements (tags with class, id and role) and
the text there.  The streams of one host are aligned one after the other into a union-free regular
expression over paths.  Where texts differ, a token becomes a text slot.  A run of equal tokens, or of
equal groups of any length, becomes a repeated group.  A mismatch is resolved by squares first: tokens that
one side lacks and that repeat the group just before them make that group a repeated one; else they
become optional.  Each part of the wrapper gathers how often it occurs, how long its texts are, how much of
them is link text and whether they vary.

With ``FEW`` different pages or more, the wrapper decides.  Its text slots with few links are weighed by
their text; the container of the heaviest one, widened while that adds nothing but headings, is the
article's place.  Content is what the wrapper has there less template: parts that are the same on every
page.  Elements that cannot hold an article by their meaning (``OUTSIDE``, ``_BAD_NAME``) never count.  Pages
without text in that place, and hosts with fewer different pages, are decided by tags and names: article
or main, else named parts, else those with few links.  Pages whose most text is under different top
elements have separate wrappers.

Hosts are dealt into groups of about ``GROUP`` pages, so a host of a third of all pages is many
groups, each with its own wrapper; every page is in one group and none is dropped.

A null page is empty; an empty page, and one without content, has empty text.  Pages without a host
form a group by themselves.  Copies of a page count once in its wrapper and get the same text.  Rows that
repeat an id are handled one by one; ids, then urls, order the alignment, and ties there are copies or in
the order of their html.  Long pages are aligned whole.  Other columns are not looked at.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import saved, table

GROUP = 128
#: Different pages from which a wrapper tells template from text.
FEW = 3
#: Rows of an alignment that are held at once.
BLOCK = 1024
#: Hosts of more than GROUP pages that are broadcast, some 20 MB; if there are more, a join by host deals them.
MAX_LARGE_HOSTS = 200_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>|<[!?][^>]*>|[^<]+|<""", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Elements that flow inside a line; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that never hold the article.
OUTSIDE = frozenset("head title nav header footer aside form menu button select option dialog fieldset".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that set parts of a page apart.
SECTIONS = frozenset("article aside div footer header main nav section".split())
_BAD_NAME = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|widget\w*|footer|header|masthead|comments?|respond|disqus|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip|copyright|legal|tags?|meta|byline)(?:$|[-_\s\d])", re.IGNORECASE)
_GOOD_NAME = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body|text)(?:$|[-_\s])", re.IGNORECASE)


Leaf = tuple[tuple[str, ...], str, int, tuple[int, ...]]


def leaves(page: str) -> list[Leaf]:
    """(path of blocks, text with white space folded, characters in links, which blocks) of each run of text."""
    out: list[Leaf] = []
    stack: list[tuple[str, str, int]] = []
    run: list[str] = []
    links, depth, count = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append((tuple(s for _, s, _ in stack), text, links, tuple(k for *_, k in stack)))
            run.clear()
            links = 0

    for m in _TOKEN.finditer(page):
        name = m[3]
        if name is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                run.append(s)
                if depth:
                    links += len(s)
            elif m[1] is not None:
                flush() if m[1].lower() not in ("svg",) else None
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                depth = 0 if m[2] else 1
            continue
        if name == "br":
            run.append("\n")
            continue
        flush()
        if m[2]:
            depth = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in VOID or name in ("html", "body"):
            continue
        if name in _P_ENDS and stack and stack[-1][0] == "p":
            stack.pop()
        ends = _SELF_ENDS.get(name)
        if ends:
            while stack and stack[-1][0] in ends:
                stack.pop()
        marks = "".join(f".{a.lower()}={b or c or d}" for a, b, c, d in _ATTR.findall(m[4])) if m[4] else ""
        count += 1
        stack.append((name, name + marks, count))
    flush()
    return out


class Part:
    """One token of a wrapper: a path with a count range and a text slot."""

    __slots__ = ("path", "optional", "repeated", "varies", "texts", "taken", "pages", "chars", "links", "into")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.optional, self.repeated, self.varies = path, False, False, False
        self.texts: list[str] = []  # of the first page that has the part, one for each position of a run
        self.taken = 0  # positions that the page in hand has filled
        self.pages = self.chars = self.links = 0
        self.into: Part | None = None  # the part of a repeated group that this one has become

    def root(self) -> "Part":
        return self if self.into is None else self.into.root()

    def absorb(self, other: "Part") -> None:
        """other is one more round of this part's group."""
        self.texts += other.texts
        self.varies |= other.varies
        self.pages, self.chars, self.links = max(self.pages, other.pages), self.chars + other.chars, self.links + other.links
        other.into = self

    def take(self, text: str, links: int) -> None:
        """The next text of the page in hand, compared with what other pages have at its position."""
        if not self.taken:
            self.pages += 1
        if self.pages == 1:
            self.texts.append(text)
        elif self.taken >= len(self.texts) or text != self.texts[self.taken]:
            self.varies = True
        self.taken += 1
        self.chars += len(text)
        self.links += links

    def close(self) -> None:
        """Ends the page in hand; runs of different lengths vary."""
        if self.taken and self.taken != len(self.texts):
            self.varies = True
        self.taken = 0

    def regex(self) -> str:
        name = "/".join(self.path) + ("#TEXT" if self.varies else "=" + "".join(self.texts[:1])[:20])
        return name + ({(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[self.optional, self.repeated])


def folded(paths: list[tuple[str, ...]]) -> list[list[int]]:
    """Positions grouped so that runs of equal paths, and of equal groups of paths, share an entry."""
    n = len(paths)
    following, last = [n] * n, {}
    for i in range(n - 1, -1, -1):
        following[i] = last.get(paths[i], n)
        last[paths[i]] = i
    entries: list[list[int]] = []
    i = 0
    while i < n:
        size = following[i] - i  # a group can only begin again where its first path does
        group = paths[i : i + size]
        if i + 2 * size <= n and paths[i + size : i + 2 * size] == group:
            j = i + size
            while paths[j : j + size] == group:
                j += size
            entries += [list(range(i + k, j, size)) for k in range(size)]
            i = j
        else:
            entries.append([i])
            i += 1
    return entries


def common(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> dict[int, int]:
    """A longest common subsequence, as positions in b with theirs in a.

    A row of the table is one integer with a bit for each entry of a, 0 where the length grows.  Only
    every BLOCK-th row is kept; the rows between are made again on the way back."""
    lo, m, n = 0, len(a), len(b)
    while lo < min(m, n) and a[lo] == b[lo]:
        lo += 1
    while lo < min(m, n) and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    out = {k: k for k in range(lo)} | {k: k + len(a) - len(b) for k in range(n, len(b))}
    a, b = a[lo:m], b[lo:n]
    if not a or not b:
        return out
    at: dict[tuple[str, ...], int] = {}
    for k, path in enumerate(a):
        at[path] = at.get(path, 0) | 1 << k
    full = (1 << len(a)) - 1

    def rows(v: int, start: int) -> list[int]:
        made = [v]
        for path in b[start : start + BLOCK]:
            u = v & at.get(path, 0)
            v = (v + u | v - u) & full
            made.append(v)
        return made

    kept = [full]
    for start in range(0, len(b) - BLOCK, BLOCK):
        kept.append(rows(kept[-1], start)[-1])
    j = len(a)
    for block in range(len(kept) - 1, -1, -1):
        made = rows(kept[block], block * BLOCK)
        k = len(made) - 1
        while k and j:
            if made[k] >> j - 1 & 1:
                j -= 1
            elif not made[k - 1] >> j - 1 & 1:
                k -= 1
            else:
                k, j = k - 1, j - 1
                out[lo + block * BLOCK + k] = lo + j
    return out


class Wrapper:
    def __init__(self) -> None:
        self.parts: list[Part] = []
        self.seen = self.distinct = 0
        self.place: tuple[str, ...] | None = None

    def align(self, page: list[Leaf]) -> list[Part]:
        """Generalises the wrapper so that it matches the page; the part that each leaf matched."""
        owner: list[Part] = [None] * len(page)  # type: ignore[list-item]
        entries = folded([leaf[0] for leaf in page])
        paths = [page[at[0]][0] for at in entries]
        old = self.parts
        parts: list[Part] = []
        match: list[Part] = [None] * len(entries)  # type: ignore[list-item]
        pairs = common([p.path for p in old], paths)

        def lacking(i: int, j: int) -> None:
            """old[i:j] have no token on this page: squares of what is before them go into it, others are optional."""
            while i < j:
                for size in range(min(j - i, len(parts)), 0, -1):
                    if [p.path for p in old[i : i + size]] == [p.path for p in parts[-size:]]:
                        for one, more in zip(parts[-size:], old[i : i + size], strict=True):
                            one.repeated = True
                            one.absorb(more)
                        i += size
                        break
                else:
                    old[i].optional = True
                    parts.append(old[i])
                    i += 1

        def extra(k: int, m: int) -> None:
            """Entries k..m have no part yet."""
            while k < m:
                for size in range(min(m - k, len(parts)), 0, -1):
                    if paths[k : k + size] == [p.path for p in parts[-size:]]:
                        match[k : k + size] = parts[-size:]
                        for p in parts[-size:]:
                            p.repeated = True
                        k += size
                        break
                else:
                    part = Part(paths[k])
                    part.optional = self.seen > 0
                    parts.append(part)
                    match[k] = part
                    k += 1

        i = k = 0
        for m in sorted(pairs):
            j = pairs[m]
            lacking(i, j)
            extra(k, m)
            parts.append(old[j])
            match[m] = old[j]
            i, k = j + 1, m + 1
        lacking(i, len(old))
        extra(k, len(entries))
        for at, part in zip(entries, match, strict=True):
            if len(at) > 1:
                part.repeated = True
            for x in at:
                part.take(page[x][1], page[x][2])
                owner[x] = part
        self.parts = parts
        for part in parts:
            part.close()
        self.seen += 1
        return owner

    def template(self, part: Part) -> bool:
        """Whether a slot is the same on every page of many with different texts."""
        return not part.varies and self.distinct >= FEW and part.pages >= self.seen

    def locate(self) -> None:
        """The article's place: the container of the heaviest text slot, widened by headings."""
        slots = [p.root() for p in self.parts if p.varies and p.links <= 0.5 * p.chars and not outside(p.path)]
        weight: dict[tuple[str, ...], int] = {}
        for p in slots:
            weight[p.path] = weight.get(p.path, 0) + p.chars
        if self.distinct < FEW or not weight:
            return
        place = max(weight, key=lambda path: (weight[path], path))[:-1]
        while place:
            added = [path for path in weight if path[: len(place) - 1] == place[:-1] and path[: len(place)] != place]
            if not added or any(tag_of(path[-1]) not in HEADINGS for path in added):
                break
            place = place[:-1]
        self.place = place

    def in_place(self, page: list[Leaf], owner: list[Part]) -> list[str]:
        """Texts of the article's place on one page."""
        place = self.place or ()
        depth = len(place)
        inner = [leaf[0][:depth] == place and len(leaf[0]) > depth for leaf in page]
        if not depth:  # paragraphs of the page itself: what is set apart from them is not theirs
            inner = [ok and tag_of(leaf[0][0]) not in SECTIONS for leaf, ok in zip(page, inner, strict=True)]
        # text directly in the container only counts beside such parts
        whole = {leaf[3][:depth] for leaf, ok in zip(page, inner, strict=True) if ok}
        keep = [ok or leaf[0] == place and leaf[3] in whole for leaf, ok in zip(page, inner, strict=True)]
        return [leaf[1] for leaf, p, ok in zip(page, owner, keep, strict=True) if ok and not outside(p.path) and not self.template(p.root()) and p.root().links <= 0.5 * p.root().chars]

    def content(self, page: list[Leaf], owner: list[Part]) -> list[str]:
        """The article's texts of one aligned page."""
        if self.place is not None and (found := self.in_place(page, owner)):
            return found
        fair = [(leaf[1], p.root()) for leaf, p in zip(page, owner, strict=True) if not outside(p.path) and not self.template(p.root())]
        inside = [t for t, p in fair if marked(p.path)]
        if inside:
            return inside
        named = [t for t, p in fair if any(_GOOD_NAME.search(s.partition(".")[2].replace("=", " ")) for s in p.path)]
        if named and sum(map(len, named)) >= 0.3 * sum(len(t) for t, _ in fair):
            return named
        return [t for t, p in fair if p.links <= 0.5 * p.chars]


def tag_of(step: str) -> str:
    return step.partition(".")[0]


@functools.lru_cache(1 << 14)
def marked(path: tuple[str, ...]) -> bool:
    return any(tag_of(s) in INSIDE for s in path)


@functools.lru_cache(1 << 14)
def outside(path: tuple[str, ...]) -> bool:
    for step in path:
        tag, _, marks = step.partition(".")
        if tag in OUTSIDE:
            return True
        if marks and tag not in INSIDE and any(_BAD_NAME.search(v.partition("=")[2]) for v in marks.split(".") if "=" in v):
            return True
    return False


def top_of(stream: list[Leaf]) -> str:
    """The top element that most text outside links is under."""
    weight: dict[str, int] = {}
    for path, text, links, _ in stream:
        if not outside(path):
            weight[path[0] if path else ""] = weight.get(path[0] if path else "", 0) + len(text) - links
    return max(weight, key=lambda k: (weight[k], k), default="")


def extract_group(pages: list[str], infer: bool = True) -> list[str]:
    """Texts of pages of one host, by one wrapper for each top element; infer: False takes each page by itself."""
    streams = [leaves(p) for p in pages]
    out = [""] * len(pages)
    kinds: dict[str | int, list[int]] = {}
    for k, s in enumerate(streams):
        if s:
            kinds.setdefault(top_of(s) if infer else k, []).append(k)
    for mine in kinds.values():
        wrapper, owners = Wrapper(), {}
        for k in mine:  # copies of a page count once
            if (key := tuple(streams[k])) not in owners:
                owners[key] = wrapper.align(streams[k])
        # pages that differ outside of what can be content are copies too
        wrapper.distinct = len({tuple(t for p, t, *_ in key if not outside(p)) for key in owners})
        wrapper.locate()
        for k in mine:
            out[k] = " ".join(wrapper.content(streams[k], owners[tuple(streams[k])]))
    return out


def extract_pages(df: DataFrame, group: int = GROUP, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    # only hosts that need more than one group are looked up; few enough of them are sent to all tasks
    large = saved(pages.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") > group))
    few = large.count() <= MAX_LARGE_HOSTS
    dealt = pages.join(F.broadcast(large) if few else large, "host", "left")
    part = F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.coalesce("host_pages", F.lit(1)) / group))
    # one key for host and part: rows that are dealt by host already must be dealt anew
    dealt = dealt.withColumn("wrapper", F.concat_ws(" ", part.cast("string"), "host"))

    def run(t: pa.Table) -> pa.Table:
        # ids order the alignment, so the wrapper does not depend on how rows arrive
        t = t.sort_by([("page_id", "ascending"), ("url", "ascending"), ("html", "ascending")])
        return pa.table({"page_id": t["page_id"], "url": t["url"], "text": pa.array(extract_group(t["html"].to_pylist()), pa.string())})

    return dealt.select("wrapper", "page_id", "url", "html").groupBy("wrapper").applyInArrow(run, "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
