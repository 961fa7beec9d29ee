"""Main text of web pages by minimum cut.

A page becomes a graph of its text blocks. A logistic classifier over structural features gives each block the
cost of calling it content or boilerplate (terminal capacities); neighbours in page order and blocks under the
same ancestors are joined by smoothness edges. The minimum cut is the labelling of least total cost.

Pages that say by their elements what is article are labelled with the default costs. They also teach: what the cut makes
of them are the examples from which the costs of all that elements do not say are fit, those of class and id
names among them (hashed). Pages that say nothing are labelled with the fitted costs, if these find more of the examples'
text than the default ones do, on examples that were not fit on and from which all names and telling elements are taken.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>|<[/a-zA-Z!?][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose contents are never text of the page.
SILENT = frozenset("script style noscript template svg head title iframe object canvas audio video select option datalist textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow msup msub mfrac msqrt mtext semantics".split())
#: Elements that can stand in a head; any other ends it.
IN_HEAD = frozenset("title meta link style script base noscript template head".split())
#: Elements that an open paragraph ends before.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SECTION = frozenset("article main section div td aside nav header footer form ul ol dl table body blockquote figure".split())

#: The features of a block and their default costs (log odds of content), the prior of the fit. mass, mass_above: shares
#: of the page's text in the block's section and in that around it.
PRIOR = {
    "bias": -2.5, "article": 4.0, "main": 3.0, "outside": -5.0, "content_name": 2.0, "boiler_tag": -10.0, "boiler_name": -8.0, "comment": -12.0,
    "links": -4.0, "paragraph": 1.0, "heading": 1.0, "item": -0.5, "log_words": 0.6, "sentence": 0.5, "mass": 2.0, "mass_above": 1.0, "legal": -3.0,
}
#: Those that say what an element is: they choose the examples, are hidden in them and are not fit.
SAID = ("article", "main", "outside", "content_name", "boiler_tag", "boiler_name", "comment")
#: Buckets of hashed names, whose costs are fit from 0.
NAMES = 128
#: Pages that are fit on, and blocks of each, at most; weights of the priors in examples; one page in so many is held back.
SAMPLE, MOST_BLOCKS, PRIOR_WEIGHT, NAME_WEIGHT, HELD = 500, 100, 20.0, 5.0, 3
_LEGAL = re.compile(r"^(?:\W*(?:©|\(c\)|copyright)|.{0,80}\ball rights reserved)", re.I)
#: Smoothness: neighbours in page order, and blocks under the same parent and grandparent.
NEXT, PARENT, GRAND = 0.6, 0.9, 0.3
#: An element with so much of the page's text, or with less if it holds the article, is a wrapper: its name says nothing.
#: Articles with so much of it as the latter say of the rest that it is outside.
WRAPPER, HOLDER = 0.9, 0.3
BOILER_TAGS = frozenset("nav footer aside form menu dialog button".split())
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|footer|header|masthead|banner|ads?|advert\w*|adsense|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|widget|toolbar|copyright|legal|disclaimer|search|tags?|meta|byline|outbrain|taboola|trending|popular)(?:$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|reply|replies|disqus|discussion|reviews?)(?:$|[\s_-])", re.I)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|prose)(?:$|[\s_-])", re.I)
#: Names of a state and not of a part, as "no-sidebar" or "comments-open".
_STATE = re.compile(r"(?:^|\s)(?:(?:no|has|with|without|is|hide|show)-\S*|\S*-(?:open|closed|enabled|disabled|active|on|off))(?=\s|$)", re.I)


class _Element:
    __slots__ = ("tag", "up", "key", "silent", "inside", "link", "block", "section", "said", "name", "names", "size", "holds")

    def __init__(self, tag: str, attrs: str, up: _Element | None, key: int) -> None:
        self.tag, self.up, self.key, self.size, self.holds = tag, up, key, 0, tag in ("article", "main", "h1")
        self.silent, self.inside, self.link = (up.silent or tag in SILENT, up.inside, up.link or tag == "a") if up else (False, False, False)
        # The nearest elements that are no inline one, and that blocks are grouped by.
        self.block = up.block if up and tag in INLINE else self
        self.section = self if tag in SECTION or not up else up.section
        self.said, self.name, self.names = "", "", frozenset()
        if tag == "article" and not self.inside:
            self.inside, self.said = True, "article"
        elif tag == "main" and not self.inside:
            self.said = "main"
        elif tag in BOILER_TAGS or tag == "header" and not self.inside:
            self.said = "boiler_tag"
        if attrs:
            named = ""
            for name, value in _ATTR.findall(attrs):
                name = name.lower()
                if name == "hidden" or name == "aria-hidden" and "true" in value:
                    self.silent = True
                elif value:
                    named += " " + value.strip("\"'")
            if named and tag not in ("html", "body"):
                self.names = frozenset(zlib.crc32(x.encode()) % NAMES for x in named.lower().split())
                named = _STATE.sub(" ", named)
                if _COMMENT.search(named):
                    self.name = "comment"
                elif _BOILER.search(named) or "contentinfo" in named or "complementary" in named:
                    self.name = "boiler_name" if tag != "article" else ""
                elif _CONTENT.search(named) and not self.inside:
                    self.name = "content_name"


def blocks(page: str) -> list[tuple[str, list[float], int, int, frozenset[int]]]:
    """(text, features, section, section above, hashed names) of each text block, in page order. Time and memory follow the page's length."""
    top = _Element("", "", None, 0)
    here, every, found = top, [top], []
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = total = 0
    owner = top

    def leave(upto: _Element) -> None:
        """Closes all elements below upto."""
        nonlocal here
        while here is not upto:
            open_[here.tag] -= 1
            here = here.up

    def flush() -> None:
        nonlocal linked, total
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            owner.size += len(text)
            found.append((text, owner.block, linked / max(1, total)))
        linked = total = 0

    def add(text: str) -> None:
        nonlocal linked, total, owner
        if here.tag == "head" and text.strip():
            leave(here.up)  # a head that was not closed
        if here.silent or not text:
            return
        if not parts:
            owner = here
        parts.append(text)
        n = len(text.strip())
        total += n
        if here.link:
            linked += n

    at, find = 0, _TAG.search
    while m := find(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE and not here.silent:
            flush()
        if close:
            # An end tag that nothing is open for costs no walk up the page.
            if open_.get(tag):
                e = here
                while e.tag != tag:
                    e = e.up
                leave(e.up)
            continue
        if open_.get("head") and tag not in IN_HEAD:
            e = here
            while e.tag != "head":
                e = e.up
            leave(e.up)
        if tag in ENDS_P:
            e = here.block
            if e.tag == "p":
                leave(e.up)
        elif tag in ("li", "dt", "dd", "tr", "td", "th") and here.tag == tag:
            leave(here.up)
        if tag in VOID or attrs.endswith("/") and tag in INLINE:
            continue
        if tag == "body" and here.silent:
            leave(top)
        here = _Element(tag, attrs, here, len(every))
        every.append(here)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    add(page[at:])
    flush()
    # What elements say is summed from the top down, once their shares of the page's text are known.
    for e in reversed(every[1:]):
        e.up.size += e.size
        e.up.holds |= e.holds
    whole, said, names = max(1, top.size), [dict.fromkeys(SAID, 0.0)], [frozenset()]
    for e in every[1:]:
        own = said[e.up.key]
        names.append(names[e.up.key] | e.names if e.names and e.size < WRAPPER * whole else names[e.up.key])
        if e.said or e.name:
            own = dict(own)
            if e.said:
                own[e.said] = min(2.0, own[e.said] + 1)
            if e.name == "content_name":
                own[e.name] = min(2.0, own[e.name] + 1)
            elif e.name:
                share = e.size / whole
                part = 0.0 if share >= WRAPPER or e.holds and share >= HOLDER else min(1.0, (WRAPPER - share) / (WRAPPER - 0.5))
                own[e.name] = min(2.0, own[e.name] + part)
        said.append(own)
    marked = sum(e.size for e in every[1:] if e.said in ("article", "main") and not said[e.up.key]["article"] and not said[e.up.key]["main"])
    outside = marked >= HOLDER * whole
    out = []
    for text, e, links in found:
        kind = "paragraph" if e.tag in ("p", "pre", "blockquote") else "heading" if len(e.tag) == 2 and e.tag[0] == "h" else "item" if e.tag == "li" else ""
        above = e.section.up.section if e.section.up else e.section
        own = {"bias": 1.0, "links": links, "log_words": math.log1p(text.count(" ") + 1), "sentence": float(text[-1] in ".!?:;\u0964\u3002\"'\u201d\u2019)")} | said[e.key]
        own["outside"] = float(outside and not own["article"] and not own["main"])
        own |= {"mass": e.section.size / whole, "mass_above": above.size / whole, "legal": float(_LEGAL.search(text) is not None)}
        if kind:
            own[kind] = 1.0
        out.append((text, [own.get(f, 0.0) for f in PRIOR], e.section.key, above.key, names[e.key]))
    return out


_DEFAULT = np.array(list(PRIOR.values()))
_PLACE = {f: i for i, f in enumerate(PRIOR)}
_HIDDEN = np.array([f in SAID for f in PRIOR])


def says(found: list) -> bool:
    """Whether elements of the page mark its article."""
    return any(b[1][_PLACE["article"]] or b[1][_PLACE["main"]] for b in found)


def examples(found: list) -> np.ndarray:
    """Rows (1 for content or 0, features, names) of the blocks of a page that says what it is, without what its elements say."""
    if not says(found):
        return np.zeros((0, 1 + len(PRIOR) + NAMES))
    keep, chosen = content(found), range(len(found))
    if len(found) > MOST_BLOCKS:
        chosen = [i * len(found) // MOST_BLOCKS for i in range(MOST_BLOCKS)]
    rows = np.zeros((len(chosen), 1 + len(PRIOR) + NAMES))
    for row, i in zip(rows, chosen, strict=True):
        row[0] = keep[i]
        row[1 : 1 + len(PRIOR)] = np.where(_HIDDEN, 0.0, found[i][1])
        row[[1 + len(PRIOR) + k for k in found[i][4]]] = 1.0
    return rows


def fit(rows: np.ndarray) -> np.ndarray:
    """Costs of features and names: logistic regression about the prior, whose loss no step raises.

    Both classes weigh alike. Without examples of both classes the prior is the model.
    """
    prior = np.concatenate([_DEFAULT, np.zeros(NAMES)])
    y, x = rows[:, 0], rows[:, 1:]
    if not len(y) or y.all() or not y.any():
        return prior
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    firm = np.where(np.arange(len(prior)) < len(PRIOR), PRIOR_WEIGHT, NAME_WEIGHT)
    loss = lambda w: weight @ np.logaddexp(0, np.where(y > 0, -1.0, 1.0) * (x @ w)) + (firm * (w - prior) ** 2).sum() / 2
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + firm * (w - prior)
        curve = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(firm)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6 or size <= 1e-4:
            break
    return w


def stripped(found: list) -> list:
    """The blocks as of a page whose elements and names say nothing."""
    return [(t, np.where(_HIDDEN, 0.0, f).tolist(), a, b, frozenset()) for t, f, a, b, _ in found]


def words_right(found: list, costs: np.ndarray | None) -> np.ndarray:
    """Words that the page has as content when it says what it is, those found when it does not, and those in both."""
    true, got = content(found), content(stripped(found), costs)
    size = np.array([b[0].count(" ") + 1.0 for b in found])
    return np.array([size @ true, size @ got, size @ (np.array(true) & np.array(got))])


def _max_flow(n: int, source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut (Dinic's algorithm)."""
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, ab: float, ba: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    s, t = n, n + 1
    for i in range(n):
        if source[i] > 0:
            join(s, i, source[i], 0.0)
        if sink[i] > 0:
            join(i, t, sink[i], 0.0)
    for a, b, w in links:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for v in queue:
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, v = [], s
            while turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            else:
                if not path:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                continue
            path.append(e)
            v = to[e]


def label(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for content. A block whose own odds outweigh all its links is settled first; that never changes the cut."""
    n = len(odds)
    own = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    settled: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if settled[i] is None and abs(own[i]) > sum(near[i].values()):
            settled[i] = own[i] > 0
            for j, w in near[i].items():
                own[j] += w if settled[i] else -w
                del near[j][i]
                queue.append(j)
    left = [i for i in range(n) if settled[i] is None]
    if left:
        new = {i: k for k, i in enumerate(left)}
        rest = [(new[i], new[j], w) for i in left for j, w in near[i].items() if i < j]
        side = _max_flow(len(left), [max(0.0, own[i]) for i in left], [max(0.0, -own[i]) for i in left], rest)
        for i, x in zip(left, side, strict=True):
            settled[i] = x
    return [bool(x) for x in settled]


def content(found: list, costs: np.ndarray | None = None) -> list[bool]:
    """Which blocks are on the content side of the minimum cut, by the costs given or the default ones."""
    if not found:
        return []
    own = np.array([b[1] for b in found])
    odds = own @ (_DEFAULT if costs is None else costs[: len(PRIOR)])
    if costs is not None:
        odds += [sum(costs[len(PRIOR) + k] for k in b[4]) for b in found]
    links: list[tuple[int, int, float]] = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    for place, weight in ((2, PARENT), (3, GRAND)):
        last: dict[int, int] = {}
        for i, b in enumerate(found):
            if b[place] in last:
                links.append((last[b[place]], i, weight))
            last[b[place]] = i
    return label(odds.tolist(), links)


def main_text(page: str | None, costs: np.ndarray | None = None) -> str:
    """The texts of a page's content; costs (fitted ones) are for pages that do not say what they are."""
    found = blocks(page or "")
    keep = content(found, None if costs is None or says(found) else costs)
    return " ".join(b[0] for b, k in zip(found, keep, strict=True) if k)


#: Pages with such an element mark their article (all but those that have it in a comment or script, or empty).
_SAYS = r"(?i)<(?:article|main)[\s>]"


def learn(pages: DataFrame, row_id: str, html: str) -> np.ndarray | None:
    """Costs for pages that say nothing, from at most SAMPLE pages that do; None where the default ones are better.

    The sample follows from a hash of id and page; at most SAMPLE * MOST_BLOCKS rows of examples reach the driver.
    """
    import pyarrow as pa

    at = F.xxhash64(F.lit("fit"), F.col(f"`{row_id}`"), F.col(f"`{html}`"))
    told = pages.where(F.col(f"`{html}`").rlike(_SAYS)).select(at.alias("at"), F.col(f"`{html}`").alias("page"))
    n = told.count()
    # About SAMPLE of them by their hash, then the SAMPLE lowest: the pages that are moved do not follow the table.
    some = told.where(F.pmod("at", F.lit(1 << 20)) < min(1 << 20, (2 * SAMPLE << 20) // max(1, n) + 1)).orderBy("at", "page").limit(SAMPLE)
    some = shared.cut(some, "taught")

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [examples(blocks(p.as_py() or "")).astype("<f4").tobytes() for p in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"at": batch.column(0), "rows": pa.array(rows, pa.binary())})

    held = F.pmod("at", F.lit(HELD)) == 0
    rows = some.where(~held).mapInArrow(teach, "at bigint, rows binary").orderBy("at", "rows").collect()
    costs = fit(np.frombuffer(b"".join(r[1] for r in rows), "<f4").astype(float).reshape(-1, 1 + len(PRIOR) + NAMES))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for p in batch.column(1) if says(f := blocks(p.as_py() or ""))]
            for name, own in (("fit", costs), ("default", None)):
                total = sum((words_right(f, own) for f in found), np.zeros(3))
                yield pa.RecordBatch.from_pydict({"name": pa.array([name]), **{k: pa.array([v]) for k, v in zip(("is", "got", "both"), total.tolist(), strict=True)}})

    sums = some.where(held).mapInArrow(judge, "name string, is double, got double, both double").groupBy("name").agg(*[F.sum(c).alias(c) for c in ("is", "got", "both")]).collect()
    shared.forget(some)
    right = {r["name"]: 2 * r["both"] / max(1.0, r["is"] + r["got"]) for r in sums}
    return costs if right.get("fit", 0.0) > right.get("default", 0.0) else None


def extract(pages: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """row_id, url, text and n_chars (code points) of each page's main text.

    Null and empty pages give an empty text; each row is worked on its own, so repeated rows repeat; other
    columns are ignored; the whole page is read, whatever its length; an empty table gives none. Costs are fit (see
    learn) if there is a page that does not mark its article, and used for such pages only.
    """
    import pyarrow as pa

    shared.prepare(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    silent = pages.where(F.length(f"`{html}`") > 0).where(~F.col(f"`{html}`").rlike(_SAYS))
    costs = learn(pages, row_id, html) if silent.limit(1).count() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), costs) for p in batch.column(2)]
            yield pa.RecordBatch.from_pydict({row_id: batch.column(0), url: batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col(f"`{row_id}`"), F.col(f"`{url}`"), F.col(f"`{html}`")).mapInArrow(run, f"`{row_id}` {kinds[row_id]}, `{url}` {kinds[url]}, text string, n_chars bigint")
