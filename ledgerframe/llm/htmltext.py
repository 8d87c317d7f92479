"""Main text of web pages by host consensus.

Every page's containers are scored by the paragraph text they hold; from the best one the search climbs to the whole
article, whose generalised path (tags with classes, numbers masked) is the page's vote. Votes are counted per host in Spark, and every page is then extracted
again at its host's winning path, or at its own best container where that path isn't there.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heads, map_arrow, materialize

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_set = lambda s: frozenset(s.split())

# Element kinds of the HTML standard, and usual names of what isn't the article.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title noscript iframe xmp noembed noframes template svg math")
BLOCK = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul")
CLOSES_P = BLOCK - _set("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr") | {"table"}
CLOSES = {"li": (_set("li"), _set("ul ol menu dir")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")), "option": (_set("option"), _set("select")), "tr": (_set("tr td th"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")), "tbody": (_set("tbody thead tfoot tr td th"), _set("table")), "tfoot": (_set("tbody thead tfoot tr td th"), _set("table"))}
P, P_SCOPE = _set("p"), _set("article aside body blockquote button caption div html section table td th")
NOISE_TAGS = _set("nav footer aside button select input label dialog menu object audio video canvas map search head datalist")
NOISE_ROLES = _set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status")
NOISE_NAMES = _set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted sidebar aside comment comments commentlist disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter subscribe subscription signup signin login register share sharing shares social related recommended recommendations recommend "
    "breadcrumb breadcrumbs menu menus nav navbar navigation navi footer foot popup modal overlay lightbox toolbar pagination pager paging search searchbox skip banner banners widget widgets paywall toc hidden copyright trending"
)
READER_NAMES = _set("comment comments commentlist disqus reply replies respond discussion")
#: Words that say nothing of what an element holds: beside a noise word they leave it one.
PLAIN_NAMES = _set(
    "a actions after area back banner bar before big block blocks body bottom box btn button buttons card cards center close col collapse column component container content count cta desktop details div dock drawer element end "
    "entries entry float form full grid group head header heading helper hero holder horizontal icon icons id image images inline inner input item items js label large layer layout left line link links list lists main media meta "
    "middle mobile module modules more new next node on outer overlay page pages panel panels part pane placeholder post posts prev primary region right row section sections secondary show site slot small sticky story stories strip tab "
    "tabs tag tags template text thumb tile title titles tool tools top unit us vertical view w wide widget wrap wrapper x zone"
)
NOISE_OR_PLAIN = NOISE_NAMES | PLAIN_NAMES
HEAD_NAMES = _set("header masthead topbar")
GOOD_NAMES = _set("article content post entry story main body text blog page")
PIECES = _set("p h1 h2 h3 h4 h5 h6 li dd dt td th tr pre blockquote figcaption span em strong b i a code")
CONTAINERS = _set("article main section div td body blockquote center")


@dataclass
class Node:
    tag: str
    names: tuple[str, ...]
    parent: int
    noise: bool
    good: bool
    path: str
    marked: bool = False  # by a name or as a form: noise unless it holds the article
    vague: bool = False  # marked only by a noise word beside others that may say what it is: share-price, related-work
    reader: bool = False
    main: bool = False
    score: float = 0.0
    parts: list = field(default_factory=list)  # text, or index of a child
    heading: bool = False


def _step(tag: str, classes: str) -> str:
    names = sorted({re.sub(r"\d+", "#", c) for c in classes.lower().split()})
    return ".".join((tag, *names))


def _hidden(attrs: dict[str, str]) -> bool:
    style = attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def parse(page: str) -> list[Node]:
    """A tree of elements, node 0 the root; scripts, styles, comments and other raw content are left out."""
    nodes = [Node("#root", (), -1, False, False, "")]
    stack, at, lower = [0], 0, None

    def text(value: str) -> None:
        if value:
            nodes[stack[-1]].parts.append((html.unescape(value) if "&" in value else value).replace("\x00", "\ufffd"))

    def close(tags: frozenset, stop: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = nodes[stack[i]].tag
            if t in tags:
                del stack[i:]
                return
            if t in stop:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                nodes[stack[-1]].parts.append(m[0][9:-3])
            continue
        if m[1] or m[4]:
            if tag in BLOCK or tag not in VOID:
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW:
            if not (m[3] or m[6] or "").endswith("/"):
                lower = page.lower() if lower is None else lower
                if len(lower) != len(page):
                    end = re.compile(f"</{tag}", re.I).search(page, at)
                    at = end.start() if end else len(page)
                else:
                    end = lower.find(f"</{tag}", at)
                    at = end if end >= 0 else len(page)
                skip = page.find(">", at)
                at = skip + 1 if skip >= 0 else len(page)
            continue
        if tag in VOID:
            nodes[stack[-1]].parts.append("\x00" if tag == "hr" else " " if tag in ("br", "img") else "")
            continue
        if tag in CLOSES_P:
            close(P, P_SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3] or m[6] or "")} if m[3] or m[6] else {}
        own = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        words = [tuple(x for x in re.split(r"[^a-z]+", n) if x) for n in own.split()]
        names = {x for w in words for x in w}
        above = nodes[stack[-1]]
        role = attrs.get("role", "").lower()
        noise = above.noise or tag in NOISE_TAGS or role in NOISE_ROLES or (tag not in ("html", "body") and _hidden(attrs))
        marked = tag == "form" or (tag not in ("html", "body") and not NOISE_NAMES.isdisjoint(names))
        vague = marked and tag != "form" and not any(not NOISE_NAMES.isdisjoint(w) and NOISE_OR_PLAIN.issuperset(w) for w in words)
        head = tag == "header" or not HEAD_NAMES.isdisjoint(names)
        main = tag in ("article", "main") or role in ("main", "article")
        good = main or not GOOD_NAMES.isdisjoint(names)
        path = above.path if tag == "html" else f"{above.path}>{_step(tag, attrs.get('class', ''))}"
        nodes.append(Node(tag, ("#head",) if head else (), stack[-1], noise, good, path, marked, vague, not READER_NAMES.isdisjoint(names), main))
        above.parts.append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
        if tag in ("h1", "h2"):
            for i in stack:
                nodes[i].heading = True
    _settle_marks(nodes)
    return nodes


def _settle_marks(nodes: list[Node]) -> None:
    """Marked elements become noise, with all below them, unless they are or hold the article.

    A vague mark (a noise word beside words of other meaning) counts only outside an article or main element and on no paragraph, heading or
    item, or where most of the text is links.
    They do where they are or hold an article or main element or the h1; of several, those under the fewest marks count.
    An article among readers' comments, or under a mark with the h1 elsewhere, counts only with more than half of the page's text outside
    links, so that comments and teasers in articles of their own stay noise. Marked elements also stay with more than half of that text, or
    more than nine tenths where they are readers' comments or an article or main element lies elsewhere.
    """
    if not any(n.marked and not n.noise for n in nodes):
        return
    count = len(nodes)
    marks, size, whole = [0] * count, [0] * count, [0] * count
    link, header, reader, holds_title, inside = ([False] * count for _ in range(5))
    for i, node in enumerate(nodes):
        if i:
            up = node.parent
            marks[i] = marks[up] + node.marked
            link[i] = link[up] or node.tag == "a"
            header[i] = (header[up] or "#head" in node.names) and not node.main
            reader[i] = reader[up] or node.reader
        if not node.noise:
            whole[i] = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
            size[i] = 0 if link[i] else whole[i]
    for i in range(count - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        whole[nodes[i].parent] += whole[i]
    titles = [i for i, n in enumerate(nodes) if n.tag == "h1" and not (n.noise or header[i] or reader[i] and 2 * size[n.parent] <= size[0])]
    for i in titles:
        while i >= 0 and not holds_title[i]:
            holds_title[i] = True
            i = nodes[i].parent
    mains = [i for i, n in enumerate(nodes) if n.main and not n.noise and (n.tag == "main" or 2 * size[i] > size[0] or not reader[i] and (not marks[i] or holds_title[i] or not titles))]
    holds = [False] * count
    for found in (mains, titles):
        fewest = min((marks[i] for i in found), default=0)
        for i in found:
            if marks[i] == fewest:
                inside[i] = inside[i] or found is mains
                while i >= 0 and not holds[i]:
                    holds[i] = True
                    i = nodes[i].parent
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = inside[i] or inside[node.parent]
        if node.vague and not node.reader and 2 * size[i] >= whole[i] and (inside[i] or not mains or node.tag in PIECES):
            node.marked = False
        if node.marked and not holds[i]:
            share = 0.9 if node.reader or (mains and not inside[i]) else 0.5
            node.noise = node.noise or size[i] <= share * size[0]
        node.noise = node.noise or nodes[node.parent].noise


def _dropped(node: Node) -> bool:
    """Noise, and headers that don't hold the article's heading."""
    return node.noise or ("#head" in node.names and not node.heading)


def blocks(nodes: list[Node], top: int) -> list[str]:
    """Text blocks under a node in page order, white space collapsed; noise left out."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        for piece in "".join(now).split("\x00"):
            piece = " ".join(piece.split())
            if piece:
                out.append(piece)
        now.clear()

    todo: list = [(top, 0)]
    while todo:
        i, k = todo.pop()
        node = nodes[i]
        if k == 0 and node.tag in BLOCK:
            flush()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if isinstance(part, str):
                now.append(part)
            elif not _dropped(nodes[part]):
                todo.append((i, k))
                todo.append((part, 0))
                break
        else:
            if node.tag in BLOCK:
                flush()
    flush()
    return out


def score(nodes: list[Node]) -> int:
    """Score all containers; the number of the article around the best one, or 0 where no container holds text or the article is the whole page.

    A text block counts for its nearest container in full and for the next one by half, less the text of links; names and tags usual for
    articles add half again.
    """
    for node in nodes:
        node.score = 0.0
    for node in nodes:
        up, link, dropped, chain = node, False, False, []
        if node.parent < 0 or not any(isinstance(p, str) and p.strip() for p in node.parts):
            continue
        while True:
            dropped = dropped or _dropped(up)
            link = link or up.tag == "a"
            if up.tag in CONTAINERS and len(chain) < 2:
                chain.append(up)
            if up.parent < 0:
                break
            up = nodes[up.parent]
        if dropped or link:
            continue
        size = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        for c, share in zip(chain, (1.0, 0.5)):
            c.score += size * share
    best = max(range(len(nodes)), key=lambda k: (nodes[k].score * (1.5 if nodes[k].good else 1.0), -k))
    return _whole(nodes, best) if nodes[best].score > 0 else 0


def _whole(nodes: list[Node], best: int) -> int:
    """The nearest article or main element around a container, else its last ancestor whose further text still belongs to it.

    Further text lies outside links and noise. It belongs where it stands in the ancestor itself (a heading, a tenth of what is found or more, or
    any where the ancestor has a usual name) or in sections or elements of the same kind, and other containers hold at most a quarter
    of what is found. To the body it climbs only for a heading, and beside no other container. Columns of a table are never joined.
    """
    for i in (best, *_above(nodes, best)):
        if nodes[i].main:
            return i
    size, direct = [0] * len(nodes), [0] * len(nodes)
    out, title = [False] * len(nodes), [False] * len(nodes)
    for i, node in enumerate(nodes):
        out[i] = (i > 0 and out[node.parent]) or _dropped(node) or node.tag == "a"
        if not out[i]:
            size[i] = direct[i] = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        size[node.parent] += size[i]
        if node.tag not in CONTAINERS or node.tag == "blockquote":
            direct[node.parent] += direct[i]
            title[i] = title[i] or (node.tag in ("h1", "h2") and direct[i] > 0)
            title[node.parent] = title[node.parent] or title[i]
    found, branch, near, same, other, headed = best, best, 0, 0, 0, False
    for i in _above(nodes, best):
        node, under = nodes[i], nodes[branch]
        joined = under.tag not in CONTAINERS or under.tag == "blockquote"
        kin = [k for k in node.parts if not isinstance(k, str) and k != branch]
        here = direct[i] - (direct[branch] if joined else 0)
        alike = sum(size[k] for k in kin if nodes[k].tag == "section" or (under.tag == "div" and nodes[k].path == under.path))
        beside = size[i] - size[branch] - here - alike
        headed = headed or any(title[k] for k in kin)
        if under.tag in ("td", "th") and any(size[k] for k in kin):
            break
        near, same, other, branch = near + here, same + alike, other + beside, i
        if node.tag in ("#root", "html", "body"):
            belongs = headed and other == 0
        else:
            belongs = node.tag in BLOCK and 4 * other <= size[found] and (same > 0 or near > 0 and (headed or node.good or 10 * near >= size[found]))
        if belongs:
            found, near, same, other, headed = i, 0, 0, 0, False
    return found


def vote_of(page: str | None) -> tuple[str, float] | None:
    """The generalised path of the page's best container, and its score."""
    nodes = parse(page or "")
    best = score(nodes)
    return (nodes[best].path, nodes[best].score) if best else None


def extract(page: str | None, path: str | None) -> str:
    """Text at ``path``, else at the page's own best container, else of the whole page without noise."""
    nodes = parse(page or "")
    if path:
        found = [i for i, n in enumerate(nodes) if n.path == path and not _dropped(n)]
        inner = [i for i in found if not any(j in found for j in _above(nodes, i))]
        got = [b for i in inner for b in blocks(nodes, i)]
        if got:
            return "\n".join(got)
    return "\n".join(blocks(nodes, score(nodes)))


def _above(nodes: list[Node], i: int):
    while nodes[i].parent >= 0:
        i = nodes[i].parent
        yield i


def host_of(url):
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, its number of pages (n) and its winning path: most votes, then the larger score, then the later path in order; null without votes."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        votes = [vote_of(p) for p in cols["html"]]
        return {"host": cols["host"], "path": [v and v[0] for v in votes], "score": [v and v[1] for v in votes]}

    votes = map_arrow(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null"), run, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.sum("n").alias("n"), F.max_by("path", F.when(F.col("path").isNotNull(), F.struct("n", "score", "path"))).alias("path"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 50_000) -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    Null and empty pages give empty text. Pages whose URL has no host are extracted by themselves. Repeated rows and
    ids give a row each; other columns are ignored. Up to ``broadcast_hosts`` hosts (counted) the winning paths are broadcast and html
    stays where it is; beyond, those of hosts with many pages are, and the other hosts' pages are shuffled.
    """
    paths = materialize(host_paths(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = join_heads(rows, paths, ["host"], small=broadcast_hosts).select("id", "url", "html", "path")

    def run(cols: dict[str, list]) -> dict[str, list]:
        text = [extract(h, p) for h, p in zip(cols["html"], cols["path"])]
        return {"id": cols["id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_arrow(joined, run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
