"""Main-text extraction by consensus host paths.

Every page is parsed into text blocks under a path of containers, a container being its tag and its
classes with digits generalised. A page's containers are scored by the text of their blocks, links
discounted; its best one, or the one above that also holds its siblings' prose, is the page's vote.
Votes are counted per host and path in Spark, and all pages of a host are extracted again with the path
that won. A page on which that path yields little next to its own best container keeps its own.

An element whose tag says so (footer, aside, dialog, ...) or that a style hides is no text. One whose class, id or
role names a menu, sidebar, advert and the like, a form, and a nav are none either, unless they hold the page's
article or main element or most of the page's text; a nav that is closed by its own tag is none in any case, and
what is named comments is none while there is other prose. A head ends where anything opens that it can't hold. A name counts by its first or last word, and not where it
states a property of something else, such as ``with-sidebar``, ``comments-open`` or ``category-alert``.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm._text import arrow_pass
from plotline.operators.checkpoints import checkpointed

#: Hosts whose paths are broadcast at most, and pages of one host that meet its path in one task beyond that.
MAX_HOSTS = 50_000
HOST_PAGES = 5_000
#: Of a container's prose the share that its siblings must add for the one above to be the article.
SIBLING_SHARE = 0.2
PROSE_CHARS = 60
#: The share of the text of a page's own best container that the host's path must yield.
LEAST_SHARE = 0.5

# Elements of HTML by their role in extraction.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select object canvas audio video noframes".split())
SKIPPED = frozenset("head footer aside menu dialog button search".split())
#: Elements that often stand around a whole page, or aren't closed: noise as names are, by what they hold.
LOOSE = frozenset("form nav".split())
#: What a head may hold; anything else that opens ends it.
IN_HEAD = frozenset("head title html".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 dt".split())
CLOSES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTAINERS = frozenset("article main section div body td blockquote center details".split())
#: Words of a class, id or role that mark what isn't the article; comments are so however long they are.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
NOISE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies "
    "consent gdpr notice notices notification notifications alert alerts popup modal overlay sidebar aside nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations newsletter subscribe signup login search "
    "pagination pager widget widgets toolbar tags complementary contentinfo dialog".split()
)
NOISY_PAIRS = frozenset(("site header", "page header", "skip link"))
#: Words before or after a noise word that make a name state a property of its element.
STATES_BEFORE = frozenset("with without has have no not is in show hide category cat tag type status format layout col template".split())
STATES_AFTER = frozenset("open opened closed enabled disabled allowed on off left right layout visible".split())
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")
#: Where the text goes on after an element whose content is no text and that isn't closed.
_RESUME = re.compile(r"<(?=/?(?:p|div|article|section|main|header|footer|nav|aside|body|ul|ol|table|blockquote|h[1-6])\b)", re.I)
Block = tuple[str, int, tuple[tuple[int, str], ...]]
SHOWN, HIDDEN, NAMED, COMMENT = range(4)


def named_noise(name: str) -> int:
    """What a class, id or role says of its element: SHOWN, NAMED noise or COMMENT."""
    words = _WORDS.findall(name.lower())
    if not words or words[0] in STATES_BEFORE or words[-1] in STATES_AFTER and len(words) > 1:
        return SHOWN
    ends = {words[0], words[-1]}
    return COMMENT if ends & COMMENTS else NAMED if ends & NOISE or " ".join(words[-2:]) in NOISY_PAIRS else SHOWN


def _attributes(source: str) -> tuple[str, int]:
    """The generalised class suffix of a container, and what its attributes say of it."""
    if not source.strip():
        return "", SHOWN
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(source)}
    names = sorted({_DIGITS.sub("N", x) for x in found.get("class", "").split()})
    suffix = "".join("." + x for x in names)
    if "hidden" in found or found.get("aria-hidden") == "true" or _UNSEEN.search(found.get("style", "")):
        return suffix, HIDDEN
    return suffix, max((named_noise(x) for k in ("class", "id", "role") for x in found.get(k, "").split()), default=SHOWN)


def parse(source: str) -> list[Block]:
    """The page's text blocks in order: text, characters of it inside links, containers (number, path).

    Noise and what isn't shown are left out. Open elements that HTML closes by itself are closed.
    """
    blocks: list[Block] = []
    #: For each block the elements around it that are named noise, by number in ``named``.
    marked: list[tuple[int, ...]] = []
    #: Of each such element whether comments are in it, whether it holds an article or main element, and
    #: whether it is noise whatever it holds.
    named: list[list[bool]] = []
    parts: list[str] = []
    linked: list[int] = [0]
    #: tag, whether it is no text, containers above and with it, named noise around it, its own number there
    stack: list[tuple[str, bool, tuple[tuple[int, str], ...], tuple[int, ...], int]] = [("", False, (), (), -1)]
    state = {"noise": 0, "links": 0, "number": 0}

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, min(linked[0], len(text)), stack[-1][2]))
                marked.append(stack[-1][3])
            parts.clear()
        linked[0] = 0

    def pop() -> None:
        flush()
        state["noise"] -= stack.pop()[1]

    def pop_head() -> bool:
        """Take the innermost open element away; whether the head is still open."""
        last = stack[-1][0]
        pop()
        return last != "head"

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if not state["noise"]:
            text = source[at : m.start() if m else size]
            if text:
                parts.append(text)
                if state["links"]:
                    linked[0] += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                resume = None if end else _RESUME.search(source, at)
                at = end.end() if end else resume.start() if resume else size
            parts.append(" ")
        elif tag == "a":
            state["links"] = 0 if m[1] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag not in BLOCKS and tag not in SKIPPED:
            continue
        elif m[1]:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    if tag == "nav" and stack[depth][4] >= 0:
                        named[stack[depth][4]][2] = True
                    while len(stack) > depth:
                        pop()
                    break
        else:
            flush()
            state["links"] = 0
            if tag not in IN_HEAD and tag not in VOID and any(x[0] == "head" for x in stack):
                while pop_head():
                    pass
            while len(stack) > 1 and stack[-1][0] in PARAGRAPHS:
                pop()
            if tag in SIBLINGS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in CLOSES[tag]:
                        break
                    if stack[depth][0] in SIBLINGS[tag]:
                        while len(stack) > depth:
                            pop()
                        break
            if tag in VOID:
                continue
            suffix, says = _attributes(m[3])
            above, around = stack[-1][2:4]
            inside = any(_kind(c) in ("article", "main") for c in above)
            noise = says == HIDDEN and tag not in ("body", "html") or tag in SKIPPED or tag == "header" and not inside
            own = -1
            if (says in (NAMED, COMMENT) or tag in LOOSE) and tag not in ("body", "html"):
                own = len(named)
                around = (*around, own)
                named.append([says == COMMENT, False, False])
            elif tag in ("article", "main"):
                for k in around:
                    named[k][1] |= not any(named[j][0] for j in around if j >= k)
            if tag in CONTAINERS:
                state["number"] += 1
                above = (*above, (state["number"], f"{above[-1][1] if above else ''}/{tag}{suffix}"))
            stack.append((tag, noise, above, around, own))
            state["noise"] += noise
    flush()
    if not named:
        return blocks
    held: Counter[int] = Counter()
    sure = {k for k, x in enumerate(named) if x[2]}
    for (text, links, _), around in zip(blocks, marked, strict=True):
        for k in around:
            held[k] += len(text) - links
    whole = sum(len(text) - links for (text, links, _), around in zip(blocks, marked, strict=True) if not sure.intersection(around))
    gone = sure | {k for k, (comments, holds, _) in enumerate(named) if not holds and not comments and 2 * held[k] <= whole}
    commented = {k for k, x in enumerate(named) if x[0] and not x[1]}
    # Comments are comments on something: where there is no prose but inside them, the name means something else.
    if any(len(text) - links >= PROSE_CHARS and not (gone | commented).intersection(around) for (text, links, _), around in zip(blocks, marked, strict=True)):
        gone |= commented
    return [b for b, around in zip(blocks, marked, strict=True) if not gone.intersection(around)]


def _kind(container: tuple[int, str]) -> str:
    return container[1].rpartition("/")[2].split(".")[0]


def _with_other_articles(article: tuple[int, str], around: tuple[tuple[int, str], ...], blocks: list[Block]) -> tuple[int, str]:
    """The article, or the nearest container around it that holds others, each of prose enough."""
    inner: dict[tuple[int, str], Counter[tuple[int, str]]] = {c: Counter() for c in around}
    own = 0
    for text, linked, above in blocks:
        worth = len(text) - linked if 2 * linked < len(text) and len(text) >= PROSE_CHARS else 0
        if article in above:
            own += worth
        elif worth and (first := next((c for c in above if _kind(c) == "article"), None)):
            for c in above[: above.index(first)]:
                if c in inner:
                    inner[c][first] += worth
    for c in reversed(around):
        if any(n >= SIBLING_SHARE * max(1, own) for n in inner[c].values()):
            return c
    return article


def best_container(blocks: list[Block]) -> tuple[int, str, float] | None:
    """Number, path and score of the best container: text outside links, a parent counting half.

    An article or main element around it is taken whole, title included, and with it further articles beside it, each
    of ``SIBLING_SHARE`` of its prose or more; without one, containers above
    are, as long as each adds prose from siblings, ``SIBLING_SHARE`` of what is inside or more.
    """
    scores: Counter[tuple[int, str]] = Counter()
    prose: Counter[tuple[int, str]] = Counter()
    chains: dict[tuple[int, str], tuple[tuple[int, str], ...]] = {}
    for text, linked, above in blocks:
        worth = len(text) - linked if 2 * linked < len(text) else 0
        for distance, container in enumerate(reversed(above)):
            if distance < 3:
                scores[container] += worth / (1 << distance)
                chains[container] = above[: len(above) - distance]
            prose[container] += worth if len(text) >= PROSE_CHARS else 0
    if not scores:
        return None
    best = min(scores, key=lambda c: (-scores[c], c[0]))
    for kind in ("article", "main"):
        for k, container in enumerate(chains[best]):
            if _kind(container) == kind:
                return *(_with_other_articles(container, chains[best][:k], blocks) if kind == "article" else container), scores[best]
    chosen = best
    for container in reversed(chains[best][:-1]):
        if prose[container] - prose[chosen] >= SIBLING_SHARE * max(1, prose[chosen]):
            chosen = container
    return *chosen, scores[best]


def text_of(blocks: list[Block], number: int | None = None, path: str | None = None) -> str:
    """Blocks inside the container of this number, or inside any of this path, joined by blank lines."""
    return "\n\n".join(t for t, _, above in blocks if any(n == number or p == path for n, p in above))


def extract(source: str | None, path: str | None) -> str:
    """The page's main text by its host's path, or by its own best container."""
    blocks = parse(source) if source else []
    if not blocks:
        return ""
    own = best_container(blocks)
    if own is None:
        return "\n\n".join(t for t, _, _ in blocks)
    mine = text_of(blocks, number=own[0])
    voted = text_of(blocks, path=path) if path else ""
    return voted if voted and len(voted) >= LEAST_SHARE * len(mine) else mine


def host_of(url: Column) -> Column:
    """The lower-case host of a url, empty where it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _votes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    votes: Counter[tuple[str, str]] = Counter()
    weights: Counter[tuple[str, str]] = Counter()
    for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        best = best_container(parse(source)) if source else None
        if best:
            votes[host, best[1]] += 1
            weights[host, best[1]] += round(best[2])
    if not votes:
        return None
    keys = list(votes)
    return pa.record_batch(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64()), pa.array([weights[k] for k in keys], pa.int64())],
        names=["host", "path", "votes", "weight"],
    )


def host_paths(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``host, path, pages``: the container path with most votes of the host's pages, ties to more text, then to the lesser path."""
    picked = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = arrow_pass(picked, _votes, "host string, path string, votes long, weight long")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("weight").alias("weight"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("weight"), "path")).alias("path"), F.sum("votes").alias("pages"))


def main_text(pages: DataFrame, id_col: str, url_col: str, html_col: str, max_hosts: int = MAX_HOSTS, host_pages: int = HOST_PAGES) -> DataFrame:
    """``page_id, url, text``: one row per page; the text is empty where there is none.

    A null or empty page has an empty text. Pages without a host in their url vote together. Repeated
    rows stay and vote each. A null id or url stays null. An empty table gives an empty result. Other
    columns are ignored. Votes are counted in each batch before they travel. The winning paths are
    written; up to ``max_hosts`` of them are broadcast and no page moves. Beyond that pages meet them by
    host, a large host's pages in as many parts as its count of pages asks for.
    """
    picked = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    paths = checkpointed(host_paths(picked, "url", "html"))
    placed = picked.withColumn("host", host_of(F.col("url")))
    if paths.count() <= max_hosts:
        joined = placed.join(F.broadcast(paths), "host", "left")
    else:
        parts = paths.select("host", "path", F.ceil(F.col("pages") / host_pages).cast("int").alias("parts"))
        large = parts.where("parts > 1").select("host", "parts")
        part = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = placed.join(large, "host", "left").withColumn("part", part).drop("parts")
        joined = dealt.join(parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["host", "part"], "left")
    joined = joined.select("page_id", "url", "html", "path")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return arrow_pass(joined, run, "page_id long, url string, text string")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every ``pages`` row."""
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return found.withColumn("n_chars", F.length("text").cast("long"))
