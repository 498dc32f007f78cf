"""Main text of a page as the maximum-scoring subsequence of its words and tags.

A page is read as a sequence of words and tags. A word scores by where it stands (in an article, a paragraph, a link, bare
in a container, in a menu, ...), a tag scores negative; the weights are fitted by a structured perceptron on labelled pages,
which labelled_pages() makes by rule in several markups, neutral ones without any telling name included. One linear scan
finds the contiguous region of the highest sum, which is decoded and joined by blocks. Menus, headers and footers around an
article are left out by the scan alone; boilerplate within one (an advert, a form, comments) weighs nothing, so that it parts
no article, and isn't taken over.
"""

from __future__ import annotations

import html
import random
import re
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_texts, text_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is no text of the page, or is no markup.
RAW = frozenset("script style template textarea title iframe noframes noembed".split())
#: Elements that hold no article text.
BOILER = frozenset("nav header footer aside form menu dialog button select label fieldset".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an open p or li ends at.
_ENDS_P = BLOCK - {"html", "body"}
#: Words that mark boilerplate where a class, id or role value is made of nothing else, but for the words in NEUTRAL.
MARKS = frozenset("""ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion promoted nav navbar navigation
menu menus breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget cookie cookies consent gdpr notice notices alert
popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus
respond reply replies form search pagination pager toolbar paywall disclaimer""".split())
#: Words that say nothing of what is in a container: ad-slot is an ad, post-header and notice-period are no marks.
NEUTRAL = frozenset("site slot box bar unit container wrapper wrap block list links area section panel button buttons icons inner outer top bottom left right posts articles stories items".split())
#: Elements whose class or id may mark boilerplate; a role or hidden counts on every element but those of KEEP.
CONTAINERS = frozenset("div section aside ul ol dl table".split())
KEEP = frozenset("html body main article".split())

#: Elements whose text is a paragraph, a heading or the like; all other text stands bare in a container.
#: "" is a page without elements.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption address summary body html".split()) | {""}
#: Words of a bare text from which it is long.
BARE = 25
#: What isn't fitted: words of an article and of paragraphs, whose tags cost next to nothing, so that no short paragraph at
#: an article's end is lost for its tags, and what is skipped.
FIXED = {"word_article": 1.0, "word_para": 1.0, "tag_article": -1e-6, "tag_para": -0.01, "tag_skip": 0.0}
#: Weights before fitting: every word is worth one, every tag costs a tenth. Tags stay negative.
START = FIXED | dict.fromkeys(("word_bare", "word_short", "word_link", "word_outside", "word_boiler"), 1.0) | {"tag": -0.1, "tag_link": -0.1}
#: While fitting, a fitted kind of word is worth so much more: labels must be found with that to spare.
MARGIN = 0.5


class Item:
    __slots__ = ("kind", "n", "text", "block", "skip")

    def __init__(self, kind: str, n: int, text: str | None, block: int, skip: bool) -> None:
        self.kind, self.n, self.text, self.block, self.skip = kind, n, text, block, skip


def _marked(name: str, attrs: str) -> bool:
    if name in BOILER:
        return True
    if not attrs or name in KEEP or ("class" not in attrs.lower() and "id" not in attrs.lower() and "role" not in attrs.lower()):
        return "hidden" in attrs and name not in KEEP and any(k.lower() == "hidden" for k, _ in _ATTR.findall(attrs))
    for k, v in _ATTR.findall(attrs):
        if k.lower() == "role" or k.lower() in ("class", "id") and name in CONTAINERS:
            for token in html.unescape(v.strip("\"'")).split():
                words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if w}
                if words & MARKS and words <= MARKS | NEUTRAL:
                    return True
        elif k.lower() == "hidden":
            return True
    return False


def parse(page: str) -> list[Item]:
    """Words and tags in order, each with its place. A text piece of n words is one item."""
    items: list[Item] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is boilerplate
    boiler = article = links = 0
    has_article = re.search(r"<(?:article|main)[\s>]|role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", page, re.I) is not None
    block = at = 0
    size = len(page)

    def is_article(name: str) -> bool:
        return name in ("article", "main")

    def outside() -> bool:
        """On a page that has an article, what isn't in it: the scan leaves it out."""
        return has_article and not article

    def pop() -> None:
        nonlocal boiler, article, links
        name, bad = stack.pop()
        boiler -= bad
        if name.startswith("*"):
            article -= 1
        elif name == "a":
            links -= 1

    while at < size:
        m = _TOKEN.match(page, at)
        if not m:  # a tag that is never closed: the rest is no text
            break
        at = m.end()
        if (text := m["text"]) is not None or (text := m["cdata"]) is not None:
            words = len(text.split())
            if boiler:
                kind = "word_boiler" if outside() else "tag_skip"
            elif article:
                kind = "word_article"
            elif links:
                kind = "word_link"
            elif has_article:
                kind = "word_outside"
            else:
                kind = "word_para" if _innermost(stack) in PARAGRAPHS else "word_bare" if words >= BARE else "word_short"
            items.append(Item(kind, words, text, block, boiler > 0 and not outside()))
            continue
        if (name := m["name"] or m["name2"]) is None:
            continue
        name, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
        if name in BLOCK:
            block += 1
        skip = boiler > 0 and not outside()
        if m["close"] or m["close2"]:
            if any(x.lstrip("*") == name for x, _ in stack):
                # an inline end tag closes nothing beyond the block that it stands in
                if name not in BLOCK and not any(x.lstrip("*") == name for x, _ in _inner(stack)):
                    continue
                while stack[-1][0].lstrip("*") != name:
                    pop()
                pop()
        elif name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        elif name not in VOID and not attrs.endswith("/"):
            if name in _ENDS_P:
                while stack and (stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "u", "small", "font") and any(x == "p" for x, _ in _inner_p(stack))):
                    pop()
            if name == "li":
                _close(stack, "li", ("ul", "ol", "menu"), pop)
            elif name in ("dt", "dd"):
                _close(stack, "dt", ("dl",), pop)
                _close(stack, "dd", ("dl",), pop)
            elif name in ("td", "th", "tr"):
                for x in ("td", "th", "tr") if name == "tr" else ("td", "th"):
                    _close(stack, x, ("table",), pop)
            bad = _marked(name, attrs)
            boiler += bad
            own = "*" + name if (is_article(name) or re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", attrs, re.I)) and not bad else name
            article += own.startswith("*")
            links += name == "a"
            stack.append((own, bad))
        if name == "br":
            items.append(Item("tag", 0, " ", block, skip))
        if skip or boiler and not outside():
            kind = "tag_skip"
        elif article:
            kind = "tag_article"
        else:
            kind = "tag_link" if name in ("a", "li") else "tag_para" if name in PARAGRAPHS or name not in BLOCK else "tag"
        items.append(Item(kind, 1, None, block, skip))
    return items


def _innermost(stack: list) -> str:
    """The innermost open block."""
    for name, _ in reversed(stack):
        if name.lstrip("*") in BLOCK:
            return name.lstrip("*")
    return ""


def _inner(stack: list) -> list:
    """Open elements up to the innermost block."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0].lstrip("*") in BLOCK:
            return stack[i:]
    return stack


def _inner_p(stack: list) -> list:
    """The open p and what stands in it, if only inline elements are open in it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == "p":
            return stack[i:]
        if stack[i][0].lstrip("*") in BLOCK:
            return []
    return []


def _close(stack: list, name: str, within: tuple, pop) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            while len(stack) > i:
                pop()
            return
        if stack[i][0].lstrip("*") in within or stack[i][1]:
            return


def best_region(items: list[Item], weights: dict[str, float]) -> tuple[int, int]:
    """The contiguous items of the highest score: one scan. Ties: the earlier, then the longer one. Nothing positive: empty."""
    best, at, score, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(items):
        score += weights[x.kind] * x.n
        if score <= 0:
            score, start = 0.0, i + 1
        elif score > best:
            best, at = score, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The text of the best region: blocks joined by one newline, white space in a block turned into one blank."""
    if not page:
        return ""
    items = parse(page)
    s, e = best_region(items, weights or fitted())
    return text_of(items[s:e])


def text_of(items: list[Item]) -> str:
    blocks: list[list[str]] = []
    last = None
    for x in items:
        if x.skip or x.text is None:
            continue
        if x.block != last:
            blocks.append([])
            last = x.block
        blocks[-1].append(x.text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def labelled_pages(n: int = 96, seed: int = 5) -> list[tuple[str, str]]:
    """(html, main text) of pages made by rule: an article of a heading and paragraphs among menus, adverts, side bars and
    footers. A third of the pages has article elements, a third telling names on div elements, a third neither."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4))) for _ in range(400)]
    say = lambda lo, hi: " ".join(rnd.choices(words, k=rnd.randrange(lo, hi)))
    links = lambda k: "".join(f'<li><a href="/{rnd.choice(words)}">{say(1, 4)}</a></li>' for _ in range(k))
    marks = {
        "article": {"menu": "nav", "head": "header", "side": "aside", "ad": "div", "main": "article", "foot": "footer"},
        "names": {"menu": 'div class="menu"', "head": 'div id="header"', "side": 'div class="sidebar"', "ad": 'div class="ad-slot"', "main": 'div class="post"', "foot": 'div class="footer"'},
        "neutral": dict.fromkeys(("menu", "head", "side", "ad", "main", "foot"), "div"),
    }
    out = []
    for i in range(n):
        m = marks[("article", "names", "neutral")[i % 3]]
        put = lambda k, body: f"<{m[k]}>{body}</{m[k].split()[0]}>"  # noqa: B023, E731
        blocks = [say(3, 9)] + [say(2, 8) if rnd.random() < 0.2 else say(15, 90) + "." for _ in range(rnd.randrange(2, 12))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        around = [
            [put("head", say(1, 5))] if rnd.random() < 0.5 else [],
            [put("menu", f"<ul>{links(rnd.randrange(3, 12))}</ul>")],
            [put("ad", say(3, 20) + ".")] if rnd.random() < 0.7 else [],
            [put("main", body)],
            [put("side", f"<ul>{links(rnd.randrange(2, 8))}</ul>{say(1, 6)}")] if rnd.random() < 0.5 else [],
            [put("foot", f"&copy; {say(2, 24)}")] if rnd.random() < 0.9 else [],
        ]
        page = f"<html><head><title>{say(2, 6)}</title></head><body>{''.join(chain.from_iterable(around))}</body></html>"
        out.append((page, "\n".join(blocks)))
    return out


def fit(pages: list[tuple[str, str]], rounds: int = 12, rate: float = 0.1) -> dict[str, float]:
    """Weights from labelled pages (html, main text): an averaged structured perceptron.

    The gold region is the one between the first and last text of the label's blocks; where the scan finds another, the
    kinds of what it wrongly took lose and of what it missed gain.
    """
    read = [(parse(page), set(label.split("\n"))) for page, label in pages]
    w, total, seen = dict(START), dict.fromkeys(START, 0.0), 0
    for _ in range(rounds):
        for items, want in read:
            gold = [i for i, x in enumerate(items) if x.text and not x.skip and " ".join(html.unescape(x.text).split()) in want]
            if gold:
                free = {k: v + MARGIN if k.startswith("word") and k not in FIXED else v for k, v in w.items()}
                g, p = set(range(gold[0], gold[-1] + 1)), set(range(*best_region(items, free)))
                for i in g ^ p:
                    step = rate * min(items[i].n, 20) / 20
                    w[items[i].kind] += step if i in g else -step
                w |= {"tag": min(w["tag"], -0.01), "tag_link": min(w["tag_link"], -0.01)} | FIXED
            seen += 1
            for k in w:
                total[k] += w[k]
    return {k: v / max(1, seen) for k, v in total.items()}


@cache
def fitted() -> dict[str, float]:
    """The weights of labelled_pages()."""
    return fit(labelled_pages())


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """keep, text, n_chars for every row. Null or empty html gives an empty text, and so does a page without a word that
    scores. Repeated rows, null ids and null URLs are read each for itself; an empty table gives an empty one; columns that
    are not kept aren't read, and kept ones named text or n_chars are replaced. A page of any length is read whole."""
    weights = weights or fitted()

    def run(texts: list[str]) -> dict:
        got = [main_text(x, weights) for x in texts]
        return {"text": pa.array(got, pa.string()), "n_chars": pa.array(list(map(len, got)), pa.int64())}

    keep = [c for c in keep if c not in ("text", "n_chars")]
    return map_texts(text_rows(pages, html_col, *keep), run, "text string, n_chars long", keep)


def op8(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. Cases are extract()'s."""
    return extract(pages.select("page_id", "url", "html"), ["page_id", "url"])
