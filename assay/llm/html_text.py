"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Parts that their tag or role marks as menus, headers,
footers and the like are left out. So are forms and parts named (by class or id) as sidebars, notices,
adverts, comments and the like, but names also stand on wrappers: a part with more than half of the
page's good text stays, and where the others together hold more than half of it, only those of them
go in which the block rules find no more good text than bad. (Text of the article that isn't bad counts
as good here, and up to 140 characters in named parts outside of it as nothing.) First pass: a
block is bad with many link characters; long blocks are good or bad by their density of stop
words; short ones stay ambiguous. The lists of stop words are those of four languages: a page whose long blocks hold
too few of them is in another one, and there length and links alone decide. Characters of scripts that
write a word in one or two of them count threefold. Preformatted text is never bad for its words. Second pass: an ambiguous block takes the label of its nearest
decided neighbours; where the two differ, it counts as bad unless the good one is nearer. Between neighbours that differ at one distance a heading goes with what follows, and a block that isn't short stays if it has no link.
On a page without any good block all that isn't bad is kept. The page's own mark of its article (``article`` or ``main``) is a feature of both: a long block in it
with few stop words is ambiguous, not bad, and between neighbours that differ at the same distance,
or with none that is decided, a block in it is good. Blocks outside are judged like any other.

Null and empty pages give an empty text. Malformed markup is read as far as it goes, and a tag that the next
``<`` finds unclosed is text, so that time grows with the page's length; repeated rows each give a row, an empty
table gives an empty one, and other columns are not read. Ids may be of any type.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from assay.llm.common import map_batches

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that for on with as was are be this by at from or an not a he they you his have which their we "
    "der die das und ist nicht mit von den ein eine zu im auf sich dem des für als auch es an werden aus er hat dass sie nach "
    "le la les de des et un une du en que est dans pour qui sur pas au par plus ce il ne se avec sont "
    "el los las y por con una su para es al lo como más del se ha o sus".split()
)
SHORT, MAX_LINKS = 70, 0.5
#: Named parts nested deeper than this count as one with the part around them.
MOST_NAMED = 64
STOP_HIGH, STOP_LOW = 0.30, 0.15

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("head nav footer aside script style noscript template iframe button select textarea svg math object canvas audio video dialog menu title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|sidebar|widgets?|menus?|nav|navbar|navigation"
    r"|breadcrumbs?|footer|masthead|comments?|commentlist|replies|reply|disqus|related|recommend\w*|shar(?:e|ing)|social|login|signup|signin|searchbox|search|pagination|pager|toolbar)(?:$|[^a-z])"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|textarea|title|noscript|iframe|template|svg)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<[!?/][^<>]*>|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
#: Ideographs, kana and hangul.
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003134f]")
#: A new one of these ends an open one of the same kind, up to the container named.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}


@dataclass
class Block:
    text: str
    links: int
    inside: bool
    parts: tuple[int, ...] = ()  # named parts around it, by number
    kept: bool = False  # preformatted
    heading: bool = False

    @property
    def size(self) -> int:
        return len(self.text) + 2 * len(_WIDE.findall(self.text))


def _left_out(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _OUT or (tag == "header" and not inside):
        return True
    if not attributes.strip():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _named(tag: str, attributes: str) -> bool:
    """Whether it is a form, or its class or id names a part that isn't main text."""
    if tag == "form":
        return True
    if tag in ("html", "body", "article", "main") or not attributes.strip():
        return False
    return any(m[1].lower() in ("class", "id") and _NAMES.search(_CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes))


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, without what is left out by its tag or role, and inline text by its name."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...], bool]] = []  # tag, left out, in an article, named parts, in a named inline element
    parts: list[str] = []
    links = breaks = anchors = n_named = 0
    inside = skipped = quiet = False
    named: tuple[int, ...] = ()
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, links, inside, named, opened["pre"] > 0, any(opened[h] > 0 for h in _HEADINGS)))
            parts.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal inside, skipped, named, quiet, anchors
        if any(x[0] in _BLOCK for x in stack[to:]):
            flush()
        anchors -= sum(x[0] == "a" for x in stack[to:])
        opened.subtract(x[0] for x in stack[to:])
        del stack[to:]
        _, skipped, inside, named, quiet = stack[-1] if stack else ("", False, False, (), False)

    for m in _TOKEN.finditer(page):
        text, tag = m[5], m[3]
        if text is not None:
            if not (skipped or quiet):
                text = entities.unescape(text) if "&" in text else text
                if breaks > 1 and text.strip():
                    flush()
                if text.strip():
                    breaks = 0
                parts.append(text)
                if anchors:
                    links += len("".join(text.split()))
            continue
        if tag is None:
            if m[0].startswith("<![CDATA[") and not (skipped or quiet):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "p" and not opened["p"]:
                flush()
            for i in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in _BLOCK and stack[i][0] in _BLOCK:  # an inline end tag closes nothing around it
                    break
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            continue
        if tag in _BLOCK:
            # A block ends an open paragraph, with the inline elements left open in it.
            for i in range(len(stack) - 1 if opened["p"] else -1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
            if tag in _ENDS and opened[_ENDS[tag][0]]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == _ENDS[tag][0]:
                        close(i)
                        break
                    if stack[i][0] in _ENDS[tag][1]:
                        break
            flush()
            breaks = 0
        if tag in _VOID or m[4].endswith("/") and tag not in _BLOCK:
            continue
        out_now = skipped or _left_out(tag, m[4], inside)
        if not out_now and _named(tag, m[4]):
            n_named += 1
            named, quiet = (*named, n_named) if len(named) < MOST_NAMED else named, tag not in _BLOCK
        elif tag in _BLOCK:
            quiet = False
        skipped, inside = out_now, inside or tag in ("article", "main")
        stack.append((tag, skipped, inside, named, quiet))
        opened[tag] += 1
        anchors += tag == "a"
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def linked(block: Block) -> bool:
    return block.links > MAX_LINKS * len(block.text.replace(" ", ""))


def listed(blocks: list[Block]) -> bool:
    """Whether the page's long blocks, taken together, hold as many stop words as a text in one of the languages does."""
    words = [w for b in blocks if b.size >= SHORT and not b.kept and not linked(b) for w in _WORD.findall(b.text.lower())]
    return not words or sum(w in STOP_WORDS for w in words) >= STOP_LOW * len(words)


def first_pass(block: Block, by_words: bool = True) -> bool | None:
    """True, False, or None for ambiguous. ``by_words``: stop words tell; else length does."""
    if linked(block):
        return False
    if block.size < SHORT or block.kept:
        return None
    if not by_words:
        return True if block.size > 2 * SHORT else None
    density = stop_density(block.text)
    return True if density >= STOP_HIGH or (density >= STOP_LOW and block.size > 2 * SHORT) else None if density >= STOP_LOW or block.inside else False


def second_pass(labels: list[bool | None], inside: list[bool] | None = None, leads: list[bool] | None = None) -> list[bool]:
    """Ambiguous blocks take after their nearest decided neighbours; in a draw or without any, they are bad unless ``inside``. In a draw, blocks that lead take after the next."""
    n = len(labels)
    inside, leads = inside or [False] * n, leads or [False] * n
    before, after = [(n, False)] * n, [(n, False)] * n
    for i in range(n):
        before[i] = (0, labels[i]) if labels[i] is not None else (before[i - 1][0] + 1, before[i - 1][1]) if i else (n, False)
    for i in range(n - 1, -1, -1):
        after[i] = (0, labels[i]) if labels[i] is not None else (after[i + 1][0] + 1, after[i + 1][1]) if i < n - 1 else (n, False)
    out = []
    for x, b, a, own, lead in zip(labels, before, after, inside, leads):
        if x is not None:
            out.append(x)
        elif lead and b[0] == a[0] < n and a[1]:
            out.append(True)
        elif min(b[0], a[0]) >= n or (b[0] == a[0] and b[1] != a[1]):
            out.append(own)
        elif b[0] == a[0]:
            out.append(b[1])
        else:
            out.append((b if b[0] < a[0] else a)[1])
    return out


def judged(blocks: list[Block], by_words: bool) -> list[bool]:
    """Both passes; where the first finds nothing good, all that isn't bad is."""
    labels = [first_pass(b, by_words) for b in blocks]
    if True not in labels:
        return [x is not False for x in labels]
    return second_pass(labels, [b.inside or (b.size >= SHORT and not b.links and not b.heading) for b in blocks], [b.heading for b in blocks])


def without_named(blocks: list[Block], by_words: bool = True) -> list[Block]:
    """``blocks`` without named parts; of parts that hold most of the good text, only those go that the block rules find mostly bad."""
    if not any(b.parts for b in blocks):
        return blocks
    labels = [first_pass(b, by_words) for b in blocks]
    none = True not in labels and not any(b.inside for b in blocks)
    good = [b.size * (x is True or (none or b.inside) and x is not False) for b, x in zip(blocks, labels)]
    loose = [bool(b.parts) and not b.inside for b in blocks]
    if sum(g for g, out in zip(good, loose) if out) <= 2 * SHORT:  # no more than a notice
        good = [0 if out else g for g, out in zip(good, loose)]
    main, kept, size = Counter(), Counter(), Counter()
    for b, g, x in zip(blocks, good, judged(blocks, by_words)):
        for part in b.parts:
            main[part] += g
            kept[part] += len(b.text) * x
            size[part] += len(b.text)
    gone = {part for part in size if 2 * main[part] <= sum(good)}
    if 2 * sum(g for b, g in zip(blocks, good) if not gone.isdisjoint(b.parts)) > sum(good):
        gone = {part for part in gone if 2 * kept[part] <= size[part]}
    return [b for b in blocks if gone.isdisjoint(b.parts)]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    by_words = listed(blocks)
    blocks = without_named(blocks, by_words)
    return "\n\n".join(b.text for b, good in zip(blocks, judged(blocks, by_words)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), fn, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
