"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks that are clearly text
(long, rich in stop words, few links, or plainly inside an article) or clearly not (links, regions of
navigation, notices, forms, comments). Regions named as reader comments, notices, adverts or sidebars are out
whatever their length, if the page has any text block elsewhere. Other role words in a class or id, or a form,
speak against a region only while the page has more running text elsewhere. The second pass gives each undecided
block the label of its nearest decided neighbours. Everything takes time in proportion to the page.
"""

from __future__ import annotations

import html
import re
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import send_by_value

# Elements and names by their role on a page, and frequent function words.
SKIPPED = "script style noscript template svg math iframe object canvas audio video head".split()
OUTSIDE = "nav header footer aside form menu dialog button select textarea fieldset".split()
INSIDE = "article main".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = ("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
          "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td "
          "textarea tfoot th thead tr ul button head title script style noscript template svg math iframe object canvas audio video").split()
ROLES = ("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar navigation nav navbar menu breadcrumb "
         "breadcrumbs footer header masthead cookie cookies consent notice popup modal newsletter subscribe share sharing social related "
         "recommended comment comments disqus respond replies reply widget pagination pager toolbar login search skip contentinfo "
         "complementary").split()
APART = frozenset(("ad ads adv advert advertisement advertising sponsor sponsored sidebar cookie cookies consent notice popup modal newsletter "
                   "comment comments disqus respond replies reply").split())
STOP_WORDS = frozenset((
    "a an and are as at be by for from he her his in is it not of on or she that the their they this to was were which with you "
    "der die das und ist in den von zu mit sich des dem nicht ein eine als auch es an auf für im "
    "le la les de des du et est en un une que qui dans pour par sur au aux avec pas ce il elle "
    "el los las y es un una que en del por con para se no su al lo como más o").split())

# Words that turn a role word after them into a statement on the layout ("no-sidebar").
LAYOUT = frozenset("no not has have with without".split())

LONG, SHORT = 200, 70
MANY_STOPS, SOME_STOPS = 0.30, 0.15
MANY_LINKS = 0.4

# Comments, declarations and raw elements, from left to right: whichever opens first owns what it
# holds, so a comment's opening inside a script is a part of the script and the other way round.
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                      r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|audio|video)\b[^>]*+(?:(?<!/)>.*?(?:</\1\s*>|\Z)|\Z)",
                      re.S | re.I)
# A quote opens a value only after "="; a tag that is not closed takes the rest of the page.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+", re.U)
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    links: int          # characters inside links
    outside: bool       # in a region that is no main text
    inside: bool        # in an article
    heading: bool
    mark: int = -1      # innermost region with a role word, or -1
    own: bool = True    # inside an article that lies within that region


def _closes(name: str, tags: list, within: frozenset = frozenset()) -> int:
    """Place in `tags` (innermost last) of the innermost element of this name, or -1. Elements named in
    `within` are not left for it."""
    for k in range(len(tags) - 1, -1, -1):
        if tags[k][0] == name:
            return k
        if tags[k][0] in within:
            return -1
    return -1


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, white space folded, character references decoded."""
    page = _DROPPED.sub(" ", page)
    found: list[Block] = []
    tags: list[tuple[str, bool, bool, bool]] = []   # (name, starts a region outside, starts an article, starts a marked region)
    count: dict[str, int] = {}                  # open elements by name
    above: list[int] = []                       # for each marked region the one around it, or -1
    apart: list[bool] = []                      # whether it is, or lies in, a region of comments, notices or the like
    marks: list[tuple[int, int]] = []           # open marked regions: (number, articles around it)
    parts: list[str] = []
    outside = inside = links_open = linked = breaks = 0
    heading = False

    def close():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            mark, around = marks[-1] if marks else (-1, 0)
            found.append(Block(text, linked, outside > 0, inside > 0, heading, mark, inside > around))
        parts, linked = [], 0

    def leave(k):
        nonlocal outside, inside, links_open
        for name, out, in_, marked in tags[k:]:
            count[name] -= 1
            if marked:
                marks.pop()
            outside, inside, links_open = outside - out, inside - in_, links_open - (name == "a")
        del tags[k:]

    at = 0
    for m in _TAG.finditer(page):
        piece = page[at:m.start()]
        at = m.end()
        if piece:
            parts.append(piece)
            if not piece.isspace():
                breaks = 0
                if links_open:
                    linked += len(" ".join(html.unescape(piece).split()))
        if not m[4]:
            continue
        end, name, rest = m[1], m[2].lower(), m[3]
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                close()
            continue
        block = name in _BLOCK_SET
        if block:
            close()
        if end:
            if count.get(name):
                leave(_closes(name, tags))
            if block:
                heading = False
        elif name not in _VOID_SET and not rest.endswith("/"):
            if name in ("p", "li") and count.get(name):       # these end where the next one begins
                k = _closes(name, tags, _HOLDERS)
                if k >= 0:
                    leave(k)
            marked, roles = False, set()
            if rest:
                roles = {_role(token) for value in _NAMES.findall(rest) for token in "".join(value).lower().split()} - {None}
                marked = bool(roles)
            # The header of an article holds its title; other headers are the page's.
            out = name in _OUTSIDE_SET and name != "form" and not (name == "header" and inside)
            marked = not out and (name == "form" or marked and name not in ("html", "body", *INSIDE))
            in_ = name in INSIDE
            tags.append((name, out, in_, marked))
            count[name] = count.get(name, 0) + 1
            if marked:
                above.append(marks[-1][0] if marks else -1)
                apart.append(not roles.isdisjoint(APART) or bool(marks) and apart[marks[-1][0]])
                marks.append((len(above) - 1, inside))
            outside, inside, links_open = outside + out, inside + in_, links_open + (name == "a")
            if block:
                heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
    if page[at:]:
        parts.append(page[at:])
    close()
    if above:
        if any(_stands(b) and not (b.mark >= 0 and apart[b.mark]) for b in found):
            for b in found:
                b.outside = b.outside or b.mark >= 0 and apart[b.mark]
        _judge_marks(found, above)
    return found


def _role(token: str) -> str | None:
    """The first role word in a class or id, if no layout word stands before it."""
    for word in re.split(r"[^a-z]+", token):
        if word in LAYOUT:
            return None
        if word in _ROLE_SET:
            return word
    return None


def _stands(b: Block) -> bool:
    """Whether a block can be the text of a page."""
    return not b.outside and not b.heading and b.links <= MANY_LINKS * len(b.text) and (b.inside or len(b.text) >= SHORT)


def _density(text: str) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def _running(b: Block) -> int:
    """Characters of running text: of long blocks rich in stop words, and of articles within the region."""
    if b.outside or b.links > MANY_LINKS * len(b.text):
        return 0
    return len(b.text) if b.own and b.inside or len(b.text) >= LONG and _density(b.text) >= SOME_STOPS else 0


def _judge_marks(found: list[Block], above: list[int]) -> None:
    """Put blocks of marked regions outside, but for regions with running text, and as much of it as
    there is out of marked regions. Regions within such a one are judged next, against its text too."""
    own, total, free = [0] * len(above), [0] * len(above), 0
    for b in found:
        if b.mark < 0:
            free += _running(b)
        else:
            own[b.mark] += _running(b)
    below: dict[int, list[int]] = {}
    for k in range(len(above) - 1, -1, -1):     # the inner ones have the larger numbers
        total[k] += own[k]
        if above[k] >= 0:
            total[above[k]] += total[k]
        below.setdefault(above[k], []).append(k)
    kept, level = {-1}, below[-1]
    while level:
        held = [k for k in level if total[k] and total[k] >= free]
        free += sum(own[k] for k in held)
        kept.update(held)
        level = [inner for k in held for inner in below.get(k, ())]
    for b in found:
        b.outside = b.outside or b.mark not in kept


_BLOCK_SET, _VOID_SET, _OUTSIDE_SET, _ROLE_SET = frozenset(BLOCKS), frozenset(VOID), frozenset(OUTSIDE), frozenset(ROLES)
_HOLDERS = _BLOCK_SET - {"p", "li"}


def first_pass(b: Block) -> int:
    if b.outside:
        return BAD
    if b.inside:
        return GOOD
    if b.links > MANY_LINKS * len(b.text):
        return BAD
    if len(b.text) < LONG and (b.text.startswith("©") or "copyright" in b.text[:40].lower()):
        return BAD
    if len(b.text) < SHORT or b.heading:
        return OPEN
    density = _density(b.text)
    if density >= MANY_STOPS or density >= SOME_STOPS and len(b.text) >= LONG:
        return GOOD
    return OPEN


def second_pass(labels: list[int], headings: list[bool]) -> list[int]:
    """Undecided blocks take the label that their nearest decided neighbours share; where those differ,
    the nearer one's, and at equal distance that of the one below for headings, else bad. Where
    nothing is decided everything is text."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        if labels[i] != OPEN:
            last = i
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        if labels[i] != OPEN:
            last = i
    out = list(labels)
    for i in range(n):
        if labels[i] == OPEN:
            a, b = before[i], after[i]
            if a is None and b is None:
                out[i] = GOOD
            elif a is None or b is None:
                out[i] = labels[b if a is None else a]
            elif labels[a] == labels[b] or i - a < b - i:
                out[i] = labels[a]
            elif b - i < i - a or headings[i]:
                out[i] = labels[b]
            else:
                out[i] = BAD
    return out


def main_text(page: str | None) -> str:
    """The good blocks in page order, one per line."""
    found = blocks(page or "")
    labels = second_pass([first_pass(b) for b in found], [b.heading for b in found])
    return "\n".join(b.text for b, label in zip(found, labels) if label == GOOD)


def _rows(names: list[str]):
    def run(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(batch.schema.get_field_index("_html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], [*names, "_text", "_n"])
    return run


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text and n_chars (code points), one row per input row.

    Null and empty pages give the empty text; text outside any tag is a block; unclosed elements last
    to the end of the page; a tag cut off at the end is dropped. Other columns are not read. Pages are
    independent, so nothing is shuffled, and no page is shortened.
    """
    held = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(html_col).alias("_html"))
    names = [f"c{i}" for i in range(len(keep))]
    kinds = "".join(f"{c} {held.schema[c].dataType.simpleString()}, " for c in names)
    out = held.mapInArrow(_rows(names), kinds + "_text string, _n long")
    return out.select(*[F.col(c).alias(k) for c, k in zip(names, keep)], F.col("_text").alias("text"), F.col("_n").alias("n_chars"))


send_by_value(sys.modules[__name__])
