"""Main text of web pages by tree scoring (operator 8).

Blocks of text (paragraphs, headings, list items, cells, loose text between block tags) give points for
length and commas to the element around them, half as many to the next and a third to the one after. An
element's points are discounted by the share of its text that stands in links. The best element, or
the article or main element that holds it, and those of its siblings that have a good part of its points or are
paragraphs and headings with few links are kept, without what never belongs to an article.

Menus, footers and what is hidden go whatever they hold. A form, or an element whose class, id or role names a part that
is no article, goes unless it is a wrapper of the page: one with the title or main element and a good part of the text in
it, or, for names that wrappers bear too, with nearly all of it. Every step takes time in proportion to the page.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from viatrix.llm.words import slices

OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][\w:-]*)|[!?])")
#: the rest of a tag, with quoted values whole
REST = re.compile(r"""(?:[^"'>]++|"[^"]*"|'[^']*')*+>""")
#: what no text is in, up to its closing tag
OPAQUE = set("script style noscript template svg iframe textarea select title".split())
#: those that go on to the page's end if nothing closes them
RAW = {"script", "style", "textarea", "title"}
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
DROPPED = set("nav footer aside button head menu option optgroup".split())
FORMS = set("form dialog fieldset".split())
SAFE = {"html", "body", "article", "main"}
#: parts of class, id and role that mark what is no article
MARKS = set(
    "ad ads adsbygoogle adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies discussion disqus footer form gdpr"
    " header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promoted related replies reply search"
    " share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget alert disclaimer".split()
)
#: of these, those that wrappers of whole pages bear too, as in nav-open or search-page; and those of readers' comments
ROOMY = set("nav menu menubar navbar sidebar header footer social tags search login share sharing banner toolbar navigation widget".split())
READERS = set("comment comments commentlist discussion disqus replies reply".split())
#: words that go with marks in names of parts, as in site-footer or related-posts; a name of marks and these alone is no title
FURNITURE = set(
    "a also all and app archive area article articles author back bar bars body bottom box buttons button by card cards center col column container content count date desktop entry fixed for from global group head heading hide"
    " holder icon icons id image in inner inline item items label layout left link links list lists main meta mobile more my new news of on outer overlay page pages panel post posts primary read right row secondary section sections short show site"
    " slider small slot sticky story stories text the this thread time title to top unit user view wrap wrapper you your zone".split()
)
#: what holds text of its own, and rarely a part of a page
LEAVES = {"p", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption", "caption", "table", "tbody"}
ARTICLE, BESIDE = {"article", "post", "entry"}, {"has", "with", "no", "without"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}


#: how an element goes: stays, always goes, goes unless it has a heading, goes unless it wraps the page, goes unless it wraps its title or main element
STAYS, GOES, HEADED, ROOM, TITLED = range(5)


def pure(name: str) -> bool:
    """Whether a name consists of marks, numbers and words that go with marks: what a title of an article's part rarely does."""
    return all(p in MARKS or p in FURNITURE or p.isdigit() for p in re.split(r"[^a-z0-9]+", name) if p)


def marked(tag: str, kind: str, value: str, in_article: bool) -> set[str]:
    """Parts of an attribute (class, id, role) that mark an element as no article.

    Ids of headings and of what is in an article are often made from titles, as are some names of paragraphs and the like: of these only names
    that are marks altogether count.
    """
    strict = tag in HEADINGS or tag in LEAVES or in_article and kind == "id"
    if tag in HEADINGS and kind == "id":
        return set()
    names = [x for x in value.split() if not strict or pure(x)]
    return MARKS & {p for x in names for p in re.split(r"[^a-z0-9]+", x)}


def fate(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element stays, by its tag and attributes."""
    if tag in DROPPED or tag == "header" and not in_article:
        return GOES
    if "-" in tag and MARKS & set(tag.lower().split("-")):  # an element of the page's own making
        return GOES
    out = ROOM if tag in FORMS else STAYS
    if not attributes.strip():
        return out
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            if tag not in SAFE:
                return GOES
        if name in ("class", "id", "role"):
            parts = set(re.split(r"[^a-z0-9]+", value))
            found = marked(tag, name, value, in_article)
            if tag in SAFE:
                found &= READERS if tag == "article" else set()
            if parts & ARTICLE:
                found -= {"header", "tags"}
            if parts & BESIDE:  # a wrapper that tells what it has beside it
                found -= {"sidebar", "banner", "header", "footer", "nav", "ad", "ads", "comments"}
            if found and tag == "section" and in_article and not any(pure(x) and MARKS & set(re.split(r"[^a-z0-9]+", x)) for x in value.split()):
                out = max(out, HEADED)  # a part of an article, if it has a heading
            elif found:
                out = max(out, ROOM if found <= ROOMY else TITLED)
    return out


def tokens(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(None, False, text) and (tag, closes, attributes), in order; comments and what is opaque are left out."""
    at, lower, endless = 0, None, set()
    while True:
        m = OPEN.search(page, at)
        more = page.find(">", m.end()) if m else -1
        if not m or more < 0 and not m[1]:
            break
        if m.start() > at:
            yield None, False, page[at : m.start()]
        if m[1]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        rest = REST.match(page, m.end())
        at = rest.end() if rest else more + 1  # a quote that nothing closes is no quote
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        inside = page[m.end() : at - 1]
        if tag in OPAQUE and not m[2]:
            if tag == "svg" and inside.endswith("/"):
                continue
            lower = page.lower() if lower is None else lower
            if len(lower) != len(page):  # some letters change their length
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in page)
            end = lower.find(f"</{tag}", at) if tag not in endless else -1
            end = page.find(">", end) if end >= 0 else -1
            if end < 0:
                endless.add(tag)
            at = end + 1 if end >= 0 else len(page) if tag in RAW else at
            continue
        yield tag, bool(m[2]), inside
    if at < len(page):
        yield None, False, page[at:]


def name_of(attributes: str) -> str:
    """The class of an element, empty if it has none."""
    return next((" ".join(v.strip("\"'").lower().split()) for n, v in ATTRIBUTE.findall(attributes) if n.lower() == "class"), "") if attributes.strip() else ""


def main_text(page: str) -> str:
    """The article's blocks, one a line; empty if there is none."""
    if not page:
        return ""
    # of every element: its tag, parent, fate, whether text in it is left out at once, whether in an article, and whether it is part of a line
    tags, parents, fates, gone, articles, inline, names = ["#root"], [-1], [STAYS], [False], [False], [False], [""]
    stack, still_open = [0], Counter()
    blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
    parts: list[tuple[str, bool]] = []
    link = False

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                node = stack[-1]
                while inline[node]:
                    node = parents[node]
                linked = sum(len(p.strip()) for p, inside in parts if inside)
                blocks.append((node, text, min(linked, len(text))))
            parts.clear()

    def push(tag: str, how: int, part: bool, attributes: str) -> None:
        top = stack[-1]
        tags.append(tag)
        names.append("" if part else name_of(attributes))
        parents.append(top)
        fates.append(how)
        gone.append(gone[top] or how == GOES)
        articles.append(articles[top] or tag in ("article", "main"))
        inline.append(part)
        stack.append(len(tags) - 1)
        still_open[tag] += 1

    def close(to: int) -> None:
        for i in stack[to:]:
            still_open[tags[i]] -= 1
        del stack[to:]

    for tag, closes, rest in tokens(page):
        if tag is None:
            if not gone[stack[-1]]:
                parts.append((html.unescape(rest) if "&" in rest else rest, link))
            continue
        if tag == "a":
            link = not closes
        if tag == "br":
            parts.append((" ", False))
        elif tag in BLOCKS:
            flush()
            if closes:
                if still_open[tag]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if tags[stack[k]] == tag))
                link = False
                continue
            if tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in ENDS[tag]:
                        close(k)
                        break
                    if tags[stack[k]] in SCOPES[tag]:
                        break
            if tags[stack[-1]] == "p" or tags[stack[-1]] in HEADINGS and tag in HEADINGS:
                close(len(stack) - 1)
            if tag not in VOID:
                push(tag, fate(tag, rest, articles[stack[-1]]), False, rest)
        elif closes:
            if still_open[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if tags[stack[k]] == tag))
        elif tag not in VOID and not rest.endswith("/") and (still_open[tag] or fate(tag, rest, True) != STAYS):
            # inside of a line only what goes, and what is within of the same name, is told apart
            push(tag, STAYS if fate(tag, rest, True) == STAYS else GOES, True, rest)
    flush()
    # children come after their parents: sums go up in one sweep
    below = range(len(tags) - 1, 0, -1)
    chars, titled, headed = [0] * len(tags), [t in ("h1", "main") for t in tags], [t in HEADINGS for t in tags]
    for node, text, _ in blocks:
        chars[node] += len(text)
    for i in below:
        chars[parents[i]] += chars[i]
        titled[parents[i]] |= titled[i]
        headed[parents[i]] |= headed[i]
    for i in range(1, len(tags)):
        share = chars[i] / max(chars[0], 1)
        gone[i] = gone[parents[i]] or fates[i] == GOES or fates[i] == HEADED and not headed[i] or fates[i] >= ROOM and not (titled[i] and share >= 0.3 or fates[i] == ROOM and share >= 0.9)
    blocks = [b for b in blocks if not gone[b[0]]]
    if not blocks:
        return ""
    points, chars, linked = [0.0] * len(tags), [0] * len(tags), [0] * len(tags)
    leaf = {"p", "pre", "blockquote", "td", "li", "dd", "dt", "figcaption"} | HEADINGS

    def menu_entry(node: int, text: str, in_links: int) -> bool:
        """A list's item that is one link, but for lists of an article."""
        return tags[node] == "li" and in_links > 0.8 * len(text) and not articles[node]

    for node, text, in_links in blocks:
        x = 0 if menu_entry(node, text, in_links) else 1 + text.count(",") + min(len(text) / 100, 3)
        up = parents[node] if tags[node] in leaf and node else node
        for share in (1, 2, 3):
            if up < 0:
                break
            points[up] += x / share
            up = parents[up]
        chars[node] += len(text)
        linked[node] += in_links
    for i in below:
        chars[parents[i]] += chars[i]
        linked[parents[i]] += linked[i]
    score = [p * (1 - b / c) if c else 0.0 for p, c, b in zip(points, chars, linked)]
    for i, t in enumerate(tags):
        if t in ("article", "main") and chars[i]:
            score[i] += 25
    best = max(range(len(tags)), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        return ""
    up = best
    while up >= 0 and tags[up] not in ("article", "main"):
        up = parents[up]
    best = up if up >= 0 else best
    chosen = {best}
    for i in range(len(tags)):
        if parents[i] == parents[best] and i != best:
            # these give their points to the parent
            plain = (tags[i] == "p" or tags[i] in HEADINGS) and linked[i] < 0.25 * chars[i]
            # parts of one kind, as rows are
            plain |= tags[i] == tags[best] and names[best] != "" and names[i] == names[best] and linked[i] < 0.5 * chars[i]
            if plain or score[i] >= max(10.0, 0.2 * score[best]):
                chosen.add(i)
    keep = [False] * len(tags)
    for i in range(len(tags)):
        keep[i] = i in chosen or (parents[i] >= 0 and keep[parents[i]])
    return "\n".join(text for node, text, in_links in blocks if keep[node] and not menu_entry(node, text, in_links))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html; other columns are not read).

    A null or empty html has an empty text, as has a page without text outside of menus and the like. Ties of
    points go to the element that begins first. Whole pages are read and repeated rows extracted each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
