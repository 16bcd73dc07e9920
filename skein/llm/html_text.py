"""Main text of web pages by two passes of block rules.

The markup is cut into blocks at block-level tags. The first pass looks at each block alone:
its length, the share of its characters inside links, and its density of stop words say
whether it is text, boilerplate, or a short or middling block that cannot be told yet. A
block inside a part that is boilerplate by its nature (a menu, a form, an advert, ...) is
boilerplate; one inside a part declared as main needs less evidence to be text, and lack of
stop words leaves it open. The second pass gives each undecided block the label of its
nearest decided neighbours: where both sides agree, theirs; where they differ, that of the
side in the same section, else text only for a block that was near to text. A declared main
part that has no decided block at all is kept: its page declares what no rule denies.

Time is linear in the page, whatever its markup: a token is matched once and never given
back, open elements are counted by name, and a missing end tag is looked for once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import bound_batches

MAX_LINK_DENSITY = 0.4
SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.10, 0.25

#: Fixed: common function words of the languages met, for the stop-word density.
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more
    no not of on one or our out she so that the their them there they this to up was we were what when which who will with
    would you aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat
    ich im in ist mit nach nicht noch oder sich sie sind so über um und von vor war wie wird zu zum zur au aux avec ce ces
    comme dans de des du elle en est et été il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que
    qui sa se ses son sont sur un une vous al como con cual del donde el ella en entre era es esta este fue ha hay la las
    le lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también un una y ya""".split()
)

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frame h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary
    table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose content is never text of the page.
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title".split())
#: Elements that are boilerplate by their nature; in an article, header and footer are so too.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that name boilerplate.
BOILER_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
    consent contentinfo cookie cookies copyright disclaimer disqus dropdown footer form gdpr header login masthead menu
    menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion
    recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription tagcloud tags toolbar widget""".split()
)
MAIN_TAGS = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+(?:>|\Z)", re.S)
END = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORDS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """Text between two block borders and where it stands."""

    text: str
    linked: int = 0
    boiler: bool = False
    heading: bool = False
    section: int = 0
    main: bool = False
    label: str = field(default="", compare=False)


def named_boiler(tag: str) -> bool:
    """Whether the attributes of a start tag name a boilerplate part or hide it."""
    for m in ATTRIBUTE.finditer(tag):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id", "role") and not BOILER_NAMES.isdisjoint(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())):
            return True
    return False


def kind_of(name: str) -> str:
    """The kind of element that blocks remember: heading, main part, link, or none of these."""
    return "a" if name == "a" else "main" if name in MAIN_TAGS else "heading" if re.fullmatch("h[1-6]", name) else ""


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in order, white space folded, empty ones left out.

    Tags need not be closed or balanced: an end tag closes the nearest open element of its
    name and what is open inside it; one without an open element is a border only. The text
    of a broken last tag is markup. A self-closing tag has no content, of dropped elements too.
    """
    out: list[Block] = []
    open_tags: list[tuple[str, bool]] = []
    inside: Counter = Counter()  # open elements by name, and by kind
    lost: set[str] = set()  # dropped elements with no end tag in the rest of the page
    text: list[str] = []
    linked = sections = boiler = 0

    def close() -> None:
        nonlocal linked
        folded = " ".join("".join(text).split())
        if folded:
            out.append(Block(folded, linked, boiler > 0, inside["/heading"] > 0, sections, inside["/main"] > 0))
        text.clear()
        linked = 0

    def leave(many: int) -> None:
        nonlocal boiler
        for t, bad in open_tags[len(open_tags) - many :]:
            boiler -= bad
            inside[t] -= 1
            inside["/" + kind_of(t)] -= 1
        del open_tags[len(open_tags) - many :]

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        start = m.start() if m else n
        if start > at:
            piece = entities.unescape(html[at:start])
            text.append(piece)
            if inside["/a"]:
                linked += len(" ".join(piece.split()))
        if not m:
            break
        at, token = m.end(), m[0]
        if token.startswith("<![CDATA["):
            text.append(token[9:].removesuffix("]]>"))
            continue
        if not (found := NAME.match(token)):
            continue
        name, ends = found[1].lower(), token[1] == "/"
        if name in BLOCK_TAGS:
            close()
        if ends:
            if inside[name]:
                many = next(k for k in range(1, len(open_tags) + 1) if open_tags[-k][0] == name)
                if any(t in BLOCK_TAGS for t, _ in open_tags[-many:]):
                    close()
                leave(many)
                sections += name in BOILER_TAGS or name in MAIN_TAGS or name in ("div", "section")
            continue
        if name in VOID or name in DROPPED and token.endswith("/>") and name not in ("script", "style", "textarea", "title"):
            continue
        if name in DROPPED:
            end = None if name in lost else END[name].search(html, at)
            if end is None:
                lost.add(name)
            at = end.end() if end else n if name in ("script", "style") else at
            continue
        if name == "p":
            # A paragraph ends the one before it.
            many = next((k for k in range(len(open_tags)) if open_tags[-1 - k][0] not in ("p", "b", "i", "em", "strong", "span", "a")), len(open_tags))
            leave(many)
        bad = name in BOILER_TAGS or name not in ("html", "body", *MAIN_TAGS) and named_boiler(token)
        if not token.endswith("/>"):
            open_tags.append((name, bad))
            boiler += bad
            inside[name] += 1
            inside["/" + kind_of(name)] += 1
            sections += name in BOILER_TAGS or name in MAIN_TAGS or name in ("div", "section")
    close()
    return out


def first_pass(block: Block) -> str:
    """good, bad, near or short, from the block alone."""
    size = len(block.text)
    if block.boiler:
        return "bad"
    if block.linked > MAX_LINK_DENSITY * size:
        return "bad"
    if size < SHORT_CHARS:
        return "short"
    words = WORDS.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= STOP_HIGH and size >= LONG_CHARS:
        return "good"
    if density >= STOP_LOW:
        return "good" if block.main or size >= LONG_CHARS else "near"
    # In the page's declared main part a lack of stop words is no proof against a block.
    return "near" if block.main else "bad"


def second_pass(found: list[Block]) -> None:
    """Give undecided blocks the label of their nearest decided neighbours."""
    n = len(found)
    before: list[int] = [-1] * n
    after: list[int] = [n] * n
    for i in range(1, n):
        before[i] = i - 1 if found[i - 1].label in ("good", "bad") else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if found[i + 1].label in ("good", "bad") else after[i + 1]
    settled = []
    for i, b in enumerate(found):
        if b.label in ("good", "bad"):
            settled.append(b.label)
            continue
        # Beyond either end of the page there is no text.
        sides = [found[k] if 0 <= k < n else Block("", section=-1, label="bad") for k in (before[i], after[i])]
        # In a main part only neighbours of that part count, and with none the block stays.
        if b.main:
            sides = [s for s in sides if s.main and not s.boiler] or [Block("", label="good")]
        labels = {s.label for s in sides}
        if len(labels) == 1:
            settled.append(labels.pop())
        elif b.heading and after[i] < n:
            settled.append(found[after[i]].label)
        else:
            same = {s.label for s in sides if s.section == b.section}
            settled.append(same.pop() if len(same) == 1 else "good" if b.label == "near" or b.main else "bad")
    for b, label in zip(found, settled):
        b.label = label


def main_text(html: str) -> str:
    """The page's text blocks in order, one to a line; empty if there are none."""
    found = blocks_of(html)
    for b in found:
        b.label = first_pass(b)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of pages (columns page_id, url, html; any others are ignored).

    Null html is empty, and its text too; a null page_id or url stays null. Pages are read whole
    and independently, however long: no exchange, repeated rows give repeated results, an
    empty table an empty one.
    """
    bound_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            text = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
