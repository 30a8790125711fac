"""Main text of web pages by template deduction over the pages of a host.

Every page becomes tokens: elements and text blocks, each with the path of
containers it stands in. Tokens with the same occurrence vector, the numbers of
their occurrences on each page of the host, form an equivalence class. A vector
is kept as the exclusive-or of one hash per page and number, so Spark forms the
classes with partial aggregations and no host is ever held together. Classes
with enough elements nest, by their paths, into the host's template; a text block
that shares its vector with elements belongs to the template. The slots are what
stands between: a block belongs to the innermost template element around it. The
article is what fills the slots inside the template's ``article`` or ``main``, or,
on pages that fill none of those, all slots outside side containers. Class and id
words are weak evidence: they never make the page, the article, what contains it
or a paragraph a side container. Forms, field sets, dialogs and objects are sides
unless the article stands in them, as in pages that one form wraps.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh64_intdigest

from ..session import written
from .tables import as_strings, rows_of

_ROWS = 1_000
# Element names of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDES = frozenset("aside button canvas datalist footer head menu nav search select svg".split())
# sides unless the article stands in them
WRAPPERS = frozenset("dialog fieldset form object".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Words of class, id and role that name a side container.
SIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertisements adverts adsense banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright disclaimer disqus footer form login menu menubar modal "
    "nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "recommended related replies reply reviews search share sharing sidebar sidenav signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar topbar widget widgets".split()
)
HEAD_WORDS = frozenset("header masthead".split())        # sides unless they stand inside the article
# What a side word may be followed by in one class name, and what before it only states a fact.
PART_WORDS = frozenset(
    "area bar block body bottom box button buttons consent container content count form group holder icon icons inner "
    "item items left link links list main menu meta outer panel posts primary right secondary section tertiary text "
    "title top widget widgets wrap wrapper".split()
)
STATE_WORDS = frozenset("has have hide hidden is no not show with without".split())
# Elements that class words never make a side.
NEVER_SIDES = frozenset("html body main article p pre blockquote h1 h2 h3 h4 h5 h6 figure figcaption dt dd caption".split())

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|[!?/][^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


TEXT, ELEMENT, MAIN = 0, 1, 2                            # kinds of tokens; MAIN: inside the article


@dataclass(frozen=True)
class Template:
    """When a class counts as template."""

    least_elements: int = 2         # elements of a class
    element_pages: int = 2          # distinct pages with an element, or all pages of a smaller host
    text_pages: int = 3             # distinct pages with a text block
    text_share: float = 0.5         # of the host's distinct pages, for a text block


def _number(text: str) -> int:
    value = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


def _named(classes: list[list[str]], words: frozenset[str]) -> bool:
    """Whether a class name says side: its last word does, or its first and the others are parts of a container."""
    for name in classes:
        name = [w for w in name if not w.isdigit()]
        if not name or not STATE_WORDS.isdisjoint(name):
            continue
        if name[-1] in words or (name[0] in words and PART_WORDS.issuperset(name[1:])):
            return True
    return False


class _Page:
    """Blocks and tokens of one page, gathered from its tags in one pass."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []    # name, path, side, main, sides by class
        self.words: list[str] = []
        # path, side, main paths around it, text; sides by class are told at the end
        self.blocks: list[tuple[str, bool, list[str], str]] = []
        self.doubts: list[tuple[int, ...]] = []              # sides by class around each block
        self.named = 0                                       # sides by class so far
        # mains and articles outside sides by element or role: is main, inside a main, side word of its own, sides by class
        self.articles: list[tuple[bool, bool, bool, tuple[int, ...]]] = []
        self.tokens: Counter = Counter()
        self.kinds: dict[str, int] = {}

    def at(self) -> tuple[str, str, bool, bool, tuple[int, ...]]:
        return self.open[-1] if self.open else ("", "", False, False, ())

    def text(self, raw: str) -> None:
        if raw:
            self.words.append(raw)

    def flush(self) -> None:
        if self.words:
            text = " ".join(html.unescape("".join(self.words)).split())
            self.words = []
            if text:
                _, path, side, _, doubts = self.at()
                self.blocks.append((path, side, [x[1] for x in self.open if x[3]], text))
                self.doubts.append(doubts)
                self.tokens[f"{path}\n{text}"] += 1

    def start(self, name: str, attributes: str) -> None:
        names: list[str] = []
        classes: list[list[str]] = []
        role = ""
        if attributes and ("=" in attributes):
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "")
                if key in ("class", "id"):
                    for one in html.unescape(value).split():
                        classes.append(_WORD.findall(_CAMEL.sub("-", one).lower()))
                        names += classes[-1]
                elif key == "role":
                    role = value.strip().lower()
        main = self.at()[3]
        is_main = name in ("article", "main") or role in ("article", "main")
        is_side = name in SIDES or (role in SIDE_WORDS and name not in ("html", "body")) or (
            not main and (name == "header" or role == "banner"))
        by_class = _named(classes, SIDE_WORDS if main else SIDE_WORDS | HEAD_WORDS)
        is_named = (by_class or name in WRAPPERS) and not is_side and not is_main and name not in NEVER_SIDES
        if name not in BLOCKS and not is_side and not is_named:
            return
        self.flush()                                     # the text before an inline side is not part of it
        if name in BLOCKS:
            if name in CLOSES_P:
                self.close("p", stop=("button", "table", "td", "th"))
            if name == "li":
                self.close("li", stop=("ul", "ol", "menu", "dir"))
            elif name in ("td", "th"):
                self.close("td", stop=("tr", "table")) or self.close("th", stop=("tr", "table"))
            elif name == "tr":
                self.close("tr", stop=("table",))
            elif name in ("dt", "dd"):
                self.close("dt", stop=("dl",)) or self.close("dd", stop=("dl",))
        _, path, side, main, doubts = self.at()
        path = f"{path}/{name}" + "".join(f".{n}" for n in sorted(set(names)) if not n.isdigit())
        self.tokens[path] += 1
        if is_main and not side and not is_side:
            self.articles.append((name == "main" or role == "main", main, by_class, doubts))
            main = True
        self.kinds[path] = MAIN if main else ELEMENT
        if is_named:
            doubts = (*doubts, self.named)
            self.named += 1
        self.open.append((name, path, side or is_side, main, doubts))

    def settle(self) -> None:
        """Blocks in sides by class, in forms and the like become side blocks, but for sides that contain the article.

        The article is the ``main`` and the ``article`` with the fewest sides by
        class around it, the first of those; beside a ``main`` only articles in it
        and without a side word of their own count. Where nothing else would be
        left of a page, its sides by class stay.
        """
        mains = [a for a in self.articles if a[0]]
        articles = [a for a in self.articles if not a[0] and (not mains or (a[1] and not a[2]))]
        around = {k for some in (mains, articles) if some for k in min(some, key=lambda a: (len(a[3]), a[2]))[3]}
        sides = [side or not around.issuperset(doubts) for (_, side, _, _), doubts in zip(self.blocks, self.doubts)]
        if not all(sides):
            self.blocks = [(path, now, over, text) for (path, _, over, text), now in zip(self.blocks, sides)]

    def close(self, name: str, stop: tuple[str, ...] = ()) -> bool:
        """End the innermost open element of that name, and what is open inside it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                self.flush()
                del self.open[k:]
                return True
            if self.open[k][0] in stop:
                return False
        return False


def parse(source: str | None) -> _Page:
    """Blocks and tokens of a page; NULL and empty pages have none. Broken markup never fails."""
    page, at = _Page(), 0
    source = source or ""
    while True:
        found = _TAG.search(source, at)
        if not found:
            break
        page.text(source[at:found.start()])
        at = found.end()
        closing, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        if closing:
            if name in BLOCKS:
                page.flush()
            page.close(name)
        elif name in RAW:
            end = _END[name].search(source, at)
            at = end.start() if end else len(source)
        elif name == "br":
            page.text(" ")
        elif name in EMPTY:
            if name == "hr":
                page.flush()
        else:
            page.start(name, attributes)
    page.text(source[at:])
    page.flush()
    page.settle()
    return page


PARSED = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()),
    T.StructField("page", T.LongType()),
    T.StructField("tokens", T.ArrayType(T.StructType([
        T.StructField("token", T.LongType()), T.StructField("kind", T.IntegerType()),
        T.StructField("n", T.IntegerType())]))),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("token", T.LongType()), T.StructField("around", T.ArrayType(T.LongType())),
        T.StructField("text", T.StringType())]))),
])


def _host(url: str | None) -> str:
    _, mark, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if mark else ""


def parsed_pages(pages: DataFrame, page_id: str, url: str, source: str) -> DataFrame:
    """Stored pages: their tokens with numbers of occurrences, and the blocks outside side containers.

    ``page`` numbers a page by its content, so that copies of a page are one
    page of the occurrence vectors.
    """
    text_type = pa.struct([("token", pa.int64()), ("around", pa.list_(pa.int64())), ("text", pa.string())])
    token_type = pa.struct([("token", pa.int64()), ("kind", pa.int32()), ("n", pa.int32())])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(token_type), pa.list_(text_type)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, _ROWS):
            rows = []
            for i, address, body in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_strings(batch.column(2))):
                page = parse(body)
                numbers = {t: _number(t) for t in page.tokens}
                rows.append((
                    i, address, _host(address), _number("\n".join(sorted(page.tokens))),
                    [(numbers[t], page.kinds.get(t, TEXT), n) for t, n in page.tokens.items()],
                    [(numbers[f"{path}\n{text}"], [numbers[x] for x in around], text)
                     for path, side, around, text in page.blocks if not side],
                ))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             names=PARSED.fieldNames())

    return written(pages.select(F.col(page_id).cast("bigint"), F.col(url), F.col(source)).mapInArrow(read, PARSED))


def templates(parsed: DataFrame, template: Template = Template()) -> DataFrame:
    """host, main, texts: tokens of the template's main elements and of its text blocks, for every host."""
    distinct = parsed.select("host", "page", "tokens").dropDuplicates(["host", "page"])
    hosts = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    vectors = distinct.select("host", "page", F.explode("tokens").alias("t")).groupBy("host", "t.token", "t.kind").agg(
        F.bit_xor(F.xxhash64("page", "t.n")).alias("vector"), F.count("*").alias("support"))
    is_text = F.col("kind") == TEXT
    enough = F.when(is_text, F.greatest(F.lit(template.text_pages), F.col("pages") * template.text_share)).otherwise(
        F.least(F.lit(template.element_pages), F.col("pages")))
    # most text blocks stand on one page; they go before rows of a host meet
    common = vectors.where(~is_text | (F.col("support") >= template.text_pages)).join(hosts, "host").where(
        F.col("support") >= enough)
    return common.groupBy("host", "vector", "support").agg(
        F.count_if(~is_text).alias("elements"),
        F.collect_list(F.when(F.col("kind") == MAIN, F.col("token"))).alias("main"),
        F.collect_list(F.when(is_text, F.col("token"))).alias("texts"),
    ).where(F.col("elements") >= template.least_elements).groupBy("host").agg(
        F.flatten(F.collect_list("main")).alias("main"), F.flatten(F.collect_list("texts")).alias("texts"))


def extract(
    pages: DataFrame, template: Template = Template(), page_id: str = "page_id", url: str = "url", source: str = "html",
) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Blocks are joined by an empty line. NULL, empty and textless pages give an
    empty text; pages with a NULL or relative url share the empty host. Repeated
    rows give a row each; other columns are not read.
    """
    parsed = parsed_pages(pages, page_id, url, source)
    found = written(templates(parsed, template).withColumnRenamed("host", "of"))
    rows = parsed.select("page_id", "url", "host", "blocks").join(found, F.col("host") == F.col("of"), "left")
    nothing = F.array().cast("array<bigint>")
    in_main = F.filter("blocks", lambda b: F.arrays_overlap(b["around"], F.coalesce("main", nothing)))
    apart = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("texts", nothing), b["token"]))
    rows = rows.select("page_id", "url", in_main.alias("in_main"), apart.alias("apart"))
    kept = F.when(F.size("in_main") > 0, F.col("in_main")).otherwise(F.col("apart"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
