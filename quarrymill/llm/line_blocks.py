"""HTML extraction by line-block distribution.

Markup is stripped to one line for each block; blocks of parts that hold no article (menus, adverts, forms and
the like, by element, role or class) become empty lines, as scripts and styles do. Text lengths are summed over a
sliding window of lines. Text begins at a surge of that sum and ends where it dives; all lines between stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window that make a surge where the page does not mark its article.
SURGE = 80

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
_DROP = frozenset("aside audio button canvas datalist dialog footer form head map menu nav search select video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|adslot|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|"
    r"cookie|cookies|copyright|disqus|footer|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pagination|"
    r"popup|promo|promoted|promotion|related|replies|respond|rail|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|"
    r"toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSES_P = _BLOCKS - frozenset(("button", "option", "select", "summary", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"))
_SPACE = re.compile(r"\s+")


def _drops(tag: str, raw: str, in_article: bool) -> bool:
    if tag in _DROP:
        return True
    if tag == "header":
        return not in_article
    if not raw or tag in ("html", "body", "article", "main") or tag in _VOID:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in _ROLES:
        return True
    return bool(_WORDS.search(found.get("class", "")) or _WORDS.search(found.get("id", "")))


def lines_of(page: str) -> list[tuple[str, bool, int]]:
    """(text, in an article, characters of links) for each block in page order; text is empty for what is dropped."""
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, dropped, in an article
    text: list[str] = []
    linked = 0
    dropped = article = False
    link = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        line = _SPACE.sub(" ", "".join(text)).strip()
        out.append((line, article, linked))
        text.clear()
        linked = 0

    def add(s: str) -> None:
        nonlocal linked
        if s and not dropped:
            s = entities.unescape(s) if "&" in s else s
            text.append(s)
            if link:
                linked += len(s)

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a" and link:
                link -= 1
            if tag == "p" and not any(x[0] == "p" for x in stack):
                flush()
            if any(x[0] == tag for x in stack):
                if tag in _BLOCKS:
                    flush()
                while stack:
                    last = stack.pop()
                    if last[0] in _BLOCKS and last[0] != tag:
                        flush()
                    if last[0] == tag:
                        break
                dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            continue
        raw = m[3] or ""
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not raw.rstrip().endswith("/") or tag not in ("svg", "math"):
                at = close.start() if close else n
                end = page.find(">", at)
                at = n if end < 0 else end + 1
            if tag not in ("math", "svg"):
                flush()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCKS:
            flush()
            for own, within in ((("p",), _CLOSES_P), (("li",), ("li",)), (("dt", "dd"), ("dt", "dd")), (("option",), ("option",)), (("td", "th"), ("td", "th", "tr")), (("tr",), ("tr",))):
                if tag in within and stack and stack[-1][0] in own:
                    stack.pop()
                    dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if tag in _CLOSES_P:  # an open p ends even under open inline elements
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in _BLOCKS), -1)
                if k >= 0 and stack[k][0] == "p":
                    del stack[k:]
                    dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if tag == "a":
            link = 1
        dropped = dropped or _drops(tag, raw, article)
        article = article or tag in ("article", "main")
        stack.append((tag, dropped, article))
    flush()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks joined by two line feeds; empty if there is none."""
    lines = lines_of(page or "")
    if any(inside and line for line, inside, _ in lines):  # lines outside the marked article weigh nothing
        weights = [len(line) if inside else 0 for line, inside, _ in lines]
        surge = 1
    else:
        weights = [0 if link * 2 > len(line) else len(line) for line, _, link in lines]
    n = len(lines)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    kept: list[str] = []
    i = 0
    while i < n:
        if sums[i] < surge or not weights[i]:
            i += 1
            continue
        while i < n and sums[i]:  # up to the dive
            if weights[i]:
                kept.append(lines[i][0])
            i += 1
    return "\n\n".join(kept)


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``, from the whole page.

    Null and empty pages, and pages without text, give an empty text. Unclosed and stray tags are repaired as
    browsers do. A page that marks an article keeps that; otherwise lines between surge and dive. White space,
    no-break space included, becomes one space within a block. Repeated rows are rows of their own, an empty
    table gives an empty result, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                texts = [main_text(p.as_py()) for p in part.column("_html")]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet"))
