"""Text expressions. Operators P7-P13, P15, P17-P25, P31, F6-F12, M2."""

from __future__ import annotations

import html as html_entities
from collections.abc import Sequence
from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ASCII_SPACE = r"[ \t\n\r\f\x0B]+"
#: What error pages say in their first 2000 characters.
ERROR_PHRASES = (
    "page you're looking for was not found", "page not found", "404 not found", "404 error", "http error 404", "this page doesn't exist",
    "this page has been removed", "this page is no longer available", "this page can't be found", "this page cannot be found", "the page has moved",
    "content not available", "access denied", "403 forbidden", "sorry, we couldn't find", "the requested url was not found", "page has been archived",
    "this content has been removed", "bad gateway", "502 bad gateway", "503 service unavailable", "500 internal server error", "server error",
    "no web page was found", "web page not available",
)
#: Words of site navigation.
NAVIGATION_WORDS = ("log in", "register", "membership", "search", "cookie", "sign up", "subscribe", "newsletter", "menu", "navigation", "currency", "cart", "checkout")
#: The sentences that address a community, and greetings.
GREETING = r"(?i)^(?:[ \t\n\r\f\x0B]*(?:hey|hi|hello|greetings|howdy)[ \t\n\r\f\x0B]*(?:everyone|all|team|guys|folks|y'?all|there|community)?[ \t\n\r\f\x0B]*[,.!:]?[ \t\n\r\f\x0B]+)+"
COMMUNITY_SENTENCES = (
    r"has\s+(?:any(?:one|body))\s+(?:ever\s+)?[^.?!]*[.?!]",
    r"have\s+any\s+of\s+(?:you|y'all)\s+[^.?!]*[.?!]",
    r"does\s+any(?:one|body)\s+[^.?!]*[.?!]",
    r"did\s+any(?:one|body)\s+[^.?!]*[.?!]",
    r"any(?:one|body)\s+(?:here|else|have|has|know|knows|dealt|encountered|experienced|familiar)\b[^.?!]*[.?!]",
    r"any\s+(?:tips|advice|thoughts|suggestions|help|insights|ideas|pointers|recommendations|guidance|input|feedback|experiences)\b[^.?!]*[.?!]",
    r"(?:would|i'd)\s+love\s+any\s+[^.?!]*[.?!]",
    r"can\s+some(?:one|body)\s+[^.?!]*[.?!]",
    r"if\s+any(?:one|body)\s+(?:has|knows|can)\s+[^.?!]*[.?!]",
    r"(?:i'm\s+)?looking\s+for\s+(?:advice|tips|input|help|thoughts|suggestions|guidance)[^.?!]*[.?!]",
    r"how\s+do\s+you\s+(?:\w+\s+)?(?:folks|guys|all|everyone|pros|experts|veterans)\b[^.?!]*[.?!]",
    r"how\s+does\s+everyone\s+[^.?!]*[.?!]",
)


def drop(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_form(text: Column) -> Column:
    """P17."""
    return F.lower(collapse(text))


def clean_html(html: Column) -> Column:
    """Without scripts, styles and tags."""
    return collapse(F.regexp_replace(drop(html, r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>"), r"<[^>]+>", " "))


def strip_chrome(html: Column) -> Column:
    """Without scripts, styles, navigation, frame elements, comments and advertising blocks; tags stay."""
    parts = [rf"(?i)<{t}[\s\S]*?</{t}>" for t in ("script", "style", "nav", "footer", "header", "aside")]
    return drop(html, *parts, r"<!--[\s\S]*?-->", r"(?i)<div[^>]*(?:sidebar|menu|breadcrumb|tag-cloud|related|advert|cookie)[^>]*>[\s\S]*?</div>")


def unescape_basic(text: Column) -> Column:
    """P9 for the five basic entities; the ampersand is last, so nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All named and numbered entities, in Arrow batches: their table is the standard library's."""
    return text.map(lambda t: None if t is None else html_entities.unescape(t))


def article_focus(html: Column, least: int = 3, most: int = 30, chars: int = 60000) -> Column:
    """P10: the first articles if there are several, else the page."""
    articles = F.regexp_extract_all(html, F.lit(r"(?i)<article[\s\S]*?</article>"), 0)
    return F.substring(collapse(F.when(F.size(articles) >= least, F.array_join(F.slice(articles, 1, most), "\n\n")).otherwise(html)), 1, chars)


def title(html: Column, chars: int = 200) -> Column:
    """P11."""
    return F.substring(collapse(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)), 1, chars)


_DATE_NAMES = r"(?:article:published_time|datePublished|publish_date|pubdate|date|dc\.date|dc\.date\.issued)"
_VERSION_NAMES = r"(?:version|edition|dc\.version)"


def _meta(names: str) -> tuple[str, str]:
    return (rf"""(?i)<meta[^>]+(?:property|name)=["']{names}["'][^>]+content=["']([^"']+)["']""", rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+(?:property|name)=["']{names}["']""")


def _first(html: Column, patterns: tuple[str, ...]) -> Column:
    return F.trim(F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns], F.lit("")))


def publication_date(html: Column) -> Column:
    """The first of the ordered patterns that matches, as YYYY[-MM[-DD]] if it has one, else its first 32 characters."""
    raw = _first(html, (*_meta(_DATE_NAMES), r"""(?i)<time[^>]+datetime=["']([^"']+)["']"""))
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"([0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?)", 1), F.lit("")), F.substring(raw, 1, 32))


def version(html: Column) -> Column:
    """P13."""
    return F.substring(_first(html, _meta(_VERSION_NAMES)), 1, 64)


def content_hash(text: Column) -> Column:
    """16 hexadecimal digits."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def row_id(prefix: str, *parts: Column) -> Column:
    """A short id from joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 10))


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """The distinct tokens of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0))


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null or blank."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " "), r"^ | $", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def strip_voice(text: Column) -> Column:
    """Without greetings and sentences that address a community, with tidy spaces and a capital first."""
    t = F.regexp_replace(F.regexp_replace(text, GREETING, ""), "(?i)" + "|".join(f"(?:{p})" for p in COMMUNITY_SENTENCES), "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s+([.,!?;:])", "$1"))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def first_sentences(text: Column, most: int = 220) -> Column:
    """Cut at the first sentence end after character 60 within reach, else at `most`."""
    t = collapse(text)
    at = F.regexp_instr(F.substring(t, 61, most), F.lit(r"[.!?](\s|$)"))
    cut = F.when(at > 0, F.substring(t, F.lit(1), F.lit(60) + at)).otherwise(F.substring(t, 1, most))
    return F.when(F.length(t) <= most, t).otherwise(F.rtrim(F.trim(cut), F.lit("…")))


def drop_parentheses(title_: Column) -> Column:
    """P24."""
    return collapse(F.regexp_replace(title_, r"\([^)]{0,40}\)", " "))


def or_terms(titles: Column) -> Column:
    """P25."""
    return F.array_join(F.transform(titles, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def length_quota(chars: Column) -> Column:
    """P31."""
    return F.when(chars < 4000, 1).when(chars < 9000, 2).otherwise(3)


def too_short(text: Column, least: int = 1500) -> Column:
    """the reason, or null."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < least, F.concat(F.lit("too_short_"), n.cast("string")))


def format_kind(content_type: Column, url: Column, head: Column) -> Column:
    """pdf or html, from the content type, the suffix or the magic bytes."""
    return F.when(F.lower(content_type).contains("pdf") | F.lower(url).endswith(".pdf") | head.startswith("%PDF-"), "pdf").otherwise("html")


def error_page(text: Column) -> Column:
    """F8: the first phrase of an error page in the first 2000 characters, or null."""
    head = F.lower(F.substring(text, 1, 2000))
    return F.coalesce(*[F.when(F.contains(head, F.lit(p)), F.lit(p)) for p in ERROR_PHRASES])


def substance(text: Column) -> Column:
    """the text without images, links, URLs, headers and rules."""
    t = drop(text, r"!\[.*?\]\(.*?\)", r"\[.*?\]\(.*?\)", r"https?://\S+", r"#{1,6}\s.*")
    return collapse(F.regexp_replace(t, r"[|_*\-=]+", " "))


def thin_reason(text: Column) -> Column:
    """too_thin, no_sentences, navigation or null."""
    s = substance(text)
    periods = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    head = F.substring(F.lower(s), 1, 500)
    nav = sum((F.contains(head, F.lit(w)).cast("int") for w in NAVIGATION_WORDS), F.lit(0))
    return F.when(F.length(s) < 500, "too_thin").when(periods < 3, "no_sentences").when(nav >= 4, "navigation")


def quote_in(quote: Column, document: Column) -> Column:
    """a quote of 30 characters or more stands in the document whole or by its first 80; both in normal form."""
    q, d = normal_form(quote), normal_form(document)
    return (F.length(q) >= 30) & (F.contains(d, q) | F.contains(d, F.substring(q, 1, 80)))


def jaccard(a: Column, b: Column) -> Column:
    """M2: 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


#: Words of a title that asks something.
ASKING = ("how", "what", "help", "advice", "question", "should i", "can i", "anyone", "tips", "issue", "problem", "struggling", "new to")


def asks(title_: Column, body: Column, comments: Column) -> Column:
    """a title that asks, more than 100 characters of text and two comments or more."""
    low = F.lower(F.coalesce(title_, F.lit("")))
    cue = F.lit(False)
    for word in ASKING:
        cue = cue | F.contains(low, F.lit(word))
    return cue & (F.length(F.coalesce(body, F.lit(""))) > 100) & (F.coalesce(comments, F.lit(0)) >= 2)


def prompt(template: str, **fields: Column) -> Column:
    """A template with its {fields}; a null field is empty, and double quotes in fields become single ones. Braces stand doubled."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.replace(F.coalesce(fields[name].cast("string"), F.lit("")), F.lit('"'), F.lit("'")))
    return F.concat(*parts) if parts else F.lit("")


def required(fields: Sequence[Column], choice: Column, allowed: Sequence[str], default: str) -> tuple[Column, Column]:
    """whether all fields hold more than blanks, and the choice if it is allowed, else the default."""
    filled = F.lit(True)
    for f in fields:
        filled = filled & (F.trim(F.coalesce(f, F.lit(""))) != "")
    low = F.lower(F.trim(choice))
    return filled, F.when(low.isin(*allowed), low).otherwise(default)
