"""Column functions over block texts. All lengths and offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes and patterns that results depend on ---
#: Unicode white space, and the class used for content characters (with U+FEFF, without U+0085).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTENT_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{SPACE}]"
CN_DIGITS = "一二三四五六七八九十"
SENTENCE_MARKS = "。．.!！?？;；…"
SENTENCE_END = rf"[{SENTENCE_MARKS}]{S}*\z"
BULLET_START = rf"^{S}*[-–—•·●○◦▪‣*①-⑳]"
HEADING_START = (
    rf"^{S}*(第{S}*[0-9{CN_DIGITS}百]+{S}*[章节条款部分篇]|[0-9]+(\.[0-9]+)*[.、{SPACE}]|[(（][0-9{CN_DIGITS}]+[)）]|[{CN_DIGITS}]+[、.])"
)
LEADING_NUMBERING = (
    rf"^{S}*(第{S}*[0-9{CN_DIGITS}百]+{S}*[章节条款部分篇]{S}*|[0-9]+(\.[0-9]+)*[.、{SPACE}]+|[(（][0-9{CN_DIGITS}]+[)）]{S}*|[{CN_DIGITS}]+[、.]{S}*)"
)
COMMA_SEMI = "[，,；;]"
MD_LINK = r"\[([^\]]*)\]\(([^)]*)\)"
LATEX_BLOCK = r"\$[^$\n]+\$"
LATEX = (
    r"\$[^$\n]+\$|\\(frac|sqrt|begin|end|cdot|times|alpha|beta|lambda|sum|mathsf|mathrm|mathbf|mathit|geqslant|leqslant|operatorname)\b"
    rf"|\\[a-zA-Z]+{S}*\{{"
)
LATEX_COMMAND = r"\\[a-zA-Z]+|[{}]"
ESCAPED_DOLLAR = r"\\\$"
HTML_TAG = (
    r"(?i)</?(?:br|hr|b|i|u|s|em|strong|sub|sup|span|div|p|a|img|font|center|small|big|del|ins|mark|code|pre|table|tbody|thead|tr|td|th)"
    rf"(?:{S}[^<>]*)?/?>"
)
GIANT_HEADING_HIT = rf"(?:^|\n){S}*(?:[0-9]+(?:\.[0-9]+)*[.、{SPACE}]|第{S}*[0-9{CN_DIGITS}百]+{S}*[章节条款])"
PAGE_NUMBER = rf"^[{SPACE}\p{{Nd}}\-–—一二三四五六七八九十之/\\.()（）页第共]+\z"
TRAILING_MARKER = rf"[\[【]相关[^\]】\n]{{0,6}}[\]】]{S}*\z"
NUM_CHAPTER = rf"^{S}*第{S}*([0-9{CN_DIGITS}百]+){S}*[章节条款部分篇]"
NUM_CHINESE = rf"^{S}*([{CN_DIGITS}]+){S}*[、.．]"
NUM_ARABIC = rf"^{S}*([0-9]+(?:[.．][0-9]+)*)"
TABLE_ROW = r"(?is)<tr[\s\S]*?</tr>"
TABLE_CELL = r"(?i)<t[dh]"
#: Character parts that never stand alone, function words whose doubling is suspect, and idioms that double them rightly.
RADICALS = "亻刂冫氵扌犭纟讠钅饣忄衤礻灬丬阝宀疒辶廴"
DOUBLED = "的地是了"
IDIOM_TAILS = {"的": "确确", "地": "道道", "是": "非非"}
FURNITURE = ("page_number", "header", "footer")
#: All characters of SPACE, for trims without a pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: CONTENT_SPACE for Java: characters of ASCII are settled before the rest of the class is looked at.
_FAST_SPACE = rf"\s[\x80-\uffff&&[{CONTENT_SPACE}]]"
# --- thresholds ---
GIANT_CHARS = 1200
ARTIFACT_CHARS, ARTIFACT_PAGES = 30, 3
LEAK_CHARS = 200
HEADING_BODY_CHARS = 40
CANDIDATE_CHARS = 30
MARKER_HEAD_CHARS = 10
DROP_CHARS = 120


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def non_ws(s: Column) -> Column:
    return F.regexp_replace(s, f"[{_FAST_SPACE}]", "")


def non_ws_len(s: Column) -> Column:
    return F.length(non_ws(s))


def at_most(s: Column, n: int) -> Column:
    """``non_ws_len(s) <= n``; long texts are mostly told by their beginning."""
    start = non_ws_len(F.substring(s, F.lit(1), F.lit(2 * n + 1)))
    return F.when(F.length(s) <= n, True).when(start > n, False).otherwise(non_ws_len(s) <= n)


def last_char(s: Column) -> Column:
    """The last character that is no white space."""
    return F.substring(F.rtrim(s, F.lit(SPACES)), F.lit(-1), F.lit(1))


def trim(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.trim(s, F.lit(SPACES))


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{CONTENT_SPACE}]+", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, rf"[{CONTENT_SPACE}]+\z", "")


def glue(a: Column, b: Column) -> Column:
    """What joins two parts of a sentence: a blank between Latin words or after a comma, else nothing."""
    return F.when(a.rlike(rf"[A-Za-z0-9,;]{S}*\z") & b.rlike(rf"^{S}*[A-Za-z0-9]"), F.lit(" ")).otherwise(F.lit(""))


def join_text(a: Column, b: Column) -> Column:
    return F.concat(trim_end(a), glue(a, b), trim_start(b))


def is_furniture(kind: Column) -> Column:
    return kind.isin(*FURNITURE)


def sentence_end(s: Column) -> Column:
    return last_char(s).isin(*SENTENCE_MARKS)


def caption_like(s: Column) -> Column:
    """2 to 30 characters, no sentence end, and 表 or 图 as the last one."""
    # the last character also rules out a sentence end
    return last_char(s).isin("表", "图") & non_ws_len(s).between(2, 30)


def blank_all(a: Column) -> Column:
    """That a list of strings is null, empty or has white space only."""
    return F.coalesce(~F.exists(a, lambda x: F.length(trim(F.coalesce(x, F.lit("")))) > 0), F.lit(True))


def table_rows(body: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(TABLE_ROW), F.lit(0))


def table_shell(body: Column) -> Column:
    return F.regexp_replace(body, TABLE_ROW, "")


def first_row_columns(body: Column) -> Column:
    """Cells in a table's first row."""
    return F.coalesce(F.regexp_count(F.get(table_rows(body), F.lit(0)), F.lit(TABLE_CELL)), F.lit(0))


def is_husk(kind: Column, body: Column, img_path: Column, caption: Column, footnote: Column) -> Column:
    """A table without rows, picture, caption and footnote."""
    return (
        (kind == "table") & ~F.coalesce(body, F.lit("")).rlike(TABLE_ROW) & (F.coalesce(F.length(non_ws(img_path)), F.lit(0)) == 0) & blank_all(caption) & blank_all(footnote)
    )


def extra_chars(s: Column) -> Column:
    """Offsets of characters that may be noise: lone radicals, and the second of the first pair of a doubled function word."""
    chars = F.split(F.coalesce(s, F.lit("")), "")

    def hit(c: Column, i: Column) -> Column:
        before, after = F.get(chars, i - 1), F.get(chars, i + 1)
        idiom = F.lit(False)
        for c0, tail in IDIOM_TAILS.items():
            idiom = idiom | ((c == c0) & (F.coalesce(F.get(chars, i + 2), F.lit("")) == tail[0]) & (F.coalesce(F.get(chars, i + 3), F.lit("")) == tail[1]))
        pair = c.isin(*DOUBLED) & (after == c) & (F.coalesce(before, F.lit("")) != c) & ~idiom
        return F.when(c.isin(*RADICALS), i).when(pair, i + 1)

    return F.array_compact(F.transform(chars, hit))


def may_delete(s: Column, offset: Column) -> Column:
    """Why the character at ``offset`` may go ('radical', 'dup_char'), or null."""
    chars = F.split(F.coalesce(s, F.lit("")), "")
    c, before, after = F.get(chars, offset), F.get(chars, offset - 1), F.get(chars, offset + 1)
    start = F.when(before == c, offset - 1).otherwise(offset)
    idiom = F.lit(False)
    for c0, tail in IDIOM_TAILS.items():
        idiom = idiom | ((c == c0) & (F.coalesce(F.get(chars, start + 2), F.lit("")) == tail[0]) & (F.coalesce(F.get(chars, start + 3), F.lit("")) == tail[1]))
    doubled = F.coalesce(before == c, F.lit(False)) | F.coalesce(after == c, F.lit(False))
    return F.when((offset >= 0) & c.isin(*RADICALS), F.lit("radical")).when((offset >= 0) & c.isin(*DOUBLED) & doubled & ~idiom, F.lit("dup_char"))


def js_number(x: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def valid_bbox(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & F.forall(b, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def union_bbox(a: Column, b: Column) -> Column:
    """The box around two boxes if both are valid, else the first."""
    return F.when(
        valid_bbox(a) & valid_bbox(b),
        F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])),
    ).otherwise(a)
