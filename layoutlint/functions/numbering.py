"""Leading section numbers of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from layoutlint.functions import text as t

_ONES = "一二三四五六七八九"


def _chinese_numbers() -> dict[str, int]:
    """The numerals for 1 to 99."""
    out = {}
    for tens in range(10):
        for ones in range(10):
            head = "" if tens == 0 else "十" if tens == 1 else _ONES[tens - 1] + "十"
            out[head + (_ONES[ones - 1] if ones else "")] = 10 * tens + ones
            if tens == 1:
                out["一十" + (_ONES[ones - 1] if ones else "")] = 10 + ones
    out.pop("")
    return out


CHINESE = _chinese_numbers()


def chinese_value(s: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(CHINESE.items()) for x in pair])[s].cast("long")


def parse(s: Column) -> Column:
    """``path``, ``style`` and ``end`` (code points up to the number's end), or null.

    Chapters come first, then Chinese numbers, then Arabic ones of parts up to 99 that no percent sign follows. A form that matches
    but has no value ends the search.
    """
    chapter, chinese, arabic = (F.regexp_extract(s, p, 1) for p in (t.NUM_CHAPTER, t.NUM_CHINESE, t.NUM_ARABIC))
    length = lambda p: F.length(F.regexp_extract(s, p, 0))
    number = lambda path, style, end: F.struct(path.alias("path"), F.lit(style).alias("style"), end.cast("int").alias("end"))
    chapter_value = F.coalesce(F.when(chapter.rlike(r"^[0-9]{1,18}\z"), chapter.try_cast("long")), chinese_value(chapter))
    parts = F.transform(F.split(F.regexp_replace(arabic, "．", "."), r"\."), lambda x: F.when(F.length(F.ltrim(x, F.lit("0"))) <= 2, x.try_cast("long")))
    arabic_end = length(t.NUM_ARABIC)
    fine = F.forall(parts, lambda x: x.isNotNull()) & ~F.substring(s, arabic_end + 1, F.lit(1)).isin("%", "％")
    return (
        F.when(s.rlike(t.NUM_CHAPTER), F.when(chapter_value.isNotNull(), number(F.array(chapter_value), "chapter", length(t.NUM_CHAPTER))))
        .when(s.rlike(t.NUM_CHINESE), F.when(chinese_value(chinese).isNotNull(), number(F.array(chinese_value(chinese)), "chinese", length(t.NUM_CHINESE))))
        .when(s.rlike(t.NUM_ARABIC), F.when(fine, number(parts, "arabic", arabic_end)))
    )


def body(s: Column, end: Column) -> Column:
    """The text after the number and the separators that follow it."""
    return F.regexp_replace(F.substring(s, end + 1, F.length(s)), rf"^[、.．{t.SPACE}]+", "")


def is_candidate(kind: Column, s: Column, level: Column, number: Column) -> Column:
    """A plain numbered text that looks like a heading: 1 to 30 characters behind the number, no comma, no sentence end."""
    n = t.non_ws_len(body(s, number["end"]))
    return F.coalesce((kind == "text") & level.isNull() & number.isNotNull() & surface(s, n), F.lit(False))


def surface(s: Column, n: Column) -> Column:
    return n.between(1, t.CANDIDATE_CHARS) & ~s.rlike(t.COMMA_SEMI) & ~t.sentence_end(s)
