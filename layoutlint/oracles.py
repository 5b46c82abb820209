"""SQL twins of the block queries, for DuckDB. Nothing else uses them."""

from __future__ import annotations

from layoutlint.functions import numbering, text as t
from layoutlint.sources.derived import DUCK_ITEMS


def q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def without(x: str, pattern: str, put: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(put)}, 'g')"


def bare(x: str) -> str:
    return without(x, f"[{t.CONTENT_SPACE}]")


def bare_len(x: str) -> str:
    return f"length({bare(x)})"


def trim(x: str) -> str:
    return without(x, rf"^{t.S}+|{t.S}+\z")


def rows_of(body: str) -> str:
    return f"regexp_extract_all(coalesce({body}, ''), {q(t.TABLE_ROW)})"


def blank_all(a: str) -> str:
    return f"(coalesce(len(list_filter({a}, lambda x: length({trim('coalesce(x, chr(32))')}) > 0)), 0) = 0)"


def furniture(x: str) -> str:
    return f"(coalesce({x}, '') in ('page_number', 'header', 'footer'))"


HUSK = (
    f"(type = 'table' and len({rows_of('table_body')}) = 0 and coalesce({bare_len('img_path')}, 0) = 0 and {blank_all('table_caption')} and {blank_all('table_footnote')})"
)
_CHINESE = "map {" + ", ".join(f"'{k}': {v}" for k, v in sorted(numbering.CHINESE.items())) + "}"


def number(x: str) -> str:
    """Path, style and end of a leading number."""
    value = lambda s: f"({_CHINESE})[{s}]"
    chapter, chinese, arabic = (f"regexp_extract({x}, {q(p)}, 1)" for p in (t.NUM_CHAPTER, t.NUM_CHINESE, t.NUM_ARABIC))
    end = lambda p: f"length(regexp_extract({x}, {q(p)}, 0))"
    chapter_value = f"coalesce(try_cast({chapter} as bigint), {value(chapter)})"
    parts = f"list_transform(string_split(replace({arabic}, '．', '.'), '.'), lambda p: try_cast(p as bigint))"
    fine = f"coalesce(list_max({parts}) <= 99, false) and {x}[{end(t.NUM_ARABIC)} + 1] not in ('%', '％')"
    pack = lambda path, style, e: "struct_pack(path := " + path + f", style := '{style}', \"end\" := {e})"
    return f"""case when {has(x, t.NUM_CHAPTER)} then case when {chapter_value} is not null then {pack(f"[{chapter_value}::bigint]", "chapter", end(t.NUM_CHAPTER))} end
      when {has(x, t.NUM_CHINESE)} then case when {value(chinese)} is not null then {pack(f"[{value(chinese)}::bigint]", "chinese", end(t.NUM_CHINESE))} end
      when {has(x, t.NUM_ARABIC)} then case when {fine} then {pack(parts, "arabic", end(t.NUM_ARABIC))} end end"""


def number_body(x: str, end: str) -> str:
    return without(f"{x}[{end} + 1:]", rf"^[、.．{t.SPACE}]+")


def surface(x: str, n: str) -> str:
    return f"({n} between 1 and {t.CANDIDATE_CHARS} and not {has(x, t.COMMA_SEMI)} and not {has(x, t.SENTENCE_END)})"


_CONTENT = f"case when not {furniture('type')} then struct_pack(ord := ord, type := type, text := text, text_level := text_level, page_idx := page_idx, husk := husk, num := num, candidate := candidate, list_items := list_items, table_body := table_body, table_caption := table_caption, table_footnote := table_footnote, bbox := bbox) end"
_BODY = number_body("text", 'num."end"')
#: Items with number, neighbours and flags, as the detectors see them.
ANNOTATED = f"""{DUCK_ITEMS},
h as (select *, coalesce({HUSK}, false) as husk, case when type = 'text' then {number('text')} end as num from items),
g as (select *, coalesce(type = 'text' and text_level is null and num is not null and {surface('text', bare_len(_BODY))}, false) as candidate from h),
f as (select *, {_CONTENT} as content from g),
n as (select *, first_value(content ignore nulls) over (partition by doc_id order by ord rows between 1 following and unbounded following) as n1,
  last_value(content ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as p1 from f),
a as materialized (select *, first_value(case when content is not null then struct_pack(x := n1) end ignore nulls) over (partition by doc_id order by ord rows between 1 following and unbounded following).x as n2 from n),
rep as materialized (select doc_id, key, count(distinct page_idx) as pages from (select doc_id, {trim('text')} as key, page_idx from a where type = 'text')
  where key <> '' and {bare_len('key')} <= {t.ARTIFACT_CHARS} group by 1, 2 having count(distinct page_idx) >= {t.ARTIFACT_PAGES}),
fur as materialized (select doc_id, key, count(*) as n from (select doc_id, {bare('text')} as key from a where {furniture('type')}) where key <> '' group by 1, 2 having count(*) >= 2),
nums as materialized (select doc_id, ord, text, text_level, candidate, num, n1, num.style as style, len(num.path) as depth, array_to_string(num.path[:len(num.path) - 1], '.') as parent, num.path[-1] as last
  from a where type = 'text' and num is not null),
caps as (select doc_id, ord, unnest(table_caption) as cap, generate_subscripts(table_caption, 1) - 1 as entry from a where type = 'table')"""


def reasons(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{name}' end" for c, name in pairs) + "], lambda x: x is not null), ',')"


def row(kind: str, source: str, *, next_ord: str = "null", value: str = "null", detail: str = "null", has_op: bool = True) -> str:
    return (
        f"select doc_id, ord, '{kind}' as kind, {str(has_op).lower()} as has_op, ({next_ord})::bigint as next_ord, ({value})::bigint as value, ({detail})::varchar as detail from {source}"
    )


_LEFT = f"list_reduce(list_prepend({bare('text')}, coalesce(furniture, []::varchar[])), lambda s, f: replace(s, f, ''))"
_IDIOM = " or ".join(f"(c = '{c}' and cs[i + 2:i + 3] = ['{tail[0]}', '{tail[1]}'])" for c, tail in t.IDIOM_TAILS.items())
_CHILD = "(n1.num.style = style and len(n1.num.path) > len(num.path) and n1.num.path[:len(num.path)] = num.path)"

SUSPECTS = {
    "pseudo_heading": row(
        "pseudo_heading",
        f"(select *, {reasons((has('text', t.COMMA_SEMI), 'comma'), (has('text', t.SENTENCE_END), 'sentence_end'), (bare_len(without('text', t.LEADING_NUMBERING)) + f' > {t.HEADING_BODY_CHARS}', 'long'))} as why from a where type = 'text' and text_level is not null and text <> '') where why <> ''",
        detail="why",
    ),
    "cross_page_break": row(
        "cross_page_break",
        f"a where type = 'text' and text_level is null and text <> '' and n1.type = 'text' and n1.text_level is null and n1.text <> '' and n1.page_idx = page_idx + 1 and not {has('text', t.SENTENCE_END)} and not {has('n1.text', t.HEADING_START)} and not {has('text', t.BULLET_START)} and not {has('n1.text', t.BULLET_START)}",
        next_ord="n1.ord",
    ),
    "giant_block": row(
        "giant_block",
        f"(select *, len(regexp_extract_all(text, {q(t.GIANT_HEADING_HIT)})) as hits from a where type = 'text' and {bare_len('text')} > {t.GIANT_CHARS}) where hits >= 2",
        value="hits",
    ),
    "page_artifact": row(
        "page_artifact",
        f"""(select *, case when {bare('text')} <> '' and {bare_len('text')} <= {t.LEAK_CHARS} and {_LEFT} = '' then 'furniture' when pages is not null then 'repeated'
  when text_level is null and key <> '' and {bare_len('text')} <= 10 and {has('key', t.PAGE_NUMBER)} then 'page_number' end as why
  from (select doc_id, ord, text, text_level, {trim('text')} as key from a where type = 'text') x
  left join (select doc_id, list(key order by -length(key), key) as furniture from fur group by doc_id) using (doc_id) left join rep using (doc_id, key)) where why is not null""",
        value="case when why = 'repeated' then pages end", detail="why",
    ),
    "residual_markup": row(
        "residual_markup",
        f"(select *, {reasons((has('text', t.MD_LINK), 'md_link'), (has('text', t.LATEX), 'latex'), ('not ' + has('text', t.LATEX) + ' and ' + has('text', t.ESCAPED_DOLLAR), 'escaped_dollar'), (has('text', t.HTML_TAG), 'html_tag'))} as why from a where type = 'text' and text <> '') where why <> ''",
        detail="why",
    ),
    "missed_heading": row(
        "missed_heading",
        f"""(select *, case when b.text_level is not null and b.last + 1 = last then b when e.text_level is not null and e.last - 1 = last then e end as sib, coalesce({_CHILD}, false) as child
  from (select *, lag(struct_pack(ord := ord, last := last, text_level := text_level)) over w as b, lead(struct_pack(ord := ord, last := last, text_level := text_level)) over w as e
    from nums window w as (partition by doc_id, style, depth, parent order by ord)) where candidate) where sib is not null or child""",
        next_ord="coalesce(sib.ord, n1.ord)", value="sib.text_level", detail="case when sib is not null then 'sibling' else 'child' end",
    ),
    "extra_char": row(
        "extra_char",
        f"""(select *, list_filter(list_transform(range(1, len(cs) + 1), lambda i: case when contains('{t.RADICALS}', cs[i]) then i - 1
    when contains('{t.DOUBLED}', cs[i]) and cs[i + 1] = cs[i] and (i = 1 or cs[i - 1] <> cs[i]) and not coalesce({_IDIOM.replace("(c = ", "(cs[i] = ")}, false) then i end), lambda x: x is not null) as ats
  from (select doc_id, ord, string_split(text, '') as cs from a where type = 'text' and text <> '')) where len(ats) > 0""",
        value="ats[1]", detail="array_to_string(ats, ',')",
    ),
    "trailing_marker": row(
        "trailing_marker",
        f"(select *, length(text) - length(regexp_extract(text, {q(t.TRAILING_MARKER)}, 0)) as at_ from a where type = 'text' and text_level is null and {has('text', t.TRAILING_MARKER)}) where {bare_len('text[:at_]')} >= {t.MARKER_HEAD_CHARS}",
        value="at_",
    ),
    "caption_heading": row(
        "caption_heading",
        f"""(select e.*, heads.ord as at_, heads.text_level, row_number() over (partition by e.doc_id, e.ord order by e.entry, heads.ord) as rn
  from (select *, num.style as style, len(num.path) as depth, array_to_string(num.path[:len(num.path) - 1], '.') as parent, num.path[-1] as last from (select *, {number('cap')} as num from caps where cap is not null)
    where num is not null and {surface('cap', bare_len(number_body('cap', 'num."end"')))}) e
  join nums heads on heads.text_level is not null and e.doc_id = heads.doc_id and e.style = heads.style and e.depth = heads.depth and e.parent = heads.parent and abs(e.last - heads.last) = 1) where rn = 1""",
        next_ord="at_", value="entry", detail="text_level",
    ),
    "caption_artifact": row(
        "caption_artifact",
        f"""(select c.*, fur.n, rep.pages, row_number() over (partition by c.doc_id, c.ord order by c.entry) as rn from (select *, {bare('cap')} as b, {trim('cap')} as k from caps where cap is not null) c
  left join fur on c.doc_id = fur.doc_id and c.b = fur.key left join rep on c.doc_id = rep.doc_id and c.k = rep.key where c.b <> '' and (fur.n is not null or rep.pages is not null)) where rn = 1""",
        value="entry", detail="case when n is not null then 'furniture' else 'repeated' end",
    ),
    "separated_caption": row(
        "separated_caption",
        rf"a where type = 'text' and text_level is null and {bare_len('text')} between 2 and 30 and not {has('text', t.SENTENCE_END)} and {has(trim('text'), r'[表图]\z')} and n1.type = 'text' and (n1.text_level is not null or n1.candidate) and n2.type = 'table' and not n2.husk",
        next_ord="n1.ord", value="n2.ord",
    ),
    "empty_table": row("empty_table", "a where husk", next_ord="p1.ord", detail="p1.type"),
    "split_table": row(
        "split_table", "a where type = 'table' and not husk and n1.type = 'table' and n1.page_idx > page_idx and not n1.husk", next_ord="n1.ord",
        value=f"coalesce(len(regexp_extract_all({rows_of('table_body')}[1], {q(t.TABLE_CELL)})), 0)",
    ),
    "split_list": row("split_list", "a where type = 'list' and n1.type = 'list' and n1.page_idx > page_idx", next_ord="n1.ord"),
    "caption_issue": row("caption_issue", f"a where type in ('table', 'image') and {blank_all('case when type = ' + chr(39) + 'table' + chr(39) + ' then table_caption else image_caption end')}", has_op=False),
}
ALL_SUSPECTS = " union all ".join(f"({s})" for s in SUSPECTS.values())


def with_items(select: str) -> str:
    return f"with {ANNOTATED}\n{select}"
