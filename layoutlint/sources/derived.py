"""Content lists derived from the standard tables, by SQL that differs between engines in a few functions only.

Documents ``D…`` have a page for each text of a source and a block for each line; ``O…`` have numbered sections with a
table for each order; ``C…`` are a few fixed Chinese lines. All have running headers and page numbers, and known irregularities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {
    "lines": "lateral view posexplode(split(text, '\\n', -1)) x as pos, line",
    "rows": "array_join(transform(array_sort(collect_list(struct(l_linenumber as k, l_extendedprice as e, html))), r -> r.html), '')",
    "names": "transform(array_sort(collect_list(struct(l_linenumber as k, l_extendedprice as e, 'Item ' || cast(l_partkey as string) || ' of lot ' || cast(l_linenumber as string) as html))), r -> r.html)",
    "money": "cast(cast(l_extendedprice as decimal(18,2)) as string)",
    "arr": "array",
    "arr_end": "",
    "none": "cast(null as array<string>)",
    "box": "array(cast(50 as double), cast({0} as double), cast(550 as double), cast({0} + 20 as double))",
    "nl": "chr(10)",
}
_DUCK = _SPARK | {
    "lines": ", lateral (select unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line) x",
    "rows": "string_agg(html, '' order by l_linenumber, l_extendedprice, html)",
    "names": "list('Item ' || cast(l_partkey as string) || ' of lot ' || cast(l_linenumber as string) order by l_linenumber, l_extendedprice, html)",
    "none": "cast(null as varchar[])",
    "box": "[cast(50 as double), cast({0} as double), cast(550 as double), cast({0} + 20 as double)]",
}
#: Fixed lines in Chinese; | parts the document, the page, the type and the text.
CHINESE_LINES = """C1|0|header|质量管理手册
C1|0|text|第一章 总则
C1|0|text|本手册规定了质量管理的的基本要求，适用于全部部门
C1|0|text|并且由各部门的负责人是是组织实施
C1|1|header|质量管理手册
C1|1|text|继续说明上一页没有写完的内容。[相关文件]
C1|1|text|二、术语
C1|1|text|地地道道的做法，的的确确有效
C1|2|header|质量管理手册
C1|2|text|三、部门职责
C1|2|text|3）亻部件不应单独出现
C1|2|text|质量管理手册
C1|2|text|产品检验记录表
C1|2|text|四、检验
C1|2|table|<table><tr><td>甲</td><td>乙</td></tr></table>
C1|3|text|各部门应当按照规定保存全部记录【相关记录】
C2|0|text|1.1 范围
C2|0|text|1.2 引用文件
C2|1|text|第2页
C2|1|text|未来的目标是提高效率和降低成本"""


def items_sql(duck: bool) -> str:
    """The query for all columns of a content list, over documents, orders, customer and lineitem."""
    d = _DUCK if duck else _SPARK
    s = lambda x: f"cast({x} as string)"
    arr = (lambda *x: f"[{', '.join(x)}]") if duck else (lambda *x: f"array({', '.join(x)})")
    empty_row = "'<tr><td></td><td> </td></tr>'"
    chinese = ", ".join("(" + ", ".join([f"'{p[0]}'", p[1], str(k), f"'{p[2]}'", f"'{p[3]}'"]) + ")" for k, p in enumerate(line.split("|") for line in CHINESE_LINES.split("\n")))
    cols = "type, text, text_level, list_items, table_body, table_caption, table_footnote, image_caption, img_path"
    blank = {c: "cast(null as string)" for c in ("text", "table_body", "img_path")} | {"text_level": "cast(null as int)"}
    blank |= {c: d["none"] for c in ("list_items", "table_caption", "table_footnote", "image_caption")}

    def block(kind: str, **values: str) -> str:
        return ", ".join([f"'{kind}' as type", *[f"{values.get(c, blank[c])} as {c}" for c in cols.split(", ")[1:]]])

    return f"""
with pages as (
  select source, text, row_number() over (partition by source order by doc_id) - 1 as page from documents
), lines as (
  select source, page, pos, line, (page * 7 + pos) % 23 as m from pages {d["lines"]}
), secs as (
  select 'O' || {s("c_nationkey")} as doc, o_orderkey as okey, o_orderpriority as prio,
    row_number() over (partition by c_nationkey order by o_orderkey) - 1 as seq
  from orders join customer on o_custkey = c_custkey
), cells as (
  select l_orderkey, l_partkey, l_linenumber, l_extendedprice,
    '<tr><td>' || {s("l_partkey")} || '</td><td>' || case l_linenumber % 4 when 1 then '  ' || {d["money"]} || ' ' when 2 then 'http://a.example/x. y/' || {d["money"]}
      when 3 then '\\\\$ ' || {d["money"]} else '$\\\\alpha' || {s("l_linenumber")} || '$  up' end || '</td></tr>' as html
  from lineitem
), bodies as (
  select l_orderkey, {d["rows"]} as html, {d["names"]} as names from cells group by l_orderkey
), tabs as (
  select doc, seq, okey, prio, coalesce(html, '') as html, names, (seq / 9) as x from secs left join bodies on okey = l_orderkey
), numbered as (
  select doc, seq, okey, prio, html, names, cast(floor(seq / 9) as bigint) % 90 + 1 as chap, seq % 9 + 1 as sec from tabs
), blocks as (
  select 'D' || source as doc_id, page as page_idx, 0 as k, 0 as pos, {block("header", text="'Report of ' || source")} from pages
  union all
  select 'D' || source, page, 1, pos, {block("text", text="case m when 3 then '<b>' || line || '</b>' when 5 then '[' || line || '](http://x.example)' when 7 then '\\\\$' || line when 9 then '- ' || line when 11 then substring(line, 1, length(line) - 1) else line end", text_level="case when pos = 0 and page % 4 = 0 then 1 end")} from lines
  union all
  select 'D' || source, page, 2, 0, {block("text", text="'Report  of ' || source")} from pages where page % 7 = 3
  union all
  select 'D' || source, page, 2, 1, {block("text", text="'- ' || " + s("page") + " || ' -'")} from pages where page % 5 = 2
  union all
  select 'D' || source, page, 2, 2, {block("image", img_path="'img/' || " + s("page") + " || '.jpg'", image_caption=f"case when page % 2 = 0 then {arr(chr(39) + 'A picture' + chr(39))} end")} from pages where page % 9 = 4
  union all
  select 'D' || source, page, 2, 3, {block("text", text="'1. ' || replace(text, chr(10), chr(10) || '2.1 ')")} from pages where page % 10 = 1
  union all
  select 'D' || source, page, 3, 0, {block("page_number", text=s("page"))} from pages
  union all
  select doc, seq, 0, 0, {block("header", text="'Orders of nation'")} from numbered
  union all
  select doc, seq, 1, 0, {block("text", text=s("chap") + " || '.' || " + s("sec") + " || ' Order block'", text_level="case when seq % 3 <> 1 then 2 end")} from numbered where seq % 8 not in (3, 6)
  union all
  select doc, seq, 1, 1, {block("text", text=s("chap") + " || '.' || " + s("sec") + " || '.1 Detail of it'")} from numbered where seq % 5 = 1
  union all
  select doc, seq, 1, 2, {block("list", list_items="names")} from numbered where seq % 8 = 6
  union all
  select doc, seq, 2, 0, {block("table", table_body="case when seq % 10 = 9 then cast(null as string) else '<table>' || html || case when seq % 6 = 0 then " + empty_row + " else '' end || '</table>' end", table_caption=f"case seq % 7 when 1 then {arr(chr(39) + 'Lines of order ' + chr(39) + ' || ' + s('okey'))} when 2 then {arr(chr(39) + 'Orders of nation' + chr(39), chr(39) + 'Lines' + chr(39))} when 3 then {arr(chr(39) + 'Note' + chr(39), s('chap') + ' || ' + chr(39) + '.' + chr(39) + ' || ' + s('sec + 1') + ' || ' + chr(39) + ' Next block' + chr(39))} when 4 then {arr(chr(39) + ' ' + chr(39))} end", table_footnote=f"case when seq % 11 = 1 then {arr('prio')} end", img_path="case when seq % 10 = 9 then '' else 'img/' || " + s("okey") + " || '.jpg' end")} from numbered where seq % 8 <> 6
  union all
  select doc, seq, 3, 0, {block("list", list_items="names")} from numbered where seq % 8 = 5
  union all
  select doc, seq, 4, 0, {block("page_number", text=s("seq + 1"))} from numbered
  union all
  select c.doc, c.page, 1, c.k, c.type, case when c.type <> 'table' then c.text end, {blank["text_level"]}, {d["none"]}, case when c.type = 'table' then c.text end, {d["none"]}, {d["none"]}, {d["none"]}, {blank["text"]} from (values {chinese}) as c(doc, page, k, type, text)
)
select doc_id, cast(row_number() over (partition by doc_id order by page_idx, k, pos) - 1 as bigint) as ord, cast(page_idx as bigint) as page_idx,
  {d["box"].format("100 * k + pos")} as bbox, {cols}
from blocks
""".replace("\\\\", "\\" if duck else "\\\\")


#: For SQL twins: ``items`` as a common table expression of DuckDB.
DUCK_ITEMS = "items as materialized (select * from (" + items_sql(True) + "))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived content lists of a folder of tables, repartitioned by document only where an operator asks for it."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = items_sql(False)
    for name in ("documents", "orders", "customer", "lineitem"):
        sql = sql.replace(f"from {name} ", f"from {{{name}}} ").replace(f"from {name}\n", f"from {{{name}}}\n").replace(f"join {name} ", f"join {{{name}}} ")
    rows = spark.sql(sql, **{n: read(n) for n in ("documents", "orders", "customer", "lineitem")})
    return rows.withColumn("image_footnote", F.lit(None).cast("array<string>"))
