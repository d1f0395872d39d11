"""SQL fragments shared by several oracles. Written apart from the Spark operators."""

from __future__ import annotations

from passageworks.functions.text import SPACES

SP = "'" + SPACES + "'"


def trim(x: str) -> str:
    return f"trim({x}, {SP})"


# Documents with headings, fences, tables, images and header lines, which the given texts lack.
MARKED = """
marked AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, n: CASE
    WHEN n = 1 THEN '# ' || x
    WHEN n % 23 = 10 THEN ''
    WHEN n % 11 = 7 OR n % 11 = 9 THEN '```'
    WHEN n % 11 = 8 THEN '# in fence ' || x
    WHEN n % 11 = 4 THEN '## ' || left(x, 40)
    WHEN n % 19 = 3 THEN '### ' || left(x, 30)
    WHEN n % 13 = 5 OR n % 13 = 6 THEN '| ' || left(x, 20) || ' | ' || length(x) || ' |'
    WHEN n % 17 = 6 THEN '![' || left(x, 12) || '](https://img.example.com/' || (n % 5) || '.png)'
    WHEN n % 29 = 11 THEN '来源：' || left(x, 10)
    ELSE x END), chr(10)) AS text
  FROM documents)"""


def lines(src: str, name: str = "lines") -> str:
    return f"""
{name}0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
          unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM {src}),
{name} AS (SELECT *, coalesce(sum(CASE WHEN starts_with({trim('content')}, '```') THEN 1 ELSE 0 END)
          OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS outside
          FROM {name}0)"""


def sections(src: str = "lines", name: str = "sec") -> str:
    return f"""
{name}_h AS (SELECT *, outside AND starts_with(content, '#') AND contains(content, ' ') AS head FROM {src}),
{name}_n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line) AS section_no FROM {name}_h),
{name}_g AS (SELECT doc_id, section_no::BIGINT AS section_no,
    max(CASE WHEN head THEN {trim("ltrim(content, '#')")} END) AS h,
    min(line) + max(head::INT) AS start_line,
    {trim("coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT head), '')")} AS body
    FROM {name}_n GROUP BY ALL),
{name} AS (SELECT doc_id, section_no, coalesce(h, '正文') AS section, start_line::BIGINT AS start_line, body
    FROM {name}_g WHERE body <> '')"""


def pack(src: str, name: str, limit: int, keys: str = "doc_id, section_no, section", cut_long: bool = True) -> str:
    """Greedy packing as folds over lists: per long line over its characters, per text over its lines."""
    cuts = f"""CASE WHEN {'strlen(t) <= ' + str(limit) if cut_long else 'true'} THEN [0::BIGINT] ELSE list_reduce(
      list_transform(string_split(t, ''), lambda c: strlen(c)::BIGINT),
      lambda a, x: CASE WHEN a.b + x > {limit} THEN {{'b': x, 'k': a.k + 1, 'cuts': list_append(a.cuts, a.k)}}
                   ELSE {{'b': a.b + x, 'k': a.k + 1, 'cuts': a.cuts}} END,
      {{'b': 0::BIGINT, 'k': 0::BIGINT, 'cuts': [0::BIGINT]}}).cuts END"""
    return f"""
{name}_l AS (SELECT {keys}, start_line, body, unnest(string_split(body, chr(10))) AS t,
     unnest(range(0, len(string_split(body, chr(10))))) AS i FROM {src}),
{name}_c AS (SELECT *, {cuts} AS cuts FROM {name}_l),
{name}_p AS (SELECT {keys}, start_line, i, unnest(list_transform(cuts, lambda c, j: substring(t, (c + 1)::BIGINT,
     coalesce(cuts[j + 1], length(t)) - c))) AS t, unnest(range(1, len(cuts) + 1)) AS j, len(cuts) AS pieces FROM {name}_c),
{name}_i AS (SELECT *, row_number() OVER (PARTITION BY {keys}, start_line ORDER BY i, j) - 1 AS k, j < pieces AS hard FROM {name}_p),
{name}_f AS (SELECT {keys}, start_line, list_reduce(list({{'b': strlen(t)::BIGINT, 'hard': hard}} ORDER BY k),
      lambda a, x: CASE
        WHEN x.hard THEN {{'n': 0::BIGINT, 'b': 0::BIGINT, 'k': a.k + 1, 'cuts': list_append(
             CASE WHEN a.n > 0 THEN list_append(a.cuts, a.k) ELSE a.cuts END, a.k + 1)}}
        WHEN a.n > 0 AND a.b + x.b + 1 > {limit} THEN {{'n': 1::BIGINT, 'b': x.b, 'k': a.k + 1, 'cuts': list_append(a.cuts, a.k)}}
        WHEN a.n = 0 THEN {{'n': 1::BIGINT, 'b': x.b, 'k': a.k + 1, 'cuts': a.cuts}}
        ELSE {{'n': a.n + 1, 'b': a.b + x.b + 1, 'k': a.k + 1, 'cuts': a.cuts}} END,
      {{'n': 0::BIGINT, 'b': 0::BIGINT, 'k': 0::BIGINT, 'cuts': [0::BIGINT]}}).cuts AS cuts
     FROM {name}_i GROUP BY ALL),
{name}_a AS (SELECT i.*, len(list_filter(list_distinct(f.cuts), lambda c: c <= i.k)) AS chunk
     FROM {name}_i i JOIN {name}_f f USING ({keys}, start_line)),
{name}_g AS (SELECT {keys}, chunk, min(start_line + i)::BIGINT AS start_line, max(start_line + i)::BIGINT AS end_line,
     {trim('string_agg(t, chr(10) ORDER BY k)')} AS content FROM {name}_a GROUP BY {keys}, start_line, chunk),
{name} AS (SELECT {keys}, start_line, end_line, content,
     row_number() OVER (PARTITION BY {keys} ORDER BY start_line, chunk) AS part,
     count(*) OVER (PARTITION BY {keys}) AS parts FROM {name}_g WHERE content <> '')"""


def frags(src: str = "marked", limit: int = 2048) -> str:
    """Documents to fragments (sections, then packing) as CTEs ending in ``frag``."""
    return lines(src) + "," + sections() + "," + pack("sec", "pk", limit) + f""",
frag AS (SELECT doc_id, section_no, part, CASE WHEN parts > 1 THEN section || '（第' || part || '部分）' ELSE section END AS section,
     start_line, end_line, content, sha256(content) AS content_hash,
     sha256(doc_id::VARCHAR || chr(0) || start_line::VARCHAR || chr(0) || part::VARCHAR) AS fragment_id FROM pk)"""


TABLE_LINE = (f"starts_with({trim('content')}, '|') AND ends_with({trim('content')}, '|') "
              "AND length(content) - length(replace(content, '|', '')) >= 3")
IMAGE_LINE = "contains(content, '![') AND contains(content, '](')"

TERMS = """list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nd}}]+'),
   lambda r: list_prepend(r, list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))"""


def terms(x: str) -> str:
    return TERMS.format(x=x)
