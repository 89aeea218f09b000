"""URL filters: host and path rules, and their spread over redirect and canonical-link aliases.

A page and what it redirects to or names as canonical are one resource. Connected components over those edges carry a
block to every alias that no rule judges; a rule's own verdict always holds, and an explicit allow anywhere in the
component outweighs its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, cut, shuffled, table
from tidemark.llm.components import components

#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
CANONICAL = r"""(?i)<link\s[^>]*?rel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\s[^>]*?http-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def first_rule(of_host: Column, of_path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Of equal ones the first listed wins."""
    name = word = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        top, _, start = rule.partition("/")
        fits = ((of_host == top) | of_host.endswith("." + top)) & of_path.startswith("/" + start)
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        word = F.when(fits, F.lit(verdict)) if word is None else word.when(fits, F.lit(verdict))
    return name if name is not None else F.lit(None).cast("string"), word if word is not None else F.lit(None).cast("string")


def _node(url: Column) -> Column:
    """The URL without its fragment, which no server sees."""
    return F.regexp_replace(url, r"#[\s\S]*$", "")


#: Links that name nothing on the web: another scheme, as of mail or scripts.
OTHER_SCHEME = r"^[a-zA-Z][-+.a-zA-Z0-9]*:"


def _relative(base: Column, link: Column) -> Column:
    """A link that goes from the base's folder, without its . and .. segments."""
    site, folder = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0), F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*((?:/[^/?#]*)*)/", 1)
    to, query = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"\?[\s\S]*$", 0)
    parts = F.split(F.concat(F.substring(folder, 2, 1 << 30), F.when(folder != "", "/").otherwise(""), to), "/")
    up = lambda at, x: F.when(x == "..", F.regexp_replace(at, r"/[^/]*$", "")).when(x == ".", at).otherwise(F.concat(at, F.lit("/"), x))
    path_ = F.aggregate(parts, F.lit(""), up)
    return F.concat(site, path_, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""), query)


def _resolved(base: Column, link: Column) -> Column:
    """The URL that a link of a page names: absolute, or relative to the page's scheme, host, folder or path."""
    scheme, site = F.regexp_extract(base, r"^([^:/?#]+:)//", 1), F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    return (
        F.when(link.rlike(r"^[^/?#]*://"), link)
        .when((scheme == "") | link.rlike(OTHER_SCHEME), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link))
        .when(link.startswith("#"), base)
        .otherwise(_relative(base, link))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): each page and what its canonical links and its refreshes name."""
    links = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda x: F.regexp_extract(x, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda x: F.regexp_extract(x, TARGET, 1)),
    )
    found = pages.select(F.col(url).alias("url"), F.explode(links).alias("link")).where("link <> ''")
    return found.select(_node(F.col("url")).alias("a"), _node(_resolved(F.col("url"), F.replace("link", F.lit("&amp;"), F.lit("&")))).alias("b")).where("a <> b")


def alias_verdicts(edges: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(node, spread): the verdict of a component for its unjudged members; components without one have no rows."""
    members = cut(components(edges))
    judged = members.withColumn("own", first_rule(host(F.col("node")), path(F.col("node")), rules)[1])
    tops = judged.groupBy("component").agg(F.min("own").alias("spread")).where("spread is not null")  # allow < block
    return members.join(shuffled(cut(tops)), "component").select("node", "spread")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; edges (a, b) between URLs add to those in the html.

    A null URL or one without :// has an empty host and path and no rule. Without a rule the verdict is that of the
    page's component, else allow. Repeated rows stay repeated; an empty table gives an empty result.
    """
    found = alias_edges(pages)
    if edges is not None:
        found = found.union(edges.select(_node(F.col("a")), _node(F.col("b"))))
    spread = cut(alias_verdicts(found, rules))
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), _node(F.col("url")).alias("node"))
    rule, own = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "own": own}).join(spread, "node", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    A null URL or one without :// has an empty host and path, no rule, and is allowed. Null html names no alias. Of
    rules of one length the first listed wins. Repeated rows stay repeated; rows with a null id are judged like any
    other; an empty table gives an empty result; other columns are not read.
    """
    return judge(table(spark, sf_dir, "pages"))


def _sql_parts(url: str) -> tuple[str, str]:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END"
    upper_lower = f"'{UPPER}', '{LOWER}'"
    return f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), {upper_lower}), '')", f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"


def _sql_case(result: int) -> str:
    out = ""
    for pair in sorted(RULES, key=lambda r: -len(r[1])):
        top, _, start = pair[1].partition("/")
        out += f" WHEN (host = '{top}' OR ends_with(host, '.{top}')) AND starts_with(path, '/{start}') THEN '{pair[result]}'"
    return f"CASE{out} END"


def _sql_pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: Aliases by a recursive union over both directions of the edges.
SQL = f"""
WITH RECURSIVE links AS (
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, {_sql_pattern(CANONICAL)}, 0)), {_sql_pattern(HREF)}, 1) AS link FROM pages
  UNION ALL
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, {_sql_pattern(REFRESH)}, 0)), {_sql_pattern(TARGET)}, 1) FROM pages
), parts AS (
  SELECT url, l, site, string_split(substr(folder, 2) || CASE WHEN folder <> '' THEN '/' ELSE '' END || regexp_extract(l, '^[^?#]*', 0), '/') AS p
  FROM (SELECT url, replace(link, '&amp;', '&') AS l, regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0) AS site, regexp_extract(url, '^[^:/?#]+://[^/?#]*((?:/[^/?#]*)*)/', 1) AS folder FROM links WHERE link <> '')
), resolved AS (
  SELECT regexp_replace(url, '#[\\s\\S]*$', '') AS a, regexp_replace(CASE
    WHEN regexp_matches(l, '^[^/?#]*://') THEN l
    WHEN site = '' OR regexp_matches(l, '{OTHER_SCHEME}') THEN NULL
    WHEN starts_with(l, '//') THEN regexp_extract(url, '^([^:/?#]+:)//', 1) || l
    WHEN starts_with(l, '/') THEN site || l
    WHEN starts_with(l, '?') THEN regexp_extract(url, '^[^?#]*', 0) || l
    WHEN starts_with(l, '#') THEN url
    ELSE site || list_reduce(p, lambda acc, x: CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END, '')
      || CASE WHEN p[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract(l, '\\?[\\s\\S]*$', 0)
    END, '#[\\s\\S]*$', '') AS b
  FROM parts
), edges AS (
  SELECT a, b FROM resolved WHERE a <> b UNION SELECT b, a FROM resolved WHERE a <> b
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), spread AS (
  SELECT a AS node, min({_sql_case(0)}) AS spread FROM (SELECT a, {_sql_parts("b")[0]} AS host, {_sql_parts("b")[1]} AS path FROM reach) GROUP BY a
), judged AS (
  SELECT page_id, host, path, node, {_sql_case(1)} AS rule, {_sql_case(0)} AS own
  FROM (SELECT page_id, {_sql_parts("url")[0]} AS host, {_sql_parts("url")[1]} AS path, regexp_replace(url, '#[\\s\\S]*$', '') AS node FROM pages)
)
SELECT page_id, host, path, rule, coalesce(own, spread, 'allow') AS verdict FROM judged LEFT JOIN spread USING (node)
"""
