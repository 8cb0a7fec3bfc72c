"""URL rules, and block decisions that follow redirects and canonical links to all aliases of a URL.

Pages say where they redirect to (``http-equiv=refresh``) and which URL is theirs
(``rel=canonical``). URLs connected by such links are aliases of one resource: if a rule blocks one
of them, those without a rule are blocked too. A rule that allows a URL wins over its aliases.

Components are found by distributed contraction; rules are a table joined by host. A hot host, URL
or component is split by salted joins, so no key has to fit a task.
"""

from __future__ import annotations

import html as entities
import re
import string
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import arrow_rows, components
from stratafold.session import literal_rows, pin

ALLOW, BLOCK = "allow", "block"
#: Rules as (verdict, host/path).
RULES = (
    (ALLOW, "org/"),
    (BLOCK, "example.org/es/"),
    (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"),
    (BLOCK, "com/de/"),
)
#: Tasks that share the rows of one host, URL or component.
SALTS = 16

_PARTS = r"^([^/?#]*)([^?#]*)(\?[^#]*)?"
_OPEN = re.compile(rb"<(?:(!--)|(script|style|title|textarea)\b|(link|meta|base)(?=[\s/>]))")
_STOP = re.compile(rb"[>\"']")
_ATTRIBUTE = re.compile(
    r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.ASCII
)
_REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", re.I | re.ASCII)


# -- what a page declares -----------------------------------------------------------------------


def _tags(page: bytes):
    """Attributes of the link, meta and base tags of a page, outside comments and scripts.

    One pass forward; a tag or comment that never ends ends the search.
    """
    low = page.lower()
    at = 0
    while found := _OPEN.search(low, at):
        comment, opaque, name = found.groups()
        if comment or opaque:
            closing = b"-->" if comment else b"</" + opaque
            at = low.find(closing, found.end())
            if at < 0:
                return
            continue
        at = found.end()
        while (stop := _STOP.search(low, at)) and stop[0] != b">":
            quote = low.find(stop[0], stop.end())
            at = stop.end() if quote < 0 else quote + 1
        if stop is None:
            return
        text = page[found.end() : stop.start()].decode("utf-8", "replace")
        values = {}
        for key, *value in _ATTRIBUTE.findall(text):
            values.setdefault(key.lower(), entities.unescape("".join(value)).strip())
        yield name, values
        at = stop.end()


def declared(url: str | None, page: bytes | None) -> list[str]:
    """The URLs that a page redirects to or names as canonical, resolved against its own.

    What can't be resolved to a URL with ``://`` is left out.
    """
    base, targets = url or "", []
    for name, values in _tags(page or b""):
        target = None
        if name == b"base" and "href" in values and base == (url or ""):
            base = _resolved(base, values["href"]) or base
        elif name == b"link" and "canonical" in values.get("rel", "").lower().split():
            target = values.get("href")
        elif name == b"meta" and values.get("http-equiv", "").lower() == "refresh":
            found = _REFRESH.match(values.get("content", ""))
            target = found and found[1].strip()
        if target and (target := _resolved(base, target)):
            targets.append(target)
    return targets


def _resolved(base: str, target: str) -> str | None:
    try:
        whole = urljoin(base, target.strip())
    except ValueError:  # brackets that are no address
        return None
    return whole if "://" in whole else None


# -- urls and rules -----------------------------------------------------------------------------


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one or for null."""
    rest = F.regexp_extract(_after_scheme(url), _PARTS, 1)
    return F.coalesce(_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), _PARTS, 2), F.lit(""))


def resource_of(url: Column) -> Column:
    """A digest of host, path and query: the same for all spellings of scheme and fragment, null
    without a host. No path is the path ``/``."""
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    query = F.regexp_extract(_after_scheme(url), _PARTS, 3)
    whole = F.md5(F.concat(host_of(url), path, F.coalesce(query, F.lit(""))))
    return F.when(host_of(url) != "", whole)


def rule_table(spark, rules=RULES) -> DataFrame:
    return literal_rows(spark, [tuple(r) for r in rules], _rule_schema())


def _rule_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL("verdict string, rule string")


def spread_left(left: DataFrame, right: DataFrame, on: str, by: Column) -> DataFrame:
    """Left join where the rows of one key go to SALTS tasks; ``right`` has a row per key."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(right.withColumn("_salt", salts), [on, "_salt"], "left").drop("_salt")


def _rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host the rules of its own name and of its parents; hosts without one are left out."""
    given = rules.where(F.col("verdict").isin(ALLOW, BLOCK) & F.col("rule").isNotNull())
    given = given.select(
        _lower(F.substring_index("rule", "/", 1)).alias("_suffix"),
        F.struct(
            F.length("rule").alias("length"),
            (F.col("verdict") == ALLOW).alias("allow"),  # wins among rules of one length
            "rule",
            "verdict",
            F.regexp_extract("rule", "/.*", 0).alias("path"),
        ).alias("given"),
    ).where("_suffix <> ''")
    labels = F.split("_host", r"\.")
    suffix = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
    )
    named = hosts.select(F.col("host").alias("_host")).distinct()
    named = named.select("_host", suffix.alias("_suffix"))
    return (
        named.join(given, "_suffix")
        .groupBy(F.col("_host").alias("host"))
        .agg(F.collect_set("given").alias("_given"))
    )


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) with ``rule`` and ``ruled``, the longest rule that fits and its verdict,
    null without one. A rule fits its host and all subdomains where the path starts with its path."""
    by_host = pin(_rules_by_host(urls, rules), "url-rules")
    joined = spread_left(urls, by_host, "host", F.struct("host", "path"))
    fitting = F.filter("_given", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(fitting)
    return joined.select(
        *urls.columns, best["rule"].alias("rule"), best["verdict"].alias("ruled")
    )


# -- the operator -------------------------------------------------------------------------------


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, ``targets``: what each page declares, whole pages read."""

    def make():
        def work(batch):
            urls = batch["url"].to_pylist()
            found = [declared(u, h.as_py()) for u, h in zip(urls, batch["html"])]
            yield {"page_id": batch["page_id"], "url": urls, "targets": found}

        return work

    given = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("binary"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_rows(given, make, f"page_id {kind}, url string, targets array<string>")


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``resource`` of every URL that is connected to a blocked one by ``edges`` (source, target)."""
    ends = [F.col(c) for c in ("source", "target")]
    known = pin(
        edges.select(
            *(
                F.struct(
                    resource_of(u).alias("node"), host_of(u).alias("host"), path_of(u).alias("path")
                ).alias(x)
                for u, x in zip(ends, "ab")
            )
        ).where("a.node is not null and b.node is not null"),
        "url-links",
    )
    found = components(known.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    urls = known.select("a.*").union(known.select("b.*")).distinct()
    blocked = with_rule(urls, rules).where(F.col("ruled") == BLOCK).select("node").distinct()
    roots = found.join(blocked, "node").select("root").distinct().withColumn("_tainted", F.lit(True))
    reached = spread_left(found, pin(roots, "url-roots"), "root", F.col("node"))
    return reached.where("_tainted").select(F.col("node").alias("resource"))


def judge(
    pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None
) -> DataFrame:
    """A row per page: page_id, host, path, ``rule`` (null without one) and ``verdict``.

    ``rules`` has columns verdict (allow or block) and rule (host/path-prefix), ``redirects`` may
    add links (source, target) that a crawler saw. The verdict is the rule's; without a rule it is
    block if an alias of the URL, at any number of links, is blocked by a rule, else allow. Aliases
    need not be rows of ``pages``.

    A null url, one without ``://`` or without a host has no aliases and no rule: allow. Null or
    broken html declares nothing. Repeated rows get the same verdict each. Rules that are null or
    neither allow nor block don't count; equal rules with both verdicts allow. An empty table
    gives no rows. Further columns are neither read nor returned.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    rows = pin(links(pages), "url-pages")
    edges = rows.select(F.col("url").alias("source"), F.explode("targets").alias("target"))
    if redirects is not None:
        edges = edges.union(redirects.select("source", "target"))
    tainted = pin(blocked_aliases(edges, rules), "url-tainted").withColumn("_tainted", F.lit(True))
    url = F.col("url")
    known = rows.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        resource_of(url).alias("resource"),
    )
    ruled = with_rule(known, rules)
    judged = spread_left(ruled, tainted, "resource", F.struct("page_id", "resource"))
    alias = F.when(F.col("_tainted"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", alias).alias("verdict")
    )


def oracle_sql() -> str:
    """The query in SQL. Of the targets it reads absolute and rooted ones."""
    values = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in RULES)
    lower = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

    def parts(url: str) -> str:
        rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
        piece = "coalesce(regexp_extract(" + rest + ", '" + _PARTS + "', %d, 's'), '')"
        return f"{lower % (piece % 1)} AS host, {piece % 2} AS path, {piece % 3} AS query"

    return f"""
WITH RECURSIVE rules AS (SELECT verdict, rule, regexp_extract(rule, '^[^/]*') AS rule_host,
  regexp_extract(rule, '/.*') AS rule_path FROM (VALUES {values}) AS r(verdict, rule)),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM pages),
targets AS (SELECT url, CASE
  WHEN regexp_matches(tag, '(?i)\\srel\\s*=\\s*["'']?(?:[^"''>]*\\s)?canonical')
  THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]*)', 1)
  WHEN regexp_matches(tag, '(?i)http-equiv\\s*=\\s*["'']?refresh')
  THEN regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''>]*)', 1) END AS target FROM tags),
links AS (SELECT url AS source, CASE WHEN starts_with(target, '/')
  THEN regexp_extract(url, '^.*?://[^/?#]*') || target ELSE target END AS target
  FROM targets WHERE contains(target, '://') OR starts_with(target, '/')),
urls AS (SELECT url, {parts('url')} FROM
  (SELECT url FROM pages UNION SELECT source FROM links UNION SELECT target FROM links) AS u),
named AS (SELECT url, host, path, CASE WHEN host <> ''
  THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS resource FROM urls),
best AS (SELECT url, max_by(rule, length(rule) * 2 + CAST(verdict = 'allow' AS INTEGER)) AS rule,
  max_by(verdict, length(rule) * 2 + CAST(verdict = 'allow' AS INTEGER)) AS verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
    AND starts_with(path, rule_path) GROUP BY url),
edges AS (SELECT a.resource AS a, b.resource AS b FROM links
  JOIN named a ON a.url = source JOIN named b ON b.url = target
  WHERE a.resource IS NOT NULL AND b.resource IS NOT NULL),
tainted AS (SELECT resource FROM named JOIN best USING (url) WHERE verdict = 'block'
  UNION SELECT CASE WHEN t.resource = a THEN b ELSE a END
  FROM tainted t JOIN edges e ON t.resource IN (a, b))
SELECT page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, b.rule,
  coalesce(b.verdict, CASE WHEN n.resource IN (SELECT resource FROM tainted) THEN 'block' ELSE 'allow' END)
  AS verdict
FROM pages p LEFT JOIN named n ON n.url IS NOT DISTINCT FROM p.url
LEFT JOIN best b ON b.url = p.url
"""
