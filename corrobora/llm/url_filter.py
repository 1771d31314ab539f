"""URL filters by a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased URL in one pass. A hit counts only
between boundaries (characters other than letters and digits, or the ends). A strict term weighs as much as the limit;
a soft term weighs 1, and repeats of a term count once, so a URL is rejected for one strict or `limit` distinct soft
terms. Allow and block rules of (host, path prefix) come before the vocabulary; the longest that fits decides.

Defined cases: a null URL, or one without "://", has an empty host and path, no rule fits it, and its verdict is that
of the vocabulary on whatever text there is (allow for null or empty). Very long URLs are read whole. Equal URLs get
equal verdicts; a null page_id is kept. An empty table gives no rows. Only page_id and url are read, so other columns
can't clash. An empty vocabulary blocks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The vocabulary by default; load_vocabulary reads larger ones.
STRICT = ("adult", "casino", "porn", "porno", "sex", "xxx", "viagra", "escort", "hentai", "nsfw")
SOFT = ("ads", "bet", "bets", "betting", "bonus", "cheap", "click", "deal", "deals", "farm", "free", "gambling", "jackpot", "lottery", "pill", "pills", "poker", "popup", "promo", "seo", "spam", "track", "tracker", "win")
#: Distinct soft terms that reject a URL; a strict term weighs as much.
SOFT_LIMIT = 2
#: The rules of the query: (verdict, rule's host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def automaton(strict=STRICT, soft=SOFT, limit: int = SOFT_LIMIT):
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, 1))
    for term in strict:
        found.add_word(term, (term, limit))
    found.make_automaton()
    return found


def load_vocabulary(spark: SparkSession, path: str, most: int = 1_000_000) -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a tab-separated file of (term, strict or soft). It is sent to all tasks, so more than `most` terms are an error."""
    rows = spark.read.csv(path, sep="\t", schema="term string, kind string").filter("term IS NOT NULL").distinct()
    rows = rows.select(F.lower("term").alias("term"), "kind").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} terms")
    if unknown := sorted({str(r["kind"]) for r in rows} - {"strict", "soft"}):
        raise ValueError(f"unknown kinds of terms: {unknown[:5]}")
    return tuple(sorted({r["term"] for r in rows if r["kind"] == kind}) for kind in ("strict", "soft"))


def weight(url: str, terms) -> int:
    """The summed weights of the distinct terms that stand between boundaries in url."""
    if not len(terms):
        return 0
    low = url.lower()
    hits = {}
    for end, (term, w) in terms.iter(low):
        start = end - len(term) + 1
        if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
            hits[term] = w
    return sum(hits.values())


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host: str, path: str, rules) -> tuple[str | None, str | None]:
    """The longest rule that fits, with its verdict. Rules: by host, pairs of (path, verdict), longest paths first.

    Of two rules that fit, the longer text wins: a subdomain's rules are longer in the host, and come first here.
    """
    best: tuple[str | None, str | None] = (None, None)
    at = 0
    while host and at >= 0:
        name = host[at:]
        for start, verdict in rules.get(name, ()):
            if path.startswith(start) and len(name + start) > len(best[0] or ""):
                best = name + start, verdict
        dot = host.find(".", at)
        at = dot + 1 if dot >= 0 else -1
    return best


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, weight) of each row."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host, []).append(("/" + path, verdict))

    @F.pandas_udf("host string, path string, rule string, verdict string, weight int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = automaton(strict, soft, limit)
        for urls in batches:
            out = []
            for url in urls:
                host, path = split_url(url)
                rule, verdict = rule_for(host, path, by_host)
                w = weight(url or "", terms)
                out.append((host, path, rule, verdict or ("block" if w >= limit else "allow"), w))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "weight"])

    return pages.select("page_id", judge(F.col("url").cast("string")).alias("out")).select("page_id", "out.*")


def op9_url_filter(spark, sf_dir) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"))


def _any(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}]){t}([^\\p{{L}}\\p{{N}}]|$)') AS INT)" for t in terms)


OP9_SQL = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
         {SOFT_LIMIT} * ({_any(STRICT)}) + {_any(SOFT)} AS weight
  FROM u),
r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{x.partition('/')[0]}', '/{x.partition('/')[2]}')" for v, x in RULES)}),
m AS (
  SELECT page_id, h.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM h JOIN r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path) GROUP BY page_id, h.url)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, CASE WHEN weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, CAST(weight AS INT) AS weight
FROM h LEFT JOIN m ON h.page_id IS NOT DISTINCT FROM m.page_id AND h.url IS NOT DISTINCT FROM m.url
"""
