"""URL filters: pattern rules indexed by their rarest literal token (operator 7).

A rule is either a site, ``host/path`` (the host with all its subdomains, and a path's beginning), or a pattern
over the whole url in which ``*`` stands for anything, ``^`` for one character that is no letter or digit, or the url's
end, and other characters for themselves. Tokens are runs of letters and digits. A pattern's tokens that
can't be part of longer ones in a fitting url index it: the url must hold each of them, so the rarest
among all urls fetches the fewest. Only the rules fetched by a url's own tokens run their expression on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizgrove.llm.common import counted
from quizgrove.session import saved

TOKEN = r"[a-z0-9]+"
#: The token that every url has, for rules without one of their own.
ANY = ""


@dataclass(frozen=True)
class Rule:
    """A rule's text, allow or block, and whether it is a site (else a pattern)."""

    text: str
    verdict: str
    site: bool = False

    def expression(self) -> str:
        """For a site, of ``host#path``; for a pattern, of the url in lower case."""
        if self.site:
            host, _, path = self.text.partition("/")
            return rf"(?s)^(?:.*\.)?{literal(host.lower())}#{literal('/' + path)}"
        parts = {"*": ".*", "^": "(?:[^a-z0-9]|$)"}
        return "(?s)" + "".join(parts.get(c) or literal(c) for c in self.text.lower())

    def tokens(self) -> list[str]:
        """Tokens that any fitting url holds whole, in lower case: those with a separator on both sides."""
        text = self.text.lower()
        found = []
        for m in re.finditer(TOKEN, text):
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            ends_whole = bool(after) and (self.site or after != "*")
            starts_whole = self.site or bool(before) and before != "*"
            if starts_whole and ends_whole:
                found.append(m.group())
        return list(dict.fromkeys(found)) or [ANY]


def literal(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


#: Fixed by the contract of the query: sites, the longest that fits decides.
SITES = (
    Rule("net/", "block", site=True),
    Rule("example.net/en/", "allow", site=True),
    Rule("example.com/de/", "block", site=True),
    Rule("org/fr/", "allow", site=True),
)
#: Patterns for urls that no site decides: trackers, copies of pages, and pages that are no text.
PATTERNS = (
    Rule("^utm_source^", "block"),
    Rule("^sessionid^", "block"),
    Rule("^ref^x^", "block"),
    Rule("^login^", "block"),
    Rule("^cart^", "block"),
    Rule("^tag^", "block"),
    Rule("^feed^*^xml^", "block"),
    Rule("^print^", "block"),
    Rule("^casino*", "block"),
    Rule("*.pdf^", "block"),
)
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; then up to ``?``, ``#`` or the end."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), capitals, capitals.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(TOKEN), F.lit(0)))


RULES = "number long, rule string, verdict string, site boolean, expression string, tokens array<string>"


def rule_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.text, r.verdict, r.site, r.expression(), r.tokens()) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def usable(rules: DataFrame) -> DataFrame:
    """``rules`` (rule, verdict, site) with ``ok``: a text that is no blank, a verdict of allow or block, and site or not."""
    fits = (F.trim("rule") != "") & F.col("verdict").isin("allow", "block") & F.col("site").isNotNull()
    return rules.select("rule", "verdict", "site").withColumn("ok", F.coalesce(fits, F.lit(False)))


def rule_table(rules: DataFrame) -> DataFrame:
    """A list of rules as a table, saved: each different usable rule with its expression and tokens.

    ``usable`` tells which rows are left out. Sites are written as ``host/path``, with a slash at least.
    """
    given = usable(rules).filter("ok").drop("ok").distinct().withColumn("number", F.monotonically_increasing_id())

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [Rule(*row) for row in zip(batch["rule"], batch["verdict"], batch["site"], strict=True)]
            yield batch.assign(expression=[rule.expression() for rule in made], tokens=[rule.tokens() for rule in made])

    columns = [column.split()[0] for column in RULES.split(", ")]
    return saved(saved(given, "given-rules").mapInPandas(prepare, "rule string, verdict string, site boolean, number long, expression string, tokens array<string>").select(*columns), "rules")


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with the token that indexes each: the one that the fewest urls hold, of equals the least.

    ``tokens`` has a row for each url and token. Only tokens that rules have are counted.
    """
    each = rules.select("number", F.explode("tokens").alias("token"))
    counts = tokens.join(counted(each.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    each = each.join(counts, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    # a rule that any url may fit can't count on a token
    rarest = each.groupBy("number").agg(F.min_by("token", F.struct("urls", "token")).alias("token"))
    return rules.drop("tokens").join(rarest, "number")


def judged_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame = (*SITES, *PATTERNS), default: str = DEFAULT) -> DataFrame:
    """url, host, path, rule (the deciding site or null) and verdict of each different url, null included.

    The longest site that fits decides; without one a fitting pattern does, block before allow; else ``default``. Null
    urls and those without ``://`` have an empty host and path, which no site fits. Urls of any length are judged whole.
    ``rules`` is a list, or a table of any size that ``rule_table`` made.
    """
    spark = pages.sparkSession
    urls = pages.select("url").distinct()
    host, path = host_and_path(F.col("url"))
    urls = saved(urls.select("url", host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens")), "urls")
    tokens = urls.filter("url IS NOT NULL").select("url", "host", "path", F.explode(F.concat("tokens", F.array(F.lit(ANY)))).alias("token"))
    index = saved(rule_index(rules if isinstance(rules, DataFrame) else rule_frame(spark, rules), tokens), "url-rules")
    fetched = tokens.join(counted(index), "token")
    subject = F.when(F.col("site"), F.concat_ws("#", "host", "path")).otherwise(F.lower("url"))
    fitting = fetched.filter(F.regexp_like(subject, F.col("expression")))
    first = F.struct(
        (~F.col("site")).alias("pattern"),
        F.when(F.col("site"), -F.char_length("rule")).otherwise(0).alias("length"),
        (F.col("verdict") != "block").alias("allows"),
        "rule",
        "verdict",
    )
    best = fitting.groupBy("url").agg(F.min(first).alias("best"))
    rows = urls.drop("tokens").join(best.withColumnRenamed("url", "of"), F.col("url").eqNullSafe(F.col("of")), "left")
    site = F.when(~F.col("best.pattern"), F.col("best.rule"))
    return rows.select("url", "host", "path", site.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] | DataFrame = (*SITES, *PATTERNS), default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``; see ``judged_urls``.

    Each different url is judged once. Every row is returned, equal rows and null ids too; other columns are not
    read; an empty table gives no rows.
    """
    found = saved(judged_urls(pages, rules, default), "judged-urls").withColumnRenamed("url", "of")
    rows = pages.select("page_id", "url").join(found, F.col("url").eqNullSafe(F.col("of")))
    return rows.select("page_id", "host", "path", "rule", "verdict")
