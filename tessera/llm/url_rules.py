"""URL filter: allow and block rules in one trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and every subdomain, where the url's path starts with the
rule's path as a string; the longest fitting rule (host characters plus path characters) wins, and of rules of
one length an allow rule. No rule: `default`.

The trie is built once from the rule table and broadcast if that has at most `MAX_RULES` rules, counted before. Urls
are then judged where they lie: no shuffle. More rules are joined, with the same result: each distinct url looks up its
host suffixes and path beginnings among the rules, and the answers go back to the rows; both joins deal the rows of one
key to several tasks.

Null urls and urls without `://` have an empty host and path, match no rule that names a host or path, and get the
default; rules with a null host or path count as empty there, a null verdict is no rule. Repeated rows are judged alike.
Other columns pass through, but for those of the four names made here (`prefix` avoids that). An empty table gives no
rows, and an empty rule table the default for all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import split_join

#: Bound on the broadcast trie (a node or two per rule, some hundred bytes each).
MAX_RULES = 200_000

Rule = tuple[str, str, str]


class RuleTrie:
    """Host labels from the last to the first, then whole path segments; a rule's last segment may be a beginning."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("host", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {})
            if rest not in ends or verdict == "allow":
                ends[rest] = (len(host) + len(path), verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        best: tuple[int, bool, str, str] | None = None
        hosts, node = [self.root], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(("host", label))
            if node is None:
                break
            hosts.append(node)
        segments = path.split("/")
        for node in hosts:
            for k, segment in enumerate(segments):
                for rest, (size, verdict, name) in node.get("ends", {}).items():
                    if segment.startswith(rest):
                        found = (size, verdict == "allow", name, verdict)
                        best = found if best is None or found > best else best
                node = node.get(("path", segment))
                if node is None or k == len(segments) - 1:
                    break
        return best and (best[3], best[2])


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) as plain text cuts; no decoding."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return host.translate(_ASCII_LOWER), rest[:cut]


_ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


_MADE = ("host", "path", "rule", "verdict")


def _judged(trie, default: str):  # noqa: ANN001, ANN202
    """A column function from urls to (host, path, rule, verdict) by the broadcast trie."""

    @F.pandas_udf(T.StructType([T.StructField(x, T.StringType()) for x in _MADE]))
    def judged(urls):  # noqa: ANN001, ANN202
        import pandas as pd

        find, rows = trie.value.find, []
        for u in urls:
            host, path = split_url(u)
            hit = find(host, path)
            rows.append((host, path, hit[1] if hit else None, hit[0] if hit else default))
        return pd.DataFrame(rows, columns=list(_MADE), dtype=object)

    return judged


def _suffixes(host: Column) -> Column:
    """The host's last labels, from none to all."""
    labels = F.split(host, r"\.")
    own = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    return F.array_distinct(F.concat(F.array(F.lit("")), own))


def _beginnings(path: Column) -> Column:
    """The path's first segments, from none to all but the last."""
    segments = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda k: F.array_join(F.slice(segments, 1, k), "/")))


def best_rules(urls: DataFrame, rules: DataFrame, parts: int = 16) -> DataFrame:
    """host, path, rule, verdict for each distinct (host, path) of urls that a rule fits, by joins."""
    head = F.when(F.col("rule_path").contains("/"), F.regexp_replace("rule_path", r"(?s)/[^/]*\z", "")).otherwise("")
    held = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).withColumn("head", head)
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    each = urls.select("host", "path").distinct().withColumn("part", F.pmod(F.xxhash64("host", "path"), F.lit(parts)).cast("int"))
    asked = each.withColumn("rule_host", F.explode(_suffixes(F.col("host")))).withColumn("head", F.explode(_beginnings(F.col("path"))))
    fits = asked.join(held, ["rule_host", "head", "part"]).where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(name), F.col("verdict") == "allow", name)
    return fits.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), "verdict"), rank).alias("r")).select("host", "path", "r.*")


def judge_urls(df: DataFrame, rules: Iterable[Rule] | DataFrame, url: str = "url", default: str = "allow", prefix: str = "", most: int = MAX_RULES) -> DataFrame:
    """df with columns host, path, rule, verdict (each name after `prefix`, replacing columns so named).

    rules: (verdict, host, path) as rows or as a table with these columns; over `most` of them are joined, not broadcast.
    """
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        few = rules if len(rules) <= most else None
        rules = spark.createDataFrame(rules, "verdict string, host string, path string") if few is None else rules
    else:
        rules = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("verdict IS NOT NULL")
        few = [tuple(r) for r in rules.collect()] if rules.limit(most + 1).count() <= most else None
    judged = _judged(spark.sparkContext.broadcast(RuleTrie(few or [])), default)
    out = df.withColumn("__judged", judged(F.col(url).cast("string")))
    if few is None:
        out = out.withColumn("__key", F.struct("__judged.host", "__judged.path"))
        found = best_rules(out.select("__key.*"), rules).select(F.struct("host", "path").alias("__key"), F.col("rule").alias("__rule"), F.col("verdict").alias("__verdict"))
        out = split_join(out, found, "__key")
        own = F.struct("__key.host", "__key.path", F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))
        out = out.withColumn("__judged", own).drop("__key", "__rule", "__verdict")
    return out.withColumns({prefix + x: F.col(f"__judged.{x}") for x in _MADE}).drop("__judged")
