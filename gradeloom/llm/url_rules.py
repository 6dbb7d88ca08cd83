"""URL allow and block rules by a sort-merge range join.

A host with its labels reversed (``com.example.www.``) turns "this host and all below it" into a
prefix, and a prefix into an interval of sorted keys.  Rule hosts open and close their interval;
intervals nest, so one sorted sweep over rule ends and URLs needs only the stack of rules that
are open.  Rows are cut into slices by range, hot hosts by page id, and each slice starts with
the stack that the slices before it left.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.operators.ordered import sliced

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for NULL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot: a host's key starts with those of the hosts above it."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """key, stack: the rules open from this key on (host, path, verdict), one row for each end of a rule host's interval.

    ``stack`` of an opening end holds the rules of the host and of all hosts above; of a closing
    end, those above alone.  A host above another is one of its label suffixes, so an equality
    join finds them.
    """
    rule = rules.where(F.col("host").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict")).distinct()
    hosts = rule.select("host").distinct()
    labels = F.split("host", "\\.")
    above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up", "at"))
    held = rule.select(F.col("host").alias("at"), F.struct("host", "path", "verdict").alias("rule"))
    stacks = above.join(held, "at").groupBy("host").agg(
        F.array_sort(F.collect_list("rule")).alias("own"), F.array_sort(F.collect_list(F.when(F.col("up") > 0, F.col("rule")))).alias("outer"))
    key = host_key(F.col("host"))
    closing = F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/"))  # "/" follows "." in the order of bytes
    return stacks.select(F.explode(F.array(F.struct(key.alias("key"), F.col("own").alias("stack")), F.struct(closing.alias("key"), F.col("outer").alias("stack")))).alias("e")).select("e.*")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url", slices: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all hosts below when the URL's path starts with
    the rule's.  The longest host and path together win; then the longer host; then block.  No rule:
    ``default`` and a NULL rule.  NULL rule paths count as empty and rules without a host are left
    out.  NULL URLs have an empty host; repeated pages are judged each; no pages give no rows.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    events = rule_events(rules)
    none = F.lit(None).cast(events.schema["stack"].dataType)
    both = rows.select("key", F.lit(1).alias("kind"), "page_id", "host", "path", none.alias("stack")).unionByName(
        events.select("key", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"),
                      F.lit(None).cast("string").alias("path"), "stack"))
    order = [F.col("key"), F.col("kind"), F.col("page_id")]
    cut = sliced(both, [], order, slices)
    ends = cut.where("kind = 0").groupBy("_slice").agg(F.max_by("stack", F.col("key")).alias("end"))
    known = cut.select("_slice").distinct().join(ends, "_slice", "left")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    starts = known.select("_slice", F.last("end", ignorenulls=True).over(before).alias("start"))
    upto = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = cut.withColumn("open", F.last("stack", ignorenulls=True).over(upto)).where("kind = 1")
    active = swept.join(F.broadcast(starts), "_slice").withColumn("open", F.coalesce("open", "start"))
    fits = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("host_size"),
                                                           r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    return active.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
