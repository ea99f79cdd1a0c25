"""URL rules by a sort-merge range join.

A rule is a host and a path prefix; it fits its host and all subdomains.  Its
canonical key is the reversed host, an end mark, and the path; all urls that it
fits under one host lie in the interval of keys that begin with it.  A url
probes once for each ancestor host that a rule could name, so subdomains need
no second dimension.  Rules and probes are sorted together, and one sweep over
the order keeps the stack of rules whose intervals are open: intervals of
prefixes nest, so the stack's top is the longest rule that holds.

Probes at hosts without rules go first.  Those of one host are dealt out by a
salt and the host's rules are copied to each salt; a host has as many salts as
its share of all probes fills parts of a fixed number of tasks, so one with a
third of all urls is swept by a third of them, and most hosts have one.  A task
streams its rows and holds no more than the stack.

Defined results: a null url or one without ``://`` has an empty host and path;
a null in a rule counts as empty, and repeated rules count once (block wins
over allow for equal rules); rules of equal length that fit one url are decided
by the longer host; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow, settle, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a shuffle partition's share of all probes that one salt of a host holds.
PARTS = 4
DEFAULT = "allow"
#: The rules of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _sweep(batches):
    """Rows by (host, salt) and key, a rule before the probes that it fits: probes leave with the stack's top."""
    group, stack = None, []
    for batch in batches:
        cells, keys, rules, ids, kinds = (batch.column(i).to_pylist() for i in range(5))
        out: list[tuple[int, str, str]] = []
        for cell, key, rule, rid, verdict in zip(cells, keys, rules, ids, kinds):
            if cell != group:
                group, stack = cell, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule, verdict))
            elif stack:
                out.append((rid, stack[-1][1], stack[-1][2]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], ["rid", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; rules: verdict, host, path."""
    spark = pages.sparkSession
    clean = (
        rules.select(F.coalesce("verdict", F.lit("block")).alias("verdict"), F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    depth = clean.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    mark = F.lit("\x01")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = settle(rows, "url-rows")  # both uses below see the same numbers of rows
    clean = settle(clean, "url-rules")
    labels = F.split("host", r"\.", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth, 1)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    at = rows.select("rid", "path", F.explode(ancestors).alias("at"))
    sizes = at.groupBy("at").agg(F.count("*").alias("n")).join(clean.select(F.col("host").alias("at")).distinct(), "at")
    tasks = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = F.lit(max(rows.count(), 1))
    salts = settle(sizes.select("at", F.ceil(F.col("n") * tasks / total).cast("int").alias("salts")), "url-salts")
    cell = lambda host, salt: F.concat(_reversed(F.col(host)), F.lit("\x02"), salt.cast("string")).alias("cell")
    probes = at.join(salts, "at").select(
        cell("at", F.pmod(F.xxhash64("rid"), F.col("salts"))),
        F.concat(_reversed(F.col("at")), mark, "path").alias("key"),
        F.lit(None).cast("string").alias("rule"),
        "rid",
        F.lit(None).cast("string").alias("verdict"),
    )
    copies = clean.join(salts, clean["host"] == salts["at"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        cell("host", F.col("salt")),
        F.concat(_reversed(F.col("host")), mark, "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        F.lit(None).cast("long").alias("rid"),
        "verdict",
    )
    # nulls sort first, so a rule stands before probes with its own key
    both = probes.unionByName(copies).repartition("cell").sortWithinPartitions("cell", "key", "rid")
    hits = both.transform(in_arrow, _sweep, "rid long, rule string, verdict string")
    slash = F.instr("rule", "/")
    host_length = F.when(slash > 0, slash - 1).otherwise(F.length("rule"))
    best = hits.groupBy("rid").agg(F.max(F.struct(F.length("rule").alias("n"), host_length.alias("h"), "rule", "verdict")).alias("b"))
    return rows.join(best, "rid", "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, CAST(strpos(url, '://') + 3 AS INT)) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (SELECT page_id, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := verdict)) AS b
        FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)
"""
