"""URL filters by a sort-merge range join on reversed hosts.

A rule is a host and a path; it fits its host and all subdomains where the path starts with the rule's. A key is
the labels of a host in reverse, ``/``, and the path: ``org.example/`` and ``/fr/``. Keys that start with a rule's key are
an interval of the sorted keys, and the intervals of two rules are nested or apart. A url has one key for its host
and one for each parent that some rule is written for, so that subdomains and paths together are still prefixes.

The sorted keys are cut into cells at sampled keys; a rule is sent to every cell that its interval meets, which
for each cut are no more than the rules nested there. In a cell rules and keys are sorted together and swept once: the
stack holds the rules that the present key starts with, the innermost on top. Equal keys are told apart by a
salt, so a url or host with any share of the rows is cut like all others.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velomart.llm.common import stage

#: Keys of a cell, about, and cells at most: their cuts go through the driver.
CELL_ROWS, MOST_CELLS = 5_000, 16_384
#: Sampled keys for each cut, and the characters that a cut is made of.
PER_CUT, CUT_CHARS = 8, 1_024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"

# The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, lower-cased, and then up to ``?`` or ``#``.

    Both are empty for a null url and one without ``://``.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def keyed_rules(rules: DataFrame) -> DataFrame:
    """(key, domain, labels, length, rule, verdict): one row per host and path.

    Null hosts and paths count as empty; an empty host fits urls without a host. Of rules with equal host and path that
    with the greatest verdict counts, block before allow.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    found = rules.select(host.alias("host"), path.alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    domain = F.array_join(_reversed(F.col("host")), ".")
    rule = F.concat("host", "path")
    return found.select(
        F.concat(domain, F.lit("/"), "path").alias("key"),
        domain.alias("domain"),
        F.size(_reversed(F.col("host"))).alias("labels"),
        F.char_length(rule).alias("length"),
        rule.alias("rule"),
        "verdict",
    )


def cuts(keys: DataFrame, partitions: int) -> list[tuple[str, int]]:
    """(start of key, salt) at which the sorted keys are cut into cells of like size, at least two per partition.

    From a sample that decides where cells end and nothing else.
    """
    total = keys.count()
    cells = min(MOST_CELLS, max(2 * partitions, math.ceil(total / CELL_ROWS)))
    share = min(1.0, PER_CUT * cells / max(1, total))
    chosen = F.pmod(F.xxhash64("salt", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted((r[0], r[1]) for r in keys.where(chosen).select(F.substring("key", 1, CUT_CHARS), "salt").collect())
    return sorted({sample[k * len(sample) // cells] for k in range(1, cells)}) if sample else []


def _key_cells(keys: DataFrame, at: list[tuple[str, int]]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True)
            cell = [bisect.bisect_right(at, (k[:CUT_CHARS], s)) for k, s in own]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("key"), batch.column("row")], ["cell", "key", "row"])

    return keys.mapInArrow(rows, "cell int, key string, row long")


def _rule_cells(rules: DataFrame, at: list[tuple[str, int]]) -> DataFrame:
    """Every rule once for each cell that may hold a key which starts with its own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, taken = [], []
            for k, key in enumerate(batch.column("key").to_pylist()):
                start = key[:CUT_CHARS]
                stop = start if len(key) >= CUT_CHARS else key + LAST
                own = range(bisect.bisect_right(at, (start, -(1 << 63))), bisect.bisect_right(at, (stop, 1 << 63)) + 1)
                cell += own
                taken += [k] * len(own)
            spread = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *spread.columns], ["cell", *spread.schema.names])

    columns = ["key", "labels", "length", "rule", "verdict"]
    return rules.select(columns).mapInArrow(rows, "cell int, key string, labels int, length int, rule string, verdict string")


def _swept(events: DataFrame) -> DataFrame:
    """(row, length, labels, rule, verdict): the innermost rule of every key that starts with one.

    ``events`` are sorted by cell and key, rules before other keys.
    """
    columns = ["row", "length", "labels", "rule", "verdict"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, present = [], None
        for batch in batches:
            found = []
            for cell, key, row, *rule in zip(*(batch.column(c).to_pylist() for c in ("cell", "key", *columns)), strict=True):
                if cell != present:
                    stack, present = [], cell
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if row is None:
                    stack.append((key, rule))
                elif stack:
                    found.append((row, *stack[-1][1]))
            values = list(zip(*found, strict=True)) or [[]] * len(columns)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], columns)

    return events.mapInArrow(rows, "row long, length int, labels int, rule string, verdict string")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of ``pages``, further columns left out.

    ``rules``: (host, path, verdict). The longest rule by characters of host and path wins, of two as long the one with more
    labels in its host. ``rule`` is its host and path, null where none fits and ``verdict`` is ``default``. Null urls
    and urls without ``://`` have an empty host and path. Rows that repeat are judged each; no rules: all default.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = stage(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    rules = stage(keyed_rules(rules), "rules")
    most = rules.agg(F.max("labels")).first()[0] or 0  # no rule has a longer host, so no key needs one
    labels = F.slice(_reversed(F.col("host")), 1, max(1, most))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    keys = (
        urls.select("row", "path", F.explode(domains).alias("domain"))
        .join(rules.select("domain").distinct(), "domain", "left_semi")
        .select(F.concat("domain", F.lit("/"), "path").alias("key"), "row", F.xxhash64("row").alias("salt"))
    )
    keys = stage(keys, "keys")
    at = cuts(keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = _key_cells(keys, at).unionByName(_rule_cells(rules, at), allowMissingColumns=True)
    order = ["cell", "key", F.col("row").asc_nulls_first()]
    found = _swept(events.repartition("cell").sortWithinPartitions(*order))
    best = found.groupBy("row").agg(F.max(F.struct("length", "labels", "rule", "verdict")).alias("best"))
    return urls.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rules_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""
WITH rests AS (
    SELECT row_number() OVER () AS n, page_id,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), urls AS (
    SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), rules(host, path, verdict) AS (VALUES {_VALUES}),
fits AS (
    SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN fits USING (n)
"""
