"""URL rules as a sort-merge range join over reversed hosts.

A rule (verdict, host, path) fits its host and every subdomain if the url's path
starts with the rule's path; of the rules that fit, the longest wins. A host
turned round, label by label and each ended by a dot (``com.example.``), makes
the hosts under a rule one interval of keys; followed by ``/`` marks and the
path, the urls under a rule become one interval too. So every url takes one key
for each ending of its host (``com.``, ``com.example.``, ...), and every rule is
the interval of keys that start with its own key.

Intervals of prefixes nest. One sweep over the sorted rules keeps the stack of
rules that are open and leaves disjoint pieces of the key space, each with the
innermost rule of the stack. Keys and pieces are then sorted together by range
partitions, and each key takes the last piece before it; what is open where a
partition begins is carried in from the partitions before. A host that owns a
third of all urls is spread over partitions, since the page id breaks ties.

Only DataFrame functions touch the rows. The rules are configuration of the
caller, held by the driver.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; no rule gives the verdict ``allow``; repeated rows are judged one by
one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.session import materialize

Rule = tuple[str, str, str]
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends the host part of a key; sorts before every character a path may hold.
_HOST_END = "\x00"
_PIECES = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("rule", T.StringType()),
                        T.StructField("verdict", T.StringType()), T.StructField("width", T.LongType())])


def _host_and_path(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def url_host(url: Column) -> Column:
    """From the first :// to the next /, ?, # or end, A-Z lower-cased."""
    host = F.substring_index(_host_and_path(url), "/", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end to the first ? or # after it."""
    return F.regexp_extract(_host_and_path(url), r"(?s)^[^/]*(/.*)$", 1)


def _reversed_host(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


def _after(prefix: bytes) -> bytes | None:
    """The first key beyond all keys that start with ``prefix``."""
    while prefix and prefix[-1] == 0xFF:
        prefix = prefix[:-1]
    return prefix[:-1] + bytes([prefix[-1] + 1]) if prefix else None


def rule_pieces(rules: Sequence[Rule]) -> list[tuple[bytes, str | None, str | None, int]]:
    """(first key, rule, verdict, length) of the pieces that the sweep leaves.

    The stack holds the open rules, the innermost on top; of two rules with the
    same host and path the first counts.
    """
    spans: dict[bytes, tuple[str, str, int]] = {}
    for verdict, host, path in rules:
        host = host.translate(str.maketrans(_UPPER, _LOWER))
        spans.setdefault((_reversed_host(host) + _HOST_END + path).encode(),
                         (host + path, verdict, len(host) + len(path)))
    pieces, stack = {}, []

    def close(until: bytes | None) -> None:
        while stack and (until is None or not until.startswith(stack[-1])):
            end = _after(stack.pop())
            if end is not None:
                pieces[end] = spans[stack[-1]] if stack else (None, None, 0)

    for start in sorted(spans):
        close(start)
        stack.append(start)
        pieces[start] = spans[start]
    close(None)
    return [(key, *pieces[key]) for key in sorted(pieces)]


def _keys(urls: DataFrame) -> DataFrame:
    """One row per url and ending of its host, with the key to look up."""
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda n: F.concat(F.array_join(F.reverse(F.slice(labels, -n, n)), "."), F.lit(".")))
    return (urls.select("host", "path", F.explode(endings).alias("ending"))
            .select("host", "path", F.encode(F.concat("ending", F.lit(_HOST_END), "path"), "UTF-8").alias("key")))


def sweep(keys: DataFrame, pieces: list[tuple]) -> DataFrame:
    """Adds to each (host, path, key) the ``piece`` of the key space it falls into."""
    marks = (keys.sparkSession.createDataFrame(pieces, _PIECES)
             .select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key",
                     F.struct("rule", "verdict", "width").alias("piece")))
    none = F.lit(None).cast(marks.schema["piece"].dataType)
    # A mark counts for the keys equal to it, so it sorts before them: its host is null.
    order = [F.col("key"), F.col("host").asc_nulls_first()]
    ordered = materialize(keys.withColumn("piece", none).unionByName(marks).repartitionByRange(*order)
                          .withColumn("part", F.spark_partition_id()), "url-sweep")
    parts = ordered.groupBy("part").agg(F.max_by("piece", F.when(F.col("piece").isNotNull(), F.col("key"))).alias("carry"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    carried = parts.select("part", F.last("carry", ignorenulls=True).over(before).alias("carry"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (ordered.withColumn("last", F.last("piece", ignorenulls=True).over(inside))
            .where(F.col("host").isNotNull())
            .join(F.broadcast(carried), "part", "left")
            .select("host", "path", F.coalesce("last", "carry").alias("piece")))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to each row.

    Distinct (host, path) pairs are swept, so a url that is repeated many times
    is looked up once; input columns of these names are replaced.
    """
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*others, url_host(url).alias("host"), url_path(url).alias("path"))
    pieces = rule_pieces(rules)
    if not pieces:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = parsed.where(F.col("host") != "").select("host", "path").distinct()
    best = (sweep(_keys(distinct), pieces).where(F.col("piece.rule").isNotNull())
            .groupBy("host", "path").agg(F.max_by("piece", F.struct("piece.width", "piece.rule")).alias("piece")))
    same = (parsed["host"] == best["host"]) & (parsed["path"] == best["path"])
    return parsed.join(best, same, "left").select(
        *[parsed[f"`{c}`"] for c in parsed.columns], best["piece"]["rule"].alias("rule"),
        F.coalesce(best["piece"]["verdict"], F.lit(default)).alias("verdict"))
