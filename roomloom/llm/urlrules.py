"""URL filters: one trie over reversed host labels and path segments.

A rule is (action, host, path).  It fits a url whose host is the rule's or a
subdomain of it and whose path starts with the rule's path.  Among the fitting
rules the one with most host labels wins, then the one with the longest path;
of equal rules, ``block`` wins.  Allow and block entries share the trie, so a
longer allow entry opens a hole in a shorter block entry and the reverse.

Defined cases: a null url or one without ``://`` has empty host and path and
fits nothing; repeated urls give repeated rows; an empty table gives no rows;
columns of the input other than the id are not carried, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

Rule = tuple[str, str, str]

_RULE, _PATHS = "//", "/"  # keys of a node that no label or segment can equal, empty ones included


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
    Path: from there to ``?``, ``#`` or the end."""
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dicts: host labels from the last to the first, then path segments.

    All segments of a rule's path but the last are whole; the last is a prefix
    and is kept in the node's list, longest first.
    """
    root: dict = {}
    for action, host, path in sorted(rules, key=lambda r: r[0] == "block"):
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATHS, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(f"/{segment}", {})
        node.setdefault(_RULE, {})[last] = (f"{host}{path}", action)
    stack = [root]
    while stack:
        node = stack.pop()
        for key, value in node.items():
            if key == _RULE:
                node[key] = sorted(value.items(), key=lambda x: -len(x[0]))
            else:
                stack.append(value)
    return root


def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    found = None
    for segment in segments:
        for prefix, rule in node.get(_RULE, ()):
            if segment.startswith(prefix):
                found = rule
                break
        node = node.get(f"/{segment}")
        if node is None:
            break
    return found


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The winning (rule, action), or None."""
    found, node, segments = None, trie, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if _PATHS in node:
            found = _in_path(node[_PATHS], segments) or found
    return found


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    max_broadcast_rules: int = 50_000,
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    Up to ``max_broadcast_rules`` rules (about a kilobyte each in a worker) the trie is
    broadcast and no row is shuffled; beyond that the rules are joined as a
    table, see :func:`judge_urls_by_join`.
    """
    if len(rules) > max_broadcast_rules:
        table = pages.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
        return judge_urls_by_join(pages, table, default, id_col, url_col)
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [look_up(trie, h, p) for h, p in zip(hosts, paths, strict=True)]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"]
            )

    kind = dict(parts.dtypes)[id_col]
    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def judge_urls_by_join(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """The same verdicts with ``rules`` (action, host, path) as a table of any size.

    Each distinct (host, path) meets only the rules of its own host suffixes.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action"))
    best = (
        parts.select("host", "path").distinct()
        .withColumn("r_host", F.explode(suffixes))
        .join(r, "r_host")
        .filter(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")),
                F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), F.col("r_action") == "block"),
            ).alias("best")
        )
    )
    return parts.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
