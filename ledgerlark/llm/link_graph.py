"""URL verdicts from rules and, where no rule fits, from trust and distrust spread over the host graph.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages
and runs against them, to those that link there. Both are personalised PageRanks on the same join: an
edge list that holds each direction with its own shares. A host is blocked if distrust is more than a
given share of what reached it, and allowed otherwise, also if nothing reached it. The share does not
depend on the size of a rank, and the ranks go on until no host is reached anew and none changes by more
than a relative tolerance, so neither the size of the table nor the distance from a seed decides.

Most links stay within a domain, so ranks settle there first: hosts are dealt by domain to cells of a bounded
number of edges (a domain with more is dealt by host), each cell is solved by itself in a task, and ranks
over the borders of cells are exchanged by a join until nothing grows. Ranks only grow, whatever the cells, and
reach the same values in no more rounds than by exchanging all edges each time.

Edges are links between hosts, counted once per page and target, and both directions between a host and
the domain above it with at least two labels. Links are folded to one row per pair of hosts before they
are joined. The rank that leaves hosts without links is not dealt out again; this scales all ranks
alike, and ranks are normalised at the end.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null pages have no links; repeated rows count each; without seeds nothing spreads and all hosts
without a rule are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.tables import stored
from ledgerlark.session import pin

DAMPING, ROUNDS, BLOCK_SHARE = 0.85, 24, 0.5
TOLERANCE = 1e-6
#: Edges of both directions that a cell holds on average; 100 bytes each in its task.
CELL_EDGES = 500_000
_PIN_EVERY = 3
#: Far from all seeds a rank would become 0 in a double; a host that was reached keeps this much.
_LEAST = 1e-290


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"), UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, of equally long ones the last listed; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links of pages with (host, html), and domain ties."""
    link = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("""(?i)href\\s*=\\s*["']?\\s*(?:https?:)?//([^/?#"'\\s>]+)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(link, lower_ascii))).alias("dst"))
    links = links.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select(F.col("host").alias("h")).where("h != ''").unionByName(links.select(F.col("dst").alias("h"))).distinct()
    labels = F.split("h", "\\.")
    # a host and each domain above it form a chain of ties
    chain = hosts.select(F.explode(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0)))).alias("k"), labels.alias("l"))
    name = lambda k: F.array_join(F.slice("l", k + 1, F.size("l")), ".")
    ties = chain.where(F.size("l") - F.col("k") > 2).select(name(F.col("k")).alias("src"), name(F.col("k") + 1).alias("dst")).distinct()
    both = ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _in_cells(ways: DataFrame, start: DataFrame, cell_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranks, inner edges, border edges): all with cells, and the ranks with what starts at each host."""
    cells = max(1, -(-ways.count() // cell_edges))
    domain = lambda host: F.substring_index(host, ".", -2)
    wide = ways.groupBy(domain("to_host").alias("wide")).count().where(F.col("count") > cell_edges).select("wide")
    wide = pin(wide)

    def dealt(df: DataFrame, host: str, cell: str) -> DataFrame:
        found = df.join(wide, domain(host) == F.col("wide"), "left")
        key = F.when(F.col("wide").isNull(), domain(host)).otherwise(F.col(host))
        return found.withColumn(cell, F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")).drop("wide")

    placed = stored(dealt(dealt(ways, "from_host", "from_cell"), "to_host", "cell"), "edges")
    reached = start.select("host", "good", "rank").unionByName(ways.select(F.col("to_host").alias("host"), "good", F.lit(0.0).alias("rank")))
    hosts = reached.groupBy("host", "good").agg(F.sum("rank").alias("start"))
    ranks = dealt(hosts, "host", "cell").select("cell", "good", "host", "start", F.lit(0.0).alias("rank"))
    inside = F.col("from_cell") == F.col("cell")
    return ranks, placed.where(inside).drop("from_cell"), placed.where(~inside).drop("from_cell")


def _settled(ways: DataFrame, start: DataFrame, tolerance: float, cell_edges: int) -> DataFrame:
    """(host, good, rank) of all hosts reached."""
    ranks, inner, border = _in_cells(ways, start, cell_edges)
    schema = "cell int, good boolean, host string, start double, rank double, grew boolean"
    closed = border.isEmpty()

    def solve(key, rows: pa.Table, edges: pa.Table) -> pa.Table:
        # rows repeat nothing; an edge from a host that nothing reaches moves nothing
        at = pd.Index(rows.column("host").to_pandas())
        from_at, to_at = (at.get_indexer(edges.column(c).to_pandas()) for c in ("from_host", "to_host"))
        known = (from_at >= 0) & (to_at >= 0)
        from_at, to_at, part = from_at[known], to_at[known], edges.column("part").to_numpy()[known]
        given = rows.column("start").to_numpy() + rows.column("inflow").to_numpy()
        before = rows.column("rank").to_numpy()
        rank, growing = before, True
        while growing:
            after = given + np.bincount(to_at, weights=part * rank[from_at], minlength=len(at))
            after = np.where(after > 0, np.maximum(after, _LEAST), 0.0)
            # each cell is solved closer than all of them together
            growing = bool((after - rank > after * (tolerance / 10)).any())
            rank = after
        return pa.table({
            "cell": rows.column("cell"), "good": rows.column("good"), "host": rows.column("host"), "start": rows.column("start"),
            "rank": pa.array(rank), "grew": pa.array(rank - before > rank * tolerance),
        })

    inflow = None
    while True:
        rows = ranks.withColumn("inflow", F.lit(0.0)) if inflow is None else ranks.join(inflow, ["host", "good"], "left").fillna(0.0, ["inflow"])
        rows = rows.select("cell", "good", "host", "start", "rank", "inflow")
        solved = stored(rows.groupBy("cell", "good").cogroup(inner.groupBy("cell", "good")).applyInArrow(solve, schema), "ranks")
        if closed or solved.where("grew").isEmpty():
            return solved.where("rank > 0").select("host", "good", "rank")
        ranks = solved.drop("grew")
        held = ranks.where("rank > 0").select(F.col("host").alias("from_host"), "good", "rank")
        moved = border.join(held, ["from_host", "good"]).select(F.col("to_host").alias("host"), "good", (F.col("rank") * F.col("part")).alias("rank"))
        inflow = moved.groupBy("host", "good").agg(F.sum("rank").alias("inflow"))


def _after_rounds(ways: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(host, good, rank) after a fixed number of rounds."""
    ranks = start
    for i in range(1, rounds + 1):
        held = ranks.select(F.col("host").alias("from_host"), "good", "rank")
        moved = ways.join(held, ["from_host", "good"]).select(F.col("to_host").alias("host"), "good", (F.col("rank") * F.col("part")).alias("rank"))
        ranks = moved.unionByName(start).groupBy("host", "good").agg(F.greatest(F.sum("rank"), F.lit(_LEAST)).alias("rank"))
        if i % _PIN_EVERY == 0 or i == rounds:
            ranks = pin(ranks)
    return ranks


def spread(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, tolerance: float = TOLERANCE, cell_edges: int = CELL_EDGES
) -> DataFrame:
    """(host, trust, distrust) from ``edges`` and ``seeds`` (host, trust, distrust), each summing to 1 or 0.

    Without ``rounds`` it goes on until no new host is reached and no exchange between cells adds to any
    rank more than ``tolerance`` of it.
    """
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    share = lambda c, of: F.lit(0.0) if not of else F.col(c) / F.lit(float(of))
    start = seeds.select("host", F.explode(F.array(
        F.struct(F.lit(True).alias("good"), share("trust", total["t"]).alias("rank")), F.struct(F.lit(False).alias("good"), share("distrust", total["d"]).alias("rank"))
    )).alias("x")).select("host", "x.good", "x.rank").where("rank > 0")
    start = pin(start.withColumn("rank", F.col("rank") * (1 - damping)))
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("_in"))
    along = edges.join(out, "src").select(F.col("src").alias("from_host"), F.col("dst").alias("to_host"), F.lit(True).alias("good"), (F.col("weight") / F.col("_out") * damping).alias("part"))
    against = edges.join(into, "dst").select(F.col("dst").alias("from_host"), F.col("src").alias("to_host"), F.lit(False).alias("good"), (F.col("weight") / F.col("_in") * damping).alias("part"))
    ways = pin(along.unionByName(against))
    ranks = _settled(ways, start, tolerance, cell_edges) if rounds is None else _after_rounds(ways, start, rounds)
    sums = ranks.groupBy().agg(F.sum(F.when(F.col("good"), F.col("rank"))).alias("t"), F.sum(F.when(~F.col("good"), F.col("rank"))).alias("d")).first()
    part = lambda good, of: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("rank"))), F.lit(0.0)) / F.lit(of or 1.0)
    return ranks.groupBy("host").agg(part(True, sums["t"]).alias("trust"), part(False, sums["d"]).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[UrlRule] = RULES, block_share: float = BLOCK_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of ``pages``."""
    split = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_ruled"))
    seeds = pin(ruled.where("_ruled is not null").groupBy("host").agg(
        F.count_if(F.col("_ruled") == "allow").alias("trust"), F.count_if(F.col("_ruled") == "block").alias("distrust")
    ))
    # digits are rounded, never the place after the point, so that the order of additions decides nothing and small ranks stay
    digits = lambda c: F.format_string("%.8e", c).cast("double").alias(c)
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    hosts = pin(spread(pin(host_edges(split)), seeds, rounds=None).select("host", (share > block_share).alias("_blocked"), digits("trust"), digits("distrust")))
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
