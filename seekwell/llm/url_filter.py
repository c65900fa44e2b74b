"""URL filter by rules and by link-graph propagation, with DataFrame functions only.

Rules of the form host + path prefix settle the urls they fit; the longest wins. They
also give the seeds: a host's trusted (blocked) weight is the share of its settled
pages that are allowed (blocked).

Trust is personalised PageRank from the trusted seeds along host links, as a share of
the host's PageRank from all hosts alike: how much of its rank comes from hosts that are
trusted. Distrust goes from the blocked seeds against the links; a host takes it from
each host that it links to by the share of its own links that go there, damped at each
hop. A settled host keeps its own weight. So neither depends on the size of the graph, on
how many seeds there are or on how many others link to the same host, and one link among
many weighs little. A page without a rule is blocked if its host's distrust is more than
`threshold` and more than its trust.

Links are counted per pair of hosts before anything is joined, so work per round
follows host pairs. A hub is split by the skew join, as ranks are joined before they
are summed by the other end. Each round is written to the shared folder.

A null url, or one without `://`, has an empty host and path: no rule fits it and it
is not a node; its verdict is `allow`. Null html has no links. Repeated pages count
repeatedly as seeds and links; every row is judged. An empty table gives an empty
result; extra columns are not read. Ties between equally long rules go to the later
rule in the list."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
_LINK = r"""(?i)\bhref\s*+=\s*+["']?((?:[a-z][a-z0-9+.-]*+:)?//[^"'\s>]++)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 20
    tolerance: float = 1e-6
    threshold: float = 0.6


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, allow) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allow"))
        out = F.when(fits, value).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(page_id, host, path, rule, allow); the last two null where no rule fits."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", "found.rule", "found.allow")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts."""
    target = F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("target")
    rows = pages.select(host_of(F.col("url")).alias("src"), target)
    whole = F.when(F.col("target").startswith("//"), F.concat(F.lit("x:"), "target")).otherwise(F.col("target"))
    rows = rows.select("src", host_of(whole).alias("dst"))
    return rows.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(
        F.count("*").alias("links")
    )


def _settled_down(
    nodes: DataFrame, edges: DataFrame, ends: tuple[str, str], masses: dict, settings: Propagation
) -> DataFrame:
    """`nodes` with a column for each of `masses`: functions that give a host's mass from
    what flows to it. Each round, masses go along `edges` (src, dst, share) from the first
    of `ends` to the second, `share` of them on each."""
    start = {m: new(F.lit(0.0)).alias(m) for m, new in masses.items()}
    now = nodes.select("*", *start.values())
    for _ in range(settings.rounds):
        sent = edges.join(now.select(F.col("host").alias(ends[0]), *masses), ends[0])
        flow = sent.groupBy(F.col(ends[1]).alias("host")).agg(
            *[F.sum(F.col(m) * F.col("share")).alias(f"{m}_in") for m in masses]
        )
        after = now.join(flow, "host", "left").select(
            *nodes.columns, *[F.col(m).alias(f"{m}_was") for m in masses],
            *[new(F.coalesce(f"{m}_in", F.lit(0.0))).alias(m) for m, new in masses.items()],
        )
        after = materialize(after, "url-round")
        moved = F.greatest(F.lit(0.0), *[F.abs(F.col(m) - F.col(f"{m}_was")) for m in masses])
        change = after.agg(F.max(moved)).first()[0] or 0.0
        now = after.select(*nodes.columns, *masses)
        if change < settings.tolerance:
            break
    return now


def host_scores(pages: DataFrame, judged: DataFrame, settings: Propagation) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that has a page or a link; trust
    and distrust are from 0 to 1."""
    links = materialize(host_links(pages), "url-links")
    count = lambda value: F.count(F.when(value, 1))
    seeds = judged.filter("host <> ''").groupBy("host").agg(
        count(F.col("allow")).alias("good"), count(~F.col("allow")).alias("bad")
    )
    ends = links.select(F.col("src").alias("host")).union(links.select(F.col("dst").alias("host"))).distinct()
    settled = F.coalesce(F.col("good") + F.col("bad") > 0, F.lit(False))
    share = lambda c: F.when(settled, F.col(c) / (F.col("good") + F.col("bad"))).otherwise(0.0).alias(c)
    nodes = materialize(
        ends.join(seeds, "host", "full").select("host", share("good"), share("bad"), settled.alias("settled")),
        "url-seeds",
    )
    out = links.groupBy("src").agg(F.sum("links").alias("out"))
    edges = materialize(
        links.join(out, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")), "url-edges"
    )
    d = settings.damping
    ranked = _settled_down(nodes, edges, ("src", "dst"), {
        "mass": lambda flow: F.lit(1 - d) * F.col("good") + F.lit(d) * flow,
        "rank": lambda flow: F.lit(1 - d) + F.lit(d) * flow,
    }, settings)
    both = _settled_down(ranked, edges, ("dst", "src"), {
        "distrust": lambda flow: F.when(F.col("settled"), F.col("bad")).otherwise(F.lit(d) * flow),
    }, settings)
    trust, distrust = F.col("mass") / F.col("rank"), F.col("distrust")
    blocked = (distrust > settings.threshold) & (distrust > trust)
    return both.select("host", trust.alias("trust"), "distrust", blocked.alias("blocked"))


def judged(
    pages: DataFrame, rules: tuple[Rule, ...], settings: Propagation = Propagation()
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    by_rule = judged_by_rules(pages, rules)
    scores = materialize(host_scores(pages, by_rule, settings), "url-hosts")
    rows = by_rule.join(scores, "host", "left")
    allowed = F.coalesce("allow", ~F.col("blocked"), F.lit(True))
    return rows.select(
        "page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
