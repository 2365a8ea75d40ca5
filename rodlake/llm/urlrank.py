"""URL filtering by rules and by propagation over the host graph. DataFrame operations only.

Trust starts at hosts whose pages the rules allow and follows hyperlinks (personalised
PageRank). Distrust starts at hosts whose pages the rules block and goes against
hyperlinks, to those who link there. A host is blocked if distrust is more than
``share`` of what it holds of both; a host that neither reaches is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crowded, discard, salted, save, within

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract, (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; nulls if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """(src, dst, links): hyperlinks between different hosts, counted. Links without a host stay on their own and count for nothing."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    ends = pages.select(host.alias("src"), F.explode(found).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return ends.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


#: Links of one host that one task joins; hubs with more are dealt over several.
HUB = 200_000
#: Rounds beyond which propagation cannot settle: the change shrinks by the damping in each, so about 90 do at 0.85.
MOST = 1000


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from (src, dst, links) and seeds (host, trust, distrust).

    trust(h) = (1 - damping) seed + damping * what the linking hosts pass on, each in
    proportion to its links; distrust likewise along reversed edges. Stops when no
    total changes by more than ``tolerance``; raises if that never comes. ``rounds``: a
    caller's own limit, at which the state so far is returned. Each round is a table in the shared folder.
    """
    if not edges.limit(1).count():
        return seeds
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("into"))
    rated = edges.join(out, "src").join(into, "dst")
    rated = save(rated.select("src", "dst", (F.col("links") / F.col("out")).alias("down"), (F.col("links") / F.col("into")).alias("up")), "hosts-edges")
    now = save(seeds.select("host", "trust", "distrust"), "hosts")
    hubs, aims = (crowded(rated, c, HUB) for c in ("src", "dst"))
    for _ in range(MOST if rounds is None else rounds):
        from_ = salted(rated, now.where("trust > 0").select(F.col("host").alias("src"), "trust"), "src", hubs, F.col("dst"))
        down = from_.select(F.col("dst").alias("host"), (F.col("trust") * F.col("down")).alias("t"), F.lit(0.0).alias("d"))
        back = salted(rated, now.where("distrust > 0").select(F.col("host").alias("dst"), "distrust"), "dst", aims, F.col("src"))
        up = back.select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("up")).alias("d"))
        start = seeds.select("host", F.col("trust") * (1 - damping), F.col("distrust") * (1 - damping))
        moved = down.select("host", F.col("t") * damping, F.col("d") * damping).union(up.select("host", F.col("t") * damping, F.col("d") * damping))
        summed = start.union(moved).toDF("host", "t", "d").groupBy("host").agg(F.sum("t").alias("trust"), F.sum("d").alias("distrust"))
        new = save(summed, "hosts")
        far = new.join(now.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")), "host", "full")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        change = far.agg(F.sum(F.abs(zero("trust") - zero("t0")) + F.abs(zero("distrust") - zero("d0")))).first()[0] or 0.0
        discard(now)
        now = new
        if change <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError("standing of hosts did not settle")
    discard(rated)
    return now


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page: str = "page_id", url: str = "url", html: str = "html", share: float = 0.5) -> DataFrame:
    """page, host, path, rule, verdict, trust, distrust: one row for each row of ``pages``.

    host and path are empty if the url is null or has no ``://``. A rule fits its host
    and all subdomains if the path starts with the rule's; the longest wins and gives
    the verdict. Without a rule the host's standing does: block if distrust is more
    than ``share`` of trust plus distrust, else allow (so also for hosts that neither
    reaches, and for empty hosts); distrust of exactly ``share`` is allowed. Null and
    empty html has no links; whole pages are read, however long. Null and repeated ids
    keep their rows; further columns are ignored. Empty table: no rows.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    each = pages.select(F.col(page).alias("page"), host.alias("host"), path.alias("path"))
    each = save(each.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page", "host", "path", "r.rule", "r.verdict", F.monotonically_increasing_id().alias("row")), "url-pages")
    ruled = each.where("verdict is not null and host <> ''").groupBy("host").agg(F.sum(F.when(F.col("verdict") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("b"))
    ruled = save(ruled, "url-seeds")
    total = ruled.agg(F.sum(F.col("a") + F.col("b"))).first()[0] or 1
    seeds = ruled.select("host", (F.col("a") / F.lit(float(total))).alias("trust"), (F.col("b") / F.lit(float(total))).alias("distrust"))
    edges = save(host_links(pages, host, html), "url-links")
    standing = propagate(edges, seeds)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    if within(standing, 200_000):
        known = each.join(F.broadcast(standing), "host", "left")
    else:  # a host with many pages, or the empty one of all malformed urls, is dealt over several tasks
        known = salted(each, standing, "host", crowded(each, "host", HUB), F.col("row"), "left")
    method = F.when((distrust > 0) & (distrust > share * (trust + distrust)), F.lit("block")).otherwise(F.lit("allow"))
    return known.select(F.col("page").alias(page), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
