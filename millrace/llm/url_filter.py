"""URL filter by a path-template tree, all in DataFrame functions.

A URL is cut into host and path. Explicit rules come first. What no rule covers is
judged by a tree of path templates, one tree for each host, as deep as its paths (the SQL
has two levels, as many as the given tables' paths have):

1. segments are generalised: digits become a wildcard at once, and of the other
   segments under one node only those with enough rows stay constants, whatever their
   share of the node's rows; the rest becomes the wildcard `*`;
2. branches of one node are merged with each other where they are similar: in the order of their labelled
   share of bad pages, in steps of 5 %, neighbours that don't differ significantly (two-proportion z test) are one
   cluster, and a branch takes its cluster's pooled labels. If there is one cluster only, or a branch
   has no labels, it takes what its node has;
3. a template is rejected if its labelled purity, smoothed towards its host's (which is
   smoothed towards the corpus'), reaches `reject_at`.

Labels are rows with bad = 1 or 0. The query uses the rows that the rules decide, as no table labels URLs. So its
labels reach the hosts that a rule covers in part; templates of a host without a rule have only the corpus' share of
blocked rows, which is below the bound, and are allowed.
Everything is grouped with partial sums, so a host with a third of all rows sends
one row per task and template; the join back is a plain left join on the template key,
which Spark splits where one key is hot.

Nulls: a null URL or one without `://` has empty host and path, and is judged like any
other template. Repeated rows give repeated results. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table

SHARES = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and all paths that start with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    min_rows: int = 3  # a constant segment has at least so many rows, however many its node has
    min_share: float = 0.02  # of the SQL alone, which also asks for this share of the node's rows; no segment of the given tables has less
    z2: float = 3.84  # square of z beyond which two shares differ (5 %)
    smoothing: float = 4.0  # pseudo-count of the prior
    reject_at: float = 0.8


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def key_of(path: Column) -> Column:
    """The path's segments joined by `/`, at least two of them (empty where there are none).

    Digits only (and an extension) are a wildcard; slashes at the end count for nothing.
    """
    parts = F.split(F.regexp_replace(path, r"/+\z", ""), "/")
    parts = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.when(p.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), F.lit("*")).otherwise(p))
    return F.concat_ws("/", F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(2) - F.size(parts)))))


def _similar(n1: Column, b1: Column, n2: Column, b2: Column, z2: float) -> Column:
    """No significant difference between the shares b1/n1 and b2/n2; few or no labels count as none."""
    p = (b1 + b2) / F.nullif(n1 + n2, F.lit(0))
    gap = b1 / F.nullif(n1, F.lit(0)) - b2 / F.nullif(n2, F.lit(0))
    spread = p * (1 - p) * (1.0 / F.nullif(n1, F.lit(0)) + 1.0 / F.nullif(n2, F.lit(0)))
    return F.coalesce(gap * gap < z2 * spread, F.lit(True)) | (p * (1 - p) == 0)


def _clusters(branch: DataFrame, s: TreeSettings) -> DataFrame:
    """host, node, share -> labels of the share's cluster (cl, cb), for nodes with several clusters. A node has SHARES + 1 shares at most, so no window is large."""
    shares = branch.where("share IS NOT NULL").groupBy("host", "node", "share").agg(F.sum("nl").alias("sl"), F.sum("nb").alias("sb"))
    node = Window.partitionBy("host", "node")
    along = node.orderBy("share")
    similar = _similar(F.col("sl"), F.col("sb"), F.lag("sl").over(along), F.lag("sb").over(along), s.z2)
    shares = shares.withColumn("apart", F.when(F.lag("sl").over(along).isNull() | similar, 0).otherwise(1)).withColumn("cluster", F.sum("apart").over(along))
    cluster = Window.partitionBy("host", "node", "cluster")
    out = shares.select("host", "node", "share", F.sum("sl").over(cluster).alias("cl"), F.sum("sb").over(cluster).alias("cb"), F.max("cluster").over(node).alias("last"))
    return out.where("last > 0").drop("last")


def _grown(live: DataFrame, nodes: DataFrame, level: int, s: TreeSettings) -> tuple[DataFrame, DataFrame]:
    """One more level: live with the nodes of that level, and those nodes with the labels that they are judged by."""
    raw = live.withColumn("raw", F.coalesce(F.get(F.split("key", "/"), level - 1), F.lit("")))
    child = raw.groupBy("host", "node", "raw").agg(F.sum("n").alias("child_n"), F.sum("labelled").alias("nl"), F.sum("bad").alias("nb"))
    child = child.withColumn("step", F.when((F.col("raw") != "*") & (F.col("child_n") >= s.min_rows), F.col("raw")).otherwise(F.lit("*")))
    below = F.concat_ws("/", "node", "step")
    branch = child.groupBy("host", "node", "step").agg(F.sum("nl").alias("nl"), F.sum("nb").alias("nb")).withColumn("share", F.expr(f"CASE WHEN nl > 0 THEN {SHARES} * nb div nl END"))
    grown = branch.join(nodes, ["host", "node"]).join(_clusters(branch, s), ["host", "node", "share"], "left").select(
        "host", below.alias("node"), F.col("nl").alias("l"), F.col("nb").alias("b"), "l0", "b0", F.coalesce("cl", "ml").alias("ml"), F.coalesce("cb", "mb").alias("mb")
    )
    steps = child.select("host", "node", "raw", "step")
    return raw.join(steps, ["host", "node", "raw"]).select("host", "key", "n", "labelled", "bad", below.alias("node")), grown


def template_verdicts(parsed: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """host, key -> template, purity, rejected. parsed: host, key (of key_of), bad (1, 0 or null).

    The first two levels are there for all; below, a node goes on while its paths do and can differ: one path alone, or
    fewer rows than a constant needs, give one branch with the node's own labels.
    """
    s = settings
    live = cut(
        parsed.groupBy("host", "key").agg(
            F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
        ),
        "urls",
    )
    segments = F.size(F.split("key", "/"))
    total = live.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.max(segments).alias("depth")).first()
    prior = total["b"] / total["n"] if total["n"] else 0.0

    def judged(done: DataFrame, nodes: DataFrame) -> DataFrame:
        at_host = (F.col("b0") + s.smoothing * F.lit(prior)) / (F.col("l0") + s.smoothing)
        verdicts = nodes.withColumn("purity", (F.col("mb") + s.smoothing * at_host) / (F.col("ml") + s.smoothing)).select("host", "node", "purity", (F.col("purity") >= s.reject_at).alias("rejected"))
        return done.join(verdicts, ["host", "node"]).select("host", "key", "template", "purity", "rejected")

    sums = F.sum("labelled"), F.sum("bad")
    nodes = live.groupBy("host").agg(*[x.alias(c) for x, c in zip(sums * 3, ("l", "b", "ml", "mb", "l0", "b0"), strict=True)]).withColumn("node", F.col("host"))
    live = live.withColumn("node", F.col("host"))
    for level in (1, 2):
        live, nodes = _grown(live, nodes, level, s)
    if (total["depth"] or 0) <= 2:
        return judged(live.withColumn("template", F.col("node")), nodes)
    found, level = [], 3
    while True:
        nodes = cut(nodes, "url-nodes")
        live = cut(live, "url-paths")
        stats = live.groupBy("host", "node").agg(F.max(segments).alias("deep"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("paths"))
        live = cut(live.join(stats, ["host", "node"]), "url-branches")
        goes_on = (F.col("deep") >= level) & (F.col("rows") >= s.min_rows) & (F.col("paths") > 1)
        rest = F.concat_ws("/", F.slice(F.split("key", "/"), level, F.greatest(F.lit(0), segments - (level - 1))))
        template = F.when(F.col("deep") < level, F.col("node")).otherwise(F.concat_ws("/", "node", F.when(F.col("rows") >= s.min_rows, rest).otherwise(F.lit("*"))))
        found.append(judged(live.where(~goes_on).withColumn("template", template), nodes))
        live = live.where(goes_on).select("host", "key", "n", "labelled", "bad", "node")
        if live.isEmpty():
            break
        live, nodes = _grown(live, nodes, level, s)
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def filter_urls(pages: DataFrame, url: str, rules: tuple[Rule, ...], label: str | None = None, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """The columns of pages with url_host, url_path, url_rule, url_verdict, url_template, url_purity.

    Columns of pages that have such a name already are replaced. label: a column of pages with 1 (bad), 0 (good) or null; without one, the rules label.
    """
    added = ("url_host", "url_path", "url_rule", "url_said", "url_key", "url_verdict", "url_template", "url_purity", "url_rejected")
    own = [c for c in pages.columns if c not in added]
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    rows = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("url_host"), path.alias("url_path"))
    text, verdict = rule_of(F.col("url_host"), F.col("url_path"), rules)
    rows = rows.withColumns({"url_rule": text, "url_said": verdict, "url_key": key_of(F.col("url_path"))})
    bad = F.when(F.col("url_said") == "block", 1).when(F.col("url_said") == "allow", 0) if label is None else F.col(f"`{label}`")
    judged = template_verdicts(rows.select(F.col("url_host").alias("host"), F.col("url_key").alias("key"), bad.alias("bad")), settings)
    judged = judged.select(F.col("host").alias("url_host"), F.col("key").alias("url_key"), F.col("template").alias("url_template"), F.col("purity").alias("url_purity"), F.col("rejected").alias("url_rejected"))
    judge = F.when(F.col("url_rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(judged, ["url_host", "url_key"], "left").select(
        *[F.col(f"`{c}`") for c in own],
        "url_host",
        "url_path",
        "url_rule",
        F.coalesce(F.col("url_said"), judge).alias("url_verdict"),
        "url_template",
        "url_purity",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, "url", RULES).select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
        F.col("url_template").alias("template"),
    )


def _rules_sql(what: str) -> str:
    longest = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in longest) + " END"


def _similar_sql(n1: str, b1: str, n2: str, b2: str) -> str:
    p, z2 = f"(({b1}) + ({b2})) / nullif(({n1}) + ({n2}), 0)", TreeSettings.z2
    gap = f"(({b1}) / nullif({n1}, 0) - ({b2}) / nullif({n2}, 0))"
    spread = f"({p}) * (1 - ({p})) * (1.0::double / nullif({n1}, 0) + 1.0::double / nullif({n2}, 0))"
    return f"(coalesce({gap} * {gap} < {z2}::double * ({spread}), true) OR coalesce(({p}) * (1 - ({p})) = 0, false))"


def _clusters_sql(nodes: str, by: str, n: str, b: str) -> str:
    return f"""
    SELECT {by}, share, sum(sl) OVER (PARTITION BY {by}, cluster) AS cl, sum(sb) OVER (PARTITION BY {by}, cluster) AS cb FROM (
      SELECT *, sum(apart) OVER (PARTITION BY {by} ORDER BY share) AS cluster FROM (
        SELECT *, CASE WHEN pl IS NULL OR {_similar_sql("sl", "sb", "pl", "pb")} THEN 0 ELSE 1 END AS apart FROM (
          SELECT *, lag(sl) OVER (PARTITION BY {by} ORDER BY share) AS pl, lag(sb) OVER (PARTITION BY {by} ORDER BY share) AS pb FROM (
            SELECT {by}, {SHARES} * {b} // {n} AS share, sum({n}) AS sl, sum({b}) AS sb FROM {nodes} WHERE {n} > 0 GROUP BY ALL))))
    QUALIFY max(cluster) OVER (PARTITION BY {by}) > 0"""


OP4_SQL = f"""
WITH raw AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM raw),
parts AS (
  SELECT *, coalesce(string_split(path, '/')[2], '') AS p1, coalesce(string_split(path, '/')[3], '') AS p2,
         {_rules_sql("text")} AS rule, {_rules_sql("verdict")} AS said FROM parsed),
rows_ AS (
  SELECT *, CASE WHEN regexp_full_match(p1, '[0-9]+(\\.[A-Za-z0-9]+)?') THEN '*' ELSE p1 END AS s1,
         CASE WHEN regexp_full_match(p2, '[0-9]+(\\.[A-Za-z0-9]+)?') THEN '*' ELSE p2 END AS s2,
         CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad FROM parts),
counts AS (
  SELECT host, s1, s2, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM rows_ GROUP BY ALL),
total AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad)::double / sum(labelled) ELSE 0.0::double END AS prior FROM counts),
c1 AS (
  SELECT host, s1 FROM (SELECT host, s1, sum(n) AS child_n FROM counts GROUP BY ALL) JOIN (SELECT host, sum(n) AS node_n FROM counts GROUP BY ALL) USING (host)
  WHERE s1 <> '*' AND child_n >= {TreeSettings.min_rows} AND child_n >= {TreeSettings.min_share}::double * node_n),
l1 AS (SELECT counts.*, CASE WHEN c1.s1 IS NULL THEN '*' ELSE counts.s1 END AS t1 FROM counts LEFT JOIN c1 ON counts.host = c1.host AND counts.s1 = c1.s1),
c2 AS (
  SELECT host, t1, s2 FROM (SELECT host, t1, s2, sum(n) AS child_n FROM l1 GROUP BY ALL) JOIN (SELECT host, t1, sum(n) AS node_n FROM l1 GROUP BY ALL) USING (host, t1)
  WHERE s2 <> '*' AND child_n >= {TreeSettings.min_rows} AND child_n >= {TreeSettings.min_share}::double * node_n),
tree AS (SELECT l1.*, CASE WHEN c2.s2 IS NULL THEN '*' ELSE l1.s2 END AS t2 FROM l1 LEFT JOIN c2 ON l1.host = c2.host AND l1.t1 = c2.t1 AND l1.s2 = c2.s2),
nodes1 AS (SELECT host, t1, sum(labelled) AS n1, sum(bad) AS b1 FROM tree GROUP BY ALL),
nodes2 AS (SELECT host, t1, t2, sum(labelled) AS n2, sum(bad) AS b2 FROM tree GROUP BY ALL),
nodes0 AS (SELECT host, sum(labelled) AS n0, sum(bad) AS b0 FROM tree GROUP BY ALL),
merged AS (
  SELECT nodes1.*, n0, b0, CASE WHEN n1 > 0 THEN {SHARES} * b1 // n1 END AS share, coalesce(cl, n0) AS m1n, coalesce(cb, b0) AS m1b
  FROM nodes1 JOIN nodes0 USING (host) LEFT JOIN ({_clusters_sql("nodes1", "host", "n1", "b1")}) c ON c.host = nodes1.host AND c.share = CASE WHEN n1 > 0 THEN {SHARES} * b1 // n1 END),
pooled AS (
  SELECT nodes2.host, nodes2.t1, t2, n0, b0, coalesce(cl, m1n) AS mn, coalesce(cb, m1b) AS mb
  FROM nodes2 JOIN merged ON merged.host = nodes2.host AND merged.t1 = nodes2.t1
  LEFT JOIN ({_clusters_sql("nodes2", "host, t1", "n2", "b2")}) c ON c.host = nodes2.host AND c.t1 = nodes2.t1 AND c.share = CASE WHEN n2 > 0 THEN {SHARES} * b2 // n2 END),
judged AS (
  SELECT host, t1, t2, (mb + {TreeSettings.smoothing}::double * ((b0 + {TreeSettings.smoothing}::double * prior) / (n0 + {TreeSettings.smoothing}::double))) / (mn + {TreeSettings.smoothing}::double) AS purity
  FROM pooled, total)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN purity >= {TreeSettings.reject_at}::double THEN 'block' ELSE 'allow' END) AS verdict,
       concat_ws('/', r.host, t.t1, t.t2) AS template
FROM rows_ r JOIN tree t ON r.host = t.host AND r.s1 = t.s1 AND r.s2 = t.s2 JOIN judged j ON t.host = j.host AND t.t1 = j.t1 AND t.t2 = j.t2
"""
