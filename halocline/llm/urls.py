"""URL filters (operator 9): rules first, then a path-template tree per host; DataFrame operations only.

Path segments that hold digits become a shape (digits to '#').  Pages fold into distinct (host, shapes) with counts, so
the tree is built on few rows and a hot host costs no more than others.  From the top down, to the end of the longest
path: a child is a wildcard if its parent has many children and it's rare among them; and children of enough pages whose
spread over next shapes is statistically like their parent's pool, and whose labels agree, are merged into one branch.
Labelled pages (those that a rule decides, or a table of labels) give every template a smoothed purity: its share of bad
pages shrunk to that of the host's other templates, that to the global one.  Templates with enough labelled pages of
their own and a high share of bad ones are rejected, with the pages no rule decides.

Defined results: a null url, or one without '://', has empty host and path; without labels nothing is rejected; paths
of any length are read to their end; a null page_id takes no label; repeated rows count and are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, written

#: Rules (verdict, host and path), fixed values of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A parent with so many children turns those with less than RARE of its pages into wildcards.
MANY, RARE = 12, 0.05
#: Branches of so many pages are merged if their spreads over next segments differ from their parent's by no more than
#: NEAR and what chance gives, about SLACK over the root of their pages.
LEAST, NEAR, SLACK = 20, 0.1, 0.5
#: Weight of the level above in a smoothed share; labelled pages and share of bad ones from which a template is rejected.
PRIOR, LABELLED, REJECT_AT = 4.0, 5, 0.8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """All segments of the path, digits as '#'."""
    return F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def judged(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.  labels(page_id, bad) adds labelled pages to those that rules decide."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": name, "ruled": verdict, "shape": shape_of(F.col("path"))})
    bad = F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))
    if labels is not None:
        given = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("given"))
        rows = rows.join(given, "page_id", "left").withColumn("bad", F.coalesce(bad, "given"))
    else:
        rows = rows.withColumn("bad", bad)
    rows = written(rows, "urls")
    leaves = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rejected = purity(templates(leaves)).where(rejects()).select("host", "shape", F.lit("block").alias("found"))
    out = rows.join(rejected, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit("allow")).alias("verdict"))


def templates(leaves: DataFrame) -> DataFrame:
    """leaves(host, shape, n, known, bad) with t, their template: '=' before a segment that stays, '*' and '+' as names.

    A level a round, until no leaf goes deeper or shares its template with another: a leaf alone can't be generalised.
    """
    keys = ["host", "shape", "n", "known", "bad", "t"]
    alive = leaves.withColumn("t", F.lit(""))
    done, d = alive.where(F.size("shape") == 0), 0
    alive = written(alive.where(F.size("shape") > 0), "tree")
    while not alive.isEmpty():
        rows = alive.withColumns({"seg": F.get("shape", F.lit(d)), "nxt": F.coalesce(F.get("shape", F.lit(d + 1)), F.lit(""))})
        spread = rows.groupBy("host", "t", "seg", "nxt").agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")], F.count(F.lit(1)).alias("leaves"))
        child = spread.groupBy("host", "t", "seg").agg(F.sum("n").alias("cn"), F.sum("known").alias("ck"), F.sum("bad").alias("cb"), F.sum("leaves").alias("leaves"))
        parent = child.groupBy("host", "t").agg(F.sum("cn").alias("pn"), F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("all"))
        child = child.join(parent, ["host", "t"])
        # the distance of two spreads is the sum of what one has more than the other
        pooled = spread.groupBy("host", "t", "nxt").agg(F.sum("n").alias("m"))
        far = spread.select("host", "t", "seg", "nxt", "n").join(pooled, ["host", "t", "nxt"]).join(child.select("host", "t", "seg", "cn", "pn"), ["host", "t", "seg"])
        far = far.groupBy("host", "t", "seg").agg(F.sum(F.greatest(F.col("n") / F.col("cn") - F.col("m") / F.col("pn"), F.lit(0.0))).alias("gap"))
        named = child.join(far, ["host", "t", "seg"]).select("host", "t", "seg", name_of().alias("name"), (F.col("all") == 1).alias("alone"))
        rest = F.concat_ws("/=", "name", F.slice("shape", d + 2, F.size("shape")))
        new = rows.join(named, ["host", "t", "seg"]).withColumn("t", F.concat("t", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("name"))))
        new = written(new.select(*keys, (F.col("alone") | (F.size("shape") <= d + 1)).alias("ended")), "tree")
        done, alive, d = done.unionByName(new.where("ended").drop("ended")), new.where("not ended").drop("ended"), d + 1
    return done


def name_of() -> Column:
    """The name of a child of a template: wildcard, merged branch or itself.

    Only branches with LEAST pages are merged, and only with those whose labelled pages say the same; branches without
    labelled pages are merged among themselves, so that no label counts for a branch it wasn't given in.
    """
    wild = (F.col("kids") >= MANY) & (F.col("cn") < RARE * F.col("pn"))
    like = (F.col("kids") > 1) & (F.col("cn") >= LEAST) & (F.col("gap") <= NEAR + SLACK / F.sqrt("cn"))
    said = F.when(F.col("ck") == 0, "+").when(2 * F.col("cb") >= F.col("ck"), "+bad").otherwise("+good")
    return F.when(wild, "*").when(like, said).otherwise(F.concat(F.lit("="), "seg"))


def purity(tree: DataFrame) -> DataFrame:
    """tree's leaves with k, the labelled pages of their template, and share, the smoothed share of bad ones among them.

    The share is drawn to that of the host's other templates, and this to that of all hosts.
    """
    total = tree.agg((F.sum("bad") / F.sum("known")).alias("top"))
    own = tree.groupBy("host", "t").agg(F.sum("known").alias("k"), F.sum("bad").alias("b"))
    hosts = own.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("b").alias("hb"))
    both = own.where("k > 0").join(hosts, "host").join(F.broadcast(total))  # one row
    up = (F.col("hb") - F.col("b") + PRIOR * F.coalesce("top", F.lit(0.0))) / (F.col("hk") - F.col("k") + PRIOR)
    share = (F.col("b") + PRIOR * up) / (F.col("k") + PRIOR)
    return tree.join(both.select("host", "t", "k", share.alias("share")), ["host", "t"])


def rejects() -> Column:
    """A template is rejected on labelled pages of its own only, by their number and their share of bad ones."""
    return (F.col("k") >= LABELLED) & (F.col("share") >= REJECT_AT)
