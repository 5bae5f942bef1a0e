"""URL filter: rules first, then path templates with labelled purity.

Each host has a tree of path templates.  Variable segments become typed
wildcards (numbers, dates, UUIDs, hex digests, random ids, with or without a file
ending).  The tree is then generalised level by level: under a template the
branches with enough labels are lined up by their share of bad ones, and
neighbours that a two-proportion z-test does not tell apart merge into one
wildcard; a branch that stays alone keeps its name, and branches with too few
labels share the wildcard ``*``.  A template is rejected by its smoothed purity,
the share of bad among its labelled urls drawn to the overall share.  A url whose
own host says nothing about its template is judged by the tree of all hosts
together; without evidence there, it is let through.  Work is done on distinct
shapes with counts, not on urls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.runtime import materialise


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


# The rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Labels that a branch needs to be told from others, and the z-score by which groups of branches have to differ.
MIN_LABELS, MIN_Z = 3, 1.96
#: Branches are first grouped by their share of bad labels, in so many steps, so that a template with very many of them stays small.
STEPS = 20
#: Labels that the overall share counts as, and the purity from which a template is rejected.
PRIOR_LABELS, REJECT = 5.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\x1f"
#: The tree of all hosts together; those of hosts begin with "=".
SHARED = "*"

# Types of variable segments, tried in this order on a segment without its file ending.
TYPES = (
    ("{uuid}", r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    ("{date}", r"(?:19|20)[0-9]{2}[-_.]?[01][0-9][-_.]?[0-3][0-9]"),
    ("{n}", r"[0-9]+"),
    ("{hex}", r"(?=[^/]*[0-9])(?:[0-9a-f]{8,}|[0-9A-F]{8,})"),
    ("{id}", r"(?=[^/]*[0-9])(?=[^/]*[A-Z])(?=[^/]*[a-z])[0-9A-Za-z_-]{11,}"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty without a url or ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host`` + ``path``, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments joined by a separator: variable ones as their type, other digits as ``{n}``."""
    out = F.replace(path, F.lit("*"), F.lit("%2A"))
    for name, pattern in TYPES:
        # a file ending goes with a variable name
        out = F.regexp_replace(out, rf"(?<=/){pattern}(?:\.[A-Za-z][0-9A-Za-z]{{0,4}})?(?=/|$)", name.replace("{", "\\{"))
    return F.translate(F.regexp_replace(out, "[0-9]+", "{n}"), "/", _END)


def _differ(a: Column, b: Column) -> Column:
    """Whether two groups (n labels, b bad) differ in their share of bad ones."""
    pooled = (a["b"] + b["b"]) / (a["n"] + b["n"])
    error = F.sqrt(pooled * (1 - pooled) * (1 / a["n"] + 1 / b["n"]))
    return (pooled > 0) & (pooled < 1) & (F.abs(a["b"] / a["n"] - b["b"] / b["n"]) > MIN_Z * error)


def _groups(branches: DataFrame) -> DataFrame:
    """(tree, template, step, group, alone, groups): the group of every step of shares under a template."""
    steps = branches.groupBy("tree", "template", "step").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("k"))
    line = steps.groupBy("tree", "template").agg(F.sort_array(F.collect_list(F.struct("step", "n", "b", "k"))).alias("line"))  # STEPS + 1 at most
    start = F.expr("struct(0L as n, 0L as b, 0 as g, cast(array() as array<struct<step:int,g:int,k:bigint>>) as out)")

    def join(s: Column, x: Column) -> Column:
        new = (s["n"] > 0) & _differ(s, x)
        g = F.when(new, s["g"] + 1).otherwise(s["g"])
        return F.struct(F.when(new, x["n"]).otherwise(s["n"] + x["n"]).alias("n"), F.when(new, x["b"]).otherwise(s["b"] + x["b"]).alias("b"), g.alias("g"), F.concat(s["out"], F.array(F.struct(x["step"].alias("step"), g.alias("g"), x["k"].alias("k")))).alias("out"))

    placed = line.select("tree", "template", F.aggregate("line", start, join, lambda s: s["out"]).alias("out"))
    one = placed.select("tree", "template", "out", F.explode("out").alias("x"))
    size = F.aggregate(F.filter("out", lambda y: y["g"] == F.col("x.g")), F.lit(0).cast("bigint"), lambda s, y: s + y["k"])
    return one.select("tree", "template", F.col("x.step").alias("step"), F.col("x.g").alias("g"), (size == 1).alias("alone"), (F.element_at("out", -1)["g"] + 1).alias("groups"))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (tree, shape, labelled, bad, and others) with ``template``; each (tree, shape) is one row.

    A round looks at the next segment in which the shapes of a template differ:
    segments that all of them share are taken at once, so that there are as many
    rounds as branchings above one another, however deep the paths are.  A round
    writes two tables.  A template leaves the loop as soon as nothing below it
    can be told apart: it has one shape, or under MIN_LABELS labels.
    """
    columns = [*shapes.columns, "template"]
    rows = materialise(shapes.withColumn("rest", F.filter(F.split("shape", _END), lambda x: x != "")).withColumn("template", F.lit("")), "url-shapes", compact=True)
    done = None
    while True:
        # what is left below a template that needs no further look: the names, or wildcards
        whole = rows.groupBy("tree", "template").agg(F.count("*").alias("shapes"), F.sum("labelled").alias("of"), F.max(F.size("rest")).alias("deep"), F.min("rest").alias("least"), F.max("rest").alias("most"))
        # what the least and the largest have in common, all have
        differs = F.array_position(F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        whole = whole.select("tree", "template", "shapes", "of", "deep", F.when(differs > 0, differs.cast("int") - 1).otherwise(F.least(F.size("least"), F.size("most"))).alias("shared"))
        looked = rows.join(whole, ["tree", "template"])
        few = F.col("of") < MIN_LABELS
        closed = few | (F.col("shapes") == 1) | (F.col("deep") == 0)
        below = F.when(few, F.transform("rest", lambda x: F.lit("*"))).otherwise(F.col("rest"))
        steps = F.when(closed, below).otherwise(F.slice("rest", F.lit(1), F.col("shared")))
        longer = F.concat(F.col("template"), F.array_join(F.transform(steps, lambda x: F.concat(F.lit("/"), x)), ""))
        left = F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest"), F.lit(1)))
        looked = looked.withColumns({"closed": closed, "longer": longer, "left": left}).drop("template", "rest").withColumnsRenamed({"longer": "template", "left": "rest"})
        looked = materialise(looked.select(*rows.columns, "closed"), "url-shapes", compact=True)
        part = looked.where("closed").select(columns)
        done = part if done is None else done.unionByName(part)
        rows = looked.where("not closed").drop("closed")
        if rows.isEmpty():
            return done
        live = rows.where(F.size("rest") > 0).withColumn("branch", F.col("rest")[0])
        branches = live.groupBy("tree", "template", "branch").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).withColumn("step", F.floor(F.col("b") * STEPS / F.greatest(F.col("n"), F.lit(1))).cast("int"))
        told = F.col("n") >= MIN_LABELS
        groups = _groups(branches.where(told))
        name = F.when(F.col("alone"), F.col("branch")).when(F.col("groups") == 1, "*").otherwise(F.concat(F.lit("*"), (F.col("g") + 1).cast("string")))
        named = branches.withColumn("step", F.when(told, F.col("step"))).join(groups, ["tree", "template", "step"], "left").select("tree", "template", "branch", F.coalesce(name, F.lit("*")).alias("kept"))
        moved = live.join(named, ["tree", "template", "branch"]).withColumn("template", F.concat("template", F.lit("/"), "kept")).withColumn("rest", F.slice("rest", F.lit(2), F.size("rest"))).select(rows.columns)
        ended = rows.where(F.size("rest") == 0)
        done = done.unionByName(ended.select(columns))
        rows = materialise(moved, "url-shapes", compact=True)


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", bad_col: str | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity, basis.

    A fitting rule decides (``basis`` rule); otherwise the template of the url
    does: ``block`` if its purity is at least REJECT, else ``allow``.  The overall
    share alone rejects nothing: the template needs a bad label, and MIN_LABELS
    labels where the url's own shape has none (``basis`` host).  Where the host's
    template has no label at all, the url's template in the tree of all hosts
    decides in the same way, if it has MIN_LABELS labels from two hosts or more
    (``basis`` shared); else nothing is known (``basis`` none).  ``template`` and
    ``purity`` are those that decide, else the host's.  Labels are the column ``bad_col`` (1 bad, 0 good,
    null unknown) or else the rules' own verdicts.  Null urls and those without
    ``://`` have empty hosts and paths and form a tree of their own.  Urls of any
    length and depth are read whole.  Repeated rows give repeated results,
    further columns are ignored, an empty table gives an empty one.
    """
    host, path = host_and_path(df[url_col])
    label = df[bad_col].cast("int") if bad_col else F.lit(None).cast("int")
    rows = df.select(df[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"), label.alias("bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    if not bad_col:
        rows = rows.withColumn("bad", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0))
    rows = rows.withColumn("shape", shape(F.col("path")))
    own = rows.groupBy("host", "shape").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    own = materialise(own, "url-shapes", compact=True)
    labelled_host = F.when(F.col("labelled") > 0, F.col("host"))
    shared = own.groupBy("shape").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min(labelled_host).alias("low"), F.max(labelled_host).alias("high"))
    trees = own.select(F.concat(F.lit("="), "host").alias("tree"), "shape", "labelled", "bad", F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high")).unionByName(shared.withColumn("tree", F.lit(SHARED)))
    placed = materialise(templates(trees), "url-templates", compact=True)
    share = own.agg(F.sum("bad") / F.sum("labelled")).first()[0] if own.agg(F.sum("labelled")).first()[0] else 0.0
    purity = placed.groupBy("tree", "template").agg(((F.sum("bad") + PRIOR_LABELS * share) / (F.sum("labelled") + PRIOR_LABELS)).alias("purity"), F.sum("labelled").alias("template_labelled"), F.sum("bad").alias("template_bad"), (F.min("low") < F.max("high")).alias("hosts"))
    judged = placed.join(purity, ["tree", "template"])
    # a few labels of one branch do not condemn the unlabelled branches that it was merged with
    enough = (F.col("labelled") > 0) | (F.col("template_labelled") >= MIN_LABELS)
    bad = (F.col("template_bad") > 0) & enough & (F.col("purity") >= REJECT)
    of_host = judged.where(F.col("tree") != SHARED).select(F.substring("tree", 2, 2**31 - 1).alias("host"), "shape", "template", "purity", bad.alias("host_bad"), (F.col("template_labelled") > 0).alias("known"))
    of_all = judged.where(F.col("tree") == SHARED).select("shape", F.col("template").alias("shared_template"), F.col("purity").alias("shared_purity"), (F.coalesce("hosts", F.lit(False)) & (F.col("template_labelled") >= MIN_LABELS)).alias("shared_known"), bad.alias("shared_bad"))
    by_all = ~F.col("known") & F.col("shared_known")
    of_shape = of_host.join(of_all, "shape").select(
        "host", "shape",
        F.when(by_all, F.col("shared_template")).otherwise(F.col("template")).alias("template"),
        F.when(by_all, F.col("shared_purity")).otherwise(F.col("purity")).alias("purity"),
        F.when(by_all, F.col("shared_bad")).otherwise(F.col("host_bad")).alias("rejected"),
        F.when(by_all, "shared").when(F.col("known"), "host").otherwise("none").alias("basis"),
    )
    out = rows.drop("bad").join(of_shape, ["host", "shape"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "purity", F.when(F.col("rule").isNotNull(), "rule").otherwise(F.col("basis")).alias("basis"))
