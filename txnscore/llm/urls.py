"""Verdicts on urls from rules and, where no rule speaks, from per-host path templates.

Every host has a tree of path segments. Going down, segments that vary by their
form (numbers, hexadecimal and other keys) become placeholders, and siblings whose
urls go on alike - same next segments, same labels - are merged into one wildcard
branch by a chi-squared test against all siblings. A path's place in the finished
tree is its template. Templates are rejected by the share of blocked urls among
their labelled ones, smoothed towards one half. Labels are the verdicts of the rules.

All steps are aggregations and equi-joins over distinct (host, path) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnscore.session import materialize

ALLOW, BLOCK = "allow", "block"
# Where a path ends: no segment holds this character, it would end the path.
END = "#"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Filter:
    """``reject`` is the least purity of a blocked template, ``strength`` the labelled urls that the
    smoothing counts for; branches of less than ``few`` urls are like any other."""

    reject: float = 0.7
    strength: float = 4.0
    few: int = 5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The name of the longest rule that fits, else NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def form_of(segment: Column) -> Column:
    """A segment with what varies by its form replaced by placeholders; a star, brace or backslash of its own is escaped."""
    s = F.regexp_replace(segment, r"([\\*{}])", r"\\$1")
    s = F.regexp_replace(s, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{8,}\b", "{hex}")
    return F.regexp_replace(s, r"(?<![{\w])[0-9]+(?![\w}])|[0-9]{2,}", "{num}")


def _decided(tree: DataFrame, few: int) -> DataFrame:
    """Every node moved down over all levels that need no test.

    At such a level all urls that go on have the same segment, which stays, or none of the
    different ones has as many urls as a test asks for, which makes all of them one
    wildcard. Either way the urls of the node stay together, so a run of such levels is
    one step, however long; only levels on which large branches part are left.
    """
    each = tree.select("host", "template", (F.col("n_allow") + F.col("n_block") + F.col("n_none")).alias("n"), F.posexplode("forms").alias("pos", "segment"))
    # A branch counts every url with its label and with its continuation.
    branches = each.groupBy("host", "template", "pos", "segment").agg((2 * F.sum("n")).alias("n"))
    levels = branches.groupBy("host", "template", "pos").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.min("segment").alias("only"))
    token = F.when(F.col("kinds") == 1, F.col("only")).when(F.col("most") < few, F.lit("*"))
    # As many entries as the longest path has segments.
    ways = levels.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("pos", token.alias("token"))))["token"].alias("tokens"))
    open_ = F.array_position(F.transform("tokens", lambda t: t.isNull()), F.lit(True)).cast("int")
    ways = ways.select("host", "template", "tokens", F.when(open_ == 0, F.size("tokens")).otherwise(open_ - 1).alias("run")).where("run > 0")
    tree = tree.join(ways, ["host", "template"], "left")
    own = F.when(F.col("run").isNull(), 0).otherwise(F.least("run", F.size("forms")))
    moved = F.concat(F.col("template"), F.lit("/"), F.array_join(F.slice("tokens", F.lit(1), own), "/"))
    left = F.slice("forms", own + 1, F.size("forms"))
    goes = own > 0
    return tree.withColumns({"template": F.when(goes, moved).otherwise(F.col("template")), "forms": F.when(goes, left).otherwise(F.col("forms"))}).drop("run", "tokens")


def templates(paths: DataFrame, how: Filter = Filter()) -> DataFrame:
    """``paths`` (host, path, n_allow, n_block, n_none: distinct host and path) with ``template``.

    Goes down until no path has a further segment. A round of joins is one level of the
    nodes whose branches are large enough to be tested; see ``_decided`` for the others.
    """
    pieces = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    tree = materialize(paths.withColumns({"forms": F.transform(pieces, form_of), "template": F.lit("")}), "url-paths")
    found = None
    while True:
        # ``forms`` is what is left of a path below its node.
        tree = _decided(tree, how.few)
        here = F.coalesce(F.get("forms", F.lit(0)), F.lit(END))
        onward = F.coalesce(F.get("forms", F.lit(1)), F.lit(END))
        tree = tree.withColumn("here", here)
        # What a branch looks like: its next segments, and the labels below it.
        traits = F.explode(
            F.filter(
                F.array(
                    *(F.struct(F.lit(mark).alias("trait"), F.col(f"n_{mark}").alias("n")) for mark in ("allow", "block", "none")),
                    F.struct(F.concat(F.lit("/"), onward).alias("trait"), (F.col("n_allow") + F.col("n_block") + F.col("n_none")).alias("n")),
                ),
                lambda t: t["n"] > 0,
            )
        )
        seen = tree.select("host", "template", "here", traits.alias("t")).groupBy("host", "template", "here", "t.trait").agg(F.sum("t.n").alias("n"))
        node, branch = ["host", "template"], ["host", "template", "here"]
        sizes = seen.groupBy(*branch).agg(F.sum("n").alias("branch_n"), F.count("*").alias("branch_traits"))
        whole = seen.groupBy(*node, "trait").agg(F.sum("n").alias("trait_n"))
        totals = whole.groupBy(*node).agg(F.sum("trait_n").alias("node_n"), F.count("*").alias("traits"))
        # Sum over traits of (o - e)^2 / e = sum of o^2 / e - n, so traits a branch lacks need no row.
        parts = seen.join(whole, [*node, "trait"]).join(totals, node).join(sizes, branch)
        expected = F.col("branch_n") * F.col("trait_n") / F.col("node_n")
        tested = parts.groupBy(*branch, "branch_n", "traits").agg((F.sum(F.col("n") * F.col("n") / expected)).alias("ratio"))
        free = F.greatest(F.col("traits") - 1, F.lit(1))
        # The 99 % point of chi-squared (Wilson and Hilferty).
        limit = free * F.pow(1 - 2 / (9 * free) + 2.326 * F.sqrt(2 / (9 * free)), 3)
        alike = (F.col("ratio") - F.col("branch_n") <= limit) | (F.col("branch_n") < how.few)
        tested = tested.select(*branch, (alike & (F.col("here") != END)).alias("alike"))
        several = tested.where("alike").groupBy(*node).agg(F.count("*").alias("merged")).where("merged > 1")
        merged = tested.where("alike").join(several, node).select(*branch, F.lit(True).alias("merged"))
        step = F.when(F.col("here") == END, F.lit("")).when(F.col("merged"), F.lit("/*")).otherwise(F.concat(F.lit("/"), "here"))
        tree = tree.join(merged, branch, "left").withColumn("template", F.concat("template", step)).drop("merged", "here")
        over = F.size("forms") == 0
        tree = tree.withColumn("over", over).withColumn("forms", F.when(over, F.col("forms")).otherwise(F.slice("forms", F.lit(2), F.size("forms"))))
        tree = materialize(tree, "url-level")
        ended = tree.where("over").drop("over", "forms")
        found = ended if found is None else found.unionByName(ended)
        tree = tree.where("NOT over").drop("over")
        if tree.isEmpty():
            return found


def judge(pages: DataFrame, rules: list[Rule], how: Filter = Filter(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` of every row.

    The verdict is the longest fitting rule's; without one, ``block`` if the template's purity
    reaches ``how.reject``. A template without labelled urls has a purity of one half and is
    allowed. NULL urls and urls without ``://`` have an empty host and path, and a verdict
    like any other. Repeated urls count as often as they occur. An empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule = rule_of(rules, F.col("host"), F.col("path"))
    verdicts = {r.name: r.verdict for r in rules}
    known = F.create_map(*(F.lit(x) for kv in verdicts.items() for x in kv)) if verdicts else None
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("rule", rule)
    paths = paths.withColumn("ruled", known[F.col("rule")] if known is not None else F.lit(None).cast("string"))
    for mark, is_it in (("allow", F.col("ruled") == ALLOW), ("block", F.col("ruled") == BLOCK), ("none", F.col("ruled").isNull())):
        paths = paths.withColumn(f"n_{mark}", F.when(is_it, F.col("n")).otherwise(0).cast("long"))
    tree = templates(paths.drop("n"), how)
    found = tree.groupBy("host", "template").agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a"))
    purity = (F.col("b") + how.strength / 2) / (F.col("a") + F.col("b") + how.strength)
    found = found.select("host", "template", purity.alias("purity"))
    judged = tree.join(found, ["host", "template"]).select(
        "host", "path", "rule", "template", "purity", F.coalesce("ruled", F.when(F.col("purity") >= how.reject, BLOCK).otherwise(ALLOW)).alias("verdict")
    )
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
