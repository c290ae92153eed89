"""What a changed working tree changes: files by their content, symbols of these, edges that hang on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Rounds, cut
from . import graph

REFERENCE = ("repo_id", "src", "kind", "receiver", "name")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, path, change) of files that are added, removed, or of other content; null hashes are equal."""
    a = old.select("repo_id", "path", F.col("content_sha").alias("was"), F.lit(True).alias("old"))
    b = new.select("repo_id", "path", F.col("content_sha").alias("is"), F.lit(True).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return a.join(b, ["repo_id", "path"], "full").select("repo_id", "path", change.alias("change")).where("change is not null")


def _touched(old_symbols: DataFrame, symbols: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, classes): (repo_id, name) of what was or is defined in changed files, and of classes alone, by either name."""
    at = changes.select("repo_id", F.col("path").alias("file_path"))
    columns = ["repo_id", "file_path", "kind", "name", "qualified_name"]
    both = old_symbols.select(*columns).unionByName(symbols.select(*columns)).where("kind <> 'import'").join(at, ["repo_id", "file_path"], "left_semi")
    names = both.select("repo_id", "name").distinct()
    classes = both.where("kind = 'class'").select("repo_id", F.explode(F.array("name", "qualified_name")).alias("name")).distinct()
    return names, classes


def _below(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """classes(repo_id, name) and all that have one of them among their bases, however far; ends where none is new."""
    keep = Rounds(bases.sparkSession, "bases").keep
    up = keep(bases.select("repo_id", "owner", "base").distinct())
    seen = new = keep(classes)
    while True:
        more = new.withColumnRenamed("name", "base").join(up, ["repo_id", "base"]).select("repo_id", F.col("owner").alias("name")).distinct()
        new = keep(more.join(seen, ["repo_id", "name"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = keep(seen.unionByName(new))


def _bases(references: DataFrame, symbols: DataFrame) -> DataFrame:
    owners = symbols.where("kind = 'class'").select("repo_id", F.col("id").alias("src"), F.col("name").alias("owner"))
    return references.where("kind = 'base'").join(owners, ["repo_id", "src"]).select("repo_id", "owner", F.col("name").alias("base"))


def affected(references: DataFrame, symbols: DataFrame, old_references: DataFrame, old_symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo_id, src): symbols whose references may lead elsewhere than before.

    Those of changed files; those with a reference whose name, or whose receiver, was or is defined in
    one; and those that ask a class for a method, by self or by its name, with a changed class among
    that class or its bases.
    """
    names, classes = _touched(old_symbols, symbols, changes)
    bases = _bases(references, symbols).unionByName(_bases(old_references, old_symbols))
    classes = _below(classes, bases)
    owner = symbols.select("repo_id", F.col("id").alias("src"), "file_path", F.when(F.col("kind") == "method", F.regexp_replace("qualified_name", r"\.[^.]*$", "")).alias("owner"))
    own = owner.join(changes.select("repo_id", F.col("path").alias("file_path")), ["repo_id", "file_path"], "left_semi").select("repo_id", "src")
    by_name = references.join(names, ["repo_id", "name"], "left_semi").select("repo_id", "src")
    receivers = names.unionByName(classes).distinct().withColumnRenamed("name", "receiver")
    by_receiver = references.where("kind = 'receiver'").join(receivers, ["repo_id", "receiver"], "left_semi").select("repo_id", "src")
    asking = references.where("kind = 'self'").select("repo_id", "src").distinct().join(owner, ["repo_id", "src"])
    by_self = asking.join(classes.withColumnRenamed("name", "owner"), ["repo_id", "owner"], "left_semi").select("repo_id", "src")
    return own.unionByName(by_name).unionByName(by_receiver).unionByName(by_self).distinct()


def refreshed_edges(old_edges: DataFrame, old_references: DataFrame, old_symbols: DataFrame, references: DataFrame, symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """The edges of resolve_references over all references, with those of affected symbols alone worked out again.

    symbols: with `old_id`, null where a symbol's file was read anew; the others' edges are kept under
    their new ids. All base references take part in the resolution, since chains of bases pass through
    classes that did not change.
    """
    again = cut(affected(references, symbols, old_references, old_symbols, changes))
    asked = references.join(again, ["repo_id", "src"], "left_semi")
    chains = references.where("kind = 'base'").join(again, ["repo_id", "src"], "left_anti")
    found, _ = graph.resolve_references(asked.select(*REFERENCE).unionByName(chains.select(*REFERENCE)), symbols.drop("old_id"))
    ids = symbols.where("old_id is not null").select("repo_id", "old_id", "id")
    kept = old_edges.select("repo_id", "src", "dst", "edge_type", "name", "tenths")
    for end in ("src", "dst"):
        kept = kept.join(ids.toDF("repo_id", end, f"new_{end}"), ["repo_id", end]).drop(end).withColumnRenamed(f"new_{end}", end)
    return found.join(again, ["repo_id", "src"], "left_semi").unionByName(kept.join(again, ["repo_id", "src"], "left_anti"))
