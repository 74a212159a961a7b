"""Names and what they refer to: symbol tables by file, imports, and resolution by scope.

A word in an entity's text refers to the entity of that name in its own file; else in
a file that its file imports; else in the nearest folder.  Resolution works on distinct (file,
word), not on every place where a word stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.operators.skew import merged, salted
from deltascope.sources.tables import cut

#: Where a name was found.
OWN, IMPORTED, NEAREST = "own file", "imported file", "nearest folder"

# Import statements of the common languages; the first group is the module.
_STATEMENTS = (
    r"""(?m)^\s*from\s+([.\w]+)\s+import\b""",
    r"""(?m)^\s*import\s+(?:static\s+)?([\w]+(?:\.[\w]+)*)\s*(?:;|,|$|as\b)""",
    r"""(?m)\bfrom\s+['"]([^'"\n]+)['"]""",
    r"""\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""",
    r"""(?m)^\s*(?:pub\s+)?use\s+([\w]+(?:::[\w]+)*)""",
    r"""(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;""",
    r"""(?m)^\s*#include\s+["]([^"\n]+)["]""",
)
_EXTENSION = r"\.[A-Za-z0-9]+$"


def folder(path: Column) -> Column:
    """The folder of a path, without the last slash; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """A folder and all above it: from itself to the root (empty)."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(upto, F.array(F.lit(""))))


def module_name(path: Column) -> Column:
    """The path by which a file is imported: without its extension, and a folder for its index file."""
    return F.regexp_replace(F.regexp_replace(path, _EXTENSION, ""), r"/(?:__init__|index|mod)$", "")


def _segments(module: Column, path: Column) -> Column:
    """An imported module as a path; relative ones from the importing file's folder."""
    here = folder(path)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))  # one dot: this folder, two: the one above
    up = F.element_at(ancestors(here), F.least(F.greatest(dots, F.lit(1)), F.size(ancestors(here))))
    dotted = F.concat_ws("/", F.when(up != "", up), F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/"))
    climbs = F.size(F.regexp_extract_all(module, F.lit(r"\.\./"), 0))
    base = F.element_at(ancestors(here), F.least(climbs + 1, F.size(ancestors(here))))
    relative = F.concat_ws("/", F.when(base != "", base), F.regexp_replace(F.regexp_replace(module, r"^(?:\.{1,2}/)+", ""), _EXTENSION, ""))
    slashed = F.regexp_replace(module, _EXTENSION, "")
    rust = F.regexp_replace(F.translate(module, ":", "/"), "/+", "/")
    plain = F.regexp_replace(rust, r"^(?:crate|self|super)(?:/|$)", "")
    return F.when(module.rlike(r"^\.{1,2}/"), relative).when(module.startswith("."), dotted).when(module.contains("::"), plain).when(module.contains("/"), slashed).otherwise(F.translate(module, ".", "/"))


def import_statements(files: DataFrame) -> DataFrame:
    """file_path and the module paths that its text imports."""
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(x), 1) for x in _STATEMENTS))))
    rows = files.select("file_path", F.explode(found).alias("module"))
    return rows.select("file_path", _segments(F.col("module"), F.col("file_path")).alias("module")).where("module <> ''").distinct()


def imports(files: DataFrame) -> DataFrame:
    """file_path, target_path: the files of the table that a file imports.

    A module names a file by its whole path or an end of it (after a slash), or a name inside that file.  Files
    meet modules on whole ends, so that no two files are compared because they share a last name only.
    """
    modules = import_statements(files)
    wanted = modules.withColumn("inside", F.regexp_replace("module", "/?[^/]*$", ""))
    wanted = wanted.select("file_path", F.explode(F.array(F.struct(F.lit(0).alias("off"), F.col("module").alias("end")), F.struct(F.lit(1).alias("off"), F.col("inside").alias("end")))).alias("x")).select("file_path", "x.*").where("end <> ''").distinct()
    parts = F.split(module_name(F.col("file_path")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    known = files.select(F.col("file_path").alias("target_path"), F.explode(ends).alias("end")).distinct()
    # an end that several files have leads to the one nearest to the root, then first by name
    one = known.groupBy("end").agg(F.min(F.struct(F.size(F.split("target_path", "/")), "target_path"))["target_path"].alias("target_path"))
    met = salted(wanted, one, ["end"], ["file_path"])
    return met.where("file_path <> target_path").select("file_path", "target_path").distinct()


def definitions(entities: DataFrame) -> DataFrame:
    """word, file_path, entity_id: the first entity of each name in each file (members by their last name)."""
    name = F.regexp_extract(F.coalesce("entity_name", F.lit("")), r"([^:.]*)$", 1)
    line = F.col("start_line") if "start_line" in entities.columns else F.lit(0)
    rows = entities.select(name.alias("word"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.struct(line.alias("line"), F.col("entity_id")).alias("at")).where("word <> ''")
    return rows.groupBy("word", "file_path").agg(F.min("at")["entity_id"].alias("entity_id"))


def _words(entities: DataFrame) -> DataFrame:
    """src, file_path and each distinct word of the text."""
    words = F.col("words") if "words" in entities.columns else F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)
    return entities.select(F.col("entity_id").alias("src"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.explode(F.array_distinct(words)).alias("word"))


def resolved(names: DataFrame, defined: DataFrame, imported: DataFrame | None) -> DataFrame:
    """file_path, word, dst, found: what each (file_path, word) of ``names`` refers to."""
    own = defined.select("file_path", "word", F.struct(F.lit(0).alias("tier"), F.lit(0).alias("far"), F.col("entity_id").alias("dst")).alias("x"))
    tiers = [names.join(merged(own), ["file_path", "word"])]
    if imported is not None:
        there = defined.select(F.col("file_path").alias("target_path"), "word", F.col("entity_id").alias("dst"))
        # a file's words go to the files it imports, not to all that define them
        reach = names.join(imported.distinct(), "file_path").join(merged(there), ["target_path", "word"])
        tiers.append(reach.select("file_path", "word", F.struct(F.lit(1).alias("tier"), F.lit(0).alias("far"), "dst").alias("x")))
    # nearest folder: the definitions below each folder are one (the least deep, then first by name and id)
    depth = F.size(F.split("file_path", "/"))
    below = defined.select("word", F.explode(ancestors(folder(F.col("file_path")))).alias("folder"), F.struct(depth.alias("depth"), F.col("file_path"), F.col("entity_id")).alias("at"))
    below = below.groupBy("word", "folder").agg(F.min("at")["entity_id"].alias("dst"))
    looked = names.select("file_path", "word", F.posexplode(ancestors(folder(F.col("file_path")))).alias("far", "folder"))
    near = salted(looked, merged(below), ["word", "folder"], ["file_path"])
    tiers.append(near.select("file_path", "word", F.struct(F.lit(2).alias("tier"), "far", "dst").alias("x")))
    rows = tiers[0]
    for more in tiers[1:]:
        rows = rows.unionByName(more)
    best = rows.groupBy("file_path", "word").agg(F.min("x").alias("x"))
    found = F.when(F.col("x.tier") == 0, OWN).when(F.col("x.tier") == 1, IMPORTED).otherwise(NEAREST)
    return best.select("file_path", "word", F.col("x.dst").alias("dst"), found.alias("found"))


def scoped_edges(entities: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """src, dst, found: the entities that each entity's text refers to, by scope.

    ``entities`` has entity_id, entity_name, file_path and content (or words); ``imported`` has
    file_path, target_path.  Entities of one name in several files are told apart by the file that speaks of them.
    Texts are taken apart once; definitions and names are tables, so that while they are small no word is shuffled to meet them.
    """
    defined = cut(definitions(entities))
    words = cut(salted(_words(entities), defined.select("word").distinct(), ["word"], ["src"], "left_semi"))
    names = cut(words.select("file_path", "word").distinct())
    tier = F.when(F.col("found") == OWN, 0).when(F.col("found") == IMPORTED, 1).otherwise(2)
    known = cut(resolved(names, defined, imported).select("file_path", "word", "dst", tier.alias("tier")))
    edges = words.join(known, ["file_path", "word"]).where("src <> dst").groupBy("src", "dst").agg(F.min("tier").alias("tier"))
    return edges.select("src", "dst", F.when(F.col("tier") == 0, OWN).when(F.col("tier") == 1, IMPORTED).otherwise(NEAREST).alias("found"))
